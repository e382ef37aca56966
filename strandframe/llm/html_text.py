"""Blocks of text of a web page, each with the part of the page that its markup says it is in."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Parts: furniture of the page by its markup; not said; and, by rising certainty, the article.
CHROME, OPEN, CONTENT, MAIN, ARTICLE = -1, 0, 1, 2, 3

RAW = "script|style|textarea|title|iframe|xmp|noembed|noframes"
TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<({RAW})(?=[\s/>])[^>]*+>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre search section select summary svg table tbody template tfoot thead tr ul video audio".split()
)
#: Between the words of these a space, but no new block.
SPACED = frozenset(["br", "td", "th", "img", "input", "wbr"]) - {"wbr"}
#: An open one of these ends where another of its kind begins, if nothing stands open between.
REPEATED = frozenset("p li dt dd tr td th option".split())
FURNITURE = frozenset("nav footer aside form button select noscript template svg dialog menu head search object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip".split())
#: First or last words of class names and ids of furniture.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion nav navbar navigation menu submenu sidebar footer banner masthead topbar cookie cookies consent gdpr notice notices notification notifications popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments disqus respond reply replies toolbar widget widgets skip copyright search form".split()
)
HEADERS = frozenset(["header"])
#: Names that tell how a page is laid out, not what an element is.
LAYOUT = frozenset("has with no without is not js".split())
CONTENTS = {"article": MAIN, "post": MAIN, "entry": MAIN, "story": MAIN, "hentry": MAIN, "main": CONTENT, "content": CONTENT}
CONTENT_WORDS = frozenset([*CONTENTS, "body", "text", "page", "single", "blog", "area", "inner", "wrapper", "container"])


@dataclass(frozen=True)
class Block:
    part: int
    text: str


def _named(value: str, inside: bool) -> int:
    """What class names or an id say."""
    found = OPEN
    for name in value.split():
        words = [w.lower() for w in WORDS.findall(name)]
        if not words or words[0] in LAYOUT:
            continue
        if words[0] in NAMES or words[-1] in NAMES or (not inside and not CONTENT_WORDS.intersection(words) and (words[0] in HEADERS or words[-1] in HEADERS)):
            return CHROME
        if CONTENT_WORDS.issuperset(words):
            found = max(found, *(CONTENTS.get(w, OPEN) for w in words))
    return found


def _element(tag: str, attributes: str, inside: bool) -> int:
    """The part that an element begins; `inside`: within an article."""
    if tag in FURNITURE or (tag == "header" and not inside):
        return CHROME
    found = ARTICLE if tag == "article" else MAIN if tag == "main" else OPEN
    if "=" in attributes or "hidden" in attributes:
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                return CHROME
            if key == "role":
                if value.lower() in ROLES:
                    return CHROME
                found = max(found, {"article": ARTICLE, "main": MAIN}.get(value.lower(), OPEN))
            elif key == "itemprop" and value == "articleBody":
                found = ARTICLE
            elif key in ("class", "id") and tag not in ("html", "body"):
                said = _named(value, inside)
                if said == CHROME and tag != "main":
                    return CHROME
                found = max(found, said)
    return found


def blocks(page: str | None) -> list[Block]:
    """The page's blocks of text in order, references decoded, white space as one space, without scripts, styles, titles and comments."""
    out: list[Block] = []
    pieces: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    parts = {CHROME: 0, CONTENT: 0, MAIN: 0, ARTICLE: 0}

    def end() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            part = CHROME if parts[CHROME] else ARTICLE if parts[ARTICLE] else MAIN if parts[MAIN] else CONTENT if parts[CONTENT] else OPEN
            out.append(Block(part, text))

    def close(k: int) -> None:
        for tag, part in stack[k:]:
            opened[tag] -= 1
            if part != OPEN:
                parts[part] -= 1
        del stack[k:]

    at, page = 0, page or ""
    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(html.unescape(piece) if "&" in piece else piece)
        at = m.end()
        closing, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            if m[1]:
                pieces.append(" ")
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            end()
        elif tag in SPACED:
            pieces.append(" ")
        if closing:
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                if any(part != OPEN for _, part in stack[k:]):
                    end()
                close(k)
        elif tag not in VOID and not attributes.endswith("/"):
            if tag in REPEATED and stack and stack[-1][0] == tag:
                close(len(stack) - 1)
            part = _element(tag, attributes, bool(parts[ARTICLE] or parts[MAIN])) if attributes or tag in BLOCKS else OPEN
            if part != OPEN:
                end()
                parts[part] += 1
            stack.append((tag, part))
            opened[tag] = opened.get(tag, 0) + 1
    if at < len(page):
        pieces.append(html.unescape(page[at:]))
    end()
    return out


def article_part(found: list[Block]) -> int:
    """The surest part that the page's markup names; OPEN where it names none."""
    return max((b.part for b in found), default=OPEN) if found else OPEN
