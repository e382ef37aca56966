"""Main text of pages: hand-made pages, the given ones, and repeated runs against a plain version."""

from __future__ import annotations

import html
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from strandframe.llm import boilerplate
from strandframe.llm.html_text import ARTICLE, CHROME, MAIN, OPEN, blocks

LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a &amp; b&nbsp;&#233; &lt;x&gt;<p>c<br>d\n\t e <b>f</b>g", [(OPEN, "a & b é <x>"), (OPEN, "c d e fg")]),
        ("<nav>m<ul><li>x</ul></nav><article><header><h1>T</h1></header><p>p<aside>s</aside>q</article><footer>f", [(CHROME, "m"), (CHROME, "x"), (ARTICLE, "T"), (ARTICLE, "p"), (CHROME, "s"), (ARTICLE, "q"), (CHROME, "f")]),
        ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no --><title>no</title><p>yes", [(OPEN, "yes")]),
        ("<main><div class='post-comments'><p>c</p></div><p>x</p></main><div class='with-sidebar'>y</div><div id=cookieNotice>z</div>", [(CHROME, "c"), (MAIN, "x"), (OPEN, "y"), (CHROME, "z")]),
        ("<header>h</header>1 < 2 <p hidden>no</p><p style='display: none'>no</p><div role=navigation>no</div>t<a href='x>y'>u</a>", [(CHROME, "h"), (OPEN, "1 < 2"), (CHROME, "no"), (CHROME, "no"), (CHROME, "no"), (OPEN, "tu")]),
        ("<p>a</b></div></p>b<p cla", [(OPEN, "a"), (OPEN, "b")]),
        ("<table><tr><td>1<td>2<tr><td>3</table>&am &amp &#x41;", [(OPEN, "1 2"), (OPEN, "3"), (OPEN, "&am & A")]),
        (None, []),
        ("", []),
        ("<script>never closed <p>x", []),
    ],
)
def test_blocks(page, want):
    assert [(b.part, b.text) for b in blocks(page)] == want


def test_broken_markup_takes_linear_time():
    for x in ("<p a='" * 60_000, "<div>" * 60_000 + "</p>" * 60_000, "<!--" * 60_000, "<script " * 60_000, "&" * 100_000, "<a b=\"c>" * 60_000, "<" * 100_000):
        blocks(x)


def own(k):
    return " ".join(f"w{k}x{j}" for j in range(40))


def page(article, *around):
    return "".join(f"<div>{a}</div>" for a in around[:1]) + f"<div>{article}</div>" + "".join(f"<div>{a}</div>" for a in around[1:])


def test_repeated_text_of_a_host_goes(spark):
    bar, foot = "We use cookies to make this site better for all of you, accept now?", "Copyright and imprint of the house of words, all rights are kept here"
    rows = [(k, f"https://U@a.example:80/{k}", page(f"Text number {k} is about {k * 7} things and {k * 11} more of them", bar, foot)) for k in range(6)]
    rows += [(20, "http://b.example/x", page("Another host with the same bar", bar)), (21, None, None), (22, "x", ""), (23, "http://A.example/c", rows[0][2]), (23, "http://A.example/c", rows[0][2]), (None, None, "<p>no host")]
    rows += [(30 + k, "http://c.example/", f"<p>{LONG} <i>{LONG.upper()}</i></p><p>page {k}") for k in range(3)]  # near copies
    rows += [(40 + k, "http://d.example/", f"<article><p>{own(k)}</p><p>Sign up for our letter today and get one every week</p><p>{own(k + 100)}</p></article>") for k in range(12)]
    got = defaultdict(list)
    for part_bytes in (boilerplate.PART_BYTES, 400):
        for r in boilerplate.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "'x' AS text"), part_bytes).collect():
            got[r["page_id"]].append(r["text"])
            assert r["n_chars"] == len(r["text"])
    for k in range(6):
        assert got[k] == [f"Text number {k} is about {k * 7} things and {k * 11} more of them"] * 2
    assert got[20] == [f"{bar}\n\nAnother host with the same bar"] * 2 and got[21] == got[22] == [""] * 2 and got[23] == got[0] * 2 and got[None] == ["no host"] * 2
    assert all(got[30 + k] == [f"{LONG} {LONG.upper()}\n\npage {k}"] * 2 for k in range(3))
    # in articles only what every page of the host has, in every part of it
    assert all(got[40 + k][0] == f"{own(k)}\n\n{own(k + 100)}" for k in range(12))


def test_given_pages(spark, sf):
    for r in boilerplate.extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " " if "<br" in x else "", x)).split()) for x in re.split(r"</?p>|</?h1>", article)]
        assert r["text"] == "\n\n".join(x for x in want if x)
    assert boilerplate.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_suffixes_against_all_windows():
    random.seed(4)
    for trial in range(200):
        pages = [np.array([random.randint(0, 2 if trial % 2 else 6) for _ in range(random.randint(0, 60))], np.uint32) for _ in range(random.randint(1, 9))]
        least = random.choice([1, 2, 3])
        want = defaultdict(lambda: [0, set()])
        for k, p in enumerate(pages):
            for i in range(len(p) - boilerplate.RUN + 1):
                want[tuple(p[i : i + boilerplate.RUN].tolist())][0] += 1
                want[tuple(p[i : i + boilerplate.RUN].tolist())][1].add(k)
        stream, page_of = boilerplate._joined([boilerplate._packed(p) for p in pages])
        at, starts, many = boilerplate.suffixes(stream, page_of, least)
        ends = [*starts[1:].tolist(), len(at)]
        got = {tuple(stream[at[a] : at[a] + boilerplate.RUN].tolist()): (b - a, m) for a, b, m in zip(starts.tolist(), ends, many.tolist(), strict=False)}
        assert got == {w: (n, len(s)) for w, (n, s) in want.items() if len(s) >= least}
        sorted_runs = [stream[i : i + boilerplate.RUN].tolist() for i in at]
        assert sorted_runs == sorted(sorted_runs)


def test_runs_of_articles_do_not_depend_on_the_cut(spark):
    """Counts of pages are of the whole host, not of each part; equal pages in several parts count once."""
    letter, rare = "Sign up for our letter today and get one every week", "Read more of the same in our printed paper that comes on Sunday"
    rows = []
    for k in range(60):  # the letter stands on 55 of 60, the paper on 50
        parts = [own(k), *([letter] if k % 12 else []), *([rare] if k % 6 else []), own(k + 100)]
        rows.append((k, "http://e.example/", "<article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article>"))
    rows += [(1000 + k, "http://e.example/", f"<!-- {k} -->" + rows[0][2]) for k in range(40)]  # copies without the letter, in many parts
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [{r["page_id"]: r["text"] for r in boilerplate.extract(df, b).collect()} for b in (boilerplate.PART_BYTES, 12_000, 2_000, 600)]
    assert not any(letter in t for t in got[0].values())
    assert all((rare in got[0][k]) == (k % 6 != 0) for k in range(60))
    assert got[1:] == got[:1] * 3
