"""Word-wise use of public tokenizers: a text is split as its tokenizer splits it, and each distinct word is encoded once.

The vocabulary travels to the executors as the text of its file, so only the driver needs the path.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from .common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Letters, numbers and white space up to U+017F, where one expression of the standard library splits as the tokenizers do.
LETTER, NUMBER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾", "\t-\r \u0085 "
#: Texts with other characters are split by the tokenizer itself; U+0130 becomes two characters in lower case.
FOREIGN = re.compile("[^\x00-įı-ſ]")
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
# Letters and numbers first: no ending begins with one, so the order of these is free.
BYTE_WORDS = re.compile(f" ?[{LETTER}]+| ?[{NUMBER}]+|{ENDINGS}| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
LOWER_WORDS = re.compile(f"[{LETTER}]+|[{NUMBER}]|{ENDINGS}|[^{SPACE}{LETTER}{NUMBER}]+")
#: Distinct words that a worker keeps; as many as were kept before them are still looked up, and kept again when they recur.
KEPT_WORDS = 300_000

#: Bytes that byte-level vocabularies keep as they are, and the letters of the others, in turn from U+0100 on.
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
LETTERS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(PLAIN))}


def is_foreign(text: str) -> bool:
    """Whether a text has a character that only its tokenizer splits right."""
    try:
        text.encode("latin-1")  # most texts, fast
    except UnicodeEncodeError:
        return FOREIGN.search(text) is not None
    return False


def read_vocabulary(path: str) -> str:
    """The text of a tokenizer's file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def loaded(vocabulary: str, kept: int = KEPT_WORDS) -> Words:
    """The worker's Words for a vocabulary, made once."""
    words = held(("bpe", hash(vocabulary)), lambda: Words(vocabulary))
    words.kept = kept
    return words


class Words(dict):
    """Ids of words, as little-endian unsigned 16-bit integers; missing words are encoded when asked for.

    Splits either as byte-level tokenizers do (every character in some word) or as those that lower-case and drop white space.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.kept = KEPT_WORDS
        #: The same where new words are encoded in bulk: a plain dict, which sets are compared with at once.
        self.table: dict[str, bytes] = {}
        from tokenizers import Tokenizer

        conf = json.loads(vocabulary)
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lower = conf["normalizer"] is not None
        self.special = [x["content"] for x in conf["added_tokens"]]
        self.specials = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")")
        self.words = LOWER_WORDS if self.lower else BYTE_WORDS
        assert self.tokenizer.get_vocab_size() <= 1 << 16
        steps = (conf["pre_tokenizer"] or {}).get("pretokenizers", [])
        #: Whether a word, its bytes as letters, is all that the tokenizer's model sees.
        self.alone = self.lower and any(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x.get("use_regex", True) for x in steps)
        self.by_ranks = None if self.lower else _by_ranks(vocabulary, conf)

    def __missing__(self, word: str) -> bytes:
        self._make_room()
        ids = self.before.get(word)
        if ids is None:
            plain = self.by_ranks is not None and word not in self.special
            ids = array("H", self.by_ranks.encode_ordinary(word) if plain else self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def _make_room(self) -> None:
        if len(self) >= self.kept:
            self.before = dict(self)
            self.clear()

    def _fill(self, new: set[str]) -> None:
        """Encodes words by the tokenizer's model alone: they are in its normal form and split already, so only the steps between are left out."""
        before, table, tokenize = self.before, self.table, self.tokenizer.model.tokenize
        table.update((w, before[w]) for w in new if w in before)
        for w in new.intersection(self.special):
            table[w] = array("H", [self.tokenizer.token_to_id(w)]).tobytes()
        for w in [w for w in new if w not in table]:
            letters = w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(LETTERS)
            table[w] = array("H", [x.id for x in tokenize(letters)]).tobytes()

    def split(self, text: str) -> list[str]:
        """The words of a text, special tokens among them."""
        if is_foreign(text):
            return self._split_by_tokenizer(text)
        if not any(x in text for x in self.special):
            return self.words.findall(text.lower() if self.lower else text)
        out = []
        for k, part in enumerate(self.specials.split(text)):
            out += [part] if k % 2 else self.words.findall(part.lower() if self.lower else part)
        return out

    def _split_by_tokenizer(self, text: str) -> list[str]:
        t, out = self.tokenizer, []
        for k, part in enumerate(self.specials.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                part = t.normalizer.normalize_str(part) if self.lower else part
                out += [part[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def encode(self, text: str | None) -> bytes:
        """A text's ids, 16 bits each; none for null."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids; new words of all the texts are encoded at once."""
        found = [self.split(text) if text else [] for text in texts]
        if not self.alone:
            return [b"".join(map(self.__getitem__, f)) for f in found]
        if len(self.table) >= self.kept:
            self.before, self.table = self.table, {}
        if new := set().union(*found).difference(self.table):
            self._fill(new)
        return [b"".join(map(self.table.__getitem__, f)) for f in found]


def _by_ranks(vocabulary: str, conf: dict, words: str = r"(?s:.+)"):
    """The same byte-level merges by the ranks of their results, where ids follow the merges in order; that is faster for single words."""
    vocab, merges = conf["model"]["vocab"], conf["model"]["merges"]
    joined = ("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges)
    if conf["model"].get("ignore_merges") or any(vocab.get(w) != 256 + k for k, w in enumerate(joined)):
        return None
    import tiktoken

    special = {x["id"] for x in conf["added_tokens"]}
    ranks = {p: k for k, p in enumerate(pieces(vocabulary)) if p and k not in special}
    return tiktoken.Encoding("words", pat_str=words, mergeable_ranks=ranks, special_tokens={})


def pieces(vocabulary: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary: printable characters stand for themselves, later ones for the other bytes in turn."""
    byte_of = {chr(b): b for b in PLAIN} | {c: b for b, c in LETTERS.items()}
    conf = json.loads(vocabulary)
    out = [b""] * (1 + max([*conf["model"]["vocab"].values(), *(x["id"] for x in conf["added_tokens"])]))
    for word, k in conf["model"]["vocab"].items():
        out[k] = bytes(byte_of[c] for c in word)
    for x in conf["added_tokens"]:
        out[x["id"]] = x["content"].encode()
    return out
