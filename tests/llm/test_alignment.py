"""Alignment of two tokenizers against a plain version that lists every overlapping pair."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strandframe.llm import alignment, bpe

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE), bpe.pieces(bpe.read_vocabulary(BYTE))


def plain(rows, tools):
    """Each row's values, worked out token by token."""
    a, b, a_pieces = tools

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    work, counts = [], Counter()
    for doc, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        whole = (" " + text).encode() if text else b""
        if b"".join(a_pieces[i] for i in x) != whole or b"".join(map(b_bytes, y)) != whole:
            x, y = [], []
        ea, eb = np.cumsum([len(a_pieces[i]) for i in x]).tolist(), np.cumsum([len(b_bytes(i)) for i in y]).tolist()
        links = [(x[i], y[j]) for i in range(len(x)) for j in range(len(y)) if max(([0] + ea)[i], ([0] + eb)[j]) < min(ea[i], eb[j])]
        counts.update(links)
        groups, i, j = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            p, q = ea.index(end) + 1, eb.index(end) + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            i, j = p, q
        work.append((doc, x, y, groups, links))
    top = {}
    for (_, j), n in counts.items():
        top[j] = max(top.get(j, 0), n)
    return Counter(
        (doc, len(x), len(y), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if x else "")
        for doc, x, y, groups, links in work
    )


@pytest.fixture(scope="module")
def made():
    random.seed(5)
    chars = ["a", "the", "The", "'s", "'ll", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\xa0", "　", " ", "é", "é", "²", "½", "12", "日本", "テ", "😀", "«", "\x00", "ing", "tion", "%%%", "<|endoftext|>", "</s>", "<unk>", "<0x0A>"]
    rows = [(k, "".join(random.choice(chars) for _ in range(random.randint(0, 14)))) for k in range(900)]
    return [*rows, (1000, None), (1001, ""), (1002, " "), (1003, "a ▁b the"), (None, "the id"), (3, rows[3][1]), (1004, "x" * 900), (1005, "the tions " * 150)]


@pytest.mark.parametrize("limit", [alignment.BROADCAST_BYTES, 3000, -1])
def test_alignment(spark, sf, tools, made, limit):
    texts = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 2500").limit(25).select("doc_id", "text")
    docs = spark.createDataFrame(made, "doc_id long, text string").union(texts).cache()
    got = Counter(tuple(r) for r in alignment.align(docs.selectExpr("doc_id", "text", "1 AS pair", "'x' AS rare"), bpe.read_vocabulary(BYTE), alignment.read_model(PIECE), limit).collect())
    assert got == plain([tuple(r) for r in docs.collect()], tools)
    assert not any(r[1:] != (0, 0, 0, 0, 0, 0, "") for r in got if r[0] in (1000, 1001, 1003))


def test_alignment_of_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), bpe.read_vocabulary(BYTE), alignment.read_model(PIECE)).count() == 0


def test_pointers_lead_to_the_last_token():
    random.seed(6)
    for _ in range(300):
        size = random.randint(1, 60)
        a, b = (np.array(sorted({*random.sample(range(1, size + 1), random.randint(1, size)), size})) for _ in range(2))
        both = sorted(set(a.tolist()) & set(b.tolist()))
        got = alignment.farthest(a, b)
        ends = np.concatenate((a, b))
        assert all(got[k] >= len(a) and ends[got[k]] == min(e for e in both if e >= ends[k]) for k in range(len(ends)))
