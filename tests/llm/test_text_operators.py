"""Text operators against plain versions of the same results, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandframe.llm import ann, attention, bpe, bpe_codec, fingerprint, langid, lm, ngram_join, packing, pii, registry, repair, shingles, toxicity
from strandframe.llm.common import fold
from strandframe.operators import graph

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null id, a clashing extra column."""
    rows = [(1, "The a b<|endoftext|>c", 1, "en"), (5, None, 2, None), (2, "", 3, "en"), (9, "中 文's x" * 700, 4, "fr"), (3, "é \n\n x", 1, "en"), (3, "é \n\n x", 1, "en"), (None, "null id", 1, "fr")]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, lang string")


def known(df):
    return [r for r in df.collect() if r["doc_id"] is not None]


def test_fingerprints(docs, texts):
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    ids = sorted(texts, reverse=True)
    for k, doc in enumerate(ids):
        x, y = texts[doc], texts[ids[(k + 1) % len(ids)]]
        half = len(x) // 2
        assert got[doc]["edited_sha256"] == hashlib.sha256((x[: len(x) - half] + y[:half]).encode()).hexdigest() and got[doc]["n_chars"] == len(x)
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.25 > 0.05 > np.mean([r["near_next"] for r in got.values()])


def test_fingerprint_estimates(spark):
    words = [f"w{k}" for k in range(4000)]
    d = spark.createDataFrame([(" ".join(words), " ".join(words[:1000]))], "a string, b string")
    a, b = fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b"))
    r = d.select(fingerprint.containment(b, a).alias("c"), fingerprint.likeness(a, b).alias("l"), (fingerprint.merge(a, b) == a).alias("m")).first()
    assert r["c"] == 1.0 and abs(r["l"] - 0.25) < 0.05 and r["m"]


def test_pii_against_plain_expressions(docs, texts):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def base(x):
        out = []
        for rank, (kind, p) in enumerate(patterns.items()):
            for m in re.finditer(p, x):
                d = re.sub("[^0-9]", "", m.group())
                luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
                if {"email": True, "ip": kind == "ip" and all(int(z) <= 255 for z in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                    out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
        return ",".join(x[2] for x in sorted(out))

    random.seed(3)
    alphabet = ["a@b.c", "_x@y", ".zz", "1.2.3", "4", ".", "4111 1111 1111 1111", "-", " ", "+1 (2", "34) 567 8901", "é", "\x01", "@", "999.1"]
    spark = docs.sparkSession
    made = [(10_000 + k, "".join(random.choice(alphabet) for _ in range(random.randint(0, 12)))) for k in range(400)]
    all_texts = dict(made) | texts
    rows = pii.find(docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))).collect()
    for r in rows:
        assert r["base_sha256"] == hashlib.sha256(base(all_texts[r["doc_id"]]).encode()).hexdigest(), all_texts[r["doc_id"]]


def test_pii_adds_and_redacts(spark):
    d = spark.createDataFrame([(1, "pay DE89370400440532013000 or DE89370400440532013001, ssn 123-45-6789, no 123-45-6789 a@b.cc"), (2, None)], "doc_id long, text string")
    r = {x["doc_id"]: x["text"] for x in pii.redact(d).collect()}
    assert r == {1: "pay [IBAN] or DE89370400440532013001, ssn [SSN], no [SSN] [EMAIL]", 2: None}
    assert pii.find(d).where("doc_id = 2").first()["spans"] == ""


def test_splitting_as_the_tokenizers_do():
    random.seed(1)
    chars = "ab 's't'll  \n\t\r\x0b\x1c\x85\xa0é²¼ßİıſƀȺ1 2中　😀«—’\x00ǅ"
    for path in (BYTE, WORD):
        words, whole = bpe.Words(bpe.read_vocabulary(path)), Tokenizer.from_file(path)
        for k in range(3000):
            x = "".join(random.choice(chars) for _ in range(random.randint(0, 14))) + ("<|endoftext|>'s  x" if k % 7 == 0 else "")
            assert np.frombuffer(words.encode(x), "<u2").tolist() == whole.encode(x, add_special_tokens=False).ids, repr(x)


@pytest.mark.parametrize("limit", [bpe_codec.BROADCAST_BYTES, 40_000, -1])
def test_codec(spark, odd, docs, limit):
    whole = Tokenizer.from_file(BYTE)
    for d in (odd, docs.limit(60)):
        d = d.select("doc_id", "text").cache()
        want = Counter()
        for r in d.collect():
            ids = whole.encode(r["text"] or "", add_special_tokens=False).ids
            want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in bpe_codec.round_trip(d, bpe.read_vocabulary(BYTE), limit).collect()) == want
    assert bpe_codec.round_trip(odd.limit(0), bpe.read_vocabulary(BYTE), limit).count() == 0


def test_best_fit_decreasing_on_counts():
    import bisect

    random.seed(2)
    for trial in range(150):
        capacity = random.choice([7, 10, 64, 1024])
        lengths = [min(capacity, 1 + int(random.expovariate(5 / (capacity + 5)))) if trial % 3 == 0 else random.randint(1, capacity) for _ in range(random.randint(0, 400))]
        rest, bins = [], 0
        for n in sorted(lengths, reverse=True):
            k = bisect.bisect_left(rest, n)
            room = rest.pop(k) if k < len(rest) else capacity
            bins += room == capacity
            bisect.insort(rest, room - n)
        runs, got = packing.best_fit_decreasing(dict(Counter(lengths)), capacity)
        held = defaultdict(list)
        for n, _, items, first, each, at in runs.tolist():
            for k in range(items):
                held[first + k // each].append((at + k % each * n, n))
        assert got == len(held) <= len(rest) and sum(map(len, held.values())) == len(lengths)
        for v in held.values():
            v.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False)) and v[0][0] == 0 and sum(v[-1]) <= capacity


def test_packing(odd, docs):
    whole, vocabulary = Tokenizer.from_file(BYTE), bpe.read_vocabulary(BYTE)
    d = docs.select("doc_id", "text")
    ids = {r["doc_id"]: whole.encode(r["text"], add_special_tokens=False).ids + [2] for r in d.collect()}
    held, seen = defaultdict(list), Counter()
    for r in packing.pack(d, vocabulary).orderBy("doc_id", "piece").collect():
        assert r["start"] == seen[r["doc_id"]] and r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        assert r["length"] == 1024 or r["piece"] == 0
        seen[r["doc_id"]] += r["length"]
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(seen[k] == len(v) for k, v in ids.items())
    for v in held.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False)) and sum(v[-1]) <= 1024
    assert len(held) <= 1.02 * -(-sum(seen.values()) // 1024) + 1
    assert packing.pack(odd, vocabulary).where("piece = 0").count() == odd.count() and packing.pack(odd.limit(0), vocabulary).count() == 0


def test_grammars():
    random.seed(4)
    for n in (0, 1, 2, 50, 5000):
        ids = np.array([random.choice([1, 2, 3, 40000]) for _ in range(n)], np.uint16)
        blob = repair.to_bytes(ids, 49408)
        first, rules, lengths, seq = repair.from_bytes(blob)
        assert (repair.expand(seq, rules, first) == ids).all()
        for a, k in ((0, n), (n // 3, n // 5), (n, 0)):
            assert (repair.decode_document(blob, a, k) == ids[a : a + k]).all()
    with pytest.raises(ValueError):
        repair.from_bytes(b"nothing of the kind" * 3)


def test_token_files(odd, docs):
    whole, vocabulary = Tokenizer.from_file(WORD), bpe.read_vocabulary(WORD)
    start = 0
    got = {r["doc_id"]: r for r in repair.round_trip(docs, vocabulary).collect()}
    for doc, text in sorted((r["doc_id"], r["text"]) for r in docs.collect()):
        ids = whole.encode(text, add_special_tokens=False).ids + [1]
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert repair.round_trip(odd, vocabulary).count() == odd.count() and repair.round_trip(odd.limit(0), vocabulary).count() == 0


def test_toxicity(spark, sf, docs, odd):
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/labels.parquet")
    big = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet")
    r = toxicity.classify(big, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(r) > 300 and ((r.predicted == r.toxic).mean() > 0.97) and r[r.predicted == 1].toxic.mean() > 0.95
    few = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (5, None), (1, 0)], "doc_id long, toxic int")
    assert toxicity.classify(odd, few).count() == odd.count() and toxicity.classify(odd.limit(0), few).count() == 0
    assert toxicity.classify(odd, few.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.reject(odd, few).columns == odd.columns


def test_language(spark, sf, odd):
    big = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    r = langid.classify(big).join(big.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (r.lang_pred == r.lang).mean() > 0.98 and r.score.between(0, 1).all()
    out = {x["doc_id"]: x for x in known(langid.classify(odd))}
    assert out[5]["lang_pred"] == out[2]["lang_pred"] == "und" and out[5]["score"] == 0 and langid.classify(odd.limit(0)).count() == 0
    assert langid.reject(odd).columns == odd.columns


def test_language_model_chances_add_up():
    m = langid.train("x", ["abc abd abe", "bca cab"] * 3)
    total = 0.0
    for c in "abcde \x02":  # every known character, and one for all that are not
        codes, starts = langid._codes(["ab" + c])
        total += 2 ** -float(langid.Costs([m]).of(langid._hashes(codes, langid.ORDER, np.array([len(codes) - 1])), codes, np.array([len(codes) - 1]))[0, 0])
    assert abs(total - 1) < 0.05


def test_attention_gradients():
    g = np.random.default_rng(0)
    m = {k: v.astype(float) for k, v in attention.initial(30, np.full(7, 1 / 7)).items()}
    x, y, real = g.integers(0, 30, (3, attention.WINDOW)), g.integers(0, 7, (3, attention.SCORED)), g.random((3, attention.SCORED)) < 0.8
    loss = lambda m: -(attention.log_probabilities(m, x, y) * real).sum() / real.sum()
    for k, grad in attention._gradients(m, x, y, real).items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        up, down = ({q: v.copy() for q, v in m.items()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - grad[at]) < 1e-6, k


def test_windows_score_each_token_once():
    ids = [np.arange(n) + 100 * n for n in (1, 23, 24, 25, 70)]
    x, y, real = attention.windows(ids, 999)
    assert (y[real] == np.concatenate(ids)).all() and (x[0, : attention.OVERLAP + 1] == 999).all()


@pytest.mark.parametrize("limit", [lm.BROADCAST_BYTES, 20_000, -1])
def test_lm_base(spark, odd, docs, limit):
    d = docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text").limit(80).union(odd.select("doc_id", "text").distinct())
    rows = [(r["doc_id"], shingles.words(r["text"])) for r in d.collect()]
    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0 for k, _ in rows}
    c = Counter(w for k, ws in rows if not held[k] for w in [*ws, b""])
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lm.score(d, fold("doc_id", 10) != 0, bpe.read_vocabulary(BYTE), limit).collect()}
    for k, ws in rows:
        want = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, b""])
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(ws) + 1, sum(c[w] > 0 for w in [*ws, b""]), n)
        assert abs(r["base_score"] - want) < 1e-7 * max(1, abs(want)) and r["score"] < 0
    assert lm.classify(odd.limit(0), bpe.read_vocabulary(BYTE)).count() == 0


def test_neighbours(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = defaultdict(list)
    for r in ann.nearest(e, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    p = e.toPandas().sort_values("vec_id")
    v, ids = np.stack([np.asarray(x, float) for x in p.embedding]), p.vec_id.to_numpy()
    norm = np.sqrt((v * v).sum(1))
    for q in np.flatnonzero(ids % 50 == 0):
        s = (v[q] * v).sum(1) / (norm[q] * norm)
        s[q] = -9
        assert got[ids[q]] == [(ids[k], s[k]) for k in np.lexsort((ids, -s))[:5]]


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "a"), (50, [1.0, 1.0], "b"), (1, [1.0, 0.0], "c"), (2, None, "d"), (3, [0.0, 0.0], "d"), (4, [float("nan"), 1.0], "d"), (5, [1.0, None], "e"), (6, [2.0, 0.0], "f"), (7, [1.0, 0.0, 0.0], "g"), (None, [1.0, 0.0], "h")]
    z = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = [tuple(r)[:3] for r in ann.nearest(z, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 6), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 6)]
    assert ann.nearest(z.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    ids, v = np.arange(400), np.random.default_rng(1).normal(size=(400, 8))
    v[100:300] = v[5]  # ties by the hundred
    got = defaultdict(list)
    for q, c, _ in ann.tile(ids[::20], v[::20], ids, v, 5):
        got[q].append(c)
    for q in ids[::20]:
        s = (v[q] * v).sum(1) / np.sqrt((v * v).sum(1)) / np.sqrt((v[q] * v[q]).sum())
        s[q] = -9
        assert got[q] == np.lexsort((ids, -s))[:5].tolist()


def plain_components(rows, words, percent):
    sets = [shingles.shingle_set(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a) and len(b) and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    parent[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 60)
    for k, (doc, _) in enumerate(rows):
        least[root(k)] = min(least[root(k)], doc)
    return {doc: (len(sets[k]), least[root(k)]) for k, (doc, _) in enumerate(rows)}


@pytest.mark.parametrize(("words", "percent", "frequent"), [(3, 90, 64), (5, 80, 2), (2, 70, 2)])
def test_jaccard_join(spark, monkeypatch, words, percent, frequent):
    g = np.random.default_rng(1)
    monkeypatch.setattr(ngram_join.signatures, "__defaults__", (frequent,))
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 40)
    texts = []
    for _ in range(200):
        x = [f"w{k}" for k in range(60)]
        for _ in range(g.integers(0, 5)):
            x[g.integers(0, 60)] = f"q{g.integers(0, 30)}"
        texts.append(" ".join(x[: g.integers(50, 61)]))
    rows = list(enumerate([*texts, "a b", "a  B", "a b c", "", None, " \n", *["a b c d e f g h i j k l m n"] * 2]))
    d = spark.createDataFrame([(k, t, 1) for k, t in rows] + [(None, "x y z", 2), (3, texts[3], 1)], "doc_id long, text string, n int")
    want = plain_components(rows, words, percent)
    got = ngram_join.join(d, words, percent).collect()
    assert len(got) == d.count() and all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)


def test_links_of_a_large_group_are_few(spark, monkeypatch):
    """150 near copies of one text, which share hundreds of signatures and fill several blocks, give about as many links as there are copies."""
    g, edges = np.random.default_rng(8), []
    monkeypatch.setattr(ngram_join.signatures, "__defaults__", (2,))
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 40)
    monkeypatch.setattr(ngram_join, "components", lambda e: edges.append(e.count()) or graph.components(e))
    rows = []
    for k in range(150):
        x = [f"w{i}" for i in range(60)]
        for _ in range(g.integers(1, 4)):
            x[g.integers(0, 60)] = f"q{k}"
        rows.append((k, " ".join(x)))
    want = plain_components(rows, 3, 80)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got) and len({c for _, c in want.values()}) > 1
    assert edges[0] < edges[-1] < 300


@pytest.mark.parametrize("dense", [True, False])
def test_groups_keep_each_signature_together(spark, monkeypatch, dense):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    monkeypatch.setattr(ngram_join, "components", graph.components)
    g = np.random.default_rng(2)
    signatures = [range(3 * s, 3 * s + 4) for s in range(100)] + [range(100, 112)] * 2 + [range(20, 60)] * (40 if dense else 1)
    if dense:
        signatures += [g.choice(np.arange(20, 60), 30, replace=False).tolist() for _ in range(20)]
    index = spark.createDataFrame([(int(k), s, int(k)) for s, of in enumerate(signatures) for k in of], "key long, signature long, label long")
    groups = defaultdict(set)
    blocks = {}
    for r in ngram_join._groups(index).collect():
        assert r["key"] not in groups[r["level"], r["tile"]] and r["label"] == r["key"]
        groups[r["level"], r["tile"]].add(r["key"])
        blocks[r["level"], r["tile"]] = r["blocks"]
    assert all(any(set(of) <= have for have in groups.values()) for of in signatures)
    assert all(blocks[at] == -(-len(have) // 16) for at, have in groups.items())
    assert sum(have >= set(range(20, 60)) for have in groups.values()) == 1


def test_one_of_each(spark, odd, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = {doc for doc, (_, c) in plain_components(rows, 5, 80).items() if doc == c}
    assert {r["doc_id"] for r in ngram_join.one_of_each(docs).collect()} == want
    assert ngram_join.one_of_each(odd).count() == odd.count() - 1 and ngram_join.join(odd.limit(0)).count() == 0


def test_components(spark):
    g = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in g.integers(-200, 200, (260, 2))]
    label = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = defaultdict(set)
    for a, b in edges:
        if a != b:
            assert label[a] == label[b]
    for n, k in label.items():
        groups[k].add(n)
    parent = {n: n for n in label}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, b in edges:
        if a != b:
            parent[root(a)] = root(b)
    assert len(groups) == len({root(n) for n in label})


def test_pipeline(spark, sf):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet")
    columns = d.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, d = d, stage(spark, d, sf).cache()
        assert d.columns == columns and 0 < d.count() <= before.count()
    assert d.select("doc_id").distinct().count() == d.count()
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == d.count()


def test_pipeline_on_odd_and_empty_tables(spark, sf, odd, docs, tmp_path):
    import corpus_pipeline

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id > 9")
    rows = plain.unionByName(odd.selectExpr("doc_id", "text", "lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")).withColumn("score", F.lit(1)).withColumn("label", F.lit("x"))
    for name, d in (("odd", rows), ("empty", rows.limit(0))):
        d.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name))
        kept = {r["doc_id"] for r in got.collect()}
        assert kept <= {r["doc_id"] for r in d.collect()} and bool(kept) == (name == "odd")


def test_registry_names_all():
    assert sorted(int(n[2 : n.index("_")]) for n in registry.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, sf, name):
    import parity

    df = registry.QUERIES[name](spark, sf)
    r = parity.connect(sf).execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert parity.rows(df.columns, [tuple(x) for x in df.collect()]) == parity.rows(columns, r.fetchall())


def test_lm_learns_from_all_training_documents(spark, docs):
    docs = docs.withColumn("ids", F.encode("text", "utf-8"))
    ids = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    for n in (1_000, 3_000, 6_000, 200_000, 10_000_000):
        seen = {r["doc_id"] for k in range(lm.ROUNDS) for r in lm._share(docs, n, k).collect()}
        assert seen == set(ids)
    taken = Counter(r["doc_id"] for k in range(lm.ROUNDS) for r in lm._share(docs, 10_000_000, k).collect())
    assert taken == ids  # once each, where the corpus is large


def test_lm_groups_ids_by_neighbours_in_all_documents(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(lm, "classes", lambda counts, sums: seen.update(counts=counts, sums=sums))
    d = spark.createDataFrame([(k, f"alpha beta gamma {k}") for k in range(3000)], "doc_id long, text string").repartition(7)
    vocabulary = bpe.read_vocabulary(BYTE)
    texts = lm.encoded(d.select("doc_id", F.lit(True).alias("learn"), F.lit(None).cast("string").alias("copy"), "text"), vocabulary, lm.Unigrams(np.zeros(0, np.uint64), np.zeros(0), 1, 1)).cache()
    counts = lm.id_counts(texts, bpe.loaded(vocabulary).tokenizer.get_vocab_size())
    lm.grouped(texts, counts)
    assert counts[-1] == 3000
    assert (seen["sums"][:, -1] == counts).all()


def test_lm_base_of_rows_that_share_an_id(spark):
    rows = [(None, "a b c d"), (None, "a zzz"), (None, None), (None, ""), (7, "a b"), (7, "a b"), (7, "q r s t u"), (8, "a b c"), (9, "d e")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary = bpe.read_vocabulary(BYTE)
    whole, joined = (sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 4)) for r in lm.score(d, F.col("doc_id") > 7, vocabulary, limit).collect()) for limit in (lm.BROADCAST_BYTES, -1))
    assert len(whole) == len(rows) and whole == joined


def test_grammars_replace_every_frequent_pair():
    g = np.random.default_rng(5)
    passage = g.permutation(64).astype(np.uint16)
    ids = np.concatenate([np.append(passage, np.uint16(100 + k)) for k in range(400)])
    rules, seq = repair.compress(ids, 1000)
    assert len(seq) <= 2 * 400 + 8 and (repair.expand(seq, rules, 1000) == ids).all()  # a passage is one symbol
    for ids in (np.zeros(1000, np.uint16), g.zipf(1.3, 60_000).clip(0, 20_000).astype(np.uint16), np.tile(np.array([1, 1, 1, 2], np.uint16), 300)):
        rules, seq = repair.compress(ids, 30_000)
        assert (repair.expand(seq, rules, 30_000) == ids).all() and len(rules) < repair.SYMBOLS - 30_000
        n: Counter = Counter()
        last = None
        for k, pair in enumerate(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True)):
            if pair == last and pair[0] == pair[1] and k == at + 1:  # overlaps the one before
                last = None
                continue
            n[pair] += 1
            last, at = pair, k
        assert max(n.values(), default=0) < repair.LEAST


def test_grammars_sort_all_pairs_once(monkeypatch):
    """After the first round only pairs beside replaced ones are grouped anew."""
    grouped, add = [], repair._Pairs._add
    monkeypatch.setattr(repair._Pairs, "_add", lambda self, at: (grouped.append(len(at)), add(self, at))[1])
    ids = (np.random.default_rng(5).zipf(1.3, 60_000) % 300).astype("<u2")
    rules, seq = repair.compress(ids, 300)
    assert grouped[0] == len(ids) - 1
    assert sum(grouped[1:]) <= 2 * (len(ids) - len(seq))
    assert np.array_equal(repair.expand(seq, rules, 300), ids)


@pytest.mark.parametrize("seed", range(6))
def test_grammars_against_plain_counts(seed):
    """Rules and sequence are those of counting every pair afresh in each round."""
    rng = np.random.default_rng(seed)
    ids = np.repeat(rng.integers(0, 4, 120), rng.integers(1, 5, 120)).astype("<u2")
    seq, rules = ids.tolist(), []

    def places(chosen):
        out, k = [], 0
        while k < len(seq) - 1:  # overlapping places: every other one from the left
            if (seq[k], seq[k + 1]) in chosen:
                out.append(k)
                k += 1
            k += 1
        return out

    while len(seq) > 1:
        n = {p: len([k for k in places({p})]) for p in set(zip(seq, seq[1:], strict=False))}
        top = max(n.values())
        if top < 3:
            break
        chosen = {p for p in n if n[p] >= max(3, (top + 1) // 2)}
        used = Counter((seq[k], seq[k + 1]) for k in places(chosen))
        kept = sorted(p for p in chosen if used[p] >= 3)
        if not kept:
            chosen = kept = [min(p for p in n if n[p] == top)]
        new = {p: 4 + len(rules) + k for k, p in enumerate(kept)}
        at = {k: new.get((seq[k], seq[k + 1])) for k in places(set(chosen))}
        at = {k: s for k, s in at.items() if s is not None}
        seq = [at.get(k, s) for k, s in enumerate(seq) if k - 1 not in at]
        rules += kept
    got, left = repair.compress(ids, 4, least=3)
    assert got.tolist() == [list(p) for p in rules] and left.tolist() == seq


def test_language_rejects_what_it_did_not_learn(spark, sf):
    g = random.Random(4)
    big = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(10_000_000 + k, "".join(chr(0x4E00 + g.randrange(20_000)) for _ in range(60)), "en") for k in range(8)]
    models = langid.fit(big.union(spark.createDataFrame(odd, big.schema)), F.lit(True))
    letters = "qxzjkvwpyfgbmdh"
    planted = [(k, " ".join("".join(g.choice(letters) for _ in range(g.randint(3, 9))) for _ in range(150)), "gibberish") for k in range(20)]
    planted += [(100 + k, " ".join(g.choice("niin kuin myös yhdessä työtä kyllä hyvää päivää että järjestelmä pöytäkirja äidinkieli".split()) for _ in range(150)), "fi") for k in range(20)]
    r = langid.identify(spark.createDataFrame(planted, big.schema), models).toPandas()
    assert r.rejected.all(), r.groupby("lang").rejected.mean()
    kept = langid.identify(big, models).agg(F.avg((~F.col("rejected")).cast("int"))).first()[0]
    assert kept > 0.97, kept


def test_fingerprints_against_plain_sketches(spark):
    import xxhash

    def plain(text):
        w = [x for x in re.split(r"[ \t-\r]+", (text or "").lower()) if x]
        h = lambda words: __import__("functools").reduce(lambda seed, x: xxhash.xxh64_intdigest(x.encode(), seed), words, 42) & (2**63 - 1)
        all_ = {h(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {h([" ".join(w)])} if w else set()
        low = {x for x in all_ if x < (2**63 - 1) // fingerprint.SCALE}
        return low or ({min(all_)} if all_ else set())

    g = random.Random(6)
    texts = [" ".join(g.choice("abcdefgh") + str(g.randrange(3)) for _ in range(n)) for n in (1, 4, 5, 30, 300, 2000)] + ["", None, "same one", "same one"]
    ids = [5, -(10**12), 10**15, 7, 8, 9, 10, 11, 12, 12]
    d = spark.createDataFrame([(k, t, "x") for k, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp string")
    got = fingerprint.fingerprints(d).collect()
    assert len(got) == len(texts)
    order = sorted(zip(ids, texts, strict=True), key=lambda r: (-r[0], r[1] or ""))
    following = {k: order[(n + 1) % len(order)][1] for n, (k, _) in enumerate(order)}
    text_of = dict(order)
    for r in got:
        a = plain(text_of[r["doc_id"]])
        assert r["fingerprint"] == ",".join(f"{x:x}" for x in sorted(a))
        if r["doc_id"] != 12:
            b = plain(following[r["doc_id"]])
            assert abs(r["near_next"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12
    assert fingerprint.fingerprints(d.limit(0)).count() == 0 and fingerprint.fingerprints(d.limit(1)).count() == 1


def test_columns_of_the_same_name_stay(spark):
    d = spark.createDataFrame([(1, "write to a@b.cc today", "KEEP", "q"), (2, None, "NULL", "r"), (3, "", "EMPTY", "s")], "doc_id long, text string, pii_spans string, toxic_score string")
    assert {(r["text"], r["pii_spans"]) for r in pii.redact(d).collect()} == {("write to [EMAIL] today", "KEEP"), (None, "NULL"), ("", "EMPTY")}
    few = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r["toxic_score"] for r in toxicity.reject(d, few).collect()} <= {"q", "r", "s"}
    assert pii.find(d.limit(0)).count() == 0 and pii.redact(d.limit(0)).columns == d.columns


def test_redacts_many_spans_of_a_long_text(spark):
    parts = [f"w{k} 😀 a{k}@b.cc" for k in range(700)]
    d = spark.createDataFrame([(1, " ".join(parts)), (2, "x" * 4096 + " a@b.cc"), (3, "y" * 9000 + "\n a@b.cc " + "z" * 9000)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    assert got[1] == " ".join(f"w{k} 😀 [EMAIL]" for k in range(700))
    assert got[2] == "x" * 4096 + " [EMAIL]" and got[3] == "y" * 9000 + "\n [EMAIL] " + "z" * 9000


def test_numbers_are_no_letters(spark):
    d = spark.createDataFrame([(1, "²³ ½ ① Ⅷ 12"), (2, "word")], "doc_id long, text string")
    models = langid.fit(spark.createDataFrame([(k, "some words here", "en") for k in range(20)], "doc_id long, text string, lang string"), F.lit(True))
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(d, models).collect()}[1] == ("und", 0.0)


def test_new_words_go_to_the_model_alone():
    """Ids as the whole tokenizer gives them, without its passes over words that are split already."""
    import time

    words, rng = bpe.Words(bpe.read_vocabulary(WORD)), random.Random(5)
    odd = ["caf\u00e9", "na\u00efve", "\u4e2d\u6587", "\u0430\u0431\u0432", "\U0001f600", "x\x7f", "\x01\x02", "\u00ad", "don't", "1\u00bd", "e\u0301", "\u0130", "<|endoftext|>", "\u017f", "&;", ""]
    texts = [" ".join(rng.sample(odd, 5)) + rng.choice(odd) for _ in range(200)]
    want = [np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert words.encode_all(texts) == want
    new = {"".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(20_000)}

    def seconds(work):
        t = time.thread_time()
        work()
        return time.thread_time() - t

    def alone():
        words.table, words.before = {}, {}
        words._fill(new)

    whole = min(seconds(lambda: words.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)) for _ in range(3))
    assert min(seconds(alone) for _ in range(3)) < whole
