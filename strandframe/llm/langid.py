"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of ORDER-character sequences: sorted arrays of n-gram hashes with their discounted
probabilities, and of context hashes with the weight left for the shorter context. A text goes to the language under which
it has the lowest cross-entropy per character. A rejection bound for each language is calibrated on documents that its
model did not see: texts far less likely than those, and texts without a letter, are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import fold, fresh

ORDER = 5
#: Documents of each language learned from, about (each is taken with the same chance, by a hash of its id); the share of them kept for calibration.
SAMPLE, CALIBRATE = 1500, 5
#: Share of the calibration texts' characters that lie in texts within the bound, before the margin.
QUANTILE = 0.99
#: Bits a character beyond that quantile, and the spread of a calibrated text's score.
MARGIN, SHARPNESS = 1.0, 6.0
#: Bits by which a whole text must lie beyond its language's bound to be rejected: a few odd letters are no evidence.
EVIDENCE = 24.0
#: n-grams of the two longest orders that occur once are left out; their mass goes to the shorter context.
LEAST = 2
START = 1
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 20
#: Distinct n-grams whose costs a task keeps; beyond, it starts afresh.
KEPT_GRAMS = 600_000


@dataclass
class Model:
    """Of one language: n-gram hashes and probabilities, context hashes and weights, by order; the rejection bound in bits a character."""

    lang: str
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    alphabet: int
    bound: float


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of Unicode's letter categories; numbers that look like letters are none."""
    return bool(text) and any(map(str.isalpha, text))


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case of all texts, each after ORDER - 1 start marks; and where each text's marks begin."""
    pad = chr(START) * (ORDER - 1)
    lowered = [pad + (t or "").lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.cumsum([0, *map(len, lowered)])


def _hashes(codes: np.ndarray, n: int, ends: np.ndarray) -> np.ndarray:
    """Hashes of the n characters up to each of the ends; of none, a constant."""
    h = np.full(len(ends), n, np.uint64)
    for k in range(n - 1, -1, -1):
        h = (h ^ codes[ends - k].astype(np.uint64)) * MULTIPLY
        h ^= h >> np.uint64(29)
    return h


def _scored(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions that are characters of a text, not start marks."""
    real = np.ones(len(codes), bool)
    for k in range(ORDER - 1):
        real[starts[:-1] + k] = False
    return np.flatnonzero(real)


def train(lang: str, texts: list[str]) -> Model:
    """The model of a language from its texts; the bound is open until calibrated."""
    codes, starts = _codes(texts)
    at = _scored(codes, starts)
    grams, contexts = [], []
    full = _hashes(codes, ORDER, at)
    _, first, counts = np.unique(full, return_index=True, return_counts=True)
    ends = at[first]  # where each distinct n-gram of the order ends, once
    for n in range(ORDER, 0, -1):
        h, c = _hashes(codes, n, ends), _hashes(codes, n - 1, ends - 1)
        # Distinct n-grams, their counts (lower orders: of the different characters before them) and their contexts.
        h, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        count = np.bincount(inverse, weights=counts).astype(np.int64)
        ends, c = ends[index], c[index]
        once, twice = (count == 1).sum(), (count == 2).sum()
        d = once / (once + 2 * twice) if once and twice else 0.5
        ctx, of = np.unique(c, return_inverse=True)
        total = np.bincount(of, weights=count)
        keep = count >= (LEAST if n > ORDER - 2 else 1)
        left = 1 - np.bincount(of, weights=np.where(keep, count - d, 0.0), minlength=len(ctx)) / total
        grams.append((h[keep], ((count - d) / total[of])[keep].astype(np.float32)))
        contexts.append((ctx, left.astype(np.float32)))
        counts = np.ones(len(ends), np.int64)  # each distinct n-gram continues its shorter one once
    return Model(lang, grams[::-1], contexts[::-1], len(grams[-1][0]) + 1, float("inf"))


def _find(keys: np.ndarray, values: np.ndarray, h: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(h), missing, np.float32)
    k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[k] == h, values[k], np.float32(missing))


class Costs:
    """Bits that each character costs each model, kept for the n-grams met so far."""

    def __init__(self, models: list[Model]):
        self.models = models
        self.forget()

    def forget(self) -> None:
        self.keys, self.bits = np.zeros(0, np.uint64), np.zeros((0, len(self.models)), np.float32)

    def of(self, full: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits of distinct n-grams, of which each has its hash and a place where it ends."""
        k = np.searchsorted(self.keys, full)
        new = np.flatnonzero((self.keys[np.minimum(k, len(self.keys) - 1)] != full) if len(self.keys) else np.ones(len(full), bool))
        if len(new):
            if len(self.keys) + len(new) > KEPT_GRAMS:
                self.forget()
                new = np.arange(len(full))
            bits = self._computed(codes, ends[new])
            keys = np.concatenate((self.keys, full[new]))
            order = np.argsort(keys, kind="stable")
            self.keys, self.bits = keys[order], np.concatenate((self.bits, bits))[order]
            k = np.searchsorted(self.keys, full)
        return self.bits[k]

    def _computed(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        grams = [_hashes(codes, n, ends) for n in range(1, ORDER + 1)]
        contexts = [_hashes(codes, n - 1, ends - 1) for n in range(1, ORDER + 1)]
        out = np.empty((len(ends), len(self.models)), np.float32)
        for k, m in enumerate(self.models):
            p = np.full(len(ends), 1 / m.alphabet, np.float32)
            for n in range(ORDER):
                p = _find(*m.grams[n], grams[n], 0.0) + _find(*m.contexts[n], contexts[n], 1.0) * p
            out[:, k] = -np.log2(p)
        return out


def entropies(costs: Costs, texts: list[str | None]) -> np.ndarray:
    """Bits a character of each text under each model; nothing for empty texts."""
    out = np.zeros((len(texts), len(costs.models)))
    codes, starts = _codes(texts)
    length = np.diff(starts) - (ORDER - 1)
    full = np.flatnonzero(length)
    if not len(full):
        return out
    at = _scored(codes, starts)
    which, seen = pd.factorize(_hashes(codes, ORDER, at))
    first = np.empty(len(seen), np.int64)
    first[which[::-1]] = at[::-1]  # one place of each distinct n-gram
    bits = costs.of(seen, codes, first)
    begin = np.concatenate(([0], np.cumsum(length[full])[:-1]))
    for k in range(len(costs.models)):
        out[full, k] = np.add.reduceat(bits[:, k][which], begin, dtype=np.float64) / length[full]
    return out


def bound_of(m: Model, texts: list[str]) -> float:
    """The rejection bound from texts that the model did not see; long texts weigh more, so that a few odd short ones do not set it."""
    e, weight = entropies(Costs([m]), texts)[:, 0], np.array([len(t) for t in texts], float)
    order = np.argsort(e, kind="stable")
    share = np.cumsum(weight[order]) / weight.sum()
    return float(e[order][np.searchsorted(share, QUANTILE)]) + MARGIN


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> list[Model]:
    """A model of each language, from whole texts of documents with a language for which learn holds.

    The driver gets the number of documents by language, then one model a language; each is trained in one task, from about
    `sample` texts however many there are.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    counts = known.groupBy("lang").count()
    order = F.abs(F.hash("doc_id", F.lit(23)).cast("double")) / 2**31
    chosen = known.join(F.broadcast(counts), "lang").where(order * F.col("count") < sample)

    def learned(texts: pd.DataFrame) -> pd.DataFrame:
        texts = texts.sort_values(["doc_id", "text"])
        held = np.arange(len(texts)) % CALIBRATE == CALIBRATE - 1
        m = train(texts["lang"].iloc[0], texts["text"][~held].tolist())
        kept = [t for t in texts["text"][held] if t] or [t for t in texts["text"] if t]
        bound = bound_of(m, kept) if kept else float("inf")
        row = {"lang": m.lang, "alphabet": m.alphabet, "bound": bound}
        for name, pairs in (("grams", m.grams), ("contexts", m.contexts)):
            row[f"{name}_hash"], row[name] = [a.tobytes() for a, _ in pairs], [b.tobytes() for _, b in pairs]
        return pd.DataFrame([row])

    schema = "lang string, alphabet int, bound double, grams_hash array<binary>, grams array<binary>, contexts_hash array<binary>, contexts array<binary>"
    pairs = lambda h, v: [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.float32)) for a, b in zip(h, v, strict=True)]
    got = chosen.groupBy("lang").applyInPandas(learned, schema).collect()
    return sorted((Model(r["lang"], pairs(r["grams_hash"], r["grams"]), pairs(r["contexts_hash"], r["contexts"]), r["alphabet"], r["bound"]) for r in got), key=lambda m: m.lang)


def identify(docs: DataFrame, models: list[Model], made: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with the language found, its score (0 to 1) and whether the text is rejected, in columns so named.

    Null texts, texts without a letter and all texts where no model was learned are ``und`` with score 0, and rejected.
    Ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = docs.drop(*made).schema.add(made[0], "string").add(made[1], "double").add(made[2], "boolean")

    def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """Consecutive texts of about CHUNK characters together."""
        first = held = 0
        for k, t in enumerate(texts):
            held += len(t or "")
            if held >= CHUNK:
                yield first, k + 1
                first, held = k + 1, 0
        if first < len(texts):
            yield first, len(texts)

    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.held("language", dict)  # in place of what other stages left
        models = shared.value
        costs = Costs(models)
        langs, bounds = np.array([m.lang for m in models], object), np.array([m.bound for m in models])
        for b in batches:
            texts = b["text"].tolist()
            lang, score, rejected = np.full(len(b), "und", object), np.zeros(len(b)), np.ones(len(b), bool)
            letters = np.array([has_letter(t) for t in texts])
            if len(models):
                for first, last in chunks(texts):
                    e = entropies(costs, texts[first:last])
                    best = e.argmin(1)
                    lowest = e[np.arange(len(e)), best]
                    lang[first:last], rejected[first:last] = langs[best], (lowest - bounds[best]) * [len(t or "") for t in texts[first:last]] > EVIDENCE
                    score[first:last] = 1 / np.exp2(-SHARPNESS * np.minimum(e - lowest[:, None], 100)).sum(1)
                lang[~letters], score[~letters], rejected[~letters] = "und", 0.0, True
            yield b.assign(**dict(zip(made, (lang, score, rejected), strict=True)))

    return docs.drop(*made).mapInPandas(predicted, schema)


def classify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each document; the held fold of the ids teaches nothing.

    Repeated rows give repeated rows; extra columns are ignored; an empty table gives no rows.
    """
    models = fit(docs, fold("doc_id", folds) != held)
    rows = identify(docs.select("doc_id", "text"), models)
    return rows.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score", "rejected")


def reject(docs: DataFrame) -> DataFrame:
    """docs without those that are rejected, in their own columns, whatever those are called.

    Null texts, empty ones and others without a letter go; repeated rows stay or go together; an empty table stays empty.
    """
    models = fit(docs, fold("doc_id", 4) != 2)
    made = fresh(docs, "lang_found", "lang_score", "lang_rejected")
    return identify(docs, models, tuple(made)).where(~F.col(made[2])).select(*docs.columns)
