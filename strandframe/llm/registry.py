"""Queries of the text operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, boilerplate, bpe, bpe_codec, fingerprint, langid, lm, ngram_join, packing, pii, repair, search, toxicity
from .common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.classify(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.classify(table(spark, sf_dir, "documents"), bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(table(spark, sf_dir, "documents"), bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), words=3, percent=90)


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.extract(table(spark, sf_dir, "pages"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, model = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")), alignment.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary, model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_fingerprints, op2_toxicity, op3_bpe, op4_language, op5_pii, op6_lm, op7_packing, op8_neighbours, op9_token_files, op10_jaccard, op11_html, op12_search, op13_alignment)}
#: The classifiers, tokenizers, packing and sketches have no SQL, nor has the nearest neighbours' last bit; they are tested against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op10_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        r AS (SELECT doc_id AS x, doc_id AS c FROM s UNION SELECT l.x, r.c FROM links l JOIN r ON r.x = l.y)
        SELECT s.doc_id, cast(len(s.sh) AS bigint) AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.sh)""",
    "op12_search": r"""
        WITH t AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
        total AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS terms FROM t WHERE len(t) > 0),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        weight AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, total),
        m AS (SELECT doc_id, 25 + (75 * len(t) * docs) // terms AS m FROM t, total),
        q AS (
            SELECT item_id, term, count(*) AS n FROM (
                SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
            GROUP BY ALL),
        s AS (
            SELECT item_id, doc_id, sum(n * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM q JOIN weight USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
        SELECT item_id, rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
}
