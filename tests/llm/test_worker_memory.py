"""What Python workers keep between tasks."""

import time
import tracemalloc

import numpy as np
import pandas as pd

from strandframe.llm import common, langid, ngram_join


def test_near_duplicates_leave_nothing_in_workers(spark):
    rows = [(k, f"{' '.join(f'w{k // 2}x{i}' for i in range(40))} {k % 2}") for k in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def kept(forget):
        def report(batches):
            for _ in batches:
                if forget:
                    common.held("nothing", dict)
                time.sleep(0.5)  # so that every worker has a task
                yield pd.DataFrame({"name": [str(common._held.get("name"))]})

        rows = spark.range(0, 64, 1, 8).mapInPandas(report, "name string").mapInPandas(lambda x: (b for b in x for b in report([b])), "name string")
        return {r["name"] for r in rows.collect()}

    kept(forget=True)
    assert ngram_join.one_of_each(docs).count() == 32
    assert "shingles" not in kept(forget=False)


def test_near_duplicates_with_shingles_of_all_texts(spark):
    """A phrase that all texts have is reported by their batches and goes past its bucket."""
    rows = [(k, f"one phrase that all of these texts have {' '.join(f'w{k // 2}x{i}' for i in range(60))} {k % 2}") for k in range(240)]
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 5, 80).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(k, k // 2 * 2) for k in range(240)]


def test_tiles_count_in_little_memory():
    """256 sets that share 300 shingles, and two of them all 340: the counts of 10 million products are added up in parts."""
    sets = [np.append(np.arange(300), 1000 + 40 * (k // 2) + np.arange(40)) for k in range(256)]
    for k in range(2, 256):
        sets[k] = np.append(np.arange(300), 100_000 + 300 * k + np.arange(300))
    sizes = np.array([len(s) for s in sets])
    tracemalloc.start()
    a, b = ngram_join.linked(sizes, sizes, np.concatenate(sets), np.arange(256), np.zeros(256, int), 80)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (a.tolist(), b.tolist()) == ([0], [1]) and most < 60 << 20


def test_language_forgets_what_other_stages_kept(spark):
    def names(keep):
        def report(batches):
            for _ in batches:
                if keep:
                    common.held("toxicity", dict)
                time.sleep(0.5)  # so that every worker has a task
                yield pd.DataFrame({"name": [str(common._held.get("name"))]})

        return {r["name"] for r in spark.range(0, 64, 1, 8).mapInPandas(report, "name string").collect()}

    docs = spark.createDataFrame([(k, "some plain text", "en") for k in range(64)], "doc_id long, text string, lang string").repartition(64)  # so that every worker has a task
    assert names(keep=True) == {"toxicity"}
    assert langid.identify(docs, []).where("lang_pred = 'und'").count() == 64
    assert "language" in names(keep=False)
