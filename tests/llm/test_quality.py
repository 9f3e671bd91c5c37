import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlore.llm.quality import SPAN, _repeated, _structure, judge, keep_good, quality_classifier, site_rates
from basketlore.llm.shared import Scratch
from tests.llm.cases import awkward, empty

LABELS = "doc_id bigint, quality int, toxic int"
BIG = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = quality_classifier(docs, labels.where(~held_out)).join(labels.where(held_out), "doc_id")
    counts = {
        (r["good"], r["keep"]): r["n"]
        for r in found.groupBy(((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"), "keep")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    kept, lost = counts[True, True], counts.get((True, False), 0)
    caught, missed = counts[False, False], counts.get((False, True), 0)
    assert kept / (kept + lost) > 0.98, counts
    assert caught / (caught + missed) > 0.9, counts


def test_sparse_sites_take_the_rate_of_the_level_above(spark):
    rows = [("a", "x", 5.0)] * 50 + [("a", "y", -5.0)] * 50 + [("b", "x", -5.0)] * 200 + [("b", "z", 5.0)] + [("c", "x", 5.0)]
    rows += [(None, None, -5.0)] * 3
    evidence = spark.createDataFrame(rows, "host string, path string, e double").select(
        "host", "path", F.struct(F.col("e").alias("low"), F.col("e").alias("toxic")).alias("evidence")
    )
    found = {(r["site_host"], r["site_path"]): r for r in site_rates(Scratch(spark, "sites"), evidence, {"low": 0.5, "toxic": 0.5}).collect()}
    assert found["a", "x"]["path_low"] > 0.9 and found["a", "y"]["path_low"] < 0.1
    assert found["b", "z"]["path_low"] < found["c", "x"]["path_low"] < 0.99
    assert found["b", "x"]["host_low"] < 0.05 and (None, None) in found


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 1), (None, 1, 1), (4, None, 0), (99, 1, 0)], LABELS)
    assert judge(docs, labels).count() == docs.count()
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    nothing = spark.createDataFrame([], LABELS)
    assert keep_good(docs, nothing).count() == docs.count()
    assert quality_classifier(empty(spark), labels).collect() == []


@pytest.mark.parametrize("size", [1, 100, SPAN - 1, SPAN, SPAN + 1, 3 * SPAN + 7])
@pytest.mark.parametrize("kinds", [1, 5, 150, 10_000])
def test_repeated_words_against_brute_force(size, kinds):
    words = np.random.default_rng(size).integers(0, kinds, size).astype(np.uint64)
    span = min(size, SPAN)
    shares = [1 - np.unique(words[i : i + span]).size / span for i in range(size - span + 1)]
    assert _repeated(words) == pytest.approx((np.mean(shares), max(shares)))


def test_repetition_after_a_clean_opening():
    clean = np.arange(1000, dtype=np.uint64)
    looping = np.concatenate((clean[:300], np.tile(clean[:3], 300)))
    assert _structure("", looping) != _structure("", clean)
    # The mean and the maximum of a text of one kind do not depend on its length.
    assert _structure("", np.tile(clean[:3], 100)) == _structure("", np.tile(clean[:3], 3000))
    assert _structure("", clean[:250]) == _structure("", clean)
