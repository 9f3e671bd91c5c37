import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlore.llm.mixing import FORM_TARGETS, OTHER, Targets, fitted, missed, mix, probabilities, rake, sample
from tests.llm.cases import awkward, empty


def test_raking_reaches_the_margins():
    draw = np.random.default_rng(3)
    counts = draw.integers(1, 1000, (4, 3, 5)).astype(float)
    counts[1, 2, :] = 0
    targets = [draw.random(n) for n in counts.shape]
    weights = counts * rake(counts, targets)
    for axis, target in enumerate(targets):
        share = weights.sum(axis=tuple(i for i in range(3) if i != axis)) / weights.sum()
        assert share == pytest.approx(target / target.sum(), abs=1e-7)
    # Raking multiplies by one number for each value only.
    factors = rake(counts, targets)
    assert factors[0, 0, 0] * factors[2, 1, 0] == pytest.approx(factors[0, 1, 0] * factors[2, 0, 0])


def test_missing_values_and_values_without_target():
    counts = np.array([[10.0, 30.0, 0.0], [60.0, 0.0, 5.0]])
    weights = counts * rake(counts, [np.array([0.5, 0.5]), np.array([0.2, 0.6, 0.0])])
    assert weights[1, 2] == 0
    assert rake(np.zeros((2, 2)), [np.ones(2), np.ones(2)]).sum() == 0


@pytest.mark.parametrize("share", [0.01, 0.3, 0.7, 1.0])
def test_probabilities_draw_the_share(share):
    draw = np.random.default_rng(4)
    counts, factors = draw.integers(1, 1000, 40).astype(float), draw.random(40) ** 3
    found = probabilities(counts, factors, share)
    assert found.max() <= 1 and (counts * found).sum() == pytest.approx(share * counts.sum())
    free = found < 1
    if free.any():
        assert np.ptp(found[free] / factors[free]) < 1e-9


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = mix(docs).cache()
    assert found.count() == docs.count()
    total, expected, drawn = found.agg(
        F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("probability")), F.sum(F.when(F.col("sampled"), F.col("n_tokens")))
    ).first()
    assert expected == pytest.approx(FORM_TARGETS.share * total) and drawn == pytest.approx(expected, rel=0.05)
    assert [r for r in found.where("sampled").select("doc_id").orderBy("doc_id").collect()] == [
        r for r in sample(docs).select("doc_id").orderBy("doc_id").collect()
    ]
    # Nothing is capped at a small share: then all margins are the targets.
    small = Targets(FORM_TARGETS.source, FORM_TARGETS.lang, FORM_TARGETS.topic, 0.02)
    for name, target in small.dimensions():
        mass = mix(docs, small).groupBy(f"{name}_group").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("m")).collect()
        whole = sum(r["m"] for r in mass)
        there = sum(target[r[0]] for r in mass)
        for r in mass:
            assert r["m"] / whole == pytest.approx(target[r[0]] / there, rel=1e-5)


def test_awkward_rows(spark):
    docs = awkward(spark)
    found = mix(docs).collect()
    assert len(found) == docs.count()
    assert {r["source_group"] for r in found} == {OTHER}
    everything = Targets({OTHER: 1.0}, {OTHER: 1.0}, {"note": 1.0, "report": 1.0}, 1.0)
    assert sample(docs, everything).columns == docs.columns
    assert sample(docs, everything).count() == docs.count()
    assert sample(docs, Targets({"nowhere": 1.0}, {"en": 1.0}, {"note": 1.0})).count() == 0
    assert mix(empty(spark)).collect() == []


def test_margins_hold_under_the_cap():
    draw = np.random.default_rng(6)
    counts = draw.integers(1, 1000, (6, 4, 3)).astype(float)
    # Targets that some probabilities of at most 1 reach, with many of them at 1.
    within = np.minimum(1, 0.5 * np.multiply.outer(np.multiply.outer(*(np.exp(draw.normal(size=n)) for n in (6, 4))), np.exp(draw.normal(size=3))))
    targets = [(counts * within).sum(axis=tuple(i for i in range(3) if i != a)) for a in range(3)]
    share = (counts * within).sum() / counts.sum()
    targets = [t / t.sum() for t in targets]
    before = probabilities(counts, rake(counts, targets), share)
    found = fitted(counts, targets, share)
    assert (within == 1).sum() > 10 and found == pytest.approx(within, abs=1e-4) and found.max() <= 1
    assert (counts * found).sum() == pytest.approx(share * counts.sum())
    assert missed(counts, before, targets) and not missed(counts, found, targets)


def test_unreachable_margins_are_reported():
    counts = np.array([[10.0, 400.0], [40.0, 550.0]])
    targets = [np.array([0.5, 0.5]), np.array([0.4, 0.6])]
    found = fitted(counts, targets, 0.5)
    weights = counts * found
    # Only 50 of 500 are there for the first column: all of them are drawn, and the rows hold.
    assert found[:, 0] == pytest.approx(1) and weights.sum(axis=1) == pytest.approx([250, 250], rel=1e-6)
    assert [(a, i) for a, i, *_ in missed(counts, found, targets)] == [(1, 0), (1, 1)]


def test_margins_at_the_registered_share(spark):
    found = mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).cache()
    mass = {}
    for name, _ in FORM_TARGETS.dimensions():
        rows = found.groupBy(f"{name}_group").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("m"), F.sum("n_tokens").alias("n")).collect()
        mass[name] = {r[0]: (r["m"], r["n"]) for r in rows}
    whole = sum(m for m, _ in mass["lang"].values())
    for name, target in (("source", FORM_TARGETS.source), ("lang", FORM_TARGETS.lang)):
        there = sum(target[v] for v in mass[name])
        for v, (m, _) in mass[name].items():
            assert m / whole == pytest.approx(target[v] / there, abs=1e-4), (name, v)
    # There are too few notes: all are drawn, and the other forms share the rest.
    notes, n = mass["topic"]["note"]
    assert notes == pytest.approx(n, rel=1e-4) and notes / whole < 0.1
    for v in ("table", "article", "report"):
        assert mass["topic"][v][0] / (whole - notes) == pytest.approx(FORM_TARGETS.topic[v] / 0.9, abs=1e-4)
