"""Mixing sources to target weights: raking, then sampling by calibrated probabilities.

Documents fall into cells of source, language and topic; a cell weighs as many
tokens as it has. Iterative proportional fitting scales the cells until the
shares of every source, every language and every topic are the targets. What the
fitting multiplies a cell by, times one factor for the wanted number of tokens,
is the probability of its documents, at most 1.

Values without a target form the group ``OTHER``; if that has no target either,
its documents have probability 0. Targets of values that do not occur are left
out, the others scaled up. Where that would take a probability beyond 1, the
fitting goes on under the cap: each value of each dimension in turn gets the factor
that gives it its share with the cap in force, until all shares hold. A value with
fewer tokens than its share is drawn in full, and the other values of its dimension
share the rest in proportion to their targets. The number of tokens always holds;
shares that are missed are logged (``missed``).

The cells are as many as the targets allow, whatever the data (``MAX_CELLS`` at
most); they alone come to the driver. Counts cover all documents, summed within
tasks first, so a source with most of the rows is no hot key. The draw is a
function of id, text and seed: a rerun and a repeated row give the same answer.
Null texts have no tokens; documents without tokens are drawn like others.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlore.llm.shared import text_of

OTHER = "other"
MAX_CELLS = 1_000_000
ROUNDS = 200
TOLERANCE = 1e-9
# Under the cap fitting is slower; a pass over each dimension handles so many cells in all rounds, but ROUNDS at least.
CAPPED_ROUNDS = 5000
CAPPED_CELLS = 10_000_000
# A share that is so far from its target is reported.
MISSED = 1e-4

_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Targets:
    """Wanted shares by value of each dimension, and of all tokens the share to be drawn."""

    source: dict[str, float]
    lang: dict[str, float]
    topic: dict[str, float]
    share: float = 0.5

    def dimensions(self) -> tuple[tuple[str, dict[str, float]], ...]:
        return ("source", self.source), ("lang", self.lang), ("topic", self.topic)


def form_of(text: Column) -> Column:
    """A topic by form: tables, then prose by length."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.length(text) < 600, "note")
        .when(F.length(text) < 2400, "article")
        .otherwise("report")
    )


FORM_TARGETS = Targets(
    source={f"src{i}": 1.0 for i in range(20)} | {OTHER: 1.0},
    lang={"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.13, OTHER: 0.02},
    topic={"table": 0.05, "note": 0.1, "article": 0.4, "report": 0.45},
)


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def rake(counts: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """Factor of each cell of the array ``counts`` that gives it the target shares along each axis."""
    factors = (counts > 0).astype(float)
    for axis, target in enumerate(targets):
        # Without a target a group gets nothing.
        factors *= np.expand_dims(target > 0, [i for i in range(counts.ndim) if i != axis])
    for _ in range(ROUNDS):
        worst = 0.0
        for axis, target in enumerate(targets):
            others = tuple(i for i in range(counts.ndim) if i != axis)
            weight = (counts * factors).sum(axis=others)
            here = (weight > 0) & (target > 0)
            wanted = np.where(here, target, 0)
            if not wanted.sum():
                return factors
            wanted = wanted / wanted.sum()
            step = np.where(here, wanted / np.where(here, weight / weight.sum(), 1), 1.0)
            worst = max(worst, np.abs(step - 1).max())
            factors = factors * np.expand_dims(step, others)
        if worst < TOLERANCE:
            break
    return factors


def _scale(counts: np.ndarray, factors: np.ndarray, wanted: float) -> float:
    """What to multiply the factors by, so that they draw ``wanted`` of the counts if capped at 1, or all they can."""
    positive = factors > 0
    if not positive.any():
        return 1.0
    if counts[positive].sum() <= wanted:
        return 1 / factors[positive].min()
    order = np.argsort(-factors[positive])
    f, c = factors[positive][order], counts[positive][order]
    # With the first i cells capped, the factor follows from the rest.
    capped = np.concatenate(([0], np.cumsum(c)[:-1]))
    rest = np.cumsum((c * f)[::-1])[::-1]
    scale = np.where(rest > 0, (wanted - capped) / np.where(rest > 0, rest, 1), np.inf)
    return scale[int(np.argmax(scale * f <= 1))]


def probabilities(counts: np.ndarray, factors: np.ndarray, share: float) -> np.ndarray:
    """Probabilities in proportion to the factors, capped at 1, that draw ``share`` of all counts, or all they can."""
    wanted = share * counts.sum()
    positive = factors > 0
    if not positive.any() or (counts[positive].sum() <= wanted):
        return positive.astype(float)
    return np.minimum(1.0, _scale(counts, factors, wanted) * factors)


def _margin(weights: np.ndarray, axis: int) -> np.ndarray:
    return weights.sum(axis=tuple(i for i in range(weights.ndim) if i != axis))


def fitted(counts: np.ndarray, targets: list[np.ndarray], share: float) -> np.ndarray:
    """Probability of each cell, at most 1: ``share`` of all counts, with the target shares as far as the counts allow."""
    factors = rake(counts, targets)
    chosen = probabilities(counts, factors, share)
    there = factors > 0
    wanted, size = share * counts.sum(), (counts * there).sum()
    if size <= wanted or chosen.max() < 1:
        return chosen
    goals = []
    for axis, target in enumerate(targets):
        room = _margin(counts * there, axis)
        goals.append(room * probabilities(room, np.where(room > 0, target / np.where(room > 0, room, 1), 0), wanted / size))
    for _ in range(min(CAPPED_ROUNDS, max(ROUNDS, CAPPED_CELLS // counts.size))):
        for axis, goal in enumerate(goals):
            f, c = np.moveaxis(factors, axis, 0), np.moveaxis(counts, axis, 0)
            for i in np.flatnonzero(goal):
                f[i] *= _scale(c[i], f[i], goal[i])
            # Where shares exclude each other, factors would go on growing and shrinking.
            factors = np.where(there, np.clip(factors, 1e-100, 1e100), 0)
        weights = counts * np.minimum(1.0, factors)
        if max(np.abs(_margin(weights, axis) - goal).max() for axis, goal in enumerate(goals)) < TOLERANCE * wanted:
            break
    return probabilities(counts, factors, share)


def missed(counts: np.ndarray, chosen: np.ndarray, targets: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
    """Dimension, value, target and drawn share of what misses its target, over the values that occur."""
    found, weights = [], counts * chosen
    if not weights.sum():
        return found
    for axis, target in enumerate(targets):
        wanted = np.where(_margin(counts, axis) > 0, target, 0)
        drawn = _margin(weights, axis) / weights.sum()
        wanted = wanted / wanted.sum()
        found += [(axis, int(i), float(wanted[i]), float(drawn[i])) for i in np.flatnonzero(np.abs(drawn - wanted) > MISSED)]
    return found


def draw(
    docs: DataFrame, targets: Targets = FORM_TARGETS, topic_of=form_of, seed: int = 1, carry: Column | None = None
) -> DataFrame:
    """Every row of ``docs`` as ``row`` with its cell, tokens, ``probability`` and ``sampled``.

    ``carry`` is returned as ``row``; by default it is a struct of all columns.
    """
    spark = docs.sparkSession
    names = [name for name, _ in targets.dimensions()]
    values = [[*(v for v in target if v != OTHER), OTHER] for _, target in targets.dimensions()]
    if np.prod([len(v) for v in values]) > MAX_CELLS:
        raise ValueError(f"The targets allow more than {MAX_CELLS} cells")

    text = text_of()
    raw = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "topic": topic_of(text)}
    groups = [
        F.when(raw[name].isin(*known), raw[name]).otherwise(OTHER).alias(f"{name}_group")
        for name, known in zip(names, values, strict=True)
    ]
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), text), 11) / F.lit(float(1 << 53))
    rows = docs.select(
        (F.struct("*") if carry is None else carry).alias("row"),
        *groups,
        n_tokens(text).alias("n_tokens"),
        uniform.alias("uniform"),
    )
    keys = [f"{name}_group" for name in names]
    cells = rows.groupBy(*keys).agg(F.sum("n_tokens").alias("n_tokens")).collect()
    counts = np.zeros([len(v) for v in values])
    for cell in cells:
        counts[tuple(v.index(cell[k]) for v, k in zip(values, keys, strict=True))] = cell["n_tokens"]
    wanted = [np.array([target.get(v, 0.0) for v in known]) for known, (_, target) in zip(values, targets.dimensions(), strict=True)]
    chosen = fitted(counts, wanted, targets.share)
    for axis, i, target, drawn in missed(counts, chosen, wanted):
        _log.warning("%s %s: share %.4f instead of %.4f", names[axis], values[axis][i], drawn, target)
    table = [
        (*(v[i] for v, i in zip(values, at, strict=True)), float(chosen[at]))
        for at in (tuple(v.index(cell[k]) for v, k in zip(values, keys, strict=True)) for cell in cells)
    ]
    schema = ", ".join(f"{k} string" for k in keys) + ", probability double"
    # As many rows as cells.
    found = rows.join(F.broadcast(spark.createDataFrame(table, schema)), keys)
    return found.withColumn("sampled", F.col("uniform") < F.col("probability")).drop("uniform")


def mix(docs: DataFrame, targets: Targets = FORM_TARGETS, topic_of=form_of, seed: int = 1) -> DataFrame:
    """``doc_id, source_group, lang_group, topic_group, n_tokens, probability, sampled`` of every row."""
    found = draw(docs, targets, topic_of, seed, F.col("doc_id"))
    return found.withColumnRenamed("row", "doc_id")


def sample(docs: DataFrame, targets: Targets = FORM_TARGETS, topic_of=form_of, seed: int = 1) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns."""
    return draw(docs, targets, topic_of, seed).where("sampled").select("row.*")
