"""Results over several support thresholds."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlore.functions.support import min_count
from basketlore.operators.apriori import AprioriResult, apriori, stack
from basketlore.operators.prep import basket_count
from basketlore.operators.son import SonResult, son

DEFAULT_SUPPORTS = (0.03, 0.025, 0.02)


def support_thresholds(items: DataFrame, supports=DEFAULT_SUPPORTS) -> DataFrame:
    """Minimum count of every threshold in every rounding mode."""
    total = items.agg(basket_count().alias("baskets"))
    each = F.explode(F.array(*(F.lit(float(s)) for s in supports))).alias("min_support")
    return total.select("baskets", each).select(
        "min_support",
        "baskets",
        *(
            min_count(F.col("baskets"), F.col("min_support"), mode).alias(f"{mode}_count")
            for mode in ("floor", "exact", "ceil")
        ),
    )


def _at_each(df: DataFrame, baskets: Column, supports, support_mode: str, reached: str) -> DataFrame:
    """Repeat every row at each threshold, in ``threshold``, whose minimum count its column ``reached`` reaches."""
    limits = F.array(
        *(
            F.struct(
                F.lit(float(s)).alias("threshold"),
                min_count(baskets, float(s), support_mode).alias("least"),
            )
            for s in supports
        )
    )
    return df.select("*", F.inline(limits)).where(F.col(reached) >= F.col("least")).drop("least")


class SupportSweep:
    """Itemsets and statistics of Apriori at every threshold, from one run at the lowest.

    ``itemsets`` has a ``min_support`` column; ``level_stats`` is
    ``(min_support, level, candidates, frequent)`` and ``summary`` is
    ``(min_support, total_itemsets)``. An itemset is frequent at a higher threshold
    if its support reaches it, and a candidate stands there if the smallest support
    among its subsets does.
    """

    def __init__(self, mined: AprioriResult, supports, support_mode: str):
        self.lowest, self.supports, self.support_mode = mined, supports, support_mode
        self.spark = mined.itemsets.sparkSession

    def _at_each(self, df: DataFrame, reached: str) -> DataFrame:
        return _at_each(df, F.lit(self.lowest.run.limits.total), self.supports, self.support_mode, reached)

    @property
    def itemsets(self) -> DataFrame:
        return self._at_each(self.lowest.itemsets, "support").withColumnRenamed("threshold", "min_support")

    @cached_property
    def _counts(self) -> dict[tuple[str, float, int], int]:
        """Frequent itemsets and listed candidates by threshold and length: one small row of each."""
        kinds = [("frequent", self.lowest.itemsets.select("length", F.col("support").alias("reached")))]
        for level in self.lowest.levels:
            if level.candidates is not None:
                rows = level.candidates.df.select(F.lit(level.length).alias("length"), F.col("min_support").alias("reached"))
                kinds.append(("candidates", rows))
        rows = stack([rows.withColumn("kind", F.lit(kind)) for kind, rows in kinds])
        counts = self._at_each(rows, "reached").groupBy("kind", "threshold", "length").count()
        return {(r["kind"], r["threshold"], r["length"]): r["count"] for r in counts.collect()}

    def _frequent(self, support: float, length: int) -> int:
        return self._counts.get(("frequent", float(support), length), 0)

    def _candidates(self, support: float, length: int) -> int:
        if length == 1:
            return self.lowest.levels[0].candidate_count
        if length == 2:
            singles = self._frequent(support, 1)
            return singles * (singles - 1) // 2
        return self._counts.get(("candidates", float(support), length), 0)

    @property
    def level_stats(self) -> DataFrame:
        lengths = range(1, len(self.lowest.levels) + 1)
        rows = [
            (float(s), k, self._candidates(s, k), self._frequent(s, k))
            for s in sorted(self.supports, reverse=True)
            for k in lengths
            if k == 1 or self._candidates(s, k)
        ]
        return self.spark.createDataFrame(rows, "min_support double, level int, candidates bigint, frequent bigint")

    @property
    def summary(self) -> DataFrame:
        lengths = range(1, len(self.lowest.levels) + 1)
        rows = [
            (float(s), sum(self._frequent(s, k) for k in lengths)) for s in sorted(self.supports, reverse=True)
        ]
        return self.spark.createDataFrame(rows, "min_support double, total_itemsets bigint")


def support_sweep(
    items: DataFrame, supports=DEFAULT_SUPPORTS, support_mode: str = "floor", measures: bool = False
) -> SupportSweep:
    """Mine once at the lowest threshold and read the others off that run."""
    mined = apriori(items, min(supports), support_mode, measures, keep_candidates=True)
    return SupportSweep(mined, supports, support_mode)


class SonSweep:
    """Itemsets and candidates of SON at every threshold, from one run at the lowest.

    What is frequent in a chunk at a higher threshold is frequent there at the lowest, with
    its local support at hand: it is a candidate of each threshold at which that
    support reaches the chunk's minimum count. ``itemsets`` and ``candidates`` have a
    ``min_support`` column.
    """

    def __init__(self, mined: SonResult, supports, support_mode: str):
        self.lowest, self.supports, self.support_mode = mined, supports, support_mode

    @property
    def itemsets(self) -> DataFrame:
        total = F.lit(self.lowest.run.limits.total)
        found = _at_each(self.lowest.itemsets, total, self.supports, self.support_mode, "support")
        return found.withColumnRenamed("threshold", "min_support")

    @property
    def candidates(self) -> DataFrame:
        baskets = F.get(F.lit(self.lowest.run.limits.baskets), F.col("chunk"))
        local = _at_each(self.lowest.local, baskets, self.supports, self.support_mode, "support")
        return local.select(F.col("threshold").alias("min_support"), "items", "length").distinct()

    @property
    def summary(self) -> DataFrame:
        """``(min_support, global_candidates, total_itemsets)``."""
        counts = [
            df.groupBy("min_support").agg(F.count(F.lit(1)).alias(name))
            for df, name in ((self.candidates, "global_candidates"), (self.itemsets, "total_itemsets"))
        ]
        every = self.lowest.itemsets.sparkSession.createDataFrame([(float(s),) for s in self.supports], "min_support double")
        for found in counts:
            every = every.join(F.broadcast(found), "min_support", "left")
        return every.na.fill(0).orderBy(F.desc("min_support"))


def son_sweep(
    items: DataFrame,
    num_chunks: int,
    supports=DEFAULT_SUPPORTS,
    support_mode: str = "exact",
    measures: bool = False,
) -> SonSweep:
    """Both phases once, at the lowest threshold."""
    return SonSweep(son(items, min(supports), num_chunks, support_mode, measures), supports, support_mode)


def son_runs(
    items: DataFrame,
    num_chunks: int,
    supports=DEFAULT_SUPPORTS,
    support_mode: str = "exact",
    measures: bool = True,
) -> dict[float, SonResult]:
    """One timed SON run per threshold; ``son_sweep`` has the same results from one run."""
    return {float(s): son(items, s, num_chunks, support_mode, measures) for s in supports}


def son_summary(items: DataFrame, runs: dict[float, SonResult]) -> DataFrame:
    rows = [
        (s, r.total_seconds, r.phase1_seconds, r.phase2_seconds, r.candidate_count, r.total_itemsets)
        for s, r in runs.items()
    ]
    schema = (
        "support double, total_time_seconds double, phase1_time_seconds double, "
        "phase2_time_seconds double, global_candidates bigint, total_itemsets bigint"
    )
    return items.sparkSession.createDataFrame(rows, schema).orderBy(F.desc("support"))


def pruning_at_lowest_support(sweep: SupportSweep, lowest_son: SonResult) -> DataFrame:
    """Candidates against frequent itemsets at the lowest threshold: Apriori by level, SON in total."""
    lowest = sweep.level_stats.agg(F.min("min_support").alias("min_support"))
    levels = sweep.level_stats.join(F.broadcast(lowest), "min_support").select(
        F.concat(F.lit("Level "), F.col("level").cast("string")).alias("stage"), "candidates", "frequent"
    )
    chunks = lowest_son.stats.select(
        F.lit("SON").alias("stage"),
        F.col("candidates_generated").alias("candidates"),
        F.col("final_frequent_itemsets").alias("frequent"),
    )
    return levels.unionByName(chunks).withColumn(
        "kept_ratio", F.try_divide(F.col("frequent"), F.col("candidates"))
    )
