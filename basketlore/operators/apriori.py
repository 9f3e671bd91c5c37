"""Level-wise Apriori over long-form baskets."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from basketlore.operators.levels import (
    Level,
    Mining,
    measure_columns,
    mining,
    with_chunk,
)
from basketlore.operators.prep import unique_lines
from basketlore.workspace import Workspace

LEVEL_STATS_SCHEMA = "level int, candidates bigint, frequent bigint, time_seconds double"


@contextmanager
def held(df: DataFrame):
    """Persist ``df`` for the block unless the caller already did."""
    ours = df.storageLevel == StorageLevel.NONE
    if ours:
        df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        if ours:
            df.unpersist()


def stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@dataclass
class AprioriResult:
    """``itemsets(items, length, support[, total_log_qty, max_qty])`` and level statistics.

    The frames read tables of the run's folder; ``close`` deletes them.
    """

    itemsets: DataFrame
    level_stats: DataFrame
    total_seconds: float
    total_itemsets: int
    levels: list[Level]
    run: Mining

    def __iter__(self):
        return iter((self.itemsets, self.level_stats))

    def close(self) -> None:
        self.run.work.clear()


def apriori(
    items: DataFrame,
    min_support: float,
    support_mode: str = "floor",
    measures: bool = False,
    max_length: int | None = None,
    keep_candidates: bool = False,
) -> AprioriResult:
    """Itemsets found in at least ``min_support`` of the baskets.

    ``items`` is long form, ``(basket_id, item, qty)``; rows that repeat basket and
    item are summed, and lines without a basket are one basket. With ``measures``
    every itemset also gets the sum of ``log1p`` of its joint quantity, the smallest
    quantity of its items in a basket, and the largest such quantity. Frequency never
    depends on quantities. With ``max_length`` no deeper level is mined. Tables that no
    result reads are deleted, all of them if the run fails; ``keep_candidates`` leaves
    those of the candidates, in ``levels``.
    """
    started = time.monotonic()
    work = Workspace(items.sparkSession, "apriori")
    with held(unique_lines(items)) as source:
        chunked = with_chunk(source, F.lit(0))
        with mining(work, chunked, min_support, support_mode, measures, keep_candidates=keep_candidates) as run:
            for level in run:
                if level.length == max_length:
                    break
    columns = ["support", *measure_columns(measures)]
    itemsets = stack(
        [level.frequent.df.select("items", F.lit(level.length).alias("length"), *columns) for level in run.levels]
    )
    stats = items.sparkSession.createDataFrame(
        [(v.length, v.candidate_count, v.frequent.rows, v.seconds) for v in run.levels],
        LEVEL_STATS_SCHEMA,
    )
    total = sum(level.frequent.rows for level in run.levels)
    return AprioriResult(itemsets, stats, time.monotonic() - started, total, run.levels, run)
