"""Two-phase SON: mine basket chunks, then count the union of their itemsets."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlore.functions.support import min_count
from basketlore.operators.apriori import held, stack
from basketlore.operators.levels import (
    ROOT_ID,
    Mining,
    Projections,
    count_extensions,
    measure_columns,
    mining,
    named_counts,
    split_wide,
    with_chunk,
)
from basketlore.operators.prep import basket_chunk, unique_lines
from basketlore.workspace import Table, Workspace, for_join

STATS_SCHEMA = (
    "num_partitions int, phase1_time double, candidates_generated bigint, "
    "phase2_time double, final_frequent_itemsets bigint, total_time double"
)


@dataclass
class SonResult:
    """Final itemsets, phase-1 candidates, statistics, and the per-chunk itemsets.

    The frames read tables of the run's folder; ``close`` deletes them.
    """

    itemsets: DataFrame
    candidates: DataFrame
    stats: DataFrame
    local: DataFrame
    candidate_count: int
    total_itemsets: int
    phase1_seconds: float
    phase2_seconds: float
    total_seconds: float
    run: Mining

    def __iter__(self):
        return iter((self.itemsets, self.candidates, self.stats))

    def close(self) -> None:
        self.run.work.clear()


def _totals(measures: bool) -> list:
    """Counts of an itemset in several chunks, added up."""
    found = [F.sum("support").alias("support")]
    if measures:
        found += [F.sum("total_log_qty").alias("total_log_qty"), F.max("max_qty").alias("max_qty")]
    return found


def distinct_candidates(work: Workspace, run: Mining) -> list[Table]:
    """Level tables of the itemsets that are frequent in some chunk.

    They are closed under subsets, so every candidate finds its prefix one
    table earlier. The single items are those of the dictionary, numbered by code.
    Longer ones carry what was counted in the ``chunks`` where they are frequent.
    """
    if run.dictionary.rows == 0:
        return []
    singles = run.dictionary.df.select(
        F.col("code").alias("id"),
        F.lit(ROOT_ID).cast("bigint").alias("pid"),
        "code",
        F.array("code").alias("codes"),
        F.array("item").alias("items"),
    )
    tables = [Table(singles, run.dictionary.rows, 2 * run.dictionary.bytes)]
    for level in run.levels[1:]:
        found = level.frequent.df.groupBy("codes").agg(
            F.first("items").alias("items"),
            F.first("code").alias("code"),
            F.collect_set("chunk").alias("chunks"),
            *_totals(run.measures),
        )
        if level.length == 2:
            found = found.withColumn("pid", F.get("codes", F.lit(0)))
        else:
            parents = tables[-1].df.select(F.col("codes").alias("prefix"), F.col("id").alias("pid"))
            parents = for_join(tables[-1].view(parents))
            found = found.withColumn("prefix", F.slice("codes", 1, level.length - 1)).join(parents, "prefix")
        found = found.select(
            F.monotonically_increasing_id().alias("id"),
            "pid",
            "code",
            "codes",
            "items",
            "chunks",
            "support",
            *measure_columns(run.measures),
        )
        if level.frequent.rows == 0:
            break
        tables.append(work.write(found, f"union{level.length}"))
    return tables


def _uncounted(work: Workspace, run: Mining, tables: list[Table]) -> list[Table]:
    """What phase 2 has to count, by length from 2: candidates in the chunks where they are not frequent.

    ``(chunk, id, pid, code, codes, counted)``; rows that are not ``counted`` are
    prefixes of longer ones that are.
    """
    every = F.array(*(F.lit(chunk) for chunk, baskets in enumerate(run.limits.baskets) if baskets))
    found, prefixes = [], None
    for length, table in reversed(list(enumerate(tables[1:], start=2))):
        missing = table.df.select(F.explode(F.array_except(every, F.col("chunks"))).alias("chunk"), "id", F.lit(True).alias("counted"))
        if prefixes is not None:
            missing = missing.unionByName(prefixes.withColumn("counted", F.lit(False)))
        marked = missing.groupBy("chunk", "id").agg(F.max("counted").alias("counted"))
        named = marked.join(for_join(table.view(table.df.select("id", "pid", "code", "codes"))), "id")
        found.insert(0, work.write(named.select("chunk", "id", "pid", "code", "codes", "counted"), f"uncounted{length}"))
        prefixes = found[0].df.select("chunk", F.col("pid").alias("id")).distinct()
    return found


def _count_candidates(work: Workspace, run: Mining, tables: list[Table], measures: bool) -> list[DataFrame]:
    """Support of every candidate over all baskets, one frame per length.

    Phase 1 has counted a candidate in the chunks where it is frequent; in the others
    it is counted now.
    """
    columns = measure_columns(measures)
    singles = run.item_counts.df.groupBy("item").agg(*_totals(measures))
    found = [
        run.dictionary.df.select("item").join(singles, "item").select(
            F.array("item").alias("items"), F.lit(1).alias("length"), "support", *columns
        )
    ]
    left = _uncounted(work, run, tables)
    projections = None
    for length, (table, rest) in enumerate(zip(tables[1:], left, strict=True), start=2):
        counts = table.df.select("id", "items", "support", *columns)
        wanted = rest.view(rest.df.where("counted").select("chunk", F.col("id").alias("own"), F.col("pid").alias("id"), "code"))
        if rest.rows and not wanted.df.isEmpty():
            if projections is None:
                baskets = split_wide(run.baskets, run.dictionary.rows)
                projections = Projections(work, baskets, "projection-all", measures)
            # Prefixes of longer ones start here too: the projection may be written for these.
            projection = projections.counting(length, [tables[0], *left], rest)
            more = named_counts(count_extensions(projection, wanted, measures), wanted, "own")
            more = more.select(F.col("own").alias("id"), F.lit(None).cast("array<string>").alias("items"), "support", *columns)
            items = F.first("items", ignorenulls=True).alias("items")
            counts = counts.unionByName(more).groupBy("id").agg(items, *_totals(measures))
        found.append(counts.select("items", F.lit(length).alias("length"), "support", *columns))
    return found


def son(
    items: DataFrame,
    min_support: float,
    num_chunks: int,
    support_mode: str = "floor",
    measures: bool = False,
) -> SonResult:
    """Frequent itemsets by partition mining.

    A basket's chunk is a fixed function of its key. An itemset frequent over
    all baskets is frequent in at least one chunk under the same rounding, so
    the result equals Apriori's whatever the number of chunks. Tables that no result
    reads are deleted, all of them if the run fails.
    """
    spark = items.sparkSession
    started = time.monotonic()
    work = Workspace(spark, "son")
    chunk = basket_chunk(num_chunks, "basket_id", dict(items.dtypes)["basket_id"])
    with held(unique_lines(items)) as source:
        chunked = with_chunk(source, chunk)
        with mining(work, chunked, min_support, support_mode, measures, num_chunks) as run:
            levels = list(run)
            tables = distinct_candidates(work, run)
            phase1 = time.monotonic() - started

            phase2_started = time.monotonic()
            least = min_count(F.lit(run.limits.total), min_support, support_mode)
            counted = stack(_count_candidates(work, run, tables, measures))
            final = work.write(counted.where(F.col("support") >= least), "itemsets")
            work.remove("uncounted")
            phase2 = time.monotonic() - phase2_started

    local = stack(
        [
            level.frequent.df.select("chunk", "items", F.lit(level.length).alias("length"), "support")
            for level in levels
        ]
    )
    found = stack(
        [t.df.select("items", F.lit(k).alias("length")) for k, t in enumerate(tables, start=1)]
    ) if tables else local.select("items", "length").limit(0)
    candidate_count = sum(t.rows for t in tables)
    elapsed = time.monotonic() - started
    stats = spark.createDataFrame(
        [(num_chunks, phase1, candidate_count, phase2, final.rows, elapsed)], STATS_SCHEMA
    )
    return SonResult(
        final.df, found, stats, local, candidate_count, final.rows, phase1, phase2, elapsed, run
    )
