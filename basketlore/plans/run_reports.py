"""Tables over run-metrics documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlore.functions.labels import algorithm_name

ALGORITHMS = ("apriori", "fpgrowth", "son")
CORE_ORDER = ("20 Cores", "10 Cores", "4 Cores")


def _runs(metrics: DataFrame, algorithm: str, *keep: str) -> DataFrame:
    """One row per document and threshold of one algorithm."""
    return metrics.select(*keep, F.explode(algorithm).alias("Support", "run"))


def _long_times(metrics: DataFrame, *keep: str) -> DataFrame:
    parts = [
        _runs(metrics, key, *keep).select(
            *keep, "Support", F.lit(key).alias("key"), F.col("run.total_time").alias("total_time")
        )
        for key in ALGORITHMS
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("Algorithm", algorithm_name(F.col("key")))


def total_times(metrics: DataFrame) -> DataFrame:
    return (
        _long_times(metrics)
        .orderBy("key", F.col("Support").cast("double").desc())
        .select("Support", "Algorithm", F.col("total_time").alias("Time (s)"))
    )


def apriori_breakdown(metrics: DataFrame) -> DataFrame:
    """Seconds of levels 1 to 3 per threshold; a level that was not run took 0."""
    seconds = [
        F.coalesce(F.try_element_at("run.levels", F.lit(str(k)))["execution_time"], F.lit(0.0)).alias(
            f"Level {k} (s)"
        )
        for k in (1, 2, 3)
    ]
    return (
        _runs(metrics, "apriori")
        .select("Support", *seconds)
        .orderBy(F.col("Support").cast("double").desc())
    )


def _breakdown(metrics: DataFrame, algorithm: str, columns: dict[str, str]) -> DataFrame:
    return (
        _runs(metrics, algorithm)
        .select("Support", *(F.col(f"run.{field}").alias(name) for field, name in columns.items()))
        .orderBy(F.col("Support").cast("double").desc())
    )


def fpgrowth_breakdown(metrics: DataFrame) -> DataFrame:
    return _breakdown(
        metrics, "fpgrowth", {"build_time": "Build Time (s)", "mine_time": "Mine Time (s)"}
    )


def son_breakdown(metrics: DataFrame) -> DataFrame:
    return _breakdown(metrics, "son", {"phase1_time": "Phase 1 (s)", "phase2_time": "Phase 2 (s)"})


def scalability_summary(labeled: DataFrame, core_order: tuple[str, ...] = CORE_ORDER) -> DataFrame:
    """Total time per configuration, algorithm and threshold; a missing time counts as 0."""
    rank = F.array_position(F.array(*(F.lit(c) for c in core_order)), F.col("Cores"))
    return (
        _long_times(labeled, "Cores")
        .select(
            "Cores",
            "Algorithm",
            F.col("Support").cast("double").alias("Support"),
            F.coalesce("total_time", F.lit(0.0)).alias("Total Time (s)"),
        )
        .orderBy(rank, "Algorithm", F.desc("Support"))
    )


def scalability_by_support(
    summary: DataFrame, core_order: tuple[str, ...] = CORE_ORDER
) -> DataFrame:
    """The summary with one column per configuration."""
    return (
        summary.groupBy("Support", "Algorithm")
        .pivot("Cores", list(core_order))
        .agg(F.first("Total Time (s)"))
        .orderBy(F.desc("Support"), "Algorithm")
    )
