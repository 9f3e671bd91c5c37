"""Whole experiments: every miner at every threshold, with timings."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlore.operators.apriori import apriori, held, stack
from basketlore.operators.fpgrowth import fit_fpgrowth, itemset_summary, mine_model
from basketlore.operators.prep import basket_count
from basketlore.operators.son import son
from basketlore.plans.reports import DEFAULT_TOP, pattern_table, top_itemsets
from basketlore.plans.sweep import DEFAULT_SUPPORTS, son_summary
from basketlore.sources.metrics import METRICS_SCHEMA
from basketlore.sources.sinks import run_config, write_csv, write_document


def _apriori_run(items: DataFrame, support: float) -> dict:
    found = apriori(items, support)
    return {
        "total_time": found.total_seconds,
        "total_itemsets": found.total_itemsets,
        "levels": {
            str(v.length): {
                "candidates_count": v.candidate_count,
                "frequent_count": v.frequent.rows,
                "execution_time": v.seconds,
            }
            for v in found.levels
        },
    }


def _fpgrowth_run(items: DataFrame, support: float) -> dict:
    started = time.monotonic()
    model = fit_fpgrowth(items, support)
    built = time.monotonic()
    summary = itemset_summary(mine_model(model)).first()
    ended = time.monotonic()
    return {
        "build_time": built - started,
        "mine_time": ended - built,
        "total_time": ended - started,
        "count": summary["count"],
        "max_length": summary["max_length"],
    }


def _son_run(items: DataFrame, support: float, num_chunks: int) -> dict:
    found = son(items, support, num_chunks)
    return {
        "num_partitions": num_chunks,
        "phase1_time": found.phase1_seconds,
        "candidates_generated": found.candidate_count,
        "phase2_time": found.phase2_seconds,
        "final_frequent_itemsets": found.total_itemsets,
        "total_time": found.total_seconds,
    }


def plain_experiment(
    items: DataFrame, supports=DEFAULT_SUPPORTS, num_chunks: int = 40
) -> DataFrame:
    """The run-metrics document, one row, of the three miners at every threshold."""
    spark = items.sparkSession
    with held(items):
        total = items.agg(basket_count()).first()[0]
        document = {
            "apriori": {str(s): _apriori_run(items, s) for s in supports},
            "fpgrowth": {str(s): _fpgrowth_run(items, s) for s in supports},
            "son": {str(s): _son_run(items, s, num_chunks) for s in supports},
            "metadata": {
                "total_baskets": total,
                "thresholds": [float(s) for s in supports],
                "spark_master": spark.sparkContext.master,
                "spark_application_id": spark.sparkContext.applicationId,
                "num_partitions": num_chunks,
            },
        }
    return spark.createDataFrame([document], METRICS_SCHEMA)


def quantity_experiment(
    items: DataFrame,
    dictionary: DataFrame,
    folder: str,
    supports=DEFAULT_SUPPORTS,
    num_chunks: int = 40,
    top_n: int = DEFAULT_TOP,
    input_dataset: str | None = None,
) -> None:
    """Quantity-aware Apriori and SON at every threshold, written as tables to ``folder``.

    ``apriori_summary``, ``apriori_levels``, ``son_summary``, the top itemsets of
    both at the lowest threshold, and ``experiment_config``.
    """
    cores = items.sparkSession.sparkContext.defaultParallelism
    with held(items):
        levelwise = {float(s): apriori(items, s, "floor", measures=True) for s in supports}
        chunked = {float(s): son(items, s, num_chunks, "exact", measures=True) for s in supports}
        config = run_config(items, cores, num_chunks, list(supports), input_dataset)
        write_document(config, f"{folder}/experiment_config")
    summary = items.sparkSession.createDataFrame(
        [(s, r.total_seconds, r.total_itemsets) for s, r in levelwise.items()],
        "support double, total_time_seconds double, total_itemsets bigint",
    )
    write_csv(summary.orderBy(F.desc("support")), f"{folder}/apriori_summary")
    levels = stack([r.level_stats.select(F.lit(s).alias("support"), "*") for s, r in levelwise.items()])
    write_csv(levels.orderBy(F.desc("support"), "level"), f"{folder}/apriori_levels")
    write_csv(son_summary(items, chunked), f"{folder}/son_summary")
    lowest = min(levelwise)
    for name, result in (("apriori", levelwise[lowest]), ("son", chunked[lowest])):
        top = top_itemsets(pattern_table(result.itemsets, dictionary), top_n)
        write_csv(top.drop("key"), f"{folder}/{name}_top_itemsets")
