"""FP-Growth through Spark ML."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlore.functions.support import min_count
from basketlore.operators.apriori import held
from basketlore.operators.prep import basket_count, unique_lines
from basketlore.workspace import Workspace, broadcast_within


def frequent_baskets(items: DataFrame, min_support: float) -> DataFrame:
    """One array per basket with its frequent items only, empty ones included.

    The estimator takes the number of rows as the number of baskets, so baskets
    without a frequent item must stay. What it never counts is left out here,
    which bounds the array of even the widest basket.
    """
    work = Workspace(items.sparkSession, "fpgrowth")
    total = items.agg(basket_count().alias("baskets"))
    least = total.select(min_count(F.col("baskets"), min_support, "ceil")).first()[0]
    counts = items.where("item IS NOT NULL").groupBy("item").agg(F.count(F.lit(1)).alias("support"))
    frequent = work.write(counts.where(F.col("support") >= F.lit(least)), "frequent")
    known = frequent.view(frequent.df.select("item", F.col("item").alias("kept")))
    # A text is there twice.
    known = broadcast_within(replace(known, bytes=2 * known.bytes))
    return (
        items.join(known, "item", "left")
        .groupBy("basket_id")
        .agg(F.collect_list("kept").alias("items"))
        .select("items")
    )


def fit_fpgrowth(
    items: DataFrame, min_support: float, num_partitions: int | None = None
) -> FPGrowthModel:
    """The fitted estimator; its itemsets are mined when they are read."""
    estimator = FPGrowth(itemsCol="items", minSupport=min_support)
    if num_partitions is not None:
        estimator = estimator.setNumPartitions(num_partitions)
    return estimator.fit(frequent_baskets(items, min_support))


def mine_model(model: FPGrowthModel) -> DataFrame:
    """The model's itemsets, mined once and written."""
    found = model.freqItemsets.select(
        F.array_sort("items").alias("items"),
        F.size("items").alias("length"),
        F.col("freq").alias("support"),
    )
    return Workspace(found.sparkSession, "fpgrowth").write(found, "itemsets").df


def fpgrowth(items: DataFrame, min_support: float, num_partitions: int | None = None) -> DataFrame:
    """``(items, length, support)`` of every itemset with count >= ceil(baskets * min_support)."""
    with held(unique_lines(items)) as source:
        return mine_model(fit_fpgrowth(source, min_support, num_partitions))


def itemset_summary(itemsets: DataFrame) -> DataFrame:
    """Number of itemsets and the longest length, 0 if there are none."""
    return itemsets.agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.max("length"), F.lit(0)).alias("max_length"),
    )


def fpgrowth_summary(items: DataFrame, min_support: float) -> DataFrame:
    return itemset_summary(fpgrowth(items, min_support))
