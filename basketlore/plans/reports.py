"""Tables over mining results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlore.functions.labels import (
    NAME_SEPARATOR,
    UNKNOWN_ITEM,
    itemset_key,
    short_label,
)

DEFAULT_TOP = 10
TOP_VOLUME = 3
HISTOGRAM_BINS = 30
DENSITY_POINTS = 200
# Grid nodes for binning between two points of the density.
DENSITY_CELLS = 16


def itemset_names(itemsets: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add ``name``: the descriptions of the items, in item order, joined with " + ".

    Each different itemset is named once, however often it occurs; only the items
    in it are looked up. Codes without a description read UNKNOWN.
    """
    others = [c for c in itemsets.columns if c != "items"]
    lines = itemsets.select("items").distinct().select("items", F.posexplode("items").alias("pos", "item"))
    text = F.coalesce("description", F.lit(UNKNOWN_ITEM))
    named = (
        lines.join(dictionary.select("item", "description"), "item", "left")
        .groupBy("items")
        .agg(F.sort_array(F.collect_list(F.struct("pos", text.alias("text")))).alias("parts"))
        .select("items", F.array_join("parts.text", NAME_SEPARATOR).alias("name"))
    )
    return itemsets.join(named, "items").select("items", "name", *others)


def pattern_table(itemsets: DataFrame, dictionary: DataFrame, *keep: str) -> DataFrame:
    """Itemsets of two and more items with their average log and largest joint quantity.

    Columns named in ``keep``, such as the threshold of a sweep, stay.
    """
    return itemset_names(itemsets.where("length >= 2"), dictionary).select(
        *keep,
        F.col("name").alias("Itemset"),
        F.col("support").alias("Support"),
        (F.col("total_log_qty") / F.col("support")).alias("Avg_Log_Qty"),
        F.col("max_qty").alias("Max_Qty"),
        F.col("length").alias("Length"),
        itemset_key(F.col("items")).alias("key"),
    )


def top_itemsets(patterns: DataFrame, n: int = DEFAULT_TOP) -> DataFrame:
    """The ``n`` most frequent patterns; equal supports in item order."""
    return patterns.orderBy(F.desc("Support"), "key").limit(n)


def top_named_itemsets(itemsets: DataFrame, dictionary: DataFrame, n: int = DEFAULT_TOP) -> DataFrame:
    """``top_itemsets`` of the pattern table, picked before anything is named."""
    key = itemset_key(F.col("items"))
    top = itemsets.where("length >= 2").orderBy(F.desc("support"), key).limit(n)
    return top_itemsets(pattern_table(top, dictionary), n)


def top_volume_labels(patterns: DataFrame, n: int = TOP_VOLUME) -> DataFrame:
    """The ``n`` patterns of the largest average log quantity, with a short label."""
    return (
        patterns.orderBy(F.desc("Avg_Log_Qty"), "key")
        .limit(n)
        .select("key", short_label(F.col("Itemset")).alias("label"), "Support", "Avg_Log_Qty")
    )


def top_per_threshold(itemsets: DataFrame, n: int = TOP_VOLUME) -> DataFrame:
    """The ``n`` largest average log quantities of every threshold of a quantity-aware sweep.

    ``(min_support, place, key, Support, Avg_Log_Qty)``; equal averages in item order.
    The window keeps ``n`` rows of a threshold in every task before they are moved.
    """
    measured = itemsets.where("length >= 2").select(
        "min_support",
        itemset_key(F.col("items")).alias("key"),
        F.col("support").alias("Support"),
        (F.col("total_log_qty") / F.col("support")).alias("Avg_Log_Qty"),
    )
    largest = Window.partitionBy("min_support").orderBy(F.desc("Avg_Log_Qty"), "key")
    placed = measured.withColumn("place", F.row_number().over(largest)).where(F.col("place") <= n)
    return placed.select("min_support", "place", "key", "Support", "Avg_Log_Qty")


def max_qty_histogram(patterns: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Patterns per bin of ``Max_Qty``: equal bins from the smallest to the largest value.

    A bin holds its left edge but not its right one, except the last, which
    holds both. All bins are listed. If all values are equal, the range is
    widened by one half on either side.
    """
    ends = patterns.agg(F.min("Max_Qty").alias("low"), F.max("Max_Qty").alias("high")).first()
    low, high = ends["low"], ends["high"]
    if low is None:
        return patterns.sparkSession.createDataFrame(
            [], "bin int, bin_start double, bin_end double, patterns bigint"
        )
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    edge = F.lit(low) + F.col("bin") * F.lit(width)
    next_edge = F.lit(low) + (F.col("bin") + 1) * F.lit(width)
    place = F.floor((F.col("Max_Qty") - F.lit(low)) / F.lit(width)).cast("int")
    # The division may land one bin off a value that lies on an edge.
    step = F.when(F.col("Max_Qty") < edge, -1).when(F.col("Max_Qty") >= next_edge, 1).otherwise(0)
    counts = (
        patterns.withColumn("bin", place)
        .withColumn("bin", F.least(F.col("bin") + step, F.lit(bins - 1)))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("found"))
    )
    every = patterns.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin",
        edge.alias("bin_start"),
        next_edge.alias("bin_end"),
        F.coalesce("found", F.lit(0)).alias("patterns"),
    )


EMPTY_DENSITY = "point int, max_qty double, density double"


def _density_figures(patterns: DataFrame, points: int) -> tuple[float, float, float, float] | None:
    """Smallest value, distance of grid points, bandwidth by Scott's rule, and what the kernel sums are divided by."""
    stats = patterns.agg(
        F.count("Max_Qty").alias("n"),
        F.min("Max_Qty").alias("low"),
        F.max("Max_Qty").alias("high"),
        F.stddev_samp("Max_Qty").alias("spread"),
    ).first()
    if not stats["n"] or not stats["spread"]:
        return None
    bandwidth = stats["spread"] * stats["n"] ** (-1 / 5)
    scale = stats["n"] * bandwidth * (2 * math.pi) ** 0.5
    return stats["low"], (stats["high"] - stats["low"]) / (points - 1), bandwidth, scale


def max_qty_density(patterns: DataFrame, points: int = DENSITY_POINTS) -> DataFrame:
    """Gaussian density of ``Max_Qty`` on a grid over its range, bandwidth by Scott's rule.

    Equal values are merged first, so the grid is laid over the distinct
    values, not over the patterns. No rows if the values do not vary. For very many
    distinct values see ``max_qty_density_binned``.
    """
    figures = _density_figures(patterns, points)
    if figures is None:
        return patterns.sparkSession.createDataFrame([], EMPTY_DENSITY)
    low, step, bandwidth, scale = figures
    at = F.lit(low) + F.col("point") * F.lit(step)
    values = patterns.groupBy("Max_Qty").agg(F.count(F.lit(1)).alias("weight"))
    spread = (at - F.col("Max_Qty")) / F.lit(bandwidth)
    return (
        values.select("Max_Qty", "weight", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        .groupBy("point")
        .agg((F.sum(F.col("weight") * F.exp(-spread * spread / 2)) / F.lit(scale)).alias("density"))
        .select("point", at.alias("max_qty"), "density")
    )


def max_qty_density_binned(
    patterns: DataFrame, points: int = DENSITY_POINTS, cells: int = DENSITY_CELLS
) -> DataFrame:
    """The density from values binned onto a fine grid, ``(point, max_qty, density, error_bound)``.

    A value gives its weight to the two grid nodes beside it, in proportion to how near
    they are; ``cells`` nodes lie between two points. Tasks send a weight per
    node, never a row per value, so what is shuffled is bounded by the grid. Replacing
    a value by its nodes interpolates the kernel linearly, which is off by at most
    (node distance / bandwidth)^2 / 8 of the kernel's height: ``error_bound``. No rows
    if the values do not vary.
    """
    figures = _density_figures(patterns, points)
    if figures is None:
        return patterns.sparkSession.createDataFrame([], EMPTY_DENSITY + ", error_bound double")
    low, step, bandwidth, scale = figures
    width, last = step / cells, (points - 1) * cells
    place = (F.col("Max_Qty") - F.lit(low)) / F.lit(width)
    left = F.least(F.floor(place), F.lit(last - 1)).cast("int")
    share = place - left
    both = F.array(
        F.struct(left.alias("node"), (1 - share).alias("weight")), F.struct((left + 1).alias("node"), share.alias("weight"))
    )
    nodes = patterns.where("Max_Qty IS NOT NULL").select(F.inline(both)).groupBy("node").agg(F.sum("weight").alias("weight"))
    far = (F.col("point") * cells - F.col("node")) * F.lit(width / bandwidth)
    at = F.lit(low) + F.col("point") * F.lit(step)
    height = 1 / (bandwidth * (2 * math.pi) ** 0.5)
    return (
        nodes.select("node", "weight", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        .groupBy("point")
        .agg((F.sum(F.col("weight") * F.exp(-far * far / 2)) / F.lit(scale)).alias("density"))
        .select("point", at.alias("max_qty"), "density", F.lit((width / bandwidth) ** 2 / 8 * height).alias("error_bound"))
    )
