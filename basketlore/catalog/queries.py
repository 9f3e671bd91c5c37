"""Named queries. Each takes a session and the folder of the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlore.catalog.fixtures import (
    BRAND,
    TYPE,
    attribute_baskets,
    baskets,
    labeled_run_metrics,
    messy_items,
    order_parts,
    retail_lines,
    run_metrics,
    sales_partitions,
    sized_lines,
)
from basketlore.functions.labels import itemset_key, percent_label
from basketlore.operators import prep
from basketlore.operators.apriori import apriori, stack
from basketlore.operators.candidates import candidates
from basketlore.operators.fpgrowth import fpgrowth, fpgrowth_summary, itemset_summary
from basketlore.operators.son import son
from basketlore.plans import reports, run_reports, sweep
from basketlore.sources.retail import read_baskets, read_lines
from basketlore.sources.sinks import run_config, write_csv
from basketlore.workspace import Workspace

LOW = 0.02
CHUNKS = 4
# Dense baskets have six levels at this threshold, sparse ones few pairs at theirs; part sizes have pairs.
DENSE, SPARSE, SIZED = 0.25, 0.0002, 0.002
SUPPORTS = sweep.DEFAULT_SUPPORTS
LINE_COLUMNS = ("InvoiceNo", "basket_id", "StockCode", "Description", "Quantity", "CustomerID")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    """Register under the function's name, less the underscore that keeps it off an import."""
    QUERIES[run.__name__.rstrip("_")] = run
    return run


def _plain(itemsets: DataFrame, *more: str) -> DataFrame:
    return itemsets.select(*more, itemset_key(F.col("items")).alias("itemset"), "length", "support")


def _measured(itemsets: DataFrame, *more: str) -> DataFrame:
    return itemsets.select(
        *more,
        itemset_key(F.col("items")).alias("itemset"),
        "length",
        "support",
        F.round("total_log_qty", 6).alias("total_log_qty"),
        "max_qty",
    )


def _whole(qty: str):
    return F.col(qty).cast("bigint").cast("string")


# Sources and sinks


@query
def scan_baskets(spark, folder):
    path = Workspace(spark, "scan").path("baskets.parquet")
    prep.basket_sets(baskets(spark, folder, BRAND)).write.parquet(path)
    found = read_baskets(spark, path)
    return found.select("basket_id", itemset_key(F.col("items")).alias("itemset"), F.size("items").alias("length"))


@query
def scan_lines(spark, folder):
    path = Workspace(spark, "scan").path("lines.csv")
    write_csv(retail_lines(spark, folder, BRAND).drop("basket_id"), path)
    return read_lines(spark, path)


@query
def scan_lines_quoted(spark, folder):
    """Descriptions with quotes, commas and line breaks, written and read back."""
    path = Workspace(spark, "scan").path("lines.csv")
    text = F.concat(F.lit('"'), "Description", F.lit('", or\n'), "StockCode", F.lit(',"'))
    write_csv(retail_lines(spark, folder, BRAND).withColumn("Description", text).drop("basket_id"), path)
    return read_lines(spark, path, multi_line=True)


@query
def scan_run_metrics(spark, folder):
    runs = run_metrics(spark, folder).select(F.explode("apriori").alias("Support", "run"))
    levels = runs.select("Support", "run.total_itemsets", F.explode("run.levels").alias("level", "stats"))
    return levels.select(
        "Support",
        "total_itemsets",
        "level",
        F.col("stats.candidates_count").alias("candidates"),
        F.col("stats.frequent_count").alias("frequent"),
        F.round("stats.execution_time", 4).alias("seconds"),
    )


@query
def scan_run_metrics_labeled(spark, folder):
    runs = labeled_run_metrics(spark, folder).select(
        "Cores", "metadata.total_baskets", F.explode("son").alias("Support", "run")
    )
    return runs.select(
        "Cores",
        "Support",
        "total_baskets",
        F.col("run.candidates_generated").alias("candidates"),
        F.col("run.final_frequent_itemsets").alias("itemsets"),
        F.round("run.phase1_time", 4).alias("phase1"),
    )


def _all_maps(metrics: DataFrame, *keep: str) -> DataFrame:
    """Every run of every algorithm's map: time, itemsets, and the two parts a run has."""
    fields = {
        "apriori": ("total_itemsets", "levels['1'].execution_time", "levels['2'].execution_time"),
        "fpgrowth": ("count", "build_time", "mine_time"),
        "son": ("final_frequent_itemsets", "phase1_time", "phase2_time"),
    }
    parts = []
    for key, (itemsets, first, second) in fields.items():
        runs = metrics.select(*keep, "metadata.total_baskets", F.explode(key).alias("Support", "run"))
        parts.append(
            runs.selectExpr(
                *keep, "total_baskets", f"'{key}' AS algorithm", "Support", f"run.{itemsets} AS itemsets",
                "round(run.total_time, 4) AS seconds", f"round(run.{first}, 4) AS part1", f"round(run.{second}, 4) AS part2",
            )
        )
    return stack(parts)


@query
def scan_run_metrics_maps(spark, folder):
    return _all_maps(run_metrics(spark, folder))


@query
def scan_run_metrics_labeled_maps(spark, folder):
    return _all_maps(labeled_run_metrics(spark, folder), "Cores")


@query
def run_config_(spark, folder):
    config = run_config(baskets(spark, folder, BRAND), 8, CHUNKS, list(SUPPORTS), "lineitem")
    return config.withColumn("supports", F.array_join(F.col("supports").cast("array<string>"), ","))


# Cleaning and baskets


@query
def filter_cancelled(spark, folder):
    return prep.drop_cancelled(retail_lines(spark, folder, BRAND)).select(*LINE_COLUMNS)


@query
def filter_positive_qty(spark, folder):
    return prep.keep_positive_quantity(retail_lines(spark, folder, BRAND)).select(*LINE_COLUMNS)


@query
def clean_lines(spark, folder):
    return prep.clean_lines(retail_lines(spark, folder, BRAND)).select(*LINE_COLUMNS)


@query
def basket_sets(spark, folder):
    sets = prep.basket_sets(baskets(spark, folder, BRAND))
    return sets.select("basket_id", itemset_key(F.col("items")).alias("itemset"))


@query
def basket_quantity_map(spark, folder):
    entries = F.map_entries("quantities")
    text = F.transform(
        entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("bigint").cast("string"))
    )
    maps = prep.basket_quantity_map(baskets(spark, folder, BRAND))
    return maps.select("basket_id", F.array_join(text, ",").alias("quantities"))


@query
def qa_baskets(spark, folder):
    found = prep.basket_quantities(baskets(spark, folder, BRAND))
    return found.select(
        "basket_id",
        F.array_join("items", "|").alias("items"),
        F.array_join(F.transform("quantities", lambda q: q.cast("bigint").cast("string")), "|").alias("quantities"),
    )


@query
def invoice_item_qty(spark, folder):
    lines = prep.clean_lines(retail_lines(spark, folder, BRAND))
    return prep.invoice_item_qty(lines, "basket_id")


@query
def basket_counts(spark, folder):
    every = baskets(spark, folder, BRAND, min_items=1)
    sizes = every.groupBy("basket_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(
        F.count(F.lit(1)).alias("baskets"), F.count_if(F.col("size") > 1).alias("multi_item_baskets")
    )


@query
def prep_counts(spark, folder):
    return prep.prep_counts(retail_lines(spark, folder, BRAND), baskets(spark, folder, BRAND))


@query
def item_dictionary(spark, folder):
    return prep.item_dictionary(prep.clean_lines(retail_lines(spark, folder, BRAND)))


@query
def basket_chunks(spark, folder):
    chunk = prep.basket_chunk(CHUNKS).alias("chunk")
    found = baskets(spark, folder, BRAND).groupBy(chunk)
    return found.agg(F.count_distinct("basket_id").alias("baskets"), F.count(F.lit(1)).alias("items"))


# Mining


@query
def support_thresholds(spark, folder):
    return sweep.support_thresholds(baskets(spark, folder, BRAND), SUPPORTS)


@query
def support_thresholds_messy(spark, folder):
    return sweep.support_thresholds(messy_items(spark, folder), SUPPORTS)


@query
def run_config_messy(spark, folder):
    config = run_config(messy_items(spark, folder), 8, CHUNKS, list(SUPPORTS), "lineitem")
    return config.select("cores", "partitions", "total_baskets", "input_dataset")


@query
def apriori_level1(spark, folder):
    return _plain(apriori(baskets(spark, folder, BRAND), LOW, max_length=1).itemsets)


@query
def apriori_level2(spark, folder):
    return _plain(apriori(baskets(spark, folder, BRAND), LOW, max_length=2).itemsets.where("length = 2"))


@query
def apriori_level3(spark, folder):
    return _plain(apriori(baskets(spark, folder, TYPE), LOW, max_length=3).itemsets.where("length = 3"))


def _candidates(items, length, support=LOW):
    levels = apriori(items, support, max_length=length - 1).levels
    found = candidates(levels[length - 2].frequent, length)
    return found.select(itemset_key(F.col("items")).alias("itemset"), "min_support")


@query
def candidates_k2(spark, folder):
    return _candidates(baskets(spark, folder, BRAND), 2)


@query
def candidates_k3(spark, folder):
    return _candidates(baskets(spark, folder, BRAND), 3)


@query
def candidates_k4_dense(spark, folder):
    return _candidates(attribute_baskets(spark, folder), 4, DENSE)


@query
def apriori_(spark, folder):
    return _plain(apriori(baskets(spark, folder, BRAND), LOW).itemsets)


@query
def apriori_deep(spark, folder):
    return _plain(apriori(baskets(spark, folder, TYPE), LOW).itemsets)


@query
def fpgrowth_(spark, folder):
    return _plain(fpgrowth(baskets(spark, folder, BRAND), LOW))


@query
def fpgrowth_deep(spark, folder):
    return _plain(fpgrowth(baskets(spark, folder, TYPE), LOW))


@query
def fpgrowth_summary_(spark, folder):
    return fpgrowth_summary(baskets(spark, folder, TYPE), LOW)


@query
def son_local(spark, folder):
    return _plain(son(baskets(spark, folder, BRAND), LOW, CHUNKS, "floor").local, "chunk")


@query
def son_candidates(spark, folder):
    found = son(baskets(spark, folder, BRAND), LOW, CHUNKS, "floor").candidates
    return found.select(itemset_key(F.col("items")).alias("itemset"), "length")


@query
def son_(spark, folder):
    return _plain(son(baskets(spark, folder, BRAND), LOW, CHUNKS, "floor").itemsets)


@query
def son_deep(spark, folder):
    return _plain(son(baskets(spark, folder, TYPE), LOW, CHUNKS, "floor").itemsets)


def _son_stats(found):
    return found.stats.select("num_partitions", "candidates_generated", "final_frequent_itemsets")


@query
def son_stats(spark, folder):
    return _son_stats(son(baskets(spark, folder, BRAND), LOW, CHUNKS, "floor"))


@query
def qa_level1(spark, folder):
    return _measured(apriori(baskets(spark, folder, BRAND), LOW, "floor", measures=True, max_length=1).itemsets)


@query
def qa_apriori(spark, folder):
    return _measured(apriori(baskets(spark, folder, BRAND), LOW, "floor", measures=True).itemsets)


@query
def qa_apriori_deep(spark, folder):
    return _measured(apriori(baskets(spark, folder, TYPE), LOW, "floor", measures=True).itemsets)


@query
def qa_level_stats(spark, folder):
    found = apriori(baskets(spark, folder, BRAND), LOW, "floor", measures=True)
    return found.level_stats.select("level", "candidates", "frequent")


@query
def qa_son(spark, folder):
    found = son(baskets(spark, folder, BRAND), LOW, CHUNKS, "exact", measures=True)
    return _measured(found.itemsets)


@query
def qa_son_deep(spark, folder):
    return _measured(son(baskets(spark, folder, TYPE), LOW, CHUNKS, "exact", measures=True).itemsets)


@query
def qa_son_stats(spark, folder):
    return _son_stats(son(baskets(spark, folder, BRAND), LOW, CHUNKS, "exact", measures=True))


@query
def apriori_dense(spark, folder):
    return _plain(apriori(attribute_baskets(spark, folder), DENSE).itemsets)


@query
def qa_apriori_dense(spark, folder):
    return _measured(apriori(attribute_baskets(spark, folder), DENSE, "floor", measures=True).itemsets)


@query
def fpgrowth_dense(spark, folder):
    return _plain(fpgrowth(attribute_baskets(spark, folder), DENSE))


@query
def son_dense(spark, folder):
    return _plain(son(attribute_baskets(spark, folder), DENSE, CHUNKS, "floor").itemsets)


@query
def qa_son_dense(spark, folder):
    return _measured(son(attribute_baskets(spark, folder), DENSE, CHUNKS, "exact", measures=True).itemsets)


@query
def level_stats_dense(spark, folder):
    return apriori(attribute_baskets(spark, folder), DENSE).level_stats.select("level", "candidates", "frequent")


@query
def apriori_sparse(spark, folder):
    return _plain(apriori(order_parts(spark, folder), SPARSE).itemsets)


@query
def fpgrowth_sparse(spark, folder):
    return _plain(fpgrowth(order_parts(spark, folder), SPARSE))


@query
def apriori_messy(spark, folder):
    return _plain(apriori(messy_items(spark, folder), LOW).itemsets)


@query
def qa_apriori_messy(spark, folder):
    return _measured(apriori(messy_items(spark, folder), LOW, "floor", measures=True).itemsets)


@query
def son_messy(spark, folder):
    return _plain(son(messy_items(spark, folder), LOW, CHUNKS, "floor").itemsets)


@query
def son_local_messy(spark, folder):
    return _plain(son(messy_items(spark, folder), LOW, CHUNKS, "floor").local, "chunk")


@query
def fpgrowth_messy(spark, folder):
    return _plain(fpgrowth(messy_items(spark, folder), LOW))


@query
def itemset_summary_(spark, folder):
    return itemset_summary(apriori(baskets(spark, folder, TYPE), LOW).itemsets)


# Sweeps and reports


@query
def support_sweep(spark, folder):
    return _plain(sweep.support_sweep(baskets(spark, folder, TYPE), SUPPORTS).itemsets, "min_support")


@query
def level_stats(spark, folder):
    return sweep.support_sweep(baskets(spark, folder, TYPE), SUPPORTS).level_stats


@query
def level_stats_wide(spark, folder):
    return sweep.support_sweep(baskets(spark, folder, BRAND), SUPPORTS).level_stats


@query
def apriori_summary(spark, folder):
    return sweep.support_sweep(baskets(spark, folder, BRAND), SUPPORTS).summary


@query
def support_labels(spark, folder):
    summary = sweep.support_sweep(baskets(spark, folder, BRAND), SUPPORTS).summary
    return summary.select(percent_label(F.col("min_support")).alias("label"), "total_itemsets")


@query
def son_summary(spark, folder):
    return sweep.son_sweep(baskets(spark, folder, BRAND), CHUNKS, SUPPORTS).summary.withColumnRenamed("min_support", "support")


@query
def son_sweep(spark, folder):
    swept = sweep.son_sweep(baskets(spark, folder, TYPE), CHUNKS, SUPPORTS, measures=True)
    return _measured(swept.itemsets, "min_support")


@query
def son_sweep_candidates(spark, folder):
    found = sweep.son_sweep(baskets(spark, folder, TYPE), CHUNKS, SUPPORTS).candidates
    return found.select("min_support", itemset_key(F.col("items")).alias("itemset"), "length")


@query
def qa_sweep(spark, folder):
    swept = sweep.support_sweep(baskets(spark, folder, TYPE), SUPPORTS, measures=True)
    return _measured(swept.itemsets, "min_support")


@query
def qa_sweep_patterns(spark, folder):
    swept = sweep.support_sweep(baskets(spark, folder, TYPE), SUPPORTS, measures=True)
    dictionary = prep.item_dictionary(prep.clean_lines(retail_lines(spark, folder, TYPE)))
    patterns = reports.pattern_table(swept.itemsets, dictionary, "min_support")
    return patterns.withColumn("Avg_Log_Qty", F.round("Avg_Log_Qty", 6))


@query
def top_per_threshold(spark, folder):
    swept = sweep.support_sweep(baskets(spark, folder, TYPE), SUPPORTS, measures=True)
    return reports.top_per_threshold(swept.itemsets).withColumn("Avg_Log_Qty", F.round("Avg_Log_Qty", 6))


@query
def pruning_at_lowest_support(spark, folder):
    items = baskets(spark, folder, BRAND).persist()
    lowest = son(items, min(SUPPORTS), CHUNKS, "exact")
    pruned = sweep.pruning_at_lowest_support(sweep.support_sweep(items, SUPPORTS), lowest)
    items.unpersist()
    return pruned.withColumn("kept_ratio", F.round("kept_ratio", 6))


def _patterns(spark, folder, item):
    found = apriori(baskets(spark, folder, item), LOW, "floor", measures=True).itemsets
    dictionary = prep.item_dictionary(prep.clean_lines(retail_lines(spark, folder, item)))
    return found, dictionary


@query
def itemset_names(spark, folder):
    found, dictionary = _patterns(spark, folder, BRAND)
    # The dictionary lacks one item, whose name must read as unknown.
    named = reports.itemset_names(found, dictionary.where("item <> 'Brand#1'"))
    return named.select(itemset_key(F.col("items")).alias("itemset"), "name", "support")


@query
def pattern_table(spark, folder):
    return reports.pattern_table(*_patterns(spark, folder, BRAND)).withColumn(
        "Avg_Log_Qty", F.round("Avg_Log_Qty", 6)
    )


@query
def top_itemsets(spark, folder):
    top = reports.top_named_itemsets(*_patterns(spark, folder, BRAND))
    return top.withColumn("Avg_Log_Qty", F.round("Avg_Log_Qty", 6))


@query
def son_top_itemsets(spark, folder):
    found = son(baskets(spark, folder, BRAND), LOW, CHUNKS, "exact", measures=True).itemsets
    dictionary = prep.item_dictionary(prep.clean_lines(retail_lines(spark, folder, BRAND)))
    return reports.top_named_itemsets(found, dictionary).withColumn("Avg_Log_Qty", F.round("Avg_Log_Qty", 6))


@query
def itemset_names_unknown(spark, folder):
    """Sold items include some that no valid line describes."""
    lines = sized_lines(spark, folder)
    sold = prep.keep_positive_quantity(prep.drop_cancelled(lines))
    sold = prep.basket_items(sold, "basket_id", partitions=sales_partitions(spark, folder))
    named = reports.itemset_names(apriori(sold, SIZED).itemsets, prep.item_dictionary(prep.clean_lines(lines)))
    return named.select(itemset_key(F.col("items")).alias("itemset"), "name", "support")


@query
def top_volume_labels(spark, folder):
    top = reports.top_volume_labels(reports.pattern_table(*_patterns(spark, folder, TYPE)))
    return top.withColumn("Avg_Log_Qty", F.round("Avg_Log_Qty", 6))


@query
def max_qty_histogram(spark, folder):
    found = reports.max_qty_histogram(reports.pattern_table(*_patterns(spark, folder, TYPE)))
    return found.withColumns({c: F.round(c, 6) for c in ("bin_start", "bin_end")})


@query
def max_qty_density(spark, folder):
    found = reports.max_qty_density(reports.pattern_table(*_patterns(spark, folder, TYPE)))
    return found.withColumns({c: F.round(c, 6) for c in ("max_qty", "density")})


@query
def max_qty_density_binned(spark, folder):
    """The binned density against the exact one: off by no more than it says."""
    patterns = reports.pattern_table(*_patterns(spark, folder, TYPE))
    exact = reports.max_qty_density(patterns).select("point", F.col("density").alias("exact"))
    binned = reports.max_qty_density_binned(patterns).join(exact, "point")
    within = F.abs(F.col("density") - F.col("exact")) <= F.col("error_bound") + 1e-12
    return binned.select("point", F.round("max_qty", 6).alias("max_qty"), F.round("exact", 6).alias("density"), within.alias("within_bound"))


# Run metrics


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.round(f"`{f.name}`", 4) for f in df.schema if f.name.endswith("(s)")})


@query
def total_times(spark, folder):
    return _rounded(run_reports.total_times(run_metrics(spark, folder)))


@query
def apriori_breakdown(spark, folder):
    return _rounded(run_reports.apriori_breakdown(run_metrics(spark, folder)))


@query
def fpgrowth_breakdown(spark, folder):
    return _rounded(run_reports.fpgrowth_breakdown(run_metrics(spark, folder)))


@query
def son_breakdown(spark, folder):
    return _rounded(run_reports.son_breakdown(run_metrics(spark, folder)))


@query
def scalability_summary(spark, folder):
    return _rounded(run_reports.scalability_summary(labeled_run_metrics(spark, folder)))


@query
def scalability_by_support(spark, folder):
    summary = run_reports.scalability_summary(labeled_run_metrics(spark, folder))
    wide = run_reports.scalability_by_support(summary)
    return wide.withColumns({c: F.round(f"`{c}`", 4) for c in run_reports.CORE_ORDER})


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return top_itemsets(spark, folder)
