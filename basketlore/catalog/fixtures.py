"""The standard tables in the shapes the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlore.operators.prep import basket_items, clean_lines
from basketlore.sources.metrics import read_labeled_run_metrics, read_run_metrics
from basketlore.sources.sinks import write_document
from basketlore.workspace import Workspace

# Item column of the wide and of the deep baskets.
BRAND = "p_brand"
TYPE = "p_type"
CORE_LABELS = ("20 Cores", "10 Cores", "4 Cores")
THRESHOLD_KEYS = ("0.03", "0.025", "0.02")
# Bytes of sales files for each task that assembles baskets.
PARTITION_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def retail_lines(spark: SparkSession, folder: str, item: str) -> DataFrame:
    """Sales lines with cancelled invoices, returns and missing descriptions."""
    joined = (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    cancelled = F.when(F.col("o_orderstatus") == "P", "C").otherwise("")
    returned = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)
    return joined.select(
        F.concat(cancelled, F.col("l_orderkey").cast("string")).alias("InvoiceNo"),
        F.col("l_orderkey").alias("basket_id"),
        F.col(item).alias("StockCode"),
        F.when(F.col("p_size") % 25 != 0, F.col("p_name")).alias("Description"),
        F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("Quantity"),
        F.col("o_custkey").cast("string").alias("CustomerID"),
    )


def sales_partitions(spark: SparkSession, folder: str) -> int:
    """Tasks to assemble the baskets of all sales lines: as many as the lines' files are long."""
    lines = table(spark, folder, "lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return -(-int(str(lines)) // PARTITION_BYTES)


def baskets(spark: SparkSession, folder: str, item: str, min_items: int = 2) -> DataFrame:
    """Cleaned baskets in long form, of two items at least."""
    lines = clean_lines(retail_lines(spark, folder, item))
    return basket_items(lines, "basket_id", min_items=min_items, partitions=sales_partitions(spark, folder))


def attribute_baskets(spark: SparkSession, folder: str) -> DataFrame:
    """Dense baskets: an order holds the return flags, brand groups and types of its lines.

    Frequent and rare items differ much, so deep levels lose candidates to pruning and
    keep others.
    """
    lines = table(spark, folder, "lineitem").join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    items = F.array(
        F.concat(F.lit("flag="), "l_returnflag"),
        F.concat(F.lit("brand="), F.substring("p_brand", 7, 1)),
        F.concat(F.lit("type="), "p_type"),
    )
    return basket_items(lines.select("l_orderkey", "l_quantity", F.explode(items).alias("item")), "l_orderkey", "item", "l_quantity")


def order_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse baskets: an order holds a few of very many parts."""
    lines = table(spark, folder, "lineitem").withColumn("item", F.col("l_partkey").cast("string"))
    return basket_items(lines, "l_orderkey", "item", "l_quantity")


def messy_items(spark: SparkSession, folder: str) -> DataFrame:
    """Long-form baskets as they may come: lines repeated, without a basket, without an item."""
    lines = table(spark, folder, "lineitem").join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    rows = lines.select(
        F.when(F.col("l_orderkey") % 50 != 0, F.col("l_orderkey")).alias("basket_id"),
        F.when(F.col("p_size") % 25 != 0, F.col("p_brand")).alias("item"),
        F.col("l_quantity").alias("qty"),
        "l_linenumber",
    )
    return rows.unionByName(rows.where("l_linenumber = 1")).drop("l_linenumber")


def sized_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Sales lines whose items are part sizes; no line of the sizes 25 and 50 has a description."""
    return retail_lines(spark, folder, "p_size").withColumn("StockCode", F.col("StockCode").cast("string"))


def _timings(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as timings: one algorithm step, threshold and machine size each."""
    labels = F.array(*(F.lit(v) for v in CORE_LABELS))
    keys = F.array(*(F.lit(v) for v in THRESHOLD_KEYS))
    return table(spark, folder, "events").select(
        labels[(F.col("user_id") % 3).cast("int")].alias("Cores"),
        keys[(F.col("event_id") % 3).cast("int")].alias("Support"),
        "event_type",
        "user_id",
        "value",
    )


def metrics_documents(spark: SparkSession, folder: str, *by: str) -> DataFrame:
    """Run-metrics documents summed up from the events, one per value of ``by``.

    The highest threshold has no level 3 and the lowest SON run no total time,
    as in a run that stopped early.
    """
    timings = _timings(spark, folder)
    keys = [*by, "Support"]

    def seconds(kind: str):
        return F.sum(F.when(F.col("event_type") == kind, F.col("value")))

    level = (
        F.when(F.col("event_type") == "click", "1")
        .when(F.col("event_type") == "view", "2")
        .when((F.col("event_type") == "purchase") & (F.col("Support") != "0.03"), "3")
        .when(F.col("event_type") == "signup", "4")
    )
    levels = (
        timings.withColumn("level", level)
        .where("level IS NOT NULL")
        .groupBy(*keys, "level")
        .agg(
            F.count(F.lit(1)).alias("candidates_count"),
            F.count_distinct("user_id").alias("frequent_count"),
            F.sum("value").alias("execution_time"),
        )
        .groupBy(*keys)
        .agg(
            F.map_from_entries(
                F.collect_list(
                    F.struct("level", F.struct("candidates_count", "frequent_count", "execution_time"))
                )
            ).alias("levels")
        )
    )
    runs = timings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("user_id").alias("users"),
        F.sum("value").alias("total_time"),
        seconds("click").alias("build_time"),
        seconds("view").alias("mine_time"),
        seconds("purchase").alias("phase1_time"),
        seconds("signup").alias("phase2_time"),
    )
    entries = runs.join(levels, keys).select(
        *keys,
        "n",
        F.struct("total_time", F.col("n").alias("total_itemsets"), "levels").alias("apriori"),
        F.struct(
            "build_time", "mine_time", "total_time", F.col("n").alias("count"), F.lit(3).alias("max_length")
        ).alias("fpgrowth"),
        F.struct(
            F.lit(4).alias("num_partitions"),
            "phase1_time",
            F.col("n").alias("candidates_generated"),
            "phase2_time",
            F.col("users").alias("final_frequent_itemsets"),
            F.when(F.col("Support") != "0.02", F.col("total_time")).alias("total_time"),
        ).alias("son"),
    )
    maps = [
        F.map_from_entries(F.collect_list(F.struct("Support", name))).alias(name)
        for name in ("apriori", "fpgrowth", "son")
    ]
    metadata = F.struct(
        F.sum("n").alias("total_baskets"),
        F.sort_array(F.collect_list(F.col("Support").cast("double")), asc=False).alias("thresholds"),
        F.lit("derived").alias("spark_master"),
        F.lit("events").alias("spark_application_id"),
        F.lit(4).alias("num_partitions"),
    )
    return entries.groupBy(*by).agg(*maps, metadata.alias("metadata"))


def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """One document over all events, written and read back."""
    path = Workspace(spark, "metrics").path("run")
    write_document(metrics_documents(spark, folder), path)
    return read_run_metrics(spark, path)


def labeled_run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """One document per machine size, each in a folder of its own, read back with labels."""
    work = Workspace(spark, "metrics")
    documents = work.write(metrics_documents(spark, folder, "Cores"), "documents").df
    folders = {}
    for label in CORE_LABELS:
        folders[label] = work.path(label.replace(" ", "_"))
        write_document(documents.where(F.col("Cores") == label).drop("Cores"), folders[label])
    return read_labeled_run_metrics(spark, folders)
