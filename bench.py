"""Time the headline queries and print one JSON line.

Plain and quantity-aware mining at supports 0.03, 0.025 and 0.02 over the order by
brand baskets, the deep order by type baskets, the dense customer by brand
baskets and the sparse customer by part baskets. Each time covers everything
from the Parquet scan to the last row, after one untimed warm-up.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from basketlore import apriori, basket_items, clean_lines, fpgrowth, son
from basketlore.catalog.fixtures import BRAND, TYPE, baskets, retail_lines, table
from basketlore.catalog.queries import QUERIES

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
CHUNKS = 40


def customer_baskets(spark, item):
    lines = table(spark, FOLDER, "lineitem").join(
        table(spark, FOLDER, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    parts = table(spark, FOLDER, "part")
    lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return basket_items(lines, "o_custkey", item, "l_quantity")


def rows(df):
    return df.agg(F.count(F.lit(1))).first()[0]


def cases(spark):
    def brand():
        return baskets(spark, FOLDER, BRAND)

    def deep():
        return baskets(spark, FOLDER, TYPE)

    yield "prepare", lambda: rows(basket_items(clean_lines(retail_lines(spark, FOLDER, BRAND)), "basket_id"))
    for s in (0.03, 0.025, 0.02):
        yield f"apriori_{s}", lambda s=s: rows(apriori(brand(), s).itemsets)
        yield f"fpgrowth_{s}", lambda s=s: rows(fpgrowth(brand(), s))
        yield f"son_{s}", lambda s=s: rows(son(brand(), s, CHUNKS).itemsets)
        yield f"qa_apriori_{s}", lambda s=s: rows(apriori(brand(), s, "floor", True).itemsets)
        yield f"qa_son_{s}", lambda s=s: rows(son(brand(), s, CHUNKS, "exact", True).itemsets)
    yield "apriori_deep_0.02", lambda: rows(apriori(deep(), 0.02).itemsets)
    yield "fpgrowth_deep_0.02", lambda: rows(fpgrowth(deep(), 0.02))
    yield "apriori_dense_0.5", lambda: rows(apriori(customer_baskets(spark, "p_brand"), 0.5).itemsets)
    yield "fpgrowth_dense_0.5", lambda: rows(fpgrowth(customer_baskets(spark, "p_brand"), 0.5))
    yield "apriori_sparse_0.001", lambda: rows(apriori(customer_baskets(spark, "l_partkey"), 0.001).itemsets)
    for name in ("top_itemsets", "support_sweep", "scalability_summary"):
        yield name, lambda name=name: rows(QUERIES[name](spark, FOLDER))


def main():
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="basketlore-bench-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    rows(apriori(baskets(spark, FOLDER, BRAND), 0.02).itemsets)
    seconds = {}
    for name, run in cases(spark):
        started = time.monotonic()
        run()
        seconds[name] = round(time.monotonic() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
