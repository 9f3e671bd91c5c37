import math

import pytest
from pyspark.sql import functions as F

from basketlore import basket_items, clean_lines, item_dictionary
from basketlore.catalog import fixtures
from basketlore.operators import prep

LINES = "InvoiceNo string, StockCode string, Description string, Quantity double, CustomerID string"


@pytest.fixture(scope="module")
def lines(spark):
    rows = [
        ("1", "a", "apple", 2.0, "7"),
        ("1", "a", "apple", 3.0, "7"),
        ("1", "b", "bread", 1.0, None),
        ("C1", "a", "apple", 1.0, "7"),
        ("c2", "a", "apple", 1.0, "7"),
        ("2", "a", "an apple", 4.0, "8"),
        ("2", "b", "nan", 4.0, "8"),
        ("2", "b", None, 4.0, "8"),
        ("3", "a", "apple", 0.0, "8"),
        ("3", "a", "apple", -1.0, "8"),
        ("3", "a", "apple", math.nan, "8"),
        ("3", "a", "apple", None, "8"),
        (None, "a", "apple", 1.0, "9"),
        (None, None, "odd", 1.0, "9"),
    ]
    return spark.createDataFrame(rows, LINES)


def test_cleaning_keeps_missing_keys_as_text(lines):
    kept = clean_lines(lines)
    assert sorted((r["InvoiceNo"], r["StockCode"], r["CustomerID"]) for r in kept.collect()) == [
        ("1", "a", "7"),
        ("1", "a", "7"),
        ("1", "b", "nan"),
        ("2", "a", "8"),
        ("nan", "a", "9"),
        ("nan", "nan", "9"),
    ]


def test_baskets_sum_quantities_and_need_two_items(lines):
    found = basket_items(clean_lines(lines)).collect()
    assert sorted(map(tuple, found)) == [
        ("1", "a", 5.0),
        ("1", "b", 1.0),
        ("nan", "a", 1.0),
        ("nan", "nan", 1.0),
    ]


def test_counts_and_dictionary(lines):
    items = basket_items(clean_lines(lines))
    assert tuple(prep.prep_counts(lines, items).first()) == (14, 6, 2)
    texts = {r["item"]: r["description"] for r in item_dictionary(clean_lines(lines)).collect()}
    assert texts == {"a": "an apple", "b": "bread", "nan": "odd"}


def test_array_and_map_forms_agree(lines):
    items = basket_items(clean_lines(lines))
    arrays = {r["basket_id"]: r for r in prep.basket_quantities(items).collect()}
    maps = {r["basket_id"]: r["quantities"] for r in prep.basket_quantity_map(items).collect()}
    sets = {r["basket_id"]: r["items"] for r in prep.basket_sets(items).collect()}
    for basket, row in arrays.items():
        assert dict(zip(row["items"], row["quantities"], strict=True)) == maps[basket]
        assert row["items"] == sets[basket] == sorted(maps[basket])


def test_missing_columns_are_named(lines):
    with pytest.raises(ValueError, match="Missing required columns: .*'Quantity'"):
        clean_lines(lines.drop("Quantity"))


def test_chunks_depend_on_the_key_only(spark):
    numbers = spark.range(100).select(F.col("id").alias("basket_id"))
    assert all(
        r["chunk"] == r["basket_id"] % 7
        for r in numbers.withColumn("chunk", prep.basket_chunk(7)).collect()
    )
    texts = numbers.select(F.col("basket_id").cast("string"))
    chunks = texts.withColumn("chunk", prep.basket_chunk(7, key_type="string"))
    first = {r["basket_id"]: r["chunk"] for r in chunks.collect()}
    again = {r["basket_id"]: r["chunk"] for r in chunks.repartition(5).collect()}
    assert first == again and set(first.values()) <= set(range(7))


def test_quantity_filter_reaches_the_scan(spark, lines, tmp_path):
    path = str(tmp_path / "lines.parquet")
    lines.write.parquet(path)
    df = clean_lines(spark.read.parquet(path)).select("InvoiceNo", "StockCode")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(Quantity,0.0)" in plan
    assert "CustomerID" not in plan.split("ReadSchema:")[1]


def test_tasks_follow_the_sales_files(spark, tmp_path, monkeypatch):
    """Baskets are assembled in as many tasks as the lines' files are long, with the same rows."""
    key = "bigint"
    orders = spark.createDataFrame([(i, "F", i % 3) for i in range(40)], f"o_orderkey {key}, o_orderstatus string, o_custkey {key}")
    parts = spark.createDataFrame([(i, f"part {i}", f"Brand#{i}", 1) for i in range(5)], f"p_partkey {key}, p_name string, p_brand string, p_size int")
    lines = [(i, i * j % 5, float(1 + j), 0.0, "N") for i in range(40) for j in range(4)]
    lines = spark.createDataFrame(lines, f"l_orderkey {key}, l_partkey {key}, l_quantity double, l_discount double, l_returnflag string")
    for name, df in (("orders", orders), ("part", parts), ("lineitem", lines)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    few = fixtures.baskets(spark, str(tmp_path), "p_brand")
    assert few.rdd.getNumPartitions() == 1
    monkeypatch.setattr(fixtures, "PARTITION_BYTES", 100)
    wanted = fixtures.sales_partitions(spark, str(tmp_path))
    many = fixtures.baskets(spark, str(tmp_path), "p_brand")
    assert wanted > 8 and many.rdd.getNumPartitions() == wanted
    assert sorted(many.collect()) == sorted(few.collect()) and few.count() > 40
