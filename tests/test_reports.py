import math

import pytest
from pyspark.sql import functions as F

from basketlore.functions.labels import algorithm_name, itemset_key, percent_label, short_label
from basketlore.plans import reports

ITEMSETS = "items array<string>, length int, support bigint, total_log_qty double, max_qty double"


@pytest.fixture(scope="module")
def patterns(spark):
    rows = [
        (["a"], 1, 9, 9.0, 3.0),
        (["a", "b"], 2, 4, 8.0, 10.0),
        (["a", "c"], 2, 4, 2.0, 40.0),
        (["b", "x"], 2, 3, 9.0, 10.0),
        (["a", "b", "c"], 3, 2, 1.0, 25.0),
    ]
    names = [("a", "apple" * 5), ("b", "bread"), ("c", "corn")]
    itemsets = spark.createDataFrame(rows, ITEMSETS)
    dictionary = spark.createDataFrame(names, "item string, description string")
    return reports.pattern_table(itemsets, dictionary)


def test_pattern_table(patterns):
    rows = {r["key"]: r for r in patterns.collect()}
    assert set(rows) == {"a|b", "a|c", "b|x", "a|b|c"}
    assert rows["b|x"]["Itemset"] == "bread + UNKNOWN"
    assert rows["a|b|c"]["Itemset"] == "apple" * 5 + " + bread + corn"
    assert rows["a|b"]["Avg_Log_Qty"] == 2.0


def test_top_rows_break_ties_by_key(patterns):
    assert [r["key"] for r in reports.top_itemsets(patterns, 3).collect()] == ["a|b", "a|c", "b|x"]
    top = reports.top_volume_labels(patterns, 2).collect()
    assert [r["key"] for r in top] == ["b|x", "a|b"]
    assert top[1]["label"] == ("apple" * 5 + " + bread")[:30] + "..."


def test_histogram_lists_every_bin(patterns):
    rows = sorted(map(tuple, reports.max_qty_histogram(patterns, 3).collect()))
    assert [(r[0], r[3]) for r in rows] == [(0, 2), (1, 1), (2, 1)]
    assert rows[0][1] == 10.0 and rows[2][2] == 40.0


def test_histogram_of_one_value_and_of_nothing(patterns):
    same = reports.max_qty_histogram(patterns.where("Max_Qty = 10"), 4).collect()
    assert sum(r["patterns"] for r in same) == 2 and len(same) == 4
    assert reports.max_qty_histogram(patterns.where("false")).count() == 0
    assert reports.max_qty_density(patterns.where("Max_Qty = 10")).count() == 0


def test_density_matches_its_formula(patterns):
    values = [10.0, 40.0, 10.0, 25.0]
    mean = sum(values) / 4
    width = math.sqrt(sum((v - mean) ** 2 for v in values) / 3) * 4 ** (-1 / 5)
    rows = reports.max_qty_density(patterns, 5).collect()
    assert len(rows) == 5
    for row in rows:
        total = sum(math.exp(-(((row["max_qty"] - v) / width) ** 2) / 2) for v in values)
        assert row["density"] == pytest.approx(total / (4 * width * math.sqrt(2 * math.pi)))


def test_labels(spark):
    ratios = [0.03, 0.025, 0.0025, 0.0125, 0.0035, 0.00375, 0.5, 1.0, 12.5]
    labels = [
        spark.range(1).select(percent_label(F.lit(r))).first()[0] for r in ratios
    ]
    assert labels == [f"{r * 100:.1f}%" for r in ratios]
    row = spark.range(1).select(
        short_label(F.lit("x" * 30)).alias("fits"),
        short_label(F.lit("x" * 31)).alias("cut"),
        percent_label(F.lit(0.025)).alias("percent"),
        algorithm_name(F.lit("fpgrowth")).alias("name"),
    )
    assert tuple(row.first()) == ("x" * 30, "x" * 30 + "...", "2.5%", "FP-Growth")


def test_repeated_itemsets_are_named_once(spark):
    rows = [(0.3, ["a", "b"], 2, 4, 8.0, 10.0), (0.2, ["a", "b"], 2, 4, 8.0, 10.0), (0.2, ["b"], 1, 9, 1.0, 1.0)]
    itemsets = spark.createDataFrame(rows, f"min_support double, {ITEMSETS}")
    dictionary = spark.createDataFrame([("a", "A"), ("b", "B")], "item string, description string")
    named = reports.itemset_names(itemsets, dictionary).collect()
    assert sorted((r["min_support"], r["name"]) for r in named) == [(0.2, "A + B"), (0.2, "B"), (0.3, "A + B")]


def test_keys_of_different_itemsets_differ(spark):
    rows = [(["a|b", "c"],), (["a", "b|c"],), (["a", "b", "c"],), (["a\\", "b"],), (["a\\|b"],)]
    keys = [r[0] for r in spark.createDataFrame(rows, "items array<string>").select(itemset_key(F.col("items"))).collect()]
    assert len(set(keys)) == len(rows) and keys[2] == "a|b|c"


def test_binned_density_is_within_its_bound(spark):
    """Very unequal distances, repeated values and nulls; the mass of the bins is that of the values."""
    values = [0.0, 0.1, 0.1, 0.25, 3.0, 3.5, 7.0, 7.0, 7.0, 19.9, 20.0, None]
    patterns = spark.createDataFrame([(v,) for v in values], "Max_Qty double")
    exact = {r["point"]: r for r in reports.max_qty_density(patterns, 50).collect()}
    for cells in (1, 4, 16):
        binned = reports.max_qty_density_binned(patterns, 50, cells).collect()
        assert len(binned) == 50
        for r in binned:
            assert r["max_qty"] == pytest.approx(exact[r["point"]]["max_qty"])
            assert abs(r["density"] - exact[r["point"]]["density"]) <= r["error_bound"] + 1e-12
    assert binned[0]["error_bound"] < 1e-4
    same = spark.createDataFrame([(2.0,), (2.0,)], "Max_Qty double")
    assert reports.max_qty_density_binned(same).count() == 0


def test_top_per_threshold_keeps_ties_in_item_order(spark):
    rows = [
        (s, items, len(items), n, logs, 1.0)
        for s, found in {
            0.2: [(["a"], 9, 99.0), (["a", "b"], 2, 4.0), (["a", "c"], 1, 2.0), (["b", "c"], 4, 1.0), (["c", "d"], 1, 3.0)],
            0.1: [(["x", "y"], 5, 5.0)],
        }.items()
        for items, n, logs in found
    ]
    itemsets = spark.createDataFrame(rows, f"min_support double, {ITEMSETS}")
    top = reports.top_per_threshold(itemsets, 3)
    found = [(r["min_support"], r["place"], r["key"]) for r in top.orderBy("min_support", "place").collect()]
    assert found == [(0.1, 1, "x|y"), (0.2, 1, "c|d"), (0.2, 2, "a|b"), (0.2, 3, "a|c")]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_top_named_itemsets_equal_those_of_the_whole_table(spark):
    rows = [(["a", "b"], 2, 4, 8.0, 10.0), (["a", "c"], 2, 4, 2.0, 40.0), (["b", "x"], 2, 3, 9.0, 10.0), (["a"], 1, 9, 1.0, 1.0)]
    itemsets = spark.createDataFrame(rows, ITEMSETS)
    names = spark.createDataFrame([("a", "apple"), ("b", "bread")], "item string, description string")
    for n in (1, 2, 10):
        whole = reports.top_itemsets(reports.pattern_table(itemsets, names), n)
        assert reports.top_named_itemsets(itemsets, names, n).collect() == whole.collect()
