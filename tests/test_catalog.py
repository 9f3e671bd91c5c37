"""A sample of the catalog against its SQL; ``tools/compare.py`` runs all of it."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from basketlore.catalog.queries import QUERIES
from tools.compare import compare, oracle_connection

SAMPLE = (
    "scan_baskets",
    "scan_lines",
    "scan_run_metrics",
    "clean_lines",
    "basket_quantity_map",
    "prep_counts",
    "basket_chunks",
    "scalability_by_support",
    "fpgrowth_deep",
    "qa_son",
    "level_stats_wide",
    "pattern_table",
)


def test_every_query_has_sql():
    assert QUERIES.keys() <= queries().keys()
    assert QUERIES.keys() <= oracle_sql().keys()


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, folder, name):
    assert compare(spark, oracle_connection(folder), folder, name) == ""


def test_entry_gives_the_known_top_pairs(spark):
    top = [(r["key"], r["Support"], round(r["Avg_Log_Qty"], 6), r["Max_Qty"]) for r in entry(spark).collect()]
    assert len(top) == 10
    assert top[:3] == [
        ("Brand#11|Brand#16", 49, 2.558842, 47.0),
        ("Brand#11|Brand#13", 46, 2.972741, 50.0),
        ("Brand#13|Brand#5", 43, 2.55623, 38.0),
    ]
