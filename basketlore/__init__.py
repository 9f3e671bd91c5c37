"""Market-basket mining on Spark DataFrames."""

from basketlore.operators.apriori import AprioriResult, apriori
from basketlore.operators.fpgrowth import fpgrowth, fpgrowth_summary
from basketlore.operators.prep import (
    basket_items,
    clean_lines,
    explode_baskets,
    item_dictionary,
)
from basketlore.operators.son import SonResult, son
from basketlore.plans.reports import pattern_table, top_itemsets
from basketlore.plans.sweep import support_sweep
from basketlore.sources.metrics import read_run_metrics
from basketlore.sources.retail import read_lines

__all__ = [
    "AprioriResult",
    "SonResult",
    "apriori",
    "basket_items",
    "clean_lines",
    "explode_baskets",
    "fpgrowth",
    "fpgrowth_summary",
    "item_dictionary",
    "pattern_table",
    "read_lines",
    "read_run_metrics",
    "son",
    "support_sweep",
    "top_itemsets",
]
