"""Text labels used by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEMSET_SEPARATOR = "|"
NAME_SEPARATOR = " + "
UNKNOWN_ITEM = "UNKNOWN"
LABEL_WIDTH = 30


def itemset_key(items: Column) -> Column:
    """One text per itemset; equal sets give equal text, others do not: a separator inside a code is escaped."""
    parts = F.transform(
        F.array_sort(items), lambda i: F.replace(F.replace(i, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    )
    return F.array_join(parts, ITEMSET_SEPARATOR)


def short_label(text: Column, width: int = LABEL_WIDTH) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def percent_label(ratio: Column) -> Column:
    """One decimal; rounds the binary value, exact halves to the even digit."""
    return F.concat(F.translate(F.format_number(ratio * 100, 1), ",", ""), F.lit("%"))


def algorithm_name(key: Column) -> Column:
    return (
        F.when(key == "apriori", "Apriori")
        .when(key == "fpgrowth", "FP-Growth")
        .otherwise("SON")
    )
