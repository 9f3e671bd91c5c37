"""Candidate generation: join frequent itemsets on their prefix, prune by subsets.

A level table holds the frequent itemsets of one length:

    chunk        basket chunk the itemset is frequent in (0 when there is one)
    id           identifier of the itemset, unique within its chunk
    pid          id of the itemset without its last item
    code, item   the last item, as a number and as text
    codes        all items as numbers, ascending
    items        all items as text, ascending
    support      number of baskets
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlore.workspace import Table, broadcast_within, for_join

# Itemsets with one prefix that are paired up under one key; larger classes are salted.
CLASS_SIZE = 4096


def _salted(level: Table) -> DataFrame:
    """``level`` with the number of salts of each itemset's prefix class."""
    if level.rows <= CLASS_SIZE:
        return level.df.withColumn("salts", F.lit(1))
    sizes = level.df.groupBy("chunk", "pid").agg(
        F.ceil(F.count(F.lit(1)) / CLASS_SIZE).cast("int").alias("salts")
    )
    return level.df.join(sizes, ["chunk", "pid"])


def _signature(codes) -> Column:
    """128 bits of an itemset."""
    return F.unhex(F.md5(F.array_join(F.transform(codes, lambda c: c.cast("string")), ",")))


def joined_pairs(level: Table) -> DataFrame:
    """Unions of two itemsets of ``level`` that share all but their last item.

    A prefix that very many itemsets share is salted, so its pairs are spread
    over tasks.
    """
    salted = _salted(level)
    left = salted.select(
        "chunk",
        "pid",
        F.pmod(F.xxhash64("code"), F.col("salts")).cast("int").alias("salt"),
        F.col("id").alias("left_id"),
        F.col("code").alias("left_code"),
        F.col("codes").alias("left_codes"),
        F.col("items").alias("left_items"),
        F.col("support").alias("left_support"),
    )
    right = salted.select(
        "chunk",
        "pid",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        "code",
        "item",
        "support",
    )
    if level.rows <= CLASS_SIZE:
        right = broadcast_within(level.view(right))
    found = left.join(right, ["chunk", "pid", "salt"]).where("left_code < code")
    return found.select(
        "chunk",
        F.col("left_id").alias("id"),
        "code",
        "item",
        F.concat("left_codes", F.array("code")).alias("codes"),
        F.array_sort(F.concat("left_items", F.array("item"))).alias("items"),
        F.least("left_support", "support").alias("min_support"),
    )


def candidates(level: Table, length: int) -> DataFrame:
    """Itemsets of ``length`` items whose every subset one shorter is in ``level``.

    The two subsets that drop one of the last two items are the joined pair. The
    others are exploded together, looked up by signature, compared in full and
    counted: the same few exchanges whatever the length.
    ``min_support`` is the smallest support among the subsets: the candidate
    also stands at any higher minimum count up to it.
    """
    found = joined_pairs(level)
    others = length - 2
    if others == 0:
        return found
    dropped = F.explode(F.sequence(F.lit(1), F.lit(others))).alias("dropped")
    subset = F.expr("concat(slice(codes, 1, dropped - 1), slice(codes, dropped + 1, size(codes)))")
    subsets = found.select("*", dropped).withColumn("subset", subset).withColumn("signature", _signature("subset"))
    known = level.df.select(
        "chunk", _signature("codes").alias("signature"), F.col("codes").alias("known"), F.col("support").alias("subset_support")
    )
    held = subsets.join(for_join(level.view(known)), ["chunk", "signature"]).where("subset = known")
    keys = ["chunk", "id", "code", "item", "codes", "items", "min_support"]
    counted = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("subsets"), F.min("subset_support").alias("least"))
    return counted.where(F.col("subsets") == others).withColumn("min_support", F.least("min_support", "least")).select(*keys)
