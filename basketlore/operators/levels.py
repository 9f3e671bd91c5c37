"""The level-wise loop shared by Apriori and both phases of SON.

Baskets become one row each: the ascending array of their frequent items. A
*projection* row stands for one frequent itemset inside one basket and carries
the tail of items that may still extend it:

    chunk, id    the itemset
    weight       number of identical baskets the row stands for
    volume       smallest quantity of the itemset's items (quantity-aware runs)
    tail, pos    an item array, of structs of code (and qty); the itemset may be
                 extended by the items behind position pos

The baskets are dealt once, by chunk first and basket second: a task holds baskets
of one chunk, and merges identical ones without another shuffle. Counting a level
explodes what lies behind the position, drops what is no candidate and feeds a
partial aggregate, all in one stage: the shuffle carries at most one row per task
and candidate of the task's chunk, whatever the number of baskets. The next
projection is a narrow step too. Projections are streamed from the baskets; only
every few levels, when they have shrunk, is one written.

Candidates beyond one broadcast are joined to the counted extensions instead of the
exploded ones: extensions are counted in the tasks first, so that no key of that
join is hot, however many baskets hold it.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlore.functions.support import min_count
from basketlore.operators.candidates import candidates
from basketlore.operators.prep import basket_count
from basketlore.workspace import (
    Table,
    Workspace,
    broadcast_within,
    fits_broadcast,
    for_join,
    join_hot_apart,
)

ROOT_ID = -1
# Pairs one task may enumerate from one basket; wider baskets are split.
PAIRS_PER_TASK = 4_000_000
# Levels streamed from the baskets or the last written projection.
CUT_EVERY = 3


@dataclass
class Level:
    """What one level produced."""

    length: int
    candidate_count: int
    frequent: Table
    seconds: float
    candidates: Table | None = None


def measure_columns(measures: bool) -> list[str]:
    return ["total_log_qty", "max_qty"] if measures else []


@dataclass(frozen=True)
class Limits:
    """Baskets and minimum count of every chunk, by chunk number."""

    baskets: list[int]
    min_counts: list[float]

    @property
    def total(self) -> int:
        return sum(self.baskets)

    def reached(self) -> Column:
        """True for rows whose support reaches the minimum count of their chunk."""
        if len(self.min_counts) == 1:
            return F.col("support") >= F.lit(self.min_counts[0])
        return F.col("support") >= F.get(F.lit(self.min_counts), F.col("chunk"))


def chunk_limits(items: DataFrame, ratio: float, mode: str, chunks: int) -> Limits:
    """One row per chunk comes to the driver; the caller chose their number."""
    sizes = items.groupBy("chunk").agg(basket_count().alias("baskets"))
    rows = sizes.select("chunk", "baskets", min_count(F.col("baskets"), ratio, mode).alias("least")).collect()
    baskets, least = [0] * chunks, [1.0] * chunks
    for row in rows:
        baskets[row["chunk"]], least[row["chunk"]] = row["baskets"], row["least"]
    return Limits(baskets, least)


def count_items(work: Workspace, items: DataFrame, measures: bool) -> Table:
    """Support of every single item per chunk."""
    found = [F.count(F.lit(1)).alias("support")]
    if measures:
        found += [
            F.sum(F.log1p("qty")).alias("total_log_qty"),
            F.max("qty").alias("max_qty"),
        ]
    counts = items.where("item IS NOT NULL").groupBy("chunk", "item").agg(*found)
    return work.write(counts, "item_counts")


def _level_columns(measures: bool) -> list:
    return [
        "chunk",
        F.col("code").alias("id"),
        F.lit(ROOT_ID).cast("bigint").alias("pid"),
        "code",
        "item",
        F.array("code").alias("codes"),
        F.array("item").alias("items"),
        "support",
        *measure_columns(measures),
    ]


def first_level(
    work: Workspace, frequent: DataFrame, chunks: int, measures: bool
) -> tuple[Table, Table]:
    """Number the items that are frequent in some chunk; return the numbering, with supports, and level 1.

    Rarest first, which keeps the classes of itemsets with a common prefix
    small. The numbers follow the sort order and are fixed by writing them.
    """
    number = F.monotonically_increasing_id()
    if chunks == 1:
        coded = frequent.orderBy("support", "item").withColumn("code", number)
        level = work.write(coded.select(*_level_columns(measures)), "level1")
        return level.view(level.df.select("code", "item", "support")), level
    total = frequent.groupBy("item").agg(F.sum("support").alias("support"))
    coded = total.orderBy("support", "item").select(number.alias("code"), "item", "support")
    # The single items of SON's candidates.
    dictionary = work.write(coded, "union1")
    words = broadcast_within(dictionary.view(dictionary.df.drop("support")))
    level = frequent.join(words, "item").select(*_level_columns(measures))
    return dictionary, work.write(level, "level1")


def encode_baskets(items: DataFrame, dictionary: Table, measures: bool, chunks: int) -> DataFrame:
    """One row per basket, ``(chunk, weight, basket)``, with its frequent items only.

    An array holds at most the dictionary, which has no more than
    (mean basket size / minimum support) items. The items are dealt to tasks of
    one chunk each, so many tasks a chunk as the session's shuffle width allows.
    Without quantities, identical baskets of a task are merged and weighted
    there: both groupings keep the column the rows were dealt by.
    """
    width = -(-int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")) // chunks)
    slot = F.col("chunk") * width + F.pmod(F.xxhash64("basket_id"), F.lit(width)).cast("int")
    coded = join_hot_apart(items, dictionary, ["item"], "support").withColumn("slot", slot)
    element = F.struct("code", "qty") if measures else F.struct("code")
    arrays = (
        coded.repartitionById(chunks * width, F.col("slot"))
        .groupBy("slot", "chunk", "basket_id")
        .agg(F.sort_array(F.collect_list(element)).alias("basket"))
        .where(F.size("basket") > 1)
    )
    if measures:
        return arrays.select("chunk", F.lit(1).cast("bigint").alias("weight"), "basket")
    merged = arrays.groupBy("slot", "chunk", "basket").agg(F.count(F.lit(1)).alias("weight"))
    return merged.select("chunk", "weight", "basket")


def split_wide(baskets: DataFrame, item_count: int) -> DataFrame:
    """Spread the pairs of very wide baskets over several tasks.

    Adds ``parts`` and ``part``: the row handles the basket positions that
    leave ``part`` when divided by ``parts``. If the dictionary is so short
    that no basket can exceed the budget, nothing is tested or moved.
    """
    whole = baskets.withColumns({"parts": F.lit(1), "part": F.lit(0)})
    if item_count * (item_count - 1) // 2 <= PAIRS_PER_TASK:
        return whole
    size = F.size("basket").cast("double")
    parts = F.ceil(size * (size - 1) / 2 / PAIRS_PER_TASK).cast("int")
    narrow = whole.where(parts <= 1)
    wide = (
        baskets.where(parts > 1)
        .withColumn("parts", parts)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    return narrow.unionByName(wide.repartition("basket", "part"))


def project_items(baskets: DataFrame, wanted: Table | None, measures: bool) -> DataFrame:
    """Projection of every item of every basket, from ``split_wide`` rows.

    With candidates that fit a broadcast only their first items start an itemset.
    """
    volume = ["head.qty AS volume"] if measures else []
    projection = (
        baskets.select("chunk", "weight", "basket", "parts", "part", F.posexplode("basket").alias("pos", "head"))
        .where("pos + 1 < size(basket) AND pos % parts = part")
        .selectExpr("chunk", "head.code AS id", "weight", *volume, "basket AS tail", "pos")
    )
    if wanted is not None and fits_broadcast(wanted):
        first = wanted.df.select("chunk", F.get("codes", F.lit(0)).alias("id"))
        projection = projection.join(F.broadcast(first), ["chunk", "id"], "left_semi")
    return projection


def _rest() -> Column:
    """What may still extend a projected itemset."""
    return F.expr("slice(tail, pos + 2, size(tail))")


def project_next(projection: DataFrame, level: Table, measures: bool) -> DataFrame:
    """Lengthen every projected itemset by one item, to those of ``level``."""
    steps = level.df.select("chunk", F.col("id").alias("next_id"), F.col("pid").alias("id"), "code")
    volume = ["volume"] if measures else []
    heads = projection.select(
        "chunk", "id", "weight", *volume, "tail", "pos", F.posexplode(_rest()).alias("behind", "head")
    ).where("pos + behind + 2 < size(tail)")
    volume = ["least(volume, head.qty) AS volume"] if measures else []
    coded = heads.withColumn("code", F.col("head.code"))
    return coded.join(for_join(level.view(steps)), ["chunk", "id", "code"]).selectExpr(
        "chunk", "next_id AS id", "weight", *volume, "tail", "pos + behind + 1 AS pos"
    )


def count_extensions(projection: DataFrame, wanted: Table | None, measures: bool) -> DataFrame:
    """Support, and quantities if asked, of itemsets one longer.

    Candidates ``wanted`` that fit a broadcast are picked before anything is
    counted. Others are left to the join that names them.
    """
    found = [F.sum("weight").alias("support")]
    volume = []
    if measures:
        volume = ["volume"]
        joint = F.least("volume", "qty")
        found += [
            F.sum(F.log1p(joint)).alias("total_log_qty"),
            F.max(joint).alias("max_qty"),
        ]
    keys = ["chunk", "id", "code"]
    longer = projection.select("chunk", "id", "weight", *volume, F.explode(_rest()).alias("next"))
    longer = longer.select("chunk", "id", "weight", *volume, "next.*")
    if wanted is not None and fits_broadcast(wanted):
        longer = longer.join(F.broadcast(wanted.df.select(*keys)), keys, "left_semi")
    return longer.groupBy(*keys).agg(*found)


def named_counts(counts: DataFrame, wanted: Table, *names: str) -> DataFrame:
    """The counts of the candidates ``wanted``, and of no other extension, with columns of theirs."""
    keys = ["chunk", "id", "code"]
    return counts.join(for_join(wanted.view(wanted.df.select(*keys, *names))), keys)


class Projections:
    """The projection that counts a length, streamed from as late a point as there is."""

    def __init__(self, work: Workspace, baskets: DataFrame, name: str, measures: bool):
        self.work, self.baskets, self.name, self.measures = work, baskets, name, measures
        self.written: DataFrame | None = None
        self.depth = 1

    def counting(self, length: int, levels: list[Table], wanted: Table | None) -> DataFrame:
        """Itemsets one shorter than ``length`` with their tails; ``levels`` are the shorter ones."""
        if self.written is None:
            projection = project_items(self.baskets, wanted, self.measures)
        else:
            projection = self.written
        for level in levels[self.depth : length - 1]:
            projection = project_next(projection, level, self.measures)
        if length > CUT_EVERY and length % CUT_EVERY == 1:
            rest = projection.withColumns({"tail": _rest(), "pos": F.lit(-1)})
            projection = self.work.write(rest, f"{self.name}{length}").df
            self.written, self.depth = projection, length - 1
        return projection


def _pair_level(counts: DataFrame, level: Table, measures: bool) -> DataFrame:
    """Level 2 from counts of pairs: the texts come from level 1, joined twice."""
    words = broadcast_within(level.view(level.df.select("chunk", "code", "item")))
    heads = words.toDF("chunk", "id", "head_item")
    return (
        counts.join(heads, ["chunk", "id"])
        .join(words, ["chunk", "code"])
        .select(
            "chunk",
            "id",
            "code",
            "item",
            F.array("id", "code").alias("codes"),
            F.array_sort(F.array("head_item", "item")).alias("items"),
            "support",
            *measure_columns(measures),
        )
    )


def _numbered(found: DataFrame) -> DataFrame:
    """The parent becomes ``pid``; every itemset gets an ``id``, fixed by writing it."""
    return found.withColumnRenamed("id", "pid").withColumn("id", F.monotonically_increasing_id())


def _pair_count(level: Table, chunks: int) -> int:
    """Candidates of length 2: every pair of frequent items of a chunk."""
    if chunks == 1:
        return level.rows * (level.rows - 1) // 2
    sizes = level.df.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs")).first()["pairs"] or 0


class Mining:
    """A run over ``items(chunk, basket_id, item, qty)``, one level after another.

    Iterating yields the level of single items, which is there at once, and mines each
    further one when it is asked for: a caller who stops pays for no deeper level.
    A level is run, and reported, while it has candidates.
    """

    def __init__(self, work: Workspace, items: DataFrame, ratio: float, mode: str, measures: bool, chunks: int = 1):
        self.work, self.measures, self.chunks = work, measures, chunks
        self.items = items
        started = time.monotonic()
        self.limits = chunk_limits(items, ratio, mode, chunks)
        self.item_counts = count_items(work, items, measures)
        frequent = self.item_counts.df.where(self.limits.reached())
        self.dictionary, level = first_level(work, frequent, chunks, measures)
        self.levels = [Level(1, self.item_counts.rows, level, time.monotonic() - started)]
        self._baskets: DataFrame | None = None

    @property
    def baskets(self) -> DataFrame:
        """The encoded baskets, written when they are first needed; after that ``items`` is not read again."""
        if self._baskets is None:
            encoded = encode_baskets(self.items, self.dictionary, self.measures, self.chunks)
            self._baskets = self.work.write(encoded, "baskets").df
        return self._baskets

    def __iter__(self) -> Iterator[Level]:
        yield self.levels[0]
        projections = None
        while self.levels[-1].frequent.rows > 1:
            started, length = time.monotonic(), len(self.levels) + 1
            before = self.levels[-1].frequent
            wanted = None
            if length == 2:
                # Every pair of frequent items is a candidate: no need to list them.
                candidate_count = _pair_count(before, self.chunks)
            else:
                wanted = self.work.write(candidates(before, length), f"candidates{length}")
                candidate_count = wanted.rows
            if candidate_count == 0:
                return
            if projections is None:
                wide = split_wide(self.baskets, self.dictionary.rows)
                projections = Projections(self.work, wide, "projection", self.measures)
            projection = projections.counting(length, [v.frequent for v in self.levels], wanted)
            counts = count_extensions(projection, wanted, self.measures).where(self.limits.reached())
            if wanted is None:
                found = _pair_level(counts, before, self.measures)
            else:
                found = named_counts(counts, wanted, "item", "codes", "items").select(
                    "chunk", "id", "code", "item", "codes", "items", "support", *measure_columns(self.measures)
                )
            level = self.work.write(_numbered(found), f"level{length}")
            self.levels.append(Level(length, candidate_count, level, time.monotonic() - started, wanted))
            yield self.levels[-1]


@contextmanager
def mining(
    work: Workspace,
    items: DataFrame,
    ratio: float,
    mode: str,
    measures: bool,
    chunks: int = 1,
    keep_candidates: bool = False,
) -> Iterator[Mining]:
    """A run whose tables go when the block ends: all but the levels, and all if it fails."""
    try:
        run = Mining(work, items, ratio, mode, measures, chunks)
        yield run
    except BaseException:
        work.clear()
        raise
    gone = ["baskets", "projection", "item_counts"]
    for name in gone if keep_candidates else [*gone, "candidates"]:
        work.remove(name)


def with_chunk(items: DataFrame, chunk: Column) -> DataFrame:
    return items.select(chunk.alias("chunk"), "basket_id", "item", "qty")
