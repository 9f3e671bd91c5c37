"""Conversation prefix trie by van Emde Boas recursion.

A node of the trie is a distinct sequence of first turns. All pieces of sequences
are cut at half their depth at once: the upper halves, named by their content and
the name of the prefix above them, fall together where conversations agree; a lower
half goes on under the name of its cut prefix. Then both kinds are cut again, until
pieces are single turns, which are the nodes. The number of rounds is the logarithm
of the depth, and equal conversations, equal halves, equal quarters are one row from
the round that finds them equal.

Totals go the other way. The total of a lower tree is grafted onto the cut prefix
it hangs from and reaches all nodes on that prefix's upper piece; the total of a
subproblem is what its root passes on to the next wider one.

A piece holds at most ``BLOCK`` turns. Longer conversations are cut into blocks of
that many turns first, and a block's digest is the turn of a trie one tier up, which
is built by the same rounds; its nodes are the roots of the blocks below. So no row
and no group grows with a conversation.

Names are 128 bits of SHA-256: the turns of a node are those of ``conv_id``, its
smallest member. Null roles and texts are empty. Turns stand in order of ``turn``,
null first; equal turns in order of the digest of role and text, repeated rows are
turns of their own. Rows without ``conv_id`` belong to no conversation and are left
out. ``c % 20`` takes the sign of c. An empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlore.llm.shared import Scratch, text_of

# Turns in one piece.
BLOCK = 64
# Identifiers in one row of a list of members.
LIST_ROWS = 8192
WORD = r"[^\x20\x09-\x0D]+"
ROOT = ""


def _digest(*parts) -> Column:
    return F.left(F.sha2(F.concat_ws(",", *parts), 256), F.lit(32))


def _turn_token() -> Column:
    """What makes a turn, and the number of words in its text."""
    role, text = text_of("role"), text_of("text")
    framed = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    words = F.regexp_count(text, F.lit(WORD)).cast("string")
    return F.concat(F.left(F.sha2(framed, 256), F.lit(32)), F.lit(":"), words)


def _path() -> Column:
    """Names of all prefixes that end in a piece, each from the prefix it was cut under."""
    names = """
        aggregate(sequence(1, size(tokens)), array(root), (a, j) -> concat(a, array(
            left(sha2(concat_ws(',', get(a, j - (j & -j)), slice(tokens, j - (j & -j) + 1, j & -j)), 256), 32))))
    """
    return F.expr(f"concat(slice({names}, 2, size(tokens) - 1), array(end))")


def _ordered(work: Scratch, turns: DataFrame) -> DataFrame:
    """``(conv_id, token, place)``: places rise through a conversation, in as many tasks as it needs."""
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        _turn_token().alias("token"),
        # Repeated rows may fill more than one task.
        F.monotonically_increasing_id().alias("tie"),
    )
    # Finding ranges reads the rows twice; without their texts that is cheap.
    rows = work.write(rows, "tokens")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "token", "tie"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return work.write(ranged.select("conv_id", "token", F.monotonically_increasing_id().alias("place")), "turns")


def _rebuilt(work: Scratch, turns: DataFrame, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """All conversations, and ``(conv_id, depth, token)`` of their rebuilt turns.

    A conversation starts with the first turns of the first of its group of
    ``group`` identifiers, at most ``heads`` - 1 of them, in place of its own.
    """
    part = F.shiftright("place", 33)
    placed = _ordered(work, turns).withColumn("part", part)
    parts = placed.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    parts = work.write(parts, "parts")
    lengths = parts.groupBy("conv_id").agg(F.sum("rows").alias("length"))
    base = F.col("conv_id") - F.col("conv_id") % group
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    found = lengths.select("conv_id", base.alias("base"), head.alias("head"))
    there = lengths.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    taken = F.least("head", F.coalesce("base_length", F.lit(0)))
    convs = work.write(found.join(there, "base", "left").select("conv_id", "base", "head", taken.alias("taken")), "convs")

    before = F.sum("rows").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = parts.withColumn("before", F.coalesce(before, F.lit(0))).join(convs.drop("base"), "conv_id")
    # A part is what one task sorted: no key of this join is hot.
    own = placed.join(spans.drop("rows"), ["conv_id", "part"])
    own = own.withColumn("position", F.expr("place - first + before + 1")).select("conv_id", "position", "token", "head", "taken")
    starts = own.where((F.col("position") < heads) & (F.col("conv_id") == base))
    starts = starts.select(F.col("conv_id").alias("base"), F.col("position").alias("depth"), "token")
    lent = convs.where("taken > 0").join(starts, "base").where("depth <= taken").select("conv_id", "depth", "token")
    kept = own.where("position > head").select("conv_id", F.expr("position - head + taken AS depth"), "token")
    return convs, lent.unionByName(kept)


def _blocks(rows: DataFrame, at: str, token: Column, block: int) -> DataFrame:
    """``(conv_id, place, tokens)``: runs of ``block`` tokens."""
    place = F.expr(f"{at} div {block}").alias("place")
    run = F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), token.alias("token"))))
    return rows.groupBy("conv_id", place).agg(run.alias("run")).select("conv_id", "place", F.col("run.token").alias("tokens"))


def _tiers(work: Scratch, rebuilt: DataFrame, block: int) -> list[DataFrame]:
    """Blocks of turns, blocks of blocks, and so on, until a conversation is one."""
    tiers = [work.write(_blocks(rebuilt.withColumn("at", F.col("depth") - 1), "at", F.col("token"), block), "blocks")]
    while (tiers[-1].agg(F.max("place")).first()[0] or 0) > 0:
        below = tiers[-1].withColumnRenamed("place", "at")
        tiers.append(work.write(_blocks(below, "at", _digest("tokens"), block), "blocks"))
    return tiers


class _Tier:
    """The trie of one tier: its pieces at every size, the smallest being its nodes."""

    def __init__(self, work: Scratch, whole: DataFrame, size: int, above: _Tier | None = None):
        self.work, self.size, self.above = work, size, above
        self.pieces = {size: whole}
        while size > 1:
            self.pieces[size // 2] = work.write(self._halved(self.pieces[size], size // 2), f"pieces{size // 2}")
            size //= 2
        self.nodes = self.pieces[1]

    @staticmethod
    def _halved(pieces: DataFrame, half: int) -> DataFrame:
        """Upper halves, merged by name, and lower halves under the names of their cuts."""
        cut = F.size("tokens") > half
        upper = F.slice("tokens", 1, half)
        named = pieces.withColumns({"name": _digest("root", upper), "cut": cut})
        merged = named.groupBy("name").agg(
            *(F.any_value(c).alias(c) for c in ("at", "root")),
            F.any_value(upper).alias("tokens"),
            F.min("conv_id").alias("conv_id"),
            F.sum("members").alias("members"),
            F.max(F.when(~F.col("cut"), F.col("done"))).alias("done"),
            F.bool_or("cut").alias("cut"),
        )
        merged = merged.withColumn("end", F.when(F.size("tokens") == half, F.col("name"))).drop("name")
        lower = named.where("cut").select(
            (F.col("at") + half).alias("at"),
            F.col("name").alias("root"),
            F.slice("tokens", half + 1, half).alias("tokens"),
            "conv_id",
            "members",
            "done",
            F.lit(False).alias("cut"),
            "end",
        )
        return merged.unionByName(lower)

    def grafted(self, own: DataFrame) -> DataFrame:
        """``(name, leaves, saved)`` summed over every node's subtree.

        ``own`` is ``(name, root, at, leaves, saved)`` of this tier's nodes. What
        hangs below a block is summed up by the tier above, whose nodes are blocks.
        """
        sums = [F.sum(c).alias(c) for c in ("leaves", "saved")]
        direct = self.work.write(own.groupBy("root", "at").agg(*sums), "direct")
        passed, shares = [direct], [own.select("name", "leaves", "saved")]

        def totals(step: int, at: int) -> DataFrame:
            """Of the trees of that many turns whose roots stand there."""
            rows = reduce(DataFrame.unionByName, (p.select("root", "at", "leaves", "saved") for p in passed))
            return rows.where(F.col("at") % step == at).groupBy(F.col("root").alias("end")).agg(*sums)

        half = 1
        while half < self.size:
            cuts = self.pieces[half].where("cut").select("root", "at", "tokens", "end")
            graft = self.work.write(cuts.join(totals(2 * half, half), "end"), f"grafts{half}")
            passed.append(graft)
            shares.append(graft.select(F.explode(_path()).alias("name"), "leaves", "saved"))
            half *= 2
        if self.above is not None:
            hanging = self.above.nodes.select("end", "root", "at").join(totals(self.size, 0), "end", "left")
            hanging = hanging.select(
                F.col("end").alias("name"), "root", "at", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("leaves", "saved"))
            )
            below = self.above.grafted(self.work.write(hanging, "hanging"))
            full = self.pieces[self.size].where("end IS NOT NULL").select("root", "tokens", "end")
            graft = full.join(below.withColumnRenamed("name", "end"), "end").where("leaves > 0 OR saved > 0")
            shares.append(graft.select(F.explode(_path()).alias("name"), "leaves", "saved"))
        found = reduce(DataFrame.unionByName, shares).groupBy("name").agg(*sums)
        return self.work.write(found, "totals")


def _lists(rows: int):
    """Runs of members of one sequence, in order, as texts of bounded length."""

    def run(batches):
        schema = pa.schema([("done", pa.string()), ("first", pa.int64()), ("list", pa.string())])
        done, ids = None, []

        def finished():
            return {"done": done, "first": ids[0], "list": ",".join(map(str, ids))}

        for batch in batches:
            out = []
            for key, conv_id in zip(batch["done"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
                if key != done or len(ids) == rows:
                    if ids:
                        out.append(finished())
                    done, ids = key, []
                ids.append(conv_id)
            yield pa.RecordBatch.from_pylist(out, schema)
        if ids:
            yield pa.RecordBatch.from_pylist([finished()], schema)

    return run


def _list_hashes(batches):
    """SHA-256 of the joined lists of each sequence, taken up one after another."""
    schema = pa.schema([("done", pa.string()), ("ends_sha256", pa.string())])
    done = digest = None
    for batch in batches:
        out = []
        for key, text in zip(batch["done"].to_pylist(), batch["list"].to_pylist(), strict=True):
            if key != done:
                if digest is not None:
                    out.append({"done": done, "ends_sha256": digest.hexdigest()})
                done, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        yield pa.RecordBatch.from_pylist(out, schema)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"done": done, "ends_sha256": digest.hexdigest()}], schema)


def _ends(members: DataFrame, rows: int) -> DataFrame:
    """``(done, ends_sha256)`` of every complete sequence.

    The hash has to see a sequence's members one after another, but that task
    is handed them in lists of ``rows``, put together in parallel.
    """
    order = ["done", "conv_id"]
    ranged = members.repartitionByRange(*order).sortWithinPartitions(*order)
    lists = ranged.mapInArrow(_lists(rows), "done string, first bigint, list string")
    together = lists.repartition("done").sortWithinPartitions("done", "first")
    return together.mapInArrow(_list_hashes, "done string, ends_sha256 string")


def prefix_trie(
    turns: DataFrame, group: int = 20, heads: int = 4, block: int = BLOCK, list_rows: int = LIST_ROWS
) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Also ``name``, the node's digest. ``turns`` has ``conv_id, turn, role, text``;
    conversations are rebuilt as the first ``crc32(conv_id) % heads`` turns of the first of
    their ``group`` identifiers and their own turns behind as many; ``heads=1``
    leaves them as they are. ``block``, a power of two, bounds the turns in one row.
    """
    if block < 2 or block & (block - 1):
        raise ValueError("block must be a power of two and at least 2")
    work = Scratch(turns.sparkSession, "prefix-trie")
    convs, rebuilt = _rebuilt(work, turns, group, heads)
    blocks = _tiers(work, rebuilt, block)

    whole = work.write(blocks[-1].select("conv_id", "tokens", _digest("tokens").alias("done")), "sequences")
    turnless = convs.join(whole, "conv_id", "left_anti").select("conv_id", F.lit(ROOT).alias("done"))
    members = work.write(whole.select("conv_id", "done").unionByName(turnless), "members")

    longest = whole.agg(F.max(F.size("tokens"))).first()[0] or 1
    size = 1 << (longest - 1).bit_length()
    distinct = whole.groupBy("done").agg(
        F.any_value("tokens").alias("tokens"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("members")
    )
    top = distinct.select(
        F.lit(0).cast("bigint").alias("at"),
        F.lit(ROOT).alias("root"),
        "tokens",
        "conv_id",
        "members",
        "done",
        F.lit(False).alias("cut"),
        F.when(F.size("tokens") == size, _digest(F.lit(ROOT), "tokens")).alias("end"),
    )
    tier = _Tier(work, work.write(top, "pieces"), size)
    for below in reversed(blocks[:-1]):
        # Every node of a tier is a block of the tier below, under the root that the node has.
        nodes = tier.nodes.drop("tokens", "cut")
        opened = nodes.join(below.withColumnRenamed("place", "at"), ["conv_id", "at"]).select(
            (F.col("at") * block).alias("at"),
            "root",
            "tokens",
            "conv_id",
            "members",
            "done",
            F.lit(False).alias("cut"),
            F.when(F.size("tokens") == block, F.col("end")).alias("end"),
        )
        tier = _Tier(work, work.write(opened, "pieces"), block, tier)

    words = F.split_part(F.get("tokens", F.lit(0)), F.lit(":"), F.lit(2)).cast("bigint")
    found = tier.nodes.select(
        F.col("end").alias("name"), "root", "at", "conv_id", "members", "done", words.alias("words")
    )
    everybody = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("members")).where("members > 0")
    root = everybody.selectExpr(
        f"'{ROOT}' AS name", "CAST(NULL AS STRING) AS root", "-1L AS at", "conv_id", "members", f"'{ROOT}' AS done", "0L AS words"
    )
    children = tier.nodes.groupBy(F.col("root").alias("name")).agg(F.count(F.lit(1)).alias("children"))
    nodes = found.unionByName(root).join(children, "name", "left")
    nodes = nodes.withColumn("children", F.coalesce("children", F.lit(0))).select(
        "*",
        F.when(F.col("children") == 0, 1).otherwise(0).cast("bigint").alias("leaves"),
        ((F.col("members") - 1) * F.col("words")).alias("saved"),
    )
    nodes = work.write(nodes, "nodes")

    below_root = nodes.where("root IS NOT NULL").select("name", "root", "at", "leaves", "saved")
    totals = tier.grafted(below_root)
    rooted = nodes.where("root IS NULL").select("name", "leaves", "saved")
    firsts = nodes.where("at = 0").select("name").join(totals, "name")
    rooted = rooted.unionByName(firsts.select(F.lit(ROOT).alias("name"), "leaves", "saved"))
    rooted = rooted.groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    sums = totals.unionByName(rooted).toDF("name", "n_leaves", "saved_tokens")

    parents = nodes.select(F.col("name").alias("root"), F.col("conv_id").alias("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        nodes.drop("leaves", "saved")
        .join(sums, "name")
        .join(parents, "root", "left")
        .join(_ends(members, list_rows), "done", "left")
        .select(
            "conv_id",
            (F.col("at") + 1).alias("depth"),
            "parent_conv_id",
            F.col("members").alias("n_convs"),
            F.col("children").alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
            "name",
        )
    )
