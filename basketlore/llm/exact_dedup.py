"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one stable id.

The texts are grouped by (hash, text): equal hashes put rows side by side, the
text itself decides. Copies meet first inside each task, so a text that fills a
third of the rows crosses the network once per task. Only groups of two and more
are kept for the second step, which hands every row its group; that join carries
no text, and its hot keys are split by adaptive execution.

Null texts count as empty. Rows repeated with the kept id are all marked as kept
in ``mark_copies``; ``drop_copies`` leaves one of them. A group in which every id
is null keeps its rows, with a null ``keep_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlore.llm.shared import Scratch, text_of


def content_hash(text: Column) -> Column:
    """128 bits of the content."""
    return F.unhex(F.md5(text))


def _groups(work: Scratch, docs: DataFrame, keep: str, hash_of) -> tuple[DataFrame, bool]:
    """Groups of two and more rows with one text, and whether two texts share a hash."""
    pick = F.min if keep == "smallest" else F.max
    texts = (
        docs.select(F.col("doc_id"), text_of().alias("text"))
        .groupBy(hash_of(F.col("text")).alias("hash"), "text")
        .agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    # Only hashes and counts are exchanged for this.
    per_hash = texts.groupBy("hash").agg(
        F.count(F.lit(1)).alias("texts"),
        F.max("keep_id").alias("keep_id"),
        F.sum("group_size").alias("group_size"),
    )
    found = work.write(per_hash.where("texts > 1 OR group_size > 1"), "groups")
    collided = found.where("texts > 1")
    if collided.isEmpty():
        return found, False
    # Equal hashes of different texts: here the text stays part of the key.
    shared = texts.join(collided.select("hash"), "hash", "left_semi")
    exact = shared.select("hash", F.col("text").alias("bytes"), "keep_id", "group_size")
    single = found.where("texts = 1").select("hash", F.lit(None).cast("string").alias("bytes"), "keep_id", "group_size")
    return work.write(exact.unionByName(single), "groups"), True


def mark_copies(
    docs: DataFrame, keep: str = "smallest", carry: Column | None = None, hash_of=content_hash
) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size`` and ``kept``.

    ``keep`` is "smallest" or "largest": which id of a group stays. ``carry`` is
    returned as ``row``; by default it is a struct of all columns.
    """
    work = Scratch(docs.sparkSession, "exact-dedup")
    groups, collided = _groups(work, docs, keep, hash_of)
    rows = docs.select(
        F.col("doc_id"),
        hash_of(text_of()).alias("hash"),
        (F.struct("*") if carry is None else carry).alias("row"),
        *([text_of().alias("bytes")] if collided else []),
    )
    same = F.col("d.hash") == F.col("g.hash")
    if collided:
        same = same & (F.col("g.bytes").isNull() | (F.col("g.bytes") == F.col("d.bytes")))
    in_group = F.col("g.hash").isNotNull()
    return rows.alias("d").join(groups.alias("g"), same, "left").select(
        F.col("d.row").alias("row"),
        F.col("d.doc_id").alias("doc_id"),
        F.when(in_group, F.col("g.keep_id")).otherwise(F.col("d.doc_id")).alias("keep_id"),
        F.coalesce(F.col("g.group_size"), F.lit(1)).alias("group_size"),
        (~in_group | F.col("g.keep_id").eqNullSafe(F.col("d.doc_id"))).alias("kept"),
    )


def drop_copies(docs: DataFrame, keep: str = "smallest", hash_of=content_hash) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns.

    Of rows that repeat both the text and the kept id one stays, whichever it is.
    """
    marked = mark_copies(docs, keep, hash_of=hash_of).where("kept")
    single = marked.where("group_size = 1").select("row.*")
    # A group's kept rows are one, unless its winning row is itself repeated.
    text = text_of("row.text")
    several = marked.where("group_size > 1").withColumn("key", F.struct(F.col("doc_id"), text.alias("text")))
    return single.unionByName(several.dropDuplicates(["key"]).select("row.*"))


def exact_dedup(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row for each row of ``docs``."""
    marked = mark_copies(docs, keep, F.sha2(text_of(), 256))
    return marked.select("doc_id", "keep_id", "group_size", "kept", F.col("row").alias("text_sha256"))
