"""Tables written between the steps of a mining run."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest table, in bytes measured when it was written, that a mining step may broadcast.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
# Rows of a larger table that are broadcast apart, because they meet a large share of the other side.
HOT_ROWS = 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    A cluster must have it set: a folder of the driver's machine would lose what
    executors write. A local session without it gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not is_one_machine(context.master):
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="basketlore-"))
    return context.getCheckpointDir()


def is_one_machine(master: str) -> bool:
    """True if driver and executors are one process: ``local`` or ``local[...]``."""
    return master == "local" or master.startswith("local[")


@dataclass(frozen=True)
class Table:
    """A written table, its exact row count and the bytes of its values."""

    df: DataFrame
    rows: int
    bytes: int

    def view(self, df: DataFrame) -> Table:
        """Columns of this table, which are no larger than it."""
        return Table(df, self.rows, self.bytes)


def row_bytes(schema: T.StructType) -> Column:
    """Bytes of a row's values, with 16 more for each text, array and row."""

    def width(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.coalesce(F.octet_length(column), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            element = kind.elementType
            if isinstance(element, T.StringType):
                inner = F.octet_length(F.array_join(column, "")) + 16 * F.size(column)
            elif isinstance(element, T.StructType):
                inner = F.size(column) * (16 + 8 * len(element))
            else:
                inner = 8 * F.size(column)
            return F.coalesce(inner, F.lit(0)) + 16
        return F.lit(8)

    return reduce(Column.__add__, (width(F.col(f.name), f.dataType) for f in schema), F.lit(16)).cast("bigint")


class Workspace:
    """A folder of Parquet tables for one mining run.

    Writing a table ends its lineage: a lost executor costs a re-read, never a
    re-run of the levels before it, and row identifiers stay what they were.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write(self, df: DataFrame, name: str) -> Table:
        seen = Observation()
        path = self.path(name)
        # The count sits on the final stage, whose tasks are counted once each.
        figures = (F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(df.schema)).alias("bytes"))
        df.observe(seen, *figures).write.parquet(path)
        self.names.append(name)
        found = seen.get
        return Table(self.spark.read.schema(df.schema).parquet(path), found["rows"], found["bytes"] or 0)

    def remove(self, prefix: str = "") -> None:
        """Delete the tables of that prefix, which nothing reads any more."""
        for name in [n for n in self.names if n.startswith(prefix)]:
            self._delete(self.path(name))
            self.names.remove(name)

    def clear(self) -> None:
        """Delete the folder, with whatever a failed write left there."""
        self._delete(self.folder)
        self.names.clear()

    def _delete(self, path: str) -> None:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(found, True)


def fits_broadcast(table: Table) -> bool:
    return table.bytes <= BROADCAST_LIMIT_BYTES


def broadcast_within(table: Table) -> DataFrame:
    """The table, marked for broadcast if it was measured to fit."""
    return F.broadcast(table.df) if fits_broadcast(table) else table.df


def for_join(table: Table) -> DataFrame:
    """The table, marked for broadcast if it was measured to fit, else for a join that sorts and spills.

    Adaptive execution splits the partitions of a key that is hot on the other side.
    """
    return F.broadcast(table.df) if fits_broadcast(table) else table.df.hint("merge")


def join_hot_apart(left: DataFrame, right: Table, keys: list[str], matches: str) -> DataFrame:
    """Join with a table of any size whose column ``matches`` tells how many rows of ``left`` each row meets.

    The rows of ``right`` that meet more than one in ``HOT_ROWS`` of all matches,
    at most ``HOT_ROWS`` of them, are broadcast; the others are joined by a shuffle,
    none of whose keys is hot.
    """
    if fits_broadcast(right):
        return left.join(F.broadcast(right.df.drop(matches)), keys)
    total = right.df.agg(F.sum(matches)).first()[0] or 0
    hot = F.col(matches) > total / HOT_ROWS
    few = F.broadcast(right.df.where(hot).drop(matches))
    many = right.df.where(~hot).drop(matches).hint("merge")
    return left.join(few, keys).unionByName(left.join(many, keys))
