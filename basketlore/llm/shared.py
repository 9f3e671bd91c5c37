"""What the operators share: a folder all executors see, and tables in it."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
# While tables are written: shuffle files of a finished write are of no use, its table is what is read;
# and texts may be long, so few of them go to Python at a time.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session without it gets a folder, set for later calls."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="basketlore-")
        context.setCheckpointDir(found)
    return found


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, for functions that run in Python there; once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="basketlore-"), "basketlore_package")
    context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
    _SHIPPED.add(context.applicationId)


@contextmanager
def write_settings(spark: SparkSession):
    before = {key: spark.conf.get(key, None) for key in _SETTINGS}
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


class Scratch:
    """Tables of one run in a folder of its own under the checkpoint folder.

    They end the lineage: what is read from them does not change when an
    executor is lost. ``drop`` removes those that no result reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark = spark
        self.root = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._made = 0

    def path(self, name: str) -> str:
        self._made += 1
        return f"{self.root}/{self._made}-{name}"

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = self.path(name)
        with write_settings(self.spark):
            df.write.parquet(path, partitionBy=partition_by)
        found = self.spark.read.schema(df.schema).parquet(path)
        found._scratch_path = path
        return found

    @staticmethod
    def same_table(view: DataFrame, table: DataFrame) -> DataFrame:
        """Mark ``view`` as read from the table's files, so that it can be dropped."""
        view._scratch_path = table._scratch_path
        return view

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))
