"""Readers of run-metrics documents."""

from __future__ import annotations

import warnings
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# One document per run. The maps are keyed by the support threshold as text.
METRICS_SCHEMA = """
    apriori map<string, struct<
        total_time: double, total_itemsets: bigint,
        levels: map<string, struct<
            candidates_count: bigint, frequent_count: bigint, execution_time: double>>>>,
    fpgrowth map<string, struct<
        build_time: double, mine_time: double, total_time: double,
        count: bigint, max_length: int>>,
    son map<string, struct<
        num_partitions: int, phase1_time: double, candidates_generated: bigint,
        phase2_time: double, final_frequent_itemsets: bigint, total_time: double>>,
    metadata struct<
        total_baskets: bigint, thresholds: array<double>, spark_master: string,
        spark_application_id: string, num_partitions: int>
"""


def _documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    reader = spark.read.schema(METRICS_SCHEMA).option("multiLine", True)
    return reader.option("pathGlobFilter", "*.json").json(paths)


def read_run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The first JSON document of ``folder``, by file name."""
    files = sorted(_documents(spark, folder).inputFiles())
    if not files:
        raise FileNotFoundError(f"No JSON files found in {folder!r}")
    return _documents(spark, files[0])


def _files(spark: SparkSession, folder: str) -> list[str] | None:
    """JSON files of a folder; None if there is no such folder."""
    try:
        return _documents(spark, folder).inputFiles()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_labeled_run_metrics(
    spark: SparkSession, folders: dict[str, str | list[str]]
) -> DataFrame:
    """All documents of several folders, with the folder's label in ``Cores``.

    A label may list alternative folder names; the first that exists is read.
    Labels without a folder or without documents are skipped with a warning. One scan
    reads all files; a document's label is looked up by the file it came from.
    """
    found, labels = set(), []
    for label, names in folders.items():
        names = [names] if isinstance(names, str) else names
        listed = ((name, _files(spark, name)) for name in names)
        folder, files = next(((n, f) for n, f in listed if f is not None), (None, None))
        if files is None:
            warnings.warn(f"Folder {names[0]!r} not found, skipping {label!r}", stacklevel=2)
        elif not files:
            warnings.warn(f"No JSON files in the folder of {label!r}", stacklevel=2)
        else:
            found.add(folder)
            labels += [(path, label) for path in files]
    if not found:
        raise ValueError("No run metrics found in any of the folders")
    # One row per metrics file, all of them listed above.
    named = spark.createDataFrame(labels, "path string, Cores string").select(_local(F.col("path")).alias("file"), "Cores")
    documents = _documents(spark, sorted(found)).withColumn("file", _local(F.col("_metadata.file_path")))
    return documents.join(F.broadcast(named), "file").drop("file")


def _local(path: Column) -> Column:
    """Listings and scans write the scheme of a local file in different ways."""
    return F.regexp_replace(path, "^file:/+", "/")
