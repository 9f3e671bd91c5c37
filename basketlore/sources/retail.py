"""Readers of sales lines and baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlore.operators.prep import REQUIRED_COLUMNS, require_columns

OPTIONAL_COLUMNS = ("CustomerID",)
BROKEN = "_broken_record"

# Texts that a CSV reader of the pandas family takes as missing.
MISSING_MARKS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _select_lines(df: DataFrame) -> DataFrame:
    require_columns(df)
    names = [*REQUIRED_COLUMNS, *(c for c in OPTIONAL_COLUMNS if c in df.columns)]
    return df.select(
        *(
            F.col(c).try_cast("double").alias(c) if c == "Quantity" else F.col(c).cast("string").alias(c)
            for c in names
        )
    )


def read_lines(spark: SparkSession, path: str, multi_line: bool = False, strict: bool = True) -> DataFrame:
    """Sales lines from CSV with a header, Parquet or JSON lines, chosen by suffix.

    Other columns of the file are not returned. A quantity that is no number
    becomes null. With ``multi_line`` a quoted CSV field may hold line breaks;
    each file is then read by one task. Without it a file is split among tasks, and a
    record of too few or too many fields, such as the halves of one with a quoted line
    break, is an error when it is read, naming the record; with ``strict=False`` its fields
    are taken as they stand. CSV files of one folder must have the same header; another
    order or other names are an error.
    """
    kind = path.rstrip("/").lower().rsplit(".", 1)[-1]
    if kind == "parquet":
        return _select_lines(spark.read.parquet(path))
    if kind == "json":
        return _select_lines(spark.read.json(path))
    if kind != "csv":
        raise ValueError("Unsupported input format. Use .csv, .parquet or .json")
    options = {"header": True, "escape": '"', "multiLine": multi_line}
    # Without inference only a header is read here; each file's own is then held against it.
    names = spark.read.options(**options).csv(path).schema
    reader = spark.read.options(**options, enforceSchema=False)
    if strict:
        # Fields are only counted where all columns are parsed.
        reader = reader.options(columnPruning=False, columnNameOfCorruptRecord=BROKEN)
        names = names.add(BROKEN, T.StringType())
    raw = reader.schema(names).csv(path)
    require_columns(raw)
    known = [c for c in (*REQUIRED_COLUMNS, *OPTIONAL_COLUMNS) if c in raw.columns]
    texts = {c: F.when(~F.col(c).isin(*MISSING_MARKS), F.col(c)) for c in known}
    if strict:
        broken = F.concat(F.lit("CSV record with a wrong number of fields (a line break inside quotes? see multi_line): "), BROKEN)
        first = known[0]
        texts[first] = F.when(F.col(BROKEN).isNull(), texts[first]).otherwise(F.raise_error(broken))
    return _select_lines(raw.select(*(text.alias(c) for c, text in texts.items())))


def read_baskets(spark: SparkSession, path: str) -> DataFrame:
    """Baskets from Parquet: the array column ``items``, plus whatever else is there."""
    df = spark.read.parquet(path)
    require_columns(df, ("items",))
    if not isinstance(df.schema["items"].dataType, T.ArrayType):
        raise ValueError("Column items must be an array")
    return df
