"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlore.operators.prep import basket_count


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_document(df: DataFrame, path: str) -> None:
    """Write a one-row frame as a folder with one JSON file."""
    write_json(df.coalesce(1), path)


def write_csv(df: DataFrame, path: str) -> bool:
    """Write with a header. Nothing is written, and False returned, if there are no rows.

    Quotes inside fields are doubled, as ``read_lines`` and most other readers expect.
    """
    if df.isEmpty():
        return False
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)
    return True


def run_config(
    items: DataFrame,
    cores: int,
    partitions: int,
    supports: list[float],
    input_dataset: str | None = None,
) -> DataFrame:
    """One row that records how a run over ``items`` was set up."""
    return items.agg(basket_count().alias("total_baskets")).select(
        F.lit(cores).alias("cores"),
        F.lit(partitions).alias("partitions"),
        F.array(*(F.lit(float(s)) for s in supports)).alias("supports"),
        "total_baskets",
        F.lit(input_dataset).cast("string").alias("input_dataset"),
    )
