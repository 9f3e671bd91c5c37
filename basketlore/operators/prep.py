"""From raw sales lines to baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEXT_COLUMNS = ("InvoiceNo", "StockCode", "Description", "CustomerID")
REQUIRED_COLUMNS = ("InvoiceNo", "StockCode", "Description", "Quantity")
MISSING_TEXT = "nan"


def require_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(MISSING_TEXT))


def basket_count(key: str = "basket_id") -> Column:
    """Number of baskets, everywhere in the package; the lines without a key are one basket."""
    return F.count_distinct(key) + F.coalesce(F.max(F.col(key).isNull().cast("int")), F.lit(0))


def is_cancelled() -> Column:
    """Invoice numbers starting with C or c; a missing number is not cancelled."""
    number = F.col("InvoiceNo").cast("string")
    return number.isNotNull() & (number.startswith("C") | number.startswith("c"))


def has_quantity() -> Column:
    """True above zero; NaN, which Spark sorts above every number, is not."""
    return (F.col("Quantity") > 0) & ~F.isnan(F.col("Quantity").cast("double"))


def is_described() -> Column:
    text = F.col("Description").cast("string")
    return text.isNotNull() & (text != MISSING_TEXT)


def is_valid_line() -> Column:
    return ~is_cancelled() & F.coalesce(has_quantity(), F.lit(False)) & is_described()


def drop_cancelled(df: DataFrame) -> DataFrame:
    return df.where(~is_cancelled())


def keep_positive_quantity(df: DataFrame) -> DataFrame:
    return df.where(has_quantity())


def clean_lines(df: DataFrame) -> DataFrame:
    """Valid sales lines, with the key columns as text."""
    require_columns(df)
    texts = {c: _text(c) for c in TEXT_COLUMNS if c in df.columns}
    return drop_cancelled(keep_positive_quantity(df)).where(is_described()).withColumns(texts)


def invoice_item_qty(
    df: DataFrame, basket_col: str = "InvoiceNo", item_col: str = "StockCode", qty_col: str = "Quantity"
) -> DataFrame:
    """Summed quantity per basket and item: ``(basket_id, item, qty)``."""
    return df.groupBy(F.col(basket_col).alias("basket_id"), F.col(item_col).alias("item")).agg(
        F.sum(F.col(qty_col).cast("double")).alias("qty")
    )


def basket_items(
    df: DataFrame,
    basket_col: str = "InvoiceNo",
    item_col: str = "StockCode",
    qty_col: str | None = "Quantity",
    min_items: int = 2,
    partitions: int | None = None,
) -> DataFrame:
    """Long-form baskets ``(basket_id, item, qty)`` with at least ``min_items`` items.

    The pre-aggregation shuffles on (basket, item), so a basket holding a large
    share of all lines is spread over the tasks and reaches the second shuffle
    as one row per distinct item. With ``partitions``, a number that follows the size of
    the input, both shuffles have so many: a task's memory is bounded however many
    lines there are, and what made ``df`` has tasks of its own.
    """
    if partitions:
        df = df.repartition(partitions, basket_col, item_col)
    if qty_col is None:
        long = df.groupBy(F.col(basket_col).alias("basket_id"), F.col(item_col).alias("item")).agg(
            F.lit(1.0).alias("qty")
        )
    else:
        long = invoice_item_qty(df, basket_col, item_col, qty_col)
    if min_items <= 1:
        return _marked_unique(long)
    if partitions:
        long = long.repartition(partitions, "basket_id")
    size = F.count(F.lit(1)).over(Window.partitionBy("basket_id"))
    found = long.withColumn("basket_size", size).where(F.col("basket_size") >= min_items).drop("basket_size")
    return _marked_unique(found)


def _marked_unique(df: DataFrame) -> DataFrame:
    """Note on the frame that no basket holds an item twice, which saves the miners a shuffle."""
    df._one_row_per_item = True
    return df


def unique_lines(items: DataFrame) -> DataFrame:
    """Long-form baskets with one row per basket and item, quantities summed; without quantities they are 1.

    Frames straight from ``basket_items`` and ``explode_baskets`` are so already.
    """
    if items.__dict__.get("_one_row_per_item"):
        return items
    qty = F.sum(F.col("qty").cast("double")) if "qty" in items.columns else F.lit(1.0)
    return _marked_unique(items.groupBy("basket_id", "item").agg(qty.alias("qty")))


def explode_baskets(df: DataFrame, items_col: str = "items", basket_col: str | None = None) -> DataFrame:
    """Long form of a table with one item array per row.

    A row with an empty array stays as one line without an item, because it
    counts as a basket. A row with no array at all is not a basket. Without
    ``basket_col`` rows are numbered by their place in the input, which is only
    fixed for a table read from files.
    """
    key = F.col(basket_col) if basket_col else F.monotonically_increasing_id()
    found = (
        df.where(F.col(items_col).isNotNull())
        .select(key.alias("basket_id"), F.array_distinct(items_col).alias("items"))
        .select("basket_id", F.explode_outer("items").alias("item"))
        .withColumn("qty", F.lit(1.0))
    )
    # A basket column may repeat; numbered rows are baskets of their own.
    return found if basket_col else _marked_unique(found)


def basket_sets(items: DataFrame) -> DataFrame:
    """One sorted item array per basket."""
    return items.groupBy("basket_id").agg(F.sort_array(F.collect_set("item")).alias("items"))


def basket_quantities(items: DataFrame) -> DataFrame:
    """One row per basket with the parallel arrays ``items`` and ``quantities``."""
    pairs = F.sort_array(F.collect_list(F.struct("item", "qty")))
    return (
        items.groupBy("basket_id")
        .agg(pairs.alias("pairs"))
        .select("basket_id", F.col("pairs.item").alias("items"), F.col("pairs.qty").alias("quantities"))
    )


def basket_quantity_map(items: DataFrame) -> DataFrame:
    """One row per basket with an item-to-quantity map."""
    pairs = F.sort_array(F.collect_list(F.struct("item", F.col("qty").cast("double").alias("qty"))))
    return items.groupBy("basket_id").agg(F.map_from_entries(pairs).alias("quantities"))


def basket_chunk(num_chunks: int, key: str = "basket_id", key_type: str = "bigint") -> Column:
    """Chunk of a basket: a fixed function of its key, so a rerun gives the same chunks; 0 without a key."""
    whole = ("tinyint", "smallint", "int", "bigint")
    hashed = F.coalesce(F.col(key), F.lit(0)) if key_type in whole else F.xxhash64(key)
    return F.pmod(hashed, F.lit(num_chunks)).cast("int")


def item_dictionary(lines: DataFrame, item_col: str = "StockCode", text_col: str = "Description") -> DataFrame:
    """One description per item: the smallest, so that reruns agree."""
    return lines.groupBy(F.col(item_col).alias("item")).agg(F.min(text_col).alias("description"))


def prep_counts(lines: DataFrame, items: DataFrame) -> DataFrame:
    """One row: raw lines, valid lines and multi-item baskets."""
    raw = lines.agg(
        F.count(F.lit(1)).alias("raw_records"),
        F.count_if(is_valid_line()).alias("valid_records"),
    )
    baskets = items.agg(basket_count().alias("baskets"))
    names = ("raw_records", "valid_records", "baskets")
    return raw.unionByName(baskets, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in names))
