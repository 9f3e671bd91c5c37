"""Document fingerprints from closed syncmers.

A window of k code points is a closed syncmer if the smallest hash among its
inner substrings of s code points stands at the window's first or last place.
Whether a window is chosen depends on its own content alone, so an edit moves
nothing but the windows it touches, and chosen windows are anchors: their order
and distances can be compared between documents.

A fingerprint keeps every anchor of the text, repeated ones too, in order of
position: its 64-bit hash and where it stands, as fixed-width hexadecimal. Two
fingerprints are compared by alignment: the longest sequence of anchors that
stands in both in the same order. Likeness is the length of that sequence as a
share of all anchors of both, those of the sequence counted once; it is exact,
whatever the lengths. ``positional_matches`` gives the alignment's pairs of
positions.

Texts without a syncmer (those shorter than a window, and some of up to 38 code
points) have one anchor, the whole text. Only empty and null texts have none; two fingerprints without anchors are alike (1), one without and
one with are not (0).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlore.llm.shared import ship_package, text_of

INNER = 8
WINDOW = 24
# Code points that one pass over a batch handles together.
PASS_CHARS = 1 << 20
# Characters of fingerprints that are handed over together.
BATCH_CHARS = 1 << 24

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(h):
    """Spread a polynomial hash over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _powers(n):
    return [np.uint64(pow(int(_BASE), i, 1 << 64)) for i in range(n)]


_POWER = _powers(WINDOW + 1)


def _rolling(codes):
    """Polynomial hashes of all substrings of INNER and of WINDOW code points, by doubling."""
    h = codes.astype(np.uint64) + np.uint64(1)
    width = 1
    while width < INNER:
        h = h[:-width] * _POWER[width] + h[width:]
        width *= 2
    inner, window = h, h
    while width < WINDOW:
        window = window[:-INNER] * _POWER[INNER] + inner[inner.size - window.size + INNER :][: window.size - INNER]
        width += INNER
    return inner, window


def _least(values, width):
    """Minimum of each window of so many values."""
    low, have = values, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def syncmers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the text's closed syncmers."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if codes.size < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places, hashes = [], []
    for start in range(0, codes.size - WINDOW + 1, PASS_CHARS):
        inner, window = _rolling(codes[start : start + PASS_CHARS + WINDOW - 1])
        inner = _mixed(inner)
        span = WINDOW - INNER
        low = _least(inner, span + 1)
        at = np.flatnonzero((low == inner[: low.size]) | (low == inner[span : span + low.size]))
        places.append(at + start)
        hashes.append(_mixed(window[at]))
    return np.concatenate(places), np.concatenate(hashes)


_ANCHOR = np.dtype([("hash", ">u8"), ("place", ">u4")])


def sketch(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all anchors in order of position, and where they stand."""
    places, hashes = syncmers(text)
    if text and not hashes.size:
        whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        return np.array([int.from_bytes(whole, "big")], np.uint64), np.zeros(1, np.int64)
    return hashes, places


def to_text(found: tuple[np.ndarray, np.ndarray]) -> str:
    """Twenty-four hexadecimal digits an anchor: hash, then position."""
    anchors = np.empty(found[0].size, _ANCHOR)
    anchors["hash"], anchors["place"] = found
    return anchors.tobytes().hex()


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    anchors = np.frombuffer(bytes.fromhex(fingerprint), _ANCHOR)
    return anchors["hash"].astype(np.uint64), anchors["place"].astype(np.int64)


def _ends(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Anchors in common at the start, and at the end of what is left."""
    n = min(a.size, b.size)
    differ = a[:n] != b[:n]
    start = int(differ.argmax()) if differ.any() else n
    n -= start
    differ = a[a.size - n :][::-1] != b[b.size - n :][::-1]
    return start, int(differ.argmax()) if differ.any() else n


def _rows(a: np.ndarray, b: np.ndarray):
    """Bit-parallel longest common subsequence: after each anchor of ``b``, a zero for each step over ``a``."""
    masks = {}
    for i, h in enumerate(a.tolist()):
        masks[h] = masks.get(h, 0) | 1 << i
    full = (1 << a.size) - 1
    row = full
    for h in b.tolist():
        on = row & masks[h]
        row = (row + on | row - on) & full
        yield row


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in either array of what stands in both."""
    return np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest sequence of anchors that stands in both in the same order."""
    start, end = _ends(a, b)
    a, b = a[start : a.size - end], b[start : b.size - end]
    i, j = _shared(a, b)
    row = (1 << i.size) - 1
    for row in _rows(a[i], b[j]):
        pass
    return start + end + i.size - row.bit_count()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Aligned anchors as a share of all anchors of both, aligned ones counted once."""
    if not a.size and not b.size:
        return 1.0
    common = aligned(a, b)
    return common / (a.size + b.size - common)


def positional_matches(left: str, right: str) -> list[tuple[int, int]]:
    """Positions of the aligned anchors of two fingerprints, by position in the left text."""
    (a, at), (b, bt) = from_text(left), from_text(right)
    start, end = _ends(a, b)
    i, j = _shared(a[start : a.size - end], b[start : b.size - end])
    i, j = i + start, j + start
    rows = [(1 << i.size) - 1, *_rows(a[i], b[j])]
    pairs, x, y = [], i.size, j.size
    while x and y:
        # Without a step at x in this row, the anchor at x adds nothing; with one in the row before too, that at y does not.
        if rows[y] >> (x - 1) & 1:
            x -= 1
        elif not rows[y - 1] >> (x - 1) & 1:
            y -= 1
        else:
            x, y = x - 1, y - 1
            pairs.append((i[x], j[y]))
    pairs += [(k, k) for k in range(start)] + [(a.size - 1 - k, b.size - 1 - k) for k in range(end)]
    return sorted((int(at[x]), int(bt[y])) for x, y in pairs)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)``, one row for each row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def rows_of(batch):
        for doc_id, value in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            yield {"doc_id": doc_id, "fingerprint": to_text(sketch(value.as_py()))}

    def run(batches):
        for batch in batches:
            yield from _handed_over(rows_of(batch), schema)

    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fingerprint string")


def _handed_over(rows, schema):
    """Batches of rows, bounded by the size of their fingerprints."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row["fingerprint"]) + len(row.get("edited_fingerprint", ""))
        if size >= BATCH_CHARS:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


# The edited text takes its end from the next document


_RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compared(doc_id, text, own, following, following_sketch):
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    edited_sketch = sketch(edited)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
        "fingerprint": to_text(own),
        "edited_fingerprint": to_text(edited_sketch),
        "near_edited": likeness(own[0], edited_sketch[0]),
        "near_next": likeness(own[0], following_sketch[0]),
    }


def _neighbours():
    """Compare each row of a sorted range with the next; the range's last meets the first of the next range."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_chars", pa.int64()),
            ("edited_sha256", pa.string()),
            ("fingerprint", pa.string()),
            ("edited_fingerprint", pa.string()),
            ("near_edited", pa.float64()),
            ("near_next", pa.float64()),
        ]
    )

    def compared(batches):
        before, ended = None, False
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("doc_id", "guest"))
            for doc_id, guest, value in zip(*columns, batch["text"], strict=True):
                if ended:
                    break
                text = value.as_py()
                own = sketch(text)
                if before is not None:
                    yield _compared(*before, text, own)
                before, ended = (doc_id, text, own), guest

    def run(batches):
        yield from _handed_over(compared(batches), schema)

    return run


def _range_of(bounds):
    """Number of the range, counted from the largest id; null ids are in the last one."""
    ascending = np.array(sorted(set(bounds)), np.int64)

    @F.pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        values = ids.where(known, 0).astype("int64").to_numpy()
        below = ascending.size - np.searchsorted(ascending, values, side="right")
        return pd.Series(np.where(known, below, ascending.size + 1).astype(np.int32))

    return number, ascending.size + 2


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and how alike they are.

    The edited text replaces the last half of the code points by the first as
    many of the next document, by descending doc_id; after the last comes the
    first. Null ids come last, repeated ids by content.

    The rows are dealt by range of id, each range to one task. The first document
    of a range also visits the range before it. Of the ids, the driver sees the
    bounds and the first of each range.
    """
    spark = docs.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    steps = [i / parts for i in range(1, parts)] or [0.5]
    bounds = rows.agg(F.percentile_approx("doc_id", steps, 100 * parts).alias("b")).first()["b"] or []
    number, parts = _range_of(bounds)
    ranged = rows.withColumn("part", number("doc_id"))
    # By descending id, then ascending tie: the complement of the tie turns its order around.
    firsts = (
        ranged.groupBy("part")
        .agg(F.max(F.struct("doc_id", F.bitwise_not("tie").alias("tie"))).alias("first"))
        .orderBy("part")
        .select("part", "first.doc_id", F.bitwise_not(F.col("first.tie")).alias("tie"))
        .collect()
    )
    visits = [(r["doc_id"], r["tie"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)]
    hosts = spark.createDataFrame(visits, "first_id bigint, first_tie bigint, host int")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    guests = ranged.join(F.broadcast(hosts), is_first).select("doc_id", "tie", "text", F.col("host").alias("part"), F.lit(True).alias("guest"))
    dealt = ranged.withColumn("guest", F.lit(False)).unionByName(guests).repartitionById(parts, F.col("part"))
    ordered = dealt.sortWithinPartitions("guest", F.col("doc_id").desc_nulls_last(), "tie", "text")
    return ordered.select("doc_id", "guest", "text").mapInArrow(_neighbours(), _RESULT)
