"""Byte-level BPE: overlapping chunks, stitched where their pre-token boundaries agree.

A text longer than a chunk is cut into chunks that run on into their right
neighbour. Every chunk is pre-tokenised on its own, anywhere in the cluster.
What stands at the chunk's start may be split wrongly, but splitting depends on
the following text only: from the first boundary that a chunk and its right
neighbour share inside their overlap, both go on alike. There they are stitched;
the pieces between two such places are encoded in parallel, each pre-token by
itself. If an overlap holds no shared boundary (a run of one character class
longer than the overlap), the rest of that text is split again as a stream.

Equal long texts are encoded once. Token ids are gathered in order of the pieces
as a stream. A worker holds one text and, where ids are asked for, its ids as numbers.
A pre-token of more than a chunk is merged by itself. Decoding concatenates
the bytes of the ids. Null texts count as empty; repeated rows are each returned.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlore.llm.shared import Scratch, ship_package, text_of

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 256
# Texts whose results are handed over together, in characters.
BATCH_CHARS = 1 << 20
# The last characters of a cut text may belong to a contraction that goes on behind the cut.
UNSAFE_CHARS = 4

RESULT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=4)
def _codec(ranks_path: str, pattern: str):
    """The encoder, the bytes of each id, and the compiled pattern; once per Python worker."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return encoder, table, regex.compile(pattern)


class _Digest:
    """Counts and hashes ids as they come, and hashes what they decode to."""

    def __init__(self, table, keep_ids):
        self.table, self.count = table, 0
        self.ids, self.decoded = hashlib.sha256(), hashlib.sha256()
        self.kept = [] if keep_ids else None

    def add(self, ids):
        self.count += len(ids)
        numbers = np.asarray(ids, "<u4")
        self.ids.update(numbers.tobytes())
        self.decoded.update(b"".join(map(self.table.__getitem__, ids)))
        if self.kept is not None:
            self.kept.append(numbers.astype("<i4"))

    def result(self):
        found = {
            "n_tokens": self.count,
            "ids_sha256": self.ids.hexdigest(),
            "decoded_sha256": self.decoded.hexdigest(),
        }
        return found if self.kept is None else found | {"ids": np.concatenate([np.empty(0, "<i4"), *self.kept])}


def _schema(fields, keep_ids):
    result = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return pa.schema([*fields, *result, *([("ids", pa.list_(pa.int32()))] if keep_ids else [])])


def _encode_whole(ranks_path, pattern, keep_ids):
    def run(batches):
        encoder, table, _ = _codec(ranks_path, pattern)
        schema = _schema([("doc_id", pa.int64())], keep_ids)
        for batch in batches:
            rows, chars = [], 0
            for doc_id, value in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text = value.as_py()
                digest = _Digest(table, keep_ids)
                digest.add(encoder.encode_ordinary(text))
                rows.append({"doc_id": doc_id} | digest.result())
                chars += len(text)
                if chars > BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, chars = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _encode_long_text(encoder, split, text):
    """Ids of a text of any length, in runs.

    A pre-token too long for the library's pattern engine, such as a run of white space, goes
    to its merging step alone; all others are handed over a chunk at a time.
    """
    start = end = 0
    for match in split.finditer(text):
        if match.end() - start > CHUNK_CHARS:
            yield encoder.encode_ordinary(text[start:end])
            start = end
            if match.end() - start > CHUNK_CHARS:
                yield encoder._encode_single_piece(match.group().encode())
                start = match.end()
        end = match.end()
    yield encoder.encode_ordinary(text[start:end])


def _cut(chunk, overlap):
    def run(batches):
        schema = pa.schema(
            [("key", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()), ("text", pa.string())]
        )
        for batch in batches:
            for key, value in zip(batch["key"].to_pylist(), batch["text"], strict=True):
                text = value.as_py()
                starts = range(0, len(text), chunk)
                for i, start in enumerate(starts):
                    row = {"key": key, "chunk": i, "last": i + 1 == len(starts)}
                    row["text"] = text[start : start + chunk + overlap]
                    yield pa.RecordBatch.from_pylist([row], schema)

    return run


def _pre_tokenise(ranks_path, pattern, chunk, overlap):
    """Add the boundaries at the chunk's start, and those in what it shares with its right neighbour."""

    def run(batches):
        split = _codec(ranks_path, pattern)[2]
        zone = pa.list_(pa.int32())
        for batch in batches:
            left, right = [], []
            for value, last in zip(batch["text"], batch["last"].to_pylist(), strict=True):
                text = value.as_py()
                ends = np.fromiter((m.end() for m in split.finditer(text)), np.int32)
                safe = ends if last else ends[ends <= len(text) - UNSAFE_CHARS]
                left.append(np.append(np.int32(0), safe[safe <= overlap]))
                right.append(safe[safe >= chunk] - chunk)
            columns = [*batch.columns, pa.array(left, zone), pa.array(right, zone)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "left", "right"])

    return run


def _encode_pieces(ranks_path, pattern, chunk):
    """Encode a chunk from its left to its right cut; without cuts pass its own text on."""

    def run(batches):
        encoder = _codec(ranks_path, pattern)[0]
        schema = pa.schema(
            [("key", pa.string()), ("chunk", pa.int64()), ("ids", pa.binary()), ("rest", pa.string())]
        )
        for batch in batches:
            for row in batch.to_pylist():
                text, end = row["text"], len(row["text"]) if row["last"] else None
                if row["cut"] is not None:
                    end = chunk + row["cut"]
                out = {"key": row["key"], "chunk": row["chunk"], "ids": None, "rest": None}
                if row["begin"] is None:
                    out["rest"] = text[:chunk]
                elif end is None:
                    out["rest"] = text[row["begin"] : chunk]
                else:
                    ids = encoder.encode_ordinary(text[row["begin"] : end])
                    out["ids"] = np.asarray(ids, "<u4").tobytes()
                yield pa.RecordBatch.from_pylist([out], schema)

    return run


def _gather(ranks_path, pattern, keep_ids):
    """The pieces of one text come in order; from a missing cut on the text is split as a stream."""

    def run(batches):
        encoder, table, split = _codec(ranks_path, pattern)
        schema = _schema([("key", pa.string())], keep_ids)
        key = digest = None
        rest, tried = "", 0

        def encoded(text):
            for ids in _encode_long_text(encoder, split, text):
                digest.add(ids)

        def finished():
            encoded(rest)
            return pa.RecordBatch.from_pylist([{"key": key} | digest.result()], schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] != key:
                    if digest is not None:
                        yield finished()
                    key, digest, rest, tried = row["key"], _Digest(table, keep_ids), "", 0
                if row["ids"] is not None:
                    digest.add(np.frombuffer(row["ids"], "<u4").tolist())
                    continue
                rest += row["rest"]
                if len(rest) < 2 * tried:
                    # Still inside a run that was looked through before: not again for every chunk.
                    continue
                safe = 0
                for match in split.finditer(rest):
                    if match.end() > len(rest) - UNSAFE_CHARS:
                        break
                    safe = match.end()
                encoded(rest[:safe])
                rest = rest[safe:]
                tried = len(rest)
        if digest is not None:
            yield finished()

    return run


def _encode_long(texts: DataFrame, work, codec, chunk, overlap, keep_ids) -> DataFrame:
    """``(key, results)`` of the distinct long texts in ``(key, text)``."""
    ids = ", ids array<int>" if keep_ids else ""
    chunks = texts.mapInArrow(_cut(chunk, overlap), "key string, chunk bigint, last boolean, text string")
    spread = chunks.groupBy("key", "chunk").agg(F.any_value("last").alias("last"), F.any_value("text").alias("text"))
    zones = "key string, chunk bigint, last boolean, text string, left array<int>, right array<int>"
    split = work.write(spread.mapInArrow(_pre_tokenise(*codec, chunk, overlap), zones), "chunks")

    # The first boundary that a chunk and its right neighbour share.
    here = split.where("NOT last").select("key", "chunk", "right")
    behind = split.where("chunk > 0").select("key", (F.col("chunk") - 1).alias("chunk"), "left")
    shared = F.array_min(F.array_intersect("right", "left"))
    cuts = work.write(here.join(behind, ["key", "chunk"]).select("key", "chunk", shared.alias("cut")), "cuts")
    # Chunks behind a missing cut have no trusted start.
    broken = cuts.where("cut IS NULL").groupBy("key").agg(F.min("chunk").alias("broken"))
    begins = cuts.select("key", (F.col("chunk") + 1).alias("chunk"), F.col("cut").alias("begin"))
    pieces = (
        split.select("key", "chunk", "last", "text")
        .join(cuts, ["key", "chunk"], "left")
        .join(begins, ["key", "chunk"], "left")
        .join(broken, "key", "left")
        .withColumn("begin", F.when(F.col("chunk") == 0, 0).otherwise(F.col("begin")))
        .withColumn("begin", F.when(F.col("broken").isNull() | (F.col("chunk") <= F.col("broken")), F.col("begin")))
        .drop("broken")
        .mapInArrow(_encode_pieces(*codec, chunk), "key string, chunk bigint, ids binary, rest string")
    )
    ordered = pieces.repartition("key").sortWithinPartitions("key", "chunk")
    found = work.write(ordered.mapInArrow(_gather(*codec, keep_ids), f"key string, {RESULT}{ids}"), "long")
    work.drop(split, cuts)
    return found


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    keep_ids: bool = False,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, with ``keep_ids`` also ``ids array<int>``.

    The ranks file must be readable at ``ranks_path`` on every executor. The ids
    are hashed as little-endian unsigned 32-bit integers.
    """
    if not 2 * UNSAFE_CHARS <= overlap <= chunk:
        raise ValueError("The overlap must be at most a chunk, and longer than what a cut may split wrongly")
    work = Scratch(docs.sparkSession, "byte-bpe")
    codec = (ranks_path, pattern)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    ids = ", ids array<int>" if keep_ids else ""
    short = rows.where(F.length("text") <= chunk)
    whole = short.mapInArrow(_encode_whole(*codec, keep_ids), f"doc_id bigint, {RESULT}{ids}")
    long = rows.where(F.length("text") > chunk).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    found = _encode_long(long.select("key", "text"), work, codec, chunk, overlap, keep_ids)
    result = whole.unionByName(long.select("doc_id", "key").join(found, "key").drop("key"))
    # Written here, batches are small whatever the caller's session says.
    return work.write(result, "encoded") if keep_ids else result


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, bytes)`` of ``(doc_id, ids)``: the bytes of all ids, one after another."""

    def run(batches):
        table = _codec(ranks_path, pattern)[1]
        for batch in batches:
            found = [b"".join(map(table.__getitem__, ids.as_py() or ())) for ids in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.binary())], ["doc_id", "bytes"])

    ship_package(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(
        run, "doc_id bigint, bytes binary"
    )
