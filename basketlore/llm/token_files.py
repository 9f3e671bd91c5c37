"""Token ids as files: Parquet lists in document order, with an index for selective reads.

Layout of a folder:

    tokens/   one file per part, parts in ascending order of documents. A row is a piece
              of a document: doc_id, row (the document's own number, as ids may repeat),
              piece, last, part, offset (of its first id among the part's) and ids
              (array<int>). Offsets, row numbers and the like are delta-encoded, ids
              dictionary-encoded; row groups and pages are of bounded size and have a
              page index, so a range of documents or positions reads its pages only,
              and metadata is read without the ids.
    parts/    part, first_id (ids in all parts before) and ids: one row per file.

A document longer than ``PIECE_CHARS`` is cut into pieces at white space, so that no
row, page or task grows with a text; a longer run without white space stays whole. Words between white
space are encoded by the library, each distinct word once per worker while it is
remembered: neither normalisation nor pre-tokenisation looks across white space, and
no token contains it.

Documents stand in ascending order of id, null first, equal ids in order of a hash of
their texts; repeated rows are documents of their own. Null and empty texts have the
end id only. An empty table gives files without rows.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from basketlore.llm.shared import Scratch, ship_package, text_of, write_settings

PIECE_CHARS = 1 << 16
# Words a worker remembers with their ids, in bytes, and the longest of them in characters.
REMEMBERED_BYTES, REMEMBERED_CHARS = 16 << 20, 64
# Words for the library's model alone, and how many it gets at once.
PLAIN, PLAIN_WORDS = "^[a-zÀ-ÖØ-öø-ÿ]+$", 1000
# Texts handed to the encoder at once, in characters.
ENCODE_CHARS = 4 << 20
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 64 << 10, 2_000
OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.page.write-checksum.enabled": "true",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "compression": "zstd",
}
SPACE = re.compile(r"[\t\n\r ]")

PIECES = "doc_id bigint, hash bigint, row bigint, piece int, last boolean, text string"
ROWS = "doc_id bigint, row bigint, piece int, last boolean, part int, offset bigint, ids array<int>"


class WordEncoder:
    """Encodes texts word by word, with the library for words not met lately.

    Words of small Latin letters alone are one pre-token that normalisation leaves
    as it is, so the library's model gets them without those steps, many at a time, in the
    byte-level letters of its vocabulary. Words and their ids are held in Arrow arrays, and found and laid
    out by Arrow: only new words become Python strings.
    """

    def __init__(self, path: str):
        self.library, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        mark, vocabulary = self.model.model.end_of_word_suffix, self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if mark and token.endswith(mark)]] = True
        # Without such a mark the whole library encodes all words.
        self.plain = PLAIN if self.ends.any() else "$."
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        table = [chr(byte) for byte in range(256)]
        for letter in map(chr, range(0xC0, 0x100)):
            for byte, char in zip(letter.encode(), letters.pre_tokenize_str(letter)[0][0], strict=True):
                table[byte] = char
        self.table = "".join(table)
        # Remembered words, their ids, and whether a word was met in a later call.
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))
        self.met = np.zeros(0, bool)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each text."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        parts = pc.split_pattern(_spaced(words.dictionary), " ")
        distinct = parts.flatten().dictionary_encode()
        ids = self._ids(distinct.dictionary).take(distinct.indices)
        ids = pa.ListArray.from_arrays(ids.offsets.take(_bounds(parts)), ids.values)
        # Lay the ids of each word where its text has it.
        ids = ids.take(words.indices)
        return ids.values.to_numpy(), np.diff(ids.offsets.take(_bounds(split)).to_numpy())

    def _ids(self, distinct: pa.Array) -> pa.Array:
        """Ids of distinct words, which are remembered."""
        at = pc.index_in(distinct, value_set=self.words)
        missing = at.is_null()
        new = distinct.filter(missing)
        missing = missing.to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().copy()
        self.met[at[~missing]] = True
        # The model's words first, the others behind them.
        plain = pc.match_substring_regex(new, self.plain).to_numpy(zero_copy_only=False)
        order = np.argsort(~plain, kind="stable")
        at[missing] = len(self.words) + np.argsort(order)
        new, count = new.take(order), int(plain.sum())
        words = pa.concat_arrays([self.words, new])
        every = pa.concat_arrays([self.ids, self._modelled(new[:count]), self._whole(new[count:])])
        found = every.take(at)
        short = pc.utf8_length(words).to_numpy() <= REMEMBERED_CHARS
        self._grow(words, every, short)
        return found

    def _grow(self, words: pa.Array, ids: pa.Array, short: np.ndarray) -> None:
        """Remember short words; when there are too many, those met again since the last time."""
        met = np.append(self.met, np.zeros(len(words) - len(self.met), bool))
        if not short.all():
            words, ids, met = words.filter(short), ids.filter(short), met[short]
        if words.nbytes + ids.nbytes > REMEMBERED_BYTES:
            words, ids = words.filter(met), ids.filter(met)
            met = np.zeros(len(words), bool)
            if words.nbytes + ids.nbytes > REMEMBERED_BYTES // 2:
                words, ids, met = words[:0], ids[:0], met[:0]
        self.words, self.ids, self.met = words, ids, met

    def _modelled(self, words: pa.Array) -> pa.Array:
        """Ids of words of Latin letters, by the library's model alone."""
        found = []
        for at in range(0, len(words), PLAIN_WORDS):
            some = words[at : at + PLAIN_WORDS]
            line = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), " ")[0].as_py()
            line = codecs.charmap_decode(line.lower().encode(), "strict", self.table)[0]
            ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.int32)
            # The last token of each word carries the model's mark of a word's end, no other does.
            ends = np.flatnonzero(self.ends[ids]) + 1
            found.append(pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), ids))
        return pa.concat_arrays(found) if found else self.ids[:0]

    def _whole(self, words: pa.Array) -> pa.Array:
        """Ids of any words, by the whole library."""
        encoded = self.library.encode_batch_fast(words.to_pylist(), add_special_tokens=False)
        return pa.array([e.ids for e in encoded], pa.list_(pa.int32()))


def _bounds(lists: pa.Array) -> pa.Array:
    """Where each list begins and ends in the flattened lists."""
    return pc.subtract(lists.offsets, lists.offsets[0])


def _spaced(words: pa.Array) -> pa.Array:
    """Words so written that fewer are distinct, with the same ids; a blank stands between parts.

    Punctuation behind a letter or digit, up to the word's end, is a pre-token of its own, so
    it may stand apart. ASCII capitals become small, which normalisation does after
    composing characters: not where a mark might compose, nor near special tokens.
    """
    small = pc.if_else(pc.match_substring_regex(words, r"\pM|<\|"), words, pc.ascii_lower(words))
    return pc.replace_substring_regex(small, r"([a-zA-Z0-9À-ÖØ-öø-ÿ])([!-&(-;=?@\[-`{}~]+)$", r"\1 \2")


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """Once per Python worker, whose task has one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)


def cut_text(text: str, size: int):
    """Pieces of about ``size`` characters, each but the first beginning with white space."""
    start = 0
    while len(text) - start > size:
        space = SPACE.search(text, start + size)
        if space is None:
            break
        yield text[start : space.start()]
        start = space.start()
    yield text[start:]


def _cut(size: int):
    def run(batches):
        schema = pa.schema(
            [("doc_id", pa.int64()), ("hash", pa.int64()), ("row", pa.int64())]
            + [("piece", pa.int32()), ("last", pa.bool_()), ("text", pa.string())]
        )
        for batch in batches:
            keys = batch.select(["doc_id", "hash", "row"]).to_pylist()
            for key, text in zip(keys, batch["text"], strict=True):
                held, piece = None, 0
                for part in cut_text(text.as_py(), size):
                    if held is not None:
                        yield pa.RecordBatch.from_pylist([key | {"piece": piece, "last": False, "text": held}], schema)
                        piece += 1
                    held = part
                yield pa.RecordBatch.from_pylist([key | {"piece": piece, "last": True, "text": held}], schema)

    return run


def _encode(path: str, end_id: int):
    """A part's pieces, in order, as rows of its file."""
    def slices(batch):
        """Runs of rows of bounded text."""
        start = chars = 0
        lengths = pc.utf8_length(batch["text"]).to_pylist()
        for at, length in enumerate(lengths):
            if chars and chars + length > ENCODE_CHARS:
                yield batch.slice(start, at - start)
                start, chars = at, 0
            chars += length
        yield batch.slice(start)

    def run(batches):
        encoder, offset = _encoder(path), 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for rows in slices(batch):
                last = rows["last"].to_numpy(zero_copy_only=False)
                ids, sizes = encoder(rows["text"])
                ends = np.cumsum(sizes)
                # The end id goes behind the last piece of each document.
                ids = np.insert(ids, ends[last], end_id)
                bounds = np.append(0, ends + np.cumsum(last))
                values = pa.array(ids.astype("<i4", copy=False), pa.int32())
                columns = [
                    rows["doc_id"],
                    rows["row"],
                    rows["piece"],
                    rows["last"],
                    rows["part"],
                    pa.array(offset + bounds[:-1], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values),
                ]
                offset += int(bounds[-1])
                yield pa.RecordBatch.from_arrays(columns, "doc_id row piece last part offset ids".split())

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, piece_chars: int = PIECE_CHARS) -> None:
    """Encode ``docs`` and write the folder.

    The tokenizer file must be readable at ``tokenizer_path`` on every executor.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).select(
        "doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"), "text"
    )
    whole = rows.where(F.length("text") <= piece_chars)
    whole = whole.select("doc_id", "hash", "row", F.lit(0).alias("piece"), F.lit(True).alias("last"), "text")
    # Numbers of documents in pieces are negative: the two branches cannot meet.
    long = rows.where(F.length("text") > piece_chars).withColumn("row", -1 - F.col("row"))
    pieces = whole.unionByName(long.mapInArrow(_cut(piece_chars), PIECES))
    order = [F.col("doc_id").asc_nulls_first(), "hash", "row", "piece"]
    ordered = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = ordered.withColumn("part", F.spark_partition_id())
    with write_settings(spark):
        parts.mapInArrow(_encode(tokenizer_path, end_id), ROWS).write.options(**OPTIONS).parquet(f"{folder}/tokens")

    ends = spark.read.schema(ROWS).parquet(f"{folder}/tokens")
    counts = ends.groupBy("part").agg(F.sum(F.size("ids")).alias("ids"))
    # One row per file: the running sum over them is small.
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts.select("part", F.coalesce(before, F.lit(0)).alias("first_id"), "ids").coalesce(1).write.parquet(f"{folder}/parts")


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, row, piece, last, part, offset, ids, start)``, ``start`` counting all ids before."""
    tokens = spark.read.schema(ROWS).parquet(f"{folder}/tokens")
    parts = spark.read.schema("part int, first_id bigint, ids bigint").parquet(f"{folder}/parts").drop("ids")
    # One row per file of tokens.
    return tokens.join(F.broadcast(parts), "part").withColumn("start", F.col("first_id") + F.col("offset")).drop("first_id")


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, row, piece, last, part, start)`` without reading any id."""
    return read_rows(spark, folder).drop("ids", "offset")


def read_range(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """``(start, ids)``: the ids from position ``start`` up to ``stop``, by pieces.

    Files outside the range are not opened for ids; inside, offsets prune row groups and pages.
    """
    parts = spark.read.schema("part int, first_id bigint, ids bigint").parquet(f"{folder}/parts")
    touched = parts.where((F.col("first_id") < stop) & (F.col("first_id") + F.col("ids") > start))
    touched = touched.select("part", "first_id")
    bounds = touched.agg(F.min("part"), F.max("part"), F.min("first_id")).first()
    tokens = spark.read.schema(ROWS).parquet(f"{folder}/tokens")
    if bounds[0] is None:
        return tokens.select(F.col("offset").alias("start"), "ids").limit(0)
    # In parts behind the first, offsets below the range's end are the only bound.
    near = F.col("part").between(bounds[0], bounds[1]) & (F.col("offset") < stop - bounds[2])
    found = tokens.where(near).join(F.broadcast(touched), "part")
    first = F.col("first_id") + F.col("offset")
    skip = F.greatest(F.lit(0), F.lit(start) - first).cast("int")
    keep = F.least(F.size("ids"), (F.lit(stop) - first).cast("int")) - skip
    return found.where((first < stop) & (first + F.size("ids") > start)).select(
        F.greatest(first, F.lit(start)).alias("start"), F.slice("ids", skip + 1, keep).alias("ids")
    )


def _crc(batches):
    """CRC-32 of every row's ids."""
    for batch in batches:
        ids = batch["ids"]
        bounds, values = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(), "<i4").view(np.uint8)
        found = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        columns = [batch["doc_id"], batch["start"], pa.array(np.diff(bounds), pa.int64()), pa.array(found, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def _running_crc(batches):
    """The pieces of a document come one after another; the sum is taken up where it stood."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    held = row = None

    def finished():
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in held], names)

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("row", "doc_id", "start")]
        for number, doc_id, start, ids in zip(*columns, batch["ids"], strict=True):
            if number != row:
                if held is not None:
                    yield finished()
                row, held = number, [doc_id, start, 0, 0]
            values = np.ascontiguousarray(ids.values.to_numpy(), "<i4")
            held[2] += len(values)
            held[3] = zlib.crc32(values.view(np.uint8), held[3])
    if held is not None:
        yield finished()


def document_digests(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files."""
    ship_package(spark)
    rows, result = read_rows(spark, folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    whole = F.col("last") & (F.col("piece") == 0)
    single = rows.where(whole).select("doc_id", "start", "ids").mapInArrow(_crc, result)
    several = rows.where(~whole).select("row", "doc_id", "start", "piece", "ids")
    several = several.repartition("row").sortWithinPartitions("row", "piece").mapInArrow(_running_crc, result)
    return single.unionByName(several)


def encode_to_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Write the files to a folder of their own and return what reads back from them, by document."""
    folder = Scratch(docs.sparkSession, "token-files").path("files")
    write_tokens(docs, folder, tokenizer_path, end_id, piece_chars)
    return document_digests(docs.sparkSession, folder)
