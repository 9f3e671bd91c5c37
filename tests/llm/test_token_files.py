"""Token files against the library on whole texts, and what the files look like."""

import glob
import random
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketlore.llm import token_files
from basketlore.llm.token_files import (
    WordEncoder,
    cut_text,
    document_digests,
    encode_to_files,
    read_metadata,
    read_range,
    read_rows,
    write_tokens,
)
from tests.llm.cases import awkward, empty

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = WordEncoder(PATH)


def ids_of(text, end_id=1):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, end_id]


def brute(rows):
    """Digests of ``(doc_id, text)`` in order; equal documents are interchangeable."""
    found, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(text)
        found.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def digests(df):
    found = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in df.collect()]
    return sorted(found, key=lambda r: r[1])


PARTS = ["a", "Ünï", "don't", "'s", " ", "\t", "\n", "\r", " ", "́", "ᄒ", "ᅡ", "12", "<|endoftext|>", "<|start", "oftext|>", "…", "ΣΑΣ", "中", "İ", "\x1f", "\x85", "--", "ﬁ", "Word", "naïve", ".", "!?", "<|ENDOFTEXT|>", "é", "x\u0301", "ß", "ÿ", "J\u030c", "J", "\u030c", "A.", "9;", "b?!"]


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=4), max_size=12))
def test_words_encode_as_whole_texts(parts):
    text = "".join(parts)
    ids, sizes = ENCODER(pa.array(["", text, "a b", text]))
    expected = [ids_of(t)[:-1] for t in ("", text, "a b", text)]
    assert ids.tolist() == [i for e in expected for i in e]
    assert sizes.tolist() == [len(e) for e in expected]


def test_words_written_differently_are_encoded_once():
    """Case and punctuation behind a word make no new words for the library."""
    encoder, seen = WordEncoder(PATH), []

    class Spy:
        def encode_batch_fast(self, words, **options):
            seen.extend(words)
            return LIBRARY.encode_batch_fast(words, **options)

    encoder.library = Spy()
    text = "Straße straße$$$ Élan élan*** élan&&& élan 7%%% élan)\x0bélan,### straße\x0c"
    for _ in range(2):
        ids, sizes = encoder(pa.array([text]))
        assert ids.tolist() == ids_of(text)[:-1] and sizes.tolist() == [len(ids)]
    assert sorted(word for word in seen if word) == ["$$$", "%%%", "&&&", ")", "***", ",###", "7"]


def test_memory_of_words_is_bounded(monkeypatch):
    """Words met again outlive those met once; results are the same without them."""
    monkeypatch.setattr(token_files, "REMEMBERED_BYTES", 4000)
    encoder = WordEncoder(PATH)
    for batch in range(40):
        text = " ".join(["again", "and"] + ["ab" * n + "cdefghij"[batch % 8] * batch for n in range(1, 40)])
        ids, sizes = encoder(pa.array([text, None, "again"]).fill_null(""))
        assert ids.tolist() == [*ids_of(text)[:-1], *ids_of("again")[:-1]]
        assert sizes.tolist() == [len(ids) - 1, 0, 1]
        assert encoder.words.nbytes + encoder.ids.nbytes <= 4000
        assert "again" in encoder.words.to_pylist() or batch == 0


@given(st.text(alphabet="ab \n", max_size=60), st.integers(1, 9))
def test_pieces_join_to_the_text(text, size):
    pieces = list(cut_text(text, size))
    assert "".join(pieces) == text
    assert all(p[0] in " \n" for p in pieces[1:])


def test_awkward_documents(spark):
    long = "word's " * 30_000 + "x" * 200_000 + " " * 200_000 + "end"
    df = awkward(spark, [(9, long, "en", "a", 1), (-4, "<|endoftext|> a<|startoftext|>b", "en", "a", 1)])
    df = df.withColumns({c: F.lit(3) for c in ("hash", "row", "piece", "last", "offset", "ids", "start")}).repartition(3)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert digests(encode_to_files(df, PATH, piece_chars=500)) == brute(rows)
    assert digests(encode_to_files(df, PATH)) == brute(rows)


def test_empty_table(spark):
    assert encode_to_files(empty(spark), PATH).collect() == []


@pytest.fixture(scope="module")
def written(spark):
    pick = random.Random(2)
    words = ["alpha", "beta", "gamma's", "Δelta", "5"]
    rows = [(i // 2, " ".join(pick.choices(words, k=pick.choice([0, 3, 40, 900])))) for i in range(400)]
    folder = tempfile.mkdtemp(prefix="basketlore-tokens-") + "/tokens"
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), folder, PATH, piece_chars=1000)
    spark.conf.unset(merge)
    return rows, folder


def test_documents_in_order(spark, written):
    rows, folder = written
    found = digests(document_digests(spark, folder))
    assert [r[0] for r in found] == sorted(r[0] for r in rows)
    counts = {}
    for doc_id, text in rows:
        counts.setdefault(doc_id, set()).add((len(ids_of(text)), zlib.crc32(np.array(ids_of(text), "<u4").tobytes())))
    for (doc_id, start, n, crc), after in zip(found, [*found[1:], None], strict=True):
        assert (n, crc) in counts[doc_id]
        assert after is None or after[1] == start + n


def test_files(written):
    """Encodings, row groups and page indexes are what the docstring says."""
    paths = glob.glob(f"{written[1]}/tokens/*.parquet")
    assert len(paths) > 1
    for path in paths:
        group = pq.ParquetFile(path).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
        for name in ("doc_id", "row", "offset", "piece"):
            assert "DELTA_BINARY_PACKED" in columns[name].encodings
            assert columns[name].has_offset_index and columns[name].has_column_index
        starts = pq.read_table(path, columns=["offset"])["offset"].to_pylist()
        assert starts == sorted(starts)


def test_ranges(spark, written):
    _, folder = written
    pieces = [(r["start"], r["ids"]) for r in read_rows(spark, folder).orderBy("start", F.size("ids")).collect()]
    every = [i for _, ids in pieces for i in ids]
    for start, stop in [(0, 10), (500, 3000), (17, 18), (len(every) - 5, len(every) + 9), (0, len(every)), (9**9, 9**9 + 1)]:
        found = read_range(spark, folder, start, stop).orderBy("start").collect()
        assert [i for r in found for i in r["ids"]] == every[start:stop]
        assert all(every[r["start"] : r["start"] + len(r["ids"])] == r["ids"] for r in found)


def test_selective_reads_prune(spark, written):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = read_range(spark, written[1], 100, 200)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(offset" in plan
    plan = read_metadata(spark, written[1])._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
