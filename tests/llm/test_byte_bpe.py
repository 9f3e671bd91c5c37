import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import regex

from basketlore.llm.byte_bpe import decode, encode
from tests.llm.cases import DOCUMENTS, awkward, empty

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def brute(text, ranks, cache={}):  # noqa: B006
    """Merge the adjacent pair of lowest rank until none is left, pre-token by pre-token."""
    ids = []
    for piece in regex.findall(PATTERN, text):
        if piece not in cache:
            parts = [bytes([b]) for b in piece.encode()]
            while len(parts) > 1:
                pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
                best = min(pairs)
                if best == 1 << 60:
                    break
                i = pairs.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            cache[piece] = [ranks[p] for p in parts]
        ids += cache[piece]
    return ids


def expected(rows, ranks):
    out = []
    for r in rows:
        text = r["text"] or ""
        ids = brute(text, ranks)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        out.append((r["doc_id"], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_texts():
    draw = random.Random(5)
    pieces = ["'re", "'s", "'", " ", "  ", "\n\n", "\t", "a", "word", " Wörter", "12", "!?", "中文", "😀", "don't", " 's"]
    texts = ["".join(draw.choices(pieces, k=draw.randint(1, 900))) for _ in range(60)]
    return [*texts, "x" * 700, " " * 500, " " * 200 + "y" + " " * 300, "ab " * 90 + "q" * 400 + " we're" * 80]


def test_awkward_rows(spark, ranks):
    docs = awkward(spark)
    found = encode(docs, RANKS, PATTERN, chunk=1024, overlap=64)
    assert sorted(map(tuple, found.collect()), key=repr) == expected(docs.collect(), ranks)


def test_every_cut_is_exact(spark, ranks):
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(odd_texts())], DOCUMENTS)
    for chunk, overlap in ((16, 8), (40, 20), (64, 64), (257, 31)):
        found = encode(docs, RANKS, PATTERN, chunk=chunk, overlap=overlap)
        assert sorted(map(tuple, found.collect()), key=repr) == expected(docs.collect(), ranks)


def test_round_trip(spark):
    docs = awkward(spark)
    encoded = encode(docs, RANKS, PATTERN, keep_ids=True, chunk=2048)
    texts = sorted(bytes(r["bytes"]) for r in decode(encoded, RANKS, PATTERN).collect())
    assert texts == sorted((r["text"] or "").encode() for r in docs.collect())


def test_whole_table(spark, folder, ranks):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert sorted(map(tuple, encode(docs, RANKS, PATTERN).collect()), key=repr) == expected(docs.collect(), ranks)


def test_empty_table(spark):
    assert encode(empty(spark), RANKS, PATTERN).collect() == []


def test_very_long_runs(spark, ranks):
    """Runs beyond what the library's pattern engine can take: white space, letters, punctuation."""
    texts = [" " * 1_500_000 + "x", "word " + "ab" * 600_000 + " end", "a" + "-" * 1_000_000, "\n" * 1_200_000]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCUMENTS)
    found = {r["doc_id"]: r for r in encode(docs, RANKS, PATTERN, keep_ids=True).collect()}
    for i, text in enumerate(texts):
        assert found[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert found[i]["n_tokens"] == len(found[i]["ids"])
    # No token is more than one space long, so all but the last stand alone.
    assert set(found[0]["ids"][:1_499_999]) == {ranks[b" "]}
    assert found[0]["ids"][1_499_999:] == brute(" x", ranks)
    assert found[1]["ids"][0] == ranks[b"word"] and found[1]["ids"][-1] == ranks[b" end"]
    # A run of letters is merged as a whole: the same pattern all along.
    assert len(set(found[1]["ids"][10:-10])) <= 2
