"""The trie against one built in plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from basketlore.llm.conversation_trie import prefix_trie

TURNS = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def _token_order(role, text):
    framed = f"{len(role)}:{role}{text}".encode()
    return hashlib.sha256(framed).hexdigest()[:32]


def brute(rows, heads=4):
    convs = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs.setdefault(conv_id, []).append((turn, role or "", text or ""))
    for turns in convs.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, _token_order(t[1], t[2])))
    rebuilt = {}
    for c, turns in convs.items():
        head = zlib.crc32(str(c).encode()) % heads
        base = convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])
        rebuilt[c] = tuple((r, t) for _, r, t in base[:head] + turns[head:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    found = []
    for node, convs_here in members.items():
        subtree = [m for m in members if m[: len(node)] == node]
        children = [m for m in subtree if len(m) == len(node) + 1]
        leaves = [m for m in subtree if not any(len(o) == len(m) + 1 and o[: len(m)] == m for o in members)]
        saved = sum((len(members[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in subtree if m)
        ends = ",".join(str(c) for c in sorted(convs_here) if len(rebuilt[c]) == len(node))
        found.append(
            (
                min(convs_here),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(convs_here),
                len(children),
                len(leaves),
                saved,
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return found


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def conversations(seed, convs, longest, vocabulary):
    pick = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(pick.randrange(longest + 1)):
            rows.append((c, turn, pick.choice(["user", "assistant"]), " ".join(["w"] * pick.randrange(vocabulary))))
    return rows


@pytest.mark.parametrize(("convs", "longest", "vocabulary", "block"), [(60, 6, 2, 64), (30, 19, 2, 4)])
def test_equals_brute_force(spark, convs, longest, vocabulary, block):
    rows = conversations(convs, convs, longest, vocabulary)
    # Copies of one conversation, so that its members are more than one list holds.
    rows += [(200 + c, turn, "user", "same words here") for c in range(0, 30) for turn in range(longest)]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    assert rows_of(prefix_trie(df, block=block, list_rows=4)) == sorted(brute(rows), key=repr)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None),
        (1, None, None, None),
        (1, 0, "user", ""),
        (1, 0, "", "user"),
        (1, 0, "user", ""),
        (None, 3, "user", "nobody's"),
        (40, 5, "user", "a  b\tc\x0bd"),
        (40, 4, None, "x" * 200_000),
        (47, 1, "user", "中文 字"),
        (-7, 1, "user", "below zero"),
        (-7, 2, "user", "below zero"),
        (-20, 1, "user", "base"),
        (20, 1, "user", None),
    ]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("name", "root", "at", "place", "depth", "end")})
    assert rows_of(prefix_trie(df, block=2)) == sorted(brute(rows), key=repr)


def test_one_conversation_of_repeated_rows(spark):
    rows = [(7, 1, "user", "again and again")] * 100 + [(8, 1, "user", "again and again")] * 40
    assert rows_of(prefix_trie(spark.createDataFrame(rows, TURNS).repartition(4), block=64)) == sorted(brute(rows), key=repr)


def test_only_turnless(spark):
    turnless = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 1)
    rows = [(turnless, 0, "user", "dropped")]
    found = rows_of(prefix_trie(spark.createDataFrame(rows, TURNS)))
    assert found == brute(rows)
    assert found[0][5] == 1


def test_empty(spark):
    assert prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_conversations_as_they_are(spark):
    rows = conversations(3, 30, 5, 3)
    assert rows_of(prefix_trie(spark.createDataFrame(rows, TURNS), heads=1)) == sorted(brute(rows, heads=1), key=repr)


def test_block_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError, match="power of two"):
        prefix_trie(spark.createDataFrame([], TURNS), block=6)
