import hashlib
import random

import numpy as np

from basketlore.llm.fingerprint import (
    INNER,
    WINDOW,
    aligned,
    fingerprint_edits,
    fingerprints,
    from_text,
    likeness,
    positional_matches,
    sketch,
    syncmers,
    to_text,
)
from tests.llm.cases import DOCUMENTS, awkward, empty


def words(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefgéü😀", k=draw.randint(1, 9))) for _ in range(n))


def test_windows_are_chosen_by_their_own_content():
    text = words(1, 300)
    places, hashes = syncmers(text)
    alone = [i for i in range(len(text) - WINDOW + 1) if len(syncmers(text[i : i + WINDOW])[0])]
    assert places.tolist() == alone
    assert [syncmers(text[i : i + WINDOW])[1][0] for i in alone[:50]] == hashes[:50].tolist()
    # Two of WINDOW - INNER + 1 places are edges.
    assert abs(len(places) / (len(text) - WINDOW + 1) - 2 / (WINDOW - INNER + 1)) < 0.03


def test_likeness_follows_the_shared_part():
    for seed in range(5):
        a, b = words(seed, 3000), words(seed + 100, 3000)
        whole, half = sketch(a)[0], sketch(a[: len(a) // 2] + b[: len(b) // 2])[0]
        assert likeness(whole, whole) == 1
        assert abs(likeness(whole, half) - 1 / 3) < 0.15
        assert likeness(whole, sketch(b)[0]) < 0.05


def test_positions_align():
    text = words(7, 800)
    shifted = "prefix that moves all. " + text
    pairs = positional_matches(to_text(sketch(text)), to_text(sketch(shifted)))
    moved = [b - a for a, b in pairs]
    assert len(pairs) > 100 and moved.count(23) > 0.95 * len(pairs)
    assert positional_matches("", to_text(sketch(text))) == []


def brute(rows):
    order = sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    out = []
    for i, r in enumerate(order):
        text, after = r["text"] or "", order[(i + 1) % len(order)]["text"] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own = sketch(text)
        out.append(
            (
                r["doc_id"],
                len(text),
                hashlib.sha256(edited.encode()).hexdigest(),
                to_text(own),
                to_text(sketch(edited)),
                likeness(own[0], sketch(edited)[0]),
                likeness(own[0], sketch(after)[0]),
            )
        )
    return sorted(out, key=repr)


def test_awkward_rows(spark):
    docs = awkward(spark, [(1000 + i, words(i, 5 * i), "en", "a", 0) for i in range(30)])
    assert sorted(map(tuple, fingerprint_edits(docs).collect()), key=repr) == brute(docs.collect())


def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = fingerprint_edits(docs).collect()
    assert sorted(map(tuple, found), key=repr) == brute(docs.collect())
    assert sum(r["near_edited"] > r["near_next"] for r in found) > 0.9 * len(found)


def test_small_and_empty_tables(spark):
    assert fingerprint_edits(empty(spark)).collect() == []
    one = spark.createDataFrame([(1, "only one", "en", "a", 8)], DOCUMENTS)
    row = fingerprint_edits(one).collect()[0]
    assert row["edited_sha256"] == hashlib.sha256(b"onlyonly").hexdigest() and row["near_next"] == 1
    assert from_text(fingerprints(one).collect()[0]["fingerprint"])[0].size == 1


def test_every_anchor_counts():
    # 50 words that two long documents share, at different places.
    shared = words(50, 50)
    a, b = (words(s, 10_000) + " " + shared + " " + words(s + 1, 10_000) for s in (60, 70))
    (hashes, places), inside = sketch(a), len(syncmers(shared)[0])
    assert hashes.size == len(syncmers(a)[0]) and places.tolist() == syncmers(a)[0].tolist()
    assert [x.tolist() for x in from_text(to_text((hashes, places)))] == [hashes.tolist(), places.tolist()]
    pairs = positional_matches(to_text(sketch(a)), to_text(sketch(b)))
    moved = b.index(shared) - a.index(shared)
    assert sum(y - x == moved for x, y in pairs) >= inside > 10
    assert likeness(hashes, sketch(b)[0]) >= inside / (2 * hashes.size)


def test_alignment_against_brute_force():
    draw = random.Random(5)
    for _ in range(200):
        a, b = (np.array(draw.choices(range(6), k=draw.randint(0, 14)), np.uint64) for _ in range(2))
        best = [[0] * (b.size + 1) for _ in range(a.size + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert aligned(a, b) == best[-1][-1]
        pairs = positional_matches(to_text((a, np.arange(a.size))), to_text((b, np.arange(b.size))))
        assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(x < i and y < j for (x, y), (i, j) in zip(pairs, pairs[1:], strict=False))


def test_order_and_repetition_count():
    a, b = words(80, 200), words(81, 200)
    assert likeness(sketch(a + b)[0], sketch(b + a)[0]) < 0.5
    assert likeness(sketch(a)[0], sketch(a + a)[0]) < 0.55


def test_short_texts_have_anchors():
    for n in [1, WINDOW - 1, *range(WINDOW, 41)]:
        texts = {words(s, 40)[:n] for s in range(100 * n, 100 * n + 60)}
        found = [sketch(t)[0] for t in texts]
        assert all(f.size for f in found)
        if n >= WINDOW:
            assert all(likeness(a, b) == 0 for a, b in zip(found, found[1:], strict=False))
        if n >= 39:
            assert all(len(syncmers(t)[0]) for t in texts)
    assert sketch("")[0].size == 0 and likeness(sketch("")[0], sketch("x" * 30)[0]) == 0
