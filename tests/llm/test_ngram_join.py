import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from basketlore.llm import ngram_join
from basketlore.llm.ngram_join import drop_near_copies, ngram_jaccard_join
from tests.llm.cases import DOCUMENTS, awkward, empty

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    size = min(5, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows):
    sets = [shingles(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(root(i), []).append(r["doc_id"])
    out = []
    for i, r in enumerate(rows):
        known = [d for d in ids[root(i)] if d is not None]
        out.append((r["doc_id"], len(sets[i]), min(known) if sets[i] and known else r["doc_id"] if not sets[i] else None))
    return sorted(out, key=repr)


def edited(words, rate, draw):
    out = list(words)
    for _ in range(int(rate * len(words) / 5)):
        out[draw.randrange(len(out))] = f"x{draw.randrange(10**6)}"
    return out


def corpus(seed, groups=6, copies=30, size=120, passage=60):
    """Groups of near copies at all distances, documents that share one passage, and short ones."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = draw.choices(vocabulary, k=passage)
    texts = []
    for _ in range(groups):
        base = draw.choices(vocabulary, k=draw.randint(8, size))
        for _ in range(copies):
            texts.append(" ".join(edited(base, draw.choice([0, 0.1, 0.2, 0.3, 0.5]), draw)))
    for _ in range(60):
        texts.append(" ".join(shared + draw.choices(vocabulary, k=draw.randint(3, 60))))
    for _ in range(30):
        texts.append(" ".join(draw.choices(vocabulary[:3], k=draw.randint(1, 9))))
    draw.shuffle(texts)
    return [(i * 3 + 1, t, "en", "a", 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = spark.createDataFrame(corpus(seed), DOCUMENTS)
    assert sorted(map(tuple, ngram_jaccard_join(docs).collect()), key=repr) == brute(docs.collect())


def test_deep_recursion(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_REGION", 2)
    monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", 1)
    docs = spark.createDataFrame(corpus(3, groups=3, copies=12, size=40, passage=20), DOCUMENTS)
    assert sorted(map(tuple, ngram_jaccard_join(docs).collect()), key=repr) == brute(docs.collect())


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert sorted(map(tuple, ngram_jaccard_join(docs).collect()), key=repr) == brute(docs.collect())
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(map(repr, [1, 3, 4, 5, 6, 7, 8, None]))


def test_empty_table(spark):
    assert ngram_jaccard_join(empty(spark)).collect() == []
    assert drop_near_copies(empty(spark)).collect() == []


def region_pairs(texts, met):
    """Pairs that the members of one region send on, each member a component of its own."""
    none = np.zeros(0, np.uint64)
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "key": [b""] * len(texts), "text": texts})
    described = ngram_join._describe(SimpleNamespace(value=(none, none)))([docs])
    table = pa.Table.from_batches(described)
    nodes = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_pydict(
        {
            "region": pa.array([7] * len(texts), pa.int64()),
            "node": nodes,
            "n": table["n"].combine_chunks(),
            "component": nodes,
            "met": pa.array([met] * len(texts)),
            "profile": table["profile"].combine_chunks(),
        }
    )
    found = list(ngram_join._near_in_regions([batch]))
    return [(a, b) for f in found for a, b in zip(f["a"].to_pylist(), f["b"].to_pylist(), strict=True)]


def test_near_copies_of_a_region_send_a_forest():
    """Members that all link to each other send one pair less than they are, which connect them."""
    draw = random.Random(5)
    base = draw.choices([f"w{i}" for i in range(400)], k=250)
    texts = [" ".join(edited(base, 0.06, draw)) for _ in range(120)]
    pairs = region_pairs(texts, False)
    assert len(pairs) == len(texts) - 1
    known = {0}
    for _ in pairs:
        known |= {x for pair in pairs if known & set(pair) for x in pair}
    assert len(known) == len(texts)


@pytest.mark.parametrize("length", [30, 120, 250, 600, 3000])
def test_profiles_lose_no_link_and_few_others_pass(length):
    """All links are among the pairs of a region, and hardly any pair of a distance over 0.25."""
    draw = random.Random(length)
    base = draw.choices([f"w{i}" for i in range(4000)], k=length)
    texts = [" ".join(edited(base, 0.01 * draw.randint(0, 30), draw)[draw.randint(0, 9) :]) for _ in range(40)]
    sets = [shingles(t) for t in texts]
    pairs, near = set(region_pairs(texts, True)), 0
    for b in range(len(texts)):
        for a in range(b):
            common, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            assert 100 * common < 80 * union or (a, b) in pairs
            near += (a, b) in pairs and common < 0.75 * union
    assert near <= 10
