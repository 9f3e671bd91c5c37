import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from basketlore.llm import katz
from basketlore.llm.katz import katz_scores
from tests.llm.cases import DOCUMENTS, awkward, empty

LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def turing(counts):
    n = Counter(counts)
    rest = 6 * n[6] / n[1] if n[1] else 1
    out = {}
    for r in range(1, 6):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return lambda c: out[c] * c if c <= 5 else c - 0.01


class Model:
    def __init__(self, texts):
        self.words, self.pairs, self.after = Counter(), Counter(), defaultdict(set)
        for text in texts:
            before = "<s>"
            for w in tokens(text):
                self.words[w] += 1
                self.pairs[before, w] += 1
                self.after[before].add(w)
                before = w
        self.total = sum(self.words.values())
        self.d1, self.d2 = turing(self.words.values()), turing(self.pairs.values())
        self.rest = 1 - sum(map(self.d1, self.words.values())) / self.total if self.total else 1

    def word(self, w):
        return self.d1(self.words[w]) / self.total if self.words[w] else self.rest

    def pair(self, h, w):
        seen = self.after.get(h)
        if not seen:
            return self.word(w)
        count = sum(self.pairs[h, x] for x in seen)
        if w in seen:
            return self.d2(self.pairs[h, w]) / count
        left = 1 - sum(self.d2(self.pairs[h, x]) for x in seen) / count
        return left / (1 - sum(map(self.word, seen))) * self.word(w)

    def row(self, doc_id, text):
        found, before, score = tokens(text), "<s>", 0
        for w in found:
            score += math.log10(self.pair(before, w))
            before = w
        base = sum(math.log10((self.words[w] + 1) / (self.total + len(self.words) + 1)) for w in found)
        known = sum(self.words[w] > 0 for w in found)
        return doc_id, held_out(doc_id), len(found), known, self.total, base, score


def check(docs):
    rows = docs.collect()
    model = Model([r["text"] for r in rows if not held_out(r["doc_id"])])
    want = sorted((model.row(r["doc_id"], r["text"]) for r in rows), key=repr)
    found = sorted(map(tuple, katz_scores(docs).collect()), key=repr)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for got, exact in zip(found, want, strict=True):
        assert got[5] == pytest.approx(exact[5], rel=1e-9, abs=1e-9)
        assert got[6] == pytest.approx(exact[6], rel=1e-6, abs=1e-6)
    return model, found


def corpus(seed, n=80):
    draw = random.Random(seed)
    words = [f"W{i}" for i in range(60)] + ["hot"] * 60
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 60))) for _ in range(n)]
    return [(i, t, "en", "a", 0) for i, t in enumerate([*texts, *texts[:9], "hot " * 400, "never seen before"])]


def test_against_brute_force(spark):
    model, _ = check(spark.createDataFrame(corpus(1), DOCUMENTS))
    words = [*model.words, "not a word"]
    for h in ["<s>", "hot", "w1", "w2", "not a word"]:
        assert sum(model.pair(h, w) for w in words) == pytest.approx(1, abs=1e-9)


def test_hot_words_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(katz, "HOT_LEAST", 20)
    monkeypatch.setattr(katz, "HOT_SHARE", 60)
    monkeypatch.setattr(katz, "BATCH_TOKENS", 300)
    monkeypatch.setattr(katz, "PARTITION_TOKENS", 200)
    check(spark.createDataFrame(corpus(2), DOCUMENTS))


def test_awkward_rows(spark):
    check(awkward(spark))


def test_whole_table(spark, folder):
    _, found = check(spark.read.parquet(f"{folder}/documents.parquet"))
    held = [r for r in found if r[1]]
    assert len(held) > 10 and sum(r[6] for r in held) > sum(r[5] for r in held)


def test_nothing_to_learn_from(spark):
    assert katz_scores(empty(spark)).collect() == []
    docs = spark.createDataFrame([(1, "a b", "en", "a", 3)], DOCUMENTS)
    row = katz_scores(docs, F.lit(True)).collect()[0]
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0, 0)
