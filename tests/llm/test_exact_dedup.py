import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from basketlore.llm.exact_dedup import content_hash, drop_copies, exact_dedup, mark_copies
from tests.llm.cases import awkward, empty


def brute(rows, pick):
    ids = defaultdict(list)
    for r in rows:
        ids[r["text"] or ""].append(r["doc_id"])
    out = []
    for r in rows:
        same = ids[r["text"] or ""]
        known = [i for i in same if i is not None]
        keep = pick(known) if known else None
        out.append((r["doc_id"], keep, len(same), keep == r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_awkward_rows_against_brute_force(spark):
    docs = awkward(spark)
    for keep, pick in (("smallest", min), ("largest", max)):
        found = exact_dedup(docs, keep).collect()
        assert sorted(map(tuple, found), key=repr) == brute(docs.collect(), pick)


def test_one_row_stays_for_each_text(spark):
    docs = awkward(spark)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({r["text"] or "" for r in docs.collect()})
    assert sorted(r["doc_id"] for r in rows if r["text"] and r["text"].startswith("alpha beta")) == [1]


def test_texts_with_one_hash_are_told_apart(spark):
    docs = awkward(spark, [(20, "alpha", "en", "a", 5), (21, "beta", "en", "a", 4)])

    def weak(text):
        return F.substring(content_hash(text), 1, 0)

    marked = mark_copies(docs, "largest", F.sha2(F.coalesce("text", F.lit("")), 256), weak)
    found = marked.select("doc_id", "keep_id", "group_size", "kept", "row").collect()
    assert sorted(map(tuple, found), key=repr) == brute(docs.collect(), max)


def test_empty_table(spark):
    assert exact_dedup(empty(spark)).collect() == []
    assert drop_copies(empty(spark)).collect() == []
