import hashlib
import struct

import corpus_pipeline
from basketlore.llm import catalog
from basketlore.llm.shared import documents
from tests.llm.cases import awkward, empty
from tests.llm.test_ngram_join import brute as brute_components


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, folder):
    docs = documents(spark, folder)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, docs, folder).cache()
    assert kept.columns == columns and 0 < kept.count() <= docs.count()

    exact = stages["exact dedup"](spark, kept, folder).cache()
    first = {}
    for r in kept.orderBy("doc_id").collect():
        first.setdefault(r["text"], r["doc_id"])
    assert exact.columns == columns and ids(exact) == sorted(first.values())

    near = stages["n-gram Jaccard join"](spark, exact, folder).cache()
    want = [d for d, _, c in brute_components(exact.collect()) if d == c]
    assert near.columns == columns and ids(near) == sorted(want)

    mixed = stages["mixing to target weights"](spark, near, folder).cache()
    assert mixed.columns == columns and set(ids(mixed)) <= set(ids(near))

    encoded = {r["doc_id"]: r for r in stages["byte-level BPE"](spark, mixed, folder).collect()}
    assert sorted(encoded) == ids(mixed)
    for r in mixed.collect():
        row = encoded[r["doc_id"]]
        assert row["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
        packed = struct.pack(f"<{len(row['ids'])}I", *row["ids"])
        assert row["n_tokens"] == len(row["ids"]) and row["ids_sha256"] == hashlib.sha256(packed).hexdigest()

    assert ids(corpus_pipeline.run(spark, folder)) == sorted(encoded)


def test_awkward_rows_pass_every_stage(spark, folder):
    for docs in (awkward(spark), empty(spark)):
        columns = docs.columns
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, folder)
            assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        docs.collect()


def test_every_operator_has_its_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in catalog.QUERIES if name.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in catalog.QUERIES
    assert catalog.ORACLE_SQL.keys() <= catalog.QUERIES.keys()
