import random
import re
import textwrap

from basketlore.llm.license_scan import PHRASES, TEMPLATES, license_scan, matching_blocks
from tests.llm.cases import awkward, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}

TEXTS = [
    "Über Text\nReleased under the MIT License.\nend",
    "This work, licensed by us, under the GNU-General public LICENSE (version 3) is apache license cc by cc by",
    "x\nLicensed under CC BY-NC 4.0.",
    "mit\nlicense mit license",
    "released under mit license terms the",
    "permission hereby granted free of charge to any person obtaining copy this software and associated "
    "documentation files deal in software without",
    "the of and this is to a in for",
]


def words(text):
    return WORD.findall(text.translate(LOWER))


def blocks(text, threshold=0.8):
    found, start = [], 0
    for number, line in enumerate(text.split("\n")):
        own = words(line)
        for t, (_, template) in enumerate(TEMPLATES):
            body = set(words(template))
            share = len(body & set(own)) / len(body)
            if share >= threshold - 1e-12:
                found.append((number, start, t, share))
        start += len(own)
    return found


def brute(text):
    own, places, labels = words(text), [], set()
    for phrase, label in PHRASES:
        parts = phrase.split()
        for i in range(len(own)):
            if own[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    found = blocks(text)
    every = labels | {TEMPLATES[t][0] for _, _, t, _ in found}
    score = 1.0 if places else max((s for *_, s in found), default=0.0)
    return (
        len(own),
        len(places),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted(labels)),
        ",".join(sorted(every)),
        score,
    )


def check(docs):
    want = sorted(((r["doc_id"], *brute(r["text"] or "")) for r in docs.collect()), key=repr)
    assert sorted(map(tuple, license_scan(docs).collect()), key=repr) == want
    return want


def test_against_brute_force(spark):
    rows = [(100 + i, t, "en", "a", 0) for i, t in enumerate(TEXTS)]
    found = {r[0]: r for r in check(awkward(spark, [*rows, (300, TEXTS[0], "en", "b", 0)]))}
    assert found[100][5:7] == ("mit", "mit")
    assert found[102][5:7] == ("cc-by", "cc-by,cc-by-nc")
    assert found[105][6] == "mit" and 0.8 <= found[105][7] < 1
    assert found[106][6:8] == ("", 0.0)


def test_blocks(spark):
    docs = awkward(spark, [(100 + i, t, "en", "a", 0) for i, t in enumerate(TEXTS)])
    found = matching_blocks(docs).select("doc_id", "block", "start", "template", "containment").collect()
    want = [(r["doc_id"], *b) for r in docs.collect() for b in blocks(r["text"] or "")]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_whole_table(spark, folder):
    check(spark.read.parquet(f"{folder}/documents.parquet"))


def test_empty_table(spark):
    assert license_scan(empty(spark)).collect() == []


def scanned(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = sorted(license_scan(docs).collect())
    return [(set(r["labels"].split(",")), r["score"]) for r in rows], docs


def test_wrapped_notices(spark):
    draw = random.Random(8)
    filler = [" ".join(f"w{draw.randrange(500)}" for _ in range(n)) for n in range(0, 240, 12)]
    texts = [
        f"{before}\n" + textwrap.fill(template, 24, initial_indent=mark, subsequent_indent=mark) + "\nmore"
        for (_, template), before in zip(TEMPLATES, filler, strict=True)
        for mark in ("", " * ")
    ]
    found, _ = scanned(spark, texts)
    for i, (labels, score) in enumerate(found):
        assert TEMPLATES[i // 2][0] in labels and score == 1, texts[i]


def test_long_lines(spark):
    draw = random.Random(9)
    name = "lesser general public license".split()
    long = [f"w{draw.randrange(500)}" for _ in range(20_000)]
    scattered = long.copy()
    for i, w in enumerate(name):
        scattered[100 + 4000 * i] = w
    whole = [" ".join([*long[:at], TEMPLATES[1][1], *long[at:]]) for at in (0, 57, 58, 101, 115, 116, 9999, 20_000)]
    found, docs = scanned(spark, [" ".join(scattered), *whole])
    assert found[0] == ({""}, 0.0)
    assert all(labels == {"mit"} and score == 1 for labels, score in found[1:])
    assert {(r["block"], r["start"], r["template"]) for r in matching_blocks(docs).collect()} == {(0, 0, 1)}
