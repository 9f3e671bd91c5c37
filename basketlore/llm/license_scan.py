"""License scans: an exact containment join of text blocks with license templates.

A template matches where a stretch of consecutive words holds at least
``THRESHOLD`` of its set of words. The stretch has ``SLACK`` times the template's
words, ``LEAST_WIDTH`` at least; line breaks play no part in it, so a wrapped
notice is found, and words scattered over a long line are not one. A match is
reported at the line where its stretch begins, once for each line and template
with the best containment; a stretch does not begin with a word that it holds
again further on.

A block is two widest stretches long, and the next begins one stretch later: each
stretch lies within the block where it begins. Only words of templates count, so
a block is cut down to them, with their places, when it is read. Block and
template are joined as sets; the stretches of what the join finds are counted.

All template words are put in one order, rarest in the corpus first. A template
of n words of which c must be found can only match a block that holds one of its
first n - c + 1 words (prefix filter); a block needs c words at all (length
filter); and what is left behind the shared word on either side must still reach
c (positional filter). What passes is counted exactly.

Besides, the fixed phrases are looked up as consecutive words; their labels are
always there. Null texts count as empty. Equal texts are joined once, whatever
their number.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlore.llm.shared import Scratch, text_of

THRESHOLD = 0.8
SLACK = 2
LEAST_WIDTH = 16

# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Names and sentences of public license notices, and their labels. A name of up to
# four words must be there in full at the usual threshold, so that no license passes for a sibling.
TEMPLATES = (
    ("mit", "under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction",
    ),
    ("apache", "Apache License, Version 2"),
    ("apache", "You may obtain a copy of the License at http www apache org licenses LICENSE-2.0"),
    ("gpl", "GNU General Public License"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
    ),
    ("lgpl", "Lesser General Public License"),
    ("agpl", "Affero General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Creative Commons Attribution"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial"),
    ("cc-by-nc", "CC BY-NC"),
    ("cc-by-nd", "Creative Commons Attribution-NoDerivatives"),
    ("cc-by-nd", "CC BY-ND"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike"),
    ("cc-by-sa", "CC BY-SA"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related rights to this work"),
)

# Word bytes stay (digits, a-z and all of a multi-byte character), other bytes become spaces.
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_ROW = (
    "doc_id bigint, key string, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels array<string>, blocks array<struct<block:bigint,words:array<int>,ids:array<int>,places:array<bigint>,"
    "lines:array<bigint>,starts:array<bigint>>>, counts array<bigint>"
)
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("key", pa.string()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.list_(pa.string())),
        (
            "blocks",
            pa.list_(
                pa.struct(
                    [
                        ("block", pa.int64()),
                        ("words", pa.list_(pa.int32())),
                        ("ids", pa.list_(pa.int32())),
                        *((name, pa.list_(pa.int64())) for name in ("places", "lines", "starts")),
                    ]
                )
            ),
        ),
        ("counts", pa.list_(pa.int64())),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8; only A-Z are lower-cased."""
    return text.lower().translate(_WORD_BYTES).split()


@lru_cache(maxsize=8)
def _templates(templates: tuple) -> tuple[dict[bytes, int], list[frozenset]]:
    """Numbers of all template words, and each template's word numbers."""
    sets = [frozenset(words_of(text.encode())) for _, text in templates]
    vocabulary = {w: i for i, w in enumerate(sorted(frozenset().union(*sets)))}
    return vocabulary, [frozenset(vocabulary[w] for w in s) for s in sets]


def needed(size: int, threshold: float) -> int:
    """The least number of words that reaches the threshold."""
    return max(1, math.ceil(size * threshold - 1e-9))


def _widths(templates: tuple) -> list[int]:
    """Words of a stretch for each template."""
    return [max(LEAST_WIDTH, SLACK * len(words_of(text.encode()))) for _, text in templates]


def _phrase_places(words, phrases):
    """Start of every place where a phrase stands, and the labels found."""
    line = b" " + b" ".join(words) + b" "
    places, labels = [], set()
    for phrase, label in phrases:
        wanted = b" " + phrase.encode() + b" "
        at = line.find(wanted)
        while at >= 0:
            places.append(line.count(b" ", 0, at))
            labels.add(label)
            at = line.find(wanted, at + 1)
    return places, sorted(labels)


def _read(templates, phrases, threshold):
    """Words, phrases and blocks of each document; the blocks that hold each template word, once a batch."""

    def run(batches):
        vocabulary, sets = _templates(templates)
        known = vocabulary.keys()
        least = min(needed(len(s), threshold) for s in sets)
        step = max(_widths(templates))
        for batch in batches:
            counts, out = [0] * len(vocabulary), []
            for doc_id, value in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text = value.as_py().encode()
                words, begins, blocks = [], [], []
                for line in text.split(b"\n"):
                    begins.append(len(words))
                    words += words_of(line)
                at = [i for i, w in enumerate(words) if w in known]
                # Of lines that begin at the same word all but the last are empty.
                lines = [bisect_right(begins, i) - 1 for i in at]
                low = 0
                while low < len(at):
                    block = at[low] // step
                    high = bisect_left(at, (block + 2) * step, low)
                    ids = [vocabulary[words[i]] for i in at[low:high]]
                    found = set(ids)
                    for w in found:
                        counts[w] += 1
                    if len(found) >= least:
                        own = lines[low:high]
                        blocks.append(
                            {
                                "block": block,
                                "words": list(found),
                                "ids": ids,
                                "places": at[low:high],
                                "lines": own,
                                "starts": [begins[n] for n in own],
                            }
                        )
                    low = bisect_left(at, (block + 1) * step, low)
                places, labels = _phrase_places(words, phrases)
                out.append(
                    {
                        "doc_id": doc_id,
                        "key": hashlib.sha256(text).hexdigest(),
                        "n_words": len(words),
                        "n_base": len(places),
                        "first_word": min(places, default=None),
                        "last_word": max(places, default=None),
                        "base_labels": labels,
                        "blocks": blocks,
                    }
                )
            out.append({"counts": counts})
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return run


def stretches(ids, places, body: frozenset, width: int):
    """Place in the lists and number of the body's words, for each stretch that begins with a word it holds once."""
    own = [i for i, w in enumerate(ids) if w in body]
    counts, end = {}, 0
    for i in own:
        while end < len(own) and places[own[end]] < places[i] + width:
            w = ids[own[end]]
            counts[w] = counts.get(w, 0) + 1
            end += 1
        if counts[ids[i]] == 1:
            yield i, len(counts)
            del counts[ids[i]]
        else:
            counts[ids[i]] -= 1


def _counted(templates, threshold):
    """Best containment by line of the stretches that begin in the first half of each block."""

    def run(batches):
        _, sets = _templates(templates)
        widths = _widths(templates)
        step = max(widths)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                body, best = sets[r["template"]], {}
                need, ends = needed(len(body), threshold), (r["block"] + 1) * step
                for i, n in stretches(r["ids"], r["places"], body, widths[r["template"]]):
                    if n >= need and r["places"][i] < ends:
                        line = r["lines"][i], r["starts"][i]
                        best[line] = max(n, best.get(line, 0))
                out += [
                    {"key": r["key"], "block": line, "start": start, "template": r["template"], "containment": n / len(body)}
                    for (line, start), n in best.items()
                ]
            yield pa.RecordBatch.from_pylist(out, _FOUND_SCHEMA)

    return run


_FOUND = "key string, block bigint, start bigint, template int, containment double"
_FOUND_SCHEMA = pa.schema(
    [
        ("key", pa.string()),
        ("block", pa.int64()),
        ("start", pa.int64()),
        ("template", pa.int32()),
        ("containment", pa.float64()),
    ]
)


def _matches(read: DataFrame, templates: tuple, threshold: float) -> DataFrame:
    """``(key, block, start, template, containment)`` of the lines where stretches begin that reach the threshold."""
    spark = read.sparkSession
    _, sets = _templates(templates)
    frequency = read.where("counts IS NOT NULL").select(F.posexplode("counts").alias("word", "blocks"))
    # One row for each word of the templates, a fixed list.
    seen = {r["word"]: r["n"] for r in frequency.groupBy("word").agg(F.sum("blocks").alias("n")).collect()}
    rank = {w: i for i, w in enumerate(sorted(frozenset().union(*sets), key=lambda w: (seen.get(w, 0), w)))}
    index, bodies = [], []
    for number, words in enumerate(sets):
        order, need = sorted(words, key=rank.__getitem__), needed(len(words), threshold)
        bodies.append((number, [rank[w] for w in order], need))
        index += [(rank[w], number, at, len(order), need) for at, w in enumerate(order[: len(order) - need + 1])]
    prefixes = spark.createDataFrame(index, "word int, template int, at int, size int, need int")
    bodies = spark.createDataFrame(bodies, "template int, body array<int>, need int")

    to_rank = F.array(*(F.lit(rank[w]) for w in sorted(rank)))
    # A text is one unit, however many documents hold it.
    texts = read.where("counts IS NULL AND size(blocks) > 0").groupBy("key").agg(F.any_value("blocks").alias("blocks"))
    blocks = texts.select("key", F.inline("blocks")).withColumn(
        "words", F.array_sort(F.transform("words", lambda w: F.get(to_rank, w)))
    )
    shared = blocks.select("*", F.posexplode("words").alias("pos", "word")).join(F.broadcast(prefixes), "word")
    room = 1 + F.least(F.col("size") - 1 - F.col("at"), F.size("words") - 1 - F.col("pos"))
    candidates = shared.where((F.size("words") >= F.col("need")) & (room >= F.col("need"))).select(
        "key", "block", "words", "ids", "places", "lines", "starts", "template"
    )
    overlap = F.size(F.array_intersect("words", "body"))
    held = (
        candidates.dropDuplicates(["key", "block", "template"])
        .join(F.broadcast(bodies), "template")
        .where(overlap >= F.col("need"))
        .select("key", "block", "ids", "places", "lines", "starts", "template")
    )
    # A line may reach into several blocks.
    lines = held.mapInArrow(_counted(templates, threshold), _FOUND).groupBy("key", "block", "start", "template")
    return lines.agg(F.max("containment").alias("containment"))


def _names(templates):
    return F.array(*(F.lit(label) for label, _ in templates))


def matching_blocks(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, block, start, label, template, containment)`` of every line of every document where a match begins."""
    read, found = _run(docs, templates, threshold)
    rows = read.where("counts IS NULL").select("doc_id", "key").join(found, "key")
    label = F.get(_names(templates), F.col("template"))
    return rows.select("doc_id", "block", "start", label.alias("label"), "template", "containment")


def _run(docs, templates, threshold):
    work = Scratch(docs.sparkSession, "license-scan")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    read = work.write(rows.mapInArrow(_read(templates, PHRASES, threshold), _ROW), "blocks")
    return read, work.write(_matches(read, templates, threshold), "matches")


def license_scan(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: phrases found, all labels, and the best containment.

    ``score`` is 1 where a phrase stands, else the largest containment of a
    matching stretch, else 0.
    """
    read, found = _run(docs, templates, threshold)
    texts = found.groupBy("key").agg(
        F.collect_set(F.get(_names(templates), F.col("template"))).alias("more"), F.max("containment").alias("best")
    )
    rows = read.where("counts IS NULL").drop("counts", "blocks").join(texts, "key", "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
