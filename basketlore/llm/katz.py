"""LM scoring: a Katz backoff model over words, learned and applied in the same exchanges.

The model, with w after h, counts c from the training documents, N tokens in all:

    P(w|h) = d2(c(h,w)) c(h,w) / c(h)      if the pair was seen,
             alpha(h) P(w)                 if h was seen but not the pair,
             P(w)                          if h was not seen
    P(w)   = d1(c(w)) c(w) / N             if w was seen, else what that leaves, for all unseen words together

d are Good-Turing discounts for counts up to 5; larger counts lose ``LEAST_DISCOUNT``, so that every
history has something left to give. alpha(h) makes the sum over all words exactly 1.

The logarithm of a text is a sum over its tokens, and every addend needs the counts of one word, one
pair or one history only. So each token travels once, to the partition of its word: there are all
pairs that end in the word, c(w) and P(w). Counts up to 5 are returned as numbers of tokens, as their
discounts are not known until all pairs are counted. Tokens of unseen pairs travel on to the partition
of their history, where alpha is put together. Texts are never exchanged, and tokens travel packed:
one row for a batch of documents and a partition.

Words of over 1 in ``HOT_SHARE`` tokens (at most so many) are dealt by pair instead, with their counts
at hand everywhere; pairs as frequent are not dealt at all but scored where they stand.

Words are told apart by 64-bit hashes. Null texts count as empty: their only token is the end.
Repeated rows each train and are each scored. A null id is in the training part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlore.llm.shared import Scratch, text_of
from basketlore.llm.words import mixed, word_groups

DISCOUNTED = 5
LEAST_DISCOUNT = 0.01
HOT_SHARE = 4096
HOT_LEAST = 1000
# Tokens packed together by a task, and tokens that one partition should hold.
BATCH_TOKENS = 1 << 21
PARTITION_TOKENS = 1_500_000

END = np.uint64(0x0123456789ABCDEF)
START = np.uint64(0xFEDCBA9876543210)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def _pair_key(words, histories):
    return mixed(words * _PAIR + histories)


def _lookup(table, values):
    """Positions in the sorted table, and which values are in it."""
    if not table.size:
        return np.zeros(values.size, np.int64), np.zeros(values.size, bool)
    at = np.minimum(np.searchsorted(table, values), table.size - 1)
    return at, table[at] == values


def _runs(batches, columns):
    """Runs of documents: tokens with their histories and document numbers, and the rows' other columns."""
    for batch in batches:
        for first, count, words, bounds in word_groups(t.as_py() for t in batch["text"]):
            sizes = np.diff(bounds)
            docs = np.repeat(np.arange(count, dtype=np.int32), sizes + 1)
            tokens = np.insert(words, bounds[1:], END)
            histories = np.empty_like(tokens)
            histories[1:] = tokens[:-1]
            histories[np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))] = START
            part = batch.slice(first, count)
            yield tokens, histories, docs, {c: part[c].to_pylist() for c in columns}


def _gathered(batches, columns):
    """Runs put together until they hold ``BATCH_TOKENS``."""
    held, size, docs = [], 0, 0

    def joined():
        tokens, histories, owners = (np.concatenate([h[i] for h in held]) for i in range(3))
        return tokens, histories, owners, {c: [v for h in held for v in h[3][c]] for c in columns}

    for tokens, histories, owners, rest in _runs(batches, columns):
        held.append((tokens, histories, owners + np.int32(docs), rest))
        size, docs = size + tokens.size, docs + len(rest[columns[0]])
        if size >= BATCH_TOKENS:
            yield joined()
            held, size, docs = [], 0, 0
    if held:
        yield joined()


def _count_words(batches):
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])
    for tokens, _, _, _ in _gathered(batches, ("held_out",)):
        words, n = np.unique(tokens, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], schema=schema)


def _count_hot_pairs(hot):
    """Pairs of two hot words; numbers of words, not hashes."""

    def run(batches):
        schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
        words = hot.value
        for tokens, histories, _, _ in _gathered(batches, ("held_out",)):
            w, w_hot = _lookup(words, tokens)
            h, h_hot = _lookup(words, histories)
            both = w_hot & h_hot
            pairs, n = np.unique(h[both] * words.size + w[both], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], schema=schema)

    return run


def good_turing(counts_of_counts: dict[int, int]) -> np.ndarray:
    """Discounts d of counts 1 to 5 (index 0 is unused); where the estimate fails, half a count is taken off."""
    n = [counts_of_counts.get(r, 0) for r in range(DISCOUNTED + 2)]
    found = np.ones(DISCOUNTED + 1)
    rest = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 1.0
    for r in range(1, DISCOUNTED + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        found[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return found


def discounted(counts: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    low = discounts[np.minimum(counts, DISCOUNTED)] * counts
    return np.where(counts > DISCOUNTED, counts - LEAST_DISCOUNT, low)


class _Unigrams:
    """What is known of words before pairs are counted; a few numbers and the hot words."""

    def __init__(self, total, vocabulary, counts_of_counts, large):
        self.total, self.vocabulary = total, vocabulary
        self.discounts = good_turing(counts_of_counts)
        kept = sum(float(discounted(np.array([r]), self.discounts)[0]) * n for r, n in counts_of_counts.items() if r <= DISCOUNTED)
        kept += large[1] - LEAST_DISCOUNT * large[0]
        self.unseen = 1 - kept / total if total else 1.0

    def log_probability(self, counts):
        seen = discounted(np.maximum(counts, 1), self.discounts) / max(1, self.total)
        return np.log10(np.where(counts > 0, seen, self.unseen))


def _pack(*arrays):
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


_ROW = (
    "kind string, part int, batch bigint, size bigint, a binary, b binary, c binary, d binary, "
    "history bigint, tokens bigint, counts array<bigint>, mass double"
)
_SCHEMA = pa.schema(
    [
        ("kind", pa.string()),
        ("part", pa.int32()),
        ("batch", pa.int64()),
        ("size", pa.int64()),
        ("a", pa.binary()),
        ("b", pa.binary()),
        ("c", pa.binary()),
        ("d", pa.binary()),
        ("history", pa.int64()),
        ("tokens", pa.int64()),
        ("counts", pa.list_(pa.int64())),
        ("mass", pa.float64()),
    ]
)


# Bytes of rows that are handed over together.
OUTPUT_BYTES = 1 << 22


def _rows(rows):
    """Batches of the rows, a few megabytes each."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(row.get(c) or b"") for c in "abcd")
        if size >= OUTPUT_BYTES:
            yield pa.RecordBatch.from_pylist(held, _SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _SCHEMA)


def _sums(batch, docs, score, base, known, low):
    """Addends of one batch's documents as a row; ``low`` counts tokens by the count of their pair."""
    size = int(docs.max()) + 1
    present = np.flatnonzero(np.bincount(docs, minlength=size))
    totals = [np.bincount(docs, weights=v, minlength=size)[present] for v in (score, base)]
    counts = np.stack(
        [np.bincount(docs, weights=(low == r), minlength=size)[present] for r in range(1, DISCOUNTED + 1)]
        + [np.bincount(docs, weights=known, minlength=size)[present]]
    ).astype(np.uint32)
    a, b, c, d = _pack(present.astype(np.uint32), *totals, counts)
    return {"kind": "sum", "batch": batch, "size": int(present.size), "a": a, "b": b, "c": c, "d": d}


def _addends(counts, pair_counts, is_end, unigrams):
    """Per token: what it adds to the score so far, to the base score, whether it is known."""
    pair = np.where(pair_counts > DISCOUNTED, np.log10(np.maximum(pair_counts, 1) - LEAST_DISCOUNT), 0.0)
    score = np.where(pair_counts > 0, pair, unigrams.log_probability(counts))
    # The word is the history of the token behind it: there its count divides.
    score -= np.where((counts > 0) & ~is_end, np.log10(np.maximum(counts, 1)), 0.0)
    return score, np.log10(counts + 1.0), counts > 0


def _deal(model, parts):
    """Pack the tokens of a batch of documents by partition; score the hot pairs on the spot."""

    def packed(batches):
        unigrams, hot, hot_counts, pairs, pair_counts = model.value
        seq = 0
        for tokens, histories, docs, rest in _gathered(batches, ("doc_id", "held_out")):
            batch = (TaskContext.get().partitionId() << 32) + seq
            seq += 1
            train = ~np.array(rest["held_out"], bool)
            w, w_hot = _lookup(hot, tokens)
            h, h_hot = _lookup(hot, histories)
            at, is_pair = _lookup(pairs, np.where(w_hot & h_hot, h * hot.size + w, -1))
            sizes = np.bincount(docs, minlength=train.size)
            ids = [i if i is not None else 0 for i in rest["doc_id"]]
            a, b, c, d = _pack(
                np.array(ids, np.int64),
                sizes.astype(np.int64),
                ~train,
                np.array([i is None for i in rest["doc_id"]]),
            )
            out = [{"kind": "docs", "part": batch % parts, "batch": batch, "size": train.size, "a": a, "b": b, "c": c, "d": d}]
            if is_pair.any():
                own = hot_counts[w[is_pair]]
                seen = pair_counts[at[is_pair]]
                score, base, known = _addends(own, seen, tokens[is_pair] == END, unigrams)
                low = np.where(seen > DISCOUNTED, 0, seen)
                out.append(_sums(batch, docs[is_pair], score, base, known, low) | {"part": batch % parts})
            yield from out
            left = ~is_pair
            tokens, histories, docs, w_hot = tokens[left], histories[left], docs[left], w_hot[left]
            target = np.where(w_hot, _pair_key(tokens, histories), mixed(tokens + _PAIR)) % np.uint64(parts)
            order = np.argsort(target, kind="stable")
            edges = np.searchsorted(target[order], np.arange(parts + 1))
            for part in range(parts):
                mine = order[edges[part] : edges[part + 1]]
                if not mine.size:
                    continue
                mine = mine[np.argsort(tokens[mine], kind="stable")]
                words, first = np.unique(tokens[mine], return_index=True)
                lengths = np.diff(np.append(first, mine.size)).astype(np.uint32)
                known, index = np.unique(histories[mine], return_inverse=True)
                small = np.uint16 if known.size < 1 << 16 else np.uint32
                owner = docs[mine].astype(np.uint16 if train.size < 1 << 16 else np.uint32)
                marked = train[docs[mine]]
                a, b, c, d = _pack(words, lengths, known, index.astype(small))
                row = {"kind": "tokens", "part": part, "batch": batch, "size": mine.size, "a": a, "b": b, "c": c, "d": d}
                # The owners and training marks follow the history numbers.
                row["d"] += owner.tobytes() + np.packbits(marked).tobytes()
                row["tokens"], row["history"] = small().itemsize, owner.itemsize
                yield row

    return lambda batches: _rows(packed(batches))


_WIDTH = {2: np.uint16, 4: np.uint32}


def _unpack_tokens(row):
    n, wide, owned = row["size"], row["tokens"], row["history"]
    words = np.repeat(np.frombuffer(row["a"], np.uint64), np.frombuffer(row["b"], np.uint32))
    data = row["d"]
    index = np.frombuffer(data, _WIDTH[wide], n)
    owner = np.frombuffer(data, _WIDTH[owned], n, n * wide)
    train = np.unpackbits(np.frombuffer(data, np.uint8, offset=n * (wide + owned)), count=n).astype(bool)
    return words, np.frombuffer(row["c"], np.uint64)[index], owner.astype(np.int64), train


def _score_words(model, parts):
    """All tokens of some words: count pairs, add up documents, and hand on what concerns histories."""

    def scored(batches):
        unigrams, hot, hot_counts, _, _ = model.value
        batch_of, held = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] != "tokens":
                    yield row
                else:
                    batch_of.append(row["batch"])
                    held.append(_unpack_tokens(row))
        if not held:
            return
        tokens, histories, train = (np.concatenate([x[i] for x in held]) for i in (0, 1, 3))
        words, word_at = np.unique(tokens, return_inverse=True)
        counts = np.bincount(word_at, weights=train, minlength=words.size).astype(np.int64)
        at, is_hot = _lookup(hot, words)
        if hot.size:
            counts = np.where(is_hot, hot_counts[at], counts)
        _, first, pair_at = np.unique(_pair_key(tokens, histories), return_index=True, return_inverse=True)
        pair_counts = np.bincount(pair_at, weights=train, minlength=first.size).astype(np.int64)

        own, seen = counts[word_at], pair_counts[pair_at]
        score, base, known = _addends(own, seen, tokens == END, unigrams)
        low = np.where(seen > DISCOUNTED, 0, seen)
        bounds = np.concatenate(([0], np.cumsum([x[0].size for x in held])))
        for i, batch in enumerate(batch_of):
            s = slice(bounds[i], bounds[i + 1])
            yield _sums(batch, held[i][2], score[s], base[s], known[s], low[s])

        # Seen pairs, summed by history.
        is_seen = pair_counts > 0
        pair_counts, first = pair_counts[is_seen], first[is_seen]
        before, at = np.unique(histories[first], return_inverse=True)
        bands = np.where(pair_counts > DISCOUNTED, 0, pair_counts)
        by_band = np.stack([np.bincount(at, weights=(bands == r), minlength=before.size) for r in range(DISCOUNTED + 1)], 1)
        total = np.bincount(at, weights=pair_counts, minlength=before.size).astype(np.int64)
        mass = np.bincount(at, weights=10 ** unigrams.log_probability(counts[word_at[first]]), minlength=before.size)
        by_count = np.bincount(np.minimum(pair_counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
        yield {"kind": "counts", "counts": by_count.tolist()}
        _, is_hot = _lookup(hot, before)
        for j in np.flatnonzero(is_hot):
            yield {
                "kind": "hot",
                "history": int(before[j].view(np.int64)),
                "tokens": int(total[j]),
                "counts": by_band[j].astype(int).tolist(),
                "mass": float(mass[j]),
            }
        rest = np.flatnonzero(~is_hot)
        for part, mine in _by_part(before[rest], parts):
            mine = rest[mine]
            a, b, c, d = _pack(before[mine], total[mine], by_band[mine].astype(np.uint32), mass[mine])
            yield {"kind": "history", "part": part, "size": mine.size, "a": a, "b": b, "c": c, "d": d}

        # Tokens of unseen pairs; those of hot histories need not meet anything.
        unseen = np.flatnonzero(seen == 0)
        owner = np.concatenate([x[2] for x in held])[unseen].astype(np.uint32)
        source = np.repeat(np.array(batch_of, np.int64), np.diff(bounds))[unseen]
        before = histories[unseen]
        _, is_hot = _lookup(hot, before)
        key = np.where(is_hot, mixed(source.view(np.uint64)), before)
        for part, mine in _by_part(key, parts):
            a, b, c = _pack(before[mine], source[mine], owner[mine])
            yield {"kind": "unseen", "part": part, "size": mine.size, "a": a, "b": b, "c": c}

    return lambda batches: _rows(scored(batches))


def _by_part(keys, parts):
    target = mixed(keys + _PAIR) % np.uint64(parts)
    order = np.argsort(target, kind="stable")
    found, first = np.unique(target[order], return_index=True)
    for part, mine in zip(found.tolist(), np.split(order, first[1:]), strict=True) if found.size else ():
        yield int(part), mine


def log_weights(by_band, mass, discounts):
    """log10 of alpha(h) c(h), from the numbers of seen pairs by count (0: over 5) and their words' mass.

    c(h) is in there because every token has divided by the count of its history already.
    """
    low = np.arange(1, DISCOUNTED + 1) * (1 - discounts[1:])
    left = by_band[:, 1:] @ low + LEAST_DISCOUNT * by_band[:, 0]
    return np.log10(left / (1 - mass))


def _back_off(discounts, hot_histories, hot_weights):
    """What tokens of unseen pairs add, from all seen pairs of their history."""

    def weighed(batches):
        stats, tokens = [], []
        for batch in batches:
            for row in batch.to_pylist():
                n = row["size"]
                if row["kind"] == "history":
                    bands = np.frombuffer(row["c"], np.uint32).reshape(n, DISCOUNTED + 1)
                    stats.append((np.frombuffer(row["a"], np.uint64), bands, np.frombuffer(row["d"], np.float64)))
                else:
                    kinds = ((row["a"], np.uint64), (row["b"], np.int64), (row["c"], np.uint32))
                    tokens.append(tuple(np.frombuffer(data, kind) for data, kind in kinds))
        if not tokens:
            return
        histories, weights = np.empty(0, np.uint64), np.empty(0)
        if stats:
            histories, at = np.unique(np.concatenate([s[0] for s in stats]), return_inverse=True)
            bands = np.concatenate([s[1] for s in stats])
            bands = np.stack([np.bincount(at, weights=bands[:, r]) for r in range(DISCOUNTED + 1)], 1)
            weights = log_weights(bands, np.bincount(at, weights=np.concatenate([s[2] for s in stats])), discounts)
        before, source, owner = (np.concatenate([t[i] for t in tokens]) for i in range(3))
        score = np.zeros(before.size)
        for known, value in ((histories, weights), (hot_histories, hot_weights)):
            at, found = _lookup(known, before)
            score[found] = value[at[found]]
        order = np.argsort(source, kind="stable")
        batches_here, first = np.unique(source[order], return_index=True)
        nothing = np.zeros(before.size, np.int64)
        for batch, mine in zip(batches_here.tolist(), np.split(order, first[1:]), strict=True):
            none = nothing[: mine.size]
            yield _sums(batch, owner[mine].astype(np.int64), score[mine], none, none, none)

    return lambda batches: _rows(weighed(batches))


_RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_sum double, score double"


def _finish(discounts, start_log):
    """Add up the rows of each batch; they come one batch after another."""

    def run(batches):
        schema = pa.schema(
            [
                ("doc_id", pa.int64()),
                ("held_out", pa.bool_()),
                ("n_tokens", pa.int64()),
                ("n_known", pa.int64()),
                ("base_sum", pa.float64()),
                ("score", pa.float64()),
            ]
        )
        low_logs = np.log10(np.arange(1, DISCOUNTED + 1) * discounts[1:])
        at, state = None, None

        def finished():
            docs, score, base, counts = state
            ids, sizes, held, null = docs
            total = score + low_logs @ counts[:DISCOUNTED] - start_log
            columns = [
                pa.array(ids, mask=null),
                pa.array(held),
                pa.array(sizes),
                pa.array(counts[DISCOUNTED].astype(np.int64)),
                pa.array(base),
                pa.array(total),
            ]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == "docs":
                    if state is not None:
                        yield finished()
                    n = row["size"]
                    docs = (
                        np.frombuffer(row["a"], np.int64),
                        np.frombuffer(row["b"], np.int64),
                        np.frombuffer(row["c"], bool),
                        np.frombuffer(row["d"], bool),
                    )
                    at, state = row["batch"], [docs, np.zeros(n), np.zeros(n), np.zeros((DISCOUNTED + 1, n))]
                    continue
                assert row["batch"] == at
                present = np.frombuffer(row["a"], np.uint32)
                state[1][present] += np.frombuffer(row["b"], np.float64)
                state[2][present] += np.frombuffer(row["c"], np.float64)
                state[3][:, present] += np.frombuffer(row["d"], np.uint32).reshape(DISCOUNTED + 1, -1)
        if state is not None:
            yield finished()

    return run


def in_held_out_part(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether the CRC of the id's text falls in the fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def katz_scores(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """Scores of all rows of ``docs`` by the model of those that are not ``held_out``.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "katz")
    held = in_held_out_part(F.col("doc_id")) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), text_of().alias("text"))
    train = rows.where("NOT held_out")

    words = train.mapInArrow(_count_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = work.write(words, "words")
    by_count = words.groupBy(F.least("n", F.lit(DISCOUNTED + 2)).alias("r")).agg(
        F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")
    )
    # One row for each count up to 6, and one for all above.
    found = {r["r"]: (r["words"], r["tokens"]) for r in by_count.collect()}
    total, vocabulary = sum(t for _, t in found.values()), sum(n for n, _ in found.values())
    large = [sum(found.get(r, (0, 0))[i] for r in (DISCOUNTED + 1, DISCOUNTED + 2)) for i in (0, 1)]
    unigrams = _Unigrams(total, vocabulary, {r: n for r, (n, _) in found.items() if r <= DISCOUNTED + 1}, large)

    # At most HOT_SHARE words, and then pairs, reach this share of all tokens.
    least = max(HOT_LEAST, -(-total // HOT_SHARE))
    table = words.where(F.col("n") >= least).toArrow()
    hot, hot_counts = table["word"].to_numpy().astype(np.int64).view(np.uint64), table["n"].to_numpy().astype(np.int64)
    order = np.argsort(hot)
    hot, hot_counts = hot[order], hot_counts[order]
    pairs = pair_counts = np.empty(0, np.int64)
    if hot.size:
        known = spark.sparkContext.broadcast(hot)
        counted = train.mapInArrow(_count_hot_pairs(known), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        table = counted.where(F.col("n") >= least).orderBy("pair").toArrow()
        pairs, pair_counts = table["pair"].to_numpy().astype(np.int64), table["n"].to_numpy().astype(np.int64)
    work.drop(words)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_TOKENS))
    model = spark.sparkContext.broadcast((unigrams, hot, hot_counts, pairs, pair_counts))
    dealt = rows.mapInArrow(_deal(model, parts), _ROW).repartitionById(parts, F.col("part"))
    # The pairs' and histories' counts and the documents' sums so far, a folder for each kind.
    scored = dealt.mapInArrow(_score_words(model, parts), _ROW)
    tables = work.write(scored, "counts", partition_by="kind")

    seen = tables.where("kind = 'counts'").select(F.posexplode("counts").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n"))
    discounts = good_turing({r["r"]: r["n"] for r in seen.collect() if r["r"] <= DISCOUNTED + 1})
    hot_histories, hot_weights = _hot_weights(tables, unigrams, hot, hot_counts, pairs, pair_counts, discounts)
    histories = tables.where("kind IN ('history', 'unseen')").repartitionById(parts, F.col("part"))
    backed = histories.mapInArrow(_back_off(discounts, hot_histories, hot_weights), _ROW)
    sums = tables.where("kind IN ('docs', 'sum')").unionByName(backed)
    training_docs = max(1, train.count())
    result = (
        sums.repartition(F.col("batch"))
        .sortWithinPartitions("batch", F.col("kind") == "sum")
        .mapInArrow(_finish(discounts, np.log10(training_docs)), _RESULT)
    )
    spread = float(np.log10(total + 1.0 * (vocabulary + 1))) if total else 0.0
    return result.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base_sum") - F.col("n_tokens") * F.lit(spread)).alias("base_score"),
        "score",
    )


def _hot_weights(tables, unigrams, hot, hot_counts, pairs, pair_counts, discounts):
    """Backoff weights of the hot histories, at most HOT_SHARE of them, their hot pairs included."""
    sums = [F.sum(F.get("counts", F.lit(r))).alias(f"n{r}") for r in range(DISCOUNTED + 1)]
    table = tables.where("kind = 'hot'").groupBy("history").agg(*sums, F.sum("mass").alias("mass")).toArrow()
    bands, mass = np.zeros((hot.size, DISCOUNTED + 1)), np.zeros(hot.size)
    at, _ = _lookup(hot, table["history"].to_numpy().astype(np.int64).view(np.uint64))
    if at.size and hot.size:
        bands[at] = np.stack([table[f"n{r}"].to_numpy() for r in range(DISCOUNTED + 1)], 1)
        mass[at] = table["mass"].to_numpy()
    if pairs.size:
        h, w = pairs // hot.size, pairs % hot.size
        probability = 10 ** unigrams.log_probability(hot_counts[w])
        bands[:, 0] += np.bincount(h, minlength=hot.size)
        mass += np.bincount(h, weights=probability, minlength=hot.size)
    used = bands.sum(axis=1) > 0
    return hot[used], log_weights(bands[used], mass[used], discounts)
