"""N-gram Jaccard join: pivots, Voronoi regions, triangle-inequality windows, recursion.

A document is the set of its distinct 5-word shingles. Jaccard distance is a
metric on such sets, and two documents link at a distance of at most 0.2. The
join is exact: it finds every link that connects two parts.

*Pivots of the first level* are the one-shingle sets. Documents without a common
shingle are at distance 1 from each other and from any document chosen as pivot,
so pivot documents alone would leave nearly all documents in one region. A
document's nearest one-shingle pivots are its own shingles, all at the same
distance; ties go to the pivot that comes first in one global order, rare
shingles before frequent ones. A partner within 0.2 must share at least 80 % of
the document's shingles, so its own nearest shared pivot lies in the first
fifth: the document is replicated to the regions of these pivots, its boundary
window, and to no others.

*Inside a region* a document is the pivot, the first member. All members learn
their distance to it, links are added, and by the triangle inequality
  - a member of the pivot's ball stays for the next round only if some member
    outside lies within 0.2 of it as far as the distances to the pivot can tell,
  - members further than 0.4 from the pivot cannot link to the ball at all,
  - a region whose members are all connected by now is finished.
The remainder takes the next pivot. A region still large after that is split by
its members' next one-shingle pivots, with a window one shingle longer. A small
one looks for the pairs of its members that may link: first for as few as join all
that may be connected, a spanning forest, and when these have been compared, for all
between the components that are left. No larger region is ever gathered in one task.

Distances are bounded before they are computed: a set's profile tells for each of
at least twice as many blocks of the universe as it has shingles whether it holds an
odd number there; the blocks in which two profiles differ are at most as many as the
symmetric difference, and nearly as many for sets that link or almost do.

Documents with equal sets are one class and joined as one. Documents without
words link with nothing. Null texts count as empty; repeated rows are linked to
each other by their equal sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlore.llm.components import components
from basketlore.llm.shared import Scratch, text_of
from basketlore.llm.words import mixed, word_groups

WORDS = 5
# Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
# The smallest set that can link to a different one: 4 of 5.
LEAST_SIZE = 4
# Levels of one-shingle pivots: sets that link share LEAST_SIZE shingles at least.
LEVELS = LEAST_SIZE
# Members of a region whose profiles are all compared with each other.
SMALL_REGION = 8192
# Rounds of pivot documents between two splits.
PIVOT_ROUNDS = 2
# Blocks of the smallest and largest profiles, powers of two.
PROFILE_LEAST, PROFILE_MOST = 256, 8192
# Frequent shingles are at most this many: they hold a share of all of at least its inverse.
FREQUENT = 1 << 22

_P = np.uint64(0xD6E8FEB86659FD93)


def _shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a document's words; all words together if there are fewer."""
    if not words.size:
        return words
    size_here = min(size, words.size)
    h = words[: words.size - size_here + 1].copy()
    for i in range(1, size_here):
        h = h * _P + words[i : words.size - size_here + 1 + i]
    return np.unique(mixed(h + np.uint64(size_here)))


def window(n: int) -> int:
    """Shingles of the boundary window: n less those that must be shared, and one."""
    return n - -(-PERCENT * n // 100) + 1


def _sets(batches):
    for batch in batches:
        for first, count, words, bounds in word_groups(t.as_py() for t in batch["text"]):
            yield batch, first, [_shingles(words[bounds[i] : bounds[i + 1]]) for i in range(count)]


def _count_together(batches):
    """Shingles in two and more documents of what one task holds at a time, with their number."""
    schema = pa.schema([("shingle", pa.int64()), ("docs", pa.int64()), ("total", pa.int64())])

    def counted(held):
        values = np.concatenate(held)
        held.clear()
        values.sort()
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        docs = np.diff(np.append(first, values.size))
        values, often = values[first], docs > 1
        total = np.zeros(often.sum() + 1, np.int64)
        total[-1] = docs.sum()
        found = np.append(values[often].view(np.int64), np.int64(0))
        return pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array(np.append(docs[often], 0)), pa.array(total)], schema=schema
        )

    held, size = [], 0
    for _, _, sets in _sets(batches):
        held += sets
        size += sum(s.size for s in sets)
        if size > 1 << 22:
            yield counted(held)
            held, size = [], 0
    if size:
        yield counted(held)


_SET_ROW = "doc_id bigint, key binary, digest binary, n bigint, anchors array<bigint>, profile binary"


def _describe(frequent):
    """Size, digest, first shingles in the global order, and profile of each document's set."""

    def run(batches):
        hot, docs = frequent.value
        schema = pa.schema(
            [
                ("doc_id", pa.int64()),
                ("key", pa.binary()),
                ("digest", pa.binary()),
                ("n", pa.int64()),
                ("anchors", pa.list_(pa.int64())),
                ("profile", pa.binary()),
            ]
        )
        for batch, first, sets in _sets(batches):
            anchors, profiles = [], []
            for found in sets:
                n = found.size
                if n < LEAST_SIZE:
                    anchors.append(found[:0].view(np.int64))
                    profiles.append(b"")
                    continue
                at = np.minimum(np.searchsorted(hot, found), max(hot.size - 1, 0))
                is_hot = hot[at] == found if hot.size else np.zeros(n, bool)
                often = found[is_hot]
                order = np.concatenate((found[~is_hot], often[np.argsort(docs[at[is_hot]], kind="stable")]))
                anchors.append(order[: window(n) + LEVELS - 1].view(np.int64))
                profiles.append(_profile(found))
            part = batch.slice(first, len(sets))
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"],
                    part["key"],
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([s.size for s in sets], pa.int64()),
                    pa.array(anchors, pa.list_(pa.int64())),
                    pa.array(profiles, pa.binary()),
                ],
                schema=schema,
            )

    return run


def _profile(found: np.ndarray) -> bytes:
    """A bit for each block: whether the set holds an odd number of its shingles."""
    blocks = PROFILE_LEAST
    while blocks < min(2 * found.size, PROFILE_MOST):
        blocks *= 2
    counts = np.bincount((found & np.uint64(blocks - 1)).astype(np.int64), minlength=blocks)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _profiles(values: list[bytes]):
    """Rows of profiles of each width, as ``(width, rows, profiles)`` in 64-bit words."""
    widths = np.fromiter(map(len, values), np.int64, len(values)) // 8
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        yield int(width), rows, np.frombuffer(b"".join([values[i] for i in rows]), np.uint64).reshape(-1, width)


def _folded(profiles: np.ndarray, width: int) -> np.ndarray:
    """The profiles of the same sets with fewer blocks."""
    while profiles.shape[-1] > width:
        half = profiles.shape[-1] // 2
        profiles = profiles[..., :half] ^ profiles[..., half:]
    return profiles


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Blocks in which profiles differ, at most the size of the symmetric difference."""
    width = min(x.shape[-1], y.shape[-1])
    return np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum(axis=-1, dtype=np.int64)


def _within(differ, total, percent):
    """Whether sets that differ in so many shingles at least may be within the distance.

    |x - y| + |y - x| >= differ, so the distance is at least 2 differ / (total + differ).
    """
    return 200 * differ <= percent * (total + differ)


def _bound_pairs(batches):
    """Mark the pairs that their profiles and sizes allow to be near."""
    for batch in batches:
        n_a, n_b = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
        apart = np.zeros(batch.num_rows, np.int64)
        left, right = batch["profile_a"].to_pylist(), batch["profile_b"].to_pylist()
        for _, rows, profiles in _profiles(left):
            for _, some, others in _profiles([right[i] for i in rows]):
                apart[rows[some]] = _apart(profiles[some], others)
        percent = np.where(batch["wide"].to_numpy(zero_copy_only=False), 2 * (100 - PERCENT), 100 - PERCENT)
        near = _within(np.maximum(apart, np.abs(n_a - n_b)), n_a + n_b, percent)
        columns = [*(batch[c] for c in ("a", "b", "n_a", "n_b", "wide")), pa.array(near)]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n_a", "n_b", "wide", "near"])


def _near_in_region(node, n, component, profiles, every):
    """Pairs of different components whose profiles allow a link: all, or a spanning forest of them.

    Yields arrays ``(a, b)``. A forest has fewer pairs than members.
    """
    _, group, sizes = np.unique(component, return_inverse=True, return_counts=True)
    # Of each width the rows, and their profiles; only neighbouring widths can link.
    wide = {width: (rows, found) for width, rows, found in _profiles(profiles)}
    narrow = {width: _folded(found, width // 2) for width, (_, found) in wide.items()}
    # Components that the pairs given so far join have one label.
    label = np.arange(sizes.size)
    # Members of the largest component have no links to look for among themselves.
    is_other = group != sizes.argmax()
    for width, (rows, found) in wide.items():
        for at, i in enumerate(rows):
            if not is_other[i]:
                continue
            near, bounds = [], []
            for other in (width // 2, width, 2 * width):
                if other not in wide:
                    continue
                members, theirs = wide[other][0], narrow[other] if other > width else wide[other][1]
                mine = narrow[width][at] if other < width else found[at]
                ahead = label[group[members]] != label[group[i]]
                if every:
                    # Of two rows outside the largest component the one of smaller number looks for the other.
                    ahead &= ~is_other[members] | (node[members] > node[i])
                seek = members[ahead]
                differ = np.maximum(_apart(theirs[ahead], mine), np.abs(n[seek] - n[i]))
                fits = _within(differ, n[seek] + n[i], 100 - PERCENT)
                near.append(seek[fits])
                bounds.append(differ[fits] / (n[seek[fits]] + n[i]))
            near = np.concatenate(near)
            if near.size and not every:
                # The nearest of each component, which is then joined.
                near = near[np.argsort(np.concatenate(bounds), kind="stable")]
                joined, first = np.unique(label[group[near]], return_index=True)
                near = near[first]
                label[np.isin(label, joined)] = label[group[i]]
            if near.size:
                yield np.minimum(node[near], node[i]), np.maximum(node[near], node[i])


def _near_in_regions(batches):
    """Pairs that may link, by region; the rows of a region come one after another."""
    schema = pa.schema([("region", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def near(region, rows):
        node, n, component, met = (np.concatenate([r[i] for r in rows]) for i in range(4))
        profiles = [p for r in rows for p in r[4]]
        for a, b in _near_in_region(node, n, component, profiles, met[0]):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(a.size, region)), pa.array(a), pa.array(b)], schema=schema)

    region, held = None, []
    for batch in batches:
        regions = batch["region"].to_numpy()
        columns = [batch[c].to_numpy(zero_copy_only=False) for c in ("node", "n", "component", "met")]
        columns.append(batch["profile"].to_pylist())
        edges = np.concatenate(([0], np.flatnonzero(np.diff(regions)) + 1, [regions.size]))
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            if start == end:
                continue
            if region != regions[start]:
                if held:
                    yield from near(region, held)
                region, held = regions[start], []
            held.append([c[start:end] for c in columns])
    if held:
        yield from near(region, held)


def _shingle_sets(batches):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    for batch, first, sets in _sets(batches):
        part = batch.slice(first, len(sets))
        values = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([part["node"], values], schema=schema)


def _frequent(work: Scratch, texts: DataFrame):
    """Frequent shingles and their numbers of documents, for the global order only.

    Any order is right; this one keeps passages that many documents share out of
    the windows. At most ``FREQUENT`` shingles reach the least number, whatever
    the size of the corpus.
    """
    together = work.write(texts.select("text").mapInArrow(_count_together, "shingle bigint, docs bigint, total bigint"), "together")
    total = together.agg(F.sum("total").alias("n")).first()["n"] or 0
    least = max(16, -(-total // FREQUENT))
    counts = together.where("docs > 0").groupBy("shingle").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    table = counts.toArrow()
    work.drop(together)
    shingles = table["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return work.spark.sparkContext.broadcast((shingles[order], table["docs"].to_numpy()[order]))


def _kinds(members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions of two, small ones that have met their pivot, and the others."""
    tiny, small = F.col("size") == 2, (F.col("size") <= SMALL_REGION) & (F.col("rounds") > 0)
    return members.where(tiny), members.where(small & ~tiny), members.where(~(tiny | small))


class _Join:
    """The state of one run: classes, their links and components, and what was compared."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.work = Scratch(self.spark, "ngram-join")
        text = text_of()
        self.rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))
        frequent = _frequent(self.work, self.rows)
        described = self.work.write(self.rows.mapInArrow(_describe(frequent), _SET_ROW), "described")
        self.sets = self.work.write(described.select("doc_id", "key", "digest", "n"), "sets")
        by_class = described.groupBy("digest", "n").agg(
            F.min("doc_id").alias("first_id"),
            F.any_value("key").alias("key"),
            F.any_value("anchors").alias("anchors"),
            F.any_value("profile").alias("profile"),
        )
        # Numbered when written, so a number stays with its class.
        self.classes = self.work.write(by_class.withColumn("node", F.monotonically_increasing_id()), "classes")
        self.work.drop(described)
        self.compared = self.shingles = self.labels = None

    # Regions

    def first_regions(self) -> DataFrame:
        """``(region, node, n, at, rounds, level, met)``: every class in the regions of its boundary window."""
        width = F.expr(f"n - (({PERCENT} * n + 99) div 100) + 1").cast("int")
        able = self.classes.where(F.col("n") >= LEAST_SIZE)
        marks = able.select("node", "n", F.posexplode(F.slice("anchors", F.lit(1), width)).alias("at", "region"))
        shared = marks.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("region")
        shared = self.work.write(shared, "shared")
        fresh = (F.lit(0).alias("rounds"), F.lit(1).alias("level"), F.lit(False).alias("met"))
        found = marks.join(shared, "region").select("region", "node", "n", "at", *fresh)
        found = self.work.write(found, "members")
        self.work.drop(shared)
        return found

    def labelled(self, members: DataFrame) -> DataFrame:
        """Add each member's component, the node itself if it has no link."""
        if self.labels is None:
            return members.withColumn("component", F.col("node"))
        return members.join(self.labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def open_regions(self, members: DataFrame) -> DataFrame:
        """Members of the regions that still hold two components, with the region's size and pivot."""
        named = self.work.write(self.labelled(members), "named")
        regions = named.groupBy("region").agg(
            F.count(F.lit(1)).alias("size"),
            F.min("node").alias("pivot"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
        )
        regions = self.work.write(regions.where("low < high").select("region", "size", "pivot"), "regions")
        found = self.work.write(named.join(regions, "region"), "open")
        self.work.drop(named, regions)
        return found

    def split(self, members: DataFrame) -> DataFrame:
        """Split regions by their members' next one-shingle pivots."""
        width = F.expr(f"n - (({PERCENT} * n + 99) div 100) + 1 + level").cast("int")
        rows = members.join(self.classes.select("node", "anchors"), "node")
        more = F.slice("anchors", F.col("at") + 2, F.greatest(width - F.col("at") - 1, F.lit(0)))
        steps = rows.select("region", "node", "n", "level", F.col("at").alias("before"), F.posexplode(more).alias("step", "next"))
        return steps.select(
            F.xxhash64("region", "next").alias("region"),
            "node",
            "n",
            (F.col("before") + 1 + F.col("step")).cast("int").alias("at"),
            F.lit(0).alias("rounds"),
            (F.col("level") + 1).alias("level"),
            F.lit(False).alias("met"),
        )

    # Distances

    def measure(self, pairs: DataFrame) -> None:
        """Distances of new pairs (a, b, wide); adds links, renews components.

        A distance is computed unless the profiles show that it is over 0.2, over
        0.4 if ``wide``; such pairs get none, or 1.
        """
        if self.compared is not None:
            pairs = pairs.join(self.compared.select("a", "b"), ["a", "b"], "left_anti")
        side = self.classes.select("node", "n", "profile")
        a, b = (side.select(*(F.col(c).alias(f"{c}_{x}") for c in side.columns)) for x in "ab")
        both = pairs.join(a, F.col("a") == F.col("node_a")).join(b, F.col("b") == F.col("node_b"))
        schema = "a bigint, b bigint, n_a bigint, n_b bigint, wide boolean, near boolean"
        both = both.select("a", "b", "n_a", "n_b", "wide", "profile_a", "profile_b")
        bounded = self.work.write(both.mapInArrow(_bound_pairs, schema), "bounded")
        todo = bounded.where("near").select("a", "b", "n_a", "n_b")
        sets = self._sets_of(todo.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        common = F.size(F.array_intersect("x", "y")).cast("bigint")
        exact = (
            todo.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
            .select("a", "b", common.alias("common"), (F.col("n_a") + F.col("n_b")).alias("total"))
            .select(
                "a",
                "b",
                (1 - F.col("common") / (F.col("total") - F.col("common"))).alias("distance"),
                (100 * F.col("common") >= PERCENT * (F.col("total") - F.col("common"))).alias("linked"),
            )
        )
        unknown = F.when(F.col("wide"), 1.0).alias("distance")
        far = bounded.where("NOT near").select("a", "b", unknown, F.lit(False).alias("linked"))
        new = self.work.write(exact.unionByName(far), "compared")
        self.work.drop(bounded)
        self.compared = new if self.compared is None else self.compared.unionByName(new)
        links, before = new.where("linked").select("a", "b"), self.labels
        if before is not None and links.isEmpty():
            return
        if before is not None:
            # What is connected already stands for the earlier links.
            links = links.union(before.select("node", "component"))
        self.labels = components(self.work, links)
        if before is not None:
            self.work.drop(before)

    def _sets_of(self, nodes: DataFrame) -> DataFrame:
        """Shingle sets of the classes to be compared; each is computed once."""
        if self.shingles is not None:
            nodes = self.work.write(nodes.join(self.shingles.select("node"), "node", "left_anti"), "nodes")
            if nodes.isEmpty():
                return self.shingles
        needed = nodes.join(self.classes.select("node", "key"), "node")
        # Copies meet in the task that reads them.
        texts = self.rows.groupBy("key").agg(F.any_value("text").alias("text"))
        rows = texts.join(needed, "key").select("node", "text")
        new = self.work.write(rows.mapInArrow(_shingle_sets, "node bigint, shingles array<bigint>"), "shingles")
        self.shingles = new if self.shingles is None else self.shingles.unionByName(new)
        return self.shingles

    def run(self) -> None:
        first = self.first_regions()
        members = self.open_regions(first)
        self.work.drop(first)
        while not members.isEmpty():
            _, small, rest = _kinds(members)
            within = self._within_small(small)
            pairs = self._pairs(members, within)
            self.measure(self.work.write(pairs.groupBy("a", "b").agg(F.max("wide").alias("wide")), "pairs"))
            # Regions of two, and small ones without a pair that may link, are done, and so are those
            # that have met, as all pairs between their components have been compared.
            after = self._remainder(rest)
            due = (F.col("rounds") >= PIVOT_ROUNDS) & (F.col("level") < LEVELS) & (F.col("size") > SMALL_REGION)
            following = after.where(~due).drop("size").unionByName(self.split(after.where(due)))
            again = small.where(~F.col("met")).join(within.select("region"), "region", "left_semi")
            following = following.unionByName(again.select(*following.columns).withColumn("met", F.lit(True)))
            following = self.open_regions(following)
            self.work.drop(members, within)
            members = following

    def _within_small(self, small: DataFrame) -> DataFrame:
        """``(region, a, b)``: a forest of the pairs that may link in small regions, all pairs where it has been compared."""
        rows = small.join(self.classes.select("node", "profile"), "node")
        rows = rows.select("region", "node", "n", "component", "met", "profile")
        rows = rows.repartition("region").sortWithinPartitions("region")
        return self.work.write(rows.mapInArrow(_near_in_regions, "region bigint, a bigint, b bigint"), "within")

    def _pairs(self, members: DataFrame, within: DataFrame) -> DataFrame:
        """Pairs to compare in this round, of different components.

        Most regions of three and more hold near copies: they are connected once
        all have met the pivot. Only then the members of the small ones meet.
        """
        likely = 100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m")
        tiny, _, rest = _kinds(members)
        left = tiny.select("region", F.col("node").alias("a"), "n", F.col("component").alias("ca"))
        right = tiny.select("region", F.col("node").alias("b"), F.col("n").alias("m"), F.col("component").alias("cb"))
        of_two = left.join(right, "region").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & likely)

        pivots = rest.where("node = pivot").select("region", F.col("component").alias("own"), F.col("n").alias("m"))
        # Only regions that go on with windows need distances beyond the ball.
        wide = F.col("size") > SMALL_REGION
        to_pivot = rest.join(pivots, "region").where((F.col("component") != F.col("own")) & (wide | likely))

        no = F.lit(False).alias("wide")
        return (
            of_two.select("a", "b", no)
            .union(to_pivot.select(F.col("pivot").alias("a"), F.col("node").alias("b"), wide.alias("wide")))
            .union(within.select("a", "b", no))
        )

    def _remainder(self, large: DataFrame) -> DataFrame:
        """Large regions without their pivot and what the triangle inequality settles."""
        ball = (100 - PERCENT) / 100
        named = self.labelled(large.drop("component"))
        distance = self.compared.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "distance")
        known = named.where("node <> pivot").join(distance, ["pivot", "node"], "left")
        own = named.where("node = pivot").select("region", F.col("component").alias("own"))
        rows = known.join(own, "region")
        inside = F.col("component") == F.col("own")
        # The nearest member that is not connected to the pivot yet.
        nearest = rows.where(~inside).groupBy("region").agg(F.min(F.coalesce("distance", F.lit(ball))).alias("nearest"))
        # Without a distance, as the pair was connected before it was compared, nothing is known;
        # of others it is at least known that they are outside the ball.
        stays = ~inside | F.col("distance").isNull() | (F.col("distance") > ball) | (F.col("nearest") <= F.col("distance") + ball + 1e-9)
        return (
            rows.join(nearest, "region")
            .where(stays)
            .select("region", "node", "n", "at", (F.col("rounds") + 1).alias("rounds"), "level", "met", "size")
        )


def _joined(docs: DataFrame) -> tuple[_Join, DataFrame]:
    join = _Join(docs)
    join.run()
    none = join.classes.select("node").where("false").select("node", F.col("node").alias("component"))
    labels = join.labels if join.labels is not None else none
    named = join.classes.select("node", "digest", "n", "first_id").join(labels, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    firsts = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = join.work.write(named.join(firsts, "component").select("digest", "n", "component_id"), "components")
    return join, classes


def ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row for each row of ``docs``.

    ``component_id`` is the smallest doc_id among those connected by links; the
    document's own without words. Null ids count only where a component has no other.
    """
    join, classes = _joined(docs)
    rows = join.sets.select("doc_id", "digest", "n").join(classes, ["digest", "n"])
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, the one of smallest doc_id, with all columns; all without words.

    Among rows that share that id, one stays, the first by content. Of components
    in which every id is null, one row for each different set stays.
    """
    join, classes = _joined(docs)
    rows = join.sets.select("doc_id", "key", "digest", "n").join(classes, ["digest", "n"])
    wordless = rows.where("n = 0").select("doc_id", "key").distinct()
    firsts = (
        rows.where("n > 0")
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        # The digest tells components of null ids apart.
        .groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("digest")).alias("tie"))
        .agg(F.min("key").alias("key"))
        .select(F.col("component_id").alias("doc_id"), "key")
    )
    kept = join.work.write(firsts.union(wordless), "kept")
    every = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.unhex(F.md5(text_of())).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("key"))
    stays = every.join(kept, same, "left_semi")
    with_words = F.length(F.trim(F.translate(text_of("row.text"), "\t\n\x0b\x0c\r", "     "))) > 0
    once = stays.where(with_words).dropDuplicates(["id", "hash"])
    return once.unionByName(stays.where(~with_words)).select("row.*")
