import glob
import math
import os
import random
from itertools import combinations

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from basketlore import apriori, explode_baskets, fpgrowth, son
from basketlore.operators import candidates as candidates_module
from basketlore.operators import levels as levels_module
from basketlore.operators import son as son_module
from basketlore.operators.candidates import candidates
from basketlore.operators.fpgrowth import itemset_summary
from basketlore.operators.levels import count_extensions
from basketlore.plans.sweep import son_sweep, support_sweep, support_thresholds
from basketlore.sources.sinks import run_config
from basketlore.workspace import Workspace, broadcast_within, is_one_machine, shared_folder
from tests import brute

LONG = "basket_id bigint, item string, qty double"


def random_baskets(seed, n=50, items="abcdefg", most=5):
    rng = random.Random(seed)
    return {
        b: {i: float(rng.randint(1, 20)) for i in rng.sample(items, rng.randint(1, most))}
        for b in range(n)
    }


def long_form(spark, baskets):
    rows = [(b, i, q) for b, items in baskets.items() for i, q in items.items()]
    return spark.createDataFrame(rows, LONG)


def as_dict(itemsets):
    return {tuple(r["items"]): r["support"] for r in itemsets.collect()}


def supports(found):
    return {items: v[0] for items, v in found.items()}


@pytest.mark.parametrize(("seed", "ratio", "mode"), [(1, 0.1, "floor"), (2, 0.07, "exact")])
def test_apriori_matches_brute_force(spark, seed, ratio, mode):
    baskets = random_baskets(seed)
    expected = brute.mine(baskets, ratio, mode)
    plain = apriori(long_form(spark, baskets), ratio, mode)
    assert as_dict(plain.itemsets) == supports(expected)
    stats = [tuple(r)[:3] for r in plain.level_stats.orderBy("level").collect()]
    assert stats == brute.candidate_counts(baskets, expected)
    assert plain.total_itemsets == len(expected)


def test_measures_match_brute_force(spark):
    baskets = random_baskets(4)
    expected = brute.mine(baskets, 0.08, "floor")
    itemsets, _ = apriori(long_form(spark, baskets), 0.08, "floor", measures=True)
    found = {tuple(r["items"]): (r["support"], r["total_log_qty"], r["max_qty"]) for r in itemsets.collect()}
    assert found.keys() == expected.keys()
    for items, (n, logs, top) in expected.items():
        assert found[items][0] == n and found[items][2] == top
        assert found[items][1] == pytest.approx(logs)


@pytest.mark.parametrize(("mode", "chunks"), [("floor", 3), ("exact", 7)])
def test_son_equals_brute_force_for_any_chunking(spark, mode, chunks):
    baskets = random_baskets(5)
    expected = brute.mine(baskets, 0.1, mode)
    result = son(long_form(spark, baskets), 0.1, chunks, mode, measures=True)
    assert as_dict(result.itemsets) == supports(expected)
    logs = {tuple(r["items"]): r["total_log_qty"] for r in result.itemsets.collect()}
    assert all(logs[i] == pytest.approx(v[1]) for i, v in expected.items())
    local = set()
    for chunk in range(chunks):
        local |= brute.mine({b: v for b, v in baskets.items() if b % chunks == chunk}, 0.1, mode).keys()
    assert {tuple(r["items"]) for r in result.candidates.collect()} == local
    stats = result.stats.first()
    assert stats["num_partitions"] == chunks
    assert stats["candidates_generated"] == len(local)
    assert stats["final_frequent_itemsets"] == len(expected)


def test_son_with_more_chunks_than_baskets_and_text_keys(spark):
    baskets = random_baskets(6, n=5, most=3)
    items = long_form(spark, baskets).withColumn("basket_id", F.concat(F.lit("inv-"), "basket_id"))
    result = son(items, 0.4, 20, "floor")
    assert as_dict(result.itemsets) == supports(brute.mine(baskets, 0.4, "floor"))


def test_fpgrowth_matches_brute_force(spark):
    baskets = random_baskets(7)
    expected = brute.mine(baskets, 0.11, "ceil")
    found = fpgrowth(long_form(spark, baskets), 0.11)
    assert as_dict(found) == supports(expected)
    summary = itemset_summary(found).first()
    assert tuple(summary) == (len(expected), max(map(len, expected)))


def test_rounding_modes_differ_as_stated(spark):
    baskets = {n: {"z"} for n in range(10)}
    for n in (0, 1):
        baskets[n] = {"z", "a", "b"}
    baskets[2] = {"z", "a"}
    items = long_form(spark, {b: dict.fromkeys(v, 1.0) for b, v in baskets.items()})
    kept = {mode: as_dict(apriori(items, 0.25, mode).itemsets) for mode in ("floor", "exact", "ceil")}
    assert kept["floor"][("b",)] == 2
    assert kept["exact"] == kept["ceil"] == {("z",): 10, ("a",): 3, ("a", "z"): 3}
    assert as_dict(fpgrowth(items, 0.25)) == kept["ceil"]


def test_support_below_one_basket_keeps_everything(spark):
    baskets = random_baskets(8, n=6, most=3)
    items = long_form(spark, baskets)
    assert as_dict(apriori(items, 0.0001).itemsets) == supports(brute.mine(baskets, 0.0001, "floor"))


def test_empty_input(spark):
    items = spark.createDataFrame([], LONG)
    result = apriori(items, 0.1)
    assert result.itemsets.count() == 0
    assert [tuple(r)[:3] for r in result.level_stats.collect()] == [(1, 0, 0)]
    found = son(items, 0.1, 3)
    assert found.itemsets.count() == 0 and found.candidate_count == 0
    assert tuple(itemset_summary(fpgrowth(items, 0.1)).first()) == (0, 0)


def test_one_basket(spark):
    items = long_form(spark, {1: {"a": 2.0, "b": 3.0}})
    assert as_dict(apriori(items, 0.5).itemsets) == {("a",): 1, ("b",): 1, ("a", "b"): 1}


def test_array_baskets_count_empty_but_not_null(spark):
    rows = [(1, ["a", "b", "a"]), (2, ["a", "b"]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "id bigint, items array<string>")
    for items in (explode_baskets(df, basket_col="id"), explode_baskets(df)):
        result = apriori(items, 0.6, "exact")
        assert result.run.limits.total == 3
        assert as_dict(result.itemsets) == {("a",): 2, ("b",): 2, ("a", "b"): 2}
        assert as_dict(fpgrowth(items, 0.6)) == as_dict(result.itemsets)


def test_hot_basket_hot_item_and_copies(spark):
    """One item everywhere, one basket with every item, a third of the baskets equal."""
    rng = random.Random(9)
    names = [f"i{n:02d}" for n in range(14)]
    baskets = {b: {"i00": 1.0, **{i: 2.0 for i in rng.sample(names, 2)}} for b in range(80)}
    baskets |= {100 + b: {"i00": 1.0, "i01": 1.0, "i02": 1.0} for b in range(40)}
    baskets[500] = {i: 5.0 for i in names}
    expected = brute.mine(baskets, 0.05, "exact")
    items = long_form(spark, baskets)
    assert as_dict(apriori(items, 0.05, "exact").itemsets) == supports(expected)
    assert as_dict(son(items, 0.05, 4, "exact").itemsets) == supports(expected)


def test_wide_baskets_and_large_classes_are_split(spark, monkeypatch):
    """The same rows with every size limit at its smallest."""
    baskets = random_baskets(10, n=40, items="abcdefghij", most=9)
    expected = brute.mine(baskets, 0.1, "floor")
    monkeypatch.setattr(levels_module, "PAIRS_PER_TASK", 3)
    monkeypatch.setattr("basketlore.workspace.BROADCAST_LIMIT_BYTES", 30_000)
    monkeypatch.setattr(candidates_module, "CLASS_SIZE", 2)
    items = long_form(spark, baskets)
    result = apriori(items, 0.1, "floor", measures=True)
    assert as_dict(result.itemsets) == supports(expected)
    stats = [tuple(r)[:3] for r in result.level_stats.orderBy("level").collect()]
    assert stats == brute.candidate_counts(baskets, expected)
    assert as_dict(son(items, 0.1, 3, "floor").itemsets) == supports(expected)


def test_candidates_are_closed_under_subsets(spark):
    baskets = random_baskets(11)
    result = apriori(long_form(spark, baskets), 0.1)
    pairs = {c for c in as_dict(result.itemsets) if len(c) == 2}
    for row in candidates(result.levels[1].frequent, 3).collect():
        a, b, c = row["items"]
        assert {(a, b), (a, c), (b, c)} <= pairs


def test_sweep_equals_single_runs(spark):
    baskets = random_baskets(12)
    items = long_form(spark, baskets)
    ratios = (0.3, 0.12)
    swept = support_sweep(items, ratios)
    for ratio in ratios:
        single = apriori(items, ratio)
        at = F.col("min_support") == ratio
        assert as_dict(swept.itemsets.where(at)) == as_dict(single.itemsets)
        levels = swept.level_stats.where(at).orderBy("level").drop("min_support").collect()
        assert [tuple(r) for r in levels] == [
            tuple(r)[:3] for r in single.level_stats.orderBy("level").collect()
        ]
        assert swept.summary.where(at).first()["total_itemsets"] == single.total_itemsets


def test_thresholds_are_double_arithmetic(spark):
    items = spark.range(18338).select(F.col("id").alias("basket_id"), F.lit("a").alias("item"), F.lit(1.0).alias("qty"))
    rows = {r["min_support"]: r for r in support_thresholds(items).collect()}
    assert rows[0.025]["exact_count"] == 18338 * 0.025
    assert (rows[0.03]["floor_count"], rows[0.03]["ceil_count"]) == (550.0, 551.0)


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="support_mode"):
        apriori(long_form(spark, random_baskets(1)), 0.1, "round")


MESSY = [(1, "a", 1.0), (1, "a", 2.0), (1, "b", 1.0), (2, "b", 1.0), (2, None, 1.0), (None, "a", 1.0), (None, "b", 4.0), (None, "b", 1.0)]


@pytest.mark.parametrize("key", ["bigint", "string"])
@pytest.mark.parametrize(("ratio", "mode"), [(0.3, "floor"), (0.7, "ceil")])
def test_repeated_lines_and_lines_without_a_basket(spark, key, ratio, mode):
    items = spark.createDataFrame(MESSY, LONG).withColumn("basket_id", F.col("basket_id").cast(key))
    baskets = {1: {"a": 3.0, "b": 1.0}, 2: {"b": 1.0}, None: {"a": 1.0, "b": 5.0}}
    expected = brute.mine(baskets, ratio, mode)
    found = {tuple(r["items"]): (r["support"], r["max_qty"]) for r in apriori(items, ratio, mode, measures=True).itemsets.collect()}
    assert found == {c: (v[0], v[2]) for c, v in expected.items()}
    assert as_dict(son(items, ratio, 3, mode).itemsets) == supports(expected)
    assert as_dict(fpgrowth(items, ratio)) == supports(brute.mine(baskets, ratio, "ceil"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_only_candidates_are_counted_beyond_one_broadcast(spark, monkeypatch, limit):
    """{a, b}, {a, c}, {b, d} are frequent, no triple is a candidate but a, b, c and the like occur."""
    work = Workspace(spark, "test")
    rows = [(0, 1, [(i,) for i in range(6)])]
    baskets = work.write(spark.createDataFrame(rows, "chunk int, weight bigint, basket array<struct<code:bigint>>"), "baskets")
    pairs = [(0, a, b, [a, b]) for a, b in ((0, 1), (0, 4), (2, 3), (3, 5), (4, 5))]
    wanted = work.write(spark.createDataFrame(pairs, "chunk int, id bigint, code bigint, codes array<bigint>"), "wanted")
    monkeypatch.setattr("basketlore.workspace.BROADCAST_LIMIT_BYTES", limit)
    projection = levels_module.project_items(levels_module.split_wide(baskets.df, 6), wanted, False)
    counts = levels_module.count_extensions(projection, wanted, False)
    named = levels_module.named_counts(counts, wanted, "codes")
    assert {tuple(r["codes"]) for r in named.collect()} == {(a, b) for _, a, b, _ in pairs}
    assert {r["support"] for r in named.collect()} == {1}
    plan = _plan(named)
    assert plan.count("basket:array") == 1
    if limit:
        assert {(r["id"], r["code"]) for r in counts.collect()} == {(a, b) for _, a, b, _ in pairs}
        assert {r["id"] for r in projection.collect()} == {0, 2, 3, 4}
        assert "SortMergeJoin" not in plan
    else:
        # Counted in the tasks, then joined: one exchange of counts, none of baskets.
        assert "Broadcast" not in plan
        assert plan.index("SortMergeJoin") < plan.index("HashAggregate")


def test_every_limit_at_zero(spark, monkeypatch):
    """Nothing may be broadcast: the same results by shuffles, with a hot item and a hot prefix."""
    baskets = random_baskets(21, n=50, items="abcdefgh", most=7)
    baskets |= {b: {"a": 1.0} | baskets[b] for b in list(baskets)}
    expected = brute.mine(baskets, 0.1, "floor")
    monkeypatch.setattr("basketlore.workspace.BROADCAST_LIMIT_BYTES", 0)
    items = long_form(spark, baskets)
    assert as_dict(apriori(items, 0.1, "floor").itemsets) == supports(expected)


def test_tasks_hold_baskets_of_one_chunk(spark):
    """Layout: what a level shuffles is bounded by candidates of the task's chunk, not by all chunks'."""
    chunks = 9
    rows = [(b, f"i{i}", 1.0, b % chunks) for b in range(300) for i in range(b % 5 + 2)]
    items = spark.createDataFrame(rows, "basket_id bigint, item string, qty double, chunk int")
    codes = [(i, f"i{i}", 300) for i in range(6)]
    dictionary = Workspace(spark, "test").write(spark.createDataFrame(codes, "code bigint, item string, support bigint"), "words")
    for measures in (False, True):
        laid = levels_module.encode_baskets(items, dictionary, measures, chunks)
        tasks = laid.select(F.spark_partition_id().alias("task"), "chunk").distinct().collect()
        assert len(tasks) == len({r["task"] for r in tasks}) >= chunks
        assert _plan(laid).count("Exchange shufflepartitionid") == 1
        assert "hashpartitioning" not in _plan(laid)
    # Four sizes of baskets, each merged to one row a task.
    merged = levels_module.encode_baskets(items, dictionary, False, chunks)
    assert merged.agg(F.sum("weight")).first()[0] == 300
    assert merged.count() <= 5 * len(tasks)


def test_pruning_has_as_many_exchanges_at_every_length(spark, monkeypatch):
    monkeypatch.setattr("basketlore.workspace.BROADCAST_LIMIT_BYTES", 0)
    work = Workspace(spark, "test")
    plans = {}
    for k in (2, 3, 5):
        sets = list(combinations(range(8), k))
        number = {s: n for n, s in enumerate(combinations(range(8), k - 1))}
        rows = [
            (0, n, number[s[:-1]], s[-1], f"i{s[-1]}", list(s), [f"i{c}" for c in s], 10 + n)
            for n, s in enumerate(sets)
            if s != (1, 3, 5, 6, 7)[:k] or k == 2
        ]
        schema = "chunk int, id bigint, pid bigint, code bigint, item string, codes array<bigint>, items array<string>, support bigint"
        level = work.write(spark.createDataFrame(rows, schema), f"level{k}")
        found = candidates(level, k + 1)
        plans[k] = _plan(found)
        kept = {tuple(r[5]): r[7] for r in rows}
        expected = {
            c: min(kept[s] for s in combinations(c, k))
            for c in combinations(range(8), k + 1)
            if all(s in kept for s in combinations(c, k))
        }
        assert {tuple(r["codes"]): r["min_support"] for r in found.collect()} == expected
        assert 0 < len(expected)
    assert len({p.count("Exchange") for p in plans.values()}) == 1


def test_levels_are_mined_when_asked_for(spark):
    items = long_form(spark, random_baskets(11))
    result = apriori(items, 0.1, max_length=2)
    assert [v.length for v in result.levels] == [1, 2]
    assert {len(c) for c in as_dict(result.itemsets)} == {1, 2}


def _folders():
    return set(glob.glob(f"{shared_folder(SparkSession.getActiveSession())}/*".removeprefix("file:")))


def test_no_tables_left_after_a_failed_run(spark, monkeypatch):
    items = long_form(spark, random_baskets(11))
    before, write, fails = _folders(), Workspace.write, []

    def failing(self, df, name):
        if name == fails[-1]:
            df = df.withColumn("bad", F.raise_error(F.lit("lost")))
        return write(self, df, name)

    monkeypatch.setattr(Workspace, "write", failing)
    for name, run in (("level3", apriori), ("candidates3", apriori), ("itemsets", lambda i, s: son(i, s, 3))):
        fails.append(name)
        with pytest.raises(Exception, match="lost"):
            run(items, 0.1)
        assert _folders() == before


def test_only_tables_of_results_are_left(spark):
    items = long_form(spark, random_baskets(11))
    before = _folders()
    levels, chunked = apriori(items, 0.1), son(items, 0.1, 3)
    left = {os.path.basename(t) for f in _folders() - before for t in glob.glob(f"{f}/*")}
    assert {t.rstrip("0123456789") for t in left} == {"level", "union", "itemsets"}
    levels.close()
    chunked.close()
    assert _folders() == before


def test_son_sweep_equals_single_runs(spark):
    items = long_form(spark, random_baskets(12, n=60))
    ratios = (0.4, 0.2, 0.1)
    for mode in ("exact", "floor"):
        swept = son_sweep(items, 4, ratios, mode)
        summary = {r["min_support"]: tuple(r)[1:] for r in swept.summary.collect()}
        for ratio in ratios:
            single = son(items, ratio, 4, mode)
            at = F.col("min_support") == ratio
            assert as_dict(swept.itemsets.where(at)) == as_dict(single.itemsets)
            ours = {tuple(r["items"]) for r in swept.candidates.where(at).collect()}
            assert ours == {tuple(r["items"]) for r in single.candidates.collect()}
            assert summary[ratio] == (single.candidate_count, single.total_itemsets)


def test_fpgrowth_without_quantities(spark):
    items = long_form(spark, random_baskets(3))
    assert as_dict(fpgrowth(items.drop("qty"), 0.2)) == as_dict(fpgrowth(items, 0.2))


def test_one_number_of_baskets(spark):
    """Lines without a key are one basket in every report, as they are for the miners."""
    items = spark.createDataFrame(MESSY, LONG)
    assert apriori(items, 0.3).run.limits.total == 3
    assert {r["baskets"] for r in support_thresholds(items).collect()} == {3}
    assert run_config(items, 1, 1, [0.1]).first()["total_baskets"] == 3


def test_a_cluster_needs_a_shared_folder():
    assert all(is_one_machine(m) for m in ("local", "local[4]", "local[*]", "local[2, 3]"))
    assert not any(is_one_machine(m) for m in ("local-cluster[3,2,3000]", "yarn", "spark://host:7077", "k8s://host"))


def test_broadcasts_follow_measured_bytes(spark, monkeypatch):
    work = Workspace(spark, "test")
    long = work.write(spark.createDataFrame([(i, "x" * 2000) for i in range(50)], "a int, item string"), "long")
    short = work.write(spark.createDataFrame([(i, "x") for i in range(50)], "a int, item string"), "short")
    assert long.bytes > 100_000 > 10_000 > short.bytes
    monkeypatch.setattr("basketlore.workspace.BROADCAST_LIMIT_BYTES", 50_000)
    hinted = [broadcast_within(t)._jdf.queryExecution().logical().toString() for t in (long, short)]
    assert "broadcast" not in hinted[0].lower() and "broadcast" in hinted[1].lower()


@pytest.mark.parametrize("measures", [False, True])
def test_phase_two_counts_only_what_phase_one_has_not(spark, monkeypatch, measures):
    """Counts of chunks where a candidate is frequent are taken over; it is counted in the others."""
    counted = []

    def count(projection, wanted, *more):
        counted.append(sorted(wanted.df.select("chunk", "own").collect()))
        return count_extensions(projection, wanted, *more)

    monkeypatch.setattr(son_module, "count_extensions", count)
    even = [(k, item, 1.0 + k) for k in range(16) for item in "abcd"]
    found = son(spark.createDataFrame(even, "basket_id bigint, item string, qty double"), 0.5, 4, "exact", measures)
    assert found.total_itemsets == 15 and {r["support"] for r in found.itemsets.collect()} == {16}
    assert counted == []

    # In chunk 0 the pair (a, b) and all above it are missing.
    odd = [r for r in even if r[0] % 4 or r[0] == 0 or r[1] != "b"]
    found = son(spark.createDataFrame(odd, "basket_id bigint, item string, qty double"), 0.5, 4, "exact", measures)
    assert [len(c) for c in counted] == [3, 3, 1] and {r["chunk"] for c in counted for r in c} == {0}
    rows = {tuple(r["items"]): r for r in found.itemsets.collect()}
    assert {k: r["support"] for k, r in rows.items()} == {k: 13 if "b" in k else 16 for k in rows} and len(rows) == 15
    if measures:
        kept = [0, *(k for k in range(16) if k % 4)]
        assert rows["a", "b", "c"]["total_log_qty"] == pytest.approx(sum(math.log1p(1 + k) for k in kept))
        assert rows["a", "b", "c"]["max_qty"] == 16
