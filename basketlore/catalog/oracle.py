"""The catalog's queries as SQL for another engine.

Written as unrolled joins without candidates or pruning: every combination of
items that shares a basket is counted, then compared with the minimum count.
"""

from __future__ import annotations

from basketlore.catalog.fixtures import BRAND, CORE_LABELS, THRESHOLD_KEYS, TYPE
from basketlore.catalog.queries import CHUNKS, DENSE, LOW, SIZED, SPARSE, SUPPORTS

LINES = """lines AS (
  SELECT (CASE WHEN o_orderstatus = 'P' THEN 'C' ELSE '' END) || CAST(l_orderkey AS VARCHAR) AS InvoiceNo,
         l_orderkey AS basket_id,
         {item} AS StockCode,
         CASE WHEN p_size % 25 = 0 THEN NULL ELSE p_name END AS Description,
         CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN -l_quantity ELSE l_quantity END AS Quantity,
         CAST(o_custkey AS VARCHAR) AS CustomerID
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

CLEAN = """clean AS (
  SELECT * FROM lines
  WHERE NOT regexp_matches(InvoiceNo, '^[Cc]') AND Quantity > 0
    AND Description IS NOT NULL AND Description <> 'nan')"""

BASKETS = """qty AS (
  SELECT basket_id, StockCode AS item, sum(Quantity) AS qty FROM clean GROUP BY basket_id, StockCode),
b AS (
  SELECT * FROM qty
  WHERE basket_id IN (SELECT basket_id FROM qty GROUP BY basket_id HAVING count(*) > 1)),
whole AS (SELECT 0 AS chunk, * FROM b),
parts AS (SELECT basket_id % {chunks} AS chunk, * FROM b)"""

DICTIONARY = "dict AS (SELECT StockCode AS item, min(Description) AS description FROM clean GROUP BY StockCode)"

DEPTH = {BRAND: 3, TYPE: 6}
DENSE_DEPTH = 6

# Baskets of the other fixtures: ``counted`` gives the number of baskets, ``b`` what is mined.
DENSE_BASKETS = """attributes AS (
  SELECT l_orderkey AS basket_id, unnest(['flag=' || l_returnflag, 'brand=' || substr(p_brand, 7, 1), 'type=' || p_type]) AS item,
         l_quantity AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey),
summed AS (SELECT basket_id, item, sum(qty) AS qty FROM attributes GROUP BY basket_id, item),
b AS (SELECT * FROM summed WHERE basket_id IN (SELECT basket_id FROM summed GROUP BY basket_id HAVING count(*) > 1)),
counted AS (SELECT * FROM b)"""

SPARSE_BASKETS = """summed AS (
  SELECT l_orderkey AS basket_id, CAST(l_partkey AS VARCHAR) AS item, sum(l_quantity) AS qty
  FROM lineitem GROUP BY l_orderkey, l_partkey),
b AS (SELECT * FROM summed WHERE basket_id IN (SELECT basket_id FROM summed GROUP BY basket_id HAVING count(*) > 1)),
counted AS (SELECT * FROM b)"""

MESSY_BASKETS = """messy AS (
  SELECT CASE WHEN l_orderkey % 50 <> 0 THEN l_orderkey END AS basket_id, CASE WHEN p_size % 25 <> 0 THEN p_brand END AS item,
         l_quantity AS qty, l_linenumber
  FROM lineitem JOIN part ON l_partkey = p_partkey),
repeated AS (SELECT * FROM messy UNION ALL SELECT * FROM messy WHERE l_linenumber = 1),
counted AS (SELECT coalesce(basket_id, 0) AS basket_id FROM repeated),
b AS (SELECT coalesce(basket_id, 0) AS basket_id, item, sum(qty) AS qty FROM repeated WHERE item IS NOT NULL
      GROUP BY coalesce(basket_id, 0), item)"""

SIZED_BASKETS = """sold AS (
  SELECT basket_id, CAST(StockCode AS VARCHAR) AS item, sum(Quantity) AS qty FROM lines
  WHERE NOT regexp_matches(InvoiceNo, '^[Cc]') AND Quantity > 0 GROUP BY basket_id, StockCode),
b AS (SELECT * FROM sold WHERE basket_id IN (SELECT basket_id FROM sold GROUP BY basket_id HAVING count(*) > 1)),
counted AS (SELECT * FROM b)"""

CHUNKED = """whole AS (SELECT 0 AS chunk, * FROM b),
parts AS (SELECT basket_id % {chunks} AS chunk, * FROM b),
whole_counted AS (SELECT 0 AS chunk, basket_id FROM counted),
parts_counted AS (SELECT basket_id % {chunks} AS chunk, basket_id FROM counted)"""


def _over(baskets: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([baskets, CHUNKED.format(chunks=CHUNKS), *ctes]) + "\n"


def _with(item: str, *ctes: str) -> str:
    parts = [LINES.format(item=item), CLEAN, BASKETS.format(chunks=CHUNKS), *ctes]
    return "WITH " + ",\n".join(parts) + "\n"


def _least(mode: str, support: float, n: str = "count(DISTINCT basket_id)") -> str:
    share = f"CAST({n} AS DOUBLE) * CAST({support} AS DOUBLE)"
    return {"floor": f"greatest(1, floor({share}))", "exact": share, "ceil": f"ceil({share})"}[mode]


def _mined(tag: str, source: str, support: float, mode: str, depth: int, counted: str = "") -> list[str]:
    """``tag1`` to ``tagN``: frequent itemsets by length, columns i1..ik; ``counted`` has all baskets, if ``source`` has not."""
    ctes = [
        f"{tag}_least AS (SELECT chunk, {_least(mode, support)} AS least FROM {counted or source} GROUP BY chunk)"
    ]
    for k in range(1, depth + 1):
        items = ", ".join(f"t{j}.item AS i{j}" for j in range(1, k + 1))
        joins = "".join(
            f"\n  JOIN {source} t{j} ON t{j}.chunk = t1.chunk AND t{j}.basket_id = t1.basket_id"
            f" AND t{j - 1}.item < t{j}.item"
            for j in range(2, k + 1)
        )
        least_qty = "t1.qty" if k == 1 else "least(" + ", ".join(f"t{j}.qty" for j in range(1, k + 1)) + ")"
        group = ", ".join(f"t{j}.item" for j in range(1, k + 1))
        ctes.append(
            f"{tag}{k} AS (SELECT t1.chunk AS chunk, {items}, count(*) AS support,\n"
            f"    sum(ln(1 + {least_qty})) AS total_log_qty, max({least_qty}) AS max_qty\n"
            f"  FROM {source} t1{joins}\n"
            f"  JOIN {tag}_least m ON m.chunk = t1.chunk\n"
            f"  GROUP BY t1.chunk, {group}, m.least HAVING count(*) >= m.least)"
        )
    return ctes


def _key(k: int, alias: str = "") -> str:
    return " || '|' || ".join(f"{alias}i{j}" for j in range(1, k + 1))


def _all(tag: str, depth: int, columns: str, first: int = 1) -> str:
    return " UNION ALL ".join(
        f"SELECT {_key(k)} AS itemset, {k} AS length, {columns} FROM {tag}{k}"
        for k in range(first, depth + 1)
    )


def _candidates(tag: str, k: int) -> str:
    """Itemsets of ``k`` items all of whose shorter subsets are in ``tag``."""
    prefix = "".join(f" AND x.i{j} = y.i{j}" for j in range(1, k - 1))
    names = [f"x.i{j}" for j in range(1, k)] + [f"y.i{k - 1}"]
    joins, supports = "", ["x.support", "y.support"]
    for d in range(k - 2):
        rest = [n for p, n in enumerate(names) if p != d]
        match = " AND ".join(f"z{d}.i{j} = {n}" for j, n in enumerate(rest, start=1))
        joins += f" JOIN {tag}{k - 1} z{d} ON z{d}.chunk = x.chunk AND {match}"
        supports.append(f"z{d}.support")
    key = " || '|' || ".join(names)
    return (
        f"SELECT {key} AS itemset, least({', '.join(supports)}) AS min_support"
        f" FROM {tag}{k - 1} x JOIN {tag}{k - 1} y"
        f" ON x.chunk = y.chunk{prefix} AND x.i{k - 1} < y.i{k - 1}{joins}"
    )


def _levels(tag: str, depth: int) -> str:
    """(level, candidates, frequent) of one threshold."""
    rows = [
        f"SELECT 1 AS level, (SELECT count(DISTINCT item) FROM b) AS candidates,"
        f" (SELECT count(*) FROM {tag}1) AS frequent"
    ]
    rows += [
        f"SELECT {k}, (SELECT count(*) FROM ({_candidates(tag, k)}) c), (SELECT count(*) FROM {tag}{k})"
        for k in range(2, depth + 1)
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(rows)}) v WHERE candidates > 0"


def _sweep(item: str, mode: str = "floor") -> tuple[list[str], dict[float, str]]:
    tags = {s: f"s{n}_" for n, s in enumerate(SUPPORTS)}
    ctes = [c for s, tag in tags.items() for c in _mined(tag, "whole", s, mode, DEPTH[item])]
    return ctes, tags


def _named(tag: str, depth: int, first: int, dictionary: str = "dict") -> str:
    """Itemsets with the descriptions of their items."""
    parts = []
    for k in range(first, depth + 1):
        names = " || ' + ' || ".join(f"coalesce(d{j}.description, 'UNKNOWN')" for j in range(1, k + 1))
        joins = "".join(f" LEFT JOIN {dictionary} d{j} ON d{j}.item = f.i{j}" for j in range(1, k + 1))
        parts.append(
            f"SELECT {_key(k, 'f.')} AS itemset, {names} AS name, {k} AS length, f.support,"
            f" f.total_log_qty, f.max_qty FROM {tag}{k} f{joins}"
        )
    return " UNION ALL ".join(parts)


def _patterns(item: str, mode: str = "floor") -> list[str]:
    """``patterns``: the pattern table, unrounded."""
    return [
        *_mined("f", "whole", LOW, mode, DEPTH[item]),
        DICTIONARY,
        "patterns AS (SELECT name AS Itemset, support AS Support, total_log_qty / support AS Avg_Log_Qty,"
        ' max_qty AS Max_Qty, length AS Length, itemset AS "key"'
        f" FROM ({_named('f', DEPTH[item], 2)}) n)",
    ]


COUNT = "CAST(support AS BIGINT) AS support"
MEASURED = f"{COUNT}, round(total_log_qty, 6) AS total_log_qty, max_qty"
LINE_COLUMNS = "InvoiceNo, basket_id, StockCode, Description, Quantity, CustomerID"


def _itemsets(item: str, mode: str = "floor", columns: str = COUNT) -> str:
    return _with(item, *_mined("f", "whole", LOW, mode, DEPTH[item])) + _all("f", DEPTH[item], columns)


def _mined_over(baskets: str, support: float, mode: str, depth: int, columns: str = COUNT) -> str:
    mined = _mined("f", "whole", support, mode, depth, "whole_counted")
    return _over(baskets, *mined) + _all("f", depth, columns)


def _grown(support: float, mode: str, depth: int = DENSE_DEPTH) -> list[str]:
    """``f1`` to ``fN`` as ``_mined`` has them, every basket's subsets being grown item by item."""
    ctes = [
        """subsets AS (
  SELECT basket_id, item AS last, [item] AS items, qty FROM b
  UNION ALL
  SELECT s.basket_id, b.item, list_append(s.items, b.item), least(s.qty, b.qty)
  FROM subsets s JOIN b ON b.basket_id = s.basket_id AND b.item > s.last WHERE len(s.items) < %d)""" % depth,
        f"least_count AS (SELECT {_least(mode, support)} AS least FROM counted)",
        """frequent AS (
  SELECT items, count(*) AS support, sum(ln(1 + qty)) AS total_log_qty, max(qty) AS max_qty
  FROM subsets GROUP BY items HAVING count(*) >= (SELECT least FROM least_count))""",
    ]
    for k in range(1, depth + 1):
        items = ", ".join(f"items[{j}] AS i{j}" for j in range(1, k + 1))
        ctes.append(
            f"f{k} AS (SELECT 0 AS chunk, {items}, support, total_log_qty, max_qty FROM frequent WHERE len(items) = {k})"
        )
    return ctes


def _grown_over(mode: str, columns: str = COUNT) -> str:
    return _dense(DENSE, mode) + _all("f", DENSE_DEPTH, columns)


def _dense(support: float, mode: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([DENSE_BASKETS, *_grown(support, mode)]) + "\n"


def _son_sweep_local() -> list[str]:
    """``p0_cand`` and so on: candidates at each threshold."""
    return [c for n, s in enumerate(SUPPORTS) for c in _local(TYPE, "exact", s, f"p{n}_")]


def _exact_sweep(item: str, select: str) -> str:
    ctes, tags = _sweep(item, "exact")
    return _with(item, *ctes) + " UNION ALL ".join(
        f"SELECT CAST({s} AS DOUBLE) AS min_support, {select} FROM ({_all(tag, DEPTH[item], MEASURED)}) u" for s, tag in tags.items()
    )


def _swept_patterns() -> str:
    """``swept``: patterns of every threshold, unrounded."""
    ctes, tags = _sweep(TYPE)
    rows = " UNION ALL ".join(
        f"SELECT CAST({s} AS DOUBLE) AS min_support, * FROM ({_named(tag, DEPTH[TYPE], 2)}) n" for s, tag in tags.items()
    )
    swept = (
        "swept AS (SELECT min_support, name AS Itemset, support AS Support, total_log_qty / support AS Avg_Log_Qty,"
        f' max_qty AS Max_Qty, length AS Length, itemset AS "key" FROM ({rows}) r)'
    )
    return _with(TYPE, *ctes, DICTIONARY, swept)


def _one_level(item: str, k: int, columns: str = COUNT) -> str:
    return (
        _with(item, *_mined("f", "whole", LOW, "floor", k))
        + f"SELECT {_key(k)} AS itemset, {k} AS length, {columns} FROM f{k}"
    )


def _local(item: str, mode: str, support: float = LOW, tag: str = "p") -> list[str]:
    depth = DEPTH[item]
    return [
        *_mined(tag, "parts", support, mode, depth),
        f"{tag}_cand AS (SELECT DISTINCT itemset, length FROM ({_all(tag, depth, 'chunk')}) u)",
    ]


def _son_stats(item: str, mode: str) -> str:
    depth = DEPTH[item]
    return (
        _with(item, *_local(item, mode), *_mined("f", "whole", LOW, mode, depth))
        + f"SELECT {CHUNKS} AS num_partitions, (SELECT count(*) FROM p_cand) AS candidates_generated,"
        f" (SELECT count(*) FROM ({_all('f', depth, 'support')}) u) AS final_frequent_itemsets"
    )


def _son_summary() -> str:
    ctes, rows = [], []
    for n, s in enumerate(SUPPORTS):
        ctes += _local(BRAND, "exact", s, f"p{n}_") + _mined(f"f{n}_", "whole", s, "exact", DEPTH[BRAND])
        rows.append(
            f"SELECT CAST({s} AS DOUBLE) AS support, (SELECT count(*) FROM p{n}__cand) AS global_candidates,"
            f" (SELECT count(*) FROM ({_all(f'f{n}_', DEPTH[BRAND], 'support')}) u) AS total_itemsets"
        )
    return _with(BRAND, *ctes) + " UNION ALL ".join(rows)


def _swept(item: str, select: str) -> str:
    ctes, tags = _sweep(item)
    return _with(item, *ctes) + " UNION ALL ".join(
        f"SELECT {select} FROM ({_all(tag, DEPTH[item], COUNT)}) u".format(s=f"CAST({s} AS DOUBLE)", pct=s)
        for s, tag in tags.items()
    )


def _level_stats(item: str) -> str:
    ctes, tags = _sweep(item)
    return _with(item, *ctes) + " UNION ALL ".join(
        f"SELECT CAST({s} AS DOUBLE) AS min_support, * FROM ({_levels(tag, DEPTH[item])}) l"
        for s, tag in tags.items()
    )


def _pruning() -> str:
    depth, low = DEPTH[BRAND], min(SUPPORTS)
    ctes = [
        *_mined("f", "whole", low, "floor", depth),
        *_local(BRAND, "exact", low),
        *_mined("e", "whole", low, "exact", depth),
    ]
    return (
        _with(BRAND, *ctes)
        + "SELECT stage, candidates, frequent,"
        " round(CAST(frequent AS DOUBLE) / candidates, 6) AS kept_ratio FROM ("
        + f"SELECT 'Level ' || level AS stage, candidates, frequent FROM ({_levels('f', depth)}) l"
        " UNION ALL SELECT 'SON', (SELECT count(*) FROM p_cand),"
        f" (SELECT count(*) FROM ({_all('e', depth, 'support')}) u)) v"
    )


HISTOGRAM = """, ends AS (SELECT min(Max_Qty) AS low, max(Max_Qty) AS high FROM patterns),
edges AS (SELECT CAST(bin AS INTEGER) AS bin, low + bin * ((high - low) / 30) AS lo,
                 low + (bin + 1) * ((high - low) / 30) AS hi FROM range(30) r(bin), ends)
SELECT bin, round(lo, 6) AS bin_start, round(hi, 6) AS bin_end, count(Max_Qty) AS patterns
FROM edges LEFT JOIN patterns ON Max_Qty >= lo AND (Max_Qty < hi OR bin = 29) GROUP BY bin, lo, hi"""

DENSITY = """, ends AS (
  SELECT count(*) AS n, min(Max_Qty) AS low, max(Max_Qty) AS high,
         stddev_samp(Max_Qty) * pow(count(*), -0.2) AS bandwidth FROM patterns),
grid AS (SELECT CAST(point AS INTEGER) AS point, low + point * ((high - low) / 199) AS x, n, bandwidth
         FROM range(200) r(point), ends)
SELECT point, round(x, 6) AS max_qty,
       round(sum(exp(-pow((x - Max_Qty) / bandwidth, 2) / 2)) / (n * bandwidth * sqrt(2 * pi())), 6) AS density
FROM grid, patterns GROUP BY point, x, n, bandwidth"""


def _case(column: str, values: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN {column} % {len(values)} = {n} THEN '{v}'" for n, v in enumerate(values))
    return f"CASE {cases} END"


MAPS = """SELECT {by}Support, any_value(total_baskets) AS total_baskets, 'apriori' AS algorithm, count(*) AS itemsets,
       round(sum(value), 4) AS seconds, round({click}, 4) AS part1, round({view}, 4) AS part2
FROM joined GROUP BY {by}Support
UNION ALL
SELECT {by}Support, any_value(total_baskets), 'fpgrowth', count(*), round(sum(value), 4), round({click}, 4), round({view}, 4)
FROM joined GROUP BY {by}Support
UNION ALL
SELECT {by}Support, any_value(total_baskets), 'son', count(DISTINCT user_id),
       CASE WHEN Support <> '0.02' THEN round(sum(value), 4) END, round({purchase}, 4), round({signup}, 4)
FROM joined GROUP BY {by}Support"""


TIMINGS = f"""WITH timings AS (
  SELECT {_case('user_id', CORE_LABELS)} AS Cores, {_case('event_id', THRESHOLD_KEYS)} AS Support,
         event_type, user_id, value FROM events)
"""
LEVEL = (
    "CASE WHEN event_type = 'click' THEN '1' WHEN event_type = 'view' THEN '2'"
    " WHEN event_type = 'purchase' AND Support <> '0.03' THEN '3' WHEN event_type = 'signup' THEN '4' END"
)


def _seconds(kind: str) -> str:
    return f"sum(CASE WHEN event_type = '{kind}' THEN value END)"


def _scalability(algorithm: str) -> str:
    time = "sum(value)" if algorithm != "SON" else "CASE WHEN Support = '0.02' THEN 0 ELSE sum(value) END"
    return (
        f"SELECT Cores, '{algorithm}' AS Algorithm, CAST(Support AS DOUBLE) AS Support, {time} AS seconds"
        " FROM timings GROUP BY Cores, Support"
    )


def _maps(total: str, by: str = "") -> str:
    return (
        TIMINGS.rstrip()
        + f",\njoined AS (SELECT t.*, total_baskets FROM timings t JOIN ({total}) n ON {'n.Cores = t.Cores' if by else 'true'})\n"
        + MAPS.format(by=by, **{k: _seconds(k) for k in ("click", "view", "purchase", "signup")})
    )


SCALABILITY = " UNION ALL ".join(_scalability(a) for a in ("Apriori", "FP-Growth", "SON"))


def oracle_sql() -> dict[str, str]:
    total = '"Time (s)"'
    return {
        "scan_baskets": _with(BRAND)
        + "SELECT basket_id, string_agg(item, '|' ORDER BY item) AS itemset, CAST(count(*) AS INTEGER) AS length"
        " FROM b GROUP BY basket_id",
        "scan_lines": _with(BRAND)
        + "SELECT InvoiceNo, StockCode, Description, Quantity, CustomerID FROM lines",
        "scan_run_metrics": TIMINGS.rstrip()
        + f""",
totals AS (SELECT Support, count(*) AS total_itemsets FROM timings GROUP BY Support)
SELECT t.Support, any_value(total_itemsets) AS total_itemsets, level, count(*) AS candidates,
       count(DISTINCT user_id) AS frequent, round(sum(value), 4) AS seconds
FROM (SELECT *, {LEVEL} AS level FROM timings) t JOIN totals ON totals.Support = t.Support
WHERE level IS NOT NULL GROUP BY t.Support, level""",
        "scan_run_metrics_labeled": TIMINGS.rstrip()
        + f""",
totals AS (SELECT Cores, count(*) AS total_baskets FROM timings GROUP BY Cores)
SELECT t.Cores, Support, any_value(total_baskets) AS total_baskets, count(*) AS candidates,
       count(DISTINCT user_id) AS itemsets, round({_seconds('purchase')}, 4) AS phase1
FROM timings t JOIN totals ON totals.Cores = t.Cores GROUP BY t.Cores, Support""",
        "scan_lines_quoted": _with(BRAND)
        + "SELECT InvoiceNo, StockCode, '\"' || Description || '\", or' || chr(10) || StockCode || ',\"' AS Description,"
        " Quantity, CustomerID FROM lines",
        "scan_run_metrics_maps": _maps("SELECT count(*) AS total_baskets FROM timings"),
        "scan_run_metrics_labeled_maps": _maps(
            "SELECT Cores, count(*) AS total_baskets FROM timings GROUP BY Cores", "Cores, "
        ),
        "run_config": _with(BRAND)
        + f"SELECT 8 AS cores, {CHUNKS} AS partitions, '{','.join(map(str, SUPPORTS))}' AS supports,"
        " count(DISTINCT basket_id) AS total_baskets, 'lineitem' AS input_dataset FROM b",
        "filter_cancelled": _with(BRAND)
        + f"SELECT {LINE_COLUMNS} FROM lines WHERE NOT regexp_matches(InvoiceNo, '^[Cc]')",
        "filter_positive_qty": _with(BRAND) + f"SELECT {LINE_COLUMNS} FROM lines WHERE Quantity > 0",
        "clean_lines": _with(BRAND) + f"SELECT {LINE_COLUMNS} FROM clean",
        "basket_sets": _with(BRAND)
        + "SELECT basket_id, string_agg(item, '|' ORDER BY item) AS itemset FROM b GROUP BY basket_id",
        "basket_quantity_map": _with(BRAND)
        + "SELECT basket_id, string_agg(item || '=' || CAST(CAST(qty AS BIGINT) AS VARCHAR), ',' ORDER BY item)"
        " AS quantities FROM b GROUP BY basket_id",
        "qa_baskets": _with(BRAND)
        + "SELECT basket_id, string_agg(item, '|' ORDER BY item) AS items,"
        " string_agg(CAST(CAST(qty AS BIGINT) AS VARCHAR), '|' ORDER BY item) AS quantities"
        " FROM b GROUP BY basket_id",
        "invoice_item_qty": _with(BRAND) + "SELECT basket_id, item, qty FROM qty",
        "basket_counts": _with(BRAND)
        + "SELECT count(*) AS baskets, count(*) FILTER (n > 1) AS multi_item_baskets"
        " FROM (SELECT basket_id, count(*) AS n FROM qty GROUP BY basket_id) s",
        "prep_counts": _with(BRAND)
        + "SELECT (SELECT count(*) FROM lines) AS raw_records, (SELECT count(*) FROM clean) AS valid_records,"
        " (SELECT count(DISTINCT basket_id) FROM b) AS baskets",
        "item_dictionary": _with(BRAND, DICTIONARY) + "SELECT item, description FROM dict",
        "basket_chunks": _with(BRAND)
        + "SELECT CAST(chunk AS INTEGER) AS chunk, count(DISTINCT basket_id) AS baskets, count(*) AS items"
        " FROM parts GROUP BY chunk",
        "support_thresholds": _with(BRAND, "total AS (SELECT count(DISTINCT basket_id) AS n FROM b)")
        + " UNION ALL ".join(
            f"SELECT CAST({s} AS DOUBLE) AS min_support, n AS baskets, "
            + ", ".join(f"CAST({_least(m, s, 'n')} AS DOUBLE) AS {m}_count" for m in ("floor", "exact", "ceil"))
            + " FROM total"
            for s in SUPPORTS
        ),
        "support_thresholds_messy": _over(MESSY_BASKETS, "total AS (SELECT count(DISTINCT basket_id) AS n FROM counted)")
        + " UNION ALL ".join(
            f"SELECT CAST({s} AS DOUBLE) AS min_support, n AS baskets, "
            + ", ".join(f"CAST({_least(m, s, 'n')} AS DOUBLE) AS {m}_count" for m in ("floor", "exact", "ceil"))
            + " FROM total"
            for s in SUPPORTS
        ),
        "run_config_messy": _over(MESSY_BASKETS)
        + f"SELECT 8 AS cores, {CHUNKS} AS partitions, count(DISTINCT basket_id) AS total_baskets, 'lineitem' AS input_dataset"
        " FROM counted",
        "candidates_k4_dense": _dense(DENSE, "floor") + _candidates("f", 4),
        "apriori_dense": _grown_over("floor"),
        "qa_apriori_dense": _grown_over("floor", MEASURED),
        "fpgrowth_dense": _grown_over("ceil"),
        "son_dense": _grown_over("floor"),
        "qa_son_dense": _grown_over("exact", MEASURED),
        "level_stats_dense": _dense(DENSE, "floor") + _levels("f", DENSE_DEPTH),
        "apriori_sparse": _mined_over(SPARSE_BASKETS, SPARSE, "floor", 3),
        "fpgrowth_sparse": _mined_over(SPARSE_BASKETS, SPARSE, "ceil", 3),
        "apriori_messy": _mined_over(MESSY_BASKETS, LOW, "floor", DEPTH[BRAND]),
        "qa_apriori_messy": _mined_over(MESSY_BASKETS, LOW, "floor", DEPTH[BRAND], MEASURED),
        "son_messy": _mined_over(MESSY_BASKETS, LOW, "floor", DEPTH[BRAND]),
        "fpgrowth_messy": _mined_over(MESSY_BASKETS, LOW, "ceil", DEPTH[BRAND]),
        "son_local_messy": _over(MESSY_BASKETS, *_mined("p", "parts", LOW, "floor", DEPTH[BRAND], "parts_counted"))
        + f"SELECT CAST(chunk AS INTEGER) AS chunk, itemset, length, support FROM ({_all('p', DEPTH[BRAND], 'chunk, support')}) u",
        "itemset_names_unknown": "WITH "
        + ",\n".join(
            [
                LINES.format(item="p_size"),
                CLEAN,
                SIZED_BASKETS,
                CHUNKED.format(chunks=CHUNKS),
                *_mined("f", "whole", SIZED, "floor", 3),
                DICTIONARY.replace("SELECT StockCode AS item", "SELECT CAST(StockCode AS VARCHAR) AS item"),
            ]
        )
        + f"\nSELECT itemset, name, support FROM ({_named('f', 3, 1)}) n",
        "son_sweep": _exact_sweep(TYPE, "itemset, length, support, total_log_qty, max_qty"),
        "son_sweep_candidates": _with(TYPE, *_son_sweep_local())
        + " UNION ALL ".join(
            f"SELECT CAST({s} AS DOUBLE) AS min_support, itemset, length FROM p{n}__cand" for n, s in enumerate(SUPPORTS)
        ),
        "qa_sweep": _with(TYPE, *_sweep(TYPE)[0])
        + " UNION ALL ".join(
            f"SELECT CAST({s} AS DOUBLE) AS min_support, * FROM ({_all(tag, DEPTH[TYPE], MEASURED)}) u"
            for s, tag in _sweep(TYPE)[1].items()
        ),
        "qa_sweep_patterns": _swept_patterns()
        + 'SELECT min_support, Itemset, Support, round(Avg_Log_Qty, 6) AS Avg_Log_Qty, Max_Qty, Length, "key" FROM swept',
        "top_per_threshold": _swept_patterns()
        + 'SELECT min_support, CAST(place AS INTEGER) AS place, "key", Support, round(Avg_Log_Qty, 6) AS Avg_Log_Qty FROM ('
        'SELECT *, row_number() OVER (PARTITION BY min_support ORDER BY Avg_Log_Qty DESC, "key") AS place FROM swept) r'
        " WHERE place <= 3",
        "son_top_itemsets": _with(BRAND, *_patterns(BRAND, "exact"))
        + 'SELECT Itemset, Support, round(Avg_Log_Qty, 6) AS Avg_Log_Qty, Max_Qty, Length, "key"'
        ' FROM patterns ORDER BY Support DESC, "key" LIMIT 10',
        "max_qty_density_binned": "SELECT *, TRUE AS within_bound FROM (" + _with(TYPE, *_patterns(TYPE)).rstrip() + DENSITY + ") d",
        "apriori_level1": _one_level(BRAND, 1),
        "apriori_level2": _one_level(BRAND, 2),
        "apriori_level3": _one_level(TYPE, 3),
        "candidates_k2": _with(BRAND, *_mined("f", "whole", LOW, "floor", 1)) + _candidates("f", 2),
        "candidates_k3": _with(BRAND, *_mined("f", "whole", LOW, "floor", 2)) + _candidates("f", 3),
        "apriori": _itemsets(BRAND),
        "apriori_deep": _itemsets(TYPE),
        "fpgrowth": _itemsets(BRAND, "ceil"),
        "fpgrowth_deep": _itemsets(TYPE, "ceil"),
        "fpgrowth_summary": _with(TYPE, *_mined("f", "whole", LOW, "ceil", DEPTH[TYPE]))
        + f'SELECT count(*) AS "count", coalesce(max(length), 0) AS max_length'
        f" FROM ({_all('f', DEPTH[TYPE], 'support')}) u",
        "itemset_summary": _with(TYPE, *_mined("f", "whole", LOW, "floor", DEPTH[TYPE]))
        + f'SELECT count(*) AS "count", coalesce(max(length), 0) AS max_length'
        f" FROM ({_all('f', DEPTH[TYPE], 'support')}) u",
        "son_local": _with(BRAND, *_local(BRAND, "floor"))
        + f"SELECT CAST(chunk AS INTEGER) AS chunk, itemset, length, support"
        f" FROM ({_all('p', DEPTH[BRAND], 'chunk, support')}) u",
        "son_candidates": _with(BRAND, *_local(BRAND, "floor")) + "SELECT itemset, length FROM p_cand",
        "son": _itemsets(BRAND),
        "son_deep": _itemsets(TYPE),
        "son_stats": _son_stats(BRAND, "floor"),
        "qa_level1": _one_level(BRAND, 1, MEASURED),
        "qa_apriori": _itemsets(BRAND, columns=MEASURED),
        "qa_apriori_deep": _itemsets(TYPE, columns=MEASURED),
        "qa_level_stats": _with(BRAND, *_mined("f", "whole", LOW, "floor", DEPTH[BRAND]))
        + _levels("f", DEPTH[BRAND]),
        "qa_son": _itemsets(BRAND, "exact", MEASURED),
        "qa_son_deep": _itemsets(TYPE, "exact", MEASURED),
        "qa_son_stats": _son_stats(BRAND, "exact"),
        "support_sweep": _swept(TYPE, "{s} AS min_support, itemset, length, support"),
        "level_stats": _level_stats(TYPE),
        "level_stats_wide": _level_stats(BRAND),
        "apriori_summary": _swept(BRAND, "{s} AS min_support, count(*) AS total_itemsets"),
        "support_labels": _swept(
            BRAND, "printf('%.1f%%', CAST({pct} AS DOUBLE) * 100) AS label, count(*) AS total_itemsets"
        ),
        "son_summary": _son_summary(),
        "pruning_at_lowest_support": _pruning(),
        "itemset_names": _with(
            BRAND,
            *_mined("f", "whole", LOW, "floor", DEPTH[BRAND]),
            DICTIONARY,
            "short AS (SELECT * FROM dict WHERE item <> 'Brand#1')",
        )
        + f"SELECT itemset, name, support FROM ({_named('f', DEPTH[BRAND], 1, 'short')}) n",
        "pattern_table": _with(BRAND, *_patterns(BRAND))
        + 'SELECT Itemset, Support, round(Avg_Log_Qty, 6) AS Avg_Log_Qty, Max_Qty, Length, "key" FROM patterns',
        "top_itemsets": _with(BRAND, *_patterns(BRAND))
        + 'SELECT Itemset, Support, round(Avg_Log_Qty, 6) AS Avg_Log_Qty, Max_Qty, Length, "key"'
        ' FROM patterns ORDER BY Support DESC, "key" LIMIT 10',
        "top_volume_labels": _with(TYPE, *_patterns(TYPE))
        + "SELECT \"key\", CASE WHEN length(Itemset) > 30 THEN substr(Itemset, 1, 30) || '...' ELSE Itemset END"
        " AS label, Support, round(Avg_Log_Qty, 6) AS Avg_Log_Qty"
        ' FROM (SELECT * FROM patterns ORDER BY Avg_Log_Qty DESC, "key" LIMIT 3) t',
        "max_qty_histogram": _with(TYPE, *_patterns(TYPE)).rstrip() + HISTOGRAM,
        "max_qty_density": _with(TYPE, *_patterns(TYPE)).rstrip() + DENSITY,
        "total_times": TIMINGS
        + " UNION ALL ".join(
            f"SELECT Support, '{a}' AS Algorithm, round({t}, 4) AS {total} FROM timings GROUP BY Support"
            for a, t in (
                ("Apriori", "sum(value)"),
                ("FP-Growth", "sum(value)"),
                ("SON", "CASE WHEN Support = '0.02' THEN NULL ELSE sum(value) END"),
            )
        ),
        "apriori_breakdown": TIMINGS
        + f"SELECT Support, round({_seconds('click')}, 4) AS \"Level 1 (s)\","
        f" round({_seconds('view')}, 4) AS \"Level 2 (s)\","
        f" CASE WHEN Support = '0.03' THEN 0 ELSE round({_seconds('purchase')}, 4) END AS \"Level 3 (s)\""
        " FROM timings GROUP BY Support",
        "fpgrowth_breakdown": TIMINGS
        + f"SELECT Support, round({_seconds('click')}, 4) AS \"Build Time (s)\","
        f" round({_seconds('view')}, 4) AS \"Mine Time (s)\" FROM timings GROUP BY Support",
        "son_breakdown": TIMINGS
        + f"SELECT Support, round({_seconds('purchase')}, 4) AS \"Phase 1 (s)\","
        f" round({_seconds('signup')}, 4) AS \"Phase 2 (s)\" FROM timings GROUP BY Support",
        "scalability_summary": TIMINGS
        + 'SELECT Cores, Algorithm, Support, round(seconds, 4) AS "Total Time (s)"'
        f" FROM ({SCALABILITY}) u",
        "scalability_by_support": TIMINGS
        + "SELECT Support, Algorithm, "
        + ", ".join(
            f"round(max(CASE WHEN Cores = '{c}' THEN seconds END), 4) AS \"{c}\"" for c in CORE_LABELS
        )
        + f" FROM ({SCALABILITY}) u GROUP BY Support, Algorithm",
    }
