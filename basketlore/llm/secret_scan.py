"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The
ledger, Parquet in a folder, holds one row for each blob and rule version that
was ever scanned, with the spans found. A run takes the pairs of blob and rule
version that the ledger lacks, scans those blobs once however many paths hold
them, appends, and joins the findings back to all paths.

Matches are found left to right without overlap, as code point spans with an
exclusive end. Null texts count as empty; an empty blob is a blob like any
other. Repeated rows are each returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlore.llm.shared import Scratch, text_of

SPANS = "array<struct<start:bigint,`end`:bigint>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds the matches; those whose ``group`` has under ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The formats asked for. A run of hexadecimal digits is as long as
# it can be, so a least length in the pattern finds what dropping short runs would;
# the same holds for access keys.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
    ),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Public formats of tokens and of private key blocks.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = (*BASE_RULES, *MORE_RULES)


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of the rule's spans in the text.

    Splitting at the pattern gives the stretches between the matches; their
    lengths and those of the matches add up to positions.
    """
    pattern = F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    lengths = F.transform(gaps, lambda g: F.length(g).cast("bigint"))
    sizes = F.transform(matches, lambda m: F.length(m).cast("bigint"))
    # Folded from left to right: the end of the last match and the spans so far.
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("found"))
    steps = F.arrays_zip(F.slice(lengths, 1, F.size(sizes)).alias("gap"), sizes.alias("size"))
    folded = F.aggregate(
        steps,
        start,
        lambda acc, step: F.struct(
            (acc["at"] + step["gap"] + step["size"]).alias("at"),
            F.concat(
                acc["found"],
                F.array(
                    F.struct(
                        (acc["at"] + step["gap"]).alias("start"),
                        (acc["at"] + step["gap"] + step["size"]).alias("end"),
                    )
                ),
            ).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    if rule.least:
        long_enough = F.transform(
            F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.length(g) >= rule.least
        )
        folded = F.transform(
            F.filter(F.arrays_zip(folded.alias("span"), long_enough.alias("keep")), lambda p: p["keep"]),
            lambda p: p["span"],
        )
    return F.when(text.rlike(rule.pattern), folded).otherwise(F.array().cast(SPANS))


def _ledger(docs: DataFrame, path: str) -> DataFrame | None:
    try:
        return docs.sparkSession.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def scan_new(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what the ledger in folder ``ledger`` lacks, and append it: ``(blob, rule, spans)``."""
    texts = docs.select(text_of().alias("text")).select(F.sha2("text", 256).alias("blob"), "text")
    # Sorted by blob within each task, copies meet before anything is exchanged.
    blobs = texts.groupBy("blob").agg(F.any_value("text").alias("text"))
    known = _ledger(docs, ledger)
    wanted = F.array(*(F.lit(r.key) for r in rules))
    if known is None:
        todo = blobs.withColumn("todo", wanted)
    else:
        seen = known.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = (
            blobs.join(seen, "blob", "left")
            .withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
            .where(F.size("todo") > 0)
        )
    scans = (
        F.when(
            F.array_contains("todo", r.key),
            F.struct(F.lit(r.key).alias("rule"), spans_of(F.col("text"), r).alias("spans")),
        )
        for r in rules
    )
    found = todo.select("blob", F.inline(F.array_compact(F.array(*scans))))
    found.write.mode("append").parquet(ledger)


def findings(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, found)``: of the blobs in the ledger with findings, all spans of these rules by start."""
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    hits = (
        docs.sparkSession.read.parquet(ledger)
        .where(F.size("spans") > 0)
        .where(F.col("rule").isin(*(r.key for r in rules)))
        .select("blob", order[F.col("rule")].alias("rank"), F.explode("spans").alias("span"))
        .dropDuplicates(["blob", "rank", "span"])
    )
    one = F.struct(F.col("span.start").alias("start"), F.col("rank"), F.col("span.end").alias("end"))
    return hits.groupBy("blob").agg(
        F.transform(
            F.sort_array(F.collect_list(one)),
            lambda s: F.struct(kinds[s["rank"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
        ).alias("found")
    )


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` as ``row`` with its blob and ``found``, after scanning what is new."""
    scan_new(docs, ledger, rules)
    found = Scratch(docs.sparkSession, "secret-findings").write(findings(docs, ledger, rules), "findings")
    return _with_findings(docs.select(F.struct("*").alias("row"), F.sha2(text_of(), 256).alias("blob")), found)


def _with_findings(rows: DataFrame, found: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<kind:string,start:bigint,`end`:bigint>>")
    return rows.join(found, "blob", "left").withColumn("found", F.coalesce("found", none))


def secret_scan(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Counts and digests of the secrets in every document.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``, one row
    for each row of ``docs``. Without a ``ledger`` folder a new one is made.
    """
    work = Scratch(docs.sparkSession, "secret-scan")
    ledger = ledger or work.path("ledger")
    scan_new(docs, ledger)
    found = work.write(findings(docs, ledger), "findings")
    rows = _with_findings(docs.select("doc_id", F.sha2(text_of(), 256).alias("blob")), found)
    base = [r.kind for r in BASE_RULES]

    def joined(spans):
        one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(one, ",")

    def of_kind(*kinds):
        return F.filter("found", lambda s: s["kind"].isin(*kinds))

    return rows.select(
        "doc_id",
        *(F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in base),
        F.sha2(joined(of_kind(*base)), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
