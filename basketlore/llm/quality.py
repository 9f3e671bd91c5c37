"""Quality classifier: hierarchical empirical Bayes.

Two faults are judged alike, low quality and toxicity. For each,

*evidence of the document* is a likelihood ratio. Words and a few structural
properties (shares of symbols, of capitals, of repeated words) are presence
features. Words are repeated within ``SPAN`` words; all stretches of that length
count, wherever they begin, by their mean and by the most repetitive one, so that
the share does not grow with the text. Those that are significantly more frequent
in faulty documents add their log odds ratio to a score; the share of faulty and
of other documents in each score band gives the ratio.

*evidence of the site* is a hierarchy of Beta priors: all documents, host, path
within the host. The expected number of faulty documents among all those of a
host is shrunk towards the global rate, that of a path towards its host; how
strongly follows from how much hosts, and paths, differ (method of moments). A
site of few documents thus has the rate of the level above.

The posterior log odds of a fault are those of the path plus the document's log
ratio. A document is kept if it is free of both faults with a probability of at
least ``KEEP``.

Only the word features are fitted on a sample of labelled rows, at most
``max_training`` of them; site rates cover all documents. Equal texts train once
for each label. Null texts count as empty, null hosts and paths as names of
their own; labels of null value and of unknown documents are ignored, of a
document labelled twice all labels count. Without labels everything is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlore.llm.shared import Scratch, text_of
from basketlore.llm.words import mixed, word_groups

MAX_TRAINING = 40_000
KEEP = 0.5
FAULTS = ("low", "toxic")
# A feature counts if it is this many standard deviations more frequent, in so many faulty documents.
LEAST_Z = 6.0
LEAST_FAULTY = 8
BANDS = (0.0, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)

_SYMBOLS = b"|#<>{}[]$%&*=!~^\\@_`"
_CAPITALS = bytes(range(65, 91))
# Words of a stretch in which repetition is looked for.
SPAN = 200
_SHARES = np.array([0.002, 0.01, 0.03, 0.1, 0.2, 0.4, 0.7])


def _repeated(words: np.ndarray) -> tuple[float, float]:
    """Share of repeated words in the text's stretches of SPAN words: mean and maximum over all of them."""
    span = min(words.size, SPAN)
    order = np.argsort(words, kind="stable")
    again = np.flatnonzero(words[order[1:]] == words[order[:-1]])
    before, here = order[again], order[again + 1]
    # A word repeats one before it in the stretches that begin at that one or earlier and still reach the word.
    first, last = np.maximum(here - span + 1, 0), np.minimum(before, words.size - span)
    fits = first <= last
    starts = words.size - span + 1
    steps = np.bincount(first[fits], minlength=starts + 1) - np.bincount(last[fits] + 1, minlength=starts + 1)
    shares = np.cumsum(steps)[:starts] / span
    return float(shares.mean()), float(shares.max())


def _structure(text: str, words: np.ndarray) -> list[int]:
    """Bands of the shares of symbols, capitals, repeated neighbours and repeated words (mean and maximum)."""
    data = text.encode()
    size = max(1, len(data))
    shares = (
        (size - len(data.translate(None, _SYMBOLS))) / size if data else 0.0,
        (size - len(data.translate(None, _CAPITALS))) / size if data else 0.0,
        float((words[1:] == words[:-1]).mean()) if words.size > 1 else 0.0,
        *(_repeated(words) if words.size >= 100 else (0.0, 0.0)),
    )
    return [16 * i + int(band) for i, band in enumerate(np.searchsorted(_SHARES, shares, side="right"))]


def _features(texts):
    """Hashes of the distinct features of each text."""
    texts = list(texts)
    for first, count, words, bounds in word_groups(texts):
        for i in range(count):
            own = words[bounds[i] : bounds[i + 1]]
            structure = mixed(np.array(_structure(texts[first + i], own), np.uint64) + np.uint64(1 << 40))
            yield np.unique(np.concatenate((own, structure)).view(np.int64))


def _count(batches):
    """Documents with each feature, in all and by fault."""
    names = ("feature", "n", *FAULTS)
    schema = pa.schema([(c, pa.int64()) for c in names])
    for batch in batches:
        faults = {f: np.array(batch[f].to_pylist(), bool) for f in FAULTS}
        every = list(_features(t.as_py() for t in batch["text"]))
        if not every:
            continue
        flat = np.concatenate(every)
        features, at = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(every)), [e.size for e in every])
        columns = [features, np.bincount(at)]
        columns += [np.bincount(at, weights=faults[f][owner]).astype(np.int64) for f in FAULTS]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)


def _scores(texts, weights) -> np.ndarray:
    """Sum of the weights of each text's features, a column for each fault."""
    features, values = weights
    found = np.zeros((len(texts), len(FAULTS)))
    if not features.size:
        return found
    for i, own in enumerate(_features(texts)):
        at = np.minimum(np.searchsorted(features, own), features.size - 1)
        found[i] = values[at[features[at] == own]].sum(axis=0)
    return found


def _bands(scores: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(BANDS), scores, side="left")


class Classifier:
    """Weights of features and log ratios of score bands; as many as the training rows can make significant."""

    def __init__(self, weights, ratios, rates):
        self.weights, self.ratios, self.rates = weights, ratios, rates

    def evidence(self, text):
        """Log likelihood ratio of each fault, as a struct column."""
        weights, ratios = self.weights, self.ratios

        @F.pandas_udf(", ".join(f"{f} double" for f in FAULTS))
        def ratio(texts: pd.Series) -> pd.DataFrame:
            bands = _bands(_scores(texts.tolist(), weights))
            return pd.DataFrame({f: ratios[i][bands[:, i]] for i, f in enumerate(FAULTS)})

        return ratio(text)


def training_rows(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> DataFrame:
    """``(text, low, toxic)`` of at most ``max_training`` labelled rows, chosen by a hash of the id."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select(
        F.col("doc_id").alias("label_id"), (F.col("quality") == 0).alias("low"), (F.col("toxic") == 1).alias("toxic")
    )
    # As many rows as the parameter says, whatever the size of the table.
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id", "low", "toxic").limit(max_training)
    rows = docs.select(F.col("doc_id"), text_of().alias("text"))
    found = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    return found.select("text", "low", "toxic").dropDuplicates()


def fit(work: Scratch, docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> Classifier:
    rows = work.write(training_rows(docs, labels, max_training), "training")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(f).alias(f) for f in FAULTS)).first()
    counts = rows.mapInArrow(_count, "feature bigint, " + ", ".join(f"{c} bigint" for c in ("n", *FAULTS)))
    counts = counts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n", *FAULTS)))
    n, significant, weights = max(1, totals["n"]), F.lit(False), []
    for fault in FAULTS:
        faulty = totals[fault]
        rate = min(max(faulty / n, 1e-9), 1 - 1e-9)
        z = (F.col(fault) - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
        counts_here = (z >= LEAST_Z) & (F.col(fault) >= LEAST_FAULTY)
        # Half a document on either side, in proportion to the feature's frequency.
        part = F.col("n") / n
        odds = F.log((F.col(fault) + part) / (faulty + 1)) - F.log((F.col("n") - F.col(fault) + part) / (n - faulty + 1))
        weights.append(F.when(counts_here, odds).otherwise(0.0).alias(f"w_{fault}"))
        significant = significant | counts_here
    table = counts.where(significant).select("feature", *weights).toArrow()
    features = table["feature"].to_numpy()
    order = np.argsort(features)
    values = np.stack([table[f"w_{f}"].to_numpy() for f in FAULTS], axis=1)[order] if features.size else np.zeros((0, 2))
    weights = (features[order], values)

    @F.pandas_udf("array<int>")
    def band(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_bands(_scores(texts.tolist(), weights)).astype(np.int32)))

    banded = rows.select(*FAULTS, band("text").alias("bands"))
    ratios = []
    for i, fault in enumerate(FAULTS):
        found = banded.groupBy(F.get("bands", F.lit(i)).alias("band")).agg(
            F.count_if(fault).alias("faulty"), F.count_if(~F.col(fault)).alias("other")
        )
        faulty, other = np.zeros(len(BANDS) + 1), np.zeros(len(BANDS) + 1)
        for r in found.collect():
            faulty[r["band"]], other[r["band"]] = r["faulty"], r["other"]
        # One pseudo-document, spread like all documents.
        spread = (faulty + other) / max(1, (faulty + other).sum())
        ratio = np.log((faulty + spread + 1e-9) / (faulty.sum() + 1)) - np.log((other + spread + 1e-9) / (other.sum() + 1))
        ratios.append(np.where(faulty + other > 0, ratio, 0.0) if faulty.sum() else np.full(len(BANDS) + 1, -20.0))
    work.drop(rows)
    rates = {f: (totals[f] + 0.5) / (n + 1) for f in FAULTS}
    return Classifier(weights, ratios, rates)


def _sigmoid(x):
    return 1 / (1 + F.exp(-x))


def _logit(p):
    return F.log(p) - F.log(1 - p)


def _strength(rate, groups: DataFrame, fault: str, parent) -> float:
    """Beta prior strength by moments: how much groups differ from their parent beyond chance."""
    p = F.col(fault) / F.col("n")
    expected = parent * (1 - parent) / F.col("n")
    found = groups.agg(
        F.sum(F.col("n") * ((p - parent) * (p - parent) - expected)).alias("extra"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("groups"),
    ).first()
    if not found["n"] or found["groups"] < 2:
        return 1e6
    variance = max(found["extra"] / found["n"], 1e-9)
    return min(max(rate * (1 - rate) / variance - 1, 1.0), 1e6)


def site_rates(work: Scratch, evidence: DataFrame, rates: dict[str, float]) -> DataFrame:
    """Posterior rates of each fault by host and path, of the rows ``(host, path, evidence)``.

    ``rates`` are the shares of faulty training rows, which turn a document's
    evidence into the expected number of faults it counts for. Expected faults are summed by path before anything is exchanged.
    """
    share = evidence.select(F.col("evidence.low").alias("low"), F.col("evidence.toxic").alias("toxic"), "host", "path")
    soft = share.select("host", "path", *(_sigmoid(_logit(F.lit(rates[f])) + F.col(f)).alias(f) for f in FAULTS))
    paths = soft.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f).alias(f) for f in FAULTS))
    paths = work.write(paths, "paths")
    totals = paths.agg(F.sum("n").alias("n"), *(F.sum(f).alias(f) for f in FAULTS)).first()
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", *FAULTS)))
    hosts = work.write(hosts, "hosts")
    rates = {f: min(max((totals[f] or 0) / max(1, totals["n"] or 0), 1e-6), 1 - 1e-6) for f in FAULTS}
    columns = []
    for f in FAULTS:
        m = _strength(rates[f], hosts, f, F.lit(rates[f]))
        columns.append(((F.col(f) + m * rates[f]) / (F.col("n") + m)).alias(f"host_{f}"))
    named = hosts.select(F.col("host").alias("site"), *columns)
    by_path = work.write(paths.join(named, F.col("host").eqNullSafe(F.col("site"))).drop("site"), "by-path")
    final = []
    for f in FAULTS:
        m = _strength(rates[f], by_path, f, F.col(f"host_{f}"))
        final.append(((F.col(f) + m * F.col(f"host_{f}")) / (F.col("n") + m)).alias(f"path_{f}"))
    found = by_path.select(
        F.col("host").alias("site_host"), F.col("path").alias("site_path"), *(f"host_{f}" for f in FAULTS), *final
    )
    return work.write(found, "sites")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    host: str = "source",
    path: str = "lang",
    max_training: int = MAX_TRAINING,
    carry: Column | None = None,
) -> DataFrame:
    """Every row of ``docs`` with the evidence, the site's rates, ``p_good`` and ``keep``.

    ``carry`` is returned as ``row``; by default it is a struct of all columns. It is
    written with the evidence, so that each text is scored once.
    """
    work = Scratch(docs.sparkSession, "quality")
    classifier = fit(work, docs, labels, max_training)
    judged = docs.select(
        (F.struct("*") if carry is None else carry).alias("row"),
        F.col(host).cast("string").alias("host"),
        F.col(path).cast("string").alias("path"),
        classifier.evidence(text_of()).alias("evidence"),
    )
    judged = work.write(judged, "judged")
    sites = site_rates(work, judged.select("host", "path", "evidence"), classifier.rates)
    here = F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path"))
    odds = {f: _logit(F.least(F.greatest(F.col(f"path_{f}"), F.lit(1e-6)), F.lit(1 - 1e-6))) + F.col(f"evidence.{f}") for f in FAULTS}
    good = F.lit(1.0)
    for f in FAULTS:
        good = good * (1 - _sigmoid(odds[f]))
    rows = judged.join(sites, here)
    return rows.withColumn("p_good", good).withColumn("keep", F.col("p_good") >= KEEP)


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: evidence, rates of its host and path, ``p_good``, ``keep``."""
    found = judge(docs.select("doc_id", "text", "source", "lang"), labels, carry=F.col("doc_id"))
    return found.select(
        F.col("row").alias("doc_id"),
        "host",
        "path",
        *(F.col(f"evidence.{f}").alias(f"evidence_{f}") for f in FAULTS),
        *(f"{level}_{f}" for f in FAULTS for level in ("host", "path")),
        "p_good",
        "keep",
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    return judge(docs, labels).where("keep").select("row.*")
