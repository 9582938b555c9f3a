"""Quality classifier with hierarchical empirical Bayes over sites.

1. Each document has a small vector of text measures.  A logistic model of them is fitted on labelled
   rows: all of them up to ``SAMPLE``, beyond that the ``SAMPLE`` rows whose ids hash lowest.
2. The evidence of a document is its label where it has one, and the classifier's probability elsewhere.
   Evidence is summed per path and per host (grouped aggregation over *all* documents, combined before the
   shuffle).  Host rates are shrunk toward the global rate and path rates toward their host's; how strongly
   follows from the observed spread between hosts, or between the paths of a host, by the method of moments,
   so that a sparse site keeps its parent's rate.
3. A document's log odds are the classifier's plus the site's, which is the path posterior without this
   document's own share, against the global rate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, checkpoint, documents

#: Labelled rows that the classifier is fitted on at most.
SAMPLE = 20_000
#: Sites up to which their table (under 100 bytes a row) is broadcast.
BROADCAST_SITES = 100_000
#: Probability below which a document is rejected.
CUT = 0.5
#: Limits of a site's prior weight, in documents.
WEIGHTS = (2.0, 1e6)

MEASURES = (
    "log_words", "upper", "digits", "marks", "bars", "bangs", "signs", "distinct", "repeats", "word_length", "lines", "stops", "no_words",
)

_KINDS = np.zeros(256, np.uint8)
for _kind, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "|", "!", "%$#&*", "\n", ".,", "\"'()-/:;<=>?@[\\]^_`{}~+"), 1):
    for _c in _chars:
        _KINDS[ord(_c)] = _kind


def measures(text: str) -> list[float]:
    """Measures of one whole text, in the order of ``MEASURES``."""
    raw = text.encode(errors="replace")
    kinds = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=9).tolist()
    size = max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    # Distinct words follow the length; against the square root of it they hardly do.
    distinct = len(set(words)) / n if n <= 20 else len(set(words)) / (n**0.8) * 20**-0.2
    return [
        float(np.log1p(len(words))), kinds[1] / size, kinds[2] / size, kinds[8] / size, kinds[3] / n, kinds[4] / n, kinds[5] / n,
        distinct, repeats / n, min(40.0, len(text) / n), kinds[6] / n, kinds[7] / n, float(not words),
    ]


def _measured(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: measures(t or ""))


def measured(text: Column) -> Column:
    return F.pandas_udf(_measured, T.ArrayType(T.DoubleType()))(text)


@dataclass(frozen=True)
class Classifier:
    """Logistic model of the measures; ``rate`` is the share of good documents among the labelled ones."""

    weights: tuple[float, ...]
    bias: float
    rate: float

    def log_odds(self, x: Column) -> Column:
        out = F.lit(self.bias)
        for i, w in enumerate(self.weights):
            out = out + F.lit(w) * x[i]
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> Classifier:
    """Newton's method with a ridge on standardised measures; a constant model for a single class."""
    rate = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < rate < 1:
        return Classifier((0.0,) * x.shape[1], float(np.log((len(y) * rate + 1) / (len(y) * (1 - rate) + 1))), rate)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1.0
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    w[-1] = np.log(rate / (1 - rate))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty @ w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    scaled = w[:-1] / spread
    return Classifier(tuple(map(float, scaled)), float(w[-1] - scaled @ mean), rate)


def _probability(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), log_odds))))


def _logit(p: Column) -> Column:
    inside = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(inside / (1 - inside))


def _weight(sites: DataFrame, count: str, good: str, parent: Column) -> float:
    """Prior weight, in documents, of a parent's rate for its sites, by the method of moments.

    With n documents of mean p around a parent's rate m, the expected square (p - m)^2 is
    m (1 - m) (1/n + (1 - 1/n) / (w + 1)); summed over sites this gives the weight w.
    """
    n, p = F.col(count), F.col(good) / F.col(count)
    spread = F.sum(n * ((p - parent) * (p - parent) - parent * (1 - parent) / n))
    most = F.sum(n * parent * (1 - parent) * (1 - 1 / n))
    row = sites.agg(spread.alias("a"), most.alias("b")).first()
    if not row["a"] or not row["b"] or row["a"] <= 0:
        return WEIGHTS[1]
    return float(min(WEIGHTS[1], max(WEIGHTS[0], row["b"] / row["a"] - 1)))


@dataclass(frozen=True)
class SiteModel:
    """Everything that scoring needs: the classifier, the sites and the prior weights."""

    classifier: Classifier
    sites: DataFrame  # host, path, path_n, path_good, host_n, host_good
    rate: float
    host_weight: float
    path_weight: float
    small: bool

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, key, p_doc, host_rate, path_rate, p_quality of the rows that the sites were counted from."""
        near = (F.broadcast(self.sites) if self.small else self.sites).alias("s")
        on = F.col("d.host").eqNullSafe(F.col("s.host")) & F.col("d.path").eqNullSafe(F.col("s.path"))
        own = F.coalesce(F.col("label"), F.col("p_doc"))
        out = docs.withColumn("p_doc", _probability(self.classifier.log_odds(F.col("x")))).alias("d").join(near, on, "left")
        # Leave this document out of its own site's evidence.
        host_rate = (F.col("host_good") - own + self.host_weight * self.rate) / (F.col("host_n") - 1 + self.host_weight)
        out = out.withColumn("host_rate", F.coalesce(host_rate, F.lit(self.rate)))
        path_rate = (F.col("path_good") - own + self.path_weight * F.col("host_rate")) / (F.col("path_n") - 1 + self.path_weight)
        out = out.withColumn("path_rate", F.coalesce(path_rate, F.col("host_rate")))
        site = _logit(F.col("path_rate")) - float(np.log(self.rate / (1 - self.rate)))
        out = out.withColumn("p_quality", _probability(_logit(F.col("p_doc")) + site))
        return out.select("doc_id", "key", "p_doc", "host_rate", "path_rate", "p_quality")


def labelled(measured_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, key, host, path, x) with ``label``, the average of an id's labels, 0 to 1; null without any."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
    known = known.agg(F.avg(F.col("quality").cast("double")).alias("label"))
    return measured_docs.join(known, "doc_id", "left").select("doc_id", "key", "host", "path", "x", "label")


def fit_sites(docs: DataFrame, sample: int = SAMPLE, broadcast_sites: int = BROADCAST_SITES) -> SiteModel:
    """Fit on rows (doc_id, key, host, path, x, label) as :func:`labelled` gives them."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    found = docs.where("label IS NOT NULL").select(place.alias("place"), "doc_id", "x", F.col("label").alias("quality"))
    count = found.count()
    if count > sample:  # so that tasks don't each send a full sample
        found = found.where(F.col("place") < int((1 << 31) * min(1.0, sample / count * 1.1 + 1000 / count)))
    rows = found.orderBy("place", "doc_id").limit(sample).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(MEASURES))
    classifier = fit_logistic(x, np.array([float(r["quality"] >= 0.5) for r in rows]))
    evidence = F.coalesce(F.col("label"), _probability(classifier.log_odds(F.col("x"))))
    paths = docs.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum(evidence).alias("path_good"))
    paths = checkpoint(paths)
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_good").alias("host_good"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    rate = min(1 - 1e-3, max(1e-3, (total["good"] or 0.0) / total["n"])) if total["n"] else 0.5
    host_weight = _weight(hosts, "host_n", "host_good", F.lit(rate))
    shrunk = (F.col("host_good") + host_weight * rate) / (F.col("host_n") + host_weight)
    both = paths.alias("a").join(hosts.withColumn("host_rate", shrunk).alias("b"), F.col("a.host").eqNullSafe(F.col("b.host")))
    both = both.select("a.host", "path", "path_n", "path_good", "host_n", "host_good", "host_rate")
    path_weight = _weight(both, "path_n", "path_good", F.col("host_rate"))
    return SiteModel(classifier, both.drop("host_rate"), rate, host_weight, path_weight, paths.count() <= broadcast_sites)


def site_of(url: Column) -> tuple[Column, Column]:
    """Host (without "www.", lower case) and first path segment of a URL; nulls where there are none."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+/([^/?#]+)", 1)
    return F.when(host != "", host), F.when(path != "", path)


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _measured_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, host: Column | str, path: Column | str) -> DataFrame:
    """doc_id, key (hash of a row's id, text, host and path), host, path, x, label; written, since it is read several times."""
    bounded_batches(docs.sparkSession)
    host, path = _as_column(host).cast("string"), _as_column(path).cast("string")
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), row_hash(F.col(doc_id), F.col(text), host, path).alias("key"),
        host.alias("host"), path.alias("path"), measured(F.col(text)).alias("x"),
    )
    return checkpoint(labelled(slim, labels))


def row_hash(doc_id: Column, text: Column, host: Column, path: Column) -> Column:
    return F.xxhash64(doc_id, text, host, path)


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: Column | str = "source",
    path: Column | str = "lang",
    cut: float = CUT,
    sample: int = SAMPLE,
    broadcast_sites: int = BROADCAST_SITES,
) -> DataFrame:
    """One row per document row: doc_id, p_doc, host_rate, path_rate, p_quality, keep.

    ``host`` and ``path`` are names or columns, such as those of :func:`site_of` where documents have URLs.
    A null text counts as empty; a null host or path is a site of its own; null ids are scored but never
    labelled; repeated rows each keep a row; several labels of one id are averaged; without labels of both
    classes the classifier is constant; empty tables give empty tables; other columns are ignored,
    whatever their names.
    """
    slim = _measured_rows(docs, labels, doc_id, text, host, path)
    scored = fit_sites(slim, sample, broadcast_sites).score(slim)
    return scored.drop("key").withColumn("keep", F.col("p_quality") >= cut)


def keep_good(docs: DataFrame, labels: DataFrame, host: Column | str = "source", path: Column | str = "lang", cut: float = CUT) -> DataFrame:
    """The rows of ``documents`` that the classifier keeps, with their columns, whatever their names.

    Cases are those of :func:`classify_quality`; rows with equal id, text, host and path share a verdict.
    Only the rejected rows' ids and hashes are joined back.
    """
    slim = _measured_rows(docs, labels, "doc_id", "text", host, path)
    bad = fit_sites(slim).score(slim).where(~(F.col("p_quality") >= cut)).select("doc_id", "key").distinct()
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("doc_id"),
        row_hash(F.col("doc_id"), F.col("text"), _as_column(host).cast("string"), _as_column(path).cast("string")).alias("key"),
    )
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key"))
    return keyed.alias("a").join(bad.alias("b"), on, "left_anti").select("row.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
