"""Quality classifier: document evidence with hierarchical empirical Bayes.

A logistic classifier on text features gives each document a probability. Hosts
and the paths in them have quality rates of their own: grouped sums estimate
them, method-of-moments variances say how far a sparse site is to be drawn to
its host and a sparse host to all documents. The posterior of a document is its
own evidence with its site's rate for prior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, materialise, text_parts
from .line_rules import repeat_words

#: The classifier is fitted on at most this many labelled documents, those with
#: the least hashes of their ids.
MAX_LABELLED = 6000
#: Documents with a lower posterior are rejected.
THRESHOLD = 0.5
#: Sites (one row each, some 60 bytes) that may be broadcast.
MAX_SITES = 200_000
SALTS = 32
RIDGE = 1e-2
_CAPS = re.compile(rb"\b[A-Z]{2,}\b")
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

FEATURES = (
    "log_words", "short", "word_bytes", "long_words", "symbols", "pipes", "exclamations", "capitals", "caps_words",
    "digits", "stops", "unique_words", "repeats", "echoes", "duplicate_lines", "lines_per_word", "wordless",
)


def features(text: bytes) -> list[float]:
    """Shares of what poor text has much of; finite for any text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0, 1.0, *[0.0] * (len(FEATURES) - 3), 1.0]
    size = len(text)
    share = lambda chars: (size - len(text.translate(None, chars))) / size
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    distinct = len(set(words))
    return [
        np.log(n),
        float(n < 20),
        sum(map(len, words)) / n,
        sum(len(w) > 20 for w in words) / n,
        share(b"#*$%&<>") * 10,
        share(b"|") * 10,
        share(b"!") * 10,
        share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        len(_CAPS.findall(text)) / n,
        share(b"0123456789"),
        text.count(b".") / n,
        distinct / n,
        repeat_words(words) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        (len(lines) - len(set(lines))) / len(lines),
        len(lines) / n,
        float(not _WORD.search(text)),
    ]


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Classifier:
        """Ridge logistic regression by Newton steps. Without rows of both
        classes the evidence of every document is 0."""
        prior = (float(y.sum()) + 1) / (len(y) + 2)
        width = len(FEATURES)
        if not len(y) or y.min() == y.max():
            return cls(np.zeros(width), np.ones(width), np.zeros(width + 1), prior)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
        w = np.zeros(width + 1)
        ridge = RIDGE * len(y) / 100 * np.eye(width + 1)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w, prior)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -20, 20)


def _scored(docs: DataFrame, model, name: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and the classifier's logit as ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for _, _, texts in text_parts(b.column(0)) for t in texts]
            logit = model.value.logits(np.array(x).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(logit)], [*b.schema.names[1:], name])

    source = docs.select("text", *[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(name, T.DoubleType())])
    return source.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Classifier:
    """The classifier, from at most ``most`` labelled documents. Labels without
    an id or a quality are left out; of several for an id the least counts, and
    so does the least text where an id has several rows."""
    sample = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t) for _, _, texts in text_parts(b.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])

    rows = (
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "_quality").agg(F.min("text").alias("text"))
        .select(F.col("_quality").cast("double"), "text").mapInArrow(run, "y double, x array<double>").collect()
    )
    rows.sort()
    y = np.array([float(r.y > 0) for r in rows])
    return Classifier.fit(np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), y)


def _key(column: str) -> Column:
    """Null is a site of its own."""
    c = F.col(f"`{column}`")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string")))


def _strength(groups: DataFrame, within: float, n: str, rate: str, parent: str) -> float:
    """Pseudo-count kappa with which a group's rate is drawn to its parent's:
    the variance inside groups over the variance between their true rates."""
    gap = F.col(rate) - F.col(parent)
    r = groups.agg(
        F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("nn"), F.count(F.lit(1)).alias("k"), F.sum(F.col(n) * gap * gap).alias("ss")
    ).first()
    if not r.n or r.k < 2:
        return 1e6
    between = (r.ss - (r.k - 1) * within) / max(r.n - r.nn / r.n, 1e-9)
    return float(min(1e6, max(1.0, within / max(between, 1e-9))))


def _once(table: DataFrame) -> DataFrame:
    """A table of sites computed once: on the driver within the bound, stored
    beyond it."""
    few = bounded(table, MAX_SITES)
    return materialise(table, "sites") if few is None else few


def sites(scored: DataFrame, host: str, path: str) -> DataFrame:
    """_host, _path, host_rate and path_rate (posterior means), one row a site.
    ``scored`` has the columns ``host`` and ``path`` and the logit _logit."""
    p = 1 / (1 + F.exp(-F.col("_logit")))
    paths = _once(
        scored.select(_key(host).alias("_host"), _key(path).alias("_path"), p.alias("_p"))
        .groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"), F.sum("_p").alias("s"), F.sum(F.col("_p") * F.col("_p")).alias("q")),
    )
    r = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("m")).first()
    if not r.n:
        return paths.select("_host", "_path", F.lit(0.5).alias("host_rate"), F.lit(0.5).alias("path_rate"))
    mean, within = r.s / r.n, max((r.q - r.m) / r.n, 1e-6)
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    hosts = hosts.withColumn("raw", F.col("hs") / F.col("hn")).withColumn("mean", F.lit(mean))
    kappa = _strength(hosts, within, "hn", "raw", "mean")
    hosts = hosts.withColumn("host_rate", (F.col("hs") + kappa * mean) / (F.col("hn") + kappa))
    inner = paths.join(hosts.select("_host", "raw", "host_rate"), "_host").withColumn("own", F.col("s") / F.col("n"))
    kappa = _strength(inner, within, "n", "own", "raw")
    return inner.select("_host", "_path", "host_rate", ((F.col("s") + kappa * F.col("host_rate")) / (F.col("n") + kappa)).alias("path_rate"))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _with_posterior(scored: DataFrame, table: DataFrame, prior: float, host: str, path: str) -> DataFrame:
    """``scored`` with host_rate, path_rate and the posterior _posterior. The
    site table is broadcast within its bound; beyond it both sides are salted,
    so that no host's documents meet in one task."""
    few = bounded(table, MAX_SITES)
    keyed = scored.withColumn("_host", _key(host)).withColumn("_path", _key(path))
    if few is not None:
        joined = keyed.join(F.broadcast(few), ["_host", "_path"])
    else:
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = keyed.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        joined = keyed.join(salted, ["_host", "_path", "_salt"])
    evidence = F.col("_logit") - float(np.log(prior / (1 - prior)))
    return joined.withColumn("_posterior", 1 / (1 + F.exp(-(evidence + _logit(F.col("path_rate"))))))


def report(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, p_doc (classifier alone), host_rate,
    path_rate, posterior and kept.

    Every row is scored on its whole text, repeated or not; null and empty texts
    have the features of no words. Null hosts and paths are sites of their own.
    Without labels of both classes all evidence is 0 and every row is kept.
    Other columns are not read.
    """
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(dict.fromkeys(["doc_id", host, path]))
    scored = materialise(_scored(docs, shared, "_logit", columns), "logits")
    out = _with_posterior(scored, sites(scored, host, path), model.prior, host, path)
    return out.select(
        "doc_id", (1 / (1 + F.exp(-F.col("_logit")))).alias("p_doc"), "host_rate", "path_rate",
        F.col("_posterior").alias("posterior"), (F.col("_posterior") >= threshold).alias("kept"),
    )


def select(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose posterior is at
    least ``threshold``. Texts are read twice and moved only where there are too
    many sites to broadcast. Every row is judged on its whole text, repeated or
    not; null and empty texts have the features of no words. Null hosts and paths
    are sites of their own. Extra columns may have any names; an empty table, or
    labels that are not of both classes, reject nothing."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    table = sites(_scored(docs, shared, "_logit", list(dict.fromkeys([host, path]))), host, path)
    # Numbered names, as the columns of docs may have any.
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    scored = _scored(numbered.withColumn("text", F.col(at["text"])), shared, "_logit", numbered.columns)
    kept = _with_posterior(scored, table, model.prior, at[host], at[path]).where(F.col("_posterior") >= threshold)
    return kept.select(*numbered.columns).toDF(*docs.columns)
