"""Operator 9: document quality, with the evidence of a classifier and the posteriors of its site (hierarchical empirical Bayes)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrays import Words, runs
from tessera.llm.common import doc_key, id_of, table, written

#: The classifier learns from about this many labelled rows at most, spread by hash over all of them.
TRAIN_ROWS = 20_000
FEATURES = ("symbols", "marks", "upper", "digits", "lines", "repeats", "distinct", "top_word", "word_length", "log_words", "pipes", "empty")
#: Bytes by kind; sentence marks and dashes are no symbols.
_ASCII = np.arange(256)
_LETTER = ((_ASCII | 32) >= 97) & ((_ASCII | 32) <= 122) | (_ASCII >= 128)
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_SPACE = (_ASCII <= 32) | (_ASCII == 127)
_MARK = np.isin(_ASCII, [ord(c) for c in "!?"])
_PIPE = _ASCII == ord("|")
_PLAIN = np.isin(_ASCII, [ord(c) for c in ".,;:'\"()-"])
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _MARK | _PIPE | _PLAIN)
_UPPER = (_ASCII >= 65) & (_ASCII <= 90)


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; shares are of its words. Null or empty texts: zeros, and empty = 1."""
    words = Words(column)
    n_texts = len(words.at) - 1
    per_text = lambda mask: np.diff(np.append(0, np.cumsum(mask))[words.at])
    n = np.diff(words.first)
    share = lambda x: x / np.maximum(n, 1)
    hashes = words.hashes(folded=True)
    repeat = np.zeros(len(hashes) + 1)
    if len(hashes) > 1:
        repeat[1:-1] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    repeats = np.diff(np.append(0, np.cumsum(repeat[:-1]))[words.first])
    distinct, top = np.zeros(n_texts), np.zeros(n_texts)
    for i in range(n_texts):
        if n[i]:
            _, count = np.unique(hashes[words.first[i] : words.first[i + 1]], return_counts=True)
            distinct[i], top[i] = len(count), count.max()
    raw = words.raw
    letters = np.maximum(per_text(_LETTER[raw]), 1)
    out = np.stack([
        np.minimum(share(per_text(_SYMBOL[raw])), 3), np.minimum(share(per_text(_MARK[raw])), 3), per_text(_UPPER[raw]) / letters,
        share(per_text(_DIGIT[raw])), share(per_text(raw == 10)), share(repeats), share(distinct), share(top),
        np.minimum(np.diff(words.at) / np.maximum(n, 1), 40) / 10, np.log1p(n) / 5, share(per_text(_PIPE[raw])), (n == 0).astype(float),
    ], axis=1)
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """Features and their square roots, so that a low share already tells."""
    return np.concatenate([x, np.sqrt(x)], axis=1)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, steps: int = 400) -> dict:
    """A logistic regression of quality on text features, from rows whose crc32 of the id modulo 5 is not 0."""
    marked = labels.select(F.col("doc_id").alias("doc"), F.col("quality").cast("int").alias("y")).where("y in (0, 1) and doc is not null")
    marked = marked.where(F.crc32(F.col("doc").cast("string").cast("binary")) % 5 != 0).groupBy("doc").agg(F.max("y").alias("y"))
    n = max(marked.count(), 1)
    if n > train_rows:
        marked = marked.where(F.pmod(F.xxhash64("doc"), F.lit(n)) < train_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).join(marked, "doc")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in runs(b):
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(list(features(part.column("text"))), pa.list_(pa.float64()))], ["y", "x"])

    sample = rows.select("y", "text").mapInArrow(measure, "y int, x array<double>").toArrow()  # about train_rows rows
    y = sample.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return {"mean": np.zeros(2 * len(FEATURES)), "scale": np.ones(2 * len(FEATURES)), "w": np.zeros(2 * len(FEATURES)), "bias": 4.0 if not len(y) or y[0] else -4.0, "prior": 0.0}
    x = expand(np.array(sample.column("x").to_pylist()))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / scale
    w, bias, m, v = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        r = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - y
        g = np.append(x.T @ r / len(y) + 1e-4 * w, r.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return {"mean": mean, "scale": scale, "w": w, "bias": bias, "prior": float(np.log(y.mean() / (1 - y.mean())))}


def _logit(p: Column) -> Column:
    safe = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(safe / (1 - safe))


def _strength(groups: DataFrame, parent: Column) -> float:
    """How many documents the prior of a level is worth: from the variance of its groups' means around their parents', by moments."""
    n, total = F.col("n"), F.col("total")
    mean = total / n
    row = groups.withColumn("parent", parent).agg(
        F.sum(n * (mean - F.col("parent")) * (mean - F.col("parent"))).alias("spread"), F.sum(F.col("parent") * (1 - F.col("parent"))).alias("noise"),
        F.sum(n).alias("n"), F.sum(n * F.col("parent") * (1 - F.col("parent"))).alias("var"),
    ).first()
    if not row["n"]:
        return 1.0
    tau = max((row["spread"] - row["noise"]) / row["n"], 1e-9)
    return float(min(max(row["var"] / row["n"] / tau - 1, 1.0), 1e6))


def posteriors(docs: DataFrame, model: dict, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, evidence, site (posterior share of good documents of the path), score, keep.

    The prior of a host is the mean over all documents, that of a path its host's posterior, each worth as many
    documents as the spread of the groups' means warrants: sparse sites shrink to the level above.  A document does
    not count for its own site.  Its score joins the log odds of the site and of its own text; keep is score >= 0.5.

    Null or empty text: scored by its features like any other.  Null host or path: a site of its own.  Null ids and
    repeated rows are kept, each scored.  Empty input: empty result.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in runs(b):
                raw = (expand(features(part.column("text"))) - model["mean"]) / model["scale"] @ model["w"] + model["bias"]
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("host"), part.column("path"), pa.array(np.clip(raw, -30, 30))], ["doc", "host", "path", "raw"])

    rows = docs.select(doc_key().alias("doc"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(score, "doc long, host string, path string, raw double").withColumn("p", 1 / (1 + F.exp(-F.col("raw"))))
    scored = written(scored, "quality-scores")
    # Grouped once by path; hosts and the whole are sums of these few rows.
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("total")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    mu = whole["total"] / whole["n"] if whole["n"] else 0.5
    k_host = _strength(hosts, F.lit(mu))
    shrunk = hosts.select("host", F.col("n").alias("host_n"), F.col("total").alias("host_total"), ((k_host * mu + F.col("total")) / (k_host + F.col("n"))).alias("host_mean"))
    sites = paths.join(shrunk, "host")
    k_path = _strength(sites, F.col("host_mean"))
    placed = scored.join(sites, ["host", "path"])
    own_host = (k_host * mu + F.col("host_total") - F.col("p")) / (k_host + F.col("host_n") - 1)
    site = (k_path * own_host + F.col("total") - F.col("p")) / (k_path + F.col("n") - 1)
    evidence = F.col("raw") - model["prior"]
    odds = evidence + _logit(F.col("site"))
    return placed.withColumn("site", site).select(
        id_of("doc").alias("doc_id"), "host", "path", evidence.alias("evidence"), "site", (1 / (1 + F.exp(-odds))).alias("score"), (odds >= 0).alias("keep"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; its source is the host, and its language below that the path; cases as in ``posteriors``."""
    docs = table(spark, sf_dir, "documents")
    return posteriors(docs, fit(docs, table(spark, sf_dir, "labels")), F.col("source"), F.col("lang"))
