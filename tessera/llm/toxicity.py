"""Operator 2: a toxicity classifier that is trained to ignore which group a text mentions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Container, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrays import release, runs
from tessera.llm.common import doc_key, id_of, table, written

#: Groups of identity terms. A term may be swapped for any other term of its group.
IDENTITY_GROUPS = (
    ("woman", "man", "girl", "boy", "frau", "mann", "mujer", "hombre", "femme", "homme"),
    ("women", "men", "girls", "boys", "frauen", "männer", "mujeres", "hombres", "femmes", "hommes"),
    ("christian", "muslim", "jew", "hindu", "buddhist", "atheist", "christ", "moslem", "jude", "musulmán", "judío", "musulman", "juif"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrant", "native", "refugee", "foreigner", "citizen"),
    ("immigrants", "natives", "refugees", "foreigners", "citizens"),
    ("disabled", "blind", "deaf", "old", "young", "elderly"),
)
#: The fit takes about so many labelled rows at most, chosen by hash over all of them.
TRAIN_ROWS = 20_000
WORD = r"[^\W\d_]+"


#: A word also counts as its first 4, 5, 6 and 7 letters (written with a star), so that inflected forms share evidence.
STEMS = (4, 5, 6, 7)
#: Word counts are handed on whenever a task holds this many.
COUNTS = 100_000
#: Words whose features a task remembers.
REMEMBERED = 50_000


def words(text: str | None) -> set[str]:
    return set(re.findall(WORD, text.lower())) if text else set()


def features(text: str | None) -> set[str]:
    return _features(words(text))


def _of_word(w: str) -> tuple[str, ...]:
    return (w, *(w[:n] + "*" for n in STEMS if len(w) > n))


class Known:
    """Features of texts, those in ``wanted`` if given; what a word adds is found once and looked up from then on."""

    def __init__(self, wanted: Container[str] | None = None) -> None:
        self.wanted, self.found = wanted, {}

    def features(self, text: str | None) -> set[str]:
        out: set[str] = set()
        found, wanted = self.found, self.wanted
        for w in words(text):
            own = found.get(w)
            if own is None:
                if len(found) >= REMEMBERED:
                    found.clear()
                own = found[w] = _of_word(w) if wanted is None else tuple(f for f in _of_word(w) if f in wanted)
            if own:
                out.update(own)
        return out


def _features(found: set[str]) -> set[str]:
    return found.union(*({w[:n] + "*" for w in found if len(w) > n} for n in STEMS))


def swapped(text: str | None, terms: dict[str, int], groups: Sequence[Sequence[str]]) -> Iterator[tuple[set[str], set[str]]]:
    """For each counterfactual of a text the features that go and those that come: words and stems that no other word holds."""
    found = words(text)
    for w in sorted(found & terms.keys()):
        rest = _features(found - {w})
        gone = _features({w}) - rest
        for other in groups[terms[w]]:
            if other not in found:
                come = _features({other}) - rest
                yield gone - come, come - gone


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of rows, and of rows with label 1, for each feature; the feature '' counts all rows."""
    every: Counter[str] = Counter()
    toxic: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        columns = [pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([toxic[f] for f in every], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["feature", "df", "df_pos"])

    for b in batches:
        for y, text in zip(b.column("y"), b.column("text"), strict=True):
            found = features(text.as_py()) | {""}
            every.update(found)
            if y.as_py():
                toxic.update(found)
            if len(every) > COUNTS:
                yield out()
                every, toxic = Counter(), Counter()
    yield out()


def scorer(model: dict) -> Callable[[Iterable[str | None]], np.ndarray]:
    """Raw scores (log odds) of texts: the bias and the weights of their features."""
    weights, bias = model["weights"], model["bias"]  # the chosen features and the identity terms
    known = Known(weights)
    return lambda texts: np.array([bias + sum(weights[f] for f in sorted(known.features(t))) for t in texts], float)


def train_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc, text, y of the rows to learn from: labelled 0 or 1, and crc32 of the id as text not 0 modulo 5."""
    marked = labels.select(F.col("doc_id").alias("doc"), F.col("toxic").cast("int").alias("y")).where("y in (0, 1) and doc is not null")
    marked = marked.where(F.crc32(F.col("doc").cast("string").cast("binary")) % 5 != 0)
    marked = marked.groupBy("doc").agg(F.max("y").alias("y"))
    return docs.select(F.col("doc_id").alias("doc"), "text").where("doc is not null").join(marked, "doc")


def fit(docs: DataFrame, labels: DataFrame, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS, train_rows: int = TRAIN_ROWS,
        least_chi: float = 24.0, strength: float = 4.0, ridge: float = 1e-4) -> dict:
    """Weights of a logistic regression on the presence of words.

    Takes at most about ``train_rows`` labelled rows, spread by hash over all of them.  Features are all
    words and stems of these whose presence depends on the label (a chi-square of ``least_chi`` at least, which chance
    hardly reaches in so many words; it is a test of significance, and there is no limit to how many pass it), and all identity terms.  Each row that mentions an
    identity term also stands as its counterfactuals, where the term is swapped for another one of its group;
    ``strength`` times the squared change of the score between the row and each of them, all words and stems that the
    swap exchanges counted, is added to the loss, so that a mention alone cannot move a score.
    """
    rows = train_labels(docs, labels)
    labelled = train_labels(docs.select("doc_id", F.lit(None).cast("string").alias("text")), labels).count()
    if labelled > train_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc"), F.lit(labelled)) < train_rows)
    counts = written(rows.select("y", "text").mapInArrow(_count, "feature string, df long, df_pos long").groupBy("feature").agg(F.sum("df").alias("df"), F.sum("df_pos").alias("df_pos")), "toxicity-words")
    total = counts.where("feature = ''").first()
    n, pos = (int(total["df"]), int(total["df_pos"])) if total else (0, 0)
    model = {"weights": {}, "bias": -2.0}
    if not n:
        return model
    if pos in (0, n):
        return model | {"bias": -4.0 if pos == 0 else 4.0}
    # Chi-square of presence against the label.
    a, b = F.col("df_pos").cast("double"), (F.col("df") - F.col("df_pos")).cast("double")
    c, d = F.lit(float(pos)) - a, F.lit(float(n - pos)) - b
    chi = n * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * (a + c) * (b + d) + 1e-9)
    terms = {t: g for g, group in enumerate(groups) for t in group}
    best = counts.where("df >= 3 and feature <> ''").withColumn("chi", chi).where(F.col("chi") >= least_chi)
    vocab = sorted({r["feature"] for r in best.select("feature").collect()} | set(terms))
    index = {w: i for i, w in enumerate(vocab)}

    def number(batches):
        known = Known(index)
        for b in batches:
            texts = b.column("text").to_pylist()
            at = [sorted(index[w] for w in known.features(t)) for t in texts]
            # Of a counterfactual, -1 - i for a feature i that goes and i for one that comes.
            swaps = [[sorted([-1 - index[w] for w in gone if w in index] + [index[w] for w in come if w in index]) for gone, come in swapped(t, terms, groups)] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(at, pa.list_(pa.int32())), pa.array(swaps, pa.list_(pa.list_(pa.int32())))], ["y", "at", "swaps"])

    sample = rows.select("y", "text").mapInArrow(number, "y int, at array<int>, swaps array<array<int>>").toArrow().to_pydict()  # train_rows rows or so
    n_rows = len(sample["y"])
    cols = np.array([f for at in sample["at"] for f in at], int)
    X = _Sparse(np.repeat(np.arange(n_rows), [len(at) for at in sample["at"]]), cols, n_rows, len(vocab))
    y = np.array(sample["y"], float)
    # Counterfactuals as differences of features, equal ones once: the score change is the sum of what comes less that of what goes.
    swaps = Counter(tuple(x) for found in sample["swaps"] for x in found)
    pair = np.repeat(np.arange(len(swaps)), [len(x) for x in swaps])
    signed_at = np.array([f for x in swaps for f in x], int)
    sign, feature = np.where(signed_at < 0, -1.0, 1.0), np.where(signed_at < 0, -1 - signed_at, signed_at)
    D = _Sparse(pair, feature, len(swaps), len(vocab), sign)
    w, bias = _train(X, y, D, np.array(list(swaps.values()), float) * strength / n_rows, ridge)
    return {"weights": {v: float(w[i]) for v, i in index.items() if abs(w[i]) > 1e-6}, "bias": float(bias)}


class _Sparse:
    def __init__(self, rows: np.ndarray, cols: np.ndarray, n: int, m: int, values: np.ndarray | float = 1.0) -> None:
        self.rows, self.cols, self.n, self.m, self.values = rows, cols, n, m, values

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.cols], self.n)

    def t_dot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, self.values * r[self.rows], self.m)


def _train(X: _Sparse, y: np.ndarray, D: _Sparse, strength: np.ndarray, ridge: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the log loss, with the squared score changes ``D`` makes penalised by ``strength``."""
    w, bias = np.zeros(X.m), 0.0
    m1, m2 = np.zeros(X.m + 1), np.zeros(X.m + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(X.dot(w) + bias, -30, 30)))
        r = (p - y) / len(y)
        g = X.t_dot(r) + ridge * w + D.t_dot(2 * strength * D.dot(w))
        g = np.append(g, r.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, predicted for each row; every word of every text counts. Null or empty text: the bias alone."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = scorer(model)
        for b in batches:
            for part in runs(b):
                score = 1 / (1 + np.exp(-np.clip(raw(part.column("text").to_pylist()), -50, 50)))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(score)], ["doc", "score"])

    scored = docs.select(doc_key().alias("doc"), F.col("text").cast("string").alias("text")).mapInArrow(apply, "doc long, score double")
    return scored.select(id_of("doc").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score.

    Learns only from labelled rows outside the held-out fold; the score depends on the text alone.  Rows with a null
    doc_id are scored and never held out.  Repeated rows are scored each.  Without labels of both kinds the score is
    a constant.
    """
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject (score below 0.5), with their columns, whatever their names.

    Each row is judged by its own whole text: repeated rows and rows without an id too.  Null and empty texts have the
    score of the bias alone.  An empty table gives an empty one; a model without labels of both kinds rejects all or none.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = scorer(model)
        for b in batches:
            for part in runs(b):
                yield part.filter(pa.array(raw(part.column("text").to_pylist()) < 0))
            release()

    return docs.mapInArrow(keep, docs.schema)
