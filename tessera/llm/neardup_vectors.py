"""Operator 3: near-duplicate vectors of equal label, by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, id_of, table, written
from tessera.llm.components import components

BLOCK_DIMS = 8
#: A label's vectors are cut into cells of about this many bytes of vectors in each block; a tile holds two cells.
CELL_BYTES = 1 << 20
#: The cuts of a label's cells come from so many of its vectors for each cell, chosen by hash; a label has 2 ** DEPTH cells at most.
SAMPLE, DEPTH = 32, 12


def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation, so that no block holds more of the distance than its share by the choice of axes."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(dims)).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int) -> list[tuple[int, int]]:
    return [(a, min(a + BLOCK_DIMS, dims)) for a in range(0, dims, BLOCK_DIMS)]


def _unit(raw: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links those that join what earlier ones left apart (n - 1 at most)."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _tree(sample: np.ndarray, depth: int) -> np.ndarray:
    """Medians that cut a sample along its axes in turn; node i is cut into 2 i + 1 (up to the median) and 2 i + 2."""
    cuts, node = np.full(2**depth - 1, np.inf), np.zeros(len(sample), np.int64)
    for level in range(depth):
        x = sample[:, level % sample.shape[1]]
        medians = pd.Series(x).groupby(node).median()
        cuts[medians.index] = medians
        node = 2 * node + 1 + (x > cuts[node])
    return cuts


def _cells(cuts: np.ndarray, points: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each point's own cell, and (point, cell) for all cells within a squared distance of ``share``, over all axes."""
    home, point, node = np.zeros(len(points), np.int64), np.arange(len(points)), np.zeros(len(points), np.int64)
    away = np.zeros(points.shape)  # squared distance from a node, by axis
    leaves = (len(cuts) + 1).bit_length() - 1
    for level in range(leaves):
        axis = level % points.shape[1]
        home = 2 * home + 1 + (points[:, axis] > cuts[home])
        gap = points[point, axis] - cuts[node]
        beyond = away.copy()
        beyond[:, axis] = np.maximum(away[:, axis], gap * gap)
        keep = beyond.sum(axis=1) <= share
        node = np.concatenate([2 * node + 1 + (gap > 0), (2 * node + 1 + (gap <= 0))[keep]])
        point, away = np.concatenate([point, point[keep]]), np.concatenate([away, beyond[keep]])
    return home - len(cuts), point, node - len(cuts)


def _join(part: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links between the home cells of a tile: rows (id key, other null, n) count links of a vector, rows (id, other) are a spanning forest."""
    block, low, high = (int(part[c].iloc[0]) for c in ("block", "low", "high"))
    unit = _unit(list(part["vector"]))
    ids, keys, weight, home = (part[c].to_numpy() for c in ("vec", "key", "copies", "home"))
    turned = unit @ rotation(unit.shape[1])
    cuts = blocks_of(unit.shape[1])
    budget = 2 - 2 * least
    share = [budget * (e - s) / unit.shape[1] * (1 + 1e-9) + 1e-12 for s, e in cuts]
    s, e = cuts[block]
    sub = turned[:, s:e]
    square = (sub * sub).sum(axis=1)
    by_axis = np.argsort(sub[:, 0], kind="stable")
    left = by_axis[home[by_axis] == low]
    right = left if low == high else by_axis[home[by_axis] == high]
    # A little wide, as the expanded distance is inexact; the direct one below decides.
    wide = share[block] + 1e-6
    pairs_a, pairs_b = [], []
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        first, last = np.searchsorted(sub[right, 0], [sub[rows[0], 0] - np.sqrt(wide), sub[rows[-1], 0] + np.sqrt(wide)])
        first = at if low == high else first
        others = right[first:last]
        near = square[rows][:, None] + square[others][None, :] - 2 * sub[rows] @ sub[others].T <= wide
        i, j = np.nonzero(np.triu(near, 1) if low == high else near)
        a, b = rows[i], others[j]
        for cut in range(0, len(a), 100_000):  # exact check of the candidates
            x, y = a[cut : cut + 100_000], b[cut : cut + 100_000]
            true = (unit[x] * unit[y]).sum(axis=1) >= least
            x, y = x[true], y[true]
            # A pair is counted in the first block that keeps within its share.
            first_block = np.ones(len(x), bool)
            for other in range(block + 1):
                p, q = cuts[other]
                d = turned[x, p:q] - turned[y, p:q]
                within = (d * d).sum(axis=1) <= share[other]
                first_block &= within if other == block else ~within
            pairs_a.append(x[first_block])
            pairs_b.append(y[first_block])
    a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (pairs_a, pairs_b))
    links = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
    some = np.flatnonzero(links)
    counts = pd.DataFrame({"id": keys[some], "other": None, "n": links[some]}, dtype="Int64")
    tree = _forest(len(ids), a, b)
    forest = pd.DataFrame({"id": ids[[x for x, _ in tree]], "other": ids[[y for _, y in tree]], "n": 0}, dtype="Int64")
    return pd.concat([counts, forest])


def near_links(vectors: DataFrame, least: float = 0.93, cell_bytes: int = CELL_BYTES) -> tuple[DataFrame, DataFrame]:
    """(key, n links; a row for each tile) and (vec, other; a spanning forest of each tile's links).

    ``vectors``: key (unique), vec, label, copies, vector (float64 as bytes).  Unit vectors with a cosine of ``least``
    lie within a squared distance of 2 - 2 * least; of the blocks of a rotated vector at least one is within its share
    of that, in proportion to its axes.  For each block the join is a range join: a label's vectors are cut into cells
    by medians along all axes of the block and meet those cells whose distance, over all axes, is within the share; a
    tile is a pair of cells of one label.  So a label of any size is spread over many small tiles, and none emits its
    pairs: it returns counts and a forest.  The cuts do not change the result.
    """
    vectors = vectors.withColumn("width", F.octet_length("vector"))
    cells = F.ceil(F.col("group_size") * F.col("width") / cell_bytes)
    large = vectors.groupBy("label", "width").agg(F.count("*").alias("group_size")).where(F.col("group_size") * F.col("width") > cell_bytes)
    large = large.withColumn("depth", F.least(F.lit(DEPTH), F.ceil(F.log2(cells))).cast("int"))
    large = large.withColumn("share", F.least(F.lit(1.0), SAMPLE * F.pow(F.lit(2.0), "depth") / F.col("group_size")))
    sample = vectors.join(large, ["label", "width"]).where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        width, depth = int(part["width"].iloc[0]), min(int(part["depth"].iloc[0]), len(part).bit_length() - 2)
        made = []
        if depth > 0:
            turned = _unit(list(part["vector"])) @ rotation(width // 8)
            made = [(part["label"].iloc[0], width, k, _tree(turned[:, s:e], depth).tobytes()) for k, (s, e) in enumerate(blocks_of(width // 8))]
        return pd.DataFrame(made, columns=["label", "width", "block", "cuts"])

    # A group has SAMPLE * 2 ** DEPTH vectors or so at most; all cuts are one number for each cell and block, a 16,384th of the vectors' bytes.
    grown = sample.groupBy("label", "width").applyInPandas(grow, "label long, width int, block int, cuts binary").toArrow().to_pylist()
    trees: dict[int, dict[int, list[np.ndarray]]] = {}
    for r in sorted(grown, key=lambda r: (r["width"], r["label"], r["block"])):
        trees.setdefault(r["width"], {}).setdefault(r["label"], []).append(np.frombuffer(r["cuts"], float))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for width, wide in whole.groupby("width"):
                cut = trees.get(width, {})
                large = wide["label"].isin(list(cut))
                for label in [None, *wide.loc[large, "label"].unique()]:  # small labels are one cell each
                    rows = wide[~large if label is None else wide["label"] == label]
                    for at in range(0, len(rows), 500):
                        b = rows.iloc[at : at + 500]
                        turned = _unit(list(b["vector"])) @ rotation(width // 8)
                        for k, (s, e) in enumerate(blocks_of(width // 8)):
                            share = (2 - 2 * least) * (e - s) / turned.shape[1] * (1 + 1e-9) + 1e-9
                            home, row, to = _cells(np.zeros(0) if label is None else cut[label][k], turned[:, s:e], share)
                            yield b.iloc[row].assign(block=k, home=home[row], low=np.minimum(home[row], to), high=np.maximum(home[row], to))

    tiles = vectors.select("key", "vec", "label", "copies", "vector", "width").mapInPandas(
        deal, "key long, vec long, label long, copies long, vector binary, width int, block int, home long, low long, high long"
    )
    found = tiles.groupBy("label", "width", "block", "low", "high").applyInPandas(lambda part: _join(part, least), "id long, other long, n long")
    found = written(found, "vector-links")
    return found.where("other is null").select(F.col("id").alias("key"), "n"), found.where("other is not null").select(F.col("id").alias("vec"), "other")


def near_duplicates(vectors: DataFrame, least: float = 0.93, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label).

    Vectors of equal label and equal direction in all bits are one for the join and count as links of each other.
    Null labels, null vectors, zero vectors and vectors with null or non-finite components link with nothing, and so
    do vectors of unlike length.  Null vec_id: counts as the smallest id, returned as null.  Rows of equal vec_id are
    rows of their own in the counts and one in the components.  Other columns are ignored.
    """

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, label in zip(b.column("embedding"), b.column("label"), strict=True):
                v = None if not label.is_valid or not x.is_valid or x.values.null_count else np.asarray(x.values, np.float64) + 0.0
                good = v is not None and len(v) and np.isfinite(v).all() and v.any()
                if good:
                    far = np.frexp(np.abs(v).max())[1]
                    if abs(far) > 400:  # its square would leave the range of doubles; a power of two changes no direction
                        v = np.ldexp(v, -far)
                out.append(v.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([b.column("vec"), b.column("label"), pa.array(out, pa.binary())], ["vec", "label", "vector"])

    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("vec"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = written(rows.mapInArrow(plain, "vec long, label long, vector binary"), "vectors")
    usable = rows.where("vector is not null")
    classes = usable.groupBy("label", "vector").agg(F.min("vec").alias("first"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("key", F.monotonically_increasing_id()), "vector-classes")
    n, forest = near_links(classes.select("key", F.col("first").alias("vec"), "label", "copies", "vector"), least, cell_bytes)
    n = n.groupBy("key").agg(F.sum("n").alias("n"))
    member = usable.join(classes, ["label", "vector"]).select("vec", "first", "key", "copies")
    links = forest.select(F.col("vec").alias("a"), F.col("other").alias("b")).unionByName(member.where("vec <> first").select(F.col("vec").alias("a"), F.col("first").alias("b")))
    groups = components(links)
    counted = member.join(n, "key", "left").select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    counted = counted.unionByName(rows.where("vector is null").select("vec", F.lit(0).cast("long").alias("n_links")))
    found = counted.join(groups.withColumnRenamed("id", "vec"), "vec", "left").withColumn("component", F.coalesce("component", "vec"))
    return found.select(
        id_of("vec").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), id_of("component").alias("component_id"), (F.col("vec") == F.col("component")).alias("kept"),
    )


def op3_near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector; cases as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
c AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.m AS component_id, vec_id = c.m AS kept FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
