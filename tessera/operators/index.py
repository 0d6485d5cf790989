"""A vector index kept as a table: balls of near vectors, by class, searched exactly.

A row of the index is a ball: up to ``BALL`` vectors of one class that have one pivot as their nearest (or few of several),
packed as one matrix, with their mean direction and the largest angle to it.  The table is partitioned
by class, so a search in some classes opens only their folders.  Angles obey the triangle inequality: a vector of a ball
is at least as far from a query as the ball's middle less the ball's radius.  A search first looks into one ball for each
block of queries and class, which bounds the similarity of the k-th neighbour, and then into the balls that may hold
something as good.  The index is read where it lies and never shuffled; blocks of queries go to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors of a ball, and queries of a block.
BALL, BLOCK = 2048, 1024
#: Blocks of queries are broadcast in groups of about so many bytes.
BROADCAST_BYTES = 64 << 20
#: Vectors of the table (those whose ids have the smallest hashes) around which the others are ordered; they change what is near, not what is found.
PIVOTS = 256
PACKED = "n int, ids binary, vectors binary, center array<double>, radius double"


def _direction(v: np.ndarray, what: str) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1)
    if not np.isfinite(norm).all() or (norm == 0).any():
        raise ValueError(f"{what}: a zero vector, or one with a component that is not finite, has no direction")
    return v / norm[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(values) % max(1, len(lists)) or len(set(lists.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors must have one length")
    return values.reshape(len(lists), -1)


def _chained(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order in which each is followed by the nearest of the rest, so that small neighbours can share a ball."""
    near, left, at = pivots @ pivots.T, np.ones(len(pivots), bool), 0
    order = []
    while True:
        order.append(at)
        left[at] = False
        if not left.any():
            return pivots[order]
        at = int(np.where(left, near[at], -np.inf).argmax())


def _coded(rows: DataFrame, what: str) -> DataFrame:
    """``rows`` (id, class_id, embedding) as unit vectors (v) with their nearest pivot; those without a vector are left out."""
    some = rows.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("class_id").cast("int").alias("class_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    chosen = [r["embedding"] for r in some.orderBy(F.xxhash64("id"), "id", "embedding").limit(PIVOTS).collect()]  # at most PIVOTS vectors
    if len({len(v) for v in chosen}) > 1:
        raise ValueError("vectors must have one length")
    p = _chained(_direction(np.array(chosen, float), what)) if chosen else np.zeros((0, 0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _direction(_matrix(b.column("embedding")), what)
                if p.shape[1] != x.shape[1]:
                    raise ValueError("vectors must have one length")
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("class_id"), pa.array((x @ p.T).argmax(1)), pa.array(list(x.astype("<f8").view(f"V{8 * x.shape[1]}").ravel().tolist()), pa.binary())], ["id", "class_id", "pivot", "v"])

    return some.mapInArrow(work, "id long, class_id int, pivot long, v binary")


def _packed(rows: DataFrame, most: int, by_class: bool) -> DataFrame:
    """Rows in order of class, pivot and id, ``most`` or fewer to a row: class_id and PACKED.  A row that is not small ends with its pivot."""
    keys = (["class_id"] if by_class else []) + ["pivot", "id"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    names = ["class_id", *[c.split()[0] for c in PACKED.split(", ")]]

    def pack(kind: int | None, ids: list[int], vectors: list[bytes]) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(vectors), "<f8").reshape(len(ids), -1)
        mean = x.mean(0)
        norm = np.linalg.norm(mean)
        center = mean / norm if norm > 1e-9 else x[0]
        radius = float(np.arccos(np.clip((x @ center).min(), -1, 1)))
        made = [pa.array([kind], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([center.tolist()]), pa.array([radius])]
        return pa.RecordBatch.from_arrays(made, names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, pivot, ids, vectors = None, None, [], []
        for b in batches:
            for i, c, p, v in zip(*(b.column(x).to_pylist() for x in ("id", "class_id", "pivot", "v")), strict=True):
                if ids and (len(ids) == most or (by_class and c != kind) or (p != pivot and 16 * len(ids) >= most)):
                    yield pack(kind, ids, vectors)
                    ids, vectors = [], []
                kind, pivot = c, p
                ids.append(i)
                vectors.append(v)
        if ids:
            yield pack(kind, ids, vectors)

    return ordered.mapInArrow(work, f"class_id int, {PACKED}")


def write_index(objects: DataFrame, path: str, ball: int = BALL) -> None:
    """Write object_id, class_id, embedding as an index below ``path``, which all executors share.

    Objects without a vector or without a class are left out, as no search for classes can return them; a vector without
    direction fails the job.  One shuffle, by ranges of (class, pivot, id): a class of any size is cut into many tasks.
    """
    rows = _coded(objects.where("class_id IS NOT NULL").withColumnRenamed("object_id", "id"), "index")
    _packed(rows, ball, True).withColumn("ball", F.expr("uuid()")).write.mode("overwrite").partitionBy("class_id").parquet(path)


def read_index(spark: SparkSession, path: str, classes: Sequence[int] | None = None) -> DataFrame:
    """The balls of an index; of some classes only, whose folders alone are then read."""
    balls = spark.read.schema(f"{PACKED}, ball string, class_id int").parquet(path)
    return balls if classes is None else balls.where(F.col("class_id").isin([int(c) for c in classes]))


def _groups(spark: SparkSession, queries: DataFrame) -> list[DataFrame]:
    """Blocks of queries, as tables that are small enough to be broadcast."""
    from tessera.operators.bank import cut

    blocks = cut(_packed(_coded(queries, "queries"), BLOCK, False).drop("class_id").withColumn("block", F.monotonically_increasing_id()))
    size = blocks.agg(F.sum(F.length("vectors") + F.length("ids"))).first()[0] or 0
    n = max(1, math.ceil(size / BROADCAST_BYTES))
    return [blocks] if n == 1 else [blocks.where(F.pmod(F.xxhash64("block"), F.lit(n)) == i) for i in range(n)]


def _angle(a: str, b: str) -> str:
    return f"acos(greatest(-1D, least(1D, aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, z) -> s + z))))"


class _Best:
    """The best ``k`` neighbours so far of each query of a block, in one class: by similarity, then the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None) -> None:
        self.sims, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.floor = np.full(n, -np.inf) if floor is None else floor

    def needed(self) -> np.ndarray:
        """The similarity that a vector must reach to count."""
        return np.maximum(self.floor, self.sims[:, -1])

    def add(self, rows: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
        k = self.sims.shape[1]
        all_s = np.concatenate([self.sims[rows], sims], axis=1)
        all_i = np.concatenate([self.ids[rows], np.broadcast_to(ids, sims.shape)], axis=1)
        top = np.lexsort((all_i, -all_s), axis=1)[:, :k]
        self.sims[rows], self.ids[rows] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)


def _search(pairs: DataFrame, k: int, other_than_self: bool, floors: bool) -> DataFrame:
    """Local best neighbours of pairs of a block (q_*) and a ball: block, class_id, ids, neighbours, similarities, one row for a task, block and class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, _Best]] = {}
        for b in batches:
            for r in range(b.num_rows):
                at = {c: b.column(c)[r] for c in b.schema.names}
                raw = lambda c, kind: np.frombuffer(at[c].as_buffer(), kind)  # noqa: B023, E731
                q_ids, ids = raw("q_ids", "<i8"), raw("ids", "<i8")
                q, x = raw("q_vectors", "<f8").reshape(len(q_ids), -1), raw("vectors", "<f8").reshape(len(ids), -1)
                if q.shape[1] != x.shape[1]:
                    raise ValueError("vectors must have one length")
                key = (at["block"].as_py(), at["class_id"].as_py())
                if key not in best:
                    floor = raw("floor", "<f8") if floors and at["floor"].is_valid else None
                    best[key] = (q_ids.copy(), _Best(len(q_ids), k, floor))
                found = best[key][1]
                center = np.array(at["center"].as_py())
                reach = np.cos(np.maximum(0, np.arccos(np.clip(q @ center, -1, 1)) - at["radius"].as_py()))
                rows = np.flatnonzero(reach >= found.needed() - 1e-4)  # similarities are rounded to four decimals
                if len(rows):
                    sims = np.round(q[rows] @ x.T, 4)
                    if other_than_self:
                        sims[q_ids[rows][:, None] == ids[None, :]] = -np.inf
                    found.add(rows, sims, ids)
        for (block, kind), (q_ids, found) in best.items():
            made = [pa.array([block]), pa.array([kind], pa.int32()), pa.array([q_ids.tobytes()], pa.binary()), pa.array([found.ids.astype("<i8").tobytes()], pa.binary()), pa.array([found.sims.astype("<f8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["block", "class_id", "q_ids", "found", "sims"])

    columns = ["block", "class_id", "q_ids", "q_vectors", "ids", "vectors", "center", "radius"] + ["floor"] * floors
    return pairs.select(*columns).mapInArrow(work, "block long, class_id int, q_ids binary, found binary, sims binary")


def _floors(seeds: DataFrame, k: int) -> DataFrame:
    """block, class_id, floor (the k-th similarity of each query so far), least."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kth = [np.frombuffer(s.as_buffer(), "<f8").reshape(-1, k)[:, -1] for s in b.column("sims")]
            made = [b.column("block"), b.column("class_id"), pa.array([x.tobytes() for x in kth], pa.binary()), pa.array([float(x.min()) for x in kth], pa.float64())]
            yield pa.RecordBatch.from_arrays(made, ["block", "class_id", "floor", "least"])

    return seeds.select("block", "class_id", "sims").mapInArrow(work, "block long, class_id int, floor binary, least double")


def _rows(local: DataFrame, k: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, q, i, s in zip(b.column("class_id").to_pylist(), b.column("q_ids"), b.column("found"), b.column("sims"), strict=True):
                ids, sims, own = np.frombuffer(i.as_buffer(), "<i8"), np.frombuffer(s.as_buffer(), "<f8"), np.repeat(np.frombuffer(q.as_buffer(), "<i8"), k)
                at = np.flatnonzero(np.isfinite(sims))
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(np.full(len(at), c, np.int32)), pa.array(ids[at]), pa.array(sims[at])], ["case_id", "class_id", "object_id", "similarity"])

    return local.mapInArrow(work, "case_id long, class_id int, object_id long, similarity double")


def search_index(queries: DataFrame, path: str, k: int, classes: Sequence[int] | None = None, other_than_self: bool = False) -> DataFrame:
    """case_id, class_id, object_id, similarity, rank: the ``k`` nearest objects of each query in each class of the index (or in some).

    Exact: as ``similarity.knn`` by class, with similarity rounded to four decimals before it is ranked and ties going to
    the smaller object.  Queries (case_id, embedding) without a vector have no neighbours; a repeated case_id is searched
    as often and keeps the best rows; ``other_than_self`` leaves out the object whose id is the query's own.
    """
    spark = queries.sparkSession
    balls = read_index(spark, path, classes)
    out = None
    for blocks in _groups(spark, queries.select(F.col("case_id").alias("id"), F.lit(None).cast("int").alias("class_id"), "embedding")):
        local = _search_group(balls, blocks, k, other_than_self)
        out = local if out is None else out.unionByName(local)
    w = Window.partitionBy("case_id", "class_id").orderBy(F.desc("similarity"), "object_id")
    return _rows(out, k).distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search_group(balls: DataFrame, blocks: DataFrame, k: int, other_than_self: bool) -> DataFrame:
    from tessera.operators.bank import cut

    q = blocks.select("block", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("center").alias("q_center"), F.col("radius").alias("q_radius"))
    # For each block and class the ball whose middle is nearest, of those with k vectors or more beside the query itself.
    middles = balls.select("class_id", "ball", "n", "center").crossJoin(F.broadcast(q.select("block", "q_center")))
    nearest = cut(middles.groupBy("block", "class_id").agg(F.min_by("ball", F.struct(F.col("n") <= k, F.expr(_angle("center", "q_center")), "ball")).alias("ball")))
    seeds = balls.join(nearest.select("block", "ball"), "ball").join(F.broadcast(q), "block")
    floors = cut(_floors(_search(seeds, k, other_than_self, False), k))
    return _search(near_pairs(balls, q, floors), k, other_than_self, True)


def near_pairs(balls: DataFrame, q: DataFrame, floors: DataFrame) -> DataFrame:
    """Pairs of a ball and a block of queries (q_*) of which a vector may be as near as the floor of a query (block, class_id, floor, least)."""
    by_class = floors.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("class_id", F.struct("floor", "least")))).alias("floors"))  # an entry for each class
    near = f"cos(greatest(0D, {_angle('center', 'q_center')} - radius - q_radius)) >= coalesce(floors[class_id].least, -2D) - 1e-4"
    pairs = balls.join(F.broadcast(q.join(by_class, "block", "left")), F.expr(near))
    return pairs.withColumn("floor", F.expr("floors[class_id].floor"))
