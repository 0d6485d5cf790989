"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside joins; such rows sort before all others.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new local one where it is unset and all runs in one process."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
    return sc.getCheckpointDir()


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Threads of one session that write at the same time share its batch size: it goes back when the last one is done.
_writing = threading.Lock()
_writers: dict[str, tuple[int, str]] = {}


#: The tables and archives that each thread of the driver has put into the shared folder, so that it can remove them.
_made = threading.local()


def _paths() -> list[str]:
    if not hasattr(_made, "paths"):
        _made.paths = []
    return _made.paths


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _paths().append(path)
    return path


def temporary_tables() -> int:
    """How many tables this thread has in the shared folder."""
    return len(_paths())


def remove_temporary(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete this thread's tables from ``since`` to ``until`` in the order they were made; for when nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    for path in _paths()[since:until]:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _paths().remove(path)


def written(df: DataFrame, name: str, batch_rows: int = 2500) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends here and survives lost executors.

    While it is written, batches that go to Python hold at most ``batch_rows`` rows, as texts and sets can be long.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    session = spark._jsparkSession.sessionUUID()
    with _writing:
        n, before = _writers.get(session, (0, spark.conf.get(ARROW_ROWS)))
        _writers[session] = n + 1, before
        now = int(spark.conf.get(ARROW_ROWS))
        spark.conf.set(ARROW_ROWS, str(min(now, batch_rows) if now > 0 else batch_rows))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        with _writing:
            n, before = _writers[session]
            if n > 1:
                _writers[session] = n - 1, before
            else:
                del _writers[session]
                spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def doc_key(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def text_key() -> Column:
    """Tells rows of one doc_id with unlike texts apart; rows of one doc_id and one text are equal to all that looks at texts alone."""
    return F.xxhash64(F.col("text").cast("string"))


def id_of(key: str) -> Column:
    return F.when(F.col(key) != NULL_ID, F.col(key))


def partitions_for(n: int, each: int, least: int | None = None, spark: SparkSession | None = None) -> int:
    """How many partitions keep about ``each`` of ``n`` items, and at least the session's shuffle partitions."""
    floor = int(spark.conf.get("spark.sql.shuffle.partitions")) if spark is not None else (least or 1)
    return max(floor, -(-n // each))


def packed_texts(docs: DataFrame, **keys: Column) -> DataFrame:
    """doc (or the given keys), packed: the texts in compressed form, for shuffles that carry whole texts."""
    keys = keys or {"doc": doc_key()}
    names = list(keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for b in batches:
            at = 0
            while at < b.num_rows:  # few texts at a time
                part = b.slice(at, 500)
                blobs = []
                for x in part.column("text"):
                    raw = x.as_buffer() or b""
                    blobs.append(len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in names), pa.array(blobs, pa.binary())], [*names, "packed"])
                at += 500

    schema = ", ".join(f"{k} long" for k in names) + ", packed binary"
    return docs.select(*(c.alias(k) for k, c in keys.items()), F.col("text").cast("string").alias("text")).mapInArrow(pack, schema)


def unpacked(packed: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    raw = [codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in packed.to_pylist()]
    return pa.array(raw, pa.large_binary())


def in_runs(batch: pa.RecordBatch, run_bytes: int = 1 << 19, column: str = "packed") -> Iterator[pa.RecordBatch]:
    """Slices of a batch of packed texts with about ``run_bytes`` of text each."""
    at, size = 0, 0
    for i, x in enumerate(batch.column(column)):
        size += int.from_bytes(bytes(x.as_buffer()[:8]), "little")
        if size >= run_bytes:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)
