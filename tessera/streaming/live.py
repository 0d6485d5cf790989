"""Live frames: one in, its detections out. The jobs are stateless; a restart goes on from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.scoring import decode_frames, raw_scores, score

FRAMES = "image_id string, height int, width int, nChannels int, data binary"


def read_frames(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Frames that arrive as Parquet files below ``path``."""
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", per_trigger).parquet(path)


def score_stream(frames: DataFrame, load_model: Callable, out: str, checkpoint: str, conf: float = 0.25, once: bool = False) -> StreamingQuery:
    """Write detections of a stream of frames to Parquet, each frame once. ``once``: work off what is there and stop."""
    writer = score(frames, load_model, conf).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def decode_stream(frames: DataFrame, load_model: Callable, out: str, checkpoint: str, conf: float = 0.25, iou: float = 0.45, once: bool = False) -> StreamingQuery:
    """Score a stream of frames to raw rows, decode and suppress them inside each row, and write the detections below ``out``.

    A micro-batch is the folder ``batch=<id>`` and replaces what an attempt before a failure left there, so each frame's
    detections are written once however often a batch is tried.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    found = decode_frames(raw_scores(frames, load_model, conf), conf, iou)
    writer = found.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_detections(spark: SparkSession, out: str) -> DataFrame:
    """What ``decode_stream`` has written."""
    return spark.read.parquet(out).drop("batch")
