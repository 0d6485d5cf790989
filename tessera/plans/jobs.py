"""Whole jobs: from detections to a ranked error report, and from hard cases to an oversampled training set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation

from tessera.operators import errors, matching, similarity
from tessera.operators.bank import cut


def error_analysis(preds: DataFrame, gts: DataFrame, least: float = 0.5, top_k: int | None = None) -> dict[str, DataFrame]:
    """Matches once, as a table in the shared folder that all reports read, then confusions, misses, false alarms, patterns and priorities."""
    matches = cut(matching.match_detections(preds, gts, least))
    table = errors.error_table(matches)
    patterns = errors.find_patterns(table)
    confusions = errors.confusion(matches)
    return {
        "matches": matches, "confusion": confusions, "false_positives": errors.false_positives(matches), "false_negatives": errors.false_negatives(matches),
        "ranking": errors.rank(confusions, "count", ["gt_class", "pred_class"], top_k), "patterns": patterns, "class_priority": errors.class_priority(patterns),
    }


def write_counted(df: DataFrame, path: str, counts: dict[str, Column]) -> dict[str, object]:
    """Write ``df`` as Parquet and return the ``counts`` (aggregates without distinct) of the rows on their way: no second pass over them."""
    seen = Observation()
    df.observe(seen, *[v.alias(n) for n, v in counts.items()]).write.mode("overwrite").parquet(path)
    return seen.get


def hard_mining(cases: DataFrame, index: DataFrame, samples: DataFrame, object_images: DataFrame, k: int = 5) -> dict[str, DataFrame]:
    """Mine the objects nearest to hard cases, rank them, and plan the copies; object_images gives each object's image."""
    manifest = similarity.hard_manifest(similarity.mine_objects(cases, index, k))
    objects = manifest.join(object_images, "object_id").select("image_id", "selection_count", "global_rank")
    weights = similarity.image_weights(samples.select("image_id"), objects)
    return {"manifest": manifest, "weights": weights, "oversampled": similarity.oversample(samples, objects)}
