"""Reproducible sampling and splitting: order and draws come from hashes of (seed, cycle, id), not from a random stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.prefix import numbered
from tessera.operators.similarity import ranked_objects, table_of


def shuffle_key(seed: int, *parts: Column | str) -> Column:
    """An order that depends on seed and values alone."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[x.cast("string") for x in cols]).cast("binary"))


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the shuffle key."""
    return F.conv(F.substring(shuffle_key(seed, *parts), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def split_dataset(df: DataFrame, ratios: tuple[float, float], seed: int, id_col: str = "image_id") -> DataFrame:
    """train, val, test: cut at int(n * ratio) of the shuffled rows; test takes the rest."""
    n = df.count()
    a, b = int(n * ratios[0]), int(n * ratios[0]) + int(n * ratios[1])
    r = ranked_objects(df.withColumn("_key", shuffle_key(seed, id_col)), [F.col("_key"), F.col(id_col)])
    split = F.when(F.col("global_rank") <= a, "train").when(F.col("global_rank") <= b, "val").otherwise("test")
    return r.withColumn("split", split).drop("_key", "global_rank")


def take_fraction(df: DataFrame, ratio: float, seed: int, id_col: str = "image_id") -> DataFrame:
    n = int(df.count() * ratio)
    r = ranked_objects(df.withColumn("_key", shuffle_key(seed, id_col)), [F.col("_key"), F.col(id_col)])
    return r.where(F.col("global_rank") <= n).drop("_key", "global_rank")


def subset(df: DataFrame, n: int, seed: int, strict: bool = False, id_col: str = "image_id") -> DataFrame:
    """``n`` rows in order of their id; fewer rows are all taken, or an error if ``strict``."""
    if strict and df.count() < n:
        raise ValueError(f"fewer than {n} rows")
    return df.orderBy(shuffle_key(seed, id_col), id_col).limit(n).orderBy(id_col)


def per_category(df: DataFrame, n: int, seed: int, id_col: str, category: str = "category") -> DataFrame:
    """At most ``n`` rows of each category, without replacement."""
    w = Window.partitionBy(category).orderBy(shuffle_key(seed, id_col), id_col)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def balanced_sample(pool: DataFrame, n: int, seed: int, id_col: str = "object_id") -> DataFrame:
    """``n`` draws; every row once in each shuffled cycle, cycle after cycle."""
    size = pool.count()
    if not size or n <= 0:
        return pool.withColumn("draw", F.lit(0).cast("bigint")).limit(0)
    cycles = -(-n // size)
    each = pool.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1)))).withColumn("_key", shuffle_key(seed, "cycle", id_col))
    r = ranked_objects(each, [F.col("cycle"), F.col("_key"), F.col(id_col)])
    return r.where(F.col("global_rank") <= n).withColumn("draw", (F.col("global_rank") - 1).cast("bigint")).drop("_key", "global_rank", "cycle")


#: Choosing a category by what is left of it and then one of its rows is a uniform draw without replacement.
sample_backgrounds = balanced_sample


def _numbered(pool: DataFrame, order: Sequence[Column]) -> DataFrame:
    return ranked_objects(pool, order).withColumn("_at", F.col("global_rank") - 1).drop("global_rank")


def random_sample(pool: DataFrame, n: int, seed: int, id_col: str = "object_id") -> DataFrame:
    """``n`` uniform draws with replacement."""
    size = pool.count()
    draws = pool.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn("_at", F.floor(uniform(seed, "draw") * size).cast("bigint"))
    return draws.join(_numbered(pool, [F.col(id_col)]), "_at").drop("_at")


def class_area_sample(pool: DataFrame, n: int, seed: int, groups: Sequence[str] = ("class_name", "bucket"), id_col: str = "object_id") -> DataFrame:
    """Round robin over the sorted groups; cyclic, in shuffled order, within each."""
    sizes = pool.groupBy(*groups).agg(F.count("*").alias("_size"))
    # A row for each class and bucket.
    ordered = table_of(sizes.withColumn("_g", F.row_number().over(Window.orderBy(*groups)) - 1))
    n_groups = ordered.count()
    draws = pool.sparkSession.range(n).select(F.col("id").alias("draw"), (F.col("id") % n_groups).cast("int").alias("_g"), F.floor(F.col("id") / n_groups).alias("_turn"))
    wanted = draws.join(ordered, "_g").withColumn("_at", F.col("_turn") % F.col("_size"))
    member = numbered(pool.withColumn("_order", shuffle_key(seed, id_col)), groups, ["_order", id_col], "_at").withColumn("_at", F.col("_at") - 1)
    return wanted.join(member, [*groups, "_at"]).select("draw", *pool.columns)


def weighted_sample(df: DataFrame, n: int, seed: int, epoch: int = 0, id_col: str = "image_id", weight: str = "weight") -> DataFrame:
    """``n`` draws with replacement by weight; each epoch draws anew.

    Weights become intervals by a two-level prefix sum; a draw is a hash-uniform point, found by a join on buckets
    of the mean weight's width, so heavy rows are spread over many buckets.
    """
    rows = df.where(F.col(weight) > 0)
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, id_col).withColumn("_part", F.spark_partition_id())
    dealt = table_of(dealt)
    totals = dealt.groupBy("_part").agg(F.sum(weight).alias("_sum"), F.count("*").alias("_n"))
    whole = totals.agg(F.sum("_sum"), F.sum("_n")).first()
    if whole[0] is None:
        return df.withColumn("draw", F.lit(0).cast("bigint")).limit(0)
    total, width = float(whole[0]), float(whole[0]) / int(whole[1])
    before = totals.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    inside = F.sum(weight).over(Window.partitionBy("_part").orderBy(id_col).rowsBetween(Window.unboundedPreceding, 0))
    spans = dealt.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn("_hi", F.col("_before") + F.col("_in")).withColumn("_lo", F.col("_hi") - F.col(weight))
    spans = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    draws = spark.range(n).select(F.col("id").alias("draw"), (uniform(seed, F.lit(epoch), "id") * total).alias("_u")).withColumn("_b", F.floor(F.col("_u") / width))
    met = draws.join(spans, "_b").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    return met.select("draw", *df.columns)


def coverage(pool: DataFrame, selected: DataFrame, id_col: str = "object_id") -> DataFrame:
    """How often the objects of a pool were drawn: smallest, largest, mean, never."""
    n = selected.groupBy(id_col).agg(F.count("*").alias("n"))
    each = pool.select(id_col).join(n, id_col, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return each.agg(F.count("*").alias("pool_size"), F.sum("n").alias("draws"), F.min("n").alias("min_draws"), F.max("n").alias("max_draws"), F.avg("n").alias("mean_draws"), F.count_if(F.col("n") == 0).alias("never"))


def yield_by(selected: DataFrame, by: Sequence[str], generations: str = "generations") -> DataFrame:
    return selected.groupBy(*by).agg(F.count("*").alias("draws"), F.sum(generations).alias("synthetic_images"))


def compare_strategies(pool: DataFrame, n: int, seed: int, generations: str = "generations") -> DataFrame:
    """Coverage and expected images of balanced, random and class-area sampling."""
    out = None
    for name, fn in (("balanced", balanced_sample), ("random", random_sample), ("class_area", class_area_sample)):
        s = fn(pool, n, seed)
        row = coverage(pool, s).crossJoin(s.agg(F.sum(generations).alias("synthetic_images"))).select(F.lit(name).alias("strategy"), "*")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def coverage_by_class_area(pool: DataFrame, selected: DataFrame, id_col: str = "object_id") -> DataFrame:
    """Draws of each class in each area bucket, zeros included: a row for each class of the pool."""
    n = selected.groupBy(id_col).agg(F.count("*").alias("n"))
    each = pool.select(id_col, "class_name", "bucket").join(n, id_col, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    at = [F.sum(F.when(F.col("bucket") == b, F.col("n")).otherwise(0)).alias(b) for b in ("small", "medium", "large")]
    return each.groupBy("class_name").agg(*at, F.sum("n").alias("draws"))


def coverage_by_generations(selected: DataFrame, generations: str = "generations") -> DataFrame:
    """Draws and images for each generation count."""
    return selected.groupBy(generations).agg(F.count("*").alias("draws"), F.sum(generations).alias("synthetic_images"))
