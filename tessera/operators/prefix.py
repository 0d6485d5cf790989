"""Sums and extremes along an order inside groups, in two levels: no task holds a whole group.

Rows carry their group as a struct in ``_key``.  ``in_ranges`` deals them to ranges of the order; a range's rows are worked
on by themselves, and a row for each range and group brings what the group's other ranges add.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.similarity import table_of


def in_ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows as a table with ``_part``, the number of their range in the order of ``_key`` and then ``order``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table_of(df.repartitionByRange(n, F.col("_key"), *order).withColumn("_part", F.spark_partition_id()))


def _beside(ranges: DataFrame, parts: DataFrame) -> DataFrame:
    """``ranges`` with the columns of ``parts``, which has a row for each range and group; null groups are equal."""
    parts = parts.withColumnsRenamed({"_key": "_key2", "_part": "_part2"})
    return ranges.join(parts, F.col("_part").eqNullSafe(F.col("_part2")) & F.col("_key").eqNullSafe(F.col("_key2"))).drop("_key2", "_part2")


def running_sums(ranges: DataFrame, order: Sequence[Column], sums: Mapping[str, str]) -> DataFrame:
    """For each (name, column) of ``sums`` the column's sum over the group's rows up to this one."""
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranges.groupBy("_key", "_part").agg(*[F.sum(c).alias(f"_own_{name}") for name, c in sums.items()])
    parts = parts.select("_key", "_part", *[F.coalesce(F.sum(f"_own_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums])
    upto = Window.partitionBy("_part", "_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranges.withColumns({name: F.sum(c).over(upto) for name, c in sums.items()})
    out = _beside(inside, parts)
    return out.withColumns({name: F.col(name) + F.col(f"_before_{name}") for name in sums}).drop(*[f"_before_{name}" for name in sums])


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: the row's number 1, 2, ... in its group by the columns of ``order``, which tell rows apart."""
    keyed = df.select("*", F.struct(*groups).alias("_key"), F.lit(1).alias("_one"))
    by = [F.col(c) for c in order]
    return running_sums(in_ranges(keyed, by), by, {name: "_one"}).drop("_key", "_one", "_part")


def later_max(ranges: DataFrame, order: Sequence[Column], name: str, value: str) -> DataFrame:
    """``name``: the largest ``value`` of the group's rows from this one on."""
    later = Window.partitionBy("_key").orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    parts = ranges.groupBy("_key", "_part").agg(F.max(value).alias("_own")).select("_key", "_part", F.max("_own").over(later).alias("_after"))
    rest = Window.partitionBy("_part", "_key").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    out = _beside(ranges.withColumn(name, F.max(value).over(rest)), parts)
    return out.withColumn(name, F.greatest(name, "_after")).drop("_after")


def percentiles(df: DataFrame, value: Column, shares: Mapping[str, float]) -> DataFrame:
    """_key and for each (name, share) of ``shares`` the exact percentile of ``value``, linear between the two nearest ranks.

    Equal values are counted first; the distinct ones are ranked in ranges, and each percentile picks two of them.
    """
    counts = df.groupBy("_key", value.alias("_v")).agg(F.count("*").alias("_n"))
    ranges = in_ranges(counts, [F.col("_v")])
    placed = running_sums(ranges, [F.col("_v")], {"_upto": "_n"})
    totals = ranges.groupBy(F.col("_key").alias("_key2")).agg(F.sum("_n").alias("_total"))
    placed = placed.join(totals, F.col("_key").eqNullSafe(F.col("_key2"))).drop("_key2")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col("_v")))

    picked, out = [F.max("_total").alias("_total")], []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("_total") - 1)
        picked += [at(F.floor(place)).alias(f"_low_{name}"), at(F.ceil(place)).alias(f"_high_{name}")]
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        out.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(name))
    return placed.groupBy("_key").agg(*picked).select("_key", *out)
