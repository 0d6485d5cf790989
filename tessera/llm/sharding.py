"""Operator 6: contiguous shards of balanced byte size, by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, written


def assign_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Cut the documents, in id order, into ``n_shards`` contiguous shards of near equal size.

    The size of a document is its UTF-8 bytes plus ``overhead``.  Only (id, size, checksum) are shuffled, never
    texts.  One range shuffle deals the rows to ordered blocks, each block's total gives its offset, and a running
    sum inside each block gives the global byte position of each row.  A row belongs to the shard that holds its
    middle byte, so each shard is within one document of total / n_shards.

    Null text: size ``overhead``, checksum 0.  Null id: sorts first.  Equal ids and repeated rows: kept, ordered by
    checksum and size, and then by their place in the input.  Empty input: empty result.  Other columns are ignored,
    whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = ["doc_id", "text_crc32", "size", "place"]
    # The table fixes the block of each row, whatever is recomputed later.
    n_blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    blocks = written(rows.repartitionByRange(n_blocks, *order).withColumn("block", F.spark_partition_id()), "shard-blocks")

    totals = blocks.groupBy("block").agg(F.sum("size").alias("block_bytes"), F.count("*").alias("block_rows"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "block",
        F.coalesce(F.sum("block_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("block_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("block_bytes").over(everything).alias("all_bytes"),
    )
    inside = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # offsets has as many rows as there are blocks, which the session's partition setting bounds.
    placed = (
        blocks.withColumn("end_inside", F.sum("size").over(inside))
        .withColumn("row_inside", F.count("*").over(inside) - 1)
        .join(F.broadcast(offsets), "block")
        .withColumn("middle", F.col("bytes_before") + F.col("end_inside") - F.col("size") / F.lit(2.0))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(F.col("middle") * n_shards / F.col("all_bytes"))).cast("int"))
        .withColumn("row", F.col("rows_before") + F.col("row_inside"))
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("first_row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, in 24 shards; cases as in ``assign_shards``."""
    return assign_shards(table(spark, sf_dir, "documents"))


#: CRC-32 by its table of 256 steps; a prefix sum gives each row's middle byte.
OP6_SQL = r"""
WITH c AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
x AS (SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, b: xor(tab[1 + (xor(s, b) & 255)], s // 256)), 4294967295)::BIGINT AS text_crc32 FROM d, c),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS e, sum(size) OVER () AS total FROM x),
m AS (SELECT *, least(23, floor((e - size / 2.0::DOUBLE) * 24 / total))::INTEGER AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM m
"""
