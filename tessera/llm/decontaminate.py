"""Operator 5: which benchmark items do documents contain?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import doc_key, id_of, table, text_key, written

#: A word is a run of anything but ASCII white space; A-Z are lower-cased, nothing else.
SPACE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Item sketches above this many rows are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(folded, SPACE), lambda w: w != "")


def shingles(names: Column, k: int) -> Column:
    """The hashes of all runs of ``k`` words, given the hash of each word; empty for fewer words."""
    n = F.size(names) - (k - 1)
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    made = F.transform(at, lambda i: F.xxhash64(*[F.get(names, i + (j - 1)) for j in range(k)]))
    return F.when(n >= 1, F.array_distinct(made)).otherwise(F.array().cast("array<bigint>"))


def find_items(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.75, size_base: float = 1.5) -> DataFrame:
    """Pairs (doc_id, item_id) where the document holds at least ``threshold`` of the item's distinct ``k``-word shingles.

    Items are put into size classes (sizes within a factor ``size_base``).  The sketch of an item is its
    floor((1 - threshold) * u) + 1 smallest shingle hashes, u being the largest size in its class: the minima of a
    MinHash bottom sketch.  A document that holds threshold * size of an item's shingles misses at most
    (1 - threshold) * size of them, so at least one of the sketch is in the document: no containing document is lost,
    however long it is.  A document's side of the search is its whole hashed shingle set, as no fixed number of
    minima of a long document can hold a short item.  Candidates are then verified by exact containment counts.

    An item of fewer than ``k`` words is looked for with its whole word sequence as one shingle of that length.
    Null or empty item: never found.  Null or empty text: holds nothing.  Null ids are kept as null.  Rows of equal
    doc_id count as one document, rows of equal item_id as one item.  Returns doc_id, item_id, n_item (distinct
    shingles of the item), n_shared, containment.
    """
    found = _held_items(docs, doc_key(), items, k, threshold, size_base)
    return found.select(
        id_of("doc").alias("doc_id"), id_of("item").alias("item_id"), "n_item", "n_shared",
        F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment"),
    )


def _held_items(docs: DataFrame, key: Column, items: DataFrame, k: int = 5, threshold: float = 0.75, size_base: float = 1.5) -> DataFrame:
    """doc (the key), item, n_item, n_shared of ``find_items``; rows of equal ``key`` count as one document."""
    item_words = items.select(doc_key("item_id").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    named = item_words.select("item", F.least(F.size("w"), F.lit(k)).alias("k"), F.transform("w", lambda x: F.xxhash64(x)).alias("names"))
    by_length = F.coalesce(*[F.when(F.col("k") == j, shingles(F.col("names"), j)) for j in range(1, k + 1)])
    item_shingles = written(named.select("item", "k", F.explode(by_length).alias("shingle")).distinct(), "item-shingles")
    lengths = sorted(r["k"] for r in item_shingles.select("k").distinct().collect())  # k values at most

    sizes = item_shingles.groupBy("item").agg(F.count("*").alias("n_item"))
    size_class = F.floor(F.log(F.col("n_item")) / F.log(F.lit(size_base)) + F.lit(1e-9))
    largest = F.ceil(F.pow(F.lit(size_base), size_class + 1))
    sketch_size = F.floor(largest * (1 - threshold) + F.lit(1e-9)) + 1
    minima = item_shingles.groupBy("item").agg(F.sort_array(F.collect_set("shingle")).alias("hashes"))  # an item's own shingles
    sketch = (
        minima.join(sizes, "item")
        .select("item", F.explode(F.slice("hashes", 1, sketch_size.cast("int"))).alias("shingle"))
    )
    sketch = written(sketch, "item-sketch")
    small = sketch.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)

    wanted = docs.select(key.alias("doc"), F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("names"))
    of_docs = F.concat(*[shingles(F.col("names"), j) for j in lengths]) if lengths else F.array().cast("array<bigint>")
    doc_shingles = wanted.select("doc", F.explode(of_docs).alias("shingle"))
    keys = hint(sketch.select("shingle").distinct())
    # Rows that hit no sketch end at the scan; the hits are few, and each document's are pre-aggregated by distinct.
    hits = doc_shingles.join(keys, "shingle", "left_semi").distinct()
    pairs = written(hits.join(hint(sketch), "shingle").select("doc", "item").distinct(), "item-candidates")

    # Exact check: documents with a candidate are expanded once more and meet the candidates' whole shingle sets.
    expected = pairs.join(item_shingles, "item").select("doc", "item", "shingle")
    verify = docs.select(key.alias("doc"), "text").join(pairs.select("doc").distinct(), "doc", "left_semi")
    verify = verify.select("doc", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("names"))
    held = verify.select("doc", F.explode(of_docs).alias("shingle"))
    item_keys = item_shingles.select("shingle").distinct()
    few = item_shingles.count() <= BROADCAST_ROWS
    held = held.join(F.broadcast(item_keys) if few else item_keys, "shingle", "left_semi").distinct()
    shared = expected.join(held, ["doc", "shingle"]).groupBy("doc", "item").agg(F.count("*").alias("n_shared"))
    return shared.join(F.broadcast(sizes) if few else sizes, "item").where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item"))


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of every benchmark item that a document holds; cases as in ``find_items``."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows whose own text holds no item, whatever other rows of the same doc_id (or of none) hold; columns as they are.

    Null, empty or blank texts hold nothing and stay; texts of any length count whole; repeated rows go or stay
    together.  Without items, or with null and empty ones only, all rows stay; an empty table gives an empty one.
    Columns of any name pass through, whatever names are used inside.
    """
    leaks = written(_held_items(docs, text_key(), items).select("doc").distinct(), "leaking-texts")
    rows = docs.select(text_key().alias("doc"), F.struct("*").alias("whole"))
    return rows.join(leaks, "doc", "left_anti").select("whole.*")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, (SELECT DISTINCT k FROM bs) WHERE len(w) >= k),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
j AS (SELECT ds.doc_id, bs.item_id, count(*) AS n_shared FROM ds JOIN bs ON ds.s = bs.s AND ds.k = bs.k GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, round(n_shared::DOUBLE / n_item, 6) AS containment FROM j JOIN n USING (item_id) WHERE n_shared >= 0.75 * n_item
"""
