"""Operator 10: components of documents whose shingle sets are similar, found through PartEnum signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.arrays import U64, Words, mix, release, run_hashes, runs, signed
from tessera.llm.common import doc_key, id_of, in_runs, packed_texts, table, unpacked, written
from tessera.llm.components import components

SHINGLE = 5
#: Jaccard threshold as a fraction.
NUM, DEN = 3, 4
#: Sets below this size use their elements as signatures; size bands above it double.
SMALL = 16
#: A shingle that more than 1 in this many documents hold is common (and at least LEAST_COMMON documents).
COMMON, LEAST_COMMON = 16384, 12
#: Bound of the common shingles that go to every worker (16 bytes each).
COMMON_ROWS = 2_000_000
#: Sketches compared at once.
TILE = 256
#: A tile holds two blocks of a signature's documents, each of about so many documents and shingles at most.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_000_000
TILE_KEY = ["sig", "low", "high"]
#: Tables of document keys up to this many rows are broadcast, larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Shingles that a task counts at once; text keys that it remembers.
HELD, REMEMBERED = 300_000, 100_000


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word runs; one hash for fewer words; none without words."""
    words = Words(column)
    names = words.hashes(folded=True)
    every = run_hashes(names, k)
    out = []
    for i in range(len(words.at) - 1):
        a, b = words.first[i], words.first[i + 1]
        out.append(run_hashes(names[a:b], b - a) if 0 < b - a < k else np.unique(every[a : b - k + 1]) if b > a else every[:0])
    return out


def sketch(s: np.ndarray) -> bytes:
    """Parities of the hashed elements, in two to four bits for each; sets differ in at least as many elements as sketches in bits."""
    bits = max(64, 1 << (2 * len(s)).bit_length())
    odd = np.bincount((mix(s) % U64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketches_differ(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.unpackbits(x ^ y).sum())


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, n, h1, h2, sketch of each text; and rows with doc null for shingles that many of the task's documents hold (h1) with their count (n)."""
    names = ["doc", "n", "h1", "h2", "sketch"]
    held: list[np.ndarray] = []

    def common() -> Iterator[pa.RecordBatch]:
        every, count = np.unique(np.concatenate(held), return_counts=True)
        many = count >= max(2, len(held) // (2 * COMMON))
        held.clear()
        release()
        n = int(many.sum())
        if n:
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(count[many].astype(np.int64)), pa.array(signed(every[many])), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names)

    for batch in batches:
        for part in runs(batch):
            sets = shingle_sets(part.column("text"))
            n = np.array([len(s) for s in sets], np.int64)
            h1 = np.array([mix(s ^ U64(0x1234567)).sum(dtype=U64) for s in sets], U64)
            h2 = np.array([mix(s + U64(0x89ABCDEF0123)).sum(dtype=U64) for s in sets], U64)
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(n), pa.array(signed(h1)), pa.array(signed(h2)), pa.array([sketch(s) for s in sets], pa.binary())], names)
            held += sets
            if sum(map(len, held)) > 2 * HELD:
                yield from common()
    if held:
        yield from common()


def signatures(s: np.ndarray, common: np.ndarray, df: np.ndarray | None = None) -> np.ndarray:
    """The PartEnum signatures of a set.

    Let n be its size and k = floor(n / 3): a set with Jaccard similarity of 3/4 or more differs from it in at most k
    elements.  In each size band [L, 2 L) the domain of uncommon shingles is cut into n1 = L / 2 first-level
    partitions and each of them into n2 = 2; of these the subsets of one (k2 = 1) are enumerated, and a signature is
    the projection of the set on such a subset.  Of the non-empty projections at most k can be missing from a similar
    set, so if there are more than k, the k + 1 smallest of both sets share one.  A set takes part in its own band
    and in the next if its size is within 3/4 of it.  Where common shingles leave too few projections, and for small
    sets, the k + 1 first elements are signatures as well, in the order of rarity (``df`` of the common ones) and then
    of hash; of two sets at least one has enough projections, or both have these.
    """
    n = len(s)
    k = n // 3
    out = []
    elements = n * NUM < SMALL * DEN
    weight = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        weight = np.where(common[at] == s, df[at] if df is not None else 1, 0)
    if n >= SMALL:
        rare = s[weight == 0]
        band = (n // SMALL).bit_length() - 1
        upper = SMALL << (band + 1)
        for j in (band, band + 1) if n * DEN >= upper * NUM else (band,):
            cut = (SMALL << (j + 1)) // 2
            h = mix(rare ^ U64(0xC2B2AE3D27D4EB4F + 2 * j))
            part = (h % U64(cut)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            p = part[order]
            begin = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.zeros(0, np.int64)
            sums = np.add.reduceat(mix(h)[order], begin) if len(p) else np.zeros(0, U64)
            found = np.sort(mix(sums ^ (p[begin].astype(U64) * U64(0x165667B19E3779F9)) ^ U64(j)))
            elements |= len(found) <= k
            out.append(found[: k + 1])
    if elements:
        h = mix(s ^ U64(0x27D4EB2F165667C5))
        out.append(h[np.lexsort((h, weight))[: k + 1]])
    return np.concatenate(out) if out else s[:0]


def _signed_rows(batches: Iterator[pa.RecordBatch], common: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
    """signature, doc; of texts of one set that the task meets in a row of batches only the first has signatures (they are linked already)."""
    seen: set[bytes] = set()
    for batch in batches:
        for part in runs(batch):
            ids = part.column("doc").to_numpy(zero_copy_only=False)
            found = []
            for doc, s in zip(ids, shingle_sets(part.column("text")), strict=True):
                key = len(s).to_bytes(8, "little") + mix(s).sum(dtype=U64).tobytes() + mix(s ^ U64(77)).sum(dtype=U64).tobytes()
                if key not in seen and len(s):
                    seen.add(key)
                    found.append((signatures(s, common, df), doc))
            if len(seen) > REMEMBERED:
                seen.clear()
            if found:
                sig = np.concatenate([x for x, _ in found])
                doc = np.repeat(np.array([d for _, d in found], np.int64), [len(x) for x, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(signed(sig)), pa.array(doc)], ["sig", "doc"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sig, doc, pivot (the smallest document) for signatures of several documents, from rows sorted by sig and doc.

    Only the pivot of the last signature is held, so a signature of very many documents needs no memory.
    """
    sig0 = doc0 = pivot0 = None
    sent = False
    for b in batches:
        sig, doc = b.column("sig").to_numpy(), b.column("doc").to_numpy()
        if not len(sig):
            continue
        if sig0 is not None:  # the last row again, as a row of its signature
            sig, doc = np.append(sig0, sig), np.append(doc0, doc)
        new = np.append(True, (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1]))
        sig, doc = sig[new], doc[new]
        first = np.append(True, sig[1:] != sig[:-1])
        group = np.cumsum(first) - 1
        pivot = doc[first][group]
        if sig0 is not None:
            pivot[group == 0] = pivot0
        several = np.bincount(group)[group] > 1
        out = several.copy()
        if sig0 is not None and (sent or pivot0 != doc0):
            out[0] = False
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (sig, doc, pivot)], ["sig", "doc", "pivot"])
        sig0, doc0, pivot0, sent = sig[-1], doc[-1], pivot[-1], bool(several[-1])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least_bytes: int = 4 << 20) -> Iterator[pa.Table]:
    """Tables of some size that hold only whole groups, from rows sorted by the keys."""
    held: list[pa.RecordBatch] = []
    size, wanted = 0, least_bytes
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size < wanted:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        differs = np.zeros(t.num_rows, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            differs |= x != x[-1]
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield t.slice(0, cut)
        held = pa.Table.from_batches(t.slice(cut).to_batches()).to_batches()
        size = sum(x.nbytes for x in held)
        wanted = max(least_bytes, 2 * size)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _tiles(t: pa.Table) -> Iterator[np.ndarray]:
    """The rows of each tile of a sorted table."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in TILE_KEY:
        x = t.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    edges = np.append(np.flatnonzero(new), t.num_rows).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield np.arange(a, b)


def _candidates(at: np.ndarray, side: np.ndarray, low: int, high: int, comp: np.ndarray, n: np.ndarray, sketches: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a tile's rows in different components whose sizes and sketches allow a similarity of 3/4: two places in ``at`` and the sketches' distance."""
    size = min(map(len, sketches))
    folded = np.zeros((len(at), size), np.uint8)
    for i, x in enumerate(sketches):
        folded[i] = x if len(x) == size else np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)
    folded = folded.view(np.uint64)
    left = np.flatnonzero(side[at] == low)
    right = left if low == high else np.flatnonzero(side[at] == high)
    comp, n = comp[at], n[at]
    for x in range(0, len(left), TILE):
        for y in range(x if low == high else 0, len(right), TILE):
            p, q = left[x : x + TILE], right[y : y + TILE]
            may = comp[p][:, None] != comp[q][None, :]
            if low == high and x == y:
                may &= p[:, None] < q[None, :]
            may &= np.minimum(n[p][:, None], n[q][None, :]) * DEN >= np.maximum(n[p][:, None], n[q][None, :]) * NUM
            i, j = np.nonzero(may)
            if len(i):
                apart = np.bitwise_count(folded[p[i]] ^ folded[q[j]]).sum(axis=1, dtype=np.int64)
                near = 7 * apart <= n[p[i]] + n[q[j]]
                yield p[i[near]], q[j[near]], apart[near]


class _Forest:
    """Union-find over some keys; the smallest key of a tree is its root."""

    def __init__(self, keys: list[int]) -> None:
        self.root = {c: c for c in keys}

    def find(self, c: int) -> int:
        root = self.root
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


def _forests(batches: Iterator[pa.RecordBatch], exact: bool) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the tiles, as forests: at most as many as a tile has rows, never all its pairs.

    Without ``exact``: between documents that sizes and sketches allow to be similar.  With it: between documents whose
    whole sets are similar, as far as they join components that the tile had not joined before.
    """
    for t in whole_groups(batches, TILE_KEY, (8 if exact else 4) << 20):
        doc, side, comp, n = (t.column(c).to_numpy() for c in ("doc", "side", "component", "n"))
        low, high = t.column("low").to_numpy(), t.column("high").to_numpy()
        held = t.column("payload").combine_chunks()
        out: list[tuple[int, int]] = []
        for at in _tiles(t):
            if len(at) < 2:
                continue
            sets = [np.frombuffer(held[i].as_buffer(), U64 if exact else np.uint8) for i in at.tolist()]
            sketches = [np.frombuffer(sketch(x), np.uint8) for x in sets] if exact else sets
            key = comp if exact else doc
            forest = _Forest(key[at].tolist())
            for i, j, apart in _candidates(at, side, low[at[0]], high[at[0]], comp, n, sketches):
                for k in np.argsort(apart, kind="stable").tolist():
                    p, q = int(i[k]), int(j[k])
                    a, b = int(key[at[p]]), int(key[at[q]])
                    if forest.find(a) != forest.find(b) and (not exact or similar(sets[p], sets[q])):
                        forest.join(a, b)
                        out.append((int(doc[at[p]]), int(doc[at[q]])))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        release()


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sizes and sketches allow a similarity of 3/4."""
    for b in batches:
        n1, n2 = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
        fits = (np.minimum(n1, n2) * DEN >= np.maximum(n1, n2) * NUM)
        s1, s2 = b.column("sketch_a"), b.column("sketch_b")
        keep = [bool(f) and 7 * sketches_differ(s1[i].as_py(), s2[i].as_py()) <= n1[i] + n2[i] for i, f in enumerate(fits)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def similar(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two sets have a similarity of 3/4 or more."""
    both = np.sort(np.concatenate([s, t]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared * 100 >= 75 * (len(both) - shared)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar."""
    for b in batches:
        keep = [similar(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)) for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = "packed" in batch.schema.names
        for part in in_runs(batch) if packed else runs(batch):
            sets = shingle_sets(unpacked(part.column("packed")) if packed else part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "set"])


def _sets_of(wanted: DataFrame, docs: DataFrame, key: Column) -> DataFrame:
    """doc, set (hashes as bytes) of the wanted documents; rows of one key and one text once."""
    wanted = written(wanted.select("doc").distinct(), "wanted-documents")
    if wanted.count() <= BROADCAST_ROWS:
        texts = docs.select(key.alias("doc"), F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "doc", "left_semi")
    else:
        texts = packed_texts(docs, doc=key).join(wanted.hint("shuffle_hash"), "doc", "left_semi")
    return written(texts.mapInArrow(_sets, "doc long, set binary"), "shingle-sets", 500)


def _near_pairs(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sizes and then their sketches do not rule out."""
    a, b = [info.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
    sized = pairs.join(a.drop("sketch_a"), "a").join(b.drop("sketch_b"), "b").where(F.least("n_a", "n_b") * DEN >= F.greatest("n_a", "n_b") * NUM)
    sized = sized.join(a.drop("n_a"), "a").join(b.drop("n_b"), "b")
    return written(sized.mapInArrow(_near, "a long, b long"), "near-pairs")


def _verified(near: DataFrame, docs: DataFrame, key: Column) -> DataFrame:
    """The pairs (a, b) of truly similar documents, by their whole sets."""
    if near.isEmpty():
        return near
    sets = _sets_of(near.select(F.col("a").alias("doc")).unionByName(near.select(F.col("b").alias("doc"))), docs, key)
    first = sets.select(F.col("doc").alias("a"), F.col("set").alias("set_a"))
    second = sets.select(F.col("doc").alias("b"), F.col("set").alias("set_b"))
    return written(near.join(first, "a").join(second, "b").mapInArrow(_similar, "a long, b long"), "similar-pairs", 250)


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: only these, between the components so far, are contracted."""
    at = lambda c: F.coalesce(F.col(f"c_{c}"), F.col(c)).alias(c)
    known = links.join(groups.select(F.col("id").alias("a"), F.col("component").alias("c_a")), "a", "left").join(groups.select(F.col("id").alias("b"), F.col("component").alias("c_b")), "b", "left")
    up = written(components(known.select(at("a"), at("b"))), "joined").select(F.col("id").alias("component"), F.col("component").alias("top"))
    alone = up.join(groups.select(F.col("id").alias("component")), "component", "left_anti").select(F.col("component").alias("id"), F.col("top").alias("component"))
    moved = groups.join(up, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    return written(moved.unionByName(alone), "groups")


def _common(described: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles, sorted, and how many documents hold each; COMMON_ROWS of them at most."""
    counts = described.where("doc is null").groupBy("h1").agg(F.sum("n").alias("df")).where(F.col("df") >= max(LEAST_COMMON, n_docs // COMMON))
    counts = written(counts, "common-shingles")
    # The threshold rises by doubling until the bound holds; a row for each power of two comes here.
    by_power = sorted(((r["p"], r["n"]) for r in counts.groupBy((F.length(F.bin("df")) - 1).alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, 1
    for p, n in by_power:
        total += n
        if total > COMMON_ROWS:
            least = 1 << (p + 1)
            break
    rows = counts.where(F.col("df") >= least).toArrow()
    shingle, df = rows.column("h1").to_numpy().astype(np.int64).view(U64), rows.column("df").to_numpy()
    by = np.argsort(shingle)
    return shingle[by], df[by]


def _still_open(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """sig, doc, component of signatures whose documents, but for their pivots, lie in several components.

    Pivots were compared with all others.  Signatures of the same documents are one: ``sig`` is made from the
    documents here (should two sets of documents get one name, they are only compared with each other for nothing).
    """
    placed = rows.where("doc <> pivot").join(groups.withColumnRenamed("id", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    one = Window.partitionBy("sig")
    seen = placed.withColumn("least", F.min("component").over(one)).where(F.col("component").isNotNull())
    seen = seen.withColumn("most", F.max("component").over(one)).withColumn("name", F.bit_xor(F.xxhash64("doc")).over(one)).where("least < most")
    return written(seen.select(F.col("name").alias("sig"), "doc", "component").distinct(), "open-signatures")


def _with_hubs(open_rows: DataFrame) -> DataFrame:
    """Open rows with their signature's hub as pivot, the document that shares most signatures, and its component.

    In a group of copies the hub is one with few changes, so most others are similar to it.
    """
    degree = open_rows.groupBy("doc").agg(F.count("*").alias("degree"))
    hub = open_rows.join(degree, "doc").groupBy("sig").agg(F.max(F.struct("degree", F.bitwise_not(F.col("doc")).alias("order"), "component")).alias("hub"))
    hub = written(hub.select("sig", F.bitwise_not(F.col("hub.order")).alias("pivot"), F.col("hub.component").alias("pivot_component")), "hubs")
    return open_rows.join(hub, "sig")


def _dealt(rows: DataFrame, payloads: DataFrame) -> DataFrame:
    """Rows (sig, doc, component) with their payload (doc, n, payload) as rows of tiles.

    A signature of many or of large documents is cut into blocks, and a tile is a pair of them.
    """
    weight = rows.join(payloads.select("doc", "n"), "doc").groupBy("sig").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.lit(1))
    blocks = written(weight.where("docs > 1").select("sig", blocks.cast("int").alias("blocks")), "signature-blocks")
    dealt = rows.join(blocks, "sig").withColumn("side", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    dealt = dealt.join(payloads, "doc").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("sig", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "doc", "component", "n", "payload")


def _by_tile(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *TILE_KEY).sortWithinPartitions(*TILE_KEY)


def similar_groups(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """doc, n (size of the shingle set), component (smallest doc that links of 3/4 similarity reach, itself included).

    Rows of equal ``key`` (doc_id unless given) are one vertex.

    Documents of equal sets are linked through the smallest of them, by one aggregation.  Of the documents that share
    a signature each is compared with the smallest, then with the one that shares most signatures.  Where a
    signature's documents then still lie in several components, all pairs across these are compared in tiles: first
    by sketches, which joins documents that may be similar to clusters, then inside each cluster by whole sets.
    Forests of links leave the tiles, never pairs, so large groups of near copies cost rows in proportion while no
    link is lost.
    """
    key = doc_key() if key is None else key
    texts = docs.select(key.alias("doc"), F.col("text").cast("string").alias("text"))
    described = written(texts.mapInArrow(_describe, "doc long, n long, h1 long, h2 long, sketch binary"), "shingle-info")
    info = described.where("doc is not null")
    hot = docs.sparkSession.sparkContext.broadcast(_common(described, info.count()))
    signed_rows = texts.mapInArrow(lambda it: _signed_rows(it, *hot.value), "sig long, doc long")
    met = written(signed_rows.repartition("sig").sortWithinPartitions("sig", "doc").mapInArrow(_meet, "sig long, doc long, pivot long"), "shared-signatures", 50_000)
    # Equal sets need no comparison. The classes are a table, so that Spark may split the join of a large one.
    equal = info.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc").alias("b"), F.count("*").alias("copies")).where("copies > 1")
    equal = written(equal.select("h1", "h2", "n", "b"), "set-classes")
    same = written(info.select("h1", "h2", "n", F.col("doc").alias("a")).join(equal, ["h1", "h2", "n"]).where("a <> b").select("a", "b"), "equal-sets")
    star = met.where("doc <> pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct()
    links = _verified(_near_pairs(star, info), docs, key).unionByName(same)
    groups = written(components(links), "groups")

    open_rows = _still_open(met, groups)
    hubs = written(_with_hubs(open_rows), "hub-rows")
    to_hub = hubs.where("component <> pivot_component").select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct()
    by_hub = _verified(_near_pairs(to_hub, info), docs, key)
    if not by_hub.isEmpty():
        groups = _joined(groups, by_hub)
    open_rows = _still_open(hubs.select("sig", "doc", "pivot"), groups)
    # What sketches allow makes clusters; each document's whole set then goes to the tiles of its cluster alone.
    sketched = info.select("doc", "n", F.col("sketch").alias("payload"))
    allowed = written(_by_tile(_dealt(open_rows, sketched)).mapInArrow(lambda it: _forests(it, exact=False), "a long, b long"), "candidate-forests")
    if not allowed.isEmpty():
        clusters = written(components(allowed), "clusters").select(F.col("id").alias("doc"), F.col("component").alias("sig"))
        clusters = clusters.join(groups.withColumnRenamed("id", "doc"), "doc", "left").select("sig", "doc", F.coalesce("component", "doc").alias("component"))
        sets = _sets_of(clusters, docs, key).select("doc", (F.octet_length("set") / 8).cast("long").alias("n"), F.col("set").alias("payload"))
        more = written(_by_tile(_dealt(written(clusters, "cluster-rows"), sets)).mapInArrow(lambda it: _forests(it, exact=True), "a long, b long"), "tile-links", 500)
        groups = _joined(groups, more)
    found = info.select("doc", "n").join(groups.withColumnRenamed("id", "doc"), "doc", "left")
    return found.select("doc", "n", F.coalesce("component", "doc").alias("component"))


def op10_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Null or empty text, or text without words: no shingles, linked with nothing.  Null doc_id: counts as the smallest
    id and is returned as null.  Rows of equal doc_id link as one document; each keeps its row.  Other columns are
    ignored.  Texts of any length are worked on whole.
    """
    found = similar_groups(table(spark, sf_dir, "documents"))
    return found.select(id_of("doc").alias("doc_id"), F.col("n").alias("n_shingles"), id_of("component").alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each group of rows that links of similarity join the one with the smallest id (null first); columns as they are.

    Rows are told apart by doc_id and text, not by doc_id alone.  Of rows equal in both, one stays; rows without
    words (null, empty, white space) are similar to nothing and all stay.  Texts of any length count whole.  An empty
    table gives an empty one.  Columns of any name pass through, whatever names are used inside.
    """
    # The row in a struct: names inside cannot clash with names of columns.
    vertex = F.xxhash64(doc_key(), F.col("text").cast("string"))
    with_words = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.select(vertex.alias("vertex"), doc_key().alias("id"), with_words.alias("counts"), F.struct("*").alias("whole"))
    again = written(rows.where("counts").groupBy("vertex").agg(F.count("*").alias("n")).where("n > 1").select("vertex"), "repeated-rows")
    if not again.isEmpty():
        firsts = rows.join(again, "vertex", "left_semi").groupBy("vertex").agg(*[F.first(c).alias(c) for c in ("id", "counts", "whole")])
        rows = rows.join(again, "vertex", "left_anti").unionByName(firsts)
    texts = rows.select("vertex", F.col("whole.text").alias("text"))
    copies = written(similar_groups(texts, F.col("vertex")).where("doc <> component").select("doc", "component"), "copies")
    members = copies.unionByName(copies.select(F.col("component").alias("doc"), "component").distinct())
    placed = written(rows.select(F.col("vertex").alias("doc"), "id").join(members, "doc"), "group-members")
    best = placed.groupBy("component").agg(F.min(F.struct("id", "doc")).alias("best")).select(F.col("best.doc").alias("doc"))
    drop = written(placed.join(best, "doc", "left_anti").select(F.col("doc").alias("vertex")), "group-copies")
    return rows.join(drop, "vertex", "left_anti").select("whole.*")


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 75 * (nx.n + ny.n - i)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""
