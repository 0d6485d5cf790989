"""Operator 7: remove byte strings that occur more than once, by a distributed merge sort of suffixes.

Only suffixes at anchors are sorted: of each window of ``width`` bytes the place of its smallest hashed ``GRAM``.
Equal windows have their anchors at equal places, so each repeated window shows as anchors whose suffixes share the
window's right part, and whose bytes before the anchor share its left part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrays import BYTE, U64, mix, prefix_hash, release, runs, signed, span_hash, texts_of
from tessera.llm.common import doc_key, id_of, in_runs, packed_texts, table, text_key, unpacked, written
from tessera.llm.recompress import _ranges, _rows, in_order

GRAM = 32
#: Low bits of a rank hold the place (a text has less than 2 GiB), so that equal hashes go to the leftmost.
PLACE = U64((1 << 31) - 1)
HELD = 200_000
#: Suffixes that a task sorts into one run.
RUN = 60_000
KNOWN, OPEN = 1, 0


def anchors(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of some texts: text, first and last window start, place and hash of their common anchor."""
    none = np.zeros(0, np.int64)
    lengths = np.diff(at)
    inside = np.maximum(lengths - width + 1, 0)
    if not inside.sum():
        return none, none, none, none, none.view(U64)
    prefix = prefix_hash(BYTE[raw])
    place = np.arange(len(raw) - GRAM + 1)
    gram = mix(span_hash(prefix, place, place + GRAM))
    rank = (gram & ~PLACE) | place.astype(U64)
    w = width - GRAM + 1
    padded = np.full(-(-len(rank) // w) * w + w, np.iinfo(np.uint64).max, U64)
    padded[: len(rank)] = rank
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    text = np.repeat(np.arange(len(lengths)), inside)
    start = np.arange(len(text)) + np.repeat(at[:-1] - (np.cumsum(inside) - inside), inside)
    best = (np.minimum(behind[start], ahead[start + w - 1]) & PLACE).astype(np.int64)
    new = np.append(True, (best[1:] != best[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return text[first], start[first], start[last], best[first], gram[best[first]]


def _anchor_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """key, doc, row, lo, hi, at, lead (first bytes of the suffix as a number), kind.

    An anchor whose hash the task holds more than once is known to be shared; of these one row stays open for the
    other tasks to meet, so that a string that a third of all texts hold leaves a row for each task.
    """
    names = ["key", "doc", "row", "lo", "hi", "at", "lead", "kind"]
    held: list[tuple[np.ndarray, ...]] = []

    def out() -> Iterator[pa.RecordBatch]:
        key, doc, row, lo, hi, at, lead = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        shared = count[back] > 1
        first = np.zeros(len(key), bool)
        first[np.unique(key, return_index=True)[1]] = True
        known = np.where(shared, KNOWN, OPEN).astype(np.int8)
        # A known row goes on under a key of its own; its first one also meets the others, as a row without windows.
        yield _rows(names, np.where(shared, mix(doc.view(U64) + at.astype(U64)), key), doc, row, lo, hi, at, lead, known)
        f = first & shared
        if f.any():
            yield _rows(names, key[f], doc[f], row[f], np.full(f.sum(), 1), np.zeros(f.sum(), np.int64), at[f], lead[f], np.full(f.sum(), OPEN, np.int8))
        release()

    for batch in batches:
        for part in runs(batch):
            raw, at = texts_of(part.column("text"))
            ids, rows = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "row"))
            text, lo, hi, place, key = anchors(raw, at, width)
            if not len(text):
                continue
            lead = np.zeros(len(text), np.int64)
            for i in range(7):
                lead = (lead << 8) | raw[place + i]
            base = at[text]
            held.append((key, ids[text], rows[text], lo - base, hi - base, place - base, lead))
            if sum(len(x[0]) for x in held) > HELD:
                yield from out()
    if held:
        yield from out()


def _shared(batches: Iterator[pa.RecordBatch], size: int = HELD) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by hash, those whose hash occurs more than once; the last row of a part waits for the next one."""
    names = ["doc", "row", "lo", "hi", "at", "lead"]
    last: list[np.ndarray] = []
    before = False  # whether the row that waits has the hash of the row before it

    def chosen(columns: list[np.ndarray], same: np.ndarray) -> pa.RecordBatch:
        _, *out, kind = columns
        # A row without windows stands for a known one: the hash is shared though the key may occur once here.
        keep = (kind == KNOWN) | (same & (out[2] <= out[3]))
        return _rows(names, *(x[keep] for x in out))

    for columns in in_order(batches, "key", *names, "kind", size=size):
        if last:
            columns = [np.concatenate(x) for x in zip(last, columns, strict=True)]
        equal = columns[0][1:] == columns[0][:-1]
        back = np.append(before, equal)
        yield chosen([x[:-1] for x in columns], back[:-1] | equal)
        last, before = [x[-1:] for x in columns], bool(back[-1])
        release()
    if last:
        yield chosen(last, np.array([before]))


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix, ``known`` bytes of which need no comparison."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - 1 - (x.bit_length() - 1) // 8


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Of a sorted run: the common prefix of each suffix with the one before, and all the rest of the bytes."""
    lcp, tails, before = np.zeros(len(suffixes), np.int32), [], b""
    for i, s in enumerate(suffixes):
        lcp[i] = n = common_prefix(before, s)
        tails.append(s[n:])
        before = s
    return lcp, b"".join(tails)


def front_decode(lcp: np.ndarray, lengths: np.ndarray, tails: bytes) -> Iterator[tuple[bytes, int]]:
    before, at = b"", 0
    for n, length in zip(lcp.tolist(), lengths.tolist(), strict=True):
        before = before[:n] + tails[at : at + length - n]
        at += length - n
        yield before, n


class LoserTree:
    """Merges sorted runs of (string, common prefix with its predecessor), never comparing a prefix that is known.

    Each contender carries its common prefix with the last winner.  Of two contenders the one with the longer such
    prefix is smaller, without a look at the strings; only if both are equal are they compared, from there on.
    """

    def __init__(self, sources: list[Iterator[tuple[bytes, int]]]) -> None:
        self.sources = sources
        self.size = 1 << max(0, len(sources) - 1).bit_length()
        self.string: list[bytes | None] = [None] * self.size
        self.lcp = [0] * self.size
        self.loser = [0] * self.size
        for i in range(len(sources)):
            self._pull(i)
        win = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = win[2 * node], win[2 * node + 1]
            win[node], self.loser[node] = self._play(a, b)
        self.winner = win[1] if self.size > 1 else 0

    def _pull(self, i: int) -> None:
        got = next(self.sources[i], None) if i < len(self.sources) else None
        self.string[i], self.lcp[i] = got if got is not None else (None, 0)

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes that with the winner."""
        s, t = self.string[a], self.string[b]
        if s is None or t is None:
            return (b, a) if s is None else (a, b)
        x, y = self.lcp[a], self.lcp[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        n = common_prefix(s, t, x)
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            self.lcp[b] = n
            return a, b
        self.lcp[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, common prefix with the one before) of each string in order."""
        while self.string[self.winner] is not None:
            i = self.winner
            yield i, self.lcp[i]
            self._pull(i)
            node = (self.size + i) // 2
            while node:
                self.winner, self.loser[node] = self._play(i, self.loser[node])
                i = self.winner
                node //= 2


def _sorted_runs(batches: Iterator[pa.RecordBatch], width: int, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Front-coded runs of suffixes, cut by the splitters: a row for each run and range.

    Of anchors with equal surroundings in a run one goes on; all of them repeat, so their windows are covered, which
    a row of a negative range says, which is the run's own: no task gathers those of several runs.
    """
    held: list[tuple[bytes, bytes, int, int, int, int]] = []  # suffix, bytes before, hi to anchor, doc, row, anchor

    def out() -> Iterator[pa.RecordBatch]:
        held.sort()
        keep, covered = [], []
        i = 0
        while i < len(held):
            j = i + 1
            while j < len(held) and held[j][:3] == held[i][:3]:
                j += 1
            keep.append(held[i])
            if j > i + 1:
                covered += [(doc, row, at - len(left), at - back) for _, left, back, doc, row, at in held[i:j]]
            i = j
        held.clear()
        lead = np.array([int.from_bytes(x[0][:7].ljust(7, b"\0"), "big") for x in keep], np.int64)
        bucket = np.searchsorted(cuts, lead, "right")
        rows = []
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keep)] if keep else []
        for a, b in zip(edges, edges[1:], strict=False):
            part = keep[a:b]
            lcp, tails = front_code([x[0] for x in part])
            meta = np.array([(len(x[0]), len(x[1]), *x[2:]) for x in part], np.int64).T
            rows.append((int(bucket[a]), lcp.tobytes(), tails, np.ascontiguousarray(meta).tobytes(), b"".join(x[1] for x in part)))
        if covered:
            found = np.stack(_ranges(*np.array(covered, np.int64).T))
            doc, row, lo = (x[:1].view(U64) for x in found[:3])
            rows.append((-1 - int(mix(mix(mix(doc) + row) + lo)[0] >> U64(1)), b"", b"", found.tobytes(), b""))
        names = ["bucket", "lcp", "tails", "meta", "before"]
        release()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), *[pa.binary()] * 4], strict=True)], names)

    for batch in batches:
        for part in in_runs(batch):
            texts = unpacked(part.column("packed"))
            for doc, row, text, found in zip(part.column("doc").to_pylist(), part.column("row").to_pylist(), texts, part.column("open").to_pylist(), strict=True):
                raw = text.as_py()
                for r in found:
                    lo, hi, at = r["lo"], r["hi"], r["at"]
                    if hi + width <= len(raw):
                        held.append((raw[at : hi + width], raw[lo:at], at - hi, doc, row, at))
            if len(held) > RUN:
                yield from out()
    if held:
        yield from out()


def _merge(table_of_runs: pa.Table, width: int) -> pa.Table:
    """Merge the runs of a range and find the windows that occur more than once; doc, row, lo, hi of their starts."""
    names = ["doc", "row", "lo", "hi"]
    rows = table_of_runs.to_pylist()
    if rows[0]["bucket"] < 0:
        covered = np.concatenate([np.frombuffer(r["meta"], np.int64).reshape(4, -1) for r in rows], axis=1)
        return pa.Table.from_batches([_rows(names, *_ranges(*covered))])
    metas = [np.frombuffer(r["meta"], np.int64).reshape(6, -1) for r in rows]
    tree = LoserTree([front_decode(np.frombuffer(r["lcp"], np.int32), m[0], r["tails"]) for r, m in zip(rows, metas, strict=True)])
    merged_order = np.fromiter((x for pair in tree for x in pair), np.int64).reshape(-1, 2)
    run, lcp = merged_order.T
    base = np.cumsum([0, *(m.shape[1] for m in metas)])
    inner = np.zeros(len(run), np.int64)  # each run keeps its order
    for i in range(len(rows)):
        inner[run == i] = np.arange(metas[i].shape[1])
    _, left, back, doc, row, at = np.concatenate(metas, axis=1)[:, base[run] + inner]
    # The bytes before each anchor, nearest first.
    before = np.zeros((len(run), width - GRAM), np.uint8)
    starts = np.cumsum([0, *left[np.argsort(base[run] + inner)]])[base[run] + inner]
    raw = np.frombuffer(b"".join(r["before"] for r in rows), np.uint8)
    for d in range(int(left.max(initial=0))):
        has = left > d
        before[has, d] = raw[starts[has] + left[has] - 1 - d]
    near = np.maximum(lcp, np.append(lcp[1:], 0)) >= GRAM
    # For each anchor the distance at which its present row of repeated windows began; a row that ends is a range.
    began = np.full(len(run), -1, np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    hashed = np.zeros(len(run), U64)
    for d in range(width - GRAM + 1):
        if d:
            hashed = hashed * U64(0x100000001B3) + BYTE[before[:, d - 1]]
        rows_at = np.flatnonzero(near & (left >= d) & (back <= d))
        hit = np.zeros(len(run), bool)
        if len(rows_at) > 1:
            block = np.cumsum(lcp < width - d)[rows_at]
            key = mix(hashed[rows_at] ^ (block.astype(U64) * U64(0x9E3779B97F4A7C15)))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            hit[rows_at[order[np.append(same, False) | np.append(False, same)]]] = True
        ended = np.flatnonzero((began >= 0) & ~hit)
        found.append((doc[ended], row[ended], at[ended] - d + 1, at[ended] - began[ended]))
        began[ended] = -1
        began[hit & (began < 0)] = d
    ended = np.flatnonzero(began >= 0)
    found.append((doc[ended], row[ended], at[ended] - (width - GRAM), at[ended] - began[ended]))
    release()
    return pa.Table.from_batches([_rows(names, *_ranges(*(np.concatenate(x) for x in zip(*found, strict=True))))])


def repeated_strings(docs: DataFrame, width: int = 200) -> DataFrame:
    """doc, row (of its text), ranges (lo, hi): the starts of all strings of ``width`` bytes that also start elsewhere."""
    spark = docs.sparkSession
    texts = docs.select(doc_key().alias("doc"), text_key().alias("row"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(lambda it: _anchor_rows(it, width), "key long, doc long, row long, lo long, hi long, at long, lead long, kind byte")
    shared = written(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "doc long, row long, lo long, hi long, at long, lead long"), "shared-anchors")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = shared.select(F.percentile_approx("lead", F.array(*[F.lit(i / n) for i in range(1, n)] or [F.lit(0.5)]), F.lit(20_000))).first()[0]
    cuts = np.unique(np.array(cuts or [], np.int64))
    open_at = shared.groupBy("doc", "row").agg(F.collect_list(F.struct("lo", "hi", "at")).alias("open"))
    at = packed_texts(docs, doc=doc_key(), row=text_key()).join(open_at.hint("shuffle_hash"), ["doc", "row"])
    front = at.mapInArrow(lambda it: _sorted_runs(it, width, cuts), "bucket long, lcp binary, tails binary, meta binary, before binary")
    found = front.groupBy("bucket").applyInArrow(lambda t: _merge(t, width), "doc long, row long, lo long, hi long")
    return found.groupBy("doc", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in batches:
        for part in in_runs(batch):
            rows = []
            for text, found in zip(unpacked(part.column("packed")), part.column("ranges").to_pylist(), strict=True):
                raw = text.as_py()
                spans: list[list[int]] = []
                for r in sorted((r["lo"], min(r["hi"] + width, len(raw))) for r in found or () if r["lo"] < len(raw)):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append(list(r))
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(spans), kept))
            n, gone, spans, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc"), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(kept, pa.binary())], names)


def dedup_bytes(docs: DataFrame, width: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: each text without the bytes of strings that occur more than once.

    A string is ``width`` UTF-8 bytes of one text; it counts where it starts at two places of any texts, overlapping
    ones included.  All strings are judged on the input.  ``kept`` is binary, as a cut may fall inside a character.
    Null or empty text: no bytes.  Null doc_id: kept as null.  Rows of equal doc_id (or of none) are told apart by
    their texts, and each loses only what its own text repeats; of repeated rows each loses what they share, as the
    strings of one start in the other.  Texts of any length are worked on whole.  Other columns are ignored.
    """
    at = packed_texts(docs, doc=doc_key(), row=text_key()).join(repeated_strings(docs, width).hint("shuffle_hash"), ["doc", "row"], "left")
    done = at.mapInArrow(lambda it: _cut(it, width), "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(id_of("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; cases as in ``dedup_bytes``."""
    kept = dedup_bytes(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as slices of bytes, counted by their hash; touching windows make one span.
OP7_SQL = r"""
WITH n AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(1, n - 198)) AS i, unnest(list_transform(range(1, n - 198), lambda i: md5(b[i:i + 199]))) AS m FROM n WHERE n >= 200),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
g AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM r),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM g),
sp AS (SELECT doc_id, s, min(i) AS a, max(i) + 200 AS e FROM k GROUP BY doc_id, s),
p AS (SELECT doc_id, lag(e, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS f, a AS t FROM sp UNION ALL SELECT doc_id, max(e), NULL FROM sp GROUP BY doc_id),
kept AS (SELECT p.doc_id, string_agg(CASE WHEN f < coalesce(t, n + 1) THEN hex(b[f:coalesce(t, n + 1) - 1]) ELSE '' END, '' ORDER BY f) AS x FROM p JOIN n USING (doc_id) GROUP BY p.doc_id),
c AS (SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans FROM sp GROUP BY doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN x IS NULL THEN b ELSE unhex(x) END) AS kept_sha256
FROM n LEFT JOIN kept USING (doc_id) LEFT JOIN c USING (doc_id)
"""
