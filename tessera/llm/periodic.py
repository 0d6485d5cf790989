"""Operator 12: runs, the maximal stretches in which the same words come round at least three times.

A run with smallest period q that starts at s and has length L is one maximal pair: the suffixes at s and s + q share
exactly their first L - q words, and the words left of them differ.  Maximal pairs are read from the tree of LCP
intervals, from the deepest interval up: the positions of an interval come from its children, pairs are those of
unlike children and unlike left words, and a pair whose common prefix is at least twice its distance is a run as it
stands; nothing is extended.

The positions of an interval are one list in text order, each with its left word as its class.  Only neighbours in that
list can be a run's pair: the common prefix is u, with len(u) >= 2 q; a third occurrence of u between the two would give
u two periods whose sum is at most len(u), so a common divisor of both as a period, and q would not be the smallest.
Neighbours of one class are passed over, as the pair could be extended to the left.  So each position looks at two
neighbours when its list joins a longer one, whatever the number of classes, and lists always join the longest.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrays import U64, mix
from tessera.llm.arrays import runs as slices
from tessera.llm.common import table

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: The common prefix of a run's pair has at least so many words: those of the run without one period, which is a third at most.
PREFIX = LEAST_WORDS - LEAST_WORDS // LEAST_PERIODS


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and its inverse, by doubling; only suffixes that are still tied are sorted again."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    new = np.append(True, ids[order][1:] != ids[order][:-1])
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    tied = order[~(new & np.append(new[1:], True))]
    h = 1
    while len(tied):
        base = rank[tied]
        then = np.where(tied + h < n, rank[np.minimum(tied + h, n - 1)] + 1, 0)
        by = np.lexsort((then, base))
        tied, base, then = tied[by], base[by], then[by]
        outer = np.append(True, base[1:] != base[:-1])
        inner = outer | np.append(True, then[1:] != then[:-1])
        at = np.arange(len(tied))
        rank[tied] = base + np.maximum.accumulate(np.where(inner, at, 0)) - np.maximum.accumulate(np.where(outer, at, 0))
        tied = tied[~(inner & np.append(inner[1:], True))]
        h *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, rank


def common_prefixes(ids: list[int], suffixes: list[int], rank: list[int], wanted: list[int]) -> dict[int, int]:
    """By rank, the words that the suffixes at the ``wanted`` places (ascending) share with the suffix before them in order."""
    n, h, last, out = len(ids), 0, -2, {}
    for i in wanted:
        h = max(h - 1, 0) if i == last + 1 else 0
        last = i
        r = rank[i]
        if r == 0:
            h = 0
            continue
        j = suffixes[r - 1]
        end = n - max(i, j)
        while h < end and ids[i + h] == ids[j + h]:
            h += 1
        out[r] = h
    return out


def _joined(length: int, children: list[list[int]], left: list[int], found: list[tuple[int, int, int]]) -> list[int]:
    """The positions of an interval from those of its children; its runs are added to ``found``."""
    all_of = max(children, key=len)
    child = {x: k for k, c in enumerate(children) if c is not all_of for x in c}
    if 8 * len(child) < len(all_of):
        for x in child:
            insort(all_of, x)
    else:
        all_of.extend(child)
        all_of.sort()
    for x, k in child.items():
        at = bisect_left(all_of, x)
        pairs = [(all_of[at - 1], x)] if at else []
        if at + 1 < len(all_of) and all_of[at + 1] not in child:
            pairs.append((x, all_of[at + 1]))
        for a, b in pairs:
            q = b - a
            if child.get(a) != child.get(b) and left[a] != left[b] and length >= (LEAST_PERIODS - 1) * q and length + q >= LEAST_WORDS:
                found.append((a, length + q, q))
    return all_of


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers, by start, then period."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    # Places whose next words, PREFIX of them, come again; most texts have none.
    windows = mix(ids.astype(U64) + U64(1))
    for k in (1, 2, 4, 8):
        windows = mix(windows[:-k] * U64(0x9E3779B97F4A7C15) + windows[k:])
    assert len(windows) == n - PREFIX + 1
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return []
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    suffixes, rank = suffix_order(ids)
    words, ranks, sa = ids.tolist(), rank.tolist(), suffixes.tolist()
    shared = common_prefixes(words, sa, ranks, np.flatnonzero(again).tolist())
    left = [-1, *words]
    found: list[tuple[int, int, int]] = []
    open_: list[tuple[int, list[list[int]]]] = []  # the intervals that are not ended: common prefix, children

    def end(above: int, positions: list[int]) -> list[int]:
        """End the intervals with a longer common prefix than ``above``; the positions of the last."""
        while open_ and open_[-1][0] > above:
            length, children = open_.pop()
            children.append(positions)
            positions = _joined(length, children, left, found)
        return positions

    last = -1
    for r in sorted(r for r, h in shared.items() if h >= PREFIX):
        if r - 1 != last and last >= 0:
            end(0, [sa[last]])
        positions = end(shared[r], [sa[r - 1]])
        if open_ and open_[-1][0] == shared[r]:
            open_[-1][1].append(positions)
        else:
            open_.append((shared[r], [positions]))
        last = r
    if last >= 0:
        end(0, [sa[last]])
    return sorted(found, key=lambda x: (x[0], x[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))


def made_periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as they are, or for a tenth of all ids a stretch of them over and over from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * -(-(n - a) // p))[: n - a]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not found:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for s, length, q in found:
        edges[s + q] += 1
        edges[s + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()]


def highest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact exponent; of equal ones the first to start, then the shortest period."""
    best = None
    for s, length, q in found:  # by start, then period
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    return best


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, change: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_runs, start, length, period, runs, collapsed: the runs of each text.

    Words are what white space (ASCII) separates.  A run is a stretch with smallest period q, of at least 24 words and
    three periods, that no neighbouring word continues.  ``runs`` has all of them by start, then period; start, length
    and period are those of the run with the greatest exact length / period (ties: smallest start, then period), null
    without a run; ``collapsed`` is the text's words joined by one space, without those that a run holds after its first
    period.  ``change`` may replace the words of a text, given them and the doc_id.

    Null and empty texts have no words, no runs and an empty ``collapsed``.  Every row is worked on by itself: null and
    repeated ids and repeated rows keep a row each, an empty table gives none, other columns are not looked at.  Texts are
    worked on whole and one at a time; what is held is about ten times the longest text, or a few times that if all of it repeats.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc_id, x in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    words = x.as_buffer().to_pybytes().split() if x.is_valid else []
                    if change is not None:
                        words = change(words, doc_id)
                    found = runs_of(numbered(words))
                    triples = [dict(zip(("start", "length", "period"), r, strict=True)) for r in found]
                    out.append((len(found), *(highest(found) or (None, None, None)), triples, b" ".join(collapsed(words, found))))
                n, start, length, period, triples, text = zip(*out, strict=True)
                columns = [*(pa.array(c, pa.int64()) for c in (n, start, length, period)), pa.array(triples, RUNS), pa.array(text, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_runs", "start", "length", "period", "runs", "collapsed"])

    schema = "doc_id long, n_runs long, start long, length long, period long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent, and digests of all runs and of the collapsed text, for every document.

    A tenth of the documents (by the checksum of their id) are made periodic from some word on; a null id is not.
    Cases as in ``periodic_runs``.
    """
    found = periodic_runs(table(spark, sf_dir, "documents"), made_periodic)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n", "")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    sha = lambda x: F.sha2(F.encode(x, "utf-8"), 256)
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
