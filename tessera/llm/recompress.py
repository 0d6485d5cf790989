"""Operator 4: remove word sequences that occurred before, found through recompression symbols.

Recompression renames a sequence round by round: first every maximal run of one symbol gets a name, then every pair
of a left and a right symbol.  A name is a hash of what it stands for, so all executors give the same name to the same
thing and no dictionary is exchanged.  Which symbols a stretch of words gets inside depends on that stretch alone but
for its borders; ``symbols`` keeps track of exactly which words decided each symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrays import U64, Words, merged, mix, prefix_hash, release, runs, signed, span_hash
from tessera.llm.common import doc_key, id_of, in_runs, packed_texts, table, text_key, unpacked, written

FAR = 1 << 40
ROUNDS = 2
#: A symbol can stand for a window if at most so many words decided it.
CONTEXT = 8


def symbols(names: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The symbols after some rounds: name, length in words, and the range [lo, hi) of the words that decided it.

    Where the border of the document took part in a decision, lo or hi lies far outside.
    """
    name, d = names, doc
    start = np.arange(len(name))
    end, lo, hi = start + 1, start, start + 1
    for level in range(rounds):
        if not len(name):
            break
        # Runs: a run is decided by itself and by its neighbours, which differ from it.
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(name)) - 1
        count = last - first + 1
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(name) - 1)
        lo, hi = (
            np.where((first > 0) & (d[before] == d[first]), lo[before], -FAR),
            np.where((last < len(name) - 1) & (d[after] == d[last]), hi[after], FAR),
        )
        start, end, d, name = start[first], end[last], d[first], name[first]
        name = np.where(count > 1, mix(name + U64(0x632BE59BD9B4E019) * count.astype(U64)), name)
        # Pairs: a left symbol joins a right symbol that follows it. A pair is decided by itself alone.
        n = len(name)
        right = (mix(name ^ U64(0xD6E8FEB86659FD93 + 2 * level)) >> U64(63)).astype(bool)
        pair = np.zeros(n, bool)
        pair[:-1] = ~right[:-1] & right[1:] & (d[1:] == d[:-1])
        joined = np.zeros(n, bool)
        joined[1:] = pair[:-1]
        nxt, prv = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
        same_next, same_prev = (d[nxt] == d) & (nxt > prv) & (np.arange(n) < n - 1), (d[prv] == d) & (np.arange(n) > 0)
        new_hi = np.where(pair, hi[nxt], np.where(right, hi, np.where(same_next, hi[nxt], FAR)))
        new_lo = np.where(pair | ~right, lo, np.where(same_prev, lo[prv], -FAR))
        name = np.where(pair, mix(name * U64(0x9FB21C651E98DF25) + name[nxt] + U64(level + 1)), name)
        end = np.where(pair, end[nxt], end)
        keep = ~joined
        name, start, end, lo, hi, d = name[keep], start[keep], end[keep], new_lo[keep], new_hi[keep], d[keep]
    return name, end - start, lo, hi


def window_anchors(names: np.ndarray, first: np.ndarray, doc: np.ndarray, width: int, rounds: int = ROUNDS, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of ``width`` words inside a document: its start, the name and the place of its anchor.

    The anchor is the best symbol (longest, then smallest hash, then leftmost) that at most ``context`` words decided,
    all inside the window.  Equal windows so have equal anchors at equal distances.  A window without such a symbol
    is its own anchor.
    """
    n = len(names)
    starts = np.arange(n)
    in_doc = starts + width <= first[doc + 1] if n else np.zeros(0, bool)
    best = np.full(n + width, np.iinfo(np.uint64).max, U64)
    name, length, lo, hi = symbols(names, doc, rounds)
    usable = hi - lo <= context
    name, length, lo = name[usable], length[usable], lo[usable]
    hashed = mix(name + U64(0x2545F4914F6CDD1D))
    rank = ((U64(15) - np.minimum(length, 15).astype(U64)) << U64(60)) | (hashed >> U64(4))
    if len(lo):
        order = np.lexsort((rank, lo))
        keep = np.ones(len(order), bool)
        keep[1:] = lo[order][1:] != lo[order][:-1]
        best[lo[order][keep]] = rank[order][keep]
    # The minimum over the places start .. start + width - context, by doubling.
    span, reach, least = width - context + 1, 1, best
    place = np.arange(len(best))
    while reach < span:
        step = min(reach, span - reach)
        a, b = least[: len(least) - step], least[step:]
        later = b < a
        place = np.where(later, place[step:], place[: len(least) - step])
        least = np.where(later, b, a)
        reach += step
    least, place = least[:n], place[:n]
    w = starts[in_doc]
    key, at = least[w], place[w]
    alone = key == np.iinfo(np.uint64).max
    if alone.any():
        prefix = prefix_hash(names)
        key[alone] = mix(span_hash(prefix, w[alone], w[alone] + width) ^ U64(0xA24BAED4963EE407))
        at[alone] = w[alone]
    return w, key, at


#: A task hands on its anchors, those with equal surroundings merged, whenever it holds this many.
HELD = 200_000
COVERED, OPEN = 1, 0


def _ranges(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges [lo, hi] of window starts, the last two columns, merged within the columns before these (doc, or doc and row)."""
    *keys, lo, hi = columns
    if not len(lo):
        return columns
    order = np.lexsort((lo, *keys[::-1]))
    *keys, lo, hi = (x[order] for x in columns)
    new = np.zeros(len(lo), bool)
    new[0] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    shift = group * FAR  # keeps documents apart
    a, b = merged(lo + shift, hi + 1 + shift)
    g = a // FAR
    return *(x[first][g] for x in keys), a - g * FAR, b - g * FAR - 1


def _by_place(doc: np.ndarray, row: np.ndarray, lo: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order by keys (last one first) and place; in that order: new keys, which to keep, and which come later.

    A place is a doc and a start: equal places of unlike rows do not come before each other, so all at the first place
    are kept, one for each row.
    """
    order = np.lexsort((row, lo, doc, *keys))
    doc, row, lo, *keys = (x[order] for x in (doc, row, lo, *keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (doc != doc[at]) | (lo != lo[at])
    again = np.zeros(len(order), bool)
    again[1:] = ~new[1:] & (row[1:] == row[:-1])
    return order, new, ~later & ~again, later


def _anchor_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Anchors of all windows: key, surroundings, doc, row, lo, hi (window starts), kind.

    Of anchors with equal surroundings only those at the first place that the task holds stay open; the others' windows
    all occur earlier and are covered.  So a passage that a third of all documents repeat leaves a row for each task.
    """
    names = ["key", "around", "doc", "row", "lo", "hi", "kind"]
    held: list[tuple[np.ndarray, ...]] = []

    def out() -> Iterator[pa.RecordBatch]:
        key, around, doc, row, lo, hi = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order, _, keep, later = _by_place(doc, row, lo, around, key)
        stay = np.sort(order[keep])
        yield _rows(names, key[stay], around[stay], doc[stay], row[stay], lo[stay], hi[stay], np.full(len(stay), OPEN, np.int8))
        gone = order[later]
        d, r, a, b = _ranges(doc[gone], row[gone], lo[gone], hi[gone])
        if len(d):
            yield _rows(names, mix(d.view(U64) + r.view(U64) + a.astype(U64)), np.zeros(len(d), U64), d, r, a, b, np.full(len(d), COVERED, np.int8))
        release()

    for batch in batches:
        for part in runs(batch):
            ids, rows = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "row"))
            words = Words(part.column("text"))
            hashes = words.hashes()
            start, key, at = window_anchors(hashes, words.first, words.doc, width)
            if not len(start):
                continue
            new = np.append(True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))
            a = start[new]
            b = start[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
            prefix = prefix_hash(hashes)
            around = mix(span_hash(prefix, a, b + width) + U64(0x9E3779B97F4A7C15) * (at[new] - a).astype(U64) + U64(31) * (b - a).astype(U64))
            d = words.doc[a]
            held.append((key[new], around, ids[d], rows[d], a - words.first[d], b - words.first[d]))
            if sum(len(x[0]) for x in held) > HELD:
                yield from out()
    if held:
        yield from out()


def _rows(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(c) if c.dtype == np.uint64 else c) for c in columns], names)


def in_order(batches: Iterator[pa.RecordBatch], *names: str, size: int = HELD) -> Iterator[list[np.ndarray]]:
    """The columns of a task's sorted rows, about ``size`` rows at a time; a group may go on in the next part."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if b.num_rows:
            held.append([b.column(n).to_numpy(zero_copy_only=False) for n in names])
        if sum(len(x[0]) for x in held) >= size:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows, those whose keys are not those of the row before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    return new


SETTLED_BY = ["key", "around", "doc", "lo", "row"]


def _settle(batches: Iterator[pa.RecordBatch], size: int = HELD) -> Iterator[pa.RecordBatch]:
    """Anchors sorted by ``SETTLED_BY``: those with equal surroundings are covered but at their first place; if surroundings differ, the firsts stay open.

    Of the rows before a part only the first of the last surroundings is remembered, and the firsts that wait for a
    second kind of surroundings.  If more than ``size`` wait, they stay open, which costs a comparison and changes no result.
    """
    names = ["doc", "row", "lo", "hi", "kind"]
    head: list[np.ndarray] = []
    several, waiting = False, [np.zeros(0, np.int64)] * 4
    for key, around, doc, row, lo, hi, kind in in_order(batches, "key", "around", "doc", "row", "lo", "hi", "kind", size=size):
        done = kind == COVERED
        passed = [doc[done], row[done], lo[done], hi[done]]
        columns = [x[~done] for x in (key, around, doc, row, lo, hi)]
        old = len(head[0]) if head else 0
        if head:
            columns = [np.concatenate(x) for x in zip(head, columns, strict=True)]
        key, around, doc, row, lo, hi = columns
        opened = [np.zeros(0, np.int64)] * 4
        if len(key):
            new = _begins(key, around)
            at = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (doc != doc[at]) | (lo != lo[at])
            again = ~new & np.append(False, row[1:] == row[:-1])
            first = ~later & ~again
            first[:old] = False  # went out or waits already
            of = np.cumsum(_begins(key)) - 1
            kinds = np.bincount(of, new) + (np.arange(of[-1] + 1) == 0) * several
            many = kinds[of] > 1
            opened = [x[first & many] for x in (doc, row, lo, hi)]
            passed = [np.concatenate([p, x[later]]) for p, x in zip(passed, (doc, row, lo, hi), strict=True)]
            if kinds[0] > 1:
                opened = [np.concatenate(x) for x in zip(waiting, opened, strict=True)]
            if of[-1] > 0 or kinds[0] > 1:
                waiting = [np.zeros(0, np.int64)] * 4
            several = bool(kinds[-1] > 1)
            if not several:
                waiting = [np.concatenate([w, x[first & (of == of[-1])]]) for w, x in zip(waiting, (doc, row, lo, hi), strict=True)]
            if len(waiting[0]) > size:
                opened = [np.concatenate(x) for x in zip(waiting, opened, strict=True)]
                several, waiting = True, [np.zeros(0, np.int64)] * 4
            head = [x[at[-1] : at[-1] + 1] for x in columns]
        for found, kind_out in ((passed, COVERED), (opened, OPEN)):
            d, r, a, b = _ranges(*found)
            yield _rows(names, d, r, a, b, np.full(len(d), kind_out, np.int8))
        release()


def _open_windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """key (hash of the window's words), doc, row, start of each window in the open ranges; of equal ones only those at the first place that the task holds stay open."""
    names = ["key", "doc", "row", "start", "kind"]
    held: list[tuple[np.ndarray, ...]] = []

    def out() -> Iterator[pa.RecordBatch]:
        key, doc, row, start = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order, _, keep, later = _by_place(doc, row, start, key)
        stay = np.sort(order[keep])
        yield _rows(names, key[stay], doc[stay], row[stay], start[stay], np.full(len(stay), OPEN, np.int8))
        gone = order[later]
        if len(gone):
            yield _rows(names, mix(doc[gone].view(U64) + row[gone].view(U64)), doc[gone], row[gone], start[gone], np.full(len(gone), COVERED, np.int8))
        release()

    for batch in batches:
        for part in in_runs(batch):
            words = Words(unpacked(part.column("packed")))
            hashes = words.hashes()
            prefix = prefix_hash(hashes)
            ids, rows = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "row"))
            where = []
            for i, found in enumerate(part.column("open").to_pylist()):
                for r in found:
                    where.append(np.arange(r["lo"], r["hi"] + 1) + words.first[i])
            start = np.unique(np.concatenate(where)) if where else np.zeros(0, np.int64)
            start = start[start + width <= len(hashes)]
            d = words.doc[start]
            start = start[start + width <= words.first[d + 1]]
            d = words.doc[start]
            held.append((mix(span_hash(prefix, start, start + width)), ids[d], rows[d], start - words.first[d]))
            if sum(len(x[0]) for x in held) > HELD:
                yield from out()
    if held:
        yield from out()


def _settle_windows(batches: Iterator[pa.RecordBatch], size: int = HELD) -> Iterator[pa.RecordBatch]:
    """Windows sorted by key, doc and start: all are covered but those at the first place of their key."""
    head: list[np.ndarray] = []
    for key, doc, row, start, kind in in_order(batches, "key", "doc", "row", "start", "kind", size=size):
        done = kind == COVERED
        columns = [x[~done] for x in (key, doc, row, start)]
        if head:
            columns = [np.concatenate(x) for x in zip(head, columns, strict=True)]
        k, d, r, s = columns
        new = _begins(k)
        at = np.flatnonzero(new)[np.cumsum(new) - 1]
        gone = (d != d[at]) | (s != s[at])
        if len(k):
            head = [x[at[-1] : at[-1] + 1] for x in columns]
        d, r, s = (np.concatenate([x[done], y[gone]]) for x, y in ((doc, d), (row, r), (start, s)))
        yield _rows(["doc", "row", "lo", "hi"], *_ranges(d, r, s, s))
        release()


def repeated_windows(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc, row (of its text), ranges (lo, hi): the starts of all windows of ``width`` words whose words also start earlier."""
    texts = docs.select(doc_key().alias("doc"), text_key().alias("row"), F.col("text").cast("string").alias("text"))
    anchors = texts.mapInArrow(lambda it: _anchor_batches(it, width), "key long, around long, doc long, row long, lo long, hi long, kind byte")
    settled = written(anchors.repartition("key").sortWithinPartitions(*SETTLED_BY).mapInArrow(_settle, "doc long, row long, lo long, hi long, kind byte"), "repeat-ranges")
    # Anchors that occur in unlike surroundings: compare their windows one by one.
    undecided = settled.where(F.col("kind") == OPEN).groupBy("doc", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("open"))
    at = packed_texts(docs, doc=doc_key(), row=text_key()).join(undecided.hint("shuffle_hash"), ["doc", "row"])
    windows = at.mapInArrow(lambda it: _open_windows(it, width), "key long, doc long, row long, start long, kind byte")
    more = windows.repartition("key").sortWithinPartitions("key", "doc", "start").mapInArrow(_settle_windows, "doc long, row long, lo long, hi long")
    both = settled.where(F.col("kind") == COVERED).select("doc", "row", "lo", "hi").unionByName(more)
    return both.groupBy("doc", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def _removed(words: Words, ranges: list, width: int) -> np.ndarray:
    """For each word whether a window that starts in one of its text's ranges covers it."""
    gone = np.zeros(len(words.start) + 1, np.int64)
    for i, found in enumerate(ranges):
        n = words.first[i + 1] - words.first[i]
        for r in found or ():
            if r["lo"] < n:
                gone[words.first[i] + r["lo"]] += 1
                gone[words.first[i] + min(r["hi"] + width, n)] -= 1
    return np.cumsum(gone)[:-1] > 0


def _kept(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, bytes]]]]:
    """For each slice of packed texts: words, removed words, and the kept words joined by one space."""
    for batch in batches:
        for part in in_runs(batch):
            words = Words(unpacked(part.column("packed")))
            removed = _removed(words, part.column("ranges").to_pylist(), width)
            rows = []
            for i in range(part.num_rows):
                a, b = words.first[i], words.first[i + 1]
                keep = np.flatnonzero(~removed[a:b]) + a
                rows.append((int(b - a), int(b - a - len(keep)), b" ".join([words.bytes_of(j) for j in keep])))
            yield part, rows


def dedup(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each document without the words of windows that occurred before.

    A window is ``width`` consecutive words of one document; it occurred before if the same words start in a document
    of smaller id or earlier in the same document.  All windows are judged on the input.  Null or empty text: no
    words, empty kept text.  Null doc_id: comes before all others.  Rows of equal doc_id (or of none) are one
    document to the order, so equal windows at equal starts of two such rows do not remove each other; each row loses
    only what its own text repeats.
    Texts of any length are worked on whole.  Other columns are ignored.
    """
    at = packed_texts(docs, doc=doc_key(), row=text_key()).join(repeated_windows(docs, width).hint("shuffle_hash"), ["doc", "row"], "left")

    def cut(batches):
        for part, rows in _kept(batches, width):
            n, gone, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc", "n_words", "n_removed", "kept_text"])

    done = at.mapInArrow(cut, "doc long, n_words long, n_removed long, kept_text string")
    return done.select(id_of("doc").alias("doc_id"), "n_words", "n_removed", "kept_text")


def dedup_rows(docs: DataFrame, width: int = 20) -> DataFrame:
    """All rows and columns of ``docs``; texts that lose words are their kept words joined by one space, and n_chars follows.

    Cases as in ``dedup``: null and empty texts stay as they are, rows of one doc_id (or of none) are told apart by
    their texts, texts of any length count whole, an empty table gives an empty one.  Columns of any name pass
    through; a column n_chars is updated where a text changes.
    """
    rows = docs.select(doc_key().alias("doc"), text_key().alias("row"), F.struct("*").alias("whole"), F.col("text").cast("string").alias("text"))
    at = rows.join(repeated_windows(docs, width).hint("shuffle_hash"), ["doc", "row"], "left")
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch):
                words = Words(part.column("text"))
                removed = _removed(words, part.column("ranges").to_pylist(), width)
                changed = np.diff(np.append(0, np.cumsum(removed))[words.first]) > 0
                columns = part.column("whole").flatten()
                texts = columns[names.index("text")].to_pylist()
                for i in np.flatnonzero(changed).tolist():
                    keep = np.flatnonzero(~removed[words.first[i] : words.first[i + 1]]) + words.first[i]
                    texts[i] = b" ".join([words.bytes_of(j) for j in keep]).decode()
                columns[names.index("text")] = pa.array(texts, pa.string())
                if "n_chars" in names:
                    n = columns[names.index("n_chars")]
                    columns[names.index("n_chars")] = pa.array([len(t) if c else x for t, c, x in zip(texts, changed, n.to_pylist(), strict=True)], n.type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return at.select("whole", "text", "ranges").mapInArrow(cut, docs.schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; cases as in ``dedup``."""
    kept = dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i + 19], ' ')))) AS h FROM d WHERE len(w) >= 20),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
ps AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
k AS (SELECT ps.doc_id, count(g.p) AS n_removed, coalesce(string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY ps.p), '') AS kept FROM ps LEFT JOIN gone g ON ps.doc_id = g.doc_id AND ps.p = g.p GROUP BY ps.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
