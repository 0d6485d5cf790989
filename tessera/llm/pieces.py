"""Operator 1: SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct stretches (a space and the letters after it) are written one after the other and indexed by a
suffix array.  Binary search finds the range of suffixes that begin with each piece of the vocabulary, so all places
of all pieces are known; these edges are sorted by the position where they end and relaxed in this order.  A BPE
encoding is the one path whose neighbouring pieces would not have merged otherwise, so of the edges that end at a
position exactly one extends an encoding: the one that is compatible with the last piece at its start.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrays import U64, mix, release, runs, text_hashes, texts_of
from tessera.llm.common import doc_key, id_of, table

#: Fixed values of the format: the mark that stands for a space, and the kinds of pieces.
MARK = "▁"
NORMAL, BYTE_PIECE = 1, 6
SEPARATOR = 0xFF
#: Encodings of stretches that a worker keeps; pairs of pieces whose compatibility it keeps.
CACHED, PAIRS = 1_500_000, 1 << 21
#: Longer stretches are relaxed one by one, in windows of so many bytes; shorter ones all at once.
LONGEST, WINDOW = 64, 1 << 16
#: Pairs of pieces whose compatibility is kept for long stretches.
REMEMBERED = 500_000


def model_path() -> str:
    """The default vocabulary file: that of the public tokenizers package, which every worker has installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.name != "identity" or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError(f"{path}: only BPE models with the identity normaliser and a dummy prefix are supported")
        self.pieces = [p.piece for p in proto.pieces]
        self.raw = [p.piece.replace(MARK, " ").encode() if p.type == NORMAL else b"" for p in proto.pieces]
        self.byte_ids = np.zeros(256, np.int32)
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE_PIECE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.raw[i] = bytes([int(p.piece[3:5], 16)])
        # In texts the mark itself and a space are the same, so pieces are kept with spaces.
        self.id_of = {p.piece.replace(MARK, " "): i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = {i: proto.pieces[i].score for i in self.id_of.values()}
        text = {i: s for s, i in self.id_of.items()}
        # Rank: 0 for single characters, then by falling score.
        merged = sorted((i for i in text if len(text[i]) > 1), key=lambda i: -self.score[i])
        self.rank = dict.fromkeys(text, 0) | {i: r for r, i in enumerate(merged, 1)}
        self.text, self.left, self.right = text, {}, {}
        self.usable = set()
        for i, s in text.items():
            if len(s) == 1:
                self.usable.add(i)
            elif s.strip(" "):
                parts = self.merge(s, stop=i)
                if parts is not None:
                    self.left[i], self.right[i] = parts
                    self.usable.add(i)
        order = sorted(self.usable, key=lambda i: self.text[i].encode())
        self.ids = np.array(order, np.int64)
        self.strings = [self.text[i].encode() for i in order]
        self.lengths = np.array([len(s) for s in self.strings], np.int64)
        self.length_of = np.zeros(len(self.pieces), np.int64)
        self.length_of[self.ids] = self.lengths

    def merge(self, s: str, stop: int | None = None) -> list[int] | tuple[int, int] | None:
        """BPE by definition: merge the neighbours of best score (leftmost first) until none is left. With ``stop``: the last merge that makes this piece, or none."""
        parts: list[str] = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.id_of.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.score[j] > best):
                    best, at = self.score[j], i
            if best is None:
                break
            if stop is not None and len(parts) == 2:
                return self.id_of[parts[0]], self.id_of[parts[1]]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if stop is not None:
            return None
        out: list[int] = []
        for p in parts:
            out += [self.id_of[p]] if p in self.id_of else self.byte_ids[list(p.replace(" ", MARK).encode() if p == " " else p.encode())].tolist()
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the texts of two pieces as these two pieces: no merge across comes before those inside."""
        limit = 1 << 60
        while True:
            m = self.id_of.get(self.text[a] + self.text[b])
            if m is not None and self.rank[m] < limit:
                return False
            if self.rank[a] > self.rank[b]:
                limit, a = self.rank[a], self.right[a]
            elif self.rank[b] == 0:
                return True
            else:
                limit, b = self.rank[b] + 1, self.left[b]


def _words8(raw: np.ndarray, skip: int) -> np.ndarray:
    """For each position the next eight bytes after ``skip`` as one number, big end first; beyond the end separators."""
    padded = np.concatenate([raw, np.full(skip + 8, SEPARATOR, np.uint8)])
    out = np.zeros(len(raw), U64)
    for i in range(8):
        out = (out << U64(8)) | padded[skip + i : skip + i + len(raw)]
    return out


def _bounds(strings: list[bytes], skip: int) -> tuple[np.ndarray, np.ndarray]:
    cut = [s[skip : skip + 8] for s in strings]
    low = np.array([int.from_bytes(s.ljust(8, b"\0"), "big") for s in cut], U64)
    high = np.array([int.from_bytes(s.ljust(8, b"\xff"), "big") for s in cut], U64)
    return low, high


class Encoder:
    """Encodes stretches; keeps what it has encoded."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = v = vocabulary
        self.low0, self.high0 = _bounds(v.strings, 0)
        self.low1, self.high1 = _bounds(v.strings, 8)
        self.pair_key = np.full(PAIRS, -1, np.int64)
        self.pair_ok = np.zeros(PAIRS, bool)
        self.forget()

    def forget(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # sorted keys, begin, count; each level far larger than the next
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _keep(self, keys: np.ndarray, found: list[np.ndarray]) -> None:
        count = np.array([len(x) for x in found], np.int64)
        total = int(count.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
        self.flat[self.used : self.used + total] = np.concatenate(found)
        level = (keys, self.used + np.cumsum(count) - count, count)
        self.used += total
        while self.levels and 4 * len(level[0]) > len(self.levels[-1][0]):
            both = [np.concatenate(x) for x in zip(self.levels.pop(), level, strict=True)]
            order = np.argsort(both[0], kind="stable")
            level = tuple(x[order] for x in both)
        self.levels.append(level)

    def _lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each key begin (-1: unknown) and how many they are."""
        begin, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        for known, b, c in self.levels:
            at = np.minimum(np.searchsorted(known, keys[open_]), len(known) - 1)
            hit = known[at] == keys[open_]
            begin[open_[hit]], count[open_[hit]] = b[at[hit]], c[at[hit]]
            open_ = open_[~hit]
        return begin, count

    def edges(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, index of the piece) of every occurrence of every piece in ``raw``."""
        v = self.v
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        k0, k1 = _words8(raw, 0)[starts], _words8(raw, 8)[starts]
        array = np.lexsort((k1, k0))  # the suffix array, by as many bytes as nearly all pieces have
        k0, k1, starts = k0[array], k1[array], starts[array]
        lo, hi = np.searchsorted(k0, self.low0), np.searchsorted(k0, self.high0, "right")
        long = np.flatnonzero((v.lengths > 8) & (lo < hi))
        # Longer pieces: binary search of the next bytes inside the range of the first eight, all pieces at once.
        for bound, keys, right in ((lo, self.low1, False), (hi, self.high1, True)):
            a, b = lo[long].copy() if not right else lo[long].copy(), hi[long].copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                m = np.minimum(mid, len(k1) - 1)
                go = (k1[m] <= keys[long]) if right else (k1[m] < keys[long])
                a, b = np.where(open_ & go, mid + 1, a), np.where(open_ & ~go, mid, b)
            if not right:
                new_lo = a
            else:
                lo[long], hi[long] = new_lo, a
        number = np.maximum(hi - lo, 0)
        piece = np.repeat(np.arange(len(lo)), number)
        place = starts[np.arange(len(piece)) + np.repeat(lo - (np.cumsum(number) - number), number)]
        longest = v.lengths[piece] > 16
        if longest.any():
            good = np.ones(len(piece), bool)
            for e in np.flatnonzero(longest):
                s = v.strings[piece[e]]
                good[e] = raw[place[e] : place[e] + len(s)].tobytes() == s
            piece, place = piece[good], place[good]
        return place, piece

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * (1 << 20) + b
        slot = (mix(key.view(U64)) & U64(PAIRS - 1)).astype(np.int64)
        unknown = self.pair_key[slot] != key
        ok = self.pair_ok[slot]
        if unknown.any():
            fresh, back = np.unique(key[unknown], return_inverse=True)
            found = np.array([self.v.compatible(k >> 20, k & ((1 << 20) - 1)) for k in fresh.tolist()])
            ok[unknown] = found[back]
            at = (mix(fresh.view(U64)) & U64(PAIRS - 1)).astype(np.int64)
            self.pair_key[at] = fresh
            self.pair_ok[at] = found
            # Two fresh pairs may have one slot; the later key stands with its own value.
            self.pair_ok[at] = np.where(self.pair_key[at] == fresh, found, self.pair_ok[at])
        return ok

    def encode_new(self, stretches: list[bytes]) -> list[np.ndarray]:
        v = self.v
        out: list[np.ndarray | None] = [None] * len(stretches)
        plain = []
        for i, s in enumerate(stretches):
            # Runs of spaces have pieces of equal score: by definition.
            if b"  " in s or b"\xe2\x96\x81" in s:
                out[i] = np.array(merge_long(v, s.decode().replace(MARK, " ")), np.int32)
            elif len(s) > LONGEST:
                out[i] = self._encode_long(s)
            else:
                plain.append(i)
        if not plain:
            return out
        lengths = np.array([len(stretches[i]) for i in plain], np.int64)
        begin = np.cumsum(lengths + 1) - lengths - 1
        raw = np.frombuffer(b"".join(stretches[i] + b"\xff" for i in plain), np.uint8)
        place, piece = self.edges(raw)
        owner_at = np.repeat(np.arange(len(plain)), lengths + 1)
        end = place + v.lengths[piece]
        # Characters without a piece: edges of their own, which go with all neighbours.
        char = np.where(raw < 0x80, 1, np.where(raw < 0xE0, 2, np.where(raw < 0xF0, 3, 4)))
        single = ((raw & 0xC0) == 0x80) | (raw == SEPARATOR)
        single[place[end - place == char[place]]] = True
        lone = np.flatnonzero(~single)
        token = np.concatenate([v.ids[piece], np.full(len(lone), -1)])
        place = np.concatenate([place, lone])
        end = np.concatenate([end, lone + char[lone]])
        owner = owner_at[place]
        # Relax the edges by the position in the stretch where they end.
        offset = end - begin[owner]
        order = np.argsort(offset, kind="stable")
        token, place, end, owner, offset = (x[order] for x in (token, place, end, owner, offset))
        step = np.flatnonzero(np.append(True, offset[1:] != offset[:-1]))
        NONE, START = -3, -2
        last = np.full(len(raw) + 1, NONE, np.int64)
        last_start = np.zeros(len(raw) + 1, np.int64)
        last[begin] = START
        for a, b in zip(step.tolist(), [*step[1:].tolist(), len(token)], strict=True):
            before, t = last[place[a:b]], token[a:b]
            ok = before != NONE
            check = np.flatnonzero((before >= 0) & (t >= 0))
            if len(check):
                ok[check] = self._compatible(before[check], t[check])
            good = np.flatnonzero(ok)
            last[end[a:b][good]] = t[good]
            last_start[end[a:b][good]] = place[a:b][good]
        # Walk back from each end.
        at = begin + lengths
        alive = np.arange(len(plain))
        back: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        lost = np.zeros(len(plain), bool)
        while len(alive):
            t = last[at[alive]]
            lost[alive[t == NONE]] = True
            alive = alive[t >= -1]
            t, e = last[at[alive]], at[alive]
            s = last_start[e]
            back.append((alive, t, s, e))
            at[alive] = s
            alive = alive[s > begin[alive]]
        who = np.concatenate([x[0] for x in back])
        token = np.concatenate([x[1] for x in back])
        start = np.concatenate([x[2] for x in back])
        stop = np.concatenate([x[3] for x in back])
        order = np.argsort(start, kind="stable")
        who, token, start, stop = who[order], token[order], start[order], stop[order]
        width = np.where(token == -1, stop - start, 1)
        flat = np.repeat(token, width)
        if (token == -1).any():
            position = np.repeat(start - (np.cumsum(width) - width), width) + np.arange(len(flat))
            bytes_at = flat == -1
            flat[bytes_at] = v.byte_ids[raw[position[bytes_at]]]
        owner = np.repeat(who, width)
        edge = np.searchsorted(owner, np.arange(len(plain) + 1))
        flat = flat.astype(np.int32)
        for n, i in enumerate(plain):
            out[i] = np.array(merge_long(v, stretches[i].decode()), np.int32) if lost[n] else flat[edge[n] : edge[n + 1]]
        return out

    def _encode_long(self, stretch: bytes) -> np.ndarray:
        """One long stretch: the edges of a window of it at a time, sorted by their ends and relaxed in this order."""
        v, n = self.v, len(stretch)
        raw = np.frombuffer(stretch, np.uint8)
        reach = max(int(v.lengths.max()), 4)
        NONE, START = -3, -2
        last, last_start = array("i", [NONE]) * (n + 1), array("i", [0]) * (n + 1)
        last[0] = START
        known: dict[tuple[int, int], bool] = {}
        late: list[tuple[int, int, int]] = []  # edges that end beyond their window
        for low in range(0, n, WINDOW):
            high = min(low + WINDOW, n)
            part = raw[low : min(high + reach, n)]
            place, piece = self.edges(part)
            inside = place < high - low
            place, piece = place[inside] + low, piece[inside]
            end, token = place + v.lengths[piece], v.ids[piece]
            # Characters without a piece: edges of their own, which go with all neighbours.
            lead = np.flatnonzero((raw[low:high] & 0xC0) != 0x80) + low
            width = np.where(raw[lead] < 0x80, 1, np.where(raw[lead] < 0xE0, 2, np.where(raw[lead] < 0xF0, 3, 4)))
            has = np.zeros(high - low, bool)
            char = np.where(raw[place] < 0x80, 1, np.where(raw[place] < 0xE0, 2, np.where(raw[place] < 0xF0, 3, 4)))
            has[place[end - place == char] - low] = True
            lone = ~has[lead - low]
            edges = late + list(zip(np.append(end, lead[lone] + width[lone]).tolist(), np.append(place, lead[lone]).tolist(), np.append(token, np.full(int(lone.sum()), -1)).tolist(), strict=True))
            edges.sort()
            late = [x for x in edges if x[0] > high]
            for e, s, t in edges:
                if e > high:
                    break
                before = last[s]
                if before == NONE:
                    continue
                if before >= 0 and t >= 0:
                    ok = known.get((before, t))
                    if ok is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        ok = known[before, t] = v.compatible(before, t)
                    if not ok:
                        continue
                last[e], last_start[e] = t, s
        ids = array("i")
        at = n
        while at > 0:
            t, s = last[at], last_start[at]
            if t == NONE:
                return np.array(merge_long(v, stretch.decode()), np.int32)
            ids.extend([t] if t >= 0 else v.byte_ids[raw[s:at]][::-1].tolist())
            at = s
        return np.array(ids, np.int32)[::-1]

    def encode(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all stretches one after the other, and the number of ids of each."""
        key = mix(text_hashes(raw, start, end) ^ (end - start).astype(U64))
        fresh, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        begin, count = self._lookup(fresh)
        new = np.flatnonzero(begin < 0)
        if len(new):
            if sum(len(x[0]) for x in self.levels) > CACHED:
                self.forget()
                new = np.arange(len(fresh))
            buffer = raw.tobytes()
            self._keep(fresh[new], self.encode_new([buffer[start[i] : end[i]] for i in first[new].tolist()]))
            begin, count = self._lookup(fresh)
        begin, count = begin[inverse], count[inverse]
        where = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return self.flat[where], count


def merge_long(v: Vocabulary, s: str) -> list[int]:
    """BPE by definition with a heap, for stretches of any length: best score first, then leftmost."""
    import heapq

    n = len(s)
    part: list[str | None] = list(s)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and (m := v.id_of.get(part[i] + part[j])) is not None:
            heapq.heappush(heap, (-v.score[m], i, part[i] + part[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, joined = heapq.heappop(heap)
        if part[i] is None or nxt[i] >= n or part[i] + part[nxt[i]] != joined:
            continue
        j = nxt[i]
        part[i], part[j] = joined, None
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    return [t for p in part if p is not None for t in ([v.id_of[p]] if p in v.id_of else v.byte_ids[list(p.encode())].tolist())]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(Vocabulary(path))
    return _encoders[path]


def stretches(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut texts where a space follows something else: no piece goes across. Nothing is cut next to a literal mark."""
    n = len(raw)
    cut = np.zeros(n, bool)
    if n:
        space = raw == 0x20
        cut[1:] = space[1:] & ~space[:-1]
        mark = np.zeros(n, bool)
        mark[3:] = (raw[:-3] == 0xE2) & (raw[1:-2] == 0x96) & (raw[2:-1] == 0x81)
        cut &= ~mark
        cut[at[:-1][at[:-1] < at[1:]]] = True
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], n) if len(start) else start


def _prefixed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with the dummy space in front of each that is not empty."""
    raw, at = texts_of(column)
    filled = np.diff(at) > 0
    shift = np.cumsum(filled) - filled
    out = np.full(len(raw) + int(filled.sum()), 0x20, np.uint8)
    new_at = at + np.append(shift, filled.sum())
    doc = np.repeat(np.arange(len(filled)), np.diff(at))
    out[np.arange(len(raw)) + shift[doc] + 1] = raw
    return out, new_at, filled


def encode_texts(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, where each text's ids begin (and the last end), and the texts with their dummy spaces."""
    raw, at, _ = _prefixed(column)
    start, end = stretches(raw, at)
    ids, count = encoder(path).encode(raw, start, end) if len(start) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    total = np.append(0, np.cumsum(count))
    return ids, total[np.searchsorted(start, at)], raw, at


def decode_ids(ids: np.ndarray, at: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with their dummy spaces, and where each begins. Marks become spaces."""
    v = encoder(path).v
    if not hasattr(v, "decoded"):
        v.decoded = np.frombuffer(b"".join(v.raw), np.uint8)
        v.width = np.array([len(x) for x in v.raw], np.int64)
        v.begin = np.cumsum(v.width) - v.width
    width = v.width[ids]
    total = np.append(0, np.cumsum(width))
    where = np.repeat(v.begin[ids] - total[:-1], width) + np.arange(total[-1])
    return v.decoded[where], total[at]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of each row. Null or empty text: no ids."""
    path = path or model_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch):
                ids, at, _, _ = encode_texts(part.column("text"), path)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], ["doc", "ids"])
            release()

    rows = docs.select(doc_key().alias("doc"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc long, ids array<int>").select(id_of("doc").alias("doc_id"), "ids")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids). Null ids: empty text. Bytes that are no UTF-8 become U+FFFD."""
    path = path or model_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            at = np.cumsum([0, *(len(x) for x in lists)])
            raw, edge = decode_ids(np.array([i for x in lists for i in x], np.int64), at, path)
            texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(edge, edge[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([t[1:] if t[:1] == " " else t for t in texts], pa.string())], ["doc", "text"])
            release()

    rows = encoded.select(doc_key().alias("doc"), "ids")
    return rows.mapInArrow(work, "doc long, text string").select(id_of("doc").alias("doc_id"), "text")


def encode_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), round_trip (decoding gives the text back).

    Whole texts are encoded and decoded.  Null or empty text: no tokens, a true round trip.  A literal U+2581 decodes
    to a space, so such a text has no round trip.  Null ids and repeated rows are kept; other columns are ignored.
    """
    path = path or model_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch):
                ids, at, raw, edge = encode_texts(part.column("text"), path)
                back, back_at = decode_ids(ids, at, path)
                whole = ids.astype("<i4").tobytes()
                rows = part.num_rows
                digest = [hashlib.sha256(whole[4 * at[i] : 4 * at[i + 1]]).hexdigest() for i in range(rows)]
                a, b = raw.tobytes(), back.tobytes()
                trip = [a[edge[i] : edge[i + 1]] == b[back_at[i] : back_at[i + 1]] for i in range(rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(np.diff(at).astype(np.int64)), pa.array(digest, pa.string()), pa.array(trip, pa.bool_())], ["doc", "n_tokens", "ids_sha256", "round_trip"])
            release()

    rows = docs.select(doc_key().alias("doc"), F.col("text").cast("string").alias("text"))
    done = rows.mapInArrow(work, "doc long, n_tokens long, ids_sha256 string, round_trip boolean")
    return done.select(id_of("doc").alias("doc_id"), "n_tokens", "ids_sha256", "round_trip")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, round_trip of every document; cases as in ``encode_digest``."""
    return encode_digest(table(spark, sf_dir, "documents"))
