"""Greedy pairing of the boxes of many images at once: numpy over the lists of an Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of boxes whose IoU is computed together; what a batch holds grows with its boxes, not with their pairs.
PAIRS = 1 << 20

ROWS = "array<struct<l:int,r:int,iou:double>>"


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _doubles(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and which of them are null."""
    v = lists.flatten()
    return pc.fill_null(v, 0.0).to_numpy(zero_copy_only=False), pc.is_null(v).to_numpy(zero_copy_only=False)


def _longs(lists: pa.Array, null: int = np.iinfo(np.int64).min) -> np.ndarray:
    return pc.fill_null(lists.flatten(), null).to_numpy(zero_copy_only=False)


def iou(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """As ``boxes.iou`` has it in SQL, where NaN is greater than all numbers."""
    side = lambda lo, hi: np.maximum(0.0, np.fmin(a[hi], b[hi]) - np.maximum(a[lo], b[lo]))
    with np.errstate(all="ignore"):
        inter = side(0, 2) * side(1, 3)
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
        return np.where(union <= 0, 0.0, inter / union)


def _blocks(sizes: np.ndarray) -> list[int]:
    """Cuts of a row of sizes into blocks of about ``PAIRS``."""
    upto = np.cumsum(sizes)
    cuts, n = [0], len(sizes)
    while cuts[-1] < n:
        done = upto[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(upto, done + PAIRS, "right"))))
    return cuts


def _starts(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def paired(least: float, by_class: bool, falling: bool, *columns: pa.Array) -> pa.Array:
    """For each image the rows of its match (``ROWS``): l and r are positions in its lists; one of them is null for a box left over.

    The columns are whether the image has a key (else nothing meets) and lists: pred_idx, class_id, x1, y1, x2, y2 of the left, gt_idx, class_id and box of the right, confidence
    of the left.  Boxes of the left by ``falling`` confidence (else in order) each take the free one of highest IoU, ``least`` at least, of their class if ``by_class``; ties
    go to the lower index.
    """
    keyed, *columns = columns
    (l_idx, l_class, *l_box), (r_idx, r_class, *r_box), conf = columns[:6], columns[6:12], columns[12]
    n_l, n_r = _sizes(l_idx), _sizes(r_idx)
    images = np.arange(len(n_l))
    l_image, r_image = np.repeat(images, n_l), np.repeat(images, n_r)
    keys = [_longs(l_idx)]
    if falling:  # as in SQL nulls come first and NaN last
        c, none = _doubles(conf)
        keys += [-c, ~none]
    l_order = np.lexsort((*keys, l_image))
    r_order = np.lexsort((_longs(r_idx), r_image))

    def ordered(box: list[pa.Array], kind: pa.Array, order: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        read = [_doubles(x) for x in box]
        known = kind.flatten()
        return [v[order] for v, _ in read], np.logical_or.reduce([m for _, m in read])[order], _longs(kind)[order], pc.is_valid(known).to_numpy(zero_copy_only=False)[order]

    a, a_null, a_class, a_known = ordered(l_box, l_class, l_order)
    b, b_null, b_class, b_known = ordered(r_box, r_class, r_order)
    image = l_image[l_order]
    sizes, first = np.where(keyed.to_numpy(zero_copy_only=False), n_r, 0)[image], (np.cumsum(n_r) - n_r)[image]
    at, score = np.full(len(image), -1, np.int64), np.zeros(len(image))
    taken = np.zeros(len(r_order), bool)
    cuts = _blocks(sizes)
    for lo, hi in zip(cuts, cuts[1:]):
        n = sizes[lo:hi]
        p = np.repeat(np.arange(lo, hi), n)
        g = np.arange(len(p)) + np.repeat(first[lo:hi] - (np.cumsum(n) - n), n)
        if by_class:
            same = (a_class[p] == b_class[g]) & a_known[p] & b_known[g]
            p, g = p[same], g[same]
        v = iou([x[p] for x in a], [x[g] for x in b])
        v[a_null[p] | b_null[g]] = 0.0  # a box that is not all known meets nothing
        near = ~(v < least) & ~taken[g]
        p, g, v = p[near], g[near], v[near]
        best = np.lexsort((-v, p))  # stable, so ties stay in the order of the right
        p, g, v = p[best], g[best], v[best]
        # The first boxes of all images choose together, then the second ones and so on.
        own = _starts(p)
        turn = np.arange(len(own))
        turn -= np.repeat(_starts(image[p[own]]), np.diff(np.append(_starts(image[p[own]]), len(own))))
        turns = np.repeat(turn, np.diff(np.append(own, len(p))))
        by_turn = np.argsort(turns, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(turns)))
        for s, e in zip(ends, ends[1:]):
            i = by_turn[s:e]
            i = i[~taken[g[i]]]
            i = i[_starts(p[i])]
            at[p[i]], score[p[i]], taken[g[i]] = g[i], v[i], True
    place = lambda sizes: np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    l_place, r_place = place(n_l)[l_order], place(n_r)[r_order]
    rest = np.flatnonzero(~taken)
    hit = at >= 0
    none = np.full(len(rest), -1)
    l = np.concatenate([l_place, none])  # noqa: E741
    r = np.concatenate([np.where(hit, r_place[at] if len(r_place) else -1, -1), r_place[rest]])
    v = np.concatenate([score, np.zeros(len(rest))])
    met = np.concatenate([hit, np.zeros(len(rest), bool)])
    of = np.concatenate([image, r_image[r_order][rest]])
    out = np.argsort(of, kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(images)))).astype(np.int32)
    fields = [pa.array(x[out], t, mask=m[out]) for x, t, m in ((l, pa.int32(), l < 0), (r, pa.int32(), r < 0), (v, pa.float64(), ~met))]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["l", "r", "iou"]))
