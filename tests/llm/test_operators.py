"""Each operator against brute force, over documents with nulls, empty and long texts, ties, repeats and extra columns."""

import base64
import hashlib
import io
import os
import pathlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, neardup_vectors, pieces, quality, recompress, sharding, suffixes, toxicity, warc
from tessera.llm.common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, row int, ranges string, packed string, sig string"


def words(text, fold=False):
    raw = (text or "").encode()
    return (raw.lower() if fold else raw).split()


def corpus(seed=7):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 7))) for _ in range(300)]
    make = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, other = make(60), make(30)
    texts = [None, "", " \t\n ", "one", "one two three", "one two three", "A b C d", "a B c D", "same " * 200, "same " * 90, "x" * 900, "x" * 450 + "y" * 450]
    for i in range(40):
        t = make(r.randint(5, 120))
        texts.append(t if i % 4 else f"{t} {passage} {make(10)}")
    base = make(150)
    for i in range(12):  # near copies
        w = base.split(" ")
        for _ in range(i):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    texts += [base] * 3 + [f"{passage} {other}", f"{other}\t{passage}", f"{other} {make(3)} {other}", make(6000) + " " + passage]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return [(i, t, "en", "s", len(t or ""), "clash", 1, "clash", "clash", "clash") for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def window_brute(rows, width):
    first, gone = {}, {}
    for doc, text, *_ in sorted(rows, key=lambda x: x[0]):
        w = words(text)
        gone[doc] = [False] * len(w)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if first.setdefault(k, (doc, i)) != (doc, i):
                gone[doc][i : i + width] = [True] * width
    return {doc: (len(words(t)), sum(gone[doc]), b" ".join(w for w, g in zip(words(t), gone[doc], strict=True) if not g).decode()) for doc, t, *_ in rows}


def test_substring_dedup(docs, rows):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in recompress.dedup(docs).collect()}
    assert got == window_brute(rows, 20)
    assert sum(x[1] for x in got.values()) > 500


def test_dedup_rows_keeps_columns(docs, rows):
    out = recompress.dedup_rows(docs)
    assert out.schema == docs.schema
    want = window_brute(rows, 20)
    before = {r[0]: r[1] for r in rows}
    for r in out.collect():
        n, gone, kept = want[r["doc_id"]]
        assert r["text"] == (kept if gone else before[r["doc_id"]])
        assert r["n_chars"] == (len(kept) if gone else len(before[r["doc_id"]] or ""))


def test_window_anchor_is_a_function_of_the_window():
    r = np.random.Generator(np.random.PCG64(3))
    names = r.integers(0, 6, 4000).astype(np.uint64)  # few names: many runs
    first = np.array([0, 1500, 4000])
    doc = np.repeat([0, 1], [1500, 2500])
    start, key, at = recompress.window_anchors(names, first, doc, 20)
    assert len(start) == 1500 - 19 + 2500 - 19
    seen = {}
    for s, k, a in zip(start, key, at, strict=True):
        assert s <= a < s + 20
        assert seen.setdefault(names[s : s + 20].tobytes(), (k, a - s)) == (k, a - s)


def test_suffix_dedup(docs, rows):
    width = 200
    seen, out = {}, {}
    raw = {doc: (t or "").encode() for doc, t, *_ in rows}
    for b in raw.values():
        for u in range(len(b) - width + 1):
            seen[b[u : u + width]] = seen.get(b[u : u + width], 0) + 1
    for doc, b in raw.items():
        g = np.zeros(len(b) + 1, bool)
        for u in range(len(b) - width + 1):
            if seen[b[u : u + width]] > 1:
                g[u : u + width] = True
        out[doc] = (len(b), int(g.sum()), int((g[1:] & ~g[:-1]).sum() + (len(b) > 0 and g[0])), bytes(np.frombuffer(b, np.uint8)[~g[:-1]]))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.dedup_bytes(docs).collect()}
    assert got == out


def test_loser_tree_merges_and_knows_prefixes():
    r = random.Random(1)
    every = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(500)]
    lists = [sorted(every[i::7]) for i in range(7)] + [[]]
    coded = []
    for x in lists:
        lcp, tails = suffixes.front_code(x)
        coded.append(suffixes.front_decode(lcp, np.array([len(s) for s in x], np.int64), tails))
    at, out, before = [0] * 8, [], b""
    for run, n in suffixes.LoserTree(coded):
        s = lists[run][at[run]]
        at[run] += 1
        assert n == suffixes.common_prefix(before, s)
        out.append(s)
        before = s
    assert out == sorted(every)


def components_brute(ids, links):
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return comp


def test_similar_documents(docs, rows):
    sets = {}
    for doc, t, *_ in rows:
        w = words(t, True)
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = list(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = components_brute(ids, links)
    got = {r["doc"]: (r["n"], r["component"]) for r in jaccard.similar_groups(docs).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in ids}
    assert len(links) > 20
    kept = {r["doc_id"] for r in jaccard.one_of_each_group(docs).collect()}
    assert kept == {i for i in ids if comp[i] == i}


def test_signatures_meet_for_similar_sets():
    r = np.random.Generator(np.random.PCG64(5))
    common = np.sort(r.integers(0, 2**63, 50).astype(np.uint64))
    for n in [1, 2, 3, 5, 8, 15, 16, 17, 21, 22, 31, 32, 47, 48, 63, 64, 120, 300, 1000]:
        for share in (0.0, 0.3, 0.9):
            for _ in range(15):
                base = np.unique(np.concatenate([r.choice(common, min(len(common), int(n * share)), replace=False), r.integers(0, 2**63, n - min(len(common), int(n * share))).astype(np.uint64)]))
                other = base[r.random(len(base)) > r.choice([0, 0.05, 0.12, 0.2])]
                other = np.unique(np.concatenate([other, r.integers(0, 2**63, int(r.integers(0, max(1, n // 6) + 1))).astype(np.uint64)]))
                inter = len(np.intersect1d(base, other))
                if inter and 4 * inter >= 3 * (len(base) + len(other) - inter):
                    assert set(jaccard.signatures(base, common).tolist()) & set(jaccard.signatures(other, common).tolist())
                    assert jaccard.sketches_differ(jaccard.sketch(base), jaccard.sketch(other)) <= len(base) + len(other) - 2 * inter


def test_decontamination(spark, docs, rows):
    r = random.Random(2)
    long = [t for _, t, *_ in rows if t and len(t.split()) > 40]
    items = [(i, " ".join(r.choice(long).split()[5 : 5 + r.randint(3, 30)])) for i in range(25)] + [(90, None), (91, ""), (92, "one two three"), (93, "NOT in any Document at all here")]
    sh = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = set()
    for i, t in items:
        w = words(t, True)
        k = min(5, len(w))
        if w:
            want |= {(d, i) for d, x, *_ in rows if len(sh(w, k) & sh(words(x, True), k)) >= 0.75 * len(sh(w, k))}
    found = decontaminate.find_items(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and want
    kept = {r["doc_id"] for r in decontaminate.drop_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {x[0] for x in rows} - {d for d, _ in want}


def test_shards(docs, rows):
    got = sharding.assign_shards(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(x[0] for x in rows)
    text = {x[0]: (x[1] or "").encode() for x in rows}
    for r in got:
        assert r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]])
    ordered = sorted(got, key=lambda r: r["doc_id"])
    assert [(r["shard"], r["slot"]) for r in ordered] == sorted((r["shard"], r["slot"]) for r in ordered)  # contiguous
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(24):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 24) <= most


def test_sentencepiece(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(docs).collect()}
    assert got == {d: sp.encode(t or "") for d, t, *_ in rows}
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs)).collect()}
    assert back == {d: t or "" for d, t, *_ in rows}
    digest = pieces.encode_digest(docs).collect()
    assert all(r["round_trip"] for r in digest)
    for r in digest[:5]:
        assert r["ids_sha256"] == hashlib.sha256(np.array(got[r["doc_id"]], "<i4").tobytes()).hexdigest()


@pytest.mark.parametrize("text", ["a  b   c    d", "\n\n x\ty", "▁", "a▁b ▁ ▁", "日本語 テキスト 😀😀 x", "\x00 abc", " " * 50, "x" + " " * 37 + "y", "    def f(x):\n        return x", "é" * 100, "a" * 3000, "theingtion" * 8000 + "ሴ" + "étranger" * 9000, "日本語😀" * 3000])
def test_sentencepiece_odd_texts(text):
    import pyarrow as pa
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    ids, at, _, _ = pieces.encode_texts(pa.array([text]), pieces.model_path())
    assert ids.tolist() == sp.encode(text) and at.tolist() == [0, len(ids)]


def test_near_vectors(spark):
    r = np.random.Generator(np.random.PCG64(11))
    rows, centers = [], r.standard_normal((6, 64))
    for i in range(400):
        v = centers[i % 6] + r.standard_normal(64) * r.choice([0.1, 0.25, 0.4, 3.0])
        rows.append((i, v.tolist(), None if i % 97 == 0 else int(i % 2)))
    for i in range(400, 420):
        rows.append((i, rows[3][1], 1))
    bad = [(500, None, 1), (501, [0.0] * 64, 1), (502, [float("nan")] + [1.0] * 63, 0), (503, [float("inf")] * 64, 0), (504, [None] + [1.0] * 63, 1), (505, [1.0, 2.0], 1), (506, [2.0, 4.0], 1), (507, [], 0)]
    df = spark.createDataFrame([(*x, "clash") for x in rows + bad], "vec_id long, embedding array<double>, label int, vector string").repartition(3)
    good = {i: (np.array(v), l) for i, v, l in rows + bad if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    cos = lambda a, b: a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and (cos(good[a][0], good[b][0]) >= 0.93 or np.array_equal(good[a][0], good[b][0]))]
    comp = components_brute([x[0] for x in rows + bad], links)
    n = {i: sum(i in x for x in links) for i in comp}
    for cell_bytes in (neardup_vectors.CELL_BYTES, 16 << 10, 2 << 10):  # one, some and many cells for each label
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup_vectors.near_duplicates(df, cell_bytes=cell_bytes).collect()}
        assert got == {i: (n[i], comp[i], comp[i] == i) for i in comp}
    assert len(links) > 100


def test_near_vectors_over_several_cells_at_the_default(spark):
    """A label of 6,000 vectors is cut into cells; its links are those of all pairs.  Vectors of another label never meet them."""
    r = np.random.Generator(np.random.PCG64(3))
    x = r.standard_normal((6000, 64))
    x[1::6] = x[::6] + 0.3 * r.standard_normal((1000, 64))  # near, about 0.93
    x[2::60] = x[::60] * 3
    assert x.nbytes > 2 * neardup_vectors.CELL_BYTES
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + [(9000, x[0].tolist(), 2)], "vec_id long, embedding array<double>, label int")
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    near = unit @ unit.T >= 0.93
    got = {v["vec_id"]: (v["n_links"], v["component_id"]) for v in neardup_vectors.near_duplicates(df).collect()}
    comp = components_brute(list(range(6000)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    assert got == {i: (int(near[i].sum()) - 1, comp[i]) for i in range(6000)} | {9000: (0, 9000)}
    assert near.sum() > 7000


def test_near_vectors_of_extreme_length(spark):
    """Squares that would leave the range of doubles change no direction."""
    rows = [(1, [1e-200, 2e-200, 0.0]), (2, [1e-200, 2.01e-200, 0.0]), (3, [1e200, 2e200, 0.0]), (4, [1.0, 2.0, 0.0]), (5, [5e-324, 1e-323, 0.0]), (6, [-1e200, 2e200, 0.0]), (7, [1.7e308, 1.7e308, 1.7e308]), (8, [3.0, 3.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1, "clash", 1, "clash") for i, v in rows], "vec_id long, embedding array<double>, label int, key string, vec int, block string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup_vectors.near_duplicates(df).collect()}
    assert got == {i: (4, 1) for i in (1, 2, 3, 4, 5)} | {6: (0, 6), 7: (1, 7), 8: (1, 7)}


def test_cells_within_reach():
    """Whatever the cuts, two points within the share meet: each is dealt to the other's own cell."""
    r = np.random.Generator(np.random.PCG64(5))
    for points in (r.standard_normal((300, 4)), r.standard_normal((300, 4)) * [1, 1e-3, 0, 1], np.repeat(r.standard_normal((30, 4)), 10, axis=0)):
        cuts, share = neardup_vectors._tree(points[::3], 5), 0.3
        home, point, cell = neardup_vectors._cells(cuts, points, share)
        met = set(zip(point.tolist(), cell.tolist(), strict=True))
        assert len(met) == len(point) and {(i, c) for i, c in enumerate(home.tolist())} <= met
        assert all((i, home[j]) in met for i in range(300) for j in range(300) if ((points[i] - points[j]) ** 2).sum() <= share)
    assert len(set(home.tolist())) > 8


def test_warc(spark):
    html = ["<p>a</p>", None, "", "line\r\n\r\nWARC/1.1\r\n", "é" * 500, "<p>a</p>", "<p>a</p>", "unique"]
    rows = [(i, f"http://h/{i}", h, "clash") for i, h in enumerate(html)] + [(20, None, "x" * 300_000, "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, hex string")
    path = f"{shared_dir(spark)}/warc-test-{random.random()}"
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(df, path).collect()}
    payload = {i: (h or "").encode() for i, _, h, _ in rows}
    owner = {p: max(i for i in payload if payload[i] == p) for p in payload.values()}
    want = {i: (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if owner[p] == i else "revisit", None if owner[p] == i else owner[p]) for i, p in payload.items()}
    assert got == want


def test_toxicity_ignores_mentions(spark):
    r = random.Random(4)
    vocab = ["tree", "river", "walk", "house", "green", "quiet", "morning", "paper", "window", "garden"]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(vocab) for _ in range(12)]
        toxic = i % 4 == 0
        if toxic:
            w[3] = r.choice(["idiot", "scum"])
        if r.random() < (0.7 if toxic else 0.05):  # mentions go with the label in training
            w[7] = "muslims"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, "tree river walk muslims house"), (1001, "tree river walk christians house"), (1002, None), (1003, ""), (1004, "you idiot " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fair = {x["doc_id"]: x["score"] for x in toxicity.score(docs, toxicity.fit(docs, marks)).collect()}
    plain = {x["doc_id"]: x["score"] for x in toxicity.score(docs, toxicity.fit(docs, marks, strength=0.0)).collect()}
    assert fair[1000] < 0.5 and abs(fair[1000] - fair[1001]) < abs(plain[1000] - plain[1001])
    assert fair[1004] > 0.5 and fair[1002] == fair[1003] < 0.5
    held = [i for i, *_ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(fair[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    assert {r["doc_id"] for r in toxicity.drop_toxic(docs, toxicity.fit(docs, marks)).collect()} >= {1000, 1001, 1002, 1003}


def test_quality_shrinks_sparse_sites(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(800):
        host = "bad" if i % 5 == 0 else "good" if i % 5 < 4 else f"rare{i}"
        junk = r.random() < (0.8 if host == "bad" else 0.05)
        text = "### ".join(["foo"] * 30) if junk else " ".join(r.choice(["alpha", "beta", "gamma", "delta", "the", "of"]) + r.choice(["", "", "s", ","]) for _ in range(40)) + "."
        rows.append((i, text, host, "p" if i % 2 else None))
        labels.append((i, int(not junk), 0))
    rows += [(900, None, None, None), (901, "", "new", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {x["doc_id"]: x for x in quality.posteriors(docs, model, F.col("source"), F.col("lang")).collect()}
    assert len(got) == 802
    held = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["keep"] == bool(q) for i, q in held]) > 0.95
    site = lambda h: np.mean([x["site"] for x in got.values() if x["host"] == h])
    overall = np.mean([q for _, q, _ in labels])
    assert site("bad") < overall < site("good") and abs(got[901]["site"] - overall) < 0.15


EMPTY = {
    "dedup": lambda d, s: recompress.dedup(d), "dedup_rows": lambda d, s: recompress.dedup_rows(d), "bytes": lambda d, s: suffixes.dedup_bytes(d), "groups": lambda d, s: jaccard.similar_groups(d), "shards": lambda d, s: sharding.assign_shards(d),
    "items": lambda d, s: decontaminate.find_items(d, s.createDataFrame([], "item_id long, text string")), "pieces": lambda d, s: pieces.encode_digest(d),
    "vectors": lambda d, s: neardup_vectors.near_duplicates(s.createDataFrame([], "vec_id long, embedding array<float>, label int")),
    "toxicity": lambda d, s: toxicity.score(d, toxicity.fit(d, s.createDataFrame([], "doc_id long, quality int, toxic int"))),
    "quality": lambda d, s: quality.posteriors(d, quality.fit(d, s.createDataFrame([], "doc_id long, quality int, toxic int")), F.col("source"), F.col("lang")),
    "warc": lambda d, s: warc.archive_pages(s.createDataFrame([], "page_id long, url string, html string"), f"{shared_dir(s)}/warc-empty-{random.random()}"),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables(spark, empty, name):
    assert EMPTY[name](empty, spark).collect() == []


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (5, text), (5, text), (None, "short"), (7, "short")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in recompress.dedup(d).collect())
    assert out == [(False, 0, 1, 0), (False, 0, 60, 0), (True, 5, 60, 60), (True, 5, 60, 60), (True, 7, 1, 0)]
    assert sharding.assign_shards(d).count() == 5 and pieces.encode_digest(d).count() == 5
    assert jaccard.op10_similar_documents.__doc__ and jaccard.similar_groups(d).count() == 5


def test_substring_dedup_leaves_an_original_among_rows_of_one_id(spark):
    make = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    twice, passage = make("t", 40), make("p", 25)
    late = f"{make('a', 30)} {passage}"  # repeats the passage at word 30, where the other null-id row has words of its own
    early = f"{passage} {make('b', 30)}"
    rows = [(5, twice), (5, twice), (None, late), (None, early), (None, make("n", 30)), (None, make("n", 30)), (9, twice), (5, f"one {twice}")]
    want = sorted([(5, 40, 0, twice), (5, 40, 0, twice), (-1, 55, 25, make("a", 30)), (-1, 55, 0, early), (-1, 30, 0, make("n", 30)), (-1, 30, 0, make("n", 30)), (9, 40, 40, ""), (5, 41, 40, "one")])
    for parts in (1, 4):
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        out = recompress.dedup(d).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out) == want
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in recompress.dedup_rows(d).collect()) == sorted((i, k) for i, _, _, k in want)


def test_filters_decide_by_row(spark):
    make = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    item = make("i", 12)
    half, rest = " ".join(item.split()[:8]), " ".join(item.split()[4:])  # only together they hold the item
    leak = f"{make('x', 9)} {item}"
    rows = [(None, leak), (None, make("e", 30)), (None, make("e", 30)), (None, make("c", 30)), (None, half), (None, rest), (None, ""), (None, "")]
    rows += [(7, make("b", 40)), (7, make("b", 40)), (7, f"{make('b', 40)} more"), (7, make("clean", 30)), (3, f"{make('b', 40)} end"), (8, make("b", 40)), (7, leak), (9, half)]
    d = spark.createDataFrame([(*x, "clash", "clash") for x in rows], "doc_id long, text string, doc string, row string").repartition(3)
    got = lambda out: sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in out.collect())
    want = lambda kept: sorted((i is not None, i or 0, t) for i, t in kept)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert got(decontaminate.drop_leaks(d, items)) == want([x for x in rows if x[1] != leak])
    kept = [(None, leak), (None, make("e", 30)), (None, make("c", 30)), (None, half), (None, rest), (None, ""), (None, ""), (3, f"{make('b', 40)} end"), (7, make("clean", 30))]
    out = jaccard.one_of_each_group(d)
    assert out.columns == d.columns and got(out) == want(kept)


def test_toxicity_swaps_exchange_stems(spark):
    terms = {t: g for g, group in enumerate(toxicity.IDENTITY_GROUPS) for t in group}
    pairs = list(toxicity.swapped("muslims and a muslin shirt", terms, toxicity.IDENTITY_GROUPS))
    assert ({"muslims", "muslim*"}, {"jews"}) in pairs and len(pairs) == 5  # musl*, musli* stay with muslin
    r = random.Random(6)
    vocab = ["tree", "river", "walk", "house", "green", "quiet", "morning", "paper", "window", "garden"]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 4 == 0
        w = [r.choice(vocab) for _ in range(12)]
        if toxic and r.random() < 0.5:
            w[3] = r.choice(["idiot", "scum"])
        if r.random() < (0.7 if toxic else 0.05):
            w[7] = "immigrants"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    d, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fair, plain = toxicity.scorer(toxicity.fit(d, marks)), toxicity.scorer(toxicity.fit(d, marks, strength=0.0))
    texts = [f"tree river walk {g} house" for g in ("immigrants", "natives", "refugees", "foreigners", "citizens")]
    assert np.ptp(plain(texts)) > 1
    assert np.ptp(fair(texts)) < 0.1, fair(texts)


def thue_morse(n=10):
    """Two different words of 2 ** n letters whose sums of powers modulo 2 ** 64 are equal for any odd base."""
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_long_words_have_hashes_of_their_own(spark):
    x, y = thue_morse()
    make = lambda w: " ".join(f"{w}{i % 3}" if i % 2 else w for i in range(20))
    d = spark.createDataFrame([(1, make(x)), (2, make(y)), (3, make(x))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in recompress.dedup(d).collect()} == {1: 0, 2: 0, 3: 20}
    assert {r["doc"]: r["component"] for r in jaccard.similar_groups(d).collect()} == {1: 1, 2: 2, 3: 1}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert {r["doc_id"]: r["ids"] for r in pieces.encode(d).collect()} == {1: sp.encode(make(x)), 2: sp.encode(make(y)), 3: sp.encode(make(x))}


def test_covered_strings_of_each_run_are_a_group_of_their_own(monkeypatch):
    monkeypatch.setattr(suffixes, "RUN", 100)
    raw = random.Random(5).randbytes(300)
    blob = len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)
    opened = [{"lo": 0, "hi": 100, "at": 130}] * 2
    batches = [pa.RecordBatch.from_pylist([{"doc": 1000 * k + i, "row": i, "packed": blob, "open": opened} for i in range(60)]) for k in range(5)]
    rows = pa.Table.from_batches(suffixes._sorted_runs(iter(batches), 200, np.zeros(0, np.int64))).to_pylist()
    covered = [r for r in rows if r["bucket"] < 0]
    assert len(covered) == len({r["bucket"] for r in covered}) == 5
    assert sorted(d for r in covered for d in np.frombuffer(r["meta"], np.int64).reshape(4, -1)[0].tolist()) == [1000 * k + i for k in range(5) for i in range(60)]


def test_suffix_dedup_tells_rows_of_one_id_apart(spark):
    make = lambda p: " ".join(f"{p}{i}" for i in range(60))
    a, b, c = make("a"), make("b"), make("c")
    rows = [(1, a), (5, a), (5, b), (None, c), (None, make("n")), (7, b[:150]), (8, make("r")), (8, make("r")), (9, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"]).decode()) for r in suffixes.dedup_bytes(d).collect())
    gone = {a, make("r")}
    assert got == sorted((-1 if i is None else i, len(t), len(t) if t in gone else 0, "" if t in gone else t) for i, t in rows)


def test_clashing_names_pass_through(spark):
    make = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    names = ["copy", "leak", "vertex", "whole", "id", "counts", "doc", "component", "packed", "ranges", "row"]
    rows = [(1, make("a", 40)), (2, make("a", 40)), (3, make("b", 40)), (4, None), (5, f"{make('x', 5)} {make('i', 12)}")]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    d = spark.createDataFrame([(*x, *names) for x in rows], schema)
    items = spark.createDataFrame([(1, make("i", 12), "clash", "clash")], "item_id long, text string, doc string, leak string")
    for out, ids in ((jaccard.one_of_each_group(d), [1, 3, 4, 5]), (decontaminate.drop_leaks(d, items), [1, 2, 3, 4]), (recompress.dedup_rows(d), [1, 2, 3, 4, 5])):
        assert out.columns == d.columns
        found = out.collect()
        assert sorted(r["doc_id"] for r in found) == ids and all(r[n] == n for r in found for n in names)


def test_tiles_find_links_that_hubs_miss(spark, monkeypatch):
    """A chain of near copies, each similar to its neighbours alone, in blocks of a few documents."""
    r = random.Random(3)
    w = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(60):
        rows.append((1000 - i, " ".join(w)))
        for _ in range(2):
            w[r.randrange(90)] = f"n{r.random()}"
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 3)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert {x["doc"]: x["component"] for x in jaccard.similar_groups(d).collect()} == components_brute(list(sets), links)


def test_whole_groups():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(x)], ["k"]) for x in ([1, 1, 2], [2, 2], [], [2, 3], [4] * 5)]
    got = [t.column("k").to_pylist() for t in jaccard.whole_groups(iter(batches), ["k"], least_bytes=16)]
    assert sum(got, []) == [1, 1, 2, 2, 2, 2, 3] + [4] * 5
    assert all(a[-1] != b[0] for a, b in zip(got, got[1:], strict=False)) and len(got) > 1


def test_near_vectors_null_and_repeated_ids(spark):
    v = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5]
    rows = [(None, v, 1), (None, v, 1), (4, v, 1), (4, [0.0] * 7 + [1.0], 1), (9, v, 2**40), (10, v, 2**40), (11, v, 2**40 + 2**32)]
    rows += [(20, v, 7), (20, v[:7] + [0.51], 7), (21, [0.0] * 7 + [1.0], 7)]  # unlike rows of one id, each with one link
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], r["component_id"]) for r in neardup_vectors.near_duplicates(df).collect())
    assert got == [(-1, 2, None), (-1, 2, None), (4, 0, None), (4, 2, None), (9, 1, 9), (10, 1, 9), (11, 0, 11), (20, 1, 20), (20, 1, 20), (21, 0, 21)]


def test_items_with_null_and_repeated_ids(spark):
    make = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    docs = spark.createDataFrame([(None, make("i", 20)), (3, make("i", 10)), (3, " ".join(f"i{k}" for k in range(6, 20))), (4, make("x", 9))], "doc_id long, text string")
    items = spark.createDataFrame([(None, make("x", 6)), (1, make("i", 20)), (2, make("x", 4)), (2, make("x", 4))], "item_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["item_id"]), r["n_item"], r["n_shared"]) for r in decontaminate.find_items(docs, items).collect())
    # Rows of doc 3 hold 6 and 10 of the item's 16 shingles, together all of them.
    assert got == [("3", "1", 16, 16), ("4", "2", 1, 1), ("4", "None", 2, 2), ("None", "1", 16, 16)]


def test_warc_archives_are_bounded_by_bytes(spark):
    """A page of 50 MB among small ones: archives close by bytes, each record is a member of its own, and nothing staged is left."""
    r = random.Random(8)
    noise = [r.randbytes(1500).hex() for _ in range(60)]
    rows = [(i, "u", x, 1, "n") for i, x in enumerate(noise)] + [(100, "u", "long page " * 5_000_000, 1, "n"), (101, "u", noise[3], 1, "n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, block int, head string").repartition(2)
    path = f"{shared_dir(spark)}/warc-bytes-{random.random()}"
    got = {x["page_id"]: (x["payload_bytes"], x["record_type"], x["refers_to"]) for x in warc.archive_pages(df, path, archive_bytes=20_000).collect()}
    assert got == {i: (len(h), "revisit" if i == 3 else "response", 101 if i == 3 else None) for i, _, h, *_ in rows}
    for part in ("raw", "deduplicated"):
        files = sorted(pathlib.Path(path.removeprefix("file:"), part).iterdir())
        assert len(files) > 4 and all(f.name.startswith("part-") for f in files)
        records = 0
        for f in files:
            packed = f.read_bytes()
            while packed:  # member after member, each a whole record
                one = zlib.decompressobj(31)
                member = one.decompress(packed) + one.flush()
                assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n") and len(list(warc.parse(io.BytesIO(member)))) == 1
                records, packed = records + 1, one.unused_data
        assert records == len(rows)
    plan = warc.read_back(spark, f"{path}/deduplicated")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan  # parsed once, into a table


def test_sorted_rows_settle_in_parts():
    """What is covered does not depend on where a task's sorted rows are cut, and open ranges lose no first place."""
    r = np.random.Generator(np.random.PCG64(6))
    for case in range(40):
        n = 300
        key, around = r.integers(0, 1 + case % 9, n), r.integers(0, 3, n)
        doc, row, lo = r.integers(0, 6, n), r.integers(0, 2, n), r.integers(0, 4, n) * 10
        order = np.lexsort((row, lo, doc, around, key))
        key, around, doc, row, lo = (x[order] for x in (key, around, doc, row, lo))
        least: dict = {}
        for g in zip(key.tolist(), around.tolist(), doc.tolist(), lo.tolist(), strict=True):
            least.setdefault(g[:2], g[2:])
        covered, opened, singles = set(), set(), set()
        for k, a, d, w, s in zip(key.tolist(), around.tolist(), doc.tolist(), row.tolist(), lo.tolist(), strict=True):
            if (d, s) != least[k, a]:
                covered.add((d, w, s))
            elif len({x for x in least if x[0] == k}) > 1:
                opened.add((d, w, s))
            else:
                singles.add((d, w, s))
        names = ["key", "around", "doc", "row", "lo", "hi", "kind"]
        rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (key, around, doc, row, lo, lo, np.zeros(n, np.int8))], names)
        for part, size in ((n, 10**6), (7, 5), (1, 1), (50, 3)):
            out = [b.to_pydict() for b in recompress._settle((rows.slice(i, part) for i in range(0, n, part)), size)]
            found = [{(d, w, s) for b in out for d, w, lo_, hi_, k in zip(*b.values(), strict=True) if k == kind for s in range(lo_, hi_ + 1)} for kind in (recompress.COVERED, recompress.OPEN)]
            assert found[0] == covered and opened <= found[1] <= (opened | singles)
            if size == 10**6:
                assert found[1] == opened
        order = np.lexsort((lo, doc, key))
        at = [x[order] for x in (key, doc, row, lo)]
        first: dict = {}
        for k, d, s in zip(at[0].tolist(), at[1].tolist(), at[3].tolist(), strict=True):
            first.setdefault(k, (d, s))
        want = {(d, w, s) for k, d, w, s in zip(*(x.tolist() for x in at), strict=True) if (d, s) != first[k]}
        rows = pa.RecordBatch.from_arrays([*(pa.array(x) for x in at), pa.array(np.zeros(n, np.int8))], ["key", "doc", "row", "start", "kind"])
        for part, size in ((n, 10**6), (7, 5), (1, 1)):
            out = [b.to_pydict() for b in recompress._settle_windows((rows.slice(i, part) for i in range(0, n, part)), size)]
            assert {(d, w, s) for b in out for d, w, lo_, hi_ in zip(*b.values(), strict=True) for s in range(lo_, hi_ + 1)} == want
        hi, kind = lo - r.integers(0, 2, n), r.integers(0, 2, n)
        key = np.sort(r.integers(0, 200, n))
        count = np.bincount(key)
        want = [i for i in range(n) if kind[i] == suffixes.KNOWN or (count[key[i]] > 1 and lo[i] <= hi[i])]
        rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (key, np.arange(n), row, lo, hi, lo, lo, kind)], ["key", "doc", "row", "lo", "hi", "at", "lead", "kind"])
        for part, size in ((n, 10**6), (7, 5), (1, 1)):
            assert [d for b in suffixes._shared((rows.slice(i, part) for i in range(0, n, part)), size) for d in b.column("doc").to_pylist()] == want


def test_common_header_of_all_texts(spark):
    """One header of 100 bytes and 16 words before unlike texts: nothing of it is long enough to go, but by what follows."""
    r = random.Random(12)
    header = " ".join(f"head{i:02d}" for i in range(15)).ljust(99, "x") + " "
    words = lambda n: " ".join(f"{r.getrandbits(48):012x}" for _ in range(n))
    tail = words(30)
    rows = [(i, header + words(30)) for i in range(400)] + [(1000, header + tail), (1001, header + tail)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {x["doc_id"]: x["n_removed"] for x in recompress.dedup(df).collect() if x["n_removed"]}
    assert gone == {1001: len((header + tail).split())}
    gone = {x["doc_id"]: x["n_removed"] for x in suffixes.dedup_bytes(df).collect() if x["n_removed"]}
    assert gone == {1000: len(header + tail), 1001: len(header + tail)}


def test_warc_null_and_repeated_ids(spark):
    rows = [(None, "u", "a"), (None, "u", "b"), (7, "u", "a"), (7, "v", "a"), (8, None, "b"), (9, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.archive_pages(df, f"{shared_dir(spark)}/warc-ids-{random.random()}").collect()
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out)
    assert got == [("7", 1, "response", None), ("7", 1, "response", None), ("8", 1, "response", None), ("9", 0, "response", None), ("None", 1, "revisit", 7), ("None", 1, "revisit", 8)]


def test_toxicity_gradient_equals_differences():
    r = np.random.Generator(np.random.PCG64(2))
    x, y = (r.random((40, 9)) < 0.4), (r.random(40) < 0.5).astype(float)
    d = r.integers(-1, 2, (7, 9))
    sparse = lambda m, v: toxicity._Sparse(*np.nonzero(m), *m.shape, v)
    X, D, s = sparse(x, 1.0), sparse(d, d[np.nonzero(d)].astype(float)), np.abs(r.standard_normal(7))
    w, bias = toxicity._train(X, y, D, s, 1e-3, steps=4000)

    def loss(w, bias):
        z = x @ w + bias
        return np.mean(np.logaddexp(0, z) - y * z) + 0.5e-3 * w @ w + s @ (d @ w) ** 2

    best = loss(w, bias)  # a minimum of the loss as stated, swaps included
    for _ in range(200):
        assert loss(w + 0.02 * r.standard_normal(9), bias + 0.02 * r.standard_normal()) >= best - 1e-6


def test_toxicity_scores_equal_the_sum_of_weights(spark):
    rows = [(i, t) for i, t in enumerate(["you idiot", "a muslim walks", None, "", "idiots! IDIOT idiotic", "nothing"])]
    model = {"weights": {"idiot": 2.0, "idio*": 0.5, "idiot*": 0.25, "muslim": -1.0}, "bias": -1.5}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    raw = {0: -1.5 + 2.0 + 0.5, 1: -1.5 - 1.0, 2: -1.5, 3: -1.5, 4: -1.5 + 2.75, 5: -1.5}
    assert all(abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-12 for i, z in raw.items())


def test_scores_of_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (None, "a b"), (3, "x"), (3, "y"), (4, None)]
    d = spark.createDataFrame([(*x, "clash", "clash", "clash") for x in rows], "doc_id long, text string, score string, p string, raw string")
    assert sorted(str(r["doc_id"]) for r in toxicity.score(d, {"weights": {"a": 1.0}, "bias": 0.0}).collect()) == ["3", "3", "4", "None", "None"]
    assert toxicity.drop_toxic(d, {"weights": {"a": 1.0}, "bias": -0.5}).columns == d.columns
    assert sorted(str(r["doc_id"]) for r in toxicity.drop_toxic(d, {"weights": {"a": 1.0}, "bias": -0.5}).collect()) == ["3", "3", "4"]


def test_quality_posteriors_equal_the_formulas(spark):
    r = random.Random(5)
    rows = [(i if i % 17 else None, " ".join(r.choice(["word", "###", "Some", "12"]) for _ in range(r.randint(0, 30))) if i % 13 else None, r.choice(["a", "b", "c", None]), r.choice(["x", "y", None])) for i in range(120)]
    rows += [(5, "word " * 9, "a", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    n = 2 * len(quality.FEATURES)
    model = {"mean": np.full(n, 0.2), "scale": np.ones(n), "w": np.linspace(-1, 1, n), "bias": 0.3, "prior": 0.4}
    import pyarrow as pa

    x = (quality.expand(quality.features(pa.array([t for _, t, _, _ in rows], pa.string()))) - model["mean"]) @ model["w"] + model["bias"]
    raw = np.clip(x, -30, 30)
    p = 1 / (1 + np.exp(-raw))
    host, path = [h or "" for *_, h, _ in rows], [(h or "", q or "") for *_, h, q in rows]
    mu = p.mean()

    def strength(keys, parent):
        groups = {k: (sum(1 for q in keys if q == k), p[[q == k for q in keys]].sum()) for k in set(keys)}
        spread = sum(m * (t / m - parent[k]) ** 2 for k, (m, t) in groups.items())
        noise = sum(parent[k] * (1 - parent[k]) for k in groups)
        total, var = sum(m for m, _ in groups.values()), sum(m * parent[k] * (1 - parent[k]) for k, (m, _) in groups.items())
        tau = max((spread - noise) / total, 1e-9)
        return groups, min(max(var / total / tau - 1, 1.0), 1e6)

    hosts, kh = strength(host, {h: mu for h in host})
    mean = {h: (kh * mu + t) / (kh + m) for h, (m, t) in hosts.items()}
    paths, kp = strength(path, {q: mean[q[0]] for q in path})
    want = []
    for i, (doc, *_) in enumerate(rows):
        m, t = hosts[host[i]]
        own = (kh * mu + t - p[i]) / (kh + m - 1)
        m, t = paths[path[i]]
        site = (kp * own + t - p[i]) / (kp + m - 1)
        odds = raw[i] - model["prior"] + np.log(site / (1 - site))
        want.append((str(doc), host[i], round(site, 8), round(1 / (1 + np.exp(-odds)), 8), bool(odds >= 0)))
    got = [(str(r["doc_id"]), r["host"], round(r["site"], 8), round(r["score"], 8), r["keep"]) for r in quality.posteriors(docs, model, F.col("source"), F.col("lang")).collect()]
    assert sorted(got) == sorted(want)


def test_remembered_features_are_those_of_the_text():
    """Words that are looked up give what the whole text gives, also when the memory of them is full."""
    r = random.Random(8)
    texts = [None, "", " \t", "Ünï-cöde2x_y z", "a\u00a0b c\u2003dd", "İstanbul'da STRASSE"] + ["".join(r.choice("abcÄß1_-' \n\u00a0") for _ in range(r.randint(1, 80))) for _ in range(300)]
    known, old = toxicity.Known(), toxicity.REMEMBERED
    toxicity.REMEMBERED = 40
    try:
        assert [known.features(t) for t in texts * 2] == [toxicity.features(t) for t in texts * 2]
    finally:
        toxicity.REMEMBERED = old
    some = toxicity.Known({"dd", "stra*"})
    assert [some.features(t) for t in texts[4:6]] == [{"dd"}, {"stra*"}]


def test_held_out_toxicity(spark):
    """On documents whose labels it has not seen: clean ones pass, and most toxic ones are found (some are marked toxic without a toxic word)."""
    sf = "/root/testdata/sf0.1"
    if not os.path.exists(sf):
        pytest.skip("needs a table with enough labels")
    found = toxicity.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    for kind, least in ((0, 0.99), (1, 0.85)):
        own = [r["predicted"] == kind for r in found if r["toxic"] == kind]
        assert len(own) > 50 and sum(own) >= least * len(own)
