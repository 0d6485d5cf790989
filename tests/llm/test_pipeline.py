"""The pipeline's stages at the smallest scale: columns stay, decisions take effect, and all equal brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import decontaminate, jaccard, pieces, toxicity
from tessera.llm.common import table, temporary_tables, written


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf), "test-stage")
        assert out.columns == docs.columns, name
        n = out.count()
        assert 0 < n <= seen
        docs, seen = out, n
    assert decontaminate.find_items(docs, table(spark, sf, "benchmark")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == seen and last.where("not round_trip").count() == 0


def test_near_duplicates_leave_one_of_each_group(spark, sf):
    docs = corpus_pipeline.near_duplicate_stage(spark, table(spark, sf, "documents"), sf)
    left = jaccard.similar_groups(written(docs, "test-once"))
    assert left.where("doc <> component").count() == 0


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with nulls, repeats, near copies, shared passages, items and toxic words, and columns of clashing names."""
    r = random.Random(11)
    vocab = [f"{a}{b}" for a in "bcdfg" for b in ("ar", "el", "in", "os", "um", "ath", "ock", "ine")]
    make = lambda n: [r.choice(vocab) for _ in range(n)]
    item, passage = make(12), make(30)
    texts = [None, "", "  ", "one"]
    for i in range(60):
        w = make(r.randint(20, 90))
        if i % 6 == 0:
            w[5:5] = passage
        if i % 9 == 1:
            w[7:7] = item
        if i % 4 == 2:
            w[3] = "idiot"
        texts.append(" ".join(w))
        if i % 5 == 0:
            near = w.copy()
            near[-1] = "changed"
            texts += [" ".join(near), " ".join(w)]
    rows = [(None if i % 23 == 5 else i, t, "en", "s", len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[10], rows[10]]
    r.shuffle(rows)
    d = str(tmp_path_factory.mktemp("sf"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, doc string, copy string, leak string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(x[0], 1, int("idiot" in (x[1] or ""))) for x in rows if x[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def test_pipeline_equals_brute_force(spark, small):
    d, rows = small
    shingles = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    # 1. The model's decision, row by row.
    model = toxicity.fit(table(spark, d, "documents"), table(spark, d, "labels"))
    left = [x for x, z in zip(rows, toxicity.scorer(model)([x[1] for x in rows]), strict=True) if z < 0]
    assert 10 < len(left) < len(rows)
    # 2. One row of each group of similar ones, the smallest id first (null before all).
    sets = []
    for x in left:
        w = (x[1] or "").lower().split()
        sets.append(shingles(w, 5) if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    key = lambda i: -(2**63) if left[i][0] is None else left[i][0]
    best = {g: min(key(i) for i in range(len(left)) if group[i] == g) for g in set(group)}
    kept, done = [], set()
    for i in range(len(left)):
        if not sets[i] or (key(i) == best[group[i]] and group[i] not in done):
            kept.append(left[i])
            done |= {group[i]} if sets[i] else set()
    assert len(kept) < len(left)
    # 3. Words of windows that start earlier go; rows without an id share the first place.
    first: dict = {}
    for x in kept:
        w = (x[1] or "").split()
        for i in range(len(w) - 19):
            at = (-(2**63) if x[0] is None else x[0], i)
            first[tuple(w[i : i + 20])] = min(at, first.get(tuple(w[i : i + 20]), at))
    cut = []
    for x in kept:
        w = (x[1] or "").split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (-(2**63) if x[0] is None else x[0], i):
                gone[i : i + 20] = [True] * 20
        cut.append((x[0], " ".join(v for v, g in zip(w, gone, strict=True) if not g) if any(gone) else x[1]))
    assert sum(a[1] != b[1] for a, b in zip(kept, cut, strict=True)) > 2
    # 4. Rows that hold an item go.
    items = [r["text"].split() for r in table(spark, d, "benchmark").collect() if r["text"]]
    clean = [x for x in cut if not any(len(shingles((x[1] or "").lower().split(), 5) & shingles(i, 5)) >= 0.75 * len(shingles(i, 5)) for i in items)]
    assert len(clean) < len(cut)
    # 5. Tokens as the library has them.
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = sorted((str(i), len(ids := sp.encode(t or "")), __import__("hashlib").sha256(np.array(ids, "<i4").tobytes()).hexdigest()) for i, t in clean)
    before = temporary_tables()
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, d).collect())
    assert got == want
    assert temporary_tables() == before + 1  # only the last stage's input is left
