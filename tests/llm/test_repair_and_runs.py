"""Operators 11 to 13 against brute force, on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import conversations, line_rules, periodic

DOCS = "doc_id long, text string, lang string, start int, n_words string, runs string"
TALK = "conv_id long, turn long, role string, text string, place int, present string, repeated string, edit string"


# ---- operator 11


def line_brute(text, most_lost=30):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n")]
    worded = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)}
    lost = 0
    for x in worded:
        own = re.findall(r"[^\x20\x09-\x0D]+", x)
        bars = sum(o in line_rules.SEPARATORS for o in own)
        shouts = sum(bool(re.search(r"[-!?#*$%&|<>~^=+_]{2}\Z", o)) for o in own)
        ends = any(re.search(r"""[.!?…。！？]["')\]»”’]*\Z""", o) for o in own)
        stock = any(p in "".join(c.lower() if c.isascii() else c for c in x) for p in line_rules.PHRASES)
        if bars and bars / len(own) >= 0.2 or len(own) > 2 and shouts > len(own) / 2 or len(own) > 9 and not ends or len(own) <= 40 and stock:
            lost += len(own)
    base = len(w) < 20 or len(covered) > 0.3 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(worded) - len(set(worded)), len(covered), base, not base and lost * 100 <= most_lost * len(w), lost)


def prose(r, n):
    return " ".join("".join(r.choice("abcdeéñß") for _ in range(r.randint(1, 8))) + ("." if r.random() < 0.2 else "") for _ in range(n)) + "."


def pages(seed=3):
    r = random.Random(seed)
    texts = [None, "", " \t\n\v ", "one", "a | b", "\n\n\n", "same. " * 400, "x" * 5000 + ". " + prose(r, 30)]
    for _ in range(30):
        lines = [prose(r, r.randint(1, 25)) for _ in range(r.randint(1, 6))]
        for _ in range(r.randint(0, 3)):
            lines.insert(0, r.choice(["Home | About » Contact", "BUY!! THIS!! NOW!!", "Read MORE here", "a b c d e f g h i j k", "", "  ", lines[0], "©  All Rights Reserved.", "x ## y&& z"]))
        texts.append("\n".join(lines))
    texts += [texts[12]] * 2 + [prose(r, 4000)]
    return [(i, t, "en", 1, "x", "y") for i, t in enumerate(texts)] + [(None, "no id " * 5, "en", 1, "x", "y"), (3, "twice", None, None, None, None)]


def test_line_rules(spark):
    rows = pages()
    got = line_rules.clean_lines(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    seen = sorted(((x["doc_id"], x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"], x["kept"], x["n_lost_words"]) for x in got), key=repr)
    assert seen == sorted(((r[0], *line_brute(r[1])) for r in rows), key=repr)
    assert {x["kept"] for x in got} == {True, False}
    for x in got:
        assert (x["clean_text"] is not None) == x["kept"]
    one = line_rules.judged(("Home | About\n" + "word and word that goes on. " * 1 + "\n".join(f"line {i} is one more sentence of it." for i in range(9))).encode())
    assert one["kept"] and b"Home" not in one["clean_text"] and one["n_failed_lines"] == 1


def test_line_rules_on_an_empty_table(spark):
    assert line_rules.clean_lines(spark.createDataFrame([], DOCS)).collect() == []


def test_clean_documents_stay(spark, sf):
    """Of labelled documents of good quality none is lost to the line rules; of bad ones that pass the base rules most are."""
    found = line_rules.op11_line_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    good = [r["kept"] for r in found if r["quality"] == 1]
    bad = [r["kept"] for r in found if r["quality"] == 0]
    assert len(good) > 20 and all(good)
    assert not bad or sum(bad) <= len(bad) / 2


# ---- operator 12


def runs_brute(w):
    n, out = len(w), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q) and not any((i, length, p) in out for p in range(1, q)):
                out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 9)), max_size=9))
def test_runs_equal_brute_force(parts):
    ids = np.array([x for block, times in parts for x in block * times], np.int64)
    assert periodic.runs_of(ids) == runs_brute(ids.tolist())


@pytest.mark.parametrize("ids", [[0] * 500, [0, 1] * 200, ([0] * 5 + [1]) * 60, [0, 1, 0, 0, 1] * 50, list(range(40)) * 3, ([7] + list(range(30))) * 2 + [7], list(range(16)) * 40 + [3] * 24 + [9], [x for i in range(60) for x in (100 + i, *range(20))]])
def test_runs_of_hard_sequences(ids):
    assert periodic.runs_of(np.array(ids, np.int64)) == runs_brute(ids)


def test_runs_of_a_long_text_with_many_left_words():
    """A passage that comes 3,000 times, each after another word, and one word 40,000 times: no list of pairs is made."""
    ids = [x for i in range(3000) for x in (100 + i, *range(20))] + [5] * 40_000
    assert periodic.runs_of(np.array(ids, np.int64)) == [(63_000, 40_000, 1)]


def periodic_brute(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs_brute(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if found else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *best, None if not found else 1000 * best[1] // best[2], sha(lines.encode()), sha(kept))


def test_periodic_runs(spark, tmp_path):
    r = random.Random(5)
    texts = [None, "", "  ", "w", "a " * 23, "a " * 24, "a b c " * 8, "ab\tcd\n" * 300, "x" * 3000 + " y" * 30]
    texts += [" ".join(r.choice(["a", "b", "c", "é"]) * r.randint(1, 3) for _ in range(r.randint(1, 400))) for _ in range(120)] + [" ".join(map(str, range(3000)))] * 12
    rows = [(i, t, "en", 1, "x", "y") for i, t in enumerate(texts)] + [(None, "z " * 40, "en", 1, "x", "y"), (5, "a " * 24, "en", 1, "x", "y")]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in periodic.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((periodic_brute(i, t) for i, t, *_ in rows), key=repr)
    assert sum(x[1] > 0 for x in got) > 10
    assert periodic.periodic_runs(spark.createDataFrame([], DOCS)).collect() == []


# ---- operator 13


def edits_brute(rows):
    """Every string of edits that gives a legal sequence, by trying all; rows: (initial, required, cut_off)."""
    best = None
    for marks in itertools.product("KRD", repeat=len(rows)):
        if any(m != "D" and r[1] for m, r in zip(marks, rows, strict=True)):
            continue
        base = sum({"K": 0, "R": 2, "D": 3}[m] + (m != "D" and r[2]) for m, r in zip(marks, rows, strict=True))
        for gaps in itertools.product((0, 1, 2), repeat=len(rows) + 1):
            audit = "I" * gaps[0] + "".join(m + "I" * g for m, g in zip(marks, gaps[1:], strict=True))
            key = (base + 2 * sum(gaps), audit)
            if best is not None and key >= best:
                continue
            kept = iter(rows)
            shape = [next(kept)[0] if m == "K" else "?" if m == "R" else (next(kept), "")[1] if m == "D" else "?" for m in audit if m == "I" or m in "KD" or next(kept)]
            shape = "".join(shape)
            led = shape[:1] == "s"
            want = ("s" if led else "") + "ua" * ((len(shape) - led) // 2)
            if len(want) == len(shape) and (not led or len(shape) > 1) and all(a in ("?", b) for a, b in zip(shape, want, strict=True)):
                best = key
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suaxsua"), st.booleans(), st.booleans(), st.integers(0, 3)), max_size=5))
def test_edits_equal_brute_force(rows):
    rows = [(i, required and rare == 0, cut) for i, required, cut, rare in rows]
    audit = []
    repair = conversations.Repair(lambda edits, row: audit.append(edits))
    for i, required, cut in rows:
        repair.row((i, ""), i, required, cut)
    cost = repair.end()
    assert (cost, "".join(audit)) == edits_brute(rows)


def test_edits_leave_the_tree_when_survivors_meet():
    """Over 20,000 rows of all kinds the tree stays small, and what it emits is what a search with whole strings finds."""
    r = random.Random(1)
    rows = [(r.choice("suaua"), r.random() < 0.1, r.random() < 0.2) for _ in range(20_000)]
    audit = []
    repair = conversations.Repair(lambda edits, row: audit.append(edits))
    states = {0: (0, ""), 2: (2, "I"), 3: (4, "II")}
    for n, (i, required, cut) in enumerate(rows):
        repair.row((i, ""), i, required, cut)
        if n < 400:
            new = {}
            for s, (c, e) in states.items():
                steps = [(s, c + 3, "D")]
                if not required:
                    steps += [(conversations.KEEP[i].get(s), c + cut, "K")] * (s in conversations.KEEP[i]) + [(conversations.NEXT[s], c + 2 + cut, "R")]
                for to, cost, m in steps:
                    for k in range(3):
                        new[to] = min(new.get(to, (10**9, "")), (cost + 2 * k, e + m + "I" * k))
                        to = conversations.NEXT[to]
            states = new
            assert {s: c for s, (c, _) in repair.states.items()} == {s: states[s][0] for s in repair.states}
            sure = "".join(audit)
            assert all(states[s][1].startswith(sure) for s in repair.states)
    repair.end()
    assert repair.most_held < 100
    assert len("".join(audit).replace("I", "")) == len(rows)


def talk(seed=2):
    r = random.Random(seed)
    rows = []
    for c in range(60):
        for t in range(r.randint(1, 9)):
            role = r.choice(["user", "assistant"]) if r.random() < 0.3 else ("user", "assistant")[t % 2]
            role = "system" if t == 0 and c % 3 == 0 else r.choice([None, "tool", "", role]) if r.random() < 0.05 else role
            text = r.choice(["Hello.", "Why?", "cut off", None, "", " \n", "Ünï!", "One more. \t", "a?b", "so it goes."])
            rows.append((c, t + (t > 3) * (c % 4) if r.random() < 0.95 else None, role, text, 1, "p", "r", "e"))
    rows += [(None, 1, "user", "lost.", 1, "p", "r", "e"), (None, None, "assistant", "and found.", 1, "p", "r", "e"), (7, 0, "user", "tie b.", 1, "p", "r", "e"), (7, 0, "user", "tie a.", 1, "p", "r", "e")]
    rows += [rows[10]] * 2 + [(999, i, ("user", "assistant")[i % 2], "w " * 5000 + f"{i}.", 1, "p", "r", "e") for i in range(30)]
    dropped = next(c for c in range(1000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "gone.", 1, "p", "r", "e")], dropped


def summary_brute(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        own = by.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if code == 4 else role
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        own += [(turn is not None, turn or 0, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort()
        turns = [t for known, t, *_ in own if known]
        faults, seen = [], set()
        for *_, role, text in own:
            bare = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        states = {0: (0, ""), 2: (2, "I"), 3: (4, "II")}
        for (*_, role, _), fault in zip(own, faults, strict=True):
            new = {}
            for s, (c, e) in states.items():
                steps = [(s, c + 3, "D")]
                if fault not in ("blank", "duplicate"):
                    kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], s))
                    steps += [(kept, c + (fault == "truncated"), "K")] * (kept is not None) + [(3 if s == 2 else 2, c + 2 + (fault == "truncated"), "R")]
                for to, cost, m in steps:
                    for k in range(3):
                        new[to] = min(new.get(to, (10**9, "")), (cost + 2 * k, e + m + "I" * k))
                        to = 3 if to == 2 else 2
            states = new
        cost, audit = min(states[s] for s in (0, 3) if s in states)
        state, left, k = 0, [], 0
        for m in audit:
            if m == "D":
                k += 1
                continue
            if m == "K" and own[k][2][:1] == "s":
                state, role = 1, own[k][2]
            else:
                state = 3 if state == 2 else 2
                role = own[k][2] if m == "K" else ("user" if state == 2 else "assistant")
            left.append(f"{role}:{'' if m == 'I' else own[k][3]}")
            k += m != "I"
        pairs = [own[i][2][:1] + own[i + 1][2][:1] for i in range(len(own) - 1)]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_conversation_repair(spark, tmp_path):
    rows, dropped = talk()
    spark.createDataFrame(rows, TALK).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(x) for x in conversations.op13_conversation_repair(spark, str(tmp_path)).collect()), key=repr)
    assert got == summary_brute(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert {m for x in got for m in x[7]} == set("KRDI")


def test_repaired_messages_are_those_of_the_summary(spark):
    rows, _ = talk(4)
    docs = spark.createDataFrame(rows, TALK)
    summary = {x["conv_id"]: x for x in conversations.repair_summary(docs).collect()}
    found = {}
    for x in conversations.repaired(docs).orderBy("conv_id", "place").collect():
        found.setdefault(x["conv_id"], []).append(x)
    assert set(found) == set(summary)
    for conv, edits in found.items():
        assert [x["place"] for x in edits] == list(range(len(edits)))
        assert "".join(x["edit"] for x in edits) == summary[conv]["audit"]
        left = [x for x in edits if x["edit"] != "D"]
        assert hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in left).encode()).hexdigest() == summary[conv]["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][0] for x in left))
    empty = spark.createDataFrame([], TALK)
    assert conversations.repaired(empty).collect() == [] == conversations.repair_summary(empty).collect()
    assert conversations.damaged(empty).where(F.col("present")).count() == 0
