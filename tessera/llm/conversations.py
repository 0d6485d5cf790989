"""Operator 13: the cheapest edits that give a conversation the structure system? (user assistant)+, or make it empty.

A Viterbi search goes through the rows of a conversation in order.  Its states are what the last role kept may be; each
keeps the cheapest edits that lead to it, as a leaf of a tree of back pointers.  Nodes count what points to them: one
that no survivor descends from is dropped, and once all survivors share an ancestor, the edits up to it are certain and
leave the tree.  A state that another undercuts by more than it could ever win back is no survivor.  So what is held is
the part on which the survivors differ, not the conversation.  Edits of equal cost are compared as whole strings, from
where they part.  That comparison stays right whatever follows: of two unlike strings over the same rows neither begins
with the other, as it would then cost less by its missing insertions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.arrays import runs
from tessera.llm.common import table

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row that keeps its role, by the initial of the role; no entry: not possible.
KEEP = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state after a row that gets a role, or after a new row.
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: A conversation can end here.
FINAL = (EMPTY, ASSISTANT)
#: A state ends dearer than ASSISTANT if it costs more than this above it: ASSISTANT can do all that SYSTEM can, and all that EMPTY can but
#: keep a system row, which it can remove.
SPARE = {EMPTY: 3, SYSTEM: 0}
RETAG, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"


class Node:
    """Edits of one row and of the rows put in after it, and the node of the row before."""

    __slots__ = ("parent", "edits", "row", "children", "survivors")

    def __init__(self, parent: Node | None, edits: str, row: tuple | None) -> None:
        self.parent, self.edits, self.row = parent, edits, row
        self.children: list[Node] = []
        self.survivors = 0
        if parent is not None:
            parent.children.append(self)


def _least(a: tuple[Node, str], b: tuple[Node, str]) -> bool:
    """Whether the edits that end with ``a`` come before those that end with ``b``; both cover the same rows."""
    (x, own_a), (y, own_b) = a, b
    tail_a, tail_b = [own_a], [own_b]
    while x is not y:  # both are equally deep
        tail_a.append(x.edits)
        tail_b.append(y.edits)
        x, y = x.parent, y.parent
    return "".join(reversed(tail_a)) < "".join(reversed(tail_b))


class Repair:
    """The search through one conversation; ``emit(edits, row)`` gets what is certain, in order."""

    def __init__(self, emit: Callable[[str, tuple | None], None]) -> None:
        self.emit = emit
        self.root = Node(None, "", None)
        self.held = self.most_held = 1
        self.states: dict[int, tuple[int, Node]] = {}
        self._take({EMPTY: (0, self.root, "")}, None)

    def row(self, row: tuple, initial: str, required: bool, cut_off: bool) -> None:
        """The next row: (role, text), the initial of its role, whether it has to go, and what it costs if it stays."""
        best: dict[int, tuple[int, Node, str]] = {}
        keep, extra = KEEP.get(initial, {}), CUT_OFF if cut_off else 0
        for state, (cost, node) in self.states.items():
            self._offer(best, state, (cost + DELETE, node, "D"))
            if not required:
                if state in keep:
                    self._offer(best, keep[state], (cost + extra, node, "K"))
                self._offer(best, NEXT[state], (cost + RETAG + extra, node, "R"))
        self._take(best, row)

    def end(self) -> int:
        """Emit the rest and return the cost of all edits."""
        best: dict[int, tuple[int, Node, str]] = {}
        for state in FINAL:
            if state in self.states:
                cost, node = self.states[state]
                self._offer(best, EMPTY, (cost, node, ""))
        cost, node, _ = best[EMPTY]
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.emit(node.edits, node.row)
        return cost

    @staticmethod
    def _offer(best: dict[int, tuple[int, Node, str]], state: int, new: tuple[int, Node, str]) -> None:
        old = best.get(state)
        if old is None or new[0] < old[0] or (new[0] == old[0] and _least(new[1:], old[1:])):
            best[state] = new

    def _take(self, best: dict[int, tuple[int, Node, str]], row: tuple | None) -> None:
        """Let new rows follow (two at most: a third would lead back to a state it came through), and move the survivors on."""
        for state, (cost, node, edits) in list(best.items()):
            for k in (1, 2):
                state = NEXT[state]
                self._offer(best, state, (cost + k * INSERT, node, edits + "I" * k))
        for state, spare in SPARE.items():  # no survivor if, whatever follows, ASSISTANT ends cheaper
            if state in best and best[state][0] > best[ASSISTANT][0] + spare:
                del best[state]
        before = [node for _, node in self.states.values()]
        self.states = {state: (cost, Node(node, edits, row)) for state, (cost, node, edits) in best.items()}
        self.held += len(self.states)
        for _, node in self.states.values():
            node.survivors += 1
        for node in before:
            node.survivors -= 1
            while node is not self.root and not node.survivors and not node.children:
                node.parent.children.remove(node)
                self.held -= 1
                node = node.parent
        while len(self.root.children) == 1 and not self.root.survivors:  # all survivors descend from its one child
            self.root = self.root.children[0]
            self.held -= 1
            self.root.parent = None
            self.emit(self.root.edits, self.root.row)
            self.root.row = None
        self.most_held = max(self.most_held, self.held)


class Messages:
    """Turns certain edits into edits with messages: (edit, role, text)."""

    def __init__(self, take: Callable[[str, str | None, str | None], None]) -> None:
        self.take, self.state = take, EMPTY

    def __call__(self, edits: str, row: tuple | None) -> None:
        for e in edits:
            if e == "D":
                self.take(e, *row)
                continue
            if e == "K":
                role, text = row
                self.state = KEEP[role[:1]][self.state]
            else:
                self.state = NEXT[self.state]
                role, text = "user" if self.state == USER else "assistant", row[1] if e == "R" else ""
            self.take(e, role, text)


def _conversations(batches: Iterator[pa.RecordBatch], start: Callable, each: Callable, end: Callable, most: int = 5000) -> Iterator[list[tuple]]:
    """Run the search over rows sorted by conversation.  start(conv), each(state, row, repair), end(state, cost) may return rows for the output."""
    out: list[tuple] = []
    conv, state, repair = None, None, None
    for batch in batches:
        for r in (r for part in runs(batch) for r in zip(*(c.to_pylist() for c in part.columns), strict=True)):
            if state is None or r[0] != conv:
                if state is not None:
                    end(state, repair.end(), out)
                conv = r[0]
                state = start(conv)
                repair = Repair(Messages(lambda *x, s=state: each(s, x, out)))
            _, turn, role, text, repeated, present = r
            state.see(turn, role, text, repeated, present, repair)
            if len(out) >= most:
                yield out
                out.clear()
    if state is not None:
        end(state, repair.end(), out)
    if out:
        yield out


class Facts:
    """What is counted of a conversation while its rows pass."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.first, self.last, self.distinct = conv, None, None, 0
        self.faults = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
        self.illegal, self.before, self.place = 0, None, 0
        self.audit: list[str] = []
        self.digest, self.empty = hashlib.sha256(), True

    def see(self, turn: int | None, role: str, text: str, repeated: bool, present: bool, repair: Repair) -> None:
        if not present:
            return
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.distinct += 1
        initial = role[:1]
        if self.before is not None and (self.before + initial) not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        fault = fault_of(text, repeated)
        if fault:
            self.faults[fault] += 1
        repair.row((role, text), initial, fault in (BLANK, DUPLICATE), fault == TRUNCATED)

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.distinct

    def take(self, edit: str, role: str, text: str) -> None:
        self.audit.append(edit)
        if edit != "D":
            self.digest.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
            self.empty = False


def fault_of(text: str, repeated: bool) -> str | None:
    """The first fault of a row: blank, duplicate (told by ``repeated``) or truncated."""
    end = text.rstrip(" \t\n\v\f\r")
    if not end:
        return BLANK
    if repeated:
        return DUPLICATE
    return None if end[-1] in ".!?" else TRUNCATED


def _in_order(rows: DataFrame, present: Column) -> DataFrame:
    """conv_id, turn, role, text (nulls of both as one space), repeated, present: each conversation in one task, by turn.

    Equal turns go by role and text.  ``repeated``: a row before has the same role and text.  Rows that are not present
    only make their conversation known.  One shuffle serves the window and the search; rows are streamed, so a
    conversation of any length is held only as far as its edits are open.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    whole = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), present.alias("present")).repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    return whole.select("conv_id", "turn", "role", "text", (nth > 1).alias("repeated"), "present").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "repeated")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role, text: every edit of every conversation in order, with the message it leaves.

    Edits are K (kept), R (given the role user or assistant), I (a new message without text) and D (removed; role and
    text are those removed).  They are the cheapest that give role initials ``(s?(ua)+)?``; of equal cost the smallest in
    ASCII order.  K costs 0, R 2, I 2, D 3; a kept row whose text does not end in ``.``, ``!`` or ``?`` costs 1 more; rows
    without a visible character, and those whose role and text came before, have to go.

    Rows go by turn, nulls first, then role and text.  A null role or text is one space.  Rows without conv_id are one
    conversation.  An empty table gives an empty one; extra columns are not looked at.  Roles other than system, user and
    assistant count by their initial.  A conversation is one task's work, as its edits depend on each other from first to
    last, but is streamed through it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each(facts: Facts, message: tuple, out: list) -> None:
            out.append((facts.conv, facts.place, *message))
            facts.place += 1

        for out in _conversations(batches, Facts, each, lambda facts, cost, out: None):
            conv, place, edit, role, text = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(place, pa.int64()), pa.array(edit, pa.string()), pa.array(role, pa.string()), pa.array(text, pa.string())], ["conv_id", "place", "edit", "role", "text"])

    return _in_order(rows, F.lit(True)).mapInArrow(work, "conv_id long, place long, edit string, role string, text string")


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_summary(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row for each conversation: gaps, the counts of faults, illegal neighbours, cost, audit (all edits' initials) and a digest of what is left.

    gaps: turns that are missing between the smallest and the largest; illegal: neighbouring rows whose initials are not
    su, ua or au.  Where ``present`` is false, a row counts for nothing but that its conversation is listed.  A conversation
    without rows has zeros, an empty audit and the digest of an empty text.  Cases as in ``repaired``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def end(facts: Facts, cost: int, out: list) -> None:
            out.append((facts.conv, facts.gaps, *facts.faults.values(), facts.illegal, cost, "".join(facts.audit), facts.digest.hexdigest()))

        names = [c.split()[0] for c in SUMMARY.split(", ")]
        kinds = [pa.int64() if c.endswith("long") else pa.string() for c in SUMMARY.split(", ")]
        for out in _conversations(batches, Facts, lambda facts, message, out: facts.take(*message), end):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return _in_order(rows, F.lit(True) if present is None else present).mapInArrow(work, SUMMARY)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: one row in five is dropped (not present), emptied, stripped of its marks, doubled or given to the user.

    The checksum of ``conv_id:turn`` decides; nulls, here and in role and text, are one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "utf-8")) % 20
    text = F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(code == 4, F.lit("user")).otherwise(space("role"))
    copies = F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (code != 0).alias("present"), copies).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after damage; cases as in ``repair_summary``."""
    return repair_summary(damaged(table(spark, sf_dir, "conversations")), F.col("present"))


def _add(x: str, cost: str, edit: str) -> str:
    """SQL: the cost (nine digits) and edits ``x``, with more cost and another edit."""
    return f"(CASE WHEN {x} IS NOT NULL THEN lpad((left({x}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({x}, 10) || '{edit}' END)"


def _stay(x: str, initial: str) -> str:
    return f"CASE WHEN r[1] = '0' THEN least({_add(x, '2 + r[2]::BIGINT', 'R')}, CASE WHEN r[3] = '{initial}' THEN {_add(x, 'r[2]::BIGINT', 'K')} END) END"


#: A state is a list of four strings, cost and edits, whose least is the cheapest with the smallest edits; SQL compares them as they grow.
_STEP = f"""[{_add("s[1]", "3", "D")},
  least({_add("s[2]", "3", "D")}, CASE WHEN r[1] = '0' AND r[3] = 's' THEN {_add("s[1]", "r[2]::BIGINT", "K")} END),
  least({_add("s[3]", "3", "D")}, {_stay("s[1]", "u")}, {_stay("s[2]", "u")}, {_stay("s[4]", "u")}),
  least({_add("s[4]", "3", "D")}, {_stay("s[3]", "a")})]"""
_INSERTED = f"""[b[1], b[2], least(b[3], {_add("b[1]", "2", "I")}, {_add("b[2]", "2", "I")}, {_add("b[4]", "2", "I")}),
  least(b[4], {_add("b[3]", "2", "I")}, {_add("b[1]", "4", "II")}, {_add("b[2]", "4", "II")})]"""
OP13_SQL = rf"""
WITH c AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM conversations),
x AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, b: xor(tab[1 + (xor(s, b) & 255)], s // 256)), 4294967295) % 20 AS code FROM o, c),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM x WHERE code <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM d),
f AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS mark, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS nth FROM n),
g AS (SELECT *, CASE WHEN mark = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN mark NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM f),
a AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    list_reduce(list_prepend(['000000000', NULL, '000000002I', '000000004II'], list([CASE WHEN fault IN ('b', 'd') THEN '1' ELSE '0' END, CASE WHEN fault = 't' THEN '1' ELSE '0' END, initial] ORDER BY k)),
      lambda s, r: list_transform([{_STEP}], lambda b: {_INSERTED})[1]) AS s FROM g GROUP BY conv_id),
p AS (SELECT *, least(s[1], s[4]) AS best FROM a),
e AS (SELECT conv_id, unnest(range(1, len(best) - 8)) AS i, unnest(string_split(substr(best, 10), '')) AS edit FROM p WHERE len(best) > 9),
q AS (SELECT conv_id, i, edit, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS k FROM e),
m AS (SELECT q.conv_id, q.i, q.edit, g.role, CASE WHEN edit = 'I' THEN '' ELSE g.text END AS text, row_number() OVER (PARTITION BY q.conv_id ORDER BY i) - 1 AS place,
    first_value(edit = 'K' AND g.initial = 's') OVER (PARTITION BY q.conv_id ORDER BY i) AS led FROM q LEFT JOIN g ON q.conv_id IS NOT DISTINCT FROM g.conv_id AND q.k = g.k WHERE edit <> 'D'),
t AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place + CASE WHEN led THEN 1 ELSE 0 END) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS whole FROM m GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(best, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM i.conv_id
"""
