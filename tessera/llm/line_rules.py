"""Operator 11: line-first cleaning.  Lines are judged one by one, failures go, then texts that lost too much are rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrays import IS_SPACE, U64, mix, runs
from tessera.llm.common import table

#: A text is rejected if its failed lines hold more than this share of its words, in percent.
MOST_LOST = 30
#: A line of so many words has to end a sentence somewhere.
LONG_LINE = 10
#: Boilerplate phrases count in lines of at most so many words; a longer line is prose that happens to name one.
BOILERPLATE_WORDS = 40
SEPARATORS = ("|", ">", ">>", "»", "›", "·", "•", "/", "::")
SENTENCE_END = r"""[.!?…。！？]["')\]»”’]*$"""
#: Two marks in a row at the end of a word; dots are left out, as prose has ellipses.
MARKS_END = r"[!?#*$%&|<>~^=+_-]{2}$"
PHRASES = (
    "all rights reserved", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie policy", "cookie settings",
    "accept cookies", "uses cookies", "use of cookies", "enable javascript", "javascript is disabled", "click here", "read more", "learn more",
    "sign in", "sign up", "log in", "add to cart", "share this", "follow us", "subscribe to our", "skip to content", "back to top", "powered by",
    "lorem ipsum",
)
SYMBOLS = "#*$%&|<>"

_separators = frozenset(x.encode() for x in SEPARATORS)
_sentence_end = re.compile(SENTENCE_END)
_marks_end = re.compile(MARKS_END)
_phrases = re.compile("|".join(map(re.escape, PHRASES)).encode())
_starts_character = (np.arange(256) & 0xC0) != 0x80
_is_symbol = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), np.uint8))
_counted = _starts_character & ~IS_SPACE


def fault(line: bytes, words: list[bytes]) -> str | None:
    """Why a line with words fails, or None: navigation, punctuation or boilerplate."""
    n = len(words)
    separators = sum(w in _separators for w in words)
    if separators and 5 * separators >= n:
        return "navigation"
    if n >= 3 and 2 * sum(_marks_end.search(w.decode()) is not None for w in words) > n:
        return "punctuation"
    if n >= LONG_LINE and not any(_sentence_end.search(w.decode()) for w in words):
        return "punctuation"
    if n <= BOILERPLATE_WORDS and _phrases.search(line.lower()):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """How many words lie in windows of ``width`` words that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    names = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    # A hash of each window tells most texts, which repeat nothing, at once; the others' windows get exact names.
    hashed = np.zeros(n, U64)
    mixed = mix(names.astype(U64) + U64(1))
    for k in range(width):
        hashed = mix(hashed + mixed[k : k + n])
    ordered = np.sort(hashed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    window = np.zeros(n, np.int64)
    for k in range(width):
        _, window = np.unique(window * len(ids) + names[k : k + n], return_inverse=True)
    often = np.bincount(window)[window] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += often
    edges[width : width + n] -= often
    return int(np.count_nonzero(np.cumsum(edges)))


def judged(raw: bytes, most_lost: int = MOST_LOST) -> dict:
    """The counts of one text, its verdict and its text without failed lines."""
    words = raw.split()
    n = len(words)
    octets = np.frombuffer(raw, np.uint8)
    seen: set[bytes] = set()
    again = failed = lost = 0
    stay = []
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            if line in seen:
                again += 1
            seen.add(line)
            if fault(line, own) is not None:
                failed += 1
                lost += len(own)
                continue
        stay.append(line)
    repeats = repeated_words(words)
    base = n < 20 or 100 * repeats > 30 * n
    kept = not base and 100 * lost <= most_lost * n
    return {
        "n_words": n, "word_chars": int(_counted[octets].sum()), "n_symbols": int(_is_symbol[octets].sum()), "n_dup_lines": again, "n_repeat_words": repeats,
        "n_failed_lines": failed, "n_lost_words": lost, "base_failed": base, "kept": kept, "clean_text": b"\n".join(stay) if kept else None,
    }


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_failed_lines long, n_lost_words long, base_failed boolean, kept boolean"


def clean_lines(docs: DataFrame, most_lost: int = MOST_LOST, texts: bool = True) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the counts, base_failed, kept and, with ``texts``, clean_text (null if rejected).

    Each line (between newlines) with a word is judged by itself: *navigation* (a fifth or more of its words are
    separators such as ``|`` or ``»``), *punctuation* (most of its words end in two or more marks, or it is long and
    ends no sentence), *boilerplate* (a stock phrase in a line that is not long).  Lines that fail go; a text that loses
    more than ``most_lost`` percent of its words is rejected, and so is one that fails the base rules: fewer than 20
    words, or over 30 percent of its words in repeated windows of eight.

    Null and empty texts and texts of white space have no words, so they fail the base rules.  Every row is judged by
    itself: null and repeated ids and repeated rows keep a row each, an empty table gives none, and other columns,
    whatever their names, are not looked at.  Texts are worked on whole and one at a time; what is held is about ten
    times the longest text.  There is no shuffle.
    """
    names = [c.split()[0] for c in COUNTS.split(", ")] + ["clean_text"] * texts

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch):
                found = []
                for x in part.column("text"):
                    row = judged(x.as_buffer().to_pybytes() if x.is_valid else b"", most_lost)
                    found.append([row[c] for c in names])
                columns = [pa.array(c, pa.binary()).cast(pa.string()) if k == "clean_text" else pa.array(c) for k, c in zip(names, zip(*found, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *names])

    schema = f"doc_id long, {COUNTS}" + ", clean_text string" * texts
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, schema)


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts of the base rules, the lines and words that fail, base_failed and kept, for every document; cases as in ``clean_lines``."""
    return clean_lines(table(spark, sf_dir, "documents"), texts=False)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
lines AS (SELECT doc_id, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS k, unnest(string_split(t, chr(10))) AS line FROM d),
worded AS (SELECT doc_id, k, line, {_WORDS.format("line")} AS w FROM lines),
facts AS (SELECT doc_id, k, line, len(w) AS n,
    len(list_filter(w, lambda x: list_contains([{", ".join(map(_quoted, SEPARATORS))}], x))) AS separators,
    len(list_filter(w, lambda x: regexp_matches(x, {_quoted(MARKS_END)}))) AS marked,
    len(list_filter(w, lambda x: regexp_matches(x, {_quoted(SENTENCE_END)}))) AS ends,
    {" OR ".join(f"contains({_LOWER}, {_quoted(p)})" for p in PHRASES)} AS phrase,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth
  FROM worded WHERE len(w) > 0),
failed AS (SELECT *, (separators > 0 AND 5 * separators >= n) OR (n >= 3 AND 2 * marked > n) OR (n >= {LONG_LINE} AND ends = 0) OR (n <= {BOILERPLATE_WORDS} AND phrase) AS fails FROM facts),
by_line AS (SELECT doc_id, count(*) FILTER (WHERE nth > 1) AS dup, count(*) FILTER (WHERE fails) AS bad, coalesce(sum(n) FILTER (WHERE fails), 0) AS lost FROM failed GROUP BY doc_id),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: md5(array_to_string(w[i:i + 7], ' ')))) AS h FROM d WHERE len(w) >= 8),
often AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS rep FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM often) GROUP BY doc_id),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words, coalesce(bad, 0)::BIGINT AS n_failed_lines, coalesce(lost, 0)::BIGINT AS n_lost_words
  FROM d LEFT JOIN by_line USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_lost_words <= {MOST_LOST} * n_words AS kept FROM f
"""
