"""Quality rules: size, symbols and repetition, by rolling hashes in numpy.

A document is scanned whole, one row at a time inside Arrow batches, so nothing is shuffled and memory follows the batch.
Words get 64-bit hashes; the hash of every n-word window follows from the window before it by one multiply-add on whole
arrays (a polynomial hash, taken for each n from prefix values). A window whose hash was seen twice marks all its words as
covered, and the characters of covered words are the repetition coverage of that n. Lines are measured alike.

A document fails the base rules when it has under 50 words or over half of its words stand in repeated 3-word windows.
It fails the method's rules when, for one of the lengths, the share of characters inside duplicated windows is over that
length's bound, lines equal to an earlier line hold more characters than their bound, or there are too many symbols. The bounds are
those that the literature gives for web text (Rae et al. 2021: 0.15 of five words down to 0.10 of ten), doubled, as these shares
count the first of equal windows too; they are not fitted to any label.

Defined results: null and empty texts have no words, fail the base rule and are not kept; ids may be null or repeated;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import map_texts, text_of, words


@dataclass(frozen=True)
class Rules:
    """Bounds: least words, symbols for each word, share of words in repeated 3-word windows, share of characters covered by duplicated windows of n words, share of characters in duplicated lines."""

    least_words: int = 50
    repeat_percent: int = 50
    symbols_per_word: float = 0.1
    covered: tuple[tuple[int, float], ...] = ((5, 0.30), (6, 0.28), (7, 0.26), (8, 0.24), (9, 0.22), (10, 0.20))
    line_chars: float = 0.30


_SYMBOLS = re.compile(r"[#*$%&|<>]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered double, dup_line_share double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n words: sum of word hash times base**(n-1-k), rolled from the shorter window."""
    if len(hashes) < n:
        return hashes[:0]
    h = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        h *= _BASE
        h += hashes[k : len(hashes) - n + 1 + k]
    return _mix(h)


def repeated(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which words stand in a window of n words that is found twice or more in the text."""
    h = window_hashes(hashes, n)
    covered = np.zeros(len(hashes), bool)
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if len(twice):
        at = np.flatnonzero(np.isin(h, twice))
        for k in range(n):
            covered[at + k] = True
    return covered


def measure(text: str, rules: Rules) -> tuple:
    found = words(text)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    hashes = _mix(np.fromiter(map(hash, found), np.int64, len(found)).view(np.uint64))
    seen: set[str] = set()
    dup_lines = dup_chars = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
            dup_chars += sum(map(len, words(line)))
        elif words(line):
            seen.add(line)
    chars, n = int(sizes.sum()), len(found)
    n_repeat = int(repeated(hashes, 3).sum())
    failed = n < rules.least_words or 100 * n_repeat > rules.repeat_percent * n
    shares = [int(sizes[repeated(hashes, k)].sum()) / chars if chars else 0.0 for k, _ in rules.covered]
    line_share = dup_chars / chars if chars else 0.0
    n_symbols = len(_SYMBOLS.findall(text))
    kept = not failed and n_symbols <= rules.symbols_per_word * n and line_share <= rules.line_chars and all(s <= most for s, (_, most) in zip(shares, rules.covered))
    return n, chars, n_symbols, dup_lines, n_repeat, failed, kept, max(shares), line_share


def check(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, kept, covered (largest coverage) and dup_line_share."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t, rules) for t in b.column(1).to_pylist()]
            columns = list(zip(*rows)) or [()] * (len(names) - 1)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return map_texts(df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), run, SCHEMA)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
w AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, length(unnest(ws)) AS c FROM s),
p AS (SELECT r, n, list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' ')) AS gs FROM s, (SELECT unnest([3, 5, 6, 7, 8, 9, 10]) AS n) WHERE len(ws) >= n),
g AS (SELECT r, n, unnest(range(1, len(gs) + 1)) AS i, unnest(gs) AS g FROM p),
t AS (SELECT r, n, g FROM g GROUP BY r, n, g HAVING count(*) > 1),
c AS (SELECT DISTINCT g.r, g.n, g.i + k AS i FROM g JOIN t ON t.r = g.r AND t.n = g.n AND t.g = g.g, (SELECT unnest(range(10)) AS k) WHERE k < g.n),
v AS (SELECT c.r, c.n, count(*) AS words, sum(w.c) AS chars FROM c JOIN w ON w.r = c.r AND w.i = c.i GROUP BY c.r, c.n),
l AS (SELECT r, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d)),
e AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
x AS (SELECT r, count(*) AS lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM e WHERE k > 1 GROUP BY r),
f AS (
  SELECT s.r, s.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(x.lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce((SELECT words FROM v WHERE v.r = s.r AND n = 3), 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce((SELECT chars FROM v WHERE v.r = s.r AND n = 5), 0) AS DOUBLE) AS c5,
         CAST(coalesce((SELECT chars FROM v WHERE v.r = s.r AND n = 6), 0) AS DOUBLE) AS c6,
         CAST(coalesce((SELECT chars FROM v WHERE v.r = s.r AND n = 7), 0) AS DOUBLE) AS c7,
         CAST(coalesce((SELECT chars FROM v WHERE v.r = s.r AND n = 8), 0) AS DOUBLE) AS c8,
         CAST(coalesce((SELECT chars FROM v WHERE v.r = s.r AND n = 9), 0) AS DOUBLE) AS c9,
         CAST(coalesce((SELECT chars FROM v WHERE v.r = s.r AND n = 10), 0) AS DOUBLE) AS c10, CAST(coalesce(x.chars, 0) AS DOUBLE) AS lc
  FROM s LEFT JOIN x ON x.r = s.r),
h AS (SELECT *, CASE WHEN word_chars > 0 THEN c5 / word_chars ELSE 0 END AS s5,
  CASE WHEN word_chars > 0 THEN c6 / word_chars ELSE 0 END AS s6,
  CASE WHEN word_chars > 0 THEN c7 / word_chars ELSE 0 END AS s7,
  CASE WHEN word_chars > 0 THEN c8 / word_chars ELSE 0 END AS s8,
  CASE WHEN word_chars > 0 THEN c9 / word_chars ELSE 0 END AS s9,
  CASE WHEN word_chars > 0 THEN c10 / word_chars ELSE 0 END AS s10,
  CASE WHEN word_chars > 0 THEN lc / word_chars ELSE 0 END AS dup_line_share, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_symbols <= 0.1::DOUBLE * n_words AND dup_line_share <= 0.30::DOUBLE AND s5 <= 0.30::DOUBLE AND s6 <= 0.28::DOUBLE AND s7 <= 0.26::DOUBLE
         AND s8 <= 0.24::DOUBLE AND s9 <= 0.22::DOUBLE AND s10 <= 0.20::DOUBLE AS kept,
       CAST(greatest(s5, s6, s7, s8, s9, s10) AS DOUBLE) AS covered, CAST(dup_line_share AS DOUBLE) AS dup_line_share
FROM h
"""
