"""Best-fit packing of documents into sequences, by the configuration linear program over the length histogram.

1. Documents become token ids with an end id; longer ones than a sequence are cut into whole sequences, the first piece
   being what is left. Pieces are counted by length: the histogram has at most ``capacity`` rows, whatever the corpus.
2. The configuration program (a variable for each way to fill a sequence; every length must be covered as often as it
   occurs; as few sequences as possible) is solved on the histogram by multiplicative weights: lengths that are covered
   less weigh more, and a knapsack by dynamic programming prices the best configuration for the weights.
3. The fractional counts are rounded down to whole configurations; what is left is filled from the largest length on, each
   time the largest that fits best. The result covers every length exactly.
4. Pieces of one length are numbered (by buckets, so that a frequent length is no single group) and a piece's number gives
   its configuration, sequence and offset by a look-up in the solution, whose size follows from the capacity alone.

Only ids, lengths and checksums move between tasks. Defined results: null and empty texts are one piece with the end id
alone; ids may be null or repeated, each row is packed by itself; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm import byte_bpe
from maskwright.llm.common import map_texts, materialize, text_of

CAPACITY, END_ID = 1024, 2
#: The program is solved to within this share of its dual bound, or for so many rounds.
GAP, ROUNDS, PROGRAMS = 0.05, 500, 3
PIECES = "doc_id long, piece long, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kept = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(byte_bpe.encode(text, path), np.array([end_id], "<u4"))
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    own = ids[i:j].tobytes()
                    rows.append((doc, k, i, j - i, zlib.crc32(own)))
                    kept.append(own) if with_ids else None
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 5
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return map_texts(df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), run, PIECES + ", ids binary" * with_ids)


@dataclass
class Solution:
    """Configurations: copies of each length, and in how many sequences each is used. ``value`` is the fractional program's, and no
    packing whatever has fewer sequences than ``bound``, its dual."""

    lengths: list[dict[int, int]]
    uses: list[int]
    value: float = 0.0
    bound: float = 0.0


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """By dynamic programming, for each room up to capacity the most value that fits, and the length to take first (0: leave one free); value[l] is that of one item of length l (0: none of it)."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    usable = np.where(value > 0, value, -np.inf)
    for c in range(1, capacity + 1):
        sums = usable[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(sums.argmax())
        best[c], took[c] = (sums[k], k + 1) if sums[k] > best[c - 1] else (best[c - 1], 0)
    return best, took


def filled(took: np.ndarray, room: int, first: int = 0) -> dict[int, int]:
    """The best configuration of a room, after one item of length ``first``, if given."""
    out = {first: 1} if first else {}
    room -= first
    while room > 0:
        l = int(took[room])
        if l:
            out[l] = out.get(l, 0) + 1
        room -= l or 1
    return out


def fractional(counts: np.ndarray, capacity: int, gap: float = GAP, rounds: int = ROUNDS) -> tuple[dict[tuple, float], float, float]:
    """The configuration program by multiplicative weights: sequences of each configuration (not whole), their sum, and a dual bound.

    A length's price is its tokens times exp(-rate * share of its count that is covered so far), so lengths that are behind cost
    more. A round prices all configurations by one knapsack and takes, for each length, the best that holds it, if its value
    is within ``gap`` of the best of all; it grows until one of its lengths has gained 1/rate of its count in the round. Prices
    divided by the best value are a solution of the dual program, whose largest value bounds every packing from below. It ends
    when the solution, scaled up to cover every length, is within ``gap`` of that bound, and after ``rounds`` in any case.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return {}, 0.0, 0.0
    have = counts.astype(float)
    rate = np.log(len(lengths) + 1) / gap
    covered, bound, total = np.zeros(len(counts)), 0.0, 0.0
    x: dict[tuple, float] = {}
    for _ in range(rounds):
        share = covered[lengths] / have[lengths]
        price = np.zeros(len(counts))
        price[lengths] = lengths * np.exp(-np.minimum(rate * (share - share.min()), 600))
        best, took = knapsack(price, capacity)
        bound = max(bound, float(price @ have) / best[capacity])
        if share.min() > 0 and total / share.min() <= (1 + gap) * bound:
            break
        worth = price[lengths] + best[capacity - lengths]
        room = have / rate
        for l in lengths[np.argsort(-worth, kind="stable")][: int((worth >= (1 - gap) * best[capacity]).sum())].tolist():
            if room[l] > 0:
                config = tuple(sorted(filled(took, capacity, l).items()))
                gain = min(room[k] / a for k, a in config)
                if gain > 0:
                    x[config] = x.get(config, 0.0) + gain
                    total += gain
                    for k, a in config:
                        room[k] -= a * gain
                        covered[k] += a * gain
    least = float((covered[lengths] / have[lengths]).min())
    scale = 1 / least if least else 1.0
    return {c: n * scale for c, n in x.items()}, total * scale, bound


def solve(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP, rounds: int = ROUNDS) -> Solution:
    """Whole configurations that cover the histogram exactly.

    The fractional solution is rounded in order of use, what is cut off being carried to the next configuration, and never above what is left of
    a length. What remains is a smaller program of the same kind, solved in turn (at most PROGRAMS of them, fewer where rounding gains
    nothing); the last pieces go largest first, each time with the largest that fits.
    """
    left = np.zeros(capacity + 1, np.int64)
    for l, n in histogram.items():
        left[l] = n
    lengths: list[dict[int, int]] = []
    uses: list[int] = []

    def use(config: dict[int, int], n: int) -> None:
        lengths.append(config)
        uses.append(n)
        for l, a in config.items():
            left[l] -= a * n

    first = None
    for _ in range(PROGRAMS):
        x, value, bound = fractional(left, capacity, gap, rounds)
        first = first or (value, bound)
        before, carry = int(left.sum()), 0.0
        for config, n in sorted(x.items(), key=lambda c: (-c[1], c[0])):
            whole = min(int(n + carry + 1e-9), *(int(left[l]) // a for l, a in config))
            carry = min(n + carry - whole, 1.0)
            if whole > 0:
                use(dict(config), whole)
        if before - int(left.sum()) <= before // 4:
            break
    while left.any():
        config, gap_ = {}, capacity
        while gap_ and len(fit := np.flatnonzero(left[: gap_ + 1] - np.array([config.get(l, 0) for l in range(gap_ + 1)]) > 0)):
            l = int(fit[-1])
            config[l] = config.get(l, 0) + 1
            gap_ -= l
        use(config, min(int(left[l]) // a for l, a in config.items()))
    return Solution(lengths, uses, *(first or (0.0, 0.0)))


def _places(solution: Solution, capacity: int) -> dict[str, np.ndarray]:
    """For each length its configurations by the pieces' numbers: first number, copies, first sequence, offset of the first copy."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    base = 0
    for config, n in zip(solution.lengths, solution.uses):
        at = 0
        for l, a in sorted(config.items(), reverse=True):
            rows.setdefault(l, []).append((given.get(l, 0), a, base, at))
            given[l] = given.get(l, 0) + a * n
            at += a * l
        base += n
    flat = [(l, *r) for l in sorted(rows) for r in rows[l]]
    t = np.array(flat, np.int64).reshape(len(flat), 5)
    return {"key": (t[:, 0] << 48) + t[:, 1], "first": t[:, 1], "copies": t[:, 2], "base": t[:, 3], "offset": t[:, 4]}


def numbered(df: DataFrame, key: str, order: list[str], n_rows: int) -> DataFrame:
    """Rows with ``number``, 0, 1, 2, ... within each key, without gathering a key: numbers within buckets of about sqrt(rows) rows, plus the sizes of the buckets before."""
    buckets = max(1, n_rows // max(2000, int(n_rows**0.5)))
    dealt = df.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    inside = dealt.withColumn("inside", F.row_number().over(Window.partitionBy(key, "bucket").orderBy(*order)) - 1)
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy(key, "bucket").agg(F.count("*").alias("n")).withColumn("before", before).drop("n")
    return inside.join(sizes, [key, "bucket"]).withColumn("number", F.col("before") + F.col("inside")).drop("bucket", "inside", "before")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. ``cut`` is read twice and should be a written table."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at = _places(solve(histogram, capacity), capacity)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, length = b.column("number").to_numpy(), b.column("length").to_numpy()
            k = np.searchsorted(at["key"], (length << 48) + number, side="right") - 1
            local = number - at["first"][k]
            copies = at["copies"][k]
            out = [at["base"][k] + local // copies, at["offset"][k] + local % copies * length]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), *map(pa.array, out)], [*cols, "sequence_id", "offset"])

    ready = numbered(cut, "length", ["doc_id", "piece", "start", "ids_crc32"], sum(histogram.values()))
    return ready.select(*cols, "number").mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, **cols) -> DataFrame:
    """All documents packed: a row per piece with its sequence and offset."""
    return place(materialize(pieces(df, path, capacity=capacity, end_id=end_id, **cols), "pieces"), capacity)
