"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones, exact.

A document is the set of its distinct word shingles (64-bit hashes). Documents with the same set are one class (128 bits; a
set of one shingle by its words); the join works on classes and returns a component for every document, so copies are never
paired with each other. Texts go by 128 bits as well.

1. Shingle counts. Each task counts the shingles of its batches before they move; they are dealt to parts whose number grows
   with the bytes of the texts, so that no part outgrows a task. What is left after the exchange is a
   fixed-size table (2**24 one-byte cells, whatever the corpus) of frequency classes. Cell 0 means that the shingle is in one
   document only. The table only orders shingles, rare ones first, and any order gives the same result.
2. Keys. A link needs a share of each set's shingles, so two linked sets meet in their prefixes under that order. A large
   set lists each shingle of its prefix (inverted lists). A small set instead lists the two-subsets of a prefix that is longer
   by one; lists are then far shorter, at the price of more keys. The boundary is the size where both cost the same: it comes
   from the histogram of sizes and the mean list length. Small sets that can still match a large one list single shingles too.
   Shingles that no other document has are never listed, nor are sets too small to link with any but themselves.
3. Candidates. Two sets of a list are compared if their sizes, their numbers of shared shingles and what is left behind the
   key still allow a link. In a list of more than ``heavy`` sets all are first compared with one of them, the one
   with the fewest rare shingles; only pairs that are then still in different components are formed afterwards, in blocks of
   bounded size.
4. Links are verified on whole sets. Components join them.

Hot lists and copies: exact copies collapse before any list is made, partial aggregates come before shuffles, joins on hot
keys are plain equi-joins that can be split at run time. Only the table of step 1 (16 MB) and, if a count shows that they
are at most ``MAX_BROADCAST``, hashes of the texts to be verified are broadcast.

Defined results: null texts and texts without words have the empty set and link with nothing; ids may be null or repeated
(a component's id is the smallest id in it, nulls left aside); other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import map_texts, materialize, text_of
from maskwright.llm.components import components, joined

N, PERCENT, HEAVY, BLOCK, MAX_BROADCAST = 4, 85, 32, 2048, 500_000
#: Bits of the frequency table's places, least and most bits of parts, bytes of texts for a part, shingles that a task counts at once.
CELL_BITS, LEAST_BITS, MOST_BITS, PART_BYTES, AT_ONCE = 24, 10, 22, 32 << 20, 1 << 19
LONG_WORD = 4096

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_TO_LOWER = bytes(_LOWER.astype(np.uint8))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWER = np.cumprod(np.concatenate([[np.uint64(1)], np.full(LONG_WORD - 1, _BASE)]), dtype=np.uint64)


def _word_hashes(own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of words that follow each other in ``own`` (lower-cased bytes): polynomial ones, and a digest for those over LONG_WORD bytes."""
    first = np.cumsum(sizes) - sizes
    at = np.arange(len(own)) - np.repeat(first, sizes)
    h = _mix(np.add.reduceat((own + np.uint64(1)) * _POWER[np.minimum(at, LONG_WORD - 1)], first))
    for k in np.flatnonzero(sizes > LONG_WORD):
        word = own[first[k] : first[k] + sizes[k]].astype(np.uint8).tobytes()
        h[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return h


def shingles(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles, A-Z read as a-z; with fewer words the whole sequence is one."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    word = ~_SPACE[b]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    h = _word_hashes(_LOWER[b[word]], ends - starts)
    k = min(n, len(h))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * _BASE + h[i : len(h) - k + 1 + i]
    return np.unique(_mix(out + np.uint64(k)))


def _signature(text: str, s: np.ndarray) -> bytes:
    """128 bits for a set: of its hashes, or, where it is one shingle, of the words themselves."""
    return hashlib.md5(s.tobytes() if len(s) != 1 else b"1" + b" ".join(text.encode("utf-8", "replace").translate(_TO_LOWER).split())).digest()


def _count_batches(n: int, bits: int):
    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(sets), return_counts=True)
        short = ((found >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
        part = (found >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        rows = [(int(part[i]), short[i:j][times[i:j] == 1].tobytes(), short[i:j][times[i:j] > 1].tobytes(), times[i:j][times[i:j] > 1].astype("<u4").tobytes()) for i, j in zip(first, [*first[1:], len(found)])]
        sizes, held = np.unique([len(s) for s in sets], return_counts=True)
        rows.append((-1 - int(found[0] % np.uint64(64)) if len(found) else -1, sizes.astype("<u4").tobytes(), held.astype("<u4").tobytes(), b""))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "once", "more", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        for b in batches:
            sets += [shingles(t, n) for t in b.column(0).to_pylist()]
            if sum(map(len, sets)) >= AT_ONCE:
                yield counted(sets)
                sets = []
        if sets:
            yield counted(sets)

    return run


def _joined(t: pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), "<u4")


def _frequency(bits: int):
    def run(t: pa.Table) -> pa.Table:
        """Frequency classes of one part, its listed shingles and their occurrences; or, for negative parts, the sizes."""
        part = t.column("part")[0].as_py()
        cells, listed, total = np.zeros(1 << (CELL_BITS - bits), np.uint8), 0, 0
        if part < 0:
            sizes, held = _joined(t, "once"), _joined(t, "more")
            used, at = np.unique(sizes, return_inverse=True)
            cells = np.concatenate([used, np.bincount(at, held, len(used)).astype("<u4")]).astype("<u4")
        else:
            once, more = _joined(t, "once"), _joined(t, "more")
            x, at = np.unique(np.concatenate([once, more]), return_inverse=True)
            df = np.bincount(at, np.concatenate([np.ones(len(once)), _joined(t, "times")]), len(x))
            on = df >= 2
            listed, total = int(on.sum()), int(df[on].sum())
            np.maximum.at(cells, x[on] >> np.uint32(32 - CELL_BITS + bits), np.minimum(255, 1 + 4 * np.log2(df[on] / 2)).astype(np.uint8))
        return pa.table({"part": pa.array([part], pa.int32()), "cells": pa.array([cells.tobytes()], pa.binary()), "listed": pa.array([listed], pa.int64()), "total": pa.array([total], pa.int64())})

    return run


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def prefix(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def boundary(sizes: dict[int, int], mean_list: float, percent: int = PERCENT) -> int:
    """The largest size that lists subsets: where keys of subsets cost more than scanning lists of single shingles."""
    cost, best, at = 0.0, 0.0, 0
    for n in sorted(s for s in sizes if 0 < s <= 1000):
        p = prefix(n, percent)
        cost += sizes[n] * (math.comb(p + 1, 2) - p * mean_list)
        if cost < best:
            best, at = cost, n
    return at


def _statistics(texts: DataFrame, n: int, percent: int) -> tuple[np.ndarray, int]:
    """The table of frequency classes (16 MB) and the boundary; they and at most 64 rows of sizes come to the driver, a part at a time."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(size / PART_BYTES + 1))))
    counted = map_texts(texts.select("text"), _count_batches(n, bits), "part int, once binary, more binary, times binary")
    width = 1 << (CELL_BITS - bits)
    cells, sizes, listed, total = np.zeros(1 << CELL_BITS, np.uint8), {}, 0, 0
    for r in counted.groupBy("part").applyInArrow(_frequency(bits), "part int, cells binary, listed long, total long").toLocalIterator():
        if r["part"] >= 0:
            cells[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["cells"], np.uint8)
        else:
            for s, c in np.frombuffer(r["cells"], "<u4").reshape(2, -1).T.tolist():
                sizes[s] = sizes.get(s, 0) + c
        listed, total = listed + r["listed"], total + r["total"]
    return cells, boundary(sizes, total / max(1, listed), percent)


ROWS = "kind int, doc_id long, text_hash binary, n int, sig binary, shared int, key long, rest int"


def _keys(cells: np.ndarray, small: int, n: int, percent: int):
    packed = zlib.compress(cells.tobytes(), 1)  # workers keep a task's function until their next one

    def of(s: np.ndarray, cells: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
        """Number of shingles that others may share, and the keys with what is left from each on."""
        cls = cells[(s >> np.uint64(40)).astype(np.int64)]
        order = np.lexsort((s, cls))
        unique, p, size = int((cls == 0).sum()), prefix(len(s), percent), len(s)
        out: list[tuple[int, int]] = []
        if 100 * size < percent * (size + 1):  # one shingle apart is too much: it links with its own class alone
            return size - unique, out
        if size > small * percent / 100:
            out += [(int(s[k].view(np.int64)), size - i) for i in range(unique, p) for k in (order[i],)]
        if size <= small:
            head = [s[order[i]] for i in range(unique, min(p + 1, size))]
            two = [(i, j) for j in range(1, len(head)) for i in range(j)]
            if two:
                i, j = np.array(two).T
                h = np.array(head)
                out += zip(_mix(_mix(h[i]) + h[j]).view(np.int64).tolist(), (size - (unique + j) + 1).tolist())
        return size - unique, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(zlib.decompress(packed), np.uint8)
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc, hash_, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                s = shingles(text, n)
                sig = _signature(text, s)
                shared, keys = of(s, cells) if len(s) else (0, [])
                rows = [(0, doc, hash_, len(s), sig, shared, None, None)] + [(1, None, None, len(s), sig, shared, key, rest) for key, rest in keys]
                for c, values in zip(cols, zip(*rows)):
                    c += values
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds)], [x.split()[0] for x in ROWS.split(", ")])

    return run


def _can_link(a: Column, b: Column, percent: int) -> Column:
    most = F.least(a["rest"], b["rest"], a["shared"], b["shared"])
    return (100 + percent) * most >= percent * (a["n"] + b["n"])


def _open_pairs(percent: int):
    """Pairs of a list, or of two blocks of it, that are in different components and can link."""

    def run(t: pa.Table) -> pa.Table:
        i, j, block = (np.asarray(t.column(c)) for c in ("i", "j", "block"))
        n, shared, rest = (np.asarray(t.column(c)).astype(np.int64) for c in ("n", "shared", "rest"))
        sig, root = (np.array(t.column(c).to_pylist(), object) for c in ("sig", "root"))
        _, root = np.unique(root, return_inverse=True)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = [], []
        for k in left:
            most = np.minimum(np.minimum(rest[k], rest[right]), np.minimum(shared[k], shared[right]))
            on = right[(root[right] != root[k]) & ((100 + percent) * most >= percent * (n[k] + n[right]))]
            on = on[on > k] if i[0] == j[0] else on
            a += [min(sig[k], sig[x]) for x in on]
            b += [max(sig[k], sig[x]) for x in on]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Shingle sets of the texts with the wanted hashes: sig, items."""
    n_wanted = wanted.limit(MAX_BROADCAST + 1).count()
    found = docs.join(F.broadcast(wanted) if n_wanted <= MAX_BROADCAST else wanted, "text_hash", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            sigs, items = [], []
            for hash_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if hash_ not in seen:
                    seen.add(hash_)
                    s = shingles(text, n)
                    sigs.append(_signature(text, s))
                    items.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(items, pa.list_(pa.int64()))], ["sig", "items"])

    return materialize(map_texts(found.select("text_hash", "text"), run, "sig binary, items array<long>").groupBy("sig").agg(F.first("items").alias("items")), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    x, y = sets.select(F.col("sig").alias("a"), F.col("items").alias("x")), sets.select(F.col("sig").alias("b"), F.col("items").alias("y"))
    both = pairs.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.filter(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT, heavy: int = HEAVY, block: int = BLOCK, payload: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Documents with their class, and the links between classes that were verified.

    Documents: doc_id, n_shingles, sig, text_hash, component_id, component (the component's smallest class; null for an
    empty set, which is a component of its own). Links: a, b (classes). Links inside a component that others already imply may be missing.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("text_hash", _text_key(F.col("text")))
    cells, small = _statistics(docs, n, percent)
    rows = materialize(map_texts(docs.select("doc_id", "text_hash", "text"), _keys(cells, small, n, percent), ROWS), "keys")
    classes = rows.filter("kind = 0 and n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min("text_hash").alias("text_hash"))

    entries = rows.filter("kind = 1").groupBy("key", "sig").agg(F.max("n").alias("n"), F.max("shared").alias("shared"), F.max("rest").alias("rest"))
    hub = F.min(F.struct((F.col("n") - F.col("shared")).alias("rare"), "sig", "n", "shared", "rest")).alias("hub")
    lists = entries.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("size"), hub).filter("size > 1")
    listed = materialize(joined(entries, lists, "key", "k").drop("k"), "lists")
    entry = F.struct("sig", "n", "shared", "rest").alias("x")
    few = listed.filter(F.col("size") <= heavy).groupBy("key").agg(F.collect_list(entry).alias("xs"))
    paired = F.flatten(F.transform("xs", lambda a: F.transform(F.filter("xs", lambda b: (b["sig"] > a["sig"]) & _can_link(a, b, percent)), lambda b: F.struct(a["sig"].alias("a"), b["sig"].alias("b")))))
    light = few.select(F.explode(paired).alias("p")).select("p.a", "p.b")
    many = listed.filter(F.col("size") > heavy)
    star = many.withColumn("x", entry).filter((F.col("x.sig") != F.col("hub.sig")) & _can_link(F.col("x"), F.col("hub"), percent)).select(F.least("sig", "hub.sig").alias("a"), F.greatest("sig", "hub.sig").alias("b"))
    pairs = materialize(light.unionByName(star).distinct(), "pairs")

    wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).union(many.select("sig")).distinct().join(classes, "sig").select("text_hash").distinct()
    sets = _sets(docs, wanted, n)
    links = materialize(_verified(pairs, sets, percent), "links")
    first = components(links)

    rooted = many.join(first.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig")).drop("hub")
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select(F.col("key").alias("k"))
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = joined(rooted, split, "key", "k").drop("k").withColumn("block", F.pmod(F.xxhash64("sig"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    grid = dealt.withColumn("o", other).withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")}).drop("o", "size")
    more = grid.groupBy("key", "i", "j").applyInArrow(_open_pairs(percent), "a binary, b binary").distinct()
    late = materialize(_verified(more, sets, percent), "late")
    whole = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late))

    of_class = classes.join(whole, F.col("sig") == F.col("node"), "left").select("sig", "rep", F.coalesce("root", "sig").alias("component"))
    ids = of_class.groupBy(F.col("component").alias("c")).agg(F.min("rep").alias("component_id"))
    named = joined(of_class, ids, "component", "c").select("sig", "component", "component_id")
    out = rows.filter("kind = 0").select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), "sig")
    full = out.filter("n_shingles > 0").join(named, "sig")
    empty = out.filter("n_shingles = 0").withColumns({"component": F.lit(None).cast("binary"), "component_id": F.col("doc_id")})
    return full.unionByName(empty), links.unionByName(late)


def digest(df: DataFrame, **kw) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return join(df, **kw)[0].select("doc_id", "n_shingles", "component_id")



def dedupe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of df that stay: of each component the one with the smallest id (then text hash), of repeated rows one; rows without words all stay.

    Rows that go, and repeated ones, are few beside the rest; their keys are broadcast if a count shows that they are at most
    ``MAX_BROADCAST``, else joined.
    """
    found = materialize(join(df, id_col, text_col, **kw)[0].filter("n_shingles > 0").groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"), F.first("component").alias("component")), "found")
    kept = found.groupBy(F.col("component").alias("c")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("k"))
    marked = joined(found, kept, "component", "c").withColumn("goes", ~(F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_hash") == F.col("k.text_hash")))).filter("goes or times > 1")
    marks = materialize(marked.select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"), "goes"), "marks")
    small = marks.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    own = df.select(F.struct(*(F.col(c) for c in df.columns)).alias("row"), F.col(id_col).cast("long").alias("k_id"), _text_key(text_of(text_col)).alias("k_hash"))
    on = F.col("k_id").eqNullSafe(F.col("m_id")) & (F.col("k_hash") == F.col("m_hash"))
    seen = own.join(F.broadcast(marks) if small else marks, on, "left")
    once = seen.filter("goes is not null and not goes").dropDuplicates(["k_id", "k_hash"])
    return seen.filter("goes is null").unionByName(once).select("row.*")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS g
  FROM w),
u AS (SELECT r, unnest(g) AS h FROM s),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM u a JOIN u b ON a.h = b.h AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM i JOIN s x ON x.r = a JOIN s y ON y.r = b WHERE 100 * c >= 85 * (len(x.g) + len(y.g) - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(r, x) AS (SELECT r, r FROM s UNION SELECT reach.r, e.b FROM reach JOIN e ON reach.x = e.a)
SELECT s.doc_id, CAST(any_value(len(s.g)) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id
FROM reach JOIN s ON s.r = reach.r JOIN s t ON t.r = reach.x GROUP BY s.r, s.doc_id
"""
