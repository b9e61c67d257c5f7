"""Ranked lexical search over inverted lists that are blocked by geometry, exact.

1. Postings. Each document is reduced to its length and to its counts of the terms that items ask for; from these come the
   collection's figures (N, L, document frequencies) and each document's parts: a term's score without its weight.
2. Blocks. Documents are dealt into shards of at most ``shard`` documents. Within a shard each term's list is clustered by
   document similarity: documents are projected to ``DIMS`` random directions, and the list's members go to the nearest of as
   many centres as it has blocks. A block stores the coordinatewise maximum of its members' parts, over the terms that stand in
   an item together with the list's own. Blocks grow with the number of these terms, so summaries are at most about twice as
   large as the lists. The shards are written in the shared folder.
3. Probe. For every item each shard scores the block with the highest bound; the kth best of these scores is a lower
   bound of the item's kth score.
4. Search. A block's bound is the sum of weight times maximum over the item's terms, in whole numbers, so it is never below a
   member's score. A list is left aside only if it, with all lists of smaller greatest score, cannot reach the kth score; a block
   only if its bound is below it. Everything else is scored in full, once for each item. Scores that a task has found
   raise its own bound as it goes on.
5. Each task hands on at most k documents for an item; the best k of these are the result.

Items are read in chunks of about ``CHUNK_BYTES`` of text, each a search of its own, so what goes to tasks (terms and items)
is bounded however many items there are; one longer item is alone. Documents' lists stay in tasks: no candidate is shuffled.

Defined results: null texts, and texts without terms, are in no list and do not count in N; repeated documents rank each;
null ids come last among equal scores; every row of the items is an item, repeated ones too; items without terms have no rows.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import give_back, map_texts, materialize

K, SHARD, LEAST_BLOCK, DIMS = 10, 4096, 64, 32
#: Bytes of item texts in a chunk, bytes of a document that are cut into terms at once, postings that a shard holds at most (but for one document).
CHUNK_BYTES, PIECE_BYTES, MOST_POSTINGS = 1 << 20, 1 << 20, 1 << 20
#: Letters and digits of ASCII and everything beyond it are terms, A-Z as a-z; all else is a space.
_TERM = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, by pieces that end between terms."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        while end < len(text) and _TERM[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_TERM).split()
        at = end


@dataclass
class Items:
    """Items of one chunk: their ids, their terms' numbers (sorted), and for a term's number the items that have it."""

    ids: list[int | None]
    terms: list[np.ndarray]
    n_terms: int
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def of_terms(self) -> list[np.ndarray]:
        """For each term the terms that stand in an item together with it, itself included, sorted."""
        held: list[list[np.ndarray]] = [[] for _ in range(self.n_terms)]
        for own in self.terms:
            for t in own:
                held[t].append(own)
        return [np.unique(np.concatenate(x)) for x in held]


def _postings(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, terms, counts = [], [], []
            for text in b.column(1).to_pylist():
                n, found = 0, []
                for piece in term_lists(text):
                    n += len(piece)
                    found.append(np.array([t for t in map(vocabulary.get, piece) if t is not None], np.int32))
                t, c = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32),) * 2
                ns.append(n)
                terms.append(t)
                counts.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return run


def _gather(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows' entries, one row after the other, and for each the row's number in ``rows``."""
    sizes = ptr[rows + 1] - ptr[rows]
    return np.arange(sizes.sum()) + np.repeat(ptr[rows] - np.cumsum(sizes) + sizes, sizes), np.repeat(np.arange(len(rows)), sizes)


def _cluster(members: np.ndarray, sketch: np.ndarray, k: int) -> np.ndarray:
    """The block (0 to k - 1) of each member: the nearest centre, after one step of moving the centres."""
    if k == 1:
        return np.zeros(len(members), np.int64)
    own = sketch[members]
    centres = own[np.linspace(0, len(own) - 1, k).astype(np.int64)]
    near = (own @ centres.T).argmax(axis=1)
    order = np.argsort(near, kind="stable")
    used, starts = np.unique(near[order], return_index=True)
    means = np.add.reduceat(own[order], starts)
    centres[used] = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    return (own @ centres.T).argmax(axis=1)


COLUMNS = {"ids": pa.int64(), "ptr": pa.int32(), "terms": pa.int32(), "parts": pa.int32(), "block_term": pa.int32(), "block_ptr": pa.int32(), "members": pa.int32(), "top_ptr": pa.int32(), "coords": pa.int32(), "maxima": pa.int32()}
SHARDS = ", ".join(f"{c} array<{'long' if c == 'ids' else 'int'}>" for c in COLUMNS)


def _shard(ids: list, ptr: np.ndarray, terms: np.ndarray, parts: np.ndarray, items: Items, near: list[np.ndarray], sketch: np.ndarray, least_block: int) -> pa.RecordBatch:
    order = np.argsort(terms, kind="stable")
    doc = np.repeat(np.arange(len(ids)), np.diff(ptr))[order]
    held, starts = np.unique(terms[order], return_index=True)
    columns = np.full(items.n_terms, -1, np.int64)
    block_term, block_sizes, members, top_sizes, coords, maxima = ([] for _ in range(6))
    for t, i, j in zip(held.tolist(), starts.tolist(), [*starts[1:].tolist(), len(doc)]):
        own, also = doc[i:j], near[t]
        size = max(least_block, len(also) // 2)
        block = _cluster(own, sketch, -(-len(own) // size))
        by_block = np.argsort(block, kind="stable")
        own, (_, block, sizes) = own[by_block], np.unique(block, return_inverse=True, return_counts=True)
        block = block[by_block]
        columns[also] = np.arange(len(also))
        at, row = _gather(ptr, own)
        c = columns[terms[at]]
        on = c >= 0
        top = np.zeros(len(sizes) * len(also), np.int32)
        np.maximum.at(top, block[row[on]] * len(also) + c[on], parts[at[on]])
        columns[also] = -1
        r, c = np.nonzero(top.reshape(len(sizes), len(also)))
        block_term += [t] * len(sizes)
        block_sizes.append(sizes)
        members.append(own)
        top_sizes.append(np.bincount(r, minlength=len(sizes)))
        coords.append(also[c])
        maxima.append(top[top > 0])
    whole = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    ends = lambda xs: np.concatenate([[0], np.cumsum(whole(xs))])
    values = [ids, ptr, terms, parts, block_term, ends(block_sizes), whole(members), ends(top_sizes), whole(coords), whole(maxima)]
    return pa.RecordBatch.from_arrays([pa.array([v if isinstance(v, list) else np.asarray(v).astype(np.int32)], pa.list_(kind)) for v, kind in zip(values, COLUMNS.values())], list(COLUMNS))


def _index(items: Items, n_docs: int, n_all: int, shard: int, least_block: int):
    """Documents (doc_id, n, terms, counts) as shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = items.of_terms()
        directions = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (items.n_terms, DIMS))
        ids, ms, terms, counts, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in terms])
            t, c = np.concatenate(terms).astype(np.int64), np.concatenate(counts)
            parts = 1_000_000_000 * c // (1000 * c + 8 * np.repeat(np.array(ms, np.int64), sizes))
            ptr = np.concatenate([[0], np.cumsum(sizes)])
            sketch = np.zeros((len(ids), DIMS), np.float32)
            for i in range(0, len(ids), 512):
                a, b = ptr[i], ptr[min(i + 512, len(ids))]
                value = (items.weights[t[a:b]] * parts[a:b]).astype(np.float32)
                sketch[i : i + 512] = np.add.reduceat(value[:, None] * directions[t[a:b]], ptr[i : min(i + 512, len(ids))] - a)
            sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
            return _shard(list(ids), ptr, t, parts, items, near, sketch, least_block)

        for b in batches:
            for doc, n, t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if ids and (len(ids) == shard or held + len(t.values) > MOST_POSTINGS):
                    yield flush()
                    ids, ms, terms, counts, held = [], [], [], [], 0
                held += len(t.values)
                ids.append(doc)
                ms.append(10 + 90 * n * n_docs // n_all)
                terms.append(t.values.to_numpy())
                counts.append(c.values.to_numpy())
        if ids:
            yield flush()
        give_back()

    return run


class _Best:
    """The k best (score, id) of an item so far; null ids last."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, score: np.ndarray, id_: np.ndarray) -> None:
        on = score > 0
        score, id_ = np.concatenate([self.score, score[on]]), np.concatenate([self.id, id_[on]])
        if len(score) > self.k:  # only what can be among the best need be put in order
            least = np.partition(score, len(score) - self.k)[len(score) - self.k]
            on = score >= least
            score, id_ = score[on], id_[on]
        order = sorted(range(len(score)), key=lambda i: (-score[i], id_[i] is None, id_[i] or 0))[: self.k]
        self.score, self.id = score[order], id_[order]

    @property
    def bound(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0


class _Shard:
    """A stored shard, read for search."""

    def __init__(self, batch: pa.RecordBatch, row: int, items: Items) -> None:
        for c in COLUMNS:
            values = batch.column(c)[row].values
            setattr(self, c, np.array(values.to_pylist(), object) if c == "ids" else values.to_numpy().astype(np.int64))
        self.items, self.columns = items, np.full(items.n_terms, -1, np.int64)
        held, starts = np.unique(self.block_term, return_index=True)
        self.blocks = dict(zip(held.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(self.block_term)])))
        self.summaries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.greatest = np.zeros(items.n_terms, np.int64)
        np.maximum.at(self.greatest, self.terms, self.parts)

    def bounds(self, t: int, item: np.ndarray) -> np.ndarray:
        """What no member of each block of a term's list can exceed for an item."""
        i, j = self.blocks[t]
        if t not in self.summaries:
            a, b = self.top_ptr[i], self.top_ptr[j]
            used, at = np.unique(self.coords[a:b], return_inverse=True)
            top = np.zeros((j - i, len(used)), np.int64)
            top[np.repeat(np.arange(j - i), np.diff(self.top_ptr[i : j + 1])), at] = self.maxima[a:b]
            self.summaries[t] = used, top
        used, top = self.summaries[t]
        at = np.minimum(np.searchsorted(used, item), len(used) - 1)
        on = used[at] == item
        return top[:, at[on]] @ self.items.weights[item[on]]

    def essential(self, item: np.ndarray, least: int) -> list[int]:
        """Terms whose lists must be looked at: the others' greatest scores do not reach ``least`` together."""
        held = [t for t in item.tolist() if t in self.blocks]
        held.sort(key=lambda t: int(self.greatest[t] * self.items.weights[t]))
        reach = np.cumsum([self.greatest[t] * self.items.weights[t] for t in held])
        return [t for t, r in zip(held, reach) if r >= max(least, 1)]

    def members_of(self, blocks: list[int]) -> np.ndarray:
        return np.unique(np.concatenate([self.members[self.block_ptr[b] : self.block_ptr[b + 1]] for b in blocks]))

    def scores(self, docs: np.ndarray, item: np.ndarray) -> np.ndarray:
        weight = self.columns
        weight[:] = 0
        weight[item] = self.items.weights[item]
        at, row = _gather(self.ptr, docs)
        return np.add.reduceat(weight[self.terms[at]] * self.parts[at], np.flatnonzero(np.diff(row, prepend=-1)))

    def search(self, item: np.ndarray, best: _Best, least: int, probe: bool) -> None:
        least = max(least, best.bound)
        found = [(self.blocks[t][0], self.bounds(t, item)) for t in self.essential(item, least)]
        if not found:
            return
        block, bound = np.concatenate([i + np.arange(len(x)) for i, x in found]), np.concatenate([x for _, x in found])
        first = int(bound.argmax())
        if bound[first] < max(least, 1):
            return
        seen = self.members_of([block[first]])
        best.add(self.scores(seen, item), self.ids[seen])
        if not probe:
            bound[first] = -1
            open_ = block[bound >= max(least, best.bound, 1)]
            if len(open_):
                rest = np.setdiff1d(self.members_of(open_.tolist()), seen, assume_unique=True)
                if len(rest):
                    best.add(self.scores(rest, item), self.ids[rest])


def _search(items: Items, k: int, least: list[int], probe: bool):
    """Shards to the best documents of each item: item (number), item_id, doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in items.terms]
        for b in batches:
            for row in range(len(b)):
                shard = _Shard(b, row, items)
                for q, item in enumerate(items.terms):
                    if len(item):
                        shard.search(item, best[q], least[q], probe)
        rows = [(q, items.ids[q], d, int(s)) for q, x in enumerate(best) for s, d in zip(x.score, x.id) if s >= least[q]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["item", "item_id", "doc_id", "score"])
        give_back()

    return run


FOUND = "item int, item_id long, doc_id long, score long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_chunk(docs: DataFrame, chunk: list, k: int, shard: int, least_block: int) -> DataFrame:
    vocabulary: dict[bytes, int] = {}
    own = [sorted({vocabulary.setdefault(t, len(vocabulary)) for piece in term_lists((r["text"] or "").encode("utf-8", "replace")) for t in piece}) for r in chunk]
    items = Items([r["item_id"] for r in chunk], [np.array(x, np.int64) for x in own], len(vocabulary))
    postings = materialize(map_texts(docs, _postings(vocabulary), "doc_id long, n long, terms array<int>, counts array<long>").filter("n > 0"), "postings")
    n_docs, n_all = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for t, c in postings.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[t] = c
    items.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for c in df.tolist()], np.int64)
    shards = materialize(postings.filter(F.size("terms") > 0).mapInArrow(_index(items, n_docs, max(1, n_all), shard, least_block), SHARDS), "shards")
    probed = _ranked(shards.mapInArrow(_search(items, k, [0] * len(chunk), True), FOUND), k).filter(F.col("rank") == k)
    least = [0] * len(chunk)
    for r in probed.select("item", "score").collect():  # one number for an item of the chunk
        least[r["item"]] = r["score"]
    return _ranked(shards.mapInArrow(_search(items, k, least, False), FOUND), k).select("item_id", "rank", "doc_id", "score")


def search(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = K, shard: int = SHARD, least_block: int = LEAST_BLOCK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text"))
    wanted = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    out = None
    for c in range(chunks):
        chunk = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c).collect()  # about chunk_bytes
        found = _search_chunk(docs, chunk, k, shard, least_block)
        out = found if out is None else out.unionByName(found)
    return out


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts FROM benchmark),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_all FROM d WHERE len(ts) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t, n_docs),
s AS (SELECT r, t, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ts) * n_docs) // n_all)) AS part FROM p JOIN d USING (r), c),
g AS (
  SELECT q, item_id, r, CAST(sum(w * part) AS BIGINT) AS score
  FROM (SELECT q, item_id, unnest(ts) AS t FROM i) JOIN w USING (t) JOIN s USING (t) GROUP BY q, item_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM g JOIN d USING (r) WHERE score > 0 QUALIFY rank <= 10
"""
