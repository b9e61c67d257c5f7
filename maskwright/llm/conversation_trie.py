"""Prefix trie of conversations by the Euler-tour technique.

Conversations that begin alike share their first turns in the trie: a node is a sequence of first turns, its members are the
conversations that start with it. A node that many share need be computed once only, which is what ``saved_tokens`` counts.

1. Turns are put in order by a range exchange, so a conversation that holds many rows is spread over tasks; a turn's number is
   its place in its range plus the sizes of the ranges before.
2. A node's key is a digest of its depth and of two sums of 64-bit hashes of its turns, each hashed with its place. Sums can be
   taken over stretches of 1,024 turns and added up, so no task holds a long conversation. Nodes come from partial aggregates.
3. Euler tour. Each node has an enter and an exit arc. Siblings are linked in buckets of about 4,096, and the buckets of a parent
   after each other, so no task holds all children of one node. The tour goes from a node's enter arc into its first child,
   or to its own exit arc, and from there to the next sibling or to the parent's exit arc.
4. List ranking by sparse ruling sets: about one arc of 64 is a ruler (by a hash of its number). All arcs jump over their
   successors, doubling their step, until they stand before a ruler; the rulers alone are a list 64 times shorter, which is
   ranked likewise. A list of at most ``bound`` (8,192) arcs is ranked in one task. Rounds are written in the shared folder.
5. Positions, leaves and savings are summed along the tour; what lies between a node's two arcs is its subtree.

``ends_sha256`` is the digest of one text for a node. Ids are sorted by range and joined to texts of at most 4,096 ids there; the digest then runs
over a node's texts in order, as a stream, so a node where a third of all conversations end is never held whole.

Defined results: turns with the same number are ordered by role and text (their first 256 characters, then a digest); repeated
rows are turns each; null roles and texts are empty; rows without conv_id belong to no conversation and take no part; an
empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import materialize, n_words, text_of
from maskwright.llm.components import joined

GROUP, HEADS = 20, 4
STRETCH, BUCKET, RULERS, BOUND, IDS = 1024, 4096, 64, 8192, 4096
SUMS = ("arcs", "leaves", "saved")
EMPTY = hashlib.sha256(b"").hexdigest()


def _rows_before(key: str) -> Window:
    return Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns with their number in their conversation: conv, at (from 0), a and b (hashes of role and text), words."""
    own = df.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text")).filter("conv is not null")
    short = lambda c: (F.substring(c, 1, 256).alias(f"{c}_1"), F.md5(F.col(c).cast("binary")).alias(f"{c}_2"))
    hashes = (F.xxhash64(F.lit(k), "role", "text").alias(c) for k, c in ((1, "a"), (2, "b")))
    drawn = own.select("conv", "turn", *short("role"), *short("text"), *hashes, n_words(F.col("text")).alias("words")).withColumn("draw", F.monotonically_increasing_id())
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), *(F.col(c) for c in ("role_1", "role_2", "text_1", "text_2", "draw"))]
    placed = drawn.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "a", "b", "words", F.monotonically_increasing_id().alias("place"))
    dealt = materialize(placed.withColumn("part", F.shiftright("place", 33)), "turns")
    ranges = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = ranges.select("conv", "part", (F.coalesce(F.sum("n").over(_rows_before("conv")), F.lit(0)) - F.col("first")).alias("shift"))
    return dealt.join(before, ["conv", "part"]).select("conv", (F.col("place") + F.col("shift")).alias("at"), "a", "b", "words")


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, size) and turns (conv, pos from 1, size, a, b, words) after each conversation's first turns are taken
    from the first one of its group: h = crc32(conv) % heads turns, then its own turns after its first h."""
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    own = sizes.withColumns({"h": F.crc32(F.col("conv").cast("string").cast("binary")) % heads, "base": F.col("conv") - F.col("conv") % group})
    known = own.join(base, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = materialize(known.select("conv", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "conversations")
    kept = joined(turns, convs.withColumnRenamed("conv", "c"), "conv", "c").filter("at >= h").select("conv", (F.col("at") - F.col("h") + F.col("k") + 1).alias("pos"), "size", "a", "b", "words")
    first = turns.filter(F.col("at") < heads - 1).withColumnRenamed("conv", "base")
    taken = first.join(convs.filter("k > 0"), "base").filter("at < k").select("conv", (F.col("at") + 1).alias("pos"), "size", "a", "b", "words")
    return convs, kept.unionByName(taken)


def _key(depth: Column, a: Column, b: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, a, b).cast("binary")))


def paths(turns: DataFrame) -> DataFrame:
    """The node that each turn leads to: conv, depth, size, words, key, parent_key."""
    wide = lambda c: F.xxhash64("pos", c).cast("decimal(20,0)")
    own = turns.withColumns({"x": wide("a"), "y": wide("b"), "part": F.floor((F.col("pos") - 1) / STRETCH).cast("long")}).drop("a", "b")
    totals = own.groupBy("conv", "part").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    before = totals.select("conv", "part", *(F.sum(c).over(_rows_before("conv")).cast("decimal(38,0)").alias(n) for c, n in (("sx", "bx"), ("sy", "by")))).filter("part > 0")
    inside = Window.partitionBy("conv", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = own.withColumns({"ix": F.sum("x").over(inside), "iy": F.sum("y").over(inside)}).join(before, ["conv", "part"], "left")
    whole = {t: (F.col(f"i{t}").cast("decimal(38,0)") + F.coalesce(f"b{t}", F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)") for t in "xy"}
    up = {t: (whole[t] - F.col(t)).cast("decimal(38,0)") for t in "xy"}
    return summed.select("conv", F.col("pos").alias("depth"), "size", "words", _key(F.col("pos"), whole["x"], whole["y"]).alias("key"), _key(F.col("pos") - 1, up["x"], up["y"]).alias("parent_key"))


def _root_key() -> Column:
    return _key(F.lit(0).cast("long"), *[F.lit(0).cast("decimal(38,0)")] * 2)


def _nodes(convs: DataFrame, path: DataFrame) -> DataFrame:
    """A row for each node: node (a number), key, parent_key, conv_id, depth, n_convs, words."""
    below = path.groupBy("key").agg(*(F.min(c).alias(n) for c, n in (("parent_key", "parent_key"), ("conv", "conv_id"), ("depth", "depth"))), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    top = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = top.select(_root_key().alias("key"), F.lit(None).cast("binary").alias("parent_key"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"))
    return materialize(below.unionByName(root).withColumn("node", F.monotonically_increasing_id()), "nodes")


def _tree(nodes: DataFrame) -> DataFrame:
    """Nodes with n_children, parent, parent_conv_id, first (child) and next (sibling)."""
    counted = nodes.join(nodes.filter("depth > 0").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children")), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    ups = counted.filter("n_children > 0").select(F.col("key").alias("u"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    held = materialize(joined(counted, ups, "parent_key", "u", "left").drop("u"), "tree")
    child = held.filter("depth > 0").select("node", "parent", F.pmod(F.xxhash64("node"), F.ceil(F.col("siblings") / BUCKET)).alias("bucket"))
    inside = Window.partitionBy("parent", "bucket").orderBy("node")
    linked = child.withColumns({"next": F.lead("node").over(inside), "no": F.row_number().over(inside)})
    heads = linked.filter("no = 1").select("parent", "bucket", F.col("node").alias("first"))
    after = heads.withColumn("then", F.lead("first").over(Window.partitionBy("parent").orderBy("bucket")))
    siblings = linked.join(after, ["parent", "bucket"]).select(F.col("node").alias("s"), F.coalesce("next", "then").alias("next"))
    first = heads.groupBy(F.col("parent").alias("f")).agg(F.min_by("first", "bucket").alias("first"))
    return materialize(held.join(siblings, F.col("node") == F.col("s"), "left").join(first, F.col("node") == F.col("f"), "left").drop("s", "f"), "linked")


def _arcs(tree: DataFrame) -> DataFrame:
    """The tour as a list: arc (even: enter, odd: exit), next, and what it adds to the sums."""
    enter, leave = F.col("node") * 2, F.col("node") * 2 + 1
    going = F.struct(enter.alias("arc"), F.coalesce(F.col("first") * 2, leave).alias("next"), F.lit(1).cast("long").alias("arcs"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    coming = F.struct(leave.alias("arc"), F.coalesce(F.col("next") * 2, F.col("parent") * 2 + 1).alias("next"), F.lit(1).cast("long").alias("arcs"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    return tree.select(F.explode(F.array(going, coming)).alias("x")).select("x.*")


def _rank_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums to the end of a list that one task holds, by doubling steps."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    arc, n = np.asarray(t.column("arc")), len(t)
    order = np.argsort(arc)
    there = t.column("next").is_valid().to_numpy(zero_copy_only=False)
    at = np.where(there, order[np.minimum(np.searchsorted(arc[order], t.column("next").fill_null(0).to_numpy()), n - 1)], n)
    at = np.append(at, n)
    sums = np.zeros((n + 1, len(SUMS)), np.int64)
    sums[:n] = np.stack([np.asarray(t.column(c)) for c in SUMS], axis=1)
    while (at[:n] < n).any():
        sums, at = sums + np.where((at < n)[:, None], sums[at], 0), at[at]
    yield pa.RecordBatch.from_arrays([pa.array(arc), *(pa.array(sums[:n, k]) for k in range(len(SUMS)))], ["arc", *SUMS])


def list_rank(arcs: DataFrame, bound: int = BOUND, rulers: int = RULERS, level: int = 0) -> DataFrame:
    """Of a list (arc, next, and the columns of SUMS; the last arc's next is null) the sums from each arc to the end: arc and SUMS."""
    arcs = materialize(arcs, "arcs")
    rules = lambda c: F.pmod(F.xxhash64(F.lit(level), c), F.lit(rulers)) == 0
    if arcs.count() <= bound:
        return arcs.repartition(1).mapInArrow(_rank_here, "arc long, " + ", ".join(f"{c} long" for c in SUMS))
    done = F.col("next").isNull() | rules("next")
    while (going := arcs.filter(~done)).limit(1).count():
        over = arcs.select(F.col("arc").alias("o"), F.col("next").alias("n"), *(F.col(c).alias(f"o_{c}") for c in SUMS))
        jumped = going.join(over, F.col("next") == F.col("o")).select("arc", F.col("n").alias("next"), *((F.col(c) + F.col(f"o_{c}")).alias(c) for c in SUMS))
        arcs = materialize(arcs.filter(done).unionByName(jumped), "arcs")
    ruling = list_rank(arcs.filter(rules("arc")), bound, rulers, level + 1)
    beyond = ruling.select(F.col("arc").alias("r"), *(F.col(c).alias(f"r_{c}") for c in SUMS))
    return arcs.join(beyond, F.col("next") == F.col("r"), "left").select("arc", *((F.col(c) + F.coalesce(f"r_{c}", F.lit(0))).alias(c) for c in SUMS))


def _texts_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv) as texts of at most IDS ids: key, low (first id), ids."""
    for b in batches:
        keys, convs = b.column(0).to_pylist(), b.column(1).to_pylist()
        cuts = [i for i in range(len(keys)) if i % IDS == 0 or keys[i] != keys[i - 1]] + [len(keys)]
        rows = [(keys[i], convs[i], ",".join(map(str, convs[i:j]))) for i, j in zip(cuts, cuts[1:])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.binary(), pa.int64(), pa.string()))], ["key", "low", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted texts of ids as one digest for each key; only the running state is held."""
    row = lambda key, state: pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array([s.hexdigest() for s in state])], ["k", "digest"])
    last, state = None, None
    for b in batches:
        keys, states = [], []
        for key, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if key == last:
                state.update(b"," + ids.encode())
            else:
                if state:
                    keys.append(last)
                    states.append(state)
                last, state = key, hashlib.sha256(ids.encode())
        if keys:
            yield row(keys, states)
    if state:
        yield row([last], [state])


def _ends(convs: DataFrame, path: DataFrame) -> DataFrame:
    """k, digest: of the ids of the conversations that end in a node."""
    last = path.filter("depth = size").select("key", "conv").unionByName(convs.filter("size = 0").select(_root_key().alias("key"), "conv"))
    chunks = last.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(_texts_of_ids, "key binary, low long, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "low").mapInArrow(_digests, "k binary, digest string")


def trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = GROUP, heads: int = HEADS, bound: int = BOUND) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, n_nodes (of its subtree)."""
    convs, turns = rebuilt(numbered(df, conv_col, turn_col, role_col, text_col), group, heads)
    path = materialize(paths(turns), "paths")
    tree = _tree(_nodes(convs, path))
    signed = lambda c: F.sum(F.when(F.col("arc") % 2 == 0, F.col(c)).otherwise(-F.col(c)))
    subtree = list_rank(_arcs(tree), bound).groupBy(F.floor(F.col("arc") / 2).alias("v")).agg(signed("arcs").alias("between"), signed("leaves").alias("n_leaves"), signed("saved").alias("saved_tokens"))
    out = tree.join(subtree, F.col("node") == F.col("v")).join(_ends(convs, path), F.col("key") == F.col("k"), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", F.lit(EMPTY)).alias("ends_sha256"), ((F.col("between") + 1) / 2).cast("long").alias("n_nodes"))


SQL = """
WITH RECURSIVE bits(i, k, v) AS (
  SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(coalesce(role, ''), 256), md5(coalesce(role, '')), left(coalesce(text, ''), 256), md5(coalesce(text, ''))) - 1 AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT c, c - c % 20 AS base, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a // 256, tab[xor(a, b) % 256 + 1])) AS r, count(*) AS n
  FROM t, crc GROUP BY c, tab),
h AS (SELECT c.c, c.base, xor(c.r, 4294967295) % 4 AS h, least(xor(c.r, 4294967295) % 4, coalesce(b.n, 0)) AS k FROM c LEFT JOIN c b ON b.c = c.base),
r AS (
  SELECT h.c, t.k + 1 AS d, role, text FROM h JOIN t ON t.c = h.base AND t.k < h.k
  UNION ALL SELECT h.c, t.k - h.h + h.k + 1, role, text FROM h JOIN t ON t.c = h.c AND t.k >= h.h),
p AS (
  SELECT c, d, text, list(struct_pack(role, text)) OVER (PARTITION BY c ORDER BY d) AS path FROM r
  UNION ALL SELECT c, 0, '', [] FROM h),
z AS (SELECT c, max(d) AS size FROM p GROUP BY c),
n AS (
  SELECT path, d, min(p.c) AS conv_id, count(*) AS n_convs, any_value(text) AS text, coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (WHERE d = size), '') AS ends
  FROM p JOIN z USING (c) GROUP BY path, d),
w AS (SELECT *, (n_convs - 1) * len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS own FROM n),
m AS (SELECT a.*, (SELECT count(*) FROM n b WHERE b.d = a.d + 1 AND b.path[:a.d] = a.path) AS kids FROM w a)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, max(u.conv_id) AS parent_conv_id, a.n_convs, a.kids AS n_children,
       count(*) FILTER (WHERE s.kids = 0) AS n_leaves, CAST(sum(s.own) AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256, count(*) AS n_nodes
FROM m a JOIN m s ON s.d >= a.d AND s.path[:a.d] = a.path LEFT JOIN n u ON u.d = a.d - 1 AND u.path = a.path[:a.d - 1]
GROUP BY a.path, a.d, a.conv_id, a.n_convs, a.kids, a.ends
"""
