"""Mixing sources to target weights over fixed-length blocks.

The words of each source form one stream, which is cut into blocks of ``block_words``. Targets follow the weights, but stop
at ``max_repeat`` times a source's size; what is above is shared anew. Each output shard draws its source counts from a
multinomial distribution (seeded by the shard, so any task can draw it again); running sums over the shards turn them into
slots 0, 1, 2, ... of each source, a pseudorandom permutation of the source's block indices (one for each pass) maps slots to
blocks, and blocks are joined to documents by index. As independent draws scatter around the target, the last shard settles:
slots beyond a source's number are given up and missing ones are added there, so every source ends at its target to within
half a block, and no block is taken more than ``max_repeat`` times.

Streams need running sums over all documents of a source. They are made within hash buckets of about sqrt(rows) documents
and then over the buckets, so no source's documents are ever in one task; its slots are dealt to tasks by shard. Sources are a
table (their number is not bounded): targets come from a few aggregates over it, and a shard draws first how many slots each
group of ``GROUP`` sources gets and then, by a join, each source of the group. Only one number for each group is on the driver.

Defined results: null text has size 0 and is never taken; a null source is a source of its own and comes last; documents of
one id are ordered by size; repeated rows take part each; without words every target is 0; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import map_texts, materialize, n_words, text_of, word_spans

WEIGHTS, MAX_REPEAT, BLOCK_WORDS, SEED, GROUP = (5, 2, 1), 3, 128, 7, 4096
#: Slots that a task makes at least, and at once.
TASK_SLOTS = 1 << 16


def _hash(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Place of each index in a pseudorandom permutation of 0..n-1: four Feistel rounds, walked on while outside."""
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    low = np.uint64((1 << half) - 1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        a, b = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(4):
            a, b = b, a ^ (_hash(b, key * 4 + r) & low)
        out[todo] = (a << np.uint64(half)) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", payload: tuple[str, ...] = ()) -> DataFrame:
    """The documents' ids, sources and sizes (and payload columns under ``p_<name>``), written once with a row number that stays."""
    read = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(text_of(text_col)).alias("size"),
        *(F.col(c).alias(f"p_{c}") for c in payload),
    )
    return materialize(read, "sized")


def _level(table: DataFrame, weight: Column, max_repeat: int) -> tuple[float, float]:
    """Words and weights that are left to the sources that do not stop at their bound: each of these has words * weight / weights.

    A round gives up those whose share is above their bound; shares of the others only grow by that, so rounds end.
    """
    words, weights = table.agg(F.sum("size").cast("double"), F.sum(weight)).first()
    total, before = words or 0.0, 0
    while True:
        above = F.lit(words or 0.0) * weight / F.lit(weights or 1) > max_repeat * F.col("size")
        n, stopped, left = table.agg(F.count_if(above), F.sum(F.when(above, max_repeat * F.col("size"))), F.sum(F.when(~above, weight))).first()
        if n == before:
            return words or 0.0, weights or 1
        before, words, weights = n, total - float(stopped or 0), left


def sources_of(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The sources, written once: name, sid (place by code points, null last), source_size, target, blocks, slots."""
    named = docs.groupBy(F.col("source").alias("name")).agg(F.sum("size").alias("size")).withColumn("last", F.col("name").isNull())
    places = materialize(named.repartitionByRange("last", "name").sortWithinPartitions("last", "name").withColumn("at", F.monotonically_increasing_id()), "places")
    part = F.shiftright("at", 33)
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    starts = places.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", before.alias("before"))
    table = materialize(places.join(F.broadcast(starts), part == F.col("part")).select("name", "size", (F.col("before") + F.col("at") - F.shiftleft("part", 33)).alias("sid")), "ranked")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights)).cast("int") + 1)
    words, all_ = _level(table, weight, max_repeat)
    share = F.lit(words) * weight / F.lit(all_)
    full = table.withColumn("target", F.when(share > max_repeat * F.col("size"), (max_repeat * F.col("size")).cast("double")).otherwise(share))
    passes = F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(max_repeat))).otherwise(0)
    sized_ = full.withColumns({"blocks": F.ceil(F.col("size") / block_words), "passes": passes})
    rest = F.when((F.col("passes") < max_repeat) & (F.col("size") > 0), F.least("blocks", F.round((F.col("target") - F.col("passes") * F.col("size")) / block_words).cast("long"))).otherwise(0)
    return materialize(sized_.select("name", "sid", F.col("size").alias("source_size"), "target", "blocks", (F.col("passes") * F.col("blocks") + rest).alias("slots")), "sources")


def _numbers(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with the number of their source, its size and its target."""
    return docs.join(sources.select("name", "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("name"))).drop("name")


def located(docs: DataFrame, n_rows: int) -> DataFrame:
    """Documents with the place of their first word in their source's stream (``at``): order is by bucket, id, size."""
    buckets = max(1, n_rows // max(500, int(n_rows**0.5)))
    dealt = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = dealt.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).withColumn("before", before).drop("n")
    return dealt.withColumn("inside", inside).join(totals, ["sid", "bucket"]).withColumn("at", F.col("before") + F.col("inside")).drop("bucket", "inside", "before")


def slots(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix: one row per slot with its output shard, source number, pass and block index."""
    spark = sources.sparkSession
    open_ = sources.filter("slots > 0").select("sid", "slots", "blocks", F.floor(F.col("sid") / GROUP).alias("grp"))
    groups = materialize(open_.groupBy("grp").agg(F.sum("slots").alias("all"), F.array_sort(F.collect_list(F.struct("sid", "slots"))).alias("own")), "groups")
    of_group = {r["grp"]: r["all"] for r in groups.select("grp", "all").collect()}
    names = np.array(sorted(of_group), np.int64)
    weights = np.array([of_group[k] for k in names.tolist()], np.int64)
    n = int(weights.sum())
    per_shard = max(4096, int(n**0.5))
    shards = math.ceil(n / per_shard)

    def draw_groups(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard in part["id"]:
                got = np.random.default_rng([seed, int(shard)]).multinomial(min(per_shard, n - int(shard) * per_shard), weights / n)
                on = np.flatnonzero(got)
                yield pd.DataFrame({"shard": np.full(len(on), shard), "grp": names[on], "n": got[on]})

    def draw_sources(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard, grp, count, own in part[["shard", "grp", "n", "own"]].itertuples(index=False):
                sid, wanted = np.array([x["sid"] for x in own], np.int64), np.array([x["slots"] for x in own], np.int64)
                got = np.random.default_rng([seed, int(shard), int(grp)]).multinomial(int(count), wanted / wanted.sum())
                on = np.flatnonzero(got)
                yield pd.DataFrame({"shard": np.full(len(on), shard), "sid": sid[on], "n": got[on]})

    # Written between the draws: a task that runs two Python functions needs two workers, and an executor keeps them.
    of_groups = materialize(spark.range(shards, numPartitions=max(1, min(shards // 16, 1024))).mapInPandas(draw_groups, "shard long, grp long, n long"), "drawn_groups")
    drawn = materialize(of_groups.join(groups.select("grp", "own"), "grp").mapInPandas(draw_sources, "shard long, sid long, n long"), "drawn")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = drawn.withColumn("first", before)
    had = F.least("slots", F.coalesce("drawn", F.lit(0)))
    settled = open_.join(drawn.groupBy("sid").agg(F.sum("n").alias("drawn")), "sid", "left").select(F.lit(shards).cast("long").alias("shard"), "sid", (F.col("slots") - had).alias("n"), had.alias("first"))
    every = runs.unionByName(settled).filter("n > 0").join(open_.select("sid", "slots", "blocks"), "sid")

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard, sid, first, last, blocks in part[["shard", "sid", "first", "last", "blocks"]].itertuples(index=False):
                for begin in range(first, last, TASK_SLOTS):
                    k = np.arange(begin, min(begin + TASK_SLOTS, last))
                    turn, index = k // blocks, k % blocks
                    block = np.empty(len(k), np.int64)
                    for t in np.unique(turn):
                        block[turn == t] = permuted(index[turn == t], int(blocks), hash((seed, int(sid), int(t))))
                    yield pd.DataFrame({"shard": np.full(len(k), shard), "sid": np.full(len(k), sid), "turn": turn, "block": block})

    dealt = every.withColumn("last", F.least(F.col("first") + F.col("n"), "slots")).repartition(max(1, min(-(-n // TASK_SLOTS), 1 << 15)), "shard", "sid")
    return dealt.mapInPandas(fill, "shard long, sid long, turn long, block long")


def taken(docs: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The parts of documents that the mix takes: row, begin and end (words of the document), times."""
    n_rows = docs.count()
    at = located(_numbers(docs.select("row", "doc_id", "source", "size").filter("size > 0"), sources), n_rows)
    last = F.floor((F.col("at") + F.col("size") - 1) / block_words)
    parts = at.select("row", "sid", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block_words), last)).alias("block"))
    times = slots(sources, seed).groupBy("sid", "block").agg(F.count("*").alias("times"))
    begin = F.greatest(F.col("block") * block_words - F.col("at"), F.lit(0))
    end = F.least((F.col("block") + 1) * block_words - F.col("at"), F.col("size"))
    return parts.join(times.hint("merge"), ["sid", "block"]).select("row", begin.alias("begin"), end.alias("end"), "times")


def mix(df: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED, **cols) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    docs = sized(df, **cols)
    sources = sources_of(docs, block_words=block_words, weights=weights, max_repeat=max_repeat)
    words = taken(docs, sources, block_words, seed).groupBy("row").agg(F.sum((F.col("end") - F.col("begin")) * F.col("times")).alias("taken"))
    return _numbers(docs, sources).join(words, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(df: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", payload: tuple[str, ...] = ()) -> DataFrame:
    """The mixed corpus: for the first, second, ... time that words of a document are taken a row with these words as its text.

    Columns: doc_id, source, times (from 1), text and ``p_<name>`` for the payload. A document taken whole keeps its text as it is.
    """
    docs = sized(df, id_col, text_col, source_col, payload=tuple(dict.fromkeys((text_col, *payload))))
    sources = sources_of(docs, block_words=block_words, weights=weights, max_repeat=max_repeat)
    parts = taken(docs, sources, block_words, seed).groupBy("row").agg(F.collect_list(F.struct("begin", "end", "times")).alias("parts"))
    whole = docs.select("row", "doc_id", "source", "size", F.col(f"p_{text_col}").alias("text"), *(F.col(f"p_{c}").alias(f"q_{c}") for c in payload))
    joined = whole.join(parts, "row").drop("row")
    names = [c for c in joined.columns if c not in ("parts", "size")]
    schema = T.StructType([joined.schema[c] for c in names] + [T.StructField("times", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts, times = [], [], []
            for k, (text, size, ps) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "size", "parts")))):
                for t in range(1, max(p["times"] for p in ps) + 1):
                    spans = sorted((p["begin"], p["end"]) for p in ps if p["times"] >= t)
                    at.append(k)
                    times.append(t)
                    texts.append(text if sum(j - i for i, j in spans) == size else _cut(text, spans))
            same = b.take(pa.array(at, pa.int64()))
            columns = [pa.array(texts, pa.string()) if c == "text" else same.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(times, pa.int32())], [*names, "times"])

    out = map_texts(joined, run, schema)
    return out.select("doc_id", "source", "times", "text", *(F.col(f"q_{c}").alias(f"p_{c}") for c in payload))


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The words begin..end of each span as they stand in the text; neighbours run on, others are parted by a line feed."""
    at = word_spans(text)
    merged: list[list[int]] = []
    for i, j in spans:
        if merged and merged[-1][1] == i:
            merged[-1][1] = j
        else:
            merged.append([i, j])
    return "\n".join(text[at[i][0] : at[j - 1][1]] for i, j in merged)
