"""A stream of hits under lists that change: each micro-batch goes by the lists of its time, and a change reaches what came before it.

Lists are one table with a row for each stretch of versions in which an entry holds: kind (``allow``: a term; ``ignore``: a hit_id),
value, valid_from, valid_to (the first version in which it no longer holds; null: it still does).

Hits are stored as they come. The result has one row for each hit and each time it was decided on: hit_id, version, runs (what is left of it; none
if it goes). If a batch finds a new version, earlier hits that a changed term stands in, or whose decision changed, are decided on again with it.
The stores take each batch once by run and batch id, so a batch that is delivered again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from maskwright.operators import detect, lists, overrides
from maskwright.sources import sink

RUNS = "array<struct<start:int,end:int,text:string>>"
RESULT = f"hit_id string, version long, runs {RUNS}"


def as_of(entries: DataFrame, version: int) -> DataFrame:
    """Entries (kind, value) that hold in a version."""
    return entries.filter((F.col("valid_from") <= version) & (F.col("valid_to").isNull() | (F.col("valid_to") > version))).select("kind", "value").distinct()


def changed(entries: DataFrame, before: int, after: int) -> DataFrame:
    """Entries that hold in one of two versions only."""
    a, b = as_of(entries, before), as_of(entries, after)
    return a.join(b, ["kind", "value"], "left_anti").unionByName(b.join(a, ["kind", "value"], "left_anti"))


def decide(hits: DataFrame, entries: DataFrame, version: int, trim_only: bool = True) -> DataFrame:
    """What is left of each hit under a version's lists: hit_id, version, runs. Hits: hit_id, start, end, text, source."""
    now = as_of(entries, version)
    terms = now.filter("kind = 'allow'").select(F.col("value").alias("term"))
    ignored = now.filter("kind = 'ignore'").select(F.col("value").alias("hit_id"), F.lit("ignore").alias("action"))
    left = lists.apply_allow_list(overrides.filter_overridden(hits, ignored), terms, trim_only)
    runs = left.groupBy("hit_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).cast(RUNS).alias("runs"))
    return hits.select("hit_id").join(runs, "hit_id", "left").select("hit_id", F.lit(version).cast("long").alias("version"), F.coalesce("runs", F.array().cast(RUNS)).alias("runs"))


def touched(hits: DataFrame, entries: DataFrame, before: int, after: int) -> DataFrame:
    """Hits that a change of the lists can bear on."""
    new = changed(entries, before, after)
    terms = new.filter("kind = 'allow'").select(F.col("value").alias("term"))
    held = detect.with_terms(hits, terms.filter("term <> ''").distinct(), ["hit_id"]).select("hit_id")
    ids = held.unionByName(new.filter("kind = 'ignore'").select(F.col("value").alias("hit_id"))).distinct()
    return hits.join(ids, "hit_id", "left_semi")


def stream_versioned(hits: DataFrame, read_lists: Callable[[int], tuple[DataFrame, int]], home: str, run_id: str, checkpoint: str, trim_only: bool = True) -> StreamingQuery:
    """Run a stream of hits (hit_id, start, end, text, source) to its end. ``read_lists`` is asked for the table and its version at each batch."""
    schema = hits.schema

    def step(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        entries, version = read_lists(k)
        stored = sink.read_committed(spark, f"{home}/hits", schema)  # what came before this batch
        last = sink.read_committed(spark, f"{home}/result", StructType.fromDDL(RESULT)).agg(F.max("version")).first()[0]
        out = decide(batch, entries, version, trim_only)
        if last is not None and last != version:
            earlier = stored.join(batch.select("hit_id"), "hit_id", "left_anti")
            out = out.unionByName(decide(touched(earlier, entries, last, version), entries, version, trim_only))
        sink.write_once(out, f"{home}/result", run_id, k)
        sink.write_once(batch, f"{home}/hits", run_id, k)

    return hits.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(results: DataFrame) -> DataFrame:
    """What is left of each hit under the last version that it was decided under: hit_id, start, end, text."""
    last = results.groupBy("hit_id").agg(F.max_by("runs", "version").alias("runs"))
    return last.select("hit_id", F.explode("runs").alias("r")).select("hit_id", "r.start", "r.end", "r.text")
