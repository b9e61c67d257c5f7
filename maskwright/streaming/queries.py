"""Registered streaming queries: each runs its job over a table as a stream until it is read up, and returns what the sink holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskwright.operators import overrides
from maskwright.plans import queries as batch
from maskwright.sources import sink
from maskwright.sources.corpus import blocks_from_text
from maskwright.sources.shared import own_dir
from maskwright.streaming import jobs, versions


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream: its file, or the files of its folder."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if path_is_file(spark, path) else spark.readStream.schema(schema).parquet(path)


def path_is_file(spark: SparkSession, path: str) -> bool:
    """Asked of Spark's own reader, so that it holds for any store: a file is listed under its own name."""
    first = spark.read.parquet(path).select("_metadata.file_path").first()
    return first is None or first[0].rstrip("/").endswith(path.rsplit("/", 1)[-1])


def run(df: DataFrame, mode: str) -> DataFrame:
    """Run a streaming frame to its end, each micro-batch written to a folder of its own, and read all of them with the batch's number."""
    spark, home = df.sparkSession, own_dir(df.sparkSession, "stream")
    schema = df.schema
    job = df.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True)
    job.foreachBatch(lambda rows, k: rows.withColumn("batch", F.lit(k).cast("long")).write.mode("overwrite").parquet(f"{home}/out/part_{k}")).start().awaitTermination()
    return spark.read.schema(schema.add("batch", "long")).option("recursiveFileLookup", True).parquet(f"{home}/out")


def s1_stream_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = blocks_from_text(stream_of(spark, sf_dir, "documents"))
    return run(jobs.stream_redact(blocks, batch.PII).select("doc_id", "location", "redacted"), "append").drop("batch")


def s1_replayed_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream is run twice under one run id, the second time from the start, as after a lost checkpoint: the sink holds each row once."""
    home = own_dir(spark, "stream")
    rows = jobs.stream_redact(blocks_from_text(stream_of(spark, sf_dir, "documents")), batch.PII).select("doc_id", "location", "redacted")
    for k in range(2):
        jobs.stream_to_sink(rows, f"{home}/sink", "run", f"{home}/checkpoint-{k}").awaitTermination()
    return sink.read_committed(spark, f"{home}/sink", rows.schema)


def s2_stream_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = batch.decision_log(stream_of(spark, sf_dir, "events"))
    out = run(jobs.stream_overrides(log), "update")
    last = out.groupBy("hit_id").agg(F.max_by(F.struct("action", "scope", "promoted_at", "deleted"), "batch").alias("x")).filter("not x.deleted")
    return last.select("hit_id", "x.action", "x.scope", "x.promoted_at")


def s3_stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = own_dir(spark, "stream")
    blocks = blocks_from_text(stream_of(spark, sf_dir, "documents"))
    hits = overrides.with_hit_id(batch.detect.find_spans(blocks, batch.PII), "doc_id").select("doc_id", "location", "start", "source", "hit_id")
    write = lambda rows, k: rows.drop("hit_id").write.mode("overwrite").parquet(f"{out}/part_{k}")
    schema = hits.drop("hit_id").schema
    jobs.stream_filter(hits, lambda: {"overrides": batch.decisions(spark, sf_dir)}, overrides.filter_overridden, write, f"{out}-checkpoint").awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out).select("doc_id", "location", "start")


def s3_versioned_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in two batches, with a change between them: one allowed term ends and another begins, as do reviewers' decisions. The result
    is that of the second version for the hits of both batches."""
    home = own_dir(spark, "stream")
    found = overrides.with_hit_id(batch.detect.find_spans(batch.blocks(spark, sf_dir), batch.PII), "doc_id").select("doc_id", "hit_id", "start", "end", "text", "source")
    found.write.parquet(f"{home}/found")
    hits = spark.read.schema(found.schema).parquet(f"{home}/found")
    for k in range(2):
        hits.filter(F.pmod(F.xxhash64("hit_id"), F.lit(2)) == k).write.parquet(f"{home}/in/part_{k}")
    files = len(spark.read.parquet(f"{home}/in/part_0").inputFiles())  # as many as the first batch takes, which leaves some to a second one
    decided = lambda n, since, until: hits.filter(F.col("doc_id") % n == 0).select(F.lit("ignore").alias("kind"), F.col("hit_id").alias("value"), F.lit(since).alias("valid_from"), F.lit(until).alias("valid_to"))
    terms = spark.createDataFrame([("allow", "44", 0, 1), ("allow", "mail", 1, None), ("allow", "17", 0, None)], "kind string, value string, valid_from int, valid_to int")
    entries = terms.unionByName(decided(3, 1, None)).unionByName(decided(5, 0, 1))
    source = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(f"{home}/in")
    versions.stream_versioned(source.drop("doc_id"), lambda k: (entries, min(k, 1)), home, "run", f"{home}/checkpoint", trim_only=False).awaitTermination()
    left = versions.latest(sink.read_committed(spark, f"{home}/result", StructType.fromDDL(versions.RESULT)))
    return left.select(F.split("hit_id", "[|]")[0].cast("long").alias("doc_id"), F.split("hit_id", "[|]")[1].alias("location"), "start", "text")


def s4_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = stream_of(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("rule_name"))
    out = run(jobs.stream_counts(hits, width="1 day", late="2 days"), "update")
    return out.groupBy("window_start", "rule_name").agg(F.max_by("hits", "batch").alias("hits"))


def s5_stream_dedupe_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = stream_of(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("|", "user_id", "event_type").alias("hit_id"))
    return run(jobs.stream_dedupe_hits(hits, late="365 days").select("hit_id"), "append").drop("batch")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (s1_stream_redact, s1_replayed_sink, s2_stream_overrides, s3_stream_filter, s3_versioned_lists, s4_stream_counts, s5_stream_dedupe_hits)}
ORACLE_SQL: dict[str, str] = {
    "s1_stream_redact": batch.ORACLE_SQL["f3_render_redacted"],
    "s1_replayed_sink": batch.ORACLE_SQL["f3_render_redacted"],
    "s2_stream_overrides": batch.ORACLE_SQL["d7_fold_overrides"],
    "s3_stream_filter": batch.ORACLE_SQL["d6_filter_overridden"],
    "s3_versioned_lists": batch.HITS + " SELECT doc_id, location, start, text FROM h WHERE NOT contains(text, 'mail') AND NOT contains(text, '17') AND doc_id % 3 <> 0",
    "s4_stream_counts": "SELECT date_trunc('day', ts) AS window_start, event_type AS rule_name, CAST(count(*) AS BIGINT) AS hits FROM events GROUP BY 1, 2",
    "s5_stream_dedupe_hits": "SELECT DISTINCT user_id || '|' || event_type AS hit_id FROM events",
}
