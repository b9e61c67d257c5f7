"""Counts and summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.sources.shared import own_dir

NO_HIT = "no hit this run"
def status_rank() -> Column:
    return F.when(F.col("status") == "failed", 0).otherwise(1)



def scan_meta(blocks: DataFrame, processed: str = "processed") -> DataFrame:
    """For each document: blocks processed, blocks in all, and whether it was broken off."""
    done, total = F.count_if(F.col(processed)), F.count("*")
    return blocks.groupBy("doc_id").agg(done.alias("processed_items"), total.alias("total_items"), (done < total).alias("cancelled"))


def rule_counts(plans: DataFrame) -> DataFrame:
    """Replacements by document and rule."""
    return plans.select("doc_id", F.explode("plan").alias("p")).groupBy("doc_id", F.col("p.rule_ord").alias("rule_index")).agg(F.count("*").alias("count"))


def rule_totals(counts: DataFrame) -> DataFrame:
    """Counts by rule and document with the totals of each rule and of all (null)."""
    return counts.rollup("rule_index", "doc_id").agg(F.sum("count").alias("count"))


def rule_summary(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """For each rule its documents with counts, or that it had no hit. The list of a rule is as long as the documents it hit."""
    lists = counts.groupBy("rule_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "count"))), lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["count"].cast("string"))), ", ").alias("docs"))
    return rules.select("rule_index", "find").join(lists, "rule_index", "left").withColumn("docs", F.coalesce("docs", F.lit(NO_HIT)))


def rule_chunks(rules: DataFrame, counts: DataFrame, most: int = 10_000) -> DataFrame:
    """For each rule its documents with counts in chunks of at most ``most`` in order of doc_id: rule_index, find, chunk (from 0), n_docs, docs; a rule without hits has one chunk.

    Documents are put in order by a range exchange, so a rule that hits much of a corpus is in no single task; a document's number is its place in its
    range plus the sizes of the ranges before. The counts are written in the shared folder once.
    """
    order = ["rule_index", "doc_id"]
    home = own_dir(counts.sparkSession, "counts")
    dealt = counts.groupBy(*order).agg(F.sum("count").alias("count")).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_place", 33)).write.parquet(home)
    placed = counts.sparkSession.read.parquet(home)
    sizes = placed.groupBy("rule_index", "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("rule_index").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("rule_index", "_part", (before - F.col("_first")).alias("_shift"))
    own = placed.join(shift, ["rule_index", "_part"]).withColumn("chunk", F.floor((F.col("_place") + F.col("_shift")) / most).cast("long"))
    row = F.struct("doc_id", "count")
    docs = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["count"].cast("string"))), ", ")
    lists = own.groupBy("rule_index", "chunk").agg(F.count("*").alias("n_docs"), docs.alias("docs"))
    filled = rules.select("rule_index", "find").join(lists, "rule_index", "left")
    return filled.select("rule_index", "find", F.coalesce("chunk", F.lit(0).cast("long")).alias("chunk"), F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"), F.coalesce("docs", F.lit(NO_HIT)).alias("docs"))


def batch_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failed").alias("failed"))


def order_results(results: DataFrame) -> DataFrame:
    """Failed ones first, then by input order."""
    return results.orderBy(status_rank(), "ord")


def filter_results(results: DataFrame, status: str = "all") -> DataFrame:
    return results if status == "all" else results.filter(F.col("status") == status)


def retry_set(manifest: DataFrame, results: DataFrame) -> DataFrame:
    return manifest.join(results.filter("status = 'failed'").select("doc_id"), "doc_id", "left_semi")


def hit_profile(hits: DataFrame) -> DataFrame:
    """Hits, distinct texts and documents by source and rule, with all subtotals (null: all)."""
    return hits.cube("source", "rule_name").agg(F.count("*").alias("hits"), F.count_distinct("text").alias("texts"), F.count_distinct("doc_id").alias("docs"))
