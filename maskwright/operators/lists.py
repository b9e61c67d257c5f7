"""Allow and block lists applied to hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.spans import kept_runs
from maskwright.operators.detect import MAX_TERMS, scan_block_list, with_terms


def split_by_allow_list(text: Column, terms: Column) -> Column:
    """What allow-listed terms leave of a text: spans with their texts."""
    return kept_runs(text, terms)


def with_own_terms(hits: DataFrame, terms: DataFrame) -> tuple[DataFrame, Column]:
    """Hits and, as a column, the terms to hold them against: an array literal for a list of at most MAX_TERMS, else those that the hit's
    text contains, found in the distinct texts."""
    own = terms.select("term").filter(F.trim("term") != "").distinct()
    words = [r["term"] for r in own.limit(MAX_TERMS + 1).collect()]
    if len(words) <= MAX_TERMS:
        return hits, F.array(*map(F.lit, sorted(words)))
    held = with_terms(hits.select("text").distinct(), own, ["text"]).groupBy(F.col("text").alias("_text")).agg(F.array_sort(F.collect_list("term")).alias("_terms"))
    return hits.join(held, F.col("text") == F.col("_text"), "left").drop("_text"), F.coalesce("_terms", F.array().cast("array<string>"))


def apply_allow_list(hits: DataFrame, terms: DataFrame | Column, trim_only: bool | None = True) -> DataFrame:
    """Hits after the allow list. Manual hits stay as they are; so do hits without a term in them.

    Otherwise the hit goes (``trim_only`` false) or is cut into a hit for each run that the terms leave (true, or no boolean).
    With an empty list nothing changes; with one, hits of no length go.
    """
    if isinstance(terms, DataFrame):
        if terms.filter(F.trim("term") != "").isEmpty():
            return hits
        hits, terms = with_own_terms(hits, terms)
    manual, inside = F.col("source") == "manual", F.exists(terms, lambda t: F.contains("text", t))
    span = "array<struct<start:int,end:int,text:string>>"
    none, same = F.array().cast(span), F.array(F.struct(F.lit(0).alias("start"), (F.col("end") - F.col("start")).alias("end"), F.col("text").alias("text"))).cast(span)
    cut = kept_runs(F.col("text"), terms) if trim_only is not False else none
    runs = F.when(manual, same).when(F.length("text") == 0, none).when(inside, cut).otherwise(same)
    out = hits.withColumn("_run", F.explode(runs))
    return out.withColumns({"end": F.col("start") + F.col("_run.end"), "start": F.col("start") + F.col("_run.start"), "text": F.col("_run.text")}).drop("_run", "_terms")


def list_pipeline(hits: DataFrame, blocks: DataFrame, allow: DataFrame, block: DataFrame, trim_only: bool | None = True) -> DataFrame:
    """Allow list, block list, allow list again: an allow-listed term wins over the same block-listed one.

    Filtering what was filtered changes nothing, so one pass after the union does both.
    """
    return apply_allow_list(hits.unionByName(scan_block_list(blocks, block)), allow, trim_only)
