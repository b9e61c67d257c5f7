"""Identity of hits and reviewers' decisions on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.operators.rules import SOURCES

ACTIONS, SCOPES = ("ignore", "confirm"), ("session", "permanent")
MAX_AGE_DAYS = 30


def doc_fingerprint(path: Column, size: Column, mtime_ns: Column) -> Column:
    """Eight hexadecimal digits for a file; null for an empty path."""
    return F.when(path != "", F.substring(F.sha1(F.concat_ws("\n", path, size.cast("string"), mtime_ns.cast("string"))), 1, 8))


def with_hit_id(hits: DataFrame, doc_hash: str = "doc_hash") -> DataFrame:
    """Hits with hit_id: document, location, start, end and source. A box gives its whole left and right edge, a hit without places 0."""
    start, end = F.lit(None).cast("int"), F.lit(None).cast("int")
    if "rect" in hits.columns:
        start, end = F.col("rect.x").cast("int"), (F.col("rect.x") + F.col("rect.w")).cast("int")
    own = lambda c: F.col(c) if c in hits.columns else F.lit(None).cast("int")
    start, end = F.coalesce(start, own("start"), F.lit(0)), F.coalesce(end, own("end"), F.lit(0))
    return hits.withColumn("hit_id", F.concat_ws("|", F.col(doc_hash).cast("string"), "location", start.cast("string"), end.cast("string"), "source"))


def parse_hit_id(df: DataFrame, col: str = "hit_id") -> DataFrame:
    """The five fields of an id and ``ok``; malformed ids have null fields."""
    parts = F.split(F.col(col), r"\|")
    whole = lambda k: F.get(parts, k).try_cast("int")
    ok = (F.size(parts) == 5) & whole(2).isNotNull() & whole(3).isNotNull() & F.get(parts, 4).isin(*SOURCES) & (F.get(parts, 0) != "")
    ok = F.coalesce(ok, F.lit(False))
    fields = {"doc_hash": F.get(parts, 0), "location": F.get(parts, 1), "start": whole(2), "end": whole(3), "source": F.get(parts, 4)}
    return df.select(*df.columns, ok.alias("ok"), *(F.when(ok, c).alias(n) for n, c in fields.items()))


def fold_overrides(events: DataFrame) -> DataFrame:
    """Current decisions from the log (hit_id, seq, op, scope, ts): hit_id, action, scope, promoted_at.

    ignore and confirm overwrite action and scope; promote makes what is there permanent at its time, unless it is that already;
    revert deletes. One shuffle by hit_id: the last revert cuts off what came before, the rest are aggregates.
    """
    write, key = F.col("op").isin(*ACTIONS), Window.partitionBy("hit_id")
    log = events.withColumn("_cut", F.max(F.when(F.col("op") == "revert", F.col("seq"))).over(key)).filter("_cut is null or seq > _cut")
    log = log.withColumn("_write", F.max(F.when(write, F.col("seq"))).over(key)).filter(F.col("_write").isNotNull())
    last = log.groupBy("hit_id").agg(
        F.max_by(F.when(write, F.struct(F.col("op").alias("action"), "scope")), F.when(write, F.col("seq"))).alias("w"),
        F.max_by(F.when(write, F.col("ts")), F.when(write, F.col("seq"))).alias("written"),
        F.min_by("ts", F.when((F.col("op") == "promote") & (F.col("seq") > F.col("_write")), F.col("seq"))).alias("p"),
    )
    permanent = F.col("w.scope") == "permanent"
    return last.select("hit_id", "w.action", F.when(F.col("p").isNotNull(), F.lit("permanent")).otherwise(F.col("w.scope")).alias("scope"), F.when(permanent, F.col("written")).otherwise(F.col("p")).alias("promoted_at"))


def fold_delta(snapshot: DataFrame, events: DataFrame, after: int) -> DataFrame:
    """Current decisions from those at event ``after`` (what ``fold_overrides`` gave for the log up to it) and the log behind it.

    A decision of the snapshot stands for the write that made it, so the fold over both is that of the whole log; only events with a
    greater ``seq`` are read (a filter that Parquet takes).
    """
    held = snapshot.select("hit_id", F.lit(after).cast("long").alias("seq"), F.col("action").alias("op"), "scope", F.col("promoted_at").alias("ts"))
    return fold_overrides(held.unionByName(events.filter(F.col("seq") > after).select("hit_id", F.col("seq").cast("long").alias("seq"), "op", "scope", "ts")))


def filter_overridden(hits: DataFrame, overrides: DataFrame, enabled: bool = True) -> DataFrame:
    """Hits without those whose decision is ignore. Manual hits and hits without an id stay."""
    if not enabled:
        return hits
    ignored = overrides.filter("action = 'ignore'").select(F.col("hit_id").alias("_id"))
    return hits.join(ignored, (F.col("hit_id") == F.col("_id")) & (F.col("source") != "manual"), "left_anti")


def annotate_hits(hits: DataFrame, overrides: DataFrame) -> DataFrame:
    """Hits with ``confirmed``."""
    marks = overrides.select("hit_id", (F.col("action") == "confirm").alias("confirmed"))
    return hits.join(marks, "hit_id", "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))


def prune_stale(overrides: DataFrame, today: Column, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Decisions whose promotion is at most so many days old, or has no readable time."""
    at = F.try_to_timestamp(F.col("promoted_at").cast("string"))
    return overrides.filter(at.isNull() | (at >= F.date_sub(today, max_age_days)))


def _restorable() -> Column:
    ok = F.col("action").isin(*ACTIONS) & F.col("scope").isin(*SCOPES) & F.col("source").isin(*SOURCES) & (F.col("end") >= F.col("start"))
    ok = ok & (F.coalesce("doc_hash", F.lit("")) != "") & F.col("location").isNotNull() & ((F.col("scope") == "session") | F.col("promoted_at").isNotNull())
    return F.coalesce(ok, F.lit(False))


def restore_overrides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are whole decisions, and the others: fields present, known values, a permanent one with its time."""
    return rows.filter(_restorable()), rows.filter(~_restorable())


def dump_overrides(overrides: DataFrame) -> DataFrame:
    return overrides.filter("scope = 'permanent'")


def load_overrides(current: DataFrame, rows: DataFrame, order: str = "ord") -> DataFrame:
    """Upsert by hit_id: the last good row of an id replaces what is there."""
    good = restore_overrides(rows)[0]
    last = good.withColumn("_n", F.row_number().over(Window.partitionBy("hit_id").orderBy(F.desc(order)))).filter("_n = 1").select(current.columns)
    return current.join(last, "hit_id", "left_anti").unionByName(last)


def replace_overrides(current: DataFrame, rows: DataFrame, order: str = "ord") -> DataFrame:
    """The permanent layer replaced as a whole by the good permanent rows."""
    return load_overrides(current.filter("scope <> 'permanent'"), rows.filter("scope = 'permanent'"), order)


def override_summary(overrides: DataFrame) -> DataFrame:
    n = lambda cond: F.count_if(F.expr(cond))
    return overrides.agg(n("action = 'ignore'").alias("ignored"), n("action = 'ignore' and scope = 'permanent'").alias("ignored_permanent"), n("action = 'confirm'").alias("confirmed"), n("action = 'confirm' and scope = 'permanent'").alias("confirmed_permanent"))
