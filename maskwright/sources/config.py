"""Rules from configuration, and hits made elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.operators.rules import validate_hits

REPLACE_SET = "struct<version:int,rules:array<struct<enabled:boolean,mode:string,find:string,replace:string>>>"
VERSION = 1


def rules_from_config(df: DataFrame, json_col: str = "config", enabled_only: bool = False, payload: tuple[str, ...] = ()) -> DataFrame:
    """Rules of a JSON object {name: {pattern, enabled, description}}: payload, rule_ord, rule_name, pattern, enabled, description.

    A legacy rule, whose value is the pattern itself, is read as enabled; with ``enabled_only`` it is left out, as are disabled
    ones. A missing ``enabled`` is true.
    """
    raw = F.from_json(F.col(json_col), F.lit("map<string,string>"))
    entries = df.select(*payload, F.posexplode(F.map_entries(raw)).alias("rule_ord", "e"))
    parsed = entries.withColumn("r", F.from_json(F.when(F.startswith(F.col("e.value"), F.lit("{")), F.col("e.value")), F.lit("struct<pattern:string,enabled:boolean,description:string>")))
    legacy = F.col("r").isNull()
    out = parsed.select(*payload, "rule_ord", F.col("e.key").alias("rule_name"), F.when(legacy, F.col("e.value")).otherwise(F.col("r.pattern")).alias("pattern"), F.coalesce("r.enabled", F.lit(True)).alias("enabled"), F.coalesce("r.description", F.lit("")).alias("description"), legacy.alias("legacy"))
    return out.filter("enabled and not legacy") if enabled_only else out


def overlay_rules(defaults: DataFrame, user: DataFrame, key: str = "rule_name") -> DataFrame:
    """The user's rules over the defaults, field by field."""
    fields = [c for c in defaults.columns if c != key]
    both = defaults.alias("d").join(user.alias("u"), key, "full")
    return both.select(key, *(F.coalesce(F.col(f"u.{c}"), F.col(f"d.{c}")).alias(c) for c in fields))


def export_replace_rules(rules: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """A versioned JSON text (column config) of ordered replace rules, one for each rule set that ``payload`` tells apart. The rules of a set are settings, few enough for one row."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rule_index", "enabled", "mode", "find", "replace"))), lambda r: F.struct(*(r[c].alias(c) for c in ("enabled", "mode", "find", "replace"))))
    return rules.groupBy(*payload).agg(F.to_json(F.struct(F.lit(VERSION).alias("version"), rows.alias("rules"))).alias("config"))


def import_replace_rules(df: DataFrame, json_col: str = "config", payload: tuple[str, ...] = ()) -> DataFrame:
    """Replace rules of a JSON text of the known version: payload, rule_index, enabled, mode, find, replace."""
    own = df.select(*payload, F.from_json(F.col(json_col), F.lit(REPLACE_SET)).alias("s")).filter(F.col("s.version") == VERSION)
    return own.select(*payload, F.posexplode("s.rules").alias("rule_index", "r")).select(*payload, "rule_index", "r.*")


def union_external_hits(hits: DataFrame, external: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits with those from elsewhere that are valid, and those that are not. Missing columns are null."""
    good, bad = validate_hits(external)
    return hits.unionByName(good, allowMissingColumns=True), bad


