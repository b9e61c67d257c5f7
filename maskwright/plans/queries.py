"""Registered queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.functions import spans
from maskwright.operators import detect, geometry, lists, names, overrides, report, resolve, rules
from maskwright.plans import pipelines
from maskwright.sources import config, corpus, sink
from maskwright.sources.shared import own_dir, stored

R = {r.rule_name: r for r in rules.DEFAULT_RULES}
EMAIL = R["电子邮箱"].pattern
PII = [R["银行卡号"], R["电子邮箱"]]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.blocks_from_text(t(spark, sf_dir, "documents"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("turn_"), "turn").alias("location"), "text")


# ---- pieces of SQL -------------------------------------------------------------------------------------------------

BLOCKS = """b AS (SELECT doc_id, 'paragraph_' || (unnest(range(1, len(ls) + 1)) - 1) AS location, CAST(unnest(range(1, len(ls) + 1)) - 1 AS INTEGER) AS block_no, unnest(ls) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""


def sql_spans(name: str, source: str, pattern: str, keep: str = "true", keys: str = "doc_id, location") -> str:
    """A CTE of a pattern's matches with their places; ``keep`` filters them by text m."""
    return f"""{name}0 AS (SELECT {keys}, text AS t, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs FROM {source} WHERE regexp_matches(text, '{pattern}')),
{name}1 AS (SELECT {keys}, t, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM {name}0),
{name} AS (SELECT {keys}, t, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start, ms[i] AS m FROM {name}1 WHERE {keep.replace("m.", "ms[i]")})"""


CARD_KEEP = "length(m.) BETWEEN 13 AND 19 AND m.[1] <> '0'"
ID_KEEP = "(length(m.) = 15 OR length(m.) = 18 AND regexp_full_match(m., '[1-9][0-9]{5}(19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{4}'))"
MOBILE_KEEP = "length(m.) = 11 AND regexp_full_match(m., '1[3-9][0-9]{9}')"
DATE = r"[0-9]{4}[年\-.][0-9]{1,2}[月\-.][0-9]{1,2}日?"
ADDRESS = r"[一-龥]{2,15}(?:省|市|自治区|特别行政区)[一-龥0-9\s,]{4,40}[0-9]+号"
PERSON = r"法定代表人\s*[:：]?\s*[一-龥]{2,4}(?:·[一-龥]{2,4})?"
# A landline starts where a run of digits does, and what follows it is matched as one character more; of those that overlap the first counts.
LANDLINE = sql_spans("l", "b", r"\p{Nd}+") + r""",
la AS (SELECT doc_id, location, start, regexp_extract(substr(t, start + 1, 15), '^(0\p{Nd}{2,3}[-\s\v\x{85}\p{Z}]?[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]{7,8})(?:[^\p{Nd}]|$)', 1) AS m FROM l),
lb AS (SELECT doc_id, location, list_reduce(list([struct_pack(s := start, e := start + length(m), m := m)] ORDER BY start), lambda a, x: CASE WHEN x[1].s >= a[-1].e THEN list_concat(a, x) ELSE a END) AS own FROM la WHERE m <> '' GROUP BY doc_id, location),
ph AS (SELECT doc_id, location, u.s AS start, u.m AS m FROM (SELECT doc_id, location, unnest(own) AS u FROM lb))"""
HITS = (
    "WITH "
    + BLOCKS
    + ", "
    + sql_spans("c", "b", "[0-9]+", CARD_KEEP)
    + ", "
    + sql_spans("e", "b", EMAIL)
    + """, h AS (SELECT doc_id, location, start, CAST(start + length(m) AS INTEGER) AS "end", m AS text, '银行卡号' AS rule_name, 4 AS rule_ord FROM c
  UNION ALL SELECT doc_id, location, start, CAST(start + length(m) AS INTEGER), m, '电子邮箱', 3 FROM e)"""
)


# ---- sources -------------------------------------------------------------------------------------------------------


@query(f"WITH {BLOCKS} SELECT doc_id, location, block_no, 'paragraph' AS kind, text FROM b")
def a1_blocks_from_text(spark, sf_dir):
    return blocks(spark, sf_dir)


@query("""
SELECT c_custkey AS doc_id, 'table_' || c_nationkey || '_cell_' || c_custkey || '_' || k AS location, CAST(k AS INTEGER) AS block_no, 'cell' AS kind, CASE k WHEN 0 THEN c_name ELSE c_mktsegment END AS text
FROM customer, (SELECT unnest([0, 1]) AS k)""")
def a2_blocks_from_cells(spark, sf_dir):
    cells = t(spark, sf_dir, "customer").withColumn("cell", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("c_name").alias("v")), F.struct(F.lit(1).alias("k"), F.col("c_mktsegment").alias("v")))))
    return corpus.blocks_from_cells(cells, F.col("c_custkey"), F.col("c_nationkey"), F.col("c_custkey"), F.col("cell.k"), F.col("cell.v"))


@query("SELECT CAST(count(DISTINCT item_id) AS BIGINT) AS items, CAST(sum(length(text)) AS BIGINT) AS chars, true AS has_path, true AS has_size FROM benchmark")
def a3_read_corpus(spark, sf_dir):
    df = corpus.read_corpus(spark, [f"{sf_dir}/benchmark.parquet"], "parquet")
    return df.agg(F.count_distinct("item_id").alias("items"), F.sum(F.length("text")).alias("chars"), F.bool_and(F.contains("path", F.lit("benchmark.parquet"))).alias("has_path"), F.bool_and(F.col("size") > 0).alias("has_size"))


_BROKEN = "(doc_id // 100) % 7 = 3"


def _files(spark, sf_dir) -> DataFrame:
    """The documents as text files of about a hundred each (number k); some of them get a line that is not UTF-8."""
    home, k = own_dir(spark, "files"), F.floor(F.col("doc_id") / 100).cast("long")
    d = t(spark, sf_dir, "documents").select(k.alias("k"), "text")
    broken = d.select("k").distinct().filter("k % 7 = 3").withColumn("text", F.unhex(F.lit("FF")).cast("string"))
    d.unionByName(broken).repartition("k").write.partitionBy("k").text(home)
    return corpus.read_files(spark, [home], glob="*.txt").withColumn("k", F.regexp_extract("path", "/k=([0-9]+)/", 1).cast("long"))


@query(f"SELECT doc_id // 100 AS k, CASE WHEN {_BROKEN} THEN 'failed' ELSE 'success' END AS status, CASE WHEN {_BROKEN} THEN 'not UTF-8' END AS error, CASE WHEN NOT {_BROKEN} THEN CAST(sum(coalesce(length(text), 0) + 1) AS BIGINT) END AS chars FROM documents GROUP BY 1, 2, 3, {_BROKEN}")
def a3_read_failures(spark, sf_dir):
    return _files(spark, sf_dir).select("k", "status", "error", F.length("text").cast("long").alias("chars"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE k % 7 <> 3) AS BIGINT) AS success, CAST(count(*) FILTER (WHERE k % 7 = 3) AS BIGINT) AS failed FROM (SELECT DISTINCT doc_id // 100 AS k FROM documents)")
def a3_failure_summary(spark, sf_dir):
    return report.batch_summary(_files(spark, sf_dir).withColumnRenamed("k", "doc_id"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'success' END AS status FROM events")
def a3_parse_records(spark, sf_dir):
    """Events as JSON texts, each fifth of them cut off."""
    whole = F.to_json(F.struct(F.col("event_type").alias("kind"), "value"))
    e = t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.substring(whole, 1, 9)).otherwise(whole).alias("text"))
    return corpus.parse_records(e, "kind string, value double").select("event_id", "kind", "status")


_PATHS = "CASE WHEN page_id % 3 = 0 THEN '/data/' || regexp_replace(url, '^https?://', '') WHEN page_id % 3 = 1 THEN '/srv/' || url ELSE '/tmp/' || regexp_replace(url, '^https?://', '') || '.PDF' END"


@query(f"""
SELECT page_id, CASE
  WHEN contains(path, '&') OR contains(path, '>') OR contains(path, '<') OR contains(path, ';') OR contains(path, '|') OR contains(path, '$') OR contains(path, '`') THEN 'shell character'
  WHEN NOT (starts_with(path, '/tmp/') OR starts_with(path, '/data/')) THEN 'outside the allowed directories'
  WHEN name = '' OR starts_with(name, '.') OR contains(name, '..') THEN 'invalid file name'
  WHEN NOT contains(substr(name, 2), '.') OR lower('.' || string_split(name, '.')[-1]) NOT IN ('.pdf', '.html') THEN 'file type not allowed' END AS reject_reason
FROM (SELECT page_id, path, string_split(path, '/')[-1] AS name FROM (SELECT page_id, {_PATHS} AS path FROM pages))""")
def a4_filter_manifest(spark, sf_dir):
    files = t(spark, sf_dir, "pages").select("page_id", F.expr(_PATHS).alias("path"))
    return corpus.filter_manifest(files, [".pdf", ".html"], ("/tmp", "/data")).select("page_id", "reject_reason")


@query("SELECT page_id, substr(sha1(url || chr(10) || length(html) || chr(10) || (page_id * 1000)), 1, 8) AS doc_hash FROM pages")
def a5_doc_fingerprint(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", overrides.doc_fingerprint(F.col("url"), F.length("html"), F.col("page_id") * 1000).alias("doc_hash"))



def _part_config(spark, sf_dir) -> DataFrame:
    p = t(spark, sf_dir, "part")
    rule = F.when(F.col("p_partkey") % 7 == 0, F.to_json(F.create_map(F.lit("k"), F.col("p_type")))).otherwise(F.lit(None))
    return p.select("p_partkey", F.concat(F.lit('{"'), F.col("p_name"), F.lit('": '), F.when(rule.isNotNull(), F.concat(F.lit('"'), "p_type", F.lit('"'))).otherwise(F.concat(F.lit('{"pattern": "'), "p_type", F.lit('"'), F.when(F.col("p_partkey") % 3 == 0, F.lit(', "enabled": false')).otherwise(""), F.lit("}"))), F.lit("}")).alias("config"))


@query("SELECT p_partkey, 0 AS rule_ord, p_name AS rule_name, p_type AS pattern, true AS enabled FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 3 <> 0")
def a6_rules_from_config(spark, sf_dir):
    return config.rules_from_config(_part_config(spark, sf_dir), "config", True, ("p_partkey",)).select("p_partkey", "rule_ord", "rule_name", "pattern", "enabled")


@query("""
SELECT coalesce(d.k, u.k) AS rule_name, coalesce(u.pattern, d.pattern) AS pattern, coalesce(u.enabled, d.enabled) AS enabled
FROM (SELECT p_partkey AS k, p_type AS pattern, true AS enabled FROM part WHERE p_type <> 'ECONOMY') d
FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN p_brand END AS pattern, false AS enabled FROM part WHERE p_size > 10) u ON d.k = u.k""")
def a7_overlay_rules(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    one = lambda df, pattern, on: df.select(F.col("p_partkey").alias("rule_name"), pattern.alias("pattern"), F.lit(on).alias("enabled"))
    return config.overlay_rules(one(p.filter("p_type <> 'ECONOMY'"), F.col("p_type"), True), one(p.filter("p_size > 10"), F.when(F.col("p_size") > 25, F.col("p_brand")), False))


@query("SELECT o_orderkey, 0 AS rule_index, o_orderstatus = 'F' AS enabled, 'exact' AS mode, o_orderpriority AS find, o_orderstatus AS replace FROM orders WHERE o_orderstatus <> 'P'")
def a8_import_replace_rules(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    rule = F.struct((F.col("o_orderstatus") == "F").alias("enabled"), F.lit("exact").alias("mode"), F.col("o_orderpriority").alias("find"), F.col("o_orderstatus").alias("replace"))
    text = F.to_json(F.struct(F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("version"), F.array(rule).alias("rules")))
    return config.import_replace_rules(o.select("o_orderkey", text.alias("config")), "config", ("o_orderkey",))


@query("SELECT o_orderkey, 0 AS rule_index, o_orderstatus = 'F' AS enabled, 'exact' AS mode, o_orderpriority AS find, o_orderstatus AS replace FROM orders UNION ALL SELECT o_orderkey, 1, true, 'regex', o_orderstatus || '+', '#' FROM orders")
def a8_export_replace_rules(spark, sf_dir):
    """Two rules of each order (in falling order of their numbers) written as one JSON text and read again."""
    o = t(spark, sf_dir, "orders")
    first = F.struct(F.lit(4).alias("rule_index"), (F.col("o_orderstatus") == "F").alias("enabled"), F.lit("exact").alias("mode"), F.col("o_orderpriority").alias("find"), F.col("o_orderstatus").alias("replace"))
    second = F.struct(F.lit(9).alias("rule_index"), F.lit(True).alias("enabled"), F.lit("regex").alias("mode"), F.concat("o_orderstatus", F.lit("+")).alias("find"), F.lit("#").alias("replace"))
    rows = o.select("o_orderkey", F.explode(F.array(second, first)).alias("r")).select("o_orderkey", "r.*")
    return config.import_replace_rules(config.export_replace_rules(rows, ("o_orderkey",)), "config", ("o_orderkey",))


# ---- decisions -----------------------------------------------------------------------------------------------------


def _log(spark, sf_dir) -> DataFrame:
    return decision_log(t(spark, sf_dir, "events"))


def decision_log(e: DataFrame) -> DataFrame:
    """Events as a log of decisions on one hit for each user."""
    kind = F.col("event_type")
    op = F.when(kind.isin("view", "signup"), "ignore").when(kind == "click", "confirm").when(kind == "purchase", "promote").otherwise("revert")
    hit_id = F.concat_ws("|", F.lit("d"), F.concat(F.lit("paragraph_"), F.col("user_id") % 7), F.col("user_id").cast("string"), (F.col("user_id") + 5).cast("string"), F.lit("rule"))
    return e.select(hit_id.alias("hit_id"), F.col("event_id").alias("seq"), op.alias("op"), F.when(kind == "signup", "permanent").otherwise("session").alias("scope"), "ts", "user_id")


FOLD = """ev AS (SELECT 'd|paragraph_' || (user_id % 7) || '|' || user_id || '|' || (user_id + 5) || '|rule' AS hit_id, event_id AS seq, ts,
  CASE WHEN event_type IN ('view', 'signup') THEN 'ignore' WHEN event_type = 'click' THEN 'confirm' WHEN event_type = 'purchase' THEN 'promote' ELSE 'revert' END AS op,
  CASE WHEN event_type = 'signup' THEN 'permanent' ELSE 'session' END AS scope FROM events),
lv AS (SELECT *, max(CASE WHEN op = 'revert' THEN seq END) OVER (PARTITION BY hit_id) AS cut FROM ev),
lw AS (SELECT *, max(CASE WHEN op IN ('ignore', 'confirm') THEN seq END) OVER (PARTITION BY hit_id) AS w FROM lv WHERE cut IS NULL OR seq > cut),
fo AS (SELECT hit_id, max(CASE WHEN seq = w THEN op END) AS action, max(CASE WHEN seq = w THEN scope END) AS s, max(CASE WHEN seq = w THEN ts END) AS wt,
  min(CASE WHEN op = 'promote' AND seq > w THEN ts END) AS p FROM lw WHERE w IS NOT NULL GROUP BY hit_id),
ov AS (SELECT hit_id, action, CASE WHEN p IS NOT NULL THEN 'permanent' ELSE s END AS scope, CASE WHEN s = 'permanent' THEN wt ELSE p END AS promoted_at FROM fo)"""


@query(f"WITH {FOLD} SELECT * FROM ov")
def d7_fold_overrides(spark, sf_dir):
    return overrides.fold_overrides(_log(spark, sf_dir))


@query(f"WITH {FOLD} SELECT * FROM ov")
def d7_snapshot_delta(spark, sf_dir):
    """The decisions of the first half of the log are kept as a table; the rest is folded onto them."""
    log, home = _log(spark, sf_dir), own_dir(spark, "snapshot")
    cut = log.agg(F.floor(F.median("seq")).cast("long")).first()[0]
    overrides.fold_overrides(log.filter(F.col("seq") <= cut)).write.parquet(home)
    return overrides.fold_delta(spark.read.parquet(home), log, cut)


@query(f"WITH {FOLD} SELECT hit_id, action, scope FROM ov WHERE scope = 'permanent'")
def a10_dump_overrides(spark, sf_dir):
    return overrides.dump_overrides(overrides.fold_overrides(_log(spark, sf_dir))).select("hit_id", "action", "scope")


@query(f"WITH {FOLD} SELECT hit_id, action, scope FROM ov WHERE promoted_at IS NULL OR promoted_at >= TIMESTAMP '2024-01-20'")
def d8_prune_stale(spark, sf_dir):
    return overrides.prune_stale(overrides.fold_overrides(_log(spark, sf_dir)), F.lit("2024-02-19").cast("date"), 30).select("hit_id", "action", "scope")


@query(f"""WITH {FOLD} SELECT CAST(count(*) FILTER (WHERE action = 'ignore') AS BIGINT) AS ignored, CAST(count(*) FILTER (WHERE action = 'ignore' AND scope = 'permanent') AS BIGINT) AS ignored_permanent,
 CAST(count(*) FILTER (WHERE action = 'confirm') AS BIGINT) AS confirmed, CAST(count(*) FILTER (WHERE action = 'confirm' AND scope = 'permanent') AS BIGINT) AS confirmed_permanent FROM ov""")
def g8_override_summary(spark, sf_dir):
    return overrides.override_summary(overrides.fold_overrides(_log(spark, sf_dir)))


@query("""
SELECT event_id, i, ok, CASE WHEN ok THEN string_split(i, '|')[2] END AS location, CASE WHEN ok THEN try_cast(string_split(i, '|')[3] AS INTEGER) END AS start
FROM (SELECT event_id, i, len(string_split(i, '|')) = 5 AND coalesce(try_cast(string_split(i, '|')[4] AS INTEGER) IS NOT NULL, false) AS ok FROM (
  SELECT event_id, 'd|p_' || (user_id % 7) || '|' || user_id || CASE WHEN event_type = 'error' THEN '|x' ELSE '|' || (user_id + 5) END || CASE WHEN event_type = 'view' THEN '' ELSE '|rule' END AS i FROM events))""")
def d9_parse_hit_id(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    i = F.concat(F.lit("d|p_"), F.col("user_id") % 7, F.lit("|"), "user_id", F.when(F.col("event_type") == "error", F.lit("|x")).otherwise(F.concat(F.lit("|"), F.col("user_id") + 5)), F.when(F.col("event_type") == "view", "").otherwise("|rule"))
    return overrides.parse_hit_id(e.select("event_id", i.alias("i")), "i").select("event_id", "i", "ok", "location", "start")


def _stored(spark, sf_dir) -> DataFrame:
    e = t(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("ord"), F.concat_ws("|", F.lit("d"), F.col("user_id").cast("string")).alias("hit_id"), F.when(kind != "error", F.lit("d")).alias("doc_hash"), F.lit("p_0").alias("location"),
        F.lit(0).alias("start"), (F.col("value") - 1).cast("int").alias("end"), F.lit("rule").alias("source"), F.when(kind == "view", "ignore").when(kind == "click", "confirm").otherwise("ignore").alias("action"),
        F.when(kind == "signup", "permanent").when(kind == "purchase", "forever").otherwise("session").alias("scope"), F.when(F.col("user_id") % 2 == 0, F.col("ts")).alias("promoted_at"),
    )


STORED = """st AS (SELECT value, event_id AS ord, 'd|' || user_id AS hit_id, CASE WHEN event_type = 'click' THEN 'confirm' ELSE 'ignore' END AS action,
  CASE WHEN event_type = 'signup' THEN 'permanent' WHEN event_type = 'purchase' THEN 'forever' ELSE 'session' END AS scope,
  event_type NOT IN ('error', 'purchase') AND CAST(trunc(value - 1) AS INTEGER) >= 0 AND (event_type <> 'signup' OR user_id % 2 = 0) AS good FROM events)"""


@query(f"WITH {STORED} SELECT ord, hit_id, action, scope FROM st WHERE good")
def d10_restore_overrides(spark, sf_dir):
    return overrides.restore_overrides(_stored(spark, sf_dir))[0].select("ord", "hit_id", "action", "scope")


@query(f"WITH {STORED} SELECT ord, hit_id, action, scope FROM st WHERE NOT coalesce(good, false)")
def d10_rejected_overrides(spark, sf_dir):
    return overrides.restore_overrides(_stored(spark, sf_dir))[1].select("ord", "hit_id", "action", "scope")


@query(f"""WITH {STORED}, cur AS (SELECT hit_id, max_by(action, ord) AS action, max_by(scope, ord) AS scope FROM st WHERE good AND trunc(value - 1) < 19 GROUP BY hit_id),
nw AS (SELECT hit_id, max_by(action, ord) AS action, max_by(scope, ord) AS scope FROM st WHERE good AND trunc(value - 1) >= 19 GROUP BY hit_id)
SELECT * FROM nw UNION ALL SELECT * FROM cur WHERE hit_id NOT IN (SELECT hit_id FROM nw)""")
def a10_load_overrides(spark, sf_dir):
    rows = _stored(spark, sf_dir)
    cur = overrides.load_overrides(rows.filter("false"), rows.filter("end < 19"))
    return overrides.load_overrides(cur, rows.filter("end >= 19")).select("hit_id", "action", "scope")


@query(f"""WITH {STORED}, cur AS (SELECT hit_id, max_by(action, ord) AS action, max_by(scope, ord) AS scope FROM st WHERE good AND trunc(value - 1) < 19 GROUP BY hit_id),
nw AS (SELECT hit_id, max_by(action, ord) AS action, 'permanent' AS scope FROM st WHERE good AND scope = 'permanent' AND trunc(value - 1) >= 19 GROUP BY hit_id)
SELECT * FROM nw UNION ALL SELECT * FROM cur WHERE scope <> 'permanent' AND hit_id NOT IN (SELECT hit_id FROM nw)""")
def a10_replace_overrides(spark, sf_dir):
    rows = _stored(spark, sf_dir)
    cur = overrides.load_overrides(rows.filter("false"), rows.filter("end < 19"))
    return overrides.replace_overrides(cur, rows.filter("end >= 19")).select("hit_id", "action", "scope")


# ---- rules and terms -----------------------------------------------------------------------------------------------


@query("SELECT item_id, CAST(i - 1 AS INTEGER) AS rule_ord, ws[i] AS rule_name, chr(92) || 'Q' || ws[i] || chr(92) || 'E' AS pattern FROM (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM benchmark))")
def b1_keywords_to_rules(spark, sf_dir):
    return rules.keywords_to_rules(t(spark, sf_dir, "benchmark"), "text", ["item_id"])


@query("SELECT p_partkey AS rule_index, p_name AS find, CASE WHEN p_type IN ('exact', 'regex') THEN p_type ELSE 'exact' END AS mode, CASE WHEN p_size % 4 = 0 THEN '*' ELSE p_brand END AS replace FROM part WHERE p_size % 5 <> 0")
def b3_normalize_replace_rules(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_index"), F.when(F.col("p_size") % 5 == 0, "  ").otherwise(F.col("p_name")).alias("find"), F.col("p_type").alias("mode"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_brand")).alias("replace"))
    return rules.normalize_replace_rules(p)


def _terms(spark, sf_dir) -> DataFrame:
    c = t(spark, sf_dir, "customer").select(F.lit("allow").alias("list"), F.lit("permanent").alias("layer"), F.col("c_custkey").cast("int").alias("ord"), F.col("c_mktsegment").alias("term"))
    s = t(spark, sf_dir, "part").select(F.lit("allow").alias("list"), F.lit("session").alias("layer"), F.col("p_partkey").cast("int").alias("ord"), F.concat(F.lit(" "), F.when(F.col("p_size") < 25, F.col("p_name")).otherwise(F.lit(" "))).alias("term"))
    return c.unionByName(s)


TERMS = """tm AS (SELECT 'permanent' AS layer, c_custkey AS ord, c_mktsegment AS term FROM customer UNION ALL SELECT 'session', p_partkey, p_name FROM part WHERE p_size < 25)"""


@query(f"WITH {TERMS} SELECT layer, CAST(ord AS INTEGER) AS ord, term FROM tm")
def b4_sanitize_terms(spark, sf_dir):
    return rules.sanitize_terms(_terms(spark, sf_dir)).select("layer", "ord", "term")


@query(f"WITH {TERMS} SELECT 'allow' AS list, term, CAST(row_number() OVER (ORDER BY k, o, term) AS INTEGER) AS ord FROM (SELECT term, min(CASE WHEN layer = 'permanent' THEN 0 ELSE 1 END) AS k, min_by(ord, (CASE WHEN layer = 'permanent' THEN 0 ELSE 1 END) * 1000000000 + ord) AS o FROM tm GROUP BY term)")
def b5_effective_terms(spark, sf_dir):
    return rules.effective_terms(_terms(spark, sf_dir))


@query(f"WITH {TERMS} SELECT layer, CAST(ord AS INTEGER) AS ord, term FROM tm WHERE layer = 'permanent' OR term NOT LIKE 'red%' UNION ALL SELECT 'session', min(CAST(n_nationkey AS INTEGER)), n_name FROM nation GROUP BY n_name")
def b7_edit_terms(spark, sf_dir):
    terms = rules.sanitize_terms(_terms(spark, sf_dir))
    more = t(spark, sf_dir, "nation").select(F.lit("allow").alias("list"), F.col("n_name").alias("term"), F.col("n_nationkey").cast("int").alias("ord"))
    gone = terms.filter("term like 'red%'").select("list", "term").union(spark.range(1).select(F.lit("allow"), F.lit("unknown")))
    return rules.remove_terms(rules.add_terms(terms, more), gone).select("layer", "ord", "term")


@query(f"WITH {TERMS} SELECT layer, CAST(ord AS INTEGER) AS ord, term FROM tm WHERE layer = 'session' UNION ALL SELECT 'permanent', CAST(n_nationkey AS INTEGER), n_name FROM nation")
def b7_update_permanent(spark, sf_dir):
    new = t(spark, sf_dir, "nation").select(F.lit("allow").alias("list"), F.concat(F.lit("  "), "n_name", F.lit(" ")).alias("term"), F.col("n_nationkey").cast("int").alias("ord"))
    return rules.update_permanent(rules.sanitize_terms(_terms(spark, sf_dir)), new).select("layer", "ord", "term")


@query("SELECT CAST(c_custkey AS INTEGER) AS rule_ord, c_name AS rule_name FROM customer WHERE c_custkey % 7 IN (0, 6)")
def b2_active_rules(spark, sf_dir):
    """Rules made of customers: disabled, blank, the seal's, not compiling, matching the empty text, and two kinds that stay."""
    c = t(spark, sf_dir, "customer")
    kind = F.col("c_custkey") % 7
    pattern = F.when(kind == 1, "  ").when(kind == 2, rules.SEAL).when(kind == 3, F.concat("c_name", F.lit("("))).when(kind == 4, "(?:x|y)*").otherwise(F.concat(F.lit("\\Q"), "c_name", F.lit("\\E")))
    table = c.select(F.col("c_custkey").cast("int").alias("rule_ord"), F.col("c_name").alias("rule_name"), pattern.alias("pattern"), F.when(kind == 6, None).otherwise(kind != 5).alias("enabled"), F.lit("").alias("description"))
    return rules.active_rule_table(table).select("rule_ord", "rule_name")


def _external(spark, sf_dir) -> DataFrame:
    e = t(spark, sf_dir, "events")
    source = F.when(F.col("event_type") == "view", "seal").when(F.col("event_type") == "click", "manual").when(F.col("event_type") == "error", "camera").otherwise("ocr")
    return e.select(F.col("event_id").alias("doc_id"), F.lit("page_0").alias("location"), F.lit(10).alias("start"), F.col("value").cast("int").alias("end"), source.alias("source"))


@query("SELECT event_id AS doc_id, CAST(trunc(value) AS INTEGER) AS \"end\", CASE event_type WHEN 'view' THEN 'seal' WHEN 'click' THEN 'manual' ELSE 'ocr' END AS source FROM events WHERE event_type <> 'error' AND trunc(value) >= 10")
def b6_validate_hits(spark, sf_dir):
    return rules.validate_hits(_external(spark, sf_dir))[0].select("doc_id", "end", "source")


@query("SELECT event_id AS doc_id, CAST(trunc(value) AS INTEGER) AS \"end\", CASE event_type WHEN 'view' THEN 'seal' WHEN 'click' THEN 'manual' WHEN 'error' THEN 'camera' ELSE 'ocr' END AS source FROM events WHERE NOT (event_type <> 'error' AND trunc(value) >= 10)")
def b6_rejected_hits(spark, sf_dir):
    return rules.validate_hits(_external(spark, sf_dir))[1].select("doc_id", "end", "source")


@query("SELECT 'rules.' || p_name AS path, CASE WHEN p_size % 6 = 0 THEN 'pattern is empty' ELSE 'order is out of range' END AS message FROM part WHERE (p_size % 6 = 0) <> (p_partkey % 10 = 0) UNION ALL SELECT 'rules.' || p_name, unnest(['pattern is empty', 'order is out of range']) FROM part WHERE p_size % 6 = 0 AND p_partkey % 10 = 0")
def b8_validate_rules(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    return rules.validate_rules(p.select(F.when(F.col("p_partkey") % 10 == 0, -1).otherwise(F.col("p_partkey").cast("int")).alias("rule_ord"), F.col("p_name").alias("rule_name"), F.when(F.col("p_size") % 6 == 0, "").otherwise(F.col("p_type")).alias("pattern")))


# ---- detection -----------------------------------------------------------------------------------------------------


@query(HITS + ' SELECT doc_id, location, rule_name, start, "end", text FROM h')
def pii_hits(spark, sf_dir):
    return detect.find_spans(blocks(spark, sf_dir), PII).select("doc_id", "location", "rule_name", "start", "end", "text")


def _default_rules_sql() -> str:
    """Every default rule over all lines; runs of digits are cut once."""
    ctes = [BLOCKS, sql_spans("n", "b", "[0-9]+"), sql_spans("e", "b", EMAIL), sql_spans("d", "b", DATE), sql_spans("ad", "b", ADDRESS), sql_spans("pe", "b", PERSON), LANDLINE]
    rows = [("身份证号", "n", ID_KEEP), ("手机号码", "n", MOBILE_KEEP), ("银行卡号", "n", CARD_KEEP), ("电子邮箱", "e", "true"), ("日期时间", "d", "true"), ("地址（含门牌号）", "ad", "true"), ("法定代表人", "pe", "true"), ("固定电话", "ph", "true")]
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT doc_id, location, '{name}' AS rule_name, start, CAST(start + length(m) AS INTEGER) AS \"end\", m AS text FROM {cte} WHERE {keep.replace('m.', 'm')}" for name, cte, keep in rows)


@query(_default_rules_sql())
def c1_default_rules(spark, sf_dir):
    active = rules.active_rules(rules.default_rules(spark))
    return detect.find_spans(blocks(spark, sf_dir), active).select("doc_id", "location", "rule_name", "start", "end", "text")


@query("WITH " + sql_spans("c", "(SELECT page_id AS doc_id, html AS text FROM pages)", "[0-9]+", CARD_KEEP, "doc_id") + ", " + sql_spans("e", "(SELECT page_id AS doc_id, html AS text FROM pages)", EMAIL, keys="doc_id") + " SELECT doc_id, start, m AS text FROM c UNION ALL SELECT doc_id, start, m FROM e")
def c1_find_spans_pages(spark, sf_dir):
    pages = t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("page_0").alias("location"), F.col("html").alias("text"))
    return detect.find_spans(pages, PII).select("doc_id", "start", "text")


@query("WITH b AS (SELECT conv_id AS doc_id, 'turn_' || turn AS location, text FROM conversations), " + sql_spans("c", "b", "(?i)ther") + " SELECT doc_id, location, start, m AS text FROM c")
def c10_find_keywords(spark, sf_dir):
    return detect.find_keywords(turns(spark, sf_dir), ["ther"]).select("doc_id", "location", "start", "text")


_NEEDLE = "WITH d AS (SELECT doc_id, text, string_split(text, ' ')[1] AS needle FROM documents), "


@query(_NEEDLE + """g AS (SELECT doc_id, needle, string_split(lower(text), lower(needle)) AS gs FROM d WHERE needle <> ''), k AS (SELECT doc_id, needle, gs, unnest(range(1, len(gs))) AS i FROM g)
SELECT doc_id, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + (i - 1) * length(needle) AS INTEGER) AS start, lower(needle) AS text FROM k""")
def c11_find_exact(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.lit("document").alias("location"), "text", F.get(F.split("text", " "), 0).alias("needle"))
    return detect.find_exact(d, "needle", "jieba").select("doc_id", "start", F.lower("text").alias("text"))


_BLOCK_TERMS = ["the", "die", "que", "token"]


@query(f"""WITH {BLOCKS}, tm AS (SELECT unnest(['the', 'die', 'que', 'token']) AS term), p AS (SELECT doc_id, location, term, string_split(text, term) AS gs FROM b JOIN tm ON contains(text, term)),
k AS (SELECT doc_id, location, term, gs, unnest(range(1, len(gs))) AS i FROM p)
SELECT doc_id, location, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + (i - 1) * length(term) AS INTEGER) AS start, '黑名单:' || term AS rule_name FROM k""")
def c12_scan_block_list(spark, sf_dir):
    terms = spark.createDataFrame([(x,) for x in _BLOCK_TERMS], "term string")
    return detect.scan_block_list(blocks(spark, sf_dir), terms).select("doc_id", "location", "start", "rule_name")


@query("WITH " + BLOCKS + """, t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{4,}')) AS term FROM benchmark),
p AS (SELECT doc_id, location, term, string_split(text, term) AS gs FROM b JOIN t ON contains(text, term)),
k AS (SELECT doc_id, location, term, gs, unnest(range(1, len(gs))) AS i FROM p)
SELECT doc_id, location, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + (i - 1) * length(term) AS INTEGER) AS start, '黑名单:' || term AS rule_name FROM k""")
def c12_many_terms(spark, sf_dir):
    """The words of all benchmark passages as a block list: about a thousand terms or more."""
    words = F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))
    terms = t(spark, sf_dir, "benchmark").select(F.explode(words).alias("term"))
    return detect.scan_block_list(blocks(spark, sf_dir), terms).select("doc_id", "location", "start", "rule_name")


@query("WITH " + sql_spans("e", "documents", "[0-9]+", CARD_KEEP, "doc_id") + """, u AS (SELECT DISTINCT doc_id, m FROM e), p AS (SELECT u.doc_id, m, string_split(text, m) AS gs FROM u JOIN documents d ON d.doc_id = u.doc_id), k AS (SELECT doc_id, m, gs, unnest(range(1, len(gs))) AS i FROM p)
SELECT doc_id, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + (i - 1) * length(m) AS INTEGER) AS start, m AS rule_name FROM k""")
def c13_unique_then_expand(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.lit("page_0").alias("location"), "text")
    return detect.unique_then_expand(d, [R["银行卡号"]]).select("doc_id", "start", "rule_name")


def _tokens(spark, sf_dir) -> DataFrame:
    b = t(spark, sf_dir, "documents").select("doc_id", F.lit("document").alias("location"), F.posexplode(F.split("text", " ")).alias("tok_no", "word"))
    return b.withColumn("flag", F.when(F.rlike("word", F.lit("^[A-Z]")), "nrx").otherwise("n"))


TOKENS = """k AS (SELECT doc_id, unnest(range(len(ws))) AS tok_no, unnest(ws) AS word FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)),
nm AS (SELECT doc_id, word, CAST(min(tok_no) AS INTEGER) AS ord FROM k WHERE regexp_matches(word, '^[A-Z]') AND length(word) BETWEEN 2 AND 4 AND word[1] IN (SELECT substr(n_name, 1, 1) FROM nation UNION SELECT substr(r_name, 1, 1) FROM region) AND word NOT IN ('Es', 'The', 'And') GROUP BY doc_id, word)"""


def _names(spark, sf_dir) -> DataFrame:
    first = lambda df, c: df.select(F.substring(c, 1, 1).alias("ch"))
    surnames = first(t(spark, sf_dir, "nation"), "n_name").union(first(t(spark, sf_dir, "region"), "r_name"))
    return names.name_candidates(_tokens(spark, sf_dir), surnames, spark.createDataFrame([("Es",), ("The",), ("And",)], "word string"))


@query(f"WITH {TOKENS} SELECT doc_id, word, ord FROM nm")
def c14_name_candidates(spark, sf_dir):
    return _names(spark, sf_dir).select("doc_id", "word", "ord")


def _start_tagger():
    """A tagger for the tests' prose: words between spaces, a capital letter marks a name."""
    return lambda text: ((w, "nrx" if w[:1].isascii() and w[:1].isupper() else "n") for w in text.split(" "))


@query(f"WITH {TOKENS} SELECT doc_id, word, ord FROM nm")
def c14_tagged_names(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.lit("document").alias("location"), "text")
    first = lambda df, c: df.select(F.substring(c, 1, 1).alias("ch"))
    surnames = first(t(spark, sf_dir, "nation"), "n_name").union(first(t(spark, sf_dir, "region"), "r_name"))
    return names.name_candidates(names.tag_tokens(d, _start_tagger), surnames, spark.createDataFrame([("Es",), ("The",), ("And",)], "word string")).select("doc_id", "word", "ord")


@query(f"""WITH {TOKENS}, p AS (SELECT nm.doc_id, word, string_split(lower(text), lower(word)) AS gs FROM nm JOIN documents d ON d.doc_id = nm.doc_id WHERE word <> 'Are')
SELECT doc_id, word AS rule_name, CAST(len(gs) - 1 AS BIGINT) AS hits FROM p""")
def c15_inject_names(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.lit("document").alias("location"), "text")
    return names.inject_names(d, _names(spark, sf_dir), ["Are"]).groupBy("doc_id", "rule_name").agg(F.count("*").alias("hits"))


def _pages(spark, sf_dir) -> DataFrame:
    """Each document line as a page; it has an image block if it holds a comma."""
    return blocks(spark, sf_dir).select("doc_id", F.col("block_no").alias("page"), "text", F.contains("text", F.lit(",")).alias("has_images"))


def _lines(spark, sf_dir) -> DataFrame:
    """Each document line as a recognised line: line i lies at y = 20 i, its width by characters."""
    b = blocks(spark, sf_dir).filter("text <> ''")
    w = spans.text_width(F.col("text")) * 10
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    y = F.col("block_no") * 20.0
    box = F.array(point(F.lit(0), y), point(w, y), point(w, y + 12), point(F.lit(0), y + 12))
    return b.select("doc_id", F.lit(0).alias("page"), F.lit("raw").alias("pass"), F.col("block_no").alias("line_no"), "text", box.alias("box"))


@query(f"""WITH {BLOCKS} SELECT doc_id, block_no AS page, CASE WHEN length(trim(text)) < 50 AND contains(text, ',') THEN replace(text, ' ', chr(10)) ELSE text END AS text FROM b""")
def c16_name_source_text(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    words = pages.select("doc_id", "page", F.posexplode(F.split("text", " ")).alias("line_no", "text"))
    return names.name_source_text(pages, words).select("doc_id", "page", "text")


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'ocr' WHEN user_id % 3 = 0 THEN 'rule' WHEN user_id % 3 = 1 THEN CASE WHEN event_type = 'view' THEN 'ocr' ELSE 'rule' END ELSE 'jieba' END AS source FROM events""")
def c17_tag_source(spark, sf_dir):
    channel = F.when(F.col("event_type") == "error", "image").when(F.col("event_type") == "view", "page").otherwise("word")
    kind = F.when(F.col("user_id") % 3 == 0, "rule").when(F.col("user_id") % 3 == 1, "keyword").otherwise("name")
    return t(spark, sf_dir, "events").select("event_id", detect.tag_source(channel, kind).alias("source"))


@query("SELECT l_orderkey, l_linenumber, coalesce((SELECT min_by(n_name, n_nationkey) FROM nation WHERE n_nationkey % 20 = l_suppkey % 40), '自定义') AS rule_name FROM lineitem")
def c18_attach_rule_name(spark, sf_dir):
    hits = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 40).cast("string").alias("pattern"), F.lit("").alias("rule_name"))
    rows = t(spark, sf_dir, "nation").select((F.col("n_nationkey") % 20).cast("string").alias("pattern"), F.col("n_name").alias("rule_name"), F.col("n_nationkey").alias("rule_ord"))
    return detect.attach_rule_name(hits, rows).select("l_orderkey", "l_linenumber", "rule_name")


# Texts for the Chinese rules are made from the keys and dates of orders. Every fifth key has a digit more beside each number, which
# the rules' look-around refuses; of the sentence of each rule the place of the match is known from how it is made.
CHINESE = """o AS (SELECT o_orderkey AS k, o_orderdate AS d FROM orders),
p AS (SELECT k, CASE WHEN k % 5 = 0 THEN '9' ELSE '' END AS x, '110101' || CAST(1950 + k % 60 AS VARCHAR) || lpad(CAST(1 + k % 12 AS VARCHAR), 2, '0') || lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0') || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || CASE WHEN k % 2 = 0 THEN 'X' ELSE CAST(k % 10 AS VARCHAR) END AS id,
  '13' || lpad(CAST(k % 1000000000 AS VARCHAR), 9, '0') AS mobile, CAST(year(d) AS VARCHAR) || '年' || CAST(month(d) AS VARCHAR) || '月' || CAST(day(d) AS VARCHAR) || '日' AS day,
  '010-' || lpad(CAST(k % 100000000 AS VARCHAR), 8, '0') AS phone, '北京市朝阳区建国路' || CAST(k AS VARCHAR) || '号' AS address, '法定代表人：王小明' AS person FROM o),
q AS (SELECT k, x, unnest(['身份证号', '手机号码', '日期时间', '固定电话', '地址（含门牌号）', '法定代表人']) AS rule_name, unnest([id, mobile, day, phone, address, person]) AS m, unnest([1, 1, 0, 1, 0, 0]) AS digits FROM p)"""


def _order_sentences(spark, sf_dir) -> dict[str, DataFrame]:
    """For every order and rule a sentence: doc_id, location, text."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    number = lambda c, n: F.lpad(c.cast("string"), n, "0")
    extra = F.when(k % 5 == 0, "9").otherwise("")
    made = {
        "身份证号": F.concat(F.lit("编号 "), extra, F.lit("110101"), (1950 + k % 60).cast("string"), number(1 + k % 12, 2), number(1 + k % 28, 2), number(k % 1000, 3), F.when(k % 2 == 0, "X").otherwise((k % 10).cast("string"))),
        "手机号码": F.concat(F.lit("电话 "), F.lit("13"), number(k % 1000000000, 9), extra),
        "日期时间": F.concat(F.lit("日期 "), F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日")),
        "固定电话": F.concat(F.lit("座机 "), F.lit("010-"), number(k % 100000000, 8), extra),
        "地址（含门牌号）": F.concat(F.lit("住 \n"), F.lit("北京市朝阳区建国路"), k.cast("string"), F.lit("号")),
        "法定代表人": F.concat(F.lit("由 \n"), F.lit("法定代表人：王小明")),
    }
    o = t(spark, sf_dir, "orders")
    return {name: o.select(k.alias("doc_id"), F.lit("order").alias("location"), text.alias("text")) for name, text in made.items()}


@query(f"WITH {CHINESE} SELECT k AS doc_id, rule_name, 3 AS start, CAST(3 + length(m) AS INTEGER) AS \"end\", m AS text FROM q WHERE digits = 0 OR x = ''")
def c2_c9_rules_on_orders(spark, sf_dir):
    """Each of the rules for national ids, mobiles, dates, landlines, addresses and representatives on a sentence of its own for every order."""
    parts = [detect.find_spans(b, [R[name]]) for name, b in _order_sentences(spark, sf_dir).items()]
    return reduce(DataFrame.unionByName, parts).select("doc_id", "rule_name", "start", "end", "text")


# Each rule over all lines of all documents, and over the sentences for it that orders make.
def _digit_rule(name: str, keep: str) -> str:
    return f"WITH {BLOCKS}, " + sql_spans("c", "b", "[0-9]+", keep) + f" SELECT doc_id, location, '{name}' AS rule_name, start, m AS text FROM c"


def _pattern_rule(name: str, pattern: str) -> str:
    return f"WITH {BLOCKS}, " + sql_spans("c", "b", pattern) + f" SELECT doc_id, location, '{name}' AS rule_name, start, m AS text FROM c"


def _one_rule(name: str):
    def run(spark, sf_dir):
        b = blocks(spark, sf_dir).select("doc_id", "location", "text")
        own = _order_sentences(spark, sf_dir).get(name)
        return detect.find_spans(b if own is None else b.unionByName(own), [R[name]]).select("doc_id", "location", "rule_name", "start", "text")

    return run


for _name, _key, _sql in (
    ("身份证号", "c2_national_id", _digit_rule("身份证号", ID_KEEP)),
    ("手机号码", "c3_mobile", _digit_rule("手机号码", MOBILE_KEEP)),
    ("日期时间", "c4_date", _pattern_rule("日期时间", DATE)),
    ("电子邮箱", "c5_email", _pattern_rule("电子邮箱", EMAIL)),
    ("银行卡号", "c6_card", _digit_rule("银行卡号", CARD_KEEP)),
    ("地址（含门牌号）", "c7_address", _pattern_rule("地址（含门牌号）", ADDRESS)),
    ("固定电话", "c8_landline", f"WITH {BLOCKS}, {LANDLINE} SELECT doc_id, location, '固定电话' AS rule_name, start, m AS text FROM ph"),
    ("法定代表人", "c9_representative", _pattern_rule("法定代表人", PERSON)),
):
    QUERIES[_key] = _one_rule(_name)
    if _sql:
        ORACLE_SQL[_key] = _sql if _key in ("c5_email", "c6_card") else _sql.replace(" SELECT doc_id, location, '", f", {CHINESE} SELECT doc_id, location, '") + f" UNION ALL SELECT k, 'order', rule_name, 3, m FROM q WHERE rule_name = '{_name}' AND (digits = 0 OR x = '')"


@query(f"""WITH {BLOCKS}, p AS (SELECT doc_id, block_no AS page, trim(text) <> '' AS txt, contains(text, ',') AS img FROM b)
SELECT doc_id, page, 'text' AS channel FROM p WHERE txt UNION ALL SELECT doc_id, page, 'image' FROM p WHERE img UNION ALL SELECT doc_id, page, 'page' FROM p WHERE NOT txt AND NOT img""")
def c19_pick_channels(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    images = pages.filter("has_images").select("doc_id", "page", F.explode(F.array(F.lit(1), F.lit(2))).alias("block_no"))
    return detect.pick_channels(pages, images)


@query(f"WITH {BLOCKS}, " + sql_spans("c", "b", "[0-9]+", CARD_KEEP, "doc_id, block_no") + ", ps AS (SELECT unnest(['raw', 'enhanced']) AS pass) SELECT doc_id, pass, block_no AS line_no, start, m AS text FROM c, ps")
def c20_find_spans_in_lines(spark, sf_dir):
    raw = _lines(spark, sf_dir)
    return detect.find_spans_in_lines([raw, raw.withColumn("pass", F.lit("enhanced"))], [R["银行卡号"]]).select("doc_id", "pass", "line_no", "start", "text")


@query(HITS + """, x AS (SELECT event_id AS doc_id, CASE event_type WHEN 'view' THEN 'seal' WHEN 'click' THEN 'manual' ELSE 'ocr' END AS source FROM events WHERE event_type <> 'error' AND trunc(value) >= 10)
SELECT doc_id, 'rule' AS source, rule_name FROM h UNION ALL SELECT doc_id, source, NULL FROM x""")
def a11_union_external_hits(spark, sf_dir):
    hits = detect.find_spans(blocks(spark, sf_dir), PII)
    return config.union_external_hits(hits, _external(spark, sf_dir))[0].select("doc_id", "source", "rule_name")


# ---- lists and decisions on hits -----------------------------------------------------------------------------------


@query(HITS + """, a AS (SELECT doc_id, location, start, text, string_split(text, '4') AS gs FROM h), k AS (SELECT doc_id, location, start, gs, unnest(range(1, len(gs) + 1)) AS i FROM a)
SELECT doc_id, location, CAST(start + list_sum(list_transform(gs[1:i], lambda x: length(x))) - length(gs[i]) + (i - 1) AS INTEGER) AS start, gs[i] AS text FROM k WHERE gs[i] <> ''""")
def d2_apply_allow_list(spark, sf_dir):
    hits = detect.find_spans(blocks(spark, sf_dir), PII)
    return lists.apply_allow_list(hits, spark.createDataFrame([("4",)], "term string")).select("doc_id", "location", "start", "text")


@query(HITS + " SELECT doc_id, location, start, text FROM h WHERE NOT contains(text, '44') AND NOT contains(text, 'mail')")
def d2_drop_allowed(spark, sf_dir):
    hits = detect.find_spans(blocks(spark, sf_dir), PII)
    return lists.apply_allow_list(hits, spark.createDataFrame([("44",), ("mail",)], "term string"), False).select("doc_id", "location", "start", "text")


@query(f"""WITH {BLOCKS}, k AS (SELECT doc_id, location, list_filter(string_split_regex(text, 'the|an'), lambda x: x <> '') AS rs FROM b WHERE text <> '')
SELECT doc_id, location, unnest(range(1, len(rs) + 1)) - 1 AS run_no, unnest(rs) AS text FROM k""")
def d1_split_by_allow_list(spark, sf_dir):
    runs = lists.split_by_allow_list(F.col("text"), F.array(F.lit("the"), F.lit("an")))
    cut = blocks(spark, sf_dir).select("doc_id", "location", F.posexplode(runs).alias("i", "r"))
    return cut.select("doc_id", "location", F.col("i").cast("long").alias("run_no"), F.col("r.text").alias("text"))


@query(HITS + f""", tm AS (SELECT unnest(['token', 'password']) AS term), p AS (SELECT doc_id, location, term, string_split(text, term) AS gs FROM b JOIN tm ON contains(text, term)),
k AS (SELECT doc_id, location, term, gs, unnest(range(1, len(gs))) AS i FROM p)
SELECT doc_id, location, start, text, 'rule' AS source FROM h WHERE NOT contains(text, 'mail') UNION ALL SELECT doc_id, location, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + (i - 1) * length(term) AS INTEGER), term, 'blacklist' FROM k WHERE term <> 'password'""")
def d4_list_pipeline(spark, sf_dir):
    b = blocks(spark, sf_dir)
    table = lambda *xs: spark.createDataFrame([(x,) for x in xs], "term string")
    out = lists.list_pipeline(detect.find_spans(b, PII), b, table("mail", "password"), table("token", "password"), False)
    return out.select("doc_id", "location", "start", "text", "source")


@query(HITS + " SELECT doc_id || '|' || location || '|' || start || '|' || \"end\" || '|rule' AS hit_id, rule_name FROM h")
def d5_with_hit_id(spark, sf_dir):
    return overrides.with_hit_id(detect.find_spans(blocks(spark, sf_dir), PII), "doc_id").select("hit_id", "rule_name")


def decisions(spark, sf_dir) -> DataFrame:
    """Hits in labelled documents: confirmed in documents of good quality, ignored in others."""
    h = overrides.with_hit_id(detect.find_spans(blocks(spark, sf_dir), PII), "doc_id")
    good = t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return h.join(good, "doc_id").select("hit_id", F.when(F.col("quality") == 1, "confirm").otherwise("ignore").alias("action")).distinct()


QUALITY = ", lq AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)"


@query(HITS + QUALITY + " SELECT h.doc_id, location, start FROM h LEFT JOIN lq ON lq.doc_id = h.doc_id WHERE quality IS NULL OR quality = 1")
def d6_filter_overridden(spark, sf_dir):
    hits = overrides.with_hit_id(detect.find_spans(blocks(spark, sf_dir), PII), "doc_id")
    return overrides.filter_overridden(hits, decisions(spark, sf_dir)).select("doc_id", "location", "start")


@query(HITS + QUALITY + " SELECT h.doc_id, location, start, coalesce(quality = 1, false) AS confirmed FROM h LEFT JOIN lq ON lq.doc_id = h.doc_id")
def d11_annotate_hits(spark, sf_dir):
    hits = overrides.with_hit_id(detect.find_spans(blocks(spark, sf_dir), PII), "doc_id")
    return overrides.annotate_hits(hits, decisions(spark, sf_dir)).select("doc_id", "location", "start", "confirmed")


# ---- boxes ---------------------------------------------------------------------------------------------------------

CARDS_IN_LINES = f"""WITH {BLOCKS}, """ + sql_spans("c", "b", "[0-9]+", CARD_KEEP, "doc_id, block_no") + """,
r AS (SELECT doc_id, block_no, start, m, length(t) * 0.55 * 10 AS lw, (start / length(t)) * length(t) * 5.5 + 1 AS x, greatest(5.0, length(m) * 5.5 - 2) AS w, block_no * 20.0 AS y FROM c WHERE length(t) > 0)"""


def _boxes(spark, sf_dir) -> DataFrame:
    spans_ = _lines(spark, sf_dir).withColumn("x", F.explode(detect.hits_in(F.col("text"), [R["银行卡号"]], "ocr")))
    box = geometry.span_rect(F.col("box"), F.col("text"), F.col("x.start"), F.col("x.end"))
    return spans_.select("doc_id", "page", "line_no", (F.col("line_no") * 20.0 + 6).alias("y_center"), F.col("x.start").alias("ord"), F.col("x.text").alias("text"), F.col("x.source").alias("source"), F.col("x.rule_name").alias("rule_name"), box.alias("rect"))


_XYWH = ("x", "y", "w", "h")


def _flat(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *(F.round(f"rect.{c}", 4).alias(c) for c in _XYWH))


@query(CARDS_IN_LINES + " SELECT doc_id, block_no AS line_no, round(CAST(x AS DOUBLE), 4) AS x, round(CAST(y AS DOUBLE), 4) AS y, round(CAST(w AS DOUBLE), 4) AS w, CAST(12.0 AS DOUBLE) AS h FROM r")
def e3_span_rect(spark, sf_dir):
    return _flat(_boxes(spark, sf_dir), "doc_id", "line_no")


@query("SELECT doc_id, round(CAST((length(text) - len(regexp_extract_all(text, '[一-鿿㐀-䶿豈-﫿]'))) * 0.55 + len(regexp_extract_all(text, '[一-鿿㐀-䶿豈-﫿]')) AS DOUBLE), 4) AS width FROM documents")
def e2_text_width(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.round(spans.text_width(F.col("text")), 4).alias("width"))


def _layout(spark, sf_dir) -> DataFrame:
    li = t(spark, sf_dir, "lineitem")
    x0, y0 = F.round(F.col("l_partkey") % 10 + F.lit(0.001) * (F.col("l_linenumber") % 2), 3), (F.col("l_suppkey") % 5).cast("double")
    box = F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity")).alias("x1"), (y0 + 30).alias("y1"))
    return li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.col("l_linenumber").alias("block_no"), F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("type"), box.alias("bbox"))


@query("""
WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS block_no, l_partkey % 10 AS x, l_suppkey % 5 AS y, l_quantity AS q FROM lineitem WHERE l_returnflag <> 'A' AND l_quantity >= 24),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, x, y, q ORDER BY block_no) AS k FROM l) SELECT doc_id, block_no FROM n WHERE k = 1""")
def e1_image_regions(spark, sf_dir):
    return geometry.image_regions(_layout(spark, sf_dir)).select("doc_id", "block_no")


@query(CARDS_IN_LINES + " SELECT doc_id, block_no AS line_no, round(CAST(lw * 0.05 AS DOUBLE), 4) AS x0, round(CAST(lw * 0.95 AS DOUBLE), 4) AS x1, round(CAST(y + 0.3 AS DOUBLE), 4) AS y0 FROM r")
def e4_shrink_box(spark, sf_dir):
    hits = _boxes(spark, sf_dir).select("doc_id", "line_no")
    b = hits.join(_lines(spark, sf_dir), ["doc_id", "line_no"]).withColumn("s", geometry.shrink_box(F.col("box"), 0.1, 0.05))
    return b.select("doc_id", "line_no", F.round(F.get("s", 0)["x"], 4).alias("x0"), F.round(F.get("s", 1)["x"], 4).alias("x1"), F.round(F.get("s", 0)["y"], 4).alias("y0"))


@query(CARDS_IN_LINES + " SELECT doc_id, block_no AS line_no, round(CAST(x + 7 AS DOUBLE), 4) AS x, round(CAST(y + 9 AS DOUBLE), 4) AS y, round(CAST(w AS DOUBLE), 4) AS w, CAST(12.0 AS DOUBLE) AS h FROM r")
def e5_clip_to_page(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    clip = F.struct(F.lit(7.0).alias("x0"), F.lit(9.0).alias("y0"))
    return _flat(b.withColumn("rect", geometry.clip_to_page(F.col("rect"), clip)), "doc_id", "line_no")


_CELL_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def _cells(spark, sf_dir) -> DataFrame:
    """Line items as boxes of an order's page: five lines of boxes at places by part."""
    li = t(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_CELL_ORDER)))
    box = geometry.rect(F.col("l_partkey") % 400, (F.col("l_suppkey") % 5) * 20, F.col("l_quantity"), F.lit(12))
    return li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.col("k").alias("ord"), ((F.col("l_suppkey") % 5) * 20.0 + 6).alias("y_center"), box.alias("rect"), F.col("l_returnflag").alias("text"), F.lit("ocr").alias("source"), F.col("l_linestatus").alias("rule_name"))


CELLS = f"""cu AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_CELL_ORDER)}) AS INTEGER) AS ord,
  CAST(l_partkey % 400 AS DOUBLE) AS x, CAST(l_suppkey % 5 * 20 AS DOUBLE) AS y, l_quantity AS w, l_returnflag AS text FROM lineitem)"""


@query(f"""WITH {CELLS}, g AS (SELECT *, max(x + w) OVER (PARTITION BY doc_id, y ORDER BY x, w, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cu),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR x - reach > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, y ORDER BY x, w, ord ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT doc_id, min(x) AS x, y, max(x + w) - min(x) AS w, CAST(12 AS DOUBLE) AS h FROM i GROUP BY doc_id, y, k""")
def e6_merge_adjacent(spark, sf_dir):
    return _flat(geometry.merge_adjacent(_cells(spark, sf_dir), expected=t(spark, sf_dir, "lineitem").count()), "doc_id")


@query(HITS + """, s AS (SELECT doc_id, location, start, text, string_split(text, '4') AS gs FROM h), k AS (SELECT doc_id, location, start, text, gs, unnest(range(1, len(gs) + 1)) AS i FROM s)
SELECT doc_id, location, start, round(CAST(100.0 * length(gs[i]) / length(text) AS DOUBLE), 4) AS w, round(CAST(100.0 * (list_sum(list_transform(gs[1:i], lambda x: length(x))) - length(gs[i]) + i - 1) / length(text) AS DOUBLE), 4) AS x FROM k WHERE gs[i] <> ''""")
def e7_kept_span_rect(spark, sf_dir):
    hits = detect.find_spans(blocks(spark, sf_dir), PII).withColumn("k", F.explode(spans.kept_runs(F.col("text"), F.array(F.lit("4")))))
    r = geometry.kept_span_rect(geometry.rect(F.lit(0), F.lit(0), F.lit(100), F.lit(12)), F.col("text"), F.col("k.start"), F.col("k.end"))
    return hits.select("doc_id", "location", "start", F.round(r["w"], 4).alias("w"), F.round(r["x"], 4).alias("x"))


def _collapsed(source: str) -> str:
    """Groups of touching boxes by recursion over the boxes of a page in order."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM {source}),
st(doc_id, n, gs) AS (
  SELECT doc_id, CAST(1 AS BIGINT), [struct_pack(fx := x, fy := y, fw := w, x0 := x, y0 := y, x1 := x + w, y1 := y + 12, ord := ord, text := text)] FROM o WHERE n = 1
  UNION ALL
  SELECT s.doc_id, o.n, CASE WHEN p = 0 THEN list_append(gs, struct_pack(fx := x, fy := y, fw := w, x0 := x, y0 := y, x1 := x + w, y1 := y + 12, ord := o.ord, text := o.text))
    ELSE list_transform(gs, lambda g, k: CASE WHEN k = p THEN struct_pack(fx := g.fx, fy := g.fy, fw := g.fw, x0 := least(g.x0, x), y0 := least(g.y0, y), x1 := greatest(g.x1, x + w), y1 := greatest(g.y1, y + 12), ord := g.ord, text := g.text) ELSE g END) END
  FROM (SELECT s.doc_id, s.gs, o.*, coalesce(list_position(list_transform(gs, lambda g: NOT (g.fx + g.fw + 2 < o.x OR o.x + o.w + 2 < g.fx OR g.fy + 14 < o.y OR o.y + 14 < g.fy)), true), 0) AS p
        FROM st s JOIN o ON o.doc_id = s.doc_id AND o.n = s.n + 1) AS s(doc_id, gs, d2, ord, x, y, w, text, n, p) JOIN (SELECT 1) ON true, LATERAL (SELECT s.n AS n, s.ord AS ord, s.text AS text) AS o),
z AS (SELECT doc_id, gs FROM st QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1)"""


@query(f"WITH RECURSIVE {CELLS}, {_collapsed('cu')} SELECT doc_id, g.ord AS ord, g.text AS text, g.x0 AS x, g.y0 AS y, g.x1 - g.x0 AS w, g.y1 - g.y0 AS h FROM (SELECT doc_id, unnest(gs) AS g FROM z)")
def e8_collapse_touching(spark, sf_dir):
    return _flat(geometry.collapse_touching(_cells(spark, sf_dir)), "doc_id", "ord", "text")


def _words_as_tokens(spark, sf_dir) -> DataFrame:
    li = _cells(spark, sf_dir)
    return li.select("doc_id", "page", F.col("ord").alias("tok_no"), F.concat("text", F.col("ord").cast("string")).alias("text"), geometry.rect(F.col("rect.x") - 20, F.col("rect.y"), F.col("rect.w") + 40, F.col("rect.h")).alias("rect"))


@query(f"""WITH {CELLS} SELECT c.doc_id, c.ord, (SELECT min_by(t.text || t.ord, t.ord) FROM cu t WHERE t.doc_id = c.doc_id AND t.y = c.y AND c.x + c.w / 2 BETWEEN t.x - 20 AND t.x + t.w + 20) AS resolved FROM cu c""")
def e9_resolve_text(spark, sf_dir):
    return geometry.resolve_text(_cells(spark, sf_dir), _words_as_tokens(spark, sf_dir)).select("doc_id", "ord", "resolved")


@query(f"""WITH {CELLS}, r AS (SELECT c.doc_id, c.ord, (SELECT min_by(t.text || t.ord, t.ord) FROM cu t WHERE t.doc_id = c.doc_id AND t.y = c.y AND c.x + c.w / 2 BETWEEN t.x - 20 AND t.x + t.w + 20) AS res FROM cu c)
SELECT doc_id, ord FROM r WHERE NOT contains(res, 'A') AND NOT contains(res, '1')""")
def d3_apply_allow_list_boxes(spark, sf_dir):
    blank = _cells(spark, sf_dir).withColumn("text", F.lit(""))
    return geometry.apply_allow_list_boxes(blank, _words_as_tokens(spark, sf_dir), F.array(F.lit("A"), F.lit("1"))).select("doc_id", "ord")


@query(f"""WITH RECURSIVE {CELLS}, r AS (SELECT doc_id, ord, x - 20 AS x, y, w + 40 AS w, text FROM cu WHERE text = 'R'), {_collapsed('r')}
SELECT doc_id, g.x0 AS x, g.y0 AS y, g.x1 - g.x0 AS w, g.y1 - g.y0 AS h FROM (SELECT doc_id, unnest(gs) AS g FROM z)""")
def e10_block_list_boxes(spark, sf_dir):
    return _flat(geometry.block_list_boxes(_words_as_tokens(spark, sf_dir), spark.createDataFrame([("R",)], "term string")), "doc_id")


@query(f"WITH {CELLS} SELECT DISTINCT doc_id, x, y, round(w / 25) * 25 AS w FROM cu")
def e11_dedupe_rects(spark, sf_dir):
    c = _cells(spark, sf_dir).withColumn("rect", geometry.rect(F.col("rect.x"), F.col("rect.y"), F.round(F.col("rect.w") / 25) * 25, F.col("rect.h")))
    return geometry.dedupe_rects(c).select("doc_id", "rect.x", "rect.y", "rect.w")


# Hits of both rules as boxes of lines that are 20 apart; boxes of a line whose gap is at most 30 become one.
PAGE_BOXES = HITS + """, hb AS (SELECT h.doc_id, block_no, start * 5.5 + 1 AS x, greatest(5.0, ("end" - start) * 5.5 - 2) AS w FROM h JOIN b ON b.doc_id = h.doc_id AND b.location = h.location),
hg AS (SELECT *, max(x + w) OVER (PARTITION BY doc_id, block_no ORDER BY x, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hb),
hi AS (SELECT *, sum(CASE WHEN reach IS NULL OR x - reach > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, block_no ORDER BY x, w ROWS UNBOUNDED PRECEDING) AS k FROM hg),
pb AS (SELECT doc_id, block_no, CAST(min(x) AS DOUBLE) AS x, CAST(block_no * 20.0 AS DOUBLE) AS y, CAST(max(x + w) - min(x) AS DOUBLE) AS w FROM hi GROUP BY doc_id, block_no, k)"""


@query(PAGE_BOXES + " SELECT doc_id, 0 AS page, round(x, 4) AS x, y, round(w, 4) AS w, CAST(12 AS DOUBLE) AS h FROM pb")
def page_scan(spark, sf_dir):
    return _flat(pipelines.page_scan(_lines(spark, sf_dir), PII), "doc_id", "page")


def _table(spark, *terms: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in terms], "term string")


def _line_tokens(spark, sf_dir) -> DataFrame:
    """The words of each line as tokens, with boxes by their places."""
    words = _lines(spark, sf_dir).select("doc_id", "page", "line_no", F.split("text", " ").alias("w"))
    ends = spans.running_sum(F.transform("w", lambda w: F.length(w) + 1))
    own = words.withColumn("e", ends).select("doc_id", "page", "line_no", F.posexplode(F.arrays_zip("w", "e")).alias("i", "k")).filter("k.w <> ''")
    box = geometry.rect((F.col("k.e") - 1 - F.length("k.w")) * 5.5, F.col("line_no") * 20.0, F.length("k.w") * 5.5, F.lit(12))
    return own.select("doc_id", "page", (F.col("line_no").cast("long") * 1000000 + F.col("i")).alias("tok_no"), F.col("k.w").alias("text"), box.alias("rect"))


_ALLOWED, _BLOCKED = ("mail", "password"), ("token", "password", "secret")


def _page_lists(spark, sf_dir, decisions: DataFrame | None = None) -> pipelines.Settings:
    return pipelines.Settings(PII, allow=_table(spark, *_ALLOWED), block=_table(spark, *_BLOCKED), decisions=decisions)


def _quality_decisions(hits: DataFrame, spark, sf_dir) -> DataFrame:
    """A decision for each hit (doc_id, hit_id) of a labelled document: confirmed where the document is good, else ignored."""
    good = t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return hits.select("doc_id", "hit_id").join(good, "doc_id").select("hit_id", F.when(F.col("quality") == 1, "confirm").otherwise("ignore").alias("action")).distinct()


# A box of a rule goes if the first word that holds its middle holds an allowed term; a word's box is listed under its first blocked
# term (by code points), in which only ``password`` is allowed, and with it all of the box's text.
PAGE_LISTS = PAGE_BOXES + QUALITY + """, tw AS (SELECT doc_id, block_no, i, ws[i] AS text, CAST((list_sum(list_transform(ws[1:i], lambda x: length(x))) - length(ws[i]) + i - 1) * 5.5 AS DOUBLE) AS x, CAST(length(ws[i]) * 5.5 AS DOUBLE) AS w
  FROM (SELECT doc_id, block_no, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, block_no, string_split(text, ' ') AS ws FROM b WHERE contains(text, 'token') OR contains(text, 'secret') OR contains(text, 'password') OR EXISTS (SELECT 1 FROM pb WHERE pb.doc_id = b.doc_id AND pb.block_no = b.block_no))) WHERE ws[i] <> ''),
ro AS (SELECT pb.doc_id, pb.block_no, pb.x, pb.w, min_by(tw.text, tw.i) AS word FROM pb LEFT JOIN tw ON tw.doc_id = pb.doc_id AND tw.block_no = pb.block_no AND pb.x + pb.w / 2 BETWEEN tw.x AND tw.x + tw.w GROUP BY ALL),
al AS (SELECT doc_id, block_no, x, w, 'ocr' AS source FROM ro WHERE word IS NULL OR NOT contains(word, 'mail') AND NOT contains(word, 'password')
  UNION ALL SELECT doc_id, block_no, x, w, 'blacklist' FROM tw WHERE (contains(text, 'token') OR contains(text, 'secret')) AND NOT contains(text, 'password'))"""


@query(PAGE_LISTS + """ SELECT al.doc_id, 0 AS page, round(x, 4) AS x, CAST(block_no * 20.0 AS DOUBLE) AS y, round(w, 4) AS w, CAST(12 AS DOUBLE) AS h, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
FROM al LEFT JOIN lq ON lq.doc_id = al.doc_id WHERE quality IS NULL OR quality = 1 GROUP BY al.doc_id, block_no, x, w""")
def page_scan_with_lists(spark, sf_dir):
    """A page scan with allow list, block list and decisions; the decisions are those on the scan's own boxes in documents with a label."""
    lines, tokens = _lines(spark, sf_dir), _line_tokens(spark, sf_dir)
    hits = stored(pipelines.page_hits(lines, _page_lists(spark, sf_dir), tokens), "boxes")  # one scan serves the decisions and the result
    out = pipelines.by_box(pipelines.decided(hits, _quality_decisions(pipelines.with_page_id(hits), spark, sf_dir)))
    return _flat(out.withColumn("sources", F.array_join("sources", ",")), "doc_id", "page", "sources")


# ---- conflicts and rendering ---------------------------------------------------------------------------------------

# In these two rules' hits nothing overlaps in one block unless a card stands inside an address, so the plan is the hits
# without those that a better one overlaps; rule order is e-mail, card.
KEPT = HITS + """, pl AS (SELECT * FROM h a WHERE rule_ord = 3 OR NOT EXISTS (SELECT 1 FROM h b WHERE b.rule_ord = 3 AND b.doc_id = a.doc_id AND b.location = a.location AND b.start < a."end" AND a.start < b."end"))"""
CUT = """, cut AS (SELECT doc_id, location, start, "end", row_number() OVER w AS k, coalesce(lag("end") OVER w, 0) AS before, count(*) OVER (PARTITION BY doc_id, location) AS n FROM pl WINDOW w AS (PARTITION BY doc_id, location ORDER BY start)),
rd AS (SELECT b.doc_id, b.location, coalesce((SELECT string_agg(substr(b.text, CAST(before + 1 AS BIGINT), CAST(start - before AS BIGINT)) || '*', '' ORDER BY k) || substr(b.text, CAST(max("end") + 1 AS BIGINT)) FROM cut WHERE cut.doc_id = b.doc_id AND cut.location = b.location), b.text) AS redacted FROM b)"""
RENDERED = KEPT + CUT


def _settings() -> pipelines.Settings:
    return pipelines.Settings(PII)


@query(KEPT + ' SELECT doc_id, location, start, "end", rule_name FROM pl')
def f1_resolve_overlaps(spark, sf_dir):
    plan = resolve.resolve_overlaps(detect.find_spans(blocks(spark, sf_dir), PII))
    return plan.select("doc_id", "location", F.explode("plan").alias("p")).select("doc_id", "location", "p.start", "p.end", "p.rule_name")


@query(RENDERED + " SELECT doc_id, location, redacted FROM rd")
def word_scan(spark, sf_dir):
    return pipelines.word_scan(blocks(spark, sf_dir), _settings()).select("doc_id", "location", "redacted")


# Rule hits are cut where allowed terms stand; blocked terms rank behind every rule; ignored are all hits of documents labelled bad.
SCAN_LISTS = HITS + QUALITY + """, hr AS (SELECT doc_id, location, start, rule_ord, unnest(range(1, len(gs) + 1)) AS i, gs, ms FROM (SELECT *, string_split_regex(text, 'mail|password') AS gs, regexp_extract_all(text, 'mail|password') AS ms FROM h)),
tm AS (SELECT unnest(['token', 'secret']) AS term), tp AS (SELECT doc_id, location, term, string_split(text, term) AS gs FROM b JOIN tm ON contains(text, term)), tk AS (SELECT doc_id, location, term, gs, unnest(range(1, len(gs))) AS i FROM tp),
al AS (SELECT doc_id, location, CAST(start + list_sum(list_transform(gs[1:i], lambda x: length(x))) - length(gs[i]) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start, length(gs[i]) AS n, rule_ord FROM hr WHERE gs[i] <> ''
  UNION ALL SELECT doc_id, location, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + (i - 1) * length(term) AS INTEGER), length(term), 1000 FROM tk),
kp AS (SELECT al.doc_id, location, start, CAST(start + n AS INTEGER) AS "end", rule_ord FROM al LEFT JOIN lq ON lq.doc_id = al.doc_id WHERE quality IS NULL OR quality = 1),
pl AS (SELECT * FROM kp a WHERE NOT EXISTS (SELECT 1 FROM kp b WHERE b.doc_id = a.doc_id AND b.location = a.location AND b.start < a."end" AND a.start < b."end" AND b.rule_ord < a.rule_ord))""" + CUT


@query(SCAN_LISTS + " SELECT doc_id, location, redacted FROM rd")
def word_scan_with_lists(spark, sf_dir):
    """A text scan with allow list, block list and decisions; the decisions are those on the scan's own hits in documents with a label."""
    b = blocks(spark, sf_dir)
    hits = overrides.with_hit_id(pipelines.word_hits(b, _page_lists(spark, sf_dir)), "doc_id")
    return pipelines.word_scan(b, _page_lists(spark, sf_dir, _quality_decisions(hits, spark, sf_dir))).select("doc_id", "location", "redacted")


@query(RENDERED + " SELECT doc_id, location, redacted FROM rd")
def f3_render_redacted(spark, sf_dir):
    return pipelines.redact_rows(blocks(spark, sf_dir), PII).select("doc_id", "location", "redacted")


@query(ORACLE_SQL["f3_render_redacted"])
def a9_write_redacted(spark, sf_dir):
    """Two batches, one of them delivered twice, and a try that was broken off before it was committed: the sink gives each row once."""
    home, rows = own_dir(spark, "sink"), f3_render_redacted(spark, sf_dir)
    half = F.pmod(F.xxhash64("doc_id", "location"), F.lit(2))
    for k in (0, 1, 0):
        sink.write_once(rows.filter(half == k), home, "run", k)
    rows.filter(half == 1).write.parquet(f"{home}/data/run_id=run/batch_id=2/try=broken")
    return sink.read_committed(spark, home, rows.schema)


RULES = [
    {"rule_index": 0, "enabled": True, "mode": "regex", "find": "th[a-z]", "replace": "<R>"},
    {"rule_index": 1, "enabled": True, "mode": "exact", "find": "the", "replace": "<E>"},
    {"rule_index": 2, "enabled": False, "mode": "exact", "find": "and", "replace": "-"},
]
# Exact beats regex wherever both stand: first the exact ones, then the regex on what is left between them.
REPLACED = "rp AS (SELECT doc_id, location, block_no, text, array_to_string(list_transform(string_split(text, 'the'), lambda s: regexp_replace(s, 'th[a-z]', '<R>', 'g')), '<E>') AS redacted FROM b)"


@query(f"WITH {BLOCKS}, {REPLACED} SELECT doc_id, location, redacted FROM rp")
def f10_batch_replace(spark, sf_dir):
    return resolve.batch_replace(blocks(spark, sf_dir), RULES).select("doc_id", "location", "redacted")


@query(f"""WITH {BLOCKS} SELECT doc_id, CAST(sum(len(string_split(text, 'the')) - 1) AS BIGINT) AS exact, CAST(sum(len(regexp_extract_all(text, 'th[a-z]'))) AS BIGINT) AS regex FROM b GROUP BY doc_id""")
def f2_match_replace_rules(spark, sf_dir):
    b = blocks(spark, sf_dir)
    n = resolve.match_replace_rules(b, RULES).groupBy("doc_id").agg(F.count_if(F.col("rule_ord") == 1).alias("exact"), F.count_if(F.col("rule_ord") == 0).alias("regex"))
    return b.select("doc_id").distinct().join(n, "doc_id", "left").na.fill(0, ["exact", "regex"])


SEGMENTS = KEPT + """, w AS (SELECT pl.*, t.text AS bt, row_number() OVER w AS k, coalesce(lag("end") OVER w, 0) AS before FROM pl JOIN b t ON t.doc_id = pl.doc_id AND t.location = pl.location WINDOW w AS (PARTITION BY pl.doc_id, pl.location ORDER BY start)),
sg AS (SELECT doc_id, location, 2 * k - 1 AS o, 'text' AS kind, substr(bt, CAST(before + 1 AS BIGINT), CAST(start - before AS BIGINT)) AS original, substr(bt, CAST(before + 1 AS BIGINT), CAST(start - before AS BIGINT)) AS shown FROM w WHERE start > before
 UNION ALL SELECT doc_id, location, 2 * k, 'replacement', text, '*' FROM w
 UNION ALL SELECT doc_id, location, 1000000, 'text', substr(bt, max("end") + 1), substr(bt, max("end") + 1) FROM w GROUP BY doc_id, location, bt HAVING length(bt) > max("end")
 UNION ALL SELECT doc_id, location, 1, 'text', text, text FROM b WHERE text <> '' AND NOT EXISTS (SELECT 1 FROM pl WHERE pl.doc_id = b.doc_id AND pl.location = b.location))"""


def _planned(spark, sf_dir) -> DataFrame:
    return pipelines.word_scan(blocks(spark, sf_dir), _settings())


@query(SEGMENTS + " SELECT doc_id, location, CAST(row_number() OVER (PARTITION BY doc_id, location ORDER BY o) - 1 AS INTEGER) AS seg_no, kind, shown AS text FROM sg")
def f4_replaced_segments(spark, sf_dir):
    return resolve.replaced_segments(_planned(spark, sf_dir)).select("doc_id", "location", "seg_no", "kind", "text")


@query(SEGMENTS + " SELECT doc_id, location, CAST(row_number() OVER (PARTITION BY doc_id, location ORDER BY o) - 1 AS INTEGER) AS seg_no, kind, original AS text FROM sg")
def f5_highlight_segments(spark, sf_dir):
    return resolve.highlight_segments(_planned(spark, sf_dir)).select("doc_id", "location", "seg_no", "kind", "text")


def _selections(spark, sf_dir) -> DataFrame:
    """The first word of every document's first line, selected by hand."""
    w = F.get(F.split("text", " "), 0)
    return blocks(spark, sf_dir).filter("block_no = 0").select("doc_id", "location", F.lit(0).alias("start"), F.length(w).alias("end"), w.alias("text"), F.lit("#").alias("replacement")).filter("text <> ''")


SELECTED = f"WITH {BLOCKS}, sl AS (SELECT doc_id, location, string_split(text, ' ')[1] AS word FROM b WHERE block_no = 0 AND string_split(text, ' ')[1] <> '')"


@query(SELECTED + " SELECT doc_id, location, 0 AS start, CAST(length(word) AS INTEGER) AS \"end\", word AS text, 'manual' AS source FROM sl")
def f6_manual_exact(spark, sf_dir):
    return resolve.manual_exact(_selections(spark, sf_dir)).select("doc_id", "location", "start", "end", "text", "source")


GLOBAL = SELECTED + """, gl AS (SELECT doc_id, location, word, gs, unnest(range(1, len(gs))) AS i FROM (SELECT b.doc_id, b.location, word, string_split(b.text, word) AS gs FROM b JOIN sl ON sl.doc_id = b.doc_id WHERE contains(b.text, word))),
gm AS (SELECT doc_id, location, word AS text, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + (i - 1) * length(word) AS INTEGER) AS start FROM gl)"""


@query(GLOBAL + " SELECT doc_id, location, start, text FROM gm")
def f7_manual_global(spark, sf_dir):
    return resolve.manual_global(_selections(spark, sf_dir), blocks(spark, sf_dir)).select("doc_id", "location", "start", "text")


@query(GLOBAL + QUALITY + " SELECT gm.doc_id, location, start, text FROM gm LEFT JOIN lq ON lq.doc_id = gm.doc_id WHERE quality IS NULL OR quality = 1 AND NOT (location = 'paragraph_0' AND start = 0)")
def f8_undo_manual(spark, sf_dir):
    s = _selections(spark, sf_dir)
    good = t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    undone = s.join(good, "doc_id").withColumn("mode", F.when(F.col("quality") == 0, "global"))
    return resolve.undo_manual(resolve.manual_global(s, blocks(spark, sf_dir)), undone).select("doc_id", "location", "start", "text")


@query(RENDERED + " SELECT doc_id, location, redacted FROM rd")
def f9_project_to_runs(spark, sf_dir):
    """Blocks cut into runs of 25 characters, redacted run by run and put together again."""
    p = _planned(spark, sf_dir)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(25)))
    runs = p.select("doc_id", "location", "text", at.alias("start")).select("doc_id", "location", F.col("start").alias("run_no"), "start", F.least(F.col("start") + 25, F.length("text")).alias("end"), F.substring(F.col("text"), F.col("start") + 1, F.lit(25)).alias("text"), F.lit("plain").alias("style"))
    out = resolve.project_to_runs(p.select("doc_id", "location", "plan"), runs)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_no", "redacted"))), lambda x: x["redacted"]), "")
    return out.groupBy("doc_id", "location").agg(whole.alias("redacted"))


# ---- reports -------------------------------------------------------------------------------------------------------


@query(f"WITH {BLOCKS} SELECT doc_id, CAST(count(*) FILTER (WHERE block_no < 5) AS BIGINT) AS processed_items, CAST(count(*) AS BIGINT) AS total_items, max(block_no) >= 5 AS cancelled FROM b GROUP BY doc_id")
def g1_scan_meta(spark, sf_dir):
    return report.scan_meta(blocks(spark, sf_dir).withColumn("processed", F.col("block_no") < 5))


COUNTS = KEPT + ", cn AS (SELECT doc_id, rule_ord AS rule_index, CAST(count(*) AS BIGINT) AS \"count\" FROM pl GROUP BY doc_id, rule_ord)"


def _counts(spark, sf_dir) -> DataFrame:
    return report.rule_counts(pipelines.redact_rows(blocks(spark, sf_dir), PII))


@query(COUNTS + ' SELECT rule_index, doc_id, CAST(sum("count") AS BIGINT) AS "count" FROM cn GROUP BY ROLLUP (rule_index, doc_id)')
def g2_rule_counts(spark, sf_dir):
    return report.rule_totals(_counts(spark, sf_dir))


@query(COUNTS + """ SELECT r.rule_index, coalesce((SELECT string_agg(doc_id || ':' || "count", ', ' ORDER BY doc_id) FROM cn WHERE cn.rule_index = r.rule_index), 'no hit this run') AS docs FROM (SELECT unnest([3, 4, 99]) AS rule_index) r""")
def g3_rule_summary(spark, sf_dir):
    rows = spark.createDataFrame([(3, "e-mail"), (4, "card"), (99, "nothing")], "rule_index int, find string")
    return report.rule_summary(rows, _counts(spark, sf_dir)).select("rule_index", "docs")


@query(COUNTS + """, nr AS (SELECT rule_index, doc_id, "count", (row_number() OVER (PARTITION BY rule_index ORDER BY doc_id) - 1) // 5 AS chunk FROM cn),
ch AS (SELECT rule_index, chunk, count(*) AS n_docs, string_agg(doc_id || ':' || "count", ', ' ORDER BY doc_id) AS docs FROM nr GROUP BY ALL)
SELECT r.rule_index, coalesce(chunk, 0) AS chunk, coalesce(n_docs, 0) AS n_docs, coalesce(docs, 'no hit this run') AS docs FROM (SELECT unnest([3, 4, 99]) AS rule_index) r LEFT JOIN ch ON ch.rule_index = r.rule_index""")
def g3_rule_chunks(spark, sf_dir):
    rows = spark.createDataFrame([(3, "e-mail"), (4, "card"), (99, "nothing")], "rule_index int, find string")
    return report.rule_chunks(rows, _counts(spark, sf_dir), 5).select("rule_index", "chunk", "n_docs", "docs")


def _results(spark, sf_dir) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("doc_id").cast("int").alias("ord"), F.when(F.col("n_chars") % 7 == 0, "failed").otherwise("success").alias("status"))


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE n_chars % 7 <> 0) AS BIGINT) AS success, CAST(count(*) FILTER (WHERE n_chars % 7 = 0) AS BIGINT) AS failed FROM documents")
def g4_batch_summary(spark, sf_dir):
    return report.batch_summary(_results(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 'failed' ELSE 'success' END AS status FROM documents ORDER BY status, doc_id")
def g5_order_results(spark, sf_dir):
    return report.order_results(_results(spark, sf_dir)).select("doc_id", "status")


@query("SELECT doc_id FROM documents WHERE n_chars % 7 = 0")
def g6_filter_results(spark, sf_dir):
    return report.filter_results(_results(spark, sf_dir), "failed").select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE n_chars % 7 = 0")
def g7_retry_set(spark, sf_dir):
    return report.retry_set(t(spark, sf_dir, "documents").select("doc_id", "source"), _results(spark, sf_dir))


@query(HITS + " SELECT source, rule_name, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT text) AS BIGINT) AS texts, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM (SELECT *, 'rule' AS source FROM h) GROUP BY CUBE (source, rule_name)")
def g9_hit_profile(spark, sf_dir):
    return report.hit_profile(detect.find_spans(blocks(spark, sf_dir), PII))


@query("SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_partkey")
def g10_first_seen(spark, sf_dir):
    return rules.first_seen(t(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey"), ["l_partkey"], "l_orderkey")
