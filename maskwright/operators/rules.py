"""Rules, keywords and term lists as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.spans import FLAGS

#: Pattern of the rule that stands for detection in images; it is no text pattern.
SEAL = "__SEAL_DETECTION__"


@dataclass(frozen=True)
class Rule:
    rule_ord: int
    rule_name: str
    pattern: str
    enabled: bool = True
    description: str = ""


# Names and patterns of the default rules.
DEFAULT_RULES = (
    Rule(0, "身份证号", r"(?<!\d)([1-9]\d{5}(19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{3}[\dXx]|\d{15})(?!\d)", True, "15- or 18-character national id"),
    Rule(1, "手机号码", r"(?<!\d)(1[3-9]\d{9})(?!\d)", True, "mobile number"),
    Rule(2, "日期时间", r"\d{4}[年\-\.]\d{1,2}[月\-\.]\d{1,2}[日]?", True, "date"),
    Rule(3, "电子邮箱", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", True, "e-mail address"),
    Rule(4, "银行卡号", r"(?<!\d)([1-9]\d{12,18})(?!\d)", True, "bank card of 13 to 19 digits"),
    Rule(5, "印章", SEAL, False, "seal in an image"),
    Rule(6, "地址（含门牌号）", r"[一-龥]{2,15}(?:省|市|自治区|特别行政区)[一-龥\d\s,]{4,40}\d+号", True, "address that ends in a house number"),
    Rule(7, "固定电话", r"(?<!\d)0\d{2,3}[-\s]?[\d\w]{7,8}(?!\d)", True, "landline"),
    Rule(8, "法定代表人", r"法定代表人\s*[::：]?\s*[一-龥]{2,4}(?:·[一-龥]{2,4})?", True, "labelled legal representative"),
)
#: What a text must hold for a default rule to match in it: a literal, or a pattern (first character ~) that is cheaper than the rule's.
GUARDS = dict(zip((r.pattern for r in DEFAULT_RULES), (r"~\d{15}", r"~1[3-9]\d{9}", r"~\d{4}[年\-\.]", "@", r"~\d{13}", "", "号", "0", "法定代表人")))
RULE_SCHEMA = "rule_ord int, rule_name string, pattern string, enabled boolean, description string"


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the first by ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def keywords_to_rules(df: DataFrame, col: str, payload: list[str] | None = None) -> DataFrame:
    """A keyword field, cut at white space, as rules that match each keyword literally: payload columns, rule_ord, rule_name, pattern."""
    parts = F.filter(F.split(F.trim(F.col(col)), r"\s+"), lambda w: w != "")
    words = df.select(*(payload or []), F.posexplode(parts).alias("rule_ord", "rule_name"))
    return words.withColumn("pattern", F.concat(F.lit("\\Q"), "rule_name", F.lit("\\E")))


def active_rule_table(rules: DataFrame) -> DataFrame:
    """The rules that are searched for: enabled, not blank, not the seal's, valid (Java syntax) and never empty matches.

    Each pattern is compiled in its row's task, so a table may have any number of rules. Java calls all that stops it from compiling, too
    deep a nesting included, an error of syntax.
    """
    on = rules.filter(F.coalesce("enabled", F.lit(True)) & (F.trim("pattern") != "") & (F.col("pattern") != SEAL))
    flagged = F.concat(F.lit(FLAGS), F.col("pattern"))
    tried = on.withColumn("_compiles", F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), flagged).isNotNull())
    return tried.filter(F.when(F.col("_compiles"), ~F.regexp_like(F.lit(""), flagged)).otherwise(F.lit(False))).drop("_compiles")


def active_rules(rules: DataFrame) -> list[Rule]:
    """The rules of ``active_rule_table`` in order, as settings of a scan, which are few."""
    rows = active_rule_table(rules).orderBy("rule_ord").collect()
    return [Rule(r["rule_ord"], r["rule_name"], r["pattern"], True, r["description"] or "") for r in rows]


def default_rules(spark) -> DataFrame:
    return spark.createDataFrame([(r.rule_ord, r.rule_name, r.pattern, r.enabled, r.description) for r in DEFAULT_RULES], RULE_SCHEMA)


def normalize_replace_rules(rules: DataFrame, default: str = "*") -> DataFrame:
    """Replace rules with blank ``find`` dropped, unknown modes read as exact and blank replacements as the default."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return rules.filter(~blank("find")).withColumns({"mode": F.when(F.col("mode").isin("exact", "regex"), F.col("mode")).otherwise("exact"), "replace": F.when(blank("replace"), F.lit(default)).otherwise(F.col("replace"))})


def sanitize_terms(df: DataFrame, col: str = "term") -> DataFrame:
    """Terms trimmed; null and blank ones dropped."""
    return df.withColumn(col, F.trim(F.col(col))).filter(F.col(col) != "")


def layer_rank() -> Column:
    return F.when(F.col("layer") == "permanent", 0).otherwise(1)


#: Places of a list that are numbered in one task.
PLACES = 10_000


def effective_terms(terms: DataFrame, places: int = PLACES) -> DataFrame:
    """Terms of both layers, permanent ones first, each once at its first place: list, term, ord (from 1).

    A list is numbered in stretches of ``places`` places of a layer; only the stretches' sizes are summed up over a whole list.
    """
    first = sanitize_terms(terms).groupBy("list", "term").agg(F.min(F.struct(layer_rank().alias("rank"), "ord")).alias("k"))
    stretched = first.select("list", "term", "k.rank", "k.ord", F.floor(F.col("k.ord") / places).alias("stretch"))
    sizes = stretched.groupBy("list", "rank", "stretch").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("list").orderBy("rank", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("list").alias("_l"), F.col("rank").alias("_r"), F.col("stretch").alias("_s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("list", "rank", "stretch").orderBy("ord", "term"))
    same = F.col("list").eqNullSafe(F.col("_l")) & (F.col("rank") == F.col("_r")) & F.col("stretch").eqNullSafe(F.col("_s"))
    return stretched.withColumn("own", own).join(before, same).select("list", "term", (F.col("before") + F.col("own")).cast("int").alias("ord"))


def add_terms(terms: DataFrame, more: DataFrame) -> DataFrame:
    """More session terms at the end of their lists (those already there stay where they are). ``more``: list, term, ord."""
    new = sanitize_terms(more).join(terms.filter("layer = 'session'"), ["list", "term"], "left_anti")
    return terms.unionByName(first_seen(new.withColumn("layer", F.lit("session")), ["list", "term"], "ord"))


def remove_terms(terms: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the given session terms; unknown ones change nothing. ``gone``: list, term."""
    return terms.join(gone.select("list", "term", F.lit("session").alias("layer")).distinct(), ["list", "term", "layer"], "left_anti")


def update_permanent(terms: DataFrame, permanent: DataFrame) -> DataFrame:
    """The permanent layer replaced; the session layer stays. ``permanent``: list, term, ord."""
    return terms.filter("layer <> 'permanent'").unionByName(sanitize_terms(permanent).withColumn("layer", F.lit("permanent")).select(terms.columns))


SOURCES = ("rule", "ocr", "jieba", "seal", "blacklist", "manual")


def valid_hit() -> Column:
    return F.coalesce(F.col("source").isin(*SOURCES) & (F.col("end") >= F.col("start")), F.lit(False))


def validate_hits(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits of a known source whose end is not before their start, and the others."""
    return hits.filter(valid_hit()), hits.filter(~valid_hit())


def validate_rules(rules: DataFrame) -> DataFrame:
    """Problems of a rule table: path, message."""
    path = F.concat_ws(".", F.lit("rules"), "rule_name")
    found = F.filter(
        F.array(
            F.when(F.coalesce(F.trim("rule_name"), F.lit("")) == "", F.lit("name is empty")),
            F.when(F.coalesce(F.trim("pattern"), F.lit("")) == "", F.lit("pattern is empty")),
            F.when(F.col("rule_ord").isNull() | (F.col("rule_ord") < 0), F.lit("order is out of range")),
        ),
        lambda m: m.isNotNull(),
    )
    return rules.select(path.alias("path"), F.explode(found).alias("message"))
