import datetime as dt
import re
import time

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.functions import spans
from maskwright.operators import detect, names
from maskwright.operators.rules import DEFAULT_RULES, Rule, active_rule_table, active_rules, default_rules, keywords_to_rules, normalize_replace_rules
from maskwright.plans import queries

TEXTS = [
    "身份证 110101199003074513 号",
    "旧证110101900307451。",
    "尾号 11010119900307451x 与 11010119900307451X",
    "电话13812345678，长串138123456789不算",
    "卡号 6222020200112233445 与 123456789012345678901",
    "😀 mail a.b+c@Example.co.uk, x@y.z",
    "固话 010-62407159 与 021-6240715O",
    "法定代表人：张三丰 法定代表人:李四·王五 代表人王二",
    "江苏省南京市鼓楼区中山路88号",
    "日期 2024年06月30日 2024-6-3 2024/06/30",
    "",
    None,
]


def hits(spark, texts, rules):
    df = spark.createDataFrame([(i, "b", x) for i, x in enumerate(texts)], "doc_id long, location string, text string")
    return {(r["doc_id"], r["rule_name"], r["start"], r["end"], r["text"]) for r in detect.find_spans(df, rules).collect()}


def test_default_rules_match_python(spark):
    rules = active_rules(default_rules(spark))
    assert [r.rule_ord for r in rules] == [0, 1, 2, 3, 4, 6, 7, 8]
    want = {(i, r.rule_name, m.start(), m.end(), m[0]) for i, x in enumerate(TEXTS) for r in rules for m in re.finditer(r.pattern, x or "", re.I)}
    assert hits(spark, TEXTS, rules) == want
    assert {n for _, n, *_ in want} == {r.rule_name for r in rules}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1 😀é\n", max_size=30), min_size=1, max_size=5))
def test_find_all_is_finditer(spark, texts):
    rules = [Rule(0, "r", "a+b?"), Rule(1, "d", r"\d1|1")]
    assert hits(spark, texts, rules) == {(i, r.rule_name, m.start(), m.end(), m[0]) for i, x in enumerate(texts) for r in rules for m in re.finditer(r.pattern, x, re.I)}


def test_no_rules_no_rows(spark):
    assert hits(spark, ["abc"], []) == set()


def test_invalid_and_empty_patterns_are_no_rules(spark):
    rows = [(0, "a", "[", True, ""), (1, "b", "x*", True, ""), (2, "c", "", True, ""), (3, "d", "__SEAL_DETECTION__", True, ""), (4, "e", "ok", None, None), (5, "f", "off", False, "")]
    df = spark.createDataFrame(rows, "rule_ord int, rule_name string, pattern string, enabled boolean, description string")
    assert [r.rule_name for r in active_rules(df)] == ["e"]


def test_any_number_of_rules(spark):
    kinds = F.element_at(F.array(*map(F.lit, ["[", "x*", "a(?=b)", r"\\Qa.b", "(?<n>a)|"])), (F.col("id") % 5 + 1).cast("int"))
    table = spark.range(200_000).select(F.col("id").cast("int").alias("rule_ord"), F.col("id").cast("string").alias("rule_name"), F.concat(kinds, F.when(F.col("id") % 5 == 3, F.col("id").cast("string")).otherwise("")).alias("pattern"), F.lit(True).alias("enabled"), F.lit("").alias("description"))
    began = time.time()
    assert active_rule_table(table).agg(F.count("*"), F.count_if(~(F.col("rule_ord") % 5).isin(2, 3))).first() == (80_000, 0)
    assert time.time() - began < 20  # 200,000 calls from the driver took longer


def test_pattern_too_deep_to_compile_is_no_rule(spark):
    rows = [(0, "a", "(" * 500_000 + "x" + ")" * 500_000, True, ""), (1, "b", "x", True, "")]
    assert [r.rule_name for r in active_rules(spark.createDataFrame(rows, "rule_ord int, rule_name string, pattern string, enabled boolean, description string"))] == ["b"]


def test_keywords(spark):
    df = spark.createDataFrame([(1, "  a.b  C\\E+ "), (2, "")], "k int, kw string")
    assert [(r["k"], r["rule_name"]) for r in keywords_to_rules(df, "kw", ["k"]).orderBy("k", "rule_ord").collect()] == [(1, "a.b"), (1, "C\\E+")]
    b = spark.createDataFrame([(1, "p", "A.b axb a.B")], "doc_id long, location string, text string")
    assert sorted(r["start"] for r in detect.find_keywords(b, ["a.b", "a.b", " "]).collect()) == [0, 8]


def test_normalize_replace_rules(spark):
    df = spark.createDataFrame([(0, True, "exact", " ", "x"), (1, True, "fuzzy", "a", ""), (2, True, "regex", "b", None), (3, True, None, "c", "y")], "rule_index int, enabled boolean, mode string, find string, replace string")
    assert [(r["rule_index"], r["mode"], r["replace"]) for r in normalize_replace_rules(df).orderBy("rule_index").collect()] == [(1, "exact", "*"), (2, "regex", "*"), (3, "exact", "y")]


@pytest.mark.parametrize("limit", [1000, 1])
def test_block_list_is_case_sensitive_both_ways(spark, monkeypatch, limit):
    monkeypatch.setattr(detect, "MAX_TERMS", limit)
    b = spark.createDataFrame([(1, "p", "abab AB a.b"), (2, "p", "x"), (3, "p", None)], "doc_id long, location string, text string")
    t = spark.createDataFrame([("ab",), ("a.b",), ("",), ("zz",), ("ab",)], "term string")
    got = {(r["doc_id"], r["start"], r["text"], r["rule_name"], r["source"]) for r in detect.scan_block_list(b, t).collect()}
    assert got == {(1, 0, "ab", "黑名单:ab", "blacklist"), (1, 2, "ab", "黑名单:ab", "blacklist"), (1, 8, "a.b", "黑名单:a.b", "blacklist")}


def test_unique_then_expand_hits_refused_occurrences(spark):
    b = spark.createDataFrame([(1, "page_0", "13812345678 x138123456789"), (2, "page_0", "  ")], "doc_id long, location string, text string")
    rows = detect.unique_then_expand(b, [r for r in DEFAULT_RULES if r.rule_ord == 1]).orderBy("start").collect()
    assert [(r["start"], r["rule_name"], r["ord"]) for r in rows] == [(0, "13812345678", 0), (13, "13812345678", 0)]


def test_lines_of_pages_with_a_text_are_not_moved(spark):
    pages = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(0).alias("page"), F.when(F.col("id") % 100 == 0, F.lit("")).otherwise(F.lit("x" * 60)).alias("text"), F.when(F.col("id") != 100, True).alias("has_images"))
    lines = pages.select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("line_no")).withColumn("text", F.col("line_no").cast("string"))
    out = names.name_source_text(pages, lines)
    assert out.columns == pages.columns and out.count() == 1000
    want = "\n".join(map(str, range(21)))
    assert {r["doc_id"]: r["text"] for r in out.filter("doc_id % 100 = 0").collect()} == {k: "" if k == 100 else want for k in range(0, 1000, 100)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan and "SortMergeJoin" not in plan


def test_names(spark):
    rows = [("王小明", "nr"), ("王小明", "nr"), ("李", "nr"), ("原告", "nr"), ("陈述", "nrt"), ("赵钱孙李周", "nr"), ("张三", "n"), ("司马光", "nrfg")]
    tok = spark.createDataFrame([(1, "p", i, w, f) for i, (w, f) in enumerate(rows)], "doc_id long, location string, tok_no int, word string, flag string")
    sur = spark.createDataFrame([(c,) for c in "王李陈赵张司"], "ch string")
    exc = spark.createDataFrame([("陈述",)], "word string")
    got = names.name_candidates(tok, sur, exc)
    assert {(r["word"], r["ord"]) for r in got.collect()} == {("王小明", 0), ("司马光", 7)}
    b = spark.createDataFrame([(1, "p", "王小明与王小明"), (1, "q", "王小明"), (2, "p", "司马光")], "doc_id long, location string, text string")
    assert {(r["location"], r["start"], r["source"]) for r in names.inject_names(b, got, ["司马光"]).collect()} == {("p", 0, "jieba"), ("p", 4, "jieba")}


def test_name_source_text(spark):
    pages = spark.createDataFrame([(1, 0, "short", True), (2, 0, "short", False), (3, 0, "x" * 60, True), (4, 0, None, True)], "doc_id long, page int, text string, has_images boolean")
    lines = spark.createDataFrame([(1, 0, 1, "b"), (1, 0, 0, "a"), (3, 0, 0, "z")], "doc_id long, page int, line_no int, text string")
    assert {r["doc_id"]: r["text"] for r in names.name_source_text(pages, lines).collect()} == {1: "a\nb", 2: "short", 3: "x" * 60, 4: None}


def test_channels_sources_and_rule_names(spark):
    pages = spark.createDataFrame([(1, 0, "t"), (2, 0, " "), (3, 0, None), (4, 0, "t")], "doc_id long, page int, text string")
    img = spark.createDataFrame([(1, 0), (1, 0), (2, 0)], "doc_id long, page int")
    assert {(r["doc_id"], r["channel"]) for r in detect.pick_channels(pages, img).collect()} == {(1, "text"), (1, "image"), (2, "image"), (3, "page"), (4, "text")}
    kinds = spark.createDataFrame([(c, k) for c in ("word", "page", "image") for k in ("rule", "keyword", "name")], "c string, k string")
    got = {(r["c"], r["k"]): r["s"] for r in kinds.select("c", "k", detect.tag_source(F.col("c"), F.col("k")).alias("s")).collect()}
    assert [got["word", k] for k in ("rule", "keyword", "name")] == ["rule", "rule", "jieba"]
    assert [got["page", k] for k in ("rule", "keyword", "name")] == ["rule", "ocr", "jieba"]
    assert got["image", "rule"] == "ocr"
    hits_ = spark.createDataFrame([(1, "p1", ""), (2, "p9", "")], "doc_id long, pattern string, rule_name string")
    rules = spark.createDataFrame([("p1", "second", 2), ("p1", "first", 1)], "pattern string, rule_name string, rule_ord int")
    assert {r["doc_id"]: r["rule_name"] for r in detect.attach_rule_name(hits_, rules).collect()} == {1: "first", 2: "自定义"}


@pytest.mark.parametrize(
    "text, terms, want",
    [
        ("", [], [(0, 0, "")]),
        ("", ["a"], []),
        ("abc", ["x"], [(0, 3, "abc")]),
        ("abc", [" ", ""], [(0, 3, "abc")]),
        ("abc", ["abc"], []),
        ("abcd", ["ab"], [(2, 4, "cd")]),
        ("abcd", ["cd"], [(0, 2, "ab")]),
        ("abcde", ["b", "d"], [(0, 1, "a"), (2, 3, "c"), (4, 5, "e")]),
        ("abcde", ["bc", "cd"], [(0, 1, "a"), (4, 5, "e")]),
        ("xaaay", ["aa"], [(0, 1, "x"), (4, 5, "y")]),
        ("AbC", ["abc"], [(0, 3, "AbC")]),
        ("😀张三😀", ["张三"], [(0, 1, "😀"), (3, 4, "😀")]),
    ],
)
def test_kept_runs(spark, text, terms, want):
    arr = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    row = spark.createDataFrame([(text,)], "text string").select(spans.kept_runs(F.col("text"), arr).alias("r")).first()
    assert [(x["start"], x["end"], x["text"]) for x in row["r"]] == want


def test_text_width(spark):
    df = spark.createDataFrame([("ab12",), ("中文",), ("中a",), ("㐀豈",), ("",)], "t string")
    assert [round(r[0], 4) for r in df.select(spans.text_width(F.col("t"))).collect()] == [2.2, 2.0, 1.55, 2.0, 0.0]


def test_landlines_sql_on_texts_where_matches_overlap(spark, tmp_path):
    texts = ["012-01234567 x", "0123-0123-01234567", "010 12345678901", "010 1234567", "0101234567890 010-ab1234c5", "9010-12345678", "０10-12345678", "010　12345678中", "a\n\n010-1234567é-010-12345678", "", None, "0000-00000000-0000-0000000"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, dt.date(1995, 1, 2))], "o_orderkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    for name in ("documents", "orders"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("c8_landline", "c1_default_rules"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        want = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 5
