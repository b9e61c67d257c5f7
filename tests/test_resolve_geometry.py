import random
import re

from pyspark.sql import functions as F

from maskwright.operators import geometry as G
from maskwright.operators import report, resolve
from maskwright.operators.rules import DEFAULT_RULES
from maskwright.plans import pipelines

HIT = "doc_id long, location string, start int, end int, text string, source string, channel string, rule_name string, rule_ord int, pattern string, replacement string"
BOX = "doc_id long, page int, ord int, y_center double, rect struct<x:double,y:double,w:double,h:double>, text string, source string, rule_name string"


def blocks(spark, *texts):
    return spark.createDataFrame([(i, "p", t) for i, t in enumerate(texts)], "doc_id long, location string, text string")


def test_channel_priority_and_disjoint_plan(spark):
    rows = [(0, "p", 0, 6, "x", "rule", "automatic", "auto", 0, None, None), (0, "p", 2, 4, "x", "manual", "manual", "m", None, None, "#"), (0, "p", 3, 5, "x", "rule", "replace", "rr", 1, None, "R"), (0, "p", 6, 6, "", "rule", "automatic", "empty", 0, None, None), (0, "p", 7, 9, "x", "rule", "automatic", "late", 3, None, None)]
    plan = resolve.resolve_overlaps(spark.createDataFrame(rows, HIT)).first()["plan"]
    assert [(p["start"], p["end"], p["rule_name"]) for p in plan] == [(3, 5, "rr"), (7, 9, "late")]


def test_render_and_segments(spark):
    rules = [{"rule_index": 0, "enabled": True, "mode": "regex", "find": "a.", "replace": "<r>"}, {"rule_index": 1, "enabled": True, "mode": "exact", "find": "ab", "replace": "<e>"}, {"rule_index": 2, "enabled": False, "mode": "exact", "find": "z", "replace": "!"}]
    out = resolve.batch_replace(blocks(spark, "😀abzac", "zz", "", None), rules)
    assert {r["doc_id"]: r["redacted"] for r in out.collect()} == {0: "😀<e>z<r>", 1: "zz", 2: "", 3: None}
    seg = resolve.replaced_segments(out).filter("doc_id = 0").orderBy("seg_no").collect()
    assert [(s["kind"], s["text"]) for s in seg] == [("text", "😀"), ("replacement", "<e>"), ("text", "z"), ("replacement", "<r>")]
    assert "".join(s["text"] for s in resolve.highlight_segments(out).filter("doc_id = 0").orderBy("seg_no").collect()) == "😀abzac"
    assert {(r["doc_id"], r["rule_index"]): r["count"] for r in report.rule_counts(out).collect()} == {(0, 0): 1, (0, 1): 1}


def test_no_replace_rules(spark):
    assert resolve.batch_replace(blocks(spark, "abc"), []).first()["redacted"] == "abc"


def test_id_beats_card_and_paths_agree(spark):
    b = blocks(spark, "x 110101199003074513 y a@b.cc", "none")
    rules = [r for r in DEFAULT_RULES if r.enabled]
    one = {r["doc_id"]: r["redacted"] for r in pipelines.redact_rows(b, rules).collect()}
    assert one == {0: "x * y *", 1: "none"} == {r["doc_id"]: r["redacted"] for r in pipelines.word_scan(b, pipelines.Settings(rules)).collect()}
    assert {r["doc_id"]: r["redacted"] for r in pipelines.redact_rows(b, rules, ["a@b"]).collect()} == {0: "x * y a@b*", 1: "none"}


def test_manual_edits(spark):
    b = blocks(spark, "aXbX", "X")
    sel = spark.createDataFrame([(0, "p", 1, 2, "X", "#")], "doc_id long, location string, start int, end int, text string, replacement string")
    assert resolve.manual_exact(sel).first()["source"] == "manual"
    every = resolve.manual_global(sel, b)
    assert sorted((r["doc_id"], r["start"]) for r in every.collect()) == [(0, 1), (0, 3)]
    undo = lambda mode: resolve.undo_manual(every, sel.withColumn("mode", F.lit(mode).cast("string"))).count()
    assert (undo(None), undo("exact"), undo("global")) == (1, 1, 0)


def test_runs_keep_formatting(spark):
    plan = spark.createDataFrame([(0, "p", [(2, 7, "R", "rule", "automatic", "r", 0)])], f"doc_id long, location string, plan {resolve.PLAN}")
    runs = spark.createDataFrame([(0, "p", 0, 0, 4, "abcd", "b"), (0, "p", 1, 4, 6, "ef", "i"), (0, "p", 2, 6, 9, "ghi", "n"), (0, "p", 3, 9, 10, "j", "n")], "doc_id long, location string, run_no int, start int, end int, text string, style string")
    assert [r["redacted"] for r in resolve.project_to_runs(plan, runs).orderBy("run_no").collect()] == ["abR", "", "hi", "j"]


def test_reports(spark):
    res = spark.createDataFrame([(1, 0, "success"), (2, 1, "failed"), (3, 2, "success"), (4, 3, "failed")], "doc_id long, ord int, status string")
    assert tuple(report.batch_summary(res).first()) == (4, 2, 2)
    assert [r["doc_id"] for r in report.order_results(res).collect()] == [2, 4, 1, 3]
    assert [report.filter_results(res, s).count() for s in ("all", "failed", "success")] == [4, 2, 2]
    assert sorted(r["doc_id"] for r in report.retry_set(res.select("doc_id"), res).collect()) == [2, 4]
    counts = spark.createDataFrame([(2, 0, 3), (1, 0, 1)], "doc_id long, rule_index int, count long")
    rules = spark.createDataFrame([(0, "a"), (1, "b")], "rule_index int, find string")
    assert {r["rule_index"]: r["docs"] for r in report.rule_summary(rules, counts).collect()} == {0: "1:1, 2:3", 1: report.NO_HIT}
    assert report.rule_totals(counts).filter("rule_index is null").first()["count"] == 4
    meta = report.scan_meta(blocks(spark, "a", "b").withColumn("processed", F.col("doc_id") == 0))
    assert {r["doc_id"]: r["cancelled"] for r in meta.collect()} == {0: False, 1: True}


def boxes(spark, rows):
    return spark.createDataFrame([(1, 0, k, y, (float(x), float(yy), float(w), float(h)), t, "ocr", f"r{k}") for k, (y, x, yy, w, h, t) in enumerate(rows)], BOX)


def flat(df):
    return sorted(tuple(r["rect"]) for r in df.collect())


def test_merge_adjacent(spark):
    near = boxes(spark, [(10.0, 0, 5, 20, 10, ""), (12.0, 35, 6, 20, 10, ""), (10.0, 100, 5, 10, 10, ""), (30.0, 0, 25, 10, 10, "")])
    assert flat(G.merge_adjacent(near)) == [(0.0, 5.0, 55.0, 11.0), (0.0, 25.0, 10.0, 10.0), (100.0, 5.0, 10.0, 10.0)]


def greedy(rows, gap=30, tol=8):
    buckets = []
    for y, r in sorted(rows):
        for b in buckets:
            if abs(y - b[0][0]) <= tol:
                b.append((y, r))
                break
        else:
            buckets.append([(y, r)])
    out = []
    for b in buckets:
        rs = sorted(r for _, r in b)
        x0, y0, x1, y1 = rs[0][0], rs[0][1], rs[0][0] + rs[0][2], rs[0][1] + rs[0][3]
        for x, y, w, h in rs[1:]:
            if x - x1 <= gap:
                x1, y0, y1 = max(x1, x + w), min(y0, y), max(y1, y + h)
            else:
                out.append((x0, y0, x1 - x0, y1 - y0))
                x0, y0, x1, y1 = x, y, x + w, y + h
        out.append((x0, y0, x1 - x0, y1 - y0))
    return sorted(out)


def test_merge_adjacent_is_the_greedy_rule(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(60)), (float(rng.randrange(300)), float(rng.randrange(60)), float(rng.randrange(1, 40)), 10.0)) for _ in range(40)]
    df = boxes(spark, [(y, *r, "") for y, r in rows])
    assert flat(G.merge_adjacent(df)) == greedy(rows)


def test_collapse_touching(spark):
    rows = [(0.0, 0, 0, 10, 10, "a"), (0.0, 11, 0, 10, 10, "b"), (0.0, 23, 0, 10, 10, "c"), (0.0, 100, 100, 5, 5, "d")]
    got = G.collapse_touching(boxes(spark, rows)).orderBy("ord").collect()
    assert [(r["text"], tuple(r["rect"])) for r in got] == [("a", (0.0, 0.0, 21.0, 10.0)), ("c", (23.0, 0.0, 10.0, 10.0)), ("d", (100.0, 100.0, 5.0, 5.0))]


def test_box_arithmetic(spark):
    line = spark.createDataFrame([("ab中文", [(0.0, 0.0), (100.0, 0.0), (100.0, 20.0), (0.0, 20.0)]), ("", [(0.0, 0.0), (9.0, 9.0)]), ("ab", [(5.0, 0.0), (5.0, 9.0)])], "text string, box array<struct<x:double,y:double>>")
    got = [r[0] for r in line.select(G.span_rect(F.col("box"), F.col("text"), F.lit(2), F.lit(4), scale=2.0, off_x=1.0)).collect()]
    x, w = 1.1 / 3.1 * 100 + 1, 2 / 3.1 * 100 - 2
    assert [round(v, 6) for v in got[0]] == [round(v, 6) for v in (x / 2 - 1, 0.0, w / 2, 10.0)] and got[1:] == [None, None]
    s = line.select(G.shrink_box(F.col("box"), 0.2, 0.1)).first()[0]
    assert [tuple(p) for p in s] == [(10.0, 1.0), (90.0, 1.0), (90.0, 19.0), (10.0, 19.0)]
    assert tuple(line.select(G.clip_to_page(G.rect(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), F.struct(F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0")))).first()[0]) == (11.0, 22.0, 3.0, 4.0)
    r = G.rect(F.lit(0), F.lit(0), F.lit(100), F.lit(10))
    texts = spark.createDataFrame([("abcd", 1, 3), ("a\nbc", 0, 2), ("abcd", 2, 2)], "t string, s int, e int")
    k = [x[0] for x in texts.select(G.kept_span_rect(r, F.col("t"), F.col("s"), F.col("e"))).collect()]
    assert [round(v, 6) for v in k[0]] == [25.0, 0.0, 50.0, 10.0] and k[1:] == [None, None]


def test_layout_and_tokens(spark):
    b = spark.createDataFrame([(1, 0, 0, 1, (0.0, 0.0, 30.0, 30.0)), (1, 0, 1, 1, (0.001, 0.0, 30.0, 30.0)), (1, 0, 2, 0, (0.0, 0.0, 90.0, 90.0)), (1, 0, 3, 1, (0.0, 0.0, 23.0, 90.0))], "doc_id long, page int, block_no int, type int, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert [r["block_no"] for r in G.image_regions(b).collect()] == [0]
    tok = spark.createDataFrame([(1, 0, 0, "foo", (0.0, 0.0, 50.0, 10.0)), (1, 0, 1, "bar", (0.0, 0.0, 80.0, 10.0))], "doc_id long, page int, tok_no int, text string, rect struct<x:double,y:double,w:double,h:double>")
    h = boxes(spark, [(0.0, 10, 0, 10, 10, ""), (0.0, 60, 0, 10, 10, ""), (0.0, 300, 0, 10, 10, "")])
    assert {r["ord"]: r["resolved"] for r in G.resolve_text(h, tok).collect()} == {0: "foo", 1: "bar", 2: ""}
    assert sorted(r["ord"] for r in G.apply_allow_list_boxes(h, tok, F.array(F.lit("oo"))).collect()) == [1, 2]
    texts = boxes(spark, [(0.0, 0, 0, 40, 10, "abcd"), (0.0, 0, 0, 40, 10, "zzzz")])
    kept = G.apply_allow_list_boxes(texts, tok, F.array(F.lit("b")))
    assert sorted((r["text"], r["rect"]["w"]) for r in kept.collect()) == [("a", 10.0), ("cd", 20.0), ("zzzz", 40.0)]
    black = G.block_list_boxes(tok, spark.createDataFrame([("o",)], "term string"), 2.0).collect()
    assert [(tuple(r["rect"]), r["text"], r["source"]) for r in black] == [((0.0, 0.0, 25.0, 5.0), "o", "blacklist")]
    assert G.dedupe_rects(h.union(h)).count() == 3


def _page_parts(spark):
    point = lambda x, y: (float(x), float(y))
    box = lambda y, n: [point(0, y), point(n * 5.5, y), point(n * 5.5, y + 12), point(0, y + 12)]
    texts = ["mail a@b.org here", "card 4111111111111111", "my token is secret", ""]
    lines = spark.createDataFrame([(d, 0, k, t, box(k * 20, len(t))) for d in (1, 2) for k, t in enumerate(texts)], "doc_id long, page int, line_no int, text string, box array<struct<x:double,y:double>>")
    tokens = []
    for d in (1, 2):
        for k, t in enumerate(texts):
            at = 0
            for i, w in enumerate(t.split(" ")):
                tokens.append((d, 0, k * 100 + i, w, (at * 5.5, k * 20.0, len(w) * 5.5, 12.0)))
                at += len(w) + 1
    return lines, spark.createDataFrame(tokens, "doc_id long, page int, tok_no long, text string, rect struct<x:double,y:double,w:double,h:double>")


def test_tokens_of_pages_without_a_box_are_not_moved(spark):
    box = lambda x: G.rect(x, F.lit(0), F.lit(20), F.lit(10))
    tokens = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(0).alias("page"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("tok_no")).withColumns({"text": F.concat(F.lit("t"), "tok_no"), "rect": box(F.col("tok_no") * 20)})
    hits = spark.range(0, 2000, 500).select(F.col("id").alias("doc_id"), F.lit(0).alias("page"), F.lit(1).alias("ord"), box(F.lit(60) + F.col("id") / 25).alias("rect"), F.lit("").alias("text"), F.lit("ocr").alias("source"), F.lit("r").alias("rule_name"))
    out = G.apply_allow_list_boxes(hits, tokens, F.array(F.lit("t4")))
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 1000, 1500]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin [^\n]*LeftSemi", plan)


def test_page_scan_with_lists_and_decisions(spark):
    lines, tokens = _page_parts(spark)
    pii = [r for r in DEFAULT_RULES if r.rule_name in ("银行卡号", "电子邮箱")]
    table = lambda *xs: spark.createDataFrame([(x,) for x in xs], "term string")
    key = lambda df: sorted((r["doc_id"], r["rect"]["y"], tuple(r["sources"])) for r in df.collect())
    plain = pipelines.Settings(pii)
    found = key(pipelines.page_scan_with_lists(lines, plain))
    assert found == [(d, y, ("ocr",)) for d in (1, 2) for y in (0.0, 20.0)]
    # An allowed term drops the whole box whose word it stands in, and wins over the same blocked term.
    lists = pipelines.Settings(pii, allow=table("@b", "secret"), block=table("token", "secret"))
    listed = [(d, y, (source,)) for d in (1, 2) for y, source in ((20.0, "ocr"), (40.0, "blacklist"))]
    many = pipelines.Settings(pii, allow=table("@b", "secret", *(f"absent {k}" for k in range(60))), block=table("token", "secret", *(f"absent {k}" for k in range(60))))
    assert key(pipelines.page_scan_with_lists(lines, many, tokens)) == listed
    none = pipelines.Settings(pii, allow=table("", " "), block=table())
    assert key(pipelines.page_scan_with_lists(lines, none, tokens)) == found
    # Decisions drop a box by its place; seals join behind the lists, a manual box can't be ignored.
    hits = pipelines.with_page_id(pipelines.page_hits(lines, lists, tokens))
    ignored = hits.filter("doc_id = 1").select("hit_id", F.lit("ignore").alias("action"))
    seals = spark.createDataFrame([(1, 0, (1.0, 1.0, 9.0, 9.0), "", "seal", "x"), (1, 0, (1.0, 1.0, 9.0, 9.0), "", "manual", "y")], "doc_id long, page int, rect struct<x:double,y:double,w:double,h:double>, text string, source string, other string")
    decided = pipelines.Settings(pii, allow=lists.allow, block=lists.block, decisions=ignored)
    assert key(pipelines.page_scan_with_lists(lines, decided, tokens, seals)) == [(1, 1.0, ("manual", "seal")), (2, 20.0, ("ocr",)), (2, 40.0, ("blacklist",))]
    gone = ignored.unionByName(pipelines.with_page_id(seals).select("hit_id", F.lit("ignore").alias("action")))
    assert key(pipelines.page_scan_with_lists(lines.filter("false"), pipelines.Settings(pii, decisions=gone), tokens, seals)) == [(1, 1.0, ("manual",))]


def test_boxes_once_and_in_order(spark):
    r = lambda x: (float(x), 0.0, 5.0, 5.0)
    df = spark.createDataFrame([(2, 0, r(1)), (1, 0, r(9)), (1, 0, r(3)), (1, 0, r(9))], "doc_id long, page int, rect struct<x:double,y:double,w:double,h:double>")
    assert [(x["doc_id"], x["rect"]["x"]) for x in G.dedupe_rects(df, ordered=True).collect()] == [(1, 3.0), (1, 9.0), (2, 1.0)]
