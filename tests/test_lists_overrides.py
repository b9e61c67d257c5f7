import datetime as dt

from pyspark.sql import functions as F

from maskwright.operators import lists, overrides, rules

HIT = "doc_id long, location string, start int, end int, text string, source string, channel string, rule_name string, rule_ord int, pattern string, replacement string"


def hits(spark, rows):
    return spark.createDataFrame([(1, "p", s, e, t, src, "automatic", "r", 0, None, None) for s, e, t, src in rows], HIT)


def terms(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "term string")


def spans(df):
    return sorted((r["start"], r["end"], r["text"], r["source"]) for r in df.collect())


def test_allow_list_trims_drops_and_spares_manual(spark):
    h = hits(spark, [(10, 16, "张三与李四a", "rule"), (20, 22, "王五", "rule"), (30, 32, "张三", "manual"), (40, 42, "张三", "ocr"), (50, 50, "", "rule")])
    t = terms(spark, "张三", " ")
    assert spans(lists.apply_allow_list(h, t)) == [(12, 16, "与李四a", "rule"), (20, 22, "王五", "rule"), (30, 32, "张三", "manual")]
    assert spans(lists.apply_allow_list(h, t, None)) == spans(lists.apply_allow_list(h, t))
    assert spans(lists.apply_allow_list(h, t, False)) == [(20, 22, "王五", "rule"), (30, 32, "张三", "manual")]
    assert lists.apply_allow_list(h, terms(spark, " ")).count() == 5


def test_allow_list_wins_over_block_list(spark):
    b = spark.createDataFrame([(1, "p", "张三李四")], "doc_id long, location string, text string")
    out = lists.list_pipeline(hits(spark, []), b, terms(spark, "张三"), terms(spark, "张三", "李四"))
    assert spans(out) == [(2, 4, "李四", "blacklist")]


def test_term_lists(spark):
    rows = [("allow", "session", 0, "b"), ("allow", "permanent", 1, " a "), ("allow", "permanent", 0, "c"), ("allow", "session", 1, "a"), ("allow", "session", 2, " "), ("allow", "session", 3, None)]
    t = spark.createDataFrame(rows, "list string, layer string, ord int, term string")
    assert [r["term"] for r in rules.effective_terms(t).orderBy("ord").collect()] == ["c", "a", "b"]
    numbered = {tuple(r) for r in rules.effective_terms(t, places=1).collect()}
    assert numbered == {("allow", "c", 1), ("allow", "a", 2), ("allow", "b", 3)} == {tuple(r) for r in rules.effective_terms(t).collect()}
    loose = spark.createDataFrame([("block", "session", None, "x"), (None, "session", 7, "y"), ("block", "session", 20_000, "z"), ("block", "permanent", 30_000, "w")], "list string, layer string, ord int, term string")
    assert {tuple(r) for r in rules.effective_terms(loose).collect()} == {("block", "w", 1), ("block", "x", 2), ("block", "z", 3), (None, "y", 1)}
    clean = rules.sanitize_terms(t)
    more = rules.add_terms(clean, spark.createDataFrame([("allow", "z", 9), ("allow", "b", 10), ("allow", "z", 11)], "list string, term string, ord int"))
    assert sorted((r["layer"], r["term"], r["ord"]) for r in more.collect() if r["layer"] == "session") == [("session", "a", 1), ("session", "b", 0), ("session", "z", 9)]
    gone = rules.remove_terms(more, spark.createDataFrame([("allow", "a"), ("allow", "nope")], "list string, term string"))
    assert sorted((r["layer"], r["term"]) for r in gone.collect()) == [("permanent", "a"), ("permanent", "c"), ("session", "b"), ("session", "z")]
    new = rules.update_permanent(gone, spark.createDataFrame([("allow", "q", 0), ("allow", " ", 1)], "list string, term string, ord int"))
    assert sorted((r["layer"], r["term"]) for r in new.collect()) == [("permanent", "q"), ("session", "b"), ("session", "z")]


def test_validation(spark):
    h = hits(spark, [(0, 1, "a", "rule"), (3, 1, "a", "rule"), (0, 1, "a", "camera"), (0, 1, "a", None)])
    good, bad = rules.validate_hits(h)
    assert (good.count(), bad.count()) == (1, 3)
    r = spark.createDataFrame([(0, "a", "x"), (-1, "b", ""), (None, "", "y")], "rule_ord int, rule_name string, pattern string")
    assert sorted(x["message"] for x in rules.validate_rules(r).collect()) == ["name is empty", "order is out of range", "order is out of range", "pattern is empty"]


def test_hit_ids(spark):
    h = hits(spark, [(3, 9, "abcdef", "rule")]).withColumn("doc_hash", F.lit("ab12cd34"))
    assert overrides.with_hit_id(h).first()["hit_id"] == "ab12cd34|p|3|9|rule"
    box = spark.createDataFrame([("d", "page_0", (10.9, 1.0, 5.3, 2.0), "ocr")], "doc_hash string, location string, rect struct<x:double,y:double,w:double,h:double>, source string")
    assert overrides.with_hit_id(box).first()["hit_id"] == "d|page_0|10|16|ocr"
    bare = spark.createDataFrame([("d", "p", "seal")], "doc_hash string, location string, source string")
    assert overrides.with_hit_id(bare).first()["hit_id"] == "d|p|0|0|seal"
    ids = spark.createDataFrame([("d|p|1|2|rule",), ("d|p|1|2",), ("d|p|x|2|rule",), ("d|p|1|2|camera",), (None,), ("",)], "hit_id string")
    assert [r["ok"] for r in overrides.parse_hit_id(ids).collect()] == [True, False, False, False, False, False]


def test_fingerprint(spark):
    import hashlib

    df = spark.createDataFrame([("/a/b.pdf", 12, 345), ("", 1, 2), (None, 1, 2)], "path string, size long, mtime_ns long")
    got = [r[0] for r in df.select(overrides.doc_fingerprint(F.col("path"), F.col("size"), F.col("mtime_ns"))).collect()]
    assert got == [hashlib.sha1(b"/a/b.pdf\n12\n345").hexdigest()[:8], None, None]


def fold(events):
    state = {}
    for h, _, op, scope, ts in events:
        if op in ("ignore", "confirm"):
            state[h] = (op, scope, ts if scope == "permanent" else None)
        elif op == "promote" and h in state and state[h][1] != "permanent":
            state[h] = (state[h][0], "permanent", ts)
        elif op == "revert":
            state.pop(h, None)
    return state


def test_fold_overrides_against_replay(spark):
    import random

    rng = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    ops = [(f"h{rng.randrange(12)}", k, rng.choice(["ignore", "confirm", "promote", "promote", "revert"]), rng.choice(["session", "session", "permanent"]), t0 + dt.timedelta(hours=k)) for k in range(150)]
    df = spark.createDataFrame(rng.sample(ops, len(ops)), "hit_id string, seq long, op string, scope string, ts timestamp")
    assert {r["hit_id"]: (r["action"], r["scope"], r["promoted_at"]) for r in overrides.fold_overrides(df).collect()} == fold(ops)


def test_decisions_on_hits(spark):
    h = overrides.with_hit_id(hits(spark, [(0, 1, "a", "rule"), (2, 3, "a", "rule"), (0, 1, "a", "manual")]).withColumn("doc_hash", F.lit("d")))
    o = spark.createDataFrame([("d|p|0|1|rule", "ignore"), ("d|p|2|3|rule", "confirm"), ("d|p|0|1|manual", "ignore")], "hit_id string, action string")
    assert sorted(r["hit_id"] for r in overrides.filter_overridden(h, o).collect()) == ["d|p|0|1|manual", "d|p|2|3|rule"]
    assert overrides.filter_overridden(h, o, False).count() == 3
    assert {r["hit_id"]: r["confirmed"] for r in overrides.annotate_hits(h, o).collect()} == {"d|p|0|1|manual": False, "d|p|0|1|rule": False, "d|p|2|3|rule": True}


ROW = "ord long, hit_id string, doc_hash string, location string, start int, end int, source string, action string, scope string, promoted_at string"


def test_override_store(spark):
    rows = [
        (0, "a", "d", "p", 0, 1, "rule", "ignore", "session", None),
        (1, "b", "d", "p", 0, 1, "rule", "confirm", "permanent", "2024-01-01T00:00:00"),
        (2, "c", "d", "p", 0, 1, "rule", "confirm", "permanent", None),
        (3, "e", "", "p", 0, 1, "rule", "ignore", "session", None),
        (4, "f", "d", "p", 0, 1, "rule", "other", "session", None),
        (5, "a", "d", "p", 0, 1, "rule", "confirm", "session", None),
    ]
    df = spark.createDataFrame(rows, ROW)
    good, bad = overrides.restore_overrides(df)
    assert (good.count(), bad.count()) == (3, 3)
    cur = overrides.load_overrides(df.filter("false"), df)
    assert {r["hit_id"]: r["action"] for r in cur.collect()} == {"a": "confirm", "b": "confirm"}
    assert [r["hit_id"] for r in overrides.dump_overrides(cur).collect()] == ["b"]
    new = overrides.replace_overrides(cur, spark.createDataFrame([(9, "z", "d", "p", 0, 1, "ocr", "ignore", "permanent", "2024-02-02T00:00:00")], ROW))
    assert sorted(r["hit_id"] for r in new.collect()) == ["a", "z"]
    s = overrides.override_summary(new).first()
    assert tuple(s) == (1, 1, 1, 0)


def test_prune_stale(spark):
    df = spark.createDataFrame([("a", "2024-01-01T00:00:00"), ("b", "2024-02-10T00:00:00"), ("c", None), ("d", "rubbish")], "hit_id string, promoted_at string")
    assert sorted(r["hit_id"] for r in overrides.prune_stale(df, F.lit("2024-02-20").cast("date")).collect()) == ["b", "c", "d"]
