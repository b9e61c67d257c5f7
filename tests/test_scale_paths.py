"""Paths that only long blocks, long lists and repeated deliveries take, held against the plain ones."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskwright.functions import spans
from maskwright.operators import detect, geometry, lists, names, overrides, report, resolve
from maskwright.operators.rules import DEFAULT_RULES
from maskwright.plans import pipelines
from maskwright.sources import corpus, sink
from maskwright.streaming import jobs, versions

HIT = "doc_id long, location string, start int, end int, source string, channel string, rule_name string, rule_ord int, replacement string, mode string"


def hits(spark, seed=1):
    rng, rows = random.Random(seed), []
    for b in range(40):
        n = rng.choice([0, 3, 17, 60, 300])
        for _ in range(n):
            s = rng.randrange(3 * n)
            rows.append((b, "p", s, s + rng.choice([0, 1, 2, 5, 12]), rng.choice("ab"), rng.choice(["automatic", "manual", "replace"]), "r", rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "#"]), rng.choice(["exact", "regex"])))
    return spark.createDataFrame(rows, HIT)


@pytest.mark.parametrize("chunk", [3, 128])
def test_conflicts_by_levels_equal_those_one_by_one(spark, monkeypatch, chunk):
    monkeypatch.setattr(resolve, "CHUNK", chunk)
    monkeypatch.setattr(resolve, "FEW", 0)
    swept = sorted(map(repr, resolve.resolve_overlaps(hits(spark)).collect()))
    monkeypatch.setattr(resolve, "FEW", 10**6)
    assert swept == sorted(map(repr, resolve.resolve_overlaps(hits(spark)).collect()))


def test_a_line_of_many_hits_is_masked_in_seconds(spark):
    line = " ".join(f"user{i}@mail{i % 7}.example.com 文" for i in range(30_000))
    b = spark.createDataFrame([(1, "p", line)], "doc_id long, location string, text string")
    began = time.time()
    got = pipelines.redact_rows(b, [r for r in DEFAULT_RULES if r.rule_ord == 3]).first()
    assert got["redacted"] == " ".join(["* 文"] * 30_000) and len(got["plan"]) == 30_000 and time.time() - began < 60


@pytest.mark.parametrize("stretch", [1, 3, 7])
def test_texts_are_cut_alike_by_any_stretch(spark, monkeypatch, stretch):
    monkeypatch.setattr(spans, "STRETCH", stretch)
    rng, rows = random.Random(stretch), []
    for k in range(60):
        text = "".join(rng.choice("ab文😀\n ") for _ in range(rng.choice([0, 1, 5, 30])))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, rng.choice([0, 2, 4, 6]))))
        plan = [(s, e, rng.choice([None, "#", ""]), "x") for s, e in zip(cuts[::2], cuts[1::2])]
        rows.append((k, text, plan))
    df = spark.createDataFrame(rows, "k int, text string, plan array<struct<start:int,end:int,replacement:string,source:string>>")
    got = df.select("k", spans.splice(F.col("text"), F.col("plan"), F.lit("*")).alias("s"), spans.segments(F.col("text"), F.col("plan"), F.lit("*")).alias("g"), spans.segments(F.col("text"), F.col("plan"), F.lit("*"), False).alias("o")).collect()
    for r in got:
        _, text, plan = rows[r["k"]]
        out, at = [], 0
        for s, e, new, source in plan:
            out += [("text", text[at:s], None)] if s > at else []
            out.append(("replacement", "*" if new is None else new, source))
            at = e
        out += [("text", text[at:], None)] if at < len(text) else []
        assert r["s"] == "".join(x[1] for x in out) and [tuple(x) for x in r["g"]] == out and "".join(x["text"] for x in r["o"]) == text


def test_kept_runs_of_long_texts(spark):
    text = "".join(random.Random(3).choice("abc") for _ in range(5000))
    got = spark.createDataFrame([(text,)], "text string").select(spans.kept_runs(F.col("text"), F.array(F.lit("ab"), F.lit("bab"), F.lit("cc"))).alias("r")).first()["r"]
    covered = [False] * len(text)
    for term in ("ab", "bab", "cc"):
        for i in range(len(text)):
            if text.startswith(term, i):
                covered[i : i + len(term)] = [True] * len(term)
    want, at = [], None
    for i, c in enumerate([*covered, True]):
        if not c and at is None:
            at = i
        if c and at is not None:
            want.append((at, i, text[at:i]))
            at = None
    assert [tuple(x) for x in got] == want


TERMS = ["aa", "aab", "b", "文", "😀a", "a b", "zz", "", "aa"]


@pytest.mark.parametrize("size", [6, 1 << 20])
def test_automata_find_what_single_searches_find(spark, monkeypatch, size):
    rng = random.Random(9)
    texts = ["".join(rng.choice("aab文😀 ") for _ in range(rng.choice([0, 3, 40]))) for _ in range(50)] + [None]
    b = spark.createDataFrame([(i, "p", x, i) for i, x in enumerate(texts)], "doc_id long, location string, text string, found int")
    terms = spark.createDataFrame([(x,) for x in TERMS], "term string")
    single = sorted(map(tuple, detect.scan_block_list(b, terms).collect()), key=repr)
    tok = b.select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("tok_no"), "text", geometry.rect(F.lit(0), F.lit(0), F.lit(9), F.lit(9)).alias("rect"))
    boxes = sorted(map(repr, geometry.block_list_boxes(tok, terms).collect()))
    own = spark.createDataFrame([(1, "p", 0, len(x), x, "rule", "automatic", "r", 0, None, None) for x in texts if x], "doc_id long, location string, start int, end int, text string, source string, channel string, rule_name string, rule_ord int, pattern string, replacement string")
    allowed = sorted(map(repr, lists.apply_allow_list(own, terms).collect()))
    monkeypatch.setattr(detect, "MAX_TERMS", 0)
    monkeypatch.setattr(lists, "MAX_TERMS", 0)
    monkeypatch.setattr(detect, "TERM_BYTES", size)
    assert sorted(map(tuple, detect.scan_block_list(b, terms).collect()), key=repr) == single and single
    assert sorted(map(repr, geometry.block_list_boxes(tok, terms).collect())) == boxes
    assert sorted(map(repr, lists.apply_allow_list(own, terms).collect())) == allowed
    assert detect.find_terms(b, terms.filter("false"), ["doc_id"]).collect() == []


def test_sink_takes_a_batch_once(spark, tmp_path):
    home = f"file://{tmp_path}/sink"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sink.read_committed(spark, home, df.schema).collect() == [] and sink.manifest(spark, home).collect() == []
    assert sink.write_once(df, home, "r", 0) and not sink.write_once(df, home, "r", 0) and sink.write_once(df, home, "other", 0)
    df.write.parquet(f"{home}/data/run_id=r/batch_id=1/try=broken")
    assert sink.read_committed(spark, home, df.schema).count() == 4
    assert [r["folder"].rsplit("/", 1)[-1] for r in sink.uncommitted(spark, home).collect()] == ["try=broken"]
    assert sink.write_once(df.filter("false"), home, "r", 1) and sink.manifest(spark, home).agg(F.sum("n_rows")).first()[0] == 4


def test_a_broken_file_is_one_failed_row(spark, tmp_path):
    for name, data in {"a.txt": b"fine \xe6\x96\x87\n", "b.txt": b"\xff\xfe", "c.txt": b"", "d.txt": b"x" * 50, "e.csv": b"no"}.items():
        (tmp_path / name).write_bytes(data)
    got = corpus.read_files(spark, [f"file://{tmp_path}"], 20, "*.txt").collect()
    assert {r["path"][-5:]: (r["status"], r["error"], r["text"]) for r in got} == {"a.txt": ("success", None, "fine 文\n"), "b.txt": ("failed", "not UTF-8", None), "d.txt": ("failed", "too large", None)}


def test_records(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, '{"a": '), (3, None), (4, "[]"), (5, '{"a": "no number"}')], "k int, text string")
    got = {r["k"]: r for r in corpus.parse_records(df, "a int, b string").collect()}
    assert (got[1]["a"], got[1]["b"], got[1]["status"], got[1]["corrupt"]) == (1, "x", "success", None)
    assert all(got[k]["status"] == "failed" and got[k]["error"] and got[k]["a"] is None for k in (2, 3, 5)) and got[2]["corrupt"] == '{"a": '


def test_a_session_ends_and_a_permanent_decision_stays(spark, tmp_path):
    src, t0 = tmp_path / "log", dt.datetime(2024, 1, 1)
    schema = "hit_id string, seq long, op string, scope string, ts timestamp"
    parts = [[("s", 1, "ignore", "session", t0), ("p", 2, "ignore", "permanent", t0), ("q", 3, "confirm", "session", t0), ("q", 4, "promote", None, t0)], [(h, 5, "promote", None, t0 + dt.timedelta(1)) for h in "spq"]]
    seen = []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{src}")
        log = spark.readStream.schema(schema).parquet(f"file://{src}")
        job = jobs.stream_overrides(log, 2 / 3600).writeStream.outputMode("update").foreachBatch(lambda df, k: seen.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        job.awaitTermination()
        time.sleep(3)
    last = {r["hit_id"]: (r["action"], r["scope"], r["promoted_at"], r["deleted"]) for r in seen}
    assert last == {"s": (None, None, None, True), "p": ("ignore", "permanent", t0, False), "q": ("confirm", "permanent", t0, False)}


def test_a_change_of_lists_reaches_earlier_hits(spark, tmp_path):
    schema = "hit_id string, start int, end int, text string, source string"
    parts = [[("a|p|0|4|rule", 0, 4, "ab44", "rule"), ("b|p|5|9|rule", 5, 9, "mail", "rule"), ("c|p|0|3|rule", 0, 3, "xyz", "rule")], [("d|p|0|6|rule", 0, 6, "mail44", "rule"), ("e|p|1|3|manual", 1, 3, "44", "manual")]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/part_{k}")
    entries = spark.createDataFrame([("allow", "44", 0, 1), ("allow", "mail", 1, None), ("ignore", "c|p|0|3|rule", 1, None)], "kind string, value string, valid_from int, valid_to int")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    home = f"file://{tmp_path}/out"
    for again in range(2):  # the second run delivers both batches anew
        versions.stream_versioned(source, lambda k: (entries, min(k, 1)), home, "run", f"file://{tmp_path}/c{again}").awaitTermination()
    rows = sink.read_committed(spark, f"{home}/result", StructType.fromDDL(versions.RESULT))
    got = sorted((r["hit_id"][0], r["version"], [tuple(x) for x in r["runs"]]) for r in rows.collect())
    first = [("a", 0, [(0, 2, "ab")]), ("b", 0, [(5, 9, "mail")]), ("c", 0, [(0, 3, "xyz")])]
    second = [("a", 1, [(0, 4, "ab44")]), ("b", 1, []), ("c", 1, []), ("d", 1, [(4, 6, "44")]), ("e", 1, [(1, 3, "44")])]
    if got[0][1] == 0 and len([x for x in got if x[1] == 0]) == 3:
        assert got == sorted(first + second)
    else:  # the files came in the other order
        assert {x[0]: x[2] for x in got if x[1] == 1} == {x[0]: x[2] for x in second}
    assert sorted((r["hit_id"][0], r["start"], r["end"]) for r in versions.latest(rows).collect()) == [("a", 0, 4), ("d", 4, 6), ("e", 1, 3)]


def test_decisions_from_any_cut_are_those_of_the_whole_log(spark):
    rng = random.Random(6)
    rows = [(rng.choice("abcdefgh"), k, rng.choice(["ignore", "confirm", "promote", "revert"]), rng.choice(["session", "permanent"]), dt.datetime(2024, 1, 1) + dt.timedelta(k)) for k in range(120)]
    log = spark.createDataFrame(rows, "hit_id string, seq long, op string, scope string, ts timestamp")
    whole = sorted(map(repr, overrides.fold_overrides(log).collect()))
    for cut in (-1, 17, 60, 119):
        assert sorted(map(repr, overrides.fold_delta(overrides.fold_overrides(log.filter(f"seq <= {cut}")), log, cut).collect())) == whole


def test_a_tagger_starts_once_in_a_task_that_has_texts(spark, monkeypatch):
    monkeypatch.setattr(names, "ROWS", 2)
    b = spark.createDataFrame([(1, "p", "A b C"), (1, "q", None), (2, "p", "")], "doc_id long, location string, text string").coalesce(1)

    def start():
        seen = []

        def tag(text):
            seen.append(text)
            return [(w, f"n{len(seen)}") for w in text.split(" ") if w]

        return tag

    got = names.tag_tokens(b, start).collect()
    assert [tuple(r) for r in got] == [(1, "p", 0, "A", "n1"), (1, "p", 1, "b", "n1"), (1, "p", 2, "C", "n1")]
    assert names.tag_tokens(b.filter("false"), start).collect() == []


def test_tokens_and_runs_meet_by_cells(spark, monkeypatch):
    rng = random.Random(8)
    box = lambda m: (rng.uniform(-50, 400), rng.uniform(-50, 400), rng.uniform(0, m), rng.uniform(0, m))
    RECT = "rect struct<x:double,y:double,w:double,h:double>"
    toks, hs = [(1, p, k, f"t{k}", box(90)) for p in range(2) for k in range(150)], [(1, p, k, box(30)) for p in range(2) for k in range(150)]
    got = geometry.resolve_text(spark.createDataFrame(hs, f"doc_id long, page int, ord int, {RECT}"), spark.createDataFrame(toks, f"doc_id long, page int, tok_no int, text string, {RECT}")).collect()

    def first(page, r):
        x, y = r[0] + r[2] / 2, r[1] + r[3] / 2
        return next((t[3] for t in toks if t[1] == page and t[4][0] <= x <= t[4][0] + t[4][2] and t[4][1] <= y <= t[4][1] + t[4][3]), "")

    assert {(r["page"], r["ord"]): r["resolved"] for r in got} == {(p, k): first(p, r) for _, p, k, r in hs}
    text = "".join(rng.choice("abc") for _ in range(900))
    cuts = sorted(rng.sample(range(1, 900), 60))
    runs = [(1, "p", k, s, e, text[s:e], "plain") for k, (s, e) in enumerate(zip([0, *cuts], [*cuts, 900]))]
    ends = sorted(rng.sample(range(900), 40))
    plan = [(s, e, rng.choice([None, "#"])) for s, e in zip(ends[::2], ends[1::2])]
    plans = spark.createDataFrame([(1, "p", plan)], "doc_id long, location string, plan array<struct<start:int,end:int,replacement:string>>")
    monkeypatch.setattr(resolve, "MEET", 7)
    out = resolve.project_to_runs(plans, spark.createDataFrame(runs, "doc_id long, location string, run_no int, start int, end int, text string, style string")).orderBy("run_no").collect()
    want, at = "", 0
    for s, e, new in plan:
        want, at = want + text[at:s] + ("*" if new is None else new), e
    assert "".join(r["redacted"] for r in out) == want + text[at:]


def test_rule_lists_in_chunks(spark):
    counts = spark.createDataFrame([(k % 997, 0, 1) for k in range(1200)] + [(5, 1, 2)], "doc_id long, rule_index int, count long")
    rules = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "rule_index int, find string")
    got = report.rule_chunks(rules, counts, 100).collect()
    own = {r["chunk"]: r for r in got if r["rule_index"] == 0}
    docs = ", ".join(own[k]["docs"] for k in sorted(own))
    assert docs == ", ".join(f"{d}:{2 if d < 203 else 1}" for d in range(997)) and max(r["n_docs"] for r in got) == 100 and len(own) == 10
    assert sorted((r["rule_index"], r["docs"], r["n_docs"]) for r in got if r["rule_index"] > 0) == [(1, "5:2", 1), (2, report.NO_HIT, 0)]


def touching(rows, pad=2):
    """Groups by comparing each box with every first box."""
    groups = []
    for x, y, w, h in rows:
        for g in groups:
            a, b, c, d = g[0]
            if not (a + c + pad < x or x + w + pad < a or b + d + pad < y or y + h + pad < b):
                g.append((x, y, w, h))
                break
        else:
            groups.append([(x, y, w, h)])
    around = lambda g: (min(r[0] for r in g), min(r[1] for r in g), max(r[0] + r[2] for r in g), max(r[1] + r[3] for r in g))
    return [(a, b, c - a, d - b) for a, b, c, d in map(around, groups)]


BOXES = "doc_id long, page int, ord int, rect struct<x:double,y:double,w:double,h:double>, text string, source string, rule_name string"


def test_touching_boxes_by_cells_are_the_greedy_rule(spark):
    rng = random.Random(5)
    pages = []
    for page in range(6):
        spread, size = [(60, 9), (900, 30), (900, 3), (5, 0), (4000, 400), (300, 40)][page]
        rows = [tuple(float(v) for v in (rng.randint(-spread, spread), rng.randint(-spread, spread), rng.randint(-1, size), rng.randint(0, size))) for _ in range(150)]
        rows += [(-5000.0, -5000.0, 9000.0, 5.0)] * 2 + rows[:9] + [(float(-spread), 0.0, 1e9, 0.5)]
        rng.shuffle(rows)
        pages.append(rows)
    df = spark.createDataFrame([(1, p, k, r, None, "ocr", None) for p, rows in enumerate(pages) for k, r in enumerate(rows)], BOXES)
    got = geometry.collapse_touching(df.repartition(7)).collect()
    for p, rows in enumerate(pages):
        assert [tuple(r["rect"]) for r in sorted((r for r in got if r["page"] == p), key=lambda r: r["ord"])] == touching(rows)


def test_boxes_without_place_stand_alone(spark):
    rows = [(None, 0, 0, (0.0, 0.0, 5.0, 5.0), "a", "s", "r"), (None, 0, 1, (None, 0.0, 5.0, 5.0), "b", "s", "r"), (None, 0, 2, (float("nan"), 0.0, 5.0, 5.0), None, "s", "r"), (None, 0, None, None, "d", None, "r"), (None, 0, 3, (0.0, 0.0, float("inf"), 5.0), "e", "s", "r"), (None, 0, 4, (1.0, 1.0, 1.0, 1.0), "f", "s", "r")]
    df = spark.createDataFrame(rows, BOXES)
    got = geometry.collapse_touching(df)
    assert got.schema.simpleString() == df.schema.simpleString()
    assert sorted(str(r["text"]) for r in got.collect()) == ["None", "a", "b", "d", "e"] and geometry.collapse_touching(df.filter("false")).count() == 0


def test_a_page_of_many_boxes(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page"), F.col("id").cast("int").alias("ord"), geometry.rect(F.col("id") % 400 * 10, F.floor(F.col("id") / 400) * 20, F.lit(9), F.lit(9)).alias("rect"), F.lit("t").alias("text"), F.lit("ocr").alias("source"), F.lit("r").alias("rule_name"))
    began = time.time()
    # in a row of 400 each third box is out of reach of the one before: a first box reaches one neighbour
    assert geometry.collapse_touching(df).count() == n // 2
    assert time.time() - began < 60


def test_hits_of_many_terms_are_columns(spark):
    terms = spark.createDataFrame([(f"w{k}w",) for k in range(40)], "term string")
    b = spark.createDataFrame([(1, "p", "w1w1w w2w😀w1w"), (2, "p", None), (3, "p", "none"), (4, "p", "w39w")], "doc_id long, location string, text string")
    out = detect.scan_block_list(b, terms)
    want = [(1, 0, 3, "w1w"), (1, 6, 9, "w2w"), (1, 10, 13, "w1w"), (4, 0, 4, "w39w")]
    assert sorted((r["doc_id"], r["start"], r["end"], r["text"]) for r in out.collect()) == want
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()  # no function is called for each hit


def test_conflicts_are_sorted_without_a_function(spark):
    rules = [{"rule_index": k, "enabled": True, "mode": m, "find": f, "replace": "<>"} for k, (m, f) in enumerate([("regex", "ab?"), ("exact", "ab")])]
    b = spark.createDataFrame([(1, "p", "ab a " * 30), (2, "p", "ab a")], "doc_id long, location string, text string")
    out = resolve.batch_replace(b, rules).select("doc_id", "redacted")
    assert sorted(map(tuple, out.collect())) == [(1, "<> <> " * 30), (2, "<> <>")]
    assert "array_sort" not in out._jdf.queryExecution().optimizedPlan().toString()


BOXES = "doc_id long, page int, y_center double, rect struct<x:double,y:double,w:double,h:double>"


def merged_one_by_one(rows, gap=30, tol=8):
    pages = {}
    for d, p, y, r in rows:
        pages.setdefault((d, p), []).append((y, r))
    out = []
    for own in pages.values():
        lines = []
        for y, r in sorted(own):
            if not lines or y - lines[-1][0] > tol:
                lines.append((y, []))
            lines[-1][1].append(r)
        for _, rects in lines:
            islands = []
            for x, y, w, h in sorted(rects):
                if islands and x - islands[-1][2] <= gap:
                    x0, y0, x1, y1 = islands[-1]
                    islands[-1] = (x0, min(y0, y), max(x1, x + w), max(y1, y + h))
                else:
                    islands.append((x, y, x + w, y + h))
            out += [(x0, y0, x1 - x0, y1 - y0) for x0, y0, x1, y1 in islands]
    return sorted(out)


@pytest.mark.parametrize("batch", ["1", "7", "10000"])
def test_boxes_of_a_line_are_joined_over_batches(spark, batch):
    rng = random.Random(3)
    rows = [(rng.randrange(3), 0, rng.randrange(300) / 3, (float(rng.randrange(9000)), float(rng.randrange(60)), float(rng.randrange(1, 40)), 10.0)) for _ in range(1500)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, batch)
    try:
        got = sorted(tuple(r["rect"]) for r in geometry.merge_adjacent(spark.createDataFrame(rows, BOXES).repartition(3)).collect())
    finally:
        spark.conf.unset(key)
    assert got == merged_one_by_one(rows)


def test_boxes_with_unknown_sides_are_joined_as_before(spark):
    nan = float("nan")
    rows = [(1, 0, 5.0, (None, 0.0, 9.0, 9.0)), (1, 0, 5.0, (0.0, None, 10.0, 9.0)), (1, 0, 6.0, (20.0, 3.0, None, 9.0)), (1, 0, 7.0, (90.0, 0.0, 5.0, 9.0)), (2, 0, 5.0, (0.0, 0.0, nan, 9.0)), (2, 0, 5.0, (1.0, 0.0, 5.0, 9.0)), (3, 0, None, (0.0, 0.0, 1.0, 1.0)), (3, 0, 1.0, None)]
    got = sorted(repr((r["doc_id"], *r["rect"])) for r in geometry.merge_adjacent(spark.createDataFrame(rows, BOXES)).collect())
    assert got == ["(1, 0.0, 3.0, 10.0, 9.0)", "(1, 90.0, 0.0, 5.0, 9.0)", "(1, None, 0.0, None, 9.0)", "(2, 0.0, 0.0, nan, 9.0)", "(2, 1.0, 0.0, 5.0, 9.0)"]


def test_boxes_are_moved_and_sorted_once_and_tasks_grow_with_them(spark, monkeypatch):
    x = F.col("id") % 90_000
    df = spark.range(100_000).select((F.col("id") % 1000).alias("doc_id"), F.lit(0).alias("page"), (F.col("id") % 7 * 20.0).alias("y_center"), geometry.rect(x, F.lit(0), F.lit(5), F.lit(5)).alias("rect"))
    once = geometry.merge_adjacent(df)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1
    monkeypatch.setattr(geometry, "TASK_BOXES", 5_000)
    dealt = geometry.merge_adjacent(df, expected=100_000)
    assert dealt.select(F.spark_partition_id()).distinct().count() == 20
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, once.collect()))


def test_a_page_of_many_boxes_is_joined_in_seconds(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page"), (F.col("id") % 4 * 3.0).alias("y_center"), geometry.rect(F.col("id") * 20, F.lit(0), F.when(F.col("id") % 10 == 0, 0).otherwise(30), F.lit(9)).alias("rect"))
    began = time.time()
    assert geometry.merge_adjacent(df, gap=25).count() > 1 and time.time() - began < 60
