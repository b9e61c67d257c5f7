import datetime as dt

import duckdb
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__
from maskwright.sources import config, corpus
from maskwright.streaming import jobs, queries as streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_blocks(spark):
    df = spark.createDataFrame([(1, "a\n\nb"), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["location"], r["text"]) for r in corpus.blocks_from_text(df).orderBy("doc_id", "block_no").collect()] == [(1, "paragraph_0", "a"), (1, "paragraph_1", ""), (1, "paragraph_2", "b"), (2, "paragraph_0", "")]
    cells = corpus.blocks_from_cells(df, F.col("doc_id"), F.lit(0), F.col("doc_id"), F.lit(3), F.col("text"))
    assert cells.filter("doc_id = 1").first()["location"] == "table_0_cell_1_3"


def test_manifest(spark):
    paths = ["", None, "/tmp/a;b.pdf", "/tmp/a%0Ab.pdf", "/tmp/a\\b.pdf", "/home_evil/a.pdf", "/etc/passwd", "/tmp/.x.pdf", "/tmp/a..pdf", "/tmp/a.exe", "/tmp/a.PDF", "/tmp/" + "a" * 5000, "/tmp/x/../../etc/a.pdf", "/tmp/dir/"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string")
    got = [r["reject_reason"] for r in corpus.filter_manifest(df, [".pdf"]).orderBy("i").collect()]
    assert got == ["empty path", "empty path", "shell character", "encoded control character", "backslash"] + ["outside the allowed directories"] * 2 + ["invalid file name"] * 2 + ["file type not allowed", None, "path too long", "outside the allowed directories", "invalid file name"]


def test_read_and_write(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a", "b"):
        (tmp_path / "in" / f"{n}.txt").write_text(f"line {n}\nmore")
    df = corpus.read_corpus(spark, [f"file://{tmp_path}/in"])
    assert sorted((r["text"], r["size"]) for r in df.collect()) == [("line a\nmore", 11), ("line b\nmore", 11)]
    out = f"file://{tmp_path}/out"
    first, second = corpus.write_redacted(df, out), corpus.write_redacted(df, out)
    assert first != second and spark.read.parquet(out).count() == 4
    with pytest.raises(AnalysisException):
        corpus.write_redacted(df, out, first.rsplit("=", 1)[-1])


def test_config(spark):
    text = '{"a": {"pattern": "x"}, "b": {"pattern": "y", "enabled": false, "description": "d"}, "c": "z"}'
    df = spark.createDataFrame([(text,), ("rubbish",), (None,)], "config string")
    rows = config.rules_from_config(df).orderBy("rule_ord").collect()
    assert [(r["rule_name"], r["pattern"], r["enabled"], r["legacy"]) for r in rows] == [("a", "x", True, False), ("b", "y", False, False), ("c", "z", True, True)]
    assert [r["rule_name"] for r in config.rules_from_config(df, enabled_only=True).collect()] == ["a"]
    rules = spark.createDataFrame([(1, True, "exact", "f", "r"), (0, False, "regex", "g", "")], "rule_index int, enabled boolean, mode string, find string, replace string")
    text = config.export_replace_rules(rules)
    assert [tuple(r) for r in config.import_replace_rules(text).orderBy("rule_index").collect()] == [(0, False, "regex", "g", ""), (1, True, "exact", "f", "r")]
    assert config.import_replace_rules(text.select(F.replace("config", F.lit('"version":1'), F.lit('"version":2')).alias("config"))).count() == 0


def test_stream_redaction_equals_batch(spark):
    a = {tuple(r) for r in __spark_entry__.queries()["s1_stream_redact"](spark, SF).collect()}
    b = {tuple(r) for r in __spark_entry__.queries()["f3_render_redacted"](spark, SF).collect()}
    assert a == b and a


def test_stream_state_over_batches(spark, tmp_path):
    src, t0 = tmp_path / "log", dt.datetime(2024, 1, 1)
    schema = "hit_id string, seq long, op string, scope string, ts timestamp"
    rows = [[("a", 1, "ignore", "session", t0), ("b", 2, "confirm", "permanent", t0)], [("a", 3, "promote", "session", t0), ("b", 4, "revert", "session", t0)], [("a", 5, "promote", "session", t0 + dt.timedelta(1))]]
    got = {}

    def keep(df, k):
        for r in df.collect():
            got.pop(r["hit_id"], None) if r["deleted"] else got.update({r["hit_id"]: (r["action"], r["scope"], r["promoted_at"])})

    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{src}")
        log = spark.readStream.schema(schema).parquet(f"file://{src}")
        jobs.stream_overrides(log).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert got == {"a": ("ignore", "permanent", t0)}


LIBRARY = [n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", LIBRARY)
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if sql := __spark_entry__.oracle_sql().get(name):
        r = duck.execute(sql)
        at = [[d[0] for d in r.description].index(c) for c in cols]
        assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_versioned_lists_read_documents_in_many_tasks(spark, tmp_path, monkeypatch):
    rows = [(k, f"a{k} x{k}@mail.org\nb y{k}@host17.org 62170000{k:08d} z{k}@host.org") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(streams, "own_dir", lambda spark, name: f"{tmp_path}/own")
    got = streams.s3_versioned_lists(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["text"]) for r in got} == {(k, x) for k in range(40) if k % 3 for x in (f"z{k}@host.org", f"62170000{k:08d}") if "17" not in x}
    # no task read all documents, for the stream's input or for its lists
    for folder in ("found", "in/part_0", "in/part_1"):
        assert len(spark.read.parquet(f"{tmp_path}/own/{folder}").inputFiles()) > 1
