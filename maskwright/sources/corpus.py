"""Documents in, redacted documents out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def blocks_from_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A block for each line: doc_id, location (paragraph_<n>), block_no, kind, text. No shuffle; a long document becomes many short rows.

    An empty text is one empty line. A null text has no lines, so its document has no block; join it back by id where it is needed.
    """
    lines = F.posexplode(F.split(F.col(text_col), "\n")).alias("block_no", "text")
    return df.select(F.col(id_col).alias("doc_id"), lines).select("doc_id", F.concat(F.lit("paragraph_"), "block_no").alias("location"), "block_no", F.lit("paragraph").alias("kind"), "text")


def blocks_from_cells(df: DataFrame, doc: Column, table: Column, row: Column, cell: Column, text: Column) -> DataFrame:
    """A block for each table cell, at table_<t>_cell_<r>_<c>."""
    return df.select(doc.alias("doc_id"), F.format_string("table_%d_cell_%d_%d", table, row, cell).alias("location"), cell.cast("int").alias("block_no"), F.lit("cell").alias("kind"), text.alias("text"))


def read_corpus(spark: SparkSession, paths: list[str], fmt: str = "text") -> DataFrame:
    """Many files as one table with their path, size and time. Text files are whole texts, one row each."""
    reader = spark.read.option("wholetext", True) if fmt == "text" else spark.read
    df = reader.format(fmt).load(paths)
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "path"), ("file_size", "size"), ("file_modification_time", "modified"))]
    return df.select(*(F.col(c).alias("text" if fmt == "text" else c) for c in df.columns), *meta)


#: A larger file is a failure; its bytes are not read.
MAX_FILE = 512 << 20


def read_files(spark: SparkSession, paths: list[str], max_bytes: int = MAX_FILE, glob: str = "*") -> DataFrame:
    """One row for each file, readable or not: path, size, modified, text, status (success, failed), error.

    A file fails by itself: one over ``max_bytes``, and one that is not UTF-8, have no text but an error; the others pass. Files are
    read as bytes, so no decoder can stop the job; sizes are filtered before bytes are read. Spark's reader skips empty files, so they have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths)
    meta = [F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    text = F.col("content").cast("string")
    error = F.when(~F.is_valid_utf8(F.col("raw")), "not UTF-8")
    small = files.filter(F.col("length") <= max_bytes).select(*meta, text.alias("raw")).withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), F.col("raw"))).drop("raw")
    large = files.filter(F.col("length") > max_bytes).select(*meta, F.lit("too large").alias("error"), F.lit(None).cast("string").alias("text"))
    status = F.when(F.col("error").isNull(), "success").otherwise("failed")
    return small.unionByName(large).select("path", "size", "modified", "text", status.alias("status"), "error")


def parse_records(df: DataFrame, schema: str, json_col: str = "text") -> DataFrame:
    """JSON records as columns, with status and error; a broken record is one failed row that keeps its text in ``corrupt``."""
    fields = [f.split()[0] for f in schema.split(", ")]
    r = F.from_json(F.col(json_col), f"{schema}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    out = df.withColumn("_r", r).withColumn("corrupt", F.when(F.col(json_col).isNull() | F.col("_r").isNull(), F.coalesce(F.col(json_col), F.lit(""))).otherwise(F.col("_r.corrupt")))
    bad = F.col("corrupt").isNotNull()
    own = [F.when(~bad, F.col(f"_r.{c}")).alias(c) for c in fields]
    return out.select(*(c for c in df.columns if c not in (*fields, json_col)), *own, "corrupt", F.when(bad, "failed").otherwise("success").alias("status"), F.when(bad, "not a record").alias("error"))


# What a path must not hold, and its greatest length.
META_CHARS = (";", "|", "&", "$", "`", ">", "<", "\n", "\r")
ESCAPES = ("%00", "%0a", "%0d")
MAX_PATH = 4096
BASE_DIRS = ("/tmp", "/var/tmp", "/home", "/data")


def filter_manifest(files: DataFrame, allowed_ext: list[str] | None = None, base_dirs: tuple[str, ...] = BASE_DIRS, path_col: str = "path") -> DataFrame:
    """Files with ``reject_reason`` (null: accepted); of several reasons the first counts.

    Paths are taken as they are: absolute, with ``.``-free segments; ``..`` in the name or a leading dot is refused, and a
    directory counts only up to a slash.
    """
    p = F.col(path_col)
    name = F.substring_index(p, "/", -1)
    ext = F.when(F.instr(F.substring(name, F.lit(2), F.length(name)), ".") > 0, F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1)))).otherwise("")
    any_of = lambda conds: F.greatest(*conds) if len(conds) > 1 else conds[0]
    reason = (
        F.when(F.coalesce(p, F.lit("")) == "", "empty path")
        .when(F.length(p) > MAX_PATH, "path too long")
        .when(any_of([F.contains(p, F.lit(c)) for c in META_CHARS]), "shell character")
        .when(any_of([F.contains(F.lower(p), F.lit(c)) for c in ESCAPES]), "encoded control character")
        .when(F.contains(p, F.lit("\\")), "backslash")
        .when(F.contains(p, F.lit("\0")), "null byte")
        .when(~any_of([F.startswith(p, F.lit(b.rstrip("/") + "/")) for b in base_dirs]) | F.contains(p, F.lit("/../")), "outside the allowed directories")
        .when((name == "") | F.startswith(name, F.lit(".")) | F.contains(name, F.lit("..")), "invalid file name")
    )
    if allowed_ext:
        reason = reason.when(~ext.isin(*[e.lower() for e in allowed_ext]), "file type not allowed")
    return files.withColumn("reject_reason", reason)


def write_redacted(df: DataFrame, path: str, run_id: str | None = None) -> str:
    """Write under a run of its own; an existing run is never overwritten. Returns the run's folder."""
    target = f"{path.rstrip('/')}/run_id={run_id or uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(target)
    return target
