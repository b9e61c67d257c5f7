"""A sink that takes each batch of a run once, however often it is delivered.

Layout: ``data/run_id=<run>/batch_id=<k>/try=<any>`` holds rows, ``manifest/run_id=<run>/batch_id=<k>`` one row that names the folder
that counts. Rows are written first, the manifest last, both by Spark's own writers, so any store will do. A try that was broken off has no
manifest row and is never read; a batch that has one is skipped. Each run has one writer at a time, as a streaming query has.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "folder string, n_rows long, run_id string, batch_id long"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Committed batches: folder, n_rows, run_id, batch_id. A path that is not there yet has none."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest").select("folder", "n_rows", "run_id", "batch_id")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def write_once(df: DataFrame, path: str, run_id: str, batch_id: int) -> bool:
    """Write a batch and commit it, unless it is committed already; says whether it was written."""
    spark, home = df.sparkSession, path.rstrip("/")
    mine = (F.col("run_id") == run_id) & (F.col("batch_id") == batch_id)
    if not manifest(spark, home).filter(mine).isEmpty():
        return False
    folder = f"{home}/data/run_id={run_id}/batch_id={batch_id}/try={uuid.uuid4().hex}"
    df.write.parquet(folder)
    n = spark.read.schema(df.schema).parquet(folder).count()
    spark.createDataFrame([(folder, n)], "folder string, n_rows long").coalesce(1).write.mode("errorifexists").parquet(f"{home}/manifest/run_id={run_id}/batch_id={batch_id}")
    return True


def read_committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of all committed batches. The manifest's folders, one for each batch, are the reader's paths."""
    folders = [r["folder"] for r in manifest(spark, path).select("folder").collect()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def uncommitted(spark: SparkSession, path: str) -> DataFrame:
    """Folders of tries that no manifest row names (column folder): what a clean-up may delete."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{path.rstrip('/')}/data").select("path")
    place = lambda c: F.regexp_extract(c, r"(run_id=[^/]+/batch_id=[^/]+/try=[^/]+)", 1)
    tries = files.select(place(F.col("path")).alias("key"), F.regexp_replace("path", r"/[^/]+$", "").alias("folder")).distinct()
    return tries.join(manifest(spark, path).select(place(F.col("folder")).alias("key")), "key", "left_anti").select("folder")
