"""Small pieces that several operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of texts that a task's Python holds as objects at once, and bytes of an Arrow batch between Spark and Python; a longer text is alone.
SLICE_BYTES, BATCH_BYTES = 2 << 20, 8 << 20

_WORD = re.compile(WORD)
#: White space to str.split() that is part of a word here.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words(text: str) -> list[str]:
    """The words of a text; str.split() is many times faster than the pattern and the same where no odd space occurs."""
    return _WORD.findall(text) if _ODD.search(text) else text.split()


def word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str) -> Column:
    """The text column, null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words without building an array of them: words start where a non-space follows a space or the start."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)), F.lit(0))


def sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a column (without nulls) hold at most SLICE_BYTES in each; no row is lost, and a longer text is alone."""
    for b in batches:
        sizes = pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, i = np.cumsum(sizes), 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_BYTES, side="right")))
            yield b.slice(i, j - i)
            i = j


def give_back() -> None:
    """Hand freed memory back to the system: a Python worker outlives its task, and what it keeps counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def map_texts(df: DataFrame, run, schema, column: str = "text") -> DataFrame:
    """``mapInArrow`` over texts in bounded memory: Spark is asked for batches of at most BATCH_BYTES (a session setting, lowered
    where it is higher), which reach ``run`` in slices; what the task has freed is given back at its end."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(df.sparkSession.conf.get(key)) > BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(sliced(batches, column))
        give_back()

    return df.mapInArrow(whole, schema)


def _bytes(setting: str) -> int:
    """A size setting in bytes; one that is written in another unit, or unbounded, counts as too high."""
    return int(setting.removesuffix("b")) if re.fullmatch(r"\d+b?", setting) else BATCH_BYTES + 1


def let(value: Column, of) -> Column:
    """of(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: of(x)), F.lit(0))


def _power(k: Column) -> Column:
    return F.pow(F.lit(2.0), k).cast("int")


def running(values: Column, combine) -> Column:
    """Running combination (``combine`` of two columns: sum, greatest) of an array of longs by doubling steps: n * log2(n) work, no array is copied for each element."""
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)).cast("double"))).cast("int") - 1)
    step = lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= _power(k), combine(x, F.get(acc, i - _power(k)))).otherwise(x))
    return F.aggregate(passes, values, step)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where it is unset, a session on one machine
    gets a folder of its own; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/spark-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: later jobs neither repeat the work nor depend on an executor's disk."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
