"""Personal names from a table of tagged tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from maskwright.operators.detect import NAME_RULE, find_exact
from maskwright.sources.shared import stored

#: Tokens of a batch between a tagger and Spark.
ROWS = 10_000


def tag_tokens(blocks: DataFrame, start: Callable[[], Callable[[str], Iterable[tuple[str, str]]]]) -> DataFrame:
    """Tagged tokens by a tagger of the user's: doc_id, location, tok_no, word, flag. Blocks: doc_id, location, text.

    ``start`` loads the model and returns a function from a text to its words with their flags. It is called in the task that needs it, once
    and not before the first text; texts come and rows go by batches of at most ``ROWS`` tokens, so a long text's tokens are not held together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, rows = None, []
        for b in batches:
            for doc, location, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                if text is None:
                    continue
                tag = tag or start()
                for k, (word, flag) in enumerate(tag(text)):
                    rows.append((doc, location, k, word, flag))
                    if len(rows) == ROWS:
                        yield _batch(rows, schema)
                        rows = []
        if rows:
            yield _batch(rows, schema)

    read = blocks.select("doc_id", "location", "text")
    out = read.select("doc_id", "location").schema.add("tok_no", "integer").add("word", "string").add("flag", "string")
    schema = to_arrow_schema(out)
    return read.mapInArrow(run, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def name_candidates(tokens: DataFrame, surnames: DataFrame, exclude: DataFrame) -> DataFrame:
    """Tokens with a flag of names, two to four characters, a surname's first character and not excluded: doc_id, location, word, ord.

    ``surnames`` (ch) and ``exclude`` (word) are tables of the user's language; the join's size decides how they move.
    """
    named = tokens.filter(F.col("flag").startswith("nr") & F.length("word").between(2, 4))
    first = named.withColumn("ch", F.substring("word", 1, 1)).join(surnames.select("ch").distinct(), "ch", "left_semi").drop("ch")
    return first.join(exclude.select("word").distinct(), "word", "left_anti").groupBy("doc_id", "location", "word").agg(F.min("tok_no").alias("ord"))


def inject_names(blocks: DataFrame, names: DataFrame, patterns: list[str] = (), page: bool = False) -> DataFrame:
    """Hits of each block's own candidate names, without those that are rules or keywords already."""
    new = names.filter(~F.col("word").isin(*patterns)) if patterns else names
    pairs = blocks.join(new.select("doc_id", "location", "word"), ["doc_id", "location"])
    return find_exact(pairs, "word", "jieba", rule_name=F.lit(NAME_RULE) if page else None)


def name_source_text(pages: DataFrame, lines: DataFrame, least: int = 50) -> DataFrame:
    """Text to look for names in: a page's own, or its recognised lines where it has image blocks and under ``least`` characters.

    The pages that ask for lines are stored first, so Spark knows their size: lines of others go before they are moved, by a broadcast if these
    pages are few, and pages with a text of their own never move.
    """
    short = F.coalesce((F.length(F.trim(F.coalesce("text", F.lit("")))) < least) & F.col("has_images"), F.lit(False))
    asking = stored(pages.filter(short), "pages")
    own = lines.join(asking.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    joined = own.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("_lines"))
    read = asking.join(joined, ["doc_id", "page"], "left").withColumn("text", F.coalesce("_lines", "text"))
    columns = ["doc_id", "page", *(c for c in pages.columns if c not in ("doc_id", "page"))]
    return pages.filter(~short).select(columns).unionByName(read.select(columns))
