"""Detection: from text blocks to hits, rows with exact offsets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from maskwright.functions.spans import FLAGS, find_all, literal
from maskwright.operators.rules import GUARDS, Rule, first_seen

# Names of custom rules, block-list hits and name hits.
CUSTOM, BLOCK_PREFIX, NAME_RULE = "自定义", "黑名单:", "姓名启发式"
HIT_COLS = ["doc_id", "location", "start", "end", "text", "source", "channel", "rule_name", "rule_ord", "pattern", "replacement"]
#: Up to so many terms, of at most so many characters, are looked for one by one; more by automata of about so many bytes of terms each.
MAX_TERMS, MAX_LENGTH, TERM_BYTES = 32, 10_000, 1 << 20


def hit(x: Column, source: str, rule_name: Column, rule_ord: Column, pattern: Column, channel: str = "automatic") -> Column:
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.lit(source).alias("source"), F.lit(channel).alias("channel"),
        rule_name.alias("rule_name"), rule_ord.cast("int").alias("rule_ord"), pattern.alias("pattern"), F.lit(None).cast("string").alias("replacement"),
    )


def hits_in(text: Column, rules: list[Rule], source: str = "rule") -> Column:
    """All hits of all rules in a text as one array, without leaving the row. Rules may overlap one another."""
    # One function for each rule, as each needs its own pattern compiled once.
    one = lambda r: F.transform(find_all(text, F.lit(FLAGS + r.pattern)), lambda x: hit(x, source, F.lit(r.rule_name), F.lit(r.rule_ord), F.lit(r.pattern)))
    none = F.array().cast("array<struct<start:int,end:int,text:string,source:string,channel:string,rule_name:string,rule_ord:int,pattern:string,replacement:string>>")
    return F.flatten(F.array(*(F.when(_likely(text, r), one(r)).otherwise(none) for r in rules)))


def _likely(text: Column, r: Rule) -> Column:
    """Whether a rule may match at all, by what its matches must hold; rules without a guard always may."""
    guard = GUARDS.get(r.pattern, "")
    return F.lit(True) if not guard else text.rlike(FLAGS + guard[1:]) if guard[0] == "~" else text.contains(guard)


def find_spans(blocks: DataFrame, rules: list[Rule], source: str = "rule") -> DataFrame:
    """Every match of every rule: one row each. No shuffle; without rules there are no rows."""
    if not rules:
        return _rows(blocks.filter("false"), hits_in(F.col("text"), [Rule(0, "", "x")], source))
    return _rows(blocks, hits_in(F.col("text"), rules, source))


def _rows(blocks: DataFrame, hits: Column) -> DataFrame:
    return blocks.select("doc_id", "location", F.explode(hits).alias("x")).select("doc_id", "location", "x.*")


def find_keywords(blocks: DataFrame, keywords: list[str], source: str = "rule") -> DataFrame:
    """Literal keywords in any case."""
    return find_spans(blocks, [Rule(k, w, f"\\Q{w}\\E") for k, w in enumerate(dict.fromkeys(keywords)) if w.strip()], source)


def find_exact(blocks: DataFrame, needle: str, source: str, case: bool = False, channel: str = "automatic", rule_name: Column | None = None) -> DataFrame:
    """Occurrences of the needle that stands in each row's own column; in any case unless ``case``."""
    found = find_all(F.col("text"), F.concat(F.lit("" if case else FLAGS), literal(F.col(needle))))
    on = blocks.filter(F.col(needle).isNotNull() & (F.col(needle) != ""))
    return _rows(on, F.transform(found, lambda x: hit(x, source, F.col(needle) if rule_name is None else rule_name, F.lit(None), F.col(needle), channel)))


def term_shards(terms: DataFrame) -> Iterator[list[str]]:
    """Distinct terms in lists of about TERM_BYTES; a longer term is alone. A list at a time comes to the driver."""
    size = terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    n = -(-size // TERM_BYTES)
    for k in range(n):
        if own := [r["term"] for r in terms.filter(F.pmod(F.xxhash64("term"), F.lit(n)) == k).collect()]:
            yield own


def _automaton(terms: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        out.add_word(t, (k, len(t)))
    out.make_automaton()
    return out


def _found_in(terms: list[str], payload: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, names = _automaton(terms), pa.array(terms, pa.string())
        for b in batches:
            # the places of a batch as flat lists: starts, numbers of terms, and where a row's own begin
            texts, rows, starts, which, ends = b.column("_text"), [], [], [], [0]
            for k in range(len(b)):
                free = {}
                for last, (t, size) in automaton.iter(texts[k].as_py() or ""):
                    start = last + 1 - size
                    if start >= free.get(t, 0):  # occurrences of one term do not overlap
                        free[t] = last + 1
                        starts.append(start)
                        which.append(t)
                if len(starts) > ends[-1]:
                    rows.append(k)
                    ends.append(len(starts))
            kept = b.take(pa.array(rows, pa.int64()))
            places = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), names.take(pa.array(which, pa.int32()))], ["start", "term"])
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in payload), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places)], [*payload, "found"])

    return run


def find_terms(df: DataFrame, terms: DataFrame, payload: list[str], text_col: str = "text") -> DataFrame:
    """Rows that hold a term, with all places of all terms: payload, found (start, term; one term's places do not overlap).

    Terms (column ``term``, distinct, not empty) make an Aho-Corasick automaton, so a text is read once however many there are. Lists
    over TERM_BYTES make several, each with its own pass and rows. Only the payload and what was found leave the scan.
    """
    read = df.select(*payload, F.col(text_col).alias("_text"))
    schema = df.select(*payload).schema.add("found", DataType.fromDDL("array<struct<start:int,term:string>>"))
    out = [read.mapInArrow(_found_in(shard, payload), schema) for shard in term_shards(terms)]
    return reduce(DataFrame.unionByName, out) if out else df.sparkSession.createDataFrame([], schema)


def _few(terms: DataFrame) -> bool:
    n, longest = terms.limit(MAX_TERMS + 1).agg(F.count("*"), F.max(F.length("term"))).first()
    return n <= MAX_TERMS and (longest or 0) <= MAX_LENGTH


def with_terms(df: DataFrame, terms: DataFrame, payload: list[str]) -> DataFrame:
    """Rows with each term that their text holds: payload, term. A few terms are broadcast; more are found by an automaton."""
    if _few(terms):
        return df.join(F.broadcast(terms), F.contains(df["text"], terms["term"])).select(*payload, "term")
    found = find_terms(df, terms, payload)
    return found.select(*payload, F.explode(F.array_distinct(F.transform("found", lambda x: x["term"]))).alias("term"))


def scan_block_list(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """Case-sensitive occurrences of block-listed terms (column ``term``), as hits of source blacklist."""
    own = terms.select("term").filter("term <> ''").distinct()
    if _few(own):
        pairs = with_terms(blocks, own, ["doc_id", "location", "text"])
        return find_exact(pairs, "term", "blacklist", case=True, rule_name=F.concat(F.lit(BLOCK_PREFIX), "term")).withColumn("pattern", F.lit(None).cast("string"))
    place = F.struct(F.col("y.start").alias("start"), (F.col("y.start") + F.length("y.term")).alias("end"), F.col("y.term").alias("text"))
    one = hit(place, "blacklist", F.concat(F.lit(BLOCK_PREFIX), "y.term"), F.lit(None), F.lit(None).cast("string"))
    return find_terms(blocks, own, ["doc_id", "location"]).select("doc_id", "location", F.explode("found").alias("y")).select("doc_id", "location", one.alias("x")).select("doc_id", "location", "x.*")


def unique_then_expand(blocks: DataFrame, rules: list[Rule], source: str = "rule") -> DataFrame:
    """Distinct strings that the rules match in a block, then every literal occurrence of each, as hits named after the string.

    ``ord`` is the place of the string's first match. Occurrences that a rule's look-around refused are hits here.
    """
    at = F.posexplode(hits_in(F.col("text"), rules, source)).alias("ord", "x")
    found = blocks.filter(F.trim("text") != "").select("doc_id", "location", "text", at)
    strings = found.groupBy("doc_id", "location", F.col("x.text").alias("needle")).agg(F.min("ord").alias("ord"), F.first("text").alias("text"))
    spans = F.explode(find_all(F.col("text"), literal(F.col("needle")))).alias("y")
    return strings.select("doc_id", "location", "ord", "needle", spans).select("doc_id", "location", "y.start", "y.end", "y.text", F.lit(source).alias("source"), F.col("needle").alias("rule_name"), "ord")


def tag_source(channel: Column, kind: Column) -> Column:
    """Source of a hit by channel (word, page, image) and kind of pattern (rule, keyword, name)."""
    return (
        F.when(channel == "image", "ocr")
        .when(kind == "rule", "rule")
        .when(kind == "keyword", F.when(channel == "page", "ocr").otherwise("rule"))
        .otherwise("jieba")
    )


def attach_rule_name(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Names of the hits' patterns; the first rule of a pattern counts, an unknown pattern is a custom one."""
    names = first_seen(rules.select("pattern", F.col("rule_name").alias("_name"), "rule_ord"), ["pattern"], "rule_ord").drop("rule_ord")
    return hits.drop("rule_name").join(names, "pattern", "left").withColumn("rule_name", F.coalesce("_name", F.lit(CUSTOM))).drop("_name")


def pick_channels(pages: DataFrame, image_blocks: DataFrame) -> DataFrame:
    """Channels of each page: text if it has text, image if it has image blocks, page if neither: doc_id, page, channel."""
    images = image_blocks.groupBy("doc_id", "page").agg(F.count("*").alias("_images"))
    has_text, has_image = F.coalesce(F.trim("text"), F.lit("")) != "", F.coalesce("_images", F.lit(0)) > 0
    channels = F.filter(F.array(F.when(has_text, F.lit("text")), F.when(has_image, F.lit("image")), F.when(~has_text & ~has_image, F.lit("page"))), lambda c: c.isNotNull())
    return pages.join(images, ["doc_id", "page"], "left").select("doc_id", "page", F.explode(channels).alias("channel"))


def find_spans_in_lines(lines: list[DataFrame], rules: list[Rule]) -> DataFrame:
    """Hits over recognised lines of several passes: doc_id, page, pass, line_no, start, end, text, rule_name."""
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lines)
    return all_.select("doc_id", "page", "pass", "line_no", F.explode(hits_in(F.col("text"), rules, "ocr")).alias("x")).select("doc_id", "page", "pass", "line_no", "x.start", "x.end", "x.text", "x.rule_name")
