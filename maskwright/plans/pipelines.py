"""Whole scans: detect, lists, decisions, conflicts, rendering as one lazy plan each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.spans import kept_runs
from maskwright.operators import detect, geometry, lists, names, overrides, resolve
from maskwright.operators.rules import Rule


# Fixed value: name of what is found in the image channel, whose boxes have no text of their own.
IMAGE_RULE = "OCR图像通道"


@dataclass(frozen=True)
class Settings:
    """What a scan goes by; tables may be left out."""

    rules: list[Rule]
    allow: DataFrame | None = None
    block: DataFrame | None = None
    decisions: DataFrame | None = None
    names: DataFrame | None = None
    trim_only: bool | None = True
    default: str = "*"


def word_hits(blocks: DataFrame, s: Settings) -> DataFrame:
    """Hits of a text scan after lists and decisions. Blocks: doc_id, location, text; with decisions also doc_hash."""
    hits = detect.find_spans(blocks, s.rules)
    if s.names is not None:
        hits = hits.unionByName(names.inject_names(blocks, s.names, [r.pattern for r in s.rules]))
    if s.block is not None:
        hits = hits.unionByName(detect.scan_block_list(blocks, s.block))
    if s.allow is not None:
        hits = lists.apply_allow_list(hits, s.allow, s.trim_only)
    if s.decisions is not None:
        keyed = overrides.with_hit_id(hits.withColumn("doc_hash", F.col("doc_id").cast("string")))
        hits = overrides.filter_overridden(keyed, s.decisions).drop("doc_hash", "hit_id")
    return hits


def word_scan(blocks: DataFrame, s: Settings, edits: DataFrame | None = None) -> DataFrame:
    """Blocks with plan and redacted text; ``edits`` are manual and replace-rule hits. Where rules are all there is, nothing leaves the row."""
    if s.rules and edits is None and s.allow is s.block is s.decisions is s.names is None:
        return redact_rows(blocks, s.rules, default=s.default)
    hits = word_hits(blocks, s)
    hits = hits if edits is None else hits.unionByName(edits, allowMissingColumns=True)
    return resolve.render_redacted(resolve.planned(blocks, hits), s.default)


def redact_rows(blocks: DataFrame, rules: list[Rule], terms: list[str] = (), default: str = "*") -> DataFrame:
    """Detection, allow list, conflicts and rendering inside each row: no shuffle, so it also runs on streams.

    Blocks get plan and redacted. ``terms`` are allow-listed; a hit with one in it is left alone where the term stands.
    """
    hits = detect.hits_in(F.col("text"), rules)
    if terms:
        allow = F.array(*map(F.lit, terms))


        cut = lambda x: F.transform(kept_runs(x["text"], allow), lambda k: x.withField("end", x["start"] + k["end"]).withField("start", x["start"] + k["start"]).withField("text", k["text"]))
        hits = F.flatten(F.transform(hits, cut))
    plan = F.coalesce(resolve.plan_in(hits, 2), F.array().cast(resolve.PLAN))
    return resolve.render_redacted(blocks.withColumn("plan", plan), default)


def page_boxes(lines: DataFrame, rules: list[Rule], adjust: float = 0.0, gap: float = 30, y_tol: float = 8) -> DataFrame:
    """Boxes of what the rules find in recognised lines, near boxes of a line joined: doc_id, page, rect."""
    found = detect.hits_in(F.col("text"), rules, "ocr")
    spans = lines.filter(F.size(found) > 0).withColumn("x", F.explode(found))  # lines without a hit go before their boxes are worked out
    boxed = spans.withColumn("rect", geometry.span_rect(F.col("box"), F.col("text"), F.col("x.start"), F.col("x.end"), adjust=adjust)).filter("rect is not null")
    ys = F.transform("box", lambda p: p["y"])
    placed = boxed.withColumn("y_center", (F.array_min(ys) + F.array_max(ys)) / 2)
    return geometry.merge_adjacent(placed.select("doc_id", "page", "y_center", "rect"), gap, y_tol)


def page_scan(lines: DataFrame, rules: list[Rule], adjust: float = 0.0, gap: float = 30, y_tol: float = 8) -> DataFrame:
    """Boxes to cover on pages of recognised lines: spans to boxes, near boxes of a line joined, each box once."""
    return geometry.dedupe_rects(page_boxes(lines, rules, adjust, gap, y_tol))


def page_hits(lines: DataFrame, s: Settings, tokens: DataFrame | None = None, external: DataFrame | None = None, adjust: float = 0.0, gap: float = 30, y_tol: float = 8) -> DataFrame:
    """Boxes of a page scan with their source and rule, after lists and decisions: doc_id, page, ord, rect, text, source, rule_name.

    What the rules find in lines has no text of its own: the allow list looks it up in ``tokens`` (needed with a list) and
    drops the whole box. Block-listed tokens come with their term as text, and the allow list wins on an equal term. ``external``
    boxes (seals, manual ones) join behind the lists. Decisions know a box by its document, page (location ``page_<n>``) and edges.
    """
    by_place = Window.partitionBy("doc_id", "page").orderBy("rect.x", "rect.y", "rect.w", "rect.h")
    hits = page_boxes(lines, s.rules, adjust, gap, y_tol).select("doc_id", "page", F.row_number().over(by_place).alias("ord"), "rect", F.lit("").alias("text"), F.lit("ocr").alias("source"), F.lit(IMAGE_RULE).alias("rule_name"))
    if s.block is not None:
        hits = hits.unionByName(geometry.block_list_boxes(tokens, s.block))
    if s.allow is not None:
        hits = geometry.apply_allow_list_boxes(hits, tokens, s.allow)
    if external is not None:
        own = set(external.columns)
        hits = hits.unionByName(external.select(*(c for c in hits.columns if c in own)), allowMissingColumns=True)
    return hits if s.decisions is None else decided(hits, s.decisions)


def decided(hits: DataFrame, decisions: DataFrame) -> DataFrame:
    """Boxes of a page scan without those that a decision ignores."""
    return overrides.filter_overridden(with_page_id(hits), decisions).drop("hit_id")


def with_page_id(hits: DataFrame) -> DataFrame:
    """Boxes of a page scan with hit_id."""
    keyed = hits.withColumns({"doc_hash": F.col("doc_id").cast("string"), "location": F.concat(F.lit("page_"), F.col("page").cast("string"))})
    return overrides.with_hit_id(keyed).drop("doc_hash", "location")


def page_scan_with_lists(lines: DataFrame, s: Settings, tokens: DataFrame | None = None, external: DataFrame | None = None, **kw) -> DataFrame:
    """Each box of ``page_hits`` once, with the sources that found it: doc_id, page, rect, sources."""
    return by_box(page_hits(lines, s, tokens, external, **kw))


def by_box(hits: DataFrame) -> DataFrame:
    """Each box once: doc_id, page, rect, sources."""
    return hits.groupBy("doc_id", "page", "rect").agg(F.array_sort(F.collect_set("source")).alias("sources"))
