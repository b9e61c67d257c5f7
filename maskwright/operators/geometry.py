"""Boxes over recognised lines and page layout: arithmetic on tables, no pixels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.spans import kept_runs, piece, text_width
from maskwright.operators.detect import BLOCK_PREFIX, with_terms
from maskwright.operators.lists import with_own_terms
from maskwright.operators.rules import first_seen
from maskwright.sources.shared import stored

MIN_WIDTH = 5.0
#: Boxes for a task where their number is known. Up to 300 million make no more than 200 tasks; with more of them, Spark also sorts what a task writes.
TASK_BOXES = 1_500_000
SIDES = ("x0", "y0", "x1", "y1")
RECT = pa.struct([pa.field(c, pa.float64()) for c in "xywh"])
#: A box that meets more cells is not dealt to them.
MANY_CELLS = 256


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def image_regions(blocks: DataFrame, min_w: float = 24, min_h: float = 24, min_area: float = 400) -> DataFrame:
    """Image blocks (type 1) that are not tiny, each place once: the first block of a bbox rounded to two decimals."""
    w, h = F.col("bbox.x1") - F.col("bbox.x0"), F.col("bbox.y1") - F.col("bbox.y0")
    big = blocks.filter((F.col("type") == 1) & (w >= min_w) & (h >= min_h) & (w * h >= min_area))
    key = F.array(*(F.round(f"bbox.{c}", 2) for c in ("x0", "y0", "x1", "y1")))
    return first_seen(big.withColumn("_key", key), ["doc_id", "page", "_key"], "block_no").drop("_key")


def _side(box: Column, c: str, pick) -> Column:
    return pick(F.transform(box, lambda p: p[c]))


def shrink_box(box: Column, x_ratio: float = 0.15, y_ratio: float = 0.1) -> Column:
    """A box of points as its four corners, drawn in by half the ratio on each side (negative: out); an axis that would turn over stays."""
    x0, x1, y0, y1 = (_side(box, c, f) for c in ("x", "y") for f in (F.array_min, F.array_max))
    dx, dy = (x1 - x0) * x_ratio / 2, (y1 - y0) * y_ratio / 2
    flat_x, flat_y = x0 + dx >= x1 - dx, y0 + dy >= y1 - dy
    nx0, nx1 = F.when(flat_x, x0).otherwise(x0 + dx), F.when(flat_x, x1).otherwise(x1 - dx)
    ny0, ny1 = F.when(flat_y, y0).otherwise(y0 + dy), F.when(flat_y, y1).otherwise(y1 - dy)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(nx0, ny0), point(nx1, ny0), point(nx1, ny1), point(nx0, ny1))


def span_rect(box: Column, text: Column, start: Column, end: Column, scale: float = 1.0, off_x: float = 0.0, off_w: float = 0.0, adjust: float = 0.0) -> Column:
    """The part of a line's box that a span takes by text width, one unit in on both sides, at least 5 wide before and after scaling; null for an empty text or a box without width."""
    low, high = _side(box, "x", F.array_min), _side(box, "x", F.array_max)
    inset = (high - low) * adjust / 2
    values = {
        "x0": F.when(low + inset >= high - inset, low).otherwise(low + inset),
        "x1": F.when(low + inset >= high - inset, high).otherwise(high - inset),
        "y0": _side(box, "y", F.array_min),
        "y1": _side(box, "y", F.array_max),
        "total": text_width(text),
        "before": text_width(piece(text, F.lit(0), start)),
        "match": text_width(piece(text, start, end)),
    }

    def of(v: Column) -> Column:
        width = v["x1"] - v["x0"]
        x = (v["x0"] + v["before"] / v["total"] * width + 1) / scale - off_x
        w = F.greatest(F.lit(MIN_WIDTH), F.greatest(F.lit(MIN_WIDTH), v["match"] / v["total"] * width - 2) / scale - off_w)
        return F.when((F.length(text) > 0) & (width > 0), rect(x, v["y0"] / scale, w, (v["y1"] - v["y0"]) / scale))

    # One value computed once: a struct bound by a lambda keeps the expression small where the box is used many times.
    return F.get(F.transform(F.array(F.struct(*(c.alias(n) for n, c in values.items()))), of), 0)


def clip_to_page(r: Column, clip: Column) -> Column:
    """A box of an image region in page coordinates."""
    return rect(r["x"] + clip["x0"], r["y"] + clip["y0"], r["w"], r["h"])


def kept_span_rect(r: Column, text: Column, start: Column, end: Column) -> Column:
    """The part of a hit's box that a kept run takes by text width; null if the run holds a line feed or has no width."""
    total, match = text_width(text), text_width(piece(text, start, end))
    w = match / total * r["w"]
    ok = (F.length(text) > 0) & (end > start) & (F.instr(piece(text, start, end), "\n") == 0) & (w > 0)
    return F.when(ok, rect(r["x"] + text_width(piece(text, F.lit(0), start)) / total * r["w"], r["y"], w, r["h"]))


def merge_adjacent(hits: DataFrame, gap: float = 30, y_tol: float = 8, expected: int | None = None) -> DataFrame:
    """Boxes of one line whose horizontal gap is small, joined: doc_id, page, rect. Hits: doc_id, page, y_center, rect.

    Lines: in order of y a box joins the first line whose first y is near, so what counts is that anchor and not the neighbour;
    with boxes in order only the latest anchor can be near. Inside a line, gaps and islands over x. Boxes are moved and sorted once, by
    page, and stream in that order; of the open line only its islands are held. ``expected``: about how many hits there are, where
    this is known; then the number of tasks grows with them, otherwise Spark's settings decide.
    """
    own = rect(*(F.col(f"rect.{c}") for c in "xywh"))
    sides = {"x0": own["x"], "y0": own["y"], "x1": own["x"] + own["w"], "y1": own["y"] + own["h"]}
    real = hits.filter("y_center is not null and rect is not null")
    read = real.select("doc_id", "page", F.col("y_center").cast("double").alias("at"), *(v.alias(c) for c, v in sides.items()))
    tasks = (expected or 0) // TASK_BOXES
    dealt = read.repartition(tasks, "doc_id", "page") if tasks > hits.sparkSession.sparkContext.defaultParallelism else read.repartition("doc_id", "page")
    schema = hits.select("doc_id", "page", own.alias("rect")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, due = [], 0, 1
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= due:
                boxes, rest = _islands(pa.Table.from_batches(held).combine_chunks(), gap, y_tol)
                held, n, due = rest.to_batches(), rest.num_rows, 2 * rest.num_rows  # a long line is not gone through for each batch
                yield from boxes.to_batches()
        if n:
            yield from _islands(pa.Table.from_batches(held).combine_chunks(), gap, y_tol, last=True)[0].to_batches()

    return dealt.sortWithinPartitions("doc_id", "page", "at", "x0", "y0", "x1").mapInArrow(run, schema)


def _opens(at: np.ndarray, turned: np.ndarray, y_tol: float) -> np.ndarray:
    """Which boxes open a line. at: their y in order, turned: the first ones of a page. Equal y, also not finite ones, are of one line."""
    alike = (at[1:] == at[:-1]) | (np.isnan(at[1:]) & np.isnan(at[:-1]))
    opens = turned.copy()
    opens[1:] |= ~alike & ~(at[1:] - at[:-1] <= y_tol)
    # a box far from its neighbour opens a line; between such boxes, a line ends where the anchor is no longer near
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(at)) - 1
    wide = at[last] - at[first] > y_tol
    for i, j in zip(first[wide].tolist(), last[wide].tolist()):
        anchor = at[i]
        for k, y in enumerate(at[i : j + 1].tolist(), i):
            if y - anchor > y_tol:
                opens[k], anchor = True, y
    return opens


def _islands(rows: pa.Table, gap: float, y_tol: float, last: bool = False) -> tuple[pa.Table, pa.Table]:
    """Joined boxes of the lines that have ended, and what must be held of the last line. Null sides count for nothing, NaN is above all."""
    n = rows.num_rows
    if not n:
        return rows.select(["doc_id", "page"]).append_column("rect", pa.array([], RECT)), rows
    keys = [pc.dictionary_encode(rows.column(c).chunk(0), null_encoding="encode").indices.to_numpy() for c in ("doc_id", "page")]
    turned = np.append(True, np.logical_or(*(k[1:] != k[:-1] for k in keys)))
    at = rows.column("at").to_numpy()
    value = {c: rows.column(c).to_numpy() for c in SIDES}
    known = {c: rows.column(c).is_valid().to_numpy() for c in SIDES}
    with np.errstate(invalid="ignore"):
        opens = _opens(at, turned, y_tol)
        line = np.cumsum(opens) - 1
        order = np.lexsort([*(k for c in ("x1", "y0", "x0") for k in (np.where(known[c], value[c], 0), known[c])), line])
        v, ok = {c: value[c][order] for c in SIDES}, {c: known[c][order] for c in SIDES}
        first = np.flatnonzero(opens)
        longest = np.diff(np.append(first, n)).max()
        # reach: the furthest right side among the boxes of the line that come before
        reach, step = np.where(ok["x1"], v["x1"], -np.inf), 1
        while step < longest:
            reach[step:] = np.where(line[step:] == line[:-step], np.maximum(reach[step:], reach[:-step]), reach[step:])
            step *= 2
        reach = np.append(-np.inf, reach[:-1])
        before = np.cumsum(ok["x1"]) - ok["x1"]
        none = before == before[first][line]
        start = np.flatnonzero(none | (ok["x0"] & ~(v["x0"] - reach <= gap)))
    has = {c: np.logical_or.reduceat(ok[c], start) for c in SIDES}
    side = {c: np.fmin.reduceat(np.where(ok[c], v[c], np.nan), start) for c in ("x0", "y0")}
    side |= {c: np.maximum.reduceat(np.where(ok[c], v[c], -np.inf), start) for c in ("x1", "y1")}
    names = rows.select(["doc_id", "page"]).take(pa.array(order[start]))
    open_ = first[-1]
    done = len(start) if last else int(np.searchsorted(start, open_))
    with np.errstate(invalid="ignore"):
        parts = {c: (side[c], ~has[c]) for c in ("x0", "y0")} | {c: (side[f"{a}1"] - side[f"{a}0"], ~(has[f"{a}0"] & has[f"{a}1"])) for c, a in (("w", "x"), ("h", "y"))}
    box = pa.StructArray.from_arrays([pa.array(p[:done], mask=m[:done]) for p, m in (parts[c] for c in ("x0", "y0", "w", "h"))], fields=list(RECT))
    boxes = names.slice(0, done).append_column("rect", box)
    # islands stand for their boxes: what comes later in the line only widens or joins them, unless a side is null or not finite
    if all(np.isfinite(value[c][open_:]).all() for c in SIDES):
        held = [pa.array(np.full(len(start) - done, at[open_])), *(pa.array(side[c][done:]) for c in SIDES)]
        return boxes, pa.table([*names.slice(done).columns, *held], schema=rows.schema)
    return boxes, rows.slice(open_)


def collapse_touching(hits: DataFrame, pad: float = 2) -> DataFrame:
    """Boxes that touch the first box of a group join it; a group keeps its first text and rule and the box around all.

    Greedy and in order (``ord``, equal ones by box and texts), so a page's boxes stream past its first boxes, which are looked up by
    the cells they meet: a page costs its boxes and not boxes by groups, and only first boxes are held. A box with a coordinate that is null or not finite
    stands alone. Hits: doc_id, page, ord, rect, text, source, rule_name.
    """
    r = F.col("rect")
    read = hits.select("doc_id", "page", F.col("ord").cast("int").alias("ord"), rect(r["x"], r["y"], r["w"], r["h"]).alias("rect"), *(F.col(c).cast("string").alias(c) for c in ("text", "source", "rule_name")))
    by_page = read.repartition("doc_id", "page").sortWithinPartitions(*read.columns)
    places = by_page.select(*read.columns, *(F.col(f"rect.{c}").alias(f"_{c}") for c in "xywh"))
    kept, names = ["doc_id", "page", "ord", "text", "source", "rule_name"], read.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, groups, rows = None, _Groups(pad), []

        def done() -> pa.RecordBatch:
            own, around = pa.Table.from_batches(rows).combine_chunks(), groups.boxes()
            columns = {c: own.column(c).combine_chunks() for c in kept}
            columns["rect"] = pa.StructArray.from_arrays([pa.array([b[i] for b in around], pa.float64()) for i in range(4)], list("xywh"))
            return pa.RecordBatch.from_pydict({c: columns[c] for c in names})

        for b in batches:
            keys = list(zip(b.column("doc_id").to_pylist(), b.column("page").to_pylist()))
            firsts = []
            for k, box in enumerate(zip(*(b.column(f"_{c}").to_pylist() for c in "xywh"))):
                if keys[k] != page:
                    page = keys[k]
                    groups.turn_page()
                if groups.add(box):
                    firsts.append(k)
            if firsts:
                rows.append(b.select(kept).take(pa.array(firsts)))
            if groups.finished():
                # all but the open page's groups go out; those stay until it ends
                whole, n = pa.Table.from_batches(rows), groups.finished()
                rest = whole.slice(n).to_batches()
                rows[:] = whole.slice(0, n).to_batches()
                open_ = groups.split()
                yield done()
                rows[:], groups = rest, open_
        if rows:
            yield done()

    return places.mapInArrow(run, read.schema)


class _Groups:
    """Groups of touching boxes, page after page; only first boxes are held, by the cells of the open page that they meet."""

    def __init__(self, pad: float):
        self.pad, self.around, self.start, self.grid, self.wide = pad, [], 0, {}, []

    def turn_page(self) -> None:
        self.start, self.grid, self.wide = len(self.around), {}, []

    def finished(self) -> int:
        """Groups of pages that have ended."""
        return self.start

    def split(self) -> _Groups:
        """Take the open page's groups out, as an object of their own."""
        out, n = _Groups(self.pad), self.start
        out.around, self.around = self.around[n:], self.around[:n]
        out.grid = {c: [g - n for g in own] for c, own in self.grid.items()}
        out.wide = [g - n for g in self.wide]
        return out

    def boxes(self) -> list[tuple]:
        return [a[4] if a[5] is None else (a[5][0], a[5][1], a[5][2] - a[5][0], a[5][3] - a[5][1]) for a in self.around]

    def add(self, box: tuple) -> bool:
        """Whether the box is the first of a new group; else it joins the earliest whose first box it touches."""
        x, y, w, h = box
        if any(v is None or not math.isfinite(v) for v in box):
            self.around.append((0, 0, 0, 0, box, None))
            return True
        x1, y1 = x + w + self.pad, y + h + self.pad
        gx, gy = ((math.floor(min(p, q) / CELL), math.floor(max(p, q) / CELL)) for p, q in ((x, x1), (y, y1)))
        large = (gx[1] - gx[0] + 1) * (gy[1] - gy[0] + 1) > MANY_CELLS  # such a box is compared with all first boxes, and each box with it
        cells = [] if large else [(i, j) for i in range(gx[0], gx[1] + 1) for j in range(gy[0], gy[1] + 1)]
        near = range(self.start, len(self.around)) if large else {g for c in cells for g in self.grid.get(c, ())}.union(self.wide)
        touched = None
        for g in near:
            a = self.around[g]
            if a[5] is not None and not (a[2] < x or x1 < a[0] or a[3] < y or y1 < a[1]) and (touched is None or g < touched):
                touched = g
        if touched is not None:
            low = self.around[touched][5]
            low[:] = min(low[0], x), min(low[1], y), max(low[2], x + w), max(low[3], y + h)
            return False
        g = len(self.around)
        self.around.append((x, y, x1, y1, box, [x, y, x + w, y + h]))
        for c in cells:
            self.grid.setdefault(c, []).append(g)
        if large:
            self.wide.append(g)
        return True


#: Side of the cells that boxes of a page are dealt to.
CELL = 64


def _cell(v: Column) -> Column:
    return F.floor(v / CELL).cast("long")


def resolve_text(hits: DataFrame, tokens: DataFrame) -> DataFrame:
    """Boxes with ``resolved``: the first token whose box holds the middle of the hit's, or the empty text. Hits need ``ord`` for their identity on a page.

    A token goes into each cell of the page's grid that its box meets, a hit's middle lies in one, and they meet by cell: a page
    costs its tokens and hits, not their product. Tokens of pages without a hit go first.
    """
    here = tokens.join(hits.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    t = here.select("doc_id", "page", F.col("tok_no"), F.col("text").alias("_t"), F.col("rect").alias("_r")).filter("_r.w >= 0 and _r.h >= 0")
    across = lambda at, size: F.explode(F.sequence(_cell(F.col(at)), _cell(F.col(at) + F.col(size))))
    dealt = t.withColumn("_gx", across("_r.x", "_r.w")).withColumn("_gy", across("_r.y", "_r.h"))
    cx, cy = F.col("rect.x") + F.col("rect.w") / 2, F.col("rect.y") + F.col("rect.h") / 2
    inside = cx.between(F.col("_r.x"), F.col("_r.x") + F.col("_r.w")) & cy.between(F.col("_r.y"), F.col("_r.y") + F.col("_r.h"))
    placed = hits.select("doc_id", "page", "ord", "rect", _cell(cx).alias("_gx"), _cell(cy).alias("_gy"))
    found = placed.join(dealt, ["doc_id", "page", "_gx", "_gy"]).filter(inside).groupBy("doc_id", "page", "ord").agg(F.min_by("_t", "tok_no").alias("resolved"))
    return hits.join(found, ["doc_id", "page", "ord"], "left").withColumn("resolved", F.coalesce("resolved", F.lit("")))


def apply_allow_list_boxes(hits: DataFrame, tokens: DataFrame, terms: Column | DataFrame) -> DataFrame:
    """Boxes after the allow list (an array, or a table of any number of terms). With a text they are cut like text hits, each run taking
    its part of the box; without one the text is looked up, and the whole box goes if a term is in it. Manual boxes stay; with
    an empty table nothing changes."""
    if isinstance(terms, DataFrame) and terms.filter(F.trim("term") != "").isEmpty():
        return hits
    hits = stored(hits, "boxes")  # they are read three times, and Spark knows their size when they meet the tokens
    own = lambda df: with_own_terms(df, terms) if isinstance(terms, DataFrame) else (df, terms)
    held = lambda t: F.exists(t, lambda x: F.contains("text", x))
    looked_up = resolve_text(hits.filter("text = '' and source <> 'manual'"), tokens)
    blank, words = own(looked_up.withColumn("text", F.col("resolved")).drop("resolved"))
    kept = blank.filter(~held(words)).withColumn("text", F.lit("")).drop("_terms")
    text, words = own(hits.filter("text <> '' or source = 'manual'"))
    same = text.filter((F.col("source") == "manual") | ~held(words)).drop("_terms")
    cut = text.filter((F.col("source") != "manual") & held(words)).withColumn("_run", F.explode(kept_runs(F.col("text"), words))).drop("_terms")
    cut = cut.withColumns({"rect": kept_span_rect(F.col("rect"), F.col("text"), F.col("_run.start"), F.col("_run.end")), "text": F.col("_run.text")}).filter("rect is not null").drop("_run")
    return same.unionByName(cut).unionByName(kept)


def block_list_boxes(tokens: DataFrame, terms: DataFrame, scale: float = 1.0) -> DataFrame:
    """Whole boxes of tokens that hold a block-listed term, touching ones joined."""
    pairs = with_terms(tokens, terms.select("term").filter("term <> ''").distinct(), ["doc_id", "page", "tok_no", "rect"])
    order = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("tok_no", "term"))
    r = F.col("rect")
    hits = pairs.select("doc_id", "page", order.alias("ord"), rect(r["x"] / scale, r["y"] / scale, r["w"] / scale, r["h"] / scale).alias("rect"), F.col("term").alias("text"), F.lit("blacklist").alias("source"), F.concat(F.lit(BLOCK_PREFIX), "term").alias("rule_name"))
    return collapse_touching(hits)


def dedupe_rects(hits: DataFrame, ordered: bool = False) -> DataFrame:
    """Each box of a page once; ``ordered``: by document, page, x, y, w, h, which is a sort of all rows and so only for what is read in order."""
    out = hits.dropDuplicates(["doc_id", "page", "rect"])
    return out.orderBy("doc_id", "page", "rect.x", "rect.y", "rect.w", "rect.h") if ordered else out
