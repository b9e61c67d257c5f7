"""Spans in text as column expressions: offsets are code points from 0, ends are exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"
#: Put before every pattern: case does not matter, and classes such as \\d and \\w are Unicode ones.
FLAGS = "(?iU)"


def literal(needle: Column) -> Column:
    """A pattern that matches the needle as it is written."""
    return F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def let(value: Column, of) -> Column:
    """of(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: of(x)), F.lit(0))


def running(values: Column, combine) -> Column:
    """Running combination (``combine`` of two columns: sum, greatest, least) of an array by doubling steps: n * log2(n) work, and no array is copied for each element."""
    n = F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)).cast("double"))).cast("int")
    steps = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(steps, values, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, combine(x, F.get(acc, i - d))).otherwise(x)))


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


#: Code points of a stretch of a text that is cut often.
STRETCH = 1024


def stretches(text: Column) -> Column:
    """A text as an array of stretches of STRETCH code points, cut in one pass; a null or empty text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)), F.array().cast("array<string>"))


def piece_of(parts: Column, start: Column, end: Column) -> Column:
    """A piece of a text from its stretches: the work goes by the piece, not by its place in the text."""
    own = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    first, last = F.floor(start / STRETCH).cast("int"), F.floor(F.greatest(end - 1, start) / STRETCH).cast("int")
    at, to = start - first * STRETCH, end - last * STRETCH
    across = F.concat(F.substring(own(first), at + 1, F.lit(STRETCH)), F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(own(last), F.lit(1), to))
    return F.when(end <= start, F.lit("")).when(first == last, F.substring(own(first), at + 1, end - start)).otherwise(across)


def find_all(text: Column, pattern: Column) -> Column:
    """All non-overlapping matches, leftmost first. The pattern must not match the empty string.

    Matches and the gaps between them alternate, so running sums over both give every offset, in time in proportion to the text. Texts without
    a match cost one search; null text has no matches.
    """
    both = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    sizes = lambda x: F.transform(x["found"], lambda m, i: F.length(F.get(x["gaps"], i)) + F.length(m))
    place = lambda x, ends: F.transform(x["found"], lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("text")))
    found = let(both, lambda x: let(running_sum(sizes(x)), lambda ends: place(x, ends)))
    return F.when(F.regexp_like(text, pattern), found).otherwise(F.array().cast(SPAN)).cast(SPAN)


def text_width(text: Column) -> Column:
    """Estimated width: 1 for a CJK ideograph, 0.55 for any other character."""
    wide = F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"))
    return wide + 0.55 * (F.length(text) - wide)


def piece(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def _starts(text: Column, term: Column) -> Column:
    """Where the term occurs, overlaps included: the text is cut before each occurrence, and the pieces' lengths add up."""
    ends = let(F.split(text, F.concat(F.lit("(?="), literal(term), F.lit(")")), -1), lambda x: running_sum(F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda p: F.length(p))))
    return F.concat(F.when(F.startswith(text, term), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), ends)


def _gaps(text: Column, parts: Column, covered: Column) -> Column:
    """What spans (s, e; by start, overlaps allowed) leave of a text. The farthest end so far is a running maximum."""
    one = lambda s, e: F.struct(s.alias("start"), e.alias("end"), piece_of(parts, s, e).alias("text"))
    ends = running(F.transform(covered, lambda x: x["e"]), lambda a, b: F.greatest(a, b))

    def between(ends: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        inner = F.transform(covered, lambda x, i: F.when(x["s"] > before(i), one(before(i), x["s"])))
        last = before(F.size(ends))
        return F.filter(F.concat(inner, F.array(F.when(F.length(text) > last, one(last, F.length(text))))), lambda x: x.isNotNull())

    return let(ends, between)


def kept_runs(text: Column, terms: Column) -> Column:
    """What the terms' occurrences leave of the text, as spans. Occurrences are case-sensitive and may overlap; blank terms count for nothing.

    An empty text without terms is kept as one empty span; an empty text with terms is not kept.
    """
    real = F.filter(terms, lambda t: t.isNotNull() & (F.trim(t) != ""))
    hits = lambda t: F.when(F.contains(text, t), F.transform(_starts(text, t), lambda i: F.struct(i.alias("s"), (i + F.length(t)).alias("e")))).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
    covered = lambda own: F.array_sort(F.flatten(F.transform(own, hits)))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text"))).cast(SPAN)
    cut = lambda own: let(F.struct(stretches(text).alias("parts"), covered(own).alias("covered")), lambda x: _gaps(text, x["parts"], x["covered"]))
    return let(real, lambda own: F.when(F.size(own) == 0, whole).otherwise(cut(own).cast(SPAN)))


def splice(text: Column, plan: Column, default: Column) -> Column:
    """The text with the plan's spans (start, end, replacement; in order, disjoint) replaced; a null replacement is the default."""

    def joined(x: Column) -> Column:
        plan, parts = x["plan"], x["parts"]
        before = lambda i: F.coalesce(F.get(plan, i - 1)["end"], F.lit(0))
        cut = F.transform(plan, lambda h, i: F.concat(piece_of(parts, before(i), h["start"]), F.coalesce(h["replacement"], default)))
        return F.concat(F.array_join(cut, ""), piece_of(parts, before(F.size(plan)), F.length(text)))

    whole = let(F.struct(plan.alias("plan"), stretches(text).alias("parts")), joined)
    return F.when(F.size(plan) == 0, text).when(text.isNotNull(), whole)


def segments(text: Column, plan: Column, default: Column, replaced: bool = True) -> Column:
    """The text cut at the plan's spans: kind (text, replacement), text, source. Empty text segments are left out."""
    row = lambda kind, text, source: F.struct(F.lit(kind).alias("kind"), text.alias("text"), source.cast("string").alias("source"))

    def cut(x: Column) -> Column:
        plan, parts = x["plan"], x["parts"]
        before = lambda i: F.coalesce(F.get(plan, i - 1)["end"], F.lit(0))
        plain = lambda s, e: F.when(e > s, row("text", piece_of(parts, s, e), F.lit(None)))
        shown = (lambda h: F.coalesce(h["replacement"], default)) if replaced else (lambda h: piece_of(parts, h["start"], h["end"]))
        both = F.transform(plan, lambda h, i: F.array(plain(before(i), h["start"]), row("replacement", shown(h), h["source"])))
        last = F.array(plain(before(F.size(plan)), F.length(text)))
        return F.filter(F.concat(F.flatten(both), last), lambda s: s.isNotNull())

    return F.when(text.isNotNull(), let(F.struct(plan.alias("plan"), stretches(text).alias("parts")), cut))
