"""Conflicts between hits, rendering, manual edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.spans import find_all, let, literal, running, segments, splice
from maskwright.operators.detect import HIT_COLS, hit

def channel_rank() -> Column:
    return F.when(F.col("channel") == "replace", 0).when(F.col("channel") == "manual", 1).otherwise(2)

PLAN = "array<struct<start:int,end:int,replacement:string,source:string,channel:string,rule_name:string,rule_ord:int>>"


#: Hits that are held against each other one by one; and those that are gathered before they are appended to the plan.
FEW, CHUNK = 16, 128
_FIELDS = ("start", "end", "replacement", "source", "channel", "rule_name", "rule_ord")


def _own(x: Column) -> Column:
    return F.struct(*(x[c].alias(c) for c in _FIELDS))


def _one_by_one(candidates: Column) -> Column:
    apart = lambda acc, x: ~F.exists(acc, lambda a: (a["start"] < x["end"]) & (x["start"] < a["end"]))
    return F.sort_array(F.aggregate(candidates, F.array().cast(PLAN), lambda acc, x: F.when(apart(acc, x), F.concat(acc, F.array(_own(x)))).otherwise(acc)))


def _sweep(places: Column) -> Column:
    """Of places in order of start (start, new, item, free: where the next span that is taken begins) the items that are taken, or stay
    taken. One pass, which gathers numbers of places, by chunks, as Spark copies what a fold holds at each step."""

    def step(acc: Column, i: Column) -> Column:
        x = F.get(places, i)
        on = (x["new"] == 0) | ((x["start"] >= acc["at"]) & (x["item"]["end"] <= x["free"]))
        return F.when(on, F.struct(x["item"]["end"].alias("at"), F.concat(acc["out"], F.array(i)).alias("out"))).otherwise(acc)

    def chunk(acc: Column, k: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast("array<int>").alias("out"))
        numbers = F.sequence(k * CHUNK, F.least((k + 1) * CHUNK, F.size(places)) - 1)
        return F.aggregate(numbers, start, step, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    taken = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(places) - 1) / CHUNK).cast("int")), start, chunk, lambda acc: F.flatten(acc["out"]))
    return F.transform(taken, lambda i: F.get(places, i)["item"])


def _by_level(candidates: Column) -> Column:
    """Levels (channel, mode, rule) in order of preference. A level's hits come by start, as do the spans taken so far, so both are merged and
    swept once: a hit is taken if it starts behind all before it and ends before the next taken span."""
    level = lambda x: F.struct(x["rank"], x["m"], x["rule"])
    at = lambda v: F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | (level(F.get(v, i)) != level(F.get(v, i - 1))))

    def merged(taken: Column, own: Column) -> Column:
        place = lambda x, new: F.struct(x["start"].alias("start"), F.lit(new).alias("new"), (x["start"] - x["end"]).alias("size"), _own(x).alias("item"))
        held = F.transform(taken, lambda x: F.struct(place(x, 0).alias("p"), F.lit(0).alias("i")))
        new = F.transform(own, lambda x, i: F.struct(place(x, 1).alias("p"), i.alias("i")))
        key = lambda x: F.struct(x["p"]["start"].alias("start"), x["p"]["new"].alias("new"), x["i"].alias("i"), x["p"]["item"].alias("item"))
        both = F.transform(F.concat(held, new), key)
        return F.when(F.size(taken) == 0, both).otherwise(F.sort_array(both))

    def freed(places: Column) -> Column:
        begins = F.transform(F.reverse(places), lambda x: F.when(x["new"] == 0, x["start"]).otherwise(F.lit(2**31 - 1)))
        return let(F.reverse(running(begins, lambda a, b: F.least(a, b))), lambda b: F.transform(places, lambda x, i: x.withField("free", F.get(b, i))))

    def whole(v: Column) -> Column:
        def over(starts: Column) -> Column:
            def step(taken: Column, k: Column) -> Column:
                first = F.get(starts, k)
                own = F.slice(v, first + 1, F.coalesce(F.get(starts, k + 1), F.size(v)) - first)
                return let(merged(taken, own), lambda p: let(freed(p), _sweep))

            return F.aggregate(F.sequence(F.lit(0), F.size(starts) - 1), F.array().cast(PLAN), step)

        return let(at(v), over)

    return let(candidates, whole)


def greedy(candidates: Column) -> Column:
    """Of candidates in order of preference those that are disjoint from all taken before, by start.

    Some few are held against each other; more are swept level by level, in n * log2(n) steps for each level that a block has.
    """
    real = F.filter(candidates, lambda x: x["end"] > x["start"])
    return let(real, lambda v: F.when(F.size(v) <= FEW, _one_by_one(v)).otherwise(_by_level(v)))


def resolve_overlaps(hits: DataFrame) -> DataFrame:
    """A plan for each block: doc_id, location, plan. Replace rules beat manual edits, which beat automatic hits; then exact
    before regex, rule order, start, longer first. Hits of a block are gathered, which the block's text bounds."""
    mode = F.when(F.col("mode") == "regex", 1).otherwise(0) if "mode" in hits.columns else F.lit(0)
    row = F.struct(channel_rank().alias("rank"), mode.alias("m"), F.coalesce("rule_ord", F.lit(1 << 30)).alias("rule"), "start", (F.col("start") - F.col("end")).alias("size"), "end", "source", "rule_name", "replacement", "channel", "rule_ord")
    return hits.groupBy("doc_id", "location").agg(greedy(F.array_sort(F.collect_list(row))).alias("plan"))


def planned(blocks: DataFrame, hits: DataFrame) -> DataFrame:
    """Blocks with their plan; without hits it is empty."""
    return blocks.join(resolve_overlaps(hits), ["doc_id", "location"], "left").withColumn("plan", F.coalesce("plan", F.array().cast(PLAN)))


def replace_hits_in(text: Column, rules: list[dict]) -> Column | None:
    """Hits of replace rules in a text as one array; null (None) without rules that are enabled and look for something."""
    arrays = []
    for r in rules:
        if r.get("enabled", True) and r["find"]:
            found = find_all(text, literal(F.lit(r["find"])) if r["mode"] == "exact" else F.lit(r["find"]))
            one = lambda x, r=r: hit(x, "rule", F.lit(r["find"]), F.lit(r["rule_index"]), F.lit(r["find"]), "replace").withField("replacement", F.lit(r["replace"])).withField("mode", F.lit(r["mode"]))
            arrays.append(F.transform(found, _one_argument(one)))
    return F.concat(*arrays) if arrays else None


def match_replace_rules(blocks: DataFrame, rules: list[dict]) -> DataFrame:
    """Hits of replace rules (dicts of rule_index, enabled, mode, find, replace): exact ones match as written, regexes with their own case."""
    hits = replace_hits_in(F.col("text"), rules)
    if hits is None:
        return match_replace_rules(blocks.filter("false"), [{"find": "x", "mode": "exact", "rule_index": 0, "replace": ""}])
    return blocks.select("doc_id", "location", F.explode(hits).alias("x")).select("doc_id", "location", "x.*")


def _one_argument(f):
    return lambda x: f(x)


def render_redacted(blocks: DataFrame, default: str = "*") -> DataFrame:
    """Planned blocks with ``redacted``."""
    return blocks.withColumn("redacted", splice(F.col("text"), F.col("plan"), F.lit(default)))


def replaced_segments(blocks: DataFrame, default: str = "*", replaced: bool = True) -> DataFrame:
    """Planned blocks cut into segments: doc_id, location, seg_no, kind, text, source."""
    cut = segments(F.col("text"), F.col("plan"), F.lit(default), replaced)
    return blocks.select("doc_id", "location", F.posexplode(cut).alias("seg_no", "s")).select("doc_id", "location", "seg_no", "s.*")


def highlight_segments(blocks: DataFrame) -> DataFrame:
    """The same segments with the original text."""
    return replaced_segments(blocks, replaced=False)


def manual_exact(selections: DataFrame) -> DataFrame:
    """Selections (doc_id, location, start, end, text, replacement) as manual hits."""
    fixed = {"source": F.lit("manual"), "channel": F.lit("manual"), "rule_name": F.lit("manual"), "rule_ord": F.lit(None).cast("int"), "pattern": F.lit(None).cast("string")}
    return selections.withColumns(fixed).select(HIT_COLS)


def manual_global(selections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every occurrence of a selected text (doc_id, text, replacement) in its document, as written."""
    s = selections.select("doc_id", F.col("text").alias("needle"), F.col("replacement").alias("_replacement")).filter("needle <> ''").distinct()
    pairs = blocks.join(s, "doc_id").filter(F.contains("text", "needle"))
    found = find_all(F.col("text"), literal(F.col("needle")))
    rows = pairs.select("doc_id", "location", "_replacement", F.explode(found).alias("x")).select("doc_id", "location", "x.start", "x.end", "x.text", F.col("_replacement").alias("replacement"))
    return manual_exact(rows)


def undo_manual(manual: DataFrame, undone: DataFrame) -> DataFrame:
    """Manual rows without the undone ones: an exact one (the default) takes its own span, a global one all rows of its text in the document."""
    mode = F.coalesce("mode", F.lit("exact"))
    spans = undone.filter(mode == "exact").select("doc_id", "location", "start", "end")
    texts = undone.filter(mode == "global").select("doc_id", "text")
    return manual.join(spans, ["doc_id", "location", "start", "end"], "left_anti").join(texts, ["doc_id", "text"], "left_anti").select(manual.columns)


#: Code points of the stretches of a block by which runs and spans meet.
MEET = 256


def project_to_runs(plans: DataFrame, runs: DataFrame, default: str = "*") -> DataFrame:
    """Styled runs with ``redacted``: a replacement goes into the first run that its span meets; its text in later runs is deleted.

    Plans: doc_id, location, plan. Runs: doc_id, location, run_no, start, end, text, style. Runs and spans go into each stretch of the block
    that they reach into and meet there, a pair in its first common stretch only: a block costs its runs and spans, not their product.
    """
    reach = lambda s, e: F.explode(F.sequence(F.floor(s / MEET), F.floor(F.greatest(e - 1, s) / MEET)))
    spans = plans.select("doc_id", "location", F.explode("plan").alias("h")).withColumn("_at", reach(F.col("h.start"), F.col("h.end")))
    dealt = runs.select("doc_id", "location", "run_no", "start", "end").withColumn("_at", reach(F.col("start"), F.col("end")))
    once = F.col("_at") == F.floor(F.greatest("start", "h.start") / MEET)
    met = dealt.join(spans, ["doc_id", "location", "_at"]).filter((F.col("start") < F.col("h.end")) & (F.col("h.start") < F.col("end")) & once)
    first = F.col("run_no") == F.min("run_no").over(Window.partitionBy("doc_id", "location", "h.start"))
    own = F.struct((F.greatest("h.start", "start") - F.col("start")).alias("start"), (F.least("h.end", "end") - F.col("start")).alias("end"), F.when(first, F.coalesce("h.replacement", F.lit(default))).otherwise("").alias("replacement"))
    cuts = met.withColumn("own", own).groupBy("doc_id", "location", "run_no").agg(F.array_sort(F.collect_list("own")).alias("cuts"))
    none = F.array().cast("array<struct<start:int,end:int,replacement:string>>")
    return runs.join(cuts, ["doc_id", "location", "run_no"], "left").withColumn("redacted", splice(F.col("text"), F.coalesce("cuts", none), F.lit(default))).drop("cuts")


def plan_in(hits: Column, rank: int, exact_first: bool = False) -> Column:
    """The plan of one text's hits of one channel, without leaving the row; ``rank`` is the channel's."""
    mode = (lambda x: F.when(x["mode"] == "regex", 1).otherwise(0)) if exact_first else (lambda x: F.lit(0))
    row = lambda x: F.struct(F.lit(rank).alias("rank"), mode(x).alias("m"), x["rule_ord"].alias("rule"), x["start"].alias("start"), (x["start"] - x["end"]).alias("size"), x["end"].alias("end"), x["source"].alias("source"), x["rule_name"].alias("rule_name"), x["replacement"].alias("replacement"), x["channel"].alias("channel"), x["rule_ord"].alias("rule_ord"))
    return greedy(F.sort_array(F.transform(hits, row)))


def batch_replace(blocks: DataFrame, rules: list[dict], default: str = "*") -> DataFrame:
    """Replace rules over all documents: blocks with plan and redacted. No text is moved: hits, plan and text stay in the row."""
    hits = replace_hits_in(F.col("text"), rules)
    plan = F.array().cast(PLAN) if hits is None else F.coalesce(plan_in(hits, 0, exact_first=True), F.array().cast(PLAN))
    return render_redacted(blocks.withColumn("plan", plan), default)
