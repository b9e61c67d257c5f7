"""Secret scans: pattern matches plus sliding-window entropy, in DataFrame expressions only.

Three base kinds come from patterns (``assign``, ``access``, ``hex``). The entropy method adds spans: every maximal run
of a character class is a candidate; a window of fixed width slides over it, and the counts of the characters in the
window are updated by the one that enters and the one that leaves, so that the Shannon entropy costs the same at each
step. Runs of windows at or above the class's threshold become one span. Candidates that the allow list covers add none.

Everything is a per-row expression: no shuffle, no Python, and a row costs time in proportion to its text, times the logarithm of the number of its matches. Cheap tests
(``contains``, one ``rlike``) come first, as nearly all texts hold no candidate.

Defined results: null text is the empty text, which has no spans; ids may be null or repeated, each row is scanned for
itself; columns other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import let, running, text_of

SPAN = "array<struct<start:long,ord:int,end:long,kind:string>>"
#: Base kinds as listed: pattern, group that is measured, its least length. A run of ``access`` or ``hex`` that is long
#: enough is the same match with or without the count in its pattern, which spares the short ones.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What a text must hold before the pattern of a base kind is tried on it.
GUARD = {
    "assign": lambda t: (t.contains("=") | t.contains(":")) & t.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    "access": lambda t: t.contains("AKIA"),
    "hex": lambda t: t.rlike(r"[0-9a-f]{24}"),
}


@dataclass(frozen=True)
class CharClass:
    """A character class whose runs are candidates: kind of the spans, its letters, window width, least bits."""

    kind: str
    letters: str
    window: int
    bits: float


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharClass("entropy_hex", "0123456789abcdefABCDEF", 20, 3.0),
    CharClass("entropy_base64", f"{_AZ}{_AZ.lower()}0123456789+/_-=", 24, 4.0),
)
#: Places of a long run that are folded at once, and code points of a block of a text that is masked.
BLOCK = 4096
#: Candidates that hold one of these (in either case) are placeholders or well-known sequences.
ALLOW = ("example", "0123456789abcdef", "abcdefghijklmnop", "xxxxxxxx", "placeholder", "deadbeefdeadbeef")
#: Candidates that match one of these are not secrets: words without digits or without letters, identifiers made of words.
ALLOW_PATTERNS = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[A-Za-z]+(?:[/_=-][A-Za-z]+)*[/_=-]?[0-9]{0,6}$",
)


def _located(text: Column, pattern: str) -> Column:
    """Matches of the pattern with their places: array of (start, end, text) in code points, from running sums over gaps and matches."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    sizes = lambda x: F.transform(x["found"], lambda m, i: (F.length(F.get(x["gaps"], i)) + F.length(m)).cast("long"))
    place = lambda x, ends: F.transform(x["found"], lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("found")))
    return let(both, lambda x: let(running(sizes(x), lambda p, q: p + q), lambda ends: place(x, ends)))


def _base(text: Column, ord_: int) -> Column:
    kind, pattern, group, least = BASE[ord_]
    size = (lambda x: F.length(F.regexp_extract(x["found"], pattern, group))) if group else (lambda x: F.length(x["found"]))
    kept = F.filter(_located(text, pattern), lambda x: size(x) >= least)
    spans = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(ord_).alias("ord"), x["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(GUARD[kind](text), spans).otherwise(F.array().cast(SPAN)).cast(SPAN)


def _clogc(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def hot_windows(run: Column, cls: CharClass) -> Column:
    """Spans (from, to) inside a run of the class's letters that windows of enough entropy cover.

    The state of the fold holds the counts by letter and S, the sum of c*log2(c) over them; the entropy of a full window of
    w letters is log2(w) - S / w. A run shorter than the window has none. Long runs are folded in blocks of BLOCK places, so that no array
    grows with the run: each block starts 2w - 1 letters early, with the counts of no letter, and ends w places late, which is all
    that tells whether a window of the block is the first or last of its span.
    """
    w, bound = cls.window, (F.log2(F.lit(float(cls.window))) - F.lit(cls.bits)) * cls.window + F.lit(1e-9)
    far = -(1 << 30)

    def block(x: Column, k: Column) -> Column:
        first = k * BLOCK
        start = F.struct(F.array_repeat(F.lit(0), len(cls.letters) + 1).alias("n"), F.lit(0.0).alias("s"), F.lit(far).alias("last"), F.array().cast("array<int>").alias("from"), F.array().cast("array<int>").alias("to"))
        begin = F.greatest(first - (2 * w - 1), F.lit(0))

        def step(acc: Column, i: Column) -> Column:
            came = F.coalesce(F.get(x, i), F.lit(0))
            left = F.when(i - w >= begin, F.coalesce(F.get(x, i - w), F.lit(0))).otherwise(F.lit(0))
            c_in, c_out = F.get(acc["n"], came), F.get(acc["n"], left)
            moved = came != left
            gain = F.when(came > 0, _clogc(c_in + 1) - _clogc(c_in)).otherwise(0.0) + F.when(left > 0, _clogc(c_out - 1) - _clogc(c_out)).otherwise(0.0)
            s = F.when(moved, acc["s"] + gain).otherwise(acc["s"])
            n = F.when(moved, F.transform(acc["n"], lambda c, j: c + ((j == came) & (came > 0)).cast("int") - ((j == left) & (left > 0)).cast("int"))).otherwise(acc["n"])
            at = i - w + 1  # the window that ends here
            hot = (at >= begin) & (i < F.size(x)) & (s <= bound)
            in_block = lambda p: (p >= first) & (p < first + BLOCK)
            opens = hot & (acc["last"] < at - w) & in_block(at)
            closes = ~hot & (acc["last"] == at - w) & in_block(acc["last"])
            return F.struct(
                n.alias("n"), s.alias("s"), F.when(hot, at).otherwise(acc["last"]).alias("last"),
                F.when(opens, F.array_append(acc["from"], at)).otherwise(acc["from"]).alias("from"), F.when(closes, F.array_append(acc["to"], acc["last"] + w)).otherwise(acc["to"]).alias("to"),
            )

        # places of letters: the last window of the block ends at first + BLOCK + w - 2, and w more steps tell whether it is its span's last
        return F.aggregate(F.sequence(begin, F.least(first + BLOCK, F.size(x)) + 2 * w), start, step, lambda acc: F.struct(acc["from"].alias("from"), acc["to"].alias("to")))

    letters = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(cls.letters), c))
    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: block(x, k))
    ends = lambda b: F.arrays_zip(F.flatten(F.transform(b, lambda y: y["from"])).alias("from"), F.flatten(F.transform(b, lambda y: y["to"])).alias("to"))
    return let(letters, lambda x: let(blocks(x), ends)).cast("array<struct<from:int,to:int>>")


def _allowed(run: Column, allow: tuple[str, ...], patterns: tuple[str, ...]) -> Column:
    held = [F.lower(run).contains(x.lower()) for x in allow] + [run.rlike(p) for p in patterns]
    return reduce(lambda a, b: a | b, held, F.lit(False))


def _entropy(text: Column, cls: CharClass, ord_: int, allow: tuple[str, ...], patterns: tuple[str, ...]) -> Column:
    char = "[" + "".join(sorted(cls.letters.replace("-", ""))).replace("0123456789", "0-9").replace(_AZ, "A-Z").replace(_AZ.lower(), "a-z") + ("-" if "-" in cls.letters else "") + "]"
    pattern = f"(?<!{char}){char}{{{cls.window},}}"
    runs = F.filter(_located(text, pattern), lambda x: ~_allowed(x["found"], allow, patterns))
    spans = F.flatten(
        F.transform(
            runs,
            lambda x: F.transform(
                hot_windows(x["found"], cls),
                lambda y: F.struct((x["start"] + y["from"]).cast("long").alias("start"), F.lit(ord_).alias("ord"), (x["start"] + y["to"]).cast("long").alias("end"), F.lit(cls.kind).alias("kind")),
            ),
        )
    )
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN)).cast(SPAN)


def _outside(spans: Column, others: Column) -> Column:
    """Spans that lie in none of the others: all are put in order of start and a running largest end of the others tells."""
    tag = lambda xs, own: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x.alias("x")))
    ends = lambda y: running(F.transform(y, lambda t: F.when(t["own"] == 0, t["x"]["end"]).otherwise(F.lit(-1).cast("long"))), F.greatest)
    outside = lambda y, e: F.transform(F.filter(F.transform(y, lambda t, i: F.struct(t.alias("t"), F.get(e, i).alias("e"))), lambda p: (p["t"]["own"] == 1) & (p["e"] < p["t"]["x"]["end"])), lambda p: p["t"]["x"])
    clean = let(F.array_sort(F.concat(tag(others, 0), tag(spans, 1))), lambda y: let(ends(y), lambda e: outside(y, e)))
    return F.when(F.size(spans) > 0, F.when(F.size(others) > 0, clean).otherwise(spans)).otherwise(F.array().cast(SPAN)).cast(SPAN)


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    classes: tuple[CharClass, ...] = CLASSES,
    allow: tuple[str, ...] = ALLOW,
    allow_patterns: tuple[str, ...] = ALLOW_PATTERNS,
    payload: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: the id, ``payload`` columns under ``p_<name>``, ``text``, ``base`` and ``spans`` (arrays of start, ord, end, kind in order).

    An entropy span that lies inside another span is not repeated.
    """
    read = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), *(F.col(c).alias(f"p_{c}") for c in payload))
    cols = [_base(F.col("text"), k) for k in range(len(BASE))]
    extra = [_entropy(F.col("text"), c, len(BASE) + k, allow, allow_patterns) for k, c in enumerate(classes)]
    found = read.withColumns({f"s{k}": c for k, c in enumerate([*cols, *extra])})
    base = F.array_sort(F.concat(*(F.col(f"s{k}") for k in range(len(BASE)))))
    out = found.withColumn("base", base)
    shown = F.col("base")
    for k in range(len(BASE), len(BASE) + len(extra)):
        shown = F.concat(shown, _outside(F.col(f"s{k}"), shown))
    return out.withColumn("spans", F.array_sort(shown)).drop(*(f"s{k}" for k in range(len(BASE) + len(extra))))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(df: DataFrame, **kw) -> DataFrame:
    """The scan as counts by base kind, the base spans' sha256 and the list of all spans."""
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(df, **kw).select(F.col("id").alias("doc_id"), *(n(k) for k, *_ in BASE), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _between(blocks: Column, begin: Column, end: Column) -> Column:
    """The text from begin to end, of a text that is cut into blocks of BLOCK code points: only the blocks that it meets are looked at."""
    first, last = F.floor(begin / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    a, z = (begin % BLOCK).cast("int"), (end % BLOCK).cast("int")
    head, tail = F.get(blocks, first), F.coalesce(F.get(blocks, last), F.lit(""))
    inner = F.when(last > first + 1, F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")).otherwise(F.lit(""))
    one, more = F.substring(head, a + 1, z - a), F.concat(F.substring(head, a + 1, F.lit(BLOCK)), inner, F.substring(tail, F.lit(1), z))
    return F.coalesce(F.when(first == last, one).otherwise(more), F.lit(""))


def mask(df: DataFrame, marker: str = "[SECRET]", payload: tuple[str, ...] = (), **kw) -> DataFrame:
    """The scan's rows with every span replaced by the marker; overlapping spans by one. Texts without spans stay as they are."""
    done = running(F.transform("spans", lambda x: x["end"]), F.greatest)

    def cut(b: Column, e: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(e, i - 1)).otherwise(F.lit(0).cast("long"))
        parts = F.transform("spans", lambda x, i: F.when(x["start"] >= before(i), F.concat(_between(b, before(i), x["start"]), F.lit(marker))).otherwise(F.lit("")))
        rest = _between(b, F.element_at(e, -1), F.length("text").cast("long"))
        return F.array_join(F.array_append(parts, rest), "")

    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    masked = F.when(F.size("spans") > 0, let(blocks, lambda b: let(done, lambda e: cut(b, e)))).otherwise(F.col("text"))
    return scan(df, payload=payload, **kw).withColumn("masked", masked)


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _sql() -> str:
    """SQL for the digest: entropies from each window's own counts, not from running ones."""
    keys = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = f"""({keys})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    found = lambda name, source, pattern: f"""{name}0 AS (SELECT r, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs FROM {source} WHERE regexp_matches(text, '{pattern}')),
{name}1 AS (SELECT r, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM {name}0),
{name} AS (SELECT r, ms[i] AS m, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM {name}1)"""  # noqa: E731
    parts = ["d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)", found("a", "d", assign), found("k", "d", BASE[1][1]), found("x", "d", BASE[2][1])]
    base = " UNION ALL ".join(f"SELECT r, s, {k} AS o, s + length(m) AS e, '{n}' AS kind FROM {t}{where}" for k, (n, t, where) in enumerate((("assign", "a", f" WHERE length(regexp_extract(m, '{assign}', 2)) >= 6"), ("access", "k", ""), ("hex", "x", ""))))
    parts.append(f"b0 AS ({base})")
    for k, c in enumerate(CLASSES):
        letters = "[" + "".join(sorted(set(c.letters) - {"-"})).replace("0123456789", "0-9").replace(_AZ, "A-Z").replace(_AZ.lower(), "a-z") + ("-" if "-" in c.letters else "") + "]"
        allowed = " OR ".join([f"contains(lower(m), '{a.lower()}')" for a in ALLOW] + [f"regexp_matches(m, '{p.replace('^(?i)', '(?i)^')}')" for p in ALLOW_PATTERNS])
        parts += [
            found(f"c{k}", "d", f"{letters}{{{c.window},}}"),
            f"n{k} AS (SELECT r, s, m FROM c{k} WHERE NOT ({allowed}))",
            f"w{k} AS (SELECT r, s, m, unnest(range(length(m) - {c.window} + 1)) AS i FROM n{k})",
            f"u{k} AS (SELECT r, s, i, unnest(string_split(m[i + 1:i + {c.window}], '')) AS ch FROM w{k})",
            f"q{k} AS (SELECT r, s, i, count(*) AS n FROM u{k} GROUP BY r, s, i, ch)",
            f"h{k} AS (SELECT r, s, i FROM q{k} GROUP BY r, s, i HAVING -sum(n / {c.window}.0::DOUBLE * log2(n / {c.window}.0::DOUBLE)) >= {c.bits} - 1e-9)",
            f"g{k} AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY r, s ORDER BY i) <= {c.window} THEN 0 ELSE 1 END AS cut FROM h{k})",
            f"j{k} AS (SELECT *, sum(cut) OVER (PARTITION BY r, s ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM g{k})",
            f"e{k} AS (SELECT r, s + min(i) AS s, {len(BASE) + k} AS o, s + max(i) + {c.window} AS e, '{c.kind}' AS kind FROM j{k} GROUP BY r, s, island)",
            f"b{k + 1} AS (SELECT * FROM b{k} UNION ALL SELECT * FROM e{k} WHERE NOT EXISTS (SELECT 1 FROM b{k} y WHERE y.r = e{k}.r AND y.s <= e{k}.s AND y.e >= e{k}.e))",
        ]
    listed_ = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e)"
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{n}') AS BIGINT) AS n_{n}" for n, *_ in BASE)
    return f"WITH {', '.join(parts)} SELECT d.doc_id, {counts}, sha256({listed_} FILTER (WHERE o < {len(BASE)}), '')) AS base_sha256, {listed_} FILTER (WHERE o IS NOT NULL), '') AS spans FROM d LEFT JOIN b{len(CLASSES)} z ON z.r = d.r GROUP BY d.r, d.doc_id"


SQL = _sql()
