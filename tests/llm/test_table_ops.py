import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from maskwright.llm import components, kd_search, ngram_join, source_mixing
from maskwright.llm.common import words

DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, sig string, row long, root string"


def rows(texts, sources=None):
    return [(i, x, "en", (sources or ["s"] * len(texts))[i], len(x or ""), 1, "x", 2, "y") for i, x in enumerate(texts)]


# ---- n-gram join ---------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text or "")]
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)]) if w else frozenset()


def brute(texts):
    sets, root = [shingle_set(x) for x in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sets, [find(i) for i in range(len(texts))]


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(n):
        base = rng.choices(vocab, k=rng.choice([3, 5, 9, 20, 60, 150]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return texts


HARD = ["", None, "\n \t", "L" * 9000, "l" * 9000, "l" * 9001, "z " + "m" * 5000 + " b c d e f g h i j", "z " + "M" * 5000 + " b c d e f g h i j", "one", "ONE", "one two", "one two three", "a b c d", "A b C d", "a b c d e", "é É", "x " * 4000, "tie tie tie tie"]


@pytest.mark.parametrize("heavy, block", [(32, 2048), (2, 3)])
def test_join_is_brute_force(spark, heavy, block):
    texts = corpus(1) + HARD
    sets, root = brute(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.digest(spark.createDataFrame(rows(texts), DOC), heavy=heavy, block=block).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    assert max(Counter(root).values()) >= 4


def test_join_with_a_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets, root = brute(texts)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.digest(spark.createDataFrame(rows(texts), DOC), heavy=8, block=16).collect()}
    assert got == dict(enumerate(root))


def test_join_with_null_and_repeated_ids_and_no_rows(spark):
    data = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "q r s t u"), (None, "lone text of five words"), (3, "a b c d e f"), (3, "a b c d e f")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in ngram_join.digest(df).collect()) == sorted([("None", "3"), ("7", "3"), ("7", "7"), ("None", "None"), ("3", "3"), ("3", "3")])
    assert ngram_join.digest(df.filter("false")).count() == 0


def test_dedupe_keeps_one_of_each_group(spark):
    texts = corpus(4, 30) + HARD
    sets, root = brute(texts)
    data = rows(texts) + [rows(texts)[0], rows(texts)[0]]
    out = ngram_join.dedupe(spark.createDataFrame(data, DOC))
    assert out.columns == [c.split()[0] for c in DOC.split(", ")]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({root[i] for i, s in enumerate(sets) if s} | {i for i, s in enumerate(sets) if not s})


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbB .\n\x0béÉ", max_size=40), st.text(alphabet="aAbB .\n\x0béÉ", max_size=40))
def test_shingles(a, b):
    assert len(ngram_join.shingles(a)) == len(shingle_set(a))
    both = len(np.intersect1d(ngram_join.shingles(a), ngram_join.shingles(b)))
    assert both == len(shingle_set(a) & shingle_set(b))


def test_boundary_follows_cost():
    assert ngram_join.boundary({10: 5, 40: 5, 200: 5}, 1.0) == 0
    assert ngram_join.boundary({10: 5, 40: 5, 200: 5}, 50.0) >= 40


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)] + [(500, k) for k in range(501, 560)] + [(9, 9)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for e in links for x in e}
    for _ in range(300):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in links)}


# ---- exact search --------------------------------------------------------------------------------------------------


def test_search_is_brute_force(spark):
    rng = np.random.default_rng(0)
    data = [(i, rng.normal(size=6).round(2).tolist()) for i in range(400)] + [(400 + i, [0.5] * 6) for i in range(60)]
    data += [(500, None), (550, []), (551, []), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (650, [float("nan")] * 6), (700, [float("inf")] + [0.0] * 5), (750, [1.0, 2.0]), (751, [3.0, 1.0]), (50, data[50][1]), (None, [1.0] * 6), (None, [9e5] * 6)]
    data += [(800, [1e30] + [0.0] * 5), (850, [600000.0] + [0.0] * 5), (851, [900000.0] + [0.5] * 5), (852, [3e7, -2e7, 1e7, 0.1, 0.2, 0.3]), (853, [-1e300] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id long, embedding array<double>, score int, rank int")
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in data if v is not None and None not in v and all(map(math.isfinite, v))]
    fit = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    want = []
    for k, (q, x) in enumerate(usable):
        if q is not None and q % 50 == 0:
            scored = sorted((-fit(sum(a * b for a, b in zip(x, y))), i is None, i or 0) for j, (i, y) in enumerate(usable) if j != k and len(y) == len(x))
            want += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:5], 1)]
    for kw in ({}, {"shard_rows": 50}):
        got = kd_search.top_k(df, F.col("id") % 50 == 0, **kw)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert (550, 1, 551, 0) in want and any(s > 1 << 53 for *_, s in want)
    assert kd_search.top_k(df.filter("false"), F.col("id") % 50 == 0).count() == 0


def test_tree_prunes_and_bounds_hold():
    rng = np.random.default_rng(1)
    points = rng.integers(-50, 50, (2000, 3)).astype(float)
    tree = kd_search.Tree(points, np.arange(2000), np.arange(2000))
    q = rng.integers(-50, 50, (20, 3)).astype(float)
    bounds = tree.bounds(q)
    for node, (i, j) in enumerate(tree.span):
        assert (tree.points[i:j] @ q.T <= bounds[:, node]).all()
    leaves = [k for k, c in enumerate(tree.kids) if not c]
    kth = np.sort(points @ q[0])[-5]
    assert np.mean([bounds[0][k] >= kth for k in leaves]) < 0.5


# ---- mixing --------------------------------------------------------------------------------------------------------


def mixing_docs(seed=0):
    rng = random.Random(seed)
    texts = [" ".join("w" for _ in range(rng.choice([0, 1, 7, 60, 400]))) for _ in range(300)] + [None, "big " * 9000]
    sources = [rng.choice(["a", "a", "a", "b", "c", None, "é"]) for _ in texts]
    return texts, sources


def test_mix_reaches_targets(spark):
    texts, sources = mixing_docs()
    df = spark.createDataFrame(rows(texts, sources) + [rows(texts, sources)[4]] * 3, DOC)
    got = source_mixing.mix(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, source_mixing.mix(df.repartition(5, "doc_id")).collect()), key=str)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == len(words(texts[r["doc_id"]] or "")) and r["taken"] <= 3 * r["size"]
        s = sources[r["doc_id"]]
        size[s], taken[s], target[s] = size[s] + r["size"], taken[s] + r["taken"], r["target"]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in names] == brute_targets([size[s] for s in names])
    assert all(r["source_size"] == size[sources[r["doc_id"]]] for r in got)
    assert all(abs(taken[s] - target[s]) <= source_mixing.BLOCK_WORDS for s in names)
    assert source_mixing.mix(df.filter("false")).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), max_repeat=3):
    """Shares of the whole size by weight; those above max_repeat times their size stop there and the rest is shared anew."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_:
        total = sum(weights[k % len(weights)] for k in open_)
        share = {k: left * weights[k % len(weights)] / total for k in open_}
        above = [k for k in open_ if share[k] > max_repeat * sizes[k]]
        if not above:
            for k in open_:
                out[k] = share[k]
            break
        for k in above:
            out[k] = float(max_repeat * sizes[k])
            left -= out[k]
        open_ = [k for k in open_ if k not in set(above)]
    return out


@settings(deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets(sizes):
    out = brute_targets(sizes)
    assert abs(sum(out) - sum(sizes)) < 1e-6 * max(1, sum(sizes))
    free = [t / w for t, s, w in zip(out, sizes, [5, 2, 1] * 4) if t < 3 * s]
    assert all(t <= 3 * s for t, s in zip(out, sizes)) and (not free or max(free) - min(free) < 1e-6 * max(free))


def test_many_sources(spark):
    """More sources than a group holds, most of one document: targets and draws are those of brute force."""
    n = 9000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 40 + F.when(F.col("id") % 1000 == 0, 3000).otherwise(0)).cast("int")).alias("text"))
    got = source_mixing.mix(df).collect()
    by = sorted(got, key=lambda r: f"s{r['doc_id']}")
    assert np.allclose([r["target"] for r in by], brute_targets([r["size"] for r in by]))
    assert all(r["taken"] <= 3 * r["size"] and abs(r["taken"] - r["target"]) <= source_mixing.BLOCK_WORDS for r in got) and len(got) == n


@given(st.integers(1, 500), st.integers(0, 10**9))
def test_permutation(n, key):
    assert sorted(source_mixing.permuted(np.arange(n), n, key)) == list(range(n))


def test_mixed_documents_hold_the_words_taken(spark):
    texts = [" ".join(f"t{i}_{k}" for k in range(n)) for i, n in enumerate([10, 700, 40, 300, 0, 900])]
    df = spark.createDataFrame(rows(texts, ["a", "b", "a", "c", "a", "b"]), DOC)
    out = source_mixing.mixed_documents(df, payload=("doc_id", "sig")).collect()
    want = {r["doc_id"]: r["taken"] for r in source_mixing.mix(df).collect()}
    got = Counter()
    for r in out:
        assert set(words(r["text"])) <= set(words(texts[r["doc_id"]])) and r["p_sig"] == "x"
        got[r["doc_id"]] += len(words(r["text"]))
    assert got == Counter({k: v for k, v in want.items() if v})
    every = Counter(w for r in out for w in words(r["text"]))
    assert max(every.values()) <= 3


# ---- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    vocab = {k: [a + b for a in p for b in p] for k, p in {"en": ["th", "er", "on", "an"], "de": ["sch", "ü", "ei", "ng"]}.items()}
    texts = [(k, " ".join(rng.choices(vocab[k], k=rng.randrange(30, 200)))) for k in ("en", "de") for _ in range(40)]
    texts += [("en", texts[0][1]), ("en", texts[1][1] + " password=abcdef123456"), ("en", "12 34"), (None, texts[5][1] + " extra word"), ("en", None), ("en", "")]
    data = [(i, x, k, f"s{i % 3}", len(x or ""), "more") for i, (k, x) in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, more string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"file://{tmp_path}")
        out.write.parquet(f"file://{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = spark.read.parquet(f"file://{tmp_path}/{name}")
            after[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(range(86)) - set(after["language_id"]) == {82, 84, 85} and after["language_id"][83]["lang"] == "en"
    _, root = brute([after["language_id"][i]["text"] if i in after["language_id"] else None for i in range(86)])
    assert set(after["ngram_join"]) == {root[i] for i in after["language_id"]} and 80 not in after["ngram_join"]
    assert all("abcdef123456" not in r["text"] and r["n_chars"] == len(r["text"]) for r in after["secret_scan"].values())
    assert set(after["secret_scan"]) == set(after["ngram_join"])
    last = spark.read.parquet(f"file://{tmp_path}/best_fit_packing")
    assert last.count() == corpus_pipeline.run(spark, f"file://{tmp_path}").count() > 0
    empty = docs.filter("false").select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
