import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.llm import conversation_trie, ranked_search, simhash_dedup
from maskwright.llm.common import words

DOC = "doc_id long, text string, rank int, item long, fp long, component_id long, root string"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([((ids or range(len(texts)))[i], t, 1, 2, 3, 4, "x") for i, t in enumerate(texts)], DOC)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- SimHash -------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = words(lowered(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values, links):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(len(values))]


TEXTS = [None, "", " \t\n", "one", "One two", "one two three", "a  b\vc d e", "É é ONE two three four", "x" * 5000, "w " * 40]


@given(st.one_of(st.sampled_from(TEXTS), st.lists(st.sampled_from(["a", "B", "ç d", "long-word", "x\x00y", "퟿"]), max_size=60).map(" ".join)))
@settings(max_examples=60, deadline=None)
def test_fingerprints_are_those_of_all_shingles(text):
    assert simhash_dedup.fingerprint((text or "").encode()) == brute_fingerprint(text)


def test_fingerprint_of_a_text_in_pieces(monkeypatch):
    text = " ".join(random.Random(3).choices([f"W{k}" for k in range(50)], k=700))
    whole = simhash_dedup.fingerprint(text.encode())
    monkeypatch.setattr(simhash_dedup, "PIECE_BYTES", 7)
    assert simhash_dedup.fingerprint(text.encode()) == whole == brute_fingerprint(text)
    assert simhash_dedup.fingerprint(b"lonely                    words") == brute_fingerprint("lonely words")


def test_the_code_is_perfect():
    patterns = simhash_dedup._error_patterns()
    assert len(set(patterns.tolist())) == 2048 and max(bin(p).count("1") for p in patterns.tolist()) == 3


@given(st.integers(0, 2**23 - 1), st.integers(0, 22), st.integers(0, 22))
@settings(max_examples=300, deadline=None)
def test_vectors_two_errors_apart_share_an_index(v, i, j):
    a, b = (set(simhash_dedup.golay_keys(np.array([x]))[0].tolist()) for x in (v, v ^ (1 << i) ^ (1 << j)))
    assert a & b and len(a) in (1, 6)


def near_fingerprints(seed, n=250):
    rng, out = random.Random(seed), []
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 60])):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("heavy", [0, 4, 32])
def test_links_keep_what_is_connected(spark, heavy):
    fps = near_fingerprints(heavy)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    got = {(r["a"], r["b"]) for r in simhash_dedup.links(spark.createDataFrame([(f,) for f in signed], "fp long"), heavy).collect()}
    near = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    place = {f: i for i, f in enumerate(signed)}
    found = [(place[a], place[b]) for a, b in got]
    assert {tuple(sorted(x)) for x in found} <= {tuple(sorted(x)) for x in near}
    assert brute_roots(fps, found) == brute_roots(fps, near)


def test_simhash_components(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choices([f"w{k}" for k in range(300)], k=400)) for _ in range(5)]
    texts = TEXTS + base + [b + " more" for b in base] + [b.upper() for b in base] * 3
    ids = [*range(100, 100 + len(texts) - 2), None, 100]
    got = simhash_dedup.digest(docs_of(spark, texts, ids)).collect()
    fps = [brute_fingerprint(t) for t in texts]
    roots = brute_roots(fps, [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    least = {r: min((ids[i] for i in range(len(ids)) if roots[i] == r and ids[i] is not None), default=None) for r in set(roots)}
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(((ids[i], f"{fps[i]:016x}", least[roots[i]]) for i in range(len(ids))), key=key)
    assert simhash_dedup.digest(docs_of(spark, [])).collect() == []


# ---- conversation trie ---------------------------------------------------------------------------------------------

TURN = "conv_id long, turn long, role string, text string, node long, depth int, key string"


def turns_of(spark, turns):
    return spark.createDataFrame([(*t, 1, 2, "x") for t in turns], TURN)


def brute_trie(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, text))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    below = {}
    for n in sorted(members, key=len, reverse=True):
        saved = (len(members[n]) - 1) * len(words(n[-1][1])) if n else 0
        under = [below[k] for k in kids[n]]
        below[n] = (sum(u[0] for u in under) or 1, saved + sum(u[1] for u in under), 1 + sum(u[2] for u in under))
    ends = {n: ",".join(str(c) for c in m if len(built[c]) == len(n)) for n, m in members.items()}
    rows = [(m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(kids[n]), *below[n][:2], hashlib.sha256(ends[n].encode()).hexdigest(), below[n][2]) for n, m in members.items()]
    return Counter(rows)


def check_trie(spark, turns, **kw):
    got = conversation_trie.trie(turns_of(spark, turns), **kw)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "n_nodes"]
    assert Counter(map(tuple, got.collect())) == brute_trie(turns)


def talks(seed, n):
    rng, out = random.Random(seed), []
    for c in rng.sample(range(-40, 200), n):
        for k in range(rng.choice([1, 2, 4, 7])):
            out.append((c, rng.choice([k, k, k, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["hello there", "a b c", "", None, f"t{k} {c % 3}"])))
    return out


def test_trie_is_the_brute_one(spark):
    check_trie(spark, talks(1, 60) + [(None, 1, "user", "lost"), (7, 0, "user", "x"), (7, 0, "user", "x")])


def test_trie_of_no_rows_and_without_turns(spark):
    check_trie(spark, [])
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 2)
    check_trie(spark, [(lone, 0, "user", "goes with the missing base")])


def test_trie_with_rulers_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "STRETCH", 16)
    monkeypatch.setattr(conversation_trie, "BUCKET", 3)
    monkeypatch.setattr(conversation_trie, "IDS", 4)
    long = [(40, k, "user", f"turn {k % 5}") for k in range(150)]
    same = [(c, k, "user", "hi") for c in range(60, 90) for k in range(2)]
    check_trie(spark, talks(2, 80) + long + same, bound=40)


def test_list_ranks_by_rulers_equal_those_of_one_task(spark):
    order = random.Random(4).sample(range(1000), 1000)
    arcs = spark.createDataFrame([(a, b, 1, a % 3, a) for a, b in zip(order, [*order[1:], None])], "arc long, next long, arcs long, leaves long, saved long")
    one = sorted(map(tuple, conversation_trie.list_rank(arcs, 2000).collect()))
    many = sorted(map(tuple, conversation_trie.list_rank(arcs, 20, 8).collect()))
    assert one == many and dict((a, n) for a, n, _, _ in one) == {a: 1000 - i for i, a in enumerate(order)}


# ---- ranked search -------------------------------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))


def brute_search(texts, ids, items, k):
    own = [Counter(terms(t)) for t in texts]
    n = [sum(c.values()) for c in own]
    n_docs, n_all, df = sum(x > 0 for x in n), sum(n), Counter(t for c in own for t in c)
    out = []
    for item, text in items:
        ask, found = set(terms(text)), []
        for i, c in enumerate(own):
            m = 10 + 90 * n[i] * n_docs // max(1, n_all)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ask if t in c)
            if s > 0:
                found.append((-s, ids[i] is None, ids[i] or 0, ids[i]))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def letters(seed, n, sizes):
    rng = random.Random(seed)
    vocab = [f"w{int(200 * rng.random() ** 3)}" for _ in range(4000)]
    return [" ".join(rng.choices(vocab, k=rng.choice(sizes))) for _ in range(n)]


ITEM = "item_id long, text string, doc_id long, score long, rank int"


@pytest.mark.parametrize(("shard", "least_block", "chunk_bytes"), [(4096, 64, 1 << 20), (50, 2, 1 << 20), (7, 1, 300), (300, 3, 900)])
def test_search_is_the_brute_one(spark, shard, least_block, chunk_bytes):
    texts = letters(1, 280, [1, 5, 40, 200]) + [None, "", "... !?", "W1-w2_w3", "Ünïcode wörter W1", "w1 " * 900]
    texts += texts[:5] * 3 + ["w1\x00w2 w3"]
    ids = [*range(len(texts) - 3), None, None, 4]
    asked = [(i, t) for i, t in enumerate(letters(2, 12, [1, 4, 30]))] + [(3, texts[0]), (3, texts[0]), (None, "w5 w6"), (90, None), (91, "unheard"), (92, "wörter!")]
    items = spark.createDataFrame([(*a, 5, 6, 7) for a in asked], ITEM)
    got = ranked_search.search(docs_of(spark, texts, ids).repartition(3), items, shard=shard, least_block=least_block, chunk_bytes=chunk_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_search(texts, ids, asked, 10)


def test_search_over_no_rows(spark):
    none = spark.createDataFrame([], ITEM)
    assert ranked_search.search(docs_of(spark, ["a b"]), none).collect() == []
    assert ranked_search.search(docs_of(spark, []), spark.createDataFrame([(1, "a", 1, 1, 1)], ITEM)).collect() == []


def test_blocks_hold_their_lists_and_bound_their_members(spark):
    texts = letters(5, 150, [5, 40])
    asked = letters(6, 8, [4, 12])
    vocabulary, own = {}, []
    for t in asked:
        own.append(np.array(sorted({vocabulary.setdefault(x.encode(), len(vocabulary)) for x in terms(t)}), np.int64))
    items = ranked_search.Items(list(range(8)), own, len(vocabulary), np.arange(1, len(vocabulary) + 1))
    batch = next(iter(docs_of(spark, texts).select("doc_id", F.col("text").cast("binary").alias("text")).toArrow().to_batches()))
    posted = list(ranked_search._postings(vocabulary)([batch]))
    on = [b.filter(np.array([len(t) > 0 for t in b.column(2)])) for b in posted]
    shard = ranked_search._Shard(next(ranked_search._index(items, 150, 3000, 4096, 4)(iter(on))), 0, items)
    assert sum(j - i > 1 for i, j in shard.blocks.values()) > 5
    for t, (i, j) in shard.blocks.items():
        members = np.concatenate([shard.members_of([b]) for b in range(i, j)])
        holds = [d for d in range(len(shard.ids)) if t in shard.terms[shard.ptr[d] : shard.ptr[d + 1]]]
        assert sorted(members.tolist()) == holds
        for item in own:
            if t in item:
                for b, bound in zip(range(i, j), shard.bounds(t, item)):
                    assert bound >= shard.scores(shard.members_of([b]), item).max()
