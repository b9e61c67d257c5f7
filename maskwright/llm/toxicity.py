"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams (3 to 6, with marks for its ends) and of the word itself; its vector is the
mean of their embeddings, so a misspelling that was never seen shares most of its vector with what was. The words of a
window are averaged and a linear softmax tells toxic from not. A text is as toxic as its most toxic window of ``window`` words: a few insults in a long text would drown in an average over all of it.

Training gets labels only from rows of the training folds: about ``max_docs`` texts of each label, of up to ``max_chars``
characters each and whole (both are parameters), come to the driver. Embeddings and softmax are trained together on full
batches of windows: each text's most toxic one under the model so far, which for clean texts is the hardest one. Steps have
momentum and one size for each of the three parameters, set by its largest gradient: n-grams that many texts share move most,
and those of a single text hardly at all. As the softmax is linear, each bucket's embedding folds into one number; scoring a text is a look-up of word
scores and a running mean, done inside Arrow batches over whole texts, without a shuffle.

Defined results: null and empty texts and those of white space hold no insult and have score ``EMPTY_SCORE`` whatever the labels
are (a rate of the sample would be near 0.5 once both labels are thinned); labels that are null or whose
document is absent are not used; a document with several labels is toxic if one says so; without labels every score is 0;
ids may repeat, and training then takes one text of an id, that of the least hash; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import fold, map_texts, text_of, words

BUCKETS, DIM, WINDOW, MAX_DOCS, MAX_CHARS = 1 << 16, 8, 4, 2500, 16000
CACHED = 50_000
EMPTY_SCORE = 0.0
SIZES = (3, 4, 5, 6)
_EDGES = ".,;:!?*#$%&|()[]\"'"


def subwords(vocab: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams and the words' own, with the word (its place in vocab) of each; lower case, no punctuation at the ends."""
    marked = [f"<{w.lower().strip(_EDGES)}>" for w in vocab]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32)
    word = np.repeat(np.arange(len(marked)), sizes)
    starts = np.cumsum(sizes) - sizes
    at = np.arange(len(codes)) - starts[word]
    mix = lambda h, n: ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(8)
    h = codes.copy()
    found, owner = [], []
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint32(0x01000193) + codes[n - 1 :] if len(h) > 1 else h[:0]
        if n in SIZES:
            on = at[: len(h)] + n < sizes[word[: len(h)]]
            found.append(mix(h[on], n))
            owner.append(word[: len(h)][on])
    power = np.cumprod(np.full(int(sizes.max(initial=1)), 0x01000193, np.uint32), dtype=np.uint32)
    found.append(mix(np.add.reduceat(codes * power[at], starts) if len(marked) else codes, 0))
    owner.append(np.arange(len(marked)))
    return np.concatenate(found).astype(np.int64) % buckets, np.concatenate(owner)


def turns_of(text: str) -> list[str]:
    """The words without those that repeat the one before: a window should see different words."""
    found = words(text)
    return [w for w, before in zip(found, [None, *found]) if w != before]


def word_means(values: np.ndarray, subs: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    return np.bincount(subs[1], values[subs[0]], n) / np.maximum(np.bincount(subs[1], minlength=n), 1)


@dataclass
class Model:
    """Log odds of each bucket and those of an empty window."""

    buckets: np.ndarray
    bias: float
    window: int = WINDOW

    def scores(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        """Scores of texts; ``known`` holds the word scores met so far."""
        out = np.full(len(texts), EMPTY_SCORE)
        for i in range(0, len(texts), 256):
            found = [turns_of(t) for t in texts[i : i + 256]]
            if len(known) > CACHED:  # a slice of texts adds at most its own words
                known.clear()
            new = list({w for d in found for w in d if w not in known})
            if new:
                known.update(zip(new, word_means(self.buckets, subwords(new, len(self.buckets)), len(new)).tolist()))
            for k, d in enumerate(found, i):
                if d:
                    odds = best_window(np.fromiter(map(known.__getitem__, d), float, len(d)), self.window)[1] + self.bias
                    out[k] = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return out


def best_window(s: np.ndarray, window: int) -> tuple[int, float]:
    """Start and mean of the window of highest mean; a shorter text is one window, whose missing words count as 0."""
    if len(s) <= window:
        return 0, float(s.sum()) / window
    sums = np.concatenate([[0.0], np.cumsum(s)])
    means = (sums[window:] - sums[:-window]) / window
    k = int(means.argmax())
    return k, float(means[k])


class _Bags:
    """Sparse averaging: each row is the mean of its items; forward and backward by sums over sorted segments."""

    def __init__(self, items: np.ndarray, rows: np.ndarray, n_rows: int, n_items: int):
        by_row = np.argsort(rows, kind="stable")
        self.items, sizes = items[by_row], np.bincount(rows, minlength=n_rows)
        self.starts = np.cumsum(sizes) - sizes
        self.inv = (1 / sizes)[:, None].astype(np.float32)
        by_item = np.argsort(items, kind="stable")
        self.row_of, ids = rows[by_item], items[by_item]
        self.first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        self.present, self.n_items = ids[self.first], n_items

    def forward(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[self.items], self.starts, axis=0) * self.inv

    def backward(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n_items, g.shape[1]), np.float32)
        out[self.present] = np.add.reduceat((g * self.inv)[self.row_of], self.first, axis=0)
        return out


def fit(texts: list[str], labels: list[int], buckets: int = BUCKETS, dim: int = DIM, window: int = WINDOW, turns: int = 14, steps: int = 10, rate: float = 0.3, seed: int = 3) -> Model:
    """Embeddings (buckets x dim) and softmax weights (dim x 2) by momentum on the logistic loss, both classes weighing the same.

    Each turn picks windows: of every text the one that is most toxic so far, and of clean texts one at random besides. The
    first picks go by the smoothed log odds of the texts that hold a bucket.
    """
    y = np.array(labels, np.float32)
    docs = [turns_of(t) for t in texts]
    on = [k for k, d in enumerate(docs) if d]
    docs, y = [docs[k] for k in on], y[on]
    base = float(y.mean()) if len(y) else 0.0
    if not 0 < base < 1:
        return Model(np.zeros(buckets, np.float32), -30.0 if base == 0 else 30.0, window)
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in d]) for d in docs]
    subs = subwords(list(vocab), buckets)
    by_word = np.argsort(subs[1], kind="stable")
    flat, ends = subs[0][by_word], np.cumsum(np.bincount(subs[1], minlength=len(vocab)))
    of_word = lambda k: flat[(ends[k - 1] if k else 0) : ends[k]]
    held = np.zeros((2, buckets))
    for d, label in zip(ids, y):
        held[int(label)][np.unique(np.concatenate([of_word(k) for k in np.unique(d)]))] += 1
    odds = np.log((held[1] + 0.5) / (y.sum() + 1)) - np.log((held[0] + 0.5) / (len(y) - y.sum() + 1))
    rng = np.random.default_rng(seed)
    emb = np.zeros((buckets, dim), np.float32)  # what training never meets stays neutral
    w = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    moments = [[np.zeros_like(p), 0.0] for p in (emb, w, bias)]
    step = 0
    for _ in range(turns):
        scores = word_means(odds, subs, len(vocab))
        best = [best_window(scores[d], window)[0] for d in ids]
        picked = [d[k : k + window] for d, k in zip(ids, best)] + [d[(k := int(rng.integers(len(d)))) : k + window] for d, label in zip(ids, y) if not label]
        label = np.concatenate([y, np.zeros(len(picked) - len(y), np.float32)])
        target = np.stack([1 - label, label], 1)
        weight = np.where(label > 0, 0.5 / label.mean(), 0.5 / (1 - label.mean())).astype(np.float32)[:, None] / len(label)
        used = np.unique(np.concatenate(picked))
        rows = [of_word(k) for k in used]
        sub = _Bags(np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows), buckets)
        doc = _Bags(np.searchsorted(used, np.concatenate(picked)), np.repeat(np.arange(len(picked)), [len(p) for p in picked]), len(picked), len(used))
        for _ in range(steps):
            step += 1
            vec = doc.forward(sub.forward(emb))
            logits = vec @ w + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - target) * weight
            grads = (sub.backward(doc.backward(g @ w.T)), vec.T @ g, g.sum(0))
            for param, grad, m in zip((emb, w, bias), grads, moments):
                m[0] += 0.1 * (grad - m[0])
                m[1] += 0.01 * (float((grad * grad).max()) - m[1])
                param -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
        odds = emb @ (w[:, 1] - w[:, 0])
    return Model(odds.astype(np.float32), float(bias[1] - bias[0]), window)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_docs: int, max_chars: int) -> list[tuple[str, int]]:
    """Training texts with labels: about max_docs of each label, drawn by a hash of the id, the same for every layout of the tables."""
    own = labels.filter((fold(F.col(id_col)) != 0) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect() if r["y"] in (0, 1)}
    if not counts:
        return []
    share = F.create_map(*(x for y, n in counts.items() for x in (F.lit(y), F.lit(min(1.0, max_docs / n)))))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    picked = own.filter(draw < share[F.col("y")])
    read = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).filter(F.length("text") <= max_chars)
    most = picked.withColumn("draw", draw).orderBy("draw", "id").limit(4 * max_docs)  # about half of these, so that the limit is no more than a bound
    rows = read.join(F.broadcast(most), "id").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y")).collect()
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: r["id"])]


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in batches:
            s = model.scores(b.column(2).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    read = df.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col)) == 0).alias("held_out"), text_of(text_col).alias("text"))
    return map_texts(read, run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, **kw) -> DataFrame:
    """All documents scored by a model that is trained on the labelled ones of the training folds."""
    rows = sample(docs, labels, id_col, text_col, label_col, max_docs, max_chars)
    return score(docs, fit([t for t, _ in rows], [y for _, y in rows], **kw), id_col, text_col)
