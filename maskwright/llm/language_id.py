"""Language identification by a string kernel with Nyström landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts counts the letter n-grams (n = 2, 3, 4, over lower-cased letters with word ends) that both hold,
each once however often it occurs, divided by the root of the product of their numbers: a blended-spectrum presence kernel.
N-grams are hashed to ``DIMS`` places, so a text is a row of bits.

Training: labelled texts of the training folds are thinned to about ``per_language`` distinct ones for every label, and to
fewer where there are so many labels that this would pass ``max_rows`` (a bounded sample; both are parameters), but not to
under ``LEAST_ROWS``; their bits, not their texts, come to the driver. Landmarks are spread over the languages, four for each
where there are many; ridge regression is solved on the Nyström features of the sample, one column per language with targets
+1 and -1.

Scoring: kernel against the landmarks, then their weights, are both matrices, so their product is taken once and a batch of
texts costs one matrix product of its bits with a (DIMS x languages) matrix. Texts are scored whole, inside Arrow batches,
without a shuffle; the matrix (DIMS x languages floats) goes with the tasks.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text when there is nothing to
learn from; ties go to the first language by name; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import fold, map_texts, text_of

DIMS, PER_LANGUAGE, LANDMARKS, MAX_ROWS, LEAST_ROWS, RIDGE = 1 << 15, 400, 256, 25600, 16, 1e-2
UND = "und"

#: A word character that is no digit: nearly always a letter, but fractions and the like are such too.
_LIKELY = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter (str.isalpha)."""
    return any(m[0].isalpha() for m in _LIKELY.finditer(text))


def grams(text: str, dims: int = DIMS) -> np.ndarray:
    """Places of the text's n-grams, repeats included. Everything but letters parts words; a word end is one character of its n-grams."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    top = int(codes.max(initial=0)) + 1
    letters = _is_letter(top)[codes]
    codes = np.where(letters, codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = letters[1:] | letters[:-1]
    codes = codes[keep].astype(np.uint32)
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    h, out = codes, []
    for n in (2, 3, 4):
        if len(h) < 2:
            break
        h = h[:-1] * np.uint32(0x01000193) + codes[n - 1 :] * np.uint32(0x9E3779B1)
        out.append((h * np.uint32(0x85EBCA6B)) >> shift)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


_LETTERS = np.zeros(0, bool)


def _is_letter(top: int) -> np.ndarray:
    """Whether each code point is a letter, up to the next power of two; made once for each range that occurs."""
    global _LETTERS
    if len(_LETTERS) < top:
        n = 1 << max(10, (top - 1).bit_length())
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(n)), bool, n)
    return _LETTERS


def bits(texts: list[str], dims: int = DIMS) -> np.ndarray:
    out = np.zeros((len(texts), dims), np.float32)
    for row, text in zip(out, texts):
        row[grams(text, dims)] = 1
    return out


@dataclass
class Model:
    """Languages, and the matrix of kernel times weights: score of x is bits(x) @ matrix / sqrt(number of its n-grams)."""

    languages: list[str]
    matrix: np.ndarray


def unpacked(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed, axis=1).astype(np.float32)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.outer(np.maximum(a.sum(1), 1), np.maximum(b.sum(1), 1)))
    return a @ b.T / norm


def fit(packed: np.ndarray, lang: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, block: int = 128) -> Model:
    """Kernel ridge regression on Nyström features; landmarks are taken in turn from the languages, in the order given.

    ``packed`` has the texts' bits, eight to a byte; they are unpacked a block of rows at a time, so that memory follows the
    landmarks and not the sample. ``landmarks`` is their least number, four for a language the next bound.
    """
    languages = sorted(set(lang))
    by = {k: [i for i, y in enumerate(lang) if y == k] for k in languages}
    turns = [i for r in range(max(map(len, by.values()), default=0)) for k in languages if r < len(by[k]) for i in (by[k][r],)]
    mark = unpacked(packed[turns[: max(landmarks, 4 * len(languages))]])
    if not len(mark):
        return Model([], np.zeros((DIMS + 1, 0), np.float32))
    values, vectors = np.linalg.eigh(kernel(mark, mark).astype(float))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    of, names = np.array(lang), np.array(languages)
    share = np.array([1 / len(by[k]) for k in lang])
    a, b = ridge * np.eye(root.shape[1] + 1), np.zeros((root.shape[1] + 1, len(languages)))
    for i in range(0, len(packed), block):
        features = kernel(unpacked(packed[i : i + block]), mark) @ root
        phi = np.hstack([features, np.ones((len(features), 1))])
        weighted = phi * share[i : i + block, None]
        a += phi.T @ weighted
        b += weighted.T @ np.where(of[i : i + block, None] == names[None], 1.0, -1.0)
    alpha = np.linalg.solve(a, b)
    mark /= np.sqrt(np.maximum(mark.sum(1, keepdims=True), 1))
    return Model(languages, np.vstack([mark.T @ (root @ alpha[:-1]).astype(np.float32), alpha[-1:]]).astype(np.float32))


def sample(df: DataFrame, train: Column, id_col: str, text_col: str, lang_col: str, per_language: int, max_rows: int) -> tuple[np.ndarray, list[str]]:
    """Packed bits and labels of the training sample, in an order that does not depend on the partitions."""
    labelled = df.filter(train & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return np.zeros((0, DIMS // 8), np.uint8), []
    most = min(per_language, max(LEAST_ROWS, max_rows // len(counts)))
    shares = df.sparkSession.createDataFrame([(r["lang"], min(1.0, most / r["n"])) for r in counts], "lang string, share double")
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = labelled.join(F.broadcast(shares), "lang").filter(draw < F.col("share")).select("lang", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, rows = b.column(0).to_pylist(), b.column(1).to_pylist()
            on = [k for k, t in enumerate(rows) if has_letter(t)]
            packed = [np.packbits(bits([rows[k]])[0].astype(bool)).tobytes() for k in on]
            yield pa.RecordBatch.from_arrays([pa.array([langs[k] for k in on], pa.string()), pa.array(packed, pa.binary())], ["lang", "bits"])

    got = map_texts(picked, pack, "lang string, bits binary").distinct().limit(4 * most * len(counts)).collect()
    rows = sorted(((r["lang"], bytes(r["bits"])) for r in got), key=lambda r: (r[0], zlib.crc32(r[1]), r[1]))
    return np.frombuffer(b"".join(b for _, b in rows), np.uint8).reshape(len(rows), DIMS // 8), [k for k, _ in rows]


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", payload: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """One row per input row: id, ``text`` if asked for, ``p_<name>`` payload, lang_pred, score."""
    read = df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), *(F.col(c).alias(f"p_{c}") for c in payload))
    kept = [c for c in read.columns if keep_text or c != "text"]
    schema = read.select(kept).schema.add("lang_pred", "string").add("score", "double")
    languages, matrix = np.array(model.languages + [UND], object), model.matrix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            pred, value = np.full(len(texts), len(languages) - 1), np.zeros(len(texts))
            on = [k for k, t in enumerate(texts) if has_letter(t)] if len(languages) > 1 else []
            for i in range(0, len(on), 64):
                at = on[i : i + 64]
                x = bits([texts[k] for k in at])
                s = x @ matrix[:-1] / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) + matrix[-1]
                e = np.exp(4 * (s - s.max(1, keepdims=True)))
                pred[at] = s.argmax(1)
                value[at] = (1 / e.sum(1)) * np.clip((s.max(1) + 1.5) / 2, 0, 1)
            out = [pa.array(languages[pred].tolist(), pa.string()), pa.array(value)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *out], [*kept, "lang_pred", "score"])

    return map_texts(read, run, schema)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS) -> Model:
    """A model from the rows with a label whose id is not in fold 0."""
    x, lang = sample(df, fold(F.col(id_col)) != 0, id_col, text_col, lang_col, per_language, max_rows)
    return fit(x, lang)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **kw) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    out = score(df, train(df, id_col, text_col, lang_col, **kw), id_col, text_col)
    return out.select(F.col("id").alias("doc_id"), (fold(F.col("id")) == 0).alias("held_out"), "lang_pred", "score")
