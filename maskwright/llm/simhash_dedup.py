"""SimHash near-duplicates found by Golay-code fuzzy hashing, exact.

A document's fingerprint has 64 bits: a bit is set if more than half of the XXH64 hashes (seed 42) of its word shingles have it.
Documents link where their fingerprints differ in at most two bits.

1. Fingerprints are made once, in bounded memory (long texts by pieces), and documents with the same one are one class, so
   exact copies meet in no list.
2. Keys. A fingerprint is cut into three segments of 22, 21 and 21 bits. Two errors leave one of three segments without an error
   (pigeonhole), and any other segment with two at most. A segment of up to 23 bits is decoded by the perfect Golay code
   (23, 12): the codewords nearest to the segment and to its 23 neighbours give one or six different indices of 12 bits. Two
   segments that differ in at most two bits have a vector between them that is the neighbour of both, so they share an index. The keys are: a segment as it
   is with each index of the following one, three times, 18 keys at most.
3. Lists of at most ``heavy`` fingerprints are verified by their differing bits, inside the row; only links leave it. The fingerprints of longer lists go another
   exact way: each is dealt to itself and its 64 neighbours. What meets at such a place differs in at most two bits from each
   other, and 65 fingerprints can meet there at most; so all are tied to the smallest, without forming pairs.
4. Components join the links.

Nothing is broadcast and nothing but counters comes to the driver. Hot keys are met by equi-joins that can be split at run time.

Defined results: null texts and texts without words have fingerprint zero, which links like any other; ids may be null or repeated (a component's
id is the smallest id in it, nulls left aside); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import map_texts, materialize
from maskwright.llm.components import components, joined

N, SEED, HEAVY = 3, 42, 32
#: Bits of the three segments, and bytes of a text that are cut into words at once.
SEGMENTS, PIECE_BYTES = (22, 21, 21), 1 << 20
# Fixed value: generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a lower-cased text, by pieces that end between words."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end].translate(_LOWER).split()
        at = end


def _counts(found: list[bytes], n: int) -> tuple[np.ndarray, int]:
    """How often each bit is set in the hashes of the words' n-word shingles, and the number of these."""
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = [xxhash.xxh64_intdigest(line[i:j], SEED) for i, j in zip(starts[: len(found) - n + 1].tolist(), ends[n - 1 :].tolist())]
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)]), len(hashes)


def fingerprint(text: bytes, n: int = N) -> int:
    """The 64-bit fingerprint of a text in UTF-8; with fewer than n words their whole sequence is the one shingle."""
    counts, total, held = np.zeros(64, np.int64), 0, []
    for found in _word_lists(text):
        held += found
        if len(held) >= n:
            more, k = _counts(held, n)
            counts, total, held = counts + more, total + k, held[len(held) - n + 1 :]
    if not total and held:
        counts, total = _counts(held, len(held))
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0]) if total else 0


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, n) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def _syndromes(v: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit vectors by the generator polynomial."""
    v = v.copy()
    for k in range(22, 10, -1):
        v ^= np.where(v >> k & 1, GENERATOR << (k - 11), 0)
    return v


def _error_patterns() -> np.ndarray:
    """For each syndrome the one pattern of at most three errors: the code is perfect."""
    one = 1 << np.arange(23)
    three = np.array([a | b | c for i, a in enumerate(one) for j, b in enumerate(one[i:], i) for c in one[j:]])
    out = np.zeros(2048, np.int64)
    out[_syndromes(three)] = three
    return out


def golay_keys(v: np.ndarray) -> np.ndarray:
    """Indices of the codewords nearest to each 23-bit vector and to its 23 neighbours: a row of 24 for each, in order, with repeats."""
    near = v.astype(np.int64)[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])
    return np.sort((near ^ _error_patterns()[_syndromes(near)]) >> 11, axis=1)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of distinct fingerprints (unsigned): the place of the fingerprint, and its key."""
    low, parts = np.uint64(0), []
    for size in SEGMENTS:
        parts.append((fps >> low & np.uint64((1 << size) - 1)).astype(np.int64))
        low += np.uint64(size)
    who, out = [], []
    for k, exact in enumerate(parts):
        index = golay_keys(parts[(k + 1) % 3])
        i, j = np.nonzero(np.diff(index, axis=1, prepend=-1))
        who.append(i)
        out.append((k << 34) + (exact[i] << 12) + index[i, j])
    return np.concatenate(who), np.concatenate(out)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.asarray(b.column(0))
        for i in range(0, len(fps), 1 << 14):
            who, key = keys(fps[i : i + (1 << 14)].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[i : i + (1 << 14)][who])], ["key", "fp"])


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(classes: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Links a, b between the distinct fingerprints (column fp, signed). Of fingerprints in long lists those remain that keep them connected."""
    entries = materialize(classes.select("fp").mapInArrow(_keyed, "key long, fp long"), "entries")
    sizes = entries.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("size")).filter("size > 1")
    listed = materialize(joined(entries, sizes, "key", "k").drop("k"), "lists")
    few = listed.filter(F.col("size") <= heavy).groupBy("key").agg(F.collect_list("fp").alias("xs"))
    found = F.flatten(F.transform("xs", lambda a: F.transform(F.filter("xs", lambda b: (b > a) & (_differ(a, b) <= 2)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    light = few.filter(F.size(found) > 0).select(F.explode(found).alias("p")).select("p.a", "p.b")
    many = listed.filter(F.col("size") > heavy).select("fp").distinct()
    around = F.array("fp", *(F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), k)) for k in range(64)))
    met = many.select("fp", F.explode(around).alias("place")).groupBy("place").agg(F.collect_list("fp").alias("xs")).filter(F.size("xs") > 1)
    star = met.select(F.array_min("xs").alias("a"), F.explode("xs").alias("b")).filter("a <> b")
    return light.unionByName(star).distinct()


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    read = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text"))
    docs = materialize(map_texts(read, _fingerprints(n), "doc_id long, fp long"), "fingerprints")
    classes = docs.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(classes, heavy))
    of_class = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    ids = of_class.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("component_id"))
    named = joined(of_class, ids, "root", "r").select(F.col("fp").alias("f"), "component_id")
    return joined(docs, named, "fp", "f").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
