"""A corpus pipeline of five stages. Each takes and returns documents (the last returns packed pieces); run() writes every
stage's result in the shared folder, so a lost executor costs a stage's own tasks only.

1. ``language_id``: documents in no language (``und``: no letter) go; a missing ``lang`` is filled in. The score decides
   nothing, as that of a short text falls with the number of languages.
2. ``ngram_join``: of each group of near copies (4-word shingles, Jaccard 0.85) one document stays.
3. ``secret_scan``: secrets are masked in place; no document goes.
4. ``source_mixing``: sources are brought to their target weights by blocks of words. A document's row holds the words that
   the mix takes; words taken twice or three times come again in a second and third row of the same doc_id.
5. ``best_fit_packing``: what is left is cut into token sequences.

Documents may have more columns than these; they are carried along to the fourth stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import best_fit_packing, language_id, ngram_join, secret_scan, source_mixing
from maskwright.llm.common import materialize, table


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in ("text", "n_chars"))


def _documents(out: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of docs in their order: from ``changed``, or from the carried ``p_<name>``."""
    return out.select(*((changed[c] if c in changed else F.col(f"p_{c}")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = language_id.score(docs, language_id.train(docs), payload=_others(docs), keep_text=True)
    kept = out.filter(F.col("lang_pred") != language_id.UND)
    return _documents(kept, docs, text=F.col("text"), n_chars=F.length("text"), lang=F.coalesce("p_lang", "lang_pred"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.dedupe(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(secret_scan.mask(docs, payload=_others(docs)), docs, text=F.col("masked"), n_chars=F.length("masked"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(source_mixing.mixed_documents(docs, payload=_others(docs)), docs, text=F.col("text"), n_chars=F.length("text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]
#: Trained models, pseudorandom draws and a tokenizer are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
