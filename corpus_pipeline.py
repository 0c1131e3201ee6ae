"""From raw documents to packed training windows in four stages, each written as Parquet and read by the next.

Every stage works on all that its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import langid, packing, simhash, suffixes
from tidewell.llm.common import delete, prepare, unused, written

WORD_BPE = "word_bpe_49k.json"
#: Encoded pieces that a worker remembers: fewer than where packing runs alone, for the worker also serves the other stages.
MEMO = 100_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are in none of the labelled languages; without labels, those without a letter alone.

    A document goes if it has no letter, if every one-versus-rest output says no (a score below one half), or if it is less
    near to the landmarks of every language than a bar that held-out labelled texts give: no language fits.
    """
    prepare(spark)
    texts, langs = langid.sample_rows(docs.select("doc_id", "text", "lang"))
    model = langid.fit_rows(texts, langs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    names = pred, score, near = unused(docs.columns, "lang_pred", "score", "near")
    scored = langid.predict(docs, model, names)
    fits = (F.col(pred) != langid.UNKNOWN) & (F.col(score) >= 0.5) & (F.col(near) >= langid.least_near(texts, langs))
    return scored.where(fits).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: sets of five-word shingles of Jaccard similarity 0.8 or more."""
    prepare(spark)
    return simhash.keep_first(docs, size=5, similarity=0.8).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of the texts, except where they occur first."""
    prepare(spark)
    return suffixes.remove_repeats(docs, later=True).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of what is left into windows."""
    prepare(spark)
    return packing.pack_balanced(docs, public_tokenizers.path(WORD_BPE), with_ids=True, memo=MEMO)


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("packing", pack)]

#: None: SQL cannot express these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, at = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            delete(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
