"""Retrieval over texts: chunks, terms, BM25 as postings, fusion with dense scores, stored indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.sources import sinks

#: Fixed value: the pattern of a term.
TERM = "[a-z][a-z0-9_-]{1,40}"


def tokens(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def word_chunks(docs: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """``key, start, words``: windows of ``size`` words, each ``overlap`` words into the one before."""
    w = docs.select(key, F.filter(F.split(text, r"\s+"), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    at = w.select(key, "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(size - overlap))).alias("start"))
    return at.select(key, F.col("start").cast("long").alias("start"), F.slice("w", F.col("start") + 1, size).alias("words"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``query_key, key, score`` of every document that has a term of the query; a query's repeated terms add up.

    Postings are cut to the queries' terms before they are counted over documents, so that only these are shuffled.
    """
    terms = docs.select(key, tokens(text).alias("t"))
    n, mean = F.count("*").alias("n"), F.avg(F.size("t")).alias("a")
    stats = terms.agg(n, mean)  # one row
    asked = queries.select(query_key, F.explode(tokens(query_text)).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qf"))
    posted = terms.select(key, F.size("t").alias("len"), F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = posted.groupBy("term", key).agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("a")))
    return tf.join(df, "term").join(asked, "term").crossJoin(F.broadcast(stats)).groupBy(query_key, key).agg(F.sum(part).alias("score"))


def fused(scores: DataFrame, query: list[str], dense: str, lexical: str, key: str, k: int, weights: tuple[float, float] = (0.55, 0.45)) -> DataFrame:
    """The ``k`` best of each query by a weighted sum of both scores, each brought to 0..1 within the query; ties by ``key``.

    A score that is the same for all is 0. Least and greatest are aggregated first, a row for each query.
    """
    ends = scores.groupBy(*query).agg(*[f(c).cast("double").alias(f"_{n}_{c}") for c in (dense, lexical) for n, f in (("lo", F.min), ("hi", F.max))])
    part = lambda c: F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (F.col(c).cast("double") - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(0.0)
    rows = scores.join(F.broadcast(ends), query).withColumn("_s", weights[0] * part(dense) + weights[1] * part(lexical))
    best = Window.partitionBy(*query).orderBy(F.desc("_s"), key)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(*query, F.col("rank").cast("long").alias("rank"), key)


def write_index(chunks: DataFrame, at: str) -> None:
    """Chunks as a table, and beside it how many rows it has and their digest."""
    chunks.write.mode("overwrite").parquet(f"{at}/chunks")
    made = sinks.logical_hash(chunks.sparkSession.read.parquet(f"{at}/chunks")).first()
    sinks.write_document(chunks.sparkSession, f"{at}/manifest.json", {"rows": made["rows"], "sha256": made["logical_sha256"]})


def read_index(spark: SparkSession, at: str) -> DataFrame:
    told = spark.read.option("multiLine", True).schema("rows long, sha256 string").json(f"{at}/manifest.json").first()
    chunks = spark.read.parquet(f"{at}/chunks")
    if tuple(sinks.logical_hash(chunks).first()) != (told["rows"], told["sha256"]):
        raise ValueError("the index differs from its manifest")
    return chunks
