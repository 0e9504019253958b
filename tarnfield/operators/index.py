"""The inverted index as DataFrames: tokens, postings of chosen terms, field statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKENIZERS

WEIGHT = (1, 75)  #: bounds of a text posting's weight


def analyzed(docs: DataFrame, key: str, fields: list[str], tokenizer: str = "standard") -> DataFrame:
    """key, field, tokens: one row per document and field that has a token."""
    names = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), TOKENIZERS[tokenizer](F.col(f)).alias("tokens")) for f in fields))).alias("x")
    return docs.select(F.col(key).alias("doc_id"), names).select("doc_id", "x.field", "x.tokens").where(F.size("tokens") > 0)


def stats(tokens: DataFrame) -> DataFrame:
    """field, doc_count, total_len."""
    return tokens.groupBy("field").agg(F.count("*").alias("doc_count"), F.sum(F.size("tokens")).cast("bigint").alias("total_len"))


def postings(tokens: DataFrame, wanted: list[str] | Column | None = None) -> DataFrame:
    """doc_id, field, term, tf, positions, len; only of terms asked for, cut out before anything is shuffled.

    Grouping is within the row, so it needs no exchange: the terms of a document are in its array.
    """
    terms = F.array_distinct("tokens") if wanted is None else F.array_intersect(F.col("tokens"), F.array(*map(F.lit, wanted)) if isinstance(wanted, list) else wanted)
    df = tokens.select("doc_id", "field", "tokens", F.size("tokens").alias("len"), F.explode(terms).alias("term"))
    at = F.filter(F.transform("tokens", lambda x, i: F.when(x == F.col("term"), i)), lambda x: x.isNotNull())
    return df.withColumn("positions", at).select("doc_id", "field", "term", F.size("positions").alias("tf"), "positions", "len")


def terms(tokens: DataFrame) -> DataFrame:
    """field, term, df, occurrences: the dictionary."""
    return tokens.select("doc_id", "field", F.explode("tokens").alias("term")).groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf")).groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def weight(tf: Column, bounds: tuple[int, int] = WEIGHT) -> Column:
    return F.least(F.lit(bounds[1]), bounds[0] + tf - 1)


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def scored(posts: DataFrame, field_stats: DataFrame, bounds: tuple[int, int] = WEIGHT) -> DataFrame:
    """posts with df, idf and the BM25 score of each posting; field_stats has a row per field."""
    df = posts.groupBy("field", "term").agg(F.count("*").alias("df"))
    with_df = posts.join(df, ["field", "term"]).join(F.broadcast(field_stats), "field")  # one row a declared field
    tf, avg = F.col("tf"), F.col("total_len") / F.col("doc_count")
    gain = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("len") / avg))
    return with_df.withColumn("idf", idf(F.col("doc_count"), F.col("df"))).withColumn("score", weight(tf, bounds) * F.col("idf") * gain)
