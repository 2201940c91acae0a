"""Ranking of texts: tokens, BM25, rank fusion, dense search, and parsing of numbers out of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

#: Constants of BM25: saturation of the term frequency and weight of the length.
K1, B = 1.5, 0.75


def tokens(text: Column | str) -> Column:
    """Runs of letters, digits and underscores (ASCII) of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0))


def bm25(documents: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """query, doc, score of every document that shares a term with the query. Terms are counted over all documents, each of which is cut into terms once."""
    terms = documents.select(F.col(doc_id).alias("doc"), tokens(text).alias("_t"))
    counts = stage(terms.select("doc", F.size("_t").alias("_len"), F.explode("_t").alias("term")).groupBy("doc", "_len", "term").agg(F.count(F.lit(1)).alias("_tf")))
    n = documents.agg(F.count(F.lit(1)).alias("_n"), F.count(text).alias("_texts")).crossJoin(counts.agg(F.sum("_tf").alias("_all"))).select("_n", F.try_divide("_all", "_texts").alias("_avg"))  # one row each
    asked = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(tokens(query))).alias("term"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    hits = counts.join(asked.join(df, "term"), "term").crossJoin(F.broadcast(n))  # n is one row
    idf = F.ln(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weight = F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    return hits.groupBy("query", "doc").agg(F.sum(idf * weight).alias("score"))


def top_k(scored: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse_ranks(rankings: DataFrame, by: str, item: str, rank: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: sum of 1 / (k + rank) over the lists that hold the item."""
    return rankings.groupBy(by, item).agg(F.sum(1.0 / (k + F.col(rank))).alias("score"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def to_number(x: str, default: float = 0.0) -> Column:
    """The number in a text; the default where it is malformed or missing."""
    return F.coalesce(F.expr(f"try_cast(trim({x}) AS DOUBLE)"), F.lit(default))


def human(x: Column) -> Column:
    """1.50B, 2.30M, 4.10K, else two decimals."""
    a = F.abs(x)
    part = lambda d, u: F.concat(F.format_string("%.2f", x / d), F.lit(u))
    return F.when(a >= 1e9, part(1e9, "B")).when(a >= 1e6, part(1e6, "M")).when(a >= 1e3, part(1e3, "K")).otherwise(F.format_string("%.2f", x))
