"""Lexical ranking and fusion of rankings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import cut

K1, B = 1.2, 0.75
RRF_K = 60


def bm25_scores(documents: DataFrame, query: str, group: str | None = None) -> DataFrame:
    """id, score (and the group column): BM25 of each document (id, text, group) for the query, where it is above 0.

    Words of the query count as often as they occur. idf = ln(1 + (N - df + .5) / (df + .5)); N, df and the mean length are
    taken over all documents, or per group if one is named. Null texts are empty. Only the query's words leave the scan:
    each document sends its counts of those words and its length, and statistics are one row (per group).
    """
    terms = re.findall(r"[a-z0-9_:-]+", query.lower())
    keys = [group] if group else []
    toks = tokens(F.coalesce(F.col("text"), F.lit("")))
    counted = documents.select(*keys, "id", F.explode(F.array(toks)).alias("toks"))
    unique = list(dict.fromkeys(terms)) or [""]
    times = lambda w: F.size(F.filter("toks", lambda t: t == F.lit(w)))
    hits = [times(w).alias(f"tf{i}") for i, w in enumerate(unique)]
    counted = counted.select(*keys, "id", F.size("toks").alias("len"), *hits)
    stats = counted.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(unique))])
    if keys:
        joined = counted.join(stats, keys)
    else:  # one row of numbers, which go into the plan
        row = stats.first()
        joined = counted.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in stats.schema})
    score = F.lit(0.0)
    for w in terms:
        i = unique.index(w)
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.greatest(F.col("mean"), F.lit(1.0))))).otherwise(0.0)
    return joined.select(*keys, "id", F.round(score, 6).alias("score")).where("score > 0")


def bm25_topk(documents: DataFrame, query: str, k: int = 20) -> DataFrame:
    """id, score of the k best documents; ties go to the smaller id."""
    return bm25_scores(documents, query).orderBy(F.col("score").desc(), "id").limit(k)


def reciprocal_rank_fusion(rankings: list[DataFrame], keys: list[str] | None = None, k: int = RRF_K) -> DataFrame:
    """*keys, id, score: the sum of 1 / (k + rank) over rankings of (*keys, id, rank from 1)."""
    keys = keys or []
    rows = rankings[0].select(*keys, "id", "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select(*keys, "id", "rank"))
    return rows.groupBy(*keys, "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))


def ranked(scores: DataFrame, keys: list[str], *order) -> DataFrame:
    """scores with rank from 1 within its keys."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def ranked_all(scores: DataFrame, *order) -> DataFrame:
    """scores with rank from 1 over all rows, without bringing them into one task: rows are sorted by ranges, counted per
    range, and numbered within their range from where the one before ends."""
    placed = cut(scores.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per range
    within = F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33)
    return placed.join(F.broadcast(before), "__part").withColumn("rank", (F.col("__before") + within + 1).cast("int")).drop("__part", "__at", "__n", "__before")
