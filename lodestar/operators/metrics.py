"""Ranking metrics of whole runs.

A run has (query_id, id, rank), qrels (query_id, id, grade), cases (query_id): all queries count, those without results too. A grade above 0 is
relevant. Results that repeat an id count each time. ``keys`` are further columns of a run (a technique, a weight), scored apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.numbers import round_half_up

MODES = ("graded", "binary", "linear", "cranfield-reversed")
METRICS = ("precision_at_k", "recall_at_k", "average_precision", "reciprocal_rank", "ndcg_at_k")


def gain(grade: Column, mode: str = "graded") -> Column:
    if mode not in MODES:
        raise ValueError(f"relevance mode must be one of {', '.join(MODES)}")
    value = grade.cast("double")
    by = {"binary": F.lit(1.0), "linear": value, "cranfield-reversed": F.pow(F.lit(2.0), 5 - value) - 1, "graded": F.pow(F.lit(2.0), value) - 1}[mode]
    return F.when(value > 0, by).otherwise(F.lit(0.0))


def per_query(cases: DataFrame, run: DataFrame, qrels: DataFrame, *, k: int = 10, mode: str = "graded", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, query_id, five metrics rounded to 4 digits, relevant_count, hits, first_rank, returned)."""
    by = ["query_id", *keys]
    judged = qrels.where(F.col("grade") > 0).select("query_id", "id", "grade")
    own_gain = gain(F.col("grade"), mode)
    # ideal order: by gain, then id; gains that aren't positive add nothing but keep their place
    order = Window.partitionBy("query_id").orderBy(own_gain.desc(), F.col("id"))
    ideal = judged.withColumn("place", F.row_number().over(order)).withColumn("gain", own_gain)
    ideal = ideal.groupBy("query_id").agg(
        F.count("*").alias("relevant_count"),
        F.sum(F.when((F.col("place") <= k) & (F.col("gain") > 0), F.col("gain") / F.log2(F.col("place") + 1))).alias("ideal"),
    )
    top = run.where(F.col("rank") <= k).select(*by, "id", "rank").join(judged, ["query_id", "id"], "left")
    hit = F.col("grade").isNotNull().cast("int")
    so_far = F.sum(hit).over(Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    top = top.withColumn("hit", hit).withColumn("so_far", so_far).withColumn("gain", F.coalesce(own_gain, F.lit(0.0)))
    summed = top.groupBy(*by).agg(
        F.count("*").alias("returned"),
        F.sum("hit").alias("hits"),
        F.sum(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank"))).alias("precisions"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_rank"),
        F.sum(F.when(F.col("gain") > 0, F.col("gain") / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    every = cases.select("query_id").distinct()
    if keys:
        every = every.join(F.broadcast(run.select(*keys).distinct()), how="cross")  # a row per technique and weight, not per result
    whole = every.join(summed, by, "left").join(ideal, "query_id", "left")
    share = lambda a, b: round_half_up(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)))
    return whole.select(
        *keys, "query_id",
        share("hits", "returned").alias("precision_at_k"),
        share("hits", "relevant_count").alias("recall_at_k"),
        share("precisions", "relevant_count").alias("average_precision"),
        round_half_up(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))).alias("reciprocal_rank"),
        share("dcg", "ideal").alias("ndcg_at_k"),
        F.coalesce("relevant_count", F.lit(0)).cast("long").alias("relevant_count"),
        F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
        F.col("first_rank").cast("long").alias("first_rank"),
        F.coalesce("returned", F.lit(0)).cast("long").alias("returned"),
    )


def aggregate(scored: DataFrame, *keys: str) -> DataFrame:
    """Means of rounded metrics, rounded again: (keys, query_count, precision_at_k, recall_at_k, map, mrr, ndcg_at_k)."""
    names = {"average_precision": "map", "reciprocal_rank": "mrr"}
    # rounded metrics are whole ten-thousandths, and sums of those don't depend on the order
    mean = lambda m: F.floor(F.coalesce(F.sum(F.round(F.col(m) * 10000).cast("long")) / F.count("*"), F.lit(0.0)) + 0.5) / F.lit(10000.0)
    return scored.groupBy(*keys).agg(F.count("*").alias("query_count"), *[mean(m).alias(names.get(m, m)) for m in METRICS])


def reference_comparison(measured: Column, published: Column, k: int = 10) -> Column:
    """(delta, relative_delta) to a published nDCG@10; null for another k or without one."""
    delta = round_half_up(measured - published)
    return F.when(F.lit(k == 10) & published.isNotNull(), F.struct(delta.alias("delta"), round_half_up(delta / published).alias("relative_delta")))
