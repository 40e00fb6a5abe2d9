"""Comparison of runs, and reports over techniques and datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.numbers import round_half_up

CORE = ("map", "ndcg_at_k", "recall_at_k", "mrr")
# Fixed values of the policy.
UNIVERSAL_RATE, WORST_REGRESSION, CONDITIONAL = 0.7, 0.05, 2


def metric_deltas(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(metric, baseline, candidate, delta) of two rows of aggregates."""
    names = ["precision_at_k", "recall_at_k", "map", "mrr", "ndcg_at_k"]
    long = lambda df, to: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(to)) for m in names])).alias("x")).select("x.*")
    return long(baseline, "baseline").join(long(candidate, "candidate"), "metric").withColumn("delta", round_half_up(F.col("candidate") - F.col("baseline")))


def group_deltas(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(behavior_group, baseline_count, candidate_count, delta) of two tables with behavior_group per query."""
    count = lambda df, to: df.groupBy("behavior_group").agg(F.count("*").alias(to))
    both = count(baseline, "baseline_count").join(count(candidate, "candidate_count"), "behavior_group", "full_outer").fillna(0)
    return both.withColumn("delta", F.col("candidate_count") - F.col("baseline_count"))


def query_deltas(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per query in both: groups and deltas of nDCG, AP, RR and recall, and the direction of nDCG."""
    names = {"ndcg_at_k": "ndcg_delta", "average_precision": "average_precision_delta", "reciprocal_rank": "reciprocal_rank_delta", "recall_at_k": "recall_delta"}
    pick = lambda df, tag: df.select("query_id", F.col("behavior_group").alias(f"{tag}_group"), *[F.col(m).alias(f"{tag}_{m}") for m in names])
    both = pick(baseline, "baseline").join(pick(candidate, "candidate"), "query_id")
    rows = both.select("query_id", "baseline_group", "candidate_group", *[round_half_up(F.col(f"candidate_{m}") - F.col(f"baseline_{m}")).alias(d) for m, d in names.items()])
    return rows.withColumn("change", F.when(F.col("ndcg_delta") > 0, "improved").when(F.col("ndcg_delta") < 0, "worsened").otherwise("unchanged"))


def most_changed(deltas: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` most improved and worsened queries (by nDCG, then AP, then id)."""
    def side(name: str, *order: Column) -> DataFrame:
        best = deltas.orderBy(*order, "query_id").limit(top)
        return best.withColumn("side", F.lit(name)).withColumn("place", F.row_number().over(Window.partitionBy("side").orderBy(*order, "query_id")))

    return side("improved", F.col("ndcg_delta").desc(), F.col("average_precision_delta").desc()).unionByName(side("worsened", F.col("ndcg_delta"), F.col("average_precision_delta")))


def decision(deltas: DataFrame) -> DataFrame:
    """One row: improved or regressed if all core metrics go one way, else mixed; precision isn't asked."""
    core = deltas.where(F.col("metric").isin(*CORE))
    up, down = F.min(F.col("delta") > 0), F.min(F.col("delta") < 0)
    return core.agg(F.when(up, "candidate_improved_core_metrics").when(down, "candidate_regressed_core_metrics").otherwise("candidate_mixed_metrics").alias("decision"))


def relative(technique: Column, baseline: Column) -> Column:
    """(technique - baseline) / baseline to 4 digits; null if either is null or the baseline 0."""
    return F.when(baseline != 0, round_half_up((technique - baseline) / baseline))


def classify(rows: DataFrame) -> DataFrame:
    """(technique, scope, ...) of rows (technique, dataset, baseline, measured): universal, domain-conditional or dormant."""
    each = rows.withColumn("delta", relative(F.col("measured"), F.col("baseline"))).where("delta is not null")
    found = each.groupBy("technique").agg(
        F.count("*").alias("evaluated"),
        F.count_if(F.col("delta") > 0).alias("improved"),
        F.least(F.min("delta"), F.lit(0.0)).alias("worst"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("delta") > 0, F.col("dataset"))))).alias("improved_on"),
    )
    rate = F.col("improved") / F.col("evaluated")
    scope = F.when((rate >= UNIVERSAL_RATE) & (F.col("worst") >= -WORST_REGRESSION), "universal").when(F.col("improved") >= CONDITIONAL, "domain-conditional").otherwise("dormant")
    return found.select("technique", scope.alias("scope"), "evaluated", "improved", round_half_up(rate, 3).alias("improve_rate"), round_half_up(F.col("worst"), 3).alias("worst_relative_regression"), "improved_on")


def wins(rows: DataFrame, against: str = "bge-hybrid", technique: str = "ltr-bge") -> DataFrame:
    """One row: on how many datasets a technique beats a simpler one, and whether that is enough to prefer it."""
    own = rows.where(F.col("technique") == technique).select("dataset", F.col("measured").alias("own"))
    other = rows.where(F.col("technique") == against).select("dataset", F.col("measured").alias("other"))
    both = own.join(other, "dataset").where("own is not null and other is not null")
    n, won = F.count("*"), F.count_if(F.col("own") > F.col("other"))
    return both.agg(n.alias("evaluated"), won.alias("won"), (F.coalesce(F.try_divide(won, n), F.lit(0.0)) >= UNIVERSAL_RATE).alias("preferred"))


def baseline_matrix(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """(dataset, tier, status, query_count, ndcg_at_k, published, delta, relative_delta), the latest run of each dataset, an aggregate first.

    ``runs`` has (dataset, generation, is_aggregate, query_count, ndcg_at_k), ``datasets`` (dataset, tier, published).
    """
    best = runs.groupBy("dataset").agg(F.max_by(F.struct("query_count", "ndcg_at_k"), F.struct("is_aggregate", "generation")).alias("run"))
    both = datasets.join(best, "dataset", "left").select("dataset", "tier", F.when(F.col("run").isNull(), "pending").otherwise("measured").alias("status"), "run.query_count", "run.ndcg_at_k", "published")
    delta = round_half_up(F.col("ndcg_at_k") - F.col("published"))
    return both.withColumn("delta", delta).withColumn("relative_delta", round_half_up(delta / F.col("published")))


def mean_of_parts(runs: DataFrame, parts: DataFrame) -> DataFrame:
    """(dataset, parts, query_count, ndcg_at_k): collections made of parts, by the plain mean over those; ``parts`` has (dataset, part), ``runs`` a row a part."""
    both = parts.join(runs.select(F.col("dataset").alias("part"), "query_count", "ndcg_at_k"), "part")
    mean = F.sum(F.round(F.col("ndcg_at_k") * 10000).cast("long")) / F.lit(10000.0) / F.count("*")
    return both.groupBy("dataset").agg(F.count("*").alias("parts"), F.sum("query_count").alias("query_count"), round_half_up(mean).alias("ndcg_at_k"))


def portfolio(rows: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """(technique, dataset, baseline, measured, relative, scope) of rows (technique, dataset, baseline, measured) and of ``fixed`` ones, measured elsewhere.

    Relative gains are null without a baseline, and where it is 0; a technique without any gain to show is dormant.
    """
    every = rows.select("technique", "dataset", "baseline", "measured")
    every = every if fixed is None else every.unionByName(fixed)
    scopes = classify(every).select("technique", "scope")
    told = every.withColumn("relative", relative(F.col("measured"), F.col("baseline"))).join(scopes, "technique", "left")
    return told.withColumn("scope", F.coalesce("scope", F.lit("dormant")))
