"""Ranking metrics over one row a query (the true candidate's rank, null if absent) or over ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 5, 10, 25)


def true_ranks(rows: DataFrame, query: str = "query_id", rank: str = "rank", target: str = "target") -> DataFrame:
    """(query, rank): the best rank of a positive row; null for a query without one."""
    return rows.groupBy(query).agg(F.min(F.when(F.col(target) == 1, F.col(rank))).alias("rank"))


def reciprocal(rank: str = "rank", cutoff: int | None = None) -> Column:
    """1 / rank; 0 for an absent rank and beyond the cutoff."""
    seen = F.col(rank).isNotNull() & (F.col(rank) <= cutoff if cutoff else F.lit(True))
    return F.when(seen, F.lit(1.0) / F.col(rank)).otherwise(F.lit(0.0))


def hit_at(k: int, rank: str = "rank") -> Column:
    if k <= 0:
        raise ValueError("k must be positive")
    return F.when(F.col(rank) <= k, F.lit(1.0)).otherwise(F.lit(0.0))


def absent_as_miss(ranks: DataFrame, by: list[str] | None = None, cutoff: int | None = 25) -> DataFrame:
    """Recall at each of KS and MRR, absent ranks counting as misses."""
    return ranks.groupBy(*by or []).agg(F.count("*").alias("n"), *[F.avg(hit_at(k)).alias(f"recall_{k}") for k in KS], F.avg(reciprocal(cutoff=cutoff)).alias("mrr"))


def coverage_metrics(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """As absent_as_miss without cutoff, with the share found, and mean and median of the found ranks."""
    found = F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)
    return ranks.groupBy(*by or []).agg(F.count("*").alias("n"), F.avg(found).alias("coverage"), *[F.avg(hit_at(k)).alias(f"recall_{k}") for k in KS], F.avg(reciprocal()).alias("mrr"), F.median("rank").alias("median_rank"), F.avg("rank").alias("mean_rank"))


def absent_dropped(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Only queries whose true candidate was found."""
    return absent_as_miss(ranks.where("rank is not null"), by, cutoff=None)


def metrics_bundle(ranks: DataFrame) -> DataFrame:
    """One row: MRR plain and at 5, 10 and 25, hits at KS, mean and median rank; zeros for an empty table."""
    zero = F.lit(0.0)
    cuts = [F.coalesce(F.avg(reciprocal(cutoff=k)), zero).alias(f"mrr_{k}") for k in (5, 10, 25)]
    hits = [F.coalesce(F.avg(hit_at(k)), zero).alias(f"hits_{k}") for k in KS]
    return ranks.agg(F.coalesce(F.avg(reciprocal()), zero).alias("mrr"), *cuts, *hits, F.coalesce(F.avg("rank"), zero).alias("mean_rank"), F.coalesce(F.median("rank"), zero).alias("median_rank"))


def improvement(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences of two one-row metric tables' shared columns."""
    names = [c for c in before.columns if c in after.columns]
    a, b = before.select(*[F.col(c).alias(f"a_{c}") for c in names]), after.select(*[F.col(c).alias(f"b_{c}") for c in names])
    return a.join(b, F.lit(True)).select(*[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"{c}_delta") for c in names])


def top_accuracy(scores: DataFrame, query: str, candidate: str, target: str, score: str = "score") -> DataFrame:
    """Share of queries whose best-scored row (ties by candidate) is a positive."""
    best = scores.groupBy(query).agg(F.max_by(target, F.struct(F.col(score), -F.col(candidate))).alias("won"))
    return best.agg(F.avg(F.col("won").cast("double")).alias("top1"))


def top_accuracies(scores: DataFrame, query: str, candidate: str, target: str, score: str = "score") -> DataFrame:
    """(forward, backward): top_accuracy of queries over candidates, and of candidates over queries."""
    forward = top_accuracy(scores, query, candidate, target, score).withColumnRenamed("top1", "forward")
    return forward.crossJoin(top_accuracy(scores, candidate, query, target, score).withColumnRenamed("top1", "backward"))  # one row each
