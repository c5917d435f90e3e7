"""Profiles: frequencies, missing values, distributions, sweeps over thresholds, error by stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import aggregated, with_cells

QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def distribution(df: DataFrame, column: str, by: list[str] | None = None, quantiles: dict[str, float] | None = None, weight: str | None = None) -> DataFrame:
    """Number, mean, least, largest and linearly interpolated quantiles; with ``weight`` a row counts so many times."""
    n, mean = (F.count(column), F.avg(column)) if weight is None else (F.sum(F.when(F.col(column).isNotNull(), F.col(weight))), weighted_mean(F.col(column), weight))
    return aggregated(df, by, [n.alias("n"), mean.alias("mean"), F.min(column).alias("min"), F.max(column).alias("max")], column, quantiles or QUANTILES, weight)


def weighted_mean(value: Column, weight: str) -> Column:
    """The mean over rows that count ``weight`` times; a null value doesn't."""
    return F.try_divide(F.sum(value * F.col(weight)).cast("double"), F.sum(F.when(value.isNotNull(), F.col(weight))))


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    counted = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return counted.limit(n) if n else counted


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_missing, percent), most missing first; one pass."""
    names = columns or df.columns
    one = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(names)])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(names)]))
    return one.select("__n", cells.alias("x")).select("x.column", "x.n_missing", F.coalesce(100.0 * F.try_divide("x.n_missing", "__n"), F.lit(0.0)).alias("percent")).orderBy(F.desc("n_missing"), "column")


def flag_profile(df: DataFrame, flags: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Number and percent of rows for each condition."""
    cells = [x for name, cond in flags.items() for x in (F.count_if(cond).alias(f"n_{name}"), (100.0 * F.avg(F.coalesce(cond, F.lit(False)).cast("double"))).alias(f"pct_{name}"))]
    return df.groupBy(*by or []).agg(F.count("*").alias("n"), *cells)


def threshold_counts(df: DataFrame, column: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n_above, share) in one pass: each row is compared with every threshold in one aggregate."""
    cells = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.count_if(F.col(column) > t).alias("n_above"), F.avg((F.col(column) > t).cast("double")).alias("share")) for t in thresholds])
    return df.agg(cells.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def tolerance_sweep(df: DataFrame, error: str, tolerances: list[float], by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by..., tolerance, share of rows whose error is within it); with ``weight`` a row counts so many times."""
    share = F.avg if weight is None else lambda within: weighted_mean(within, weight)
    cells = F.array(*[F.struct(F.lit(float(t)).alias("tolerance"), share((F.abs(error) <= t).cast("double")).alias("share")) for t in tolerances])
    return df.groupBy(*by or []).agg(cells.alias("x")).select(*by or [], F.explode("x").alias("x")).select(*by or [], "x.*")


def size_distribution(df: DataFrame, key: str, tail: int = 15) -> DataFrame:
    """(size, n_groups) for sizes up to ``tail``; larger ones as tail + 1."""
    sizes = df.groupBy(key).agg(F.count("*").alias("size"))
    return sizes.groupBy(F.least("size", F.lit(tail + 1)).alias("size")).agg(F.count("*").alias("n_groups"))


def frequency_thresholds(df: DataFrame, key: str, thresholds: list[int]) -> DataFrame:
    """(threshold, keys with at least so many rows, keys with exactly so many)."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    cells = F.array(*[F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("n") >= t).alias("n_at_least"), F.count_if(F.col("n") == t).alias("n_exactly")) for t in thresholds])
    return sizes.agg(cells.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def described(df: DataFrame, column: str) -> DataFrame:
    plain = [F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")]
    return aggregated(df, None, plain, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def repeats(df: DataFrame, by: list[str], column: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))


def exact_auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Share of (positive, negative) pairs in which the positive scores strictly more.

    Rows are first counted by score; a running count over distinct scores, in cells whose totals are added up
    first, gives each score the negatives below it.
    """
    by_score = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    cells = with_cells(by_score, "s")
    totals = cells.groupBy("__cell").agg(F.sum("q").alias("cell_q"))  # some hundred rows
    before = totals.select("__cell", F.coalesce(F.sum("cell_q").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy("__cell").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cells.withColumn("below", below).join(before, "__cell")
    return placed.agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("before"))).cast("double"), (F.sum("p") * F.sum("q")).cast("double")).alias("auc"))


def vector_statistics(df: DataFrame, vector: str, size: int) -> DataFrame:
    """One row: vectors of another size, with values that aren't finite, of zeros only, and the norms of the finite ones."""
    from ..functions.vectors import is_finite, norm

    finite = is_finite(F.col(vector))
    length = F.when(finite, norm(F.col(vector)))
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(F.size(vector) != size).alias("n_wrong_size"),
        F.count_if(~finite).alias("n_not_finite"),
        F.count_if(length == 0).alias("n_zero"),
        F.min(length).alias("min_norm"),
        F.avg(length).alias("mean_norm"),
        F.max(length).alias("max_norm"),
    )


def list_lengths(df: DataFrame, column: str, step: int = 1) -> DataFrame:
    """(n, n_rows): how many rows' lists have so many entries, in units of ``step``; a null list has none."""
    n = F.greatest(F.lit(0), F.floor(F.size(column) / step))
    return df.groupBy(n.cast("long").alias("n")).agg(F.count("*").alias("n_rows"))


def distinct_profile(df: DataFrame, key: str, flags: dict[str, Column], by: list[str], name: str) -> DataFrame:
    """Rows and distinct keys of each group, and distinct keys among the rows of each condition.

    Rows become one a (group, key) first, so that the distinct counts are plain counts.
    """
    held = df.groupBy(*by, key).agg(F.count("*").alias("__n"), *[F.max(F.coalesce(c, F.lit(False))).alias(f"__{f}") for f, c in flags.items()])
    return held.groupBy(*by).agg(F.sum("__n").alias("n"), F.count(key).alias(f"n_{name}"), *[F.count_if(F.col(f"__{f}") & F.col(key).isNotNull()).alias(f"n_{name}_{f}") for f in flags])


def ranking_summary(rows: DataFrame, query: str = "query_id", target: str = "target") -> DataFrame:
    """Queries, rows, positives, negatives, queries with one positive and without one, and group sizes."""
    sizes = rows.groupBy(query).agg(F.count("*").alias("n"), F.sum(target).alias("p"))
    counts = [F.count("*").alias("n_queries"), F.sum("n").alias("n_rows"), F.sum("p").alias("n_positive"), F.sum(F.col("n") - F.col("p")).alias("n_negative"), F.count_if(F.col("p") == 1).alias("n_one_positive"), F.count_if(F.col("p") == 0).alias("n_without_positive")]
    return sizes.agg(*counts, F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"))
