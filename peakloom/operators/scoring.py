"""Scores of (group, spectrum, candidate): aggregates over spectra, ranks, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chem import availability, safe_float
from ..functions.vectors import dot

METHODS = ("mean", "max", "top2_mean", "logsumexp")
#: The ranker's feature columns in their order, and the view that a model is trained on.
FEATURES = ["aggregated_score", "mean_score", "max_score", "top2_mean_score", "spectral_similarity_score", "embedding_similarity_score", "neural_compatibility_score", "mass_error_ppm", "abs_mass_error_ppm", "formula_match", "num_supporting_spectra", "candidate_availability_fraction", "retrieval_rank", "similarity_rank", "neural_rank", "score_std", "score_range"]
MODEL_FEATURES = ["mean_score", "max_score", "top2_mean_score", "mass_error_ppm", "abs_mass_error_ppm", "num_supporting_spectra", "retrieval_rank", "similarity_rank", "neural_rank", "score_std", "score_range"]


def dense_scores(spectra: DataFrame, candidates: DataFrame, group: str = "grp", vector: str = "embedding") -> DataFrame:
    """Dot product of every spectrum and candidate of one group; other columns of both stay."""
    b = candidates.withColumnRenamed(vector, "__other")
    return spectra.join(b, group).withColumn("score", dot(F.col(vector), F.col("__other"))).drop(vector, "__other")


def finite(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))


def top_mean(scores: Column, k: int) -> Column:
    """Mean of the k largest of an array, or of all if fewer."""
    top = F.slice(F.sort_array(scores, asc=False), 1, k)
    return F.aggregate(top, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.size(top), F.lit(1))


def aggregate_scores(scores: DataFrame, method: str, by: list[str], score: str = "score", temperature: float = 0.1) -> DataFrame:
    """(by..., score) by one of METHODS over the finite scores; a key without any is absent."""
    rows = scores.where(finite(F.col(score)))
    if method == "mean":
        return rows.groupBy(*by).agg(F.avg(score).alias("score"))
    if method == "max":
        return rows.groupBy(*by).agg(F.max(score).alias("score"))
    if method == "top2_mean":
        order = Window.partitionBy(*by).orderBy(F.desc(score))
        return rows.withColumn("__n", F.row_number().over(order)).where("__n <= 2").groupBy(*by).agg(F.avg(score).alias("score"))
    if method == "logsumexp":
        top = F.max(score).over(Window.partitionBy(*by))
        shifted = rows.withColumn("__top", top).groupBy(*by, "__top").agg(F.sum(F.exp((F.col(score) - F.col("__top")) / temperature)).alias("__sum"))
        return shifted.select(*by, (F.col("__top") + temperature * F.log("__sum")).alias("score"))
    raise ValueError(f"unknown method {method}; known: {', '.join(METHODS)}")


def with_unsupported(aggregated: DataFrame, pool: DataFrame, by: list[str]) -> DataFrame:
    """Every candidate of the pool; one without a supporting spectrum scores minus infinity."""
    return pool.select(*by).distinct().join(aggregated, by, "left").withColumn("score", F.coalesce("score", F.lit(float("-inf"))))


def score_statistics(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """mean, max, top-2 mean, population deviation, range and number of the finite scores; zeros where there is none."""
    x = F.when(finite(F.col(score)), F.col(score))
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last("__x"))
    ranked = scores.withColumn("__x", x).withColumn("__n", F.row_number().over(order))
    zero = F.lit(0.0)
    return ranked.groupBy(*by).agg(
        F.coalesce(F.avg("__x"), zero).alias("mean_score"),
        F.coalesce(F.max("__x"), zero).alias("max_score"),
        F.coalesce(F.avg(F.when(F.col("__n") <= 2, F.col("__x"))), zero).alias("top2_mean_score"),
        F.coalesce(F.stddev_pop("__x"), zero).alias("score_std"),
        F.coalesce(F.max("__x") - F.min("__x"), zero).alias("score_range"),
        F.count("__x").alias("num_supporting_spectra"),
    )


def pool_by_structure(scores: DataFrame, query: str, structure: str, score: str = "score") -> DataFrame:
    return scores.groupBy(query, structure).agg(F.max(score).alias("score"))


def ranked(scores: DataFrame, query: str, order: list[Column], name: str = "rank") -> DataFrame:
    """Places 1, 2, ... by a total order inside each query."""
    return scores.withColumn(name, F.row_number().over(Window.partitionBy(query).orderBy(*order)))


def min_ranked(scores: DataFrame, query: str, score: str = "score", name: str = "rank") -> DataFrame:
    """1 + the number of larger scores: equal scores share a rank."""
    return scores.withColumn(name, F.rank().over(Window.partitionBy(query).orderBy(F.desc(score))))


def top_k(scores: DataFrame, query: str, k: int, order: list[Column]) -> DataFrame:
    if k <= 0:
        raise ValueError("k must be positive")
    return ranked(scores, query, order).where(F.col("rank") <= k)


def mass_error_feature(hits: DataFrame, by: list[str], spectrum: str = "spectrum_id", error: str = "error_ppm") -> DataFrame:
    """Mean over supporting spectra of each one's error of least size."""
    least = hits.groupBy(*by, spectrum).agg(F.min_by(error, F.struct(F.abs(error), F.col(error))).alias("__e"))
    return least.groupBy(*by).agg(F.avg("__e").alias("mass_error_ppm"))


def candidate_features(statistics: DataFrame, mass_errors: DataFrame, sizes: DataFrame, group: str = "grp", candidate: str = "structure") -> DataFrame:
    """The 17 features: statistics are of (group, candidate), sizes of (group, n_spectra).

    The ranks are those of the mean (retrieval), of the largest score (similarity) and of the top-2 mean
    (neural), ties by candidate; formula_match is 0, as a model must not see it.
    """
    joined = statistics.join(mass_errors, [group, candidate], "left").join(sizes, group)

    def rank_of(column: str) -> Column:
        return F.row_number().over(Window.partitionBy(group).orderBy(F.desc(column), candidate)).cast("double")

    error = safe_float(F.col("mass_error_ppm"))
    columns = {
        "aggregated_score": F.col("mean_score"),
        "mean_score": F.col("mean_score"),
        "max_score": F.col("max_score"),
        "top2_mean_score": F.col("top2_mean_score"),
        "spectral_similarity_score": F.col("mean_score"),
        "embedding_similarity_score": F.col("max_score"),
        "neural_compatibility_score": F.col("top2_mean_score"),
        "mass_error_ppm": error,
        "abs_mass_error_ppm": F.abs(error),
        "formula_match": F.lit(0.0),
        "num_supporting_spectra": F.col("num_supporting_spectra").cast("double"),
        "candidate_availability_fraction": availability(F.col("num_supporting_spectra"), F.col("n_spectra")),
        "retrieval_rank": rank_of("mean_score"),
        "similarity_rank": rank_of("max_score"),
        "neural_rank": rank_of("top2_mean_score"),
        "score_std": F.col("score_std"),
        "score_range": F.col("score_range"),
    }
    return joined.select(group, candidate, *(columns[name].alias(name) for name in FEATURES))


def feature_array(names: list[str] | None = None) -> Column:
    return F.array(*[safe_float(F.col(c)) for c in names or FEATURES])
