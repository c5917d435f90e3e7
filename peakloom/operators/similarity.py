"""Sparse similarity as joins on bins; ``sparse_index`` has a stored index, ``blocks`` the dense search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .peaks import norms, normalized
from .splits import dense_index


def normalized_scores(queries: DataFrame, references: DataFrame, spectrum: str = "spectrum_id") -> DataFrame:
    """(query, reference, score) of every pair that shares a bin; both sides are (spectrum, bin, v) over their norms.

    The join is on the bin, and each pair's products are added up before anything else is shuffled. A bin that
    many spectra share is split by adaptive execution, as both sides come straight from their shuffles.
    """
    q = queries.select("bin", F.col(spectrum).alias("query"), F.col("v").alias("qv"))
    r = references.select("bin", F.col(spectrum).alias("reference"), "v")
    return q.join(r, "bin").groupBy("query", "reference").agg(F.sum(F.col("qv") * F.col("v")).alias("score"))


def sparse_scores(queries: DataFrame, references: DataFrame, spectrum: str = "spectrum_id") -> DataFrame:
    """``normalized_scores`` of two bin tables."""
    return normalized_scores(normalized(queries, spectrum), normalized(references, spectrum), spectrum)


def with_zero_scores(scores: DataFrame, queries: DataFrame, structures: DataFrame, query: str = "query", structure: str = "structure") -> DataFrame:
    """Every query of a stated set against every structure, 0 where they share no bin.

    The result is that grid, so the query set must be bounded; Spark broadcasts a side where its size allows. Ranks
    alone don't need it, see ``zero_aware_ranks``.
    """
    grid = queries.select(query).distinct().crossJoin(structures.select(structure).distinct())
    return grid.join(scores, [query, structure], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def zero_aware_ranks(scores: DataFrame, truths: DataFrame, structures: DataFrame, query: str = "query", structure: str = "structure") -> DataFrame:
    """(query, rank) of each query's true structure (``truths``: query, structure) among all structures, where those that
    ``scores`` lacks score 0 and equal scores go by structure; null for a structure that isn't one.

    The absent ones are counted, not listed: before a true structure without a score stand all scored ones, and of
    the others those of smaller key, by its place among all structures. Scores must not be negative.
    """
    places = dense_index(structures.select(structure).distinct(), structure, "__place")
    known = truths.join(places, structure, "left").select(query, F.col(structure).alias("__truth"), "__place")
    own = scores.where("score > 0").select(query, structure, "score").join(known, query, "right")
    mine = F.max(F.when(F.col(structure) == F.col("__truth"), F.col("score"))).over(Window.partitionBy(query))
    ahead = F.when(F.col("__mine").isNotNull(), (F.col("score") > F.col("__mine")) | ((F.col("score") == F.col("__mine")) & (F.col(structure) < F.col("__truth")))).otherwise(F.col(structure).isNotNull())
    counted = own.withColumn("__mine", mine).groupBy(query, "__truth", "__place", "__mine").agg(F.count_if(ahead).alias("__ahead"), F.count_if(F.col(structure) < F.col("__truth")).alias("__smaller"))
    absent = F.when(F.col("__mine").isNull(), F.col("__place") - F.col("__smaller")).otherwise(F.lit(0))
    return counted.select(query, F.when(F.col("__place").isNotNull(), F.col("__ahead") + absent + 1).cast("long").alias("rank"))


def pair_cosine(pairs: DataFrame, bins: DataFrame, spectrum: str = "spectrum_id") -> DataFrame:
    """``pairs`` (a, b) with their cosine; 0 where either has no bin or they share none."""
    left, right = bins.select(F.col(spectrum).alias("a"), "bin", F.col("v").alias("av")), bins.select(F.col(spectrum).alias("b"), "bin", F.col("v").alias("bv"))
    shared = pairs.join(left, "a").join(right, ["b", "bin"]).groupBy("a", "b").agg(F.sum(F.col("av") * F.col("bv")).alias("__dot"))
    size = norms(bins, spectrum)
    out = pairs.join(shared, ["a", "b"], "left").join(size.select(F.col(spectrum).alias("a"), F.col("norm").alias("__na")), "a", "left").join(size.select(F.col(spectrum).alias("b"), F.col("norm").alias("__nb")), "b", "left")
    return out.select("a", "b", F.coalesce(F.try_divide(F.col("__dot"), F.col("__na") * F.col("__nb")), F.lit(0.0)).alias("cosine"))
