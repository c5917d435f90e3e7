"""A stored inverted index of sparse spectra, and exact top-k search in it.

The index is three tables, written once: postings (bin, part, reference, value), bucketed by bin and part, so that a search
joins them where they lie; the same rows by reference, to score what is left; and a row a bin with its number of
postings and its largest value. A bin of more than ``PART_ROWS`` postings is split in parts by hash, and a query's
row of that bin goes to each part: no task holds a whole common bin.

A search looks at a query's bins from the rarest on. What the bins from some place on can add to a score is bounded, by
their norms and by their largest values. Once that bound is below the k-th best score that is known already, a
reference which shares none of the bins before that place can't be among the k best, and these bins' postings aren't read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import scratch_path
from .peaks import normalized

PART_ROWS = 50_000
PROBED = 2_000  # postings of a query's rarest bins that its first threshold comes from; any number gives the same result
SLACK = 1e-6  # scores this near to a bound are still looked at, so that rounding loses none
BUCKETS = 64


@dataclass(frozen=True)
class SparseIndex:
    """Names of the tables; ``postings`` and ``forward`` are bucketed, ``bins`` has at most as many rows as there are bins."""

    postings: str
    forward: str
    bins: str

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        return spark.table(self.postings), spark.table(self.forward), spark.table(self.bins)

    def drop(self, spark: SparkSession) -> None:
        for name in (self.postings, self.forward, self.bins):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _stored(df: DataFrame, name: str, buckets: int, by: list[str]) -> str:
    """A bucketed table in the shared folder; rows are dealt by the buckets' own hash first, so that each bucket is one file."""
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *by).write.format("parquet").option("compression", "zstd").option("path", scratch_path(df.sparkSession, name))
    writer.bucketBy(buckets, *by).sortBy(*by).saveAsTable(table)
    return table


def build_index(bins: DataFrame, spectrum: str = "spectrum_id", buckets: int = BUCKETS, part_rows: int = PART_ROWS) -> SparseIndex:
    """``bins``: (spectrum, bin, v), a row a bin, values not negative. Spectra are stored over their norm; one of norm 0 has no row."""
    spark = bins.sparkSession
    forward = _stored(normalized(bins, spectrum).select(F.col(spectrum).alias("reference"), "bin", "v"), "sparse_forward", buckets, ["reference"])
    rows = spark.table(forward)
    sizes = rows.groupBy("bin").agg(F.count("*").alias("n"), F.max("v").alias("top")).withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int"))
    table = f"sparse_bins_{uuid.uuid4().hex}"
    sizes.coalesce(1).write.format("parquet").option("path", scratch_path(spark, "sparse_bins")).saveAsTable(table)
    # a row a bin: (high - low) / width of them at most, whatever the number of spectra
    split = rows.join(F.broadcast(spark.table(table).select("bin", "parts")), "bin")
    postings = _stored(split.select("bin", F.pmod(F.hash("reference"), "parts").alias("part"), "reference", "v"), "sparse_postings", buckets, ["bin", "part"])
    return SparseIndex(postings, forward, table)


def checked(spark: SparkSession, index: SparseIndex, tolerance: float = 1e-9) -> DataFrame:
    """One row: whether the tables hold the same rows, how many, and how many references are not of length 1."""
    postings, forward, bins = index.tables(spark)
    lengths = forward.groupBy("reference").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    a = postings.agg(F.count("*").alias("n_postings"), F.max("part").alias("last_part"))
    b = lengths.agg(F.count("*").alias("n_references"), F.count_if(F.abs(F.col("length") - 1) > tolerance).alias("n_bad_length"))
    c = bins.agg(F.count("*").alias("n_bins"), F.sum("n").alias("n_counted"), F.max("n").alias("most"))
    both = postings.join(forward.select("reference", "bin", F.col("v").alias("w")), ["reference", "bin"], "full_outer").agg(F.count_if(~F.col("v").eqNullSafe(F.col("w"))).alias("n_differ"))
    one = a.crossJoin(b).crossJoin(c).crossJoin(both)  # one row each
    return one.withColumn("sound", (F.col("n_postings") == F.col("n_counted")) & (F.col("n_bad_length") == 0) & (F.col("n_differ") == 0))


def _bounded(queries: DataFrame, bins: DataFrame, spectrum: str) -> DataFrame:
    """(query, bin, qv, parts, seen, from_here, after): a query's bins that the index has, from the rarest on, with the postings
    up to each, and what this bin and those after it, or those after it, can add."""
    q = normalized(queries, spectrum).select(F.col(spectrum).alias("query"), "bin", F.col("v").alias("qv"))
    known = q.join(F.broadcast(bins), "bin")  # a row a bin, see build_index
    rare = Window.partitionBy("query").orderBy("n", "bin")
    rest, up_to = rare.rowsBetween(0, Window.unboundedFollowing), rare.rowsBetween(Window.unboundedPreceding, 0)
    bound = F.least(F.sqrt(F.sum(F.col("qv") * F.col("qv")).over(rest)), F.sum(F.col("qv") * F.col("top")).over(rest))
    out = known.withColumn("seen", F.sum("n").over(up_to)).withColumn("from_here", bound)
    return out.withColumn("after", F.coalesce(F.lead("from_here").over(rare), F.lit(0.0)))


def _joined(rows: DataFrame, postings: DataFrame, own: bool) -> DataFrame:
    """(query, reference, partial): products added up over the given bins of each query."""
    asked = rows.select("query", "bin", "qv", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = asked.join(postings.hint("merge"), ["bin", "part"])
    if not own:
        pairs = pairs.where("query <> reference")
    return pairs.groupBy("query", "reference").agg(F.sum(F.col("qv") * F.col("v")).alias("partial"))


def search(spark: SparkSession, index: SparseIndex, queries: DataFrame, k: int, spectrum: str = "spectrum_id", own: bool = False, probed: int = PROBED) -> DataFrame:
    """(query, reference, score, rank): each query's k references of largest cosine, of equal ones (to 9 places) the smaller reference.

    Exact, as if every pair that shares a bin had been scored; pairs that share none are not listed. Without ``own`` a query
    that is a reference itself is left out of its own list.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    ranked, chosen = candidates(spark, index, queries, k, spectrum, own, probed)
    forward = index.tables(spark)[1]
    # what is left is scored over the bins that weren't read, from the references' own rows
    unread = ranked.where("NOT needed").select("query", "bin", "qv")
    rest = chosen.join(forward, "reference").join(unread, ["query", "bin"]).groupBy("query", "reference").agg(F.sum(F.col("qv") * F.col("v")).alias("rest"))
    scored = chosen.join(rest, ["query", "reference"], "left").select("query", "reference", (F.col("partial") + F.coalesce("rest", F.lit(0.0))).alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "reference")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def candidates(spark: SparkSession, index: SparseIndex, queries: DataFrame, k: int, spectrum: str = "spectrum_id", own: bool = False, probed: int = PROBED) -> tuple[DataFrame, DataFrame]:
    """(queries' bins with ``needed``: whether its postings must be read; (query, reference, partial) of those that can be among the k best)."""
    from ..sources.files import materialized

    postings, _, bins = index.tables(spark)
    rows = materialized(_bounded(queries, bins, spectrum), "search-bins")
    first = _joined(rows.where((F.col("seen") <= probed) | (F.col("seen") == F.col("n"))), postings, own)
    place = Window.partitionBy("query").orderBy(F.desc("partial"))
    known = first.withColumn("place", F.row_number().over(place)).where(F.col("place") == k).select("query", F.col("partial").alias("least"))
    least = F.coalesce("least", F.lit(0.0)) - SLACK
    ranked = materialized(rows.join(known, "query", "left").withColumn("least", least).withColumn("needed", F.col("from_here") >= F.col("least")), "search-ranked")
    needed = ranked.where("needed")
    ends = needed.groupBy("query").agg(F.min("after").alias("after"), F.max("least").alias("least"))
    found = _joined(needed, postings, own).join(ends, "query").where(F.col("partial") + F.col("after") >= F.col("least"))
    return ranked, materialized(found.select("query", "reference", "partial"), "search-found")
