"""A stored index of candidate masses, and the range join that reads only the folders it is asked for.

Variants are stored once with their structure's count and neighbours in mass, by buckets on the logarithm of the mass. Folders
are stretches of ``PER_FOLDER`` buckets, so their number follows from the range of masses, not from the number of
variants; inside a folder rows are sorted by bucket, so the files' own minima and maxima skip further. A search
takes the folders that its windows meet (a list as short as there are folders) and joins by bucket there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import scratch_path
from .range_join import bucket_step, clean_variants, log_bucket, nearest_only, windows, with_neighbours

PER_FOLDER = 1000
PPM = 10.0


@dataclass(frozen=True)
class MassIndex:
    """``step``: relative width of a bucket, twice the tolerance that the index is made for; others are searched as well."""

    path: str
    step: float
    per_folder: int = PER_FOLDER

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def build_mass_index(variants: DataFrame, ppm: float = PPM, path: str | None = None, per_folder: int = PER_FOLDER) -> MassIndex:
    """``variants``: structure, exact_mass, smiles and any other columns; rows without a key or a sound mass are left out."""
    path = path or scratch_path(variants.sparkSession, "mass-index")
    step = bucket_step(ppm)
    rows = with_neighbours(clean_variants(variants)).withColumn("bucket", log_bucket(F.col("exact_mass"), step))
    rows = rows.withColumn("folder", F.floor(F.col("bucket") / per_folder))
    # by bucket too, so that a folder of very many variants is written by several tasks
    rows.repartitionByRange("folder", "bucket").sortWithinPartitions("folder", "bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("folder").parquet(path)
    return MassIndex(path, step, per_folder)


def folders_asked(asked: DataFrame, per_folder: int) -> list[int]:
    """The folders of the windows' buckets, of which there are as many as stretches of mass at most."""
    return sorted(r.folder for r in asked.select(F.floor(F.col("__bucket") / per_folder).alias("folder")).distinct().collect())


def stored_rows(spark: SparkSession, index: MassIndex, asked: DataFrame) -> DataFrame:
    """The stored variants of the folders that ``range_join.windows`` meet."""
    return index.rows(spark).where(F.col("folder").isin(folders_asked(asked, index.per_folder))).drop("folder")


def search_masses(spark: SparkSession, index: MassIndex, queries: DataFrame, ppm: float | Column, query: str = "spectrum_id", mass: str = "mass", max_candidates: int | None = None) -> DataFrame:
    """As ``mass_hits``: one row a query and structure, its nearest variant, errors and variant count."""
    if max_candidates is not None and max_candidates <= 0:
        raise ValueError("max_candidates must be positive")
    asked = windows(queries, ppm, mass, index.step)
    joined = asked.join(stored_rows(spark, index, asked).withColumnRenamed("bucket", "__bucket"), "__bucket").where(F.col("exact_mass").between(F.col("__low"), F.col("__high")))
    best = nearest_only(joined.drop("__bucket", "__low", "__high"), mass).withColumn("error_da", F.col("exact_mass") - F.col(mass))
    if max_candidates is None:
        return best
    by_query = Window.partitionBy(query).orderBy(F.abs("error_ppm"), "structure")
    return best.withColumn("__n", F.row_number().over(by_query)).where(F.col("__n") <= max_candidates).drop("__n")


def self_check(spark: SparkSession, index: MassIndex, ppm: float = PPM) -> DataFrame:
    """One row: structures, those whose every variant finds its structure without an error, and the same in percent."""
    stored = index.rows(spark)
    own = stored.select(F.col("structure").alias("own"), F.col("exact_mass").alias("mass"))
    found = search_masses(spark, index, own, ppm, "own").where("structure = own and exact_mass = mass and error_ppm = 0").select("own", "mass")
    marked = own.join(found.withColumn("found", F.lit(1)), ["own", "mass"], "left")
    each = marked.groupBy("own").agg(F.min(F.coalesce("found", F.lit(0))).alias("found"))
    return each.agg(F.count("*").alias("n_structures"), F.sum("found").alias("n_found"), (100.0 * F.avg("found")).alias("percent"))
