"""Submission lists: cut to the best, then one of each evaluation identity, ranked anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import joined_by
from .scoring import ranked, top_k


def submission_lists(rows: DataFrame, molecule: str, order: list[Column], identity: str, shown: str, most: int = 25) -> DataFrame:
    """(molecule, smiles, n): at most ``most`` entries joined by ';'. Duplicates by ``identity`` go after the cut, so a list may be shorter."""
    best = top_k(rows, molecule, most, order)
    first = Window.partitionBy(molecule, identity).orderBy("rank")
    unique = best.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    final = ranked(unique.withColumnRenamed("rank", "__cut"), molecule, [F.col("__cut")])
    return final.groupBy(molecule).agg(joined_by(F.col("rank"), F.col(shown)).alias("smiles"), F.count("*").alias("n"))


def for_sample(lists: DataFrame, sample: DataFrame, molecule: str) -> DataFrame:
    """The sample's molecules in all, with an empty list where there is none."""
    return sample.select(molecule).join(lists, molecule, "left").select(molecule, F.coalesce("smiles", F.lit("")).alias("smiles"))
