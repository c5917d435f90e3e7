"""Encoder forward passes with the caller's weights, contrastive losses, and batch sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import stable_order
from ..functions.vectors import dot
from .layers import Weights, molecule_forward, spectrum_forward


def spectrum_vectors(mz: np.ndarray, intensity: np.ndarray, mask: np.ndarray, precursor: np.ndarray, weights: Weights) -> np.ndarray:
    return spectrum_forward(mz, intensity, mask, precursor, weights)[0]


def molecule_vectors(fingerprints: np.ndarray, weights: Weights) -> np.ndarray:
    return molecule_forward(fingerprints, weights)[0]


def molecule_vector(fingerprint: np.ndarray, weights: Weights) -> np.ndarray:
    return molecule_vectors(fingerprint[None, :], weights)[0]


ROWS = 512  # spectra or molecules encoded at once


def padded_lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of lists as one matrix and the mask of what isn't padding; a null list is empty, a null entry 0."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    mask = np.arange(max(1, sizes.max(initial=0))) < sizes[:, None]
    out = np.zeros(mask.shape)
    out[mask] = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(float))
    return out, mask


def encode_spectra(df: DataFrame, weights: dict, spectrum: str = "spectrum_id") -> DataFrame:
    """(spectrum, embedding) of rows with mzs, intensities and precursor_mz; the weights (a few MB) are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids, mzs, ints, pre = batch.slice(at, ROWS).columns
                mz, mask = padded_lists(mzs)
                out = spectrum_vectors(mz, padded_lists(ints)[0], mask, np.nan_to_num(pre.to_numpy(zero_copy_only=False).astype(float)), shared.value)
                yield pa.RecordBatch.from_arrays([ids, pa.array(list(out), pa.list_(pa.float64()))], [spectrum, "embedding"])

    kind = dict(df.dtypes)[spectrum]
    return df.select(spectrum, "mzs", "intensities", "precursor_mz").mapInArrow(rows, f"{spectrum} {kind}, embedding array<double>")


def encode_molecules(df: DataFrame, weights: Weights, molecule: str = "structure", fingerprint: str = "fingerprint") -> DataFrame:
    """(molecule, embedding) of rows with a fingerprint array; null for a null fingerprint."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids, prints = batch.slice(at, ROWS).columns
                out: list = prints.to_pylist()
                known = [i for i, x in enumerate(out) if x is not None]
                if known:
                    for i, v in zip(known, molecule_vectors(np.array([out[i] for i in known]), shared.value), strict=True):
                        out[i] = v
                yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(pa.float64()))], [molecule, "embedding"])

    return df.select(molecule, fingerprint).mapInArrow(rows, f"{molecule} {dict(df.dtypes)[molecule]}, embedding array<double>")


def supervised_contrastive_loss(batch: DataFrame, by: str, label: str, vector: str = "embedding", item: str = "vec_id", temperature: float = 0.1) -> DataFrame:
    """(by, loss, n_anchors): mean over anchors with a positive of the mean over its positives of -log softmax, inside each batch."""
    a = batch.select(by, F.col(item).alias("i"), F.col(label).alias("li"), F.col(vector).alias("vi"))
    b = batch.select(by, F.col(item).alias("j"), F.col(label).alias("lj"), F.col(vector).alias("vj"))
    pairs = a.join(b, by).where("i <> j").select(by, "i", (F.col("li") == F.col("lj")).alias("positive"), (dot(F.col("vi"), F.col("vj")) / temperature).alias("s"))
    top = F.max("s").over(Window.partitionBy(by, "i"))
    anchors = pairs.withColumn("top", top).groupBy(by, "i", "top").agg(F.sum(F.exp(F.col("s") - F.col("top"))).alias("z"), F.avg(F.when(F.col("positive"), F.col("s"))).alias("p"))
    losses = anchors.where("p is not null").select(by, (F.col("top") + F.log("z") - F.col("p")).alias("l"))
    return losses.groupBy(by).agg(F.avg("l").alias("loss"), F.count("*").alias("n_anchors"))


def cross_modal_loss(pairs: DataFrame, by: str, query: str, target: str, score: str, positive: str, temperature: float = 0.1) -> DataFrame:
    """(by, loss): mean of both directions of -log(share of the softmax that positives get), inside each batch."""

    def one_way(side: str) -> DataFrame:
        s = F.col(score) / temperature
        top = F.max("s").over(Window.partitionBy(by, side))
        each = pairs.withColumn("s", s).withColumn("top", top).withColumn("e", F.exp(F.col("s") - F.col("top")))
        sums = each.groupBy(by, side).agg(F.sum("e").alias("z"), F.sum(F.when(F.col(positive), F.col("e"))).alias("p"))
        return sums.where("p > 0").select(by, (F.log("z") - F.log("p")).alias("l"))

    both = one_way(query).groupBy(by).agg(F.avg("l").alias("l")).unionByName(one_way(target).groupBy(by).agg(F.avg("l").alias("l")))
    return both.groupBy(by).agg(F.avg("l").alias("loss"))


def structure_batches(rows: DataFrame, structure: str, row: str, structures: int, per_structure: int) -> DataFrame:
    """(batch, structure, row, draw): batches of ``structures`` structures with ``per_structure`` rows each, in hash
    order; a structure with fewer rows gives its rows again. The last batch may be short."""
    order = Window.partitionBy(structure).orderBy(stable_order(F.col(structure), F.col(row)), row)
    placed = rows.select(structure, row).withColumn("n", F.row_number().over(order) - 1).withColumn("size", F.count("*").over(Window.partitionBy(structure)))
    draws = placed.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(per_structure - 1)))).where("draw % size = n")
    from .splits import dense_index

    names = dense_index(rows.select(structure).distinct().withColumn("h", stable_order(F.col(structure))), "h", "place")
    batches = names.select(structure, F.floor(F.col("place") / structures).alias("batch"))
    return draws.join(batches, structure).select("batch", structure, row, "draw")
