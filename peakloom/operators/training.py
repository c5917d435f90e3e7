"""Training both encoders together, data-parallel over batches.

A batch is put together once and is a row; each task of a step runs forward and backward passes of its batches and adds their gradients up as
integers (in units of 2^-40), so that the sum is the same for any number of partitions. Those vectors, one a task, are added up in
a tree of shuffles, and the driver gets one vector of as many numbers as there are weights. AdamW with a clipped norm
moves the weights; a checkpoint of every step goes to a folder that all share, and a run goes on from the last one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import require
from ..sources.files import scratch_path, write_parquet
from .encoders import padded_lists
from .layers import Weights, contrast, molecule_backward, molecule_forward, spectrum_backward, spectrum_forward

UNIT = float(1 << 40)
FAN = 16  # vectors that a task of the tree adds up


@dataclass(frozen=True)
class TrainConfig:
    peak_rate: float = 1e-3
    floor_rate: float = 0.0
    warmup: int = 2
    steps: int = 10
    weight_decay: float = 1e-2
    clip: float = 1.0
    beta1: float = 0.9
    beta2: float = 0.999
    temperature: float = 0.1

    def __post_init__(self) -> None:
        if min(self.peak_rate, self.clip, self.temperature, self.steps) <= 0 or min(self.floor_rate, self.weight_decay, self.warmup) < 0:
            raise ValueError("rates, clip, temperature and steps must be positive, decay and warm-up not negative")

    def rate(self, step: int) -> float:
        """Linear up to the peak over the warm-up, then a half cosine down to the floor."""
        if step < self.warmup:
            return self.peak_rate * (step + 1) / max(1, self.warmup)
        share = min(1.0, (step - self.warmup) / max(1, self.steps - self.warmup))
        return self.floor_rate + (self.peak_rate - self.floor_rate) * 0.5 * (1 + math.cos(math.pi * share))


def names_of(weights: Weights) -> list[tuple[str, str]]:
    return [(layer, name) for layer in sorted(weights) for name in sorted(weights[layer])]


def flattened(weights: Weights) -> np.ndarray:
    return np.concatenate([np.asarray(weights[a][b], float).ravel() for a, b in names_of(weights)])


def shaped(flat: np.ndarray, like: Weights) -> Weights:
    out: Weights = {}
    at = 0
    for a, b in names_of(like):
        size = np.size(like[a][b])
        out.setdefault(a, {})[b] = flat[at : at + size].reshape(np.shape(like[a][b]))
        at += size
    return out


def decayed(weights: Weights) -> np.ndarray:
    """1 for the weights of dense layers, which decay; 0 for biases and norms."""
    return np.concatenate([np.full(np.size(weights[a][b]), float(b == "w")) for a, b in names_of(weights)])


def batch_gradient(mz, intensity, mask, precursor, prints, structure, weights: Weights, temperature: float) -> tuple[float, np.ndarray]:
    s, kept_s = spectrum_forward(mz, intensity, mask, precursor, weights)
    m, kept_m = molecule_forward(prints, weights)
    loss, to_s, to_m = contrast(s, m, structure[:, None] == structure, temperature)
    return loss, flattened(spectrum_backward(to_s, kept_s, weights) | molecule_backward(to_m, kept_m, weights))


_SUM = "n long, loss long, gradient array<long>"
_ITEM = ["item", "structure", "mzs", "intensities", "precursor_mz", "fingerprint"]
_COLUMNS = ["batch", *_ITEM]
PARTS = 64  # folders of batches at most


def _one(n: int, loss: int, gradient: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"n": [n], "loss": [loss], "gradient": [gradient]}, schema=pa.schema([("n", pa.int64()), ("loss", pa.int64()), ("gradient", pa.list_(pa.int64()))]))


def gradient_sum(rows: DataFrame, weights: Weights, temperature: float) -> tuple[int, float, np.ndarray]:
    """(batches, mean loss, mean gradient) of ``rows``, laid out by ``laid_out``."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total = 0, 0, None
        for part in batches:
            for listed in part.column("rows"):
                table = listed.values
                mz, mask = padded_lists(table.field("mzs"))
                intensity, _ = padded_lists(table.field("intensities"))
                prints, _ = padded_lists(table.field("fingerprint"))
                precursor = np.nan_to_num(table.field("precursor_mz").to_numpy(zero_copy_only=False).astype(float))
                own, gradient = batch_gradient(mz, intensity, mask, precursor, prints, table.field("structure").to_numpy(zero_copy_only=False), shared.value, temperature)
                whole = np.rint(gradient * UNIT).astype(np.int64)
                n, loss, total = n + 1, loss + int(round(own * UNIT)), whole if total is None else total + whole
        if total is not None:
            yield _one(n, loss, total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total = 0, 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("gradient")[i].values.to_numpy()
                n, loss, total = n + batch.column("n")[i].as_py(), loss + batch.column("loss")[i].as_py(), own if total is None else total + own
        if total is not None:
            yield _one(n, loss, total)

    sums = rows.mapInArrow(passes, _SUM)
    parts = rows.rdd.getNumPartitions()
    while parts > 1:
        parts = math.ceil(parts / FAN)
        sums = sums.repartition(parts).mapInArrow(added, _SUM)
    last = sums.collect()  # one row
    if not last:
        return 0, 0.0, np.zeros(len(flattened(weights)))
    r = last[0]
    return r.n, r.loss / UNIT / r.n, np.array(r.gradient, float) / UNIT / r.n


def whole_batches(rows: DataFrame, by: Column) -> DataFrame:
    """A row a batch, with ``part``, and its rows (item, structure, mzs, intensities, precursor_mz, fingerprint) in order of item."""
    listed = F.array_sort(F.collect_list(F.struct(*[c for c in _ITEM])))  # some dozen rows
    return require(rows, _COLUMNS).groupBy(by.alias("part"), "batch").agg(listed.alias("rows"))


def laid_out(rows: DataFrame, partitions: int) -> DataFrame:
    """The whole batches of rows with batch, item, structure, mzs, intensities, precursor_mz and fingerprint, in so many partitions."""
    return whole_batches(rows, F.lit(0)).repartition(partitions, "batch")


@dataclass
class State:
    step: int
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray


def moved(state: State, gradient: np.ndarray, config: TrainConfig, decay: np.ndarray) -> tuple[State, float, float]:
    """The state after one AdamW step, with the learning rate and the gradient's norm before clipping."""
    norm = float(np.linalg.norm(gradient))
    g = gradient * min(1.0, config.clip / (norm + 1e-6))
    t = state.step + 1
    first = config.beta1 * state.first + (1 - config.beta1) * g
    second = config.beta2 * state.second + (1 - config.beta2) * g * g
    rate = config.rate(state.step)
    step = (first / (1 - config.beta1**t)) / (np.sqrt(second / (1 - config.beta2**t)) + 1e-8)
    weights = state.weights * (1 - rate * config.weight_decay * decay) - rate * step
    return State(t, weights, first, second), rate, norm


_CHECKPOINT = "step int, weights array<double>, first array<double>, second array<double>"


def save(spark: SparkSession, state: State, folder: str) -> None:
    spark.createDataFrame([(state.step, state.weights.tolist(), state.first.tolist(), state.second.tolist())], _CHECKPOINT).write.mode("overwrite").parquet(f"{folder}/step={state.step:06d}")


def resume(spark: SparkSession, folder: str) -> State | None:
    """The last whole checkpoint: Spark's writer leaves no readable part of an unfinished one."""
    from pyspark.errors import AnalysisException

    try:
        r = spark.read.schema(_CHECKPOINT).option("recursiveFileLookup", "true").parquet(folder).orderBy(F.desc("step")).first()
    except AnalysisException:
        return None
    return r and State(r.step, np.array(r.weights), np.array(r["first"]), np.array(r.second))


def asked(step: int, per_step: int, n: int) -> list[tuple[int, int]]:
    """The batches of a step, as ranges (from, until): ``per_step`` of the n from step * per_step on, over and over."""
    start, many = step * per_step % n, min(per_step, n)
    return [(start, start + many)] if start + many <= n else [(start, n), (0, start + many - n)]


def train(rows: DataFrame, weights: Weights, config: TrainConfig, per_step: int, folder: str, partitions: int | None = None, until: int | None = None) -> tuple[Weights, list[tuple[int, float, float, float]]]:
    """(weights, (step, loss, rate, norm) of each step made). ``rows`` has a dense ``batch``; step s takes the ``per_step`` batches
    from s * per_step on, over and over. ``until`` stops early; the next call with the same folder goes on from there.

    Batches are put together once and written to folders of consecutive ones, so a step reads its own folders and shuffles nothing;
    its tasks grow with its batches, unless ``partitions`` says how many.
    """
    spark = rows.sparkSession
    n = rows.agg(F.coalesce(F.max("batch") + 1, F.lit(0)).cast("long")).first()[0]
    each = max(1, per_step, math.ceil(n / PARTS))  # batches of a folder
    part = F.floor(F.col("batch") / each).cast("int")
    path = scratch_path(spark, "training")
    batches = whole_batches(rows, part)
    write_parquet(batches, path, partition_by=["part"])
    batches = spark.read.schema(batches.schema).parquet(path)
    state = resume(spark, folder) or State(0, flattened(weights), *(np.zeros(len(flattened(weights))) for _ in range(2)))
    decay, made = decayed(weights), []
    while n and state.step < min(config.steps, until or config.steps):
        wanted = [F.col("part").between(low // each, (high - 1) // each) & (F.col("batch") >= low) & (F.col("batch") < high) for low, high in asked(state.step, per_step, n)]
        used = batches.where(reduce(lambda a, b: a | b, wanted))
        _, loss, gradient = gradient_sum(used.repartition(partitions) if partitions else used, shaped(state.weights, weights), config.temperature)
        at = state.step
        state, rate, norm = moved(state, gradient, config, decay)
        save(spark, state, folder)
        made.append((at, loss, rate, norm))
    return shaped(state.weights, weights), made
