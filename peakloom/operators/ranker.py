"""A learned reranker: pairwise logistic regression over feature differences.

It stands in for a gradient-boosted pairwise ranker, which Spark does not have; it makes no claim to equal its
scores. Pairs are formed inside a query only, a positive with each of its negatives; the objective weighs them by
what their exchange would change in the ranking by the first feature.

The fit is that of Spark ML's logistic regression without an intercept over ``difference_pairs``, but no pair becomes a row:
rows are packed in blocks, a task takes pairs of blocks of one query, and one vector of sums leaves it. Sums are exact
integers, so a fit is the same for any partitioning. The work stays that of all pairs, in bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import require
from ..sources.files import materialized
from .descent import minimised
from .group_blocks import SALTS, packed
from .metrics import metrics_bundle, true_ranks
from .scoring import MODEL_FEATURES, feature_array, ranked

OBJECTIVES = ("rank:pairwise", "rank:ndcg", "rank:map")


@dataclass(frozen=True)
class RankerConfig:
    """``objective`` sets the weights of pairs: all equal, by the change in NDCG, or by the change in average precision.

    With validation rows the fit is looked at every ``step`` iterations and stops ``patience`` iterations after the best.
    """

    objective: str = "rank:pairwise"
    max_iter: int = 50
    reg: float = 1e-3
    step: int = 5
    patience: int = 10
    features: tuple[str, ...] = field(default=tuple(MODEL_FEATURES))

    def __post_init__(self) -> None:
        if self.objective not in OBJECTIVES:
            raise ValueError(f"unknown objective {self.objective}; known: {', '.join(OBJECTIVES)}")
        if self.max_iter <= 0 or self.reg < 0 or self.step <= 0 or self.patience <= 0 or not self.features:
            raise ValueError("max_iter, step and patience must be positive, reg not negative, features not empty")


@dataclass(frozen=True)
class Ranker:
    """Weights, and if the fit was validated the iteration that they are from, its MRR at 25 and that of every look."""

    config: RankerConfig
    weights: tuple[float, ...]
    best_iteration: int | None = None
    best_score: float | None = None
    history: tuple[tuple[int, float], ...] = ()

    def score(self) -> Column:
        return F.aggregate(F.zip_with(feature_array(list(self.config.features)), F.array(*[F.lit(w) for w in self.weights]), lambda x, w: x * w), F.lit(0.0), lambda acc, x: acc + x)

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("model_score", self.score())

    def importances(self, spark: SparkSession) -> DataFrame:
        """(feature, weight), largest in size first."""
        table = spark.createDataFrame(list(zip(self.config.features, self.weights, strict=True)), "feature string, weight double")
        return table.orderBy(F.desc(F.abs("weight")), "feature")

    def save(self, spark: SparkSession, path: str) -> None:
        c = self.config
        row = (c.objective, c.max_iter, c.reg, c.step, c.patience, list(c.features), list(self.weights), self.best_iteration, self.best_score, [list(map(float, h)) for h in self.history])
        spark.createDataFrame([row], _SAVED).write.mode("overwrite").json(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ranker:
        r = spark.read.schema(_SAVED).json(path).first()
        config = RankerConfig(r.objective, r.max_iter, r.reg, r.step, r.patience, tuple(r.features))
        return Ranker(config, tuple(r.weights), r.best_iteration, r.best_score, tuple((int(n), x) for n, x in r.history))


_SAVED = "objective string, max_iter int, reg double, step int, patience int, features array<string>, weights array<double>, best_iteration int, best_score double, history array<array<double>>"


def gain(rank: Column, objective: str) -> Column:
    """What a positive at ``rank`` adds to the objective's metric."""
    if objective == "rank:ndcg":
        return 1 / F.log2(rank + 1)
    return F.lit(1.0) / rank


def _placed(rows: DataFrame, features: list[str], query: str, target: str) -> DataFrame:
    """(q, t, x, h, r): features as an array, their hash, and the place by the first one."""
    x = require(rows, [query, target, *features]).select(F.col(query).alias("q"), F.col(target).alias("t"), feature_array(features).alias("x"), F.xxhash64(query, *features).alias("h"))
    return x.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.get("x", 0)), "h")))


def difference_pairs(rows: DataFrame, features: list[str], query: str = "query_id", target: str = "target", objective: str = "rank:pairwise") -> DataFrame:
    """(features, label, weight): positive minus negative with label 1, and its opposite with 0 for every second pair."""
    x = _placed(rows, features, query, target)
    p = x.where("t = 1").select("q", F.col("x").alias("px"), F.col("h").alias("ph"), F.col("r").alias("pr"))
    n = x.where("t = 0").select("q", F.col("x").alias("nx"), F.col("h").alias("nh"), F.col("r").alias("nr"))
    label = (F.col("ph").bitwiseXOR(F.col("nh")) % 2 == 0).cast("double")
    sign = F.when(label == 1, 1.0).otherwise(-1.0)
    weight = F.lit(1.0) if objective == "rank:pairwise" else F.abs(gain(F.col("pr"), objective) - gain(F.col("nr"), objective))
    return p.join(n, "q").select(array_to_vector(F.zip_with("px", "nx", lambda a, b: (a - b) * sign)).alias("features"), label.alias("label"), weight.alias("weight"))


POSITIVES, NEGATIVES, AT_ONCE = 512, 2048, 64
EXACT = 1 << 64  # sums are added up in this fraction


def pair_blocks(rows: DataFrame, features: list[str], query: str = "query_id", target: str = "target", objective: str = "rank:pairwise") -> DataFrame:
    """(p, n): a block of a query's positives and one of its negatives, as matrices of the features, the sign that ``difference_pairs``
    gives by the hash, and the place's gain."""
    x = _placed(rows, features, query, target).where("q is not null and t in (0, 1)")
    grp = F.col("q").cast("long") if dict(x.dtypes)["q"] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("q")
    worth = F.lit(0.0) if objective == "rank:pairwise" else gain(F.col("r"), objective)
    sign = F.when(F.col("h") % 2 == 0, 1.0).otherwise(-1.0)
    x = materialized(x.select(grp.alias("g"), "t", "r", F.concat("x", F.array(sign, worth)).alias("v")), "placed")
    p = packed(x.where("t = 1"), "g", "r", "v", POSITIVES).select("grp", F.col("matrix").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    n = packed(x.where("t = 0"), "g", "r", "v", NEGATIVES).select("grp", F.col("matrix").alias("n"), F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int").alias("salt"))
    return p.join(n, ["grp", "salt"]).select("p", "n").repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _added(blocks: DataFrame, width: int, each: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``each(positives, negatives)`` over all pairs of blocks; a row a task comes to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for batch in batches:
            for pair in zip(batch.column("p"), batch.column("n"), strict=True):
                own = each(*(np.frombuffer(m.as_buffer()).reshape(-1, width) for m in pair)).tolist()
                total = [t + int(v * EXACT) for t, v in zip(total or [0] * len(own), own, strict=True)]
        if total:
            yield pa.RecordBatch.from_pydict({"sums": [[str(t) for t in total]]})

    found = [[int(v) for v in r.sums] for r in blocks.mapInArrow(sums, "sums array<string>").collect()]
    return np.array([sum(v) / EXACT for v in zip(*found, strict=True)])


def _centred(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features less those of one row: differences stay, and are exactly 0 for a feature that doesn't differ."""
    return p[:, :-2] - n[0, :-2], n[:, :-2] - n[0, :-2]


def _pair_weights(p: np.ndarray, n: np.ndarray, objective: str) -> np.ndarray | float:
    return 1.0 if objective == "rank:pairwise" else np.abs(p[:, -1:] - n[:, -1])


def _spread(p: np.ndarray, n: np.ndarray, objective: str) -> np.ndarray:
    """Sums over pairs of the weight, its square, and the weighted signed differences and their squares."""
    (x, y), out = _centred(p, n), 0.0
    for at in range(0, len(p), AT_ONCE):
        own, a = x[at : at + AT_ONCE], p[at : at + AT_ONCE]
        c = np.broadcast_to(_pair_weights(a, n, objective), (len(own), len(n)))
        s = c * a[:, -2:-1] * n[:, -2]
        squares = c.sum(1) @ own**2 - 2 * (own * (c @ y)).sum(0) + c.sum(0) @ y**2
        out = out + np.concatenate([[c.sum(), (c * c).sum()], s.sum(1) @ own - s.sum(0) @ y, squares])
    return out


def _loss(p: np.ndarray, n: np.ndarray, objective: str, weights: np.ndarray) -> np.ndarray:
    """The pairs' weighted logistic loss and its gradient."""
    (x, y), loss, by_p, by_n = _centred(p, n), 0.0, np.zeros(len(p)), np.zeros(len(n))
    above, below = y @ weights, x @ weights
    for at in range(0, len(p), AT_ONCE):
        d = above - below[at : at + AT_ONCE, None]
        small = np.exp(-np.abs(d))
        c = _pair_weights(p[at : at + AT_ONCE], n, objective)
        loss += float((c * (np.maximum(d, 0) + np.log(1 + small))).sum())
        share = c * np.where(d > 0, 1.0, small) / (1 + small)
        by_p[at : at + AT_ONCE] = share.sum(1)
        by_n += share.sum(0)
    return np.concatenate([[loss], by_n @ y - by_p @ x])


def fitted(blocks: DataFrame, config: RankerConfig) -> Iterator[tuple[float, ...]]:
    """The weights after each iteration, over differences of unit deviation; a feature that doesn't differ has weight 0."""
    k = len(config.features)
    sums = _added(blocks, k + 2, partial(_spread, objective=config.objective))
    if not len(sums) or sums[0] <= 0:
        return
    whole, room = sums[0], sums[0] - sums[1] / sums[0]
    variance = np.maximum(sums[2 + k :] - sums[2 : 2 + k] ** 2 / whole, 0) / room if room > 0 else np.zeros(k)
    scale = np.divide(1.0, np.sqrt(variance), out=np.zeros(k), where=variance > 0)

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        found = _added(blocks, k + 2, partial(_loss, objective=config.objective, weights=x * scale)) / whole
        return float(found[0] + config.reg / 2 * x @ x), found[1:] * scale + config.reg * x

    for x in minimised(objective, np.zeros(k)):
        yield tuple(float(v) for v in x * scale)


def fit(rows: DataFrame, config: RankerConfig | None = None, query: str = "query_id", target: str = "target", validation: DataFrame | None = None) -> Ranker:
    """The ranker after max_iter iterations, or with ``validation`` that of the best look.

    The optimiser draws nothing and starts from zero, so a look at n iterations is at the fit that would end there.
    """
    config = config or RankerConfig()
    blocks = materialized(pair_blocks(rows, list(config.features), query, target, config.objective), "pairs")  # every iteration reads them
    states, weights, made = fitted(blocks, config), (0.0,) * len(config.features), 0

    def after(n: int) -> tuple[float, ...]:
        nonlocal weights, made
        while made < n:
            weights, made = next(states, weights), made + 1
        return weights

    if validation is None:
        return Ranker(config, after(config.max_iter))
    validation = materialized(require(validation, [query, *config.features]), "validation")
    best, history = None, []
    for n in range(config.step, config.max_iter + config.step, config.step):
        n = min(n, config.max_iter)
        weights = after(n)
        score = float(evaluate(validation, Ranker(config, weights), query).first().mrr_25)
        history.append((n, score))
        if best is None or score > best[1]:
            best = (n, score, weights)
        if n - best[0] >= config.patience or n == config.max_iter:
            break
    return Ranker(config, best[2], best[0], best[1], tuple(history))


def evaluate(rows: DataFrame, ranker: Ranker, query: str = "query_id", candidate: str = "candidate_id") -> DataFrame:
    ordered = ranked(ranker.predict(rows), query, [F.desc("model_score"), F.col(candidate)])
    return metrics_bundle(true_ranks(ordered, query))


#: The grid of an experiment: objective and regularisation.
EXPERIMENTS = (RankerConfig(), RankerConfig(reg=0.1), RankerConfig("rank:ndcg"), RankerConfig("rank:map"))


def run_experiments(train: DataFrame, validation: DataFrame, configs: list[RankerConfig] | tuple[RankerConfig, ...] = EXPERIMENTS) -> tuple[Ranker, list[Ranker]]:
    """(the fit of largest validation MRR at 25, the first of equal ones; every fit in the order of ``configs``)."""
    train, validation = materialized(train, "train"), materialized(validation, "validation")
    fitted = [fit(train, c, validation=validation) for c in configs]
    return max(fitted, key=lambda r: (r.best_score, -fitted.index(r))), fitted


def select_best(train: DataFrame, validation: DataFrame, configs: list[RankerConfig]) -> tuple[Ranker, float]:
    best, _ = run_experiments(train, validation, configs)
    return best, best.best_score
