"""A boosted ranker of regression trees, learned from grouped histograms.

Features are cut into bins at exact quantiles once. A tree is then grown level by level: gradients of a query's pairs
come from sums over its classes of equal scores, each level is one grouped sum over (node, feature, bin), and
only that histogram, whose size depends on depth, features and bins alone, comes to the driver to choose the splits. No row
leaves the executors. Gradients are rounded to integers before they are summed, so the sums, and with them every
split, are the same for any partitioning and after a lost task has run again.

The state of a round is written to the shared folder and the one before it is deleted: lineage doesn't grow with trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.chem import safe_float
from ..schemas import require
from ..sources.files import drop_path, scratch_path, write_parquet
from .cells import quantiles
from .metrics import reciprocal, true_ranks
from .ranker import OBJECTIVES, gain
from .scoring import MODEL_FEATURES, feature_array, ranked

UNIT = 1 << 30  # gradients are summed in this fraction
CUTOFF = 25


@dataclass(frozen=True)
class TreeConfig:
    """``objective`` weighs pairs: all equal, by their exchange's change in NDCG, or in average precision, at the present ranking.

    With ``pair_method`` "topk" only pairs with a row among the first ``num_pairs`` of its query count. The weights of a query's
    pairs add up to 1, so that queries count alike. ``subsample`` (rows, per tree) and ``colsample`` (features, per tree) pick
    by hash of ``seed``.
    """

    objective: str = "rank:pairwise"
    n_trees: int = 100
    learning_rate: float = 0.1
    max_depth: int = 4
    min_child_weight: float = 0.0
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    subsample: float = 1.0
    colsample: float = 1.0
    max_bins: int = 64
    pair_method: str = "mean"
    num_pairs: int = 32
    early_stopping: int | None = None
    seed: int = 42
    features: tuple[str, ...] = field(default=tuple(MODEL_FEATURES))

    def __post_init__(self) -> None:
        if self.objective not in OBJECTIVES:
            raise ValueError(f"unknown objective {self.objective}; known: {', '.join(OBJECTIVES)}")
        if self.pair_method not in ("mean", "topk"):
            raise ValueError("pair_method must be 'mean' or 'topk'")
        if min(self.n_trees, self.learning_rate, self.num_pairs) <= 0 or self.max_bins < 2 or not self.features:
            raise ValueError("n_trees, learning_rate and num_pairs must be positive, max_bins 2 at least, features not empty")
        if min(self.max_depth, self.min_child_weight, self.reg_lambda, self.reg_alpha) < 0:
            raise ValueError("max_depth, min_child_weight, reg_lambda and reg_alpha must not be negative")
        if not (0 < self.subsample <= 1 and 0 < self.colsample <= 1):
            raise ValueError("subsample and colsample must be in (0, 1]")
        if self.early_stopping is not None and self.early_stopping <= 0:
            raise ValueError("early_stopping must be positive")


class Node(NamedTuple):
    """An inner node has a feature, and rows below its threshold go left; a leaf has feature -1 and a value. Indexes are in its tree."""

    feature: int
    threshold: float
    left: int
    right: int
    value: float
    gain: float


Tree = tuple[Node, ...]
_NODE = "struct<feature:int,threshold:double,left:int,right:int,value:double,gain:double>"
_SAVED = f"features array<string>, best_iteration int, best_score double, history array<double>, trees array<array<{_NODE}>>"


@dataclass(frozen=True)
class Ensemble:
    """Trees whose values add up, and if the fit was validated the number of trees that is best and the MRR after each.

    Predictions use the trees up to the best number.
    """

    features: tuple[str, ...]
    trees: tuple[Tree, ...]
    best_iteration: int | None = None
    best_score: float | None = None
    history: tuple[float, ...] = ()

    @property
    def used(self) -> tuple[Tree, ...]:
        return self.trees[: self.best_iteration]

    def flat(self) -> dict[str, np.ndarray]:
        """All used trees as value arrays, children numbered through; ``roots`` has each tree's first node."""
        sizes = [len(t) for t in self.used]
        roots = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if sizes else np.zeros(0, np.int64)
        nodes = [(n.feature, n.threshold, n.left + r, n.right + r, n.value) for t, r in zip(self.used, roots, strict=True) for n in t]
        columns = list(zip(*nodes, strict=True)) or [[]] * 5
        kinds = (np.int64, float, np.int64, np.int64, float)
        return {"roots": roots} | {name: np.array(c, k) for name, c, k in zip(("feature", "threshold", "left", "right", "value"), columns, kinds, strict=True)}

    def predict(self, rows: DataFrame, name: str = "model_score") -> DataFrame:
        """``rows`` with the sum of their leaves; a value that isn't finite counts as 0. One pass over Arrow batches, all rows a step down."""
        flat, width, kept = self.flat(), len(self.features), rows.columns
        ready = require(rows, list(self.features)).withColumn("__x", feature_array(list(self.features)))

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("__x")
                total = scores(flat, x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(total)], [*kept, name])

        return ready.mapInArrow(walk, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{name}` double")

    def score(self) -> Column:
        """The same as one expression, for small ensembles."""

        def below(tree: Tree, i: int) -> Column:
            n = tree[i]
            return F.lit(n.value) if n.feature < 0 else F.when(safe_float(F.col(self.features[n.feature])) < n.threshold, below(tree, n.left)).otherwise(below(tree, n.right))

        total = F.lit(0.0)
        for tree in self.used:
            total = total + below(tree, 0)
        return total

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, i, self.features[n.feature] if n.feature >= 0 else None, n.threshold, n.left, n.right, n.value, n.gain) for t, tree in enumerate(self.trees) for i, n in enumerate(tree)]
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, left int, right int, value double, gain double")

    def importances(self, spark: SparkSession) -> DataFrame:
        """(feature, gain, splits, share): the gain of all its splits in the used trees, largest first; features without a split too."""
        total = dict.fromkeys(self.features, (0.0, 0))
        for n in (n for t in self.used for n in t if n.feature >= 0):
            g, k = total[self.features[n.feature]]
            total[self.features[n.feature]] = (g + n.gain, k + 1)
        whole = sum(g for g, _ in total.values()) or 1.0
        table = spark.createDataFrame([(f, g, k, g / whole) for f, (g, k) in total.items()], "feature string, gain double, splits int, share double")
        return table.orderBy(F.desc("gain"), "feature")

    def save(self, spark: SparkSession, path: str) -> None:
        row = (list(self.features), self.best_iteration, self.best_score, list(self.history), [[tuple(n) for n in t] for t in self.trees])
        spark.createDataFrame([row], _SAVED).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ensemble:
        r = spark.read.schema(_SAVED).parquet(path).first()
        return Ensemble(tuple(r.features), tuple(tuple(Node(*n) for n in t) for t in r.trees), r.best_iteration, r.best_score, tuple(r.history))


def scores(flat: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for root in flat["roots"]:
        node = np.full(len(x), root)
        while True:
            feature = flat["feature"][node]
            inner = feature >= 0
            if not inner.any():
                break
            left = x[rows, np.maximum(feature, 0)] < flat["threshold"][node]
            node = np.where(inner, np.where(left, flat["left"][node], flat["right"][node]), node)
        total += flat["value"][node]
    return total


# learning


def cut_points(rows: DataFrame, features: list[str], max_bins: int) -> list[list[float]]:
    """For each feature the different values of its exact quantiles at 1 / max_bins, 2 / max_bins, ..., 1."""
    pairs = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(features) - 1)).alias("feature"), feature_array(features).alias("value"))).alias("z")
    long = rows.select(pairs).select(F.col("z.feature").alias("feature"), F.col("z.value").alias("value"))
    points = {f"q{i}": i / max_bins for i in range(1, max_bins + 1)}
    found = {r.feature: sorted({r[name] for name in points}) for r in quantiles(long, "value", points, ["feature"]).collect()}  # max_bins numbers a feature
    return [found.get(i, []) for i in range(len(features))]


def binned(rows: DataFrame, config: TreeConfig, cuts: list[list[float]], query: str, candidate: str, target: str) -> DataFrame:
    """(query, id, target, bins, score): a value's bin is the number of cuts up to it."""
    bins = F.array(*[_bin_of(safe_float(F.col(f)), c) for f, c in zip(config.features, cuts, strict=True)])
    return rows.select(F.col(query).alias("query"), F.col(candidate).alias("id"), F.col(target).cast("int").alias("target"), bins.alias("bins"), F.lit(0.0).alias("score"))


def _bin_of(x: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= x)) if cuts else F.lit(0)


def gradients(state: DataFrame, config: TreeConfig) -> DataFrame:
    """``state`` with integer gradients g and h of the pairs' logistic loss at the present scores; 0 for rows in no pair.

    How wrong a pair is depends on its two scores alone, and rows have few different ones, as they are sums of leaves. So a row's sum
    over its pairs comes from the sums of each class of equal scores on the other side; where places weigh the pairs, from the
    classes' sums of gains, and inside the row's own class from running sums in order of place. No pair becomes a row, except with
    "topk", which has ``num_pairs`` a row at most.
    """
    if config.pair_method == "topk":
        return _topk_gradients(state, config)
    placed = config.objective != "rank:pairwise"
    rows = ranked(state, "query", [F.desc("score"), F.col("id")], "place") if placed else state
    worth = F.round(gain(F.col("place"), config.objective) * UNIT).cast("long") if placed else F.lit(0).cast("long")
    rows = rows.withColumn("u", worth)
    sides = {1: F.col("target") == 1, 0: F.col("target") == 0}

    def side(t: int, name: str) -> DataFrame:
        own = rows.where(sides[t]).groupBy("query", "score").agg(F.count("*").alias(f"{name}_n"), F.sum("u").alias(f"{name}_u"))
        return own.withColumnRenamed("score", f"{name}_score")

    # classes of equal scores, not rows
    pairs = side(1, "p").join(side(0, "n"), "query").withColumn("wrong", 1 / (1 + F.exp(F.col("p_score") - F.col("n_score"))))
    sign = F.signum(F.col("p_score") - F.col("n_score")).cast("int")
    factors = {"g": F.col("wrong"), "h": F.col("wrong") * (1 - F.col("wrong"))}

    def seen(t: int, own: str, other: str) -> DataFrame:
        """For each class of one side what the other side's classes add up to: a, and b that counts with the row's own gain; w with equal weights of pairs."""
        n, u = F.col(f"{other}_n"), F.col(f"{other}_u")
        if placed:
            a = {c: F.round(f * sign * u).cast("long") for c, f in factors.items()} | {"w": sign * u}
            b = {c: F.round(f * sign * n * UNIT).cast("long") for c, f in factors.items()} | {"w": sign * n * UNIT}
        else:
            a = {c: F.round(f * UNIT).cast("long") * n for c, f in factors.items()} | {"w": n * UNIT}
            b = dict.fromkeys("ghw", F.lit(0).cast("long"))
        sums = [F.sum(x[c].cast("decimal(38,0)")).cast("double").alias(f"{name}_{c}") for name, x in (("a", a), ("b", b)) for c in "ghw"]
        return pairs.groupBy("query", F.col(f"{own}_score").alias("score")).agg(*sums).withColumn("target", F.lit(t))

    both = seen(0, "n", "p").unionByName(seen(1, "p", "n"))
    tied = F.lit(0.0)
    if placed:
        same = Window.partitionBy("query", "score")
        before = same.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)

        def of_others(value: Column, window: WindowSpec) -> Column:
            """The sum over rows of the other side."""
            n, p = (F.coalesce(F.sum(F.when(sides[t], value)).over(window), F.lit(0)) for t in (0, 1))
            return F.when(sides[1], n).otherwise(p)

        one, u = F.lit(1).cast("long"), F.col("u")
        rows = rows.withColumns({"n_before": of_others(one, before), "u_before": of_others(u, before), "n_same": of_others(one, same), "u_same": of_others(u, same)})
        tied = (F.col("u_before") - F.col("n_before") * u) + ((F.col("n_same") - F.col("n_before")) * u - (F.col("u_same") - F.col("u_before")))
    rows = rows.withColumn("tied", F.when(sides[1] | sides[0], tied).otherwise(0).cast("double"))
    turn = F.when(sides[1], -1.0).otherwise(1.0)  # a place's gain counts with the other sign on the positives' side

    def added(c: str, of_tied: float) -> Column:
        apart = F.col(f"a_{c}") - F.col(f"b_{c}") * (F.col("u") / UNIT)
        return F.coalesce((turn if placed else F.lit(1.0)) * apart, F.lit(0.0)) + F.col("tied") * of_tied

    rows = rows.join(both, ["query", "score", "target"], "left").select(*state.columns, added("g", 0.5).alias("g"), added("h", 0.25).alias("h"), added("w", 1.0).alias("w"))
    whole = rows.where("target = 0").groupBy("query").agg(F.sum(F.round("w").cast("decimal(38,0)")).cast("double").alias("whole"))
    scaled = {c: F.coalesce(F.round(F.try_divide(x * F.lit(float(UNIT)), F.col("whole"))).cast("long"), F.lit(0).cast("long")) for c, x in (("g", turn * F.col("g")), ("h", F.col("h")))}
    return rows.join(whole, "query", "left").withColumns(scaled).select(*state.columns, "g", "h")


def _topk_gradients(state: DataFrame, config: TreeConfig) -> DataFrame:
    """Pairs with a row among the first ``num_pairs``: the first positives with all negatives, and the first negatives with the other positives."""
    rows = ranked(state, "query", [F.desc("score"), F.col("id")], "place")
    kept = ["query", "id", "score", "place"]
    positive = rows.where("target = 1").select(*[F.col(c).alias(f"p_{c}") for c in kept])
    negative = rows.where("target = 0").select(*kept)
    same = F.col("query") == F.col("p_query")
    first = F.col("p_place") <= config.num_pairs
    pairs = negative.join(positive.where(first), same).unionByName(negative.where(F.col("place") <= config.num_pairs).join(positive.where(~first), same))
    weight = F.lit(1.0) if config.objective == "rank:pairwise" else F.abs(gain(F.col("place"), config.objective) - gain(F.col("p_place"), config.objective))
    wrong = 1 / (1 + F.exp(F.col("p_score") - F.col("score")))
    made = pairs.select("query", "id", "p_id", weight.alias("w"), (weight * wrong).alias("g"), (weight * wrong * (1 - wrong)).alias("h"))
    sides = F.explode(F.array(F.struct(F.col("id"), F.lit(1).alias("sign")), F.struct(F.col("p_id").alias("id"), F.lit(-1).alias("sign")))).alias("s")
    whole = made.groupBy("query").agg(F.sum(_units("w")).alias("whole"))
    each = made.select("query", sides, "g", "h").groupBy("query", F.col("s.id").alias("id")).agg(F.sum(_units("g") * F.col("s.sign")).alias("g"), F.sum(_units("h")).alias("h"))
    scaled = each.join(whole, "query").select("query", "id", *[F.round(F.try_divide(F.col(c) * F.lit(float(UNIT)), F.col("whole"))).cast("long").alias(c) for c in ("g", "h")])
    zero = F.lit(0).cast("long")
    return state.join(scaled, ["query", "id"], "left").withColumns({c: F.coalesce(c, zero) for c in ("g", "h")})


def _units(column: str) -> Column:
    return F.round(F.col(column) * UNIT).cast("long")


def _node_of(tree: list[list], cuts: list[list[float]]) -> Column:
    """The node that a row has reached, from its bins."""

    def below(i: int) -> Column:
        feature, cut, left, right = tree[i][:4]
        return F.lit(i) if feature < 0 else F.when(F.get("bins", F.lit(feature)) <= cut, below(left)).otherwise(below(right))

    return below(0)


def histogram(state: DataFrame, node: Column, features: list[int]) -> DataFrame:
    """(node, feature, bin, g, h): sums of the gradients, made in each task before anything is shuffled."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.get("bins", F.lit(f)).alias("bin")) for f in features])).alias("b")
    return state.select(node.alias("node"), each, "g", "h").groupBy("node", "b.feature", "b.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def _shrunk(g: float, alpha: float) -> float:
    return math.copysign(max(abs(g) - alpha, 0.0), g)


def weight_of(g: float, h: float, config: TreeConfig) -> float:
    return -_shrunk(g, config.reg_alpha) / (h + config.reg_lambda) if h + config.reg_lambda > 0 else 0.0


def quality(g: float, h: float, config: TreeConfig) -> float:
    return _shrunk(g, config.reg_alpha) ** 2 / (h + config.reg_lambda) if h + config.reg_lambda > 0 else 0.0


def best_split(bins: dict[int, dict[int, tuple[int, int]]], config: TreeConfig) -> tuple[float, int, int] | None:
    """(gain, feature, last bin on the left) of largest gain over a node's {feature: {bin: (g, h)}}; equal gains go to the lower feature, then the lower bin."""
    best = None
    for feature, sums in sorted(bins.items()):
        g, h = (sum(x[i] for x in sums.values()) / UNIT for i in (0, 1))
        left_g = left_h = 0
        for at in sorted(sums)[:-1]:
            left_g, left_h = left_g + sums[at][0], left_h + sums[at][1]
            lg, lh = left_g / UNIT, left_h / UNIT
            rg, rh = g - lg, h - lh
            if min(lh, rh) < config.min_child_weight:
                continue
            gained = (quality(lg, lh, config) + quality(rg, rh, config) - quality(g, h, config)) / 2
            if gained > 1e-12 and (best is None or gained > best[0]):
                best = (gained, feature, at)
    return best


def _grown(state: DataFrame, config: TreeConfig, cuts: list[list[float]], number: int) -> tuple[list[list], Tree]:
    """One tree, as [feature, bin, left, right, value, gain] lists and as nodes."""
    if config.subsample < 1:
        state = state.where(F.pmod(F.xxhash64(F.lit(config.seed), F.lit(number), "query", "id"), F.lit(1_000_000)) < int(config.subsample * 1_000_000))
    features = sampled_features(config, number)
    tree: list[list] = [[-1, 0, -1, -1, 0.0, 0.0]]
    open_nodes = [0]
    for depth in range(config.max_depth + 1):
        found: dict[int, dict[int, dict[int, tuple[int, int]]]] = {}
        wanted = features if depth < config.max_depth else features[:1]  # the last level needs sums alone
        node = _node_of(tree, cuts)
        for r in histogram(state.where(node.isin(open_nodes)), node, wanted).collect():  # nodes x features x bins
            found.setdefault(r.node, {}).setdefault(r.feature, {})[r.bin] = (r.g, r.h)
        following = []
        for i in open_nodes:
            bins = found.get(i, {})
            sums = next(iter(bins.values()), {})
            g, h = (sum(x[j] for x in sums.values()) / UNIT for j in (0, 1))
            tree[i][4] = config.learning_rate * weight_of(g, h, config)
            split = best_split(bins, config) if depth < config.max_depth else None
            if split:
                gained, feature, at = split
                tree[i] = [feature, at, len(tree), len(tree) + 1, 0.0, gained]
                following += [len(tree), len(tree) + 1]
                tree += [[-1, 0, -1, -1, 0.0, 0.0], [-1, 0, -1, -1, 0.0, 0.0]]
        open_nodes = following
        if not open_nodes:
            break
    return tree, tuple(Node(f, cuts[f][at] if f >= 0 else 0.0, left, right, value, gained) for f, at, left, right, value, gained in tree)


def sampled_features(config: TreeConfig, number: int) -> list[int]:
    if config.colsample == 1:
        return list(range(len(config.features)))
    import zlib

    order = sorted(range(len(config.features)), key=lambda i: (zlib.crc32(f"{config.seed}:{number}:{i}".encode()), i))
    return sorted(order[: max(1, round(config.colsample * len(order)))])


def _leaf_value(tree: list[list], cuts: list[list[float]]) -> Column:
    node = _node_of(tree, cuts)
    return F.get(F.array(*[F.lit(float(n[4])) for n in tree]), node)


def mrr(state: DataFrame, cutoff: int = CUTOFF) -> float:
    placed = ranked(state, "query", [F.desc("score"), F.col("id")])
    return float(true_ranks(placed, "query").agg(F.coalesce(F.avg(reciprocal(cutoff=cutoff)), F.lit(0.0)).alias("m")).first().m)


def fit(rows: DataFrame, config: TreeConfig | None = None, query: str = "query_id", candidate: str = "candidate_id", target: str = "target", validation: DataFrame | None = None) -> Ensemble:
    """Trees for ``rows``, one a (query, candidate). With ``validation`` the MRR at 25 is taken after each tree, the fit
    stops ``early_stopping`` trees after the best (if set), and predictions use the best number."""
    config = config or TreeConfig()
    if config.early_stopping and validation is None:
        raise ValueError("early_stopping needs validation rows")
    spark = rows.sparkSession
    kept = _Kept(spark)
    rows = kept.next(require(rows, [query, candidate, target, *config.features]).select(query, candidate, target, *config.features), "tree-rows")
    cuts = cut_points(rows, list(config.features), config.max_bins)
    state = binned(rows, config, cuts, query, candidate, target)
    judged = binned(require(validation, [query, candidate, target, *config.features]), config, cuts, query, candidate, target) if validation is not None else None
    if judged is not None:
        judged = kept.next(judged, "tree-judged")
    trees: list[Tree] = []
    history: list[float] = []
    best = None
    for number in range(config.n_trees):
        state = kept.next(gradients(state, config), "tree-state")
        tree, nodes = _grown(state, config, cuts, number)
        trees.append(nodes)
        add = (F.col("score") + _leaf_value(tree, cuts)).alias("score")
        state = state.select("query", "id", "target", "bins", add)
        if judged is not None:
            judged = kept.next(judged.select("query", "id", "target", "bins", add), "tree-judged")
            history.append(mrr(judged))
            if best is None or history[-1] > history[best]:
                best = number
            if config.early_stopping and number - best >= config.early_stopping:
                break
    kept.close()
    return Ensemble(config.features, tuple(trees), None if best is None else best + 1, None if best is None else history[best], tuple(history))


class _Kept:
    """Tables of the rounds in the shared folder: of each name only the last one stays."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def next(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        write_parquet(df, path)
        if name in self.paths:
            drop_path(self.spark, self.paths[name])
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        for path in self.paths.values():
            drop_path(self.spark, path)


EXPERIMENTS = (TreeConfig(), TreeConfig("rank:ndcg"), TreeConfig("rank:map"), TreeConfig(max_depth=2), TreeConfig(reg_lambda=10.0), TreeConfig(pair_method="topk"))


def run_experiments(train: DataFrame, validation: DataFrame, configs: list[TreeConfig] | tuple[TreeConfig, ...] = EXPERIMENTS) -> tuple[int, list[Ensemble]]:
    """(index of the fit of largest validation MRR at 25, the first of equal ones; all fits)."""
    fitted = [fit(train, c, validation=validation) for c in configs]
    return max(range(len(fitted)), key=lambda i: (fitted[i].best_score, -i)), fitted


def described(config: TreeConfig) -> dict:
    return asdict(config) | {"features": list(config.features)}
