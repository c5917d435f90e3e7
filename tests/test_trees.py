"""The boosted ranker against a learner in plain Python, split for split, and its ensembles."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from peakloom.operators import trees

U = trees.UNIT
NAMES = ("f0", "f1", "f2")


def some_rows(seed=5, queries=40, size=9, first=0):
    rng = random.Random(seed)
    rows = []
    for q in range(first, first + queries):
        true = rng.randrange(size)
        for c in range(size):
            hit = c == true or rng.random() < 0.05
            x = [rng.gauss(1.0 if hit else 0.0, 0.8), float(rng.randrange(4) - (2 if hit and q % 2 else 0)), rng.random()]
            rows.append((q, c, int(hit), *[round(v, 3) for v in x]))
    rows += [(first + queries, 0, 0, 0.1, 1.0, 0.5), (first + queries, 1, 0, 0.2, 0.0, 0.5), (first + queries + 1, 0, 1, 0.5, 2.0, 0.1)]  # queries without a pair
    return rows


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, "query_id long, candidate_id long, target int, f0 double, f1 double, f2 double").repartition(parts)


# --- a learner over lists, one row after another


def plain_cuts(values, n):
    v = sorted(values)
    out = set()
    for i in range(1, n + 1):
        r = (i / n) * (len(v) - 1)
        low, high = v[math.floor(r)], v[math.ceil(r)]
        out.add(low + (high - low) * (r - math.floor(r)))
    return sorted(out)


def plain_gradients(rows, score, config):
    g, h = [0] * len(rows), [0] * len(rows)
    for q in {r[0] for r in rows}:
        own = [i for i, r in enumerate(rows) if r[0] == q]
        place = {i: n for n, i in enumerate(sorted(own, key=lambda i: (-score[i], rows[i][1])), 1)}
        pairs = []
        for i in own:
            for j in own:
                if rows[i][2] == 1 and rows[j][2] == 0 and (config.pair_method == "mean" or min(place[i], place[j]) <= config.num_pairs):
                    gain = {"rank:pairwise": None, "rank:ndcg": lambda r: 1 / math.log2(r + 1), "rank:map": lambda r: 1 / r}[config.objective]
                    w = 1.0 if gain is None else abs(gain(place[j]) - gain(place[i]))
                    wrong = 1 / (1 + math.exp(score[i] - score[j]))
                    pairs.append((i, j, round(w * U), round(w * wrong * U), round(w * wrong * (1 - wrong) * U)))
        whole = sum(p[2] for p in pairs)
        sums = {}
        for i, j, _, a, b in pairs:
            sums[j] = (sums.get(j, (0, 0))[0] + a, sums.get(j, (0, 0))[1] + b)
            sums[i] = (sums.get(i, (0, 0))[0] - a, sums.get(i, (0, 0))[1] + b)
        for i, (a, b) in sums.items():
            g[i], h[i] = (math.copysign(math.floor(abs(x * float(U) / whole) + 0.5), x) for x in (a, b))
    return [int(x) for x in g], [int(x) for x in h]


def plain_tree(x, g, h, cuts, config):
    tree = [[-1, 0.0, -1, -1, 0.0, 0.0]]
    members = {0: list(range(len(x)))}
    level = [0]
    for depth in range(config.max_depth + 1):
        following = []
        for n in level:
            own = members[n]
            total_g, total_h = sum(g[i] for i in own) / U, sum(h[i] for i in own) / U
            value = lambda a, b: a * a / (b + config.reg_lambda)
            tree[n][4] = config.learning_rate * (-total_g / (total_h + config.reg_lambda))
            best = None
            for f in range(len(cuts)):
                for cut in cuts[f]:
                    left = [i for i in own if x[i][f] < cut]
                    if not left or len(left) == len(own):
                        continue
                    lg, lh = sum(g[i] for i in left) / U, sum(h[i] for i in left) / U
                    if min(lh, total_h - lh) < config.min_child_weight:
                        continue
                    gain = (value(lg, lh) + value(total_g - lg, total_h - lh) - value(total_g, total_h)) / 2
                    if gain > 1e-12 and (best is None or gain > best[0]):
                        best = (gain, f, cut, left)
            if best and depth < config.max_depth:
                gain, f, cut, left = best
                inside = set(left)
                tree[n] = [f, cut, len(tree), len(tree) + 1, 0.0, gain]
                members[len(tree)], members[len(tree) + 1] = left, [i for i in own if i not in inside]
                following += [len(tree), len(tree) + 1]
                tree += [[-1, 0.0, -1, -1, 0.0, 0.0], [-1, 0.0, -1, -1, 0.0, 0.0]]
        level = following
    return tree


def plain_score(tree, x):
    n = tree[0]
    while n[0] >= 0:
        n = tree[n[2] if x[n[0]] < n[1] else n[3]]
    return n[4]


def plain_fit(rows, config):
    x = [r[3:] for r in rows]
    cuts = [plain_cuts([r[f] for r in x], config.max_bins) for f in range(3)]
    score, made = [0.0] * len(rows), []
    for _ in range(config.n_trees):
        tree = plain_tree(x, *plain_gradients(rows, score, config), cuts, config)
        score = [s + plain_score(tree, v) for s, v in zip(score, x, strict=True)]
        made.append(tree)
    return made, score


CONFIG = trees.TreeConfig(n_trees=2, learning_rate=0.4, max_depth=2, max_bins=8, features=NAMES)


@pytest.mark.parametrize("objective", trees.OBJECTIVES)
def test_equal_to_a_plain_learner(spark, objective):
    config = replace(CONFIG, objective=objective, min_child_weight=0.05, max_depth=3)
    rows = some_rows()
    got = trees.fit(frame(spark, rows), config)
    want, score = plain_fit(rows, config)
    assert len(got.trees) == 2
    for a, b in zip(got.trees, want, strict=True):
        assert [(n.feature, n.left, n.right) for n in a] == [(n[0], n[2], n[3]) for n in b]
        for n, m in zip(a, b, strict=True):
            assert n.threshold == pytest.approx(m[1], abs=1e-12) and n.value == pytest.approx(m[4], abs=1e-8) and n.gain == pytest.approx(m[5], abs=1e-8)
    table = frame(spark, rows)
    for r in got.predict(table).withColumn("again", got.score()).collect():
        assert r.model_score == pytest.approx(score[rows.index(tuple(r)[:6])], abs=1e-8) and r.again == pytest.approx(r.model_score, abs=1e-12)


def test_same_for_any_partitioning_and_objectives_differ(spark):
    rows = some_rows(8)
    config = replace(CONFIG, subsample=0.8, colsample=0.7)
    one, eight = trees.fit(frame(spark, rows, 1), config), trees.fit(frame(spark, rows, 8), config)
    assert one == eight
    by_objective = {o: trees.fit(frame(spark, rows), replace(CONFIG, objective=o, n_trees=1)).trees for o in trees.OBJECTIVES}
    assert len(set(by_objective.values())) == 3
    first = [t[0][0] for t in by_objective.values()]
    assert all(n.feature >= 0 for n in first)
    few = trees.fit(frame(spark, rows), replace(CONFIG, pair_method="topk", num_pairs=1, n_trees=1))
    assert few.trees != by_objective["rank:pairwise"]


def test_topk_pairs_and_alpha(spark):
    config = replace(CONFIG, pair_method="topk", num_pairs=2, n_trees=2)
    rows = some_rows(3, queries=15)
    got = trees.fit(frame(spark, rows), config)
    want, _ = plain_fit(rows, config)
    assert [[(n.feature, n.left) for n in t] for t in got.trees] == [[(n[0], n[2]) for n in t] for t in want]
    flat = trees.fit(frame(spark, rows), replace(CONFIG, reg_alpha=1e6, n_trees=1))
    assert len(flat.trees[0]) == 1 and flat.trees[0][0].value == 0


def test_early_stopping_and_the_best_cut(spark):
    train, held = frame(spark, some_rows(1)), frame(spark, some_rows(2, first=100))
    config = replace(CONFIG, n_trees=4, early_stopping=1, learning_rate=1.5)
    got = trees.fit(train, config, validation=held)
    assert got.best_iteration == got.history.index(max(got.history)) + 1 and got.best_score == max(got.history)
    assert len(got.trees) == len(got.history) == min(4, got.best_iteration + 1)
    assert len(got.used) == got.best_iteration
    # the history is the MRR of what the first trees predict
    for n in (1, len(got.trees)):
        scored = replace(got, best_iteration=n).predict(held).select(F.col("query_id").alias("query"), F.col("candidate_id").alias("id"), "target", F.col("model_score").alias("score"))
        assert trees.mrr(scored) == pytest.approx(got.history[n - 1], abs=1e-9)
    best, fitted = trees.run_experiments(train, held, [replace(CONFIG, n_trees=1, max_depth=1), replace(CONFIG, n_trees=1)])
    assert fitted[best].best_score == max(f.best_score for f in fitted)


def test_saved_ensembles_and_importances(spark, tmp_path):
    rows = some_rows()
    got = trees.fit(frame(spark, rows), CONFIG, validation=frame(spark, some_rows(2, first=100)))
    got.save(spark, str(tmp_path / "e"))
    assert trees.Ensemble.load(spark, str(tmp_path / "e")) == got
    table = got.importances(spark).collect()
    assert {r.feature for r in table} == set(NAMES) and sum(r.share for r in table) == pytest.approx(1)
    assert [r.gain for r in table] == sorted((r.gain for r in table), reverse=True)
    assert table[0].gain == pytest.approx(sum(n.gain for t in got.used for n in t if n.feature >= 0 and NAMES[n.feature] == table[0].feature))
    assert got.table(spark).count() == sum(len(t) for t in got.trees)


def test_odd_values_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 1, 1, None, 2.0, float("nan")), (1, 2, 0, 1.0, None, float("inf")), (2, 1, 0, 0.0, 0.0, 0.0)], "query_id long, candidate_id long, target int, f0 double, f1 double, f2 double")
    got = trees.fit(rows, replace(CONFIG, n_trees=1))
    assert all(math.isfinite(r.model_score) for r in got.predict(rows).collect())
    none = trees.fit(rows.limit(0), replace(CONFIG, n_trees=2))
    assert [len(t) for t in none.trees] == [1, 1] and none.predict(rows.limit(0)).count() == 0
    assert trees.Ensemble(NAMES, ()).predict(rows).where("model_score = 0").count() == 3


def test_configurations_are_checked(spark):
    for bad in ({"objective": "none"}, {"n_trees": 0}, {"learning_rate": 0}, {"max_depth": -1}, {"min_child_weight": -1}, {"subsample": 0}, {"colsample": 1.5}, {"reg_lambda": -1}, {"early_stopping": 0}, {"pair_method": "all"}, {"num_pairs": 0}, {"features": ()}):
        with pytest.raises(ValueError):
            trees.TreeConfig(**bad)
    with pytest.raises(ValueError):
        trees.fit(frame(spark, some_rows(queries=2)), replace(CONFIG, early_stopping=1))
