import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import catalog, encoders, layers, metrics, peaks, pools, profiling, range_join, ranker, scoring, similarity, splits, submit
from peakloom.schemas import checked, looked_up, require, violations
from peakloom.sources import files

A, B, C = "A" * 14, "B" * 14, "C" * 14


@pytest.fixture(scope="module")
def variants(spark):
    return spark.createDataFrame([(A, "CCO", "C2H6O", 100.0), (B, "CCN", "C2H7N", 100.0005), (B, "C[NH3+]", "C2H8N", 101.007776), (C, "CCC", "C3H8", 150.0)], "structure string, smiles string, formula string, exact_mass double")


def find(spark, variants, mass, ppm, **options):
    q = spark.createDataFrame([(1, float(mass))], "spectrum_id long, mass double")
    rows = range_join.mass_hits(q, variants, ppm, **options).orderBy(F.abs("error_ppm"), "structure").collect()
    return [(r.structure, r.exact_mass, r.variant_count) for r in rows]


def test_range_join(spark, variants):
    assert [h[0] for h in find(spark, variants, 100.0, 10.0)] == [A, B]
    assert find(spark, variants, 101.007776, 10.0) == [(B, 101.007776, 2)]
    assert (B, 100.0005, 2) in find(spark, variants, 100.0004, 20.0)
    assert find(spark, variants, 200.0, 10.0) == [] and find(spark, variants, -1.0, 10.0) == []
    assert [h[0] for h in find(spark, variants, 100.0, 10.0, max_candidates=1)] == [A]
    with pytest.raises(ValueError):
        find(spark, variants, 100.0, -1.0)
    with pytest.raises(ValueError):
        find(spark, variants, 100.0, 1.0, max_candidates=0)


def test_window_is_closed(spark):  # H2
    v = spark.createDataFrame([("x", "s", 100.0 + 100.0 * 10.0 * 1e-6)], "structure string, smiles string, exact_mass double")
    assert len(find(spark, v, 100.0, 10.0)) == 1


def test_range_join_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    q = [(i, float(m)) for i, m in enumerate(rng.uniform(50, 3000, 60))]
    c = [(int(i), "s", float(m)) for i, m in enumerate(rng.uniform(50, 3000, 400))]
    got = range_join.tolerance_join(spark.createDataFrame(q, "spectrum_id long, mass double"), spark.createDataFrame(c, "structure long, smiles string, exact_mass double"), 5000.0)
    want = {(i, j) for i, m in q for j, _, x in c if m - m * 5000 * 1e-6 <= x <= m + m * 5000 * 1e-6}
    pairs = [(r.spectrum_id, r.structure) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_counts_keep_queries_without_hits(spark, variants):
    q = spark.createDataFrame([(1, 100.0), (2, 500.0)], "spectrum_id long, mass double")
    assert {r.spectrum_id: r.n_candidates for r in range_join.hit_counts(q, variants, 10.0).collect()} == {1: 2, 2: 0}


def test_generation_status(spark, variants):
    s = spark.createDataFrame([(1, 100.0, True, True), (2, 100.0, False, False), (3, 100.0, True, False), (4, -5.0, True, True), (5, None, True, True)], "spectrum_id long, mass double, supported boolean, trusted boolean")
    status, hits = range_join.generate_candidates(s, variants, 10.0)
    assert {r.spectrum_id: r.status for r in status.collect()} == {1: "ok", 2: "unsupported", 3: "untrusted", 4: "bad_mass", 5: "bad_mass"}
    assert {r.spectrum_id for r in hits.collect()} == {1}
    assert {r.spectrum_id for r in range_join.generate_candidates(s, variants, 10.0, require_trusted=False)[1].collect()} == {1, 3}


def sets(spark, groups):
    spectra = [(g, 10 * g + i) for g, s in enumerate(groups) for i in range(len(s))]
    hits = [(g, 10 * g + i, c) for g, s in enumerate(groups) for i, cs in enumerate(s) for c in cs]
    return spark.createDataFrame(hits, "grp int, spectrum_id int, structure int"), spark.createDataFrame(spectra, "grp int, spectrum_id int")


def test_pools(spark):
    hits, spectra = sets(spark, [[[1, 2, 3], [2, 3, 4], [3, 4, 5]], [[1, 2, 3], [2, 3], [2, 4]], [[1, 2], [2, 3], [3, 4]], [[1, 2], [], [2, 3]]])

    def pool(**k):
        out = {}
        for r in pools.select_pool(hits, spectra, **k).collect():
            out.setdefault((r.grp, r.mode), set()).add(r.structure)
        return out

    assert pool() == {(0, "intersection"): {3}, (1, "intersection"): {2}, (2, "union_fallback"): {1, 2, 3, 4}, (3, "union_fallback"): {1, 2, 3}}
    assert pool(ignore_empty=True)[(3, "intersection")] == {2}  # H6
    assert pools.union(hits).where("grp = 0").count() == 5
    mask = pools.availability_mask(pools.select_pool(hits, spectra), spectra, hits).where("grp = 1")
    assert {r.spectrum_id: r.available for r in mask.collect()} == {10: True, 11: True, 12: True}


def scores(spark, rows):
    return spark.createDataFrame(rows, "grp int, spectrum_id int, structure int, score double")


def test_aggregation(spark):
    s = scores(spark, [(0, 1, 1, 0.8), (0, 1, 2, 0.2), (0, 2, 2, 0.8), (0, 2, 3, 0.9), (0, 3, 2, 0.7), (0, 3, 3, float("nan"))])

    def of(method):
        return {r.structure: round(r.score, 6) for r in scoring.aggregate_scores(s, method, ["grp", "structure"]).collect()}

    assert of("mean") == {1: 0.8, 2: round(1.7 / 3, 6), 3: 0.9} and of("max") == {1: 0.8, 2: 0.8, 3: 0.9} and of("top2_mean") == {1: 0.8, 2: 0.75, 3: 0.9}
    assert of("logsumexp")[2] == round(0.8 + 0.1 * math.log(1 + math.exp(-1) + math.exp(-6)), 6)
    with pytest.raises(ValueError):
        of("median")
    pool = spark.createDataFrame([(0, 1), (0, 9)], "grp int, structure int")
    low = {r.structure: r.score for r in scoring.with_unsupported(scoring.aggregate_scores(s, "mean", ["grp", "structure"]), pool, ["grp", "structure"]).collect()}
    assert low[9] == float("-inf")  # H25


def test_statistics(spark):  # H12, H17
    s = scores(spark, [(0, 1, 1, 0.2), (0, 2, 1, 0.6), (0, 3, 1, float("nan")), (0, 1, 2, None), (0, 2, 2, float("inf"))])
    got = {r.structure: r for r in scoring.score_statistics(s, ["grp", "structure"]).collect()}
    assert got[1].mean_score == pytest.approx(0.4) and got[1].score_std == pytest.approx(0.2) and got[1].score_range == pytest.approx(0.4) and got[1].num_supporting_spectra == 2
    assert (got[2].mean_score, got[2].max_score, got[2].score_std, got[2].num_supporting_spectra) == (0.0, 0.0, 0.0, 0)


def test_ranks(spark):  # H3
    s = scores(spark, [(0, 1, 10, 0.2), (0, 1, 20, 0.9), (0, 1, 30, 0.5), (0, 1, 40, 0.5)])
    order = [F.desc("score"), F.col("structure")]
    assert [r.structure for r in scoring.ranked(s, "grp", order).orderBy("rank").collect()] == [20, 30, 40, 10]
    assert {r.structure: r["rank"] for r in scoring.min_ranked(s, "grp").collect()} == {20: 1, 30: 2, 40: 2, 10: 4}
    assert scoring.top_k(s, "grp", 2, order).count() == 2
    with pytest.raises(ValueError):
        scoring.top_k(s, "grp", 0, order)


def test_feature_order(spark):  # H18, H19
    s = scores(spark, [(0, 1, 1, 0.2), (0, 2, 1, 0.8), (0, 1, 2, 0.6), (0, 2, 2, 0.5)])
    errors = spark.createDataFrame([(0, 1, -3.0)], "grp int, structure int, mass_error_ppm double")
    sizes = spark.createDataFrame([(0, 2)], "grp int, n_spectra long")
    f = scoring.candidate_features(scoring.score_statistics(s, ["grp", "structure"]), errors, sizes)
    assert f.columns == ["grp", "structure", *scoring.FEATURES] and len(scoring.FEATURES) == 17 and len(scoring.MODEL_FEATURES) == 11
    rows = {r.structure: r for r in f.collect()}
    assert rows[1].abs_mass_error_ppm == 3.0 and rows[2].mass_error_ppm == 0.0 and rows[1].formula_match == 0.0
    assert rows[1].retrieval_rank == 2.0 and rows[1].similarity_rank == 1.0
    assert rows[1].spectral_similarity_score == rows[1].mean_score and rows[1].embedding_similarity_score == rows[1].max_score


def test_metrics(spark):  # H4, H5
    r = spark.createDataFrame([(1, 1), (2, 2), (3, 30), (4, None)], "query_id int, rank int")
    zero, drop = metrics.absent_as_miss(r).first(), metrics.absent_dropped(r).first()
    assert (zero.n, zero.mrr, zero.recall_1, zero.recall_25) == (4, 0.375, 0.25, 0.5)
    assert drop.n == 3 and drop.mrr == pytest.approx((1 + 0.5 + 1 / 30) / 3)
    assert metrics.coverage_metrics(r).first().coverage == 0.75
    bundle = metrics.metrics_bundle(r.limit(0)).first()
    assert bundle.mrr == 0.0 and bundle.median_rank == 0.0
    with pytest.raises(ValueError):
        metrics.hit_at(0)
    assert metrics.improvement(metrics.metrics_bundle(r), metrics.metrics_bundle(r)).first().mrr_delta == 0.0


def test_true_ranks(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 1, 0)], "query_id string, rank int, target int")
    assert {r.query_id: r["rank"] for r in metrics.true_ranks(rows).collect()} == {"a": 2, "b": None}


def long_peaks(spark, *lists):
    rows = [(i, float(m), float(v)) for i, ps in enumerate(lists) for m, v in ps]
    return spark.createDataFrame(rows, "spectrum_id int, mz double, intensity double")


def cosine(spark, a, b):
    bins = peaks.sparse_bins(long_peaks(spark, a, b))
    return similarity.pair_cosine(spark.createDataFrame([(0, 1)], "a int, b int"), bins).first().cosine


def test_cosine(spark):
    assert cosine(spark, [(100, 1), (200, 2)], [(100, 1), (200, 2)]) == pytest.approx(1.0, abs=1e-12)
    assert cosine(spark, [(100, 1)], [(200, 1)]) == 0.0
    assert cosine(spark, [(100, 1), (200, 1)], [(100, 1), (300, 1)]) == pytest.approx(0.5, abs=1e-12)
    assert cosine(spark, [(100, 1)], [(2000, 1)]) == 0.0


def test_bins(spark):
    bins = peaks.sparse_bins(long_peaks(spark, [(100.01, 0.2), (100.04, 0.3), (-1, 1), (1000, 1), (5, 0), (7, float("inf"))]))
    assert [(r.bin, round(r.v, 6)) for r in bins.collect()] == [(1000, 0.5)]
    n = {r.bin: r.v for r in peaks.normalized(spark.createDataFrame([(0, 1, 3.0), (0, 2, 4.0), (1, 1, 0.0)], "spectrum_id int, bin long, v double")).collect()}
    assert n == {1: pytest.approx(0.6), 2: pytest.approx(0.8)}


def test_zero_scores_are_ranked(spark):  # H13
    s = spark.createDataFrame([(1, 7, 0.4)], "query int, structure int, score double")
    q, all_structures = s.select("query"), spark.createDataFrame([(7,), (8,)], "structure int")
    assert {r.structure: r.score for r in similarity.with_zero_scores(s, q, all_structures).collect()} == {7: 0.4, 8: 0.0}


def test_splits(spark):
    rows = spark.createDataFrame([(f"s{i % 7}", i, i % 3 == 0) for i in range(40)], "structure string, row int, good boolean")
    roles = splits.library_split(rows, "structure", "row", F.col("good"))
    assert {r.structure: r.n for r in roles.where("role = 'query'").groupBy("structure").agg(F.count("*").alias("n")).collect()} == {f"s{i}": 1 for i in range(7)}
    multi = splits.multispectrum_split(rows, "structure", "row", F.col("good"))
    assert multi.where("role = 'query'").groupBy("structure").count().agg(F.max("count")).first()[0] <= 3
    grouped = splits.grouped_split(rows, "structure")
    val, train = grouped.where("split = 'validation'"), grouped.where("split = 'train'")
    assert splits.is_disjoint(val, train, "structure") and val.select("structure").distinct().count() == 1
    lone = spark.createDataFrame([("x", 1, True)], "structure string, row int, good boolean")
    assert splits.library_split(lone, "structure", "row", F.col("good")).first().role == "unused"
    assert sorted(r.row_index for r in splits.dense_index(rows, "row").collect()) == list(range(40))
    again = {(r.structure, r.row, r.role) for r in splits.library_split(rows.repartition(3), "structure", "row", F.col("good")).collect()}
    assert again == {(r.structure, r.row, r.role) for r in roles.collect()}  # H15


def test_combined_index(spark, variants):
    out = catalog.combined_index({"one": variants.where(F.col("structure") != C), "two": variants.where(F.col("structure") != A)})
    got = {(r.structure, r.smiles): (r.sources, r.structure_sources) for r in out.collect()}
    assert got[(A, "CCO")] == ("one", "one") and got[(B, "CCN")] == ("one+two", "one+two") and len(got) == 4


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "x int, y string")
    assert [(r.column, r.n_missing) for r in profiling.missing_profile(df).collect()] == [("y", 1), ("x", 0)]
    assert profiling.distribution(df, "x").first().p50 == 2.0
    pairs = spark.createDataFrame([(0.9, True), (0.2, True), (0.5, False), (0.2, False)], "s double, p boolean")
    assert profiling.exact_auc(pairs, "s", "p").first().auc == 0.5
    assert [r.n_above for r in profiling.threshold_counts(df, "x", [0, 2]).orderBy("threshold").collect()] == [3, 1]


def test_submission(spark):  # H20
    rows = spark.createDataFrame([(1, i, 1.0 - i / 100, f"k{i // 2}") for i in range(40)], "m int, structure int, score double, k string")
    got = submit.submission_lists(rows, "m", [F.desc("score"), F.col("structure")], "k", "k").first()
    assert got.n == 13 and got.smiles.split(";")[:2] == ["k0", "k1"]
    sample = spark.createDataFrame([(1,), (2,)], "m int")
    filled = submit.for_sample(submit.submission_lists(rows, "m", [F.desc("score"), F.col("structure")], "k", "k"), sample, "m")
    assert {r.m: r.smiles != "" for r in filled.collect()} == {1: True, 2: False}


def test_validation(spark):
    good = spark.createDataFrame([("q2", "c4", 0), ("q1", "c2", 0), ("q1", "c1", 1)], "query_id string, candidate_id string, target int")
    assert [r.candidate_id for r in checked(good).collect()] == ["c1", "c2", "c4"]
    bad = good.union(spark.createDataFrame([("q1", "c1", 2)], good.schema))
    assert violations(bad).first().n_repeated == 1
    with pytest.raises(ValueError, match="n_bad_target"):
        checked(bad)
    with pytest.raises(ValueError, match="missing columns: x"):
        require(good, ["x"])
    with pytest.raises(ValueError):
        looked_up(good, spark.createDataFrame([("q1", 1)], "query_id string, v int"), "query_id", "v")


def test_ranker(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(q, c, int(c == 0), *(float(x) for x in (rng.normal(1.5 if c == 0 else 0, 1), rng.normal()))) for q in range(40) for c in range(6)]
    df = spark.createDataFrame(rows, "query_id int, candidate_id int, target int, f1 double, f2 double")
    config = ranker.RankerConfig(max_iter=20, features=("f1", "f2"))
    model = ranker.fit(df, config)
    assert model.weights[0] > abs(model.weights[1])
    assert ranker.evaluate(df, model).first().hits_1 > 0.5
    assert model.importances(spark).first().feature == "f1"
    model.save(spark, str(tmp_path / "m"))
    assert ranker.Ranker.load(spark, str(tmp_path / "m")) == model
    with pytest.raises(ValueError):
        ranker.RankerConfig(objective="none")


def test_ranker_objectives_and_stopping(spark):
    rng = np.random.default_rng(2)
    rows = [(q, c, int(c == 0), *(float(x) for x in (rng.normal(1.0 if c == 0 else 0, 1), rng.normal()))) for q in range(30) for c in range(5)]
    df = spark.createDataFrame(rows, "query_id int, candidate_id int, target int, f1 double, f2 double")
    # weights against their definition: ranks by the first feature
    for objective, worth in (("rank:pairwise", None), ("rank:ndcg", lambda r: 1 / math.log2(r + 1)), ("rank:map", lambda r: 1 / r)):
        want = []
        for q in range(30):
            own = sorted((r for r in rows if r[0] == q), key=lambda r: -r[3])
            place = {r[1]: i + 1 for i, r in enumerate(own)}
            want += [1.0 if worth is None else abs(worth(place[0]) - worth(place[c])) for c in range(1, 5)]
        got = sorted(r.weight for r in ranker.difference_pairs(df, ["f1", "f2"], objective=objective).collect())
        assert got == pytest.approx(sorted(want))
    config = ranker.RankerConfig(max_iter=9, step=2, patience=4, features=("f1", "f2"))
    model = ranker.fit(df.where("query_id < 20"), config, validation=df.where("query_id >= 20"))
    assert [n for n, _ in model.history] == list(range(2, 2 + 2 * len(model.history), 2)) or model.history[-1][0] == 9
    assert (model.best_iteration, model.best_score) == max(model.history, key=lambda h: (h[1], -h[0]))
    assert model.history[-1][0] - model.best_iteration >= 4 or model.history[-1][0] == 9
    again = ranker.fit(df.where("query_id < 20"), ranker.RankerConfig(max_iter=model.best_iteration, features=("f1", "f2")))
    assert model.weights == pytest.approx(again.weights, rel=1e-9)  # sums of partitions come in any order
    best, score = ranker.select_best(df.where("query_id < 20"), df.where("query_id >= 20"), [config, ranker.RankerConfig("rank:ndcg", max_iter=4, features=("f1", "f2"))])
    assert score == best.best_score >= model.best_score


def plain_gelu(x):
    return [0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in x]


def plain_dense(x, layer):
    return [sum(x[i] * layer["w"][i][j] for i in range(len(x))) + layer["b"][j] for j in range(len(layer["b"]))]


def unit(x):
    n = math.sqrt(sum(v * v for v in x))
    return [v / n for v in x]


def plain_norm(x, layer):
    mean = sum(x) / len(x)
    spread = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x) + 1e-5)
    return [(v - mean) / spread * layer["scale"][i] + layer["shift"][i] for i, v in enumerate(x)]


def test_encoders_against_plain_python(spark):
    from peakloom.plans.training_queries import MOLECULE_WEIGHTS as m, SPECTRUM_WEIGHTS as w

    x = np.linspace(-8, 8, 4001)
    assert np.allclose(layers.erf(x), [math.erf(v) for v in x], atol=1e-15, rtol=1e-13)
    lists = [([100.0, 200.5, 950.0], [1.0, 0.5, 0.25], 300.0), ([], [], 300.0), ([55.5], [1.0], None), (None, None, 1.0)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(lists)], "spectrum_id long, mzs array<double>, intensities array<double>, precursor_mz double")
    got = {r.spectrum_id: r.embedding for r in encoders.encode_spectra(df.coalesce(1), w).collect()}
    for i, (mzs, ints, pre) in enumerate(lists):
        if not mzs:
            assert got[i] == [0.0] * 16
            continue
        h = [plain_gelu(plain_dense(plain_gelu(plain_norm(plain_dense([m / 1000, v], w["peak1"]), w["peak_norm"])), w["peak2"])) for m, v in zip(mzs, ints)]
        a = [math.exp(plain_dense(plain_gelu(plain_dense(v, w["attention1"])), w["attention2"])[0]) for v in h]
        pooled = [sum(a[p] * h[p][j] for p in range(len(h))) / sum(a) for j in range(12)] + [max(v[j] for v in h) for j in range(12)]
        pooled += plain_gelu(plain_dense(plain_gelu(plain_dense([(pre or 0.0) / 1000], w["precursor1"])), w["precursor2"]))
        assert got[i] == pytest.approx(unit(plain_dense(plain_gelu(plain_norm(plain_dense(pooled, w["out1"]), w["out_norm"])), w["out2"])), abs=1e-12)
    prints = spark.createDataFrame([(1, [1, 0] * 16), (2, None), (3, [1] * 32)], "structure long, fingerprint array<int>")
    found = {r.structure: r.embedding for r in encoders.encode_molecules(prints, m).collect()}
    for k, bits in ((1, [1, 0] * 16), (3, [1] * 32)):
        y = plain_gelu(plain_norm(plain_dense(bits, m["mol1"]), m["mol_norm1"]))
        y = plain_gelu(plain_norm(plain_dense(y, m["mol2"]), m["mol_norm2"]))
        assert found[k] == pytest.approx(unit(plain_dense(y, m["mol3"])), abs=1e-12)
    assert found[2] is None


def test_cells(spark):
    """Quantiles, dense places and complete groups against numpy, on skewed, tied, null and empty columns."""
    from peakloom.operators import cells

    rng = np.random.default_rng(4)
    data = [("a", float(v)) for v in rng.exponential(1, 3000)] + [("b", float(v)) for v in rng.integers(0, 3, 500)] + [("c", None), ("c", None), (None, 5.0), (None, 7.0), ("d", 1e300)]
    df = spark.createDataFrame(data, "g string, v double")
    points = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    got = {r.g: r for r in cells.quantiles(df, "v", points, ["g"]).collect()}
    for g in ("a", "b", "d", None):
        own = [v for k, v in data if k == g and v is not None]
        assert [got[g][n] for n in points] == pytest.approx([np.quantile(own, q) for q in points.values()], rel=1e-12), g
    assert "c" not in got and cells.aggregated(df, ["g"], [F.count("*").alias("n")], "v", {"p": 0.5}).where("g = 'c'").first() == ("c", 2, None)
    whole = [v for _, v in data if v is not None]
    assert cells.quantiles(df, "v", {"p": 0.37}).first().p == pytest.approx(np.quantile(whole, 0.37), rel=1e-12)
    assert cells.quantiles(df.limit(0), "v", {"p": 0.5}).count() == 0 or cells.quantiles(df.limit(0), "v", {"p": 0.5}).first().p is None
    names = [f"common-prefix-{i}" for i in range(1500)] + [None]
    index = {r.k: r.row_index for r in splits.dense_index(spark.createDataFrame([(n,) for n in names], "k string"), "k").collect()}
    assert [k for k, _ in sorted(index.items(), key=lambda x: x[1])] == [None, *sorted(n for n in names if n)] and sorted(index.values()) == list(range(1501))
    head = splits.complete_groups(spark.createDataFrame([(i // 3, i) for i in range(30)], "g int, i int"), "g", 11)
    assert sorted(r.i for r in head.collect()) == list(range(9))


def test_nearest_variant_is_picked_in_the_join(spark):
    """Against a window over all hits: several variants, equal masses, ties on both sides."""
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 12)), "s%d" % rng.integers(0, 5), float(np.round(rng.uniform(100, 100.4), 2))) for _ in range(150)]
    q = [(i, float(np.round(rng.uniform(100, 100.4), 3))) for i in range(60)]
    got = range_join.mass_hits(spark.createDataFrame(q, "spectrum_id int, mass double"), spark.createDataFrame(rows, "structure int, smiles string, exact_mass double"), 600.0).collect()
    want = {}
    for i, m in q:
        for s, name, x in rows:
            if m - m * 600 * 1e-6 <= x <= m + m * 600 * 1e-6:
                key = (abs((x - m) / m * 1e6), x, name)
                want[i, s] = min(want.get((i, s), key), key)
    assert {(r.spectrum_id, r.structure): (r.exact_mass, r.smiles) for r in got} == {k: v[1:] for k, v in want.items()} and len(got) == len(want)
    assert {r.structure: r.variant_count for r in got} == {s: sum(1 for r in rows if r[0] == s) for s in {r.structure for r in got}}


def test_one_to_one(spark):
    a, z = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "p"), (3, "q"), (3, "r")], "k int, w string")
    assert pools.one_to_one(a, z.where("w <> 'r'"), ["k"], "left").count() == 2
    with pytest.raises(Exception, match="repeated key in the right table: 3"):
        pools.one_to_one(a, z, ["k"], "full_outer").collect()


def test_chemistry_filters(spark):
    from peakloom.functions.chem import ChemistryConfig
    from peakloom.operators import evaluation

    rows = [(q, s, adduct, 100.0, mass) for q, adduct in ((1, "[M+H]+"), (2, "[M+Na]+"), (3, "[M+2H]2+"), (4, "[?]"), (5, "[M+Na]+")) for s, mass in ((1, 100.0 if q == 5 else 101.0), (2, 102.0), (3, None))]
    df = spark.createDataFrame(rows, "query int, structure int, adduct string, neutral_mass double, exact_mass double")
    kept = lambda c: sorted((r.query, r.structure) for r in evaluation.chemistry_filter(df, c).collect())
    every = [(q, s) for q in (2, 3, 4) for s in (1, 2, 3)]
    assert kept(ChemistryConfig()) == every + [(5, 1)]  # hard: none left; soft: all of 2 back; disabled and unknown: passed
    assert kept(ChemistryConfig(fallback=False)) == every[3:] + [(5, 1)]
    candidates = spark.createDataFrame([(g, s, 100.0 + s) for g in (1, 2, 3, 4) for s in (0, 1)], "grp int, structure int, exact_mass double")
    seen = spark.createDataFrame([(1, "[M+H]+", 100.0), (1, "[M+Na]+", 101.0), (2, "[M+Na]+", 101.0), (2, "[M+K]+", 300.0), (3, "[M+Na]+", 300.0), (4, "[?]", 100.0)], "grp int, adduct string, neutral_mass double")
    got = sorted((r.grp, r.structure) for r in evaluation.multi_observation_filter(candidates, seen).collect())
    assert got == [(1, 0), (2, 1), (3, 0), (3, 1), (4, 0), (4, 1)]


def test_zero_aware_ranks_equal_the_grid(spark):
    rng = np.random.default_rng(9)
    scores = spark.createDataFrame([(q, s, float(np.round(rng.uniform(0.1, 1), 1))) for q in range(8) for s in rng.choice(20, 6, replace=False).tolist()], "query int, structure int, score double")
    truths = spark.createDataFrame([(q, int(rng.integers(0, 20))) for q in range(8)] + [(8, 3), (9, 99)], "query int, structure int")
    structures = spark.createDataFrame([(s,) for s in range(20)], "structure int")
    grid = similarity.with_zero_scores(scores, truths.select("query"), structures)
    placed = scoring.ranked(grid, "query", [F.desc("score"), F.col("structure")]).join(truths.withColumnRenamed("structure", "t"), "query").where("structure = t")
    want = {r.query: r["rank"] for r in placed.collect()}
    assert {r.query: r["rank"] for r in similarity.zero_aware_ranks(scores, truths, structures).collect()} == want | {9: None}


def test_encoders(spark):
    rng = np.random.default_rng(1)
    def layer(i, o):
        return {"w": rng.normal(size=(i, o)), "b": rng.normal(size=o)}
    norm = lambda n: {"scale": rng.normal(size=n), "shift": rng.normal(size=n)}
    w = {"peak1": layer(2, 8), "peak_norm": norm(8), "peak2": layer(8, 8), "attention1": layer(8, 4), "attention2": layer(4, 1), "precursor1": layer(1, 4), "precursor2": layer(4, 4), "out1": layer(20, 6), "out_norm": norm(6), "out2": layer(6, 5)}
    df = spark.createDataFrame([(1, [100.0, 200.0], [1.0, 0.5], 300.0), (2, [], [], 300.0)], "spectrum_id long, mzs array<double>, intensities array<double>, precursor_mz double")
    got = {r.spectrum_id: r.embedding for r in encoders.encode_spectra(df, w).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1.0) and got[2] == [0.0] * 5
    m = {"mol1": layer(6, 4), "mol_norm1": norm(4), "mol2": layer(4, 4), "mol_norm2": norm(4), "mol3": layer(4, 3)}
    assert np.linalg.norm(encoders.molecule_vector(np.ones(6), m)) == pytest.approx(1.0)


def test_files(spark, tmp_path):
    sdf = "mol one\n  x\n\n  0  0\nM  END\n> <KEY>\nABCDEFGHIJKLMN-OP\n\n> <MASS>\n12.5\n\n$$$$\nmol two\n\n\nM  END\n> <KEY>\nshort\n\n$$$$\n"
    (tmp_path / "a.sdf").write_text(sdf)
    got = files.read_sdf(spark, str(tmp_path / "a.sdf"), {"KEY": "inchikey", "MASS": "exact_mass"})
    assert [(r.title, r.inchikey, r.exact_mass) for r in got.orderBy("title").collect()] == [("mol one", "ABCDEFGHIJKLMN-OP", "12.5"), ("mol two", "short", None)]
    assert [r.structure for r in files.clean_structures(got).collect()] == ["ABCDEFGHIJKLMN"]
    df = spark.range(10).withColumn("v", F.array(F.col("id")))
    files.write_parquet(df, str(tmp_path / "p"), rows_per_file=3)
    back = files.read_parquet(spark, str(tmp_path / "p"), ["id"])
    assert back.columns == ["id"] and back.count() == 10 and files.file_info(spark.read.parquet(str(tmp_path / "p"))).agg(F.sum("n_rows")).first()[0] == 10
    files.write_csv(spark.range(2), str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), "id long").count() == 2
    files.write_summary(spark.range(1), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().id == 0
    assert files.column_info(df).count() == 2
