"""Small tests of what FINDINGS_r04.md asks for."""

import pytest

from peakloom.plans import bindings, evaluation_queries, mass_queries  # noqa: F401  they register
from tests.oracle import differences
from tests.test_round3 import _mass_tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


RANKED = ["adduct_strata_metrics", "hybrid_threshold_metrics", "multispectrum_evaluation", "subsampled_evaluation"]


@pytest.mark.parametrize("name", RANKED)
def test_truths_are_ranked_in_cells(spark, sf, tmp_path, name):
    """Copied vectors and structures of equal masses; pairs of a spectrum and a candidate are no row of a join."""
    _mass_tables(spark, tmp_path, 3_000)
    spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 20").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    part = spark.read.parquet(f"{tmp_path}/part.parquet").collect()
    spark.createDataFrame([*part, *[(p.p_partkey + 300, "m", p.p_brand, p.p_retailprice) for p in part]], "p_partkey long, p_name string, p_brand string, p_retailprice double").write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
    f, sql = bindings.REGISTERED[name]
    made = f(spark, str(tmp_path))
    assert "MapInArrow" in _plan(made)
    assert differences(made, str(tmp_path), sql) == ""


def _repeated(spark, folder, n_events, copies):
    """Tables in which each mass has several spectra and each pair of masses several structures."""
    _mass_tables(spark, folder, n_events)
    part = spark.read.parquet(f"{folder}/part.parquet").collect()
    rows = [(p.p_partkey + 300 * i, f"n{(7 * i) % 5}", p.p_brand, p.p_retailprice) for i in range(copies) for p in part]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_retailprice double").write.mode("overwrite").parquet(f"{folder}/part.parquet")


LISTED = ["range_join_hits", "range_join_capped", "ppm_both_conventions", "candidate_constraints", "chemistry_filter_hard", "chemistry_filter_soft", "mass_index_search", "hard_negatives"]
COUNTED = ["range_join_counts", "candidate_count_distribution", "survival_by_adduct", "tolerance_sweep", "error_by_source", "error_by_adduct"]


@pytest.mark.parametrize("name", LISTED + COUNTED)
def test_classes_of_equal_masses(spark, tmp_path, monkeypatch, name):
    """Classes of several parts, too; ties are settled by structure over all of them."""
    from peakloom.operators import mass_classes
    from peakloom.plans import more_queries, training_queries  # noqa: F401  they register

    monkeypatch.setattr(mass_classes, "CLASS", 2)
    _repeated(spark, tmp_path, 4_500, 4)
    f, sql = bindings.REGISTERED[name]
    made = f(spark, str(tmp_path))
    assert differences(made, str(tmp_path), sql) == ""


def test_class_hits_do_not_grow_with_copies(spark, tmp_path_factory):
    one, four = tmp_path_factory.mktemp("one"), tmp_path_factory.mktemp("four")
    _repeated(spark, one, 21_000, 1)
    _repeated(spark, four, 84_000, 4)
    n = [bindings.class_hits(spark, str(f)).count() for f in (one, four)]
    assert n[0] == n[1] > 0


def test_weighted_quantiles_equal_repeated_rows(spark):
    from peakloom.operators import cells, profiling

    rows = [(i % 3, float(i * i % 17), 1 + i % 5) for i in range(60)] + [(0, None, 4)]
    weighted = spark.createDataFrame(rows, "g int, x double, w long")
    repeated = spark.createDataFrame([(g, x) for g, x, w in rows for _ in range(w)], "g int, x double")
    points = {"a": 0.0, "b": 0.31, "c": 0.5, "d": 1.0}
    assert sorted(cells.quantiles(weighted, "x", points, ["g"], "w").collect()) == sorted(cells.quantiles(repeated, "x", points, ["g"]).collect())
    pairs = [profiling.distribution(weighted, "x", ["g"], weight="w"), profiling.distribution(repeated, "x", ["g"])]
    assert [sorted(tuple(round(v, 9) for v in r) for r in p.collect()) for p in pairs][0] == sorted(tuple(round(v, 9) for v in r) for r in pairs[1].collect())


@pytest.mark.parametrize("name", ["spectral_retrieval", "spectral_retrieval_metrics", "multispectrum_retrieval", "chemistry_filtered_ranking", "chemistry_comparison"])
def test_spectral_pairs_are_reduced_in_tasks(spark, tmp_path, name):
    """Equal scores, structures without a shared bin, lone spectra and rows without a spectrum."""
    from peakloom.plans import spectrum_queries  # noqa: F401  it registers

    rows = [(i // 3 if i % 50 else None, 10_000.0 + (i * i * 37 % 900) * 10, float(1 + i % 50)) for i in range(1_500)] + [(2_000, 99_000.0, 5.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    f, sql = bindings.REGISTERED[name]
    made = f(spark, str(tmp_path))
    assert "MapInArrow" in _plan(made)
    assert differences(made, str(tmp_path), sql) == ""


@pytest.mark.parametrize("name", ["candidate_generation", "constrained_retrieval_strata"])
def test_spectra_that_agree_are_asked_once(spark, sf, tmp_path, name):
    """No hit is joined to a spectrum by its id."""
    from peakloom.plans import inference_queries  # noqa: F401  it registers

    _repeated(spark, tmp_path, 3_000, 3)
    spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 20").write.parquet(f"{tmp_path}/embeddings.parquet")
    f, sql = bindings.REGISTERED[name]
    made = f(spark, str(tmp_path))
    assert "Join [spectrum_id" not in _plan(made)
    assert differences(made, str(tmp_path), sql) == ""


def test_manifest_of_classes(spark, tmp_path, monkeypatch):
    """Classes of several parts, whose structures have names of their own; hits are shuffled as classes."""
    from peakloom.operators import mass_classes
    from peakloom.plans import inference_queries

    monkeypatch.setattr(mass_classes, "CLASS", 2)
    _repeated(spark, tmp_path, 3_000, 4)
    part = spark.read.parquet(f"{tmp_path}/part.parquet").collect()
    spark.createDataFrame([(p.p_partkey, f"n{p.p_partkey}", f"b{p.p_partkey % 7}", p.p_retailprice) for p in part], "p_partkey long, p_name string, p_brand string, p_retailprice double").write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
    classes = mass_classes.alike(bindings.variants(spark, str(tmp_path)), ("smiles", "formula")).cache()
    assert classes.select("class").distinct().count() == 150 and classes.count() > 150
    assert inference_queries._class_manifest(spark, str(tmp_path), classes).select("structure").distinct().count() <= 150
    f, sql = bindings.REGISTERED["candidate_manifest"]
    assert differences(f(spark, str(tmp_path)), str(tmp_path), sql) == ""


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("name", ["top_accuracy", "both_accuracies", "pooled_by_structure"])
def test_best_scores_come_from_blocks(spark, sf, tmp_path, name, odd):
    """Copied vectors (equal scores); with a vector that isn't finite all pairs are listed as before."""
    from peakloom.plans import coverage_queries, ranking_queries  # noqa: F401  they register

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(v.vec_id + 1000 * i, [float("nan")] * len(v.embedding) if odd and v.vec_id == 3 else v.embedding, v.label) for i in range(2) for v in e.where("vec_id < 40").collect()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    f, sql = bindings.REGISTERED[name]
    made = f(spark, str(tmp_path))
    assert ("MapInArrow" in _plan(made)) is not odd
    assert differences(made, str(tmp_path), sql) == ""
