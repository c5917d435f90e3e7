"""Every registered query of the package against its SQL."""

import importlib

import pytest

from peakloom.plans import bindings

for name in ("coverage_queries", "dataset_queries", "evaluation_queries", "inference_queries", "mass_queries", "more_queries", "ranking_queries", "spectrum_queries", "structure_queries", "training_queries"):
    importlib.import_module(f"peakloom.plans.{name}")

from tests.oracle import differences  # noqa: E402

SIZE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in bindings.REGISTERED.items() if sql))
def test_query_equals_sql(spark, name):
    f, sql = bindings.REGISTERED[name]
    assert differences(f(spark, SIZE), SIZE, sql) == ""


def test_reranker_runs(spark, sf):
    f, _ = bindings.REGISTERED["reranked_candidates"]
    rows = f(spark, sf).collect()
    assert rows and all(r.rank >= 1 for r in rows)


@pytest.mark.parametrize("name", ["encoded_spectra", "encoded_molecules", "ranker_experiments", "feature_importances", "structure_fingerprints"])
def test_queries_without_sql(spark, sf, name):
    rows = bindings.REGISTERED[name][0](spark, sf).collect()
    assert rows
    if name.startswith("encoded"):
        assert all(abs(sum(x * x for x in r[1:]) - 1) < 1e-4 for r in rows)
    if name == "ranker_experiments":
        assert [r.mrr_25 for r in rows if r.chosen] == [max(r.mrr_25 for r in rows)]


def test_entry_module_lists_everything():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 120
