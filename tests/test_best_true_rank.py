"""Q8 against brute force: ranks among all reference spectra, by similarity."""

import numpy as np

from peakloom.plans.bindings import REGISTERED
import peakloom.plans.spectrum_queries  # noqa: F401  it registers


def test_best_true_similarity_rank(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 6)), rng.normal(size=4).round(3).tolist()) for i in range(101)]
    rows[40] = (40, 99, rows[40][2])  # without a true reference
    rows[61] = (61, rows[60][1], rows[62][2])  # a tie of a true reference with another
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.query: (r.best, r["rank"]) for r in REGISTERED["best_true_similarity_rank"][0](spark, str(tmp_path)).collect()}
    want = {}
    for i, label, v in rows[::20]:
        scores = [(round(float(np.dot(v, w)), 6), x == label) for j, x, w in rows if j != i]
        best = max((s for s, true in scores if true), default=None)
        want[i] = (best, None if best is None else 1 + sum(s > best for s, _ in scores))
    assert set(got) == set(want) and want[40] == (None, None)
    for i, (best, rank) in want.items():
        assert got[i][1] == rank and (best is None or abs(got[i][0] - best) < 1e-5), i
