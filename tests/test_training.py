"""Gradients against finite differences, the training step, its sums and its checkpoints."""

import numpy as np
import pytest

from peakloom.operators import training
from peakloom.operators.layers import contrast

RNG = np.random.default_rng(3)


def layer(i, o):
    return {"w": RNG.normal(size=(i, o)) * 0.5, "b": RNG.normal(size=o) * 0.1}


def norm(n):
    return {"scale": 1 + RNG.normal(size=n) * 0.1, "shift": RNG.normal(size=n) * 0.1}


WEIGHTS = {
    "peak1": layer(2, 6), "peak_norm": norm(6), "peak2": layer(6, 6), "attention1": layer(6, 3), "attention2": layer(3, 1), "precursor1": layer(1, 3), "precursor2": layer(3, 3),
    "out1": layer(15, 7), "out_norm": norm(7), "out2": layer(7, 4), "mol1": layer(5, 6), "mol_norm1": norm(6), "mol2": layer(6, 5), "mol_norm2": norm(5), "mol3": layer(5, 4),
}


def a_batch(n=6, peaks=4):
    mz, ints = RNG.uniform(50, 900, (n, peaks)), RNG.uniform(0.1, 1, (n, peaks))
    mask = np.arange(peaks) < np.array([4, 2, 1, 0, 3, 4])[:n, None]
    return np.where(mask, mz, 0.0), np.where(mask, ints, 0.0), mask, RNG.uniform(100, 900, n), (RNG.random((n, 5)) < 0.5).astype(float), np.array([1, 1, 2, 3, 4, 2])[:n]


def test_gradient_against_finite_differences():
    batch = a_batch()
    loss, gradient = training.batch_gradient(*batch, WEIGHTS, 0.3)
    flat = training.flattened(WEIGHTS)
    assert loss > 0 and len(gradient) == len(flat)
    for i in range(0, len(flat), 3):
        step = np.zeros(len(flat))
        step[i] = 1e-5
        up, down = (training.batch_gradient(*batch, training.shaped(flat + s, WEIGHTS), 0.3)[0] for s in (step, -step))
        assert gradient[i] == pytest.approx((up - down) / 2e-5, abs=2e-6, rel=1e-4), training.names_of(WEIGHTS)


def test_contrast_without_positives():
    s, m = RNG.normal(size=(3, 4)), RNG.normal(size=(2, 4))
    loss, to_s, to_m = contrast(s, m, np.zeros((3, 2), bool), 0.1)
    assert loss == 0 and not to_s.any() and not to_m.any()


def rows(spark, n=60, per_batch=10, parts=4):
    rng = np.random.default_rng(5)
    out = []
    for i in range(n):
        structure = i % 12
        peaks = rng.integers(1, 6)
        out.append((i // per_batch, i, structure, [float(60 * structure + 10 * j) for j in range(peaks)], [float(x) for x in rng.uniform(0.1, 1, peaks)], float(80 * structure + 50), [int((structure >> k) & 1) for k in range(5)]))
    out[3] = (*out[3][:3], None, None, None, out[3][6])
    return spark.createDataFrame(out, "batch long, item long, structure long, mzs array<double>, intensities array<double>, precursor_mz double, fingerprint array<int>").repartition(parts)


def test_same_sum_for_any_partitioning(spark):
    one = training.gradient_sum(training.laid_out(rows(spark, parts=1), 1), WEIGHTS, 0.2)
    for parts in (8, 20):
        other = training.gradient_sum(training.laid_out(rows(spark, parts=3), parts), WEIGHTS, 0.2)
        assert one[0] == other[0] == 6 and one[1] == other[1] and np.array_equal(one[2], other[2])
    assert training.gradient_sum(training.laid_out(rows(spark).limit(0), 2), WEIGHTS, 0.2)[0] == 0


def test_loss_falls_and_a_run_is_resumed(spark, tmp_path):
    config = training.TrainConfig(steps=8, warmup=1, peak_rate=0.02)
    table = rows(spark)
    whole, made = training.train(table, WEIGHTS, config, 6, str(tmp_path / "a"), partitions=2)
    assert [m[0] for m in made] == list(range(8)) and made[-1][1] < made[0][1] * 0.9
    assert [m[2] for m in made] == pytest.approx([config.rate(i) for i in range(8)]) and config.rate(0) == 0.02
    _, first = training.train(table, WEIGHTS, config, 6, str(tmp_path / "b"), partitions=3, until=3)
    again, rest = training.train(table, WEIGHTS, config, 6, str(tmp_path / "b"), partitions=1)
    assert first + rest == made
    assert np.array_equal(training.flattened(whole), training.flattened(again))
    none, made = training.train(table, WEIGHTS, config, 6, str(tmp_path / "b"))
    assert made == [] and np.array_equal(training.flattened(none), training.flattened(whole))


def test_adamw_by_hand():
    config = training.TrainConfig(clip=1.0, warmup=0, weight_decay=0.5, steps=2)
    state = training.State(0, np.array([1.0, -2.0]), np.zeros(2), np.zeros(2))
    got, rate, norm = training.moved(state, np.array([3.0, 4.0]), config, np.array([1.0, 0.0]))
    assert norm == 5 and rate == config.peak_rate
    assert got.weights == pytest.approx([1 - 1e-3 * 0.5 - 1e-3, -2 - 1e-3], abs=1e-9)  # a first step is the rate's size, whatever the gradient's
    with pytest.raises(ValueError):
        training.TrainConfig(steps=0)
