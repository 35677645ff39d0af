"""The model learns from all labelled rows: weights and cut are those of all pairs, however few rows give the first weights."""

import numpy as np

from lekhani.llm import quality


def test_all_pairs_and_exact_cut(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 5)
    rng = np.random.default_rng(4)
    good, bad = (np.abs(rng.standard_normal((n, len(quality.FEATURES)))) + shift for n, shift in ((230, 0.0), (70, 0.4)))
    rows = [([float(v) for v in x], k) for k, part in ((1, good), (0, bad)) for x in part]
    model = quality.train(spark.createDataFrame([*rows, (rows[0][0], 7), (rows[0][0], None)], "x array<double>, label int"))
    x = quality.expand(np.concatenate([good, bad]))
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0))
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    d = (z[:230, None] - z[None, 230:]).reshape(230 * 70, -1)
    slope = -(d / (1 + np.exp(d @ model.weights))[:, None]).mean(0) + 1e-3 * model.weights
    assert np.abs(slope).max() < 1e-3
    s = model.latent(np.concatenate([good, bad]))
    assert (s < model.cut).sum() == 70


def test_quantile_by_sorting(spark, monkeypatch):
    monkeypatch.setattr(quality, "CUTS", 3)
    rng = np.random.default_rng(6)
    for s in (rng.standard_normal(50), np.repeat([0.5, 1.5], 20), np.full(9, 2.0)):
        values = spark.createDataFrame([(float(v),) for v in s], "s double")
        for below in (0, 1, 20, 21, len(s)):
            assert quality.quantile(values, below) == quality.between(np.sort(s), below)
