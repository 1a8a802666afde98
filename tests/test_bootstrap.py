"""Paired bootstrap against weighting every row in every replicate."""

import numpy as np
import pytest

from quietline.operators import bootstrap


def plain(y, s, w):
    order = np.argsort(-s, kind="stable")
    y, s, w = y[order], s[order], w[order]
    out = tp = n = 0.0
    for v in dict.fromkeys(s.tolist()):
        own = s == v
        h = (w[own] * y[own]).sum()
        tp, n = tp + h, n + w[own].sum()
        out += h * tp / n if n else 0
    return out / (w * y).sum() if (w * y).sum() else None


@pytest.mark.parametrize(("rows", "levels", "parts"), [(400, 12, 3), (3000, 5000, 7), (60, 1, 2)])
def test_average_precision(spark, monkeypatch, rows, levels, parts):
    r = np.random.default_rng(rows)
    c, y, s = r.integers(0, 25, rows), r.integers(0, 2, rows), r.integers(0, levels, rows) / levels
    df = spark.createDataFrame(list(zip(c.tolist(), y.tolist(), s.tolist(), strict=True)) + [(1, None, 0.5), (None, 1, 0.5)], "c long, y int, s double").repartition(parts)
    got = {x.replicate: x.ap for x in bootstrap.average_precision(df, "c", "y", "s", 9).collect()}
    w = bootstrap.weights(c, 9)
    assert all(got[k] == pytest.approx(plain(y.astype(float), s, w[:, k]), abs=1e-12) for k in range(9))
    b = {x.replicate: x.brier for x in bootstrap.brier(df, "c", "y", "s", 9).collect()}
    assert all(b[k] == pytest.approx((w[:, k] * (s - y) ** 2).sum() / w[:, k].sum(), abs=1e-12) for k in range(9))


def test_weights():
    w = bootstrap.weights(np.arange(20_000), 60)
    assert (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.01 and abs(w[:, 1:].var() - 1) < 0.02
    assert abs(np.corrcoef(w[:-1, 3], w[1:, 3])[0, 1]) < 0.03 and abs(np.corrcoef(w[:, 4], w[:, 5])[0, 1]) < 0.03


def test_interval(spark):
    """A better model's gain is above 0; a model has no gain over itself; no positives, no precision."""
    r = np.random.default_rng(2)
    y = r.integers(0, 2, 2000)
    rows = [(int(k % 50), int(v), float(a), float(b)) for k, (v, a, b) in enumerate(zip(y, r.random(2000), 0.4 * y + 0.6 * r.random(2000), strict=True))]
    df = spark.createDataFrame(rows, "c long, y int, a double, b double")
    got = {x.metric: x for x in bootstrap.interval(bootstrap.paired(df, "c", "y", "a", "b", 40)).collect()}
    assert 0 < got["d_ap"].low < got["d_ap"].estimate < got["d_ap"].high and got["d_brier"].high < 0
    assert {x.d_ap for x in bootstrap.paired(df, "c", "y", "a", "a", 5).collect()} == {0.0}
    none = bootstrap.average_precision(df.withColumn("y", df["y"] * 0), "c", "y", "a", 3).collect()
    assert {x.ap for x in none} == {None}
