"""Saturation models: parameters come back, bounds hold."""

import numpy as np
import pytest

from strandframe.operators import nonlinear as nl


def rows(f, xs, key="a"):
    return [(key, float(x), float(f(x))) for x in xs]


def frame(spark, data):
    return spark.createDataFrame(data, "k string, x double, y double").repartition(3)


def test_parameters_are_recovered_for_each_key(spark):
    xs = 10.0 ** np.linspace(3, 9, 60)
    data = rows(lambda x: 0.02 * x / (5e6 + x), xs, "a") + rows(lambda x: 0.013 * x / (2e5 + x), xs, "b") + rows(lambda x: x, xs[:2], "few")
    got = {r.k: r for r in nl.fit(frame(spark, [*data, ("a", None, 1.0), ("a", 1.0, float("nan"))]), "x", "y", nl.saturating, [0.01, 1e6], ["k"]).collect()}
    assert got["a"].parameters == pytest.approx([0.02, 5e6], rel=1e-6) and got["b"].parameters == pytest.approx([0.013, 2e5], rel=1e-6)
    assert (got["a"].n, got["a"].status, got["few"].status, got["few"].parameters) == (60, "converged", "too_few_rows", None)
    data = rows(lambda x: 2e-12 * x + 0.01 * x / (1e6 + x), xs)
    assert nl.fit(frame(spark, data), "x", "y", nl.saturating_with_slope, [1e-9, 0.01, 1e6]).first().parameters == pytest.approx([2e-12, 0.01, 1e6], rel=1e-4)


def test_bounds_hold_where_they_are_met(spark):
    xs = np.linspace(3, 14, 80)
    f = lambda a, g, k: lambda x: a + g * x - np.log10(1 + 10 ** (g * (x - k)))
    box = ([-12, 0, 2], [2, 2, 16])
    got = nl.fit(frame(spark, rows(f(-4.5, 0.3, 9.5), xs)), "x", "y", nl.saturating_power, [-4.0, 0.12, 9.0], (), box).first()
    assert got.parameters == pytest.approx([-4.5, 0.3, 9.5], rel=1e-4) and got.status == "converged"
    steep = nl.fit(frame(spark, rows(f(-9, 2.6, 7.0), xs)), "x", "y", nl.saturating_power, [-4.0, 0.12, 9.0], (), box).first()
    assert steep.parameters[1] == 2.0 and all(lo <= p <= hi for p, lo, hi in zip(steep.parameters, *box, strict=True)) and steep.rss > 0
    x, y = xs, f(-9, 2.6, 7.0)(xs)
    best = min(((y - f(a, 2.0, k)(x)) ** 2).sum() for a in np.linspace(-8, -6, 81) for k in np.linspace(6, 8, 81))
    assert steep.rss <= best + 1e-3


def test_no_rows_and_no_finite_start(spark):
    assert nl.fit(frame(spark, [("a", 1.0, 1.0)]).where("false"), "x", "y", nl.saturating, [1, 1], ["k"]).count() == 0
    bad = nl.fit(frame(spark, rows(lambda x: x, [1, 2, 3])), "x", "y", lambda x, p: (x / (p[0] - p[0]) if False else x * float("nan"), [x, x]), [1, 1]).first()
    assert bad.status == "no_finite_start" and bad.parameters is None
