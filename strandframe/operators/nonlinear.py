"""Nonlinear least squares by aggregation: a step is one pass that sums residuals and products of partial derivatives."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[Column, Sequence[Column]], tuple[Column, list[Column]]]
#: Fits that run side by side at most: their parameters pass through the driver in every step.
MOST = 10_000


def saturating(x: Column, p: Sequence[Column]) -> tuple[Column, list[Column]]:
    """v x / (k + x)."""
    v, k = p
    return v * x / (k + x), [x / (k + x), -v * x / ((k + x) * (k + x))]


def saturating_with_slope(x: Column, p: Sequence[Column]) -> tuple[Column, list[Column]]:
    """a x + v x / (k + x)."""
    a, v, k = p
    return a * x + v * x / (k + x), [x, x / (k + x), -v * x / ((k + x) * (k + x))]


def saturating_power(x: Column, p: Sequence[Column]) -> tuple[Column, list[Column]]:
    """a + g x - log10(1 + 10 ^ (g (x - k))), on logarithms: a power law that levels off at k."""
    a, g, k = p
    u = g * (x - k)
    over = F.greatest(u, F.lit(0.0)) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(u)))
    share = 1 / (1 + F.pow(F.lit(10.0), F.greatest(-u, F.lit(-300.0))))
    return a + g * x - over, [F.lit(1.0), x - (x - k) * share, g * share]


def _step(jtj: np.ndarray, jtr: np.ndarray, at: np.ndarray, damp: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The damped step, within bounds: parameters at a bound that would leave it stay there."""
    free = ~(((at <= low) & (jtr < 0)) | ((at >= high) & (jtr > 0)))
    new = at.copy()
    if free.any():
        left = jtj[np.ix_(free, free)]
        scale = np.sqrt(np.where(np.diag(left) > 0, np.diag(left), 1.0))
        step = np.linalg.lstsq(left / np.outer(scale, scale) + damp * np.eye(len(scale)), jtr[free] / scale, rcond=None)[0] / scale
        new[free] += step
    return np.clip(new, low, high)


def fit(df: DataFrame, x: str, y: str, model: Model, start: Sequence[float], keys: Sequence[str] = (), bounds: tuple[Sequence[float], Sequence[float]] | None = None, steps: int = 100, tolerance: float = 1e-12) -> DataFrame:
    """(keys, n, parameters, rss, steps, status) of y against a model of x, for every key, from one start.

    status is converged, out_of_steps, or too_few_rows where there are not more rows than parameters. Rows with a null or
    non-finite number take no part. Each step joins the keys' trial parameters to the rows and takes one aggregation with
    map-side partial sums; a trial that does not lower the residual is taken back and damped more. Parameters, and
    nothing else, pass through the driver: more than MOST keys are an error.
    """
    spark, m = df.sparkSession, len(start)
    low, high = (np.array(b, float) for b in (bounds or ([-np.inf] * m, [np.inf] * m)))
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    rows = df.where(fine(x) & fine(y)).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    found = rows.groupBy(*keys).agg(F.count("*").alias("n")).limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} fits")
    sizes = {tuple(r[k] for k in keys): r.n for r in found if r.n}
    state = {k: {"at": None, "trial": np.clip(np.array(start, float), low, high), "damp": 1e-3, "cost": np.inf, "jtj": None, "jtr": None, "steps": 0, "status": "out_of_steps"} for k, n in sizes.items() if n > m}
    live = set(state)
    upper = [(i, j) for i in range(m) for j in range(i, m)]
    for _ in range(steps):
        if not live:
            break
        trials = spark.createDataFrame([(*k, state[k]["trial"].tolist()) for k in live], ", ".join([*kinds, "_p array<double>"]))
        joined = rows.join(F.broadcast(trials), [rows[k].eqNullSafe(trials[k]) for k in keys]) if keys else rows.crossJoin(F.broadcast(trials))  # MOST rows
        picked = joined.select(*[rows[k] for k in keys], "_x", "_y", "_p")
        value, parts = model(F.col("_x"), [F.get("_p", F.lit(i)) for i in range(m)])
        terms = picked.select(*keys, (F.col("_y") - value).alias("_r"), *[d.alias(f"_d{i}") for i, d in enumerate(parts)])
        sums = [F.sum(F.col("_r") * F.col("_r")), *[F.sum(F.col("_r") * F.col(f"_d{i}")) for i in range(m)], *[F.sum(F.col(f"_d{i}") * F.col(f"_d{j}")) for i, j in upper]]
        for row in terms.groupBy(*keys).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).collect():
            s, v = state[tuple(row[k] for k in keys)], [np.nan if row[f"s{i}"] is None else row[f"s{i}"] for i in range(len(sums))]
            s["steps"] += 1
            if np.isfinite(v).all() and v[0] < s["cost"]:
                gain, moved = s["cost"] - v[0], s["at"] is None or np.abs(s["trial"] - s["at"]).max() > 0
                s["at"], s["jtr"] = s["trial"], np.array(v[1 : 1 + m])
                s["jtj"] = np.zeros((m, m))
                for (i, j), w in zip(upper, v[1 + m :], strict=True):
                    s["jtj"][i, j] = s["jtj"][j, i] = w
                done = not moved or gain <= tolerance * max(v[0], 1e-300)
                s["cost"], s["damp"] = v[0], max(s["damp"] / 5, 1e-12)
            else:
                s["damp"] *= 8
                done = s["at"] is not None and s["damp"] > 1e12
            if s["at"] is None:
                s["status"] = "no_finite_start"
                live.discard(tuple(row[k] for k in keys))
                continue
            s["trial"] = _step(s["jtj"], s["jtr"], s["at"], s["damp"], low, high)
            if done or s["cost"] == 0 or np.array_equal(s["trial"], s["at"]):
                s["status"] = "converged"
                live.discard(tuple(row[k] for k in keys))
    out = [(*k, n, state[k]["at"].tolist(), float(state[k]["cost"]), state[k]["steps"], state[k]["status"]) if k in state and state[k]["at"] is not None else (*k, n, None, None, 0, state[k]["status"] if k in state else "too_few_rows") for k, n in sizes.items()]
    return spark.createDataFrame(out, ", ".join([*kinds, "n long, parameters array<double>, rss double, steps int, status string"]))
