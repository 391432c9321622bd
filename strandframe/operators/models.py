"""Linear models with several numeric terms and factors, from a Gram matrix over sparse dummies, and their bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.operators._folders import shared_folder
from strandframe.operators.resampling import PcgDraws, numbered

ONE, Y = "1", "y"
#: A column is redundant if what the others leave of it is a smaller share of its square sum.
TOLERANCE = 1e-10
#: Columns of a model at most: its Gram matrix is solved in one task.
WIDEST = 4000


def complete(df: DataFrame, y: str, numerics: Sequence[str], factors: Sequence[str]) -> DataFrame:
    """Rows with finite numbers, as doubles; a missing level is 'unclassified'."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    rows = df
    for c in (y, *numerics):
        rows = rows.where(fine(c))
    return rows.withColumns({c: F.col(c).cast("double") for c in (y, *numerics)} | {f: F.coalesce(F.col(f).cast("string"), F.lit("unclassified")) for f in factors})


def centred(rows: DataFrame, names: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with these columns less their means, the means): one row of means for each of the keys."""
    means = rows.groupBy(*keys).agg(*[F.avg(c).alias(f"_mean_{i}") for i, c in enumerate(names)])
    joined = rows.join(means, list(keys)) if keys else rows.crossJoin(F.broadcast(means))  # one row
    return joined.withColumns({c: F.col(c) - F.col(f"_mean_{i}") for i, c in enumerate(names)}).drop(*[f"_mean_{i}" for i in range(len(names))]), means


def gram(rows: DataFrame, y: str, numerics: Sequence[str], factors: Sequence[str], keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """(keys, a, b, v): sums of products of the design's columns, once for each pair.

    Rows are summed by their levels first, with partial sums where they lie, and only these cells are spread over the
    pairs of columns that are not zero in them: the numbers, and one dummy for each factor.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    base = {ONE: F.lit(1.0), **{f"x{i}": F.col(c) for i, c in enumerate(numerics)}, Y: F.col(y)}
    names = list(base)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    cells = rows.groupBy(*keys, *factors).agg(*[F.sum(w * base[a] * base[b]).alias(f"_{a}_{b}") for a, b in pairs])
    dummy = [F.concat(F.lit(f"f{k}:"), F.col(f)) for k, f in enumerate(factors)]
    entry = lambda a, b, v: F.struct(a.alias("a"), b.alias("b"), F.col(v).alias("v"))
    parts = [entry(F.lit(a), F.lit(b), f"_{a}_{b}") for a, b in pairs]
    parts += [entry(d, F.lit(b), f"_{ONE}_{b}") for d in dummy for b in names]
    parts += [entry(d, e, f"_{ONE}_{ONE}") for i, d in enumerate(dummy) for e in dummy[i:]]
    return cells.select(*keys, F.explode(F.array(*parts)).alias("_e")).groupBy(*keys, "_e.a", "_e.b").agg(F.sum("_e.v").alias("v"))


def solve(entries: dict[tuple[str, str], float], numerics: int, least: int, effect_of: int) -> dict:
    """A model's figures from its Gram entries: pivoted Cholesky of the scaled matrix tells the rank, then solves it."""
    n = round(entries.get((ONE, ONE), 0.0))
    levels = sorted({a for a, _ in entries if a.startswith("f")}, key=lambda a: (int(a[1 : a.index(":")]), a[a.index(":") + 1 :]))
    firsts = {a[: a.index(":")]: a for a in reversed(levels)}  # the first level of each factor has no column
    names = [ONE, *(f"x{i}" for i in range(numerics)), *(a for a in levels if firsts[a[: a.index(":")]] != a)]
    p = len(names)
    out = {"n": n, "columns": p, "rank": None, "effect": None, "se": None, "z": None, "offset": None, "coefficients": None, "r2": None}
    if n < least:
        return out | {"status": "too_few_rows"}
    if n <= p:
        return out | {"status": "no_residual_freedom"}
    if p > WIDEST:
        raise ValueError(f"{p} columns, over {WIDEST}")
    of = lambda a, b: entries.get((a, b), entries.get((b, a), 0.0))
    g, t = np.array([[of(a, b) for b in names] for a in names]), np.array([of(a, Y) for a in names])
    scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
    m = g / np.outer(scale, scale)
    low, left, order = np.zeros((p, p)), np.diag(m).copy(), np.arange(p)
    rank = p
    for k in range(p):
        best = k + int(left[k:].argmax())
        if left[best] <= TOLERANCE:
            rank = k
            break
        for x in (left, order):
            x[[k, best]] = x[[best, k]]
        low[[k, best]] = low[[best, k]]
        low[k, k] = np.sqrt(left[k])
        rest = slice(k + 1, p)
        low[rest, k] = (m[order[rest], order[k]] - low[rest, :k] @ low[k, :k]) / low[k, k]
        left[rest] -= low[rest, k] ** 2
    out["rank"] = rank
    if rank < p:
        return out | {"status": "rank_deficient"}
    inverse = np.empty((p, p))
    half = np.linalg.inv(low)
    inverse[np.ix_(order, order)] = half.T @ half
    inverse /= np.outer(scale, scale)
    coef = inverse @ t
    coef += inverse @ (t - g @ coef)  # one refinement
    total = of(Y, Y) - of(ONE, Y) ** 2 / n
    rss = max(0.0, of(Y, Y) - float(coef @ t))
    rss = 0.0 if rss <= 1e-14 * of(Y, Y) else rss
    k = 1 + effect_of
    se = float(np.sqrt(max(0.0, rss / (n - p) * inverse[k, k])))
    effect = float(coef[k])
    z = effect / se if se else (np.inf if effect else 0.0)
    return out | {"effect": effect, "se": se, "z": z, "offset": float(coef[0]), "coefficients": coef[1 : 1 + numerics].tolist(), "r2": 1 - rss / total if total > 0 else 1.0, "status": "ok"}


def solved(entries: DataFrame, numerics: int, keys: Sequence[str], least: int, effect_of: int) -> DataFrame:
    """(keys, n, columns, rank, effect, se, z, offset, coefficients, r2, status) of the models of a Gram table."""
    kinds = {k: entries.schema[k].dataType.simpleString() for k in keys}
    names = ["n", "columns", "rank", "effect", "se", "z", "offset", "coefficients", "r2", "status"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        got = solve(dict(zip(zip(group["a"], group["b"], strict=True), group["v"], strict=True)), numerics, least, effect_of)
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), *(got[c] for c in names)]], columns=[*keys, *names])

    schema = ", ".join([*(f"`{k}` {t}" for k, t in kinds.items()), "n long, columns int, rank int, effect double, se double, z double, offset double, coefficients array<double>, r2 double, status string"])
    return entries.groupBy(*keys).applyInPandas(run, schema)


def factor_model(df: DataFrame, y: str, numerics: Sequence[str], factors: Sequence[str] = (), keys: Sequence[str] = (), least: int = 3, effect_of: int = 0) -> DataFrame:
    """(keys, n, columns, rank, effect, se, z, intercept, r2, status): y on an intercept, numbers and factors.

    A factor has a dummy for every level but its first; effect is the coefficient of numerics[effect_of]. Status is ok,
    too_few_rows, no_residual_freedom (not more rows than columns) or rank_deficient; but for ok there are no figures.
    Incomplete rows take no part; missing levels are the level 'unclassified'. One pass for the means, one aggregation
    for the Gram matrix; columns grow with the levels and may be WIDEST.
    """
    rows, means = centred(complete(df, y, numerics, factors), [y, *numerics], keys)
    out = solved(gram(rows, y, numerics, factors, keys), len(numerics), keys, least, effect_of)
    joined = out.join(means, list(keys)) if keys else out.crossJoin(F.broadcast(means))  # one row
    shift = sum((F.col(f"_mean_{i + 1}") * F.element_at("coefficients", i + 1) for i in range(len(numerics))), F.lit(0.0))
    return joined.select(*keys, "n", "columns", "rank", "effect", "se", "z", (F.col("_mean_0") + F.col("offset") - shift).alias("intercept"), "r2", "status")


def with_square(df: DataFrame, x: str, y: str, factors: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """The complete rows with _linear, x less its mean, and _square, its square."""
    rows, _ = centred(complete(df, y, [x], factors), [x], keys)
    return rows.withColumn("_linear", F.col(x)).withColumn("_square", F.col(x) * F.col(x))


def quadratic_model(df: DataFrame, x: str, y: str, factors: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """factor_model of y on x, centred on its mean, and its square, whose coefficient is the effect; five rows at least."""
    return factor_model(with_square(df, x, y, factors, keys), y, ["_linear", "_square"], factors, keys, least=5, effect_of=1)


def stratified_bootstrap(df: DataFrame, y: str, numerics: Sequence[str], factors: Sequence[str], order: Sequence[str], seed: int, replicates: int, least: int = 3, effect_of: int = 0) -> DataFrame:
    """(replicate, n, effect, status) of models on rows drawn with replacement within each level of the first factor.

    Draw for draw the PCG64 stream of the seed: replicate by replicate, level by level in sorted order, as many numbers
    as the level has rows, which are taken in this order (a unique one, else equal rows are numbered as they come). All
    rows are one stratum without a factor. Means are those of all rows, which changes no effect. Levels are listed on
    the driver, rows and draws are not.
    """
    spark = df.sparkSession
    shared_folder(spark)
    rows, _ = centred(complete(df, y, numerics, factors), [y, *numerics], [])
    stratum = F.col(factors[0]) if factors else F.lit("")
    known = rows.select(*dict.fromkeys([*factors, *order, *numerics, y]), stratum.alias("_stratum"))
    placed = numbered(known, ["_stratum"], order, "number").checkpoint()
    levels = sorted((r._stratum, r.n) for r in placed.groupBy("_stratum").agg(F.count("*").alias("n")).collect())
    draws = PcgDraws.of(spark, seed, [n for _, n in levels], replicates)
    named = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(levels)], "stratum int, _stratum string")
    drawn = draws.weights(spark).join(F.broadcast(named), "stratum")  # a row a level
    both = drawn.join(placed, ["_stratum", "number"])
    return solved(gram(both, y, numerics, factors, ["replicate"], F.col("weight")), len(numerics), ["replicate"], least, effect_of).select("replicate", "n", "effect", "status")


def bootstrap_interval(effects: DataFrame) -> DataFrame:
    """One row (replicates, skipped, ci_low, ci_high): percentiles of the effects that could be fitted."""
    return effects.agg(F.count("*").alias("replicates"), F.count_if(F.col("status") != "ok").alias("skipped"), F.percentile("effect", F.lit(0.025)).alias("ci_low"), F.percentile("effect", F.lit(0.975)).alias("ci_high"))
