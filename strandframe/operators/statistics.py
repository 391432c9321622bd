"""Estimators: quantiles, regressions from sums, resampling, multiplicity.

Regressions are computed from sufficient sums, so a fit is one aggregation with a map-side partial sum, and leaving a
unit out is a subtraction. Resampling is relational: replicate x draw rows pick blocks through a counter-mode digest.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strandframe.operators._folders import shared_folder

Z95 = 1.959963984540054


def quantile_linear(value: str | Column, p: float) -> Column:
    """Rank (n - 1) p, linear between neighbours. It holds a group's distinct values; `quantiles_linear` does not."""
    return F.percentile(F.col(value) if isinstance(value, str) else value, p)


def quantiles_linear(df: DataFrame, value: str, wanted: dict[str, float], keys: Sequence[str]) -> DataFrame:
    """(keys, a column for each name in wanted): quantile_linear at these p, null for a group without values.

    Values are counted, dealt in ranges and stored; a range's own counts start after those of the ranges before it, and
    only ranges that hold a wanted rank are looked at, so neither a group nor its distinct values need fit in one task.
    """
    spark = df.sparkSession
    shared_folder(spark)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    dealt = counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "_v").withColumn("_part", F.spark_partition_id()).checkpoint()
    by = Window.partitionBy(*keys).orderBy("_part")
    ranges = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_size")).withColumns({"_end": F.sum("_size").over(by), "_all": F.sum("_size").over(Window.partitionBy(*keys))})
    ranges = ranges.withColumn("_start", F.col("_end") - F.col("_size"))
    ranks = {name: (F.col("_all") - 1) * F.lit(float(p)) for name, p in wanted.items()}
    ends = [f(rank).cast("long") for rank in ranks.values() for f in (F.floor, F.ceil)]
    hit = F.lit(False)
    for at in ends:
        hit |= (at >= F.col("_start")) & (at < F.col("_end"))
    named = [F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]
    few = ranges.where(hit).select(*named, F.col("_part").alias("_of"), "_start", "_all")
    met = dealt.join(few, [F.col("_part") == F.col("_of"), *(F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys))])
    met = met.withColumn("_to", F.col("_start") + F.sum("_n").over(Window.partitionBy("_part", *keys).orderBy("_v"))).withColumn("_from", F.col("_to") - F.col("_n"))
    one = lambda at: F.max(F.when((at >= F.col("_from")) & (at < F.col("_to")), F.col("_v")))
    found = met.groupBy(*keys).agg(F.max("_all").alias("_all"), *[one(at).alias(f"_{i}") for i, at in enumerate(ends)])
    out = {}
    for i, (name, rank) in enumerate(ranks.items()):
        a, b = F.col(f"_{2 * i}"), F.col(f"_{2 * i + 1}")
        out[name] = F.when(a == b, a).otherwise((F.ceil(rank) - rank) * a + (rank - F.floor(rank)) * b)
    empty = df.select(*keys).distinct().select(*named)
    result = found.select(*keys, *[c.alias(name) for name, c in out.items()])
    on = [F.col(f"_key_{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    return empty.join(result, on, "left").select(*[F.col(f"_key_{i}").alias(k) for i, k in enumerate(keys)], *wanted)


def _sorted(value: str) -> Column:
    return F.array_sort(F.filter(F.collect_list(value), lambda v: ~F.isnan(v)))


def quantile_nearest(value: str, p: float) -> Column:
    """The value at index round((n - 1) p), half to even. For groups of bounded size: it holds a group's values."""
    v = _sorted(value)
    return F.when(F.size(v) > 0, F.element_at(v, (F.bround((F.size(v) - 1) * F.lit(p)) + 1).cast("int")))


def quantile_outer(value: str, p: float, low: bool) -> Column:
    """The order statistic at floor (low) or ceil of p (n - 1). For groups of bounded size."""
    v = _sorted(value)
    at = F.floor((F.size(v) - 1) * F.lit(p)) if low else F.ceil((F.size(v) - 1) * F.lit(p))
    return F.when(F.size(v) > 0, F.element_at(v, (at + 1).cast("int")))


def tertiles(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with stratum low, middle, high or unknown by the sorted values at n // 3 - 1 and 2 n // 3 - 1."""
    v = F.array_sort(F.collect_list(value))
    cuts = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(v.alias("_v")).where("size(_v) > 0")
    at = lambda k: F.element_at("_v", (F.floor(F.size("_v") * k / 3)).cast("int"))
    cuts = cuts.select(*keys, F.when(F.size("_v") >= 3, at(1)).otherwise(F.element_at("_v", -1)).alias("_t1"), F.when(F.size("_v") >= 2, at(2)).otherwise(F.element_at("_v", -1)).alias("_t2"))
    joined = df.join(cuts, list(keys), "left") if keys else df.crossJoin(F.broadcast(cuts))  # one row
    return joined.withColumn("stratum", F.when(F.col(value).isNull(), "unknown").when(F.col(value) <= F.col("_t1"), "low").when(F.col(value) <= F.col("_t2"), "middle").otherwise("high")).drop("_t1", "_t2")


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """95 % score interval of a proportion, within 0 and 1; null without trials."""
    p, n = successes / total, total
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


def tukey_outliers(df: DataFrame, value: str, keys: Sequence[str], log10: bool = True, least: int = 4) -> DataFrame:
    """Rows beyond 1.5 interquartile ranges of their group, on a log scale; groups under `least` rows have none."""
    x = F.log10(F.col(value)) if log10 else F.col(value)
    fences = df.withColumn("_x", x).groupBy(*keys).agg(F.percentile("_x", F.lit(0.25)).alias("_q1"), F.percentile("_x", F.lit(0.75)).alias("_q3"), F.count("_x").alias("_n")).where(f"_n >= {least}")
    joined = df.withColumn("_x", x).join(fences, list(keys))
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    return joined.where((F.col("_x") < F.col("_q1") - reach) | (F.col("_x") > F.col("_q3") + reach)).drop("_x", "_q1", "_q3", "_n")


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Normal two-sided p of a z value; none for null, and 0 for an infinite one."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else None)


def _complete(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) != float("inf"))
    return df.where(fine(x) & fine(y)).withColumns({x: F.col(x).cast("double"), y: F.col(y).cast("double")})


def sums(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sufficient sums of a straight line per group."""
    a, b = F.col(x), F.col(y)
    return _complete(df, x, y, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"), F.sum(b * b).alias("syy"))


def _line(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column, syy: Column, df_used: Column) -> dict[str, Column]:
    cxx, cxy, cyy = sxx - sx * sx / n, sxy - sx * sy / n, syy - sy * sy / n
    slope = F.when(cxx > 0, cxy / cxx)
    rss = F.greatest(F.lit(0.0), cyy - slope * cxy)
    return {"slope": slope, "rss": rss, "cxx": cxx, "cyy": cyy, "se": F.sqrt(rss / (n - df_used) / cxx)}


def ols(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, effect, intercept, r2, se, z): a straight line per group; groups under three complete rows have none."""
    s = sums(df, x, y, keys).where("n >= 3")
    c = {k: F.col(k) for k in ("n", "sx", "sy", "sxx", "sxy", "syy")}
    fit = _line(*c.values(), F.lit(2))
    out = s.select(*keys, "n", fit["slope"].alias("effect"), ((c["sy"] - fit["slope"] * c["sx"]) / c["n"]).alias("intercept"), F.when(fit["cyy"] > 0, 1 - fit["rss"] / fit["cyy"]).otherwise(1.0).alias("r2"), fit["se"].alias("se"))
    return out.where("effect is not null").withColumn("z", F.col("effect") / F.col("se"))


def ols_fixed_effects(df: DataFrame, x: str, y: str, level: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, levels, effect, r2, se, z): one slope with an intercept per level, from within-level sums.

    A missing level is the level 'unclassified'. R squared is against the overall mean, as in a dummy regression.
    """
    named = df.withColumn(level, F.coalesce(F.col(level).cast("string"), F.lit("unclassified")))
    s = sums(named, x, y, [*keys, level])
    within = lambda a, b, ab: F.sum(F.col(ab) - F.col(a) * F.col(b) / F.col("n"))
    t = s.groupBy(*keys).agg(F.sum("n").alias("N"), F.count("*").alias("levels"), within("sx", "sx", "sxx").alias("cxx"), within("sx", "sy", "sxy").alias("cxy"), within("sy", "sy", "syy").alias("cyy"), F.sum("sy").alias("ty"), F.sum("syy").alias("tyy"))
    rss = F.greatest(F.lit(0.0), F.col("cyy") - F.col("cxy") * F.col("cxy") / F.col("cxx"))
    total = F.col("tyy") - F.col("ty") * F.col("ty") / F.col("N")
    out = t.where("N > levels + 1 and cxx > 0").select(*keys, F.col("N").alias("n"), "levels", (F.col("cxy") / F.col("cxx")).alias("effect"), F.when(total > 0, 1 - rss / total).otherwise(1.0).alias("r2"), F.sqrt(rss / (F.col("N") - F.col("levels") - 1) / F.col("cxx")).alias("se"))
    return out.withColumn("z", F.col("effect") / F.col("se"))


def quadratic(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, intercept, linear, quadratic, r2): y on centred x and its square; five complete rows at least."""
    done = _complete(df, x, y, keys)
    middle = done.groupBy(*keys).agg(F.avg(x).alias("_m"))
    joined = done.join(middle, list(keys)) if keys else done.crossJoin(F.broadcast(middle))  # one row
    u, v = F.col(x) - F.col("_m"), F.col(y)
    s = joined.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(u * u).alias("s2"), F.sum(u * u * u).alias("s3"), F.sum(u * u * u * u).alias("s4"), F.sum(v).alias("t0"), F.sum(u * v).alias("t1"), F.sum(u * u * v).alias("t2"), F.sum(v * v).alias("vv")).where("n >= 5")
    n, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n", "s2", "s3", "s4", "t0", "t1", "t2"))
    # normal equations with sum(u) = 0
    a, b, d = s4 - s2 * s2 / n, s3, s2
    e, f = t2 - s2 * t0 / n, t1
    det = a * d - b * b
    q, lin = (e * d - b * f) / det, (a * f - b * e) / det
    icept = (t0 - q * s2) / n
    rss = F.col("vv") - icept * t0 - lin * t1 - q * t2
    tss = F.col("vv") - t0 * t0 / n
    return s.where(det > 0).select(*keys, "n", icept.alias("intercept"), lin.alias("linear"), q.alias("quadratic"), F.when(tss > 0, 1 - rss / tss).otherwise(1.0).alias("r2"))


def leave_one_out(df: DataFrame, x: str, y: str, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, min_effect, max_effect) over fits that leave out one unit each; fits that fail are skipped."""
    per = sums(df, x, y, [*keys, unit])
    names = ("n", "sx", "sy", "sxx", "sxy", "syy")
    whole = per.groupBy(*keys).agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    joined = per.join(whole, list(keys)) if keys else per.crossJoin(F.broadcast(whole))  # one row
    rest = {c: F.col(f"t_{c}") - F.col(c) for c in names}
    fit = _line(*rest.values(), F.lit(2))
    fits = joined.where(rest["n"] >= 3).select(*keys, fit["slope"].alias("effect")).where("effect is not null")
    return fits.groupBy(*keys).agg(F.count("*").alias("n"), F.min("effect").alias("min_effect"), F.max("effect").alias("max_effect"))


def with_enough(df: DataFrame, level: str, value: str, least: int = 8) -> DataFrame:
    """Rows of levels with at least `least` finite values."""
    fine = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(level).count().where(f"count >= {least}").select(level)
    return df.join(fine, level, "left_semi")


def benjamini_hochberg(df: DataFrame, p: str, families: Sequence[str], into: str = "q") -> DataFrame:
    """df with adjusted p values per family: running minimum of p m / rank from the largest p down, at most 1."""
    by = Window.partitionBy(*families)
    known = F.when(F.col(p).isNotNull(), F.col(p))
    ranked = df.withColumn("_m", F.count(known).over(by)).withColumn("_rank", F.row_number().over(by.orderBy(F.col(p).asc_nulls_last())))
    raw = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * F.col("_m") / F.col("_rank")))
    down = by.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("_raw", raw).withColumn(into, F.when(F.col(p).isNotNull(), F.min("_raw").over(down))).drop("_m", "_rank", "_raw")


def average_rank(df: DataFrame, value: str, into: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with ranks from 1, ties at their mean. Distinct values are counted first, so ties cost one row."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    by = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn(into, F.coalesce(F.sum("_c").over(by), F.lit(0)) + (F.col("_c") + 1) / 2).drop("_c")
    return df.join(ranks, [*keys, value])


def correlations(df: DataFrame, x: str, y: str, control: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, pearson, spearman and, given a control, partial)."""
    done = _complete(df, x, y, keys)
    both = average_rank(average_rank(done, x, "_rx", keys), y, "_ry", keys)
    aggs = [F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman")]
    if control:
        aggs += [F.corr(x, control).alias("_xc"), F.corr(y, control).alias("_yc")]
    out = both.groupBy(*keys).agg(*aggs)
    if control:
        partial = (F.col("pearson") - F.col("_xc") * F.col("_yc")) / F.sqrt((1 - F.col("_xc") ** 2) * (1 - F.col("_yc") ** 2))
        out = out.withColumn("partial", partial).drop("_xc", "_yc")
    return out


def jackknife(df: DataFrame, value: str, point: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, standard_error, low, high) from estimates that each leave out one unit; the lower end is at least 0."""
    t = df.groupBy(*keys).agg(F.count(value).alias("n"), F.var_pop(value).alias("_v"), F.first(point).alias("_p")).where("n >= 2")
    se = F.sqrt((F.col("n") - 1) * F.col("_v"))
    return t.select(*keys, "n", se.alias("standard_error"), F.greatest(F.lit(0.0), F.col("_p") - Z95 * se).alias("low"), (F.col("_p") + Z95 * se).alias("high"))


def seed_digest(policy: str, dataset: str, statistic: str) -> Column:
    """Hex SHA-256 of the three names joined by NUL."""
    return F.sha2(F.lit(f"{policy}\0{dataset}\0{statistic}"), 256)


def counter_index(seed_hex: Column, replicate: Column, contig: Column, draw: Column, upper: Column) -> Column:
    """A number below `upper`: the first 8 bytes of SHA-256 over seed, replicate, contig length, contig and draw."""
    fixed = lambda v, n: F.unhex(F.lpad(F.hex(v.cast("long")), 2 * n, "0"))
    name = F.encode(contig, "UTF-8")
    payload = F.concat(F.unhex(seed_hex), fixed(replicate, 8), fixed(F.octet_length(contig), 4), name, fixed(draw, 8))
    number = F.conv(F.substring(F.sha2(payload, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (number % upper.cast("decimal(20,0)")).cast("long")


def block_bootstrap(blocks: DataFrame, policy: str, dataset: str, statistic: str, replicates: int, numerator: str = "num", denominator: str = "den", least: int = 20) -> DataFrame:
    """(blocks, low, high): contig-stratified block bootstrap of a ratio of sums, percentile interval.

    blocks has contig, block and the two sums; blocks without denominator do not take part, fewer than `least` give
    null ends. Draws are rows: replicate x contig x draw, joined to the blocks by (contig, index).
    """
    spark = blocks.sparkSession
    kept = blocks.where(F.col(denominator) > 0).withColumn("contig", F.col("contig").cast("string"))
    at = F.row_number().over(Window.partitionBy("contig").orderBy("block")) - 1
    indexed = kept.withColumn("_i", at.cast("long"))
    sizes = indexed.groupBy("contig").agg(F.count("*").alias("_n"))
    seed = F.substring(seed_digest(policy, dataset, statistic), 1, 16)
    draws = sizes.withColumn("_draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).crossJoin(F.broadcast(spark.range(replicates).withColumnRenamed("id", "_rep")))  # `replicates` rows
    draws = draws.withColumn("_i", counter_index(seed, F.col("_rep"), F.col("contig"), F.col("_draw"), F.col("_n")))
    sums_ = draws.join(indexed.select("contig", "_i", numerator, denominator), ["contig", "_i"]).groupBy("_rep").agg(F.sum(numerator).alias("_num"), F.sum(denominator).alias("_den"))
    ends = sums_.withColumn("_e", F.col("_num") / F.col("_den")).agg(F.percentile("_e", 0.025).alias("low"), F.percentile("_e", 0.975).alias("high"))
    n = indexed.agg(F.count("*").alias("blocks"))
    enough = F.col("blocks") >= least
    return n.crossJoin(F.broadcast(ends)).select("blocks", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))


def ratio_of_marginals(s: Column, s_low: Column, s_high: Column, w: Column, w_low: Column, w_high: Column) -> tuple[Column, Column, Column]:
    """Ratio with its widest bounds from both intervals; null where a divisor is not positive."""
    over = lambda a, b: F.when(b > 0, a / b)
    return over(s, w), over(s_low, w_high), over(s_high, w_low)


def aic(rss: Column, n: Column, parameters: int) -> Column:
    """n log(rss / n^2) + 2 (parameters + 1): the sum of squares is divided by n twice; differences are unaffected."""
    return n * F.log(rss / n / n) + 2 * (parameters + 1)


def power_law(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """y = exp(intercept) x ^ effect, by a line on logarithms of positive values."""
    logs = df.where((F.col(x) > 0) & (F.col(y) > 0)).withColumns({x: F.log(x), y: F.log(y)})
    return ols(logs, x, y, keys)


def michaelis_menten(df: DataFrame, x: str, y: str, keys: Sequence[str], steps: int = 60) -> DataFrame:
    """(keys, a, b, rss) of y = a x / (b + x) by damped least squares on each group, which must fit in a task."""
    import numpy as np

    names = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        u, v = group[x].to_numpy(float), group[y].to_numpy(float)
        a, b, damp = float(v.max()), float(np.median(u)), 1e-2
        cost = lambda p: float(((v - p[0] * u / (p[1] + u)) ** 2).sum())
        now = cost((a, b))
        for _ in range(steps):
            part = np.stack([u / (b + u), -a * u / (b + u) ** 2], 1)
            left = part.T @ part
            step = np.linalg.lstsq(left + damp * np.diag(np.diag(left) + 1e-12), part.T @ (v - a * u / (b + u)), rcond=None)[0]
            new = cost((a + step[0], b + step[1])) if b + step[1] > 0 else np.inf
            if new < now:
                a, b, now, damp = a + step[0], b + step[1], new, damp / 3
            else:
                damp *= 4
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), a, b, now]], columns=[*keys, "a", "b", "rss"])

    return df.select(*keys, x, y).groupBy(*keys).applyInPandas(fit, f"{names}, a double, b double, rss double")


def split_half_slopes(df: DataFrame, x: str, y: str) -> DataFrame:
    """(half, n, slope): straight lines below and from the mean x on."""
    middle = df.agg(F.avg(x).alias("_m"))
    halves = df.crossJoin(F.broadcast(middle)).withColumn("half", F.when(F.col(x) < F.col("_m"), "low").otherwise("high"))  # one row
    return ols(halves, x, y, ["half"]).select("half", "n", F.col("effect").alias("slope"))
