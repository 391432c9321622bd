"""Queries of the estimators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators import models, nonlinear, reads, resampling
from strandframe.operators import statistics as st
from strandframe.plans._tables import read
from strandframe.plans.registry import register

_X = "o as (select o_orderpriority as level, o_custkey, o_orderkey, log10(o_orderkey) as x, log10(o_totalprice) as y from orders where o_orderkey > 0)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("level"), "o_custkey", "o_orderkey", F.log10(F.col("o_orderkey").cast("double")).alias("x"), F.log10("o_totalprice").alias("y")).where("x is not null")


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@register("stat_quantile_linear", "select l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 6) as low, round(quantile_cont(l_extendedprice, 0.5), 6) as middle, round(quantile_cont(l_extendedprice, 0.975), 6) as high from lineitem group by 1")
def quantile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    out = st.quantiles_linear(li, "l_extendedprice", {"low": 0.025, "middle": 0.5, "high": 0.975}, ["l_returnflag"])
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("low", "middle", "high")])


@register("stat_quantile_nearest", "with s as (select l_suppkey, list(l_extendedprice order by l_extendedprice) as v from lineitem group by 1) select l_suppkey, v[round_even((len(v) - 1) * 0.25, 0)::int + 1] as low, v[round_even((len(v) - 1) * 0.75, 0)::int + 1] as high from s")
def quantile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy("l_suppkey").agg(st.quantile_nearest("l_extendedprice", 0.25).alias("low"), st.quantile_nearest("l_extendedprice", 0.75).alias("high"))


@register("stat_quantile_outer", "with s as (select l_suppkey, list(l_extendedprice order by l_extendedprice) as v from lineitem group by 1) select l_suppkey, v[floor((len(v) - 1) * 0.025)::int + 1] as low, v[ceil((len(v) - 1) * 0.975)::int + 1] as high from s")
def quantile_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy("l_suppkey").agg(st.quantile_outer("l_extendedprice", 0.025, True).alias("low"), st.quantile_outer("l_extendedprice", 0.975, False).alias("high"))


@register("stat_tertile_strata", "with v as (select list(c_acctbal order by c_acctbal) as v from customer), c as (select v[len(v) // 3] as t1, v[2 * len(v) // 3] as t2 from v) select case when c_acctbal <= t1 then 'low' when c_acctbal <= t2 then 'middle' else 'high' end as stratum, count(*) as n, min(c_acctbal) as least from customer, c group by 1")
def tertile_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.tertiles(read(spark, sf_dir, "customer"), "c_acctbal").groupBy("stratum").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("least"))


_Z = "1.959963984540054"


@register("stat_wilson_interval", f"""with c as (select l_suppkey, count(*) filter (where l_returnflag = 'R') as k, count(*) as n from lineitem group by 1), p as (select *, k / n::double as p, {_Z} * {_Z} as zz from c)
select l_suppkey, round(greatest(0, ((p + zz / (2 * n)) - {_Z} * sqrt(p * (1 - p) / n + zz / (4.0 * n * n))) / (1 + zz / n)), 9) as low, round(least(1, ((p + zz / (2 * n)) + {_Z} * sqrt(p * (1 - p) / n + zz / (4.0 * n * n))) / (1 + zz / n)), 9) as high from p""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count("*").alias("n"))
    low, high = st.wilson(F.col("k"), F.col("n"))
    return c.select("l_suppkey", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@register("stat_tukey_outliers", "with x as (select o_orderkey, o_orderpriority, log10(o_totalprice) as x from orders), f as (select o_orderpriority, quantile_cont(x, 0.25) as a, quantile_cont(x, 0.75) as b from x group by 1 having count(*) >= 4) select o_orderkey, o_orderpriority from x join f using (o_orderpriority) where x < a - 1.5 * (b - a) or x > b + 1.5 * (b - a)")
def tukey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.tukey_outliers(read(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


@register("stat_ols", f"with {_X} select level, count(*) as n, round(regr_slope(y, x), 6) as effect, round(regr_intercept(y, x), 6) as intercept, round(regr_r2(y, x), 6) as r2 from o group by level")
def ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.ols(_orders(spark, sf_dir), "x", "y", ["level"]).select("level", "n", "effect", "intercept", "r2"), "effect", "intercept", "r2")


@register("stat_ols_fixed_effects", f"with {_X}, d as (select x - avg(x) over (partition by level) as u, y - avg(y) over (partition by level) as v, y - avg(y) over () as w, level from o) select count(*) as n, count(distinct level) as levels, round(sum(u * v) / sum(u * u), 6) as effect, round(1 - (sum(v * v) - sum(u * v) * sum(u * v) / sum(u * u)) / sum(w * w), 6) as r2 from d")
def ols_fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.ols_fixed_effects(_orders(spark, sf_dir), "x", "y", "level").select("n", "levels", "effect", "r2"), "effect", "r2")


@register("stat_quadratic", """with o as (select o_orderkey / 1000.0 as x, log10(o_totalprice) as y from orders), c as (select x - avg(x) over () as u, y as v from o),
s as (select count(*)::double as n, sum(u*u) as s2, sum(u*u*u) as s3, sum(u*u*u*u) as s4, sum(v) as t0, sum(u*v) as t1, sum(u*u*v) as t2 from c)
select n::bigint as n, round(((t2 - s2 * t0 / n) * s2 - s3 * t1) / ((s4 - s2 * s2 / n) * s2 - s3 * s3), 6) as quadratic, round(((s4 - s2 * s2 / n) * t1 - s3 * (t2 - s2 * t0 / n)) / ((s4 - s2 * s2 / n) * s2 - s3 * s3), 6) as linear from s""")
def quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select((F.col("o_orderkey") / 1000.0).alias("x"), F.log10("o_totalprice").alias("y"))
    return _rounded(st.quadratic(o, "x", "y").select("n", "quadratic", "linear"), "quadratic", "linear")


@register("stat_leave_one_out", f"""with {_X}, p as (select level, count(*)::double as n, sum(x) as sx, sum(y) as sy, sum(x*x) as sxx, sum(x*y) as sxy from o group by level), t as (select sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx, sum(sxy) as sxy from p),
r as (select t.n - p.n as n, t.sx - p.sx as sx, t.sy - p.sy as sy, t.sxx - p.sxx as sxx, t.sxy - p.sxy as sxy from p, t)
select count(*) as n, round(min((sxy - sx * sy / n) / (sxx - sx * sx / n)), 6) as min_effect, round(max((sxy - sx * sy / n) / (sxx - sx * sx / n)), 6) as max_effect from r""")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.leave_one_out(_orders(spark, sf_dir), "x", "y", "level"), "min_effect", "max_effect")


@register("stat_split_clades", "select o_custkey, count(*) as n from orders group by 1 having count(*) >= 16")
def split_clades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.with_enough(read(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 16).groupBy("o_custkey").agg(F.count("*").alias("n"))


@register("stat_benjamini_hochberg", """with p as (select c_custkey, c_mktsegment, ((c_custkey * 7919) % 10007) / 10007.0 as p from customer),
r as (select *, count(*) over (partition by c_mktsegment) as m, row_number() over (partition by c_mktsegment order by p) as k from p)
select c_custkey, round(min(least(1.0, p * m / k)) over (partition by c_mktsegment order by k desc rows unbounded preceding), 9) as q from r""")
def bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", ((F.col("c_custkey") * 7919) % 10007 / 10007.0).alias("p"))
    return st.benjamini_hochberg(c, "p", ["c_mktsegment"]).select("c_custkey", F.round("q", 9).alias("q"))


@register("stat_correlations", """with o as (select c_mktsegment, c_acctbal as x, (c_custkey % 100)::double as y, c_nationkey::double as z from customer),
r as (select *, avg(rx) over (partition by c_mktsegment, x) as ax, avg(ry) over (partition by c_mktsegment, y) as ay from (select *, row_number() over (partition by c_mktsegment order by x) as rx, row_number() over (partition by c_mktsegment order by y) as ry from o))
select c_mktsegment, count(*) as n, round(corr(x, y), 6) as pearson, round(corr(ax, ay), 6) as spearman, round((corr(x, y) - corr(x, z) * corr(y, z)) / sqrt((1 - corr(x, z) ** 2) * (1 - corr(y, z) ** 2)), 6) as partial from r group by c_mktsegment""")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"), F.col("c_nationkey").cast("double").alias("z"))
    return _rounded(st.correlations(c, "x", "y", "z", ["c_mktsegment"]), "pearson", "spearman", "partial")


@register("stat_jackknife", """with b as (select l_suppkey, count(*)::double as n, sum(l_quantity) as q from lineitem group by 1), t as (select sum(n) as n, sum(q) as q from b),
e as (select (t.q - b.q) / (t.n - b.n) as e, t.q / t.n as p from b, t)
select count(*) as n, round(sqrt((count(*) - 1) * var_pop(e)), 9) as standard_error, round(greatest(0, any_value(p) - 1.959963984540054 * sqrt((count(*) - 1) * var_pop(e))), 6) as low, round(any_value(p) + 1.959963984540054 * sqrt((count(*) - 1) * var_pop(e)), 6) as high from e""")
def jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    t = b.agg(F.sum("n").alias("tn"), F.sum("q").alias("tq"))
    e = b.crossJoin(F.broadcast(t)).select(((F.col("tq") - F.col("q")) / (F.col("tn") - F.col("n"))).alias("e"), (F.col("tq") / F.col("tn")).alias("p"))  # one row
    out = st.jackknife(e, "e", "p")
    return out.select("n", F.round("standard_error", 9).alias("standard_error"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@register(
    "stat_block_bootstrap",
    r"""with b as (select (l_suppkey % 5)::varchar as contig, l_partkey // 50 as block, count(*) filter (where l_returnflag = 'R')::bigint as num, count(*) as den from lineitem group by 1, 2),
i as (select *, row_number() over (partition by contig order by block) - 1 as i, count(*) over (partition by contig) as n from b),
s as (select substr(sha256('policy' || chr(0) || 'lineitem' || chr(0) || 'returns'), 1, 16) as seed),
d as (select contig, n, g.draw, r.rep from (select distinct contig, n from i) c, lateral (select unnest(range(0, n)) as draw) g, (select unnest(range(0, 100)) as rep) r),
h as (select contig, rep, ('0x' || substr(sha256(unhex(seed || lpad(printf('%x', rep), 16, '0') || lpad(printf('%x', strlen(contig)), 8, '0') || hex(contig) || lpad(printf('%x', draw), 16, '0'))), 1, 16))::ubigint % n as i from d, s),
e as (select rep, sum(num) / sum(den)::double as e from h join i using (contig, i) group by rep)
select (select count(*) from b) as blocks, round(quantile_cont(e, 0.025), 9) as low, round(quantile_cont(e, 0.975), 9) as high from e""",
)
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    b = li.groupBy((F.col("l_suppkey") % 5).cast("string").alias("contig"), F.floor(F.col("l_partkey") / 50).alias("block")).agg(F.count_if(F.col("l_returnflag") == "R").alias("num"), F.count("*").alias("den"))
    return _rounded(st.block_bootstrap(b, "policy", "lineitem", "returns", 100), "low", "high", digits=9)


@register("stat_power_law", "with o as (select ln(l_quantity) as x, ln(l_extendedprice) as y, l_returnflag from lineitem) select l_returnflag, count(*) as n, round(regr_slope(y, x), 6) as effect, round(regr_intercept(y, x), 6) as intercept from o group by 1")
def power_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.power_law(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", "n", "effect", "intercept"), "effect", "intercept")


@register("stat_aic", "with o as (select l_returnflag, regr_count(l_extendedprice, l_quantity)::double as n, regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity) as rss from lineitem group by 1) select l_returnflag, round(n * ln(rss / n / n) + 6, 4) as aic from o")
def aic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = "l_quantity", "l_extendedprice"
    o = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), (F.regr_syy(y, x) - F.regr_sxy(y, x) ** 2 / F.regr_sxx(y, x)).alias("rss"))
    return o.select("l_returnflag", F.round(st.aic(F.col("rss"), F.col("n"), 2), 4).alias("aic"))


@register("stat_split_half_slopes", "with m as (select avg(l_quantity) as m from lineitem) select case when l_quantity < m then 'low' else 'high' end as half, count(*) as n, round(regr_slope(l_extendedprice, l_quantity), 6) as slope from lineitem, m group by 1")
def split_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.split_half_slopes(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), "slope")


@register("stat_ratio_of_marginals", """with b as (select l_suppkey, avg(l_extendedprice) filter (where l_linestatus = 'O') as s, avg(l_extendedprice) filter (where l_linestatus = 'F') as w from lineitem group by 1)
select l_suppkey, round(s / w, 9) as ratio, round((0.9 * s) / (1.1 * w), 9) as low, round((1.1 * s) / (0.9 * w), 9) as high from b""")
def ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_extendedprice")))
    b = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(mean("O").alias("s"), mean("F").alias("w"))
    s, w = F.col("s"), F.col("w")
    got = st.ratio_of_marginals(s, 0.9 * s, 1.1 * s, w, 0.9 * w, 1.1 * w)
    return b.select("l_suppkey", *[F.round(c, 9).alias(n) for c, n in zip(got, ("ratio", "low", "high"), strict=True)])


@register("stat_michaelis_menten")
def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.avg("l_extendedprice").alias("price"))
    return st.michaelis_menten(per, "l_quantity", "price", ["l_returnflag"])


@register("stat_two_sided_p")
def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = st.ols(_orders(spark, sf_dir), "x", "y", ["level"])
    return fit.select("level", "effect", st.two_sided_p("z").alias("p"))


_WITHIN = """w as (select *, {x1} - avg({x1}) over g as u1, {x2} - avg({x2}) over g as u2, y - avg(y) over g as v from o window g as (partition by {keys}level)),
s as (select {keys}count(*) as n, count(distinct level) as levels, sum(u1 * u1) as a, sum(u1 * u2) as b, sum(u2 * u2) as d, sum(u1 * v) as e, sum(u2 * v) as f, sum(v * v) as vv, var_pop(y) * count(*) as tss, min(level) as first from w {by}),
c as (select *, (e * d - b * f) / (a * d - b * b) as c1, (a * f - b * e) / (a * d - b * b) as c2 from s)"""


@register(
    "stat_factor_model",
    f"""with o as (select l_linestatus as k, l_returnflag as level, l_quantity as x1, l_discount as x2, l_extendedprice as y from lineitem), {_WITHIN.format(x1="x1", x2="x2", keys="k, ", by="group by k")},
m as (select o.k, avg(y) as my, avg(x1) as m1, avg(x2) as m2 from o join c on o.k = c.k and o.level = c.first group by o.k)
select k, n, levels + 2 as columns, round(c1, 4) as effect, round(sqrt((vv - c1 * e - c2 * f) / (n - levels - 2) * d / (a * d - b * b)), 4) as se, round(my - c1 * m1 - c2 * m2, 2) as intercept, round(1 - (vv - c1 * e - c2 * f) / tss, 8) as r2, 'ok' as status from c join m using (k)""",
)
def factor_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("k"), F.col("l_returnflag").alias("level"), F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"), F.col("l_extendedprice").alias("y"))
    fit = models.factor_model(li, "y", ["x1", "x2"], ["level"], ["k"])
    return fit.select("k", "n", F.col("columns").cast("long").alias("columns"), F.round("effect", 4).alias("effect"), F.round("se", 4).alias("se"), F.round("intercept", 2).alias("intercept"), F.round("r2", 8).alias("r2"), "status")


@register(
    "stat_quadratic_fixed_effects",
    f"""with z as (select o_orderpriority as level, o_orderkey / 1000.0::double as x, log10(o_totalprice) as y from orders), o as (select level, y, x - avg(x) over () as l1, (x - avg(x) over ()) ** 2 as l2 from z), {_WITHIN.format(x1="l1", x2="l2", keys="", by="")}
select n, round(c2, 8) as effect, round(1 - (vv - c1 * e - c2 * f) / tss, 8) as r2, 'ok' as status from c""",
)
def quadratic_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("level"), (F.col("o_orderkey") / 1000.0).alias("x"), F.log10("o_totalprice").alias("y"))
    return models.quadratic_model(o, "x", "y", ["level"]).select("n", F.round("effect", 8).alias("effect"), F.round("r2", 8).alias("r2"), "status")


@register("stat_stratified_bootstrap")
def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = models.stratified_bootstrap(_orders(spark, sf_dir), "y", ["x"], ["level"], ["o_orderkey"], 2024, 50)
    return _rounded(models.bootstrap_interval(effects), "ci_low", "ci_high")


@register("stat_ratio_bootstrap")
def ratio_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.floor(F.col("l_partkey") / 100).alias("block")).agg(F.count_if(F.col("l_returnflag") == "R").alias("num"), F.sum(F.col("l_quantity").cast("long")).alias("den"))
    return _rounded(resampling.bootstrap_ratio(blocks, 200, 17, ["l_suppkey", "block"]), "estimate", "ci_low", "ci_high", "standard_error", digits=9)


_CURVES = "r as (select l_suppkey % 50 as replicate, l_partkey % 16 as interval, avg(l_quantity) / 50 as t, avg(l_extendedprice) / 1e4 as l, 0.05 + (l_suppkey % 50) / 1000.0::double as theta from lineitem group by 1, 2, 5), p as (select l_partkey % 16 as interval, avg(l_quantity) / 50 as t, avg(l_extendedprice) / 1e4 as l, 0.07::double as theta from lineitem group by 1)"
_SPREAD = ", ".join(f"round(min({c}), 6) as {n}_min, round(list_sort(list({c}))[round_even((count(*) - 1) * 0.025, 0)::int + 1], 6) as {n}_q025, round(median({c}), 6) as {n}_median, round(list_sort(list({c}))[round_even((count(*) - 1) * 0.975, 0)::int + 1], 6) as {n}_q975, round(max({c}), 6) as {n}_max" for c, n in (("theta", "replicate_theta"), ("top", "top"), ("oldest", "oldest")))


@register(
    "psmc_replicate_audit",
    f"""with {_CURVES}, e as (select replicate, max(theta) as theta, max(l) as top, max_by(l, interval) as oldest, count(*) as n from r group by 1), m as (select count(*) as replicates, min(n) as fewest_intervals, max(n) as most_intervals, {_SPREAD} from e),
o as (select max(theta) as theta, count(*) as intervals, round(min(t), 6) as time_from, round(max(t), 6) as time_to, round(min(l), 6) as lambda_min, round(max(l), 6) as lambda_max, round(min_by(l, interval), 6) as lambda_recent, round(max_by(l, interval), 6) as lambda_oldest, min_by(interval, l) as interval_of_min, max_by(interval, l) as interval_of_max, count(distinct l) as distinct_lambdas from p)
select *, round(theta / replicate_theta_median, 6) as ratio, theta < replicate_theta_min or theta > replicate_theta_max as outside from o, m""",
)
def replicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    curve = [(F.avg("l_quantity") / 50).alias("time"), (F.avg("l_extendedprice") / 1e4).alias("lambda")]
    each = li.groupBy((F.col("l_suppkey") % 50).alias("replicate"), (F.col("l_partkey") % 16).alias("interval")).agg(*curve).withColumn("theta", 0.05 + F.col("replicate") / 1000)
    primary = li.groupBy((F.col("l_partkey") % 16).alias("interval")).agg(*curve).withColumn("theta", F.lit(0.07))
    out = reads.audit_trajectories(primary, each)
    return _rounded(out, *(c for c, kind in out.dtypes if kind == "double" and c != "theta"))


@register("stat_saturation_models")
def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices against quantities: a saturating curve with a slope, and a levelling power law within bounds."""
    li = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", F.log10("l_quantity").alias("lq"), F.log10("l_extendedprice").alias("lp"))
    slope = nonlinear.fit(li, "l_quantity", "l_extendedprice", nonlinear.saturating_with_slope, [1000.0, 1000.0, 1.0], ["l_returnflag"], steps=30)
    power = nonlinear.fit(li, "lq", "lp", nonlinear.saturating_power, [3.0, 0.5, 1.0], ["l_returnflag"], ([-12, 0, 0.5], [6, 2, 16]), steps=30)
    both = slope.withColumn("model", F.lit("slope")).unionByName(power.withColumn("model", F.lit("power")))
    return both.select("l_returnflag", "model", "n", F.round("rss", 2).alias("rss"), (F.col("parameters")[1] > 0).alias("rising"))
