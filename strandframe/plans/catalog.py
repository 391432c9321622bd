"""Queries of catalogs and contig names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators import catalog as ca
from strandframe.plans._tables import read
from strandframe.plans.registry import register


@register("catalog_statistics", "with g as (select o_custkey, count(*) as n from orders group by 1) select sum(n)::bigint as rows, count(*) as names, (sum(n) - count(*))::bigint as excess, count(*) filter (where n > 1) as repeated from g")
def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.catalog_statistics(read(spark, sf_dir, "orders"), "o_custkey")


@register("catalog_seed_rows", "select o_custkey, min(o_orderkey) as first_row, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') as modalities, max_by(o_orderstatus, o_orderkey) as o_orderstatus from orders group by 1")
def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("modalities", F.array("o_orderpriority"))
    return ca.seed_rows(o, "o_custkey", "o_orderkey", "modalities", ["o_orderstatus"]).withColumn("modalities", F.array_join("modalities", ","))


@register("catalog_resolve_pairs", """with d as (select s_suppkey as a, s_suppkey + 1 as p1, case when s_suppkey % 3 = 0 then s_suppkey + 2 end as p2, s_suppkey // 2 as b, s_nationkey as i from supplier),
l as (select a, b, i, p1 as p from d union all select a, b, i, p2 from d where p2 is not null), m as (select l.a, l.p, l.b = o.b as s, l.i = o.i as t, (o.p1 = l.a or coalesce(o.p2 = l.a, false)) as k from l join d o on o.a = l.p),
g as (select a, count(*) as n, max(p) as only_, count(*) filter (where k) as nk, max(p) filter (where k) as pk, count(*) filter (where s) as ns, max(p) filter (where s) as ps, count(*) filter (where t) as nt, max(p) filter (where t) as pt from m group by a),
r as (select a, case when n = 1 then only_ when nk = 1 then pk when ns = 1 then ps when nt = 1 then pt end as p, case when n = 1 then 'only_link' when nk = 1 then 'reciprocal' when ns = 1 then 'biosample' when nt = 1 then 'isolate' end as rule from g)
select r.a as accession, r.p as partner, rule from r join m on m.a = r.a and m.p = r.p where m.k or m.s or m.t""")
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    d = read(spark, sf_dir, "supplier").select(k.alias("accession"), F.filter(F.array(k + 1, F.when(k % 3 == 0, k + 2)), lambda x: x.isNotNull()).alias("linked"), F.floor(k / 2).alias("biosample"), F.col("s_nationkey").alias("isolate"))
    return ca.resolve_pairs(d)


@register("catalog_dictionary_rows", "with n as (select 's' || (s_suppkey * 2) as name from supplier union select 'p' || p_size from part), c as (select 's' || s_suppkey as contig from supplier), a as (select 'p' || n_nationkey as alias, 's' || (n_nationkey + 1) as contig from nation) select name, coalesce(c.contig, a.contig, '') as contig, case when c.contig is not null then 'EXACT' when a.contig is not null then 'VALIDATED_ALIAS' else 'UNRESOLVED' end as state from n left join c on name = c.contig left join a on name = alias")
def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    s, p, n = (read(spark, sf_dir, t) for t in ("supplier", "part", "nation"))
    out = ca.dictionary_rows(s.select(text("s", F.col("s_suppkey") * 2).alias("name")), p.select(text("p", F.col("p_size")).alias("name")), n.select(text("p", F.col("n_nationkey")).alias("alias"), text("s", F.col("n_nationkey") + 1).alias("contig")), s.select(text("s", F.col("s_suppkey")).alias("contig")))
    return out.withColumn("contig", F.coalesce("contig", F.lit("")))


@register("catalog_without_contigs", "select l_suppkey, count(*) as n from lineitem where l_suppkey not in (select s_suppkey from supplier where s_nationkey in (select s_nationkey from supplier where s_suppkey <= 3)) group by 1")
def without(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("contig"))
    kept = ca.without_contigs(li, s.where("s_suppkey <= 3").select(F.col("s_suppkey").alias("name")), s.select(F.col("s_nationkey").alias("group"), F.col("s_suppkey").alias("alias")))
    return kept.groupBy(F.col("contig").alias("l_suppkey")).agg(F.count("*").alias("n"))


@register("catalog_regions", "select l_orderkey, l_linenumber, l_suppkey::varchar as contig, l_partkey as start, l_partkey + l_quantity::bigint as end_ from lineitem")
def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    text = F.concat(F.col("l_suppkey").cast("string"), F.lit(":"), (F.col("l_partkey") + 1).cast("string"), F.lit("-"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).cast("string"))
    r = ca.parse_region(text)
    return li.select("l_orderkey", "l_linenumber", r["contig"].alias("contig"), r["start"].alias("start"), r["end"].alias("end_"))


@register("catalog_owned_records", "select contig, (pos - 1) // 300 as core, count(*) as n from (select distinct l_suppkey as contig, l_partkey + 1 as pos, l_returnflag from lineitem) group by 1, 2")
def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("contig"), (F.col("l_partkey") + 1).alias("pos"), F.col("l_returnflag").alias("ref"), F.array(F.lit("A")).alias("alts"))
    return ca.owned_records(li, 300).groupBy("contig", "core").agg(F.count("*").alias("n"))


@register("catalog_merged_telemetry", "select o_orderkey::varchar as job, case when o_orderkey % 2 = 0 then 'baseline' else 'sidecar' end as \"table\", o_custkey::double as max_rss_mib, case when o_orderkey % 5 = 0 then 'record' else 'accounting' end as source from orders")
def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    jobs = o.select(F.col("o_orderkey").cast("string").alias("job"), "o_orderkey", F.col("o_custkey").cast("double").alias("max_rss_mib"))
    rows = lambda n: jobs.where(F.col("o_orderkey") % 2 == n).drop("o_orderkey")
    accounting = jobs.select("job", F.lit("COMPLETED").alias("State"), F.when(F.col("o_orderkey") % 5 != 0, F.col("max_rss_mib")).alias("max_rss_mib"))
    return ca.merged_telemetry(rows(0), rows(1), accounting)


@register("catalog_scenarios", "select s_suppkey, f.scenario, round(s_acctbal * f.x, 6) as projected from supplier, (values ('low', 0.5), ('base', 1.0), ('high', 17.9)) as f(scenario, x)")
def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ca.scenario_rows(read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), {"low": 0.5, "base": 1.0, "high": 17.9}, "s_acctbal")
    return out.select("s_suppkey", "scenario", F.round("projected", 6).alias("projected"))
