"""Queries of ledgers and accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators import ledger as lg
from strandframe.operators import selection as se
from strandframe.plans._tables import read
from strandframe.plans.registry import register


@register("ledger_reconcile", "select coalesce(c_custkey, o_custkey) as key, case when o_custkey is null then 'LEFT_ONLY' when c_custkey is null then 'RIGHT_ONLY' else 'BOTH' end as side from (select distinct c_custkey from customer) full join (select distinct o_custkey from orders) on c_custkey = o_custkey")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return lg.reconcile(c, o, ["key"])


@register("ledger_state_accounting", "with s as (select unnest(['F', 'O', 'P', 'QUARANTINED']) as o_orderstatus) select s.o_orderstatus, count(o_orderkey) as rows, coalesce(sum(o_custkey), 0)::bigint as total from s left join orders using (o_orderstatus) group by 1")
def state_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.state_accounting(read(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P", "QUARANTINED"], "o_custkey")


@register("ledger_overlapping_totals", "select 'all' as subset, count(*) as rows, sum(n_chars)::bigint as total from documents union all select 'english', count(*), sum(n_chars)::bigint from documents where lang = 'en' union all select 'long', count(*), sum(n_chars)::bigint from documents where n_chars > 2000 union all select 'either', count(*), sum(n_chars)::bigint from documents where lang = 'en' or n_chars > 2000")
def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    en, long = F.col("lang") == "en", F.col("n_chars") > 2000
    return lg.overlapping_totals(read(spark, sf_dir, "documents"), {"all": F.lit(True), "english": en, "long": long, "either": en | long}, "n_chars")


@register("ledger_cap_vector", "with l as (select l_shipdate, l_returnflag as dimension, l_linestatus || l_linenumber as source, case when l_linenumber = 7 then 'inf'::double else l_extendedprice end as lim from lineitem) select dimension, min(lim) as cap from l where not isinf(lim) group by 1")
def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    limits = li.select(F.col("l_returnflag").alias("dimension"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("source"), F.when(F.col("l_linenumber") == 7, float("inf")).otherwise(F.col("l_extendedprice")).alias("limit"))
    return lg.cap_vector(limits).select("dimension", "cap")


@register("ledger_proposed_budget", "with t as (select o_orderpriority, o_totalprice, row_number() over (partition by o_orderpriority order by o_totalprice desc) as k from orders), s as (select o_orderpriority, sum(o_totalprice) as scratch from t where k <= 2 group by 1) select o_orderpriority, round_even(sum(o_custkey)::double, 4) as o_custkey, round_even(max(o_orderkey)::double, 4) as o_orderkey, round_even(any_value(scratch), 4) as scratch from orders join s using (o_orderpriority) group by 1")
def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("scratch", F.col("o_totalprice"))
    return lg.proposed(o, ["o_custkey"], ["o_orderkey"], {"scratch": 2}, ["o_orderpriority"])


@register("ledger_resource_verdict", "with r as (select s_suppkey, s_acctbal as low, s_acctbal * 2 as high from supplier) select s_suppkey, case when high <= 9000 + 1e-9 then 'PASS' when low > 9000 + 1e-9 then 'FAIL' else 'INCONCLUSIVE' end as verdict from r")
def resource_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("s_acctbal")
    return read(spark, sf_dir, "supplier").select("s_suppkey", lg.resource_verdict(b, b, b * 2, F.lit(None).cast("double"), F.lit(9000.0)).alias("verdict"))


@register("ledger_upsert", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.upsert(read(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@register("ledger_insert_or_ignore", "select user_id, event_id from events qualify row_number() over (partition by user_id order by event_id) = 1")
def ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.upsert(read(spark, sf_dir, "events"), ["user_id"], "event_id", True).select("user_id", "event_id")


@register("ledger_last_failure", "with f as (select o_custkey, max_by(o_orderpriority, o_orderkey) as p from orders where o_orderstatus = 'F' group by 1) select c_custkey, coalesce(case when c_mktsegment <> 'BUILDING' then p end, 'none') as last_failure from customer left join f on o_custkey = c_custkey")
def last_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumn("state", F.when(F.col("c_mktsegment") == "BUILDING", "COMPLETE").otherwise("FAILED"))
    f = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").withColumn("c_custkey", F.col("o_custkey"))
    out = lg.attach_last_failure(c, f, ["c_custkey"], "o_orderkey", "o_orderpriority")
    return out.select("c_custkey", F.coalesce("last_failure", F.lit("none")).alias("last_failure"))


@register("ledger_headline_audit", "select event_type as claim, round(avg(value), 9) as reported, round(avg(value), 9) as recomputed, case when event_type < 'd' then 'MISMATCH' else 'MATCH' end as status from events group by 1")
def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("claim")).agg(F.avg("value").alias("recomputed"))
    claims = g.select("claim", F.when(F.col("claim") < "d", F.col("recomputed") + 1e-6).otherwise(F.col("recomputed")).alias("reported"))
    out = lg.audit_claims(claims, g)
    return out.select("claim", F.round(F.when(F.col("status") == "MATCH", F.col("reported")).otherwise(F.col("recomputed")), 9).alias("reported"), F.round("recomputed", 9).alias("recomputed"), "status")


@register("ledger_claim_rows", "with s as (select distinct lang, source from documents), o as (select lang, source, count(distinct doc_id) as n from documents join labels using (doc_id) group by 1, 2) select s.lang, s.source, coalesce(n, 0) as n, case when n > 0 then 'OBSERVED' else 'NO_OBSERVATION' end as status from s left join o using (lang, source)")
def claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return lg.claim_rows(d.select("lang", "source").distinct(), d.join(read(spark, sf_dir, "labels"), "doc_id"), ["lang", "source"], "doc_id")


@register("ledger_task_graph", "with e as (select distinct l_partkey as source, l_suppkey as target from lineitem where l_linenumber = 1), q as (select distinct l_partkey as source, l_suppkey as target from lineitem where l_linenumber = 2), x as (select distinct l_partkey as source, l_suppkey as target from lineitem where l_linenumber = 3) select *, 'missing' as fault from q anti join e using (source, target) union all select *, 'forbidden' from x semi join e using (source, target)")
def task_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    edges = lambda n: li.where(F.col("l_linenumber") == n).select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).distinct()
    return lg.forbidden_paths(edges(1), edges(2), edges(3))


@register("ledger_closed_world", "with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as k from orders) select c_custkey, case when r.o_orderkey is null then 'NO_ROSTER' when o_orderkey % 5 = 0 then 'FAILED' else 'MATCHED' end as disposition from customer left join r on o_custkey = c_custkey and k = 1")
def closed_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = se.best(read(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey")])
    c = read(spark, sf_dir, "customer")
    joined = c.join(first, c["c_custkey"] == first["o_custkey"], "left")
    rule = lg.first_reason({"NO_ROSTER": F.col("o_orderkey").isNull(), "FAILED": F.col("o_orderkey") % 5 == 0}, "MATCHED")
    return lg.require_unique(joined.select("c_custkey", rule.alias("disposition")), ["c_custkey"])


@register("ledger_normalised_diff", "select count(*) as differing from (select c_custkey, c_nationkey from customer except all select c_custkey, c_nationkey from customer where c_custkey % 10 <> 0)")
def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return lg.unequal_rows(c, c.where("c_custkey % 10 <> 0"), ["c_acctbal"]).agg(F.count("*").alias("differing"))


@register("ledger_allocation_summary", "select o_orderstatus, count(*) as allocations, sum(o_custkey * 4) / 3600.0 as core_hours, round(median(o_totalprice), 6) as median, ceil(201 / 21.0) * round(median(o_totalprice), 6) as makespan from orders group by 1")
def allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("allocations"), (F.sum(F.col("o_custkey") * 4) / 3600.0).alias("core_hours"), F.round(F.median("o_totalprice"), 6).alias("median"))
    return g.withColumn("makespan", F.lit(10.0) * F.col("median"))
