"""Queries of the alignment operators: records made of lineitem, operations from its numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators import alignment as al
from strandframe.operators import intervals as iv
from strandframe.operators._folders import shared_folder
from strandframe.plans._tables import LINES, lines, read
from strandframe.plans.registry import register

# Two shapes: n bases equal, 1 unlike, 2 inserted, 3 equal, 4 deleted, n equal; or n equal, 3 deleted, 5 equal, 2 unlike, 1 inserted, n equal.
_RECORDS = f"""r as (select line_id as record_id, 'q' || l_suppkey % 10 as query, (l_orderkey * 24 + l_linenumber * 5)::bigint as query_start, 't' || l_suppkey as target, (l_orderkey * 3 + l_linenumber * 2)::bigint as target_start,
 l_quantity::bigint as n, case when l_linestatus = 'O' then '+' else '-' end as strand, (l_orderkey % 60)::bigint as mapq, l_linenumber % 3 = 0 as other from {LINES}),
p as (select *, query_start + 2 * n + case when other then 8 else 6 end as query_end, target_start + 2 * n + case when other then 10 else 8 end as target_end, 2 * n + case when other then 5 else 3 end as matches, 2 * n + case when other then 11 else 10 end as block from r)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every line item, of two shapes."""
    n, other = F.col("l_quantity").cast("long"), F.col("l_linenumber") % 3 == 0
    q, t = F.col("l_orderkey") * 24 + F.col("l_linenumber") * 5, F.col("l_orderkey") * 3 + F.col("l_linenumber") * 2
    of = lambda a, b: 2 * n + F.when(other, b).otherwise(a)
    return lines(spark, sf_dir).select(
        F.col("line_id").alias("record_id"),
        F.concat(F.lit("q"), (F.col("l_suppkey") % 10).cast("string")).alias("query"),
        F.lit(100_000_000).cast("long").alias("query_length"),
        q.alias("query_start"),
        (q + of(6, 8)).alias("query_end"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("target"),
        F.lit(100_000_000).cast("long").alias("target_length"),
        t.alias("target_start"),
        (t + of(8, 10)).alias("target_end"),
        of(3, 5).alias("matches"),
        of(10, 11).alias("block"),
        (F.col("l_orderkey") % 60).alias("mapq"),
        F.concat(n.cast("string"), F.when(other, "=3D5=2X1I").otherwise("=1X2I3=4D"), n.cast("string"), F.lit("=")).alias("cigar"),
    )


_OPS = """o as (select record_id, query, target, strand, query_start, query_end, u.* from p, lateral (select unnest(case when other then [
 {{'i': 0, 'op': '=', 'len': n, 't': target_start, 'q': 0}}, {{'i': 1, 'op': 'D', 'len': 3, 't': target_start + n, 'q': n}}, {{'i': 2, 'op': '=', 'len': 5, 't': target_start + n + 3, 'q': n}},
 {{'i': 3, 'op': 'X', 'len': 2, 't': target_start + n + 8, 'q': n + 5}}, {{'i': 4, 'op': 'I', 'len': 1, 't': target_start + n + 10, 'q': n + 7}}, {{'i': 5, 'op': '=', 'len': n, 't': target_start + n + 10, 'q': n + 8}}] else [
 {{'i': 0, 'op': '=', 'len': n, 't': target_start, 'q': 0}}, {{'i': 1, 'op': 'X', 'len': 1, 't': target_start + n, 'q': n}}, {{'i': 2, 'op': 'I', 'len': 2, 't': target_start + n + 1, 'q': n + 1}},
 {{'i': 3, 'op': '=', 'len': 3, 't': target_start + n + 1, 'q': n + 3}}, {{'i': 4, 'op': 'D', 'len': 4, 't': target_start + n + 4, 'q': n + 6}}, {{'i': 5, 'op': '=', 'len': n, 't': target_start + n + 8, 'q': n + 6}}] end, recursive := true)) u)"""


@register("align_segments", f"with {_RECORDS}, {_OPS} select record_id, i as op_index, op, len as length, t as t_start, t + case when op = 'I' then 0 else len end as t_end, case when strand = '-' then query_end - q - case when op = 'D' then 0 else len end else query_start + q end as q_start from o".format())
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.segments(_records(spark, sf_dir)).select("record_id", "op_index", "op", "length", "t_start", "t_end", "q_start")


_M = """{name}_w as (select *, case when start > max(e) over (partition by contig order by start, e rows between unbounded preceding and 1 preceding) or row_number() over (partition by contig order by start, e) = 1 then 1 else 0 end as fresh from {source}),
{name}_g as (select *, sum(fresh) over (partition by contig order by start, e rows unbounded preceding) as island from {name}_w),
{name} as (select contig, min(start) as start, max(e) as e from {name}_g group by contig, island)"""


def _sub(name: str, a: str, b: str) -> str:
    """Bases of a (kept where its weight is positive) where b is not."""
    return f"""{name}_ev as (select contig, pos, sum(x) as x, sum(y) as y from (select contig, start as pos, 1 as x, 0 as y from {a} union all select contig, e, -1, 0 from {a} union all select contig, start, 0, 1 from {b} union all select contig, e, 0, -1 from {b}) group by contig, pos),
{name}_sg as (select contig, pos as start, lead(pos) over w as e, sum(x) over w as x, sum(y) over w as y from {name}_ev window w as (partition by contig order by pos)),
{name} as (select contig, start, e from {name}_sg where e is not null and x > 0 and y = 0)"""


_TRAVERSE = f"""with {_RECORDS}, {_OPS},
shown as (select target as contig, t as start, t + len as e from o where op in ('=', 'X')),
ev as (select contig, pos, sum(d) as d from (select contig, start as pos, 1 as d from shown union all select contig, e, -1 from shown) group by contig, pos),
dp as (select contig, pos as start, lead(pos) over (partition by contig order by pos) as e, sum(d) over (partition by contig order by pos) as depth from ev),
once as (select contig, start, e from dp where depth = 1 and e is not null), many as (select contig, start, e from dp where depth > 1 and e is not null),
edge as (select target as contig, target_start as start, least(target_end, target_start + 5) as e from p union all select target, greatest(target_start, target_end - 5), target_end from p),
gap as (select o.target as contig, greatest(target_start, t - 2) as start, least(target_end, t + 2 + case when op = 'I' then 1 else len end) as e from o join p using (record_id) where op in ('I', 'D')),
bad as (select * from edge union all select * from gap union all select * from many)"""


@register("align_traverse_callable", (_TRAVERSE + f", {_sub('c', 'once', 'bad')} select contig, sum(e - start)::bigint as bases from c group by contig").format())
def traverse_callable(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _, _ = al.traverse(_records(spark, sf_dir), 5, 2)
    return good.groupBy("contig").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


_UNPADDED = _TRAVERSE.replace("_start + 5", "_start + 0").replace("_end - 5", "_end - 0").replace("t - 2", "t - 0").replace("t + 2 +", "t + 0 +")


@register("align_traverse_snvs", (_UNPADDED + f", {_sub('c', 'once', 'bad')}, x as (select target as contig, t + unnest(range(len)) as pos from o where op = 'X') select contig, pos from x where exists (select 1 from c where c.contig = x.contig and x.pos >= c.start and x.pos < c.e)").format())
def traverse_snvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, changed, _ = al.traverse(_records(spark, sf_dir), 0, 0)
    return changed.select("contig", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))


@register("align_traverse_reasons", (_TRAVERSE + f", {_M.format(name='me', source='edge')}, {_M.format(name='mg', source='gap')}, {_M.format(name='mm', source='many')} select 'alignment_edge' as reason, sum(e - start)::bigint as bases from me union all select 'indel_flank', sum(e - start)::bigint from mg union all select 'multiple_projection', sum(e - start)::bigint from mm union all select 'ambiguous_base', 0").format())
def traverse_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.traverse(_records(spark, sf_dir), 5, 2)[2]


@register("align_summary", "with {r} select count(*) as records, sum(block)::bigint as block_bases, sum(matches)::bigint as matching_bases, round(sum(matches) / sum(block)::double, 9) as identity, round(avg(mapq), 6) as mean_mapq, round(avg((mapq >= 20)::int), 9) as share_mapq_20 from p".format(r=_RECORDS.format()))
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.summary(_records(spark, sf_dir)).withColumns({"identity": F.round("identity", 9), "mean_mapq": F.round("mean_mapq", 6), "share_mapq_20": F.round("share_mapq_20", 9)})


_AXIS = """a as (select query as contig, query_start as start, query_end as e from p), {m},
ev as (select contig, pos, sum(d) as d from (select contig, start as pos, 1 as d from a union all select contig, e, -1 from a) group by contig, pos),
dp as (select contig, max(d) as max_depth from (select contig, sum(d) over (partition by contig order by pos) as d from ev) group by contig)"""


@register("align_axis_metrics", "with {r}, {a} select m.contig, 100000000::bigint as length, sum(e - start)::bigint as covered, round(sum(e - start) / 100000000.0, 9) as coverage, any_value(max_depth)::bigint as max_depth from m join dp using (contig) group by m.contig".format(r=_RECORDS.format(), a=_AXIS.format(m=_M.format(name="m", source="a"))))
def axis_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.axis_metrics(_records(spark, sf_dir), "query").withColumn("coverage", F.round("coverage", 9))


@register("align_pair_table", "with {r}, g as (select query, target, count(*) as records, sum(matches)::bigint as matches from p group by 1, 2), t as (select 't' || s_suppkey as target from supplier) select * from g union all select 'q10', null, 0, 0 union all select null, target, 0, 0 from t where target not in (select target from g)".format(r=_RECORDS.format()))
def pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.range(11).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("contig"))
    t = read(spark, sf_dir, "supplier").select(F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("contig"))
    return al.pair_table(_records(spark, sf_dir), q, t)


@register("align_overlap_conflicts", "with {r} select record_id from (select record_id, target_start, max(target_end) over (partition by target order by target_start, target_end, record_id rows between unbounded preceding and 1 preceding) as reach from p) where target_start < reach".format(r=_RECORDS.format()))
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.overlap_conflicts(_records(spark, sf_dir), "target").select("record_id")


@register("align_project_to_target", "with {r}, {o}, s as (select distinct 'q' || e_ as contig, b * 25000 as start, b * 25000 + 40 as e from (select unnest(range(0, 10)) as e_), (select unnest(range(0, 13)) as b)) select o.record_id, o.target as contig, case when strand = '-' then t + len - (least(qs + len, s.e) - qs) else t + greatest(qs, s.start) - qs end as start, (least(qs + len, s.e) - greatest(qs, s.start))::bigint as bases from (select *, case when strand = '-' then query_end - q - len else query_start + q end as qs from o where op in ('=', 'X')) o join s on o.query = s.contig and qs < s.e and s.start < qs + len".format(r=_RECORDS.format(), o=_OPS.format()))
def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(130).select(F.concat(F.lit("q"), (F.col("id") % 10).cast("string")).alias("contig"), (F.floor(F.col("id") / 10) * 25000).alias("start"))
    spans = grid.withColumn("end", F.col("start") + 40)
    return al.project(_records(spark, sf_dir), spans).select("record_id", "contig", "start", (F.col("end") - F.col("start")).alias("bases"))


_NONUNIQUE = """placed as (select query as contig, case when strand = '-' then query_end - q - len else query_start + q end as start, case when strand = '-' then query_end - q else query_start + q + len end as e, t, strand, target from o where op in ('=', 'X')),
ev as (select contig, pos, sum(d) as d from (select contig, start as pos, 1 as d from placed union all select contig, e, -1 from placed) group by contig, pos),
dp as (select contig, pos as start, lead(pos) over (partition by contig order by pos) as e, sum(d) over (partition by contig order by pos) as depth from ev),
hit as (select p.target as contig, case when strand = '-' then t + p.e - least(p.e, d.e) else t + greatest(p.start, d.start) - p.start end as start, least(p.e, d.e) - greatest(p.start, d.start) as n from placed p join dp d on d.contig = p.contig and d.depth > 1 and d.e is not null and d.start < p.e and p.start < d.e),
lifted as (select contig, start, start + n as e from hit)"""


@register("align_nonunique_targets", "with {r}, {o}, {n}, {m} select contig, start, e as \"end\" from m".format(r=_RECORDS.format(), o=_OPS.format(), n=_NONUNIQUE, m=_M.format(name="m", source="lifted")))
def nonunique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.nonunique_targets(_records(spark, sf_dir))


#: Columns that no rule of the exact pass reads.
_UNRANKED = ("query_length", "target_length", "mapq")


@register("align_exact_multiplicity")
def multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    return al.exact_multiplicity(_records(spark, sf_dir).drop(*_UNRANKED)).select("record_id", "query", "target")


@register("align_variant_depth", "select unnest(['query', 'target']) as axis, 1::bigint as max_depth")
def variant_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deepest overlap on both axes of what the exact pass keeps: 1 and 1."""
    shared_folder(spark)
    kept = al.exact_multiplicity(_records(spark, sf_dir).drop(*_UNRANKED))
    span = lambda axis: F.struct(F.lit(axis).alias("axis"), F.col(axis).alias("contig"), F.col(f"{axis}_start").alias("start"), F.col(f"{axis}_end").alias("end"))
    both = kept.select(F.explode(F.array(span("query"), span("target"))).alias("s")).select("s.*")
    return iv.max_depth(both, ["axis", "contig"]).groupBy("axis").agg(F.max("max_depth").alias("max_depth"))
