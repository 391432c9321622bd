"""Queries of the interval algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators import intervals as iv
from strandframe.plans import _tables as t
from strandframe.plans.registry import register

_ISLANDS = """
{name}_w as (select *, case when start > max(end_) over (partition by {keys} order by start, end_ rows between unbounded preceding and 1 preceding) or row_number() over (partition by {keys} order by start, end_) = 1 then 1 else 0 end as fresh from {source}),
{name}_g as (select *, sum(fresh) over (partition by {keys} order by start, end_ rows unbounded preceding) as island from {name}_w),
{name} as (select {keys}, min(start) as start, max(end_) as end_ from {name}_g group by {keys}, island)"""


def _merged(name: str, source: str, keys: str = "contig") -> str:
    return _ISLANDS.format(name=name, source=source, keys=keys)


_WIDTH = 512
_A = f"i as ({t.INTERVALS}), a0 as (select * from i where l_returnflag = 'A'), b0 as (select * from i where l_returnflag = 'R')"
_SWEEP = """
ev as (select contig, pos, sum(da) as da, sum(db) as db from (
  select contig, start as pos, 1 as da, 0 as db from a0 union all select contig, end_, -1, 0 from a0
  union all select contig, start, 0, 1 from b0 union all select contig, end_, 0, -1 from b0) group by contig, pos),
sg as (select contig, pos as start, lead(pos) over (partition by contig order by pos) as end_, sum(da) over (partition by contig order by pos) as na, sum(db) over (partition by contig order by pos) as nb from ev)"""


@register("interval_merge", f"with {_A}, {_merged('m', 'i')} select contig, start, end_ from m")
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.merge(t.intervals(spark, sf_dir), width=_WIDTH).withColumnRenamed("end", "end_")


@register("interval_measure", f"with {_A}, {_merged('m', 'i')} select contig, sum(end_ - start)::bigint as bases from m group by contig")
def measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.measure(t.intervals(spark, sf_dir), width=_WIDTH)


@register("interval_intersect", f"with {_A}, {_SWEEP}, hit as (select * from sg where na > 0 and nb > 0 and end_ is not null), {_merged('m', 'hit')} select contig, start, end_ from m")
def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = t.intervals(spark, sf_dir)
    return iv.intersect(i.where("l_returnflag = 'A'"), i.where("l_returnflag = 'R'"), width=_WIDTH).withColumnRenamed("end", "end_")


@register("interval_subtract", f"with {_A}, {_SWEEP}, hit as (select * from sg where na > 0 and nb = 0 and end_ is not null), {_merged('m', 'hit')} select contig, start, end_ from m")
def subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = t.intervals(spark, sf_dir)
    return iv.subtract(i.where("l_returnflag = 'A'"), i.where("l_returnflag = 'R'"), width=_WIDTH).withColumnRenamed("end", "end_")


_DEPTH = """ev as (select contig, pos, sum(d) as d from (select contig, start as pos, 1 as d from i union all select contig, end_, -1 from i) group by contig, pos),
sg as (select contig, pos as start, lead(pos) over (partition by contig order by pos) as end_, sum(d) over (partition by contig order by pos) as depth from ev)"""


@register("interval_coverage_depth", f"with {_A}, {_DEPTH} select contig, depth::bigint as depth, sum(end_ - start)::bigint as bases from sg where end_ is not null and depth > 0 group by contig, depth")
def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = iv.depth_segments(t.intervals(spark, sf_dir), width=_WIDTH).where("depth > 0")
    return swept.groupBy("contig", "depth").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


@register("interval_max_depth", f"with {_A}, {_DEPTH} select contig, max(depth)::bigint as max_depth from sg where end_ is not null group by contig")
def max_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.max_depth(t.intervals(spark, sf_dir), width=_WIDTH)


@register("interval_uniquely_covered", f"with {_A}, {_DEPTH}, hit as (select * from sg where depth = 1 and end_ is not null), {_merged('m', 'hit')} select contig, start, end_ from m")
def unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.uniquely_covered(t.intervals(spark, sf_dir), width=_WIDTH).withColumnRenamed("end", "end_")


@register("interval_overlap_join", f"with {_A} select a.contig, count(*) as pairs, sum(least(a.end_, b.end_) - greatest(a.start, b.start))::bigint as bases from (select * from a0 where l_linestatus = 'O') a join b0 b on a.contig = b.contig and a.start < b.end_ and b.start < a.end_ group by a.contig")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = t.intervals(spark, sf_dir).select("contig", "start", "end", "l_returnflag", "l_linestatus", "l_linenumber")
    a, b = i.where("l_returnflag = 'A' and l_linestatus = 'O'").select("contig", "start", "end"), i.where("l_returnflag = 'R'").select("contig", "start", "end")
    met = iv.overlaps(a, b, width=64)
    return met.groupBy("contig").agg(F.count("*").alias("pairs"), F.sum(F.least("end", "b_end") - F.greatest("start", "b_start")).alias("bases"))


@register("interval_overlap_select", f"with {_A} select l_orderkey, l_linenumber, contig, start, end_ from a0 where exists (select 1 from b0 where b0.contig = a0.contig and a0.start < b0.end_ and b0.start < a0.end_)")
def overlap_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = t.intervals(spark, sf_dir)
    hit = iv.overlaps(i.where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", "contig", "start", "end"), i.where("l_returnflag = 'R'").select("contig", "start", "end"), width=64, how="semi")
    return hit.withColumnRenamed("end", "end_")


@register("interval_overlap_names", f"with {_A} select a.l_orderkey, a.l_linenumber, string_agg(b.name, ',' order by b.name) as names from a0 a join (select distinct contig, start, end_, l_orderkey::varchar as name from b0) b on a.contig = b.contig and a.start < b.end_ and b.start < a.end_ group by a.l_orderkey, a.l_linenumber")
def overlap_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = t.intervals(spark, sf_dir)
    b = i.where("l_returnflag = 'R'").select("contig", "start", "end", F.col("l_orderkey").cast("string").alias("name")).distinct()
    met = iv.overlaps(i.where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", "contig", "start", "end"), b, width=64)
    return met.groupBy("l_orderkey", "l_linenumber").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


@register("interval_points_within", f"with {_A}, p as ({t.POINTS}), {_merged('m', 'a0')} select event_id, contig, pos from p where exists (select 1 from m where m.contig = p.contig and p.pos >= m.start and p.pos < m.end_)")
def points_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t.intervals(spark, sf_dir).where("l_returnflag = 'A'")
    return iv.points_within(t.points(spark, sf_dir).select("event_id", "contig", "pos"), a, width=_WIDTH)


@register("interval_points_outside", f"with {_A}, p as ({t.POINTS}), {_merged('m', 'a0')} select event_type, count(*) as n from p where not exists (select 1 from m where m.contig = p.contig and p.pos >= m.start and p.pos < m.end_) group by event_type")
def points_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t.intervals(spark, sf_dir).where("l_returnflag = 'A'")
    return iv.points_within(t.points(spark, sf_dir), a, width=_WIDTH, how="left_anti").groupBy("event_type").agg(F.count("*").alias("n"))


@register("interval_span_containment", f"with {_A}, {_merged('m', 'b0')} select l_orderkey, l_linenumber from a0 where exists (select 1 from m where m.contig = a0.contig and a0.start >= m.start and a0.end_ <= m.end_)")
def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = t.intervals(spark, sf_dir)
    return iv.contained(i.where("l_returnflag = 'A'"), i.where("l_returnflag = 'R'"), width=_WIDTH).select("l_orderkey", "l_linenumber")


_REASONS = ("A", "R", "N")


@register(
    "interval_reason_mask",
    f"""with {_A}, u as (select distinct contig, 0 as start, 2200 as end_ from i),
ev as (select contig, pos, sum(a) as a, sum(r) as r, sum(n) as n from (
  select contig, start as pos, (l_returnflag = 'A')::int as a, (l_returnflag = 'R')::int as r, (l_returnflag = 'N')::int as n from i
  union all select contig, end_, -(l_returnflag = 'A')::int, -(l_returnflag = 'R')::int, -(l_returnflag = 'N')::int from i
  union all select contig, start, 0, 0, 0 from u union all select contig, end_, 0, 0, 0 from u) group by contig, pos),
sg as (select contig, pos as start, lead(pos) over w as end_, sum(a) over w as a, sum(r) over w as r, sum(n) over w as n from ev window w as (partition by contig order by pos)),
cl as (select contig, least(start, 2200) as start, least(end_, 2200) as end_, case when a > 0 then 'A' when r > 0 then 'R' when n > 0 then 'N' else 'callable' end as reason from sg where end_ is not null and start < 2200)
select contig, reason, sum(end_ - start)::bigint as bases from cl group by contig, reason""",
)
def reason_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = t.intervals(spark, sf_dir)
    universe = i.select("contig").distinct().select("contig", F.lit(0).cast("long").alias("start"), F.lit(2200).cast("long").alias("end"))
    reasons = i.select("contig", F.col("l_returnflag").alias("reason"), "start", "end")
    masked = iv.reason_mask(universe, reasons, _REASONS, width=_WIDTH)
    return masked.groupBy("contig", "reason").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


@register(
    "interval_depth_masks",
    f"""with d as ({t.MINUTES}), s as (select 'low' as name, 1 as lo, 1 as hi union all select 'high', 2, 1000000),
h as (select name, contig, pos - 1 as start, pos as end_ from d join s on depth between lo and hi), {_merged('m', 'h', 'name, contig')} select name, contig, start, end_ from m""",
)
def depth_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = iv.depth_masks(t.minutes(spark, sf_dir), [("low", 1, 1), ("high", 2, None)])
    return out.withColumnRenamed("end", "end_")


@register("interval_depth_histogram", f"with d as ({t.MINUTES}) select depth, count(*) as positions from d group by depth")
def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.minutes(spark, sf_dir).groupBy("depth").agg(F.count("*").alias("positions"))


_LENGTHS = "l as (select c_custkey as contig, (1000 + c_custkey % 977)::bigint as length from customer)"


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("contig"), (1000 + F.col("c_custkey") % 977).alias("length"))


@register("interval_core_windows", f"with {_LENGTHS} select contig, g.s as core_start, least(g.s + 300, length) as core_end, greatest(0, g.s - 50) as query_start, least(length, least(g.s + 300, length) + 50) as query_end from l, lateral (select unnest(range(0, length, 300)) as s) g")
def core_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.windows(_lengths(spark, sf_dir), 300, 50)


@register("interval_tiles", f"with {_A}, {_merged('m', 'a0')} select contig, g.s as start, least(g.s + 40, end_) as end_ from m, lateral (select unnest(range(start, end_, 40)) as s) g")
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.tiles(t.intervals(spark, sf_dir).where("l_returnflag = 'A'"), 40).withColumnRenamed("end", "end_")


@register("interval_block_counts", f"with p as ({t.POINTS}) select contig, pos // 100 as block, count(*) as n from p group by 1, 2")
def block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.block_counts(t.points(spark, sf_dir), 100).withColumnRenamed("count", "n")


@register("interval_block_bases", f"with {_A}, {_merged('m', 'a0')}, k as (select contig, g.b as block, least(end_, (g.b + 1) * 100) - greatest(start, g.b * 100) as n from m, lateral (select unnest(range(start // 100, (end_ - 1) // 100 + 1)) as b) g) select contig, block, sum(n)::bigint as bases from k group by contig, block")
def block_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.split_at_blocks(t.intervals(spark, sf_dir).where("l_returnflag = 'A'"), 100)


@register("interval_positions_to_runs", f"with p as (select distinct contig, pos from ({t.POINTS})), g as (select contig, pos, pos - row_number() over (partition by contig order by pos) as k from p) select contig, min(pos) as start, max(pos) + 1 as end_ from g group by contig, k")
def position_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.runs(t.points(spark, sf_dir)).withColumnRenamed("end", "end_")


@register(
    "interval_axis_audit",
    f"""with i as (select line_id as id, l_suppkey as contig, l_partkey as start, l_partkey + l_quantity::bigint as end_ from {t.LINES}), {_DEPTH},
x as (select contig, max(depth) as max_depth from sg where end_ is not null group by contig),
p as (select a.contig, a.id, count(*) as n from i a join i b on a.contig = b.contig and a.id <> b.id and a.start < b.end_ and b.start < a.end_ and (least(a.end_, b.end_) - greatest(a.start, b.start)) / least(a.end_ - a.start, b.end_ - b.start)::double > 0.5 group by a.contig, a.id),
s as (select contig, sum(n) / 2 as c, max(n) + 1 as m from p group by contig)
select x.contig, max_depth::bigint as max_depth, coalesce(c, 0)::bigint as conflicts, coalesce(m, 1)::bigint as max_conflicts from x left join s using (contig)""",
)
def axis_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = t.lines(spark, sf_dir).select(F.col("line_id").alias("id"), F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))
    out = iv.axis_audit(i, 0.5, width=64)
    return out.select("contig", *[F.col(c).cast("long").alias(c) for c in ("max_depth", "conflicts", "max_conflicts")])


@register("interval_genome_strata", f"""with {_LENGTHS}, c as (select *, coalesce(sum(length) over (order by contig rows between unbounded preceding and 1 preceding), 0) as f, sum(length) over () as total from l),
o as (select 'early' as stratum, 0 as off union all select 'middle', (select any_value(total) from c)::bigint // 2 union all select 'late', (select any_value(total) from c)::bigint - 500)
select stratum, contig, (off - f)::bigint as start, least(length, (off - f) + 500)::bigint as end_ from o join c on off >= f and off < f + length""")
def genome_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.genome_strata(_lengths(spark, sf_dir), 500).withColumnRenamed("end", "end_")
