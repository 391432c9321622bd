"""Queries that write a test table in a file format to the shared folder, read it back and count what came."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators._folders import shared_folder
from strandframe.plans._tables import read
from strandframe.plans.registry import register
from strandframe.sources import variants


def place(spark: SparkSession, name: str) -> str:
    """A folder of its own in the session's shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_CONTIGS = {f"chr{i}": 1 << 30 for i in range(25)}


@register(
    "variant_binary_files",
    """with v as (select 'chr' || (l_suppkey % 25) as contig, l_orderkey as pos0, ['A', 'C', 'G', 'T'][(l_partkey % 4 + 1)::int] as ref,
  case when l_linenumber = 1 then '' when l_linenumber = 2 then '<NON_REF>' when l_linenumber = 3 then 'AT,G' else 'TG' end as alts, case when l_returnflag = 'R' then 'q10' else '' end as filters,
  case when l_linenumber = 2 then l_orderkey + l_quantity::bigint end as end_, case l_linestatus when 'F' then '0|1' else './.' end as first, case when l_linenumber = 3 then '2/1' else '0/0' end as second from lineitem)
select contig, ref, alts, filters, first, second, count(*) as n, sum(pos0)::bigint as positions, coalesce(sum(end_), 0)::bigint as ends from v group by all""",
)
def binary_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    alts = F.when(n == 1, F.array().cast("array<string>")).when(n == 2, F.array(F.lit("<NON_REF>"))).when(n == 3, F.array(F.lit("AT"), F.lit("G"))).otherwise(F.array(F.lit("TG")))
    ends = F.when(n == 2, F.create_map(F.lit("END"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    first = F.when(F.col("l_linestatus") == "F", "0|1").otherwise("./.")
    v = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("chr"), F.col("l_suppkey") % 25).alias("contig"), F.col("l_orderkey").alias("pos0"), F.element_at(F.array(*[F.lit(b) for b in "ACGT"]), (F.col("l_partkey") % 4 + 1).cast("int")).alias("ref"), alts.alias("alts"),
        F.when(F.col("l_returnflag") == "R", F.array(F.lit("q10"))).otherwise(F.array().cast("array<string>")).alias("filters"), ends.alias("info"), F.create_map(F.lit("s1"), first, F.lit("s2"), F.when(n == 3, "2/1").otherwise("0/0")).alias("genotypes"),
    )
    at = place(spark, "variants")
    variants.write_variants(v, at, _CONTIGS, ["s1", "s2"], ["q10"])
    back = variants.read_variants(spark, at, split_bytes=1 << 18)
    text = lambda c: F.array_join(c, ",").alias(c)
    keys = ["contig", "ref", text("alts"), text("filters"), F.col("genotypes")["s1"].alias("first"), F.col("genotypes")["s2"].alias("second")]
    end = F.col("info")["END"].cast("long")
    return back.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("pos0").alias("positions"), F.coalesce(F.sum(end), F.lit(0)).alias("ends"))
