"""Queries of filters, joins, selections and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import documents as dc
from strandframe.functions import scalars as sc
from strandframe.operators import ledger as lg
from strandframe.operators import selection as se
from strandframe.plans._tables import read
from strandframe.plans.registry import register


@register("scalar_finite", "with x as (select event_id, case event_id % 6 when 0 then 'NA' when 1 then ' ' when 2 then 'abc' when 3 then 'inf' when 4 then value::varchar else 'nan' end as t, value from events) select event_id, case when event_id % 6 = 4 then value else -1.0 end as v from x")
def finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    t = F.when(k == 0, "NA").when(k == 1, " ").when(k == 2, "abc").when(k == 3, "inf").when(k == 4, F.col("value").cast("string")).otherwise("nan")
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(sc.finite(t), F.lit(-1.0)).alias("v"))


@register("scalar_multi_values", "with x as (select doc_id, lang || ';;' || source || '; ' || lang as cell from documents) select doc_id, len(list_filter(list_transform(string_split(cell, ';'), lambda x: trim(x)), lambda x: x <> ''))::int as n, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(cell, ';'), lambda x: trim(x)), lambda x: x <> ''))), ';') as names from x")
def multi_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat("lang", F.lit(";;"), "source", F.lit("; "), "lang")
    return read(spark, sf_dir, "documents").select("doc_id", sc.multi_count(cell).alias("n"), sc.sorted_unique(cell).alias("names"))


@register("scalar_multi_sum", "select l_orderkey, l_linenumber, l_partkey, sum(l_partkey + l_suppkey)::bigint as total from lineitem group by 1, 2, 3")
def multi_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.col("l_partkey").cast("string"), F.lit("; ;"), F.col("l_suppkey").cast("string"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", sc.multi_sum(cell).alias("s")).groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.sum("s").alias("total"))


@register("scalar_slug", "select page_id, regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') as part, regexp_replace(url, '^(ftp|http|rsync)://', 'https://') as secure from pages")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", sc.slug(F.col("url")).alias("slug"), sc.safe_component(F.col("url")).alias("part"), sc.https(F.col("url")).alias("secure"))


@register("scalar_attributes", "select p_partkey, p_name as name, p_brand as brand from part")
def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    text = F.concat(F.lit("ID="), F.replace(F.url_encode("p_name"), F.lit("+"), F.lit("%20")), F.lit('; brand "'), F.col("p_brand"), F.lit('";'))
    a = sc.attributes(text)
    return p.select("p_partkey", a["ID"].alias("name"), a["brand"].alias("brand"))


@register("scalar_json_fields", "select event_id, json_extract_string(props, '$.' || (json_keys(props))[1]) as first from events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    return read(spark, sf_dir, "events").select("event_id", F.element_at(m, F.element_at(F.json_object_keys("props"), 1)).alias("first"))


@register("scalar_memory_sizes", "select o_orderkey, case o_orderkey % 4 when 0 then n / 1024.0 when 1 then n::double when 2 then n * 1024.0 else n * 1048576.0 end as mib from (select o_orderkey, o_custkey as n from orders)")
def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    text = F.concat(F.col("o_custkey").cast("string"), F.element_at(F.array(*[F.lit(u) for u in "KMGT"]), (F.col("o_orderkey") % 4 + 1).cast("int")))
    return o.select("o_orderkey", sc.memory_mib(text).alias("mib"))


@register("scalar_confidence_tier", """with e as (select c_custkey, case c_custkey % 11 when 0 then false when 1 then null else true end as h, case c_custkey % 7 when 0 then false when 1 then null else true end as s from customer)
select c_custkey, case when h = false then 'X' when h is null then 'C' when s then 'A' when s is null then 'C' else 'B' end as tier from e""")
def tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = lambda n: F.when(F.col("c_custkey") % n == 0, F.lit(False)).when(F.col("c_custkey") % n == 1, F.lit(None).cast("boolean")).otherwise(F.lit(True))
    return read(spark, sf_dir, "customer").select("c_custkey", sc.confidence_tier([three(11), F.lit(True)], [three(7), F.lit(True)]).alias("tier"))


@register("scalar_all_reasons", "select o_orderkey, array_to_string(list_filter([case when o_totalprice < 100000 then 'small' end, case when o_orderstatus <> 'F' then 'open' end, case when o_custkey % 2 = 0 then 'even' end], lambda x: x is not null), ',') as reasons, case when o_totalprice < 100000 then 'small' when o_orderstatus <> 'F' then 'open' when o_custkey % 2 = 0 then 'even' else 'eligible' end as first from orders")
def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = {"small": F.col("o_totalprice") < 100000, "open": F.col("o_orderstatus") != "F", "even": F.col("o_custkey") % 2 == 0}
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(lg.all_reasons(c), ",").alias("reasons"), lg.first_reason(c, "eligible").alias("first"))


@register("scalar_quality_verdict", "with x as (select l_orderkey, l_linenumber, l_partkey, l_quantity as qv, l_tax * 10 as a, l_discount * 10 as b, l_extendedprice / 40000 as ratio from lineitem), v as (select *, case when qv < 20 then 'low_quality' when a > 0.5 and b > 0.5 then 'contradicted' when ratio not between 0.8 and 1.25 then 'inconsistent' else 'supported' end as verdict from x) select verdict, count(*) as n from v group by 1")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = sc.quality_verdict(F.col("l_quantity"), F.col("l_tax") * 10, F.col("l_discount") * 10, F.col("l_extendedprice") / 40000, F.lit(1.0))
    return read(spark, sf_dir, "lineitem").groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


@register("scalar_failure_codes", "select case when lower(text) like '%time limit%' then 'TIMEOUT' when regexp_matches(lower(text), 'checksum|digest|sha-?256|md5') then 'CHECKSUM' when regexp_matches(lower(text), 'no such file|not found|missing') then 'MISSING_INPUT' when regexp_matches(lower(text), 'oom|connection|network') then 'SPECIAL' else 'OTHER' end as code, count(*) as n from documents where not regexp_matches(lower(text), 'oom|connection|network|out of memory|cannot allocate|timed? ?out|time ?limit') group by 1")
def failure_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where(~F.lower("text").rlike("oom|connection|network|out of memory|cannot allocate|timed? ?out|time ?limit"))
    return d.groupBy(sc.failure_code(F.col("text")).alias("code")).agg(F.count("*").alias("n"))


@register("scalar_resources", "select c_custkey, round_even(greatest(8, least(2000, 8 + 120 * g)), 2) as cpu, round_even(greatest(16, least(512, 16 + 48 * g)), 2) as memory, round_even(greatest(20, least(4000, 20 + 90 * g)), 2) as scratch from (select c_custkey, c_custkey * 1000003 / 1e9 as g from customer)")
def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    cpu, memory_, scratch = sc.predicted_resources(F.col("c_custkey") * 1000003)
    return read(spark, sf_dir, "customer").select("c_custkey", cpu.alias("cpu"), memory_.alias("memory"), scratch.alias("scratch"))


@register("select_best_per_key", "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1")
def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.best(read(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


_T = "t as (select o_custkey as gene_id, o_orderkey as id, floor(o_totalprice)::bigint as length, o_orderstatus = 'F' as valid, o_orderkey % 97 = 0 as exception from orders)"


@register("select_canonical_transcript", f"with {_T} select gene_id, id::varchar as transcript_id from t where not exception and valid qualify row_number() over (partition by gene_id order by length desc, id::varchar) = 1")
def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gene_id"), F.col("o_orderkey").cast("string").alias("transcript_id"), F.floor("o_totalprice").alias("length"), (F.col("o_orderstatus") == "F").alias("valid"), F.lit(False).alias("canonical"), (F.col("o_orderkey") % 97 == 0).alias("exception"))
    return se.canonical_transcripts(o).select("gene_id", "transcript_id")


@register("select_assembly_rank", """with a as (select p_brand, p_partkey, (case when p_partkey % 3 = 0 then 'GCF_' else 'GCA_' end) || lpad(p_partkey::varchar, 9, '0') as accession, p_partkey % 5 = 0 as suppressed, ['reference genome', 'representative genome', 'na', 'other'][p_partkey % 4 + 1] as category, ['Complete Genome', 'Chromosome', 'Scaffold', 'Contig'][p_size % 4 + 1] as level, date '2020-01-01' + (p_partkey % 700)::int as day from part)
select p_brand, accession from a qualify row_number() over (partition by p_brand order by suppressed::int, case category when 'reference genome' then 0 when 'representative genome' then 1 when 'na' then 2 else 3 end, case when accession like 'GCF_%' then 0 else 1 end, case level when 'Complete Genome' then 0 when 'Chromosome' then 1 when 'Scaffold' then 2 else 3 end, day desc, accession) = 1""")
def assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))
    k = F.col("p_partkey")
    a = read(spark, sf_dir, "part").select("p_brand", F.concat(F.when(k % 3 == 0, "GCF_").otherwise("GCA_"), F.lpad(k.cast("string"), 9, "0")).alias("accession"), (k % 5 == 0).alias("suppressed"), pick(["reference genome", "representative genome", "na", "other"], k % 4).alias("refseq_category"), pick(["Complete Genome", "Chromosome", "Scaffold", "Contig"], F.col("p_size") % 4).alias("assembly_level"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 700).cast("int")), "yyyy/MM/dd").alias("release_date"))
    return se.best(a, ["p_brand"], se.assembly_order()).select("p_brand", "accession")


@register("select_hash_sample", "with c as (select c_nationkey, count(*) as n from customer group by 1 having count(*) >= 20 order by n desc, c_nationkey::varchar limit 1) select c_custkey, sha256('set' || chr(0) || c_nationkey::varchar || chr(0) || c_custkey::varchar) as digest from customer semi join c using (c_nationkey) order by digest limit 20")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.hash_sample(read(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "set", 20).select("c_custkey", "digest")


@register("select_until_target", "select o_custkey, o_orderkey from (select *, coalesce(sum(floor(o_totalprice)::bigint) over (partition by o_custkey order by md5(o_orderkey::varchar) rows between unbounded preceding and 1 preceding), 0) as before_ from orders) where before_ < 500000")
def until_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("size", F.floor("o_totalprice"))
    return se.until_target(o, "size", [F.md5(F.col("o_orderkey").cast("string"))], 500_000, ["o_custkey"]).select("o_custkey", "o_orderkey")


@register("select_latest_attempts", "select o_custkey, o_orderkey as job_id from orders qualify row_number() over (partition by o_custkey order by case o_orderstatus when 'O' then 0 when 'F' then 1 else 2 end, o_orderkey desc) = 1")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "RUNNING").when(F.col("o_orderstatus") == "F", "FAILED").otherwise("PENDING")
    o = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("job_id"), state.alias("state"), F.lit(True).alias("observed"))
    return se.latest_attempts(o, ["o_custkey"]).select("o_custkey", "job_id")


@register("select_multiplicity", "select doc_id, count(*) over (partition by text) as multiplicity from documents")
def multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.with_multiplicity(read(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("k")), "k").select("doc_id", "multiplicity")


@register("join_strict_inner", "select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey")
def strict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    used = s.select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    whole = lg.strict_join(used, n, ["n_nationkey"])
    return s.join(whole, s["s_nationkey"] == whole["n_nationkey"]).select("s_suppkey", "n_name")


@register("join_case_insensitive", "select c.c_custkey, count(*) as n from customer c join customer d on lower(trim(c.c_mktsegment)) = lower(trim(d.c_mktsegment)) and c.c_nationkey = d.c_nationkey group by 1")
def case_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.lower(F.trim("c_mktsegment")).alias("k"))
    return c.join(c.groupBy("k", "c_nationkey").agg(F.count("*").alias("n")), ["k", "c_nationkey"]).select("c_custkey", "n")


@register("join_semi_anti", "select 'with' as side, count(*) as n from customer where c_custkey in (select o_custkey from orders) union all select 'without', count(*) from customer where c_custkey not in (select o_custkey from orders)")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    n = lambda how, side: c.join(o, "c_custkey", how).agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return n("left_semi", "with").unionByName(n("left_anti", "without"))


@register("set_operations", "select 'intersect' as op, count(*) as n from (select c_nationkey from customer intersect select s_nationkey from supplier) union all select 'except', count(*) from (select l_partkey from lineitem where l_linenumber = 1 except select l_partkey from lineitem where l_linenumber = 2) union all select 'union', count(*) from (select c_nationkey from customer union all select s_nationkey from supplier)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    li = read(spark, sf_dir, "lineitem")
    p = lambda n: li.where(F.col("l_linenumber") == n).select("l_partkey")
    count = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(c.intersect(s), "intersect").unionByName(count(p(1).subtract(p(2)), "except")).unionByName(count(c.unionByName(s), "union"))


_ORDER = {
    "type": "object", "required": ["key", "status"], "additionalProperties": False,
    "properties": {"status": {"enum": ["F", "O"]}, "key": {"type": "integer", "minimum": 100}, "priority": {"type": "string", "pattern": "^[1-3]"}, "items": {"type": "array", "uniqueItems": True, "items": {"maximum": 3}}},
}


@register(
    "json_schema_faults",
    """with f as (select unnest([case when o_orderstatus not in ('F', 'O') then {'pointer': '/status', 'rule': 'enum'} end, case when o_orderkey < 100 then {'pointer': '/key', 'rule': 'minimum'} end, case when o_orderpriority[1] not in ('1', '2', '3') then {'pointer': '/priority', 'rule': 'pattern'} end,
 case when o_custkey % 5 = o_custkey % 3 then {'pointer': '/items', 'rule': 'uniqueItems'} end, case when o_custkey % 5 > 3 then {'pointer': '/items/0', 'rule': 'maximum'} end, case when o_custkey % 7 = 0 then {'pointer': '/extra', 'rule': 'additionalProperties'} end]) as x from orders)
select x.pointer as pointer, x.rule as rule, count(*) as n from f where x is not null group by 1, 2""",
)
def json_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON documents against a schema."""
    text = lambda c: F.col(c).cast("string")
    doc = F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('","key":'), text("o_orderkey"), F.lit(',"priority":"'), "o_orderpriority", F.lit('","items":['), (F.col("o_custkey") % 5).cast("string"), F.lit(","), (F.col("o_custkey") % 3).cast("string"), F.lit("]"), F.when(F.col("o_custkey") % 7 == 0, ',"extra":1}').otherwise("}"))
    return dc.faults(read(spark, sf_dir, "orders").withColumn("doc", doc), "o_orderkey", "doc", _ORDER).groupBy("pointer", "rule").agg(F.count("*").alias("n"))


@register("json_canonical_digest", """select event_id, sha256('{"a":[{"k":' || event_id || ',"t":"' || event_type || '"}],"b":' || props[7:-2] || '}') as digest from events""")
def json_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON with keys out of order, a digest of their own and blanks, digested in canonical form."""
    e = read(spark, sf_dir, "events")
    doc = F.concat(F.lit('{ "self": "x", "b": '), F.regexp_extract("props", r":\s*([^}]*)}", 1), F.lit(', "a": [ {"t" : "'), "event_type", F.lit('", "k": '), F.col("event_id").cast("string"), F.lit("} ]}"))
    return dc.digests(e.withColumn("doc", doc), "event_id", "doc", without="self").select("event_id", F.col("sha256").alias("digest"))
