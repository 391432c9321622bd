"""Catalog rows, contig names and their bindings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import scalars as sc


def catalog_statistics(df: DataFrame, name: str) -> DataFrame:
    """One row: rows, distinct names, rows in excess of one a name, names that repeat."""
    g = df.groupBy(name).agg(F.count("*").alias("_n"))
    return g.agg(F.sum("_n").alias("rows"), F.count("*").alias("names"), (F.sum("_n") - F.count("*")).alias("excess"), F.count_if(F.col("_n") > 1).alias("repeated"))


def seed_rows(df: DataFrame, key: str, order: str, modalities: str, others: Sequence[str]) -> DataFrame:
    """A row per key: the union of its modality arrays, sorted, and the other columns of its last row."""
    g = df.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(modalities)))).alias(modalities), F.min(order).alias("first_row"), *[F.max_by(c, order).alias(c) for c in others])
    return g.select(key, "first_row", modalities, *others)


def resolve_pairs(df: DataFrame) -> DataFrame:
    """(accession, partner, rule) from rows (accession, linked, biosample, isolate): the one linked haplotype.

    Exactly one link; else the only linked one that links back; else the only one of the same sample; else the only
    one of the same isolate. A partner needs the same sample or isolate, or a link back, as evidence of identity.
    """
    links = df.select("accession", "biosample", "isolate", F.explode("linked").alias("partner"))
    other = df.select(F.col("accession").alias("partner"), F.col("biosample").alias("_b"), F.col("isolate").alias("_i"), F.col("linked").alias("_l"))
    m = links.join(other, "partner")
    yes = lambda c: F.coalesce(c, F.lit(False))
    m = m.withColumns({"back": yes(F.array_contains("_l", F.col("accession"))), "sample": yes(F.col("biosample") == F.col("_b")), "same": yes(F.col("isolate") == F.col("_i"))})
    only = lambda c: F.when(F.count_if(c) == 1, F.max(F.when(c, F.col("partner"))))
    g = m.groupBy("accession").agg(only(F.lit(True)).alias("a"), only(F.col("back")).alias("b"), only(F.col("sample")).alias("c"), only(F.col("same")).alias("d"), F.collect_set(F.when(F.col("back") | F.col("sample") | F.col("same"), F.col("partner"))).alias("_ok"))
    partner = F.coalesce("a", "b", "c", "d")
    rule = F.when(F.col("a").isNotNull(), "only_link").when(F.col("b").isNotNull(), "reciprocal").when(F.col("c").isNotNull(), "biosample").when(F.col("d").isNotNull(), "isolate")
    return g.where(F.array_contains("_ok", partner)).select("accession", partner.alias("partner"), rule.alias("rule"))


def resolve_aliases(aliases: DataFrame, annotation: DataFrame, sequences: DataFrame) -> DataFrame:
    """(name, contig): a bijection from annotation names (name, length) to contigs (contig, length) of equal length.

    A name without an alias, an alias to an absent contig or to another length, and two names for a contig are errors
    when the rows are read; a name that is a contig stands for itself.
    """
    own = sequences.select("contig", F.col("length").alias("_have"))
    named = annotation.join(aliases.select(F.col("alias").alias("name"), F.col("contig").alias("_alias")), "name", "left")
    named = named.join(own.select(F.col("contig").alias("name"), F.lit(True).alias("_self")), "name", "left")
    target = named.withColumn("contig", F.coalesce("_alias", F.when(F.col("_self"), F.col("name")))).join(own, "contig", "left")
    twice = F.count("*").over(Window.partitionBy("contig")) > 1
    fault = F.when(F.col("contig").isNull(), "undeclared name ").when(F.col("_have").isNull(), "absent contig for ").when(F.col("_have") != F.col("length"), "other length for ").when(twice, "two names for one contig: ")
    return target.select("name", F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.col("name")))).otherwise(F.col("contig")).alias("contig"))


def binding_status(same_accession: Column, declared: Column, exact: Column, alias: Column, farthest: Column, length: Column, circular: Column) -> Column:
    """How an annotation fits an assembly, in order; features of a circular contig may reach to twice its length."""
    outside = farthest > F.when(circular, 2 * length).otherwise(length)
    return F.when(~same_accession, "ACCESSION_MISMATCH").when(F.coalesce(outside, F.lit(False)) | ~(exact | alias), "DICTIONARY_MISMATCH").when(exact & declared, "EXACT_DICTIONARY").otherwise("VALIDATED_ALIAS")


def dictionary_rows(observed: DataFrame, declared: DataFrame, aliases: DataFrame, contigs: DataFrame) -> DataFrame:
    """(name, contig, state) of every name observed or declared: EXACT, VALIDATED_ALIAS or UNRESOLVED."""
    names = observed.select("name").unionByName(declared.select("name")).distinct()
    own = contigs.select(F.col("contig").alias("name"), F.col("contig").alias("_exact")).distinct()
    m = names.join(own, "name", "left").join(aliases.select(F.col("alias").alias("name"), F.col("contig").alias("_alias")), "name", "left")
    return m.select("name", F.coalesce("_exact", "_alias").alias("contig"), F.when(F.col("_exact").isNotNull(), "EXACT").when(F.col("_alias").isNotNull(), "VALIDATED_ALIAS").otherwise("UNRESOLVED").alias("state"))


def without_contigs(df: DataFrame, names: DataFrame, aliases: DataFrame, contig: str = "contig") -> DataFrame:
    """Rows off the named contigs, whatever alias they are named by; aliases is (group, alias)."""
    groups = aliases.join(names.select(F.col("name").alias("alias")), "alias", "left_semi").select("group").distinct()
    gone = aliases.join(groups, "group", "left_semi").select(F.col("alias").alias(contig)).unionByName(names.select(F.col("name").alias(contig))).distinct()
    return df.join(gone, contig, "left_anti")


def parse_region(text: Column, widest: int = 10_000_000) -> Column:
    """struct<contig, start, end> of 'contig:first-last' (one-based); reversed or too wide regions are errors."""
    n = lambda i: F.regexp_extract(text, r"^(.+):([0-9]+)-([0-9]+)$", i)
    start, end = n(2).try_cast("bigint") - 1, n(3).try_cast("bigint")
    fine = (start >= 0) & (start < end) & (end - start <= widest)
    whole = F.struct(n(1).alias("contig"), start.alias("start"), end.alias("end"))
    return F.when(F.coalesce(fine, F.lit(False)), whole).otherwise(F.raise_error(F.concat(F.lit("bad region "), F.coalesce(text, F.lit("null")))))


def clipped(df: DataFrame, start: int, end: int) -> DataFrame:
    """Intervals cut to a window; those outside are gone."""
    return df.withColumns({"start": F.greatest("start", F.lit(start)), "end": F.least("end", F.lit(end))}).where("start < end")


def owned_records(df: DataFrame, core: int) -> DataFrame:
    """Distinct (contig, pos, ref, alts) with the one disjoint core window that owns each (one-based positions)."""
    return df.select("contig", "pos", "ref", "alts").distinct().withColumn("core", F.floor((F.col("pos") - 1) / core))


def merged_telemetry(baseline: DataFrame, sidecar: DataFrame, accounting: DataFrame) -> DataFrame:
    """Jobs of both tables with their accounting row: largest memory, and where it came from.

    A job without a row, that did not complete, or without any measure is an error when read.
    """
    jobs = baseline.withColumn("_from", F.lit("baseline")).unionByName(sidecar.withColumn("_from", F.lit("sidecar")), True)
    m = jobs.join(accounting.select("job", F.col("State").alias("_state"), F.col("max_rss_mib").alias("_rss")), "job", "left")
    rss = F.coalesce("_rss", "max_rss_mib")
    fault = F.when(F.col("_state").isNull(), "no accounting of ").when(F.col("_state") != "COMPLETED", "not completed: ").when(rss.isNull(), "not measured: ")
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.col("job").cast("string"))).cast("double")).otherwise(rss)
    return m.select("job", "_from", checked.alias("max_rss_mib"), F.when(F.col("_rss").isNotNull(), "accounting").otherwise("record").alias("source")).withColumnRenamed("_from", "table")


def text_fallback(sources: Sequence[Column], pattern: str) -> Column:
    """The first of several texts in which a pattern's first group is found."""
    found = [F.regexp_extract(s, pattern, 1) for s in sources]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def native_linkage(name: Column, date: Column, total: Column, rows: Column, accession: Column) -> Column:
    """An annotation that is named and dated, whose page is complete, and whose rows all carry the accession."""
    named = (sc.slug(F.coalesce(name, F.lit(""))) != "") & date.isNotNull()
    return named & (total == F.size(rows)) & F.forall(rows, lambda r: F.coalesce(r == accession, F.lit(False)))


def scenario_rows(df: DataFrame, scenarios: dict[str, float], value: str) -> DataFrame:
    """A row per row and scenario, the value multiplied by its factor. The scenarios are a short list."""
    s = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(f).alias("_f")) for n, f in scenarios.items()]))
    return df.withColumn("_s", s).select(*df.columns, F.col("_s.scenario").alias("scenario"), (F.col(value) * F.col("_s._f")).alias("projected")).drop("_s")
