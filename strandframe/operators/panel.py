"""Coding panels: coverage of many sets of features at once, classes of callable bases, transcripts judged one by one."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators import intervals as iv
from strandframe.operators import resampling
from strandframe.operators import sequence as sq

#: The stop codons of genetic code table 1.
STOPS = ("TAA", "TAG", "TGA")


def clipped(features: DataFrame, mapping: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep, contig, start, end): what of each feature lies in the merged mapping, a row for each interval it meets."""
    met = iv.overlaps(features.select(*keep, "contig", "start", "end"), iv.merge(mapping))
    return met.select(*keep, "contig", F.greatest("start", "b_start").alias("start"), F.least("end", "b_end").alias("end"))


def set_coverage(features: DataFrame, mapping: DataFrame, group: str = "set", name: str = "id") -> DataFrame:
    """(group, features, overlapped, covered, bases, callable_bases, lost_bases) of features (group, name, contig, start, end).

    overlapped features meet the mapping somewhere, covered ones lie wholly in one of its merged intervals; bases are
    those of a group's union. One range join serves all groups: its clipped pieces are summed by feature, and merged by
    group. A name in several rows of a group is one feature, covered if all of its rows are.
    """
    rows = features.select(group, name, "contig", "start", "end").distinct()
    pieces = clipped(rows.withColumnsRenamed({"start": "_s", "end": "_e"}).withColumns({"start": F.col("_s"), "end": F.col("_e")}), mapping, [group, name, "_s", "_e"])
    spans = pieces.groupBy(group, name, "contig", F.col("_s").alias("start"), F.col("_e").alias("end")).agg(F.sum(F.col("end") - F.col("start")).alias("_b"))
    each = rows.join(spans, [group, name, "contig", "start", "end"], "left")
    per = each.groupBy(group, name).agg((F.count("_b") > 0).alias("_o"), F.bool_and(F.coalesce(F.col("_b") == F.col("end") - F.col("start"), F.lit(False))).alias("_c"))
    counts = per.groupBy(group).agg(F.count("*").alias("features"), F.count_if("_o").alias("overlapped"), F.count_if("_c").alias("covered"))
    union = iv.measure(rows, [group, "contig"]).groupBy(group).agg(F.sum("bases").alias("bases"))
    open_ = iv.measure(pieces.select(group, "contig", "start", "end"), [group, "contig"]).groupBy(group).agg(F.sum("bases").alias("callable_bases"))
    out = counts.join(union, group).join(open_, group, "left").withColumn("callable_bases", F.coalesce("callable_bases", F.lit(0)))
    return out.withColumn("lost_bases", F.col("bases") - F.col("callable_bases"))


def acgt_only(spans: DataFrame, table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, contig, start, end): the spans' union less bases that are none of ACGT."""
    whole = iv.merge(spans, [*keys, "contig"])
    gaps = sq.non_acgt(table)
    if not keys:
        return iv.subtract(whole, gaps)
    named = whole.select(*keys, "contig").distinct().join(gaps, "contig")
    return iv.subtract(whole, named, [*keys, "contig"])


def class_blocks(classes: DataFrame, snvs: DataFrame, block: int, group: str = "class") -> DataFrame:
    """(group, contig, block, den, num): callable bases of disjoint class intervals by block, and the distinct SNVs on them."""
    den = iv.split_at_blocks(classes, block, [group, "contig"]).withColumnRenamed("bases", "den")
    sites = snvs.select("contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")).distinct()
    met = iv.overlaps(sites, classes.select(group, "contig", "start", "end")).groupBy(group, "contig", F.floor(F.col("start") / block).alias("block")).agg(F.count("*").alias("num"))
    return den.join(met, [group, "contig", "block"], "left").withColumn("num", F.coalesce("num", F.lit(0)))


def class_diversity(blocks: DataFrame, dataset: str, replicates: int, group: str = "class") -> DataFrame:
    """(group, numerator, denominator, estimate, ci_low, ci_high, standard_error, replicates, blocks): a block bootstrap a class.

    The stream's seed is the first 8 bytes of SHA-256 over dataset:class; classes, a short list, run one after the other.
    """
    out = None
    for r in blocks.groupBy(group).agg(F.sum("num").alias("numerator"), F.sum("den").alias("denominator")).where("denominator > 0").orderBy(group).collect():
        seed = int(hashlib.sha256(f"{dataset}:{r[group]}".encode()).hexdigest()[:16], 16)
        one = resampling.bootstrap_ratio(blocks.where(F.col(group) == r[group]), replicates, seed, ["contig", "block"])
        one = one.select(F.lit(r[group]).alias(group), F.lit(r.numerator).alias("numerator"), F.lit(r.denominator).alias("denominator"), *one.columns)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no class has a callable base")
    return out


def variant_features(variants: DataFrame, features: DataFrame, lists: Sequence[str], keys: Sequence[str] = ("contig", "pos", "ref", "alt")) -> DataFrame:
    """(keys, lists): for every variant on a feature, the sorted distinct names of all features over it, comma-joined.

    A feature's cell may itself be a comma-joined list; empty names are left out.
    """
    at = variants.select(*keys, F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")).distinct()
    met = iv.overlaps(at, features.select("contig", "start", "end", *lists))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(F.split(F.coalesce(F.col(c).cast("string"), F.lit("")), ","))), lambda x: x != ""))), ",")
    return met.groupBy(*keys).agg(*[names(c).alias(c) for c in lists])


def transcript_errors(segments: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """(transcript_id, error, cds, terminal_stop): the first rule a transcript breaks, as text, else its coding sequence.

    Segments are (transcript_id, contig, strand, start, end, phase). Rules in order: bad_phase (none of 0, 1, 2),
    several_contigs_or_strands, duplicate_segment, overlapping_segments, outside_contig, phase_chain, partial_codon,
    ambiguous_base, internal_stop. Nothing raises: each transcript is judged alone, in a few joins for all of them.
    """
    by = Window.partitionBy("transcript_id")
    before = F.max("end").over(by.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    again = F.lag(F.struct("start", "end")).over(by.orderBy("start", "end"))
    shape = segments.withColumns({"_over": F.col("start") < before, "_same": again.eqNullSafe(F.struct("start", "end"))})
    rule = F.when(F.max(F.coalesce((~F.col("phase").isin(0, 1, 2)).cast("int"), F.lit(1))) == 1, "bad_phase").when(F.count_distinct("contig", "strand") > 1, "several_contigs_or_strands")
    rule = rule.when(F.bool_or(F.col("_same")), "duplicate_segment").when(F.bool_or(F.coalesce("_over", F.lit(False))), "overlapping_segments")
    first = shape.groupBy("transcript_id").agg(rule.alias("error"), F.sum(F.col("end") - F.col("start")).alias("bases"))
    sound = segments.join(first.where("error is null").select("transcript_id"), "transcript_id", "left_semi")
    chain = sq.phase_chain(sq.ordered_segments(sound)).select("transcript_id", "reason")
    put = sq.coding_sequences(sq.ordered_segments(sound), table, size)
    start = F.min_by("phase", F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start")))
    lead = sound.groupBy("transcript_id").agg(start.alias("_lead"))
    both = first.join(put, "transcript_id", "left").join(chain, "transcript_id", "left").join(lead, "transcript_id", "left")
    stop = lambda c: c.isin(*STOPS)
    triples = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length("cds") / 3) - 1, F.lit(0)).cast("int")), lambda i: F.substring(F.col("cds"), i * 3 + 1, F.lit(3)))
    coded = both.withColumn("_t", triples)
    error = F.coalesce(
        "error", F.when(F.col("cds").isNull() | (F.length("cds") < F.col("bases") - F.col("_lead")), "outside_contig"), F.when(F.col("reason") == "phase", "phase_chain"), F.when((F.length("cds") % 3 != 0) | (F.length("cds") == 0), "partial_codon"),
        F.when(F.col("cds").rlike("[^ACGT]"), "ambiguous_base"), F.when(F.exists(F.slice("_t", F.lit(1), F.greatest(F.size("_t") - 1, F.lit(0))), stop), "internal_stop"),
    )
    ended = F.coalesce(stop(F.element_at("_t", -1)), F.lit(False))
    out = coded.withColumns({"error": error, "_end": ended})
    kept = F.when(F.col("error").isNull(), F.when(F.col("_end"), F.expr("substring(cds, 1, length(cds) - 3)")).otherwise(F.col("cds")))
    return out.select("transcript_id", "error", kept.alias("cds"), (F.col("error").isNull() & F.col("_end")).alias("terminal_stop"))


def validated_canonical(transcripts: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((gene_id, transcript_id, cds, terminal_stop), (reason, transcripts)): one translated transcript a gene, and what was left out.

    transcripts: gene_id, transcript_id, canonical, exception. Exceptions go first. The provider's canonical transcript
    is taken alone, and its error is fatal when read, as are two of them in a gene; else the longest without an error,
    ties by the id's bytes. Genes with none left are counted as gene_without_valid_cds, other reasons count transcripts.
    """
    rows = transcripts.join(errors, "transcript_id").withColumns({"exception": F.coalesce("exception", F.lit(False)), "canonical": F.coalesce("canonical", F.lit(False))})
    gene = Window.partitionBy("gene_id")
    named = F.count_if(F.col("canonical") & ~F.col("exception")).over(gene)
    fatal = F.when(named > 1, F.concat(F.lit("several provider-canonical transcripts of "), "gene_id")).when(F.col("canonical") & ~F.col("exception") & F.col("error").isNotNull(), F.concat(F.lit("provider-canonical transcript "), "transcript_id", F.lit(" is invalid: "), "error"))
    known = rows.withColumns({"_n": named, "_fatal": fatal})
    pool = known.where(~F.col("exception") & ((F.col("_n") == 0) | F.col("canonical")))
    order = gene.orderBy(F.col("error").isNotNull(), F.length("cds").desc_nulls_last(), F.encode("transcript_id", "UTF-8"))
    checked = pool.withColumn("error", F.when(F.col("_fatal").isNotNull(), F.raise_error(F.col("_fatal")).cast("string")).otherwise(F.col("error")))
    chosen = checked.withColumn("_r", F.row_number().over(order)).where("_r = 1 and error is null").select("gene_id", "transcript_id", "cds", "terminal_stop")
    lost = known.select("gene_id").distinct().join(chosen.select("gene_id"), "gene_id", "left_anti").agg(F.count("*").alias("transcripts")).select(F.lit("gene_without_valid_cds").alias("reason"), "transcripts")
    odd = known.where("exception").agg(F.count("*").alias("transcripts")).select(F.lit("annotated_translation_exception").alias("reason"), "transcripts")
    bad = pool.where("error is not null and not canonical").agg(F.count("*").alias("transcripts")).select(F.lit("invalid_candidate_transcript").alias("reason"), "transcripts")
    return chosen, lost.unionByName(odd).unionByName(bad).where("transcripts > 0")


def exact_fourfold_sites(segments: DataFrame, table: DataFrame, size: int, declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((contig, pos), (transcript_id, reason)): fourfold sites of the transcripts that stand alone, called together.

    segments are of the canonical transcripts. declared (transcript_id, reason) are left out beforehand and must all be
    there; of the rest each is judged alone and leaves with its error as the reason. If nobody is left, that is an error.
    """
    spark = segments.sparkSession
    out = spark.createDataFrame([], "transcript_id string, reason string") if declared is None else declared.select(F.col("transcript_id").cast("string").alias("transcript_id"), "reason")
    if unknown := out.join(segments.select("transcript_id").distinct(), "transcript_id", "left_anti").limit(5).collect():
        raise ValueError(f"declared exclusions are absent: {sorted(r.transcript_id for r in unknown)}")
    rest = segments.join(out.select("transcript_id"), "transcript_id", "left_anti")
    judged = transcript_errors(rest, table, size)
    fine = judged.where("error is null").select("transcript_id", "cds")
    if not fine.limit(1).count():
        raise ValueError("every canonical transcript is excluded")
    kept = sq.ordered_segments(rest.join(fine.select("transcript_id"), "transcript_id", "left_semi"))
    return sq.fourfold_sites(kept, fine), out.unionByName(judged.where("error is not null").select("transcript_id", F.col("error").alias("reason")))
