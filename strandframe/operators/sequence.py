"""Sequences in chunks, codons, fourfold sites, consensus and binning.

A sequence is a table (contig, chunk_start, seq) of fixed-size chunks; no operator needs a whole contig in one row.
Positions are zero-based.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators import intervals as iv

#: Codons in the order of these bases, their amino acids in genetic code 1.
BASES, AMINO = "TCAG", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: AMINO[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
FOURFOLD = frozenset(c for c in CODONS if CODONS[c] != "*" and len({CODONS[c[:2] + b] for b in BASES}) == 1)
#: Two-base ambiguity codes.
IUPAC = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}


def reverse_complement(seq: str | Column) -> Column:
    return F.reverse(F.translate(seq if isinstance(seq, Column) else F.col(seq), "ACGTNacgtn", "TGCANtgcan"))


def codon_table(spark) -> DataFrame:
    """(codon, amino, fourfold): 64 rows, safe to send everywhere."""
    return spark.createDataFrame([(c, a, c in FOURFOLD) for c, a in CODONS.items()], "codon string, amino string, fourfold boolean")


def codons(df: DataFrame, seq: str) -> DataFrame:
    """df with a row per codon: codon_index from 0 and codon; a last part of a codon is left out."""
    return df.select("*", F.posexplode(triplets(F.col(seq))).alias("codon_index", "codon"))


def triplets(seq: Column) -> Column:
    """The whole codons of a sequence, in one pass."""
    return F.regexp_extract_all(seq, F.lit("(?s)..."), F.lit(0))


def translate(seq: str | Column) -> Column:
    """Protein of a coding sequence; a codon that is not of the table is an error, a terminal stop is trimmed."""
    c = seq if isinstance(seq, Column) else F.col(seq)
    table = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    parts = triplets(c)
    letters = F.transform(parts, lambda x: F.coalesce(F.element_at(table, x), F.raise_error(F.concat(F.lit("bad codon "), x)).cast("string")))
    return F.when(F.length(c) >= 3, F.regexp_replace(F.array_join(letters, ""), r"\*$", "")).otherwise("")


def translation_state(seq: str | Column) -> Column:
    """'ok', or why a coding sequence is not valid: length, symbol, internal_stop."""
    c = seq if isinstance(seq, Column) else F.col(seq)
    stops = [k for k, a in CODONS.items() if a == "*"]
    inner = F.substring(c, F.lit(1), F.length(c) - 3)
    inner_codons = triplets(inner)
    return F.when((F.length(c) == 0) | (F.length(c) % 3 != 0), "length").when(~c.rlike("^[ACGT]*$"), "symbol").when(F.exists(inner_codons, lambda x: x.isin(stops)), "internal_stop").otherwise("ok")


def symbol_counts(df: DataFrame, seq: str, keys: Sequence[str], symbols: str = "ACGTN") -> DataFrame:
    """(keys, one count per symbol): by what goes missing when a symbol is taken out, without exploding."""
    count = lambda s: F.sum(F.length(seq) - F.length(F.replace(F.col(seq), F.lit(s), F.lit(""))))
    return df.groupBy(*keys).agg(*[count(s).cast("long").alias(s) for s in symbols])


def gc_content(df: DataFrame, seq: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, gc, acgt, gc_fraction): ambiguous symbols are in neither count."""
    s = symbol_counts(df.withColumn(seq, F.upper(seq)), seq, keys, "ACGT")
    return s.select(*keys, (F.col("G") + F.col("C")).alias("gc"), (F.col("A") + F.col("C") + F.col("G") + F.col("T")).alias("acgt")).withColumn("gc_fraction", F.col("gc") / F.nullif(F.col("acgt"), F.lit(0)))


def gc3(df: DataFrame, seq: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, gc3_gc, gc3_sites, gc3): third positions pooled over coding sequences."""
    third = F.regexp_replace(F.substring(F.col(seq), F.lit(1), F.floor(F.length(seq) / 3).cast("int") * 3), "(?s)..(.)", "$1")
    ready = df.where(F.length(seq) >= 3).withColumn("_third", third)
    return gc_content(ready, "_third", keys).withColumnsRenamed({"gc": "gc3_gc", "acgt": "gc3_sites", "gc_fraction": "gc3"})


def chunks(df: DataFrame, seq: str, contig: str = "contig", size: int = 1 << 16) -> DataFrame:
    """(contig, chunk_start, seq): long sequences as rows of bounded size."""
    c = F.col(seq)
    cut = F.when(F.length(c) > 0, F.regexp_extract_all(c, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).otherwise(F.array(c))  # one pass, however long
    rows = df.select(contig, F.posexplode(cut).alias("_i", "_seq"))
    return rows.select(contig, (F.col("_i").cast("long") * size).alias("chunk_start"), F.col("_seq").alias("seq"))


def fetch(table: DataFrame, spans: DataFrame, size: int = 1 << 16) -> DataFrame:
    """spans (contig, start, end, ...) with the column sequence, put together from the chunks they touch."""
    keyed = spans.withColumn("_id", F.monotonically_increasing_id())
    want = keyed.select("_id", "contig", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / size) * size, F.floor((F.col("end") - 1) / size) * size, F.lit(size).cast("long"))).alias("chunk_start"))
    part = F.substring(F.col("seq"), (F.greatest("start", "chunk_start") - F.col("chunk_start") + 1).cast("int"), (F.least(F.col("end"), F.col("chunk_start") + size) - F.greatest("start", "chunk_start")).cast("int"))
    met = want.join(table, ["contig", "chunk_start"]).withColumn("_part", F.struct("chunk_start", part.alias("s")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("_part")), lambda p: p["s"]), "")
    # contig, start and end tell what was fetched, so equal spans share one sequence
    got = met.select("contig", "start", "end", "_part").distinct().groupBy("contig", "start", "end").agg(whole.alias("sequence"))
    return spans.join(got, ["contig", "start", "end"], "left")


def pattern_intervals(table: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """(contig, start, end): merged matches of regular expressions in chunks; runs of single symbols join over chunk edges.

    Spark has no function for all offsets of a pattern, so chunks go through Arrow in batches.
    """
    found = [re.compile(p) for p in patterns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(contig, at + m.start(), at + m.end()) for contig, at, seq in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for p in found for m in p.finditer(seq or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["contig", "start", "end"])

    kind = table.schema["contig"].dataType.simpleString()
    return iv.merge(table.select("contig", "chunk_start", "seq").mapInArrow(run, f"contig {kind}, start long, end long"))


def non_acgt(table: DataFrame) -> DataFrame:
    """Runs of symbols other than ACGT."""
    return pattern_intervals(table, ["[^ACGTacgt]+"])


def tandem_repeats(table: DataFrame, copies: dict[int, int]) -> DataFrame:
    """(contig, start, end): merged runs of a unit of so many bases (the keys) in at least so many whole copies.

    A base that is equal to the one a unit later is found where it lies, with the first bases of the chunks that follow;
    such bases join to stretches over any number of chunks, so results do not depend on how sequences are cut. Of a
    stretch the whole copies count, from its start, or from the end of the repeat before if that reaches into it.
    """
    widest = max(copies)
    own = table.select("contig", "chunk_start", "seq", (F.col("chunk_start") + F.length("seq")).alias("_end"))
    heads = table.where(F.length("seq") > 0).select("contig", F.col("chunk_start").alias("_end"), F.substring("seq", 1, widest).alias("_more"), (F.col("chunk_start") + F.length("seq")).alias("_next"))
    ahead = heads
    for _ in range(widest - 1):  # chunks may be as short as one base
        further = heads.select("contig", F.col("_end").alias("_next"), F.col("_more").alias("_then"), F.col("_next").alias("_after"))
        ahead = ahead.join(further, ["contig", "_next"], "left").select("contig", "_end", F.substring(F.concat("_more", F.coalesce("_then", F.lit(""))), 1, widest).alias("_more"), F.coalesce("_after", "_next").alias("_next"))
    rows = own.join(ahead.select("contig", "_end", "_more"), ["contig", "_end"], "left").select("contig", "chunk_start", "seq", F.coalesce("_more", F.lit("")).alias("more"))
    bases = np.frombuffer(b"ACGT", np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for contig, at, seq, more in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = np.frombuffer(((seq or "") + more).encode("ascii", "replace"), np.uint8)
                known, n = np.isin(text, bases), len(seq or "")
                for unit, least in copies.items():
                    m = max(0, min(n, len(text) - unit))
                    same = np.zeros(m + 2, np.int8)
                    same[1:-1] = (text[:m] == text[unit : unit + m]) & known[:m]
                    step = np.diff(same)
                    for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
                        if a == 0 or b == n or b - a >= unit * (least - 1):
                            out.append((contig, unit, at + a, at + b))
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["contig", "unit", "start", "end"])

    kind = table.schema["contig"].dataType.simpleString()
    runs = iv.merge(rows.mapInArrow(run, f"contig {kind}, unit int, start long, end long"), ["contig", "unit"])
    least = F.element_at(F.create_map(*[F.lit(x) for pair in copies.items() for x in pair]), F.col("unit")) * F.col("unit")
    long_ = runs.withColumn("end", F.col("end") + F.col("unit")).where(F.col("end") - F.col("start") >= least)
    by = Window.partitionBy("contig", "unit").orderBy("start")
    chained = long_.withColumn("_c", F.sum(F.coalesce((F.col("start") >= F.lag("end").over(by)).cast("int"), F.lit(1))).over(by))
    chain = chained.groupBy("contig", "unit", "_c").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_s"))

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    last = lambda done, s: F.aggregate(F.slice(done, F.greatest(F.size(done), F.lit(1)), F.lit(1)), s["start"], lambda acc, x: F.greatest(acc, x["end"]))

    def step(done: Column, s: Column) -> Column:
        start = last(done, s)
        whole = start + F.floor((s["end"] - start) / F.col("unit")) * F.col("unit")
        return F.when(whole - start >= least, F.concat(done, F.array(F.struct(start.alias("start"), whole.alias("end"))))).otherwise(done)

    found = chain.select("contig", F.explode(F.aggregate("_s", none, step)).alias("m")).select("contig", "m.start", "m.end")
    return iv.merge(found)


def low_complexity(table: DataFrame) -> DataFrame:
    """One base ten times or more, two bases ten times, three bases seven times."""
    return tandem_repeats(table, {1: 10, 2: 10, 3: 7})


def ordered_segments(segments: DataFrame, keys: Sequence[str] = ("transcript_id",)) -> DataFrame:
    """CDS segments with biological_index from 0: by start on +, from the far end on -.

    A transcript on two contigs or strands, or with overlapping segments, is an error when its rows are read.
    """
    by = Window.partitionBy(*keys)
    before = F.max("end").over(by.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    ways = F.size(F.collect_set(F.struct("contig", "strand")).over(by))
    bad = F.when(ways > 1, F.raise_error(F.lit("transcript on two contigs or strands"))).when(F.col("start") < before, F.raise_error(F.lit("segments overlap")))
    index = F.row_number().over(by.orderBy(F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start")))) - 1
    return segments.withColumn("biological_index", F.coalesce(bad.cast("int"), index))


def phase_chain(segments: DataFrame, keys: Sequence[str] = ("transcript_id",)) -> DataFrame:
    """(keys, bases, trimmed, phase_ok, reason): whether each segment's phase is what the bases before it leave.

    The first phase is trimmed; a later one must be (3 - length % 3) % 3 of what came before, and the total whole
    codons.
    """
    by = Window.partitionBy(*keys).orderBy("biological_index")
    first = F.first("phase").over(by)
    done = F.coalesce(F.sum(F.col("end") - F.col("start")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - first
    want = F.when(F.col("biological_index") == 0, F.col("phase")).otherwise(F.pmod(3 - F.pmod(done, F.lit(3)), F.lit(3)))
    marked = ordered_segments(segments, keys).withColumn("_bad", F.col("phase") != want).withColumn("_first", first)
    total = marked.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("bases"), F.max("_first").alias("_first"), F.max(F.coalesce("_bad", F.lit(True)).cast("int")).alias("_bad"))
    trimmed = F.col("bases") - F.col("_first")
    reason = F.when(F.col("_bad") == 1, "phase").when(trimmed % 3 != 0, "length").otherwise("ok")
    return total.select(*keys, "bases", trimmed.alias("trimmed"), (reason == "ok").alias("phase_ok"), reason.alias("reason"))


def coding_sequences(segments: DataFrame, table: DataFrame, size: int = 1 << 16, keys: Sequence[str] = ("transcript_id",)) -> DataFrame:
    """(keys, cds): spliced, on the coding strand, first phase trimmed."""
    ready = fetch(table, ordered_segments(segments, keys), size)
    piece = F.when(F.col("strand") == "-", reverse_complement("sequence")).otherwise(F.col("sequence"))
    parts = F.array_sort(F.collect_list(F.struct("biological_index", piece.alias("s"), "phase")))
    put = ready.groupBy(*keys).agg(parts.alias("_p"))
    whole = F.array_join(F.transform("_p", lambda p: p["s"]), "")
    return put.select(*keys, F.substring(whole, F.element_at("_p", 1)["phase"].cast("int") + 1, F.length(whole)).alias("cds"))


def coding_positions(segments: DataFrame, keys: Sequence[str] = ("transcript_id",)) -> DataFrame:
    """(keys, contig, strand, cds_index, pos): where each base of a coding sequence lies; the first phase is trimmed."""
    by = Window.partitionBy(*keys).orderBy("biological_index")
    ordered = ordered_segments(segments, keys)
    before = F.coalesce(F.sum(F.col("end") - F.col("start")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ordered.withColumn("_before", before).withColumn("_skip", F.first("phase").over(by))
    bases = placed.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("end") - F.col("start") - 1)))
    pos = F.when(F.col("strand") == "-", F.col("end") - 1 - F.col("_k")).otherwise(F.col("start") + F.col("_k"))
    out = bases.select(*keys, "contig", "strand", (F.col("_before") + F.col("_k") - F.col("_skip")).alias("cds_index"), pos.alias("pos"))
    return out.where("cds_index >= 0")


def fourfold_sites(segments: DataFrame, sequences: DataFrame, keys: Sequence[str] = ("transcript_id",)) -> DataFrame:
    """(contig, pos): third bases of fourfold codons; a base seen in more than one (frame, fourfold) state is left out.

    sequences is (keys, cds) of the transcripts that take part.
    """
    spark = segments.sparkSession
    table = F.broadcast(codon_table(spark))  # 64 rows
    own = codons(sequences.select(*keys, "cds"), "cds").join(table, "codon", "left").select(*keys, "codon_index", "fourfold")
    bases = coding_positions(segments, keys).withColumn("codon_index", F.floor(F.col("cds_index") / 3).cast("int")).withColumn("_frame", (F.col("cds_index") % 3).cast("int"))
    state = bases.join(own, [*keys, "codon_index"]).select("contig", "pos", F.struct("_frame", F.coalesce(F.col("fourfold"), F.lit(False)).alias("f")).alias("_s"))
    one = state.groupBy("contig", "pos").agg(F.min("_s").alias("a"), F.max("_s").alias("b")).where("a = b")
    return one.where("a._frame = 2 and a.f").select("contig", "pos")


def consensus_counts(mask: DataFrame, snps: DataFrame, indels: DataFrame, flank: int = 10) -> DataFrame:
    """(contig, callable, masked_by_indels, heterozygous): sizes of a diploid consensus, from intervals alone.

    The mask beats an ambiguity code: a SNP within `flank` of an indel is masked.
    """
    near = indels.select("contig", F.greatest(F.lit(0), F.col("start") - flank).alias("start"), (F.col("end") + flank).alias("end"))
    kept = iv.subtract(mask, near)
    het = iv.points_within(snps, kept).groupBy("contig").agg(F.countDistinct("pos").alias("heterozygous"))
    whole = iv.measure(mask).withColumnRenamed("bases", "_all")
    left = iv.measure(kept).withColumnRenamed("bases", "callable")
    out = whole.join(left, "contig", "left").join(het, "contig", "left")
    return out.select("contig", F.coalesce("callable", F.lit(0)).alias("callable"), (F.col("_all") - F.coalesce("callable", F.lit(0))).alias("masked_by_indels"), F.coalesce("heterozygous", F.lit(0)).alias("heterozygous"))


def apply_consensus(seq: Column, start: Column, snps: Column) -> Column:
    """A chunk with ambiguity codes at SNPs; snps is an array of (pos, code) inside the chunk, sorted by position."""
    first = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, s: F.struct(F.concat(acc["done"], F.substring(seq, (acc["at"] + 1).cast("int"), (s["pos"] - start - acc["at"]).cast("int")), s["code"]).alias("done"), (s["pos"] - start + 1).alias("at"))
    return F.aggregate(snps, first, step, lambda acc: F.concat(acc["done"], F.substring(seq, (acc["at"] + 1).cast("int"), F.length(seq))))


def psmcfa(table: DataFrame, width: int = 100) -> DataFrame:
    """(contig, bin, symbol) of a consensus in chunks whose size is a multiple of width.

    A short last bin or one with any N is N, one with an ambiguity code K, else T.
    """
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(width)))
    cut = table.where(F.length("seq") > 0).withColumn("_at", at)
    piece = F.substring(F.col("seq"), F.col("_at") + 1, F.lit(width))
    symbol = F.when((F.length(piece) < width) | piece.contains("N"), "N").when(piece.rlike("[KMRSWY]"), "K").otherwise("T")
    return cut.select("contig", F.floor((F.col("chunk_start") + F.col("_at")) / width).alias("bin"), symbol.alias("symbol"))


def wrapped(seq: str | Column, width: int = 60) -> Column:
    """Lines of `width` symbols."""
    c = seq if isinstance(seq, Column) else F.col(seq)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(width)), lambda i: F.substring(c, i + 1, F.lit(width)))


def strength(base: Column) -> Column:
    """W for A and T, S for C and G, else NA."""
    return F.when(F.upper(base).isin("A", "T"), "W").when(F.upper(base).isin("C", "G"), "S").otherwise("NA")


def is_snv(ref: Column, alts: Column) -> Column:
    """One plain reference base, and one or more alternatives that are plain bases."""
    base = "^[ACGT]$"
    return ref.rlike(base) & (F.size(alts) > 0) & F.forall(alts, lambda a: a.rlike(base))


def change_class(ref: Column, alt: Column) -> Column:
    """WS, SW or none of the two, for single-base changes."""
    pair = F.concat(strength(ref), strength(alt))
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1) & pair.isin("WS", "SW"), pair)


def partition_summary(partitions: DataFrame, mask: DataFrame, variants: DataFrame) -> DataFrame:
    """(name, bp, variants, rate): bases of each named partition in the mask, variants wholly inside, rate or null."""
    inside = iv.intersect(partitions.select("name", "contig", "start", "end"), _named_mask(partitions, mask), ["name", "contig"])
    bp = inside.groupBy("name").agg(F.sum(F.col("end") - F.col("start")).alias("bp"))
    merged = inside.withColumnsRenamed({"start": "m_start", "end": "m_end"})
    met = iv.overlaps(variants.select("contig", "start", "end", "variant_id"), merged.select("contig", F.col("m_start").alias("start"), F.col("m_end").alias("end"), "name"))
    n = met.where("start >= b_start and end <= b_end").groupBy("name").agg(F.count("*").alias("variants"))
    out = partitions.select("name").distinct().join(bp, "name", "left").join(n, "name", "left")
    out = out.select("name", F.coalesce("bp", F.lit(0)).alias("bp"), F.coalesce("variants", F.lit(0)).alias("variants"))
    return out.withColumn("rate", F.col("variants") / F.nullif(F.col("bp"), F.lit(0)))


def _named_mask(partitions: DataFrame, mask: DataFrame) -> DataFrame:
    """The mask once per partition name and contig that has it."""
    names = partitions.select("name", "contig").distinct()
    return mask.select("contig", "start", "end").join(names, "contig").select("name", "contig", "start", "end")


def tracts(markers: DataFrame) -> DataFrame:
    """(event_id, markers, strong, weak, ambiguous, inner, outer): conversion tracts from markers (event_id, pos, base, low, high).

    inner runs from the first to the last marker; outer between the flanking unconverted positions low and high, which
    must be the same for all markers of an event.
    """
    s = strength(F.col("base"))
    n = lambda k: F.count_if(s == k)
    g = markers.groupBy("event_id").agg(F.count("*").alias("markers"), n("S").alias("strong"), n("W").alias("weak"), n("NA").alias("ambiguous"), (F.max("pos") - F.min("pos") + 1).alias("inner"), F.min("low").alias("_l"), F.max("low").alias("_l2"), F.min("high").alias("_h"), F.max("high").alias("_h2"))
    bad = (F.col("_l") != F.col("_l2")) | (F.col("_h") != F.col("_h2"))
    return g.select("event_id", "markers", "strong", "weak", "ambiguous", "inner", F.when(bad, F.raise_error(F.lit("flanks differ within an event")).cast("long")).otherwise(F.col("_h") - F.col("_l") - 1).alias("outer"))
