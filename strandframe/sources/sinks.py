"""Writers with fixed column order and full sort; Spark's commit protocol makes them whole or absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.sequence import wrapped
from strandframe.sources.text import PAF


def write_tsv(df: DataFrame, path: str, columns: Sequence[str], keys: Sequence[str], single: bool = False) -> None:
    """Tab-separated with a header, range-sorted by keys; `single` puts small ledgers into one file."""
    out = df.select(*columns).orderBy(*keys)
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="")


def write_lines(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """The column text as lines, sorted by keys."""
    df.orderBy(*keys).select("text").write.mode("overwrite").text(path)


def write_bed(df: DataFrame, path: str) -> None:
    write_lines(df.withColumn("text", F.concat_ws("\t", "contig", "start", "end")), path, ("contig", "start", "end"))


def write_paf(df: DataFrame, path: str) -> None:
    text = F.concat_ws("\t", *[F.col(c).cast("string") for c in PAF], F.concat(F.lit("cg:Z:"), "cigar"))
    write_lines(df.withColumn("text", text), path, ("query", "query_start", "query_end", "target", "target_start"))


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    """(contig, chunk_start, seq) with chunks a multiple of the width long: header lines before each contig's first."""
    body = df.select("contig", "chunk_start", F.posexplode(wrapped("seq", width)).alias("k", "text"))
    head = df.where("chunk_start = 0").select("contig", F.lit(-1).cast("long").alias("chunk_start"), F.lit(0).alias("k"), F.concat(F.lit(">"), "contig").alias("text"))
    write_lines(body.unionByName(head), path, ("contig", "chunk_start", "k"))


def write_vcf(df: DataFrame, path: str, sample: str) -> None:
    """(contig, pos, ref, alt, genotype), one-based."""
    head = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(("##fileformat=VCFv4.3", f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{sample}"))], "pos long, text string")
    rows = df.select("contig", F.col("pos").cast("long").alias("pos"), F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), "genotype").alias("text"))
    write_lines(head.withColumn("contig", F.lit("")).unionByName(rows), path, ("contig", "pos"))
