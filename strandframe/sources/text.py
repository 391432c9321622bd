"""Strict readers of sequence, annotation, alignment, variant, depth and scheduler text.

Lines carry `line`, which rises with their order in a file. What is not as the format says is an error when read, not
a null. Text is staged once: callers that read a table often should write it as Parquet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.functions import scalars as sc


def _fail(message: str, *more: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), *[F.coalesce(m.cast("string"), F.lit("null")) for m in more]))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text), without blank lines; compressed files are read as such."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.col("value").alias("text")).where(F.trim("text") != "")


def fields(spark: SparkSession, path: str, names: Sequence[str], least: int | None = None, comment: str = "#", sep: str = "\t") -> DataFrame:
    """(line, names): columns of a text table as strings, from `least` of them on; comment lines are left out."""
    least = len(names) if least is None else least
    parts = lines(spark, path).where(~F.col("text").startswith(comment) if comment else F.lit(True)).withColumn("_f", F.split("text", sep))
    checked = parts.withColumn("_f", F.when(F.size("_f") >= least, F.col("_f")).otherwise(_fail("too few fields: ", F.col("text"))))
    return checked.select("line", *[F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(names)])


def whole(c: str | Column, what: str = "number") -> Column:
    """A whole number, or an error."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(c).rlike(r"^-?\d+$"), F.trim(c).cast("bigint")).otherwise(_fail(f"bad {what}: ", c))


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, sep: str = "\t") -> DataFrame:
    """All cells as strings; with `columns` the header must be these, in order."""
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, quote="", mode="FAILFAST")
    if columns is not None and df.columns != list(columns):
        raise ValueError(f"header is {df.columns}, not {list(columns)}")
    return df


def read_fasta(spark: SparkSession, path: str, chunk: int = 1 << 16, strict: bool = True) -> DataFrame:
    """(contig, chunk_start, seq), upper-cased; repeated or empty names, and with strict inner white space, are errors."""
    records = spark.read.text(path, lineSep="\n>").withColumn("value", F.regexp_replace("value", "^>", "")).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\n]*)", 1)
    name = F.regexp_extract(head, r"^(\S*)", 1)
    body = F.substring(F.col("value"), F.length(head) + 2, F.length("value"))
    seq = F.upper(F.regexp_replace(body, r"[\r\n]", ""))
    rows = records.select(name.alias("contig"), seq.alias("seq"))
    n = F.count("*").over(Window.partitionBy("contig"))
    bad = (F.col("contig") == "") | (n > 1) | (F.col("seq").rlike(r"\s") if strict else F.lit(False))
    checked = rows.withColumn("contig", F.when(bad, _fail("bad sequence name or content: ", F.col("contig"))).otherwise(F.col("contig")))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(chunk)))
    return checked.select("contig", at.alias("_at"), "seq").select("contig", F.col("_at").cast("long").alias("chunk_start"), F.substring(F.col("seq"), F.col("_at") + 1, F.lit(chunk)).alias("seq"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    f = fields(spark, path, ("contig", "length", "offset", "line_bases", "line_width"), 2)
    return f.select("contig", whole("length").alias("length"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    f = fields(spark, path, ("contig", "start", "end", "name"), 3)
    f = f.where(~F.col("contig").rlike("^(track|browser)"))
    start, end = whole("start"), whole("end")
    return f.select("contig", F.when((start >= 0) & (start < end), start).otherwise(_fail("bad interval on ", F.col("contig"))).alias("start"), end.alias("end"), "name")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """(line, contig, source, type, start, end, score, strand, phase, attributes): start from zero, attributes as a map."""
    f = lines(spark, path)
    tail = f.where(F.col("text").startswith("##FASTA")).agg(F.min("line").alias("_tail"))
    body = f.crossJoin(F.broadcast(tail)).where("_tail is null or line < _tail").where(~F.col("text").startswith("#"))  # one row
    # The check names _tail, so that it is not tried on lines of the tail before they are gone.
    inside = F.coalesce(F.col("line") < F.col("_tail"), F.lit(True))
    parts = body.withColumn("_f", F.split("text", "\t")).withColumn("_f", F.when(~inside, F.lit(None)).when(F.size("_f") == 9, F.col("_f")).otherwise(_fail("not nine columns: ", F.col("text"))))
    at = lambda i: F.get("_f", F.lit(i))
    start, end = whole(at(3), "start") - 1, whole(at(4), "end")
    return parts.select("line", at(0).alias("contig"), at(1).alias("source"), at(2).alias("type"), F.when((start >= 0) & (start < end), start).otherwise(_fail("bad coordinates: ", F.col("text"))).alias("start"), end.alias("end"), at(5).alias("score"), F.when(at(6).isin("+", "-", ".", "?"), at(6)).otherwise(_fail("bad strand: ", F.col("text"))).alias("strand"), F.when(at(7) == ".", F.lit(None)).otherwise(at(7).try_cast("int")).alias("phase"), sc.attributes(at(8)).alias("attributes"))


def annotation_profile(gff: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per contig: features by type, farthest end; and the parents that no feature has as its id."""
    per = gff.groupBy("contig", "type").agg(F.count("*").alias("features"), F.max("end").alias("max_end"))
    ids = gff.select(F.col("attributes")["ID"].alias("id")).where("id is not null").distinct()
    parents = gff.select(F.explode(F.split(F.col("attributes")["Parent"], ",")).alias("id")).distinct()
    return per, parents.join(ids, "id", "left_anti")


def read_vcf(spark: SparkSession, path: str, samples: Sequence[str] | None = None) -> DataFrame:
    """(line, contig, pos0, ref, alts, filters, info, genotypes): genotypes map sample -> text, of the asked samples.

    The header names the samples; one that is asked for and not there is an error.
    """
    f = lines(spark, path)
    head = f.where(F.col("text").startswith("#CHROM")).select(F.split("text", "\t").alias("h")).first()
    if head is None:
        raise ValueError("no #CHROM line")
    own = head.h[9:]
    wanted = list(samples) if samples is not None else own
    if lost := set(wanted) - set(own):
        raise ValueError(f"no samples {sorted(lost)}")
    p = f.where(~F.col("text").startswith("#")).withColumn("_f", F.split("text", "\t"))
    at = lambda i: F.get("_f", F.lit(i))
    gt_at = F.array_position(F.split(at(8), ":"), "GT").cast("int") - 1
    texts = [x for s in wanted for x in (F.lit(s), F.get(F.split(at(9 + own.index(s)), ":"), gt_at))]
    info = F.map_from_entries(F.transform(F.filter(F.split(at(7), ";"), lambda x: (x != "") & (x != ".")), lambda x: F.struct(F.substring_index(x, "=", 1), F.when(x.contains("="), F.substring(x, F.locate("=", x) + 1, F.length(x))))))
    alts = F.filter(F.split(at(4), ","), lambda a: a != ".")
    return p.select("line", at(0).alias("contig"), (whole(at(1), "position") - 1).alias("pos0"), F.upper(at(3)).alias("ref"), alts.alias("alts"), F.filter(F.split(at(6), ";"), lambda x: x != ".").alias("filters"), info.alias("info"), (F.create_map(*texts) if texts else F.create_map().cast("map<string,string>")).alias("genotypes"))


PAF = ("query", "query_length", "query_start", "query_end", "strand", "target", "target_length", "target_start", "target_end", "matches", "block", "mapq")


def read_paf(spark: SparkSession, path: str, with_cigar: bool = True) -> DataFrame:
    """The twelve fields, and cigar from exactly one cg:Z tag; record_id is the line."""
    f = lines(spark, path).withColumn("_f", F.split("text", "\t")).withColumn("_f", F.when(F.size("_f") >= 12, F.col("_f")).otherwise(_fail("fewer than 12 fields: ", F.col("text"))))
    numbers = {"query_length", "query_start", "query_end", "target_length", "target_start", "target_end", "matches", "block", "mapq"}
    cols = [(whole(F.get("_f", F.lit(i)), n) if n in numbers else F.get("_f", F.lit(i))).alias(n) for i, n in enumerate(PAF)]
    tags = F.filter(F.slice("_f", 13, 1 << 20), lambda t: t.startswith("cg:Z:"))
    out = f.select(F.col("line").alias("record_id"), *cols, tags.alias("_t"))
    fine = F.col("strand").isin("+", "-") & (F.col("query_start") >= 0) & (F.col("query_start") < F.col("query_end")) & (F.col("query_end") <= F.col("query_length")) & (F.col("target_start") >= 0) & (F.col("target_start") < F.col("target_end")) & (F.col("target_end") <= F.col("target_length"))
    if with_cigar:
        fine &= F.size("_t") == 1
        out = out.withColumn("cigar", F.substring(F.element_at("_t", 1), 6, 1 << 30))
    return out.withColumn("strand", F.when(fine, F.col("strand")).otherwise(_fail("bad alignment record ", F.col("record_id")))).drop("_t")


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    f = fields(spark, path, ("contig", "pos", "depth"))
    return f.select("line", "contig", whole("pos").alias("pos"), whole("depth").alias("depth"))


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    f = fields(spark, path, ("chrom", "pos", "ref", "depth", "bases"), comment="")
    n = F.count("*").over(Window.partitionBy("chrom", "pos"))
    return f.select("chrom", F.when(n > 1, _fail("position twice: ", F.col("pos")).cast("bigint")).otherwise(whole("pos")).alias("pos"), "ref", whole("depth").alias("depth"), "bases")


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    f = fields(spark, path, ("depth", "count")).where("depth <> 'depth'")
    return f.select(whole("depth").alias("depth"), whole("count").alias("count"))


def read_psmc(spark: SparkSession, path: str, last_round: str = "largest") -> DataFrame:
    """(round, theta, interval, time, lambda) of the final round: the largest number, or the last in the file.

    A theta that is not positive or a repeated interval is an error.
    """
    f = lines(spark, path).withColumn("_f", F.split("text", r"\s+"))
    down = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda i: F.get("_f", F.lit(i))
    rd = F.when(at(0) == "RD", whole(at(1)))
    start = F.when(at(0) == "RD", F.col("line"))
    named = f.withColumns({"round": F.last(rd, True).over(down), "_start": F.last(start, True).over(down)})
    key = F.col("round") if last_round == "largest" else F.col("_start")
    final = named.withColumn("_k", key).withColumn("_m", F.max("_k").over(Window.partitionBy())).where("_k = _m")
    theta = final.where(at(0) == "TR").agg(F.max(at(1).try_cast("double")).alias("theta"))
    rows = final.where(at(0) == "RS").select("round", whole(at(1)).alias("interval"), at(2).try_cast("double").alias("time"), at(3).try_cast("double").alias("lambda"))
    n = F.count("*").over(Window.partitionBy("interval"))
    out = rows.withColumn("_n", n).crossJoin(F.broadcast(theta))  # one row
    bad = (F.col("_n") > 1) | ~F.coalesce(F.col("theta") > 0, F.lit(False)) | F.col("time").isNull() | F.col("lambda").isNull()
    return out.select("round", F.when(bad, _fail("bad trajectory at ", F.col("interval")).cast("double")).otherwise(F.col("theta")).alias("theta"), "interval", "time", "lambda")


def read_psmcfa(spark: SparkSession, path: str) -> DataFrame:
    """(contig, bin, symbol): one of N, K, T for each."""
    chunked = read_fasta(spark, path)
    checked = chunked.withColumn("seq", F.when(F.col("seq").rlike("^[NKT]*$"), F.col("seq")).otherwise(_fail("bad symbol on ", F.col("contig"))))
    return checked.where(F.length("seq") > 0).select("contig", F.posexplode(F.split("seq", "")).alias("_p", "symbol"), "chunk_start").where("symbol <> ''").select("contig", (F.col("chunk_start") + F.col("_p")).alias("bin"), "symbol")


def read_sacct(spark: SparkSession, path: str) -> DataFrame:
    """A row per job: its own fields, with the largest memory of its steps."""
    df = spark.read.csv(path, sep="|", header=True, inferSchema=False, quote="")
    job = F.regexp_extract("JobIDRaw", r"^([^.]+)", 1)
    rss = sc.memory_mib(F.col("MaxRSS"))
    own = ~F.col("JobIDRaw").contains(".")
    first = lambda c: F.max(F.when(own, F.col(c))).alias(c)
    return df.withColumns({"job": job, "_rss": rss}).groupBy("job").agg(first("JobName"), first("State"), F.max(F.when(own, F.col("ElapsedRaw").try_cast("bigint"))).alias("elapsed_s"), F.max(F.when(own, F.col("AllocCPUS").try_cast("bigint"))).alias("cpus"), F.max("_rss").alias("max_rss_mib"), F.count_if(~own).alias("steps"))


def read_md5(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5) of a digest file; a path with two digests is an error."""
    f = lines(spark, path)
    m = f.select(F.regexp_extract("text", r"^([0-9a-fA-F]{32})\s+\*?(\S.*)$", 1).alias("md5"), F.regexp_extract("text", r"^([0-9a-fA-F]{32})\s+\*?(\S.*)$", 2).alias("path"), "text")
    checked = m.select("path", F.when(F.col("md5") == "", _fail("no digest: ", F.col("text"))).otherwise(F.lower("md5")).alias("md5"))
    return checked.groupBy("path").agg(F.min("md5").alias("md5"), F.max("md5").alias("_b")).withColumn("md5", F.when(F.col("md5") != F.col("_b"), _fail("two digests of ", F.col("path"))).otherwise(F.col("md5"))).drop("_b")


def read_inventory(spark: SparkSession, path: str, roots: DataFrame) -> DataFrame:
    """Objects (path, type, size, mtime, accession) of a '|' listing; each belongs to the longest root (root, accession) that leads its path.

    A root without any object is an error.
    """
    f = fields(spark, path, ("type", "size", "mtime", "path"), sep=r"\|")
    rows = f.select("type", whole("size").alias("size"), "mtime", "path")
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    met = rows.withColumn("root", F.explode(prefixes)).join(roots, "root").withColumn("_n", F.length("root"))
    longest = met.withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy(F.col("_n").desc()))).where("_k = 1")
    if lost := roots.join(longest.select("root").distinct(), "root", "left_anti").limit(1).collect():
        raise ValueError(f"nothing under {lost[0].root}")
    return longest.select("path", "type", "size", "mtime", "accession")


def read_assembly_report(spark: SparkSession, path: str, lengths: DataFrame) -> DataFrame:
    """(alias, contig): names that stand for exactly one contig of equal length."""
    f = fields(spark, path, ("name", "role", "molecule", "location", "genbank", "relation", "refseq", "unit", "length", "ucsc"))
    names = F.explode(F.array_distinct(F.filter(F.array("name", "genbank", "refseq", "ucsc"), lambda n: ~n.isin("na", "") & n.isNotNull())))
    rows = f.withColumn("_row", F.col("line")).withColumn("alias", names).select("_row", "alias", whole("length").alias("_length"))
    own = rows.join(lengths.select(F.col("contig").alias("alias"), F.col("length").alias("_have")), "alias").where("_length = _have").select("_row", F.col("alias").alias("contig")).distinct()
    return rows.join(own, "_row").groupBy("alias").agg(F.countDistinct("contig").alias("_n"), F.min("contig").alias("contig")).where("_n = 1").select("alias", "contig")


def coverage_summary(rows: DataFrame) -> DataFrame:
    """Length-weighted depth and breadth of rows (length, depth, breadth)."""
    return rows.agg(F.sum("length").alias("bases"), (F.sum(F.col("depth") * F.col("length")) / F.sum("length")).alias("depth"), (F.sum(F.col("breadth") * F.col("length")) / F.sum("length")).alias("breadth"))


def flagstat_summary(text: Column) -> tuple[Column, Column]:
    """Total and mapped counts of a flag summary text."""
    n = lambda p: F.regexp_extract(text, p, 1).try_cast("bigint")
    return n(r"(?m)^(\d+) \+ \d+ in total"), n(r"(?m)^(\d+) \+ \d+ mapped \(")


ESUMMARY = "struct<result:map<string,string>>"


def parse_esummary(df: DataFrame, column: str) -> DataFrame:
    """Assembly candidates of a summary document: one row per uid."""
    doc = F.from_json(column, ESUMMARY)["result"]
    uids = F.from_json(doc["uids"], "array<string>")
    entry = "struct<assemblyaccession:string,taxid:string,speciestaxid:string,refseq_category:string,assemblystatus:string,asmreleasedate_genbank:string,ftppath_refseq:string,propertylist:array<string>>"
    rows = df.select(F.explode(F.transform(uids, lambda u: F.from_json(F.element_at(doc, u), entry))).alias("e"))
    return rows.select(F.col("e.assemblyaccession").alias("accession"), F.col("e.taxid").try_cast("bigint").alias("taxid"), F.col("e.speciestaxid").try_cast("bigint").alias("species_taxid"), "e.refseq_category", F.col("e.assemblystatus").alias("assembly_level"), F.col("e.asmreleasedate_genbank").alias("release_date"), F.col("e.ftppath_refseq").alias("path"), F.coalesce(F.exists("e.propertylist", lambda p: F.lower(p).contains("suppressed")), F.lit(False)).alias("suppressed"))


def sra_summary(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, projects, strategies, runs, bases) of experiment XML by sample; runs and bases of whole-genome ones."""
    x = df.select(key, F.expr(f"xpath_string({xml}, '//Bioproject')").alias("project"), F.expr(f"xpath_string({xml}, '//LIBRARY_STRATEGY')").alias("strategy"), F.expr(f"xpath_int({xml}, 'count(//Run)')").alias("n"), F.expr(f"xpath_double({xml}, 'sum(//Run/@total_bases)')").alias("b"))
    wgs = F.col("strategy") == "WGS"
    return x.groupBy(key).agg(F.array_sort(F.collect_set("project")).alias("projects"), F.array_sort(F.collect_set("strategy")).alias("strategies"), F.coalesce(F.sum(F.when(wgs, F.col("n"))), F.lit(0)).alias("runs"), F.coalesce(F.sum(F.when(wgs, F.col("b"))), F.lit(0.0)).cast("bigint").alias("bases"))


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1, header_row: int = 1) -> DataFrame:
    """(row, cells map<string,string>) of a sheet, names from the header row; blank rows are left out.

    One workbook is one task: the format is a zip archive.
    """
    import io
    import zipfile
    from xml.etree import ElementTree

    import pandas as pd

    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def column(ref: str) -> int:
        n = 0
        for c in ref:
            if not c.isalpha():
                break
            n = n * 26 + ord(c) - 64
        return n - 1

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    shared = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        shared = ["".join(t.text or "" for t in si.iter(f"{space}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")]
                    names, out = None, []
                    for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{space}row"):
                        cells = {}
                        for c in row.iter(f"{space}c"):
                            v = c.find(f"{space}v")
                            text = "".join(t.text or "" for t in c.iter(f"{space}t")) if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                            if text:
                                cells[column(c.get("r"))] = text
                        n = int(row.get("r"))
                        if n == header_row:
                            names = cells
                        elif names is not None and cells:
                            out.append((n, {names[i]: t for i, t in cells.items() if i in names}))
                    yield pd.DataFrame({"row": [n for n, _ in out], "cells": [c for _, c in out]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row long, cells map<string,string>")


def verify_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(path, state) of expected files (path, size, sha256): ok, missing, size or digest. Files must fit a task."""
    got = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^.*/", "").alias("path"), F.col("length").alias("_size"), F.sha2("content", 256).alias("_sha"))
    m = expected.join(got, "path", "left")
    return m.select("path", F.when(F.col("_size").isNull(), "missing").when(F.col("_size") != F.col("size"), "size").when(F.col("_sha") != F.col("sha256"), "digest").otherwise("ok").alias("state"))
