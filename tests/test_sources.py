"""Readers and writers on small files."""

import hashlib
import io
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandframe.sources import sinks, text


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        p = tmp_path / name
        p.write_text(content)
        return str(p)

    return write


def test_fasta_and_index(spark, put):
    got = text.read_fasta(spark, put("a.fa", ">c1 more words\nacgt\nAC\n>c2\nNNN\n"), chunk=4).collect()
    assert {(r.contig, r.chunk_start, r.seq) for r in got} == {("c1", 0, "ACGT"), ("c1", 4, "AC"), ("c2", 0, "NNN")}
    for bad in (">a\nAC\n>a\nGT\n", ">\nAC\n", ">a\nA C\n"):
        with pytest.raises(PySparkException):
            text.read_fasta(spark, put("b.fa", bad)).collect()
    assert text.read_fai(spark, put("a.fai", "c1\t6\t3\t4\t5\n")).first().length == 6


def test_bed_gff_vcf(spark, put):
    assert [(r.contig, r.start, r.end) for r in text.read_bed(spark, put("a.bed", "c\t1\t5\nc\t7\t9\tx\n")).collect()] == [("c", 1, 5), ("c", 7, 9)]
    with pytest.raises(PySparkException):
        text.read_bed(spark, put("b.bed", "c\t5\t5\n")).collect()
    gff = text.read_gff(spark, put("a.gff", "##gff-version 3\nc\ts\tmRNA\t3\t11\t.\t+\t.\tID=m1;Parent=g0\nc\ts\tCDS\t3\t11\t.\t+\t0\tParent=m1\n##FASTA\n>c\nACGT\n"))
    assert [(r.type, r.start, r.end, r.phase) for r in gff.collect()] == [("mRNA", 2, 11, None), ("CDS", 2, 11, 0)]
    _, orphans = text.annotation_profile(gff)
    assert [r.id for r in orphans.collect()] == ["g0"]
    vcf = put("a.vcf", "##fileformat=VCFv4.3\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\nc\t4\t.\ta\tG,T\t.\tPASS\tDP=3;FLAG\tDP:GT\t3:0/1\t2:./.\n")
    r = text.read_vcf(spark, vcf, ["S1"]).first()
    assert (r.pos0, r.ref, r.alts, r.filters, r.info, r.genotypes) == (3, "A", ["G", "T"], ["PASS"], {"DP": "3", "FLAG": None}, {"S1": "0/1"})
    with pytest.raises(ValueError):
        text.read_vcf(spark, vcf, ["S9"])


def test_paf_depth_pileup(spark, put):
    line = "q\t10\t0\t10\t+\tt\t12\t1\t11\t10\t10\t60\tcg:Z:10=\n"
    assert text.read_paf(spark, put("a.paf", line)).first().cigar == "10="
    for bad in (line.replace("cg:Z", "xx:Z"), line.replace("\t+\t", "\t*\t"), "q\t10\n"):
        with pytest.raises(PySparkException):
            text.read_paf(spark, put("b.paf", bad)).collect()
    assert text.read_depth(spark, put("a.depth", "c\t1\t7\n")).first().depth == 7
    assert text.read_pileup(spark, put("a.pile", "c\t1\tA\t2\t.#\n")).first().bases == ".#"
    with pytest.raises(PySparkException):
        text.read_pileup(spark, put("b.pile", "c\t1\tA\t2\t.,\nc\t1\tA\t2\t.,\n")).collect()


PSMC = "RD\t0\nTR\t0.1\t0.02\nRS\t0\t0.0\t1.0\t1\t1\t1\nRD\t2\nTR\t0.2\t0.02\nRS\t0\t0.0\t2.0\t1\t1\t1\nRS\t1\t0.5\t3.0\t1\t1\t1\nRD\t1\nTR\t0.3\t0.02\nRS\t0\t0.0\t4.0\t1\t1\t1\n"


def test_psmc_rounds(spark, put):
    path = put("a.psmc", PSMC)
    assert {(r.theta, r.interval, r["lambda"]) for r in text.read_psmc(spark, path).collect()} == {(0.2, 0, 2.0), (0.2, 1, 3.0)}
    assert {(r.theta, r["lambda"]) for r in text.read_psmc(spark, path, "last").collect()} == {(0.3, 4.0)}
    assert [r.symbol for r in text.read_psmcfa(spark, put("a.psmcfa", ">c\nTK\nN\n")).orderBy("bin").collect()] == ["T", "K", "N"]


def test_accounting_and_digests(spark, put):
    s = text.read_sacct(spark, put("a.sacct", "JobIDRaw|JobName|State|ElapsedRaw|AllocCPUS|MaxRSS\n7|j|COMPLETED|60|4|\n7.batch|b|COMPLETED|60|4|2048K\n7.0|x|COMPLETED|60|4|3M\n"))
    r = s.first()
    assert (r.job, r.JobName, r.elapsed_s, r.max_rss_mib, r.steps) == ("7", "j", 60, 3.0, 2)
    d = "0" * 32
    assert text.read_md5(spark, put("a.md5", f"{d}  x/y.fa\n")).first().path == "x/y.fa"
    with pytest.raises(PySparkException):
        text.read_md5(spark, put("b.md5", f"{d}  x\n{'1' * 32}  x\n")).collect()
    roots = spark.createDataFrame([("a", "A1"), ("a/b", "A2")], "root string, accession string")
    got = text.read_inventory(spark, put("a.inv", "f|3|2020|a/x\nf|4|2020|a/b/y\n"), roots)
    assert {(r.path, r.accession) for r in got.collect()} == {("a/x", "A1"), ("a/b/y", "A2")}
    path = put("file.bin", "hello")
    want = spark.createDataFrame([("file.bin", 5, hashlib.sha256(b"hello").hexdigest()), ("gone", 1, "")], "path string, size long, sha256 string")
    assert {(r.path, r.state) for r in text.verify_files(spark, path, want).collect()} == {("file.bin", "ok"), ("gone", "missing")}


def test_documents_of_other_kinds(spark, put, tmp_path):
    doc = '{"result":{"uids":["5"],"5":{"assemblyaccession":"GCF_1.1","taxid":"9","speciestaxid":"9","refseq_category":"na","assemblystatus":"Contig","propertylist":["suppressed_genbank"]}}}'
    r = text.parse_esummary(spark.createDataFrame([(doc,)], "j string"), "j").first()
    assert (r.accession, r.taxid, r.suppressed) == ("GCF_1.1", 9, True)
    xml = '<R><Bioproject>P1</Bioproject><LIBRARY_STRATEGY>WGS</LIBRARY_STRATEGY><Runs><Run total_bases="5"/><Run total_bases="7"/></Runs></R>'
    r = text.sra_summary(spark.createDataFrame([("s", xml)], "sample string, x string"), "sample", "x").first()
    assert (r.projects, r.runs, r.bases) == (["P1"], 2, 12)
    flags = spark.createDataFrame([("10 + 0 in total (x)\n8 + 0 mapped (80%)",)], "t string")
    assert tuple(flags.select(*text.flagstat_summary(F.col("t"))).first()) == (10, 8)
    book = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>n</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"/><row r="3"><c r="A3" t="inlineStr"><is><t>x</t></is></c><c r="B3"><v>4</v></c></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(book.getvalue())
    assert [(r.row, r.cells) for r in text.read_xlsx(spark, str(tmp_path / "a.xlsx")).collect()] == [(3, {"name": "x", "n": "4"})]
    report = put("report", "chr1\tm\t1\tC\tGB1\t=\tRS1\tP\t100\tucsc1\nchr2\tm\t2\tC\tGB2\t=\tna\tP\t50\tna\n")
    lengths = spark.createDataFrame([("RS1", 100), ("chr2", 51)], "contig string, length long")
    assert {(r.alias, r.contig) for r in text.read_assembly_report(spark, report, lengths).collect()} == {("chr1", "RS1"), ("GB1", "RS1"), ("RS1", "RS1"), ("ucsc1", "RS1")}


def test_round_trips(spark, put, tmp_path):
    bed = spark.createDataFrame([("c", 5, 9), ("c", 1, 3)], "contig string, start long, end long")
    sinks.write_bed(bed, str(tmp_path / "o.bed"))
    assert [(r.start, r.end) for r in text.read_bed(spark, str(tmp_path / "o.bed")).collect()] == [(1, 3), (5, 9)]
    fa = text.read_fasta(spark, put("r.fa", ">c1\n" + "ACGT" * 40 + "\n>c2\nAC\n"), chunk=120)
    sinks.write_fasta(fa.coalesce(1), str(tmp_path / "o.fa"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "o.fa")).collect()]
    assert lines[0] == ">c1" and [len(x) for x in lines[1:4]] == [60, 60, 40] and lines[4:] == [">c2", "AC"]
    tsv = spark.createDataFrame([("b", 1), ("a", 2)], "k string, v long")
    sinks.write_tsv(tsv, str(tmp_path / "o.tsv"), ["k", "v"], ["k"], single=True)
    assert [tuple(r) for r in text.read_tsv(spark, str(tmp_path / "o.tsv"), ["k", "v"]).collect()] == [("a", "2"), ("b", "1")]
    with pytest.raises(ValueError):
        text.read_tsv(spark, str(tmp_path / "o.tsv"), ["k"])
    paf = text.read_paf(spark, put("r.paf", "q\t10\t0\t10\t+\tt\t12\t1\t11\t10\t10\t60\tcg:Z:10=\n"))
    sinks.write_paf(paf, str(tmp_path / "o.paf"))
    assert text.read_paf(spark, str(tmp_path / "o.paf")).drop("record_id").exceptAll(paf.drop("record_id")).count() == 0
    sinks.write_vcf(spark.createDataFrame([("c", 4, "A", "G", "0/1")], "contig string, pos long, ref string, alt string, genotype string"), str(tmp_path / "o.vcf"), "S")
    assert text.read_vcf(spark, str(tmp_path / "o.vcf")).first().genotypes == {"S": "0/1"}
