"""Variant files in all their forms give the same rows; broken ones are told apart."""

import gzip
import random
import struct

import pytest

from strandframe.sources import blocks, variants

HEADER = variants.header_text({"c1": 10**6, "c2": 5000}, ["s1", "s2", "s3"], ["q10", "low"], ["END", "DP", "FLAG"])


def made(n=3000):
    rng = random.Random(6)
    rows = []
    for contig, k in (("c1", n), ("c2", 40)):
        for pos in sorted(rng.sample(range(5000 if contig == "c2" else 10**6), k)):
            alts = rng.choice([["A"], ["A", "GT"], [], ["<NON_REF>"]])
            info = {"DP": str(rng.randrange(99))} | ({"END": str(pos + 50)} if alts == ["<NON_REF>"] else {})
            calls = {s: rng.choice(["0/0", "0|1", "./.", ".", "1", "0/1/1", "1|0"] if alts else ["0/0", "./."]) for s in ("s1", "s2", "s3")}
            rows.append({"contig": contig, "pos0": pos, "ref": rng.choice(["C", "CATG" * 9]), "alts": alts, "filters": rng.choice([[], ["q10"], ["q10", "low"]]), "info": info, "genotypes": calls})
    return rows


def text_of(rows):
    line = lambda r: "\t".join([r["contig"], str(r["pos0"] + 1), ".", r["ref"], ",".join(r["alts"]) or ".", ".", ";".join(r["filters"]) or "PASS", ";".join(f"{k}={v}" for k, v in r["info"].items()) or ".", "GT:DP", *(f"{r['genotypes'][s]}:7" for s in ("s1", "s2", "s3"))])
    return HEADER + "\n".join(map(line, rows)) + "\n"


def collected(df):
    pick = lambda r: (r.contig, r.pos0, r.ref, tuple(r.alts), tuple(r.filters), tuple(sorted(r.info.items())), tuple(sorted(r.genotypes.items())))
    return [pick(r) for r in df.orderBy("file", "at").collect()]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """The same rows as text, gzip, blocked text with and without an index, and binary with and without one."""
    at, rows = tmp_path_factory.mktemp("variants"), made()
    text = text_of(rows).encode()
    (at / "a.vcf").write_bytes(text)
    (at / "b.vcf.gz").write_bytes(gzip.compress(text))
    packed = blocks.compressed(text)
    (at / "c.vcf.gz").write_bytes(packed)
    (at / "d.vcf.gz").write_bytes(packed)
    (at / "d.vcf.gz.gzi").write_bytes(blocks.gzi(blocks.checked_blocks(str(at / "d.vcf.gz"))))
    data, index = variants.binary_file(HEADER, iter(rows))
    (at / "e.bcf").write_bytes(data)
    (at / "f.bcf").write_bytes(data)
    (at / "f.bcf.csi").write_bytes(index)
    want = [(r["contig"], r["pos0"], r["ref"], tuple(r["alts"]), tuple(r["filters"]), tuple(sorted(r["info"].items())), tuple(sorted(r["genotypes"].items()))) for r in rows]
    return at, want


@pytest.mark.parametrize(("name", "parts"), [("a.vcf", 3), ("b.vcf.gz", 1), ("c.vcf.gz", 2), ("d.vcf.gz", 2), ("e.bcf", 1), ("f.bcf", 2)])
def test_every_form_gives_the_same_rows(spark, files, name, parts):
    at, want = files
    df = variants.read_variants(spark, str(at / name), split_bytes=20000)
    assert df.rdd.getNumPartitions() >= parts and (parts > 1 or df.rdd.getNumPartitions() == 1)
    assert collected(df) == want
    few = variants.read_variants(spark, f"file:{at / name}", samples=["s2"], split_bytes=7000)
    assert collected(few) == [(*w[:6], tuple(x for x in w[6] if x[0] == "s2")) for w in want]


def test_splits_at_every_size_lose_and_repeat_no_line(tmp_path):
    rng = random.Random(1)
    text = b"".join(bytes(rng.choices(b"abc", k=rng.choice([0, 1, 5, 70000]))) + b"\n" for _ in range(200)) + b"tail"
    want = [x for x in text.split(b"\n") if x]
    path = tmp_path / "x.gz"
    path.write_bytes(blocks.compressed(text))
    total = path.stat().st_size
    for size in (1, 300, 5000, total):
        got = []
        for a, b in blocks.splits(str(path), size):
            with blocks.opened(str(path)) as f:
                got += [x for x in blocks.lines(blocks.members(f, a, total), a == 0, b) if x]
        assert got == want, size


def test_written_ranges_are_read_back(spark, tmp_path, files):
    _, want = files
    rows = variants.read_variants(spark, str(files[0] / "a.vcf"), split_bytes=20000)
    out = str(tmp_path / "out")
    variants.write_variants(rows.repartition(4), out, {"c1": 10**6, "c2": 5000}, ["s1", "s2", "s3"], ["q10", "low"], ["END", "DP", "FLAG"])
    assert len(blocks.files_of(out, [".bcf"])) > 1 and not list((tmp_path / "out").glob(".*"))
    assert sorted(collected(variants.read_variants(spark, out))) == sorted(want)
    empty = rows.where("false")
    variants.write_variants(empty, str(tmp_path / "none"), {"c1": 10}, ["s1"])
    assert variants.read_variants(spark, str(tmp_path / "none")).count() == 0


def fails(spark, path, word, **more):
    with pytest.raises(Exception, match=word):
        variants.read_variants(spark, str(path), **more).collect()


def test_broken_indexes_and_blocks_raise(spark, files, tmp_path):
    at, _ = files
    data, index = (at / "f.bcf").read_bytes(), b"".join(d for _, d in blocks.members(blocks.opened(str(at / "f.bcf.csi")), 0, (at / "f.bcf.csi").stat().st_size))
    count, offset = struct.unpack_from("<i", index, 20)[0], 24
    assert count > 0

    def binary(name, raw, own=data):
        (tmp_path / f"{name}.bcf").write_bytes(own)
        (tmp_path / f"{name}.bcf.csi").write_bytes(blocks.compressed(raw))
        return tmp_path / f"{name}.bcf"

    begin = struct.unpack_from("<Q", index, offset + 16)[0]
    moved = index[: offset + 16] + struct.pack("<Q", begin + (1 << 40)) + index[offset + 24 :]
    fails(spark, binary("magic", b"TBI\1" + index[4:]), "CSI_MAGIC")
    fails(spark, binary("short", index[:-20]), "CSI_SIZE")
    fails(spark, binary("range", moved), "CSI_RANGE")
    starts = sorted(variants.read_csi(str(at / "f.bcf.csi"), len(data)))
    late = next(s for s in starts if s[0] > 0)
    inside = index.replace(struct.pack("<Q", late[0] << 16 | late[1]), struct.pack("<Q", (late[0] << 16 | late[1]) + 1))
    fails(spark, binary("inside", inside), "CSI_RECORD|record|RANGE|unpack|offset", split_bytes=1000)
    fails(spark, binary("torn", index, data[: len(data) // 2]), "CSI_RANGE|BGZF")
    flipped = bytearray(data)
    flipped[len(data) // 2] ^= 255
    (tmp_path / "flip.bcf").write_bytes(bytes(flipped))
    fails(spark, tmp_path / "flip.bcf", "BGZF_(DATA|CHECKSUM)|record")

    packed, good = (at / "d.vcf.gz").read_bytes(), (at / "d.vcf.gz.gzi").read_bytes()
    n = struct.unpack_from("<Q", good)[0]
    assert n > 1
    swap = good[:8] + good[24:40] + good[8:24] + good[40:]
    for name, raw, word in (("size", good[:-1], "GZI_SIZE"), ("order", swap, "GZI_ORDER"), ("far", good[:-16] + struct.pack("<QQ", 1 << 40, 1 << 41), "GZI_RANGE"), ("off", good[:8] + struct.pack("<QQ", struct.unpack_from("<Q", good, 8)[0] + 3, 70000)[:16] + good[24:], "BGZF_HEADER")):
        (tmp_path / f"{name}.vcf.gz").write_bytes(packed)
        (tmp_path / f"{name}.vcf.gz.gzi").write_bytes(raw)
        fails(spark, tmp_path / f"{name}.vcf.gz", word, split_bytes=5000)


def test_block_table_names_the_broken_rule(spark, files, tmp_path):
    at, _ = files
    good = (at / "c.vcf.gz").read_bytes()
    cases = {"BGZF_SIZE": good[:10], "BGZF_EOF": good[:-28], "BGZF_HEADER": b"x" + good[1:], "BGZF_EXTRA": good[:12] + b"XX" + good[14:], "BGZF_BLOCK_SIZE": good[:16] + b"\x05\x00" + good[18:], "BGZF_CHECKSUM": None}
    size = struct.unpack_from("<H", good, 16)[0] + 1
    cases["BGZF_CHECKSUM"] = good[: size - 8] + b"\0\0\0\0" + good[size - 4 :]
    for rule, raw in cases.items():
        (tmp_path / rule).write_bytes(raw)
    (tmp_path / "skewed").write_bytes(good)
    (tmp_path / "skewed.gzi").write_bytes(struct.pack("<QQQ", 1, size, 17))
    paths = [*(str(tmp_path / r) for r in cases), str(tmp_path / "skewed"), str(at / "d.vcf.gz")]
    got = {r.path.rsplit("/", 1)[1]: r for r in blocks.block_table(spark, paths).collect()}
    for rule in cases:
        assert got[rule].error.startswith(rule), (rule, got[rule])
    assert got["skewed"].error.startswith("GZI_BLOCK") and got["d.vcf.gz"].error is None and got["d.vcf.gz"].blocks > 2


@pytest.mark.parametrize(
    ("change", "word"),
    [
        (lambda t: t.replace("length=5000", "size=5"), "needs ID and length"),
        (lambda t: t.replace("ID=c2", "ID=c1"), "declared twice"),
        (lambda t: t.replace("s1\ts2", "s1\ts1"), "named twice"),
        (lambda t: t.replace("#CHROM", "#CROM"), "CHROM"),
        (lambda t: t + "c1\t5\t.\tC\tA\n", "fewer than eight"),
        (lambda t: t + "c1\t0\t.\tC\tA\t.\t.\t.\tGT\t0/0\t0/0\t0/0\n", "bad position"),
        (lambda t: t + "c1\t5\t.\tC\tA\t.\t.\t.\tGT\t0/0\t0/0\n", "2 samples, not 3"),
        (lambda t: t + "c1\t5\t.\tC\tA\t.\t.\t.\tDP\t1\t2\t3\n", "no GT"),
        (lambda t: t + "c1\t5\t.\tC\tA\t.\t.\t.\tGT\t0/x\t0/0\t0/0\n", "malformed GT"),
        (lambda t: "c1\t5\t.\tC\tA\t.\t.\t.\n" + t, "before #CHROM"),
    ],
)
def test_broken_text_is_refused(spark, tmp_path, change, word):
    (tmp_path / "x.vcf").write_text(change(text_of(made(3))))
    fails(spark, tmp_path / "x.vcf", word)


def test_repeated_variants_and_unknown_samples_are_refused(spark, files):
    at, want = files
    df = variants.read_variants(spark, str(at / "a.vcf"))
    assert variants.refused_variants(df).count() == len(want)
    with pytest.raises(Exception, match="variant twice: c1"):
        variants.refused_variants(df.union(df.limit(1))).collect()
    fails(spark, at / "a.vcf", "no samples", samples=["s9"])
