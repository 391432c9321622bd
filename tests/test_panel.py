"""Coverage of feature sets, classes and transcripts, base by base."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import panel
from strandframe.operators import resampling as rs
from strandframe.operators import sequence as sq

SPAN = "contig string, start long, end long"


def test_coverage_of_sets(spark):
    rng = random.Random(3)
    feats = [(s, f"g{k}", "c" if k % 3 else "d", a := rng.randrange(900), a + rng.randrange(1, 60)) for k in range(80) for s in rng.sample(["x", "y", "z"], 2)]
    mapping = [("c", a := rng.randrange(1000), a + rng.randrange(1, 40)) for _ in range(40)]
    got = {r.set: r for r in panel.set_coverage(spark.createDataFrame([*feats, feats[0], ("w", "lone", "e", 0, 5)], "set string, id string, contig string, start long, end long"), spark.createDataFrame(mapping, SPAN)).collect()}
    open_ = {(c, p) for c, a, b in mapping for p in range(a, b)}
    for s in "xyz":
        own = {f[1]: f for f in feats if f[0] == s}
        of = lambda f: {(f[2], p) for p in range(f[3], f[4])}
        union = set().union(*(of(f) for f in own.values()))
        want = (len(own), sum(bool(of(f) & open_) for f in own.values()), sum(of(f) <= open_ for f in own.values()), len(union), len(union & open_), len(union - open_))
        r = got[s]
        assert (r.features, r.overlapped, r.covered, r.bases, r.callable_bases, r.lost_bases) == want
    assert (got["w"].overlapped, got["w"].covered, got["w"].lost_bases) == (0, 0, 5)


def test_classes_and_their_bootstrap(spark):
    classes = spark.createDataFrame([("CDS", "c", 0, 250), ("CDS", "d", 5, 30), ("gene", "c", 100, 400)], "class string, contig string, start long, end long")
    snvs = spark.createDataFrame([("c", 10), ("c", 10), ("c", 150), ("c", 399), ("d", 4), ("d", 29), ("e", 1)], "contig string, pos long")
    blocks = panel.class_blocks(classes, snvs, 100).cache()
    assert {tuple(r) for r in blocks.select("class", "contig", "block", "den", "num").collect()} == {("CDS", "c", 0, 100, 1), ("CDS", "c", 1, 100, 1), ("CDS", "c", 2, 50, 0), ("CDS", "d", 0, 25, 1), ("gene", "c", 1, 100, 1), ("gene", "c", 2, 100, 0), ("gene", "c", 3, 100, 1)}
    got = {r["class"]: r for r in panel.class_diversity(blocks, "ds", 50).collect()}
    assert (got["CDS"].numerator, got["CDS"].denominator, got["gene"].estimate) == (3, 275, pytest.approx(2 / 300))
    import hashlib

    seed = int(hashlib.sha256(b"ds:gene").hexdigest()[:16], 16)
    alone = rs.bootstrap_ratio(blocks.where(F.col("class") == "gene"), 50, seed, ["contig", "block"]).first()
    assert got["gene"].ci_low == alone.ci_low and got["gene"].ci_high == alone.ci_high
    with pytest.raises(ValueError):
        panel.class_diversity(blocks.where("false"), "ds", 50)


def test_bases_and_features_of_variants(spark):
    table = sq.chunks(spark.createDataFrame([("c", "ACGNNACGTN")], "contig string, seq string"), "seq", size=4)
    spans = spark.createDataFrame([("a", "c", 0, 6), ("b", "c", 4, 10)], "k string, contig string, start long, end long")
    assert {tuple(r) for r in panel.acgt_only(spans, table, ["k"]).collect()} == {("a", "c", 0, 3), ("a", "c", 5, 6), ("b", "c", 5, 9)}
    feats = spark.createDataFrame([("c", 0, 5, "g2,g1", "t1"), ("c", 3, 9, "g1", None)], "contig string, start long, end long, genes string, transcripts string")
    v = spark.createDataFrame([("c", 4, "N", "A"), ("c", 8, "T", "A"), ("c", 9, "N", "A")], "contig string, pos long, ref string, alt string")
    got = {(r.pos, r.genes, r.transcripts) for r in panel.variant_features(v, feats, ["genes", "transcripts"]).collect()}
    assert got == {(4, "g1,g2", "t1"), (8, "g1", "")}


SEQ = "ATGGCTTAACCC" + "GGGTTATTAGCCATNN" + "ATGGCC"
SEGS = "transcript_id string, contig string, strand string, start long, end long, phase int"


def made(spark):
    rows = [
        ("good", "c", "+", 0, 6, 0), ("good", "c", "+", 28, 34, 0), ("stop_at_end", "c", "+", 0, 9, 0), ("minus", "c", "-", 14, 26, 0), ("inside", "c", "+", 0, 12, 0), ("partial", "c", "+", 0, 5, 0), ("chain", "c", "+", 0, 4, 0), ("chain", "c", "+", 6, 11, 0),
        ("two", "c", "+", 0, 3, 0), ("two", "d", "+", 0, 3, 0), ("over", "c", "+", 0, 6, 0), ("over", "c", "+", 4, 10, 0), ("dup", "c", "+", 0, 3, 0), ("dup", "c", "+", 0, 3, 0), ("far", "c", "+", 30, 39, 0), ("unclear", "c", "+", 25, 28, 0), ("phaseless", "c", "+", 0, 3, None), ("absent", "x", "+", 0, 3, 0),
        ("trimmed", "c", "+", 2, 6, 1),
    ]
    return spark.createDataFrame(rows, SEGS), sq.chunks(spark.createDataFrame([("c", SEQ), ("d", "ACGT")], "contig string, seq string"), "seq", size=5)


def test_each_transcript_is_judged_alone(spark):
    segments, table = made(spark)
    got = {r.transcript_id: (r.error, r.cds, r.terminal_stop) for r in panel.transcript_errors(segments, table, 5).collect()}
    assert got["good"] == (None, "ATGGCTATGGCC", False) and got["stop_at_end"] == (None, "ATGGCT", True) and got["trimmed"] == (None, "GCT", False)
    assert got["minus"] == (None, "ATGGCTAATAAC", False)
    errors = {"inside": "internal_stop", "partial": "partial_codon", "chain": "phase_chain", "two": "several_contigs_or_strands", "over": "overlapping_segments", "dup": "duplicate_segment", "far": "outside_contig", "unclear": "ambiguous_base", "phaseless": "bad_phase", "absent": "outside_contig"}
    assert {k: got[k][0] for k in errors} == errors and all(got[k][1] is None for k in errors)


def test_one_bad_transcript_does_not_lose_the_others(spark):
    segments, table = made(spark)
    names = ["good", "inside", "over", "stop_at_end"]
    some = segments.where(F.col("transcript_id").isin(names))
    declared = spark.createDataFrame([("stop_at_end", "known pseudogene")], "transcript_id string, reason string")
    sites, out = panel.exact_fourfold_sites(some, table, 5, declared)
    assert {tuple(r) for r in sites.collect()} == {("c", 5), ("c", 33)}
    assert {tuple(r) for r in out.collect()} == {("stop_at_end", "known pseudogene"), ("inside", "internal_stop"), ("over", "overlapping_segments")}
    with pytest.raises(ValueError, match="absent"):
        panel.exact_fourfold_sites(some, table, 5, spark.createDataFrame([("nobody", "x")], declared.schema))
    with pytest.raises(ValueError, match="every canonical"):
        panel.exact_fourfold_sites(segments.where("transcript_id = 'inside'"), table, 5)


def test_canonical_transcripts_must_translate(spark):
    segments, table = made(spark)
    errors = panel.transcript_errors(segments, table, 5).cache()
    rows = [("g1", "good", False, False), ("g1", "inside", False, False), ("g1", "stop_at_end", False, False), ("g2", "partial", False, False), ("g3", "trimmed", True, False), ("g3", "good", False, True), ("g4", "over", False, True)]
    of = lambda rows: spark.createDataFrame(rows, "gene_id string, transcript_id string, canonical boolean, exception boolean")
    chosen, left = panel.validated_canonical(of(rows), errors)
    assert {(r.gene_id, r.transcript_id) for r in chosen.collect()} == {("g1", "good"), ("g3", "trimmed")}
    assert {tuple(r) for r in left.collect()} == {("annotated_translation_exception", 2), ("invalid_candidate_transcript", 2), ("gene_without_valid_cds", 2)}
    with pytest.raises(Exception, match="inside is invalid: internal_stop"):
        panel.validated_canonical(of([("g", "inside", True, False)]), errors)[0].collect()
    with pytest.raises(Exception, match="several provider-canonical"):
        panel.validated_canonical(of([("g", "good", True, False), ("g", "trimmed", True, False)]), errors)[0].collect()
