"""Single operators on small inputs with answers by hand or by a second, plain version."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandframe.functions import scalars as sc
from strandframe.operators import alignment as al
from strandframe.operators import graph
from strandframe.operators import intervals as iv
from strandframe.operators import ledger as lg
from strandframe.operators import population as po
from strandframe.operators import reads as rd
from strandframe.operators import selection as se
from strandframe.operators import sequence as sq
from strandframe.operators import statistics as st
from strandframe.streaming import windows as wi

IV = "contig string, start long, end long"


def ivs(spark, *rows):
    return spark.createDataFrame([("c", a, b) for a, b in rows], IV)


def spans(df):
    return sorted((r.start, r.end) for r in df.collect())


def test_touching_intervals_merge_across_bins(spark):
    a = ivs(spark, (0, 5), (5, 9), (20, 30), (25, 26), (31, 31))
    for width in (2, 7, 64):
        assert spans(iv.merge(a, width=width)) == [(0, 9), (20, 30)]
    assert spans(iv.merge(a.where("false"))) == []


def test_algebra_against_bases(spark):
    rng = random.Random(1)
    make = lambda n: [(a, a + rng.randrange(1, 40)) for a in (rng.randrange(400) for _ in range(n))]
    x, y = make(40), make(30)
    bx, by = ({p for a, b in s for p in range(a, b)} for s in (x, y))
    a, b = ivs(spark, *x), ivs(spark, *y)
    bases = lambda df: {p for s, e in spans(df) for p in range(s, e)}
    assert bases(iv.intersect(a, b, width=16)) == bx & by
    assert bases(iv.subtract(a, b, width=16)) == bx - by
    assert iv.measure(a, width=16).first().bases == len(bx)
    depth = lambda p: sum(s <= p < e for s, e in x)
    assert iv.max_depth(a, width=16).first().max_depth == max(map(depth, bx))
    assert bases(iv.uniquely_covered(a, width=16)) == {p for p in bx if depth(p) == 1}
    pairs = iv.overlaps(a.distinct(), b.distinct(), width=16).count()
    assert pairs == sum(s < f and r < e for s, e in set(x) for r, f in set(y))
    reasons = b.withColumn("reason", F.when(F.col("start") % 2 == 0, "even").otherwise("odd"))
    parts = iv.reason_mask(ivs(spark, (0, 450)), reasons, ["odd", "even"], width=16)
    assert sum(r.end - r.start for r in parts.collect()) == 450
    with pytest.raises(PySparkException):
        iv.require_valid(ivs(spark, (5, 5))).collect()


def test_depth_masks_break_at_gaps(spark):
    d = spark.createDataFrame([("c", 1, 5), ("c", 2, 5), ("c", 4, 5), ("c", 5, 1)], "contig string, pos long, depth long")
    got = {(r.name, r.start, r.end) for r in iv.depth_masks(d, [("deep", 2, None), ("any", 1, 9)]).collect()}
    assert got == {("deep", 0, 2), ("deep", 3, 4), ("any", 0, 2), ("any", 3, 5)}


RECORD = "record_id long, query string, query_length long, query_start long, query_end long, strand string, target string, target_length long, target_start long, target_end long, matches long, block long, mapq long, cigar string"


def test_alignment_walk(spark):
    # target ACGTACGTAC, query ACGAACGGTAC on +: 3=1X3=1I3=
    r = spark.createDataFrame([(1, "q", 11, 0, 11, "+", "t", 10, 0, 10, 9, 11, 60, "3=1X3=1I3=")], RECORD)
    ops = {(x.op, x.t_start, x.t_end, x.q_start, x.q_end) for x in al.segments(r).collect()}
    assert ("X", 3, 4, 3, 4) in ops and ("I", 7, 7, 7, 8) in ops
    good, snvs, counts = al.traverse(r, 1, 0)
    assert spans(good) == [(1, 7), (8, 9)] and spans(snvs) == [(3, 4)]
    assert {c.reason: c.bases for c in counts.collect()} == {"alignment_edge": 2, "indel_flank": 1, "multiple_projection": 0, "ambiguous_base": 0}
    seqs = spark.createDataFrame([(1, "ACGTACGTAC", "ACGAACGGTAC")], "record_id long, target_seq string, query_seq string")
    assert {(v.pos, v.ref, v.alt) for v in al.variants(r, seqs).collect()} == {(4, "T", "A"), (7, "G", "GG")}
    assert al.replayed(r, seqs).first().mismatched == 0
    back = r.withColumn("strand", F.lit("-"))
    assert spans(al.project(back, ivs(spark, (0, 3)).withColumn("contig", F.lit("q")))) == [(7, 10)]
    for bad in ("3=1M", "3=1X", "", None):
        with pytest.raises(PySparkException):
            al.segments(r.withColumn("cigar", F.lit(bad).cast("string"))).collect()


def test_sweep_of_records_over_bins(spark):
    """Records around the edges of bins, against base by base; operations are never exploded, so none is shuffled."""
    rng, edge, flank, rows = random.Random(11), 4, 3, []
    depth, edges, flanks, changed = ({} for _ in range(4))
    for i in range(60):
        ops = [(rng.randrange(1, 9), rng.choice("=X=ID")) for _ in range(rng.randrange(1, 8))]
        if i == 0:
            ops = [(70_000, "="), (3, "D"), (70_000, "=")]
        t, q = (sum(n for n, o in ops if o in x) for x in ("=XD", "=XI"))
        t0 = rng.randrange(100) + iv.BIN * rng.choice([1, 2]) - 60 if i else 1000
        t1, at, c = t0 + t, t0, f"t{i % 2}"
        rows.append((i, "q", 10**9, 0, q, "+-"[i % 2], c, 10**9, t0, t1, 1, 1, 60, "".join(f"{n}{o}" for n, o in ops)))
        for p in [*range(t0, min(t1, t0 + edge)), *range(max(t0, t1 - edge), t1)]:
            edges[c, p] = True
        for n, o in ops:
            end = at + n * (o != "I")
            for p in range(at, end) if o in "=X" else range(max(t0, at - flank), min(t1, end + flank + (o == "I"))):
                if o in "=X":
                    depth[c, p] = depth.get((c, p), 0) + 1
                    changed[c, p] = changed.get((c, p), False) or o == "X"
                else:
                    flanks[c, p] = True
            at = end
    doubt = {("t0", p) for p in [*range(65_530, 65_545), *range(2000, 2010)]}
    unclear = spark.createDataFrame([("t0", 65_530, 65_545), ("t0", 2000, 2010)], "contig string, start long, end long")
    good, snvs, counts = al.traverse(spark.createDataFrame(rows, RECORD), edge, flank, unclear)
    want = {p for p, n in depth.items() if n == 1 and p not in edges and p not in flanks and p not in doubt}
    bases = lambda df: [(r.contig, p) for r in df.collect() for p in range(r.start, r.end)]
    assert sorted(bases(good)) == sorted(want) and sorted(bases(snvs)) == sorted(p for p in want if changed[p])
    assert not {(r.contig, r.end) for r in good.collect()} & {(r.contig, r.start) for r in good.collect()}
    assert {r.reason: r.bases for r in counts.collect()} == {"alignment_edge": len(edges), "indel_flank": len(flanks), "multiple_projection": sum(n > 1 for n in depth.values()), "ambiguous_base": sum(n == 1 and p in doubt for p, n in depth.items())}
    assert "explode" not in good._jdf.queryExecution().optimizedPlan().toString().replace("explode(sequence", "")


def test_segments_are_walked_where_records_lie(spark):
    rng, rows, want = random.Random(5), [], set()
    for i in range(40):
        ops = [(rng.randrange(1, 1200), rng.choice("=XID")) for _ in range(rng.choice([1, 3, 2000]))]
        t, q = (sum(n for n, o in ops if o in x) for x in ("=XD", "=XI"))
        rows.append((i, "q", 10**9, 50, 50 + q, "+-"[i % 2], "t", 10**9, 7, 7 + t, 1, 1, 60, "".join(f"{n}{o}" for n, o in ops)))
        a, b = 7, 0
        for k, (n, o) in enumerate(ops):
            on_t, on_q = n * (o in "=XD"), n * (o in "=XI")
            start = 50 + q - b - on_q if i % 2 else 50 + b
            want.add((i, k, o, n, a, a + on_t, start, start + on_q))
            a, b = a + on_t, b + on_q
    found = al.segments(spark.createDataFrame(rows, RECORD))
    assert "cigar" not in found.columns and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.select("record_id", "op_index", "op", "length", "t_start", "t_end", "q_start", "q_end").collect()} == want


def test_multiplicity_is_the_greedy_one(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        q, t, n = rng.randrange(600), rng.randrange(600), rng.randrange(5, 60)
        rows.append((i, f"q{i % 3}", 1000, q, q + n, "+", f"t{i % 2}", 1000, t, t + n, n - rng.randrange(3), n, 60, f"{n}="))
    key = lambda r: (-(__import__("math").log1p(r[11]) * r[10] / r[11]), -r[10], -r[11], r[1], r[3], r[4], r[6], r[8], r[9])
    kept = []
    for r in sorted(rows, key=key):
        if all((r[1] != k[1] or r[4] <= k[3] or k[4] <= r[3]) and (r[6] != k[6] or r[9] <= k[8] or k[9] <= r[8]) for k in kept):
            kept.append(r)
    got = al.exact_multiplicity(spark.createDataFrame(rows, RECORD))
    assert {r.record_id for r in got.collect()} == {k[0] for k in kept}


def test_multiplicity_of_many_small_groups(spark):
    """Pairs that overlap, and records alone: no call a group, and records alone meet no other."""
    rows = [(2 * i + k, "q", 10**9, 100 * i + 5 * k, 100 * i + 5 * k + 20 + k, "+", f"t{i % 3}", 10**9, 100 * i, 100 * i + 20 + k, 20 + k, 20 + k, 60, f"{20 + k}=") for i in range(2000) for k in range(1 + i % 2)]
    kept = al.exact_multiplicity(spark.createDataFrame(rows, RECORD))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "MapInArrow" in plan
    assert {r.record_id for r in kept.collect()} == {2 * i + i % 2 for i in range(2000)}
    assert al.conflict_groups(spark.createDataFrame(rows, RECORD)).where("group is null").count() == 1000


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 300) if i % 60 != 59] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: i // 60 * 60 for i in range(300)}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_codons(spark):
    assert sum(a == "*" for a in sq.CODONS.values()) == 3 and len(sq.FOURFOLD) == 32
    one = spark.createDataFrame([("ATGGCTTAA", "acgtn")], "s string, r string")
    r = one.select(sq.translate("s").alias("p"), sq.translation_state("s").alias("t"), sq.reverse_complement("r").alias("c")).first()
    assert (r.p, r.t, r.c) == ("MA", "ok", "nacgt")
    states = spark.createDataFrame([("ATGTAAGCT",), ("ATGN",), ("ATGNNN",)], "s string").select(sq.translation_state("s").alias("t"))
    assert [x.t for x in states.collect()] == ["internal_stop", "length", "symbol"]


def test_fourfold_sites(spark):
    #      0123456789
    seq = "CCATGGCTTAACC"
    table = sq.chunks(spark.createDataFrame([("c", seq)], "contig string, s string"), "s", size=4)
    cds = spark.createDataFrame([("t1", "c", 2, 5, "+", 0), ("t1", "c", 5, 11, "+", 0)], "transcript_id string, contig string, start long, end long, strand string, phase int")
    seqs = sq.coding_sequences(cds, table, 4)
    assert seqs.first().cds == "ATGGCTTAA"
    assert [(r.contig, r.pos) for r in sq.fourfold_sites(cds, seqs).collect()] == [("c", 7)]
    rev = spark.createDataFrame([("t2", "c", 0, 9, "-", 0)], cds.schema)
    assert sq.coding_sequences(rev, table, 4).first().cds == "AAGCCATGG"
    assert {r.pos: r.cds_index for r in sq.coding_positions(rev).collect()}[8] == 0
    assert sq.phase_chain(cds).first().reason == "ok"
    assert sq.phase_chain(cds.withColumn("phase", F.lit(1))).first().reason == "length"
    assert sq.phase_chain(cds.withColumn("phase", F.when(F.col("start") == 5, 1).otherwise(0))).first().reason == "phase"
    with pytest.raises(PySparkException):
        sq.ordered_segments(cds.unionByName(cds)).collect()


def test_low_complexity_and_consensus(spark):
    seq = "CG" + "A" * 12 + "CGT" + "AC" * 10 + "G" + "ACG" * 7 + "TTNNNN"
    table = sq.chunks(spark.createDataFrame([("c", seq)], "contig string, s string"), "s")
    assert spans(sq.non_acgt(table)) == [(61, 65)]
    assert spans(sq.low_complexity(table))[0] == (2, 14)
    bins = sq.psmcfa(spark.createDataFrame([("c", 0, "A" * 100 + "A" * 50 + "R" + "A" * 49 + "ANA")], "contig string, chunk_start long, seq string"))
    assert [r.symbol for r in bins.orderBy("bin").collect()] == ["T", "K", "N"]
    made = spark.createDataFrame([("ACGTAC", 10, [(11, "Y"), (15, "R")])], "s string, at long, v array<struct<pos:long,code:string>>")
    assert made.select(sq.apply_consensus(F.col("s"), F.col("at"), F.col("v")).alias("x")).first().x == "AYGTAR"


def test_genotypes_and_diversity(spark):
    g = spark.createDataFrame([("0/1",), ("1|1",), ("./.",)], "g string")
    assert [r.x for r in g.select(po.genotype("g").alias("x")).collect()] == [[0, 1], [1, 1], [None, None]]
    assert [r.x for r in g.select(po.genotype("g", inbred=True).alias("x")).collect()] == [[None], [1], [None]]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("0/1/1",)], "g string").select(po.genotype("g")).collect()
    d = spark.createDataFrame([(3, 1), (1, 0)], "a long, b long").select(po.pairwise_diversity([F.col("a"), F.col("b")]).alias("d"))
    assert [r.d for r in d.collect()] == [0.5, None]


def test_pileup_and_spectrum():
    assert rd.count_pileup("^~.,A+2ACg$*-1T<", "C", "A") == (2, 1, 1, 1)
    with pytest.raises(ValueError):
        rd.count_pileup("A+C", "C", "A")
    import numpy as np

    depths = np.arange(1, 120, dtype=float)
    one, two = rd.negative_binomial(depths, np.array([20.0, 40.0]), 300)
    assert abs(one.sum() - 1) < 1e-6 and abs((one * depths).sum() - 20) < 1e-3
    made = 2e5 * one + 1e6 * two
    fit = rd.fit_spectrum({int(d): int(c) for d, c in zip(depths, made, strict=True)}, 21)
    want = 1 - (2e6 / (2e5 + 2e6)) ** (1 / 21)
    assert fit["status"] == "estimated" and abs(fit["heterozygosity"] - want) < 2e-4


def test_models_recover_parameters(spark):
    rng = random.Random(4)
    rows = [(f"c{i % 4}", x, 0.4 + 0.1 * (i % 4) + 0.025 * x) for i, x in ((i, rng.uniform(3, 9)) for i in range(80))]
    d = spark.createDataFrame(rows, "class string, x double, y double")
    fit = st.ols_fixed_effects(d, "x", "y", "class").first()
    assert abs(fit.effect - 0.025) < 1e-9 and fit.levels == 4
    curved = d.withColumn("y", 1 - 0.004 * F.col("x") * F.col("x"))
    assert abs(st.quadratic(curved, "x", "y").first().quadratic + 0.004) < 1e-9
    mm = spark.createDataFrame([("g", float(x), 5 * x / (3 + x)) for x in range(1, 30)], "k string, x double, y double")
    got = st.michaelis_menten(mm, "x", "y", ["k"]).first()
    assert abs(got.a - 5) < 1e-6 and abs(got.b - 3) < 1e-6
    p = spark.createDataFrame([("f", 0.01), ("f", 0.02), ("f", 0.02), ("f", 0.9), ("f", None)], "f string, p double")
    assert [round(r.q, 6) if r.q is not None else None for r in st.benjamini_hochberg(p, "p", ["f"]).orderBy(F.col("p").asc_nulls_last()).collect()] == [0.026667, 0.026667, 0.026667, 0.9, None]
    assert abs(spark.createDataFrame([(1.959963984540054,)], "z double").select(st.two_sided_p("z").alias("p")).first().p - 0.05) < 1e-12


def test_ledgers_fail_closed(spark):
    d = spark.createDataFrame([(1, "A", 3, 1, 2), (2, "B", 5, 2, 3)], "id long, s string, n long, a long, b long")
    assert lg.require_unique(d, ["id"]).count() == 2
    for bad in (lambda: lg.require_unique(d.unionByName(d), ["id"]), lambda: lg.require_domain(d, "s", ["A"]), lambda: lg.require_sum(d.withColumn("n", F.lit(9)), "n", ["a", "b"]), lambda: lg.strict_join(d, d.where("id = 1"), ["id"]), lambda: lg.require_header(d, ["id"]), lambda: lg.require_all_matched(d, d.where("id = 1"), ["id"])):
        with pytest.raises(lg.LedgerError):
            bad()
    assert lg.require_sum(d, "n", ["a", "b"]).count() == 2
    twice = spark.createDataFrame([("g", "t1", 9, True, True, False), ("g", "t2", 9, True, True, False)], "gene_id string, transcript_id string, length long, valid boolean, canonical boolean, exception boolean")
    with pytest.raises(PySparkException):
        se.canonical_transcripts(twice).collect()
    assert se.canonical_transcripts(twice.withColumn("canonical", F.lit(False))).first().transcript_id == "t1"
    assert [r["k"] for r in se.novelty_cover([{"k": 1, "a": "x", "size": 3}, {"k": 2, "a": "x", "size": 1}, {"k": 3, "a": "y", "size": 9}], ["a"], 2)] == [2, 3]


def test_scalars(spark):
    d = spark.createDataFrame([("a=1;b=x%20y",), ('gene_id "g 1"; tag "t"',)], "t string").select(sc.attributes(F.col("t")).alias("m"))
    assert [r.m for r in d.collect()] == [{"a": "1", "b": "x y"}, {"gene_id": "g 1", "tag": "t"}]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("nonsense",)], "t string").select(sc.attributes(F.col("t"))).collect()
    m = spark.createDataFrame([("512K", 2), ("4Gc", 3), ("", 1), (None, 1)], "t string, n long")
    assert [r.x for r in m.select(sc.requested_memory_mib(F.col("t"), F.col("n")).alias("x")).collect()] == [0.5, 12288.0, None, None]
    o = spark.createDataFrame([("2020/01/02 00:00",), ("2020-01-02",), ("?",)], "t string").select(se.release_ordinal(F.col("t")).alias("d"))
    import datetime

    assert [r.d for r in o.collect()] == [datetime.date(2020, 1, 2).toordinal()] * 2 + [0]


def test_streaming_windows(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "a", 1.0, 1) for m in (1, 2, 31, 32, 59)]
    e = spark.createDataFrame(rows, "t string, event_type string, value double, user_id long").withColumn("ts", F.to_timestamp("t")).drop("t")
    e.write.parquet(str(tmp_path / "in"))
    q = wi.tumbling(wi.read_stream(spark, str(tmp_path / "in"), e), "30 minutes").writeStream.format("memory").queryName("tumbling_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("tumbling_test").collect()) == [2, 3]
    assert sorted(r.n for r in wi.sessions(e, "10 minutes").collect()) == [1, 2, 2]


def test_low_complexity_over_chunk_edges(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("ACGT") for _ in range(50)) + "A" * 13 + "CGT" + "AC" * 12 + "GGT" + "ACG" * 9 + "TT" + "G" * 70 + "CATG"
    whole = sq.low_complexity(spark.createDataFrame([("c", 0, text)], "contig string, chunk_start long, seq string")).collect()
    for size in (21, 25, 40):
        parts = [("c", i, text[i : i + size]) for i in range(0, len(text), size)]
        got = sq.low_complexity(spark.createDataFrame(parts, "contig string, chunk_start long, seq string")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, whole)) and len(whole) >= 4


def test_plus_signs_in_attributes(spark):
    d = spark.createDataFrame([("Note=a+b%2Bc%20d",)], "a string")
    assert d.select(sc.attributes(F.col("a")).alias("m")).first().m == {"Note": "a+b+c d"}


def test_low_complexity_is_the_same_for_every_chunk_size(spark):
    import random
    import re

    rng = random.Random(9)
    parts = ["A" * 10, "CT" * 10 + "C", "ACG" * 9, "AC" * 11, "CA" * 10, "ACA" * 8, "N" * 4, "G" * 25, "GT" * 9, "TAT" * 7 + "TA", "CTC" * 7]
    text = "".join(rng.choice(parts) + "".join(rng.choices("ACGT", k=rng.choice([0, 0, 1, 3, 8]))) for _ in range(40))
    patterns = [r"([ACGT])\1{9,}", r"([ACGT]{2})\1{9,}", r"([ACGT]{3})\1{6,}"]
    open_ = {p for x in patterns for m in re.finditer(x, text) for p in range(m.start(), m.end())}
    assert open_ and len(open_) < len(text)
    sizes = [1, 2, 3, 5, 22, 41, 45, 1000, len(text)]
    rows = [(str(size), k, text[k : k + size]) for size in sizes for k in range(0, len(text), size)]
    got = {}
    for r in sq.low_complexity(spark.createDataFrame(rows, "contig string, chunk_start long, seq string").repartition(6)).collect():
        got.setdefault(r.contig, set()).update(range(r.start, r.end))
    for size in sizes:
        assert got[str(size)] == open_, size
