"""Near copies and whitening of vectors against plain versions."""

import math

import duckdb
import numpy as np
import pytest

from strandframe.llm import vector_neighbours as nb
from strandframe.llm import whitening as wh
from strandframe.llm.queries import op12_whitening, op13_vector_neighbours

SF = "/root/testdata/sf0.001"


def plain_links(rows, similarity):
    """By all pairs: row index -> (links, smallest id reachable)."""
    ok = [(i, label, np.array(v, float)) for i, (_, label, v) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ok = [(i, label, v / abs(v).max()) for i, label, v in ok]
    near = {i: set() for i in range(len(rows))}
    for k, (i, a, x) in enumerate(ok):
        for j, b, y in ok[k + 1 :]:
            if a == b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= similarity:
                near[i].add(j)
                near[j].add(i)
    out = []
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids, default=None)))
    return out


def crowd(seed, groups, size, dim, spread):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        centre = rng.standard_normal(dim)
        out += [(g % 3, (centre + spread * rng.standard_normal(dim)).tolist()) for _ in range(size)]
    return out


ODD = [
    (None, 1, [1.0, 2.0]), (None, 1, [1.0, 2.0]), (5, 1, [2.0, 4.0]), (5, 1, [2.0, 4.0]), (7, None, [1.0, 2.0]), (8, 2, [1.0, 2.0]), (9, 1, None),
    (10, 1, [0.0, -0.0]), (11, 1, [float("nan"), 1.0]), (12, 1, [float("inf"), 1.0]), (13, 1, [None, 1.0]), (14, 1, []), (15, 1, [1.0, 2.0, 0.0]), (16, 1, [1e200, 2e200]),
    (17, 1, [1e-200, 2e-200]), (18, 2, [-0.0, 3.0]), (19, 2, [0.0, 3.0]),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, label, v, "x", 1) for i, label, v in rows], "vec_id long, label int, embedding array<double>, cls string, root int")


@pytest.mark.parametrize("block", [4, 1024])
def test_links_are_those_of_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", block)
    rows = [(i, label, v) for i, (label, v) in enumerate(crowd(1, 12, 25, 16, 0.1) + crowd(2, 60, 1, 16, 1))] + ODD
    got = sorted(map(tuple, nb.near_vectors(frame(spark, rows), nb.Hashing(projections=6)).select("vec_id", "n_links", "component_id").collect()), key=str)
    assert got == sorted(plain_links(rows, 0.98), key=str)
    assert sum(n for _, n, _ in got) > 1000


def test_kept_rows_and_empty_table(spark):
    got = {(r.vec_id, r.component_id, r.kept) for r in nb.near_vectors(frame(spark, ODD)).collect()}
    assert {(8, 8, True), (19, 18, False), (18, 18, True), (None, 5, False), (9, 9, True), (17, 5, False)} <= got
    assert nb.near_vectors(frame(spark, ODD[:2])).collect()[0].asDict() == {"vec_id": None, "n_links": 1, "component_id": None, "kept": True}
    assert nb.near_vectors(frame(spark, []).where("false")).count() == 0


def test_tables_find_the_least_similar_pairs():
    rng = np.random.default_rng(3)
    x = nb.units(rng.standard_normal((4000, 64)))
    away = rng.standard_normal(x.shape)
    away = nb.units(away - (away * x).sum(1, keepdims=True) * x)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * away
    group = np.zeros(len(x), np.int64)
    met = (nb.keys(x, group, nb.NEAR) == nb.keys(y, group, nb.NEAR)).any(axis=1)
    assert met.mean() > 0.998
    assert (nb.keys(x, group, nb.NEAR)[:-1] == nb.keys(x, group, nb.NEAR)[1:]).mean() < 1e-3
    assert nb.collision(0, 1) == 1.0 and nb.Hashing(similarity=1.0).tables == 1


def test_query_agrees_with_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.sql(nb.ALL_PAIRS_SQL).fetchall()
    assert sorted(map(tuple, op13_vector_neighbours(spark, SF).collect())) == sorted(want) and want


def plain_whitening(rows, k=16):
    """(vec_id, component) -> the other columns, by whole numbers and fractions of numpy."""
    x = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(v) for _, v in x})
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    centred = [[n * v[j] - s[j] for j in range(d)] for v in fit]
    scatter = [[sum(v[i] * v[j] for v in centred) for j in range(d)] for i in range(d)]
    cov = np.array([[scatter[i][j] / n**3 for j in range(d)] for i in range(d)])
    e, basis = np.linalg.eigh(cov)
    e, basis = e[::-1][:k], basis[:, ::-1][:, :k]
    out = []
    for i, v in x:
        dev = [n * v[j] - s[j] for j in range(d)]
        w = (np.array(dev, float) / n) @ basis
        out += [(i, c + 1, n, sum(y * y for y in dev), w[c] / math.sqrt(e[c]) if e[c] > 1e-9 else None, e[c] / np.trace(cov)) for c in range(len(e))]
    return out


def test_whitening_agrees_with_whole_numbers(spark):
    rng = np.random.default_rng(5)
    mixed = rng.standard_normal((300, 20)) @ rng.standard_normal((20, 20)) + 1e3
    rows = [(i, v.tolist()) for i, v in enumerate(mixed)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (400, None), (401, [None] + [1.0] * 19), (402, [float("nan")] * 20), (403, [float("-inf")] * 20), (404, [])]
    got = wh.whiten(spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, x int, n int").repartition(5)).collect()
    want = plain_whitening(rows)
    key = lambda r: (str(r[0]), r[1], r[3])
    got.sort(key=key)
    want.sort(key=key)
    assert [tuple(r)[:4] for r in got] == [r[:4] for r in want] and len(got) == 302 * 16
    signs = {}
    for g, w in zip(got, want, strict=True):
        sign = signs.setdefault(g.component, math.copysign(1, g.whitened * w[4]))
        assert g.whitened == pytest.approx(sign * w[4], abs=1e-8)
        assert g.explained == pytest.approx(w[5], rel=1e-9)
        assert g.identity_error < 1e-9


def test_whitening_without_variance_and_without_rows(spark):
    of = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    flat = wh.whiten(of([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat] == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    line = wh.whiten(of([(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert {(r.component, None if r.whitened is None else round(abs(r.whitened), 9), r.explained) for r in line} == {(1, 1.0, 1.0), (2, None, 0.0)}
    assert all(r.identity_error < 1e-12 for r in line)
    empty = wh.whiten(of([(1, None), (2, [])]))
    assert empty.count() == 0 and empty.columns[0] == "vec_id"
    with pytest.raises(ValueError):
        wh.whiten(of([(1, [1.0]), (2, [1.0, 2.0])]))


def test_remainders_and_large_moments():
    ps = wh.primes(10**40)
    assert len(set(ps)) == len(ps) and math.prod(ps) > 2 * 10**40
    for x in (0, 1, -1, 10**40, -(10**40), 123456789**4):
        assert wh.remaindered({p: x % p for p in ps}) == x
    rows = np.random.default_rng(1).integers(-(1 << 61), 1 << 61, (5000, 3))
    for p in ps[:2]:
        assert wh.residue_gram(rows, p).tolist() == (np.array([[sum(int(a) * int(b) for a, b in zip(rows[:, i], rows[:, j])) % p for j in range(3)] for i in range(3)])).tolist()
    m = wh.Moments(3 << 40, [(3 << 40) * 10**6 + 5] * 2, [[0, 0], [0, 0]])
    dev = wh.deviations(np.array([[10**6 + 10**6, 10**6 - 3]]), m)
    assert dev.tolist() == [[(3 << 40) * 10**6 - 5, -(9 << 40) - 5]] and wh.squared(dev) == [None]
    assert wh.squared(np.array([[3, 4]])) == [25]


def test_whitening_query(spark):
    got = op12_whitening(spark, SF).collect()
    vectors = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = {(r[0], r[1]): r for r in plain_whitening(vectors)}
    assert len(got) == len(want)
    for r in got:
        w = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == w[2:4] and abs(r.whitened) == pytest.approx(abs(w[4]), abs=1e-7) and r.explained == pytest.approx(w[5], rel=1e-9)
