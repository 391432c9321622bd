"""The trie of conversations against a plain version and SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from strandframe.llm import prefix_trie as pt
from strandframe.llm.queries import op11_prefix_trie

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def plain(rows):
    """Nodes as prefixes in a dictionary."""
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    members = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        seq = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append((c, d == len(seq)))
    out = []
    for node, own in members.items():
        under = [k for k in members if k[: len(node)] == node]
        kids = lambda k: [x for x in members if len(x) == len(k) + 1 and x[: len(k)] == k]
        done = ",".join(str(c) for c in sorted(c for c, e in own if e))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        saved = sum((len(members[k]) - 1) * words(k[-1][1]) for k in under if k)
        out.append((min(c for c, _ in own), len(node), parent, len(own), len(kids(node)), sum(not kids(k) for k in under), saved, hashlib.sha256(done.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed, n):
    """Conversations over few words, so that prefixes are shared, some copied whole; null roles, texts and turns."""
    rng = random.Random(seed)
    said = [("user", "hi  there"), ("user", ""), (None, None), ("", "a b\tc"), ("bot", "hi  there"), ("system", "Ünï code\n½")]
    rows = []
    for c in rng.sample(range(-60, 6000), n):
        for i in range(rng.choice([1, 1, 2, 3, 3, 3, 5, 8])):
            rows.append((c, None if i == 0 and c % 3 == 0 else i, *(said[0] if rng.random() < 0.6 else rng.choice(said))))
    return [*rows, (None, 1, "user", "of no conversation"), (7001, 0, "user", "x" * 200000), (7001, 1, "user", "x " * 50000)]


def frame(spark, rows):
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return d.selectExpr("*", "1 as node", "2 as seq", "3 as conv").repartition(5)


@pytest.mark.parametrize("ranges", [1, 7])
def test_nodes_are_those_of_all_prefixes(spark, ranges, monkeypatch):
    monkeypatch.setattr(pt, "RUN_BYTES", 3000)
    monkeypatch.setattr(pt, "CHUNK_BYTES", 300)
    monkeypatch.setattr(pt, "MARK", 4)
    monkeypatch.setattr(pt, "ID_BITS", 4)
    rows = talk(1, 300)
    got = pt.trie(pt.rebuilt(frame(spark, rows)), ranges).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_ties_repeats_and_empty_tables(spark):
    rows = [(1, 1, "a", "x"), (1, 1, "a", "x"), (2, 1, "a", "y"), (2, 1, "b", "z"), (20, 0, "u", "only"), (33, 5, "u", "alone"), (21, 0, "u", "p"), (21, 1, "u", "q")]
    once, again = (sorted(map(tuple, pt.trie(pt.rebuilt(frame(spark, r))).collect()), key=str) for r in (rows, rows[::-1]))
    assert once == again and once[-1][3] > 0
    assert pt.trie(pt.rebuilt(frame(spark, rows[:1]).where("false"))).count() == 0
    assert pt.trie(pt.rebuilt(frame(spark, [(None, 1, "a", "b")]))).count() == 0


def test_merge_keeps_lcps_and_spares_shared_turns():
    rng = random.Random(4)
    turn = lambda i: i.to_bytes(pt.TURN, "big")
    opening = b"".join(turn(9) for _ in range(50))
    seqs = [[opening + b"".join(turn(rng.randrange(3)) for _ in range(rng.randrange(6))) for _ in range(200)] for _ in range(5)]
    runs = [[e for c in pt.sorted_run([(s, i) for i, s in enumerate(run)]) for e in pt.entries(c)] for run in seqs]
    merge = pt.Merge([iter(r) for r in runs])
    out = list(merge)
    assert [o[0] for o in out] == sorted(s for run in seqs for s in set(run))
    assert [o[1] for o in out[1:]] == [pt.lcp_from(a[0], b[0], 0) for a, b in zip(out, out[1:])]
    assert sum(o[2] for o in out) == 1000 and merge.compared < 5 * 50 + 12 * len(out)
    assert list(pt.Merge([])) == [] and list(pt.Merge([iter([])])) == []


def test_query_agrees_with_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.sql(pt.TRIE_SQL)
    assert want.columns == COLUMNS
    assert sorted(map(tuple, op11_prefix_trie(spark, SF).select(COLUMNS).collect()), key=str) == sorted(want.fetchall(), key=str)
