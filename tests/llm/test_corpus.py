"""Operators over a whole table, against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from strandframe.llm import decontamination, line_dedup, lm_scoring, mixing, simhash, suffix_dedup

LOWER = simhash.LOWER


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_classes(docs, rows, none):
    prints = {(i, t): plain_fingerprint(t) for i, t, *_ in rows}
    root = roots(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    least = defaultdict(list)
    for (i, _), p in prints.items():
        if i is not None:
            least[root[p]].append(i)
    want = sorted(str((i, f"{prints[i, t]:016x}", min(least[root[prints[i, t]]], default=None))) for i, t, *_ in rows)
    got = sorted(str((r.doc_id, bytes(r.sig).hex(), r.component_id)) for r in simhash.classes(docs).collect())
    assert got == want
    assert simhash.classes(none).count() == 0


@pytest.mark.parametrize("kind", [simhash.FINGERPRINT, simhash.NEAR_COPIES])
def test_vantage_point_shards_lose_no_link(spark, kind):
    rng = random.Random(4)
    size = sum(p[2] for p in kind.parts) * 64
    base = [rng.getrandbits(size) for _ in range(500)]
    close = [b ^ sum(1 << x for x in rng.sample(range(size), rng.randrange(1, kind.max_bits + 3))) for b in base[:300]]
    dense = [base[0] ^ 1 << rng.randrange(size) ^ 1 << rng.randrange(size) for _ in range(700)]
    sigs = {x.to_bytes(size // 8, "big") for x in base + close + dense}
    rows = {s: simhash._matrix([s])[0] for s in sigs}
    m = simhash._matrix(list(sigs))
    names = list(sigs)
    parent = list(range(len(names)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(names)):
        for j in np.flatnonzero(simhash.linked(m, kind, m[i])).tolist():
            parent[find(i)] = find(j)
    want = {frozenset(names[j] for j in range(len(names)) if find(j) == r) for r in {find(i) for i in range(len(names))}}
    got = simhash.links(spark.createDataFrame([(bytearray(s),) for s in sigs], "sig binary"), kind).collect()
    parent = {s: s for s in sigs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in got:
        a, b = bytes(r.a), bytes(r.b)
        assert simhash.linked(rows[a][None], kind, rows[b])[0]
        parent[top(a)] = top(b)
    classes = defaultdict(set)
    for s in sigs:
        classes[top(s)].add(s)
    assert {frozenset(c) for c in classes.values()} == want
    assert len(got) < 20 * len(sigs)  # a forest a leaf, far from all pairs


def test_keep_one(spark, none):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(40)]
    near = [" ".join("new" if k == 150 else w for k, w in enumerate(t.split())) for t in texts[:20]]
    rows = [(i, t, "en") for i, t in enumerate(texts + near + texts[:5])] + [(None, texts[0], "en"), (3, texts[3], "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == list(range(40))
    assert kept.where("doc_id is null").count() == 1
    assert simhash.keep_one(none).count() == 0


def plain_repeats(texts, length=200):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        kept = bytes(b for b, h in zip(t, hit, strict=True) if not h)
        out.append((len(t), sum(hit), sum(1 for i, h in enumerate(hit) if h and not (i and hit[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(docs, rows, none):
    want = sorted(str((i, *w)) for (i, *_), w in zip(rows, plain_repeats([(t or "").encode() for _, t, *_ in rows]), strict=True))
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs))
    assert sorted(str(tuple(r)) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == want
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_of_shared_passages(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    passage, short = word(260), word(190)
    texts = [word(rng.randrange(400)) + (passage if k % 3 else short) + word(rng.randrange(400)) for k in range(60)] + [word(50) * 30, "z" * 1000, word(199)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(suffix_dedup.remove_repeats(d)).collect()}
    assert got == dict(enumerate(plain_repeats([t.encode() for t in texts])))


@pytest.mark.parametrize("length", [90, 400])
def test_suffix_dedup_of_other_lengths(spark, length):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    passage = word(900)
    texts = [word(300) + passage + word(50), word(500) + passage[:-20], passage[100:600] + word(200), passage, word(700)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(suffix_dedup.remove_repeats(d, length=length)).collect()}
    assert got == dict(enumerate(plain_repeats([t.encode() for t in texts], length)))
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(d, length=50)


def test_suffix_dedup_lets_go_of_shuffles(spark, monkeypatch):
    """Shuffle files of a step are let go before the next step, however late the driver would collect them itself."""
    d = spark.createDataFrame([(i, f"{i % 5} " * 150 + str(i)) for i in range(40)], "doc_id long, text string")
    steps, compared = [], suffix_dedup._compared
    monkeypatch.setattr(suffix_dedup, "let_go", lambda _: steps.append("let go"), raising=False)
    monkeypatch.setattr(suffix_dedup, "_compared", lambda *args: steps.append("compared") or compared(*args))
    assert suffix_dedup.remove_repeats(d).count() == 40
    assert steps == ["let go", "let go", "compared"]


def test_blind_trie_and_quicksort():
    rng = random.Random(8)
    strings = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(300)]
    trie = suffix_dedup.BlindTrie(12)
    for i, s in enumerate(strings):
        trie.add(s, i)
    groups = list(trie.leaves())
    assert [strings[g[0]] for g in groups] == sorted(set(strings)) and all(len({strings[i] for i in g}) == 1 for g in groups)
    table = np.array([[rng.randrange(3) for _ in range(4)] for _ in range(2000)], np.uint64)
    tied = {frozenset(g.tolist()) for g in suffix_dedup.multikey(table)}
    by = defaultdict(set)
    for i, r in enumerate(map(tuple, table.tolist())):
        by[r].add(i)
    assert tied == {frozenset(v) for v in by.values() if len(v) > 1}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(docs, rows, none, order):
    texts = [(t or "").encode().translate(LOWER).split() for _, t, *_ in rows]
    marked = [["<s>"] * order + w for w in texts]

    def grams(words, n):
        """n-grams that end at each word and at the mark before the first one."""
        return [tuple(words[k - n + 1 : k + 1]) for k in range(order - 1, len(words))]

    total = [Counter(g for w in marked for g in grams(w, n)) for n in range(1, order + 1)]
    words_in_all = sum(total[0].values())
    want = []
    for (i, *_), w, m in zip(rows, texts, marked, strict=True):
        if not w:
            want.append((i, 0, None, 0))
            continue
        own = [Counter(grams(m, n)) for n in range(1, order + 1)]
        rest, score, back = max(1, words_in_all - len(w)), 0.0, 0
        for k in range(order, len(m)):
            for n in range(order, 0, -1):
                g = tuple(m[k - n + 1 : k + 1])
                top = total[n - 1][g] - own[n - 1][g]
                under = total[n - 2][g[:-1]] - own[n - 2][g[:-1]] if n > 1 else rest
                if top > 0 and under >= top:
                    score += math.log(top / under) + (order - n) * math.log(0.4)
                    back += n < order
                    break
            else:
                score += order * math.log(0.4) - math.log(rest)
                back += 1
        want.append((i, len(w), round(score, 6), back))
    got = lm_scoring.scores(docs, order=order, block_bytes=1 << 16).collect()
    assert sorted(str((r.doc_id, r.n_words, None if r.log_score is None else round(r.log_score, 6), r.n_backoff)) for r in got) == sorted(map(str, want))
    if order == 2:
        assert lm_scoring.scores(none).count() == 0


def test_packing():
    rng = np.random.default_rng(9)
    for n in (0, 1, 5, 4000):
        v = np.unique(rng.integers(0, 1 << 56, n).astype(np.uint64))
        assert (lm_scoring.unpack(lm_scoring.pack(v)) == v).all()
        c = rng.integers(0, 70_000, n)
        assert (lm_scoring.unpack_counts(lm_scoring.pack_counts(c)) == c).all()


def test_mix_against_sql(spark, docs, none):
    got = mixing.mix_by_source(docs)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas().convert_dtypes())
    want = con.sql(mixing.MIX_SQL.format(docs="documents", more="")).fetchall()
    assert sorted(str(tuple(r)) for r in got.select("doc_id", "size", "source_size", "target", "taken").collect()) == sorted(map(str, want))
    assert mixing.mix_by_source(none).count() == 0
    assert got.where("taken > 2 * size").count() == 0


def test_flow_is_least_cost():
    supply = {("a",): 10, ("a", "b"): 10, ("b",): 5}
    flow = mixing.route(supply, {"a": 15, "b": 20})
    assert sum(v for d in flow.values() for v in d.values()) == 35
    flow = mixing.route(supply, {"a": 12, "b": 8})
    assert all(sum(d.values()) <= supply[p] for p, d in flow.items())  # nobody is repeated while others wait
    assert mixing.targets({"a": 10, "b": 1000, None: 3}) == {"a": 20.0, None: 6.0, "b": 1493.5}
    assert mixing.targets({}) == {}


def test_mix_of_overlapping_sources(spark, none):
    """Totals against the smallest cut over all sets of sources, which is the most that any routing can give."""
    from itertools import combinations

    from pyspark.sql import functions as F

    rng = random.Random(17)
    for trial in range(4):
        choices = [["a"], ["b"], ["c"], ["a", "b"], ["b", "a", "b"], ["c", None, "c"], [None], ["a", "b", "c"], [], None]
        rows = [(k, rng.choice(choices), rng.randrange(0, 40) if trial else 5) for k in range(120)] + [(3, ["a"], 7), (None, ["b", "c"], 9)]
        d = spark.createDataFrame(rows, "doc_id long, members array<string>, size int").withColumns({c: F.lit(c) for c in ("id", "key", "part", "edge", "before")})
        done, sizes, aims = mixing.mix(d, F.col("members"), F.col("size"))
        got = done.collect()
        assert sorted(str((r.doc_id, r.members, r["size"])) for r in got) == sorted(str((i, sorted(set(m or []), key=lambda s: (s is None, s or "")), n)) for i, m, n in rows)
        assert all(0 <= r.taken <= 2 * r["size"] for r in got)
        supply = Counter()
        for _, m, n in rows:
            supply[frozenset(m or [])] += n
        assert sizes == {s: sum(n for p, n in supply.items() if s in p) for s in sizes} and set(sizes) == {"a", "b", "c", None}
        quota = {s: int(t) for s, t in aims.items()}

        def most(times, supply=supply, quota=quota):
            cuts = [c for k in range(5) for c in combinations(quota, k)]
            return min(sum(quota[s] for s in c) + sum(times * n for p, n in supply.items() if not p <= set(c)) for c in cuts)

        given = Counter()
        for r in got:
            given[frozenset(r.members)] += r.taken
        assert sum(given.values()) == most(2)
        assert sum(max(0, given[p] - supply[p]) for p in supply) == most(2) - most(1)  # least repetition
        assert sorted(map(str, mixing.mix(d, F.col("members"), F.col("size"))[0].collect())) == sorted(map(str, got))


def test_line_dedup_against_sql(docs, none):
    named = docs.dropDuplicates(["doc_id"])
    con = duckdb.connect()
    con.register("documents", named.select("doc_id", "text").toPandas())
    want = con.sql(line_dedup.REPEATS_SQL).fetchall()
    from pyspark.sql import functions as F

    got = line_dedup.remove_repeats(named).select("doc_id", "n_units", "n_removed", "n_shared", "shared_words", "longest_shared", F.sha2(F.coalesce("text", F.lit("")), 256), F.coalesce("text", F.lit("")))
    drop = lambda rows: sorted(str((None if r[0] != r[0] or r[0] is None else int(r[0]), *tuple(r)[1:])) for r in rows if r[0] != 900001)  # noqa: E731  null text has no units here
    assert drop(got.collect()) == drop(want)
    assert line_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("kind", ["line", "paragraph"])
def test_line_dedup_against_brute_force(spark, kind):
    """Short and wordless lines, null and repeated ids, rows given twice, columns of all names used inside."""
    import re

    from pyspark.sql import functions as F

    rng = random.Random(12)
    pool = ["of", "}", "", "  ", "The End.", "the  end", "é ü", *(" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 12))) for _ in range(40))]
    sep = line_dedup.SEPARATORS[kind]
    texts = [sep.join(rng.choice(pool) for _ in range(rng.randrange(9))) for _ in range(60)] + [None, "", "unique to one", "unique to the other" + sep + "of", sep.join(["of"] * 500)]
    ids = [*range(60), 60, 61, 5, 5, None]
    rows = [*zip(ids, texts, strict=True), (7, texts[7]), (7, texts[7]), (None, texts[-1] + sep + "last"), (None, texts[3])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("row", "positions", "parts", "flags", "starts", "doc", "id", "touched")})
    key = {(r.doc_id, r.text): r.k for r in d.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("k")).collect()}
    norm = lambda u: re.sub(r"[\s!-/:-@\[-`{-~]+", " ", u.lower()).strip()
    places = defaultdict(list)
    for i, t in set(rows):
        for p, u in enumerate((t or "").split(sep)):
            if norm(u):
                places[norm(u)].append((i is None, i or 0, key[i, t], p))
    want = []
    for i, t in rows:
        if t is None:
            want.append((i, None, 0, 0, 0, 0, 0))
            continue
        us = t.split(sep)
        own = [(i is None, i or 0, key[i, t], p) for p in range(len(us))]
        shared = [u for u in us if norm(u) and len(places[norm(u)]) > 1]
        kept = [u for u, o in zip(us, own, strict=True) if not norm(u) or min(places[norm(u)]) == o]
        words = [len(norm(u).split()) for u in shared]
        want.append((i, sep.join(kept), len(us), len(us) - len(kept), len(shared), sum(words), max(words, default=0)))
    got = line_dedup.remove_repeats(d, kind=kind)
    assert got.columns == [*d.columns, *line_dedup.ADDED]
    found = got.collect()
    assert sorted(str((r.doc_id, r.text, r.n_units, r.n_removed, r.n_shared, r.shared_words, r.longest_shared)) for r in found) == sorted(map(str, want))
    assert all(r.row == "row" and r.id == "id" for r in found)
    originals = defaultdict(list)
    for i, t in rows:
        originals[i].append(t)
    for r in found:
        assert r.text is None or any(t is not None and sep.join(t[s.start : s.start + s["size"]] for s in r.kept_spans) == r.text for t in originals[r.doc_id])
    with pytest.raises(ValueError):
        line_dedup.remove_repeats(d.withColumn("n_units", F.lit(1)))


def test_decontamination(spark, docs, rows, none):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert {(i, k) for i, t, *_ in rows for k, text in items if text in (t or "")} <= got
    sliced = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, benchmark, max_sent=200).collect()}
    assert sliced == got
    kept = decontamination.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} - {i for i, _ in got}
    assert decontamination.contaminated(none, benchmark).count() == 0 and decontamination.clean(docs, benchmark.where("false")).count() == docs.count()


def test_template_slots():
    item = b"If Alice has 12 apples and gives 5 kg of apples to Bob how many of the 12 apples remain with Alice today"
    index = decontamination.Items([(1, item)], 8)
    new = b"x y. If Carol has 30 apples and gives 7 kg of apples to Dave how many of the 30 apples remain with Carol today ok"
    assert decontamination.batch_matches([new, b"", b"the"], index)[0][0][3:] == (1.0, True)
    unlike = new.replace(b"the 30 apples", b"the 31 apples")
    assert decontamination.batch_matches([unlike], index) == {}
    short = decontamination.Items([(2, b"just four words here")], 8)
    assert decontamination.batch_matches([b"well just four words here then"], short)[0][0][0] == 2
