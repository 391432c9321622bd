"""Conversation prefix trie: sorted runs that carry LCPs, loser-tree merges of key ranges, nodes from an open-path stack."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm._common import cut, ship
from strandframe.llm._vectors import runs

WORDS = r"[^\x20\x09-\x0D]+"
#: Bytes of a turn in a sequence: 16 of its digest, 4 of its number of words.
TURN = 20
#: Bytes of sequences that are sorted at once, and of a chunk of a sorted run.
RUN_BYTES, CHUNK_BYTES = 8 << 20, 64 << 10
#: Of so many entries of a run, one is a mark from which the key ranges are drawn.
MARK = 64
#: Conversations whose ids, apart in the low bits only, are written in one piece of a node's ends.
ID_BITS = 12
ROOT = bytes(16)
NODE = "range int, idx long, edge boolean, node binary, parent binary, depth long, words long, n long, low long, children long, leaves long, saved long"


def turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turns): a conversation's turns in order, each as the hex digits of TURN bytes."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    one = F.concat(digest, F.lower(F.lpad(F.hex(F.regexp_count(text, F.lit(WORDS))), 8, "0")))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), one.alias("one"))
    return rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "one"))).alias("turns")).select("conv", F.col("turns.one").alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, seq): each conversation with its opening taken from the conversation of the next lower multiple of every.

    It is h turns long, h = crc32 of the decimal id modulo most, or what that conversation has; the conversation's own
    turns follow from the one after its first h. Ids are whole numbers (toward zero for negative ones). Rows without an
    id belong to no conversation; null turns come first, rows of one turn are ordered by digest; null roles and texts
    are empty. A conversation's digests meet in one task, its texts do not.
    """
    own = cut(turns(conversations, id_col, turn_col, role_col, text_col))
    heads = own.where(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv").cast("string")) % most).cast("int")
    both = own.join(heads, F.col("conv") - F.col("conv") % every == F.col("base"), "left").withColumn("h", h)
    opening = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    seq = F.concat(opening, F.slice("turns", F.col("h") + 1, F.size("turns")))
    return both.select("conv", F.unhex(F.array_join(seq, "")).alias("seq"))


def chained(seq: bytes) -> bytes:
    """The key of a sequence's node."""
    key = ROOT
    for i in range(0, len(seq), TURN):
        key = below(key, seq[i : i + TURN])
    return key


def below(key: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(key + turn, digest_size=16).digest()


def lcp_from(a: bytes, b: bytes, at: int) -> int:
    """Turns that two sequences share, of which the first at are known to be."""
    i, end = at * TURN, min(len(a), len(b))
    while i < end and a[i : i + TURN] == b[i : i + TURN]:
        i += TURN
    return i // TURN


def sorted_run(rows: list[tuple[bytes, int]]) -> Iterator[dict[str, list]]:
    """Chunks of the sorted distinct sequences: lcps with the sequence before (0 for a chunk's first), tails after it,
    number and least id of the conversations, and marks."""
    rows.sort()
    chunk: dict[str, list] = {}
    last, held, total = b"", 0, 0
    mark = min(MARK, len(rows)) // 2
    for seq, conv in rows:
        if chunk and seq == last:
            chunk["counts"][-1] += 1  # ids ascend, so the least is there already
            continue
        if not chunk or held > CHUNK_BYTES:
            if chunk:
                yield chunk
            chunk, held = {"lcps": [], "tails": [], "counts": [], "lows": [], "marks": []}, 0
            lcp = 0
        else:
            lcp = lcp_from(last, seq, 0)
        tail = seq[lcp * TURN :]
        for name, x in (("lcps", lcp), ("tails", tail), ("counts", 1), ("lows", conv)):
            chunk[name].append(x)
        if total % MARK == mark:
            chunk["marks"].append(seq)
        held, last, total = held + len(tail) + 24, seq, total + 1
    if chunk:
        yield chunk


def entries(chunk: dict[str, list]) -> Iterator[tuple[bytes, int, int, int]]:
    """(sequence, lcp with the one before, conversations, least id) of a chunk."""
    seq = b""
    for lcp, tail, count, low in zip(chunk["lcps"], chunk["tails"], chunk["counts"], chunk["lows"], strict=True):
        seq = seq[: lcp * TURN] + tail
        yield seq, lcp, count, low


_CHUNK = ["lcps", "tails", "counts", "lows"]
_KINDS = {"lcps": pa.list_(pa.int32()), "tails": pa.list_(pa.binary()), "counts": pa.list_(pa.int64()), "lows": pa.list_(pa.int64()), "marks": pa.list_(pa.binary())}
_SQL = "lcps array<int>, tails array<binary>, counts array<long>, lows array<long>"


def sorted_runs(seqs: DataFrame) -> DataFrame:
    """Chunks (run, chunk) of sorted runs of the sequences; a run is what a task sorts at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple[bytes, int]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for i, chunk in enumerate(sorted_run(held)):
                yield pa.RecordBatch.from_arrays([pa.array([task << 32 | made]), pa.array([i], pa.int32()), *(pa.array([chunk[c]], _KINDS[c]) for c in (*_CHUNK, "marks"))], ["run", "chunk", *_CHUNK, "marks"])

        for batch in batches:
            for conv, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((seq, conv))
                size += len(seq) + 64
                if size > RUN_BYTES:
                    yield from out()
                    held, size, made = [], 0, made + 1
        yield from out()

    return seqs.select("conv", "seq").mapInArrow(run, f"run long, chunk int, {_SQL}, marks array<binary>")


def cuts(stored: DataFrame, ranges: int) -> list[bytes]:
    """Where ranges of sequences begin: one mark for each range at most, drawn by Spark's own range sampling."""
    marks = stored.select(F.explode("marks").alias("mark")).repartitionByRange(ranges, "mark")
    firsts = marks.groupBy(F.spark_partition_id().alias("p")).agg(F.min("mark").alias("mark")).collect()
    return sorted({bytes(r.mark) for r in firsts})[1:]


class Merge:
    """A loser tree over sorted runs with LCPs: yields (sequence, lcp with the one before, conversations, least id).

    Each waiting head knows how many turns it shares with the last winner. Of two heads the one that shares more comes
    first, without a look at either; only heads that share equally many turns are compared, from the next turn on.
    """

    def __init__(self, sources: list[Iterator[tuple[bytes, int, int, int]]]):
        self.sources, self.heads = sources, [next(s, None) for s in sources]
        self.lcps = [0] * len(sources)
        self.compared = 0

    def first(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser) of two runs' heads; the loser's lcp becomes the one with the winner."""
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if self.lcps[i] != self.lcps[j]:
            return (i, j) if self.lcps[i] > self.lcps[j] else (j, i)
        at = lcp_from(a[0], b[0], self.lcps[i])
        self.compared += at - self.lcps[i] + 1
        x, y = (s[0][at * TURN : at * TURN + TURN] for s in (a, b))
        winner, loser = (i, j) if (x, i) <= (y, j) else (j, i)
        self.lcps[loser] = at
        return winner, loser

    def __iter__(self) -> Iterator[tuple[bytes, int, int, int]]:
        k = len(self.sources)
        if not k:
            return
        losers, won = [0] * k, [0] * (2 * k)
        won[k:] = range(k)
        for n in range(k - 1, 0, -1):
            won[n], losers[n] = self.first(won[2 * n], won[2 * n + 1])
        top = won[1]
        while (head := self.heads[top]) is not None:
            yield head[0], self.lcps[top], head[2], head[3]
            self.heads[top] = head = next(self.sources[top], None)
            self.lcps[top] = 0 if head is None else head[1]
            n = (top + k) // 2
            while n:
                top, losers[n] = self.first(top, losers[n])
                n //= 2


class OpenPath:
    """The nodes from the root to the last sequence. What is popped is finished, but for nodes at a range's edges.

    A node is [idx, edge, key, parent, depth, words, n, low, children, leaves, saved]; an edge node holds what its range
    knows of it without its edge children, and passes nothing up.
    """

    def __init__(self) -> None:
        self.open: list[list] = []
        self.idx = 0

    def push(self, key: bytes, words: int, edge: bool) -> None:
        parent = self.open[-1][2] if self.open else None
        self.open.append([self.idx, edge, key, parent, len(self.open), words, 0, None, 0, 0, 0])
        self.idx += 1

    def add(self, depth: int, n: int, low: int | None, children: int = 0, leaves: int = 0, saved: int = 0) -> None:
        node = self.open[depth]
        node[6] += n
        node[7] = low if node[7] is None else node[7] if low is None else min(node[7], low)
        node[8], node[9], node[10] = node[8] + children, node[9] + leaves, node[10] + saved

    def close(self, depth: int, edges: bool = False) -> Iterator[list]:
        """The nodes below a depth, deepest first; edges: whether they stay open in the next range."""
        while len(self.open) > depth:
            node = self.open.pop()
            node[1] = node[1] or edges
            if not node[1]:
                node[9] = node[9] or 1
                node[10] += (node[6] - 1) * node[5]
                if self.open:
                    self.add(-1, node[6], node[7], 1, node[9], node[10])
            yield node


def _rows(part: int, nodes: list[list]) -> pa.RecordBatch:
    names = [x.split()[0] for x in NODE.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 7]
    return pa.RecordBatch.from_arrays([pa.array([part] * len(nodes), pa.int32()), *(pa.array([n[i] for n in nodes], k) for i, k in enumerate(kinds[1:]))], names)


def range_nodes(sources: list[Iterator[tuple[bytes, int, int, int]]]) -> Iterator[list]:
    """The nodes of the sequences of one range, from its merged runs."""
    path = OpenPath()
    path.push(ROOT, 0, True)
    first = True
    for seq, lcp, count, low in Merge(sources):
        depth = len(seq) // TURN
        if first or depth != len(path.open) - 1 or lcp != depth:  # not the same sequence again
            yield from path.close(lcp + 1)
            for d in range(lcp, depth):
                turn = seq[d * TURN : d * TURN + TURN]
                path.push(below(path.open[-1][2], turn), int.from_bytes(turn[16:], "big"), first)
        path.add(depth, count, low)
        first = False
    yield from path.close(0, edges=True)


def joined_edges(rows: Iterator[dict]) -> Iterator[list]:
    """Edge nodes of all ranges, in order: those of one key are one node, which stays open until another takes its place."""
    path = OpenPath()
    for r in rows:
        d = r["depth"]
        if len(path.open) <= d or path.open[d][2] != r["node"]:
            yield from path.close(d)
            path.push(r["node"], r["words"], False)
        path.add(d, r["n"], r["low"], r["children"], r["leaves"], r["saved"])
    yield from path.close(0)


def nodes(seqs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(node, parent, depth, n, low, children, leaves, saved) of every node of the trie of sequences (conv, seq).

    Runs are sorted where the sequences lie and stored as chunks; marks of the runs cut the keys into ranges (default:
    the session's shuffle partitions), so that a prefix with many sequences below it lies in many ranges; a task merges
    a range's pieces, which it holds as Arrow columns, and copies of a sequence are one entry of a run. Nodes that reach
    over a range's ends, two paths a range, are joined in the ranges' order.
    """
    spark = seqs.sparkSession
    ship(spark)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = cut(sorted_runs(seqs))
    at = cuts(stored, ranges)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = [e[0] for e in entries(row)]
                ends = sorted({0, *(bisect_left(keys, c) for c in at[bisect_right(at, keys[0]) : bisect_right(at, keys[-1])]), len(keys)})
                for a, b in zip(ends, ends[1:], strict=False):
                    piece = {c: row[c][a:b] for c in _CHUNK} | {"lcps": [0, *row["lcps"][a + 1 : b]], "tails": [keys[a], *row["tails"][a + 1 : b]]}
                    yield pa.RecordBatch.from_arrays([pa.array([bisect_right(at, keys[a])], pa.int32()), pa.array([row["run"]]), pa.array([row["chunk"]], pa.int32()), *(pa.array([piece[c]], _KINDS[c]) for c in _CHUNK)], ["range", "run", "chunk", *_CHUNK])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["range"]):
            of: dict[int, list[int]] = {}
            for i, run in enumerate(table.column("run").to_pylist()):
                of.setdefault(run, []).append(i)

            def source(rows: list[int], table: pa.Table = table) -> Iterator[tuple[bytes, int, int, int]]:
                last = b""
                for i in rows:
                    for k, (seq, lcp, count, low) in enumerate(entries({c: table.column(c)[i].as_py() for c in _CHUNK})):
                        yield seq, lcp if k else lcp_from(last, seq, 0), count, low
                        last = seq

            held, part = [], table.column("range")[0].as_py()
            for node in range_nodes([source(rows) for rows in of.values()]):
                held.append(node)
                if len(held) >= 4096:
                    yield _rows(part, held)
                    held = []
            yield _rows(part, held)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node in joined_edges(r for batch in batches for r in batch.to_pylist()):
            yield _rows(-1, [node])

    pieces = stored.mapInArrow(deal, f"range int, run long, chunk int, {_SQL}")
    merged = cut(pieces.repartitionById(len(at) + 1, F.col("range")).sortWithinPartitions("range", "run", "chunk").mapInArrow(merge, NODE))
    edges = merged.where("edge").repartition(1).sortWithinPartitions("range", "idx").mapInArrow(join, NODE)
    return cut(merged.where("not edge").unionByName(edges).drop("range", "idx", "edge", "words"))


def ends(seqs: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end: of their decimal ids, ascending, comma-joined.

    Ids of a node meet in pieces of 2 ** ID_BITS at most, then the pieces, in order, in one digest: a digest takes its
    bytes one after the other, but they are streamed, not held.
    """

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([chained(s) for s in batch.column(1).to_pylist()], pa.binary()), batch.column(0)], ["node", "conv"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, hashlib.sha256()
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], ["node", "ends_sha256"])
        for batch in batches:
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node == now:
                    sha.update(b"," + ids.encode())
                    continue
                if now is not None:
                    yield done()
                now, sha = node, hashlib.sha256(ids.encode())
        if now is not None:
            yield done()

    ship(seqs.sparkSession)
    keyed = seqs.select("conv", "seq").mapInArrow(key, "node binary, conv long")
    pieces = keyed.groupBy("node", F.shiftright("conv", ID_BITS).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    return pieces.repartition("node").sortWithinPartitions("node", "piece").mapInArrow(digest, "node binary, ends_sha256 string")


def trie(seqs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the
    trie of sequences (conv, seq); conv is unique, and no sequences give no nodes.

    conv_id and depth name a node: no other of its depth has its least conversation.
    """
    seqs = cut(seqs)
    found = nodes(seqs, ranges)
    parents = found.select(F.col("node").alias("parent"), F.col("low").alias("parent_conv_id"))
    none = F.lit(hashlib.sha256().hexdigest())
    placed = found.join(ends(seqs), "node", "left").join(parents, "parent", "left")
    return placed.select(
        F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


#: The same rows in DuckDB: nodes as prefixes, an ancestor for every prefix of a node's least conversation.
TRIE_SQL = r"""
with t as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
g as (select c, turn, sha256(length(role)::varchar || ':' || role || text)[1:32] as d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w from t),
o as (select c, list(d order by turn nulls first, d, w) as ds, list(w order by turn nulls first, d, w) as ws,
  (xor(list_reduce([4294967295::bigint] || list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint), lambda a, b: list_reduce([xor(a, b)] || range(8), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295::bigint) % 4)::int as h
  from g group by c),
r as (select o.c, list_concat(coalesce(b.ds[1:o.h], []), o.ds[o.h + 1:]) as ds, list_concat(coalesce(b.ws[1:o.h], []), o.ws[o.h + 1:]) as ws from o left join o b on b.c = o.c - o.c % 20),
p as (select c, d, array_to_string(ds[1:d], ',') as k, case when d > 0 then array_to_string(ds[1:d - 1], ',') end as pk, d > 0 as inner_, case when d > 0 then ws[d] else 0 end as w, d = len(ds) as e from (select c, ds, ws, unnest(range(0, len(ds) + 1)) as d from r)),
n as (select d, k, any_value(pk) as pk, min(c) as m, count(*) as n, any_value(w) as w, string_agg(c::varchar, ',' order by c) filter (where e) as ids from p group by d, k),
q as (select d - 1 as d, pk as k, count(*) as n_children from n where d > 0 group by all),
s as (select a.d, a.k, sum(case when q.k is null then 1 else 0 end) as n_leaves, sum((n.n - 1) * n.w) as saved from n left join q on q.d = n.d and q.k = n.k join p a on a.c = n.m and a.d <= n.d group by a.d, a.k)
select n.m as conv_id, n.d as depth, u.m as parent_conv_id, n.n as n_convs, coalesce(n_children, 0)::bigint as n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(coalesce(n.ids, '')) as ends_sha256
from n join s on s.d = n.d and s.k = n.k left join q on q.d = n.d and q.k = n.k left join n u on u.d = n.d - 1 and u.k = n.pk
"""
