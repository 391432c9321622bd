"""SimHash near-dedup with vantage-point shards (operator 3).

Fingerprints link at no more than `max_bits` differing bits. A fingerprint is cut into blocks; two that link differ
in at most `max_bits // blocks` bits of some block (pigeonhole), so each block's Hamming distance is a metric in
which only a small radius matters. For every block a vantage-point tree is grown from a bounded sample: a node
holds a vantage value and the median distance; fingerprints nearer go left, the others right, and those within the
radius beyond the median go left too, so that by the triangle inequality every linking pair meets in some shard.
Inside a shard the same tree goes on with vantage points of the shard's own, down to leaves, where whole
fingerprints are compared. A shard returns a spanning forest of its links, never all pairs; what joins the forests
is the components operator. Large groups of equal fingerprints are one fingerprint from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm._common import bytes_of, cut, map_batches, ship
from strandframe.operators.graph import connected_components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Fingerprints that the upper tree is grown from, at most; fingerprints a shard should hold; of a leaf.
SAMPLE, PER_SHARD, LEAF = 8192, 16_384, 384


@dataclass(frozen=True)
class Signature:
    """What is hashed and what links.

    Each part is (words in a shingle, whether each shingle counts once, 64-bit words, least bytes of a shingle, which
    do not matter if no shingle has them); the parts' hashes stand one after the other. The first part is searched: at
    most max_bits differ, by `blocks` blocks. The second, if any, must also agree to `max_more` bits.
    """

    parts: tuple[tuple[int, bool, int, int], ...] = ((4, False, 1, 0),)
    max_bits: int = 4
    blocks: int = 3
    max_more: int = 0

    @property
    def searched(self) -> int:
        return self.parts[0][2]

    @property
    def radius(self) -> int:
        return self.max_bits // self.blocks


#: Four-word shingles with repeats, 64 bits, links at 4.
FINGERPRINT = Signature()
#: Copies with scattered edits: sets of longer words in 128 bits find candidates, 256 bits over five-word shingles
#: decide. Copies that differ by a block may be beyond these limits; near_copies finds those.
NEAR_COPIES = Signature(((1, True, 2, 6), (5, True, 4, 0)), 17, 9, 50)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """k-word shingles joined by blanks; fewer words give the whole sequence, none give nothing."""
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return [joined[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def fold(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of unsigned hashes: a bit is set if more than half have it."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes), bitorder="little").tobytes(), "little")


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of what has these hashes: the first is the hash itself."""
    if not k:
        return hashes
    h = (hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0x94D049BB133111EB)


def signature(text: bytes, kind: Signature) -> bytes:
    words, out = words_of(text), []
    for k, once, n, least in kind.parts:
        pieces = shingles(words, k)
        pieces = list(set(pieces)) if once else pieces
        if least:
            pieces = [p for p in pieces if len(p) >= least] or pieces
        hashes = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in pieces), np.uint64, len(pieces))
        out += [fold(mixed(hashes, i)) if pieces else 0 for i in range(n)]
    return b"".join(x.to_bytes(8, "big") for x in out)


def signatures(docs: DataFrame, kind: Signature = FINGERPRINT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sig binary) of whole texts; null and wordless texts give zero bits."""
    of_id = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([signature(t, kind) for t in bytes_of(batch)], pa.binary())], ["id", "sig"])

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {of_id}, sig binary")


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), ">u8").astype(np.uint64).reshape(len(sigs), -1)


def block_masks(kind: Signature) -> np.ndarray:
    """For each block a mask over the searched words."""
    bits = kind.searched * 64
    edges = [round(i * bits / kind.blocks) for i in range(kind.blocks + 1)]
    out = np.zeros((kind.blocks, kind.searched), np.uint64)
    for i in range(kind.blocks):
        for b in range(edges[i], edges[i + 1]):
            out[i, b // 64] |= np.uint64(1) << np.uint64(63 - b % 64)
    return out


def distance(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.bitwise_count(rows ^ point).sum(-1, dtype=np.int32)


def grow(sample: np.ndarray, depth: int) -> list[tuple[np.ndarray, int] | None]:
    """A tree of (vantage, median) in heap order over masked values; None where a sample has one value only."""
    nodes: list = [None] * ((1 << depth) - 1)
    todo = {0: sample}
    for n in range(len(nodes)):
        rows = todo.pop(n, sample[:0])
        if not len(rows):
            continue
        nodes[n] = vantage(rows)
        if nodes[n] is not None:
            near = distance(rows, nodes[n][0]) <= nodes[n][1]
            todo[2 * n + 1], todo[2 * n + 2] = rows[near], rows[~near]
    return nodes


def vantage(rows: np.ndarray) -> tuple[np.ndarray, int] | None:
    """Of a few candidates the one that splits most evenly, ties included; None if all rows are equal."""
    best = None
    for i in range(0, len(rows), max(1, len(rows) // 5)):
        d = distance(rows, rows[i])
        for cut_at in {int(np.median(d)), int(np.median(d)) - 1}:
            near = int((d <= cut_at).sum())
            if 0 < near < len(rows) and (best is None or abs(2 * near - len(rows)) < best[0]):
                best = (abs(2 * near - len(rows)), rows[i], cut_at)
    return best and (best[1], best[2])


def drawn(n: int, mask: np.ndarray) -> tuple[np.ndarray, int]:
    """The node of number n below the sampled tree: a vantage value drawn by the number, half the block's bits."""
    point = np.array([xxhash.xxh64_intdigest(n.to_bytes(8, "big"), seed) for seed in range(len(mask))], np.uint64)
    return point & mask, int(np.bitwise_count(mask).sum()) // 2


def route(rows: np.ndarray, nodes: list, depth: int, radius: int, mask: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, positions) of masked rows; a row near a boundary is in several leaves."""
    todo = [(0, np.arange(len(rows)))]
    while todo:
        n, at = todo.pop()
        if not len(at):
            continue
        if n >= (1 << depth) - 1:
            yield n, at
            continue
        node = nodes[n] if n < len(nodes) else drawn(n, mask)
        if node is None:
            todo.append((2 * n + 1, at))
            continue
        d = distance(rows[at], node[0])
        todo += [(2 * n + 1, at[d <= node[1] + radius]), (2 * n + 2, at[d > node[1]])]


def linked(rows: np.ndarray, kind: Signature, point: np.ndarray) -> np.ndarray:
    """Which whole signatures link with a point (or points, broadcast)."""
    x = rows ^ point
    ok = np.bitwise_count(x[..., : kind.searched]).sum(-1, dtype=np.int32) <= kind.max_bits
    if x.shape[-1] > kind.searched:
        ok &= np.bitwise_count(x[..., kind.searched :]).sum(-1, dtype=np.int32) <= kind.max_more
    return ok


def forest(rows: np.ndarray, at: np.ndarray, kind: Signature) -> list[tuple[int, int]]:
    """Spanning links among rows[at]: a search that compares each reached row with the rows not reached yet."""
    own, n, live = rows[at], len(at), np.zeros(len(at), bool)
    lead = np.ascontiguousarray(own[:, 0])  # the first word alone rules out nearly all pairs
    for i in range(0, n, 128):  # rows without a link drop out first
        a, b = np.nonzero(np.bitwise_count(lead[None] ^ lead[i : i + 128, None]) <= kind.max_bits)
        a, b = a[a + i < b] + i, b[a + i < b]
        for j in range(0, len(a), 1 << 16):
            ok = linked(own[a[j : j + (1 << 16)]], kind, own[b[j : j + (1 << 16)]])
            live[a[j : j + (1 << 16)][ok]] = live[b[j : j + (1 << 16)][ok]] = True
    left, out = np.flatnonzero(live), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            point = queue.pop()
            hit = np.bitwise_count(lead[left] ^ lead[point]) <= kind.max_bits
            hit[hit] = linked(own[left[hit]], kind, own[point])
            found, left = left[hit], left[~hit]
            out += [(int(at[point]), int(at[f])) for f in found]
            queue += found.tolist()
    return out


def links_within(rows: np.ndarray, mask: np.ndarray, kind: Signature) -> list[tuple[int, int]]:
    """Spanning links of a shard's signatures, by a tree over one block's metric."""
    masked = rows[:, : kind.searched] & mask
    todo, out = [np.arange(len(rows))], []
    while todo:
        at = todo.pop()
        node = vantage(masked[at]) if len(at) > LEAF else None
        if node is not None:
            d = distance(masked[at], node[0])
            near, far = at[d <= node[1] + kind.radius], at[d > node[1]]
            if len(near) <= 0.9 * len(at):
                todo += [near, far]
                continue
        out += forest(rows, at, kind)
    return out


def links(distinct: DataFrame, kind: Signature = FINGERPRINT) -> DataFrame:
    """(a, b) spanning links between distinct signatures (column sig): their components are those of all links.

    The upper trees come from the SAMPLE signatures of smallest hash and stay that size however many rows there
    are (twelve levels; deeper ones take drawn vantage points); the number of shards follows the count.
    """
    spark = distinct.sparkSession
    ship(spark)
    masks = block_masks(kind)
    n = distinct.count()
    depth = max(1, int(np.ceil(np.log2(max(128 / kind.blocks, n / PER_SHARD)))))
    sample = [bytes(r.sig) for r in distinct.orderBy(F.xxhash64("sig"), "sig").limit(SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], "a binary, b binary")
    top = _matrix(sample)[:, : kind.searched]
    trees = [grow(top & m, min(depth, 12)) for m in masks]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sigs = batch.column(0)
                rows = _matrix(sigs.to_pylist())[:, : kind.searched]
                for b, mask in enumerate(masks):
                    for leaf, at in route(rows & mask, trees[b], depth, kind.radius, mask):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b << 32 | leaf)), sigs.take(pa.array(at))], ["shard", "sig"])

    def solve(table: pa.Table) -> pa.Table:
        sigs = table.column("sig").to_pylist()
        pairs = links_within(_matrix(sigs), masks[table.column("shard")[0].as_py() >> 32], kind) if len(sigs) > 1 else []
        return pa.table({"a": pa.array([sigs[i] for i, _ in pairs], pa.binary()), "b": pa.array([sigs[j] for _, j in pairs], pa.binary())})

    dealt = distinct.select("sig").mapInArrow(deal, "shard long, sig binary")
    return dealt.groupBy("shard").applyInArrow(solve, "a binary, b binary")


def classes(docs: DataFrame, kind: Signature = FINGERPRINT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sig, component_id) for every row: component_id is the smallest id whose text is reachable by links.

    Null and wordless texts have the zero signature and link like any other. Repeated rows each give a row. Null ids
    never become a component's name; a component of null ids only has a null name. No rows give no rows. Other
    columns are ignored.
    """
    sigs = cut(signatures(docs, kind, id_col, text_col))
    return in_classes(sigs, connected_components(links(sigs.select("sig").distinct(), kind), "a", "b"), id_col)


def in_classes(sigs: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """(id, sig, component_id) for every row (id, sig), by the components (node, root) of signatures."""
    distinct = sigs.groupBy("sig").agg(F.min("id").alias("first"))
    placed = distinct.join(roots, distinct["sig"] == roots["node"], "left").select(distinct["sig"], "first", F.coalesce("root", distinct["sig"]).alias("root"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    names = cut(placed.join(named, "root").select("sig", "component_id"))
    return sigs.join(names, "sig").select(F.col("id").alias(id_col), "sig", "component_id")


def row_of(id_col: str, text_col: str) -> Column:
    """What tells rows apart: id and text together."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def keep_one(docs: DataFrame, kind: Signature = NEAR_COPIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without the further members of each class: its smallest id stays.

    Of rows of one id in a class one stays, and rows of one id with unlike texts are documents of their own. Rows
    alike in id and text are one document. Rows with a null id all stay, as nothing tells them apart. Columns of docs
    may have any name but _row and _rank.
    """
    of_id = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), row_of(id_col, text_col).alias("row"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([signature(t, kind) for t in bytes_of(batch)], pa.binary())], ["id", "row", "sig"])

    sigs = cut(map_batches(keyed, run, f"id {of_id}, row long, sig binary"))
    return firsts(docs, sigs, connected_components(links(sigs.select("sig").distinct(), kind), "a", "b"), id_col, text_col)


def firsts(docs: DataFrame, sigs: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each class of sigs (id, row, sig) by the components (node, root), the first by (id, row),
    and all null ids."""
    first = sigs.where("id is not null").groupBy("sig").agg(F.min(F.struct("id", "row")).alias("first"))
    placed = first.join(roots, first["sig"] == roots["node"], "left").select(F.coalesce("root", "sig").alias("root"), "first")
    stay = cut(placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_row")))
    keyed = docs.withColumn("_row", row_of(id_col, text_col))
    rank = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
    kept = keyed.where(F.col(id_col).isNotNull()).join(stay, "_row", "left_semi").withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return kept.unionByName(keyed.where(F.col(id_col).isNull())).select(docs.columns)
