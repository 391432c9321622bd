"""Embedding near-dedup: quantised random projections bucket the unit vectors in several tables, exact cosines follow."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm._common import cut, ship
from strandframe.llm._vectors import by_length, runs
from strandframe.operators.graph import connected_components

#: Rows of a bucket that meet in one task are two blocks of about this many.
BLOCK = 1024
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@dataclass(frozen=True)
class Hashing:
    """projections a key, each cut in steps of width; as many tables as find a pair of the least cosine but for miss.

    More projections make buckets of unlike vectors rarer and call for more tables; the default suits some million
    vectors of one label, after which 16 projections are cheaper.
    """

    similarity: float = 0.98
    projections: int = 12
    width: float = 1.6
    miss: float = 1e-4
    seed: int = 20

    @property
    def tables(self) -> int:
        met = collision(math.sqrt(2 - 2 * self.similarity), self.width) ** self.projections
        return max(1, math.ceil(math.log(self.miss) / math.log1p(-met))) if met < 1 else 1


NEAR = Hashing()


def collision(distance: float, width: float) -> float:
    """The chance that two points at a distance fall in one step of a Gaussian projection."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


@lru_cache(4)
def _draws(hashing: Hashing, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions (dim, tables * projections), offsets, and odd multipliers that fold a key's steps into a long."""
    rng = np.random.default_rng([hashing.seed, dim])
    n = hashing.tables * hashing.projections
    return rng.standard_normal((dim, n)), rng.uniform(0, hashing.width, n), rng.integers(0, 1 << 63, n, np.uint64) | np.uint64(1)


def units(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; those that are zero or not finite become NaN."""
    with np.errstate(all="ignore"):
        rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
        return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def keys(unit: np.ndarray, group: np.ndarray, hashing: Hashing) -> np.ndarray:
    """The buckets of unit vectors, a row of longs each, one a table; group keeps labels apart."""
    directions, offsets, odd = _draws(hashing, unit.shape[1])
    steps = np.floor((unit @ directions + offsets) / hashing.width).astype(np.int64).view(np.uint64)
    folded = (steps * odd).reshape(len(unit), hashing.tables, hashing.projections).sum(axis=2, dtype=np.uint64)
    folded ^= group.view(np.uint64)[:, None]
    for shift, by in ((30, _MIX[0]), (27, _MIX[1])):
        folded = (folded ^ (folded >> np.uint64(shift))) * np.uint64(by)
    return (folded ^ (folded >> np.uint64(31))).view(np.int64)


def _group(label: object, dim: int) -> int:
    return int.from_bytes(hashlib.blake2b(repr((label, dim)).encode(), digest_size=8).digest(), "little", signed=True)


def marked(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, cls, grp, vec) of every row: equal vectors of a label share cls; grp and vec are null if it links with nothing."""
    ship(vectors.sparkSession)
    of_id = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, n = batch.column(2).to_pylist(), batch.num_rows
            cls: list = [b"none%d" % (i % 4096) for i in range(n)]  # many unlike keys, so that idle rows spread in joins
            grp: list = [None] * n
            vec: list = [None] * n
            for at, rows in by_length(batch.column(1)):
                rows = rows + 0.0  # negative zeros go
                fit = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
                for i, row in zip(at[fit].tolist(), rows[fit], strict=True):
                    if labels[i] is not None:
                        grp[i], vec[i] = _group(labels[i], len(row)), row
                        cls[i] = hashlib.blake2b(row.tobytes(), digest_size=16, key=grp[i].to_bytes(8, "little", signed=True)).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array(grp, pa.int64()), pa.array(vec, pa.list_(pa.float64()))], ["id", "cls", "grp", "vec"])

    wanted = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"), F.col(label_col).alias("label"))
    return wanted.mapInArrow(run, f"id {of_id}, cls binary, grp long, vec array<double>")


def entries(classes: DataFrame, hashing: Hashing) -> DataFrame:
    """(cid, t, key): the bucket of every class in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in by_length(batch.column(1)):
                own = keys(units(rows), batch.column(2).to_numpy()[at], hashing)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(list(own), pa.list_(pa.int64()))], ["cid", "keys"])

    ship(classes.sparkSession)
    found = classes.select("cid", "vec", "grp").mapInArrow(run, "cid long, keys array<long>")
    return found.select("cid", F.posexplode("keys").alias("t", "key"))


def tile_links(unit: np.ndarray, own: np.ndarray, copies: np.ndarray, left: np.ndarray | None, table: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, lead) of the rows of a tile: the rows marked left against the others, or all against each other (None).

    own holds the rows' buckets. links counts the partners' copies over pairs that no earlier table brings together, so
    that all tiles add up; lead is the first row of a row's component by the tile's links, whichever table counts them.
    """
    n = len(unit)
    links, lead = np.zeros(n, np.int64), np.arange(n)
    rows, cols = (lead, lead) if left is None else (np.flatnonzero(left), np.flatnonzero(~left))
    near = unit[rows] @ unit[cols].T >= similarity
    if left is None:
        np.fill_diagonal(near, False)
    a, b = np.nonzero(np.triu(near) if left is None else near)
    if not len(a):
        return links, lead
    new = np.arange(len(a))
    for t in range(table):
        new = new[own[rows[a[new]], t] != own[cols[b[new]], t]]
    np.add.at(links, rows[a[new]], copies[cols[b[new]]])
    np.add.at(links, cols[b[new]], copies[rows[a[new]]])
    on, off = near.any(axis=1), near.any(axis=0)
    near, rows, cols = near[on][:, off], rows[on], cols[off]
    lead = lead.copy()
    while True:
        before = lead.copy()
        lead[rows] = np.minimum(lead[rows], np.where(near, lead[cols][None], n).min(axis=1))
        lead[cols] = np.minimum(lead[cols], np.where(near, lead[rows][:, None], n).min(axis=0))
        if (before == lead).all():
            return links, lead


def links(classes: DataFrame, hashing: Hashing) -> DataFrame:
    """(cid, links, root) of classes (cid, grp, vec, copies), a row for each tile that links a class; root is another
    class of its component or itself. A pair is counted in one tile only.

    Only buckets with company are dealt, so vectors cross the network once to meet their places and once for every
    bucket shared with others; a bucket of many blocks takes as many copies of each row.
    """
    found = entries(classes, hashing)
    # stored, so that the join meets exchanges on both sides and a bucket with a large share of the rows can be split
    shared = cut(found.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    places = found.join(shared, ["t", "key"]).groupBy("cid").agg(F.collect_list(F.struct("t", "key", "n")).alias("places"))  # one a table at most
    dealt = classes.join(places, "cid").withColumn("p", F.explode("places")).withColumn("blocks", F.ceil(F.col("p.n") / BLOCK))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cid"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = dealt.select("p.t", "p.key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") < F.col("other")).alias("left"), "cid", "grp", "copies", "vec")
    by = ["t", "key", "i", "j"]

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        t, i, j = (rows.column(c)[0].as_py() for c in ("t", "i", "j"))
        cid, grp, copies, left = (rows.column(c).to_numpy() for c in ("cid", "grp", "copies", "left"))
        for g in np.unique(grp):  # one, but for hash collisions
            at = np.flatnonzero(grp == g)
            unit = units(np.stack(rows.column("vec").take(pa.array(at)).to_numpy()))
            count, lead = tile_links(unit, keys(unit, grp[at], hashing), copies[at], None if i == j else left[at].astype(bool), t, hashing.similarity)
            hit = np.flatnonzero((count > 0) | (lead != np.arange(len(lead))))
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(cid[at][hit]), pa.array(count[hit]), pa.array(cid[at][lead[hit]])], ["cid", "links", "root"])

    ship(classes.sparkSession)
    return tiles.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda batches: (out for rows in runs(batches, by) for out in solve(rows)), "cid long, links long, root long")


def near_vectors(vectors: DataFrame, hashing: Hashing = NEAR, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row: how many other rows its vector links with, the smallest id
    reachable by links, and whether the row bears that id.

    Two rows link if their labels are equal and their vectors, as doubles, have a cosine of the similarity or more and
    share a bucket. Null labels, vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of unlike lengths. Rows are told apart even if their ids or all columns are equal. Null ids
    never name a component; one of null ids only has a null name and keeps its rows. No rows give no rows. Other
    columns are ignored.

    Equal vectors are one class from the start, so copies cost no pairs. A hot bucket is met block by block, and links
    are counted where they are found: neither pairs nor groups are written out. What is left is the arithmetic of
    comparing unequal vectors of one bucket, which grows with the square of a group of near copies.
    """
    of = {"id": id_col, "vec": vector_col, "label": label_col}
    rows = marked(vectors, *of.values())
    same = rows.where("grp is not null").groupBy("cls").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("grp").alias("grp"), F.first("vec").alias("vec"))
    classes = cut(same.withColumn("cid", F.monotonically_increasing_id()))
    met = cut(links(classes, hashing))
    roots = connected_components(met.where("cid <> root"), "cid", "root")
    names = classes.select("cid", "cls", "first", "copies").join(roots, F.col("cid") == F.col("node"), "left").select("cid", "cls", "first", "copies", F.coalesce("root", "cid").alias("root"))
    named = cut(names.groupBy("root").agg(F.min("first").alias("component_id")))
    counted = met.groupBy("cid").agg(F.sum("links").alias("links"))
    judged = cut(names.join(named, "root").join(counted, "cid", "left").select("cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("placed")))
    own = F.when(F.col("placed"), F.col("component_id")).otherwise(F.col("id"))
    return rows.select("id", "cls").join(judged, "cls", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


#: The same rows by all pairs, for DuckDB.
ALL_PAIRS_SQL = """
with recursive r as (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
u as (select * from r where v is not null and label is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
e as (select a.r as a, b.r as b, b.vec_id as id from u a join u b on a.label = b.label and len(a.v) = len(b.v) and a.r <> b.r and list_cosine_similarity(a.v, b.v) >= 0.98),
c as (select r, r as at, vec_id as id from r union select c.r, e.b, e.id from c join e on e.a = c.at),
k as (select r, min(id) as component_id from c group by r),
n as (select a as r, count(*) as n from e group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id is not distinct from component_id as kept from r join k using (r) left join n using (r)
"""
