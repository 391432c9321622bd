"""Order checks over files that are read in parts: no window over a whole file, only over its parts' ends."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sort_faults(df: DataFrame, by: Sequence[str], order: Sequence[str], strict: bool = False) -> DataFrame:
    """(the columns order, rule) of rows of by that come too early, where order tells a row's place in its file.

    order is (file, place): rows of a partition must be of rising places within a file, as readers give them, or they
    are faults of the rule 'place'. A row is a fault of 'order' if by is below that of the row before in its file
    (strict: or equal); nulls come first. Where places are faults, faults of order mean nothing. Each partition is streamed past once and leaves its faults and the ends of its
    stretches of a file; only the ends, a few rows a partition, are put in order and compared with their neighbours.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (*order, *by)}
    names = [*(f"o{i}" for i in range(len(order))), *(f"b{i}" for i in range(len(by)))]
    own = df.select(*[F.col(c).alias(n) for c, n in zip(kinds, names, strict=True)])
    fields = [own.schema[n] for n in names]
    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields, strict=True)), "rule string, stretch long"])
    rank = lambda row, a, b: tuple((x is not None, x) if x is not None else (False, 0) for x in row[a:b])
    k = len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, stretch = None, None, 0
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is None or row[0] != last[0]:
                    if last is not None:
                        out += [(*first, "first", stretch), (*last, "last", stretch)]
                        stretch += 1
                    first = row
                elif rank(row, 1, k) <= rank(last, 1, k):
                    out.append((*row, "place", stretch))
                elif (now := rank(row, k, None)) < (then := rank(last, k, None)) or strict and now == then:
                    out.append((*row, "order", stretch))
                last = row
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([*(c.type for c in batch.columns), pa.string(), pa.int64()])], [*names, "rule", "stretch"])
            kinds_ = [c.type for c in batch.columns]
        if last is not None:
            out = [(*first, "first", stretch), (*last, "last", stretch)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([*kinds_, pa.string(), pa.int64()])], [*names, "rule", "stretch"])

    found = own.mapInArrow(run, schema).drop("stretch")
    ends = found.where("rule in ('first', 'last')")
    in_file = Window.partitionBy("o0").orderBy(*names[1:k], F.when(F.col("rule") == "first", 0).otherwise(1))
    key = F.struct(*[F.struct(F.col(n).isNotNull(), n) for n in names[k:]])
    place = F.struct(*names[1:k])
    near = ends.withColumns({"_key": key, "_place": place}).withColumns({"_k": F.lag("_key").over(in_file), "_p": F.lag("_place").over(in_file), "_r": F.lag("rule").over(in_file)})
    joint = near.where("rule = 'first' and _r is not null")
    worse = (F.col("_key") <= F.col("_k")) if strict else (F.col("_key") < F.col("_k"))
    at_ends = joint.withColumn("rule", F.when((F.col("_place") <= F.col("_p")) | (F.col("_r") != "last"), "place").when(worse, "order").otherwise("fine")).where("rule <> 'fine'")
    both = found.where("rule not in ('first', 'last')").unionByName(at_ends.select(found.columns))
    return both.select(*[F.col(n).alias(c) for n, c in zip(names[:k], order, strict=True)], "rule")


def key_stretches(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """(file, key, stretches): in how many separate runs of its file a key's rows come; one if they are contiguous.

    A partition leaves the ends of its runs of a key; runs that meet over a partition's edge are one.
    """
    file, place = order
    kind_f, kind_k, kind_p = (df.schema[c].dataType.simpleString() for c in (file, key, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for f, x, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or (f, x) != now[:2]:
                    out += [now] * (now is not None)
                    now = (f, x, p)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], c.type) for i, c in enumerate(batch.columns)], ["file", "key", "place"])
            types = [c.type for c in batch.columns]
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[i]], t) for i, t in enumerate(types)], ["file", "key", "place"])

    starts = df.select(file, key, place).mapInArrow(run, f"file {kind_f}, key {kind_k}, place {kind_p}")
    before = F.lag(F.struct("key")).over(Window.partitionBy("file").orderBy("place"))
    marked = starts.withColumn("_new", F.coalesce((~before.eqNullSafe(F.struct("key"))).cast("int"), F.lit(1)))
    return marked.groupBy("file", "key").agg(F.sum("_new").alias("stretches"))
