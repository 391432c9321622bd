"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators._folders import shared_folder

#: Bytes of text that one call of a batch function gets at most (a longer text comes alone).
BATCH_BYTES = 3 << 20
#: Bytes that Spark puts in an Arrow batch at most (a longer row comes alone): a task holds its batch on both sides.
ARROW_BYTES = 8 << 20
_ARROW_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder the driver has it in, and get batches of bounded bytes."""
    if int(str(spark.conf.get(_ARROW_CONF)).rstrip("b")) not in range(1, ARROW_BYTES + 1):
        spark.conf.set(_ARROW_CONF, str(ARROW_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def cut(df: DataFrame) -> DataFrame:
    """The rows, stored in the shared checkpoint folder: lineage ends here and lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most BATCH_BYTES of text (one row at least)."""
    sizes = [0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()]
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > BATCH_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow over runs of rows of bounded text; function turns one run into the rows it yields."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = function(part)
                if out is not None:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts, null as empty."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def bit_map(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A map of 2 ** bits bits, those set that the leading bits of the hashes (longs) name.

    Its size is fixed however many rows there are, so it may go to every executor; a fuller map only lets more by.
    """
    bit = F.shiftrightunsigned(column, 64 - bits)
    words = hashes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("own")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("own").to_numpy().view(np.uint64)
    return out


def in_map(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned hashes may be among those that the map was made of."""
    bit = hashes >> np.uint64(64 - 6 - (len(known).bit_length() - 1))
    return (known[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


_owner: list[tuple[str, Callable[[], None]]] = []


def claim(name: str, forget: Callable[[], None]) -> None:
    """Say whose memo this worker process holds: when another operator's batch comes, the one before forgets its own.

    Workers outlive stages, so without this the memos of all operators of a session would add up.
    """
    if _owner and _owner[0][0] != name:
        _owner.pop()[1]()
    if not _owner:
        _owner.append((name, forget))
