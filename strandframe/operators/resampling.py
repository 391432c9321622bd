"""Bootstraps that follow a generator's stream draw for draw, with every replicate drawn by itself on the executors.

Two generators are followed: PCG64 with bounded draws by multiplication, whose stream can be entered anywhere, and the
Mersenne twister with bounded draws by rejection, whose states are handed on in checkpoints of 624 words.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.operators._folders import shared_folder

#: Numbers of a stream that one batch holds.
SPAN = 1 << 20
#: Draws between two handed-on states of a twister's stream.
HANDED = 1 << 16
#: Numbered rows that a task holds while it goes along a stream.
HELD = 1 << 22
_WORD = np.uint64(0xFFFFFFFF)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], into: str) -> DataFrame:
    """df with the number, from 0, of a row within its keys in this order; no key's rows need fit in one task.

    Rows are dealt in ranges of (keys, order) and stored; a range's own numbers start after the rows that the ranges
    before it have of the key. Rows alike in keys and order are numbered as they come.
    """
    spark = df.sparkSession
    shared_folder(spark)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *keys, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]
    starts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*named, F.col("_part").alias("_of"), "_before")
    local = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    joined = local.join(starts, [F.col("_part") == F.col("_of"), *(F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys))])
    return joined.select(*df.columns, (F.col("_own") - 1 + F.col("_before")).cast("long").alias(into))


# --- PCG64 --------------------------------------------------------------------------------------------------------


def pcg_words(seed: int, start: int, count: int) -> np.ndarray:
    """32-bit numbers start to start + count of the stream: each 64-bit step gives its low half first."""
    bits = np.random.PCG64(seed)
    bits.advance(start // 2)
    return bits.random_raw(start % 2 + count + 1 >> 1).astype("<u8").view("<u4")[start % 2 : start % 2 + count]


def refused(words: np.ndarray, n: int) -> np.ndarray:
    """Which 32-bit numbers a bounded draw below n passes over."""
    return (words.astype(np.uint64) * np.uint64(n) & _WORD) < np.uint64((1 << 32) % n)


@dataclass(frozen=True)
class PcgDraws:
    """In each of the replicates, as many draws below each size as the size says, one size after the other.

    Numbers that a draw passes over shift all that follow. They are rare (n in 2 ** 32), so tasks look for numbers that
    any size would pass over, and the few found tell where every replicate's numbers begin; a replicate is then drawn
    alone. A size of one takes no number.
    """

    seed: int
    sizes: tuple[int, ...]
    replicates: int
    passed: tuple[int, ...]

    @staticmethod
    def of(spark: SparkSession, seed: int, sizes: Sequence[int], replicates: int) -> PcgDraws:
        if any(not 1 <= n < 1 << 32 for n in sizes):
            raise ValueError("sizes must lie between 1 and 2 ** 32 - 1")
        per = [n for n in sizes if n > 1]
        total, bounds = sum(per) * replicates, [0, *accumulate(per)]
        reach = total + 1024 + math.ceil(total * 2 * max(per, default=0) / 2**32)
        kinds = sorted(set(per))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    words = pcg_words(seed, k * SPAN, min(SPAN, reach - k * SPAN))
                    at = np.flatnonzero(np.any([refused(words, n) for n in kinds], axis=0)) if kinds else np.zeros(0, int)
                    yield pa.RecordBatch.from_arrays([pa.array(at + k * SPAN, pa.int64()), pa.array(words[at].astype(np.int64))], ["at", "word"])

        found = spark.range(math.ceil(reach / SPAN)).mapInArrow(look, "at long, word long").orderBy("at").collect() if total else []
        passed: list[int] = []
        for r in found:
            logical = r.at - len(passed)
            if logical < total and refused(np.array([r.word], np.uint32), per[bisect_right(bounds, logical % bounds[-1]) - 1])[0]:
                passed.append(r.at)
        return PcgDraws(seed, tuple(sizes), replicates, tuple(passed))

    def draw(self, replicate: int) -> list[np.ndarray]:
        """The draws of a replicate, an array a size."""
        per = sum(n for n in self.sizes if n > 1)
        ends = [replicate * per, (replicate + 1) * per]
        logical = [p - i for i, p in enumerate(self.passed)]
        start, end = (e + sum(x < e for x in logical) for e in ends)
        words = pcg_words(self.seed, start, end - start)
        words = np.delete(words, [p - start for p in self.passed if start <= p < end])
        out, i = [], 0
        for n in self.sizes:
            if n == 1:
                out.append(np.zeros(1, np.int64))
                continue
            out.append((words[i : i + n].astype(np.uint64) * np.uint64(n) >> np.uint64(32)).astype(np.int64))
            i += n
        return out

    def weights(self, spark: SparkSession) -> DataFrame:
        """(replicate, stratum, number, weight): how often a replicate draws each row of a stratum, never drawn ones left out."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.column(0).to_pylist():
                    for k, drawn in enumerate(self.draw(r)):
                        number, weight = np.unique(drawn, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(number), r)), pa.array(np.full(len(number), k, np.int32)), pa.array(number), pa.array(weight)], ["replicate", "stratum", "number", "weight"])

        return spark.range(self.replicates).repartition(max(1, min(self.replicates, spark.sparkContext.defaultParallelism * 4))).mapInArrow(run, "replicate long, stratum int, number long, weight long")


# --- Mersenne twister ---------------------------------------------------------------------------------------------


def twister(seed: int) -> np.random.MT19937:
    """The standard library's generator of a seed, for whole arrays."""
    state = random.Random(seed).getstate()[1]
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    return bits


def below(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(accepted draws below n, their places among the words): the leading bits of a word, passed over if not below n."""
    if not 1 <= n < 1 << 32:
        raise ValueError("draws lie below 2 ** 32")
    drawn = words >> np.uint64(32 - n.bit_length())
    at = np.flatnonzero(drawn < n)
    return drawn[at].astype(np.int64), at


def twister_draws(bits: np.random.MT19937, n: int, count: int) -> np.ndarray:
    """The next count draws below n; what is left of the stream is past them."""
    out, left = [], count
    while left:
        state = bits.state
        drawn, at = below(bits.random_raw(2 * left + 64), n)
        if len(drawn) >= left:
            bits.state = state
            bits.random_raw(int(at[left - 1]) + 1)
            drawn = drawn[:left]
        out.append(drawn)
        left -= len(drawn)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _state_row(bits: np.random.MT19937) -> bytes:
    state = bits.state["state"]
    return np.append(state["key"], np.uint32(state["pos"])).astype("<u4").tobytes()


def _from_row(row: bytes) -> np.random.MT19937:
    words = np.frombuffer(row, "<u4")
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": words[:-1].astype(np.uint32), "pos": int(words[-1])}}
    return bits


def handed_states(spark: SparkSession, seed: int, n: int, draws: int) -> DataFrame:
    """(piece, state): the generator before every HANDED draws below n of one stream.

    A twister cannot be entered midway, so one task runs along the stream, keeping nothing but states, which are stored;
    all draws are then made from them.
    """
    shared_folder(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                bits = twister(seed)
                for piece in range(math.ceil(draws / HANDED)):
                    yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([_state_row(bits)], pa.binary())], ["piece", "state"])
                    twister_draws(bits, n, min(HANDED, draws - piece * HANDED))

    return spark.range(0, 1, 1, 1).mapInArrow(run, "piece long, state binary").checkpoint()


def one_stream(spark: SparkSession, seed: int, n: int, replicates: int) -> DataFrame:
    """(replicate, number, weight): n draws below n a replicate, all replicates from one twister stream, counted by number.

    A replicate whose draws lie in two pieces has its counts in two rows of a number.
    """
    total = n * replicates
    states = handed_states(spark, seed, n, total).repartition(spark.sparkContext.defaultParallelism * 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first = piece * HANDED
                drawn = twister_draws(_from_row(state), n, min(HANDED, total - first))
                replicate = (first + np.arange(len(drawn))) // n
                both, weight = np.unique(np.stack([replicate, drawn]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(weight)], ["replicate", "number", "weight"])

    return states.mapInArrow(run, "replicate long, number long, weight long")


def drawn_sums(rows: DataFrame, seed: int, n: int, replicates: int, held: int = HELD) -> DataFrame:
    """(replicate, num, den, known): sums of rows (number, num, den) over n draws below n a replicate, all replicates from
    one twister stream; known counts the draws of a num that is not null.

    Draws outnumber rows by the replicates, so they never move: a task holds the rows of `held` numbers, makes the draws
    of its share of the stream again and takes those that are its own. The stream is made once for each range of numbers.
    """
    total, ranges = n * replicates, math.ceil(n / held)
    pieces = math.ceil(total / HANDED)
    shares = max(1, min(pieces, math.ceil(rows.sparkSession.sparkContext.defaultParallelism * 2 / ranges)))
    each = math.ceil(pieces / shares)
    own = rows.select("number", F.col("num").cast("double"), F.col("den").cast("double"), F.floor(F.col("number") / held).alias("range"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    states = handed_states(rows.sparkSession, seed, n, total).select("piece", "state", F.floor(F.col("piece") / each).cast("int").alias("share"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges - 1).cast("long"))).alias("range"))

    def run(key: tuple[pa.Scalar, ...], mine: pa.Table, stream: pa.Table) -> pa.Table:
        low = key[0].as_py() * held
        at = mine["number"].to_numpy() - low
        num, den, known = (np.zeros(min(held, n - low), kind) for kind in (float, float, bool))
        num[at], den[at], known[at] = mine["num"].fill_null(0).to_numpy(), mine["den"].to_numpy(), mine["num"].is_valid().to_numpy()
        out: list[list[np.ndarray]] = [[], [], [], []]
        for piece, state in zip(stream["piece"].to_pylist(), stream["state"].to_pylist(), strict=True):
            first = piece * HANDED
            drawn = twister_draws(_from_row(state), n, min(HANDED, total - first)) - low
            took = np.flatnonzero((drawn >= 0) & (drawn < len(num)))
            replicate, drawn = (first + took) // n - first // n, drawn[took]
            sums = [np.bincount(replicate, weights=v[drawn]) for v in (num, den, known)]
            for column, values in zip(out, [first // n + np.arange(len(sums[0])), *sums], strict=True):
                column.append(values)
        joined = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table([pa.array(joined[0].astype(np.int64)), *map(pa.array, joined[1:])], ["replicate", "num", "den", "known"])

    parts = own.groupBy("range", "share").cogroup(states.groupBy("range", "share")).applyInArrow(run, "replicate long, num double, den double, known double")
    return parts.groupBy("replicate").agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("known").alias("known"))


def own_streams(spark: SparkSession, seed: int, n: int, replicates: int, first: int = 1) -> DataFrame:
    """(replicate, seed, draw, unit): n draws below n for replicates numbered from first, each from the stream of seed + replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column(0).to_pylist():
                bits = twister(seed + r)
                for at in range(0, n, SPAN):
                    unit = twister_draws(bits, n, min(SPAN, n - at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), r)), pa.array([str(seed + r)] * len(unit)), pa.array(at + np.arange(len(unit))), pa.array(unit)], ["replicate", "seed", "draw", "unit"])

    return spark.range(first, first + replicates).repartition(max(1, min(replicates, spark.sparkContext.defaultParallelism * 4))).mapInArrow(run, "replicate long, seed string, draw long, unit long")


def bootstrap_ratio(blocks: DataFrame, replicates: int, seed: int, order: Sequence[str], numerator: str = "num", denominator: str = "den") -> DataFrame:
    """One row (estimate, ci_low, ci_high, standard_error, replicates, blocks): a ratio of sums over blocks drawn with replacement.

    Blocks without denominator take no part; the rest, in this order, are drawn by one twister stream. The interval's
    ends are the order statistics at floor and ceil of 2.5 and 97.5 % of replicates - 1; the error is the sample
    deviation. No usable block, or fewer than two replicates, is an error.
    """
    spark = blocks.sparkSession
    kept = blocks.where(F.col(denominator) > 0).select(*order, F.col(numerator).alias("_num"), F.col(denominator).alias("_den"))
    about = kept.agg(F.count("*").alias("n"), (F.sum("_num") / F.sum("_den")).alias("estimate")).first()
    if not about.n or replicates < 2:
        raise ValueError("a bootstrap needs a block with a denominator and two replicates")
    rows = numbered(kept.withColumn("_all", F.lit(0)), ["_all"], order, "number")
    sums = drawn_sums(rows.select("number", F.col("_num").alias("num"), F.col("_den").alias("den")), seed, about.n, replicates)
    ratios = sums.select("replicate", F.when(F.col("known") > 0, F.col("num") / F.col("den")).alias("ratio"))
    low, high = math.floor(0.025 * (replicates - 1)) + 1, math.ceil(0.975 * (replicates - 1)) + 1
    ranked = ratios.withColumn("_r", F.row_number().over(Window.orderBy("ratio")))  # a row a replicate
    at = lambda k: F.max(F.when(F.col("_r") == k, F.col("ratio")))
    return ranked.agg(F.lit(about.estimate).alias("estimate"), at(low).alias("ci_low"), at(high).alias("ci_high"), F.stddev_samp("ratio").alias("standard_error"), F.count("*").alias("replicates")).withColumn("blocks", F.lit(about.n))


def sampled_records(draws: DataFrame, units: DataFrame) -> DataFrame:
    """(replicate, draw, name, symbols): the records of every replicate, one for each draw of a unit (unit, contig, start,
    end, symbols), named by ordinal and span, so that neither bins nor blocks reach over a boundary.

    Units must be of N, K and T and as long as they say; draws of units that are not there are an error.
    """
    unit, ordinal = F.col("unit"), F.lpad((F.col("draw") + 1).cast("string"), 6, "0")
    ordinal = F.when(F.col("draw") + 1 < 1_000_000, ordinal).otherwise((F.col("draw") + 1).cast("string"))
    joined = draws.join(units, "unit", "left")
    bad = F.col("contig").isNull() | ~F.coalesce(F.col("symbols").rlike("^[NKT]+$"), F.lit(False)) | (F.length("symbols") != F.col("end") - F.col("start"))
    name = F.concat(F.lit("block_"), ordinal, F.lit("_"), F.col("contig"), F.lit("_"), F.col("start").cast("string"), F.lit("_"), F.col("end").cast("string"))
    return joined.select("replicate", "draw", F.when(bad, F.raise_error(F.concat(F.lit("no such unit, or not its symbols: "), unit.cast("string")))).otherwise(name).alias("name"), "symbols")
