"""Interval algebra on half-open, zero-based intervals (contig, start, end).

Every function works on whole tables and keeps to two costs: one shuffle on (contig, bin) and, where runs cross bins,
a second over the far fewer results. A contig with most of the rows is spread over its bins, so no sweep has to see a
whole contig. Touching intervals merge. Empty intervals are dropped where the contract allows and refused by
`require_valid`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 16


def _keyed(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def valid(df: DataFrame) -> DataFrame:
    """Rows that are intervals at all: both ends known and start before end."""
    return df.where("start < end")


def require_valid(df: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """The same rows; a reversed, empty or unknown interval, or one outside its contig, is an error when read."""
    bad = ~F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")), F.lit(False))
    checked = df.withColumn("start", F.when(bad, F.raise_error(F.concat(F.lit("bad interval on "), F.coalesce(F.col("contig").cast("string"), F.lit("null"))))).otherwise(F.col("start")))
    if lengths is None:
        return checked
    size = lengths.select(F.col("contig").alias("_contig"), F.col("length").alias("_length"))
    joined = checked.join(size, checked["contig"] == size["_contig"], "left")
    out = F.coalesce(F.col("end") > F.col("_length"), F.lit(True))
    return joined.withColumn("end", F.when(out, F.raise_error(F.lit("interval outside its contig"))).otherwise(F.col("end"))).drop("_contig", "_length")


def pieces(df: DataFrame, width: int = BIN) -> DataFrame:
    """Intervals cut at the edges of bins, with the column bin."""
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    cut = valid(df).withColumn("bin", F.explode(bins))
    return cut.withColumn("start", F.greatest("start", F.col("bin") * width)).withColumn("end", F.least("end", (F.col("bin") + 1) * width))


def _islands(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))
    marked = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def merge(df: DataFrame, keys: Sequence[str] = ("contig",), width: int = BIN) -> DataFrame:
    """The union per key as disjoint intervals; touching ones become one."""
    keys = list(keys)
    local = _islands(pieces(df.select(*keys, "start", "end"), width), [*keys, "bin"]).drop("bin")
    return _islands(local, keys).select(*keys, "start", "end")


def joined(df: DataFrame, keys: Sequence[str] = ("contig",)) -> DataFrame:
    """Intervals with those that touch or overlap made one, by a sweep per key: for the few that reach an edge of a bin."""
    return _islands(df, list(keys)).select(*keys, "start", "end")


def measure(df: DataFrame, keys: Sequence[str] = ("contig",), width: int = BIN) -> DataFrame:
    """Bases in the union per key. Bins are disjoint, so their sums add up without a second sweep."""
    keys = list(keys)
    local = _islands(pieces(df.select(*keys, "start", "end"), width), [*keys, "bin"])
    return local.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


def depth_segments(df: DataFrame, keys: Sequence[str] = ("contig",), width: int = BIN, counters: dict[str, Column] | None = None) -> DataFrame:
    """(keys, start, end, depth): maximal runs of positions of one bin between events, with how many intervals cover.

    counters adds a sum per name, each over the intervals its condition holds for. Segments of depth 0 between
    intervals are kept; a segment never crosses a bin.
    """
    keys = list(keys)
    counters = {"depth": F.lit(True)} | (counters or {})
    flagged = df.select(*keys, "start", "end", *[F.when(c, 1).otherwise(0).alias(n) for n, c in counters.items()])
    cut = pieces(flagged, width)
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("step")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("step"))))
    events = cut.select(*keys, "bin", ends.alias("e"), *counters)
    sums = events.groupBy(*keys, "bin", F.col("e.pos").alias("start")).agg(*[F.sum(F.col("e.step") * F.col(n)).alias(n) for n in counters])
    by = Window.partitionBy(*keys, "bin").orderBy("start")
    running = by.rowsBetween(Window.unboundedPreceding, 0)
    out = sums.select(*keys, "start", F.lead("start").over(by).alias("end"), *[F.sum(n).over(running).alias(n) for n in counters])
    return out.where("end is not null")


def max_depth(df: DataFrame, keys: Sequence[str] = ("contig",), width: int = BIN) -> DataFrame:
    """Most intervals over one base; intervals that only touch do not overlap."""
    return depth_segments(df, keys, width).groupBy(*keys).agg(F.max("depth").alias("max_depth"))


def uniquely_covered(df: DataFrame, keys: Sequence[str] = ("contig",), width: int = BIN) -> DataFrame:
    """Disjoint intervals of depth exactly 1."""
    return merge(depth_segments(df, keys, width).where("depth = 1"), keys, width)


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("contig",), width: int = BIN) -> DataFrame:
    """Bases in both unions, as disjoint intervals, by one sweep over both (no pairs are formed)."""
    return _combine(a, b, keys, width, (F.col("_a") > 0) & (F.col("_b") > 0))


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("contig",), width: int = BIN) -> DataFrame:
    """Bases of a's union that b's lacks, as disjoint intervals."""
    return _combine(a, b, keys, width, (F.col("_a") > 0) & (F.col("_b") == 0))


def _combine(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int, which: Column) -> DataFrame:
    keys = list(keys)
    both = a.select(*keys, "start", "end", F.lit(True).alias("_own")).unionByName(b.select(*keys, "start", "end", F.lit(False).alias("_own")))
    swept = depth_segments(both, keys, width, {"_a": F.col("_own"), "_b": ~F.col("_own")})
    return merge(swept.where(which), keys, width)


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("contig",), width: int = BIN, how: str = "inner") -> DataFrame:
    """Rows of a with each row of b that overlaps (how: inner), or rows of a with any (semi) or none (anti).

    b's start and end come as b_start, b_end, its other columns keep their names. Intervals are dealt to the bins they
    touch and joined on (keys, bin); a pair is emitted in the bin of the later start only, so once.
    """
    keys = list(keys)
    left = valid(a).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    right = valid(b).withColumnsRenamed({"start": "b_start", "end": "b_end"} | {k: f"_b_{k}" for k in keys})
    right = right.withColumn("_b_bin", F.explode(F.sequence(F.floor(F.col("b_start") / width), F.floor((F.col("b_end") - 1) / width))))
    on = (F.col("_bin") == F.col("_b_bin")) & (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    for k in keys:
        on &= left[k] == right[f"_b_{k}"]
    if how == "inner":
        met = left.join(right, on).where(F.col("_bin") == F.floor(F.greatest("start", "b_start") / width))
        return met.drop("_bin", "_b_bin", *[f"_b_{k}" for k in keys])
    hit = left.join(right, on, "left_semi").drop("_bin").distinct()
    if how == "semi":
        return a.join(hit.select(*keys, "start", "end").distinct(), [*keys, "start", "end"], "left_semi")
    return a.join(hit.select(*keys, "start", "end").distinct(), [*keys, "start", "end"], "left_anti")


def points_within(points: DataFrame, intervals: DataFrame, keys: Sequence[str] = ("contig",), position: str = "pos", width: int = BIN, how: str = "left_semi") -> DataFrame:
    """Points inside the union (left_semi), outside it (left_anti) or with the merged interval they are in (inner).

    A point has one bin, so only intervals are dealt out; merged intervals make at most one match.
    """
    keys = list(keys)
    cut = pieces(merge(intervals, keys, width), width) if how != "inner" else merge(intervals, keys, width).withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    cut = cut.withColumnsRenamed({k: f"_b_{k}" for k in keys})
    on = (F.floor(points[position] / width) == cut["bin"]) & (points[position] >= cut["start"]) & (points[position] < cut["end"])
    for k in keys:
        on &= points[k] == cut[f"_b_{k}"]
    joined = points.join(cut, on, how)
    return joined.drop("bin", *[f"_b_{k}" for k in keys]) if how == "inner" else joined


def contained(spans: DataFrame, intervals: DataFrame, keys: Sequence[str] = ("contig",), width: int = BIN) -> DataFrame:
    """Spans wholly inside one merged interval. Only the interval over a span's first base can hold it."""
    keys = list(keys)
    held = merge(intervals, keys, width).withColumnsRenamed({"start": "_m_start", "end": "_m_end"} | {k: f"_m_{k}" for k in keys})
    held = held.withColumn("_m_bin", F.explode(F.sequence(F.floor(F.col("_m_start") / width), F.floor((F.col("_m_end") - 1) / width))))
    on = (F.floor(spans["start"] / width) == held["_m_bin"]) & (spans["start"] >= held["_m_start"]) & (spans["end"] <= held["_m_end"])
    for k in keys:
        on &= spans[k] == held[f"_m_{k}"]
    return valid(spans).join(held, on, "left_semi")


def reason_mask(universe: DataFrame, reasons: DataFrame, order: Sequence[str], keys: Sequence[str] = ("contig",), width: int = BIN, reason: str = "reason", clear: str = "callable") -> DataFrame:
    """(keys, reason, start, end): the universe split by the first reason in `order` that holds, else `clear`.

    A base has one reason only, so the parts add up to the universe. Unknown reasons are refused.
    """
    keys = list(keys)
    known = reasons.withColumn(reason, F.when(F.col(reason).isin(list(order)), F.col(reason)).otherwise(F.raise_error(F.lit("unknown reason"))))
    both = universe.select(*keys, "start", "end", F.lit(None).cast("string").alias(reason)).unionByName(known.select(*keys, "start", "end", reason))
    counters = {"_universe": F.col(reason).isNull()} | {f"_r{i}": F.coalesce(F.col(reason) == r, F.lit(False)) for i, r in enumerate(order)}
    swept = depth_segments(both, keys, width, counters).where("_universe > 0")
    first = F.coalesce(*[F.when(F.col(f"_r{i}") > 0, F.lit(r)) for i, r in enumerate(order)], F.lit(clear))
    return merge(swept.withColumn(reason, first), [*keys, reason], width)


def runs(positions: DataFrame, keys: Sequence[str] = ("contig",), position: str = "pos") -> DataFrame:
    """Runs of consecutive positions as intervals (gaps and islands); repeated positions count once."""
    keys = list(keys)
    return merge(positions.select(*keys, F.col(position).alias("start"), (F.col(position) + 1).alias("end")).distinct(), keys)


def depth_masks(depth: DataFrame, specs: Sequence[tuple[str, int | None, int | None]], keys: Sequence[str] = ("contig",)) -> DataFrame:
    """(name, keys, start, end): runs of positions (1-based pos) with depth within each named inclusive range."""
    hits = F.filter(F.array(*[F.when((F.col("depth") >= (low if low is not None else 0)) & (F.lit(True) if high is None else F.col("depth") <= high), F.lit(name)) for name, low, high in specs]), lambda n: n.isNotNull())
    named = depth.select(*keys, (F.col("pos") - 1).alias("pos"), F.explode(hits).alias("name"))
    return runs(named, ["name", *keys])


def windows(lengths: DataFrame, core: int, padding: int = 0) -> DataFrame:
    """Disjoint core windows over each contig, with padded query windows clipped to it."""
    starts = lengths.where("length > 0").withColumn("core_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(core).cast("long"))))
    out = starts.withColumn("core_end", F.least(F.col("core_start") + core, F.col("length")))
    return out.select("contig", "core_start", "core_end", F.greatest(F.lit(0), F.col("core_start") - padding).alias("query_start"), F.least("length", F.col("core_end") + padding).alias("query_end"))


def tiles(df: DataFrame, size: int, keys: Sequence[str] = ("contig",)) -> DataFrame:
    """Merged intervals cut into units of at most `size`, from each interval's own start."""
    merged = merge(df, keys).withColumn("_at", F.explode(F.sequence("start", F.col("end") - 1, F.lit(size).cast("long"))))
    return merged.select(*keys, F.col("_at").alias("start"), F.least(F.col("_at") + size, F.col("end")).alias("end"))


def block_counts(points: DataFrame, size: int, keys: Sequence[str] = ("contig",), position: str = "pos") -> DataFrame:
    """Points per block of `size` positions."""
    return points.groupBy(*keys, F.floor(F.col(position) / size).alias("block")).count()


def split_at_blocks(df: DataFrame, size: int, keys: Sequence[str] = ("contig",)) -> DataFrame:
    """Bases of the union per block of `size` positions."""
    cut = pieces(merge(df, keys), size)
    return cut.groupBy(*keys, F.col("bin").alias("block")).agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


def pick_stratified(lengths: DataFrame, k: int, window: int) -> DataFrame:
    """k contigs at evenly spaced ranks by name, and the first `window` bases of each; ranks that meet are an error."""
    ranked = lengths.withColumn("_i", F.row_number().over(Window.orderBy("contig")) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(max(1, k - 1))).cast("int"))
    checked = ranked.withColumn("_w", F.when(F.size(F.array_distinct(wanted)) < k, F.raise_error(F.lit("strata are not unique"))).otherwise(wanted))
    return checked.where(F.array_contains("_w", F.col("_i"))).select("contig", F.lit(0).cast("long").alias("start"), F.least("length", F.lit(window).cast("long")).alias("end"))


def genome_strata(lengths: DataFrame, width: int) -> DataFrame:
    """Early, middle and late windows by cumulative genome length, each on the contig its offset falls in."""
    by = Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)
    placed = lengths.withColumn("_from", F.coalesce(F.sum("length").over(by), F.lit(0))).withColumn("_total", F.sum("length").over(Window.partitionBy()))
    offsets = F.explode(F.array(F.struct(F.lit("early").alias("name"), F.lit(0).cast("long").alias("at")), F.struct(F.lit("middle").alias("name"), F.floor(F.col("_total") / 2).alias("at")), F.struct(F.lit("late").alias("name"), F.greatest(F.lit(0), F.col("_total") - width).alias("at"))))
    hit = placed.withColumn("_o", offsets).where("_o.at >= _from and _o.at < _from + length")
    start = F.col("_o.at") - F.col("_from")
    return hit.select(F.col("_o.name").alias("stratum"), "contig", start.alias("start"), F.least(F.col("length"), start + width).alias("end"))


def axis_audit(df: DataFrame, threshold: float, keys: Sequence[str] = ("contig",), width: int = BIN) -> DataFrame:
    """Per key: deepest overlap, pairs that overlap by more than `threshold` of the shorter one, most such partners + 1.

    df needs an `id` that tells rows apart. Pairs come from the binned join; only overlapping ones are formed.
    """
    pairs = overlaps(df.select(*keys, "start", "end", "id"), df.select(*keys, "start", "end", F.col("id").alias("b_id")), keys, width).where("id <> b_id")
    share = (F.least("end", "b_end") - F.greatest("start", "b_start")) / F.least(F.col("end") - F.col("start"), F.col("b_end") - F.col("b_start"))
    bad = pairs.where(share > threshold).groupBy(*keys, "id").agg(F.count("*").alias("n"))
    summed = bad.groupBy(*keys).agg((F.sum("n") / 2).cast("long").alias("conflicts"), (F.max("n") + 1).alias("most"))
    deep = max_depth(df, keys, width)
    return deep.join(summed, list(keys), "left").select(*keys, "max_depth", F.coalesce("conflicts", F.lit(0)).alias("conflicts"), F.coalesce("most", F.lit(1)).alias("max_conflicts"))
