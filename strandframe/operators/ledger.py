"""Closed-world ledgers: every input row gets exactly one outcome, and sums reconcile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class LedgerError(ValueError):
    """A table breaks its contract."""


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, or an error naming one key that is empty or repeated."""
    blank = F.lit(False)
    for k in keys:
        blank |= F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
    empty = df.where(blank).limit(1).count()
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if empty or twice:
        raise LedgerError(f"key {list(keys)} is empty or repeated: {twice}")
    return df


def require_header(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if list(df.columns) != list(columns):
        raise LedgerError(f"columns are {df.columns}, not {list(columns)}")
    return df


def require_domain(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    odd = df.where(~F.col(column).isin(list(allowed)) | F.col(column).isNull()).limit(1).collect()
    if odd:
        raise LedgerError(f"{column} outside {list(allowed)}: {odd}")
    return df


def require_sum(df: DataFrame, whole: str, parts: Sequence[str]) -> DataFrame:
    """df, or an error if a row's parts do not add up to its whole."""
    odd = df.where(F.col(whole) != sum((F.col(p) for p in parts[1:]), F.col(parts[0]))).limit(1).collect()
    if odd:
        raise LedgerError(f"{whole} is not the sum of {list(parts)}: {odd}")
    return df


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side): BOTH, LEFT_ONLY or RIGHT_ONLY for every key of either side, so nothing is lost."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    met = a.join(b, list(keys), "full_outer")
    return met.select(*keys, F.when(F.col("_r").isNull(), "LEFT_ONLY").when(F.col("_l").isNull(), "RIGHT_ONLY").otherwise("BOTH").alias("side"))


def require_all_matched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    odd = reconcile(left, right, keys).where("side <> 'BOTH'").limit(1).collect()
    if odd:
        raise LedgerError(f"unmatched: {odd}")


def strict_join(left: DataFrame, right: DataFrame, keys: Sequence[str], same: Sequence[str] = (), tolerance: float = 1e-10) -> DataFrame:
    """Inner join of two tables unique by key in which every left row must match, and `same` columns agree."""
    require_unique(left, keys)
    require_unique(right, keys)
    if lost := left.join(right, list(keys), "left_anti").limit(1).collect():
        raise LedgerError(f"no match for {lost}")
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in same})
    joined = left.join(other, list(keys))
    for c in same:
        off = F.abs(F.col(c) - F.col(f"_r_{c}")) > tolerance
        joined = joined.withColumn(c, F.when(off, F.raise_error(F.lit(f"{c} differs")).cast("double")).otherwise(F.col(c))).drop(f"_r_{c}")
    return joined


def state_accounting(df: DataFrame, state: str, states: Sequence[str], size: str) -> DataFrame:
    """(state, rows, total): every state of the domain, those without rows at zero; another state is an error."""
    require_domain(df, state, states)
    names = df.sparkSession.createDataFrame([(s,) for s in states], f"{state} string")
    own = df.groupBy(state).agg(F.count("*").alias("rows"), F.sum(size).alias("total"))
    return names.join(own, state, "left").select(state, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("total", F.lit(0)).alias("total"))


def overlapping_totals(df: DataFrame, subsets: dict[str, Column], size: str) -> DataFrame:
    """(subset, rows, total) of conditions that may overlap, from one aggregation."""
    aggs = [x for n, c in subsets.items() for x in (F.count_if(c).alias(f"{n}_rows"), F.sum(F.when(c, F.col(size))).alias(f"{n}_total"))]
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("subset"), F.col(f"{n}_rows").alias("rows"), F.coalesce(F.col(f"{n}_total"), F.lit(0)).alias("total")) for n in subsets])).alias("_x")).select("_x.*")


def all_reasons(conditions: dict[str, Column]) -> Column:
    """The names of all conditions that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]), lambda x: x.isNotNull())


def first_reason(conditions: dict[str, Column], otherwise: str) -> Column:
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in conditions.items()], F.lit(otherwise))


def cap_vector(limits: DataFrame) -> DataFrame:
    """(dimension, source, cap): per dimension the smallest finite limit over sources; ties by source name."""
    fine = limits.where(F.col("limit").isNotNull() & ~F.isnan("limit") & (F.abs("limit") != float("inf")))
    g = fine.groupBy("dimension").agg(F.min(F.struct(F.col("limit"), F.col("source"))).alias("_m"))
    return g.select("dimension", F.col("_m.source").alias("source"), F.col("_m.limit").alias("cap"))


def proposed(df: DataFrame, additive: Sequence[str], capacity: Sequence[str], largest: dict[str, int], keys: Sequence[str] = ()) -> DataFrame:
    """Sums of additive columns, maxima of capacity ones, sums of the k largest values of others; to four places, half to even."""
    aggs = [F.sum(c).alias(c) for c in additive] + [F.max(c).alias(c) for c in capacity]
    out = df.groupBy(*keys).agg(*aggs)
    for c, k in largest.items():
        by = Window.partitionBy(*keys).orderBy(F.col(c).desc())
        part = df.select(*keys, c).withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= k).groupBy(*keys).agg(F.sum(c).alias(c))
        out = out.join(part, list(keys)) if keys else out.crossJoin(F.broadcast(part))  # one row
    names = [*additive, *capacity, *largest]
    return out.select(*keys, *[F.bround(F.col(c).cast("double"), 4).alias(c) for c in names])


def resource_verdict(low: Column, base: Column, high: Column, observed: Column, cap: Column) -> Column:
    """PASS if what was observed, else the high estimate, fits the cap; FAIL if even the low one does not; else INCONCLUSIVE."""
    return F.when(cap.isNull(), "INCONCLUSIVE").when(observed.isNotNull(), F.when(observed <= cap + 1e-9, "PASS").otherwise("FAIL")).when(high <= cap + 1e-9, "PASS").when(low > cap + 1e-9, "FAIL").otherwise("INCONCLUSIVE")


def upsert(log: DataFrame, keys: Sequence[str], sequence: str, insert_or_ignore: bool = False) -> DataFrame:
    """The current state of an append-only log: the last row of each key wins, or the first if later ones are ignored."""
    order = F.col(sequence).asc() if insert_or_ignore else F.col(sequence).desc()
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def attach_last_failure(rows: DataFrame, failures: DataFrame, keys: Sequence[str], ordinal: str, value: str, state: str = "state") -> DataFrame:
    """rows with the last failure of their key, if they are not complete."""
    last = failures.groupBy(*keys).agg(F.max_by(value, ordinal).alias("last_failure"))
    joined = rows.join(last, list(keys), "left")
    return joined.withColumn("last_failure", F.when(F.col(state) != "COMPLETE", F.col("last_failure")))


def audit_claims(claims: DataFrame, recomputed: DataFrame, relative: float = 1e-12, absolute: float = 1e-12) -> DataFrame:
    """(claim, reported, recomputed, absolute_difference, status) of claims against recomputed values."""
    m = claims.join(recomputed, "claim", "left")
    d = F.abs(F.col("reported") - F.col("recomputed"))
    ok = d <= F.greatest(F.lit(absolute), relative * F.abs("recomputed"))
    return m.select("claim", "reported", "recomputed", d.alias("absolute_difference"), F.when(F.col("recomputed").isNull(), "MISSING").when(ok, "MATCH").otherwise("MISMATCH").alias("status"))


def claim_rows(specs: DataFrame, observations: DataFrame, keys: Sequence[str], identity: str) -> DataFrame:
    """(keys, n, status) of every specification, those without observations too; n counts distinct identities."""
    own = observations.groupBy(*keys).agg(F.countDistinct(identity).alias("n"))
    return specs.select(*keys).join(own, list(keys), "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, "OBSERVED").otherwise("NO_OBSERVATION").alias("status"))


def forbidden_paths(edges: DataFrame, required: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(source, target, fault): required edges of a task graph that are missing and forbidden ones that are there."""
    lost = required.join(edges, ["source", "target"], "left_anti").withColumn("fault", F.lit("missing"))
    there = forbidden.join(edges, ["source", "target"], "left_semi").withColumn("fault", F.lit("forbidden"))
    return lost.unionByName(there)


def unequal_rows(a: DataFrame, b: DataFrame, volatile: Sequence[str] = ()) -> DataFrame:
    """Rows on one side only, once volatile columns are gone; side tells which. Repeated rows count."""
    x, y = a.drop(*volatile), b.drop(*volatile)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))
