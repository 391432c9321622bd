"""Mixing sources to target weights by min-cost flow (operator 7).

Documents are summed by membership pattern (the set of sources a document may serve), patterns and sources become a
small flow network: a pattern gives its size once at cost 0, once more at cost 1, and so on (convex repetition
costs), sources take their quotas. The flow fixes how many words each pattern gives; within a pattern whole passes
are even and the rest goes to documents in the order of a keyed digest. Only sums by pattern reach the driver, at
most `max_patterns` of them; the order is never sorted as a whole: sums by digest prefix find the one prefix in
which a pattern's rest runs out, and only that prefix is ranked.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from strandframe.llm._common import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, REPEATS, SEED, MAX_PATTERNS = (3, 1, 2), Fraction(3, 2), 2, "mix-1", 20_000


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, repeats: int = REPEATS) -> dict[str | None, float]:
    """Words per source: `share` of all words by weight, none above `repeats` times its size, excess shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    rows = sorted((Fraction(repeats * sizes[s], weights[i % len(weights)]), i, s, weights[i % len(weights)]) for i, s in enumerate(names) if True) if names else []
    left, weight, out = share * sum(sizes.values()), sum(w for *_, w in rows), {}
    for k, (ratio, _, s, w) in enumerate(rows):
        if ratio * weight > left:
            for *_, t, v in rows[k:]:
                out[t] = float(left) * v / weight
            return out
        out[s] = float(repeats * sizes[s])
        left, weight = left - repeats * sizes[s], weight - w
    return out


def route(supply: dict[tuple, int], quotas: dict[str | None, int], repeats: int = REPEATS) -> dict[tuple, dict[str | None, int]]:
    """Words from each pattern to each of its sources: most words, then least total cost of repetition.

    Successive cheapest paths over residual capacities; the k-th pass over a pattern costs k - 1 a word.
    """
    patterns, sources = list(supply), list(quotas)
    at = {("s", s): i + 2 + len(patterns) for i, s in enumerate(sources)}
    arcs: list[list[int]] = []  # to, room, cost; the reverse arc has the number ^ 1
    out_of: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(sources))]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        out_of[a].append(len(arcs))
        arcs.append([b, room, cost])
        out_of[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    given: dict[tuple, dict[str | None, int]] = {p: {} for p in patterns}
    for i, p in enumerate(patterns):
        for k in range(repeats):
            arc(0, i + 2, supply[p], k)
        for s in p:
            if s in quotas:
                given[p][s] = len(arcs)
                arc(i + 2, at["s", s], repeats * supply[p], 0)
    for s in sources:
        arc(at["s", s], 1, quotas[s], 0)
    while True:
        cost, came, queue, waits = {0: 0}, {}, deque([0]), {0}
        while queue:
            a = queue.popleft()
            waits.discard(a)
            for n in out_of[a]:
                b, room, c = arcs[n]
                if room > 0 and cost[a] + c < cost.get(b, 1 << 60):
                    cost[b], came[b] = cost[a] + c, n
                    if b not in waits:
                        waits.add(b)
                        queue.append(b)
        if 1 not in cost:
            return {p: {s: arcs[n ^ 1][1] for s, n in d.items()} for p, d in given.items()}
        path, b = [], 1
        while b:
            path.append(came[b])
            b = arcs[came[b] ^ 1][0]
        room = min(arcs[n][1] for n in path)
        for n in path:
            arcs[n][1] -= room
            arcs[n ^ 1][1] += room


def mix(docs: DataFrame, members: Column, size: Column, id_col: str = "doc_id", weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, repeats: int = REPEATS, seed: str = SEED, max_patterns: int = MAX_PATTERNS) -> tuple[DataFrame, dict[str | None, int], dict[str | None, float]]:
    """(id, members, size, taken) per row, with the sizes and targets of the sources.

    members is an array of the sources a row may serve (null is a source too); it comes back sorted, without repeats,
    and empty where it was null: such a row serves none and is not taken. A source's size counts every row that may
    serve it. taken lies between 0 and repeats * size. Rows that repeat (id and size alike) share a place in the
    order, whichever comes first. An empty table gives no rows and no targets. More than max_patterns membership
    patterns raise an error, since their sums are what the driver holds. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    pattern = F.array_sort(F.array_distinct(F.coalesce(members.cast(ArrayType(StringType())), F.array().cast(ArrayType(StringType())))))
    rows = cut(docs.select(F.col(id_col).alias("id"), pattern.alias("members"), size.alias("size"), key.alias("key")))
    # the longer the table, the longer the prefix: about a million rows have one, and are ranked in one task
    digits = max(3, math.ceil(math.log(max(1, rows.count()) / (1 << 20), 16)))
    rows = rows.withColumn("part", F.substring("key", 1, digits))
    parts = cut(rows.groupBy("members", "part").agg(F.sum("size").alias("words")))
    sums = parts.groupBy("members").agg(F.sum("words").alias("words")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    supply = {tuple(r.members): r.words for r in sorted(sums, key=lambda r: tuple((s is None, s or "") for s in r.members))}
    sizes: dict[str | None, int] = {}
    for p, n in supply.items():
        for s in set(p):
            sizes[s] = sizes.get(s, 0) + n
    aims = targets(sizes, weights, share, repeats)
    flow = route(supply, {s: int(t) for s, t in aims.items()}, repeats)
    plan = [(list(p), *divmod(sum(flow[p].values()), n)) if n else (list(p), 0, 0) for p, n in supply.items()]
    kind = StructType([StructField("members", ArrayType(StringType())), StructField("passes", LongType()), StructField("rest", LongType())])
    plan_df = F.broadcast(spark.createDataFrame(plan, kind))  # at most max_patterns rows
    same = lambda a, b: a["members"].eqNullSafe(b["members"])
    before = Window.partitionBy("members").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    edge = parts.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    edge = edge.join(plan_df, same(edge, plan_df)).where("before <= rest and rest < before + words").groupBy(edge["members"]).agg(F.first("passes").alias("passes"), F.first("rest").alias("rest"), F.max("part").alias("edge"), F.max("before").alias("before"))
    # A rest below the pattern's size always has its prefix, but a pattern of size 0 has none.
    full = plan_df.join(edge.select("members", "edge", "before"), "members", "left")
    full = F.broadcast(full.withColumnRenamed("members", "_members"))
    joined = rows.join(full, rows["members"].eqNullSafe(full["_members"])).drop("_members")
    sure = joined.where("edge is null or part <> edge").withColumn("extra", F.when(F.col("part") < F.col("edge"), F.col("size")).otherwise(0))
    rank = Window.partitionBy("members").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    open_ = joined.where("part = edge").withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(rank), F.lit(0)))
    open_ = open_.withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("ahead")))).drop("ahead")
    done = sure.unionByName(open_).select(F.col("id").alias(id_col), "members", "size", (F.col("passes") * F.col("size") + F.col("extra")).cast("long").alias("taken"))
    return done, sizes, aims


def mix_by_source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **more) -> DataFrame:
    """(id, source, size, source_size, target, taken): every row serves its own source, null being a source."""
    done, sizes, aims = mix(docs, F.array(F.col(source_col)), word_count(F.col(text_col)), id_col, **more)
    kind = "source string, source_size long, target double"
    names = F.broadcast(docs.sparkSession.createDataFrame([(s, n, aims[s]) for s, n in sizes.items()], kind))  # one row a source, at most max_patterns
    rows = done.withColumn("_source", F.element_at("members", 1))
    return rows.join(names, rows["_source"].eqNullSafe(names["source"])).select(id_col, names["source"].alias(source_col), "size", "source_size", "target", "taken")


#: DuckDB's words for the query over documents with the parameters above.
MIX_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
             md5('mix-1:' || coalesce(doc_id::varchar, 'null')) as key from {docs}),
s as (select source, sum(size)::bigint as source_size, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w from d group by source),
o as (select *, coalesce(sum(2 * source_size) over (order by 2.0 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::double as capped,
        sum(w) over (order by 2.0 * source_size / w, source nulls last rows between current row and unbounded following)::double as weight,
        1.5 * (sum(source_size) over ())::double as total from s),
f as (select *, 2.0 * source_size * weight <= (total - capped) * w as full_ from o),
c as (select coalesce(sum(2 * source_size) filter (where full_), 0)::double as capped, sum(w) filter (where not full_)::double as weight from f),
t as (select f.source, source_size, case when full_ then 2.0 * source_size else (total - c.capped) * w / c.weight end::double as target from f, c),
p as (select source, source_size, target, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as passes,
        case when source_size > 0 then floor(target)::bigint % source_size else 0 end as rest from t),
x as (select d.*, coalesce(sum(size) over (partition by source order by key, size rows between unbounded preceding and 1 preceding), 0) as ahead from d)
select x.doc_id, x.size, p.source_size, p.target, (p.passes * x.size + greatest(0, least(x.size, p.rest - x.ahead)))::bigint as taken{more}
from x join p on x.source is not distinct from p.source
"""
