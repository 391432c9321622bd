"""Rankings and selections with all ties broken."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by an order that leaves no ties."""
    by = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(by)).where("_rank = 1").drop("_rank")


def canonical_transcripts(df: DataFrame) -> DataFrame:
    """One transcript a gene: the provider's canonical one, else the longest valid one, ties by the id's bytes.

    df: gene_id, transcript_id, length, valid, canonical, exception. Exceptions are left out first; two canonical
    ones of a gene are an error when read.
    """
    kept = df.where(~F.coalesce("exception", F.lit(False)))
    by = Window.partitionBy("gene_id")
    n = F.count_if(F.coalesce("canonical", F.lit(False))).over(by)
    checked = kept.withColumn("_c", F.when(n > 1, F.raise_error(F.concat(F.lit("two canonical transcripts of "), "gene_id")).cast("int")).otherwise(F.coalesce(F.col("canonical").cast("int"), F.lit(0))))
    usable = checked.where((F.col("_c") == 1) | F.coalesce("valid", F.lit(False)))
    return best(usable, ["gene_id"], [F.col("_c").desc(), F.col("length").desc(), F.encode("transcript_id", "UTF-8")]).drop("_c")


def release_ordinal(text: Column) -> Column:
    """Days since the first of January of year 1, plus one; 0 for text in none of the known formats."""
    day = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy/MM/dd HH:mm", "yyyy/MM/dd", "yyyy-MM-dd")])
    return F.coalesce(F.datediff(F.to_date(day), F.lit("0001-01-01").cast("date")) + 1, F.lit(0))


def assembly_order(taxon: Column | None = None) -> list[Column]:
    """Best assembly first: current, taxon, category, source, level, newest, accession."""
    level = F.regexp_replace(F.lower("assembly_level"), "[^a-z]", "")
    category = F.lower(F.trim("refseq_category"))
    ranks = lambda c, names, rest: F.coalesce(*[F.when(c == n, i) for n, i in names.items()], F.lit(rest))
    near = F.lit(0) if taxon is None else F.when(F.col("taxid") == taxon, 0).when(F.col("species_taxid") == taxon, 1).otherwise(2)
    return [
        F.coalesce(F.col("suppressed").cast("int"), F.lit(0)),
        near,
        ranks(category, {"reference genome": 0, "representative genome": 1, "na": 2, "": 2}, 3),
        F.when(F.col("accession").startswith("GCF_"), 0).otherwise(1),
        ranks(level, {"completegenome": 0, "chromosome": 1, "scaffold": 2, "contig": 3}, 4),
        release_ordinal(F.col("release_date")).desc(),
        F.encode("accession", "UTF-8"),
    ]


def hash_sample(df: DataFrame, population: str, sample: str, dataset: str, size: int) -> DataFrame:
    """`size` samples of the largest population that has so many (ties by name), by the smallest SHA-256 of the names joined by NUL."""
    counts = df.groupBy(population).agg(F.count("*").alias("_n")).where(f"_n >= {size}")
    chosen = best(counts, [], [F.col("_n").desc(), F.encode(F.col(population).cast("string"), "UTF-8")]).drop("_n")
    key = F.sha2(F.concat_ws("\0", F.lit(dataset), F.col(population).cast("string"), F.col(sample).cast("string")), 256)
    mine = df.join(F.broadcast(chosen), population, "left_semi")  # one row
    return mine.withColumn("digest", key).orderBy("digest", sample).limit(size)


def until_target(df: DataFrame, size: str, order: Sequence[Column], target: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows in order as long as the sum of those before is under the target; the last may overshoot."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum(size).over(by), F.lit(0))).where(F.col("_before") < target).drop("_before")


def latest_attempts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One attempt a key: running before any that is not pending before any observed, then the largest job number."""
    state = F.upper("state")
    rank = F.when(state == "RUNNING", 0).when(state.isNotNull() & (state != "PENDING"), 1).when(F.col("observed"), 2).otherwise(3)
    return best(df, keys, [rank, F.col("job_id").desc()])


def with_multiplicity(df: DataFrame, key: str) -> DataFrame:
    """Every row, with how many rows share its key."""
    return df.withColumn("multiplicity", F.count("*").over(Window.partitionBy(key)))


def novelty_cover(rows: list[dict], strata: Sequence[str], picks: int) -> list[dict]:
    """A greedy pick of up to `picks` rows: most strata values not seen yet, a quarter more with the bonus flag, smaller, earlier.

    Sequential, over a candidate list that the caller has bounded.
    """
    seen, out, left = set(), [], list(enumerate(rows))
    while left and len(out) < picks:
        def worth(item: tuple[int, dict]) -> tuple:
            i, r = item
            return (-(sum((s, r[s]) not in seen for s in strata) + 0.25 * bool(r.get("bonus"))), r.get("size", 0), i)

        i, r = min(left, key=worth)
        out.append(r)
        seen |= {(s, r[s]) for s in strata}
        left = [x for x in left if x[0] != i]
    return out
