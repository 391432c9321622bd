"""Substring dedup by lines or paragraphs (operator 8).

Units of all texts are normalised and digested; of each digest the occurrence ranked first stays, all later ones go.
What stays keeps the offsets it had in the original text. A unit is a line (or paragraph) with a word in it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from strandframe.llm._common import cut

#: Words a unit needs to be removed as a repeat: any unit with a word is one.
MIN_WORDS = 1
SEPARATORS = {"line": "\n", "paragraph": "\n\n"}
#: Columns that are added.
ADDED = ("n_units", "n_removed", "n_shared", "shared_words", "longest_shared", "kept_spans")


def normalised(unit: Column) -> Column:
    """Lower case, runs of white space and of punctuation as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(unit), r"[\s\p{Punct}]+", " "))


def _row(id_col: str, text_col: str) -> Column:
    """What tells rows apart: id and text together."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "line") -> DataFrame:
    """(id, row, pos, words, h1, h2): every unit with the number of its words and its 128-bit digest."""
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), SEPARATORS[kind])
    rows = docs.select(F.col(id_col).alias("id"), _row(id_col, text_col).alias("row"), F.posexplode(parts).alias("pos", "unit"))
    norm = rows.select("id", "row", "pos", normalised(F.col("unit")).alias("norm"))
    words = F.when(F.col("norm") == "", 0).otherwise(F.regexp_count("norm", F.lit(" ")) + 1)
    return norm.select("id", "row", "pos", words.alias("words"), F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """(row, positions, n_shared, shared_words, longest_shared) of the rows with a unit that stands elsewhere too.

    positions are those to remove, rising. The earliest occurrence by (id, row, position) stays, within one document
    too; null ids rank last, and rows of one id with unlike texts are documents of their own. Rows alike in id and
    text are one document given twice and fare alike. The shared columns count first occurrences too. Units are
    digested once and stored; a digest's count and first place are pre-aggregated before the shuffle, and the join
    back meets stored tables on both sides, so a frequent digest can be split.
    """
    long_ones = cut(units(docs, id_col, text_col, kind).where(F.col("words") >= min_words))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "pos")
    first = cut(long_ones.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h1", "h2", F.col("first.row").alias("first_row"), F.col("first.pos").alias("first_pos")))
    met = long_ones.join(first, ["h1", "h2"]).withColumn("stays", (F.col("row") == F.col("first_row")) & (F.col("pos") == F.col("first_pos")))
    # rows alike in id and text come as often as they stand; each place counts once
    own = met.groupBy("row").agg(F.collect_set(F.struct("pos", "words", "stays")).alias("own"))
    return own.select(
        "row",
        F.array_sort(F.transform(F.filter("own", lambda u: ~u["stays"]), lambda u: u["pos"])).alias("positions"),
        F.size("own").cast("long").alias("n_shared"),
        F.aggregate("own", F.lit(0).cast("long"), lambda n, u: n + u["words"]).alias("shared_words"),
        F.array_max(F.transform("own", lambda u: u["words"])).cast("long").alias("longest_shared"),
    )


@F.pandas_udf(ArrayType(IntegerType()))
def _running(sizes: pd.Series) -> pd.Series:
    """Where each unit begins, from the sizes of all."""
    return sizes.map(lambda v: None if v is None else np.cumsum(v) - v)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated units cut out of text_col, plus the columns ADDED.

    n_units: units, wordless ones included; n_removed: units removed; n_shared, shared_words, longest_shared: units
    that stand elsewhere too (the occurrence that stays included), their words, and the words of the longest one;
    kept_spans: (start, size) in characters of the original text. Null texts stay null and have no units, every row
    is kept, and a document that loses all its units has an empty text. Own columns named like an added one are an
    error; all other names may be used.
    """
    if taken := set(ADDED) & set(docs.columns):
        raise ValueError(f"columns in the way: {sorted(taken)}")
    sep = SEPARATORS[kind]
    found = cut(repeats(docs, id_col, text_col, kind, min_words))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _row(id_col, text_col).alias("row"))
    text = F.col(f"doc.`{text_col}`")
    joined = rows.join(found, "row", "left").withColumn("parts", F.split(text, sep)).withColumn("touched", F.coalesce(F.size("positions") > 0, F.lit(False)) & text.isNotNull())
    # One flag a unit, written out between the positions to remove: linear in the units.
    before = F.transform("positions", lambda p, i: F.concat(F.array_repeat(F.lit(True), p - F.coalesce(F.get("positions", i - 1), F.lit(-1)) - 1), F.array(F.lit(False))))
    flags = F.concat(F.flatten(before), F.array_repeat(F.lit(True), F.size("parts") - 1 - F.get("positions", F.size("positions") - 1)))
    joined = joined.withColumn("flags", F.when(F.col("touched"), flags))
    kept = F.array_join(F.filter("parts", lambda u, i: F.get("flags", i)), sep)
    starts = _running(F.transform("parts", lambda u: F.length(u) + F.lit(len(sep))))
    spans = F.filter(F.transform("parts", lambda u, i: F.when(F.get("flags", i), F.struct(F.get("starts", i).alias("start"), F.length(u).alias("size")))), lambda s: s.isNotNull())
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("size")))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    joined = joined.withColumn("starts", starts).withColumns(
        {
            "new_text": F.when(F.col("touched"), kept).otherwise(text),
            "n_units": F.when(text.isNull(), 0).otherwise(F.size("parts")).cast("long"),
            "n_removed": F.when(F.col("touched"), F.size("positions")).otherwise(0).cast("long"),
            **{c: count(c) for c in ("n_shared", "shared_words", "longest_shared")},
            "kept_spans": F.when(F.col("touched"), spans).otherwise(whole),
        }
    )
    return joined.select(*[F.col("new_text" if c == text_col else f"doc.`{c}`").alias(c) for c in docs.columns], *ADDED)


#: DuckDB's words for the query: the same normal form, the text itself in place of the digest.
REPEATS_SQL = r"""
with u as (select doc_id, t.pos - 1 as pos, t.unit as unit from (select doc_id, unnest(list_zip(range(1, len(p) + 1), p)) as z from (select doc_id, string_split(coalesce(text, ''), chr(10)) as p from documents)), lateral (select z[1] as pos, z[2] as unit) t),
n as (select *, trim(regexp_replace(lower(unit), '[\s!-/:-@\[-`{-~]+', ' ', 'g')) as norm from u),
l as (select *, len(string_split(norm, ' ')) as words from n where norm <> ''),
r as (select *, row_number() over (partition by norm order by doc_id nulls last, pos) as rank, count(*) over (partition by norm) as times from l),
g as (select doc_id, count(*) filter (where rank > 1) as n_removed, count(*) as n_shared, sum(words) as shared_words, max(words) as longest_shared from r where times > 1 group by doc_id),
k as (select n.doc_id, string_agg(n.unit, chr(10) order by n.pos) as kept from n left join r on r.doc_id is not distinct from n.doc_id and r.pos = n.pos where coalesce(r.rank, 1) = 1 group by n.doc_id),
c as (select doc_id, count(*) as n_units from n group by doc_id)
select d.doc_id, c.n_units::bigint as n_units, coalesce(g.n_removed, 0)::bigint as n_removed, coalesce(g.n_shared, 0)::bigint as n_shared, coalesce(g.shared_words, 0)::bigint as shared_words,
  coalesce(g.longest_shared, 0)::bigint as longest_shared, sha256(coalesce(k.kept, '')) as kept_sha256, coalesce(k.kept, '') as kept_text
from documents d join c on c.doc_id is not distinct from d.doc_id left join g on g.doc_id is not distinct from d.doc_id left join k on k.doc_id is not distinct from d.doc_id
"""
