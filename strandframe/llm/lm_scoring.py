"""Language-model scores by stupid backoff, computed relationally (operator 5).

Documents are dealt into blocks. A block's n-grams are exploded and pre-aggregated, and each part of the hash range
gets, packed into one row, the block's distinct n-gram hashes with their counts. A part adds up the counts of all
blocks (the n-gram count table, partitioned by hash) and sends each block, again as one row, the totals of the
n-grams that it asked about, in its order. Joined to the block's documents these give every document's score. A
document is scored with the counts of all others: its own n-grams are taken off the totals, else each would be its
own evidence. Very frequent n-grams are one entry a block, so no key is hot.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm._common import claim, cut, ship

#: Longest n-gram; factor of each step back; bytes of text in a block; fewest blocks; parts of the hash range.
ORDER, ALPHA, BLOCK_BYTES, MIN_BLOCKS, PART_BLOCKS = 2, 0.4, 14 << 20, 24, 1
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: N-grams are told apart by 56 bits.
_BITS = np.uint64((1 << 56) - 1)
_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BEGIN = np.uint64(0x5BD1E995)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= 200_000:
            self.clear()
        self[word] = h
        return h


@functools.cache
def _hashes() -> _Hashes:
    return _Hashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * _TURN
    return h ^ h >> np.uint64(32)


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each text, and for n = 1 to order the hash of the n-gram that ends at each word.

    A text begins with a mark that stands for the words before it; the mark itself is an n-gram of length 1 that no
    word position has, so it is returned as the entry before each text's first word.
    """
    claim("lm_scoring", _hashes.cache_clear)
    split = [t.translate(_LOWER).split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter(map(_hashes().__getitem__, (w for words in split for w in words)), np.uint64, int(counts.sum()))
    at = np.cumsum(counts + 1) - counts - 1  # of the marks
    words = np.empty(len(flat) + len(split), np.uint64)
    is_mark = np.zeros(len(words), bool)
    is_mark[at] = True
    words[is_mark], words[~is_mark] = BEGIN, flat
    out, running = [], np.zeros(len(words), np.uint64)
    first = np.repeat(at, counts + 1)
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            # words n - 1 places back; before the mark there is only the mark
            back = np.maximum(np.arange(len(words)) - (n - 1), first)
            running = running * _MIX + _mixed(words[back])
            out.append((_mixed(running + np.uint64(n)) & _BITS))
    return counts, out


def pack(values: np.ndarray) -> bytes:
    """Rising numbers as compressed differences, in planes of bytes."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(steps.view("<u8").reshape(-1).astype(np.uint64), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    width = 1 if not len(values) or values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 8
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1).astype(np.int64)


def cuts(parts: int) -> np.ndarray:
    """Where the parts of the hash range begin."""
    return np.array([(i << 56) // parts for i in range(parts)], np.uint64)


def block_counts(texts: list[bytes], order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams of a block, rising, with their counts, for each n."""
    return [np.unique(h, return_counts=True) for h in grams(texts, order)[1]]


def document_scores(texts: list[bytes], totals: list[np.ndarray], n_words: int, order: int = ORDER, alpha: float = ALPHA) -> list[tuple[int, float | None, int]]:
    """(words, sum of log scores, words that needed a step back) of each text.

    totals holds, for each n, corpus counts of the block's distinct n-grams in rising order; n_words is the number of
    words in the corpus. Counts and number are those of the other documents. A word seen nowhere else scores as
    alpha ** order of a word seen once.
    """
    counts, hashes = grams(texts, order)
    numbers = [np.unique(h, return_inverse=True)[1] for h in hashes]
    out, at = [], 0
    for k in counts.tolist():
        own = slice(at, at + k + 1)
        at += k + 1
        if not k:
            out.append((0, None, 0))
            continue
        left = []
        for n in range(order):
            _, inverse, mine = np.unique(numbers[n][own], return_inverse=True, return_counts=True)
            left.append(totals[n][numbers[n][own]] - mine[inverse])
        rest = max(1, n_words - k)
        score = np.full(k, np.log(alpha) * order - np.log(rest))
        level = np.full(k, -1)
        for n in range(order):
            top = left[n][1:]
            under = left[n - 1][:-1] if n else None
            ok = (top > 0) & (under >= top) if n else top > 0
            value = np.log(np.maximum(top, 1)) - (np.log(np.maximum(under, 1)) if n else np.log(rest)) + (order - 1 - n) * np.log(alpha)
            score[ok], level[ok] = value[ok], n
        out.append((k, float(score.sum()), int((level < order - 1).sum())))
    return out


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, log_score, mean_log_score, n_backoff) for every row.

    Null and wordless texts have no score. Repeated rows are documents of their own and evidence for each other.
    Other columns are ignored. Memory is that of a block, or of the part of the hash range whose n-grams meet.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(MIN_BLOCKS, -(-size // block_bytes))
    parts = blocks * PART_BLOCKS
    texts = texts.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    of_id = texts.schema["id"].dataType.simpleString()

    def ask(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        rows: list[tuple] = []
        for n, (found, counts) in enumerate(block_counts(table.column("text").cast(pa.binary()).to_pylist(), order)):
            edges = [*np.searchsorted(found, cuts(parts)).tolist(), len(found)]
            rows += [(p, block, n, pack(found[a:b]), pack_counts(counts[a:b])) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(zip(("part", "block", "n", "grams", "counts"), kinds, strict=True))})

    def total(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        part = table.column("part")[0].as_py()
        ns, owners = np.array(table.column("n")), table.column("block").to_pylist()
        packed, counted = table.column("grams").to_pylist(), table.column("counts").to_pylist()
        for n in sorted(set(ns.tolist())):
            rows = np.flatnonzero(ns == n).tolist()
            own = [unpack(packed[i]) for i in rows]
            counts = [unpack_counts(counted[i]) for i in rows]
            _, inverse = np.unique(np.concatenate(own), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
            edges = np.cumsum([0, *map(len, own)])
            words = int(sums.sum())
            out += [(owners[i], part, n, pack_counts(sums[inverse[a:b]]), words) for i, a, b in zip(rows, edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
        return pa.table({c: pa.array([r[i] for r in out], kind) for i, (c, kind) in enumerate(zip(("block", "part", "n", "totals", "words"), kinds, strict=True))})

    def score(own: pa.Table, got: pa.Table) -> pa.Table:
        answers = sorted(zip(got.column("n").to_pylist(), got.column("part").to_pylist(), got.column("totals").to_pylist(), strict=True))
        totals = [np.concatenate([unpack_counts(t) for m, _, t in answers if m == n] or [np.zeros(0, np.int64)]) for n in range(order)]
        n_words = got.column("all_words")[0].as_py() if got.num_rows else 0
        found = document_scores(own.column("text").cast(pa.binary()).to_pylist(), totals, n_words, order, alpha)
        return pa.table({"id": own.column("id"), "n_words": pa.array([k for k, _, _ in found], pa.int64()), "log_score": pa.array([s for _, s, _ in found], pa.float64()), "n_backoff": pa.array([b for _, _, b in found], pa.int64())})

    asked = texts.select("block", "text").groupBy("block").applyInArrow(ask, "part int, block int, n int, grams binary, counts binary")
    answered = asked.groupBy("part").applyInArrow(total, "block int, part int, n int, totals binary, words long")
    # Each part repeats its sum of words in every row; the words of the corpus, marks included, are one number.
    answered = cut(answered)
    all_words = answered.where("n = 0").groupBy("part").agg(F.max("words").alias("w")).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first().w
    answered = answered.withColumn("all_words", F.lit(all_words).cast("long")).drop("words")
    done = texts.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, f"id {of_id}, n_words long, log_score double, n_backoff long")
    return done.select(F.col("id").alias(id_col), "n_words", "log_score", (F.col("log_score") / F.col("n_words")).alias("mean_log_score"), "n_backoff")


#: DuckDB's words for the query, for bigrams and the parameters above; scores rounded as the query rounds them.
SCORES_SQL = r"""
with w as (select row_number() over () as r, doc_id, list_concat(['<s> '], regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) as v from documents),
t as (select r, i, v[i] as x, case when i > 1 then v[i - 1] end as p from w, lateral (select unnest(range(1, len(v) + 1)) as i) g),
u as (select x, count(*) as n from t group by x), uo as (select r, x, count(*) as n from t group by r, x),
b as (select p, x, count(*) as n from t where i > 1 group by p, x), bo as (select r, p, x, count(*) as n from t where i > 1 group by r, p, x),
a as (select sum(n)::double as n from u),
s as (select t.r, b.n - bo.n as c2, up.n - uop.n as c0, ux.n - uox.n as c1, greatest(1, a.n - (len(w.v) - 1)) as rest
  from t join w on w.r = t.r join b on b.p = t.p and b.x = t.x join bo on bo.r = t.r and bo.p = t.p and bo.x = t.x join u up on up.x = t.p join uo uop on uop.r = t.r and uop.x = t.p join u ux on ux.x = t.x join uo uox on uox.r = t.r and uox.x = t.x, a where t.i > 1),
f as (select r, count(*) as n_words, sum(case when c2 > 0 then ln(c2 / c0::double) when c1 > 0 then ln(c1::double) - ln(rest) + ln(0.4) else 2 * ln(0.4) - ln(rest) end) as log_score, count(*) filter (where c2 <= 0) as n_backoff from s group by r)
select w.doc_id, coalesce(n_words, 0)::bigint as n_words, round(log_score, 4) as log_score, round(log_score / n_words, 6) as mean_log_score, coalesce(n_backoff, 0)::bigint as n_backoff from w left join f on f.r = w.r
"""
