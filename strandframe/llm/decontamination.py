"""Benchmark decontamination by template windows (operator 9).

Words become template tokens: numbers, number words with units and names turn into typed placeholders, all else is
lower-cased. Windows of template tokens of the benchmark are hashed and joined to those of the documents; a hit is
verified token by token, and its slots are checked: within a run the same original value must stand for the same value
every time. A re-parameterised question matches although its numbers and names are new.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm._common import bit_map, bytes_of, claim, cut, in_map, map_batches, ship, slices

#: Tokens in a window; the least share of an item's tokens that consistent windows of a document must cover, or the
#: number of tokens that is enough whatever the share; windows of the benchmark that are sent to every executor at most
#: (beyond that the windows are joined by a shuffle, after a filter of 2 ** FILTER_BITS bits).
WINDOW, COVER, ENOUGH, MAX_SENT, FILTER_BITS = 8, 0.6, 50, 1_000_000, 27
#: Fixed values.
UNITS = frozenset(b"mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec secs min mins h hr hrs hour hours day days week weeks month months year years metre metres meter meters mile miles inch inches foot feet gram grams kilogram kilograms pound pounds litre litres liter liters dollar dollars euro euros cent cents percent degree degrees watt watts volt volts hz khz mhz ghz kb mb gb tb mph kmh".split())
NUMBER_WORDS = frozenset(b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter dozen".split())
_NUMBER = re.compile(rb"[$\xe2\x82\xac\xc2\xa3]*[+-]?\d[\d.,:/%]*(?:st|nd|rd|th)?$")
_NUMBER_UNIT = re.compile(rb"([+-]?\d[\d.,]*)([a-z]+)$")
_STRIP = b".,;:!?\"'()[]{}*#$%&|<>"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
NUM, UNIT, NAME = b"<num>", b"<unit>", b"<name>"


def _capital(bare: bytes) -> bool:
    """Whether a word begins with a capital of any alphabet and has other letters too."""
    if bare[:1] < b"\x80":
        return bare[:1].isupper() and not bare.isupper()
    word = bare.decode("utf-8", "replace")
    return word[:1].isupper() and not word.isupper()


class Vocabulary(dict):
    """Raw words as numbers, with columns: template token, its hash, and what the word is."""

    def __init__(self):
        super().__init__()
        self.tokens: list[bytes] = []
        self.fresh: list[tuple[int, int]] = []
        self.hashes, self.kinds = np.zeros(0, np.uint64), np.zeros(0, np.uint8)

    def __missing__(self, raw: bytes) -> int:
        bare = raw.strip(_STRIP)
        low = bare.translate(_LOWER)
        wordy = low[:1].isalpha()
        if low in NUMBER_WORDS or (not wordy and _NUMBER.match(low)):
            low = NUM
        elif not wordy and (m := _NUMBER_UNIT.match(low)) and m[2] in UNITS:
            low = NUM + UNIT
        elif _capital(bare):
            self.fresh.append((xxhash.xxh64_intdigest(low), MAY_NAME | (ENDS if raw.rstrip(b"\"')]}*#$%&|")[-1:] in _ENDINGS else 0)))
            return self._put(raw, low)
        self.fresh.append((xxhash.xxh64_intdigest(low), (0 if low else BLANK) | (MAY_UNIT if low in UNITS else 0) | (IS_NUM if low == NUM else 0) | (ENDS if raw.rstrip(b"\"')]}*#$%&|")[-1:] in _ENDINGS else 0)))
        return self._put(raw, low)

    def forget(self) -> None:
        self.clear()
        self.__init__()

    def _put(self, raw: bytes, token: bytes) -> int:
        n = self[raw] = len(self.tokens)
        self.tokens.append(token)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 200_000:
            self.forget()
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            self.hashes = np.concatenate([self.hashes, np.array([h for h, _ in self.fresh], np.uint64)])
            self.kinds = np.concatenate([self.kinds, np.array([k for _, k in self.fresh], np.uint8)])
            self.fresh = []
        return out


BLANK, ENDS, MAY_NAME, MAY_UNIT, IS_NUM = 1, 2, 4, 8, 16
_ENDINGS = (b".", b"!", b"?", b":")
VOCABULARY = Vocabulary()
_UNIT_HASH, _NAME_HASH = np.uint64(xxhash.xxh64_intdigest(UNIT)), np.uint64(xxhash.xxh64_intdigest(NAME))


def templated(words: list[bytes], starts: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(which words have a token, their hashes in VARIANTS ways, what each became).

    Words of several texts may stand one after the other; starts says where texts begin. A capital inside a sentence
    opens a name, one that opens a sentence may; a unit is one only after a number. Hashes: names inside sentences as
    placeholders, all as words, and all capitals as placeholders. Became: 0 as it is, 1 a name, 2 a unit, 4 perhaps a name.
    """
    numbers = VOCABULARY.numbers(words)
    kinds = VOCABULARY.kinds[numbers]
    opens = np.ones(len(words), bool)
    opens[1:] = (kinds[:-1] & ENDS) > 0
    if starts is not None:
        opens[starts[starts < len(words)]] = True
    capital = (kinds & MAY_NAME) > 0
    named, perhaps = capital & ~opens, capital & opens
    at = np.flatnonzero((kinds & BLANK) == 0)
    numbers, kinds, named, perhaps = numbers[at], kinds[at], named[at], perhaps[at]
    plain = VOCABULARY.hashes[numbers]
    unit = (kinds & MAY_UNIT) > 0
    unit[1:] &= (kinds[:-1] & IS_NUM) > 0
    unit[:1] = False
    plain[unit] = _UNIT_HASH
    masked = plain.copy()
    masked[named] = _NAME_HASH
    opened = masked.copy()
    opened[perhaps] = _NAME_HASH
    return at, [masked, plain, opened], named.astype(np.uint8) + 2 * unit + 4 * perhaps


_BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every run of `size` tokens."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for i in range(size):
        out *= _BASE
        out += hashes[i : i + len(out)]
    return (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


class Text:
    """A text's template tokens, its original words, which may be names, and its hashes."""

    def __init__(self, data: bytes):
        words = data.split()
        at, self.hashes, became = templated(words)
        self.raws = [words[i] for i in at.tolist()]
        self.tokens = [(VOCABULARY.tokens[VOCABULARY[r]], NAME, UNIT)[k & 3] for r, k in zip(self.raws, became.tolist(), strict=True)]
        self.words = [_word(r) for r in self.raws]
        self.names = ((became & 5) > 0).tolist()


class Items:
    """Benchmark items, indexed by their windows; an item shorter than a window is one window of its own length."""

    def __init__(self, rows: list[tuple[int, bytes]], size: int):
        self.items, found = {}, {}
        for i, data in rows:
            text = Text(data)
            if not text.tokens:
                continue
            n = min(size, len(text.tokens))
            self.items[i] = (text.tokens, [_value(t, r) for t, r in zip(text.tokens, text.raws, strict=True)], text.words, text.names, n)
            for h in text.hashes:
                for at, key in enumerate(window_hashes(h, n).tolist()):
                    found.setdefault(n, {}).setdefault(key, set()).add((i, at))
        self.owners = found
        self.seen = {}
        for n, keys in found.items():
            self.seen[n] = np.zeros(1 << 20, bool)
            self.seen[n][np.fromiter(keys, np.uint64, len(keys)) >> np.uint64(44)] = True

    def hits(self, hashes: np.ndarray, n: int) -> list[tuple[int, int]]:
        """(position, hash) of windows of n tokens that the index has."""
        own = window_hashes(hashes, n)
        keys = self.owners[n]
        return [(p, h) for p in np.flatnonzero(self.seen[n][own >> np.uint64(44)]).tolist() if (h := int(own[p])) in keys]


def _word(raw: bytes) -> bytes:
    return raw.strip(_STRIP).translate(_LOWER)


def _value(token: bytes, raw: bytes) -> bytes:
    """The value in a slot; other tokens have none."""
    return _word(raw) if token in (NUM, UNIT, NAME) or token == NUM + UNIT else b""


def _same(a: bytes, b: bytes, raw_a: bytes, raw_b: bytes) -> bool:
    """Tokens agree, or both are the same word although one looks like a name."""
    return a == b or raw_a == raw_b


def matches(data: bytes, items: Items) -> list[tuple[int, int, int, float, bool]]:
    """(item, first token, tokens covered, share of the item, whether only slots differ) for each item met.

    Windows that share a hash are verified and lengthened both ways by equal template tokens; words that may be names
    are equal as long as one always stands for the same other one. A run whose slots are consistent counts whole; of
    another one, what stands verbatim for a window or more counts. The share is that of the item's tokens covered.
    """
    text = Text(data)
    tokens, words, names = text.tokens, text.words, text.names
    hits: dict[int, set[tuple[int, int]]] = {}
    for n, owners in items.owners.items():
        for h in text.hashes:
            for p, key in items.hits(h, n):
                for i, q in owners[key]:
                    hits.setdefault(i, set()).add((p, q))
    out = []
    for i, found in hits.items():
        theirs, values, their_words, their_names, n = items.items[i]
        covered, first, changed, done = set(), len(tokens), False, set()

        def lengthened(p: int, q: int, loose: bool) -> tuple[int, int, dict[bytes, bytes] | None] | None:
            """(first, last + 1) of the run around a window, and what its slots stand for, none if inconsistent."""
            slots: dict[bytes, bytes] = {}

            def alike(k: int) -> bool:
                if not (0 <= p + k < len(tokens) and 0 <= q + k < len(theirs)):
                    return False
                if _same(tokens[p + k], theirs[q + k], words[p + k], their_words[q + k]):
                    return True
                return loose and names[p + k] and their_names[q + k] and slots.setdefault(their_words[q + k], words[p + k]) == words[p + k]

            if not all(alike(k) for k in range(n)):
                return None
            a, b = 0, n
            while alike(a - 1):
                a -= 1
            while alike(b):
                b += 1
            fits = all(slots.setdefault(values[q + k], words[p + k]) == words[p + k] for k in range(a, b) if values[q + k])
            return a, b, slots if fits else None

        for p, q in sorted(found):
            if (p, q) in done:
                continue
            tried = [r for r in (lengthened(p, q, True), lengthened(p, q, False)) if r]
            if not tried:
                continue
            a, b, slots = next((r for r in tried if r[2] is not None), tried[-1])
            done |= {(p + k, q + k) for k in range(a, b)}
            if slots is not None:
                runs = [(a, b)]
                changed |= any(k != v for k, v in slots.items())
            else:
                unlike = [a - 1, *(k for k in range(a, b) if words[p + k] != their_words[q + k]), b]
                runs = [(x + 1, y) for x, y in zip(unlike, unlike[1:], strict=False) if y - x > n]
            for x, y in runs:
                covered |= set(range(q + x, q + y))
                first = min(first, p + x)
        if covered:
            out.append((i, first, len(covered), len(covered) / len(theirs), changed))
    return out


def batch_matches(texts: list[bytes], items: Items) -> dict[int, list[tuple[int, int, int, float, bool]]]:
    """Matches by position in the batch. One pass over all windows of the batch finds the texts worth a closer look."""
    claim("decontamination", VOCABULARY.forget)
    split = [t.split() for t in texts]
    starts = np.cumsum([0, *map(len, split)])[:-1]
    at, hashes, _ = templated([w for words in split for w in words], starts)
    owner = np.searchsorted(starts, at, "right") - 1
    near = {int(owner[p]) for n in items.owners for h in hashes for p, _ in items.hits(h, n) if owner[p] == owner[p + n - 1]}
    return {k: found for k in sorted(near) if (found := matches(texts[k], items))}


def counts(hit: tuple[int, int, int, float, bool], cover: float, enough: int) -> bool:
    """Whether a match is contamination: a large share of the item, or a long passage of it."""
    return hit[3] >= cover or hit[2] >= enough


def _rows_of(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """(row, item, item_text): every benchmark row with a text, told apart by id and text; the id may be null."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("item_text")).where("item_text is not null").distinct()
    return rows.withColumn("row", F.xxhash64("item", "item_text"))


def _bound(rows: DataFrame) -> int:
    """A bound of the number of windows of benchmark rows: three hashings a word."""
    return 3 * rows.agg(F.coalesce(F.sum(F.regexp_count("item_text", F.lit(r"\S+"))), F.lit(0)).alias("n")).first().n


_HIT = "first_token long, n_tokens long, share double, reparameterised boolean"
_HIT_KINDS = [pa.int64(), pa.int64(), pa.float64(), pa.bool_()]


def _searched(rows: DataFrame, docs: DataFrame, window: int, cover: float, enough: int) -> DataFrame:
    """(key, item, first_token, n_tokens, share, reparameterised) of docs (key, text): the small benchmark is sent."""
    sent = docs.sparkSession.sparkContext.broadcast([(n, r.item, r.item_text.encode()) for n, r in enumerate(sorted(rows.collect(), key=lambda r: (r.item is None, r.item or 0, r.item_text)))])
    of_key = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names = Items([(n, data) for n, _, data in sent.value], window), [i for _, i, _ in sent.value]
        for batch in batches:
            for piece in slices(batch):
                found = [(k, names[h[0]], *h[1:]) for k, own in batch_matches(bytes_of(piece), index).items() for h in own if counts(h, cover, enough)]
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array([f[0] for f in found], pa.int64())), *(pa.array([f[i + 1] for f in found], kind) for i, kind in enumerate([pa.int64(), *_HIT_KINDS]))], ["key", "item", "first_token", "n_tokens", "share", "reparameterised"])

    return docs.mapInArrow(run, f"key {of_key}, item long, {_HIT}")


def _joined(rows: DataFrame, docs: DataFrame, window: int, cover: float, enough: int) -> DataFrame:
    """As _searched for docs (key, text) of unlike keys, with a benchmark of any size, reading the texts once.

    Windows of benchmark and documents meet by a shuffled hash join; a bit map of the benchmark's window hashes, of
    fixed size, keeps most of the documents' windows at home. The pairs (key, row) that meet are verified.
    """
    spark = docs.sparkSession
    of_key = docs.schema["key"].dataType.simpleString()

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "item_text"):
                own = []
                for row, data in zip(piece.column(0).to_pylist(), bytes_of(piece, "item_text"), strict=True):
                    index = Items([(0, data)], window)
                    own += [(row, n, h) for n, keys in index.owners.items() for h in keys]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in own], pa.int64()), pa.array([o[1] for o in own], pa.int32()), pa.array(np.array([o[2] for o in own], np.uint64).view(np.int64))], ["row", "n", "h"])

    theirs = cut(rows.select("row", "item_text").mapInArrow(of_items, "row long, n int, h long"))
    bits = bit_map(theirs, "h", FILTER_BITS)
    sizes = sorted(r.n for r in theirs.select("n").distinct().collect())  # 1 to window
    sent = spark.sparkContext.broadcast(bits)

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("decontamination", VOCABULARY.forget)
        known = sent.value
        for batch in batches:
            for piece in slices(batch):
                split = [t.split() for t in bytes_of(piece)]
                starts = np.cumsum([0, *map(len, split)])[:-1]
                at, hashes, _ = templated([w for words in split for w in words], starts)
                owner = np.searchsorted(starts, at, "right") - 1
                for n in sizes:
                    for h in hashes:
                        own = window_hashes(h, n)
                        hit = np.flatnonzero(in_map(known, own) & (owner[: len(own)] == owner[n - 1 : n - 1 + len(own)])) if len(own) else np.zeros(0, np.int64)
                        if len(hit):
                            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(owner[hit])), pa.array(np.full(len(hit), n, np.int32)), pa.array(own[hit].view(np.int64))], ["key", "n", "h"])

    met = docs.mapInArrow(of_docs, f"key {of_key}, n int, h long").distinct().join(theirs, ["n", "h"]).select("key", "row").distinct()
    both = cut(met).join(rows, "row").join(docs, "key").select("key", "text", "item", "item_text")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        claim("decontamination", VOCABULARY.forget)
        found = []
        for k, (data, own) in enumerate(zip(bytes_of(batch), bytes_of(batch, "item_text"), strict=True)):
            found += [(k, h) for h in matches(data, Items([(0, own)], window)) if counts(h, cover, enough)]
        at = pa.array([k for k, _ in found], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), *(pa.array([h[i + 1] for _, h in found], kind) for i, kind in enumerate(_HIT_KINDS))], ["key", "item", "first_token", "n_tokens", "share", "reparameterised"])

    return map_batches(both, verify, f"key {of_key}, item long, {_HIT}")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, cover: float = COVER, enough: int = ENOUGH, max_sent: int = MAX_SENT) -> DataFrame:
    """(id, item, first_token, n_tokens, share, reparameterised) for each document and benchmark row that shares enough.

    The benchmark's size is checked first: up to max_sent windows it goes to every executor and the documents are
    read once, without a shuffle; beyond, windows are joined by their hashes. Either way no row of the benchmark is
    lost: one without an id is reported with a null item, and rows of one id with unlike texts are searched each.
    Null and empty texts match nothing. Repeated rows of docs each give rows; repeated rows of the benchmark count
    once. No rows on either side give no rows. Other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = _rows_of(benchmark, item_col, item_text_col)
    if _bound(rows) <= max_sent:
        found = _searched(rows, docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), window, cover, enough)
        return found.withColumnsRenamed({"key": id_col, "item": item_col})
    keyed = docs.select(F.col(id_col).alias("id"), F.md5(text_col).alias("key"), F.col(text_col).alias("text")).where("key is not null")
    found = _joined(rows, keyed.select("key", "text").dropDuplicates(["key"]), window, cover, enough)
    return keyed.select("id", "key").join(found, "key").drop("key").withColumnsRenamed({"id": id_col, "item": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, cover: float = COVER, enough: int = ENOUGH, max_sent: int = MAX_SENT) -> DataFrame:
    """The rows of docs, all columns, that share too little with every benchmark row. Map-only for most benchmarks.

    Null and empty texts stay. Columns of docs may have any name but, for a benchmark beyond max_sent, _key.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = _rows_of(benchmark, item_col, item_text_col)
    if _bound(rows) > max_sent:
        texts = docs.select(F.md5(text_col).alias("key"), F.col(text_col).alias("text")).where("key is not null").dropDuplicates(["key"])
        gone = cut(_joined(rows, texts, window, cover, enough).select(F.col("key").alias("_key")).distinct())
        return docs.join(gone, F.md5(docs[text_col]) == gone["_key"], "left_anti")
    sent = spark.sparkContext.broadcast([(n, r.item_text.encode()) for n, r in enumerate(rows.collect())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(sent.value, window)
        for batch in batches:
            for piece in slices(batch, text_col):
                found = batch_matches(bytes_of(piece, text_col), index)
                yield piece.filter(pa.array([not any(counts(h, cover, enough) for h in found.get(k, ())) for k in range(piece.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
