"""Suffix-array dedup with deep-shallow sorting (operator 4).

Every byte covered by a string of `length` bytes that also starts elsewhere is removed. Suffixes that share so long a
prefix share the smallest hash among the prefix's `GRAM`-byte grams, so each run of window starts with one smallest
gram is a segment, and segments meet by that gram's hash. Most need no text: a gram that occurs once has no repeat,
and where all segments of a gram are alike all their windows repeat. The segments of the other grams are dealt out
with their bytes, by the gram and half of what surrounds it (which splits grams that very many texts share), and
their suffixes are sorted: multikey quicksort on eight-byte symbols to a shallow depth, blind tries for what still
ties there. Equal neighbours in that order are the repeated windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm._common import bytes_of, shared_folder, ship, slices
from strandframe.operators._folders import let_go

LENGTH, GRAM, SHALLOW = 200, 80, 32
BLOCK, SOLVE_BYTES, SMALL = 1 << 17, 4 << 20, 256
#: A segment's shape is one number: where its gram begins, times this, plus its window starts.
_SHAPE = 1 << 15
_POSITION = np.uint64((1 << 23) - 1)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of `size` bytes, by doubling."""
    value = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(32)
    power, width, out, done = np.uint64(0xD6E8FEB86659FD93), 1, None, 0
    n = len(data) - size + 1
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                part = value[done : done + n]
                out = part.copy() if out is None else out * power + part
                done += width
            if width * 2 > size:
                break
            value = value[: len(value) - width] * power + value[width:]
            power, width = power * power, width * 2
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    width, low = 1, values
    while width * 2 <= size:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    n = len(values) - size + 1
    return np.minimum(low[:n], low[size - width : size - width + n]) if width < size else low[:n]


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first start, number of starts, where the gram begins after the first start, gram hash) of all segments.

    Windows never cross texts. Texts stand one after the other and are hashed in blocks, so memory is bounded for
    texts of any size; a segment may be cut at a block's edge.
    """
    ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    found: list[list[np.ndarray]] = []
    for at in range(0, max(0, len(flat) - length + 1), BLOCK):
        block = flat[at : at + BLOCK + length - 1]
        hashes = gram_hashes(block, gram)
        packed = hashes & ~_POSITION | np.arange(len(hashes), dtype=np.uint64)
        least = (sliding_min(packed, length - gram + 1) & _POSITION).astype(np.int64)
        starts = np.arange(at, at + len(least))
        one, two = np.searchsorted(ends, [at, at + len(least) - 1], "right")
        owner = np.repeat(np.arange(one, two + 1), np.diff(np.concatenate([[at], np.minimum(ends[one : two + 1], at + len(least))])))
        inside = starts + length <= ends[owner]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new & inside)
        last = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
        base = np.concatenate([[0], ends])[owner[first]]
        found.append([owner[first], starts[first] - base, last - first + 1, least[first] - first, hashes[least[first]]])
    if not found:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def multikey(symbols: np.ndarray) -> list[np.ndarray]:
    """Positions of rows that tie in all columns, as groups of two or more, by multikey quicksort column by column.

    Rows split three ways around a pivot of the current column; those equal to it go on with the next column. Few
    rows are ordered at once.
    """
    todo, out = [(np.arange(len(symbols)), 0)], []
    while todo:
        at, depth = todo.pop()
        if len(at) < 2:
            continue
        if depth == symbols.shape[1]:
            out.append(at)
        elif len(at) <= SMALL:
            rest = symbols[at, depth:]
            at = at[np.lexsort(rest.T[::-1])]
            rest = symbols[at, depth:]
            edges = np.flatnonzero((rest[1:] != rest[:-1]).any(1)) + 1
            out += [g for g in np.split(at, edges) if len(g) > 1]
        else:
            column = symbols[at, depth]
            pivot = np.sort(column[:: max(1, len(column) // 31)])[len(column[:: max(1, len(column) // 31)]) // 2]
            todo += [(at[column < pivot], depth), (at[column > pivot], depth), (at[column == pivot], depth + 1)]
    return out


class BlindTrie:
    """Strings of one length; inner nodes know only the depth at which children differ and their next byte."""

    def __init__(self, size: int):
        self.size, self.root = size, None

    def add(self, text: bytes, name: int) -> None:
        if self.root is None:
            self.root = (self.size, text, [name])
            return
        node = self.root
        while node[0] < self.size:  # down blindly: any leaf below shares the most with the text, or as much
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = node[1]
        unlike = int.from_bytes(text, "big") ^ int.from_bytes(other, "big")
        if not unlike:
            node[2].append(name)
            return
        shared = self.size - (unlike.bit_length() + 7) // 8
        above, node = None, self.root
        while node[0] < shared:
            above, node = node, node[1][text[node[0]]]
        leaf = (self.size, text, [name])
        if node[0] == shared:
            node[1][text[shared]] = leaf
            return
        new = (shared, {text[shared]: leaf, other[shared]: node})
        if above is None:
            self.root = new
        else:
            above[1][text[above[0]]] = new

    def leaves(self) -> Iterator[list[int]]:
        """Names in the order of their strings, alike ones together."""
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[0] == self.size:
                yield node[2]
            else:
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]


def repeated(pieces: list[tuple[int, bytes]], length: int = LENGTH) -> list[np.ndarray]:
    """For each (group, bytes): which of its windows occur in another piece of the group, by deep-shallow sorting."""
    data = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
    sizes = np.array([len(p) for _, p in pieces])
    counts = sizes - length + 1
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(pieces)), counts)
    first = np.cumsum(counts) - counts
    starts = np.arange(counts.sum()) - first[owner] + base[owner]
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    symbols = np.empty((len(starts), 1 + SHALLOW // 8), np.uint64)
    symbols[:, 0] = np.array([g for g, _ in pieces], np.uint64)[owner]
    for i in range(SHALLOW // 8):
        symbols[:, 1 + i] = np.ascontiguousarray(words[starts + 8 * i]).view(">u8").reshape(-1)
    hit = np.zeros(len(starts), bool)
    view = memoryview(data)
    for tied in multikey(symbols):
        trie = BlindTrie(length - SHALLOW)
        for i in tied.tolist():
            at = int(starts[i])
            trie.add(bytes(view[at + SHALLOW : at + length]), i)
        for names in trie.leaves():
            if len(names) > 1:
                hit[names] = True
    return np.split(hit, first[1:])


def _solve(groups: list[tuple[int, dict[bytes, list[tuple[int, int]]]]], length: int) -> tuple[list[int], list[int], list[int]]:
    """(row, start, end) of the repeated bytes of segments, given by group and bytes with their places."""
    pieces, places = [], []
    for g, (_, own) in enumerate(groups):
        for piece, where in own.items():
            pieces.append((g, piece))
            places.append(where)
    rows, starts, ends = [], [], []
    for (_, piece), where, hit in zip(pieces, places, repeated(pieces, length), strict=True):
        if len(where) > 1:
            runs = [(0, len(piece) - length + 1)]
        elif hit.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            runs = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        else:
            continue
        for row, start in where:
            for a, b in runs:
                rows.append(row)
                starts.append(start + a)
                ends.append(start + b - 1 + length)
    return rows, starts, ends


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


_SPANS = "array<struct<start:int,end:int>>"
_PA_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_NEEDS = "array<struct<gram:long,start:int,shape:int>>"
_PA_NEEDS = pa.list_(pa.struct([("gram", pa.int64()), ("start", pa.int32()), ("shape", pa.int32())]))


def _marks(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, spans, needs) by row: bytes known to repeat, and segments whose bytes must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data = bytes_of(part)
                text, start, n, off, hashes = segments(data, length, gram)
                digests = np.fromiter((xxhash.xxh3_64_intdigest(data[t][a : a + k]) for t, a, k in zip(text.tolist(), start.tolist(), (n + length - 1).tolist(), strict=True)), np.uint64, len(text))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(hashes.view(np.int64)), pa.array(digests.view(np.int64)), pa.array(start.astype(np.int32)), pa.array((off * _SHAPE + n).astype(np.int32))], ["row", "gram", "digest", "start", "shape"])

    found = texts.select("row", "text").mapInArrow(run, "row long, gram long, digest long, start int, shape int")
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b")).where("n > 1").select("gram", (F.col("a") == F.col("b")).alias("alike"))
    met = found.select("row", "gram", "start", "shape").join(grams, "gram")
    span = F.when(F.col("alike"), F.struct("start", (F.col("start") + F.col("shape") % _SHAPE + (length - 1)).cast("int").alias("end")))
    need = F.when(~F.col("alike"), F.struct("gram", "start", "shape"))
    return met.groupBy("row").agg(F.collect_list(span).alias("spans"), F.collect_list(need).alias("needs"))


def _compared(pending: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, spans) from the segments whose bytes must be compared."""
    half = (length - gram) // 2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, rows, starts, data = [], [], [], []
                for row, text, needs in zip(part.column(0).to_pylist(), bytes_of(part), part.column(2).to_pylist(), strict=True):
                    for need in needs:
                        off, n = divmod(need["shape"], _SHAPE)
                        a = need["start"]
                        g = a + off
                        # windows with at most half of what surrounds the gram before it share what follows, else what precedes
                        middle = min(max(a, g - half), a + n)
                        if middle < a + n:
                            keys.append(xxhash.xxh3_64_intdigest(text[g : g + gram + half], 1))
                            rows.append(row)
                            starts.append(middle)
                            data.append(text[middle : a + n - 1 + length])
                        if a < middle:
                            keys.append(xxhash.xxh3_64_intdigest(text[g - half : g + gram], 2))
                            rows.append(row)
                            starts.append(a)
                            data.append(text[a : middle - 1 + length])
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(rows, pa.int64()), pa.array(starts, pa.int32()), pa.array(data, pa.binary())], ["key", "row", "start", "data"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple[int, dict[bytes, list[tuple[int, int]]]]] = []
        held, last = 0, None

        def flush(keep: bool) -> Iterator[pa.RecordBatch]:
            nonlocal groups, held
            now, groups = (groups[:-1], groups[-1:]) if keep else (groups, [])
            held = sum(map(len, groups[0][1])) if groups else 0
            now = [g for g in now if len(g[1]) > 1 or any(len(w) > 1 for w in g[1].values())]
            if now:
                rows, starts, ends = _solve(now, length)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["row", "start", "end"])

        for batch in batches:
            for key, row, start, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != last:
                    if held > SOLVE_BYTES:
                        yield from flush(False)
                    groups.append((key, {}))
                    last = key
                own = groups[-1][1]
                if data not in own:
                    own[data] = []
                    held += len(data)
                own[data].append((row, start))
        yield from flush(False)

    dealt = pending.select("row", "text", "needs").mapInArrow(deal, "key long, row long, start int, data binary")
    found = dealt.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(sort, "row long, start int, end int")
    return found.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("more"))


def _stored(df: DataFrame) -> DataFrame:
    """The rows, in a compressed table of the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/marked-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, kept binary, spans, n_bytes) for every row: the bytes left, and the removed spans of the original.

    Null counts as empty. Rows that repeat an id and a text are documents of their own, so all their windows repeat.
    Rows are told apart by a hash of id and text together with the id. Texts cross the network once, those with
    segments to compare twice; tables in the shared folder lie between. length is gram bytes at least, and less than
    32,768 more.
    """
    if not 0 <= length - gram < _SHAPE - 1:
        raise ValueError(f"a length of {length} with grams of {gram} bytes")
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("row", F.xxhash64("id", "text"))
    marks = _stored(_marks(texts, length, gram))
    let_go(spark)  # the shuffle files of each step go before the next makes its own
    marked = _stored(texts.join(marks, "row", "left"))
    let_go(spark)
    pending = marked.where(F.size("needs") > 0)
    more = _compared(pending, length, gram)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                kept, spans, sizes = [], [], []
                known, extra = part.column(2).to_pylist(), part.column(3).to_pylist()
                for text, a, b in zip(bytes_of(part), known, extra, strict=True):
                    own = union([(s["start"], s["end"]) for s in [*(a or []), *(b or [])]])
                    kept.append(cut_out(text, own))
                    spans.append([{"start": x, "end": y} for x, y in own])
                    sizes.append(len(text))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), pa.array(spans, _PA_SPANS), pa.array(sizes, pa.int64())], ["id", "kept", "spans", "n_bytes"])

    of_id = texts.schema["id"].dataType.simpleString()
    sure = marked.where("needs is null or size(needs) = 0").select("id", "text", "spans", F.lit(None).cast(_SPANS).alias("more"))
    open_ = pending.select("row", "id", "text", "spans").join(more, "row", "left").select("id", "text", "spans", "more")
    return sure.unionByName(open_).mapInArrow(finish, f"id {of_id}, kept binary, spans {_SPANS}, n_bytes long").withColumnRenamed("id", id_col)


def digest(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return done.select(id_col, "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
