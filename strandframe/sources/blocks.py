"""Block-compressed files: gzip members of at most 64 KiB whose headers tell their sizes, so that readers start at any.

Files are opened through pyarrow's file systems, by the driver to plan and by tasks to read their own part.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: what a member begins with, its extra field, and the empty member that ends a file.
MAGIC, EXTRA = b"\x1f\x8b\x08\x04", b"BC\x02\x00"
LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
HEAD, LEAST, MOST = 18, 28, 1 << 16
#: Bytes of content of a member that is written here; what cannot be compressed still fits in one.
CONTENT = 0xFF00


class BlockError(ValueError):
    """What is wrong with a block-compressed file or its index; the message begins with the rule that it breaks."""


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it; Spark's file: paths and plain ones are local."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def opened(path: str) -> pa.NativeFile:
    fs, at = located(path)
    return fs.open_input_file(at)


def size_of(path: str) -> int | None:
    """Bytes of a file; None if there is none."""
    fs, at = located(path)
    info = fs.get_file_info(at)
    return info.size if info.type == pafs.FileType.File else None


def files_of(path: str, endings: Sequence[str]) -> list[str]:
    """The files with these endings in a folder, sorted, without hidden ones; or the file itself."""
    fs, at = located(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    prefix = path.rstrip("/")
    inner = (f.path[len(at.rstrip("/")) :] for f in found if f.type == pafs.FileType.File and f.path.endswith(tuple(endings)))
    return sorted(prefix + p for p in inner if not re.search(r"/[._]", p))


def member_size(head: bytes, at: int, total: int) -> int:
    """Bytes of the member that a header of HEAD bytes begins."""
    if len(head) < HEAD or head[:4] != MAGIC:
        raise BlockError(f"BGZF_HEADER: no member at {at}")
    if struct.unpack_from("<H", head, 10)[0] < 6 or head[12:16] != EXTRA:
        raise BlockError(f"BGZF_EXTRA: no size field at {at}")
    size = struct.unpack_from("<H", head, 16)[0] + 1
    if not LEAST <= size <= MOST or at + size > total:
        raise BlockError(f"BGZF_BLOCK_SIZE: {size} bytes at {at}")
    return size


def inflate(member: bytes, at: int) -> bytes:
    """A member's content, its checksum and length held against it."""
    extra = struct.unpack_from("<H", member, 10)[0]
    try:
        data = zlib.decompress(member[12 + extra : -8], -15)
    except zlib.error as e:
        raise BlockError(f"BGZF_DATA: {e} at {at}") from e
    if struct.unpack("<II", member[-8:]) != (zlib.crc32(data), len(data)):
        raise BlockError(f"BGZF_CHECKSUM: content at {at} is not what was written")
    return data


def members(f: pa.NativeFile, at: int, total: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the members from an offset on, which must be a member's."""
    f.seek(at)
    ahead = b""
    while at < total:
        if len(ahead) < MOST:
            ahead += f.read(1 << 20)
        size = member_size(ahead[:HEAD], at, total)
        yield at, inflate(ahead[:size], at)
        at, ahead = at + size, ahead[size:]


def compressed(data: bytes, end: bool = True, offsets: list[int] | None = None, start: int = 0) -> bytes:
    """data as members, with the empty last one if asked; offsets gets each member's place."""
    out, at = [], start
    for i in range(0, len(data), CONTENT):
        part = data[i : i + CONTENT]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        if len(body) > MOST - HEAD - 8:
            packer = zlib.compressobj(0, zlib.DEFLATED, -15)
            body = packer.compress(part) + packer.flush()
        member = MAGIC + struct.pack("<IBBH", 0, 0, 255, 6) + EXTRA + struct.pack("<H", HEAD + len(body) + 7) + body + struct.pack("<II", zlib.crc32(part), len(part))
        if offsets is not None:
            offsets.append(at)
        out.append(member)
        at += len(member)
    return b"".join(out) + LAST * end


def checked_blocks(path: str) -> list[tuple[int, int]]:
    """(offset, bytes of content) of all members; the first rule that the file breaks is raised."""
    total = size_of(path)
    if total is None or total < len(LAST):
        raise BlockError("BGZF_SIZE: shorter than the last member")
    with opened(path) as f:
        f.seek(total - len(LAST))
        if f.read(len(LAST)) != LAST:
            raise BlockError("BGZF_EOF: the last member is not the empty one")
        return [(at, len(data)) for at, data in members(f, 0, total)]


def read_gzi(path: str, total: int) -> list[tuple[int, int]]:
    """(compressed, plain) offsets of the members after the first, from the index of a file of total bytes."""
    with opened(path) as f:
        raw = f.read()
    if len(raw) < 8 or len(raw) != 8 + 16 * struct.unpack_from("<Q", raw)[0]:
        raise BlockError(f"GZI_SIZE: {len(raw)} bytes")
    pairs = list(struct.iter_unpack("<QQ", raw[8:]))
    if any(b[0] <= a[0] or b[1] <= a[1] for a, b in zip([(-1, -1), *pairs], pairs, strict=False)):
        raise BlockError("GZI_ORDER: offsets do not rise")
    if pairs and pairs[-1][0] >= total:
        raise BlockError(f"GZI_RANGE: {pairs[-1][0]} is outside the file")
    return pairs


def gzi(blocks: Sequence[tuple[int, int]]) -> bytes:
    """The index of a file's members (offset, bytes of content), the empty last one left out."""
    pairs, plain = [], 0
    for (_, n), (at, own) in zip(blocks, blocks[1:], strict=False):
        plain += n
        if own:
            pairs.append((at, plain))
    return struct.pack("<Q", len(pairs)) + b"".join(struct.pack("<QQ", *p) for p in pairs)


def sync(f: pa.NativeFile, at: int, total: int) -> int:
    """The first member at or after an offset: one whose header and whose follower's header are right."""
    f.seek(at)
    window = f.read(3 * MOST)
    i = window.find(MAGIC)
    while i >= 0:
        try:
            after = at + i + (n := member_size(window[i : i + HEAD], at + i, total))
            if after == total or member_size(window[i + n : i + n + HEAD], after, total):
                return at + i
        except BlockError:
            pass
        i = window.find(MAGIC, i + 1)
    return total


def splits(path: str, split_bytes: int) -> list[tuple[int, int]]:
    """(from, to) compressed offsets of about split_bytes, both members', from path.gzi if it is there, else by sync."""
    total = size_of(path)
    if total is None:
        raise FileNotFoundError(path)
    wanted = range(split_bytes, total, split_bytes)
    with opened(path) as f:
        if size_of(path + ".gzi") is not None:
            known = [0, *(c for c, _ in read_gzi(path + ".gzi", total))]
            starts = {known[i] for i in (bisect_left(known, w) for w in wanted) if i < len(known)}
            for s in starts:
                f.seek(s)
                member_size(f.read(HEAD), s, total)
        else:
            starts = {sync(f, w, total) for w in wanted}
    ends = sorted({0, *starts, total})
    return list(zip(ends, ends[1:], strict=False))


def lines(blocks: Iterator[tuple[int, bytes]], first: bool, end: int) -> Iterator[bytes]:
    """The lines of a split: those that begin after its first newline (in the first split from the start), up to and
    with the one that begins at or reaches over the offset end."""
    held, skip = b"", not first
    for at, data in blocks:
        if at >= end:
            head, newline, _ = data.partition(b"\n")
            held += b"" if skip else head
            if newline:
                if not skip:
                    yield held
                return
            continue
        if skip:
            _, newline, data = data.partition(b"\n")
            skip = not newline
            if skip:
                continue
        *whole, held = (held + data).split(b"\n")
        yield from whole
    if held:
        yield held


def block_table(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, blocks, content, error): members and bytes of content of each file, or the rule that it breaks; a task a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    found = checked_blocks(path)
                    if size_of(path + ".gzi") is not None:
                        plain, starts = 0, {}
                        for at, n in found:
                            starts[at] = plain
                            plain += n
                        if wrong := [p for p in read_gzi(path + ".gzi", size_of(path) or 0) if starts.get(p[0]) != p[1]]:
                            raise BlockError(f"GZI_BLOCK: {wrong[0]} is no member's place")
                    rows.append((path, len(found), sum(n for _, n in found), None))
                except (BlockError, OSError) as e:
                    rows.append((path, None, None, str(e)))
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "blocks", "content", "error"), r, strict=True)) for r in rows], pa.schema([("path", pa.string()), ("blocks", pa.int64()), ("content", pa.int64()), ("error", pa.string())]))

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return listed.mapInArrow(run, "path string, blocks long, content long, error string")
