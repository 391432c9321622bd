"""Variant files, text or binary, block-compressed or not: splittable reads and indexed binary writes.

A data source plans its partitions on the driver, from block indexes where there are some, and tasks decode their own
part. Binary records do not tell where they begin, so a binary file is split at the record offsets of its index
(path.csi) and read by one task without it.
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from strandframe.sources import blocks

SCHEMA = "file string, at long, contig string, pos0 long, ref string, alts array<string>, filters array<string>, info map<string,string>, genotypes map<string,string>"
_ARROW = pa.schema([("file", pa.string()), ("at", pa.int64()), ("contig", pa.string()), ("pos0", pa.int64()), ("ref", pa.string()), ("alts", pa.list_(pa.string())), ("filters", pa.list_(pa.string())), ("info", pa.map_(pa.string(), pa.string())), ("genotypes", pa.map_(pa.string(), pa.string()))])
ENDINGS = (".vcf", ".vcf.gz", ".vcf.bgz", ".bcf")
#: Fixed values of the formats: magic words, missing and end marks of small whole numbers, sizes of typed values.
BINARY, INDEX = b"BCF\x02\x02", b"CSI\x01"
KINDS = {1: ("b", 1, -128), 2: ("h", 2, -32768), 3: ("i", 4, -2147483648)}
FLOAT, FLOAT_MISSING, FLOAT_END, CHAR = 5, 0x7F800001, 0x7F800002, 7
SHIFT, DEPTH = 14, 5
BATCH = 2048


@dataclass(frozen=True)
class Header:
    """Contig lengths and samples in order; by number, the contigs' and the filters', infos' and formats' names."""

    contigs: dict[str, int]
    samples: tuple[str, ...]
    contig_names: dict[int, str]
    names: dict[int, str]


def _declared(line: str) -> dict[str, str]:
    inner = re.fullmatch(r"##\w+=<(.+)>", line)
    pairs = re.split(r",(?=[A-Za-z][A-Za-z0-9_]*=)", inner[1]) if inner else []
    return {k: v.strip('"') for k, _, v in (p.partition("=") for p in pairs)}


def parse_header(lines: Sequence[str]) -> Header:
    """From the lines up to #CHROM: every contig must have a name of its own and a length, samples must differ."""
    contigs: dict[str, int] = {}
    contig_names: dict[int, str] = {}
    names, known = {0: "PASS"}, {"PASS"}
    for line in lines:
        if line.startswith("##contig="):
            d = _declared(line)
            if "ID" not in d or not re.fullmatch(r"\d+", d.get("length", "")):
                raise ValueError(f"a contig needs ID and length: {line}")
            if d["ID"] in contigs:
                raise ValueError(f"contig {d['ID']} is declared twice")
            contigs[d["ID"]] = int(d["length"])
            contig_names[int(d.get("IDX", len(contig_names)))] = d["ID"]
        elif re.match("##(FILTER|INFO|FORMAT)=<", line):
            d = _declared(line)
            if d["ID"] not in known:
                names[int(d.get("IDX", len(names)))] = d["ID"]
                known.add(d["ID"])
        elif line.startswith("#CHROM\t"):
            samples = tuple(line.split("\t")[9:])
            if len(set(samples)) < len(samples):
                raise ValueError("samples are named twice")
            return Header(contigs, samples, contig_names, names)
        elif not line.startswith("#") and line.strip():
            raise ValueError("records before #CHROM")
    raise ValueError("no #CHROM line")


def _kind(path: str) -> str:
    """binary, blocked, gzip or text, by what the file begins with."""
    with blocks.opened(path) as f:
        head = f.read(blocks.HEAD)
    if head[:4] == blocks.MAGIC and head[12:16] == blocks.EXTRA:
        with blocks.opened(path) as f:
            _, first = next(blocks.members(f, 0, blocks.size_of(path) or 0))
        return "binary" if first.startswith(BINARY[:3]) else "blocked"
    return "gzip" if head[:2] == b"\x1f\x8b" else "text"


def _plain(f: pa.NativeFile, at: int, total: int, size: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Text in pieces that end with a multiple of size, so that a split's end is a piece's end."""
    f.seek(at)
    while at < total:
        data = f.read(size - at % size)
        yield at, data
        at += len(data)


class Binary:
    """A binary file read from a virtual offset (place of a member, place in its content)."""

    def __init__(self, path: str, coffset: int = 0, uoffset: int = 0):
        self.total = blocks.size_of(path) or 0
        self.blocks = blocks.members(blocks.opened(path), coffset, self.total)
        self.at, self.data, self.i = coffset, b"", 0
        self._next()
        self.i = uoffset
        if uoffset > len(self.data):
            raise blocks.BlockError(f"CSI_OFFSET: {uoffset} is beyond the member at {coffset}")

    def _next(self) -> bool:
        found = next(self.blocks, None)
        if found is None:
            return False
        (self.at, self.data), self.i = found, 0
        return True

    def tell(self) -> tuple[int, int]:
        """Where the next byte is; at the end, past the last member."""
        while self.i == len(self.data):
            if not self._next():
                return self.total, 0
        return self.at, self.i

    def take(self, n: int) -> bytes:
        out = self.data[self.i : self.i + n]
        self.i += len(out)
        while len(out) < n:
            if not self._next():
                raise ValueError("the file ends within a record")
            more = self.data[: n - len(out)]
            self.i = len(more)
            out += more
        return out

    def header(self) -> Header:
        if self.take(5) != BINARY:
            raise ValueError("not a binary variant file of version 2.2")
        return parse_header(self.take(struct.unpack("<I", self.take(4))[0]).rstrip(b"\0").decode().split("\n"))


def header_of(path: str) -> Header:
    kind = _kind(path)
    if kind == "binary":
        return Binary(path).header()
    with blocks.opened(path) as f:
        raw = gzip.open(f) if kind == "gzip" else f
        total = blocks.size_of(path) or 0
        source = blocks.members(f, 0, total) if kind == "blocked" else iter(lambda: (0, raw.read(1 << 16)), (0, b""))
        lines: list[str] = []
        for line in blocks.lines(source, True, 1 << 62):
            lines.append(line.decode().rstrip("\r"))
            if line.startswith(b"#CHROM\t") or not line.startswith(b"#") and line.strip():
                break
        return parse_header(lines)


def _typed(data: bytes, i: int) -> tuple[int, int, int]:
    """(kind, number of values, place of the first) of a typed value."""
    kind, n = data[i] & 15, data[i] >> 4
    i += 1
    if n == 15:
        n, i = _whole(data, i)
    return kind, n, i


def _whole(data: bytes, i: int) -> tuple[int, int]:
    """(a typed whole number, the place after it)."""
    kind = data[i] & 15
    if kind not in KINDS or data[i] >> 4 != 1:
        raise ValueError("a whole number was expected")
    code, size, _ = KINDS[kind]
    return struct.unpack_from(f"<{code}", data, i + 1)[0], i + 1 + size


def _value(data: bytes, i: int) -> tuple[str, int]:
    """(text of a typed value, the place after it): values comma-joined, missing ones '.', a flag 'true'."""
    kind, n, i = _typed(data, i)
    if kind == CHAR:
        return data[i : i + n].rstrip(b"\0").decode(), i + n
    if kind == 0 or not n:
        return "true", i
    if kind == FLOAT:
        bits = struct.unpack_from(f"<{n}I", data, i)
        given = [("." if b == FLOAT_MISSING else f"{struct.unpack('<f', struct.pack('<I', b))[0]:g}") for b in bits if b != FLOAT_END]
        return ",".join(given), i + 4 * n
    code, size, missing = KINDS[kind]
    values = struct.unpack_from(f"<{n}{code}", data, i)
    return ",".join("." if v == missing else str(v) for v in values if v != missing + 1), i + size * n


def _genotype(values: Sequence[int], missing: int) -> str:
    """Alleles as (allele + 1) << 1 | phased; 0 and the missing mark are no call."""
    out = ""
    for k, v in enumerate(v for v in values if v != missing + 1):
        allele = "." if v == missing or v >> 1 == 0 else str((v >> 1) - 1)
        out += allele if not k else ("|" if v & 1 and v != missing else "/") + allele
    return out or "."


def decode(shared: bytes, indiv: bytes, header: Header, wanted: Sequence[int]) -> dict:
    """A binary record as a row; wanted are the numbers of the samples whose genotypes are read."""
    contig, pos, length, _, counts, sizes = struct.unpack_from("<iiifII", shared)
    n_info, n_allele, n_fmt, n_sample = counts & 0xFFFF, counts >> 16, sizes >> 24, sizes & 0xFFFFFF
    if contig not in header.contig_names or n_sample != len(header.samples) or pos < 0:
        raise ValueError(f"a record's contig, position or samples are not the header's: {contig}:{pos}, {n_sample} samples")
    _, i = _value(shared, 24)
    alleles = []
    for _ in range(n_allele):
        a, i = _value(shared, i)
        alleles.append(a)
    kind, n, i = _typed(shared, i)
    filters: list[str] = []
    if n:
        code, size, missing = KINDS[kind]
        filters = [header.names[v] for v in struct.unpack_from(f"<{n}{code}", shared, i) if v != missing]
        i += n * size
    info = {}
    for _ in range(n_info):
        key, i = _whole(shared, i)
        info[header.names[key]], i = _value(shared, i)
    symbolic = any(a.startswith("<") for a in alleles[1:])
    if symbolic and length > len(alleles[0]):
        info.setdefault("END", str(pos + length))
    calls, i, found = {}, 0, not header.samples
    for _ in range(n_fmt):
        key, i = _whole(indiv, i)
        kind, n, i = _typed(indiv, i)
        code, size, missing = KINDS.get(kind, ("x", 4 if kind == FLOAT else 1, 0))
        if header.names[key] == "GT":
            found = True
            calls = {header.samples[s]: _genotype(struct.unpack_from(f"<{n}{code}", indiv, i + s * n * size), missing) for s in wanted}
        i += n * size * n_sample
    if not found:
        raise ValueError(f"a record has no GT: {header.contig_names[contig]}:{pos + 1}")
    return {"contig": header.contig_names[contig], "pos0": pos, "ref": alleles[0], "alts": [a for a in alleles[1:] if a not in (".", "")], "filters": [x for x in filters if x not in ("PASS", ".")], "info": info, "genotypes": calls}


def parse_line(line: str, header: Header, wanted: Sequence[int]) -> dict:
    """A text record as a row."""
    f = line.split("\t")
    if len(f) < 8:
        raise ValueError(f"fewer than eight fields: {line[:80]}")
    if not re.fullmatch(r"[1-9]\d*", f[1]):
        raise ValueError(f"bad position: {line[:80]}")
    calls = {}
    if header.samples:
        if len(f) != 9 + len(header.samples):
            raise ValueError(f"{len(f) - 9} samples, not {len(header.samples)}: {line[:80]}")
        keys = f[8].split(":")
        if "GT" not in keys:
            raise ValueError(f"a record has no GT: {line[:80]}")
        at = keys.index("GT")
        for s in wanted:
            parts = f[9 + s].split(":")
            call = parts[at] if at < len(parts) and parts[at] else "."
            if not re.fullmatch(r"(\d+|\.)([/|](\d+|\.))*", call):
                raise ValueError(f"malformed GT {call!r}")
            calls[header.samples[s]] = call
    info = {} if f[7] in ("", ".") else {k: v if eq else "true" for k, eq, v in (x.partition("=") for x in f[7].split(";"))}
    return {"contig": f[0], "pos0": int(f[1]) - 1, "ref": f[3], "alts": [] if f[4] in ("", ".") else f[4].split(","), "filters": [] if f[6] in ("", ".", "PASS") else f[6].split(";"), "info": info, "genotypes": calls}


def read_csi(path: str, total: int) -> list[tuple[int, int]]:
    """The virtual offsets at which the index's chunks begin, rising, of a file of total bytes; broken ones are errors."""
    size = blocks.size_of(path) or 0
    with blocks.opened(path) as f:
        raw = b"".join(data for _, data in blocks.members(f, 0, size))
    try:
        if raw[:4] != INDEX:
            raise blocks.BlockError("CSI_MAGIC: not such an index")
        aux = struct.unpack_from("<iii", raw, 4)[2]
        refs, i = struct.unpack_from("<i", raw, 16 + aux)[0], 20 + aux
        starts = set()
        for _ in range(refs):
            bins = struct.unpack_from("<i", raw, i)[0]
            i += 4
            for _ in range(bins):
                _, _, chunks = struct.unpack_from("<IQi", raw, i)
                i += 16
                for begin, end in struct.iter_unpack("<QQ", raw[i : i + 16 * chunks]):
                    if begin >= end or begin >> 16 >= total:
                        raise blocks.BlockError(f"CSI_RANGE: {begin >> 16} to {end >> 16} in {total} bytes")
                    starts.add(begin)
                i += 16 * chunks
    except struct.error as e:
        raise blocks.BlockError(f"CSI_SIZE: {e}") from e
    if i not in (len(raw), len(raw) - 8):
        raise blocks.BlockError(f"CSI_SIZE: {len(raw)} bytes, {i} read")
    return [(s >> 16, s & 0xFFFF) for s in sorted(starts)]


@dataclass(frozen=True)
class Part(InputPartition):
    path: str
    kind: str
    start: tuple[int, int]
    end: tuple[int, int]


class VariantSource(DataSource):
    """format("variants"): options path, samples (a JSON list, else all), split_bytes, and for writes header (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "variants"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return VariantReader(self.options["path"], json.loads(self.options.get("samples", "null")), int(self.options.get("split_bytes", 32 << 20)))

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return VariantWriter(self.options["path"], self.options["header"])


class VariantReader(DataSourceReader):
    def __init__(self, path: str, samples: list[str] | None, split_bytes: int):
        self.files, self.samples, self.split_bytes = blocks.files_of(path, ENDINGS), samples, split_bytes
        if not self.files:
            raise FileNotFoundError(f"no variant files in {path}")
        self.first = header_of(self.files[0])
        if lost := set(samples or ()) - set(self.first.samples):
            raise ValueError(f"no samples {sorted(lost)}")

    def partitions(self) -> Sequence[Part]:
        out: list[Part] = []
        for path in self.files:
            kind, total = _kind(path), blocks.size_of(path) or 0
            if kind == "blocked":
                out += [Part(path, kind, (a, 0), (b, 0)) for a, b in blocks.splits(path, self.split_bytes)]
            elif kind == "text":
                step = max(1 << 20, self.split_bytes >> 20 << 20) if self.split_bytes >= 1 << 20 else self.split_bytes
                out += [Part(path, kind, (a, 0), (min(total, a + step), 0)) for a in range(0, total, step)]
            elif kind == "gzip":
                out.append(Part(path, kind, (0, 0), (total, 0)))
            else:
                own = Binary(path)
                own.header()
                first, ends = own.tell(), []
                if blocks.size_of(path + ".csi") is not None:
                    last = first[0]
                    for at in read_csi(path + ".csi", total):
                        if at > first and at[0] - last >= self.split_bytes:
                            ends.append(at)
                            last = at[0]
                ends = [first, *ends, (total, 0)]
                out += [Part(path, kind, a, b) for a, b in zip(ends, ends[1:], strict=False)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        header = header_of(part.path)
        if header.samples != self.first.samples or header.contigs != self.first.contigs:
            raise ValueError(f"{part.path} has another header than {self.files[0]}")
        wanted = [i for i, s in enumerate(header.samples) if self.samples is None or s in self.samples]
        held: list[dict] = []
        for n, row in enumerate(self._rows(part, header, wanted)):
            held.append(row | {"file": part.path, "at": (part.start[0] << 16) + part.start[1] + n})
            if len(held) == BATCH:
                yield pa.RecordBatch.from_pylist(held, _ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)

    def _rows(self, part: Part, header: Header, wanted: Sequence[int]) -> Iterator[dict]:
        if part.kind == "binary":
            own = Binary(part.path, *part.start)
            while (at := own.tell()) < part.end:
                shared, indiv = struct.unpack("<II", own.take(8))
                yield decode(own.take(shared), own.take(indiv), header, wanted)
            if at != part.end:
                raise blocks.BlockError(f"CSI_RECORD: {part.end} is inside a record of {part.path}")
            return
        total = blocks.size_of(part.path) or 0
        with blocks.opened(part.path) as f:
            if part.kind == "gzip":
                raw = gzip.open(f)
                source = iter(lambda: (0, raw.read(1 << 20)), (0, b""))
            else:
                source = blocks.members(f, part.start[0], total) if part.kind == "blocked" else _plain(f, part.start[0], total, min(1 << 20, self.split_bytes))
            for line in blocks.lines(source, part.start[0] == 0, part.end[0]):
                text = line.decode().rstrip("\r")
                if text and not text.startswith("#"):
                    yield parse_line(text, header, wanted)


def read_variants(spark: SparkSession, path: str, samples: Sequence[str] | None = None, split_bytes: int = 32 << 20) -> DataFrame:
    """(file, at, contig, pos0, ref, alts, filters, info, genotypes) of the variant files at a path, all or asked samples.

    Rows of a file rise with `at` in the file's order. Text, gzip, block-compressed text (split by path.gzi, else at
    members that are found) and binary files (split by path.csi) give the same rows. A broken index, header or record is
    an error; PASS and missing filters are none, a symbolic allele's length becomes END.
    """
    spark.dataSource.register(VariantSource)
    r = spark.read.format("variants").option("path", path).option("split_bytes", split_bytes)
    return (r if samples is None else r.option("samples", json.dumps(list(samples)))).load()


def _pack(values: Sequence[int]) -> bytes:
    """Whole numbers as a typed vector of the smallest kind."""
    kind = next(k for k, (_, size, missing) in KINDS.items() if all(missing + 8 <= v < -missing for v in values))
    return _head(kind, len(values)) + struct.pack(f"<{len(values)}{KINDS[kind][0]}", *values)


def _head(kind: int, n: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([0xF0 | kind]) + _pack([n])


def _text(x: str) -> bytes:
    return _head(CHAR, len(x.encode())) + x.encode()


def encode(row: dict, contig: int, number: dict[str, int], samples: Sequence[str]) -> bytes:
    """A row as a binary record; infos are texts but END, genotypes the only format. number: of filters and infos."""
    alleles = [row["ref"], *row["alts"]]
    info = dict(row["info"] or ())
    length = int(info["END"]) - row["pos0"] if "END" in info else len(row["ref"])
    calls = dict(row["genotypes"] or ())
    filters = [number[x] for x in row["filters"]] or [0]
    shared = struct.pack("<iiiIII", contig, row["pos0"], length, FLOAT_MISSING, len(alleles) << 16 | len(info), bool(samples) << 24 | len(samples))
    shared += _head(CHAR, 0) + b"".join(_text(a) for a in alleles) + _pack(filters)
    for k, v in sorted(info.items()):
        shared += _pack([number[k]]) + (_pack([int(v)]) if k == "END" else _text(v))
    indiv = b""
    if samples:
        split = [re.findall(r"([/|]?)(\d+|\.)", calls.get(s) or ".") for s in samples]
        most = max(map(len, split))
        rows = [[(0 if a == "." else int(a) + 1) << 1 | (sep == "|") for sep, a in c] for c in split]
        kind = 1 if max(max(r) for r in rows) < 120 else 2
        code, _, missing = KINDS[kind]
        indiv = _pack([number["GT"]]) + _head(kind, most) + b"".join(struct.pack(f"<{most}{code}", *r, *[missing + 1] * (most - len(r))) for r in rows)
    return struct.pack("<II", len(shared), len(indiv)) + shared + indiv


def bin_of(begin: int, end: int) -> int:
    """The smallest bin of the index that holds an interval."""
    level, shift, first = DEPTH, SHIFT, ((1 << 3 * DEPTH) - 1) // 7
    while level and begin >> shift != (end - 1) >> shift:
        level, shift = level - 1, shift + 3
        first -= 1 << 3 * level
    return first + (begin >> shift) if level else 0


def header_text(contigs: dict[str, int], samples: Sequence[str], filters: Sequence[str], infos: Sequence[str]) -> str:
    out = ["##fileformat=VCFv4.3", '##FILTER=<ID=PASS,Description="All filters passed">']
    out += [f'##FILTER=<ID={x},Description="{x}">' for x in filters]
    out += [f'##INFO=<ID={x},Number=1,Type={"Integer" if x == "END" else "String"},Description="{x}">' for x in infos]
    out += ['##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', *(f"##contig=<ID={c},length={n}>" for c, n in contigs.items())]
    return "\n".join([*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])])]) + "\n"


def binary_file(text: str, rows: Iterator[dict]) -> tuple[bytes, bytes]:
    """(file, index) of rows sorted by the header's contigs and position, built in memory."""
    header = parse_header(text.split("\n"))
    order, number = {c: i for i, c in header.contig_names.items()}, {v: k for k, v in header.names.items()}
    plain = bytearray(BINARY + struct.pack("<I", len(text) + 1) + text.encode() + b"\0")
    spans: dict[int, list[tuple[int, int, int]]] = {}
    last = (-1, -1)
    for row in rows:
        key = (order[row["contig"]], row["pos0"])
        if key < last:
            raise ValueError(f"rows are not sorted at {row['contig']}:{row['pos0']}")
        last, begin = key, len(plain)
        plain += encode(row, key[0], number, header.samples)
        end = int(dict(row["info"] or ()).get("END", row["pos0"] + len(row["ref"])))
        spans.setdefault(key[0], []).append((bin_of(row["pos0"], max(end, row["pos0"] + 1)), begin, len(plain)))
    offsets: list[int] = []
    data = blocks.compressed(bytes(plain), True, offsets)
    virtual = lambda p: offsets[p // blocks.CONTENT] << 16 | p % blocks.CONTENT if p < len(plain) else len(data) - len(blocks.LAST) << 16
    index = INDEX + struct.pack("<iiii", SHIFT, DEPTH, 0, len(order))
    for ref in range(len(order)):
        chunks: dict[int, list[list[int]]] = {}
        for b, begin, end in spans.get(ref, []):
            own = chunks.setdefault(b, [])
            if own and own[-1][1] == begin and begin // blocks.CONTENT == own[-1][0] // blocks.CONTENT:
                own[-1][1] = end
            else:
                own.append([begin, end])
        index += struct.pack("<i", len(chunks))
        for b, own in sorted(chunks.items()):
            index += struct.pack("<IQi", b, virtual(own[0][0]), len(own)) + b"".join(struct.pack("<QQ", virtual(x), virtual(y)) for x, y in own)
    return data, blocks.compressed(index + struct.pack("<Q", 0))


class VariantWriter(DataSourceWriter):
    """Each task writes a binary file and its index under hidden names; the commit gives them their own."""

    def __init__(self, path: str, header: str):
        self.path, self.header, self.run = path, header, uuid.uuid4().hex
        fs, at = blocks.located(path)
        fs.create_dir(at)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        name = uuid.uuid4().hex
        fs, at = blocks.located(self.path)
        files = binary_file(self.header, (r.asDict() for r in rows))
        for ending, data in zip((".bcf", ".bcf.csi"), files, strict=True):
            with fs.open_output_stream(f"{at}/.{self.run}-{name}{ending}") as f:
                f.write(data)
        return Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = blocks.located(self.path)
        for name in (m.name for m in messages if m is not None):
            for ending in (".bcf.csi", ".bcf"):  # a file is never there without its index
                fs.move(f"{at}/.{self.run}-{name}{ending}", f"{at}/part-{name}{ending}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = blocks.located(self.path)
        for name in (m.name for m in messages if m is not None):
            for ending in (".bcf", ".bcf.csi"):
                fs.delete_file(f"{at}/.{self.run}-{name}{ending}")


@dataclass
class Written(WriterCommitMessage):
    name: str


def write_variants(rows: DataFrame, path: str, contigs: dict[str, int], samples: Sequence[str] = (), filters: Sequence[str] = (), infos: Sequence[str] = ("END",), ranges: int | None = None) -> None:
    """Rows (contig, pos0, ref, alts, filters, info, genotypes) as indexed binary files, ranges of (contig, pos0) each.

    A range is built in memory by its task: take as many ranges (default: the session's shuffle partitions) as that needs.
    """
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.sparkSession.dataSource.register(VariantSource)
    order = F.array_position(F.array(*[F.lit(c) for c in contigs]), F.col("contig"))
    wanted = ["contig", "pos0", "ref", "alts", "filters", "info", "genotypes"]
    by = rows.select(*wanted).withColumn("_o", order).repartitionByRange(ranges, "_o", "pos0").sortWithinPartitions("_o", "pos0").drop("_o")
    by.write.format("variants").option("path", path).option("header", header_text(contigs, samples, filters, infos)).mode("append").save()


def refused_variants(rows: DataFrame, keys: Sequence[str] = ("contig", "pos0", "ref", "alts")) -> DataFrame:
    """rows, or an error when read that names a variant which is there twice."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rows.columns if c not in keys])
    bad = F.raise_error(F.concat(F.lit("variant twice: "), F.concat_ws(" ", *[F.col(k).cast("string") for k in keys])))
    return n.withColumn(keys[0], F.when(F.col("_n") == 1, F.col(keys[0])).otherwise(bad)).select(rows.columns)
