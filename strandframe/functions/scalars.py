"""Column expressions: lenient and strict coercions, multi-value cells, classifications, closed forms of cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = ("", "NA", "NaN", "nan")


def finite(c: Column) -> Column:
    """A finite double; null for missing marks, text that is no number, and infinities."""
    text = F.trim(c.cast("string"))
    v = F.when(text.isin(*MISSING), F.lit(None).cast("double")).otherwise(text.try_cast("double"))
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def integer(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("bigint")


def number_or_zero(c: Column) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def truth(c: Column, default: bool = False) -> Column:
    """Yes for the usual words for yes; the default for a missing or empty cell."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(text.isin("1", "true", "t", "yes", "y", "pass"))


def qualifies(columns: dict[str, Column]) -> Column:
    """A sample passes quality control, is unrelated, and carries none of the four marks against it."""
    return truth(columns["qc_pass"]) & truth(columns["unrelated"]) & ~truth(columns["cross_or_progeny"]) & ~truth(columns["duplicate_or_related"]) & ~truth(columns["laboratory_control"]) & ~truth(columns["contaminated"])


def multi(c: Column, pattern: str = r"[;,|]") -> Column:
    """The non-blank parts of a cell, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != "")


def multi_count(c: Column, sep: str = ";") -> Column:
    return F.size(multi(c, sep))


def multi_sum(c: Column, sep: str = ";") -> Column:
    return F.aggregate(multi(c, sep), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def sorted_unique(c: Column, sep: str = ";") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(multi(c, sep))), sep)


def linked(ids: Column, accessions: Column) -> Column:
    """Pairs of ids and accessions if there are as many of each, else null."""
    return F.when(F.size(ids) == F.size(accessions), F.arrays_zip(ids.alias("id"), accessions.alias("accession")))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def safe_component(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def https(c: Column) -> Column:
    return F.regexp_replace(c, "^(ftp|http|rsync)://", "https://")


def attributes(c: Column) -> Column:
    """Map of 'k=v;' or 'k "v";' attributes, percent-decoded (a + stays); a part that is neither is an error."""
    parts = F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda p: p != "")
    key = lambda p: F.when(p.contains("="), F.substring_index(p, "=", 1)).otherwise(F.substring_index(p, " ", 1))
    value = lambda p: F.when(p.contains("="), F.url_decode(F.replace(F.substring(p, F.locate("=", p) + 1, F.length(p)), F.lit("+"), F.lit("%2B")))).otherwise(F.regexp_extract(p, r'"([^"]*)"', 1))
    bad = F.exists(parts, lambda p: ~p.contains("=") & ~p.rlike(r'^\S+ "[^"]*"$'))
    return F.when(bad, F.raise_error(F.concat(F.lit("bad attributes: "), c))).otherwise(F.map_from_entries(F.transform(parts, lambda p: F.struct(key(p), value(p)))))


def compression(head: Column) -> Column:
    """Kind of a file by its first bytes (binary)."""
    lead = lambda n: F.hex(F.substring(head, 1, n))
    block = lead(4) == "1F8B0804"
    return F.when(block & F.hex(head).contains("42430200"), "bgzip").when(lead(2) == "1F8B", "gzip").when(lead(3) == "425A68", "bzip2").when(lead(4) == "28B52FFD", "zstd").when(lead(4) == "504B0304", "zip").otherwise("plain")


def file_format(name: Column) -> Column:
    base = F.regexp_replace(F.lower(name), r"\.(gz|bgz|bz2|zst)$", "")
    kinds = {"gff": r"\.gff3?$", "gtf": r"\.gtf$", "fasta": r"\.(fa|fasta|fna|faa)$", "2bit": r"\.2bit$", "bed": r"\.bed$", "vcf": r"\.vcf$", "table": r"\.(tsv|csv|txt)$"}
    return F.coalesce(*[F.when(base.rlike(p), k) for k, p in kinds.items()], F.lit("other"))


def sequence_subset(name: Column) -> Column:
    kind = file_format(name)
    return F.when(kind == "fasta", "fasta").when(kind == "2bit", "2bit").otherwise("other")


def first_signal(text: Column, signals: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first pattern found in lower-cased text."""
    return F.coalesce(*[F.when(F.lower(text).rlike(p), F.lit(label)) for label, p in signals], F.lit(otherwise))


def failure_code(text: Column) -> Column:
    return first_signal(text, [("OUT_OF_MEMORY", "out of memory|oom|cannot allocate"), ("TIMEOUT", "time ?limit|timed? ?out"), ("CHECKSUM", "checksum|digest|sha-?256|md5"), ("MISSING_INPUT", "no such file|not found|missing"), ("DISK", "no space left|disk quota"), ("NETWORK", "connection|network|unreachable")], "OTHER")


def group_of(name: Column, groups: dict[str, str], lineage: Column, otherwise: str = "other") -> Column:
    """A class's group, else that of the first class its lineage names."""
    table = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    from_lineage = F.element_at(F.filter(F.transform(multi(lineage), lambda x: F.element_at(table, x)), lambda x: x.isNotNull()), 1)
    return F.coalesce(F.element_at(table, name), F.when(F.size(F.filter(F.transform(multi(lineage), lambda x: F.element_at(table, x)), lambda x: x.isNotNull())) > 0, from_lineage), F.lit(otherwise))


def confidence_tier(hard: Sequence[Column], soft: Sequence[Column]) -> Column:
    """X if a hard condition fails, C if one is unknown; A if all soft ones hold, C if one is unknown, else B."""
    h, s = F.array(*hard), F.array(*soft)
    no = F.exists(h, lambda x: F.coalesce(~x, F.lit(False)))
    open_ = lambda a: F.exists(a, lambda x: x.isNull())
    all_yes = F.forall(s, lambda x: F.coalesce(x, F.lit(False)))
    return F.when(no, "X").when(open_(h), "C").when(all_yes, "A").when(open_(s), "C").otherwise("B")


def quality_verdict(qv: Column, contradicted_a: Column, contradicted_b: Column, ratio: Column, r: Column) -> Column:
    """Ordered: low quality, contradicted by both technologies, inconsistent, else supported."""
    return F.when(qv < 20, "low_quality").when((contradicted_a > 0.5) & (contradicted_b > 0.5), "contradicted").when(~ratio.between(0.8, 1.25) | (r < 0.5), "inconsistent").otherwise("supported")


def measurement_state(value: Column, minimum: Column, strict: bool) -> Column:
    """missing, invalid or below_minimum, else ok. Strict: what is not finite and positive is missing, and a bad minimum is below_minimum."""
    v, m = finite(value), finite(minimum)
    if strict:
        return F.when(v.isNull() | (v <= 0), "missing").when(m.isNull() | (m <= 0) | (v < m), "below_minimum").otherwise("ok")
    return F.when(value.isNull() | (F.trim(value.cast("string")) == ""), "missing").when(v.isNull() | (v < 0), "invalid").when(v < m, "below_minimum").otherwise("ok")


def memory_mib(text: Column) -> Column:
    """MiB of a size with suffix K, M, G or T (bytes without one)."""
    n, unit = F.regexp_extract(text, r"^([0-9.]+)", 1).try_cast("double"), F.upper(F.regexp_extract(text, r"([KMGT])i?[Bcn]?$", 1))
    power = F.when(unit == "K", -1).when(unit == "M", 0).when(unit == "G", 1).when(unit == "T", 2).otherwise(-2)
    return F.when(text.isNotNull() & (F.trim(text) != ""), n * F.pow(F.lit(1024.0), power))


def requested_memory_mib(text: Column, cpus: Column) -> Column:
    """MiB asked for; with suffix c the amount is for each CPU."""
    return memory_mib(F.regexp_replace(text, "[cn]$", "")) * F.when(text.endswith("c"), cpus).otherwise(1)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def predicted_resources(bases: Column) -> tuple[Column, Column, Column]:
    """(cpu hours, memory GiB, scratch GiB) of a genome of so many bases, clamped, to two places, half to even."""
    g = bases / 1e9
    return F.bround(clamp(8 + 120 * g, 8, 2000), 2), F.bround(clamp(16 + 48 * g, 16, 512), 2), F.bround(clamp(20 + 90 * g, 20, 4000), 2)


def relative_error(predicted: Column, observed: Column) -> Column:
    return F.when(observed > 0, (predicted - observed) / observed)
