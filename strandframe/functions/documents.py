"""JSON documents: schemas as predicates with error pointers, canonical forms and nested digests."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FAULT = "array<struct<pointer:string,rule:string>>"
#: How Spark names the kinds of a JSON value.
_KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "boolean": "^BOOLEAN$", "null": "^VOID$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$"}
_SEEN = ("type", "enum", "const", "pattern", "minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minItems", "maxItems", "uniqueItems", "items", "required", "properties", "additionalProperties", "allOf", "anyOf", "oneOf", "not", "if", "then", "else", "$ref")
_SILENT = ("$schema", "$id", "$defs", "definitions", "title", "description", "default", "examples", "format", "$comment")


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).rlike(_KINDS[kind])


def _text(x: Any) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def schema_faults(v: Column, schema: Mapping[str, Any] | bool, root: Mapping[str, Any] | None = None, pointer: Column | None = None, _within: tuple[str, ...] = ()) -> Column:
    """array<struct<pointer, rule>> of what a VARIANT breaks in a JSON schema; empty if nothing.

    The schema is compiled to one expression of built-in functions: a predicate for each rule, lambdas over array items,
    counts of fitting branches for oneOf. format is an annotation; a keyword or a recursive $ref that cannot be compiled
    is an error here, not a rule that passes.
    """
    root = schema if root is None else root
    at = F.lit("") if pointer is None else pointer
    if isinstance(schema, bool):
        return _faults([] if schema else [(F.lit(False), "false")], at)
    if odd := set(schema) - set(_SEEN) - set(_SILENT):
        raise ValueError(f"keywords {sorted(odd)} are not known")
    parts: list[Column] = []
    checks: list[tuple[Column, str]] = []
    inner = lambda value, sub, where=at: schema_faults(value, sub, root, where, _within)
    if ref := schema.get("$ref"):
        if ref in _within or not ref.startswith("#/"):
            raise ValueError(f"$ref {ref} is recursive or not local")
        found: Any = root
        for step in ref[2:].split("/"):
            found = found[step.replace("~1", "/").replace("~0", "~")]
        parts.append(schema_faults(v, found, root, at, (*_within, ref)))
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        ok = _is(v, kinds[0])
        for k in kinds[1:]:
            ok = ok | _is(v, k)
        checks.append((ok, "type"))
    whole = F.to_json(v)
    if "const" in schema:
        checks.append((whole == _text(schema["const"]), "const"))
    if "enum" in schema:
        checks.append((whole.isin([_text(x) for x in schema["enum"]]), "enum"))
    text, number = _is(v, "string"), _is(v, "number")
    size = F.length(_as(v, "string"))
    for name, ok in (("pattern", lambda x: _as(v, "string").rlike(x)), ("minLength", lambda x: size >= x), ("maxLength", lambda x: size <= x)):
        if name in schema:
            checks.append((~text | ok(schema[name]), name))
    value = _as(v, "double")
    for name, ok in (("minimum", lambda x: value >= x), ("maximum", lambda x: value <= x), ("exclusiveMinimum", lambda x: value > x), ("exclusiveMaximum", lambda x: value < x)):
        if name in schema:
            checks.append((~number | ok(schema[name]), name))
    array, items = _is(v, "array"), _as(v, "array<variant>")
    for name, ok in (("minItems", lambda x: F.size(items) >= x), ("maxItems", lambda x: F.size(items) <= x), ("uniqueItems", lambda x: F.lit(not x) | (F.size(F.array_distinct(F.transform(items, lambda i: F.to_json(i)))) == F.size(items)))):
        if name in schema:
            checks.append((~array | F.coalesce(ok(schema[name]), F.lit(False)), name))
    if "items" in schema:
        each = F.flatten(F.transform(items, lambda x, i: inner(x, schema["items"], F.concat(at, F.lit("/"), i.cast("string")))))
        parts.append(F.when(array, F.coalesce(each, _none())).otherwise(_none()))
    known = schema.get("properties", {})
    of = _is(v, "object")
    keys = F.map_keys(_as(v, "map<string,variant>"))
    for name in schema.get("required", []):
        checks.append((~of | F.array_contains(keys, name), f"required {name}"))
    for name, sub in known.items():
        child = F.try_variant_get(v, f"$['{name}']", "variant")
        where = F.concat(at, F.lit("/" + name.replace("~", "~0").replace("/", "~1")))
        parts.append(F.when(of & F.array_contains(keys, name), inner(child, sub, where)).otherwise(_none()))
    more = schema.get("additionalProperties", True)
    if more is False:
        others = F.filter(keys, lambda k: ~k.isin(list(known))) if known else keys
        parts.append(F.when(of, F.coalesce(F.transform(others, lambda k: F.struct(F.concat(at, F.lit("/"), k).alias("pointer"), F.lit("additionalProperties").alias("rule"))), _none())).otherwise(_none()))
    elif more is not True:
        raise ValueError("additionalProperties can be true or false")
    fits = lambda sub: F.size(inner(v, sub)) == 0
    for sub in schema.get("allOf", []):
        parts.append(inner(v, sub))
    if "anyOf" in schema:
        checks.append((_count([fits(s) for s in schema["anyOf"]]) >= 1, "anyOf"))
    if "oneOf" in schema:
        checks.append((_count([fits(s) for s in schema["oneOf"]]) == 1, "oneOf"))
    if "not" in schema:
        checks.append((~fits(schema["not"]), "not"))
    if "if" in schema:
        parts.append(F.when(fits(schema["if"]), inner(v, schema.get("then", True))).otherwise(inner(v, schema.get("else", True))))
    parts.append(_faults(checks, at))
    return F.flatten(F.array(*parts))


def _none() -> Column:
    return F.array().cast(_FAULT)


def _count(conditions: Sequence[Column]) -> Column:
    return sum((c.cast("int") for c in conditions[1:]), conditions[0].cast("int"))


def _faults(checks: Sequence[tuple[Column, str]], at: Column) -> Column:
    if not checks:
        return _none()
    broken = [F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.struct(at.alias("pointer"), F.lit(rule).alias("rule"))) for ok, rule in checks]
    return F.filter(F.array(*broken), lambda x: x.isNotNull()).cast(_FAULT)


def faults(docs: DataFrame, id_col: str, json_col: str, schema: Mapping[str, Any]) -> DataFrame:
    """(id, pointer, rule): a row for every rule of a JSON schema that a document breaks; text that is no JSON is 'json'."""
    parsed = docs.select(F.col(id_col), F.try_parse_json(json_col).alias("_v"))
    bad = F.when(F.col("_v").isNull(), F.array(F.struct(F.lit("").alias("pointer"), F.lit("json").alias("rule")))).otherwise(schema_faults(F.col("_v"), schema))
    return parsed.select(id_col, F.explode(bad).alias("_f")).select(id_col, "_f.pointer", "_f.rule")


def canonical(value: Any) -> str:
    """Keys sorted, no blanks, ASCII: equal documents have equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def digests(docs: DataFrame, id_col: str, json_col: str, without: str | None = None) -> DataFrame:
    """(id, sha256, canonical) of each document's canonical form, without a top-level key (its own digest) if one is named.

    Null or broken JSON has nulls.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = []
            for raw in batch.column(1).to_pylist():
                try:
                    value = json.loads(raw)
                    texts.append(canonical({k: x for k, x in value.items() if k != without} if isinstance(value, dict) else value))
                except (TypeError, ValueError):
                    texts.append(None)
            hashed = [t and hashlib.sha256(t.encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashed, pa.string()), pa.array(texts, pa.string())], ["id", "sha256", "canonical"])

    return docs.select(F.col(id_col).alias("id"), json_col).mapInArrow(run, f"id {kind}, sha256 string, canonical string").withColumnRenamed("id", id_col)


def leaves(docs: DataFrame, id_col: str, json_col: str, pattern: str | None = None) -> DataFrame:
    """(id, pointer, key, value): every text or number in a document by its JSON pointer, of keys or values that a pattern
    (searched in 'key=value') picks; digests, for instance, by r'(sha256|md5)\\w*=[0-9a-f]{32,64}$'."""
    kind, wanted = docs.schema[id_col].dataType.simpleString(), pattern and re.compile(pattern)

    def walk(value: Any, pointer: str, key: str) -> Iterator[tuple[str, str, str]]:
        inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
        if inner is not None:
            for k, x in inner:
                yield from walk(x, f"{pointer}/{str(k).replace('~', '~0').replace('/', '~1')}", str(k) if isinstance(value, dict) else key)
        elif value is not None and (not wanted or wanted.search(f"{key}={value}")):
            yield pointer, key, value if isinstance(value, str) else json.dumps(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += [(name, *leaf) for leaf in walk(json.loads(raw), "", "")]
                except (TypeError, ValueError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([batch.schema.field(0).type, pa.string(), pa.string(), pa.string()])], ["id", "pointer", "key", "value"])

    return docs.select(F.col(id_col).alias("id"), json_col).mapInArrow(run, f"id {kind}, pointer string, key string, value string").withColumnRenamed("id", id_col)


#: Fixed value: what looks like a credential that is given a value.
_CREDENTIAL = r"(?i)(?:credential|password|passwd|secret|token|access[_-]?token|api[_-]?key)\s*[=:]\s*\S+"
#: The denominators that fit a source of variation.
_MASKS = {"deposited_exact_reference_variants": ("all_sites_vcf", "gvcf", "cohort_callable_mask"), "direct_wfmash_h2_to_h1": ("h1_reference_alignable_mask",)}


def manifest_faults(docs: DataFrame, id_col: str, json_col: str, schema: Mapping[str, Any] | None = None) -> DataFrame:
    """(id, pointer, rule): what a manifest of datasets breaks, in its schema if one is given and in rules between fields.

    The rules, by dataset: annotation-derived or diversity results need a native annotation of the reference's assembly;
    diversity needs a source, a denominator that fits its kind, samples, and one sample-list digest; two accessions never
    differ; a dataset_id is there once; no text assigns a credential.
    """
    v = docs.select(F.col(id_col), F.try_parse_json(json_col).alias("_v"))
    sets = v.select(id_col, F.posexplode(F.try_variant_get("_v", "$.datasets", "array<variant>")).alias("_i", "_d"))
    get = lambda path: F.try_variant_get("_d", f"$.{path}", "string")
    has = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get("_d", f"$.{name}", "variant")).rlike("^OBJECT<[^>]"), F.lit(False))
    on = lambda c: F.coalesce(c, F.lit(False))
    diverse = on(get("diversity_eligibility") == "eligible")
    derived = diverse | on(get("observables.gc3") == "eligible") | on(get("observables.pi_S_over_pi_W") == "eligible")
    both = has("reference") & has("annotation")
    kind, mask = get("variation.kind"), get("denominator.kind")
    fits = F.coalesce(*[F.when(kind == k, on(mask.isin(list(m)))) for k, m in _MASKS.items()], F.lit(True))
    rules = {
        "reference_and_annotation": ~derived | both,
        "assembly": ~both | on(get("annotation.assembly_accession") == get("reference.assembly_accession")),
        "native_annotation": ~(derived & both) | on(get("annotation.status") == "native"),
        "variation": ~diverse | has("variation"),
        "denominator": ~diverse | has("denominator"),
        "samples": ~diverse | has("samples"),
        "sample_list": ~(diverse & has("denominator") & has("samples")) | on(get("denominator.sample_list_sha256") == get("samples.sample_list.sha256")),
        "denominator_kind": ~(diverse & has("variation") & has("denominator")) | fits,
    }
    broken = F.explode(F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull()))
    out = sets.select(id_col, F.concat(F.lit("/datasets/"), F.col("_i").cast("string")).alias("pointer"), broken.alias("rule"))
    named = sets.select(id_col, get("dataset_id").alias("_n")).groupBy(id_col, "_n").agg(F.count("*").alias("_c")).where("_n is not null and _c > 1")
    out = out.unionByName(named.select(id_col, F.lit("/datasets").alias("pointer"), F.lit("dataset_id").alias("rule")).distinct())
    out = out.unionByName(leaves(docs, id_col, json_col).where(F.col("value").rlike(_CREDENTIAL)).select(id_col, "pointer", F.lit("credential").alias("rule")))
    return out if schema is None else faults(docs, id_col, json_col, schema).unionByName(out)
