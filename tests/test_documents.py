"""JSON schemas as predicates, canonical forms: each rule broken once."""

import copy
import hashlib
import json

import pytest

from strandframe.functions import documents as dc

SCHEMA = {
    "$defs": {"sha": {"type": "string", "pattern": "^[0-9a-f]{4}$"}, "named": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "minLength": 2, "maxLength": 5}}}},
    "type": "object",
    "required": ["version", "items"],
    "additionalProperties": False,
    "properties": {
        "version": {"const": "v1"}, "kind": {"enum": ["a", "b", 3, None]}, "n": {"type": ["integer", "null"], "minimum": 1, "maximum": 9}, "x": {"type": "number", "exclusiveMinimum": 0, "exclusiveMaximum": 1}, "flag": {"type": "boolean"},
        "items": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"allOf": [{"$ref": "#/$defs/named"}], "properties": {"sha": {"$ref": "#/$defs/sha"}}}},
        "one": {"oneOf": [{"type": "string"}, {"const": "s"}, {"type": "integer"}]}, "any": {"anyOf": [{"type": "string"}, {"type": "integer", "minimum": 5}]}, "no": {"not": {"type": "string"}},
        "cond": {"if": {"required": ["k"]}, "then": {"required": ["l"]}, "else": {"required": ["m"]}}, "a/b~c": {"type": "integer"},
    },
}
GOOD = {"version": "v1", "kind": None, "n": None, "x": 0.5, "flag": True, "items": [{"name": "ab", "sha": "00ff"}, {"name": "cd"}], "one": "t", "any": 7, "no": 1, "cond": {"k": 1, "l": 2}, "a/b~c": 4}
BROKEN = [
    ({"version": "v2"}, "/version", "const"), ({"version": 1}, "/version", "const"), ({"kind": "c"}, "/kind", "enum"), ({"n": 0}, "/n", "minimum"), ({"n": 10}, "/n", "maximum"), ({"n": 1.5}, "/n", "type"), ({"x": 0}, "/x", "exclusiveMinimum"), ({"x": 1}, "/x", "exclusiveMaximum"), ({"x": "1"}, "/x", "type"),
    ({"flag": "true"}, "/flag", "type"), ({"items": []}, "/items", "minItems"), ({"items": [{"name": f"n{i}"} for i in range(4)]}, "/items", "maxItems"), ({"items": [{"name": "aa"}] * 2}, "/items", "uniqueItems"), ({"items": {}}, "/items", "type"),
    ({"items": [{"name": "aa"}, {}]}, "/items/1", "required name"), ({"items": [{"name": "a"}]}, "/items/0/name", "minLength"), ({"items": [{"name": "abcdef"}]}, "/items/0/name", "maxLength"), ({"items": [{"name": "ab", "sha": "00FF"}]}, "/items/0/sha", "pattern"),
    ({"one": "s"}, "/one", "oneOf"), ({"one": None}, "/one", "oneOf"), ({"any": 4}, "/any", "anyOf"), ({"no": "x"}, "/no", "not"), ({"cond": {"k": 1}}, "/cond", "required l"), ({"cond": {}}, "/cond", "required m"), ({"other": 1}, "/other", "additionalProperties"), ({"a/b~c": "x"}, "/a~1b~0c", "type"),
]


def test_each_rule_broken_once(spark):
    docs = [("good", json.dumps(GOOD)), ("none", "{"), ("list", "[]"), ("lost", json.dumps({"version": "v1"}))] + [(str(k), json.dumps(GOOD | change)) for k, (change, _, _) in enumerate(BROKEN)]
    got = {}
    for r in dc.faults(spark.createDataFrame(docs, "id string, doc string"), "id", "doc", SCHEMA).collect():
        got.setdefault(r.id, []).append((r.pointer, r.rule))
    assert "good" not in got and got["none"] == [("", "json")] and got["list"] == [("", "type")] and got["lost"] == [("", "required items")]
    for k, (change, pointer, rule) in enumerate(BROKEN):
        assert got[str(k)] == [(pointer, rule)], change


def test_what_cannot_be_compiled_is_refused(spark):
    from pyspark.sql import functions as F

    for bad in ({"patternProperties": {}}, {"$ref": "other.json#/x"}, {"$ref": "#/a", "a": 1}, {"additionalProperties": {"type": "string"}}):
        with pytest.raises((ValueError, KeyError)):
            dc.schema_faults(F.parse_json(F.lit("{}")), bad)
    with pytest.raises(ValueError, match="recursive"):
        dc.schema_faults(F.parse_json(F.lit("{}")), {"$ref": "#/$defs/a", "$defs": {"a": {"properties": {"b": {"$ref": "#/$defs/a"}}}}})


def test_canonical_forms_are_sorted_dumps(spark):
    values = [{"b": [1, {"z": None, "a": "é\n\"\\"}], "a": {"y": 1.50, "x": True}, "self": "x"}, [], "text", 1e22, {"self": 1}]
    docs = [(i, json.dumps(v, indent=2)) for i, v in enumerate(values)] + [(9, "{oops"), (10, None)]
    got = {r.id: r for r in dc.digests(spark.createDataFrame(docs, "id long, doc string"), "id", "doc", without="self").collect()}
    for i, v in enumerate(values):
        text = json.dumps({k: x for k, x in v.items() if k != "self"} if isinstance(v, dict) else v, sort_keys=True, separators=(",", ":"))
        assert got[i].canonical == text and got[i].sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got[9].sha256 is None and got[10].canonical is None
    nested = json.dumps({"files": [{"sha256": "ab" * 32, "size": 3}, {"md5": "cd" * 16}], "x/y": {"sha256_of": "ef" * 32}, "sha256": "short"})
    found = {(r.pointer, r.key, r.value) for r in dc.leaves(spark.createDataFrame([(1, nested), (2, "[")], "id long, doc string"), "id", "doc", r"(sha256|md5)\w*=[0-9a-f]{32,64}$").collect()}
    assert found == {("/files/0/sha256", "sha256", "ab" * 32), ("/files/1/md5", "md5", "cd" * 16), ("/x~1y/sha256_of", "sha256_of", "ef" * 32)}


def test_manifest_rules(spark):
    one = {"dataset_id": "d", "diversity_eligibility": "eligible", "observables": {"gc3": "eligible", "pi_S_over_pi_W": "no"}, "reference": {"assembly_accession": "A.1"}, "annotation": {"assembly_accession": "A.1", "status": "native"}, "variation": {"kind": "deposited_exact_reference_variants"}, "denominator": {"kind": "gvcf", "sample_list_sha256": "aa"}, "samples": {"sample_list": {"sha256": "aa"}}}

    def changed(path, value):
        d = copy.deepcopy(one)
        at = d
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
        return {"datasets": [d]}

    cases = {
        "reference_and_annotation": changed(["reference"], None), "assembly": changed(["annotation", "assembly_accession"], "A.2"), "native_annotation": changed(["annotation", "status"], "lifted"), "variation": changed(["variation"], None), "denominator": changed(["denominator"], None), "samples": changed(["samples"], {}),
        "sample_list": changed(["samples", "sample_list", "sha256"], "bb"), "denominator_kind": changed(["denominator", "kind"], "h1_reference_alignable_mask"), "dataset_id": {"datasets": [one, one]}, "credential": {"datasets": [one], "note": "password = hunter2"},
    }
    direct = changed(["variation", "kind"], "direct_wfmash_h2_to_h1")
    docs = [("good", {"datasets": [one]}), ("none", {"datasets": []}), ("direct", direct), *cases.items()]
    got = {}
    for r in dc.manifest_faults(spark.createDataFrame([(k, json.dumps(v)) for k, v in docs], "id string, doc string"), "id", "doc").collect():
        got.setdefault(r.id, set()).add(r.rule)
    assert got == {k: {k} for k in cases} | {"direct": {"denominator_kind"}}
