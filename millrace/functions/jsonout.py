"""Validation of model answers: a subset of JSON Schema compiled to Column predicates over a VARIANT."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.errors import ManifestError

#: Keywords that are understood; any other is an error when the manifest is loaded.
KEYWORDS = frozenset(("type", "properties", "required", "additionalProperties", "items", "enum", "minimum", "maximum", "minLength", "description", "title"))
TYPES = {
    "string": r"^STRING$",
    "boolean": r"^BOOLEAN$",
    "integer": r"^BIGINT$",
    "number": r"^(BIGINT|DOUBLE|DECIMAL.*)$",
    "object": r"^OBJECT.*$",
    "array": r"^ARRAY.*$",
    "null": r"^VOID$",
}


def check_schema(schema: dict[str, Any], where: str = "$") -> None:
    if unknown := set(schema) - KEYWORDS:
        raise ManifestError(f"{where}: unsupported schema keyword {sorted(unknown)[0]!r}")
    kinds = schema.get("type", [])
    for kind in kinds if isinstance(kinds, list) else [kinds]:
        if kind not in TYPES:
            raise ManifestError(f"{where}: unknown type {kind!r}")
    for name, sub in schema.get("properties", {}).items():
        check_schema(sub, f"{where}.{name}")
    if "items" in schema:
        check_schema(schema["items"], f"{where}[]")


def _every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def conforms(v: Column, schema: dict[str, Any]) -> Column:
    """Whether a present variant value meets the schema."""
    kind = F.schema_of_variant(v)
    tests: list[Column] = []
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        tests.append(reduce(lambda a, b: a | b, [kind.rlike(TYPES[k]) for k in kinds]))
    text = v.try_cast("string")
    if "enum" in schema:
        tests.append(reduce(lambda a, b: a | b, [(kind == "STRING") & (text == x) if isinstance(x, str) else (kind != "STRING") & (text == (str(x).lower() if isinstance(x, bool) else str(x))) for x in schema["enum"]]))
    if "minimum" in schema:
        tests.append(F.coalesce(v.try_cast("double") >= float(schema["minimum"]), F.lit(False)))
    if "maximum" in schema:
        tests.append(F.coalesce(v.try_cast("double") <= float(schema["maximum"]), F.lit(False)))
    if "minLength" in schema:
        tests.append(F.coalesce(F.length(text) >= schema["minLength"], F.lit(False)))
    known = schema.get("properties", {})
    required = set(schema.get("required", ()))
    for name in [*known, *(r for r in required if r not in known)]:
        sub = F.try_variant_get(v, f"$.{name}", "variant")
        ok = conforms(sub, known.get(name, {}))
        tests.append(F.when(sub.isNull(), F.lit(name not in required)).otherwise(ok))
    if schema.get("additionalProperties") is False:
        names = F.json_object_keys(F.to_json(v))
        tests.append(F.when(kind.rlike(TYPES["object"]), F.size(F.array_except(names, F.array(*map(F.lit, known)) if known else F.expr("cast(array() as array<string>)"))) == 0).otherwise(True))
    if "items" in schema:
        items = v.try_cast("array<variant>")
        tests.append(F.when(kind.rlike(TYPES["array"]), F.forall(items, lambda x: conforms(x, schema["items"]))).otherwise(True))
    return _every(tests)


def validated(raw: Column, output_format: str = "json", schema: dict[str, Any] | None = None, match_when: str | None = None) -> Column:
    """struct(payload, matched, error): canonical JSON, the boolean that match_when names, or what is wrong."""
    none = F.lit(None).cast("string")
    if output_format == "text":
        if schema is not None or match_when is not None:
            raise ManifestError("a text answer has neither a schema nor a field to match on")
        return F.struct(none.alias("payload"), F.lit(True).alias("matched"), none.alias("error"))
    check_schema(schema or {})
    v = F.try_parse_json(raw)
    wrong = F.when(v.isNull() | raw.isNull(), F.lit("the answer isn't JSON")).when(~F.schema_of_variant(v).rlike(TYPES["object"]), F.lit("the answer isn't a JSON object"))
    if schema:
        wrong = wrong.when(~F.coalesce(conforms(v, schema), F.lit(False)), F.lit("the answer doesn't meet the schema"))
    matched = F.lit(True)
    if match_when is not None:
        field = F.try_variant_get(v, f"$.{match_when}", "variant")
        wrong = wrong.when(F.coalesce(F.schema_of_variant(field) != "BOOLEAN", F.lit(True)), F.lit(f"the answer has no boolean {match_when!r}"))
        matched = F.coalesce(field.try_cast("boolean"), F.lit(False))
    return F.struct(F.when(wrong.isNull(), F.to_json(v)).alias("payload"), F.when(wrong.isNull(), matched).otherwise(F.lit(False)).alias("matched"), wrong.alias("error"))
