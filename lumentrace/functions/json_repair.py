"""JSON objects out of model answers that wrap, break or embellish them.

Answers that are clean JSON of the expected shape are taken apart by variant functions; only the others go through the
scanner, in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCES = (re.compile(r"```json\s*(.*?)```", re.S | re.I), re.compile(r"```\w*\s*(.*?)```", re.S))
_COMMA = re.compile(r",(\s*[}\]])")
_EVIDENCE = re.compile(r'("evidence"\s*:\s*)("(?:[^"\\]|\\.)*"(?:\s*,\s*"(?:[^"\\]|\\.)*"(?!\s*:))*)')
_QUOTES = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'"})


def balanced(text: str) -> str | None:
    """The first bracketed value whose brackets close, with strings and escapes minded; the earliest bracket wins."""
    for start in (m.start() for m in re.finditer(r"[{\[]", text)):
        depth, quoted, skip = [], False, False
        for at in range(start, len(text)):
            c = text[at]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth.append("}" if c == "{" else "]")
            elif c in "}]":
                if not depth or depth.pop() != c:
                    break
                if not depth:
                    return text[start : at + 1]
    return None


def repaired(text: str) -> str:
    """Trailing commas go, and several evidence strings become a list."""
    return _EVIDENCE.sub(lambda m: f"{m[1]}[{m[2]}]", _COMMA.sub(r"\1", text))


def tolerant(answer: str | None) -> object | None:
    """The JSON value of an answer, from a tagged fence, any fence, the first balanced brackets or the whole; None if there is none."""
    if not answer:
        return None
    parts = [m[1] for f in _FENCES for m in [f.search(answer)] if m] + [balanced(answer), answer]
    for part in filter(None, parts):
        for attempt in (part, repaired(part), repaired(part.translate(_QUOTES))):
            try:
                return json.loads(attempt.strip())
            except ValueError:
                continue
    return None


# Fields of an extracted property.
FIELDS = ("property_description", "category", "reason", "behavior_type", "contains_errors", "unexpected_behavior", "model")
# Why an answer gave no property.
JSON_PARSE_ERROR, UNSUPPORTED_JSON_SHAPE, EMPTY_LIST_RESPONSE, UNKNOWN_MODEL_MAPPING = "JSON_PARSE_ERROR", "UNSUPPORTED_JSON_SHAPE", "EMPTY_LIST_RESPONSE", "UNKNOWN_MODEL_MAPPING"
PARSED = T.StructType(
    [T.StructField("pos", T.IntegerType())] + [T.StructField(f, T.StringType()) for f in FIELDS] + [T.StructField("evidence", T.ArrayType(T.StringType())), T.StructField("error_type", T.StringType())]
)


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def properties_of(value: object) -> tuple[list[dict], str | None]:
    """Property objects of a parsed answer, or the reason why there are none."""
    if isinstance(value, dict):
        inner = value.get("properties", [value])
    else:
        inner = value
    if not isinstance(inner, list) or not all(isinstance(x, dict) for x in inner):
        return [], UNSUPPORTED_JSON_SHAPE
    return (inner, None) if inner else ([], EMPTY_LIST_RESPONSE)


def _kind(value) -> Column:
    """STRING, BOOLEAN, VOID, OBJECT<...>, ARRAY<...> and so on; null where there is no value at all."""
    return F.schema_of_variant(value)


def _clean_items(v: Column) -> Column:
    """The property objects of a parsed answer in which every field is text, a boolean or null and evidence lists texts; else null.

    On these the scanner and the variant functions agree to the letter; numbers and nested values it writes its own way.
    """
    inner = F.try_variant_get(v, "$.properties", "variant")
    items = F.when(~F.startswith(_kind(v), F.lit("OBJECT")), F.try_variant_get(v, "$", "array<variant>"))
    items = items.when(_kind(inner).isNull(), F.array(v)).otherwise(F.try_variant_get(v, "$.properties", "array<variant>"))

    def plain(x: Column) -> Column:
        field = lambda f: F.coalesce(_kind(F.try_variant_get(x, f"$.{f}", "variant")), F.lit("VOID"))
        good = F.startswith(_kind(x), F.lit("OBJECT")) & field("evidence").isin("STRING", "VOID", "ARRAY<STRING>")
        for f in FIELDS:
            good = good & field(f).isin("STRING", "BOOLEAN", "VOID")
        return good

    return F.when((F.size(items) > 0) & F.forall(items, plain), items)


def parsed_rows(answers: DataFrame, response: str = "raw_response") -> DataFrame:
    """The input's columns with one row for each property of an answer, or one row that tells the error.

    Adds pos, the property's fields as text, evidence as a list of strings, and error_type.
    """
    others = [c for c in answers.columns if c not in PARSED.names]
    r = F.col(response).cast("string")
    bare = ~F.contains(r, F.lit("```")) & F.ltrim(r).rlike(r"^[\[{]")
    split = answers.select(*others, F.when(bare, F.try_parse_json(r)).alias("_v")).withColumn("_items", F.when(F.col("_v").isNotNull(), _clean_items(F.col("_v")))).drop("_v")
    item = split.where("_items is not null").select(*others, F.posexplode("_items").alias("pos", "_x"))
    get = lambda f, kind="string": F.try_variant_get("_x", f"$.{f}", kind)
    evidence = F.when(_kind(get("evidence", "variant")) == "STRING", F.array(get("evidence"))).otherwise(get("evidence", "array<string>"))
    easy = item.select(*others, F.col("pos").cast("int").alias("pos"), *[get(f).alias(f) for f in FIELDS], evidence.alias("evidence"), F.lit(None).cast("string").alias("error_type"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out, source = [], []
            for i, answer in enumerate(rows[response]):
                value = tolerant(answer)
                found, error = ([], JSON_PARSE_ERROR) if value is None else properties_of(value)
                for pos, p in enumerate(found or [{}]):
                    evidence = p.get("evidence")
                    listed = None if evidence is None else [_text(e) for e in evidence] if isinstance(evidence, list) else [_text(evidence)]
                    out.append({"pos": pos, **{f: _text(p.get(f)) for f in FIELDS}, "evidence": listed, "error_type": error})
                    source.append(i)
            made = pd.DataFrame(out, columns=PARSED.names)
            yield pd.concat([rows[others].iloc[source].reset_index(drop=True), made], axis=1)

    schema = T.StructType([answers.schema[c] for c in others] + PARSED.fields)
    return easy.unionByName(split.where("_items is null").drop("_items").mapInPandas(run, schema))


def diagnosis(response: str = "raw_response"):
    """What seems wrong with an answer that does not parse."""
    r = F.col(response)
    n = lambda c: F.length(r) - F.length(F.replace(r, F.lit(c), F.lit("")))
    return (
        F.when(r.isNull() | (F.trim(r) == ""), "empty response")
        .when((n("{") == 0) & (n("[") == 0), "no brackets")
        .when(n("{") != n("}"), "unbalanced braces")
        .when(n("[") != n("]"), "unbalanced brackets")
        .when(n('"') % 2 == 1, "unbalanced quotes")
        .when(~F.contains(r, F.lit("```")), "no code fence")
        .otherwise("invalid JSON")
    )


def schema_error(value: object, side_by_side: bool = False) -> str | None:
    """The first way in which a parsed answer differs from a list of typed property objects; None if in none."""
    if not isinstance(value, list):
        return "not a list"
    required = {"behavior_type": str, "property_description": str, "category": str, "evidence": str, "reason": str, "contains_errors": bool, "unexpected_behavior": bool} | ({"model": str} if side_by_side else {})
    for i, item in enumerate(value):
        if not isinstance(item, dict):
            return f"item {i} is no object"
        for field, kind in required.items():
            if field not in item:
                return f"item {i} lacks {field}"
            if not isinstance(item[field], kind) and not (field == "evidence" and isinstance(item[field], list)):
                return f"item {i}: {field} is no {kind.__name__}"
    return None


def schema_errors(response: str = "raw_response", side_by_side: bool = False) -> Column:
    """``schema_error`` of a column of answers; 'no JSON' where nothing can be parsed, null where all is as it should be."""

    @F.pandas_udf("string")
    def check(answers: pd.Series) -> pd.Series:
        values = answers.map(tolerant)
        return pd.Series(["no JSON" if v is None else schema_error(v, side_by_side) for v in values], index=answers.index, dtype=object)

    return check(F.col(response))
