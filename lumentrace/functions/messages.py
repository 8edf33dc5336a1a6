"""Chat messages of any common shape as segments and as text.

Shapes differ from row to row, so messages travel as JSON text and are normalised in Arrow batches.
"""

from __future__ import annotations

import ast
import json
import pprint
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALL = "struct<id:string,name:string,arguments:string>"
MESSAGES = f"array<struct<role:string,name:string,id:string,segments:array<struct<kind:string,text:string,image:string,tool_calls:array<{CALL}>>>>>"


def _load(value: object) -> object:
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def tool_calls(value: object) -> list[dict]:
    """Calls given as list, object or JSON text, flat or with a nested function."""
    value = _load(value)
    if isinstance(value, dict):
        value = value.get("tool_calls", [value])
    out = []
    for call in value if isinstance(value, list) else []:
        if isinstance(call, dict):
            inner = call.get("function") if isinstance(call.get("function"), dict) else call
            arguments = inner.get("arguments")
            out.append({"id": call.get("id"), "name": inner.get("name"), "arguments": arguments if isinstance(arguments, str) or arguments is None else json.dumps(arguments, sort_keys=True, ensure_ascii=False)})
    return out


def _image(part: dict) -> str | None:
    image = part.get("image_url", part.get("image"))
    return image.get("url") if isinstance(image, dict) else image


def _segment(kind: str, text: str | None = None, image: str | None = None, calls: list | None = None) -> dict:
    return {"kind": kind, "text": text, "image": image, "tool_calls": calls}


def segments(content: object) -> list[dict]:
    """Content as text, images and tool calls in order."""
    if content is None:
        return []
    if isinstance(content, str):
        return [_segment("text", content)]
    if isinstance(content, list):
        return [s for part in content for s in segments(part)]
    if isinstance(content, dict):
        if isinstance(content.get("segments"), list):
            return segments(content["segments"])
        if content.get("tool_calls") is not None:
            own = segments({k: v for k, v in content.items() if k != "tool_calls"}) if content.get("text") is not None or _image(content) else []
            return [*own, _segment("tool", calls=tool_calls(content["tool_calls"]))]
        out = [_segment("text", str(content["text"]))] if content.get("text") is not None else []
        out += [_segment("image", image=image)] if (image := _image(content)) else []
        return out or [_segment("text", json.dumps(content, sort_keys=True, ensure_ascii=False))]
    return [_segment("text", str(content))]


def normalised(messages: object) -> list[dict]:
    """Messages as (role, name, id, segments)."""
    messages = _load(messages)
    out = []
    for m in messages if isinstance(messages, list) else []:
        if isinstance(m, dict):
            calls = tool_calls(m.get("tool_calls") or ([m["function_call"]] if m.get("function_call") else None))
            parts = segments(m.get("content")) + ([_segment("tool", calls=calls)] if calls else [])
            out.append({"role": m.get("role") or "user", "name": m.get("name"), "id": m.get("id") or m.get("tool_call_id"), "segments": parts})
    return out


def with_segments(df: DataFrame, column: str, to: str = "messages") -> DataFrame:
    """Add the normalised messages of a column of JSON text; null or other text gives none."""

    @F.pandas_udf(MESSAGES)
    def convert(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in parts:
            yield values.map(normalised)

    return df.withColumn(to, convert(F.col(column)))


def image_text(image: Column) -> Column:
    """Where an image is; of data only the length."""
    return F.when(F.startswith(image, F.lit("data:")), F.concat(F.lit("[image data, "), F.length(image).cast("string"), F.lit(" characters]"))).otherwise(F.concat(F.lit("[image "), image, F.lit("]")))


def has_image(messages: Column) -> Column:
    return F.exists(messages, lambda m: F.exists(m["segments"], lambda s: s["kind"] == "image"))


def as_text(messages: Column) -> Column:
    """Messages as text: a header for each role, then its segments by line."""

    def call(c: Column) -> Column:
        return F.concat(F.lit("[call "), F.coalesce(c["name"], F.lit("?")), F.lit("("), F.coalesce(c["arguments"], F.lit("")), F.lit(")]"))

    def part(s: Column) -> Column:
        calls = F.array_join(F.transform(s["tool_calls"], call), "\n")
        return F.when(s["kind"] == "text", s["text"]).when(s["kind"] == "image", image_text(s["image"])).otherwise(F.coalesce(calls, F.lit("")))

    def one(m: Column) -> Column:
        head = F.concat(F.lit("=== "), F.upper(m["role"]), F.coalesce(F.concat(F.lit(" ("), m["name"], F.lit(")")), F.lit("")), F.lit(" ===\n"))
        body = F.array_join(F.transform(m["segments"], part), "\n")
        return F.concat(head, F.when(F.size(m["segments"]) == 0, F.lit("(empty)")).otherwise(body))

    return F.array_join(F.transform(messages, one), "\n\n")


def collapsed(messages: Column) -> Column:
    """Content parts with the text between images joined, in order: array of (kind, value)."""

    def add(acc: Column, s: Column) -> Column:
        value = F.when(s["kind"] == "image", s["image"]).otherwise(F.coalesce(s["text"], F.lit("")))
        kind = F.when(s["kind"] == "image", F.lit("image")).otherwise(F.lit("text"))
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.lit("text").alias("kind"), F.concat(last["value"], F.lit("\n"), value).alias("value"))))
        return F.when((F.size(acc) > 0) & (kind == "text") & (last["kind"] == "text"), joined).otherwise(F.concat(acc, F.array(F.struct(kind.alias("kind"), value.alias("value")))))

    return F.aggregate(F.flatten(F.transform(messages, lambda m: m["segments"])), F.array().cast("array<struct<kind:string,value:string>>"), add)


def simple(prompt: Column, response: Column) -> Column:
    """A prompt and its answer as two messages in JSON text."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.to_json(F.array(turn("user", prompt), turn("assistant", response)))


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, messages): turn rows gathered as an array of (role, content) in order of turn."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def rendered(rows: DataFrame) -> DataFrame:
    """(conv_id, text): turn rows as one text with a header for each turn."""
    line = F.concat(F.lit("=== "), F.upper("role"), F.lit(" ===\n"), F.coalesce("text", F.lit("(empty)")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda m: m["line"]), "\n\n").alias("text"))


def printed(value: Column) -> Column:
    """Text that is a dictionary in Python's notation laid out in lines of 80 characters with sorted keys; other text as it is."""

    @F.pandas_udf("string")
    def lay_out(values: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                found = ast.literal_eval(x)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                return x
            return pprint.pformat(found, width=80) if isinstance(found, dict) else x

        return values.map(one)

    return F.when(F.rlike(value, F.lit(r"^[ \t]*\{")), lay_out(value)).otherwise(value)
