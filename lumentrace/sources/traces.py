"""Agent traces and evaluation files as conversations of (role, content) messages."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Span attributes of the OpenInference convention.
KIND, INPUT, OUTPUT, TOOL_NAME, TOOL_TEXT, TOOL_OUTPUT = "openinference.span.kind", "llm.input_messages", "llm.output_messages", "tool.name", "tool.description", "output.value"

EVENTS = "trace_id string, pos int, ts string, kind string, role string, content string, tool_calls string, tool_name string, tool_description string"


def _spans(node: object) -> Iterator[dict]:
    """All spans below a trace, depth first."""
    for span in node if isinstance(node, list) else []:
        if isinstance(span, dict):
            yield span
            yield from _spans(span.get("child_spans"))


def _value(x: object) -> object:
    if isinstance(x, str):
        try:
            return json.loads(x)
        except ValueError:
            return x
    return x


def flattened(attributes: dict, prefix: str) -> list[dict]:
    """Messages kept under dotted keys, ``prefix.0.message.role`` and so on, put together in order of their numbers."""
    tree: dict = {}
    for key, value in attributes.items():
        if key.startswith(f"{prefix}."):
            node, path = tree, key[len(prefix) + 1 :].split(".")
            for step in path[:-1]:
                node = node.setdefault(step, {})
                if not isinstance(node, dict):
                    break
            else:
                node[path[-1]] = value

    def listed(node: object) -> object:
        if isinstance(node, dict):
            if node and all(k.isdigit() for k in node):
                return [listed(node[k]) for k in sorted(node, key=int)]
            return {k: listed(v) for k, v in node.items()}
        return node

    out = listed(tree)
    return out if isinstance(out, list) else []


def messages_of(attributes: dict, prefix: str) -> list[dict]:
    """Messages of an attribute, whether nested, JSON text or flattened."""
    found = _value(attributes.get(prefix))
    if isinstance(found, dict):
        found = found.get("messages", [found])
    found = found if isinstance(found, list) else flattened(attributes, prefix)
    return [m.get("message", m) for m in found if isinstance(m, dict)]


def _text(content: object) -> str | None:
    return content if content is None or isinstance(content, str) else json.dumps(content, sort_keys=True, ensure_ascii=False)


def events(traces: DataFrame, column: str = "trace", id_column: str = "trace_id") -> DataFrame:
    """One row for each message and tool span of JSON traces, with its place in depth-first order. Text that is no JSON gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in EVENTS.split(", ")]
        for rows in batches:
            out = []
            for trace_id, text in zip(rows[id_column], rows[column], strict=True):
                trace = _value(text)
                spans = _spans(trace.get("spans") if isinstance(trace, dict) else trace)
                for pos, span in enumerate(spans):
                    a = span.get("span_attributes") or {}
                    at = (trace_id, pos, span.get("timestamp"), a.get(KIND))
                    if a.get(KIND) == "TOOL":
                        out.append((*at, "tool", _text(a.get(TOOL_OUTPUT)), None, a.get(TOOL_NAME), a.get(TOOL_TEXT)))
                        continue
                    for prefix in (INPUT, OUTPUT):
                        for m in messages_of(a, prefix):
                            content, calls = m.get("content", m.get("contents")), m.get("tool_calls")
                            if prefix == INPUT and m.get("role") == "system" or not content and not calls:
                                continue
                            out.append((*at, m.get("role") or "user", _text(content), _text(calls), None, None))
            yield pd.DataFrame(out, columns=names)

    return traces.select(id_column, column).mapInPandas(run, EVENTS.replace("trace_id", id_column, 1))


def conversations(found: DataFrame, id_column: str = "trace_id") -> DataFrame:
    """(trace_id, messages): events by time, missing times first, then by place."""
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("ts", F.lit("")).alias("ts"), "pos", "role", "content", "tool_calls")))
    return found.groupBy(id_column).agg(F.transform(order, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["tool_calls"].alias("tool_calls"))).alias("messages"))


def tools(found: DataFrame, id_column: str = "trace_id") -> DataFrame:
    """Distinct tools of each trace, the first by place for each name."""
    first = F.min_by("tool_description", "pos").alias("description")
    return found.where("kind = 'TOOL' and tool_name is not null").groupBy(id_column, F.col("tool_name").alias("name")).agg(first, F.min("pos").alias("pos"))


def simulations(files: DataFrame) -> DataFrame:
    """Rows of agent evaluation files with ``info``, ``tasks`` and ``simulations``, one for each simulation of a known task.

    ``files`` is ``spark.read.json(path, multiLine=True)``. Adds the policy as system message where there is one.
    """
    sims = files.select(F.col("info.agent_info.llm").alias("model"), F.col("info.environment_info.policy").alias("policy"), F.explode("simulations").alias("s"))
    tasks = files.select(F.explode("tasks").alias("t")).select(F.col("t.id").alias("task_id"), F.col("t.user_scenario.instructions").cast("string").alias("prompt"))
    rows = sims.select("model", "policy", F.col("s.task_id").alias("task_id"), F.col("s.messages").alias("m"), F.col("s.reward_info.reward").cast("double").alias("reward"))
    said = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    system = F.when(F.col("policy").isNotNull(), F.array(F.struct(F.lit("system").alias("role"), F.col("policy").alias("content")))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    return rows.join(tasks, "task_id").select(F.col("task_id").cast("string").alias("question_id"), "prompt", "model", F.concat(system, said).alias("model_response"), F.create_map(F.lit("reward"), F.col("reward")).alias("score"))


def trials(runs: DataFrame, failed_only: bool = False) -> DataFrame:
    """(question_id, prompt, messages, reward) of runs (task_id, trial, traj, info...), with the reward from either place."""
    names = {f.name for f in runs.schema["info"].dataType} if "info" in runs.columns else set()
    places = ([F.col("info.reward_info.reward")] if "reward_info" in names else []) + ([F.col("reward_info.reward")] if "reward_info" in runs.columns else []) + ([F.col("reward")] if "reward" in runs.columns else [])
    reward = F.coalesce(*places, F.lit(None)).cast("double")
    prompt = F.col("info.task.instruction") if "task" in names else F.lit(None).cast("string")
    out = runs.select(F.concat_ws("-", "task_id", "trial").alias("question_id"), prompt.alias("prompt"), F.col("traj").alias("messages"), reward.alias("reward"))
    return out.where("reward = 0") if failed_only else out


def battles(rows: DataFrame, least: int = 0) -> DataFrame:
    """Battles with both conversations, the winner as a model's name, one for each prompt (the smallest id); models with fewer than ``least`` battles go."""
    from pyspark.sql import Window

    winner = F.when(F.col("winner") == "model_a", F.col("model_a")).when(F.col("winner") == "model_b", F.col("model_b")).otherwise("tie")
    full = rows.where("conversation_a is not null and conversation_b is not null").withColumns({"winner": winner, "prompt": F.col("conversation_a")[0]["content"]})
    one = full.withColumn("_n", F.row_number().over(Window.partitionBy("prompt").orderBy("id"))).where("_n = 1").drop("_n")
    if least:
        rare = one.groupBy("model_a").count().where(F.col("count") < least).select(F.col("model_a").alias("_m"))
        one = one.join(rare, F.col("model_a") == F.col("_m"), "left_anti").join(rare, F.col("model_b") == F.col("_m"), "left_anti")
    return one


def trajectory_text(messages: Column, roles: bool = True) -> Column:
    """An array of (role, content) as lines, each with its role before it; messages without content have none."""
    said = F.filter(messages, lambda m: m["content"].isNotNull())
    return F.array_join(F.transform(said, lambda m: F.concat(m["role"], F.lit(": "), m["content"]) if roles else m["content"]), "\n")


def user_profile(messages: Column) -> Column:
    """The first tool message that is a JSON object and tells of a name, an e-mail address or payment, as a variant; null if there is none."""
    fits = F.filter(messages, lambda m: (m["role"] == "tool") & F.rlike(m["content"], F.lit(r"^\s*\{")) & F.rlike(F.lower(m["content"]), F.lit("name|email|payment")) & F.try_parse_json(m["content"]).isNotNull())
    return F.try_parse_json(F.get(fits, F.lit(0))["content"])
