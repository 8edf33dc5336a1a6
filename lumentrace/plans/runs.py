"""Runs described by a configuration: a JSON text or a dictionary; values given on top win where they are not null."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumentrace.operators import joins, ranking
from lumentrace.operators.providers import CallCache, Provider
from lumentrace.plans import pipeline
from lumentrace.sources import loaders


def merged(config: str | dict, **given) -> dict:
    base = json.loads(config) if isinstance(config, str) else dict(config)
    return base | {k: v for k, v in given.items() if v is not None}


def run(spark: SparkSession, config: str | dict, provider: Provider, **given) -> pipeline.Dataset:
    """Explain the table at ``data_path``, or label it where the configuration has a taxonomy, and save to ``output_dir``.

    Keys: data_path, output_dir, method, models, model_a, model_b, score_columns, sample_size, min_cluster_size, replicates,
    taxonomy (labels, or a map of label to description).
    """
    c = merged(config, **given)
    df = loaders.load(spark, c["data_path"])
    if c.get("models"):
        df = df.where(F.col("model").isin(*c["models"]))
        if len(c["models"]) == 2:
            df = joins.answered_by_all(df, c["models"])
    if c.get("model_a") and c.get("model_b") and "model" in df.columns:
        key = ["question_id", "prompt"] if "question_id" in df.columns else ["prompt"]
        values = ["model_response", *(c.get("score_columns") or [])]
        df = joins.tidy_pairs(df, c["model_a"], c["model_b"], key, values).withColumns({"model_a": F.lit(c["model_a"]), "model_b": F.lit(c["model_b"])})
        df = df.withColumnsRenamed({"model_response_a": "model_a_response", "model_response_b": "model_b_response"})
    elif c.get("sample_size") and "model" in df.columns:
        df = ranking.sample_prompts(df, c["sample_size"])
    cache = CallCache(spark, f"{c['output_dir']}/calls")
    scored = {"score_columns": c["score_columns"]} if c.get("score_columns") and "model_a" not in df.columns else {}
    if c.get("taxonomy"):
        out = pipeline.label(df, provider, cache, list(c["taxonomy"]), c.get("replicates", 0), **scored)
    else:
        out = pipeline.explain(df, provider, cache, c.get("method"), None, c.get("replicates", 0), c.get("min_cluster_size", 5), **scored)
    pipeline.snapshot(c["output_dir"])("final", out)
    return out
