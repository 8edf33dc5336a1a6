"""Reading and writing tables and datasets. Paths go through Spark's readers, so any store it knows will do."""

from __future__ import annotations

import ast
import json
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumentrace.session import written


def load(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """A table by its suffix: csv with header, jsonl, json (one document), or parquet."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')
    if suffix in ("jsonl", "ndjson"):
        return spark.read.json(path, multiLine=bool(multiline))
    if suffix == "json":
        return spark.read.json(path, multiLine=multiline is not False)
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown kind of file: {path}")


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows of Python objects with the union of their keys, in order of first appearance."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    if not rows:
        return spark.createDataFrame([], T.StructType([]))
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], names, samplingRatio=1.0)


def json_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(value): lines that are not blank, as variants; lines that are no JSON are null. ``limit`` counts lines before that."""
    lines = spark.read.text(path)
    lines = lines.limit(limit) if limit is not None else lines
    return lines.where(F.length(F.trim("value")) > 0).select(F.try_parse_json("value").alias("value"))


def detect_method(df: DataFrame) -> str | None:
    """side_by_side or single_model by the columns that are there; None if neither fits."""
    have = set(df.columns)
    if {"prompt", "model_a", "model_b", "model_a_response", "model_b_response"} <= have:
        return "side_by_side"
    return "single_model" if {"prompt", "model", "model_response"} <= have else None


def resolve(spark: SparkSession, rows: list[dict] | None = None, path: str | None = None, method: str | None = None) -> tuple[DataFrame, str | None]:
    """The first source given, and the method given or detected."""
    if rows is not None:
        df = from_rows(spark, rows)
    elif path is not None:
        df = load(spark, path)
    else:
        raise ValueError("no source given")
    return df, method or detect_method(df)


def indexed(df: DataFrame, *order: str) -> DataFrame:
    """Rows with row_idx from 0 in the given order; a conversation without question_id is known by it."""
    # written, since ranges that are drawn twice may differ
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "indexed")
    at = parts.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    size = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    before = size.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    return at.join(F.broadcast(before), "_part").withColumn("row_idx", (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before")


def meta(df: DataFrame, known: list[str]) -> DataFrame:
    """Columns that are not known as one JSON text, which leaves out nulls."""
    rest = [c for c in df.columns if c not in known]
    return df.select(*[c for c in known if c in df.columns], (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("meta"))


def precomputed_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(value, embedding): the first column whose name holds ``embedding`` and the text column that it belongs to."""
    df = spark.read.parquet(path)
    vector = next((c for c in df.columns if "embedding" in c.lower()), None)
    if vector is None:
        raise ValueError(f"no embedding column in {path}")
    base = vector.lower().replace("_embedding", "").replace("embedding", "")
    text = next((c for c in df.columns if c.lower() == base), None) or next(c for c, t in df.dtypes if t == "string")
    return df.select(F.col(text).alias("value"), F.col(vector).cast("array<float>").alias("embedding"))


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(*[F.when(~bad(F.col(c)), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Write parquet, or json lines with null for numbers that JSON lacks."""
    if kind == "parquet":
        df.write.mode(mode).parquet(path)
    elif kind in ("json", "jsonl", "dataframe"):
        json_safe(df).write.mode(mode).option("ignoreNullFields", "false").json(path)
    else:
        raise ValueError(f"unknown kind of output: {kind}")


def save_clusters(rows: DataFrame, path: str, embeddings: bool = False) -> None:
    """Full rows as parquet and as light json lines without vectors; vectors apart if asked."""
    vectors = [c for c in rows.columns if "embedding" in c.lower()]
    save(rows.drop(*vectors), f"{path}/clustered_results.parquet")
    save(rows.drop(*vectors), f"{path}/clustered_results.jsonl", "jsonl")
    if embeddings and vectors:
        save(rows.select("property_id", *vectors), f"{path}/embeddings.parquet")


def save_metrics(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        save(df, f"{path}/{name}_df.jsonl", "jsonl")


def load_metrics(spark: SparkSession, path: str) -> dict[str, DataFrame | None]:
    """The metric tables that are there, from JSON lines or else from a JSON array, None for the others."""
    from pyspark.sql.utils import AnalysisException

    out: dict[str, DataFrame | None] = {}
    for name in ("model_cluster_scores", "cluster_scores", "model_scores"):
        out[name] = None
        for suffix, array in (("_df.jsonl", False), ("_df.json", True), (".json", True)):
            try:
                out[name] = spark.read.json(f"{path}/{name}{suffix}", multiLine=array)
                break
            except AnalysisException:
                continue
    return out


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def results_page(spark: SparkSession, path: str, name: str, page: int = 0, size: int = 100, order: str = "row_idx") -> DataFrame | None:
    """A page of a table in a folder of results, from parquet or else JSON lines; rows without a description are left out; None if it is not there."""
    from pyspark.sql.utils import AnalysisException

    for read, suffix in ((spark.read.parquet, "parquet"), (spark.read.json, "jsonl")):
        try:
            df = read(f"{path}/{name}.{suffix}")
        except AnalysisException:
            continue
        if "property_description" in df.columns:
            df = df.where(F.coalesce(F.trim("property_description"), F.lit("")) != "")
        by = [c for c in (order, "question_id", "property_id", *df.columns) if c in df.columns]
        return df.orderBy(*dict.fromkeys(by)).offset(page * size).limit(size)
    return None


def save_events(rows: DataFrame, path: str, kind: str = "property") -> None:
    """One JSON line for each row, with its kind, for readers that take results line by line."""
    rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*rows.columns).alias(kind))).alias("value")).write.mode("overwrite").text(path)


def as_input(conversations: DataFrame) -> DataFrame:
    """Conversations of a dataset (question_id, prompt, model, model_response, scores...) under the names of input columns, scores as one JSON text."""
    known = [c for c in ("question_id", "prompt", "model", "model_response") if c in conversations.columns]
    numbers = [c for c, t in conversations.dtypes if t in ("double", "float") and c not in known]
    return conversations.select(*known, *([F.to_json(F.struct(*numbers)).alias("score")] if numbers else []))


def literals_to_json(df: DataFrame, *columns: str) -> DataFrame:
    """Columns of text in which objects stand as Python literals, with those as JSON; other text stays as it is."""
    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if x is None or not x.lstrip().startswith(("{", "[", "(")):
                return x
            try:
                return json.dumps(ast.literal_eval(x.strip()), ensure_ascii=False)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                return x

        return values.map(one)

    plain = lambda c: F.try_parse_json(c).isNotNull() | ~F.rlike(F.ltrim(c), F.lit(r"^[\[{(]"))
    return df.withColumns({c: F.when(plain(F.col(c)), F.col(c)).otherwise(convert(F.col(c))) for c in columns})
