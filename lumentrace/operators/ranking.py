"""Windows, top-k, pages and samples. Every order ends in a unique key, so results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.sources import loaders


def keep_first(df: DataFrame, key: list[str], *order: str | Column) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_k(df: DataFrame, by: list[str], value: str, k: int, *ties: str) -> DataFrame:
    """The k largest values of each group with their rank; nulls never count."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc(), *ties)
    return df.where(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def ranked(df: DataFrame, value: str) -> DataFrame:
    """Rank by a value, largest first, on a table of one row for each model; nulls are left out."""
    return df.where(F.col(value).isNotNull()).withColumn("rank", F.rank().over(Window.orderBy(F.col(value).desc())).cast("long"))


def failure_runs(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Runs of failures (``ok`` false) between successes in order: their first place and length; null ``ok`` neither counts nor ends a run."""
    seen = rows.where("ok is not null")
    w = Window.partitionBy(*by).orderBy(*order)
    island = F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return seen.withColumn("island", island).where("not ok").groupBy(*by, "island").agg(F.count("*").alias("run_length"), F.min(order[0]).alias("run_start"))


def examples(rows: DataFrame, by: list[str], order: str, n: int = 3) -> DataFrame:
    """The first n rows of each group, numbered."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long")).where(F.col("n") <= n)


def renumbered(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows with a dense id of their key in order of first appearance; the distinct keys are numbered by ranges."""
    firsts = rows.groupBy(*key).agg(F.min(order).alias("_first"))
    ids = loaders.indexed(firsts, "_first", *key).withColumn("new_id", F.col("row_idx").cast("int")).drop("_first", "row_idx")
    return rows.join(ids, key)


def small_to_outliers(rows: DataFrame, label: str, least: int, group: str | None = None) -> DataFrame:
    """Rows whose label is null or has fewer than ``least`` rows get the outlier label, one for each group if there are groups."""
    name = F.lit("Outliers") if group is None else F.concat(F.lit("Outliers - "), F.coalesce(F.col(group).cast("string"), F.lit("none")))
    sizes = rows.groupBy(label).agg(F.count("*").alias("_size"))
    out = rows.join(sizes, label, "left")
    return out.withColumn(label, F.when(F.col(label).isNull() | (F.col("_size") < least), name).otherwise(F.col(label))).drop("_size")


def page(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    return df.orderBy(order).offset(offset).limit(limit)


def hash_order(*keys: str, seed: int = 42) -> Column:
    """An order that looks random and depends on keys and seed alone."""
    return F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def sample_rows(df: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """Exactly n rows, or all if there are fewer, the same whatever the partitions."""
    return df.orderBy(hash_order(*keys, seed=seed), *keys).limit(n)


def sample_prompts(df: DataFrame, n: int, prompt: str = "prompt", seed: int = 42) -> DataFrame:
    """About n rows with as many of each model: n / models prompts that all models answered, or else that many prompts of each model."""
    models = df.select("model").distinct().count()
    k = n // max(1, models)
    if k < 1:
        raise ValueError("the sample is smaller than the number of models")
    full = df.groupBy(prompt).agg(F.count_distinct("model").alias("m")).where(F.col("m") == models)
    if full.limit(k).count() == k:
        chosen = full.orderBy(hash_order(prompt, seed=seed), prompt).limit(k).select(prompt)
        return df.join(chosen, prompt, "left_semi")
    return sample_each(df, k, prompt, seed)


def sample_each(df: DataFrame, k: int, prompt: str = "prompt", seed: int = 42) -> DataFrame:
    """The rows of k prompts of each model."""
    pairs = df.select("model", prompt).distinct()
    w = Window.partitionBy("model").orderBy(hash_order(prompt, seed=seed), prompt)
    return df.join(pairs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n"), ["model", prompt], "left_semi")


def sample_members(rows: DataFrame, by: list[str], key: str, n: int = 50, seed: int = 42) -> DataFrame:
    """At most n members of each cluster."""
    w = Window.partitionBy(*by).orderBy(hash_order(key, seed=seed), key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def until_budget(messages: DataFrame, by: list[str], order: str, text: str, budget: int) -> DataFrame:
    """Messages in order while the running number of tokens (words) stays within the budget; the one that crosses it is cut.

    Null text is free and always passes.
    """
    tokens = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.filter(F.split(F.col(text), r"[ \t\n\r]+"), lambda t: t != "")))
    w = Window.partitionBy(*by).orderBy(order)
    before = F.coalesce(F.sum("_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = messages.withColumn("_tokens", tokens).withColumn("_before", before).where(F.col(text).isNull() | (F.col("_before") < budget))
    words = F.filter(F.split(F.col(text), r"[ \t\n\r]+"), lambda t: t != "")
    cut = F.array_join(F.slice(words, 1, F.greatest(F.lit(budget) - F.col("_before"), F.lit(1)).cast("int")), " ")
    return out.withColumn(text, F.when(F.col("_before") + F.col("_tokens") > budget, cut).otherwise(F.col(text))).drop("_tokens", "_before")
