"""Behaviour metrics: how often each model shows each behaviour cluster, and how quality goes with it.

``facts`` holds (conversation_id, model, cluster), one row for each property; ``scores`` holds (conversation_id, model) and
one column for each metric. Null means no data. Denominators count distinct (conversation, model), numerators distinct
(conversation, model, cluster), so the levels are aggregated from their own deduplicated rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.session import dealt

#: Cluster labels that form no group of their own, though their rows stay in the denominators.
NO_CLUSTER = ("", "No properties")
PAIR = ["conversation_id", "model"]


def metric_names(scores: DataFrame) -> list[str]:
    return sorted(c for c in scores.columns if c not in PAIR)


def in_cluster() -> Column:
    return F.col("cluster").isNotNull() & ~F.col("cluster").isin(*NO_CLUSTER)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or there is none."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def other_models_mean(value: str, *by: str) -> Column:
    """Mean of ``value`` over the other rows of a group; 0 where the row is alone."""
    w = Window.partitionBy(*by)
    return F.coalesce(F.try_divide(F.sum(value).over(w) - F.col(value), (F.count("*").over(w) - 1).cast("double")), F.lit(0.0))


def scored_triples(facts: DataFrame, scores: DataFrame) -> DataFrame:
    """Distinct (conversation, model, cluster) rows with the score columns.

    Rows are dealt by conversation and model, which serves the distinct rows, the join and the pairs.
    """
    return dealt(facts.select(*PAIR, "cluster"), *PAIR).distinct().join(scores, PAIR, "left")


def pairs_of(triples: DataFrame, names: list[str]) -> DataFrame:
    """The (conversation, model) rows of scored triples, with the score columns."""
    return triples.groupBy(*PAIR).agg(F.count("*").alias("_n"), *[F.first(m).alias(m) for m in names]).drop("_n")


def scored_pairs(facts: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversation, model) rows and (conversation, model, cluster) rows, both with the score columns.

    Facts are reduced to distinct triples once; the pairs come from those, and one join brings the scores.
    """
    triples = scored_triples(facts, scores)
    return pairs_of(triples, metric_names(scores)), triples.where(in_cluster())


def _means(names: list[str], prefix: str = "quality_") -> list[Column]:
    return [F.avg(m).alias(f"{prefix}{m}") for m in names]


def model_cluster_metrics(facts: DataFrame, scores: DataFrame) -> DataFrame:
    """A row for every model and cluster, absent pairs too: size, proportion, proportion_delta, quality_*, quality_delta_*."""
    names = metric_names(scores)
    pairs, triples = scored_pairs(facts, scores)
    cells = triples.groupBy("model", "cluster").agg(F.count("*").alias("size"), *_means(names))
    models = pairs.groupBy("model").agg(F.count("*").alias("model_size"), *_means(names, "model_"))
    clusters = triples.select("cluster").distinct()
    dense = models.crossJoin(clusters).join(cells, ["model", "cluster"], "left").withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
    dense = dense.withColumn("proportion", ratio(F.col("size"), F.col("model_size")))
    delta = F.col("proportion") - other_models_mean("proportion", "cluster")
    quality = [(F.col(f"quality_{m}") - F.col(f"model_{m}")).alias(f"quality_delta_{m}") for m in names]
    return dense.select("model", "cluster", "size", "proportion", delta.alias("proportion_delta"), *[f"quality_{m}" for m in names], *quality)


def cluster_metrics(facts: DataFrame, scores: DataFrame) -> DataFrame:
    """A row for every cluster over all models; total_unique_conversations counts conversations whatever the model."""
    names = metric_names(scores)
    pairs, triples = scored_pairs(facts, scores)
    cells = triples.groupBy("cluster").agg(F.count("*").alias("size"), F.count_distinct("conversation_id").alias("total_unique_conversations"), *_means(names))
    whole = pairs.agg(F.count("*").alias("all_size"), *_means(names, "all_"))
    quality = [(F.col(f"quality_{m}") - F.col(f"all_{m}")).alias(f"quality_delta_{m}") for m in names]
    return cells.crossJoin(F.broadcast(whole)).select(
        "cluster", "size", ratio(F.col("size"), F.col("all_size")).alias("proportion"), "total_unique_conversations", *[f"quality_{m}" for m in names], *quality
    )


def model_metrics(facts: DataFrame, scores: DataFrame) -> DataFrame:
    """A row for every model: size and quality, and how far its quality lies from that of all rows."""
    names = metric_names(scores)
    pairs, triples = scored_pairs(facts, scores)
    grouped = triples.select(*PAIR).distinct().groupBy("model").agg(F.count("*").alias("size"))
    cells = pairs.groupBy("model").agg(F.count("*").alias("model_size"), *_means(names))
    whole = pairs.agg(F.count("*").alias("all_size"), *_means(names, "all_"))
    out = cells.join(grouped, "model", "left").crossJoin(F.broadcast(whole))
    size = F.coalesce("size", F.lit(0)).cast("long")
    quality = [(F.col(f"quality_{m}") - F.col(f"all_{m}")).alias(f"quality_delta_{m}") for m in names]
    return out.select("model", size.alias("size"), ratio(size, F.col("model_size")).alias("proportion"), *[f"quality_{m}" for m in names], *quality)


def with_metadata(cells: DataFrame, facts: DataFrame, examples: int = 3) -> DataFrame:
    """Add ``examples``, the first conversations of each (model, cluster) by id, as an array; empty where there are none."""
    w = Window.partitionBy("model", "cluster").orderBy("conversation_id")
    few = facts.where(in_cluster()).select("model", "cluster", "conversation_id").distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= examples)
    shown = few.groupBy("model", "cluster").agg(F.sort_array(F.collect_list("conversation_id")).alias("examples"))
    return cells.join(shown, ["model", "cluster"], "left").withColumn("examples", F.coalesce("examples", F.array().cast(shown.schema["examples"].dataType)))


def subset_metrics(facts: DataFrame, scores: DataFrame, included: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Model x cluster metrics of the facts whose ``property_id`` is among ``included``.

    Unlike ``model_cluster_metrics``, salience compares with the cluster's share over all rows, groups with a null label
    are kept, and ``totals`` (model, total) may give denominators from outside.
    """
    names = metric_names(scores)
    chosen = facts.join(included.select("property_id").distinct(), "property_id", "left_semi").select(*PAIR, "cluster").distinct()
    rows = chosen.join(scores, PAIR, "left")
    if totals is None:
        totals = chosen.select(*PAIR).distinct().groupBy("model").agg(F.count("*").alias("total"))
    cells = rows.groupBy("model", "cluster").agg(F.count("*").alias("size"), *_means(names))
    whole, of_cluster = Window.partitionBy(), Window.partitionBy("cluster")
    share = ratio(F.sum("size").over(of_cluster), F.sum("size").over(whole))
    out = cells.withColumn("share", share).join(totals, "model", "left").withColumn("proportion", ratio(F.col("size"), F.col("total")))
    return out.select("model", "cluster", "size", "proportion", (F.col("proportion") - F.col("share")).alias("proportion_delta"), *[f"quality_{m}" for m in names])


def conversations_by_model(facts: DataFrame) -> DataFrame:
    """Distinct conversations of each model; blank models are left out."""
    return facts.where(F.trim("model") != "").groupBy("model").agg(F.count_distinct("conversation_id").alias("total"))


def long_scores(scores: DataFrame) -> DataFrame:
    """(conversation_id, model, metric, value) of the non-null scores."""
    names = metric_names(scores)
    return scores.unpivot(PAIR, names, "metric", "value").where("value is not null")


def inferred_metrics(long: DataFrame) -> DataFrame:
    """Metric names with the number of scores; the union over all rows, not the first row's keys."""
    return long.groupBy("metric").agg(F.count("*").alias("n"))


def significant(lower: str, upper: str) -> Column:
    """Whether an interval excludes 0; null where there is none."""
    return ~((F.col(lower) <= 0) & (F.col(upper) >= 0))


def stacked(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
