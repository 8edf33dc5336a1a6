"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.sources import loaders


def preview(df: DataFrame, by: str, columns: list[str] | None = None) -> DataFrame:
    """Count and mean of the numeric columns for each value, null included."""
    numeric = [c for c, t in df.dtypes if c != by and (t in ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean") or t.startswith("decimal"))]
    chosen = [c for c in numeric if columns is None or c in columns]
    return df.groupBy(by).agg(F.count("*").alias("count"), *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in chosen])


def summary_table(rows: DataFrame) -> DataFrame:
    """For each (cluster, model): count, share of the model's rows, and that share against the median of the cluster's shares."""
    cells = rows.groupBy("cluster", "model").agg(F.count("*").alias("count"))
    total = Window.partitionBy("model")
    share = cells.withColumn("percent", F.col("count") / F.sum("count").over(total) * 100)
    median = F.percentile("percent", F.lit(0.5)).over(Window.partitionBy("cluster"))
    return share.withColumn("ratio_to_median", F.try_divide(F.col("percent"), median))


def size_statistics(rows: DataFrame, outlier: str = "Outliers") -> DataFrame:
    """Clusters, outliers and their rate, and the least, mean and largest size of the clusters proper, as one row."""
    size = rows.groupBy("cluster").agg(F.count("*").alias("size"))
    proper = F.when(F.col("cluster") != outlier, F.col("size"))
    return size.agg(
        F.count(proper).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("cluster") == outlier, F.col("size"))), F.lit(0)).cast("long").alias("n_outliers"),
        F.coalesce(F.try_divide(F.coalesce(F.sum(F.when(F.col("cluster") == outlier, F.col("size"))), F.lit(0)).cast("double"), F.sum("size").cast("double")), F.lit(0.0)).alias("outlier_rate"),
        F.min(proper).alias("min_size"),
        F.avg(proper).alias("avg_size"),
        F.max(proper).alias("max_size"),
    )


def clusters_of(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Clusters with their members as aligned arrays in order of row_idx, and the label of the first.

    A row holds at most ``most`` members, so a cluster of more takes several rows; ``first`` is the place of a row's first
    member in its cluster, ``size`` the size of the cluster. Rows without a cluster_id make one cluster of their own.
    """
    at = loaders.indexed(rows.withColumnRenamed("row_idx", "_order"), "cluster_id", "_order", "property_id")
    whole = at.groupBy(F.col("cluster_id").alias("_id")).agg(F.min("row_idx").alias("_start"), F.count("*").alias("size"), F.min_by("cluster_label", "row_idx").alias("_label"))
    placed = at.join(whole, F.col("cluster_id").eqNullSafe(F.col("_id"))).withColumn("_first", F.expr(f"(row_idx - _start) div {most} * {most}"))
    members = F.sort_array(F.collect_list(F.struct("row_idx", "property_id", "property_description", "question_id")))
    out = placed.groupBy("cluster_id", F.col("_first").alias("first")).agg(F.first("_label").alias("cluster_label"), F.first("size").alias("size"), members.alias("m"))
    return out.select("cluster_id", "cluster_label", "size", "first", F.col("m.property_id").alias("property_ids"), F.col("m.property_description").alias("property_descriptions"), F.col("m.question_id").alias("question_ids"))


def labelled(taxonomy: DataFrame, rows: DataFrame) -> DataFrame:
    """Every label of a taxonomy with the number of its rows, 0 included."""
    size = rows.groupBy("label").agg(F.count("*").alias("size"))
    return taxonomy.join(size, "label", "left").withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))


def counts(rows: DataFrame, column: str, missing: str | None = None) -> DataFrame:
    key = F.coalesce(F.col(column), F.lit(missing)) if missing is not None else F.col(column)
    return rows.groupBy(key.alias(column)).agg(F.count("*").alias("count"))


def summary_stats(cells: DataFrame, flag: str) -> DataFrame:
    """Distinct models and clusters, and how many cells a flag marks, as one row."""
    return cells.agg(F.count_distinct("model").alias("n_models"), F.count_distinct("cluster").alias("n_clusters"), F.coalesce(F.sum(F.col(flag).cast("int")), F.lit(0)).cast("long").alias("n_flagged"))


def distinct_examples(cells: DataFrame) -> DataFrame:
    """Distinct conversations among the nested examples, as one row."""
    return cells.select(F.explode("examples").alias("id")).agg(F.count_distinct("id").alias("n_battles"))


def models_of(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct models over one column or the two sides of battles."""
    return df.select(F.explode(F.array(*columns)).alias("model")).where("model is not null").distinct()


def extraction_stats(rows: DataFrame, response: str = "raw_response") -> DataFrame:
    """Responses, failures, their rate of success, and the mean length of those that came, as one row."""
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(response).isNull()).alias("failures"),
        F.coalesce(F.try_divide(F.count(response).cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("success_rate"),
        F.avg(F.length(response).cast("double")).alias("avg_length"),
    )
