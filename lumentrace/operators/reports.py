"""Frames behind reports, dashboards and plots; each is a small table by its nature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.operators.reshape import quality_metrics


def tidy_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by..., metric, value, ci_lower, ci_upper): one row for each cell and quality metric, for bars with error bars."""
    rows = []
    for m in quality_metrics(cells.columns):
        bounds = [F.col(f"quality_{m}_ci_{b}") if f"quality_{m}_ci_{b}" in cells.columns else F.lit(None).cast("double") for b in ("lower", "upper")]
        rows.append(F.struct(F.lit(m).alias("metric"), F.col(f"quality_{m}").alias("value"), bounds[0].alias("ci_lower"), bounds[1].alias("ci_upper")))
    return cells.select(*by, F.inline(F.array(*rows)))


def error_bars(tidy: DataFrame) -> DataFrame:
    return tidy.withColumns({"plus": F.col("ci_upper") - F.col("value"), "minus": F.col("value") - F.col("ci_lower")})


def heatmap_order(cells: DataFrame, axis: str, value: str) -> DataFrame:
    """Rows with the place of their model or cluster by mean value, largest first."""
    mean = cells.groupBy(axis).agg(F.avg(value).alias("_mean"))
    return cells.join(mean.withColumn("place", F.row_number().over(Window.orderBy(F.col("_mean").desc(), axis)).cast("long")).drop("_mean"), axis)


def tracker_rows(df: DataFrame, examples: int = 5) -> DataFrame:
    """Rows for a table of an experiment tracker: few examples, nested values as JSON, null text as None."""
    out = []
    for name, kind in df.dtypes:
        if kind.startswith("array"):
            out.append(F.to_json(F.slice(name, 1, examples)).alias(name))
        elif kind.startswith(("map", "struct")):
            out.append(F.to_json(name).alias(name))
        else:
            out.append(F.coalesce(F.col(name), F.lit("None")).alias(name) if kind == "string" else F.col(name))
    return df.select(*out)


def payload(tables: dict[str, DataFrame]) -> dict:
    """Metric tables as records with their models, clusters and metrics: what a page shows at once."""
    cells = tables["model_cluster_scores"]
    return {
        **{name: [r.asDict(recursive=True) for r in df.collect()] for name, df in tables.items()},
        "models": sorted(r[0] for r in cells.select("model").distinct().collect()),
        "clusters": sorted(r[0] for r in cells.select("cluster").distinct().collect()),
        "metrics": quality_metrics(cells.columns),
    }


def summary_lines(cells: DataFrame, models: DataFrame, questions: int, k: int = 3) -> DataFrame:
    """(part, place, line) of a plain text: a heading, models by their first quality metric, and the k most frequent clusters of each model."""
    names = quality_metrics(models.columns)
    size = models.agg(F.format_string(f"{questions} conversations, %d models", F.count("*")).alias("line"))
    out = size.select(F.lit(0).alias("part"), F.lit(1).alias("place"), "line")
    if names:
        first = F.col(f"quality_{names[0]}")
        # as many rows as there are models
        ranked = models.where(first.isNotNull()).withColumn("place", F.row_number().over(Window.orderBy(first.desc(), "model")))
        out = out.unionByName(ranked.select(F.lit(1).alias("part"), "place", F.format_string(f"%d. %s: {names[0]} %.3f", "place", "model", first).alias("line")))
    w = Window.partitionBy("model").orderBy(F.col("proportion").desc(), "cluster")
    top = cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    top = top.withColumn("place", F.row_number().over(Window.orderBy("model", "rank")))
    return out.unionByName(top.select(F.lit(2).alias("part"), "place", F.format_string("%s: %s in %.1f%%", "model", "cluster", F.col("proportion") * 100).alias("line")))


def summary_text(cells: DataFrame, models: DataFrame, questions: int, k: int = 3) -> str:
    """The lines of ``summary_lines``, of which there are k + 1 for each model, as one text."""
    return "\n".join(r.line for r in summary_lines(cells, models, questions, k).orderBy("part", "place").collect())


def save_summary(lines: DataFrame, path: str) -> None:
    """The lines as a text file."""
    lines.coalesce(1).sortWithinPartitions("part", "place").select("line").write.mode("overwrite").text(path)


def file_counts(spark, paths: dict[str, str]) -> dict[str, int]:
    """Lines of each text artefact; 0 for one that is not there."""
    from pyspark.sql.utils import AnalysisException

    out = {}
    for name, path in paths.items():
        try:
            out[name] = spark.read.text(path).count()
        except AnalysisException:
            out[name] = 0
    return out
