"""Between long, wide and nested shapes; scores as columns, maps and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrace.session import dealt

# Words in the names of numeric columns that are taken for scores, and columns that never are.
SCORE_WORDS = ("score", "rating", "quality", "helpfulness", "accuracy", "correctness", "fluency", "coherence", "relevance")
NO_SCORES = ("question_id", "id", "size", "cluster_id")


def rename(df: DataFrame, mapping: dict[str, str], required: list[str]) -> DataFrame:
    """Columns renamed to the required names; ValueError names mapped columns that do not exist."""
    if missing := [v for v in mapping.values() if v not in df.columns]:
        raise ValueError(f"mapped columns not found: {', '.join(missing)}")
    out = df.withColumnsRenamed({v: k for k, v in mapping.items()})
    if lacking := [c for c in required if c not in out.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return out


def scores_to_map(df: DataFrame, columns: list[str], suffix: str = "", to: str = "score") -> DataFrame:
    """A map of metric to number from columns; text is read as a number where it is one, nulls and NaN are left out."""
    names = [c.removesuffix(suffix) for c in columns]
    values = F.array(*[F.nullif(F.col(c).try_cast("double"), F.lit(float("nan"))) for c in columns])
    return df.withColumn(to, F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), values), lambda _, v: v.isNotNull())).drop(*columns)


def scores_to_columns(df: DataFrame, metrics: list[str], column: str = "score", prefix: str = "score_") -> DataFrame:
    return df.select(*[c for c in df.columns if c != column], *[F.col(column)[m].alias(f"{prefix}{m}") for m in metrics])


def score_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose names tell of scores and not of ids or sizes."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]
    return [c for c in numeric if any(w in c.lower() for w in SCORE_WORDS) and c not in NO_SCORES and not c.endswith("_id")]


def parsed_score(column: str, missing_is_zero: bool = False) -> Column:
    """A score given as JSON object or number in text: a map, empty where there is none (or 0 if asked)."""
    as_map = F.from_json(F.col(column), "map<string,double>")
    number = F.col(column).try_cast("double")
    none = F.create_map(F.lit("score"), F.lit(0.0)) if missing_is_zero else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return F.coalesce(F.when(number.isNull(), as_map), F.when(number.isNotNull(), F.create_map(F.lit("score"), number)), none)


def winner_scores(winner: str = "winner", a: str = "model_a", b: str = "model_b") -> tuple[Column, Column]:
    """+1 and -1 by the winner's name or side, 0 and 0 for any kind of tie, nulls otherwise."""
    w = F.col(winner)
    won_a, won_b = (w == F.col(a)) | (w == "model_a"), (w == F.col(b)) | (w == "model_b")
    tie = F.contains(F.lower(w), F.lit("tie"))
    pick = lambda x, y: F.when(won_a, F.lit(x)).when(won_b, F.lit(y)).when(tie, F.lit(0.0))
    return pick(1.0, -1.0), pick(-1.0, 1.0)


def side_to_tidy(df: DataFrame, keep: list[str], values: list[str]) -> DataFrame:
    """Two rows for each battle, one for each side, in one scan."""
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"model_{s}").alias("model"), *[F.col(f"{v}_{s}").alias(v) for v in values])
    return df.select(*keep, F.inline(F.array(side("a"), side("b"))))


def exploded_members(clusters: DataFrame) -> DataFrame:
    """Aligned member lists as rows with their positions; shorter lists give nulls. Positions go on from ``first`` where a cluster takes several rows."""
    place = F.col("member_pos") + F.col("first") if "first" in clusters.columns else F.col("member_pos")
    zipped = F.arrays_zip("property_ids", "property_descriptions", "question_ids")
    kept = [c for c in ("cluster_id", "cluster_label", "first") if c in clusters.columns]
    rows = clusters.select(*kept, F.posexplode_outer(zipped).alias("member_pos", "m"))
    return rows.select("cluster_id", "cluster_label", place.alias("member_pos"), F.col("m.property_ids").alias("property_id"), F.col("m.property_descriptions").alias("property_description"), F.col("m.question_ids").alias("question_id"))


def sanitized(name: str | Column) -> Column:
    """Metric names for columns: parentheses go; space, slash and dash become underscores."""
    column = F.col(name) if isinstance(name, str) else name
    return F.translate(F.regexp_replace(column, "[()]", ""), " /-", "___")


def sanitized_names(names: list[str]) -> dict[str, str]:
    """Column names of metrics; ValueError where two fall together."""
    out = {n: n.replace("(", "").replace(")", "").replace(" ", "_").replace("/", "_").replace("-", "_") for n in names}
    if len(set(out.values())) < len(out):
        raise ValueError(f"metric names fall together: {sorted(names)}")
    return out


def wide(long: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """One column for each metric of a long (by..., metric, value) table, in one aggregation of rows dealt by ``by``."""
    values = [F.first(F.when(F.col("metric") == m, F.col("value")), ignorenulls=True).alias(m) for m in metrics]
    return dealt(long, *by).groupBy(*by).agg(*values)


def long(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(by, columns, "metric", "value").where("value is not null")


def nested_by_model(cells: DataFrame, value: str) -> DataFrame:
    """(model, clusters): a map of cluster to value for each model."""
    return cells.groupBy("model").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cluster", value)))).alias("clusters"))


def flat_of_nested(nested: DataFrame, value: str) -> DataFrame:
    return nested.select("model", F.explode("clusters").alias("cluster", value))


def heatmap(cells: DataFrame, value: str, clusters: list[str]) -> DataFrame:
    """Model x cluster matrix."""
    return cells.groupBy("model").pivot("cluster", clusters).agg(F.first(value))


def quality_metrics(columns: list[str]) -> list[str]:
    """Names of quality metrics in the columns of a metric table, without deltas and intervals."""
    rest = [c.removeprefix("quality_") for c in columns if c.startswith("quality_") and not c.startswith("quality_delta_")]
    return sorted(c for c in rest if "_ci_" not in c and not c.endswith("_significant"))


def flattened(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """A struct's leaves as columns with dotted names; a null struct gives nulls."""
    from pyspark.sql import types as T

    def leaves(kind: T.DataType, path: list[str]) -> list[list[str]]:
        return [x for f in kind for x in leaves(f.dataType, [*path, f.name])] if isinstance(kind, T.StructType) else [path]

    found = leaves(df.schema[column].dataType, [])
    get = lambda path: F.col(".".join(f"`{x}`" for x in (column, *path)))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], *[get(p).alias(prefix + ".".join(p)) for p in found])
