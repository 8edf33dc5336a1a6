"""Row selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The behaviour types that a property may have.
BEHAVIOR_TYPES = ("Positive", "Negative (critical)", "Negative (non-critical)", "Style")


def _among(column: str, values: list) -> Column:
    some = [v for v in values if v is not None]
    found = F.coalesce(F.col(column).isin(*some), F.lit(False)) if some else F.lit(False)
    return found | F.col(column).isNull() if None in values else found


def select(df: DataFrame, include: dict[str, list] | None = None, exclude: dict[str, list] | None = None) -> DataFrame:
    """Rows that match every include list and no exclude list.

    A list matches any of its values; unknown columns and empty lists are ignored; null matches only where it is listed.
    """
    for column, values in (include or {}).items():
        if column in df.columns and values:
            df = df.where(_among(column, values))
    for column, values in (exclude or {}).items():
        if column in df.columns and values:
            df = df.where(~_among(column, values))
    return df


def blank(column: str) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) == ""


def valid_property(description: str = "property_description", behavior: str = "behavior_type") -> Column:
    """A description that is not blank and a behaviour type that is blank or allowed."""
    return ~blank(description) & (blank(behavior) | F.coalesce(F.col(behavior).isin(*BEHAVIOR_TYPES), F.lit(False)))


def split_valid(properties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and invalid properties."""
    return properties.where(valid_property()), properties.where(~valid_property())


def of_known_models(properties: DataFrame, models: DataFrame) -> DataFrame:
    return properties.join(models.select("model").distinct(), "model", "left_semi")


def by_models(df: DataFrame, models: list[str], column: str = "model") -> DataFrame:
    return df.where(F.col(column).isin(*models)) if models else df


def bypassed(df: DataFrame, keep_positive: bool) -> tuple[DataFrame, DataFrame]:
    """Rows to cluster, and positive ones that are not clustered; those come back with id -2."""
    if keep_positive:
        return df, df.limit(0)
    positive = F.coalesce(F.col("behavior_type") == "Positive", F.lit(False))
    return df.where(~positive), df.where(positive)


def valid_members(clusters: DataFrame) -> DataFrame:
    """Clusters whose member arrays hold no blank or placeholder description, with their sizes counted again."""
    kept = F.filter(F.arrays_zip("property_descriptions", "property_ids", "question_ids"), lambda m: (F.coalesce(F.trim(m["property_descriptions"]), F.lit("")) != "") & (m["property_descriptions"] != "No properties"))
    out = clusters.withColumn("kept", kept).withColumns({c: F.col(f"kept.{c}") for c in ("property_descriptions", "property_ids", "question_ids")})
    return out.withColumns({"size": F.size("kept").cast("long"), "total_unique_conversations": F.size(F.array_distinct("question_ids")).cast("long")}).drop("kept")


def require_columns(df: DataFrame, required: list[str]) -> None:
    """ValueError that names the missing columns in order."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def reject_unknown_models(df: DataFrame) -> DataFrame:
    """The rows, with an error at run time where a model is called unknown."""
    check = F.assert_true(F.coalesce(F.lower("model") != "unknown", F.lit(True)), F.lit("a property has the model 'unknown'"))
    return df.where(check.isNull())


def of_type_and_impact(properties: DataFrame, behavior: str | None = None, impacts: tuple[str, ...] = ("high", "medium"), column: str = "impact") -> DataFrame:
    """Properties whose behaviour type holds a text, in any case, and whose impact, where there is such a column, is one of some."""
    if behavior:
        properties = properties.where(F.contains(F.lower("behavior_type"), F.lit(behavior.lower())))
    return properties.where(F.lower(F.trim(column)).isin(*impacts)) if column in properties.columns else properties
