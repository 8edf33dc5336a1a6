"""Joins of conversations, properties, scores and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.session import written

#: Characters of texts that are broadcast at most with what was found for them.
SMALL = 1 << 20


def conversations_with_properties(conversations: DataFrame, properties: DataFrame, side_by_side: bool = False) -> DataFrame:
    """Every conversation with its properties; those without keep a row of nulls.

    Side by side, a property's model is the property's own, or the conversation's where it has none.
    """
    if not side_by_side:
        return conversations.join(properties, ["question_id", "model"], "left")
    both = conversations.withColumnRenamed("model", "conversation_model").join(properties, "question_id", "left")
    return both.withColumn("model", F.coalesce("model", "conversation_model")).drop("conversation_model")


def members_with_properties(members: DataFrame, properties: DataFrame) -> DataFrame:
    """Cluster members whose property exists, joined on the property's id."""
    return members.join(properties, "property_id")


def with_scores(facts: DataFrame, scores: DataFrame, keys=("conversation_id", "model")) -> DataFrame:
    return facts.join(scores, list(keys), "left")


def by_id_or_base(left: DataFrame, right: DataFrame, key: str = "id", sep: str = "-") -> DataFrame:
    """Left rows with the right row of the same id, or else of the same id up to the first separator.

    Two equi joins, so no pair of ids is compared twice; the smallest right id wins among those with the same base.
    """
    r = right.withColumnRenamed(key, "matched_id")
    exact = left.join(r, left[key] == r["matched_id"], "left")
    base = F.split_part(F.col("matched_id"), F.lit(sep), F.lit(1))
    first = r.withColumn("base", base).withColumn("rank", F.row_number().over(Window.partitionBy("base").orderBy("matched_id"))).where("rank = 1").drop("rank")
    values = [c for c in right.columns if c != key]
    second = first.select(F.col("base").alias("_base"), F.col("matched_id").alias("_id"), *[F.col(v).alias(f"_{v}") for v in values])
    out = exact.join(second, F.split_part(exact[key], F.lit(sep), F.lit(1)) == second["_base"], "left")
    hit = F.col("matched_id").isNotNull()
    how = F.when(hit, "exact").when(F.col("_id").isNotNull(), "base")
    return out.select(*left.columns, F.coalesce("matched_id", "_id").alias("matched_id"), how.alias("match"), *[F.when(hit, F.col(v)).otherwise(F.col(f"_{v}")).alias(v) for v in values])


def _grams(text: Column, size: int | Column) -> Column:
    """The distinct runs of ``size`` characters of a text; none of a shorter one."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, size)))


def containing(left: DataFrame, right: DataFrame, text: str, part: str, gram: int = 4) -> DataFrame:
    """Pairs where ``text`` contains ``part``, one for each left row: the smallest part. Equal left rows give a row each.

    A containment join has no equality to hash, so rows meet on runs of ``gram`` characters. Each part goes by its rarest one,
    by how many texts hold it, so parts with a common beginning don't meet all texts that share it; one that no text holds
    rules the part out. Parts shorter than that meet the texts on all runs of their own length, which is equality. Empty and
    null parts are in no text. Texts that rows share meet the parts once.
    """
    rows = written(left.select(F.col(text).alias("_text")).where(F.col(text).isNotNull()).distinct().withColumn("_row", F.monotonically_increasing_id()), "texts")
    parts = written(right.where(F.length(part) > 0).distinct().withColumn("_part", F.monotonically_increasing_id()), "parts")
    own = parts.where(F.length(part) >= gram).select("_part", F.explode(_grams(F.col(part), gram)).alias("_at"))
    seen = rows.select("_row", F.explode(_grams(F.col("_text"), gram)).alias("_at"))
    counts = seen.join(own.select("_at").distinct(), "_at", "left_semi").groupBy("_at").agg(F.count("*").alias("_n"))
    # a run without a count is in no text
    rarest = own.join(counts, "_at", "left").groupBy("_part").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_at").alias("at"))).alias("k")).where("k.n > 0")
    long = rarest.select("_part", F.col("k.at").alias("_at")).join(seen, "_at").select("_row", "_part")
    brief = parts.where(F.length(part) < gram).select("_part", F.col(part).alias("_at"), F.length(part).alias("_size"))
    sizes = brief.agg(F.sort_array(F.collect_set("_size"))).first()[0]
    pairs = long
    for size in sizes:
        held = rows.select("_row", F.explode(_grams(F.col("_text"), size)).alias("_at"))
        pairs = pairs.unionByName(held.join(brief.where(F.col("_size") == size), "_at").select("_row", "_part"))
    met = pairs.join(rows.hint("merge"), "_row").join(parts.hint("merge"), "_part").where(F.contains(F.col("_text"), F.col(part)))
    best = met.groupBy("_row", "_text").agg(F.min(F.struct(F.col(part).alias("_by"), *[F.col(c).alias(f"_{c}") for c in right.columns])).alias("_best"))
    best = written(best.select("_text", "_best"), "found")
    size = best.agg(F.coalesce(F.sum(F.length("_text") + F.length(F.col("_best._by"))), F.lit(0))).first()[0]
    few = F.broadcast(best) if size <= SMALL else best.hint("merge")
    return left.join(few, left[text] == few["_text"]).select(*[left[c] for c in left.columns], *[F.col("_best")[f"_{c}"].alias(c) for c in right.columns])


def answered_by_all(df: DataFrame, models: list[str], prompt: str = "prompt") -> DataFrame:
    """Rows of prompts that every one of the models answered."""
    done = df.where(F.col("model").isin(*models)).groupBy(prompt).agg(F.count_distinct("model").alias("n")).where(F.col("n") == len(set(models)))
    return df.join(done.select(prompt), prompt, "left_semi")


def with_row_index(properties: DataFrame, rows: DataFrame, side_by_side: bool = False, index: str = "row_idx") -> DataFrame:
    """Properties with the index of the row that they come from, by question and model; side by side both models of a row lead to it.

    Of rows that share a question and model the last counts; a property without a row has no index.
    """
    models = F.explode(F.array_distinct(F.array("model_a", "model_b"))) if side_by_side else F.col("model")
    keyed = rows.select("question_id", models.alias("model"), F.col(index)).groupBy("question_id", "model").agg(F.max(index).alias(index))
    # files of rows with constant models are small, and a plan would broadcast them for that
    return properties.drop(index).join(keyed.hint("merge"), ["question_id", "model"], "left")


def without_properties(conversations: DataFrame, properties: DataFrame) -> DataFrame:
    return conversations.join(properties.select("question_id", "model").distinct(), ["question_id", "model"], "left_anti")


def tidy_pairs(df: DataFrame, model_a: str, model_b: str, key: list[str], values: list[str]) -> DataFrame:
    """One row for each key that both models answered, with every value of each model; pairs with a null are dropped.

    Raises at run time if a model answered a key twice.
    """
    rows = df.where(F.col("model").isin(model_a, model_b)).withColumn("n", F.count("*").over(Window.partitionBy(*key, "model")))
    once = rows.where(F.assert_true(F.col("n") == 1, F.lit("a model answers the same key twice")).isNull())
    sides = [once.where(F.col("model") == m).select(*key, *[F.col(v).alias(f"{v}_{s}") for v in values]) for m, s in ((model_a, "a"), (model_b, "b"))]
    return sides[0].join(sides[1], key).dropna()


def common_trials(a: DataFrame, b: DataFrame, key: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each key that both sides have."""
    both = a.select(*key).intersect(b.select(*key))
    w = Window.partitionBy(*key).orderBy(order)
    return tuple(x.join(both, key, "left_semi").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n") for x in (a, b))


def estimated_pairs(df: DataFrame, model_a: str, model_b: str, key: str = "prompt") -> DataFrame:
    """How many keys both models answered, as one row."""
    have = df.groupBy(key).agg(F.max((F.col("model") == model_a).cast("int")).alias("a"), F.max((F.col("model") == model_b).cast("int")).alias("b"))
    return have.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).cast("long").alias("n_pairs"))


def enriched(clusters: DataFrame, cells: DataFrame) -> DataFrame:
    """Clusters with their proportions by model as a map, and their size and quality over all models."""
    by_model = cells.groupBy("cluster").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "proportion")))).alias("proportions"), F.sum("size").alias("total_size"))
    return clusters.join(by_model, "cluster", "left")


def last_cluster_of(properties: DataFrame, members: DataFrame) -> DataFrame:
    """Properties with the cluster that names them last, in order of member position."""
    w = Window.partitionBy("property_id").orderBy(F.col("member_pos").desc())
    last = members.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("property_id", "cluster_id", "cluster_label")
    return properties.join(last, "property_id", "left")
