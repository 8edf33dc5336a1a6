"""Names for clusters, coarse groups of names, and the assignment of fine to coarse, through a provider of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrace.functions import text
from lumentrace.operators import clustering, ranking
from lumentrace.operators.providers import CallCache, Embedder, Provider, embedded, hashing_embedder
from lumentrace.session import written
from lumentrace.sources import loaders

NAME_ASK = "Give a short name that fits all of these behaviours and answer with the name alone."
COARSE_ASK = "Group these names under at most {n} broader names. Answer with one broader name on each line."
PRETTY_ASK = "Put a summary of at most four words before this name and answer with 'summary: name' alone."
#: Options that a request to match holds at most.
OPTIONS = 200
MATCH_ASK = "Which of the options fits the name best? Answer with the option alone, or with Outliers if none fits."


def named(members: DataFrame, provider: Provider, cache: CallCache, by: str = "cluster_id", value: str = "property_description", most: int = 50) -> DataFrame:
    """(cluster id, label): one call for each cluster over at most ``most`` of its members; 'Unlabeled' with the id where it fails."""
    some = ranking.sample_members(members.select(by, value).distinct(), [by], value, most)
    asks = some.groupBy(by).agg(F.array_join(F.sort_array(F.collect_list(value)), "\n").alias("values"))
    asks = asks.withColumn("request", text.sections(NAME_ASK, behaviours=F.col("values")))
    label = text.unquoted(F.col("response"))
    unnamed = F.concat(F.lit("Unlabeled "), F.col(by).cast("string"))
    return cache.complete(asks, "request", provider).select(by, F.when(F.coalesce(label, F.lit("")) != "", label).otherwise(unnamed).alias("label"))


def coarse_names(names: DataFrame, provider: Provider, cache: CallCache, most: int = 20, chunk: int = 500) -> DataFrame:
    """(label): broader names of a list of names. A list of at most ``most`` stays as it is, also where the call fails.

    A call sees at most ``chunk`` names in order; the names that several calls give are grouped again while they get fewer.
    """
    one = names.select("label").distinct()
    while True:
        if one.limit(most + 1).count() <= most:
            return one
        rows = loaders.indexed(one, "label").withColumn("part", F.expr(f"row_idx div {chunk}"))
        size = rows.count()
        ask = rows.groupBy("part").agg(F.array_join(F.sort_array(F.collect_list("label")), "\n").alias("names"))
        ask = ask.withColumn("request", text.sections(COARSE_ASK.replace("{n}", str(most)), names=F.col("names")))
        lines = F.split(F.coalesce(F.col("response"), F.col("names")), "\n")
        found = cache.complete(ask, "request", provider).select(F.explode(F.transform(lines, text.list_item)).alias("label")).where("label <> ''")
        found = written(found.distinct(), "names")
        if size <= chunk or found.count() >= size:
            return found
        one = found


def prettified(names: DataFrame, provider: Provider, cache: CallCache) -> DataFrame:
    """(cluster id, label) with a short summary in bold before each label, one call for each distinct label; labels of failed calls and outliers stay."""
    asks = names.select("label").distinct().where(~text.is_outlier(F.col("label"))).withColumn("request", text.sections(PRETTY_ASK, name=F.col("label")))
    said = cache.complete(asks, "request", provider)
    summary = F.trim(F.regexp_replace(F.substring_index("response", ":", 1), r"[*\"]", ""))
    pretty = said.where(F.contains("response", F.lit(":")) & (summary != "")).select("label", F.concat(F.lit("**"), summary, F.lit(":** "), F.col("label")).alias("_pretty"))
    return names.join(pretty, "label", "left").withColumn("label", F.coalesce("_pretty", "label")).drop("_pretty").select(*names.columns)


def under_coarse(members: DataFrame, most: int, provider: Provider, cache: CallCache) -> DataFrame:
    """Members under at most ``most`` broader names of their labels; outliers, and labels that fit none, are outliers."""
    fine = members.where(~text.is_outlier(F.col("cluster_label"))).select(F.col("cluster_label").alias("label")).distinct()
    pairs = matched(fine, coarse_names(fine, provider, cache, most), provider, cache)
    out = members.join(pairs.withColumnRenamed("label", "cluster_label"), "cluster_label", "left")
    return out.withColumn("cluster_label", F.coalesce("coarse", "cluster_label")).select(*members.columns)


def matched(fine: DataFrame, coarse: DataFrame, provider: Provider, cache: CallCache, most: int = OPTIONS, embed: Embedder | None = None) -> DataFrame:
    """(label, coarse): the option that an answer names for each fine label; Outliers where it names none or there are none.

    A request holds at most ``most`` options: where there are more, those whose vectors are closest to the label's, so its
    size does not grow with their number. ``embed`` makes the vectors, by default from the labels' words.
    """
    one, options = fine.select("label").distinct(), coarse.select(F.col("label").alias("option")).where("option is not null").distinct()
    if (n := options.limit(most + 1).count()) > most:
        make = embed or hashing_embedder()
        vectors = lambda df, name: written(embedded(df.select(name), name, make), "vectors")
        near = clustering.closest(vectors(one, "label"), vectors(options, "option"), "label", "option", most)
        asks = near.select("label", F.sort_array(F.transform("near", lambda x: x["option"])).alias("options"))
    else:
        listed = options.agg(F.sort_array(F.collect_set("option")).alias("options"))
        asks = one.crossJoin(F.broadcast(listed)) if n else one.withColumn("options", F.array().cast("array<string>"))
    asks = asks.withColumn("request", text.sections(MATCH_ASK, options=F.array_join("options", "\n"), name=F.col("label")))
    chosen = text.matched_label(F.col("response"), F.col("options"))
    return cache.complete(asks, "request", provider).select("label", F.coalesce(chosen, F.lit("Outliers")).alias("coarse"))


def matched_by_vectors(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """(label, coarse) by the largest cosine of (label, embedding) rows; Outliers if there is no coarse label."""
    near = clustering.nearest(fine.withColumnRenamed("label", "_fine"), coarse.withColumnRenamed("label", "coarse"), "_fine", "coarse")
    return fine.select("label").distinct().join(near.select(F.col("_fine").alias("label"), "coarse"), "label", "left").withColumn("coarse", F.coalesce("coarse", F.lit("Outliers")))


def regrouped_outliers(members: DataFrame, least: int, provider: Provider, cache: CallCache) -> DataFrame:
    """Members whose outliers, if there are at least twice ``least``, joined an existing or a new label; -1 stays for the rest."""
    out = members.where("cluster_id = -1")
    n = out.select("property_description").distinct().count()
    if n < 2 * least:
        return members
    names = coarse_names(out.select(F.col("property_description").alias("label")), provider, cache, max(1, n // least))
    known = members.where("cluster_id <> -1").select(F.col("cluster_label").alias("label")).distinct()
    pairs = matched(out.select(F.col("property_description").alias("label")), names.unionByName(known).distinct(), provider, cache)
    moved = out.drop("cluster_label").join(pairs.withColumnsRenamed({"label": "property_description", "coarse": "cluster_label"}), "property_description")
    ids = members.where("cluster_id <> -1").groupBy("cluster_label").agg(F.min("cluster_id").alias("_id"))
    fresh = F.when(F.col("cluster_label") == "Outliers", F.lit(-1)).otherwise(F.coalesce("_id", F.xxhash64("cluster_label").bitwiseAND(F.lit((1 << 62) - 1))))
    moved = moved.join(ids, "cluster_label", "left").withColumn("cluster_id", fresh.cast("long")).drop("_id")
    return members.where("cluster_id <> -1").unionByName(moved.select(*members.columns))
