"""Registered queries of sources and sinks, report frames and the pipeline's calls, with an offline provider in place of a model."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lumentrace.functions import messages, text
from lumentrace.operators import filters, metrics, naming, reports, reshape
from lumentrace.operators.providers import CallCache
from lumentrace.plans import pipeline, q_metrics
from lumentrace.plans.facts import obs, rounded
from lumentrace.session import shared_path, table, written
from lumentrace.sources import loaders, traces

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name with the SQL that says the same."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- sources and sinks: what is written is what is read ---


@query("SELECT nation.*, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def csv_round_trip(spark, sf_dir):
    path = shared_path(spark, "csv")
    df = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey")).drop("r_regionkey")
    df.write.csv(f"{path}.csv", header=True, escape='"')
    return loaders.load(spark, f"{path}.csv").select(*[F.col(c).cast(t) for c, t in df.dtypes])


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, sf_dir):
    path = shared_path(spark, "lines")
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    loaders.save(df, f"{path}.jsonl", "jsonl")
    return loaders.load(spark, f"{path}.jsonl").select(*[F.col(c).cast(t) for c, t in df.dtypes])


@query("SELECT page_id, url, length(html) AS size FROM pages")
def json_values(spark, sf_dir):
    """Pages as JSON lines, read as variants."""
    path = shared_path(spark, "values")
    table(spark, sf_dir, "pages").select(F.to_json(F.struct("page_id", "url", F.length("html").alias("size"))).alias("value")).write.text(path)
    get = lambda f, kind: F.try_variant_get("value", f"$.{f}", kind).alias(f)
    return loaders.json_lines(spark, path).select(get("page_id", "long"), get("url", "string"), get("size", "long"))


@query("SELECT vec_id::VARCHAR AS value, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def embeddings_round_trip(spark, sf_dir):
    path = shared_path(spark, "vectors")
    loaders.save(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("name_embedding")), path)
    found = loaders.precomputed_embeddings(spark, path)
    return rounded(found.select("value", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total")), 4)


@query(q_metrics.ORACLE_SQL["metrics_model_cluster"])
def metrics_round_trip(spark, sf_dir):
    """A metric table saved as JSON lines and loaded again."""
    df = q_metrics.metrics_model_cluster(spark, sf_dir)
    path = shared_path(spark, "metrics")
    loaders.save_metrics({"model_cluster_scores": df}, path)
    back = loaders.load_metrics(spark, path)
    assert back["cluster_scores"] is None
    return back["model_cluster_scores"].select(*[F.col(c).cast(t) for c, t in df.dtypes])


@query("SELECT event_id AS property_id, event_type AS property_description, row_number() OVER (ORDER BY event_id) - 1 AS row_idx FROM events WHERE event_id % 3 > 0 ORDER BY event_id LIMIT 50 OFFSET 100")
def results_page(spark, sf_dir):
    """The third page of saved clusters, whose rows without a description are left out."""
    e = table(spark, sf_dir, "events")
    rows = loaders.indexed(e.where("event_id % 3 > 0"), "event_id").select(F.col("event_id").alias("property_id"), F.col("event_type").alias("property_description"), "row_idx")
    blank = e.where("event_id % 3 = 0").select(F.col("event_id").alias("property_id"), F.lit(" ").alias("property_description"), F.lit(-1).cast("long").alias("row_idx"))
    path = shared_path(spark, "results")
    loaders.save_clusters(rows.unionByName(blank), path)
    return loaders.results_page(spark, path, "clustered_results", 2, 50)


@query("SELECT event_id, event_type, user_id FROM events")
def event_lines(spark, sf_dir):
    """Rows written as one JSON line each with their kind, and read back."""
    path = shared_path(spark, "event-lines")
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    loaders.save_events(df, path)
    return spark.read.json(path).where("type = 'property'").select(*[F.col(f"property.{c}").cast(t).alias(c) for c, t in df.dtypes])


@query("SELECT o_orderkey AS id, '{\"status\": \"' || o_orderstatus || '\", \"key\": ' || o_custkey || ', \"open\": ' || (o_orderstatus = 'O') || '}' AS value FROM orders")
def literals_to_json(spark, sf_dir):
    """Python literals as JSON."""
    o = table(spark, sf_dir, "orders")
    flag = F.when(F.col("o_orderstatus") == "O", F.lit("True")).otherwise(F.lit("False"))
    value = F.concat(F.lit("{'status': '"), F.col("o_orderstatus"), F.lit("', 'key': "), F.col("o_custkey").cast("string"), F.lit(", 'open': "), flag, F.lit("}"))
    return loaders.literals_to_json(o.select(F.col("o_orderkey").alias("id"), value.alias("value")), "value")


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS row_idx FROM documents")
def indexed_rows(spark, sf_dir):
    return loaders.indexed(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id").select("doc_id", "row_idx")


@query("SELECT c_custkey::VARCHAR AS question_id, 'p' AS prompt, 'm' AS model, c_name AS model_response, '{\"acctbal\":' || c_acctbal::DOUBLE::VARCHAR || '}' AS score FROM customer")
def conversations_as_input(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").cast("string").alias("question_id"), F.lit("p").alias("prompt"), F.lit("m").alias("model"), F.col("c_name").alias("model_response"), F.col("c_acctbal").cast("double").alias("acctbal"))
    return loaders.as_input(rows)


@query("SELECT o_orderkey AS id, o_orderstatus AS \"o.status\", o_custkey AS \"o.who.key\" FROM orders")
def flattened_struct(spark, sf_dir):
    nested = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").alias("key")).alias("who")).alias("o"))
    return reshape.flattened(nested, "o", "o.")


@query("SELECT o_orderkey AS id, '{\"a\":' || o_custkey || ',\"b\":\"' || o_orderstatus || '\"}' AS key FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1")
def prompt_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    given = F.concat(F.lit(' { "b": "'), F.col("o_orderstatus"), F.lit('", "a": '), F.col("o_custkey").cast("string"), F.lit("}"))
    return o.select(F.col("o_orderkey").alias("id"), text.prompt_key(F.when(F.col("o_orderkey") % 2 == 0, given).otherwise(F.col("o_orderstatus"))).alias("key"))


@query("SELECT event_id AS id FROM events WHERE contains(lower(event_type), 'c') AND user_id % 3 IN (0, 1)")
def filter_type_and_impact(spark, sf_dir):
    impact = F.expr("CASE user_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN ' medium' ELSE 'low' END").alias("impact")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("behavior_type"), impact)
    return filters.of_type_and_impact(rows, "C").select("id")


@query("SELECT conv_id, coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (text IS NOT NULL), '') AS text FROM conversations GROUP BY conv_id")
def trajectory_texts(spark, sf_dir):
    """All turns of a conversation as lines; a turn without text gives none, a conversation without any an empty text."""
    rows = messages.conversations(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", traces.trajectory_text(F.col("messages")).alias("text"))


@query("SELECT o_orderkey AS id, 'Customer#' || o_custkey AS name FROM orders")
def user_profiles(spark, sf_dir):
    """The profile among the tool messages of a trajectory."""
    o = table(spark, sf_dir, "orders")
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    profile = F.concat(F.lit('{"Name": "Customer#'), F.col("o_custkey").cast("string"), F.lit('"}'))
    said = F.array(turn("user", F.lit("my name")), turn("tool", F.lit('{"order": 1}')), turn("tool", F.lit("{name")), turn("tool", profile), turn("tool", F.lit('{"Name": "other"}')))
    return o.select(F.col("o_orderkey").alias("id"), F.try_variant_get(traces.user_profile(said), "$.Name", "string").alias("name"))


@query("SELECT o_orderkey AS id, 'assistant' AS role, o_orderstatus AS content FROM orders UNION ALL SELECT o_orderkey, 'user', o_comment FROM (SELECT o_orderkey, 'p' || o_custkey AS o_comment FROM orders)")
def simple_messages(spark, sf_dir):
    """A prompt and its answer as messages."""
    o = table(spark, sf_dir, "orders")
    made = messages.simple(F.concat(F.lit("p"), F.col("o_custkey").cast("string")), F.col("o_orderstatus"))
    return o.select(F.col("o_orderkey").alias("id"), F.inline(F.from_json(made, "array<struct<role:string,content:string>>")))


# --- report frames ---

def _cells(spark, sf_dir):
    return written(metrics.model_metrics(*obs(spark, sf_dir)), "cells")


@query(f"SELECT model, 'discount' AS metric, quality_discount AS value FROM ({q_metrics.ORACLE_SQL['metrics_model']}) UNION ALL SELECT model, 'quantity', quality_quantity FROM ({q_metrics.ORACLE_SQL['metrics_model']})")
def tidy_cells(spark, sf_dir):
    return rounded(reports.tidy_cells(_cells(spark, sf_dir), ["model"]).select("model", "metric", "value"))


@query(f"SELECT model, row_number() OVER (ORDER BY quality_quantity DESC, model) AS place FROM ({q_metrics.ORACLE_SQL['metrics_model']})")
def heatmap_order(spark, sf_dir):
    return reports.heatmap_order(_cells(spark, sf_dir), "model", "quality_quantity").select("model", "place")


# --- the pipeline's calls ---


def _words(said: str, n: int) -> list[str]:
    return sorted(set(said.lower().split()))[:n]


def _labels(request: str) -> str:
    """The taxonomy label that the answer's length falls under."""
    said = request.rsplit("[answer]", 1)[-1].strip()
    return json.dumps({"category": ["short", "middle", "long"][len(said) % 3], "property_description": "length", "evidence": [], "reason": "r"})


def _extracts(request: str) -> str:
    return "```json\n" + json.dumps([{"property_description": w, "behavior_type": "Style", "evidence": w} for w in _words(request.rsplit("[answer]", 1)[-1], 2)]) + "\n```"


def _compares(request: str) -> str:
    """The first word of each side, and a property of no known side."""
    a, b = request.split("[model_a_answer]", 1)[-1].split("[model_b_answer]", 1)
    found = [{"model": f"Model {x}", "property_description": w, "behavior_type": "Style"} for x, said in (("A", a), ("B", b), ("C", a)) for w in _words(said, 1)]
    return json.dumps(found)


def _single(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), F.lit("?").alias("prompt"), F.concat(F.lit("m"), (F.col("item_id") % 2).cast("string")).alias("model"), F.col("text").alias("model_response"))


def _cache(spark):
    return CallCache(spark, shared_path(spark, "calls"))


_SPLIT = r"list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')))"


@query(f"SELECT item_id::VARCHAR AS question_id, 'm' || item_id % 2 AS model, unnest({_SPLIT}[1:2]) AS property_description FROM benchmark")
def pipeline_extract(spark, sf_dir):
    out = pipeline.extract_properties(_single(spark, sf_dir), _extracts, _cache(spark))
    return out.properties.select("question_id", "model", "property_description")


@query("""WITH f AS (SELECT item_id::VARCHAR AS c, 'm' || item_id % 2 AS model, CASE length(trim(text)) % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'middle' ELSE 'Other' END AS cluster FROM benchmark),
    n AS (SELECT model, count(*) AS total FROM f GROUP BY 1)
    SELECT m.model, k.cluster, count(f.c) AS size, count(f.c) / any_value(total) AS proportion FROM (SELECT DISTINCT model FROM f) m CROSS JOIN (SELECT DISTINCT cluster FROM f) k
    LEFT JOIN f ON f.model = m.model AND f.cluster = k.cluster JOIN n ON n.model = m.model GROUP BY 1, 2""")
def pipeline_label(spark, sf_dir):
    """A fixed taxonomy without the label 'long', whose answers are Other."""
    out = pipeline.label(_single(spark, sf_dir), _labels, _cache(spark), ["short", "middle"])
    return out.tables["model_cluster_scores"].select("model", "cluster", "size", "proportion")


def _battles(spark, sf_dir):
    """Benchmark items against the ones after them."""
    b = table(spark, sf_dir, "benchmark")
    a, z = b.select("item_id", F.col("text").alias("model_a_response")), b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("model_b_response"))
    both = a.join(z, "item_id")
    return both.select(F.col("item_id").cast("string").alias("question_id"), F.lit("?").alias("prompt"), F.lit("left").alias("model_a"), F.lit("right").alias("model_b"), "model_a_response", "model_b_response", F.when(F.col("item_id") % 3 == 0, "left").otherwise("tie").alias("winner"))


@query(f"""SELECT a.item_id::VARCHAR AS question_id, 'left' AS model, {_SPLIT.replace('text', 'a.text')}[1] AS property_description, CASE WHEN a.item_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS winner FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1
    UNION ALL SELECT a.item_id::VARCHAR, 'right', {_SPLIT.replace('text', 'b.text')}[1], CASE WHEN a.item_id % 3 = 0 THEN -1.0 ELSE 0.0 END FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1""")
def pipeline_side_by_side(spark, sf_dir):
    """One request shows both answers; properties go to the model that they name, with its score."""
    out = pipeline.extract_properties(_battles(spark, sf_dir), _compares, _cache(spark))
    rows = out.properties.withColumnRenamed("question_id", "conversation_id").join(out.scores, ["conversation_id", "model"], "left")
    return rows.select(F.col("conversation_id").alias("question_id"), "model", "property_description", "winner")


@query("SELECT 'UNKNOWN_MODEL_MAPPING' AS error_type, count(*) AS n FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def pipeline_unknown_models(spark, sf_dir):
    answers = pipeline.Pipeline([("extract", pipeline.extraction(_compares, _cache(spark))), ("parse", pipeline.parsing(10**9))])
    out = pipeline.explain(_battles(spark, sf_dir), _compares, _cache(spark), pipeline=answers)
    return out.failures.groupBy("error_type").agg(F.count("*").alias("n"))


def _names(request: str) -> str:
    """Names and matches from the words of the request."""
    if request.startswith(naming.NAME_ASK):
        return request.rsplit("\n", 1)[-1].upper()
    if request.startswith(naming.MATCH_ASK):
        name = request.rsplit("[name]\n", 1)[-1]
        return f"names in {name[0]}"
    return "\n".join(sorted({f"names in {x[0]}" for x in request.rsplit("[names]\n", 1)[-1].split("\n") if x}))


@query("SELECT event_type AS by, upper(max('t' || user_id)) AS label FROM events GROUP BY 1")
def cluster_names(spark, sf_dir):
    """Each cluster named after the last of its members, all of which the call sees."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("by"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("property_description"))
    return naming.named(rows, _names, _cache(spark), "by", most=10**6)


@query("SELECT DISTINCT c_mktsegment AS label, 'names in ' || c_mktsegment[1] AS coarse FROM customer")
def coarse_matches(spark, sf_dir):
    """Market segments under the initials that a provider names as broader groups."""
    fine = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("label"))
    cache = _cache(spark)
    return naming.matched(fine, naming.coarse_names(fine, _names, cache, 4), lambda r: _names(r), cache)


@query()
def pipeline_cluster_job(spark, sf_dir):
    """Given properties clustered, named, regrouped and measured in one call."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").cast("string").alias("property_id"), F.col("user_id").cast("string").alias("question_id"), F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")).alias("model"), F.concat_ws(" ", "event_type", (F.col("event_id") % 50).cast("string")).alias("property_description"), F.lit("Style").alias("behavior_type"))
    job = pipeline.cluster_job(rows, clusterer=pipeline.chosen(pipeline.CLUSTERERS, "hierarchical", provider=_names, cache=_cache(spark), min_cluster_size=5))
    return job.tables["model_cluster_scores"].select("model", "cluster", "size", "proportion")
