"""Registered queries of evaluation files, score shapes, report frames, streams that are merged, and runs of whole pipelines."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import functions as F

from lumentrace.functions import json_repair, messages, text
from lumentrace.operators import clustering, filters, grouping, joins, metrics, naming, providers, reports, reshape
from lumentrace.plans import pipeline, q_metrics, q_pipeline, q_text, runs
from lumentrace.plans.facts import obs, rounded
from lumentrace.session import shared_path, table
from lumentrace.sources import loaders, traces
from lumentrace.streaming import streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name with the SQL that says the same."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- sources ---


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def parquet_round_trip(spark, sf_dir):
    path = shared_path(spark, "table") + ".parquet"
    loaders.save(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return loaders.resolve(spark, path=path)[0]


@query("SELECT r_regionkey, r_name, CASE WHEN r_regionkey % 2 = 0 THEN length(r_name) END AS size FROM region")
def rows_in_memory(spark, sf_dir):
    """The regions, of which there are five whatever the scale, as Python rows with a key that some lack."""
    rows = [{"r_regionkey": r.r_regionkey, "r_name": r.r_name} | ({"size": len(r.r_name)} if r.r_regionkey % 2 == 0 else {}) for r in table(spark, sf_dir, "region").collect()]
    return loaders.resolve(spark, rows=rows)[0]


@query("SELECT o_orderkey::VARCHAR AS trace_id, 'tool' || o_custkey AS name, 'first' AS description FROM orders")
def tool_definitions(spark, sf_dir):
    """The tools of traces with two spans of one tool, whose first description stays."""
    o = table(spark, sf_dir, "orders")
    span = lambda d: F.concat(F.lit(f'{{"span_attributes":{{"{traces.KIND}":"TOOL","{traces.TOOL_NAME}":"tool'), F.col("o_custkey").cast("string"), F.lit(f'","{traces.TOOL_TEXT}":"{d}"}},"child_spans":[]}}'))
    made = o.select(F.col("o_orderkey").cast("string").alias("trace_id"), F.concat(F.lit('{"spans":['), span("first"), F.lit(","), span("second"), F.lit("]}")).alias("trace"))
    return traces.tools(traces.events(made)).select("trace_id", "name", "description")


_BATTLES = """b AS (SELECT o_orderkey AS id, 'p' || o_custkey AS prompt, 'm' || o_custkey % 7 AS model_a, 'm' || o_orderkey % 5 AS model_b,
    CASE o_orderkey % 3 WHEN 0 THEN 'm' || o_custkey % 7 WHEN 1 THEN 'm' || o_orderkey % 5 ELSE 'tie' END AS winner FROM orders),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY id) AS n FROM b) WHERE n = 1),
    rare AS (SELECT model_a AS m FROM one GROUP BY 1 HAVING count(*) < 8)"""


@query(f"WITH {_BATTLES} SELECT id, prompt, model_a, model_b, winner FROM one WHERE model_a NOT IN (SELECT m FROM rare) AND model_b NOT IN (SELECT m FROM rare)")
def arena_battles(spark, sf_dir):
    """One battle for each prompt, of models with eight and more, with the winner's name."""
    name = lambda c, n: F.concat(F.lit("m"), (F.col(c) % n).cast("string"))
    said = lambda c: F.array(F.struct(F.lit("user").alias("role"), c.alias("content")))
    prompt = F.concat(F.lit("p"), F.col("o_custkey").cast("string"))
    winner = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'model_a' WHEN 1 THEN 'model_b' ELSE 'tie (bothbad)' END")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), name("o_custkey", 7).alias("model_a"), name("o_orderkey", 5).alias("model_b"), winner.alias("winner"), said(prompt).alias("conversation_a"), said(prompt).alias("conversation_b"))
    return traces.battles(rows, least=8).select("id", "prompt", "model_a", "model_b", "winner")


@query("""SELECT o_orderkey::VARCHAR AS question_id, 'do ' || o_custkey AS prompt, o_orderstatus AS model, 'system: be kind' || chr(10) || 'user: hi' AS said, o_orderkey % 2 + 0.5::DOUBLE AS reward FROM orders WHERE o_orderkey % 4 < 3""")
def task_simulations(spark, sf_dir):
    """Evaluation files, one for each order, whose simulations meet their tasks; those of a task that the file lacks go."""
    key = F.col("o_orderkey").cast("string")
    task = F.struct(key.alias("id"), F.struct(F.concat(F.lit("do "), F.col("o_custkey").cast("string")).alias("instructions")).alias("user_scenario"))
    of = F.when(F.col("o_orderkey") % 4 == 3, F.concat(key, F.lit("?"))).otherwise(key)
    said = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")))
    sim = F.struct(of.alias("task_id"), said.alias("messages"), F.struct((F.col("o_orderkey") % 2 + 0.5).alias("reward")).alias("reward_info"))
    info = F.struct(F.struct(F.col("o_orderstatus").alias("llm")).alias("agent_info"), F.struct(F.lit("be kind").alias("policy")).alias("environment_info"))
    files = table(spark, sf_dir, "orders").select(info.alias("info"), F.array(task).alias("tasks"), F.array(sim).alias("simulations"))
    return traces.simulations(files).select("question_id", "prompt", "model", traces.trajectory_text(F.col("model_response")).alias("said"), F.col("score")["reward"].alias("reward"))


@query("SELECT l_orderkey || '-' || l_linenumber AS question_id, 'part ' || l_partkey AS prompt, 0.0::DOUBLE AS reward FROM lineitem WHERE l_linestatus = 'F'")
def failed_trials(spark, sf_dir):
    """Trials whose reward, in either of its places, is 0."""
    items = table(spark, sf_dir, "lineitem")
    reward = F.when(F.col("l_linestatus") == "F", 0.0).otherwise(1.0)
    there = F.col("l_linenumber") % 2 == 0
    info = F.struct(F.struct(F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("instruction")).alias("task"), F.struct(F.when(there, reward).alias("reward")).alias("reward_info"))
    made = items.select(F.col("l_orderkey").cast("string").alias("task_id"), F.col("l_linenumber").cast("string").alias("trial"), F.lit("[]").alias("traj"), info.alias("info"), F.when(~there, reward).alias("reward"))
    return traces.trials(made, failed_only=True).select("question_id", "prompt", "reward")


# --- projections and checks ---


@query("SELECT doc_id AS question_id, source AS model, text AS model_response FROM documents")
def renamed_columns(spark, sf_dir):
    given = {"question_id": "doc_id", "model": "source", "model_response": "text"}
    return reshape.rename(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), given, list(given)).select(*given)


@query("SELECT doc_id, quality FROM labels")
def detected_scores(spark, sf_dir):
    """The columns of labels that are taken for scores."""
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", *reshape.score_columns(labels))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey + 0.5 END::DOUBLE AS a, CASE WHEN o_orderkey % 4 = 1 THEN o_custkey END::DOUBLE AS score,
    CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::INT AS n FROM orders""")
def parsed_scores(spark, sf_dir):
    """Scores as JSON objects, as numbers, absent, and as text that is neither."""
    key = F.col("o_custkey").cast("string")
    given = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit('{"a":'), key, F.lit('.5,"b":1}'))).when(F.col("o_orderkey") % 4 == 1, key).when(F.col("o_orderkey") % 4 == 2, F.lit("none"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), given.alias("given"))
    s = reshape.parsed_score("given")
    return rows.select("id", F.try_element_at(s, F.lit("a")).alias("a"), F.try_element_at(s, F.lit("score")).alias("score"), F.size(F.map_filter(s, lambda _, v: v.isNotNull())).alias("n"))


@query("SELECT doc_id, source AS model FROM documents")
def known_models(spark, sf_dir):
    """Rows that have the columns that they need and name their models."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("model"))
    filters.require_columns(rows, ["doc_id", "model"])
    return filters.reject_unknown_models(rows)


@query("SELECT o_orderkey AS id, '[' || o_custkey || ',' || o_custkey + 1 || ',' || o_custkey + 2 || ']' AS list, '{\"s\":\"' || o_orderstatus || '\"}' AS nested, CASE WHEN o_orderkey % 2 = 0 THEN 'None' ELSE o_orderstatus END AS word FROM orders")
def tracker_table(spark, sf_dir):
    c = F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(c, c + 1, c + 2, c + 3).alias("list"), F.struct(F.col("o_orderstatus").alias("s")).alias("nested"), F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderstatus")).alias("word"))
    return reports.tracker_rows(rows, examples=3)


@query("SELECT c_custkey AS id, 'acctbal' AS metric, round(c_acctbal::DOUBLE, 4) + 0.0 AS value, 2.0::DOUBLE AS plus, 1.0::DOUBLE AS minus FROM customer")
def error_bars(spark, sf_dir):
    """A metric table in long form with the lengths of its error bars."""
    v = F.col("c_acctbal").cast("double")
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), v.alias("quality_acctbal"), (v - 1).alias("quality_acctbal_ci_lower"), (v + 2).alias("quality_acctbal_ci_upper"))
    return rounded(reports.error_bars(reports.tidy_cells(cells, ["id"])).select("id", "metric", "value", "plus", "minus"), 4)


@query("SELECT 'events' AS name, count(*) AS lines FROM events UNION ALL SELECT 'absent', 0")
def artefact_lines(spark, sf_dir):
    path = shared_path(spark, "lines")
    loaders.save(table(spark, sf_dir, "events"), path, "jsonl")
    found = reports.file_counts(spark, {"events": path, "absent": f"{path}-absent"})
    return spark.createDataFrame(list(found.items()), "name string, lines long")


@query("SELECT doc_id, source, lang, count(*) OVER (PARTITION BY lang) AS n FROM documents")
def custom_expression(spark, sf_dir):
    """A user's SELECT over a table."""
    return pipeline.custom_sql(table(spark, sf_dir, "documents"), "SELECT doc_id, source, lang, count(*) OVER (PARTITION BY lang) AS n FROM {df}")


# --- labels, sections and messages ---


@query("""SELECT o_orderkey AS id, 'name ' || o_orderstatus AS label, o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 AS outlier, 'Ask' || chr(10) || chr(10) || '[status]' || chr(10) || o_orderstatus ||
    CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || chr(10) || '[customer]' || chr(10) || o_custkey ELSE '' END AS asked FROM orders""")
def labels_and_sections(spark, sf_dir):
    """Quotes off names, labels that mean outliers, and requests in sections of which some are absent."""
    quoted = F.concat(F.lit("\"name "), F.col("o_orderstatus"), F.lit("'"))
    label = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'Outliers' WHEN 1 THEN 'Outliers - en' ELSE 'Outliers2' END")
    asked = text.sections("Ask", status=F.col("o_orderstatus"), customer=F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.unquoted(quoted).alias("label"), text.is_outlier(label).alias("outlier"), asked.alias("asked"))


@query("""SELECT o_orderkey AS id, true AS has_image, 'a' || o_custkey || chr(10) || 'b' AS before, 'data:' || repeat('x', (o_orderkey % 10)::INT) AS image, 'c' AS after, 3 AS n,
    '[image data, ' || 5 + o_orderkey % 10 || ' characters]' AS shown FROM orders""")
def messages_with_images(spark, sf_dir):
    """Text between images joined, in order, and an image as text."""
    part = lambda c: F.concat(F.lit('{"type":"text","text":"'), c, F.lit('"}'))
    url = F.concat(F.lit("data:"), F.repeat(F.lit("x"), (F.col("o_orderkey") % 10).cast("int")))
    image = F.concat(F.lit('{"type":"image_url","image_url":{"url":"'), url, F.lit('"}}'))
    content = F.concat_ws(",", part(F.concat(F.lit("a"), F.col("o_custkey").cast("string"))), part(F.lit("b")), image, part(F.lit("c")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit('[{"role":"user","content":['), content, F.lit("]}]")).alias("raw"))
    found = messages.with_segments(rows, "raw").select("id", messages.has_image(F.col("messages")).alias("has_image"), messages.collapsed(F.col("messages")).alias("parts"))
    at = lambda i: F.col("parts")[i]["value"]
    return found.select("id", "has_image", at(0).alias("before"), at(1).alias("image"), at(2).alias("after"), F.size("parts").alias("n"), messages.image_text(at(1)).alias("shown"))


@query("SELECT event_id AS row_idx, CASE event_id % 6 WHEN 3 THEN NULL WHEN 4 THEN 'no JSON' WHEN 0 THEN 'item 0 lacks category' WHEN 1 THEN 'item 0 lacks category' ELSE 'not a list' END AS problem FROM events")
def answer_schema_errors(spark, sf_dir):
    """How answers differ from a list of whole properties."""
    return q_text._answers(spark, sf_dir).select("row_idx", json_repair.schema_errors().alias("problem"))


_LONG = "o_orderkey % 3 = 0"


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN 'order ' || o_custkey
    ELSE concat('{{"key": ', o_custkey, ',', CASE WHEN {_LONG} THEN chr(10) END, ' "status": "', repeat(o_orderstatus, CASE WHEN {_LONG} THEN 80 ELSE 1 END), '"}}').replace('"', chr(39)) END AS text FROM orders""")
def printed_dictionaries(spark, sf_dir):
    """Dictionaries with sorted keys, long ones in several lines, and other text."""
    status = F.repeat(F.col("o_orderstatus"), F.when(F.expr(_LONG), 80).otherwise(1))
    given = F.concat(F.lit("{'status': '"), status, F.lit("', 'key': "), F.col("o_custkey").cast("string"), F.lit("}"))
    value = F.when(F.col("o_orderkey") % 3 == 2, F.concat(F.lit("order "), F.col("o_custkey").cast("string"))).otherwise(given)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), messages.printed(value).alias("text"))


@query("SELECT c_custkey AS id, left(c_mktsegment, 2) AS label, dense_rank() OVER (ORDER BY left(c_mktsegment, 2)) - 1 AS cluster_id FROM customer")
def labels_merged(spark, sf_dir):
    """Labels under merged names, with ids in order of those."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    names = rows.select("label").distinct().withColumn("merged", F.substring("label", 1, 2))
    return clustering.merged_labels(rows, names).select("id", "label", "cluster_id")


@query("""WITH m AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS size FROM events WHERE event_type IS NOT NULL)
    SELECT event_type AS cluster_id, any_value(size) AS size, place // 100 * 100 AS first, count(*) AS n, min(event_id)::VARCHAR AS least, max(event_id)::VARCHAR AS most FROM m GROUP BY event_type, place // 100""")
def cluster_pieces(spark, sf_dir):
    """Members of clusters as arrays of at most a hundred."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("cluster_id"), F.col("event_type").alias("cluster_label"), F.col("event_id").alias("row_idx"), F.col("event_id").cast("string").alias("property_id"), F.lit("d").alias("property_description"), F.col("user_id").alias("question_id"))
    out = grouping.clusters_of(rows, most=100)
    return out.select("cluster_id", "size", "first", F.size("property_ids").cast("long").alias("n"), F.col("property_ids")[0].alias("least"), F.element_at("property_ids", -1).alias("most"))


@query("""SELECT n_nationkey AS property_id, CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE 'names in ' || n_name[1] END AS cluster_label FROM nation JOIN region ON n_regionkey = r_regionkey""")
def outliers_regrouped(spark, sf_dir):
    """Outliers that a provider puts under new names; the other members stay."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = F.col("n_nationkey") % 2 == 1
    members = n.select(F.col("n_nationkey").alias("property_id"), F.col("n_name").alias("property_description"), F.when(out, -1).otherwise(F.col("r_regionkey")).cast("long").alias("cluster_id"), F.when(out, "Outliers").otherwise(F.col("r_name")).alias("cluster_label"))
    return naming.regrouped_outliers(members, 2, q_pipeline._names, q_pipeline._cache(spark)).select("property_id", "cluster_label")


# --- calls and vectors ---


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE 64 END AS size, CASE WHEN trim(text) <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents")
def embedded_texts(spark, sf_dir):
    """Distinct texts embedded once by the offline embedder; vectors have unit length, those of texts without words are 0."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = providers.embedded(rows, "text", providers.hashing_embedder())
    return out.select("doc_id", F.coalesce(F.size(F.nullif("embedding", F.array().cast("array<float>"))), F.lit(0)).alias("size"), (F.round(F.coalesce(clustering.norm(F.col("embedding")), F.lit(0.0)), 3)).alias("norm"))


def _loud(request: str) -> str:
    return request.upper()


def _gone(request: str) -> None:
    """A provider that is out of service."""


@query("SELECT event_id, upper(event_type) AS answer FROM events")
def cached_calls(spark, sf_dir):
    """Answers that come from the cache when the provider is out of service."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    cache = q_pipeline._cache(spark)
    cache.complete(rows, "event_type", _loud).count()
    return cache.complete(rows, "event_type", _gone, "answer").select("event_id", "answer")


def _vector(request: str) -> str:
    return json.dumps([float(len(request)), 1.0])


def _weak_vector(request: str) -> str | None:
    """As ``_vector``, but out of service for names with a u, and in the wrong shape for those that begin with C."""
    if "U" in request:
        raise ConnectionError
    return "[1, x" if request.startswith("C") else _vector(request)


@query("SELECT n_nationkey, CASE WHEN n_name NOT LIKE 'C%' OR n_name LIKE '%U%' THEN length(n_name)::DOUBLE END AS first, CASE WHEN n_name LIKE '%U%' THEN 'no answer' WHEN n_name LIKE 'C%' THEN 'no vector' END AS reason FROM nation")
def embeddings_by_calls(spark, sf_dir):
    """Vectors of names after a run that fails in part and one that is whole, with what the first could not embed."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cache = q_pipeline._cache(spark)
    _, dead = providers.embedded_by_calls(rows, "n_name", _weak_vector, cache)
    out, _ = providers.embedded_by_calls(rows, "n_name", providers.paced(_vector, 500), cache)
    return out.join(dead, "n_name", "left").select("n_nationkey", F.col("embedding")[0].cast("double").alias("first"), "reason")


# --- streams ---


@query("SELECT event_id AS row_idx, count(*) AS n FROM events WHERE event_id % 6 <= 2 AND event_type IS NOT NULL GROUP BY event_id, event_type HAVING event_id % 6 > 0 UNION ALL SELECT event_id, 2 * count(*) FROM events WHERE event_id % 6 = 0 AND event_type IS NOT NULL GROUP BY event_id")
def stream_properties(spark, sf_dir):
    """The valid properties of answers that come as files of JSON lines; fenced answers hold two."""
    source, found = shared_path(spark, "answers"), shared_path(spark, "found")
    q_text._answers(spark, sf_dir).write.json(source)
    stream = streams.json_source(spark, source, "row_idx long, raw_response string")
    streams.start(streams.properties(stream).select("row_idx"), found, shared_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(found).groupBy("row_idx").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_merged(spark, sf_dir):
    """Each (user, kind) once, over several batches of a stream."""
    source, found = shared_path(spark, "rows"), shared_path(spark, "merged")
    table(spark, sf_dir, "events").select("user_id", "event_type").repartition(3).write.json(source)
    streams.merged(streams.json_source(spark, source, "user_id long, event_type string", 1), found, shared_path(spark, "checkpoint"), ["user_id", "event_type"]).awaitTermination()
    return spark.read.parquet(found).select("user_id", "event_type")


@query("""WITH e AS (SELECT user_id, ts::TIMESTAMP AS t FROM events WHERE ts IS NOT NULL), g AS (SELECT *, CASE WHEN t >= lag(t) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, floor(epoch(min(t)))::BIGINT AS began, floor(epoch(max(t)))::BIGINT + 6 * 3600 AS ended, count(*) AS n FROM s GROUP BY user_id, session""")
def event_sessions(spark, sf_dir):
    """Sessions of each user, which end after six hours of silence."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    return streams.sessions(e, "at", "user_id", "6 hours").select("user_id", F.unix_timestamp("session_start").alias("began"), F.unix_timestamp("session_end").alias("ended"), "n")


#: Steps of five days; every tenth event comes two steps late.
_STEPS = """e AS (SELECT *, floor(epoch(ts) / 432000)::BIGINT AS own, floor(epoch(ts) / 432000)::BIGINT + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END AS step,
        floor(epoch(ts) / 3600)::BIGINT AS hour FROM events WHERE ts IS NOT NULL)"""


def _in_steps(spark, sf_dir, source: str, late: bool) -> None:
    """The events as files of their own, two for each step of five days, in order of the steps."""
    e = table(spark, sf_dir, "events").where("ts is not null").select("event_id", F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type")
    step = F.expr("unix_timestamp(at) div 432000") + (F.when(F.col("event_id") % 10 == 0, 2).otherwise(0) if late else 0)
    e = e.withColumn("step", step)
    for r in e.select("step").distinct().orderBy("step").collect():
        e.where(F.col("step") == r["step"]).drop("step").repartition(2).write.mode("append").parquet(source)


@query(f"""WITH {_STEPS}, s AS (SELECT step, max(ts) AS most FROM e GROUP BY step),
    w AS (SELECT step, floor(epoch_ms(max(most) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)) / 3600000.0 - 2) AS closed FROM s)
    SELECT hour, event_type, count(*) AS n FROM e JOIN w USING (step) WHERE (closed IS NULL OR hour + 1 > closed) AND hour + 1 <= (SELECT epoch_ms(max(ts)) / 3600000.0 - 2 FROM e) GROUP BY 1, 2""")
def stream_late_counts(spark, sf_dir):
    """Hourly counts that go out as the watermark, two hours behind, closes the hours; rows that come later than that are dropped.

    A batch drops the rows of hours that were closed when the batch before it began, so by what had come two batches ago;
    hours that never close give no row.
    """
    source, found = shared_path(spark, "steps"), shared_path(spark, "counts")
    _in_steps(spark, sf_dir, source, late=True)
    stream = streams.file_source(spark, source, "event_id long, at timestamp, user_id long, event_type string", files_per_trigger=2)
    streams.start_with_state(streams.windowed_counts(stream, "at", "event_type"), found, shared_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(found).select(F.expr("unix_timestamp(window_start) div 3600").alias("hour"), "event_type", "n")


@query("""SELECT a.event_id AS view_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase'
    AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR""")
def stream_pairs(spark, sf_dir):
    """Views with the purchases of the same user in the six hours after them, from two streams."""
    source, found = shared_path(spark, "steps"), shared_path(spark, "pairs")
    _in_steps(spark, sf_dir, source, late=False)
    stream = lambda: streams.file_source(spark, source, "event_id long, at timestamp, user_id long, event_type string", files_per_trigger=2)
    views = stream().where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("at").alias("viewed"), "user_id")
    bought = stream().where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("at").alias("bought"), "user_id")
    pairs = streams.paired(views, bought, "user_id", "viewed", "bought", "6 hours")
    streams.start_with_state(pairs.select("view_id", "purchase_id"), found, shared_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(found)


@query("SELECT DISTINCT user_id, event_type FROM events WHERE ts IS NOT NULL")
def stream_merged_late(spark, sf_dir):
    """Each (user, kind) once, of events of which every tenth comes days late; keys live until the stream is 60 days past them."""
    source, found = shared_path(spark, "steps"), shared_path(spark, "merged")
    _in_steps(spark, sf_dir, source, late=True)
    stream = streams.file_source(spark, source, "event_id long, at timestamp, user_id long, event_type string", files_per_trigger=2)
    streams.merged(stream, found, shared_path(spark, "checkpoint"), ["user_id", "event_type"], ts="at", ttl="60 days").awaitTermination()
    return spark.read.parquet(found).select("user_id", "event_type")


# --- pipelines ---


@query("SELECT l_returnflag AS model, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1")
def custom_stages(spark, sf_dir):
    """A pipeline built stage by stage, one of them one's own, with snapshots from which the result is read."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_returnflag").alias("model"))

    def distinct(data: pipeline.Dataset) -> pipeline.Dataset:
        return replace(data, properties=data.conversations.distinct())

    path = shared_path(spark, "snapshots")
    built = pipeline.Pipeline([]).add("same", pipeline.identity).add("gone", pipeline.identity).insert(1, "distinct", distinct).remove("gone")
    assert [name for name, _ in built] == ["same", "distinct"]
    built.run(pipeline.Dataset(rows), after=pipeline.snapshot(path))
    return loaders.load(spark, f"{path}/distinct/properties.parquet").groupBy("model").agg(F.count("*").alias("n"))


@query(q_metrics.ORACLE_SQL["metrics_cluster"])
def metrics_of_members(spark, sf_dir):
    """Metric tables of saved members alone."""
    facts, scores = obs(spark, sf_dir)
    members = facts.withColumnsRenamed({"conversation_id": "question_id", "cluster": "cluster_label"})
    return rounded(pipeline.metrics_only(members, scores)["cluster_scores"])


@query(q_pipeline.ORACLE_SQL["pipeline_label"])
def configured_run(spark, sf_dir):
    """A run that a configuration describes, over a saved table, with its results read from the folder that it saved to."""
    path = shared_path(spark, "run")
    loaders.save(q_pipeline._single(spark, sf_dir), f"{path}/in.parquet")
    config = json.dumps({"data_path": f"{path}/in.parquet", "output_dir": "nowhere", "taxonomy": {"short": "s", "middle": "m"}})
    runs.run(spark, config, q_pipeline._labels, output_dir=f"{path}/out")
    return loaders.load_metrics(spark, f"{path}/out/final")["model_cluster_scores"].select("model", "cluster", F.col("size").cast("long").alias("size"), "proportion")


@query(q_metrics.ORACLE_SQL["metrics_model"])
def report_payload(spark, sf_dir):
    """The models' rows of a payload for a page."""
    facts, scores = obs(spark, sf_dir)
    tables = pipeline.metrics_only(facts.withColumnsRenamed({"conversation_id": "question_id", "cluster": "cluster_label"}), scores)
    shown = reports.payload(tables)
    assert shown["metrics"] == ["discount", "quantity"]
    return rounded(spark.createDataFrame(shown["model_scores"], tables["model_scores"].schema))


# --- shapes of whole datasets ---

_PAIRED = """SELECT o_orderkey::VARCHAR AS id, o_totalprice::DOUBLE AS price_a, (o_totalprice * (1 + o_orderkey % 3))::DOUBLE AS price_b, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7 END::DOUBLE AS rank_a, 1.5::DOUBLE AS rank_b FROM orders"""


def _sides(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    price = F.col("o_totalprice").cast("double")
    return o.select(
        key.cast("string").alias("question_id"), F.lit("?").alias("prompt"), F.lit("x").alias("model_a"), F.lit("y").alias("model_b"), F.lit("yes").alias("model_a_response"), F.lit("no").alias("model_b_response"),
        price.alias("price_a"), (price * (1 + key % 3)).alias("price_b"), F.when(key % 5 > 0, key % 7).alias("rank_a"), F.lit(1.5).alias("rank_b"),
    )


@query(f"WITH p AS ({_PAIRED}) SELECT id AS conversation_id, 'x' AS model, round(price_a, 3) AS price, rank_a AS rank FROM p UNION ALL SELECT id, 'y', round(price_b, 3), rank_b FROM p")
def scores_side_by_side(spark, sf_dir):
    """Scores of both sides from columns that end in _a and _b."""
    rows = pipeline.prepare(_sides(spark, sf_dir), "side_by_side", score_columns=["price", "rank"])
    return rounded(pipeline.dataset(rows, "side_by_side").scores, 3)


@query("""WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey::VARCHAR) - 1 AS row_idx FROM orders)
    SELECT l_orderkey AS question_id, l_linenumber AS n, CASE WHEN l_linenumber % 3 < 2 THEN row_idx END AS row_idx FROM lineitem JOIN i ON l_orderkey = o_orderkey""")
def property_row_index(spark, sf_dir):
    """Properties of both models of a battle with the battle's row; those of another model have none."""
    rows = pipeline.prepare(_sides(spark, sf_dir).select("question_id", "prompt", "model_a", "model_b", "model_a_response", "model_b_response"), "side_by_side")
    side = F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("question_id"), side.alias("model"), F.col("l_linenumber").alias("n"))
    return joins.with_row_index(found, rows, side_by_side=True).select(F.col("question_id").cast("long").alias("question_id"), "n", "row_idx")


@query("""SELECT d.doc_id::VARCHAR AS question_id, source AS model, quality::DOUBLE AS quality, CASE WHEN d.doc_id % 3 > 0 THEN lang END AS cluster_label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def wide_dataset(spark, sf_dir):
    """Conversations with their scores, properties and clusters in one frame; those without a property stay."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("question_id"), F.col("source").alias("model"), "doc_id", "lang")
    scores = d.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("question_id").alias("conversation_id"), "model", F.col("quality").cast("double").alias("quality"))
    members = d.where("doc_id % 3 > 0").select("question_id", "model", F.col("lang").alias("cluster_label"))
    data = pipeline.Dataset(d.select("question_id", "model"), scores=scores, members=members)
    return pipeline.wide(data).select("question_id", "model", "quality", "cluster_label")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 > 0 THEN '{"n_regionkey":' || n_regionkey || ',"n_name":"' || n_name || '"}' ELSE '{"n_regionkey":' || n_regionkey || '}' END AS meta FROM nation""")
def unknown_columns(spark, sf_dir):
    """Columns that are not known as one JSON text, without those that are null."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.when(F.col("n_nationkey") % 4 > 0, F.col("n_name")).alias("n_name"))
    return loaders.meta(n, ["n_nationkey"])


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN value END AS value, event_id % 4 = 0 AS finite FROM events")
def json_safe_numbers(spark, sf_dir):
    """Numbers that JSON lacks as null, read back from JSON lines."""
    path, x = shared_path(spark, "numbers"), F.col("event_id") % 4
    odd = F.when(x == 0, F.col("value")).when(x == 1, F.lit(float("nan"))).when(x == 2, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    loaders.save(table(spark, sf_dir, "events").select("event_id", odd.alias("value")), path, "jsonl")
    return spark.read.schema("event_id long, value double").json(path).select("event_id", "value", F.col("value").isNotNull().alias("finite"))


def _pretty(request: str) -> str | None:
    name = request.rsplit("\n", 1)[-1]
    return None if name.startswith("B") else f'"{name.lower()[:3]}*": {name}'


@query("SELECT c_custkey AS cluster_id, CASE WHEN c_mktsegment LIKE 'B%' THEN c_mktsegment ELSE '**' || lower(c_mktsegment[1:3]) || ':** ' || c_mktsegment END AS label FROM customer")
def pretty_labels(spark, sf_dir):
    """Labels with a summary before them, asked for once each; a label whose call fails stays."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cluster_id"), F.col("c_mktsegment").alias("label"))
    return naming.prettified(names, _pretty, q_pipeline._cache(spark))


@query(q_metrics.ORACLE_SQL["metrics_model"])
def chosen_metrics(spark, sf_dir):
    """Metric tables by the stage that the registry has for the method."""
    facts, scores = obs(spark, sf_dir)
    members = facts.withColumnsRenamed({"conversation_id": "question_id", "cluster": "cluster_label"})
    made = pipeline.chosen(pipeline.METRICS, "single_model")(pipeline.Dataset(members, scores=scores, members=members))
    return rounded(made.tables["model_scores"])


@query("""WITH b AS (SELECT conv_id, turn // 2, max(CASE WHEN turn % 2 = 0 THEN text END) AS first, max(CASE WHEN turn % 2 = 1 THEN text END) AS second FROM conversations GROUP BY 1, 2)
    SELECT model, count(*) AS n FROM (SELECT unnest(['one', 'two']) AS model FROM b WHERE first IS NOT NULL AND second IS NOT NULL) GROUP BY model""")
def tidy_run(spark, sf_dir):
    """A configured run over a tidy table that compares two models: the prompts that both answered become battles."""
    path = shared_path(spark, "run")
    rows = table(spark, sf_dir, "conversations")
    rows = rows.select(F.concat_ws("-", "conv_id", F.expr("turn div 2")).alias("prompt"), F.when(F.col("turn") % 2 == 0, "one").otherwise("two").alias("model"), F.col("text").alias("model_response"))
    loaders.save(rows, f"{path}/in.parquet")
    config = {"data_path": f"{path}/in.parquet", "output_dir": f"{path}/out", "model_a": "one", "model_b": "two"}
    provider = lambda request: json.dumps([{"model": f"Model {x}", "property_description": "says something", "behavior_type": "Style"} for x in "AB"])
    out = runs.run(spark, config, provider)
    return out.tables["model_scores"].select("model", "size").withColumnRenamed("size", "n")


@query(f"""WITH m AS (SELECT * FROM ({q_metrics.ORACLE_SQL["metrics_model"]})), c AS (SELECT * FROM ({q_metrics.ORACLE_SQL["metrics_model_cluster"]})),
    t AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY proportion DESC, cluster) AS rank FROM c)
    SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem) || ' conversations, ' || count(*) || ' models' AS value FROM m
    UNION ALL SELECT printf('%d. %s: discount %.3f', row_number() OVER (ORDER BY quality_discount DESC, model), model, quality_discount) FROM m
    UNION ALL SELECT printf('%s: %s in %.1f%%', model, cluster, proportion * 100) FROM t WHERE rank <= 3""")
def summary_lines(spark, sf_dir):
    """A plain text of the models and their most frequent clusters, saved and read back."""
    facts, scores = obs(spark, sf_dir)
    path, n = shared_path(spark, "summary"), facts.select("conversation_id").distinct().count()
    cells, models = rounded(metrics.model_cluster_metrics(facts, scores)), rounded(metrics.model_metrics(facts, scores))
    reports.save_summary(reports.summary_lines(cells, models, n), path)
    return spark.read.text(path)
