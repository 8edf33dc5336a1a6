"""Registered queries of the text, JSON, message, vector, source, pipeline and streaming operators."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumentrace.functions import json_repair, messages, text
from lumentrace.operators import clustering, filters
from lumentrace.plans.facts import rounded
from lumentrace.session import shared_path, table
from lumentrace.sources import traces

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- scalar strings ---


@query("SELECT page_id, trim(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '_') AS name FROM pages")
def safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_filename(F.col("url")).alias("name"))


@query("""SELECT p_partkey, trim(CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_type WHEN 2 THEN p_type ELSE '**' || p_type END) AS item FROM part""")
def clean_list_item(spark, sf_dir):
    item = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('12. ', p_type) WHEN 1 THEN concat('- ', p_type) WHEN 2 THEN concat('  b) ', p_type) ELSE concat('**', p_type) END")
    return table(spark, sf_dir, "part").select("p_partkey", text.list_item(item).alias("item"))


@query("""SELECT n_nationkey, (SELECT r_name FROM region WHERE contains(lower(r_name), lower(substr(n_name, 1, 2))) ORDER BY r_regionkey LIMIT 1) AS label FROM nation""")
def match_label_name(spark, sf_dir):
    regions = table(spark, sf_dir, "region").agg(F.transform(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda r: r["r_name"]).alias("options"))
    return table(spark, sf_dir, "nation").crossJoin(F.broadcast(regions)).select("n_nationkey", text.matched_label(F.concat(F.substring("n_name", 1, 2), F.lit(".")), F.col("options")).alias("label"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'meta_Llama-Instruct' WHEN 1 THEN 'x_qwen' WHEN 2 THEN 'x_qwen' ELSE 'unknown' END AS model FROM orders")
def model_name_pass(spark, sf_dir):
    said = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'llama' WHEN 1 THEN 'Model B' WHEN 2 THEN 'x_qwen' ELSE 'Model C' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.model_of(said, F.lit("meta_Llama-Instruct"), F.lit("x_qwen")).alias("model"))


@query("SELECT page_id, split_part(url, '/', 3) AS base FROM pages")
def base_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("base"))


@query("SELECT o_orderkey, (CASE o_orderkey % 4 WHEN 0 THEN 1.5 * 1099511627776 WHEN 1 THEN 10.0 * 1073741824 WHEN 2 THEN 512 END)::BIGINT AS bytes FROM orders")
def size_to_bytes(spark, sf_dir):
    size = F.expr("CASE o_orderkey % 4 WHEN 0 THEN '1.5TB' WHEN 1 THEN '10GB' WHEN 2 THEN '512B' ELSE 'much' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.bytes_of(size).alias("bytes"))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '... [truncated]' ELSE text END AS text FROM documents")
def shorten_traces(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.shortened(F.col("text")).alias("text"))


@query("""SELECT n_nationkey, 'About ' || n_name || ': {x} ' || coalesce(n_comment, '') AS prompt FROM (SELECT *, NULL::VARCHAR AS n_comment FROM nation)""")
def fill_template(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", text.filled(F.lit("About {name}: {x} {comment}"), name=F.col("n_name"), comment=F.lit(None).cast("string")).alias("prompt"))


@query("""WITH w AS (SELECT item_id, list_filter(string_split(text, ' '), lambda w: w <> '') AS words FROM benchmark)
    SELECT item_id, CASE WHEN len(words) = 0 THEN '' WHEN words IS NOT NULL THEN list_reduce(words, lambda acc, w: CASE WHEN length(split_part(acc, '<br>', -1)) + 1 + length(w) <= 50 THEN acc || ' ' || w ELSE acc || '<br>' || w END) END AS text FROM w""")
def wrap_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.wrapped(F.col("text")).alias("text"))


# --- JSON ---


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_events_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"))


def _answers(spark, sf_dir):
    """Events as model answers: fenced, bare, embellished, broken and empty JSON."""
    d = F.col("event_type")
    item = F.format_string('{"property_description": "%s", "category": "c", "evidence": "q1", "q2", "reason": "r", "behavior_type": "Style"}', d)
    clean = F.format_string('{"property_description": "%s", "behavior_type": "Style", "contains_errors": false}', d)
    shape = F.col("event_id") % 6
    answer = (
        F.when(shape == 0, F.concat(F.lit("Here it is:\n```json\n["), clean, F.lit(","), clean, F.lit("]\n```")))
        .when(shape == 1, F.concat(F.lit("["), clean, F.lit(",]")))
        .when(shape == 2, F.concat(F.lit("So: "), item, F.lit(" and that is it")))
        .when(shape == 3, F.lit("[]"))
        .when(shape == 4, F.lit("no answer"))
        .otherwise(F.lit("```json\n5\n```"))
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("row_idx"), answer.alias("raw_response"))


@query("""WITH e AS (SELECT event_id AS row_idx, event_type AS d, event_id % 6 AS s, unnest(range(CASE WHEN event_id % 6 = 0 THEN 2 ELSE 1 END)) AS p FROM events)
    SELECT row_idx, p::INT AS pos, CASE WHEN s <= 2 THEN d END AS property_description, CASE WHEN s = 2 THEN 'q1,q2' END AS evidence, CASE WHEN s IN (0, 1) THEN 'false' END AS contains_errors,
    CASE s WHEN 3 THEN 'EMPTY_LIST_RESPONSE' WHEN 4 THEN 'JSON_PARSE_ERROR' WHEN 5 THEN 'UNSUPPORTED_JSON_SHAPE' END AS error_type FROM e""")
def property_rows_from_json(spark, sf_dir):
    rows = json_repair.parsed_rows(_answers(spark, sf_dir))
    return rows.select("row_idx", "pos", "property_description", F.when(F.col("evidence").isNotNull(), F.array_join("evidence", ",")).alias("evidence"), "contains_errors", "error_type")


@query("SELECT CASE event_id % 6 WHEN 3 THEN 'EMPTY_LIST_RESPONSE' WHEN 4 THEN 'JSON_PARSE_ERROR' WHEN 5 THEN 'UNSUPPORTED_JSON_SHAPE' END AS error_type, count(*) AS count FROM events WHERE event_id % 6 >= 3 GROUP BY 1")
def json_tolerant_parse(spark, sf_dir):
    return json_repair.parsed_rows(_answers(spark, sf_dir)).where("error_type is not null").groupBy("error_type").agg(F.count("*").alias("count"))


@query("SELECT event_id AS row_idx, CASE WHEN event_id % 6 = 0 THEN 'invalid JSON' WHEN event_id % 6 <= 3 THEN 'no code fence' ELSE 'no brackets' END AS problem FROM events")
def json_diagnosis(spark, sf_dir):
    return _answers(spark, sf_dir).select("row_idx", json_repair.diagnosis().alias("problem"))


@query(f"SELECT event_id AS row_idx FROM events WHERE event_id % 6 <= 2 AND event_type IS NOT NULL")
def validated_properties(spark, sf_dir):
    rows = json_repair.parsed_rows(_answers(spark, sf_dir)).where("error_type is null")
    return filters.split_valid(rows)[0].select("row_idx").distinct()


# --- messages ---


@query("SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'assistant') AS n_assistant FROM conversations GROUP BY 1")
def chat_to_messages(spark, sf_dir):
    chats = messages.conversations(table(spark, sf_dir, "conversations"))
    return chats.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.size(F.filter("messages", lambda m: m["role"] == "assistant")).cast("long").alias("n_assistant"))


@query("SELECT conv_id, sha256(string_agg('=== ' || upper(role) || ' ===' || chr(10) || coalesce(text, '(empty)'), chr(10) || chr(10) ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY 1")
def conversation_to_text(spark, sf_dir):
    return messages.rendered(table(spark, sf_dir, "conversations")).select("conv_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def _agentic(rows):
    """Turn rows as messages in JSON with a tool call and an image on some."""
    call = F.lit('[{"id":"1","type":"function","function":{"name":"look","arguments":"{}"}}]')
    content = F.to_json(F.array(F.struct(F.lit("text").alias("type"), "text")))
    one = F.concat(F.lit('{"role":"'), F.col("role"), F.lit('","content":'), F.when(F.col("turn") == 0, F.to_json(F.array("text"))).otherwise(content), F.lit(',"tool_calls":'), call, F.lit("}"))
    return rows.select("conv_id", "turn", F.concat(F.lit("["), one, F.lit("]")).alias("raw"))


def _tool_texts(rows):
    out = messages.with_segments(_agentic(rows), "raw")
    return out.select("conv_id", "turn", F.size(F.flatten(F.transform("messages", lambda m: m["segments"]))).alias("n_segments"), messages.has_image(F.col("messages")).alias("has_image"), F.sha2(messages.as_text(F.col("messages")).cast("binary"), 256).alias("text_sha256"))


@query("SELECT conv_id, turn, 2 AS n_segments, false AS has_image, sha256('=== ' || upper(role) || ' ===' || chr(10) || text || chr(10) || '[call look({})]') AS text_sha256 FROM conversations")
def tool_calls_to_text(spark, sf_dir):
    return _tool_texts(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id AS trace_id, count(*) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations WHERE role <> 'system' AND text <> '' GROUP BY 1")
def trace_to_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    span = F.concat(
        F.lit('{"timestamp":"'), F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit('","span_attributes":{"openinference.span.kind":"LLM","llm.input_messages":'),
        F.to_json(F.array(F.struct("role", F.col("text").alias("content")))), F.lit("},\"child_spans\":[]}"),
    )
    made = rows.groupBy(F.col("conv_id").cast("string").alias("trace_id")).agg(F.concat(F.lit('{"spans":['), F.array_join(F.collect_list(span), ","), F.lit("]}")).alias("trace"))
    out = traces.conversations(traces.events(made))
    return out.select(F.col("trace_id").cast("long").alias("trace_id"), F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


# --- vectors ---


@query("""WITH l AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS sd FROM l GROUP BY 1)
    SELECT vec_id, dim, round((x - m) / (sd + 1e-8), 5) + 0.0 AS z FROM l JOIN s USING (dim)""")
def standardize_embeddings(spark, sf_dir):
    return rounded(clustering.standardised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), 5)


@query("""WITH l AS (SELECT label AS c_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT c_id, dim, avg(x) AS x FROM l GROUP BY 1, 2),
    c AS (SELECT c_id, list(x ORDER BY dim) AS c FROM m GROUP BY 1), p AS (SELECT vec_id, c_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 9) AS s FROM embeddings, c)
    SELECT vec_id, c_id, round(s, 6) + 0.0 AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c_id) AS n FROM p) WHERE n = 1""")
def cosine_assign_nearest(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return rounded(clustering.nearest(e, clustering.mean_vectors(e, "label", "embedding").withColumnRenamed("label", "c_id"), "vec_id", "c_id"))


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def l2_norms(spark, sf_dir):
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", clustering.norm(F.col("embedding")).alias("norm")), 5)


@query()
def hdbscan_labels(spark, sf_dir):
    values = table(spark, sf_dir, "embeddings").select(F.col("label").alias("stratum"), F.col("vec_id").alias("value"), "embedding")
    return clustering.cluster_strata(values, min_cluster_size=5)


_BLOBS = """c AS (SELECT n_regionkey AS stratum, c_custkey AS value, CASE WHEN c_custkey > 20 THEN c_custkey % 3 END AS blob FROM customer JOIN nation ON c_nationkey = n_nationkey),
    b AS (SELECT stratum, blob, row_number() OVER (PARTITION BY stratum ORDER BY min(value)) - 1 AS cluster FROM c WHERE blob IS NOT NULL GROUP BY stratum, blob)"""


def _blobs(spark, sf_dir):
    """Customers of a region in a plane: three lines of customers one apart, far from each other, and twenty customers alone, ever farther."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.col("n_regionkey").alias("stratum"), F.col("c_custkey").alias("value"), F.when(F.col("c_custkey") > 20, F.col("c_custkey") % 3).alias("blob"))
    place = F.row_number().over(Window.partitionBy("stratum", "blob").orderBy("value")).cast("double")
    at = F.when(F.col("blob").isNull(), F.array(F.lit(0.0), F.pow(F.lit(2.0), place) * 1e9)).otherwise(F.array(F.col("blob") * 1e7, place))
    return c.select("stratum", "value", at.alias("embedding"))


@query(f"WITH {_BLOBS} SELECT c.stratum, value, coalesce(cluster, -1) AS cluster FROM c LEFT JOIN b ON c.stratum = b.stratum AND c.blob = b.blob")
def density_clusters(spark, sf_dir):
    """Clusters that stand apart: the parts into which links shorter than the way between the lines tie the customers; those alone are noise."""
    return clustering.cluster_strata(_blobs(spark, sf_dir), min_cluster_size=5, scale=False)


@query(f"WITH {_BLOBS} SELECT stratum, count(*) - 1 AS n_edges, count(*) FILTER (blob IS NULL) + count(DISTINCT blob) - 1 AS long_edges FROM c GROUP BY stratum")
def spanning_trees(spark, sf_dir):
    """The tree of each region's customers by rounds over all links that blocks of them leave: its links, and the long ones."""
    points = clustering.prepared(_blobs(spark, sf_dir), scale=False)[1]
    tree = clustering.strata_trees(points, reduce_to=1000)
    names = points.groupBy("sid").agg(F.first("stratum").alias("stratum"))
    return tree.groupBy("sid").agg(F.count("*").alias("n_edges"), F.sum((F.col("d") > 2).cast("long")).alias("long_edges")).join(names, "sid").select("stratum", "n_edges", "long_edges")


@query("SELECT doc_id AS property_id, CASE WHEN lang IN ('de', 'en') THEN lang ELSE 'Other' END AS cluster_label, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END::BIGINT AS cluster_id FROM documents")
def taxonomy_assign(spark, sf_dir):
    taxonomy = spark.createDataFrame([("de", 0), ("en", 1)], "label string, id long")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("property_id"), F.concat(F.lit(" "), F.col("lang")).alias("category"))
    return clustering.taxonomy_assigned(rows, taxonomy).select("property_id", "cluster_label", "cluster_id")


# --- the pipeline, with an offline provider ---


def _offline(request: str) -> str:
    """Answers from the request's words alone, in place of a language model."""
    words = sorted(set(request.rsplit("[answer]", 1)[-1].lower().split()))[:2]
    return json.dumps([{"property_description": w, "behavior_type": "Style", "category": "words", "evidence": w, "reason": "occurs"} for w in words])


@query()
def pipeline_explain(spark, sf_dir):
    from lumentrace.operators.providers import CallCache
    from lumentrace.plans import pipeline

    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), F.lit("?").alias("prompt"), F.concat(F.lit("m"), (F.col("item_id") % 2).cast("string")).alias("model"), F.col("text").alias("model_response"))
    out = pipeline.explain(rows, _offline, CallCache(spark, shared_path(spark, "calls")), min_cluster_size=2)
    return out.tables["model_cluster_scores"].select("model", "cluster", "size", "proportion")


# --- streams ---


@query("SELECT floor(epoch(ts::TIMESTAMP) / 3600)::BIGINT AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, sf_dir):
    """The streamed hourly counts of all events: the stream works off the table and its closed and open windows are read back."""
    import uuid

    from lumentrace.streaming import streams

    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    counted = streams.windowed_counts(stream.withColumn("at", F.col("ts").cast("timestamp")), "at", "event_type")
    name = f"counts_{uuid.uuid4().hex}"
    done = counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", shared_path(spark, name)).trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.table(name).select(F.expr("unix_timestamp(window_start) div 3600").alias("hour"), "event_type", "n")
