"""Registered queries of the filter, join, reshape, grouping and ranking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrace.operators import filters, grouping, joins, metrics, ranking, reshape
from lumentrace.plans.facts import OBS, doc_obs, obs, rounded
from lumentrace.session import table

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


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


# --- filters ---


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src0', 'src1', 'src2') AND NOT coalesce(source IN ('src1'), false)")
def select_include_exclude(spark, sf_dir):
    return filters.select(_docs(spark, sf_dir), {"lang": ["en", "fr"], "source": ["src0", "src1", "src2"], "nowhere": ["x"], "n_chars": []}, {"source": ["src1"]})


def _properties(spark, sf_dir):
    """Events as extracted properties: the event type, or blank, as behaviour type."""
    e = table(spark, sf_dir, "events")
    kind = F.expr("CASE event_id % 5 WHEN 0 THEN 'Positive' WHEN 1 THEN 'Style' WHEN 2 THEN 'Neutral' WHEN 3 THEN '' END")
    text = F.when(F.col("event_id") % 7 == 0, F.lit("  ")).otherwise(F.col("event_type"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("question_id"), text.alias("property_description"), kind.alias("behavior_type"))


PROPERTIES = """p AS (SELECT event_id AS id, user_id AS question_id, CASE WHEN event_id % 7 = 0 THEN '  ' ELSE event_type END AS property_description,
    CASE event_id % 5 WHEN 0 THEN 'Positive' WHEN 1 THEN 'Style' WHEN 2 THEN 'Neutral' WHEN 3 THEN '' END AS behavior_type FROM events)"""
_VALID = "trim(property_description) <> '' AND (coalesce(trim(behavior_type), '') = '' OR behavior_type IN ('Positive', 'Negative (critical)', 'Negative (non-critical)', 'Style'))"


@query(f"WITH {PROPERTIES} SELECT id, question_id, property_description, behavior_type FROM p WHERE {_VALID}")
def filter_valid_properties(spark, sf_dir):
    return filters.split_valid(_properties(spark, sf_dir))[0]


@query(f"WITH {PROPERTIES} SELECT id, question_id, property_description, behavior_type FROM p WHERE NOT ({_VALID})")
def filter_invalid_properties(spark, sf_dir):
    return filters.split_valid(_properties(spark, sf_dir))[1]


@query(f"WITH {PROPERTIES} SELECT id, question_id FROM p WHERE property_description IS NOT NULL AND trim(property_description) <> ''")
def filter_nonblank(spark, sf_dir):
    return _properties(spark, sf_dir).where(~filters.blank("property_description")).select("id", "question_id")


@query(f"WITH {PROPERTIES} SELECT id, behavior_type FROM p WHERE behavior_type = 'Positive'")
def filter_positive_bypass(spark, sf_dir):
    return filters.bypassed(_properties(spark, sf_dir), keep_positive=False)[1].select("id", "behavior_type")


@query(f"""WITH {PROPERTIES} SELECT behavior_type AS cluster_label, count(*) AS size, count(DISTINCT question_id) AS total_unique_conversations
    FROM p WHERE trim(property_description) <> '' AND behavior_type IS NOT NULL GROUP BY 1""")
def filter_members_array(spark, sf_dir):
    rows = _properties(spark, sf_dir).where("behavior_type is not null").groupBy(F.col("behavior_type").alias("cluster_label"))
    clusters = rows.agg(F.collect_list(F.struct("property_description", "id", "question_id")).alias("m")).select(
        "cluster_label", F.col("m.property_description").alias("property_descriptions"), F.col("m.id").alias("property_ids"), F.col("m.question_id").alias("question_ids")
    )
    return filters.valid_members(clusters).select("cluster_label", "size", "total_unique_conversations")


@query("SELECT doc_id, source AS model FROM documents WHERE source IN ('src3', 'src4')")
def filter_models(spark, sf_dir):
    return filters.by_models(_docs(spark, sf_dir).select("doc_id", F.col("source").alias("model")), ["src3", "src4"])


# --- joins ---


@query("""SELECT o_orderkey AS question_id, o_orderstatus AS model, l_linenumber AS property_id, l_quantity::DOUBLE AS quantity FROM orders LEFT JOIN
    (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus""")
def join_conv_props_single(spark, sf_dir):
    conversations = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderstatus").alias("model"))
    items = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    props = items.select(F.col("l_orderkey").alias("question_id"), F.col("l_linestatus").alias("model"), F.col("l_linenumber").alias("property_id"), F.col("l_quantity").cast("double").alias("quantity"))
    return joins.conversations_with_properties(conversations, props)


@query("""SELECT o_orderkey AS question_id, coalesce(l_returnflag, o_orderstatus) AS model, l_linenumber AS property_id FROM orders LEFT JOIN
    (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey""")
def join_conv_props_sxs(spark, sf_dir):
    conversations = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderstatus").alias("model"))
    items = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    props = items.select(F.col("l_orderkey").alias("question_id"), F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("property_id"))
    return joins.conversations_with_properties(conversations, props, side_by_side=True)


@query("SELECT p_partkey AS property_id, p_brand AS cluster_label, l_orderkey AS question_id FROM part JOIN lineitem ON l_partkey = p_partkey")
def join_members_props(spark, sf_dir):
    members = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("property_id"), F.col("p_brand").alias("cluster_label"))
    props = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("property_id"), F.col("l_orderkey").alias("question_id"))
    return joins.members_with_properties(members, props)


@query(f"WITH {OBS} SELECT conversation_id, model, cluster, round(discount, 6) AS discount, round(quantity, 6) AS quantity FROM facts LEFT JOIN scores USING (conversation_id, model)")
def join_scores_left(spark, sf_dir):
    facts, scores = obs(spark, sf_dir)
    return rounded(joins.with_scores(facts.drop("property_id"), scores))


_IDS = """l AS (SELECT CASE WHEN event_id % 3 = 0 THEN event_id::VARCHAR || '-1' ELSE event_id::VARCHAR END AS id FROM events),
r AS (SELECT CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR || '-' || (event_id % 4)::VARCHAR ELSE event_id::VARCHAR END AS id, event_type FROM events)"""


@query(f"""WITH {_IDS}, f AS (SELECT *, split_part(id, '-', 1) AS base, row_number() OVER (PARTITION BY split_part(id, '-', 1) ORDER BY id) AS n FROM r)
    SELECT l.id, coalesce(r.id, f.id) AS matched_id, CASE WHEN r.id IS NOT NULL THEN 'exact' WHEN f.id IS NOT NULL THEN 'base' END AS match, CASE WHEN r.id IS NOT NULL THEN r.event_type ELSE f.event_type END AS event_type
    FROM l LEFT JOIN r ON l.id = r.id LEFT JOIN f ON f.n = 1 AND f.base = split_part(l.id, '-', 1)""")
def join_base_id_priority(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.col("event_id").cast("string")
    left = e.select(F.when(F.col("event_id") % 3 == 0, F.concat(text, F.lit("-1"))).otherwise(text).alias("id"))
    right = e.select(F.when(F.col("event_id") % 2 == 0, F.concat(text, F.lit("-"), (F.col("event_id") % 4).cast("string"))).otherwise(text).alias("id"), "event_type")
    return joins.by_id_or_base(left, right)


@query("""SELECT page_id, url, item FROM (SELECT page_id, url, b.item, row_number() OVER (PARTITION BY page_id, url ORDER BY b.item) AS n FROM pages
    JOIN (SELECT DISTINCT substr(url, 9, 12) AS item FROM pages) b ON contains(url, b.item)) WHERE n = 1""")
def join_substring_theta(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return joins.containing(pages, pages.select(F.substring("url", 9, 12).alias("item")).distinct(), "url", "item")


@query("""WITH p AS (SELECT DISTINCT substr(event_type, 1 + (event_id % 3)::BIGINT, 2 + (event_id % 5)::BIGINT) AS part FROM events WHERE event_id % 7 <> 3),
    t AS (SELECT event_type, min(part) AS part FROM (SELECT DISTINCT event_type FROM events) JOIN p ON part <> '' AND contains(event_type, part) GROUP BY 1)
    SELECT event_type || user_id % 3 AS text, part FROM events JOIN t USING (event_type)""")
def join_substring_repeats(spark, sf_dir):
    """Texts that many rows share with the smallest of the parts that they hold, short parts and longer ones; each row has its own."""
    e = table(spark, sf_dir, "events")
    parts = e.where("event_id % 7 <> 3").select(F.substr("event_type", (F.col("event_id") % 3 + 1).cast("int"), (F.col("event_id") % 5 + 2).cast("int")).alias("part")).distinct()
    return joins.containing(e.select(F.concat("event_type", (F.col("user_id") % 3).cast("string")).alias("text")), parts, "text", "part")


@query("""SELECT doc_id, lang AS prompt, source AS model FROM documents WHERE lang IN
    (SELECT lang FROM documents WHERE source IN ('src1', 'src2') GROUP BY lang HAVING count(DISTINCT source) = 2)""")
def join_semi_paired(spark, sf_dir):
    df = _docs(spark, sf_dir).select("doc_id", F.col("lang").alias("prompt"), F.col("source").alias("model"))
    return joins.answered_by_all(df, ["src1", "src2"])


@query("SELECT doc_id AS question_id, source AS model FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def join_anti_no_properties(spark, sf_dir):
    conversations = _docs(spark, sf_dir).select(F.col("doc_id").alias("question_id"), F.col("source").alias("model"))
    labelled = conversations.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id")), "question_id")
    return joins.without_properties(conversations, labelled)


@query("""WITH a AS (SELECT l_orderkey, l_returnflag, l_quantity::DOUBLE AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_partkey, l_suppkey) AS n, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS c FROM lineitem),
    s AS (SELECT * FROM a WHERE c = 1) SELECT x.l_orderkey AS prompt, round(x.q, 6) AS quantity_a, round(y.q, 6) AS quantity_b FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.l_returnflag = 'A' AND y.l_returnflag = 'R'""")
def tidy_to_sxs_pairs(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("prompt"), F.col("l_returnflag").alias("model"), F.col("l_quantity").cast("double").alias("quantity"))
    single = rows.withColumn("c", F.count("*").over(Window.partitionBy("prompt", "model"))).where("c = 1").drop("c")
    return rounded(joins.tidy_pairs(single, "A", "R", ["prompt"], ["quantity"]))


@query("""WITH a AS (SELECT l_orderkey AS task, l_linenumber AS trial, min(l_partkey) AS part FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
    b AS (SELECT DISTINCT l_orderkey AS task, l_linenumber AS trial FROM lineitem WHERE l_returnflag = 'N') SELECT a.* FROM a JOIN b USING (task, trial)""")
def join_intersection_trials(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("trial"), F.col("l_partkey").alias("part"), "l_returnflag")
    a, b = (items.where(F.col("l_returnflag") == f).drop("l_returnflag") for f in "AN")
    return joins.common_trials(a, b, ["task", "trial"], "part")[0]


@query("""SELECT count(*) AS n_pairs FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max((l_returnflag = 'A')::INT) = 1 AND max((l_returnflag = 'N')::INT) = 1)""")
def join_estimated_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("prompt"), F.col("l_returnflag").alias("model"))
    return joins.estimated_pairs(rows, "A", "N")


@query(f"""WITH {OBS}, cells AS (SELECT model, cluster, count(*) AS size FROM triples GROUP BY 1, 2), m AS (SELECT model, count(*) AS t FROM pairs GROUP BY 1)
    SELECT cluster, sum(size)::BIGINT AS total_size, string_agg(model || '=' || printf('%.4f', size / t::DOUBLE), ',' ORDER BY model) AS proportions FROM cells JOIN m USING (model) GROUP BY 1""")
def join_cluster_enrich(spark, sf_dir):
    facts, scores = obs(spark, sf_dir)
    cells = metrics.model_cluster_metrics(facts, scores)
    out = joins.enriched(facts.select("cluster").distinct(), cells)
    text = F.array_join(F.transform(F.map_entries("proportions"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))), ",")
    return out.select("cluster", "total_size", text.alias("proportions"))


@query("""SELECT p_partkey AS property_id, cluster_label FROM part LEFT JOIN (SELECT l_partkey, max_by(l_returnflag, struct_pack(a := l_orderkey, b := l_linenumber, c := l_suppkey, d := l_quantity)) AS cluster_label FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def join_last_cluster(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    pos = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    members = items.select(F.col("l_partkey").alias("property_id"), pos.alias("member_pos"), F.lit(0).alias("cluster_id"), F.col("l_returnflag").alias("cluster_label"))
    return joins.last_cluster_of(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("property_id")), members).drop("cluster_id")


# --- shapes ---


@query(f"WITH {OBS} SELECT conversation_id, model, 'discount' AS metric, round(discount, 6) AS value FROM scores UNION ALL SELECT conversation_id, model, 'quantity', round(quantity, 6) FROM scores")
def unpivot_scores(spark, sf_dir):
    return rounded(reshape.long(obs(spark, sf_dir)[1], ["conversation_id", "model"], ["discount", "quantity"]))


@query(f"WITH {OBS} SELECT conversation_id, model, round(discount, 6) AS discount, round(quantity, 6) AS quantity FROM scores")
def flatten_long_to_wide(spark, sf_dir):
    scores = obs(spark, sf_dir)[1]
    return rounded(reshape.wide(metrics.long_scores(scores), ["conversation_id", "model"], ["discount", "quantity"]))


@query(f"WITH {OBS} SELECT model, cluster, count(*) AS size FROM triples GROUP BY 1, 2")
def unflatten_nested(spark, sf_dir):
    facts, _ = obs(spark, sf_dir)
    cells = facts.select("conversation_id", "model", "cluster").distinct().groupBy("model", "cluster").agg(F.count("*").alias("size"))
    return reshape.flat_of_nested(reshape.nested_by_model(cells, "size"), "size")


@query("SELECT DISTINCT p_type AS metric, replace(replace(replace(replace(replace(p_type, '(', ''), ')', ''), ' ', '_'), '/', '_'), '-', '_') AS clean FROM part")
def sanitize_metric_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("metric")).distinct().withColumn("clean", reshape.sanitized("metric"))


@query(f"""WITH {OBS}, c AS (SELECT model, cluster, count(*) AS n FROM triples WHERE cluster IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1, 2)
    SELECT model, max(n) FILTER (cluster = 'Brand#1') AS "Brand#1", max(n) FILTER (cluster = 'Brand#2') AS "Brand#2", max(n) FILTER (cluster = 'Brand#3') AS "Brand#3" FROM c GROUP BY 1""")
def pivot_heatmap(spark, sf_dir):
    facts, _ = obs(spark, sf_dir)
    some = ["Brand#1", "Brand#2", "Brand#3"]
    cells = facts.where(F.col("cluster").isin(*some)).select("conversation_id", "model", "cluster").distinct().groupBy("model", "cluster").agg(F.count("*").alias("n"))
    return reshape.heatmap(cells, "n", some)


@query("""SELECT p_brand AS cluster_label, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS member_pos, p_partkey AS property_id, p_type AS property_description FROM part""")
def explode_members(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("cluster_id"), F.col("p_brand").alias("cluster_label"), F.col("p_partkey").alias("property_id"), F.col("p_partkey").alias("row_idx"), F.col("p_type").alias("property_description"), F.col("p_size").alias("question_id"))
    return reshape.exploded_members(grouping.clusters_of(rows)).select("cluster_label", F.col("member_pos").cast("long").alias("member_pos"), "property_id", "property_description")


@query("""SELECT o_orderkey AS battle, 'a' AS side, o_orderstatus AS model, o_totalprice::DOUBLE AS value FROM orders UNION ALL SELECT o_orderkey, 'b', o_orderpriority, -o_totalprice::DOUBLE FROM orders""")
def sxs_to_tidy_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("double")
    battles = o.select(F.col("o_orderkey").alias("battle"), F.col("o_orderstatus").alias("model_a"), F.col("o_orderpriority").alias("model_b"), price.alias("value_a"), (-price).alias("value_b"))
    return reshape.side_to_tidy(battles, ["battle"], ["value"])


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN '' ELSE 'quality=' || quality::VARCHAR || '.0,toxic=' || toxic::VARCHAR || '.0' END AS score FROM documents LEFT JOIN labels USING (doc_id)""")
def score_columns_to_map(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    out = reshape.scores_to_map(rows, ["quality", "toxic"])
    text = F.array_join(F.transform(F.map_entries("score"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("doc_id", text.alias("score"))


@query("SELECT doc_id, quality::DOUBLE AS score_quality, toxic::DOUBLE AS score_toxic FROM documents LEFT JOIN labels USING (doc_id)")
def score_map_to_columns(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return reshape.scores_to_columns(reshape.scores_to_map(rows, ["quality", "toxic"]), ["quality", "toxic"])


@query("""SELECT o_orderkey AS battle, CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 WHEN 2 THEN 0.0 END::DOUBLE AS score_a, CASE o_orderkey % 4 WHEN 0 THEN -1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 END::DOUBLE AS score_b FROM orders""")
def winner_to_scores(spark, sf_dir):
    winner = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'model_b' WHEN 2 THEN 'Tie (bothbad)' ELSE 'z' END")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("battle"), F.lit("x").alias("model_a"), F.lit("y").alias("model_b"), winner.alias("winner"))
    a, b = reshape.winner_scores()
    return rows.select("battle", a.alias("score_a"), b.alias("score_b"))


# --- groups ---


@query("SELECT lang, count(*) AS count, round(avg(n_chars), 6) AS mean_n_chars, round(avg(doc_id), 6) AS mean_doc_id FROM documents GROUP BY lang")
def groupby_preview(spark, sf_dir):
    return rounded(grouping.preview(_docs(spark, sf_dir), "lang"))


@query("""WITH c AS (SELECT lang AS cluster, source AS model, count(*) AS count FROM documents GROUP BY 1, 2), s AS (SELECT *, count / sum(count) OVER (PARTITION BY model) * 100 AS percent FROM c)
    SELECT cluster, model, count, round(percent, 6) AS percent, round(percent / median(percent) OVER (PARTITION BY cluster), 6) AS ratio_to_median FROM s""")
def cluster_summary_table(spark, sf_dir):
    return rounded(grouping.summary_table(_docs(spark, sf_dir).select(F.col("lang").alias("cluster"), F.col("source").alias("model"))))


@query("""WITH s AS (SELECT CASE WHEN source IN ('src0', 'src1') THEN 'Outliers' ELSE source END AS c, count(*) AS n FROM documents GROUP BY 1)
    SELECT count(*) FILTER (c <> 'Outliers') AS n_clusters, coalesce(sum(n) FILTER (c = 'Outliers'), 0)::BIGINT AS n_outliers, round(coalesce(sum(n) FILTER (c = 'Outliers'), 0) / sum(n)::DOUBLE, 6) AS outlier_rate,
    min(n) FILTER (c <> 'Outliers') AS min_size, round(avg(n) FILTER (c <> 'Outliers'), 6) AS avg_size, max(n) FILTER (c <> 'Outliers') AS max_size FROM s""")
def cluster_size_stats(spark, sf_dir):
    label = F.when(F.col("source").isin("src0", "src1"), "Outliers").otherwise(F.col("source"))
    return rounded(grouping.size_statistics(_docs(spark, sf_dir).select(label.alias("cluster"))))


@query("SELECT label, coalesce(size, 0) AS size FROM (SELECT DISTINCT n_name AS label FROM nation UNION SELECT DISTINCT event_type FROM events) LEFT JOIN (SELECT event_type AS label, count(*) AS size FROM events GROUP BY 1) USING (label)")
def label_clusters_left(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("label"))
    taxonomy = table(spark, sf_dir, "nation").select(F.col("n_name").alias("label")).union(events).distinct()
    return grouping.labelled(taxonomy, events)


@query("SELECT event_type AS error_type, count(*) AS count FROM events GROUP BY 1")
def error_type_counts(spark, sf_dir):
    return grouping.counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("error_type")), "error_type")


@query("SELECT coalesce(quality::VARCHAR, 'unknown') AS model, count(*) AS count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def counts_with_unknown(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("quality").cast("string").alias("model"))
    return grouping.counts(rows, "model", "unknown")


@query("SELECT count(DISTINCT source) AS n_models, count(DISTINCT lang) AS n_clusters, coalesce(sum((n_chars > 2000)::INT), 0)::BIGINT AS n_flagged FROM documents")
def summary_stats(spark, sf_dir):
    cells = _docs(spark, sf_dir).select(F.col("source").alias("model"), F.col("lang").alias("cluster"), (F.col("n_chars") > 2000).alias("flag"))
    return grouping.summary_stats(cells, "flag")


@query(f"""WITH {OBS}, few AS (SELECT conversation_id, row_number() OVER (PARTITION BY model, cluster ORDER BY conversation_id) AS r FROM triples) SELECT count(DISTINCT conversation_id) AS n_battles FROM few WHERE r <= 3""")
def distinct_battles(spark, sf_dir):
    facts, scores = obs(spark, sf_dir)
    return grouping.distinct_examples(metrics.with_metadata(metrics.model_cluster_metrics(facts, scores), facts))


@query("SELECT count(*) AS total, count(*) FILTER (quality IS NULL) AS failures, round(count(quality)::DOUBLE / count(*), 6) AS success_rate, round(avg(CASE WHEN quality IS NOT NULL THEN n_chars END), 6) AS avg_length FROM documents LEFT JOIN labels USING (doc_id)")
def extraction_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rounded(grouping.extraction_stats(docs.select(F.when(F.col("quality").isNotNull(), F.col("text")).alias("raw_response"))))


# --- windows, top-k, samples ---


@query(f"""WITH {OBS}, c AS (SELECT model, cluster, count(*) AS size FROM triples GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY size DESC, cluster) AS rank FROM c) WHERE rank <= 5""")
def topk_clusters_per_model(spark, sf_dir):
    facts, scores = obs(spark, sf_dir)
    cells = metrics.model_cluster_metrics(facts, scores).select("model", "cluster", "size")
    return ranking.top_k(cells, ["model"], "size", 5, "cluster")


@query(f"WITH {OBS} SELECT model, round(avg(quantity), 6) AS quality, rank() OVER (ORDER BY avg(quantity) DESC) AS rank FROM pairs GROUP BY 1")
def rank_models(spark, sf_dir):
    facts, scores = obs(spark, sf_dir)
    return rounded(ranking.ranked(metrics.model_metrics(facts, scores).select("model", F.col("quality_quantity").alias("quality")), "quality"))


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_keep_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    return ranking.keep_first(docs, ["h", "n"], "doc_id").select("doc_id", "lang", "source")


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value > 50 END AS ok FROM events), i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM e WHERE ok IS NOT NULL)
    SELECT user_id, island::BIGINT AS island, count(*) AS run_length, min(event_id) AS run_start FROM i WHERE NOT ok GROUP BY 1, 2""")
def run_length_failures(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("value") > 50).alias("ok"))
    return ranking.failure_runs(rows, ["user_id"], ["event_id"])


@query("SELECT lang, source, doc_id, n FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3")
def first_n_examples(spark, sf_dir):
    return ranking.examples(_docs(spark, sf_dir).select("lang", "source", "doc_id"), ["lang", "source"], "doc_id")


@query("WITH f AS (SELECT lang, source, row_number() OVER (ORDER BY min(doc_id), lang, source) - 1 AS new_id FROM documents GROUP BY 1, 2) SELECT doc_id, lang, source, new_id FROM documents JOIN f USING (lang, source)")
def reid_groups(spark, sf_dir):
    return ranking.renumbered(_docs(spark, sf_dir).select("doc_id", "lang", "source"), ["lang", "source"], "doc_id").withColumn("new_id", F.col("new_id").cast("long"))


@query("""WITH k AS (SELECT doc_id, lang, lang || '-' || source AS label FROM documents) SELECT doc_id, lang, CASE WHEN count(*) OVER (PARTITION BY label) < 12 THEN 'Outliers - ' || lang ELSE label END AS label FROM k""")
def small_label_to_outlier(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "lang", F.concat_ws("-", "lang", "source").alias("label"))
    return ranking.small_to_outliers(rows, "label", 12, "lang")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40")
def page_offset_limit(spark, sf_dir):
    return ranking.page(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id", 40, 20)


@query("SELECT doc_id, lang FROM documents ORDER BY md5(doc_id::VARCHAR || '-42'), doc_id LIMIT 100")
def sample_rows_exact(spark, sf_dir):
    return ranking.sample_rows(_docs(spark, sf_dir).select("doc_id", "lang"), 100, "doc_id")


@query("""WITH p AS (SELECT l_orderkey AS prompt, l_returnflag AS model FROM lineitem), f AS (SELECT prompt FROM p GROUP BY 1 HAVING count(DISTINCT model) = 3 ORDER BY md5(prompt::VARCHAR || '-42'), prompt LIMIT 30)
    SELECT prompt, model FROM p WHERE prompt IN (SELECT prompt FROM f)""")
def sample_prompts_even(spark, sf_dir):
    return ranking.sample_prompts(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("prompt"), F.col("l_returnflag").alias("model")), 90)


@query("""WITH p AS (SELECT DISTINCT source AS model, lang AS prompt FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY md5(prompt || '-42'), prompt) AS n FROM p)
    SELECT doc_id, source AS model, lang AS prompt FROM documents JOIN f ON f.model = source AND f.prompt = lang AND n <= 2""")
def sample_prompts_fallback(spark, sf_dir):
    return ranking.sample_each(_docs(spark, sf_dir).select("doc_id", F.col("source").alias("model"), F.col("lang").alias("prompt")), 2).select("doc_id", "model", "prompt")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '-42'), doc_id) AS n FROM documents) WHERE n <= 5")
def sample_cluster_members(spark, sf_dir):
    return ranking.sample_members(_docs(spark, sf_dir).select("source", "doc_id"), ["source"], "doc_id", 5)


@query("""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM conversations), b AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
    SELECT conv_id, turn, least(len(w), 60 - before)::BIGINT AS n_tokens FROM b WHERE before < 60""")
def token_truncate(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = ranking.until_budget(chats, ["conv_id"], "turn", "text", 60)
    return out.select("conv_id", "turn", F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda t: t != "")).cast("long").alias("n_tokens"))


# --- sets ---


@query("SELECT o_orderstatus AS model FROM orders UNION SELECT o_orderpriority FROM orders")
def union_models_distinct(spark, sf_dir):
    return grouping.models_of(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_keys(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def intersect_keys(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id").intersect(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1")
def unstack_counts(spark, sf_dir):
    return _docs(spark, sf_dir).where("lang in ('en', 'fr')").groupBy("source").pivot("lang", ["en", "fr"]).count().na.fill(0)


@query("SELECT source AS cluster, lang AS model, count(*) AS size FROM documents GROUP BY 1, 2 UNION ALL SELECT 'all', lang, count(*) FROM documents GROUP BY 2")
def union_by_name(spark, sf_dir):
    facts, _ = doc_obs(spark, sf_dir)
    cells = facts.groupBy(F.col("model").alias("cluster"), F.col("cluster").alias("model")).agg(F.count("*").alias("size"))
    whole = facts.groupBy(F.col("cluster").alias("model")).agg(F.count("*").alias("size"))
    return metrics.stacked([cells, whole]).withColumn("cluster", F.coalesce("cluster", F.lit("all")))
