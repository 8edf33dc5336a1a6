"""Registered queries of the metric and bootstrap operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrace.operators import bootstrap, metrics
from lumentrace.plans.facts import DOC_OBS, OBS, doc_obs, obs, rounded

#: The operators' default.
REPLICATES = 100


def metrics_model_cluster(spark, sf_dir):
    return rounded(metrics.model_cluster_metrics(*obs(spark, sf_dir)))


def metrics_missing_scores(spark, sf_dir):
    return rounded(metrics.model_cluster_metrics(*doc_obs(spark, sf_dir)))


def metrics_cluster(spark, sf_dir):
    return rounded(metrics.cluster_metrics(*obs(spark, sf_dir)))


def metrics_model(spark, sf_dir):
    return rounded(metrics.model_metrics(*obs(spark, sf_dir)))


def metrics_salience(spark, sf_dir):
    return rounded(metrics.model_cluster_metrics(*obs(spark, sf_dir)).select("model", "cluster", F.col("proportion_delta").alias("salience")))


def metrics_dense_cross(spark, sf_dir):
    cells = metrics.model_cluster_metrics(*doc_obs(spark, sf_dir))
    return cells.select("model", "cluster", "size", (F.col("size") == 0).alias("is_empty"))


def metrics_subset(spark, sf_dir):
    facts, scores = obs(spark, sf_dir)
    included = facts.where(F.substring("cluster", -1, 1).isin("1", "2", "3")).select("property_id")
    return rounded(metrics.subset_metrics(facts, scores, included, metrics.conversations_by_model(facts)))


def metrics_totals_by_model(spark, sf_dir):
    return metrics.conversations_by_model(obs(spark, sf_dir)[0])


def metric_keys_inferred(spark, sf_dir):
    return metrics.inferred_metrics(metrics.long_scores(doc_obs(spark, sf_dir)[1]))


def metrics_examples(spark, sf_dir):
    facts, scores = obs(spark, sf_dir)
    cells = metrics.with_metadata(metrics.model_cluster_metrics(facts, scores), facts)
    return cells.select("model", "cluster", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


def bootstrap_draws(spark, sf_dir):
    facts, _ = obs(spark, sf_dir)
    return bootstrap.draws(spark, facts.select("conversation_id").distinct().count(), REPLICATES)


def bootstrap_model_cluster_ci(spark, sf_dir):
    return rounded(bootstrap.model_cluster_intervals(*obs(spark, sf_dir), REPLICATES))


def bootstrap_cluster_ci(spark, sf_dir):
    return rounded(bootstrap.cluster_intervals(*obs(spark, sf_dir), REPLICATES))


def bootstrap_model_ci(spark, sf_dir):
    return rounded(bootstrap.model_intervals(*obs(spark, sf_dir), REPLICATES))


def bootstrap_salience_ci(spark, sf_dir):
    return rounded(bootstrap.model_cluster_intervals(*obs(spark, sf_dir), REPLICATES).where("measure = 'proportion_delta'").drop("measure"))


def bootstrap_significance(spark, sf_dir):
    facts, scores = obs(spark, sf_dir)
    full = bootstrap.attached(metrics.model_cluster_metrics(facts, scores), bootstrap.model_cluster_intervals(facts, scores, REPLICATES), ["model", "cluster"])
    return full.select("model", "cluster", "proportion_delta_significant", "quality_delta_discount_significant", "quality_delta_quantity_significant")


def bootstrap_missing_scores(spark, sf_dir):
    return rounded(bootstrap.model_intervals(*doc_obs(spark, sf_dir), REPLICATES))


def _means(names, prefix):
    return ", ".join(f"avg({m}) AS {prefix}{m}" for m in names)


def _cells(facts: str, names: list[str]) -> str:
    return f"""WITH {facts},
    cells AS (SELECT model, cluster, count(*) AS size, {_means(names, 'quality_')} FROM triples GROUP BY 1, 2),
    models AS (SELECT model, count(*) AS model_size, {_means(names, 'model_')} FROM pairs GROUP BY 1),
    dense AS (SELECT model, cluster, coalesce(size, 0) AS size, coalesce(size, 0)::DOUBLE / model_size AS proportion, {', '.join(f'quality_{m}, quality_{m} - model_{m} AS quality_delta_{m}' for m in names)}
        FROM models CROSS JOIN (SELECT DISTINCT cluster FROM triples) LEFT JOIN cells USING (model, cluster)),
    full_cells AS (SELECT *, proportion - coalesce((sum(proportion) OVER w - proportion) / nullif(count(*) OVER w - 1, 0), 0) AS proportion_delta FROM dense WINDOW w AS (PARTITION BY cluster))
    """


def _round(*names):
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


TWO = ["discount", "quantity"]
_MEASURES = ["proportion", "proportion_delta", *[f"quality_{m}" for m in TWO], *[f"quality_delta_{m}" for m in TWO]]


def _draws() -> str:
    return f"""ids AS (SELECT conversation_id, row_number() OVER (ORDER BY conversation_id) - 1 AS conv_idx FROM (SELECT DISTINCT conversation_id FROM facts)),
    n AS (SELECT count(*) AS n FROM ids),
    trials AS (SELECT t // n AS rep, t % n AS d, n FROM n, range(n * {REPLICATES}) r(t)),
    draws AS (SELECT rep, ('0x' || substr(md5(rep::VARCHAR || '-' || d::VARCHAR), 1, 8))::BIGINT % n AS conv_idx, count(*) AS w FROM trials GROUP BY 1, 2),
    drawn AS (SELECT rep, conversation_id, w FROM draws JOIN ids USING (conv_idx))"""


def _wmean(m, alias):
    return f"sum(w * {m}) / nullif(sum(CASE WHEN {m} IS NOT NULL THEN w END), 0) AS {alias}"


def _replicates(facts: str, names: list[str]) -> str:
    quality = ", ".join(f"c.{m} AS quality_{m}, c.{m} - m.model_{m} AS quality_delta_{m}" for m in names)
    return f"""WITH {facts}, {_draws()},
    cells AS (SELECT rep, model, cluster, sum(w) AS size, {', '.join(_wmean(m, m) for m in names)} FROM triples JOIN drawn USING (conversation_id) GROUP BY 1, 2, 3),
    models AS (SELECT rep, model, sum(w) AS model_size, {', '.join(_wmean(m, f'model_{m}') for m in names)} FROM pairs JOIN drawn USING (conversation_id) GROUP BY 1, 2),
    whole AS (SELECT rep, sum(w) AS all_size, {', '.join(_wmean(m, f'all_{m}') for m in names)} FROM pairs JOIN drawn USING (conversation_id) GROUP BY 1),
    grid AS (SELECT rep, model, cluster FROM (SELECT DISTINCT model FROM pairs), (SELECT DISTINCT cluster FROM triples), range({REPLICATES}) r(rep)),
    dense AS (SELECT g.rep, g.model, g.cluster, coalesce(coalesce(c.size, 0) / nullif(m.model_size, 0)::DOUBLE, 0) AS proportion, {quality}
        FROM grid g LEFT JOIN cells c USING (rep, model, cluster) LEFT JOIN models m ON m.rep = g.rep AND m.model = g.model),
    reps AS (SELECT *, proportion - coalesce((sum(proportion) OVER w - proportion) / nullif(count(*) OVER w - 1, 0), 0) AS proportion_delta FROM dense WINDOW w AS (PARTITION BY rep, cluster)),
    model_reps AS (SELECT rep, model, {', '.join(f'model_{m} AS quality_{m}, model_{m} - all_{m} AS quality_delta_{m}' for m in names)} FROM models JOIN whole USING (rep))
    """


def _intervals(source: str, by: str, measures: list[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT {by}, '{m}' AS measure, {m} AS value FROM {source}" for m in measures)
    return f"""SELECT {by}, measure, round(quantile_cont(value, 0.025), 6) + 0.0 AS ci_lower, round(quantile_cont(value, 0.975), 6) + 0.0 AS ci_upper,
    round(avg(value), 6) + 0.0 AS ci_mean, count(*) AS n_valid FROM ({parts}) WHERE value IS NOT NULL GROUP BY {by}, measure"""


_CLUSTER_REPS = f"""WITH {OBS}, {_draws()},
    whole AS (SELECT rep, sum(w) AS all_size, {', '.join(_wmean(m, f'all_{m}') for m in TWO)} FROM pairs JOIN drawn USING (conversation_id) GROUP BY 1),
    cells AS (SELECT rep, cluster, sum(w) AS size, {', '.join(_wmean(m, m) for m in TWO)} FROM triples JOIN drawn USING (conversation_id) GROUP BY 1, 2),
    reps AS (SELECT rep, cluster, coalesce(size, 0) / all_size::DOUBLE AS proportion, {', '.join(f'{m} AS quality_{m}, {m} - all_{m} AS quality_delta_{m}' for m in TWO)}
        FROM (SELECT DISTINCT cluster FROM triples) CROSS JOIN whole LEFT JOIN cells USING (rep, cluster))
    """

QUERIES = {
    f.__name__: f
    for f in (
        metrics_model_cluster, metrics_missing_scores, metrics_cluster, metrics_model, metrics_salience, metrics_dense_cross, metrics_subset, metrics_totals_by_model, metric_keys_inferred,
        metrics_examples, bootstrap_draws, bootstrap_model_cluster_ci, bootstrap_cluster_ci, bootstrap_model_ci, bootstrap_salience_ci, bootstrap_significance, bootstrap_missing_scores,
    )
}

ORACLE_SQL = {
    "metrics_model_cluster": _cells(OBS, TWO) + f"SELECT model, cluster, size, {_round(*_MEASURES)} FROM full_cells",
    "metrics_missing_scores": _cells(DOC_OBS, ["quality", "toxic"])
    + f"SELECT model, cluster, size, {_round('proportion', 'proportion_delta', 'quality_quality', 'quality_toxic', 'quality_delta_quality', 'quality_delta_toxic')} FROM full_cells",
    "metrics_cluster": f"""WITH {OBS}, whole AS (SELECT count(*) AS all_size, {_means(TWO, 'all_')} FROM pairs),
        cells AS (SELECT cluster, count(*) AS size, count(DISTINCT conversation_id) AS total_unique_conversations, {_means(TWO, 'quality_')} FROM triples GROUP BY 1)
        SELECT cluster, size, round(size::DOUBLE / all_size, 6) + 0.0 AS proportion, total_unique_conversations, {_round('quality_discount', 'quality_quantity')},
        round(quality_discount - all_discount, 6) + 0.0 AS quality_delta_discount, round(quality_quantity - all_quantity, 6) + 0.0 AS quality_delta_quantity FROM cells, whole""",
    "metrics_model": f"""WITH {OBS}, whole AS (SELECT {_means(TWO, 'all_')} FROM pairs), cells AS (SELECT model, count(*) AS model_size, {_means(TWO, 'quality_')} FROM pairs GROUP BY 1),
        sizes AS (SELECT model, count(*) AS size FROM (SELECT DISTINCT conversation_id, model FROM triples) GROUP BY 1)
        SELECT model, size, round(size::DOUBLE / model_size, 6) + 0.0 AS proportion, {_round('quality_discount', 'quality_quantity')},
        round(quality_discount - all_discount, 6) + 0.0 AS quality_delta_discount, round(quality_quantity - all_quantity, 6) + 0.0 AS quality_delta_quantity FROM cells JOIN sizes USING (model), whole""",
    "metrics_salience": _cells(OBS, TWO) + "SELECT model, cluster, round(proportion_delta, 6) + 0.0 AS salience FROM full_cells",
    "metrics_dense_cross": _cells(DOC_OBS, ["quality", "toxic"]) + "SELECT model, cluster, size, size = 0 AS is_empty FROM full_cells",
    "metrics_subset": f"""WITH {OBS}, totals AS (SELECT model, count(DISTINCT conversation_id) AS total FROM facts GROUP BY 1),
        chosen AS (SELECT DISTINCT conversation_id, model, cluster FROM facts WHERE property_id IN (SELECT property_id FROM facts WHERE right(cluster, 1) IN ('1', '2', '3'))),
        cells AS (SELECT model, cluster, count(*) AS size, {_means(TWO, 'quality_')} FROM chosen LEFT JOIN scores USING (conversation_id, model) GROUP BY 1, 2)
        SELECT model, cluster, size, round(size::DOUBLE / total, 6) + 0.0 AS proportion,
        round(size::DOUBLE / total - (sum(size) OVER (PARTITION BY cluster))::DOUBLE / sum(size) OVER (), 6) + 0.0 AS proportion_delta, {_round('quality_discount', 'quality_quantity')}
        FROM cells JOIN totals USING (model)""",
    "metrics_totals_by_model": f"WITH {OBS} SELECT model, count(DISTINCT conversation_id) AS total FROM facts GROUP BY 1",
    "metric_keys_inferred": f"WITH {DOC_OBS} SELECT 'quality' AS metric, count(quality) AS n FROM pairs UNION ALL SELECT 'toxic', count(toxic) FROM pairs",
    "metrics_examples": f"""WITH {OBS}, few AS (SELECT model, cluster, conversation_id, row_number() OVER (PARTITION BY model, cluster ORDER BY conversation_id) AS rank FROM triples),
        shown AS (SELECT model, cluster, string_agg(conversation_id::VARCHAR, ',' ORDER BY conversation_id) AS examples FROM few WHERE rank <= 3 GROUP BY 1, 2)
        SELECT model, cluster, coalesce(examples, '') AS examples FROM (SELECT DISTINCT model FROM pairs) CROSS JOIN (SELECT DISTINCT cluster FROM triples) LEFT JOIN shown USING (model, cluster)""",
    "bootstrap_draws": f"WITH {OBS}, {_draws()} SELECT rep, conv_idx, w FROM draws",
    "bootstrap_model_cluster_ci": _replicates(OBS, TWO) + _intervals("reps", "model, cluster", _MEASURES),
    "bootstrap_cluster_ci": _CLUSTER_REPS + _intervals("reps", "cluster", [m for m in _MEASURES if m != "proportion_delta"]),
    "bootstrap_model_ci": _replicates(OBS, TWO) + _intervals("model_reps", "model", [m for m in _MEASURES if not m.startswith("proportion")]),
    "bootstrap_salience_ci": f"SELECT * EXCLUDE (measure) FROM ({_replicates(OBS, TWO) + _intervals('reps', 'model, cluster', ['proportion_delta'])})",
    "bootstrap_significance": _replicates(OBS, TWO)
    + f"""SELECT model, cluster, {', '.join(f"NOT (quantile_cont({m}, 0.025) <= 0 AND quantile_cont({m}, 0.975) >= 0) AS {m}_significant" for m in ('proportion_delta', 'quality_delta_discount', 'quality_delta_quantity'))}
        FROM reps GROUP BY 1, 2""",
    "bootstrap_missing_scores": _replicates(DOC_OBS, ["quality", "toxic"]) + _intervals("model_reps", "model", ["quality_quality", "quality_toxic", "quality_delta_quality", "quality_delta_toxic"]),
}
