"""The analysis pipeline: conversations to properties, clusters and metrics, as composable stages over DataFrames."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrace.functions import json_repair, text
from lumentrace.operators import bootstrap, clustering, filters, grouping, metrics, naming, ranking, reshape
from lumentrace.operators.providers import CallCache, Provider, embedded, hashing_embedder
from lumentrace.plans.expressions import custom_sql
from lumentrace.session import dealt, written
from lumentrace.sources import loaders

# Columns that each method needs.
REQUIRED = {"single_model": ["prompt", "model", "model_response"], "side_by_side": ["prompt", "model_a", "model_b", "model_a_response", "model_b_response"]}

PAIR_INSTRUCTIONS = "Compare the two answers. List the behaviours in which they differ as a JSON array of objects with model (Model A or Model B), behavior_type, property_description, category, evidence, reason, contains_errors and unexpected_behavior."
INSTRUCTIONS = "List the behaviours that stand out in this answer as a JSON array of objects with behavior_type, property_description, category, evidence, reason, contains_errors and unexpected_behavior."


@dataclass(frozen=True)
class Dataset:
    """What flows between stages; every part is lazy.

    conversations: question_id, model (and response columns); battles: question_id with both models and answers, where they
    were compared; scores: conversation_id, model, metrics...; properties: one row each; failures: answers without a
    property; members: property_id, cluster_id, cluster_label; tables: metric tables.
    """

    conversations: DataFrame
    battles: DataFrame | None = None
    scores: DataFrame | None = None
    answers: DataFrame | None = None
    properties: DataFrame | None = None
    failures: DataFrame | None = None
    members: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)


Stage = Callable[[Dataset], Dataset]
#: Parts of a dataset that stages hand on as rows.
PARTS = ("conversations", "battles", "scores", "answers", "properties", "failures", "members")


class Pipeline:
    """A list of stages, with the wall time of each kept."""

    def __init__(self, stages: list[tuple[str, Stage]]):
        self.stages, self.seconds = list(stages), {}

    def add(self, name: str, stage: Stage) -> Pipeline:
        self.stages.append((name, stage))
        return self

    def insert(self, at: int, name: str, stage: Stage) -> Pipeline:
        self.stages.insert(at, (name, stage))
        return self

    def remove(self, name: str) -> Pipeline:
        self.stages = [s for s in self.stages if s[0] != name]
        return self

    def __iter__(self) -> Iterator[tuple[str, Stage]]:
        return iter(self.stages)

    @contextlib.contextmanager
    def timed(self, name: str):
        began = time.time()
        yield
        self.seconds[name] = time.time() - began

    def run(self, data: Dataset, after: Callable[[str, Dataset], None] | None = None, progress: Callable[[str, float], None] | None = None) -> Dataset:
        """Each stage's rows are written to the shared folder and read back, so later stages never repeat its work.

        ``progress`` is told each stage's name and the part of the stages done before it, and at the end 'done' and 1; what
        it raises doesn't stop the run.
        """

        def tell(name: str, done: float) -> None:
            if progress:
                with contextlib.suppress(Exception):  # a listener's failure is its own
                    progress(name, done)

        for at, (name, stage) in enumerate(self.stages):
            tell(name, at / len(self.stages))
            with self.timed(name):
                made = stage(data)
                if not isinstance(made, Dataset):
                    raise TypeError(f"stage {name} gave no Dataset")
                fresh = {p: getattr(made, p) for p in PARTS if getattr(made, p) is not None and getattr(made, p) is not getattr(data, p)}
                data = replace(made, **{p: written(df, f"{name}-{p}") for p, df in fresh.items()})
            if after:
                after(name, data)
        tell("done", 1.0)
        return data


def prepare(df: DataFrame, method: str, mapping: dict[str, str] | None = None, score_columns: list[str] | None = None, sample_size: int | None = None) -> DataFrame:
    """Renamed, scored, sampled and checked input, with question_id filled in and row_idx in order of prompt.

    Side by side a metric ``m`` of ``score_columns`` is in two columns, ``m_a`` and ``m_b``.
    """
    if mapping:
        df = reshape.rename(df, mapping, [])
    if score_columns and method == "side_by_side":
        filters.require_columns(df, [f"{c}_{s}" for c in score_columns for s in "ab"])
        for s in "ab":
            df = reshape.scores_to_map(df, [f"{c}_{s}" for c in score_columns], f"_{s}", f"score_{s}")
    elif score_columns:
        df = reshape.scores_to_map(df, score_columns)
    if method == "single_model" and "model" not in df.columns:
        df = df.withColumn("model", F.lit("model"))
    filters.require_columns(df, REQUIRED[method])
    first = "question_id" if "question_id" in df.columns else "prompt"
    df = loaders.indexed(df, first, *[c for c in ("model", "model_a", "model_b") if c in df.columns])
    if "question_id" not in df.columns:
        df = df.withColumn("question_id", F.col("row_idx").cast("string"))
    return ranking.sample_rows(df, sample_size, "row_idx") if sample_size else df


def dataset(df: DataFrame, method: str) -> Dataset:
    """Conversations with one row for each (question, model), and their scores by metric."""
    battles = None
    if method == "side_by_side":
        battles = df.select("question_id", "prompt", "row_idx", "model_a", "model_b", *[F.col(c).cast("string").alias(c) for c in ("model_a_response", "model_b_response")])
        if "winner" in df.columns and "score_a" not in df.columns:
            a, b = reshape.winner_scores()
            df = df.withColumns({"score_a": F.create_map(F.lit("winner"), a), "score_b": F.create_map(F.lit("winner"), b)})
        values = ["response", *(["score"] if "score_a" in df.columns else [])]
        sides = df.withColumnsRenamed({"model_a_response": "response_a", "model_b_response": "response_b"})
        df = reshape.side_to_tidy(sides, ["question_id", "prompt", "row_idx"], values).withColumnRenamed("response", "model_response")
    kept = [c for c in ("question_id", "prompt", "model", "model_response", "row_idx") if c in df.columns]
    scores = None
    if "score" in df.columns and dict(df.dtypes)["score"].startswith("map"):
        long = df.select(F.col("question_id").alias("conversation_id"), "model", F.explode("score").alias("metric", "value")).where("value is not null")
        names = sorted(r[0] for r in long.select("metric").distinct().collect()) or ["score"]
        means = [F.avg(F.col("score")[n].cast("double")).alias(n) for n in names]
        rows = df.select(F.col("question_id").alias("conversation_id"), "model", "score")
        # the columns' names may hold any sign, dots too
        scores = dealt(rows, "conversation_id", "model").groupBy("conversation_id", "model").agg(*means).where(F.coalesce(*[F.col("`" + n.replace("`", "``") + "`") for n in names]).isNotNull())
    return Dataset(df.select(*kept), battles, scores)


def wide(data: Dataset) -> DataFrame:
    """One row for each property of each conversation, with the conversation's scores and the property's cluster; all conversations stay."""
    out = data.conversations
    if data.scores is not None:
        out = out.join(data.scores.withColumnRenamed("conversation_id", "question_id"), ["question_id", "model"], "left")
    rows = data.members if data.members is not None else data.properties
    if rows is not None:
        taken = set(out.columns) - {"question_id", "model"}
        out = out.join(rows.select(*[c for c in rows.columns if c not in taken]), ["question_id", "model"], "left")
    return out


def extraction(provider: Provider, cache: CallCache, instructions: str = INSTRUCTIONS, pair_instructions: str = PAIR_INSTRUCTIONS) -> Stage:
    """One model call for each conversation, or for each battle, which shows both answers and neither model's name."""

    def stage(data: Dataset) -> Dataset:
        if data.battles is not None:
            asked = text.sections(pair_instructions, prompt=F.col("prompt"), model_a_answer=F.col("model_a_response"), model_b_answer=F.col("model_b_response"))
            answers = cache.complete(data.battles.withColumn("request", asked), "request", provider, "raw_response")
            return replace(data, answers=answers.drop("request", "model_a_response", "model_b_response"))
        prompt = text.sections(instructions, prompt=F.col("prompt"), answer=F.col("model_response").cast("string"))
        answers = cache.complete(data.conversations.withColumn("request", prompt), "request", provider, "raw_response").drop("request")
        return replace(data, answers=answers)

    return stage


def longest_failure_run(rows: DataFrame) -> int:
    """Most answers in a row, in order of row_idx, that gave nothing but errors.

    In a run the places among all answers and among the failed ones grow together, so their difference marks the run; both
    are numbered by ranges, without a task that sees all answers.
    """
    answers = rows.groupBy(F.col("row_idx").alias("at")).agg(F.min(F.col("error_type").isNotNull()).alias("failed"))
    failed = loaders.indexed(answers, "at").where("failed").select(F.col("row_idx").alias("place"))
    runs = loaders.indexed(failed, "place").groupBy(F.col("place") - F.col("row_idx")).count()
    return runs.agg(F.max("count")).first()[0] or 0


def parsing(most_failures_in_a_row: int = 10) -> Stage:
    """Answers to properties and failures; RuntimeError where more answers than allowed fail in a row.

    A property of a battle belongs to the model that it means; one that means neither is a failure.
    """

    def stage(data: Dataset) -> Dataset:
        if data.battles is not None:
            rows = json_repair.parsed_rows(data.answers)
            meant = text.model_of(F.col("model"), F.col("model_a"), F.col("model_b"))
            lost = F.col("error_type").isNull() & (F.coalesce(meant, F.lit("unknown")) == "unknown")
            rows = rows.withColumns({"model": meant, "error_type": F.when(lost, json_repair.UNKNOWN_MODEL_MAPPING).otherwise(F.col("error_type"))})
        else:
            rows = json_repair.parsed_rows(data.answers.withColumnRenamed("model", "answer_model"))
            rows = rows.withColumn("model", F.coalesce("answer_model", "model")).drop("answer_model")
        rows = written(rows, "parsed")
        rows = rows.withColumn("property_id", F.sha2(F.concat_ws("|", "question_id", "model", F.col("pos").cast("string"), "property_description"), 256))
        failures = rows.where("error_type is not null")
        longest = longest_failure_run(rows)
        if longest > most_failures_in_a_row:
            raise RuntimeError(f"{longest} answers in a row could not be parsed")
        return replace(data, properties=rows.where("error_type is null").drop("error_type"), failures=failures)

    return stage


def validation(data: Dataset) -> Dataset:
    good, bad = filters.split_valid(data.properties)
    return replace(data, properties=good, failures=loaders.union([data.failures, bad.withColumn("error_type", F.lit("INVALID_PROPERTY"))]) if data.failures is not None else bad)


def hierarchical_clustering(provider: Provider, cache: CallCache, min_cluster_size: int = 5, groupby: str | None = "behavior_type", embed=None, coarse: int | None = None, pretty: bool = False) -> Stage:
    """Density clusters with names from a provider and outliers given another chance; with ``coarse`` under at most so many broader names.

    Names that several clusters share make one cluster. A provider that fails leaves 'Unlabeled' names and fine ones as they are.
    """
    density = density_clustering(min_cluster_size, groupby, embed)

    def stage(data: Dataset) -> Dataset:
        members = written(density(data).members, "members")
        names = written(naming.named(members.where("cluster_id <> -1"), provider, cache), "names")
        if pretty:
            names = written(naming.prettified(names, provider, cache), "names")
        named = members.drop("cluster_label").join(names.withColumnRenamed("label", "cluster_label"), "cluster_id", "left")
        named = named.withColumn("cluster_label", F.coalesce("cluster_label", F.lit("Outliers")))
        out = written(naming.regrouped_outliers(named, min_cluster_size, provider, cache).select(*members.columns), "regrouped")
        if coarse:
            out = naming.under_coarse(out, coarse, provider, cache)
        ids = F.when(text.is_outlier(F.col("cluster_label")), -1).otherwise(F.xxhash64("cluster_label").bitwiseAND(F.lit((1 << 62) - 1)))
        return replace(data, members=out.withColumn("cluster_id", ids.cast("long")))

    return stage


def density_clustering(min_cluster_size: int = 5, groupby: str | None = "behavior_type", embed=None) -> Stage:
    """Clusters of descriptions within each stratum, named by their first description; small ones are outliers."""

    def stage(data: Dataset) -> Dataset:
        stratum = F.coalesce(F.col(groupby).cast("string"), F.lit("none")) if groupby else F.lit("all")
        rows = data.properties.where(~filters.blank("property_description")).select("property_id", "question_id", "model", F.col("property_description").alias("value"), stratum.alias("stratum"))
        vectors = embedded(rows.select("stratum", "value").distinct(), "value", embed or hashing_embedder())
        labels = clustering.cluster_strata(vectors, min_cluster_size)
        names = labels.where("cluster >= 0").groupBy("stratum", "cluster").agg(F.min("value").alias("cluster_label"))
        out = rows.join(labels, ["stratum", "value"]).join(names, ["stratum", "cluster"], "left")
        out = ranking.small_to_outliers(out, "cluster_label", min_cluster_size, "stratum" if groupby else None)
        ids = out.select("cluster_label").distinct().withColumn("cluster_id", F.when(text.is_outlier(F.col("cluster_label")), -1).otherwise(F.xxhash64("cluster_label").bitwiseAND(F.lit((1 << 62) - 1))))
        return replace(data, members=out.join(ids, "cluster_label").select("property_id", "question_id", "model", F.col("value").alias("property_description"), "cluster_id", "cluster_label"))

    return stage


def taxonomy_clustering(labels: list[str]) -> Stage:
    """The taxonomy's label for each property, Other where it has none of them."""

    def stage(data: Dataset) -> Dataset:
        spark = data.properties.sparkSession
        taxonomy = spark.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, id long")
        return replace(data, members=clustering.taxonomy_assigned(data.properties, taxonomy).select("property_id", "question_id", "model", "property_description", "cluster_id", "cluster_label"))

    return stage


def metric_tables(replicates: int = 0) -> Stage:
    """The three metric tables, with intervals if replicates are asked for."""

    def stage(data: Dataset) -> Dataset:
        facts = data.members.select(F.col("question_id").alias("conversation_id"), "model", F.col("cluster_label").alias("cluster"), "property_id")
        scores = data.scores if data.scores is not None else facts.select("conversation_id", "model").distinct()
        tables = {"model_cluster_scores": metrics.model_cluster_metrics(facts, scores), "cluster_scores": metrics.cluster_metrics(facts, scores), "model_scores": metrics.model_metrics(facts, scores)}
        if replicates:
            lists = bootstrap.drawn(facts, replicates)
            tables["model_cluster_scores"] = bootstrap.attached(tables["model_cluster_scores"], bootstrap.model_cluster_intervals(facts, scores, replicates, lists), ["model", "cluster"])
            tables["cluster_scores"] = bootstrap.attached(tables["cluster_scores"], bootstrap.cluster_intervals(facts, scores, replicates, lists), ["cluster"])
            tables["model_scores"] = bootstrap.attached(tables["model_scores"], bootstrap.model_intervals(facts, scores, replicates, lists), ["model"])
        return replace(data, tables=tables)

    return stage


def identity(data: Dataset) -> Dataset:
    return data


def default_pipeline(provider: Provider, cache: CallCache, min_cluster_size: int = 5, replicates: int = 0) -> Pipeline:
    return Pipeline([("extract", extraction(provider, cache)), ("parse", parsing()), ("validate", validation), ("cluster", density_clustering(min_cluster_size)), ("metrics", metric_tables(replicates))])


def label_pipeline(provider: Provider, cache: CallCache, taxonomy: list[str], replicates: int = 0) -> Pipeline:
    asked = f"Choose one of these labels: {', '.join(taxonomy)}. Answer with a JSON object with category, property_description, evidence and reason."
    return Pipeline([("extract", extraction(provider, cache, asked)), ("parse", parsing()), ("cluster", taxonomy_clustering(taxonomy)), ("metrics", metric_tables(replicates))])


def explain(df: DataFrame, provider: Provider, cache: CallCache, method: str | None = None, pipeline: Pipeline | None = None, replicates: int = 0, min_cluster_size: int = 5, **prepared) -> Dataset:
    """The whole analysis of a table of answers or battles; a pipeline of one's own takes the place of the default."""
    method = method or loaders.detect_method(df)
    if method is None:
        raise ValueError("the columns fit neither single_model nor side_by_side")
    return (pipeline or default_pipeline(provider, cache, min_cluster_size, replicates)).run(dataset(prepare(df, method, **prepared), method))


def extract_properties(df: DataFrame, provider: Provider, cache: CallCache, method: str | None = None, **prepared) -> Dataset:
    return explain(df, provider, cache, method, Pipeline([("extract", extraction(provider, cache)), ("parse", parsing()), ("validate", validation)]), **prepared)


def label(df: DataFrame, provider: Provider, cache: CallCache, taxonomy: list[str], replicates: int = 0, **prepared) -> Dataset:
    return explain(df, provider, cache, "single_model", label_pipeline(provider, cache, taxonomy, replicates), **prepared)


def cluster_job(properties: DataFrame, scores: DataFrame | None = None, clusterer: Stage | None = None, replicates: int = 0, progress: Callable[[str, float], None] | None = None) -> Dataset:
    """Clusters and metrics of given properties (property_id, question_id, model, property_description, behavior_type).

    Invalid properties become failures; the default clusterer is ``density_clustering``.
    """
    failures = properties.limit(0).withColumn("error_type", F.lit(None).cast("string"))
    data = Dataset(properties.select("question_id", "model").distinct(), scores=scores, properties=properties, failures=failures)
    return Pipeline([("validate", validation), ("cluster", clusterer or density_clustering()), ("metrics", metric_tables(replicates))]).run(data, progress=progress)


#: Clusterers and metrics by name; a clusterer takes keyword arguments and gives a stage that sets ``members``, a metric one that sets ``tables``.
CLUSTERERS: dict[str, Callable[..., Stage]] = {"density": density_clustering, "hdbscan": density_clustering, "hierarchical": hierarchical_clustering, "taxonomy": taxonomy_clustering, "dummy": lambda: identity}
METRICS: dict[str, Callable[..., Stage]] = {"single_model": metric_tables, "side_by_side": metric_tables}


def chosen(kind: dict[str, Callable[..., Stage]], name: str, **given) -> Stage:
    """The stage that a registry has under a name; ValueError tells the names that there are."""
    if name not in kind:
        raise ValueError(f"{name!r} is none of {', '.join(sorted(kind))}")
    return kind[name](**given)


def metrics_only(members: DataFrame, scores: DataFrame | None = None, replicates: int = 0) -> dict[str, DataFrame]:
    """Metric tables of saved cluster members."""
    return metric_tables(replicates)(Dataset(members, scores=scores, members=members)).tables


def snapshot(path: str) -> Callable[[str, Dataset], None]:
    """An ``after`` hook that writes what each stage made."""

    def write(name: str, data: Dataset) -> None:
        for part in ("properties", "failures", "members"):
            if (df := getattr(data, part)) is not None:
                loaders.save(df, f"{path}/{name}/{part}.parquet")
        if data.tables:
            loaders.save_metrics(data.tables, f"{path}/{name}")

    return write


def parse_summary(data: Dataset) -> DataFrame:
    """Failures by type."""
    return grouping.counts(data.failures, "error_type")
