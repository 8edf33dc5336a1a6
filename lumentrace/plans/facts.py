"""Stand-in fact sets over the shared tables, as DataFrames and as the SQL that states them a second time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.session import dealt, table


def obs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as conversations, return flags as models, brands as clusters; mean quantity and discount as scores."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_quantity", "l_discount")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    facts = items.join(parts, items.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("conversation_id"),
        F.col("l_returnflag").alias("model"),
        F.col("p_brand").alias("cluster"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("property_id"),
    )
    scores = dealt(items, "l_orderkey", "l_returnflag").groupBy(F.col("l_orderkey").alias("conversation_id"), F.col("l_returnflag").alias("model")).agg(
        F.avg(F.col("l_discount").cast("double")).alias("discount"), F.avg(F.col("l_quantity").cast("double")).alias("quantity")
    )
    return facts, scores


OBS = """facts AS (SELECT l_orderkey AS conversation_id, l_returnflag AS model, p_brand AS cluster, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS property_id
    FROM lineitem JOIN part ON l_partkey = p_partkey),
scores AS (SELECT l_orderkey AS conversation_id, l_returnflag AS model, avg(l_discount::DOUBLE) AS discount, avg(l_quantity::DOUBLE) AS quantity FROM lineitem GROUP BY 1, 2),
triples AS (SELECT DISTINCT f.conversation_id, f.model, f.cluster, discount, quantity FROM facts f LEFT JOIN scores USING (conversation_id, model)),
pairs AS (SELECT DISTINCT conversation_id, model, discount, quantity FROM triples)"""


def doc_obs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as conversations, sources as models, languages as clusters; labels, which many lack, as scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    facts = docs.select(F.col("doc_id").alias("conversation_id"), F.col("source").alias("model"), F.col("lang").alias("cluster"), F.col("doc_id").cast("string").alias("property_id"))
    scores = docs.join(labels, "doc_id").select(F.col("doc_id").alias("conversation_id"), F.col("source").alias("model"), F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return facts, scores


DOC_OBS = """facts AS (SELECT doc_id AS conversation_id, source AS model, lang AS cluster FROM documents),
triples AS (SELECT DISTINCT doc_id AS conversation_id, source AS model, lang AS cluster, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM documents LEFT JOIN labels USING (doc_id)),
pairs AS (SELECT DISTINCT conversation_id, model, quality, toxic FROM triples)"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; negative zero becomes zero."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
