"""From raw documents to packed training sequences: the corpus pipeline over the operators of ``lumentrace.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns of
``documents``. ``run`` writes every stage's output to the shared folder and reads it back. Further columns of ``docs``, whatever
their names and types, stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumentrace.llm import exact_dedup, minhash_dedup, packing, quality, substring_dedup
from lumentrace.llm.common import NULL_ID, discard, text_hash, written
from lumentrace.llm.queries import table, vocabulary


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of a column, whatever the case of letters."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def _same(docs: DataFrame) -> list[Column]:
    """The columns as they are, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` but for the rows with the ids of ``dropped``."""
    return docs.join(dropped.select("doc_id").distinct(), "doc_id", "left_anti")


def _by_row(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with ids that no two rows share, and a function that puts the own ids back.

    Where ids repeat or are null the rows are written once in order of doc_id under row numbers.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs, lambda rows: rows
    (own,) = _fresh(docs, "own_id")
    rest = [c for c, f in zip(_same(docs), docs.schema.fields, strict=True) if f.name not in ("doc_id", "text") and not isinstance(f.dataType, T.MapType | T.VariantType)]
    rows = docs.withColumn(own, F.col("doc_id")).repartitionByRange("doc_id", text_hash()).sortWithinPartitions("doc_id", text_hash(), *rest).withColumn("doc_id", F.monotonically_increasing_id())
    return written(rows, "rows"), lambda rows: rows.withColumn("doc_id", F.col(own)).drop(own)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it is fitted on the labelled ones among ``docs``.

    Rows are judged each by its own text, null as an empty one; null and repeated ids are kept with their rows.
    """
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest doc_id; a null id is smaller than all others.

    Of rows that share an id each stands for itself, and one of those with equal texts stays. Null texts are equal to empty
    ones, so one of all of them stays.
    """
    docs, own = _by_row(docs)
    return own(_without(docs, exact_dedup.deduplicate(docs).where("not kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles, the one with the smallest id.

    Null and repeated ids count as in ``drop_copies``. Texts without words are linked with nothing and stay.
    """
    docs, own = _by_row(docs)
    return own(_without(docs, minhash_dedup.grouped(docs, k=5, percent=80).where("not kept")))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that occur earlier; what loses nothing keeps its text as it is.

    Every row stays, with an empty text where all words go; a null text stays null. Rows that repeat an id with one text
    don't cut each other.
    """
    own, hashed, kept = _fresh(docs, "own_id", "own_hash", "own_kept")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias(own)
    cut = substring_dedup.remove_repeats(docs, rejoin=False, once=True).where("n_removed > 0").select(key, F.col("text_hash").alias(hashed), F.col("kept").alias(kept))
    out = docs.select("*", key, text_hash().alias(hashed)).join(cut, [own, hashed], "left")
    text = F.coalesce(kept, "text")
    size = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)
    return out.withColumns({"text": text, "n_chars": size}).select(*_same(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their ids; every row is packed, null text as an empty one."""
    return packing.packed(docs, vocabulary("word_bpe_49k.json"), length=2048, end_id=1)


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("packing", pack)]

#: SQL can't express the classifier, the tokenizer and the packing; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
