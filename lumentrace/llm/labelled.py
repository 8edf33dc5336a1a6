"""Bounded samples of labelled documents and models fitted on them inside one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrace.llm.common import with_text


def fold(parts: int) -> Column:
    """crc32 of doc_id as text, modulo ``parts``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def _labelled(labels: DataFrame, label: str, train: Column) -> DataFrame:
    """(doc_id, y) of the labelled ids for which ``train`` holds; null labels and ids are not used."""
    return labels.where(train).where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: tuple[int, int], train: Column) -> DataFrame:
    """(doc_id, text, y): at most rows[0] documents of label 0 and rows[1] of label 1, the first by a hash of doc_id.

    Only ``labels`` rows for which ``train`` holds are used; null labels and ids are not. The ids are few by these
    bounds, so they are broadcast and the documents are not shuffled. Labels without a document count against the bounds,
    and an id that several documents have brings all of them.
    """
    one = _labelled(labels, label, train)
    order = F.xxhash64("doc_id", F.lit(17))
    some = [one.where(F.col("y") == y).orderBy(order, "doc_id").limit(n) for y, n in enumerate(rows)]
    return with_text(docs).join(F.broadcast(some[0].unionByName(some[1])), "doc_id")


def odds_shift(labels: DataFrame, label: str, rows: tuple[int, int], train: Column) -> float:
    """Log odds of label 1 among all labels that ``sample`` draws from, less those in the sample; 0 where no bound binds."""
    counted = {r.y: r["count"] for r in _labelled(labels, label, train).groupBy("y").count().collect()}
    whole = [counted.get(y, 0) for y in (0, 1)]
    drawn = [min(n, most) for n, most in zip(whole, rows, strict=True)]
    return float(np.log((whole[1] + 1) / (whole[0] + 1)) - np.log((drawn[1] + 1) / (drawn[0] + 1)))


def fitted(rows: DataFrame, fit: Callable[[list[int], list[str], np.ndarray], bytes]) -> bytes:
    """The model that ``fit(ids, texts, y)`` makes of a bounded sample, computed in one task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [p for p in parts if len(p)]
        all_rows = pd.concat(found).sort_values("doc_id") if found else pd.DataFrame({"doc_id": [], "text": [], "y": []})
        texts = [t or "" for t in all_rows["text"]]
        yield pd.DataFrame({"model": [fit(all_rows["doc_id"].tolist(), texts, all_rows["y"].to_numpy(dtype=np.int64))]})

    made = rows.repartition(1).mapInPandas(run, "model binary").first()
    return bytes(made[0]) if made else fit([], [], np.zeros(0, dtype=np.int64))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w
