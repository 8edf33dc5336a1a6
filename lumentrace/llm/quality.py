"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: one to three bytes, one and two words, and runs of two and three equal words, whichever
word it is. Each indicator is scaled by the log-count ratio of the two classes, the vector is brought to
unit length, and a linear hinge-loss model is fitted by dual coordinate descent. A fifth of the sample is left out of that
and turns margins into probabilities.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrace.llm.common import byte_values, in_batches, joined, mix, with_ids, with_text, word_hashes, words
from lumentrace.llm.labelled import fitted, fold, logistic, odds_shift, sample

BITS = 18
#: Most labelled rows of label 0 and of label 1 that the model is fitted on.
TRAIN_ROWS = (4000, 6000)
COST, EPOCHS = 2.0, 10
KEEP = 0.3


def features(text: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted ids, below 2**BITS, of the n-grams that occur in it."""
    data, starts = joined(text)
    shift = np.uint64(64 - BITS)
    tables = [mix(byte_values(0) + np.uint64(n)) for n in (1, 2, 3)]
    sums, grams = np.zeros(len(data), dtype=np.uint64), []
    for n in range(3):
        sums = sums[: len(data) - n] + tables[n][data[n:]]
        grams.append((mix(sums + np.uint64(n)) >> shift).astype(np.int64))
    begin, end, first = words(data, starts)
    hashes = word_hashes(data, begin, end)
    terms = (hashes >> shift).astype(np.int64)
    pairs = (mix(hashes[:-1] * np.uint64(3) + hashes[1:]) >> shift).astype(np.int64)
    same = np.zeros(len(terms), dtype=bool)
    same[1:] = terms[1:] == terms[:-1]
    twice = same.copy()
    twice[1:] &= same[:-1]
    flags = np.zeros(1 << BITS, dtype=bool)
    for d in range(len(starts) - 1):
        a, b, f, g = starts[d], starts[d + 1] - 1, first[d], first[d + 1]
        for n in range(3):
            flags[grams[n][a : max(a, b - n)]] = True
        flags[terms[f:g]] = True
        flags[pairs[f : max(f, g - 1)]] = True
        if g - f > 1 and same[f + 1 : g].any():
            flags[1] = True
            if g - f > 2 and twice[f + 2 : g].any():
                flags[2] = True
        # a short text's ids are few: sort them instead of looking through all flags
        if b - a < 1 << (BITS - 7):
            used = np.concatenate([*(grams[n][a : max(a, b - n)] for n in range(3)), terms[f:g], pairs[f : max(f, g - 1)], [1, 2]])
            ids = np.unique(used[flags[used]])
        else:
            ids = np.flatnonzero(flags)
        flags[ids] = False
        yield ids


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float, epochs: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and constant of the hinge-loss model: one dual variable a row, each set to its best value in turn."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(1 << BITS), 0.0
    dual = np.zeros(len(rows))
    norm = np.array([v @ v + 1 for v in values])
    sign = np.where(y > 0, 1.0, -1.0)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            x, v, s = rows[k], values[k], sign[k]
            best = min(max(dual[k] - (s * (w[x] @ v + b) - 1) / norm[k], 0.0), cost)
            if (step := (best - dual[k]) * s) != 0:
                w[x] += step * v
                b += step
                dual[k] = best
    return w, b


def fit(ids: list[int], texts: list[str], y: np.ndarray, shift: float = 0.0) -> bytes:
    """A pickled model: weight times ratio and squared ratio of each feature, the constant, and the calibration.

    ``shift`` is added to the calibrated log odds; it makes up for a sample with other odds than all labels.
    """
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if not n0 or not n1:
        share = (n1 + 1) / (n0 + n1 + 2)
        zero = np.zeros(1 << BITS, dtype=np.float32)
        return pickle.dumps((zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))) + shift))
    rows = [x for at in range(0, len(texts), 200) for x in features(pa.array(texts[at : at + 200]))]
    count = np.zeros((2, 1 << BITS))
    for x, label in zip(rows, y, strict=True):
        count[label, x] += 1
    ratio = np.log((count[1] + 1) / (n1 + 2)) - np.log((count[0] + 1) / (n0 + 2))
    values = [ratio[x] / max(1e-9, float(np.sqrt((ratio[x] ** 2).sum()))) for x in rows]
    aside = np.arange(len(rows)) % 5 == 4
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside[:] = False
    used = np.flatnonzero(~aside)
    w, b = dual_descent([rows[i] for i in used], [values[i] for i in used], y[used], COST, EPOCHS)
    tuned = np.flatnonzero(aside) if aside.any() else used
    margin = np.array([w[rows[i]] @ values[i] + b for i in tuned])
    slope, base = logistic(margin[:, None], y[tuned])
    return pickle.dumps(((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), b, float(slope), float(base) + shift))


def model(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: tuple[int, int] = TRAIN_ROWS) -> bytes:
    """Fit on at most ``rows`` labelled documents of each class outside the held-out fold (crc32 of the id mod 5 is 0).

    Scores are at the odds of all these labels, whatever the sample's.
    """
    train = fold(5) != 0
    return fitted(sample(docs, labels, label, rows, train), partial(fit, shift=odds_shift(labels, label, rows, train)))


def _scorer(docs: DataFrame, fitted_model: bytes) -> Callable[[pa.Array], np.ndarray]:
    """A function of text columns for use inside tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted_model)
    loaded: list = []

    def score(text: pa.Array) -> np.ndarray:
        if not loaded:
            loaded.append(pickle.loads(shared.value))
        weight, square, b, slope, base = loaded[0]
        margin = np.array([weight[x].sum() / max(1e-9, float(square[x].sum()) ** 0.5) + b if len(x) else b for x in features(text)], dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(slope * margin + base, -30, 30)))

    return score


def scored(docs: DataFrame, fitted_model: bytes) -> DataFrame:
    """(doc_id, score): probability of label 1 of each whole text.

    Null or empty text has no features and gets the score of the constant; every row gives a row; a null doc_id stays null;
    other columns are not read.
    """
    score = _scorer(docs, fitted_model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch.column("text")))], names=["doc_id", "score"])

    return with_ids(with_text(docs).mapInArrow(in_batches(step), "doc_id long, score double"))


def classified(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; predicted is 1 where the score reaches ``keep``.

    Without labels of both classes every score is their smoothed share. Labels that are null, have no doc_id or belong to no
    document are not used; of several labels of an id the largest counts. Rows that repeat a doc_id are scored each by its
    own text. A null doc_id gives a null held_out. An empty ``documents`` gives an empty result.
    """
    out = scored(docs, model(docs, labels))
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= keep).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches ``keep``; nothing is shuffled.

    Rows are kept or not each by its own text, null as an empty one; ids play no part, so null and repeated ones are fine.
    """
    score = _scorer(docs, model(docs, labels))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(score(batch.column("text")) >= keep))

    return docs.mapInArrow(in_batches(step), docs.schema)
