"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, and one that adds to it the segments by which toxic text
differs. Each word of a text is a window. Its compressed lengths under the two dictionaries are compared; how far a window
of that length gains under the toxic one tells, by frequencies in a calibration half of the sample, how much more often
such windows occur in toxic text. A document's evidence is the sum and the largest of these log ratios, and a logistic curve
turns them into a probability.

The segments are found greedily: the byte string with the widest support in toxic documents among those that are rare in
ordinary ones is extended while its neighbours agree, the windows that it explains are set aside, and so on. Words are too
short for zstandard to find matches near a window's end, so a constant tail follows each.
"""

from __future__ import annotations

import pickle
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrace.llm.common import Recent, in_batches, with_ids, with_text
from lumentrace.llm.labelled import fitted, fold, logistic, odds_shift, sample

#: Most labelled rows of label 0 and of label 1 that the model is fitted on.
TRAIN_ROWS = (4000, 2000)
GRAMS = (5, 8, 11)
#: Least log ratio of document frequencies, and least share of toxic documents, of a segment.
CONTRAST, SUPPORT = 3.0, 1 / 40
#: Bytes of the ordinary dictionary; the segments of the toxic one all follow it, as many as the bounded sample gives.
DICTIONARY = 16384
TAIL = bytes(64)
LENGTHS, GAINS = 32, 32
TOXIC = 0.7
CACHE = 300_000


def windows(text: str) -> list[bytes]:
    """Lower-cased words, each with the space before and after it."""
    return [b" " + w + b" " for w in text.encode().lower().split()]


def grams(window: bytes) -> set[bytes]:
    return {window[i : i + n] for n in GRAMS for i in range(len(window) - n + 1)} | {window}


def segments(toxic: list[set[bytes]], ordinary: list[set[bytes]]) -> list[bytes]:
    """Byte strings that many toxic documents hold and few ordinary ones, widest support first, then whole windows with them."""
    seen, other = Counter(), Counter()
    for doc in toxic:
        seen.update({g for w in doc for g in grams(w)})
    least = max(3, int(len(toxic) * SUPPORT))
    seen = Counter({g: n for g, n in seen.items() if n >= least})
    for doc in ordinary:
        other.update({g for w in doc for g in grams(w)} & seen.keys())
    floor = np.log(len(toxic) + 1) - np.log(len(ordinary) + 1)
    good = {g for g, n in seen.items() if np.log((n + 0.5) / (other[g] + 0.5)) - floor > CONTRAST}
    live = [(w, found) for doc in toxic for w in doc if (found := grams(w) & good)]
    out, whole = [], []
    while live:
        gram, support = min(Counter(g for _, found in live for g in found).items(), key=lambda x: (-x[1], x[0]))
        if support < least:
            break
        hits = [w for w, found in live if gram in found]
        live = [x for x in live if gram not in x[1]]
        segment = gram
        while True:
            near = Counter()
            for w in hits:
                at = w.find(segment)
                if at >= 0:
                    near.update([w[at : at + len(segment) + 1], w[max(0, at - 1) : at + len(segment)]])
            near.pop(segment, None)
            if not near:
                break
            longer, n = min(near.items(), key=lambda x: (-x[1], x[0]))
            if n < 0.8 * len(hits):
                break
            segment = longer
        out.append(segment)
        whole += [(w, n) for w, n in Counter(hits).items() if n >= max(3, least // 4) and w != segment]
    return out + [w for w, _ in sorted(whole, key=lambda x: (-x[1], x[0]))]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """A compressor that reaches all of its dictionary, however long."""
    parameters = zstandard.ZstdCompressionParameters(
        window_log=max(15, (len(content) + 1024).bit_length()), hash_log=16, chain_log=16, search_log=8, min_match=4, target_length=64, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


class Cells:
    """The cell of a window: its length and by how many bytes the toxic dictionary makes it shorter."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.a, self.b = compressor(ordinary).compress, compressor(ordinary + toxic).compress

    def __call__(self, window: bytes) -> int:
        padded = window + TAIL
        gain = len(self.a(padded)) - len(self.b(padded)) + 2
        return min(len(window), LENGTHS - 1) * GAINS + min(max(gain, 0), GAINS - 1)


def evidence(ratios: np.ndarray) -> tuple[float, float]:
    """Of a document's windows: the log of one plus the sum of the large log ratios, and the largest."""
    large = ratios[ratios > 1]
    return float(np.log1p(large.sum())), float(ratios.max()) if len(ratios) else 0.0


def _ordinary_content(docs: list[list[bytes]]) -> bytes:
    samples = [b"".join(d[i : i + 40]) for d in docs for i in range(0, len(d), 40)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=16, d=6, level=3).as_bytes()[-(DICTIONARY - 900) :]
    except zstandard.ZstdError:  # too few or too small samples to train on
        return b"".join(samples)[-DICTIONARY:] or b" the "


def fit(ids: list[int], texts: list[str], y: np.ndarray, shift: float = 0.0) -> bytes:
    """A pickled model: the two dictionaries, the log ratio of each cell, and the logistic weights.

    ``shift`` is added to the calibrated log odds; it makes up for a sample with other odds than all labels.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    plain = (b" the ordinary", b" the ordinary", np.zeros(LENGTHS * GAINS), np.array([0.0, 0.0, np.log(share / (1 - share)) + shift]))
    docs = [windows(t) for t in texts]
    toxic, ordinary = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if len(toxic) < 4 or len(ordinary) < 4:
        return pickle.dumps(plain)
    halves = [(toxic[h::2], ordinary[h::2]) for h in (0, 1)]
    found = segments([set(docs[i]) for i in halves[0][0]], [set(docs[i]) for i in halves[0][1]])
    base, extra = _ordinary_content([docs[i] for i in halves[0][1]]), b"".join(found[::-1])
    memo = Recent(Cells(base, extra), 1 << 30)
    cells = [np.fromiter((memo[w] for w in d), dtype=np.int64, count=len(d)) for d in docs]
    count = [sum((np.bincount(cells[i], minlength=LENGTHS * GAINS) for i in half), np.zeros(LENGTHS * GAINS)) for half in halves[1]]
    total = [max(1.0, c.sum()) for c in count]
    ratio = np.log((count[0] + 0.3) / total[0]) - np.log((count[1] + 0.3 * total[1] / total[0]) / total[1])
    x = np.array([evidence(ratio[c]) for c in cells])
    tuned = np.concatenate(halves[1])
    return pickle.dumps((base, extra, ratio, logistic(x[tuned], y[tuned]) + np.array([0.0, 0.0, shift])))


def model(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: tuple[int, int] = TRAIN_ROWS) -> bytes:
    """Fit on at most ``rows`` labelled documents of each class outside the held-out fold (crc32 of the id mod 3 is 1).

    Scores are at the odds of all these labels, whatever the sample's.
    """
    train = fold(3) != 1
    return fitted(sample(docs, labels, label, rows, train), partial(fit, shift=odds_shift(labels, label, rows, train)))


def scored(docs: DataFrame, fitted_model: bytes) -> DataFrame:
    """(doc_id, score): probability of label 1 of each whole text.

    Null or empty text has no windows and so no evidence; every row gives a row; a null doc_id stays null; other columns
    are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted_model)
    loaded: list = []

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not loaded:
            base, extra, ratio, weights = pickle.loads(shared.value)
            cells = Cells(base, extra)
            loaded.append((Recent(lambda w: float(ratio[cells(b" " + w + b" ")]), CACHE), weights))
        memo, weights = loaded[0]
        x = np.array([(*evidence(np.array([memo[w] for w in (t or "").encode().lower().split()])), 1.0) for t in batch.column("text").to_pylist()])
        score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return with_ids(with_text(docs).mapInArrow(in_batches(step), "doc_id long, score double"))


def classified(docs: DataFrame, labels: DataFrame, threshold: float = TOXIC) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; predicted is 1 where the score reaches ``threshold``.

    With fewer than four labelled documents of a class every score is the classes' smoothed share. Labels that are null,
    have no doc_id or belong to no document are not used; of several labels of an id the largest counts. Rows that repeat a
    doc_id are scored each by its own text. A null doc_id gives a null held_out. An empty ``documents`` gives an empty
    result.
    """
    out = scored(docs, model(docs, labels))
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
