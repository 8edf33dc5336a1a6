"""Substring deduplication over bytes: suffixes ordered only through ``threshold`` bytes.

The order of suffixes is needed only as far as their first ``threshold`` bytes, and only up to equality: equal groups
are exactly the repeated windows. Passes go from the most significant digit, the anchor's gram, to narrower nodes of
start positions (module ``windows``); a pass drops what is already unique, so almost no suffix reaches the last digit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumentrace.llm.common import in_batches, one_a_text, own_ids, with_ids, with_text, written
from lumentrace.llm.windows import NODES, Tokens, anchors_of, attach, covered, judged, refine, texts_by_id

THRESHOLD = 400
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def byte_tokens(threshold: int) -> Tokens:
    return Tokens("bytes", threshold, max(1, min(32, threshold)), (16, 1))


def repeated_spans(texts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, spans) of (doc_id, text) rows with unique ids.

    A span (pos, n) stands for the byte windows [pos, pos + n - 1 + threshold), all of which also start elsewhere.
    """
    tokens = byte_tokens(threshold)
    first = written(judged(texts.mapInArrow(anchors_of(tokens), NODES), "any").where("hit or open"), "suffix-first")
    return refine(texts, first, tokens, "any", "suffix")[0]


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Remove each byte covered by a ``threshold``-byte string that also starts anywhere else in ``docs``.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary, since a cut may split a
    character). Null text counts as empty; a text below the threshold keeps all; overlapping occurrences count;
    matches never cross documents. Rows that repeat a doc_id with the same text count once and get the same result;
    different texts under one doc_id are documents of their own, and so are those without one.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = with_text(docs)
    own, keys = one_a_text(rows)
    texts = texts_by_id(own).rows
    spans = repeated_spans(texts, threshold)

    def cut(step: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for i, text in enumerate(step.column("text").to_pylist()):
            data = (text or "").encode()
            gone = covered(step, i, len(data), threshold)
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
            kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes() if gone.any() else data
            for to, x in zip(out, (len(data), int(gone.sum()), int((edge == 1).sum()), kept), strict=True):
                to.append(x)
        arrays = [step.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return with_ids(own_ids(attach(texts, spans).mapInArrow(in_batches(cut), OUT), keys, rows))
