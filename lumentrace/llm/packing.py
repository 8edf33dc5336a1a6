"""Order-preserving packing of documents into fixed-length training sequences by dynamic programming.

Documents stand in order of doc_id. A sequence is a stretch of at most ``length`` tokens between two cut points, and a
cut point lies at the end of a document or of a sentence. Only a sentence of more than ``LONG_PART`` of a sequence, which
mostly stands for text without sentences, may be cut inside, at every ``HARD_STEP`` tokens. The cost of a packing is its padding plus a penalty for each cut that truncates a document; the best predecessor of a cut is
the least of (cost + position) over a window that slides with the cut, kept in a monotone queue, so the work is linear.
"""

from __future__ import annotations

import re
import struct
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lumentrace.llm.bpe import byte_symbols
from lumentrace.llm.common import Recent, text_steps, with_ids, with_text

#: Costs of a cut at a sentence's end inside a document, and inside a sentence, as parts of a sequence of padding.
SENTENCE_CUT, HARD_CUT = 1 / 512, 1 / 32
#: Tokens between cut points inside a long sentence, at most this part of a sequence, and the part from which a sentence is long.
HARD_STEP, HARD_PART, LONG_PART = 24, 1 / 64, 1 / 16
#: Tokens that a task packs at a time; what the last sequence of a block holds goes on into the next block.
BLOCK = 1 << 20
#: Words whose ids a worker remembers.
CACHE = 500_000
OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

_coders: dict[str, Recent] = {}
_LOWER_WORD = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
_AFTER_SIGN = re.compile("[^\\w \\t-\\r][.,]|_[.,]|[\u0130\u0250-\U0010ffff]").search
_MARKED = re.compile("[A-Z][\u0300-\U0010ffff]").search


def word_ids(vocabulary: str) -> Recent:
    """Ids of words between ASCII white space (bytes to little-endian 32-bit words), by the library, remembered.

    This tokenizer drops white space and never joins across it, so a text's ids are those of its words.
    """
    if vocabulary not in _coders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        encode, merge = tokenizer.encode, tokenizer.model.tokenize
        symbols = {b: c for c, b in byte_symbols().items()}

        def ids(word: bytes) -> bytes:
            text = word.decode()
            if _LOWER_WORD(text):  # one piece that the normaliser leaves alone: straight to the merges
                found = [t.id for t in merge(word.decode("latin-1").translate(symbols))]
            else:
                found = encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(found)}I", *found)

        _coders[vocabulary] = Recent(ids, CACHE)
    return _coders[vocabulary]


def plain_words(text: str) -> list[bytes]:
    """Words of a text, brought to fewer forms without a change of their ids.

    The normaliser composes marks with their letters, then lower-cases. So ASCII capitals may go first, but for texts that may
    hold special tokens and for words in which a capital might stand before a mark, all of which lie at U+0300 or after, as
    some capitals compose where their small letters don't. Letters and signs are separate pieces, so a comma or full stop may
    leave the letter or digit before it, but for texts in which one follows another sign or a character whose normal form
    might end in a mark.
    """
    if "<|" in text:
        return text.encode().split()
    if _AFTER_SIGN(text):
        if _MARKED(text):
            return [w if _MARKED(w.decode()) else w.lower() for w in text.encode().split()]
    else:
        text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
        if text.endswith("."):
            text = text[:-1] + " ."
    return text.encode().lower().split()


def tokens_of(text: str, coder: Recent, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a document with its end id, and the places after its full stops, exclamation and question marks."""
    ids = np.frombuffer(b"".join([coder[w] for w in plain_words(text)] + [struct.pack("<I", end_id)]), dtype="<u4")
    stop = np.zeros(len(ids), dtype=bool)
    for sign in (b".", b"!", b"?"):
        stop |= ids == struct.unpack_from("<I", coder[sign])[0]
    return ids, np.flatnonzero(stop) + 1


def cut_points(docs: list[tuple[np.ndarray, np.ndarray]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where the concatenated documents may be cut, with their penalties; 0 comes first."""
    stride = max(1, min(HARD_STEP, int(length * HARD_PART)))
    at, cost, base = [np.zeros(1, dtype=np.int64)], [np.zeros(1)], 0
    for ids, places in docs:
        soft = np.unique(np.append(places[(places > 0) & (places < len(ids))], len(ids)))
        before = np.concatenate([[0], soft[:-1]])
        inside = np.where(soft - before > length * LONG_PART, (soft - before - 1) // stride, 0)
        first = np.cumsum(inside) - inside
        step = np.arange(int(inside.sum())) - np.repeat(first, inside) + 1
        every = np.concatenate([soft, np.repeat(before, inside) + step * stride])
        penalty = np.full(len(every), length * HARD_CUT)
        penalty[: len(soft)] = length * SENTENCE_CUT
        penalty[len(soft) - 1] = 0
        order = np.argsort(every, kind="stable")
        at.append(every[order] + base)
        cost.append(penalty[order])
        base += len(ids)
    return np.concatenate(at), np.concatenate(cost)


@lru_cache(maxsize=1 << 16)
def closing(tokens: int, length: int) -> tuple[float, int]:
    """Cheapest end of a shard: (cost, size of the first sequence) of splitting the last tokens.

    A sequence whose size is a power of two needs no padding, so a rest may be cut into a few of them.
    """
    if tokens & (tokens - 1) == 0:
        return 0.0, tokens
    best = (float(length - tokens), tokens)
    power = 1 << (tokens.bit_length() - 1)
    while power >= max(1, length // 64):
        best = min(best, (length * HARD_CUT + closing(tokens - power, length)[0], power))
        power >>= 1
    return best


def best_cuts(at: np.ndarray, cost: np.ndarray, length: int, final: bool) -> list[int]:
    """Ends of the sequences that cost least together; with ``final`` unset the last one may be continued for free."""
    places, costs = at.tolist(), cost.tolist()
    n = len(places)
    back = [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    total = [0.0] * n
    for j in range(1, n):
        here = places[j]
        low = here - length
        while places[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        back[j] = i
        total[j] = t = value + length - here + costs[j]
        t += here
        while queue and queue[-1][0] >= t:
            queue.pop()
        queue.append((t, j))
    end, last = places[-1], n - 1
    if n < 2:
        return []
    reach = range(int(np.searchsorted(at, end - length)), n - 1)
    tail = (lambda r: closing(r, length)[0]) if final else (lambda r: 0.0)
    i = min(reach, key=lambda i: (total[i] + tail(end - places[i]), i))
    back[last] = i
    cuts, j = [], last
    while j:
        cuts.append(places[j])
        j = back[j]
    cuts.reverse()
    if final:
        rest = end - places[i]
        cuts.pop()
        while rest:
            size = closing(rest, length)[1]
            cuts.append(end - rest + size)
            rest -= size
    return cuts


class Shard:
    """The documents of one task in order, packed block by block."""

    def __init__(self, length: int, first_id: int):
        self.length, self.sequence = length, first_id
        self.docs: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []  # doc_id, tokens packed before, all tokens, ids, places
        self.held = 0

    def add(self, doc_id: int, ids: np.ndarray, places: np.ndarray) -> None:
        self.docs.append((doc_id, 0, len(ids), ids, places))
        self.held += len(ids)

    def pack(self, final: bool) -> pa.RecordBatch | None:
        """Rows of the finished sequences; without ``final`` the last sequence's tokens stay."""
        if not self.docs:
            return None
        cuts = best_cuts(*cut_points([(d[3], d[4]) for d in self.docs], self.length), self.length, final)
        keep_from = cuts[-1] if final else (cuts[-2] if len(cuts) > 1 else 0)
        starts = np.concatenate([[0], np.cumsum([len(d[3]) for d in self.docs])])
        done = np.array([c for c in cuts if c <= keep_from], dtype=np.int64)
        edges = np.unique(np.concatenate([[0], done, starts[starts <= keep_from]]))
        a, b = edges[:-1], edges[1:]
        doc = np.searchsorted(starts, a, "right") - 1
        seq = np.searchsorted(done, a, "right")
        seq_start = np.concatenate([[0], done])[seq]
        raw = np.concatenate([d[3] for d in self.docs]).tobytes()
        ids, before, whole = (np.array([d[k] for d in self.docs], dtype=np.int64) for k in (0, 1, 2))
        columns = [
            pa.array(ids[doc]),
            pa.array(a - starts[doc] + before[doc]),
            pa.array(b - a),
            pa.array([raw[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()),
            pa.array(whole[doc]),
            pa.array(seq + self.sequence),
            pa.array(a - seq_start),
        ]
        self.sequence += len(done)
        left = []
        for k, (doc_id, packed, size, tokens, places) in enumerate(self.docs):
            cut = max(0, keep_from - int(starts[k]))
            if cut < len(tokens):
                left.append((doc_id, packed + cut, size, tokens[cut:], places[places > cut] - cut))
        self.docs, self.held = left, int(starts[-1]) - keep_from
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUT.split(", ")])


def packed(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens.

    A document is its ids under the ``tokenizers`` file ``vocabulary`` without special tokens, then ``end_id``. Each id
    lies in one piece. Returns doc_id, start (its ids before the piece), length, ids (little-endian 32-bit words),
    doc_tokens, sequence_id and offset (place in the sequence, gapless from 0). Documents are dealt to tasks by ranges of
    doc_id and packed in order; sequences never span tasks, and the rest of a task's tokens closes with sequences whose
    size is a power of two where that is cheaper than padding. Null or empty text gives the end id alone; a null doc_id
    comes first; repeated rows are packed each; rows that share an id, or have none, are one range and so one task, which
    streams through them; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(vocabulary)
        shard = Shard(length, TaskContext.get().partitionId() << 32)
        for step in text_steps(batches):
            for doc_id, text in zip(step.column("doc_id").to_pylist(), step.column("text").to_pylist(), strict=True):
                shard.add(doc_id, *tokens_of(text or "", coder, end_id))
                if shard.held >= BLOCK:
                    yield shard.pack(False)
        if (out := shard.pack(True)) is not None:
            yield out

    ordered = with_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return with_ids(ordered.mapInArrow(run, OUT))
