"""Byte-level BPE by dynamic programming over prefixes, instead of repeated merging.

For each prefix of a piece of text there is exactly one last token that the merge procedure could leave there, and it is
the one token that ends there, continues a valid encoding of the prefix before it, and is compatible with that one's last
token. The tokens that end at a place come from an automaton over the vocabulary. Two tokens are compatible when merging
their concatenation gives back the two; that is decided by walking down their merge trees. Following the back-pointers
from the end emits the ids.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumentrace.llm.common import Recent, in_batches, with_ids, with_text

# The pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker remembers.
CACHE = 200_000
OUT = "doc_id long, ids binary, decoded string"


def byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte: itself where it is printable and no space, else the next free from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBPE:
    """Encoder and decoder of one vocabulary file (a JSON file of the ``tokenizers`` library, byte-level BPE)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        vocab = {bytes(symbols[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in symbols for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t in self.special:
            vocab.pop(t.encode(), None)
        self.bytes_of = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.vocab = vocab
        self.pair_id: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (bytes(symbols[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            a, b, ab = vocab[left], vocab[right], vocab[left + right]
            self.pair_id[a, b] = rank
            if ab not in self.parts:
                self.parts[ab], self.rank[ab] = (a, b), rank
        automaton = ahocorasick.Automaton()
        for text, token in vocab.items():
            if len(text) == 1 or token in self.parts:  # a byte or the result of some merge
                automaton.add_word(text.decode("latin-1"), (token, len(text)))
        automaton.make_automaton()
        self.ends = automaton.iter
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.cache = Recent(self.piece, CACHE)
        self.fits: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' text would leave exactly these two tokens."""
        if len(self.fits) > 4 * CACHE:
            self.fits.clear()
        known = self.fits[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # At the border, the last part of left and the first part of right exist from some rank on until they merge
        # into their parents. A merge across the border that comes before both parents' merges breaks the pair.
        # Of equal ranks the merge further left comes first.
        never = 1 << 62
        limit, last = never, never
        a, b = left, right
        while True:
            across = self.pair_id.get((a, b), never)
            if across < limit and across <= last:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # undo the later of the two merges; of equal ones, the right one happened later
            if ra > rb:
                limit = ra
                a = self.parts[a][1]
            else:
                last = rb
                b = self.parts[b][0]

    def piece(self, text: str) -> bytes:
        """Ids of one piece, as little-endian 32-bit words."""
        data = text.encode()
        n = len(data)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        fits = self.fits
        # tokens that end at a place come longest first; the first compatible one is the only one
        for at, (token, size) in self.ends(data.decode("latin-1")):
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                left = last[start]
                good = fits.get((left, token))
                if good is None:
                    good = self.compatible(left, token)
                if not good:
                    continue
            last[end], back[end] = token, start
        ids, end = [], n
        while end:
            ids.append(last[end])
            end = back[end]
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian 32-bit words; strings of special tokens give their ids."""
        parts = self.cut(text) if self.cut and any(t in text for t in self.special) else [text]
        cache, out = self.cache, []
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
                continue
            out += [cache[piece] for piece in self.split(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of the ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[str, PrefixBPE] = {}


def coder(path: str) -> PrefixBPE:
    """The encoder of a vocabulary file, one for each Python worker."""
    if path not in _loaded:
        _loaded[path] = PrefixBPE(path)
    return _loaded[path]


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, decoded): each whole text as ids (little-endian 32-bit words) and those ids as text again.

    ``vocabulary`` is the path of a byte-level BPE file, the same on all executors. Null text counts as empty and gives no
    ids; every row gives a row, repeated ones too; a null doc_id stays null; other columns are not read.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = coder(vocabulary)
        ids = [bpe.encode(t or "") for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return with_ids(with_text(docs).mapInArrow(in_batches(step), OUT))
