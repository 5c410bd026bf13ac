"""Encoding of the whole corpus with a public byte-level BPE vocabulary (problem 7).

The text is split by the vocabulary's pattern. Each distinct piece is encoded once per Python worker by a backtracking
encoder: an Aho-Corasick automaton gives the longest token at every position in one pass; tokens are appended as long as
each neighbouring pair is compatible, and on a conflict the encoder takes the next shorter token or steps back. Positions
that proved to be dead ends are marked, so no position is tried twice and the work is linear in the piece.

A pair (a, b) is compatible when merging the bytes of ``a + b`` by rank gives exactly ``[a, b]``. A token sequence whose
neighbours are all compatible is the merge result itself, so the outcome equals that of rank-ordered merging. Pairs are
looked up in a table that is filled on first use.

Vocabulary files stay where they are; ``vocab`` is their path. Nothing is trained.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces kept per worker; the store is emptied when full (bounds memory, not the result).
CACHED_PIECES = 400_000
LONGEST_CACHED = 64


class ByteBPE:
    """A byte-level vocabulary: ``encode`` text to ids, ``decode`` ids to text."""

    def __init__(self, vocab: str = VOCAB, pattern: str = PATTERN) -> None:
        import ahocorasick
        import regex

        self.rank: dict[bytes, int] = {}
        with open(vocab, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.rank[base64.b64decode(token)] = int(rank)
        self.token: dict[int, bytes] = {r: t for t, r in self.rank.items()}
        self.pieces = regex.compile(pattern).findall
        # characters of the automaton stand for bytes
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), r))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        # offset table of the decoder: all tokens' bytes in one array, token r at offsets[r]:offsets[r + 1]
        size = max(self.token) + 1
        self.offsets = np.zeros(size + 1, np.int64)
        self.offsets[1:] = np.cumsum([len(self.token.get(r, b"")) for r in range(size)])
        self.bytes = np.frombuffer(b"".join(self.token.get(r, b"") for r in range(size)), np.uint8)

    def merge(self, data: bytes) -> list[int]:
        """Rank-ordered merging, the definition; used on pairs of tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a`` inside a piece."""
        key = (a, b)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= CACHED_PIECES * 5:
                self.compatible.clear()
            known = self.compatible[key] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def next_shorter(self, r: int) -> int:
        """The longest token that is a proper prefix of token ``r``, -1 if none."""
        known = self.shorter.get(r)
        if known is None:
            t = self.token[r]
            known = self.shorter[r] = next((self.rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.rank), -1)
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest, length = [-1] * n, [0] * n
        for end, (k, r) in self.automaton.iter(data.decode("latin-1")):
            start = end - k + 1
            if k > length[start]:
                longest[start], length[start] = r, k
        dead = bytearray(n + 1)
        out: list[int] = []
        pos, candidate = 0, longest[0]
        while pos < n:
            last = out[-1] if out else -1
            while candidate >= 0:
                end = pos + len(self.token[candidate])
                if not dead[end] and (last < 0 or self.fits(last, candidate)):
                    break
                candidate = self.next_shorter(candidate)
            if candidate >= 0:
                out.append(candidate)
                pos = end
                candidate = longest[pos] if pos < n else -1
            else:
                dead[pos] = 1
                candidate = out.pop()  # every single byte is a token, so position 0 never dies
                pos -= len(self.token[candidate])
                candidate = self.next_shorter(candidate)
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of the text without special tokens; null and empty texts give an empty list."""
        out: list[int] = []
        known = self.known
        for piece in self.pieces(text or ""):
            ids = known.get(piece)
            if ids is None:
                ids = tuple(self.encode_piece(piece.encode("utf-8")))
                if len(piece) <= LONGEST_CACHED:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    known[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids, by one gather through the offset table."""
        if not len(ids):
            return ""
        r = np.asarray(ids, np.int64)
        start, size = self.offsets[r], self.offsets[r + 1] - self.offsets[r]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(start, size)
        return self.bytes[at].tobytes().decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(vocab: str = VOCAB) -> ByteBPE:
    """One vocabulary per Python worker."""
    return ByteBPE(vocab)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as the cluster has cores; a table that is already split stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * 2)


def encode_column(df: DataFrame, key: str, text: str, vocab: str = VOCAB) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row.

    Null and empty texts give an empty list. Repeated rows and equal keys stay as they are; other columns are ignored. A
    very long text is one row's list. An empty table gives an empty table.
    """
    kind = df.schema[key].dataType.simpleString()
    slim = spread(df.select(df[key].alias("key"), df[text].alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocab)
        for b in batches:
            lists = [bpe.encode(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            offsets[1:] = np.cumsum([len(x) for x in lists])
            flat = np.fromiter((i for x in lists for i in x), np.int32, offsets[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["key", "ids"])

    return slim.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_column(df: DataFrame, key: str, ids: str, vocab: str = VOCAB) -> DataFrame:
    """``key`` and ``text`` decoded from the ids; a null list gives a null text, an empty one the empty text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocab)
        for b in batches:
            texts = [None if x is None else bpe.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return df.select(df[key].alias("key"), df[ids].alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
