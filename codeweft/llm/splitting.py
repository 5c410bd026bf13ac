"""Cutting oversized texts at natural boundaries with overlap (problem 6).

Agglomerative merging per text: it begins with atomic segments (lines; parts of very long lines), holds every adjacent
pair in a heap by the strength of the boundary between them and merges across the weakest boundary first, as long as the
merged core and the overlap it takes from the piece before fit the limit. What is left are the strongest boundaries.

Sizes are in tokens: bytes of UTF-8 / 4, rounded down.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT_TOKENS = 1000
OVERLAP_LINES = 2
OVERLAP_BYTES = 80
#: Lines above this many bytes are atomised further, at statement ends, then at separators and spaces.
ATOM_BYTES = 1024

# Strengths of boundaries: inside a line 0 (any character), 1 (space), 2 (separator), 3 (end of a statement); between
# lines from 10 on, more for shallow indentation, ends of blocks and blank lines.
_STATEMENT = re.compile(rb"[;{}]")
_SEPARATOR = re.compile(rb"[,)\]>]")
_LINE = re.compile(rb"[^\n]*\n|[^\n]+")


def _atoms(body: bytes, atom_bytes: int) -> tuple[list[int], list[int]]:
    """Start offsets of the atoms and the strength of the boundary before each (the first is 99)."""
    starts, strength = [], []
    pos, blank_before, last = 0, False, b""
    for line in _LINE.findall(body):
        if pos > 0 or starts:
            s = 10
            text = line.strip()
            if blank_before and text:
                s += 20
            indent = len(line) - len(line.lstrip(b" \t"))
            indent += 3 * (len(line[:indent]) - len(line[:indent].replace(b"\t", b"")))
            s += max(0, 12 - indent) if text else 0
            if last.endswith((b";", b"}", b")", b":", b".")):
                s += 2
            if text.startswith((b"}", b")", b"]", b"else", b"elif", b"except", b"catch", b"fi", b"done", b"end")):
                s -= 6
        else:
            s = 99
        for i, (off, inner) in enumerate(_long_line(line, atom_bytes)):
            starts.append(pos + off)
            strength.append(s if i == 0 else inner)
        stripped = line.strip()
        blank_before = not stripped
        last = stripped or last
        pos += len(line)
    return starts, strength


def _long_line(line: bytes, atom_bytes: int) -> list[tuple[int, int]]:
    """Offsets and strengths of the atoms inside one line."""
    if len(line) <= atom_bytes:
        return [(0, 0)]
    out, start = [(0, 0)], 0
    while len(line) - start > atom_bytes:
        window = line[start : start + atom_bytes]
        cut, strength = 0, 0
        for pattern, s in ((_STATEMENT, 3), (_SEPARATOR, 2)):
            for m in pattern.finditer(window, atom_bytes // 2):
                cut, strength = m.end(), s
            if cut:
                break
        if not cut:
            space = window.rfind(b" ", atom_bytes // 2)
            cut, strength = (space + 1, 1) if space > 0 else (atom_bytes, 0)
        while cut > 1 and start + cut < len(line) and line[start + cut] & 0xC0 == 0x80:  # never inside a character
            cut -= 1
        start += cut
        out.append((start, strength))
    return out


def split_text(body: str, limit_tokens: int = LIMIT_TOKENS, overlap_lines: int = OVERLAP_LINES, overlap_bytes: int = OVERLAP_BYTES) -> list[tuple[int, int, int, int, int]]:
    """Pieces of a text as (start, core_start, end, first_line, last_line): byte offsets and 0-based line numbers.

    ``start`` is ``core_start`` less the overlap with the piece before. A text within the limit is one piece. After a cut
    between lines the overlap is the two lines before it; inside a line it is 80 bytes (or a few less, never half a
    character). Where two lines before a cut take more than half of the limit, 80 bytes are shared instead.
    """
    data = body.encode("utf-8")
    most = limit_tokens * 4 + 3
    if len(data) <= most:
        return [(0, 0, len(data), 0, data.count(b"\n") - (1 if data.endswith(b"\n") and len(data) else 0))]
    starts, strength = _atoms(data, min(ATOM_BYTES, most // 3))
    n = len(starts)
    ends = starts[1:] + [len(data)]

    def overlap(i: int) -> int:
        """Where the overlap of a piece that begins with atom i starts."""
        at = starts[i]
        if i == 0:
            return 0
        if data[at - 1 : at] == b"\n":
            back = at - 1
            for _ in range(overlap_lines):
                back = data.rfind(b"\n", 0, back)
                if back < 0:
                    break
            if at - (back + 1) <= most // 2:
                return back + 1
        back = max(0, at - overlap_bytes)
        while back < at and data[back] & 0xC0 == 0x80:
            back += 1
        return back

    shared = [overlap(i) for i in range(n)]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    end_of, alive = ends[:], [True] * n
    heap = [(strength[i], starts[i] - starts[i - 1], i) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, _, i = heapq.heappop(heap)
        if not alive[i]:
            continue
        a = left[i]
        if end_of[i] - shared[a] > most:
            continue  # both sides only grow, so this boundary stays
        end_of[a], alive[i] = end_of[i], False
        right[a] = right[i]
        if right[i] < n:
            left[right[i]] = a
    out = []
    i = seen = line = 0  # ``line``: line breaks before ``seen``, carried from piece to piece
    while i < n:
        line += data.count(b"\n", seen, shared[i]) if shared[i] >= seen else -data.count(b"\n", shared[i], seen)
        seen = shared[i]
        last = line + data.count(b"\n", seen, max(seen, end_of[i] - 1))
        out.append((seen, starts[i], end_of[i], line, last))
        i = right[i]
    return out


PIECES = "id bigint, piece int, n_pieces int, start_line int, end_line int, start_byte int, overlap_bytes int, n_tokens int, text string"


def split_oversized(df: DataFrame, limit_tokens: int = LIMIT_TOKENS, overlap_lines: int = OVERLAP_LINES, overlap_bytes: int = OVERLAP_BYTES) -> DataFrame:
    """The pieces of every ``body`` above the limit; see :data:`PIECES`.

    Lines count from the row's ``start_line``, or from 1 where that is null or below 1; ``end_line`` is not trusted.
    Null, empty and small bodies give no rows (they need no cut). Exact repeats of a row count once. Extra columns are
    ignored. Each row is cut on its own, so partitions and hot files do not matter.
    """
    big = (
        df.select(F.col("id").cast("long").alias("id"), F.col("body").cast("string").alias("body"), F.col("start_line").cast("int").alias("start_line"))
        .where(F.floor(F.octet_length("body") / 4) > limit_tokens)
        .dropDuplicates(["id", "body", "start_line"])
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, body, first in zip(pdf["id"], pdf["body"], pdf["start_line"]):
                base = int(first) if first == first and first is not None and first >= 1 else 1
                data = body.encode("utf-8")
                pieces = split_text(body, limit_tokens, overlap_lines, overlap_bytes)
                for k, (start, core, end, a, b) in enumerate(pieces):
                    rows.append((i, k, len(pieces), base + a, base + b, start, core - start, (end - start) // 4, data[start:end].decode("utf-8")))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    return big.mapInPandas(run, PIECES)
