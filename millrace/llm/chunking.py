"""Cutting oversized texts at natural boundaries, with an overlap.

Sizes are prefix sums over atoms (code points, or tokens of a public vocabulary). The boundaries of a text are sorted
arrays of atom offsets, one for each strength: before a top-level definition, after a blank line, after a line, after a
space. A piece ends at the last boundary under the limit, found by binary search in the strongest array that has one in
the second half of the piece; where none has, it is cut hard at the limit. The next piece starts ``overlap`` before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from ..operators.batches import REMEMBERED
from ..operators.batches import pieces as batch_pieces
from .tokens import TOKENIZER_DIR, TOKENIZER_FILE, encoding

STRENGTHS = ("definition", "blank_line", "line", "space")
#: A piece cut at a boundary has at least this share of the limit.
LEAST_FILL = 0.5
_DEFINITION = re.compile(r"\n[ \t]*\r?\n(?=[^\s})\]])")
_BLANK = re.compile(r"\n[ \t]*\r?\n")
_SPACE = re.compile(r"[ \t]+")


def boundaries(text: str) -> list[np.ndarray]:
    """Offsets (in code points) after which the text may be cut, by strength, each sorted."""
    line = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    return [
        np.asarray([m.end() for m in _DEFINITION.finditer(text)], np.int64),
        np.asarray([m.end() for m in _BLANK.finditer(text)], np.int64),
        line.astype(np.int64),
        np.asarray([m.end() for m in _SPACE.finditer(text)], np.int64),
    ]


def cut(prefix: np.ndarray, levels: list[np.ndarray], limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces as (first atom, end atom, kind of the cut at the end).

    prefix: size before each atom, and of all of them at the end; levels: atom offsets, sorted. Every piece has at most
    ``limit``; consecutive pieces share ``overlap`` (with sizes of atoms over 1, as near below it as they allow).
    """
    n = len(prefix) - 1
    if prefix[n] <= limit:
        return [(0, n, "end")]
    overlap = min(overlap, limit - 1)
    out: list[tuple[int, int, str]] = []
    start = 0
    while True:
        most = int(np.searchsorted(prefix, prefix[start] + limit, side="right")) - 1
        if most >= n:
            out.append((start, n, "end"))
            return out
        most = max(most, start + 1)
        least = max(int(np.searchsorted(prefix, prefix[start] + max(overlap + 1, int(limit * LEAST_FILL)), side="left")), start + 1)
        end, kind = most, "hard"
        for level, name in zip(levels, STRENGTHS, strict=True):
            k = int(np.searchsorted(level, most, side="right")) - 1
            if k >= 0 and level[k] >= least:
                end, kind = int(level[k]), name
                break
        out.append((start, end, kind))
        back = int(np.searchsorted(prefix, prefix[end] - overlap, side="left"))
        start = max(back, start + 1)


def _tokens(text: str, folder: str, vocabulary: str) -> np.ndarray:
    """Code point offset of the start of each token, and the text's length: atoms of unit ``tokens``."""
    e = encoding(folder, vocabulary)
    sizes = np.asarray([len(b) for b in map(e.decode_single_token_bytes, e.encode_ordinary(text))], np.int64)
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points[np.concatenate([[0], np.cumsum(sizes)])]


def split(text: str, limit: int, overlap: int, unit: str = "characters", folder: str = TOKENIZER_DIR, vocabulary: str = TOKENIZER_FILE) -> list[tuple[int, int, int, str]]:
    """Pieces of a text as (start, end, size, kind of cut); offsets in code points."""
    if unit == "characters":
        if len(text) <= limit:
            return [(0, len(text), len(text), "end")]
        return [(a, b, b - a, kind) for a, b, kind in cut(np.arange(len(text) + 1), boundaries(text), limit, overlap)]
    at = _tokens(text, folder, vocabulary)
    n = len(at) - 1
    levels = []
    for level in boundaries(text) if n > limit else [np.zeros(0, np.int64)] * 4:
        k = np.searchsorted(at, level)  # only boundaries between tokens
        k = np.minimum(k, n)
        levels.append(k[at[k] == level])
    return [(int(at[a]), int(at[b]), b - a, kind) for a, b, kind in cut(np.arange(n + 1), levels, limit, overlap)]


def text_pieces(
    df: DataFrame, key: str, text: str, limits: list[tuple[str, str, int, int]], with_text: bool = True, oversized_only: bool = True,
    folder: str = TOKENIZER_DIR, vocabulary: str = TOKENIZER_FILE,
) -> DataFrame:
    """Pieces of distinct (key, text): ``key, text_hash, limit_name, piece_no, n_pieces, start, end, size, cut`` and the piece.

    limits: (name, unit, most, overlap), unit ``characters`` or ``tokens``. ``start`` and ``end`` are offsets in code points,
    so ``text[start:end]`` is the piece and the pieces without their overlaps are the text, character by character. Null
    texts have no pieces, an empty text one empty piece (none with ``oversized_only``), texts within the limit one piece
    (none with ``oversized_only``); a key with two texts has the pieces of both; repeated rows count once.

    One narrow pass; each task cuts a repeated text once, and what is left of the repetition between tasks is dropped by a
    shuffle of the pieces: of their offsets only, or with ``with_text`` of offsets and texts, about as much as the
    distinct oversized texts hold, times the number of limits.
    """
    ship(df.sparkSession)
    fields = [
        df.schema[key], T.StructField("text_hash", T.LongType()), T.StructField("limit_name", T.StringType()), T.StructField("piece_no", T.IntegerType()), T.StructField("n_pieces", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("size", T.LongType()), T.StructField("cut", T.StringType()),
    ]
    if with_text:
        fields.append(T.StructField("piece", T.StringType()))
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for part in batch_pieces(batch, 2):
                keys, hashes = part.column(0).to_pylist(), part.column(1).to_pylist()
                fresh = []
                for i, pair in enumerate(zip(keys, hashes, strict=True)):
                    if pair not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(pair)
                        fresh.append(i)
                rows: list[tuple] = []
                at: list[int] = []
                for i, t in zip(fresh, part.column(2).take(pa.array(fresh, pa.int64())).to_pylist(), strict=True):
                    for name, unit, most, overlap in limits:
                        found = split(t, most, overlap, unit, folder, vocabulary)
                        if len(found) == 1 and oversized_only:
                            continue
                        for no, (a, b, size, kind) in enumerate(found):
                            at.append(i)
                            rows.append((hashes[i], name, no, len(found), a, b, size, kind, t[a:b] if with_text else None))
                if rows:
                    columns = list(zip(*rows, strict=True))[: len(names) - 1]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, types, strict=False))], names=names)

    source = df.where(F.col(text).isNotNull()).select(F.col(key), F.xxhash64(text).alias("__hash"), F.col(text))
    return source.mapInArrow(run, T.StructType(fields)).dropDuplicates([key, "text_hash", "limit_name", "piece_no"])
