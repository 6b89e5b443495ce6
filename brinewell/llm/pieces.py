"""Splitting oversized texts at natural boundaries, with overlap.

Every possible cut has a strength (paragraph, line, sentence mark, blank).  A
sparse table over those strengths answers "strongest cut in this length window,
rightmost on ties" in constant time.  The next piece starts at most ``overlap``
characters back, at a natural place where there is one, and never so far back
that the next natural cut would fall out of reach; so a cut is forced only where
a stretch longer than the limit has no natural place.

Defined results: null texts have no pieces (null); texts within the limit,
empty ones too, are one piece; positions count Unicode code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks directly after which a cut is natural.
MARKS = ".!?。！？।"
#: Characters that are white space in Unicode.
BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

NONE, BLANK, MARK, LINE, PARAGRAPH = 0, 1, 2, 3, 4

_KIND = np.zeros(65536, np.uint8)
_KIND[[ord(c) for c in MARKS]] = MARK
_KIND[[ord(c) for c in BLANKS]] = BLANK
_NEWLINE = np.zeros(65536, bool)
_NEWLINE[[ord(c) for c in "\n\r\u2028\u2029"]] = True


def cut_strengths(text: str) -> np.ndarray:
    """Strength of a cut at each position 0..len(text)."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.minimum(code, 65535).astype(np.uint16)
    kind, new = _KIND[code], _NEWLINE[code]
    out = np.zeros(len(code) + 1, np.int64)
    blank = kind == BLANK
    out[1:][blank] = BLANK  # after white space
    out[:-1][blank] = np.maximum(out[:-1][blank], BLANK)  # before it
    out[1:][kind == MARK] = MARK
    out[1:][new] = LINE
    if len(code) > 1:
        out[2:][new[1:] & new[:-1]] = PARAGRAPH
    out[0] = out[-1] = PARAGRAPH
    return out


class SparseMax:
    """Range maximum over (strength, position): the strongest, rightmost position of any window."""

    def __init__(self, strength: np.ndarray):
        self.n = len(strength)
        level = strength * self.n + np.arange(self.n)
        self.rows, step = [level], 1
        while 2 * step <= self.n:
            level = np.maximum(level[: self.n - 2 * step + 1], level[step : self.n - step + 1])
            self.rows.append(level)
            step *= 2

    def best(self, lo: int, hi: int) -> tuple[int, int]:
        """(strength, position) of the strongest cut in lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        key = int(max(self.rows[k][lo], self.rows[k][hi - (1 << k) + 1]))
        return divmod(key, self.n)


def split_text(text: str, limit: int = 1000, overlap: int = 100, slab: int = 1 << 16) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of the pieces; ``forced`` says the end is no natural place."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    n = len(text)
    if n <= limit:
        return [(0, n, False)]
    strength = cut_strengths(text)
    natural = np.flatnonzero(strength)
    slab = max(slab, 4 * limit)
    base, table = 0, SparseMax(strength[:slab])
    out, start, floor = [], 0, 0
    while n - start > limit:
        if start + limit + 1 > base + table.n and base + table.n <= n:
            base, table = start, SparseMax(strength[start : start + slab])
        # the least end of a piece: half the limit, but always past the last cut
        low = max(start + limit // 2, floor + 1)
        power, at = table.best(low - base, start + limit - base)
        if not power and floor + 1 < low:
            power, at = table.best(floor + 1 - base, low - base)
        forced = not power
        cut = start + limit if forced else at + base
        out.append((start, cut, forced))
        floor = cut
        if cut >= n:
            return out
        following = int(natural[np.searchsorted(natural, cut, "right")])
        back = max(cut - overlap, start + 1)
        if following - cut <= limit:
            back = max(back, following - limit)  # keep the next natural cut within reach
        k = int(np.searchsorted(natural, back, "left"))
        start = int(natural[k]) if natural[k] <= cut and (natural[k] < cut or not forced) else min(back, cut)
    out.append((start, n, False))
    return out


PIECES_TYPE = pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32()), ("forced", pa.bool_())]))


def split_oversized(docs: DataFrame, doc_id: str, text: str, *, limit: int = 1000, overlap: int = 100) -> DataFrame:
    """(doc_id, pieces array<struct<start_char, end_char, forced>>, longest_stretch) of every text.

    ``longest_stretch`` is the longest run of characters without white space or
    a mark. One pass, no shuffle.
    """

    def run(batches):
        for batch in batches:
            pieces, stretch = [], []
            for t in batch.column(1).to_pylist():
                if t is None:
                    pieces.append(None)
                    stretch.append(None)
                    continue
                pieces.append([{"start_char": a, "end_char": b, "forced": f} for a, b, f in split_text(t, limit, overlap)])
                stretch.append(longest_stretch(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, PIECES_TYPE), pa.array(stretch, pa.int32())], names=["_id", "pieces", "longest_stretch"])

    kind = dict(docs.dtypes)[doc_id]
    out = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"_id {kind}, pieces array<struct<start_char:int,end_char:int,forced:boolean>>, longest_stretch int")
    return out.withColumnRenamed("_id", doc_id)


def longest_stretch(text: str) -> int:
    code = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 65535).astype(np.uint16)
    stops = np.flatnonzero(_KIND[code])
    return int(np.diff(np.concatenate([[-1], stops, [len(code)]])).max() - 1)


def piece_texts(docs: DataFrame, doc_id: str, text: str, *, limit: int = 1000, overlap: int = 100) -> DataFrame:
    """One row per piece: doc_id, piece_no (from 0), start_char, end_char, forced, piece."""
    kind = dict(docs.dtypes)[doc_id]
    schema = [("piece_no", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("forced", pa.bool_()), ("piece", pa.string())]

    def run(batches):
        for batch in batches:
            rows, owner = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                if t is not None:
                    for i, (a, b, f) in enumerate(split_text(t, limit, overlap)):
                        rows.append((i, a, b, f, t[a:b]))
                        owner.append(k)
            cols = list(zip(*rows)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(cols, schema))], names=["_id", *(n for n, _ in schema)])

    out = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"_id {kind}, piece_no int, start_char int, end_char int, forced boolean, piece string")
    return out.withColumnRenamed("_id", doc_id)
