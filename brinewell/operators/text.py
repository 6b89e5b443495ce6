"""Chunking for retrieval indexes.

The rule: a text is cut at the first separator of a list that occurs in it, the
separator staying with the part behind it; parts still too long are cut by the
remaining separators, at last by characters; parts are then merged in order up
to the size, and each chunk repeats as many whole parts of its predecessor's end
as fit the overlap.  Separators are literal.  Null texts have no chunks, blank
parts are kept inside chunks, chunks of nothing but white space are dropped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stable_id

#: Separators of the overlapping splitter, in order; the last one means single characters.
SENTENCE_SEPARATORS = ("\n\n", "\n", " ", ".", ",", "\u200b", "\uff0c", "\u3001", "\uff0e", "\u3002", "")


def _parts(text: str, size: int, separators: tuple[str, ...]) -> list[str]:
    if len(text) <= size:
        return [text] if text else []
    for i, s in enumerate(separators):
        if s == "":
            return [text[k : k + size] for k in range(0, len(text), size)]
        if s in text:
            cut = text.split(s)
            whole = ([cut[0]] if cut[0] else []) + [s + p for p in cut[1:]]
            return [q for p in whole for q in _parts(p, size, separators[i + 1 :] or ("",))]
    return [text[k : k + size] for k in range(0, len(text), size)]


def chunk(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    out, held, n = [], [], 0
    for part in _parts(text, size, separators):
        if held and n + len(part) > size:
            out.append("".join(held))
            while held and (n > overlap or n + len(part) > size):
                n -= len(held.pop(0))
        held.append(part)
        n += len(part)
    if held:
        out.append("".join(held))
    return [c for c in (x.strip() for x in out) if c]


def chunks(text: Column, size: int = 200, overlap: int = 10, separators: tuple[str, ...] = ("\n",)) -> Column:
    """array<string> of chunks (Arrow batches)."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and below the size")
    seps = tuple(separators)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else chunk(t, size, overlap, seps))

    return run(text)


def split_documents(docs: DataFrame, text: str, keep: list[str], size: int = 200, overlap: int = 10, separators: tuple[str, ...] = ("\n",), scope: str = "document") -> DataFrame:
    """(id, keep..., chunk_seq_num from 0, page_content, question): ``question`` is the whole text
    (``scope='document'``) or the chunk itself (``scope='chunk'``); ``id`` is a repeatable one."""
    if scope not in ("document", "chunk"):
        raise ValueError(f"scope {scope!r}")
    cut = docs.withColumn("_chunks", chunks(F.col(text), size, overlap, separators))
    out = cut.select(*keep, F.col(text).alias("_text"), F.posexplode("_chunks").alias("chunk_seq_num", "page_content"))
    return out.select(stable_id(*[F.col(k) for k in keep], F.col("chunk_seq_num")).alias("id"), *keep, "chunk_seq_num", "page_content", (F.col("_text") if scope == "document" else F.col("page_content")).alias("question"))
