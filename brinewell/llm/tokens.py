"""Encoding a corpus with a public tokenizer (rank files read by tiktoken).

Defined results: null and empty texts have the empty list of ids; special
tokens are never produced, their spellings are ordinary text; every other text
is encoded whole, and ``decode_ids(encode_ids(t)) == t``.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = "byte_bpe_50k"
#: Texts longer than this many characters are cut at safe boundaries before encoding.
LONG_TEXT = 8192

#: Fixed value: the public pre-splitting pattern of the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A token of that pattern always begins here: a single blank between two printing
#: characters, or the change from a letter to a digit or back.
SAFE = regex.compile(r"(?<=\S)(?= \S)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


def default_path(name: str = DEFAULT_TOKENIZER, folder: str | None = None) -> str:
    """Place of a rank file: ``folder``, or the installed ``public_tokenizers``, or /opt/tokenizers."""
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, f"{name}.tiktoken")


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = LONG_TEXT) -> list[str]:
    """``text`` cut at safe boundaries about every ``size`` characters; never elsewhere."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        m = SAFE.search(text, start + size)
        if m is None:
            break
        out.append(text[start : m.start()])
        start = m.start()
    out.append(text[start:])
    return out


def encode_text(enc, text: str | None) -> list[int]:
    if not text:
        return []
    ids: list[int] = []
    for piece in safe_pieces(text):
        ids += enc.encode_ordinary(piece)
    return ids


def encode_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row, in one pass without a shuffle."""
    place = path or default_path()

    def run(batches):
        enc = encoding(place)
        for batch in batches:
            ids = [encode_text(enc, t) for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate([np.asarray(x, np.int32) for x in ids]) if len(ids) else np.zeros(0, np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=[doc_id, "ids"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(doc_id, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{doc_id}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens int) of every row; null and empty texts have 0."""
    place = path or default_path()

    def run(batches):
        enc = encoding(place)
        for batch in batches:
            n = [len(encode_text(enc, t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], names=[doc_id, "n_tokens"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(doc_id, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{doc_id}` {kind}, n_tokens int")


def decode_ids(rows: DataFrame, doc_id: str = "doc_id", ids: str = "ids", *, path: str | None = None, errors: str = "replace") -> DataFrame:
    """(doc_id, text): the tokens' raw bytes joined, then read as UTF-8.

    Bytes are joined before they are read, since one character may be spread
    over tokens. A null list gives null; an id outside the vocabulary raises.
    """
    place = path or default_path()

    def run(batches):
        enc = encoding(place)
        for batch in batches:
            out = [None if x is None else enc.decode_bytes(x).decode("utf-8", errors) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[doc_id, "text"])

    kind = dict(rows.dtypes)[doc_id]
    return rows.select(doc_id, ids).mapInArrow(run, f"`{doc_id}` {kind}, text string")
