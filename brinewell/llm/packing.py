"""Filling containers of fixed capacity with whole texts: best-fit decreasing.

Each input partition packs its own items (no shuffle, memory bounded by the
partition), longest first, each into the open container with the least room
that still takes it; a segment tree over remaining capacities finds that
container in logarithmic time.  Only the last containers of a partition stay
open, so the unused space is that of about one container per partition.

Defined results: null and empty texts have no tokens and take no container
(their container_id is null, n_tokens 0); a text over the capacity is cut into
pieces of exactly the capacity and a rest; ties go in order of doc_id; repeated
ids are packed as separate items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_path, encode_text, encoding


class RoomTree:
    """Open containers by remaining room 1..capacity; ``tightest(n)`` is the least room >= n."""

    def __init__(self, capacity: int):
        self.half = 1 << max(1, capacity.bit_length())
        self.count = [0] * (2 * self.half)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        i, count = room + self.half, self.count
        while i:
            count[i] += 1
            i >>= 1

    def tightest(self, need: int) -> int:
        """Least room >= need with an open container, or -1."""
        count = self.count
        i = need + self.half
        if count[i]:
            return need
        # climb until a right sibling holds something, then descend to its left-most leaf
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.half:
                    i <<= 1
                    if not count[i]:
                        i += 1
                return i - self.half
            i >>= 1
        return -1

    def take(self, room: int) -> int:
        i, count = room + self.half, self.count
        while i:
            count[i] -= 1
            i >>= 1
        return self.bins[room].pop()


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of every item (sizes 1..capacity); longest first, ties in order."""
    sizes = np.asarray(sizes, np.int64)
    if len(sizes) and (sizes.min() < 1 or sizes.max() > capacity):
        raise ValueError("sizes must lie in 1..capacity")
    tree, out, n = RoomTree(capacity), np.zeros(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        room = tree.tightest(size)
        if room < 0:
            number, room, n = n, capacity, n + 1
        else:
            number = tree.take(room)
        out[i] = number
        if room > size:
            tree.add(room - size, number)
    return out


PACKED = pa.schema([("container_id", pa.int64()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("start_token", pa.int32()), ("n_tokens", pa.int32())])
PACKED_DDL = "container_id long, doc_id long, piece_no int, start_token int, n_tokens int"


def pack_sizes(doc_ids: np.ndarray, sizes: np.ndarray, capacity: int, first: int = 0) -> pa.RecordBatch:
    """Rows of PACKED for one set of items."""
    order = np.argsort(doc_ids, kind="stable")
    doc_ids, sizes = doc_ids[order], sizes[order]
    pieces = np.maximum(1, -(-sizes // capacity))
    owner = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = number * capacity
    n = np.minimum(capacity, sizes[owner] - start)
    box = np.full(len(owner), -1, np.int64)
    some = n > 0
    box[some] = best_fit_decreasing(n[some], capacity) + first
    return pa.RecordBatch.from_arrays(
        [pa.array(box, mask=~some), pa.array(doc_ids[owner], pa.int64()), pa.array(number.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], schema=PACKED
    )


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """One row per text (or piece of an oversized one): container_id, doc_id, piece_no, start_token, n_tokens."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    place = path or default_path()

    def run(batches):
        enc = encoding(place)
        ids, sizes = [], []
        for batch in batches:
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            sizes.append(np.fromiter((len(encode_text(enc, t)) for t in batch.column(1).to_pylist()), np.int64, batch.num_rows))
        if ids:
            yield pack_sizes(np.concatenate(ids), np.concatenate(sizes), capacity, TaskContext.get().partitionId() << 32)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text")).mapInArrow(run, PACKED_DDL)
