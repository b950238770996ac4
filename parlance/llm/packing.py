"""Packed training sequences: best-fit-decreasing with a segment tree over free capacity.

Documents are tokenised and split, without loss, into pieces of at most the
sequence length. Pieces of a pool (a bounded run of one partition) are placed
longest first, each into the bin with the least free room that still holds it.
The segment tree over capacities finds that bin in logarithmic time: leaf c
counts the bins with c free places, and a descent yields the least c >= length.

Edge cases: a null or empty text has only its end-of-document id; a document of
several pieces keeps their order through ``piece_starts``; rows that share a
doc_id, and rows without one, are told apart by ``rows``; the pool bounds memory
beyond the longest text, and every partition starts its own pool; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.tokens import VOCABULARY, encode, end_of_document, id_type

PAD = 0


class CapacityTree:
    """A set of free capacities 0..most with a search for the least one that suffices."""

    def __init__(self, most: int) -> None:
        self.leaves = 1
        while self.leaves <= most:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def change(self, capacity: int, by: int) -> None:
        at = self.leaves + capacity
        while at:
            self.count[at] += by
            at //= 2

    def least(self, need: int) -> int | None:
        """The smallest stored capacity that is at least ``need``."""
        at = self.leaves + need
        if not self.count[at]:
            while at > 1 and (at % 2 or not self.count[at + 1]):
                at //= 2
            if at == 1:
                return None
            at += 1
            while at < self.leaves:
                at *= 2
                if not self.count[at]:
                    at += 1
        return at - self.leaves


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of the pieces of each bin; equal lengths keep their order."""
    tree, bins, free = CapacityTree(capacity), [], {}
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.least(lengths[k])
        if room is None:
            room, at = capacity, len(bins)
            bins.append([])
        else:
            at = free[room].pop()
            tree.change(room, -1)
        bins[at].append(k)
        left = room - lengths[k]
        free.setdefault(left, []).append(at)
        tree.change(left, 1)
    return bins


_SCHEMA = "shard long, sequence long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{}>, rows array<long>, piece_starts array<long>"


def pack(
    documents: DataFrame,
    *,
    length: int = 2048,
    pool_tokens: int = 1 << 21,
    vocabulary: str = VOCABULARY,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per packed sequence.

    ``ids`` is one row of the id matrix (``length`` ids of the vocabulary's
    ``tokens.id_type``, padded with 0 behind ``n_tokens``); ``cu_seqlens`` are
    the cumulative segment lengths from 0 to ``n_tokens``; ``position_resets``
    are the places where positions start again at 0; ``doc_ids`` and
    ``piece_starts`` say which document each segment is of and from which of its
    tokens on. ``rows`` numbers the input rows (partition above 33 bits of
    place), for ids that repeat.
    """
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made, pool, size, of = TaskContext.get().partitionId(), 0, [], 0, None
        close, row = np.array([end_of_document(vocabulary)], id_type(vocabulary)), TaskContext.get().partitionId() << 33

        def flush() -> pa.RecordBatch:
            nonlocal made
            bins = best_fit_decreasing([len(p[3]) for p in pool], length)
            matrix = np.full((len(bins), length), PAD, close.dtype)
            cuts = []
            for i, own in enumerate(bins):
                joined = np.concatenate([pool[k][3] for k in own])
                matrix[i, : len(joined)] = joined
                cuts.append([0, *np.cumsum([len(pool[k][3]) for k in own]).tolist()])
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * len(bins), pa.int64()), pa.array(range(made, made + len(bins)), pa.int64()), pa.array([c[-1] for c in cuts], pa.int32()), pa.array([m.tobytes() for m in matrix], pa.binary()),
                    pa.array(cuts, pa.list_(pa.int32())), pa.array([c[:-1] for c in cuts], pa.list_(pa.int32())), pa.array([[pool[k][0] for k in own] for own in bins], pa.list_(of)),
                    *(pa.array([[pool[k][c] for k in own] for own in bins], pa.list_(pa.int64())) for c in (1, 2)),
                ],
                ["shard", "sequence", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "rows", "piece_starts"],
            )
            made += len(bins)
            return out

        for batch in batches:
            of = batch.column(0).type
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate((encode(t, vocabulary), close))
                pool += [(own, row, lo, ids[lo : lo + length]) for lo in range(0, len(ids), length)]
                row += 1
                size += len(ids)
                if size >= pool_tokens:
                    yield flush()
                    pool, size = [], 0
        if pool:
            yield flush()

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _SCHEMA.format(kind))


def positions(cu_seqlens: list[int], length: int) -> np.ndarray:
    """Position ids of a packed row: each segment counts from 0, padding is 0."""
    out = np.zeros(length, np.int64)
    for lo, hi in zip(cu_seqlens, cu_seqlens[1:], strict=False):
        out[lo:hi] = np.arange(hi - lo)
    return out


def unpack(packed, dtype: str = "<u2") -> dict:
    """{row: (doc_id, ids)}: the token ids of every input row from all packed rows, without the end-of-document id."""
    parts: dict = {}
    for p in packed:
        ids = np.frombuffer(p["ids"], dtype)
        for k, (lo, hi) in enumerate(zip(p["cu_seqlens"], p["cu_seqlens"][1:], strict=False)):
            parts.setdefault((p["rows"][k], p["doc_ids"][k]), []).append((p["piece_starts"][k], ids[lo:hi]))
    return {row: (d, np.concatenate([ids for _, ids in sorted(own, key=lambda x: x[0])])[:-1]) for (row, d), own in parts.items()}
