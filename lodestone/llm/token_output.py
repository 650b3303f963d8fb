"""Packed token ids in binary (operator 1): best-fit-decreasing packing with capacity search in a segment tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestone.llm import word_bpe
from lodestone.llm.common import slices, texts

PACKED = "sequence_id long, doc_ids array<long>, doc_starts array<long>, n_tokens int, cu_seqlens array<int>, input_ids binary, position_ids binary"


class _Rooms:
    """Bins by their remaining room; a segment tree over the rooms finds the least that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = [0] * (2 * self.size)  # bins under each node
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_: int, by: int = 1) -> None:
        if by > 0:
            self.bins[room].append(bin_)
        node = room + self.size
        while node:
            self.some[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of a bin with the least room of at least need; the bin is taken out."""
        node = need + self.size
        while not self.some[node]:
            while node & 1:  # up until there is a right sibling
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.size:
            node = 2 * node if self.some[2 * node] else 2 * node + 1
        room = node - self.size
        bin_ = self.bins[room].pop()
        self.add(room, bin_, -1)
        return room, bin_


def best_fit(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length). Documents over the capacity are first cut at its multiples; pieces
    go by descending length (then document and start) into the fullest sequence that has room, or else a new one."""
    pieces = sorted((-min(capacity, n - s), d, s) for d, n in enumerate(lengths) for s in range(0, n, capacity))
    rooms, out = _Rooms(capacity), []
    for n, d, s in pieces:
        found = rooms.take(-n)
        room, at = found or (capacity, len(out))
        if not found:
            out.append([])
        out[at].append((d, s, -n))
        if room + n:
            rooms.add(room + n, at)
    return out


def packed_matrix(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, pad_id: int = 0, block_tokens: int = 1 << 20) -> DataFrame:
    """One row for each packed sequence: input_ids (capacity little-endian ids, 16 bits wide if the vocabulary allows, padded
    with pad_id), position_ids (as many 16 or 32 bit positions that start again at 0 with each piece), cu_seqlens (cumulative lengths of the
    pieces from 0 to n_tokens), and of each piece its document and its first id's place there.

    Null text counts as empty: such a document is its end id alone. Null doc_ids stay null, repeated rows are documents of
    their own, an empty table gives no rows, other columns play no part. No id is lost or repeated. Packing runs in blocks
    of block_tokens tokens where documents are read, without a shuffle; sequence ids don't change when a task runs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = word_bpe.load(path)
        wide, place = vocabulary.wide, np.dtype("<u2" if capacity <= 1 << 16 else "<u4")
        end = np.array([end_id], dtype=wide)
        sequence = TaskContext.get().partitionId() << 32
        counting = np.arange(capacity, dtype=place)
        ids: list[np.ndarray] = []
        keys: list = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for pieces in best_fit([len(x) for x in ids], capacity):
                cuts = np.cumsum([0, *(n for _, _, n in pieces)], dtype=np.int32)
                matrix, places = np.full(capacity, pad_id, dtype=wide), np.zeros(capacity, dtype=place)
                for (d, s, n), at in zip(pieces, cuts.tolist()):
                    matrix[at : at + n] = ids[d][s : s + n]
                    places[at : at + n] = counting[:n]
                rows.append((sequence, [keys[d] for d, _, _ in pieces], [s for _, s, _ in pieces], int(cuts[-1]), cuts.tolist(), matrix.tobytes(), places.tobytes()))
                sequence += 1
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in PACKED.split(", ")])

        for batch in slices(batches):
            for key, x in zip(batch.column(0).to_pylist(), vocabulary.encode(batch.column(1).to_pylist())):
                keys.append(key)
                ids.append(np.concatenate([x, end]))
                held += len(x) + 1
                if held >= block_tokens:
                    yield packed()
                    ids, keys, held = [], [], 0
        if keys:
            yield packed()

    return texts(docs).mapInArrow(run, PACKED)


def write_packed(docs: DataFrame, out: str, path: str, **options) -> None:
    """Writes the matrix as Parquet files to a folder that all executors share; what it held is replaced. Nulls, repeated rows
    and empty tables are as in packed_matrix (an empty table gives a folder without rows); other columns play no part."""
    packed_matrix(docs, path, **options).write.mode("overwrite").parquet(out)
