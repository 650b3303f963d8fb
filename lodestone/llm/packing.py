"""Cost-balanced packing of token ids into sequences (operator 4)."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestone.llm import word_bpe
from lodestone.llm.common import Scratch, slices, texts

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"


def capacities(total: int, capacity: int) -> list[int]:
    """Full sequences, then the rest as descending powers of two, which need no padding."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def balance(lengths: list[int], capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray, np.ndarray]:
    """Places documents of these lengths: (document, start, length, sequence, offset) of each piece, the tokens and the
    cost of each sequence.

    A piece of n tokens costs linear * n + quadratic * n * n, as attention stays within a piece. Pieces go by descending
    length to the sequence of the lowest cost that has room for them whole; if none has, the sequence of the lowest cost
    with any room takes what fits, and the remainder waits for its turn by its new length. As the capacities sum to the
    tokens, every sequence ends full. Ties go to the earlier document and the earlier sequence."""
    room = np.array(capacities(sum(lengths), capacity), dtype=np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    queue = [(-min(capacity, n - s), d, s) for d, n in enumerate(lengths) for s in range(0, n, capacity)]
    heapq.heapify(queue)
    pieces = []
    while queue:
        n, doc, start = heapq.heappop(queue)
        n = -n
        fits = room >= n
        if not fits.any():
            fits = room > 0
        at = int(np.where(fits, cost, np.inf).argmin())
        take = min(n, int(room[at]))
        pieces.append((doc, start, take, at, int(size[at] - room[at])))
        room[at] -= take
        cost[at] += linear * take + quadratic * take * take
        if take < n:
            heapq.heappush(queue, (take - n, doc, start + take))
    return pieces, size, cost


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, block_tokens: int = 1 << 20, linear: float = 1.0, quadratic: float = 1 / 2048, emit_ids: bool = False) -> DataFrame:
    """One row for each piece of a document, by the vocabulary file at path.

    Null text counts as empty, and a document without text is its end id alone; a null doc_id stays null. Repeated rows
    are documents of their own. An empty table gives no rows. Documents are packed in blocks of about block_tokens tokens
    where they are read, without a shuffle: a task holds one block (or one longer document) at a time. Sequence ids are
    distinct over all tasks and the same when a task is run again. Other columns, whatever their names, play no part. With emit_ids, a column ids holds each piece's ids as
    little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = word_bpe.load(path)
        sequence = TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        keys: list = []
        held = 0
        end = np.array([end_id], dtype=np.uint32)

        def packed() -> pa.RecordBatch:
            pieces, size, cost = balance([len(x) for x in ids], capacity, linear, quadratic)
            rows = [ids[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in pieces]
            column = lambda f: [f(p) for p in pieces]
            data = [
                pa.array(column(lambda p: keys[p[0]]), pa.int64()), pa.array(column(lambda p: p[1]), pa.int64()), pa.array(column(lambda p: p[2]), pa.int64()), pa.array([zlib.crc32(r) for r in rows], pa.int64()),
                pa.array(column(lambda p: len(ids[p[0]])), pa.int64()), pa.array(column(lambda p: sequence + p[3]), pa.int64()), pa.array(column(lambda p: p[4]), pa.int64()),
                pa.array(column(lambda p: int(size[p[3]])), pa.int64()), pa.array(column(lambda p: float(cost[p[3]])), pa.float64()),
            ]
            names = [c.split()[0] for c in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays(data + [pa.array(rows, pa.binary())] * emit_ids, names + ["ids"] * emit_ids)

        for batch in slices(batches):
            for key, x in zip(batch.column(0).to_pylist(), vocabulary.encode(batch.column(1).to_pylist())):
                keys.append(key)
                ids.append(np.concatenate([x, end]))
                held += len(x) + 1
                if held >= block_tokens:
                    out = packed()
                    sequence += len(capacities(held, capacity))
                    ids, keys, held = [], [], 0
                    yield out
        if keys:
            yield packed()

    return Scratch(docs.sparkSession, "packed").keep(texts(docs).mapInArrow(run, PIECES + ", ids binary" * emit_ids), "pieces")
