"""Byte-level BPE encoding and decoding by tiktoken and a local rank file (operator 6)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestone.llm.common import slices, texts

#: A blank between two letters or digits: every match that holds it starts with it, so a text can be cut in front of it.
_BOUNDARY = regex.compile(r"(?<=[\p{L}\p{N}]) (?=[\p{L}\p{N}])")
_loaded: dict = {}


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.decimal = {i: str(i) for i in ranks.values()}

    def encode(self, text: str, segment: int = 100_000) -> list[int]:
        """The ids of the whole text, in segments that end at safe boundaries."""
        if len(text) <= segment:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for part in segments(text, segment):
            ids += self.encoding.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def segments(text: str, segment: int) -> Iterator[str]:
    """Cuts at the first safe boundary past each segment's length; a stretch without one stays whole."""
    start = 0
    while len(text) - start > segment:
        found = _BOUNDARY.search(text, start + segment)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def load(path: str, pattern: str) -> ByteBPE:
    """One vocabulary for each worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(path, pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, emit_ids: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a blank), decoded_sha256 (of
    the bytes that the ids decode to), round_trip (they are the text's); with emit_ids also ids and decoded.

    Null text counts as empty: no ids, digests of nothing. A null doc_id stays null; repeated rows give repeated rows; an
    empty table gives none; other columns, whatever their names, play no part. A text of any length is cut at safe
    boundaries, and its digests are of the whole. No special tokens: their strings are ordinary text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text)
                decoded = bpe.decode(ids)
                rows.append((len(ids), hashlib.sha256(" ".join([bpe.decimal[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest(), decoded == text.encode(), *((ids, decoded) if emit_ids else ())))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.binary()][: 4 + 2 * emit_ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "ids", "decoded"][: 1 + len(kinds)])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>, decoded binary" * emit_ids)
