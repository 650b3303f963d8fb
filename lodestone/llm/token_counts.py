"""Edit-aware token counts (operator 2): a document's pre-token segments in a tree of sums; an edit re-encodes only the
segments that it touches and their boundary context."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe
from lodestone.llm.common import slices, texts

SEGMENT = 512
#: A boundary depends on the character before it and the two after it.
CONTEXT = 2
EDITS = "array<struct<position:long,n_deleted:long,inserted:string>>"
COUNTS = "doc_id long, n_tokens_before long, n_tokens long, n_chars long, n_segments long, n_edits long, reencoded_chars long"


@dataclass(slots=True)
class Node:
    """A segment with its text, or two subtrees; chars, tokens and leaves are sums over the subtree, height is its levels."""

    chars: int
    tokens: int
    leaves: int
    height: int = 1
    text: str | None = None
    left: Node | None = None
    right: Node | None = None


def _over(left: Node | None, right: Node | None) -> Node | None:
    if left is None or right is None:
        return left or right
    return Node(left.chars + right.chars, left.tokens + right.tokens, left.leaves + right.leaves, 1 + max(left.height, right.height), None, left, right)


def _balanced(leaves: list[Node]) -> Node | None:
    if len(leaves) <= 1:
        return leaves[0] if leaves else None
    half = len(leaves) // 2
    return _over(_balanced(leaves[:half]), _balanced(leaves[half:]))


def _leaves(node: Node | None) -> Iterator[Node]:
    stack = [node] if node else []
    while stack:
        n = stack.pop()
        if n.text is not None:
            yield n
        else:
            stack += [n.right, n.left]


class EditableCount:
    """The token count of a text that changes. Segments end at safe boundaries, so that their counts add up."""

    def __init__(self, text: str, bpe: byte_bpe.ByteBPE, segment: int = SEGMENT):
        self.bpe, self.segment, self.reencoded = bpe, segment, 0
        self.root = _balanced(self._encoded(text))
        self.reencoded = 0

    def _encoded(self, text: str) -> list[Node]:
        self.reencoded += len(text)
        return [Node(len(s), len(self.bpe.encode(s)), 1, 1, s) for s in byte_bpe.segments(text, self.segment) if s]

    @property
    def tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def chars(self) -> int:
        return self.root.chars if self.root else 0

    def text(self) -> str:
        return "".join(n.text for n in _leaves(self.root))

    def edit(self, position: int, n_deleted: int, inserted: str) -> None:
        """Replaces n_deleted characters at position by inserted; both are kept within the text."""
        start = min(max(0, position), self.chars)
        stop = min(max(start, start + n_deleted), self.chars)
        before, touched, after = self._split(self.root, start - CONTEXT, stop + CONTEXT, 0)
        origin = before.chars if before else 0
        old = "".join(n.text for n in _leaves(touched))
        new = old[: start - origin] + (inserted or "") + old[stop - origin :]
        root = _over(_over(before, _balanced(self._encoded(new))), after)
        if root is not None and root.height > 3 * root.leaves.bit_length() + 8:  # seldom: edits are many by then
            root = _balanced(list(_leaves(root)))
        self.root = root

    def _split(self, node: Node | None, start: int, stop: int, at: int) -> tuple[Node | None, Node | None, Node | None]:
        """The subtrees wholly before start, those that touch [start, stop], those wholly after."""
        if node is None or at > stop:
            return None, None, node
        if at + node.chars < start:
            return node, None, None
        if node.text is not None:
            return None, node, None
        a, b, c = self._split(node.left, start, stop, at)
        d, e, f = self._split(node.right, start, stop, at + node.left.chars)
        return _over(a, d), _over(b, e), _over(c, f)


def counts_after_edits(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """rows: doc_id, text and edits, an array of (position, n_deleted, inserted) in code points, applied in order.

    One row for each document: its tokens before and after, characters and segments after, and how many characters had to
    be encoded again. Null text counts as empty, null edits as none, nulls in an edit as 0 or nothing; positions past the
    end append. A null doc_id stays null, repeated rows stay repeated, an empty table gives no rows, other columns of any
    names play no part. A text of any length is one tree in the memory of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(path, pattern)
        for batch in slices(batches):
            out = []
            for text, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                counted = EditableCount(text, bpe)
                before = counted.tokens
                for e in edits or []:
                    if e is not None:
                        counted.edit(e["position"] or 0, e["n_deleted"] or 0, e["inserted"] or "")
                out.append((before, counted.tokens, counted.chars, counted.root.leaves if counted.root else 0, len(edits or []), counted.reencoded))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], pa.int64()) for i in range(6))], [c.split()[0] for c in COUNTS.split(", ")])

    chosen = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("edits").cast(EDITS).alias("edits"))
    return chosen.mapInArrow(run, COUNTS)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Brings a table of edits (doc_id, seq, position, n_deleted, inserted) to its documents, in the order of seq, edits of
    one seq by position. Documents without edits get null; rows that repeat a document get the same edits each; edits of a
    null or unknown doc_id go; nulls in an edit stay; an empty table of either gives no rows or no edits; other columns
    play no part."""
    each = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "position", "n_deleted", "inserted"))).alias("found"))
    joined = texts(docs).join(each, "doc_id", "left")
    return joined.select("doc_id", "text", F.transform("found", lambda e: F.struct(e["position"].cast("long").alias("position"), e["n_deleted"].cast("long").alias("n_deleted"), e["inserted"].cast("string").alias("inserted"))).alias("edits"))


def with_revision(docs: DataFrame) -> DataFrame:
    """A fixed revision of every document, by its length: a word goes in at a quarter, twelve characters go at the middle,
    eight are replaced at three quarters, and a sentence is added. A null text counts as empty and gets the insertions;
    repeated rows, null ids and an empty table stay as they are; other columns play no part."""
    n = F.char_length("text").cast("long")
    at = lambda quarter: F.floor(n * quarter / 4).cast("long")
    edit = lambda position, deleted, inserted: F.struct(position.alias("position"), F.lit(deleted).cast("long").alias("n_deleted"), F.lit(inserted).alias("inserted"))
    return texts(docs).withColumn("edits", F.array(edit(at(1), 0, " revised"), edit(at(2), 12, ""), edit(at(3), 8, "new words"), edit(n * 2 + 100, 0, " One more sentence.")))
