"""Quality rules as a bitmask ledger (operator 9): every rule is evaluated once, policies are masks over its bits."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices, texts, window_hashes, word_hashes

SYMBOLS = "#*$%&|<>"
MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: Rules by bit. The first two are the base rules; a document without words fails by too_few_words alone.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A version of what counts: the rules by name."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", 1, ("too_few_words", "repeated_windows"))
DEFAULT = Policy("web", 1, tuple(RULES))


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of so many words which the text holds twice or more, the first one included."""
    if len(words) <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(number) == len(words):
        return 0
    hashes = window_hashes(word_hashes(words), width)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    if new.all():
        return 0
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    windows = np.lib.stride_tricks.sliding_window_view(ids, width)
    same = ~new
    exact = (windows[order[same]] == windows[first[same]]).all(axis=1)
    if exact.all():
        starts = np.concatenate([order[same], first[same]])
    else:  # two windows share a hash
        counted = Counter(map(bytes, windows))
        starts = np.array([i for i, w in enumerate(windows) if counted[bytes(w)] > 1], dtype=np.int64)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.unique(starts)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return (
        len(words), len(text) - sum(text.count(c) for c in " \t\n\r\x0b\x0c"), sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)), repeat_words(words), len(lines),
    )


def measurements(docs: DataFrame) -> DataFrame:
    """One row of measurements for each document; null text has no words. A text is read once, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [measure(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(6))], [c.split()[0] for c in MEASURES.split(", ")])

    return texts(docs).mapInArrow(run, MEASURES)


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and fail_bits, where bit i is set if the document fails rule i of RULES.

    Null and empty texts measure 0 everywhere and fail too_few_words; a null doc_id stays null; repeated rows stay
    repeated; an empty table gives no rows; other columns of docs play no part."""
    bits: Column = F.lit(0).cast("long")
    for i, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measurements(docs).withColumn("fail_bits", bits)


def apply_policy(entries: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """base_failed, kept and the policy's version, from the stored bits alone. Rows with null bits get null verdicts; repeated
    rows stay; an empty ledger gives no rows; columns of these three names are replaced."""
    fails = lambda p: F.col("fail_bits").bitwiseAND(F.lit(p.mask).cast("long")) != 0
    return entries.withColumns({"base_failed": fails(BASE), "kept": ~fails(BASE) & ~fails(policy), "policy": F.lit(f"{policy.name}/{policy.version}")})


def ablations(entries: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone (kept if it went), and that the policy
    keeps. Entries are first counted by their bits, so that few rows remain whatever the input. Null bits fail nothing and
    count nowhere; repeated rows count each; an empty ledger gives no rows; other columns play no part."""
    counted = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in policy.rules))).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))
    return counted.select("bits", "n", rules).groupBy(F.col("r.rule").alias("rule")).agg(total(hit).alias("n_failed"), total(F.col("bits") == F.col("r.bit")).alias("n_failed_alone"), total(F.col("bits") == 0).alias("n_kept"))


def write_ledger(docs: DataFrame, path: str) -> DataFrame:
    """Writes the ledger as a table in a folder that all executors share, and reads it: policies and ablations of any version
    then need no text. Rows are as in ledger(); what the folder held is replaced."""
    ledger(docs).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)
