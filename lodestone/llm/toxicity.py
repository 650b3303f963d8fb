"""Toxicity by class-conditional Kneser-Ney models (operator 5).

Expressions are words spelled in bytes: each byte is predicted from the bytes before it in its word, by one interpolated
Kneser-Ney model of the toxic documents and one of the ordinary ones. Grams don't cross words, so that each distinct word is
scored once; an expression of several words counts by its words. Both models back off to shared counts, which cover all
documents, labelled or not, so an expression that neither class has seen often weighs the same in both. A document's
log-likelihoods under the two models are compared per word, and a logistic curve over that difference, fitted on labelled
rows that the counts leave out, gives the score."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import CHUNK, Scratch, packed_chunks, parted, release, slices, summed, texts, words_of

DISCOUNT = 0.75
#: The model learns from about this many labelled rows of each class at most; the share of rows is set by their number.
MAX_TRAIN_DOCS = 20_000
ORDER = 5
#: A word's log-likelihoods differ by more than this where it is clearly of one class.
CLEAR = 2.0
#: Lengths in words of the stretches whose best is told apart from the rest of the text.
WINDOWS = (1, 4, 16)
FEATURES = 5 + len(WINDOWS)
#: Words whose weight a task remembers.
KNOWN_WORDS = 200_000
#: Distinct words that a task counts before it adds them up by grams.
COUNTED_WORDS = 100_000
FOLDS = 5
_LENGTH = 40  # a gram's number: its length above this bit, its bytes below, the last byte lowest


def _positions(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each predicted byte of the words, blanks at both ends; the word of each."""
    data = np.frombuffer(b"".join([b" " + w + b" " for w in words]), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    gram, size = data.copy(), np.ones(len(data), dtype=np.int64)
    for n in range(1, order):
        ok = np.flatnonzero(place >= n)
        gram[ok] |= data[ok - n] << (8 * n)
        size[ok] += 1
    own = place > 0
    return (gram | size << _LENGTH)[own], word[own]


def _context(gram: np.ndarray) -> np.ndarray:
    size, own = gram >> _LENGTH, gram & ((1 << _LENGTH) - 1)
    return own >> 8 | (size - 1) << _LENGTH


def _suffix(gram: np.ndarray) -> np.ndarray:
    size, own = gram >> _LENGTH, gram & ((1 << _LENGTH) - 1)
    return own & ((np.int64(1) << (8 * (size - 1))) - 1) | (size - 1) << _LENGTH


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted numbers among sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return i, keys[i] == wanted


def _best(each: np.ndarray, length: int) -> float:
    """The highest mean of as many values in a row, or of all if there are fewer."""
    if not len(each):
        return 0.0
    length = min(length, len(each))
    total = np.r_[0.0, np.cumsum(each)]
    return float((total[length:] - total[:-length]).max() / length)


@dataclass
class Model:
    order: int
    grams: np.ndarray  # sorted
    ratio: np.ndarray  # of each gram, toxic to ordinary, as a logarithm
    contexts: np.ndarray  # sorted; those that both classes know
    backoff: np.ndarray  # of each context, the ratio for a byte that never followed it
    weights: np.ndarray  # of the features, the last for a constant

    def of_grams(self, gram: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(gram)), np.arange(len(gram))
        for _ in range(self.order):
            i, known = _at(self.grams, gram)
            out[open_[known]] = self.ratio[i[known]]
            gram, open_ = gram[~known], open_[~known]
            j, known = _at(self.contexts, _context(gram))
            out[open_[known]] = self.backoff[j[known]]
            gram, open_ = _suffix(gram[~known]), open_[~known]
            if not len(gram):
                break
        return out

    def of_words(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        gram, word = _positions(words, self.order)
        distinct, back = np.unique(gram, return_inverse=True)
        return np.bincount(word, weights=self.of_grams(distinct)[back], minlength=len(words))

    def features(self, texts_: list[str], known: dict[bytes, float]) -> np.ndarray:
        """Per document: the difference of the log-likelihoods over the words and over their number's root; the same of what
        single words give beyond CLEAR, and the mean over the best stretch of some lengths, as a few expressions among many plain
        words make a text toxic; a constant."""
        split = [words_of(t) for t in texts_]
        new = list({w for s in split for w in s if w not in known})
        known.update(zip(new, self.of_words(new).tolist()))
        rows = []
        for s in split:
            each, n = np.array([known[w] for w in s], dtype=np.float64), max(1, len(s))
            total, clear = each.sum(), np.maximum(each - CLEAR, 0).sum()
            rows.append((total / n, total / n**0.5, clear / n, clear / n**0.5, *(_best(each, k) for k in WINDOWS), 1.0))
        return np.array(rows).reshape(-1, FEATURES)

    def score(self, features: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -30, 30)))


def kneser_ney(grams: np.ndarray, counts: np.ndarray, order: int) -> Model:
    """grams: distinct gram numbers of the top order or from a word's start; counts: their occurrences in ordinary, in toxic
    and in all documents.

    A shorter gram counts the distinct longer ones of the class that end with it, as is usual for these models."""
    pooled = counts.astype(np.float64)
    levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in range(order, 0, -1):
        own = grams >> _LENGTH == n
        key, value = grams[own], pooled[own]
        if n < order:
            longer, their = levels[n + 1]
            key, value = np.concatenate([key, _suffix(longer)]), np.concatenate([value, (their > 0).astype(np.float64)])
        key, back = np.unique(key, return_inverse=True)
        levels[n] = key, np.column_stack([np.bincount(back, weights=value[:, c], minlength=len(key)) for c in range(3)])
    all_grams, ratios, contexts, backoffs = [], [], [], []
    shorter_key, shorter = np.array([0], dtype=np.int64), np.full((1, 3), 1 / 257)
    for n in range(1, order + 1):
        key, value = levels[n]
        if not len(key):
            continue
        context, back = np.unique(_context(key), return_inverse=True)
        total = np.column_stack([np.bincount(back, weights=value[:, c], minlength=len(context)) for c in range(3)])
        kinds = np.column_stack([np.bincount(back, weights=value[:, c] > 0, minlength=len(context)) for c in range(3)])
        below = shorter[_at(shorter_key, _suffix(key) if n > 1 else np.zeros(len(key), dtype=np.int64))[0]]
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(total > 0, DISCOUNT * kinds / total, 1.0)
            p = np.where(total[back] > 0, np.maximum(value - DISCOUNT, 0) / total[back] + left[back] * below[:, [2, 2, 2]], below)
        both = (total[:, 0] > 0) & (total[:, 1] > 0)
        all_grams.append(key)
        ratios.append(np.log(p[:, 1] / p[:, 0]))
        contexts.append(context[both])
        backoffs.append(np.log(left[both, 1] / left[both, 0]))
        shorter_key, shorter = key, p
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    g, r, c, b = joined(all_grams, np.int64), joined(ratios, np.float64), joined(contexts, np.int64), joined(backoffs, np.float64)
    return Model(order, np.sort(g), r[np.argsort(g)], np.sort(c), b[np.argsort(c)], np.zeros(FEATURES))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights by Newton's method; of no use, and so a constant, where one class is absent."""
    scale = np.maximum(np.abs(x).mean(axis=0), 1e-9) if len(x) else np.ones(FEATURES)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)) * max(1, len(z)) / 100, z.T @ (y - p) - ridge * w * max(1, len(z)) / 100)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def count_grams(texts_: list[str], toxic: list[int], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and their occurrences in ordinary and toxic texts."""
    keys, sums = [], []
    for c in (0, 1):
        number: dict[bytes, int] = {}
        for t, label in zip(texts_, toxic):
            if label == c:
                for w in words_of(t):
                    number[w] = number.get(w, 0) + 1
        if number:
            gram, word = _positions(list(number), order)
            key, back = np.unique(gram, return_inverse=True)
            n = np.bincount(back, weights=np.fromiter(number.values(), dtype=np.float64, count=len(number))[word]).astype(np.int64)
            keys.append(key)
            sums.append(np.column_stack([n * (c == 0), n * (c == 1)]))
    if not keys:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.int64)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    both = np.concatenate(sums)
    return key, np.column_stack([np.bincount(back, weights=both[:, c], minlength=len(key)) for c in (0, 1)]).astype(np.int64)


def corpus_counts(docs: DataFrame, grams: np.ndarray, order: int) -> np.ndarray:
    """How often the words of all documents have each of the sorted grams. A task adds up its words by grams and sends one
    packed array of counters."""
    size = -(-max(1, len(grams)) // CHUNK) * CHUNK
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, number = np.zeros(size, dtype=np.int64), Counter()

        def add() -> None:
            gram, word = _positions(list(number), order)
            at, known = _at(shared.value, gram)
            times = np.fromiter(number.values(), dtype=np.float64, count=len(number))[word]
            counts[:] += np.bincount(at[known], weights=times[known], minlength=size).astype(np.int64)
            number.clear()

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                number.update(words_of(text))
                if len(number) > COUNTED_WORDS:
                    add()
        if number:
            add()
        chunks, blobs = packed_chunks(counts)
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "counts"])
        release()

    out = summed(texts(docs).select("text").mapInArrow(run, "chunk int, counts binary"), size)[: len(grams)]
    shared.destroy()
    return out


def fold(key) -> F.Column:
    """0 for rows that are held out, 1 for those that set the curve, the rest for those that are counted."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(FOLDS)).cast("int")


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, order: int = ORDER) -> Model:
    """Learns from labelled rows that are not held out. Rows of a label are taken by a hash of doc_id, all of them up to
    max_docs and an even share beyond; their grams are counted where the rows are and summed over the cluster, and only
    the distinct grams of that bounded sample come to the driver. How often all documents have these grams, which the
    models share, is counted in one more pass over all texts.

    Where no label is usable, or labels are of one class, nothing is learned and every score is 0."""
    spark = docs.sparkSession
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold(F.col("doc_id"))).filter("fold <> 0")
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(order, *(np.zeros(0, dtype=k) for k in (np.int64, np.float64, np.int64, np.float64)), np.zeros(FEATURES))
    share = F.lit(1.0)
    for label, n in sizes.items():
        share = F.when(F.col("toxic") == label, F.lit(min(1.0, max_docs / n))).otherwise(share)
    marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    scratch = Scratch(spark, "toxicity")
    # About 2 * max_docs pairs of numbers at most, whatever the labels: they go to the texts, not the texts to them.
    sample = scratch.keep(texts(docs).join(F.broadcast(marked), "doc_id").select("doc_id", "text", "toxic", "fold"), "sample")

    def counted(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, n = count_grams(batch.column(1).to_pylist(), batch.column(2).to_pylist(), order)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n[:, 0]), pa.array(n[:, 1])], ["gram", "ordinary", "toxic"])

    grams = sample.filter("fold <> 1").select("doc_id", "text", "toxic").mapInArrow(lambda b: counted(b, order), "gram long, ordinary long, toxic long")
    found = scratch.keep(grams.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "grams").toArrow().sort_by("gram")
    key = found.column("gram").to_numpy()
    own = np.column_stack([found.column("ordinary").to_numpy(), found.column("toxic").to_numpy()])
    everywhere = np.maximum(corpus_counts(docs, key, order), own.sum(axis=1))
    model = kneser_ney(key, np.column_stack([own, everywhere]), order)

    shared = spark.sparkContext.broadcast(model)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = shared.value.features(batch.column(0).to_pylist(), {})
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(FEATURES - 1)), batch.column(1)], [*(f"f{i}" for i in range(FEATURES - 1)), "toxic"])

    curve = sample.filter("fold = 1").select("text", "toxic").mapInArrow(described, "".join(f"f{i} double, " for i in range(FEATURES - 1)) + "toxic int").toArrow()
    x = np.column_stack([*(curve.column(i).to_numpy() for i in range(FEATURES - 1)), np.ones(len(curve))])
    model.weights = logistic(x, curve.column("toxic").to_numpy().astype(np.float64))
    shared.destroy()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted, n_words.

    Null text counts as empty; a text without words gets the curve's constant; a text of any length is scored whole. A null
    doc_id stays null (its fold is that of the empty string), repeated rows get the same score, an empty table gives no
    rows, other columns of any names play no part. Only the text enters the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in slices(batches):
            if len(known) > KNOWN_WORDS:
                known.clear()
            text = batch.column(2).to_pylist()
            s = shared.value.score(shared.value.features(text, known))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = texts(docs).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    return score(docs, train(docs, labels, max_docs))


def reject_toxic(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't take for toxic. Texts are scored where they are read;
    what moves are the 64-bit hashes of the rejected ones, and the rows that may have them.

    A null text counts as empty; rows with a null doc_id and repeated rows are judged by their text like others; where
    labels teach nothing all rows stay; an empty table stays empty; columns of any names pass."""
    model = train(docs, labels, max_docs)
    if not len(model.grams):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in slices(batches):
            if len(known) > KNOWN_WORDS:
                known.clear()
            s = shared.value.score(shared.value.features(batch.column(1).to_pylist(), known))
            yield batch.select(["_rejected"]).filter(pa.array(s >= 0.5))

    row = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(row.alias("_rejected"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gone = Scratch(docs.sparkSession, "rejected").keep(rows.mapInArrow(run, "_rejected long").distinct(), "rows")
    shared.destroy()
    sure, open_ = parted(docs, row, gone, "_rejected")
    return sure.unionByName(open_.join(gone, row == F.col("_rejected"), "left_anti"))
