"""Ranking by vectors."""

from __future__ import annotations

from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.functions import text as X
from lodestone.functions import vector as V
from lodestone.sources.scratch import Scratch


def of_type(candidates: DataFrame, chunk_type: str | None) -> DataFrame:
    """None and 'any' mean every type. The filter comes before any scoring."""
    return candidates if chunk_type in (None, "any") else candidates.filter(F.col("chunk_type") == chunk_type)


# One rule for vectors that don't fit, everywhere: a null vector, or one with a null in it, takes no part; of vectors of
# different lengths the shorter counts as filled with zeros.


def cosine_scores(candidates: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    return candidates.withColumn("score", V.cosine_to(F.col(column), query))


def top(scored: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k with their rank. The limit runs in every task first, so one task ranks k rows of each at most."""
    first = scored.orderBy(*order).limit(schema.checked_k(k))
    from pyspark.sql import Window

    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def topk(candidates: DataFrame, query: list[float], k: int = 10, chunk_type: str | None = None, key: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """By the unrounded cosine, ties by the key; without the vector."""
    scored = cosine_scores(of_type(candidates, chunk_type), query, column).drop(column).filter("score IS NOT NULL")
    return top(scored, k, [F.desc("score"), F.asc(key)])


def topk_v1(candidates: DataFrame, query: list[float], k: int = 10, chunk_type: str | None = None) -> DataFrame:
    """By the cosine to four places, as Python rounds."""
    scored = cosine_scores(of_type(candidates, chunk_type), query).drop("embedding").filter("score IS NOT NULL").withColumn("score", X.python_round4(F.col("score")))
    return top(scored, k, [F.desc("score"), F.asc("chunk_id")])


def inner_product_topk_v1(candidates: DataFrame, query: list[float], k: int = 10, chunk_type: str | None = None) -> DataFrame:
    """By the inner product of normalised 32-bit vectors, shown to four places. k is at most the number of candidates."""
    scored = of_type(candidates, chunk_type).withColumn("raw", V.inner_product_f32(query)(F.col("embedding"))).drop("embedding").filter("raw IS NOT NULL")
    return top(scored, k, [F.desc("raw"), F.asc("chunk_id")]).withColumn("score", X.python_round4(F.col("raw").cast("double"))).drop("raw")


def knn_join(queries: DataFrame, candidates: DataFrame, k: int, key: str = "chunk_id", column: str = "embedding", block: int = 10_000) -> DataFrame:
    """The k nearest candidates of each query (query_id, vector): a stated set of queries against all candidates.

    A block of queries goes to every task; each task scores its candidates by matrix products and keeps k of each query, so
    what is shuffled is tasks x queries x k rows and never all pairs. Any number of queries pass the driver in blocks, and
    where there are several, the result of each is written to the shared folder, so that one at a time is held and broadcast."""
    scratch, parts = Scratch(candidates.sparkSession, "knn"), []
    rows = queries.select("query_id", "vector").filter(F.col("vector").isNotNull()).toLocalIterator()
    held = list(islice(rows, block))
    while True:
        following = list(islice(rows, block))
        found = _nearest([r[0] for r in held], [r[1] for r in held], candidates, k, key, column)
        if not following and not parts:
            return found
        parts.append(scratch.keep(found, f"block{len(parts)}"))
        if not following:
            return reduce(DataFrame.unionByName, parts)
        held = following


#: Scores that a task holds at a time.
_SCORES = 1 << 22


def _first(score: np.ndarray, id_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row, of equal ones those of the least ids; only rows with a tie at the k-th value are sorted."""
    if not k:
        return score[:, :0], id_[:, :0]
    at = np.argpartition(-score, k - 1, axis=1)[:, :k]
    bound = np.take_along_axis(score, at, axis=1).min(axis=1)
    for i in np.flatnonzero((score >= bound[:, None]).sum(axis=1) > k):
        best = np.flatnonzero(score[i] >= bound[i])
        at[i] = best[np.lexsort((id_[i, best], -score[i, best]))[:k]]
    return np.take_along_axis(score, at, axis=1), np.take_along_axis(id_, at, axis=1)


def _nearest(names: list, vectors: list, candidates: DataFrame, k: int, key: str, column: str) -> DataFrame:
    q = V.matrix(vectors, 1)
    own = ~np.isnan(q).any(axis=1)
    names, q = [n for n, fine in zip(names, own) if fine], q[own]
    size = np.linalg.norm(q, axis=1, keepdims=True)
    shared = candidates.sparkSession.sparkContext.broadcast((names, q / np.where(size == 0, 1, size)))

    def best(batches):
        names, q = shared.value
        score, id_ = np.zeros((len(names), 0)), np.zeros((len(names), 0), dtype=np.int64)
        step = max(1, _SCORES // max(1, len(names)))
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step) if len(names)):
            m = V.matrix(batch.column(1).to_pylist(), q.shape[1])
            fine = ~np.isnan(m).any(axis=1)
            ids, m = np.array(batch.column(0))[fine], m[fine]
            norms = np.linalg.norm(m, axis=1)
            score = np.hstack([score, q @ (m / np.where(norms == 0, 1, norms)[:, None])[:, : q.shape[1]].T])
            id_ = np.hstack([id_, np.broadcast_to(ids, (len(names), len(ids)))])
            if score.shape[1] > k:
                score, id_ = _first(score, id_, k)
        n, width = score.shape
        if n * width:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, dtype=np.int64), width)), pa.array(id_.reshape(-1)), pa.array(score.reshape(-1))], ["query_id", key, "score"])

    partial = candidates.select(F.col(key).cast("long").alias(key), column).mapInArrow(best, f"query_id long, {key} long, score double")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key)))
    return partial.withColumn("rank", rank).filter(F.col("rank") <= k)
