"""Signals, the weighted rank and the token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.schema import Options


def recency(candidates: DataFrame, modified: Column, by: str | None = None) -> DataFrame:
    """Age within the candidates, 0 newest to 1 oldest; a missing time counts as the oldest, equal times give 0, and no
    time at all gives null. Only positive times set the range."""
    known = F.when(modified > 0, modified)
    if by is None:  # one row of bounds, summed where the rows are
        bounds = F.broadcast(candidates.agg(F.min(known).alias("_low"), F.max(known).alias("_high")))
        joined = candidates.join(bounds)
    else:
        bounds = candidates.groupBy(by).agg(F.min(known).alias("_low"), F.max(known).alias("_high"))
        joined = candidates.join(bounds, F.col(by).eqNullSafe(bounds[by])).drop(bounds[by])
    low, high = F.col("_low"), F.col("_high")
    span = F.when(high == low, F.lit(1.0)).otherwise((high - low).cast("double"))
    return joined.withColumn("recency", (high - F.coalesce(modified, low)).cast("double") / span).drop("_low", "_high")


def final_score(semantic: Column, distance: Column, age: Column, coedit: Column, options: Options = Options()) -> Column:
    w = options.weights
    near = F.lit(1.0) - F.coalesce(distance, F.lit(0.5))
    fresh = F.lit(1.0) - F.coalesce(age, F.lit(0.5))
    return X.round4(F.lit(w["semantic"]) * semantic + F.lit(w["graph"]) * near + F.lit(w["recency"]) * fresh + F.lit(w["coedit"]) * F.coalesce(coedit, F.lit(0.0)))


def final_rank(candidates: DataFrame, options: Options = Options()) -> DataFrame:
    """Ranks few candidates (score, graph_distance, recency, coedit, and rank by meaning) by the weighted score."""
    scored = candidates.withColumn("final_score", final_score(F.col("score"), F.col("graph_distance"), F.col("recency"), F.col("coedit"), options))
    return scored.withColumn("final_rank", F.row_number().over(Window.orderBy(F.desc("final_score"), F.asc("rank"), F.asc("chunk_id"))))


def budget_prefix(ranked: DataFrame, tokens: Column, budget: int, order: str = "final_rank") -> DataFrame:
    """The ranked rows up to the first that overflows the budget; smaller ones after it don't come in."""
    running = F.sum(tokens.cast("long")).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("running_tokens", running).filter(F.col("running_tokens") <= budget)


def assembled(prefix: DataFrame, part: Column, tokens: Column, order: str = "final_rank") -> DataFrame:
    """One row: the parts in rank order with a blank line between, their tokens and number."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), part.alias("part"))))
    return prefix.agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").alias("context"), F.coalesce(F.sum(tokens.cast("long")), F.lit(0)).cast("long").alias("token_count"), F.count("*").alias("n_sources"))
