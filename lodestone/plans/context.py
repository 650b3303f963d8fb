"""Ranked context under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import coedit, graph, rank, vector
from lodestone.schema import Options
from lodestone.sources.scratch import Scratch

OPTIONS = Options()


def search(candidates: DataFrame, query: list[float], k: int = OPTIONS.k, chunk_type: str | None = None) -> DataFrame:
    """The k chunks nearest to the query vector, with what they carry."""
    return vector.topk(candidates, query, k, chunk_type)


def search_memories(memories: DataFrame, query: list[float], k: int = OPTIONS.memory_candidates) -> DataFrame:
    """The k memories nearest to the query vector, newer ones first among equals."""
    scored = vector.cosine_scores(memories, query).drop("embedding").filter("score IS NOT NULL")
    return vector.top(scored, k, [F.desc("score"), F.desc("created_at"), F.asc("memory_id")])


def anchor(candidates: DataFrame, active_file: str) -> DataFrame:
    """One row: the first ranked candidate of the active file."""
    active = active_file.replace("\\", "/")
    return candidates.filter((F.col("path") == active) | F.endswith(F.col("path"), F.lit("/" + active))).agg(F.min_by("chunk_id", "rank").alias("node")).filter("node IS NOT NULL")


def ranked(candidates: DataFrame, query: list[float], edges: DataFrame | None = None, counts: DataFrame | None = None, active_file: str | None = None, modified: Column | None = None, options: Options = OPTIONS) -> DataFrame:
    """The best code candidates by meaning, with age, graph distance and co-edits where they are known, in their final
    order. The first cut reads the candidates once and is kept: code_candidates rows, which the rest works on."""
    found = Scratch(candidates.sparkSession, "ranked").keep(search(candidates, query, options.code_candidates), "top")
    if modified is not None:
        path = Window.partitionBy("path")
        found = found.withColumn("_modified", F.max_by(modified, F.when(modified.isNotNull() & (modified != 0), F.col("rank"))).over(path))
        found = rank.recency(found, F.col("_modified")).drop("_modified")
    else:
        found = found.withColumn("recency", F.lit(None).cast("double"))
    distance, together = F.lit(None).cast("double"), F.lit(None).cast("double")
    if active_file is not None and edges is not None:
        first = anchor(found, active_file)
        near = graph.distances(edges, first, found.select(F.col("chunk_id").alias("node")))
        near = near.crossJoin(F.broadcast(first.agg(F.count("*").alias("_anchors")))).filter("_anchors > 0")
        found = found.join(near.select(F.col("node").alias("chunk_id"), F.col("distance").alias("_distance")), "chunk_id", "left")
        distance = F.col("_distance")
    if active_file is not None and counts is not None:
        shared = coedit.scores(counts, active_file.replace("\\", "/"), found.select("path"))
        found = found.join(shared.withColumnRenamed("score", "_coedit"), "path", "left")
        together = F.col("_coedit")
    return rank.final_rank(found.withColumn("graph_distance", distance).withColumn("coedit", together).drop("_distance", "_coedit"), options)


def sources(ranking: DataFrame, token_budget: int = OPTIONS.token_budget) -> DataFrame:
    """The ranked rows that fit the budget, with their line range and running tokens."""
    tokens = X.token_estimate(F.coalesce("content", F.lit("")))
    return rank.budget_prefix(ranking.withColumn("tokens", tokens).withColumn("lines", X.line_range(F.col("start_line"), F.col("end_line"))), F.col("tokens"), token_budget)


def assembled(fitting: DataFrame) -> DataFrame:
    part = X.source_header(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("name"), F.coalesce("content", F.lit("")))
    return rank.assembled(fitting, part, F.col("tokens"))


def query_context_json(fitting: DataFrame, memories: DataFrame) -> DataFrame:
    """One row with one JSON text: context, sources, memories, token_count."""
    listed = F.sort_array(F.collect_list(F.struct("final_rank", "path", "name", "lines", "final_score")))
    found = F.transform(listed, lambda s: F.struct(s["path"].alias("path"), s["name"].alias("name"), s["lines"].alias("lines"), s["final_score"].alias("score")))
    noted = F.sort_array(F.collect_list(F.struct("rank", "memory_id", "memory_type", "content", "score", "created_at")))
    notes = memories.agg(F.transform(noted, lambda m: F.struct(m["memory_id"].alias("id"), m["memory_type"].alias("memory_type"), m["content"].alias("content"), m["score"].alias("score"), m["created_at"].alias("created_at"))).alias("memories"))
    rows = assembled(fitting).crossJoin(fitting.agg(found.alias("sources"))).crossJoin(notes)
    message = F.when(F.col("n_sources") == 0, F.lit("No source fits or the index is empty."))
    return rows.select(F.to_json(F.struct("context", "sources", "memories", "token_count", message.alias("message"))).alias("json"))


def project_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files and chunks of each project; counted apart, then joined by project."""
    n_files = files.groupBy("project_id").agg(F.count("*").alias("n_files"))
    n_chunks = chunks.join(files.select("file_id", "project_id"), "file_id").groupBy("project_id").agg(F.count("*").alias("n_chunks"))
    return n_files.join(n_chunks, "project_id", "left").select("project_id", "n_files", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))


def status(projects: DataFrame, project_id: str, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row, even for a project that isn't known: whether it was indexed, its files and chunks."""
    own = files.filter(F.col("project_id") == project_id)
    n_files, n_chunks = own.agg(F.count("*").alias("n_files")), chunks.join(own.select("file_id"), "file_id").agg(F.count("*").alias("n_chunks"))
    known = projects.filter(F.col("project_id") == project_id).agg(F.coalesce(F.max(F.col("indexed_at").isNotNull()), F.lit(False)).alias("indexed"))
    return known.crossJoin(n_files).crossJoin(n_chunks).select(F.lit(project_id).alias("project_id"), "indexed", "n_files", "n_chunks")


def list_memories(memories: DataFrame, project_id: str) -> DataFrame:
    """Newest first, expired ones too."""
    return memories.filter(F.col("project_id") == project_id).orderBy(F.desc("created_at"), F.asc("memory_id"))
