"""Edges and traversals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as X
from lodestone.schema import checked_direction
from lodestone.sources.scratch import Scratch


def upserted(edges: DataFrame, version: str) -> DataFrame:
    """One row for each (from_id, to_id, edge_type), with the weight of the last version."""
    last = edges.groupBy("from_id", "to_id", "edge_type").agg(F.max_by("weight", F.col(version)).alias("weight"))
    return last.select(X.edge_id(F.col("from_id").cast("string"), F.col("to_id").cast("string"), F.col("edge_type")).alias("id"), "from_id", "to_id", "edge_type", "weight")


def collapsed(edges: DataFrame, priority: Column) -> DataFrame:
    """One edge for each pair, of the type that comes last by priority. Self edges go."""
    best = F.max_by(F.struct("edge_type", "weight"), priority)
    return edges.filter("from_id <> to_id").groupBy("from_id", "to_id").agg(best.alias("e")).select("from_id", "to_id", "e.edge_type", "e.weight")


def degrees(edges: DataFrame) -> DataFrame:
    """Successors and predecessors of each node."""
    out, in_ = edges.groupBy(F.col("from_id").alias("node")).agg(F.countDistinct("to_id").alias("n_out")), edges.groupBy(F.col("to_id").alias("node")).agg(F.countDistinct("from_id").alias("n_in"))
    return out.join(in_, "node", "full").select("node", F.coalesce("n_out", F.lit(0)).cast("long").alias("n_out"), F.coalesce("n_in", F.lit(0)).cast("long").alias("n_in"))


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    edges = edges.filter("from_id IS NOT NULL AND to_id IS NOT NULL")  # an end that isn't known leads nowhere
    forth, back = edges.select(F.col("from_id").alias("at"), F.col("to_id").alias("next")), edges.select(F.col("to_id").alias("at"), F.col("from_id").alias("next"))
    return {"outgoing": forth, "incoming": back, "both": forth.unionByName(back)}[checked_direction(direction)].distinct()


#: A graph of this many edges at most is walked by one task.
SMALL = 500_000


def _walked(steps: DataFrame, roots: DataFrame, depth: int | None) -> DataFrame:
    """The traversal of a small graph in one task, over arrays of its distinct steps."""
    nothing = F.lit(None).cast(steps.schema["at"].dataType)
    rows = steps.select("at", "next", F.lit(False).alias("root")).unionByName(roots.filter("node IS NOT NULL").select(nothing.alias("at"), F.col("node").alias("next"), F.lit(True).alias("root")))

    def run(batches):
        found = [[np.asarray(b.column(i).to_pylist(), dtype=object) for i in range(3)] for b in batches]
        if not found:
            return
        at, next_, root = (np.concatenate(x) for x in zip(*found))
        start = root.astype(bool)
        names, number = np.unique(np.concatenate([at[~start], next_]), return_inverse=True)
        a, b, level = number[: (~start).sum()], number[(~start).sum() :][~start], np.unique(number[(~start).sum() :][start])
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        edge, distance, hop = np.searchsorted(a, np.arange(len(names) + 1)), np.full(len(names), -1), 0
        distance[level] = 0
        while len(level) and (depth is None or hop < depth):
            hop += 1
            reached = np.unique(np.concatenate([b[edge[n] : edge[n + 1]] for n in level]))
            level = reached[distance[reached] < 0]
            distance[level] = hop
        seen = np.flatnonzero(distance >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(names[seen].tolist()), pa.array(distance[seen].astype(np.int32))], ["node", "distance"])

    return rows.coalesce(1).mapInArrow(run, T.StructType([T.StructField("node", steps.schema["at"].dataType), T.StructField("distance", T.IntegerType())]))


def bfs(edges: DataFrame, roots: DataFrame, direction: str = "both", depth: int | None = 2, small: int = SMALL) -> DataFrame:
    """(node, distance) of what the roots (one column) reach in depth hops, or at all if that is None.

    The distinct steps are written to the shared folder first, so that the one task that walks a graph of at most small steps
    reads them and nothing else: joins and sorts that edges come from would run in it too. In a larger graph each hop
    joins the last level with the edges and drops what was seen; levels are written to the shared folder, so the plan
    doesn't grow, and only whether a level is empty comes to the driver. Both give the same rows. Null roots and edges with a
    null end take no part; a root that no edge knows is reached at 0."""
    scratch = Scratch(edges.sparkSession, "bfs")
    steps, roots = scratch.keep(_steps(edges, direction), "steps"), roots.toDF("node").filter("node IS NOT NULL")
    if steps.count() <= small:
        roots = scratch.keep(roots.withColumn("node", F.col("node").cast(steps.schema["at"].dataType)).distinct(), "roots")
        return _walked(steps, roots, depth)
    level = roots.distinct().withColumn("distance", F.lit(0))
    seen, hop = level, 0
    while depth is None or hop < depth:
        hop += 1
        reached = level.join(steps, F.col("node") == F.col("at")).select(F.col("next").alias("node")).distinct()
        level = scratch.keep(reached.join(seen, "node", "left_anti").withColumn("distance", F.lit(hop)), f"level{hop}")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def subgraph(edges: DataFrame, root: DataFrame, depth: int = 2, direction: str = "both") -> DataFrame:
    """The edges that a traversal meets while it expands nodes nearer than depth: of each expanded node and neighbour the
    edge to it where there is one, else the edge from it."""
    expanded = bfs(edges, root, direction, depth).filter(F.col("distance") < depth).select("node")
    pairs = expanded.join(_steps(edges, direction), F.col("node") == F.col("at")).select("at", "next").distinct()
    there = edges.select("from_id", "to_id", "edge_type", "weight")
    out = pairs.join(there, (F.col("at") == F.col("from_id")) & (F.col("next") == F.col("to_id"))).select(there.columns)
    back = pairs.join(there, (F.col("at") == F.col("from_id")) & (F.col("next") == F.col("to_id")), "left_anti")
    return out.unionByName(back.join(there, (F.col("next") == F.col("from_id")) & (F.col("at") == F.col("to_id"))).select(there.columns)).distinct()


def induced_subgraph_v1(edges: DataFrame, root: DataFrame, depth: int = 2, direction: str = "both") -> DataFrame:
    """All edges between the nodes reached; with both directions, what is reached forward or backward, not mixed."""
    ways = ("outgoing", "incoming") if checked_direction(direction) == "both" else (direction,)
    nodes = bfs(edges, root, ways[0], depth).select("node")
    for way in ways[1:]:
        nodes = nodes.union(bfs(edges, root, way, depth).select("node"))
    return within(edges, nodes.distinct())


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes (column node)."""
    ends = nodes.select("node")
    return edges.join(ends.withColumnRenamed("node", "from_id"), "from_id", "left_semi").join(ends.withColumnRenamed("node", "to_id"), "to_id", "left_semi").select(edges.columns)


def distances(edges: DataFrame, source: DataFrame, targets: DataFrame) -> DataFrame:
    """(node, distance) of the targets (column node), hops over the furthest node's, either way along edges; 1 where there
    is no path, 0 at the source itself even if no edge knows it."""
    found = bfs(edges, source, "both", None)
    furthest = F.broadcast(found.agg(F.greatest(F.lit(1), F.max("distance")).alias("most")))
    joined = targets.select("node").distinct().join(found, "node", "left").join(furthest)
    return joined.select("node", F.coalesce(F.least(F.lit(1.0), F.col("distance") / F.col("most")), F.lit(1.0)).alias("distance"))


def distances_v1(edges: DataFrame, source: DataFrame, targets: DataFrame, cap: int = 5) -> DataFrame:
    """Hops over cap, 1 at most; 1 where an end is unknown or there is no path."""
    known = edges.select(F.col("from_id").alias("node")).union(edges.select(F.col("to_id"))).distinct()
    found = bfs(edges, source, "both", cap).join(known, "node", "left_semi")
    joined = targets.select("node").distinct().join(found, "node", "left")
    return joined.select("node", F.coalesce(F.least(F.lit(1.0), F.col("distance") / F.lit(cap)), F.lit(1.0)).alias("distance"))


def resolve_target(chunks: DataFrame, target: str) -> DataFrame:
    """The first chunk by (path, start_line, chunk_id) with this name, or whose path ends so."""
    return chunks.filter((F.col("name") == target) | F.endswith(F.col("path"), F.lit(target))).orderBy("path", "start_line", "chunk_id").limit(1)


def resolve_target_like_v1(chunks: DataFrame, target: str) -> DataFrame:
    """A chunk of exactly this name, else one whose path holds it, whatever its case; % and _ stand for any text and any
    character."""
    matched = chunks.withColumn("class", F.when(F.col("name") == target, 0).when(F.ilike(F.col("path"), F.lit(f"%{target}%")), 1))
    return matched.filter("class IS NOT NULL").orderBy("class", "start_line", "path", "chunk_id").limit(1).drop("class")


def representatives(chunks: DataFrame, by: str = "path") -> DataFrame:
    """The first chunk of each file by (start_line, chunk_id)."""
    return chunks.groupBy(by).agg(F.min_by("chunk_id", F.struct("start_line", "chunk_id")).alias("chunk_id"))


def resolved_imports(imports: DataFrame, files: DataFrame, python: bool = False) -> DataFrame:
    """imports (from_path, specifier): the first candidate path that is a file (path). Self imports go."""
    each = imports.select("from_path", "specifier", F.posexplode(X.import_candidates(F.col("specifier"), F.col("from_path"), python)).alias("at", "path"))
    first = each.join(files.select("path").distinct(), "path").groupBy("from_path", "specifier").agg(F.min_by("path", "at").alias("to_path"))
    return first.filter("from_path <> to_path")


def import_edges(imports: DataFrame, chunks: DataFrame, python: bool = False) -> DataFrame:
    """Edges from the importing file's representative chunk to the imported one's."""
    first = representatives(chunks)
    found = resolved_imports(imports, first.select("path"), python)
    named = found.join(first.withColumnsRenamed({"path": "from_path", "chunk_id": "from_id"}), "from_path").join(first.withColumnsRenamed({"path": "to_path", "chunk_id": "to_id"}), "to_path")
    return named.filter("from_id <> to_id").select("from_id", "to_id", F.lit("imports").alias("edge_type"), F.lit(1.0).alias("weight")).distinct()


def name_index_v1(chunks: DataFrame) -> DataFrame:
    """(name, chunk_id): of chunks with one name, the last by seq."""
    return chunks.filter("name IS NOT NULL AND name <> ''").groupBy("name").agg(F.max_by("chunk_id", "seq").alias("chunk_id"))


def code_edges_v1(chunks: DataFrame) -> DataFrame:
    """Call and inheritance edges by name, of chunks (chunk_id, seq, name, content); inheritance wins over a call."""
    index = name_index_v1(chunks).withColumnRenamed("chunk_id", "to_id")
    named = lambda names, kind, weight: chunks.select(F.col("chunk_id").alias("from_id"), F.explode(names).alias("name")).join(index, "name").select("from_id", "to_id", F.lit(kind).alias("edge_type"), F.lit(weight).alias("weight"))
    both = named(X.called_names(F.col("content")), "calls", 0.8).unionByName(named(X.base_names(F.col("content")), "extends", 1.0))
    return collapsed(both, F.when(F.col("edge_type") == "extends", 1).otherwise(0))


def file_nodes(files: DataFrame, chunks: DataFrame, cap: int = 400) -> DataFrame:
    """The files with most chunks, those without any too: file_id, path, language (unknown if null), n_chunks."""
    counted = chunks.groupBy("file_id").agg(F.count("chunk_id").alias("n_chunks"))
    joined = files.join(counted, "file_id", "left").select("file_id", "path", F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))
    return joined.orderBy(F.desc("n_chunks"), F.asc("file_id")).limit(cap)


def file_edges(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct pairs of different files that edges between their chunks (chunk_id, file_id) join."""
    of = chunks.select("chunk_id", "file_id")
    joined = edges.join(of.withColumnsRenamed({"chunk_id": "from_id", "file_id": "from_file"}), "from_id").join(of.withColumnsRenamed({"chunk_id": "to_id", "file_id": "to_file"}), "to_id")
    return joined.filter("from_file <> to_file").select("from_file", "to_file").distinct()


def file_graph(files: DataFrame, chunks: DataFrame, edges: DataFrame, cap: int = 400) -> tuple[DataFrame, DataFrame]:
    """Nodes, and edges between them."""
    nodes = file_nodes(files, chunks, cap)
    pairs = within(file_edges(edges, chunks).withColumnsRenamed({"from_file": "from_id", "to_file": "to_id"}), nodes.withColumnRenamed("file_id", "node"))
    return nodes, pairs.withColumnsRenamed({"from_id": "from_file", "to_id": "to_file"})
