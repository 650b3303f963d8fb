"""The engine's functions over a store: index, search, status, graphs, memories, context."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.functions import text as X
from lodestone.operators import chunking, coedit, embed, graph
from lodestone.plans import context
from lodestone.schema import Options
from lodestone.sources import files as sources
from lodestone.sources.scratch import Scratch
from lodestone.sources.store import Store, cascade, retried, upserted


def project_id(root: str) -> str:
    return str(uuid.uuid5(uuid.UUID(X.NAMESPACE_DNS), root))


def with_files(vectors: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Vectors (chunk_id, embedding) with their chunks and these with their files."""
    return vectors.join(chunks, "chunk_id").join(files, "file_id")


def by_ids(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The chunks whose chunk_id is wanted."""
    return chunks.join(wanted.select("chunk_id").distinct(), "chunk_id", "left_semi")


def memory_row(spark: SparkSession, pid: str, session_id: str, memory_type: str, content: str, now: Column) -> tuple[DataFrame, str] | None:
    """A new memory as one row, and its id; None for blank content, which is refused. An unknown type becomes a context note."""
    text = content.strip()
    if not text:
        return None
    mid = str(uuid.uuid4())
    kind = schema.memory_type(F.lit(memory_type))
    return spark.range(1).select(F.lit(mid).alias("id"), F.lit(pid).alias("project_id"), F.lit(session_id).alias("session_id"), kind.alias("memory_type"), F.lit(text).alias("content"), F.lit(1.0).alias("relevance_score"), now.alias("created_at")), mid


class Engine:
    """A project is the tree below its root. Each has a store of its own below one folder, so that a look-up or a change reads
    and writes one project's tables, however many there are."""

    def __init__(self, spark: SparkSession, store: str, provider: embed.Provider | None = None, options: Options = Options(), clock=lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)):
        self.spark, self.folder, self.options, self.clock = spark, store.rstrip("/"), options, clock
        self.provider = provider or embed.Hashing()
        self._stores: dict[str, Store] = {}

    def store(self, root: str) -> Store:
        pid = project_id(root)
        if pid not in self._stores:
            self._stores[pid] = Store(self.spark, f"{self.folder}/{pid}")
        return self._stores[pid]

    def _own(self, name: str, root: str) -> DataFrame:
        return self.store(root).read(name)

    def _now(self):
        return F.lit(self.clock()).cast("timestamp")

    def _project(self, root: str, indexed: bool) -> None:
        old = self._own("projects", root)
        row = self.spark.range(1).select(F.lit(project_id(root)).alias("id"), F.lit(root).alias("name"), F.lit(root).alias("root_path"), F.lit(None).cast("string").alias("config"), (self._now() if indexed else F.lit(None).cast("timestamp")).alias("indexed_at"), self._now().alias("created_at"))
        kept = row.join(old.select("id", F.col("created_at").alias("_c"), F.col("indexed_at").alias("_i"), F.col("config").alias("_f")), "id", "left")
        row = kept.select("id", "name", "root_path", F.coalesce("config", "_f").alias("config"), F.coalesce("indexed_at", "_i").alias("indexed_at"), F.coalesce("_c", "created_at").alias("created_at"))
        self.store(root).write("projects", upserted(old, row, ["id"]))

    def index(self, root: str, force: bool = False, paths: list[str] | None = None) -> dict:
        """Brings the store up to date with the tree, or with these paths of it (and what of them is gone). Files whose hash
        hasn't changed are skipped. The tree is read once; files, chunks, vectors, imports, edges and co-edits change in one
        transaction, which begins anew if another writer was first."""
        pid = project_id(root)
        try:
            scanned = sources.scan(self.spark, root).withColumn("project_id", F.lit(pid))
            if paths:
                scanned = scanned.filter(F.col("path").isin([p.replace("\\", "/") for p in paths]))
            scanned = Scratch(self.spark, "scan").keep(scanned, "files")
            counts = retried(lambda: self._index(root, pid, scanned, force, paths))
            return {"success": True, "project_id": pid, "project_path": root, "files_indexed": counts["files_indexed"], "files_skipped": counts["files_skipped"], "total_files": counts["total_files"]}
        except Exception as e:  # the caller gets a result row in any case
            return {"success": False, "project_id": pid, "project_path": root, "files_indexed": 0, "files_skipped": 0, "total_files": 0, "error": str(e)}

    def _index(self, root: str, pid: str, scanned: DataFrame, force: bool, paths: list[str] | None) -> Row:
        store = self.store(root)
        with store.transaction():
            stored = store.read("files")
            counts = sources.index_counts(scanned, stored, force).first()
            self._project(root, True)
            self._replace(store, pid, scanned, stored, force, paths)
            self._embed(store)
            if paths:
                self._record(store, [p.replace("\\", "/") for p in paths], pid)
        return counts

    def _replace(self, store: Store, pid: str, scanned: DataFrame, stored: DataFrame, force: bool, paths: list[str] | None) -> None:
        """Changed and vanished files lose their rows, changed and new ones get theirs. Edges follow from the imports that are
        stored with each file, so they are right after a targeted change too: of the file, and of those that import it."""
        scratch = Scratch(self.spark, "index")
        new = scratch.keep(sources.changed(scanned, stored, force).withColumn("file_id", X.row_id(F.col("project_id"), F.col("path"))), "new")
        gone = stored.filter(F.col("path").isin([p.replace("\\", "/") for p in paths])) if paths else stored
        gone = sources.vanished(scanned, gone).select(F.col("id").alias("file_id"))
        out = scratch.keep(new.select("file_id").unionByName(gone), "out")
        parsed = scratch.keep(chunking.parsed(new), "parsed")
        chunks, vectors, _ = cascade(out, store.read("chunks").withColumnRenamed("id", "chunk_id"), store.read("embeddings"), store.read("graph_edges"))
        fresh = chunking.identified(parsed).select(F.col("chunk_id").alias("id"), "file_id", "chunk_type", "name", "content", "start_line", "end_line", "token_count", F.lit(None).cast("map<string,string>").alias("metadata"))
        found = parsed.filter("specifier IS NOT NULL").select("file_id", F.col("path").alias("from_path"), "specifier")
        rows = new.select(F.col("file_id").alias("id"), "project_id", "path", "language", "hash", "last_modified")
        store.write("files", stored.join(out.withColumnRenamed("file_id", "id"), "id", "left_anti").unionByName(rows))
        store.write("chunks", chunks.withColumnRenamed("chunk_id", "id").unionByName(fresh.dropDuplicates(["id"])))
        store.write("embeddings", vectors)
        store.write("imports", store.read("imports").join(out, "file_id", "left_anti").unionByName(found))
        store.write("graph_edges", self._edges(store, pid))

    def _edges(self, store: Store, pid: str) -> DataFrame:
        files = store.read("files").select(F.col("id").alias("file_id"), "path")
        chunks = store.read("chunks").select(F.col("id").alias("chunk_id"), "file_id", "start_line").join(files, "file_id")
        found = graph.import_edges(store.read("imports").select("from_path", "specifier"), chunks, python=True)
        return found.select(X.edge_id(F.col("from_id"), F.col("to_id"), F.col("edge_type")).alias("id"), F.lit(pid).alias("project_id"), F.col("from_id").alias("from_chunk"), F.col("to_id").alias("to_chunk"), "edge_type", "weight")

    def _embed(self, store: Store) -> None:
        chunks = store.read("chunks").withColumnRenamed("id", "chunk_id")
        old = store.read("embeddings")
        new = embed.embedded(embed.without_vector(chunks, old), self.provider).withColumn("created_at", self._now())
        store.append("embeddings", new.select(old.columns))

    def _record(self, store: Store, paths: list[str], pid: str) -> None:
        if len(set(paths)) < 2:
            return
        session = self.spark.createDataFrame([(0, p) for p in paths], "session_id int, file_id string")
        new = coedit.pairs(session, F.unix_micros(self._now())).withColumn("project_id", F.lit(pid))
        old = store.read("file_coedits").withColumn("last_seen", F.unix_micros("last_seen"))
        key = ["project_id", "file_a", "file_b"]
        both = old.select(*key, "count", "last_seen").unionByName(new.select(*key, "count", "last_seen")).groupBy(*key).agg(F.sum("count").alias("count"), F.max("last_seen").alias("last_seen"))
        store.write("file_coedits", both.select(X.edge_id(*(F.col(k) for k in key)).alias("id"), *key, "count", F.timestamp_micros("last_seen").alias("last_seen")))

    def record_coedits(self, root: str, paths: list[str]) -> None:
        store = self.store(root)

        def step() -> None:
            with store.transaction():
                self._record(store, [p.replace("\\", "/") for p in paths], project_id(root))

        retried(step)

    def candidates(self, root: str) -> DataFrame:
        """Chunks with their vectors and files."""
        files = self._own("files", root).select(F.col("id").alias("file_id"), "path", "last_modified")
        chunks = self._own("chunks", root).select(F.col("id").alias("chunk_id"), "file_id", "chunk_type", "name", "content", "start_line", "end_line")
        return with_files(self._own("embeddings", root).select("chunk_id", F.col("vector").alias("embedding")), chunks, files)

    def chunks_by_ids(self, root: str, ids: list[str]) -> DataFrame:
        """The chunks of these ids with their files; none for an empty list."""
        wanted = self.spark.createDataFrame([(i,) for i in ids], "chunk_id string")
        files = self._own("files", root).select(F.col("id").alias("file_id"), "path", "last_modified")
        return by_ids(self._own("chunks", root).withColumnRenamed("id", "chunk_id"), wanted).join(files, "file_id")

    def _vector(self, query: str) -> list[float]:
        return self.provider.embed([query])[0].tolist()

    def search(self, query: str, root: str, k: int = 10, filter_type: str | None = None) -> DataFrame:
        """Nothing for a blank query."""
        found = context.search(self.candidates(root), self._vector(query), schema.checked_k(k), filter_type)
        return found.withColumnRenamed("last_modified", "modified_at") if query.strip() else found.limit(0)

    def memories(self, root: str) -> DataFrame:
        rows = self._own("memories", root).withColumnRenamed("id", "memory_id")
        return rows.join(self._own("memory_embeddings", root).select("memory_id", F.col("vector").alias("embedding")), "memory_id", "left")

    def search_memories(self, query: str, root: str, k: int = 5) -> DataFrame:
        return context.search_memories(self.memories(root).filter("embedding IS NOT NULL"), self._vector(query), k).select("memory_id", "memory_type", "content", "score", "created_at", "rank")

    def remember(self, root: str, session_id: str, memory_type: str, content: str) -> dict:
        """Blank content is refused; an unknown type becomes a context note."""
        noted = memory_row(self.spark, project_id(root), session_id, memory_type, content, self._now())
        if noted is None:
            return {"id": None, "success": False}
        row, mid = noted
        store = self.store(root)

        def step() -> None:
            with store.transaction():
                if store.read("projects").isEmpty():
                    self._project(root, False)
                store.append("memories", row)
                vector = embed.embedded(row, self.provider, key="id").withColumnRenamed("id", "memory_id").withColumn("created_at", self._now())
                store.append("memory_embeddings", vector)

        retried(step)
        return {"id": mid, "success": True}

    def list_memories(self, root: str) -> DataFrame:
        return context.list_memories(self._own("memories", root).withColumnRenamed("id", "memory_id"), project_id(root))

    def delete_memory(self, root: str, memory_id: str) -> dict:
        store = self.store(root)

        def step() -> bool:
            with store.transaction():
                old = store.read("memories")
                if old.filter(F.col("id") == memory_id).isEmpty():
                    return False
                vectors = store.read("memory_embeddings").filter(F.col("memory_id") != memory_id)
                store.write("memories", old.filter(F.col("id") != memory_id))
                store.write("memory_embeddings", vectors)
            return True

        return {"success": retried(step)}

    def status(self, root: str) -> DataFrame:
        files = self._own("files", root).select(F.col("id").alias("file_id"), "project_id")
        return context.status(self._own("projects", root).withColumnRenamed("id", "project_id"), project_id(root), files, self._own("chunks", root))

    def edges(self, root: str) -> DataFrame:
        return self._own("graph_edges", root).select(F.col("from_chunk").alias("from_id"), F.col("to_chunk").alias("to_id"), "edge_type", "weight")

    def graph(self, target: str, root: str, depth: int = 2, direction: str = "both") -> tuple[DataFrame, DataFrame]:
        """Nodes and edges around the chunk that the target names; both empty if there is none."""
        chunks = self.candidates(root).drop("embedding", "content")
        start = graph.resolve_target(chunks, target).select(F.col("chunk_id").alias("node"))
        edges = graph.subgraph(self.edges(root), start, depth, direction)
        reached = graph.bfs(self.edges(root), start, direction, depth)
        return chunks.join(reached, F.col("chunk_id") == F.col("node")).drop("node"), edges

    def graph_distances(self, root: str, active: str, candidate_ids: list[str]) -> DataFrame:
        one = lambda values: self.spark.createDataFrame([(v,) for v in values], "node string")
        return graph.distances(self.edges(root), one([active]), one(candidate_ids))

    def file_graph(self, root: str) -> tuple[DataFrame, DataFrame]:
        files = self._own("files", root).withColumnRenamed("id", "file_id")
        chunks = self._own("chunks", root).withColumnRenamed("id", "chunk_id").join(files.select("file_id"), "file_id", "left_semi")
        return graph.file_graph(files, chunks, self.edges(root), self.options.file_cap)

    def coedit_scores(self, root: str, active_file: str, paths: DataFrame) -> DataFrame:
        return coedit.scores(self._own("file_coedits", root), active_file, paths)

    def file_coedits(self, root: str, active_file: str) -> DataFrame:
        """Scores of the files that the file graph shows."""
        return self.coedit_scores(root, active_file, self.file_graph(root)[0].select("path"))

    def query_context(self, prompt: str, root: str, active_file: str | None = None, token_budget: int | None = None) -> dict:
        query = self._vector(prompt)
        ranking = context.ranked(self.candidates(root), query, self.edges(root), self._own("file_coedits", root), active_file, F.col("last_modified"), self.options)
        fitting = context.sources(ranking, self.options.token_budget if token_budget is None else token_budget)
        return json.loads(context.query_context_json(fitting, self.search_memories(prompt, root, self.options.memory_candidates)).first()[0])


def write_options(folder: str, options: Options = Options()) -> Path:
    """A project's options as a JSON file, if there is none; and its ignore file told of the store's folder."""
    path = Path(folder) / ".lodestone" / "config.json"
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"token_budget": options.token_budget, "k": options.k, "depth": options.depth}, indent=2))
    ignore = Path(folder) / ".gitignore"
    if ignore.exists() and ".lodestone/" not in ignore.read_text().splitlines():
        ignore.write_text(ignore.read_text().rstrip("\n") + "\n.lodestone/\n")
    return path
