"""Queries over the driver's tables, each with the SQL that its result is checked against where SQL can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import chunking, coedit, graph, rank, vector
from lodestone.plans import context, engine
from lodestone.plans.views import Tables, with_views
from lodestone.sources import files as sources
from lodestone.sources import store
from lodestone.sources.scratch import Scratch
from lodestone.sources.tree import remove_from_tree, write_tree
from lodestone.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ACTIVE = "src/f7.py"
ACTIVE_PART = 5


def query(views: str = "", sql: str | None = None):
    """Registers a function of Tables under its name, and its SQL after the views it needs."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(views.split(), sql) if views else sql
        return f

    return register


def six(column: str):
    return F.round(column, 6).alias(column)


# Vectors

_Q = "(select embedding::double[] as q from embeddings where vec_id = 0)"
_COS = "list_cosine_similarity(embedding::double[], q)"
_TOP = """select row_number() over (order by s desc, chunk_id)::int as rank, chunk_id, path, round(s, 6) as score
from (select chunk_id, path, {cos} as s from v_candidates, {q} {where}) order by s desc, chunk_id limit {k}"""


@query("v_candidates", f"select chunk_id, round({_COS}, 6) as score from v_candidates, {_Q}")
def cosine_scores(t):
    return vector.cosine_scores(t.view("v_candidates").select("chunk_id", "embedding"), t.vector()).select("chunk_id", six("score"))


@query("v_candidates", _TOP.format(cos=_COS, q=_Q, where="", k=20))
def cosine_topk(t):
    return context.search(t.view("v_candidates"), t.vector(), 20).select("rank", "chunk_id", "path", six("score"))


@query("v_candidates", _TOP.format(cos=_COS, q=_Q, where="where chunk_type = 'class'", k=10))
def cosine_topk_filtered(t):
    return context.search(t.view("v_candidates"), t.vector(), 10, "class").select("rank", "chunk_id", "path", six("score"))


@query("v_candidates", _TOP.format(cos=f"round({_COS}, 4)", q=_Q, where="", k=10))
def cosine_topk_round4_v1(t):
    return vector.topk_v1(t.view("v_candidates"), t.vector(), 10).select("rank", "chunk_id", "path", six("score"))


@query("v_candidates", f"select row_number() over (order by s desc, chunk_id)::int as rank, chunk_id, path, round(s, 3) as score from (select chunk_id, path, {_COS} as s from v_candidates, {_Q}) order by s desc, chunk_id limit 10")
def inner_product_topk_v1(t):
    found = vector.inner_product_topk_v1(t.view("v_candidates").select("chunk_id", "path", "chunk_type", "embedding"), t.vector(), 10)
    return found.select("rank", "chunk_id", "path", F.round("score", 3).alias("score"))  # 32-bit products against 64-bit ones


@query("", """select query_id, chunk_id, rank, round(s, 6) as score from (
  select a.vec_id as query_id, b.vec_id as chunk_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s,
         row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.vec_id)::int as rank
  from embeddings a, embeddings b where a.vec_id % 20 = 0) where rank <= 5""")
def knn_join(t):
    rows = t.read("embeddings")
    found = vector.knn_join(rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), rows.withColumnRenamed("vec_id", "chunk_id"), 5)
    return found.select("query_id", "chunk_id", "rank", six("score"))


# Relations

@query("", """select e.vec_id as chunk_id, d.source as project_id, concat(d.source, '/', d.doc_id::varchar) as path, d.lang as language, len(e.embedding)::int as dims, v.event_type as chunk_type
from embeddings e join events v on v.event_id = e.vec_id join documents d on d.doc_id = e.vec_id""")
def candidate_join(t):
    chunks = t.read("events").select(F.col("event_id").alias("chunk_id"), F.col("event_id").alias("file_id"), F.col("event_type").alias("chunk_type"))
    files = t.view("v_files").select("file_id", "project_id", "path", "language")
    vectors = t.read("embeddings").select(F.col("vec_id").alias("chunk_id"), F.size("embedding").alias("dims"))
    return engine.with_files(vectors, chunks, files).select("chunk_id", "project_id", "path", "language", "dims", "chunk_type")


@query("v_candidates", "select chunk_id, path, chunk_type, start_line, end_line from v_candidates where chunk_id in (3, 17, 256, 499, 100000000)")
def candidates_by_ids(t):
    wanted = t.spark.createDataFrame([(i,) for i in (3, 17, 256, 499, 100000000)], "chunk_id long")
    return engine.by_ids(t.view("v_candidates"), wanted).select("chunk_id", "path", "chunk_type", "start_line", "end_line")


_BLOCKS = """blocks as (select file_id, b.block::int as block, (b.block * 50 + 1)::int as start_line, (b.block * 50 + len(part))::int as end_line, array_to_string(part, chr(10)) as content
  from (select file_id, b.block as block, list_slice(lines, b.block * 50 + 1, b.block * 50 + 50) as part from (
    select file_id, string_split(regexp_replace(content, '\\n$', ''), chr(10)) as lines from v_files where content <> ''), lateral (select unnest(range(0, ((len(lines) - 1) // 50) + 1)) as block) b) b)"""


def _blocks(t):
    return chunking.line_blocks(t.view("v_files").select("file_id", "content"))


@query("v_files", f"@{_BLOCKS} select project_id, count(distinct f.file_id) as n_files, count(b.file_id) as n_chunks from v_files f left join blocks b using (file_id) group by project_id")
def project_stats(t):
    return context.project_stats(t.view("v_files"), _blocks(t).select("file_id"))


@query("v_files", f"@{_BLOCKS} select 'src3' as project_id, true as indexed, count(distinct f.file_id) as n_files, count(b.file_id) as n_chunks from v_files f left join blocks b using (file_id) where project_id = 'src3'")
def status(t):
    files = t.view("v_files").select("file_id", "project_id")
    projects = files.select("project_id").distinct().withColumn("indexed_at", F.lit(0))
    return context.status(projects, "src3", files, _blocks(t).select("file_id"))


@query("v_files", f"@{_BLOCKS} select f.file_id, path, coalesce(language, 'unknown') as language, count(b.file_id) as n_chunks from v_files f left join blocks b using (file_id) group by all order by n_chunks desc, file_id limit 400")
def files_chunk_count_top400(t):
    return graph.file_nodes(t.view("v_files").select("file_id", "path", "language"), _blocks(t).select("file_id", F.col("block").alias("chunk_id")), 400)


@query("v_candidates v_edges", "select distinct a.file_id as from_file, b.file_id as to_file from v_edges e join v_candidates a on a.chunk_id = e.from_id join v_candidates b on b.chunk_id = e.to_id where a.file_id <> b.file_id")
def file_edges_distinct(t):
    return graph.file_edges(t.view("v_edges"), t.view("v_candidates"))


@query("v_candidates v_edges", """@n as (select file_id, count(*) as c from v_candidates group by 1 order by 2 desc, 1 limit 400)
select distinct a.file_id as from_file, b.file_id as to_file from v_edges e join v_candidates a on a.chunk_id = e.from_id join v_candidates b on b.chunk_id = e.to_id
where a.file_id <> b.file_id and a.file_id in (select file_id from n) and b.file_id in (select file_id from n)""")
def file_graph(t):
    chunks = t.view("v_candidates").select("chunk_id", "file_id", "path")
    files = chunks.select("file_id", "path").distinct().withColumn("language", F.lit("python"))
    return graph.file_graph(files, chunks, t.view("v_edges"))[1]


@query("v_candidates", "select path, arg_min(chunk_id, start_line * 100000 + chunk_id) as chunk_id from v_candidates group by path")
def representative_chunk(t):
    return graph.representatives(t.view("v_candidates"))


@query("", "select doc_id as chunk_id from documents where doc_id not in (select vec_id from embeddings)")
def unembedded_chunks(t):
    from lodestone.operators.embed import without_vector

    return without_vector(t.read("documents").select(F.col("doc_id").alias("chunk_id")), t.read("embeddings").select(F.col("vec_id").alias("chunk_id")))


# Edits

_PAIRS = "pairs as (select a.file_id as file_a, b.file_id as file_b, count(*) as count, max(a.session_id) as last_seen from v_sessions a join v_sessions b on a.session_id = b.session_id and a.file_id < b.file_id group by 1, 2)"


@query("v_sessions", f"@{_PAIRS} select * from pairs")
def coedit_pairs(t):
    return coedit.pairs(t.view("v_sessions"), F.col("session_id"))


@query("v_sessions", f"""@{_PAIRS}, own as (select case when file_a = {ACTIVE_PART} then file_b else file_a end as path, count from pairs where file_a = {ACTIVE_PART} or file_b = {ACTIVE_PART})
select p_partkey as path, round(coalesce(count / (select max(count) from own), 0), 6)::double as score from part left join own on path = p_partkey where (select count(*) from own) > 0""")
def coedit_scores(t):
    counts = coedit.pairs(t.view("v_sessions"), F.col("session_id"))
    found = coedit.scores(counts, ACTIVE_PART, t.read("part").select(F.col("p_partkey").alias("path")))
    return found.select("path", six("score"))


@query("", """select user_id, count(*) as n_events, count(distinct event_type)::int as n_types, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as end_us from (
  select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from (
    select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as fresh from events)) group by user_id, session""")
def edit_sessions(t):
    events = t.read("events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    found = coedit.edit_sessions(events, "user_id", "ts", "30 minutes", "event_type")
    return found.select("user_id", "n_events", F.size("changed").alias("n_types"), F.unix_micros("first_ts").alias("start_us"), F.unix_micros("last_ts").alias("end_us"))


# Graphs

_ROOT = "root as (select to_id as node from v_edges group by 1 order by count(*) desc, 1 limit 1)"
_FORTH, _BACK = "select from_id as a, to_id as b from v_edges", "select to_id as a, from_id as b from v_edges"
_STEPS = {"out": _FORTH, "in": _BACK, "both": f"{_FORTH} union {_BACK}"}


def _reach(way: str, depth: int, name: str = "walk") -> str:
    return f"{name}_s as ({_STEPS[way]}), {name} as (select node, 0 as d from root union select b, d + 1 from {name} join {name}_s on a = node where d < {depth}), {name}_d as (select node, min(d)::int as distance from {name} group by 1)"


def _root(t) -> DataFrame:
    return t.view("v_edges").groupBy(F.col("to_id").alias("node")).count().orderBy(F.desc("count"), "node").limit(1).select("node")


def _weighted(t) -> DataFrame:
    weight = F.when(F.col("edge_type") == "calls", F.lit(0.8)).otherwise(F.lit(1.0))
    return t.view("v_edges").withColumn("weight", weight)


_WEIGHT = "case when edge_type = 'calls' then 0.8::double else 1.0::double end"


@query("v_edges", f"@{_ROOT}, {_reach('out', 3)} select * from walk_d")
def graph_bfs_out(t):
    return graph.bfs(t.view("v_edges"), _root(t), "outgoing", 3)


@query("v_edges", f"@{_ROOT}, {_reach('in', 2)} select * from walk_d")
def graph_bfs_in(t):
    return graph.bfs(t.view("v_edges"), _root(t), "incoming", 2)


@query("v_edges", f"@{_ROOT}, {_reach('both', 2)} select * from walk_d")
def graph_bfs_both(t):
    return graph.bfs(t.view("v_edges"), _root(t), "both", 2)


@query("v_edges", f"""@{_ROOT}, {_reach('both', 2)}, x as (select distinct node as a, b from walk_d join walk_s on walk_s.a = node where distance < 2)
select distinct e.from_id, e.to_id, e.edge_type, {_WEIGHT} as weight from v_edges e, x
where (e.from_id = x.a and e.to_id = x.b) or (e.from_id = x.b and e.to_id = x.a and not exists (select 1 from v_edges o where o.from_id = x.a and o.to_id = x.b))""")
def subgraph_edges(t):
    return graph.subgraph(_weighted(t), _root(t), 2, "both")


@query("v_edges", f"""@{_ROOT}, {_reach('out', 2, 'f')}, {_reach('in', 2, 'g')}, n as (select node from f_d union select node from g_d)
select from_id, to_id, edge_type, {_WEIGHT} as weight from v_edges where from_id in (select node from n) and to_id in (select node from n)""")
def induced_subgraph_v1(t):
    return graph.induced_subgraph_v1(_weighted(t), _root(t), 2, "both")


@query("v_edges", f"""@{_ROOT}, {_reach('both', 40)} select vec_id as node, round(coalesce(least(1.0::double, distance / (select greatest(1, max(distance)) from walk_d)), 1.0::double), 6) as distance
from embeddings left join walk_d on node = vec_id""")
def graph_distances(t):
    return graph.distances(t.view("v_edges"), _root(t), t.read("embeddings").select(F.col("vec_id").alias("node"))).select("node", six("distance"))


@query("v_edges", f"@{_ROOT}, {_reach('both', 5)} select vec_id as node, round(coalesce(least(1.0::double, distance / 5), 1.0::double), 6) as distance from embeddings left join walk_d on node = vec_id")
def graph_distances_capped_v1(t):
    return graph.distances_v1(t.view("v_edges"), _root(t), t.read("embeddings").select(F.col("vec_id").alias("node"))).select("node", six("distance"))


@query("v_candidates", "select chunk_id, name, path, start_line from v_candidates where name = 'n7' or ends_with(path, 'n7') order by path, start_line, chunk_id limit 1")
def resolve_target(t):
    return graph.resolve_target(t.view("v_candidates"), "n7").select("chunk_id", "name", "path", "start_line")


@query("v_candidates", "select chunk_id, name, path, start_line from v_candidates where path ilike '%SRC/f_.%' order by start_line, path, chunk_id limit 1")
def resolve_target_like_v1(t):
    return graph.resolve_target_like_v1(t.view("v_candidates"), "SRC/f_.").select("chunk_id", "name", "path", "start_line")


@query("v_edges", f"select from_id, to_id, arg_max(edge_type, p) as edge_type, arg_max({_WEIGHT}, p) as weight from (select *, case edge_type when 'calls' then 0 when 'imports' then 1 else 2 end as p from v_edges) group by 1, 2")
def edge_collapse(t):
    priority = F.when(F.col("edge_type") == "calls", 0).when(F.col("edge_type") == "imports", 1).otherwise(2)
    return graph.collapsed(_weighted(t), priority)


@query("v_edges", "select concat(from_id::varchar, ':', to_id::varchar, ':', edge_type) as id, from_id, to_id, edge_type, case when to_id % 2 = 0 then 2.0::double else 1.0::double end as weight from v_edges")
def edge_upsert(t):
    edges = t.view("v_edges")
    old = edges.withColumns({"weight": F.lit(1.0), "version": F.lit(1)})
    return graph.upserted(old.unionByName(edges.filter("to_id % 2 = 0").withColumns({"weight": F.lit(2.0), "version": F.lit(2)})), "version")


@query("v_edges", "select coalesce(a.node, b.node) as node, coalesce(n_out, 0) as n_out, coalesce(n_in, 0) as n_in from (select from_id as node, count(distinct to_id) as n_out from v_edges group by 1) a full join (select to_id as node, count(distinct from_id) as n_in from v_edges group by 1) b on a.node = b.node")
def node_degrees(t):
    return graph.degrees(t.view("v_edges"))


# Names in code

_SPECIFIERS = """select distinct path as from_path, case file_id % 4 when 0 then concat('./f', (file_id * 3 % 60)::varchar) when 1 then concat('../src/./f', (file_id * 7 % 60)::varchar) when 2 then concat('./x/../f', (file_id * 5 % 60)::varchar, '.py') else 'numpy' end as specifier, case file_id % 4 when 0 then file_id * 3 % 60 when 1 then file_id * 7 % 60 else file_id * 5 % 60 end as target, file_id from v_candidates"""


@query("v_candidates", f"select from_path, specifier, concat('src/f', target::varchar, '.py') as to_path from ({_SPECIFIERS}) where file_id % 4 < 3 and target < 50 and target <> file_id")
def import_resolution(t):
    files, n = t.view("v_candidates").select("path", "file_id").distinct(), F.col("file_id")
    numbered = lambda lead, by, tail="": F.concat(F.lit(lead), (n * by % 60).cast("string"), F.lit(tail))
    specifier = F.when(n % 4 == 0, numbered("./f", 3)).when(n % 4 == 1, numbered("../src/./f", 7)).when(n % 4 == 2, numbered("./x/../f", 5, ".py")).otherwise("numpy")
    return graph.resolved_imports(files.select(F.col("path").alias("from_path"), specifier.alias("specifier")), files, python=True)


_CODE = "select vec_id as chunk_id, vec_id as seq, concat('n', (vec_id % 200)::varchar) as name, concat('class K extends n', (vec_id * 3 % 200)::varchar, ' { if (a) n', (vec_id * 7 % 200)::varchar, ' (len(x)); n', (vec_id * 3 % 200)::varchar, '() }') as content from embeddings"


def _code(t) -> DataFrame:
    n = F.col("vec_id")
    named = lambda by: F.concat(F.lit("n"), (n * by % 200).cast("string"))
    content = F.concat(F.lit("class K extends "), named(3), F.lit(" { if (a) "), named(7), F.lit(" (len(x)); "), named(3), F.lit("() }"))
    return t.read("embeddings").select(n.alias("chunk_id"), n.alias("seq"), named(1).alias("name"), content.alias("content"))


@query("", f"""with c as ({_CODE}), i as (select name, arg_max(chunk_id, seq) as to_id from c group by 1),
n as (select chunk_id as from_id, unnest(regexp_extract_all(content, '\\b(\\w+)\\s*\\(', 1)) as name, 'calls' as edge_type, 0.8::double as weight, 0 as p from c
union all select chunk_id, unnest(regexp_extract_all(content, '(?:extends|implements)\\s+(\\w+)', 1)), 'extends', 1.0::double, 1 from c)
select from_id, to_id, arg_max(edge_type, p) as edge_type, arg_max(weight, p) as weight from n join i using (name) where from_id <> to_id and name not in ('if', 'len') group by 1, 2""")
def code_edges_v1(t):
    return graph.code_edges_v1(_code(t))


@query("", f"with c as ({_CODE}) select distinct chunk_id, unnest(regexp_extract_all(content, '(?:extends|implements)\\s+(\\w+)', 1)) as base from c")
def base_names_v1(t):
    return _code(t).select("chunk_id", F.explode(X.base_names(F.col("content"))).alias("base"))


@query("", "select doc_id, count(*)::int as n_modules, min(m) as first_module, max(m) as last_module from (select distinct doc_id, unnest(regexp_extract_all(replace(text, chr(10), concat(chr(10), 'import ')), '(?m)^(?:from|import)\\s+([\\w.]+)', 1)) as m from documents) group by 1")
def import_regex_v1(t):
    names = X.imported_names(F.replace(F.col("text"), F.lit("\n"), F.lit("\nimport ")))
    rows = t.read("documents").select("doc_id", names.alias("names")).filter(F.size("names") > 0)
    return rows.select("doc_id", F.size("names").alias("n_modules"), F.array_min("names").alias("first_module"), F.array_max("names").alias("last_module"))


# Ranking

@query("v_candidates", "select chunk_id, round((max(m) over () - m) / (max(m) over () - min(m) over ())::double, 6) as recency from (select chunk_id, epoch_us(modified_at) as m from v_candidates)")
def recency_norm(t):
    rows = t.view("v_candidates").select("chunk_id", F.unix_micros(F.col("modified_at").cast("timestamp")).alias("m"))
    return rank.recency(rows, F.col("m")).select("chunk_id", six("recency"))


_RANKED = f"""top as (select *, row_number() over (order by s desc, chunk_id)::int as rank from (select *, {_COS} as s from v_candidates, {_Q}) order by s desc, chunk_id limit 20),
timed as (select *, arg_max(epoch_us(modified_at), rank) over (partition by path) as m from top),
anchor as (select arg_min(chunk_id, rank) as node from top where path = '{ACTIVE}' or ends_with(path, '/{ACTIVE}')),
root as (select node from anchor where node is not null), {_reach('both', 40)},
counted as (select a.path as file_a, b.path as file_b, count(*) as count from (select distinct modified % 40 as sid, path from v_candidates) a join (select distinct modified % 40 as sid, path from v_candidates) b on a.sid = b.sid and a.path < b.path group by 1, 2),
own as (select case when file_a = '{ACTIVE}' then file_b else file_a end as other, count from counted where file_a = '{ACTIVE}' or file_b = '{ACTIVE}'),
scored as (select *, case when (select count(*) from own) > 0 then coalesce((select count from own where other = path) / (select max(count) from own), 0) end as coedit, (max(m) over () - m) / greatest((max(m) over () - min(m) over ())::double, 1) as recency,
  case when exists (select 1 from root) then coalesce((select least(1.0::double, distance / (select greatest(1, max(distance)) from walk_d)) from walk_d where node = chunk_id), 1.0::double) end as graph_distance from timed),
final as (select *, floor((0.55::double * s + 0.20::double * (1.0::double - coalesce(graph_distance, 0.5::double)) + 0.10::double * (1.0::double - recency) + 0.15::double * coalesce(coedit, 0)::double) * 10000 + 0.5::double) / 10000 as final_score from scored),
ranked as (select *, row_number() over (order by final_score desc, rank)::int as final_rank, ceil(length(coalesce(content, '')) / 4)::int as tokens from final),
budgeted as (select *, sum(tokens) over (order by final_rank)::bigint as running_tokens from ranked)"""


def _ranking(t) -> DataFrame:
    modified = F.unix_micros(F.col("modified_at").cast("timestamp"))
    together = coedit.pairs(t.view("v_candidates").select((F.col("modified") % 40).alias("session_id"), F.col("path").alias("file_id")))
    return context.ranked(t.view("v_candidates"), t.vector(), t.view("v_edges"), together, ACTIVE, modified)


@query("v_candidates v_edges", f"@{_RANKED} select final_rank, rank, chunk_id, path, round(final_score, 4) as final_score, round(graph_distance, 6) as graph_distance, round(recency, 6) as recency, round(coedit, 6) as coedit from ranked")
def final_rank(t):
    return _ranking(t).select("final_rank", "rank", "chunk_id", "path", F.round("final_score", 4).alias("final_score"), six("graph_distance"), six("recency"), six("coedit"))


@query("v_candidates v_edges", f"@{_RANKED} select final_rank, chunk_id, path, name, concat(start_line::varchar, '-', end_line::varchar) as lines, tokens, running_tokens, round(final_score, 4) as score from budgeted where running_tokens <= 8000")
def query_context(t):
    found = context.sources(_ranking(t), 8000)
    return found.select("final_rank", "chunk_id", "path", "name", "lines", "tokens", "running_tokens", F.round("final_score", 4).alias("score"))


@query("v_candidates", f"select chunk_id, tokens, running_tokens from (select chunk_id, tokens, sum(tokens) over (order by s desc, chunk_id)::bigint as running_tokens from (select chunk_id, ceil(length(coalesce(content, '')) / 4)::int as tokens, {_COS} as s from v_candidates, {_Q} order by s desc, chunk_id limit 50)) where running_tokens <= 3000")
def token_budget_prefix(t):
    top = context.search(t.view("v_candidates"), t.vector(), 50).withColumn("tokens", X.token_estimate(F.coalesce("content", F.lit(""))))
    return rank.budget_prefix(top, F.col("tokens"), 3000, "rank").select("chunk_id", "tokens", "running_tokens")


@query("v_candidates v_edges", f"""@{_RANKED} select coalesce(string_agg(concat('// ', path, ':', start_line::varchar, '-', end_line::varchar, ' (', name, ')', chr(10), coalesce(content, '')), concat(chr(10), chr(10)) order by final_rank), '') as context,
coalesce(sum(tokens), 0)::bigint as token_count, count(*) as n_sources from budgeted where running_tokens <= 8000""")
def context_assembly(t):
    return context.assembled(context.sources(_ranking(t), 8000))


_JSON = """notes as (select row_number() over (order by {cos} desc, created_at desc, memory_id) as rank, memory_id, memory_type, content, created_at, round({cos}, 6) as score from v_memories join embeddings using (vec_id), {q} order by {cos} desc, created_at desc, memory_id limit 5),
fitting as (select * from budgeted where running_tokens <= 8000)
select to_json({{context: coalesce(string_agg(concat('// ', path, ':', start_line::varchar, '-', end_line::varchar, ' (', name, ')', chr(10), coalesce(content, '')), concat(chr(10), chr(10)) order by final_rank), ''),
  sources: list({{path: path, name: name, lines: concat(start_line::varchar, '-', end_line::varchar), score: final_score}} order by final_rank),
  memories: (select list({{id: memory_id, memory_type: memory_type, content: content, score: score, created_at: created_at}} order by rank) from notes), token_count: coalesce(sum(tokens), 0)::bigint}})::varchar as json from fitting"""


@query("v_candidates v_edges v_memories", f"@{_RANKED},\n{_JSON.format(cos=_COS, q=_Q)}")
def query_context_json(t):
    notes = _memory_topk(t).withColumn("score", F.round("score", 6))
    return context.query_context_json(context.sources(_ranking(t), 8000), notes)


# Texts

@query("", "select doc_id, ceil(length(text) / 4)::int as tokens, greatest(1, length(text) // 4)::int as tokens_v1 from documents")
def token_estimates(t):
    return t.read("documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"), X.token_estimate_v1(F.col("text")).alias("tokens_v1"))


@query("", "select doc_id, length(left(text, 12000))::int as n_kept, md5(left(text, 12000)) as digest from documents")
def content_cap(t):
    cut = X.content_cap(F.col("text"))
    return t.read("documents").select("doc_id", F.char_length(cut).alias("n_kept"), F.md5(cut).alias("digest"))


@query("", "select doc_id, left(sha256(text), 16) as hash, sha256(text) as hash_v1 from documents")
def file_hash(t):
    return t.read("documents").select("doc_id", X.file_hash(F.col("text")).alias("hash"), X.file_hash_v1(F.col("text")).alias("hash_v1"))


@query("", "select doc_id, len(string_split(text, chr(10)))::int as n_lines, case when text = '' then 0 else len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) end::int as n_lines_v1 from documents")
def line_counts(t):
    return t.read("documents").select("doc_id", X.line_count(F.col("text")).alias("n_lines"), X.line_count_v1(F.col("text")).alias("n_lines_v1"))


_UUID = "concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-5', substr({h}, 14, 3), '-', substr('89ab', ('0x' || substr({h}, 17, 1))::int % 4 + 1, 1), substr({h}, 18, 3), '-', substr({h}, 21, 12))"


@query("v_files", f"select path, {_UUID.format(h='a')} as id, {_UUID.format(h='b')} as id_v1 from (select path, sha1(unhex('{X.NAMESPACE_DNS}') || encode(path)) as a, sha1(unhex('{X.NAMESPACE_URL}') || encode(path)) as b from v_files)")
def project_uuid5(t):
    paths = t.view("v_files").select("path")
    return paths.select("path", X.uuid5(F.col("path")).alias("id"), X.uuid5(F.col("path"), X.NAMESPACE_URL).alias("id_v1"))


@query("v_files", f"@{_BLOCKS} select file_id, block, start_line, end_line, content, greatest(1, length(content) // 4)::int as token_count from blocks")
def line_blocks_v1(t):
    return _blocks(t)


@query("v_files", """select file_id, 'module' as chunk_type, content, 1 as start_line, n::int as end_line, greatest(1, length(content) // 4)::int as token_count from (
  select file_id, array_to_string(list_filter(lines, lambda x: starts_with(x, 'import ')), chr(10)) as content, len(lines) as n, len(list_filter(lines, lambda x: starts_with(x, 'import '))) as k from (
    select file_id, string_split(regexp_replace(replace(content, chr(10), concat(chr(10), 'import ')), '\\n$', ''), chr(10)) as lines from v_files)) where k > 0""")
def module_lines_v1(t):
    changed = t.view("v_files").select("file_id", F.replace(F.col("content"), F.lit("\n"), F.lit("\nimport ")).alias("content"))
    return chunking.module_lines(changed)


@query("v_files", "select file_id, 'module' as chunk_type, left(content, 12000) as content, 1 as start_line, len(string_split(content, chr(10)))::int as end_line, ceil(length(content) / 4)::int as token_count from v_files where file_id % 3 <> 0 and len(string_split(content, chr(10))) >= 3")
def module_fallback(t):
    files = t.view("v_files").select("file_id", "content")
    return chunking.module_fallback(files, files.filter("file_id % 3 = 0").select("file_id"))


_PATHS = "select doc_id, concat(case doc_id % 6 when 0 then 'src' when 1 then 'node_modules/x' when 2 then 'a/dist/b' when 3 then 'distribution' when 4 then 'lib/.git' else 'deep/er' end, '/f', doc_id::varchar, case doc_id % 7 when 0 then '.py' when 1 then '.ts' when 2 then '.TSX' when 3 then '.js' when 4 then '.jsx' when 5 then '.md' else '' end) as path from documents"


def _paths(t) -> DataFrame:
    n = F.col("doc_id")
    folder = F.element_at(F.array(*map(F.lit, ("src", "node_modules/x", "a/dist/b", "distribution", "lib/.git", "deep/er"))), (n % 6 + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, (".py", ".ts", ".TSX", ".js", ".jsx", ".md", ""))), (n % 7 + 1).cast("int"))
    return t.read("documents").select("doc_id", F.concat(folder, F.lit("/f"), n.cast("string"), ending).alias("path"))


@query("", f"select path, case when lower(path) like '%.py' then 'python' when lower(path) like '%.js' or lower(path) like '%.jsx' then 'javascript' when lower(path) like '%.tsx' then 'tsx' when lower(path) like '%.ts' then 'typescript' end as language from ({_PATHS})")
def language_by_ext(t):
    return _paths(t).select("path", X.language(F.col("path")).alias("language"))


@query("", f"select path, doc_id % 6 in (1, 2, 4) as ignored, doc_id % 6 in (1, 2, 3, 4) as ignored_by_watcher, doc_id % 7 < 5 as supported, doc_id % 7 in (0, 1, 3, 4) as supported_by_watcher from ({_PATHS})")
def ignore_filter(t):
    p = F.col("path")
    return _paths(t).select("path", X.ignored(p).alias("ignored"), X.ignored_by_watcher(p).alias("ignored_by_watcher"), X.supported(p).alias("supported"), X.supported(p, True).alias("supported_by_watcher"))


# Snapshots: the stored files lack every seventh document, have another hash for every third and some files more

_OLD = "old as (select project_id, path, file_id, case when file_id % 3 = 0 then 'stale' else left(sha256(content), 16) end as hash from v_files where file_id % 7 <> 0 union all select project_id, concat(path, '.old'), -file_id, 'gone' from v_files where file_id % 11 = 0)"
_NEW = "new as (select project_id, path, file_id, left(sha256(content), 16) as hash from v_files)"


def _snapshots(t) -> tuple[DataFrame, DataFrame]:
    new = t.view("v_files").select("project_id", "path", "file_id", X.file_hash(F.col("content")).alias("hash"))
    old = new.filter("file_id % 7 <> 0").withColumn("hash", F.when(F.col("file_id") % 3 == 0, F.lit("stale")).otherwise(F.col("hash")))
    more = new.filter("file_id % 11 = 0").select("project_id", F.concat("path", F.lit(".old")).alias("path"), (-F.col("file_id")).alias("file_id"), F.lit("gone").alias("hash"))
    return new, old.unionByName(more)


@query("v_files", f"@{_OLD}, {_NEW} select n.project_id, n.path, n.file_id, n.hash from new n left join old o using (project_id, path) where o.hash is distinct from n.hash")
def changed_files(t):
    return sources.changed(*_snapshots(t)).select("project_id", "path", "file_id", "hash")


@query("v_files", f"@{_OLD}, {_NEW} select project_id, path, file_id, hash from old where (project_id, path) not in (select project_id, path from new)")
def deleted_files(t):
    return sources.vanished(*_snapshots(t)).select("project_id", "path", "file_id", "hash")


@query("v_files", f"@{_OLD}, {_NEW} select * from new union all select * from old where (project_id, path) not in (select project_id, path from new)")
def upsert_files(t):
    new, old = _snapshots(t)
    return store.upserted(old, new, ["project_id", "path"])


@query("v_files", f"@{_OLD}, {_NEW} select count(*) filter (n.hash is distinct from o.hash) as files_indexed, count(*) filter (n.hash is not distinct from o.hash) as files_skipped, count(*) as total_files from new n left join old o using (project_id, path)")
def index_counts(t):
    return sources.index_counts(*_snapshots(t))


@query("v_candidates v_edges", "select 'chunk' as kind, chunk_id as a, file_id as b from v_candidates where file_id >= 10 union all select 'edge', from_id, to_id from v_edges where from_id % 50 >= 10 and to_id % 50 >= 10 union all select 'vector', vec_id, 0 from embeddings where vec_id % 50 >= 10")
def cascade_delete(t):
    chunks = t.view("v_candidates").select("chunk_id", "file_id")
    edges = t.view("v_edges").select(F.col("from_id").alias("from_chunk"), F.col("to_id").alias("to_chunk"))
    kept = store.cascade(chunks.select("file_id").distinct().filter("file_id < 10"), chunks, t.read("embeddings").select(F.col("vec_id").alias("chunk_id")), edges)
    rows = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).cast("long").alias("a"), b.cast("long").alias("b"))
    return rows(kept[0], "chunk", "chunk_id", F.col("file_id")).unionByName(rows(kept[1], "vector", "chunk_id", F.lit(0))).unionByName(rows(kept[2], "edge", "from_chunk", F.col("to_chunk")))


# Memories

def _memories(t) -> DataFrame:
    return t.view("v_memories").join(t.read("embeddings").select("vec_id", "embedding"), "vec_id")


def _memory_topk(t) -> DataFrame:
    return context.search_memories(_memories(t), t.vector(), 5)


@query("v_memories", f"select row_number() over (order by {_COS} desc, created_at desc, memory_id)::int as rank, memory_id, memory_type, content, created_at, round({_COS}, 6) as score from v_memories join embeddings using (vec_id), {_Q} order by {_COS} desc, created_at desc, memory_id limit 5")
def memory_topk(t):
    return _memory_topk(t).select("rank", "memory_id", "memory_type", "content", "created_at", six("score"))


@query("v_memories", "select memory_id, memory_type, content, created_at from v_memories where project_id = 'p2' order by created_at desc")
def list_memories(t):
    return context.list_memories(t.view("v_memories"), "p2").select("memory_id", "memory_type", "content", "created_at")


@query("v_memories", "select memory_id, memory_type from v_memories where memory_id <> '3-0'")
def delete_memory(t):
    gone = t.view("v_memories").filter("memory_id = '3-0' AND project_id = 'p3'")
    return store.without(t.view("v_memories"), gone, memory_id="memory_id").select("memory_id", "memory_type")


@query("v_memories", "select memory_id, memory_type, content from v_memories union all select 'new', 'context_note', 'a note'")
def remember(t):
    old = t.view("v_memories").select("memory_id", "memory_type", "content")
    row, _ = engine.memory_row(t.spark, "p", "session", "idea", "  a note ", F.lit(0).cast("timestamp"))
    return store.upserted(old, row.select(F.lit("new").alias("memory_id"), "memory_type", "content"), ["memory_id"])


# Code and streams

def _generated(t, language: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    body = {
        "python": F.concat(F.lit("from .m"), n, F.lit(" import a\n\nclass C"), n, F.lit(":\n    def f(self):\n        x = 1\n        return x\n\ndef short(): pass\n")),
        "typescript": F.concat(F.lit("import {a} from './m"), n, F.lit("';\nexport class C"), n, F.lit(" {\n  run(x: number): number {\n    const s = `}${x}`;\n    return x;\n  }\n}\nconst g = (y) => {\n  // }\n  return y;\n};\n")),
    }[language]
    path = F.concat(F.lit("src/f"), n, F.lit(".py" if language == "python" else ".ts"))
    return t.read("documents").select(F.col("doc_id").cast("string").alias("file_id"), path.alias("path"), F.lit(language).alias("language"), body.alias("content"))


def _of_code(t, language: str, older: bool) -> DataFrame:
    return chunking.chunks(_generated(t, language), older).select("file_id", "chunk_type", "name", "start_line", "end_line", "token_count")


@query("", """select doc_id::varchar as file_id, u.t as chunk_type, case when u.n = 'C' then concat('C', doc_id::varchar) else u.n end as name, u.a::int as start_line, u.b::int as end_line from documents,
(values ('class', 'C', 3, 6), ('function', 'f', 4, 6)) u(t, n, a, b)""")
def python_chunks(t):
    return _of_code(t, "python", False).drop("token_count")


@query("", """select doc_id::varchar as file_id, u.t as chunk_type, case when u.n = 'C' then concat('C', doc_id::varchar) else u.n end as name, u.a::int as start_line, u.b::int as end_line from documents,
(values ('class', 'C', 2, 7), ('function', 'run', 3, 6), ('function', null, 8, 11)) u(t, n, a, b)""")
def js_chunks(t):
    return _of_code(t, "typescript", False).drop("token_count")


@query("", """select doc_id::varchar as file_id, u.t as chunk_type, case when u.n = 'C' then concat('C', doc_id::varchar) else u.n end as name, u.a::int as start_line, u.b::int as end_line, case when u.k < 0 then (u.base + u.times * length(doc_id::varchar)) // 4 else u.k end::int as token_count from documents,
(values ('module', null, 1, 8, -1, 15, 1), ('class', 'C', 3, 6, -1, 56, 1), ('function', 'short', 8, 8, 4, 0, 0)) u(t, n, a, b, k, base, times)""")
def python_chunks_v1(t):
    return _of_code(t, "python", True)


@query("", "select concat('src/f', doc_id::varchar, '.ts') as from_path, concat('./m', doc_id::varchar) as specifier from documents")
def code_imports(t):
    return chunking.imports(_generated(t, "typescript"))


_TREE = """nations as (select n_nationkey as k, n_regionkey as r, p.p from nation, (values ('one'), ('two')) p(p) where not (p.p = 'one' and n_nationkey % 5 = 4)),
files as (select p, concat('pkg/n', k, '.py') as path, concat('f', k) as name, concat('pkg/r', r, '/__init__.py') as target, p = 'one' and k % 3 = 0 as changed from nations
  union all select p, concat('pkg/r', r_regionkey, '/__init__.py'), 'f', null, false from region, (values ('one'), ('two')) p(p)
  union all select p, 'pkg/_own/x.py', 'x', null, false from (values ('one'), ('two')) p(p) union all select p, 'empty.py', null, null, false from (values ('one'), ('two')) p(p))"""


@query("", f"""with {_TREE} select 'file' as kind, p as project, path, 'python' as what from files union all select 'chunk', p, path, case when changed then concat(name, '_2') else name end from files where name is not null
union all select 'edge', p, path, target from files where target is not null union all select 'status', p, concat(count(*)::varchar, ' files'), concat(count(name)::varchar, ' chunks') from files group by p""")
def incremental_index(t):
    """Two trees of a module for each nation, which import their region's package. One tree then changes, and is brought up to
    date by the paths that changed or went: its files, chunks and edges, and the other's, which stay as they were."""
    scratch = Scratch(t.spark, "tree")
    nations = [(r[0], r[1]) for r in t.read("nation").select("n_nationkey", "n_regionkey").collect()]
    regions = [r[0] for r in t.read("region").select("r_regionkey").collect()]
    own = lambda key, region, tail: f"from .r{region} import f\n\n\ndef f{key}{tail}():\n    x = 1\n    return x\n"
    tree = {f"pkg/n{k}.py": own(k, r, "") for k, r in nations} | {f"pkg/r{r}/__init__.py": "def f():\n    x = 1\n    return x\n" for r in regions}
    tree |= {"pkg/_own/x.py": "def x():\n    a = 1\n    return a\n", "empty.py": "", "node_modules/c.py": "def no():\n    a = 1\n    return a\n"}
    lode = engine.Engine(t.spark, f"{scratch.root}/store")
    roots = {p: f"{scratch.root}/{p}" for p in ("one", "two")}
    for root in roots.values():
        write_tree(t.spark, root, tree)
        lode.index(root)
    changed = {f"pkg/n{k}.py": own(k, r, "_2") for k, r in nations if k % 3 == 0 and k % 5 != 4}
    gone = [f"pkg/n{k}.py" for k, _ in nations if k % 5 == 4]
    write_tree(t.spark, roots["one"], changed)
    remove_from_tree(t.spark, roots["one"], gone)
    lode.index(roots["one"], paths=[*changed, *gone])
    rows = []
    for p, root in roots.items():
        of = lode.candidates(root).select("chunk_id", "path", "name")
        ends = of.select(F.col("chunk_id").alias("from_id"), "path"), of.select(F.col("chunk_id").alias("to_id"), F.col("path").alias("what"))
        edges = lode.edges(root).join(ends[0], "from_id").join(ends[1], "to_id").select(F.lit("edge").alias("kind"), "path", "what")
        status = lode.status(root).select(F.lit("status").alias("kind"), F.concat(F.col("n_files").cast("string"), F.lit(" files")).alias("path"), F.concat(F.col("n_chunks").cast("string"), F.lit(" chunks")).alias("what"))
        files = lode.store(root).read("files").select(F.lit("file").alias("kind"), "path", F.col("language").alias("what"))
        parts = [files, of.select(F.lit("chunk").alias("kind"), "path", F.col("name").alias("what")), edges, status]
        rows += [part.select("kind", F.lit(p).alias("project"), "path", "what") for part in parts]
    return functools.reduce(DataFrame.unionByName, rows)


@query("", """with timed as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as fresh from events),
numbered as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from timed),
closed as (select user_id, session from numbered group by 1, 2 having max(ts) + interval 30 minute <= (select max(ts) from events)),
types as (select distinct user_id, session, event_type from numbered semi join closed using (user_id, session))
select a.event_type as file_a, b.event_type as file_b, count(*) as count from types a join types b on a.user_id = b.user_id and a.session = b.session and a.event_type < b.event_type group by 1, 2""")
def streaming_coedit(t):
    """The closed sessions of the events table read as a stream, each emitted once when the watermark passes its end, and how
    often two event types meet in one of a user's sessions."""
    scratch = Scratch(t.spark, "stream")
    table = t.read("events").schema
    stream = t.spark.readStream.schema(table).parquet(f"{t.folder}/events.parque[t]")  # a pattern, as the table may be a file or a folder
    found = watch.bursts(stream.select("user_id", "event_type", "ts"), "user_id", "ts", "event_type", "30 minutes", "0 seconds")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{scratch.root}/sessions/batch={number}")

    started = found.writeStream.outputMode("append").option("checkpointLocation", f"{scratch.root}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    started.awaitTermination()
    sessions = t.spark.read.parquet(f"{scratch.root}/sessions").drop("batch")
    return watch.coedits(sessions, "user_id").select("file_a", "file_b", "count")
