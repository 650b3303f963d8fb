import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.functions import text as X
from lodestone.functions import vector as V
from lodestone.operators import chunking, coedit, embed, graph, rank, vector


def one(spark, expr, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, value if not isinstance(value, (str, int, float)) else F.lit(value))
    return df.select(expr.alias("x")).first().x


def test_cosine(spark):
    rows = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "embedding array<float>")
    assert [round(r.s, 9) for r in rows.select(V.cosine_to(F.col("embedding"), [1.0, 0.0]).alias("s")).collect()] == [0.0, 0.6]
    assert rows.select(V.cosine(F.col("embedding"), F.col("embedding")).alias("s")).collect()[1].s == pytest.approx(1)


def test_blobs(spark):
    rows = spark.createDataFrame([([1.5, -2.25],), ([],), (None,)], "v array<float>")
    assert [r.v for r in rows.select(V.from_blob(V.to_blob("v")).alias("v")).collect()] == [[1.5, -2.25], [], None]
    assert bytes(rows.select(V.to_blob("v").alias("b")).first().b) == np.array([1.5, -2.25], "<f4").tobytes()


def test_topk(spark):
    rows = spark.createDataFrame([(i, "class" if i % 2 else "module", [1.0, float(i // 2)]) for i in range(3)], "chunk_id long, chunk_type string, embedding array<float>")
    assert [r.chunk_id for r in vector.topk(rows, [1.0, 0.0], 10).collect()] == [0, 1, 2]
    assert [r.chunk_id for r in vector.topk(rows, [1.0, 0.0], 2, "class").collect()] == [1]
    with pytest.raises(ValueError):
        vector.topk(rows, [1.0, 0.0], -1)
    got = vector.knn_join(rows.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector")), rows, 2).collect()
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in got) == [(0, 1, 0), (0, 2, 1), (1, 1, 0), (1, 2, 1), (2, 1, 2), (2, 2, 0)]


def test_knn_join_in_blocks(spark):
    rows = spark.range(25, numPartitions=3).select(F.col("id").alias("chunk_id"), F.array(F.col("id").cast("float"), F.lit(3.0).cast("float")).alias("embedding"))
    queries = rows.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())
    want = found(vector.knn_join(queries, rows, 3))
    for block in (4, 25, 100):
        assert found(vector.knn_join(queries, rows, 3, block=block)) == want
    assert len(want) == 75 and vector.knn_join(queries.limit(0), rows, 3).count() == 0


def test_limits_reach_every_task(spark):
    rows = spark.range(100, numPartitions=4).select(F.col("id").alias("chunk_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    plan = vector.cosine_scores(rows, [1.0, 0.0]).orderBy(F.desc("score")).limit(5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_recency(spark):
    def of(values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, m long")
        return [r.recency for r in rank.recency(rows, F.col("m")).orderBy("i").collect()]

    assert of([5, 5, 5]) == [0, 0, 0] and of([10, 20, None]) == [1, 0, 1] and of([None, None]) == [None, None]


def test_final_score(spark):
    null = F.lit(None).cast("double")
    assert one(spark, rank.final_score(F.lit(0.8), null, null, null)) == 0.59
    assert one(spark, X.round4(F.lit(-0.00005))) == 0 and one(spark, X.round4(F.lit(0.12345))) == 0.1235


def test_budget(spark):
    rows = spark.createDataFrame([(1, 60, "a"), (2, 50, "b"), (3, 10, "c")], "final_rank int, tokens int, part string")
    fits = rank.budget_prefix(rows, F.col("tokens"), 100)
    assert [r.final_rank for r in fits.collect()] == [1]
    assert rank.budget_prefix(rows, F.col("tokens"), 50).count() == 0
    assert tuple(rank.assembled(rank.budget_prefix(rows, F.col("tokens"), 110), F.col("part"), F.col("tokens")).first()) == ("a\n\nb", 110, 2)
    assert tuple(rank.assembled(rows.limit(0), F.col("part"), F.col("tokens")).first()) == ("", 0, 0)


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "calls", 1.0) for a, b in pairs], "from_id string, to_id string, edge_type string, weight double")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


@pytest.mark.parametrize("small", [0, graph.SMALL])
def test_traversals(spark, monkeypatch, small):
    monkeypatch.setattr(graph.bfs, "__defaults__", ("both", 2, small))
    chain = edges(spark, [("a", "b"), ("b", "c"), ("x", "y")])
    assert {tuple(r) for r in graph.bfs(chain, nodes(spark, "b"), "both", 1).collect()} == {("b", 0), ("a", 1), ("c", 1)}
    assert {tuple(r) for r in graph.bfs(chain, nodes(spark, "a"), "outgoing", None).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    wanted = nodes(spark, "a", "b", "c", "x", "z")
    assert {tuple(r) for r in graph.distances(chain, nodes(spark, "a"), wanted).collect()} == {("a", 0.0), ("b", 0.5), ("c", 1.0), ("x", 1.0), ("z", 1.0)}
    assert {tuple(r) for r in graph.distances(chain, nodes(spark, "z"), wanted).collect()} == {("a", 1.0), ("b", 1.0), ("c", 1.0), ("x", 1.0), ("z", 0.0)}
    assert {tuple(r) for r in graph.distances_v1(chain, nodes(spark, "a"), wanted).collect()} == {("a", 0.0), ("b", 0.2), ("c", 0.4), ("x", 1.0), ("z", 1.0)}
    assert {r.distance for r in graph.distances_v1(chain, nodes(spark, "z"), wanted).collect()} == {1.0}
    with pytest.raises(ValueError):
        graph.bfs(chain, nodes(spark, "a"), "up")


def test_the_walking_task_reads_steps_only(spark):
    """What edges are joined from doesn't run in the one task that walks them."""
    known = nodes(spark, "a", "b", "c")
    joined = edges(spark, [("a", "b"), ("b", "c"), ("c", "x")]).join(known.withColumnRenamed("node", "to_id").hint("merge"), "to_id", "left_semi").distinct()
    found = graph.bfs(joined, nodes(spark, "a"), "outgoing", None)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_both_ways_to_walk_agree(spark):
    import random

    rng = random.Random(3)
    many = edges(spark, [(str(rng.randint(0, 60)), str(rng.randint(0, 60))) for _ in range(90)])
    for way in schema.DIRECTIONS:
        for depth in (1, 3, None):
            a, b = ({tuple(r) for r in graph.bfs(many, nodes(spark, "1", "2"), way, depth, small).collect()} for small in (0, 1000))
            assert a == b


def test_subgraphs(spark):
    pair = edges(spark, [("a", "b"), ("b", "a")])
    assert [(r.from_id, r.to_id) for r in graph.subgraph(pair, nodes(spark, "a"), 1, "both").collect()] == [("a", "b")]
    triangle = edges(spark, [("a", "b"), ("a", "c"), ("b", "c")])
    assert {(r.from_id, r.to_id) for r in graph.subgraph(triangle, nodes(spark, "a"), 1, "both").collect()} == {("a", "b"), ("a", "c")}
    assert graph.induced_subgraph_v1(triangle, nodes(spark, "a"), 1, "both").count() == 3
    assert {r.node: (r.n_out, r.n_in) for r in graph.degrees(triangle).collect()} == {"a": (2, 0), "b": (1, 1), "c": (0, 2)}


def test_edge_tables(spark):
    rows = spark.createDataFrame([("a", "b", "calls", 1.0, 1), ("a", "b", "calls", 3.0, 2)], "from_id string, to_id string, edge_type string, weight double, version int")
    assert [tuple(r) for r in graph.upserted(rows, "version").collect()] == [("a:b:calls", "a", "b", "calls", 3.0)]


def test_code_edges(spark):
    rows = spark.createDataFrame([(1, 1, "f", "g(); if (h(1)) f()"), (2, 2, "g", "class X extends f"), (3, 3, "f", "len(x)"), (4, 4, "h", "g (2); class Y implements g"), (5, 5, None, "")], "chunk_id long, seq long, name string, content string")
    assert {tuple(r) for r in graph.code_edges_v1(rows).collect()} == {(1, 2, "calls", 0.8), (1, 4, "calls", 0.8), (1, 3, "calls", 0.8), (2, 3, "extends", 1.0), (4, 2, "extends", 1.0)}


def test_coedits(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "z"), (4, "b"), (4, "a"), (4, "a")], "session_id int, file_id string")
    counts = coedit.pairs(rows, F.col("session_id"))
    assert {tuple(r) for r in counts.collect()} == {("a", "b", 3, 4), ("a", "c", 1, 2), ("b", "c", 1, 2)}
    both = coedit.merged(counts, counts)
    assert {r["count"] for r in both.filter("file_a = 'a' AND file_b = 'b'").collect()} == {6}


def test_paths(spark):
    made = X.import_candidates(F.lit("./x"), F.lit("src/a.ts"))
    assert one(spark, made) == ["src/x.ts", "src/x.tsx", "src/x.js", "src/x.jsx", "src/x/index.ts", "src/x/index.tsx", "src/x/index.js", "src/x"]
    assert one(spark, X.import_candidates(F.lit("react"), F.lit("a.ts"))) == []
    assert one(spark, X.normalised(F.lit("a/./b//../c/../../d"))) == "d" and one(spark, X.normalised(F.lit("../a"))) == "../a"
    assert one(spark, X.relative_to(F.lit("C:\\p\\src\\a.py"), F.lit("C:\\p"))) == "src/a.py"
    assert one(spark, X.python_specifier(F.lit(2), F.lit("a.b"))) == "../a/b"
    assert one(spark, X.strip_quotes(F.lit("'a\""))) == "a"


def test_sizes(spark):
    assert [one(spark, f(F.lit("abcde"))) for f in (X.token_estimate, X.token_estimate_v1)] == [2, 1]
    assert one(spark, X.utf16_length(F.lit("a👍"))) == 3 and one(spark, X.token_estimate_v1(F.lit(""))) == 1
    assert [one(spark, f(F.lit("a\nb\n"))) for f in (X.line_count, X.line_count_v1)] == [3, 2]


def test_uuid5(spark):
    for name in ("", "/a/é", "x" * 300):
        assert one(spark, X.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
        assert one(spark, X.uuid5(F.lit(name), X.NAMESPACE_URL)) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_enums(spark):
    assert one(spark, schema.memory_type(F.lit("todo"))) == "todo" and one(spark, schema.memory_type(F.lit("x"))) == "context_note"
    assert [schema.ui_limit(v) for v in (None, "7", "x", 99)] == [15, 7, 15, 50]


def test_chunks():
    py = chunking.chunks_of("class A:\n    def f(self):\n        return 1\n\n    async def g(self):\n        a = 1\n        return a\n\ndef s(): pass\n", "python")
    assert [(k, n, a, b) for k, n, _, a, b, _ in py] == [("class", "A", 1, 7), ("function", "g", 5, 7)]
    old = chunking.chunks_of_v1("import os\nclass A:\n    def f(self):\n        return 1\ndef s(): pass\n", "python")
    assert [(k, n, a, b) for k, n, _, a, b, _ in old] == [("module", None, 1, 5), ("class", "A", 2, 4), ("function", "s", 5, 5)]
    assert chunking.chunks_of("x\n", "python") == [] and chunking.chunks_of("def (\n\n\n", "python")[0][0] == "module"
    assert [c[3:5] for c in chunking.chunks_of_v1("a\n" * 120, None)] == [(1, 50), (51, 100), (101, 120)] and chunking.chunks_of_v1(" \n", "python") == []
    long = chunking.chunks_of("def f():\n" + "    x = 1\n" * 3000, "python")[0]
    assert len(long[2]) == schema.MAX_CONTENT and long[5] > schema.MAX_CONTENT / 4


def test_javascript():
    code = """import a from 'm'; // class Not {
import './side';
export default function main(x) {
  if (x) { return /[}/]/.test("}"); }
  return `a ${ (() => { return '}' })() } b`;
}
abstract class A<T> extends B {
  private async load(p: string): Promise<T> {
    for (const i of p) {
      go(i);
    }
  }
  get size() {
    return 1;

  }
}
const k = async x => {
  /* } */
  return x;
};
list.map((v) =>
  v
    .more());
"""
    got = [(k, n, a, b) for k, n, a, b, _ in chunking.javascript_nodes(code)]
    assert ("function", "main", 3, 6) in got and ("class", "A", 7, 17) in got and ("function", "load", 8, 12) in got and ("function", "size", 13, 16) in got
    assert ("function", None, 18, 21) in got and ("function", None, 5, 5) in got and ("function", None, 22, 24) in got
    assert not any(n in ("if", "for", "Not", "go") for _, n, _, _ in got)
    assert chunking.javascript_imports(code) == ["m", "./side"]
    assert chunking.python_imports("from . import a\nfrom ..b.c import d\nfrom e import f\nimport g\n") == ["./", "../b/c", "e"]
    assert chunking.javascript_nodes("class { ( => `${ `${") == []


def test_hashing_provider(spark):
    rows = spark.createDataFrame([("a", "one two"), ("b", None)], "chunk_id string, content string")
    got = {r.chunk_id: r for r in embed.embedded(rows, embed.Hashing(16)).collect()}
    assert math.isclose(sum(x * x for x in got["a"].vector), 1, abs_tol=1e-6) and not any(got["b"].vector) and got["a"].dims == 16


def test_vectors_that_do_not_fit(spark):
    """Null vectors and those with a null take no part; shorter ones count as filled with zeros."""
    rows = spark.createDataFrame([(0, "m", [1.0, 0.0]), (1, "m", None), (2, "m", [1.0]), (3, "m", [1.0, 0.0, 1.0]), (4, "m", [None, 1.0]), (5, "m", [])], "chunk_id long, chunk_type string, embedding array<float>")
    order = [0, 2, 3, 5]
    for found in (vector.topk(rows, [1.0, 0.0], 9), vector.topk_v1(rows, [1.0, 0.0], 9), vector.inner_product_topk_v1(rows, [1.0, 0.0], 9)):
        got = found.orderBy("rank").collect()
        assert [r.chunk_id for r in got] == order and [round(r.score, 3) for r in got] == [1.0, 1.0, 0.707, 0.0]
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, None), (9, [2.0])], "query_id long, vector array<float>")
    got = vector.knn_join(queries, rows, 9).collect()
    assert [[r.chunk_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (7, 8, 9)] == [order, [], order]


def test_python_rounding(spark):
    rng = random.Random(1)
    values = [0.03125, 0.00005, 0.12345, 0.99995, 0.0, 1.0, -0.12345] + [round(rng.uniform(-1, 1), 5) for _ in range(500)] + [k / 128 for k in range(-130, 130)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", X.python_round4(F.col("x")).alias("y")).collect()
    assert all(r.y == round(r.x, 4) for r in got)


def test_walks_of_edges_with_null_ends(spark):
    edges = spark.createDataFrame([(1, 2), (None, 3), (2, None), (2, 4), (None, None), (5, 6)], "from_id long, to_id long")
    roots = spark.createDataFrame([(1,), (None,), (9,)], "node long")
    for direction, want in (("both", {1: 0, 2: 1, 4: 2, 9: 0}), ("incoming", {1: 0, 9: 0}), ("outgoing", {1: 0, 2: 1, 4: 2, 9: 0})):
        for small in (100, 0):
            assert {r.node: r.distance for r in graph.bfs(edges, roots, direction, None, small).collect()} == want


def test_pairs_of_a_mass_change(spark):
    rows = [(s, f"f{i:03}") for s, n in ((1, 40), (2, 3), (3, 1)) for i in range(n)]
    sessions = spark.createDataFrame(rows, "session_id long, file_id string")
    want = sorted((r.file_a, r.file_b, r["count"]) for r in coedit.pairs(sessions).collect())
    assert len(want) == 780 and sorted((r.file_a, r.file_b, r["count"]) for r in coedit.pairs(sessions, block=7).collect()) == want
