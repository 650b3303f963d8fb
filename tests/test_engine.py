import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.operators import embed
from lodestone.plans.engine import Engine, project_id, write_options
from lodestone.schema import Options
from lodestone.sources import files as sources
from lodestone.sources.store import Conflict, Store, retried

PY = "from .util import helper\n\n\nclass Store:\n    def load(self):\n        x = helper()\n        return x\n\n\nasync def run(a):\n    y = a\n    return y\n"
TS = "import { x } from './lib';\nimport y from \"react\";\nexport class Box {\n  open(): void {\n    x(`}${y}`);\n  }\n}\nconst f = async (a) => {\n  return a;\n};\n"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    for path, text in {"pkg/a.py": PY, "pkg/util.py": "def helper():\n    z = 1\n    return z\n", "web/b.ts": TS, "web/lib.ts": "export function x() {\n  return 1;\n}\n", "web/c.JSX": "const C = () => (\n  <div>\n  </div>\n);\n", "empty.py": "", "node_modules/n.js": "a\nb\nc\n", "note.md": "no"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


def test_scan(spark, tree):
    got = sources.scan(spark, str(tree))
    assert paths(got) == ["empty.py", "pkg/a.py", "pkg/util.py", "web/b.ts", "web/c.JSX", "web/lib.ts"]
    assert {r.path: r.language for r in got.collect()}["web/c.JSX"] == "javascript"
    assert all(len(r.hash) == 64 for r in sources.scan(spark, str(tree), older=True).collect())


def test_index_again_and_again(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    root = str(tree)
    first = engine.index(root)
    assert first["success"], first
    assert (first["files_indexed"], first["files_skipped"], first["total_files"]) == (6, 0, 6)
    names = sorted((r.path, r.name or "", r.chunk_type) for r in engine.candidates(root).collect())
    assert ("pkg/a.py", "Store", "class") in names and ("pkg/a.py", "load", "function") in names and ("pkg/a.py", "run", "function") in names
    assert ("web/b.ts", "Box", "class") in names and ("web/b.ts", "open", "function") in names and ("web/b.ts", "", "function") in names
    assert engine.index(root)["files_indexed"] == 0
    edges = {(r.from_id, r.to_id) for r in engine.edges(root).collect()}
    of = {r.chunk_id: r.path for r in engine.candidates(root).collect()}
    assert {(of[a], of[b]) for a, b in edges} == {("pkg/a.py", "pkg/util.py"), ("web/b.ts", "web/lib.ts")}

    (tree / "pkg/util.py").write_text("def helper():\n    z = 2\n    return z\n\n\ndef more():\n    a = 1\n    return a\n")
    (tree / "web/lib.ts").unlink()
    (tree / "new.py").write_text("def fresh():\n    a = 1\n    return a\n")
    again = engine.index(root)
    assert (again["files_indexed"], again["files_skipped"]) == (2, 4)
    fresh = Engine(spark, str(tmp_path / "other"))
    fresh.index(root)
    same = lambda e: sorted((r.path, r.name or "", r.start_line, r.content) for r in e.candidates(root).collect())
    assert same(engine) == same(fresh)
    assert engine.index(root, force=True)["files_indexed"] == 6 and same(engine) == same(fresh)
    assert not engine.candidates(root).filter("path = 'web/lib.ts'").count()
    row = engine.status(root).first()
    assert (row.indexed, row.n_files, row.n_chunks) == (True, 6, engine.candidates(root).count())
    assert engine.store(root).vacuum() > 0 and same(engine) == same(fresh)


def test_targeted_index_records_coedits(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    root = str(tree)
    engine.index(root)
    (tree / "pkg/a.py").write_text(PY + "\n\ndef last():\n    a = 1\n    return a\n")
    (tree / "web/b.ts").unlink()
    done = engine.index(root, paths=["pkg/a.py", "web/b.ts"])
    assert done["files_indexed"] == 1
    assert "web/b.ts" not in paths(engine.store(root).read("files")) and engine.candidates(root).filter("name = 'last'").count() == 1
    engine.record_coedits(root, ["pkg\\a.py", "web/b.ts", "empty.py"])
    found = {r.path: r.score for r in engine.coedit_scores(root, "pkg/a.py", spark.createDataFrame([("web/b.ts",), ("empty.py",), ("x",)], "path string")).collect()}
    assert found == {"web/b.ts": 1.0, "empty.py": 0.5, "x": 0.0}
    assert engine.coedit_scores(root, "unseen.py", spark.createDataFrame([("x",)], "path string")).count() == 0


def test_search_context_and_graph(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), embed.Hashing(64))
    root = str(tree)
    engine.index(root)
    assert engine.search("helper", root, 3).count() == 3 and engine.search("  ", root).count() == 0
    assert {r.chunk_type for r in engine.search("helper", root, 9, "class").collect()} == {"class"}
    engine.remember(root, "s", "idea", "  the helper loads ")
    found = engine.query_context("helper load", root, "pkg/a.py")
    assert found["sources"] and found["token_count"] > 0 and found["memories"][0]["memory_type"] == "context_note"
    assert engine.query_context("helper", root, token_budget=0)["sources"] == []
    nodes, edges = engine.graph("Store", root)
    assert paths(nodes) == ["pkg/a.py", "pkg/util.py"] and edges.count() == 1
    assert engine.graph("nothing", root)[0].count() == 0
    nodes, edges = engine.file_graph(root)
    assert nodes.count() == 6 and edges.count() == 2
    start = nodes.first()
    assert engine.file_coedits(root, start.path).count() == 0


def test_memories(spark, tmp_path):
    clock = iter(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(100))
    engine = Engine(spark, str(tmp_path / "store"), clock=lambda: next(clock))
    assert not engine.remember("/r", "s", "todo", "  ")["success"]
    a, b = (engine.remember("/r", "s", "todo", t)["id"] for t in ("first note", "second note"))
    assert [r.memory_id for r in engine.list_memories("/r").collect()] == [b, a]
    assert [r.memory_id for r in engine.search_memories("first", "/r", 1).collect()] == [a]
    assert not engine.delete_memory("/other", a)["success"] and engine.delete_memory("/r", a)["success"]
    assert engine.list_memories("/r").count() == 1 and engine.store("/r").read("memory_embeddings").count() == 1


def test_errors_become_rows(spark, tmp_path):
    done = Engine(spark, str(tmp_path / "store")).index(str(tmp_path / "missing"))
    assert not done["success"] and done["error"] and done["project_id"] == project_id(str(tmp_path / "missing"))


def test_transactions_take_effect_together(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("m", "p")], "id string, project_id string")
    with pytest.raises(RuntimeError), store.transaction():
        store.write("memories", rows)
        assert store.read("memories").count() == 1
        raise RuntimeError
    assert store.read("memories").count() == 0
    store.upsert("memories", rows.withColumn("content", F.lit("x")), ["id"])
    store.upsert("memories", rows.withColumn("content", F.lit("y")), ["id"])
    assert [r.content for r in store.read("memories").collect()] == ["y"]


def test_of_two_writers_the_second_begins_anew(spark, tmp_path):
    one, two = (Store(spark, str(tmp_path / "store")) for _ in range(2))
    rows = lambda i: spark.createDataFrame([(i, "p")], "id string, project_id string")
    with pytest.raises(Conflict), one.transaction():
        one.append("memories", rows("a"))
        two.append("memories", rows("b"))
    assert [r.id for r in one.read("memories").collect()] == ["b"]
    turns = []

    def step():
        with one.transaction():
            assert one.read("memories").count() == 1 + len(turns)
            if not turns:
                two.append("memories", rows("c"))
            turns.append(1)
            one.append("memories", rows("a"))

    retried(step)
    assert len(turns) == 2 and sorted(r.id for r in two.read("memories").collect()) == ["a", "b", "c"]


def test_appends_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "MERGE", 3)
    store = Store(spark, str(tmp_path / "store"))
    for i in range(8):
        store.append("memories", spark.createDataFrame([(str(i), "p")], "id string, project_id string"))
        assert len(store._versions()["memories"]) <= 3
    assert sorted(r.id for r in store.read("memories").collect()) == list("01234567")


def test_names_that_spark_hides_and_empty_files(spark, tmp_path):
    root = tmp_path / "tree"
    for path in ("pkg/__init__.py", "pkg/_util.py", "_lib/a/b.py", ".hidden.js", "c.Tsx", "deep/ok.Js", "deep/dist/no.js", "node_modules/no.js", ".git/no.py", ".js", "a b/ü#%{x}.ts", "x=1/[m].py", "empty.py", "_e/.e.py"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("" if "e.py" in path or path == "empty.py" else path)
    got = {r.path: r.content for r in sources.scan(spark, str(root)).collect()}
    want = {"pkg/__init__.py", "pkg/_util.py", "_lib/a/b.py", ".hidden.js", "c.Tsx", "deep/ok.Js", "a b/ü#%{x}.ts", "x=1/[m].py", "empty.py", "_e/.e.py"}
    assert set(got) == want and all(text == ("" if path in ("empty.py", "_e/.e.py") else path) for path, text in got.items())
    assert set(paths(sources.scan(spark, str(root), older=True))) == want


def test_edges_after_a_targeted_change(spark, tmp_path):
    body = "\n\ndef f{0}():\n    x = 1\n    return x\n"
    root = tmp_path / "p"
    root.mkdir()
    for name, text in {"a.py": "from .b import f" + body, "b.py": "from .c import f" + body, "c.py": body, "d.py": "from .a import f" + body}.items():
        (root / name).write_text(text.format(name[0]))
    engine = Engine(spark, str(tmp_path / "store"))
    engine.index(str(root))

    def links():
        of = {r.chunk_id: r.path for r in engine.candidates(str(root)).collect()}
        return sorted((of[r.from_id], of[r.to_id]) for r in engine.edges(str(root)).collect())

    assert links() == [("a.py", "b.py"), ("b.py", "c.py"), ("d.py", "a.py")]
    (root / "a.py").write_text("# moved\nfrom .c import f" + body.format("a"))
    assert engine.index(str(root), paths=["a.py"])["files_indexed"] == 1
    assert links() == [("a.py", "c.py"), ("b.py", "c.py"), ("d.py", "a.py")]
    (root / "b.py").unlink()
    engine.index(str(root), paths=["b.py"])
    assert links() == [("a.py", "c.py"), ("d.py", "a.py")]
    (root / "b.py").write_text("from .d import f" + body.format("b"))
    engine.index(str(root), paths=["b.py"])
    assert links() == [("a.py", "c.py"), ("b.py", "d.py"), ("d.py", "a.py")]


def test_projects_are_read_apart(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    for p in ("one", "two"):
        (tmp_path / p).mkdir()
        (tmp_path / p / "a.py").write_text(f"def {p}():\n    x = 1\n    return x\n")
        engine.index(str(tmp_path / p))
    found = engine.candidates(str(tmp_path / "one"))
    assert [r.name for r in found.collect()] == ["one"]
    assert all(project_id(str(tmp_path / "one")) in f for f in found.inputFiles()) and found.inputFiles()


def test_chunks_by_ids(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    engine.index(str(tree))
    ids = [r.chunk_id for r in engine.candidates(str(tree)).limit(2).collect()]
    assert sorted(r.chunk_id for r in engine.chunks_by_ids(str(tree), [*ids, "none"]).collect()) == sorted(ids)
    assert engine.chunks_by_ids(str(tree), []).count() == 0


def test_options(tmp_path):
    (tmp_path / ".gitignore").write_text("a\n")
    path = write_options(str(tmp_path), Options(token_budget=5))
    write_options(str(tmp_path))
    assert '"token_budget": 5' in path.read_text() and (tmp_path / ".gitignore").read_text() == "a\n.lodestone/\n"
