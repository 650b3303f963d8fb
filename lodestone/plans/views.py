"""The engine's tables played by the driver's tables, as SQL that Spark and other engines run alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = """select doc_id as file_id, source as project_id, concat(source,'/',cast(doc_id as varchar(20))) as path, lang as language, n_chars, text as content from documents"""
CANDIDATES = """select e.vec_id as chunk_id,
       case e.label % 3 when 0 then 'function' when 1 then 'class' else 'module' end as chunk_type,
       concat('n',cast(e.vec_id % 97 as varchar(9))) as name,
       concat('p',cast(e.vec_id % 5 as varchar(9))) as project_id,
       concat('src/f',cast(e.vec_id % 50 as varchar(9)),'.py') as path, e.vec_id % 50 as file_id,
       cast(e.vec_id * 7 % 300 + 1 as int) as start_line, cast(e.vec_id * 7 % 300 + 20 as int) as end_line,
       e.embedding, v.ts as modified_at, v.user_id as modified, d.n_chars as n_chars, d.text as content
from embeddings e join events v on v.event_id = e.vec_id left join documents d on d.doc_id = e.vec_id"""
EDGES = """select distinct event_id as from_id, user_id as to_id,
       case event_type when 'click' then 'calls' when 'view' then 'calls' when 'purchase' then 'extends' else 'imports' end as edge_type
from events
where event_id in (select vec_id from embeddings) and user_id in (select vec_id from embeddings)
  and event_id <> user_id"""
MEMORIES = """select concat(cast(conv_id as varchar(20)),'-',cast(turn as varchar(20))) as memory_id,
       case role when 'user' then 'decision' when 'assistant' then 'pattern' else 'context_note' end as memory_type,
       text as content, conv_id*1000+turn as created_at, (conv_id*31+turn)%500 as vec_id, concat('p',cast(conv_id % 5 as varchar(9))) as project_id
from conversations"""
SESSIONS = "select distinct l_orderkey as session_id, l_partkey as file_id from lineitem"
SQL = {"v_files": FILES, "v_candidates": CANDIDATES, "v_edges": EDGES, "v_memories": MEMORIES, "v_sessions": SESSIONS}


def with_views(names: list[str], query: str) -> str:
    """A query after the views that it names."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + ("," if query.lstrip().startswith("@") else "") + "\n" + query.lstrip().removeprefix("@")


class Tables:
    """The driver's tables, and the views over them as data frames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        import re

        tables = {t for t in re.findall(r"\b(documents|embeddings|events|conversations|lineitem)\b", SQL[name])}
        return self.spark.sql(re.sub(r"\b(documents|embeddings|events|conversations|lineitem)\b(?=\s|\)|$)(?!\.)", r"{\1}", SQL[name]), **{t: self.read(t) for t in tables})

    def vector(self, vec_id: int = 0) -> list[float]:
        """One row of embeddings, as the query vector."""
        from pyspark.sql import functions as F

        return self.read("embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]
