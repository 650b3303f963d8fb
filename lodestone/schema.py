"""Tables of the engine and the values that their columns and parameters may take."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I, _D, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in columns.items()])


TABLES: dict[str, T.StructType] = {
    "projects": _table(id=_S, name=_S, root_path=_S, config=_S, indexed_at=_TS, created_at=_TS),
    "files": _table(id=_S, project_id=_S, path=_S, language=_S, hash=_S, last_modified=_D),
    "chunks": _table(id=_S, file_id=_S, chunk_type=_S, name=_S, content=_S, start_line=_I, end_line=_I, token_count=_I, metadata=T.MapType(_S, _S)),
    "embeddings": _table(chunk_id=_S, model=_S, vector=T.ArrayType(T.FloatType()), dims=_I, created_at=_TS),
    "imports": _table(file_id=_S, from_path=_S, specifier=_S),
    "graph_edges": _table(id=_S, project_id=_S, from_chunk=_S, to_chunk=_S, edge_type=_S, weight=_D),
    "memories": _table(id=_S, project_id=_S, session_id=_S, memory_type=_S, content=_S, relevance_score=_D, created_at=_TS, expires_at=_TS),
    "memory_embeddings": _table(memory_id=_S, model=_S, vector=T.ArrayType(T.FloatType()), dims=_I, created_at=_TS),
    "file_coedits": _table(id=_S, project_id=_S, file_a=_S, file_b=_S, count=_L, last_seen=_TS),
}

# Fixed values that results depend on.
CHUNK_TYPES = ("function", "class", "module")
EDGE_TYPES = ("calls", "extends", "imports")
MEMORY_TYPES = ("decision", "pattern", "todo", "context_note")
DIRECTIONS = ("incoming", "outgoing", "both")
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx"}
MAX_CONTENT = 12_000
MIN_LINES = 3
BLOCK_LINES = 50


@dataclass(frozen=True)
class Options:
    """Parameters of queries with their defaults."""

    k: int = 10
    code_candidates: int = 20
    memory_candidates: int = 5
    depth: int = 2
    direction: str = "both"
    token_budget: int = 8000
    file_cap: int = 400
    ui_k: int = 15
    ui_k_max: int = 50
    weights: dict[str, float] = field(default_factory=lambda: {"semantic": 0.55, "graph": 0.20, "recency": 0.10, "coedit": 0.15})


def checked_k(k: int) -> int:
    if k < 0:
        raise ValueError(f"k must not be negative: {k}")
    return k


def checked_direction(direction: str) -> str:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}: {direction}")
    return direction


def ui_limit(value: str | int | None, options: Options = Options()) -> int:
    """What a user typed as a number of results: the default if it is no positive number, the maximum at most."""
    try:
        return min(int(value or options.ui_k), options.ui_k_max)
    except ValueError:
        return options.ui_k


def memory_type(column: Column) -> Column:
    """An unknown type becomes a context note."""
    return F.when(column.isin(*MEMORY_TYPES), column).otherwise(F.lit("context_note"))
