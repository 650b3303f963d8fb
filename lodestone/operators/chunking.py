"""Files into chunks and imports. Syntax trees live and die on the workers."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.functions import text as X

CHUNKS = "file_id string, path string, chunk_type string, name string, content string, start_line int, end_line int, token_count int"
PARSED = CHUNKS + ", specifier string"


def line_blocks(files: DataFrame, size: int = schema.BLOCK_LINES, key: str = "file_id", text: str = "content") -> DataFrame:
    """Blocks of lines, as module chunks, for texts that aren't parsed: block number, first and last line, content, tokens."""
    lines = F.split(F.regexp_replace(F.col(text), "\n$", ""), "\n")
    cut = files.filter(F.col(text) != "").select(key, lines.alias("lines")).select(key, "lines", F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / size).cast("int"))).alias("block"))
    part = cut.select(key, "block", F.expr(f"slice(lines, block * {size} + 1, {size})").alias("part"))
    content = F.array_join("part", "\n")
    return part.select(key, "block", (F.col("block") * size + 1).alias("start_line"), (F.col("block") * size + F.size("part")).alias("end_line"), content.alias("content"), X.token_estimate_v1(content).alias("token_count"))


def module_lines(files: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """The import and export lines of each file that has some, as one chunk over the whole file."""
    found = X.import_lines(F.col(text))
    content = F.array_join(found, "\n")
    return files.filter(F.size(found) > 0).select(key, F.lit("module").alias("chunk_type"), content.alias("content"), F.lit(1).alias("start_line"), X.line_count_v1(F.col(text)).alias("end_line"), X.token_estimate_v1(content).alias("token_count"))


def module_fallback(files: DataFrame, chunks: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """One chunk for each file without others that has three lines or more: its capped text, its whole text's tokens."""
    alone = files.join(chunks.select(key).distinct(), key, "left_anti").filter(X.line_count(F.col(text)) >= schema.MIN_LINES)
    return alone.select(key, F.lit("module").alias("chunk_type"), X.content_cap(F.col(text)).alias("content"), F.lit(1).alias("start_line"), X.line_count(F.col(text)).alias("end_line"), X.token_estimate(F.col(text)).alias("token_count"))


def _units(text: str) -> int:
    return len(text.encode("utf-16-be", "surrogatepass")) // 2


def python_nodes(source: str) -> list[tuple[str, str | None, int, int, str]]:
    """(type, name, first line, last line, text) of functions and classes, outer before inner."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = source.split("\n")
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            rows = lines[node.lineno - 1 : node.end_lineno]
            last = rows[-1].encode()[: node.end_col_offset].decode(errors="ignore")
            first = rows[0].encode()[node.col_offset :].decode(errors="ignore") if len(rows) > 1 else last.encode()[node.col_offset :].decode(errors="ignore")
            text = "\n".join([first, *rows[1:-1], last]) if len(rows) > 1 else first
            out.append(("class" if isinstance(node, ast.ClassDef) else "function", node.name, node.lineno, node.end_lineno, text))
    return sorted(out, key=lambda n: (n[2], -n[3]))


def python_imports(source: str) -> list[str]:
    """Modules of from-imports; a relative one as a path."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = [n for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)]
    up = lambda n: "./" if n == 1 else "../" * (n - 1)
    return [up(n.level) + (n.module or "").replace(".", "/") if n.level else n.module for n in sorted(found, key=lambda n: n.lineno)]


_BEFORE_REGEX = re.compile(r"(?:^|[=(,:;!&|?{}\[+\-*%<>~^]|\breturn|\btypeof|\bcase|\bin|\bof|\bdo|\belse)\s*$")


def blanked(source: str) -> str:
    """The source with comments, strings and regular expressions blanked, of the same length and lines. What a template's
    ${...} holds stays."""
    out, i, n, templates = list(source), 0, len(source), []

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    def template(start: int) -> int:
        k = start
        while k < n:
            if source[k] == "\\":
                k += 2
            elif source[k] == "`":
                blank(start, k + 1)
                return k + 1
            elif source.startswith("${", k):
                blank(start, k)
                out[k] = out[k + 1] = " "
                templates.append(0)
                return k + 2
            else:
                k += 1
        blank(start, n)
        return n

    while i < n:
        c = source[i]
        if source.startswith("//", i):
            end = source.find("\n", i)
            end = n if end < 0 else end
            blank(i, end)
            i = end
        elif source.startswith("/*", i):
            end = source.find("*/", i + 2)
            end = n if end < 0 else end + 2
            blank(i, end)
            i = end
        elif c in "'\"":
            k = i + 1
            while k < n and source[k] != c and source[k] != "\n":
                k += 2 if source[k] == "\\" else 1
            blank(i + 1, k)
            i = k + 1
        elif c == "`":
            out[i] = " "
            i = template(i + 1)
        elif c == "/" and _BEFORE_REGEX.search("".join(out[max(0, i - 12) : i])):
            k, in_class = i + 1, False
            while k < n and source[k] != "\n" and (source[k] != "/" or in_class):
                in_class = source[k] == "[" or in_class and source[k] != "]"
                k += 2 if source[k] == "\\" else 1
            blank(i, k + 1)
            i = k + 1
        elif c == "{" and templates:
            templates[-1] += 1
            i += 1
        elif c == "}" and templates:
            if templates[-1]:
                templates[-1] -= 1
                i += 1
            else:
                templates.pop()
                out[i] = " "
                i = template(i + 1)
        else:
            i += 1
    return "".join(out)


def _pairs(code: str) -> dict[int, int]:
    """Where each bracket's partner is."""
    match, stack = {}, []
    for i, c in enumerate(code):
        if c in "([{":
            stack.append((c, i))
        elif c in ")]}" and stack and stack[-1][0] == "([{"[")]}".index(c)]:
            match[stack.pop()[1]] = i
    return match


_FUNCTION = re.compile(r"(?<![\w$.])(?:async\s+)?function\s*\*?\s*([\w$]+)?\s*(?:<[^>(]*>)?\s*(?=\()")
_CLASS = re.compile(r"(?<![\w$.])(?:abstract\s+)?class\b(?:\s+(?!extends\b|implements\b)([\w$]+))?[^{;()]*(?=\{)")
_METHOD = re.compile(r"(?:(?:public|private|protected|static|override|readonly|async|get|set)\s+)*\*?\s*(#?[\w$]+)\s*(?:<[^>(]*>)?\s*(?=\()")
_ARROW = re.compile(r"=>")
_NO_METHOD = frozenset(("if", "for", "while", "switch", "catch", "function", "return", "with", "new", "await", "typeof", "super"))


def javascript_nodes(source: str) -> list[tuple[str, str | None, int, int, str]]:
    """(type, name, first line, last line, text) of functions, classes, methods and arrow functions, outer before inner, by
    a scanner that knows strings, comments and brackets but no grammar."""
    code = blanked(source)
    match = _pairs(code)
    found: list[tuple[int, int, str, str | None]] = []

    def body(at: int) -> int | None:
        """The end of a block after a closed parameter list, return types skipped."""
        m = re.compile(r"\s*(?::[^={;]*?)?\s*(?=\{)").match(code, at)
        return match.get(m.end()) if m else None

    for m in _FUNCTION.finditer(code):
        close = match.get(m.end())
        end = body(close + 1) if close is not None else None
        if end is not None:
            found.append((m.start(), end + 1, "function", m[1]))
    for m in _CLASS.finditer(code):
        end = match.get(m.end())
        if end is None:
            continue
        found.append((m.start(), end + 1, "class", m[1]))
        at = m.end() + 1
        while at < end:  # members, one after another
            if code[at] in "([{":
                at = match.get(at, at) + 1
                continue
            member = _METHOD.match(code, at) if code[at - 1] in " \n\t;{}*" and (code[at].isalpha() or code[at] in "_$#*") else None
            close = match.get(member.end()) if member and member[1] not in _NO_METHOD else None
            stop = body(close + 1) if close is not None else None
            if stop is not None:
                found.append((at, stop + 1, "function", member[1]))
                at = stop + 1
            else:
                at += 1
    back = {v: k for k, v in match.items()}
    for m in _ARROW.finditer(code):
        before = len(code[: m.start()].rstrip())
        typed = re.search(r"\)\s*:[^(){};=]*$", code[max(0, before - 200) : before])
        if typed:
            before = max(0, before - 200) + typed.start() + 1
        if before and code[before - 1] == ")" and before - 1 in back:
            start = back[before - 1]
        else:
            name = re.search(r"[\w$]+$", code[:before])
            if not name:
                continue
            start = name.start()
        lead = re.search(r"async\s*$", code[max(0, start - 10) : start])
        start -= len(lead[0]) if lead else 0
        at = m.end()
        while at < len(code) and code[at].isspace():
            at += 1
        if at < len(code) and code[at] == "{":
            end = match.get(at, at) + 1
        else:  # an expression: up to what closes or separates it
            end = at
            while end < len(code) and code[end] not in ",;)]}":
                end = match.get(end, end) + 1 if code[end] in "([{" else end + 1
                if end < len(code) and code[end] == "\n" and not re.match(r"\s*[.?:+*/&|=<>-]", code[end:]):
                    break
        found.append((start, end, "function", None))
    line = lambda i: source.count("\n", 0, i) + 1
    return [(kind, name, line(a), line(max(a, b - 1)), source[a:b]) for a, b, kind, name in sorted(set(found), key=lambda f: (f[0], -f[1], f[2], f[3] or ""))]


_JS_IMPORT = re.compile(r"(?m)^\s*(?:import\s*|(?:import|export)\b[^;'\"=()]*?\bfrom\s*)(['\"])([^'\"\n]+)\1")


def javascript_imports(source: str) -> list[str]:
    """Specifiers of import declarations (and of re-exports)."""
    return [m[2] for m in _JS_IMPORT.finditer(source)]


def nodes_of(source: str, language: str | None) -> list[tuple[str, str | None, int, int, str]]:
    return python_nodes(source) if language == "python" else javascript_nodes(source) if language in ("javascript", "typescript", "tsx") else []


def imports_of(source: str, language: str | None) -> list[str]:
    return python_imports(source) if language == "python" else javascript_imports(source) if language in ("javascript", "typescript", "tsx") else []


def chunks_of(source: str, language: str | None) -> list[tuple[str, str | None, str, int, int, int]]:
    """Chunks of three lines or more, nested ones included; else the whole file if it is that long."""
    out = [(k, n, t[: schema.MAX_CONTENT], a, b, -(-_units(t) // 4)) for k, n, a, b, t in nodes_of(source, language) if b - a + 1 >= schema.MIN_LINES]
    lines = source.count("\n") + 1
    if not out and lines >= schema.MIN_LINES:
        out.append(("module", None, source[: schema.MAX_CONTENT], 1, lines, -(-_units(source) // 4)))
    return out


def chunks_of_v1(source: str, language: str | None) -> list[tuple[str, str | None, str, int, int, int]]:
    """Outermost chunks of any length in whole lines, after one of the import lines; blocks of lines if there are none."""
    if not source.strip():
        return []
    lines = source.splitlines()
    size = lambda t: max(1, len(t) // 4)
    out, last = [], 0
    for kind, name, a, b, _ in nodes_of(source, language):
        if a > last:
            content = "\n".join(lines[a - 1 : b])
            out.append((kind, name, content, a, b, size(content)))
            last = b
    top = "\n".join(x for x in lines if x.strip().startswith(("import ", "from ", "require(", "export ")))
    if top and language is not None:
        out.insert(0, ("module", None, top, 1, len(lines), size(top)))
    step = schema.BLOCK_LINES
    blocks = ("\n".join(lines[i : i + step]) for i in range(0, len(lines), step))
    return out or [("module", None, c, i * step + 1, min(len(lines), i * step + step), size(c)) for i, c in enumerate(blocks)]


def parsed(files: DataFrame, older: bool = False) -> DataFrame:
    """files (file_id, path, language, content): their chunks and imports in one pass over the text; a row with a
    specifier is an import, any other a chunk. Unparsable and unknown files give what has no syntax."""
    split = chunks_of_v1 if older else chunks_of

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                rows += [(f.file_id, f.path, *c, None) for c in split(f.content or "", f.language)]
                rows += [(f.file_id, f.path, None, None, None, None, None, None, s) for s in imports_of(f.content or "", f.language)]
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])
            yield frame.astype({c: "Int32" for c in ("start_line", "end_line", "token_count")})

    return files.select("file_id", "path", "language", "content").mapInPandas(run, PARSED)


def chunks(files: DataFrame, older: bool = False) -> DataFrame:
    return identified(parsed(files, older))


def identified(rows: DataFrame) -> DataFrame:
    """The chunks of parsed rows, with their ids."""
    found = rows.filter("specifier IS NULL").drop("specifier")
    return found.withColumn("chunk_id", chunk_id(F.col("file_id"), F.col("start_line"), F.col("end_line"), F.col("chunk_type"), F.coalesce("name", F.lit("")), F.col("content")))


def chunk_id(*parts: Column) -> Column:
    return X.row_id(*parts)


def imports(files: DataFrame) -> DataFrame:
    return parsed(files).filter("specifier IS NOT NULL").select(F.col("path").alias("from_path"), "specifier")
