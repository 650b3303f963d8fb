"""Text expressions: sizes, hashes, paths, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import schema

# Fixed values that results depend on.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py")
IGNORED = ("node_modules", ".git", "__pycache__", "dist", "build", ".lodestone", ".next", "coverage", ".venv", "venv", ".env")
IGNORED_V1 = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".next", ".cache", "coverage")
IGNORED_FILES_V1 = (".env", ".env.local", ".env.production")
IGNORED_BY_WATCHER = r"node_modules|\.git|__pycache__|dist|build|\.lodestone"
CANDIDATES = (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")
PYTHON_CANDIDATES = (".py", "/__init__.py")
CALL = r"(?U)\b(\w+)\s*\("
BASE = r"(?:extends|implements)\s+(\w+)"
IMPORTS = (r"(?m)^(?:from|import)\s+([\w.]+)", r"(?:import|require)\s*(?:\(?\s*['\"])(\.{1,2}/[\w./]+)['\"]", r"export\s+.*?from\s+['\"](\.{1,2}/[\w./]+)['\"]")
CALL_STOPS = ("if", "for", "while", "return", "print", "len", "range", "str", "int", "list", "dict", "set", "type", "super", "self", "cls")
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, by which sizes are estimated."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def token_estimate(text: Column) -> Column:
    return F.ceil(utf16_length(text) / 4).cast("int")


def token_estimate_v1(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4).cast("int"))


def content_cap(text: Column, cap: int = schema.MAX_CONTENT) -> Column:
    return F.substring(text, 1, cap)


def file_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def file_hash_v1(text: Column) -> Column:
    return F.sha2(text, 256)


def line_count(text: Column) -> Column:
    """Lines between newlines, the empty one after a last newline included."""
    return F.size(F.split(text, "\n"))


def line_count_v1(text: Column) -> Column:
    """Lines that a newline ends, or the text's end."""
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n")))


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(text, "['\"]", "")


def slashes(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def relative_to(path: Column, root: Column) -> Column:
    """The path below root, with slashes."""
    p, r = slashes(path), F.regexp_replace(slashes(root), "/+$", "")
    return F.when(F.startswith(p, F.concat(r, F.lit("/"))), F.substr(p, F.length(r) + 2)).otherwise(p)


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """A name's first dot begins no extension."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language(path: Column) -> Column:
    """Null for an extension that isn't supported."""
    ext = extension(path)
    return reduce(lambda w, item: w.when(ext == item[0], F.lit(item[1])), schema.LANGUAGES.items(), F.when(F.lit(False), F.lit("")))


def language_v1(path: Column) -> Column:
    found = language(path)
    return F.when(found == "tsx", F.lit("typescript")).otherwise(found)


def supported(path: Column, case_sensitive: bool = False) -> Column:
    ext = F.regexp_extract(path, r"[^/](\.[^./]+)$", 1) if case_sensitive else extension(path)
    return ext.isin(*EXTENSIONS)


def is_supported(name: str) -> bool:
    """supported() of one file's name, for listings."""
    return "." + name[1:].rsplit(".", 1)[-1].lower() in EXTENSIONS and "." in name[1:]


def ignored(path: Column, names: tuple[str, ...] = IGNORED) -> Column:
    """Whether a folder or the file itself of a relative path has an ignored name."""
    return F.arrays_overlap(F.split(slashes(path), "/"), F.array(*map(F.lit, names)))


def ignored_by_watcher(path: Column) -> Column:
    """Whether an ignored name stands anywhere in the path, even within another name."""
    return F.rlike(path, F.lit(IGNORED_BY_WATCHER))


def normalised(path: Column) -> Column:
    """Without empty and . parts, and with .. applied."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def import_candidates(specifier: Column, from_path: Column, python: bool = False) -> Column:
    """Paths that a relative import may mean, in order; none for a package's name. With python, its files come too."""
    base = normalised(F.concat(directory(from_path), F.lit("/"), specifier))
    endings = (PYTHON_CANDIDATES if python else ()) + CANDIDATES
    found = F.array(*(F.concat(base, F.lit(e)) for e in endings), base)
    return F.when(F.startswith(specifier, F.lit(".")), found).otherwise(F.array().cast("array<string>"))


def python_specifier(level: Column, module: Column) -> Column:
    """A relative Python module (its dots counted) as a relative path."""
    up = F.when(level <= 1, F.lit("./")).otherwise(F.repeat(F.lit("../"), (level - 1).cast("int")))
    return F.concat(up, F.regexp_replace(F.coalesce(module, F.lit("")), r"\.", "/"))


def called_names(text: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(CALL), F.lit(1))), F.array(*map(F.lit, CALL_STOPS)))


def base_names(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(BASE), F.lit(1)))


def imported_names(text: Column) -> Column:
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in IMPORTS))))


def import_lines(text: Column) -> Column:
    starts = r"^(import |from |require\(|export )"
    return F.filter(F.split(text, "\n"), lambda line: F.rlike(F.trim(line), F.lit(starts)))


def source_header(path: Column, start: Column, end: Column, name: Column, content: Column) -> Column:
    named = F.when(name.isNotNull() & (name != ""), F.concat(F.lit(" ("), name, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("// "), path, F.lit(":"), line_range(start, end), named, F.lit("\n"), content)


def line_range(start: Column, end: Column) -> Column:
    return F.concat_ws("-", start.cast("string"), end.cast("string"))


def edge_id(from_: Column, to: Column, kind: Column) -> Column:
    return F.concat_ws(":", from_, to, kind)


def uuid5(name: Column, namespace: str = NAMESPACE_DNS) -> Column:
    """A version 5 UUID by built-in functions."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substr(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def row_id(*parts: Column) -> Column:
    """An identifier that is the same whenever its parts are."""
    return F.substring(F.sha2(F.to_json(F.struct(*(p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)))), 256), 1, 32)


def python_round4(x: Column) -> Column:
    """To four places as Python's round: by the exact binary value, ties to the even digit. Only values near a tie need exact
    arithmetic, in parts of the binary value that fit whole numbers."""
    size = F.least(F.abs(x), F.lit(64.0))
    high = F.floor(size * float(1 << 26))
    low = F.floor((size * float(1 << 26) - high) * float(1 << 44))
    whole = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    scaled = (high.cast("decimal(12,0)") * whole(10_000 << 44).cast("decimal(18,0)")).cast("decimal(38,0)") + (low.cast("decimal(14,0)") * F.lit(10_000).cast("decimal(5,0)")).cast("decimal(38,0)")
    down = F.floor(size * 10_000).cast("decimal(38,0)")
    rest = scaled - (down.cast("decimal(12,0)") * whole(1 << 70).cast("decimal(22,0)")).cast("decimal(38,0)")
    half = whole(1 << 69)
    up = (rest > half) | ((rest == half) & (down % 2 == 1))
    exact = (down.cast("long") + up.cast("int")) / 10_000 * F.signum(x)
    near = F.abs(size * 10_000 - F.floor(size * 10_000) - 0.5) < 1e-6
    return F.when(near & (size < 64), exact).otherwise(F.round(x, 4))


def round4(x: Column) -> Column:
    """To four places, halves upwards."""
    return F.floor(x * 10000 + 0.5) / 10000
