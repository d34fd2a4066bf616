"""What Python files define, call and import, as rows: one small pass over each file's syntax tree, the rest in DataFrames.

Defined results. A null source or one that does not parse gives one ERROR row and nothing else; an empty file gives its
FILE row alone. Names that a file defines again take the place of the first and the content of the last.
"""

from __future__ import annotations

import ast
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "rel_path string, kind string, ord int, name string, owner string, start_line int, end_line int, signature string, doc string, body_hash string, chunk string, calls array<string>, bases array<string>, level int, module string, top boolean"
_ARROW = pa.schema([("rel_path", pa.string()), ("kind", pa.string()), ("ord", pa.int32()), ("name", pa.string()), ("owner", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("doc", pa.string()), ("body_hash", pa.string()), ("chunk", pa.string()), ("calls", pa.list_(pa.string())), ("bases", pa.list_(pa.string())), ("level", pa.int32()), ("module", pa.string()), ("top", pa.bool_())])
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_LINE_END = re.compile(r"\r\n|\r|\n")


def _name(node: ast.AST) -> str | None:
    return getattr(node, "id", None) or getattr(node, "attr", None)


def _base(node: ast.AST) -> str | None:
    """The last name of a base class: generic parameters and calls around it do not count."""
    while isinstance(node, (ast.Subscript, ast.Call)):
        node = node.value if isinstance(node, ast.Subscript) else node.func
    return _name(node)


def _called(nodes: list[ast.stmt]) -> list[str]:
    return sorted({n for top in nodes for x in ast.walk(top) if isinstance(x, ast.Call) and (n := _name(x.func))})


def _hash(node: ast.AST) -> str:
    """SHA-1 of a definition's tree without its docstring."""
    body = node.body[1:] if ast.get_docstring(node, clean=False) is not None else node.body
    bare = type(node)(**{f: body if f == "body" else getattr(node, f) for f in node._fields})
    return hashlib.sha1(ast.dump(bare).encode()).hexdigest()


def _chunk(lines: list[str], node: ast.stmt) -> str:
    """A statement's source, decorators left out; its columns count UTF-8 bytes."""
    rows = [x.encode() for x in lines[node.lineno - 1 : node.end_lineno]]
    rows[-1] = rows[-1][: node.end_col_offset]
    rows[0] = rows[0][node.col_offset :]
    return b"\n".join(rows).decode()


def facts(source: str | None) -> list[dict]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError) as error:
        return [{"kind": "ERROR", "doc": type(error).__name__}]
    plain = [x for x in tree.body if not isinstance(x, (*_DEFS, ast.ClassDef))]
    out = [{"kind": "FILE", "doc": ast.get_docstring(tree), "calls": _called(plain)}]
    lines = _LINE_END.split(source)
    # What a statement stands in: "module" or "class" (directly in a class of the module), or deeper.
    todo = [(x, None, True, "module") for x in reversed(tree.body)]
    while todo:
        node, owner, outer, place = todo.pop()
        row = {"start_line": getattr(node, "lineno", None), "end_line": getattr(node, "end_lineno", None)}
        below = ""
        if isinstance(node, (*_DEFS, ast.ClassDef)) or isinstance(node, ast.Assign) and outer:
            row["chunk"] = _chunk(lines, node)
        if isinstance(node, ast.ClassDef):
            out.append(row | {"kind": "CLASS", "name": node.name, "doc": ast.get_docstring(node), "bases": [b for x in node.bases if (b := _base(x))]})
            owner, outer, below = node.name, False, "class" if place == "module" else ""
        elif isinstance(node, _DEFS):
            out.append(row | {"kind": "FUNCTION", "name": node.name, "owner": owner, "doc": ast.get_docstring(node), "signature": f"({', '.join(a.arg for a in node.args.args)})", "body_hash": _hash(node), "calls": _called(node.body), "top": place != ""})
            outer = False
        elif isinstance(node, ast.Assign) and outer:
            out += [row | {"kind": "CONSTANT", "name": t.id} for t in node.targets if isinstance(t, ast.Name)]
        elif isinstance(node, ast.AnnAssign) and place == "module" and isinstance(node.target, ast.Name):
            out.append(row | {"kind": "CONSTANT", "name": node.target.id})
        elif isinstance(node, ast.Import):
            out += [row | {"kind": "IMPORT", "level": 0, "module": a.name} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [row | {"kind": "IMPORT", "level": node.level, "module": node.module, "name": a.name} for a in node.names]
        todo += [(x, owner, outer, below) for x in reversed(list(ast.iter_child_nodes(node)))]
    return out


def _facts(batches):
    for batch in batches:
        for path, source in zip(batch.column("rel_path").to_pylist(), batch.column("source").to_pylist(), strict=True):
            rows = [{"rel_path": path, "ord": k} | row for k, row in enumerate(facts(source))]
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def parse(files: DataFrame) -> DataFrame:
    """Facts of files (rel_path, source)."""
    return files.select("rel_path", "source").mapInArrow(_facts, SCHEMA)


def _node_id() -> Column:
    return F.concat("rel_path", F.lit("::"), F.when(F.col("owner").isNotNull(), F.concat("owner", F.lit("."))).otherwise(F.lit("")), "name")


def entities(parsed: DataFrame) -> DataFrame:
    """Classes, functions and constants: node_id, type, name, file_path, class_name, is_method, lines, signature, doc, body_hash, chunk, ord."""
    own = parsed.filter(F.col("kind").isin("CLASS", "FUNCTION", "CONSTANT")).withColumn("node_id", _node_id())
    rest = ["kind", "name", "rel_path", "owner", "start_line", "end_line", "signature", "doc", "body_hash", "chunk"]
    last = own.groupBy("node_id").agg(F.max_by(F.struct(*rest), "ord").alias("x"), F.min("ord").alias("ord"))
    x = last.select("node_id", "x.*", "ord")
    return x.select("node_id", F.col("kind").alias("type"), "name", F.col("rel_path").alias("file_path"), F.col("owner").alias("class_name"), F.col("owner").isNotNull().alias("is_method"), "start_line", "end_line", "signature", "doc", "body_hash", "chunk", "ord")


def calls(parsed: DataFrame) -> DataFrame:
    """caller_id, file_path, class_name, symbol: what functions of a module and methods of its classes call, and files outside of definitions.

    What a nested function calls, the one around it calls; functions in if or try blocks are no callers.
    """
    callers = parsed.filter("kind = 'FILE' or kind = 'FUNCTION' and top")
    caller = F.when(F.col("kind") == "FILE", F.col("rel_path")).otherwise(_node_id())
    return callers.select(caller.alias("caller_id"), F.col("rel_path").alias("file_path"), F.col("owner").alias("class_name"), F.explode("calls").alias("symbol")).distinct()


def class_bases(parsed: DataFrame) -> DataFrame:
    return parsed.filter("kind = 'CLASS'").select(_node_id().alias("node_id"), F.col("rel_path").alias("file_path"), F.explode("bases").alias("base")).distinct()


def wanted_stems(parsed: DataFrame) -> DataFrame:
    """(src, stem) of relative imports: the path, less its ending, of the module named, and of the symbol as a module."""
    found = parsed.filter("kind = 'IMPORT' and level > 0")
    folders = F.split("rel_path", "/")
    up = F.size(folders) - F.col("level")
    base = F.when(up >= 0, F.concat(F.slice(folders, F.lit(1), F.greatest(up, F.lit(0))), F.coalesce(F.split("module", "[.]"), F.array().cast("array<string>"))))
    stems = F.array(F.array_join(base, "/"), F.array_join(F.concat(base, F.array("name")), "/"))
    return found.select(F.col("rel_path").alias("src"), F.explode(stems).alias("stem")).filter("stem is not null").distinct()


def stems(parsed: DataFrame) -> DataFrame:
    """(stem, dst, package) of files: their paths less the ending; a package's own file has the path of the package."""
    package = F.col("rel_path").rlike("(^|/)__init__[.]py$")
    stem = F.when(package, F.regexp_replace("rel_path", "/?__init__[.]py$", "")).otherwise(F.regexp_replace("rel_path", "[.]py$", ""))
    return parsed.filter("kind in ('FILE', 'ERROR')").select(stem.alias("stem"), F.col("rel_path").alias("dst"), package.alias("package"))


def met_stems(wanted: DataFrame, parsed: DataFrame) -> DataFrame:
    """(src, dst) of wanted(src, stem) that files have; a file goes before a package. Only files that are wanted are grouped."""
    known = stems(parsed).join(wanted.select("stem").distinct(), "stem", "left_semi").groupBy("stem").agg(F.min_by("dst", "package").alias("dst"))
    return wanted.join(known, "stem").select("src", "dst").filter("src != dst").distinct()


def relative_imports(parsed: DataFrame) -> DataFrame:
    """(src, dst) of relative imports of files that were parsed."""
    return met_stems(wanted_stems(parsed), parsed)


def modules(parsed: DataFrame) -> DataFrame:
    """module, file_path, file_ord: dotted names of files; a package's own file has the package's name."""
    dotted = F.replace(F.regexp_replace(F.regexp_replace("rel_path", "[.]py$", ""), "(^|/)__init__$", ""), F.lit("/"), F.lit("."))
    return parsed.filter("kind in ('FILE', 'ERROR')").select(dotted.alias("module"), F.col("rel_path").alias("file_path"), F.col("rel_path").alias("file_ord"))


def suffixes(modules: DataFrame) -> DataFrame:
    """name, file_path, file_ord: modules(module, file_path, file_ord) under their dotted names and all endings of these."""
    parts = modules.withColumn("p", F.split("module", "[.]"))
    return parts.select("file_path", "file_ord", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "."))).alias("name"))


def imported_names(parsed: DataFrame) -> DataFrame:
    """import_id (the importing file) and name of absolute imports: the module, and the symbol as a module of it."""
    found = parsed.filter("kind = 'IMPORT' and level = 0")
    names = F.array(F.col("module"), F.when(F.col("name").isNotNull(), F.concat("module", F.lit("."), "name")))
    return found.select(F.col("rel_path").alias("import_id"), F.explode(names).alias("name")).filter("name is not null").distinct()
