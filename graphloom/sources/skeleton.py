"""Outlines of definitions: what a function or class declares, calls and returns, without its control flow.

Python reads a chunk's syntax tree and returns the outline's lines; everything around them is built from columns.

Defined results. A chunk that is null, blank, without a definition at its start, or holds no statement has the embedding
text as its skeleton. One that does not parse has the embedding text, or its own first 500 characters where that is empty.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from graphloom.functions import text as T
from graphloom.sources.python_source import _DEFS, _name

# The longest expression, docstring and remark, and the most items of a list, of yields and of returns.
EXPRESSION, DOCSTRING, REMARK, ITEMS, RESULTS = 80, 500, 120, 30, 5


def _short(node: ast.AST | None) -> str:
    text = ast.unparse(node) if node is not None else ""
    return text if len(text) <= EXPRESSION else text[: EXPRESSION - 3] + "..."


def _bound(node: ast.stmt) -> list[str]:
    """Plain names that an assignment binds, those in a tuple or list included."""
    match node:
        case ast.Assign(targets=targets):
            flat = [e for t in targets for e in (t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t])]
        case ast.AnnAssign(target=target) | ast.AugAssign(target=target):
            flat = [target]
        case _:
            flat = []
    return [x.id for x in flat if isinstance(x, ast.Name)]


def _marks(node: ast.AST) -> Iterator[tuple[str, str]]:
    """(label, text) of what a tree holds, level by level."""
    for x in ast.walk(node):
        match x:
            case ast.Call(func=func) if _name(func):
                yield "Calls", _name(func)
            case ast.Yield(value=value):
                yield "Yields", _short(value) or "value"
            case ast.YieldFrom(value=value):
                yield "Yields", f"from {_short(value)}"
            case ast.Return(value=value) if value is not None:
                yield "Return expressions", _short(value)
            case ast.stmt():
                yield from (("Variables", name) for name in _bound(x))


def _line(label: str, items) -> list[str]:
    text = ", ".join(items)
    return [f"{label}: {text}"] if text else []


def _doc(node: ast.AST) -> str:
    return (ast.get_docstring(node) or "").strip()


def _header(node: ast.AST) -> str:
    """A definition's first line as the parser prints it: a decorator, where there is one."""
    return ast.unparse(node).split("\n", 1)[0].rstrip(":")


def _function(node: ast.AST) -> list[str]:
    marks = list(_marks(node))
    told = lambda label: [t for k, t in marks if k == label]
    known = {a.arg for a in node.args.args} | {"self"}
    return [
        f"Signature: {_header(node)}",
        *_line("Decorators", map(_short, node.decorator_list)),
        *_line("Docstring", [_doc(node)[:DOCSTRING]]),
        *_line("Return type", [_short(node.returns)]),
        *_line("Calls", sorted(set(told("Calls")))[:ITEMS]),
        *_line("Variables", sorted(set(told("Variables")) - known)[:ITEMS]),
        *_line("Yields", told("Yields")[:RESULTS]),
        *_line("Return expressions", told("Return expressions")[:RESULTS]),
    ]


def _class(node: ast.ClassDef) -> list[str]:
    methods = [x for x in node.body if isinstance(x, _DEFS)]
    remarks = [_doc(m).split("\n")[0][:REMARK] for m in methods]
    headers = [f"  - {_header(m)}" + (f"  # {r}" if r else "") for m, r in zip(methods, remarks, strict=True)]
    attributes = (n for x in node.body if not isinstance(x, ast.AugAssign) for n in _bound(x))
    return [
        "Type: CLASS",
        f"Name: {node.name}",
        *_line("Inherits", map(_short, node.bases)),
        *_line("Docstring", [_doc(node)[:DOCSTRING]]),
        *_line("Attributes", islice(attributes, ITEMS)),
        *(["Methods:"] if headers else []),
        *headers[:ITEMS],
        *_line("Calls", sorted({t for m in methods for k, t in _marks(m) if k == "Calls"})[:ITEMS]),
    ]


def outline(chunk: str | None) -> list[str] | None:
    """Lines of the definition that a chunk starts with; none if it starts with something else, null if it does not parse."""
    try:
        body = ast.parse((chunk or "").strip()).body
        if body and isinstance(body[0], _DEFS):
            return _function(body[0])
        return _class(body[0]) if body and isinstance(body[0], ast.ClassDef) else []
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


@F.pandas_udf(ArrayType(StringType()))
def _outline(chunks: pd.Series) -> pd.Series:
    return chunks.map(outline)


def skeleton(chunk: Column, text: Column, owner: Column, path: Column) -> Column:
    """Skeleton of a node from its source chunk, embedding text, class name and file path."""
    lines, text = _outline(chunk), T.strip(F.coalesce(text, F.lit("")))
    named = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.array(F.concat(F.lit(label), c))).otherwise(F.array().cast("array<string>"))
    whole = F.concat(F.slice(lines, 1, 1), named("Class: ", owner), F.slice(lines, 2, 1 << 30), named("File: ", path))
    return F.when(lines.isNull(), F.when(text != "", text).otherwise(T.strip(F.substring(chunk, 1, 500)))).when(F.size(lines) == 0, text).otherwise(F.array_join(whole, "\n"))


def rerank_passage(chunk: Column, text: Column, owner: Column, path: Column) -> Column:
    """What a reranker reads of a node: embedding text and skeleton, or one where they are equal or the other is empty."""
    outlined, text = skeleton(chunk, text, owner, path), T.strip(F.coalesce(text, F.lit("")))
    return F.when(outlined == text, text).otherwise(F.concat_ws("\n\n", T.blank_to_null(text), T.blank_to_null(outlined)))
