"""Calls of Python sources as rows, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KIND = "array<struct<callee:string,line:int,col:int,text:string,arg0_dynamic:boolean,arg0_literal:string,n_args:int,kwargs:map<string,string>>>"
FAILED = "struct<calls:" + KIND + ",failed:boolean>"


def _is_dynamic(node: ast.AST | None) -> bool:
    """Is a value put together at run time? Plain strings, numbers and lists of such aren't."""
    if node is None or isinstance(node, ast.Constant):
        return False
    if isinstance(node, ast.JoinedStr):
        return any(isinstance(x, ast.FormattedValue) for x in node.values)
    if isinstance(node, (ast.List, ast.Tuple)):
        return any(_is_dynamic(x) for x in node.elts)
    if isinstance(node, ast.Starred):
        return _is_dynamic(node.value)
    return True


def _literal(node: ast.AST | None) -> str:
    """The string pieces of an expression, in order."""
    return " ".join(x.value for x in ast.walk(node) if isinstance(x, ast.Constant) and isinstance(x.value, str)) if node is not None else ""


def _callee(node: ast.expr) -> str:
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    names.append(node.id if isinstance(node, ast.Name) else "")
    return ".".join(reversed(names))


def calls_of(source: str) -> list[dict]:
    """Every call of a module. Columns count characters from 1."""
    lines, found = source.split("\n"), []
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Call):
            first = node.args[0] if node.args else None
            col = len(lines[node.lineno - 1].encode()[: node.col_offset].decode(errors="replace")) + 1
            text = (ast.get_source_segment(source, node) or "")[:400]
            kwargs = {k.arg: ast.unparse(k.value) for k in node.keywords if k.arg}
            found.append({"callee": _callee(node.func), "line": node.lineno, "col": col, "text": text, "arg0_dynamic": _is_dynamic(first), "arg0_literal": _literal(first).strip(), "n_args": len(node.args), "kwargs": kwargs})
    return found


def _parsed(sources: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for some in sources:
        rows = []
        for source in some:
            try:
                rows.append((calls_of(source), False))
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                rows.append(([], True))
        yield pd.DataFrame(rows, columns=["calls", "failed"])


def parsed(files: DataFrame) -> DataFrame:
    """files with p: the calls, and whether the parser gave up."""
    parse = F.pandas_udf(_parsed, FAILED).asNondeterministic()  # or explode has it run a second time, to filter
    return files.withColumn("p", parse("text"))
