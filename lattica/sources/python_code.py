"""Definitions, imports and calls of Python sources, by the standard parser."""

from __future__ import annotations

import ast
import hashlib

import pandas as pd
from pyspark.sql import DataFrame

FACTS = "file string, kind string, qualname string, name string, region_start int, def_line int, end_line int, owner string, body_sha1 string"


def facts_of(path: str, text: str) -> list[tuple]:
    """Rows of one file: definitions (function, method, class), imports, and calls by name; a file that doesn't parse
    gives one row of kind ``error``."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [(path, "error", "", "", None, None, None, "", None)]
    rows: list[tuple] = []
    todo: list[tuple[ast.AST, str, bool]] = [(tree, "", False)]
    while todo:
        node, owner, in_class = todo.pop()
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(x, ast.ClassDef) else "method" if in_class else "function"
                name = f"{owner}.{x.name}" if owner else x.name
                start = min([x.lineno, *(d.lineno for d in x.decorator_list)])
                body = hashlib.sha1("\n".join(ast.dump(b) for b in x.body).encode()).hexdigest()
                rows.append((path, kind, name, x.name, start, x.lineno, x.end_lineno, owner, body))
                todo.append((x, name, kind == "class"))
            else:
                if isinstance(x, ast.Import):
                    rows += [(path, "import", a.name, a.asname or a.name, x.lineno, x.lineno, x.end_lineno, owner, None) for a in x.names]
                elif isinstance(x, ast.ImportFrom):
                    rows += [(path, "import", "." * x.level + (x.module or "") + ":" + a.name, a.asname or a.name, x.lineno, x.lineno, x.end_lineno, owner, None) for a in x.names]
                elif isinstance(x, ast.Call):
                    called = x.func.id if isinstance(x.func, ast.Name) else x.func.attr if isinstance(x.func, ast.Attribute) else ""
                    if called:
                        rows.append((path, "call", called, called, x.lineno, x.lineno, x.end_lineno, owner, None))
                todo.append((x, owner, in_class and not isinstance(x, ast.Lambda)))
    return rows


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of files (file, text), a batch of files at a time."""
    names = [x.split()[0] for x in FACTS.split(", ")]

    def of(frames):
        for frame in frames:
            rows = [r for path, text in zip(frame["file"], frame["text"]) for r in facts_of(path, text or "")]
            out = pd.DataFrame(rows, columns=names)
            for c in ("region_start", "def_line", "end_line"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.select("file", "text").mapInPandas(of, FACTS)
