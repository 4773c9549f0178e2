"""Facts of source files as one table: what each file defines, imports, calls, derives from, reads, writes, serves and
requests. Python is read by its standard parser, other languages by the line grammars of ``grammar``.

A file is one row (file, text); files are read a batch at a time and share nothing, so any number of them is read in
parallel, and a file that can't be read gives a row that says so instead of failing the others.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grammar

#: fact: def, import, base, call, read, write, resource, route, request, heading or error.
FACTS = "file string, language string, fact string, kind string, name string, owner string, target string, line int, end_line int, region_start int, level int, runs string, least_args int, most_args int"
NAMES = [x.split()[0] for x in FACTS.split(", ")]
MODULE_LEVEL, DEFERRED, TYPE_CHECKING = "module-level", "deferred", "type-checking"
#: Methods that change what they are called on.
MUTATORS = frozenset("append extend insert remove pop popitem clear update add discard setdefault sort reverse appendleft popleft __setitem__".split())


def _row(file: str, language: str, fact: str, **more) -> tuple:
    return tuple({"file": file, "language": language, "fact": fact, **more}.get(n) for n in NAMES)


def _dotted(node: ast.AST) -> str:
    """``a.b.c`` of names and attributes; empty for anything else at the root."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "super":
        return ".".join(["super", *reversed(parts)])
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


class _Python(ast.NodeVisitor):
    """Collects the facts of one module; ``scope`` holds (qualified name, is a class, local names)."""

    def __init__(self, file: str, tree: ast.Module):
        self.file, self.rows = file, []
        self.scope: list[tuple[str, bool, set[str]]] = []
        self.runs, self.guarded = MODULE_LEVEL, False
        self.state: dict[str, int] = {}
        for x in tree.body:
            for name in self._assigned(x):
                self.state.setdefault(name, x.lineno)
        for name, line in self.state.items():
            self.add("def", kind="constant" if name.isupper() else "variable", name=name, line=line, end_line=line, region_start=line)
        self.visit(tree)

    def add(self, fact: str, **more) -> None:
        self.rows.append(_row(self.file, "python", fact, **{"owner": self.scope[-1][0] if self.scope else "", **more}))

    @staticmethod
    def _assigned(x: ast.AST) -> list[str]:
        targets = x.targets if isinstance(x, ast.Assign) else [x.target] if isinstance(x, (ast.AnnAssign, ast.AugAssign)) else []
        return [y.id for t in targets for y in (t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]) if isinstance(y, ast.Name) and not y.id.startswith("__")]

    def _define(self, x, kind: str) -> None:
        outer = self.scope[-1] if self.scope else None
        name = f"{outer[0]}.{x.name}" if outer else x.name
        first = min([x.lineno, *(d.lineno for d in x.decorator_list)])
        more, local = {}, set()
        if kind != "class":
            a = x.args
            plain = [*a.posonlyargs, *a.args]
            bound = int(bool(outer and outer[1] and plain and plain[0].arg in ("self", "cls")))
            more = {"least_args": len(plain) - bound - len(a.defaults), "most_args": None if a.vararg or a.kwarg else len(plain) - bound + len(a.kwonlyargs)}
            shared = {n for y in ast.walk(x) if isinstance(y, (ast.Global, ast.Nonlocal)) for n in y.names}
            local = {y.arg for y in [*plain, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]} | {y.id for y in ast.walk(x) if isinstance(y, ast.Name) and isinstance(y.ctx, ast.Store)} - shared
        self.add("def", kind=kind, name=name, line=x.lineno, end_line=x.end_lineno, region_start=first, **more)
        for d in x.decorator_list:
            if target := _dotted(d.func if isinstance(d, ast.Call) else d):
                self.add("call", kind="decorator", target=target, owner=name, line=d.lineno)
        if kind == "class":
            for b in x.bases:
                if target := _dotted(b.value if isinstance(b, ast.Subscript) else b):
                    self.add("base", kind="base", target=target, owner=name, line=x.lineno)
        self.scope.append((name, kind == "class", local))
        before = self.runs
        if kind != "class" and self.runs == MODULE_LEVEL:
            self.runs = DEFERRED
        for y in x.body:
            self.visit(y)
        self.runs = before
        self.scope.pop()

    def visit_FunctionDef(self, x) -> None:
        self._define(x, "method" if self.scope and self.scope[-1][1] else "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, x) -> None:
        self._define(x, "class")

    def visit_If(self, x) -> None:
        checking = _dotted(x.test).split(".")[-1] == "TYPE_CHECKING"
        before, self.runs = self.runs, TYPE_CHECKING if checking else self.runs
        for y in x.body:
            self.visit(y)
        self.runs = before
        self.visit(x.test)
        for y in x.orelse:
            self.visit(y)

    def visit_Import(self, x) -> None:
        for a in x.names:
            self.add("import", kind="module", name=a.asname or a.name.split(".")[0], target=a.name, level=0, line=x.lineno, runs=self.runs)

    def visit_ImportFrom(self, x) -> None:
        for a in x.names:
            self.add("import", kind="name" if a.name != "*" else "star", name=a.asname or a.name, target=f"{x.module or ''}:{a.name}", level=x.level, line=x.lineno, runs=self.runs)

    def visit_Call(self, x) -> None:
        target = _dotted(x.func)
        if target:
            parts = target.split(".")
            if len(parts) == 2 and parts[1] in MUTATORS and self._is_state(parts[0]):
                self.add("write", kind="mutated", target=parts[0], line=x.lineno)
            open_ = any(isinstance(y, ast.Starred) for y in x.args) or any(k.arg is None for k in x.keywords)
            n = len(x.args) + len(x.keywords)
            self.add("call", kind="call", target=target, line=x.lineno, least_args=n, most_args=None if open_ else n)
        self.generic_visit(x)

    def _is_state(self, name: str) -> bool:
        return name in self.state and not any(name in local for _, _, local in self.scope)

    def visit_Name(self, x) -> None:
        if self.scope and self._is_state(x.id):
            self.add("read" if isinstance(x.ctx, ast.Load) else "write", kind="name", target=x.id, line=x.lineno)

    def visit_Subscript(self, x) -> None:
        if self.scope and isinstance(x.ctx, (ast.Store, ast.Del)) and isinstance(x.value, ast.Name) and self._is_state(x.value.id):
            self.add("write", kind="mutated", target=x.value.id, line=x.lineno)
        self.generic_visit(x)


def facts_of(file: str, text: str) -> list[tuple]:
    """The rows of one file, see ``FACTS``."""
    language = grammar.language_of(file)
    if not language:
        return []
    if language in ("markdown", "rst"):
        return [_row(file, language, "heading", kind="heading", name=t, level=k, line=a, end_line=b, region_start=a, owner="") for t, k, a, b in grammar.headings(file, text)]
    rows: list[tuple] = []
    if language == "python":
        try:
            rows += _Python(file, ast.parse(text)).rows
        except (SyntaxError, ValueError, RecursionError) as e:
            rows.append(_row(file, language, "error", kind=type(e).__name__, owner=""))
            return rows
    else:
        own = grammar.branches_blanked(text) if language in ("c", "cpp") else text
        found = grammar.definitions(file, own)
        rows += [_row(file, language, "def", kind=k, name=q, owner=q.rpartition(".")[0], line=d, end_line=e, region_start=r) for k, q, r, d, e in found]
        rows += [_row(file, language, "import", kind="module", name=names or re.split(r"[./:\\]+", re.sub(r"\.h\w*$", "", m.rstrip("./:*")))[-1], target=m, level=0, line=k, owner="", runs=MODULE_LEVEL) for k, m, names in grammar.imports(file, own)]
        rows += [_row(file, language, "base", kind=rel, target=b, owner=o, line=k) for k, o, b, rel in grammar.bases(file, own)]
        rows += _plain_calls(file, language, own, found)
    at = [(r[NAMES.index("region_start")], r[NAMES.index("end_line")], r[NAMES.index("name")]) for r in rows if r[2] == "def"]
    inside = lambda k: max(((a, -b, n) for a, b, n in at if a <= k <= b), default=(0, 0, ""))[2]
    rows += [_row(file, language, "route", kind=f, name=v, target=p, owner=h, line=k) for k, v, p, f, h in grammar.routes(file, text)]
    rows += [_row(file, language, "request", kind="request", name=v, target=u, owner=inside(k), line=k) for k, v, u in grammar.requests(file, text)]
    rows += [_row(file, language, "resource", kind=kind, name=rel, target=key, owner=inside(k), line=k) for k, kind, key, rel in grammar.resources(file, text)]
    return rows


_CALL = re.compile(r"(?<![\w$.])(?P<new>new\s+)?(?P<t>[A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*)\s*(?:<[\w, ]*>)?\(")


def _plain_calls(file: str, language: str, text: str, found: list[tuple]) -> list[tuple]:
    """Calls by name inside the definitions of a file, with the innermost definition as owner."""
    g, rows = grammar.GRAMMARS[language], []
    heads = {(d, q.split(".")[-1]) for _, q, _, d, _ in found}
    for k, line in enumerate(grammar.blanked(text, g).split("\n"), 1):
        for m in _CALL.finditer(line):
            name = m["t"].replace("::", ".").replace("->", ".")
            last = name.split(".")[-1]
            own = max(((d, -e, q) for kind, q, _, d, e in found if d <= k <= e and kind not in grammar.TYPES), default=None)
            if own is None or last in grammar.NOT_NAMES or (k, last) in heads:
                continue
            rows.append(_row(file, language, "call", kind="new" if m["new"] else "call", target=re.sub(r"^(?:this|self|Self)\.", "self.", name), owner=own[2], line=k))
    return rows


def code_facts(files: DataFrame) -> DataFrame:
    """The facts of ``files`` (file, text). Files of no known language give none; a null text counts as empty; a file
    that doesn't parse gives one row of fact ``error``. Rows of one file given twice come twice."""

    def of(batches):
        import pyarrow as pa

        kinds = [pa.int32() if x.endswith(" int") else pa.string() for x in FACTS.split(", ")]
        for batch in batches:
            rows = [r for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in facts_of(file or "", text or "")]
            columns = list(zip(*rows)) if rows else [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=NAMES)

    return files.select(F.col("file").cast("string").alias("file"), F.col("text").cast("string").alias("text")).mapInArrow(of, FACTS)
