"""Scope: which nodes a question is about. A scope string becomes column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dirname, is_test_path, is_vendored


@dataclass
class Scope:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    tests: bool = True
    external: bool = True
    vendored: bool = True


# Fixed names of the flags.
FLAGS = {"tests": "tests", "test": "tests", "external": "external", "externals": "external", "vendored": "vendored", "vendor": "vendored", "minified": "vendored"}


def clean_pattern(pattern: str) -> str:
    """Without a trailing ``/**``, ``/*`` or ``/``, and a leading ``./``."""
    return re.sub(r"(/\*\*|/\*|/)$", "", re.sub(r"^\./", "", pattern))


def parse_scope(spec: str | None, navigation: bool = False) -> Scope:
    """Tokens split at commas and white space: ``all``; ``+`` or ``-`` with a flag of ``FLAGS``; ``!pattern``; else a
    pattern to include. Ranking questions leave vendored and external code out unless told otherwise, navigation
    leaves nothing out. ``ValueError`` names a flag that isn't known."""
    scope = Scope(external=navigation, vendored=navigation)
    for token in re.split(r"[,\s]+", spec or ""):
        if token.lower() == "all":
            scope.tests = scope.external = scope.vendored = True
        elif token[:1] in ("+", "-"):
            if token[1:].lower() not in FLAGS:
                raise ValueError(f"unknown scope flag {token!r}: + or - with one of {', '.join(FLAGS)}, or 'all'")
            setattr(scope, FLAGS[token[1:].lower()], token[0] == "+")
        elif pattern := clean_pattern(token.removeprefix("!")):
            (scope.exclude if token[0] == "!" else scope.include).append(pattern)
    return scope


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression; ``*`` also matches ``/``."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        end = pattern.find("]", at + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[at + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            at = end
        else:
            out += re.escape(c)
        at += 1
    return f"(?s)^{out}$"


def path_matches(pattern: str, path: Column) -> Column:
    """A plain pattern matches a path, all below it, and the path without its extension; a glob the path or all
    below what it matches."""
    if re.search(r"[*?\[]", pattern):
        return path.rlike(glob_regex(pattern)) | path.rlike(glob_regex(pattern + "/*"))
    return (path == pattern) | F.startswith(path, F.lit(pattern + "/")) | (F.regexp_replace(path, r"\.[^./]*$", "") == pattern)


def keeps_path(scope: Scope, path: Column) -> Column:
    any_of = lambda ps: reduce(lambda a, b: a | b, (path_matches(p, path) for p in ps), F.lit(False))
    return (any_of(scope.include) if scope.include else F.lit(True)) & ~any_of(scope.exclude)


def reason(scope: Scope, nodes: DataFrame) -> Column:
    """Why a node is left out, first of vendored, external, tests, filtered; null if it stays."""
    path = F.coalesce(F.col("file"), F.lit(""))
    out = F.when(is_vendored(path) & F.lit(not scope.vendored), "vendored")
    if "external" in nodes.columns:
        out = out.when(F.coalesce(F.col("external"), F.lit(False)) & F.lit(not scope.external), "external")
    return out.when(is_test_path(path) & F.lit(not scope.tests), "tests").when(~keeps_path(scope, path), "filtered")


@dataclass
class View:
    nodes: DataFrame
    edges: DataFrame
    dropped: DataFrame

    def left_out(self) -> DataFrame:
        return self.dropped.groupBy("reason").agg(F.count("*").alias("n"))

    def vendored_dirs(self, top: int = 3) -> DataFrame:
        return self.dropped.where("reason = 'vendored'").groupBy(dirname(F.col("file")).alias("dir")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dir").limit(top)


def scoped(nodes: DataFrame, edges: DataFrame, spec: str | None, navigation: bool = False) -> View:
    """Nodes that stay, and edges neither end of which was dropped: an end that never was a node doesn't drop it."""
    judged = nodes.withColumn("reason", reason(parse_scope(spec, navigation), nodes))
    dropped = judged.where("reason is not null")
    gone = dropped.select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return View(judged.where("reason is null").drop("reason"), kept.select(edges.columns), dropped)


def strict(edges: DataFrame) -> DataFrame:
    """Edges that were read, not guessed; a missing confidence counts as read."""
    return edges.where(F.coalesce(F.upper("confidence"), F.lit("EXTRACTED")) == "EXTRACTED")


# Fixed vocabulary of relations.
IMPORTS = ("imports", "imports_from", "dynamic_import", "re_exports", "requires")
CALLS = ("calls", "indirect_call")
CONTAINMENT = ("contains", "method", "defines", "case_of")
NON_DEPENDENCY = (*CONTAINMENT, "rationale_for")
STATE = ("reads", "writes", "written_by")
HTTP = ("handles", "http_calls")
TYPES = ("inherits", "extends", "implements", "mixes_in", "embeds", "uses")
MEMBERS_USED = ("references", "dispatches_to", "references_constant", "uses_static_prop")
PRESETS = {"all": None, "code": (*IMPORTS, *CALLS, *TYPES, *MEMBERS_USED, *HTTP), "calls": (*CALLS, "dispatches_to"), "imports": IMPORTS, "types": TYPES, "state": STATE, "http": HTTP}


def relations(spec: str | None) -> tuple[str, ...] | None:
    """Presets and single relations, together; None: no filter."""
    tokens = [x for x in re.split(r"[,\s]+", (spec or "").lower()) if x]
    if not tokens or "all" in tokens:
        return None
    return tuple(dict.fromkeys(r for x in tokens for r in PRESETS.get(x) or (x,)))


def of_relations(edges: DataFrame, spec: str | None) -> DataFrame:
    wanted = relations(spec)
    return edges if wanted is None else edges.where(F.lower(F.trim("relation")).isin(*wanted))


def search_nodes(nodes: DataFrame, edges: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """Nodes whose label or id contains the pattern, in graph order, with degree and how many there are in all."""
    from .degree import degrees

    p = F.lit(pattern.lower())
    hits = nodes.where(F.contains(F.lower("label"), p) | F.contains(F.lower("id"), p))
    total = hits.agg(F.count("*").alias("total"))
    first = hits.orderBy("pos").limit(limit)
    return first.join(degrees(edges), "id", "left").fillna(0, ["degree"]).crossJoin(F.broadcast(total)).select("id", "label", "type", "degree", "total")  # total: one row
