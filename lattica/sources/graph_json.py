"""Graphs written as one JSON document, read tolerantly: several names for each field, ids as strings, order kept."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import line_of

# Fixed names of each field, first present wins.
_NODE = {"id": ("id", "name", "label"), "label": ("label", "name", "id"), "file": ("file", "path", "source_file"), "type": ("type", "file_type"), "community": ("community", "cluster"), "doc": ("doc", "docstring", "summary", "description")}
_EDGE = {"src": ("source", "from", "src"), "dst": ("target", "to", "dst"), "relation": ("relation", "label", "type"), "confidence": ("confidence",)}
_MISSING = {"id": "?", "label": "?", "file": "", "type": "", "doc": "", "src": "?", "dst": "?", "relation": "->"}


def _first(names: tuple[str, ...], default: str | None) -> Column:
    """The first key that is there and neither null nor empty; the integer 0 counts as there."""
    m = F.col("m")
    found = F.coalesce(*(F.nullif(F.try_element_at(m, F.lit(n)), F.lit("")) for n in names))
    return found if default is None else F.coalesce(found, F.lit(default))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (pos, id, label, file, type, community, doc, line, external) and edges (pos, src, dst, relation,
    confidence) of the documents at ``path``. A document that isn't an object with lists gives no rows."""
    whole = spark.read.text(path, wholetext=True)

    def part(keys: tuple[str, str]) -> DataFrame:
        lists = F.coalesce(*(F.from_json(F.get_json_object("value", f"$.{k}"), "array<map<string,string>>") for k in keys))
        return whole.select(F.posexplode(lists).alias("pos", "m"))

    nodes = part(("nodes", "vertices"))
    at = F.coalesce(_first(("line", "lineno", "start_line"), None).try_cast("int"), line_of(_first(("source_location",), "")))
    columns = [_first(v, _MISSING.get(k)).alias(k) for k, v in _NODE.items() if k != "community"]
    external = (F.lower(_first(("external",), "false")) == "true") | (_first(("type",), "") == "external")
    nodes = nodes.select(F.col("pos").cast("long").alias("pos"), *columns, _first(_NODE["community"], None).try_cast("long").alias("community"), at.alias("line"), external.alias("external"))
    edges = part(("edges", "links")).select(F.col("pos").cast("long").alias("pos"), *(_first(v, _MISSING.get(k)).alias(k) for k, v in _EDGE.items()))
    return nodes, edges


def read_rules(text: str) -> dict[str, list[str]]:
    """Layer rules: an object of prefix to list of prefixes, bare or under ``layers``."""
    raw = json.loads(text)
    raw = raw.get("layers", raw) if isinstance(raw, dict) else {}
    clean = lambda p: p.strip().removeprefix("./").rstrip("/") or p
    return {clean(k): [clean(x) for x in ([v] if isinstance(v, str) else v)] for k, v in raw.items() if isinstance(v, (list, str))}


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables as Parquet in a new folder; readers see it once it is complete."""
    nodes.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")


def prune(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes whose file is gone (files: file) and the edges at them."""
    gone = nodes.where("file <> ''").join(files.select("file").distinct(), "file", "left_anti").select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept.select(edges.columns)
