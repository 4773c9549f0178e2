"""Degrees and lint of a graph kept up to date under edges that come and go: signed counts, written by batch."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.snapshot import cut, shared_dir

#: Rows of a file of counts, about, if a part has more.
FILE = 1_000_000
_LINT = ("dangling", "self_loops", "recursive", "duplicates", "orphans")


@dataclass
class SignedCounts:
    """Counts of keys as the sum of signed ones in immutable segments, each stored by parts of the keys' hash.

    A batch writes its own keys only, and reads those parts of the segments in which its keys lie. When ``fan`` neighbouring segments
    are of a size (their logarithm to that base), they are written as one, so each row is written anew about once a size.
    """

    spark: SparkSession
    keys: dict[str, str]
    parts: int
    fan: int
    segments: list[tuple[str, int]] = field(default_factory=list)

    def _part(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def _read(self, paths: list[str]) -> DataFrame:
        schema = ", ".join(f"{k} {t}" for k, t in self.keys.items()) + ", n long, part int"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, (self.spark.read.schema(schema).parquet(p) for p in paths))

    def _dealt(self, rows: DataFrame, n: int) -> DataFrame:
        """At most ``n`` rows dealt to tasks by part, several tasks for a part of more than ``FILE``: all rows of a key to the task that
        deal numbers, so that no task has two parts while another has none."""
        pieces = 1 + n // (self.parts * FILE)
        piece = F.pmod(F.xxhash64(F.lit("piece"), *self.keys), F.lit(pieces)).cast("int")
        return rows.withColumn("deal", piece * self.parts + self._part()).repartitionById(self.parts * pieces, "deal")

    def _write(self, dealt: DataFrame) -> tuple[str, DataFrame]:
        """Writes dealt rows, a file for each task; read again with all their columns."""
        path = f"{shared_dir(self.spark)}/counts-{uuid.uuid4().hex}"
        rows = dealt.withColumn("part", F.pmod("deal", F.lit(self.parts))).drop("deal")
        rows.write.partitionBy("part").parquet(path)
        return path, self.spark.read.schema(rows.schema).parquet(path)

    def rows(self) -> DataFrame:
        """The keys whose count isn't zero, with it as n."""
        return self._read([p for p, _ in self.segments]).groupBy(*self.keys).agg(F.sum("n").alias("n")).where("n <> 0")

    def found(self, parts: list[int]) -> DataFrame:
        """Signed counts in the segments' ``parts``: other folders aren't listed for a scan."""
        return self._read([p for p, _ in self.segments]).where(F.col("part").isin(parts))

    def meet(self, delta: DataFrame, where: str, known: SignedCounts | None = None) -> tuple[str, DataFrame]:
        """Writes ``delta`` (keys, n and other numbers), a written table, with a key's rows added up, with the count of each key up to now as
        was and, given ``known``, whether that holds the key as there; only what ``where`` says. Null keys are keys, but not known ones.

        All of it meets in one shuffle, of the delta and of those parts in which its keys lie, and what is written can be the next segment.
        """
        parts = [r[0] for r in delta.select(self._part()).distinct().collect()]  # numbers below self.parts
        numbers = [c for c in delta.columns if c not in self.keys]
        none = [F.lit(0).cast("long").alias(c) for c in numbers]
        zero, no = F.lit(0).cast("long"), F.lit(False)
        met = delta.select(*self.keys, *(F.col(c).cast("long").alias(c) for c in numbers), zero.alias("was"), no.alias("there"))
        met = met.unionByName(self.found(parts).select(*self.keys, *none, F.col("n").alias("was"), no.alias("there")))
        n = delta.count() + sum(k for _, k in self.segments)
        if known is not None:
            named = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in self.keys))
            met = met.unionByName(known.found(parts).where(named).select(*self.keys, *none, zero.alias("was"), F.lit(True).alias("there")))
            n += sum(k for _, k in known.segments)
        sums = [F.sum(c).alias(c) for c in (*numbers, "was")] + ([F.max("there").alias("there")] if known is not None else [])
        return self._write(self._dealt(met, n).groupBy("deal", *self.keys).agg(*sums).where(where))

    def _size(self, n: int) -> int:
        size = 0
        while n >= self.fan:
            size, n = size + 1, n // self.fan
        return size

    def add(self, path: str, n: int) -> None:
        """Takes in ``n`` written rows, one for a key, as a segment."""
        if n:
            self.segments = [*self.segments, (path, n)]
        while len(tail := self.segments[-self.fan :]) == self.fan and len({self._size(k) for _, k in tail}) == 1:
            rest = self.segments[: -self.fan]
            every = self._dealt(self._read([p for p, _ in tail]), sum(k for _, k in tail))
            path, merged = self._write(every.groupBy("deal", *self.keys).agg(F.sum("n").alias("n")).where("n <> 0"))
            n = merged.count()
            self.segments = [*rest, (path, n)] if n else rest


@dataclass
class MaintainedGraph:
    """Degrees and lint (``degree.validate``) of a graph of fixed nodes (id) after batches of edges that come or go.

    Counts lie in ``parts`` folders by hash: more of them make small batches read less, at some tens of milliseconds a folder written. The state is a folder: what a batch has written counts once its
    line in the folder's log is there, so a batch that fails is made again, a batch that comes again is passed over, and a
    new session that opens the folder goes on.
    """

    spark: SparkSession
    folder: str
    nodes: DataFrame
    parts: int = 16
    fan: int = 4

    def __post_init__(self) -> None:
        kinds = {"edges": {"src": "string", "dst": "string", "relation": "string"}, "degrees": {"id": "string"}, "ids": {"id": "string"}}
        self._counts = {name: SignedCounts(self.spark, keys, self.parts, self.fan) for name, keys in kinds.items()}
        try:
            log = self.spark.read.schema("state string, batch long").parquet(f"{self.folder}/log")
            last = log.orderBy(F.desc("batch")).limit(1).collect()
        except AnalysisException:  # no batch yet
            last = []
        if last:
            state = json.loads(last[0].state)
            self.batch, self.lint = last[0].batch, state["lint"]
            for name, segments in state["segments"].items():
                self._counts[name].segments = [tuple(s) for s in segments]
        else:
            self.batch, self.lint = -1, dict.fromkeys(_LINT, 0)
        ids = self._counts["ids"]
        if not ids.segments:
            own = self.nodes.select(F.col("id").cast("string").alias("id")).distinct().withColumn("n", F.lit(1).cast("long"))
            path, written = ids._write(ids._dealt(own, self.nodes.count()))
            ids.segments = [(path, written.count())]
            if self.batch < 0:
                self.lint["orphans"] = ids.segments[0][1]

    def apply(self, changes: DataFrame, batch: int | None = None) -> MaintainedGraph:
        """Takes in ``changes`` (src, dst, relation, n): n copies of an edge that come, or go if n is below zero; rows of an edge add up.

        ``batch`` is its number in a stream (for ``foreachBatch``): one that isn't above the last is passed over. ``ValueError``, with the
        state as it was, if more copies go than there are. Returns the graph itself.
        """
        batch = self.batch + 1 if batch is None else batch
        if batch <= self.batch:
            return self
        edges, degrees = self._counts["edges"], self._counts["degrees"]
        path, moved = edges.meet(cut(changes.select("src", "dst", "relation", "n"), "changes"), "n <> 0")
        lint = self._edge_lint(moved)
        n_edges, least = lint.pop("rows"), lint.pop("least")
        if least is not None and least < 0:
            raise ValueError("more copies of an edge go than there are")
        ends = moved.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out")))).alias("e"), "n").select("e.id", "e.out", "n")
        ends = cut(ends.groupBy("id").agg(F.sum("n").alias("n"), F.sum("out").alias("outs"), F.sum(1 - F.col("out")).alias("ins")), "ends")
        ends_path, turned = degrees.meet(ends, "outs + ins > 0", self._counts["ids"])
        n_ends, lint["orphans"], lint["dangling"] = self._end_lint(moved, turned)
        kept = edges.segments, degrees.segments
        try:
            edges.add(path, n_edges)
            degrees.add(ends_path, n_ends)
            now = {k: self.lint[k] + lint[k] for k in _LINT}
            state = json.dumps({"lint": now, "segments": {name: c.segments for name, c in self._counts.items()}})
            self.spark.createDataFrame([(state, batch)], "state string, batch long").coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        except Exception:
            edges.segments, degrees.segments = kept
            raise
        self.lint, self.batch = now, batch
        return self

    def _edge_lint(self, moved: DataFrame) -> dict[str, int]:
        """How the counts change with edges (src, dst, relation, n, was), how many rows there are, and the least count after them."""
        loop, call = F.col("src") == F.col("dst"), F.lower(F.trim("relation")).isin("calls", "indirect_call")
        copies = lambda n: F.greatest(n - 1, F.lit(0))
        total = lambda x: F.coalesce(F.sum(x), F.lit(0))
        return moved.agg(
            F.count("*").alias("rows"),
            F.min(F.col("was") + F.col("n")).alias("least"),
            total(F.when(loop & ~call, F.col("n"))).alias("self_loops"),
            total(F.when(loop & call, F.col("n"))).alias("recursive"),
            total(copies(F.col("was") + F.col("n")) - copies(F.col("was"))).alias("duplicates"),
        ).first().asDict()

    def _end_lint(self, moved: DataFrame, turned: DataFrame) -> tuple[int, int, int]:
        """Rows of ``turned`` (id, n, outs, ins, was, there), how the number of orphans changes, and that of dangling edges.

        An edge dangles for either end that is no node, so once too often for two: only those are looked up, and only
        where unknown ids are both sources and targets.
        """
        after, lost = F.col("was") + F.col("n"), ~F.col("there")
        n, orphans, ends, outs, ins = turned.agg(
            F.count("*"),
            F.count_if(F.col("there") & (after == 0)) - F.count_if(F.col("there") & (F.col("was") == 0)),
            F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0)),
            F.count_if(lost & (F.col("outs") > 0)),
            F.count_if(lost & (F.col("ins") > 0)),
        ).first()
        if outs and ins:
            of = lambda end, side: turned.where(lost & (F.col(side) > 0)).select(F.col("id").alias(f"_{end}"))
            both = moved.join(of("src", "outs"), F.col("src").eqNullSafe(F.col("_src")), "left_semi").join(of("dst", "ins"), F.col("dst").eqNullSafe(F.col("_dst")), "left_semi")
            ends -= both.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return n, orphans, ends

    def degrees(self) -> DataFrame:
        """(id, degree), as ``degree.degrees`` counts them."""
        return self._counts["degrees"].rows().withColumnRenamed("n", "degree")

    def edges(self) -> DataFrame:
        """(src, dst, relation, n): the edges that are there, with their copies."""
        return self._counts["edges"].rows()

    def validated(self) -> DataFrame:
        """One row, as ``degree.validate`` gives it; read off, not counted."""
        return self.spark.createDataFrame([tuple(self.lint[k] for k in _LINT)], ", ".join(f"{k} long" for k in _LINT))
