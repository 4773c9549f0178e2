"""An inverted index that is refreshed in batches: immutable segments, marks of what has gone, tiered merging."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.snapshot import cut
from . import search


@dataclass
class Segment:
    """Postings and lengths of the chunks that came in the batches up to ``batch`` and are in no other segment."""

    batch: int
    chunks: int
    postings: DataFrame
    lengths: DataFrame


@dataclass
class SegmentedIndex:
    """Postings and lengths of chunks that come, change and go; each batch writes a segment of its own rows only.

    A chunk that changes or goes is *marked* with the number of its batch: rows of earlier segments don't count any more.
    When ``fan`` neighbouring segments are of a tier (their sizes' logarithm to that base), they are written
    as one without marked rows, so each row is written anew about once a tier, and there are few segments for
    any number of batches. The driver holds a line for each segment.
    """

    terms: Callable[[Column], Column] = search.code_terms
    fan: int = 4
    segments: list[Segment] = field(default_factory=list)
    marks: DataFrame | None = None
    batch: int = 0

    def refresh(self, rows: DataFrame, removed: DataFrame | None = None) -> SegmentedIndex:
        """Takes in chunks (cid, name, path, body) that are new or have changed, and drops ``removed`` (cid). A cid may
        come once in a batch; one that is new and removed in the same batch stays. Returns the index itself."""
        self.batch += 1
        rows = cut(rows.select("cid", "name", "path", "body"), "batch")
        gone = rows.select("cid") if removed is None else rows.select("cid").union(removed.select("cid"))
        if self.segments:
            marks = gone.distinct().select("cid", F.lit(self.batch).alias("mark"))
            self.marks = cut(marks if self.marks is None else self.marks.unionByName(marks), "marks")
        postings, lengths = search.index(rows, self.terms)
        made = Segment(self.batch, 0, cut(postings, "postings"), cut(lengths, "lengths"))
        made.chunks = made.lengths.count()
        if made.chunks:
            self.segments.append(made)
        while len(tail := self.segments[-self.fan :]) == self.fan and len({self._tier(s) for s in tail}) == 1:
            self._merge(tail)
        return self

    def _tier(self, s: Segment) -> int:
        tier, size = 0, s.chunks
        while size >= self.fan:
            tier, size = tier + 1, size // self.fan
        return tier

    def _merge(self, tail: list[Segment]) -> None:
        one = Segment(tail[-1].batch, 0, cut(self._alive(tail, "postings"), "postings"), cut(self._alive(tail, "lengths"), "lengths"))
        one.chunks = one.lengths.count()
        self.segments = [s for s in self.segments if s not in tail] + [one] * bool(one.chunks)
        if self.marks is not None:  # marks that no segment is older than have nothing left to say
            first = min((s.batch for s in self.segments), default=self.batch)
            self.marks = cut(self.marks.where(F.col("mark") > first), "marks")

    def _alive(self, segments: list[Segment], what: str) -> DataFrame:
        every = reduce(DataFrame.unionByName, (getattr(s, what).withColumn("__batch", F.lit(s.batch)) for s in segments))
        if self.marks is None:
            return every.drop("__batch")
        last = self.marks.groupBy("cid").agg(F.max("mark").alias("__mark"))
        return every.join(last, "cid", "left").where(F.coalesce(F.col("__mark") <= F.col("__batch"), F.lit(True))).drop("__batch", "__mark")

    def postings(self) -> DataFrame:
        """(term, cid, tf_name, tf_path, tf_body) of the chunks that are there now."""
        return self._alive(self.segments, "postings")

    def lengths(self) -> DataFrame:
        """(cid, l_name, l_path, l_body) of the chunks that are there now."""
        return self._alive(self.segments, "lengths")

    def scores(self, terms: list[str]) -> DataFrame:
        """(cid, score, matched) as ``search.bm25f`` gives it; the terms are looked up before marks are applied."""
        if not self.segments:
            raise ValueError("the index has no chunks")
        return search.bm25f(self.postings(), self.lengths(), terms)
