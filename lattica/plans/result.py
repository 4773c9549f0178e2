"""What a tool answers: rows in order, how many there are in all, and whether some were left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame


@dataclass
class Result:
    """``rows`` are the first ``limit`` in order; ``total`` counts all; ``hint`` says how to see more."""

    rows: DataFrame
    total: int
    limit: int
    hint: str = ""

    @property
    def truncated(self) -> bool:
        return self.total > self.limit

    @property
    def meta(self) -> dict:
        out = {"total": self.total, "shown": min(self.total, self.limit), "truncated": self.truncated}
        return out | ({"hint": self.hint} if self.truncated and self.hint else {})


def limited(df: DataFrame, limit: int, *order: Column, hint: str = "") -> Result:
    """The first ``limit`` rows in a total order, with the count of all. ``ValueError`` for a limit below one."""
    if limit < 1:
        raise ValueError("a limit is one or more")
    return Result(df.orderBy(*order).limit(limit), df.count(), limit, hint)
