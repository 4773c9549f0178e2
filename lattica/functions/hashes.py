"""Hashes that Spark has no function for, in Arrow batches."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fnv1a(data: bytes) -> int:
    """The 64-bit FNV-1a hash, unsigned."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_hex(text: Column) -> Column:
    """FNV-1a of a string's UTF-8 as 16 hex digits; null stays null."""

    @F.pandas_udf("string")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else f"{fnv1a(t.encode()):016x}")

    return of(text)


def blake2b_hex(text: Column, size: int = 16) -> Column:
    """BLAKE2b of a string's UTF-8, ``size`` bytes as hex digits; null stays null."""

    @F.pandas_udf("string")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=size).hexdigest())

    return of(text)


def member_signature(members: DataFrame, group: str, member: str) -> DataFrame:
    """(group, n, signature): FNV-1a of a group's sorted members joined by zero characters.

    A group is gathered as one array; for groups without a bound use ``degree.set_signature``, which sums hashes.
    """
    own = members.select(group, F.col(member).cast("string").alias("m")).where("m is not null").distinct()
    listed = own.groupBy(group).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("m")), "\x00").alias("all"))
    return listed.select(group, "n", fnv1a_hex(F.col("all")).alias("signature"))
