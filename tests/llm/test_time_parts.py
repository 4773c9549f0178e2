import datetime as dt
import glob
import hashlib
import zlib
from calendar import monthrange
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lattica.llm import time_parts

MARCH = dt.datetime(2024, 3, 1)


def moment(ts, click_id):
    if ts is None or click_id is None:
        return ts
    k = zlib.crc32(str(click_id).encode()) % 128
    if k < 16:
        return ts - dt.timedelta(days=(k + 6) ** 3)
    return dt.datetime.combine(ts.date() - dt.timedelta(days=ts.weekday()), dt.time()) if k > 111 else ts


def leaf_names(moments, limit):
    """{(y, m, d, h) prefix: leaf} by recursion over lists of moments."""
    out = {}

    def fill(parents, siblings, level):
        run, size = [], None
        runs = []
        for k in siblings:
            n = sum(1 for m in moments if (m.year, m.month, m.day, m.hour)[: level + 1] == (*parents, k))
            if n > limit and level < 3:
                nxt = [range(1, 13), range(1, monthrange(*(*parents, k)[:2], )[1] + 1) if level == 1 else [], range(24)][level]
                fill((*parents, k), nxt, level + 1)
                run, size = [], None
            elif size is not None and size + n <= limit:
                run.append(k)
                size += n
            else:
                run, size = [k], n
                runs.append(run)
        text = lambda k: f"{k:02d}" if level else f"{k:04d}"
        for r in runs:
            for k in r:
                out[(*parents, k)] = "/".join([*(f"{p:04d}" if i == 0 else f"{p:02d}" for i, p in enumerate(parents)), f"{text(r[0])}-{text(r[-1])}"])

    if moments:
        years = [m.year for m in moments]
        fill((), range(min(years), max(years) + 1), 0)
    return out


def layout(rows, limit):
    """{(leaf, part): [row, ...]} of rows (moment, arrived_at, click_id, whole row)."""
    names = leaf_names([r[0] for r in rows if r[0]], limit)
    leaves = defaultdict(list)
    for r in rows:
        m = r[0]
        leaf = "null" if m is None else next(names[p] for n in range(1, 5) if (p := (m.year, m.month, m.day, m.hour)[:n]) in names)
        leaves[leaf].append(r)
    low = (dt.datetime.min, -1)
    out = {}
    for leaf, own in leaves.items():
        own.sort(key=lambda r: (r[0] or low[0], r[1] is not None, r[1] or low[0], r[2] is not None, r[2] or 0))
        for at in range(0, len(own), limit):
            out[leaf, at // limit + 1] = own[at : at + limit]
    return out


def expected(rows, limit=None):
    """rows: (ts, arrived_at, click_id, whole row)."""
    limit = limit or 1 + len(rows) // 650
    rows = [(moment(ts, i), a, i, row) for ts, a, i, row in rows]
    start, final = layout([r for r in rows if r[1] is not None and r[1] < MARCH], limit), layout(rows, limit)
    same = lambda x, y: x is not None and sorted(map(repr, x)) == sorted(map(repr, y))
    return sorted(
        (leaf, part, len(own), sum(1 for r in own if not (r[1] is not None and r[1] < MARCH)), hashlib.sha256(",".join("" if r[2] is None else str(r[2]) for r in own).encode()).hexdigest(), not same(start.get((leaf, part)), own))
        for (leaf, part), own in final.items()
    )


def check(df, rows, result, limit=None):
    got = result.collect()
    assert sorted((r.leaf, r.part, r.n_rows, r.n_new, r.ids_sha256, r.rewritten) for r in got) == expected(rows, limit)
    for r in got:
        assert r.columns == ",".join(df.columns)
        own = pq.ParquetFile(r.path.removeprefix("file:").replace("///", "/")).read()
        assert own.column_names == df.columns and own.num_rows == r.n_rows
    if got:
        root = got[0].path.removeprefix("file:").replace("///", "/").rsplit("/", 3)[0]
        assert len(glob.glob(f"{root}/**/*.parquet", recursive=True)) == len(got)
    return got


def rows_of(df):
    return [(r.ts, r.arrived_at, r.click_id, tuple(r)) for r in df.collect()]


def test_every_click(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/clicks.parquet")
    result = time_parts.op12_time_parts(spark, "/root/testdata/sf0.001")
    assert result.dtypes == [("leaf", "string"), ("part", "bigint"), ("n_rows", "bigint"), ("n_new", "bigint"), ("columns", "string"), ("ids_sha256", "string"), ("path", "string"), ("rewritten", "boolean")]
    got = check(df, rows_of(df), result)
    assert {r.rewritten for r in got} == {True, False} and any(r.part > 1 for r in got)


def started():
    return F.col("arrived_at") < F.expr("timestamp_ntz'2024-03-01 00:00:00'")


def lay(df, **more):
    return time_parts.layouts(df, time_parts.click_moment(), ["arrived_at", "click_id"], started(), "click_id", **more)


@pytest.mark.parametrize("limit", [1, 7])
def test_odd_rows(spark, limit):
    t = lambda *a: dt.datetime(2024, *a)
    rows = [(None, t(1, 5), 7), (None, None, None), (t(2, 29, 23, 59), t(2, 29, 23, 59), 5), (t(3, 1), t(3, 1), 6), (t(1, 1), t(1, 1), None), (t(1, 1), None, 9), (t(12, 31, 23), t(1, 2), 11)]
    rows += [(t(1, 3, 4, 5), t(1, 3, 5), 42)] * 20 + [(t(1, 3, 4, 5), t(1, 3, 5), 10 + i) for i in range(30)] + [(t(1 + i % 5, 1 + i % 28, i % 24), t(1 + i % 5, 1 + i % 28, i % 24), 100 + i) for i in range(60)]
    df = spark.createDataFrame([(i, ts, a, f"x{i}", n % 3, "y", True, 1) for n, (ts, a, i) in enumerate(rows)], "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, leaf string, part int, row string, new boolean, key int")
    check(df, rows_of(df), lay(df, limit=limit), limit)
    assert lay(df.where("false")).collect() == []
    late = df.where("arrived_at >= '2024-03-01'")
    check(late, rows_of(late), lay(late, limit=limit), limit)


def test_equal_rows_are_cut_into_buckets(spark):
    """Half of the rows are one row; no bucket holds more than a few files' worth of them."""
    t = dt.datetime(2024, 1, 1, 5)
    df = spark.createDataFrame([(1, t, t)] * 5000 + [(i, t + dt.timedelta(minutes=i), t) for i in range(5000)], "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz")
    limit = 200
    rows = time_parts.keyed(df, F.col("ts"), ["arrived_at", "click_id"], started(), limit)
    led = time_parts._led(rows, time_parts.leaves_of(rows.groupBy(*time_parts.LEVELS).agg(F.count("*").alias("n")), limit))
    pivots = led.where("pivot").groupBy("leaf").agg(F.sort_array(F.collect_set("key")).alias("pivots"))
    sizes = led.join(pivots, "leaf", "left").groupBy("leaf", time_parts._bucket(F.col("key"), F.col("pivots"))).count().collect()
    assert max(r["count"] for r in sizes) < 3 * limit and sum(r["count"] for r in sizes) == 10_000


def test_runs():
    assert time_parts.runs([(1, 2), (2, 0), (3, 2), (4, 9), (5, 0), (6, 4), (7, 1)], 4) == ([([1, 2, 3], 4), ([5, 6], 4), ([7], 1)], [4])
