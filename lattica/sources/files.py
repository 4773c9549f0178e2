"""Files of a project as tables: which ones a walk takes, what ignore files leave out, confined reads, saved names,
and vectors kept by the text's hash.

A listing has names, sizes and times only; no content is read for a file that is left out, and contents are read by
the tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension, is_vendored
from ..operators.resolve import first_by
from . import grammar

#: Larger files aren't read; folders that a walk never enters; how many files a search takes, and how large.
LARGEST, SEARCHED, SEARCH_BYTES, SNIFFED = 2 << 20, 20_000, 1 << 20, 2048
SKIPPED_DIRS = ("node_modules", "__pycache__", "venv", "env", "dist", "build", "target", "site-packages")
#: Files that state routes wherever they are.
ROUTE_FILES = r"(?:^|/)urls\.py$|(?:^|/)config/routes\.rb$|(?:^|/)routes/[^/]+\.php$"
ROUTE_LIMIT = 200


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, size, modified, path) of all files below a folder, ``file`` relative to it; contents aren't read.

    Spark's own file source passes by names with a leading ``_`` or ``.``, which sources have, so the listing is the
    file system's.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(conf)
    base = system.resolvePath(top).toString().rstrip("/")
    found, rows = system.listFiles(top, True), []
    while found.hasNext():
        x = found.next()
        path = x.getPath().toString()
        rows.append((path[len(base) + 1 :], x.getLen(), x.getModificationTime(), path))
    made = spark.createDataFrame(rows, "file string, size long, millis long, path string")
    return made.select("file", "size", F.timestamp_millis("millis").alias("modified"), "path")


def read_text(listed: DataFrame) -> DataFrame:
    """(file, text) of listed files (file, path), read by the tasks; bytes that aren't UTF-8 are replaced."""

    def of(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
                texts = []
                for path in part.column(1).to_pylist():
                    system, name = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
                    with system.open_input_file(re.sub("^/+", "/", name)) as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["file", "text"])

    return listed.select("file", "path").mapInArrow(of, "file string, text string")


def ignore_regex(pattern: str) -> str:
    """One line of an ignore file as a regular expression over a path relative to the file's folder: ``*`` stays
    inside a folder, ``**`` crosses them, a pattern with an inner slash is anchored, one that ends in a slash means
    folders (everything below)."""
    folder, body = pattern.endswith("/"), pattern.rstrip("/")
    anchored, body, out, at = "/" in body, body.lstrip("/"), "", 0
    while at < len(body):
        if body.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif body.startswith("/**", at) and at + 3 == len(body):
            out, at = out + "/.*", at + 3
        elif body[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif body[at] == "?":
            out, at = out + "[^/]", at + 1
        elif body[at] == "[" and (end := body.find("]", at + 2)) > 0:
            inner = body[at + 1 : end]
            out, at = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif body[at] == "\\" and at + 1 < len(body):
            out, at = out + re.escape(body[at + 1]), at + 2
        else:
            out, at = out + re.escape(body[at]), at + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$")


def ignored(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether ignore rules (folder, line) leave a path out: the last line that fits decides, ``!`` takes back. Rules
    of outer folders come first."""
    out = F.lit(False)
    for folder, line in rules:
        body = line.rstrip("\n")
        if not body.strip() or body.startswith("#"):
            continue
        back, body = body.startswith("!"), body.removeprefix("!").strip()
        prefix = folder.rstrip("/") + "/" if folder.strip("/") else ""
        own = path.substr(F.lit(len(prefix) + 1), F.length(path))
        fits = own.rlike(ignore_regex(body)) & (F.startswith(path, F.lit(prefix)) if prefix else F.lit(True))
        out = F.when(fits, F.lit(not back)).otherwise(out)
    return out


def discover(listed: DataFrame, rules: list[tuple[str, str]] = (), docs: bool = True, largest: int = LARGEST) -> DataFrame:
    """(file, status) of listed files (file, size): ``read``, or why not: hidden, ignored, environment, too_large,
    unknown. A folder with ``pyvenv.cfg`` is an environment. In order of the path."""
    homes = listed.where(F.endswith("file", F.lit("/pyvenv.cfg"))).select(F.regexp_replace("file", "/pyvenv.cfg$", "").alias("home")).distinct()
    # a file's folders against the environments, however many there are
    parts = F.split("file", "/")
    above = listed.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("home"))
    inside = above.join(homes, "home", "left_semi").select("file").distinct().withColumn("inside", F.lit(True))
    listed = listed.join(inside, "file", "left")
    in_env = F.coalesce("inside", F.lit(False))
    wanted = [e for e in grammar.LANGUAGE if docs or grammar.LANGUAGE[e] not in ("markdown", "rst")]
    status = F.when(F.col("file").rlike(r"(?:^|/)\.[^/]"), "hidden").when(ignored(F.col("file"), list(rules)), "ignored").when(in_env, "environment").when(~extension(F.col("file")).isin(*wanted), "unknown").when(F.col("size") > largest, "too_large").otherwise("read")
    return listed.select("file", status.alias("status")).orderBy("file")


def search_walk(listed: DataFrame, extra: DataFrame | None = None, most: int = SEARCHED) -> DataFrame:
    """(file) that a search takes: source files outside hidden and skipped folders, the first ``most`` by path, and
    files of the graph (extra: file) that the walk passes by."""
    dirs = F.split("file", "/")
    inner = F.slice(dirs, 1, F.greatest(F.size(dirs) - 1, F.lit(0)))
    kept = listed.where(extension(F.col("file")).isin(*grammar.LANGUAGE) & ~F.exists(inner, lambda d: F.startswith(d, F.lit(".")) | d.isin(*SKIPPED_DIRS)))
    first = kept.select("file").orderBy("file").limit(most)
    return first if extra is None else first.unionByName(extra.select("file").join(first, "file", "left_anti")).distinct()


def index_state(files: DataFrame, largest: int = SEARCH_BYTES) -> DataFrame:
    """(file, skipped) of files (file, size, text): empty if it is indexed, else vendored, oversize or binary."""
    head = F.substring("text", 1, SNIFFED)
    return files.select("file", F.when(is_vendored(F.col("file")), "vendored").when(F.col("size") > largest, "oversize").when(F.contains(head, F.lit("\x00")), "binary").otherwise("").alias("skipped"))


def route_candidates(listed: DataFrame, graph_files: DataFrame, most: int = ROUTE_LIMIT) -> DataFrame:
    """(file) that may state routes and that the graph (file) hasn't, the first ``most`` by path."""
    return listed.where(F.col("file").rlike(ROUTE_FILES)).select("file").join(graph_files.select("file").distinct(), "file", "left_anti").orderBy("file").limit(most)


def relevant(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``files`` (file, ...) that a graph could hold: they have nodes, or a language is known."""
    held = nodes.where("file <> ''").select("file").distinct()
    known = files.where(extension(F.col("file")).isin(*grammar.LANGUAGE))
    return known.unionByName(files.join(held, "file", "left_semi").where(~extension(F.col("file")).isin(*grammar.LANGUAGE)).select(files.columns))


def confined(path: Column) -> Column:
    """A relative path without ``.`` and ``..`` steps; null if it leaves its root or is absolute."""
    steps = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit(True).alias("ok"))
    walked = F.aggregate(
        steps, state,
        lambda s, x: F.when(x.isin("", "."), s).when(x == "..", F.struct(F.when(F.size(s["done"]) > 0, F.slice(s["done"], 1, F.size(s["done"]) - 1)).otherwise(s["done"]).alias("done"), (s["ok"] & (F.size(s["done"]) > 0)).alias("ok"))).otherwise(F.struct(F.concat(s["done"], F.array(x)).alias("done"), s["ok"].alias("ok"))),
    )
    outside = path.rlike(r"^(?:/|[A-Za-z]:|~)") | ~walked["ok"]
    return F.when(~outside & (F.size(walked["done"]) > 0), F.array_join(walked["done"], "/"))


def read_lines(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, lo, hi, line, text) of wanted lines (file, lo, hi) of files (file, text): from 1, clamped to the file;
    nothing for a path that leaves its root or isn't there."""
    own = wanted.select(F.col("file").alias("asked"), "lo", "hi", confined(F.col("file")).alias("file")).where("file is not null")
    met = own.join(files.select("file", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines")), "file")
    lo, hi = F.greatest(F.lit(1), F.col("lo")), F.least(F.col("hi"), F.size("lines"))
    cut_ = met.withColumn("from", lo).withColumn("rows", F.slice("lines", lo, F.greatest(hi - lo + 1, F.lit(0))))
    return cut_.select(F.col("asked").alias("file"), "lo", "hi", F.posexplode("rows").alias("i", "text"), "from").select("file", "lo", "hi", (F.col("from") + F.col("i")).alias("line"), "text")


def set_labels(saved: DataFrame, given: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, rejected): saved names (community, name) with the given ones in their place; ids that no community
    (known: community) has are rejected, blank names take a name away."""
    ids = known.select("community").distinct()
    fresh = given.join(ids, "community", "left_semi").select("community", F.trim("name").alias("name"))
    kept = saved.join(fresh, "community", "left_anti").select("community", "name").unionByName(fresh.where("name <> ''"))
    return kept, given.join(ids, "community", "left_anti").select("community")


def update_vectors(store: DataFrame, texts: DataFrame, embed, dimension: int) -> tuple[DataFrame, int]:
    """(store, n): vectors (key, embedding) of texts (text) by the text's hash. Only the ``n`` texts that the store
    hasn't are embedded, in batches, by ``embed`` (a list of texts to an array); keys that no text has go."""
    keyed = texts.select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("key"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["key"])
    unseen = keyed.join(store.select("key"), "key", "left_anti")

    def of(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                rows = np.asarray(embed(batch.column(1).to_pylist()), np.float32).reshape(batch.num_rows, dimension)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows), pa.list_(pa.float32()))], names=["key", "embedding"])

    kept = store.join(keyed.select("key"), "key", "left_semi").select("key", F.col("embedding").cast("array<float>").alias("embedding"))
    return kept.unionByName(unseen.mapInArrow(of, "key string, embedding array<float>")), unseen.count()


def static_embedding(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, embedding): the normalised mean of the vectors (token, embedding) of each text's (key, text) words; a text
    without known words has none."""
    words = texts.select("key", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), 0)).alias("token"))
    parts = words.join(tokens, "token").select("key", F.posexplode("embedding").alias("i", "x"))
    sums = parts.groupBy("key", "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    rows = sums.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")).where("norm > 0")
    return rows.select("key", F.transform("v", lambda p: (p["x"] / F.col("norm")).cast("float")).alias("embedding"))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key: what an appended table says now."""
    return first_by(rows, keys, *order)


def addable(url: Column, offline: bool = False) -> Column:
    """Whether an outside document may be added: web addresses only, and none offline."""
    return F.lit(not offline) & F.coalesce(url.rlike(r"^(?i)https?://[^/\s]+"), F.lit(False))
