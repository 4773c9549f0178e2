"""What ``git`` prints, as tables: history, status, differences. The text is read as it stands (saved output, or a
command's), so any number of repositories' logs can be read as rows, and no operator starts a process.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.snapshot import cut
from . import grammar

#: Commits of more files than this say nothing about what belongs together; below so many commits nothing is known.
BULK, LEAST_COMMITS = 30, 10
COMMITS = "repo string, commit_pos long, commit string, status string, old string, file string"


def read_log(logs: DataFrame) -> DataFrame:
    """(repo, commit_pos, commit, status, old, file): a row for each file of each commit of ``logs`` (repo, log), where
    ``log`` is the text of ``git log --name-status`` with a record separator (1E) before each commit; newest first.

    ``old`` is a renamed or copied file's earlier path. Commits without files give a row of null file. A null log gives
    no rows.
    """
    records = logs.select("repo", F.posexplode(F.split("log", "\x1e")).alias("commit_pos", "record")).where(F.trim(F.regexp_replace("record", r"\s", "")) != "")
    lines = records.select("repo", F.col("commit_pos").cast("long").alias("commit_pos"), F.filter(F.split("record", "\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    rows = lines.select("repo", "commit_pos", F.trim(F.col("lines")[0]).alias("commit"), F.explode_outer(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"))
    parts = F.split("line", "\t")
    status, moved = F.substring(parts[0], 1, 1), F.substring(parts[0], 1, 1).isin("R", "C") & (F.size(parts) >= 3)
    return rows.select("repo", "commit_pos", "commit", status.alias("status"), F.when(moved, F.try_element_at(parts, F.lit(2))).alias("old"), F.when(moved, F.try_element_at(parts, F.lit(3))).otherwise(F.try_element_at(parts, F.lit(2))).alias("file"))


def current_names(commits: DataFrame, rounds: int = 60) -> DataFrame:
    """``commits`` with ``file`` as the name that it has now: a rename makes all older commits' rows of the old path
    rows of the new one, and chains of renames end at their newest name."""
    renames = commits.where("status = 'R' and old is not null").select("repo", F.col("old").alias("path"), F.col("file").alias("to"), F.col("commit_pos").alias("at"))
    # where a path was given away and, later, made anew: a row follows the nearest newer rename of its path
    now = cut(commits.withColumn("place", F.monotonically_increasing_id()).withColumn("from_pos", F.col("commit_pos")), "history")
    for _ in range(rounds):
        met = now.join(renames.withColumnRenamed("path", "file"), ["repo", "file"]).where(F.col("at") < F.col("from_pos"))
        nearest = met.groupBy("place").agg(F.max_by(F.struct("to", "at"), "at").alias("m"))
        new = now.join(nearest, "place", "left")
        new = cut(new.select("repo", "commit_pos", "commit", "status", "old", F.coalesce("m.to", "file").alias("file"), "place", F.coalesce("m.at", "from_pos").alias("from_pos"), F.col("m").isNotNull().alias("moved")), "history")
        now = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return now.drop("place", "from_pos")
    raise RuntimeError(f"renames aren't followed in {rounds} rounds")


def commit_files(commits: DataFrame, tracked: DataFrame) -> DataFrame:
    """(repo, commit_pos, commit, file) of tracked files (repo, file) only, by their names of now."""
    named = current_names(commits).where("file is not null").select("repo", "commit_pos", "commit", "file").distinct()
    return named.join(tracked.select("repo", "file").distinct(), ["repo", "file"], "left_semi").select("repo", "commit_pos", "commit", "file")


def history_state(commits: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, commits, bulk, usable): how many commits there are, how many were too large to count, and whether there
    are enough to say what changes together."""
    total = commits.groupBy("repo").agg(F.countDistinct("commit_pos").alias("commits"))
    bulk = files.groupBy("repo", "commit_pos").agg(F.count("*").alias("n")).where(F.col("n") > BULK).groupBy("repo").agg(F.count("*").alias("bulk"))
    return total.join(bulk, "repo", "left").select("repo", "commits", F.coalesce("bulk", F.lit(0)).alias("bulk"), (F.col("commits") >= LEAST_COMMITS).alias("usable"))


def _fields(raw: Column) -> Column:
    return F.filter(F.split(raw, "\x00"), lambda x: x != "")


def read_status(statuses: DataFrame) -> DataFrame:
    """(repo, code, file, old) of ``git status --porcelain -z`` (repo, raw). A renamed or copied file has its earlier
    path in the field after it."""
    fields = statuses.select("repo", F.posexplode(_fields(F.col("raw"))).alias("i", "x"), _fields(F.col("raw")).alias("all"))
    # a field is an earlier path if the one before it is a rename that isn't itself an earlier path
    moved = lambda x: x.rlike(r"^(?:[RC].|.[RC]) ")
    state = F.aggregate(F.slice("all", 1, F.col("i")), F.lit(False), lambda s, x: F.when(s, False).otherwise(moved(x)))
    marked = fields.withColumn("is_old", state)
    following = F.try_element_at("all", F.col("i") + 2)
    return marked.where("not is_old").select("repo", F.substring("x", 1, 2).alias("code"), F.expr("substring(x, 4)").alias("file"), F.when(moved(F.col("x")), following).alias("old"))


def read_diff(diffs: DataFrame) -> DataFrame:
    """(repo, kind, old, file) of ``git diff --name-status -M -z`` (repo, raw): added, removed, renamed or modified."""
    status = r"^[A-Z]\d*$"
    fields = diffs.select("repo", _fields(F.col("raw")).alias("all"))
    # statuses are the fields at the places that the ones before leave: one path follows, or two after R and C
    step = lambda s, x: F.when(s["skip"] > 0, F.struct((s["skip"] - 1).alias("skip"), (s["i"] + 1).alias("i"), s["at"].alias("at"))).otherwise(F.struct(F.when(x.rlike("^[RC]"), 2).otherwise(1).alias("skip"), (s["i"] + 1).alias("i"), F.concat(s["at"], F.array(s["i"])).alias("at")))
    start = F.struct(F.lit(0).alias("skip"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("at"))
    at = fields.select("repo", "all", F.explode(F.aggregate("all", start, step, lambda s: s["at"])).alias("i"))
    field = lambda k: F.try_element_at("all", F.col("i") + k)
    rows = at.select("repo", field(1).alias("code"), field(2).alias("old"), field(3).alias("third")).where(F.col("code").rlike(status))
    moved = F.col("code").rlike("^[RC]")
    kind = F.when(F.col("code") == "A", "added").when(F.col("code") == "D", "removed").when(moved, "renamed").otherwise("modified")
    return rows.select("repo", kind.alias("kind"), "old", F.when(moved, F.col("third")).otherwise(F.col("old")).alias("file"))


def shape_of(file: str, text: str | None) -> str | None:
    """What a source says apart from comments and layout: Python's parse tree, else the words and marks that are left
    without comments. Null where it can't be told."""
    import hashlib

    if text is None:
        return None
    if file.lower().endswith((".py", ".pyi")):
        try:
            return hashlib.sha1(ast.dump(ast.parse(text)).encode()).hexdigest()
        except (SyntaxError, ValueError, RecursionError):
            return None
    g = grammar.GRAMMARS.get(grammar.language_of(file))
    if g is None:
        return None
    tokens = re.findall(rf"{g.strings}|[\w$]+|[^\w\s]", grammar.blanked(text, g, strings=False), re.S)
    return hashlib.sha1("\x00".join(tokens).encode()).hexdigest()


def shapes(files: DataFrame) -> DataFrame:
    """(file, shape) of files (file, text): equal for texts that differ in comments, blank space and layout only."""

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shape_of(f or "", t) for f, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.string())], names=["file", "shape"])

    return files.select("file", "text").mapInArrow(of, "file string, shape string")


def structural_diff(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, old, file, structural) of changes (kind, old, file) between two versions of the files (file, text): what
    is added or removed is structural, what is renamed or modified if its shape differs or can't be told."""
    a, b = shapes(before).select(F.col("file").alias("old"), F.col("shape").alias("was")), shapes(after).select("file", F.col("shape").alias("is"))
    met = changes.join(a, "old", "left").join(b, "file", "left")
    same = F.coalesce(F.col("was") == F.col("is"), F.lit(False))
    return met.select("kind", "old", "file", (F.col("kind").isin("added", "removed") | ~same).alias("structural"))


#: A graph is built anew rather than updated beyond so many changed files; only so many are compared for their shape.
MANY = 25


def freshness(nodes: DataFrame, changed: DataFrame, before: DataFrame, after: DataFrame, behind: bool = False, reachable: bool = True) -> DataFrame:
    """One row (action, stale, structural, cosmetic, phantom, ignored) for a graph (nodes: file) and pending changes
    (file, removed) against the build's texts ``before`` and the ones of now ``after`` (file, text).

    Files that the graph can't hold are ignored; edits of comments and layout don't count; a removed file that still
    has nodes, an unreachable build or very many changes ask for a rebuild, anything else that counts for an update.
    """
    held = nodes.where("file <> ''").select("file").distinct().withColumn("held", F.lit(True))
    known = F.regexp_extract(F.lower("file"), r"\.([^./]+)$", 1).isin(*grammar.LANGUAGE)
    met = changed.select("file", F.coalesce("removed", F.lit(False)).alias("removed")).join(held, "file", "left").withColumn("relevant", F.coalesce("held", F.lit(False)) | known)
    own = met.join(shapes(before).withColumnRenamed("shape", "was"), "file", "left").join(shapes(after).withColumnRenamed("shape", "is"), "file", "left")
    edited = ~F.col("removed") & F.col("relevant")
    same = F.coalesce(F.col("was") == F.col("is"), F.lit(False))
    n = own.agg(F.count_if(edited).alias("edited"), F.count_if(edited & same).alias("alike"), F.count_if(F.col("removed") & F.coalesce("held", F.lit(False))).alias("phantom"), F.count_if(~F.col("removed") & ~F.col("relevant")).alias("ignored"))
    cosmetic = F.when(F.col("edited") <= MANY, F.col("alike")).otherwise(0)
    counted = n.select("phantom", "ignored", cosmetic.alias("cosmetic"), (F.col("edited") - cosmetic).alias("structural"))
    stale = F.lit(behind) | F.lit(not reachable) | (F.col("structural") > 0) | (F.col("phantom") > 0)
    action = F.when(~stale, "fresh").when(F.lit(not reachable) | (F.col("phantom") > 0) | (F.col("structural") > MANY), "rebuild").otherwise("update")
    return counted.select(action.alias("action"), stale.alias("stale"), "structural", "cosmetic", "phantom", "ignored")


def build_drift(answer: DataFrame, changed: DataFrame) -> DataFrame:
    """(file) of an answer's files (file) that have changed since the graph was built (changed: file)."""
    return answer.select("file").where("file <> ''").distinct().join(changed.select("file").distinct(), "file", "left_semi")
