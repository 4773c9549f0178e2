"""From the facts of source files to a graph: ids, nodes, containment, imports, names resolved to definitions.

Every step is a join of fact tables on names or paths. A name is looked up in tiers, nearest first: its class and the
definitions around it, its file, the file's import bindings (followed through up to three re-exports). What a tier
finds is read; a name that only one definition of the whole project has is a guess (INFERRED); any other gets no edge
and a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import basename, dirname, family
from ..plans.snapshot import cut
from .resolve import first_by

#: Re-exports that a name is followed through; the shortest method name that is guessed by itself.
REEXPORTS, LEAST_NAME = 3, 4
#: Method names that too many types have to guess by.
COMMON = ("append", "close", "copy", "count", "find", "format", "index", "items", "join", "keys", "open", "read", "replace", "split", "start", "stop", "strip", "update", "values", "write")
CLASSES = ("class", "struct", "interface", "enum", "type_alias", "extension")
CALLABLES = ("function", "method", "constructor")
STATES = ("variable", "constant", "property")


def slug(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), F.lit("_"))


def stem(path: Column) -> Column:
    """A path without its extension."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def allocate_ids(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """``rows`` with ``id``: the key itself for the first of equal keys, then ``_2``, ``_3`` in order; a number that
    another key already spells is passed over by one more underscore."""
    keyed = rows.withColumn("key", key)
    numbered = keyed.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    made = numbered.withColumn("id", F.when(F.col("k") == 1, F.col("key")).otherwise(F.concat_ws("_", "key", F.col("k").cast("string"))))
    taken = made.where("k = 1").select(F.col("id").alias("id"), F.lit(True).alias("spelled"))
    met = made.join(taken, "id", "left")
    clash = F.col("spelled").isNotNull() & (F.col("k") > 1)
    return met.withColumn("id", F.when(clash, F.concat_ws("__", "key", F.col("k").cast("string"))).otherwise(F.col("id"))).drop("key", "k", "spelled")


def assemble(facts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, type, kind, file, line, end_line, region_start, qualname, language, least_args, most_args) and
    containment edges (src, dst, relation): a node for each file (file), definition and heading; a file holds its
    outermost definitions, a class its methods, an enum its cases.

    Files whose paths differ in the extension only keep it in their ids. A definition given twice at one line counts
    once. Labels are ``f()``, ``.m()`` or the bare name.
    """
    named = files.select("file").distinct()
    stems = named.groupBy(slug(stem(F.col("file"))).alias("s")).agg(F.count("*").alias("n"))
    base = named.withColumn("s", slug(stem(F.col("file")))).join(stems, "s").select("file", F.when(F.col("n") > 1, slug(F.col("file"))).otherwise(F.col("s")).alias("base"))
    hubs = base.select("file", "base", F.lit("").alias("qualname"), F.lit("file").alias("kind"), F.lit(1).alias("line"), F.lit(None).cast("int").alias("end_line"), F.lit(1).alias("region_start"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("int").alias("least_args"), F.lit(None).cast("int").alias("most_args"))
    own = facts.where("fact in ('def', 'heading')").dropDuplicates(["file", "name", "line", "kind"]).join(base, "file").select("file", "base", F.col("name").alias("qualname"), "kind", "line", "end_line", "region_start", "language", "least_args", "most_args")
    key = F.concat_ws("_", "base", F.nullif(slug(F.col("qualname")), F.lit("")))
    made = cut(allocate_ids(hubs.unionByName(own), key, F.col("file"), F.col("line"), F.col("qualname")), "nodes")
    bare = F.when(F.col("kind") == "heading", F.col("qualname")).otherwise(F.element_at(F.split("qualname", r"\."), -1))
    label = F.when(F.col("kind") == "file", basename(F.col("file"))).when(F.col("kind") == "function", F.concat(bare, F.lit("()"))).when(F.col("kind").isin("method", "constructor"), F.concat(F.lit("."), bare, F.lit("()"))).otherwise(bare)
    kind = F.when(F.col("kind") == "file", "file").when(F.col("kind") == "heading", "document").when(F.col("kind").isin(*STATES), "state").otherwise("code")
    nodes = made.select("id", label.alias("label"), kind.alias("type"), "kind", "file", "line", "end_line", "region_start", "qualname", "language", "least_args", "most_args")
    outer = nodes.select("file", F.col("qualname").alias("outer"), F.col("id").alias("src"), F.col("kind").alias("outer_kind"), F.col("line").alias("outer_line"))
    inner = nodes.where("kind <> 'file'").withColumn("outer", F.when(F.col("kind") == "heading", "").when(F.contains("qualname", F.lit(".")), F.regexp_replace("qualname", r"\.[^.]*$", "")).otherwise(""))
    met = inner.join(outer, ["file", "outer"], "left").join(outer.where("outer = ''").select("file", F.col("src").alias("hub")), "file")
    met = first_by(met.select("id", "kind", "src", "hub", "outer_kind", "outer_line"), ["id"], F.col("outer_line").desc_nulls_last(), F.col("src"))
    relation = F.when(F.col("kind").isin("method", "constructor") & F.col("outer_kind").isin(*CLASSES), "method").when(F.col("kind") == "enum_member", "case_of").when(F.col("kind").isin(*STATES), "defines").otherwise("contains")
    return nodes, met.select(F.coalesce("src", "hub").alias("src"), F.col("id").alias("dst"), relation.alias("relation"))


def module_path(file: Column) -> Column:
    """A Python file's dotted path; a package's own file is the package."""
    return F.regexp_replace(F.regexp_replace(stem(file), "/", "."), r"(?:^|\.)__init__$", "")


def import_targets(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(file, name, runs, line, target_file, symbol, kind): the file of the project that each import of Python, JS or
    TypeScript means, and which of its names is bound (null: the module itself).

    A dotted path means the one file whose path ends in it; two or more candidates mean none of them, unless one is
    the whole path. ``from a import b`` means the module ``a.b`` if there is one, else the name in ``a``. A relative
    specifier is joined to the importing file's directory and tried with the language's extensions and index files.
    """
    named = cut(files.select("file").distinct(), "files")
    python = facts.where("fact = 'import' and language = 'python'").select("file", "name", "runs", "line", "kind", "level", F.split("target", ":").alias("t"))
    package = F.when(F.col("level") > 0, F.regexp_replace(F.regexp_replace(dirname(F.col("file")), "/", "."), "^$", ""))
    ups = F.slice(F.split(package, r"\."), 1, F.greatest(F.size(F.split(package, r"\.")) - F.col("level") + 1, F.lit(0)))
    root = F.when(F.col("level") > 0, F.concat_ws(".", F.array_join(F.filter(ups, lambda x: x != ""), "."), F.nullif(F.col("t")[0], F.lit("")))).otherwise(F.col("t")[0])
    asked = python.select("file", "name", "runs", "line", "kind", "level", root.alias("module"), F.when(F.size("t") > 1, F.col("t")[1]).alias("symbol"))
    # a name may be a module of its own: both are asked for, the module goes first
    both = asked.select("*", F.explode(F.array(F.struct(F.concat_ws(".", F.nullif(F.col("module"), F.lit("")), "symbol").alias("path"), F.lit(None).cast("string").alias("bound"), F.lit(0).alias("prio")), F.struct(F.col("module").alias("path"), F.col("symbol").alias("bound"), F.lit(1).alias("prio")))).alias("x"))
    both = both.where("symbol is not null or x.prio = 1").where("x.path <> ''").select("file", "name", "runs", "line", "kind", "level", "x.*")
    modules = named.where(F.col("file").rlike(r"\.pyi?$")).select(F.col("file").alias("target_file"), module_path(F.col("file")).alias("dotted")).where("dotted <> ''")
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    met = both.withColumn("last", last("path")).join(modules.withColumn("last", last("dotted")), "last")
    met = met.where((F.col("dotted") == F.col("path")) | ((F.col("level") == 0) & F.endswith("dotted", F.concat(F.lit("."), F.col("path")))))
    whole = F.col("dotted") == F.col("path")
    each = met.groupBy("file", "name", "runs", "line", "kind", "prio", "bound").agg(F.count_if(whole).alias("exact"), F.countDistinct("target_file").alias("n"), F.max(F.when(whole, F.col("target_file"))).alias("own"), F.min("target_file").alias("only"))
    sure = each.select("file", "name", "runs", "line", "kind", "prio", F.when(F.col("exact") == 1, F.col("own")).when(F.col("n") == 1, F.col("only")).alias("target_file"), F.col("bound").alias("symbol")).where("target_file is not null and target_file <> file")
    found = first_by(sure, ["file", "name", "line"], F.col("prio")).drop("prio")
    script = facts.where("fact = 'import' and language in ('js', 'ts') and target like '.%'").select("file", "name", "runs", "line", "target")
    names = F.filter(F.transform(F.split(F.regexp_replace("name", r"[{}]", ","), ","), lambda x: F.trim(x)), lambda x: x != "")
    bound = script.select("file", "runs", "line", "target", F.explode_outer(names).alias("x"))
    alias = F.regexp_extract("x", r"^(?:type\s+)?([\w$*]+)(?:\s+as\s+([\w$]+))?$", 1), F.regexp_extract("x", r"\bas\s+([\w$]+)$", 1)
    bound = bound.select("file", "runs", "line", "target", F.when(F.contains("x", F.lit("*")), F.lit(None)).otherwise(F.nullif(alias[0], F.lit(""))).alias("symbol"), F.coalesce(F.nullif(alias[1], F.lit("")), F.nullif(alias[0], F.lit("")), F.lit("")).alias("name"))
    steps = F.split(F.concat_ws("/", F.nullif(dirname(F.col("file")), F.lit("")), "target"), "/")
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda done, x: F.when(x.isin("", "."), done).when((x == "..") & (F.size(done) > 0), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(x))))
    scripts = named.where(F.col("file").rlike(r"\.[cm]?[jt]sx?$")).select(F.col("file").alias("target_file"), F.explode(F.array(F.col("file"), stem(F.col("file")), F.regexp_replace(stem(F.col("file")), "/index$", ""))).alias("path")).distinct()
    js = bound.withColumn("path", F.array_join(walked, "/")).join(scripts, "path").where("target_file <> file")
    js = first_by(js.select("file", "name", "runs", "line", F.lit("name").alias("kind"), "target_file", "symbol", F.length("target_file").alias("n")), ["file", "name", "line"], F.col("n"), F.col("target_file")).drop("n")
    return found.select("file", "name", "runs", "line", "target_file", "symbol", "kind").unionByName(js.select("file", "name", "runs", "line", "target_file", "symbol", "kind"))


def bindings(targets: DataFrame, nodes: DataFrame, depth: int = REEXPORTS) -> DataFrame:
    """(file, name, target_file, symbol): what each imported name stands for, followed through files that only pass it
    on, at most ``depth`` of them."""
    defined = cut(nodes.where("kind <> 'file'").select(F.col("file").alias("target_file"), F.col("qualname").alias("symbol")).distinct(), "defined")
    passed = cut(targets.select(F.col("file").alias("target_file"), F.col("name").alias("symbol"), F.col("target_file").alias("to_file"), F.col("symbol").alias("to_symbol")).dropDuplicates(["target_file", "symbol"]), "passed")
    now = targets.select("file", "name", "target_file", "symbol").dropDuplicates(["file", "name"])
    for _ in range(depth):
        known = defined.withColumn("known", F.lit(True))
        met = now.join(known, ["target_file", "symbol"], "left").join(passed, ["target_file", "symbol"], "left")
        on = F.col("known").isNull() & F.col("to_file").isNotNull()
        now = met.select("file", "name", F.when(on, F.col("to_file")).otherwise(F.col("target_file")).alias("target_file"), F.when(on, F.col("to_symbol")).otherwise(F.col("symbol")).alias("symbol"))
    return now


def import_edges(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, relation, runs): a file to each file that it imports, at its earliest."""
    hub = nodes.where("kind = 'file'").select("file", "id")
    rank = F.when(F.col("runs") == "module-level", 0).when(F.col("runs") == "deferred", 1).otherwise(2)
    one = targets.groupBy("file", "target_file").agg(F.min_by("runs", rank).alias("runs"))
    met = one.join(hub.withColumnRenamed("id", "src"), "file").join(hub.select(F.col("file").alias("target_file"), F.col("id").alias("dst")), "target_file")
    return met.select("src", "dst", F.lit("imports_from").alias("relation"), "runs")


def resolve_names(facts: DataFrame, nodes: DataFrame, bound: DataFrame) -> DataFrame:
    """(file, owner, fact, kind, target, line, id, how, confidence): the definition that each call, base, decorator,
    read and write names, by tiers; how says which one (member, scope, file, import, unique), null if none fits.

    Of several definitions that a tier offers a call, those that its number of arguments fits go first; if more than
    one is left, each is a guess.
    """
    uses = facts.where("fact in ('call', 'base', 'read', 'write')").select("file", "owner", "fact", "kind", "target", "line", F.col("least_args").alias("given"), F.col("most_args").alias("closed"))
    uses = cut(uses.withColumn("use", F.monotonically_increasing_id()), "uses")
    defs = nodes.where("kind not in ('file', 'heading')").select(F.col("file").alias("def_file"), F.col("qualname").alias("q"), F.col("id"), F.col("kind").alias("def_kind"), "least_args", "most_args")
    parts = F.split("target", r"\.")
    head, rest = parts[0], F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), ".")
    split = uses.select("*", head.alias("head"), rest.alias("rest"))
    # the scopes around a use, innermost first: a.b.c, a.b, a, and the file itself
    chain = F.split("owner", r"\.")
    around = F.transform(F.sequence(F.lit(0), F.when(F.col("owner") == "", 0).otherwise(F.size(chain))), lambda i: F.array_join(F.slice(chain, 1, F.when(F.col("owner") == "", 0).otherwise(F.size(chain)) - i), "."))
    at = lambda prefix, name: F.concat_ws(".", F.nullif(prefix, F.lit("")), name)
    own = split.where(F.col("head").isin("self", "cls", "this", "super") & (F.col("rest") != ""))
    member = own.select("*", F.posexplode(around).alias("i", "scope")).select("use", at(F.col("scope"), F.col("rest")).alias("q"), F.col("file").alias("def_file"), F.lit(0).alias("tier"), F.col("i").alias("near"))
    plain = split.where(~F.col("head").isin("self", "cls", "this", "super"))
    scoped = plain.select("*", F.posexplode(around).alias("i", "scope")).select("use", at(F.col("scope"), F.col("target")).alias("q"), F.col("file").alias("def_file"), F.lit(1).alias("tier"), F.col("i").alias("near"))
    via = plain.join(bound.select("file", F.col("name").alias("head"), "target_file", "symbol"), ["file", "head"]).select("use", at(F.coalesce("symbol", F.lit("")), F.nullif(F.col("rest"), F.lit(""))).alias("q"), F.col("target_file").alias("def_file"), F.lit(2).alias("tier"), F.lit(0).alias("near"))
    asked = member.unionByName(scoped).unionByName(via).where("q <> ''")
    offered = asked.join(defs, ["def_file", "q"]).select("use", "id", "def_kind", "least_args", "most_args", "tier", "near")
    # members of a base's class, one step up
    heirs = facts.where("fact = 'base'").select("file", F.col("owner").alias("heir"), "target")
    up = own.select("use", "file", "rest", F.explode(around).alias("heir")).join(heirs, ["file", "heir"])
    local = up.select("use", at(F.col("target"), F.col("rest")).alias("q"), F.col("file").alias("def_file"))
    far = up.join(bound.select("file", F.col("name").alias("target"), "target_file", "symbol"), ["file", "target"]).select("use", at(F.coalesce("symbol", F.lit("")), F.col("rest")).alias("q"), F.col("target_file").alias("def_file"))
    inherited = local.unionByName(far).join(defs, ["def_file", "q"]).select("use", "id", "def_kind", "least_args", "most_args", F.lit(0).alias("tier"), F.lit(99).alias("near"))
    sure = offered.unionByName(inherited)
    best = sure.groupBy("use").agg(F.min(F.struct("tier", "near")).alias("best"))
    sure = sure.join(best, "use").where((F.col("tier") == F.col("best.tier")) & (F.col("near") == F.col("best.near"))).drop("best")
    # one definition of that name in the whole project, of the same language family
    last = F.element_at(parts, -1)
    left = split.where("fact in ('call', 'base')").join(sure.select("use").distinct(), "use", "left_anti").select("use", last.alias("bare"), family(F.col("file")).alias("fam"), (F.size(parts) > 1).alias("dotted"))
    names = defs.select(F.element_at(F.split("q", r"\."), -1).alias("bare"), family(F.col("def_file")).alias("fam"), "id", "def_kind", "least_args", "most_args")
    alone = names.where(~F.col("def_kind").isin(*STATES)).groupBy("bare", "fam").agg(F.countDistinct("id").alias("n"), *(F.min(c).alias(c) for c in ("id", "def_kind", "least_args", "most_args"))).where("n = 1")
    fair = ~F.col("dotted") | ((F.length("bare") >= LEAST_NAME) & ~F.col("bare").isin(*COMMON))
    guessed = left.where(fair).join(alone, ["bare", "fam"]).select("use", "id", "def_kind", "least_args", "most_args", F.lit(3).alias("tier"), F.lit(0).alias("near"))
    found = sure.unionByName(guessed).join(uses.select("use", "given", "closed"), "use")
    fits = F.coalesce(F.col("closed").isNull() | ((F.col("given") >= F.coalesce("least_args", F.lit(0))) & (F.col("most_args").isNull() | (F.col("given") <= F.col("most_args")))), F.lit(True))
    fitted = found.withColumn("fits", fits)
    some = fitted.groupBy("use").agg(F.max("fits").alias("any"))
    fitted = fitted.join(some, "use").where("fits or not any").select("use", "id", "def_kind", "tier").distinct()
    alike = fitted.groupBy("use").agg(F.count("*").alias("alike"))
    how = F.element_at(F.array(*(F.lit(x) for x in ("member", "scope", "import", "unique"))), F.col("tier") + 1)
    met = uses.join(fitted, "use", "left").join(alike, "use", "left")
    return met.select("file", "owner", "fact", "kind", "target", "line", "id", "def_kind", F.when(F.col("id").isNotNull(), how).alias("how"), F.when(F.col("id").isNotNull(), F.when((F.col("tier") == 3) | (F.col("alike") > 1), "INFERRED").otherwise("EXTRACTED")).alias("confidence"))


def relation_of() -> Column:
    """What a resolved use makes of its target; null: no edge."""
    d = F.col("def_kind")
    called = F.when(d.isin(*CALLABLES) | d.isin(*CLASSES), "calls").when(d.isin(*STATES), "reads")
    based = F.when(d == "interface", "implements").when(F.col("kind").isin("implements", "mixes_in"), F.col("kind")).when(d.isin(*CLASSES), "inherits")
    state = F.when(d.isin(*STATES), F.when(F.col("fact") == "read", "reads").otherwise("writes"))
    return F.when(F.col("fact") == "call", called).when(F.col("fact") == "base", based).otherwise(state)


def edges_of(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, relation, confidence, line) of resolved uses: one for each (src, dst, relation), at its first line
    and its surest; an edge to itself stays for calls only. A call of a class also calls its only constructor."""
    owner = nodes.select("file", F.col("qualname").alias("owner"), F.col("id").alias("src")).dropDuplicates(["file", "owner"])
    met = resolved.where("id is not null").withColumn("relation", relation_of()).where("relation is not null").join(owner, ["file", "owner"])
    made = met.select("src", F.col("id").alias("dst"), "relation", "confidence", "line", "kind")
    made = made.withColumn("confidence", F.when((F.col("relation") == "writes") & (F.col("kind") == "mutated"), "INFERRED").otherwise(F.col("confidence")))
    inits = nodes.where((F.col("kind") == "constructor") | F.endswith("qualname", F.lit(".__init__"))).select("file", F.regexp_replace("qualname", r"\.[^.]*$", "").alias("qualname"), F.col("id").alias("init"))
    only = nodes.where(F.col("kind").isin("class", "struct")).join(inits, ["file", "qualname"]).groupBy("id").agg(F.min("init").alias("init"), F.count("*").alias("n")).where("n = 1")
    built = made.where("relation = 'calls'").join(only.select(F.col("id").alias("dst"), "init"), "dst").select("src", F.col("init").alias("dst"), "relation", "confidence", "line", "kind")
    every = made.unionByName(built).where("src <> dst or relation = 'calls'")
    sure = F.when(F.col("confidence") == "EXTRACTED", 0).otherwise(1)
    return every.groupBy("src", "dst", "relation").agg(F.min_by("confidence", sure).alias("confidence"), F.min("line").alias("line"))


def unresolved(resolved: DataFrame, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, line, target, reason) of calls without an edge: a name that is imported from outside the project, one
    that several definitions have, one that none has, or a value of unknown type."""
    calls = resolved.where("fact = 'call' and id is null").select("file", "line", "target")
    parts = F.split("target", r"\.")
    bare = nodes.where("kind not in ('file', 'heading')").groupBy(F.element_at(F.split("qualname", r"\."), -1).alias("bare")).agg(F.count("*").alias("n"))
    imported = facts.where("fact = 'import'").select("file", F.col("name").alias("head"), F.lit(True).alias("outside")).distinct()
    met = calls.withColumn("head", parts[0]).withColumn("bare", F.element_at(parts, -1)).join(imported, ["file", "head"], "left").join(bare, "bare", "left")
    reason = F.when(F.col("outside"), "external").when(F.coalesce("n", F.lit(0)) > 1, "ambiguous").when(F.col("n").isNull(), "no definition").otherwise("unknown receiver")
    return met.select("file", "line", "target", reason.alias("reason"))


def resource_edges(facts: DataFrame, nodes: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of resources that at least ``least`` definitions use: env variables, files, tables; an event
    needs a sender and a receiver."""
    owner = nodes.select("file", F.col("qualname").alias("owner"), F.col("id").alias("src")).dropDuplicates(["file", "owner"])
    used = facts.where("fact = 'resource'").join(owner, ["file", "owner"]).select("src", F.concat_ws(":", "kind", "target").alias("dst"), F.col("name").alias("relation"), "kind", "target").distinct()
    counts = used.groupBy("dst").agg(F.countDistinct("src").alias("n"), F.countDistinct("relation").alias("sides"), F.first("kind").alias("kind"), F.first("target").alias("label"))
    kept = counts.where((F.col("n") >= least) & ((F.col("kind") != "event") | (F.col("sides") == 2)))
    return kept.select(F.col("dst").alias("id"), "label", F.lit("resource").alias("type"), "kind"), used.join(kept.select("dst"), "dst", "left_semi").select("src", "dst", "relation")


def route_edges(facts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of routes: a node for each method and pattern of a file; ``handles`` to the definition that
    serves it, ``http_calls`` from those whose requests it answers."""
    from .spans import link_calls, normalize_pattern, request_path

    served = facts.where("fact = 'route'").select("file", "line", F.col("name").alias("verb"), normalize_pattern(F.col("target")).alias("pattern"), F.col("kind").alias("framework"), F.element_at(F.split("owner", r"[.#:]+"), -1).alias("handler"))
    served = served.withColumn("id", F.concat_ws(" ", "verb", "pattern")).distinct()
    made = served.groupBy("id").agg(F.min("pattern").alias("label"), F.min("framework").alias("framework")).select("id", "label", F.lit("route").alias("type"), F.col("framework").alias("kind"))
    bare = F.element_at(F.split("qualname", r"\."), -1)
    by_name = nodes.where(F.col("kind").isin(*CALLABLES)).select("file", bare.alias("handler"), F.col("id").alias("dst"), "line")
    near = served.join(by_name.withColumnRenamed("line", "at"), ["file", "handler"])
    handled = first_by(near, ["id", "file", "line"], F.abs(F.col("at") - F.col("line")), F.col("dst")).select(F.col("id").alias("src"), "dst", F.lit("handles").alias("relation"), F.lit("EXTRACTED").alias("confidence"))
    asked = facts.where("fact = 'request'").select("file", "owner", F.col("name").alias("method"), request_path(F.col("target")).alias("r")).where("r.kind = 'path'")
    owner = nodes.select("file", F.col("qualname").alias("owner"), F.col("id").alias("src")).dropDuplicates(["file", "owner"])
    calls = asked.join(owner, ["file", "owner"]).select(F.concat_ws("|", "src", "method", "r.path").alias("call"), "src", "method", F.col("r.path").alias("path"), "file").dropDuplicates(["call"])
    linked = link_calls(calls.select("call", "method", "path", "file"), served.select(F.col("id").alias("route"), "verb", "pattern", F.col("file").alias("route_file")))
    called = linked.join(calls.select("call", "src"), "call").select("src", F.col("route").alias("dst"), F.lit("http_calls").alias("relation"), "confidence")
    return made, handled.unionByName(called).distinct()


def package_uses(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(package, symbol, files, uses): the names that files use of packages from outside the project, most used first.

    A package is the first part of an import that means no file of the project; a symbol is what is imported from it or
    called through it.
    """
    root = F.when(F.col("language").isin("go"), F.col("target")).when(F.col("language").isin("js", "ts"), F.regexp_extract("target", r"^(@[^/]+/[^/]+|[^/]+)", 1)).when(F.col("language") == "python", F.element_at(F.split("target", "[.:]"), 1)).when(F.col("language") == "rust", F.element_at(F.split("target", "::"), 1)).when(F.col("language") == "php", F.element_at(F.split("target", r"\\"), 1)).when(F.col("language").isin("java", "kotlin", "scala", "csharp"), F.regexp_replace("target", r"\.(?:\*|_|[A-Z].*)$", "")).otherwise(F.col("target"))
    own = files.select(F.explode(F.array(F.element_at(F.split("file", "/"), 1), F.regexp_replace(basename(F.col("file")), r"\.[^.]*$", ""), F.element_at(F.split("file", "/"), -2))).alias("package")).where("package is not null").distinct() if files is not None else None
    imports = facts.where("fact = 'import' and coalesce(level, 0) = 0 and target not like '.%'").select("file", "language", root.alias("package"), "name", F.when(F.col("kind") == "name", F.element_at(F.split("target", ":"), -1)).alias("symbol"))
    imports = imports.join(own, "package", "left_anti") if own is not None else imports
    direct = imports.where("symbol is not null").select("package", "symbol", "file")
    calls = facts.where("fact = 'call' and target like '%.%'").select("file", F.element_at(F.split("target", r"\."), 1).alias("name"), F.regexp_replace("target", r"^[^.]*\.", "").alias("symbol"))
    through = imports.where("symbol is null").select("file", "package", F.element_at(F.split(F.regexp_replace("name", r"^.*\bas\s+", ""), "[^A-Za-z0-9_$]+"), -1).alias("name")).join(calls, ["file", "name"]).select("package", "symbol", "file")
    return direct.unionByName(through).groupBy("package", "symbol").agg(F.countDistinct("file").alias("files"), F.count("*").alias("uses"))


def build(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, type, kind, file, line) and edges (src, dst, relation, confidence) of source files (file, text):
    everything above in order. The facts and the nodes are written; each later step joins them."""
    from ..sources.code import code_facts

    facts = cut(code_facts(files), "facts")
    nodes, contained = assemble(facts, files)
    nodes = cut(nodes, "nodes")
    targets = cut(import_targets(facts, files), "imports")
    resolved = resolve_names(facts, nodes, bindings(targets, nodes))
    sure = F.lit("EXTRACTED").alias("confidence")
    res_nodes, res_edges = resource_edges(facts, nodes)
    route_nodes, routed = route_edges(facts, nodes)
    columns = ["src", "dst", "relation", "confidence"]
    edges = contained.select("src", "dst", "relation", sure).unionByName(import_edges(targets, nodes).select("src", "dst", "relation", sure)).unionByName(edges_of(resolved, nodes).select(*columns)).unionByName(res_edges.select("src", "dst", "relation", sure)).unionByName(routed.select(*columns))
    extra = lambda df: df.select("id", "label", "type", "kind", F.lit("").alias("file"), F.lit(None).cast("int").alias("line"))
    every = nodes.select("id", "label", "type", "kind", "file", "line").unionByName(extra(res_nodes)).unionByName(extra(route_nodes))
    return every, edges


def structural_receivers(resolved: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """(src, dst, relation, confidence) of calls on values of unknown type: where a definition calls at least ``least``
    different names on one value, and one class alone of the same language family has methods of all those names, the
    calls are guessed to be its methods. Calls that are resolved, or on imported names, take no part."""
    calls = resolved.where("fact = 'call' and id is null").select("file", "owner", F.split("target", r"\.").alias("t")).where("size(t) = 2")
    used = calls.select("file", "owner", F.col("t")[0].alias("value"), F.col("t")[1].alias("name")).where("value not in ('self', 'cls', 'this', 'super')").distinct()
    sizes = used.groupBy("file", "owner", "value").agg(F.count("*").alias("wanted")).where(F.col("wanted") >= least)
    methods = nodes.where(F.col("kind").isin("method", "constructor")).select(F.col("id").alias("dst"), family(F.col("file")).alias("fam"), F.col("file").alias("class_file"), F.regexp_replace("qualname", r"\.[^.]*$", "").alias("class"), F.element_at(F.split("qualname", r"\."), -1).alias("name"))
    met = used.join(sizes, ["file", "owner", "value"]).withColumn("fam", family(F.col("file"))).join(methods, ["fam", "name"])
    whole = met.groupBy("file", "owner", "value", "class_file", "class").agg(F.countDistinct("name").alias("has"), F.first("wanted").alias("wanted")).where("has = wanted")
    only = whole.groupBy("file", "owner", "value").agg(F.count("*").alias("n"), F.min(F.struct("class_file", "class")).alias("c")).where("n = 1").select("file", "owner", "value", "c.class_file", "c.class")
    owner = nodes.select("file", F.col("qualname").alias("owner"), F.col("id").alias("src")).dropDuplicates(["file", "owner"])
    found = met.join(only, ["file", "owner", "value", "class_file", "class"]).join(owner, ["file", "owner"])
    return found.select("src", "dst", F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence")).distinct()
