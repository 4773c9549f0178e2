"""Column expressions over names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories of tests and of vendored code, and extensions by language family.
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs", "testing", "e2e")
VENDORED_DIRS = ("vendor", "vendors", "vendored", "_vendor", "node_modules", "bower_components", "third_party", "third-party", "thirdparty", "site-packages")
FAMILIES = {
    "py": "python", "pyi": "python", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js", "go": "go", "java": "jvm", "kt": "jvm", "kts": "jvm", "scala": "jvm",
    "cs": "csharp", "rs": "rust", "swift": "swift", "c": "c", "h": "c", "cc": "c", "cpp": "c", "cxx": "c", "hpp": "c", "rb": "ruby", "php": "php",
}


def bare_name(label: Column) -> Column:
    """The last part of a dotted or ``::`` name, without ``()``, leading dots and type arguments."""
    plain = F.regexp_replace(F.regexp_replace(label, r"\(\)", ""), r"^\.+", "")
    return F.element_at(F.split(F.regexp_replace(F.substring_index(plain, "<", 1), "::", "."), r"\."), -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def family(path: Column) -> Column:
    pairs = [F.lit(x) for kv in FAMILIES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def top_dir(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("")


def common_dirs(a: Column, b: Column) -> Column:
    """How many leading directories two paths share."""
    x, y = F.split(dirname(a), "/"), F.split(dirname(b), "/")
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q) & (p != ""))
    return F.when((dirname(a) == "") | (dirname(b) == ""), 0).otherwise(F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, ok: F.struct(F.when(s["on"] & ok, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & ok).alias("on")), lambda s: s["n"]))


def dir_distance(a: Column, b: Column) -> Column:
    """Steps up from one path's directory and down to the other's."""
    depth = lambda p: F.when(dirname(p) == "", 0).otherwise(F.size(F.split(dirname(p), "/")))
    return depth(a) + depth(b) - 2 * common_dirs(a, b)


def diverging(a: Column, b: Column) -> Column:
    """The first directories below the common ones, as 'x/y'-like pair; null if one path is above the other."""
    x, y, n = F.split(dirname(a), "/"), F.split(dirname(b), "/"), common_dirs(a, b)
    p, q = F.slice(x, 1, n + 1), F.slice(y, 1, n + 1)
    return F.when((F.size(x) > n) & (F.size(y) > n), F.array(F.array_join(p, "/"), F.array_join(q, "/")))


def is_test_path(path: Column) -> Column:
    """A directory of tests, a test-like directory name, or a test-like file stem."""
    dirs = F.split(dirname(path), "/")
    stem = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    named = F.exists(dirs, lambda d: F.lower(d).isin(*TEST_DIRS) | d.rlike(r"[a-z0-9.](?:Tests?|TestCase)(?:$|\.)"))
    return F.coalesce(named | F.lower(stem).rlike(r"^test_|_tests?$|_spec$|\.test$|\.spec$|^conftest$") | stem.rlike(r"[a-z0-9.](?:Tests?|TestCase)(?:$|\.)"), F.lit(False))


def is_vendored(path: Column) -> Column:
    """A vendored directory, a minified or bundled file, or a stem that ends in a build's hash: eight characters or
    more with a digit that are hexadecimal or of both cases."""
    dirs = F.split(dirname(path), "/")
    token = F.regexp_extract(basename(path), r"[-.]([A-Za-z0-9_]{8,})\.(?:js|mjs|cjs|css)$", 1)
    hashed = token.rlike("[0-9]") & F.when(token.rlike("^[0-9a-f]*$"), token.rlike("[a-f]")).otherwise(token.rlike("[A-Z]") & token.rlike("[a-z]"))
    return F.coalesce(F.exists(dirs, lambda d: F.lower(d).isin(*VENDORED_DIRS)) | F.lower(basename(path)).rlike(r"\.min\.|\.bundle\.") | hashed, F.lit(False))


#: Of a script or style file, so many bytes are looked at; longer lines than this on average aren't hand-written.
SNIFFED, LONG_LINES = 65536, 150


def is_minified(path: Column, text: Column) -> Column:
    """Whether a script's or style's lines are too long to be hand-written."""
    head = F.substring(text, 1, SNIFFED)
    lines = F.regexp_count(head, F.lit("\n")) + 1
    return F.coalesce(extension(path).isin("js", "mjs", "cjs", "css") & (F.trim(head) != "") & (F.length(head) / lines > LONG_LINES), F.lit(False))


def is_file_hub(label: Column, file: Column) -> Column:
    return (label == file) | F.endswith(file, F.concat(F.lit("/"), label))


def line_of(location: Column) -> Column:
    """The first line number of a location such as ``L12-L30``; null if there is none."""
    return F.regexp_extract(location, r"^[Ll]*(\d+)", 1).try_cast("int")


def approx_tokens(n_chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n_chars / 3.5)).cast("long")
