"""Line grammars: what a source file defines, imports, serves and uses, for languages without a parser at hand.

A file is read as lines in which strings and comments are blanked where they would mislead. A definition is a line
that fits one of its language's patterns; it ends where its block closes, by braces, by an ``end`` of the same indent,
or by indent. These are facts of the text, not of a full parse: macros and generated code are read as they stand.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Fixed extensions of the languages.
EXTENSIONS = {
    "python": "py pyi", "js": "js jsx mjs cjs", "ts": "ts tsx mts cts", "go": "go", "java": "java", "kotlin": "kt kts", "scala": "scala sc", "csharp": "cs", "rust": "rs", "swift": "swift",
    "c": "c h", "cpp": "cc cpp cxx hpp hh hxx", "ruby": "rb rake", "php": "php", "markdown": "md markdown", "rst": "rst",
}
LANGUAGE = {e: name for name, own in EXTENSIONS.items() for e in own.split()}
#: Words that open blocks or calls but define nothing.
NOT_NAMES = frozenset("if for while switch catch return else do try function new await typeof case when match loop using lock synchronized sizeof defined foreach elseif unless until guard throw assert super this self init func fn fun def function".split())

_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|open|async|virtual|partial|readonly|extern|unsafe|inline|suspend|data|lateinit|implicit|lazy|case|export|default|declare|mutating|fileprivate|native|synchronized|transient|volatile|const|constexpr|explicit|friend|new)\s+)*"


@dataclass(frozen=True)
class Grammar:
    """Patterns of a language. ``definitions``: (kind, pattern with the name as group ``n``); kinds ``method?`` count
    only inside a type, ``function?`` only outside one."""

    definitions: tuple[tuple[str, str], ...]
    imports: tuple[str, ...] = ()
    bases: str = ""
    block: str = "{"
    comments: str = r"//[^\n]*|/\*.*?\*/"
    strings: str = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
    compiled: dict = field(default_factory=dict, compare=False, hash=False)

    def pattern(self, text: str) -> re.Pattern:
        if text not in self.compiled:
            self.compiled[text] = re.compile(text)
        return self.compiled[text]


_JS = (
    ("class", rf"^\s*{_MODS}class\s+(?P<n>[\w$]+)"),
    ("interface", rf"^\s*{_MODS}interface\s+(?P<n>[\w$]+)"),
    ("enum", rf"^\s*{_MODS}enum\s+(?P<n>[\w$]+)"),
    ("type_alias", rf"^\s*{_MODS}type\s+(?P<n>[\w$]+)[^=]*="),
    ("namespace", rf"^\s*{_MODS}(?:namespace|module)\s+(?P<n>[\w$.]+)\s*\{{"),
    ("function", rf"^\s*{_MODS}function\s*\*?\s*(?P<n>[\w$]+)\s*[(<]"),
    ("function", rf"^\s*{_MODS}(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>"),
    ("function", rf"^\s*{_MODS}(?:const|let|var)\s+(?P<n>[\w$]+)\s*=\s*(?:async\s+)?function"),
    ("method?", rf"^\s+(?:(?:get|set)\s+)?{_MODS}(?:\*\s*)?#?(?P<n>[\w$]+)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{{;]+)?\{{"),
)
_JS_IMPORTS = (r"^\s*import\s+(?:type\s+)?(?P<names>[^'\"]*?)\s*(?:from\s*)?['\"](?P<m>[^'\"]+)['\"]", r"^\s*export\s+(?P<names>[^'\"]*?)\s*from\s*['\"](?P<m>[^'\"]+)['\"]", r"(?:const|let|var)\s+(?P<names>[^=]+?)\s*=\s*require\(\s*['\"](?P<m>[^'\"]+)['\"]", r"\b(?:import|require)\(\s*['\"](?P<m>[^'\"]+)['\"]")
_JVM_TYPES = (("class", rf"^\s*(?:@\w+(?:\([^)]*\))?\s+)*{_MODS}(?:class|record|object)\s+(?P<n>\w+)"), ("interface", rf"^\s*{_MODS}(?:@?interface|trait)\s+(?P<n>\w+)"), ("enum", rf"^\s*{_MODS}enum\s+(?:class\s+)?(?P<n>\w+)"))
_TYPED = rf"^\s*(?:@\w+(?:\([^)]*\))?\s+)*{_MODS}(?:<[^>]+>\s*)?[\w.<>\[\],?*&:\s]+?[\s*&](?P<n>~?\w+)\s*\([^;{{]*\)\s*(?:const|noexcept|throws\s+[\w.,\s]+|where\s[^{{]+)?\s*(?:\{{|=>|$)"
GRAMMARS = {
    "js": Grammar(_JS, _JS_IMPORTS, r"\bextends\s+(?P<b>[\w$.]+)(?:.*?\bimplements\s+(?P<i>[\w$., ]+))?|\bimplements\s+(?P<i2>[\w$., ]+)", strings=r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"),
    "go": Grammar(
        (("method", r"^func\s+\(\s*\w*\s*\*?(?P<o>\w+)[^)]*\)\s*(?P<n>\w+)"), ("function", r"^func\s+(?P<n>\w+)"), ("struct", r"^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+interface\b"), ("type_alias", r"^type\s+(?P<n>\w+)\s+=?\s*[\w\[\]*.]+\s*$")),
        (r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"(?P<m>[^\"\s]+)\"\s*$",),
        strings=r"\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])'",
    ),
    "java": Grammar((*_JVM_TYPES, ("method?", _TYPED), ("constructor?", rf"^\s*{_MODS}(?P<n>[A-Z]\w*)\s*\([^;]*\)\s*(?:throws\s+[\w.,\s]+)?\{{")), (r"^\s*import\s+(?:static\s+)?(?P<m>[\w.]+(?:\.\*)?)\s*;",), r"\bextends\s+(?P<b>[\w.]+)(?:<[^>]*>)?(?:.*?\bimplements\s+(?P<i>[\w., <>]+))?|\bimplements\s+(?P<i2>[\w., <>]+)"),
    "kotlin": Grammar((*_JVM_TYPES, ("function", rf"^\s*{_MODS}fun\s+(?:<[^>]+>\s*)?(?:(?P<o>\w+)(?:<[^>]*>)?\.)?(?P<n>\w+)\s*\("), ("type_alias", r"^\s*typealias\s+(?P<n>\w+)")), (r"^\s*import\s+(?P<m>[\w.]*\w(?:\.\*)?)",), r"\b(?:class|interface|object)\s+\w+[^:{]*?(?:\([^)]*\))?\s*:\s*(?P<b>[\w.]+)(?:\([^)]*\))?(?:\s*,\s*(?P<i>[\w., <>()]+))?"),
    "scala": Grammar((*_JVM_TYPES, ("function", rf"^\s*{_MODS}def\s+(?P<n>\w+)"), ("type_alias", r"^\s*type\s+(?P<n>\w+)")), (r"^\s*import\s+(?P<m>[\w.]*\w(?:\.[_*]|\.\{[^}]*\})?)",), r"\bextends\s+(?P<b>[\w.]+)(?:[^{]*?\bwith\s+(?P<i>[\w., ]+))?"),
    "csharp": Grammar((("namespace", r"^\s*namespace\s+(?P<n>[\w.]+)"), ("class", rf"^\s*(?:\[[^\]]*\]\s*)*{_MODS}(?:class|record)\s+(?P<n>\w+)"), ("struct", rf"^\s*{_MODS}struct\s+(?P<n>\w+)"), ("interface", rf"^\s*{_MODS}interface\s+(?P<n>\w+)"), ("enum", rf"^\s*{_MODS}enum\s+(?P<n>\w+)"), ("method?", _TYPED)), (r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<m>[\w.]+)\s*;",), r"\b(?:class|record|struct|interface)\s+\w+(?:<[^>]*>)?(?:\([^)]*\))?\s*:\s*(?P<b>[\w.]+)(?:<[^>]*>)?(?:\s*,\s*(?P<i>[\w., <>]+))?"),
    "rust": Grammar(
        (("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(?P<n>\w+)"), ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|union)\s+(?P<n>\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>\w+)"), ("interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<n>\w+)"), ("module", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<n>\w+)\s*\{"), ("type_alias", r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<n>\w+)"), ("extension", r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<n>\w+)")),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<m>[\w:]+(?:::\{[^}]*\}|::\*)?)", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<m>\w+)\s*;"),
        r"\bimpl(?:<[^>]*>)?\s+(?P<b>[\w:]+)(?:<[^>]*>)?\s+for\s+(?P<of>\w+)",
        strings=r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'",
    ),
    "swift": Grammar((("class", rf"^\s*(?:@\w+\s+)*{_MODS}(?:class|actor)\s+(?P<n>[A-Z]\w*)"), ("struct", rf"^\s*{_MODS}struct\s+(?P<n>\w+)"), ("interface", rf"^\s*{_MODS}protocol\s+(?P<n>\w+)"), ("enum", rf"^\s*{_MODS}(?:indirect\s+)?enum\s+(?P<n>\w+)"), ("extension", rf"^\s*{_MODS}extension\s+(?P<n>[\w.]+)"), ("function", rf"^\s*(?:@\w+\s+)*{_MODS}func\s+(?P<n>\w+)")), (r"^\s*(?:@testable\s+)?import\s+(?P<m>[\w.]+)",), r"\b(?:class|struct|enum|protocol|extension|actor)\s+[\w.]+(?:<[^>]*>)?\s*:\s*(?P<b>[\w.]+)(?:\s*,\s*(?P<i>[\w., ]+))?"),
    "c": Grammar((("struct", r"^\s*(?:typedef\s+)?(?:struct|union)\s+(?P<n>\w+)\s*\{"), ("enum", r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(?P<n>\w+)"), ("class", r"^\s*(?:template\s*<[^>]*>\s*)?class\s+(?P<n>\w+)[^;]*$"), ("namespace", r"^\s*(?:inline\s+)?namespace\s+(?P<n>[\w:]+)"), ("constant", r"^\s*#\s*define\s+(?P<n>\w+)"), ("function", r"^(?!\s*(?:return|else|typedef|using)\b)\s*(?:[\w:<>,~]++[\s*&]++)+(?:(?P<o>\w+)::)?(?P<n>~?\w+)\s*\([^;]*\)\s*(?:const|noexcept|override|final|\s)*\{?\s*$")), (r"^\s*#\s*include\s+[<\"](?P<m>[^>\"]+)[>\"]",), r"\b(?:class|struct)\s+\w+\s*(?:final\s*)?:\s*(?:public|private|protected|virtual|\s)*(?P<b>[\w:]+)"),
    "ruby": Grammar((("class", r"^\s*class\s+(?P<n>[A-Z][\w:]*)"), ("module", r"^\s*module\s+(?P<n>[A-Z][\w:]*)"), ("function", r"^\s*def\s+(?:self\.)?(?P<n>\w+[?!=]?)"), ("constant", r"^\s*(?P<n>[A-Z][A-Z0-9_]+)\s*=(?!=)")), (r"^\s*(?:require|require_relative|load)\s*\(?\s*['\"](?P<m>[^'\"]+)['\"]",), r"^\s*class\s+[\w:]+\s*<\s*(?P<b>[\w:]+)|^\s*(?:include|extend|prepend)\s+(?P<x>[A-Z][\w:]*)", block="end", comments=r"#[^\n]*|^=begin.*?^=end"),
    "php": Grammar((("namespace", r"^\s*namespace\s+(?P<n>[\w\\]+)"), ("class", rf"^\s*{_MODS}class\s+(?P<n>\w+)"), ("interface", r"^\s*interface\s+(?P<n>\w+)"), ("interface", r"^\s*trait\s+(?P<n>\w+)"), ("enum", r"^\s*enum\s+(?P<n>\w+)"), ("function", rf"^\s*{_MODS}function\s+&?(?P<n>\w+)")), (r"^\s*use\s+(?:function\s+|const\s+)?(?P<m>[\w\\]+(?:\\\{[^}]*\})?)(?:\s+as\s+\w+)?\s*;", r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"](?P<m>[^'\"]+)['\"]"), r"\bextends\s+(?P<b>[\w\\]+)(?:.*?\bimplements\s+(?P<i>[\w\\, ]+))?|\bimplements\s+(?P<i2>[\w\\, ]+)", comments=r"//[^\n]*|#(?!\[)[^\n]*|/\*.*?\*/"),
}
GRAMMARS["ts"] = GRAMMARS["js"]
GRAMMARS["cpp"] = GRAMMARS["c"]
TYPES = frozenset("class struct interface enum namespace module extension".split())


def language_of(path: str) -> str:
    return LANGUAGE.get(path.rsplit(".", 1)[-1].lower(), "") if "." in path.rsplit("/", 1)[-1] else ""


def blanked(text: str, grammar: Grammar, strings: bool = True) -> str:
    """The text with comments, and strings if wanted, blanked; line breaks stay."""
    both = grammar.pattern("(?ms)" + f"(?P<c>{grammar.comments})|(?P<s>{grammar.strings})")
    blank = lambda m: re.sub(r"[^\n]", " ", m[0]) if m["c"] is not None else (m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if strings else m[0])
    return both.sub(blank, text)


def _end(lines: list[str], at: int, grammar: Grammar) -> int:
    """The last line (from 0) of the block that a definition on line ``at`` opens."""
    if grammar.block == "end":
        indent = len(lines[at]) - len(lines[at].lstrip())
        if re.search(r"\bend\s*$", lines[at]) or re.match(r"^\s*[A-Z][A-Z0-9_]+\s*=", lines[at]) or re.match(r"^\s*def\s+\S+.*\)\s*=\s", lines[at]):
            return at
        for k in range(at + 1, len(lines)):
            if re.match(r"\s*end\b", lines[k]) and len(lines[k]) - len(lines[k].lstrip()) <= indent:
                return k
        return at
    depth, opened = 0, False
    if "{" not in lines[at] and re.search(r"\)\s*(?::\s*[\w<>?.,\s]+)?=(?!>)", lines[at]):
        return at  # an expression body
    for k in range(at, len(lines)):
        for c in lines[k]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
            elif c == ";" and not opened:
                return k
        if opened and depth <= 0:
            return k
        if not opened and k > at + 2:
            return at
    return len(lines) - 1 if opened else at


#: Comment and attribute lines above a definition, where they differ from C's and Java's.
_ABOVE = {"ruby": r"\s*#", "php": r"\s*(?://|#|/\*|\*)", "rust": r"\s*(?://|#\[|/\*|\*)", "c": r"\s*(?://|/\*|\*)", "cpp": r"\s*(?://|/\*|\*)"}


def definitions(path: str, text: str) -> list[tuple[str, str, int, int, int]]:
    """(kind, qualname, region_start, def_line, end_line) of a file, in order; lines from 1. A region begins at the
    comment or decorator lines right above."""
    g = GRAMMARS.get(language_of(path))
    if g is None:
        return []
    lines, raw, found, open_ = blanked(text, g).split("\n"), text.split("\n"), [], []
    for k, line in enumerate(lines):
        while open_ and open_[-1][1] < k:
            open_.pop()
        for kind, pattern in g.definitions:
            m = g.pattern(pattern).match(line)
            name = m["n"] if m else None
            if not m or name in NOT_NAMES:
                continue
            owner = open_[-1] if open_ else None
            inside = owner is not None and owner[2] in TYPES and owner[2] not in ("namespace", "module")
            if kind.endswith("?") and not inside or kind == "constructor?" and owner[0].split(".")[-1] != name:
                continue
            kind = kind.rstrip("?")
            if kind == "function" and inside:
                kind = "method"
            if kind == "method" and inside and owner[0].split(".")[-1] == name:
                kind = "constructor"
            end = k if kind in ("constant", "type_alias") else _end(lines, k, g)
            receiver = m.groupdict().get("o")
            prefix = (receiver + "." if receiver else "") if not inside else owner[0] + "."
            if owner is not None and not inside and not receiver:
                prefix = owner[0] + "."
            qualname = prefix + name.replace("::", ".").replace("\\", ".")
            start = k
            while start > 0 and re.match(_ABOVE.get(language_of(path), r"\s*(?://|/\*|\*|@\w|\[\w)"), raw[start - 1]):
                start -= 1
            found.append((kind, qualname, start + 1, k + 1, end + 1))
            if end > k or kind in TYPES:
                open_.append((qualname, end, kind))
            break
    return found


def imports(path: str, text: str) -> list[tuple[int, str, str]]:
    """(line, module, names) of a file's imports; names as they stand."""
    g = GRAMMARS.get(language_of(path))
    if g is None:
        return []
    found, block = [], False
    for k, line in enumerate(blanked(text, g, strings=False).split("\n")):
        if language_of(path) == "go":  # quoted paths count in an import's line or block only
            if re.match(r"\s*import\s*\(", line):
                block = True
                continue
            if block and line.strip() == ")":
                block = False
            if not block and not line.lstrip().startswith("import"):
                continue
        for pattern in g.imports:
            m = g.pattern(pattern).search(line)
            if m:
                found.append((k + 1, m["m"], (m.groupdict().get("names") or "").strip()))
                break
    return found


def bases(path: str, text: str) -> list[tuple[int, str, str, str]]:
    """(line, definition, base, relation) of heritage: the first base inherits, others implement; mixins of Ruby and
    of Scala are mixed in."""
    g, language = GRAMMARS.get(language_of(path)), language_of(path)
    if g is None or not g.bases:
        return []
    found, lines = [], blanked(text, g).split("\n")
    at = [(d[3], d[4], d[1]) for d in definitions(path, text) if d[0] in TYPES]
    for k, line in enumerate(lines):
        for m in g.pattern(g.bases).finditer(line):
            names = m.groupdict()
            own = next((q for a, b, q in reversed(at) if a <= k + 1 <= b), None) if not names.get("of") else names["of"]
            if own is None:
                continue
            more = [x.split("<")[0].split("(")[0].strip() for x in re.split(r",|\bwith\b", names.get("i") or names.get("i2") or "")]
            if names.get("b"):
                found.append((k + 1, own, names["b"], "implements" if language == "rust" else "inherits"))
            found += [(k + 1, own, x, "mixes_in" if language == "scala" else "implements") for x in more if x]
            if names.get("x"):
                found.append((k + 1, own, names["x"], "mixes_in"))
    return found


#: Verbs of routes, and by language the frameworks that a file must name before a pattern counts.
VERBS = "get|post|put|delete|patch|head|options"
_PATH = r"['\"`](?P<p>[^'\"`]*)['\"`]"
ROUTES: dict[str, tuple[tuple[str, str, str], ...]] = {
    "python": (
        ("fastapi|flask|sanic|quart|litestar", "web", rf"^\s*@\w[\w.]*\.(?P<v>{VERBS})\(\s*{_PATH}"),
        ("fastapi|flask|sanic|quart|litestar", "web", rf"^\s*@\w[\w.]*\.route\(\s*{_PATH}(?:.*?methods\s*=\s*[\[(](?P<vs>[^\])]*))?"),
        ("django", "django", r"^\s*(?:path|re_path|url)\(\s*r?['\"](?P<p>[^'\"]*)['\"]\s*,\s*(?P<h>[\w.]+)"),
    ),
    "js": (
        ("express|fastify|koa|hono|restify|@hapi", "web", rf"\b(?:app|router|server|api|fastify|\w*[Rr]outer)\.(?P<v>{VERBS}|all)\(\s*['\"`](?P<p>/[^'\"`]*)['\"`]\s*,\s*(?:.*,\s*)?(?P<h>[\w.]+)?"),
        ("@nestjs", "nest", r"^\s*@(?P<v>Get|Post|Put|Delete|Patch|Head|Options|All)\(\s*(?:['\"`](?P<p>[^'\"`]*)['\"`])?"),
    ),
    "go": (
        ("net/http|gin-gonic|go-chi|labstack/echo|gorilla/mux|gofiber", "web", rf"\.(?P<v>GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Get|Post|Put|Delete|Patch)\(\s*{_PATH}\s*,\s*(?P<h>[\w.]+)"),
        ("net/http|gin-gonic|go-chi|gorilla/mux", "web", rf"\.?\bHandle(?:Func)?\(\s*['\"`](?:(?P<v>[A-Z]+)\s+)?(?P<p>/[^'\"`]*)['\"`]\s*,\s*(?P<h>[\w.]+)"),
    ),
    "java": (
        ("springframework", "spring", r"^\s*@(?P<v>Get|Post|Put|Delete|Patch)Mapping(?:\(\s*(?:value\s*=\s*|path\s*=\s*)?(?:\"(?P<p>[^\"]*)\")?)?"),
        (r"ws\.rs", "jaxrs", r"^\s*@(?P<v>GET|POST|PUT|DELETE|PATCH|HEAD)\b(?P<p>)"),
    ),
    "kotlin": (("springframework", "spring", r"^\s*@(?P<v>Get|Post|Put|Delete|Patch)Mapping(?:\(\s*(?:\"(?P<p>[^\"]*)\")?)?"), (r"io\.ktor", "ktor", rf"^\s*(?P<v>{VERBS})\(\s*\"(?P<p>[^\"]*)\"\s*\)\s*\{{")),
    "csharp": (("AspNetCore|Http", "aspnet", r"^\s*\[Http(?P<v>Get|Post|Put|Delete|Patch)(?:\(\s*\"(?P<p>[^\"]*)\")?"), ("", "minimal", r"\.Map(?P<v>Get|Post|Put|Delete|Patch)\(\s*\"(?P<p>[^\"]*)\"\s*,\s*(?P<h>[\w.]+)?")),
    "rust": (("actix_web|rocket", "actix", rf"^\s*#\[(?P<v>{VERBS})\(\s*\"(?P<p>[^\"]*)\""), ("axum", "axum", rf"\.route\(\s*\"(?P<p>[^\"]*)\"\s*,\s*(?P<v>{VERBS})\(\s*(?P<h>[\w:]+)")),
    "ruby": (("", "rails", rf"^\s*(?P<v>{VERBS})\s+['\"](?P<p>[^'\"]*)['\"](?:\s*,\s*to:\s*['\"](?P<h>[^'\"]*)['\"]|\s*=>\s*['\"](?P<h2>[^'\"]*)['\"])"), ("sinatra", "sinatra", rf"^\s*(?P<v>{VERBS})\s+['\"](?P<p>[^'\"]*)['\"]\s+do\b")),
    "php": (("", "laravel", rf"\bRoute::(?P<v>{VERBS}|any)\(\s*{_PATH}\s*,\s*(?:\[\s*)?(?P<h>[\w\\]+)?"), ("Symfony", "symfony", r"^\s*#\[Route\(\s*['\"](?P<p>[^'\"]*)['\"](?:.*?methods:\s*\[(?P<vs>[^\]]*)\])?")),
}
ROUTES["ts"] = ROUTES["js"]
#: Prefixes that a class or group puts before the routes in it.
PREFIXES = {"java": r"@(?:RequestMapping|Path)\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]*)\"", "kotlin": r"@RequestMapping\(\s*\"([^\"]*)\"", "csharp": r"\[Route\(\s*\"([^\"]*)\"", "js": r"@Controller\(\s*['\"`]([^'\"`]*)['\"`]", "ts": r"@Controller\(\s*['\"`]([^'\"`]*)['\"`]"}
#: Rails' resources: (method, pattern after the name, action).
RESOURCES = (("GET", "", "index"), ("POST", "", "create"), ("GET", "/new", "new"), ("GET", "/{id}", "show"), ("GET", "/{id}/edit", "edit"), ("PATCH", "/{id}", "update"), ("DELETE", "/{id}", "destroy"))
_DEFINES = re.compile(r"^\s*(?:(?:public|private|protected|internal|static|async|override|suspend|virtual|final)\s+)*(?:def|fun|fn|function|func|[\w<>\[\],.?]+)\s+(?P<n>\w+)\s*[(<]|^\s*(?:async\s+)?(?P<n2>\w+)\s*\(")


def routes(path: str, text: str) -> list[tuple[int, str, str, str, str]]:
    """(line, method, pattern, framework, handler) of a file, by line. A decorated handler is the next definition."""
    language = language_of(path)
    g = GRAMMARS.get(language)
    lines = (blanked(text, g, strings=False) if g else re.sub(r"(?m)^\s*#.*$", "", text)).split("\n")
    found, prefix, owner = [], "", ""
    wanted = [(f, re.compile(p)) for gate, f, p in ROUTES.get(language, ()) if re.search(gate, text)]
    for k, line in enumerate(lines):
        if language in PREFIXES and (m := re.search(PREFIXES[language], line)):
            following = next((x for x in lines[k + 1 : k + 6] if re.search(r"\b(?:class|interface)\s+\w+", x)), "") if not re.search(r"\bclass\s+\w+", line) else line
            if following:
                owner = re.search(r"\b(?:class|interface)\s+(\w+)", following)[1]
                prefix = m[1].replace("[controller]", re.sub(r"Controller$", "", owner).lower())
                continue
        for framework, p in wanted:
            for m in p.finditer(line):
                names = m.groupdict()
                handler = names.get("h") or names.get("h2") or ""
                if not handler and re.match(r"\s*(?:@|#\[|\[)", line):
                    after = next((x for x in lines[k + 1 : k + 8] if x.strip() and not re.match(r"\s*(?:@|#\[|\[)", x)), "")
                    d = _DEFINES.match(after)
                    handler = (d["n"] or d["n2"] or "") if d else ""
                pattern = names.get("p") or ""
                if framework == "jaxrs":
                    sub = next((re.search(r"@Path\(\s*\"([^\"]*)\"", x) for x in lines[k + 1 : k + 3] if "@Path" in x), None)
                    pattern = sub[1] if sub else ""
                if framework in ("nest", "spring", "jaxrs", "aspnet"):
                    pattern = "/" + "/".join(x.strip("/") for x in (prefix, pattern) if x.strip("/"))
                if framework in ("django", "rails", "laravel", "symfony") and not pattern.startswith("/"):
                    pattern = "/" + pattern.lstrip("^").rstrip("$")
                verbs = [v.strip(" '\"").upper() for v in (names.get("vs") or "").split(",") if v.strip(" '\"")] or [(names.get("v") or ("ANY" if framework in ("django", "symfony") or names.get("v") is None and framework != "web" else "GET")).upper()]
                found += [(k + 1, "ANY" if v == "ALL" else v, pattern, framework, handler) for v in verbs]
        if language == "ruby" and (m := re.match(r"\s*resources\s+:(\w+)(?:.*?only:\s*\[([^\]]*)\])?(?:.*?except:\s*\[([^\]]*)\])?", line)):
            only = {x.strip(" :") for x in m[2].split(",")} if m[2] else None
            out = {x.strip(" :") for x in m[3].split(",")} if m[3] else set()
            found += [(k + 1, verb, f"/{m[1]}{tail}", "rails", f"{m[1]}#{action}") for verb, tail, action in RESOURCES if (only is None or action in only) and action not in out]
    return found


_REQUESTS = re.compile(rf"\b(?:requests|httpx|axios|client|http|session|\$http|restTemplate|reqwest|HTTParty|Http)(?:\.|::)(?P<v>{VERBS}|Get|Post|Put|Delete)(?:Async|ForObject)?\(\s*f?{_PATH}|\bfetch\(\s*['\"`](?P<f>[^'\"`]*)['\"`](?:.*?method:\s*['\"](?P<fv>\w+)['\"])?")


def requests(path: str, text: str) -> list[tuple[int, str, str]]:
    """(line, method, url) of the requests that a file makes with a literal URL."""
    found = []
    for k, line in enumerate(text.split("\n")):
        for m in _REQUESTS.finditer(line):
            found.append((k + 1, (m["v"] or m["fv"] or "get").upper(), m["p"] if m["p"] is not None else m["f"]))
    return found


_ENV = re.compile(r"(?:os\.environ(?:\.get)?[\[(]|os\.getenv\(|process\.env\[|System\.getenv\(|std::env::var\(|env::var\(|os\.Getenv\(|ENV\[|ENV\.fetch\(|getenv\(|Environment\.GetEnvironmentVariable\()\s*['\"]([A-Za-z_]\w*)['\"]|process\.env\.([A-Z_][A-Z0-9_]*)")
_FILES = re.compile(r"\b(?:open|read_csv|read_parquet|readFile(?:Sync)?|writeFile(?:Sync)?|File\.(?:read|open|write)|os\.Open|os\.ReadFile|fopen|file_get_contents|file_put_contents)\(\s*['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([a-z+]+)['\"])?")
_EVENTS = re.compile(r"\.(emit|publish|dispatch|send_event|trigger|on|subscribe|addListener|addEventListener|once)\(\s*['\"]([\w.:-]+)['\"]")
_SQL = re.compile(r"(?i)\b(?:(from|join)|(insert\s+into|update|delete\s+from|merge\s+into|create\s+table(?:\s+if\s+not\s+exists)?))\s+[`\"]?([a-z_][\w.]*)")


def resources(path: str, text: str) -> list[tuple[int, str, str, str]]:
    """(line, kind, key, relation) of what a file uses by literal: env, file, event, table."""
    found = []
    for k, line in enumerate(text.split("\n")):
        found += [(k + 1, "env", m[1] or m[2], "reads") for m in _ENV.finditer(line)]
        found += [(k + 1, "file", m[1], "writes" if "write" in m[0].split("(")[0].lower() or "put" in m[0].split("(")[0] or set(m[2] or "") & set("wax") else "reads") for m in _FILES.finditer(line)]
        found += [(k + 1, "event", m[2], "reads" if m[1] in ("on", "subscribe", "addListener", "addEventListener", "once") else "writes") for m in _EVENTS.finditer(line)]
        for s in re.finditer(r"\"([^\"]*)\"|'([^']*)'|`([^`]*)`", line):
            own = s[1] or s[2] or s[3] or ""
            if re.match(r"(?i)\s*(?:select|insert|update|delete|merge|create|with)\b", own):
                found += [(k + 1, "table", m[3].lower(), "reads" if m[1] else "writes") for m in _SQL.finditer(own)]
    return found


def headings(path: str, text: str) -> list[tuple[str, int, int, int]]:
    """(title, level, line, end_line) of a Markdown or reStructuredText file; a section ends before the next heading
    of its level or a higher one."""
    lines, found, fence = text.split("\n"), [], False
    if language_of(path) == "markdown":
        for k, line in enumerate(lines):
            if re.match(r"\s*(?:```|~~~)", line):
                fence = not fence
            elif not fence and (m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)):
                found.append((m[2], len(m[1]), k + 1))
            elif not fence and k and re.match(r"(?:=+|-+)\s*$", line) and lines[k - 1].strip() and not re.match(r"[#>\-*\s]", lines[k - 1]):
                found.append((lines[k - 1].strip(), 1 if line[0] == "=" else 2, k))
    elif language_of(path) == "rst":
        order: list[str] = []
        for k in range(1, len(lines)):
            m = re.match(r"([=\-~^\"'`#*+:.])\1{2,}\s*$", lines[k])
            if m and lines[k - 1].strip() and len(lines[k].rstrip()) >= len(lines[k - 1].rstrip()) and not re.match(r"([=\-~^\"'`#*+:.])\1{2,}\s*$", lines[k - 1]):
                over = k >= 2 and lines[k - 2].rstrip() == lines[k].rstrip()
                style = m[1] + ("o" if over else "")
                if style not in order:
                    order.append(style)
                found.append((lines[k - 1].strip(), order.index(style) + 1, k))
    out = []
    for i, (title, level, line) in enumerate(found):
        end = next((x[2] - 1 for x in found[i + 1 :] if x[1] <= level), len(lines))
        out.append((title, level, line, end))
    return out


def branches_blanked(text: str) -> str:
    """C and C++ text with all but one branch of each preprocessor condition blanked (the first, after ``#if 0`` the
    second), so that a definition that stands in several branches counts once; lines stay in place."""
    out: list[str] = []
    stack: list[tuple[bool, bool]] = []  # whether the branch is kept, and whether one has been
    for line in text.split("\n"):
        m = re.match(r"\s*#\s*(ifdef|ifndef|if|elif|else|endif)\b(.*)", line)
        if not m:
            out.append(line if all(kept for kept, _ in stack) else "")
            continue
        if m[1] in ("if", "ifdef", "ifndef"):
            kept = not (m[1] == "if" and m[2].strip() == "0")
            stack.append((kept, kept))
        elif m[1] == "endif":
            del stack[-1:]
        elif stack:
            stack[-1] = (not stack[-1][1], True)
        out.append(line)
    return "\n".join(out)
