"""Main text of web pages by consensus host paths.

1. Each page's containers are scored: text in sentences counts for one, text in links and in boilerplate against.
   The best container votes with its *path*: tags and first classes from the root down, digits generalised.
2. Spark counts the votes of each host and keeps the winning path of each.
3. Each page is extracted again from the containers at its host's winning path; a page without them uses its own
   best container. Boilerplate inside is left out.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, written

# Fixed vocabularies of HTML.
CONTAINERS = frozenset("html body main article section div td form aside nav header footer blockquote ul ol table dl figure details dialog fieldset menu search hgroup noscript template svg select textarea iframe object".split())
BREAKS = CONTAINERS - {"svg"} | frozenset("p br hr h1 h2 h3 h4 h5 h6 li tr th dt dd pre figcaption address center option summary caption thead tbody tfoot title head".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes")
#: Elements that end where one of a group begins or their parent ends.
IMPLIED = {"p": BREAKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
#: Elements whose text is never main text; elements that no class makes boilerplate.
NOISE_TAGS = frozenset("nav aside footer header select svg menu dialog object search".split())
#: Elements that are main text only if they hold most of the page's; controls, whose words are text only inside a sentence.
FORMS = frozenset("form fieldset".split())
CONTROLS = frozenset("button label".split())
PLAIN = frozenset("html body main".split())
#: Words of a class, id or role of adverts, notices and reader comments; and of the parts around an article.
FOREIGN = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments commentlist reply replies disqus discussion adbanner adbox adcontainer adsense adslot adspace adunit adwrapper cookie cookies consent gdpr newsletter subscribe".split())
LAYOUT = frozenset("banner sidebar side rail nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot notice notices alert popup modal overlay signup login share sharing social related recommended widget toolbar pagination pager copyright complementary contentinfo responses search".split())
#: Words that may stand beside those in one class without changing what it says.
NEUTRAL = frozenset("area article bar block body bottom box button buttons col column container content entry feed form global group inner item items js left link links list main message module outer page panel post posts primary reader right row secondary section site slot text thread top unit user wrap wrapper".split())
#: Words that say the same behind any prefix (``wp-comment``), and those before them that speak of something else (``no-ads``).
CERTAIN = frozenset("ad ads advert adverts advertisement comment comments commentlist".split())
STATES = frozenset("with without has have no not non show shows hide is are allow allows allowed enable enabled disable disabled open closed free block after before above below to on".split())
# Tags as the HTML standard reads them: a quote opens a value only right after "=", and "/" has no effect.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![A-Za-z])[^>]*+(?:>|\Z)|"
    r"<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)?+)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+))?+)?+", re.S)
CLOSE = {t: re.compile(rf"</{t}(?=[\s>/])|</{t}\Z", re.I) for t in RAW}
_ENDS = re.compile(r"[.!?;:,]")
_PART = re.compile("[A-Z]?[a-z]+|[A-Z]+")


#: Places in which a host's pages meet its winning path.
SALTS = 32


class Container:
    """An element that holds others. ``blocks`` are indices into the page's list of blocks; ``kind`` is "tag" or
    "foreign" if the element itself is boilerplate, "layout" if its class says so and its text may tell otherwise."""

    __slots__ = ("parent", "tag", "name", "kind", "noise", "depth", "matched", "first", "end", "text", "links", "marks")

    def __init__(self, parent, tag: str, name: str, kind: str | None, first: int, wanted: list[str]):
        self.parent, self.tag, self.name, self.kind, self.first, self.end = parent, tag, name, kind, first, None
        self.depth = parent.depth + 1 if parent is not None else 0
        self.matched = parent is None or (parent.matched and self.depth < len(wanted) and wanted[self.depth] == name)
        self.text = self.links = self.marks = 0
        self.noise = False

    @property
    def path(self) -> str:
        names, at = [], self
        while at is not None:
            names.append(at.name)
            at = at.parent
        return ">".join(reversed(names))


def judged(tokens: list[str], article: bool = False) -> str | None:
    """What whole class tokens say: "foreign", "layout" or nothing. Of a token's words one must be of the
    vocabulary and the others neutral, so neither ``with-sidebar`` nor ``comments-open`` says anything. A certain word
    may end any name, as ``google-ads`` or the block of ``c-ad__body``."""
    found = None
    for token in tokens:
        parts = [x.lower() for x in _PART.findall(token)]
        block = [x.lower() for x in _PART.findall(token.split("__")[0].split("--")[0])]
        if block and block[-1] in CERTAIN and not STATES & set(block):
            return "foreign"
        if parts and all(x in FOREIGN or x in LAYOUT or x in NEUTRAL for x in parts):
            if any(x in FOREIGN for x in parts):
                return "foreign"
            if not article and any(x in LAYOUT for x in parts):
                found = "layout"
    return found


def _describe(tag: str, attributes: str) -> tuple[str, str | None]:
    """Generalised name, and what kind of boilerplate it is."""
    found: dict[str, str] = {}
    if "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    classes = unescape(found.get("class", "")).split()
    kind = "tag" if tag in NOISE_TAGS else "layout" if tag in FORMS else None
    if kind != "tag" and found and tag not in PLAIN:
        kind = kind if (said := judged([*classes, *found.get("id", "").split(), *found.get("role", "").split()], tag == "article")) is None else said
    return tag + ("." + re.sub(r"\d+", "#", classes[0].lower()) if classes else ""), kind


def parse(page: str, path: str | None = None) -> tuple[list[tuple[str, Container]], list[Container]]:
    """(blocks, containers): the page's blocks in order, each with its container, and all containers; those at
    ``path`` are ``matched`` and as deep as it.

    Markup that is never closed, or cut off at the end of the page, ends with the page.
    """
    wanted = path.split(">") if path else []
    root = Container(None, "", "", None, 0, wanted)
    stack, containers, blocks, parts, open_ = [root], [root], [], [], Counter()
    link = mute = control = 0  # depth of the stack at an open link, advert or control inside a line
    controls: list[int] = []  # which of the parts are a control's words

    def flush() -> None:
        if parts:
            if controls:
                own = set(controls)
                words = [k for k, x in enumerate(parts) if k not in own and not x.isspace()]
                for k in controls:
                    if not words or not words[0] < k < words[-1]:
                        parts[k] = " "
                controls.clear()
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                blocks.append((text, stack[-1]))

    def close(tag: str) -> None:
        nonlocal link, mute, control
        flush()
        while True:
            x = stack.pop()
            x.end = len(blocks)
            open_[x.tag] -= 1
            if x.tag == tag:
                break
        link, mute, control = (k if k <= len(stack) else 0 for k in (link, mute, control))

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        chunk = page[at : m.start() if m else len(page)]
        if chunk and not mute:
            text = unescape(chunk)
            if control:
                controls.append(len(parts))
            parts.append(text)
            n = len(text) if not (control or text.isspace()) else 0
            top = stack[-1]
            top.text += n
            if link:
                top.links += n
            elif n:
                top.marks += len(_ENDS.findall(text))
        if m is None:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "a":
            link = 0 if m[1] else len(stack)
        if tag in CONTROLS:
            control = 0 if m[1] else control or len(stack)
        elif tag in ("p", "li", "td"):
            control = 0  # a control that isn't closed ends with its block
        if tag in ("a", "span"):
            if m[1]:
                mute = 0
            elif "=" in m[3] and _describe(tag, m[3])[1] == "foreign":
                mute = mute or len(stack)
        if tag in BREAKS:
            flush()
        if m[1]:
            if open_[tag] > 0:
                close(tag)
            continue
        while (ends := IMPLIED.get(stack[-1].tag)) and tag in ends:
            close(stack[-1].tag)
        if tag in CLOSE:
            end = CLOSE[tag].search(page, at)
            at = end.start() if end else len(page)
            continue
        name = kind = None
        if tag in CONTAINERS or (tag in BREAKS and tag not in ("br", "hr") and "=" in m[3]):
            name, kind = _describe(tag, m[3])
        # other elements hold nothing of their own unless they are boilerplate
        if tag in CONTAINERS and not (tag == "svg" and m[3].endswith("/")) or kind:
            if tag not in BREAKS and kind:
                flush()
            made = Container(stack[-1], tag, name, kind, len(blocks), wanted)
            stack.append(made)
            containers.append(made)
            open_[tag] += 1
    flush()
    for x in containers:
        if x.end is None:
            x.end = len(blocks)
    _settle(containers)
    return blocks, containers


def _settle(containers: list[Container]) -> None:
    """Which containers are boilerplate: elements that are, and all inside; a form, or what only its layout class says so
    about, isn't if it holds most of the page's text and that isn't links."""
    text, links = ({id(x): (0 if x.kind in ("tag", "foreign") else getattr(x, k)) for x in containers} for k in ("text", "links"))
    for x in reversed(containers):  # children come after their parent
        if x.parent is not None and x.kind not in ("tag", "foreign"):
            text[id(x.parent)] += text[id(x)]
            links[id(x.parent)] += links[id(x)]
    whole = text[id(containers[0])]
    for x in containers[1:]:
        prose = x.kind == "layout" and 2 * text[id(x)] > whole and 3 * links[id(x)] < text[id(x)]
        x.noise = x.parent.noise or (x.kind is not None and not prose)


def best_container(containers: list[Container]) -> Container:
    """The one with the highest score; of equals the innermost. A part of a child's score counts for the parent,
    so text spread over many small children still finds what holds them."""
    total = {id(x): 0.0 if x.noise else x.text - 2 * x.links + 10 * x.marks for x in containers}
    for x in reversed(containers):  # children come after their parent
        if x.parent is not None and not x.noise:
            total[id(x.parent)] += 0.75 * total[id(x)]
    return max((x for x in containers if not x.noise), key=lambda x: (total[id(x)] + (50 if x.tag in ("article", "main") else 0), x.depth, -x.first))


def vote(page: str) -> tuple[str, float]:
    """The path of a page's best container, and the text in it."""
    blocks, containers = parse(page)
    if not blocks:
        return "", 0.0
    best = best_container(containers)
    return best.path, float(sum(len(t) for t, c in blocks[best.first : best.end] if not c.noise))


def extract(page: str, path: str | None) -> str:
    """The text of the containers at ``path``, of the best one if there are none."""
    blocks, containers = parse(page, path)
    depth = path.count(">") if path else 0
    chosen = [x for x in containers if depth and x.matched and x.depth == depth and not x.noise]
    if not chosen:
        chosen = [best_container(containers)]
    kept, at = [], 0
    for x in chosen:
        for k in range(max(at, x.first), x.end):
            if not blocks[k][1].noise:
                kept.append(blocks[k][0])
        at = max(at, x.end)
    return "\n".join(kept)


def page_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, votes): the winning path of each host; of equal votes the one with more text, then the first
    by name. Pages without text don't vote."""

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            found = [vote(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in found]), pa.array([n for _, n in found], pa.float64())], names=["host", "path", "n"])

    votes = pages.select(page_host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).transform(small_batches).mapInArrow(of, "host string, path string, n double").where("n > 0")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("n").alias("n"))
    return counted.groupBy("host").agg(F.min_by(F.struct("path", "votes"), F.struct((-F.col("votes")).alias("v"), (-F.col("n")).alias("n"), "path")).alias("w")).select("host", "w.path", "w.votes")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Null and empty pages have an empty text; pages without a host share one. Repeated rows each vote and have
    equal texts. A page larger than others is parsed as a whole. Other columns are ignored.
    """
    winners = written(host_paths(pages), "host-paths").select("host", "path")

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [extract(h.as_py() or "", p.as_py()) for h, p in zip(batch.column("html"), batch.column("path"))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), page_host(F.col("url")).alias("host"))
    # a host may have a third of the pages: its row is met in SALTS places (one, where Spark finds the winners small)
    own = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    winners = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    met = own.join(winners, ["host", "salt"], "left").select("page_id", "url", "html", "path")
    return met.transform(small_batches).mapInArrow(of, "page_id long, url string, text string").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))
