"""Operator 11: the main text of web pages, by paths that the pages of a host agree on.

Each page scores its containers by the running text right below them. Containers have paths of tags
and classes in which numbers are wildcards, and pages of one host vote for paths in Spark. A second
pass takes from every page the elements on the host's winning path; a container whose
text is the same wherever it occurs on the host is furniture and is left out of it.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_CHARS, Scratch, documents, with_estimates

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"

# Elements of the markup language by what they do, and the words that sites name their furniture by.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp noembed noframes iframe".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table article section div main body aside nav form blockquote".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTAINERS = set("article section div main body td center".split())
SILENT = RAW | set("noscript template svg canvas button select object audio video map".split())
FURNITURE_TAGS = SILENT | set("head nav footer aside form dialog menu".split())
FURNITURE_ROLES = set("navigation contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
FURNITURE_WORDS = set(
    """ad ads adv advert adverts advertisement advertising adbox adsense adslot banner sponsor sponsored promo promotion nav navbar navigation menu menubar
    breadcrumb breadcrumbs sidebar rail widget widgets footer foot masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay
    newsletter subscribe subscription signup login form search comment comments commentlist reply replies respond responses disqus discuss discussion reactions
    related recommended recommendations trending popular teaser teasers outbrain taboola share sharing social tags toc skip cta side aside announcement
    pagination pager toolbar copyright legal privacy paywall werbung kommentar kommentare publicite commentaires publicidad comentarios""".split()
)
HEADER_WORDS = {"header", "hdr"}
TEXT_WORDS = set("article articlebody entry post story content body text main prose".split())
STATES = set("has with no is without".split())


def name_words(value: str) -> list[str]:
    """The words of one class or id: at marks, changes of case and digits."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+", value)]


class Element:
    __slots__ = ("tag", "parent", "step", "furniture", "heading", "names_text", "children")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        names = [*attributes.get("class", "").split(), *attributes.get("id", "").split()]
        words = [set(w) for n in names if (w := name_words(n)) and w[0] not in STATES]
        said = set().union(*words)
        self.tag, self.parent = tag, parent
        classes = sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").split()})
        self.step = ".".join([tag, *classes])
        inside = parent is not None and (parent.heading or parent.tag in ("article", "main") or parent.names_text)
        header = tag == "header" or bool(said & HEADER_WORDS) or attributes.get("role") == "banner"
        named = bool(said & FURNITURE_WORDS) and not any(w <= TEXT_WORDS for w in words)
        out = tag not in ("html", "body") and (tag in FURNITURE_TAGS or named or attributes.get("role") in FURNITURE_ROLES or (header and not inside))
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        self.furniture = (parent is not None and parent.furniture) or out or hidden
        self.heading = (parent is not None and parent.heading) or (header and inside)  # of a header inside an article only headings are kept
        self.names_text = bool(said & TEXT_WORDS)
        self.children: list = []  # elements and text in page order


def parse(page: str) -> Element:
    """A tree of elements that forgives what browsers forgive: open paragraphs, strays, a page that breaks off."""
    top = at = Element("#", {}, None)
    place, n = 0, len(page)
    while place < n:
        found = TOKEN.search(page, place)
        if not found:
            break
        if found.start() > place:
            at.children.append(page[place : found.start()])
        place = found.end()
        closing, tag, rest = found.group(1), found.group(2), found.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            inner = at
            while inner is not top and inner.tag != tag and (tag not in INLINE or inner.tag in INLINE):
                inner = inner.parent
            at = inner.parent if inner.tag == tag else at
            continue
        if tag not in INLINE and tag not in RAW:
            inner = at
            while inner is not top and inner.tag not in SCOPES and inner.tag != "p":
                inner = inner.parent
            at = inner.parent if inner.tag == "p" else at
        if tag in CLOSES:
            inner = at
            while inner is not top and inner.tag not in SCOPES and inner.tag not in CLOSES[tag]:
                inner = inner.parent
            at = inner.parent if inner.tag in CLOSES[tag] else at
        attributes = {}
        for name, *values in ATTRIBUTE.findall(rest):
            attributes.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
        element = Element(tag, attributes, at)
        at.children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, place)
            place = end.end() if end else n
        elif tag not in VOID and not rest.rstrip().endswith("/"):
            at = element
    if place < n:
        at.children.append(page[place:])
    return top


def walk(top: Element, stop=lambda element: False) -> Iterator[tuple[Element, str | None]]:
    """(element, text) for text right below an element, (element, None) as an element begins, ends or is left out by `stop`, in page order, without recursion."""
    stack = [(top, iter(top.children))]
    while stack:
        element, rest = stack[-1]
        for child in rest:
            if isinstance(child, str):
                yield element, child
                continue
            yield child, None
            if not stop(child):
                stack.append((child, iter(child.children)))
                break
        else:
            yield element, None
            stack.pop()


def blocks(top: Element, left_out=frozenset()) -> list[str]:
    """The blocks below `top`: text between borders of elements that are not inline, white space as one space."""
    out, piece, paths = [], [], {}
    for element, text in walk(top, lambda e: e.furniture or (bool(left_out) and path_of(e, paths) in left_out)):
        if text is not None:
            if not element.heading or _in_heading(element):
                piece.append(text)
        elif element.tag == "br":
            piece.append(" ")
        elif element.tag not in INLINE and element.tag not in SILENT:
            out.append("".join(piece))
            piece = []
    out.append("".join(piece))
    shown = (" ".join(html.unescape(b).split()) for b in out)
    return [b for b in shown if b]


def _in_heading(element: Element) -> bool:
    while element is not None and element.heading:
        if element.tag in HEADINGS:
            return True
        element = element.parent
    return False


def path_of(element: Element, known: dict[int, str]) -> str:
    """Generalised path from the body: steps of tag and classes, numbers as wildcards."""
    chain = []
    while element.parent is not None and id(element) not in known:
        chain.append(element)
        element = element.parent
    path = known.get(id(element), "")
    for e in reversed(chain):
        path = known[id(e)] = path if e.tag in ("html", "#") else f"{path}/{e.step}"
    return path


def containers(top: Element) -> Iterator[Element]:
    """Containers outside furniture, in page order."""
    stack = [top]
    while stack:
        element = stack.pop()
        if element.tag in CONTAINERS:
            yield element
        stack.extend(c for c in reversed(element.children) if not isinstance(c, str) and not c.furniture)


def score(top: Element) -> tuple[dict[str, float], dict[str, str]]:
    """Path to score of the containers that hold running text, and path to all the text below it.

    A paragraph counts for the container around it in full and for the next one out by half, as
    its characters outside links; names that sites give to texts add a quarter. Furniture scores nothing.
    """
    paths: dict[int, str] = {}
    scores: dict[str, float] = defaultdict(float)
    inside: dict[str, list[str]] = defaultdict(list)
    for element, text in walk(top, lambda e: e.furniture):
        if text is None or not text.strip(BLANK_CHARS):
            continue
        linked, at = False, element
        while at.tag not in CONTAINERS and at.parent is not None:
            linked, at = linked or at.tag == "a", at.parent
        size = len(text.strip(BLANK_CHARS))
        outer, weight = at, 1.0
        while outer is not None and outer.tag != "#":
            if outer.tag in CONTAINERS:
                path = path_of(outer, paths)
                inside[path].append(text)
                if weight > 0.25 and not linked and not element.heading:
                    scores[path] += size * weight * (1.25 if outer.names_text or outer.tag in ("article", "main") else 1.0)
                    weight /= 2
            outer = outer.parent
    return scores, {p: "".join(t) for p, t in inside.items()}


def page_votes(page: str | None) -> list[tuple[str, int, int]]:
    """path, thousandths of the page's best score, and digest of the text below, for each container path of a page."""
    scores, inside = score(parse(page or ""))
    best = max(scores.values(), default=0.0) or 1.0
    return [(path, round(1000 * scores.get(path, 0.0) / best), zlib.crc32(" ".join(text.split()).encode(errors="replace"))) for path, text in inside.items()]


def _climb(element: Element) -> Element:
    """The article around an element, where it is within one: sections of an article belong together."""
    around = element
    while around is not None and around.tag != "#":
        if around.tag == "article":
            return around
        around = around.parent
    return element


def outermost(elements: list[Element]) -> list[Element]:
    """`elements` without repeats and without those inside another of them."""
    out, seen = [], set()
    for element in elements:
        around = element
        while around is not None and id(around) not in seen:
            around = around.parent
        if around is None:
            seen.add(id(element))
            out.append(element)
    return out


def extract(page: str | None, winners: list[str], furniture: frozenset[str]) -> str:
    """Text of the elements on the first of `winners` that the page has text on, else on the page's own best path, else of the whole page."""
    top = parse(page or "")
    paths: dict[int, str] = {}
    by_path = defaultdict(list)
    for element in containers(top):
        by_path[path_of(element, paths)].append(element)

    def on(path: str) -> str:
        return "\n\n".join(b for element in outermost(list(map(_climb, by_path.get(path, ())))) for b in blocks(element, furniture))

    for path in winners:
        if text := on(path):
            return text
    scores, _ = score(top)
    own = min(scores, key=lambda p: (-scores[p], p), default=None)
    return (own and on(own)) or "\n\n".join(blocks(top, furniture))


def vote_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(host, *vote) for host, page in zip(batch["host"], batch["html"]) for vote in page_votes(page)]
        yield pd.DataFrame(rows, columns=["host", "path", "share", "print"])


def extract_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        known = [([] if w is None else list(w), frozenset() if f is None else frozenset(f)) for w, f in zip(batch["winners"], batch["furniture"])]
        texts = [extract(page, *agreed) for page, agreed in zip(batch["html"], known)]
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, HOST, 1), F.lit("")))


def agree(scratch: Scratch, votes: DataFrame, share: float, pages: int, sameness: float) -> DataFrame:
    """host, winners (paths by votes), furniture: what the pages of each host agree on.

    A path's votes are its shares of the pages' best scores, times how far its texts differ from page to page. Winners have
    at least `share` of the votes of the first, so there are few for each host, and do not lie around one with more votes. Furniture
    is a path found `pages` times or more whose distinct texts are at most `sameness` of the
    times, next to the same figure of the first.
    """
    paths = scratch.cut(votes.groupBy("host", "path").agg(F.sum("share").alias("sum"), F.count("*").alias("n"), F.approx_count_distinct("print", 0.02).alias("kinds")))
    paths = paths.withColumn("variety", F.least(F.col("kinds") / F.col("n"), F.lit(1.0)))
    paths = paths.withColumn("votes", F.col("sum") * F.col("variety"))
    first = paths.groupBy("host").agg(F.max(F.struct("votes", "variety", "path")).alias("first"))
    joined = paths.join(first, "host").where(F.col("first.votes") > 0)
    wins = F.col("votes") >= F.col("first.votes") * share
    around = F.startswith(F.concat("first.path", F.lit("/")), F.concat("path", F.lit("/")))
    same = (F.col("n") >= pages) & (F.col("variety") <= F.col("first.variety") * sameness) & ~wins & ~around
    listed = joined.groupBy("host").agg(
        F.sort_array(F.collect_list(F.when(wins, F.struct((-F.col("votes")).alias("v"), "path")))).alias("w"),
        F.sort_array(F.collect_set(F.when(same, F.col("path")))).alias("furniture"),
    )
    inner = lambda x, i: ~F.exists(F.slice("w", F.lit(1), i), lambda y: F.startswith(y["path"], F.concat(x["path"], F.lit("/"))))
    return listed.select("host", F.transform(F.filter("w", inner), lambda x: x["path"]).alias("winners"), "furniture")


def main_text(spark: SparkSession, pages: DataFrame, *, share: float = 0.05, least_pages: int = 5, sameness: float = 0.34) -> DataFrame:
    """page_id, url, text and n_chars of each row of `pages` (page_id, url, html).

    A null html is an empty one and gives an empty text, as does a page without text. Pages whose url is null or
    names no host have no one to agree with and go by their own best container; so do pages that have none of
    the host's paths. Rows that repeat vote and are answered each. An empty table gives an empty
    result; other columns are ignored.

    Votes are summed before they are shuffled, so a host with most pages is one row for each of its paths;
    what hosts agreed on is sent to all tasks up to 100,000 hosts, and joined with salted keys beyond.
    """
    scratch = Scratch(spark)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    votes = rows.where("host is not null").select("host", "html").mapInPandas(vote_batches, "host string, path string, share long, print long")
    agreed = scratch.cut(agree(scratch, votes, share, least_pages, sameness))
    known = with_estimates(rows, agreed, ["host"], agreed.count())
    return known.select("page_id", "url", "html", "winners", "furniture").mapInPandas(extract_batches, "page_id long, url string, text string, n_chars long")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark, documents(spark, sf_dir, "pages"))
