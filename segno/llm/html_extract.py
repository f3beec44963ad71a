"""Main text of web pages by equivalence classes of template tokens.

Pages of one host share a template. Pages with the same content, told by their text outside menus,
headers and the like, count as one, so copies of an article are no template. Every page is read into tokens: its tags, with the path of
elements around them, and its pieces of text. Tokens with the same occurrence vector across the
host's pages form an equivalence class. A vector is summed up as the sum over pages of a content hash
times the number of occurrences, so classes come from one aggregation with map-side sums, however
many pages a host has. A class is valid if it is frequent on its host and properly nested: each of
its opening tags has its closing tag in a class that is valid too. Valid classes, nested by path, make the
host's template; what stands between template tokens are slots.

Slots are extracted, except those in parts that a page's own markup or names mark as menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles or comments. Where a page has an article or
main element, that is where its slots are taken from. Text that the template itself repeats on a host's
pages, in an element of the template, is left out there as elsewhere; only a line of an article that
holds a slot too stays whole, so that no word is cut from a sentence. A name counts whole or by its
parts (``has-sidebar``); what only a part marks is no bar to an article or main element within.

Defined results
---------------
* A null or empty html has an empty text. A page without an article gives its remaining body text.
* The host is the url's; a null or odd url is a host of its own name or of none.
* Repeated rows each get their result. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, settle

#: Elements without content (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup (fixed values).
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements within a line of text (fixed values); all others bound a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold main text (fixed values).
OUTSIDE = frozenset(
    "head nav header footer aside form script style noscript template svg math iframe object canvas audio video button select option textarea input fieldset dialog menu title noembed noframes xmp".split()
)
#: Words in class, id or role that mark the same (fixed values).
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs"
    " header masthead topbar footer contentinfo sidebar sidebars aside complementary rail comment comments commentlist respond replies disqus cookie cookies consent gdpr"
    " notice notices notification alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager skip search".split()
)
#: Those of them that mark reader comments, which may be articles of their own (fixed values).
COMMENTS = frozenset("comment comments commentlist respond replies disqus".split())
#: First parts of names by which an article is a teaser of another one (fixed values).
TEASERS = frozenset("related recommended recommendations promo sponsored".split())
#: Parts of names that say how a thing is built, not what it is (fixed values).
STRUCTURE = frozenset("bar bars block box boxes button buttons container group icons inner item items link links list outer panel row section slot strip tools top bottom left right wrap wrapper".split())
#: Elements that can hold a list of comments (fixed values).
CONTAINERS = frozenset("div section ul ol li article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that close an open paragraph (fixed values).
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Start tags that close an open element of their own kind, up to the element that bounds them (fixed values).
CLOSES_OWN = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}

#: Template tokens, of 8 bytes each, that may be broadcast; beyond it pages are spread by salts.
BROADCAST_TOKENS = 2_000_000
SALTS = 64

#: Quotes hold a value only behind an equals sign; elsewhere, as in an apostrophe, they are characters like others.
_TAG = re.compile(r"""<!--|<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)>|<[!?][^>]*+>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_NAMES = re.compile(r"[^a-z0-9]+")


@dataclass
class Element:
    tag: str
    path: str
    outside: bool  # within a part that holds no main text
    article: bool  # within an article or main element
    loose: bool = False  # outside only by a part of a compound name, which an article or main element within resets
    story: bool = False  # within an article element
    commented: bool = False  # within a container whose name is one of comments by its first or last part


@dataclass
class Piece:
    """A piece of text: where it stands, and whether a block ends before it."""

    text: str
    element: Element
    breaks: bool


class Marks(NamedTuple):
    """What attributes say of an element."""

    marked: bool = False  # a whole name says that it is no main text
    part: bool = False  # a part of a compound name does
    built: bool = False  # a compound name does whose other parts say only how the thing is built, as in share-bar
    main: bool = False  # its role is main
    comments: bool = False  # a whole name says that it has reader comments
    commented: bool = False  # the first or last part of a compound name does
    teaser: bool = False  # a name begins like those of teasers


def _marks(attributes: str) -> Marks:
    marked = part = built = main = comments = commented = teaser = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden":
            marked = True
        elif name in ("class", "id", "role"):
            names = (values[0] or values[1] or values[2]).lower().split()
            main = main or name == "role" and "main" in names
            marked = marked or not MARKED.isdisjoint(names)
            comments = comments or not COMMENTS.isdisjoint(names)
            parts = [_NAMES.split(x) for x in names]
            part = part or any(not MARKED.isdisjoint(x) for x in parts)
            built = built or any(not MARKED.isdisjoint(x) and all(y in MARKED or y in STRUCTURE for y in x) for x in parts)
            commented = commented or any(x[0] in COMMENTS or x[-1] in COMMENTS for x in parts)
            teaser = teaser or any(x[0] in TEASERS for x in parts)
        elif name == "style" and "display:none" in "".join(values).replace(" ", "").lower():
            marked = True
    return Marks(marked, part, built, main, comments, commented, teaser)


NOTHING = Marks()


def read_page(page: str) -> tuple[list[str], list[Piece]]:
    """Tag tokens of a page in order (a path, closing ones with a slash), and its pieces of text."""
    root = Element("", "", False, False)
    last = max(page.rfind(">") + 1, page.rfind("<!--") + 4)  # no tag ends and no comment begins behind it, so none is looked for there
    stack = [root]
    tokens: list[str] = []
    pieces: list[Piece] = []
    breaks = True
    at = 0

    def text(to: int) -> None:
        nonlocal breaks
        if to > at:
            pieces.append(Piece(page[at:to], stack[-1], breaks))
            breaks = False

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            tokens.append("/" + stack.pop().path)

    while True:
        found = _TAG.search(page, at, max(at, last))
        if not found:
            text(len(page))
            break
        text(found.start())
        at = found.end()
        if found.group(0) == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        if not found.group(2):
            continue
        tag = found.group(2).lower()
        if tag not in INLINE:
            breaks = True
        if found.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in CLOSES_OWN:
            bounds = CLOSES_OWN[tag].split()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag or (tag in ("dt", "dd") and stack[k].tag in ("dt", "dd")):
                    close(k)
                    break
                if stack[k].tag in bounds:
                    break
        above = stack[-1]
        attributes = found.group(3)
        marks = _marks(attributes) if attributes else NOTHING
        main = marks.main or tag in ("article", "main")
        commented = above.commented or marks.commented and tag in CONTAINERS
        strict = above.outside and not above.loose
        outside = above.outside
        if tag in HEADINGS and above.article and above.tag == "header":
            strict = outside = False  # an article's own heading
        elif main:
            strict = strict or tag == "article" and (marks.comments or commented or marks.teaser)
            outside = strict
        elif tag not in ("html", "body"):
            # Within a story a part of a name says nothing alone: a search-results list or a share-price is of the text.
            strict = strict or tag in OUTSIDE or marks.marked or commented and not above.story
            outside = outside or strict or (marks.built if above.story else marks.part)
        element = Element(tag, f"{above.path}>{tag}", outside, above.article or main, outside and not strict, above.story or tag == "article", commented)
        tokens.append(element.path)
        if tag in VOID or attributes.endswith("/") and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if tag in ("textarea", "title") and end and end.start() > at:
                pieces.append(Piece(page[at : end.start()], element, True))
            at = end.end() if end else len(page)
            tokens.append("/" + element.path)
            breaks = True
            continue
        stack.append(element)
    close(1)
    return tokens, pieces


def token_hash(token: str) -> int:
    data = token.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 31 ^ zlib.crc32(data[::-1] + b"#")


def _clean(piece: str) -> str:
    return " ".join(html.unescape(piece).split())


#: What a sentence ends with, behind closing quotes and brackets (fixed values).
SENTENCE_ENDS = (".", "!", "?", "\u2026")


def _is_sentence(text: str) -> bool:
    """Four words or more, up to a full stop or the like."""
    return text.rstrip("\"'\u2019\u201d)").endswith(SENTENCE_ENDS) and text.count(" ") >= 3


def _of_template(piece: Piece, template: frozenset[int]) -> bool:
    """Whether a piece is a text token of the template, nested in an element of it; other pieces are in slots.

    That pages share a sentence inside their articles does not make it template: it may be what they tell.
    """
    path = piece.element.path
    if path and token_hash(path) not in template:
        return False
    text = _clean(piece.text)
    return token_hash(f"{path}|{text}") in template and not (piece.element.article and _is_sentence(text))


def _slots(pieces: list[Piece], template: frozenset[int]) -> list[Piece]:
    """Pieces that are not the template's; a line of an article with other text keeps its words whole."""
    lines: list[list[Piece]] = []
    for p in pieces:
        if p.breaks or not lines:
            lines.append([])
        lines[-1].append(p)
    out = []
    for line in lines:
        slots = [p for p in line if not _of_template(p, template)]
        out += line if line[0].element.article and any(p.text.strip() for p in slots) else slots
    return out


def main_text(page: str, template: frozenset[int] = frozenset()) -> str:
    """The slots of a page that hold main text, white space collapsed, in page order."""
    _, pieces = read_page(page)
    held = [p for p in pieces if not p.element.outside]
    if any(p.element.article and p.text.strip() for p in held):
        held = [p for p in held if p.element.article]
    if template:
        held = _slots(held, template)
    keep = {id(p) for p in held}
    parts: list[str] = []
    gap = False
    for p in pieces:
        gap = gap or p.breaks
        if id(p) in keep:
            if gap:
                parts.append(" ")
            parts.append(html.unescape(p.text))
            gap = False
    return " ".join("".join(parts).split())


# --- the template -------------------------------------------------------------------------------

_HOST = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


#: What is left out of a page's content, by which copies are told: parts that hold no main text, comments and tags.
_NO_CONTENT = r"(?is)<!--.*?-->|<(script|style|nav|header|footer|aside|form|noscript)\b.*?</\1\s*>|<[^>]*>"


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    url = pages[url_col].cast("string")
    host = F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))
    return pages.select(pages[id_col].cast("long").alias("page_id"), url.alias("url"), host.alias("host"), pages[html_col].cast("string").alias("html"))


def _beside(pages: DataFrame, known: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Pages with what is known of their keys.

    It goes to every task while it is small; beyond that each row is copied to so many salts and the
    pages of its keys are spread over them.
    """
    if size <= BROADCAST_TOKENS:
        return pages.join(F.broadcast(known), keys, "left")
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], "left")


def distinct_contents(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with the hash of their content and how many pages of the host share it; (host, of): distinct contents of a host."""
    content = F.regexp_replace(F.coalesce("html", F.lit("")), _NO_CONTENT, " ")
    keyed = pages.withColumn("content", F.xxhash64(F.trim(F.regexp_replace(content, r"\s+", " "))))
    counts = settle(keyed.groupBy("host", "content").agg(F.count(F.lit(1)).alias("copies")))
    copied = counts.where("copies > 1")
    found = _beside(keyed, copied, ["host", "content"], copied.count())
    return found.withColumn("copies", F.coalesce("copies", F.lit(1))), counts.groupBy("host").agg(F.count(F.lit(1)).alias("of"))


def tokens_by_host(pages: DataFrame) -> DataFrame:
    """(host, token, mate, vector, pages): each token's occurrence vector on a host, summed up; ``pages`` from ``distinct_contents``.

    Copies weigh as one page together. ``mate`` is the closing token of an opening one, null for others.
    """

    def make():
        def step(batch):
            found: dict[tuple[str, int], list] = {}
            for content, copies, host, page in zip(*(batch.column(c).to_pylist() for c in ("content", "copies", "host", "html")), strict=True):
                weight = content & 0xFFFFFFFFFFFF  # copies add it up alike for all their tokens
                tags, pieces = read_page(page or "")
                count: dict[int, int] = {}
                mates: dict[int, int | None] = {}
                for t in tags:
                    h = token_hash(t)
                    count[h] = count.get(h, 0) + 1
                    if h not in mates:
                        opens = t[0] == ">" and t.rpartition(">")[2] not in VOID
                        mates[h] = token_hash("/" + t) if opens else None
                for p in pieces:
                    if text := _clean(p.text):
                        h = token_hash(f"{p.element.path}|{text}")
                        count[h] = count.get(h, 0) + 1
                        mates[h] = None
                for h, n_here in count.items():
                    held = found.setdefault((host, h), [mates[h], 0, 0.0])
                    held[1] = (held[1] + weight * n_here) & 0xFFFFFFFFFFFF
                    held[2] += 1 / copies
            return {
                "host": [k[0] for k in found], "token": [k[1] for k in found], "mate": [v[0] for v in found.values()],
                "vector": [v[1] for v in found.values()], "pages": [v[2] for v in found.values()],
            }

        return step

    rows = map_batches(pages.select("content", "copies", "host", "html"), "host string, token long, mate long, vector long, pages double", make)
    # 48 bits a row: sums stay exact for 2**15 rows, then wrap alike for equal vectors under the mask.
    return rows.groupBy("host", "token").agg(
        F.max("mate").alias("mate"), F.sum(F.col("vector").cast("decimal(20,0)")).alias("vector"), F.round(F.sum("pages"), 6).alias("pages")
    ).withColumn("vector", F.pmod("vector", F.lit(1 << 48).cast("decimal(20,0)")).cast("long"))


def templates(pages: DataFrame, share: float = 0.5, least_pages: int = 3, least_class: int = 2) -> DataFrame:
    """(host, tokens): the template of each host that has one; ``pages`` as from ``_pages``.

    A valid class stands on ``share`` of the host's distinct contents and at least ``least_pages``, has
    ``least_class`` tokens, and its tags close where they open. As each token is on that share of the
    pages, a template is no longer than two average pages.
    """
    pages, sizes = distinct_contents(pages)
    tokens = tokens_by_host(pages)
    # Every page is read for this, so it is written once; three steps take it from there.
    frequent = settle(tokens.join(sizes, "host").where((F.col("pages") >= F.col("of") * share) & (F.col("pages") >= least_pages)))
    classes = frequent.groupBy("host", "vector", "pages").agg(F.collect_set("token").alias("tokens"), F.collect_set("mate").alias("mates"))
    valid = classes.where(F.size("tokens") >= least_class).select("host", F.explode("tokens").alias("token"))
    # Nesting: an opening tag whose closing tag is in no valid class is no template token.
    opened = frequent.select("host", "token", "mate")
    nested = valid.join(opened, ["host", "token"])
    closing = valid.select("host", F.col("token").alias("mate"), F.lit(True).alias("closes"))
    nested = nested.join(closing, ["host", "mate"], "left").where("mate is null or closes")
    return nested.groupBy("host").agg(F.collect_set("token").alias("tokens"))


def _beside_templates(read: DataFrame, known: DataFrame) -> DataFrame:
    """Pages with their host's template. Pages are not dealt by host, as one may have most of them."""
    tokens = known.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n")).first()["n"]
    return _beside(read, known, ["host"], tokens)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.5) -> DataFrame:
    """A row per page: page_id, url, host, text."""
    read = _pages(pages, id_col, url_col, html_col)
    found = _beside_templates(read, settle(templates(read, share)))

    def make():
        known: dict[str, tuple] = {}

        def step(batch):
            out = []
            for host, page, tokens in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "tokens")), strict=True):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = frozenset(tokens or ())
                out.append(main_text(page or "", known[host]))
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "host": batch.column("host"), "text": out}

        return step

    return map_batches(found.select("page_id", "url", "host", "html", "tokens"), "page_id long, url string, host string, text string", make)


def extract_digest(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
