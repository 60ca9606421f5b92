"""Main text of web pages by template deduction.

1. A page is read into tokens: its tags (with the path of open tags) and its text pieces. A token's
   occurrence vector says how often each page of the host has it; for a text piece inside an article,
   how often each distinct article has it. Articles are told apart by their longest piece, so pages
   that repeat an article count once.
2. Tokens of a host with the same vector are one equivalence class. Vectors are never built: a
   grouped sum and exclusive or over (page, count) hashes identify them, so a host with a third
   of all pages is one row per token after the map-side combine.
3. Classes that are on at least half of a host's pages (inside articles: of its distinct articles),
   and on at least MIN_PAGES, make its template.
   A class is valid on a page if its tokens stand there in the template's order; a class with
   larger counts is nested in the slots between the tokens of one with smaller counts.
4. What is left between the tokens of valid classes are the slots. Slots inside menus, headers,
   footers, sidebars, notices, adverts, forms and reader comments (told by the template's tags) are
   dropped; if the page has an article, its slots are the text, else the remaining slots of the page.

An article whose fixed pieces hold more than half of its characters is itself a repeat (a near copy of
others, not text between boilerplate) and stays whole. A host with fewer than MIN_PAGES pages has a
template of tags only, one with fewer distinct articles has none inside them.

Cases: a null or empty html gives an empty text; a null or odd url has no host and no template;
repeated pages give equal texts; broken markup (unclosed tags, quotes, comments) is read to its
end; empty tables give empty results; extra columns pass through ``extract``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterline.llm.common import fresh, query, small_batches, table
from quarterline.session import stored

MIN_PAGES = 3
MIN_SHARE = 0.5
#: Tokens of all templates together that may be broadcast; with more, pages are shuffled by host.
MAX_BROADCAST = 1_000_000

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+[^>]*+)>?""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_SPACE = re.compile(r"\s+")

RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])|</{t}\Z", re.I) for t in RAW}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr br".split())
NOISE_TAGS = set("nav footer aside form button select option dialog menu object svg math canvas audio video head fieldset".split())
#: A tag of this kind is noise unless it holds an article.
SOFT_TAGS = {"form", "header", "fieldset"}
NOISE_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "cookie cookies consent gdpr notice notices alert popup modal overlay promo promotion sponsor sponsored comment comments commentlist "
    "reply replies respond disqus share sharing social related recommended newsletter subscribe subscription widget pagination pager "
    "toolbar masthead topbar login signup search skip".split()
)
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu"}
#: An opening tag closes these if they are open and not outside the stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
OTHER, MAIN, ARTICLE = 0, 1, 2
#: Kinds of tokens: tags, text, text inside an article; and the mark of an article itself.
TAG, TEXT, INSIDE, WHOLE = 0, 1, 2, 3


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def _is_noise(tag: str, attributes: dict[str, str]) -> bool:
    if tag in NOISE_TAGS or tag == "header":
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role") in NOISE_ROLES:
        return True
    if "display:none" in attributes.get("style", "").replace(" ", ""):
        return True
    if tag in ("html", "body"):
        return False
    return not NOISE_NAMES.isdisjoint(re.split(r"[^a-z0-9]+", attributes.get("class", "") + " " + attributes.get("id", "")))


class Reader:
    """One pass over a page: ``blocks`` (text, zone, noise, token) and ``tokens`` (hash, kind)."""

    def __init__(self, html: str, with_tokens: bool):
        self.blocks: list[tuple[str, int, bool, int]] = []
        self.tokens: list[tuple[int, int]] = []
        self.with_tokens = with_tokens
        self.stack: list[tuple[str, int, bool, bool, int]] = []  # tag, zone, noise, can be lifted, path hash
        self.piece: list[str] = []
        self._read(html)

    def _state(self) -> tuple[int, bool, int]:
        return (self.stack[-1][1], self.stack[-1][2], self.stack[-1][4]) if self.stack else (OTHER, False, 0)

    def _flush(self) -> None:
        if self.piece:
            text = _SPACE.sub(" ", unescape("".join(self.piece))).strip()
            self.piece.clear()
            if text:
                zone, noise, path = self._state()
                inside = zone == ARTICLE
                token = 0
                if self.with_tokens and not (inside and noise):
                    token = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), (path + inside) & 0xFFFFFFFF) >> 1
                    self.tokens.append((token, INSIDE if inside else TEXT))
                self.blocks.append((text, zone, noise, token))

    def _pop_to(self, names: set[str], stops: set[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                del self.stack[i:]
                return
            if self.stack[i][0] in stops:
                return

    def _open(self, tag: str, raw: str) -> None:
        if tag not in INLINE:
            self._flush()
            self._pop_to({"p"}, {"td", "th", "button", "table", "article", "section", "div", "body"})
        if tag in CLOSES:
            self._pop_to(*CLOSES[tag])
        attributes = _attributes(raw)
        zone, noise, path = self._state()
        own = _is_noise(tag, attributes)
        role = attributes.get("role")
        if tag == "article" or attributes.get("itemprop") == "articlebody":
            new = ARTICLE
        elif tag == "main" or role == "main":
            new = MAIN
        else:
            new = OTHER
        lifted = bool(self.stack) and self.stack[-1][3]
        if new > zone and noise and lifted and not own:
            noise = False  # a wrapper whose name sounds like noise holds the article
        if tag == "header" and zone == ARTICLE:
            own = False  # the article's own heading
        soft = tag in SOFT_TAGS or tag not in NOISE_TAGS
        lift = (lifted or not noise) and (soft or not own)
        if self.with_tokens:
            path = xxhash.xxh64_intdigest(f"{tag}.{attributes.get('class', '')}#{attributes.get('id', '')}".encode("utf-8", "surrogatepass"), path & 0xFFFFFFFFFFFFFFFF) >> 1
            if tag not in INLINE:
                self.tokens.append((path, TAG))
        if tag not in VOID:
            self.stack.append((tag, max(zone, new), noise or own, lift, path))

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    self._leave(i)
                    return
                if self.stack[i][0] not in INLINE:
                    return
            return
        self._flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if self.stack[i][0] in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "article", "body", "html", "main"):
                return

    def _leave(self, i: int) -> None:
        if self.stack[i][2] != (self.stack[i - 1][2] if i else False):
            self._flush()  # an inline element that is noise ends
        del self.stack[i:]

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                self.piece.append(html[at:])
                break
            if m.start() > at:
                self.piece.append(html[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    self.piece.append(m[0][9:].removesuffix("]]>"))
                continue
            tag = name.lower()
            if m[1]:
                self._close(tag)
            elif tag == "br":
                self.piece.append(" ")
            elif tag in RAW:
                end = _RAW_END[tag].search(html, at)
                close = html.find(">", end.end()) if end else -1
                at = close + 1 if close >= 0 else n
            else:
                if tag in INLINE and tag not in VOID and _is_noise(tag, _attributes(m[3])) and not self._state()[1]:
                    self._flush()
                self._open(tag, m[3])
        self._flush()


def page_tokens(html: str | None) -> list[tuple[int, int, int, int]]:
    """(token, kind, count, first place) of a page; one of kind WHOLE names the article by its longest piece."""
    page = Reader(html or "", True)
    counts, first = Counter(t for t, _ in page.tokens), {}
    for i, (t, kind) in enumerate(page.tokens):
        first.setdefault(t, (kind, i))
    out = [(t, first[t][0], c, first[t][1]) for t, c in counts.items()]
    article = [b[0] for b in page.blocks if b[1] == ARTICLE and not b[2]]
    if article:
        longest = max(article, key=lambda t: (len(t), t))
        out.append((xxhash.xxh64_intdigest(longest.encode("utf-8", "surrogatepass")) >> 1, WHOLE, 1, 0))
    return out


def main_text(html: str | None, classes: list[list[int]]) -> str:
    """The text of a page's slots, given the fixed text tokens and tags of its host by class."""
    if not html:
        return ""
    page = Reader(html, bool(classes))
    zones = {b[1] for b in page.blocks if not b[2]}
    place: dict[int, int] = {}
    for i, (t, _) in enumerate(page.tokens):
        place.setdefault(t, i)
    fixed_tokens: set[int] = set()
    for tokens in classes:
        places = [place.get(t, -1) for t in tokens]
        if -1 not in places and places == sorted(places):  # valid on this page
            fixed_tokens.update(tokens)
    wanted = max(zones, default=OTHER)
    blocks = [(t, token in fixed_tokens) for t, zone, noise, token in page.blocks if zone == wanted and not noise]
    if wanted == ARTICLE and 2 * sum(len(t) for t, fixed in blocks if fixed) > sum(len(t) for t, _ in blocks):
        return "\n\n".join(t for t, _ in blocks)  # the article itself is a repeat
    return "\n\n".join(t for t, fixed in blocks if not fixed)


def host_of(url) -> F.Column:
    """The host in lower case; an empty string for a null or odd url."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """``host, classes`` of columns ``host, html``: per host its classes, each in page order.

    Classes stand in nesting order: those with the smallest counts first.
    """

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for host, html in zip(rows["host"], rows["html"]):
                page = xxhash.xxh64_intdigest((html or "").encode("utf-8", "surrogatepass"))
                found = page_tokens(html)
                article = next((t for t, kind, _, _ in found if kind == WHOLE), 0)
                for token, kind, count, place in found:
                    at = xxhash.xxh64_intdigest(str(count).encode(), page) >> 1 if kind < INSIDE else 0
                    out.append((host, 0 if kind == WHOLE else token, kind, article if kind >= INSIDE else 0, at, count, place))
            yield pd.DataFrame(out, columns=["host", "token", "kind", "article", "at", "count", "place"])

    named = pages.where("host != ''")
    rows = named.mapInPandas(tokens, "host string, token long, kind int, article long, at long, count int, place long")
    low = lambda x: F.col(x).bitwiseAND(0xFFFFFFFF)
    # Pages that repeat an article become one; of the other tokens, all rows are summed at once.
    found = rows.groupBy("host", "token", "kind", "article").agg(
        F.bit_xor("at").alias("x"), F.sum(low("at")).alias("s"), F.count("*").alias("pages"), F.sum("count").alias("total"), F.avg("place").alias("place"),
    )
    inside = F.col("kind") >= INSIDE
    once = lambda x, y: F.when(inside, x).otherwise(F.col(y)).alias(y)
    each = F.floor(F.col("total") / F.col("pages"))
    named_by = F.shiftrightunsigned(F.xxhash64("article", each), 1)
    found = found.select("host", "token", "kind", "place", once(named_by, "x"), once(named_by.bitwiseAND(0xFFFFFFFF), "s"), once(F.lit(1), "pages"), once(each, "total"))
    found = found.groupBy("host", "token", "kind").agg(
        F.bit_xor("x").alias("x"), F.sum("s").alias("s"), F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.avg("place").alias("place"),
    )
    seen = named.groupBy("host").agg(F.count("*").alias("of"))
    found = stored(found.where(F.col("pages") >= MIN_PAGES))  # two reads, one parse
    articles = found.where(F.col("kind") == WHOLE).select("host", F.col("pages").alias("articles"))
    enough = F.col("pages") >= MIN_SHARE * F.when(F.col("kind") == INSIDE, F.col("articles")).otherwise(F.col("of"))
    often = found.where(F.col("kind") != WHOLE).join(seen, "host").join(articles, "host", "left").where(enough)
    often = often.withColumn("text", F.col("kind") != TAG)
    classes = often.groupBy("host", "x", "s", "pages").agg(
        F.sort_array(F.collect_list(F.struct("place", "token"))).alias("tokens"), F.max("text").alias("fixed"), F.sum("total").alias("total"),
    )
    # Only classes with fixed text take text away from the slots.
    classes = classes.where("fixed").select("host", F.struct((F.col("total") / F.col("pages")).alias("size"), F.expr("transform(tokens, t -> t.token)").alias("tokens")).alias("c"))
    return classes.groupBy("host").agg(F.expr("transform(sort_array(collect_list(c)), c -> c.tokens)").alias("classes"))


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> tuple[DataFrame, str]:
    """``pages`` with one more column (its name is returned): the main text."""
    small_batches(pages.sparkSession, 500)
    host, of, classes, out = fresh(pages, "host", "of", "classes", "main")
    hosted = pages.withColumn(host, host_of(F.col(f"`{url}`")))
    found = templates(hosted.select(F.col(host).alias("host"), F.col(f"`{html}`").alias("html")))
    found = stored(found).withColumnsRenamed({"host": of, "classes": classes})
    size = found.agg(F.sum(F.size(F.flatten(classes)) + F.lit(1))).first()[0] or 0
    found = F.broadcast(found) if size <= MAX_BROADCAST else found
    joined = hosted.join(found, F.col(host) == F.col(of), "left")

    def texts(pages_: pd.Series, classes_: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, [list(x) for x in c] if c is not None else []) for h, c in zip(pages_, classes_)], dtype=object)

    done = joined.withColumn(out, F.pandas_udf(texts, T.StringType()).asNondeterministic()(F.col(f"`{html}`"), F.col(classes)))
    return done.select(*[F.col(f"`{c}`") for c in pages.columns], out), out


@query("op6_html_extraction")
def op6_html_extraction(spark, sf_dir):
    done, text = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", F.col(text).alias("text"), F.length(text).cast("long").alias("n_chars"))
