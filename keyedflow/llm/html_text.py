"""Main text of web pages by equivalence-class template deduction.

A page is read as tokens: elements by their path, and blocks of text by path and text. Tokens
of a host whose numbers of occurrences are the same on all of its pages (equal occurrence
vectors) form an equivalence class. The class that every page has once is the skeleton of the
host's template; other classes are valid where they nest in it: every element's parent is part
of the template. What the template leaves open are its slots. Slots in menus, headers, footers,
sidebars, notices, adverts, forms and comments are dropped, as is text that is itself part of
the template; the remaining slots are extracted. In articles, and in classes other than the
skeleton, that is text whose element is of the same class, so that the element never holds
another: a paragraph like others that many pages share is main text. Pages keep all of their
text if they would have none, or lose most to classes other than the skeleton, or if such shared
paragraphs are most of what they have: these are copies of each other. Outside articles, slots that hold mostly links
are lists of links, and dropped on the pages where they do; headlines are not.

Vectors are never gathered: a vector is told by two sums of hashes of each page and its count,
to which a repeated page adds as often as it occurs, so a host with a third of all pages is counted like any other, before anything is shuffled.

Hosts with fewer than MIN_PAGES pages, pages without a host, and pages that lack their host's
region are read on their own, by the names of their elements.

Defined results: null or empty html has an empty text. Malformed markup is read as far as it
goes: what is not a tag is text. Repeated rows get equal texts. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyedflow.llm.common import BROADCAST_BYTES, store, table
from keyedflow.llm.url_rules import split_url

MIN_PAGES = 4
#: A token belongs to a template if this share of the host's pages has it.
SUPPORT = 0.5
#: Above this share of linked characters a slot is a list of links.
LINKED = 0.6

# Elements and names of parts that are not the main text.
DROPPED = set("head title script style noscript nav footer aside form button select textarea iframe svg template dialog menu object canvas".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert sidebar nav navbar navigation menu breadcrumb breadcrumbs masthead footer comment comments disqus reply replies respond share "
    "sharing social related recommended recommendations newsletter subscribe subscription signup popup modal overlay widget login "
    "search toolbar pagination pager hidden".split()
)
# Words that say nothing about what a part holds, beside the names above.
PLAIN = set(
    "area bar block box column container content inner item items left link links list main outer page panel post posts right section "
    "site slot top unit wrap wrapper bottom article articles story stories button buttons icon icons js block global form thread text".split()
)
ARTICLE = {"article", "main"}
HEADLINES = {"h1", "h2", "h3", "h4", "h5", "h6"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose start or end tag may be missing: a start closes these if they are open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_P_OPEN = INLINE | VOID

TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|"""
    r"""<(/?)([a-z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<[!?/][^>]*>""",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HREF = re.compile(r"\bhref\s*=", re.I)
NEXT_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
PART = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")


def _label(tag: str, attributes: str) -> str:
    names = []
    if "=" in attributes:
        for found in NAMED.finditer(attributes):
            names += DIGITS.sub("0", next(v for v in found.groups() if v is not None).lower()).split()
    return ".".join([tag, *sorted(set(names))]).replace("/", "")


def _dropped(label: str, inside_article: bool) -> bool:
    tag, _, names = label.partition(".")
    if tag in DROPPED:
        return True
    if tag in ("html", "body") or tag in ARTICLE:
        return False
    for name in names.split("."):
        # The whole name must tell: "share-buttons" does, "share-price" does not.
        telling = set(PART.findall(name)) - PLAIN
        if telling and telling <= NAMES or (not inside_article and (tag == "header" or "header" in telling)):
            return True
    return False


class Page:
    """A page's elements (path -> number) and blocks (path, text, linked characters, dropped)."""

    def __init__(self, markup: str):
        self.elements: Counter[str] = Counter()
        self.blocks: list[tuple[str, str, int, bool]] = []
        self._stack: list[tuple[str, str, bool, bool]] = []  # tag, path, dropped, inside an article
        self._text: list[str] = []
        self._linked = 0
        self._link, self._link_depth, self._link_ends = False, 0, True  # open, elements around it, has an end tag
        at = 0
        for found in TAG.finditer(markup):
            if found.start() > at:
                self._add(markup[at : found.start()])
            at = found.end()
            if found[3]:
                tag, closing = found[3].lower(), found[2] == "/"
                if tag == "a":
                    self._anchor(not closing and HREF.search(found[4]) is not None, markup, at)
                else:
                    self._tag(tag, closing, found[4])
        if at < len(markup):
            self._add(markup[at:])
        self._flush()

    def _anchor(self, link: bool, markup: str, at: int) -> None:
        """A link may hold blocks; one without an end tag ends with its block."""
        self._link, self._link_depth = link, len(self._stack)
        if link:
            following = NEXT_LINK.search(markup, at)
            self._link_ends = following is not None and following[1] == "/"

    def _add(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self._text.append(text)
        if self._link:
            self._linked += len(text.strip())

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                _, path, dropped, _ = self._stack[-1] if self._stack else ("", "", False, False)
                self.blocks.append((path, text, min(self._linked, len(text)), dropped))
            self._text, self._linked = [], 0
        self._link = self._link and self._link_ends

    def _close(self, i: int) -> None:
        del self._stack[i:]
        if i < self._link_depth:
            self._link = False

    def _pop(self, tags: set[str], stop: set[str] = frozenset()) -> None:
        """Close the last open element of ``tags`` and all within it, unless one of ``stop`` is nearer."""
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] in tags:
                self._close(i)
                return
            if self._stack[i][0] in stop:
                return

    def _tag(self, tag: str, closing: bool, attributes: str) -> None:
        if tag in INLINE:
            return
        self._flush()
        if closing:
            self._pop({tag})
            return
        if tag not in KEEPS_P_OPEN and self._stack and self._stack[-1][0] == "p":
            self._close(len(self._stack) - 1)
        if tag in CLOSES:
            self._pop(CLOSES[tag], {"ul", "ol", "dl", "table", "select"})
        if tag == "body":
            self._pop({"head"})
        if tag in VOID:
            return
        label = _label(tag, attributes)
        _, above, dropped, inside = self._stack[-1] if self._stack else ("", "", False, False)
        path = f"{above}/{label}"
        self.elements[path] += 1
        if not attributes.endswith("/") or tag in ("p", "div"):
            self._stack.append((tag, path, dropped or _dropped(label, inside), inside or tag in ARTICLE))


def _hash(path: str, text: str) -> str:
    return hashlib.md5(f"{path}\n{text}".encode("utf-8", "surrogatepass")).hexdigest()


def tokens(page: Page) -> Iterator[tuple[str, str, int, int, int, bool]]:
    """``(path, text hash or '', count, characters, linked characters, dropped)``."""
    chars, linked, texts, dropped = Counter(), Counter(), Counter(), {}
    for path, text, links, out in page.blocks:
        chars[path] += len(text)
        linked[path] += links
        texts[path, _hash(path, text)] += 1
        dropped[path] = out
    yield "", "", 1, chars[""], linked[""], False
    for path, count in page.elements.items():
        yield path, "", count, chars[path], linked[path], dropped.get(path, False)
    for (path, text), count in texts.items():
        yield path, text, count, 0, 0, dropped[path]


def _tag_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].partition(".")[0]


def _is_article(path: str) -> bool:
    return _tag_of(path) in ARTICLE


def _within(path: str, regions: list[str]) -> bool:
    return any(path == r or path.startswith(r + "/") for r in regions)


def _in_headline(path: str) -> bool:
    return any(part.partition(".")[0] in HEADLINES for part in path.split("/"))


def deduce(found: pd.DataFrame) -> dict:
    """A host's template from its supported tokens: region, link lists, and fixed texts."""
    skeleton = found.loc[(found["path"] == "") & (found["text"] == ""), "vector"].iloc[0]
    elements = found[found["text"] == ""]
    by_vector = {vector: set(group["path"]) for vector, group in elements.groupby("vector")}
    # The skeleton first; then classes nest where the parents of all their elements are known.
    template = set(by_vector.pop(skeleton))
    grown = True
    while grown:
        grown = False
        for vector, paths in list(by_vector.items()):
            if all(p.rsplit("/", 1)[0] in template | paths for p in paths):
                template |= by_vector.pop(vector)
                grown = True
    slots = elements[elements["path"].isin(template) & (elements["chars"] > 0) & ~elements["dropped"]]
    region = sorted(p for p in template if _is_article(p))
    articles = [p for p in region if not any(r.startswith(p + "/") for r in region)]
    lists = slots[slots["linked"] > LINKED * slots["chars"]]["path"]
    lists = [p for p in lists if not _within(p, articles) and not _in_headline(p)]
    slots = slots[~slots["path"].isin(lists)]
    region = [p for p in region if any(_within(s, [p]) for s in slots["path"])]
    # Text of the template: of the class that its element has, and all of the skeleton outside articles.
    texts = found[found["text"] != ""]
    whole = texts["path"].map(dict(zip(elements["path"], elements["vector"]))) == texts["vector"]
    fixed = texts[(texts["vector"] == skeleton) & (whole | (not region))]["text"]
    copied = texts[(texts["vector"] == skeleton) & ~texts["text"].isin(fixed)]["text"]
    shared = texts[(texts["vector"] != skeleton) & whole & texts["path"].isin(template) & (texts["pages"] >= MIN_PAGES)]["text"]
    if not region:
        # The smallest container that has most of what the slots hold.
        total, best = slots["chars"].sum(), ""
        for path in sorted(template, key=len):
            inside = slots["path"].eq(path) | slots["path"].str.startswith(path + "/")
            if total and slots.loc[inside, "chars"].sum() > 0.8 * total and path.startswith(best) and not path.endswith("/p"):
                best = path
        region = [best] if best else []
    return {"region": region, "lists": sorted(lists), "fixed": sorted(fixed), "copied": sorted(copied), "shared": sorted(shared)}


def _without(blocks: list[tuple[str, str]], texts: set[str], least: float) -> list[tuple[str, str]]:
    """The blocks that are not in ``texts``; all, if no more than a share ``least`` would be left."""
    own = [(p, t) for p, t in blocks if _hash(p, t) not in texts] if texts else blocks
    return own if sum(len(t) for _, t in own) > least * sum(len(t) for _, t in blocks) else blocks


def main_text(page: Page, template: dict | None) -> str:
    kept = [(path, text) for path, text, _, dropped in page.blocks if not dropped]
    if template:
        held = dict.fromkeys(template["lists"], 0.0)
        for path, text, linked, _ in page.blocks:
            if path in held:
                held[path] += linked - LINKED * len(text)
        kept = [(p, t) for p, t in kept if held.get(p, 0.0) <= 0]
    regions = [r for r in (template or {}).get("region", []) if r in page.elements] or [p for p in page.elements if _is_article(p)]
    if regions:
        kept = [(p, t) for p, t in kept if _within(p, regions)] or kept
    if template:
        own, copied = _without(kept, set(template["fixed"]), 0), set(template["copied"])
        if 2 * sum(len(t) for p, t in own if copied and _hash(p, t) in copied) <= sum(len(t) for _, t in own):
            kept = own
        kept = _without(kept, set(template["shared"]), 0.5)
    return " ".join(t for _, t in kept)


def templates(pages: DataFrame) -> DataFrame:
    """``host, template`` (JSON) of every host with enough pages; ``pages`` has host, page, html."""
    schema = "host string, page long, path string, text string, count long, chars long, linked long, dropped boolean"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(host, page, *t) for host, page, markup in zip(batch["host"], batch["page"], batch["html"]) for t in tokens(Page(markup))]
            yield pd.DataFrame(rows, columns=["host", "page", "path", "text", "count", "chars", "linked", "dropped"])

    found = pages.where("host <> ''").select("host", "page", "html").mapInPandas(read, schema)
    # Sums of 29 bits hold for 10 billion pages of one host.
    vector = F.concat_ws(":", *[F.sum(F.pmod(F.xxhash64("page", "count", F.lit(i)), F.lit(1 << 29))) for i in (0, 1)])
    vectors = found.groupBy("host", "path", "text").agg(
        F.count(F.lit(1)).alias("pages"), vector.alias("vector"),
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.max("dropped").alias("dropped"),
    )
    vectors = store(vectors.where("text = '' or pages > 1"))
    hosts = vectors.where("path = '' and text = ''").select("host", F.col("pages").alias("host_pages"))
    # A supported token is on half of the pages, so there are at most twice as many as a page has.
    supported = vectors.join(hosts.where(F.col("host_pages") >= MIN_PAGES), "host").where(F.col("pages") >= F.col("host_pages") * SUPPORT)

    def deduced(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [group["host"].iloc[0]], "template": [json.dumps(deduce(group))]})

    return store(supported.groupBy("host").applyInPandas(deduced, "host string, template string"))


def extract(df: DataFrame) -> DataFrame:
    """page_id, url, text for every row of ``df`` (page_id, url, html)."""
    pages = split_url(df.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))).drop("path")
    known = templates(pages.withColumn("page", F.xxhash64("page_id", "url", "html")))
    size = known.agg(F.sum(F.octet_length("template"))).first()[0] or 0
    joined = pages.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host", "left")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, dict] = {}
        for batch in batches:
            out = []
            for markup, template in zip(batch["html"].to_pylist(), batch["template"].to_pylist()):
                own = None
                if template is not None:
                    if template not in parsed:
                        if len(parsed) >= 10_000:
                            parsed.clear()
                        parsed[template] = json.loads(template)
                    own = parsed[template]
                out.append(main_text(Page(markup), own))
            columns = [batch["page_id"], batch["url"], pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text"])

    kind = df.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "template").mapInArrow(extracted, f"page_id {kind}, url string, text string")


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html")).withColumn("n_chars", F.char_length("text").cast("long"))
