"""Pages of markup as tables: page facts, links, text blocks, sentences and regions.

One pass per page builds a small element tree (unclosed paragraphs and list items close by themselves, scripts and styles
are skipped); everything else follows from it. Pages come in Arrow batches, and the result is one row per page with nested
arrays, which ``links_of``, ``blocks_of`` and ``sentences_of`` unfold in the JVM.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import url_skeleton
from ..shared import stored
from .reports import cluster_confidence

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(("script", "style", "noscript", "template"))
#: An opening tag closes an open element of these tags first, within the nearest of the fences.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = frozenset((*HEADINGS, "p", "li", "dt", "dd", "blockquote", "figcaption"))
STRUCTURAL = frozenset("html body main header nav section article aside footer div form ul ol li".split())


@dataclass(frozen=True)
class Limits:
    """Bounds of what is read of one page; None: all of it, which is the default everywhere."""

    raw: int | None = None
    blocks: int | None = None
    sentences: int | None = None
    in_block: int | None = None
    block_text: int | None = None
    sentence_text: int | None = None
    link_text: int | None = None
    title: int | None = None
    heading: int | None = None


EXACT = Limits()
# The bounds of a crawler that keeps pages small.
CRAWLER = Limits(180, 120, 250, 6, 900, 420, 2000, 220, 180)
# Roles in order, with the tags, aria roles and words of class, id or label that give them.
ROLES = (
    ("footer", ("footer",), ("contentinfo",), ("footer",)),
    ("breadcrumb", (), (), ("breadcrumb",)),
    ("sidebar", ("aside",), ("complementary",), ("sidebar", "rail", "aside")),
    ("table_of_contents", (), (), ("table of contents", "toc", "contents", "jump links")),
    ("faq", (), (), ("faq", "questions", "accordion")),
    ("comparison", (), (), ("comparison", "compare", "versus", "vs")),
    ("product_grid", (), (), ("product grid", "product list", "products", "catalog", "collection grid")),
    ("tool", (), (), ("calculator", "estimator", "configurator", "tool", "widget")),
    ("form", ("form",), (), ("form", "newsletter", "signup", "sign up")),
    ("related_content", (), (), ("related", "recommended", "similar", "popular")),
    ("cta", (), (), ("cta", "call to action", "get started", "book demo", "request quote", "contact sales")),
    ("header", ("header",), ("banner",), ("header",)),
    ("hero", (), (), ("hero", "masthead", "intro", "eyebrow")),
    ("navigation", ("nav",), ("navigation",), ("navigation", "nav", "menu")),
    ("main", ("main", "body"), ("main",), ()),
    ("section", ("section", "article"), (), ()),
)
REGION_TAGS = frozenset("body header nav main aside footer section article form".split())
REGION_ARIA = frozenset("navigation banner main contentinfo complementary".split())
REGION_WORDS = ("breadcrumb", "hero", "faq", "sidebar", "related", "toc", "contents", "comparison", "product", "cta", "tool")
# Prominence of blocks and what regions add to it.
PROMINENCE = {"h1": 1.0, "h2": 0.9, "h3": 0.82, "h4": 0.74, "h5": 0.68, "h6": 0.68, "blockquote": 0.6, "p": 0.56, "li": 0.46}
PROMINENT_REGION = {"hero": 0.14, "cta": 0.08, "header": 0.08, "faq": 0.04, "comparison": 0.04, "tool": 0.04, "footer": -0.1, "related_content": -0.1, "sidebar": -0.06, "navigation": -0.06, "table_of_contents": -0.06}
BOILERPLATE_REGION = dict.fromkeys(("navigation", "footer", "sidebar", "table_of_contents", "related_content"), 0.42) | dict.fromkeys(("cta", "header", "breadcrumb"), 0.18)
BOILERPLATE_WORDS = re.compile(r"\b(table of contents|subscribe|newsletter|privacy policy|cookie|related posts|read more|contact us|terms|share this)\b")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9\"'])")


class Element:
    __slots__ = ("attrs", "children", "index", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []
        self.index = 1 + sum(isinstance(c, Element) and c.tag == tag for c in parent.children) if parent else 1

    def walk(self) -> Iterator[Element]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Element)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return tidy(" ".join(out) if self.tag in ("body", "main", "article", "html") else "".join(out))

    def above(self) -> Iterator[Element]:
        node = self
        while node is not None:
            yield node
            node = node.parent


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#page", {}, None)
        self.skipping = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SKIPPED:
            self.skipping += 1
        if self.skipping:
            return
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, {"button", "td", "th", "li", "div", "section", "article"})
        if tag in CLOSES and tag != "p":
            self._close(CLOSES[tag], FENCES.get(tag, set()))
        node = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag in SKIPPED:
            if not self.skipping and tag in VOID:
                self.at.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))
        else:
            self.handle_starttag(tag, attrs)

    def _close(self, tags: set[str], fences: set[str]) -> None:
        for node in self.at.above():
            if node.tag in tags:
                self.at = node.parent
                return
            if node.tag in fences:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skipping = max(0, self.skipping - 1)
            return
        if self.skipping:
            return
        for node in self.at.above():
            if node.tag == tag and node.parent is not None:
                self.at = node.parent
                return

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.at.children.append(data)


def parsed(html: str) -> Element:
    builder = Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def tidy(x: str, most: int | None = None) -> str:
    x = " ".join(x.split())
    return x if most is None or len(x) <= most else x[: most - 1].rstrip() + "…"


def digest(x: str) -> str:
    return hashlib.sha1(x.lower().encode()).hexdigest()


def between(x: float) -> float:
    return max(0.0, min(1.0, x))


def role_of(node: Element) -> str:
    get = node.attrs.get
    aria = get("role", "").lower()
    signal = " ".join([node.tag, aria, *(get(k, "").lower() for k in ("id", "class", "aria-label", "data-region"))])
    words = set(re.split(r"[^a-z0-9]+", signal))
    for role, tags, arias, hints in ROLES:
        if node.tag in tags or aria in arias or any(all(w in words for w in h.split()) if " " in h else h in signal for h in hints):
            return role
    return "unknown"


def is_region(node: Element) -> bool:
    named = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()
    return node.tag in REGION_TAGS or node.attrs.get("role", "").lower() in REGION_ARIA or any(w in named for w in REGION_WORDS)


def selector_word(x: str) -> str:
    return re.sub(r"[^a-z0-9_-]+", "-", x.strip().lower()).strip("-")


def dom_path(node: Element) -> str:
    parts = []
    for n in node.above():
        if n.tag in STRUCTURAL:
            own = selector_word(n.attrs.get("id", ""))
            parts.append(f"{n.tag}#{own}" if own else f"{n.tag}:nth-of-type({n.index})")
    return " > ".join(reversed(parts))


def selector(node: Element) -> str:
    own = selector_word(node.attrs.get("id", ""))
    classes = [c for c in map(selector_word, node.attrs.get("class", "").split()) if c][:2]
    return node.tag + (f"#{own}" if own else "") + "".join(f".{c}" for c in classes)


def sentences(text: str, most: int | None = None) -> list[str]:
    found = [tidy(s, most) for s in SENTENCE_END.split(tidy(text))]
    return [s for s in found if len(s) >= 55 and len(s.split()) >= 8]


def boilerplate(role: str, text: str, link_density: float, repeats: int) -> float:
    score = BOILERPLATE_REGION.get(role, 0.0) + (min(0.32, 0.14 * (repeats - 1)) if repeats > 1 else 0.0)
    score += 0.26 if link_density > 0.45 else 0.16 if link_density > 0.28 else 0.0
    score += 0.22 if BOILERPLATE_WORDS.search(text.lower()) else 0.0
    return between(score + (0.08 if len(text.split()) < 12 else 0.0))


# Words of classes that tell a page's structure, and of calls to action.
CLASS_HINTS = frozenset(("article", "card", "content", "cta", "faq", "feature", "footer", "form", "grid", "header", "hero", "list", "main", "menu", "nav", "post", "pricing", "product", "review", "section", "sidebar", "table", "testimonial", "tool"))
CTA_WORDS = ("buy", "consultation", "demo", "quote", "start", "trial")
STRUCTURED = re.compile(r'"@type"\s*:\s*"([A-Za-z]+)"')
PRICE = re.compile(r"[$€£]\s?\d")
WORD = re.compile(r"[a-z0-9]+")


def bucket_of(n: int) -> str:
    return "0" if n <= 0 else "1" if n == 1 else "2-3" if n <= 3 else "4-8" if n <= 8 else "9-16" if n <= 16 else "17+"


def structure(node: Element) -> str:
    """Tag, aria role, depth, children, text and class words of a node, as a token."""
    depth = sum(1 for _ in node.above()) - 1
    children = sum(isinstance(c, Element) for c in node.children)
    hints = sorted(set(WORD.findall(node.attrs.get("class", "").lower())) & CLASS_HINTS)
    own = len(tidy("".join(c for c in node.children if isinstance(c, str))))
    return f"{node.tag}:{node.attrs.get('role', '').lower() or '-'}:d{bucket_of(depth)}:c{bucket_of(children)}:t{bucket_of(own)}:{'+'.join(hints[:2]) or '-'}"


def page_snapshot(url: str | None, html: str | None, limits: Limits = EXACT) -> dict:
    """Everything about one page; a null or broken page gives empty parts."""
    root = parsed(html or "")
    nodes = list(root.walk())
    by_tag: dict[str, list[Element]] = {}
    for n in nodes:
        by_tag.setdefault(n.tag, []).append(n)
    first = lambda tag: by_tag[tag][0].text() if tag in by_tag else None
    meta = {n.attrs.get("name", "").lower(): n.attrs.get("content", "") for n in reversed(by_tag.get("meta", []))}
    canonical = next((n.attrs.get("href") for n in by_tag.get("link", []) if n.attrs.get("rel", "").lower() == "canonical"), None)
    body = by_tag["body"][0] if "body" in by_tag else root
    regions = {id(n): role_of(n) for n in nodes if is_region(n)}
    near = lambda node: next(((i, n) for i, n in enumerate(node.above()) if id(n) in regions), (0, body))[1]
    role = lambda node: regions.get(id(near(node)), "main")
    text = body.text()
    structured = sorted({x.lower() for x in STRUCTURED.findall(html or "")})
    linked = Counter(id(near(a)) for a in by_tag.get("a", []))
    called = set(WORD.findall(" ".join(n.text() for t in ("a", "button") for n in by_tag.get(t, [])).lower()))
    parts = text_parts(nodes, role, tidy(first("h1") or "", limits.heading), limits)
    return {
        "title": tidy(first("title") or "", limits.title) or None,
        "meta_description": tidy(meta.get("description", "")) or None,
        "canonical_url": urljoin(url or "", canonical) if canonical else None,
        "noindex": "noindex" in meta.get("robots", "").lower(),
        "language": next((n.attrs.get("lang") for n in by_tag.get("html", [])), None),
        "h1_text": first("h1"),
        "h1_count": len(by_tag.get("h1", [])),
        "h2_count": len(by_tag.get("h2", [])),
        "word_count": len(text.split()),
        "structured_types": structured,
        "has_price": bool(PRICE.search(text)),
        "has_ratings": "aggregaterating" in structured or "review" in structured,
        "calls": sorted(called.intersection(CTA_WORDS)),
        "dom": [*(structure(n) for n in nodes if n.tag in STRUCTURAL), *(f"block:{b['block_type']}:{b['role']}" for b in parts["blocks"])],
        "region_links": [f"{regions[id(n)]}:links{bucket_of(linked[id(n)])}" for n in nodes if id(n) in regions],
        "links": links(url or "", by_tag.get("a", []), role),
        "regions": [{"role": r, "dom_path": p} for r, p in dict.fromkeys((regions[id(n)], dom_path(n)) for n in nodes if id(n) in regions)],
        **parts,
    }


def links(url: str, anchors: list[Element], role) -> list[dict]:  # noqa: ANN001
    """Web links; ``internal`` ones stay on the page's host, with or without www."""
    bare = lambda host: (host or "").lower().removeprefix("www.")
    out = []
    for n in anchors:
        href = n.attrs.get("href", "").strip()
        if not href or href.startswith("#"):
            continue
        try:
            target = urljoin(url, href)
            parts = urlsplit(target)
            own = urlsplit(url).hostname
            host = parts.hostname
        except ValueError:
            continue
        if parts.scheme in ("http", "https") and host:
            block = next((p.tag for p in n.above() if p.tag in BLOCKS), "a")
            out.append({"to_url": target, "internal": bare(host) == bare(own), "anchor": tidy(n.text(), 180), "role": role(n), "block_type": block})
    return out


def text_parts(nodes: list[Element], role, page_heading: str, limits: Limits = EXACT) -> dict:  # noqa: ANN001
    raw, chain, chain_role = [], [page_heading or None] + [None] * 5, None
    for n in nodes:
        if n.tag not in BLOCKS:
            continue
        text = tidy(n.text(), limits.block_text)
        if not text:
            continue
        where = role(n)
        if where != chain_role:  # another kind of region begins its own chain under the page's heading
            keep = chain if where in ("section", "main", "comparison", "faq", "product_grid", "tool", "form") else [None] * 6
            chain, chain_role = [None if where in ("header", "navigation", "breadcrumb", "footer") else page_heading or None, *keep[1:]], where
        if n.tag in HEADINGS:
            level = int(n.tag[1])
            chain = [*chain[: level - 1], text, *[None] * (6 - level)]
        words = len(text.split())
        if (len(text) < 4 if n.tag in HEADINGS else len(text) < 35 or words < 6) or (limits.raw is not None and len(raw) >= limits.raw):
            continue
        linked = tidy("".join(a.text() for a in n.walk() if a.tag == "a"), limits.link_text)
        headings = [tidy(x, limits.heading) for x in chain if x]
        children = max(1, sum(isinstance(c, Element) for c in n.children))
        key = digest("|".join([where, dom_path(n).lower(), selector(n), " > ".join(headings).lower()]))[:20]
        raw.append({"block_key": f"blk_{key}", "block_type": n.tag, "role": where, "dom_path": dom_path(n), "headings": headings, "text": text, "text_hash": digest(text), "link_density": between(len(linked) / len(text)), "text_density": between(words / max(12, 10 * children)), "prominence": between(PROMINENCE.get(n.tag, 0.5) + PROMINENT_REGION.get(where, 0.0))})
    repeats = Counter(b["text_hash"] for b in raw)
    blocks = [b | {"block": i, "boilerplate": boilerplate(b["role"], b["text"], b["link_density"], repeats[b["text_hash"]])} for i, b in enumerate(raw[: limits.blocks])]
    found, seen = [], set()
    for b in blocks:
        if b["boilerplate"] >= 0.78 or b["text_density"] < 0.18:
            continue
        for i, s in enumerate(sentences(b["text"], limits.sentence_text)[: limits.in_block]):
            if (limits.sentences is None or len(found) < limits.sentences) and (h := digest(s)) not in seen:
                seen.add(h)
                found.append({"block": b["block"], "block_key": b["block_key"], "place": i, "sentence": s, "text_hash": h, "role": b["role"], "link_density": b["link_density"], "boilerplate": b["boilerplate"]})
    return {"blocks": blocks, "sentences": found}


LINK = "struct<to_url:string,internal:boolean,anchor:string,role:string,block_type:string>"
BLOCK = "struct<block:int,block_key:string,block_type:string,role:string,dom_path:string,headings:array<string>,text:string,text_hash:string,link_density:double,text_density:double,prominence:double,boilerplate:double>"
SENTENCE = "struct<block:int,block_key:string,place:int,sentence:string,text_hash:string,role:string,link_density:double,boilerplate:double>"
SNAPSHOT = f"title string, meta_description string, canonical_url string, noindex boolean, language string, h1_text string, h1_count int, h2_count int, word_count int, structured_types array<string>, has_price boolean, has_ratings boolean, calls array<string>, dom array<string>, region_links array<string>, links array<{LINK}>, regions array<struct<role:string,dom_path:string>>, blocks array<{BLOCK}>, sentences array<{SENTENCE}>"


def snapshots(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", limits: Limits = EXACT, columns: tuple[str, ...] | None = None) -> DataFrame:
    """id, url and SNAPSHOT of every page, or those ``columns`` of it; pages are parsed again wherever the result is used, so
    write it before it is used twice."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    slim = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"), F.col(html_col).alias("_html"))
    kind = slim.schema["_id"].dataType.simpleString()
    shape = StructType([f for f in StructType.fromDDL(SNAPSHOT) if columns is None or f.name in columns])
    fields, shown = to_arrow_schema(shape), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = [page_snapshot(u, h, limits) for u, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                made = pa.RecordBatch.from_pylist(rows, schema=fields)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made.columns], names=["_id", "url", *made.schema.names])

    return slim.mapInArrow(run, f"_id {kind}, url string, {shown}").withColumnRenamed("_id", id_col)


def unfolded(pages: DataFrame, column: str, id_col: str = "page_id") -> DataFrame:
    return pages.select(id_col, F.explode(column).alias("_x")).select(id_col, "_x.*")


def regions_from_blocks(blocks: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Per page and role: mean densities, first block key, and the text in order (what is gathered is one page's text)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), " ")
    return blocks.groupBy(id_col, "role").agg(F.count(F.lit(1)).alias("blocks"), F.avg("text_density").alias("text_density"), F.avg("link_density").alias("link_density"), F.min_by("block_key", "block").alias("block_key"), text.alias("text"))


def repeated_blocks(blocks: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Per page, the share of blocks whose text stands on two pages or more."""
    pages = blocks.groupBy("text_hash").agg(F.count_distinct(id_col).alias("pages"))
    return blocks.join(pages, "text_hash").groupBy(id_col).agg(F.count(F.lit(1)).alias("blocks"), F.avg((F.col("pages") >= 2).cast("double")).alias("repeated_share"))


#: Structure tokens of a page that its template goes by.
TEMPLATE_TOKENS = 120


def templates(pages: DataFrame, id_col: str = "page_id", most_tokens: int | None = TEMPLATE_TOKENS) -> DataFrame:
    """Pages with the same structure share a template: the fingerprint is that of the first ``most_tokens`` structure
    tokens (nodes, then blocks; None: all) and of the links of each region in order. Returns page, template, the pages of
    the template and its confidence. What a page has is written once, so that it is parsed once."""
    dom = F.col("dom") if most_tokens is None else F.slice("dom", 1, most_tokens)
    shape = F.concat_ws("#", F.array_join(dom, "|"), F.array_join("region_links", "|"))
    keyed = pages.select(id_col, F.concat(F.lit("tpl_"), F.substring(F.sha2(shape, 256), 1, 12)).alias("template"), url_skeleton(F.col("url"))["family"].alias("_family"), F.size(F.array_distinct(F.transform("region_links", lambda x: F.substring_index(x, ":", 1)))).alias("_kinds"), F.size("region_links").alias("_regions"))
    keyed = stored(keyed, "templates")
    sizes = keyed.groupBy("template").agg(F.count(F.lit(1)).alias("size"), F.max("_kinds").alias("_kinds"), F.max("_regions").alias("_regions"))
    top = keyed.groupBy("template", "_family").agg(F.count(F.lit(1)).alias("_n")).groupBy("template").agg(F.max("_n").alias("_top"))
    # Members share all their regions, so the share of kinds among them is the first member's.
    sure = cluster_confidence(F.col("size"), F.col("_top") / F.col("size"), F.when(F.col("_kinds") > 0, F.least(F.col("_kinds"), F.lit(6)) / F.greatest(F.lit(1), F.col("_regions"))).otherwise(0.0))
    known = sizes.join(top, "template").select("template", "size", sure.alias("confidence"))
    return keyed.select(id_col, "template").join(known, "template")
