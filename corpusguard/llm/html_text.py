"""HTML extraction by equivalence-class template deduction.

A page is read as tokens: tags, and blocks of text, each told apart by the path of elements
it lies in. Over the pages of a host, tokens with the same occurrence vector, which says how
often a token stands in each page, form a class. A class is valid if it is large and
frequent enough and its tokens come in one order in all pages; valid classes nest by their
paths in the template, whose root class stands once in every page. What the template does not
hold are its slots. Blocks that are template themselves are left out; of the slots, those of
the article are kept: in ``article`` or ``main`` elements, or, on hosts without them, in the
element of the root class whose slots hold the most unlinked text. Elements that are menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments by
name, role or class are never part of it.

Occurrence vectors are compared by support, total and a 64-bit sum over pages, which Spark
combines before it shuffles, so no host is held by one task. Pages of a host with the same
article count once, so copies do not make an article look like a template. Hosts with
fewer than ``MIN_PAGES`` different pages have no template; their articles are found by
element, or else by the element that holds the most unlinked text of the page.

Blocks begin and end with block elements; ``br`` is white space. Character references are
decoded, white space of any kind in a block becomes one space.

Nulls and edges: null or empty html gives an empty text; a null url has the host ''. Elements
left open are closed as browsers do. Repeated rows give a row each; an empty table gives
none. Whole pages of any length are read in one pass. Other columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.llm import common
from corpusguard.session import materialized

#: Different pages that a host's template is deduced from at least, and their share that a class stands in.
MIN_PAGES, MIN_SHARE, MIN_CLASS = 10, 0.95, 2
#: Share of link text from which a slot is a list of links.
LINKED = 0.5

TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/><]*)((?:[^>"'<]|"[^"<]*"|'[^'<]*')*+)>|<(/?)([A-Za-z][^\s/><]*)([^><]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
SECTIONS = frozenset("html body article main section nav aside header footer form table td th fieldset dialog".split())
BLOCKS = SECTIONS | frozenset("address blockquote center details dd dir div dl dt figcaption figure h1 h2 h3 h4 h5 h6 head hgroup hr legend li "
                              "menu ol option p pre search select summary tbody tfoot thead title tr ul caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element of these names, looked for up to the given containers.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
OUT_ELEMENTS = frozenset("nav header footer aside form script style dialog menu button select option template svg canvas object noscript iframe textarea "
                         "title head audio video map datalist".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog status menu menubar toolbar".split())
OUT_WORDS = frozenset("nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored "
                      "promo promotion banner cookie cookies consent gdpr notice notices notification alert comment comments commentlist disqus reply "
                      "replies discussion share sharing social breadcrumb breadcrumbs related recommended newsletter subscribe subscription popup modal "
                      "overlay toolbar widget pagination pager signup login search copyright legal disclaimer form".split())
#: A class name with one of these says what stands beside an element, not what it is.
BESIDE = frozenset("with has no without".split())


@dataclass(slots=True)
class Element:
    name: str
    path: str
    #: path of the innermost block element
    block: str
    out: bool
    article: bool
    link: bool


@dataclass(slots=True)
class Block:
    path: str
    text: str
    out: bool
    article: bool
    linked: int


@dataclass(slots=True)
class Page:
    tags: list[str] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


ROOT = Element("", "", "", False, False, False)


def _element(name: str, attributes: str, parent: Element) -> Element:
    label, out, article = name, parent.out, parent.article
    if name in ("article", "main"):
        article = True
    if name in OUT_ELEMENTS and not (name == "header" and article):
        out = True
    if attributes and not attributes.isspace():
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                # ids are often numbered by page
                label += f".{value if key == 'class' else re.sub('[0-9]+', '', value)}"
                if name not in ("html", "body"):
                    for said in value.lower().split():
                        words = set(WORD.findall(said))
                        out = out or bool(words & OUT_WORDS and not words & BESIDE)
            elif key == "role":
                role = value.lower()
                out, article = out or role in OUT_ROLES, article or role in ("main", "article")
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                out = True
    path = f"{parent.path}/{label}"
    return Element(name, path, path if name in BLOCKS else parent.block, out, article, parent.link or name == "a")


class _Reader:
    """Builds a page from tags and text, with the elements that are open."""

    def __init__(self):
        self.page = Page()
        self.open: list[Element] = []
        #: texts of the block at hand, and of what is left out inside it: [element, parts, linked characters]
        self.text: dict[bool, list] = {}

    def add(self, raw: str) -> None:
        at = self.open[-1] if self.open else ROOT
        held = self.text.get(at.out)
        if held is None:
            if raw.isspace():
                return
            held = self.text[at.out] = [at, [], 0]
        held[1].append(raw)
        if at.link:
            held[2] += len(raw)

    def flush(self) -> None:
        for out, (at, parts, linked) in self.text.items():
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                self.page.blocks.append(Block(at.block, text, out, at.article, linked))
        self.text.clear()

    def close(self, names: set | frozenset, walls: set | frozenset) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].name in names:
                del self.open[k:]
                return
            if self.open[k].name in walls:
                return

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.flush()
            self.close({"p"}, SECTIONS)
            if name in HEADINGS and self.open and self.open[-1].name in HEADINGS:
                self.open.pop()
        elif name == "br":
            self.add(" ")
            return
        if name in ENDS:
            self.close(*ENDS[name])
        element = _element(name, attributes, self.open[-1] if self.open else ROOT)
        self.page.tags.append(element.path)
        if name not in VOID and not (name in ("html", "body") and any(e.name == name for e in self.open)):
            self.open.append(element)

    def end(self, name: str) -> None:
        block = name in BLOCKS
        if block:
            self.flush()
        if name in ("html", "body"):
            return
        for k in range(len(self.open) - 1, -1, -1):
            at = self.open[k]
            if at.name == name:
                self.page.tags.append(f"{at.path}/")
                if block:
                    del self.open[k:]
                else:
                    del self.open[k]
                return
            if at.name in SECTIONS and name not in SECTIONS:
                return


def read_page(text: str | None) -> Page:
    """The tags of a page, by path, and its blocks of text, in order."""
    reader = _Reader()
    text = text or ""
    at = 0
    while True:
        found = TAG.search(text, at)
        stop = found.start() if found else len(text)
        if stop > at:
            reader.add(text[at:stop])
        if not found:
            break
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        if found[1] or found[4]:
            reader.end(name)
            continue
        reader.start(name, found[3] or found[6] or "")
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(text, at)
            stop = close.start() if close else len(text)
            if name == "textarea" or name == "title":
                reader.add(text[at:stop])
            at = stop
    reader.flush()
    return reader.page


def hashed(*parts: str) -> int:
    """A signed 64-bit hash."""
    value = xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def article_blocks(page: Page, main: str | None = None, template: frozenset = frozenset()) -> list[Block]:
    """The blocks of the article, without those that are template."""
    kept = [b for b in page.blocks if not b.out]
    inside = [b for b in kept if b.article]
    if not inside:
        kept = [b for b in kept if b.linked <= LINKED * len(b.text)]
        within = [b for b in kept if main is not None and (b.path == main or b.path.startswith(main + "/"))]
        inside = within or densest(kept)
    return [b for b in inside if not template or hashed(b.path, b.text) not in template]


def densest(blocks: list[Block]) -> list[Block]:
    """The blocks in the element whose blocks, those directly in it, hold the most text."""
    held: dict[str, int] = {}
    for b in blocks:
        parent = b.path.rsplit("/", 1)[0]
        held[parent] = held.get(parent, 0) + len(b.text)
    if not held:
        return blocks
    best = max(held, key=lambda p: (held[p], p))
    return [b for b in blocks if f"{b.path}/".startswith(f"{best}/")]


TOKEN = pa.struct([("token", pa.int64()), ("path", pa.string()), ("block", pa.bool_()), ("n", pa.int64()), ("place", pa.int32()), ("chars", pa.int64()),
                   ("linked", pa.int64()), ("out", pa.bool_()), ("article", pa.bool_())])
TOKENS = pa.schema([("host", pa.string()), ("page", pa.int64()), ("tokens", pa.list_(TOKEN))])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each page, each once with its number and first place. ``page`` is a hash of what its article says."""
    for batch in common.slices(batches, "html"):
        out = []
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = read_page(text)
            found: dict[int, dict] = {}
            for k, path in enumerate(page.tags):
                token = hashed(path)
                seen = found.get(token)
                if seen:
                    seen["n"] += 1
                else:
                    found[token] = {"token": token, "path": path, "block": False, "n": 1, "place": k, "chars": 0, "linked": 0, "out": False, "article": False}
            for k, b in enumerate(page.blocks):
                token = hashed(b.path, b.text)
                seen = found.get(token)
                if seen:
                    seen["n"] += 1
                else:
                    found[token] = {"token": token, "path": b.path, "block": True, "n": 1, "place": k, "chars": len(b.text), "linked": b.linked,
                                    "out": b.out, "article": b.article}
            said = hashed(*(b.text for b in article_blocks(page)))
            out.append({"host": host, "page": said, "tokens": list(found.values())})
        yield pa.RecordBatch.from_pylist(out, schema=TOKENS)


def deduce_templates(pages: DataFrame) -> DataFrame:
    """host, pages, main, template, classes: the element that holds the article's slots, the blocks that are template, and the
    nested classes as (class, parent, path, size), by host with enough different pages. ``pages`` has host and html."""
    from pyspark.sql.pandas.types import from_arrow_schema
    told = pages.select("host", "html").mapInArrow(_tokens, from_arrow_schema(TOKENS))
    told = materialized(told.groupBy("host", "page").agg(F.first("tokens").alias("tokens")), "tokens")
    sizes = told.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= MIN_PAGES)
    tokens = told.select("host", "page", F.explode("tokens").alias("t")).select("host", "page", "t.*")
    # an occurrence vector by support, total and a sum over pages
    vector = F.xxhash64("page", "n").cast("decimal(20,0)")
    facts = tokens.groupBy("host", "token").agg(
        F.first("path").alias("path"), F.first("block").alias("block"), F.first("out").alias("out"), F.first("article").alias("article"),
        F.count(F.lit(1)).alias("support"), F.sum("n").alias("total"), F.sum(vector).alias("vector"), F.min("place").alias("place"),
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    facts = materialized(facts.join(sizes, "host"), "facts")
    large = facts.where(F.col("support") >= MIN_SHARE * F.col("pages"))
    label = F.xxhash64("support", "total", "vector")
    classes = large.select("host", "token", "path", "block", "support", "total", "pages", "place", label.alias("class"))
    big = classes.groupBy("host", "class").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= MIN_CLASS)
    classes = materialized(classes.join(big, ["host", "class"]), "classes")
    # valid: one order in all pages, for tags and for blocks
    ordered = (tokens.select("host", "page", "token", "place").join(classes.select("host", "token", "class", "block"), ["host", "token"])
               .groupBy("host", "class", "block", "page").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("o"))
               .groupBy("host", "class", "block").agg(F.min(F.xxhash64("o.token")).alias("a"), F.max(F.xxhash64("o.token")).alias("b"))
               .where("a = b").select("host", "class", "block"))
    valid = materialized(classes.join(ordered, ["host", "class", "block"]), "valid")
    root = valid.where("total = support AND support = pages AND NOT block").select("host", F.col("path").alias("at"))
    # a class lies in the innermost element of the root class that is open around its first token
    steps = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))

    def around(df: DataFrame) -> DataFrame:
        """``df`` with ``parent``, the innermost root element that its path lies in."""
        keyed = df.select("host", "path").distinct().select("host", "path", F.explode(steps).alias("at"))
        inner = keyed.join(root, ["host", "at"]).groupBy("host", "path").agg(F.max_by("at", F.length("at")).alias("parent"))
        return df.join(inner, ["host", "path"], "left")

    nested = around(valid.groupBy("host", "class").agg(F.min("path").alias("path"), F.max("size").alias("size")))
    nested = nested.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("path", "parent", "size", "class"))).alias("classes"))
    blocks = valid.where("block").groupBy("host").agg(F.collect_set("token").alias("template"))
    slots = facts.where("block AND NOT out").join(valid.select("host", "token"), ["host", "token"], "left_anti")
    slots = around(slots.groupBy("host", "path").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked")))
    held = (slots.where(F.col("linked") <= LINKED * F.col("chars")).groupBy("host", "parent").agg(F.sum("chars").alias("chars"))
            .groupBy("host").agg(F.max_by("parent", F.struct("chars", "parent")).alias("main")))
    return sizes.join(held, "host", "left").join(blocks, "host", "left").join(nested, "host", "left")


EXTRACTED = "page_id long, url string, text string"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "html"):
        known: dict = {}
        texts = []
        for host, text, main, template in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "main", "template"))):
            if host not in known:
                known[host] = frozenset(template or ())
            texts.append("\n".join(b.text for b in article_blocks(read_page(text), main, known[host])))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text: the article of every page in ``pages`` (page_id, url, html).

    Templates are a row per host and small beside the pages; Spark sends them to all tasks if their written size allows it, and
    joins by host otherwise, splitting a host that holds many pages.
    """
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    templates = materialized(deduce_templates(read).select("host", "main", "template"), "templates")
    return read.join(templates, "host", "left").mapInArrow(_texts, EXTRACTED)
