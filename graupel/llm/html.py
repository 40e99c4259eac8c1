"""Main text of web pages by composite text density.

Each page becomes a tree.  For every node the number of characters and tags
below it, and the same for links alone, give a density: characters per tag,
lowered where links make up much of it.  The densest node's path from the body
gives the threshold; among nodes at or above it, the one whose children's
densities sum highest holds the article.  Elements that are never article
text (menus, adverts, forms, ...) are cut before, by tag, role, class and id.

Cases: a null or empty page gives the empty text, as does one without a dense
node; unclosed, misnested and unknown tags are closed as a browser would or
treated as text; pages of any length are read whole and nesting depth is not
limited by recursion; repeated rows give equal rows; an empty table an empty
table.  Columns other than those named are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slices, table

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript iframe template svg math object embed head title nav footer aside form button select option textarea input dialog menu canvas audio video map".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored sponsors promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar side aside footer foot masthead topbar toolbar comment comments commentlist respond disqus reply replies reviews notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations widget widgets pagination pager skip form search".split()
)
#: Words that say where a part stands or what it is made of: beside them a noise word still names the whole.
LAYOUT_WORDS = frozenset(
    "a b c and the box bar block area section list item items link links left right top bottom main primary secondary site page global post posts article articles content inner outer user reader readers "
    "story stories news text body row col column panel pane unit slot zone group button buttons icon icons title heading header small large mini mobile desktop sticky fixed center wide first last "
    "new latest more all my our js ui mod module component".split()
)
#: Tags that end an open element of the given kinds when they start.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
ASKED = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "up", "kids", "noise", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, up: "Node | None", noise: bool):
        self.tag, self.up, self.noise = tag, up, noise
        self.kids: list = []


def _noise(tag: str, attributes: str, inside: Node) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header":
        while inside is not None:
            if inside.tag in ("article", "main"):
                break
            inside = inside.up
        if inside is None:
            return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name not in ASKED:
            continue
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in NOISE_ROLES:
            return True
        if name in ("class", "id"):
            for part in value.split():
                words = {w.lower() for w in WORD.findall(part)}
                if words & NOISE_WORDS and words <= NOISE_WORDS | LAYOUT_WORDS:
                    return True
    return False


class Tags:
    """The tags, comments and declarations of a page from a place on.  A tag
    ends at the first ``>`` outside quotes; behind a quote that is never closed
    quotes don't count.  Each character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.open = page, set()  # quotes that don't occur any more

    def end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` is closed, -1 if nowhere."""
        page, quoted = self.page, at
        while True:
            quoted = PLAIN.match(page, quoted).end()
            if quoted >= len(page):
                return page.find(">", at)
            c = page[quoted]
            if c == ">":
                return quoted
            close = -1 if c in self.open else page.find(c, quoted + 1)
            if close < 0:
                self.open.add(c)
                return page.find(">", at)
            quoted = close + 1

    def next(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        """(start, end, name or None, closing, attributes) of the next one."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, len(page) if end < 0 else end + 3, None, False, ""
            if page.startswith(("<!", "<?"), at):
                end = page.find(">", at)
                return at, len(page) if end < 0 else end + 1, None, False, ""
            if m := OPENING.match(page, at):
                end = self.end(m.end())
                if end < 0:
                    return None  # no tag ends from here on: the rest is text
                return at, end + 1, m[2].lower(), bool(m[1]), page[m.end() : end]
            at += 1
        return None


def parse(page: str) -> Node:
    """The page's tree; text is kept decoded, as strings among a node's kids."""
    tags = Tags(page)
    top = Node("html", None, False)
    at, here = 0, top
    body = None
    size = len(page)
    while at < size:
        found = tags.next(at)
        if found is None:
            here.kids.append(entities.unescape(page[at:]))
            break
        start, end, tag, closing, attributes = found
        if start > at:
            here.kids.append(entities.unescape(page[at:start]))
        at = end
        if tag is None:
            continue
        if closing:
            node = here
            while node is not None and node.tag != tag:
                # an end tag of an inline element doesn't close a block
                if tag in INLINE and node.tag not in INLINE:
                    node = None
                    break
                node = node.up
            if node is not None and node is not top and node.tag != "body":
                here = node.up
            continue
        if tag == "html":
            continue
        if tag == "body":
            if body is None:
                body = here = Node("body", top, False)
                top.kids.append(body)
            continue
        if tag not in INLINE and tag not in VOID:  # a block ends an open paragraph
            node = here
            while node.tag in INLINE:
                node = node.up
            if node.tag == "p":
                here = node.up
        if tag in ENDS:
            node, last = here, None
            while node is not None and node.tag not in FENCES[tag] and node.tag not in ("body", "article", "main"):
                if node.tag in ENDS[tag]:
                    last = node
                node = node.up
            if last is not None:
                here = last.up
        if body is None and here.tag == "head" and tag not in ("title", "meta", "link", "script", "style", "base", "noscript", "template"):
            here = top
        new = Node(tag, here, _noise(tag, attributes, here))
        here.kids.append(new)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not attributes.rstrip().endswith("/") or tag in ("p", "div", "b", "a"):
            here = new
    root = body or top
    _free_forms(root)
    return root


#: What belongs to a form itself and isn't text of the page.
CONTROLS = frozenset("label legend button select option textarea input".split())


def _free_forms(root: Node) -> None:
    """A form that holds most of the page's text beside its own controls is the
    page's frame and no form to be cut."""
    forms, total, work = [], 0, [(root, None, False)]
    held: dict[int, int] = {}
    while work:
        node, form, cut = work.pop()
        if node.tag == "form" and node.noise and not cut:
            form = node
            forms.append(node)
            held[id(node)] = 0
        elif node.noise:
            cut = True
        size = sum(len("".join(k.split())) for k in node.kids if isinstance(k, str))
        if not cut and node.tag not in CONTROLS:
            total += size
            if form is not None:
                held[id(form)] += size
        work += [(k, form, cut) for k in node.kids if isinstance(k, Node)]
    for form in forms:
        if held[id(form)] > 0.5 * total:
            form.noise = False
            form.tag = "div"


def measure(body: Node) -> list[Node]:
    """Counts, densities and sums of children's densities for every node that
    is not noise, in page order."""
    order, work = [], [(body, False)]
    while work:
        node, link = work.pop()
        link = link or node.tag == "a"
        node.chars = sum(len("".join(k.split())) for k in node.kids if isinstance(k, str))
        node.tags = 0
        node.link_chars, node.link_tags = (node.chars, 1) if link else (0, 0)
        order.append(node)
        work += [(k, link) for k in reversed(node.kids) if isinstance(k, Node) and not k.noise]
    for node in reversed(order):
        if node.up is not None and node is not body:
            node.up.chars += node.chars
            node.up.tags += node.tags + 1
            node.up.link_chars += node.link_chars
            node.up.link_tags += node.link_tags
    share = body.link_chars / max(1, body.chars)
    for node in order:
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if not c:
            node.density = 0.0
        else:
            base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
            inner = max(c / lc * t / lt, 1.0000001)
            node.density = c / t * math.log(inner) / max(math.log(max(base, 1.0000001)), 1.0) if base > 1 else c / t
        node.total = 0.0
    for node in order:
        if node is not body and node.up is not None and node.tag not in INLINE:  # a phrase is a part of its block
            node.up.total += node.density
    return order


def article(page: str) -> Node | None:
    """The subtree that holds the main text, or None."""
    body = parse(page)
    nodes = measure(body)
    densest = max(nodes, key=lambda n: n.density)
    if not densest.density:
        return None
    least, node = densest.density, densest
    while node is not None:
        least = min(least, node.density)
        node = node.up if node is not body else None
    # of equal sums that of a marked-up article
    leaf = lambda n: (n.total if n.total else n.density, n.tag in ("article", "main"))
    best = max((n for n in nodes if n.density >= least and n.tag not in INLINE), key=leaf, default=body)
    # a title or a line of its own beside the text, without links of its own
    while best is not body and best.up is not None and best.up is not body and best.up.chars - best.chars <= 0.3 * best.chars and best.up.link_chars - best.link_chars <= 0.1 * (best.up.chars - best.chars):
        best = best.up
    return best


def blocks(root: Node) -> str:
    """The text below ``root`` without noise: white space made single, blocks
    joined by one space."""
    out, work = [], [root]
    while work:
        node = work.pop()
        if isinstance(node, str):
            out.append(node)
        elif not node.noise:
            apart = node.tag not in INLINE or node.tag == "br"
            if apart:
                out.append(" ")
                work.append(" ")
            work += reversed(node.kids)
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    if not page or not page.strip():
        return ""
    root = article(page)
    return blocks(root) if root is not None else ""


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, ``text`` and ``n_chars`` (code points), per row."""

    def run(batches):
        for batch in slices(batches):
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], [*batch.schema.names[:-1], "out_text", "out_chars"])

    cut = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(html_col).alias("page"))
    kinds = ", ".join(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = cut.mapInArrow(run, f"{kinds}, out_text string, out_chars long")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("out_text").alias("text"), F.col("out_chars").alias("n_chars"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
