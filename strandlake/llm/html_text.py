"""Main text of web pages by composite text density.

Each page becomes a DOM in one forward pass over its bytes, in time linear in its length whatever it holds. Elements that are never article text by their meaning (scripts, navigation)
are left out. Forms, and elements whose role, class or id names nothing but an advert, a notice, a menu, comments and the like, are left out
unless they wrap the text: they hold an article, main or h1 element that no such name marks, or most of the body's characters outside links (named elements
only where no such article or main stands outside). Every other
node's density is its characters per tag, adjusted by the share of link characters and tags against the body's; the subtree with the largest
sum of its children's densities is the text (of equal sums, an article or main element's counts). The least density on the path from that node to the body is the threshold: a part beside the path
belongs to the text if it holds a node as dense as that, or lies between two such parts and is not mostly links. Inside an article or main element the short parts before the first and
behind the last count too, once the dense ones hold half of its characters. Inside the text, elements with weaker names (related, toc) stay if they are half as dense as the threshold and not mostly links.

A null, empty or text-less page gives an empty text. Unclosed and misnested tags are closed as a browser would; a tag or comment that
the page's end cuts off is no text. The work is
one map over the pages; nothing is shuffled and each row stands alone, repeated or not.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.tables import map_texts, texts_of

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:([\"'])|([^\s>]*)))?")
_SPACE = re.compile(r"[\s/]*")

# Element names of HTML by their part.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
DROPPED = frozenset(
    "script style textarea title head nav footer aside button select option input noscript iframe object embed svg canvas template dialog menu audio video map".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr".split())
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
MAIN = frozenset(("article", "main"))
#: an opening tag ends these open elements, up to the nearest of its scope
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

# Words of class and id names. A name is a role if all words between its hyphens are of these lists and one is a role's.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe signup login nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar sidebar share sharing comment comments disqus replies respond skip copyright".split()
)
WEAK = frozenset("widget widgets related recommended recommendations search social toc".split())
LAYOUT = frozenset("area bar block bottom box btn button buttons center container desktop form global header holder icon icons inner item items left link links list local mobile module outer panel post posts right row section site slot sticky sub top unit wrap wrapper".split())
#: of layouts and headings too when compound
WHOLE = frozenset("side header tags".split())
_NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())


class Node:
    __slots__ = ("tag", "parent", "parts", "noise", "named", "marks", "chars", "tags", "link_chars", "link_tags", "density", "peak", "total")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False, named: int = 0):
        self.tag, self.parent, self.noise, self.named = tag, parent, noise, named
        self.parts: list = []


def _role_of(attrs: dict[str, str]) -> int:
    """2: the names tell a part that is no text; 1: they may; 0: they don't."""
    if attrs.get("role", "").lower() in _NOISE_ROLE:
        return 2
    found = 0
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        words = [w for w in re.split("[-_]+", name) if w]
        if name in WHOLE:
            found = max(found, 1)
        elif words and all(w in STRONG or w in WEAK or w in LAYOUT for w in words):
            found = max(found, 2 if any(w in STRONG for w in words) else 1 if any(w in WEAK for w in words) else 0)
    return found


def _drop_named(root: Node) -> None:
    """Make noise of the forms and named elements that do not wrap the text."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        if not n.noise:
            order.append(n)
            todo += [x for x in n.parts if isinstance(x, Node)]
    for n in reversed(order):  # chars: outside links; marks: articles and mains, and headings, that no name makes noise
        own = n.named < 2
        frames, heads = int(own and n.tag in ("article", "main")), int(own and n.tag == "h1")
        n.chars = 0
        for x in n.parts:
            if isinstance(x, str):
                n.chars += len("".join(x.split()))
            elif not x.noise:
                n.chars += x.chars
                frames, heads = frames + x.marks[0], heads + x.marks[1]
        n.chars *= n.tag != "a"
        n.marks = frames, heads
    for n in order:
        if n.tag in ("article", "main") or any(n.marks):
            n.named = 0  # it wraps the text
        elif n.named == 2 or n.tag == "form":
            n.noise = 2 * n.chars <= root.chars or n.tag != "form" and root.marks[0] > 0


class _Scanner:
    """Finds what a page's next piece of markup is. It never looks at a character twice for the same thing: a quote or an end
    that was once looked for in vain is not looked for again."""

    def __init__(self, page: str):
        self.page = page
        self.missing: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """Where ``what`` next stands; the page's length if nowhere."""
        if what not in self.missing:
            k = self.page.find(what, at)
            if k >= 0:
                return k
            self.missing.add(what)
        return len(self.page)

    def tag_end(self, at: int) -> tuple[int, dict[str, str], bool]:
        """Behind the tag whose attributes begin at ``at``; class, id and role; whether it closes itself."""
        page, attrs = self.page, {}
        while True:
            m = _ATTR.match(page, at)
            if m is None:
                end = _SPACE.match(page, at).end()
                return end + 1, attrs, page[end - 1 : end] == "/" and end > at
            at, value = m.end(), m[3]
            if m[2]:
                end = self.find(m[2], at)
                value, at = page[at:end], end + 1
            name = m[1].lower()
            if name in ("class", "id", "role") and value:
                attrs.setdefault(name, value)


class _Stack:
    """Open elements, and for each name and for blocks where they stand in the stack."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {}, [0]

    def nearest(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def push(self, node: Node) -> None:
        k = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(k)
        if node.tag in BLOCK:
            self.blocks.append(k)

    def cut(self, k: int) -> None:
        """Close the elements from place ``k``."""
        while len(self.nodes) > k:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()


def parse(page: str) -> Node:
    """The page's elements below a root that stands for the body."""
    scan, stack, at = _Scanner(page), _Stack(root := Node("body", None)), 0
    text = 0  # where the text that is still to be added begins

    def add_text(end: int) -> None:
        if end > text and not stack.nodes[-1].noise:
            stack.nodes[-1].parts.append(page[text:end])

    while (at := scan.find("<", at)) < len(page):
        opened = at + 1
        if page.startswith("!--", opened):
            add_text(at)
            text = at = scan.find("-->", opened + 3) + 3
            continue
        closing = page.startswith("/", opened)
        m = _NAME.match(page, opened + closing)
        if m is None:
            if closing or page[opened : opened + 1] in ("!", "?"):
                add_text(at)
                text = at = scan.find(">", opened) + 1
            else:
                at += 1  # a mere less-than sign
            continue
        add_text(at)
        end, attrs, ended = scan.tag_end(m.end())
        text = at = end
        if end > len(page):
            break
        tag = m[0].lower()
        if tag in ("html", "body"):
            continue
        if closing:
            k = stack.nearest((tag,))
            if k and (tag in BLOCK or stack.blocks[-1] <= k):  # an inline end tag does not close a block
                stack.cut(k)
            continue
        if tag in CLOSES_P:
            k = stack.nearest(("p",))
            if k and stack.blocks[-1] == k:
                stack.cut(k)
        if tag in ENDS:
            names, scope = ENDS[tag]
            k = stack.nearest(names)
            if k > stack.nearest(scope):
                stack.cut(k)
        above = stack.nodes[-1]
        noise = above.noise or tag in DROPPED or tag == "header" and not stack.nearest(MAIN)
        node = Node(tag, above, noise, 0 if tag in HEADINGS or not attrs else _role_of(attrs))
        if not above.noise:
            above.parts.append(node)
        if tag in VOID or ended and tag not in BLOCK:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if close is None:
                return _finish(root)
            text = at = scan.find(">", close.end() - 1) + 1
            continue
        stack.push(node)
    else:
        add_text(len(page))
    return _finish(root)


def _finish(root: Node) -> Node:
    _drop_named(root)
    return root


def _measure(root: Node) -> list[Node]:
    """Set every kept node's densities; nodes in page order. Iterative: pages may nest deeply."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        if not n.noise:
            order.append(n)
            todo += reversed([x for x in n.parts if isinstance(x, Node)])
    for n in reversed(order):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for x in n.parts:
            if isinstance(x, str):
                n.chars += len("".join(x.split()))
            elif not x.noise:
                n.chars += x.chars
                n.tags += x.tags + 1
                n.link_chars += x.link_chars
                n.link_tags += x.link_tags
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
    share = root.link_chars / root.chars if root.chars else 0.0
    for n in order:
        n.density = _density(n, share)
    for n in reversed(order):
        kept = [x for x in n.parts if isinstance(x, Node) and not x.noise]
        n.total = sum(x.density for x in kept)
        n.peak = max([n.density, *(x.peak for x in kept)])
    return order


def _density(n: Node, share: float) -> float:
    """Characters per tag, to the logarithm of how few of both are links."""
    if not n.chars:
        return 0.0
    tags, links, link_chars = max(n.tags, 1), max(n.link_tags, 1), max(n.link_chars, 1)
    base = math.log(n.chars / max(n.chars - n.link_chars, 1) * n.link_chars + share * n.chars + math.e)
    x = n.chars / link_chars * tags / links
    return n.chars / tags * (math.log(x) / math.log(base) if base > 1 and x > 0 else math.log(max(x, 1.0)))


def _blocks(nodes: list, least: float) -> list[str]:
    """Texts of the blocks below ``nodes``, in page order, without weakly named elements below half the density ``least`` or mostly of links."""
    out, line = [], []

    def close() -> None:
        if line:
            text = " ".join(html.unescape("".join(line)).split())
            if text:
                out.append(text)
            line.clear()

    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            line.append(x)
        elif x.noise or x.named and (2 * x.density < least or 2 * x.link_chars >= x.chars):
            line.append(" ")
        elif x.tag == "br":
            line.append(" ")
        else:
            block = x.tag in BLOCK
            if block:
                close()
                todo.append(None)
            todo += reversed(x.parts)
    close()
    return out


def main_text(page: str) -> str:
    """The article's blocks, one a line."""
    root = parse(page)
    order = _measure(root)
    if not root.chars:
        return ""
    best = max(order, key=lambda n: (n.total, n.tag in MAIN))
    if best.total <= 0:
        best = root
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    before, behind = [], []
    held = best.chars  # by the parts that density has chosen
    for k in range(1, len(path)):
        left, right, held = _beside(path[k], path[k - 1], threshold, held)
        before.append(left)
        behind.append(right)
    return "\n".join(_blocks([*(x for xs in reversed(before) for x in xs), best, *(x for xs in behind for x in xs)], threshold))


def _beside(frame: Node, middle: Node, threshold: float, held: int) -> tuple[list, list, int]:
    """The parts of ``frame`` that belong to the text, on both sides of ``middle``; ``held``: characters that density chose up to ``middle``, and here."""
    parts = [x for x in frame.parts if isinstance(x, str) or not x.noise]
    here = next(i for i, x in enumerate(parts) if x is middle)
    dense = [i for i, x in enumerate(parts) if isinstance(x, Node) and (i == here or x.chars and x.peak >= threshold or x.tag in HEADINGS)]
    held += sum(parts[i].chars for i in dense if i != here)
    whole = frame.tag in MAIN and 2 * held >= frame.chars
    first, last = (0, len(parts)) if whole else (dense[0], dense[-1])
    taken = set(dense)
    fits = lambda i, x: i in taken or first <= i <= last and (isinstance(x, str) or 2 * x.link_chars < x.chars or not x.chars)
    sides = [(i, x) for i, x in enumerate(parts) if i != here and fits(i, x)]
    return [x for i, x in sides if i < here], [x for i, x in sides if i > here], held


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p) if p else "" for p in texts_of(b["text"])]
        return pa.RecordBatch.from_arrays([b["id"], b["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("text"))
    return map_texts(rows, run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
