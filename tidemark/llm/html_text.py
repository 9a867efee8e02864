"""Main text of web pages by composite text density.

A page is read into a tree. Every node gets the composite density of its subtree: characters per tag, lowered where
characters or tags belong to links, by the formula of Sun, Song and Liao (DOM based content extraction via text density,
2011). The density sums of the children are compared over the tree; the subtree with the largest sum is selected, and the
lowest density on its path up to the body is the threshold: blocks outside the subtree are taken too where a node that
holds them, below the body, reaches the threshold and its text is not mostly links.

Regions that are no article by their element (menus, headers outside the article, footers, sidebars, scripts, styles) or
by the attribute `hidden` are cut while the page is read. Class names, ids, roles and aria-hidden are hints, and so are
forms, since some sites put the whole page into one: such regions (notices, adverts, comments of readers) are read too and cut before densities are taken, unless they hold the
page's `main`, its largest `article` or most of its text outside links. See cut_hinted.
White space inside a block becomes one space; blocks are joined in page order by one space.

Null or empty pages, and pages without text, give an empty text. Broken markup is accepted: unclosed and misnested
elements, cut tags and cut character references. Rows are handled one by one. Trees deeper than the interpreter's stack
are no danger: every walk is a loop.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
#: One attribute: its name, and its value in double, single or no quotes.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?|["'][^"']*["']?""")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
          "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CUT = {"nav", "aside", "footer", "header", "menu", "dialog", "button", "select", "option", "head", "input", *RAW}
#: Elements that can stand around a whole page as well as around a few fields: hints, as a noise name is.
FIELDS = {"form", "fieldset"}
#: An open element of the key is closed by the start of one of the values.
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
          "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
        "option": {"option"}}
SCOPES = {"article", "body", "div", "html", "main", "ol", "section", "table", "td", "th", "ul"}
NOISE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|advertisement|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumb\w*|sidebar\w*|"
                   r"footer|header|masthead|cookie\w*|consent|notice\w*|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|"
                   r"recommended|comments?|commentlist|respond|disqus|widget\w*|pagination|pager|toolbar|skip-link)(?=$|[\s_-])", re.I)
TELLS = re.compile("class|id|role|hidden", re.I)
#: Before a noise word of the same name these say what a page has or lacks, not what the element is: has-sidebar, no-comments.
ABOUT = re.compile(r"(?:^|[_-])(?:has|have|no|non|not|with|without)[_-]", re.I)
#: Regions of readers' texts can be longer than the article.
READERS = re.compile(r"comment|respond|disqus", re.I)
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}


class Node:
    __slots__ = ("name", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "hint", "block", "in_article")

    def __init__(self, name: str, parent: "Node | None", hint: str = ""):
        self.name, self.parent, self.children, self.hint = name, parent, [], hint
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        # The nearest element around that is not inline, and whether an article holds it: no walk up per element.
        self.block: Node = self if parent is None or name not in INLINE else parent.block
        self.in_article: bool = name in ("article", "main") or parent is not None and parent.in_article


def attributes_of(raw: str) -> dict[str, str]:
    """Attributes by lower-case name, of repeated ones the first; without a value: an empty text."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        if m[1]:
            out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def is_noise_name(names: str) -> bool:
    """Whether one of a class attribute's names, or an id, has a noise word."""
    return any((m := NOISE.search(x)) and not ABOUT.search(x[:m.start() + 1]) for x in names.split())


def standing(name: str, attributes: str, in_article: bool) -> str:
    """How an element stands: 'cut', or as a hint 'readers' or 'noise', or '' for text like any other."""
    if name in CUT and not (name == "header" and in_article):
        return "cut"
    fields = "noise" if name in FIELDS else ""
    if name in ("html", "body") or not TELLS.search(attributes):
        return fields
    given = attributes_of(attributes)
    roles = given.get("role", "").lower().split()
    plain = name not in ("article", "main") and "main" not in roles
    # Any value hides, also "false", but that of text which a search in the page opens.
    if plain and given.get("hidden", "until-found").lower() != "until-found":
        return "cut"
    names = [x for k in ("class", "id") if (x := given.get(k, "")) and is_noise_name(x)]
    if names and "main" not in roles:
        return "readers" if any(map(READERS.search, names)) else "noise"
    if plain and (given.get("aria-hidden", "").lower() == "true" or not NOISE_ROLES.isdisjoint(roles)):
        return "noise"
    return fields


def tree(page: str) -> Node:
    """The page's elements and texts, without the regions that are no article. Texts are strings among the children."""
    root = Node("html", None)
    at, pos, size = root, 0, len(page)
    skipped: list[str] = []  # open elements of the region being cut
    opened, cut_open = Counter(), Counter()  # open elements by name, so that a stray end tag walks nowhere

    def text(a: int, b: int) -> None:
        if not skipped and a < b:
            at.children.append(html.unescape(page[a:b]))

    def leave(to: Node) -> None:
        nonlocal at
        while at is not to:
            opened[at.name] -= 1
            at = at.parent

    while pos < size:
        m = TAG.search(page, pos)
        if m is None:
            text(pos, size)
            break
        text(pos, m.start())
        pos = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), m[1] == "/"
        if skipped:
            if closing:
                while cut_open[name]:
                    last = skipped.pop()
                    cut_open[last] -= 1
                    if last == name:
                        break
            elif name in RAW:
                pos = after_raw(page, pos, name)
            elif name not in VOID and not m[3].endswith("/"):
                if name != "p" or skipped[-1] != "p":
                    skipped.append(name)
                    cut_open[name] += 1
            continue
        if closing:
            up = at if opened[name] else None
            while up is not None and up.name != name:
                up = None if up.name in ("td", "th", "table") and name in INLINE else up.parent
            if up is not None and up is not root:
                leave(up.parent)
            continue
        while at.name in ENDS and name in ENDS[at.name]:
            leave(at.parent)
        if name in BLOCKS or name in ENDS:
            # An inline element left open inside a paragraph does not keep the paragraph open.
            up = at.block
            if up.name in ENDS and name in ENDS[up.name]:
                leave(up.parent)
        if name in RAW:
            pos = after_raw(page, pos, name)
        elif name in VOID:
            if name != "wbr":
                at.children.append(" " if name in ("br", "img", "hr") else "")
                at.tags += name != "br"
        else:
            hint = standing(name, m[3], at.in_article)
            if hint == "cut":
                if not m[3].endswith("/") and name not in VOID:
                    skipped, cut_open = [name], Counter({name: 1})
                continue
            if name == "html" and at is root:
                continue
            node = Node(name, at, hint)
            at.children.append(node)
            if not m[3].endswith("/"):
                at = node
                opened[name] += 1
    cut_hinted(root)
    return root


def cut_hinted(root: Node) -> None:
    """Cuts the regions whose names or roles hint that they are no article.

    A hint is overruled where the region holds `main`, or more than half of the page's text outside links (nine tenths of it
    for readers' comments, which can be longer than the article), or else the largest `article`, if that has more text than
    all that stands outside hinted regions. Where the page has `main`, such an `article`, or outside hinted regions an `article`
    of a tenth of the text, only regions inside it are overruled for their share. Regions inside an overruled one are judged by themselves. An `article`
    named as noise counts as no article but is cut only with the region that it stands in.
    """
    nodes = in_order(root)
    if not any(n.hint for n in nodes):
        return
    free, plain, inside = 0, dict.fromkeys(map(id, nodes), 0), {id(root.parent): (False, False)}
    for n in nodes:
        linked, hinted = inside[id(n.parent)]
        linked, hinted = linked or n.name == "a", hinted or n.hint != "" and n.name not in ("article", "main")
        inside[id(n)] = linked, hinted
        if not linked:
            own = plain[id(n)] = sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
            free += 0 if hinted else own
    for n in reversed(nodes):
        if n is not root:
            plain[id(n.parent)] += plain[id(n)]
    whole, holds = plain[id(root)], set()
    articles = [n for n in nodes if n.name == "article" and not n.hint]
    largest = max(articles, key=lambda n: plain[id(n)], default=None)
    if largest is not None and plain[id(largest)] <= free:
        largest = None
    for n in nodes:
        if (n.name == "main" or n is largest) and inside[id(n)][1] and plain[id(n)]:
            up = n.parent
            while up is not None and not (up.hint == "readers" and n.name != "main"):
                holds.add(id(up))
                up = up.parent
    anchors = {id(n) for n in nodes if n is largest or n.name == "main" and plain[id(n)]
               or n.name == "article" and not n.hint and not inside[id(n)][1] and 10 * plain[id(n)] > whole}
    open_to_share = set()
    for n in nodes:
        if not anchors or id(n) in anchors or id(n.parent) in open_to_share:
            open_to_share.add(id(n))
    for n in nodes:
        n.children = [c for c in n.children if isinstance(c, str) or not c.hint or c.name in ("article", "main") or id(c) in holds
                      or id(c) in open_to_share and (10 * plain[id(c)] > 9 * whole if c.hint == "readers" else 2 * plain[id(c)] > whole)]


def after_raw(page: str, pos: int, name: str) -> int:
    """The end of an element whose content is no markup."""
    m = re.compile(rf"</{name}\s*(?:>|\Z)|</{name}[\s/][^>]*(?:>|\Z)", re.I).search(page, pos)
    return m.end() if m else len(page)


def in_order(root: Node) -> list[Node]:
    """Nodes, parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out


def weigh(root: Node) -> list[Node]:
    """Sets densities and density sums of all nodes; returns them, parents first."""
    nodes = in_order(root)
    for n in reversed(nodes):
        n.chars += sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        for c in n.children:
            if isinstance(c, Node):
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags
        if n.name == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
    body_share = root.link_chars / max(1, root.chars)
    for n in reversed(nodes):
        n.density = composite(n.chars, max(1, n.tags), n.link_chars, n.link_tags, body_share)
        n.total = sum(c.density for c in n.children if isinstance(c, Node)) or n.density
    return nodes


def composite(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """Characters per tag, lowered for links: C/T x log base ln(C LC / (C - LC) + body share x C + e) of (C/LC x T/LT)."""
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - link_chars) * link_chars + body_share * chars + math.e)
    inner = chars / max(1, link_chars) * tags / max(1, link_tags)
    return chars / tags * math.log(max(inner, 1.0)) / max(math.log(base), 1e-9) if base > 1.0001 and math.log(base) > 1e-9 else (
        chars / tags * math.log(max(inner, 1.0)) / 1e-1)


def selected(root: Node) -> set[int]:
    """Identities of the topmost nodes whose text is the article."""
    nodes = weigh(root)
    best = max(nodes, key=lambda n: n.total)
    if best.chars == 0:
        return set()
    path, up = [], best
    while up is not None and up.name != "body" and up is not root:
        path.append(up)
        up = up.parent
    threshold = min((n.density for n in path), default=0.0)
    # The article's own element, when the selected subtree stands in one, is taken whole.
    for n in reversed(path):
        if n.name in ("article", "main"):
            best = n
            break
    out, todo = {id(best)}, [root]
    on_path = {id(n) for n in path}
    while todo:
        n = todo.pop()
        for c in n.children:
            if isinstance(c, Node) and id(c) not in out:
                if c is not best and id(c) not in on_path and c.density >= threshold > 0 and 2 * c.link_chars < c.chars:
                    out.add(id(c))
                else:
                    todo.append(c)
    return out


def blocks(root: Node, chosen: set[int]) -> list[str]:
    """Texts of the chosen nodes' blocks in page order."""
    out, buffer = [], []

    def flush() -> None:
        line = " ".join("".join(buffer).split())
        buffer.clear()
        if line:
            out.append(line)

    todo: list[tuple[object, bool]] = [(root, id(root) in chosen)]
    while todo:
        item, inside = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if inside:
                buffer.append(item)
        else:
            inside = inside or id(item) in chosen
            parts: list[tuple[object, bool]] = [(c, inside) for c in item.children]
            if item.name not in INLINE:
                flush()
                parts = [*parts, (None, inside)]
            todo += reversed(parts)
    flush()
    return out


def main_text(page: str) -> str:
    """The article's text."""
    if not page:
        return ""
    root = tree(page)
    return " ".join(blocks(root, selected(root)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()),
                                           "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    return arrow_pass(rows, one, "page_id long, url string, text string, n_chars long")
