"""Main text of web pages by composite text density.

A page becomes a tree of elements. For each element the characters per tag are worked out and adjusted by its links: with
C characters and T tags below it, of them LC characters and LT tags in links, and the body's C and LC,

    density = C / T * log_b(C / LC * T / LT),  b = ln(C / (C - LC) * LC + LC_body / C_body * C + e)

An element's sum is the sum of its children's densities. The element of the largest sum is the core of the article. The
smallest density on the path from it to the body is the page's threshold. The article is the core with those elements beside it,
and beside its ancestors, that reach the threshold, up to the first ancestor beside which none does; what does not reach it
stays out, but for headings directly above and text in between. An element named article or main around the core is
the article itself, with those beside it that have half as much text a tag as the core. Elements that are never text of an article (by name, role or class) leave the tree first, unless the article would go with them.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

# Element names and attribute words of HTML pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp")
#: Elements that never belong to the article.
DROPPED = frozenset(
    "script style noscript template iframe object embed svg math canvas audio video head title nav footer aside button "
    "input select option textarea label fieldset dialog menu noembed noframes map applet".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead "
    "tr ul caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open paragraph.
ENDS_P = BLOCKS - frozenset("body html caption legend optgroup option td th tr tbody thead tfoot".split())
#: Elements that an element of the same kind ends, up to the enclosing list or table.
ENDS_OWN = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
#: Roles and words of classes and ids that stand for other things than the article.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|adsense|banner|sponsor\w*|promo\w*|promotions?|nav|navbar|navigation|menu|breadcrumbs?|"
    r"sidebar|side-bar|aside|rail|footer|foot|header|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|notification|alert|popup|pop-up|modal|"
    r"overlay|newsletter|subscri\w+|signup|sign-up|login|signin|comments?|commentlist|comment-\w+|respond|replies|reply|disqus|discussion|"
    r"share|sharing|social|related|recommend\w*|recirc|teaser|widget|pagination|pager|search|skip|legal|copyright|disclaimer|"
    r"tags|byline-links|paywall|hidden|sr-only|visually-hidden|feedback|ratings?|poll|survey)(?=$|[\s_-])", re.IGNORECASE)
#: Classes that only say what stands beside, and those of an article's own header.
BESIDE = re.compile(r"\S*(?<![a-z])(?:has|with|no|without)[-_]\S+", re.IGNORECASE)
OWN_HEADER = re.compile(r"(?:^|\s)\S*(?:entry|post|article|story|content|single)[-_]+(?:header|head)(?=$|\s)", re.IGNORECASE)
#: Words that may as well name a subject: inside an article such an element is weighed, not dropped.
SUBJECTS = re.compile(r"(?:^|(?<=[\s_-]))(?:legal|poll|survey|ratings?|feedback|discussion|search|social|rail|menu)(?=$|[\s_-])", re.IGNORECASE)
CONTROLS = frozenset("form input select option textarea button".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
ARTICLE = frozenset(["article", "main"])
#: A quote opens a value only after an equals sign; one that nothing closes opens none.
MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|"
    r"<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)|=)*+)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")


class Node:
    """An element with its children; text is kept among them as plain strings."""

    __slots__ = ("name", "attrs", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []
        if parent is not None:
            parent.children.append(self)

    def elements(self) -> list[Node]:
        """Child elements."""
        return [c for c in self.children if isinstance(c, Node)]


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def tree(page: str) -> Node:
    """The tree of a page. Open elements are closed where HTML implies it, and at the end of a cut-off page."""
    root = node = Node("html", {}, None)
    at = 0

    def close(names: set[str] | frozenset[str], until: set[str] | frozenset[str] = frozenset()) -> Node:
        """Leave the innermost open element of some names, unless one of ``until`` stands before it."""
        n = node
        while n is not root and n.name not in until:
            if n.name in names:
                return n.parent
            n = n.parent
        return node

    for m in MARKUP.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            node.children.append(html.unescape(page[at:m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            node.children.append(m["cdata"])
        elif m["close"]:
            name = m["close"].lower()
            if name not in ("html", "body"):
                node = close({name}, {"td", "th"} if name in ("p", "li", "b", "i", "a", "span") else frozenset())
        elif m["open"]:
            name, attrs = m["open"].lower(), m["attrs"] or ""
            if name in ("html", "body"):
                continue
            if name in ENDS_P:
                node = close({"p"}, {"td", "th", "article", "section", "div", "li", "blockquote", "button"})
            if name in HEADINGS:
                node = close(HEADINGS, BLOCKS - HEADINGS)
            if name in ENDS_OWN:
                own, until = ENDS_OWN[name]
                while True:
                    outer = close(own, until)
                    if outer is node:
                        break
                    node = outer
            node = Node(name, _attributes(attrs) if "=" in attrs or attrs.strip(" /") else {}, node)
            if name in RAW and not attrs.endswith("/"):
                end = re.compile(f"</{name}(?=[\\s/>])[^>]*>?|\\Z", re.IGNORECASE).search(page, at)
                if name in ("title", "textarea", "xmp"):
                    node.children.append(page[at:end.start()])
                at = end.end()
                node = node.parent
            elif name in VOID or attrs.endswith("/") and name in ("svg", "path", "use"):
                node = node.parent
    if at < len(page) and not page.startswith("<", at):
        node.children.append(html.unescape(page[at:]))
    return root


def _apart(node: Node) -> bool:
    """Whether an element is something else than text of an article."""
    if node.name in DROPPED:
        return True
    if not node.attrs:
        return False
    a = node.attrs
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or HIDDEN.search(a.get("style", "")):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    if node.name in ARTICLE or node.name in HEADINGS or node.name in ("html", "body", "p"):
        words = a.get("class", "") + " " + a.get("id", "")
        return node.name in ("article", "p") and bool(re.search(r"(?:^|[\s_-])(?:comment|reply|ad|advert\w*|teaser|promo|notice|cookie)s?(?=$|[\s_-])", words))
    return any(WORDS.search(BESIDE.sub("", a.get(x, ""))) for x in ("class", "id"))


def _subject(node: Node, within: Node, weight: dict[int, tuple[int, bool]]) -> bool:
    """Whether an element inside an article is a part of it although a word of its class or id may stand for something else: no
    other word does, it holds no controls, and it has half as much text a tag as the article, most of it no comments and the like."""
    own = {x: SUBJECTS.sub("", v) if x in ("class", "id") else v for x, v in node.attrs.items()}
    if own == node.attrs or _apart(Node(node.name, own, None)):
        return False
    tags, foreign, waiting = 1, 0, node.elements()
    while waiting:
        c = waiting.pop()
        if c.name in CONTROLS:
            return False
        tags += 1
        if _apart(c) and not SUBJECTS.search(f"{c.attrs.get('class', '')} {c.attrs.get('id', '')}"):
            foreign += weight[id(c)][0]
        else:
            waiting += c.elements()
    chars = weight[id(node)][0]
    return 2 * foreign < chars and 2 * chars * len(_post_order(within)) >= tags * weight[id(within)][0]


#: Words of what may outweigh a short article: spared only if next to nothing else is on the page.
FOREIGN = re.compile(r"comment|repl(?:y|ies)|respond|disqus|discussion|cookie|consent|gdpr|popup|pop-up|modal|overlay|newsletter|legal|disclaimer|copyright|footer", re.IGNORECASE)


def _weigh(root: Node) -> dict[int, tuple[int, bool]]:
    """For each element its characters outside links, and whether an article or main stands below it."""
    found: dict[int, tuple[int, bool]] = {}
    for n in _post_order(root):
        chars, holds = 0, False
        for c in n.children:
            if isinstance(c, Node):
                more, named = found[id(c)]
                chars += more
                holds = holds or named or c.name in ARTICLE
            else:
                chars += len("".join(c.split()))
        found[id(n)] = (0 if n.name in ("a", "title", "select", "button", "textarea") else chars, holds)
    return found


def _leaving(root: Node) -> set[int]:
    """The elements to take out. One that holds the page's only article or main, or most of its text outside links, stays,
    and what stands in it is looked at by itself."""
    weight = _weigh(root)
    whole = weight[id(root)][0]
    leaving: dict[int, tuple[Node, Node | None]] = {}
    named, gone, waiting = False, 0, [(root, None)]
    while waiting:
        node, inside = waiting.pop()
        for c in node.elements():
            own_header = bool(c.attrs) and bool(OWN_HEADER.search(c.attrs.get("class", "")))
            header = c.name == "header" or own_header
            if (not inside and not own_header) if header else _apart(c) and not (inside and _subject(c, inside, weight)):
                leaving[id(c)] = (c, inside)
                gone += weight[id(c)][0]
            else:
                named = named or c.name in ARTICLE
                waiting.append((c, c if c.name in ARTICLE else inside))
        if waiting:
            continue

        def spared(c: Node) -> bool:
            chars, holds = weight[id(c)]
            if holds and not named:
                return chars > 0
            foreign = c.attrs and FOREIGN.search(f"{c.attrs.get('class', '')} {c.attrs.get('id', '')}") or c.name in ("dialog", "nav", "footer", "aside")
            return 2 * chars > whole and (not foreign or not named and 10 * (whole - gone) < whole)

        kept = max((x for x in leaving.values() if spared(x[0])), key=lambda x: weight[id(x[0])][0], default=None)
        if kept is not None:
            del leaving[id(kept[0])]
            gone -= weight[id(kept[0])][0]
            named = named or kept[0].name in ARTICLE
            waiting.append((kept[0], kept[0] if kept[0].name in ARTICLE else kept[1]))
    return set(leaving)


def prune(root: Node) -> None:
    """Take everything out that never is text of an article. A header inside an article keeps its headings alone."""
    leaving = _leaving(root)
    waiting = [(root, False)]
    while waiting:
        node, inside = waiting.pop()
        kept = []
        for c in node.children:
            if isinstance(c, Node):
                if id(c) in leaving:
                    continue
                if inside and c.name == "header" or c.attrs and OWN_HEADER.search(c.attrs.get("class", "")):
                    c.children = _headings(c)
                waiting.append((c, inside or c.name in ARTICLE))
            kept.append(c)
        node.children = kept


def _headings(node: Node) -> list[Node]:
    """Headings below an element, in page order."""
    found, stack = [], node.elements()[::-1]
    while stack:
        c = stack.pop()
        if c.name in HEADINGS:
            found.append(c)
        elif not _apart(c):
            stack += c.elements()[::-1]
    return found


def _post_order(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += n.elements()
    return order[::-1]


def measure(root: Node) -> list[Node]:
    """Densities and sums of all elements, the root's last."""
    order = _post_order(root)
    for n in order:
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for c in n.children:
            if isinstance(c, Node):
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.link_tags += 1 if c.name == "a" else c.link_tags
            else:
                n.chars += len("".join(c.split()))
        if n.name == "a":
            n.link_chars, n.link_tags = n.chars, 1
    body_chars, body_links = max(1, root.chars), root.link_chars
    for n in order:
        c, t, lc, lt = n.chars, max(1, n.tags), n.link_chars, max(1, n.link_tags)
        if not c:
            n.density = 0.0
            continue
        base = math.log(c / max(1, c - lc) * lc + body_links / body_chars * c + math.e)
        ratio = c / max(1, lc) * t / lt
        n.density = c / t * max(0.0, math.log(ratio) / math.log(base)) if base > 1 else c / t * max(1.0, math.log(ratio) + 1)
    for n in order:
        n.total = sum(c.density for c in n.elements())
    return order


def article(root: Node) -> list[Node]:
    """The element that holds the main text, with the articles beside it that are alike; nothing if the page has no text."""
    order = measure(root)
    if not root.chars:
        return []
    core = max(reversed(order), key=lambda n: n.total)  # of equal sums the outer one
    if core.total <= 0:
        core = root
    threshold, n = math.inf, core
    while n is not None:
        threshold = min(threshold, n.density)
        n = n.parent
    named, n = None, core
    while n is not None:
        if n.name in ARTICLE:
            named = n
        n = n.parent
    if named is not None:
        return [c for c in named.parent.elements() if c is named or c.name in ARTICLE and not _mostly_links(c) and _plain_chars(c) >= _plain_chars(core) / 2]
    n, top, ended = core, core, False
    while n is not root:
        held = _joined(n, threshold, core, ended)
        if len(held) > 1:
            top = n.parent
        elif any(isinstance(c, Node) and c.chars for c in n.parent.children if c is not n):
            ended = True  # nothing beside it belongs to the article: further up only headings do
        n.parent.children = held
        n = n.parent
    return [top]


def _plain_chars(node: Node) -> float:
    """Characters outside links for each tag."""
    return (node.chars - node.link_chars) / max(1, node.tags)


def _mostly_links(node: Node) -> bool:
    return 2 * node.link_chars > node.chars


def _joined(node: Node, threshold: float, core: Node, ended: bool) -> list:
    """The children of a node's parent that belong to the article: the node, with elements that reach the threshold, text
    between them, loose text next to them, and headings directly above. ``ended``: only headings do."""
    children = [c for c in node.parent.children if isinstance(c, Node) and c.chars or isinstance(c, str) and c.strip() or c is node]
    inline = lambda c: isinstance(c, str) or c.name not in BLOCKS
    heading = lambda c: isinstance(c, Node) and (c.name in HEADINGS or c.chars and sum(h.chars for h in _headings(c)) == c.chars)
    own = next(i for i, c in enumerate(children) if c is node)
    leaf = lambda c: not any(x.name in BLOCKS for x in c.elements())
    plain = lambda c: not _mostly_links(c) and (c.name in ("ul", "ol", "dl", "table", "blockquote", "hr") or leaf(c))
    first = last = own
    if not ended:  # paragraphs beside a paragraph are its fellows, whatever their density
        reach = [i for i, c in enumerate(children) if i == own or isinstance(c, Node) and c.name in BLOCKS and (
            leaf(node) and (heading(c) or plain(c)) or not heading(c) and c.density >= threshold)]
        first, last = reach[0], reach[-1]
        while last + 1 < len(children) and inline(children[last + 1]):
            last += 1
        while first and inline(children[first - 1]):
            first -= 1
    at = first  # headings above, with single lines such as the author's between them and the text
    while at and (heading(children[at - 1]) or not inline(children[at - 1]) and not _mostly_links(children[at - 1])
                  and leaf(children[at - 1])):
        at -= 1
        if heading(children[at]):
            first = at
    plenty = _plain_chars(core) / 2

    def belongs(i: int, c: Node | str) -> bool:
        if i == own or inline(c) or heading(c) or c.density >= threshold:
            return True
        # in between: single lines, lists and tables, and parts with half as much text a tag as the core
        return plain(c) or not _mostly_links(c) and _plain_chars(c) >= plenty

    return [c for i, c in enumerate(children) if first <= i <= last and belongs(i, c)]


def _menu(node: Node) -> bool:
    """A list or block of several links with hardly any text beside them."""
    return node.name in ("ul", "ol", "div", "p", "table") and node.link_tags >= 3 and node.link_chars > 0.8 * node.chars


def blocks(node: Node) -> list[str]:
    """The texts of an element's blocks in page order, white space made single spaces. Menus stay in where the page names its
    article, as a list of sources may be one."""
    named = node.name in ARTICLE
    found: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        if text:
            found.append(text)
        line.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif x.name == "br":
            line.append(" ")
        elif x is node or named or not _menu(x):
            block = x.name in BLOCKS
            if block:
                end()
                stack.append(None)
            stack += x.children[::-1]
    end()
    return found


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds; empty if there is none."""
    if not page:
        return ""
    root = tree(page)
    prune(root)
    return "\n".join(b for part in article(root) for b in blocks(part))


@pandas_udf(T.StringType())
def _main_texts(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extracted(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """All rows with ``text``, the main text of the page, and ``n_chars``, its code points.

    A null, empty or text-free page has the empty text and 0. Cut-off pages give what there is. Input columns named text or
    n_chars give way. Pages of any length are parsed whole, each by itself.
    """
    return pages.withColumn("text", _main_texts(F.col(html_column).cast("string"))).withColumn("n_chars", F.length("text").cast("long"))
