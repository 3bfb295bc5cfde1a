"""HTML extraction by wrapper induction.

Pages of one host are parsed into trees, runs of like siblings are folded into one repeated node, and the trees are
aligned by simple tree matching into one template tree. A text node whose text is the same wherever pages of the host have
it is template, as is a text that most pages have anywhere in a run of like nodes; one that varies is a slot. The slot that holds nearly all varying words of the host's pages is its main
part: what else varies outside it (menus, adverts, footers) goes. Elements, roles and names that tell boilerplate break ties: they
can't be the main part, they are cut inside it where the name says nothing else, and they decide alone on hosts with too few pages.
Nothing here recurses, and each step takes time in proportion to the page but for the alignment, which has a budget.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import defaultdict
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import BROADCAST_BYTES, written
from seqloom.llm.url_filter import host_of

# Fixed values of HTML: elements without an end tag, with raw text, and those that start a new block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noframes iframe xmp noembed".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements and roles that are never part of the article.
ZONES = frozenset("head nav footer aside form script style noscript template button select option input textarea label iframe object embed svg math canvas audio video dialog menu title noframes noembed xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of a class or id that tell of boilerplate; those that may also be an article's subject; those that say only what a thing
#: is made of. A name tells of boilerplate if it has a word of the first two and else only words of the third.
WORDS = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promos sidebar sidebars rail widget widgets menus nav navbar navigation breadcrumb breadcrumbs footer foot topbar toolbar cookie cookies cookiebar consent gdpr popup newsletter subscribe signup login comment comments commentlist respond disqus sharing share recommended recommendations pagination pager copyright disclaimer hidden skip".split())
UNSURE = frozenset("alert banner banners discussion header legal masthead menu modal notice notices overlay promotion related replies reply social subscription tags".split())
FRAME = frozenset("area article articles bar block blog body bottom box btn button buttons center col column container content count cta desktop entry foldable form global group holder icons inner item items js left link links list main middle mobile module more news outer page panel popular post posts primary reader right row secondary section side site slot sticky stories tab text this thread title top tree unit user wrap wrapper zone".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)|\b(hidden)\b""")
_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])")
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*>?", re.I) for t in RAW}
#: Elements whose runs are one repeated node of a template: list items, rows, paragraphs, what stands in lines.
REPEATED = frozenset("# a abbr b blockquote br code dd dt em h2 h3 h4 h5 h6 hr i img li mark option p pre q small span strong sub sup td th tr u".split())
#: Elements that can be a host's main part, and those beside it that belong to it.
CONTAINERS = frozenset("html body main article section div center".split())
BESIDE = frozenset("# h1 h2 h3 h4 h5 h6 p blockquote pre".split())
#: An open element that one of these start tags ends.
_P_ENDS = BLOCKS - {"caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "body", "html", "head", "title", "legend"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
_SCOPES = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "body", "main", "aside", "nav"}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: The share of its containers' varying words that a node's main child holds at least.
DOMINANT = 0.8
#: Pairs of nodes that one alignment weighs by what is below them; beyond it labels alone decide. Nodes of a template from which
#: those go that few pages have.
WEIGHED, MOST_NODES = 50_000, 20_000
#: Children from which what is folded into a node that stands for a run is aligned in pairs of pairs, no more one by one.
LONGEST = 500
#: Bytes of pages that are folded into one partial template.
FOLDED = 64 << 20
#: Parts by which the partial templates of a host are merged first.
SALTS = 64


class Node:
    """An element (label: its name, class and id), or a text node (label `#`). zone: 2 is boilerplate, 1 may be."""

    __slots__ = ("label", "tag", "zone", "kids", "text", "key")

    def __init__(self, label: str, tag: str = "", zone: int = 0, text: str = ""):
        self.label, self.tag, self.zone, self.text, self.kids, self.key = label, tag, zone, text, [], None


def names_zone(name: str) -> int:
    """2 if a class or id tells of boilerplate, 1 if it may, else 0."""
    parts = [x.lower() for x in _PARTS.split(name) if x]
    if not all(x in WORDS or x in UNSURE or x in FRAME or x.isdigit() for x in parts):
        return 0
    return 2 if any(x in WORDS for x in parts) else int(any(x in UNSURE for x in parts))


_KNOWN_NAMES: dict[str, int] = {}


def _element(tag: str, attributes: str) -> Node:
    label, zone = tag, 2 if tag in ZONES else 0
    if attributes:
        got = {}
        for k, v, flag in _ATTRIBUTE.findall(attributes):
            got.setdefault((k or flag).lower(), v.strip("\"'"))
        names = [*got.get("class", "").split(), *got.get("id", "").split()]
        if got.get("class"):
            label += "." + " ".join(got["class"].split())
        if got.get("id") and not any(c.isdigit() for c in got["id"]):
            label += "#" + got["id"]
        if got.get("role", "").lower() in ROLES or got.get("aria-hidden") == "true" or "hidden" in got:
            zone = 2
        if zone < 2 and tag not in ("body", "html", "main"):
            for x in names:
                kind = _KNOWN_NAMES.get(x)
                if kind is None:
                    if len(_KNOWN_NAMES) > 10_000:
                        _KNOWN_NAMES.clear()
                    kind = _KNOWN_NAMES[x] = names_zone(x)
                if tag == "article":  # a reader's comment may be an article, else its name is that of its subject
                    kind = 2 if {"comment", "reply"} & {y.lower() for y in _PARTS.split(x)} else 0
                zone = max(zone, kind)
    return Node(label, tag, zone)


def parse(html: str) -> Node:
    """The tree of a page; never fails: unknown end tags are dropped, open elements end with the page."""
    root = Node("", "")
    stack, at, n = [root], 0, len(html)
    opened: dict[str, list[int]] = defaultdict(list)  # where each tag is open in the stack
    scopes = [0]
    last_end, quotes = html.rfind(">"), True

    def text(raw: str) -> None:
        if raw:
            stack[-1].kids.append(Node("#", text=unescape(raw) if "&" in raw else raw))

    def cut(i: int) -> None:
        for x in stack[i:]:
            opened[x.tag].pop()
        del stack[i:]
        while scopes[-1] >= i:
            scopes.pop()

    def close(tags: set[str]) -> None:
        i = max((opened[t][-1] for t in tags if opened[t]), default=0)
        if i > scopes[-1]:
            cut(i)

    seen = 0  # text from here on is not in the tree yet
    while at < n:
        at = html.find("<", at)
        if at < 0 or at > last_end and not html.startswith("<!--", at):
            break
        if html.startswith("<!--", at):
            text(html[seen:at])
            end = html.find("-->", at + 4)
            seen = at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), at):
            text(html[seen:at])
            mark = "]]>" if html.startswith("<![CDATA[", at) else ">"
            end = html.find(mark, at)
            seen = at = n if end < 0 else end + len(mark)
            continue
        ends = html.startswith("</", at)
        m = _NAME.match(html, at + 1 + ends)
        if m is None:
            at += 1
            continue
        end = m.end()
        while quotes:  # to the > that no quotes hold
            stop = _STOP.search(html, end)
            if stop is None:
                quotes = False  # quotes that nothing ends: from here on they mean nothing
                break
            end = stop.start()
            if stop[0] == ">":
                break
            other = html.find(stop[0], end + 1)
            end = end + 1 if other < 0 else other + 1
        if not quotes:
            end = html.find(">", m.end())
            if end < 0:
                break
        text(html[seen:at])
        tag, attributes = m[0].lower(), html[m.end() : end]
        seen = at = end + 1
        if ends:
            if opened[tag]:
                cut(opened[tag][-1])
            continue
        if tag in _P_ENDS:
            close({"p"})
        if tag in _SIBLINGS:
            close(_SIBLINGS[tag])
        node = _element(tag, attributes)
        stack[-1].kids.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            seen = at = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            opened[tag].append(len(stack))
            if tag in _SCOPES:
                scopes.append(len(stack))
            stack.append(node)
    text(html[seen:])
    return root


class Template:
    """A template node: its label and tag, children, the one text that all pages have here (or None), the pages it was seen in,
    the words of its own text in all of them, and zone. often: in how many pages a text node has which texts (None: `text` in all).
    run: whether a page has several texts here. nodes: of one page's template, the page's own nodes."""

    __slots__ = ("label", "tag", "kids", "text", "pages", "words", "zone", "often", "nodes", "run")

    def __init__(self, label: str, tag: str, text: str | None, pages: int = 1, words: int = 0, zone: int = 0, often: dict | None = None, nodes: list | None = None, run: bool = False):
        self.label, self.tag, self.kids, self.text, self.pages, self.words, self.zone, self.often, self.nodes, self.run = label, tag, [], text, pages, words, zone, often, nodes, run

    def counts(self) -> dict:
        """In how many pages a text node has which texts."""
        return {self.text: self.pages} if self.often is None else self.often


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def _key(node: Node) -> tuple[str, int]:
    """What stands for the text of a text node, and its words. Short texts stand for themselves, long ones for a hash."""
    if node.key is None:
        parts = node.text.split()
        text = " ".join(parts)
        node.key = text if len(text) <= 32 else xxhash.xxh3_128_hexdigest(text), len(parts)
    return node.key


def _leaf(node: Node, nodes: list) -> Template:
    if node.label != "#":
        return Template(node.label, node.tag, None, 1, 0, node.zone, None, nodes)
    return Template("#", "#", *_key(node)[:1], 1, _key(node)[1], 0, None, nodes)


def _folded(a: list[Template], b: list[Template]) -> list[Template]:
    """The children of two nodes of one run as those of one: like ones join in their order, the others are inserted."""
    both, i, j = [], 0, 0
    for x, y in [*_in_order([k.label for k in a], [k.label for k in b]), (len(a), len(b))]:
        both += a[i:x] + b[j:y]
        if x < len(a):
            p, q = a[x], b[y]
            p.nodes += q.nodes
            p.words += q.words
            if p.label == "#" and p.text != q.text:
                p.text = None
            both.append(p)
        i, j = x + 1, y + 1
    return both


def template_of(page: Node) -> Template:
    """A page's own template: a run of like siblings (REPEATED) becomes one node, which holds all that they hold.

    Nodes of a run are folded one by one. Where what they hold differs and comes to over LONGEST children, the rest is folded in
    pairs, these in pairs again and so on: that takes the run's size times its logarithm, however unlike its nodes are.
    """
    root = _leaf(page, [page])
    todo = [root]
    while todo:
        t = todo.pop()
        # the children of all nodes that were folded into this one, folded each on its own and then aligned
        whole: list[Template] | None = None
        later: list[list[Template]] = []
        for node in t.nodes:
            kids: list[Template] = []
            for k in node.kids:
                if k.label == "#" and not k.text.strip():
                    continue
                if kids and kids[-1].label == k.label and (k.tag or k.label) in REPEATED:
                    last = kids[-1]
                    last.nodes.append(k)
                    if k.label == "#":
                        text, n = _key(k)
                        last.words += n
                        if text != last.text:
                            last.text = None
                else:
                    kids.append(_leaf(k, [k]))
            if whole is None:
                whole = kids
                continue
            if len(whole) > LONGEST and [k.label for k in whole] != [k.label for k in kids]:
                later.append(kids)
            else:
                whole = _folded(whole, kids)
        while len(later) > 1:
            later = [_folded(*later[i : i + 2]) if i + 1 < len(later) else later[i] for i in range(0, len(later), 2)]
        t.kids = _folded(whole, later[0]) if later else whole or []
        for k in t.kids:
            if k.label == "#" and len(k.nodes) > 1:
                k.run, k.often = True, {_key(x)[0]: 1 for x in k.nodes}
        todo += [k for k in t.kids if k.label != "#"]
    return root


def _in_order(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Order-keeping pairs of equal labels: each of a with the next like one of b. Not always the most, but in linear time."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    places: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    out, at = [], 0
    for i, x in enumerate(a):
        own = places.get(x)
        if own:
            k = bisect_left(own, at)
            # a step that leaves most of b behind is not worth it while others of a may still match
            if k < len(own) and own[k] - at <= 2 * (len(a) - i):
                out.append((i, own[k]))
                at = own[k] + 1
    return out


def matching(a: list, b: list, weight) -> list[tuple[int, int]]:
    """Simple tree matching of two lists of children: the order-keeping pairs of equal labels with the most matched nodes."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    gain = [[weight(x, y) for y in b] for x in a]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + gain[i - 1][j - 1])
    i, j, pairs = len(a), len(b), []
    while i and j:
        if gain[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + gain[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


class Alignment:
    """Simple tree matching of two trees, each pair of nodes weighed once; after WEIGHED pairs labels alone align children."""

    def __init__(self, budget: int = WEIGHED):
        self.known: dict[tuple[int, int], int] = {}
        self.budget = budget

    def _small(self, a: Template, b: Template) -> bool:
        return len(a.kids) * len(b.kids) <= self.budget

    def matched(self, a: Template, b: Template) -> int:
        """Nodes that simple tree matching pairs in the trees of a and b."""
        known, todo = self.known, [(a, b)]
        while todo:
            x, y = todo[-1]
            if (id(x), id(y)) in known:
                todo.pop()
                continue
            if x.label != y.label:
                known[id(x), id(y)] = 0
                continue
            same = len(x.kids) == len(y.kids) and all(p.label == q.label for p, q in zip(x.kids, y.kids))
            if same:
                pairs = list(zip(x.kids, y.kids))
            elif self._small(x, y):
                self.budget -= len(x.kids) * len(y.kids)
                pairs = [(p, q) for p in x.kids for q in y.kids if p.label == q.label]
            else:
                known[id(x), id(y)] = 1 + len(_in_order([k.label for k in x.kids], [k.label for k in y.kids]))
                continue
            missing = [(p, q) for p, q in pairs if (id(p), id(q)) not in known]
            if missing:
                if not same:
                    self.budget += len(x.kids) * len(y.kids)  # it is counted when all below is known
                todo += missing
                continue
            if same:
                known[id(x), id(y)] = 1 + sum(known[id(p), id(q)] for p, q in pairs)
            else:
                known[id(x), id(y)] = 1 + sum(known[id(x.kids[i]), id(y.kids[j])] for i, j in matching(x.kids, y.kids, lambda p, q: known.get((id(p), id(q)), 0)))
        return known[id(a), id(b)]

    def pairs(self, a: Template, b: Template) -> list[tuple[int, int]]:
        """Which children of a and b belong together."""
        if len(a.kids) == len(b.kids) and all(x.label == y.label for x, y in zip(a.kids, b.kids)):
            return [(i, i) for i in range(len(a.kids))]
        if not self._small(a, b):
            return _in_order([k.label for k in a.kids], [k.label for k in b.kids])
        out = matching(a.kids, b.kids, self.matched)
        self.budget -= len(a.kids) * len(b.kids)
        return out


def matched(a: Template, b: Template) -> int:
    """Nodes that simple tree matching pairs."""
    return Alignment().matched(a, b)


def merge(a: Template, b: Template) -> Template:
    """Merges template b into a, its equal in label: matched nodes join, the others are inserted in order."""
    aligned, todo = Alignment(), [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.label == "#":
            if x.often is not None or y.often is not None or x.text != y.text:
                x.often = x.counts()
                for k, n in y.counts().items():
                    x.often[k] = x.often.get(k, 0) + n
            if x.text != y.text:
                x.text = None
            x.run |= y.run
        x.pages += y.pages
        x.words += y.words
        kids, i, j = [], 0, 0
        for p, q in [*aligned.pairs(x, y), (len(x.kids), len(y.kids))]:
            kids += x.kids[i:p] + y.kids[j:q]
            if p < len(x.kids):
                kids.append(x.kids[p])
                todo.append((x.kids[p], y.kids[q]))
            i, j = p + 1, q + 1
        x.kids = kids
    return a


def _preorder(t: Template) -> list[Template]:
    out, todo = [], [t]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += x.kids[::-1]
    return out


def _rest(label: str, tag: str, gone: list[Template]) -> Template:
    """A node that no page has, with the words of the nodes `gone`: free ones, those of links, those in ZONES, and of links there."""
    words, todo = defaultdict(int), [(x, False, False) for x in gone]
    while todo:
        x, linked, zone = todo.pop()
        if x.label == "#":
            words[linked, zone] += x.words
        todo += [(k, linked or x.tag == "a", zone or x.tag in ZONES) for k in x.kids]
    out = Template(label, tag, None, 0)
    for linked, zone in ((False, False), (True, False), (False, True), (True, True)):
        node = Template("#", "#", None, 0, words[linked, zone], 0, {})
        for name, on in (("a", linked), ("nav", zone)):
            if on:
                inner, node = node, Template(f"*{name}{linked:d}", name, None, 0)
                node.kids = [inner]
        out.kids.append(node)
    return out


def _frequent(nodes: list[Template], least: float) -> None:
    """Replaces nodes that at most `least` pages have by _rest(), but for containers with a quarter of their parent's words."""
    words: dict[int, int] = {}
    for x in reversed(nodes):
        words[id(x)] = x.words * (x.label == "#") + sum(words[id(k)] for k in x.kids)
    todo = nodes[:1]
    while todo:
        x = todo.pop()
        keep = [k for k in x.kids if k.pages > least or (k.pages and k.tag in CONTAINERS and 4 * words[id(k)] >= words[id(x)])]
        kept = set(map(id, keep))
        gone = [k for k in x.kids if id(k) not in kept]
        todo += keep
        x.kids = keep
        for label, tag, own in (("*p", "p", [k for k in gone if k.tag in BESIDE]), ("*", "", [k for k in gone if k.tag not in BESIDE])):
            if own:
                x.kids = [*x.kids, _rest(label, tag, own)]


def packed(t: Template, most: int = MOST_NODES, rare: float = math.inf) -> bytes:
    """A template as bytes. Of one with over `most` nodes those go that the fewest pages have. With `rare`, none that more pages
    have, and the words of the others stay, summed (_frequent()): these nodes can't be template, but they decide on the main part.
    """
    nodes = _preorder(t)
    if len(nodes) > most:
        least = min(rare, sorted((x.pages for x in nodes), reverse=True)[most])
        if rare < math.inf:
            _frequent(nodes, least)
        else:
            for x in nodes:
                x.kids = [k for k in x.kids if k.pages > least]
        nodes = _preorder(t)
    return pickle.dumps([(x.label, x.tag, len(x.kids), x.text, x.pages, x.words, x.zone, x.often, x.run) for x in nodes])


def unpacked(raw: bytes) -> Template:
    rows = pickle.loads(raw)
    root, todo = None, []
    for label, tag, n, text, pages, words, zone, often, run in rows:
        t = Template(label, tag, text, pages, words, zone, often, None, run)
        if root is None:
            root = t
        else:
            todo[-1][0].kids.append(t)
            todo[-1][1] -= 1
            if not todo[-1][1]:
                todo.pop()
        if n:
            todo.append([t, n])
    return root


class Wrapper:
    """What a host's template says of its pages: which texts are constant, which node is the main part, which nodes that may be
    boilerplate are: those with little text or mostly links on most pages."""

    def __init__(self, template: Template, pages: int, least_pages: int):
        self.template, self.least = template, max(least_pages, pages / 2)
        nodes = _preorder(template)
        linked: dict[int, bool] = {id(template): False}
        for x in nodes:
            for k in x.kids:
                linked[id(k)] = linked[id(x)] or k.tag == "a"
        words, links, varying = {}, {}, {}
        for x in reversed(nodes):
            own = x.words if x.label == "#" else 0
            words[id(x)] = own + sum(words[id(k)] for k in x.kids)
            links[id(x)] = (own if linked[id(x)] else 0) + sum(links[id(k)] for k in x.kids)
            free = 0 if linked[id(x)] or self.constant(x) else own
            varying[id(x)] = 0 if x.tag in ZONES else free + sum(varying[id(k)] for k in x.kids)
        self.main, self.path, x = None, [], template
        while True:
            kids = [k for k in x.kids if k.tag in CONTAINERS and k.zone < 2 and varying[id(k)]]
            best = max(kids, key=lambda k: varying[id(k)], default=None)
            if best is None or varying[id(best)] < DOMINANT * sum(varying[id(k)] for k in x.kids if k.tag not in BESIDE):
                # no slot dominates: an element that says it is the main part does
                best = max((k for k in kids if k.tag in ("article", "main") and k.pages >= self.least), key=lambda k: varying[id(k)], default=None)
            if best is None:
                break
            self.path.append(x)
            self.main = x = best
            if best.tag == "article":
                break
        self.boilerplate = {id(x) for x in nodes if x.zone == 1 and x.pages >= self.least and (2 * links[id(x)] >= words[id(x)] or words[id(x)] <= 12 * x.pages)}

    def constant(self, t: Template) -> bool:
        return t.label == "#" and t.text is not None and t.pages >= self.least

    def constants(self, t: Template) -> set[str]:
        """The texts that are template here: the one that all pages have, or those of a run that at least half of them have."""
        if t.run:
            return {k for k, n in t.counts().items() if n >= self.least}
        return {t.text} if self.constant(t) else set()

    def applied(self, page: Node) -> tuple[list[Node], set[int], set[int]]:
        """(roots of the page's main part, ids of its constant text nodes, ids of its nodes that are boilerplate here). No
        roots: the page has no such part."""
        own = template_of(page)
        aligned, todo = Alignment(), [(own, self.template)]
        roots, beside, constant, gone = [], [], set(), set()
        path = {id(x) for x in self.path}
        inside = self.main is not None and self.main.tag not in ("article", "main") and not any(x.tag in ("article", "main") for x in self.path)
        while todo:
            x, t = todo.pop()
            if t is self.main:
                roots += x.nodes
            if id(t) in self.boilerplate:
                gone.update(map(id, x.nodes))
            if t.label == "#" and (fixed := self.constants(t)):
                constant.update(id(k) for k in x.nodes if _key(k)[0] in fixed)
            met = aligned.pairs(x, t)
            todo += [(x.kids[i], t.kids[j]) for i, j in met]
            if inside and id(t) in path:
                # texts and paragraphs right beside the main part belong to it
                beside += [n for k in x.kids if k.tag in BESIDE and not k.zone for n in k.nodes]
        return (roots and [*roots, *beside]), constant, gone


def article(page: Node, constant: set[int] = frozenset(), roots: list[Node] = (), gone: set[int] = frozenset()) -> str:
    """The blocks of the page's article, joined by two line ends.

    The article is what `roots` hold; without them what <article> elements hold (else <main>, else the whole page), without
    zones and constant texts. Of a <header> only headings count, and only inside the article. If that leaves nothing, an
    article counts also in an element whose class alone makes it a zone. Names that may be boilerplate are cut outside
    articles, inside only what `gone` has.
    """
    if roots and (text := _blocks(list(roots), page, constant, gone)):
        return text

    def tops(tag: str, strict: bool) -> list[Node]:
        out, todo = [], [page]
        while todo:
            x = todo.pop()
            if x.tag == tag and x.zone < 2:
                out.append(x)
            elif not (x.zone and (strict or x.tag in ZONES)):
                todo += x.kids[::-1]
        return out

    found = tops("article", True) or tops("main", True)
    return _blocks(found or [page], page, constant, gone) or _blocks(tops("article", False) or tops("main", False), page, constant, gone)


def _blocks(roots: list[Node], page: Node, constant: set[int], gone: set[int]) -> str:
    blocks, line, chosen = [], [], {id(x) for x in roots}

    def end() -> None:
        if line and (text := _squeezed("".join(line))):
            blocks.append(text)
        line.clear()

    whole = page in roots
    first = {id(k) for k in page.kids} if whole else ()
    # (node, whether in a header, whether in a chosen one); a node is left, by None, after its children
    todo: list[tuple] = [(page, False, False)]
    while todo:
        node, header, inside = todo.pop()
        if header is None:
            end()
            continue
        top = id(node) in chosen
        if node.zone == 2 or id(node) in gone or (node.zone and whole and node.tag != "article"):
            if not top:
                if inside:
                    line.append(" ")
                    continue
                if node.tag in ZONES:
                    continue
        if node.label == "#":
            if (inside or top) and id(node) not in constant and not header:
                line.append(node.text)
                if top and not inside:
                    end()
            continue
        if node.tag == "br":
            if inside:
                line.append(" ")
            continue
        if node.tag == "header" and id(node) in first:
            continue
        block = node.tag in BLOCKS or (top and not inside)
        if block:
            end()
            todo.append((node, None, None))
        header = (inside or top) and (header or node.tag == "header") and node.tag not in _HEADINGS
        todo += [(k, header, inside or top) for k in node.kids[::-1]]
    end()
    return "\n\n".join(blocks)


def _text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def host_templates(pages: DataFrame, least_pages: int = 5) -> DataFrame:
    """host, template and pages (the number of those with distinct contents) for each host of `pages` (url, html).

    Pages are dealt by host and a hash of their contents, so that copies meet in one task and count once, however they lie.
    Each task folds its pages into a template a host (one for each FOLDED bytes); these partial templates are merged by host and
    one of SALTS, then by host. So a hot host costs its tasks alike, no task gathers its pages, and a task sends a copied page on
    once.

    A partial template counts every text. Before they are merged, the counts are summed by host and text, dealt by both; only
    texts that half of the host's pages and least_pages have are kept, with all their counts: at most twice as many as a page has.
    Of a template of over MOST_NODES nodes those go that no quarter of its pages has; their words stay, summed in their parents.
    """

    def once(batches):
        seen: set = set()
        for b in batches:
            keys, new = [], []
            for host, html in zip(b.column(0).to_pylist(), b.column(1)):
                key = xxhash.xxh3_128_digest((html.as_py() or "").encode())
                new.append((host, key) not in seen)
                seen.add((host, key))
                keys.append(key)
            yield pa.record_batch([b.column(0), pa.array(keys, pa.binary()), b.column(1)], ["host", "key", "html"]).filter(pa.array(new, pa.bool_()))

    def fold(batches):
        host, last, t, n, size = None, None, None, 0, 0

        def row():
            return pa.record_batch([pa.array([host]), pa.array([packed(t, rare=(n - 1) // 4)], pa.binary()), pa.array([n], pa.int64())], ["host", "template", "pages"])

        for b in batches:
            for h, key, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if h == host and key == last:
                    continue
                html = html.as_py() or ""
                if t is not None and (h != host or size > FOLDED):
                    yield row()
                    t = None
                own = template_of(parse(html))
                t, n, size = (own, 1, len(html)) if t is None else (merge(t, own), n + 1, size + len(html))
                host, last = h, key
        if t is not None:
            yield row()

    def counted(batches):
        for b in batches:
            for host, raw, n, total in zip(*(b.column(c) for c in ("host_key", "template", "pages", "total"))):
                least, counts = max(least_pages, total.as_py() / 2), defaultdict(int)
                for x in _preorder(unpacked(raw.as_py())):
                    if x.label == "#":
                        for k, m in x.counts().items():
                            counts[k] += m
                rest = total.as_py() - n.as_py()
                some = {_text_key(k): m for k, m in counts.items() if m + rest >= least}
                yield pa.record_batch([pa.array([host.as_py()] * len(some), pa.int64()), pa.array(list(some), pa.int64()), pa.array(list(some.values()), pa.int64()), pa.array([least] * len(some), pa.float64())], ["host_key", "text", "n", "least"])

    def often(batches):
        for b in batches:
            out = []
            for raw, texts in zip(b.column("template"), b.column("texts").to_pylist()):
                t, texts = unpacked(raw.as_py()), set(texts or ())
                for x in _preorder(t):
                    if x.often is not None:
                        x.often = {k: n for k, n in x.often.items() if _text_key(k) in texts}
                out.append(packed(t, math.inf))
            yield pa.record_batch([b.column("host"), pa.array(out, pa.binary()), b.column("pages")], ["host", "template", "pages"])

    def join(key, table):
        whole, n = None, sum(table.column("pages").to_pylist())
        for x in table.column("template"):
            whole = unpacked(x.as_py()) if whole is None else merge(whole, unpacked(x.as_py()))
        return pa.table({"host": pa.array([key[0].as_py()]), "template": pa.array([packed(whole, rare=(n - 1) // 4)], pa.binary()), "pages": pa.array([n], pa.int64())})

    def small(df: DataFrame, size: Column) -> DataFrame:
        """A written table, to be broadcast if its size allows."""
        return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df

    schema = "host string, template binary, pages long"
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string"))
    dealt = rows.mapInArrow(once, "host string, key binary, html string").repartition("host", "key").sortWithinPartitions("host", "key")
    parts = written(dealt.mapInArrow(fold, schema), "templates").withColumn("host_key", F.xxhash64("host"))
    total = small(written(parts.groupBy("host").agg(F.sum("pages").alias("total")), "templates"), F.length("host") + 64)
    texts = parts.join(total, "host").mapInArrow(counted, "host_key long, text long, n long, least double")
    texts = texts.groupBy("host_key", "text").agg(F.sum("n").alias("n"), F.first("least").alias("least")).where("n >= least")
    texts = small(written(texts.groupBy("host_key").agg(F.collect_list("text").alias("texts")), "templates"), 8 * F.size("texts") + 64)
    parts = parts.join(texts, "host_key", "left").mapInArrow(often, schema)
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("template"), F.lit(SALTS)))
    return parts.groupBy("host", "salt").applyInArrow(join, schema).groupBy("host").applyInArrow(join, schema)


TEXTS = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, least_pages: int = 5, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text and n_chars (code points) of the main text of every page (page_id, url, html).

    A text that stands at its place in half of the host's distinct pages, least_pages or more, and never another there, is
    template and dropped, as is one that so many pages have anywhere in a run of paragraphs or items; so is what lies outside
    the host's main part. Fewer pages show no template: there, and on a page without the main part, elements and names alone decide.
    The templates are broadcast while they have at most most_bytes; else pages and templates are joined by host.
    A null or empty html has an empty text; a null url has the empty host; repeated rows are extracted each.
    """
    templates = written(host_templates(pages, least_pages), "templates")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url")).alias("host"))
    names = ["page_id", "url", "text", "n_chars"]

    def texts(batch, known):
        out = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html")):
            html = html.as_py()
            page = parse(html or "")
            t, n = known(host)
            if t is not None and n >= least_pages:
                roots, constant, gone = t.applied(page)
                out.append(article(page, constant, roots, gone))
            else:
                out.append(article(page))
        return pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names)

    if (templates.agg(F.sum(F.length("template") + F.length("host"))).first()[0] or 0) <= most_bytes:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: (bytes(r.template), r.pages) for r in templates.toLocalIterator()})

        def run(batches):
            loaded: dict[str, tuple] = {}

            def known(host):
                if host not in loaded:
                    raw, n = shared.value[host]
                    loaded[host] = (Wrapper(unpacked(raw), n, least_pages), n)
                return loaded[host]

            for b in batches:
                yield texts(b, known)

        return rows.mapInArrow(run, TEXTS)

    def run_joined(batches):
        last = [None, None, 0]
        for b in batches:
            for i in range(len(b)):
                one = b.slice(i, 1)
                host = one.column("host")[0].as_py()
                if last[0] != host:
                    n = one.column("pages")[0].as_py()
                    last[:] = host, Wrapper(unpacked(one.column("template")[0].as_py()), n, least_pages), n
                yield texts(one, lambda _: (last[1], last[2]))

    return rows.join(templates, "host").mapInArrow(run_joined, TEXTS)
