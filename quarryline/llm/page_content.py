"""The article of a web page, by a tree-structured graphical model over its elements.

Every element and every block of text is a node with a hidden state: boilerplate, article, or (elements only) mixed. A node
has a potential from its own features (tag, attribute words, link density, length, where the headline is); an edge between
parent and child has a potential for their two states, by the kind of the child. Both are estimated from labelled pages,
piecewise: a logistic regression for the nodes, counts for the edges, taken relative to the states' own frequencies.
The product over the tree is summed exactly by messages from the leaves to the root and back; a block belongs to the article
if its marginal says so.

Blocks: every tag except a, b, code, em, i, span, strong ends one; comments, scripts and styles give no text; entities are
decoded; white space is collapsed and trimmed; empty blocks are dropped. Unclosed paragraphs, list items and cells end where
HTML says they do.

Pages are independent: one pass, no shuffle; the parameters (a few kilobytes) go with the task.

Defined results. Null or empty pages and pages without an article have no blocks. Repeated rows give repeated blocks, which
the query makes distinct. Further columns are not read.
"""

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import page_training

INLINE = frozenset("a b code em i span strong".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][\w:\-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_PCLOSE = frozenset("address article aside blockquote center details dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What an element ends when it begins, up to the given ancestors.
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tr", "td", "th", "thead", "tbody"]), frozenset(["table"])), "option": (frozenset(["option"]), frozenset(["select"])), "body": (frozenset(["head"]), frozenset()),
}

B, M, C = 0, 1, 2  # boilerplate, mixed, article

# What is known of a node and of what is below it, as bits.
RIGHTS, COOKIE, SENTENCE, BUTTON, HR, LAYOUT, ASIDE, NAV = (1 << k for k in range(8))
_BELOW = {"button": BUTTON, "aside": ASIDE, "nav": NAV}
_BITS = (("rights", RIGHTS), ("cookie", COOKIE), ("sentence", SENTENCE), ("button", BUTTON), ("hr", HR), ("layout", LAYOUT), ("aside", ASIDE), ("nav", NAV))


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "text", "linked", "order", "words", "links", "flags", "has_h1", "label", "index", "key", "listy", "reach", "pure", "home", "says", "under", "box", "prose")

    def __init__(self, tag: str, attrs: str, parent: "Node | None", order: int, text: str | None = None, linked: int = 0):
        self.tag, self.attrs, self.parent, self.kids, self.text, self.linked, self.order = tag, attrs, parent, [], text, linked, order
        self.words = self.links = self.flags = self.prose = 0
        self.has_h1 = False
        self.label = -1


def tree(page: str) -> Node:
    """The elements with text below them, and the blocks as leaves."""
    root = Node("#root", "", None, 0)
    at, here, order = 0, root, 1
    run: list[str] = []
    linked = inlink = 0

    def flush() -> None:
        nonlocal linked, order
        if run:
            text = _SPACE.sub(" ", "".join(run)).strip()
            if text:
                here.kids.append(Node("#text", "", here, order, text, linked))
                order += 1
            run.clear()
        linked = 0

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            text = html.unescape(text) if "&" in text else text
            run.append(text)
            if inlink:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                inlink = not m[1]
            continue
        flush()
        if m[1]:
            inlink = 0
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                here = node.parent
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        ends, stop = ({"p"}, frozenset(["table", "td", "th", "button"])) if tag in _PCLOSE else (None, None)
        for ends, stop in ((ends, stop), _ENDS.get(tag, (None, None))):
            if ends:
                node, last = here, None
                while node is not root and node.tag not in stop:
                    if node.tag in ends:
                        last = node
                    node = node.parent
                if last is not None:
                    here = last.parent
        if tag in _VOID:
            if tag == "hr":
                here.flags |= HR
            continue
        inlink = 0
        node = Node(tag, " ".join(a or b or c for a, b, c in _ATTR.findall(m[3])).lower() if m[3] else "", here, order)
        order += 1
        here.kids.append(node)
        here = node
    flush()
    return root


# Words in class, id and role by what they say. (fixed values)
_SAYS = (
    ("nav", re.compile(r"nav|menu|topbar|crumb|tabs|toolbar|header")), ("foot", re.compile(r"foot|legal|copyright|imprint|colophon")), ("side", re.compile(r"side|aside|related|widget|more|complementary|secondary|promo|newsletter|toc")),
    ("dialog", re.compile(r"cookie|consent|modal|dialog|banner|popup|overlay|gdpr|notice")), ("share", re.compile(r"share|social|follow")), ("main", re.compile(r"content|main|article|post|entry|body|text|story|docs")),
)
_DIALOG = 1 << 3
_UNDER = {t: 1 << (len(_SAYS) + k) for k, t in enumerate(("nav", "aside", "footer", "header", "article", "main", "section", "td"))}
_CHROME = 0b11110 | _UNDER["nav"] | _UNDER["aside"] | _UNDER["footer"]
_UNDER_NAMES = [name for name, _ in _SAYS] + list(_UNDER)
#: Signs of a rights notice. (fixed values)
_RIGHTS = ("©", "copyright", "rights reserved", "droits réservés", "rechte vorbehalten", "derechos reservados")
_SEPARATED = re.compile(r"\S ?[|·›»] ?\S")
_CELLS = frozenset("table tbody thead tr td th".split())
_LISTY = frozenset("ul ol li table tbody thead tr td th pre blockquote dl dt dd p h1 h2 h3 h4 h5 h6 #text".split())
_BLOCKY = frozenset("h1 h2 p ul ol div pre".split())
_said: dict[str, int] = {}


def _says(attrs: str) -> int:
    """Which of the kinds of ``_SAYS`` the attribute words name, as bits."""
    mask = _said.get(attrs)
    if mask is None:
        if len(_said) > 50_000:
            _said.clear()
        mask = _said[attrs] = sum(1 << k for k, (_, rx) in enumerate(_SAYS) if rx.search(attrs))
    return mask


_HEADS = frozenset(("h1", "h2", "h3"))


def _headline(heads: list[Node]) -> Node | None:
    """The first heading of the highest level that is not in a menu, footer, sidebar or dialogue; the first h1 of all if there is no other."""
    best = None
    for n in heads:
        around = n.under | n.says
        if around & _CHROME or around & _UNDER["header"] and not around & (_UNDER["article"] | _UNDER["main"]):
            continue
        if best is None or n.tag < best.tag:
            best = n
    return best or next((n for n in heads if n.tag == "h1" and not (n.under | n.says) & _DIALOG), None)


def _density(n: Node) -> int:
    d = n.links / n.words
    return 0 if d < 0.05 else 1 if d < 0.3 else 2 if d < 0.6 else 3 if d < 0.9 else 4


def _held(n: Node, total: int) -> int:
    """How much of the prose of the page a node holds, and whether that is much: 0 without prose."""
    if not n.prose:
        return 0
    share = n.prose / total
    return 1 + (0 if share < 0.1 else 1 if share < 0.25 else 2 if share < 0.5 else 3 if share < 0.8 else 4) + 5 * (0 if n.prose < 15 else 1 if n.prose < 40 else 2 if n.prose < 100 else 3)


def _length(w: int) -> int:
    return 0 if w < 3 else 1 if w < 6 else 2 if w < 12 else 3 if w < 30 else 4 if w < 80 else 5 if w < 200 else 6


def measured(root: Node) -> list[Node]:
    """The nodes that have text below them, parents first, with what the features need of what is below."""
    nodes, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.tag == "head" or n.tag == "title":
            continue
        nodes.append(n)
        stack += reversed(n.kids)
    for n in reversed(nodes):
        text = n.text
        if text is not None:
            n.words = text.count(" ") + 1
            n.links = n.words if n.linked >= 0.8 * len(text) else round(n.words * n.linked / len(text))
            low = text.lower()
            if any(x in low for x in _RIGHTS):
                n.flags |= RIGHTS
            if "cookie" in low or "consent" in low:
                n.flags |= COOKIE
            if n.words >= 6 and text.rstrip("\"'”)]")[-1:] in ".!?…:;":
                n.flags |= SENTENCE
                if not n.flags & (RIGHTS | COOKIE) and n.links < 0.3 * n.words:
                    n.prose = n.words
            continue
        words = links = prose = 0
        flags, kids = n.flags, [k for k in n.kids if k.words]
        for k in kids:
            words += k.words
            links += k.links
            prose += k.prose
            flags |= k.flags & ~HR
            if k.tag in _BLOCKY:
                flags |= LAYOUT
        n.words, n.links, n.prose, n.kids, n.flags = words, links, prose, kids, flags | _BELOW.get(n.tag, 0)
    out = [n for n in nodes if n.words]
    for k, n in enumerate(out):
        n.index = k
    return out


def features(nodes: list[Node]) -> None:
    """Gives every node its key: the discrete facts that its features are made from."""
    if not nodes:
        return
    total, total_prose, heads = nodes[0].words, nodes[0].prose, []
    for n in nodes:
        up = n.parent
        n.has_h1 = False
        n.says = _says(n.attrs) if n.attrs else 0
        n.under = 0 if up is None else up.under | up.says | _UNDER.get(up.tag, 0)
        n.listy = n.tag in _LISTY and not (n.flags & LAYOUT and n.tag in _CELLS)
        n.box = up if up is None or up.parent is None or not up.listy else up.box
        if n.tag in _HEADS:
            heads.append(n)
    h1 = _headline(heads)
    level = int(h1.tag[1]) if h1 else 0
    up = h1.parent if h1 else None
    while up is not None:
        up.has_h1 = True
        up = up.parent
    for n in nodes:
        up = n.parent
        if n.has_h1 or n is h1 or up is None:
            n.reach, n.pure = 0, True
        else:
            n.reach, n.pure = up.reach + 1, n.listy and (up.reach == 0 or up.pure)
    at, home = (h1.order, h1.parent) if h1 else (None, None)
    while home is not None and home.parent is not None and home.listy:
        home = home.parent
    for n in nodes:
        up = n.parent
        if home is None:
            n.home = "none"
        elif n is home:
            n.home = "self"
        elif up is not None and (up is home or up.home in ("pure", "mixed")):
            n.home = "pure" if n.listy and (up is home or up.home == "pure") else "mixed"
        else:
            n.home = "holds" if n.has_h1 else "out"
        where = "none" if at is None else "is" if n is h1 or up is h1 else "has" if n.has_h1 else "before" if n.order < at else "after"
        reach = (min(n.reach, 6), n.pure) if at is not None else None
        hub = n.box if n.text is not None or n.listy else n
        around_ = hub.parent or hub
        held = _held(hub, total_prose), _held(around_, total_prose)
        common = (_density(n), _length(n.words), where, n.flags, n.home, reach, level, held)
        if n.text is not None:
            b = n.box
            n.key = (*common, up.tag, n.text.rstrip("\"'”)]")[-1:] in ".!?…:;", _SEPARATED.search(n.text) is not None, _density(b), b.has_h1, b.flags & (RIGHTS | COOKIE | BUTTON | HR))
        else:
            s = n.words / total
            k = len(n.kids)
            n.key = (*common, n.tag, n.says, n.under, 0 if s < 0.05 else 1 if s < 0.2 else 2 if s < 0.5 else 3 if s < 0.8 else 4, 0 if k < 2 else 1 if k < 4 else 2 if k < 8 else 3, any(x is h1 for x in n.kids))


def named(key: tuple, leaf: bool) -> list[str]:
    """The names of the features of a node with that key."""
    d, w, where, flags, home, reach, level, held = key[:8]
    bits = [name for name, bit in _BITS if flags & bit]
    f = ["bias", f"d{d}", f"w{w}", f"h1:{where}", f"h1:{where}:d{d > 2}", *[f"has:{x}" for x in bits]]
    f += [f"home:{home}", f"home:{home}:{where}", f"home:{home}:d{d > 2}", f"home:{home}:w{w > 2}", *[f"home:{home}:has:{x}" for x in bits if x in ("rights", "cookie", "button", "aside", "nav")]]
    f.append(f"reach{reach[0]}:{reach[1]}" if reach else "reach-none")
    own, above = held
    f += [f"held{own}", f"held{own}:home:{home}", f"held{own}:d{d > 2}:w{w > 2}", f"above{above}", f"above{above}:held{own}", f"held{own}:level{level > 0}"]
    if level != 1:
        f += [f"head{level}", f"head{level}:home:{home}", f"head{level}:{where}", f"head{level}:d{d > 2}:w{w > 2}"]
    if leaf:
        tag, end, sep, density, holds, around = key[8:]
        f += [f"in:{tag}:end:{end}:d{d > 2}:w{w > 2}", f"home:{home}:{where}:end:{end}:d{d > 2}", f"end:{end}:d{d}:w{w}"]
        return f + [f"in:{tag}", f"end:{end}", f"sep:{sep}", f"box:d{density}", f"box:h1:{holds}", *[f"box:{name}" for name, bit in _BITS if around & bit]]
    tag, says, under, share, kids, h1kid = key[8:]
    prose, rights = bool(flags & SENTENCE), bool(flags & RIGHTS)
    f += [f"tag:{tag}:d{d > 2}:prose{prose}", f"home:{home}:{where}:d{d > 2}:prose{prose}:rights{rights}", f"prose{prose}:d{d}:w{w}"]
    said = [name for k, (name, _) in enumerate(_SAYS) if says >> k & 1]
    return f + [f"tag:{tag}", f"share{share}", f"kids{kids}", *([f"says:{x}" for x in said] or ["says:nothing"]), *[f"under:{x}" for k, x in enumerate(_UNDER_NAMES) if under >> k & 1], f"h1kid:{h1kid}:{bool(flags & (ASIDE | NAV))}"]


def _edge(parent: Node, child: Node) -> str:
    kind = "leaf" if child.text is not None else "list" if child.listy else "box"
    return f"{kind}:{'list' if parent.listy else 'body' if parent.tag in ('body', 'html', '#root') else 'box'}"


class Model:
    """Node weights by feature, and edge factors by kind."""

    def __init__(self, leaf: dict[str, list[float]], box: dict[str, list[float]], edges: dict[str, list[list[float]]]):
        self.leaf, self.box, self.edges = leaf, box, edges
        self._seen: tuple[dict, dict] = {}, {}
        flat = {k: tuple(x for row in e for x in row) for k, e in edges.items()}
        same = (1.0,) * 9
        self._flat = {(kind, to): flat.get(f"{kind}:{to}", same) for kind in ("leaf", "list", "box") for to in ("list", "body", "box")}

    def potential(self, n: Node) -> tuple[float, float, float]:
        """The node's own factor; computed once for a key."""
        leaf = n.text is not None
        seen = self._seen[leaf]
        p = seen.get(n.key)
        if p is None:
            if len(seen) > 200_000:
                seen.clear()
            z = [0.0, 0.0, 0.0]
            weights = self.leaf if leaf else self.box
            for f in named(n.key, leaf):
                for k, w in enumerate(weights.get(f, ())):
                    z[k] += w
            top = max(z[B], z[C]) if leaf else max(z)
            e = [math.exp(x - top) for x in z]
            p = seen[n.key] = (e[0], 0.0, e[2]) if leaf else tuple(e)
        return p

    def marginals(self, nodes: list[Node]) -> list[float]:
        """By node, the probability of being article; messages upward, then downward."""
        n_ = len(nodes)
        below, up, edge, above = [None] * n_, [None] * n_, [None] * n_, [None] * n_
        for n in reversed(nodes):
            b, m, c = self.potential(n)
            for k in n.kids:
                x, y, z = up[k.index]
                b, m, c = b * x, m * y, c * z
                s = b + m + c
                if s < 1e-30:
                    b, m, c, s = b + 1e-30, m + 1e-30, c + 1e-30, s + 3e-30
                b, m, c = b / s, m / s, c / s
            below[n.index] = b, m, c
            p = n.parent
            if p is not None:
                kind = "leaf" if n.text is not None else "list" if n.listy else "box"
                e = edge[n.index] = self._flat[kind, "list" if p.listy else "body" if p.tag in ("body", "html", "#root") else "box"]
                x, y, z = e[0] * b + e[1] * m + e[2] * c, e[3] * b + e[4] * m + e[5] * c, e[6] * b + e[7] * m + e[8] * c
                s = x + y + z
                up[n.index] = x / s, y / s, z / s
        out = [0.0] * n_
        above[0] = 1.0, 1.0, 1.0
        for n in nodes:
            i = n.index
            b, m, c = below[i]
            x, y, z = above[i]
            b, m, c = b * x, m * y, c * z
            s = b + m + c
            out[i] = c / s if s > 0 else 0.0
            for k in n.kids:
                j = k.index
                x, y, z = up[j]
                x, y, z = b / max(x, 1e-30), m / max(y, 1e-30), c / max(z, 1e-30)
                e = edge[j]
                x, y, z = x * e[0] + y * e[3] + z * e[6], x * e[1] + y * e[4] + z * e[7], x * e[2] + y * e[5] + z * e[8]
                s = x + y + z or 1.0
                above[j] = x / s, y / s, z / s
        return out

    def blocks(self, page: str) -> list[str]:
        """The blocks of the article, in order."""
        nodes = measured(tree(page))
        if not nodes:
            return []
        features(nodes)
        p = self.marginals(nodes)
        return [n.text for n in nodes if n.text is not None and p[n.index] > 0.5]


def _labelled(page: str) -> list[Node]:
    """The nodes of a page whose article text stands between marks, with their labels."""
    on, off = page_training.ON, page_training.OFF
    root = tree(page)
    stack = [root]
    while stack:
        n = stack.pop()
        stack += n.kids
        if n.text is not None:
            n.label = C if on in n.text or off in n.text else B
            n.text = n.text.replace(on, "").replace(off, "")
    nodes = measured(root)
    for n in reversed(nodes):
        if n.text is None:
            kids = {k.label for k in n.kids}
            n.label = kids.pop() if len(kids) == 1 else M
    features(nodes)
    return nodes


def _regression(counts: dict[tuple[tuple[str, ...], int], int], states: tuple[int, ...], steps: int = 120, rate: float = 0.8, decay: float = 2e-4) -> dict[str, list[float]]:
    """Multinomial logistic regression over binary features, equal rows counted; features seen fewer than three times are left out."""
    rows, weight = list(counts), np.array(list(counts.values()), np.float32)[:, None]
    weight /= weight.sum()
    seen: Counter = Counter()
    for (fs, _), n in counts.items():
        for f in fs:
            seen[f] += n
    names = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
    held = [[names[f] for f in fs if f in names] for fs, _ in rows]
    columns = np.array([i for h in held for i in h], np.int32)
    lengths = np.array([len(h) for h in held])
    at_row = np.concatenate(([0], np.cumsum(lengths)[:-1]))  # every row holds its bias, so none is empty
    order = np.argsort(columns, kind="stable")
    by_column = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)[order]
    at_column = np.searchsorted(columns[order], np.arange(len(names)))
    y = np.zeros((len(rows), len(states)), np.float32)
    y[np.arange(len(rows)), [states.index(s) for _, s in rows]] = 1.0
    w, first, second = np.zeros((len(names), len(states)), np.float32), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.add.reduceat(w[columns], at_row, axis=0)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = np.add.reduceat(((p - y) * weight)[by_column], at_column, axis=0) + decay * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= rate * 0.2 * (1 - (t - 1) / steps) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    out = {}
    for f, i in names.items():
        v = [0.0, 0.0, 0.0]
        for s, k in zip(states, w[i]):
            v[s] = float(k)
        out[f] = v
    return out


_TRAINED: dict[tuple[int, int], Model] = {}


def train(n: int = page_training.PAGES, seed: int = 7) -> Model:
    """A model fitted to ``n`` labelled pages (the bound of the training sample); the same for the same arguments."""
    if (n, seed) not in _TRAINED:
        leaves, boxes, pairs = Counter(), Counter(), defaultdict(lambda: np.full((3, 3), 0.5))
        for page in page_training.pages(n, seed):
            for node in _labelled(page):
                leaf = node.text is not None
                (leaves if leaf else boxes)[node.key, node.label] += 1
                for k in node.kids:
                    pairs[_edge(node, k)][node.label, k.label] += 1
        edges = {}
        for kind, counts in pairs.items():
            joint = counts / counts.sum()
            edges[kind] = (joint / np.outer(joint.sum(axis=1), joint.sum(axis=0))).tolist()
        by_name = []
        for counts, leaf in ((leaves, True), (boxes, False)):
            rows = Counter()
            for (key, label), times in counts.items():
                rows[tuple(named(key, leaf)), label] += times
            by_name.append(rows)
        _TRAINED[n, seed] = Model(_regression(by_name[0], (B, C)), _regression(by_name[1], (B, M, C)), edges)
    return _TRAINED[n, seed]


def article(df: DataFrame, key: str, raw: str, model: Model | None = None) -> DataFrame:
    """(key, position, block) of the article of every page, positions from 1."""
    model = model or train()
    weights = model.leaf, model.box, model.edges
    rows = df.select(F.col(key).alias("key"), F.col(raw).alias("raw")).where("raw IS NOT NULL AND raw <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*weights)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                b = batch.slice(start, 1000)
                at, pos, text = [], [], []
                for i, page in enumerate(b.column(1).to_pylist()):
                    found = m.blocks(page)
                    at += [i] * len(found)
                    pos += range(1, len(found) + 1)
                    text += found
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(text, pa.string())], ["key", "position", "block"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, position int, block string")
