"""HTML extraction: a classifier's costs and the nearness of blocks make a graph, its minimum cut keeps the main text."""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict, deque
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import Batches, table, texts
from litmill.llm.registry import query

SAMPLE_PAGES = 2000  # distinct pages, least hash first, that the classifier is fitted on
UNIT = 1000  # costs are whole numbers of this part
SURE = 1 << 40  # cost of keeping what is never main text
CORE, OUTSIDE, HINT = 6.0, 3.0, 8.0  # log odds: in the main container, outside it, in a container named as boilerplate
MOST = 4.0  # the classifier's own log odds are held within
NEAR, SIBLING, STEPS = 1.0, 0.8, 8  # smoothness of neighbours on the page and in one container; longest path counted

# What HTML says of elements, and words that pages use in class and id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead tr ul head button svg math template noscript object "
    "audio video canvas map label datalist output progress meter marquee".split()
)
UNSEEN = frozenset("head template noscript svg math object audio video canvas datalist map".split())
NEVER = frozenset("nav footer aside form dialog button select option optgroup menu fieldset legend label search output progress meter".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES_NEVER = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion nav navbar "
    "navigation menu menus submenu breadcrumb breadcrumbs pager pagination sitemap topbar toolbar masthead header footer copyright "
    "colophon sidebar rail widget widgets related recommended recommendations trending popular teaser share sharing social follow "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay toast disclaimer paywall subscribe "
    "subscription newsletter signup login signin register search form comment comments commentlist respond reply replies "
    "disqus guestbook feedback".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus guestbook feedback".split())
CORE_WORDS = frozenset("article content post entry story".split())
CORE_NAMES = re.compile(
    r"(?:^|[^a-z])(?:(?:article|post|entry|story|main|page)[-_]?(?:body|content|text)|content|article|post|entry|story|main)(?:[^a-z]|$)"
)
SCOPE = ("table", "td", "th", "caption", "template")  # an end tag does not reach beyond these
LISTS = ("ul", "ol", "menu", "dir")
# Start tag to the open elements it closes, and to those it does not look beyond.
CLOSES = {
    "li": (("li",), LISTS), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    **{t: (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)) for t in ("thead", "tbody", "tfoot")},
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
}

_ATTRS = r"""((?>=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z)"""
_markup = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(?P<raw>script|style|title|textarea|iframe|noembed|noframes|xmp)(?=[\s/>]){_ATTRS.replace('(', '(?:', 1)}"
    rf".*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*){_ATTRS.replace('(', '(?P<attrs>', 1)}"
    rf"|</?[!?/][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^A-Za-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_attribute = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_name_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])").findall
_sentence_marks = re.compile(r"[.!?;:,。！？；：，、]")


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    depth: int
    hint: str = ""  # never, bad, comment, core, main or article
    unseen: bool = False


@dataclass(slots=True)
class Block:
    """Text between two boundaries of block elements, white space collapsed."""

    text: str
    element: int
    words: int
    link_words: int


@dataclass
class Page:
    elements: list[Element] = field(default_factory=lambda: [Element("", -1, 0)])
    blocks: list[Block] = field(default_factory=list)


def _hint(tag: str, attrs: str, in_article: bool) -> tuple[str, bool]:
    """What an element's name and attributes say of its text, and whether it is not shown."""
    own = {}
    for m in _attribute.finditer(attrs):
        own.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    style = own.get("style", "").replace(" ", "").lower()
    unseen = "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    role = own.get("role", "").lower()
    if tag in NEVER or role in ROLES_NEVER or (tag == "header" and not in_article):
        return "never", unseen
    if tag == "article" or role == "article":
        base = "article"
    elif tag == "main" or role == "main":
        base = "main"
    else:
        base = ""
    names = [own.get("class", ""), own.get("id", "")]
    for name in " ".join(names).split():
        parts = [w.lower() for w in _name_words(name)]
        if parts and parts[0] in ("has", "with", "no", "without", "is") or tag in ("body", "html"):
            continue
        if COMMENT_WORDS.intersection(parts):
            return "comment", unseen
        bad = BAD_WORDS.intersection(parts)
        if bad and not (bad == {"header"} and CORE_WORDS.intersection(parts)):
            return "bad", unseen
        if not base and CORE_NAMES.search("-".join(parts)):
            base = "core"
    return base, unseen


def read_page(body: str) -> Page:
    """Blocks of a page in page order, each with its place in the tree of block elements.

    Tags follow the HTML rules that matter here: quoted attributes, comments,
    raw text elements, void elements, end tags left out or without a start, an
    unfinished tag at the end.  Work grows with the length of the page only.
    """
    page = Page()
    elements, blocks = page.elements, page.blocks
    stack = [0]
    places: dict[str, list[int]] = defaultdict(list)  # by name: places in the stack
    pieces: list[tuple[str, bool]] = []
    link_at = -1  # place in the stack where a link was opened
    articles = 0

    def flush() -> None:
        if not pieces:
            return
        whole = " ".join("".join(p for p, _ in pieces).split())
        if whole and not elements[stack[-1]].unseen:
            linked = sum(len(p.split()) for p, linked in pieces if linked)
            blocks.append(Block(whole, stack[-1], whole.count(" ") + 1, linked))
        pieces.clear()

    def close_to(size: int) -> None:
        nonlocal link_at, articles
        while len(stack) > size:
            e = elements[stack.pop()]
            places[e.tag].pop()
            articles -= e.hint in ("article", "main")
        if link_at >= len(stack):
            link_at = -1

    def last(names: Sequence[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def add(text: str) -> None:
        if text:
            pieces.append((entities.unescape(text) if "&" in text else text, link_at >= 0))

    at = 0
    for m in _markup.finditer(body):
        add(body[at : m.start()])
        at = m.end()
        if m["raw"]:
            if m["raw"].lower() in ("textarea", "iframe", "xmp"):
                flush()
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag == "a":
            link_at = -1 if m["end"] else len(stack) - 1
            continue
        if tag == "br":
            pieces.append((" ", False))
            continue
        if tag not in BLOCK:
            continue
        flush()
        if m["end"]:
            found = last((tag,))
            if found >= 1 and tag not in ("body", "html") and (found >= last(SCOPE) or tag in ("table", "template")):
                close_to(found)
            continue
        if elements[stack[-1]].tag == "p":
            close_to(len(stack) - 1)
        if tag in CLOSES:
            closed, beyond = CLOSES[tag]
            lowest = last(beyond)
            opened = [i for n in closed for i in places.get(n, ())[-1:] if i > lowest]
            if opened:
                close_to(min(opened))
        if tag in VOID:
            continue
        hint, unseen = _hint(tag, m["attrs"] or "", articles > 0)
        parent = elements[stack[-1]]
        elements.append(Element(tag, stack[-1], parent.depth + 1, hint, unseen or parent.unseen or tag in UNSEEN))
        places[tag].append(len(stack))
        stack.append(len(elements) - 1)
        articles += hint in ("article", "main")
    add(body[at:])
    flush()
    return page


KINDS = ("p", "heading", "li", "cell", "other")


def pattern(block: Block, tag: str) -> tuple[int, ...]:
    """What the classifier sees of a block, in steps: words, share in links, marks per word, end, kind of element."""
    marks = len(_sentence_marks.findall(block.text))
    kind = "heading" if tag in HEADINGS else "cell" if tag in ("td", "th", "dd", "dt") else tag if tag in ("p", "li") else "other"
    return (
        min(8, block.words.bit_length()), min(3, 4 * block.link_words // block.words), min(3, 16 * marks // block.words),
        int(block.text[-1] in ".!?。！？\"”"), KINDS.index(kind),
    )


def features(seen: np.ndarray) -> np.ndarray:
    """A row for each pattern: 1, the four steps, and one column for each kind."""
    return np.c_[np.ones(len(seen)), seen[:, :4], np.eye(len(KINDS))[seen[:, 4]]]


# Where the fit starts and what it is held to: long texts with sentence marks and few links are main text.
START = np.array([-2.0, 0.5, -1.5, 0.4, 0.8, 0.6, 1.0, -0.5, -0.2, -0.2])


def fit(seen: np.ndarray, label: np.ndarray, weight: np.ndarray, hold: float = 20.0) -> np.ndarray:
    """Weights of a logistic model over patterns, held to START; START itself where nothing is labelled."""
    x, w = features(seen), START.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (label - p)) - hold * (w - START)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + hold * np.eye(len(w)), slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def min_cut(gain: Sequence[int], edges: Sequence[tuple[int, int, int]]) -> list[bool]:
    """Labels of least cost: node i loses ``gain[i]`` if not kept (``-gain[i]`` if kept), an edge its weight if cut.

    A node whose gain outweighs all its open edges has that label in some
    least cut; it is settled at once and moves its edges into its neighbours'
    gains.  What is left goes to a maximum flow by shortest augmenting paths in
    layers; kept is what the source still reaches.
    """
    n = len(gain)
    pull = list(gain)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    open_weight = [sum(d.values()) for d in near]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(pull[i]) < open_weight[i]:
            continue
        label[i] = pull[i] > 0
        for j, w in near[i].items():
            if label[j] is None:
                pull[j] += w if label[i] else -w
                open_weight[j] -= w
                queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return [bool(x) for x in label]
    number = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    room: list[dict[int, int]] = [{} for _ in range(len(rest) + 2)]
    for i, k in number.items():
        for j, w in near[i].items():
            if j in number:
                room[k][number[j]] = w
        if pull[i] > 0:
            room[source][k], room[k][source] = pull[i], 0
        elif pull[i] < 0:
            room[k][sink], room[sink][k] = -pull[i], 0
    while True:
        layer = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for b, w in room[a].items():
                if w > 0 and b not in layer:
                    layer[b] = layer[a] + 1
                    queue.append(b)
        if sink not in layer:
            break
        onward = {a: iter(list(room[a])) for a in layer}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                flow = min(room[x][y] for x, y in zip(path, path[1:]))
                for x, y in zip(path, path[1:]):
                    room[x][y] -= flow
                    room[y][x] = room[y].get(x, 0) + flow
                full = next(k for k, (x, y) in enumerate(zip(path, path[1:])) if not room[x][y])
                del path[full + 1 :]
                continue
            for b in onward[a]:
                if room[a][b] > 0 and layer.get(b, -1) == layer[a] + 1:
                    path.append(b)
                    break
            else:
                path.pop()
    for i, k in number.items():
        label[i] = k in layer
    return [bool(x) for x in label]


def _steps(elements: list[Element], a: int, b: int) -> int:
    """Steps between two elements of the tree, not counted beyond STEPS."""
    steps = 0
    while a != b and steps < STEPS:
        if elements[a].depth >= elements[b].depth:
            a = elements[a].parent
        else:
            b = elements[b].parent
        steps += 1
    return steps


def context(page: Page) -> list[str]:
    """What the containers of each element say: never, bad, core, outside, or nothing.

    The core is what lies in an article; without one in main; without one in a
    container named as content.  A container named as boilerplate does not
    count if it holds most of the page and what looks like its main text;
    comments always count.
    """
    elements = page.elements
    holds = [False] * len(elements)
    words = [0] * len(elements)
    for b in page.blocks:
        words[b.element] += b.words
    for k in range(len(elements) - 1, 0, -1):
        e = elements[k]
        words[e.parent] += words[k]
        holds[e.parent] |= holds[k] or e.hint in ("article", "main")
    marked = any(e.hint in ("article", "main") for e in elements)
    out, found = [""] * len(elements), set()
    for k, e in enumerate(elements[1:], 1):
        above = out[e.parent]
        wide = words[k] > 0.5 * words[0] and (holds[k] if marked else words[k] >= 100)
        if above in ("never", "bad"):
            out[k] = above
        elif e.hint == "never":
            out[k] = "bad" if wide else "never"
            if wide and e.tag in ("form", "fieldset"):  # some pages are one form
                out[k] = above
        elif e.hint == "comment" or (e.hint == "bad" and not wide):
            out[k] = "bad"
        elif e.hint in ("article", "main", "core"):
            order = ("core", "main", "article")
            out[k] = e.hint if above not in order or order.index(e.hint) > order.index(above) else above
        else:
            out[k] = above
        if words[k]:
            found.add(out[k])
    best = next((h for h in ("article", "main", "core") if h in found), None)
    if best is None:
        return [c if c in ("never", "bad") else "" for c in out]
    # Text of main that stands beside its article is neither core nor outside.
    return [c if c in ("never", "bad") else "core" if c == best else "" if c else "outside" for c in out]


LABELS = {"core": 1, "never": 0, "bad": 0}


def main_text(body: str, weights: np.ndarray) -> str:
    """The main text of a page: kept blocks in page order, joined by a line feed."""
    page = read_page(body)
    blocks, elements = page.blocks, page.elements
    if not blocks:
        return ""
    said = context(page)
    prior = {"core": CORE, "outside": -OUTSIDE, "bad": -HINT, "": 0.0}
    odds = np.clip(features(np.array([pattern(b, elements[b.element].tag) for b in blocks])) @ weights, -MOST, MOST)
    gain = [
        -SURE if said[b.element] == "never" else math.floor(UNIT * (o + prior[said[b.element]]))
        for b, o in zip(blocks, odds.tolist())
    ]
    edges = []
    beside: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if k:
            near = _steps(elements, blocks[k - 1].element, b.element)
            edges.append((k - 1, k, int(UNIT * NEAR / (1 + near))))
        container = elements[b.element].parent
        if container in beside:
            edges.append((beside[container], k, int(UNIT * SIBLING)))
        beside[container] = k
    kept = min_cut(gain, edges)
    return "\n".join(b.text for b, yes in zip(blocks, kept) if yes)


def learn(pages: DataFrame, html: str = "html", sample: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights of the block classifier, fitted on the ``sample`` distinct pages with the least hash.

    Labels come from the pages' own markup: blocks in the main container, and
    blocks in navigation, footers, forms and the like.  Only counts of patterns
    (at most 9 * 4 * 4 * 2 * 5 * 2) come to the driver.
    """
    own = pages.select(F.col(html).alias("html"), F.xxhash64(html).alias("hash"))
    least = [r["hash"] for r in own.select("hash").distinct().orderBy("hash").limit(sample).collect()]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for h, body in zip(batch.column("hash").to_pylist(), texts(batch, "html")):
                page = read_page(body)
                said = context(page)
                rows += [
                    (h, *pattern(b, page.elements[b.element].tag), LABELS[said[b.element]]) for b in page.blocks if said[b.element] in LABELS
                ]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64() if k == 0 else pa.int32()) for k, c in enumerate(zip(*rows))],
                    names=["hash", *"abcde", "label"],
                )

    found = own.filter(F.col("hash") <= (least[-1] if least else 0)).mapInArrow(run, "hash long, a int, b int, c int, d int, e int, label int")
    # A pattern weighs as much as there are distinct pages with it, so copies of a page count once.
    counts = found.groupBy(*"abcde", "label").agg(F.count_distinct("hash").alias("n")).collect()
    seen = np.array([r[:5] for r in counts], np.int64).reshape(-1, 5)
    return fit(seen, np.array([r["label"] for r in counts], float), np.array([r["n"] for r in counts], float))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its whole main text, empty if it has none.

    A null or empty page has none; broken markup is read as browsers read it;
    a repeated row is answered as often as it comes; null ids and urls stay;
    other columns are not read; an empty table gives an empty result.  White
    space of any kind inside a block becomes one space, line breaks (br) too.
    ``weights`` of an earlier :func:`learn` save fitting again.
    """
    model = learn(pages, html) if weights is None else weights

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [main_text(body, model) for body in texts(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = {c: own.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return own.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


@query("op13_html_extraction")
def html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
