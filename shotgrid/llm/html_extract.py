"""Main-text extraction by wrapper induction over the pages of a host.

1. Every page becomes a small DOM tree; its outline (tags with class and id,
   text lengths and hashes, no text) is what induction moves.
2. Each host has a pivot page. The outline of every page of the host is aligned
   with the pivot's by simple tree matching (equal labels, order kept, most
   nodes matched); hosts with very many pages are dealt to many tasks, each
   with one copy of the pivot, and only sums for the pivot's nodes leave a task.
3. Of the summed alignments, nodes whose text stays the same on nearly all
   pages of different content (``CONSTANT`` of at least ``MIN_PAGES``) are
   template, known by their slot: the labels from the page's root down, and the
   text. Pages of equal text in their content root, links left out, count once;
   where template would hold more than half of the pivot's text outside links,
   the pages are copies with other surroundings, and the host has no template.
   Nodes that a class, id or role word marks as no article text are kept all
   the same where they hold ``DOMINANT`` of a host's text.
4. On hosts without article or main elements the alignment also gives the content
   slot: from the top down the one container that holds ``DOMINANT`` of the host's
   text outside links. Containers beside it that stand on nearly all pages, hold no
   paragraph or heading and on average less than ``SHORT`` of its text (links do
   not count) are template even where their words vary. On a page the slot is the heaviest
   child of its label; the children around it are matched with the host's by simple
   tree matching, and those on template go unless they hold words of the page's title only.
5. The wrapper (kept marks, template and content slots) is joined back to the pages.
   What is left of a page without template, marked and skipped nodes is its
   varying text. Its root is the article (or else main) element that holds
   ``DOMINANT`` of it, widened to take in every h1; without one, the root goes
   down from the top only while one container holds all of it, so that nothing
   but links is passed over. The root's text is taken block by block.

Character references are decoded, white space inside a block (line breaks
included) becomes one space, blocks are trimmed and joined by one line feed.

A form is no article text unless it stands around the page: around an article or
main element or, where no page element of that kind is outside it, around
``DOMINANT`` of the text in paragraphs and headings. Attributes are read by name.

Defined cases: no pages: no rows; null or empty html: empty text; broken, unclosed or cut-off
markup is read as far as it goes; a url without a host shares the wrapper of
all such urls; repeated rows each give a row; extra columns are not read.
"""

from __future__ import annotations

import html as htmllib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotgrid.llm.common import map_arrow, stash

CONSTANT = 0.8     # share of a host's different pages on which a template node has one text
MIN_PAGES = 5      # different pages a host needs before any node can be template
DOMINANT = 0.8     # share of the text an article or main element, or a kept mark, must hold
SHORT = 0.1        # share of the content slot's text that a template slot with varying words may hold on average
CHUNK = 256        # pages aligned with one copy of the pivot
DEPTH = 256        # nesting beyond this is read as if it were at this depth (as browsers do)
CELLS = 1 << 16    # pairs of children whose matches are kept in memory; of longer lists the same are found row by row
COMMON = 64        # children of a long list with one text before it counts as common (speed, not results)

# HTML's void elements, elements without text, blocks and containers.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed xmp".split())
SKIP = frozenset("script style noscript template iframe svg canvas object audio video form button select option "
                 "input textarea label fieldset nav menu footer aside head title dialog noembed xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary "
                  "table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("html body main article section div center table tbody tr td form".split())
SURROUNDING = frozenset("div section center table span ul ol dl".split())    # may be template with varying words
CLOSES_P = BLOCK - {"body", "html"}
HEADS = frozenset(("h1", "h2"))    # their text counts in links too
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
WEAK = frozenset(("side", "alert"))    # marks that do not count on a paragraph of an article
UNMARKED = frozenset("html body main article".split())
# Whole words of a class, id or role that mark what is no article text.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar side menu nav "
                  "navbar navigation breadcrumb breadcrumbs header masthead footer foot comment comments respond reply "
                  "replies disqus cookie cookies consent notice notices alert popup modal newsletter subscribe signup "
                  "login share sharing social related recommended widget toolbar pagination pager copyright".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
                  re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)(?:</title|\Z)", re.I | re.S)
_SPACE = re.compile(r"\s+")


class Node:
    """An element: ``label`` is its tag with class and id words, ``items`` its children and texts in order.

    ``skip``: never article text; ``mark``: a class, id or role word says so.
    """

    __slots__ = ("tag", "label", "items", "skip", "mark")

    def __init__(self, tag: str, label: str, skip: bool, mark: bool = False):
        self.tag, self.label, self.items, self.skip, self.mark = tag, label, [], skip, mark

    @property
    def nodes(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


def attributes(text: str) -> dict[str, str]:
    """The attributes of a tag by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), "".join(values))
    return out


def parse(html: str) -> Node:
    """A tolerant reading of HTML: void and raw elements, implied ends of blocks, unmatched ends ignored."""
    root = Node("#", "#", False)
    stack, at, forms = [root], 0, []
    for m in _TAG.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            stack[-1].items.append(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag), 0)
            if depth:
                del stack[depth:]
            continue
        if tag in CLOSES_P:
            _close(stack, "p", BLOCK - {"p"})
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            _close(stack, tag, frozenset(("ul", "ol", "dl", "table", "select")) | (frozenset(("tr",)) if tag in ("td", "th") else frozenset()))
        names = attributes(m[3]) if m[3] else {}
        words = [w for k in ("class", "id", "role") if k in names for w in names[k].lower().split()]
        hidden = bool(names) and ("hidden" in names or names.get("aria-hidden", "").strip().lower() == "true"
                                  or bool(_NONE.search(names.get("style", ""))))
        mark = tag not in UNMARKED and not MARKS.isdisjoint(words)
        skip = hidden or tag in SKIP
        if skip or mark or tag == "header":
            inside = any(n.tag in ("article", "main") for n in stack)
            skip = hidden or (tag in SKIP and not (inside and tag in ("label", "fieldset"))) or (tag == "header" and not inside)
            mark = mark and not (inside and tag == "p" and WEAK.issuperset(MARKS.intersection(words)))
        node = Node(tag, ".".join([tag, *sorted(set(words))]), skip, mark)
        stack[-1].items.append(node)
        if tag == "form" and not hidden:
            forms.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not m[3].endswith("/") and len(stack) < DEPTH:
            stack.append(node)
    if at < len(html):
        stack[-1].items.append(html[at:])
    if forms:
        see_through(root, forms)
    unmark(root)
    return root


def see_through(root: Node, forms: list[Node]) -> None:
    """Forms around the page are no controls: they are read like any container."""
    def held(node):
        """(article and main elements, characters in paragraphs and headings) under a node."""
        bodies = prose = 0
        todo = [(node, False)]
        while todo:
            x, inside = todo.pop()
            if x.skip and x.tag != "form":
                continue
            bodies += x.tag in ("article", "main")
            inside = inside or x.tag in PROSE
            prose += sum(len(t.strip()) for t in x.items if isinstance(t, str)) if inside else 0
            todo += [(y, inside) for y in x.nodes]
        return bodies, prose

    bodies, prose = held(root)
    for form in forms:      # outer ones come first
        mine, text = held(form)
        form.skip = not (mine or (not bodies and prose and text >= DOMINANT * prose))


def unmark(root: Node) -> None:
    """Marks around the page's article or main elements do not count, unless others stand outside marks."""
    around, todo = [], [(root, ())]
    while todo:
        x, marked = todo.pop()
        if x.skip:
            continue
        if x.mark:
            marked = *marked, x
        if x.tag in ("article", "main"):
            if not marked:
                return
            around += marked
        todo += [(y, marked) for y in x.nodes]
    for x in around:
        x.mark = False


def _close(stack: list[Node], tag: str, barrier: frozenset) -> None:
    """End an open ``tag`` unless an element of ``barrier`` was opened inside it."""
    for d in range(len(stack) - 1, 0, -1):
        if stack[d].tag == tag:
            del stack[d:]
            return
        if stack[d].tag in barrier:
            return


def inner_text(node: Node) -> str:
    parts, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not x.skip and not x.mark:
            if x.tag in BLOCK or x.tag == "br":
                parts.append(" ")
            todo += reversed(x.items)
    return _SPACE.sub(" ", htmllib.unescape("".join(parts))).strip()


def outline(node: Node, seen: dict[int, tuple[int, int]] | None = None, above: int = 0) -> list:
    """[label, hash of all text, length of text outside links and marks, children, length with marks, mark], for induction.

    ``seen`` gets the slot (hash of the labels from the root, hash of all text) of every node by its identity.
    """
    here = below(above, node.label) if seen is not None else 0
    kids = [outline(n, seen, here) for n in node.nodes if n.tag not in ("script", "style", "head")]
    own = [s.strip() for s in node.items if isinstance(s, str)]
    chars = sum(map(len, own))
    none = node.skip or node.tag == "a"
    text = 0 if none or node.mark else chars + sum(k[2] for k in kids)
    full = 0 if none else chars + sum(k[4] for k in kids)
    whole = xxhash.xxh32_intdigest("\0".join(own + [str(k[1]) for k in kids if k[1]])) if any(own) or any(
        k[1] for k in kids) else 0
    if seen is not None:
        seen[id(node)] = here, whole
    return [node.label, whole, text, kids, full, int(node.mark)]


def below(slot: int, label: str) -> int:
    """The hash of a node's labels from the root, from that of its parent."""
    return xxhash.xxh64_intdigest(label, slot) >> 1


def content_key(root: Node) -> int:
    """Hash of the text outside links and marks below the page's own content root: equal for copies of an article."""
    out = left_out(root, [], {})
    parts, todo = [], [content_root(root, out)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append("".join(x.split()))
        elif id(x) not in out and x.tag != "a":
            todo += x.items
    return xxhash.xxh64_intdigest("\0".join(p for p in parts if p)) >> 1 if any(parts) else 0


def texts_of(node: list) -> set[int]:
    """The text hashes in an outline, that of no text left out."""
    out, todo = set(), [node]
    while todo:
        x = todo.pop()
        out.add(x[1])
        todo += x[3]
    return out - {0}


def aligned(x: list, y: list) -> tuple[float, list[tuple[int, int]]]:
    """What ``match`` finds for two long lists of children: (weight, places of matched children).

    The same table, filled a row at a time, of which only the steps back stay, compressed.
    Children that differ in texts alone which the pair does not share weigh the same, so each
    pair of such kinds is matched once; pairs with a text that is not common are matched themselves.
    """
    places = defaultdict(list)
    for j, q in enumerate(y):
        for h in texts_of(q):
            places[h].append(j)
    often = {h for h, at in places.items() if len(at) > COMMON}

    def kind(node, own):
        """Its outline with ``own`` for every text that is not common."""
        return [node[0], node[1] if not node[1] or node[1] in often else own, 0, [kind(k, own) for k in node[3]]]

    numbers: dict[str, int] = {}
    numbers_of = np.array([numbers.setdefault(json.dumps(kind(q, -2)), len(numbers)) for q in y])
    kinds = [json.loads(k) for k in numbers]
    known: dict[str, np.ndarray] = {}
    above, steps = np.zeros(len(y) + 1), []
    for p in x:
        mine = kind(p, -1)
        key = json.dumps(mine)
        if key not in known:
            if len(known) >= COMMON:
                known.clear()
            known[key] = np.array([match(mine, k)[0] if k[0] == p[0] else 0.0 for k in kinds])
        weigh = known[key][numbers_of]      # 0: other label
        for j in {j for h in texts_of(p) - often if h in places for j in places[h]}:
            if weigh[j]:
                weigh[j] = match(p, y[j])[0]
        row, both = np.zeros(len(y) + 1), np.where(weigh > 0, above[:-1] + weigh, -1.0)
        row[1:] = np.maximum.accumulate(np.maximum(above[1:], both))
        steps.append(zlib.compress(np.where(row[1:] == both, 2, row[1:] == above[1:]).astype(np.uint8).tobytes(), 1))
        above = row
    found, j = [], len(y)
    for i in range(len(x) - 1, -1, -1):
        back = zlib.decompress(steps[i])
        while j and not back[j - 1]:
            j -= 1
        if not j:
            break
        if back[j - 1] == 2:
            j -= 1
            found.append((i, j))
    return float(above[-1]), found


def match(a: list, b: list) -> tuple[float, list]:
    """Simple tree matching: (weight, pairs of matched nodes) of two outlines with equal labels.

    A matched node weighs 1 and half more when its text is equal too.
    """
    weight = 1.5 if a[1] == b[1] else 1.0
    x, y = a[3], b[3]
    if not x or not y:
        return weight, [(a, b)]
    if len(x) * len(y) > CELLS:
        total, places = aligned(x, y)
        return weight + total, [(a, b), *(pair for i, j in places for pair in match(x[i], y[j])[1])]
    best = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
    sub = {}
    for i, p in enumerate(x):
        row, above = best[i + 1], best[i]
        for j, q in enumerate(y):
            value = row[j] if row[j] > above[j + 1] else above[j + 1]
            if p[0] == q[0]:
                sub[i, j] = w = match(p, q) if p[3] and q[3] else (1.5 if p[1] == q[1] else 1.0, [(p, q)])
                if above[j] + w[0] > value:
                    value = above[j] + w[0]
            row[j + 1] = value
    pairs, i, j = [(a, b)], len(x), len(y)
    while i and j:
        if (i - 1, j - 1) in sub and best[i][j] == best[i - 1][j - 1] + sub[i - 1, j - 1][0]:
            pairs += sub[i - 1, j - 1][1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return weight + best[-1][-1], pairs


def numbered(tree: list) -> list:
    """The nodes of an outline in document order, each with its number as a further item."""
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        node.append(len(out))
        out.append(node)
        todo += reversed(node[3])
    return out


def induce(pivot: str, pages: dict[int, tuple[int, int, int]]) -> str:
    """The wrapper of a host as JSON: slots of marked nodes that are kept, and (slot, text hash, number) of template nodes.

    ``pages`` maps the number of a pivot node to (pages matched, pages with the
    pivot's text, characters outside links with marks, and without), summed over the host's pages.
    The wrapper's third item is the content slot.
    """
    tree = json.loads(pivot)
    nodes = numbered(tree)
    total, _, full, _ = pages.get(0, (0, 0, 0, 0))
    fixed = {n[-1] for n in nodes if n[1] and total >= MIN_PAGES and pages.get(n[-1], (0, 0, 0))[1] >= CONSTANT * total}
    top, kept, article, todo = [], [], False, [(tree, 0, False, True)]
    while todo:
        n, above, marked, varies = todo.pop()
        slot = below(above, n[0])
        if varies and n[-1] in fixed:
            top.append((slot, n))
            varies = False
        marked = marked or bool(n[5])
        article = article or (not marked and n[2] > 0 and n[0].split(".")[0] in ("article", "main"))
        if n[5] and full and pages.get(n[-1], (0, 0, 0))[2] >= DOMINANT * full:
            kept.append(slot)
        todo += [(k, slot, marked, varies) for k in n[3]]
    if 2 * sum(n[2] for _, n in top) > tree[2]:     # so much is an article's copies, and its headline with them
        top = []
    template = Counter((slot, n[1]) for slot, n in top)
    slot = [] if article or any(n[0].split(".")[0] in ("article", "main") for n in nodes) else content_slot(tree, pages, fixed)
    return json.dumps([[] if article else sorted(kept), sorted([*t, k] for t, k in template.items()), slot])


def left_out(root: Node, kept: list[int], template: dict[tuple[int, int], int]) -> set[int]:
    """Identities of the nodes that are no varying text: skipped, marked and not ``kept``, or in a template slot."""
    slots, out, todo = {}, set(), [root]
    if kept or template:
        outline(root, slots)
    rest, keep = dict(template), set(kept)
    while todo:
        x = todo.pop()
        slot = slots.get(id(x))
        if x.skip or (x.mark and not (slot and slot[0] in keep)):
            out.add(id(x))
        elif rest.get(slot):
            rest[slot] -= 1
            out.add(id(x))
        else:
            todo += reversed(x.nodes)
    return out


def weights(root: Node, out: set[int]) -> tuple[dict[int, int], dict[int, int], list[list[Node]]]:
    """By node: text outside links, and h1 elements; articles and mains with the nodes above them."""
    mass, heads, found = {}, {}, []

    def weigh(node, path, link, head):
        head = head or node.tag in HEADS
        link = link or node.tag == "a"
        path = [*path, node]
        if node.tag in ("article", "main"):
            found.append(path)
        text = sum(len(s.strip()) for s in node.items if isinstance(s, str)) if head or not link else 0
        n = 0
        for k in node.nodes:
            if id(k) not in out:
                weigh(k, path, link, head)
                text, n = text + mass[id(k)], n + heads[id(k)]
        mass[id(node)], heads[id(node)] = text, n + (node.tag == "h1" and text > 0)

    weigh(root, [], False, False)
    return mass, heads, found


def trimmed(node: list, depth: int = 2) -> list:
    """An outline's labels and text hashes down to ``depth``."""
    return [node[0], node[1], 0, [trimmed(k, depth - 1) for k in node[3]] if depth else []]


def plain(node: list) -> bool:
    """No paragraph and no heading in an outline."""
    todo = [node]
    while todo:
        x = todo.pop()
        if x[0].split(".")[0] in PROSE:
            return False
        todo += x[3]
    return True


def content_slot(tree: list, pages: dict[int, tuple], fixed: set[int]) -> list:
    """Of each container from the top to the host's content slot: [label, children before it, children after it].

    Children that stand on nearly all pages, as [outline, whether template].
    """
    total, levels, node = pages.get(0, (0,))[0], [], tree
    text = lambda n: pages[n[-1]][3] if n[-1] in pages else 0      # noqa: E731
    often = lambda n: n[-1] in pages and pages[n[-1]][0] >= CONSTANT * total      # noqa: E731
    while total >= MIN_PAGES:
        inner = [k for k in node[3] if k[0].split(".")[0] in CONTAINER and not k[5] and k[-1] not in fixed and often(k)]
        best = max(inner, key=text, default=None)
        if best is None or not text(best) or text(best) < DOMINANT * text(node):
            break
        at = next(i for i, k in enumerate(node[3]) if k is best)
        sides = [[[trimmed(k), k[0].split(".")[0] in SURROUNDING and text(k) <= SHORT * text(best) and plain(k)]
                  for k in side if k[0].split(".")[0] not in SKIP and not k[5] and k[-1] not in fixed and often(k)]
                 for side in (node[3][:at], node[3][at + 1:])]
        levels.append([best[0], *sides])
        node = best
    return levels if any(goes for _, *sides in levels for side in sides for _, goes in side) else []


def surroundings(root: Node, levels: list, out: set[int], mass: dict[int, int], title: str) -> set[int]:
    """Identities of a page's nodes that lie on template around the host's content slot."""
    gone, node = set(), root
    for label, *sides in levels:
        kids = [k for k in node.nodes if id(k) not in out and k.tag not in ("script", "style", "head")]
        same = [i for i, k in enumerate(kids) if k.label == label]
        if not same:
            break
        at = max(same, key=lambda i: mass[id(kids[i])])
        for known, side in zip(sides, (kids[:at], kids[at + 1:])):
            outlines = [outline(k) for k in side]
            tops = [["", 0, 0, [o for o, _ in known]], ["", 1, 0, [trimmed(o) for o in outlines]]]
            goes = {id(o) for o, template in known if template}
            places = {id(o): i for i, o in enumerate(tops[1][3])}
            for mine, found in match(*tops)[1]:
                i = places.get(id(found)) if id(mine) in goes else None
                if i is not None and plain(outlines[i]):
                    text = inner_text(side[i])
                    if not (text and text in title):
                        gone.add(id(side[i]))
        node = kids[at]
    return gone


def content_root(root: Node, out: set[int]) -> Node:
    """The node to read, of a page without the nodes in ``out``."""
    mass, heads, found = weights(root, out)
    for tag in ("article", "main"):
        for path in found:
            if path[-1].tag == tag and mass[id(path[-1])] >= max(DOMINANT * mass[id(root)], 1):
                return next(n for n in reversed(path) if heads[id(n)] == heads[id(root)])
    node = root
    while mass[id(node)]:
        step = next((n for n in node.nodes if n.tag in CONTAINER and id(n) not in out and mass[id(n)] == mass[id(node)]), None)
        if step is None:
            break
        node = step
    return node


def extract(html: str, kept: list[int], template: dict[tuple[int, int], int], slot: list = ()) -> str:
    page = parse(html)
    out = left_out(page, kept, template)
    if slot:
        mass, _, found = weights(page, out)
        if not found:
            title = _TITLE.search(html)
            out |= surroundings(page, slot, out, mass, _SPACE.sub(" ", htmllib.unescape(title[1])).strip() if title else "")
    root = content_root(page, out)
    blocks, now = [], []

    def flush():
        text = _SPACE.sub(" ", htmllib.unescape("".join(now))).strip()
        if text:
            blocks.append(text)
        now.clear()

    todo = [(x, False) for x in reversed(root.items)]
    while todo:
        x, end = todo.pop()
        if isinstance(x, str):
            now.append(x)
        elif end:
            flush()
        elif id(x) in out:
            flush() if x.tag in BLOCK else None
        elif x.tag in ("br", "wbr"):
            now.append(" ")
        else:
            if x.tag in BLOCK:
                flush()
                todo.append((x, True))
            todo += [(y, False) for y in reversed(x.items)]
    flush()
    return "\n".join(blocks)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def _outlines(batches):
    for batch in batches:
        trees, keys = [], []
        for html in batch.column(1).to_pylist():
            root = parse(html or "")
            tree = outline(root)
            trees.append(json.dumps(tree, separators=(",", ":")))
            keys.append(content_key(root) or tree[1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(trees, pa.string())],
                                         ["host", "page_key", "outline"])


def _align(batches):
    """Rows come sorted by (host, part, pivot first); sums for each pivot node leave at the end of a group."""
    state = {"key": None, "pivot": None, "sums": None}
    names = ["host", "node", "pages", "same", "chars", "text"]

    def taken(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 6))], names)

    def close():
        return [(state["key"][0], k, *v) for k, v in state["sums"].items()] if state["sums"] else []

    for batch in batches:
        rows = []
        for h, part, member, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (h, part) != state["key"]:
                rows += close()
                state.update(key=(h, part), pivot=None, sums=defaultdict(lambda: [0, 0, 0, 0]))
            if not member:
                state["pivot"] = json.loads(text)
                numbered(state["pivot"])
                continue
            for a, b in match(state["pivot"], json.loads(text))[1]:
                s = state["sums"][a[-1]]
                s[0] += 1
                s[1] += a[1] == b[1]
                s[2] += b[4]
                s[3] += b[2]
        yield taken(rows)
    yield taken(close())


def _wrappers(batches):
    for batch in batches:
        out = []
        for pivot, sums in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            out.append(induce(pivot, {s["node"]: (s["pages"], s["same"], s["chars"], s["text"]) for s in sums}))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["host", "wrapper"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from the alignment of each host's pages of different content with its pivot."""
    outlines = stash(map_arrow(pages.select(host(F.col("url")).alias("host"), "html"), _outlines,
                               "host string, page_key long, outline string"), "outlines")
    # pages of equal content once; the pivot is the page of the median size class nearest the mean, by length of its outline
    pages_of = outlines.groupBy("host", "page_key").agg(F.min("outline").alias("outline"))
    pages_of = stash(pages_of, "outlines")
    size = F.length("outline")
    hosts = pages_of.groupBy("host").agg(F.avg(size).alias("mean"), F.ceil(F.count("*") / CHUNK).alias("parts"))
    near = pages_of.join(hosts, "host").select(
        "host", "parts", "page_key", "outline", F.struct(F.abs(size - F.col("mean")).alias("off"), "page_key").alias("rank"))
    pivots = stash(near.groupBy("host").agg(F.min_by("outline", "rank").alias("outline"), F.first("parts").alias("parts")), "pivots")
    rows = (pages_of.join(pivots.select("host", "parts"), "host")
            .select("host", F.pmod(F.xxhash64("page_key"), "parts").alias("part"), F.lit(True).alias("member"), "outline")
            .union(pivots.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                                 F.lit(False), "outline"))
            .repartition("host", "part").sortWithinPartitions("host", "part", "member"))
    sums = (map_arrow(rows, _align, "host string, node long, pages long, same long, chars long, text long")
            .groupBy("host", "node").agg(*(F.sum(c).alias(c) for c in ("pages", "same", "chars", "text"))))
    per_host = (sums.groupBy("host").agg(F.collect_list(F.struct("node", "pages", "same", "chars", "text")).alias("sums"))  # one pivot's nodes
                .join(pivots.select("host", "outline"), "host").select("host", "outline", "sums"))
    return map_arrow(per_host, _wrappers, "host string, wrapper string")


def _extract(batches):
    known: dict[str, tuple] = {}
    for batch in batches:
        texts = []
        for html, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if wrapper not in known:
                if len(known) > 1000:
                    known.clear()
                kept, template, slot = json.loads(wrapper) if wrapper else ([], [], [])
                known[wrapper] = kept, {(path, text): n for path, text, n in template}, slot
            texts.append(extract(html or "", *known[wrapper]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row."""
    found = stash(wrappers(pages), "wrappers")
    rows = (pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
            .join(found, "host", "left").select("page_id", "url", "html", "wrapper"))
    return map_arrow(rows, _extract, "page_id long, url string, text string, n_chars long")
