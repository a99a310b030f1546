"""Main text of web pages by wrapper induction.

1. Each page becomes a tree. Pages of a host whose containers have the same paths are one
   layout; the pattern is a page of the layout's most frequent shape. Layouts of fewer than
   ``PAGES`` different pages, and pages without text, go with the host's most frequent layout
   that has text. Every different page is aligned with its pattern by simple tree matching
   (most nodes matched in order, labels equal). A node of the pattern whose own text is the same
   in most aligned pages is template; where texts vary there is a content slot.
2. The layout's content node is the deepest one that covers ``COVER`` of the text in varying
   slots, or the outermost article or main part around it.
3. A page's text is its blocks under that content node. Menus, headers, footers, side
   bars, notices, adverts, forms, comments and code are left out by their tags, roles and
   class words. Pages the wrapper does not fit use their own article or main part, or else
   all blocks that are not template. Inside an article, too, blocks are left out whose texts
   most pages of the layout hold at the same path (``INSIDE`` pages at least).

Pages are parsed where they are scanned. Only skeletons (labels and hashes) are shuffled to
learn a wrapper, and only extracted blocks to apply it.

Defined cases: null or empty html gives an empty text; broken markup is closed as browsers
would; a page without a usable url belongs to host ``''``; equal pages of a host count
once in the wrapper; repeated rows are extracted each; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .store import saved

COVER = 0.7
# aligned pages and share of them that make a text template
PAGES, SAME = 3, 0.6
# inside an article a text is template on so many pages at least: few pages may share a heading
INSIDE = 5

# Element names and class words, as used in markup.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title iframe noscript template xmp noembed noframes svg object".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
             "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
             "section select summary table tbody td tfoot th thead tr ul".split())
DROPPED = set("head nav footer aside form button select input dialog canvas audio video map fieldset".split())
# a list by this name is a menu of the page, or a list of the article it stands in
OUTER = {"menu"}
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                    "toolbar".split())
DROPPED_WORDS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies "
                    "consent gdpr nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments "
                    "commentlist reply replies disqus share sharing social related recommended newsletter subscribe "
                    "signup login popup modal pagination pager toolbar masthead skip notice notices".split())
# these name parts of an article too, so they count only outside of one
OUTER_WORDS = set("header banner widget side rail".split())
MAIN = {"article", "main"}
# the elements that make a page's layout
CONTAINERS = set("html body center div section article main nav header footer aside form table".split())
# an open element of the key is closed by the start of one of these
CLOSED_BY = {"p": BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"},
             "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
             "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
             "th": {"td", "th", "tr", "tbody", "tfoot"}}
# an implied end does not reach beyond these
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "p": {"td", "th", "table", "button", "li"}, "option": {"select"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?"
                    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|[^<]+|<", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_FIGURES = re.compile(r"[0-9]+")
# what an implied end may close or stop at: other open elements are passed by
_EDGES = BLOCKS | set(CLOSED_BY) | set().union(*SCOPES.values())


class Node:
    """An element. ``label`` is its name with its classes, figures in them made equal, so that
    a class made from a page's number is the same on all pages. ``edge`` is the nearest
    element from here upwards that an implied end may close; ``main`` tells whether a main
    part lies below, ``wraps`` whether a form stands around the page."""
    __slots__ = ("tag", "label", "kinds", "words", "role", "hidden", "kids", "up", "edge", "main", "wraps", "volume")

    def __init__(self, tag: str, up, attrs: str = ""):
        self.tag, self.up, self.kids, self.volume = tag, up, [], 0
        self.edge = self if up is None or tag in _EDGES else up.edge
        self.label, self.kinds, self.words, self.role, self.hidden = tag, (), (), "", False
        self.main = self.wraps = False
        if attrs and not attrs.isspace():
            found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(attrs)}
            kind = found.get("class", "")
            self.kinds = kind.lower().split()
            if self.kinds:
                self.label = f"{tag}.{' '.join(sorted({_FIGURES.sub('#', k) for k in self.kinds}))}"
            self.words = _WORD.findall(f"{kind} {found.get('id', '')}".lower())
            self.role = found.get("role", "").lower()
            self.hidden = ("hidden" in found or found.get("aria-hidden") == "true"
                           or "display:none" in found.get("style", "").replace(" ", "").lower())


def parse(page: str) -> Node:
    """Tree of a page: ``kids`` holds nodes and texts in order."""
    root = here = Node("#", None)
    forms: list[Node] = []
    open_: dict[str, int] = {}
    at, size = 0, len(page)

    def leave(to: Node) -> None:
        nonlocal here
        while here is not to:
            open_[here.tag] -= 1
            here = here.up
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        close, tag = m[1], m[2]
        if tag:
            tag = tag.lower()
            node = here.edge
            while node.up is not None:  # implied ends
                if tag in CLOSED_BY.get(node.tag, ()):
                    leave(node.up)
                elif node.tag in SCOPES.get(tag, ()) or node.tag in BLOCKS and node.tag not in CLOSED_BY:
                    break
                node = node.up.edge
            new = Node(tag, here, m[3] or "")
            here.kids.append(new)
            if tag == "form":
                forms.append(new)
            if tag in MAIN or new.role == "main":
                node = here
                while node is not None and not node.main:
                    node.main, node = True, node.up
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = page.find(">", end.start()) + 1 or size if end else size
            elif tag not in VOID and not (m[3] or "").endswith("/") or tag in BLOCKS - VOID:
                here = new
                open_[tag] = open_.get(tag, 0) + 1
        elif close:
            close = close.lower()
            if open_.get(close):
                node = here
                while node.tag != close:
                    node = node.up
                leave(node.up)
        elif m[0][0] != "<" or m[0] == "<":
            here.kids.append(m[0])
    if forms:
        _weigh(root)
        for form in forms:
            form.wraps = form.main or 2 * form.volume > root.volume
    return root


def _hash(text: str, size: int = 8) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=size).digest(), "little", signed=True)


def _path(around: int, label: str) -> int:
    """Hash of a path: of the path around, 0 at the top, and one label more."""
    return _hash(f"{around}/{label}")


def _slot(path: int, words: int) -> int:
    """Hash of a node's path and of its own text's hash."""
    return _hash(f"{path}\0{words}")


def _plain(text: str) -> str:
    return _SPACE.sub(" ", entities.unescape(text)).strip()


def _weigh(root: Node) -> None:
    """Characters of text in and below each node, without parts that are never text."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.volume = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        stack.extend(k for k in node.kids if isinstance(k, Node))
    for node in reversed(order):
        if node.up is not None and node.tag not in RAW and (node.tag not in DROPPED or node.tag == "form"):
            node.up.volume += node.volume


def _dropped(node: Node, inside: bool) -> bool:
    """Whether the node is not part of the main text. ``inside``: it lies in an article,
    where ids and parts of class names are made from headings and say nothing."""
    if node.tag == "form" and not node.hidden:
        # a form around the page holds the main part, or more than half of the text
        return not node.wraps
    if node.tag in RAW or node.tag in DROPPED or node.tag in OUTER and not inside or node.hidden:
        return True
    if node.tag in ("html", "body") or node.role == "main" or node.tag == "main":
        return False
    bad = node.role in DROPPED_ROLES or node.tag == "header" and not inside or any(
        w in DROPPED_WORDS for w in (node.kinds if inside else node.words)) or not inside and any(
        w in OUTER_WORDS for w in node.words)
    return bad and not node.main


class Block:
    __slots__ = ("main", "parts", "keys")

    def __init__(self, main):
        self.main, self.parts, self.keys = main, [], set()


def blocks(root: Node) -> tuple[list[tuple[int, str, list[int]]], list[tuple[int, int, int]]]:
    """Text blocks in page order: number of the article or main part they lie in (0: none),
    the text, and for those in one the slots of its nodes; and the nodes around blocks: hash
    of the path, first block and the one after the last."""
    out: list[Block] = [Block(0)]
    around: list[list[int]] = []
    mains = 0
    # (node, path, main) to enter; a text; or the end of a block with its place in `around`
    stack: list = [(root, 0, 0)]
    while stack:
        node, path, main = stack.pop()
        if isinstance(node, str):
            out[-1].parts.append(node)
            if path is not None and not node.isspace():
                out[-1].keys.add(path)
            continue
        if node is None:
            if path is not None:
                around[path][2] = len(out)
            out.append(Block(main))
            continue
        own = path
        inner = main
        if node.up is not None:
            if node.tag == "br":
                out[-1].parts.append(" ")
                continue
            if _dropped(node, main > 0):
                if node.tag in BLOCKS:
                    out.append(Block(main))
                else:
                    out[-1].parts.append(" ")
                continue
            if (node.tag in MAIN or node.role == "main") and not main:
                mains += 1
                inner = mains
            own = _path(path, node.label)
        if node.up is None or node.tag in BLOCKS:
            place = None
            # a block without others in it is not around itself
            if node.up is not None and any(isinstance(k, Node) and k.tag in BLOCKS for k in node.kids):
                place = len(around)
                around.append([own, len(out), 0])
            out.append(Block(inner))
            stack.append((None, place, main))
        text = _plain(" ".join(k for k in node.kids if isinstance(k, str))) if inner else ""
        key = _slot(own, _hash(text, 4)) if text else None
        for kid in reversed(node.kids):
            stack.append((kid, key if isinstance(kid, str) else own, inner))
    texts = [_plain("".join(b.parts)) for b in out]
    left = np.append(0, np.cumsum([bool(t) for t in texts])).tolist()  # blocks with text before each
    told = [(b.main, t, sorted(b.keys)) for b, t in zip(out, texts) if t]
    return told, [(path, left[low], left[high]) for path, low, high in around if left[low] < left[high]]


def skeleton(root: Node) -> tuple[list[int], list[str], list[int], list[int]]:
    """Depth, label, hash of own text and its length, of all nodes in page order. Left-out
    parts are one node each."""
    depth, label, text, size = [], [], [], []
    stack = [(root, 0, False)]
    while stack:
        node, level, inside = stack.pop()
        own = _plain(" ".join(k for k in node.kids if isinstance(k, str)))
        depth.append(level)
        label.append(node.label)
        text.append(_hash(own, 4) if own else 0)
        size.append(len(own))
        if node.up is not None and _dropped(node, inside):
            continue
        inside = inside or node.tag in MAIN
        stack.extend((k, level + 1, inside) for k in reversed(node.kids) if isinstance(k, Node))
    return depth, label, text, size


def frame(root: Node) -> int:
    """Hash of a page's layout: the different paths of its containers, outside of articles and
    left-out parts. 0 for a page without text."""
    paths, full, stack = set(), False, [(root, 0)]
    while stack:
        node, path = stack.pop()
        full = full or any(isinstance(k, str) and not k.isspace() for k in node.kids)
        if node.up is not None:
            gone = _dropped(node, False)
            if node.tag in CONTAINERS or gone:
                path = _hash(f"{path}/{node.label}")
                paths.add(path)
            if gone:
                continue
            if node.tag in MAIN:
                full = full or _holds_text(node)
                continue
        stack.extend((k, path) for k in node.kids if isinstance(k, Node))
    return _hash(" ".join(map(str, sorted(paths)))) or 1 if full else 0


def _holds_text(node: Node) -> bool:
    stack = [node]
    while stack:
        node = stack.pop()
        if any(isinstance(k, str) and not k.isspace() for k in node.kids):
            return True
        stack.extend(k for k in node.kids if isinstance(k, Node))
    return False


class Tree:
    """A skeleton with children and, for equal shapes, equal ``shape`` numbers."""

    def __init__(self, depth: list[int], label: list[str], shapes: dict):
        self.label = label
        self.kids: list[list[int]] = [[] for _ in depth]
        last: list[int] = []
        for k, d in enumerate(depth):
            del last[d:]
            if last:
                self.kids[last[-1]].append(k)
            last.append(k)
        self.size = [1] * len(depth)
        self.shape = [0] * len(depth)
        for k in range(len(depth) - 1, -1, -1):
            self.size[k] += sum(self.size[c] for c in self.kids[k])
            form = (label[k], *(self.shape[c] for c in self.kids[k]))
            self.shape[k] = shapes.setdefault(form, len(shapes) + 1)


def match(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Pairs of nodes of the best simple tree matching: a node matches one of equal label,
    its children match in order, and most nodes match."""
    best: dict[tuple[int, int], int] = {}

    def ready(x: int, y: int) -> int | None:
        """Nodes that match below a pair, or nothing while its children's are not known."""
        if a.label[x] != b.label[y]:
            return 0
        if not a.kids[x] or not b.kids[y]:
            return 1
        if a.shape[x] == b.shape[y]:
            return a.size[x]
        return best.get((a.shape[x], b.shape[y]))  # equal shapes match alike

    def weight(x: int, y: int) -> int:
        if (w := ready(x, y)) is not None:
            return w
        stack = [(x, y)]  # no recursion: pages may be nested deeper than Python's stack
        while stack:
            m, n = stack[-1]
            if ready(m, n) is None:
                kx, ky = a.kids[m], b.kids[n]
                if missing := [(i, j) for i in kx for j in ky if ready(i, j) is None]:
                    stack.extend(missing)
                    continue
                best[a.shape[m], b.shape[n]] = 1 + table(kx, ky)[-1][-1]
            stack.pop()
        return best[a.shape[x], b.shape[y]]

    def table(kx: list[int], ky: list[int]) -> list[list[int]]:
        rows = [[0] * (len(ky) + 1)]
        for x in kx:
            above, row = rows[-1], [0]
            for k, y in enumerate(ky):
                w = weight(x, y)
                row.append(max(row[-1], above[k + 1], above[k] + w))
            rows.append(row)
        return rows

    pairs, todo = [], [(0, 0)] if a.label[0] == b.label[0] else []
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        kx, ky = a.kids[x], b.kids[y]
        if not kx or not ky:
            continue
        if a.shape[x] == b.shape[y]:
            todo.extend(zip(kx, ky))
            continue
        rows = table(kx, ky)
        i, j = len(kx), len(ky)
        while i and j:
            w = weight(kx[i - 1], ky[j - 1])
            if w and rows[i][j] == rows[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                todo.append((kx[i], ky[j]))
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return pairs


def _pack(bones: tuple) -> bytes:
    """A skeleton in few bytes: equal skeletons have equal bytes. Labels hold no line break:
    their classes are cut at white space."""
    depth, label, text, size = bones
    parts = [np.array(depth, "<u4").tobytes(), np.array(text, "<i4").tobytes(), np.array(size, "<u4").tobytes(),
             "\n".join(label).encode("utf-8", "surrogatepass")]
    return len(depth).to_bytes(4, "little") + zlib.compress(b"".join(parts), 6)


def _unpack(raw: bytes) -> tuple[list[int], list[str], np.ndarray, np.ndarray]:
    n, raw = int.from_bytes(raw[:4], "little"), zlib.decompress(raw[4:])
    return (np.frombuffer(raw, "<u4", n).tolist(), raw[12 * n:].decode("utf-8", "surrogatepass").split("\n"),
            np.frombuffer(raw, "<i4", n, 4 * n), np.frombuffer(raw, "<u4", n, 8 * n))


def _skeletons(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pages in frames:
        rows = []
        for page in pages["html"]:
            root = parse(page if isinstance(page, str) else "")
            bones = skeleton(root)
            rows.append((frame(root), _hash("\n".join(f"{d}{own}" for d, own in zip(*bones[:2]))), _pack(bones)))
        yield pd.DataFrame({"host": pages["host"].to_numpy(), "page_id": pages["page_id"].to_numpy(),
                            "frame": [r[0] for r in rows], "shape": [r[1] for r in rows], "bones": [r[2] for r in rows]})


def _aligned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each node of a pattern: pages aligned, pages of the same text, text seen."""
    for frame in frames:
        for (host, layout), part in frame.groupby(["host", "layout"]):
            shapes: dict = {}
            depth, label, words, _ = _unpack(part["pattern"].iloc[0])
            pattern = Tree(depth, label, shapes)
            n = np.zeros((len(words), 3), np.int64)
            for raw in part["bones"]:
                depth, label, own, size = _unpack(raw)
                for x, y in match(pattern, Tree(depth, label, shapes)):
                    n[x] += (1, words[x] == own[y], 0 if words[x] == own[y] else size[y])
                if len(shapes) > 100_000:  # only a memo: start it afresh with the pattern
                    shapes.clear()
                    depth, label, words, _ = _unpack(part["pattern"].iloc[0])
                    pattern = Tree(depth, label, shapes)
            at = np.flatnonzero(n[:, 0])
            yield pd.DataFrame({"host": host, "layout": layout, "node": at, "pages": n[at, 0], "same": n[at, 1], "text": n[at, 2]})


def _slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The different slots inside articles and main parts, of each page."""
    for pages in frames:
        hosts, layouts, slots = [], [], []
        for host, layout, raw in zip(pages["host"], pages["layout"], pages["bones"]):
            depth, label, words, _ = _unpack(raw)
            found, path, within = set(), [], 0  # depth of the main part around, 0 if there is none
            for d, tag, own in zip(depth, label, words.tolist()):
                del path[d:]
                path.append(_path(path[-1], tag) if d else 0)
                if d <= within:
                    within = 0
                if not within and d and tag.split(".")[0] in MAIN:
                    within = d
                if within and own:
                    found.add(_slot(path[-1], own))
            hosts += [host] * len(found)
            layouts += [layout] * len(found)
            slots += found
        yield pd.DataFrame({"host": pd.Series(hosts, dtype=object), "layout": np.array(layouts, np.int64),
                            "slot": np.array(slots, np.int64)})


def _wrapper(bones: bytes, counts) -> tuple[int, bool, list[int]]:
    """Content node (hash of its path, 0 if there is none), whether it is an article or
    main part, and template texts of one host."""
    depth, label, words, _ = _unpack(bones)
    pages, same, text = np.zeros((3, len(depth)), np.int64)
    for row in counts if counts is not None else ():
        pages[row["node"]], same[row["node"]], text[row["node"]] = row["pages"], row["same"], row["text"]
    # paths of labels: number of the path around, label, depth, and text below
    known: dict[tuple[int, str], int] = {}
    ups, names, deep, own, chain = [-1], [""], [0], [], []
    for d, tag in zip(depth, label):
        del chain[d:]
        here = 0
        if chain:
            here = known.setdefault((chain[-1], tag), len(ups))
            if here == len(ups):
                ups.append(chain[-1])
                names.append(tag)
                deep.append(d)
        chain.append(here)
        own.append(here)
    fixed = (pages >= PAGES) & (same >= SAME * pages) & (words != 0)
    text[fixed] = 0
    under = [0] * len(ups)
    for here, size in zip(own, text.tolist()):
        if here:  # the nodes around a text, not the text's own node
            under[ups[here]] += size
    for here in range(len(ups) - 1, 0, -1):
        under[ups[here]] += under[here]
    whole = int(text.sum())
    content, main = 0, False
    if whole:
        at = max((k for k in range(len(ups)) if under[k] >= COVER * whole), key=lambda k: deep[k], default=0)
        steps = []
        while at:
            steps.append(names[at])
            at = ups[at]
        for step in reversed(steps):
            content = _path(content, step)
            if step.split(".")[0] in MAIN:
                main = True
                break
    return content, main, words[fixed].tolist()


def _wrapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        made = [_wrapper(raw, counts) for raw, counts in zip(frame["pattern"], frame["counts"])]
        yield pd.DataFrame({"host": frame["host"].to_numpy(), "layout": frame["layout"].to_numpy(), "content": [m[0] for m in made],
                            "content_main": [m[1] for m in made], "fixed": [m[2] for m in made]})


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, frame, content, content_main, fixed, slots`` from ``host, page_id, html``, one row for
    each layout of a host."""
    # equal pages count once; patterns are a table of their own, so that the join below can
    # split a host that holds a large part of all pages
    kinds = saved(pages.select("host", "page_id", "html").mapInPandas(
        _skeletons, "host string, page_id bigint, frame bigint, shape bigint, bones binary")
        .groupBy("host", "frame", "shape", "bones").agg(F.min("page_id").alias("page_id")), "skeletons")
    # a layout of too few pages to learn from goes with the host's most frequent one
    sizes = saved(kinds.groupBy("host", "frame").agg(F.count(F.lit(1)).alias("n")), "layouts")
    most = sizes.groupBy("host").agg(F.max_by("frame", F.struct(F.col("frame") != 0, "n", "frame")).alias("most"))
    uses = saved(sizes.join(most, "host").select("host", "frame", F.when(
        (F.col("frame") != 0) & (F.col("n") >= PAGES), F.col("frame")).otherwise(F.col("most")).alias("layout")), "uses")
    # the pattern has the most frequent shape of its layout
    shapes = kinds.groupBy("host", F.col("frame").alias("layout"), "shape").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("page_id", "bones"), F.struct("page_id", "bones")).alias("page"))
    pattern = saved(shapes.join(uses.select("host", "layout").distinct(), ["host", "layout"]).groupBy("host", "layout").agg(
        F.min_by("page.bones", F.struct(-F.col("n"), "page")).alias("pattern")), "patterns")
    node = F.struct("node", "pages", "same", "text")
    counts = (kinds.select("host", "frame", "bones").join(uses.join(pattern, ["host", "layout"]), ["host", "frame"])
              .select("host", "layout", "bones", "pattern").mapInPandas(
        _aligned, "host string, layout bigint, node int, pages bigint, same bigint, text bigint")
        .groupBy("host", "layout", "node").agg(*[F.sum(c).alias(c) for c in ("pages", "same", "text")])
        # at most the nodes of one page
        .groupBy("host", "layout").agg(F.collect_list(node).alias("counts")))
    made = pattern.join(counts, ["host", "layout"], "left").mapInPandas(
        _wrapped, "host string, layout bigint, content bigint, content_main boolean, fixed array<int>")
    # texts that most pages of a layout hold at the same place inside their article
    inner = (kinds.select("host", "frame", "bones").join(uses, ["host", "frame"]).select("host", "layout", "bones")
             .mapInPandas(_slots, "host string, layout bigint, slot bigint")
             .groupBy("host", "layout", "slot").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= INSIDE))
    whole = sizes.join(uses, ["host", "frame"]).filter("frame <> 0").groupBy("host", "layout").agg(F.sum("n").alias("n"))
    slots = inner.join(whole, ["host", "layout"]).filter(F.col("pages") >= SAME * F.col("n")).groupBy("host", "layout").agg(
        F.collect_list("slot").alias("slots"))
    told = made.join(slots, ["host", "layout"], "left")
    return saved(uses.join(told, ["host", "layout"]).drop("layout"), "wrappers")


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pages in frames:
        rows, layouts = [], []
        for page in pages["html"]:
            root = parse(page if isinstance(page, str) else "")
            found, around = blocks(root)
            layouts.append(frame(root))
            volume: dict[int, int] = {}
            for main, text, _ in found:
                volume[main] = volume.get(main, 0) + len(text)
            volume.pop(0, None)
            chosen = max(volume, key=lambda m: (volume[m], -m)) if volume else -1
            rows.append(([{"at": k, "main": main == chosen, "words": _hash(text, 4), "text": text, "slots": slots}
                          for k, (main, text, slots) in enumerate(found)],
                         [{"path": path, "low": low, "high": high} for path, low, high in around]))
        yield pd.DataFrame({"page_id": pages["page_id"].to_numpy(), "url": pages["url"].to_numpy(),
                            "host": pages["host"].to_numpy(), "frame": layouts, "blocks": [r[0] for r in rows],
                            "around": [r[1] for r in rows]})


def host(url: Column) -> Column:
    """Lower-case host of an address; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``page_id, url, html``."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    cut = own.mapInPandas(_blocks, "page_id bigint, url string, host string, frame bigint, blocks array<struct<at: int, "
                                   "main: boolean, words: int, text: string, slots: array<bigint>>>, "
                                   "around array<struct<path: bigint, low: int, high: int>>")
    fitted = cut.join(wrappers(own), ["host", "frame"], "left")
    nodes = F.filter("around", lambda n: n["path"] == F.col("content"))
    under = F.filter("blocks", lambda b: F.exists(F.col("nodes"), lambda n: (n["low"] <= b["at"]) & (b["at"] < n["high"])))
    inside = F.filter("blocks", lambda b: b["main"])
    other = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("fixed", b["words"]), F.lit(False)))
    varied = F.filter(under, lambda b: ~F.array_contains("fixed", b["words"]))
    known = F.coalesce("slots", F.array().cast("array<bigint>"))

    def own_text(part: Column) -> Column:
        """Blocks in which not all is template; all of them if nothing else is left."""
        left = F.filter(part, lambda b: (F.size(b["slots"]) == 0) | F.exists(
            b["slots"], lambda k: ~F.array_contains(known, k)))
        return F.when(F.size(left) > 0, left).otherwise(part)
    chosen = (F.when(F.col("content_main") & (F.size(under) > 0), own_text(under)).when(F.size(inside) > 0, own_text(inside))
              .when(F.size(varied) > 0, varied).otherwise(other))
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), "\n")
    return fitted.withColumn("nodes", nodes).select("page_id", "url", text.alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("bigint"))
