"""Main-text extraction by wrapper induction over the pages of each host.

A page is parsed to a DOM tree, and the tree to a skeleton: adjacent siblings of one kind (tag, class, id, role) become one
node that stands for the run. All skeletons of a host are aligned by simple tree matching (the order-preserving alignment of
children that matches the most nodes) and merged to a wrapper, whose nodes know in how many pages they stand, whether their
text is the same in all of them (template) or varies (slot), and how much of it is link text. The wrapper decides what is
content: in each page every outermost node that is marked as an article (or as main text, where articles hold less than half of
it), else the node that holds the varying text, without the parts below whose
kind says menu, header, footer, sidebar, notice, advert, form, script or comment. In a marked root blocks go that are the same in all
pages that have it, unless they are more than half of its text, as in copies; words of class and id decide there only
where none of them says otherwise or they name comments or adverts, else what they name goes where it is constant or
at least half link text. A page that lacks its host's root has one of its own.

Skeletons and their statistics are summed inside each partition first, so that a host with a third of all pages is a few
rows a task; wrappers are then merged in two steps, first over SALTS parts of a host. Pages meet their wrapper by a join on the host,
broadcast only where all wrappers together are small.

Defined results: null or empty html, and pages without text, give an empty text; pages without a host share one
wrapper; repeated rows are repeated results; nothing is cut off at any length; nesting beyond DEEP levels is flattened
into its ancestor, without the parts that their kind drops.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.shared import cut, table
from marginalia.llm.urls import host_of

SALTS = 16
DEEP = 60
#: Bytes of wrappers that may be broadcast.
SENT = 32 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea noscript iframe xmp template".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul br caption option head".split())
_ENDS_P = _BLOCKS - {"br", "html", "body", "head", "title", "option", "caption"}
_SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_SCOPE = frozenset("article aside body div footer form header html main nav section table ul ol dl td th blockquote".split())

_DROPPED_TAGS = frozenset("head script style noscript template iframe svg canvas nav footer aside form button select option input textarea dialog menu object embed audio video map label fieldset".split())
_DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navigation navbar menu breadcrumb breadcrumbs "
    "sidebar side aside widget footer foot copyright masthead topbar toolbar comment comments reply replies disqus respond cookie cookies consent gdpr notice notices "
    "alert popup modal overlay dialog share sharing social related recommended newsletter subscribe subscription signup login search pagination pager "
    "contentinfo complementary skip hidden form".split()
)
#: Of the dropped words, those of readers' comments and adverts: they vary from page to page as content does.
_FOREIGN_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored comment comments reply replies disqus respond".split())
#: Words that say where a node stands, not what it holds.
_PLACE_WORDS = frozenset("area bar block body bottom box container content group inner item items left links list main outer page panel post right row section site slot top unit wrap wrapper".split())
_ARTICLE_WORDS = frozenset("article articlebody main content post entry story maincontent".split())


class Node:
    __slots__ = ("kind", "children", "texts", "link")

    def __init__(self, kind: str, link: bool):
        self.kind, self.children, self.texts, self.link = kind, [], [], link


def _kind(tag: str, attributes: str) -> str:
    if not attributes.strip():
        return tag
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    words = sorted({w for k in found for w in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", found[k]).lower())})
    return f"{tag} {' '.join(words)}" if words else tag


def parse(text: str) -> Node:
    """The tree of a page. Texts are held in page order as (serial, text) at the node they stand in; a block's edge is the text None."""
    root = Node("html", False)
    stack, serial, at = [root], 0, 0
    tags = ["html"]
    held: Counter[str] = Counter()  # open tags by name
    size = len(text)
    while at < size:
        m = _TOKEN.match(text, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            found = m[0]
            if found[0] != "<" or found == "<":
                stack[-1].texts.append((serial, found))
                serial += 1
            continue
        tag = tag.lower()
        if m[1]:
            if held[tag]:
                while True:
                    stack.pop()
                    held[tags[-1]] -= 1
                    if tags.pop() == tag:
                        break
            if tag in _BLOCKS:
                stack[-1].texts.append((serial, None))
                serial += 1
            continue
        if tag in _BLOCKS:
            stack[-1].texts.append((serial, None))
            serial += 1
        if tag in ("html", "br"):
            continue
        ends = _SAME.get(tag, frozenset()) | ({"p"} if tag in _ENDS_P else frozenset())
        if any(held[e] for e in ends):
            k = len(tags) - 1
            while k > 0 and tags[k] not in ends and tags[k] not in _SCOPE:
                k -= 1
            if k > 0 and tags[k] in ends:
                held.subtract(tags[k:])
                del tags[k:], stack[k:]
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(text, at)
            at = end.end() if end else size
            continue
        kind = _kind(tag, m[3] or "")
        if len(stack) < DEEP:
            node = Node(kind, tag == "a" or stack[-1].link)
            stack[-1].children.append(node)
        else:
            # stands for its ancestor, so that its end tag closes nothing else; what is dropped by its kind hangs in no tree
            node = Node(kind, stack[-1].link) if _boiler(kind) else stack[-1]
        if not (m[3] or "").rstrip().endswith("/") or tag in _BLOCKS:
            stack.append(node)
            tags.append(tag)
            held[tag] += 1
    return root


class Skeleton:
    """A tree of kinds; runs of adjacent siblings of a kind are one node, which knows the page's nodes it stands for."""

    __slots__ = ("kind", "children", "members")

    def __init__(self, kind: str, members: list[Node]):
        self.kind, self.members, self.children = kind, members, []
        last = None
        for member in members:
            for child in member.children:
                if last is None or child.kind != last[0]:
                    last = (child.kind, [])
                    self.children.append(last)
                last[1].append(child)
        self.children = [Skeleton(*c) for c in self.children]

    def shape(self) -> str:
        return f"{self.kind}({','.join(c.shape() for c in self.children)})" if self.children else self.kind

    def walk(self) -> Iterator[Skeleton]:
        yield self
        for c in self.children:
            yield from c.walk()


def _slot(node: Skeleton) -> tuple[int, int, int]:
    """(digest, characters, characters in links) of a node's own text."""
    own = " ".join(" ".join(t.split()) for m in node.members for _, t in m.texts if t)
    own = own.strip()
    digest = int.from_bytes(hashlib.blake2b(own.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big") if own else 0
    return digest, len(own), len(own) if node.members[0].link else 0


# A wrapper node is [kind, pages, least digest, greatest digest, characters, link characters, children].


def _leaf(kind: str, slot: list[int], pages: int) -> list:
    return [kind, pages, *slot, []]


def wrapper_of(shape: Skeleton, slots: Iterator[list[int]], pages: int) -> list:
    own = _leaf(shape.kind, next(slots), pages)
    own[6] = [wrapper_of(c, slots, pages) for c in shape.children]
    return own


def _size(tree: list) -> int:
    return 1 + sum(map(_size, tree[6]))


def _match(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: matched nodes below two nodes of one kind, and which children are paired."""
    if a[0] != b[0]:
        return 0, []
    x, y = a[6], b[6]
    if not x or not y:
        return 1, []
    score = [[_match(p, q)[0] for q in y] for p in x]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + score[i - 1][j - 1])
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if score[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + score[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[-1][-1], pairs[::-1]


def merge(a: list, b: list) -> list:
    """One wrapper of two whose roots are of one kind."""
    _, pairs = _match(a, b)
    children, i, j = [], 0, 0
    for p, q in [*pairs, (len(a[6]), len(b[6]))]:
        children += a[6][i:p] + b[6][j:q]
        if p < len(a[6]):
            children.append(merge(a[6][p], b[6][q]))
        i, j = p + 1, q + 1
    return [a[0], a[1] + b[1], min(a[2], b[2]), max(a[3], b[3]), a[4] + b[4], a[5] + b[5], children]


def _words(kind: str) -> tuple[str, set[str]]:
    tag, _, rest = kind.partition(" ")
    return tag, set(rest.split())


def _boiler(kind: str) -> bool:
    tag, words = _words(kind)
    return tag in _DROPPED_TAGS or bool(words & _DROPPED_WORDS) and tag not in ("html", "body", "article", "main", "p")


def _certain(kind: str) -> bool:
    """Whether a kind is boilerplate in a marked root too, whatever its text: by its tag, or as all its words say so; else its words are a prior only."""
    tag, words = _words(kind)
    if tag in _DROPPED_TAGS or not _boiler(kind):
        return tag in _DROPPED_TAGS
    if words & _FOREIGN_WORDS:
        return True
    return not re.fullmatch("h[1-6]", tag) and not {w for w in words - _DROPPED_WORDS - _PLACE_WORDS if len(w) > 2}


def _constant(node: list, pages: int) -> bool:
    """Whether a node and all below it have one text in all of so many pages."""
    return node[1] >= pages > 1 and node[2] == node[3] and all(_constant(c, pages) for c in node[6])


def _text(node: list, at: int = 4) -> int:
    """Characters of a node and all below it, at 5 those in links."""
    return node[at] + sum(_text(c, at) for c in node[6])


def _kept(node: list, pages: int) -> int:
    """Characters of a marked root that stay where constant blocks go."""
    return node[4] + sum(_kept(c, pages) for c in node[6] if not _certain(c[0]) and not (_block(c[0]) and _constant(c, pages)))


def _block(kind: str) -> bool:
    return kind.partition(" ")[0] in _BLOCKS


def _marked(kind: str) -> int:
    tag, words = _words(kind)
    return 2 if tag == "article" or "articlebody" in words else 1 if tag == "main" or words & _ARTICLE_WORDS else 0


def _varies(node: list, pages: int) -> bool:
    return pages < 2 or node[1] < 2 or node[2] != node[3] or node[1] < 0.9 * pages


def _pages(tree: list) -> int:
    """Number of pages of a wrapper; 1 where all are copies of one."""
    return 1 if tree[2] == tree[3] else tree[1]


def _mass(node: list, pages: int, inside: bool = False) -> int:
    """Varying text, less twice what is link text, of what isn't boilerplate below a node."""
    own = max(0, node[4] - 2 * node[5]) if inside or _varies(node, pages) else 0
    return own + sum(_mass(c, pages, inside) for c in node[6] if not (_certain if inside else _boiler)(c[0]))


def plain_root(tree: list) -> tuple[int, ...] | None:
    """Path of child numbers to the deepest node that still holds most of the varying text of a host without marks."""
    pages = _pages(tree)
    plain = []

    def walk(node: list, path: tuple[int, ...]) -> None:
        plain.append((_mass(node, pages), path))
        for k, c in enumerate(node[6]):
            if _open(node[0], c[0]):
                walk(c, (*path, k))

    walk(tree, ())
    most = plain[0][0]
    return max((p for p in plain if p[0] > 0 and 10 * p[0] >= 8 * most), key=lambda p: (len(p[1]), p[0]), default=(0, None))[1]


def _open(kind: str, child: str) -> bool:
    """Whether a content root may lie in a child."""
    return not _boiler(child) and not (child.split(" ")[0] == "header" and not _marked(kind))


def chosen(tree: list, shape: Skeleton) -> list[bool]:
    """For each node of a page's skeleton, in order of walk(), whether its own text is content."""
    pages = _pages(tree)
    twins: dict[int, list | None] = {}
    paths: dict[int, tuple[int, ...] | None] = {}

    def align(node: Skeleton, twin: list | None, path: tuple[int, ...] | None) -> None:
        twins[id(node)], paths[id(node)] = twin, path
        pairs = {j: i for i, j in _match(twin, _bare(node))[1]} if twin is not None else {}
        for j, c in enumerate(node.children):
            i = pairs.get(j)
            align(c, twin[6][i] if i is not None else None, (*path, i) if i is not None else None)

    def mass(node: Skeleton) -> float:
        """Text of a node in a page, on average; 1 where the wrapper doesn't know it."""
        twin = twins[id(node)]
        return 1 if twin is None else _mass(twin, pages, True) / twin[1]

    def marked(node: Skeleton) -> list[Skeleton]:
        """The outermost marked nodes with text, and the articles in one where they hold at least half of it."""
        inner = [r for c in node.children if _open(node.kind, c.kind) for r in marked(c)]
        if node is shape or not _marked(node.kind) or not mass(node):
            return inner
        articles = [r for r in inner if _marked(r.kind) == 2]
        return articles if _marked(node.kind) == 1 and 2 * sum(map(mass, articles)) >= mass(node) else [node]

    def plain() -> list[Skeleton]:
        """The page's own root: as plain_root(), by what its nodes hold on average."""
        found: list[tuple[int, float, Skeleton]] = []

        def walk(node: Skeleton, depth: int, seen: bool) -> float:
            twin = twins[id(node)]
            own = 1 if twin is None else max(0, twin[4] - 2 * twin[5]) / twin[1] if _varies(twin, pages) else 0
            own += sum(walk(c, depth + 1, seen and _open(node.kind, c.kind)) for c in node.children if not _boiler(c.kind))
            if seen:
                found.append((depth, own, node))
            return own

        most = walk(shape, 0, True)
        return [max((f for f in found if f[1] > 0 and 10 * f[1] >= 8 * most), key=lambda f: f[:2])[2]] if most else []

    align(shape, tree, ())
    roots = marked(shape)
    strict = not roots
    if roots:
        articles = [r for r in roots if _marked(r.kind) == 2]
        if 2 * sum(map(mass, articles)) >= max(map(mass, roots)):
            roots = articles
    else:
        path = plain_root(tree)
        roots = [n for n in shape.walk() if path is not None and paths[id(n)] == path] or plain()
    tops = set(map(id, roots))
    out: list[bool] = []

    def dropped(c: Skeleton, pages: int) -> bool:
        """Whether a node in a marked root goes; pages are those that have the root, 0 where what they agree in stays."""
        twin = twins[id(c)]
        if _certain(c.kind) or twin is None:
            return _certain(c.kind)
        if _block(c.kind) and _constant(twin, pages):
            return True
        return _boiler(c.kind) and (_constant(twin, pages) or 2 * _text(twin, 5) >= _text(twin) > 0)

    def walk(node: Skeleton, inside: bool, base: int) -> None:
        twin = twins[id(node)]
        if id(node) in tops:
            inside = True
            # where most of the text is the same, the pages are copies and tell nothing of a template
            base = twin[1] if not strict and twin is not None and 2 * _kept(twin, twin[1]) >= _kept(twin, 0) else 0
        out.append(inside and not (strict and twin is not None and not _varies(twin, pages)))
        for c in node.children:
            if inside and (_boiler(c.kind) if strict else dropped(c, base)):
                out.extend(False for _ in c.walk())
            else:
                walk(c, inside, base)

    walk(shape, False, 0)
    return out


def _bare(node: Skeleton) -> list:
    return [node.kind, 0, 0, 0, 0, 0, [_bare(c) for c in node.children]]


@lru_cache(maxsize=512)
def _wrapper(packed: str) -> list:
    return json.loads(packed)


_known: dict[tuple[str, str], list[bool]] = {}


def extract(text: str | None, packed: str | None) -> str:
    """Main text of a page by its host's wrapper."""
    if not text or not packed:
        return ""
    shape = Skeleton("html", [parse(text)])
    key = (packed, shape.shape())
    if (takes := _known.get(key)) is None:
        if len(_known) > 20_000:
            _known.clear()
        takes = _known[key] = chosen(_wrapper(packed), shape)
    found = [t for node, take in zip(shape.walk(), takes, strict=True) if take for m in node.members for t in m.texts]
    found.sort(key=lambda t: t[0])
    blocks, now = [], []
    for _, t in found:
        if t is None:
            blocks.append("".join(now))
            now = []
        else:
            now.append(t)
    blocks.append("".join(now))
    return " ".join(b for b in (" ".join(entities.unescape(b).split()) for b in blocks) if b)


def _rows(names: list[str], columns: list[list], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, html) to (host, wrapper): the merged tree of each host as JSON."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}

        def flush() -> pa.RecordBatch:
            rows = [(h, s, json.dumps(v[1])) for (h, s), v in held.items()]
            held.clear()
            return _rows(["host", "shape", "wrapper"], [list(c) for c in zip(*rows, strict=True)], [pa.string()] * 3)

        for batch in batches:
            for host, text in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                if not (text := text.as_py()):
                    continue
                shape = Skeleton("html", [parse(text)])
                slots = [(d, d, n, k) for d, n, k in map(_slot, shape.walk())]
                # at the root the digest is the whole page's: pages that are copies of one another tell nothing of a template
                whole = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")
                slots[0] = (whole, whole, *slots[0][2:])
                own = wrapper_of(shape, iter(map(list, slots)), 1)
                key = (host, shape.shape())
                if key in held:
                    held[key][1] = merge(held[key][1], own)
                else:
                    held[key] = [None, own]
                if len(held) > 5_000:
                    yield flush()
        if held:
            yield flush()

    def fold(rows: pa.Table) -> list:
        """In an order that doesn't depend on how the rows came."""
        trees = [json.loads(w) for w in sorted(rows.column("wrapper").to_pylist())]
        trees.sort(key=lambda t: (-t[1], -_size(t)))
        out = trees[0]
        for t in trees[1:]:
            out = merge(out, t)
        return out

    def part(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([json.dumps(fold(rows))], pa.string())})

    found = pages.select("host", "html").mapInArrow(shapes, "host string, shape string, wrapper string")
    salted = found.withColumn("salt", F.pmod(F.xxhash64("shape"), F.lit(SALTS)))
    return salted.groupBy("host", "salt").applyInArrow(part, "host string, wrapper string").groupBy("host").applyInArrow(part, "host string, wrapper string")


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to page_id, url and text."""
    named = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    found = cut(wrappers(named))
    size = found.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    both = named.join(F.broadcast(found) if size <= SENT else found, "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), w.as_py()) for h, w in zip(batch.column("html"), batch.column("wrapper"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return both.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")


def op9_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text and its number of code points."""
    found = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
