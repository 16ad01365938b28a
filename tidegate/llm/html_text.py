"""Main text of web pages by wrapper induction over the pages of a host.

Each page becomes a tree of its block elements (tag and classes are the label, without
words that bear a number; pages' articles match whatever their classes; equal siblings,
such as paragraphs, fall into one node), with the text that stands directly in each. Ids
keep siblings apart and decide between matchings that are equally good, but are no label,
as they may be a page's own. Pages of a host with equal trees count once. The trees of a host
are laid over each other by simple tree matching: the best ordered matching of children,
recursively.

Constant nodes decide first: one that at least half of the host's different pages have, with
the same text on all of them, is template; all others are slots. The content root is the
article or main element with the most varying text, or else the deepest node that holds most
of it. A page's main text are the blocks in slots below the root.

Names decide what the alignment can't, boxes whose text varies as well. Elements that are
menus, footers, forms, scripts and the like by their tag or role, and reader comments, are
never text. A box whose class or id is made of words for sidebars, adverts or notices alone
is not, unless it holds more than half of the varying text: then its name is not believed.
A page that is left with no text by its template, such as one that is constant all over,
is read alone, by names and mass below its own root.

Every page of a host takes part. Equal trees become one by a hash exchange; templates are
merged in groups of about FAN by a hash of the tree, in as many rounds as it takes, so the
result is a function of the table, and no host's pages meet in one task. A template's size
depends on a host's layouts, not on its pages.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import doc_columns, mapped, stored

# Element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption".split())
SKIPPED = frozenset("head nav footer aside form script style textarea title noscript template iframe svg math button select option input object audio video canvas dialog menu".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
SKIPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup share sharing social related recommended widget masthead topbar footer copyright pagination pager toolbar login header".split()
)
#: Words that say where or what kind of box, beside those that say what for.
PLAIN_WORDS = frozenset("area bar bottom box block body bottom btn buttons center col column container content footer google header icons inner item items left link links list main outer panel post posts primary right row secondary section site sticky the title top unit wrap wrapper zone".split())
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
#: What a start tag of the first closes, if it is open and nearer than one of the last.
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}

#: Elements whose classes are no part of the label: they often name a page's own post, tags and section.
WHOLE = frozenset("html body article main".split())
#: Elements that ids keep apart from their siblings.
NAMED = frozenset("div section".split())

DEEPEST = 64
#: Siblings of one label that ids keep apart, at most; further ones fall into the last.
SIBLINGS = 32
#: What equal names add to a matching: less than any node, even where all siblings have it.
SAME_NAME = 2.0**-20
#: Different pages with the same text in a node that make it template, at least; in an article or main element it takes more.
CONSTANT = 3
CONSTANT_INSIDE = 10
#: Share of a host's different pages that a node of the template is on, at least.
COMMON = 0.5
SHARE = 0.6
#: Share of the varying text above which a box's name is not believed.
BELIEVED = 0.5
#: Templates that are merged in one group, at about.
FAN = 512

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?=[\s=/]|\Z)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGIT = re.compile(r"[0-9]")
_IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}


class Node:
    """A node of a page's tree or of a template: `mark` is the text's hash, 0 for none, None if it varies; `name` is empty if it varies; `boxed` if its class or id names a box beside the text."""

    __slots__ = ("label", "kids", "pages", "mark", "mass", "name", "boxed")

    def __init__(self, label: str, pages: int = 1, name: str = "", boxed: bool = False):
        self.label, self.kids, self.pages, self.mark, self.mass, self.name, self.boxed = label, [], pages, 0, 0, name, boxed

    def as_list(self) -> list:
        return [self.label, self.pages, self.mark, self.mass, [k.as_list() for k in self.kids], self.name, int(self.boxed)]

    @staticmethod
    def of(x: list) -> Node:
        node = Node(x[0], x[1], x[5], bool(x[6]))
        node.mark, node.mass = x[2], x[3]
        node.kids = [Node.of(k) for k in x[4]]
        return node


def _attributes(raw: str) -> tuple[str, str, str, bool]:
    """Classes, id, role, and whether it is hidden."""
    classes, own, role, hidden = "", "", "", False
    if raw:
        for m in _ATTRIBUTE.finditer(raw):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key == "class":
                classes = value.lower()
            elif key == "id":
                own = value.lower()
            elif key == "role":
                role = value.lower()
            else:
                hidden = hidden or key == "hidden" or value.lower() == "true"
    return classes, own, role, hidden


def _numberless(names: str) -> str:
    """The words of an attribute that bear no digit."""
    return " ".join(w for w in names.split() if not _DIGIT.search(w))


def _label(tag: str, classes: str, own: str) -> tuple[str, str]:
    """What nodes of pages match by, and what else keeps siblings apart."""
    classes = _numberless(classes)
    if tag in WHOLE:
        return tag, classes
    return f"{tag} {classes}" if classes else tag, _numberless(own) if tag in NAMED else ""


def _left_out(tag: str, names: str, role: str, hidden: bool, inside: bool) -> bool:
    """Whether an element is never text, wherever it stands."""
    if tag in ("html", "body", "main", "article"):
        return hidden
    if tag in SKIPPED or hidden or role in SKIPPED_ROLES or tag == "header" and not inside:
        return True
    return any(words and words <= COMMENT_WORDS | PLAIN_WORDS and words & COMMENT_WORDS for words in _token_words(names))


def _token_words(names: str) -> list[set[str]]:
    return [set(_WORD.findall(token)) for token in names.split()]


def _boxed(tag: str, names: str, inside: bool) -> bool:
    """Whether a class or an id is made of words for boxes beside the text alone."""
    if tag in ("html", "body", "main", "article") or not names:
        return False
    known = SKIPPED_WORDS - {"header"} if inside else SKIPPED_WORDS
    return any(words & known and words <= SKIPPED_WORDS | PLAIN_WORDS for words in _token_words(names))


def parse(page: str) -> tuple[Node, list[tuple[str, Node]]]:
    """A page's tree and its blocks in order, (text, node); what is never text is in neither."""
    root = Node("")
    blocks: list[tuple[str, Node]] = []
    # Open elements: tag, node, whether text in it is left out, whether it is in an article or main element.
    stack: list[tuple[str, Node, bool, bool]] = [("", root, False, False)]
    held: list[str] = []
    owner = root
    at = 0

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                blocks.append((text, owner))
            held.clear()

    def close(k: int) -> None:
        if any(t[0] in BLOCK or t[2] for t in stack[k:]):
            flush()
        del stack[k:]

    find, n = _TOKEN.search, len(page)
    while at < n:
        m = find(page, at)
        if m is None:
            if not stack[-1][2]:
                owner = stack[-1][1]
                held.append(page[at:])
            break
        if m.start() > at and not stack[-1][2]:
            owner = stack[-1][1]
            held.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                held.append(" ")
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if tag in _IMPLIED:
            ends, bounds = _IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] in bounds:
                    break
        _, node, out, inside = stack[-1]
        classes, own, role, hidden = _attributes(m[3])
        boxed = False
        if not out:
            names = f"{classes} {own}"
            boxed = _boxed(tag, names, inside)
            # In a line of text there is no node to weigh a box by.
            if _left_out(tag, names, role, hidden, inside) or boxed and tag not in BLOCK:
                flush()
                out = True
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if not out:
                owner = node
                held.append(html.escape(page[at : end.start() if end else n]) if tag == "noscript" else "")
            at = end.end() if end else n
            continue
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK:
            flush()
            if not out and len(stack) < DEEPEST:
                node = _kid(node, *_label(tag, classes, own), boxed)
        stack.append((tag, node, out, inside or tag in ("article", "main") or role == "main"))
    flush()
    texts: dict[int, list[str]] = {}
    nodes: dict[int, Node] = {}
    for text, node in blocks:
        texts.setdefault(id(node), []).append(text)
        nodes[id(node)] = node
    for key, own in texts.items():
        nodes[key].mark = xxhash.xxh3_64_intdigest("\n".join(own)) >> 1 | 1
        nodes[key].mass = sum(map(len, own))
    return root, blocks


def _kid(parent: Node, label: str, name: str, boxed: bool) -> Node:
    """The child with this label, name and kind, new if there is none."""
    alike = [k for k in parent.kids if k.label == label and k.boxed == boxed]
    found = next((k for k in alike if k.name == name), None)
    if found is None and len(alike) >= SIBLINGS:
        found = alike[-1]
    if found is None:
        found = Node(label, name=name, boxed=boxed)
        parent.kids.append(found)
    return found


def matching(a: Node, b: Node) -> tuple[float, list[tuple[Node, Node]]]:
    """Simple tree matching: the size of the best ordered matching of two trees with equal labels at the root, and its pairs of children."""
    one = 1 + SAME_NAME if a.name and a.name == b.name else 1
    if not a.kids or not b.kids:
        return one, []
    n, m = len(a.kids), len(b.kids)
    w = [[matching(x, y)[0] if x.label == y.label and x.boxed == y.boxed else 0 for y in b.kids] for x in a.kids]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w[i][j])
    pairs, i, j = [], n, m
    while i and j:
        if w[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + w[i - 1][j - 1]:
            pairs.append((a.kids[i - 1], b.kids[j - 1]))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return one + best[n][m], pairs[::-1]


def merged(a: Node, b: Node) -> Node:
    """`b` laid over the template `a`, which changes."""
    _, pairs = matching(a, b)
    a.pages += b.pages
    a.name = a.name if a.name == b.name else ""
    a.mass += b.mass
    if a.mark != b.mark:
        a.mark = (a.mark or b.mark) if a.mark == 0 or b.mark == 0 else None
    taken = {id(y): x for x, y in pairs}
    place = 0
    for kid in b.kids:
        if id(kid) in taken:
            own = taken[id(kid)]
            merged(own, kid)
            place = a.kids.index(own) + 1
        else:
            a.kids.insert(place, kid)
            place += 1
    return a


def overlaid(template: Node, page: Node) -> dict[int, Node]:
    """The template's node for each node of a page, by id."""
    out, todo = {}, [(template, page)]
    while todo:
        x, y = todo.pop()
        out[id(y)] = x
        todo += matching(x, y)[1]
    return out


def _is_main(node: Node) -> bool:
    return node.label.split(" ")[0] in ("article", "main")


def _is_template(node: Node, pages: int, least: int) -> bool:
    """Whether a node is template on a host of so many different pages."""
    return node.mark is not None and node.pages >= max(least, COMMON * pages)


def _varying(node: Node, pages: int, boxes: bool = False) -> int:
    """Bytes of varying text in a node's subtree; those in named boxes below it only if `boxes`."""
    own = 0 if _is_template(node, pages, CONSTANT) else node.mass
    return own + sum(_varying(k, pages, boxes) for k in node.kids if boxes or not k.boxed)


def _believe(tree: Node) -> None:
    """Take from boxes that hold more than half of all varying text the name of a box."""
    whole, todo = _varying(tree, tree.pages, True), [tree]
    while todo:
        node = todo.pop()
        if node.boxed and whole and _varying(node, tree.pages, True) > BELIEVED * whole:
            node.boxed = False
        todo += node.kids


def content_root(tree: Node) -> Node:
    """The article or main element with the most varying text, or else the deepest node that holds most of it."""
    todo, best, pages = [tree], None, tree.pages
    while todo:
        node = todo.pop()
        if _is_main(node):
            if best is None or _varying(node, pages) > _varying(best, pages):
                best = node
        else:
            todo += [k for k in node.kids if not k.boxed]
    if best is not None and best.mass + sum(k.mass for k in best.kids) + _varying(best, pages):
        return best
    node = tree
    while True:
        whole = _varying(node, pages)
        kid = max((k for k in node.kids if not k.boxed), key=lambda k: _varying(k, pages), default=None)
        if kid is None or not whole or _varying(kid, pages) < SHARE * whole or kid.label.split(" ")[0] in ("p", "li", "ul", "ol", "table", "td", "tr", "blockquote", "pre"):
            return node
        node = kid


def _below(node: Node) -> set[int]:
    out, todo = set(), [node]
    while todo:
        x = todo.pop()
        out.add(id(x))
        todo += [k for k in x.kids if not k.boxed]
    return out


class Wrapper:
    """A host's template with what follows from it: the content root, and which of its nodes' blocks are text."""

    def __init__(self, template: Node):
        # Nodes are matched with boxes as they are named; what is below the root, with the names that are believed.
        believed = Node.of(template.as_list())
        _believe(believed)
        root = content_root(believed)
        below, least = _below(root), CONSTANT_INSIDE if _is_main(root) else CONSTANT
        self.template = template
        self.slots = {id(x) for x, y in zip(_walk(template), _walk(believed), strict=True) if id(y) in below and not _is_template(x, template.pages, least)}

    def text(self, tree: Node, blocks: list[tuple[str, Node]]) -> list[str]:
        over = overlaid(self.template, tree)
        return [text for text, node in blocks if id(over.get(id(node))) in self.slots]


def main_text(page: str, wrapper: Wrapper | None) -> str:
    """The text of a page under its host's wrapper (None: the page alone)."""
    tree, blocks = parse(page)
    if not blocks:
        return ""
    kept = wrapper.text(tree, blocks) if wrapper is not None else []
    if not kept:
        _believe(tree)
        below = _below(content_root(tree))
        kept = [text for text, node in blocks if id(node) in below]
    return "\n".join(kept)


def _walk(node: Node) -> Iterator[Node]:
    yield node
    for kid in node.kids:
        yield from _walk(kid)


def host(url: Column) -> Column:
    """The host of a URL in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _trees(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(host, tree) of pages with any text, equal ones of a batch once."""
    found: dict[tuple[str, str], None] = {}
    for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        tree, blocks = parse(page or "")
        if blocks:
            found[name, json.dumps(tree.as_list())] = None
    yield pa.record_batch([pa.array([n for n, _ in found], type=pa.string()), pa.array([t for _, t in found], type=pa.string())], names=["host", "template"])


def _united(table: pa.Table) -> pa.Table:
    """One template from several of a host; the order in which they are laid over each other is that of their texts."""
    own = sorted(table.column("template").to_pylist())
    tree = Node.of(json.loads(own[0]))
    for other in own[1:]:
        merged(tree, Node.of(json.loads(other)))
    return pa.table({"host": table.column("host").slice(0, 1), "template": pa.array([json.dumps(tree.as_list())])})


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) for every host of `pages` (url, html)."""
    own = pages.select(host(pages["url"]).alias("host"), pages["html"])
    rows = stored(mapped(own, ["host", "html"], "host string, template string", _trees).distinct(), "trees")
    while True:
        sizes = stored(rows.groupBy("host").agg(F.count("*").alias("n")), "sizes")
        most = sizes.agg(F.max("n")).first()[0] or 0
        placed = rows.join(sizes, "host").withColumn("slot", F.pmod(F.xxhash64("template"), F.ceil(F.col("n") / FAN)))
        rows = stored(placed.select("host", "slot", "template").groupBy("host", "slot").applyInArrow(_united, "host string, template string"), "templates")
        if most <= FAN:
            return rows


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html).

    Null and empty pages have an empty text. A null url, or one without a host, belongs to
    the host with the empty name. Repeated rows and null ids are kept as they are; other
    columns are ignored; an empty table gives no rows. The result is a function of the table,
    whatever the order and the partitions of its rows.
    """
    pages = doc_columns(pages, "page_id", "url", "html")
    known = templates(pages)

    def run(batches):
        parsed: dict[str, Wrapper] = {}
        for batch in batches:
            texts = []
            for page, raw in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if raw is not None and raw not in parsed:
                    if len(parsed) > 500:
                        parsed.clear()
                    parsed[raw] = Wrapper(Node.of(json.loads(raw)))
                texts.append(main_text(page, parsed.get(raw)) if page else "")
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    wide = pages.withColumn("host", host(F.col("url"))).join(known, "host", "left").select("page_id", "url", "html", "template")
    return wide.mapInArrow(run, "page_id long, url string, text string, n_chars long")
