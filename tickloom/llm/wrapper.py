"""Main text of web pages by wrapper induction.

Each page is parsed leniently into a tree. Siblings with the same signature (tag, class, id) fold into one slot, so a
page's skeleton is small however long its article is. Every page of a host is aligned with one reference page of that
host by simple tree matching (roots must agree; children are matched in order, for the greatest number of matched
nodes). Slots whose text is the same on nearly all aligned pages are the host's template, within articles too; slots
that vary carry content. Alignment is counted as sums over pages, so a host with a third of all pages is shared by all
tasks.

Markup is evidence on the varying slots. Menus, headers, footers, scripts and the like never hold content. Words of
classes (adverts, comments of readers) and forms count against a slot, unless it holds nearly all that varies on the
host. Article and main elements count for their slots: where they hold a fair share of the varying text, nothing
outside them is kept; of the two, the one that holds the body, as a page may have teasers in article elements beside
it. Blocks come out in page order, one line each.

Null html is empty and gives an empty text; a null or host-less url has no host, so its page has no template. A host
of fewer than MIN_PAGES different skeletons has none either; their pages are judged by their own slots. Repeated rows are extracted alike.
"""

from __future__ import annotations

import html
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import attach, slices, stored
from tickloom.llm.url_filter import host_of

#: Aligned pages that a template slot needs, and the share of them that must agree.
MIN_PAGES, CONSTANT = 4, 0.9
#: A slot with words against it is content if it holds so many times the other varying text of the host.
OUTWEIGHS = 10
#: Article and main elements are believed if they hold this share of the varying text.
MARKED = 0.25
#: Wrappers of all hosts together are broadcast up to this size; beyond it they are joined by shuffle.
BROADCAST_BYTES = 8 << 20
SALTS = 16

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: A start tag that ends open elements of these kinds, up to the nearest element that may hold them.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
#: Elements that hold no article text, whatever their class.
NO_CONTENT = frozenset(
    "head script style noscript template nav header footer aside button select option input textarea svg canvas iframe object embed menu dialog title".split())
#: Roles that declare the same, and words of classes and ids that count against an element.
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
NO_CONTENT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget related recommended share sharing social cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription signup login comment comments commentlist disqus reply replies discussion copyright legal pagination pager toolbar skip".split())
ARTICLE = frozenset(["article", "main"])

_TAG = re.compile(r"<(?:!--(?P<note>.*?)(?:--!?>|\Z)|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"'=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=|\"|')*+)>|(?P<odd>[!?/][^>]*>))", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|\Z)""", re.I)
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")
_WORDS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "sign", "dead", "kids")

    def __init__(self, tag: str, sign: str, dead: bool):
        self.tag, self.sign, self.dead, self.kids = tag, sign, dead, []


def declared_empty(tag: str, attrs: dict[str, str]) -> bool:
    """Whether markup says that an element isn't part of the article."""
    return tag in NO_CONTENT or attrs.get("role", "").lower() in NO_CONTENT_ROLES or "hidden" in attrs


def doubted(tag: str, attrs: dict[str, str]) -> bool:
    """Whether words of its class or id, or that it is a form, count against an element."""
    if tag in ARTICLE or tag in ("html", "body"):
        return False
    return tag == "form" or attrs.get("role", "").lower() == "form" or any(w in NO_CONTENT_WORDS for k in ("class", "id") for w in _WORDS.findall(attrs.get(k, "").lower()))


def parse(page: str) -> Node:
    """Tree of a page; text nodes are strings. Unknown or missing end tags never fail."""
    root = Node("#", "#", False)
    stack, at, n = [root], 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            stack[-1].kids.append(html.unescape(page[at:lt]))
        if lt == n:
            break
        m = _TAG.match(page, lt)
        if not m:  # a "<" of the text
            stack[-1].kids.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m["name"] is None:
            continue
        tag = m["name"].lower()
        if m["close"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ARTICLE and tag not in ("body", "html", *ARTICLE) and tag in BLOCKS and tag != stack[i].tag:
                    break  # a stray end tag doesn't close the article
            continue
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m["attrs"] or "")}
        if tag in BLOCKS:  # a block ends an open paragraph
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in ENDS:
            own, within = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in within:
                    break
                if stack[i].tag in own:
                    del stack[i:]
                    break
        doubt = doubted(tag, attrs)
        node = Node(tag, f"{'?' * doubt}{tag}.{attrs.get('class', '')}#{attrs.get('id', '')}", declared_empty(tag, attrs) or doubt and tag not in BLOCKS)
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else n
            node.kids.append(page[at:stop])
            close = page.find(">", stop)
            at = n if close < 0 else close + 1
        elif tag not in VOID and not (m["attrs"] or "").rstrip().endswith("/"):
            stack.append(node)
        elif tag not in VOID and tag in BLOCKS:
            stack.append(node)  # a slash does not close an HTML element
    return root


def fold(root: Node) -> list[tuple[int, str, int, int]]:
    """Skeleton in preorder: (depth, signature, checksum of the own text, its length); same-signature siblings are one
    slot. Text and blocks of inline elements are their block's; elements without content are left out."""
    out, todo = [], [(0, "#", [root])]
    while todo:
        depth, sign, group = todo.pop()
        own, slots = [], {}
        for node in group:
            inner = list(reversed(node.kids))
            while inner:
                x = inner.pop()
                if isinstance(x, str):
                    own.append(x)
                elif x.dead:
                    continue
                elif x.tag in BLOCKS:
                    slots.setdefault(x.sign, []).append(x)
                else:
                    inner.extend(reversed(x.kids))
        text = _SPACE.sub(" ", " ".join(own)).strip()
        out.append((depth, sign, zlib.crc32(text.encode("utf-8", "replace")) if text else -1, len(text)))
        todo.extend((depth + 1, s, g) for s, g in reversed(slots.items()))
    return out


def children(skeleton: list[tuple[int, str, int]]) -> list[list[int]]:
    kids, path = [[] for _ in skeleton], []
    for i, (depth, *_) in enumerate(skeleton):
        del path[depth:]
        if path:
            kids[path[-1]].append(i)
        path.append(i)
    return kids


def align(a: list[tuple[int, str, int]], b: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """Simple tree matching: pairs of matched slots of two skeletons, in order, as many as possible."""
    if not a or not b:
        return []
    ka, kb = children(a), children(b)
    sizes: dict[tuple[int, int], int] = {}
    choice: dict[tuple[int, int], list[tuple[int, int]]] = {}
    todo = [(0, 0, False)]
    while todo:
        i, j, ready = todo.pop()
        if (i, j) in sizes:
            continue
        same = [(x, y) for x in ka[i] for y in kb[j] if a[x][1] == b[y][1]]
        if not ready:
            todo.append((i, j, True))
            todo.extend((x, y, False) for x, y in same)
            continue
        # longest chain of same-signature children, weighted by what they match below; signatures are unique here
        same.sort()
        best: list[tuple[int, int]] = []
        for k, (x, y) in enumerate(same):
            w, back = sizes[x, y], -1
            top = max(((best[p][0], p) for p in range(k) if same[p][0] < x and same[p][1] < y), default=(0, -1))
            best.append((w + top[0], top[1] if top[0] else back))
        chain, k = [], max(range(len(best)), key=lambda p: best[p][0], default=-1)
        sizes[i, j] = 1 + (best[k][0] if best else 0)
        while k >= 0:
            chain.append(same[k])
            k = best[k][1]
        choice[i, j] = chain[::-1]
    pairs, todo = [], [(0, 0)]
    while todo:
        i, j = todo.pop()
        pairs.append((i, j))
        todo.extend(choice[i, j])
    return sorted(pairs)


def doubts(path: tuple[str, ...], lifted: set[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Elements on the way to a slot that words count against."""
    return [path[: k + 1] for k, sign in enumerate(path) if sign[0] == "?" and path[: k + 1] not in lifted]


def outweighing(slots: list[tuple[tuple[str, ...], int]]) -> set[tuple[str, ...]]:
    """Of (path, length of the text) of varying slots, the doubted elements that hold nearly all the text."""
    lifted: set[tuple[str, ...]] = set()
    while True:
        rest, held = 0, {}
        for path, n in slots:
            against = doubts(path, lifted)
            if not against:
                rest += n
            elif len(against) == 1:
                held[against[0]] = held.get(against[0], 0) + n
        top = max(held, key=lambda p: (held[p], p), default=None)
        if top is None or held[top] <= OUTWEIGHS * rest:
            return lifted
        lifted.add(top)


def within(path: tuple[str, ...], kind: str) -> bool:
    return any(sign.startswith(kind + ".") for sign in path)


def marked(slots: list[tuple[tuple[str, ...], int]], lifted: set[tuple[str, ...]]) -> str:
    """The kind of element, article or main, that holds the body; empty if neither does."""
    sure = [(within(p, "article"), within(p, "main"), n) for p, n in slots if not doubts(p, lifted)]
    article, main_only = sum(n for a, _, n in sure if a), sum(n for a, m, n in sure if m and not a)
    main = sum(n for _, m, n in sure if m)
    if not max(article, main) or max(article, main) < MARKED * sum(n for *_, n in sure):
        return ""
    return "article" if article >= main_only else "main"


class Wrapper:
    """What a host's pages have in common: reference skeleton, template slots, and how markup is to be read."""

    def __init__(self, reference: list[tuple[int, str, int, int]], template: set[int], sizes: dict[int, int]):
        self.reference, self.template = reference, template
        paths = _paths(reference)
        varying = [(paths[i], n) for i, n in sizes.items() if i not in template]
        self.lifted = outweighing(varying)
        self.kind = marked(varying, self.lifted)


def extract(page: str, wrapper: Wrapper | None = None) -> str:
    """The page's main text; ``wrapper``: that of its host."""
    root = parse(page)
    paths = _paths(own := fold(root))
    gone: set[tuple[str, ...]] = set()
    lifted: set[tuple[str, ...]] = set()
    if wrapper:
        # a slot that differs on this page isn't the template's text
        gone = {paths[j] for i, j in align(wrapper.reference, own) if i in wrapper.template and wrapper.reference[i][2] == own[j][2]}
        lifted = wrapper.lifted
    varying = [(path, x[3]) for path, x in zip(paths, own) if path not in gone]
    kind = wrapper.kind if wrapper and any(n for p, n in varying if within(p, wrapper.kind) and not doubts(p, lifted)) else marked(varying, lifted)
    kept = {p for p, _ in varying if (not kind or within(p, kind)) and not doubts(p, lifted)}
    lines: list[str] = []
    buffer: list[str] = []

    def flush():
        if buffer and (line := _SPACE.sub(" ", "".join(buffer)).strip(" ")):
            lines.append(line)
        buffer.clear()

    # explicit stack: entering a node, or the mark that one ends
    todo: list = [(x, ("#",)) for x in [root]]
    while todo:
        x, path = todo.pop()
        if x is None:
            flush()
            continue
        if isinstance(x, str):
            if path in kept:
                buffer.append(x)
            continue
        if x.dead:
            if x.tag in BLOCKS:
                flush()
            continue
        here = path if x.tag == "#" or x.tag not in BLOCKS else (*path, x.sign)
        if x.tag == "br":
            buffer.append(" ")
        if x.tag in BLOCKS:
            flush()
            todo.append((None, here))
        todo.extend((k, here) for k in reversed(x.kids))
    flush()
    return "\n".join(lines)


def _paths(skeleton: list[tuple[int, str, int]]) -> list[tuple[str, ...]]:
    out, path = [], []
    for depth, sign, *_ in skeleton:
        del path[depth:]
        path.append(sign)
        out.append(tuple(path))
    return out


_SKELETON = "array<struct<depth:int,sign:string,text:long,size:int>>"


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, reference, slots): per host of MIN_PAGES pages, its reference skeleton and, of each of its slots that
    MIN_PAGES pages have, the number, whether it is template, and the length of its text on all pages."""
    def skeletons(batches):
        for b in slices(batches, 1):
            made = [[{"depth": d, "sign": s, "text": t, "size": n} for d, s, t, n in fold(parse(p))] for p in b.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("depth", pa.int32()), ("sign", pa.string()), ("text", pa.int64()), ("size", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, kind)], names=["host", "skeleton"])

    own = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).where("host <> ''") \
        .mapInArrow(skeletons, f"host string, skeleton {_SKELETON}")
    own = stored(own, "skeletons")
    # equal pages say nothing of what varies; the reference is the first by hash, found by partial minima
    distinct = own.groupBy("host", F.xxhash64("skeleton").alias("h")).agg(F.first("skeleton").alias("skeleton"))
    distinct = stored(distinct, "skeletons")
    refs = stored(distinct.groupBy("host").agg(F.count("*").alias("pages"), F.min(F.struct("h", "skeleton")).alias("x")).where(F.col("pages") >= MIN_PAGES).select("host", "pages", F.col("x.skeleton").alias("reference")), "references")

    def aligned(batches):
        for b in batches:
            hosts, slots, equal, sizes = [], [], [], []
            for host, s, r in zip(*(b.column(i).to_pylist() for i in range(3))):
                one, other = _tuples(r), _tuples(s)
                for i, j in align(one, other):
                    hosts.append(host)
                    slots.append(i)
                    equal.append(int(one[i][2] == other[j][2] != -1))
                    sizes.append(other[j][3])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(slots, pa.int32()), pa.array(equal, pa.int64()), pa.array(sizes, pa.int64())], names=["host", "slot", "equal", "size"])

    met = attach(distinct, refs, "host", "pages").select("host", "skeleton", "reference").mapInArrow(aligned, "host string, slot int, equal long, size long")
    slots = met.groupBy("host", "slot").agg(F.count("*").alias("n"), F.sum("equal").alias("equal"), F.sum("size").alias("size")).where(F.col("n") >= MIN_PAGES) \
        .groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", (F.col("equal") >= CONSTANT * F.col("n")).alias("template"), "size"))).alias("slots"))
    return stored(slots.join(refs, "host").select("host", "reference", "slots"), "wrappers")


def _tuples(skeleton: list[dict]) -> list[tuple[int, str, int, int]]:
    return [(x["depth"], x["sign"], x["text"], x["size"]) for x in skeleton]


def main_text(pages: DataFrame) -> DataFrame:
    """Every page: page_id, url, text, n_chars."""
    own = wrappers(pages)
    size = own.agg(F.sum(F.octet_length(F.to_json("reference")))).first()[0] or 0
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    if size <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(own), "host", "left")
    else:
        salted = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches):
        known: dict[str, Wrapper] = {}
        for b in slices(batches, 2):
            texts = []
            for i, (page, host) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                if host not in known and b.column(4)[i].is_valid:
                    found = b.column(5)[i].as_py()
                    known[host] = Wrapper(_tuples(b.column(4)[i].as_py()), {x["slot"] for x in found if x["template"]}, {x["slot"]: x["size"] for x in found})
                    if len(known) > 1000:
                        del known[next(iter(known))]
                texts.append(extract(page, known.get(host)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = dict(pages.dtypes)["page_id"]
    out = met.select("page_id", "url", "html", "host", "reference", "slots").mapInArrow(run, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
