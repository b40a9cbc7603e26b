"""Main text of web pages by equivalence-class template deduction.

Pages of a host come from templates. A token (the start or end of an element in its place, or a text in
its place) has an occurrence vector: how often it stands in each page of the host. Tokens that share a
vector form an equivalence class. A class is valid if its tokens keep one order in every page, and if it
nests: its occurrences lie within one and the same slot of another class, or of none, and never across
a token of that class. Valid classes make up the template, a tree by their slots; what the slots hold
is data.

1. One scan counts tokens; vectors are compared by sums of digests over pages, so counting is one
   aggregation with partial sums whatever the size of a host. Rows with equal pages add the same to each
   token of theirs, and distinct pages are what support counts.
2. One scan lays the classes over each page: order, nesting, and how much text and linked text each
   slot holds are summed up for each host, class and slot.
3. One scan extracts: texts that belong to valid classes go, and what the slots hold stays, within the
   marked article where there is one, else within the least element of the template that holds nearly
   all of the page's data. Slots that hold links for the most part go, if nothing marks an article.

What tags and attributes say outright (nav, footer, class="comments") is followed before that. Hosts
with fewer than three distinct pages have no template; tags and attributes decide alone.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|([^<]+)|(<)", re.S)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

# Element names of HTML by what they are to an extractor.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr del rb rt".split())
DROP = frozenset(
    "head script style title textarea noscript iframe template svg math canvas object embed audio video nav header footer aside form button select option input dialog menu noembed noframes map datalist fieldset".split()
)
CLOSES = {  # an opening tag ends an open element of these kinds, up to the named bounds
    "p": (frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure details".split()), frozenset("td th li body article section div button".split())),
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "tbody", "tfoot", "thead"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "tr"]), frozenset(["table"])),
    "th": (frozenset(["td", "th", "tr"]), frozenset(["table"])),
    "option": (frozenset(["option", "optgroup"]), frozenset(["select"])),
}
CLOSED_BY: dict[str, list[tuple[str, frozenset]]] = defaultdict(list)
for _kind, (_by, _bounds) in CLOSES.items():
    for _tag in _by:
        CLOSED_BY[_tag].append((_kind, _bounds))
# Parts of class names and ids that mark what isn't the article.
AWAY = frozenset(
    "nav navbar navigation menu submenu sidebar sidenav aside footer foot header masthead topbar breadcrumb breadcrumbs ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup signin login register comment comments disqus respond reply replies share sharing social follow related recommended recommendations trending popular widget widgets pagination pager paging copyright legal disclaimer search toolbar skip hidden outbrain taboola paywall feedback survey".split()
)
# Parts of names that say nothing of what an element is.
PLAIN = frozenset("box bar wrap wrapper container inner outer section area block list item items link links main site page global top bottom left right center col row grid md sm lg xs xl text title head panel content group holder region module slot unit menu btn button buttons icon icons hidden mobile desktop primary secondary fixed sticky clearfix".split()) - frozenset(["holder", "text", "content", "title"])
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form status toolbar".split())
# Class names, ids and item properties that mark the article.
BODY = frozenset(["articlebody", "article-body", "article-content", "entry-content", "post-content", "post-body", "story-body", "page-content", "main-content", "maincontent", "content-body", "article", "articletext", "article-text"])
#: Distinct pages on which a token must stand to be template, and share of a host's page rows. The share bounds
#: a template: no more tokens than 1 / SHARE times those of an average page.
PAGES, SHARE = 3, 0.02
#: Share of a page's data that the least element must hold to be where the main text is.
MOST = 0.8


class Node:
    __slots__ = ("tag", "path", "gone", "main", "link", "depth")

    def __init__(self, tag, path, gone, main, link, depth):
        self.tag, self.path, self.gone, self.main, self.link, self.depth = tag, path, gone, main, link, depth


ROOT = Node("", "", False, "", False, 0)


@lru_cache(10_000)
def _names(names: str) -> tuple[bool, bool]:
    """Whether one of the class names and ids, or each but plain ones, marks what isn't the article: all
    parts of such a name do, or are plain."""
    kinds = []
    for n in names.split():
        parts = [p.lower() for p in PARTS.findall(n)]
        if parts and all(p in AWAY or p in PLAIN for p in parts):
            kinds.append(2 if any(p in AWAY for p in parts) else 1)
        else:
            kinds.append(0)
    return 2 in kinds, 2 in kinds and 0 not in kinds


def _element(tag: str, raw: str, up: Node) -> Node:
    gone, main, role = up.gone or tag in DROP, up.main, tag
    if raw:
        attrs = {}
        for m in ATTR.finditer(raw):
            attrs.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        cls, name, kind = attrs.get("class", "").lower(), attrs.get("id", "").lower(), attrs.get("role", "").lower()
        if cls:
            role += "." + ".".join(sorted(cls.split()))
        if not gone and tag not in ("html", "body"):
            style = attrs.get("style", "").replace(" ", "").lower()
            one, every = _names(f"{attrs.get('class', '')} {attrs.get('id', '')}")
            away = every if up.main or tag in ("main", "article") else one  # within the article, or as one, no name may say otherwise
            gone = kind in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or away
        if not gone:
            if attrs.get("itemprop", "").lower() == "articlebody" or name in BODY or any(c in BODY for c in cls.split()):
                main = main if main.startswith("a") else "b"
            elif kind == "main":
                main = main or "m"
            elif kind == "article":
                main = "a"
    if not gone and tag == "article":
        main = "a"
    elif not gone and tag == "main":
        main = main or "m"
    return Node(tag, f"{up.path}/{role}", gone, main, up.link or tag == "a", up.depth + 1)


def walk(page: str) -> Iterator[tuple[str, Node, str, int]]:
    """("open", node, "", region), ("close", ...) and ("text", node, text, region) in page order; regions
    are numbers of the outermost article, article body or main element that holds the node, 0 if none."""
    stack: list[tuple[Node, int]] = [(ROOT, 0)]
    at, n, regions = 0, len(page), 0
    match = TOKEN.match

    def cut(k: int) -> list:
        out = [("close", node, "", region) for node, region in reversed(stack[k:])]
        del stack[k:]
        return out

    while at < n:
        m = match(page, at)
        if m is None:  # a tag that never ends: the rest is no text
            at += 1
            continue
        at = m.end()
        text, tag = m[4], m[2]
        if m[5]:
            text = "<"
        if text is not None:
            node, region = stack[-1]
            yield "text", node, text, region
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0].tag == tag:
                    yield from cut(k)
                    break
            continue
        for kind, bounds in CLOSED_BY.get(tag, ()):
            for k in range(len(stack) - 1, 0, -1):
                t = stack[k][0].tag
                if t == kind:
                    yield from cut(k)
                    break
                if t in bounds:
                    break
        up, region = stack[-1]
        node = _element(tag, m[3], up)
        if node.main and not region or node.main.startswith("a") and not up.main.startswith("a") and node.main != up.main:
            regions += 1
            region = regions
        yield "open", node, "", region
        if tag in VOID or m[3].endswith("/") and tag not in RAW and tag in ("path", "use"):
            continue
        if tag in RAW:
            low = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            end = low.start() if low else n
            at = page.find(">", end) + 1 if low else n
            at = at or n
            continue
        stack.append((node, region))
    yield from cut(1)


def space(s: str) -> str:
    return " ".join(s.split())


def _key(s: str) -> int:
    """63 bits that stand for a token."""
    return xxhash.xxh3_64_intdigest(s.encode()) >> 1


def tokens(events: Iterable[tuple[str, Node, str, int]]) -> Iterator[tuple[int, int, Node, str, int]]:
    """(key, kind, node, text, region) of what can be template, in page order, from walk()'s events. Kinds:
    0 text, 1 start and 2 end of an element. Elements within a line are none."""
    for kind, node, text, region in events:
        if node.gone:
            continue
        if kind == "text":
            if t := space(text):
                yield _key(f"={node.path}={t}"), 0, node, text, region
        elif node.tag not in INLINE and node.tag not in VOID:
            yield (_key("<" + node.path), 1, node, "", region) if kind == "open" else (_key(">" + node.path), 2, node, "", region)


def host_of(url) -> object:
    """The host of a URL column, empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


class Template:
    """Classes of a host as tokens in order. members: (class, mean place, key, kind, element, depth) of
    each token; found: what the pages say of the classes (None before they were asked)."""

    def __init__(self, members: list, found: list | None):
        by: dict[int, list] = defaultdict(list)
        for m in members:
            by[m["cls"]].append(m)
        self.valid, self.support, self.slots, self.text = set(by), {}, defaultdict(lambda: [0, 0]), {}
        if found is not None:
            parents, bad, sums = defaultdict(set), Counter(), defaultdict(lambda: [0, 0, 0, 0, 0])
            for f in found:
                c = f["cls"]
                if f["slot"] >= 0:
                    got = self.slots[c, f["slot"]]
                    got[0] += f["chars"]
                    got[1] += f["linked"]
                else:
                    parents[c].add((f["parent"], f["pslot"]))
                    bad[c] += f["bad"]
                    for i, x in enumerate(("fixed_in", "data_in", "fixed_out", "data_out", "pages")):
                        sums[c][i] += f[x]
            self.valid = {c for c in by if not bad[c] and len(parents[c]) == 1}
            total = max([v[4] for v in sums.values()], default=0)
            # texts that outweigh what varies beside them are those of copies, not of a template
            self.text = {c: (v[0] <= v[1], 2 * v[4] >= total or v[2] <= v[3]) for c, v in sums.items()}
        self.place: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        self.size: dict[int, int] = {}
        self.rows: dict[int, int] = {}
        for c in self.valid:
            own = sorted(by[c], key=lambda m: m["place"])
            self.size[c], self.rows[c] = len(own), own[0]["rows"]
            starts: dict[int, int] = {}
            for r, m in enumerate(own):
                self.place[m["key"]] = (c, r)
                if m["kind"] == 1:
                    starts[m["element"]] = r
                elif m["kind"] == 2 and m["element"] in starts and own[0]["once"]:
                    self.pair[c, starts[m["element"]]] = r  # an element that stands once, from start to end


class Overlay:
    """A template laid over one page's tokens. open: instances of classes that the next token lies in, as
    [class, rank of its last token, number of the instance], outermost first."""

    def __init__(self, template: Template, found: list):
        self.t, self.open, self.bad, self.parents = template, [], Counter(), Counter()
        ranks: dict[int, list[int]] = defaultdict(list)
        for key, *_ in found:
            if (p := template.place.get(key)) is not None:
                ranks[p[0]].append(p[1])
        # in order: the ranks of all tokens, again and again
        self.ordered = {c for c, r in ranks.items() if r == list(range(template.size[c])) * (len(r) // template.size[c])}
        for c in ranks.keys() - self.ordered:
            self.bad[c] += 1
        self.seen = ranks.keys()

    def step(self, key: int) -> tuple[int, int] | None:
        """Takes in a token; its class and rank, if it is of a class that is in order."""
        p = self.t.place.get(key)
        if p is None or p[0] not in self.ordered:
            return None
        c, r = p
        if r == 0:
            up = self.open[-1] if self.open else (0, -1)
            self.parents[c, up[0], up[1]] += 1
            self.open.append([c, 0])
            return p
        while self.open and self.open[-1][0] != c:  # an instance that c's token cuts
            other = self.open[-1][0]
            if not any(o[0] == c for o in self.open):
                return p
            less = min((c, other), key=lambda x: (self.t.rows[x], self.t.size[x], x))
            self.bad[less] += 1
            self.open.pop()
        if self.open:
            self.open[-1][1] = r
            if r == self.t.size[c] - 1:
                self.open.pop()
        return p


MEMBERS = "array<struct<cls:bigint,place:bigint,key:bigint,kind:int,element:bigint,depth:int,once:boolean,rows:bigint>>"


def deduce_templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host, members and found (as Template takes them) for each host of pages (host, html) that has
    classes. Two scans of pages, and aggregations by token and by slot."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple[str, int], list] = {}
        names = ["host", "key", "rows", "v1", "v2", "bits", "place", "once", "kind", "element", "depth"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int32()]

        def flush():
            rows = [(*k, *v) for k, v in acc.items()]
            acc.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

        for b in batches:
            for host, html in zip(b.column(0).to_pylist(), b.column(1)):
                html = html.as_py() or ""
                page = xxhash.xxh3_64_intdigest(html.encode())
                here: dict[int, list] = {0: [1, 0, 0, 0, 0]}
                for at, (key, kind, node, _, _) in enumerate(tokens(walk(html))):
                    got = here.get(key)
                    if got is None:
                        here[key] = [1, at, kind, _key(node.path) if kind else 0, node.depth]
                    else:
                        got[0] += 1
                for key, (n, at, kind, element, depth) in here.items():
                    mark = xxhash.xxh3_64_intdigest(f"{page}:{n}".encode())
                    got = acc.get((host, key))
                    if got is None:
                        acc[host, key] = [1, mark & 0xFFFFFFFF, mark >> 32, 1 << page % 63, at, n == 1, kind, element, depth]
                    else:
                        got[0] += 1
                        got[1] += mark & 0xFFFFFFFF
                        got[2] += mark >> 32
                        got[3] |= 1 << page % 63
                        got[4] += at
                        got[5] &= n == 1
                if len(acc) > 100_000:
                    yield flush()
        yield flush()

    raw = pages.select("host", "html").mapInArrow(count, "host string, key long, rows long, v1 long, v2 long, bits long, place long, once boolean, kind int, element long, depth int")
    total = [F.sum(c).alias(c) for c in ("rows", "v1", "v2", "place")] + [F.bit_or("bits").alias("bits"), F.min("once").alias("once")] + [F.max(c).alias(c) for c in ("kind", "element", "depth")]
    # no more distinct pages are counted than there are, since bits of a digest stand for them
    seen = scratch.put(raw.groupBy("host", "key").agg(*total).where((F.bit_count("bits") >= PAGES) | (F.col("key") == 0)))
    hosts = seen.where("key = 0").select("host", F.col("rows").alias("total"))
    often = seen.where((F.col("key") != 0) & (F.bit_count("bits") >= PAGES)).join(hosts, "host").where(F.col("rows") >= F.col("total") * SHARE)
    vector = ["host", "rows", "v1", "v2"]
    classes = often.groupBy(*vector).agg(F.count("*").alias("size"), F.sum((F.col("kind") > 0).cast("int")).alias("tags")).where("size > 1 and tags > 0")
    tied = often.join(classes.select(*vector), vector).withColumn("cls", F.xxhash64("rows", "v1", "v2"))
    members = scratch.put(tied.groupBy("host").agg(F.collect_list(F.struct("cls", "place", "key", "kind", "element", "depth", "once", "rows")).cast(MEMBERS).alias("members")))  # bounded by SHARE

    sums = ["bad", "pages", "chars", "linked", "fixed_in", "data_in", "fixed_out", "data_out"]

    def lay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple, list[int]] = defaultdict(lambda: [0] * len(sums))
        known: dict[str, Template] = {}

        def flush():
            rows = [(*k, *v) for k, v in acc.items()]
            acc.clear()
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32()] + [pa.int64()] * len(sums)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["host", "cls", "slot", "parent", "pslot", *sums])

        for b in batches:
            for host, html, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if host not in known:
                    if len(known) > 200:
                        known.clear()
                    known[host] = Template(own.as_py(), None)
                found = list(tokens(walk(html.as_py() or "")))
                over = Overlay(known[host], found)
                fixed, data = defaultdict(lambda: [0, 0]), [0, 0]
                for key, kind, node, text, region in found:
                    p = over.step(key)
                    if not kind:
                        size, out = len(space(text)), not region
                        if p is not None:
                            fixed[p[0]][out] += size
                        else:
                            data[out] += size
                            if over.open:
                                slot = acc[host, over.open[-1][0], over.open[-1][1], 0, 0]
                                slot[2] += size
                                slot[3] += size * node.link
                for (c, up, at), _ in over.parents.items():
                    acc[host, c, -1, up, at][1] += 0
                for c in over.seen:
                    one = next(((up, at) for k, up, at in over.parents if k == c), (0, -1))
                    row = acc[host, c, -1, *one]
                    for i, x in enumerate((over.bad[c], 1, 0, 0, fixed[c][0], data[0], fixed[c][1], data[1])):
                        row[i] += x
                if len(acc) > 100_000:
                    yield flush()
        yield flush()

    laid = pages.select("host", "html").join(members, "host").select("host", "html", "members").mapInArrow(lay, "host string, cls long, slot int, parent long, pslot int, " + ", ".join(f"{c} long" for c in sums))
    said = laid.groupBy("host", "cls", "slot", "parent", "pslot").agg(*[F.sum(c).alias(c) for c in sums])
    found = said.groupBy("host").agg(F.collect_list(F.struct("cls", "slot", "parent", "pslot", *sums)).alias("found"))  # some rows for each token
    return scratch.put(members.join(found, "host").select("host", "members", "found"))


def blocks_of(page: str, template: Template | None = None) -> list[str]:
    """Blocks of the main text in page order."""
    events = list(walk(page))
    found = list(tokens(events))
    over = Overlay(template, found) if template is not None else None
    marks, spans, slot_of = {0: ""}, [], []
    starts: dict[tuple[int, int], tuple[int, int]] = {}
    for at, (key, kind, node, _, region) in enumerate(found):
        if region:
            marks[region] = max(marks.get(region, ""), "z" if node.main[:1] in "ab" and node.main else node.main, key=lambda v: (v == "z", v))
        p = over.step(key) if over else None
        slot_of.append((p, tuple(over.open[-1]) if over and over.open else None))
        if p is not None and p in template.pair:
            starts[p[0], template.pair[p]] = (at, node.depth)
        elif p is not None and p in starts:
            spans.append((starts[p][1], starts[p][0], at))
    article = {r for r, v in marks.items() if v == "z"} or {r for r, v in marks.items() if v}

    def template_text(at: int) -> bool:
        p = slot_of[at][0]
        return p is not None and not found[at][1] and template.text.get(p[0], (True, True))[not found[at][4]]

    keep = [False] * len(found)
    if article:
        for at, (_, kind, _, _, region) in enumerate(found):
            keep[at] = region in article and not kind and not template_text(at)
    else:
        size = [0 if kind or template_text(at) else len(space(text)) for at, (_, kind, _, text, _) in enumerate(found)]
        least, all_ = (0, 0, len(found)), sum(size)
        for depth, a, b in spans:
            if depth > least[0] and sum(size[a:b]) >= MOST * all_ > 0:
                least = (depth, a, b)
        for at in range(least[1], least[2]):
            chars, linked = template.slots.get(slot_of[at][1], (0, 0)) if over and slot_of[at][1] else (0, 0)
            keep[at] = size[at] > 0 and 2 * linked <= chars
    out: list[list] = [["", 0, 0]]
    at = -1
    for kind, node, text, _ in events:
        if kind != "text":
            if node.tag not in INLINE:
                out.append(["", 0, 0])
            at += not node.gone and node.tag not in INLINE and node.tag not in VOID
        elif not node.gone:
            if t := space(text):
                at += 1
            if not t or keep[at]:
                out[-1][0] += text
                out[-1][1 + node.link] += len(t)
    blocks = [(space(entities.unescape(t)), plain, linked) for t, plain, linked in out]
    return [t for t, plain, linked in blocks if t and (article or template is not None or linked <= plain or linked < 20 and plain > 0)]


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", out_col: str = "text") -> DataFrame:
    """One row for each row of pages: id, url, and the main text as blocks in page order joined by one
    space, white space within a block collapsed and character references decoded.

    The whole page is read. Null and empty pages, and pages without an article, have an empty text. A
    null or odd url counts as the empty host, its pages as those of one host. Repeated rows, and rows with
    equal pages, count once in their host's template and come back as often as they are; ids play no part
    in it and may be null. All articles of a page are kept. Other columns of pages are not read.
    """
    scratch = Scratch(pages.sparkSession, "html")
    src = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html")).withColumn("host", host_of(F.col("url")))
    templates = deduce_templates(src.select("host", "html"), scratch)
    kinds = dict(src.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for b in batches:
            out = []
            for host, html, members, found in zip(b.column(2).to_pylist(), *(b.column(i) for i in (3, 4, 5))):
                if members.is_valid and host not in known:
                    if len(known) > 200:
                        known.clear()
                    known[host] = Template(members.as_py(), found.as_py())
                out.append(" ".join(blocks_of(html.as_py() or "", known.get(host))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["id", "url", "text"])

    both = src.join(templates, "host", "left").select("id", "url", "host", "html", "members", "found")
    return both.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string").toDF(id_col, url_col, out_col)
