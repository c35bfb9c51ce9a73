"""Main-text extraction by wrapper induction.

Pages are parsed to DOM trees of their block elements, with runs of text as leaves. A run
(its element's label, that is tag, class and id with digits folded, and its text) that half of a host's pages have is constant;
runs are counted over all pages of the host, so no order of pages changes a count. The host's
template is the tree of the page that has most constant runs, pruned to them and the elements
above them: an ordered tree.

Extraction aligns every page with its host's template by simple tree matching: the largest
order-preserving matching of children, level by level, by dynamic programming, on stacks of its own, so depth
is no limit. Constant runs that are matched are template, wherever they stand, in the page's article element (or
main) too; what varies, and a constant text that stands where the template has none, is content. Elements that say
they are something else (menus, asides, adverts, forms, comments) go as well, which is for the slots that vary
and are not the article. Of what is left all article elements (or main ones) are the main text, in page order; on pages
without, the container that has most of it. An article of which nothing
varies (a page that its host repeats) is kept by the element rules alone.

Defined results: null or empty pages have an empty text; pages without a host
are a group of their own under the empty host; repeated rows are extracted one
by one; hosts with fewer than ``LEAST_PAGES`` pages have no template; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import scratch, small_batches, written

#: Up to so many bytes of templates are sent to every executor; more are joined by host.
BROADCAST_BYTES = 32 << 20
#: A constant run is on so many pages at least, and on half of the host's.
LEAST_PAGES = 3

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe select button".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("li dd dt td th tr tbody thead tfoot caption option optgroup legend summary body html".split())
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# What is not the article, by element, role, and words of class and id.
OTHER_TAGS = frozenset("head nav footer aside form dialog menu".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu topbar masthead footer sidebar aside notice notices cookie cookies consent gdpr popup modal newsletter subscribe signup login comment comments commentlist respond disqus replies share sharing social related recommended breadcrumb breadcrumbs pagination pager widget toolbar alert search copyright".split()
)

#: Words that, beside one of those above, still name no more than a part of it: "related-posts" is not the article, "related-work" may be.
PARTS = frozenset("box block container wrapper wrap area section list item items link links post posts article articles bar form button buttons top bottom left right inner outer site page global primary secondary slot unit header text title label icon icons image panel row col group body".split())
#: Elements that a class alone makes something else; a paragraph or heading is what it is.
HOLDERS = frozenset("div section ul ol table tr td li dl span ins center fieldset details figure header main article body".split())

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|([!?]))")
_REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}


class Element:
    __slots__ = ("children", "label", "other", "role", "tag")

    def __init__(self, tag: str, label: str, role: str = "", other: bool = False):
        self.tag, self.label, self.role, self.other = tag, label, role, other
        self.children: list[Element | str] = []


def _says_other(name: str) -> bool:
    words = _WORD.findall(name)
    return any(w in OTHER_WORDS for w in words) and all(w in OTHER_WORDS or w in PARTS for w in words)


def _element(tag: str, rest: str) -> Element:
    if len(rest) <= 1:
        return Element(tag, tag)
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(rest)}
    if not found:
        return Element(tag, tag)
    name = f"{found.get('class', '')} {found.get('id', '')}".strip().lower()
    role = found.get("role", "").lower()
    words = set(_WORD.findall(name))
    hidden = "hidden" in found
    other = hidden or role in OTHER_ROLES or (tag in HOLDERS and any(map(_says_other, name.split())))
    if role == "main" or found.get("itemprop", "").lower() == "articlebody":
        role = "main"
    return Element(tag, f"{tag}.{_DIGITS.sub('#', name)}" if name else tag, "header" if "header" in words and role == "" else role, other)


def parse(page: str) -> Element:
    """The DOM tree of a page, as forgiving as browsers about what is left open."""
    root = Element("html", "html")
    stack, at, n = [root], 0, len(page)

    def close(names: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        if m[1]:
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        rest = _REST.match(page, m.end())
        if rest is None:
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
        else:
            at = rest.end()
        if m[4]:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag in ("body", "html"):
                continue
            close((tag,), ("article", "main", "body") if tag not in BLOCK else ())
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = n if end is None else end.end()
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P:
            close(("p",), ("article", "main", "div", "section", "td", "li", "body", "blockquote"))
        if tag in CLOSES_SAME:
            close(CLOSES_SAME[tag], HOLDS[tag])
        new = _element(tag, page[m.end() : at])
        stack[-1].children.append(new)
        if tag not in VOID and not page.startswith("/>", at - 2):
            stack.append(new)
    return root


def _sign(label: str, text: str) -> int:
    return int.from_bytes(blake2b(f"{label} {text}".encode(), digest_size=8).digest(), "big", signed=True)


def is_other(x: Element, inside: bool) -> bool:
    if x.tag in ("article", "main", "body"):
        return inside and x.other
    return x.tag in OTHER_TAGS or x.other or (not inside and (x.tag == "header" or x.role == "header"))


class Page:
    """A page's block elements and runs of text, in page order; parents come before their children.

    ``key`` is an element's label or a run's sign, ``text`` a run's text; ``other`` says that an element around is something else.
    """

    def __init__(self, root: Element):
        self.key: list[str | int] = [root.label]
        self.text: list[str | None] = [None]
        self.up, self.other, self.kids = [-1], [False], [[]]
        self.articles: list[int] = []
        self.mains: list[int] = []
        held: list[str] = []

        def add(key, text, up: int, other: bool) -> int:
            k = len(self.key)
            self.key.append(key)
            self.text.append(text)
            self.up.append(up)
            self.other.append(other)
            self.kids.append([])
            self.kids[up].append(k)
            return k

        def flush(at: int) -> None:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                add(_sign(self.key[at], text), text, at, self.other[at])

        # What is left of an element, its place, whether it is a block, and whether it is in an article.
        stack = [(iter(root.children), 0, True, False)]
        while stack:
            left, at, block, inside = stack[-1]
            for c in left:
                if isinstance(c, str):
                    held.append(c)
                elif c.tag in ("br", "hr", "img"):
                    held.append(" ")
                elif c.tag in BLOCK:
                    flush(at)
                    new = add(c.label, None, at, self.other[at] or is_other(c, inside))
                    main = c.tag == "main" or c.role == "main"
                    if c.tag == "article" and not inside and not self.other[new]:
                        self.articles.append(new)
                    elif main and not inside and not self.other[new]:
                        self.mains.append(new)
                    stack.append((iter(c.children), new, True, inside or c.tag == "article" or main))
                    break
                elif not is_other(c, inside):
                    stack.append((iter(c.children), at, False, inside))
                    break
            else:
                stack.pop()
                if block:
                    flush(at)

    def signs(self) -> set[int]:
        return {k for k, t in zip(self.key, self.text, strict=True) if t is not None}


def template_of(page: Page, constants: frozenset[int]) -> list[list]:
    """The tree of a page pruned to its constant runs, as (depth, key) in page order."""
    keep = [t is not None and k in constants for k, t in zip(page.key, page.text, strict=True)]
    depth = [0] * len(keep)
    for k in range(1, len(keep)):
        depth[k] = depth[page.up[k]] + 1
    for k in range(len(keep) - 1, 0, -1):
        if keep[k]:
            keep[page.up[k]] = True
    return [[depth[k], page.key[k]] for k in range(len(keep)) if keep[k]]


class Template:
    """A pruned tree with its children by node."""

    def __init__(self, flat: list[list]):
        self.key = [key for _, key in flat]
        self.kids: list[list[int]] = [[] for _ in flat]
        above: list[int] = []
        for k, (depth, _) in enumerate(flat):
            del above[depth:]
            if above:
                self.kids[above[-1]].append(k)
            above.append(k)


def _best_children(a: list[int], b: list[int], weight) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest order-preserving matching of two rows of children."""
    rows = [[0] * (len(b) + 1)]
    weights = [[weight(x, y) for y in b] for x in a]
    for w in weights:
        last, row = rows[-1], [0]
        for j, v in enumerate(w):
            row.append(max(last[j + 1], row[j], last[j] + v))
        rows.append(row)
    i, j, pairs = len(a), len(b), []
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((a[i], b[j]))
    return rows[-1][-1], pairs


def align(t: Template, page: Page) -> tuple[int, set[int]]:
    """Simple tree matching: the number of matched nodes, and the page's nodes among them."""
    if not t.key or t.key[0] != page.key[0]:
        return 0, set()
    size: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    todo = [(0, 0, False)]
    while todo:
        i, j, ready = todo.pop()
        wanted = {t.key[x] for x in t.kids[i]}
        mine = [y for y in page.kids[j] if page.key[y] in wanted] if wanted else []
        if not ready:
            todo.append((i, j, True))
            todo += [(x, y, False) for x in t.kids[i] if t.kids[x] for y in mine if t.key[x] == page.key[y]]
            continue
        # A pair of runs, or of elements without children in the template, is one node.
        weight = lambda x, y: size.get((x, y), 1) if t.key[x] == page.key[y] else 0
        inner, chosen[i, j] = _best_children(t.kids[i], mine, weight) if mine else (0, [])
        size[i, j] = 1 + inner
    matched, todo = set(), [(0, 0)]
    while todo:
        i, j = todo.pop()
        matched.add(j)
        todo += chosen.get((i, j), ())
    return size[0, 0], matched


#: What may hold nearly all of an article on pages without an article element.
_SHARE = 0.6


def main_text(page: str, template: Template | None = None) -> str:
    """The article of a page; blocks are joined by two line ends."""
    if not page:
        return ""
    x = Page(parse(page))
    matched = align(template, x)[1] if template is not None else set()
    runs = [k for k, t in enumerate(x.text) if t is not None and not x.other[k]]
    for roots in (x.articles, x.mains):
        if roots:
            within = [False] * len(x.key)
            for k in roots:
                within[k] = True
            for k in range(1, len(within)):
                within[k] = within[k] or within[x.up[k]]
            mine = [k for k in runs if within[k]]
            if mine:
                return "\n\n".join(x.text[k] for k in ([k for k in mine if k not in matched] or mine))
    runs = [k for k in runs if k not in matched]
    length = [0] * len(x.key)
    for k in runs:
        length[k] = len(x.text[k])
    for k in range(len(length) - 1, 0, -1):
        length[x.up[k]] += length[k]
    at = 0
    while True:
        best = max((k for k in x.kids[at] if x.text[k] is None), key=length.__getitem__, default=at)
        # One container with nearly all of what varies is the article, or holds it; a single block is not a container.
        if best == at or length[best] < _SHARE * length[at] or all(x.text[k] is not None for k in x.kids[best]):
            break
        at = best
    within = [False] * len(x.key)
    within[at] = True
    for k in range(at + 1, len(within)):
        within[k] = within[x.up[k]]
    return "\n\n".join(x.text[k] for k in runs if within[k])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))


#: Signs that a partition counts before it sends them on.
HELD_SIGNS = 200_000


def _count_signs(batches):
    """(host, sign, n): the pages of each run, and under a null sign all pages; sent on whenever many are held."""
    counts: Counter[tuple[str, int | None]] = Counter()

    def send():
        rows = list(counts.items())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([h for (h, _), _ in rows], pa.string()), pa.array([x for (_, x), _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], ["host", "sign", "n"])

    for rows in batches:
        for host, page in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            counts.update((host, sign) for sign in Page(parse(page)).signs())
            counts[host, None] += 1
            if len(counts) >= HELD_SIGNS:
                yield send()
    yield send()


def _seed_trees(known: dict[str, frozenset[int]] | None):
    """(host, size, tree): of a partition's pages of each host the template with most runs; of as many the first as text."""

    def run(batches):
        best: dict[str, tuple[int, str]] = {}

        def send():
            out = [pa.array(list(best), pa.string()), pa.array([n for n, _ in best.values()], pa.int64()), pa.array([x for _, x in best.values()], pa.string())]
            best.clear()
            return pa.RecordBatch.from_arrays(out, ["host", "size", "tree"])

        for rows in batches:
            for k, (host, page) in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)):
                constants = known.get(host) if known is not None else frozenset(rows.column(2)[k].as_py())
                if not constants:
                    continue
                x = Page(parse(page))
                flat = template_of(x, constants)
                mine = (sum(isinstance(key, int) for _, key in flat), json.dumps(flat))
                best[host] = max(best.get(host, mine), mine)
            if sum(len(x) for _, x in best.values()) > BROADCAST_BYTES:
                yield send()
        yield send()

    return run


def _is_small(table: DataFrame, size: Column) -> bool:
    return (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def induce(pages: DataFrame, url="url", html="html") -> DataFrame:
    """(host, tree): the template of each host that has one."""
    base = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")).filter(F.col("html") != "")
    counted = written(base.mapInArrow(_count_signs, "host string, sign long, n long"), "signs")
    of = counted.filter("sign IS NULL").groupBy("host").agg(F.sum("n").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    shared = counted.filter("sign IS NOT NULL").groupBy("host", "sign").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_PAGES)
    # Runs on half of the pages are twice a page's runs at most, on average.
    constants = written(shared.join(of, "host").filter("2 * n >= pages").groupBy("host").agg(F.collect_list("sign").alias("constants")), "constants")
    if _is_small(constants, F.octet_length("host") + 8 * F.array_size("constants")):
        known = {r.host: frozenset(r.constants) for r in constants.toLocalIterator()}
        seeds = base.filter(F.lit(bool(known))).mapInArrow(_seed_trees(known), "host string, size long, tree string")
    else:
        seeds = base.join(constants, "host").select("host", "html", "constants").mapInArrow(_seed_trees(None), "host string, size long, tree string")
    return seeds.groupBy("host").agg(F.max(F.struct("size", "tree")).alias("x")).select("host", "x.tree")


_OUT = "id long, url string, text string, n_chars long"


def _extract(known: dict[str, str] | None):
    def run(batches):
        trees: dict[str, Template | None] = {}
        for rows in batches:
            ids, urls, hosts, pages = (rows.column(k) for k in range(4))
            texts = []
            for k, (host, page) in enumerate(zip(hosts.to_pylist(), pages.to_pylist(), strict=True)):
                if host not in trees:
                    raw = known.get(host) if known is not None else rows.column(4)[k].as_py()
                    if len(trees) > 5000:
                        trees.clear()
                    trees[host] = Template(json.loads(raw)) if raw else None
                texts.append(main_text(page, trees[host]))
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, key="page_id", url="url", html="html") -> DataFrame:
    """(key, url, text, n_chars) of each page: its main text and that text's code points."""
    spark = pages.sparkSession
    small_batches(spark)
    with scratch(spark):
        templates = written(induce(pages, url, html), "templates", keep=True)
    base = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), host_of(F.col(url)).alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    if _is_small(templates, F.octet_length("tree") + F.octet_length("host")):
        out = base.mapInArrow(_extract({r.host: r.tree for r in templates.toLocalIterator()}), _OUT)
    else:
        out = base.join(templates, "host", "left").select("id", "url", "host", "html", "tree").mapInArrow(_extract(None), _OUT)
    return out.select(F.col("id").alias(key), "url", "text", "n_chars")
