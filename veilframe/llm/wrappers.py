"""HTML extraction with wrappers inferred from the pages of a host.

The pages of a host come from a few templates; pages of a host whose bodies have the same kinds of children are one cluster. A
wrapper is a union-free regular expression over the tokens of all distinct pages of a cluster: adjacent siblings of the same
shape fold into a repeated group, then pages are aligned one after the other; where two streams agree the wrapper keeps the token,
where texts differ it gets a text slot, and tokens that one side lacks become an optional group. Wrappers align with each
other as pages do, so tasks infer wrappers of their own pages, which are then merged in two rounds. A text place also counts its pages and
its commonest texts (Misra-Gries counters, which merge): inside a repeated group these tell the template's lines from slots.

A page is then read as a whole and matched against the wrapper of its cluster. Scripts, styles and markup never reach the text;
elements that their names, roles or class and id words mark as menus, headers, footers, sidebars, notices, adverts, forms or
comments are left out (inside an article class and id words count only for what recurs on half of the cluster's pages); text that the wrapper matches as template text is left out. Of the rest, what stands in the cluster's
main place, the deepest one that holds most of the text in slots, is the text. The article or main elements are a hint: where one
holds half of that text or more, its borders are taken instead. Character references are decoded, white space inside a block
becomes one space, blocks are joined by an empty line (two newlines), nothing else is dropped.

Edge cases: null and empty html give an empty text; a null url has an empty host; unclosed and stray tags, truncated pages and
unquoted attributes are read as far as they make sense; pages of a cluster of fewer than ``least_pages`` distinct pages share
a wrapper with the host's other such pages, and where these are too few are read by names alone;
repeated rows are read each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import map_texts, materialize, small
from veilframe.llm.url_filter import split_url


@dataclass(frozen=True)
class Sampling:
    """From how many distinct pages on a wrapper counts, and what makes template text."""

    least_pages: int = 3
    #: Share of a place's pages that carry a template text, and counters of commonest texts per place.
    template_share: float = 0.9
    counters: int = 32
    #: Share of the text in slots that the main place holds at least.
    main_share: float = 0.7
    #: A task hands on its wrappers when it has so many, and a wrapper's parts are first merged in so many heaps.
    held: int = 200
    heaps: int = 16


# Fixed values of the HTML standard and common usage.
RAW = "script style noscript template svg math textarea select option iframe object canvas audio video title".split()
CODE = "script style title textarea select option".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "button": {"button"}}
HEAD = frozenset("base link meta".split())
#: Where its end tag is missing, one of LOOSE ends where one of CONTENT begins.
LOOSE = frozenset("nav button label".split())
CONTENT = frozenset("article main section div h1 p header footer".split())
BOUNDS = frozenset("ul ol dl table body html article section div".split())
ASIDE_TAGS = frozenset("nav aside footer form button dialog menu head label fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners promo promos promotion sponsor sponsored sponsors sidebar sidebars widget widgets related recommended recommendations nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer foot header masthead topbar cookie cookies consent gdpr notice notices notification popup modal overlay alert newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus reply replies respond "
    "search pagination pager copyright disclaimer skip toolbar".split()
)

ATTRS = r"(?:[^\"'>]++|\"[^\"]*+\"|'[^']*')*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # A self-closed element has no content; an unquoted value's last slash doesn't close. Scripts and the like close themselves only where no end tag follows.
    r"|<(?P<code>" + "|".join(CODE) + rf")(?=[\s/>])(?:{ATTRS}|[^>]*)>.*?</(?P=code)\s*>"
    r"|<(?:" + "|".join(RAW) + rf")(?=[\s/>])(?:\s*/|{ATTRS}(?<=[\s\"']/))>"
    r"|<(?P<raw>" + "|".join(RAW) + rf")(?=[\s/>])(?:{ATTRS}|[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{ATTRS})>|<[!?/a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)} if "=" in attrs else {}


def is_aside(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether an element holds something beside the article."""
    if name in ASIDE_TAGS or name == "header" and not in_article:
        return True
    if name in ("html", "body", "main") or not attrs or name == "header":
        return False
    return attrs.get("role", "").lower() in ASIDE_ROLES or not in_article and has_aside_word(attrs)


def has_aside_word(attrs: dict[str, str], in_article: bool = False) -> bool:
    """A header inside an article belongs to it, whether by name or by class."""
    return any(w.lower() in ASIDE_WORDS and not (in_article and w.lower() == "header") for key in ("class", "id") for w in WORDS.findall(attrs.get(key, "")))


@dataclass
class Element:
    name: str
    key: str
    aside: bool
    article: bool
    main: bool
    path: str
    part: str = ""  # inside an article: the place of the outermost element whose class or id words mark it
    loose: bool = False


def events(source: str) -> Iterator[tuple[str, Element | None, str]]:
    """(kind, element, text) of a page: 'open' and 'close' of elements and 'text' inside them; end tags are implied where HTML does."""
    stack: list[Element] = []
    ends: dict[str, int] = {}  # where the next end tag of a name stands

    def ended(name: str, at: int) -> bool:
        if ends.get(name, -1) < at:
            m = re.compile(rf"</{name}[\s/>]", re.I).search(source, at)
            ends[name] = m.start() if m else len(source)
        return ends[name] < len(source)

    for m in TOKEN.finditer(source):
        # Anything but metadata ends the head.
        if stack and stack[-1].name == "head" and (not m["text"].isspace() if m["text"] is not None else m["name"] and not m["end"] and m["name"].lower() not in HEAD):
            yield "close", stack.pop(), ""
        if m["text"] is not None:
            yield "text", stack[-1] if stack else None, m["text"]
        elif m["name"]:
            name = m["name"].lower()
            if m["end"]:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), -1)
                if at >= 0:
                    while len(stack) > at:
                        yield "close", stack.pop(), ""
                elif name in BLOCK:
                    yield "break", stack[-1] if stack else None, ""
                continue
            if name in VOID:
                yield ("break" if name == "hr" else "space"), stack[-1] if stack else None, ""
                continue
            shut = CLOSES.get(name) or ({"p"} if name in BLOCK else ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in shut:
                    while len(stack) > i:
                        yield "close", stack.pop(), ""
                elif stack[i].name in BOUNDS:
                    break
            if name in CONTENT:
                at = next((i for i, x in enumerate(stack) if x.loose), len(stack))
                while len(stack) > at:
                    yield "close", stack.pop(), ""
            attrs = attributes(m["attrs"])
            above = stack[-1] if stack else Element("", "", False, False, False, "")
            words = ".".join(sorted(WORDS.findall(attrs.get("class", ""))))
            key = name + (f".{words}" if words else "")
            marked = above.article and name not in HEADINGS and has_aside_word(attrs, True)
            if marked and has_aside_word({"id": attrs.get("id", "")}, True):
                key += f"#{digest(attrs['id'])}"
            aside = above.aside or is_aside(name, attrs, above.article)
            article = not aside and (above.article or name == "article" or attrs.get("itemprop", "").lower() == "articlebody")
            main = not aside and (above.main or name == "main" or attrs.get("role", "").lower() == "main")
            # A path names block elements only: emphasis doesn't make another place.
            path = f"{above.path}/{key}" if name in BLOCK else above.path
            stack.append(Element(name, key, aside, article, main, path, above.part or (path if marked and not aside else ""), name in LOOSE and not ended(name, m.end())))
            yield "open", stack[-1], ""
    while stack:
        yield "close", stack.pop(), ""


@dataclass
class Block:
    text: str
    path: str
    aside: bool
    article: bool
    main: bool
    part: str


# A wrapper is a list of items: ("tag", key, items, pages), ("text", literal or None for a slot, characters, pages, counters of
# texts by hash), ("opt", items), ("rep", items). A page's own stream has the same tags, and ("text", number of its block).


#: Elements nested deeper stand beside each other in a wrapper.
DEEP = 80


def read_page(source: str | None) -> tuple[list[Block], list]:
    """The text blocks of a page in order, decoded and with white space collapsed, and its tokens as nested items."""
    out: list[Block] = []
    root: list = []
    stack = [root]
    parts: list[str] = []
    owner: Element | None = None

    def flush() -> None:
        nonlocal parts, owner
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        if text:
            e = owner or Element("", "", False, False, False, "")
            stack[-1].append(("text", len(out)))
            out.append(Block(text, e.path, e.aside, e.article, e.main, e.part))
        parts, owner = [], None

    for kind, e, text in events(source or ""):
        if kind == "text":
            if owner is not None and e is not None and (e.path, e.aside, e.part) != (owner.path, owner.aside, owner.part):
                flush()
            if owner is None and not text.isspace():
                owner = e
            parts.append(text)
        elif kind == "space":
            parts.append(" ")
        elif kind == "break" or e is not None and e.name in BLOCK:
            flush()
            if kind == "open" and len(stack) > DEEP:
                stack.append(stack[-1])
            elif kind == "open":
                item = ("tag", e.key, [], 1)
                stack[-1].append(item)
                stack.append(item[2])
            elif kind == "close" and len(stack) > 1:
                stack.pop()
    flush()
    return out, root


def page_blocks(source: str | None) -> list[Block]:
    return read_page(source)[0]


def cluster(items: list) -> str:
    """The template of a page: the kinds of its body's children."""
    inner = items
    while (deeper := [x for x in inner if x[0] == "tag" and x[1].partition(".")[0] in ("html", "body")]):
        inner = [y for x in deeper for y in x[2]]
    return digest(" ".join(sorted({x[1] for x in inner if x[0] == "tag"})))


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def shape(item: tuple) -> str:
    if item[0] == "text":
        return "#"
    return item[1] if item[0] == "tag" else shape(item[1][0]) if item[1] else ""


def parse(source: str, s: Sampling = Sampling()) -> list:
    """The token stream of a page as nested items, with siblings of one shape folded into repeated groups."""
    return stream(*read_page(source))


def stream(blocks: list[Block], items: list) -> list:
    def put(items: list) -> list:
        out = []
        for i in items:
            if i[0] == "tag":
                out.append(("tag", i[1], put(i[2]), 1))
            else:
                text = blocks[i[1]].text
                out.append(("text", text, len(text), 1, {digest(text): 1}))
        return out

    return fold(put(items))


def fold(items: list) -> list:
    """Adjacent elements of one shape become a repeated group of their alignment."""
    out: list = []
    for item in items:
        if item[0] == "tag":
            item = ("tag", item[1], fold(item[2]), item[3])
            if out and out[-1][0] in ("tag", "rep") and shape(out[-1]) == item[1]:
                before = out.pop()
                inner = before[1] if before[0] == "rep" else [before]
                out.append(("rep", align(inner, [item], one_page=True)))
                continue
        out.append(item)
    return out


def optional(items: list) -> list:
    return [x if x[0] == "opt" else ("opt", [x]) for x in items]


def merge_counts(a: dict[str, int], b: dict[str, int], one_page: bool, most: int) -> dict[str, int]:
    """Counts add over pages; inside a page a text counts once. More than ``most`` counters are all lowered by the next one's count."""
    out = dict(a)
    for k, n in b.items():
        out[k] = max(out.get(k, 0), n) if one_page else out.get(k, 0) + n
    if len(out) > most and not one_page:
        least = sorted(out.values(), reverse=True)[most]
        out = {k: n - least for k, n in out.items() if n > least}
    return out


def merge(a: tuple, b: tuple, one_page: bool = False, s: Sampling = Sampling()) -> tuple:
    """One item for two of the same shape."""
    if a[0] == "opt" or b[0] == "opt":
        return ("opt", align(a[1] if a[0] == "opt" else [a], b[1] if b[0] == "opt" else [b], one_page, s))
    if a[0] == "rep" or b[0] == "rep":
        return ("rep", align(a[1] if a[0] == "rep" else [a], b[1] if b[0] == "rep" else [b], one_page, s))
    pages = max(a[3], b[3]) if one_page else a[3] + b[3]
    if a[0] == "text":
        return ("text", a[1] if a[1] == b[1] else None, a[2] + b[2], pages, merge_counts(a[4], b[4], one_page, s.counters))
    return ("tag", a[1], align(a[2], b[2], one_page, s), pages)


def align(a: list, b: list, one_page: bool = False, s: Sampling = Sampling()) -> list:
    """The wrapper that matches what either list matches: common items merged, the others optional, in order."""
    x, y = [shape(i) for i in a], [shape(i) for i in b]
    if x == y:
        return [merge(i, j, one_page, s) for i, j in zip(a, b, strict=True)]
    out: list = []
    for op, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "equal":
            out.extend(merge(p, q, one_page, s) for p, q in zip(a[i:j], b[k:m], strict=True))
        else:
            out.extend(optional(a[i:j]))
            out.extend(optional(b[k:m]))
    return out


def infer(pages: list[str], s: Sampling = Sampling()) -> list:
    """The wrapper of some pages."""
    wrapper: list | None = None
    for source in pages:
        items = parse(source, s)
        wrapper = items if wrapper is None else align(wrapper, items, s=s)
    return wrapper or []


def expression(items: list) -> str:
    """A wrapper as a regular expression over tokens, for reading."""
    out = []
    for i in items:
        if i[0] == "tag":
            out.append(f"<{i[1]}>{expression(i[2])}</{i[1].partition('.')[0]}>")
        elif i[0] == "text":
            out.append("#TEXT" if i[1] is None else re.escape(i[1]))
        else:
            out.append(f"({expression(i[1])}){'?' if i[0] == 'opt' else '+'}")
    return "".join(out)


def profile(wrapper: list, pages: int, s: Sampling = Sampling()) -> dict:
    """What matching needs of a wrapper: its items with the template texts of every text place, the main place, and the places
    that few of the pages have."""
    slots: Counter[str] = Counter()
    places: Counter[str] = Counter()

    def walk(items: list, path: str, aside: bool) -> list:
        out = []
        for i in items:
            inner = i
            while inner[0] in ("opt", "rep"):
                if len(inner[1]) != 1:
                    break
                inner = inner[1][0]
            if inner[0] == "tag":
                name, _, words = inner[1].partition("#")[0].partition(".")
                places[f"{path}/{inner[1]}"] += inner[3]
                out.append([inner[1], walk(inner[2], f"{path}/{inner[1]}", aside or is_aside(name, {"class": words.replace(".", " ")}, "/article" in path))])
            elif inner[0] == "text":
                fixed = [k for k, n in inner[4].items() if inner[3] >= s.least_pages and n >= s.template_share * inner[3]]
                if not aside and inner[1] is None:
                    # The text of a paragraph speaks for what holds the paragraph.
                    above = path.rpartition("/")[0]
                    while above:
                        slots[above] += inner[2]
                        above = above.rpartition("/")[0]
                    slots[""] += inner[2]
                out.append(["#", fixed])
            else:
                out.extend(walk(inner[1], path, aside))
        return out

    items = walk(wrapper, "", False)
    holding = [p for p in slots if slots[p] >= s.main_share * slots[""] and slots[""]]
    return {"items": items, "main": max(holding, key=lambda p: (p.count("/"), p)) if holding else None, "usual": sorted(p for p, n in places.items() if 2 * n >= pages and is_marked(p))}


def is_marked(path: str) -> bool:
    """Whether class words mark the last element of a place, or id words, which only then are part of it."""
    last = path.rpartition("/")[2]
    return "#" in last or has_aside_word({"class": last.partition(".")[2].replace(".", " ")}, True)


def template_blocks(items: list, page: list, blocks: list[Block]) -> set[int]:
    """Matches a page against a wrapper's items: the blocks that stand as template text at their places."""
    found: set[int] = set()

    def match(items: list, page: list) -> None:
        runs: list[list] = []  # siblings of one shape meet one repeated group
        for i in page:
            if i[0] == "tag" and runs and runs[-1][0][0] == "tag" and runs[-1][0][1] == i[1]:
                runs[-1].append(i)
            else:
                runs.append([i])
        x, y = [i[0] for i in items], [shape(r[0]) for r in runs]
        same = [(0, 0, len(x))] if x == y else SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
        for i, j, n in same:
            for item, run in zip(items[i : i + n], runs[j : j + n], strict=True):
                for one in run:
                    if item[0] != "#":
                        match(item[1], one[2])
                    elif item[1] and digest(blocks[one[1]].text) in item[1]:
                        found.add(one[1])

    match(items, page)
    return found


def extract(source: str | None, about: dict[str, dict] | None = None) -> str:
    """The main text of a page, by the profiles of its host's clusters."""
    blocks, page = read_page(source)
    own = (about.get(cluster(page)) or about.get("")) if about else None
    fixed = template_blocks(own["items"], page, blocks) if own else ()
    # Inside an article a class or id word says less: with a wrapper, it counts where half of the pages have such an element.
    usual = set(own["usual"]) if own else None
    found = [b for k, b in enumerate(blocks) if not b.aside and k not in fixed and not (b.part and (usual is None or b.part in usual))]
    main = own["main"] if own else None
    chosen = [b for b in found if main is not None and (b.path == main or b.path.startswith(f"{main}/"))] or found
    size = lambda lot: sum(len(b.text) for b in lot)
    if 2 * size(b for b in chosen if b.article) >= size(chosen):
        chosen = [b for b in found if b.article]
    elif 2 * size(b for b in chosen if b.main) >= size(chosen):
        chosen = [b for b in found if b.main]
    return "\n\n".join(b.text for b in chosen)


PARTS = "host string, cluster string, n long, at long, wrapper string"


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, h, html) of the distinct pages; only pages that have copies move."""
    own = pages.where(F.col("html").isNotNull()).select(split_url(F.col("url"))[0].alias("host"), F.xxhash64("html").alias("h"), "html")
    copied = materialize(own.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("host").alias("_host"), F.col("h").alias("_h")))
    on = (F.col("host") == F.col("_host")) & (F.col("h") == F.col("_h"))
    if copied.isEmpty():
        return own
    copied = small(copied)
    return own.join(copied, on, "left_anti").unionAll(own.join(copied, on, "left_semi").dropDuplicates(["host", "h"]))


def host_profiles(pages: DataFrame, s: Sampling = Sampling()) -> DataFrame:
    """(host, profiles of its clusters as JSON) from all distinct pages of every host."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}

        def hand_on() -> pa.RecordBatch:
            rows = [(h, c, n, at, json.dumps(w)) for (h, c), (n, at, w) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["host", "cluster", "n", "at", "wrapper"])

        for b in batches:
            for host, h, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                blocks, page = read_page(source.as_py())
                key, items = (host, cluster(page)), stream(blocks, page)
                if key in held:
                    n, at, w = held[key]
                    held[key] = [n + 1, min(at, h), align(w, items, s=s)]
                else:
                    held[key] = [1, h, items]
                    if len(held) >= s.held:
                        yield hand_on()
        if held:
            yield hand_on()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: tuple, n: int, at: int, w: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.string()), pa.array([n], pa.int64()), pa.array([at], pa.int64()), pa.array([json.dumps(w)], pa.string())], names=["host", "cluster", "n", "at", "wrapper"])

        key, n, at, w = None, 0, 0, []
        for b in batches:
            for host, kind, m, first, text in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if (host, kind) != key:
                    if key:
                        yield row(key, n, at, w)
                    key, n, at, w = (host, kind), m, first, json.loads(text)
                else:
                    n, w = n + m, align(w, json.loads(text), s=s)
        if key:
            yield row(key, n, at, w)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in join(batches):
            about = profile(json.loads(b.column(4)[0].as_py()), b.column(2)[0].as_py(), s) if b.column(2)[0].as_py() >= s.least_pages else None
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([json.dumps(about)], pa.string())], names=["host", "cluster", "profile"])

    parts = materialize(map_texts(distinct_pages(pages), learn, PARTS))
    rare = parts.groupBy("host", "cluster").agg(F.sum("n").alias("n")).where(F.col("n") < s.least_pages).select(F.col("host").alias("_host"), F.col("cluster").alias("_cluster"))
    named = parts.join(rare, (F.col("host") == F.col("_host")) & (F.col("cluster") == F.col("_cluster")), "left")
    named = named.select("host", F.when(F.col("_host").isNull(), F.col("cluster")).otherwise("").alias("cluster"), "n", "at", "wrapper")
    # A host's parts are as many as the tasks that met it, so they are merged in heaps first.
    heap = F.pmod(F.xxhash64("at"), F.lit(s.heaps))
    once = map_texts(named.withColumn("heap", heap).repartition("host", "cluster", "heap").sortWithinPartitions("host", "cluster", "heap", "at").drop("heap"), join, PARTS)
    whole = map_texts(once.repartition("host", "cluster").sortWithinPartitions("host", "cluster", "at"), finish, "host string, cluster string, profile string")
    entries = whole.where("profile <> 'null'").groupBy("host").agg(F.sort_array(F.collect_list(F.concat(F.lit('"'), "cluster", F.lit('":'), "profile"))).alias("e"))
    return entries.select("host", F.concat(F.lit("{"), F.array_join("e", ","), F.lit("}")).alias("profile"))


#: Profiles are a few kilobytes each.
PROFILES = 10_000


def extract_pages(pages: DataFrame, s: Sampling = Sampling()) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    profiles = small(materialize(host_profiles(pages, s).select(F.col("host").alias("_host"), "profile")), PROFILES)
    rows = pages.select("page_id", "url", "html", split_url(F.col("url"))[0].alias("host")).join(profiles, F.col("host") == F.col("_host"), "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for b in batches:
            texts = []
            for source, about in zip(b.column(2), b.column(3), strict=True):
                key = about.as_py()
                if key not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[key] = json.loads(key) if key else {}
                texts.append(extract(source.as_py(), known[key]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_texts(rows.select("page_id", "url", "html", "profile"), run, f"page_id {kind}, url string, text string, n_chars long")
