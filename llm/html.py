r"""Main text of web pages by wrappers, inferred per host as union-free regular expressions.

Every page is read as a stream of tags and text slots and folded into a tree in which neighbours with one label become
one repeated group. The streams of a host are aligned one after the other: what both have is merged, what one of them
lacks becomes optional, runs that recur become repeated, texts are slots. The outcome is one expression per host
without unions, such as `body(nav(ul(li(#)+)) div.ad(#)? article(#h1 #p+) footer(#))`.

Every page is matched against its host's wrapper, which gives each of its texts an element. Elements are measured over
the host's distinct pages: letters, letters inside links, and how often their texts recur. What is menu, header, footer,
sidebar or hidden by its tag or role is no main text, and what a word of its class or id calls advert, comments or the
like only if it holds less than half of the main text. Texts that recur on half of an element's pages are the host's frame,
unless they stand in an article or main. A page then gives its texts in all main containers, in page order; if it
has none, all others but those of elements that are nearly all links.

Equal streams of a host are counted before the shuffle and aligned in rounds, in parts of about `PART`, until one is left;
whatever the share of the host. Pages meet their host's wrapper by a join on the host.

Defined cases: null and empty html give an empty text; broken or cut markup is read as far as it goes, an unfinished tag
at the end is dropped; pages without a host in their url share one wrapper; repeated rows give equal rows; other columns
are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import hashlib
import html as entities
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.registry import query, table
from tagloom.session import materialize, spread

PART = 64  # streams that are aligned one after the other
MIN_PAGES = 5  # distinct pages from which texts that recur count as the host's frame
DEPTH = 48  # containers below this depth count as part of the one above, in wrappers only

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "math", "canvas", "object", "xmp")
FOREIGN = frozenset(("svg", "math"))
FALLBACKS = frozenset("svg math canvas object".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption caption td th summary address".split())
CONTAINERS = frozenset(
    "html head body div section article main nav aside header footer form ul ol dl menu table thead tbody tfoot tr "
    "blockquote figure fieldset details dialog select button center".split()
)
# Leaves that can hold containers, what ends them besides their end tag, and what holds them.
NESTS = frozenset("li dt dd td th figcaption caption summary address".split())
ENDS = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
ROWS = frozenset("tr thead tbody tfoot".split())
SCOPES = frozenset("ul ol dl menu table".split())
# What isn't main text by its tag, its role, or a word of its class or id.
NOISE_TAGS = frozenset("head nav aside footer menu dialog select button".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer comment comments reply replies respond disqus cookie cookies consent notice popup modal "
    "overlay share sharing social related recommended newsletter subscribe widget pagination pager toolbar".split()
)
MAIN_WORDS = frozenset("article articlebody post content entry story text main".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<![^>]*+>|<\?[^>]*+>"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?>[^>\"']+|\"[^\"]*+\"|'[^']*+')*+)(>|\Z)|(<[A-Za-z/][^>]*+(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*=\s*(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]+))?", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}
_NUMBER = re.compile(r"(?<=[-_])[0-9]+|[0-9]{3,}")
# Runs of letters and digits that look drawn, such as 3fa9c1d2: two digits or more among letters.
_DRAWN = re.compile(r"(?<![a-z0-9])(?=[0-9]*[a-z])(?=[a-z]*[0-9][a-z]*[0-9])[a-z0-9]{5,}(?![a-z0-9])")
_SPACE = re.compile(r"\s+")


def _label(tag: str, attributes: str) -> str:
    """`tag.classes and id@role!`; `!` is for hidden elements.

    What may be a page's own is left out, so that a host's wrapper does not grow with its pages: of an id only the words
    that say what an element is for are kept, and in classes numbers and drawn names stand as 9.
    """
    found = {name.lower(): value.strip("\"'").lower() for name, value in _ATTRIBUTE.findall(attributes)} if attributes else {}
    names = re.sub("[@!]", "_", _NUMBER.sub("9", _DRAWN.sub("9", found.get("class", "")))).split()
    names += {word for word in re.split("[^a-z0-9]+", found.get("id", "")) if word in NOISE_WORDS or word in MAIN_WORDS}
    role = re.sub("[^a-z]", "", found.get("role", ""))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    return ".".join([tag, *sorted(names)]) + ("@" + role if role else "") + ("!" if hidden else "")


@functools.lru_cache(100_000)
def _hints(label: str) -> tuple[str, bool, bool, bool, bool]:
    """(tag, certainly no main text, maybe none, a tag or role of main text, a word of main text)"""
    tag, _, rest = label.lstrip("#").rstrip("!").partition("@")[0].partition(".")
    role = label.rstrip("!").partition("@")[2]
    words = set(re.split(r"[^a-z]+", rest))
    hard = tag in NOISE_TAGS or role in NOISE_ROLES or label[-1] == "!"
    strong = tag in ("article", "main") or role in ("main", "article")
    weak = bool(words & MAIN_WORDS) and tag not in ("html", "body") and label[0] != "#"
    return tag, hard, bool(words & NOISE_WORDS) or tag == "form", strong, weak


class Block:
    """A run of text between block borders: its text, the containers around it, and the letters inside links."""

    __slots__ = ("at", "slot", "after", "parts", "linked")

    def __init__(self, at, slot, after):
        self.at, self.slot, self.after, self.parts, self.linked = at, slot, after, [], 0

    def text(self) -> str:
        return _SPACE.sub(" ", entities.unescape("".join(self.parts))).strip()


def _leave(tag: str, stack: list[int], containers: list) -> None:
    """Close an open item or cell of the innermost list or table."""
    ends = ENDS.get(tag, (tag,))
    for i in range(len(stack) - 1, 0, -1):
        if containers[stack[i]][0] in ends:
            del stack[i:]
            return
        if containers[stack[i]][0] in SCOPES:
            return


def parse(page: str):
    """(blocks, containers in order) of a page; a container is (tag, label, parent index)."""
    containers = [("", "", -1)]
    stack = [0]
    blocks: list[Block] = []
    block: Block | None = None
    links, slot, at = 0, "#", 0
    found = _TOKEN.search(page, at)
    while True:
        text = page[at : found.start()] if found else page[at:]
        if text:
            if block is None:
                block = Block(stack[-1], slot, len(containers) - 1)
                blocks.append(block)
            block.parts.append(text)
            block.linked += len(text) if links else 0
        if not found:
            return blocks, containers
        at = found.end()
        closing, tag, attributes, end = found.group(1), (found.group(2) or "").lower(), found.group(3), found.group(4)
        if tag and end == ">":
            if not closing and tag in _RAW_END:
                if tag not in FOREIGN or not attributes.endswith("/"):
                    finish = _RAW_END[tag].search(page, at)
                    # Unclosed fallbacks hide their tag only, unclosed scripts the rest of the page.
                    at = finish.end() if finish else at if tag in FALLBACKS else len(page)
                if tag not in ("title", "textarea", "noscript") and block is not None:
                    block.parts.append(" ")
            elif tag == "a":
                links = max(0, links - 1) if closing else links + 1
            elif tag == "br":
                if block is not None:
                    block.parts.append(" ")
            elif tag == "hr":
                block = None
            elif tag in LEAVES:
                block, slot = None, "#"
                if tag in NESTS:
                    _leave(tag, stack, containers)
                if not closing:
                    label = _label(tag, attributes)
                    slot = "#" + label
                    _, hard, soft, *_ = _hints(slot)
                    if tag in NESTS and (hard or soft):  # what lies inside is marked, too
                        containers.append((tag, label, stack[-1]))
                        stack.append(len(containers) - 1)
            elif tag in CONTAINERS:
                block, slot = None, "#"
                links = 0
                if tag in ROWS:
                    _leave("td", stack, containers)
                    _leave("th", stack, containers)
                if closing:
                    for i in range(len(stack) - 1, 0, -1):
                        if containers[stack[i]][0] == tag:
                            del stack[i:]
                            break
                elif not attributes.endswith("/") or tag not in VOID:
                    if tag == "body":  # a body never lies in a head that was left open
                        stack[:] = [i for i in stack if containers[i][0] != "head"]
                    containers.append((tag, _label(tag, attributes), stack[-1]))
                    stack.append(len(containers) - 1)
        found = _TOKEN.search(page, at)


# A wrapper's element is [label, at least once?, may repeat?, children]; slots have no children.


def merge(a: list, b: list) -> list:
    """Two sequences of elements as one that covers both."""
    out = []
    match = difflib.SequenceMatcher(None, [x[0] for x in a], [x[0] for x in b], autojunk=False)
    for what, i, j, k, m in match.get_opcodes():
        if what == "equal":
            for x, y in zip(a[i:j], b[k:m], strict=True):
                out.append([x[0], x[1] and y[1], x[2] or y[2], merge(x[3], y[3])])
        else:
            out += [[x[0], False, x[2], x[3]] for x in a[i:j] + b[k:m]]
    return fold(out)


def fold(items: list) -> list:
    """Neighbours with one label, or runs of two to four labels that recur, as repeated elements."""
    out: list = []
    for item in items:
        if out and out[-1][0] == item[0]:
            last = out[-1]
            out[-1] = [last[0], last[1] or item[1], True, merge(last[3], item[3]) if last[3] or item[3] else []]
        else:
            out.append(item)
    for size in (2, 3, 4):
        i = 0
        while i + 2 * size <= len(out):
            labels = [x[0] for x in out[i : i + size]]
            n = 1
            while [x[0] for x in out[i + n * size : i + (n + 1) * size]] == labels:
                n += 1
            if n > 1:
                group = out[i : i + size]
                for r in range(1, n):
                    group = [
                        [x[0], x[1] and y[1], x[2] or y[2], merge(x[3], y[3])]
                        for x, y in zip(group, out[i + r * size : i + (r + 1) * size], strict=True)
                    ]
                out[i : i + n * size] = [["(" + " ".join(labels) + ")", True, True, group]]
            i += 1
    return out


def tree(texts, blocks, containers) -> list:
    """Elements of one page as [label, children]; a slot has its number among the page's texts instead of children."""
    depth = [0] * len(containers)
    place = [0] * len(containers)
    for i in range(1, len(containers)):
        parent = place[containers[i][2]]
        depth[i] = depth[parent] + 1
        place[i] = i if depth[i] <= DEPTH else parent
    # A slot stands behind the containers that were there when it began.
    inner: list[list] = [[] for _ in containers]
    number = 0
    for text, block in zip(texts, blocks, strict=True):
        if text:
            inner[place[block.at]].append((block.after + 0.5, [block.slot, number]))
            number += 1
    items: list = []
    for i in range(len(containers) - 1, -1, -1):
        if place[i] == i:
            items = [item for _, item in sorted(inner[i], key=lambda x: x[0])]
            if i:
                inner[place[containers[i][2]]].append((i, [containers[i][1], items]))
    return items


def skeleton(items: list) -> list:
    """The folded tree of one page."""
    return fold([[label, True, False, [] if isinstance(inner, int) else skeleton(inner)] for label, inner in items])


def written(items: list) -> str:
    """A wrapper as an expression."""
    mark = {(True, False): "", (True, True): "+", (False, False): "?", (False, True): "*"}
    return " ".join(
        (f"({written(x[3])})" if x[0][0] == "(" else x[0] + (f"({written(x[3])})" if x[3] else "")) + mark[x[1], x[2]]
        for x in items
    )


_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)"


# The elements of a wrapper have numbers in page order; every slot of a page belongs to one of them.


def level(items: list, elements: list, parent: int = -1) -> tuple:
    """One level of a wrapper made for matching: its elements in order, with the repeated groups around each, and their
    places by label. Appends `(label, parent's number)` of every element to `elements`."""
    entries: list = []

    def add(items, loops):
        for label, _, again, children in items:
            if label[0] == "(":
                loop = [len(entries), 0]
                add(children, [loop, *loops])
                loop[1] = len(entries)
            else:
                number = len(elements)
                elements.append((label, parent))
                entries.append((label, number, again, loops, level(children, elements, number)))

    add(items, [])
    places: dict[str, list[int]] = {}
    for i, entry in enumerate(entries):
        places.setdefault(entry[0], []).append(i)
    return entries, places


def _next(entries, places, at, label):
    """The element that a page's next label stands for, if the one before was `at`: the same one again, the next one or the
    first one of a repeated group, else the next one of all, else the last one."""
    if at >= 0 and entries[at][0] == label and entries[at][2]:
        return at
    k = bisect.bisect_right(places, at)
    ahead = places[k] if k < len(places) else None
    if at >= 0:
        for start, end in entries[at][3]:
            if ahead is not None and ahead < end:
                return ahead
            k = bisect.bisect_left(places, start)
            if k < len(places) and places[k] <= at:
                return places[k]
    return places[-1] if ahead is None else ahead


def matched(items: list, wrapper: tuple, out: list, parent: int = -1) -> list:
    """`out` with the number of a wrapper's element for every slot of the page."""
    entries, places = wrapper
    at = -1
    for label, inner in items:
        if label not in places:  # no page of the host was like this
            number, below = parent, ([], {})
        else:
            at = _next(entries, places[label], at, label)
            _, number, _, _, below = entries[at]
        if isinstance(inner, int):
            out[inner] = number
        else:
            matched(inner, below, out, number)
    return out


def _marks(elements: list) -> list:
    """Per element (certainly no main text, inside what says that it is the main text): by tags, roles and words of it and
    of what is around it."""
    out: list = []
    for label, parent in elements:
        tag, hard, soft, strong, weak = _hints(label)
        out_of, inside = out[parent] if parent >= 0 else (False, False)
        hard = out_of or hard or (tag == "header" and not inside)  # the heading of an article belongs to it
        out.append((hard, not hard and (inside or (weak and (strong or not soft)) or (strong and not soft))))
    return out


def choose(elements: list, stats: dict) -> tuple[list[int], list[int]]:
    """(slots of main containers, slots for pages that have none of these), as numbers of elements.

    `stats` has per element, summed over the host's distinct pages that have it: pages, letters, linked letters, letters
    inside what says that it is the main text, these and all letters of the whole pages, texts, distinct texts.
    """
    marks = _marks(elements)
    zero = (0,) * 8
    noise, main, sure, links = [], [], [], []
    for e, (label, parent) in enumerate(elements):
        tag, _, soft, strong, weak = _hints(label)
        _, n, linked, own, mains, total, _, _ = stats.get(e, zero)
        # A word alone makes nothing noise that holds most of the main text.
        most = own >= 0.5 * mains > 0 or ((not mains or tag == "article" or label[0] == "#") and n >= 0.5 * total)
        bad = marks[e][0] or (soft and tag not in ("html", "body", "main") and not most)
        noise.append(bad or (parent >= 0 and noise[parent]))
        links.append(linked >= 0.9 * n or (parent >= 0 and links[parent]))
        up = main[parent] if parent >= 0 else -1
        main.append(up if up >= 0 else e if (strong or weak) and not noise[e] else -1)
        sure.append((strong and not noise[e]) or (parent >= 0 and sure[parent]))
    slots = [e for e, (label, _) in enumerate(elements) if label[0] == "#" and not noise[e] and e in stats]
    varying = _varying(elements, stats, slots, sure, links) or slots
    parts = _main_parts(elements, stats, {main[e] for e in varying} - {-1}, sure)
    return [e for e in varying if main[e] in parts], [e for e in varying if not links[e]]


def _varying(elements, stats, slots, sure, links) -> list[int]:
    """Slots whose texts are the pages' own. A text that recurs stays as well where most letters of its container are the
    pages' own: an article may say the same on many pages. Links never stay for that."""
    own = {e for e in slots if sure[e] or not _constant(stats[e])}
    letters: dict[int, list[int]] = {}
    for e in slots:
        letters.setdefault(elements[e][1], [0, 0])[e in own] += stats[e][1]
    return [e for e in slots if e in own or (not links[e] and letters[elements[e][1]][1] > letters[elements[e][1]][0])]


def _main_parts(elements, stats, mains, sure) -> set[int]:
    """All main containers but teasers. Containers side by side count together. By a tag or role a part is main text in any
    case; by words, if its group holds at least half of the text of the pages it is on, or if the host has such a part and
    it holds a tenth."""
    groups: dict[int, list[int]] = {}
    for e in mains:
        groups.setdefault(elements[e][1], []).append(e)
    parts: set[int] = set()
    for group in groups.values():
        words = [e for e in group if not sure[e]]
        parts.update(e for e in group if sure[e])
        if 2 * sum(stats[e][1] for e in words) >= max((stats[e][5] for e in words), default=0):
            parts.update(words)
    return parts | {e for e in mains if parts and 10 * stats[e][1] >= stats[e][5]}


def _constant(stat) -> bool:
    """Do texts of this element recur on half of its pages, on average?"""
    pages, *_, texts, distinct = stat
    return pages >= MIN_PAGES and 2 * texts >= pages * distinct


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _measure(batches):
    """Per page: its host, folded stream, tree, and digests, letters and linked letters of its texts."""
    for batch in batches:
        rows = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            blocks, containers = parse(page or "")
            texts = [block.text() for block in blocks]
            items = tree(texts, blocks, containers)
            pairs = [(text, block) for text, block in zip(texts, blocks, strict=True) if text]
            rows.append(
                {
                    "host": host,
                    "skeleton": json.dumps(skeleton(items), separators=(",", ":"), ensure_ascii=False),
                    "tree": json.dumps(items, separators=(",", ":"), ensure_ascii=False),
                    "digests": [_digest(text) for text, _ in pairs],
                    "n": [len(text) for text, _ in pairs],
                    "linked": [min(len(text), block.linked) for text, block in pairs],
                }
            )
        longs = pa.list_(pa.int64())
        kinds = [("host", pa.string()), ("skeleton", pa.string()), ("tree", pa.string()), ("digests", longs), ("n", longs), ("linked", longs)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def _count(batches):
    """Per page: `<element, n, linked, own, mains, total, digests>` of every element that it has."""
    number = pa.int64()
    names = ["n", "linked", "own", "mains", "total"]
    kind = pa.struct([("element", pa.int32()), *[(name, number) for name in names], ("digests", pa.list_(number))])
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            wrapper, elements, marks = _compiled(row["wrapper"])
            found: dict[int, list] = {}
            mains = total = 0
            slots = matched(json.loads(row["tree"]), wrapper, [-1] * len(row["n"]))
            for e, digest, n, linked in zip(slots, row["digests"], row["n"], row["linked"], strict=True):
                if e < 0:
                    continue
                hard, inside = marks[e]
                own = n if inside else 0
                mains += own
                total += 0 if hard else n
                found.setdefault(e, [0, 0, 0, set()])[3].add(digest)
                while e >= 0:
                    sums = found.setdefault(e, [0, 0, 0, set()])
                    sums[0] += n
                    sums[1] += linked
                    sums[2] += own
                    e = elements[e][1]
            rows.append(
                [
                    {"element": e, "n": n, "linked": linked, "own": own, "mains": mains, "total": total, "digests": list(digests)}
                    for e, (n, linked, own, digests) in found.items()
                ]
            )
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(rows, pa.list_(kind))], names=["host", "found"])


@functools.lru_cache(16)
def _compiled(wrapper: str):
    elements: list = []
    return level(json.loads(wrapper), elements), elements, _marks(elements)


def _choose(batches):
    for batch in batches:
        mains, rest = [], []
        for wrapper, stats in zip(batch.column("skeleton").to_pylist(), batch.column("stats").to_pylist(), strict=True):
            both = choose(_compiled(wrapper)[1], {s["element"]: tuple(s.values())[1:] for s in stats or []})
            mains.append(both[0])
            rest.append(both[1])
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("host", "n_pages", "skeleton")), pa.array(mains, ints), pa.array(rest, ints)],
            names=["host", "n_pages", "skeleton", "mains", "rest"],
        )


def _align(frame):
    """One wrapper from all rows of a group, in a fixed order."""
    import pandas as pd

    wrapper = None
    for one in sorted(frame["skeleton"]):
        wrapper = json.loads(one) if wrapper is None else merge(wrapper, json.loads(one))
    return pd.DataFrame(
        {
            "host": [frame["host"].iloc[0]],
            "part": [0],
            "skeleton": [json.dumps(wrapper, separators=(",", ":"), ensure_ascii=False)],
            "n": [int(frame["n"].sum())],
        }
    )


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit(""))))


def wrappers(pages: DataFrame) -> DataFrame:
    """`<host, n_pages, skeleton, mains, rest>` of `<host, html>`: the wrapper (see `written`) and its chosen slots (see
    `choose`)."""
    longs = "array<bigint>"
    measured = materialize(
        pages.select("host", "html").mapInArrow(
            _measure, f"host string, skeleton string, tree string, digests {longs}, n {longs}, linked {longs}"
        ),
        "page-streams",
    )
    whole = aligned(measured.groupBy("host", "skeleton").agg(F.count("*").alias("n")))
    # Copies of a page say nothing about what its host repeats.
    distinct = measured.drop("skeleton").dropDuplicates(["host", "tree", "digests"])
    counted = distinct.join(whole.select("host", F.col("skeleton").alias("wrapper")), "host").mapInArrow(
        _count,
        "host string, found array<struct<element:int,n:bigint,linked:bigint,own:bigint,mains:bigint,total:bigint,"
        f"digests:{longs}>>",
    )
    found = materialize(counted, "page-elements").select("host", F.explode("found").alias("f")).select("host", "f.*")
    sums = found.groupBy("host", "element").agg(
        F.count("*").alias("pages"),
        *[F.sum(c).alias(c) for c in ("n", "linked", "own", "mains", "total")],
        F.sum(F.size("digests").cast("bigint")).alias("texts"),
    )
    texts = found.select("host", "element", F.explode("digests").alias("digest"))
    texts = texts.groupBy("host", "element").agg(F.count_distinct("digest").alias("distinct"))
    stat = F.struct("element", "pages", "n", "linked", "own", "mains", "total", "texts", F.coalesce("distinct", F.lit(0)).alias("distinct"))
    stats = sums.join(texts, ["host", "element"], "left").groupBy("host").agg(F.collect_list(stat).alias("stats"))
    return (
        whole.select("host", F.col("n").alias("n_pages"), "skeleton")
        .join(stats, "host", "left")
        .mapInArrow(_choose, "host string, n_pages bigint, skeleton string, mains array<int>, rest array<int>")
    )


def aligned(streams: DataFrame) -> DataFrame:
    """`<host, skeleton, n>`: one wrapper per host of `<host, skeleton, n>`, in rounds of parts of about `PART` streams."""
    schema = "host string, part int, skeleton string, n bigint"
    while True:
        streams = materialize(streams, "aligned")
        sizes = streams.groupBy("host").agg(F.count("*").alias("size"))
        if (sizes.agg(F.max("size")).first()[0] or 0) <= 1:
            return streams
        parts = F.ceil(F.col("size") / PART)
        parted = streams.join(sizes, "host").select(
            "host", "skeleton", "n", F.pmod(F.xxhash64("skeleton"), parts).cast("int").alias("part")
        )
        merged = parted.groupBy("host", "part").applyInPandas(lambda frame: _align(frame), schema)
        streams = merged.groupBy("host", "skeleton").agg(F.sum("n").alias("n"))


def _extract(batches, extra):
    for batch in batches:
        texts = []
        columns = (batch.column(c).to_pylist() for c in ("html", "skeleton", "mains", "rest"))
        for page, wrapper, mains, rest in zip(*columns, strict=True):
            texts.append(main_text(page or "", wrapper or "[]", mains or [], rest or []))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in extra), pa.array(texts, pa.string())], names=[*extra, "text"]
        )


def main_text(page: str, wrapper: str, mains: list[int], rest: list[int]) -> str:
    """Texts that the page has in the slots `mains` of its host's wrapper, else those in the slots `rest`."""
    blocks, containers = parse(page)
    texts = [block.text() for block in blocks]
    slots = matched(tree(texts, blocks, containers), _compiled(wrapper)[0], [-1] * len(blocks))
    chosen = set(mains)
    if chosen.isdisjoint(slots):
        chosen = set(rest)
    return "\n".join(text for text, e in zip(filter(None, texts), slots) if e in chosen)


def extract(pages: DataFrame) -> DataFrame:
    """`<page_id, url, text>` for every row of `<page_id, url, html>`."""
    hosted = with_host(pages.select("page_id", "url", "html"))
    rules = materialize(wrappers(hosted), "wrappers").select("host", "skeleton", "mains", "rest")
    kind = pages.schema["page_id"].dataType.simpleString()
    return (
        hosted.join(rules, "host", "left")
        .select("page_id", "url", "html", "skeleton", "mains", "rest")
        .mapInArrow(lambda batches: _extract(batches, ["page_id", "url"]), f"page_id {kind}, url string, text string")
    )


@query("op7_html")
def op7_html(spark, folder):
    pages = spread(table(spark, folder, "pages", "page_id", "url", "html"))
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
