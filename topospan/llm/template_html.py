"""Main text of web pages by a template deduced from equivalence classes (Arasu and Garcia-Molina, 2003).

A page is a sequence of tokens: tags (opening and closing), and the words between them (but for those
inside `article` or `main`, which are data), each told apart by the path of open elements above it
(with their id and class names). Over the pages of one
host, tokens with the same occurrence vector (how often they stand on each page) form an
equivalence class; vectors are compared by an order-free sum of hashes of (page, count), so a host's
pages never meet in one task. Classes of at least `size` tokens and a support of at least `share`
of the host's pages are large and frequent enough to be examined.

The second pass over the pages examines them. Each page is read against the classes of its host: the
tokens of a class must come round in one order (t1 t2 ... tm, again and again: a class is ordered),
and what stands between two of its tokens must stand there whole (classes nest and never
interleave). Each page reports, for each class, the order it saw, the position (class and gap) that
holds the class, and whether it came round; a class stays if all the pages that hold it agree and
none objects. What stays is a tree: gaps of ordered classes, each with the classes nested in it and
with slots, the tokens that are in no valid class. The same pass measures how many characters
outside links stand in the slots under each element of the template.

The main slot of a page is the innermost template element, of those that stand once on it, that
holds at least half of the slots' characters over the host, with its whole content. Elements decide the ties: where the page has `article` or `main`, a main slot inside one is
widened to it, one that contains some is narrowed to them, and one beside them yields to them; pages
without a main slot (too few pages of the host, nothing in common) go by `article` and `main`, or
else by the body. The column `decided` of extract() says which it was. Outside `article` and `main`
a text node of template words only is constant text and goes; inside, nothing is dropped by its
words. Navigation, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments inside the main slot go by element, role, id or class name: a template can't tell a
comment from a paragraph.

Blocks are the text between block-level tags; character references are decoded, white space turns
into one space, blocks are trimmed and joined by a line break; empty ones are left out.

A host's template has at most 1/share times the tokens of a page of it on average; templates are
broadcast only if their written size is under `small_bytes`, and joined by host otherwise.

Defined results: null, empty and unparsable pages have an empty text; a page without a host (or of
a host with fewer than `least_pages` pages) has no template; unclosed elements end with their
parents; a tag whose quote is never closed ends at its first `>`; repeated rows count as pages each;
whole pages are read, nested and long ones in linear time; equal tokens of one path are one token.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings, written

SHARE = 0.5
SIZE = 2
LEAST_PAGES = 4
SMALL_BYTES = 8 << 20

#: Elements by kind, and name parts that mark what isn't main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
ASIDE = frozenset("nav header footer aside form script style noscript template iframe textarea select button title head menu dialog svg math object".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMES = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer sidebar aside widget ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login share sharing social related recommended comment comments respond reply replies disqus toolbar pagination pager skip".split())
P_CLOSERS = BLOCK - {"body", "html", "head"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|([^<]+|<)", re.S)
_OPEN_QUOTE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"(?<![\w-])(id|class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_SPACE = re.compile(r"\s+")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _marks(name: str, attributes: str) -> tuple[str, bool]:
    """An element's label in paths, and whether its names put it aside."""
    if "=" not in attributes:
        return name, name in ASIDE
    label, aside = name, name in ASIDE
    for key, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        key = key.lower()
        if key == "role":
            aside = aside or value in ROLES
        else:
            label += ("#" if key == "id" else ".") + value
            if name not in ("body", "html", "main", "article"):
                aside = aside or not NAMES.isdisjoint(re.split(r"[^a-z]+", value))
    return label, aside


class Node:
    """An open element; `path` is a hash of the labels from the top."""

    __slots__ = ("aside", "label", "link", "main", "name", "path", "up")

    def __init__(self, name, label, up, aside, main):
        self.name, self.label, self.up, self.aside, self.main = name, label, up, aside, main
        self.path = xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), up.path & (2**64 - 1)) - 2**63 if up else 0
        self.link = name == "a" or bool(up and up.link)


def tokens(page: str):
    """Events of a page, in order: ('open', node, name), ('close', node, name) and ('text', node, raw text)."""
    stack = [Node("", "", None, False, False)]
    held: Counter = Counter()  # open elements by name
    at, end = 0, len(page)

    def cut(k):
        for node in reversed(stack[k:]):
            held[node.name] -= 1
            yield "close", node, node.name
        del stack[k:]

    while at < end:
        m = _TOKEN.match(page, at)
        if m is None or m[4] == "<":
            m = _OPEN_QUOTE.match(page, at) or m
        if m is None:
            break
        at = m.end()
        closing, name, attributes, *text = m.groups()
        if text and text[0] is not None:
            yield "text", stack[-1], text[0]
        elif name is not None:
            name = name.lower()
            if closing:
                if held[name]:
                    k = len(stack) - 1
                    while stack[k].name != name:
                        k -= 1
                    yield from cut(k)
                continue
            if name in P_CLOSERS and held["p"]:
                yield from cut(next(i for i, x in enumerate(stack) if x.name == "p"))
            shut = SIBLINGS.get(name)
            if shut and any(held[x] for x in shut):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in shut:
                        yield from cut(k)
                        break
                    if stack[k].name in ("ul", "ol", "dl", "table", "tbody", "select"):
                        break
            label, aside = _marks(name, attributes)
            up = stack[-1]
            if aside and name == "header" and up.main and not _ATTRIBUTE.search(attributes):
                aside = False  # an article's own heading
            node = Node(name, label, up, up.aside or aside, up.main or name in MAIN)
            yield "open", node, name
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
                yield "close", node, name
            elif name in VOID or attributes.rstrip().endswith("/"):
                yield "close", node, name
            else:
                stack.append(node)
                held[name] += 1
        # comments, declarations and the like have no token
    yield from cut(1)


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - 2**63


def _word(path: int, word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), path & (2**64 - 1)) - 2**63


def _tag(path: int, kind: str) -> int:
    """The token of an element's opening or closing tag; no word has a blank."""
    return _word(path, f" {kind}")


def vector(page: str) -> Counter:
    """How often each token of a page stands on it."""
    words: Counter = Counter()
    for kind, node, what in tokens(page):
        path = node.path
        if kind != "text":
            words[path, f" {kind}"] += 1
        elif not node.main or node.aside:  # words of an article are data
            words.update([(path, w) for w in what.split()])
    return Counter({_word(path, w): n for (path, w), n in words.items()})


STATS = "host string, token long, support long, vector long"


def statistics(pages: DataFrame) -> DataFrame:
    """Per host and token its support and the sum of hashes of its occurrence vector, from (host, url, html)."""

    def run(batches):
        for batch in batches:
            held: dict[tuple[str, int], list[int]] = {}
            for host, page, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for token, n in vector(page or "").items():
                    x = (xxhash.xxh3_64_intdigest(f"{key} {n}".encode()) >> 20) & (2**40 - 1)
                    own = held.setdefault((host, token), [0, 0])
                    own[0] += 1
                    own[1] += x
                if len(held) > 300_000:
                    yield out(held)
                    held = {}
            yield out(held)

    def out(held):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int64()), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in range(2))], names=["host", "token", "support", "vector"])

    rows = pages.mapInArrow(run, STATS)
    return rows.groupBy("host", "token").agg(F.sum("support").alias("support"), F.sum("vector").alias("vector"))


def classes(pages: DataFrame, share: float = SHARE, size: int = SIZE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, classes): the host's classes that are large and frequent enough, as (id, support, tokens)."""
    counts = pages.groupBy("host").agg(F.count("*").alias("pages")).where((F.col("pages") >= least_pages) & (F.col("host") != ""))
    frequent = statistics(pages).join(counts, "host").where(F.col("support") >= F.greatest(F.lit(least_pages), F.ceil(F.col("pages") * share)))
    own = frequent.groupBy("host", "support", "vector").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("token")).alias("tokens")).where(F.col("n") >= size)
    return own.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("support", "vector").alias("id"), "support", "tokens"))).alias("classes"))


def positions(sequence: list[tuple[int, int]], sizes: dict[int, int]) -> dict[int, tuple[int, int, int, bool]]:
    """What one page says of each class: (hash of its order, holding class, gap, whether it came round and nested).

    sequence: (class, token) of the page's class tokens in order; sizes: tokens of each class. The
    order is that of a class's first round; classes at the top are held by class 0, gap 0, and ones
    that stand in several positions by class 0, gap -1, which is no position of the template.
    """
    first: dict[int, dict[int, int]] = {}
    for c, token in sequence:
        own = first.setdefault(c, {})
        if len(own) < sizes[c]:
            own.setdefault(token, len(own))
    good = dict.fromkeys(first, True)
    held: dict[int, tuple[int, int]] = {}
    at: dict[int, int] = {}  # the next token of each class that is under way
    way: list[int] = []
    for c, token in sequence:
        turn = first[c].get(token, -1)
        if c not in at:
            place = (way[-1], at[way[-1]]) if way else (0, 0)
            held[c] = place if held.get(c, place) == place else (0, -1)
            if turn:
                good[c] = False
            at[c] = 0
            way.append(c)
        elif way[-1] != c:  # what was opened inside hasn't come round: it interleaves
            k = len(way) - 1 - way[::-1].index(c)
            for x in way[k + 1 :]:
                good[x] = False
                del at[x]
            del way[k + 1 :]
        if turn != at[c]:
            good[c] = False
        at[c] += 1
        if at[c] == sizes[c]:
            del at[c]
            way.pop()
    for c in way:
        good[c] = False
    return {c: (_hash(*map(str, own)), *held[c], good[c] and held[c][1] >= 0) for c, own in first.items()}


VIEWS = "host string, kind int, class long, form long, up long, gap int, good boolean, n long"


def views(rows: DataFrame) -> DataFrame:
    """What the pages say, summed, from (host, html, classes).

    kind 0: of a class its order (form), its position (up, gap), whether it came round, and on how
    many pages. kind 1: of an element (class: its path) how many characters of words in no class
    and outside links it holds (n); of the top that is path 0.
    """

    def run(batches):
        seen: dict[str, tuple[dict, dict, dict]] = {}
        for batch in batches:
            said: Counter = Counter()
            mass: Counter = Counter()
            for host, page, own in zip(batch.column(0).to_pylist(), strings(batch.column(1)), batch.column(2), strict=True):
                if host not in seen:
                    if len(seen) > 50:
                        seen.clear()
                    found = own.as_py()
                    seen[host] = {t: c["id"] for c in found for t in c["tokens"]}, {c["id"]: len(c["tokens"]) for c in found}, {}
                of, sizes, codes = seen[host]
                if len(codes) > 100_000:
                    codes.clear()
                sequence = []
                held: Counter = Counter()
                for kind, node, what in tokens(page):
                    path = node.path
                    if kind == "text" and node.main and not node.aside:
                        if not node.link:
                            held[node] += len(what.strip())
                        continue
                    for word in what.split() if kind == "text" else (f" {kind}",):
                        known = codes.get((path, word))
                        if known is None:
                            token = _word(path, word)
                            known = codes[path, word] = of.get(token), token
                        if known[0] is not None:
                            sequence.append(known)
                        elif kind == "text" and not node.link and not node.aside:
                            held[node] += len(word)
                for c, (form, up, gap, good) in positions(sequence, sizes).items():
                    said[host, c, form, up, gap, good] += 1
                for node, n in held.items():
                    while node is not None:
                        mass[host, node.path] += n
                        node = node.up
            out = [(h, 0, c, f, u, g, ok, n) for (h, c, f, u, g, ok), n in said.items()] + [(h, 1, p, 0, 0, 0, True, n) for (h, p), n in mass.items()]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in VIEWS.split(", ")])

    said = rows.mapInArrow(run, VIEWS)
    return said.groupBy("host", "kind", "class", "form", "up", "gap", "good").agg(F.sum("n").alias("n"))


def valid(found: list[dict], said: list[dict]) -> dict[int, tuple[int, int]]:
    """The classes that stay, each with its position (holding class, gap): the host's template tree.

    A class stays if every page that holds it (its support) saw the same order and position and
    found it whole; a class whose holder goes is held by the top.
    """
    support = {c["id"]: c["support"] for c in found}
    stay = {x["class"]: (x["up"], x["gap"]) for x in said if x["kind"] == 0 and x["good"] and x["n"] == support[x["class"]]}
    return {c: (up, gap) if up in stay else (0, 0) for c, (up, gap) in stay.items()}


def templates(pages: DataFrame, share: float = SHARE, size: int = SIZE, least_pages: int = LEAST_PAGES, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """(host, tokens of the valid classes, masses: (path, n) of the elements that hold at least half of the slots' characters), from (host, html, key)."""
    found = written(classes(pages, share, size, least_pages), "html-classes")
    said = written(views(pages.select("host", "html").join(F.broadcast(found.df) if found.size() <= small_bytes else found.df, "host")), "html-views")
    word = F.struct("kind", "class", "up", "gap", "good", "n")
    orders = said.df.where("kind = 0").groupBy("host").agg(F.collect_list(word).alias("said"))  # as many as the host's classes, or a page's views of them
    top = said.df.where("kind = 1 and class = 0").select("host", F.col("n").alias("whole"))
    masses = said.df.where("kind = 1").join(top, "host").where("2 * n >= whole").groupBy("host").agg(F.collect_list(F.col("class")).alias("large"))

    def run(batches):
        for batch in batches:
            out = [[t for c in r["classes"] if c["id"] in stay for t in c["tokens"]] for r in batch.to_pylist() for stay in [valid(r["classes"], r["said"] or [])]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64())), batch.column(3)], names=["host", "tokens", "large"])

    return found.df.join(orders, "host", "left").join(masses, "host", "left").select("host", "classes", "said", "large").mapInArrow(run, "host string, tokens array<long>, large array<long>")


class Template:
    """A host's template: tokens of valid classes, and paths of elements that hold half of the slots' characters."""

    def __init__(self, tokens_=(), large=()):
        self.tokens, self.large = frozenset(tokens_ or ()), frozenset(large or ())


def main_text(page: str, template: Template | None = None) -> tuple[str, str]:
    """The page's main text, given its host's template, and what decided on it: template, element or body."""
    template = template or Template()
    stream = list(tokens(page))
    own: Node | None = None  # the main slot: the innermost element of the template that holds half of the slots' characters
    depth = -1
    elements = []
    times = Counter(node.path for kind, node, _ in stream if kind == "open")
    for kind, node, _ in stream:
        if kind != "open":
            continue
        if node.name in MAIN and not node.up.main and not node.aside:
            elements.append(node)
        if node.path in template.large and times[node.path] == 1 and not node.aside and _tag(node.path, "open") in template.tokens:
            n = sum(1 for _ in _up(node))
            if n > depth:
                own, depth = node, n
    inside = set(elements)
    if own is None:
        decided = "element" if inside else "body"
    elif own.main:
        inside, decided = {x for x in _up(own) if x in inside}, "template"
    else:
        narrowed = {x for x in inside if own in _up(x)}
        decided = "template" if narrowed or not inside else "element"
        inside = narrowed or inside or {own}
    blocks: list[str] = []
    parts: list[str] = []
    under = 0 if inside else 1

    def close():
        block = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if block:
            blocks.append(block)

    for kind, node, what in stream:
        if kind != "text":
            if what in BLOCK:
                close()
            elif what == "br":
                parts.append(" ")
            if node in inside:
                under += 1 if kind == "open" else -1
        elif under and not node.aside:
            words = what.split()
            if node.main or not words or not all(_word(node.path, w) in template.tokens for w in words):
                parts.append(what)
    close()
    return "\n".join(blocks), decided


def _up(node: Node | None):
    while node is not None:
        yield node
        node = node.up


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """page_id, url, text, n_chars, decided of every page."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), _HOST.pattern, 1), F.lit("")))
    slim = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    known = written(templates(slim.select("host", "html", F.xxhash64("page_id", "url", "html").alias("key")), share, small_bytes=small_bytes), "html-templates")
    rows = slim.join(F.broadcast(known.df) if known.size() <= small_bytes else known.df, "host", "left").select("page_id", "url", "html", "host", "tokens", "large")

    def run(batches):
        seen: dict[str, Template] = {}
        for batch in batches:
            texts = []
            for page, at, own, large in zip(strings(batch.column(2)), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                if at not in seen:
                    if len(seen) > 2000:
                        seen.clear()
                    seen[at] = Template(own.as_py(), large.as_py())
                texts.append(main_text(page, seen[at]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in texts], pa.string()), pa.array([len(x[0]) for x in texts], pa.int64()), pa.array([x[1] for x in texts])], names=["page_id", "url", "text", "n_chars", "decided"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, decided string")
