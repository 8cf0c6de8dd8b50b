"""HTML extraction with inferred wrappers (operator 1).

The pages of a host share templates.  A page becomes a stream of tokens: tags with
their class and id, and text.  Adjacent repeats of a stretch, of any length, fold
into a repeated group.  The streams of a host are aligned one with another into a
union-free regular expression, its wrapper: equal tags stay, a stretch that only
one side has becomes optional, repeated groups are aligned inside, and text meets
the text that stands at its place.  A text that all the different pages which have
the place hold there is template, if these are at least ``SEEN``; all else there
fills a slot.  A page's main text is what fills the wrapper's slots in the article
(or the main part, or else the body) and outside of menus, headers, footers, asides,
forms, notices, adverts and comments: of the first of these with any such text, in
page order.  Where a page has template text alone, that is its text.

Pages with equal folded streams are aligned by counting: what all of them hold at a
place is found by an aggregation, so a host with most of the pages brings few
streams.  Different streams are merged in rounds, some hundred of a host in a task,
until one is left.  Alignment is by a longest common subsequence, in linear space
and with the tokens of one side as bits.  Each stream is then laid along the wrapper
of its host, which says for each of its places what is template there; pages refer
to that by the number of their stream.  It is broadcast only if it is small in all.

Null or empty html gives an empty text, an empty table no rows.  Pages whose url has
no host share one group.  Repeated pages each give a row, and count once as evidence.
Only the three columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm._common import arrow_batches, prepare, table, written

#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe".split())
BLOCK = frozenset("html head body title address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul caption textarea button".split())
CLOSES_P = BLOCK - {"html", "head", "body", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "caption", "legend", "button", "textarea", "select"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
OUTSIDE = frozenset("nav footer aside form head menu button select textarea dialog input label".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations toolbar copyright login search pagination pager widget complementary contentinfo".split()
)
#: Words that may stand beside one of these in a class or id that tells, and those that tell nothing within an article.
BESIDE = frozenset("box container wrapper wrap list item items block area section widget bar site page top bottom left right inner outer link links text title header head body global primary secondary fixed sticky small large btn button icon row col panel group form".split())
VAGUE = frozenset("discussion notice notices alert promotion search banner reply respond".split())
PARTS = frozenset("main article content".split())
ENDS = WORDS & frozenset("comment comments commentlist reply replies disqus ad ads advert adverts advertisement sponsored related recommended".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


def tokens(page: str):
    """("open", name, key), ("close", name, None) and ("text", raw text, None); raw elements and comments are left out."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], None
            return
        if m.start() > at:
            yield "text", page[at : m.start()], None
        at = m.end()
        if m["cdata"] is not None:
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            yield "close", name, None
            continue
        attrs = m["attrs"] if m["name"] else m["attrs2"]
        if name in RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        keys = sorted({w for a in _ATTR.finditer(attrs) for w in _telling(a[2] or a[3] or a[4] or "")}) if "=" in attrs else []
        yield "open", name, ".".join([name, *keys])


def _telling(value: str):
    """The words of a class or id that tell what an element is: those of names made of such words and of plain ones."""
    for name in value.lower().split():
        parts = re.findall(r"[a-z]+", name)
        if all(w in WORDS or w in BESIDE or w in PARTS for w in parts):
            yield from (w for w in parts if w in WORDS or w in PARTS)


def slots(page: str):
    """(path of open elements, block text) in page order, and structural tokens in between as (None, token)."""
    path: list[tuple[str, str]] = []
    parts: list[str] = []
    where = ""

    def flush():
        text = " ".join("".join(parts).split())
        parts.clear()
        return text

    for kind, name, key in tokens(page):
        if kind == "text":
            if not parts:
                where = "/".join(k for _, k in path)
            parts.append(htmllib.unescape(name))
            continue
        if name in BLOCK:
            text = flush()
            if text:
                yield where, text
        elif name == "br":
            parts.append("\n") if parts else None
        if kind == "open":
            if name in CLOSES_P and any(t == "p" for t, _ in path):
                _pop(path, {"p"})
            if name in SAME:
                _pop(path, SAME[name], {"ul", "ol", "dl", "table", "select", "menu"})
            yield None, key
            if name not in VOID:
                path.append((name, key if name in BLOCK else name))
        else:
            if name in VOID or not any(t == name for t, _ in path):
                continue
            _pop(path, {name})
            yield None, "/" + name
    text = flush()
    if text:
        yield where, text


def _pop(path: list, names: set, stop: set = frozenset()) -> None:
    """Close up to and with the innermost element of ``names``, but not beyond one of ``stop``."""
    for i in range(len(path) - 1, -1, -1):
        if path[i][0] in names:
            del path[i:]
            return
        if path[i][0] in stop:
            return


def _inline_free(path: str) -> str:
    return "/".join(k for k in path.split("/") if k.split(".")[0] in BLOCK)


# A wrapper is a list of nodes: a tag "name.key" or "/name", a place of text ["#", path, texts that all have, pages],
# ["+", nodes] or ["?", node].


class _Fold:
    """A stream while it is folded: numbers of nodes, and for each node the blocks of text at each of its places."""

    def __init__(self):
        self.known: dict = {}
        self.nodes: list = []
        self.ids: list[int] = []
        self.held: list[list[list[int]]] = []

    def number(self, what, node) -> int:
        if what not in self.known:
            self.known[what] = len(self.nodes)
            self.nodes.append(node)
        return self.known[what]

    def add(self, what, node, held: list[list[int]]) -> None:
        self.ids.append(self.number(what, node))
        self.held.append(held)

    def _group(self, at: int, size: int, copies: int) -> tuple[int, list[list[int]]]:
        piece = self.ids[at : at + size]
        rounds = [[places for node in self.held[at + c * size : at + (c + 1) * size] for places in node] for c in range(copies)]
        held = [[i for part in place for i in part] for place in zip(*rounds, strict=True)]
        if size == 1 and self.nodes[piece[0]][0] == "+":
            return piece[0], held
        return self.number(("+", *piece), ["+", [self.nodes[i] for i in piece]]), held

    def fold(self) -> None:
        """Adjacent repeats become repeated groups, short ones first, until none is left."""
        size, ids = 1, np.array(self.ids, np.int64)
        changed = False
        while 2 * size <= len(ids) or changed:
            if 2 * size > len(ids):
                size, changed = 1, False
                continue
            again = ids[:-size] == ids[size:]
            edges = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0, append=0)) if np.count_nonzero(again) >= size else []
            out, held, at = [], [], 0
            for lo, hi in zip(edges[::2], edges[1::2], strict=True):
                lo = max(int(lo), at)
                copies = (int(hi) - lo) // size + 1
                if copies > 1:
                    out += self.ids[at:lo]
                    held += self.held[at:lo]
                    one, places = self._group(lo, size, copies)
                    out.append(one)
                    held.append(places)
                    at = lo + copies * size
            if at:
                self.ids, self.held = out + self.ids[at:], held + self.held[at:]
                ids, changed = np.array(self.ids, np.int64), True
            else:
                size += 1


def stream(page: str) -> tuple[list, list[tuple[int, str]]]:
    """The folded token stream, and the blocks of text in page order, each with the number of its place; inline elements are part of their text."""
    f, texts = _Fold(), []
    for where, what in slots(page):
        if where is not None:
            path = _inline_free(where)
            f.add(("#", path), ["#", path], [[len(texts)]])
            texts.append(what)
        elif what.lstrip("/").split(".")[0] in BLOCK:
            f.add(what, what, [])
    f.fold()
    place = [0] * len(texts)
    for n, blocks in enumerate(places for node in f.held for places in node):
        for i in blocks:
            place[i] = n
    return [f.nodes[i] for i in f.ids], list(zip(place, texts, strict=True))


def _key(node):
    """What two nodes must have in common to be one."""
    if isinstance(node, str):
        return node
    if node[0] == "?":
        return _key(node[1])
    return ("#", node[1]) if node[0] == "#" else ("+", _key(node[1][0]))


SPACE = 1 << 28


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of positions; the longer list is held as bits of a number."""
    if len(a) > len(b):
        return [(i, j) for j, i in _common(b, a)]
    lead = 0
    while lead < len(a) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < len(a) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[lead : len(a) - tail], b[lead : len(b) - tail]
    if len(x) > 1 and len(x) * len(y) > SPACE:
        # too much to keep: split where the halves' common subsequences are longest together
        mid = len(x) // 2
        k = int(np.argmax(_lengths(x[:mid], y) + _lengths(x[:mid:-1] + [x[mid]], y[::-1])[::-1]))
        middle = _common(x[:mid], y[:k]) + [(i + mid, j + k) for i, j in _common(x[mid:], y[k:])]
    else:
        rows, middle, i, j = _rows(x, y), [], len(x), len(y)
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                middle.append((i, j))
        middle.reverse()
    return [(i, i) for i in range(lead)] + [(i + lead, j + lead) for i, j in middle] + [(len(a) - t, len(b) - t) for t in range(tail, 0, -1)]


def _rows(x: list, y: list, keep: bool = True) -> list[int]:
    """For each beginning of x a number: bit j is unset where y[: j + 1] has one more in common with it than y[:j]."""
    where: dict = {}
    for j, what in enumerate(y):
        where.setdefault(what, []).append(j)
    masks = {what: sum(1 << j for j in at) if len(at) < 64 else int.from_bytes(np.packbits(np.bincount(at, minlength=len(y)).astype(bool), bitorder="little").tobytes(), "little") for what, at in where.items()}
    full = (1 << len(y)) - 1
    row, rows = full, [full]
    for what in x:
        both = row & masks.get(what, 0)
        row = (row + both | row - both) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _lengths(x: list, y: list) -> np.ndarray:
    """How much x has in common with each beginning of y, from the empty one."""
    bits = np.unpackbits(np.frombuffer(_rows(x, y, False)[0].to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def align(a: list, b: list) -> list:
    """The union-free generalisation of two node lists."""
    out: list = []
    i = j = 0
    for x, y in [*_common([_key(n) for n in a], [_key(n) for n in b]), (len(a), len(b))]:
        out += [n if n[0] == "?" else ["?", n] for n in a[i:x] + b[j:y]]
        if x < len(a):
            out.append(_merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def _merge(a, b):
    if isinstance(a, str) and isinstance(b, str):
        return a
    if a[0] == "?" or b[0] == "?":
        return ["?", _merge(a[1] if a[0] == "?" else a, b[1] if b[0] == "?" else b)]
    if a[0] == "#":
        return ["#", a[1], sorted(set(a[2]) & set(b[2])), a[3] + b[3]]
    return ["+", align(a[1], b[1])]


def places(nodes: list) -> list[list]:
    """The places of text of a node list, in order."""
    out: list = []
    for n in nodes:
        if not isinstance(n, str):
            out += [n] if n[0] == "#" else places(n[1] if n[0] == "+" else [n[1]])
    return out


def laid(nodes: list, wrapper: list) -> list[list | None]:
    """For each place of a stream the place of the wrapper that it meets."""
    met = dict(_common([_key(n) for n in nodes], [_key(n) for n in wrapper]))
    out: list = []
    for i, n in enumerate(nodes):
        if isinstance(n, str):
            continue
        w = wrapper[met[i]] if i in met else None
        if w is not None and w[0] == "?":
            w = w[1]
        if n[0] == "#":
            out.append(w)
        else:
            out += laid(n[1], w[1]) if w is not None else [None] * len(places(n[1]))
    return out


def _outside(path: list[list[str]]) -> bool:
    """Whether an element of the path is one of those that never hold the main text."""
    article = False
    for name, *keys in path:
        if name == "title" or name in OUTSIDE or name == "header" and not article:
            return True
        if name in ("html", "body", "main"):
            continue
        if name == "article":
            if ENDS & set(keys):
                return True
            article = True
        elif (WORDS - VAGUE if article else WORDS) & set(keys):
            return True
    return False


#: Where main text is looked for, by preference: within articles, the main part, content, or all that is not outside.
LEVELS = 4


def level(path: str) -> int:
    """A bit for each of these that a path lies in; 0 outside of the main text."""
    keys = [k.split(".") for k in path.split("/")] if path else []
    if _outside(keys):
        return 0
    tests = (lambda k: k[0] == "article", lambda k: k[0] == "main" or "main" in k[1:], lambda k: bool({"article", "content"} & set(k[1:])))
    return sum(1 << n for n, test in enumerate(tests) if any(test(k) for k in keys)) | 1 << LEVELS - 1


def _number(*what: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(what).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", url or "")
    return m[1].lower() if m else ""


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, host, page (a number of the html), sid (of the stream), nodes (the stream as JSON), blocks (place, hash, text), seen (place, hash, once each)."""
    prepare(pages.sparkSession)
    block = pa.struct([("place", pa.int32()), ("hash", pa.int64()), ("text", pa.string())])
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(block))

    def streams(batches):
        for batch in batches:
            out: list = [[] for _ in types]
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                nodes, blocks = stream(page or "")
                nodes = json.dumps(nodes, ensure_ascii=False, separators=(",", ":"))
                row = (_host(url), _number(page or ""), _number(nodes), nodes, [{"place": p, "hash": _number(text), "text": text} for p, text in blocks])
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=["page_id", "url", "host", "page", "sid", "nodes", "blocks"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(streams, f"page_id {dict(rows.dtypes)['page_id']}, url string, host string, page long, sid long, nodes string, blocks array<struct<place:int,hash:long,text:string>>")


SEEN, FAN = 5, 256


def streams(pages: DataFrame) -> DataFrame:
    """host, sid, nodes, pages, common: the different streams of parsed pages, from how many different pages, and (place, hash) of text that all of these hold."""
    seen = F.expr("array_distinct(transform(blocks, b -> struct(b.place AS place, b.hash AS hash)))")
    once = pages.select("host", "sid", "page", seen.alias("seen")).dropDuplicates(["host", "sid", "page"])
    # a place of -1 counts the pages
    counts = once.select("host", "sid", F.explode(F.concat("seen", F.array(F.struct(F.lit(-1).alias("place"), F.lit(0).cast("long").alias("hash"))))).alias("x")).groupBy("host", "sid", "x.place", "x.hash").agg(F.count("*").alias("n"))
    counts = written(counts, "texts")
    sizes = counts.where("place < 0").select("host", "sid", F.col("n").alias("pages"))
    common = counts.where("place >= 0").join(sizes, ["host", "sid"]).where("n = pages").groupBy("host", "sid").agg(F.collect_list(F.struct("place", "hash")).alias("common"))
    nodes = pages.groupBy("host", "sid").agg(F.first("nodes").alias("nodes"))
    return nodes.join(sizes, ["host", "sid"]).join(common, ["host", "sid"], "left")


def _told(row) -> list:
    """A stream's nodes, each place with the texts that all its pages hold there, and their number."""
    nodes = json.loads(row["nodes"])
    here = places(nodes)
    for place in here:
        place += [[], int(row["pages"])]
    for x in row["common"] if row["common"] is not None else ():
        here[x["place"]][2].append(x["hash"])
    return nodes


def wrappers(found: DataFrame, fan: int = FAN) -> DataFrame:
    """host, wrapper (as JSON): the streams of each host merged, so many in a task, until one is left."""

    def tell(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(_told(r)) for r in batch.to_pylist()], pa.string())], names=["host", "wrapper"])

    def merge(pdf):
        wrapper = None
        for text in sorted(pdf["wrapper"]):
            wrapper = json.loads(text) if wrapper is None else align(wrapper, json.loads(text))
        pdf = pdf.iloc[:1].copy()
        pdf["wrapper"] = json.dumps(wrapper)
        return pdf[["host", "wrapper"]]

    rows = written(found.mapInArrow(tell, "host string, wrapper string"), "streams-told")
    most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        parts = -(-most // fan)
        rows = rows.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(parts)).alias("part")).applyInPandas(lambda pdf: merge(pdf), "host string, wrapper string")
        rows = written(rows, "wrappers")
        most = rows.groupBy("host").count().agg(F.max("count")).first()[0]
    return rows


def _places(found: DataFrame, wrapped: DataFrame) -> DataFrame:
    """host, sid, places (level, template): of each place of each stream, where it lies and which texts there are template."""
    kind = pa.list_(pa.struct([("level", pa.int32()), ("template", pa.list_(pa.int64()))]))

    def run(batches):
        known: tuple = (None, None)
        for batch in batches:
            out = []
            for nodes, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if known[0] != wrapper:
                    known = (wrapper, json.loads(wrapper))
                nodes = json.loads(nodes)
                met = laid(nodes, known[1])
                out.append([{"level": level(n[1]), "template": w[2] if w is not None and w[3] >= SEEN else []} for n, w in zip(places(nodes), met, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["host", "sid", "places"])

    return found.select("host", "sid", "nodes").join(wrapped, "host").mapInArrow(run, "host string, sid long, places array<struct<level:int,template:array<long>>>")


SMALL_MB = 16


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text for each page."""
    with arrow_batches(prepare(pages.sparkSession)):
        pages = written(parsed(pages, id_col, url_col, html_col), "pages", "zstd")
        found = written(streams(pages), "streams")
        told = written(_places(found, wrappers(found)), "places")
        size = told.agg(F.sum(F.expr("aggregate(places, 16, (a, x) -> a + 16 + 8 * size(x.template))"))).first()[0] or 0
    if size <= SMALL_MB << 20:
        told = F.broadcast(told)
    main = "places[b.place].level & {} > 0"
    own = main + " AND NOT array_contains(places[b.place].template, b.hash)"
    choices = ", ".join(f"filter(blocks, b -> {test.format(1 << n)})" for test in (own, main) for n in range(LEVELS))
    text = F.expr(f"coalesce(array_join(transform(get(filter(array({choices}), x -> size(x) > 0), 0), b -> b.text), '\n'), '')")
    return pages.select("page_id", "url", "host", "sid", "blocks").join(told, ["host", "sid"], "left").select("page_id", "url", text.alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
