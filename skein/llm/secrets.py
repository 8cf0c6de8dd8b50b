"""Secret scans with a trigram inverted index (operator 7).

Every rule is a regular expression.  From its syntax tree a Boolean trigram
query is derived: what a match must contain.  Documents are indexed in
segments (one for each block of an Arrow batch): the postings of a trigram are
the documents of the segment that hold it.  A rule's candidates are found by
uniting and intersecting postings; only those are verified with the regular
expression.  A rule from which no mandatory trigram follows (such as a bare run
of hex digits) scans every document.  Nothing is shuffled.

The index of a segment holds the trigrams that some rule wants, and lives as long
as its block is scanned: rules are known before documents are read, so there is no
later query that a stored index could answer.

Null texts count as empty, an empty table gives no rows.  Repeated rows and
repeated or null ids each give a row.  Long texts are scanned whole, one text a
block if need be.  Positions are code points, ends exclusive.  Only the columns
named are read, so others may have any name; ``drop_secrets`` carries them along.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skein.llm._bytes import SLAB, blocks
from skein.llm._common import id_text, prepare, table


@dataclass(frozen=True)
class Rule:
    """``least``: characters that ``group`` needs; a shorter match is dropped."""

    name: str
    pattern: str
    least: int = 0
    group: int = 0


def _anycase(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_anycase(w) for w in ("password", "passwd", "secret", "token")) + "|" + _anycase("api") + "_?" + _anycase("key")
BASE_RULES = (
    Rule("assign", rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
)

# A trigram query: True (anything), a bytes trigram, ("and", ...) or ("or", ...).
_MOST = 64
ANY_CASE = sre.SRE_FLAG_IGNORECASE


def _and(parts):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts):
    if not parts or any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _grams(strings: frozenset[str]):
    """What all of a text must hold that contains one of ``strings``."""
    options = []
    for s in sorted(strings):
        b = s.encode()
        if len(b) < 3:
            return True
        options.append(_and(sorted({b[i : i + 3] for i in range(len(b) - 2)})))
    return _or(options)


def _chars(items) -> frozenset[str] | None:
    """The characters of a class, or None if there are many."""
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= 8 else None


def _walk(tree) -> tuple[frozenset[str] | None, object]:
    """(all strings that it can match, or None; query that a match implies)."""
    done, exact = [], frozenset([""])

    def close():
        nonlocal exact
        done.append(_grams(exact))
        exact = frozenset([""])

    whole = True
    for op, arg in tree:
        if op is sre.LITERAL:
            piece, query = frozenset([chr(arg)]), True
        elif op is sre.IN:
            piece, query = _chars(arg), True
        elif op is sre.SUBPATTERN:
            piece, query = _walk(arg[-1])
        elif op is sre.BRANCH:
            walked = [_walk(x) for x in arg[1]]
            piece = None if any(p is None for p, _ in walked) else frozenset().union(*(p for p, _ in walked))
            query = _or([_and([q, True if p is None else _grams(p)]) for p, q in walked])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) or op.name == "POSSESSIVE_REPEAT":
            low, high, sub = arg
            p, q = _walk(sub)
            piece, query = None, q if low else True
            if (low, high) == (0, 1) and p is not None:
                piece = p | {""}
            elif low and low == high and low <= 5 and p is not None and len(p) == 1:
                piece = frozenset(x * low for x in p)
        elif op is sre.AT:
            continue
        else:
            piece, query = None, True
        if piece is not None and len(exact) * len(piece) <= _MOST:
            exact = frozenset(a + b for a in exact for b in piece)
            continue
        whole = False
        close()
        done.append(query)
        if piece is not None and len(piece) <= _MOST:
            exact = piece
    if whole:
        return exact, True
    close()
    return None, _and(done)


def trigram_query(pattern: str):
    """The Boolean query that every text with a match fulfils; True if none follows."""
    tree = sre_parse.parse(pattern)
    if tree.state.flags & ANY_CASE or re.search(r"\(\?[a-zA-Z]*i", pattern):  # letters of either case imply no trigram
        return True
    exact, query = _walk(tree)
    return _grams(exact) if exact is not None else query


def _needed(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(_needed(q) for q in query[1:]))


class Segment:
    """An inverted index over one block: for each wanted trigram the sorted rows that hold it."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, number: np.ndarray, wanted: list[bytes]):
        self.rows, self.postings = len(offsets) - 1, {}
        seen = np.zeros((0, 2), np.int64)
        for lo in range(0, max(0, len(buf) - 2), SLAB):
            part = buf[lo : lo + SLAB + 2].astype(np.int32)
            hit = number[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            at = np.flatnonzero(hit)
            row = np.searchsorted(offsets, at + lo, side="right") - 1
            inside = at + lo + 3 <= offsets[row + 1]
            pairs = np.stack([hit[at][inside].astype(np.int64), row[inside]], 1)
            seen = np.unique(np.concatenate([seen, pairs]), axis=0)
        cuts = np.searchsorted(seen[:, 0], np.arange(1, len(wanted) + 2))
        for k, gram in enumerate(wanted):
            self.postings[gram] = seen[cuts[k] : cuts[k + 1], 1]

    def find(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.rows)
        if isinstance(query, bytes):
            return self.postings[query]
        parts = [self.find(q) for q in query[1:]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True)
        return out


@lru_cache(maxsize=4)
def _compiled(rules: tuple[Rule, ...]):
    """For each rule its query and its regular expression, the wanted trigrams, and the number of each trigram; once for a worker."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*(_needed(q) for q in queries)))
    number = np.zeros(1 << 24, np.uint16)
    for k, g in enumerate(wanted):
        number[g[0] << 16 | g[1] << 8 | g[2]] = k + 1
    return queries, [re.compile(r.pattern) for r in rules], wanted, number


def scan_texts(column: pa.Array, rules: tuple[Rule, ...]) -> Iterator[list[tuple[int, int, int]]]:
    """For each row the spans (start, rule number, end), by start and then rule."""
    queries, regexes, wanted, number = _compiled(rules)
    for lo, buf, offsets in blocks(column):
        segment = Segment(buf, offsets, number, wanted)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(segment.rows)]
        texts: dict[int, str] = {}
        for k, rule in enumerate(rules):
            for row in segment.find(queries[k]).tolist():
                if row not in texts:
                    texts[row] = buf[offsets[row] : offsets[row + 1]].tobytes().decode()
                for m in regexes[k].finditer(texts[row]):
                    if len(m[rule.group]) >= rule.least:
                        found[row].append((m.start(), k, m.end()))
        for spans in found:
            spans.sort()
            yield spans


def find_secrets(docs: DataFrame, base: tuple[Rule, ...] = BASE_RULES, more: tuple[Rule, ...] = MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, and spans (kind, start, end) by start and then kind as listed."""
    prepare(docs.sparkSession)
    rules = base + more
    names = pa.array([r.name for r in rules])
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches):
        for batch in batches:
            rows = list(scan_texts(batch.column(1), rules))
            flat = np.array([s for spans in rows for s in spans], np.int64).reshape(-1, 3)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in rows])]).astype(np.int32)
            values = pa.StructArray.from_arrays([names.take(pa.array(flat[:, 1])), pa.array(flat[:, 0]), pa.array(flat[:, 2])], fields=list(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def drop_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with each secret of the text replaced by ``mark``; overlapping spans become one."""
    prepare(docs.sparkSession)
    rules = BASE_RULES + MORE_RULES

    def scan(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            column, out = batch.column(at), []
            for text, spans in zip(column.to_pylist(), scan_texts(column, rules), strict=True):
                if spans:
                    parts, end = [], 0
                    for a, _, b in spans:
                        if a >= end:
                            parts += [text[end:a], mark]
                        end = max(end, b)
                    text = "".join([*parts, text[end:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, column.type) if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(scan, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = [r.name for r in BASE_RULES]

    def digest(batches):
        for batch in batches:
            rows = []
            for spans in batch.column(1).to_pylist():
                told = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in spans]
                kinds = [k for k, _ in told]
                rows.append((*(kinds.count(k) for k in base), hashlib.sha256(",".join(t for k, t in told if k in base).encode()).hexdigest(), ",".join(t for _, t in told)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return find_secrets(table(spark, sf_dir, "documents")).mapInArrow(digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _sql() -> str:
    """The spans of each rule from its matches and the pieces between them."""
    rules = BASE_RULES + MORE_RULES
    parts = []
    for k, rule in enumerate(rules):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        size = f"length(regexp_extract(m[i], {pattern}, {rule.group}))"
        parts.append(
            f"""SELECT doc_id, {k} AS k, '{rule.name}' AS kind, a, a + n AS b FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'a': list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'size': {size}}}), recursive := true)
    FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS m, regexp_split_to_array(text, {pattern}) AS p FROM d) WHERE len(m) > 0) WHERE size >= {rule.least}"""
        )
    spans = "\n  UNION ALL ".join(parts)
    base = ", ".join(f"'{r.name}'" for r in BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in BASE_RULES)
    told = "kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS (
  {spans}
), t AS (
  SELECT doc_id, {counts}, string_agg({told}, ',' ORDER BY a, k) FILTER (kind IN ({base})) AS base, string_agg({told}, ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.name}, 0) AS n_{r.name}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (doc_id)
"""


SQL = _sql()
