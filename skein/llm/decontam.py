"""Benchmark decontamination by template canonicalisation (operator 10, native).

Words of a text are made canonical: numbers, units after a number and names
become typed placeholders, other words are lower-cased and lose punctuation at
their end.  What is a name cannot be told from one word, so a text has three
forms: in the first every word that begins with a capital is a name, in the
second none is, in the third those inside a sentence are.  The first finds
exchanged names wherever they stand, the second copies in other case, the third
exchanged names where a sentence begins elsewhere.

A document is contaminated by a benchmark item if, in one of the forms, 13
consecutive canonical words of both are equal, and either the words themselves are
the same (a table of numbers has no other), or 7 of the 13 are literal and the
slots agree.  These are checked over the whole stretch in which the item, laid
along the document, goes on being equal in any form: equal values of the item stand for equal
values of the document and the other way round.  A name that is the same on both
sides counts as literal.  So a question whose numbers or names were exchanged is
found, one whose slots contradict each other or a chance run of placeholders is
not.  An item of fewer than 13 words is its own window: all its words in a row, 7
of 13 of them literal or all the same.

Any 13 words hold a whole block of 7 that starts at a multiple of 7.  Thus the
documents give only these blocks, the benchmark gives every run of 7 words, and
both are hash-joined, each with the keys of all forms; for each hit the item is
laid along the document.  For each length of shorter items that occurs, the
documents give every run of so many words too.  The benchmark side is broadcast
only if its count is within ``BROADCAST_ROWS``.

Null and empty texts share nothing.  Items that repeat count by item_id.  A null
doc_id keeps its row, and is not contaminated; rows that repeat an id share what
any of them has.  Empty tables of documents or items give no pair.  Long texts are
read whole.  Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm._common import table, unused, written

WINDOW, BLOCK, LITERAL = 13, 7, 7
BROADCAST_ROWS = 200_000
_S = r"\x20\x09-\x0D"
#: Unit words, singular and plural or symbol.
UNITS = "km m cm mm kg g mg l ml s h min kilometers kilometres meters metres miles feet inches kilograms grams pounds ounces liters litres hours minutes seconds days weeks months years dollars euros cents percent degrees".split()
_NUMBER = rf"(?<![^{_S}])[$€£(\[\"'+-]*[0-9][0-9.,:/]*%?[)\].,;:!?\"']*(?![^{_S}])"
_UNIT = rf"(?<=<num>)([{_S}]+)(?i:{'|'.join(UNITS)})[.,;:!?)]*(?![^{_S}])"
#: A name inside a sentence, to be marked, and any word that begins with a capital, marked or not.
_NAME = rf"[\p{{Lu}}](?<=[^.!?{_S}]\x20[\p{{Lu}}])[\p{{L}}'’-]*[.,;:!?)\"']*(?![^{_S}])"
_CAPITAL = rf"(?<![^{_S}])[^\p{{L}}\p{{N}}{_S}]*\p{{Lu}}[^{_S}]*"
_TAIL = rf"[.,;:!?\"')\]](?<=[\p{{L}}\p{{N}}>].)[.,;:!?\"')\]]*(?![^{_S}])"
_MARK = "\x02"
#: What is not part of a slot's value.
_OUTER = r"^[(\[\"'“‘«]+|[.,;:!?\"')\]”’»]+$"
FORMS = 3


def marked(text: Column) -> Column:
    """The text with as many words as before: numbers and units canonical, no punctuation at ends, names inside a sentence marked."""
    c = F.regexp_replace(F.translate(text, _MARK, "\x03"), _NUMBER, "<num>")
    c = F.when(F.contains(c, F.lit("<num>")), F.regexp_replace(c, _UNIT, "$1<unit>")).otherwise(c)
    return F.regexp_replace(F.regexp_replace(c, _NAME, _MARK + "$0"), _TAIL, "")


def forms(c: Column) -> list[Column]:
    """The words of a marked text in each form: all capitalised words are names, none, those inside a sentence."""
    inside = F.when(F.contains(c, F.lit(_MARK)), F.regexp_replace(c, rf"{_MARK}[^{_S}]*", "<name>")).otherwise(c)
    return [_split(F.lower(x)) for x in (F.regexp_replace(c, _CAPITAL, "<name>"), F.translate(c, _MARK, ""), inside)]


def _split(text: Column) -> Column:
    return F.split(text, f"[{_S}]+")


def _values(text: Column) -> Column:
    """The words as values of slots."""
    return F.transform(_split(F.lower(text)), lambda x: F.regexp_replace(x, _OUTER, ""))


def _trimmed(text: Column) -> Column:
    return F.trim(F.coalesce(text.cast("string"), F.lit("")), F.lit("\x20\t\n\x0b\x0c\r"))


def _in_forms(df: DataFrame, name: str, *others: str) -> DataFrame:
    """The columns ``others``, and the words of ``text`` in each form as name0, name1, ..."""
    marks = df.select(*others, marked(F.col("text")).alias("__m"))
    return marks.select(*others, *(c.alias(f"{name}{v}") for v, c in enumerate(forms(F.col("__m")))))


def _keys(name: str, i: str, words: int = BLOCK) -> str:
    """The distinct keys of the run of words at ``i``."""
    return f"array_distinct(array({', '.join(f'xxhash64(slice({name}{v}, {i} + 1, {words}))' for v in range(FORMS))}))"


def _runs(words: int, least: int, step: int) -> str:
    """The keys and places of a document's runs of so many words, if it has ``least`` words."""
    starts = f"if(size(dc0) >= {least}, sequence(0, greatest(size(dc0) - {words}, 0), {step}), array())"
    return f"flatten(transform({starts}, i -> transform({_keys('dc', 'i', words)}, h -> struct(h, i AS pos))))"


def _found(v: int) -> str:
    """Whether the words of document and item that face each other hold, in form v, a window that counts.

    do, dc: the document's words from where the item begins or would begin; skip: how many of the item's come before the document's first.
    """
    n = f"least(size(io), {WINDOW})"
    slots = "('<num>', '<unit>', '<name>')"
    # a run ends where two words differ in every form
    equal = " OR ".join(f"dc{u}[j] = ic{u}[skip + j]" for u in range(FORMS))
    facing = f"""aggregate(sequence(0, size(do) - 1),
      struct(0 AS run, cast(array() AS array<struct<run:int,same:boolean,slot:boolean,literal:boolean,d:string,i:string>>) AS o),
      (s, j) -> if({equal},
        struct(s.run AS run, concat(s.o, array(struct(s.run AS run, dc{v}[j] = ic{v}[skip + j] AS same, dc{v}[j] = ic{v}[skip + j] AND dc{v}[j] IN {slots} AS slot,
          NOT dc{v}[j] IN {slots} OR (dc{v}[j] = '<name>' AND do[j] = io[skip + j]) AS literal, do[j] AS d, io[skip + j] AS i))) AS o),
        struct(s.run + 1 AS run, s.o AS o)),
      s -> s.o)"""
    agree = """exists(array(array_distinct(transform(filter(z, x -> x.slot), x -> struct(x.d, x.i)))),
      q -> size(q) = size(array_distinct(transform(q, x -> x.d))) AND size(q) = size(array_distinct(transform(q, x -> x.i))))"""
    windows = f"filter(transform(sequence(1, size(z) - {n} + 1), j -> slice(z, j, {n})), y -> forall(y, x -> x.same))"
    return f"""exists(array({facing}), w -> exists(array_distinct(transform(w, x -> x.run)), r -> exists(array(filter(w, x -> x.run = r)), z ->
        size(z) >= {n} AND (exists({windows}, y -> forall(y, x -> x.d = x.i))
          OR (exists({windows}, y -> size(filter(y, x -> x.literal)) * {WINDOW} >= {LITERAL} * {n}) AND {agree})))))"""


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id), once for each document and item that share a window."""
    docs = docs.select(F.col(id_col).alias("doc_id"), _trimmed(F.col(text_col)).alias("text")).where("doc_id IS NOT NULL")
    items = benchmark.select("item_id", _trimmed(F.col("text")).alias("text")).where("item_id IS NOT NULL AND text <> ''")
    items = written(_in_forms(items.withColumn("io", _values(F.col("text"))), "ic", "item_id", "io"), "items")
    lengths = sorted(n for (n,) in items.select(F.size("io")).distinct().collect() if n < WINDOW)
    grams = items.where(F.size("io") >= WINDOW).select("item_id", F.size("io").alias("n"), F.explode(F.expr(f"flatten(transform(sequence(0, size(io) - {BLOCK}), i -> transform({_keys('ic', 'i')}, h -> struct(h, i AS off))))")).alias("x")).select("item_id", "n", "x.h", "x.off")
    # a short item that is placeholders alone with its names exchanged would hit everywhere, and is matched by equal words only
    short = [f"if({v == 1} OR exists(ic{v}, x -> x NOT IN ('<num>', '<unit>', '<name>')), xxhash64(ic{v}), null)" for v in range(FORMS)]
    short = items.where(F.size("io") < WINDOW).select("item_id", F.size("io").alias("n"), F.explode(F.expr(f"array_distinct(array({', '.join(short)}))")).alias("h"), F.lit(0).alias("off"))
    grams = grams.unionByName(short.where("h IS NOT NULL"))
    small = F.broadcast if grams.count() <= BROADCAST_ROWS else (lambda df: df)
    # the size is looked at within the expression: a filter would make the forms twice
    runs = [_runs(BLOCK, WINDOW, BLOCK), *(_runs(n, n, 1) for n in lengths)]
    blocks = _in_forms(docs, "dc", "doc_id").select("doc_id", F.explode(F.expr(f"concat({', '.join(runs)})")).alias("x")).select("doc_id", "x.h", "x.pos")
    # all hits of an item at one distance are one: where the item begins, or would begin
    hits = blocks.join(small(grams), "h").select("doc_id", "item_id", "n", (F.col("pos") - F.col("off")).alias("at")).distinct()
    by_doc = hits.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "n", "at")).alias("hits"))
    near = _in_forms(docs.join(by_doc, "doc_id").withColumn("do", _split(F.lower("text"))), "dc", "doc_id", "do", "hits")
    part = "greatest(x.at, 0) + 1, x.n + least(x.at, 0)"
    near = near.select("doc_id", F.explode(F.expr(f"""transform(hits, x -> struct(x.item_id AS item_id, greatest(-x.at, 0) AS skip,
        {', '.join(f'slice(dc{v}, {part}) AS dc{v}' for v in range(FORMS))}, slice(do, {part}) AS do))""")).alias("x")).select("doc_id", "x.*")
    near = near.withColumn("do", F.transform("do", lambda x: F.regexp_replace(x, _OUTER, ""))).join(small(items), "item_id")
    return near.where(F.expr(" OR ".join(_found(v) for v in range(FORMS)))).select("doc_id", "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, unchanged, of the documents that share no window with the benchmark."""
    bad = unused(docs, "bad")
    found = matches(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(found, F.col(id_col) == F.col(bad), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, first_item."""
    docs = table(spark, sf_dir, "documents")
    found = matches(docs, table(spark, sf_dir, "benchmark")).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "first_item")
