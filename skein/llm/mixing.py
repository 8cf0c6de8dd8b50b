"""Mixing sources to target weights by Pfair scheduling (operator 2, native).

Each source's documents, in a fixed pseudo-random order, are cut into blocks.
The target weights become whole shares c of a period P (their sum).  The j-th
block of a source has release time floor(j*P/c) and deadline ceil((j+1)*P/c);
in each slot the released block with the earliest deadline goes next.  As the
shares fill the period, every block meets its window, so at any slot a source
is less than one block away from its share.  The schedule repeats each period,
so only one period is simulated (a SQL ``aggregate`` over P slots); the slot of
every block, and the place of every document, follow by arithmetic.

Given weights are taken as exact decimals: where the least whole numbers in their
proportion sum to at most ``EXACT_MOST``, these are the shares and their sum is the
period, and no rounding adds up over periods.  Else, and without weights, shares
are rounded to about ``PERIOD``, as in the SQL.  Sources that weigh nothing come
after all others, in equal shares.

A source that has run out leaves its slots to the others, which keep their
proportions.  All rows are kept.  A null source is a source of its own; rows
with the same id keep together in an order of no account; a null id counts as an
empty one.  An empty table gives no rows.  Texts, whatever their length, and all
other columns are only carried along; those named as the three results are replaced.
Only the number of sources and the period bound what is not distributed.  Ranks
within a source are taken in 4096 hash groups, so that a source with most of the
rows is split, and positions are sums over ranges of slots.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm._common import table, written

BLOCK = 16
PERIOD = 512
PLAN_MOST = 100_000
EXACT_MOST = 2048

_EDF = """
aggregate(sequence(0, p - 1),
  struct(transform(c, x -> 0) AS a, cast(array() AS array<int>) AS o),
  (s, t) -> transform(array(array_min(filter(
      transform(c, (x, i) -> struct(
        if(s.a[i] < x AND (s.a[i] * p) div x <= t, ((s.a[i] + 1) * p + x - 1) div x, 9223372036854775807L) AS d, i AS i)),
      x -> x.d < 9223372036854775807L)).i),
    k -> struct(transform(s.a, (x, i) -> if(i = k, x + 1, x)) AS a, concat(s.o, array(k)) AS o))[0],
  s -> s.o)
"""


def shares(counts: DataFrame, weights: dict | None, period: int, alpha: float) -> DataFrame:
    """(skey, n, c): whole shares of about ``period``; at least one for each source.

    Without weights a source weighs its number of documents to the power alpha.
    Of given weights, a source that is not named weighs nothing; ``mix`` keeps such sources apart.
    """
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(alpha))
    else:
        given = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (str(k), float(v)))) if weights else F.lit(None).cast("map<string,double>")
        w = F.coalesce(F.try_element_at(given, F.col("skey")), F.lit(0.0))
    total = F.sum("w").over(Window.partitionBy(F.lit(0)))
    share = F.floor(F.lit(float(period)) * F.col("w") / F.nullif(total, F.lit(0.0)) + F.lit(0.5)).cast("int")
    return counts.withColumn("w", w).select("skey", "n", F.greatest(F.lit(1), F.coalesce(share, F.lit(1))).alias("c"))


def schedule(sources: DataFrame) -> DataFrame:
    """(skey, j, slot, p, share, n): of a period of p slots, the j-th block of a source with so many shares and documents goes to ``slot``."""
    one = sources.agg(F.array_sort(F.collect_list(F.struct("skey", "n", "c"))).alias("s")).where(F.size("s") > 0)
    one = one.select("s", F.expr("transform(s.c, x -> cast(x AS long))").alias("c")).withColumn("p", F.expr("aggregate(c, 0L, (a, x) -> a + x)"))
    slots = one.select("s", "p", F.posexplode(F.expr(_EDF)).alias("slot", "k")).select("k", "slot", "p", F.expr("s[k]").alias("x"))
    j = F.row_number().over(Window.partitionBy("k").orderBy("slot")) - 1
    return slots.select(F.col("x.skey").alias("skey"), j.cast("long").alias("j"), "slot", "p", F.col("x.c").cast("long").alias("share"), F.col("x.n").alias("n"))


def _ahead(blocks: DataFrame) -> DataFrame:
    """(slot, ahead): how many documents come before each block (slot, size), by sums of ranges of slots."""
    dealt = written(blocks.repartitionByRange("slot").withColumn("part", F.spark_partition_id()), "blocks")
    sums = dealt.groupBy("part").agg(F.sum("size").alias("m"))  # a row for each task
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.select("part", "slot", F.coalesce(F.sum("size").over(within), F.lit(0)).alias("here")).join(F.broadcast(sums), "part")
    return rows.select("slot", (F.col("before") + F.col("here")).alias("ahead"))


def _whole(weights: dict) -> dict[str, int]:
    """The least whole numbers in the proportion of the weights."""
    exact = {k: Fraction(str(v)) for k, v in weights.items()}
    scale = math.lcm(*(v.denominator for v in exact.values()))
    whole = {k: int(v * scale) for k, v in exact.items()}
    common = math.gcd(*whole.values())
    return {k: v // common for k, v in whole.items()}


def mix(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, period: int = PERIOD, alpha: float = 0.5, id_col: str = "doc_id", source_col: str = "source", prefix: str = "mix_") -> DataFrame:
    """All rows and columns, and block (within the source), slot (virtual) and position (from 0, over all) with ``prefix``.

    A column of the input that has one of these three names is replaced.
    """
    if weights is not None:
        return _mix_given(docs, weights, block, period, id_col, source_col, prefix)
    return _mix(docs, None, block, period, alpha, id_col, source_col, prefix)


def _key(source_col: str) -> Column:
    return F.coalesce(F.col(source_col).cast("string"), F.lit("\0null"))


def _mix_given(docs: DataFrame, weights: dict, block: int, period: int, id_col: str, source_col: str, prefix: str) -> DataFrame:
    """The sources that weigh something, and after them the others."""
    for name in ("block", "slot", "position"):
        docs = docs.drop(prefix + name)
    named = {str(k): v for k, v in weights.items() if v > 0}
    key = _key(source_col)
    present = {k: named[k] for (k,) in docs.select(key.alias("k")).where(F.col("k").isin(list(named))).distinct().collect()}
    if not present:
        return _mix(docs, None, block, period, 0.0, id_col, source_col, prefix)
    whole = _whole(present)
    if sum(whole.values()) <= EXACT_MOST:
        present, period = whole, sum(whole.values())
    heavy = key.isin(list(present))
    first = _mix(docs.where(heavy), present, block, period, 1.0, id_col, source_col, prefix)
    rest = docs.where(~heavy)
    if rest.isEmpty():
        return first
    rows, slots = first.agg(F.count("*"), F.max(prefix + "slot") + 1).first()
    rest = _mix(rest, None, block, period, 0.0, id_col, source_col, prefix)
    return first.unionByName(rest.withColumn(prefix + "slot", F.col(prefix + "slot") + slots).withColumn(prefix + "position", F.col(prefix + "position") + rows))


def _mix(docs: DataFrame, weights: dict | None, block: int, period: int, alpha: float, id_col: str, source_col: str, prefix: str) -> DataFrame:
    for name in ("block", "slot", "position"):
        docs = docs.drop(prefix + name)
    names = docs.columns
    key = _key(source_col)
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), key.alias("skey"), h.alias("h"), F.col(id_col).alias("id")).withColumn("g", F.substring("h", 1, 3))
    groups = docs.select(key.alias("skey"), F.substring(h, 1, 3).alias("g")).groupBy("skey", "g").agg(F.count("*").alias("m"))
    sources = shares(groups.groupBy("skey").agg(F.sum("m").alias("n")), weights, period, alpha)
    plan = written(schedule(sources), "schedule")
    # period + sources rows; broadcast only while they are few
    small = F.broadcast if plan.count() <= PLAN_MOST else (lambda df: df)
    before = Window.partitionBy("skey").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("skey", "g", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("skipped"))
    ranked = keyed.join(groups, ["skey", "g"]).withColumn("r", F.row_number().over(Window.partitionBy("skey", "g").orderBy("h", "id")) - 1 + F.col("skipped"))
    ranked = ranked.withColumn("b", F.expr(f"r div {block}"))
    # A block's number within its period is b modulo the source's share, which the schedule holds with every slot.
    ranked = ranked.join(small(plan.where("j = 0").select("skey", "share")), "skey").withColumn("j", F.expr("b % share")).drop("share")
    placed = ranked.join(small(plan), ["skey", "j"]).withColumn("slot", F.expr("(b div share) * p + slot"))
    # a slot has one block, which its first document stands for
    starts = placed.where(f"r % {block} = 0").select("slot", F.expr(f"least(cast({block} AS long), n - r)").alias("size"))
    placed = placed.join(_ahead(starts), "slot")
    return placed.select("row.*", F.col("b").cast("long").alias(prefix + "block"), F.col("slot").cast("long").alias(prefix + "slot"), (F.col("ahead") + F.expr(f"r % {block}")).alias(prefix + "position"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", F.col("mix_block").alias("block"), F.col("mix_slot").alias("slot"), F.col("mix_position").alias("position"))


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, chr(0) || 'null') AS skey, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), n AS (
  SELECT skey, count(*) AS n FROM d GROUP BY skey
), s AS (
  SELECT skey, n, greatest(1, CAST(floor({PERIOD} * sqrt(n) / (SELECT sum(sqrt(n)) FROM n) + 0.5) AS BIGINT)) AS c,
         row_number() OVER (ORDER BY skey) AS i FROM n
), p AS (
  SELECT CAST(sum(c) AS BIGINT) AS p, list(c ORDER BY i) AS c FROM s
), edf AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS k, list_transform(c, lambda x: CAST(0 AS BIGINT)) AS a, c, p FROM p
  UNION ALL
  SELECT t + 1, pick, list_transform(a, lambda x, i: CASE WHEN i = pick THEN x + 1 ELSE x END), c, p
  FROM (
    SELECT t, a, c, p, list_min(list_filter(list_transform(c, lambda x, i:
        CASE WHEN a[i] < x AND (a[i] * p) // x <= t + 1 THEN (((a[i] + 1) * p + x - 1) // x) * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000 AS pick
    FROM edf WHERE t + 1 < p
  )
), slots AS (
  SELECT t AS slot, k AS i, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS j FROM edf WHERE t >= 0
), r AS (
  SELECT d.doc_id, d.source, s.i, s.c, row_number() OVER (PARTITION BY d.skey ORDER BY d.h, d.doc_id) - 1 AS r FROM d JOIN s USING (skey)
), b AS (
  SELECT r.*, r.r // {BLOCK} AS block FROM r
), v AS (
  SELECT b.doc_id, b.source, b.block, b.r, (b.block // b.c) * (SELECT p FROM p) + x.slot AS slot
  FROM b JOIN slots x ON x.i = b.i AND x.j = b.block % b.c
)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot,
       CAST(row_number() OVER (ORDER BY slot, r) - 1 AS BIGINT) AS position FROM v
"""
