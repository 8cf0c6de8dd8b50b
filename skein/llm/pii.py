"""Personal data by weak supervision (operator 6, native).

Regular expressions propose spans: four base kinds, and three further kinds that
are only kept if the method says so.  Labelling functions (form, gazetteers,
context words before a span, checks, boundaries) vote +1, -1 or abstain on each.
Expectation-maximisation over the counts of vote patterns, kind by kind and until
nothing changes, estimates how reliable each labeller is, and gives each pattern a
probability.  It starts from stated assumptions, which weigh as much as some
hundred spans and which no weight leaves by more than a factor of two, so that a
small or odd table does not turn a labeller round.  With these as soft labels a
final span classifier (naive Bayes, for each kind) is trained, which also sees what
no labeller does: length and variety of the span, and what stands before and after
it.  It decides on the spans that are not of a base kind.  Base spans stay.

Everything runs as DataFrame and SQL functions; one row stays one row, nothing
is shuffled but the counts of vote patterns, whose number is bounded by the
labellers.  Positions are code points, ends exclusive.  Null texts count as
empty, long ones are read whole.  Repeated rows and repeated or null ids each give
a row, an empty table none.  Only the two columns named are read, so others may
have any name.

A pattern starts only where no earlier start in the same run of characters could
fail differently, and repeats possessively; the matches are those of the plain
patterns, in linear time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm._common import id_text, table, written

_L = r"A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_L}]))[{_L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "tel": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20-][0-9]{3}-[0-9]{4}(?![0-9-])",
}
KINDS = [*BASE, *MORE]
#: Gazetteers and context words.
TLDS = "com org net edu gov mil int info biz io ai app dev de fr es it nl be ch at uk eu us ca au jp cn in br mx ru pl se no fi dk pt ie".split()
DIAL = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92".split()
IBAN = "AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK".split()
NEAR = {
    "email": "mail|contact|write|reach|address|courriel|correo",
    "ip": "ip|address|host|server|client|login|from",
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": "call|phone|tel|mobile|cell|fax|contact|whatsapp|telefon",
    "ssn": "ssn|social|security|taxpayer",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "tel": "call|phone|tel|mobile|cell|fax|contact|whatsapp|telefon",
}
FAR = "version|release|isbn|issn|doi|order|invoice|serial|model|part|article|section|chapter|figure"
#: Words that may stand between such a word and the span.
LINK = "number|numbers|no|nr|num|id|code|is|was"
VOTES = ["form", "gazetteer", "near", "far", "check", "edge"]
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_DIGITS = "regexp_replace({v}, '[^0-9]', '')"


def _lit(s: str) -> str:
    return "r'" + s.replace("'", "\\x27") + "'"


def _spans(kind: str) -> str:
    """Spans of a kind from its matches and the pieces between them."""
    return f"""aggregate(sequence(0, size({kind}_m) - 1),
        named_struct('at', 0, 'o', cast(array() AS array<struct<start:int,end:int,value:string>>)),
        (s, i) -> named_struct('at', s.at + length({kind}_p[i]) + length({kind}_m[i]),
          'o', concat(s.o, array(named_struct('start', s.at + length({kind}_p[i]), 'end', s.at + length({kind}_p[i]) + length({kind}_m[i]), 'value', {kind}_m[i])))),
        s -> s.o)"""


def _luhn(d: str) -> str:
    doubled = f"2 * cast(substring({d}, -i, 1) AS int)"
    return f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + if(i % 2 = 1, cast(substring({d}, -i, 1) AS int), if({doubled} > 9, {doubled} - 9, {doubled}))) % 10 = 0"


def _valid(kind: str, v: str) -> str:
    d = _DIGITS.format(v=v)
    return {
        "ip": f"{v} RLIKE {_lit(rf'^{_OCTET}(?:[.]{_OCTET}){{3}}$')}",
        "card": f"if(length({d}) BETWEEN 13 AND 19, {_luhn(d)}, false)",
        "phone": f"length({d}) BETWEEN 9 AND 15",
    }.get(kind, "true")


def _votes(kind: str, v: str, left: str, right: str) -> dict[str, str]:
    d = _DIGITS.format(v=v)
    form = {
        "email": f"if({v} RLIKE {_lit('^[A-Za-z0-9][^@]{0,63}@[^@]+[.][A-Za-z]{2,}$')}, 1, -1)",
        "ip": f"if({v} RLIKE {_lit('(^|[.])0[0-9]')}, -1, 1)",
        "card": f"if({v} RLIKE {_lit('^[0-9]{13,19}$|^[0-9]{4}([ -])[0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}$')}, 1, 0)",
        "phone": f"if({v} RLIKE {_lit('[.][.]|--|[(][^)]*$')}, -1, 1)",
        "ssn": f"if({v} RLIKE '^(000|666|9)|-00-|-0000$', -1, 1)",
        "iban": f"if(length(replace({v}, ' ', '')) BETWEEN 15 AND 34, 1, -1)",
        "tel": f"if({v} RLIKE {_lit('^[(]?[2-9][0-9]{2}')}, 1, -1)",
    }[kind]
    gazetteer = {
        "email": f"if(lower(regexp_extract({v}, '([A-Za-z0-9-]+)$', 1)) IN ({','.join(repr(x) for x in TLDS)}), 1, -1)",
        "ip": f"if({v} RLIKE {_lit('^(0|127|255)[.]')}, -1, 0)",
        "card": f"if({d} RLIKE '^(4|5[1-5]|2[2-7]|3[47]|6)', 1, 0)",
        "phone": f"if({d} RLIKE '^({'|'.join(DIAL)})', 1, -1)",
        "iban": f"if(substring({v}, 1, 2) IN ({','.join(repr(x) for x in IBAN)}), 1, -1)",
    }.get(kind, "0")
    check = {
        "card": f"if({d} RLIKE {_lit(chr(94) + '([0-9])' + chr(92) + '1+$')}, -1, 1)",
        "phone": f"if(length({d}) BETWEEN 10 AND 14, 1, 0)",
        "ip": f"if({v} RLIKE '^([0-9]+)[.]0[.]0[.]0$', -1, 1)",
    }.get(kind, "0")
    return {
        "form": form,
        "gazetteer": gazetteer,
        "near": f"if({left} RLIKE {_lit(chr(92) + 'b(?:' + NEAR[kind] + ')')}, 1, 0)",
        "far": f"if({left} RLIKE {_lit(chr(92) + 'b(?:' + FAR + ')(?:' + chr(92) + 'W+(?:' + LINK + ')){0,2}' + chr(92) + 'W*$')}, -1, 0)",
        "check": check,
        "edge": f"if({left} RLIKE '[A-Za-z0-9]$' OR {right} RLIKE '^[A-Za-z0-9]', -1, 1)",
    }


def _features(v: str, left: str, right: str) -> dict[str, str]:
    """What only the classifier sees of a span and its context, as small numbers."""

    def kind_of(c: str) -> str:
        return f"CASE WHEN {c} = '' THEN 0 WHEN {c} RLIKE {_lit(chr(92) + 'p{L}')} THEN 1 WHEN {c} RLIKE '[0-9]' THEN 2 WHEN {c} IN (':', '=', '#') THEN 3 WHEN {c} IN ('-', '/', '_', '@') THEN 4 ELSE 5 END"

    different = f"size(array_distinct(split(regexp_replace({v}, '[^A-Za-z0-9]', ''), '')))"
    return {
        "size": f"cast(least(4, length({v}) div 8) AS int)",
        "lead": kind_of(f"substring(rtrim({left}), -1, 1)"),
        "tail": kind_of(f"ltrim({right})"),
        "variety": f"CASE WHEN {different} <= 2 THEN 0 WHEN {different} <= 4 THEN 1 ELSE 2 END",
    }


FEATURES = {"size": 5, "lead": 6, "tail": 6, "variety": 3}


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found: an array of (kind number, start, end, votes, features) by kind and start."""
    docs = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    none = F.expr("cast(array() AS array<string>)")
    gate = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    found = docs.select("doc_id", "text", *(F.when(gate.get(k, F.lit(True)), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"{k}_m") for k, p in (BASE | MORE).items()))
    found = found.select("*", *(F.when(F.size(f"{k}_m") > 0, F.split("text", p, -1)).otherwise(none).alias(f"{k}_p") for k, p in (BASE | MORE).items()))
    found = found.select("doc_id", "text", *(F.expr(f"if(size({k}_m) = 0, cast(array() AS array<struct<start:int,end:int,value:string>>), filter({_spans(k)}, x -> {_valid(k, 'x.value')})) AS {k}") for k in KINDS))
    base = f"concat({', '.join(BASE)})"
    typed = []
    for n, k in enumerate(KINDS):
        rows = k if k in BASE else f"if(size({k}) = 0, {k}, filter({k}, x -> NOT exists({base}, y -> x.start < y.end AND y.start < x.end)))"
        context = ("x.value", "lower(substring(text, greatest(x.start - 40, 0) + 1, least(x.start, 40)))", "substring(text, x.end + 1, 1)")
        told = ", ".join(f"'{name}', {x}" for name, x in (_votes(k, *context) | _features(*context)).items())
        typed.append(f"transform({rows}, x -> named_struct('kind', {n}, 'start', x.start, 'end', x.end, {told}))")
    return found.select("doc_id", F.expr(f"concat({', '.join(typed)})").alias("found"))


#: What is assumed of each labeller before any data: how likely it votes +1 and -1 on personal data, and on other spans.
ASSUMED = {
    "form": ((0.90, 0.01), (0.45, 0.45)),
    "gazetteer": ((0.80, 0.05), (0.40, 0.30)),
    "near": ((0.60, 0.0), (0.15, 0.0)),
    "far": ((0.0, 0.003), (0.0, 0.60)),
    "check": ((0.50, 0.02), (0.30, 0.30)),
    "edge": ((0.97, 0.03), (0.60, 0.40)),
}
#: The assumptions weigh as much as so many spans; a vote's weight stays between half and twice the assumed one.
WEIGHT, LEAST, MOST = 200.0, 0.5, 2.0


def _within(x: float, assumed: float) -> float:
    lo, hi = sorted((LEAST * assumed, MOST * assumed))
    return min(max(x, lo), hi)


def reliabilities(counts: dict[tuple[int, ...], float], rounds: int = 1000) -> tuple[float, dict[str, dict[int, float]]]:
    """For one kind, from how often each vote pattern occurs: the log odds before any vote, and of each labeller's votes.

    Expectation-maximisation until nothing changes by a millionth.
    """
    share = {f: {y: {1: p[0], -1: p[1], 0: 1 - p[0] - p[1]} for y, p in ((True, yes), (False, no))} for f, (yes, no) in ASSUMED.items()}
    first = {f: {v: math.log(max(s[True][v], 1e-4) / max(s[False][v], 1e-4)) for v in (-1, 0, 1)} for f, s in share.items()}
    prior, odds = 0.4, first
    for _ in range(rounds):
        yes, no = 0.0, 0.0
        votes = {f: {v: [0.0, 0.0] for v in (-1, 0, 1)} for f in VOTES}
        for pattern, n in counts.items():
            z = prior + sum(odds[f][v] for f, v in zip(VOTES, pattern, strict=True))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            yes, no = yes + n * p, no + n * (1 - p)
            for f, v in zip(VOTES, pattern, strict=True):
                votes[f][v][0] += n * p
                votes[f][v][1] += n * (1 - p)
        new = {
            f: {v: _within(math.log((votes[f][v][0] + WEIGHT * max(share[f][True][v], 1e-4)) / (yes + WEIGHT)) - math.log((votes[f][v][1] + WEIGHT * max(share[f][False][v], 1e-4)) / (no + WEIGHT)), first[f][v]) for v in (-1, 0, 1)}
            for f in VOTES
        }
        top = _within(math.log((yes + 0.6 * WEIGHT) / (no + 0.4 * WEIGHT)), 0.4)
        moved = max(abs(top - prior), *(abs(new[f][v] - odds[f][v]) for f in VOTES for v in (-1, 0, 1)))
        prior, odds = top, new
        if moved < 1e-6:
            break
    return prior, odds


def _chance(score: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(score, F.lit(30.0)), F.lit(-30.0))))


def estimate(patterns: DataFrame) -> Column:
    """From (kind, votes, features, n): the classifier's log odds for a span, as a column over the same names.

    The driver gets a row for each vote pattern that occurs, at most kinds x 3^labellers, and then two figures for each
    kind, feature and value.
    """
    by_kind: dict[int, dict] = {k: {} for k in range(len(KINDS))}
    for r in patterns.groupBy("kind", *VOTES).agg(F.sum("n").alias("n")).collect():
        by_kind[r["kind"]][tuple(r[f] for f in VOTES)] = r["n"]
    known = {k: reliabilities(c) for k, c in by_kind.items()}

    def of_kind(k: int) -> Column:
        prior, odds = known[k]
        return sum((F.element_at(F.create_map(*(F.lit(x) for v, w in odds[f].items() for x in (v, w))), F.col(f)) for f in VOTES), F.lit(prior))

    score = F.lit(0.0)
    for k in known:
        score = F.when(F.col("kind") == k, of_kind(k)).otherwise(score)
    p = _chance(score)
    sums = patterns.groupBy("kind").agg(F.sum(F.col("n") * p).alias("y"), F.sum(F.col("n") * (1 - p)).alias("n"), *(F.sum(F.when(F.col(f) == v, F.col("n") * q).otherwise(0.0)).alias(f"{f}_{v}_{name}") for f, size in FEATURES.items() for v in range(size) for name, q in (("y", p), ("n", 1 - p))))
    for t in sums.collect():
        for f, size in FEATURES.items():
            # smoothed so that a feature seen on few spans says little, and bounded so that none outvotes a labeller
            says = [math.log((t[f"{f}_{v}_y"] + WEIGHT / size) / (t["y"] + WEIGHT)) - math.log((t[f"{f}_{v}_n"] + WEIGHT / size) / (t["n"] + WEIGHT)) for v in range(size)]
            score = score + F.when(F.col("kind") == t["kind"], F.element_at(F.array(*(F.lit(max(-0.5, min(0.5, w))) for w in says)), F.col(f) + 1)).otherwise(0.0)
    return score


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: an array of (kind, start, end) by kind as listed and start."""
    found = written(candidates(docs, id_col, text_col), "candidates")
    columns = ["kind", *VOTES, *FEATURES]
    spans = found.select(F.explode("found").alias("x")).select(*(F.col(f"x.{c}").alias(c) for c in columns))
    patterns = written(spans.groupBy(*columns).agg(F.count("*").cast("double").alias("n")), "patterns")
    # At most one row for each pattern: kinds x 3^labellers x values of features, whatever the input.
    good = patterns.where((estimate(patterns) >= 0) & (F.col("kind") >= len(BASE))).agg(F.collect_set(F.struct(*columns)).alias("good"))
    like = ", ".join(f"x.{c} AS {c}" for c in columns)
    names = ", ".join(repr(k) for k in KINDS)
    return found.withColumn("good", good.scalar()).select(
        "doc_id", F.expr(f"transform(filter(found, x -> x.kind < {len(BASE)} OR array_contains(good, struct({like}))), x -> struct(array({names})[x.kind] AS kind, x.start AS start, x.end AS end))").alias("spans")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    spans = find_pii(table(spark, sf_dir, "documents"))
    told = "transform(filter(spans, x -> {}), x -> concat(x.kind, ':', x.start, ':', x.end))"
    base = ", ".join(repr(k) for k in BASE)
    return spans.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) AS long)").alias(f"n_{k}") for k in BASE),
        F.sha2(F.expr(f"array_join({told.format(f'x.kind IN ({base})')}, ',')"), 256).alias("base_sha256"),
        F.expr(f"array_join({told.format('true')}, ',')").alias("spans"),
    )
