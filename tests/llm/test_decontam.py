"""Decontamination against brute force over all alignments, and on planted re-parameterised items."""

import random

import pytest
import regex

from skein.llm import decontam

S = r"\x20\x09-\x0D"
WORDS = "a train leaves the city with boxes and every driver asks how many remain after stops on this long route when we sell half of them to people who pay later".split()
NAMES = "Anna Ben Carl Dora Emil Finn Gina Hugo Ida Jan".split()


def forms(text):
    """The three readings of a text, as lists, by the patterns of the operator."""
    c = regex.sub(decontam._NUMBER, "<num>", text.replace("\x02", "\x03"))
    c = regex.sub(decontam._UNIT, r"\1<unit>", c)
    c = regex.sub(decontam._TAIL, "", regex.sub(decontam._NAME, lambda m: "\x02" + m[0], c))
    readings = (regex.sub(decontam._CAPITAL, "<name>", c), c.replace("\x02", ""), regex.sub(rf"\x02[^{S}]*", "<name>", c))
    return [regex.split(f"[{S}]+", x.lower()) for x in readings]


def contaminated(doc, item):
    doc, item = (doc or "").strip(" \t\n\v\f\r"), (item or "").strip(" \t\n\v\f\r")
    if not doc or not item:
        return False
    d, i = ([regex.sub(decontam._OUTER, "", w) for w in regex.split(f"[{S}]+", x.lower())] for x in (doc, item))
    n = min(len(i), 13)
    slots = {"<num>", "<unit>", "<name>"}
    df, itf = forms(doc), forms(item)
    for v in range(3):
        dc, ic = df[v], itf[v]
        if len(i) < 13 and v != 1 and all(w in slots for w in ic):
            continue
        for at in range(-len(i) + 1, len(d)):
            run = []
            for j in range(max(0, -at), len(i) + 1):
                if j < len(i) and at + j < len(d) and any(df[u][at + j] == itf[u][j] for u in range(3)):
                    x, y = dc[at + j], ic[j]
                    run.append((x == y, x == y and x in slots, x not in slots or x == "<name>" and d[at + j] == i[j], d[at + j], i[j]))
                    continue
                windows = [w for w in (run[k : k + n] for k in range(len(run) - n + 1)) if all(same for same, *_ in w)]
                pairs = {(x, y) for _, slot, _, x, y in run if slot}
                agree = len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})
                if any(all(x == y for *_, x, y in w) or agree and sum(lit for _, _, lit, *_ in w) * 13 >= 7 * n for w in windows):
                    return True
                run = []
    return False


def question(rng):
    """A template with slots, some of them twice, and a way to fill it."""
    parts = [rng.choice(WORDS) for _ in range(26)]
    for at, slot in zip(rng.sample(range(2, 26), 6), ("{n}", "{n}", "{m}", "{a}", "{a}", "{b}"), strict=True):
        parts[at] = slot

    def fill(r):
        n, m = r.sample(range(2, 99), 2)
        a, b = r.sample(NAMES, 2)
        return " ".join(parts).format(n=n, m=m, a=a, b=b)

    return fill, parts


def both(spark, docs, items):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, items).collect()}


def test_planted_questions_are_found_and_others_are_not(spark):
    rng = random.Random(6)
    items, docs, planted = [], [], set()
    for i in range(40):
        fill, parts = question(rng)
        items.append(fill(rng))
        around = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(40))) for _ in range(2)]
        docs.append(f"{around[0]} {fill(rng)} {around[1]}")
        planted.add((len(docs) - 1, i))
        # the same template with slots that contradict each other: both places of {n} get numbers of their own
        n = iter(rng.sample(range(100, 999), 9))
        docs.append(" ".join(str(next(n)) if p in ("{n}", "{m}") else rng.choice(NAMES) if p[0] == "{" else p for p in parts))
    got = both(spark, docs, items)
    assert len(got & planted) >= 0.9 * len(planted)
    assert {d for d, _ in got - planted} <= {d for d, x in enumerate(docs) if any(contaminated(x, y) for y in items)}
    assert len({d for d, _ in got if d % 2}) <= 4  # by chance 13 words lie between the slots


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    items = [question(rng)[0](rng) for _ in range(5)] + ["Add 12 and 30 to 5 km.", "Anna", " ".join(str(k * 7 % 31) for k in range(20)), "", None]
    docs = [None, "", "Anna", "Add 14 and 31 to 6 km.", "add 12 and 30 to 5 km"]
    for _ in range(60):
        w = (rng.choice(items) or "x y z").split(" ")
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w))
            w[k] = rng.choice([str(rng.randrange(60)), rng.choice(NAMES), rng.choice(WORDS), w[k].lower(), w[k] + "."])
        lo = rng.randrange(0, max(1, len(w) - 12))
        docs.append(rng.choice(["", "So. ", "One\n"]) + rng.choice([" ", "\n", "  "]).join(w[lo:]) + rng.choice(["", " and so on", "."]))
    assert both(spark, docs, items) == {(d, i) for d, x in enumerate(docs) for i, y in enumerate(items) if contaminated(x, y)}


def test_verbatim_words_count_and_contradicting_slots_do_not(spark):
    item = "A train leaves with 40 boxes of 3 kg each and driver Anna asks how many kg remain after 40 stops on route"
    other = item.replace("40", "55").replace("3 kg", "7 kg").replace("Anna", "Berta")
    docs = [item.replace("with 40", "with 12", 1), other.replace("with 55", "with 12", 1), other, other.replace("Berta", "Anna")]
    assert {d for d, _ in both(spark, docs, [item])} == {0, 2, 3}  # 0 has 17 words of the item as they are
