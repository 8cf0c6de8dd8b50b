"""Column expressions on quantized vectors, sketches and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize(e: Column, factor: float) -> Column:
    """float32 product, truncated toward zero, clipped to +-127."""
    f = F.lit(factor).cast("float")
    return F.transform(e.cast("array<float>"), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), (x * f).cast("int"))))


def overflow(e: Column, factor: float) -> Column:
    f = F.lit(factor).cast("float")
    return F.size(F.filter(e.cast("array<float>"), lambda x: F.abs((x * f).cast("int")) > 127))


def total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def l2sq(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def l2sq_part(a: Column, b: Column, start: int, size: int) -> Column:
    return l2sq(F.slice(a, start + 1, size), F.slice(b, start + 1, size))


def l2sq_sparse(a: Column, b: Column, axes: list[int]) -> Column:
    pick = F.array(*map(F.lit, axes))
    return total(F.transform(pick, lambda j: (F.get(a, j) - F.get(b, j)) * (F.get(a, j) - F.get(b, j))))


def squared(v: Column) -> Column:
    """Elements that were stored as roots, for the distances above: the squares of both sides are compared."""
    return F.transform(v, lambda x: x * x)


def l2sq_pivot(v: Column, c: Column, axes: list[int] | None = None, start: int = 0, size: int | None = None) -> Column:
    """Only axes at which the pivot is at an extreme; and of these only the listed ones, or those of a range."""
    v, c = (v, c) if size is None else (F.slice(v, start + 1, size), F.slice(c, start + 1, size))
    if axes is not None:
        v, c = rotate(v, axes), rotate(c, axes)
    return total(F.zip_with(v, c, lambda x, y: F.when(F.abs(y) == 127, (x - y) * (x - y)).otherwise(0)))


def rotate(v: Column, order: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, order)), lambda i: F.get(v, i))


def array(values: list, kind: str = "double") -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def bits(mask: str, values: str, w: int, how: str = "+") -> Column:
    """Sum (or maximum) of values[p] over the set bits p of a mask."""
    step = f"a + cast({values}[p] AS long)" if how == "+" else f"greatest(a, cast({values}[p] AS long))"
    return F.expr(f"aggregate(sequence(0, {w - 1}), 0L, (a, p) -> if(getbit({mask}, p) = 1, {step}, a))")


def permuted(mask: str, rank: str, w: int) -> Column:
    """The mask with bit p moved to the rank of p."""
    return F.expr(f"aggregate(sequence(0, {w - 1}), 0L, (a, p) -> if(getbit({mask}, p) = 1, a + shiftleft(1L, {rank}[p]), a))")


def inverse_gray(x: Column, w: int) -> Column:
    out = x
    for s in range(1, w):
        out = out.bitwiseXOR(F.shiftright(x, s))
    return out


def has_bit(mask: Column, p: int) -> Column:
    return F.shiftright(mask, p).bitwiseAND(F.lit(1).cast("long")) == 1


def with_bit(mask: Column, p: int, on: bool = True) -> Column:
    bit = F.lit(1 << p).cast("long")
    return mask.bitwiseOR(bit) if on else mask.bitwiseAND(F.bitwise_not(bit))


def intervals(positions: Column) -> Column:
    """Ascending numbers as runs (first, count) without gaps."""
    start = F.filter(F.transform(positions, lambda x, i: F.when((i == 0) | (F.get(positions, i - 1) != x - 1), x)), lambda x: x.isNotNull())
    nxt = lambda i: F.coalesce(F.array_position(positions, F.get(start, i + 1)).cast("long"), F.size(positions).cast("long") + 1)
    return F.transform(start, lambda s, i: F.struct(s.alias("first"), (nxt(i) - F.array_position(positions, s)).alias("count")))


def folded(table: str, widths: list[int], byte: int = 8) -> Column:
    """The distance tables of several codes that are packed in one byte, summed for each value of the byte.

    ``table`` holds for each part an array by code; ``widths`` the bits of each part's codes.  The parts that fit a byte
    together are folded, the first code highest; a query's distance is then one look-up for each byte.
    """
    groups, used = [[]], 0
    for p, b in enumerate(widths):
        if used + b > byte:
            groups.append([])
            used = 0
        groups[-1].append(p)
        used += b
    out = []
    for parts in groups:
        terms, shift = [], 0
        for p in reversed(parts):
            terms.append(f"{table}[{p}][shiftright(v, {shift}) & {(1 << widths[p]) - 1}]")
            shift += widths[p]
        out.append(f"transform(sequence(0, {(1 << shift) - 1}), v -> {' + '.join(terms)})")
    return F.expr(f"array({', '.join(out)})")


def pack_mixed(codes: str, widths: list[int], byte: int = 8) -> Column:
    """Codes of differing widths to bytes, in the groups of ``folded``."""
    groups, used = [[]], 0
    for p, b in enumerate(widths):
        if used + b > byte:
            groups.append([])
            used = 0
        groups[-1].append(p)
        used += b
    out = []
    for parts in groups:
        value = "0"
        for p in parts:
            value = f"(shiftleft({value}, {widths[p]}) | {codes}[{p}])"
        out.append(value)
    return F.expr(f"array({', '.join(out)})")


def folded_distance(packed: str, tables: str) -> Column:
    return F.expr(f"aggregate(transform({packed}, (v, g) -> {tables}[g][v]), 0L, (a, x) -> a + x)")


def pack(codes: str, bits_: int) -> Column:
    """Codes to bytes, the first code highest; the last byte is right-aligned."""
    per = 8 // bits_
    return F.expr(f"transform(sequence(0, (size({codes}) - 1) div {per}), i -> aggregate(slice({codes}, i * {per} + 1, {per}), 0, (a, c) -> shiftleft(a, {bits_}) | c))")


def unpack(packed: str, bits_: int, n: int) -> Column:
    per = 8 // bits_
    return F.expr(f"transform(sequence(0, {n - 1}), j -> shiftright({packed}[j div {per}], {bits_} * (least({per}, {n} - (j div {per}) * {per}) - 1 - j % {per})) & {(1 << bits_) - 1})")
