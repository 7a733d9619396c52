"""Column expressions: coordinates, bins, hashes, recoding and terrain transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_xy(row: Column, col: Column, affine: Sequence[float]) -> tuple[Column, Column]:
    """Integer coordinates of a pixel's corner by (ul_x, x_res, 0, ul_y, 0, y_res)."""
    return (F.lit(affine[0]) + col * F.lit(affine[1])).cast("int"), (F.lit(affine[3]) + row * F.lit(affine[5])).cast("int")


def to_row_col(x: Column, y: Column, affine: Sequence[float]) -> tuple[Column, Column]:
    """Pixel of a coordinate, truncated toward zero."""
    return ((y - affine[3]) / affine[5]).cast("int"), ((x - affine[0]) / affine[1]).cast("int")


def floor_mod(value: Column, by: float) -> Column:
    """A remainder with the sign of ``by``."""
    return F.pmod(value, F.lit(by)) if by > 0 else -F.pmod(-value, F.lit(-by))


def snapped(value: Column, onto: float, resolution: float) -> Column:
    """``value`` moved onto the grid that ``onto`` lies on."""
    remainder = onto % resolution
    return value + F.lit(remainder) - floor_mod(value, resolution)


def in_bin(value: Column, low, high) -> Column:
    """(low, high]."""
    return (value > low) & (value <= high)


def bin_number(value: Column, edges: Sequence[tuple[float, float]]) -> Column:
    """Number of the first bin (low, high] that holds the value, null if none does."""
    out = None
    for k, (low, high) in enumerate(edges):
        out = F.when(in_bin(value, low, high), k) if out is None else out.when(in_bin(value, low, high), k)
    return out.cast("int")


def low_product(key: Column, factor: int) -> Column:
    """The low 32 bits of a number's low 32 bits times a factor below 2 ** 32, by halves so that nothing overflows."""
    low = key.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.pmod(F.pmod(F.floor(low / 65536) * factor, F.lit(65536)) * 65536 + low % 65536 * factor, F.lit(4294967296))


def portable_hash(key: Column, seed: int) -> Column:
    """Two rounds of multiplication modulo 2 ** 32, the same in any engine with 64-bit integers; for all whole keys of 64 bits.

    The upper 32 bits enter by a factor of their own, so keys below 2 ** 32 hash as by (key * 2654435761 + seed * 40503)
    alone. Null keys give null.
    """
    key = key.cast("bigint")
    upper = F.shiftrightunsigned(key, 32)
    once = F.pmod(low_product(key, 2654435761) + low_product(upper, 2246822519) + seed * 40503, F.lit(4294967296))
    return F.pmod(once * 1597334677 + 12345, F.lit(4294967296))


def recoded(value: Column, pairs: dict, inverse: bool = False) -> Column:
    """Values by a table or its inverse; others pass through."""
    table = {v: k for k, v in pairs.items()} if inverse else pairs
    entries = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.element_at(entries, value), value)


def cosine_aspect(aspect: Column, turn: float) -> Column:
    """100 (cos(aspect - turn) + 1) truncated to whole units, from 0 to 200; degrees."""
    return (100 * (F.cos(F.radians(aspect - turn)) + 1)).cast("smallint")


def aspect_intensity(slope: Column, aspect: Column, facing: float, degrees_per_radian: float = 57.29578) -> Column:
    """sin(slope) cos(aspect - facing); ``facing`` is taken in radians as given."""
    return F.sin(slope / degrees_per_radian) * F.cos(aspect / degrees_per_radian - facing)


def gaussian_weight(value: Column, centre: float, width: float, height: float = 1.0) -> Column:
    """(height e) ** -((value - centre) ** 2 / (2 width ** 2))."""
    return F.pow(F.lit(height * 2.718281828459045), -F.pow(value - centre, F.lit(2)) / (2 * width * width))


def percent_error(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, b) * 100


def four_digits(value: Column) -> Column:
    """A path/row or tile id padded to its last four digits."""
    return F.right(F.concat(F.lit("0000"), value.cast("string")), F.lit(4))


def six_digits(value: Column) -> Column:
    """Four or five digits as three of path and three of row."""
    text = value.cast("string")
    split = F.when(F.length(text) == 5, 3).otherwise(2)
    return F.concat(F.lpad(F.substr(text, F.lit(1), split), 3, "0"), F.lpad(F.substr(text, split + 1), 3, "0"))


def text_accuracy(text: Column) -> Column:
    """The accuracy that a sentence states, in percent: fractions times 100, errors taken from 100, several averaged."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1), lambda x: x.cast("double"))
    percents = F.transform(numbers, lambda x: F.when(x < 1, x * 100).otherwise(x))
    mean = F.when(F.size(percents) > 0, F.aggregate(percents, F.lit(0.0), lambda a, x: a + x) / F.size(percents))
    return F.when(F.contains(F.lower(text), F.lit("error")), 100 - mean).otherwise(mean)


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean over columns that aren't null."""
    values = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def row_metrics(columns: Sequence[Column], equal=None, between: tuple[float, float] | None = None) -> dict[str, Column]:
    """Metrics over the columns of a row by name, nulls left out: mean, median, stdev, max, min, num_pix_with_data, num_pix_equal, num_pix_between [low, high) and mid_pix (the middle column)."""
    every = F.array(*[c.cast("double") for c in columns])
    held = F.array_sort(F.filter(every, lambda x: x.isNotNull()))
    n = F.size(held)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(n > 0, total(held) / n)
    out = {"mean": mean, "max": F.array_max(held), "min": F.array_min(held), "num_pix_with_data": n, "mid_pix": every[len(columns) // 2]}
    out["median"] = F.when(n > 0, (F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2)
    out["stdev"] = F.when(n > 0, F.sqrt(total(F.transform(held, lambda x: (x - mean) * (x - mean))) / n))
    if equal is not None:
        out["num_pix_equal"] = F.size(F.filter(held, lambda x: x == equal))
    if between is not None:
        out["num_pix_between"] = F.size(F.filter(held, lambda x: (x >= between[0]) & (x < between[1])))
    return out


def kernel_sums(columns: Sequence[str], prefixes: Sequence[str]) -> list[Column]:
    """Sums over maps of the columns that name the same kernel: <prefix>_<kernel> for each prefix, as sum_<prefixes>_<kernel>."""
    kernels = [c[len(prefixes[0]) :].strip("_") for c in columns if c.startswith(prefixes[0])]
    for p in prefixes:
        if [c[len(p) :].strip("_") for c in columns if c.startswith(p)] != kernels:
            raise ValueError(f"the columns of {p} name other kernels than those of {prefixes[0]}")
    return [sum((F.col(f"{p}_{k}") for p in prefixes[1:]), F.col(f"{prefixes[0]}_{k}")).alias("_".join(["sum", *prefixes, k])) for k in kernels]


def starting_with(columns: Sequence[str], prefix: str) -> list[str]:
    """Column names by prefix, in order of name."""
    return sorted(c for c in columns if c.startswith(prefix))


#: First years of composites by era (before 1999, from then on) and length of an epoch in years.
FIRST_YEARS = {("early", 3): 1986, ("early", 4): 1987, ("early", 5): 1988, ("early", 6): 1989, ("late", 1): 2000, ("late", 2): 2001, ("late", 3): 2001, ("late", 4): 2003}
LAST_EPOCHS = {("early", 3): 5, ("early", 4): 4, ("early", 5): 3, ("early", 6): 2, ("late", 1): 19, ("late", 2): 9, ("late", 3): 6, ("late", 4): 4}


def epoch_year(index: Column, length: int, start_year: int) -> Column:
    """The year of an epoch's index; indices beyond the era's table pass through."""
    era = "early" if start_year < 1999 else "late", length
    if era not in FIRST_YEARS:
        return index
    return F.when(index.between(0, LAST_EPOCHS[era]), F.lit(FIRST_YEARS[era]) + length * index).otherwise(index)


OPERATORS = ("<=", ">=", "<", ">")


def drop_rule(text: str, metrics: Sequence[str], drop_value: int = 0) -> tuple[str, str, int, bool]:
    """(metric, operator, value, understood) of a rule ``<metric> <operator> <integer>``; a malformed one means the first metric below ``drop_value``."""
    found = [o for o in OPERATORS if o in text]
    found = [o for o in found if not any(o != p and o in p for p in found)]
    if len(found) == 1:
        operands = [s.strip() for s in text.split(found[0])]
        if len(operands) == 2 and operands[0] in metrics and operands[1].lstrip("+-").isdigit():
            return operands[0], found[0], int(operands[1]), True
    return metrics[0], "<", drop_value, False


def dropped(rule: tuple[str, str, int, bool]) -> Column:
    metric, operator, value, _ = rule
    return {"<": F.col(metric) < value, ">": F.col(metric) > value, "<=": F.col(metric) <= value, ">=": F.col(metric) >= value}[operator]


def constants(text: Column) -> Column:
    """``K:V,K:V`` as an array of (key, value)."""
    return F.transform(F.split(text, ","), lambda p: F.struct(F.trim(F.split(p, ":")[0]).alias("key"), F.trim(F.split(p, ":")[1]).alias("value")))


def ring_area(ring: Column) -> Column:
    """The area of a closed ring ARRAY<STRUCT<x, y>>."""
    ends = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(ends, F.lit(0.0), lambda s, x: s + x)) / 2


def half_even(value: Column) -> Column:
    return F.bround(value, 0).cast("int")
