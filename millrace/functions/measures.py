"""Numeric functions: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stored link model (coefficients in the order of `operators.features.LINK_FEATURES`,
# intercept) and the scaler of its two scaled features (mean, scale).
COEFFICIENTS = (0.024055321670, 0.710194614363, -0.468232906109, 1.683108941514, -1.233447798907, 0.968551250297)
INTERCEPT = -0.091714266396
SCALER = {"num_hyphen": (1.902777777778, 2.076052090857), "num_slash": (1.763888888889, 1.073585057898)}


def right_closed_bin(value: Column, width: float, bins: int) -> Column:
    """k for values in ((k-1) * width, k * width], 1 to bins; null outside."""
    k = F.ceil(value / width)
    return F.when((value > 0) & (value <= width * bins), k).cast("long")


def ratio(a: Column, b: Column, default: float = -1.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def logistic(terms: list[Column], intercept: float) -> Column:
    total = F.lit(intercept)
    for t in terms:
        total = total + t
    return 1 / (1 + F.exp(-total))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0; the shorter vector is filled with zeros."""
    pad = lambda x, n: F.concat(x, F.array_repeat(F.lit(0).cast("float"), F.greatest(n - F.size(x), F.lit(0)).cast("int")))
    size = F.greatest(F.size(a), F.size(b))
    a, b = pad(a, size), pad(b, size)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def colour_distance(one: Column, two: Column) -> Column:
    """Euclidean distance of two rgb() or rgba() texts."""
    parts = [[F.regexp_extract(c, r"rgba?\((\d+),\s*(\d+),\s*(\d+)", k).try_cast("double") for k in (1, 2, 3)] for c in (one, two)]
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(*parts)), F.lit(0.0)))


def third_bins(value: Column, extent: Column, low: float, high: float) -> list[Column]:
    """One-hot position in the first, middle or last part of an extent."""
    return [(value < extent * low).cast("long"), ((value >= extent * low) & (value <= extent * high)).cast("long"), (value > extent * high).cast("long")]


def centre_distance(x1: Column, y1: Column, w1: Column, h1: Column, x2: Column, y2: Column, w2: Column, h2: Column) -> Column:
    dx, dy = (x1 + w1 / 2) - (x2 + w2 / 2), (y1 + h1 / 2) - (y2 + h2 / 2)
    return F.sqrt(dx * dx + dy * dy)


def rectangles_meet(x1: Column, y1: Column, w1: Column, h1: Column, x2: Column, y2: Column, w2: Column, h2: Column) -> Column:
    return (x1 < x2 + w2) & (x2 < x1 + w1) & (y1 < y2 + h2) & (y2 < y1 + h1)


def adjacent(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Share of the shorter of two intervals that the other covers; 0 where they don't meet."""
    overlap = F.least(a_to, b_to) - F.greatest(a_from, b_from)
    return F.greatest(F.lit(0.0), F.coalesce(F.try_divide(overlap.cast("double"), F.least(a_to - a_from, b_to - b_from).cast("double")), F.lit(0.0)))


def seam_degree(x1: Column, y1: Column, w1: Column, h1: Column, x2: Column, y2: Column, w2: Column, h2: Column) -> Column:
    """How much of a seam two rectangles share: side by side by height, one above the other by width;
    0 if they overlap, the better of the two otherwise."""
    beside = adjacent(y1, y1 + h1, y2, y2 + h2)
    stacked = adjacent(x1, x1 + w1, x2, x2 + w2)
    return F.when(rectangles_meet(x1, y1, w1, h1, x2, y2, w2, h2), F.lit(0.0)).otherwise(F.greatest(beside, stacked))


def in_box(left: Column, top: Column, width: Column, height: Column, least: tuple[float, float], most: tuple[float, float]) -> Column:
    """On the page, and within the given width and height."""
    return (left >= 0) & (top >= 0) & width.between(least[0], most[0]) & height.between(least[1], most[1])


def in_popup(style: Column, left: Column, top: Column, width: Column, height: Column, page_width: Column, page_height: Column, share: float = 0.3) -> Column:
    """Shown, positioned above the page (z-index over 0), and centred within a share of the page: 1 or 0.
    `style` is a map of style names to values."""
    of = lambda k: F.element_at(style, k)
    above = F.coalesce(of("z-index").try_cast("double") > 0, F.lit(False)) & F.coalesce(of("position").isin("fixed", "absolute"), F.lit(False))
    seen = F.coalesce(of("display") != "none", F.lit(True)) & F.coalesce(of("visibility") != "hidden", F.lit(True))
    centred = (F.abs(left + width / 2 - page_width / 2) <= page_width * share) & (F.abs(top + height / 2 - page_height / 2) <= page_height * share)
    return (above & seen & centred).cast("int")


def has_any(c: Column, words: list[str]) -> Column:
    """Whether a text has one of the words as a piece, in any case."""
    low = F.lower(c)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return F.coalesce(out, F.lit(False))


def has_token(c: Column, words: list[str]) -> Column:
    """Whether one of a text's tokens, split at white space, is one of the words."""
    return F.coalesce(F.arrays_overlap(F.split(F.lower(c), r"\s+"), F.array(*map(F.lit, words))), F.lit(False))
