"""List functions: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def deep_flatten(c: Column, depth: int) -> Column:
    """The elements of lists nested `depth` levels below the outer one, in order; null lists are left out."""
    for _ in range(depth):
        c = F.flatten(F.filter(c, lambda x: x.isNotNull()))
    return c


def tuples(c: Column, n: int, fill: Column) -> Column:
    """A list cut into lists of `n` elements, the last one filled up with `fill`."""
    padded = F.concat(c, F.array_repeat(fill, F.pmod(-F.size(c), F.lit(n)).cast("int")))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(padded), F.lit(1)), F.lit(n)), lambda k: k <= F.size(padded))
    return F.transform(starts, lambda k: F.slice(padded, k, n))


def random_subarray(c: Column, n: int, seed: int = 0) -> Column:
    """`n` elements of a list of strings without replacement, all if it has fewer; the same in each run: in the
    order of the digests of seed, position and element."""
    keyed = F.transform(c, lambda x, k: F.struct(F.md5(F.concat_ws("|", F.lit(seed), k, x)).alias("key"), k.alias("at"), x.alias("x")))
    return F.slice(F.transform(F.array_sort(keyed), lambda s: s["x"]), 1, n)
