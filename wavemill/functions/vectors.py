"""Vectors as arrays; arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, f) -> Column:
    """f of x with x computed once a row: an outer expression inside a lambda is computed anew for every element."""
    return F.element_at(F.transform(F.array(x), f), 1)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Null for a vector of norm 0 or of NaN."""
    return let(norm(v), lambda n: F.when((n > 0) & ~F.isnan(n), F.transform(v, lambda x: x.cast("double") / n)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def softmax(v: Column) -> Column:
    powers = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x.cast("double") - top)))
    return let(powers, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total)))


def argmax(v: Column) -> Column:
    """Zero-based place of the first maximum."""
    return F.array_position(v, F.array_max(v)) - 1


def top_k(v: Column, k: int) -> Column:
    """The k largest as structs (score, place), ties by place."""
    ranked = F.array_sort(F.transform(v, lambda x, i: F.struct((-x.cast("double")).alias("negative"), i.alias("place"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: F.struct((-s.negative).alias("score"), s.place.alias("place")))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors (array of arrays) whose mask is 1; the divisor is at least 1e-9."""
    kept = F.transform(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: F.transform(z["v"], lambda x: x.cast("double") * z["m"]))
    total = F.aggregate(F.slice(kept, 2, 1 << 30), kept[0], lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, x: s + x), F.lit(1e-9))
    return let(weight, lambda w: F.transform(total, lambda x: x / w))
