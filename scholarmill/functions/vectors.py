"""Dense vectors as array columns, in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product; null where a vector is null or their lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v: Column) -> Column:
    """The unit vector; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of those vectors whose mask isn't 0; null where none is left."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda p: p["m"] != 0), lambda p: p["v"])
    total = F.aggregate(kept, F.transform(F.get(kept, F.lit(0)), lambda x: x.cast("double") * 0), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(kept))


def last_token_pool(vectors: Column, mask: Column) -> Column:
    """The vector of the last token whose mask isn't 0; null where there is none."""
    last = F.array_max(F.transform(mask, lambda m, i: F.when(m != 0, i)))
    return F.get(vectors, last)
