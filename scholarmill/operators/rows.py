"""Operators on rows: first and last of a key, running numbers, batches, hash samples and splits, merges of sources."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarmill.plans.stage import stage


def _one(df: DataFrame, keys: Sequence[str], order: Sequence[Column], pick) -> DataFrame:
    """One row of each key, by an aggregate: partial results keep a hot key small before the shuffle."""
    whole = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*df.columns).alias("_row"))
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(pick(whole).alias("_best")).select("_best._row.*")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The earliest row of each key by ``order``, ties by all columns; rows of a null key are a group of their own.

    Map columns can't be ordered; all others, nested ones too, can.
    """
    return _one(df, keys, [F.col(c) for c in order], F.min)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest row of each key by ``order``."""
    return _one(df, keys, [F.col(c) for c in order], F.max)


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """Running numbers from 1 in ``order``, without one task that sees all rows.

    Rows are range-partitioned and sorted, each partition counts, and the offsets (one number a partition) are added.
    The order must be total for the numbers to be reproducible.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stage(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy("_part").count().collect())
    offset, at = {}, 0
    for part, n in sizes:
        offset[part], at = at, at + n
    if not sizes:
        return ranged.drop("_part").withColumn(name, F.lit(None).cast("long"))
    base = F.element_at(F.create_map(*[F.lit(x) for p in offset.items() for x in p]), F.col("_part"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(name, (base + own).cast("long")).drop("_part")


def batches_of(df: DataFrame, order: Sequence[Column], size: int, name: str = "batch") -> DataFrame:
    """Batches of ``size`` rows in order, numbered from 0."""
    return number_rows(df, order, "_no").withColumn(name, F.floor((F.col("_no") - 1) / size)).drop("_no")


def split_into(df: DataFrame, order: Sequence[Column], n: int, name: str = "part") -> DataFrame:
    """``n`` contiguous parts of equal size but the last, as a division by the rounded-up size gives them."""
    df = number_rows(df, order, "_no")
    size = max(1, -(-df.count() // n))
    return df.withColumn(name, F.floor((F.col("_no") - 1) / size)).drop("_no")


def batches_by_bytes(df: DataFrame, order: Sequence[Column], text: str, limit: int, name: str = "batch") -> DataFrame:
    """Contiguous batches of about ``limit`` bytes: a row belongs to the batch in which its first byte lies.

    Rows that tie in ``order`` stay together. Running sums are made over keys and sizes only, in each range partition, and
    offset by the sums of those before it; texts are joined to their batch at the end.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    keys = [f"_o{i}" for i in range(len(order))]
    sized = keyed.groupBy(*keys).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).alias("_size"))
    ranged = stage(sized.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    sums = sorted((r[0], r[1]) for r in ranged.groupBy("_part").agg(F.sum("_size")).collect())
    pairs, at = [], 0
    for part, n in sums:
        pairs += [F.lit(part), F.lit(at)]
        at += n
    base = F.element_at(F.create_map(*pairs), F.col("_part")) if pairs else F.lit(0)
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = ranged.select(*[F.col(k).alias(f"{k}_") for k in keys], F.floor((base + before) / limit).alias(name))
    return keyed.join(found, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])).select(*df.columns, name)


def hash_order(seed: str, *columns: Column) -> Column:
    """A reproducible random order: the MD5 of the seed and the columns as text."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in columns]))


def take_by_hash(df: DataFrame, n: int, seed: str, *columns: Column) -> DataFrame:
    """``n`` rows in hash order; each task keeps its own ``n`` only."""
    return df.orderBy(hash_order(seed, *columns), *columns).limit(n)


def pick_items(items: Column, n: int, seed: str, key: Column) -> Column:
    """``n`` positions (from 0) of an array in hash order, ascending; all where there are no more."""
    hashed = F.transform(items, lambda x, i: F.struct(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"), i.cast("string"))).alias("h"), i.alias("i")))
    return F.array_sort(F.transform(F.slice(F.array_sort(hashed), 1, n), lambda s: s.i))


def merge_sources(primary: DataFrame, secondary: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """All rows of ``primary``; where a column is null there, the one row of ``secondary`` with the key gives it."""
    other = secondary.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    keep = [c for c in primary.columns if c not in columns]
    return primary.join(other, key, "left").select(*keep, *[F.coalesce(c, f"_{c}").alias(c) for c in columns])


def cascade(rows: DataFrame, steps: Sequence[tuple[str, DataFrame, str]], value: str) -> DataFrame:
    """Resolve rows through lookups in order: each step sees only what the steps before it left.

    A step is (name, lookup, key): lookup has one row of each key with the column ``value``. The result has the columns
    of ``rows``, ``value`` and ``resolved_by``, both null for what no step resolves. A null key or value resolves nothing.
    """
    kind = dict(steps[0][1].dtypes)[value]
    out = rows.withColumn("_value", F.lit(None).cast(kind)).withColumn("_by", F.lit(None).cast("string"))
    spread = F.xxhash64(*rows.columns).cast("string")
    for name, lookup, key in steps:
        # rows that are resolved or have no key meet nothing: they get a key of their own, so they spread over all tasks
        open_key = F.when(F.col("_value").isNull(), F.col(key).cast("string"))
        own = F.coalesce(F.concat(F.lit("k"), open_key), F.concat(F.lit("-"), spread))
        other = lookup.filter(F.col(key).isNotNull()).select(F.concat(F.lit("k"), F.col(key).cast("string")).alias("_key"), F.col(value).alias("_new"))
        out = out.withColumn("_key", own).join(other, "_key", "left")
        out = out.withColumn("_by", F.coalesce("_by", F.when(F.col("_new").isNotNull(), name))).withColumn("_value", F.coalesce("_value", "_new")).drop("_key", "_new")
    return out.select(*rows.columns, F.col("_value").alias(value), F.col("_by").alias("resolved_by"))


def identify(rows: DataFrame, key: str, source: str, order: Sequence[Column], name: str = "corpus_id") -> DataFrame:
    """Dense ids: the first row of each key by ``order`` numbers it, prefixed by that row's source; repeats inherit it."""
    first = first_wins(rows.withColumn("_pos", F.struct(*order)), [key], ["_pos"]).select(key, F.col(source).alias("_source"), "_pos")
    numbered = number_rows(first, [F.col("_pos"), F.col(key)], "_n")
    return rows.join(numbered.select(key, F.concat(F.when(F.col("_source") == "arxiv", "arxiv-").otherwise("ss-"), (F.col("_n") - 1).cast("string")).alias(name)), key)
