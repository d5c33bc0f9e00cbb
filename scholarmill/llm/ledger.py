"""Duplicates hidden by formatting: an incremental ledger of canonical keys.

A record's canonical key hashes its values without white space, letter case and punctuation, each in its field. The
ledger is a table of (bucket, key, count, earliest representative), a folder for each bucket; a new batch is aggregated,
joined by a full outer join to the buckets that it touches, and the counts are added. Only those are read and written.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmill.plans.stage import stage

BUCKETS = 64  #: of each source
KEY = ["source_name", "bucket", "h1", "h2"]
LEDGER = "source_name string, bucket int, h1 long, h2 long, copies long, keep_id string, last_id string"
#: A key is hot from this share of all rows on; so there are at most 1 / HOT_SHARE hot keys, whatever the data.
HOT_SHARE, HOT_LEAST = 0.005, 10_000


def plain(c: Column) -> Column:
    """Letters, digits and combining marks of a string, in lower case; null stays null."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\p{M}]+", "")


def keyed(df: DataFrame, source: str, record_id: Column, values: list[Column], buckets: int = BUCKETS) -> DataFrame:
    """(source_name, bucket, h1, h2, record_id): the 128-bit canonical key of each record.

    ``values`` are canonical strings, one for each field in a fixed order. Null agrees with null only; a value that is
    empty or has signs only agrees with such values.
    """
    canon = F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("v"), v), F.lit("n")) for v in values])
    df = df.select(record_id.cast("string").alias("record_id"), canon.alias("_canon"))
    h1 = F.xxhash64("_canon")
    return df.select(F.lit(source).alias("source_name"), F.pmod(h1, F.lit(buckets)).cast("int").alias("bucket"), h1.alias("h1"), F.xxhash64(F.lit("second"), "_canon").alias("h2"), "record_id")


def batch_counts(rows: DataFrame) -> DataFrame:
    """A batch of keyed rows in the ledger's form; partial aggregation keeps hot keys small."""
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.min("record_id").alias("keep_id"), F.max("record_id").alias("last_id"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def add_batch(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The ledger after a batch of keyed rows: counts added, the smallest id kept as representative.

    Only buckets that the batch touches are read, joined and written, as folders of a new stage table; there are at most
    BUCKETS of them for each source, so their list is small at any size. The others stay in the files that hold them.
    """
    new = stage(batch_counts(rows))
    touched = [(r[0], r[1]) for r in new.select("source_name", "bucket").distinct().collect()]
    hit = F.lit(False)
    for source in sorted({t[0] for t in touched}):
        hit = hit | ((F.col("source_name") == source) & F.col("bucket").isin(sorted(b for t, b in touched if t == source)))
    old, b = ledger.filter(hit).alias("old"), new.alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in KEY]
    pick = lambda f, c: f(F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")), F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")))
    joined = old.join(b, on, "full_outer").select(
        *[F.coalesce(F.col(f"old.{k}"), F.col(f"new.{k}")).alias(k) for k in KEY],
        (F.coalesce("old.copies", F.lit(0)) + F.coalesce("new.copies", F.lit(0))).alias("copies"),
        pick(F.least, "keep_id").alias("keep_id"),
        pick(F.greatest, "last_id").alias("last_id"),
    )
    written = stage(joined.repartition("source_name", "bucket"), partition_by=["source_name", "bucket"])
    return written.select(*ledger.columns).unionByName(ledger.filter(~hit))


def members(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """(source_name, keep_id, dup_id, copies): one row for each further record of a group; repeats of an id count once.

    ``rows`` are the keyed rows of all batches. Hot keys (at least HOT_SHARE of all rows, so at most 1 / HOT_SHARE keys)
    are found by a broadcast of that bounded list, all other keys by a shuffle, so no task receives a hot group.
    """
    groups = ledger.filter("keep_id <> last_id")
    total = ledger.agg(F.sum("copies")).first()[0] or 0
    hot_from = max(HOT_LEAST, int(total * HOT_SHARE) + 1)
    cold = groups.filter(F.col("copies") < hot_from)
    hot = groups.filter(F.col("copies") >= hot_from)
    n_hot = hot.count()
    pairs = (rows.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti") if n_hot else rows).join(cold, KEY)
    if n_hot:
        pairs = pairs.unionByName(rows.join(F.broadcast(hot), KEY))
    return pairs.filter(F.col("record_id") != F.col("keep_id")).select("source_name", "keep_id", F.col("record_id").alias("dup_id"), "copies").distinct()


RAW = "paperId string, title string, abstract string, url string, matchScore string, _corrupt string"


def corpus_keys(corpus: DataFrame) -> DataFrame:
    """Keyed rows of corpus_data: title and abstract."""
    return keyed(corpus, "corpus_data", F.col("corpus_id"), [plain(F.col("title")), plain(F.col("abstract"))])


def lookup_keys(raw: DataFrame) -> DataFrame:
    """Keyed rows of lookup_raw: the five values of the payload, matchScore as a number.

    Payloads that are no whole JSON object (cut off, null, empty) have no key. A missing field counts as null.
    """
    rec = F.from_json("payload", RAW, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    df = raw.select("raw_id", rec.alias("_r")).filter(F.col("_r").isNotNull() & F.col("_r._corrupt").isNull())
    score = F.coalesce(F.expr("try_cast(_r.matchScore AS double)").cast("string"), plain(F.col("_r.matchScore")))
    return keyed(df, "lookup_raw", F.col("raw_id"), [*(plain(F.col(f"_r.{c}")) for c in ("paperId", "title", "abstract", "url")), score])
