"""Sinks: JSON lines, batches, compressed shards, HTML files, BibTeX history."""

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarmill.sources.files import safe


def write_json_lines(df: DataFrame, path: str, rows_per_file: int | None = None, compression: str | None = None) -> None:
    """One JSON object a line; null fields are left out. Files hold at most ``rows_per_file`` rows."""
    writer = df.write.mode("errorifexists")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if compression:
        writer = writer.option("compression", compression)
    writer.json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors as Parquet."""
    df.write.mode("errorifexists").parquet(path)


def merge_shards(df: DataFrame, path: str, order: str) -> None:
    """All rows in one ordered file, for exports that are small by nature."""
    df.orderBy(order).coalesce(1).write.mode("errorifexists").json(path)


def side_files(files: DataFrame, root: str) -> DataFrame:
    """Write (path, content) below the shared folder ``root``, a file each; (path, n_bytes) of what was written.

    ``content`` is text or bytes, an empty one makes a mark such as "done". Paths that lead out of the folder, null ones
    and null contents are left out. The folder must be a mounted one that all executors share; a store of another kind is an error.
    """
    import pyarrow as pa

    root = root.removeprefix("file://")
    if "://" in root:
        raise ValueError(f"files can't be written one by one to {root}")

    def run(batches):
        for b in batches:
            paths, sizes = [], []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not safe(path):
                    continue
                at = Path(root) / path
                at.parent.mkdir(parents=True, exist_ok=True)
                at.write_bytes(content)
                paths.append(path)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "n_bytes"])

    return files.filter(F.col("path").isNotNull() & F.col("content").isNotNull()).select("path", F.col("content").cast("binary")).mapInArrow(run, "path string, n_bytes bigint")


def restore_html(bundle: DataFrame, path: str) -> DataFrame:
    """Write the pages of (name, content_b64) below the shared folder ``path``; (name, n_bytes) of what was written.

    Only the last part of a name is used; rows with a null name or content are left out.
    """
    name = F.element_at(F.split("name", "/"), -1)
    return side_files(bundle.select(name.alias("path"), F.unbase64("content_b64").alias("content")), path).withColumnRenamed("path", "name")


def merge_sorted(df: DataFrame, path: str, order: str, compression: str = "gzip") -> None:
    """All rows as compressed JSON lines in order over the names of the files, made by range, so that no task sees them all."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.mode("errorifexists").option("compression", compression).json(path)


def history_file(entries: DataFrame, entry: str, order: str, when: str, session: str | None = None) -> DataFrame:
    """(content), or (session, content) of each session: distinct entries in first-seen order below a header with the given
    time and their number. A session's history is one file, so its entries meet in one row."""
    keys = [session] if session else []
    first = entries.filter(F.col(entry).isNotNull()).groupBy(*keys, entry).agg(F.min(order).alias("_o"))
    joined = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("_o", entry))).alias("x"))
    content = F.concat(F.lit(f"% Exported {when}, "), F.col("n").cast("string"), F.lit(" entries\n\n"), F.array_join(F.transform("x", lambda e: e[entry]), "\n\n"))
    return joined.select(*keys, content.alias("content"))
