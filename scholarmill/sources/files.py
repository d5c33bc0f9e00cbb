"""Sources: text with unknown encoding, archives, JSON in several shapes, HTML bundles, vectors.

Nothing here makes a network call. Archives are untrusted: members with absolute or upward paths are skipped.
"""

import gzip
import io
import tarfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, else Latin-1; null for null."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def repaired(content: Column) -> Column:
    """Bytes as UTF-8 with what is invalid replaced."""
    return F.make_valid_utf8(content.cast("string"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, name, content) of the files below ``path``; files that are empty or vanish meanwhile are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def papers(spark: SparkSession, path: str) -> DataFrame:
    """(month, paper_id, rel_path, text) of a tree month/paper/files; directories that don't begin with their month are left out."""
    parts = F.split(F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{path.rstrip('/')}/", ""), "/")
    df = binary_files(spark, path).withColumn("_p", parts).filter(F.size("_p") >= 3)
    df = df.select(F.get("_p", F.lit(0)).alias("month"), F.get("_p", F.lit(1)).alias("paper_id"), F.array_join(F.slice("_p", 3, 1000), "/").alias("rel_path"), decoded(F.col("content")).alias("text"))
    return df.filter(F.col("paper_id").startswith(F.col("month")))


def safe(name: str) -> bool:
    """Whether a member's path stays inside the archive."""
    p = PurePosixPath(name)
    return not p.is_absolute() and ".." not in p.parts and "\\" not in name and bool(p.parts)


def unpack(content: bytes, name: str, limit: int, depth: int = 3) -> Iterator[tuple[str, bytes | None, str]]:
    """(path, content, status) of the files in a tar, gzip or both, nested up to ``depth``; other content is one file.

    A member larger than ``limit`` bytes has status "too large" and no content, one with an unsafe path "unsafe path";
    what can't be read is "unreadable".
    """
    try:
        if content[:2] == b"\x1f\x8b" and depth:
            with gzip.open(io.BytesIO(content)) as f:
                inner = f.read(limit + 1)
            if len(inner) > limit:
                yield name, None, "too large"
                return
            yield from unpack(inner, name.removesuffix(".gz").removesuffix(".tgz"), limit, depth - 1)
            return
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:") as tar:
            for m in tar:
                if not m.isfile():
                    continue
                path = f"{name.removesuffix('.tar')}/{m.name}"
                if not safe(m.name):
                    yield path, None, "unsafe path"
                elif m.size > limit:
                    yield path, None, "too large"
                else:
                    inner = tar.extractfile(m).read()
                    if m.name.endswith((".gz", ".tar", ".tgz")) and depth:
                        yield from unpack(inner, path, limit, depth - 1)
                    else:
                        yield path, inner, "ok"
    except tarfile.ReadError:
        yield (name, content, "ok") if content else (name, None, "unreadable")
    except (OSError, EOFError, gzip.zlib.error):
        yield name, None, "unreadable"


def archives(files: DataFrame, allowed: DataFrame | None = None, done: DataFrame | None = None, limit: int = 1 << 28) -> DataFrame:
    """(name, member, content, status) of the files in archives.

    ``allowed`` and ``done`` have a column name: archives that aren't allowed or are done already are dropped by name
    before anything is unpacked.
    """
    if allowed is not None:
        files = files.join(allowed.select("name").distinct(), "name", "left_semi")
    if done is not None:
        files = files.join(done.select("name").distinct(), "name", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(name, *r) for r in unpack(content or b"", name, limit)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.binary(), pa.string()))], names=["name", "member", "content", "status"])

    return files.select("name", "content").mapInArrow(run, "name string, member string, content binary, status string")


def flatten(tex: DataFrame) -> DataFrame:
    r"""(paper_id, full_tex, n_main): each paper's longest main file with its \input and \include expanded.

    ``tex`` is (paper_id, rel_path, text). A main file is a top-level .tex with \documentclass; of equally long ones the
    first by path wins. A file is included once for each root, paths are relative to the including file, unresolved and
    circular commands stay as they are. Papers without a main file have no row. A paper's files meet in one task.
    """
    import re

    command = re.compile(r"\\(?:input|include)\s*\{([^{}]+)\}")

    def expand(path: str, files: dict[str, str], seen: set[str]) -> str:
        def one(m: re.Match) -> str:
            base = path.rpartition("/")[0]
            target = m[1].strip() if m[1].strip().endswith(".tex") else m[1].strip() + ".tex"
            full = f"{base}/{target}" if base else target
            if not safe(full) or full not in files or full in seen:
                return m[0]
            seen.add(full)
            return expand(full, files, seen)

        return command.sub(one, files[path])

    def run(table: pa.Table) -> pa.Table:
        files = dict(sorted((p, t or "") for p, t in zip(table.column("rel_path").to_pylist(), table.column("text").to_pylist()) if p))
        roots = [p for p, t in files.items() if "/" not in p and p.endswith(".tex") and "\\documentclass" in t]
        full = [expand(p, files, {p}) for p in roots]
        best = max(full, key=len, default=None)
        ids = table.column("paper_id").to_pylist()[:1]
        rows = {"paper_id": ids, "full_tex": [best], "n_main": [len(roots)]}
        return pa.table({k: pa.array(v if best is not None else [], kind) for (k, v), kind in zip(rows.items(), (pa.string(), pa.string(), pa.int32()))})

    return tex.select("paper_id", "rel_path", "text").groupBy("paper_id").applyInArrow(run, "paper_id string, full_tex string, n_main int")


def merged_files(files: DataFrame, suffix: str) -> DataFrame:
    """(paper_id, merged): files of a suffix under headers with their names, in path order."""
    part = F.concat(F.lit("% From file: "), "rel_path", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    df = files.filter(F.col("rel_path").endswith(suffix)).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("rel_path", part.alias("p")))).alias("x"))
    return df.select("paper_id", F.array_join(F.transform("x", lambda e: e.p), "\n").alias("merged"))


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, glob: str | None = None) -> DataFrame:
    """JSON lines with a given schema, never inferred; broken lines are in _corrupt_record where the schema has it."""
    reader = spark.read.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).json(path)


def json_object(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value, source_file) of files that hold one JSON object each: {key: value}; ``value`` is a DDL type."""
    df = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("m"), F.input_file_name().alias("source_file"))
    return df.select(F.explode("m").alias("key", "value"), "source_file")


def json_arrays(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Lines that are JSON arrays, as string columns."""
    a = F.from_json("value", "array<string>")
    return spark.read.text(path).select(a.alias("a")).filter(F.col("a").isNotNull()).select(*[F.get("a", F.lit(i)).alias(n) for i, n in enumerate(names)])


def html_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(name, content_b64) of the HTML files below ``path``; of equal names the last path counts."""
    df = binary_files(spark, path, "*.html")
    last = df.groupBy("name").agg(F.max_by("content", "path").alias("content"))
    return last.select("name", F.regexp_replace(F.base64("content"), r"[\r\n]", "").alias("content_b64"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vector shards, with source_file; unreadable ones are skipped, none at all is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no vector shards at {path}")
    return spark.read.option("ignoreCorruptFiles", "true").parquet(path).withColumn("source_file", F.input_file_name())


def looked_up(worklist: DataFrame, key: str, lookup: Callable[[list[str]], list[str | None]] | None, batch: int = 10, parallel: int = 1) -> DataFrame:
    """(key, payload, message) from a caller's lookup, called for ``batch`` keys at a time on ``parallel`` tasks; off without one.

    Where the lookup raises, or its answer has another length, the batch has null payloads and a message that says so; a
    key that it doesn't know has neither.
    """
    if lookup is None:
        return worklist.select(key, *[F.lit(None).cast("string").alias(c) for c in ("payload", "message")]).limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_pylist()
            out: list[tuple[str | None, str | None]] = []
            for i in range(0, len(keys), batch):
                part = keys[i : i + batch]
                try:
                    got, message = lookup(part), None
                    if len(got) != len(part):
                        got, message = [None] * len(part), f"{len(got)} answers to {len(part)} keys"
                except Exception as error:  # whatever a caller's lookup raises
                    got, message = [None] * len(part), f"{type(error).__name__}: {error}"
                out += [(g, message) for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[k] for o in out], pa.string()) for k in (0, 1))], names=[key, "payload", "message"])

    return worklist.select(key).filter(F.col(key).isNotNull()).distinct().repartition(parallel).mapInArrow(run, f"`{key}` string, payload string, message string")


def scored(pairs: DataFrame, key: str, left: str, right: str, scorer: Callable[[list[tuple[str, str]]], list[float]]) -> DataFrame:
    """(key, score) of pairs of texts by a caller's cross-encoder, a batch at a time; null texts are scored as empty ones."""
    kind = dict(pairs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = scorer([(x or "", y or "") for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=[key, "score"])

    return pairs.select(key, left, right).mapInArrow(run, f"`{key}` {kind}, score double")


def generated(prompts: DataFrame, key: str, prompt: str, model: Callable[[list[str]], list[tuple[str, list[float]]]]) -> DataFrame:
    """(key, answer, hidden) by a caller's generator: its text and the hidden state at its end, a batch at a time.

    Null prompts give a null answer and are not sent.
    """
    kind = dict(prompts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(1).to_pylist()
            got = iter(model([p for p in asked if p is not None]) if any(p is not None for p in asked) else [])
            out = [next(got) if p is not None else (None, None) for p in asked]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.float32()))], names=[key, "answer", "hidden"])

    return prompts.select(key, prompt).mapInArrow(run, f"`{key}` {kind}, answer string, hidden array<float>")


def split_samples(text: Column) -> Column:
    """The samples of a collection that stand apart by at least two blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\n\n\n+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def encoded(df: DataFrame, key: str, text: str, encoder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(key, embedding) by a caller's encoder, a batch at a time; null texts are encoded as empty ones."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = encoder([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=[key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<float>")
