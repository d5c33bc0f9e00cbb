"""Queries of sources, sinks and streams, over files that are written from the tables into the shared folder."""

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmill.plans.registry import query
from scholarmill.plans.stage import place, stage
from scholarmill.sources import files, sinks
from scholarmill.sources.tables import table
from scholarmill.streaming import worklists


@query("SELECT DISTINCT row_id, arxiv_id, split, source, md5(paper) AS paper_md5 FROM train_rows")
def json_lines_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """SC-7, SC-10, SC-13, SK-1, SK-6: rows as compressed JSON lines and back, by the files with the suffix."""
    at = place(spark, "lines")
    df = table(spark, d, "train_rows").select("row_id", "arxiv_id", "split", "source", "paper").distinct()
    sinks.write_json_lines(df, at, rows_per_file=1000, compression="gzip")
    return files.json_lines(spark, at, df.schema, glob="*.json.gz").select("row_id", "arxiv_id", "split", "source", F.md5("paper").alias("paper_md5"))


@query("SELECT arxiv_id AS key, min(title) AS title FROM arxiv_metadata WHERE title IS NOT NULL AND arxiv_id IS NOT NULL GROUP BY 1")
def json_object_scan(spark: SparkSession, d: str) -> DataFrame:
    """SC-8: files of one JSON object each, {id: {title}}, as a table of their keys."""
    at = place(spark, "objects")
    df = table(spark, d, "arxiv_metadata").filter("title is not null and arxiv_id is not null").groupBy("arxiv_id").agg(F.min("title").alias("title"))
    objects = df.groupBy(F.substring("arxiv_id", 1, 4)).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("arxiv_id", F.struct("title"))))).alias("value"))
    objects.select("value").write.option("maxRecordsPerFile", 1).text(at)
    return files.json_object(spark, at, "struct<title:string>").select("key", "value.title")


@query("SELECT DISTINCT corpus_id, title, md5(abstract) AS abstract_md5 FROM corpus_data WHERE corpus_id IS NOT NULL")
def json_arrays_scan(spark: SparkSession, d: str) -> DataFrame:
    """SC-9: lines that are JSON arrays."""
    at = place(spark, "arrays")
    table(spark, d, "corpus_data").filter("corpus_id is not null").select("corpus_id", "title", "abstract").distinct().select(F.to_json(F.array("corpus_id", "title", "abstract"))).write.text(at)
    return files.json_arrays(spark, at, ["corpus_id", "title", "abstract"]).select("corpus_id", "title", F.md5("abstract").alias("abstract_md5"))


@query("SELECT vec_id, embedding[1] AS first, len(embedding) AS n FROM embeddings WHERE embedding IS NOT NULL")
def vector_shards(spark: SparkSession, d: str) -> DataFrame:
    """SC-11, SK-10: vectors written as shards and read again."""
    at = place(spark, "vectors")
    sinks.write_vectors(table(spark, d, "embeddings").filter("embedding is not null"), at)
    return files.vectors(spark, at).select("vec_id", F.get("embedding", F.lit(0)).alias("first"), F.size("embedding").cast("long").alias("n"))


@query("SELECT id || '.html' AS name, md5(min(title || chr(10) || bibtex)) AS page_md5 FROM bibtex GROUP BY 1")
def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """SC-19, SK-13: pages restored from Base64 and bundled again."""
    at = place(spark, "pages")
    pages = table(spark, d, "bibtex").groupBy(F.concat("id", F.lit(".html")).alias("name")).agg(F.min(F.concat("title", F.lit("\n"), "bibtex")).alias("page"))
    stage(sinks.restore_html(pages.select("name", F.base64(F.encode("page", "UTF-8")).alias("content_b64")), at))
    return files.html_bundle(spark, at).select("name", F.md5(F.unbase64("content_b64")).alias("page_md5"))


@query("""WITH b AS (SELECT id, min(bibtex) AS bibtex, min(title) AS title FROM bibtex GROUP BY 1)
  SELECT id || '.tar.gz' AS name, id || '/main.tex' AS member, md5(title) AS content_md5, 'ok' AS status FROM b UNION ALL SELECT id || '.tar.gz', id || '/refs.bib', md5(bibtex), 'ok' FROM b
  UNION ALL SELECT id || '.tar.gz', id || '/../out', NULL, 'unsafe path' FROM b""")
def archive_members(spark: SparkSession, d: str) -> DataFrame:
    """SC-4, SC-5, SC-6: members of compressed archives, with what became of each; paths that lead out are not unpacked."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, out = [], []
            for id_, bibtex, title in zip(*(c.to_pylist() for c in b.columns)):
                raw = io.BytesIO()
                with tarfile.open(fileobj=raw, mode="w:gz") as tar:
                    for name, text in (("main.tex", title), ("refs.bib", bibtex), ("../out", "x")):
                        member = tarfile.TarInfo(name)
                        member.size = len(text.encode())
                        tar.addfile(member, io.BytesIO(text.encode()))
                names.append(f"{id_}.tar.gz")
                out.append(raw.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], names=["name", "content"])

    b = table(spark, d, "bibtex").groupBy("id").agg(F.min("bibtex").alias("bibtex"), F.min("title").alias("title"))
    return files.archives(b.mapInArrow(packed, "name string, content binary")).select("name", "member", F.md5("content").alias("content_md5"), "status")


def _or_none(c: str) -> Column:
    """A text, or a remark where it is empty: empty files aren't read."""
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("% none"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """(month, paper_id, rel_path, text) of a tree of papers: main files with inclusions and bibliographies, written and walked."""
    at = place(spark, "papers")
    p = table(spark, d, "parsed_parts").filter("intro is not null and arxiv_id is not null").groupBy(F.replace("arxiv_id", F.lit("/"), F.lit("")).alias("arxiv_id")).agg(F.min_by(F.struct("intro", "related_work", "bib"), "part_id").alias("p")).select("arxiv_id", "p.*")
    main = F.concat(F.lit("\\documentclass{a}\n\\input{parts/intro}\n\\include{parts/rel.tex}\n\\input{none}\n% "), "arxiv_id", F.lit("\n"))
    parts = {"main.tex": main, "short.tex": F.lit("\\documentclass"), "parts/intro.tex": _or_none("intro"), "parts/rel.tex": _or_none("related_work"), "b.bib": _or_none("bib"), "a.bib": F.concat(F.lit("@misc{"), "arxiv_id", F.lit("}"))}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rel"), t.alias("text")) for n, t in parts.items()])).alias("f")
    rows = p.select("arxiv_id", each).select(F.concat_ws("/", F.substring("arxiv_id", 1, 4), "arxiv_id", "f.rel").alias("path"), F.encode("f.text", "UTF-8").alias("content"))
    stage(sinks.side_files(rows, at))
    return files.papers(spark, at.removeprefix("file://"))


_PAPERS = """WITH p AS (SELECT replace(arxiv_id, '/', '') AS arxiv_id, min_by(struct_pack(intro, related_work, bib), part_id) AS p FROM parsed_parts WHERE intro IS NOT NULL AND arxiv_id IS NOT NULL GROUP BY 1)"""


@query(_PAPERS + r""" SELECT arxiv_id AS paper_id, md5('\documentclass{a}' || chr(10) || coalesce(nullif(p.intro, ''), '% none') || chr(10) || coalesce(nullif(p.related_work, ''), '% none') || chr(10) || '\input{none}' || chr(10) || '% ' || arxiv_id || chr(10)) AS tex_md5, CAST(2 AS INTEGER) AS n_main FROM p WHERE NOT regexp_matches(p.intro || coalesce(p.related_work, ''), '\\(input|include)[^a-z]')""")
def expanded_papers(spark: SparkSession, d: str) -> DataFrame:
    """SC-1, SC-3, SK-7, ST-30, ST-31, AG-3: papers walked by month, the longest main file with its inclusions expanded."""
    return files.flatten(_tree(spark, d)).select("paper_id", F.md5("full_tex").alias("tex_md5"), "n_main")


@query(_PAPERS + """ SELECT arxiv_id AS paper_id, md5('% From file: a.bib' || chr(10) || '@misc{' || arxiv_id || '}' || chr(10) || chr(10) || '% From file: b.bib' || chr(10) || coalesce(nullif(p.bib, ''), '% none') || chr(10)) AS bib_md5 FROM p""")
def merged_bibs(spark: SparkSession, d: str) -> DataFrame:
    """ST-32, TK-9: a paper's .bib files in the order of their names."""
    return files.merged_files(_tree(spark, d), ".bib").select("paper_id", F.md5("merged").alias("bib_md5"))


@query("SELECT doc_id, md5(text) AS text_md5, length(text) AS n, 'caf' || chr(233) AS latin FROM documents WHERE text IS NOT NULL")
def decoded_bytes(spark: SparkSession, d: str) -> DataFrame:
    """SC-1, SC-2: bytes as text, UTF-8 or Latin-1."""
    df = table(spark, d, "documents").filter("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("raw"), F.unhex(F.lit("636166E9")).alias("old"))
    return df.select("doc_id", F.md5(files.decoded(F.col("raw"))).alias("text_md5"), F.length(files.repaired(F.col("raw"))).cast("long").alias("n"), files.decoded(F.col("old")).alias("latin"))


def _upper(keys: list[str]) -> list[str | None]:
    return [k.upper() if k.isascii() else None for k in keys]


@query("SELECT DISTINCT citation_key, upper(citation_key) AS payload, CAST(NULL AS VARCHAR) AS message FROM citations WHERE citation_key IS NOT NULL")
def lookup_plugin(spark: SparkSession, d: str) -> DataFrame:
    """SC-15, SC-16: a caller's lookup, ten keys at a time; the stand-in answers with the key in capitals."""
    return files.looked_up(table(spark, d, "citations"), "citation_key", _upper, parallel=4)


def _sizes(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count(" "))] for t in texts]


def _same_words(pairs: list[tuple[str, str]]) -> list[float]:
    return [float(len(set(a.split(" ")) & set(b.split(" ")))) for a, b in pairs]


def _first_line(prompts: list[str]) -> list[tuple[str, list[float]]]:
    return [(p.split("\n")[0], [float(len(p))]) for p in prompts]


@query("SELECT doc_id, [CAST(length(coalesce(text, '')) AS FLOAT), CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) AS FLOAT)] AS embedding FROM documents")
def encoder_plugin(spark: SparkSession, d: str) -> DataFrame:
    """UD-2: a caller's encoder; the stand-in gives lengths."""
    return files.encoded(table(spark, d, "documents"), "doc_id", "text", _sizes)


@query("SELECT corpus_id, CAST(len(list_distinct(list_intersect(string_split(coalesce(title, ''), ' '), string_split(coalesce(abstract, ''), ' ')))) AS DOUBLE) AS score FROM (SELECT DISTINCT corpus_id, title, abstract FROM corpus_data)")
def cross_encoder_plugin(spark: SparkSession, d: str) -> DataFrame:
    """UD-4: scores of pairs by a caller's cross-encoder; the stand-in counts common words."""
    return files.scored(table(spark, d, "corpus_data").select("corpus_id", "title", "abstract").distinct(), "corpus_id", "title", "abstract", _same_words)


@query("SELECT row_id, string_split(paper, chr(10))[1] AS answer, CASE WHEN paper IS NOT NULL THEN [CAST(length(paper) AS FLOAT)] END AS hidden FROM (SELECT DISTINCT row_id, paper FROM train_rows)")
def generator_plugin(spark: SparkSession, d: str) -> DataFrame:
    """UD-3, SM-2: answers and hidden states of a caller's generator; the stand-in gives the first line."""
    return files.generated(table(spark, d, "train_rows").select("row_id", "paper").distinct(), "row_id", "paper", _first_line)


@query(r"""WITH p AS (SELECT DISTINCT part_id, bib FROM parsed_parts WHERE bib IS NOT NULL), s AS (SELECT part_id, list_filter(list_transform(string_split_regex(bib, '\n\n\n+'), lambda x: regexp_replace(x, '^[ \t\r\f\v\n]+|[ \t\r\f\v\n]+$', '', 'g')), lambda x: x <> '') AS a FROM p)
  SELECT part_id, unnest(range(len(a))) AS pos, md5(unnest(a)) AS sample_md5 FROM s""")
def bib_samples(spark: SparkSession, d: str) -> DataFrame:
    """SC-20: bibliographies split into their items at blank lines."""
    df = table(spark, d, "parsed_parts").filter("bib is not null").select("part_id", "bib").distinct()
    return df.select("part_id", F.posexplode(files.split_samples(F.col("bib"))).alias("pos", "x")).select("part_id", F.col("pos").cast("long").alias("pos"), F.md5("x").alias("sample_md5"))


@query("SELECT arxiv_id, md5('% Exported now, ' || count(*) || ' entries' || chr(10) || chr(10) || string_agg(raw, chr(10) || chr(10) ORDER BY pos, raw)) AS content_md5 FROM (SELECT arxiv_id, raw, min(pos) AS pos FROM citations WHERE raw IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def history_export(spark: SparkSession, d: str) -> DataFrame:
    """SK-14, DT-4: each session's history of entries as a file; a paper stands for a session."""
    return sinks.history_file(table(spark, d, "citations"), "raw", "pos", "now", "arxiv_id").select("arxiv_id", F.md5("content").alias("content_md5"))


@query("SELECT title, min(lookup_id) AS lookup_id FROM title_lookup WHERE title IS NOT NULL GROUP BY title")
def cache_grown_by_stream(spark: SparkSession, d: str) -> DataFrame:
    """SM-5, SK-9: a lookup cache that grows by a stream of files, each title once."""
    at, cache, checkpoint = (place(spark, n) for n in ("arriving", "cache", "offsets"))
    df = table(spark, d, "title_lookup").select("lookup_id", "title")
    df.repartitionByRange(4, "lookup_id").write.parquet(at)
    grown = worklists.grow_cache(spark.readStream.schema(df.schema).parquet(at), "title", "lookup_id", cache, checkpoint)
    grown.awaitTermination()
    return spark.read.parquet(cache).select("title", "lookup_id")


_SPAN = r"(?s)<\|cite_start\|>.*?<\|cite_end\|>"


@query(rf"""WITH p AS (SELECT item_id, text, string_split_regex(text, '{_SPAN}') AS outside, regexp_extract_all(text, '{_SPAN}') AS spans FROM test_items WHERE text <> ''),
  h AS (SELECT *, regexp_extract(array_to_string(outside, chr(1)), '(?s)^((?:.*?[.!?][ \n]){{3}})', 1) AS h FROM p), g AS (SELECT *, string_split(substr(h, 1, length(h) - 1), chr(1)) AS kept FROM h)
  SELECT item_id, md5(CASE WHEN h <> '' THEN array_to_string(list_transform(kept, lambda x, i: CASE WHEN i = 1 THEN x ELSE spans[i - 1] || x END), '') ELSE text END) AS text_md5, h <> '' AS done FROM g""")
def sessions_by_stream(spark: SparkSession, d: str) -> DataFrame:
    """SM-1, SM-3: texts that arrive in two chunks, each session cut after three sentences by its own state."""
    at, out, checkpoint = (place(spark, n) for n in ("chunks", "states", "offsets"))
    half = F.floor(F.length("text") / 2).cast("int")
    t = table(spark, d, "test_items").filter("text <> ''").select(F.col("item_id").cast("string").alias("session_id"), "text")
    chunks = F.array(F.struct(F.lit(0).alias("pos"), F.substring(F.col("text"), F.lit(1), half).alias("chunk")), F.struct(F.lit(1).alias("pos"), F.substring(F.col("text"), half + 1, F.length("text")).alias("chunk")))
    t = t.select("session_id", F.explode(chunks).alias("c")).select("session_id", "c.*")
    t.write.parquet(at)
    found = worklists.sessions(spark.readStream.schema(t.schema).parquet(at), 3)
    writing = found.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    writing.awaitTermination()
    last = spark.read.parquet(out).groupBy("session_id").agg(F.max_by(F.struct("text", "done"), "batch").alias("s"))
    return last.select(F.col("session_id").cast("long").alias("item_id"), F.md5("s.text").alias("text_md5"), "s.done")
