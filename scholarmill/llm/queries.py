"""The pN_ queries, each over its whole tables, and SQL for those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmill.llm import bpe, entities, langid, leaks, ledger, lookalike, markup, overlap, pieces
from scholarmill.sources.tables import table

LIMITS = {"paper": (6000, 200), "targets": (700, 60)}


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    """Records of corpus_data (other services) and title_lookup with the paper they describe and a confidence."""
    year = F.expr("try_cast(regexp_extract(versions[0].created, '[A-Za-z]+ ([0-9]{4}) ', 1) AS int)")
    papers = table(spark, d, "arxiv_metadata").select(F.col("arxiv_id").alias("id"), "title", "abstract", "authors", year.alias("year"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    corpus = table(spark, d, "corpus_data").filter("source <> 'arxiv' or source is null")
    corpus = corpus.select(F.lit("corpus_data").alias("other_table"), F.col("paper_id").alias("id"), "title", "abstract", none("authors", "string"), none("year", "int"))
    lookup = table(spark, d, "title_lookup").filter(F.col("paperid").isNotNull())
    lookup = lookup.select(F.lit("title_lookup").alias("other_table"), F.col("paperid").alias("id"), "title", "abstract", "authors", F.col("pub_year").cast("int").alias("year"))
    return entities.match(papers, corpus.unionByName(lookup))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The matches of p1_matches as pairs."""
    return p1_matches(spark, d).select(F.col("paper_id").alias("arxiv_id"), "other_table", "other_id").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of titles and of abstracts that look the same though their strings differ."""
    corpus = table(spark, d, "corpus_data")
    left = lookalike.forms(corpus, "corpus_id", "title", "title").unionByName(lookalike.forms(corpus, "corpus_id", "abstract", "abstract"))
    right = lookalike.forms(table(spark, d, "title_lookup"), "lookup_id", "title", "title").unionByName(lookalike.forms(table(spark, d, "arxiv_metadata"), "arxiv_id", "abstract", "abstract"))
    return lookalike.same_look(left, right).select("field", F.col("left_id").alias("corpus_id"), F.col("right_id").alias("other_id"))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of each title and abstract of corpus_data."""
    df = table(spark, d, "corpus_data").select("corpus_id", "title", "abstract").distinct()
    df = lookalike.with_consistent(lookalike.with_consistent(df, "title", "title_form"), "abstract", "abstract_form")
    return df.select("corpus_id", "title_form", "abstract_form")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The items over their limit, which the splitting operator cuts."""
    items = pieces.split_items(table(spark, d, "train_rows").select("row_id", *LIMITS), LIMITS)
    return items.filter(F.size("cuts") > 0).select("row_id", "field", "item_no").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the items over their limit; full copies of a row are split once."""
    items = pieces.split_items(table(spark, d, "train_rows").select("row_id", *LIMITS), LIMITS)
    return pieces.pieces(items).distinct()


FIELDS = ("intro", "related_work", "bib")


def _values(spark: SparkSession, d: str) -> DataFrame:
    return markup.values(table(spark, d, "parsed_parts"), "part_id", FIELDS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The values of parsed_parts with markup."""
    return markup.with_markup(markup.pages(_values(spark, d), "part_id"), "part_id").distinct()


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    """The clean text of each value of parsed_parts."""
    return markup.cleaned(_values(spark, d), "part_id")


def p4_templates(spark: SparkSession, d: str) -> DataFrame:
    """Equivalence classes of markup tokens over all values, which are valid, and the class that each nests in."""
    return markup.templates(markup.pages(_values(spark, d), "part_id"))


def _train(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train_rows").select("row_id", "paper", (F.col("split") != "train").alias("is_eval"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a training and an evaluation row whose papers overlap."""
    return overlap.overlaps(_train(spark, d), "row_id", "paper", "is_eval")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping evaluation rows and pairs for each split and source of the evaluation row."""
    pairs = p5_found(spark, d)
    rows = table(spark, d, "train_rows").filter("split <> 'train'").select("row_id", "split", "source").distinct()
    each = pairs.select(F.explode(F.array("id_a", "id_b")).alias("row_id")).groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))
    return each.join(rows, "row_id").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_pairs"))


def _ledger(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The keyed rows of both tables and the ledger after two batches of both: arXiv's records and the earlier half of the
    payloads by id, then the rest, whose counts are added to those of the first."""
    corpus, raw = table(spark, d, "corpus_data"), table(spark, d, "lookup_raw")
    arxiv, middle = F.col("source").eqNullSafe("arxiv"), raw.agg(F.percentile_approx("raw_id", 0.5)).first()[0]
    early = F.col("raw_id") <= F.lit(middle).cast("long")
    book, rows = ledger.empty_ledger(spark), None
    for some_corpus, some_raw in ((arxiv, early), (~arxiv, ~F.coalesce(early, F.lit(False)))):
        batch = ledger.stage(ledger.corpus_keys(corpus.filter(some_corpus)).unionByName(ledger.lookup_keys(raw.filter(some_raw))))
        book = ledger.add_batch(book, batch)
        rows = batch if rows is None else rows.unionByName(batch)
    return book, rows


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The further records of each group of records that differ in layout only."""
    book, rows = _ledger(spark, d)
    return ledger.members(book, rows).select(F.col("source_name").alias("table_name"), "keep_id", "dup_id")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """One record for each group, with the number of its copies, full copies included."""
    return _ledger(spark, d)[0].select(F.col("source_name").alias("table_name"), "keep_id", "copies")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of each document by byte_bpe_50k."""
    return bpe.encode_column(table(spark, d, "documents"), "doc_id", "text", bpe.Encoder.load())


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold passages of test items, with the items and the merged spans of words to remove."""
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "test_items"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a document and a test item whose passage it holds."""
    return p8_spans(spark, d).select("doc_id", F.explode("item_ids").alias("item_id")).distinct()


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language of each document, those of its segments, and how sure they are."""
    docs = table(spark, d, "documents")
    return langid.detect(docs, "doc_id", "text", "lang", langid.fitted(docs, "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The languages of documents whose label is missing or wrong, and of mixed documents."""
    return langid.mislabelled(p9_languages(spark, d), "doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_matches, p2_found, p2_forms, p3_found, p3_pieces, p4_found, p4_clean, p4_templates, p5_found, p5_report, p6_found, p6_counts, p7_ids, p8_found, p8_spans, p9_found, p9_languages)}


_PLAIN = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')"
_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN 'n' ELSE 'v' || {_PLAIN.format(c)} END"
_JSON = lambda k: f"json_extract_string(payload, '$.{k}')"
_KEYED = f"""
  SELECT 'corpus_data' AS table_name, corpus_id AS id, {_FIELD('title')} || chr(1) || {_FIELD('abstract')} AS k FROM corpus_data
  UNION ALL
  SELECT 'lookup_raw', CAST(raw_id AS VARCHAR), {' || chr(1) || '.join(_FIELD(_JSON(x)) for x in ('paperId', 'title', 'abstract', 'url'))}
    || chr(1) || coalesce(CAST(try_cast({_JSON('matchScore')} AS DOUBLE) AS VARCHAR), {_FIELD(_JSON('matchScore'))})
  FROM lookup_raw WHERE json_valid(payload)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """
            SELECT DISTINCT row_id, 'paper' AS field, 0 AS item_no FROM train_rows WHERE length(paper) > 6000
            UNION
            SELECT DISTINCT row_id, 'targets', CAST(i - 1 AS INTEGER) FROM (
              SELECT row_id, targets, unnest(range(1, len(targets) + 1)) AS i FROM train_rows) WHERE length(targets[i]) > 700""",
        "p6_found": f"""
            WITH keyed AS ({_KEYED}), groups AS (SELECT table_name, k, min(id) AS keep_id FROM keyed GROUP BY 1, 2)
            SELECT DISTINCT table_name, keep_id, id AS dup_id FROM keyed JOIN groups USING (table_name, k) WHERE id <> keep_id""",
        "p6_counts": f"""
            WITH keyed AS ({_KEYED})
            SELECT table_name, keep_id, copies FROM (SELECT table_name, k, min(id) AS keep_id, count(*) AS copies FROM keyed GROUP BY 1, 2)""",
    }
