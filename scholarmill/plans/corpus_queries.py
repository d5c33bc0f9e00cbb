"""Queries of joins, aggregations, set operations, filters, samples and batches over the corpus tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmill.functions import bib
from scholarmill.functions.cite import as_reference, reference_span
from scholarmill.functions.prompts import few_shot, first_line, spaced_markers
from scholarmill.functions.titles import byte_size, citation_label, display_title, normalize_title, yymm
from scholarmill.operators import assembly, rows
from scholarmill.plans.registry import query
from scholarmill.sources.tables import table

_NORMED = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g'))"
_NORM = f"CASE WHEN {_NORMED} = '' THEN trim(lower({{0}})) ELSE {_NORMED} END"


def _norm() -> Column:
    """The key of a title; of one without ASCII letters and digits the title itself, so that these stay apart."""
    norm = normalize_title(F.col("title"))
    return F.when(norm == "", F.trim(F.lower("title"))).otherwise(norm)


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """Records with a title and its key."""
    return table(spark, d, "corpus_data").filter(F.col("title").isNotNull()).select("corpus_id", "paper_id", "title", "abstract", "source", _norm().alias("norm"))


_C = f"WITH c AS (SELECT *, {_NORM.format('title')} AS norm FROM corpus_data WHERE title IS NOT NULL)"


@query(_C + " SELECT norm, min(corpus_id) AS corpus_id FROM c GROUP BY norm")
def normalize_title_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """ST-14, AG-4, AG-6: the first record of each title."""
    return rows.first_wins(_corpus(spark, d).select("norm", "corpus_id"), ["norm"], ["corpus_id"]).select("norm", "corpus_id")


@query(_C + " SELECT norm, max(corpus_id) AS corpus_id FROM c GROUP BY norm")
def normalize_title_dedup_last(spark: SparkSession, d: str) -> DataFrame:
    """AG-5: the last record of each title."""
    return rows.last_wins(_corpus(spark, d).select("norm", "corpus_id"), ["norm"], ["corpus_id"]).select("norm", "corpus_id")


@query(_C + ", f AS (SELECT norm, min(corpus_id) AS corpus_id FROM c GROUP BY norm)" + f" SELECT DISTINCT lookup_id, corpus_id FROM title_lookup t LEFT JOIN f ON f.norm = {_NORM.format('t.title')} WHERE t.title IS NOT NULL")
def exact_match_lookup(spark: SparkSession, d: str) -> DataFrame:
    """JN-8: lookups by exact title; a miss keeps its row."""
    asked = table(spark, d, "title_lookup").filter(F.col("title").isNotNull()).select("lookup_id", _norm().alias("norm"))
    return asked.join(normalize_title_dedup_first(spark, d), "norm", "left").select("lookup_id", "corpus_id").distinct()


@query(
    _C + f""", f AS (SELECT norm, min(corpus_id) AS v FROM c GROUP BY norm), l AS (SELECT title, min(paperid) AS v FROM title_lookup WHERE paperid IS NOT NULL GROUP BY title),
  q AS (SELECT DISTINCT arxiv_id, pos, title, citation_key, citation_corpus_id, {_NORM.format('title')} AS norm FROM citations WHERE title IS NOT NULL),
  b AS (SELECT citation_key, min(id) AS v FROM bibtex GROUP BY 1)
  SELECT arxiv_id, pos, coalesce(citation_corpus_id, f.v, l.v, b.v) AS value,
    CASE WHEN citation_corpus_id IS NOT NULL THEN 'given' WHEN f.v IS NOT NULL THEN 'exact' WHEN l.v IS NOT NULL THEN 'cache' WHEN b.v IS NOT NULL THEN 'bibtex' END AS resolved_by
  FROM q LEFT JOIN f ON f.norm = q.norm LEFT JOIN l ON l.title = q.title LEFT JOIN b ON b.citation_key = q.citation_key"""
)
def resolve_cascade(spark: SparkSession, d: str) -> DataFrame:
    """JN-3 to JN-7, JN-12, SE-3: citations resolved by their own id, exact title, cache and key, each step on the rest only."""
    cited = table(spark, d, "citations").filter(F.col("title").isNotNull()).select("arxiv_id", "pos", "title", "citation_key", "citation_corpus_id", _norm().alias("norm")).distinct()
    given = cited.filter(F.col("citation_corpus_id").isNotNull()).select("arxiv_id", "pos", F.col("citation_corpus_id").alias("value"), F.lit("given").alias("resolved_by"))
    rest = cited.filter(F.col("citation_corpus_id").isNull()).drop("citation_corpus_id")
    exact = normalize_title_dedup_first(spark, d).withColumnRenamed("corpus_id", "value")
    cache = table(spark, d, "title_lookup").filter(F.col("paperid").isNotNull() & F.col("title").isNotNull()).groupBy("title").agg(F.min("paperid").alias("value"))
    keys = table(spark, d, "bibtex").groupBy("citation_key").agg(F.min("id").alias("value"))
    found = rows.cascade(rest, [("exact", exact, "norm"), ("cache", cache, "title"), ("bibtex", keys, "citation_key")], "value")
    return given.unionByName(found.select("arxiv_id", "pos", "value", "resolved_by"))


@query("""
  WITH p AS (SELECT DISTINCT lookup_id, title, abstract FROM title_lookup WHERE title IS NOT NULL), s AS (SELECT title, min(abstract) AS abstract FROM corpus_data WHERE title IS NOT NULL GROUP BY title)
  SELECT lookup_id, md5(coalesce(p.abstract, s.abstract)) AS abstract_md5 FROM p LEFT JOIN s USING (title)""")
def merge_prefer_primary(spark: SparkSession, d: str) -> DataFrame:
    """JN-9: the primary source's value, else the secondary's; keys of the secondary only are dropped."""
    p = table(spark, d, "title_lookup").filter(F.col("title").isNotNull()).select("lookup_id", "title", "abstract").distinct()
    s = table(spark, d, "corpus_data").filter(F.col("title").isNotNull()).groupBy("title").agg(F.min("abstract").alias("abstract"))
    return rows.merge_sources(p, s, "title", ["abstract"]).select("lookup_id", F.md5("abstract").alias("abstract_md5"))


@query("""
  WITH u AS (SELECT arxiv_id AS paper_id, 'arxiv' AS source, 0 AS part, arxiv_id AS pos FROM arxiv_metadata UNION ALL SELECT paper_id, source, 1, corpus_id FROM corpus_data),
  f AS (SELECT paper_id, first(source ORDER BY part, pos, source) AS source, min(struct_pack(part, pos)) AS p FROM u GROUP BY paper_id),
  n AS (SELECT paper_id, (CASE WHEN source = 'arxiv' THEN 'arxiv-' ELSE 'ss-' END) || (row_number() OVER (ORDER BY p, paper_id) - 1) AS corpus_no FROM f)
  SELECT u.paper_id, corpus_no, count(*) AS n_rows FROM u JOIN n ON n.paper_id = u.paper_id GROUP BY 1, 2""")
def corpus_identify(spark: SparkSession, d: str) -> DataFrame:
    """WN-1, SE-1, AG-12: one counter over both sources, the first first; repeats inherit their id."""
    a = table(spark, d, "arxiv_metadata").select(F.col("arxiv_id").alias("paper_id"), F.lit("arxiv").alias("source"), F.lit(0).alias("part"), F.col("arxiv_id").alias("pos"))
    c = table(spark, d, "corpus_data").select("paper_id", "source", F.lit(1).alias("part"), F.col("corpus_id").alias("pos"))
    found = rows.identify(a.unionByName(c), "paper_id", "source", [F.col("part"), F.col("pos")], "corpus_no")
    return found.groupBy("paper_id", "corpus_no").agg(F.count(F.lit(1)).alias("n_rows"))


@query("""
  WITH d AS (SELECT DISTINCT arxiv_id, pos, citation_key, kind, raw FROM citations WHERE raw IS NOT NULL),
  k AS (SELECT arxiv_id, citation_key, min(kind) AS kind FROM d GROUP BY 1, 2)
  SELECT k.arxiv_id, k.citation_key, k.kind, CASE WHEN k.kind = 0 THEN max_by(raw, pos) ELSE min_by(raw, pos) END AS raw FROM d JOIN k ON k.arxiv_id = d.arxiv_id AND k.citation_key = d.citation_key AND k.kind = d.kind GROUP BY 1, 2, 3""")
def cite_bib_join(spark: SparkSession, d: str) -> DataFrame:
    """JN-15: of a key's items the .bib one (kind 0, the last) before the .bbl one (kind 1, the first)."""
    items = table(spark, d, "citations").filter(F.col("raw").isNotNull())
    order = F.struct("kind", F.when(F.col("kind") == 0, -F.col("pos")).otherwise(F.col("pos")).alias("o"), "raw")
    return items.groupBy("arxiv_id", "citation_key").agg(F.min(order).alias("m")).select("arxiv_id", "citation_key", "m.kind", "m.raw")


@query(r"""WITH i AS (SELECT arxiv_id, unnest(bib_items) AS raw, 0 AS kind FROM parsed_parts UNION SELECT arxiv_id, unnest(bbl_items), 1 FROM parsed_parts UNION SELECT arxiv_id, raw, kind FROM citations),
  k AS (SELECT arxiv_id, raw, kind, CASE WHEN kind = 0 THEN nullif(trim(regexp_extract(raw, '@\w+[ \t\r\f\v\n]*\{([^,]+),', 1)), '') ELSE nullif(trim(regexp_extract(regexp_replace(raw, '[ \t\r\f\v\n]+', ' ', 'g'), '\\bibitem *(?:\[(?:[^\[\]]|\{[^{}]*\})*\])? *\{([^}]+)\}', 1)), '') END AS citation_key FROM i WHERE raw IS NOT NULL),
  c AS (SELECT DISTINCT arxiv_id, citation_key FROM citations WHERE citation_key IS NOT NULL), j AS (SELECT c.arxiv_id, c.citation_key, min((kind, raw)) AS m FROM c LEFT JOIN k ON k.arxiv_id = c.arxiv_id AND k.citation_key = c.citation_key GROUP BY 1, 2)
  SELECT arxiv_id, citation_key, m[1] AS kind, md5(m[2]) AS raw_md5 FROM j""")
def key_items(spark: SparkSession, d: str) -> DataFrame:
    """JN-2: the item of each cited key among its paper's .bib items (kind 0), else its .bbl items (kind 1), by the key that the item gives; a miss keeps its row."""
    p, c = table(spark, d, "parsed_parts"), table(spark, d, "citations")
    raw = p.select("arxiv_id", F.explode("bib_items").alias("raw"), F.lit(0).alias("kind")).union(p.select("arxiv_id", F.explode("bbl_items"), F.lit(1))).union(c.select("arxiv_id", "raw", "kind"))
    key = F.when(F.col("kind") == 0, bib.entry_key(F.col("raw"))).otherwise(bib.bibitem_key(F.col("raw")))
    items = raw.filter(F.col("raw").isNotNull()).select("arxiv_id", "kind", "raw", key.alias("citation_key")).filter(F.col("citation_key").isNotNull())
    best = items.groupBy("arxiv_id", "citation_key").agg(F.min(F.struct("kind", "raw")).alias("m"))
    cited = c.filter(F.col("citation_key").isNotNull()).select("arxiv_id", "citation_key").distinct()
    return cited.join(best, ["arxiv_id", "citation_key"], "left").select("arxiv_id", "citation_key", "m.kind", F.md5("m.raw").alias("raw_md5"))


@query("SELECT DISTINCT c.citation_key, c.title FROM (SELECT citation_key, min(title) AS title FROM citations GROUP BY 1) c WHERE c.citation_key IN (SELECT citation_key FROM bibtex)")
def cited_and_defined(spark: SparkSession, d: str) -> DataFrame:
    """SE-4, JN-14: cited keys that have an entry; the fixed table of entries is checked to be small by the planner."""
    keys = table(spark, d, "bibtex").select("citation_key").distinct()
    return table(spark, d, "citations").groupBy("citation_key").agg(F.min("title").alias("title")).join(keys, "citation_key", "left_semi")


@query("SELECT DISTINCT c.title FROM citations c WHERE c.citation_corpus_id IS NULL AND c.title IS NOT NULL AND NOT EXISTS (SELECT 1 FROM title_lookup t WHERE t.title = c.title)")
def lookup_worklist(spark: SparkSession, d: str) -> DataFrame:
    """JN-6, SE-3: titles that have still to be looked up."""
    asked = table(spark, d, "title_lookup").select("title").distinct()
    return table(spark, d, "citations").filter(F.col("citation_corpus_id").isNull() & F.col("title").isNotNull()).select("title").distinct().join(asked, "title", "left_anti")


@query("""SELECT DISTINCT c.corpus_id, b.citation_key, 'title' AS found_by FROM corpus_data c JOIN bibtex b ON b.title = c.title UNION SELECT DISTINCT c.corpus_id, b.citation_key, 'id' FROM corpus_data c JOIN bibtex b ON b.id = c.paper_id
  UNION SELECT DISTINCT c.corpus_id, b.citation_key, 'cited' FROM corpus_data c JOIN citations x ON x.arxiv_id = c.paper_id JOIN bibtex b ON b.citation_key = x.citation_key""")
def corpus_bibtex(spark: SparkSession, d: str) -> DataFrame:
    """JN-10: records with their BibTeX entries, by id or title, and with those of the works they cite, by key."""
    c = table(spark, d, "corpus_data").select("corpus_id", "paper_id", "title").distinct()
    b = table(spark, d, "bibtex").select("id", F.col("title").alias("b_title"), "citation_key").distinct()
    cited = table(spark, d, "citations").select(F.col("arxiv_id").alias("paper_id"), "citation_key").distinct().join(b.select("citation_key"), "citation_key", "left_semi")
    by = lambda df, how: df.select("corpus_id", "citation_key", F.lit(how).alias("found_by"))
    return by(c.join(b, F.col("title") == F.col("b_title")), "title").union(by(c.join(b, F.col("paper_id") == F.col("id")), "id")).union(by(c.join(cited, "paper_id"), "cited")).distinct()


@query("SELECT DISTINCT d.doc_id, m.title, m.categories FROM documents d JOIN (SELECT arxiv_id, min(title) AS title, min(categories) AS categories FROM arxiv_metadata GROUP BY 1) m ON m.arxiv_id = d.arxiv_id")
def documents_with_papers(spark: SparkSession, d: str) -> DataFrame:
    """JN-7, JN-13: documents of known papers, with their metadata."""
    m = table(spark, d, "arxiv_metadata").groupBy("arxiv_id").agg(F.min("title").alias("title"), F.min("categories").alias("categories"))
    return table(spark, d, "documents").select("doc_id", "arxiv_id").join(m, "arxiv_id").select("doc_id", "title", "categories").distinct()


@query("""SELECT main_cite, count(*) AS n, count(DISTINCT source) AS n_sources, round(avg(n_chars), 4) AS mean_chars, b.title FROM documents LEFT JOIN (SELECT citation_key, min(title) AS title FROM bibtex GROUP BY 1) b ON b.citation_key = main_cite GROUP BY main_cite, b.title""")
def main_cite_stats(spark: SparkSession, d: str) -> DataFrame:
    """AG-7: statistics by cited work, aggregated before the join: one key holds a tenth of the rows."""
    stats = table(spark, d, "documents").groupBy("main_cite").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))
    names = table(spark, d, "bibtex").groupBy(F.col("citation_key").alias("main_cite")).agg(F.min("title").alias("title"))
    return stats.join(names, "main_cite", "left").select("main_cite", "n", "n_sources", "mean_chars", "title")


@query("""SELECT regexp_replace(lower(categories), 'physics', '', 'g') AS categories, count(*) AS n, bool_or(contains(replace(lower(categories), 'physics', ''), 'cs.')) AS is_cs,
  bool_or(contains(replace(replace(lower(categories), 'physics', ''), 'optics', ''), 'cs')) AS is_cs_wide FROM (SELECT DISTINCT arxiv_id, categories FROM arxiv_metadata) GROUP BY 1""")
def category_histogram(spark: SparkSession, d: str) -> DataFrame:
    """FI-1, FI-2, AG-2: papers by category, and whether it is of computer science."""
    bare = F.replace(F.lower("categories"), F.lit("physics"), F.lit(""))
    df = table(spark, d, "arxiv_metadata").select("arxiv_id", "categories").distinct().withColumn("_c", bare)
    wide = F.contains(F.replace("_c", F.lit("optics"), F.lit("")), F.lit("cs"))
    return df.groupBy(F.col("_c").alias("categories")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.contains("_c", F.lit("cs."))).alias("is_cs"), F.bool_or(wide).alias("is_cs_wide"))


@query("""SELECT CASE WHEN message IS NOT NULL THEN 'failed' WHEN paperid IS NULL THEN 'not found' WHEN abstract IS NULL THEN 'no abstract' WHEN matchscore < 30 THEN 'low score' WHEN matchscore IS NULL THEN 'no score' WHEN length(abstract) <= 10 THEN 'short' ELSE 'usable' END AS status,
  count(*) AS n, min(lookup_id) AS first_id FROM title_lookup GROUP BY 1""")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """AG-1, FI-4, FI-5, FI-11, SK-8: lookups by what became of them."""
    c = F.col
    status = (
        F.when(c("message").isNotNull(), "failed").when(c("paperid").isNull(), "not found").when(c("abstract").isNull(), "no abstract").when(c("matchscore") < 30, "low score")
        .when(c("matchscore").isNull(), "no score").when(F.length("abstract") <= 10, "short").otherwise("usable")
    )
    return table(spark, d, "title_lookup").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.min("lookup_id").alias("first_id"))


@query("SELECT substr(arxiv_id, 1, 4) AS month, count(*) AS n, count_if(NOT starts_with(arxiv_id, '2410')) AS n_kept, count_if((NOT contains(categories, 'physics') AND NOT contains(arxiv_id, '/')) OR (contains(arxiv_id, 'cs/') AND NOT contains(arxiv_id, 'physics'))) AS n_allowed FROM arxiv_metadata GROUP BY 1")
def papers_by_month(spark: SparkSession, d: str) -> DataFrame:
    """AG-8, FI-3, FI-8, FI-12, DT-3: papers by month, with the allowed ones."""
    i, c = F.col("arxiv_id"), F.col("categories")
    has = lambda x, s: F.contains(x, F.lit(s))
    allowed = (~has(c, "physics") & ~has(i, "/")) | (has(i, "cs/") & ~has(i, "physics"))
    return table(spark, d, "arxiv_metadata").groupBy(yymm(i).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~i.startswith("2410")).alias("n_kept"), F.count_if(allowed).alias("n_allowed"))


@query("SELECT arxiv_id, count(*) AS n, count(citation_corpus_id) AS n_resolved, count(DISTINCT citation_key) AS n_keys FROM (SELECT DISTINCT * FROM citations) GROUP BY arxiv_id HAVING count(citation_corpus_id) >= 4")
def papers_with_citations(spark: SparkSession, d: str) -> DataFrame:
    """FI-6, AG-9: papers with at least four resolved citations."""
    df = table(spark, d, "citations").distinct().groupBy("arxiv_id").agg(F.count(F.lit(1)).alias("n"), F.count("citation_corpus_id").alias("n_resolved"), F.countDistinct("citation_key").alias("n_keys"))
    return df.filter("n_resolved >= 4")


@query("SELECT arxiv_id, token, citation_key, pos FROM (SELECT *, row_number() OVER (PARTITION BY arxiv_id, regexp_extract(token, '_(\\d+)', 1) ORDER BY pos, loaded_at, citation_key) AS r FROM citations WHERE starts_with(token, '<|multi') AND citation_corpus_id IS NOT NULL) WHERE r = 1")
def first_of_multi_cite(spark: SparkSession, d: str) -> DataFrame:
    """WN-6: the first resolved citation of each group."""
    df = table(spark, d, "citations").filter(F.col("token").startswith("<|multi") & F.col("citation_corpus_id").isNotNull())
    best = df.groupBy("arxiv_id", F.regexp_extract("token", r"_(\d+)", 1).alias("g")).agg(F.min(F.struct("pos", "loaded_at", "citation_key", "token")).alias("m"))
    return best.select("arxiv_id", "m.token", "m.citation_key", "m.pos")


@query("SELECT doc_id FROM documents ORDER BY md5('seed|' || doc_id), doc_id LIMIT 100")
def head_sample(spark: SparkSession, d: str) -> DataFrame:
    """TK-8: a sample of 100 documents in a reproducible random order; the limit is the feature."""
    return rows.take_by_hash(table(spark, d, "documents"), 100, "seed", F.col("doc_id")).select("doc_id")


@query("""WITH r AS (SELECT DISTINCT row_id, arxiv_id FROM train_rows), e AS (SELECT row_id FROM r ORDER BY md5('eval|' || row_id), row_id LIMIT 50)
  SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM e) THEN 'eval' ELSE 'train' END AS part, arxiv_id LIKE '24%' AS by_month FROM r""")
def train_eval_split(spark: SparkSession, d: str) -> DataFrame:
    """TK-7: fifty rows in hash order for evaluation, and the split by month beside it. The list of the fifty is broadcast."""
    df = table(spark, d, "train_rows").select("row_id", "arxiv_id").distinct()
    held = rows.take_by_hash(df, 50, "eval", F.col("row_id")).select("row_id", F.lit(True).alias("_held"))
    part = F.when(F.col("_held"), "eval").otherwise("train")
    return df.join(F.broadcast(held), "row_id", "left").select("row_id", part.alias("part"), F.col("arxiv_id").like("24%").alias("by_month"))


@query("""WITH r AS (SELECT DISTINCT row_id, targets FROM train_rows WHERE targets IS NOT NULL), i AS (SELECT row_id, unnest(range(len(targets))) AS i FROM r),
  p AS (SELECT row_id, i, row_number() OVER (PARTITION BY row_id ORDER BY md5('pick|' || row_id || '|' || i), i) AS k FROM i)
  SELECT row_id, list(i ORDER BY i) AS picked FROM p WHERE k <= 4 GROUP BY row_id UNION ALL SELECT row_id, [] FROM r WHERE len(targets) = 0""")
def sample_targets_md5(spark: SparkSession, d: str) -> DataFrame:
    """TK-6, AR-5: four targets of each row in hash order."""
    df = table(spark, d, "train_rows").select("row_id", "targets").distinct().filter(F.col("targets").isNotNull())
    return df.select("row_id", rows.pick_items(F.col("targets"), 4, "pick", F.col("row_id")).cast("array<bigint>").alias("picked"))


@query("SELECT batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM documents) GROUP BY batch")
def chunk_by_rows(spark: SparkSession, d: str) -> DataFrame:
    """SK-2, WN-7: batches of 64 rows in order."""
    df = rows.batches_of(table(spark, d, "documents").select("doc_id"), [F.col("doc_id")], 64)
    return df.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT i // CAST(ceil(n / 50.0) AS BIGINT) AS part, count(*) AS n, min(doc_id) AS first_id FROM n GROUP BY 1")
def chunk_into_parts(spark: SparkSession, d: str) -> DataFrame:
    """SK-3, AR-16: fifty contiguous parts."""
    return rows.split_into(table(spark, d, "documents").select("doc_id"), [F.col("doc_id")], 50).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("""WITH s AS (SELECT doc_id, coalesce(strlen(text), 0) AS b, coalesce(sum(coalesce(strlen(text), 0)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
  SELECT CAST(before // 100000 AS BIGINT) AS batch, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM s GROUP BY 1""")
def chunk_by_bytes(spark: SparkSession, d: str) -> DataFrame:
    """SK-4: contiguous batches of about 100 kB."""
    df = rows.batches_by_bytes(table(spark, d, "documents").select("doc_id", "text"), [F.col("doc_id")], "text", 100_000)
    return df.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))


@query("SELECT DISTINCT corpus_id, md5('<|reference_start|>' || title || ': ' || replace(replace(abstract, '<|reference_start|>', ''), '<|reference_end|>', '') || '<|reference_end|>') AS text_md5, coalesce(paper_id, corpus_id) AS any_id FROM corpus_data WHERE source = 'arxiv' AND length(abstract) > 10")
def reference_corpus(spark: SparkSession, d: str) -> DataFrame:
    """PJ-1, PJ-3, PJ-12, FI-5, FI-9: the corpus as reference texts."""
    bare = F.replace(F.replace("abstract", F.lit("<|reference_start|>"), F.lit("")), F.lit("<|reference_end|>"), F.lit(""))
    text = F.concat(F.lit("<|reference_start|>"), "title", F.lit(": "), bare, F.lit("<|reference_end|>"))
    df = table(spark, d, "corpus_data").filter((F.col("source") == "arxiv") & (F.length("abstract") > 10))
    return df.select("corpus_id", F.md5(text).alias("text_md5"), F.coalesce("paper_id", "corpus_id").alias("any_id")).distinct()


@query("""WITH p AS (SELECT DISTINCT arxiv_id, title, abstract FROM arxiv_metadata) SELECT arxiv_id, md5('<|paper_start|> \\title{' || coalesce(title, '') || '}' || chr(10) || '\\maketitle' || chr(10) || '\\begin{abstract}' || chr(10) || coalesce(abstract, '') || chr(10) || '\\end{abstract}' || chr(10)) AS paper_md5 FROM p""".replace("\\\\", "\\"))
def paper_template(spark: SparkSession, d: str) -> DataFrame:
    """PJ-6, PJ-7: the frame of a paper; missing parts are empty."""
    p = table(spark, d, "arxiv_metadata").select("arxiv_id", "title", "abstract").distinct()
    part = lambda c: F.coalesce(c, F.lit(""))
    text = F.concat(F.lit("<|paper_start|> \\title{"), part("title"), F.lit("}\n\\maketitle\n\\begin{abstract}\n"), part("abstract"), F.lit("\n\\end{abstract}\n"))
    return p.select("arxiv_id", F.md5(text).alias("paper_md5"))


@query("""WITH c AS (SELECT DISTINCT corpus_id, title || ': ' || abstract AS x FROM corpus_data WHERE length(abstract) > 10) SELECT corpus_id, md5(' <|cite_start|> (Reference: ' || x || ') <|cite_end|>') AS span_md5, md5(' <|reference_start|> ' || x || ' <|reference_end|>') AS target_md5 FROM c WHERE NOT contains(x, '<|')""")
def reference_spans(spark: SparkSession, d: str) -> DataFrame:
    """PJ-2, PJ-4, PJ-5: citation spans and the targets made of them."""
    c = table(spark, d, "corpus_data").filter(F.length("abstract") > 10).select("corpus_id", F.concat("title", F.lit(": "), "abstract").alias("x")).distinct()
    c = c.filter(F.col("x").isNotNull() & ~F.contains("x", F.lit("<|")))
    return c.select("corpus_id", F.md5(reference_span(F.col("x"))).alias("span_md5"), F.md5(as_reference(reference_span(F.col("x")))).alias("target_md5"))


@query("""WITH f AS (SELECT arxiv_id, pos, min((loaded_at, (token, citation_key, title, raw, kind, citation_corpus_id, message, extracted_at))) AS m FROM citations WHERE title IS NOT NULL GROUP BY 1, 2),
  e AS (SELECT arxiv_id, list((m[2][1], m[2][3]) ORDER BY pos) AS entries FROM f GROUP BY 1), p AS (SELECT DISTINCT part_id, arxiv_id, intro FROM parsed_parts WHERE intro IS NOT NULL),
  t AS (SELECT part_id, CASE WHEN entries IS NULL THEN intro ELSE list_reduce(list_transform(entries, lambda e: [e[1], e[2]]), lambda acc, e: [replace(acc[1], e[1], e[2])], [intro])[1] END AS full_text FROM p LEFT JOIN e USING (arxiv_id))
  SELECT part_id, CAST(length(full_text) AS INTEGER) AS n_chars, md5(full_text) AS text_md5 FROM t""")
def fill_citations(spark: SparkSession, d: str) -> DataFrame:
    """AR-2, AR-3, AR-4: introductions with the titles of their citations in place of the tokens."""
    cited = rows.first_wins(table(spark, d, "citations").filter(F.col("title").isNotNull()), ["arxiv_id", "pos"], ["loaded_at"])
    maps = cited.groupBy("arxiv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token", F.col("title").alias("value")))).alias("entries"))
    maps = maps.select("arxiv_id", F.transform("entries", lambda e: F.struct(e.token.alias("token"), e.value.alias("value"))).alias("entries"))
    parts = table(spark, d, "parsed_parts").select("part_id", "arxiv_id", "intro").filter(F.col("intro").isNotNull()).distinct()
    full = assembly.fill_tokens(F.col("intro"), F.col("entries"))
    return parts.join(maps, "arxiv_id", "left").select("part_id", F.length(full).alias("n_chars"), F.md5(full).alias("text_md5"))


_SPACE = "[\\t-\\r\\x1c-\\x1f \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_TOKENS_OF = lambda x: f"len(list_filter(string_split_regex({x}, '{_SPACE}+'), lambda w: w <> ''))"


@query(rf"""WITH RECURSIVE p AS (SELECT DISTINCT part_id, intro FROM parsed_parts WHERE length(intro) > 0), w AS (SELECT part_id, intro, {_TOKENS_OF('intro')} AS n FROM p),
  c AS (SELECT part_id, list_filter(list_transform(string_split(regexp_replace(intro, '(<\|(?:cite_\d+|multi_cite_\d+_\d+)\|>)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> '') AS a FROM w WHERE n > 120),
  s AS (SELECT part_id, i, x, {_TOKENS_OF('x')} AS n FROM (SELECT part_id, unnest(a) AS x, unnest(range(len(a))) AS i FROM c)),
  r AS (SELECT part_id, i, x, 0 AS part, n AS used FROM s WHERE i = 0 UNION ALL SELECT s.part_id, s.i, s.x, CASE WHEN r.used + s.n > 120 THEN r.part + 1 ELSE r.part END, CASE WHEN r.used + s.n > 120 THEN s.n ELSE r.used + s.n END FROM r JOIN s ON s.part_id = r.part_id AND s.i = r.i + 1),
  g AS (SELECT part_id, part, string_agg(x, '' ORDER BY i) AS paper FROM r GROUP BY 1, 2 UNION ALL SELECT part_id, 0, intro FROM w WHERE n <= 120)
  SELECT part_id, CAST(part AS INTEGER) AS part, CAST(count(*) OVER (PARTITION BY part_id) AS INTEGER) AS n_parts, CAST({_TOKENS_OF('paper')} AS INTEGER) AS n_tokens, md5(paper) AS paper_md5 FROM g""")
def segment_tokens(spark: SparkSession, d: str) -> DataFrame:
    """WN-3, AR-13, FI-7: introductions and their citations as segments of at most 120 tokens."""
    parts = table(spark, d, "parsed_parts").select("part_id", "intro").distinct()
    return assembly.segments(parts, "part_id", "intro", 120).select("part_id", "part", "n_parts", "n_tokens", F.md5("paper").alias("paper_md5"))


@query()
def segment_to_citation(spark: SparkSession, d: str) -> DataFrame:
    """WN-4: introductions as segments of at most 120 tokens that go back to their last citation; tested against known cuts."""
    parts = table(spark, d, "parsed_parts").select("part_id", "intro").distinct()
    return assembly.segments(parts, "part_id", "intro", 120, back=True).select("part_id", "part", "n_parts", "n_tokens", F.md5("paper").alias("paper_md5"))


@query("""WITH r AS (SELECT DISTINCT row_id, paper, targets, targets_idx FROM train_rows), n AS (SELECT *, len(regexp_extract_all(coalesce(paper, ''), '<\\|cite_start\\|>')) AS s, len(regexp_extract_all(coalesce(paper, ''), '<\\|cite_end\\|>')) AS e FROM r)
  SELECT row_id, list_filter([CASE WHEN coalesce(len(targets), -1) <> 4 THEN 'targets' END, CASE WHEN coalesce(len(targets_idx), -1) <> 4 THEN 'indexes' END, CASE WHEN s < 4 OR e < 4 THEN 'few_spans' END, CASE WHEN s <> e THEN 'unpaired' END,
    CASE WHEN list_max(targets_idx) >= s THEN 'out_of_range' END, CASE WHEN len(list_filter(targets, lambda t: t IS NULL)) > 0 THEN 'null_target' END], lambda x: x IS NOT NULL) AS faults FROM n""")
def integrity_check(spark: SparkSession, d: str) -> DataFrame:
    """FI-13: what is wrong with each training row."""
    r = table(spark, d, "train_rows").select("row_id", "paper", "targets", "targets_idx").distinct()
    return r.select("row_id", assembly.training_row_faults(F.col("paper"), F.col("targets"), F.col("targets_idx")).alias("faults"))


_MASK = """WITH p AS (SELECT DISTINCT row_id, list_filter(string_split(paper, ' '), lambda t: t <> '') AS w FROM train_rows WHERE paper IS NOT NULL), t AS (SELECT row_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM p),
  m AS (SELECT row_id, i, t, last_value(CASE WHEN t IN ('<|cite_start|>', '<|cite_end|>') THEN t END IGNORE NULLS) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM t)
  SELECT row_id, count(*) AS n, count_if(last IS DISTINCT FROM '<|cite_start|>') AS n_labels FROM m GROUP BY row_id"""


@query(_MASK)
def label_mask(spark: SparkSession, d: str) -> DataFrame:
    """AR-9: tokens that are labels, those within citation spans not counted."""
    p = table(spark, d, "train_rows").filter(F.col("paper").isNotNull()).select("row_id", F.filter(F.split("paper", " "), lambda t: t != "").alias("w")).distinct().filter(F.size("w") > 0)
    mask = assembly.label_mask(F.col("w"))
    return p.select("row_id", F.size("w").cast("long").alias("n"), F.size(F.filter(mask, lambda m: m)).cast("long").alias("n_labels"))


@query("""WITH p AS (SELECT DISTINCT row_id, targets_idx, list_filter(string_split(paper, ' '), lambda t: t <> '') AS w FROM train_rows WHERE paper IS NOT NULL AND targets_idx IS NOT NULL),
  m AS (SELECT row_id, targets_idx, list_filter(list_transform(w, lambda t, i: CASE WHEN t = '<|cite_start|>' THEN i - 1 END), lambda i: i IS NOT NULL) AS places FROM p)
  SELECT row_id, len(places) AS n, list_transform(targets_idx, lambda k: places[k + 1]) AS picked FROM m""")
def marker_positions(spark: SparkSession, d: str) -> DataFrame:
    """AR-10: where the citation spans of a paper begin that its targets name."""
    p = table(spark, d, "train_rows").filter("paper is not null and targets_idx is not null").select("row_id", "targets_idx", F.filter(F.split("paper", " "), lambda t: t != "").alias("w")).distinct()
    at = lambda picks=None: assembly.marker_positions(F.col("w"), "<|cite_start|>", picks)
    return p.select("row_id", F.size(at()).cast("long").alias("n"), at(F.col("targets_idx")).cast("array<bigint>").alias("picked"))


@query("SELECT raw_id, json_extract_string(payload, '$.paperId') AS paper_id, try_cast(json_extract_string(payload, '$.matchScore') AS DOUBLE) AS score FROM (SELECT DISTINCT raw_id, payload FROM lookup_raw) WHERE json_valid(payload)")
def lookup_payloads(spark: SparkSession, d: str) -> DataFrame:
    """AR-1: fields of JSON payloads; cut-off ones are left out."""
    rec = F.from_json("payload", "paperId string, matchScore double, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    df = table(spark, d, "lookup_raw").select("raw_id", "payload").distinct().select("raw_id", rec.alias("r"))
    return df.filter("r is not null and r._corrupt is null").select("raw_id", F.col("r.paperId").alias("paper_id"), F.col("r.matchScore").alias("score"))


@query("SELECT doc_id, md5(text) AS text_md5, to_base64(encode(text)) AS b64, CASE WHEN strlen(text) < 1024 THEN strlen(text) || ' B' ELSE (strlen(text) // 1024) || ' KB' END AS size, true AS same FROM documents WHERE text IS NOT NULL")
def base64_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """AR-14, AR-15, ST-43: hashes and Base64 without line breaks, and whether each text comes back the same."""
    b64 = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"[\r\n]", "")
    n = F.octet_length("text")
    size = byte_size(n)
    df = table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", "text", b64.alias("b64"), size.alias("size"))
    return df.select("doc_id", F.md5("text").alias("text_md5"), "b64", "size", (F.decode(F.unbase64("b64"), "UTF-8") == F.col("text")).alias("same"))


@query("SELECT arxiv_id, string_agg(raw, chr(10) || chr(10) ORDER BY pos) AS history FROM (SELECT arxiv_id, raw, min(pos) AS pos FROM citations WHERE raw IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def bibtex_history(spark: SparkSession, d: str) -> DataFrame:
    """SK-14, AG-11, SE-2: distinct entries of a paper in first-seen order."""
    first = table(spark, d, "citations").filter(F.col("raw").isNotNull()).groupBy("arxiv_id", "raw").agg(F.min("pos").alias("pos"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda e: e.raw), "\n\n")
    return first.groupBy("arxiv_id").agg(joined.alias("history"))


@query("""SELECT part_id, len(u) AS n_items, md5(array_to_string(u, '|')) AS items_md5 FROM (SELECT part_id, list_filter(v, lambda x, i: list_position(v, x) = i) AS u FROM (SELECT part_id, list_filter(list_concat(coalesce(bib_items, []), coalesce(bbl_items, [])), lambda x: x IS NOT NULL) AS v FROM (SELECT DISTINCT part_id, bib_items, bbl_items FROM parsed_parts)))""")
def item_union(spark: SparkSession, d: str) -> DataFrame:
    """SE-2, JN-16: distinct items of both kinds, in the order of their first occurrence."""
    p = table(spark, d, "parsed_parts").select("part_id", "bib_items", "bbl_items").distinct()
    none = F.array().cast("array<string>")
    both = F.filter(F.array_union(F.coalesce("bib_items", none), F.coalesce("bbl_items", none)), lambda x: x.isNotNull())
    return p.select("part_id", F.size(both).cast("long").alias("n_items"), F.md5(F.array_join(both, "|")).alias("items_md5"))


@query("SELECT DISTINCT doc_id, strlen(text) >= 0 AS has_text, length(text) >= 100 AS long_enough FROM documents")
def short_documents(spark: SparkSession, d: str) -> DataFrame:
    """FI-10: documents of at least 100 characters; null where there is no text."""
    return table(spark, d, "documents").select("doc_id", (F.octet_length("text") >= 0).alias("has_text"), (F.length("text") >= 100).alias("long_enough")).distinct()


@query("WITH i AS (SELECT DISTINCT part_id, concat_ws(chr(10), intro, related_work, other_tex) AS t, unnest([intro, title]) AS x FROM parsed_parts) SELECT part_id, md5(x) AS part_md5, coalesce(x <> '' AND strpos(t, x) > 0 AND strpos(substr(t, strpos(t, x) + 1), x) = 0, false) AS once, coalesce(length(x) > 0, false) AS filled FROM i")
def unique_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """FI-14: whether the introduction and the title occur once in the whole paper."""
    from scholarmill.functions.latex import occurs_once

    p = table(spark, d, "parsed_parts").select("part_id", F.concat_ws("\n", "intro", "related_work", "other_tex").alias("t"), F.explode(F.array("intro", "title")).alias("x")).distinct()
    return p.select("part_id", F.md5("x").alias("part_md5"), occurs_once(F.col("t"), F.col("x")).alias("once"), F.coalesce(F.length("x") > 0, F.lit(False)).alias("filled"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(ts) AS last_ts, min_by(event_id, (ts, event_id)) AS first_event FROM events GROUP BY event_type")
def events_state(spark: SparkSession, d: str) -> DataFrame:
    """The state that a stream of events ends in; the stream is tested to reach it."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("last_ts"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"))


@query("""WITH a AS (SELECT arxiv_id, min(abstract) AS abstract FROM arxiv_metadata WHERE abstract IS NOT NULL GROUP BY 1), c AS (SELECT paper_id, min(title) AS title FROM corpus_data WHERE title IS NOT NULL GROUP BY 1)
  SELECT arxiv_id, title, md5(abstract) AS abstract_md5 FROM a JOIN c ON c.paper_id = a.arxiv_id""")
def papers_with_abstracts(spark: SparkSession, d: str) -> DataFrame:
    """JN-1: papers and abstracts, one of each for an id."""
    a = table(spark, d, "arxiv_metadata").filter(F.col("abstract").isNotNull()).groupBy("arxiv_id").agg(F.min("abstract").alias("abstract"))
    c = table(spark, d, "corpus_data").filter(F.col("title").isNotNull()).groupBy(F.col("paper_id").alias("arxiv_id")).agg(F.min("title").alias("title"))
    return a.join(c, "arxiv_id").select("arxiv_id", "title", F.md5("abstract").alias("abstract_md5"))


@query("""WITH c AS (SELECT DISTINCT arxiv_id, pos, raw FROM citations WHERE raw IS NOT NULL) SELECT arxiv_id, pos, md5('Extract the title of the cited work.' || chr(10) || chr(10) || 'Item: a' || chr(10) || 'Title: b' || chr(10) || chr(10) || 'Item: ' || raw || chr(10) || 'Title:') AS prompt_md5, string_split(raw, chr(10))[1] AS first FROM c""")
def title_prompts(spark: SparkSession, d: str) -> DataFrame:
    """PJ-8, PJ-9, UD-1: prompts that ask for titles, and first lines."""
    c = table(spark, d, "citations").filter(F.col("raw").isNotNull()).select("arxiv_id", "pos", "raw").distinct()
    return c.select("arxiv_id", "pos", F.md5(few_shot(F.col("raw"), [("a", "b")])).alias("prompt_md5"), first_line(F.col("raw")).alias("first"))


@query("""SELECT DISTINCT row_id, len(list_filter(targets, lambda t: contains(t, '<|reference_start|>'))) AS n, md5(array_to_string(list_transform(list_filter(targets, lambda t: t IS NOT NULL), lambda t: replace(replace(t, '<|reference_start|>', '<|reference_start|> '), '<|reference_end|>', ' <|reference_end|>')), '|')) AS spaced_md5 FROM train_rows WHERE targets IS NOT NULL""")
def spaced_targets(spark: SparkSession, d: str) -> DataFrame:
    """PJ-2: targets with blanks inside their markers."""
    r = table(spark, d, "train_rows").filter(F.col("targets").isNotNull()).select("row_id", "targets").distinct()
    some = F.filter("targets", lambda t: t.isNotNull())
    return r.select("row_id", F.size(F.filter(some, lambda t: F.contains(t, F.lit("<|reference_start|>")))).cast("long").alias("n"), F.md5(F.array_join(F.transform(some, spaced_markers), "|")).alias("spaced_md5"))


@query("SELECT doc_id % 8 AS shard, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def encode_shards(spark: SparkSession, d: str) -> DataFrame:
    """SC-14: rows by shard, for encoders that work beside each other."""
    return table(spark, d, "documents").groupBy((F.col("doc_id") % 8).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE r BETWEEN 11 AND 20")
def row_slice(spark: SparkSession, d: str) -> DataFrame:
    """FI-15: rows 11 to 20 in order; the slice is the feature."""
    return rows.number_rows(table(spark, d, "documents").select("doc_id"), [F.col("doc_id")]).filter("row_no between 11 and 20").select("doc_id")


@query("""WITH p AS (SELECT DISTINCT part_id, arxiv_id, intro FROM parsed_parts WHERE intro IS NOT NULL), c AS (SELECT DISTINCT arxiv_id, token FROM citations)
  SELECT part_id, list(token ORDER BY strpos(intro, token), token) AS in_order FROM p JOIN c USING (arxiv_id) WHERE strpos(intro, token) > 0 GROUP BY part_id""")
def tokens_in_order(spark: SparkSession, d: str) -> DataFrame:
    """TK-10: a paper's citation tokens by where the introduction has them."""
    c = table(spark, d, "citations").select("arxiv_id", "token").distinct()
    p = table(spark, d, "parsed_parts").filter(F.col("intro").isNotNull()).select("part_id", "arxiv_id", "intro").distinct()
    hits = p.join(c, "arxiv_id").select("part_id", F.struct(F.call_function("locate", F.col("token"), F.col("intro")).alias("at"), "token").alias("h")).filter("h.at > 0")
    return hits.groupBy("part_id").agg(F.transform(F.array_sort(F.collect_list("h")), lambda h: h.token).alias("in_order"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean_value, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2")
def events_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Events by day: an addition of this engine, the batch form of the windowed stream."""
    e = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type")
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.countDistinct("user_id").alias("n_users"))


@query("""SELECT DISTINCT arxiv_id, trim(regexp_replace(translate(regexp_replace(title, '[\\x00-\\x20\\x7f\\x{A0}]', ' ', 'g'), '{}.', ''), ' {2,}', ' ', 'g')) AS title, md5('<|reference_start|>' || replace(abstract, chr(10), ' ') || '<|reference_end|>') AS text_md5 FROM arxiv_metadata WHERE contains(replace(lower(categories), 'physics', ''), 'cs.') AND length(abstract) > 10""")
def corpus_by_category(spark: SparkSession, d: str) -> DataFrame:
    """PJ-3, FI-1, ST-12: papers of computer science as reference texts, titles cleaned, abstracts on one line."""
    m = table(spark, d, "arxiv_metadata").filter(F.contains(F.replace(F.lower("categories"), F.lit("physics"), F.lit("")), F.lit("cs.")) & (F.length("abstract") > 10))
    text = F.concat(F.lit("<|reference_start|>"), F.replace("abstract", F.lit("\n"), F.lit(" ")), F.lit("<|reference_end|>"))
    return m.select("arxiv_id", F.trim(display_title(F.col("title"))).alias("title"), F.md5(text).alias("text_md5")).distinct()


@query("SELECT DISTINCT arxiv_id, title FROM arxiv_metadata WHERE regexp_matches(arxiv_id, '^24[0-9]{2}')")
def month_shard(spark: SparkSession, d: str) -> DataFrame:
    """FI-8: the papers of a shard of months, which is the feature."""
    return table(spark, d, "arxiv_metadata").filter(yymm(F.col("arxiv_id")).rlike("^24[0-9]{2}$")).select("arxiv_id", "title").distinct()


@query("""SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (n // 1024) || ' KB' WHEN n < 1073741824 THEN (n // 1048576) || ' MB' ELSE (n // 1073741824) || ' GB' END AS size FROM (SELECT o_orderkey, CAST(floor(pow(2, o_orderkey % 40)) AS BIGINT) + o_orderkey AS n FROM orders)""")
def byte_sizes(spark: SparkSession, d: str) -> DataFrame:
    """ST-43: sizes in bytes up to gigabytes."""
    n = F.floor(F.pow(F.lit(2), F.col("o_orderkey") % 40)).cast("long") + F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", byte_size(n).alias("size"))


@query("""WITH c AS (SELECT DISTINCT citation_key || title || citation_key AS k, 'https://x.y/' || id AS u FROM bibtex)
  SELECT k, CASE WHEN length(k) > 110 THEN substr(k, 1, 105) || '...  ' ELSE k END || repeat(' ', greatest(0, 150 - least(length(k), 110) - length(u))) || u AS label FROM c""")
def citation_labels(spark: SparkSession, d: str) -> DataFrame:
    """PJ-10: long keys cut, padded so that key and address fill a line."""
    c = table(spark, d, "bibtex").select(F.concat("citation_key", "title", "citation_key").alias("k"), F.concat(F.lit("https://x.y/"), "id").alias("u")).distinct()
    return c.select("k", citation_label(F.col("k"), F.col("u")).alias("label"))
