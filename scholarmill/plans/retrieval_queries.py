"""Queries of retrieval: exact and approximate nearest vectors, BM25, labels."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmill.functions.bib import bibtex
from scholarmill.functions.vectors import dot, l2_normalize, last_token_pool
from scholarmill.operators import retrieval
from scholarmill.operators.rows import number_rows
from scholarmill.plans.registry import query
from scholarmill.plans.stage import place
from scholarmill.sources.tables import table

K = 5
_TOP = """
  WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  n AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS len FROM v),
  s AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_inner_product(q.e, d.e) / (q.len * d.len), 6) AS score
        FROM n q, n d WHERE q.vec_id % 20 = 0),
  t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def _queries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries every vector whose id is divisible by 20."""
    v = table(spark, d, "embeddings")
    return v, v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(_TOP + " SELECT query_id, vec_id, score, rank FROM t WHERE rank <= 5")
def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    """TK-1: the nearest five vectors of each query, by cosine."""
    return retrieval.top_k_cosine(*_queries(spark, d), K)


_DOCS = ", docs AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS vec_id, doc_id, source, lang, n_chars, text FROM documents)"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents by position: the i-th by id is that of vector i."""
    numbered = number_rows(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", (F.length("text") > 0).alias("has_text")), [F.col("doc_id")])
    return numbered.withColumn("vec_id", F.col("row_no") - 1).drop("row_no")


@query(_TOP + _DOCS + " SELECT query_id, t.vec_id, score, rank, doc_id, source, lang, n_chars FROM t LEFT JOIN docs ON docs.vec_id = t.vec_id WHERE rank <= 5")
def topk_with_metadata(spark: SparkSession, d: str) -> DataFrame:
    """TK-1, JN-11: the nearest vectors with their documents; a vector without a document keeps its row."""
    return topk_cosine(spark, d).join(_documents(spark, d), "vec_id", "left").select("query_id", "vec_id", "score", "rank", "doc_id", "source", "lang", "n_chars")


@query(_TOP + _DOCS + ", r AS (SELECT query_id, docs.vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pick FROM t JOIN docs ON docs.vec_id = t.vec_id WHERE rank <= 5 AND length(text) > 0) SELECT query_id, vec_id, score FROM r WHERE pick = 1")
def rerank_first(spark: SparkSession, d: str) -> DataFrame:
    """TK-5: of the candidates with metadata the first."""
    best = topk_cosine(spark, d).join(_documents(spark, d).filter("has_text").select("vec_id"), "vec_id").groupBy("query_id").agg(F.min(F.struct("rank", "vec_id", "score")).alias("m"))
    return best.select("query_id", "m.vec_id", "m.score")


def _index(spark: SparkSession, d: str) -> tuple[retrieval.InvertedFile, DataFrame]:
    """The index of all vectors, written to the shared folder and loaded from there."""
    at = place(spark, "index")
    v = table(spark, d, "embeddings")
    retrieval.InvertedFile.fit(v).build(v, at)
    return retrieval.InvertedFile.load(spark, at)


@query()
def topk_approximate(spark: SparkSession, d: str) -> DataFrame:
    """TK-2, SK-11: nearest vectors from a persisted inverted file; topk_recall compares it with topk_cosine."""
    index, lists = _index(spark, d)
    return index.search_lists(lists, _queries(spark, d)[1], K)


@query("SELECT count(*) AS n_queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def topk_recall(spark: SparkSession, d: str) -> DataFrame:
    """TK-2: whether the persisted index finds at least nine tenths of the nearest vectors that exact search finds."""
    near = topk_approximate(spark, d).select("query_id", "vec_id", F.lit(1).alias("hit"))
    each = topk_cosine(spark, d).join(near, ["query_id", "vec_id"], "left")
    return each.agg(F.count_distinct("query_id").alias("n_queries"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


@query("""
  WITH v AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  u AS (SELECT label, e, sqrt(list_inner_product(e, e)) AS len FROM v)
  SELECT label, count(*) AS n, round(avg(e[1] / len), 6) AS mean_first, round(avg(list_inner_product(e, e) / (len * len)), 6) AS mean_norm FROM u GROUP BY label""")
def unit_vectors_by_label(spark: SparkSession, d: str) -> DataFrame:
    """AR-6: unit vectors, summed up by label."""
    df = table(spark, d, "embeddings").select("label", l2_normalize(F.col("embedding")).alias("u"))
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.get("u", F.lit(0))), 6).alias("mean_first"), F.round(F.avg(dot(F.col("u"), F.col("u"))), 6).alias("mean_norm"))


@query(_TOP + """ SELECT l.label, round(avg(t.score), 6) AS mean_score, count(*) AS n FROM t JOIN embeddings l ON l.vec_id = t.query_id WHERE rank <= 5 GROUP BY l.label""")
def similarity_label_stats(spark: SparkSession, d: str) -> DataFrame:
    """AG-7: mean similarity of the nearest vectors by the query's label."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    return topk_cosine(spark, d).join(labels, "query_id").groupBy("label").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count(F.lit(1)).alias("n"))


@query(_TOP + """, x AS (SELECT query_id, max(score) FILTER (WHERE vec_id <> query_id) AS best, ln(sum(exp(score / 0.5)) FILTER (WHERE vec_id <> query_id)) - max(score) FILTER (WHERE vec_id <> query_id) / 0.5 AS loss FROM t GROUP BY query_id) SELECT query_id, best, round(loss, 5) AS loss FROM x""")
def contrastive_loss(spark: SparkSession, d: str) -> DataFrame:
    """AR-8: softmax cross-entropy of each query, its nearest other row the positive and all other rows the negatives."""
    v, q = _queries(spark, d)
    return retrieval.softmax_loss(v, q, 0.5).select("query_id", "best", F.round("loss", 5).alias("loss"))


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(e, e)) AS len FROM v)
  SELECT a.vec_id AS query_id, d.vec_id, round(list_inner_product(a.e, d.e) / (a.len * d.len), 6) AS similarity FROM n a JOIN n d ON a.label = d.label WHERE a.vec_id % 20 = 0""")
def similarity_matrix(spark: SparkSession, d: str) -> DataFrame:
    """AR-7: the similarities of each query and the rows of its batch, which its label stands for."""
    v = table(spark, d, "embeddings")
    unit = v.select("vec_id", "label", l2_normalize(F.col("embedding")).alias("u"))
    q = unit.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("u").alias("w"))
    return unit.join(q, "label").select("query_id", "vec_id", F.round(dot(F.col("u"), F.col("w")), 6).alias("similarity"))


@query("""
  WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  SELECT label, round((sum(CASE WHEN vec_id % 3 <> 0 THEN e[1] END) / count(CASE WHEN vec_id % 3 <> 0 THEN 1 END)), 6) AS pooled_first, round((sum(CASE WHEN vec_id % 3 <> 0 THEN e[64] END) / count(CASE WHEN vec_id % 3 <> 0 THEN 1 END)), 6) AS pooled_last FROM v GROUP BY label""")
def masked_mean_pooling(spark: SparkSession, d: str) -> DataFrame:
    """AR-12: the mean of a label's unmasked vectors, summed up position by position, so a label may hold any number of them."""
    df = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 3 != 0).alias("keep"), F.posexplode("embedding").alias("pos", "x"))
    means = df.groupBy("label", "pos").agg(F.avg(F.when(F.col("keep"), F.col("x").cast("double"))).alias("m"))
    pooled = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p.m).alias("p"))
    return pooled.select("label", F.round(F.get("p", F.lit(0)), 6).alias("pooled_first"), F.round(F.element_at("p", -1), 6).alias("pooled_last"))


@query("""WITH e AS (SELECT vec_id, embedding[:8] AS a, embedding[9:16] AS b, embedding[17:24] AS c FROM embeddings)
  SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN NULL WHEN 1 THEN a[1] WHEN 2 THEN b[1] ELSE c[1] END AS pooled_first FROM e""")
def last_token_pooling(spark: SparkSession, d: str) -> DataFrame:
    """AR-11: the vector of the last unmasked token; each row's slices stand for three tokens of which the first id % 4 are unmasked."""
    tokens = F.array(*[F.slice("embedding", 8 * k + 1, 8) for k in range(3)])
    mask = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: (k < F.col("vec_id") % 4).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", F.get(last_token_pool(tokens, mask), F.lit(0)).alias("pooled_first"))


_BM25 = """
  WITH d AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
  q AS (SELECT item_id AS query_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM test_items),
  p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2),
  f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  n AS (SELECT count(*) AS n, avg(len(w)) AS m FROM d),
  i AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM f, n),
  e AS (SELECT avg(idf) * 0.25 AS floor FROM i),
  g AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(w) AS term FROM q) GROUP BY 1, 2),
  s AS (SELECT query_id, p.doc_id, round(sum(qf * CASE WHEN idf < 0 THEN floor ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / m))), 6) AS score
        FROM g JOIN i USING (term) JOIN p USING (term) JOIN d ON d.doc_id = p.doc_id, n, e GROUP BY 1, 2),
  b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0)
  SELECT query_id, doc_id, round(score, 3) AS score FROM b WHERE r = 1"""


def _bm25_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from scholarmill.functions.titles import normalize_title

    text = normalize_title(F.col("text")).alias("text")
    return table(spark, d, "documents").select("doc_id", text), table(spark, d, "test_items").select(F.col("item_id").alias("query_id"), text)


@query(_BM25)
def bm25_top1(spark: SparkSession, d: str) -> DataFrame:
    """TK-3, AG-10: the best document of each test item by Okapi BM25."""
    best = retrieval.bm25_best(*_bm25_inputs(spark, d))
    return best.select("query_id", "doc_id", F.round("score", 3).alias("score"))


@query(_BM25.replace("tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / m))", "tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len(w) / m))"))
def bm25_lucene_top1(spark: SparkSession, d: str) -> DataFrame:
    """TK-4: the same with the parameters of a Lucene index."""
    best = retrieval.bm25_best(*_bm25_inputs(spark, d), k1=0.9, b=0.4)
    return best.select("query_id", "doc_id", F.round("score", 3).alias("score"))


_TITLE_BM25 = """
  WITH n0 AS (SELECT DISTINCT corpus_id AS doc_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS x FROM corpus_data),
  q0 AS (SELECT DISTINCT lookup_id AS query_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS x FROM title_lookup),
  x AS (SELECT x, min(doc_id) AS doc_id FROM n0 WHERE x <> '' GROUP BY x),
  d AS (SELECT doc_id, list_filter(string_split(coalesce(x, ''), ' '), lambda t: t <> '') AS w FROM n0),
  q AS (SELECT query_id, list_filter(string_split(coalesce(x, ''), ' '), lambda t: t <> '') AS w FROM q0 WHERE x IS NULL OR x NOT IN (SELECT x FROM x)),
  p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2),
  f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), n AS (SELECT count(*) AS n, avg(len(w)) AS m FROM d),
  i AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM f, n), e AS (SELECT avg(idf) * 0.25 AS floor FROM i),
  g AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(w) AS term FROM q) GROUP BY 1, 2),
  s AS (SELECT query_id, p.doc_id, round(sum(qf * CASE WHEN idf < 0 THEN floor ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / m))), 6) AS score
        FROM g JOIN i USING (term) JOIN p USING (term) JOIN d ON d.doc_id = p.doc_id, n, e GROUP BY 1, 2),
  b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0)
  SELECT query_id, x.doc_id, 1.0::DOUBLE AS score, true AS exact FROM q0 JOIN x USING (x) UNION ALL SELECT query_id, doc_id, round(score, 3), false FROM b WHERE r = 1"""


@query(_TITLE_BM25)
def title_search(spark: SparkSession, d: str) -> DataFrame:
    """TK-3, TK-4: lookups in an index of titles only, an exact title first with score 1, else the best by BM25."""
    from scholarmill.functions.titles import normalize_title

    docs = table(spark, d, "corpus_data").select(F.col("corpus_id").alias("doc_id"), "title").distinct()
    asked = table(spark, d, "title_lookup").select(F.col("lookup_id").alias("query_id"), "title").distinct()
    return retrieval.title_first(docs, asked, normalize_title).select("query_id", "doc_id", F.round("score", 3).alias("score"), "exact")


_BIBTEX = """
  WITH m AS (SELECT DISTINCT arxiv_id, title, authors, authors_parsed[1][1] AS last, versions[1].created AS created, journal_ref, doi, report_no, categories FROM arxiv_metadata),
  y AS (SELECT *, coalesce(string_split(trim(string_split(created, ',')[2]), ' ')[3], CASE WHEN contains(journal_ref, ':') THEN trim(string_split(journal_ref, ',')[-1]) END) AS year FROM m),
  k AS (SELECT *, lower(replace(coalesce(last, string_split(trim(string_split(authors, ',')[1]), ' ')[-1]), chr(92), '')) AS name FROM y),
  c AS (SELECT *, CASE WHEN year IS NULL THEN name || '_arxiv' ELSE name || year || string_split(lower(trim(title)), ' ')[1] END AS citation_key FROM k),
  b AS (SELECT *, concat_ws(',' || chr(10), CASE WHEN length(trim(title)) > 0 THEN '    title={' || trim(title) || '}' END,
      CASE WHEN length(authors) > 0 THEN '    author={' || replace(authors, chr(92), '') || '}' END,
      '    journal={' || CASE WHEN length(journal_ref) > 0 THEN journal_ref ELSE 'arXiv preprint arXiv:' || arxiv_id END || '}',
      CASE WHEN length(year) > 0 THEN '    year={' || year || '}' END, CASE WHEN length(doi) > 0 THEN '    doi={' || doi || '}' END,
      CASE WHEN length(report_no) > 0 THEN '    number={' || report_no || '}' END, '    archivePrefix={arXiv}', '    eprint={' || arxiv_id || '}',
      CASE WHEN length(categories) > 0 THEN '    primaryClass={' || categories || '}' END) AS body FROM c)
  SELECT arxiv_id, coalesce(citation_key, arxiv_id) AS citation_key, md5(coalesce('@article{' || citation_key || ',' || chr(10) || body || chr(10) || '}',
    '@article{' || arxiv_id || ',' || chr(10) || '    title={' || coalesce(title, 'Unknown Title') || '},' || chr(10) || '    journal={arXiv preprint arXiv:' || arxiv_id || '},' || chr(10) || '    author={' || coalesce(authors, 'Unknown Authors') || '}' || chr(10) || '}')) AS entry_md5 FROM b"""


def bibtex_entries(spark: SparkSession, d: str) -> DataFrame:
    """ST-42, DT-1, DT-2: a BibTeX entry for each paper."""
    last = F.get(F.get("authors_parsed", F.lit(0)), F.lit(0)).alias("last")
    m = table(spark, d, "arxiv_metadata").select("arxiv_id", "title", "authors", last, F.get("versions", F.lit(0)).created.alias("created"), "journal_ref", "doi", "report_no", "categories").distinct()
    made = bibtex(*[F.col(c) for c in ("arxiv_id", "title", "authors", "last", "created", "journal_ref", "doi", "report_no", "categories")]).alias("_b")
    return m.select("arxiv_id", made).select("arxiv_id", "_b.citation_key", "_b.bibtex")


@query(_BIBTEX)
def bibtex_generate(spark: SparkSession, d: str) -> DataFrame:
    return bibtex_entries(spark, d).select("arxiv_id", "citation_key", F.md5("bibtex").alias("entry_md5"))


@query("""SELECT DISTINCT id, citation_key, length(citation_key) AS n_key, CASE WHEN length(citation_key) > 20 THEN substr(citation_key, 1, 15) || '...  ' ELSE citation_key END
  || repeat(' ', greatest(0, 40 - length(citation_key))) || replace(replace(title, chr(10), ' '), '  ', ' ') AS label FROM bibtex""")
def choice_labels(spark: SparkSession, d: str) -> DataFrame:
    """PJ-10, PJ-11: labels of candidates, long keys cut, padded, titles on one line."""
    key, n = F.col("citation_key"), F.length("citation_key")
    short = F.when(n > 20, F.concat(F.substring(key, 1, 15), F.lit("...  "))).otherwise(key)
    line = F.replace(F.replace(F.col("title"), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))
    return table(spark, d, "bibtex").select("id", "citation_key", n.alias("n_key"), F.concat(short, F.repeat(F.lit(" "), F.greatest(F.lit(0), 40 - n)), line).alias("label")).distinct()
