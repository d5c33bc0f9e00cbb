"""Retrieval: exact cosine top-k, an inverted-file index with measured recall, BM25."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarmill.plans.stage import stage

BM25_BLOCK = 512  #: queries whose weights, queries by terms, are sent as one matrix
QUERY_BLOCK = 4096  #: queries that are sent to all rows at a time; the block is the only thing broadcast


def _matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a vector of the common width, their unit vectors)."""
    lists = column.to_pylist()
    if width is None:
        width = next((len(v) for v in lists if v), 0)
    rows = np.array([i for i, v in enumerate(lists) if v is not None and len(v) == width and width and None not in v], np.int64)
    m = np.array([lists[i] for i in rows], np.float64).reshape(len(rows), width)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return rows, np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def top_k_cosine(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", exclude_self: bool = False) -> DataFrame:
    """(query_key, key, score, rank): the ``k`` nearest rows of each query by cosine, ties by the smaller key.

    The queries are taken in blocks; each task holds a block and keeps its own ``k`` best for each query, so what is
    shuffled is queries times tasks times k, not pairs. A zero vector has score 0 to all; null vectors, vectors of
    another width and rows with a null key are left out. Scores are rounded to 6 decimals, so that ties are ties.
    """
    kinds, qkind = dict(vectors.dtypes)[key], dict(queries.dtypes)[query_key]
    shape = f"`{query_key}` {qkind}, `{key}` {kinds}, score double"
    rows = queries.select(query_key, vector).filter(F.col(vector).isNotNull() & F.col(query_key).isNotNull()).distinct()
    n = rows.count()
    spark, found = vectors.sparkSession, None
    for start in range(0, max(n, 1), QUERY_BLOCK):
        part = (rows.orderBy(query_key).offset(start).limit(QUERY_BLOCK) if n > QUERY_BLOCK else rows).toArrow()
        ids = part.column(0).to_pylist()
        keep, q = _matrix(part.column(1).combine_chunks()) if len(ids) else (np.zeros(0, int), np.zeros((0, 0)))
        sent = spark.sparkContext.broadcast(([ids[i] for i in keep], q))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            best: list[list[tuple]] = [[] for _ in names]
            for batch in batches:
                if not names:
                    continue
                at, m = _matrix(batch.column(1), q.shape[1])
                if not len(at):
                    continue
                keys = batch.column(0).to_pylist()
                score = np.round(q @ m.T, 6) + 0.0
                for i, row in enumerate(score):
                    top = np.argpartition(-row, min(k, len(row) - 1))[: k + 1] if len(row) > k + 1 else np.arange(len(row))
                    least = np.sort(row[top])[::-1][min(k, len(top) - 1)]
                    for j in np.flatnonzero(row >= least):  # with all that tie with the last
                        if keys[at[j]] is not None and not (exclude_self and keys[at[j]] == names[i]):
                            best[i].append((-row[j], keys[at[j]]))
                    best[i] = sorted(set(best[i]))[: k + 1]
            flat = [(names[i], key_, -s) for i, b in enumerate(best) for s, key_ in b]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], _arrow(qkind)), pa.array([f[1] for f in flat], _arrow(kinds)), pa.array([f[2] for f in flat], pa.float64())], names=[query_key, key, "score"])

        one = vectors.select(key, vector).mapInArrow(run, shape)
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def softmax_loss(vectors: DataFrame, queries: DataFrame, temperature: float, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """(query_key, best, loss): cross-entropy of each query's nearest other row against all rows but itself.

    The queries are taken in blocks; each task sums up its rows for a block. Rows without a vector of the common width
    are left out on both sides, so is a row with the query's own key. Scores are rounded to 6 decimals.
    """
    rows = queries.select(query_key, vector).filter(F.col(vector).isNotNull() & F.col(query_key).isNotNull()).distinct()
    n, spark, found = rows.count(), vectors.sparkSession, None
    qkind = dict(queries.dtypes)[query_key]
    for start in range(0, max(n, 1), QUERY_BLOCK):
        part = (rows.orderBy(query_key).offset(start).limit(QUERY_BLOCK) if n > QUERY_BLOCK else rows).toArrow()
        ids = part.column(0).to_pylist()
        keep, q = _matrix(part.column(1).combine_chunks()) if len(ids) else (np.zeros(0, int), np.zeros((0, 0)))
        sent = spark.sparkContext.broadcast(([ids[i] for i in keep], q))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            total, best = np.zeros(len(names)), np.full(len(names), -np.inf)
            at = {name: i for i, name in enumerate(names)}
            for batch in batches:
                rows, x = _matrix(batch.column(1), q.shape[1]) if names else ((), None)
                if not len(rows):
                    continue
                keys = batch.column(0).to_pylist()
                s = np.round(q @ x.T, 6) + 0.0
                for j, r in enumerate(rows):
                    if keys[r] in at:
                        s[at[keys[r]], j] = -np.inf
                total += np.exp(s / temperature).sum(axis=1)
                best = np.maximum(best, s.max(axis=1))
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in hit], _arrow(qkind)), pa.array(total[hit]), pa.array(best[hit])], names=[query_key, "total", "best"])

        one = vectors.select(key, vector).mapInArrow(run, f"`{query_key}` {qkind}, total double, best double")
        found = one if found is None else found.unionByName(one)
    return found.groupBy(query_key).agg(F.max("best").alias("best"), F.sum("total").alias("_t")).select(query_key, "best", (F.ln("_t") - F.col("best") / temperature).alias("loss"))


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


class InvertedFile:
    """An inverted-file index: k-means centres fitted on a bounded sample, every row in the list of its nearest centre.

    There are as many lists as the root of half the number of rows. How many of them a query must look into for the wanted
    recall is measured on the sample and kept with the index.
    """

    def __init__(self, centres: np.ndarray, probes: int = 1):
        self.centres, self.probes = centres, probes

    @classmethod
    def fit(cls, vectors: DataFrame, vector: str = "embedding", lists: int | None = None, sample: int = 20_000, rounds: int = 12, k: int = 5, recall: float = 0.94) -> "InvertedFile":
        """Centres from at most ``sample`` rows, the least by hash; at most 4,096 lists."""
        some = vectors.select(vector).filter(F.col(vector).isNotNull())
        lists = lists or min(4096, max(1, round((some.count() / 2) ** 0.5)))
        rows = some.orderBy(F.xxhash64(vector)).limit(sample).toArrow()
        _, m = _matrix(rows.column(0).combine_chunks()) if rows.num_rows else (None, np.zeros((0, 1)))
        if not len(m):
            return cls(np.zeros((1, 1)))
        centres = m[np.linspace(0, len(m) - 1, min(lists, len(m))).astype(int)].copy()
        for _ in range(rounds):
            near = (m @ centres.T).argmax(axis=1)
            total = np.zeros_like(centres)
            np.add.at(total, near, m)
            norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
            centres = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centres)
        return cls(centres, cls._fewest(m, centres, k, recall))

    @staticmethod
    def _fewest(m: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = 256) -> int:
        """The fewest lists in which ``asked`` sampled queries find that share of their ``k`` nearest sampled rows."""
        q = m[np.linspace(0, len(m) - 1, min(asked, len(m))).astype(int)]
        top = np.argsort(-(q @ m.T), axis=1, kind="stable")[:, :k]
        home = (m @ centres.T).argmax(axis=1)
        place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)  # of each list in a query's order
        needed = np.sort(np.take_along_axis(place, home[top], axis=1).ravel())
        return int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) + 1

    def build(self, vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding") -> None:
        """Write the index below ``path``: every row's unit vector in the folder of its list, and the centres."""
        spark = vectors.sparkSession
        self._placed(vectors, key, vector).repartition("_list").write.partitionBy("_list").parquet(f"{path}/lists")
        rows = [(i, self.probes, c.tolist()) for i, c in enumerate(self.centres)]
        spark.createDataFrame(rows, "list int, probes int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")

    @classmethod
    def load(cls, spark, path: str) -> tuple["InvertedFile", DataFrame]:
        """The index at ``path`` and its rows, to be searched by ``search_lists``."""
        rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()
        return cls(np.array([r.centre for r in rows]), rows[0].probes), spark.read.parquet(f"{path}/lists")

    def _placed(self, vectors: DataFrame, key: str, vector: str) -> DataFrame:
        from scholarmill.functions.vectors import l2_normalize

        return self.assign(vectors.select(key, vector), vector).select(key, l2_normalize(F.col(vector)).alias("_v"), F.explode("lists").alias("_list"))

    def assign(self, df: DataFrame, vector: str = "embedding", probes: int = 1) -> DataFrame:
        """``df`` with the array ``lists`` of the ``probes`` nearest lists of each row; empty where it has no such vector."""
        sent = df.sparkSession.sparkContext.broadcast(self.centres)
        at = df.columns.index(vector)
        shape = T.StructType([*df.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, m = _matrix(batch.column(at), sent.value.shape[1])
                out: list[list[int]] = [[] for _ in range(batch.num_rows)]
                if len(rows):
                    near = np.argsort(-(m @ sent.value.T), axis=1, kind="stable")[:, :probes]
                    for r, x in zip(rows, near):
                        out[r] = x.tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])

        return df.mapInArrow(run, shape)

    def search(self, vectors: DataFrame, queries: DataFrame, k: int, probes: int | None = None, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
        """As ``search_lists``, of vectors that are put into their lists first."""
        return self.search_lists(self._placed(vectors, key, vector), queries, k, probes, key, vector, query_key)

    def search_lists(self, rows: DataFrame, queries: DataFrame, k: int, probes: int | None = None, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", part: int = 50_000) -> DataFrame:
        """(query_key, key, score, rank) among the rows of the ``probes`` lists nearest to each query.

        A list is cut into parts of about ``part`` rows; its queries go to each. The rows and queries of a part are scored
        by one matrix product, and only the best of each query leave it.
        """
        kinds, qkind = dict(rows.dtypes)[key], dict(queries.dtypes)[query_key]
        sizes = {r[0]: r[1] for r in rows.groupBy("_list").count().collect()}  # one for each list
        parts = F.array(*[F.lit(-(-sizes.get(i, 1) // part)) for i in range(len(self.centres))])
        n_parts = F.get(parts, F.col("_list").cast("int"))
        rows = rows.select("_list", F.pmod(F.xxhash64(key), n_parts.cast("long")).alias("_part"), key, "_v")
        q = self.assign(queries.select(query_key, vector), vector, probes or self.probes).select(query_key, F.col(vector).alias("_q"), F.explode("lists").alias("_list"))
        q = q.select("_list", F.explode(F.sequence(F.lit(0), n_parts - 1).cast("array<bigint>")).alias("_part"), query_key, "_q")

        def run(q: pa.Table, v: pa.Table) -> pa.Table:
            if not (q.num_rows and v.num_rows):
                return pa.table({query_key: pa.array([], _arrow(qkind)), key: pa.array([], _arrow(kinds)), "score": pa.array([], pa.float64())})
            qs, m = _matrix(q.column("_q").combine_chunks())
            at, x = _matrix(v.column("_v").combine_chunks(), m.shape[1])
            score = np.round(m @ x.T, 6) + 0.0
            least = np.sort(score, axis=1)[:, -min(k, score.shape[1])][:, None] if score.size else score
            i, j = np.nonzero(score >= least)  # with all that tie with the last
            return pa.table({query_key: q.column(query_key).take(pa.array(qs[i])), key: v.column(key).take(pa.array(at[j])), "score": pa.array(score[i, j])})

        scored = q.groupBy("_list", "_part").cogroup(rows.groupBy("_list", "_part")).applyInArrow(run, f"`{query_key}` {qkind}, `{key}` {kinds}, score double")
        order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25(documents: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, doc_key: str = "doc_id", query_key: str = "query_id", text: str = "text") -> DataFrame:
    """(query_key, doc_key, score) of all documents that share a term with a query, terms between single blanks of ``text``.

    Okapi weights; a term in more than half of the documents has a negative weight, which becomes ``epsilon`` times the
    mean of all terms' weights. Only terms of the queries are joined, so postings of others never leave their task.
    Scores are rounded to 6 decimals. Documents without terms count for the mean length.
    """
    terms = lambda df, key: df.select(key, F.explode(F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda t: t != "")).alias("term"))
    size = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda t: t != ""))
    n, mean = documents.agg(F.count(F.lit(1)), F.avg(size)).first()
    postings = terms(documents, doc_key).groupBy("term", doc_key).agg(F.count(F.lit(1)).alias("tf"))
    df = stage(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    idf = F.ln(F.lit(float(n or 0)) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    floor = (df.agg(F.avg(idf)).first()[0] or 0.0) * epsilon
    weights = df.select("term", F.when(idf < 0, F.lit(floor)).otherwise(idf).alias("idf"))
    asked = terms(queries, query_key).groupBy("term", query_key).agg(F.count(F.lit(1)).alias("qf")).join(weights, "term")
    lengths = documents.select(doc_key, size.alias("dl"))
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("qf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(float(mean or 1.0))))
    return asked.join(postings, "term").join(lengths, doc_key).groupBy(query_key, doc_key).agg(F.round(F.sum(part), 6).alias("score"))


def bm25_best(documents: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, doc_key: str = "doc_id", query_key: str = "query_id", text: str = "text") -> DataFrame:
    """(query_key, doc_key, score): the best document of each query, as ``best_document`` of ``bm25`` gives it.

    For a stated query set against all rows: the queries go to all tasks in blocks, each task scores its documents by
    one matrix product and keeps its best for each query, so no (query, document) pair is ever shuffled.
    """
    cut = lambda df, key: df.select(F.col(key), F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda t: t != "").alias("terms"))
    docs, asked = cut(documents, doc_key), cut(queries.filter(F.col(query_key).isNotNull()).distinct(), query_key)
    df = stage(docs.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    n, mean = docs.agg(F.count(F.lit(1)), F.avg(F.size("terms"))).first()
    idf = F.ln(F.lit(float(n or 0)) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    floor = (df.agg(F.avg(idf)).first()[0] or 0.0) * epsilon
    n_queries, found = asked.count(), None
    dkind, qkind = dict(documents.dtypes)[doc_key], dict(queries.dtypes)[query_key]
    for start in range(0, max(n_queries, 1), BM25_BLOCK):
        part = asked.orderBy(query_key).offset(start).limit(BM25_BLOCK) if n_queries > BM25_BLOCK else asked
        rows = part.collect()
        words = part.select(F.explode("terms").alias("term")).distinct()
        weight = {r[0]: r[1] for r in words.join(df, "term").select("term", F.when(idf < 0, F.lit(floor)).otherwise(idf)).collect()}
        number = {t: i for i, t in enumerate(sorted(weight))}
        m = np.zeros((len(rows), len(number)))
        for i, r in enumerate(rows):
            for t in r[1]:
                if t in number:
                    m[i, number[t]] += weight[t]
        sent = documents.sparkSession.sparkContext.broadcast(([r[0] for r in rows], number, m))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, number, m = sent.value
            best: list[tuple[float, object] | None] = [None] * len(ids)
            step = max(1, 4_000_000 // max(1, len(number)))
            for batch in batches:
                keys, terms = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a in range(0, len(keys), step):
                    each = terms[a : a + step]
                    code = np.fromiter((i * len(number) + number[t] for i, ts in enumerate(each) for t in ts if t in number), np.int64)
                    tf = np.bincount(code, minlength=len(each) * len(number)).reshape(len(each), len(number)).astype(np.float64)
                    dl = np.array([len(t) for t in each], np.float64)[:, None]
                    score = np.round(m @ (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (mean or 1.0)))).T, 6)
                    for i, row in enumerate(score):
                        top = row.max()
                        if top > 0 and (best[i] is None or -top <= best[i][0]):
                            first = min((-top, keys[a + j]) for j in np.flatnonzero(row == top))
                            best[i] = first if best[i] is None else min(best[i], first)
            hit = [(i, *x) for i, x in zip(ids, best) if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hit], _arrow(qkind)), pa.array([h[2] for h in hit], _arrow(dkind)), pa.array([-h[1] for h in hit], pa.float64())], names=[query_key, doc_key, "score"])

        one = docs.filter(F.col(doc_key).isNotNull()).mapInArrow(run, f"`{query_key}` {qkind}, `{doc_key}` {dkind}, score double")
        found = one if found is None else found.unionByName(one)
    return best_document(found, query_key, doc_key)


def best_document(scored: DataFrame, query_key: str = "query_id", doc_key: str = "doc_id") -> DataFrame:
    """The document of the best positive score of each query, of equal ones the smaller key."""
    best = scored.filter("score > 0").groupBy(query_key).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(doc_key).alias("d"))).alias("m"))
    return best.select(query_key, F.col("m.d").alias(doc_key), (-F.col("m.s")).alias("score"))


def title_first(documents: DataFrame, queries: DataFrame, normal, doc_key: str = "doc_id", query_key: str = "query_id", text: str = "title", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query_key, doc_key, score, exact): the document of the same title, of several the smaller key, with score 1; else the best by BM25.

    ``normal`` turns a title into its key, whose words are the terms. Titles without a key match nothing exactly.
    """
    norm = lambda df, key: df.select(F.col(key), normal(F.col(text)).alias("text"))
    docs, asked = norm(documents, doc_key).distinct(), norm(queries, query_key).filter(F.col(query_key).isNotNull()).distinct()
    first = docs.filter("text <> ''").groupBy("text").agg(F.min(doc_key).alias(doc_key))
    found = stage(asked.join(first, "text", "left"))
    exact = found.filter(F.col(doc_key).isNotNull()).select(query_key, doc_key, F.lit(1.0).alias("score"), F.lit(True).alias("exact"))
    rest = found.filter(F.col(doc_key).isNull()).select(query_key, "text")
    return exact.unionByName(bm25_best(docs, rest, k1, b, epsilon, doc_key, query_key).withColumn("exact", F.lit(False)))
