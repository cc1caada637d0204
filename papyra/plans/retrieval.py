"""Retrieval queries. The benchmark's items are the queries; documents, embeddings and line items stand for the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import bm25 as B
from papyra.operators import retrieval as R
from papyra.plans.registry import register
from papyra.sources.scratch import spread, written

TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{{{L}}}}\p{{{{N}}}}\p{{{{M}}}}_]+'), lambda t: t <> '')"


def _read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


def _docs(spark, d):
    return _read(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")


def _asked(spark, d):
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


BM25_CTE = f"""
dt AS MATERIALIZED (SELECT doc_id AS key, {TOKENS.format("text")} AS w FROM documents),
tot AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM dt),
post AS MATERIALIZED (SELECT key, dl, term, count(*) AS tf FROM (SELECT key, len(w) AS dl, unnest(w) AS term FROM dt) GROUP BY ALL),
idf0 AS (SELECT term, ln(n_docs - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, tot GROUP BY term, n_docs),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM idf0) ELSE raw END AS idf FROM idf0),
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
bs AS (SELECT query_id, key, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN idf USING (term) JOIN post USING (term), tot GROUP BY ALL),
bm AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank, key, score FROM bs) WHERE rank <= {{k}} AND score > 0)
"""


def _index(spark, d):
    """The documents' index, for all searches of a query."""
    return B.build(spread(_docs(spark, d)))


@register("bm25_topk", f"WITH {BM25_CTE.format(k=10)} SELECT * FROM bm")
def bm25_topk(spark, d):
    return B.search(_index(spark, d), _asked(spark, d), 10)


def _vectors(spark, d):
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding", "label")


def _vector_queries(spark, d):
    """Every vector whose id is divisible by 20, asking with its own id."""
    return _read(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


VEC_CTE = """
vs AS (SELECT q.vec_id AS query_id, c.vec_id AS key, c.label, round(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE)) * (CAST(q.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE)))), 6) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 {where}),
vr AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, key) AS INTEGER) AS rank, key, score FROM vs)
"""


@register("vector_topk", f"WITH {VEC_CTE.format(where='')} SELECT * FROM vr WHERE rank <= 10")
def vector_topk(spark, d):
    return R.vector_top_k(_vectors(spark, d), _vector_queries(spark, d), 10)


@register("vector_topk_section", f"WITH {VEC_CTE.format(where='WHERE c.label = 3')} SELECT * FROM vr WHERE rank <= 5")
def vector_topk_section(spark, d):
    return R.vector_top_k(_vectors(spark, d), _vector_queries(spark, d), 5, keep=F.col("label") == 3)


@register(
    "vector_topk_overfetch",
    f"""WITH {VEC_CTE.format(where='')}, o AS (SELECT vr.*, label FROM vr JOIN (SELECT vec_id AS key, label FROM embeddings) USING (key) WHERE rank <= 25)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, key) AS INTEGER) AS rank, key, score FROM o WHERE label IN (3, 4) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, key) <= 5""",
)
def vector_topk_overfetch(spark, d):
    wide = R.vector_top_k(_vectors(spark, d), _vector_queries(spark, d), 25).drop("rank")
    labels = _read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "label")
    kept = wide.join(labels, "key").where("label IN (3, 4)")
    return R.top_k(kept, 5, F.asc("score"), F.asc("key")).select("query_id", "rank", "key", "score")


# two ranked lists over the same documents: BM25, and the share of the query's words that a document has
COVER_CTE = f"""
cv0 AS (SELECT query_id, key, round(count(*)::DOUBLE / max(nq), 6) AS score FROM (SELECT DISTINCT query_id, term, count(*) OVER (PARTITION BY query_id) AS nq FROM qt) JOIN post USING (term) GROUP BY ALL),
cv AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank, key, score FROM cv0) WHERE rank <= {{k}})
"""


RRF_CTE = """
u AS (SELECT query_id, key, rank, 0 AS l FROM bm UNION ALL SELECT query_id, key, rank, 1 FROM cv),
f0 AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(l * 1000000 + rank) AS first FROM u GROUP BY ALL),
fu AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, key) AS INTEGER) AS rank, key, score FROM f0)
"""


@register("hybrid_rrf", f"WITH {BM25_CTE.format(k=10)}, {COVER_CTE.format(k=10)}, {RRF_CTE} SELECT * FROM fu WHERE rank <= 5")
def hybrid_rrf(spark, d):
    index = _index(spark, d)
    return R.fuse([B.search(index, _asked(spark, d), 10), B.coverage(index, _asked(spark, d), 10)], 5)


@register(
    "first_wins_merge",
    f"""WITH {BM25_CTE.format(k=5)}, {COVER_CTE.format(k=5)}, u AS (SELECT query_id, key, rank, score, 0 AS l FROM bm UNION ALL SELECT query_id, key, rank, score, 1 FROM cv),
    o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY l, rank) = 1)
    SELECT query_id, key, l AS list_no, CAST(row_number() OVER (PARTITION BY query_id ORDER BY l, rank) AS INTEGER) AS rank FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY l, rank) <= 7""",
)
def first_wins_merge(spark, d):
    index = _index(spark, d)
    merged = R.first_wins([B.search(index, _asked(spark, d), 5), B.coverage(index, _asked(spark, d), 5)], 7, "key")
    return merged.select("query_id", "key", "list_no", "rank")


def _ranked_with_length(spark, d):
    return written(B.search(_index(spark, d), _asked(spark, d), 20)).join(_docs(spark, d).select("key", F.length("text").alias("n")), "key")


@register(
    "rerank_top_n",
    f"""WITH {BM25_CTE.format(k=20)}, s AS (SELECT query_id, bm.key, rank AS old_rank, CASE WHEN query_id % 7 = 0 THEN NULL ELSE round(1000.0::DOUBLE / (1 + length(text)), 9) END AS ns FROM bm JOIN documents ON doc_id = bm.key WHERE rank <= 15),
    t AS (SELECT *, CASE WHEN max(CASE WHEN ns IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) = 1 THEN -old_rank ELSE ns END AS new_score FROM s)
    SELECT query_id, key, old_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC, old_rank) AS INTEGER) AS rank FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC, old_rank) <= 5""",
)
def rerank_top_n(spark, d):
    """A deterministic scorer that fails for every seventh query."""
    score = F.when(F.col("query_id") % 7 != 0, F.round(F.lit(1000.0) / (1 + F.col("n")), 9))
    return R.rerank(_ranked_with_length(spark, d), score, depth=15, top_n=5).select("query_id", "key", "old_rank", "rank")


@register("rerank_truncate", f"WITH {BM25_CTE.format(k=20)} SELECT query_id, key, rank FROM bm WHERE rank <= 5")
def rerank_truncate(spark, d):
    return R.rerank(_ranked_with_length(spark, d), None, top_n=5).select("query_id", "key", "rank")


YEAR = "CASE WHEN {0} % 11 = 0 THEN NULL ELSE CAST(2000 + {0} % 25 AS INTEGER) END"


def _dated(hits):
    """Hits with a year from the document's number, unknown for some, and bounds from the query's."""
    year = F.when(F.col("key") % 11 != 0, (2000 + F.col("key") % 25).cast("int"))
    low = F.when(F.col("query_id") % 5 != 0, (2012 + F.col("query_id") % 12).cast("int"))
    high = F.when(F.col("query_id") % 3 == 0, (2018 + F.col("query_id") % 12).cast("int"))
    return hits.withColumn("year", year).withColumn("year_from", low).withColumn("year_to", high)


DATED = f"""y AS (SELECT query_id, key, rank, {YEAR.format("key")} AS year, CASE WHEN query_id % 5 <> 0 THEN CAST(2012 + query_id % 12 AS INTEGER) END AS year_from, CASE WHEN query_id % 3 = 0 THEN CAST(2018 + query_id % 12 AS INTEGER) END AS year_to FROM bm)"""


@register("year_filter", f"WITH {BM25_CTE.format(k=20)}, {DATED} SELECT query_id, key, year FROM y WHERE year IS NULL OR ((year_from IS NULL OR year >= year_from) AND (year_to IS NULL OR year <= year_to))")
def year_filter(spark, d):
    return R.keep_years(_dated(B.search(_index(spark, d), _asked(spark, d), 20)), F.col("year_from"), F.col("year_to")).select("query_id", "key", "year")


@register(
    "progressive_relaxation",
    f"""WITH {BM25_CTE.format(k=12)}, {DATED}, z AS (SELECT *, (year IS NULL OR year_from IS NULL OR (year >= year_from AND (year_to IS NULL OR year <= year_to))) AS s, (year IS NULL OR year_from IS NULL OR (year >= year_from - 2 AND (year_to IS NULL OR year <= year_to))) AS w FROM y),
    n AS (SELECT *, sum(s::INT) OVER (PARTITION BY query_id) AS n1, sum(w::INT) OVER (PARTITION BY query_id) AS n2 FROM z)
    SELECT query_id, key, rank, year FROM n WHERE CASE WHEN n1 >= 3 THEN s WHEN n2 >= 3 THEN w ELSE TRUE END""",
)
def progressive_relaxation(spark, d):
    return R.relaxed_years(_dated(B.search(_index(spark, d), _asked(spark, d), 12))).select("query_id", "key", "rank", "year")


@register(
    "context_assembly",
    f"""WITH {BM25_CTE.format(k=4)} SELECT query_id, string_agg('[' || rank || '] lib/' || bm.key || '.txt#chunk-' || (bm.key % 7) || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context,
    string_agg('lib/' || bm.key || '.txt', ';' ORDER BY rank) AS sources FROM bm JOIN documents ON doc_id = bm.key GROUP BY query_id""",
)
def context_assembly(spark, d):
    hits = written(B.search(_index(spark, d), _asked(spark, d), 4)).join(_docs(spark, d), "key")  # few rows, so texts stay where they are
    hits = hits.withColumn("file_path", F.concat(F.lit("lib/"), F.col("key"), F.lit(".txt"))).withColumn("chunk_index", F.col("key") % 7).withColumn("content", F.col("text"))
    return R.context(hits)


@register(
    "multi_question_fanout",
    f"""WITH {BM25_CTE.format(k=3)}, l AS (SELECT query_id % 10 AS parent_id, query_id, rank, key FROM bm),
    s AS (SELECT parent_id, key, min(query_id * 1000 + rank) AS first FROM l GROUP BY ALL)
    SELECT parent_id, count(*) AS n_sources, string_agg(CAST(key AS VARCHAR), ',' ORDER BY first) AS sources FROM s GROUP BY parent_id""",
)
def multi_question_fanout(spark, d):
    """Sub-questions are rows with a parent; each parent gets its sources once, in order of first appearance."""
    hits = B.search(_index(spark, d), _asked(spark, d), 3).withColumn("parent_id", F.col("query_id") % 10)
    once = hits.groupBy("parent_id", "key").agg(F.min(F.struct("query_id", "rank")).alias("first"))
    whole = once.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("first", "key"))).alias("s"))
    return whole.select("parent_id", F.size("s").cast("long").alias("n_sources"), F.array_join(F.transform("s.key", lambda x: x.cast("string")), ",").alias("sources"))
