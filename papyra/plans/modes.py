"""Retrieval modes put together: local, global, dual, mix, and the router that sends each query to its mode.

Chunks are numbered like the vectors: a chunk's mentions are those of the line items whose order has its number
modulo the number of vectors.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import graph as G
from papyra.operators import retrieval as R
from papyra.operators import router
from papyra.operators import sessions as S
from papyra.plans.graph import KEYS, _keywords
from papyra.plans.logs import STATS, _strategies
from papyra.plans.registry import register

#: In SQL, the number of chunks.
CHUNKS = "(SELECT count(*) FROM embeddings)"


def _read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


def _only(rows, of):
    """The rows of the queries `of`; all, if it is None."""
    return rows if of is None else rows.join(of.select("query_id"), "query_id", "left_semi")


def _vector_hits(spark, d, k, of=None):
    """Each benchmark item asks with the vector of its number."""
    vectors = _read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    asked = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).join(vectors, F.col("query_id") == F.col("key")).select("query_id", F.col("embedding").alias("vector"))
    return R.vector_top_k(vectors, _only(asked, of), k)


def _graph_hits(spark, d, k, of=None):
    entities = _read(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    chunks = _read(spark, d, "embeddings").agg(F.count("*").alias("chunks"))  # one row
    mentions = _read(spark, d, "lineitem").crossJoin(F.broadcast(chunks)).select((F.col("l_orderkey") % F.col("chunks")).alias("chunk_id"), F.col("l_partkey").alias("entity_id")).distinct()
    return G.chunk_hits(_only(_keywords(spark, d), of), entities, mentions, k).select("query_id", "rank", F.col("chunk_id").alias("key"), F.col("hits").alias("score"))


def _local(spark, d, k):
    return R.fuse([_graph_hits(spark, d, 2 * k), _vector_hits(spark, d, 2 * k)], k)


def _relation_hits(spark, d, k, of=None):
    rows = _read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst"), F.col("l_returnflag").alias("type")).distinct()
    rows = rows.withColumn("description", F.concat(F.lit("part "), F.col("src"), F.lit(" from "), F.col("dst")))
    return G.matching_relations(_only(_keywords(spark, d), of), rows, k)


def _entity_hits(spark, d, k, of=None):
    """Entities by name: the first of those whose name has a keyword."""
    entities = _read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    return G.named_hits(_only(_keywords(spark, d), of), entities, k)


def _edges(spark, d):
    return _read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst"))


def _vector_sql(k: int) -> str:
    distance = "list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE)) * (CAST(q.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE))))"
    return f"""vh AS (SELECT * FROM (SELECT query_id, key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s, key) AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS key, round({distance}, 6) AS s FROM embeddings q JOIN benchmark ON q.vec_id = item_id CROSS JOIN embeddings c)) WHERE rank <= {k})"""


def _graph_sql(k: int) -> str:
    return f"""{KEYS}, eh0 AS (SELECT DISTINCT query_id, p_partkey FROM part JOIN keys ON contains(lower(p_name), lower(keyword))), gm AS (SELECT DISTINCT l_orderkey % {CHUNKS} AS key, l_partkey FROM lineitem),
gh AS (SELECT * FROM (SELECT query_id, key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, key) AS INTEGER) AS rank FROM eh0 JOIN gm ON l_partkey = p_partkey GROUP BY query_id, key) WHERE rank <= {k})"""


def _fused_sql(name: str, lists: list[str], k: int) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, key, rank, {n} AS l FROM {x}" for n, x in enumerate(lists))
    return f"""{name}0 AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(l * 1000000 + rank) AS first FROM ({union}) GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, key) AS INTEGER) AS rank, key, score FROM {name}0) WHERE rank <= {k})"""


@register("local_retrieval", f"WITH {_graph_sql(10)}, {_vector_sql(10)}, {_fused_sql('lo', ['gh', 'vh'], 5)} SELECT * FROM lo")
def local_retrieval(spark, d):
    return _local(spark, d, 5)


DUAL = f"""{KEYS}, eh AS (SELECT query_id, CAST(p_partkey AS VARCHAR) AS key, rank FROM (SELECT query_id, p_partkey, row_number() OVER (PARTITION BY query_id ORDER BY p_partkey) AS rank FROM (SELECT DISTINCT query_id, p_partkey FROM part JOIN keys ON contains(lower(p_name), lower(keyword)))) WHERE rank <= 6),
rl AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000 AS dst, l_returnflag AS type FROM lineitem),
rh AS (SELECT query_id, src || '::' || dst AS key, rank FROM (SELECT query_id, src, dst, row_number() OVER (PARTITION BY query_id ORDER BY count(DISTINCT keyword) DESC, src, dst, type) AS rank FROM rl JOIN keys ON contains(lower('part ' || src || ' from ' || dst), lower(keyword)) GROUP BY query_id, src, dst, type) WHERE rank <= 6),
sd AS (SELECT DISTINCT query_id, CAST(unnest(string_split(key, '::')) AS BIGINT) AS id FROM (SELECT query_id, key FROM eh UNION ALL SELECT query_id, key FROM rh)),
bw AS (SELECT src, dst FROM rl UNION SELECT dst, src FROM rl), nb AS (SELECT DISTINCT query_id, dst AS near FROM bw JOIN sd ON src = id),
wd AS (SELECT query_id, CAST(near AS VARCHAR) AS key, rank FROM (SELECT query_id, near, row_number() OVER (PARTITION BY query_id ORDER BY near) AS rank FROM nb WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.query_id = nb.query_id AND sd.id = near)) WHERE rank <= 50),
al AS (SELECT *, 0 AS list_no FROM eh UNION ALL SELECT *, 1 FROM rh UNION ALL SELECT *, 2 FROM wd), on_ AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY list_no, rank) = 1),
du AS (SELECT query_id, key, list_no, CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_no, rank) AS INTEGER) AS rank FROM on_ QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_no, rank) <= 20)"""


def _dual(spark, d, of=None):
    return G.dual_level(_entity_hits(spark, d, 6, of), _relation_hits(spark, d, 6, of), _edges(spark, d), 20)


@register("dual_level", f"WITH {DUAL} SELECT * FROM du")
def dual_level(spark, d):
    return _dual(spark, d)


@register(
    "global_retrieval",
    f"""WITH {DUAL.split("sd AS")[0].rstrip().rstrip(",")}, gm AS (SELECT DISTINCT l_orderkey % {CHUNKS} AS k, l_partkey FROM lineitem), {_graph_sql(6).split("gh AS")[0].split("eh0 AS")[0].replace(KEYS + ",", "").strip()}
    g0 AS (SELECT query_id, k, count(*) AS n FROM (SELECT DISTINCT query_id, p_partkey FROM part JOIN keys ON contains(lower(p_name), lower(keyword))) JOIN gm ON l_partkey = p_partkey GROUP BY ALL),
    gh AS (SELECT query_id, 'chunk-' || k AS key, rank FROM (SELECT query_id, k, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, k) AS rank FROM g0) WHERE rank <= 6), {_fused_sql('gl', ['rh', 'gh'], 8)} SELECT * FROM gl""",
)
def global_retrieval(spark, d):
    relations = _relation_hits(spark, d, 6).select("query_id", "rank", F.concat_ws("::", "src", "dst").alias("key"))
    chunks = _graph_hits(spark, d, 6).select("query_id", "rank", F.concat(F.lit("chunk-"), "key").alias("key"))
    return R.fuse([relations, chunks], 8)


MIX = f"""{DUAL}, {_vector_sql(10)}, {_graph_sql(20).replace(KEYS + ",", "").strip()}, vq AS (SELECT query_id, CAST(key AS VARCHAR) AS key, rank FROM vh),
v2 AS (SELECT * FROM (SELECT query_id, key, rank FROM vh)), {_fused_sql('lo', ['gh', 'v2'], 10)}, lq AS (SELECT query_id, CAST(key AS VARCHAR) AS key, rank FROM lo), {_fused_sql('mx', ['vq', 'lq', 'du'], 5)}"""


def _wide_local(spark, d, of=None):
    return R.fuse([_graph_hits(spark, d, 20, of), _vector_hits(spark, d, 10, of)], 10)


def _mix(spark, d, of=None):
    as_text = lambda hits: hits.select("query_id", "rank", F.col("key").cast("string").alias("key"))
    return R.fuse([as_text(_vector_hits(spark, d, 10, of)), as_text(_wide_local(spark, d, of)), as_text(_dual(spark, d, of))], 5)


@register("mix_retrieval", f"WITH {MIX} SELECT * FROM mx")
def mix_retrieval(spark, d):
    return _mix(spark, d)


def _asked_questions(spark, d):
    """The items as questions: long words are topics, capitalised ones names, by which alone their modes are chosen; some
    ask for times in their text, for years or for a section."""
    text = F.when(F.length("text") % 5 == 0, F.concat(F.lit("2010年以来 "), "text")).otherwise(F.col("text"))
    words = F.split("text", r"\W+")
    rows = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("text"), F.length("text").alias("n"), words.alias("w"))
    hl = F.filter("w", lambda x: F.length(x) >= 12)
    ll = F.filter("w", lambda x: F.rlike(x, F.lit("^[A-Z][a-z]{7,}$")))
    year = F.when(F.col("n") % 7 == 2, 2008)
    section = F.when(F.col("n") % 4 == 1, "label-3").otherwise("")
    return rows.select("query_id", "text", F.lit("auto").alias("mode"), ll.alias("ll"), hl.alias("hl"), section.alias("section"), year.alias("year_from"), F.lit(0).alias("year_to"))


def _finders(spark, d):
    chunk = lambda hits: hits.select("query_id", "rank", F.concat(F.lit("c"), "key").alias("key"))
    return {
        "vectors": lambda asked, k: chunk(_vector_hits(spark, d, k, asked)),
        "words": lambda asked, k: chunk(R.bm25(_read(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), asked, k)),
        "chunks": lambda asked, k: chunk(_graph_hits(spark, d, k, asked)),
        "entities": lambda asked, k: _entity_hits(spark, d, k, asked),
        "relations": lambda asked, k: _relation_hits(spark, d, k, asked).withColumn("key", F.concat_ws("::", "src", "dst")),
    }


def _router_sql() -> str:
    """Every mode for every question at its own depth, then the questions' own modes."""
    def ranked(name: str, rows: str, order: str) -> str:
        return f"{name} AS (SELECT query_id, key, rank FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM {rows}) WHERE rank <= 80)"

    def fused(name: str, lists: list[str], most: str) -> str:
        union = " UNION ALL ".join(f"SELECT query_id, key, rank, {n} AS l FROM {x}" for n, x in enumerate(lists))
        return f"""{name}0 AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(l * 1000000 + rank) AS first FROM ({union}) GROUP BY ALL),
{name} AS (SELECT query_id, key, rank FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, key) AS rank FROM {name}0) JOIN pl USING (query_id) WHERE rank <= {most})"""

    vectors = _vector_sql(80).replace("SELECT * FROM (SELECT query_id, key,", "SELECT query_id, 'c' || key AS key, rank FROM (SELECT query_id, key,", 1)
    return f"""WITH {STATS}, {KEYS}, be AS (SELECT question_type, mode AS best FROM ss WHERE samples >= 5 AND mode <> 'odd' QUALIFY row_number() OVER (PARTITION BY question_type ORDER BY successes::DOUBLE / samples DESC, mode) = 1),
q0 AS (SELECT item_id AS query_id, length(text) AS n, list_filter(regexp_split_to_array(text, '\\W+'), lambda x: length(x) >= 12) AS hl, list_filter(regexp_split_to_array(text, '\\W+'), lambda x: regexp_matches(x, '^[A-Z][a-z]{{7,}}$')) AS ll FROM benchmark),
q1 AS (SELECT *, n % 5 = 0 AS timed, n % 7 = 2 AS explicit, CASE WHEN n % 4 = 1 THEN 'label-3' END AS section, CASE WHEN n % 5 = 0 THEN 'temporal' WHEN len(ll) > 0 AND len(hl) > 0 THEN 'mixed' WHEN len(ll) > 0 THEN 'specific' WHEN len(hl) > 0 THEN 'abstract' ELSE 'general' END AS question_type FROM q0),
q2 AS (SELECT *, CASE question_type WHEN 'temporal' THEN 'mix' WHEN 'mixed' THEN coalesce(best, 'dual') WHEN 'specific' THEN coalesce(best, 'local') WHEN 'abstract' THEN coalesce(best, 'global') ELSE coalesce(best, 'mix') END AS mode FROM q1 LEFT JOIN be USING (question_type)),
pl AS MATERIALIZED (SELECT query_id, mode, section, explicit, timed, CASE WHEN section IS NOT NULL OR explicit OR timed THEN 20 ELSE 5 END AS depth, CASE WHEN section IS NOT NULL OR explicit OR timed THEN 20 ELSE 5 END * CASE WHEN mode = 'mix' THEN 2 ELSE 1 END AS wide, CASE WHEN explicit THEN 2008 WHEN timed THEN 2010 END AS low FROM q2),
{vectors},
hit AS (SELECT DISTINCT query_id, p_partkey FROM part JOIN keys ON contains(lower(p_name), lower(keyword))), gm AS (SELECT DISTINCT l_orderkey % {CHUNKS} AS k, l_partkey FROM lineitem), g0 AS (SELECT query_id, k, count(*) AS n FROM hit JOIN gm ON l_partkey = p_partkey GROUP BY ALL),
gh AS (SELECT query_id, 'c' || k AS key, rank FROM (SELECT query_id, k, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, k) AS rank FROM g0) WHERE rank <= 80),
eh AS (SELECT query_id, CAST(p_partkey AS VARCHAR) AS key, rank FROM (SELECT query_id, p_partkey, row_number() OVER (PARTITION BY query_id ORDER BY p_partkey) AS rank FROM hit) JOIN pl USING (query_id) WHERE rank <= wide),
rl AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000 AS dst, l_returnflag AS type FROM lineitem),
rh AS (SELECT query_id, src || '::' || dst AS key, rank FROM (SELECT query_id, src, dst, row_number() OVER (PARTITION BY query_id ORDER BY count(DISTINCT keyword) DESC, src, dst, type) AS rank FROM rl JOIN keys ON contains(lower('part ' || src || ' from ' || dst), lower(keyword)) GROUP BY query_id, src, dst, type) JOIN pl USING (query_id) WHERE rank <= wide),
sd AS (SELECT DISTINCT query_id, CAST(unnest(string_split(key, '::')) AS BIGINT) AS id FROM (SELECT query_id, key FROM eh UNION ALL SELECT query_id, key FROM rh)),
bw AS (SELECT src, dst FROM rl UNION SELECT dst, src FROM rl), nb AS (SELECT DISTINCT query_id, dst AS near FROM bw JOIN sd ON src = id),
wd AS (SELECT query_id, CAST(near AS VARCHAR) AS key, rank FROM (SELECT query_id, near, row_number() OVER (PARTITION BY query_id ORDER BY near) AS rank FROM nb WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.query_id = nb.query_id AND sd.id = near)) WHERE rank <= 50),
al AS (SELECT *, 0 AS list_no FROM eh UNION ALL SELECT *, 1 FROM rh UNION ALL SELECT *, 2 FROM wd), on_ AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY list_no, rank) = 1),
du AS (SELECT query_id, key, r AS rank FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY list_no, rank) AS r FROM on_) JOIN pl USING (query_id) WHERE r <= wide),
g2 AS (SELECT gh.* FROM gh JOIN pl USING (query_id) WHERE rank <= 2 * wide), v2 AS (SELECT vh.* FROM vh JOIN pl USING (query_id) WHERE rank <= 2 * wide), v1 AS (SELECT vh.* FROM vh JOIN pl USING (query_id) WHERE rank <= wide), g1 AS (SELECT gh.* FROM gh JOIN pl USING (query_id) WHERE rank <= wide),
{fused('lo', ['g2', 'v2'], 'wide')}, {fused('ei', ['rh', 'g1'], 'wide')}, gl AS (SELECT * FROM du UNION ALL SELECT * FROM ei WHERE query_id NOT IN (SELECT query_id FROM du)), {fused('mx', ['v1', 'lo', 'gl'], '80')},
hits AS (SELECT query_id, key, rank, mode, section, explicit, low FROM (SELECT 'semantic' AS m, * FROM v1 UNION ALL SELECT 'local', * FROM lo UNION ALL SELECT 'dual', * FROM du UNION ALL SELECT 'global', * FROM gl UNION ALL SELECT 'mix', * FROM mx) JOIN pl USING (query_id) WHERE m = mode AND rank <= depth),
fa AS (SELECT 'c' || vec_id AS key, 'label-' || label AS sec, 2000 + 2 * label AS year FROM embeddings),
kn AS (SELECT h.*, year FROM hits h LEFT JOIN fa USING (key) WHERE section IS NULL OR coalesce(sec = section, FALSE)),
st AS (SELECT *, year IS NULL OR low IS NULL OR year >= low AS s, year IS NULL OR low IS NULL OR year >= low - 2 AS w FROM kn),
nn AS (SELECT *, sum(s::INT) OVER (PARTITION BY query_id) AS n1, sum(w::INT) OVER (PARTITION BY query_id) AS n2 FROM st),
ke AS (SELECT * FROM nn WHERE CASE WHEN explicit OR n1 >= 3 THEN s WHEN n2 >= 3 THEN w ELSE TRUE END)
SELECT query_id, mode, key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, key) AS INTEGER) AS rank FROM ke QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, key) <= 5"""


@register("mode_router", _router_sql())
def mode_router(spark, d):
    """Each item is routed by what its text asks for and by the history of its kind."""
    plan = router.planned(_asked_questions(spark, d), S.best_mode(_strategies(spark, d)), 2024)
    facts = _read(spark, d, "embeddings").select(F.concat(F.lit("c"), "vec_id").alias("key"), F.concat(F.lit("label-"), "label").alias("section"), (2000 + 2 * F.col("label")).alias("year"))
    return router.answered(plan, _finders(spark, d), _edges(spark, d), facts)


@register(
    "entity_cards",
    f"""WITH {KEYS}, eh AS (SELECT query_id, p_partkey AS key, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, p_partkey, row_number() OVER (PARTITION BY query_id ORDER BY p_partkey) AS rank FROM (SELECT DISTINCT query_id, p_partkey FROM part JOIN keys ON contains(lower(p_name), lower(keyword)))) WHERE rank <= 6),
    pr AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1), bw AS (SELECT src, dst FROM pr UNION SELECT dst, src FROM pr),
    nm AS (SELECT DISTINCT src, p_name AS near FROM bw JOIN part ON dst = p_partkey), nr AS (SELECT src, string_agg(near, ', ' ORDER BY near) AS near FROM (SELECT * FROM nm QUALIFY row_number() OVER (PARTITION BY src ORDER BY near) <= 10) GROUP BY src)
    SELECT query_id, rank, key, p_name || ': ' || p_type || CASE WHEN near IS NULL THEN '' ELSE ' [related: ' || near || ']' END AS content FROM eh JOIN part ON key = p_partkey LEFT JOIN nr ON src = key""",
)
def entity_cards(spark, d):
    entities = _read(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    lines = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    edges = lines.withColumnRenamed("l_partkey", "src").join(after, ["l_orderkey", "l_linenumber"]).select("src", "dst")
    return G.entity_cards(entities, edges, _entity_hits(spark, d, 6))
