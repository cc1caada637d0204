"""Search of entities' and relations' vectors by a question's keywords, and the modes that rest on it.

Parts stand for entities, suppliers and their nations for relations. A question has topics (high level), names (low
level) or neither, by its number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import graph as G
from papyra.operators import retrieval as R
from papyra.plans.modes import CHUNKS, _fused_sql, _graph_hits
from papyra.plans.graph import KEYS
from papyra.plans.registry import register


def _read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


def _questions(spark, d):
    """(query_id, ll, hl, text): topics for every third question, names for the next, neither for the last."""
    n = F.col("item_id") % 3
    none = F.array().cast("array<string>")
    hl = F.when(n == 0, F.array(F.lit("located in"), F.concat(F.lit("NATION"), F.col("item_id") % 25))).otherwise(none)
    ll = F.when(n <= 1, F.array(F.lit("Part"), F.concat(F.lit("TYPE"), F.col("item_id") % 7))).otherwise(none)
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), ll.alias("ll"), hl.alias("hl"), "text")


def _entities(spark, d):
    return _read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))


def _relations(spark, d):
    nations = _read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = _read(spark, d, "supplier").join(F.broadcast(nations), "s_nationkey")  # 25 nations
    rows = rows.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst"), F.col("s_name").alias("src_name"), F.col("n_name").alias("dst_name"), F.lit("LOCATED_IN").alias("type"), F.concat(F.lit("branch "), F.col("s_suppkey") % 50).alias("description"))
    return rows


def _unit(rows: str, key: str) -> str:
    """In SQL, (key, place, v) of the texts of rows: the vectors that the hook makes."""
    return rf"""SELECT {key}, place, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS v FROM (SELECT {key}, CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS INTEGER) AS place, count(*) AS n FROM (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS w FROM {rows}) GROUP BY ALL)"""


def _near(name: str, asked: str, rows: str, k: int) -> str:
    """In SQL, the k rows nearest to each asked text, by all pairs."""
    return f"""{name}q AS ({_unit(asked, "query_id")}), {name}x AS MATERIALIZED ({_unit(rows, "key")}),
{name}d AS (SELECT q.query_id, x.key, sum(q.v * x.v) AS dot FROM {name}q q JOIN {name}x x USING (place) GROUP BY ALL),
{name} AS (SELECT query_id, key, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, key) AS INTEGER) AS rank FROM (SELECT a.query_id, b.key, round(2 - 2 * coalesce(dot, 0), 5) AS score FROM {asked} a CROSS JOIN {rows} b LEFT JOIN {name}d USING (query_id, key)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, key) <= {k})"""


QUESTIONS = """qs AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'located in NATION' || item_id % 25 END AS hl, CASE WHEN item_id % 3 <= 1 THEN 'Part TYPE' || item_id % 7 END AS ll, text AS question FROM benchmark),
eq AS MATERIALIZED (SELECT query_id, coalesce(ll, hl, question) AS text FROM qs), rq AS MATERIALIZED (SELECT query_id, coalesce(hl, ll, question) AS text FROM qs),
en AS MATERIALIZED (SELECT p_partkey AS key, concat_ws(' ', p_name, p_type, p_brand) AS text FROM part),
re AS MATERIALIZED (SELECT s_suppkey || '::' || s_nationkey AS key, s_suppkey AS src, s_nationkey AS dst, s_name, n_name, s_name || ' LOCATED_IN ' || n_name || ' branch ' || s_suppkey % 50 AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@register("entity_vector_search", f"WITH {QUESTIONS}, {_near('ev', 'eq', 'en', 5)} SELECT query_id, key, rank FROM ev")
def entity_vector_search(spark, d):
    return R.entity_vector_search(_entities(spark, d), _questions(spark, d), 5, places=5).select("query_id", "key", "rank")


@register(
    "relation_vector_search",
    f"""WITH {QUESTIONS}, {_near('rv', 'rq', 're', 5)} SELECT query_id, key, rank, 'Relation: ' || s_name || ' -[LOCATED_IN]-> ' || n_name || chr(10) || 'Source: ' || s_name || chr(10) || 'Target: ' || n_name || chr(10) || 'Type: LOCATED_IN' || chr(10) || 'Description: branch ' || src % 50 AS card FROM rv JOIN re USING (key)""",
)
def relation_vector_search(spark, d):
    return R.relation_vector_search(_relations(spark, d), _questions(spark, d), 5, places=5).select("query_id", "key", "rank", "card")


@register(
    "global_by_vectors",
    f"""WITH {QUESTIONS}, {_near('rv', 'rq', 're', 6)}, {KEYS}, gm AS (SELECT DISTINCT l_orderkey % {CHUNKS} AS k, l_partkey FROM lineitem),
    g0 AS (SELECT query_id, k, count(*) AS n FROM (SELECT DISTINCT query_id, p_partkey FROM part JOIN keys ON contains(lower(p_name), lower(keyword))) JOIN gm ON l_partkey = p_partkey GROUP BY ALL),
    gh AS (SELECT query_id, 'chunk-' || k AS key, rank FROM (SELECT query_id, k, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, k) AS rank FROM g0) WHERE rank <= 6), {_fused_sql('gl', ['rv', 'gh'], 8)} SELECT * FROM gl""",
)
def global_by_vectors(spark, d):
    """The global mode: relations by their vectors, fused with the chunks that the graph finds."""
    relations = R.relation_vector_search(_relations(spark, d), _questions(spark, d), 6, places=5).select("query_id", "rank", "key")
    chunks = _graph_hits(spark, d, 6).select("query_id", "rank", F.concat(F.lit("chunk-"), "key").alias("key"))
    return R.fuse([relations, chunks], 8)


@register(
    "dual_by_vectors",
    f"""WITH {QUESTIONS}, {_near('ev', 'eq', 'en', 6)}, {_near('rv', 'rq', 're', 6)},
    eh AS (SELECT query_id, CAST(key AS VARCHAR) AS key, rank FROM ev), sd AS (SELECT DISTINCT query_id, CAST(unnest(string_split(key, '::')) AS BIGINT) AS id FROM (SELECT query_id, key FROM eh UNION ALL SELECT query_id, key FROM rv)),
    ed AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem), bw AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), nb AS (SELECT DISTINCT query_id, dst AS near FROM bw JOIN sd ON src = id),
    wd AS (SELECT query_id, CAST(near AS VARCHAR) AS key, rank FROM (SELECT query_id, near, row_number() OVER (PARTITION BY query_id ORDER BY near) AS rank FROM nb WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.query_id = nb.query_id AND sd.id = near)) WHERE rank <= 50),
    al AS (SELECT *, 0 AS list_no FROM eh UNION ALL SELECT query_id, key, rank, 1 FROM rv UNION ALL SELECT *, 2 FROM wd), on_ AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY list_no, rank) = 1)
    SELECT query_id, key, list_no, CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_no, rank) AS INTEGER) AS rank FROM on_ QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_no, rank) <= 20""",
)
def dual_by_vectors(spark, d):
    """The dual mode: entities by their vectors (low level), relations by theirs (high level), then neighbours."""
    asked = _questions(spark, d)
    low = R.entity_vector_search(_entities(spark, d), asked, 6, places=5)
    high = R.relation_vector_search(_relations(spark, d), asked, 6, places=5).select("query_id", "rank", "src", "dst")
    edges = _read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return G.dual_level(low, high, edges, 20)
