"""Graph queries. Parts and suppliers are entities, line items are chunks, orders are documents, customers references."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import entities as E
from papyra.operators import graph as G
from papyra.plans.registry import register


def _read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


def _nodes(spark, d):
    one = lambda t, label, key, name: _read(spark, d, t).select(F.concat(F.lit(label[0] + ":"), F.col(key)).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"))
    return one("part", "Entity", "p_partkey", "p_name").union(one("orders", "Document", "o_orderkey", "o_orderpriority")).union(one("customer", "Reference", "c_custkey", "c_name"))


NODES = """nodes AS (SELECT 'E:' || p_partkey AS id, 'Entity' AS label, p_name AS name FROM part UNION ALL SELECT 'D:' || o_orderkey, 'Document', o_orderpriority FROM orders UNION ALL SELECT 'R:' || c_custkey, 'Reference', c_name FROM customer)"""


def _edges(spark, d):
    lines = _read(spark, d, "lineitem").select(F.concat(F.lit("D:"), F.col("l_orderkey")).alias("src"), F.concat(F.lit("E:"), F.col("l_partkey")).alias("dst"), F.lit("MENTIONS").alias("type"))
    cites = _read(spark, d, "orders").select(F.concat(F.lit("D:"), F.col("o_orderkey")).alias("src"), F.concat(F.lit("R:"), F.col("o_custkey")).alias("dst"), F.lit("CITES").alias("type"))
    return lines.union(cites)


EDGES = """edges AS (SELECT 'D:' || l_orderkey AS src, 'E:' || l_partkey AS dst, 'MENTIONS' AS type FROM lineitem UNION ALL SELECT 'D:' || o_orderkey, 'R:' || o_custkey, 'CITES' FROM orders)"""


@register("graph_stats", f"WITH {NODES}, {EDGES} SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY ROLLUP (label) UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY ROLLUP (type)")
def graph_stats(spark, d):
    return G.stats(_nodes(spark, d), _edges(spark, d))


SUB = f"""{NODES}, {EDGES}, sub AS (SELECT * FROM nodes WHERE label IN ('Document', 'Reference') AND contains(lower(name), '1') ORDER BY CASE label WHEN 'Document' THEN 0 ELSE 3 END, name, id LIMIT 400)"""


@register("subgraph_nodes", f"WITH {SUB} SELECT id, label, name FROM sub")
def subgraph_nodes(spark, d):
    return G.subgraph(_nodes(spark, d), _edges(spark, d), 400, ["Document", "Reference"], "1")[0]


ENTITIES = """ents AS (SELECT 'P:' || p_partkey AS id, 'Entity' AS label, p_name AS name FROM part UNION ALL SELECT 'S:' || s_suppkey, 'Entity', s_name FROM supplier),
links AS (SELECT DISTINCT 'P:' || l_partkey AS src, 'S:' || l_suppkey AS dst, l_returnflag AS type FROM lineitem),
sub AS (SELECT * FROM ents WHERE contains(lower(name), 'i') ORDER BY name, id LIMIT 500)"""


def _entities(spark, d):
    """Parts and suppliers as entity nodes, and the relations between them."""
    one = lambda t, mark, key, name: _read(spark, d, t).select(F.concat(F.lit(mark), F.col(key)).alias("id"), F.lit("Entity").alias("label"), F.col(name).alias("name"))
    links = _read(spark, d, "lineitem").select(F.concat(F.lit("P:"), "l_partkey").alias("src"), F.concat(F.lit("S:"), "l_suppkey").alias("dst"), F.col("l_returnflag").alias("type"))
    return one("part", "P:", "p_partkey", "p_name").union(one("supplier", "S:", "s_suppkey", "s_name")), links


@register("subgraph_edges", f"WITH {ENTITIES} SELECT src, dst, type FROM links WHERE src IN (SELECT id FROM sub) AND dst IN (SELECT id FROM sub)")
def subgraph_edges(spark, d):
    return G.subgraph(*_entities(spark, d), 5000, ["Entity"], "I")[1]


@register(
    "entity_search",
    f"""WITH {ENTITIES}, top AS (SELECT * FROM sub ORDER BY name, id LIMIT 50), rel AS (SELECT * FROM links WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top) AND type = 'R' ORDER BY src, dst LIMIT 15)
    SELECT 'node' AS kind, id AS a, name AS b FROM (SELECT * FROM top ORDER BY name, id LIMIT 10) UNION ALL SELECT 'relation', src, dst FROM rel""",
)
def entity_search(spark, d):
    """The first nodes and relations of a subgraph of 50, as the report shows them."""
    return G.entity_search(*_entities(spark, d), "i", relation_type="R")


@register("display_names", "SELECT page_id, coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN '' ELSE html END, ''), nullif(url, ''), 'x') AS name FROM pages")
def display_names(spark, d):
    rows = _read(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("html")).alias("title"), "url", F.lit("x").alias("kind"))
    return rows.select("page_id", G.display_name("title", "url", "kind").alias("name"))


def _relations(spark, d):
    """Relations between parts and suppliers, as numbers: suppliers follow the parts."""
    return _read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst"), F.col("l_returnflag").alias("type"))


RELS = "rels AS (SELECT l_partkey AS src, l_suppkey + 1000000 AS dst, l_returnflag AS type FROM lineitem)"


@register("edge_list", f"WITH {RELS} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM rels WHERE src <> dst")
def edge_list(spark, d):
    return G.undirected(_relations(spark, d))


@register(
    "one_hop_neighbours",
    f"""WITH {RELS}, s AS (SELECT item_id AS query_id, unnest([item_id, item_id + 1, 1000000 + item_id % 7]) AS id FROM benchmark), b AS (SELECT src, dst FROM rels UNION SELECT dst, src FROM rels),
    n AS (SELECT DISTINCT query_id, dst AS near FROM b JOIN s ON src = id), x AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = n.query_id AND s.id = n.near))
    SELECT query_id, near, CAST(row_number() OVER (PARTITION BY query_id ORDER BY near) AS INTEGER) AS rank FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY near) <= 50""",
)
def one_hop_neighbours(spark, d):
    seeds = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array("item_id", F.col("item_id") + 1, F.lit(1_000_000) + F.col("item_id") % 7)).alias("id"))
    return G.one_hop(_relations(spark, d), seeds)


NAMES = ("ring", "WIDGET", "small", "red", "blue")


def _keywords(spark, d):
    """Keywords of a query: a word of parts' names and a number."""
    rows = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(F.array(F.element_at(F.array(*map(F.lit, NAMES)), (F.col("item_id") % len(NAMES) + 1).cast("int")), (F.col("item_id") * 3).cast("string"))).alias("pos", "keyword"))
    return rows


KEYS = f"keys AS (SELECT item_id AS query_id, unnest([{list(NAMES)!r}[item_id % {len(NAMES)} + 1], CAST(item_id * 3 AS VARCHAR)]) AS keyword FROM benchmark)"


@register(
    "graph_retrieval",
    f"""WITH {KEYS}, h AS (SELECT DISTINCT query_id, p_partkey, p_name FROM part JOIN keys ON contains(lower(p_name), lower(keyword))),
    m AS (SELECT DISTINCT l_orderkey AS chunk_id, l_partkey FROM lineitem),
    r AS (SELECT query_id, chunk_id, count(*) AS hits, array_to_string(list_sort(list_distinct(list(p_name))), '|') AS names, array_to_string(list_sort(list(p_partkey)), '|') AS entity_ids FROM h JOIN m ON l_partkey = p_partkey GROUP BY ALL)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS INTEGER) AS rank, chunk_id, hits, names, entity_ids, CAST(year(o_orderdate) AS INTEGER) AS year FROM r LEFT JOIN orders ON o_orderkey = chunk_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) <= 10""",
)
def graph_retrieval(spark, d):
    entities = _read(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    mentions = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id")).distinct()
    found = G.matching_chunks(_keywords(spark, d), entities, mentions, 10, _years(spark, d))
    return found.select("query_id", "rank", "chunk_id", "hits", "names", "entity_ids", "year")


def _years(spark, d):
    """(chunk_id, year): the order's year."""
    return _read(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.year("o_orderdate").alias("year"))


@register(
    "relation_retrieval",
    f"""WITH {KEYS}, r AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, l_returnflag AS type, 'part ' || l_partkey || ' from ' || l_suppkey AS description FROM lineitem),
    s AS (SELECT query_id, src, dst, type, count(DISTINCT keyword) AS score FROM r JOIN keys ON contains(description, keyword) GROUP BY ALL), y AS (SELECT l_partkey AS src, CAST(max(year(o_orderdate)) AS INTEGER) AS year FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
    SELECT query_id, src, dst, type, score, year, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src, dst, type) AS INTEGER) AS rank FROM s LEFT JOIN y USING (src) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src, dst, type) <= 10""",
)
def relation_retrieval(spark, d):
    rows = _read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("type")).distinct()
    rows = rows.withColumn("description", F.concat(F.lit("part "), F.col("src"), F.lit(" from "), F.col("dst")))
    mentions = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id"))
    found = G.matching_relations(_keywords(spark, d), rows, 10, mentions=mentions, years=_years(spark, d))
    return found.select("query_id", "src", "dst", "type", "score", "year", "rank")


@register(
    "stale_relations",
    """WITH m AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS e FROM lineitem), r AS (SELECT DISTINCT l_partkey AS src, l_partkey % 50 + 1 AS dst, l_returnflag AS type FROM lineitem)
    SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM m a JOIN m b ON a.c = b.c WHERE a.e = r.src AND b.e = r.dst)""",
)
def stale_relations(spark, d):
    """Relations whose ends no chunk mentions together."""
    lines = _read(spark, d, "lineitem")
    mentions = lines.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id")).distinct()
    relations = lines.select(F.col("l_partkey").alias("src"), (F.col("l_partkey") % 50 + 1).alias("dst"), F.col("l_returnflag").alias("type")).distinct()
    return G.unsupported_relations(relations, mentions).select("src", "dst", "type")


@register("orphan_entities", "SELECT p_partkey AS entity_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def orphan_entities(spark, d):
    used = _read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("entity_id"))
    return _read(spark, d, "part").select(F.col("p_partkey").alias("entity_id")).join(used, "entity_id", "left_anti")


@register("mention_edges", "SELECT DISTINCT l_orderkey || '-' || l_linenumber AS chunk_id, l_partkey AS entity_id FROM lineitem")
def mention_edges(spark, d):
    return _read(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_partkey").alias("entity_id")).distinct()


@register(
    "description_merge",
    r"""WITH x AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS seq, trim(l_returnflag || ' ' || l_linestatus || ' ') AS t FROM lineitem), f AS (SELECT l_partkey, t, min(seq) AS seq FROM x WHERE t <> '' GROUP BY ALL)
    SELECT l_partkey AS entity_id, string_agg(t, chr(10) || '---' || chr(10) ORDER BY seq) AS description FROM f GROUP BY l_partkey""",
)
def description_merge(spark, d):
    rows = _read(spark, d, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat("l_returnflag", F.lit(" "), "l_linestatus", F.lit(" ")).alias("t"))
    return rows.groupBy(F.col("l_partkey").alias("entity_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "t"))).alias("d")).select("entity_id", E.merged_description(F.col("d.t")).alias("description"))


@register(
    "entity_upsert",
    r"""WITH o AS (SELECT l_partkey AS entity_id, l_orderkey * 10 + l_linenumber AS seq, l_shipdate < TIMESTAMP '1997-01-01' AS old, l_returnflag || l_linestatus AS t FROM lineitem),
    f AS (SELECT entity_id, t, min(seq + CASE WHEN old THEN 0 ELSE 100000000 END) AS s FROM o GROUP BY ALL), g AS (SELECT entity_id, string_agg(t, chr(10) || '---' || chr(10) ORDER BY s) AS description FROM f GROUP BY ALL)
    SELECT entity_id, max_by(t, seq + CASE WHEN old THEN 0 ELSE 100000000 END) AS name, any_value(description) AS description, NOT bool_or(old) AS is_new FROM o JOIN g USING (entity_id) GROUP BY entity_id""",
)
def entity_upsert(spark, d):
    """Mentions before a day are the existing rows, later ones are new."""
    rows = _read(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_shipdate") < "1997-01-01").alias("old"), F.concat("l_returnflag", "l_linestatus").alias("name"))
    rows = rows.withColumn("description", F.col("name")).withColumn("seq", F.when(F.col("old"), F.col("seq")).otherwise(F.col("seq") + 100_000_000))
    return E.upsert_merged(rows.where("old").drop("old"), rows.where("NOT old").drop("old"), ["entity_id"], ["name"])


@register(
    "relation_resolution",
    """WITH e AS (SELECT l_orderkey AS c, l_linenumber AS pos, lower(p_brand) AS n, l_partkey AS id FROM lineitem JOIN part ON l_partkey = p_partkey), u AS (SELECT c, n, max_by(id, pos) AS id FROM e GROUP BY ALL),
    r AS (SELECT a.c, a.n AS s, b.n AS t FROM e a JOIN e b ON a.c = b.c AND b.pos = a.pos + 1)
    SELECT r.c AS chunk_id, x.id AS source_id, y.id AS target_id, x.id || '::NEXT::' || y.id AS relation_key FROM r JOIN u x ON x.c = r.c AND x.n = r.s JOIN u y ON y.c = r.c AND y.n = r.t""",
)
def relation_resolution(spark, d):
    """Entities of a chunk are its parts, named by their brands; a relation leads from each to the next. SQL leaves open
    which of the lines of one number counts; here it's the first one in the order of the files."""
    parts = _read(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("name"))
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("seq")
    found = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("entity_id"), place).join(parts, "entity_id")
    after = found.select("chunk_id", (F.col("pos") - 1).alias("pos"), F.upper("name").alias("target"))
    relations = found.select("chunk_id", "pos", F.col("name").alias("source")).join(after, ["chunk_id", "pos"]).select("chunk_id", "source", F.lit("NEXT").alias("type"), "target")
    return E.resolve_relations(found, relations).select("chunk_id", "source_id", "target_id", "relation_key")


@register("louvain_communities")
def louvain_communities(spark, d):
    """Communities of parts and suppliers over all relations; tested by modularity and planted blocks."""
    return G.louvain(G.undirected(_relations(spark, d)))


GIVEN = "mem AS (SELECT p_partkey AS id, p_size % 17 AS community, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS description FROM part)"


@register(
    "community_table",
    f"""WITH {GIVEN} SELECT 'community-' || community AS community_id, community AS label, count(*) AS entity_count, string_agg('- ' || name || CASE WHEN description = '' THEN '' ELSE ': ' || description END, chr(10) ORDER BY name, '- ' || name || CASE WHEN description = '' THEN '' ELSE ': ' || description END) AS summary FROM mem GROUP BY community HAVING count(*) >= 3""",
)
def community_table(spark, d):
    """Given a partition: by size."""
    parts = _read(spark, d, "part")
    members = parts.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 17).alias("community"))
    entities = parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type")).alias("description"))
    return G.community_table(members, entities)


@register("largest_communities", f"WITH {GIVEN} SELECT 'community-' || community AS community_id, count(*) AS entity_count FROM mem GROUP BY community ORDER BY 2 DESC, 1 LIMIT 5")
def largest_communities(spark, d):
    return community_table(spark, d).select("community_id", "entity_count").orderBy(F.desc("entity_count"), "community_id").limit(5)


@register("modularity", f"""WITH {RELS}, p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM rels), e AS (SELECT a % 5 AS ca, b % 5 AS cb FROM p), m AS (SELECT count(*) AS m FROM e),
    k AS (SELECT c, count(*) AS k FROM (SELECT ca AS c FROM e UNION ALL SELECT cb FROM e) GROUP BY c), i AS (SELECT ca AS c, count(*) AS e FROM e WHERE ca = cb GROUP BY ca)
    SELECT round(sum(coalesce(e, 0) / m - pow(k / (2 * m), 2)), 9) AS modularity FROM k LEFT JOIN i USING (c), m""")
def modularity(spark, d):
    pairs = G.undirected(_relations(spark, d))
    members = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("community", F.col("id") % 5)
    return G.modularity(pairs, members).select(F.round("modularity", 9).alias("modularity"))
