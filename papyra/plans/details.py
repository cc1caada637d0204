"""Smaller queries: lookups, cards, formats, flags and counts around the larger operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.operators import graph as G
from papyra.operators import retrieval as R
from papyra.operators.chunking import stride_chunks, with_chunk_ids
from papyra.operators.keywords import extract_keywords, naive_keywords
from papyra.plans.chunking import STRIDE
from papyra.plans.graph import RELS
from papyra.plans.registry import register
from papyra.sources.scratch import spread
from papyra.plans.retrieval import BM25_CTE


def _read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


@register("vector_table_read", "SELECT vec_id, label FROM embeddings")
def vector_table_read(spark, d):
    """All stored metadata without the vectors: the scan reads two columns."""
    return _read(spark, d, "embeddings").select("vec_id", "label")


@register("table_items_capped", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3")
def table_items_capped(spark, d):
    """At most three tables of each document, as the feature asks; the first by number."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return _read(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("n")).where("n <= 3").drop("n")


CHUNKED = f"{STRIDE.format(t='documents')}"


@register("chunk_registration", f"WITH {CHUNKED} SELECT md5(doc_id || '::' || md5(content) || '::' || (row_number() OVER (PARTITION BY doc_id, md5(content) ORDER BY chunk_index) - 1)) AS chunk_id, doc_id, chunk_index, left(content, 100) AS preview FROM st")
def chunk_registration(spark, d):
    """The chunk table: ids and previews of 100 characters."""
    rows = with_chunk_ids(stride_chunks(_read(spark, d, "documents"), 200, 40))
    return rows.select("chunk_id", "doc_id", "chunk_index", F.substring("content", 1, 100).alias("preview"))


@register("chunks_of_document", f"WITH {CHUNKED} SELECT doc_id, count(*) AS n, string_agg(md5(content), ',' ORDER BY chunk_index) AS ids FROM st GROUP BY doc_id")
def chunks_of_document(spark, d):
    rows = stride_chunks(_read(spark, d, "documents"), 200, 40).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.md5("content").alias("h")))).alias("c"))
    return rows.select("doc_id", F.size("c").cast("long").alias("n"), F.array_join("c.h", ",").alias("ids"))


@register("chunking_fallback", "SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) = doc_id % 12 AND doc_id % 12 > 0 THEN 'sections' ELSE 'plain' END AS way FROM documents")
def chunking_fallback(spark, d):
    """Sections are used only if there are as many of them as pages, and some."""
    n = F.col("doc_id") % 12
    return _read(spark, d, "documents").select("doc_id", F.when((F.size(F.split("text", "\n")) == n) & (n > 0), "sections").otherwise("plain").alias("way"))


@register("unknown_pages_labelled", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'method' WHEN page_id % 3 = 1 THEN 'unknown' ELSE 'result' END AS section FROM pages")
def unknown_pages_labelled(spark, d):
    """A labeller's answers for unknown pages count only if they are known labels."""
    answer = F.element_at(F.array(F.lit("method"), F.lit("nonsense"), F.lit("result")), (F.col("page_id") % 3 + 1).cast("int"))
    known = ("abstract", "introduction", "related_work", "method", "experiment", "result", "discussion", "conclusion", "reference", "appendix")
    return _read(spark, d, "pages").select("page_id", F.when(answer.isin(*known), answer).otherwise("unknown").alias("section"))


@register("metadata_context", "SELECT doc_id, md5(left(coalesce(nullif(string_split(text, chr(10))[1], ''), text), 10000)) AS context_md5 FROM documents")
def metadata_context(spark, d):
    """The first page, else the whole text; its first 10,000 characters."""
    first = F.nullif(F.element_at(F.split("text", "\n"), 1), F.lit(""))
    return _read(spark, d, "documents").select("doc_id", F.md5(F.substring(F.coalesce(first, "text"), 1, 10_000)).alias("context_md5"))


@register("metadata_defaults", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Unknown' ELSE source END AS title, CASE WHEN doc_id % 2 = 0 THEN 'A; B' ELSE lang END AS authors FROM documents")
def metadata_defaults(spark, d):
    """Model answers as JSON: a missing title is Unknown, authors may be a list or one string."""
    answer = F.concat(F.lit("{"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit('"title": "'), F.col("source"), F.lit('", '))).otherwise(""), F.lit('"authors": '), F.when(F.col("doc_id") % 2 == 0, F.lit('"A;B "')).otherwise(F.concat(F.lit('["'), F.col("lang"), F.lit('"]'))), F.lit("}"))
    rows = _read(spark, d, "documents").select("doc_id", answer.alias("a"))
    as_list = F.from_json(F.get_json_object("a", "$.authors"), "array<string>")
    as_text = F.transform(F.split(F.get_json_object("a", "$.authors"), ";"), lambda x: F.trim(x))
    many = F.startswith(F.get_json_object("a", "$.authors"), F.lit("["))
    return rows.select("doc_id", F.coalesce(F.get_json_object("a", "$.title"), F.lit("Unknown")).alias("title"), F.array_join(F.when(many, as_list).otherwise(as_text), "; ").alias("authors"))


@register("first_chunks", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) <= 2")
def first_chunks(spark, d):
    """The first two chunks of each document go to extraction, as the feature asks."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return _read(spark, d, "lineitem").withColumn("n", F.row_number().over(order)).where("n <= 2").select("l_orderkey", "l_linenumber", "l_partkey")


@register("document_nodes", "SELECT o_orderkey AS doc_id, CAST(year(o_orderdate) AS INTEGER) AS year, count(l_orderkey) AS n_chunks FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def document_nodes(spark, d):
    """Document nodes with the number of their HAS_CHUNK edges."""
    n = _read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("n"))
    return _read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year")).join(n, "doc_id", "left").select("doc_id", "year", F.coalesce("n", F.lit(0)).alias("n_chunks"))


@register("extraction_counts", "SELECT l_orderkey AS doc_id, count(DISTINCT l_partkey) AS n_entities, count(DISTINCT l_partkey) FILTER (l_partkey % 3 <> 0) AS n_created FROM lineitem GROUP BY 1")
def extraction_counts(spark, d):
    """Distinct entities of a document, and those that weren't known before (here every third one was)."""
    rows = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("e")).distinct()
    known = _read(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("e"), F.lit(1).alias("old"))
    return rows.join(known, "e", "left").groupBy("doc_id").agg(F.count("*").alias("n_entities"), F.count_if(F.col("old").isNull()).alias("n_created"))


@register("extracted_once", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def extracted_once(spark, d):
    """Documents whose extraction isn't done: an anti-join with the flags."""
    orders = _read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return orders.select("o_orderkey").join(orders.where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", "left_anti")


@register("vector_text", "SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN '' ELSE chr(10) || p_type END AS entity_text, concat_ws(' ', p_brand, nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END, ''), p_name) AS relation_text FROM part")
def vector_text(spark, d):
    """The text that stands for an entity or a relation; blanks are left out."""
    kind = F.when(F.col("p_size") % 2 != 0, F.col("p_type")).otherwise("")
    join = lambda glue, *parts: F.array_join(F.filter(F.array(*parts), lambda x: x != ""), glue)
    return _read(spark, d, "part").select("p_partkey", join("\n", F.col("p_name"), kind).alias("entity_text"), join(" ", F.col("p_brand"), kind, F.col("p_name")).alias("relation_text"))


@register("edges_of_node", f"WITH {RELS} SELECT item_id, src, dst, type FROM benchmark JOIN (SELECT DISTINCT * FROM rels) ON src = item_id OR dst = item_id + 1000000")
def edges_of_node(spark, d):
    """Edges that begin or end at a node: two equi-joins, each edge once."""
    rows = _read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst"), F.col("l_returnflag").alias("type")).distinct()
    items = _read(spark, d, "benchmark").select("item_id")
    out = items.join(rows, F.col("item_id") == F.col("src")).union(items.join(rows, F.col("item_id") + 1_000_000 == F.col("dst")))
    return out.select("item_id", "src", "dst", "type").distinct()


@register("neighbour_set", f"WITH {RELS} SELECT src AS id, count(DISTINCT dst) AS n FROM (SELECT src, dst FROM rels UNION ALL SELECT dst, src FROM rels) GROUP BY src")
def neighbour_set(spark, d):
    edges = _read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst"))
    return G.both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))


@register("smallest_community_size", "SELECT p_brand, greatest(2, CAST(round(count(*) / 20.0::DOUBLE) AS BIGINT)) AS least FROM part GROUP BY p_brand")
def smallest_community_size(spark, d):
    return _read(spark, d, "part").groupBy("p_brand").agg(F.greatest(F.lit(2).cast("long"), F.round(F.count("*") / 20.0).cast("long")).alias("least"))


@register("community_members", "SELECT p_partkey AS entity_id, 'community-' || (p_size % 17) AS community_id FROM part WHERE p_size % 17 IN (SELECT p_size % 17 FROM part GROUP BY 1 HAVING count(*) >= 3)")
def community_members(spark, d):
    """BELONGS_TO edges of the communities that are large enough."""
    rows = _read(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), (F.col("p_size") % 17).alias("c"))
    large = rows.groupBy("c").agg(F.count("*").alias("n")).where("n >= 3").select("c")
    return rows.join(large, "c", "left_semi").select("entity_id", F.concat(F.lit("community-"), "c").alias("community_id"))


@register("library_search", "SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'high') OR contains(CAST(year(o_orderdate) AS VARCHAR), '97')")
def library_search(spark, d):
    hit = F.contains(F.lower(F.coalesce("o_orderpriority", F.lit(""))), F.lit("high")) | F.contains(F.year("o_orderdate").cast("string"), F.lit("97"))
    return _read(spark, d, "orders").where(hit).select("o_orderkey")


@register("id_pairs_split", f"WITH {RELS} SELECT DISTINCT unnest([src, dst]) AS id FROM rels")
def id_pairs_split(spark, d):
    pair = F.concat_ws("::", F.col("l_partkey"), F.col("l_suppkey") + 1_000_000)
    return _read(spark, d, "lineitem").select(F.explode(F.filter(F.split(pair, "::"), lambda x: x != "")).alias("id")).select(F.col("id").cast("long").alias("id")).distinct()


@register("set_operations", "SELECT l_partkey AS k, 'both' AS kind FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT l_partkey, 'both' FROM lineitem WHERE l_quantity < 10 UNION ALL (SELECT l_partkey, 'first' FROM lineitem WHERE l_quantity > 40 EXCEPT SELECT l_partkey, 'first' FROM lineitem WHERE l_quantity < 10)")
def set_operations(spark, d):
    lines = _read(spark, d, "lineitem")
    a, b = lines.where("l_quantity > 40").select(F.col("l_partkey").alias("k")), lines.where("l_quantity < 10").select(F.col("l_partkey").alias("k"))
    return a.intersect(b).withColumn("kind", F.lit("both")).union(a.subtract(b).withColumn("kind", F.lit("first")))


@register("relation_cards", "SELECT DISTINCT 'Relation: part ' || l_partkey || ' -[' || l_returnflag || ']-> ' || l_suppkey || chr(10) || 'Type: ' || l_returnflag AS card FROM lineitem")
def relation_cards(spark, d):
    rows = _read(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_suppkey").distinct()
    return rows.select(F.concat(F.lit("Relation: part "), "l_partkey", F.lit(" -["), "l_returnflag", F.lit("]-> "), "l_suppkey", F.lit("\nType: "), "l_returnflag").alias("card")).distinct()


@register("naive_keywords", r"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(text, '[\s,，。?？!！]+'), lambda w: length(w) > 1), '|') AS words FROM benchmark")
def naive_keyword_list(spark, d):
    return _read(spark, d, "benchmark").select("item_id", F.array_join(naive_keywords(F.col("text")), "|").alias("words"))


@register("keyword_extraction")
def keyword_extraction(spark, d):
    """End to end, on the benchmark's items; tested on fixed questions."""
    return extract_keywords(_read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")).select("query_id", "ll", "hl")


@register("history_override", "SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN 'mix' ELSE coalesce(CASE item_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'dual' END, 'global') END AS mode FROM benchmark")
def history_override(spark, d):
    """The best mode of a question's type, if one is known, except for questions about times."""
    q = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 4 == 0, "temporal").otherwise(F.concat(F.lit("t"), F.col("item_id") % 3)).alias("question_type"), F.when(F.col("item_id") % 4 == 0, "mix").otherwise("global").alias("auto"))
    best = _read(spark, d, "events").select(F.concat(F.lit("t"), F.col("user_id") % 2).alias("question_type")).distinct().withColumn("best", F.when(F.col("question_type") == "t0", "local").otherwise("dual"))
    return q.join(best, "question_type", "left").select("query_id", F.when(F.col("question_type") == "temporal", F.col("auto")).otherwise(F.coalesce("best", "auto")).alias("mode"))


@register("hit_tags", f"WITH {BM25_CTE.format(k=3)} SELECT query_id, rank, '[' || rank || '] lib/' || key || CASE WHEN key % 4 = 0 THEN '' ELSE ' (' || (2000 + key % 20) || ')' END || CASE WHEN key % 3 = 0 THEN '' ELSE ' [method]' END AS line FROM bm")
def hit_tags(spark, d):
    """Hits as lines; unknown years and sections have no tag."""
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    hits = R.bm25(spread(docs), _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 3)
    year = F.when(F.col("key") % 4 != 0, F.concat(F.lit(" ("), 2000 + F.col("key") % 20, F.lit(")"))).otherwise("")
    section = F.when(F.col("key") % 3 != 0, F.lit(" [method]")).otherwise("")
    return hits.select("query_id", "rank", F.concat(F.lit("["), "rank", F.lit("] lib/"), "key", year, section).alias("line"))


@register("extraction_json", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Alpha|' || lang ELSE lang || '|beta' END AS names FROM documents")
def extraction_json(spark, d):
    """Model answers with either spelling of their fields, as a list or an object; what isn't an object goes."""
    obj = F.concat(F.lit('{"entities": [{"name": "Alpha"}, {"entity_name": "'), "lang", F.lit('"}, {"other": 1}]}'))
    lst = F.concat(F.lit('[{"entity_name": "'), "lang", F.lit('"}, {"name": "beta"}]'))
    raw = F.when(F.col("doc_id") % 2 == 0, obj).otherwise(lst)
    rows = _read(spark, d, "documents").select("doc_id", raw.alias("raw"))
    items = F.from_json(F.when(F.startswith("raw", F.lit("[")), F.col("raw")).otherwise(F.get_json_object("raw", "$.entities")), "array<struct<name:string,entity_name:string>>")
    names = F.filter(F.transform(items, lambda e: F.coalesce(e["name"], e["entity_name"])), lambda n: n.isNotNull())
    return rows.select("doc_id", F.array_join(names, "|").alias("names"))


@register("usage_records", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN length(text) + 5 ELSE 77 END AS total, format('{} prompt + 5 completion', length(text)) AS line FROM conversations")
def usage_records(spark, d):
    """The total is the sum where none is given."""
    prompt, given = F.length("text"), F.when(F.col("turn") % 2 != 0, F.lit(77))
    return _read(spark, d, "conversations").select("conv_id", "turn", F.coalesce(given, prompt + 5).cast("long").alias("total"), F.format_string("%d prompt + 5 completion", prompt).alias("line"))


@register("keyword_chips", "SELECT item_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[,;，；]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS chips FROM benchmark")
def keyword_chips(spark, d):
    return _read(spark, d, "benchmark").select("item_id", F.array_join(F.filter(F.transform(F.split("text", "[,;，；]"), lambda x: F.trim(x)), lambda x: x != ""), "|").alias("chips"))


@register("batch_totals", "SELECT source, count(*) AS total, count(*) FILTER (doc_id % 7 = 0) AS failed, count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 5 = 0) AS skipped, count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 5 <> 0) AS succeeded FROM documents GROUP BY source")
def batch_totals(spark, d):
    """The report of a batch: an error column never stops the others."""
    error = F.when(F.col("doc_id") % 7 == 0, "broken")
    rows = _read(spark, d, "documents").select("source", error.alias("error"), (F.col("doc_id") % 5 == 0).alias("known"))
    return rows.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("error").isNull() & F.col("known")).alias("skipped"), F.count_if(F.col("error").isNull() & ~F.col("known")).alias("succeeded"))


@register("stage_cards", "SELECT user_id, stage, CASE WHEN n < user_id % 8 THEN 'done' WHEN n = user_id % 8 THEN 'current' ELSE 'pending' END AS state FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(0, 8)) AS n, unnest(['parsing', 'chunking', 'metadata', 'indexing', 'graph', 'citations', 'extraction', 'finishing']) AS stage)")
def stage_cards(spark, d):
    """Each document's eight stages: done, current or pending."""
    from papyra.operators.maintenance import STAGES

    at = (F.col("user_id") % 8).cast("int")
    rows = _read(spark, d, "events").select("user_id").distinct().select("user_id", at.alias("at"), F.posexplode(F.array(*map(F.lit, STAGES))).alias("n", "stage"))
    return rows.select("user_id", "stage", F.when(F.col("n") < F.col("at"), "done").when(F.col("n") == F.col("at"), "current").otherwise("pending").alias("state"))


@register("metadata_delete", "SELECT doc_id FROM documents WHERE doc_id % 10 <> 3 AND source <> 'src4'")
def metadata_delete(spark, d):
    """Rows go by id or by path: two anti-joins."""
    docs = _read(spark, d, "documents").select("doc_id", "source")
    ids, paths = docs.where("doc_id % 10 = 3").select("doc_id"), docs.where("source = 'src4'").select("source").distinct()
    return docs.join(ids, "doc_id", "left_anti").join(paths, "source", "left_anti").select("doc_id")


@register("session_delete", "SELECT conv_id, turn FROM conversations WHERE conv_id % 4 <> 2")
def session_delete(spark, d):
    rows = _read(spark, d, "conversations").select("conv_id", "turn")
    return rows.join(rows.where("conv_id % 4 = 2").select("conv_id").distinct(), "conv_id", "left_anti")


@register("session_list", "SELECT conv_id, n, row_number() OVER (ORDER BY n DESC, conv_id) AS place FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def session_list(spark, d):
    """All sessions, the longest first."""
    rows = _read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return R.placed(rows, F.desc("n"), "conv_id").select("conv_id", "n", "place")


@register("session_list_all", "SELECT conv_id, n, row_number() OVER (ORDER BY last DESC, conv_id) AS place FROM (SELECT conv_id, count(*) AS n, max(turn) AS last FROM conversations GROUP BY conv_id)")
def session_list_all(spark, d):
    """All sessions, newest first."""
    rows = _read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    return R.placed(rows, F.desc("last"), "conv_id").select("conv_id", "n", "place")


@register("rejection_messages", "SELECT user_id, event_type, format('Tool {} was called {} times; wait a little.', event_type, count(*)) AS message FROM events GROUP BY user_id, event_type")
def rejection_messages(spark, d):
    n = _read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.select("user_id", "event_type", F.format_string("Tool %s was called %d times; wait a little.", "event_type", "n").alias("message"))
