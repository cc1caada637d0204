"""Queries of maintenance, sessions and streams. Events stand for logs and tool calls, conversations for sessions,
orders and line items for documents and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import text as X
from papyra.operators import maintenance as M
from papyra.operators import sessions as S
from papyra.plans.registry import register
from papyra.sources import dealt
from papyra.sources.scratch import shared_folder
from papyra.streaming import jobs


def _read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


# --- maintenance -------------------------------------------------------------------------------------------------


def _versions(spark, d):
    """Rows of a keyed table: users with the values of their events; the second half of the month is new."""
    e = _read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "event_type", "value", "ts")
    return e.where("ts < '2024-01-16'").drop("ts"), e.where("ts >= '2024-01-16' AND user_id % 3 <> 0").drop("ts")


@register("keyed_upsert", "WITH n AS (SELECT user_id AS key, event_id AS seq, event_type, value, CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END AS g FROM events WHERE ts < TIMESTAMP '2024-01-16' OR user_id % 3 <> 0) SELECT key, seq, event_type, value FROM n QUALIFY row_number() OVER (PARTITION BY key ORDER BY g DESC, seq DESC) = 1")
def keyed_upsert(spark, d):
    return M.upsert(*_versions(spark, d), ["key"])


@register("admission", "SELECT page_id, CASE WHEN page_id % 4 = 2 THEN 'extension' WHEN length(html) * 30000 > 52428800 THEN 'size' END AS reason FROM pages")
def admission(spark, d):
    ending = F.element_at(F.array(F.lit(".pdf"), F.lit(".DOCX"), F.lit(".png"), F.lit(".txt")), (F.col("page_id") % 4 + 1).cast("int"))
    files = _read(spark, d, "pages").select("page_id", F.concat(F.lit("f"), F.col("page_id"), ending).alias("name"), (F.length("html").cast("long") * 30000).alias("n_bytes"))
    return M.admit(files).select("page_id", "reason")


@register(
    "ingest_plan",
    """WITH l AS (SELECT 'lib/' || doc_id AS file_path, md5(text) AS content_id, row_number() OVER (PARTITION BY md5(text) ORDER BY 'lib/' || doc_id) AS n FROM documents),
    s AS (SELECT 'lib/' || doc_id AS file_path, CASE WHEN doc_id % 2 = 0 THEN md5(text) ELSE md5(lang) END AS content_id, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'processed' END AS status FROM documents WHERE doc_id % 5 < 3)
    SELECT file_path, content_id, CASE WHEN content_id IN (SELECT content_id FROM s WHERE status = 'processed') THEN 'skip' WHEN n > 1 THEN 'duplicate' WHEN file_path IN (SELECT file_path FROM s) THEN 'update' ELSE 'new' END AS action FROM l""",
)
def ingest_plan(spark, d):
    docs = _read(spark, d, "documents").withColumn("file_path", F.concat(F.lit("lib/"), "doc_id"))
    status = docs.where("doc_id % 5 < 3").select("file_path", F.when(F.col("doc_id") % 2 == 0, F.md5("text")).otherwise(F.md5("lang")).alias("content_id"), F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("processed").alias("status"))
    return M.ingest_plan(docs.select("file_path", F.md5("text").alias("content_id")), status)


@register("year_on_chunks", "SELECT l_orderkey AS doc_id, l_linenumber AS chunk_index, CAST(year(o_orderdate) AS INTEGER) AS year FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def year_on_chunks(spark, d):
    years = _read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"))
    return _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index")).join(years, "doc_id", "left")


@register("listing_with_status", "SELECT o_orderkey AS doc_id, coalesce(n, 0) AS n_chunks, o_orderstatus AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY 1) ON l_orderkey = o_orderkey")
def listing_with_status(spark, d):
    chunks = _read(spark, d, "lineitem").where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("n"))
    orders = _read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"))
    return orders.join(chunks, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_chunks"), "status")


@register("changed_files", "SELECT a.doc_id, b.doc_id AS old_id FROM documents a JOIN documents b ON a.source = b.source AND a.n_chars = b.n_chars AND a.doc_id > b.doc_id AND md5(a.text) <> md5(b.text)")
def changed_files(spark, d):
    """The same path (here source and length) with different content."""
    docs = _read(spark, d, "documents").select("doc_id", "source", "n_chars", F.md5("text").alias("h"))
    old = docs.select(F.col("doc_id").alias("old_id"), "source", "n_chars", F.col("h").alias("old_h"))
    return docs.join(old, ["source", "n_chars"]).where("doc_id > old_id AND h <> old_h").select("doc_id", "old_id")


def _tables(spark, d):
    """Suppliers have negative numbers, so that no part has the same."""
    lines = _read(spark, d, "lineitem")
    orders = _read(spark, d, "orders")
    chunk = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return {
        "documents": orders.select(F.col("o_orderkey").alias("doc_id")),
        "chunks": lines.select(F.col("l_orderkey").alias("doc_id"), chunk.alias("chunk_id")),
        "cites": orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("ref_id")),
        "mentions": lines.select(chunk.alias("chunk_id"), F.col("l_partkey").alias("entity_id")).union(lines.select(chunk.alias("chunk_id"), (-1 - F.col("l_suppkey")).alias("entity_id"))),
        "relations": lines.select(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst")).distinct(),
        "entities": _read(spark, d, "part").select(F.col("p_partkey").alias("entity_id")),
    }


@register(
    "delete_cascade",
    """WITH g AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 = 1), l AS (SELECT *, l_orderkey IN (SELECT k FROM g) AS gone FROM lineitem),
    m AS (SELECT DISTINCT a.l_partkey, b.l_suppkey FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE NOT a.gone),
    r AS (SELECT DISTINCT l_partkey, l_suppkey, (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM m) AS dead FROM l), e AS (SELECT p_partkey, (SELECT bool_and(gone) FROM l WHERE l_partkey = p_partkey) AS dead FROM part)
    SELECT 'documents' AS "table", (SELECT count(*) FROM g) AS deleted UNION ALL SELECT 'chunks', (SELECT count(*) FROM l WHERE gone) UNION ALL SELECT 'cites', (SELECT count(*) FROM g)
    UNION ALL SELECT 'mentions', (SELECT 2 * count(*) FROM l WHERE gone) UNION ALL SELECT 'relations', (SELECT count(*) FROM r WHERE dead) UNION ALL SELECT 'entities', (SELECT count(*) FROM e WHERE dead)""",
)
def delete_cascade(spark, d):
    ids = _read(spark, d, "orders").where("o_orderkey % 4 = 1").select(F.col("o_orderkey").alias("doc_id"))
    return M.delete_cascade(_tables(spark, d), ids)[1]


def _delete_sql() -> str:
    from papyra.plans import registry

    return registry._SQL["delete_cascade"]


@register("delete_in_place", _delete_sql())
def delete_in_place(spark, d):
    """The same deletes in tables on disk that are dealt by key: the counts, and what is left has to agree with them."""
    folder = shared_folder(spark)
    tables = _tables(spark, d)
    keys = dealt.KEYS | {"relations": ["src", "dst"]}
    for name, rows in tables.items():
        dealt.deal(rows, f"{folder}/{name}", keys[name], parts=8)
    before = {name: dealt.load(spark, f"{folder}/{name}").count() for name in tables}
    ids = _read(spark, d, "orders").where("o_orderkey % 4 = 1").select(F.col("o_orderkey").alias("doc_id"))
    dealt.remove_documents(spark, folder, ids)
    return spark.createDataFrame([(name, before[name] - dealt.load(spark, f"{folder}/{name}").count()) for name in tables], "table string, deleted long")


@register("vector_delete", "SELECT vec_id, label FROM embeddings WHERE label NOT IN (SELECT DISTINCT item_id % 5 FROM benchmark WHERE item_id % 5 < 2)")
def vector_delete(spark, d):
    gone = _read(spark, d, "benchmark").where("item_id % 5 < 2").select((F.col("item_id") % 5).cast("int").alias("label")).distinct()
    return M.without(_read(spark, d, "embeddings").select("vec_id", "label"), gone, "label")


STATUS = "st AS (SELECT event_id AS seq, user_id AS doc_id, 'lib/' || user_id AS file_path, CASE event_type WHEN 'signup' THEN 'processing' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'processed' WHEN 'view' THEN 'indexing' ELSE 'clicked' END AS status, CASE event_id % 3 WHEN 0 THEN 'chunking' WHEN 1 THEN 'graph' ELSE 'other' END AS step FROM events)"


def _status_log(spark, d):
    kind = F.create_map(*[F.lit(x) for x in ("signup", "processing", "error", "failed", "purchase", "processed", "view", "indexing", "click", "clicked")])
    step = F.element_at(F.array(F.lit("chunking"), F.lit("graph"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int"))
    return _read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("doc_id"), F.concat(F.lit("lib/"), "user_id").alias("file_path"), F.element_at(kind, F.col("event_type")).alias("status"), step.alias("step"))


NOW = f"{STATUS}, now_ AS (SELECT * FROM st WHERE status <> 'clicked' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1)"


@register("status_now", f"WITH {NOW} SELECT doc_id, file_path, status, step, seq FROM now_")
def status_now(spark, d):
    return M.current_status(_status_log(spark, d))


@register("status_progress", f"WITH {NOW} SELECT doc_id, CAST(CASE WHEN status IN ('processed', 'failed') THEN 100 WHEN step = 'chunking' THEN 12 WHEN step = 'graph' THEN 50 ELSE 0 END AS INTEGER) AS percent, status IN ('failed', 'pending') AS may_start FROM now_")
def status_progress(spark, d):
    rows = M.current_status(_status_log(spark, d))
    return rows.select("doc_id", M.progress(F.col("status"), F.col("step")).alias("percent"), M.may_start(F.col("status")).alias("may_start"))


@register("status_facets", f"""WITH {NOW} SELECT count(*) AS "all", count(*) FILTER (status NOT IN ('processed', 'failed')) AS running, count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'failed') AS failed FROM now_""")
def status_facets(spark, d):
    return M.facets(M.current_status(_status_log(spark, d)))


def _catalogue(spark, d):
    return _read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("authors"), F.col("p_type").alias("abstract"), F.lit(None).cast("string").alias("keywords"))


@register("catalogue_search", "WITH f AS (SELECT p_partkey AS doc_id, p_name AS title FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')) SELECT doc_id, title, (SELECT count(*) FROM f) AS total FROM f ORDER BY doc_id LIMIT 25")
def catalogue_search(spark, d):
    return M.catalogue_search(_catalogue(spark, d), "Ring", 25).select("doc_id", "title", "total")


@register(
    "catalogue_lookup",
    """WITH q AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN CAST(item_id AS VARCHAR) ELSE (SELECT p_name FROM part WHERE p_partkey = item_id % 100) END AS q FROM benchmark),
    m AS (SELECT query_id, p_partkey AS doc_id, p_name AS title, count(*) OVER (PARTITION BY query_id) - 1 AS others, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN CAST(p_partkey AS VARCHAR) = q THEN 0 ELSE 1 END, p_partkey) AS n FROM q JOIN part ON CAST(p_partkey AS VARCHAR) = q OR contains(lower(p_name), lower(q)))
    SELECT query_id, doc_id, title, others FROM m WHERE n = 1""",
)
def catalogue_lookup(spark, d):
    names = _read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    items = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 100).alias("k")).join(names, "k", "left")
    asked = items.select("query_id", F.when(F.col("query_id") % 2 == 0, F.col("query_id").cast("string")).otherwise(F.col("name")).alias("q"))
    return M.lookup(_catalogue(spark, d), asked).select("query_id", "doc_id", "title", "others")


@register("library_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY coalesce(o_orderpriority, ''), coalesce(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE year(o_orderdate) END, 0) DESC, o_orderkey) AS place FROM orders")
def library_sort(spark, d):
    """The whole library by priority, then newest first."""
    from papyra.operators.retrieval import placed

    year = F.coalesce(F.when(F.col("o_orderkey") % 9 != 0, F.year("o_orderdate")), F.lit(0))
    rows = _read(spark, d, "orders").select("o_orderkey", year.alias("y"), F.coalesce("o_orderpriority", F.lit("")).alias("p"))
    return placed(rows, "p", F.desc("y"), "o_orderkey").select("o_orderkey", "place")


@register("library_sort_all", "SELECT o_orderkey, row_number() OVER (ORDER BY coalesce(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE year(o_orderdate) END, 0) DESC, coalesce(o_orderpriority, ''), o_orderkey) AS place FROM orders")
def library_sort_all(spark, d):
    """The whole library, newest first; unknown years last."""
    from papyra.operators.retrieval import placed

    year = F.coalesce(F.when(F.col("o_orderkey") % 9 != 0, F.year("o_orderdate")), F.lit(0))
    rows = _read(spark, d, "orders").select("o_orderkey", year.alias("y"), F.coalesce("o_orderpriority", F.lit("")).alias("p"))
    return placed(rows, F.desc("y"), "p", "o_orderkey").select("o_orderkey", "place")


@register("extraction_cache_misses", "SELECT md5('lib/' || doc_id || '::' || md5(lang)) AS cache_key, doc_id FROM documents WHERE doc_id % 3 <> 0")
def extraction_cache_misses(spark, d):
    """Documents whose key (file and configuration) has no cached result; here every third one has."""
    rows = _read(spark, d, "documents").select(F.md5(F.concat(F.lit("lib/"), "doc_id", F.lit("::"), F.md5("lang"))).alias("cache_key"), "doc_id")
    return rows.join(rows.where("doc_id % 3 = 0").select("cache_key"), "cache_key", "left_anti")


@register("count_chunks_by_kind", "SELECT l_orderkey AS doc_id, count(*) FILTER (l_linestatus = 'O') AS n_text, count(*) FILTER (l_linestatus <> 'O') AS n_modal FROM lineitem GROUP BY 1")
def count_chunks_by_kind(spark, d):
    return _read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count_if(F.col("l_linestatus") == "O").alias("n_text"), F.count_if(F.col("l_linestatus") != "O").alias("n_modal"))


# --- sessions ----------------------------------------------------------------------------------------------------


def _turns(spark, d):
    c = _read(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"), F.col("text").alias("user_input"), F.length("text").alias("tokens"), (F.length("text") / 1000.0).alias("cost"))


@register("session_meta", "SELECT conv_id AS session_id, left(min_by(text, turn), 30) AS title, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turn_count, CAST(sum(length(text)) AS BIGINT) AS tokens, round(sum(length(text) / 1000.0::DOUBLE), 6) AS cost FROM conversations GROUP BY 1")
def session_meta(spark, d):
    return S.session_meta(_turns(spark, d))


def _summaries(spark, d):
    """A summary of turns 0 and 1 for every third session, and another of turn 2 for every sixth."""
    ids = _read(spark, d, "conversations").select("conv_id").distinct()
    one = ids.where("conv_id % 3 = 0").select(F.col("conv_id").alias("session_id"), F.lit(0).alias("seq"), F.lit("first").alias("text"), F.array(F.lit(0).cast("long"), F.lit(1).cast("long")).alias("covers"))
    two = ids.where("conv_id % 6 = 0").select(F.col("conv_id").alias("session_id"), F.lit(1).alias("seq"), F.lit("second").alias("text"), F.array(F.lit(2).cast("long")).alias("covers"))
    return one.union(two)


UNCOVERED = "un AS (SELECT * FROM conversations WHERE NOT ((conv_id % 3 = 0 AND turn <= 1) OR (conv_id % 6 = 0 AND turn = 2)))"


@register("uncovered_turns", f"WITH {UNCOVERED} SELECT conv_id AS session_id, turn FROM un")
def uncovered_turns(spark, d):
    return S.uncovered(_turns(spark, d), _summaries(spark, d)).select("session_id", "turn")


@register(
    "history_restore",
    f"""WITH {UNCOVERED} SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role, text AS content FROM un
    UNION ALL SELECT DISTINCT conv_id, 0, 'system', CASE WHEN conv_id % 6 = 0 THEN '[1] (2 turns) first' || chr(10) || '[2] (1 turns) second' ELSE 'first' END FROM conversations WHERE conv_id % 3 = 0""",
)
def history_restore(spark, d):
    return S.restore(_turns(spark, d), _summaries(spark, d))


@register("last_turns", "SELECT conv_id AS session_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def last_turns(spark, d):
    return S.last_turns(_turns(spark, d), 2).select("session_id", "turn", "role")


@register("compaction_trigger", "WITH t AS (SELECT conv_id AS session_id, turn, sum(length(text)) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT session_id, turn, CAST(total AS BIGINT) AS total FROM t WHERE total > 1500 AND back > 3")
def compaction_trigger(spark, d):
    return S.to_compact(_turns(spark, d), 1500, 3).select("session_id", "turn", "total")


@register("dialogue_text", "SELECT conv_id AS session_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY 1")
def dialogue_text(spark, d):
    return S.dialogue(_turns(spark, d)).select("session_id", F.md5("text").alias("text_md5"))


@register("new_messages", "SELECT conv_id, turn, role FROM conversations WHERE turn >= 2 AND role <> 'system'")
def new_messages(spark, d):
    """The messages of a turn: those after the base that aren't the system's."""
    return _read(spark, d, "conversations").where("turn >= 2 AND role <> 'system'").select("conv_id", "turn", "role")


LOG = "lg AS (SELECT ['specific', 'abstract', 'mixed'][user_id % 3 + 1] AS question_type, CASE event_type WHEN 'click' THEN 'mix' WHEN 'view' THEN 'local' WHEN 'error' THEN 'global' WHEN 'signup' THEN 'dual' ELSE 'odd' END AS mode, event_id % 4 AS result_count, value > 10 AS continued FROM events)"


def _strategies(spark, d):
    kind = F.element_at(F.array(F.lit("specific"), F.lit("abstract"), F.lit("mixed")), (F.col("user_id") % 3 + 1).cast("int"))
    mode = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "mix", "view", "local", "error", "global", "signup", "dual", "purchase", "odd")]), F.col("event_type"))
    return S.strategy_stats(_read(spark, d, "events").select(kind.alias("question_type"), mode.alias("mode"), (F.col("event_id") % 4).alias("result_count"), (F.col("value") > 10).alias("continued")))


STATS = f"{LOG}, ss AS (SELECT question_type, mode, count(*) AS samples, count(*) FILTER (result_count > 0 AND continued) AS successes FROM lg GROUP BY ALL)"


@register("strategy_stats", f"WITH {STATS} SELECT * FROM ss")
def strategy_stats(spark, d):
    return _strategies(spark, d)


@register("best_mode", f"WITH {STATS} SELECT question_type, mode, round(successes::DOUBLE / samples, 9) AS rate FROM ss WHERE samples >= 5 AND mode <> 'odd' QUALIFY row_number() OVER (PARTITION BY question_type ORDER BY successes::DOUBLE / samples DESC, mode) = 1")
def best_mode(spark, d):
    return S.best_mode(_strategies(spark, d))


WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> ''))"
TYPE = "['preference', 'rule', 'note'][{} % 3 + 1]"


def _typed(n):
    return F.element_at(F.array(F.lit("preference"), F.lit("rule"), F.lit("note")), (n % 3 + 1).cast("int"))


@register(
    "relevant_memories",
    f"""WITH m AS (SELECT doc_id AS slug, {TYPE.format('doc_id')} AS t, unnest({WORDS.format('text')}) AS w FROM documents), q AS (SELECT item_id AS query_id, {TYPE.format('item_id')} AS t, unnest({WORDS.format('text')}) AS w FROM benchmark),
    p AS (SELECT query_id, slug, count(*) AS p FROM q JOIN m USING (w) GROUP BY ALL UNION ALL SELECT item_id, doc_id, 3 FROM benchmark, documents WHERE {TYPE.format('item_id')} = {TYPE.format('doc_id')}),
    s AS (SELECT query_id, slug, CAST(sum(p) AS BIGINT) AS score FROM p GROUP BY ALL)
    SELECT query_id, slug, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) <= 5""",
)
def relevant_memories(spark, d):
    memories = _read(spark, d, "documents").select(F.col("doc_id").alias("slug"), _typed(F.col("doc_id")).alias("question_type"), "text")
    queries = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), _typed(F.col("item_id")).alias("question_type"), "text")
    return S.relevant_memories(memories, queries)


@register(
    "memory_dedup",
    f"""WITH m AS (SELECT doc_id AS slug, 't' || doc_id % 400 AS title, source AS type, {WORDS.format('text')} AS w FROM documents WHERE doc_id % 2 = 0), c AS (SELECT doc_id AS slug, 't' || (doc_id % 1000 + 300) AS title, source AS type, {WORDS.format('text')} AS w FROM documents WHERE doc_id % 2 = 1)
    SELECT slug FROM c WHERE slug NOT IN (SELECT slug FROM m) AND title NOT IN (SELECT title FROM m) AND NOT EXISTS (SELECT 1 FROM m WHERE m.type = c.type AND len(list_intersect(m.w, c.w)) > 0.7 * len(list_distinct(m.w || c.w)))""",
)
def memory_dedup(spark, d):
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("slug"), F.col("source").alias("type"), "text")
    old = docs.where("slug % 2 = 0").withColumn("title", F.concat(F.lit("t"), F.col("slug") % 400))
    new = docs.where("slug % 2 = 1").withColumn("title", F.concat(F.lit("t"), F.col("slug") % 1000 + 300))
    return S.new_memories(new, old).select("slug")


@register("memory_save", "SELECT doc_id, CASE WHEN lang IN ('preference', 'rule', 'note') THEN lang ELSE 'preference' END AS type, CASE WHEN left(string_split(text, chr(10))[1], 100) = '' THEN source ELSE left(string_split(text, chr(10))[1], 100) END AS description FROM documents")
def memory_save(spark, d):
    """Types outside the white list become preferences; the description is the first line, else the title."""
    first = F.substring(F.element_at(F.split("text", "\n"), 1), 1, 100)
    kind = F.when(F.col("lang").isin("preference", "rule", "note"), F.col("lang")).otherwise("preference")
    return _read(spark, d, "documents").select("doc_id", kind.alias("type"), F.coalesce(F.nullif(first, F.lit("")), "source").alias("description"))


@register(
    "similar_memories",
    f"""WITH m AS (SELECT doc_id, source AS type, list_sort({WORDS.format('text')}) AS w FROM documents), c AS (SELECT type, w, min(doc_id) AS class_id, count(*) AS n FROM m GROUP BY ALL),
    l AS (SELECT a.class_id, sum(b.n) AS links FROM c a JOIN c b ON a.type = b.type AND a.class_id <> b.class_id AND len(a.w) > 0.7 * len(b.w) AND len(b.w) > 0.7 * len(a.w) AND len(list_intersect(a.w, b.w)) > 0.7 * len(list_distinct(a.w || b.w)) GROUP BY ALL)
    SELECT doc_id, class_id, CAST(CASE WHEN len(m.w) = 0 THEN 0 ELSE n - 1 + coalesce(links, 0) END AS BIGINT) AS n_links FROM m JOIN c ON m.type IS NOT DISTINCT FROM c.type AND m.w = c.w LEFT JOIN l USING (class_id)""",
)
def similar_memories(spark, d):
    """Every memory's class and how many others of its type share more than 0.7 of its words."""
    return S.similar_memories(_read(spark, d, "documents").select(F.col("doc_id"), F.col("source").alias("type"), "text"), "doc_id")


@register("usage_rollup", "SELECT user_id, event_type, count(*) AS n, CAST(sum(CASE WHEN value > 20 THEN NULL ELSE event_id END) AS BIGINT) AS tokens FROM events GROUP BY ALL")
def usage_rollup(spark, d):
    """Token totals; nulls are passed over."""
    return _read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(F.when(F.col("value") <= 20, F.col("event_id"))).alias("tokens"))


@register("role_names", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END AS shown, regexp_matches('s-' || conv_id || CASE WHEN conv_id % 5 = 0 THEN '/x' ELSE '' END, '^[A-Za-z0-9_-]{1,64}$') AS valid FROM conversations")
def role_names(spark, d):
    sid = F.concat(F.lit("s-"), "conv_id", F.when(F.col("conv_id") % 5 == 0, "/x").otherwise(""))
    return _read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise(F.col("role")).alias("shown"), F.rlike(sid, F.lit("^[A-Za-z0-9_-]{1,64}$")).alias("valid"))


# --- the limiter and streams ---------------------------------------------------------------------------------------


def _calls(events):
    return events.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("tool"), "ts", "event_id")


LIMITED = """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_type, event_id, n, [ts] AS held, TRUE AS allowed FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_type, event_id, n, CASE WHEN len(f) < 3 THEN list_append(f, ts) ELSE f END, len(f) < 3
  FROM (SELECT e.*, list_filter(r.held, lambda t: e.ts - t <= INTERVAL 4 DAY) AS f FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.n = r.n + 1))
SELECT user_id AS session_id, event_type AS tool, event_id, allowed FROM r"""


@register("call_limiter", LIMITED)
def call_limiter(spark, d):
    return S.limit_calls(_calls(_read(spark, d, "events")), 3, 4 * 86400).select("session_id", "tool", "event_id", "allowed")


def _stream(spark, d, table):
    """The table as a stream, be it one file or a folder of files (Spark's streams take folders only)."""
    path = f"{d}/{table}.parquet"
    rows = spark.readStream.schema(_read(spark, d, table).schema)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there).isDirectory():
        return rows.parquet(path)
    return rows.option("pathGlobFilter", f"{table}.parquet").parquet(d)


@register("call_limiter_stream", LIMITED)
def call_limiter_stream(spark, d):
    return jobs.run_available(jobs.limit_calls_stream(_calls(_stream(spark, d, "events")), 3, 4 * 86400))


@register("usage_stream", "SELECT * FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def usage_stream(spark, d):
    """Days that the watermark has closed."""
    events = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    done = jobs.run_available(jobs.usage_stream(events))
    return done.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@register("ingest_stream", "SELECT doc_id, content_id, n FROM (SELECT min(doc_id) AS doc_id, md5(text) AS content_id, length(any_value(text)) AS n FROM documents GROUP BY md5(text))")
def ingest_stream(spark, d):
    """A stream of documents into one table, each content once; the same rows as in batch."""
    source = _stream(spark, d, "documents").withColumn("content_id", F.md5("text"))
    done = jobs.append_new_stream(spark, source, "content_id", lambda rows: rows.select("content_id", F.length("text").alias("n")))
    docs = _read(spark, d, "documents").select("doc_id", F.md5("text").alias("_content")).groupBy("_content").agg(F.min("doc_id").alias("doc_id"))
    return done.join(docs, done["content_id"].eqNullSafe(docs["_content"])).select("doc_id", "content_id", "n")
