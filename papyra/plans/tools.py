"""Queries of what goes around a retrieval, and of the SQL functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.operators import questions as Q
from papyra.operators import retrieval as R
from papyra.operators import sessions as S
from papyra.operators import tools
from papyra.plans.logs import STATS, _strategies
from papyra.plans.registry import register
from papyra.sources.scratch import spread
from papyra.plans.retrieval import BM25_CTE, _asked, _docs


def _read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


BEST = f"{STATS}, be AS (SELECT question_type, mode FROM ss WHERE samples >= 5 AND mode <> 'odd' QUALIFY row_number() OVER (PARTITION BY question_type ORDER BY successes::DOUBLE / samples DESC, mode) = 1), ty AS (SELECT list(DISTINCT question_type ORDER BY question_type) AS t FROM ss)"


@register("modes_by_history", f"WITH {BEST}, q AS (SELECT item_id AS query_id, CASE WHEN item_id % 5 = 0 THEN 'temporal' ELSE t[item_id % len(t) + 1] END AS question_type FROM benchmark, ty) SELECT query_id, CASE WHEN question_type = 'temporal' THEN 'mix' ELSE coalesce(mode, 'mix') END AS mode FROM q LEFT JOIN be USING (question_type)")
def modes_by_history(spark, d):
    """The mode of each question: the one that did best in the log of strategies for its type."""
    log = _strategies(spark, d)
    types = log.agg(F.array_sort(F.collect_set("question_type")).alias("t"))  # one row
    kind = F.when(F.col("item_id") % 5 == 0, "temporal").otherwise(F.get("t", (F.col("item_id") % F.size("t")).cast("int")))
    asked = _read(spark, d, "benchmark").crossJoin(F.broadcast(types)).select(F.col("item_id").alias("query_id"), kind.alias("question_type"), F.lit("mix").alias("mode"))
    return Q.override_modes(asked, S.best_mode(log)).select("query_id", "mode")


@register(
    "research_contexts",
    f"""WITH {BM25_CTE.format(k=3)}, h AS (SELECT bm.query_id, string_agg('[' || rank || '] ' || text, chr(10) ORDER BY rank) AS lines, list('doc-' || key) AS s FROM bm JOIN documents ON doc_id = key GROUP BY 1),
    q AS (SELECT item_id AS query_id, item_id // 5 AS parent_id, 'Question ' || item_id AS question, length(text) AS prompt FROM benchmark)
    SELECT parent_id, count(*) AS n_questions, md5(string_agg('## ' || question || chr(10) || coalesce(lines, ''), chr(10) || chr(10) ORDER BY query_id)) AS context_md5,
      array_to_string(list_sort(list_distinct(flatten(list(coalesce(s, []))))), ',') AS sources, CAST(sum(prompt) AS BIGINT) AS prompt_tokens, CAST(7 * count(*) AS BIGINT) AS completion_tokens, CAST(sum(prompt) + 7 * count(*) AS BIGINT) AS total_tokens FROM q LEFT JOIN h USING (query_id) GROUP BY parent_id""",
)
def research_contexts(spark, d):
    """Five questions make one task: a context with a section for each, the sources, and the tokens of all."""
    items = _read(spark, d, "benchmark")
    questions = items.select(F.floor(F.col("item_id") / 5).alias("parent_id"), F.col("item_id").alias("query_id"), F.concat(F.lit("Question "), "item_id").alias("question"))
    usage = items.select(F.col("item_id").alias("query_id"), F.length("text").alias("prompt"), F.lit(7).alias("completion"))
    docs = _docs(spark, d).select("key", F.col("text").alias("content"))
    hits = R.bm25(spread(_docs(spark, d)), _asked(spark, d), 3).join(docs, "key").withColumn("source", F.concat(F.lit("doc-"), "key"))
    done = Q.researched(questions, hits, usage)
    return done.select("parent_id", "n_questions", F.md5("context").alias("context_md5"), F.array_join("sources", ",").alias("sources"), "prompt_tokens", "completion_tokens", "total_tokens")


def _messages(spark, d):
    return _read(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))


@register("last_answers", "SELECT conv_id AS session_id, arg_max(text, turn) AS answer FROM conversations WHERE role = 'assistant' AND trim(text) <> '' GROUP BY conv_id")
def last_answers(spark, d):
    return Q.last_answers(_messages(spark, d))


@register(
    "turn_blocks",
    """WITH m AS (SELECT conv_id, turn, role, text, role = 'user' AS asks FROM conversations WHERE trim(coalesce(text, '')) <> ''),
    n AS (SELECT *, row_number() OVER w = 1 AS first, sum(CASE WHEN asks OR k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS block FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM m) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    l AS (SELECT conv_id, turn, CASE WHEN asks OR first THEN CASE WHEN first THEN '' ELSE chr(10) || chr(10) END || '[第 ' || CAST(block AS BIGINT) || ' 轮]' ELSE '' END || chr(10) || CASE WHEN asks THEN '用户' ELSE '助手' END || ': ' || text AS line FROM n)
    SELECT conv_id AS session_id, md5(string_agg(line, '' ORDER BY turn)) AS history_md5 FROM l GROUP BY conv_id""",
)
def turn_blocks(spark, d):
    return Q.turn_blocks(_messages(spark, d)).select("session_id", F.md5("history").alias("history_md5"))


TRIMMED = "trim(coalesce({}, ''), ' ' || chr(9) || chr(10) || chr(13))"


@register(
    "turn_dialogue",
    f"""WITH c AS (SELECT conv_id, turn, role, {TRIMMED.format('text')} AS t, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM conversations),
    a AS (SELECT conv_id, n, arg_max(t, turn) AS answer FROM c WHERE role = 'assistant' AND t <> '' AND length(t) % 5 <> 0 GROUP BY ALL),
    b AS (SELECT c.conv_id, c.n, '用户：' || t || CASE WHEN answer IS NULL THEN '' WHEN length(answer) <= 400 THEN chr(10) || '助手：' || answer ELSE chr(10) || '助手：' || left(answer, 250) || '…' || right(answer, 150) END AS line FROM c LEFT JOIN a USING (conv_id, n) WHERE role = 'user')
    SELECT conv_id AS session_id, md5(string_agg('[第 ' || CAST(n AS BIGINT) || ' 轮]' || chr(10) || line, chr(10) || chr(10) ORDER BY n)) AS dialogue_md5 FROM b GROUP BY conv_id""",
)
def turn_dialogue(spark, d):
    """Turns of conversations with their last answers; messages of some lengths stand for those that call tools."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _read(spark, d, "conversations").withColumn("n", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order))
    turns = rows.where("role = 'user'").select(F.col("conv_id").alias("session_id"), F.col("n").alias("turn"), F.col("text").alias("user_input"))
    calls = F.length(F.btrim("text", F.lit(" \t\r\n"))) % 5 == 0
    messages = rows.where("role <> 'user'").select(F.col("conv_id").alias("session_id"), F.col("n").alias("turn"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"), calls.alias("tool_calls"))
    return Q.turn_dialogue(turns, messages).select("session_id", F.md5("dialogue").alias("dialogue_md5"))


@register(
    "priced_usage",
    "WITH u AS (SELECT event_id, event_type AS model, user_id AS prompt, event_id % 50 AS completion FROM events), p AS (SELECT event_type AS model, length(event_type) / 10.0::DOUBLE AS pp, length(event_type) / 5.0::DOUBLE AS cp FROM (SELECT DISTINCT event_type FROM events) WHERE event_type <> 'click') SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 9 ELSE prompt + completion END AS total, round((prompt * coalesce(pp, 0) + completion * coalesce(cp, 0)) / 1000, 9) AS cost FROM u LEFT JOIN p USING (model)",
)
def priced_usage(spark, d):
    """Costs by a table of prices; one model has none. Some records bring their own total."""
    events = _read(spark, d, "events")
    total = F.when(F.col("event_id") % 4 == 0, F.lit(9)).cast("long")
    usage = events.select("event_id", F.col("event_type").alias("model"), F.col("user_id").alias("prompt"), (F.col("event_id") % 50).alias("completion"), total.alias("total"))
    size = F.length("model").cast("double")
    prices = usage.select("model").distinct().where("model <> 'click'").select("model", (size / 10).alias("prompt_price"), (size / 5).alias("completion_price"))
    return Q.priced(usage, prices).select("event_id", "total", F.round("cost", 9).alias("cost"))


@register("extraction_cache", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'new-' || lang ELSE 'old-' || lang END AS value FROM documents")
def extraction_cache(spark, d):
    """A cache of all documents after new values for some and changes of some files; what it gives for each document."""
    docs = _read(spark, d, "documents").select("doc_id", F.concat(F.lit("lib/"), "doc_id").alias("file_path"), "lang").withColumn("cache_key", F.md5(F.concat("file_path", F.lit("::v1"))))
    cache = docs.select("file_path", "cache_key", F.concat(F.lit("old-"), "lang").alias("value"))
    cache = Q.cache_put(cache, docs.where("doc_id % 3 = 0").select("file_path", "cache_key", F.concat(F.lit("new-"), "lang").alias("value")))
    cache = Q.cache_invalidate(cache, docs.where("doc_id % 5 = 0"))
    return Q.cache_hits(cache, docs.select("doc_id", "cache_key")).select("doc_id", "value")


@register(
    "sql_tools",
    """SELECT 'entities' AS tool, CAST(s_suppkey AS VARCHAR) AS key, s_name AS more FROM supplier WHERE contains(lower(s_name), '1')
    UNION ALL SELECT 'relations', CAST(s_suppkey AS VARCHAR), CAST(1000000 + s_nationkey AS VARCHAR) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(s_name || ' in ' || n_name), lower(n_name)) AND s_nationkey < 5 AND contains(lower(s_name || ' in ' || n_name), 'supplier')
    UNION ALL SELECT 'neighbours', CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE s_nationkey = 3
    UNION ALL SELECT DISTINCT 'chunks', CAST(l_orderkey AS VARCHAR), NULL FROM lineitem WHERE l_suppkey = 7
    UNION ALL SELECT 'year', CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1996
    UNION ALL SELECT 'status', CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'community', CAST(s_suppkey AS VARCHAR), 'c' || s_nationkey FROM supplier WHERE s_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 2)
    UNION ALL SELECT 'found', CAST(doc_id AS VARCHAR), CAST(row_number() OVER (ORDER BY n DESC, CAST(doc_id AS VARCHAR)) AS VARCHAR) FROM (SELECT doc_id, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '\\s+')), ['the', 'of', 'and'])) AS n FROM documents) WHERE n > 0 QUALIFY row_number() OVER (ORDER BY n DESC, CAST(doc_id AS VARCHAR)) <= 10""",
)
def sql_tools(spark, d):
    """The eight functions called from SQL: suppliers and nations are entities, orders documents, documents chunks."""
    suppliers, nations = _read(spark, d, "supplier"), _read(spark, d, "nation")
    places = nations.select((F.col("n_nationkey") + 1_000_000).cast("long").alias("entity_id"), F.col("n_name").alias("name"))
    entities = suppliers.select("s_suppkey", "s_name").toDF("entity_id", "name").where("entity_id IS NOT NULL").unionByName(places).withColumn("description", F.lit(""))
    relations = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("src"), (F.col("s_nationkey") + 1_000_000).cast("long").alias("dst"), F.lit("IN").alias("type"), F.concat("s_name", F.lit(" in "), "n_name").alias("description"))
    orders = _read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"))
    tools.register_tools(
        spark,
        {
            "papyra_documents": orders,
            "papyra_chunks": _read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("content")),
            "papyra_entities": entities,
            "papyra_relations": relations,
            "papyra_mentions": _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_suppkey").alias("entity_id")),
            "papyra_communities": suppliers.select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("c"), "s_nationkey").alias("community_id")),
        },
    )
    return spark.sql("""SELECT 'entities' AS tool, entity_id AS key, name AS more FROM papyra_find_entities('1') WHERE length(entity_id) < 7
        UNION ALL SELECT 'relations', src, dst FROM papyra_find_relations('Supplier') WHERE dst < '1000005' AND length(dst) = 7
        UNION ALL SELECT 'neighbours', entity_id, name FROM papyra_neighbours('1000003')
        UNION ALL SELECT 'chunks', chunk_id, NULL FROM papyra_chunks_of('7')
        UNION ALL SELECT 'year', doc_id, title FROM papyra_documents_of(1995, 1996)
        UNION ALL SELECT 'status', doc_id, title FROM papyra_documents_with('F')
        UNION ALL SELECT 'community', entity_id, community_id FROM papyra_community_of('2')
        UNION ALL SELECT 'found', chunk_id, CAST(place AS STRING) FROM papyra_find_chunks('the of and', 10)""")
