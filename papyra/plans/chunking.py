"""Queries of pages and chunks. Documents' lines stand for pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import chunking as C
from papyra.plans.registry import register


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _pages(spark, d):
    """A page a line; a heading on some."""
    rows = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_no", "text"))
    section = F.when(F.col("page_no") % 4 == 1, F.element_at(F.array(F.lit("abstract"), F.lit("method"), F.lit("result")), (F.col("page_no") % 3 + 1).cast("int")))
    return rows.withColumn("section", section)


PAGES = """pages_ AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS page_no, ls[k] AS text, CASE WHEN (k - 1) % 4 = 1 THEN ['abstract', 'method', 'result'][(k - 1) % 3 + 1] END AS section
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
kept AS (SELECT * FROM pages_ WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '')"""


@register("pages_to_text", f"WITH {PAGES} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text FROM kept GROUP BY doc_id")
def pages_to_text(spark, d):
    return C.document_text(_pages(spark, d))


OFFSETS = f"""{PAGES}, off AS (SELECT doc_id, page_no, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start" FROM kept)"""


@register("page_offsets", f'WITH {OFFSETS} SELECT doc_id, page_no, "start", lead("start") OVER (PARTITION BY doc_id ORDER BY page_no) AS "end" FROM off')
def page_offsets(spark, d):
    return C.page_offsets(_pages(spark, d))


STRIDE = """st AS (SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(k * 160 AS INTEGER) AS "offset", substr(text, CAST(k * 160 + 1 AS BIGINT), 200) AS content
  FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 40) / 160.0) AS BIGINT), 1))) AS k FROM {t} WHERE length(text) > 0))"""


@register("stride_chunks", f"WITH {STRIDE.format(t='documents')} SELECT * FROM st")
def stride_chunks(spark, d):
    return C.stride_chunks(_docs(spark, d), 200, 40)


@register("asof_page", f"""WITH {OFFSETS}, txt AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text FROM kept GROUP BY doc_id), {STRIDE.format(t='txt')}
    SELECT st.doc_id, chunk_index, "offset", page_no FROM st ASOF JOIN off ON st.doc_id = off.doc_id AND st."offset" >= off."start" """)
def asof_page(spark, d):
    pages = _pages(spark, d)
    chunks = C.stride_chunks(C.document_text(pages), 200, 40).drop("content")
    return C.page_of_offset(chunks, C.page_offsets(pages)).select("doc_id", "chunk_index", "offset", "page_no")


FILLED = f"""{PAGES}, fi AS (SELECT doc_id, page_no, text, coalesce(last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no ROWS UNBOUNDED PRECEDING), 'unknown') AS section FROM pages_)"""


@register("section_fill", f"WITH {FILLED} SELECT doc_id, page_no, section FROM fi")
def section_fill(spark, d):
    return C.fill_sections(_pages(spark, d)).select("doc_id", "page_no", "section")


@register(
    "page_groups",
    f"""WITH {FILLED}, t AS (SELECT *, nullif(CASE WHEN page_no % 3 = 2 THEN '' ELSE section || page_no // 4 END, '') AS title, CASE WHEN lag(section) OVER w = section THEN 0 ELSE 1 END AS c FROM fi WINDOW w AS (PARTITION BY doc_id ORDER BY page_no)),
    u AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS run FROM t),
    v AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM u),
    g AS (SELECT *, sum(CASE WHEN c = 1 OR (title IS NOT NULL AND seen IS NOT NULL AND seen <> title) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS section_no FROM v)
    SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, any_value(section) AS section_type, coalesce(max(title), '') AS title, min(page_no) AS first_page, md5(string_agg(text, chr(10) || chr(10) ORDER BY page_no)) AS text_md5 FROM g GROUP BY doc_id, section_no""",
)
def page_groups(spark, d):
    """Every third page has no title, and titles change within a section."""
    title = F.when(F.col("page_no") % 3 == 2, "").otherwise(F.concat("section", F.floor(F.col("page_no") / 4).cast("string")))
    pages = C.fill_sections(_pages(spark, d)).withColumn("title", title)
    return C.group_pages(pages).select("doc_id", "section_no", "section_type", "title", "first_page", F.md5("text").alias("text_md5"))


@register(
    "chunk_ids",
    f"""WITH {STRIDE.format(t='documents')} SELECT doc_id, chunk_index, md5(doc_id || '::' || md5(content) || '::' || (row_number() OVER (PARTITION BY doc_id, md5(content) ORDER BY chunk_index) - 1)) AS chunk_id FROM st""",
)
def chunk_ids(spark, d):
    return C.with_chunk_ids(C.stride_chunks(_docs(spark, d), 200, 40)).select("doc_id", "chunk_index", "chunk_id")


@register("recursive_chunks")
def recursive_chunks(spark, d):
    """Tested by properties: sizes, order, places, and that no word is lost; offsets of one separator by chunk_offsets."""
    return C.with_chunk_ids(C.recursive_chunks(_docs(spark, d)))


@register(
    "chunk_offsets",
    """WITH l AS (SELECT doc_id, k, ls[k] AS line, CAST(coalesce(list_sum(list_transform(ls[1:k - 1], lambda x: length(x) + 1)), 0) AS INTEGER) AS a FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
    t AS (SELECT doc_id, k, rtrim(ltrim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS c, a + length(line) - length(ltrim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS s FROM l)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index, CAST(s AS INTEGER) AS "start", CAST(s + length(c) AS INTEGER) AS "end", c AS content FROM t WHERE c <> ''""",
)
def chunk_offsets(spark, d):
    """Chunks of single lines: the places of the pieces between one fixed separator, in their documents."""
    return C.recursive_chunks(_docs(spark, d), 1, 0, ("\n",))


@register("section_chunks")
def section_chunks(spark, d):
    """Tested by properties: sizes by section, places and overlaps."""
    pages = C.fill_sections(_pages(spark, d)).withColumn("title", F.lit(""))
    return C.section_chunks(C.group_pages(pages))


@register(
    "chunk_pages",
    f"""WITH {OFFSETS}, txt AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text FROM kept GROUP BY doc_id), o AS (SELECT doc_id, page_no, "start", lead("start") OVER (PARTITION BY doc_id ORDER BY page_no) AS "end" FROM off)
    SELECT doc_id, page_no, "start", CAST("start" + length(text) AS BIGINT) AS "end" FROM off JOIN kept USING (doc_id, page_no) WHERE length(text) <= 300 AND NOT regexp_matches(text, '^\\s|\\s$')""",
)
def chunk_pages(spark, d):
    """The pages of one piece each (short ones, here each a section of its own): sectioned chunks with their page and place."""
    rows = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_no", "text"))
    kept = rows.where(F.btrim("text", F.lit(" \n\t\r")) != "")
    alone = kept.where((F.length("text") <= 300) & ~F.rlike("text", F.lit(r"^\s|\s$")))
    sections = alone.select("doc_id", F.col("page_no").alias("section_no"), F.lit("abstract").alias("section_type"), "text")
    first = C.page_offsets(kept).select("doc_id", F.col("page_no").alias("section_no"), F.col("start").alias("from"))
    chunks = C.section_chunks(sections).join(first, ["doc_id", "section_no"])
    placed = chunks.select("doc_id", (F.col("from") + F.col("start")).alias("offset"), (F.col("from") + F.col("end")).alias("to"))
    return C.page_of_offset(placed, C.page_offsets(kept)).select("doc_id", "page_no", F.col("offset").alias("start"), F.col("to").alias("end"))


@register("modal_chunks", """SELECT page_id, '[TABLE] ' || url || chr(10) || html AS content, (SELECT count(*) FROM documents d WHERE d.doc_id = page_id) + row_number() OVER (PARTITION BY page_id ORDER BY url) - 1 AS chunk_index FROM pages WHERE trim(html) <> ''""")
def modal_chunks(spark, d):
    """Modal items are numbered after the document's text chunks (one here); blank ones are left out."""
    from pyspark.sql import Window

    items = spark.read.parquet(f"{d}/pages.parquet").where(F.trim("html") != "")
    texts = _docs(spark, d).groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("page_id").orderBy("url")
    rows = items.join(texts, "page_id", "left").withColumn("chunk_index", F.coalesce("n", F.lit(0)) + F.row_number().over(order) - 1)
    return rows.select("page_id", C.modal_text(F.lit("table"), F.col("url"), F.col("html")).alias("content"), "chunk_index")
