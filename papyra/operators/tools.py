"""The library's entry points as SQL table functions, over temporary views of a session's tables.

`register_tools` names the views and the functions; a query may then call them, also once a row by LATERAL. The bodies
are plain SQL over the views, so Spark plans a call together with the query that makes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The views and the columns that functions read.
VIEWS = {
    "papyra_documents": ("doc_id", "title", "year", "status"),
    "papyra_chunks": ("chunk_id", "doc_id", "content"),
    "papyra_entities": ("entity_id", "name", "description"),
    "papyra_relations": ("src", "dst", "type", "description"),
    "papyra_mentions": ("chunk_id", "entity_id"),
    "papyra_communities": ("entity_id", "community_id"),
}

#: name: (arguments, columns returned, body).
TOOLS = {
    "papyra_find_chunks": (
        "question STRING, k INT",
        "chunk_id STRING, score BIGINT, place INT",
        """SELECT chunk_id, score, place FROM (
             SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS place FROM (
               SELECT CAST(chunk_id AS STRING) AS chunk_id, CAST(size(array_intersect(split(lower(content), '\\\\s+'), array_remove(split(lower(papyra_find_chunks.question), '\\\\s+'), ''))) AS BIGINT) AS score FROM papyra_chunks)
             WHERE score > 0) WHERE place <= papyra_find_chunks.k""",
    ),
    "papyra_find_entities": ("keyword STRING", "entity_id STRING, name STRING", "SELECT CAST(entity_id AS STRING), name FROM papyra_entities WHERE contains(lower(name), lower(papyra_find_entities.keyword))"),
    "papyra_find_relations": ("keyword STRING", "src STRING, dst STRING, type STRING", "SELECT CAST(src AS STRING), CAST(dst AS STRING), type FROM papyra_relations WHERE contains(lower(description), lower(papyra_find_relations.keyword))"),
    "papyra_neighbours": (
        "entity STRING",
        "entity_id STRING, name STRING",
        """SELECT DISTINCT CAST(e.entity_id AS STRING), e.name FROM papyra_entities e JOIN (SELECT src AS a, dst AS b FROM papyra_relations UNION SELECT dst, src FROM papyra_relations) p ON e.entity_id = p.b
           WHERE CAST(p.a AS STRING) = papyra_neighbours.entity""",
    ),
    "papyra_chunks_of": ("entity STRING", "chunk_id STRING", "SELECT DISTINCT CAST(chunk_id AS STRING) FROM papyra_mentions WHERE CAST(entity_id AS STRING) = papyra_chunks_of.entity"),
    "papyra_documents_of": ("year_from INT, year_to INT", "doc_id STRING, title STRING, year INT", "SELECT CAST(doc_id AS STRING), title, year FROM papyra_documents WHERE year BETWEEN papyra_documents_of.year_from AND papyra_documents_of.year_to"),
    "papyra_documents_with": ("asked_status STRING", "doc_id STRING, title STRING", "SELECT CAST(doc_id AS STRING), title FROM papyra_documents WHERE status = papyra_documents_with.asked_status"),
    "papyra_community_of": (
        "entity STRING",
        "community_id STRING, entity_id STRING",
        """SELECT CAST(m.community_id AS STRING), CAST(m.entity_id AS STRING) FROM papyra_communities m JOIN papyra_communities o ON m.community_id = o.community_id
           WHERE CAST(o.entity_id AS STRING) = papyra_community_of.entity""",
    ),
}


def register_tools(spark: SparkSession, tables: dict[str, DataFrame]) -> list[str]:
    """Registers the eight functions in the session; `tables` has a DataFrame for each of VIEWS. Their names."""
    for view, columns in VIEWS.items():
        tables[view].select(*columns).createOrReplaceTempView(view)
    for name, (arguments, columns, body) in TOOLS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({columns}) RETURN {body}")
    return list(TOOLS)
