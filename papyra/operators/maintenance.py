"""Incremental maintenance: upserts, ingest plans, deletes that cascade, status logs, catalogue queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.operators.keyword_match import containing
from papyra.sources.scratch import written

# The stages of an ingest, in order; its end states.
STAGES = ("parsing", "chunking", "metadata", "indexing", "graph", "citations", "extraction", "finishing")
STATES = ("pending", "processing", *STAGES, "processed", "failed")
EXTENSIONS = (".pdf", ".docx", ".txt")
MAX_BYTES = 50 * 1024 * 1024


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Insert or replace by key; of several new rows of a key the one with the greatest seq counts."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(rows, keys, F.desc("_new"), F.desc(seq)).drop("_new")


def admit(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds reason to files (name, n_bytes): null if the file is admitted."""
    ending = F.lower(F.regexp_extract("name", r"\.[^.]+$", 0))
    return files.withColumn("reason", F.when(~ending.isin(*extensions), F.lit("extension")).when(F.col("n_bytes") > max_bytes, F.lit("size")))


def ingest_plan(listing: DataFrame, status: DataFrame) -> DataFrame:
    """(file_path, content_id, action): skip content that is processed; update a path whose content differs; else new.

    Content found several times in the listing is claimed by its first path; the others are duplicates.
    """
    done = status.where("status = 'processed'").select(F.col("content_id").alias("_done")).distinct()
    known = status.select(F.col("file_path").alias("_path"), F.col("content_id").alias("_old"))
    known = known.groupBy("_path").agg(F.collect_set("_old").alias("_olds"))
    rows = listing.withColumn("_n", F.row_number().over(Window.partitionBy("content_id").orderBy("file_path")))
    rows = rows.join(done, F.col("content_id") == F.col("_done"), "left").join(known, F.col("file_path") == F.col("_path"), "left")
    action = F.when(F.col("_done").isNotNull(), "skip").when(F.col("_n") > 1, "duplicate").when(F.size("_olds") > 0, "update").otherwise("new")
    return rows.select("file_path", "content_id", action.alias("action"))


def without(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return rows.join(ids, on, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], doc_ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables documents, chunks, cites (doc_id), mentions (chunk_id, entity_id), relations (src, dst), entities
    (entity_id) without the documents and what only they support; and (table, deleted) counts. What goes is written once;
    the tables that are left are not computed for the counts."""
    from papyra.operators.graph import lost_support

    out = {name: without(tables[name], doc_ids, "doc_id") for name in ("documents", "chunks", "cites")}
    gone = written(tables["chunks"].join(doc_ids, "doc_id", "left_semi").select("chunk_id"))
    n_mentions, dead, orphans = lost_support(tables["relations"], tables["mentions"], gone)
    out["mentions"] = without(tables["mentions"], gone, "chunk_id")
    out["relations"] = tables["relations"].join(dead, ["src", "dst"], "left_anti")
    out["entities"] = without(tables["entities"], orphans, "entity_id")
    spark = doc_ids.sparkSession
    known = spark.createDataFrame([("chunks", gone.count()), ("mentions", n_mentions)], "table string, deleted long")
    lost = {"documents": (doc_ids, ["doc_id"]), "cites": (doc_ids, ["doc_id"]), "relations": (dead, ["src", "dst"]), "entities": (orphans, ["entity_id"])}
    counts = [tables[name].join(ids, on, "left_semi").agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table"), "deleted") for name, (ids, on) in lost.items()]
    return out, reduce(DataFrame.unionByName, counts, known)


def clean_old_versions(tables: dict[str, DataFrame], doc_ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """delete_cascade for documents that are about to be read again: their own rows stay."""
    out, counts = delete_cascade(tables, doc_ids)
    return out | {"documents": tables["documents"]}, counts.where(F.col("table") != "documents")


def current_status(log: DataFrame) -> DataFrame:
    """(doc_id, file_path, status, step, error) now, from the log (seq, ...); rows with unknown states are left out."""
    return latest(log.where(F.col("status").isin(*STATES)), ["doc_id"], F.desc("seq"))


def progress(status: Column, step: Column) -> Column:
    place = F.coalesce(*[F.when(step == s, F.lit(n)) for n, s in enumerate(STAGES)])
    return F.when(status.isin("processed", "failed"), F.lit(100)).when(place.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(5), F.floor(place * 100 / len(STAGES)))).cast("int")


def may_start(status: Column) -> Column:
    """Whether an ingest may begin: not while one runs, not when it's done."""
    return status.isNull() | status.isin("failed", "pending")


def catalogue_search(papers: DataFrame, keyword: str, limit: int) -> DataFrame:
    """Papers whose title, authors, abstract or keywords have the keyword; the first by id, with the number of all."""
    word = F.lit(keyword.lower())
    found = papers.where(reduce(Column.__or__, [F.contains(F.lower(F.coalesce(c, F.lit(""))), word) for c in ("title", "authors", "abstract", "keywords")]))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("doc_id").limit(limit).crossJoin(F.broadcast(total))  # one row


def lookup(papers: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: (query_id, q). The paper whose id is q, else the first whose title has it, and how many others match. Ids
    meet by an equi-join, titles by one pass of an automaton; blank questions match nothing."""
    asked = asked.where(F.trim("q") != "")
    by_id = papers.withColumn("q", F.col("doc_id").cast("string")).join(asked, "q").withColumn("_exact", F.lit(0)).drop("q")
    by_title = containing(papers, "title", asked.select("query_id", F.col("q").alias("keyword")))
    other = (F.col("doc_id").cast("string") != F.col("keyword")) | F.col("doc_id").isNull()
    rows = by_id.unionByName(by_title.where(other).drop("keyword").withColumn("_exact", F.lit(1)))
    best = F.min_by(F.struct(*papers.columns), F.struct("_exact", "doc_id")).alias("p")
    return rows.groupBy("query_id").agg(best, (F.count("*") - 1).alias("others")).select("query_id", "p.*", "others")


def facets(status: DataFrame) -> DataFrame:
    running = ~F.col("status").isin("processed", "failed")
    return status.agg(F.count("*").alias("all"), F.count_if(running).alias("running"), F.count_if(F.col("status") == "processed").alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"))
