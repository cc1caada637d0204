"""The staged ingest: documents (doc_id, file_path, text) or their pages to the tables that queries read.

`ingest` makes the tables of one batch. What models answer is written once and then read by every later table: a chunk
is asked about once, however many tables rest on the answer, and an answer that is known from an earlier run (by a hash
of the prompt's name and the chunk's text) is not asked for again. `ingest_to` writes a batch below a folder, each table
with a directory a batch, which a repeated batch replaces; `tables` reads a folder's batches as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import text as X
from papyra.operators.chunking import document_text, paged_chunks, recursive_chunks, with_chunk_ids
from papyra.operators.entities import entity_id, merged_description, resolve_relations
from papyra.operators.hooks import complete, embed
from papyra.sources.scratch import written

#: References that are kept of one document.
MOST_REFERENCES = 100
#: The name of the extractor's prompt; another name asks anew.
PROMPT = "extract-1"

# The names that a model's answer may give to the same field.
ENTITY = "name:string,entity_type:string,type:string,description:string"
RELATION = "source_name:string,source:string,target_name:string,target:string,relation_type:string,relation:string,type:string,description:string"
EXTRACTED = f"entities array<struct<{ENTITY}>>, relations array<struct<{RELATION}>>"

#: The tables of a batch that are kept as they are, and their keys; entities and relations are merged from two of them.
KEPT = {"documents": "doc_id", "chunks": "chunk_id", "vectors": "chunk_id", "references": "ref_id", "cites": None, "answers": "answer_key", "named": None, "related": None, "status": "doc_id"}


def answer_key(content: Column, prompt: str = PROMPT) -> Column:
    return F.md5(F.concat(F.lit(prompt + "::"), content))


def answers(chunks: DataFrame, extractor: Callable[[list[tuple]], list], known: DataFrame | None = None, prompt: str = PROMPT) -> DataFrame:
    """(answer_key, answer, answer_error) of the different contents of chunks, written once. Keys with an answer in
    `known` are taken from there; failed ones are asked for again."""
    asked = chunks.select(answer_key(F.col("content"), prompt).alias("answer_key"), "content").dropDuplicates(["answer_key"])
    if known is None:
        return written(complete(asked, "content", extractor).drop("content"))
    told = known.where("answer IS NOT NULL").dropDuplicates(["answer_key"])
    new = complete(asked.join(told, "answer_key", "left_anti"), "content", extractor).drop("content")
    return written(told.join(asked, "answer_key", "left_semi").select("answer_key", "answer", "answer_error").unionByName(new))


def parsed(answer: Column) -> Column:
    """entities (name, type, description) and relations (source, type, target, description) of an answer in JSON, which may
    be an object or a bare list of entities, under whichever of the known field names."""
    json = X.extract_json(answer)
    bare = F.from_json(json, f"array<struct<{ENTITY}>>")
    whole = F.from_json(json, EXTRACTED)
    entities = F.when(F.ltrim(json).startswith("["), bare).otherwise(whole["entities"])
    return F.struct(
        F.transform(entities, lambda e: F.struct(e["name"].alias("name"), F.coalesce(e["entity_type"], e["type"]).alias("type"), e["description"].alias("description"))).alias("entities"),
        F.transform(
            whole["relations"],
            lambda r: F.struct(
                F.coalesce(r["source_name"], r["source"]).alias("source"),
                F.coalesce(r["relation_type"], r["relation"], r["type"]).alias("type"),
                F.coalesce(r["target_name"], r["target"]).alias("target"),
                r["description"].alias("description"),
            ),
        ).alias("relations"),
    )


def found_by(chunks: DataFrame, told: DataFrame, prompt: str = PROMPT) -> tuple[DataFrame, DataFrame]:
    """Of chunks and written answers: named (chunk_id, pos, name, type, description, entity_id) and related (chunk_id,
    relation_key, src, dst, type, description), relations whose ends are names of entities of the same chunk."""
    keyed = chunks.select("chunk_id", answer_key(F.col("content"), prompt).alias("answer_key"))
    read = keyed.join(told.select("answer_key", parsed(F.col("answer")).alias("a")), "answer_key")
    named = read.select("chunk_id", F.posexplode("a.entities").alias("pos", "e")).select("chunk_id", "pos", "e.*").where("trim(coalesce(name, '')) <> ''")
    named = named.withColumn("entity_id", entity_id(F.coalesce("type", F.lit("")), F.col("name")))
    ends = resolve_relations(named, read.select("chunk_id", F.explode("a.relations").alias("r")).select("chunk_id", "r.*"))
    return named, ends.select("chunk_id", "relation_key", F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "type", "description")


def _merged() -> Column:
    told = F.array_sort(F.collect_list(F.struct("chunk_id", F.coalesce("description", F.lit("")).alias("d"))))
    return merged_description(F.transform(told, lambda x: x["d"])).alias("description")


def graph_of(named: DataFrame, related: DataFrame) -> dict[str, DataFrame]:
    """Tables entities, mentions and relations: mentions of one thing in several chunks meet by their key, and its
    descriptions are merged."""
    place = F.struct("chunk_id", "pos")
    return {
        "entities": named.groupBy("entity_id").agg(F.min_by("name", place).alias("name"), F.min_by("type", place).alias("type"), _merged()),
        "mentions": named.select("chunk_id", "entity_id").distinct(),
        "relations": related.groupBy("relation_key", "src", "dst", "type").agg(_merged()),
    }


def extracted(chunks: DataFrame, extractor: Callable[[list[tuple]], list], known: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables answers, entities, mentions and relations from a model's answers about chunks (chunk_id, content), one call
    a different content; a chunk whose call fails has none."""
    told = answers(chunks, extractor, known)
    return {"answers": told, **graph_of(*found_by(chunks, told))}


def ingest(
    docs: DataFrame,
    embedder: Callable[[list[tuple]], list] | None = None,
    extractor: Callable[[list[tuple]], list] | None = None,
    pages: DataFrame | None = None,
    known: DataFrame | None = None,
    max_chunks: int | None = None,
) -> dict[str, DataFrame]:
    """The tables documents, chunks, vectors, references, cites and status and, with an extractor, answers, named, related,
    entities, mentions and relations.

    docs: (doc_id, file_path, text) and, where reading a file failed, its error. Documents with pages (doc_id, page_no,
    text) get their text from these and are chunked by sections, others by recursive splitting; chunks have the section, page_no
    (null without pages) and start in the text. Each content is read once, by the first of its paths; blank texts are
    documents without chunks. Of a document `max_chunks` chunks are asked about (all, without it); `known` has earlier
    answers.

    A file that can't be read, or of which a chunk's vector fails, costs its own rows only: it is failed in status, with the
    step and the error, and later tables leave it out; a failed answer costs one chunk's. Chunks, vectors and answers are written on the
    way, so that hooks are called once; the rest are lazy plans."""
    error = F.col("error") if "error" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select("doc_id", "file_path", text.alias("text"), error.alias("error"))
    if pages is not None:
        whole = document_text(pages).select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
        first = first.join(whole, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "file_path", F.coalesce("_text", "text").alias("text"), "error", F.col("_doc").isNotNull().alias("paged"))
    else:
        first = first.withColumn("paged", F.lit(False))
    unread = first.where("error IS NOT NULL")
    first = first.where("error IS NULL").withColumn("content_id", F.md5("text"))
    claims = first.groupBy("content_id").agg(F.min_by("doc_id", F.struct("file_path", "doc_id")).alias("doc_id"))
    read = first.join(claims, ["doc_id", "content_id"], "left_semi")
    body = F.col("text")
    papers = read.select("doc_id", "file_path", "content_id", X.rule_year(body).alias("year"), X.rule_abstract(body).alias("abstract"), X.rule_keywords(body).alias("keywords"))
    plain = recursive_chunks(read.where("NOT paged").select("doc_id", "text")).withColumn("section", F.lit("unknown")).withColumn("page_no", F.lit(None).cast("int"))
    if pages is not None:
        own = pages.select("doc_id", F.col("page_no").cast("int").alias("page_no"), "text").join(read.select("doc_id"), "doc_id", "left_semi")
        plain = plain.unionByName(paged_chunks(own).withColumns({c: F.col(c).cast("int") for c in ("chunk_index", "start", "end")}))
    chunks = written(with_chunk_ids(plain).join(papers.select("doc_id", "file_path", "year"), "doc_id"))
    made = written(embed(chunks.select("chunk_id", "doc_id", "content"), "content", embedder).drop("content"))
    broken = made.where("embedding_error IS NOT NULL").groupBy("doc_id").agg(F.min("embedding_error").alias("error"))
    sound = lambda rows: rows.join(broken.select("doc_id"), "doc_id", "left_anti")
    found = sound(read).select("doc_id", F.posexplode(X.split_references(X.reference_section(body))).alias("n", "raw_text")).where(F.col("n") < MOST_REFERENCES)
    raw = F.col("raw_text")
    found = found.select("doc_id", F.md5(raw).alias("ref_id"), "raw_text", X.quoted_title(raw).alias("title"), X.reference_year(raw).alias("year"), X.doi(raw).alias("doi"))
    with_chunks = chunks.select("doc_id").distinct().withColumn("_some", F.lit(True))
    state = papers.select("doc_id", "file_path").join(with_chunks, "doc_id", "left").join(broken, "doc_id", "left")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("_some"), "ready").otherwise("empty")
    step = F.when(F.col("error").isNotNull(), "indexing")
    out = {
        "documents": papers,
        "chunks": chunks,
        "vectors": sound(made.drop("embedding_error")),
        "references": found.drop("doc_id").dropDuplicates(["ref_id"]),
        "cites": found.select("doc_id", "ref_id").distinct(),
        "status": state.select("doc_id", "file_path", status.alias("status"), step.alias("step"), "error").unionByName(
            unread.select("doc_id", "file_path", F.lit("failed").alias("status"), F.lit("parsing").alias("step"), "error")
        ),
    }
    if extractor is None:
        return out
    asked = sound(chunks)
    if max_chunks is not None:
        asked = asked.where(F.col("chunk_index") < max_chunks)
    told = answers(asked, extractor, known)
    named, related = found_by(asked, told)
    return out | {"answers": told, "named": named, "related": related} | graph_of(named, related)


def totals(status: DataFrame) -> DataFrame:
    """One row: how many files a batch had, and how many of them are ready, empty and failed."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return status.agg(F.count("*").alias("files"), of("ready"), of("empty"), of("failed"))


def ingest_to(folder: str, batch_id: int, docs: DataFrame, pages: DataFrame | None = None, **hooks) -> None:
    """Ingests a batch into the folder. Documents whose content or id an earlier batch has (one that didn't fail) are passed
    over, and answers of earlier batches are used. Batches are known by their numbers: one that is run again, or was
    stopped half way, replaces what it has written and adds nothing twice."""
    spark = docs.sparkSession
    before = {name: _before(spark, folder, name, batch_id) for name in ("documents", "status", "answers")}
    if before["status"] is not None:
        done = before["status"].where("status <> 'failed'").select("doc_id")
        docs = docs.join(done, "doc_id", "left_anti")
        same = before["documents"].join(done, "doc_id", "left_semi").select(F.col("content_id").alias("_content"))
        docs = docs.withColumn("_content", F.md5(F.coalesce("text", F.lit("")))).join(same, "_content", "left_anti").drop("_content") if pages is None else docs
    made = ingest(docs, pages=pages, known=before["answers"], **hooks)
    for name in KEPT:
        if name in made:
            made[name].write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _before(spark: SparkSession, folder: str, name: str, batch_id: int | None) -> DataFrame | None:
    """The table's rows of the batches before batch_id (all, for None); null without any."""
    if not _there(spark, f"{folder}/{name}"):
        return None
    rows = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
    return rows if batch_id is None else rows.where(F.col("batch") < batch_id)


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of the folder's batches, entities and relations merged over them. A key that several batches have counts
    once, the latest of its rows."""
    out = {}
    for name, key in KEPT.items():
        rows = _before(spark, folder, name, None)
        if rows is None:
            continue
        if key is None:
            rows = rows.drop("batch").distinct()
        else:
            kept = [c for c in rows.columns if c not in (key, "batch")]
            rows = rows.groupBy(key).agg(F.max_by(F.struct(*kept), "batch").alias("r")).select(key, "r.*")
        out[name] = rows
    if "named" in out:
        out |= graph_of(out["named"], out["related"])
    return out
