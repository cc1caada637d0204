"""The queries of this subpackage and, where SQL can express them, their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from papyra.llm import chat, decontaminate, lexical, line_dedup, mixing, near_duplicates, secrets, simhash, token_counts, topk, toxicity, url_filter, vector_codes
from papyra.llm.common import cut
from papyra.llm.oracles import ORACLES
from papyra.sources.scratch import written

#: The vocabulary for op9; a parameter, read on the driver only.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Rules of the contract: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: A conversation of the contract: texts that look like the template's marks.
MARKED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, _read(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("secrets", lambda x: x["kind"] != "entropy")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), rules)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text")
    marked = spark.createDataFrame(MARKED, "conv_id long, turn long, role string, text string")
    rows = rows.unionByName(marked.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType)))
    turns = chat.parse_turns(chat.read_back(cut(chat.pack(rows))))
    loss = chat.unescape(F.expr("substring(text, cast(loss_start as int) + 1, cast(loss_end - loss_start as int))"))
    turns = turns.select("conv_id", F.struct("turn_no", F.concat("role", F.lit("\n"), "words", F.lit("\n")).alias("said"), loss.alias("loss"), F.length("text").alias("n")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    lost = F.array_join("t.loss", "")
    return whole.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join("t.said", ""), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.aggregate("t", F.lit(0).cast("long"), lambda n, t: n + t["n"]).alias("formatted_chars"),
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, mixing.cyclic_weights(docs))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, byte_fallback = token_counts.read_vocabulary(TOKENIZER)
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, pieces, byte_fallback).select("doc_id", "n_tokens")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.learnable(_read(spark, sf_dir, "labels")))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(toxicity.fold() == 1, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.REJECT).cast("int").alias("predicted"),
        F.col("evidence.doc_id").alias("evidence"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(vector_codes.vector_codes(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")))
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    by_label = found.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    by_label = written(by_label)  # so that Spark knows its size
    both = found.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return both.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.col("codebook").alias("codebooks_sha256"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.ranked_search(docs, _read(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_secrets, op3_url_filter, op4_chat_format, op5_near_duplicates, op6_line_dedup, op7_mix, op8_topk, op9_token_counts, op10_toxicity, op11_vector_codes, op12_simhash, op13_lexical_search)}
QUERIES["pipeline"] = corpus_pipeline.run


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    found = dict(ORACLES)
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
