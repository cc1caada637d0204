"""Scans of files and logs, and the sinks that write them."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

SESSION_LOG = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("turn_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("user_input", T.StringType()),
        T.StructField("sources", T.ArrayType(T.StringType())),
        T.StructField("covers_turn_ids", T.ArrayType(T.StringType())),
        T.StructField("summary_text", T.StringType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def discover(spark: SparkSession, folder: str, endings: str = "*.{pdf,docx,txt}") -> DataFrame:
    """(path, name, n_bytes, content_id, content) of a folder's files, not of its subfolders; unreadable files are passed over."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", endings).option("ignoreCorruptFiles", "true").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("n_bytes"), F.md5("content").alias("content_id"), "content")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, page_no, text): a text file is one page, trimmed; an empty one has none."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("path"), F.btrim("value", F.lit(" \n\t\r")).alias("text"))
    return rows.where("text <> ''").select("path", F.lit(0).alias("page_no"), "text")


def _docx_text(content: bytes) -> tuple[str | None, str | None]:
    """(text, error): the paragraphs that aren't blank, trimmed, a line each."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
        lines = ("".join(t.text or "" for t in p.iter(f"{WORD_NS}t")).strip() for p in root.iter(f"{WORD_NS}p"))
        return "\n".join(x for x in lines if x), None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        return None, f"{type(e).__name__}: {e}"


def docx_texts(files: DataFrame) -> DataFrame:
    """(path, text, error) of discovered .docx files; one bad file has an error and stops nothing."""

    def run(batches):
        for pdf in batches:
            found = [_docx_text(c) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "text": [t for t, _ in found], "error": [e for _, e in found]})

    return files.where(F.endswith(F.lower("name"), F.lit(".docx"))).select("path", "content").mapInPandas(run, "path string, text string, error string")


def read_session_log(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records, corrupt lines) of JSONL files; blank lines are passed over."""
    raw = spark.read.text(folder).where(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", SESSION_LOG, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_corrupt"), parsed.where(bad).select("value")


def append_session_log(records: DataFrame, folder: str) -> None:
    records.write.mode("append").partitionBy("session_id").json(folder)


def save_vectors(vectors: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Vectors with their metadata; an empty table is legal and stays empty when it is read again."""
    vectors.write.mode(mode).parquet(folder)


def load_vectors(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(folder)
