"""Entities and relations: keys, merged descriptions, upserts, edges."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR, LONGEST = "\n---\n", 2000


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(df: DataFrame, column: str) -> DataFrame:
    """The column in normal form C, for which Spark has no function; batches go to Python through Arrow."""
    return df.withColumn(column, F.pandas_udf(_nfc, "string")(F.col(column)))


def normal_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def entity_id(kind: Column, name: Column) -> Column:
    """The key by which mentions of one thing in different documents meet."""
    return F.md5(F.concat(F.lower(kind), F.lit("::"), normal_name(name)))


def merged_description(items: Column, longest: int = LONGEST) -> Column:
    """Descriptions trimmed, blanks dropped, each once in order, joined. A summariser may replace what is too long;
    without one, or if it fails, the same join holds."""
    kept = F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))
    return F.array_join(kept, SEPARATOR)


def upsert_merged(existing: DataFrame, new: DataFrame, keys: list[str], latest: list[str]) -> DataFrame:
    """Both: keys, latest columns, seq, description. One row a key: its descriptions in order of seq, each once, the
    latest values of the other columns, and whether the key is new."""
    rows = existing.withColumn("_old", F.lit(1)).unionByName(new.withColumn("_old", F.lit(0)))
    done = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("seq", "description"))).alias("d"), F.max("_old").alias("_old"), *[F.max_by(c, F.struct("seq", c)).alias(c) for c in latest]
    )
    return done.select(*keys, *latest, merged_description(F.col("d.description")).alias("description"), (F.col("_old") == 0).alias("is_new"))


def resolve_relations(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations (chunk_id, source, type, target) with the ids of their ends, looked up by name among the entities
    (chunk_id, pos, name, entity_id) of the same chunk; of equal names the last one counts, of equal places the one that
    is first by seq, if there is such a column, and by entity_id. Unresolved ones go."""
    last = Window.partitionBy("chunk_id", "norm").orderBy(F.desc("pos"), *[c for c in ("seq", "entity_id") if c in entities.columns])
    named = entities.withColumn("norm", normal_name(F.col("name"))).withColumn("_n", F.row_number().over(last)).where("_n = 1")
    ends = lambda side: named.select("chunk_id", F.col("norm").alias(f"_{side}"), F.col("entity_id").alias(f"{side}_id"))
    rows = relations.withColumn("_source", normal_name(F.col("source"))).withColumn("_target", normal_name(F.col("target")))
    rows = rows.join(ends("source"), ["chunk_id", "_source"]).join(ends("target"), ["chunk_id", "_target"])
    return rows.drop("_source", "_target").withColumn("relation_key", F.concat_ws("::", "source_id", "type", "target_id"))
