"""Tables dealt by key into partitions, so that deletes and upserts rewrite only the partitions that they touch.

A table lies in directories part=0, part=1, ... by the hash of its keys. A change first finds the partitions that hold one
of its keys (keys alone are read), then reads, changes and overwrites these in one job (dynamic partition overwrite, which
puts new files in place when the job has ended); all others keep their files. Each partition has one ground row without
data, which readers don't see, so that a partition that loses its last row is overwritten, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators.graph import lost_support
from papyra.sources.scratch import written

PARTS = 64
#: The tables that hang on a document, and their keys.
KEYS = {"documents": ["doc_id"], "chunks": ["chunk_id"], "cites": ["doc_id", "ref_id"], "mentions": ["chunk_id", "entity_id"], "relations": ["src", "dst", "type"], "entities": ["entity_id"], "vectors": ["chunk_id"], "status": ["doc_id"]}


def _part(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    rows.repartition("part").write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", mode).parquet(path)


def deal(rows: DataFrame, path: str, keys: list[str], parts: int = PARTS) -> None:
    """Writes a table anew."""
    spark = rows.sparkSession
    ground = spark.range(parts).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema], F.lit(True).alias("_ground"), F.col("id").cast("int").alias("part"))
    _write(rows.withColumns({"_ground": F.lit(False), "part": _part(keys, parts)}).unionByName(ground), path, "static")


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return _raw(spark, path).where("NOT _ground").drop("_ground", "part")


def _parts_of(spark: SparkSession, path: str) -> int:
    return _raw(spark, path).where("_ground").count()


def _same(keys: list[str], other: DataFrame, own: DataFrame) -> Column:
    on = F.lit(True)
    for k in keys:
        on &= own[k].eqNullSafe(other[f"_{k}"])
    return on


def _named(ids: DataFrame, keys: list[str]) -> DataFrame:
    return ids.select([F.col(k).alias(f"_{k}") for k in keys]).distinct()


def remove(spark: SparkSession, path: str, ids: DataFrame, on: list[str]) -> int:
    """Removes the rows that agree with a row of ids in the columns `on`; returns how many there were."""
    gone = written(_named(ids, on))
    rows = _raw(spark, path)
    hit = rows.where("NOT _ground").select("part", *on)
    found = {r["part"]: r["n"] for r in hit.join(gone, _same(on, gone, hit), "left_semi").groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    if found:
        touched = rows.where(F.col("part").isin(list(found)))
        kept = touched.where("NOT _ground")
        kept = kept.join(gone, _same(on, gone, kept), "left_anti").unionByName(touched.where("_ground"))
        _write(kept, path, "dynamic")
    return sum(found.values())


def put(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> None:
    """Inserts rows or replaces those of the same keys (the keys by which the table was dealt; each once in new)."""
    new = written(new.withColumns({"_ground": F.lit(False), "part": _part(keys, _parts_of(spark, path))}))
    parts = [r["part"] for r in new.select("part").distinct().collect()]
    if parts:
        touched = _raw(spark, path).where(F.col("part").isin(parts))
        named = _named(new, keys)
        old = touched.where("NOT _ground")
        kept = old.join(named, _same(keys, named, old), "left_anti").unionByName(touched.where("_ground"))
        _write(kept.unionByName(new), path, "dynamic")


def remove_documents(spark: SparkSession, folder: str, doc_ids: DataFrame, keep_documents: bool = False) -> dict[str, int]:
    """Removes documents and all that only they support from the dealt tables below the folder (those of KEYS that are
    there: chunks, cites, mentions, vectors, relations whose ends no chunk mentions together any more, entities that none
    mentions any more); how many rows of each table went. keep_documents: the documents' own rows stay (they are about to
    be read again)."""
    there = {n for n in KEYS if spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}").getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}"))}
    at = lambda n: f"{folder}/{n}"
    ids = written(doc_ids.select("doc_id").distinct())
    chunks = load(spark, at("chunks"))
    gone = written(chunks.join(ids, "doc_id", "left_semi").select("chunk_id").distinct())
    relations = load(spark, at("relations")).select("src", "dst") if "relations" in there else spark.createDataFrame([], "src long, dst long")
    _, stale, orphans = lost_support(relations, load(spark, at("mentions")), gone)
    out = {}
    if "relations" in there:
        out["relations"] = remove(spark, at("relations"), stale, ["src", "dst"])
    plans = {"entities": (orphans, "entity_id"), "mentions": (gone, "chunk_id"), "vectors": (gone, "chunk_id"), "chunks": (ids, "doc_id"), "cites": (ids, "doc_id")}
    if not keep_documents:
        plans |= {"documents": (ids, "doc_id"), "status": (ids, "doc_id")}
    for name, (which, column) in plans.items():
        if name in there:
            out[name] = remove(spark, at(name), which, [column])
    return out
