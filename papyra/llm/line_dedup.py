"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased; it is known by a 128-bit hash.
Keys come in batches, each key with the number of the batch's documents that have it. Runs hold keys sorted by hash
and dealt over partitions by hash, all in the same way, so that runs and batches meet partition by partition, without
a shuffle. A run is `settled` (its keys have been found in `min_docs` documents) or `open` (keys with the number of
documents so far). A new batch

1. merge-anti-joins the settled runs: their keys need no counting any more;
2. merge-joins the open runs, whose counts its keys add to their own;
3. adds its own run, which goes in part to the settled and in part to the open ones.

So each key becomes settled in one run only, and an open key's highest count is its last. When a level has `fanout`
runs they are merged into one run of the next level; a key is rewritten once a level.

Null and empty texts are one empty line. Keys shorter than `min_chars` code points are never dropped. A document
that repeats a line counts once; rows that repeat a document count as documents of their own. An empty table gives
an empty result. Other columns stay whatever they are called, except those that have the name of an added column.
"""

from __future__ import annotations

from collections import Counter
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import append_columns, bound_batches, cut, free_names, freed, raw_texts

SPACE = b" \t\n\x0b\x0c\r"
#: Up to so many frequent keys (16 bytes each) are broadcast; beyond it they are joined.
BROADCAST_KEYS = 400_000
#: A task hands on its counts after so many different keys.
FLUSH_KEYS = 400_000

RUN = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("n_docs", T.LongType())])
BATCHED = T.StructType([T.StructField("batch", T.IntegerType()), *RUN])
HASH = ["h1", "h2"]


def line_keys(raw: bytes | None) -> list[bytes]:
    """The keys of all lines of a text."""
    return [line.strip(SPACE) for line in (raw or b"").lower().split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _halves(digests) -> tuple[list[int], list[int]]:
    pairs = [(int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)) for d in digests]
    return [a for a, _ in pairs], [b for _, b in pairs]


@contextmanager
def _planned_once(spark: SparkSession):
    """Within it plans aren't adaptive: a checkpoint then keeps the partitioning and the order that its plan had."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _dealt(df: DataFrame) -> DataFrame:
    """Rows dealt by hash over as many partitions as the session's shuffles have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *HASH)


def batch_keys(docs: DataFrame, text_col: str, min_chars: int, n_batches: int = 1) -> list[DataFrame]:
    """(h1, h2, n_docs) of each of n_batches batches: keys with the numbers of their documents. The documents are dealt
    over batches by their texts' hashes and read once; counts are summed first within tasks."""
    bound_batches(docs.sparkSession)

    def run(batches):
        counts: list[Counter] = [Counter() for _ in range(n_batches)]
        held = 0

        def out():
            numbers = [n for n, c in enumerate(counts) for _ in range(len(c))]
            h1, h2 = _halves(d for c in counts for d in c)
            sums = [x for c in counts for x in c.values()]
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sums, pa.int64())], BATCHED.names)

        for batch in batches:
            for raw, n in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                before = len(counts[n])
                counts[n].update({_digest(k) for k in set(line_keys(raw)) if long_enough(k, min_chars)})
                held += len(counts[n]) - before
                if held >= FLUSH_KEYS:
                    yield out()
                    counts, held = [Counter() for _ in range(n_batches)], 0
        if held:
            yield out()

    number = F.pmod(F.xxhash64(F.col(text_col)), F.lit(n_batches)).cast("int")
    parts = docs.select(F.col(text_col), number.alias("batch")).mapInArrow(freed(run), BATCHED)
    with _planned_once(docs.sparkSession):
        sums = cut(_dealt(parts).groupBy("batch", *HASH).agg(F.sum("n_docs").alias("n_docs")))
    return [sums.where(F.col("batch") == n).drop("batch") for n in range(n_batches)]


class LineRuns:
    """The levelled runs, each cut from its lineage in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.settled: list[list[DataFrame]] = []
        self.open: list[list[DataFrame]] = []

    def new_lines(self, keys: DataFrame) -> DataFrame:
        """The keys of a batch that aren't settled: a sort-merge anti-join with each settled run."""
        for run in _all(self.settled):
            keys = keys.hint("merge").join(run.select(*HASH).hint("merge"), HASH, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Adds a batch's keys (each once), and merges levels that are full."""
        with _planned_once(self.spark):
            # a batch that batch_keys has dealt isn't dealt again
            keys = keys.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs")).sortWithinPartitions(*HASH)
            keys = self.new_lines(keys).withColumn("known", F.lit(0).cast("long"))
            for run in _all(self.open):
                keys = keys.hint("merge").join(run.withColumnRenamed("n_docs", "seen").hint("merge"), HASH, "left")
                keys = keys.withColumn("known", F.greatest("known", F.coalesce("seen", F.lit(0)))).drop("seen")
            run = cut(keys.select(*HASH, (F.col("n_docs") + F.col("known")).alias("n_docs")))
            self._push(self.settled, run.where(F.col("n_docs") >= self.min_docs))
            self._push(self.open, run.where(F.col("n_docs") < self.min_docs))

    def _push(self, levels: list[list[DataFrame]], run: DataFrame) -> None:
        level = 0
        while True:
            if level == len(levels):
                levels.append([])
            levels[level].append(run)
            if len(levels[level]) < self.fanout:
                return
            # runs dealt in the same way are united partition by partition; of a key's counts the highest is the last
            merged = reduce(DataFrame.unionByName, levels[level]).groupBy(*HASH).agg(F.max("n_docs").alias("n_docs"))
            run, levels[level] = cut(merged.sortWithinPartitions(*HASH)), []
            level += 1

    def frequent(self) -> DataFrame:
        """(h1, h2, n_docs): the settled keys; n_docs is the number with which they settled."""
        runs = _all(self.settled)
        return reduce(DataFrame.unionByName, runs) if runs else self.spark.createDataFrame([], RUN)


def _all(levels: list[list[DataFrame]]) -> list[DataFrame]:
    return [run for level in levels for run in level]


ADDED = T.StructType([T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def _drop_known(docs: DataFrame, dropped, text_col: str, min_chars: int, own_col: str = "") -> DataFrame:
    """Drops lines by a broadcast set of digests, or, where `dropped` is None, by those in the row's column own_col."""

    def start():
        known = frozenset(dropped.value) if dropped is not None else frozenset()

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            own = batch.column(own_col).to_pylist() if dropped is None else None
            texts, lines, gone = [], [], []
            for i, raw in enumerate(raw_texts(batch.column(text_col))):
                bad = known if own is None else frozenset(own[i] or ())
                parts = (raw or b"").split(b"\n")
                keep = parts
                if bad:
                    keep = [p for p, k in zip(parts, line_keys(raw), strict=True) if not (long_enough(k, min_chars) and _digest(k) in bad)]
                texts.append(b"\n".join(keep).decode())
                lines.append(len(parts))
                gone.append(len(parts) - len(keep))
            return [pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())]

        return work

    return append_columns(docs, ADDED, start)


def _drop_joined(docs: DataFrame, frequent: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """The way for any number of frequent keys: texts' keys are joined with them, and what matches goes back to the text.

    A text is known by its 128-bit hash, so a text of which there are many copies is looked up once.
    """
    bound_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("t", T.BinaryType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])

    def explode(batches):
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                digests = {_digest(k) for k in set(line_keys(raw)) if long_enough(k, min_chars)}
                h1, h2 = _halves(digests)
                yield pa.RecordBatch.from_arrays([pa.array([_digest(raw or b"")] * len(h1), pa.binary()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["t", "h1", "h2"])

    def start():
        return lambda batch: [pa.array([_digest(raw or b"") for raw in raw_texts(batch.column(text_col))], pa.binary())]

    found = docs.select(text_col).mapInArrow(freed(explode), schema).join(frequent.select("h1", "h2"), ["h1", "h2"], "left_semi").dropDuplicates()
    digest = F.unhex(F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0")))
    # columns of the documents keep their names, whatever these are
    drop_col, own_t, found_t = free_names(docs, "drop", "t", "t")
    found = found.groupBy(F.col("t").alias(found_t)).agg(F.collect_set(digest).alias(drop_col))
    keyed = append_columns(docs, T.StructType([T.StructField(own_t, T.BinaryType())]), start)
    joined = keyed.join(found, F.col(own_t) == F.col(found_t), "left").drop(own_t, found_t)
    return _drop_known(joined, None, text_col, min_chars, drop_col).drop(drop_col)


def one_of_each(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text) of one row of each different text, known by a 128-bit digest; copies are dropped first within tasks."""
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return docs.select(text_col).withColumn("_digest", digest).dropDuplicates(["_digest"]).drop("_digest")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, n_batches: int = 4, fanout: int = 3, text_col: str = "text", broadcast_keys: int = BROADCAST_KEYS, counted: DataFrame | None = None) -> DataFrame:
    """Adds kept_text (the lines whose key is in fewer than min_docs documents), n_lines and n_dropped. The documents
    are counted in `counted`, if it is given."""
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs, fanout)
    for keys in batch_keys(docs if counted is None else counted, text_col, min_chars, n_batches):
        runs.add(keys)
    frequent = runs.frequent()
    if frequent.count() > broadcast_keys:
        return _drop_joined(docs, frequent, text_col, min_chars)
    keys = [a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True) for a, b, _ in frequent.collect()]
    return _drop_known(docs, spark.sparkContext.broadcast(keys), text_col, min_chars)
