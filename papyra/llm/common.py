"""What several of these operators share: row-wise Arrow passes, words, cutting lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: At most so many bytes of rows go to Python at once, whatever the length of the texts.
ARROW_BATCH_BYTES = 4 << 20
#: A worker keeps the hashes of so many words of a task's texts; those of other words are computed each time.
HASHES_KEPT = 1 << 17
#: Rows without texts in a file of those that are written between steps.
FILE_ROWS = 1 << 17

#: Over UTF-8 bytes: A-Z to a-z, every other ASCII byte that is not a digit or letter to a space.
#: Bytes of characters beyond ASCII stay, so words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(raw: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text; null and empty texts have none."""
    return raw.translate(WORD_BYTES).split() if raw else []


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The column's strings as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. In local mode a temporary one serves where none is named."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="papyra-checkpoint-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared checkpoint folder and reads them from there.

    files: in how many files at most (else one for each partition). Each file costs a task and a commit, and on a local
    file system processes that an executor starts for the file's rights.
    """
    checkpoint_dir(df.sparkSession)
    return (df if files is None else df.coalesce(files)).checkpoint()


def files_for(spark: SparkSession, n_rows: int = 0) -> int:
    """In how many files so many rows without texts are written between steps: one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-n_rows // FILE_ROWS))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has a column of (in any case), so that no column is lost."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def placed(df: DataFrame, order: Column, name: str = "place") -> DataFrame:
    """Adds each row's place (from 0) in the order, without a window over all rows: ranges of rows are counted, and a
    row's place is that in its range after the rows of the ranges before. Only the counts go through the driver."""
    part = free_names(df, "part")[0]
    ranged = cut(df.repartitionByRange(order).withColumn(part, F.spark_partition_id()))
    offsets, before = [], 0
    for row in ranged.groupBy(part).count().orderBy(part).collect():
        offsets.append((row[0], before))
        before += row[1]
    starts = df.sparkSession.createDataFrame(offsets, f"{part} int, before long")
    within = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1
    return ranged.withColumn(name, within).join(F.broadcast(starts), part).withColumn(name, F.col("before") + F.col(name)).drop(part, "before")


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session has a smaller bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, with the task's Arrow memory given back at its end: workers stay for later tasks and stages, and
    Arrow's pool would keep what they have freed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return task


def append_columns(df: DataFrame, added: T.StructType, start: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]) -> DataFrame:
    """Every row with the added columns, computed in Arrow batches and without a shuffle.

    `start` runs once in each task and returns a function from a batch to the added arrays. An input column
    that has the name of an added one (in any case) is replaced.
    """
    bound_batches(df.sparkSession)
    new = {f.name.lower() for f in added}
    kept = [f for f in df.schema if f.name.lower() not in new]
    names = [f.name for f in kept] + [f.name for f in added]
    n_kept = len(kept)
    order = [i for i, f in enumerate(df.schema) if f.name.lower() not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            if batch.num_rows:
                arrays = [batch.column(i) for i in order] + work(batch)
                assert len(arrays) == n_kept + len(new)
                yield pa.RecordBatch.from_arrays(arrays, names)

    return df.mapInArrow(freed(run), T.StructType([*kept, *added]))
