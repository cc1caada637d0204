"""Batched retrieval: queries are rows, and one job answers all of them.

Every retriever returns hits (query_id, rank, key, score) and cuts to the k best of each query by a window; ties go
to the smaller key. Scores are rounded to SCORE_PLACES before ranking, so that the order of a distributed sum
doesn't decide ties.
"""

from __future__ import annotations

from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from papyra.operators.bm25 import SCORE_PLACES, build, search
from papyra.operators.hooks import embed
from papyra.sources.scratch import cut

RRF_K = 60
#: Queries, and numbers of their vectors in all, that are broadcast at most.
BROADCAST_QUERIES, BROADCAST_NUMBERS = 16_384, 1 << 23
#: Rows of a block of vectors and of queries, and queries that are compared at once.
BLOCK_ROWS, BLOCK_QUERIES, TILE = 65_536, 16_384, 256


def top_k(scored: DataFrame, k: int | Column, *order: Column) -> DataFrame:
    """The k first rows of each query in the given order (score, then key), with their rank."""
    order = order or (F.desc("score"), F.asc("key"))
    window = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def filtered_top_k(scored: DataFrame, k: int, keep: Column, overfetch: int | None = None) -> DataFrame:
    """Top k after a filter. Exact: filter first. With overfetch m: rank, keep the first m*k, filter, rank again."""
    if overfetch is None:
        return top_k(scored.where(keep), k)
    return top_k(top_k(scored, overfetch * k).drop("rank").where(keep), k)


def bm25(docs: DataFrame, queries: DataFrame, k: int, key: str = "key", text: str = "text") -> DataFrame:
    """BM25 Okapi over docs, for queries (query_id, text), by an index made for the purpose; where several searches go
    over the same documents, make one with `papyra.operators.bm25` and keep it."""
    return search(build(docs, key, text), queries, k)


def _matrix(column: pa.ChunkedArray, length: int) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), length)


def nearest_pairs(q: np.ndarray, x: np.ndarray, k: int, places: int = SCORE_PLACES, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, squared distance) of the k nearest rows of x of each row of q; of distances that are equal
    to so many places the first rows. reach: no distance above it is wanted, by row of q."""
    found = []
    for at in range(0, len(q), TILE):
        part = q[at : at + TILE]
        near = np.maximum((part * part).sum(1)[:, None] + (x * x).sum(1)[None] - 2.0 * (part @ x.T), 0.0)
        near = np.round(near, places)
        if len(x) > k:
            last = np.partition(near, k - 1, axis=1)[:, k - 1 : k]
            below, same = near < last, near == last
            taken = below | (same & (np.cumsum(same, axis=1) <= k - below.sum(1, keepdims=True)))
        else:
            taken = np.ones(near.shape, bool)
        if reach is not None:
            taken &= near <= reach[at : at + TILE, None]
        i, j = np.nonzero(taken)
        found.append((i + at, j, ((part[i] - x[j]) ** 2).sum(1)))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _first_of_each(found: pa.Table, k: int) -> pa.Table:
    """Of rows (q, near, key) the k first of each q."""
    found = found.sort_by([("q", "ascending"), ("near", "ascending"), ("key", "ascending")])
    q = found.column("q").to_numpy()
    heads = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    place = np.arange(len(q)) - np.repeat(heads, np.diff(np.append(heads, len(q))))
    return found.take(pa.array(np.flatnonzero(place < k)))


def _where_they_lie(vectors: DataFrame, asked: list, schema: T.StructType, k: int, places: int) -> DataFrame:
    """(query_id, key, score): each task's k nearest vectors of each asked (query_id, vector, length)."""
    shared = vectors.sparkSession.sparkContext.broadcast(asked)
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches):
        by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths = np.array([n for _, _, n in shared.value])
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            by_length[n] = rows, np.array([shared.value[r][1] for r in rows], np.float64).reshape(len(rows), n)
        held, reach = None, np.full(len(lengths), np.inf)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = table.column("_n").to_numpy()
            for n in np.unique(sizes).tolist():
                if n not in by_length:
                    continue
                rows, q = by_length[n]
                part = table.take(pa.array(np.flatnonzero(sizes == n))).sort_by("key")
                i, j, distance = nearest_pairs(q, _matrix(part.column("embedding"), n), k, places, reach[rows])
                new = pa.table({"q": rows[i], "near": np.round(distance, places), "key": part.column("key").take(pa.array(j)).combine_chunks(), "score": distance})
                held = _first_of_each(new if held is None else pa.concat_tables([held, new]), k)
                found, near = held.column("q").to_numpy(), held.column("near").to_numpy()
                full = np.bincount(found, minlength=len(lengths)) >= k
                last = np.full(len(lengths), -np.inf)
                np.maximum.at(last, found, near)
                reach = np.where(full, last + 10.0**-places, np.inf)
        if held is not None:
            ids = pa.array([r[0] for r in shared.value], kinds[0])
            yield from pa.Table.from_arrays([ids.take(held.column("q").combine_chunks()), held.column("key").cast(kinds[1]), held.column("score")], names=schema.names).to_batches()

    return vectors.mapInArrow(run, schema)


def _dealt_blocks(vectors: DataFrame, queries: DataFrame, schema: T.StructType, k: int, places: int, block_rows: int, block_queries: int) -> DataFrame:
    """The same for any number of queries: both are dealt over blocks of bounded size; a task compares one block of
    each."""
    side = isqrt(2 * vectors.sparkSession.sparkContext.defaultParallelism - 1) + 1
    n_rows, n_queries = vectors.count(), queries.count()
    row_blocks = max(1, -(-n_rows // block_rows), min(side, n_rows // 512))
    query_blocks = max(1, -(-n_queries // block_queries), min(side, n_queries // 16))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n).cast("long"))
    asked = queries.withColumn("_qb", dealt("query_id", query_blocks)).withColumn("_rb", each(row_blocks))
    held = vectors.withColumn("_rb", dealt("key", row_blocks)).withColumn("_qb", each(query_blocks))
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table([pa.array([], kind) for kind in kinds], names=schema.names)
        length = left.column("_n")[0].as_py()
        right = right.sort_by("key")
        i, j, distance = nearest_pairs(_matrix(left.column("vector"), length), _matrix(right.column("embedding"), length), k, places)
        return pa.table([left.column("query_id").take(pa.array(i)), right.column("key").take(pa.array(j)), pa.array(distance)], names=schema.names)

    return asked.groupBy("_n", "_qb", "_rb").cogroup(held.groupBy("_n", "_qb", "_rb")).applyInArrow(search, schema)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, keep: Column | None = None, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, places: int = SCORE_PLACES, broadcast_queries: int = BROADCAST_QUERIES) -> DataFrame:
    """Exact k nearest by squared Euclidean distance. vectors: (key, embedding, ...), queries: (query_id, vector).

    The queries are read first. If they are no more than may be broadcast, every task compares them with the vectors that
    it holds, by matrix products, and hands on its k nearest of each; no vector moves. More queries are dealt with the
    vectors over blocks. Either way a window merges. Null vectors, and those that hold nulls, take no part; vectors are
    compared with those of the same length.
    """
    if keep is not None:
        vectors = vectors.where(keep)
    full = lambda c: F.col(c).isNotNull() & F.forall(c, lambda v: v.isNotNull())
    vectors = vectors.where(full("embedding")).select("key", "embedding", F.size("embedding").alias("_n"))
    queries = queries.where(full("vector")).select("query_id", "vector", F.size("vector").alias("_n"))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("key", vectors.schema["key"].dataType), T.StructField("score", T.DoubleType())])
    n, numbers = queries.agg(F.count("*"), F.sum("_n")).first()
    if n <= broadcast_queries and (numbers or 0) <= BROADCAST_NUMBERS:
        found = _where_they_lie(vectors, [tuple(r) for r in queries.collect()], schema, k, places)
    else:
        found = _dealt_blocks(vectors, queries, schema, k, places, block_rows, block_queries)
    scored = found.withColumn("score", F.round("score", places))
    return top_k(scored, k, F.asc("score"), F.asc("key")).select("query_id", "rank", "key", "score")


def search_text(first: Column, second: Column, question: Column) -> Column:
    """What a search of vectors asks with: the first keywords if there are any, else the second, else the question."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return F.when(some(first), F.array_join(first, " ")).when(some(second), F.array_join(second, " ")).otherwise(question)


def _by_vectors(rows: DataFrame, asked: DataFrame, k: int, call, places: int) -> DataFrame:
    """The k rows (key, text) nearest to each asked text, by vectors of `call`, or of the library's own without one."""
    made = {} if call is None else {"call": call}
    vectors = embed(rows.select("key", "text"), **made).select("key", "embedding")
    queries = embed(asked.select("query_id", "text"), **made).select("query_id", F.col("embedding").alias("vector"))
    return vector_top_k(vectors, queries, k, places=places)


def entity_vector_search(entities: DataFrame, queries: DataFrame, k: int, call=None, places: int = SCORE_PLACES) -> DataFrame:
    """entities: (key, text); queries: (query_id, ll, hl, text). Entities near to the names (low level), else the topics,
    else the question: (query_id, rank, key, score)."""
    asked = queries.select("query_id", search_text(F.col("ll"), F.col("hl"), F.col("text")).alias("text"))
    return _by_vectors(entities, asked, k, call, places)


def relation_vector_search(relations: DataFrame, queries: DataFrame, k: int, call=None, places: int = SCORE_PLACES) -> DataFrame:
    """relations: (src, dst, src_name, dst_name, type, description); queries: (query_id, ll, hl, text). Relations near to
    the topics (high level), else the names, else the question, with the relation and its card. A relation's text is its
    ends' names with the type between them, then the description; blanks are left out."""
    told = F.filter(F.transform(F.array("src_name", "type", "dst_name", "description"), lambda p: F.trim(F.coalesce(p, F.lit("")))), lambda p: p != "")
    named = relations.withColumn("key", F.concat_ws("::", "src", "dst")).withColumn("text", F.array_join(told, " "))
    asked = queries.select("query_id", search_text(F.col("hl"), F.col("ll"), F.col("text")).alias("text"))
    hits = _by_vectors(named, asked, k, call, places)
    lines = [("Relation", F.concat("src_name", F.lit(" -["), "type", F.lit("]-> "), "dst_name")), ("Source", F.col("src_name")), ("Target", F.col("dst_name")), ("Type", F.col("type")), ("Description", F.col("description"))]
    card = F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit(""))) for name, value in lines])
    return hits.join(named.withColumn("card", card).drop("text"), "key")


def fuse(lists: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (RRF_K + rank) over the lists; ties by first appearance."""
    named = [hits.select("query_id", "key", "rank", F.lit(n).alias("list_no")) for n, hits in enumerate(lists)]
    all_hits = reduce(DataFrame.unionByName, named)
    fused = all_hits.groupBy("query_id", "key").agg(
        F.round(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))), 9).alias("score"), F.min(F.struct("list_no", "rank")).alias("first")
    )
    return top_k(fused, k, F.desc("score"), F.asc("first"), F.asc("key")).select("query_id", "rank", "key", "score")


def first_wins(lists: list[DataFrame], k: int, *key: str) -> DataFrame:
    """Lists in order of priority, each key once, at its first place; cut to k."""
    named = [hits.withColumn("list_no", F.lit(n)) for n, hits in enumerate(lists)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named).withColumnRenamed("rank", "pos")
    once = Window.partitionBy("query_id", *key).orderBy("list_no", "pos")
    rows = rows.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    return top_k(rows, k, F.asc("list_no"), F.asc("pos"))


def or_else(hits: DataFrame, others: DataFrame) -> DataFrame:
    """The hits; for queries that have none, the others."""
    return hits.unionByName(others.join(hits.select("query_id").distinct(), "query_id", "left_anti"))


def rerank(candidates: DataFrame, score: Column | None, depth: int = 50, top_n: int = 5) -> DataFrame:
    """The first `depth` candidates scored again; where the score is null (a failed scorer), and without a scorer,
    the original order holds."""
    if score is None:
        return candidates.where(F.col("rank") <= top_n)
    rows = candidates.where(F.col("rank") <= depth).withColumn("new_score", score)
    failed = F.max(F.col("new_score").isNull().cast("int")).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("new_score", F.when(failed == 1, -F.col("rank").cast("double")).otherwise(F.col("new_score")))
    rows = rows.withColumnRenamed("rank", "old_rank")
    return top_k(rows, top_n, F.desc("new_score"), F.asc("old_rank"))


def keep_years(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Rows within the years; unknown years stay; null bounds are open."""
    year = F.col("year")
    return rows.where(year.isNull() | ((low.isNull() | (year >= low)) & (high.isNull() | (year <= high))))


def relaxed_years(hits: DataFrame, least: int = 3, widen: int = 2) -> DataFrame:
    """hits with (query_id, rank, year, year_from, year_to): the strict filter; if it leaves fewer than `least` rows of
    a query, year_from less `widen`; if that does, no filter. One pass: a query's counts of both tiers choose."""
    year, low, high = F.col("year"), F.col("year_from"), F.col("year_to")
    below = high.isNull() | (year <= high)
    strict = year.isNull() | low.isNull() | ((year >= low) & below)
    wide = year.isNull() | low.isNull() | ((year >= low - widen) & below)
    per_query = Window.partitionBy("query_id")
    rows = hits.withColumn("_strict", strict).withColumn("_wide", wide)
    rows = rows.withColumn("_n1", F.sum(F.col("_strict").cast("int")).over(per_query)).withColumn("_n2", F.sum(F.col("_wide").cast("int")).over(per_query))
    kept = F.when(F.col("_n1") >= least, F.col("_strict")).when(F.col("_n2") >= least, F.col("_wide")).otherwise(F.lit(True))
    return rows.where(kept).drop("_strict", "_wide", "_n1", "_n2")


def context(hits: DataFrame, path: str = "file_path", index: str = "chunk_index", content: str = "content") -> DataFrame:
    """One text a query: `[i] path#chunk-n`, the content, joined by blank lines; and the sources, each once, in order."""
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col(path), F.lit("#chunk-"), F.col(index), F.lit("\n"), F.col(content))
    rows = hits.withColumn("_line", line).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("_line").alias("line"), F.col(path).alias("path")))).alias("rows"))
    return rows.select("query_id", F.array_join("rows.line", "\n\n").alias("context"), F.array_join(F.array_distinct("rows.path"), ";").alias("sources"))


def placed(rows: DataFrame, *order) -> DataFrame:
    """All rows with their place (from 1) in the order, which should be total. Ranges are sorted apart; a row's place is
    its place within its range and the number of rows in the ranges before."""
    # the low 33 bits of the id are the row's number within its partition, the others the partition's
    ranges = cut(rows.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    of_range = F.shiftright("_id", 33)
    before, offsets = 0, []
    for r in ranges.groupBy(of_range.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        offsets.append((r["p"], before))
        before += r["n"]
    counted = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_p long, _before long"))  # a row a range
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranges.withColumn("_p", of_range).join(counted, "_p").withColumn("place", place).drop("_p", "_id", "_before")
