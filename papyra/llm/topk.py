"""Exact top-k search by inner product, pruned by segment statistics at several resolutions.

A vector is cut into segments; of each segment of l components only the mean m and the standard deviation s are
kept. Cauchy and Schwarz bound the distance of two vectors from below by the sum of l ((m - m')^2 + (s - s')^2), and
so their inner product, (|x|^2 + |y|^2 - distance^2) / 2, from above by the sum of l (m m' + s s'). A segment of one
component is exact. Candidates go through the levels of RESOLVED coarse to fine: at each level the first part of the
vectors is resolved down to single components, whose products have been summed, and the rest is held as SEGMENTS
segments. Pairs whose bound is below the query's k-th best score so far are dropped; the exact product is completed
for those that survive.

The k-th best score is carried along: each query first gets that among SEEDS rows (a bounded choice that only gives a
lower bound and decides about no result), so that every block prunes from its first rows and hands on only what
reaches it. Queries and candidates are dealt over blocks of bounded size; a task has one block of each. Its best k are
merged with those of the other blocks by a window per query.

Vectors that are null or hold null or non-finite components take no part; vectors are compared with those of the
same length only. Ids may be of any type. Scaled components are held to +-2^62, scores to the range of a long; vectors whose products doubles
don't hold exactly are compared as whole numbers of any size, a small tile at a time. Rows that repeat are candidates
and queries of their own. Ties go to the smaller id, null ids last. Queries without candidates have no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import bound_batches, cut, free_names, placed

#: The share of a vector's components that is resolved at each level, and the segments of the rest.
RESOLVED = (0.0, 0.5, 0.75)
SEGMENTS = 4
QUERY_BLOCK, ROW_BLOCK = 16384, 65536
#: Rows and queries of a tile; below this share of survivors the products are completed pair by pair.
CHUNK, TILE, FEW = 1024, 512, 0.03
#: Tiles of vectors with large components.
LARGE_CHUNK, LARGE_TILE = 512, 16
#: Rows that give the first k-th best scores, and at most so many components of them.
SEEDS, SEED_COMPONENTS = 2048, 1 << 20
#: Blocks are smaller where they would be fewer pairs than this.
LEAST_PAIRS = 16
NONE = np.iinfo(np.int64).max

FOUND = T.StructType([T.StructField("q", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("c", T.LongType()), T.StructField("score", T.LongType())])


def segment_features(x: np.ndarray, n_segments: int) -> np.ndarray:
    """sqrt(l) times each segment's mean and deviation: the bound is the inner product of two rows of these."""
    if not x.shape[1]:
        return np.zeros((len(x), 1))
    parts = np.array_split(x, min(n_segments, x.shape[1]), axis=1)
    means = [np.sqrt(p.shape[1]) * p.mean(1) for p in parts]
    deviations = [np.sqrt(p.shape[1]) * p.std(1) for p in parts]
    return np.stack(means + deviations, axis=1)


def best_of(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """The k best of each row: highest score, then smallest id, then row."""
    order = np.lexsort((rows, ids, -scores), axis=-1)[:, :k]
    return tuple(np.take_along_axis(a, order, 1) for a in (scores, ids, rows))


def survivors(q: np.ndarray, x: np.ndarray, of_q: list, of_x: list, cuts: list[int], alive: np.ndarray, least: np.ndarray, counts: np.ndarray):
    """(columns, exact): exact scores of the pairs of q and x[columns] that no level drops, -inf for the others.

    of_q, of_x: the features of the rest at each level; counts: pairs that reach each level, and those completed.
    """
    columns, partial = np.arange(len(x)), np.zeros(alive.shape)
    for level, (start, stop) in enumerate(zip(cuts, cuts[1:], strict=False)):
        counts[level] += np.count_nonzero(alive)
        alive &= partial + of_q[level] @ of_x[level][columns].T >= least
        held = alive.any(0)
        if not held.all():
            columns, alive, partial = columns[held], alive[:, held], partial[:, held]
        n_alive = np.count_nonzero(alive)
        if n_alive <= FEW * alive.size:
            exact = np.full(alive.shape, -np.inf)
            i, j = np.nonzero(alive)
            exact[i, j] = partial[i, j] + np.einsum("ij,ij->i", q[i, start:], x[columns[j], start:])
            counts[-1] += n_alive
            return columns, exact
        partial += q[:, start:stop] @ x[columns, start:stop].T
    counts[-1] += np.count_nonzero(alive)
    return columns, np.where(alive, partial, -np.inf)


def search_block(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, least: np.ndarray | None = None, counts: np.ndarray | None = None):
    """(scores, ids, rows), each queries x k, of a block; missing ones have row -1. Components are whole numbers
    whose products' sums doubles hold exactly. least: scores below these aren't wanted."""
    m, length = q.shape
    least = np.full(m, -np.inf) if least is None else least
    counts = np.zeros(len(RESOLVED) + 1, np.int64) if counts is None else counts
    scores, best_ids, best_rows = np.full((m, k), -np.inf), np.full((m, k), NONE), np.full((m, k), -1)
    cuts = [int(length * share) for share in RESOLVED] + [length]
    of_q, of_x = ([segment_features(v[:, at:], SEGMENTS) for at in cuts[:-1]] for v in (q, x))
    for top in range(0, m, TILE):
        tile = slice(top, top + TILE)
        for at in range(0, len(x), CHUNK):
            part = slice(at, at + CHUNK)
            reach = np.maximum(scores[tile, -1:], least[tile, None])
            slack = np.where(np.isfinite(reach), 1e-9 * np.abs(reach) + 1e-6, 0.0)
            columns, exact = survivors(q[tile], x[part], [f[tile] for f in of_q], [f[part] for f in of_x], cuts, q_rows[tile, None] != rows[None, part], reach - slack, counts)
            exact[exact < reach] = -np.inf
            n_new = int(np.isfinite(exact).sum(1).max(initial=0))
            if not n_new:
                continue
            pick = np.argpartition(-exact, n_new - 1, axis=1)[:, :n_new]
            new = np.take_along_axis(exact, pick, 1)
            new_ids, new_rows = (np.where(np.isfinite(new), v[part][columns][pick], none) for v, none in ((ids, NONE), (rows, -1)))
            scores[tile], best_ids[tile], best_rows[tile] = best_of(np.hstack([scores[tile], new]), np.hstack([best_ids[tile], new_ids]), np.hstack([best_rows[tile], new_rows]), k)
    return scores, best_ids, best_rows


def search_large(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """The same for components of any size, as whole numbers; a small tile at a time."""
    m = len(q)
    scores, best_ids, best_rows = np.full((m, k), -NONE), np.full((m, k), NONE), np.full((m, k), -1)
    for top in range(0, m, LARGE_TILE):
        tile = slice(top, top + LARGE_TILE)
        for at in range(0, len(x), LARGE_CHUNK):
            part = slice(at, at + LARGE_CHUNK)
            new = np.clip(q[tile].astype(object) @ x[part].astype(object).T, -NONE + 1, NONE).astype(np.int64)
            other = q_rows[tile, None] != rows[None, part]
            new_ids, new_rows = (np.where(other, v[None, part], none) for v, none in ((ids, NONE), (rows, -1)))
            scores[tile], best_ids[tile], best_rows[tile] = best_of(np.hstack([scores[tile], np.where(other, new, -NONE)]), np.hstack([best_ids[tile], new_ids]), np.hstack([best_rows[tile], new_rows]), k)
    return scores, best_ids, best_rows


def _matrix(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def _is_large(x: np.ndarray) -> np.ndarray:
    """Whether a vector's products with others need more than doubles: sums of products of those that don't are below
    2^52."""
    return np.abs(x.astype(np.float64)).max(1, initial=0) ** 2 * max(1, x.shape[1]) >= 2.0**52


def with_least(asks: DataFrame, rows: DataFrame, k: int, longest: int) -> DataFrame:
    """Adds least to the queries: the k-th best score among a bounded number of rows, null if these are too few."""
    n_seeds = max(k + 1, min(SEEDS, SEED_COMPONENTS // max(1, longest)))
    seeds: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("r")).limit(n_seeds).select("r", "n", "x").collect():
        seeds.setdefault(r["n"], []).append((r["r"], r["x"]))
    shared = asks.sparkSession.sparkContext.broadcast(seeds)
    schema = T.StructType([*asks.schema, T.StructField("least", T.LongType())])

    def run(batches):
        ready = {}
        for n, found in shared.value.items():
            x = np.array([v for _, v in found], np.int64).reshape(len(found), n)
            small = ~_is_large(x)
            ready[n] = np.array([r for r, _ in found])[small], x[small].astype(np.float64)
        for batch in batches:
            least: list[int | None] = [None] * len(batch)
            lengths = batch.column("n").to_numpy()
            for n, (seed_rows, x) in ready.items():
                at = np.flatnonzero(lengths == n)
                if not len(at) or len(x) <= k:
                    continue
                q = _matrix(batch.column("x").take(pa.array(at)), n)
                small = ~_is_large(q)
                at, q = at[small], q[small].astype(np.float64)
                own = batch.column("r").to_numpy()[at]
                scores = np.where(own[:, None] != seed_rows[None], q @ x.T, -np.inf)
                for i, s in zip(at, np.partition(scores, -k, axis=1)[:, -k], strict=True):
                    least[i] = int(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], schema.names)

    return asks.mapInArrow(run, schema)


def topk(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of vectors that is a query, its k best other rows.

    Components are floor(scale * x), x as a double; the score is their integer inner product.
    """
    spark = vectors.sparkSession
    if not isinstance(vectors.schema[id_col].dataType, T.IntegralType):  # by the ids' places in their order
        place, asks = free_names(vectors, "id_place", "id_asks")
        numbered = placed(vectors.withColumn(asks, F.coalesce(is_query, F.lit(False))), F.asc_nulls_last(id_col), place)
        numbered = cut(numbered)
        found = topk(numbered, F.col(asks), k, scale, place, vector_col)
        named = lambda name: numbered.select(F.col(place).alias(f"{name}_place"), F.col(id_col).alias(name))
        found = found.withColumnsRenamed({"query_id": "query_id_place", "vec_id": "vec_id_place"})
        return found.join(named("query_id"), "query_id_place").join(named("vec_id"), "vec_id_place").select("query_id", "rank", "vec_id", "score")
    bound_batches(spark)
    parallel = spark.sparkContext.defaultParallelism
    finite = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(vector_col, lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(2.0**62)), F.lit(-(2.0**62)))))
    rows = vectors.select(F.monotonically_increasing_id().alias("r"), F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.when(F.col(vector_col).isNotNull() & finite, whole).alias("x"))
    rows = cut(rows.where("x IS NOT NULL").withColumn("n", F.size("x")))
    counts = rows.agg(F.count("*"), F.count_if("asks"), F.max("n")).first()
    # as many blocks of queries as of rows: what is copied, and what each query gets from all blocks, stays small
    side = math.isqrt(max(LEAST_PAIRS, 2 * parallel) - 1) + 1
    query_blocks = max(1, -(-counts[1] // QUERY_BLOCK), min(side, counts[1] // 64))
    row_blocks = max(1, -(-counts[0] // ROW_BLOCK), min(side, counts[0] // 64))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("r"), F.lit(n)).cast("int")

    asks = with_least(rows.where("asks").drop("asks"), rows, k, counts[2] or 0)
    asks = asks.withColumn("qb", block(query_blocks)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    held = rows.drop("asks").withColumn("rb", block(row_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [pa.table({f.name: pa.array([], pa.int64()) for f in FOUND})]
        if len(left) and len(right):
            length = left.column("n")[0].as_py()
            q, x = _matrix(left.column("x"), length), _matrix(right.column("x"), length)
            q_rows, q_ids = left.column("r").to_numpy(), left.column("id")
            x_rows, ids = right.column("r").to_numpy(), right.column("id").fill_null(NONE).to_numpy()
            least = left.column("least").cast(pa.float64()).fill_null(-np.inf).to_numpy()
            large_q, large_x = _is_large(q), _is_large(x)
            for of_q, of_x, large in ((~large_q, ~large_x, False), (~large_q, large_x, True), (large_q, np.ones(len(x), bool), True)):
                at, to = np.flatnonzero(of_q), np.flatnonzero(of_x)
                if not len(at) or not len(to):
                    continue
                if large:
                    scores, best, best_rows = search_large(q[at], q_rows[at], x[to], ids[to], x_rows[to], k)
                else:
                    scores, best, best_rows = search_block(q[at].astype(np.float64), q_rows[at], x[to].astype(np.float64), ids[to], x_rows[to], k, least[at])
                there = best_rows >= 0
                which = at[np.nonzero(there)[0]]
                vec_ids = pa.array(best[there], mask=best[there] == NONE)
                columns = [pa.array(q_rows[which]), q_ids.combine_chunks().take(pa.array(which)), vec_ids, pa.array(best_rows[there]), pa.array(scores[there].astype(np.int64))]
                found.append(pa.Table.from_arrays(columns, names=FOUND.names))
        return pa.concat_tables(found)

    found = asks.groupBy("n", "qb", "rb").cogroup(held.groupBy("n", "qb", "rb")).applyInArrow(search, FOUND)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "c")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
