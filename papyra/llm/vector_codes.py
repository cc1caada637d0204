"""Codes for vectors by product quantisation, fitted with dual-tree Lloyd rounds in whole numbers.

Components are floor(scale * x). A vector is cut into PARTS parts of consecutive components (the first ones have one
more where the length doesn't divide). The codebook of a part starts as that part of the vectors with the ENTRIES
smallest ids; each round deals all parts to their nearest entries (ties: lower index) and replaces every entry by the
floor of its parts' mean; entries without parts stay. Last, parts are dealt once more, which gives the codes.

Vectors lie in blocks, wherever Spark has them. A block has a tree over each part: halves by the widest component,
with each node's box, number and cached sum; trees are made once and written to the shared folder. A round makes a tree
over the entries, too, and goes down both at once: a pair of nodes is dropped when the least distance of its boxes is
above the greatest distance to another entry node; of single entries one also goes when another is nowhere in the box
farther off. A node with one entry left is dealt whole by its cached sum; leaves that stay uncertain compare points and
the entries left. All of it is in whole numbers, so no bound needs slack. Blocks with components that would overflow
are handled as Python's integers by the same code.

Only sums by entry leave a task, and only codebooks go through the driver: entries x length numbers, at most
MODEL_NUMBERS at once (vectors of more lengths than that holds are fitted in turn).

Vectors that are null or hold null, infinite or NaN components take no part. Vectors of different lengths have
codebooks of their own. Ids and labels may be of any type, null ones included (null ids come last); rows that repeat
are rows of their own, and equal ids are taken in order of their vectors. With fewer rows than ENTRIES there are fewer
entries. Components are held to +-2^62, errors to the range of a long. An empty vector has code 00... and error 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from papyra.llm.common import bound_batches, cut

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Points of a leaf; vectors of a block, and at most so many components of them.
LEAF, BLOCK_ROWS, BLOCK_COMPONENTS = 32, 8192, 1 << 19
#: Numbers of all codebooks that are fitted at once.
MODEL_NUMBERS = 1 << 22
#: Components of this size and above are handled as Python's integers: distances of smaller ones fit in 64 bits.
LARGE = 1 << 24
#: No distance of components held to +-2^62 reaches this.
FAR = 1 << 190
MOST = np.iinfo(np.int64).max


@dataclass
class Tree:
    """A balanced tree over points: level l has 2^l nodes, which are ranges of `order`."""

    points: np.ndarray
    order: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.low) - 1


def starts(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level start, and the end."""
    return (np.arange((1 << level) + 1) * n) >> level


def depth_of(n: int, leaf: int) -> int:
    return max(0, (n // leaf).bit_length() - 1)


def stacked(points: np.ndarray, order: np.ndarray, depth: int) -> Tree:
    """The tree whose order is known; points are in the tree's order."""
    low, high, sums = [], [], []
    for level in range(depth + 1):
        at = starts(len(points), level)[:-1]
        low.append(np.minimum.reduceat(points, at))
        high.append(np.maximum.reduceat(points, at))
        sums.append(np.add.reduceat(points, at))
    return Tree(points, order, low, high, sums)


def grow(points: np.ndarray, leaf: int) -> Tree:
    """A tree over the points (at least one, of one component at least)."""
    n, depth = len(points), depth_of(len(points), leaf)
    order, rough = np.arange(n), points.astype(np.float64)
    for level in range(depth):
        edges = starts(n, level)
        here = rough[order]
        widest = (np.maximum.reduceat(here, edges[:-1]) - np.minimum.reduceat(here, edges[:-1])).argmax(1)
        node = np.repeat(np.arange(1 << level), np.diff(edges))
        order = order[np.lexsort((here[np.arange(n), widest[node]], node))]
    return stacked(points[order], order, depth)


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range number, position) of every position in the ranges."""
    size = last - first
    which = np.repeat(np.arange(len(first)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def descend(tree: Tree, book: np.ndarray) -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
    """(level, nodes, entries): nodes that are dealt whole; and with level None positions of single points."""
    entries = grow(book, 1)
    none = FAR if book.dtype == object else MOST
    level, above, nodes, alive = 0, 0, np.zeros(1, np.int64), np.ones((1, 1), bool)
    while len(nodes):
        single = above > entries.depth
        low, high = tree.low[level][nodes][:, None], tree.high[level][nodes][:, None]
        least, most = (book, book) if single else (entries.low[above], entries.high[above])
        gap = np.maximum(np.maximum(least - high, low - most), 0)
        wide = np.maximum(high - least, most - low)
        near, far = (gap * gap).sum(2), (wide * wide).sum(2)
        alive &= near <= np.where(alive, far, none).min(1)[:, None]
        if single:
            best = np.where(alive, far, none).argmin(1)
            # most that best can be farther off than another entry, anywhere in the box
            toward = book - book[best][:, None]
            squares = (book * book).sum(1)
            more = squares[best][:, None] - squares + 2 * np.maximum(low * toward, high * toward).sum(2)
            others = np.arange(len(book)) != best[:, None]
            alive &= ~(others & ((more < 0) | ((more == 0) & (best[:, None] < np.arange(len(book))))).astype(bool))
            sure = alive.sum(1) == 1
            yield level, nodes[sure], alive[sure].argmax(1)
            nodes, alive = nodes[~sure], alive[~sure]
            if level == tree.depth:
                edges = starts(len(tree.points), level)
                which, at = spread(edges[nodes], edges[nodes + 1])
                i, j = np.nonzero(alive[which])
                away = tree.points[at[i]] - book[j]
                distances = np.full((len(at), len(book)), none, dtype=book.dtype)
                distances[i, j] = (away * away).sum(1)
                if len(at):
                    yield None, at, distances.argmin(1)
                return
        if level < tree.depth:
            level += 1
            nodes = (2 * nodes[:, None] + np.arange(2)).ravel()
            alive = np.repeat(alive, 2, axis=0)
        if not single:
            above += 1
            if above > entries.depth:  # from the entries' leaves to single entries, in their own order
                owner = np.searchsorted(starts(len(book), entries.depth), np.arange(len(book)), side="right") - 1
                place = np.empty(len(book), np.int64)
                place[entries.order] = owner
                alive = alive[:, place]
            else:
                alive = np.repeat(alive, 2, axis=1)


def totals(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) by entry."""
    sums, counts = np.zeros(book.shape, book.dtype), np.zeros(len(book), np.int64)
    for level, at, entry in descend(tree, book):
        if level is None:
            np.add.at(sums, entry, tree.points[at])
            np.add.at(counts, entry, 1)
        else:
            np.add.at(sums, entry, tree.sums[level][at])
            np.add.at(counts, entry, np.diff(starts(len(tree.points), level))[at])
    return sums, counts


def codes_of(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every point, in the order in which the points came."""
    dealt = np.zeros(len(tree.points), np.int64)
    for level, at, entry in descend(tree, book):
        if level is None:
            dealt[at] = entry
        else:
            edges = starts(len(tree.points), level)
            which, places = spread(edges[at], edges[at + 1])
            dealt[places] = entry[which]
    away = tree.points - book[dealt]
    codes, errors = np.empty(len(dealt), np.int64), np.empty(len(dealt), book.dtype)
    codes[tree.order], errors[tree.order] = dealt, (away * away).sum(1)
    return codes, errors


def cuts(length: int, parts: int) -> list[int]:
    """Where the parts begin, and the end."""
    whole, more = divmod(length, parts)
    return [k * whole + min(k, more) for k in range(parts + 1)]


def _blocks(vectors: DataFrame, parts: int) -> DataFrame:
    """(n, ids, labels, orders, points): blocks of vectors of the same length with their trees' orders and points."""
    spark = vectors.sparkSession
    bound_batches(spark)
    id_type, label_type = vectors.schema["id"].dataType, vectors.schema["label"].dataType
    binaries = T.ArrayType(T.BinaryType())
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type)), T.StructField("orders", binaries), T.StructField("points", binaries)])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches):
        for batch in batches:
            lengths = batch.column("n").to_numpy()
            for length in np.unique(lengths).tolist():
                where = np.flatnonzero(lengths == length)
                rows = max(1, min(BLOCK_ROWS, BLOCK_COMPONENTS // max(1, length)))
                for at in range(0, len(where), rows):
                    held = batch.take(pa.array(where[at : at + rows]))
                    x = held.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(held), length)
                    edges = cuts(length, parts)
                    trees = [grow(x[:, a:b], LEAF) if b > a else None for a, b in zip(edges, edges[1:], strict=False)]
                    orders = [t.order.astype(np.int32).tobytes() if t else b"" for t in trees]
                    points = [t.points.tobytes() if t else b"" for t in trees]
                    row = [[length], [held.column("id").to_pylist()], [held.column("label").to_pylist()], [orders], [points]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], schema.names)

    return vectors.mapInArrow(run, schema)


def _trees(row: dict, parts: int) -> Iterator[tuple[int, Tree]]:
    """(part, tree) of a block; parts without components are left out."""
    edges, n = cuts(row["n"], parts), len(row["ids"])
    for part, (order, raw) in enumerate(zip(row["orders"], row["points"], strict=True)):
        width = edges[part + 1] - edges[part]
        if width:
            points = np.frombuffer(raw, np.int64).reshape(n, width)
            yield part, stacked(points, np.frombuffer(order, np.int32), depth_of(n, LEAF))


def _fitting(tree: Tree, book: list[list[int]]) -> tuple[Tree, np.ndarray]:
    """The tree and the book as 64-bit numbers, or as Python's integers where either has large components."""
    most = max((abs(v) for e in book for v in e), default=0)
    if most < LARGE and -LARGE < tree.low[0].min() and tree.high[0].max() < LARGE and tree.points.shape[1] < 1 << 12:
        return tree, np.array(book, np.int64)
    points = tree.points.astype(object)
    return stacked(points, tree.order, tree.depth), np.array(book, object)


def _first_books(vectors: DataFrame, parts: int, entries: int) -> dict[int, list[list[list[int]]]]:
    """By length: for each part its first entries, the parts of the vectors with the smallest ids."""
    order = Window.partitionBy("n").orderBy(F.asc_nulls_last("id"), "x")
    first = vectors.withColumn("place", F.row_number().over(order)).where(F.col("place") <= entries)
    books: dict[int, list] = {}
    for r in first.select("n", "place", "x").orderBy("n", "place").collect():
        edges = cuts(r["n"], parts)
        book = books.setdefault(r["n"], [[] for _ in range(parts)])
        for part in range(parts):
            book[part].append(list(r["x"][edges[part] : edges[part + 1]]))
    return books


def _round(blocks: DataFrame, books: dict, parts: int) -> dict:
    """The books after one round."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    big = T.DecimalType(38, 0)
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("n", "part", "entry", "place")] + [T.StructField("total", big), T.StructField("times", T.LongType())])

    def run(batches):
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                for part, tree in _trees(row, parts):
                    sums, counts = totals(*_fitting(tree, shared.value[row["n"]][part]))
                    key = row["n"], part
                    was = held.get(key, (0, 0))
                    held[key] = was[0] + sums.astype(object), was[1] + counts
        for (n, part), (sums, counts) in held.items():
            e, p = np.indices(sums.shape)
            columns = [np.full(e.size, n), np.full(e.size, part), e.ravel(), p.ravel()]
            arrays = [pa.array(c.astype(np.int32)) for c in columns]
            arrays += [pa.array([Decimal(v) for v in sums.ravel()], pa.decimal128(38, 0)), pa.array(np.repeat(counts, sums.shape[1]))]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    found = blocks.mapInArrow(run, schema).groupBy("n", "part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("times").alias("times"))
    new = {n: [[list(e) for e in book] for book in of_parts] for n, of_parts in books.items()}
    for r in found.where("times > 0").collect():
        new[r["n"]][r["part"]][r["entry"]][r["place"]] = int(r["total"]) // r["times"]
    shared.destroy()
    return new


def digest(book: list[list[list[int]]]) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for part in book for entry in part for v in entry).encode()).hexdigest()


def _encoded(blocks: DataFrame, books: dict, parts: int, schema: T.StructType) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    digests = {n: digest(book) for n, book in books.items()}
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"])
                codes, errors = np.zeros((n, parts), np.uint8), np.zeros(n, object)
                for part, tree in _trees(row, parts):
                    codes[:, part], away = codes_of(*_fitting(tree, shared.value[row["n"]][part]))
                    errors += away.astype(object)
                text = codes.tobytes().hex()
                width = 2 * parts
                found = [row["ids"], row["labels"], [text[k : k + width] for k in range(0, len(text), width)], [min(e, MOST) for e in errors.tolist()], [digests[row["n"]]] * n]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(found, kinds, strict=True)], schema.names)

    return blocks.mapInArrow(run, schema)


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error, codebook): two hex digits a part, the squared distances summed over the parts, and the
    digest of the codebooks used. entries: 256 at most."""
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hex digits, so a codebook has 1 to 256 entries")
    finite = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(vector_col, lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(2.0**62)), F.lit(-(2.0**62)))))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(F.col(vector_col).isNotNull() & finite, whole).alias("x"))
    rows = rows.where("x IS NOT NULL").withColumn("n", F.size("x"))
    blocks = cut(_blocks(rows, parts))
    lengths = sorted(r["n"] for r in blocks.select("n").distinct().collect())
    schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("codebook", T.StringType())])
    out, at = vectors.sparkSession.createDataFrame([], schema), 0
    while at < len(lengths):
        group = [lengths[at]]
        at += 1
        while at < len(lengths) and entries * (sum(group) + lengths[at]) <= MODEL_NUMBERS:
            group.append(lengths[at])
            at += 1
        whole = len(group) == len(lengths)
        these, held = (df if whole else df.where(F.col("n").isin(group)) for df in (rows, blocks))
        books = _first_books(these, parts, entries)
        for _ in range(rounds):
            books = _round(held, books, parts)
        found = _encoded(held, books, parts, schema)
        out = found if whole else out.unionByName(found)
    return out
