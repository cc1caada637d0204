"""SimHash near duplicates by a Gray-order hierarchical index.

A text's words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, its shingles SHINGLE consecutive words joined by a space,
repeats included (fewer words: one shingle of all). A bit of the fingerprint is set if it is in over half of the
shingles' XXH64 hashes (seed 42); texts without words have fingerprint zero. Two fingerprints are linked if they differ
in at most `radius` bits, and linked documents are in one component. All links between different fingerprints are
found; equal ones are one node.

The index. Fingerprints are cut into segments; two that differ in at most `radius` bits agree in all bits of at least
segments - radius of them. Each choice of that many segments is one order of the index: its top nodes are the bit
patterns under the choice's mask, and below each the fingerprints are sorted by the Gray rank of their other bits, so
that neighbours share many. Runs of FAN are factored upwards: a node holds the mask and the bits that all below it
share. The search goes down pairs of nodes of one top node; the differences in the bits that both sides share are
accumulated (a level counts only bits that the levels above hadn't), and a pair of whole groups is dropped as soon as
they exceed the radius. What is left at the leaves is compared exactly.

The number of segments follows from the number of fingerprints (a top node should hold NODE or fewer), so that work
grows with their number and not with its square; the result is the same for any number.

Each order is dealt by ranges of (top node, Gray rank), so that a frequent pattern is split. A top node that lies in one
range is searched there. Others become blocks of BLOCK fingerprints: pairs of blocks are dropped by the bits that each
block shares, before any fingerprint moves, and each pair left is one unit of work. Tasks hand on a forest of links, not
the pairs.

What is written between the steps goes into as few files as its rows need (the fingerprints: as the documents came in;
the rounds of the components: ROWS in each; one for each core at least), not into one for each partition of a shuffle:
each file costs an executor a commit, and on a local file system processes that it starts for the file's rights.

Null and empty texts have fingerprint zero. Rows that repeat are documents of their own. Ids may be of any type; the
component's id is its smallest one (null only if all are).
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import append_columns, bound_batches, cut, free_names, raw_texts
from papyra.llm.near_duplicates import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Members of a top node to aim at, and of a block; nodes below one node; pairs of nodes that are held at once.
NODE, BLOCK, FAN, PAIRS = 256, 2048, 8, 1 << 18
#: Rows that a task searches at once; rows in a file of those between the rounds of the components.
CHUNK, ROWS = 1 << 15, 1 << 17
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALL = np.uint64(2**64 - 1)


def fingerprint(raw: bytes | None, size: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text."""
    words = raw.translate(LOWER).split() if raw else []
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :]
    hashed = xxhash.xxh64_intdigest
    hashes = np.fromiter([hashed(text[a:b], SEED) for a, b in zip(first[:n].tolist(), last.tolist(), strict=True)], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14), None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the texts' fingerprints, as longs."""

    def start():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            found = np.array([fingerprint(raw) for raw in raw_texts(batch.column(text_col))], np.uint64)
            return [pa.array(found.view(np.int64))]

        return work

    return append_columns(docs, T.StructType([T.StructField(name, T.LongType())]), start)


def segments_for(n: int, radius: int) -> int:
    """The fewest segments with which evenly spread fingerprints have NODE or fewer in a top node."""
    g = radius + 1
    while g < 32 and n > NODE << (64 * (g - radius) // g) and comb(g + 1, radius) <= 512:
        g += 1
    return g


def masks(segments: int, radius: int) -> list[int]:
    """The masks of the index's orders: each choice of segments - radius segments."""
    edges = [64 * k // segments for k in range(segments + 1)]
    bits = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(bits, segments - radius)]


def gray_rank(x: Column) -> Column:
    """The place of x among the Gray codes, as a long whose order is that of the place."""
    for step in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, step))
    return x.bitwiseXOR(F.lit(-(2**63)))


def _long(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


# --- the index in a task -----------------------------------------------------------------------------------------


def levels_of(values: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The index over sorted values: of each level the shared mask, the shared bits, and where each node's children start
    (one more for the end). Level 0 are the values, the last has one node a group."""
    mask, bits = np.full(len(values), ALL), values
    levels = [(mask, bits, np.arange(len(values) + 1))]
    while len(group) > 1 and (group[1:] == group[:-1]).any():
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        place = np.arange(len(group)) - np.repeat(heads, np.diff(np.append(heads, len(group))))
        first = np.flatnonzero(place % FAN == 0)
        every = np.bitwise_and.reduceat(bits & mask, first)
        some = np.bitwise_or.reduceat(bits | ~mask, first)
        mask = ~(every ^ some)
        bits = every & mask
        levels.append((mask, bits, np.append(first, len(group))))
        group = group[first]
    return levels


def _children(starts: np.ndarray, a: np.ndarray, b: np.ndarray):
    """For each pair of nodes all pairs of their children: (number of the pair, child of a, child of b)."""
    na, nb = starts[a + 1] - starts[a], starts[b + 1] - starts[b]
    n = na * nb
    which = np.repeat(np.arange(len(a)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return which, starts[a][which] + k // nb[which], starts[b][which] + k % nb[which]


def linked(values: np.ndarray, group: np.ndarray, radius: int, between: tuple[int, int] | None = None):
    """Yields (i, j) of pairs of one group (or of the two groups `between`) that differ in at most radius bits."""
    levels = levels_of(values, group)
    tops = np.arange(len(levels[-1][0]))
    a, b = (tops, tops) if between is None else (np.array([between[0]]), np.array([between[1]]))
    apart = np.bitwise_count((levels[-1][1][a] ^ levels[-1][1][b]) & levels[-1][0][a] & levels[-1][0][b]).astype(np.int64)
    near = apart <= radius
    todo = [(len(levels) - 1, a[near], b[near], apart[near])]
    while todo:
        level, a, b, apart = todo.pop()
        if len(a) > PAIRS // FAN**2:
            half = len(a) // 2
            todo += [(level, a[:half], b[:half], apart[:half]), (level, a[half:], b[half:], apart[half:])]
            continue
        if not level:
            there = a < b if between is None else np.ones(len(a), bool)
            yield a[there], b[there]
            continue
        mask, _, starts = levels[level]
        which, i, j = _children(starts, a, b)
        if between is None:
            half = i <= j
            which, i, j = which[half], i[half], j[half]
        below, bits, _ = levels[level - 1]
        fresh = below[i] & below[j] & ~(mask[a] & mask[b])[which]
        more = apart[which] + np.bitwise_count((bits[i] ^ bits[j]) & fresh)
        near = more <= radius
        if near.any():
            todo.append((level - 1, i[near], j[near], more[near]))


class Forest:
    """Joins positions; only the first member of each set is kept a position."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def edges(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = np.flatnonzero(self.root != np.arange(len(self.root)))
        return values[self.root[far]], values[far]


def forest_of(values: np.ndarray, group: np.ndarray, radius: int, between: tuple[int, int] | None = None):
    """(a, b): links that join all that is linked within the groups, or between the two."""
    forest = Forest(len(values))
    for i, j in linked(values, group, radius, between):
        forest.join(i, j)
    return forest.edges(values)


# --- the index over the cluster ----------------------------------------------------------------------------------

STEP = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("order_no", T.IntegerType()), T.StructField("top", T.LongType()), T.StructField("every", T.LongType()), T.StructField("some", T.LongType()), T.StructField("members", T.BinaryType())])


def _searched(prints: DataFrame, radius: int, segments: int, block: int) -> DataFrame:
    """Rows of STEP: links found within ranges; and blocks (members not null) of the top nodes that touch a range's
    ends or are larger than a block."""
    chosen = masks(segments, radius)
    key = F.create_map(*[F.lit(v) for n, m in enumerate(chosen) for v in (n, _long(m))])[F.col("order_no")]
    rows = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(chosen) - 1))).alias("order_no"))
    rows = rows.withColumn("mask", key).select("order_no", F.col("fp").bitwiseAND(F.col("mask")).alias("top"), gray_rank(F.col("fp").bitwiseAND(F.bitwise_not("mask"))).alias("rank"), "fp")
    bound_batches(prints.sparkSession)

    def as_links(a, b):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *(pa.nulls(n, f) for f in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], STEP.names)

    def as_blocks(order_no, top, values):
        for at in range(0, len(values), block):
            v = values[at : at + block]
            shared = np.array([np.bitwise_and.reduce(v), np.bitwise_or.reduce(v)]).view(np.int64).tolist()
            row = [None, None, int(order_no), int(top), *shared, v.tobytes()]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], STEP.names)
            yield as_links(*forest_of(v, np.zeros(len(v), np.int64), radius))

    def run(batches):
        held, first = None, True

        def flush(rows, last):
            """Searches the whole top nodes of rows; returns the last one's rows, which may go on."""
            nonlocal first
            order_no, top, fp = rows
            heads = np.flatnonzero(np.append(True, (order_no[1:] != order_no[:-1]) | (top[1:] != top[:-1])))
            ends = np.append(heads[1:], len(fp))
            n = len(heads) if last else len(heads) - 1
            inside = np.arange(n)
            edge = (first & (inside == 0)) | (last & (inside == n - 1)) | (ends[:n] - heads[:n] > block)
            for k in np.flatnonzero(edge):
                yield from as_blocks(order_no[heads[k]], top[heads[k]], fp[heads[k] : ends[k]])
            whole = np.flatnonzero(~edge & (ends[:n] - heads[:n] > 1))
            if len(whole):
                group = np.repeat(whole, ends[whole] - heads[whole])
                at = np.arange(len(group)) - np.repeat(np.cumsum(ends[whole] - heads[whole]) - (ends[whole] - heads[whole]), ends[whole] - heads[whole]) + heads[group]
                yield as_links(*forest_of(fp[at], group, radius))
            if n:
                first = False
            return tuple(c[heads[-1] :] for c in rows) if not last else None

        for batch in batches:
            new = tuple(batch.column(c).to_numpy() for c in ("order_no", "top")) + (batch.column("fp").to_numpy().view(np.uint64),)
            held = new if held is None else tuple(np.concatenate(c) for c in zip(held, new, strict=True))
            if len(held[0]) >= CHUNK:
                held = yield from flush(held, False)
        if held is not None and len(held[0]):
            yield from flush(held, True)

    dealt = rows.repartitionByRange("order_no", "top", "rank").sortWithinPartitions("order_no", "top", "rank")
    return dealt.select("order_no", "top", "fp").mapInArrow(run, STEP)


def _across(blocks: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between blocks of one top node; block_id is theirs alone, and the rows are written."""
    slim = blocks.select("order_no", "top", "block_id", "every", "some")
    other = slim.select("order_no", "top", F.col("block_id").alias("other_id"), F.col("every").alias("every2"), F.col("some").alias("some2"))
    shared = F.bitwise_not(F.col("every").bitwiseXOR(F.col("some"))).bitwiseAND(F.bitwise_not(F.col("every2").bitwiseXOR(F.col("some2"))))
    near = F.bit_count(F.col("every").bitwiseXOR(F.col("every2")).bitwiseAND(shared)) <= radius
    pairs = slim.join(other, ["order_no", "top"]).where((F.col("block_id") < F.col("other_id")) & near).select("block_id", "other_id")
    members = blocks.select("block_id", F.col("members").alias("left"))
    others = blocks.select(F.col("block_id").alias("other_id"), F.col("members").alias("right"))
    both = pairs.join(members, "block_id").join(others, "other_id").select("left", "right")

    def run(batches):
        for batch in batches:
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                group = np.repeat([0, 1], [len(x), len(y)])
                a, b = forest_of(np.concatenate([x, y]), group, radius, (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def links(prints: DataFrame, radius: int = RADIUS, segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the different fingerprints fp (longs) that join all that is linked."""
    if segments is None:
        segments = segments_for(prints.count(), radius)
    found = cut(_searched(prints, radius, segments, block).withColumn("block_id", F.monotonically_increasing_id()))
    within = found.where("members IS NULL").select("a", "b")
    return within.unionByName(_across(found.where("members IS NOT NULL").drop("a", "b"), radius)).distinct()


def simhash_components(docs: DataFrame, radius: int = RADIUS, text_col: str = "text", id_col: str = "doc_id", segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of docs with fingerprint (16 hex digits) and component_id; a column of docs that has such a name is
    replaced."""
    kept = [c for c in docs.columns if c.lower() not in ("fingerprint", "component_id")]
    fp, node, root = free_names(docs, "fp", "fp_node", "fp_root")
    signed = cut(fingerprints(docs.select(kept), text_col, fp))
    prints = signed.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("least"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    prints = cut(prints.coalesce(max(cores, signed.rdd.getNumPartitions())))
    n = prints.count()
    files = max(cores, -(-n // ROWS))
    linked_prints = links(prints.select("fp"), radius, segments or segments_for(n, radius), block)
    found = components(linked_prints, files).withColumnRenamed("sid", node).withColumnRenamed("root", root)
    of_print = prints.join(found, F.col("fp") == F.col(node), "left").withColumn(root, F.coalesce(root, "fp")).drop(node)
    least = of_print.groupBy(F.col(root).alias(node)).agg(F.min("least").alias("component_id"))
    of_print = of_print.join(least, F.col(root) == F.col(node)).select(F.col("fp").alias(node), "component_id")
    hexed = F.lower(F.lpad(F.hex(fp), 16, "0"))
    return signed.join(of_print, F.col(fp) == F.col(node)).select(*kept, hexed.alias("fingerprint"), "component_id")
