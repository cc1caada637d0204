"""Ranked lexical search: K2-treaps over the grid of terms and documents.

Items ask for their k documents with the highest scores. Terms are [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+ with A-Z
lower-cased, words of whole texts. A document's score sums the impacts of the item's terms, each once, in whole numbers:

    w = floor(1000 ln((2N + 2) / (2 df + 1))),  m = 10 + (90 n N) div L,  impact = w ((10^9 tf) div (1000 tf + 8 m))

with N documents that have a term, L their terms in all, n a document's terms, df documents that hold the term.

One pass over the texts makes postings of the asked terms, a row a document, and counts N, L and df; both are summed in
tasks first. Postings are written to the shared folder and read in blocks of documents. A block's grid has a row for
each asked term, by descending weight, and a column for each document; its K2-treap is a quadtree whose cells exist only
where there is an impact (a bitmap a level, children found by rank) and hold the greatest impact in them. An item's row
paths go down together: a range of documents is bounded by the sum, over the item's terms, of the greatest impact in the
cells on the terms' paths. Ranges are opened best first, STEP at a time, and dropped when their bound is below the k-th
best score that the task has for the item (carried from block to block; equal bounds are opened, as ties go to the
smaller id). A range of one document has its exact score as bound.

A task hands on k rows an item, a window by item merges them after each task's own best. Items are dealt into groups of
at most GROUP_TERMS different terms (the postings of a group are made by a pass of its own; an item with more terms is
a group of its own): what is broadcast, a group's terms and items, has that bound.

Null and empty texts have no terms: such documents don't count and such items have no rows. Items that repeat are items
of their own, so are rows of documents, with equal ids too. Ids may be of any type; null ids come last in ties.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from papyra.llm.common import bound_batches, cut, raw_texts, words_of

#: Different terms of a group of items; documents of a block, and at most so many postings; ranges opened at once.
GROUP_TERMS, BLOCK_DOCS, BLOCK_POSTINGS, STEP = 1 << 18, 8192, 1 << 21, 256


class Treap:
    """The K2-treap of points (row, column, impact) on a square grid of side 2^height."""

    def __init__(self, row: np.ndarray, column: np.ndarray, impact: np.ndarray, height: int):
        self.height = height
        code = np.zeros(len(row), np.int64)
        for bit in range(height):
            code |= (((row >> bit) & 1) << (2 * bit + 1)) | (((column >> bit) & 1) << (2 * bit))
        order = np.argsort(code, kind="stable")
        code, best = code[order], impact[order]
        levels = []
        for _ in range(height):
            levels.append((code, best))
            heads = np.flatnonzero(np.append(True, (code[1:] >> 2) != (code[:-1] >> 2)))
            code, best = code[heads] >> 2, np.maximum.reduceat(best, heads)
        self.top = best
        #: By level from the top: the place of each child among the cells there (-1: no cell), and the cells' maxima.
        self.children, self.best = [], []
        above = code
        for code, best in reversed(levels):
            place = np.full(4 * len(above), -1, np.int32)
            place[4 * np.searchsorted(above, code >> 2) + (code & 3)] = np.arange(len(code))
            self.children.append(place)
            self.best.append(best)
            above = code

    def search(self, rows: np.ndarray, n_columns: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of the columns with scores of `least` or more and above 0, among them all of the k best."""
        least = max(1, least)
        root = int(self.top[0]) * len(rows)
        # batches of ranges, best first: (-bound of the best, number, level, first columns, cells on the paths, bounds)
        todo = [(-root, 0, 0, np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int32), np.array([root]))]
        found_at, found, number = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while todo and -todo[0][0] >= least:
            _, _, level, first, cells, bounds = heapq.heappop(todo)
            keep = bounds >= least
            first, cells = first[keep], cells[keep]
            if level == self.height:
                found_at, found = np.append(found_at, first), np.append(found, bounds[keep])
                if len(found) >= k:
                    least = max(least, int(np.partition(found, len(found) - k)[len(found) - k]))
                    held = found >= least
                    found_at, found = found_at[held], found[held]
                continue
            bit = self.height - level - 1
            quadrant = 2 * ((rows >> bit) & 1)
            place, best = self.children[level], self.best[level]
            firsts, below, sums = [], [], []
            for half in (0, 1):
                child = np.where(cells >= 0, place[4 * cells + quadrant + half], -1)
                bound = np.where(child >= 0, best[child], 0).sum(1)
                start = first + (half << bit)
                near = (bound >= least) & (start < n_columns)
                firsts.append(start[near])
                below.append(child[near])
                sums.append(bound[near])
            first, cells, bounds = np.concatenate(firsts), np.concatenate(below), np.concatenate(sums)
            order = np.argsort(-bounds, kind="stable")
            for at in range(0, len(order), STEP):
                part = order[at : at + STEP]
                number += 1
                heapq.heappush(todo, (-int(bounds[part[0]]), number, level + 1, first[part], cells[part], bounds[part]))
        return found_at, found


def item_groups(items: DataFrame, text_col: str, id_col: str, group_terms: int) -> list[DataFrame]:
    """The items in groups of at most group_terms terms, as frames (item, item_id, terms). Terms are distinct, and items
    without any are left out. Only the items' numbers of terms are summed on the way; groups follow a running sum."""
    bound_batches(items.sparkSession)
    schema = T.StructType([T.StructField("item_id", items.schema[id_col].dataType), T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("n", T.LongType())])

    def run(batches):
        for batch in batches:
            terms = [sorted(set(words_of(raw))) for raw in raw_texts(batch.column("text"))]
            kinds = pa.list_(pa.binary()), pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, kinds[0]), pa.array([len(t) for t in terms], kinds[1])], schema.names)

    read = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    read = cut(read.where("n > 0").withColumn("item", F.monotonically_increasing_id()))
    part = F.shiftright("item", 33)
    totals = {r["p"]: r["n"] for r in read.groupBy(part.alias("p")).agg(F.sum("n").alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(totals):
        offsets.append((p, before))
        before += totals[p]
    if before <= group_terms:
        return [read] if offsets else []
    starts = F.broadcast(read.sparkSession.createDataFrame(offsets, "p long, before long"))  # a row a partition
    running = F.sum("n").over(Window.partitionBy(part).orderBy("item")) + F.col("before") - 1
    dealt = cut(read.join(starts, part == F.col("p")).withColumn("group_no", F.floor(running / group_terms)))
    numbers = sorted(r["group_no"] for r in dealt.select("group_no").distinct().collect())
    return [dealt.where(F.col("group_no") == g) for g in numbers]


def _postings(docs: DataFrame, terms: list[bytes]) -> tuple[DataFrame, int, int, np.ndarray]:
    """(rows (doc_id, n, terms, times) of documents that hold asked terms; N; L; df by term)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(terms)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n", T.LongType()), T.StructField("terms", T.BinaryType()), T.StructField("times", T.BinaryType()), T.StructField("counted", T.ArrayType(T.LongType()))])
    id_kind = to_arrow_type(id_type)

    def run(batches):
        number = {t: k for k, t in enumerate(shared.value)}
        counted = np.zeros(len(number) + 2, np.int64)
        for batch in batches:
            at, sizes, found, times = [], [], [], []
            for k, raw in enumerate(raw_texts(batch.column("text"))):
                words = words_of(raw)
                if not words:
                    continue
                counted[0] += 1
                counted[1] += len(words)
                held = Counter(map(number.get, words))
                held.pop(None, None)
                if held:
                    numbers = np.fromiter(held, np.int32, len(held))
                    counted[numbers + 2] += 1
                    at.append(k)
                    sizes.append(len(words))
                    found.append(numbers.tobytes())
                    times.append(np.fromiter(held.values(), np.int32, len(held)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), pa.array(times, pa.binary()), pa.nulls(len(at), pa.list_(pa.int64()))], schema.names)
        there = np.flatnonzero(counted)
        sums = np.stack([there, counted[there]], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, id_kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([sums], pa.list_(pa.int64()))], schema.names)

    rows = cut(docs.mapInArrow(run, schema))
    pairs = rows.where("size(counted) > 0").select(F.explode(F.sequence(F.lit(0), F.size("counted") - 2, F.lit(2))).alias("k"), "counted")
    sums = pairs.select(F.col("counted")[F.col("k")].alias("what"), F.col("counted")[F.col("k") + 1].alias("n")).groupBy("what").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(terms) + 2, np.int64)
    for r in sums.collect():  # a row an asked term
        counts[r["what"]] = r["n"]
    return rows.where("n IS NOT NULL").drop("counted"), int(counts[0]), int(counts[1]), counts[2:]


def _blocks(batches):
    """Blocks of documents: (batch of ids, numbers of terms, column, term and times of each posting)."""
    for batch in batches:
        n_terms = np.array([len(t) // 4 for t in batch.column("terms").to_pylist()], np.int64)
        at = 0
        while at < len(batch):
            within = np.cumsum(n_terms[at : at + BLOCK_DOCS])
            n = max(1, int(np.searchsorted(within, BLOCK_POSTINGS, side="right")))
            part = batch.slice(at, min(n, len(within)))
            terms = np.frombuffer(b"".join(part.column("terms").to_pylist()), np.int32)
            times = np.frombuffer(b"".join(part.column("times").to_pylist()), np.int32)
            yield part.column("doc_id"), part.column("n").to_numpy(), np.repeat(np.arange(len(part)), n_terms[at : at + len(part)]), terms, times.astype(np.int64)
            at += len(part)


def _search_group(docs: DataFrame, group: DataFrame, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): each task's best rows of each item of a group."""
    spark = docs.sparkSession
    asked = group.select("item", "item_id", "terms").collect()  # GROUP_TERMS terms at most, or one item
    terms = sorted({t for r in asked for t in r["terms"]})
    terms = [bytes(t) for t in terms]
    rows, n_docs, n_words, df = _postings(docs, terms)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    # rows of the grid by descending weight: cells of neighbouring rows then have impacts of a like size
    grid_row = np.empty(len(terms), np.int64)
    grid_row[np.argsort(-weights, kind="stable")] = np.arange(len(terms))
    number = {t: i for i, t in enumerate(terms)}
    wanted = [(r["item"], np.array([number[bytes(t)] for t in r["terms"]], np.int64)) for r in asked]
    shared = spark.sparkContext.broadcast((wanted, weights, grid_row, n_docs, n_words))
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
    id_kind = to_arrow_type(schema["doc_id"].dataType)
    bound_batches(spark)

    def run(batches):
        wanted, weights, grid_row, n_docs, n_words = shared.value
        least = np.zeros(len(wanted), np.int64)
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * len(wanted)
        for ids, n, column, term, times in _blocks(batches):
            m = 10 + 90 * n * n_docs // n_words
            impact = weights[term] * (1_000_000_000 * times // (1000 * times + 8 * m[column]))
            there = np.zeros(len(weights), bool)
            there[term[impact > 0]] = True
            if not there.any():
                continue
            height = max(1, int(max(len(weights), len(ids)) - 1).bit_length())
            treap = Treap(grid_row[term[impact > 0]], column[impact > 0], impact[impact > 0], height)
            which, at, scores = [], [], []
            for i, (_, own) in enumerate(wanted):
                own = own[there[own]]
                if not len(own):
                    continue
                columns, found = treap.search(grid_row[own], len(ids), k, int(least[i]))
                if len(found) > k:  # ties
                    table = pa.table({"id": ids.take(pa.array(columns)), "score": pa.array(found)})
                    first = pc.sort_indices(table, sort_keys=[("score", "descending"), ("id", "ascending")], null_placement="at_end").to_numpy()[:k]
                    columns, found = columns[first], found[first]
                if len(found):
                    best = np.sort(np.append(held[i], found))[-k:]
                    held[i], least[i] = best, best[0] if len(best) == k else 0
                    which += [i] * len(columns)
                    at.append(columns)
                    scores.append(found)
            if which:
                items = pa.array(np.array([x[0] for x in wanted], np.int64)[which])
                yield pa.RecordBatch.from_arrays([items, ids.take(pa.array(np.concatenate(at))).cast(id_kind), pa.array(np.concatenate(scores))], schema.names)

    return rows.mapInArrow(run, schema)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text", group_terms: int = GROUP_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents with the highest scores above 0."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    schema = T.StructType([T.StructField("item_id", items.schema[item_col].dataType), T.StructField("rank", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])
    out = docs.sparkSession.createDataFrame([], schema)
    groups = item_groups(items, item_text_col, item_col, group_terms)
    for group in groups:
        ranked = _search_group(docs, group, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = ranked.join(group.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
        out = found if len(groups) == 1 else out.unionByName(found)
    return out
