"""BM25 over an index of impact-ordered posting blocks, for batches of queries.

The index is a table with a row a shard (at most SHARD_DOCS documents): the shard's keys and terms and, for each term,
its postings by descending impact, so that the first of every BLOCK postings is that block's maximum. An impact is the
part of the score that doesn't depend on how rare the term is, so an index serves any queries. It is made without
a shuffle: texts are read and cut into words once, by the tasks that hold them; the numbers of documents by term are
summed shard by shard. `save` and `load` keep it.

A search gives each task the queries' terms (BROADCAST_ROWS rows of query and term at most; more queries are dealt into
groups). In a shard each query goes two ways. First the best block of each of its terms gives some documents' partial
scores; the k-th best of these, or the k-th best score that the task has from earlier shards, is a lower bound of the
query's k-th score. Then terms whose maxima together stay below the bound can't bring up a document by themselves and are
left out, and of each other term only those blocks are read whose maximum, with the other terms' maxima, reaches the
bound. The documents found so, if their sums and the maxima of what wasn't read reach the bound, get their exact
scores. Tasks hand on k rows a query at most, which a window merges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from papyra.sources.batches import bound_batches, freed
from papyra.sources.scratch import written

K1, B, NEGATIVE_IDF = 1.5, 0.75, 0.25
SCORE_PLACES = 6
#: Documents and words of a shard at most (one document at least), postings of a block.
SHARD_DOCS, SHARD_WORDS, BLOCK = 4096, 1 << 20, 64
#: Rows of query and term that are broadcast at once.
BROADCAST_ROWS = 200_000
#: Sums of doubles in another order differ by less.
SLACK = 1e-5


WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased words: what is left between characters that are no letters, digits or underscores."""
    return WORD.findall(text.lower()) if text else []


@dataclass(frozen=True)
class Index:
    """blocks: a row a shard; terms: (term, df); the number of documents, their words in all, the mean of all idfs."""

    blocks: DataFrame
    terms: DataFrame
    n_docs: int
    n_words: int
    mean_idf: float

    def save(self, folder: str) -> None:
        self.blocks.write.parquet(f"{folder}/blocks")
        self.terms.write.parquet(f"{folder}/terms")
        self.blocks.sparkSession.createDataFrame([(self.n_docs, self.n_words, self.mean_idf)], "n_docs long, n_words long, mean_idf double").coalesce(1).write.parquet(f"{folder}/totals")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Index:
        blocks, terms, totals = (spark.read.parquet(f"{folder}/{t}") for t in ("blocks", "terms", "totals"))
        return Index(blocks, terms, *totals.select("n_docs", "n_words", "mean_idf").first())


def _cut_shards(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """(keys, lengths, words) of shards, from batches of (keys, lists of words)."""
    held, docs, n = [], 0, 0

    def shard():
        keys, words = (pa.concat_arrays(parts) for parts in zip(*held, strict=True))
        return keys, pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64), words.flatten()

    for keys, words in batches:
        lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(keys):
            room = np.cumsum(lengths[at : at + SHARD_DOCS - docs])
            more = int(np.searchsorted(room, SHARD_WORDS - n, side="right"))
            if more == 0 and not docs:
                more = 1
            if more:
                held.append((keys.slice(at, more), words.slice(at, more)))
                docs, n, at = docs + more, n + int(room[more - 1]), at + more
            if at < len(keys):
                yield shard()
                held, docs, n = [], 0, 0
    if held:
        yield shard()


def _counted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(keys, lengths, terms, df, docs, times): shards with their postings by term and document."""
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    longs, key_type = T.ArrayType(T.LongType()), docs.schema[key].dataType
    schema = T.StructType([T.StructField("keys", T.ArrayType(key_type)), T.StructField("lengths", longs), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("df", longs), T.StructField("docs", T.BinaryType()), T.StructField("times", T.BinaryType())])

    def cut(batch):
        return batch.column("key"), pa.array([words_of(t) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))

    def run(batches):
        for keys, lengths, words in _cut_shards(map(cut, batches)):
            coded = words.dictionary_encode()
            term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(keys)), lengths)
            pair, times = np.unique(term * len(keys) + doc, return_counts=True)
            df = np.bincount(pair // len(keys), minlength=len(coded.dictionary))
            row = [pa.ListArray.from_arrays([0, len(v)], v) for v in (keys, pa.array(lengths), coded.dictionary, pa.array(df))]
            yield pa.RecordBatch.from_arrays([*row, pa.array([(pair % len(keys)).astype(np.int32).tobytes()]), pa.array([times.astype(np.int32).tobytes()])], schema.names)

    return texts.mapInArrow(freed(run), schema)


def _by_impact(counted: DataFrame, mean_length: float) -> DataFrame:
    """(keys, terms, df, docs, parts): each term's postings by descending impact."""
    schema = T.StructType([*(counted.schema[c] for c in ("keys", "terms", "df", "docs")), T.StructField("parts", T.BinaryType())])

    def run(batches):
        for batch in batches:
            docs, parts = [], []
            lengths = batch.column("lengths").to_pylist()
            for n, df, raw, raw_times in zip(lengths, batch.column("df").to_pylist(), batch.column("docs").to_pylist(), batch.column("times").to_pylist(), strict=True):
                doc, tf = np.frombuffer(raw, np.int32), np.frombuffer(raw_times, np.int32)
                part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.array(n, np.int64)[doc] / mean_length)) if len(doc) else np.zeros(0)
                order = np.lexsort((doc, -part, np.repeat(np.arange(len(df)), df)))
                docs.append(doc[order].tobytes())
                parts.append(part[order].tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("keys", "terms", "df")), pa.array(docs, pa.binary()), pa.array(parts, pa.binary())], schema.names)

    return counted.mapInArrow(freed(run), schema)


def build(docs: DataFrame, key: str = "key", text: str = "text") -> Index:
    """The index of docs. Null texts are documents without words."""
    bound_batches(docs.sparkSession)
    counted = written(_counted(docs, key, text))
    n_docs, n_words = counted.agg(F.sum(F.size("keys")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n_docs, n_words = n_docs or 0, n_words or 0
    pairs = counted.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select("t.terms", "t.df")
    terms = written(pairs.groupBy(F.col("terms").alias("term")).agg(F.sum("df").alias("df")))
    mean_idf = terms.agg(F.avg(_raw_idf(n_docs))).first()[0] or 0.0
    return Index(written(_by_impact(counted, n_words / n_docs if n_words else 1.0)), terms, n_docs, n_words, mean_idf)


def _raw_idf(n_docs: int) -> Column:
    return F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def best_documents(terms: list[tuple[float, np.ndarray, np.ndarray]], n_docs: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores): those with scores above `least` less SLACK, among them all of the k best. terms: (weight,
    documents, impacts by descending impact)."""
    top = np.array([max(0.0, w * p[0]) for w, _, p in terms])
    lowest = sum(min(0.0, w * p[0]) for w, _, p in terms)  # of terms that lower a score
    first = [(d[:BLOCK], w * p[:BLOCK]) for (w, d, p), t in zip(terms, top, strict=True) if t > 0]
    if first:
        some = np.bincount(np.concatenate([d for d, _ in first]), np.concatenate([x for _, x in first]), n_docs)
        if n_docs > k:
            least = max(least, float(np.partition(some, n_docs - k)[n_docs - k]) + lowest)
    least -= SLACK
    order = np.argsort(top)
    idle = np.zeros(len(terms), bool)
    idle[order[np.cumsum(top[order]) < least]] = True  # together below the bound
    whole, unread = top.sum(), np.where(idle, top, 0.0)
    parts = []
    for n in np.flatnonzero(~idle):
        w, d, p = terms[n]
        end = len(p)
        if w > 0:
            heads = np.arange(0, len(p), BLOCK)
            end = min(len(p), BLOCK * int(np.count_nonzero(w * p[heads] + (whole - top[n]) >= least)))
            if end < len(p):
                unread[n] = w * p[end]
        parts.append((d[:end], w * p[:end]))
    found = np.bincount(np.concatenate([d for d, _ in parts]), np.concatenate([x for _, x in parts]), n_docs) if parts else np.zeros(n_docs)
    met = np.zeros(n_docs, bool)
    for d, _ in parts:
        met[d] = True
    chosen = np.flatnonzero(met & (found + unread.sum() >= least))
    place = np.full(n_docs, -1)
    place[chosen] = np.arange(len(chosen))
    scores = np.zeros(len(chosen))
    for w, d, p in terms:
        at = place[d]
        there = at >= 0
        scores[at[there]] += w * p[there]
    keep = scores >= least
    return chosen[keep], scores[keep]


def _search(index: Index, asked: DataFrame, k: int, shared_words: bool) -> DataFrame:
    """asked: (query_id, term, weight), BROADCAST_ROWS at most. (query_id, key, score): each task's best rows. Shards go to
    Python one by one, as each is larger than a batch."""
    bound_batches(asked.sparkSession)
    rows = asked.select("query_id", "term", "weight").collect()
    queries: dict = {}
    for r in rows:
        queries.setdefault(r["query_id"], []).append((r["term"], r["weight"]))
    id_kind = to_arrow_type(asked.schema["query_id"].dataType)
    key_type = index.blocks.schema["keys"].dataType.elementType
    wanted = sorted({r["term"] for r in rows})
    number = {t: n for n, t in enumerate(wanted)}
    asks = [(np.array([number[t] for t, _ in own]), np.array([w for _, w in own])) for own in queries.values()]
    shared = index.blocks.sparkSession.sparkContext.broadcast((list(queries), wanted, asks))
    schema = T.StructType([asked.schema["query_id"], T.StructField("key", key_type), T.StructField("score", T.DoubleType())])
    key_kind = to_arrow_type(key_type)

    def run(batches):
        ids, wanted, asks = shared.value
        ids, wanted = pa.array(ids, id_kind), pa.array(wanted, pa.string())
        held = [np.zeros(0)] * len(asks)
        for batch in batches:
            for row in range(len(batch)):
                keys, terms = batch.column("keys")[row].values, batch.column("terms")[row].values
                docs, parts = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in (("docs", np.int32), ("parts", np.float64)))
                ends = np.cumsum(batch.column("df")[row].values.to_numpy())
                where = pc.index_in(wanted, value_set=terms).fill_null(-1).to_numpy()
                which, at, scores = [], [], []
                for q, (own, weights) in enumerate(asks):
                    there = where[own]
                    lists = []
                    for n, w in zip(there[there >= 0], weights[there >= 0], strict=True):
                        span = slice(ends[n - 1] if n else 0, ends[n])
                        lists.append((w, docs[span], np.ones(ends[n] - (ends[n - 1] if n else 0)) if shared_words else parts[span]))
                    if not lists:
                        continue
                    least = held[q][0] if len(held[q]) == k else 0.0
                    found, score = best_documents(lists, len(keys), k, least)
                    score = np.round(score, SCORE_PLACES)
                    above = score > 0
                    found, score = found[above], score[above]
                    if len(found) > k:
                        table = pa.table({"key": keys.take(pa.array(found)), "score": pa.array(score)})
                        best = pc.sort_indices(table, sort_keys=[("score", "descending"), ("key", "ascending")]).to_numpy()[:k]
                        found, score = found[best], score[best]
                    if len(found):
                        held[q] = np.sort(np.append(held[q], score))[-k:]
                        which += [q] * len(found)
                        at.append(found)
                        scores.append(score)
                if which:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), keys.take(pa.array(np.concatenate(at))).cast(key_kind), pa.array(np.concatenate(scores))], schema.names)

    return index.blocks.mapInArrow(freed(run), schema)


def _in_groups(asked: DataFrame, search) -> DataFrame:
    """`search` over all asked rows, in groups of whole queries that hold BROADCAST_ROWS rows or so."""
    asked = written(asked)
    n = asked.count()
    if n <= BROADCAST_ROWS:
        return search(asked)
    groups = 2 * n // BROADCAST_ROWS + 1
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups))
    out = None
    for g in range(groups):
        found = search(asked.where(group == g))
        out = found if out is None else out.unionByName(found)
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("key"))
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", "rank", "key", "score")


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, term, qf) of queries (query_id, text)."""
    schema = T.StructType([queries.schema["query_id"], T.StructField("term", T.StringType())])

    def run(batches):
        for batch in batches:
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            at = np.repeat(np.arange(len(words)), [len(w) for w in words])
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(at)), pa.array([w for own in words for w in own], pa.string())], schema.names)

    return queries.select("query_id", "text").mapInArrow(run, schema).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """BM25 Okapi: (query_id, rank, key, score) for queries (query_id, text). A query's term counts as often as it
    occurs; only scores above 0 count. Terms found in more than half of the documents have NEGATIVE_IDF times the mean
    idf instead."""
    raw = _raw_idf(index.n_docs)
    idf = F.when(raw < 0, F.lit(NEGATIVE_IDF * index.mean_idf)).otherwise(raw)
    asked = _asked(queries).join(index.terms, "term").select("query_id", "term", (F.col("qf") * idf).alias("weight"))
    return _ranked(_in_groups(asked, lambda a: _search(index, a, k, False)), k)


def coverage(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, key, score): the share of a query's different words that a document has."""
    asked = _asked(queries)
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("nq"))
    known = asked.join(index.terms, "term", "left_semi").select("query_id", "term", F.lit(1.0).alias("weight"))
    found = _in_groups(known, lambda a: _search(index, a, k, True)).join(sizes, "query_id")
    return _ranked(found.withColumn("score", F.round(F.col("score") / F.col("nq"), SCORE_PLACES)), k)
