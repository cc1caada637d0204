"""Many keywords in many texts: one multi-pattern automaton goes once over each text.

Keywords are looked for in whatever case. The automaton over the different keywords is broadcast (AUTOMATON_CHARS
characters at most; more are dealt into groups, each a pass of its own); a worker builds it once. Ranked searches keep the k best
rows of each query in the task and hand on only these, so rows move as queries x k x tasks and not as queries x rows.
Blank and null keywords are in no text, null texts hold none.
"""

from __future__ import annotations

from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from papyra.sources.scratch import written

AUTOMATON_CHARS = 2_000_000
#: Queries whose counts are held at once.
QUERIES = 256
#: The broadcast value whose automaton this worker has, and the automaton.
_latest: list = [None, None]


def _automaton(value: tuple) -> ahocorasick.Automaton:
    """The automaton of a broadcast value (words, ...), which a worker builds once."""
    if _latest[0] is not value:
        automaton = ahocorasick.Automaton()
        for n, word in enumerate(value[0]):
            automaton.add_word(word, n)
        automaton.make_automaton()
        _latest[:] = value, automaton
    return _latest[1]


def _found(shared, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, word number) of the words in the texts, each once a text, by text."""
    at, words = [], []
    if shared.value[0]:
        iterate = _automaton(shared.value).iter
        for n, text in enumerate(texts):
            if text:
                held = {w for _, w in iterate(text)}
                if held:
                    at += [n] * len(held)
                    words += held
    return np.array(at, np.int64), np.array(words, np.int64)


def _asked(keywords: DataFrame) -> DataFrame:
    return keywords.withColumn("_kw", F.lower("keyword")).where(F.trim("_kw") != "")


def _in_groups(rows: DataFrame, by: str, size, most: int) -> list[DataFrame]:
    """The rows in groups of whole `by` values whose sizes are `most` or so together."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    if total <= most:
        return [rows]
    n = 2 * total // most + 1
    return [rows.where(F.pmod(F.xxhash64(by), F.lit(n)) == g) for g in range(n)]


def tagged(rows: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """rows, once for each of the words (_kw, lower-case, AUTOMATON_CHARS characters at most) that the column holds."""
    shared = rows.sparkSession.sparkContext.broadcast((sorted({r[0] for r in words.select("_kw").collect()}),))
    schema = T.StructType([*rows.schema, T.StructField("_kw", T.StringType())])

    def run(batches):
        known = pa.array(shared.value[0], pa.string())
        for batch in batches:
            at, found = _found(shared, batch.column("_text").to_pylist())
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], known.take(pa.array(found))], schema.names)

    return rows.withColumn("_text", F.lower(column)).mapInArrow(run, schema)


def with_words(rows: DataFrame, column: str, keywords: DataFrame, key: str) -> DataFrame:
    """(key, words): the different keywords, lower-case, that the column holds; rows without any are left out. A key's
    rows count as one."""
    words = written(_asked(keywords).select("_kw").distinct())
    found = [tagged(rows.select(key, column), column, g) for g in _in_groups(words, "_kw", F.length("_kw"), AUTOMATON_CHARS)]
    return reduce(DataFrame.unionByName, found).groupBy(key).agg(F.collect_set("_kw").alias("words"))


def containing(rows: DataFrame, column: str, keywords: DataFrame) -> DataFrame:
    """rows joined with the keywords (query_id, keyword) that their column holds. A different keyword is looked for once
    and then finds its queries by an equi-join."""
    asked = _asked(keywords)
    words = written(asked.select("_kw").distinct())
    found = [tagged(rows, column, g) for g in _in_groups(words, "_kw", F.length("_kw"), AUTOMATON_CHARS)]
    return reduce(DataFrame.unionByName, found).join(asked, "_kw").drop("_kw")


class Best:
    """The k best rows of each of n queries: highest score, then first in the order of the columns."""

    def __init__(self, n: int, k: int, order: list[str]):
        self.k, self.order, self.held = k, order, None
        self.least = np.zeros(n, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, rows: pa.Table) -> None:
        """rows: the rows themselves, one a query and score."""
        new = rows.append_column("_q", pa.array(query)).append_column("_s", pa.array(score))
        both = new if self.held is None else pa.concat_tables([self.held, new])
        both = both.sort_by([("_q", "ascending"), ("_s", "descending"), *((c, "ascending") for c in self.order)])
        q = both.column("_q").to_numpy()
        heads = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.repeat(heads, np.diff(np.append(heads, len(q))))
        self.held = both.take(pa.array(np.flatnonzero(place < self.k)))
        q, s = self.held.column("_q").to_numpy(), self.held.column("_s").to_numpy()
        full = np.flatnonzero(np.bincount(q, minlength=len(self.least)) >= self.k)
        last = np.full(len(self.least), np.iinfo(np.int64).max)
        np.minimum.at(last, q, s)
        self.least[full] = last[full]


def _wanted(keywords: DataFrame) -> tuple[list[str], list, list[np.ndarray]]:
    """(different words, query ids, each query's word numbers) of keywords (query_id, _kw)."""
    rows = keywords.select("query_id", "_kw").distinct().collect()  # AUTOMATON_CHARS characters at most
    words = sorted({r["_kw"] for r in rows})
    number, queries = {w: n for n, w in enumerate(words)}, {}
    for r in rows:
        queries.setdefault(r["query_id"], []).append(number[r["_kw"]])
    return words, list(queries), [np.array(sorted(v)) for v in queries.values()]


def _best_in(batch: pa.Table, at: np.ndarray, words: np.ndarray, asks: list[np.ndarray], n_words: int, best: Best, count: bool) -> None:
    """Adds the batch's rows, which are in the order of ties, to the best of the queries that ask for their words."""
    order = np.argsort(words, kind="stable")
    at, ends = at[order], np.cumsum(np.bincount(words, minlength=n_words))
    which, picked, scores = [], [], []
    for q, own in enumerate(asks):
        met = [at[(ends[w - 1] if w else 0) : ends[w]] for w in own]
        n = np.bincount(np.concatenate(met), minlength=len(batch))
        if not count:
            n = np.minimum(n, 1)
        rows = np.flatnonzero(n >= max(1, best.least[q]))
        if len(rows) > best.k:
            top = np.sort(np.partition(n[rows], len(rows) - best.k)[len(rows) - best.k :])[0]
            above, same = rows[n[rows] > top], rows[n[rows] == top]
            rows = np.concatenate([above, same[: best.k - len(above)]])
        if len(rows):
            which.append(np.full(len(rows), q))
            picked.append(rows)
            scores.append(n[rows])
    if which:
        best.add(np.concatenate(which), np.concatenate(scores).astype(np.int64), batch.take(pa.array(np.concatenate(picked))))


def _ranked(found: list[DataFrame], k: int, order: list[str]) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), *order)
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def keyword_top_k(rows: DataFrame, column: str, keywords: DataFrame, k: int, order: list[str], count: bool = True) -> DataFrame:
    """(query_id, score, rank, and the columns of rows): each query's k best rows by the number of its different keywords
    that the column holds (1 for any, without `count`), then by the columns of `order`."""
    text, names = rows.withColumn("_text", F.lower(column)), list(rows.columns)

    def search(asked: DataFrame) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(_wanted(asked))
        schema = T.StructType([asked.schema["query_id"], *rows.schema, T.StructField("score", T.LongType())])
        kind = to_arrow_type(asked.schema["query_id"].dataType)

        def run(batches):
            words, ids, asks = shared.value
            best = Best(len(ids), k, order)
            for batch in batches:
                table = pa.Table.from_batches([batch])
                table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order]))
                at, found = _found(shared, table.column("_text").to_pylist())
                if len(at):
                    _best_in(table.drop_columns(["_text"]), at, found, asks, len(words), best, count)
            if best.held is not None:
                held = best.held.combine_chunks()
                columns = [pa.array(ids, kind).take(held.column("_q").combine_chunks()), *(held.column(c) for c in names), held.column("_s")]
                yield from pa.Table.from_arrays(columns, names=schema.names).to_batches()

        return text.mapInArrow(run, schema)

    return _ranked([search(g) for g in _in_groups(written(_asked(keywords)), "query_id", F.length("_kw"), AUTOMATON_CHARS)], k, order)


def group_top_k(members: DataFrame, keywords: DataFrame, k: int) -> DataFrame:
    """(query_id, score, rank, group_id): members (group_id, words: the keywords, lower-case, that the member holds). Each
    query's k best groups by the number of their members that hold any of its keywords, then by id.

    Members meet by group once, whatever the number of queries. A group of any size is counted batch by batch."""
    dealt = members.where("group_id IS NOT NULL").repartition("group_id").sortWithinPartitions("group_id")

    def search(asked: DataFrame) -> DataFrame:
        shared = members.sparkSession.sparkContext.broadcast(_wanted(asked))
        schema = T.StructType([asked.schema["query_id"], members.schema["group_id"], T.StructField("score", T.LongType())])
        kind = to_arrow_type(asked.schema["query_id"].dataType)

        def run(batches):
            words, ids, asks = shared.value
            known, best = pa.array(words, pa.string()), Best(len(ids), k, ["group_id"])
            open_id, open_counts = None, np.zeros(len(ids), np.int64)  # of the group that may go on

            def close(rows: pa.Array, counts: np.ndarray, first: int) -> None:
                """counts: groups x queries, from the query `first` on."""
                g, q = np.nonzero(counts >= np.maximum(1, best.least[first : first + counts.shape[1]]))
                if len(g):
                    n = counts[g, q]
                    order = np.lexsort((g, -n, q))
                    heads = np.flatnonzero(np.append(True, q[order][1:] != q[order][:-1]))
                    place = np.arange(len(q)) - np.repeat(heads, np.diff(np.append(heads, len(q))))
                    pick = order[place < k]
                    best.add(q[pick] + first, n[pick], pa.table({"group_id": rows.take(pa.array(g[pick]))}))

            for batch in batches:
                lists = batch.column("words")
                number = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy()
                owner = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                order = np.argsort(number, kind="stable")[np.count_nonzero(number < 0) :]
                owner, ends = owner[order], np.cumsum(np.bincount(number[order], minlength=len(words)))
                coded = batch.column("group_id").dictionary_encode()  # in order of appearance, which is that of the ids
                group, n_groups = coded.indices.to_numpy(), len(coded.dictionary)
                goes_on = open_id is not None and coded.dictionary[0].as_py() == open_id
                if open_id is not None and not goes_on:
                    close(pa.array([open_id], coded.dictionary.type), open_counts[None], 0)
                latest = np.zeros(len(ids), np.int64)
                for first in range(0, len(asks), QUERIES):
                    part = asks[first : first + QUERIES]
                    counts = np.zeros((n_groups, len(part)), np.int64)
                    for q, own in enumerate(part):
                        met = np.unique(np.concatenate([owner[(ends[w - 1] if w else 0) : ends[w]] for w in own]))
                        counts[:, q] = np.bincount(group[met], minlength=n_groups)
                    if goes_on:
                        counts[0] += open_counts[first : first + QUERIES]
                    close(coded.dictionary, counts[:-1], first)
                    latest[first : first + QUERIES] = counts[-1]
                open_id, open_counts, id_kind = coded.dictionary[-1].as_py(), latest, coded.dictionary.type
            if open_id is not None:
                close(pa.array([open_id], id_kind), open_counts[None], 0)
            if best.held is not None:
                held = best.held.combine_chunks()
                yield from pa.Table.from_arrays([pa.array(ids, kind).take(held.column("_q").combine_chunks()), held.column("group_id"), held.column("_s")], names=schema.names).to_batches()

        return dealt.mapInArrow(run, schema)

    return _ranked([search(g) for g in _in_groups(written(_asked(keywords)), "query_id", F.length("_kw"), AUTOMATON_CHARS)], k, ["group_id"])


def shared_words_top_k(rows: DataFrame, queries: DataFrame, k: int, key: str, kind: str, bonus: int) -> DataFrame:
    """(query_id, key, score, rank): rows (key, kind, words), queries (query_id, kind, words), words different from each
    other. A pair's score is the number of words that both have, and the bonus if both are of one kind; each query's k best
    with a score above 0, then by key.

    Every task goes over its rows batch by batch, keeps the k best of each query and hands on only these. A query is passed
    over in a batch whose words it can't reach its k-th best score with."""
    flat = queries.select("query_id", F.col(kind).alias("kind"), F.explode_outer("words").alias("_kw"))

    def search(asked: DataFrame) -> DataFrame:
        held: dict = {}
        for r in asked.distinct().collect():  # AUTOMATON_CHARS characters at most
            held.setdefault(r["query_id"], (r["kind"], []))[1].extend([r["_kw"]] if r["_kw"] is not None else [])
        words = sorted({w for _, own in held.values() for w in own})
        number = {w: n for n, w in enumerate(words)}
        asks = [(own_kind, np.array(sorted(number[w] for w in own), np.int64)) for own_kind, own in held.values()]
        shared = rows.sparkSession.sparkContext.broadcast((words, list(held), asks))
        schema = T.StructType([queries.schema["query_id"], rows.schema[key], T.StructField("score", T.LongType())])
        id_kind = to_arrow_type(queries.schema["query_id"].dataType)

        def run(batches):
            words, ids, asks = shared.value
            known, best = pa.array(words, pa.string()), Best(len(ids), k, [key])
            for batch in batches:
                table = pa.Table.from_batches([batch])
                table = table.take(pc.sort_indices(table, sort_keys=[(key, "ascending")]))
                lists = table.column("words").combine_chunks()
                found = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy()
                owner = np.repeat(np.arange(len(table)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                order = np.argsort(found, kind="stable")[np.count_nonzero(found < 0) :]
                owner, times = owner[order], np.bincount(found[order], minlength=len(words))
                ends, kinds = np.cumsum(times), table.column("kind").combine_chunks()
                which, picked, scores = [], [], []
                for q, (own_kind, own) in enumerate(asks):
                    own = own[times[own] > 0]
                    if len(own) + bonus < best.least[q]:
                        continue
                    met = [owner[ends[w] - times[w] : ends[w]] for w in own]
                    n = np.bincount(np.concatenate(met), minlength=len(table)) if met else np.zeros(len(table), np.int64)
                    if own_kind is not None:
                        n = n + bonus * pc.fill_null(pc.equal(kinds, own_kind), False).to_numpy(zero_copy_only=False)
                    at = np.flatnonzero(n >= max(1, best.least[q]))
                    if len(at) > k:
                        last = np.partition(n[at], len(at) - k)[len(at) - k]
                        at = np.concatenate([at[n[at] > last], at[n[at] == last]])[:k]
                    if len(at):
                        which.append(np.full(len(at), q))
                        picked.append(at)
                        scores.append(n[at])
                if which:
                    best.add(np.concatenate(which), np.concatenate(scores).astype(np.int64), table.select([key]).take(pa.array(np.concatenate(picked))))
            if best.held is not None:
                held = best.held.combine_chunks()
                yield from pa.Table.from_arrays([pa.array(ids, id_kind).take(held.column("_q").combine_chunks()), held.column(key), held.column("_s")], names=schema.names).to_batches()

        return rows.select(key, F.col(kind).alias("kind"), "words").mapInArrow(run, schema)

    groups = _in_groups(written(flat), "query_id", F.coalesce(F.length("_kw"), F.lit(1)), AUTOMATON_CHARS)
    return _ranked([search(g) for g in groups], k, [key])
