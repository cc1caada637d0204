"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

The classifier is fitted on a bounded sample of labelled rows: at most MAX_LABELLED of them, of which the index has at
most MAX_EXAMPLES texts of each label with MAX_POSTINGS different words in all. Everything else is counted over all
documents.

A text's vector is its TF-IDF vector over words, tf = 1 + ln(count), idf = ln(1 + n / (df + 0.5)), with n and df counted
over all documents, scaled to length 1; a word that no example has counts in the length only, with the idf of a word of
one document. Its neighbours are the k examples with the greatest cosine, exactly. An inverted list keeps for each block
of examples the greatest weight in it; the blocks with the highest bounds are read first, then those whose bound reaches
the k-th best. (Features of many examples have rows instead, whose sums are known before.) Ties go to the example with the smaller number, which follows from its text and label. The vote is the
share of label 1 among the neighbours, each weighted by a power of its cosine.

Two texts that differ in one toxic passage are near neighbours, so the vote alone can't tell them apart. Beside it stands
the evidence of telling terms: short words, prefixes of longer ones (inflected forms of one stem then meet) and prefixes
that several different words share. How many labelled documents of each label have a term is counted; those much more
frequent in one label than in the other (a lift of LIFT and a z-score of LEAST_Z at least) and found in LEAST_SHARE of its
texts at least, so that no group of copies makes its own, are telling. A text's evidence
is the sum of the log odds of its telling terms, as a whole and in relation to the text's length.

Of two thirds of the labelled rows the index is made; the rest calibrates: a logistic regression (RIDGE keeps its weights
small) of the label on the vote and the evidence gives the score. A text with the same vector as some of its neighbours
(cosine 1 to six places) has their share of label 1 instead. A score depends on the text only.

Null texts are empty. Labels other than 0 and 1 and labels of unknown documents are left out; a document with
several labels counts as 1 if any is 1; of rows that bear the same id one text is learned from. Ids may be of any type.
Without labels of both kinds nothing can be told apart: all scores are 0, or 0.5
if only label 1 is known. A text without words has no neighbours and no evidence. Rows that repeat are scored one by one; other
columns stay, except those that have the name of an added column.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from papyra.llm.common import append_columns, bound_batches, cut, freed, raw_texts, words_of

PREFIXES = (4, 5, 7)
#: A prefix that so many different words of a text share is a term of its own.
REPEATS = (2, 3)
LIFT, LEAST_Z, LEAST_SHARE = 3.0, 5.0, 0.05
#: Documents with this score or more are rejected.
REJECT = 0.7
#: The classifier is fitted on at most so many labelled rows, those with the smallest hashes of their ids.
MAX_LABELLED = 24_000
MAX_EXAMPLES = 1024
#: Different words of all examples together; an example that would exceed it is passed over.
MAX_POSTINGS = 1_000_000
BLOCK = 64
#: Features of at least this share of the examples are held as rows, not as lists; texts that are multiplied with them at
#: once.
DENSE, TOGETHER = 0.06, 64
#: So many blocks are read first.
FIRST_BLOCKS = 2
K = 31
#: A neighbour's vote counts as its cosine to this power.
STEEPNESS = 8
FLUSH_TERMS = 300_000
#: A text's length counts in units of so many words.
LENGTH_UNIT = 50
WORDS_KEPT = 500_000
#: The penalty of the calibration's weights, and its steps.
RIDGE, STEPS = 1.0, 30
FEATURES = 5


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; rows with 1 are held out from learning."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from."""
    return labels.where(fold() != 1)


def prefixes_of(word: bytes) -> tuple[bytes, ...]:
    """The word's beginnings, cut between characters; a shorter word's is the word itself, marked."""
    if len(word) <= PREFIXES[0]:
        return (b"=" + word,)
    if word.isascii():
        return tuple(word[:n] for n in PREFIXES if len(word) > n)
    text = word.decode()
    return tuple(text[:n].encode() for n in PREFIXES if len(text) > n) or (b"=" + word,)


def terms_of_text(words: list[bytes]) -> set[bytes]:
    """All terms of a text: prefixes, and those that several different words share once more (marked 2, 3)."""
    shared: Counter = Counter()
    for w in set(words):
        shared.update(prefixes_of(w))
    terms = set(shared)
    terms.update(b"%d" % n + p for p, m in shared.items() for n in REPEATS if m >= n)
    return terms


def word_key(word: bytes) -> int:
    """Words are known by 64-bit hashes, so a vocabulary's size doesn't depend on their lengths."""
    return xxhash.xxh3_64_intdigest(word)


def ragged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from starts[i] to ends[i], for every i in turn, and the i of each."""
    lengths = ends - starts
    owner = np.repeat(np.arange(len(starts)), lengths)
    return np.arange(len(owner)) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths), owner


class WordNumbers(dict):
    """Word -> its number in the vocabulary, or -1. The telling terms of words that have any are kept beside."""

    def __init__(self, vocabulary: np.ndarray, telling: dict[bytes, float]):
        super().__init__()
        self.number_of = {k: n for n, k in enumerate(vocabulary.tolist())}
        self.telling = telling
        self.twice = {t[1:] for t in telling if t[:1].isdigit() and int(t[:1]) in REPEATS}
        self.terms: dict[bytes, tuple] = {}

    def __missing__(self, word: bytes) -> int:
        if self.telling:
            before = prefixes_of(word)
            known = [t for t in before if t in self.telling]
            repeated = [p for p in before if p in self.twice]
            if known or repeated:
                self.terms[word] = known, repeated
        n = self[word] = self.number_of.get(word_key(word), -1)
        return n

    def of(self, counts: Counter) -> tuple[np.ndarray, Counter]:
        """The numbers of a text's words, and how often each telling term occurs."""
        if len(self) > WORDS_KEPT:
            self.clear()
            self.terms.clear()
        numbers = np.fromiter(map(self.__getitem__, counts), np.int64, len(counts))
        telling: Counter = Counter()
        shared: Counter = Counter()
        for w in counts.keys() & self.terms.keys():
            known, repeated = self.terms[w]
            for t in known:
                telling[t] += counts[w]
            shared.update(repeated)
        telling.update({t: 1 for p, m in shared.items() for n in REPEATS if m >= n and (t := b"%d" % n + p) in self.telling})
        return numbers, telling


@dataclass
class Model:
    """The index and what scoring needs; bounded by MAX_LABELLED, MAX_EXAMPLES and MAX_POSTINGS.

    Features are words, numbered in order of their keys. telling has each telling term's log odds. An entry is a feature in a block of
    examples: `starts` has the place of each feature's first entry, `blocks` and `most` the block and the greatest
    weight of each entry, `at` the place of its first posting; `examples` and `weights` are the postings. Features that
    occur in many examples have a row in `dense` instead of postings (`row` has its number, or -1).
    """

    telling: dict[bytes, float] = field(default_factory=dict)
    k: int = K
    share: float = 0.0
    id_type: T.DataType = field(default_factory=T.LongType)
    names: list = field(default_factory=list)
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray | None = None
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rarest: float = 1.0
    lists: dict[str, np.ndarray] = field(default_factory=dict)

    def ready(self) -> Model:
        """Makes what isn't sent with the model: a worker does it once."""
        self.numbers = WordNumbers(self.vocabulary, self.telling)
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "numbers"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.ready()

    def vector(self, numbers: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, weights) of a text's vector, in order of numbers, without the words that no example has (-1)."""
        if not len(numbers):
            return np.zeros(0, np.int64), np.zeros(0)
        seen = numbers >= 0
        weights = 1.0 + np.log(times)
        weights *= np.where(seen, self.idf[numbers], self.rarest) if len(self.idf) else self.rarest
        weights = weights[seen] / math.sqrt(float(weights @ weights))
        numbers = numbers[seen]
        order = np.argsort(numbers)
        return numbers[order], weights[order]

    def index(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Makes the inverted lists of the examples' vectors."""
        features = np.concatenate([f for f, _ in vectors])
        examples = np.repeat(np.arange(len(vectors)), [len(f) for f, _ in vectors])
        weights = np.concatenate([w for _, w in vectors])
        order = np.lexsort((examples, features))
        features, examples, weights = features[order], examples[order], weights[order]
        n_features, n_blocks = len(self.vocabulary), -(-len(vectors) // BLOCK)
        blocks = examples // BLOCK
        new = np.ones(len(features), bool)
        new[1:] = (features[1:] != features[:-1]) | (blocks[1:] != blocks[:-1])
        entry_at = np.flatnonzero(new)
        found = np.bincount(features, minlength=n_features)
        often = np.flatnonzero(found >= max(BLOCK, DENSE * len(vectors)))
        row = np.full(n_features, -1)
        row[often] = np.arange(len(often))
        dense = np.zeros((len(often), n_blocks * BLOCK))
        held = row[features] >= 0
        dense[row[features[held]], examples[held]] = weights[held]
        self.lists = {
            "starts": np.searchsorted(features[entry_at], np.arange(n_features + 1)),
            "blocks": blocks[entry_at],
            "most": np.maximum.reduceat(weights, entry_at),
            "at": np.append(entry_at, len(features)),
            "examples": examples,
            "weights": weights,
            "row": row,
            "dense": dense,
        }

    def known(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the features that are held as rows add to the cosines of texts (rows) and examples, by one product."""
        rows = self.lists["row"]
        mine = np.zeros((len(vectors), len(self.lists["dense"])))
        for n, (numbers, weights) in enumerate(vectors):
            at = rows[numbers]
            mine[n, at[at >= 0]] = weights[at >= 0]
        return mine @ self.lists["dense"]

    def nearest(self, numbers: np.ndarray, weights: np.ndarray, scores: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The k examples of the highest cosine, exactly; (cosine to 6 places, number), best first. scores: a row of what
        `known` gives, which is changed."""
        if not self.lists or not len(numbers):
            return []
        lists = self.lists
        scores = self.known([(numbers, weights)])[0] if scores is None else scores
        n, n_blocks = len(self.labels), len(scores) // BLOCK
        listed = lists["row"][numbers] < 0
        numbers, weights = numbers[listed], weights[listed]
        entries, owner = ragged(lists["starts"][numbers], lists["starts"][numbers + 1])
        of_block, entry_weights = lists["blocks"][entries], weights[owner]
        # of rows the sums are known, of lists the greatest weights
        bounds = scores.reshape(n_blocks, BLOCK).max(1) + np.bincount(of_block, entry_weights * lists["most"][entries], n_blocks)

        def read(chosen: np.ndarray) -> None:
            which = chosen[of_block]
            at = entries[which]
            places, entry = ragged(lists["at"][at], lists["at"][at + 1])
            if len(places):
                scores[:] += np.bincount(lists["examples"][places], lists["weights"][places] * entry_weights[which][entry], len(scores))

        first = np.zeros(n_blocks, bool)
        first[np.argsort(-bounds, kind="stable")[:FIRST_BLOCKS]] = True
        read(first)
        reach = np.partition(scores, -self.k)[-self.k] if n >= self.k else 0.0
        rest = ~first & (bounds >= max(reach - 1e-5, 1e-12))
        if rest.any():
            read(rest)
        rounded = np.round(scores[:n], 6)
        last = np.partition(rounded, -self.k)[-self.k] if n >= self.k else 0.0
        there = np.flatnonzero((rounded >= last) & (rounded > 0))
        best = there[np.lexsort((there, -rounded[there]))][: self.k]
        return [(float(rounded[i]), int(i)) for i in best]

    def look(self, texts: list[list[bytes]]) -> list[tuple[list[float], list[tuple[float, int]]]]:
        """Of each text's words the features of calibration (the vote first) and the nearest examples."""
        out = []
        for at in range(0, len(texts), TOGETHER):
            part = texts[at : at + TOGETHER]
            counted = [Counter(words) for words in part]
            read = [self.numbers.of(counts) for counts in counted]
            vectors = [self.vector(numbers, np.fromiter(counts.values(), np.float64, len(counts))) for counts, (numbers, _) in zip(counted, read, strict=True)]
            known = self.known(vectors) if self.lists else [None] * len(part)
            for words, (_, telling), vector, scores in zip(part, read, vectors, known, strict=True):
                near = self.nearest(*vector, scores)
                out.append(([vote_of(near, self.labels), *evidence_of([self.telling[t] for t in sorted(telling)], len(words))], near))
        return out

    def score(self, features: list[float], near: list[tuple[float, int]]) -> float:
        if self.weights is None:
            return min(self.share, 0.5)
        copies = [self.labels[n] for s, n in near if s >= 1.0]
        if copies:
            return float(sum(copies) / len(copies))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, float(np.append(features, 1.0) @ self.weights)))))


def vote_of(near: list[tuple[float, int]], labels: np.ndarray) -> float:
    weights = [s**STEEPNESS for s, _ in near]
    total = sum(weights)
    return sum(w * labels[n] for w, (_, n) in zip(weights, near, strict=True)) / total if total else 0.0


def evidence_of(odds: list[float], n_words: int) -> list[float]:
    """Of telling terms' log odds: what speaks for label 1 and for label 0, damped, and both in relation to the length."""
    most, least = math.log1p(math.fsum(x for x in odds if x > 0)), math.log1p(math.fsum(-x for x in odds if x < 0))
    length = max(1, n_words // LENGTH_UNIT).bit_length()
    return [most, most / length, least, least / length]


def count_terms(labelled: DataFrame, text_col: str) -> DataFrame:
    """(term, n0, n1): in how many documents of each label a term occurs."""
    bound_batches(labelled.sparkSession)
    schema = T.StructType([T.StructField("term", T.BinaryType()), T.StructField("n0", T.LongType()), T.StructField("n1", T.LongType())])

    def run(batches):
        counts = (Counter(), Counter())

        def out():
            terms = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], ["term", "n0", "n1"])

        for batch in batches:
            for raw, label in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                counts[label].update(terms_of_text(words_of(raw)))
                if len(counts[0]) + len(counts[1]) > FLUSH_TERMS:
                    yield out()
                    for c in counts:
                        c.clear()
        if counts[0] or counts[1]:
            yield out()

    return labelled.select(F.col(text_col), "toxic").mapInArrow(freed(run), schema).groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def telling_terms(counts: DataFrame, n0: int, n1: int) -> dict[bytes, float]:
    """The terms that tell the labels apart, with the logarithms of their odds ratios. There are at most 1 / LEAST_SHARE
    times as many as a labelled text has terms on average."""
    p0, p1 = (F.col("n0") + 0.5) / (n0 + 1.0), (F.col("n1") + 0.5) / (n1 + 1.0)
    p = (F.col("n0") + F.col("n1") + 1.0) / (n0 + n1 + 2.0)
    z = F.abs(p1 - p0) / F.sqrt(p * (1.0 - p) * (1.0 / (n0 + 1.0) + 1.0 / (n1 + 1.0)))
    lift = F.greatest(p1 / p0, p0 / p1)
    best = counts.where((z >= LEAST_Z) & (lift >= LIFT) & (F.greatest(p0, p1) >= LEAST_SHARE)).select("term", F.log(p1 / p0).alias("odds"))
    return {bytes(r["term"]): r["odds"] for r in best.orderBy("term").collect()}


def regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The weights of a logistic regression of y on x, the last that of the constant, by Newton's steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = RIDGE * np.append(np.ones(x.shape[1] - 1), 1e-3)
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


_KEPT: dict[str, WordNumbers] = {}


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray, text_col: str) -> tuple[int, np.ndarray]:
    """The number of documents, and in how many of them each word of the vocabulary (sorted keys) occurs: all documents
    are counted, and summed within tasks first."""
    shared, key = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex
    bound_batches(docs.sparkSession)

    def run(batches):
        if key not in _KEPT:  # a worker's numbers serve all its tasks
            _KEPT.clear()
            _KEPT[key] = WordNumbers(shared.value, {})
        numbers = _KEPT[key]
        counts, n_docs = np.zeros(len(shared.value) + 1, np.int64), 0  # the last place is that of other words
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                n_docs += 1
                counts[numbers.of(dict.fromkeys(words_of(raw), 1))[0]] += 1
        found = np.flatnonzero(counts[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, found)), pa.array(np.append(n_docs, counts[found]))], ["word", "n"])

    sums = docs.select(F.col(text_col)).mapInArrow(freed(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    table = sums.toArrow()  # at most one row a word of the vocabulary
    words, n = table.column("word").to_numpy(), table.column("n").to_numpy()
    df = np.zeros(len(vocabulary), np.int64)
    df[words[words >= 0]] = n[words >= 0]
    return int(n[words < 0].sum()), df


BAG = T.StructType([T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])


def choose(labelled: DataFrame, max_examples: int, max_postings: int) -> list[dict]:
    """The examples (toxic, h, doc_id, keys and times of words): two rows in three by hash, texts that are the same once a label, at most max_examples of each label in order of hash, and at most
    max_postings different words in all."""
    picks = []
    for label in (1, 0):
        one = labelled.where((F.col("toxic") == label) & (F.pmod("h", F.lit(3)) > 0)).dropDuplicates(["h"])
        picks.append(one.orderBy("h", "doc_id").limit(max_examples))
    examples = cut(append_columns(picks[0].unionByName(picks[1]), BAG, lambda: _bags).drop("text"))
    left, chosen = max_postings, []
    # labels take turns, so that neither uses up what there is
    ranked: dict[int, list] = {1: [], 0: []}
    for r in examples.select("toxic", "h", F.size("keys").alias("n")).orderBy("h").collect():
        ranked[r["toxic"]].append((r["h"], r["n"]))
    for place in range(max(map(len, ranked.values()))):
        for label in (1, 0):
            if place < len(ranked[label]) and ranked[label][place][1] <= left:
                chosen.append((label, ranked[label][place][0]))
                left -= ranked[label][place][1]
    if not chosen:
        return []
    kept = examples.sparkSession.createDataFrame(chosen, "toxic int, h long")
    table = examples.join(F.broadcast(kept), ["toxic", "h"]).toArrow()
    ids = table.column("doc_id").to_pylist()
    rows = []
    for n in range(len(table)):
        row = {name: table.column(name)[n] for name in ("toxic", "h", *BAG.names)}
        array = lambda x, kind: np.asarray(x.values.to_numpy(zero_copy_only=False), kind)
        rows.append({"toxic": row["toxic"].as_py(), "h": row["h"].as_py(), "doc_id": ids[n], "keys": array(row["keys"], np.int64).view(np.uint64), "times": array(row["times"], np.float64)})
    # texts with the same most frequent word lie together, so that a block's greatest weights tell something about it
    top = lambda r: int(r["keys"][np.lexsort((r["keys"], -r["times"]))[0]]) if len(r["keys"]) else 0
    return sorted(rows, key=lambda r: (top(r), r["toxic"], r["h"]))


def _bags(batch: pa.RecordBatch) -> list[pa.Array]:
    counted = [Counter(words_of(raw)) for raw in raw_texts(batch.column("text"))]
    keys = [np.fromiter(map(word_key, counts), np.uint64, len(counts)).view(np.int64) for counts in counted]
    return [pa.array(keys, pa.list_(pa.int64())), pa.array([list(counts.values()) for counts in counted], pa.list_(pa.int64()))]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_examples: int = MAX_EXAMPLES, max_postings: int = MAX_POSTINGS, k: int = K, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """The model from labels (doc_id, toxic) and the texts of their documents, at most max_labelled of them, and from
    the words of all documents."""
    spark = docs.sparkSession
    labels = labels.where("toxic IN (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = labels.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    labelled = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "toxic", F.struct(F.xxhash64("text").alias("h"), "text").alias("t"))
    # one text an id, so there are no more rows than ids, however often an id is repeated
    labelled = cut(labelled.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("t").alias("t")).select("doc_id", "toxic", "t.h", "t.text"))
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    model = Model(k=k, share=n1 / (n0 + n1) if n0 + n1 else 0.0, id_type=labelled.schema["doc_id"].dataType).ready()
    if not n0 or not n1:
        return model
    model.telling = telling_terms(count_terms(labelled, "text"), n0, n1)
    examples = choose(labelled, max_examples, max_postings)
    if examples:
        model.vocabulary = np.unique(np.concatenate([r["keys"] for r in examples]))
        n_docs, df = document_frequencies(docs, model.vocabulary, text_col)
        model.idf, model.rarest = np.log(1.0 + n_docs / (df + 0.5)), math.log(1.0 + n_docs / 1.5)
        model.names, model.labels = [r["doc_id"] for r in examples], np.array([r["toxic"] for r in examples], float)
        model.index([model.vector(np.searchsorted(model.vocabulary, r["keys"]), r["times"]) for r in examples])
    model.ready()
    shared = spark.sparkContext.broadcast(model)
    looked = append_columns(labelled.where(F.pmod("h", F.lit(3)) == 0).select("text", "toxic", "h"), T.StructType([T.StructField("features", T.ArrayType(T.DoubleType()))]), lambda: _features(shared.value))
    rows = looked.select("h", "toxic", "features").orderBy("h", "toxic").collect()  # MAX_LABELLED / 3 or so
    model.weights = regression(np.array([r["features"] for r in rows]).reshape(len(rows), FEATURES), np.array([r["toxic"] for r in rows], float))
    return model


def _features(model: Model):
    return lambda batch: [pa.array([features for features, _ in model.look([words_of(raw) for raw in raw_texts(batch.column("text"))])], pa.list_(pa.float64()))]


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", n_evidence: int = 3) -> DataFrame:
    """Adds toxicity (0 to 1) and evidence: the nearest examples with their labels and cosines."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    evidence_type = T.StructType([T.StructField("doc_id", model.id_type), T.StructField("toxic", T.IntegerType()), T.StructField("cosine", T.DoubleType())])
    added = T.StructType([T.StructField("toxicity", T.DoubleType()), T.StructField("evidence", T.ArrayType(evidence_type))])
    kind = pa.list_(to_arrow_type(evidence_type))

    def start():
        own = shared.value

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            scores, evidence = [], []
            raws = raw_texts(batch.column(text_col))
            for features, near in (found for at in range(0, len(raws), TOGETHER) for found in own.look([words_of(raw) for raw in raws[at : at + TOGETHER]])):
                scores.append(own.score(features, near))
                evidence.append([{"doc_id": own.names[n], "toxic": int(own.labels[n]), "cosine": s} for s, n in near[:n_evidence]])
            return [pa.array(scores, pa.float64()), pa.array(evidence, kind)]

        return work

    return append_columns(docs, added, start)
