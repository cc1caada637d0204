"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of shingles of SHINGLE consecutive words (one shorter shingle if there are fewer words); two are
linked if the Jaccard similarity of their sets is THRESHOLD at least. Steps:

1. Each text gets its set's digest and a MinHash signature. Documents of equal sets are collapsed; they are linked.
2. Sets that agree in all ROWS values of one of BANDS bands meet in a bucket. At the threshold a pair is missed with
   probability (1 - 0.8^4)^20 = 3e-5, less above it.
3. In a bucket, pairs are compared MinHash value by value, STEP at a time. After n values of which m agree, the
   similarity has the posterior Beta(m + 1, n - m + 1); a pair is dropped when its probability of reaching the
   threshold falls below TOLERANCE. Pairs already joined through others are passed over. What survives joins sets
   into candidate groups.
4. Within each candidate group all pairs are verified exactly, from the sets; links are counted, and the links'
   connected components are the classes.

No pairs are written out: steps 3 and 4 hand on one row a member. Buckets and groups of any size are cut into blocks
and each pair of blocks is one unit of work, so no task holds more than two blocks.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. Null and empty texts, and texts without words,
are linked to nothing and are classes of their own. Rows that repeat are documents of their own. The class's id is
its smallest doc_id (null ids come last).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import HASHES_KEPT, append_columns, bound_batches, cut, files_for, free_names, freed, raw_texts, words_of

SHINGLE, THRESHOLD = 5, 0.8
HASHES, ROWS, BANDS, STEP = 128, 4, 20, 16
TOLERANCE = 1e-5
#: Members of a block of a bucket, and of a candidate group (there also bounded by the shingles that they hold).
BUCKET_BLOCK, GROUP_BLOCK, GROUP_SHINGLES = 2048, 512, 1_000_000
#: The second scan passes over texts that are in no candidate group by a filter of FILTER_SHARE bits a candidate, at
#: least 2^FILTER_LEAST and at most 2^FILTER_MOST; for more candidates texts and candidates meet by a semi-join first.
FILTER_SHARE, FILTER_LEAST, FILTER_MOST = 16, 22, 25
MIX = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20240229)
_FACTORS = (_random.integers(0, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_MASKS = _random.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < HASHES_KEPT:
            self[word] = h
        return h


def shingles_of(words: list[bytes], hashes: dict, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(w))):
        out = out * MIX + w[k : k + n]
        out ^= out >> np.uint64(29)
    return np.unique(out * MIX)


def signature(shingles: np.ndarray) -> bytes:
    """HASHES 16-bit MinHash values."""
    h = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(h), 2048):
        least = np.minimum(least, ((h[at : at + 2048, None] ^ _MASKS) * _FACTORS).min(0))
    mixed = least * np.uint32(0x85EBCA6B)
    return (mixed >> np.uint32(16)).astype(np.uint16).tobytes()


@lru_cache
def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """After STEP, 2 STEP, ... values: the fewest matches with which a pair is kept.

    With a uniform prior, P(similarity >= t | m of n agree) is the probability that a Binomial(n + 1, t) is m at most.
    """
    kept = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        kept.append(m)
    return tuple(kept)


def prune(one: np.ndarray, others: np.ndarray, fewest: tuple[int, ...]) -> np.ndarray:
    """The rows of `others` that survive the comparison with `one`."""
    left, matches = np.arange(len(others)), np.zeros(len(others), np.int32)
    for step, least in enumerate(fewest):
        part = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (others[left, part] == one[part]).sum(1)
        keep = matches >= least
        left, matches = left[keep], matches[keep]
        if not len(left):
            break
    return left


def join_candidates(signatures: np.ndarray, fewest: tuple[int, ...]) -> np.ndarray:
    """For each member the first member of its group: what survives pruning joins; joined pairs aren't compared."""
    n = len(signatures)
    root = np.arange(n)
    for x in range(n):
        # the first member has been compared with all; every one outside its group comes to those within
        if x and root[x] == 0:
            continue
        others = np.flatnonzero(root != root[x])
        near = others[prune(signatures[x], signatures[others], fewest)]
        if len(near):
            met = np.unique(np.append(root[near], root[x]))
            root[np.isin(root, met)] = met[0]
    return root


def exact_links(sets: list[np.ndarray], threshold: float, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of left x right (positions in sets) whose Jaccard similarity reaches the threshold."""
    sizes = np.array([len(s) for s in sets])
    joined, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, inverse, times = np.unique(joined, return_inverse=True, return_counts=True)
    shared = times[inverse] > 1
    columns = np.unique(inverse[shared])
    place = np.zeros(len(times), np.int64)
    place[columns] = np.arange(len(columns))
    owner, column = owner[shared], place[inverse[shared]]
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, max(1, len(columns)), 8192):
        block = np.zeros((len(sets), min(8192, len(columns) - at)), np.float32)
        inside = (column >= at) & (column < at + 8192)
        block[owner[inside], column[inside] - at] = 1
        both += block[left] @ block[right].T
    total = sizes[left][:, None] + sizes[right][None, :] - both
    return np.nonzero((both >= threshold * total - 1e-6) & (both > 0))


def _groups(batches, key: str):
    """The rows of each key of batches sorted by key, as one table each."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(starts, starts[1:], strict=False):
            if held and keys[a] != last:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
            last = keys[a]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def signatures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds sid (the set's digest, null without words), n_shingles and sig."""
    added = T.StructType([T.StructField("sid", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("sig", T.BinaryType())])

    def start():
        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            ids, sizes, sigs = [], [], []
            for raw in raw_texts(batch.column(text_col)):
                s = shingles_of(words_of(raw), hashes)
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sizes.append(len(s))
                sigs.append(signature(s) if len(s) else None)
            return [pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())]

        return work

    return append_columns(docs, added, start)


def _dealt(members: DataFrame, key: str, blocks, others: list[str]) -> DataFrame:
    """Each member once for every pair of blocks that its block is part of; unit: hash of (key, pair of blocks)."""
    members = members.withColumn("nb", blocks).withColumn("b", F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    members = members.withColumn("o", other).withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o"))
    return members.withColumn("unit", F.concat_ws(":", F.hex(key), "i", "j")).select("unit", key, "i", "j", "b", "sid", *others)


def candidate_edges(sets: DataFrame, threshold: float, tolerance: float, bucket_block: int) -> DataFrame:
    """(a, b): sets that survive the pruning in a bucket, each with the first of its group there."""
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(BANDS)])
    bands = sets.select("sid", F.explode(keys).alias("band"))
    sizes = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = bands.join(sizes, "band").join(sets.select("sid", "sig"), "sid")
    blocks = F.ceil(F.col("n") / bucket_block).cast("int")
    units = _dealt(met, "band", blocks, ["sig"])
    fewest = fewest_matches(threshold, tolerance)
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def run(batches):
        for group in _groups(batches, "unit"):
            ids = group.column("sid").to_pylist()
            sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(len(ids), HASHES)
            root = join_candidates(sigs, fewest)
            far = np.flatnonzero(root != np.arange(len(ids)))
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array([ids[root[k]] for k in far], pa.binary()), pa.array([ids[k] for k in far], pa.binary())], ["a", "b"])

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(freed(run), schema).distinct()


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(sid, root) for every end of an edge: root is the smallest sid of its connected component.

    Each round every node takes the smallest root among its neighbours' and then its root's root, until none changes.
    files: in how many files at most a round is written (else one for each partition).
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), files)
    roots = both.groupBy("a").agg(F.min("b").alias("b"))
    roots = cut(roots.select(F.col("a").alias("sid"), F.least("a", "b").alias("root")), files)
    while True:
        near = both.join(roots, both["b"] == roots["sid"]).groupBy("a").agg(F.min("root").alias("near"))
        own = roots.join(near, roots["sid"] == near["a"]).select("sid", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = own.select(F.col("sid").alias("up"), F.col("root").alias("up_root"))
        new = cut(own.join(up, own["root"] == up["up"]).select("sid", "old", F.least("root", "up_root").alias("root")), files)
        roots = new.select("sid", "root")
        if not new.where("old <> root").head(1):
            return roots


def _filter_words(ids: DataFrame, column: str, n_bits: int) -> np.ndarray:
    """A filter of n_bits bits by hashes of ids, as longs of 32 bits each."""
    bit = ids.select(F.pmod(F.xxhash64(column), F.lit(n_bits)).alias("bit")).distinct()
    words = bit.groupBy(F.expr("cast(bit div 32 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits"))
    found = words.toArrow()  # n_bits / 32 rows at most
    bits = np.zeros(n_bits // 32, np.int64)
    bits[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    return bits


def _shingled(docs: DataFrame, ids: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, sid, shingles) of the texts whose ids may be among `ids`."""
    n = ids.count()
    size = max(FILTER_LEAST, (FILTER_SHARE * n).bit_length())
    if size > FILTER_MOST:
        docs = docs.join(ids.select(F.col("doc_id").alias("_candidate")), F.col(id_col).eqNullSafe(F.col("_candidate")), "left_semi")
    n_bits = 1 << min(size, FILTER_MOST)
    shared = docs.sparkSession.sparkContext.broadcast(_filter_words(ids, "doc_id", n_bits))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("sid", T.BinaryType()), T.StructField("shingles", T.BinaryType())])
    bound_batches(docs.sparkSession)

    def run(batches):
        bits, hashes = shared.value, WordHashes()
        for batch in batches:
            at = batch.column("bit").to_numpy()
            keep = np.flatnonzero((bits[at // 32] >> (at % 32)) & 1)
            if len(keep):
                part = batch.take(pa.array(keep))
                found = [shingles_of(words_of(raw), hashes).tobytes() for raw in raw_texts(part.column("text"))]
                ids = [hashlib.blake2b(s, digest_size=16).digest() for s in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(found, pa.binary())], ["doc_id", "sid", "shingles"])

    bit = F.pmod(F.xxhash64(id_col), F.lit(n_bits)).alias("bit")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), bit).mapInArrow(freed(run), schema)


def verified(groups: DataFrame, threshold: float) -> DataFrame:
    """(sid, links, root): for each member and unit, the documents linked to it there, and its first linked member.

    groups: (root, sid, copies, blocks, shingles).
    """
    units = _dealt(groups, "root", F.col("blocks"), ["copies", "shingles"])
    schema = T.StructType([T.StructField("sid", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("first", T.BinaryType())])

    def run(batches):
        for group in _groups(batches, "unit"):
            ids = group.column("sid").to_pylist()
            if len(set(ids)) < len(ids):  # rows that repeat in id and text bring their set again
                group = group.take(pa.array(sorted({s: n for n, s in enumerate(ids)}.values())))
                ids = group.column("sid").to_pylist()
            sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
            copies, block = group.column("copies").to_numpy(), group.column("b").to_numpy()
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            left = np.flatnonzero(block == i)
            right = left if i == j else np.flatnonzero(block == j)
            if not len(left) or not len(right):
                continue
            a, b = exact_links(sets, threshold, left, right)
            a, b = left[a], right[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
            root = np.arange(len(ids))
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                while root[y] != y:
                    root[y] = root[root[y]]
                    y = root[y]
                if x != y:
                    root[max(x, y)] = min(x, y)
            for x in range(len(ids)):
                root[x] = root[root[x]]
            there = np.flatnonzero(links > 0)
            if len(there):
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in there], pa.binary()), pa.array(links[there].astype(np.int64)), pa.array([ids[root[x]] for x in there], pa.binary())], ["sid", "links", "first"])

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(freed(run), schema)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, text_col: str = "text", id_col: str = "doc_id", bucket_block: int = BUCKET_BLOCK, group_block: int = GROUP_BLOCK) -> DataFrame:
    """(doc_id, text_hash, sid, class_sid, class_id, n_links) of every row; class_sid and sid are null without words.

    n_links: the number of other documents linked to the document, copies among them.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(signatures(slim.withColumn("text_hash", F.xxhash64("text"))).drop("text"))
    sets = signed.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    as_came = max(files_for(docs.sparkSession), signed.rdd.getNumPartitions())
    sets = cut(sets, as_came)
    files = files_for(docs.sparkSession, sets.count())
    grouped = components(candidate_edges(sets, threshold, tolerance, bucket_block), files)
    members = cut(grouped.join(sets.drop("sig"), "sid"), files)
    sizes = members.groupBy(F.col("root").alias("_root")).agg(F.greatest(F.ceil(F.count("*") / group_block), F.ceil(F.sum("n_shingles") / GROUP_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(sizes, F.col("root") == F.col("_root")).drop("_root")
    texts = _shingled(docs, members.select(F.col("first_id").alias("doc_id")), text_col, id_col).withColumnRenamed("sid", "_sid")
    held = members.join(texts, (F.col("sid") == F.col("_sid")) & F.col("first_id").eqNullSafe(F.col("doc_id"))).select("root", "sid", "copies", "blocks", "shingles")
    links = cut(verified(held, threshold))
    classes = components(links.where("sid <> first").select(F.col("first").alias("a"), F.col("sid").alias("b")), files)
    counts = links.groupBy("sid").agg(F.sum("links").alias("links"))
    of_set = sets.select("sid", "first_id", "copies").join(counts, "sid", "left").join(classes, "sid", "left")
    of_set = of_set.withColumn("class_sid", F.coalesce("root", "sid"))
    least = of_set.groupBy(F.col("class_sid").alias("_class")).agg(F.min("first_id").alias("class_id"))
    of_set = of_set.join(least, F.col("class_sid") == F.col("_class")).select(F.col("sid").alias("_sid"), "class_sid", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = signed.join(of_set, F.col("sid") == F.col("_sid"), "left").coalesce(as_came)
    return out.select("doc_id", "text_hash", "sid", "class_sid", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents without the others of each class: the one with the smallest id (then text hash) stays.

    Rows that are the same in id and text stay once; texts without words all stay.
    """
    found = cut(near_duplicates(docs, threshold, text_col=text_col, id_col=id_col))
    files = files_for(docs.sparkSession, found.count())
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    best = found.where("class_sid IS NOT NULL").groupBy(F.col("class_sid").alias("_class")).agg(F.min(order).alias("best"))
    same = found.where("class_sid IS NOT NULL").groupBy("class_sid", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    judged = same.join(best, F.col("class_sid") == F.col("_class"))
    stays = (F.col("best.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("best.text_hash") == F.col("text_hash"))
    gone = judged.where(~stays).select(F.col("doc_id").alias("_id_gone"), F.col("text_hash").alias("_hash_gone"))
    again = judged.where(stays & (F.col("n") > 1)).select(F.col("doc_id").alias("_id_gone"), F.col("text_hash").alias("_hash_gone"))
    own = free_names(docs, "text_hash_")[0]
    keyed = docs.withColumn(own, F.xxhash64(text_col))
    same_row = lambda other: F.col(id_col).eqNullSafe(other["_id_gone"]) & (F.col(own) == other["_hash_gone"])
    gone = cut(gone, files)
    left = keyed.join(gone, same_row(gone), "left_anti")
    again = cut(again, files)
    if again.head(1):
        once = left.join(again, same_row(again), "left_semi").dropDuplicates([id_col, own])
        left = left.join(again, same_row(again), "left_anti").unionByName(once)
    return left.drop(own)
