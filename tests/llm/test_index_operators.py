"""Vector codes, SimHash components and ranked lexical search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from pathlib import Path
from urllib.parse import urlparse

import duckdb
import numpy as np
import pytest
import xxhash
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra.llm import chat, common, decontaminate, lexical, mixing, near_duplicates, registry, secrets, simhash, topk, vector_codes
from papyra.llm.common import checkpoint_dir

# --- 11 ----------------------------------------------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (id, vector) -> list of (id, code, error), and the codebooks by length."""
    kept = []
    for key, v in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((key, [math.floor(max(-(2.0**62), min(2.0**62, float(x) * scale))) for x in v]))
    out, books = [], {}
    for n in {len(v) for _, v in kept}:
        own = sorted(((k, v) for k, v in kept if len(v) == n), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        edges = vector_codes.cuts(n, parts)
        pieces = [[v[a:b] for _, v in own] for a, b in zip(edges, edges[1:], strict=False)]
        book = [[list(x) for x in p[:entries]] for p in pieces]
        near = lambda x, b: min((sum((s - t) ** 2 for s, t in zip(x, e, strict=True)), k) for k, e in enumerate(b))
        for _ in range(rounds):
            for p, b in zip(pieces, book, strict=True):
                dealt = [near(x, b)[1] for x in p]
                for k in range(len(b)):
                    mine = [x for x, d in zip(p, dealt, strict=True) if d == k]
                    if mine:
                        b[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        found = [[near(x, b) for x in p] for p, b in zip(pieces, book, strict=True)]
        books[n] = hashlib.sha256(",".join(str(v) for p in book for e in p for v in e).encode()).hexdigest()
        for k, (key, _) in enumerate(own):
            out.append((key, "".join(f"{f[k][1]:02x}" for f in found), min(2**63 - 1, sum(f[k][0] for f in found)), books[n]))
    return out


def same_codes(spark, rows, **how):
    df = spark.createDataFrame([(k, v, k, "own") for k, v in rows], "vec_id long, embedding array<double>, label long, code string")
    got = [(r["id"], r["code"], r["error"], r["codebook"]) for r in vector_codes.vector_codes(df, **how).collect()]
    assert sorted(got, key=repr) == sorted(brute_codes(rows, **how), key=repr)


def test_vector_codes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (6, 19))
    rows = [(n, (centres[n % 6] + rng.normal(0, 0.05 if n % 3 else 1.5, 19)).tolist()) for n in range(700)]
    odd = [(None, rows[3][1]), (7, rows[7][1]), (7, [0.0] * 19), (-1, None), (-2, [None] * 19), (-3, [float("nan")] * 19), (-4, [float("inf"), *[0.0] * 18]), (5, [1e300, -1e300] + [3e15] * 17), (800, []), (801, []), (802, [0.5, -0.5, 0.25])]
    same_codes(spark, rows + odd)
    monkeypatch.setattr(vector_codes, "MODEL_NUMBERS", 1)  # lengths are fitted in turn
    same_codes(spark, rows[:50] + odd, parts=3, entries=5, rounds=2)


def test_vector_codes_ties(spark):
    same_codes(spark, [(n, [float((n * k) % 3) for k in range(1, 9)]) for n in range(60)], entries=7)
    same_codes(spark, [(n, [1.0] * 16) for n in range(90)])
    same_codes(spark, [(3, [1.0] * 16)])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 16), st.integers(1, 4), st.integers(1, 40), st.integers(0, 2**32 - 1), st.sampled_from([1, 1 << 30]))
def test_descent(n, k, width, spread, seed, factor):
    rng = np.random.default_rng(seed)
    points, book = rng.integers(-spread, spread, (n, width)) * factor, rng.integers(-spread, spread, (k, width)) * factor
    tree, book = vector_codes._fitting(vector_codes.grow(points, 4 if n < 30 else vector_codes.LEAF), book.tolist())
    away = ((points.astype(object)[:, None] - book[None]) ** 2).sum(2)
    codes, errors = vector_codes.codes_of(tree, book)
    assert (codes == away.argmin(1)).all() and (errors == away.min(1)).all()
    sums, counts = vector_codes.totals(tree, book)
    assert (counts == np.bincount(codes, minlength=k)).all()
    assert all((sums[e] == points.astype(object)[codes == e].sum(0)).all() for e in range(k) if counts[e])


# --- 12 ----------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    """The number of each print's component, by comparing all pairs."""
    x = np.array(prints, np.uint64)
    root = np.arange(len(x))
    for k in range(len(x)):
        near = np.flatnonzero(np.bitwise_count(x ^ x[k]) <= radius)
        met = np.unique(root[near])
        root[np.isin(root, met)] = met[0]
    return root.tolist()


def least_ids(ids, roots):
    least: dict = {}
    for key, root in zip(ids, roots, strict=True):
        if key is not None:
            least[root] = min(least.get(root, key), key)
    return [least.get(root) for root in roots]


def test_registered_simhash_by_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()
    prints = [brute_fingerprint(t) for _, t in docs]
    want = [(d, f"{p:016x}", c) for (d, _), p, c in zip(docs, prints, least_ids([d for d, _ in docs], brute_components(prints)), strict=True)]
    got = registry.queries()["op12_simhash"](spark, DATA).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_simhash_of_odd_rows(spark):
    long_text = " ".join(str(n * n % 977) for n in range(60_000))
    texts = [None, "", " \t\n", "One", "one", "ONE two", "a b c d", "A b  c\td e", "é É x y z", long_text, long_text + " more", "x" * 300_000]
    rows = [(None if n == 4 else f"d{n}", t, "own", n) for n, t in enumerate(texts)] + [("d3", "One", "own", 3)]
    df = spark.createDataFrame(rows, "doc_id string, text string, fp string, fp_node int")
    got = simhash.simhash_components(df).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "fp", "fp_node", "fingerprint", "component_id"}
    prints = [brute_fingerprint(t) for _, t, _, _ in rows]
    ids = least_ids([r[0] for r in rows], brute_components(prints))
    want = [(d, t, o, n, f"{p:016x}", c) for (d, t, o, n), p, c in zip(rows, prints, ids, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_simhash_writes_few_files(spark):
    words = [[f"w{g * n * n % 9973}" for n in range(400)] for g in range(1, 13)]
    texts = [" ".join([*words[k % 12], f"end{k // 12}"]) for k in range(120)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    confs = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in confs}
    written = lambda: {str(p) for p in Path(urlparse(checkpoint_dir(spark)).path).rglob("part-*")}
    before = written()
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        got = sorted(map(tuple, simhash.simhash_components(df).select("doc_id", "fingerprint", "component_id").collect()))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    prints = [brute_fingerprint(t) for t in texts]
    want = [(k, f"{p:016x}", c) for k, (p, c) in enumerate(zip(prints, least_ids(range(len(texts)), brute_components(prints)), strict=True))]
    assert got == want
    assert len(set(prints)) > len({c for _, _, c in want}) > 1
    # only the search has a file for each of the shuffle's partitions; it was one for each in every step
    assert len(written() - before) <= 40 + 3 + 10 * spark.sparkContext.defaultParallelism


def test_word_hashes_are_bounded_and_stay_right():
    hashes = near_duplicates.WordHashes()
    words = [b"w%d" % n for n in range(common.HASHES_KEPT + 1000)]
    for _ in range(2):
        assert all(hashes[w] == xxhash.xxh3_64_intdigest(w) for w in words)
    assert len(hashes) == common.HASHES_KEPT


def test_a_tasks_arrow_memory_is_given_back_after_its_last_batch(monkeypatch):
    seen = []
    pool = type("Pool", (), {"release_unused": lambda self: seen.append("released")})()
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    for n in common.freed(lambda batches: (2 * n for n in batches))(iter([1, 2])):
        seen.append(n)
    assert seen == [2, 4, "released"]


def test_the_pipelines_last_stages_write_few_files(spark):
    texts = [" ".join(f"w{(k % 30 + 1) * n * n % 9973}" for n in range(1, 40 + k % 30)) + " last" * (k // 30) for k in range(60)] + ["", "one word"]
    df = spark.createDataFrame([(k, t, "abc"[k % 3]) for k, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    weights = mixing.cyclic_weights(df)
    want = sorted(map(tuple, mixing.mix(df, weights).collect()))
    assert any(r[5] for r in want)
    confs = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in confs}
    written = lambda: {str(p) for p in Path(urlparse(checkpoint_dir(spark)).path).rglob("part-*")}
    files = []
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        for stage in (lambda: near_duplicates.keep_one(df).select("doc_id"), lambda: mixing.mix(df, weights)):
            before = written()
            got = sorted(map(tuple, stage().collect()))
            assert got == (want if files else [(k,) for k in (*range(30), 60, 61)])
            files.append(len(written() - before))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # only the verified links have a file for each of the shuffle's partitions; it was one for each in most steps
    cores = spark.sparkContext.defaultParallelism
    assert files[0] <= 60 + 3 + 20 * cores
    assert files[1] <= 3 + 30 * cores


def clustered(seed, n):
    """Fingerprints of which many are some bits apart, in chains and around hubs."""
    rng, out = random.Random(seed), set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40])):
            out.add(x)
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)[:n]


@pytest.mark.parametrize(("segments", "block"), [(5, 2048), (5, 3), (6, 8), (8, 2048), (None, 16)])
def test_links_join_all(spark, segments, block):
    prints = clustered(segments or 1, 600)
    hot = 0x0123456789ABCDEF
    prints = sorted({*prints, *(hot ^ (k << 52) for k in range(150))})  # one top node in all orders but one
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long").repartition(3), 4, segments, block).collect()
    place, root = {s[0]: k for k, s in enumerate(signed)}, list(range(len(signed)))
    for e in edges:
        a, b = (place[e[c]] for c in "ab")
        old, new = root[a], root[b]
        root = [new if r == old else r for r in root]
    want = brute_components(prints)
    assert len(set(zip(root, want, strict=True))) == len(set(root)) == len(set(want))
    assert len(edges) <= 5000


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 120), st.integers(0, 8), st.booleans())
def test_index_finds_all_pairs(seed, n, radius, between):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 2**63, 3, dtype=np.uint64)
    values = centre[rng.integers(0, 3, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    group = np.sort(rng.integers(0, 2 if between else 4, n))
    if between and len(set(group.tolist())) < 2:
        return
    found = {(int(i), int(j)) for a, b in simhash.linked(values, group, radius, (0, 1) if between else None) for i, j in zip(a, b, strict=True)}
    apart = np.bitwise_count(values[:, None] ^ values[None])
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if apart[i, j] <= radius and ((group[i] != group[j]) if between else (group[i] == group[j]))}
    assert found == want


# --- 13 ----------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute_ranked(docs, items, k):
    words = [terms(t) for _, t in docs]
    n_docs, n_words = sum(1 for w in words if w), sum(map(len, words))
    out = []
    for item, text in items:
        scored = []
        for (doc, _), w in zip(docs, words, strict=True):
            score = 0
            for t in set(terms(text)):
                if tf := w.count(t):
                    df = sum(1 for v in words if t in v)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * len(w) * n_docs // n_words)))
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, n + 1, d, -s) for n, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("group_terms", "block"), [(1 << 18, 8192), (6, 3), (1, 1)])
def test_ranked_search(spark, monkeypatch, group_terms, block):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)] + ["É", "straße", "A_b"]
    docs = [(n, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(33)], k=rng.randint(1, 30)))) for n in range(60)]
    docs += [(70, None), (71, ""), (72, "..."), (None, docs[0][1]), (3, docs[3][1]), (3, "w5 w6"), (80, "w1 " * 60_000 + "w9"), *((90 + n, "tie w7") for n in range(20))]
    items = [("1", "w1 W2 w2, w9"), ("1", "tie"), ("2", None), ("3", "..."), (None, "w7 É"), ("4", "nowhere"), ("5", " ".join(vocabulary)), ("6", "straße a b")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, score int").repartition(3)
    found = lexical.ranked_search(df, spark.createDataFrame(items, "item_id string, text string"), k=5, group_terms=group_terms).collect()
    assert sorted(map(tuple, found), key=repr) == brute_ranked(docs, items, 5)


def test_ranked_search_without_items(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    assert lexical.ranked_search(docs, spark.createDataFrame([], "item_id int, text string")).collect() == []
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert len(lexical.ranked_search(docs.repartition(4), items).collect()) == 1  # tasks without documents
    assert lexical.ranked_search(spark.createDataFrame([(1, None)], "doc_id int, text string").repartition(4), items).collect() == []
    assert lexical.ranked_search(docs.where(F.lit(False)), spark.createDataFrame([(1, "a")], "item_id int, text string")).collect() == []


# --- ids of any type, columns of any name, what the allow-list leaves ---------------------------------------------

KEY = "9fK2xQ7zLm4Rt8WvBn3Yp6HdQ1"


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        (KEY, 1),
        (f"s3/example/{KEY}", 1),
        (f"sample_{KEY}-dummy", 1),
        (f"see {KEY}=placeholder or {KEY}/x", 2),
        (f"example{KEY}", 0),
        ("Q7zLm4Rt8WvBn3Yp6HdQ" * 10 + "duMmY" + "9fK2xQ7zLm4Rt8WvBn3Yp6" * 10, 1),
        ("example/" * 30, 0),
        ("123e4567-e89b-12d3-a456-426614174000", 0),
    ],
)
def test_allowed_words_cover_their_segment_only(spark, text, spans):
    found = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()["secrets"]
    assert [f["kind"] for f in found] == ["entropy"] * spans


def test_conversations_with_ids_that_are_no_numbers(spark):
    rows = [("c-b", 0, "user", "Hi"), ("c-b", 1, "assistant", "there"), ("c-a", 0, "user", "Hi"), ("c-a", 1, "assistant", None), (None, 0, "user", "x")]
    turns = chat.parse_turns(chat.read_back(chat.pack(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")))).collect()
    assert sorted(((t["conv_id"], t["turn_no"], t["role"], t["words"]) for t in turns), key=repr) == sorted(((c, n, r, t or "") for c, n, r, t in rows), key=repr)


def test_top_k_of_ids_that_are_no_numbers(spark):
    vectors = [(f"v{n:02}", [float(n % 5), float(n % 3)]) for n in range(30)] + [(None, [4.0, 2.0]), ("v01", [9.0, 9.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id string, embedding array<double>, id_place int")
    found = topk.topk(df, F.col("vec_id").endswith("0"), k=4, scale=1).collect()
    want = []
    for n, (q, v) in enumerate(vectors):
        if q and q.endswith("0"):
            near = sorted((-int(v[0] * w[0] + v[1] * w[1]), i is None, i or "", m) for m, (i, w) in enumerate(vectors) if m != n)[:4]
            want += [(q, r + 1, i or None, -s) for r, (s, _, i, _) in enumerate(near)]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_columns_with_the_operators_own_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", "y", "z"), (2, "a b c d e f", "x", "y", "z"), (3, "other words here", "x", "y", "z")], "doc_id int, text string, _hits_so_far string, hits_so_far string, _text_hash string")
    items = spark.createDataFrame([("1", "b c d"), ("2", "words here")], "item_id string, text string")
    for chars in (10**6, 1):
        rows = decontaminate.decontaminate(docs, items, 3, block_chars=chars).orderBy("doc_id").collect()
        assert [(r["n_hit"], r["_hits_so_far"], r["hits_so_far"]) for r in rows] == [(3, "x", "y"), (3, "x", "y"), (2, "x", "y")]
    kept = near_duplicates.keep_one(docs).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["_text_hash"]) for r in kept] == [(1, "z"), (3, "z")]


def test_candidates_meet_texts_beyond_the_filter(spark, monkeypatch):
    words = [f"w{n}" for n in range(40)]
    texts = [(n, " ".join([*words[:39], f"x{n % 6}"])) for n in range(12)] + [(20, "a b"), (21, None)]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    want = sorted(map(tuple, near_duplicates.near_duplicates(docs).select("doc_id", "class_id", "n_links").collect()))
    monkeypatch.setattr(near_duplicates, "FILTER_MOST", 5)
    monkeypatch.setattr(near_duplicates, "FILTER_LEAST", 5)
    assert sorted(map(tuple, near_duplicates.near_duplicates(docs).select("doc_id", "class_id", "n_links").collect())) == want
