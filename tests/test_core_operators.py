"""What SQL doesn't say: properties, round trips, and edge cases."""

from __future__ import annotations

import datetime
import io
import json
import math
import os
import random
import re
import time
import uuid
import zipfile
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra.functions import text as X
from papyra.operators import bm25, keyword_match
from papyra.operators import chunking as C
from papyra.operators import graph as G
from papyra.operators import hooks as H
from papyra.operators import retrieval as R
from papyra.operators import sessions as S
from papyra.operators import ingest as ingest_module
from papyra.operators.ingest import ingest, totals
from papyra.sources import files
from papyra.streaming import jobs, ordered
from papyra.sources.scratch import cut


def test_louvain_finds_planted_blocks(spark):
    pairs = [(b * 10 + i, b * 10 + j) for b in range(3) for i in range(6) for j in range(i + 1, 6)] + [(0, 10), (10, 20)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    members = {r["id"]: r["community"] for r in G.louvain(edges, rounds=4, levels=1, cut=cut).collect()}
    assert {frozenset(k for k in members if members[k] == c) for c in set(members.values())} == {frozenset(range(b * 10, b * 10 + 6)) for b in range(3)}


@pytest.mark.parametrize("part_edges", [10**6, 120])
def test_louvain_in_parts_is_as_good_as_in_one(spark, monkeypatch, part_edges):
    """On a graph with planted blocks the modularity is that of the blocks, or near it, however many parts there are."""
    monkeypatch.setattr(G, "PART_EDGES", part_edges)
    rng = random.Random(5)
    pairs = {(a, b) for a in range(120) for b in range(a + 1, 120) if rng.random() < (0.5 if a // 12 == b // 12 else 0.01)}
    edges = spark.createDataFrame(sorted(pairs), "a long, b long")
    members = G.louvain(edges)
    found = G.modularity(edges, members).first()[0]
    planted = G.modularity(edges, spark.createDataFrame([(n, n // 12) for n in range(120)], "id long, community long")).first()[0]
    assert found >= planted - 0.02


def test_louvain_of_no_edges(spark):
    assert G.louvain(spark.createDataFrame([], "a long, b long"), cut=cut).collect() == []


def test_louvain_moves_until_no_node_gains(spark):
    edges = spark.createDataFrame([(n, n + 1) for n in range(39)], "src long, dst long")
    both = cut(G.both_ways(edges).withColumn("w", F.lit(1.0)))
    place = {r["id"]: r["c"] for r in G._settled(both, 78.0, None, cut).collect()}
    near: dict = {}
    for r in both.collect():
        near.setdefault(r["src"], []).append(r["dst"])
    total = Counter()
    for n, own in near.items():
        total[place[n]] += len(own)
    gain = lambda n, c: sum(place[m] == c for m in near[n]) - len(near[n]) * (total[c] - (len(near[n]) if place[n] == c else 0)) / 78.0
    assert all(gain(n, place[m]) <= gain(n, place[n]) + 1e-9 for n in near for m in near[n])


def test_louvain_communities_reads_all_relations(spark, monkeypatch):
    from conftest import DATA

    from papyra.plans import graph as P

    monkeypatch.setattr(P.G, "louvain", lambda pairs, **_: pairs)
    assert P.louvain_communities(spark, DATA).count() == P.edge_list(spark, DATA).count()


def test_recursive_chunks_keep_all_words_within_size(spark):
    text = "\n\n".join(" ".join(f"w{p}x{k}" for k in range(60)) + "." for p in range(9))
    rows = C.recursive_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x" * 2500)], "doc_id long, text string"), 300, 60).collect()
    chunks = [r["content"] for r in rows if r["doc_id"] == 1]
    assert all(len(c) <= 300 for c in chunks)
    assert set(text.split()) == {w for c in chunks for w in c.split()}
    assert {r["doc_id"] for r in rows} == {1, 4}


def test_section_chunks_fit_their_sections_and_overlap(spark):
    paragraph = "A sentence of some words. " * 8
    df = spark.createDataFrame([(1, 0, "abstract", "\n\n".join([paragraph] * 4)), (1, 1, "odd", "y" * 1200)], "doc_id long, section_no int, section_type string, text string")
    rows = C.section_chunks(df, overlap=30).orderBy("section_no", "chunk_index").collect()
    first = [r["content"] for r in rows if r["section_no"] == 0]
    assert all(len(c) <= 300 + 30 for c in first) and len(first) > 1
    assert len([r for r in rows if r["section_no"] == 1]) == 3


def test_page_groups_join_untitled_pages(spark):
    pages = spark.createDataFrame([(1, n, s, t, f"p{n}") for n, (s, t) in enumerate([("abstract", "A"), ("abstract", ""), ("abstract", "B"), ("method", ""), ("method", "M")])], "doc_id int, page_no int, section string, title string, text string")
    rows = C.group_pages(pages).orderBy("section_no").collect()
    assert [(r["section_type"], r["title"], r["text"]) for r in rows] == [("abstract", "A", "p0\n\np1"), ("abstract", "B", "p2"), ("method", "M", "p3\n\np4")]


def test_limiter_denies_without_counting(spark):
    calls = spark.createDataFrame([(1, "t", t, t) for t in range(6)], "session_id long, tool string, s long, event_id long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    allowed = [r["allowed"] for r in S.limit_calls(calls, 2, 3).orderBy("event_id").collect()]
    assert allowed == [True, True, False, False, True, True]


def test_streamed_limiter_takes_a_hot_key_in_order(spark, tmp_path):
    from papyra.streaming.jobs import limit_calls_stream, run_available

    order = list(range(60))
    random.Random(8).shuffle(order)
    calls = spark.createDataFrame([(1, "t", t, t) for t in order], "session_id long, tool string, s long, event_id long").withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1)
    calls.write.parquet(str(tmp_path / "calls"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls"))
        got = {r.event_id: r.allowed for r in run_available(limit_calls_stream(stream, 2, 3)).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {r.event_id: r.allowed for r in S.limit_calls(calls, 2, 3).collect()}


def test_places_run_on_across_ranges(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = R.placed(spark.range(999).repartition(3), F.desc("id"))
        assert got.rdd.getNumPartitions() > 1
        assert {r.id: r.place for r in got.collect()} == {n: 999 - n for n in range(999)}
    finally:
        spark.conf.set(key, before)
    assert R.placed(spark.range(0), "id").collect() == []


def test_docx_and_text_scans(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("one ", "  ", "two"))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "b.docx").write_bytes(b"not a file of this kind")
    (tmp_path / "c.txt").write_text(" text \n")
    (tmp_path / "d.txt").write_text("  ")
    (tmp_path / "e.md").write_text("no")
    found = files.discover(spark, str(tmp_path))
    assert sorted(r["name"] for r in found.collect()) == ["a.docx", "b.docx", "c.txt", "d.txt"]
    texts = {r["path"][-6:]: (r["text"], r["error"] is None) for r in files.docx_texts(found).collect()}
    assert texts == {"a.docx": ("one\ntwo", True), "b.docx": (None, False)}
    assert [r["text"] for r in files.read_texts(spark, str(tmp_path)).collect()] == ["text"]


def test_session_log_skips_corrupt_lines(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text(json.dumps({"session_id": "a", "type": "messages", "turn_id": "1"}) + "\n\n{broken\n")
    good, bad = files.read_session_log(spark, str(tmp_path))
    assert [r["session_id"] for r in good.collect()] == ["a"] and bad.count() == 1
    files.append_session_log(good, str(tmp_path / "out"))
    files.append_session_log(good, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_vectors_saved_empty_stay_empty(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.5])], "key long, embedding array<float>")
    files.save_vectors(rows, str(tmp_path / "v"))
    files.save_vectors(rows.where("key < 0"), str(tmp_path / "v"))
    assert files.load_vectors(spark, str(tmp_path / "v"), rows.schema).count() == 0


def test_relaxation_tiers(spark):
    rows = [(q, n, y, 2020, None) for q, years in ((1, (2020, 2021, 2022, 2010)), (2, (2018, 2019, 2021, 2010)), (3, (2010, 2011, 2021))) for n, y in enumerate(years)]
    hits = spark.createDataFrame(rows, "query_id int, rank int, year int, year_from int, year_to int")
    kept = R.relaxed_years(hits).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in kept} == {1: 3, 2: 3, 3: 3}


def test_reference_paragraphs_and_numbers(spark):
    texts = [("x\nReferences\n[1] first entry here\n[2] second entry here",), ("x\nBibliography\na paragraph entry\n\nanother paragraph\n\nshort",), ("no references",)]
    got = spark.createDataFrame(texts, "t string").select(X.split_references(X.reference_section(F.col("t"))).alias("r")).collect()
    assert [r["r"] for r in got] == [["first entry here", "second entry here"], ["a paragraph entry", "another paragraph"], []]


def test_keywords_of_fixed_questions(spark):
    from papyra.operators.keywords import extract_keywords

    asked = [(1, "CLIP和GraphSAGE在OGB-Arxiv上的表现差异是什么"), (2, "图神经网络研究趋势和应用挑战有哪些"), (3, "the of and"), (4, None)]
    got = {r["query_id"]: (r["ll"], r["hl"]) for r in extract_keywords(spark.createDataFrame(asked, "query_id int, text string")).collect()}
    assert {"CLIP", "GraphSAGE", "OGB-Arxiv"} <= set(got[1][0]) | {p for x in got[1][0] for p in x.replace("和", " ").replace("在", " ").split()}
    assert got[2][1] and got[3] == ([], []) and got[4] == ([], [])


def test_calls_pair_first_in_first_out(spark):
    rng = random.Random(5)
    rows = [(n % 3, rng.choice("ab"), n, rng.choice(["start", "end", "other"])) for n in range(300)]
    got = {(r.session_id, r.tool, r.start_seq): r.end_seq for r in S.pair_calls(spark.createDataFrame(rows, "session_id long, tool string, seq long, kind string")).collect()}
    want, waiting = {}, {}
    for session, tool, seq, kind in rows:
        queue = waiting.setdefault((session, tool), [])
        if kind == "start":
            queue.append(seq)
            want[session, tool, seq] = None
        elif kind == "end" and queue:
            want[session, tool, queue.pop(0)] = seq
    assert got == want


def test_resets_let_go_of_calls(spark):
    rng = random.Random(6)
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    calls = [(rng.randrange(3), rng.choice("ab"), at(n * 5000), n) for n in range(200)]
    resets = [(rng.choice([0, 1, None]), rng.choice(["a", None]), at(rng.randrange(10**6))) for _ in range(12)]
    resets = [(s, None if s is None else t, ts) for s, t, ts in resets]
    for chosen in (resets, []):
        out = S.limit_calls_with_resets(spark.createDataFrame(calls, "session_id long, tool string, ts timestamp, event_id long"), spark.createDataFrame(chosen, "session_id long, tool string, ts timestamp"), 2, 40000)
        got = {r.event_id: r.allowed for r in out.collect()}
        held, want = {}, {}
        for session, tool, ts, n in calls:
            last = max([r[2] for r in chosen if r[2] <= ts and r[0] in (None, session) and r[1] in (None, tool)], default=None)
            mine = [t for t in held.get((session, tool), []) if (ts - t).total_seconds() <= 40000 and (last is None or t < ts and t >= last)]
            want[n] = len(mine) < 2
            held[session, tool] = mine + [ts] * want[n]
        assert got == want


def test_hooks_keep_failures_to_their_rows(spark):
    def call(rows):
        if any(t == "bad" for (t,) in rows):
            raise ValueError("no")
        return [None if t is None else t.upper() for (t,) in rows]

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "")], "id long, t string").coalesce(1)
    got = {r.id: (r.answer, r.answer_error) for r in H.complete(rows, "t", call).collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError: no"), 3: (None, None), 4: ("", None)}
    assert H.embed(rows.where("id > 9"), "t").count() == 0
    assert [r.embedding for r in H.embed(rows.where("id = 3"), "t").collect()] == [[0.0] * 64]


def test_harvest_drops_what_is_known_or_broken(spark):
    said = lambda **f: json.dumps({"should_save": True, "title": "T one", "body": "first line\nmore", **f})
    answers = [(1, said(type="rule")), (2, said()), (3, said(title="Known")), (4, said(title=" ")), (5, said(should_save=False)), (6, "no json"), (7, None), (8, "[1]"), (9, said(title="U", type="note", description="alpha beta gamma"))]
    known = spark.createDataFrame([("x", "Known", "rule", "words"), ("y", "Y", "note", "alpha beta gamma")], "slug string, title string, type string, text string")
    got = S.harvest(spark.createDataFrame(answers, "answer_id long, answer string"), known).select("answer_id", "slug", "type", "text").collect()
    assert [tuple(r) for r in got] == [(1, "t_one", "rule", "first line")]


def test_similar_memories_against_all_pairs(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choices("abcdefghijkl", k=rng.randrange(1, 12))) for _ in range(60)]
    rows = [(n, rng.choice(["x", "y", None]), t) for n, t in enumerate([*texts, *texts[:15], "", None, " "])]
    got = {r.id: (r.class_id, r.n_links) for r in S.similar_memories(spark.createDataFrame(rows, "id long, type string, text string"), "id").collect()}
    sets = {n: (k, frozenset((t or "").split())) for n, k, t in rows}
    want = {}
    for n, (k, w) in sets.items():
        like = [m for m, (k2, w2) in sets.items() if m != n and k == k2 and w and w2 and len(w & w2) > 0.7 * len(w | w2) and (k is not None or w == w2)]
        want[n] = (min(m for m, s in sets.items() if s == (k, w)), len(like))
    assert got == want


def test_reports_take_any_shape(spark):
    answers = ["", None, "{}", '{"research_gaps": "one", "evidence_basis": "e"}', '["a"]', "prose"]
    rows = spark.createDataFrame([(n, a) for n, a in enumerate(answers)], "id long, a string").select("id", X.report_fields(F.col("a")).alias("r"))
    got = {r.id: r.r for r in rows.collect()}
    assert got[3].research_gaps == ["one"] and got[3].evidence_basis == "e" and got[3].confidence_note == X.NOT_GIVEN
    assert got[4].suggested_directions == ["a"] and got[5].evidence_basis == "prose" and got[2].research_gaps == []


def test_ingest_tables_fit_together(spark):
    text = "An abstract of 2021.\n\n" + "Words and words. " * 200 + '\nReferences\n[1] A name, "A title of some length", 2019. doi:10.1234/ab\n[2] Another name, 2020'
    docs = spark.createDataFrame([("a", "p/2", text), ("b", "p/1", text), ("c", "p/3", ""), ("d", "p/4", None), ("e", "p/5", "short")], "doc_id string, file_path string, text string")
    t = ingest(docs)
    assert sorted(r.doc_id for r in t["documents"].collect()) == ["b", "c", "e"]
    chunks = t["chunks"].collect()
    assert {c.doc_id for c in chunks} == {"b", "e"} and len({c.chunk_id for c in chunks}) == len(chunks)
    assert t["vectors"].count() == len(chunks) and t["cites"].count() == 2 and t["references"].count() == 2
    empty = ingest(docs.where("doc_id = 'none'"))
    assert all(df.count() == 0 for df in empty.values())


def test_vector_search_by_blocks_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(n, [float(rng.randint(0, 2)) for _ in range(4)]) for n in range(300)] + [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "key long, embedding array<double>")
    asked = [(n, rows[n][1]) for n in range(0, 300, 7)] + [(5000, None)]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    whole = [(n, v) for n, v in rows if v is not None and None not in v]
    want = []
    for q, v in asked[:-1]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), n) for n, w in whole if len(w) == 4)[:6]
        want += [(q, r + 1, n, s) for r, (s, n) in enumerate(near)]
    for sizes in ({}, {"broadcast_queries": 0, "block_rows": 40, "block_queries": 9}):
        assert sorted(tuple(r) for r in R.vector_top_k(vectors, queries, 6, **sizes).collect()) == sorted(want)


def brute_bm25(docs, queries, k):
    words = {key: re.findall(r"\w+", (t or "").lower()) for key, t in docs}
    n, mean = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(w for own in words.values() for w in set(own))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else low for w, v in idf.items()}
    out = []
    for q, text in queries:
        scores = {}
        for key, own in words.items():
            s = sum(idf.get(w, 0) * own.count(w) * 2.5 / (own.count(w) + 1.5 * (0.25 + 0.75 * len(own) / mean)) for w in re.findall(r"\w+", (text or "").lower()) if w in own)
            if round(s, 6) > 0:
                scores[key] = round(s, 6)
        out += [(q, r + 1, key, s) for r, (key, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "rows"), [(4096, 200_000), (7, 200_000), (3, 5)])
def test_bm25_index_against_all_pairs(spark, tmp_path, monkeypatch, shard, rows):
    monkeypatch.setattr(bm25, "SHARD_DOCS", shard)
    monkeypatch.setattr(bm25, "BLOCK", 4)
    monkeypatch.setattr(bm25, "BROADCAST_ROWS", rows)
    rng = random.Random(8)
    vocabulary = [f"w{n}" for n in range(40)] + ["Ünder_score", "é2"]
    docs = [(n, " ".join(rng.choices(vocabulary, weights=[3 / (i + 1) for i in range(42)], k=rng.randint(1, 25)))) for n in range(90)] + [(100, None), (101, ""), (102, "w1 " * 500), (103, "w39 w38"), (104, "w39 w38")]
    queries = [(1, "w1 w2, W2 w39"), (2, " ".join(vocabulary)), (3, None), (4, "nothing"), (5, "w39"), (6, "ünder_score é2 w0"), (7, "w0 w0 w0")]
    index = bm25.build(spark.createDataFrame(docs, "key long, text string").repartition(2))
    index.save(f"{tmp_path}/index")
    asked = spark.createDataFrame(queries, "query_id long, text string")
    want = brute_bm25(docs, queries, 6)
    for use in (index, bm25.Index.load(spark, f"{tmp_path}/index")):
        got = sorted(tuple(r) for r in bm25.search(use, asked, 6).collect())
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want, strict=True))
    share = lambda q, t: len(set(re.findall(r"\w+", q.lower())) & set(re.findall(r"\w+", (t or "").lower()))) / len(set(re.findall(r"\w+", q.lower())))
    covered = []
    for q, text in queries:
        near = sorted((-round(share(text, t), 6), key) for key, t in docs if text and share(text, t) > 0)[:4]
        covered += [(q, r + 1, key, -s) for r, (s, key) in enumerate(near)]
    assert sorted(tuple(r) for r in bm25.coverage(index, asked, 4).collect()) == sorted(covered)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 400), st.integers(1, 12), st.integers(1, 20))
def test_pruning_keeps_the_best_documents(seed, n_docs, n_terms, k):
    rng = np.random.default_rng(seed)
    terms, whole = [], np.zeros(n_docs)
    for _ in range(n_terms):
        docs = rng.permutation(n_docs)[: rng.integers(1, n_docs + 1)]
        parts, weight = -np.sort(-rng.random(len(docs)) * 2), float(rng.choice([-0.2, 0.1, 1.0, 5.0]))
        terms.append((weight, docs, parts))
        whole[docs] += weight * parts
    found, scores = bm25.best_documents(terms, n_docs, k, 0.0)
    best = np.flatnonzero(whole > max(0.0, np.sort(whole)[-min(k, n_docs)] - 1e-9))
    assert set(best) <= set(found.tolist())
    assert np.allclose(scores, whole[found])


def test_bm25_without_documents(spark):
    none = spark.createDataFrame([], "key long, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert R.bm25(none, asked, 3).collect() == []
    assert R.bm25(asked.withColumnRenamed("query_id", "key"), none.withColumnRenamed("key", "query_id"), 3).collect() == []


def test_many_keywords_in_many_texts(spark, monkeypatch):
    rng = random.Random(4)
    texts = [(n, "".join(rng.choice("abcAB é") for _ in range(rng.randint(0, 12)))) for n in range(120)] + [(500, None), (501, "")]
    keys = [(n % 9, "".join(rng.choice("abc é") for _ in range(rng.randint(1, 5)))) for n in range(60)] + [(1, " "), (2, ""), (3, None)]
    rows, keywords = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(keys, "query_id long, keyword string")
    want = sorted((i, q, k) for i, t in texts for q, k in keys if t and k and k.strip(" ") and k.lower() in t.lower())
    members = [(g, i) for i in range(120) for g in {i % 7, i % 5, 0} if i % 11]
    for limit in (2_000_000, 20):
        monkeypatch.setattr(keyword_match, "AUTOMATON_CHARS", limit)
        got = G.containing(rows, "t", keywords).select("id", "query_id", "keyword")
        assert sorted(tuple(r) for r in got.collect()) == want
        for count in (True, False):
            top = keyword_match.keyword_top_k(rows, "t", keywords, 4, ["id"], count=count).select("query_id", "rank", "id", "score").collect()
            best = []
            for q in {q for _, q, _ in want}:
                n = Counter(i for i, x in {(i, k.lower()) for i, p, k in want if p == q})
                first = sorted((-(c if count else 1), i) for i, c in n.items())[:4]
                best += [(q, r + 1, i, -c) for r, (c, i) in enumerate(first)]
            assert sorted(tuple(r) for r in top) == sorted(best)
        mentions = spark.createDataFrame(members, "chunk_id long, entity_id long")
        hits = G.chunk_hits(keywords, rows.withColumnsRenamed({"id": "entity_id", "t": "name"}), mentions, 3).collect()
        best = []
        for q in {q for _, q, _ in want}:
            mine = {i for i, p, _ in want if p == q}
            n = Counter(g for g, i in members if i in mine)
            best += [(q, r + 1, g, -c) for r, (c, g) in enumerate(sorted((-c, g) for g, c in n.items())[:3])]
        assert sorted(tuple(r) for r in hits) == sorted(best)


def test_relation_search_asks_with_topics_then_names_then_the_question(spark):
    relations = spark.createDataFrame([(1, 2, "clip", "graphs", "BASED_ON", "clip rests on graphs"), (3, 4, "trees", "soil", "IN", "trees stand in soil")], "src long, dst long, src_name string, dst_name string, type string, description string")
    queries = spark.createDataFrame([(1, ["clip"], ["soil"], "?"), (2, ["clip"], [], "trees"), (3, [], None, "trees stand")], "query_id long, ll array<string>, hl array<string>, text string")
    got = {r["query_id"]: r for r in R.relation_vector_search(relations, queries, 1).collect()}
    assert [got[n]["key"] for n in (1, 2, 3)] == ["3::4", "1::2", "3::4"]
    assert got[2]["card"].split("\n") == ["Relation: clip -[BASED_ON]-> graphs", "Source: clip", "Target: graphs", "Type: BASED_ON", "Description: clip rests on graphs"]
    assert [r["key"] for r in R.entity_vector_search(spark.createDataFrame([("a", "clip"), ("b", "soil")], "key string, text string"), queries.where("query_id = 1"), 1).collect()] == ["a"]


def test_unknown_pages_get_labels_of_the_set_only(spark):
    from papyra.operators.questions import label_unknown, splits_by_section

    def call(asked):
        if any(t == "bad" for (t,) in asked):
            raise ValueError("no")
        return [" Method " if t == "m" else "poem" for (t,) in asked]

    pages = spark.createDataFrame([(1, "m", "unknown"), (2, "x", None), (3, "bad", "unknown"), (4, "m", "result")], "n int, text string, section string")
    assert {r["n"]: r["section"] for r in label_unknown(pages, call, ("method", "result")).collect()} == {1: "method", 2: "unknown", 3: "unknown", 4: "result"}
    docs = spark.createDataFrame([(1, ["a"], ["s"]), (2, ["a", "b"], ["s"]), (3, [], []), (4, None, None)], "n int, pages array<string>, sections array<string>")
    assert [r["by_section"] for r in splits_by_section(docs).orderBy("n").collect()] == [True, False, False, False]


def test_status_lookups(spark):
    from papyra.operators.questions import statuses

    rows = spark.createDataFrame([("a", "p/a", "ready"), ("b", "p/b", "failed"), ("c", "p/c", "ready")], "doc_id string, file_path string, status string")
    find = lambda **by: [r["doc_id"] for r in statuses(rows, **by).orderBy("doc_id").collect()]
    assert find() == ["a", "b", "c"] and find(doc_id="b") == ["b"] and find(file_path="p/c") == ["c"] and find(status="ready") == ["a", "c"]


def test_keywords_of_a_model_where_there_are_none(spark):
    from papyra.operators.keywords import keywords_or_asked

    answers = {"?": '```json\n{"low_level_keywords": ["X", "x", " "], "high_level_keywords": ["topics"]}\n```', "!": "no json"}
    queries = spark.createDataFrame([(1, "CLIP"), (2, "?"), (3, "!"), (4, None)], "query_id long, text string")
    found = {r["query_id"]: r for r in keywords_or_asked(queries, lambda asked: [answers[t] for (t,) in asked]).collect()}
    assert "CLIP" in found[1]["ll"]
    assert [(found[n]["ll"], found[n]["hl"]) for n in (2, 3, 4)] == [(["X"], ["topics"]), ([], []), ([], [])]


def answered(folder, spelling=0):
    """An extractor that leaves a file a call, so that calls of all workers are counted."""

    def extractor(asked):
        out = []
        for (text,) in asked:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(text)
            if "broken" in text:
                raise ValueError("no answer")
            entities = [{"name": " CLIP", ("type", "entity_type")[spelling]: "Model", "description": text[:9]}, {"name": "ImageNet", "type": "Data", "description": ""}]
            names = (("source", "type", "target"), ("source_name", "relation", "target_name"))[spelling]
            relations = [dict(zip(names, r, strict=True), description="d") for r in (("clip", "USES", "imagenet"), ("clip", "USES", "nobody"))]
            out.append(json.dumps(entities if "list" in text else {"entities": entities, "relations": relations}))
        return out

    return extractor


@pytest.mark.parametrize("spelling", [0, 1])
def test_ingest_asks_once_a_chunk(spark, tmp_path, spelling):
    texts = ["first text", "second text", "broken text", None, "a list", "first text "] + [f"words {n} and more" for n in range(6)]
    docs = spark.createDataFrame([(f"d{n:02}", f"p/{n:02}", t) for n, t in enumerate(texts)], "doc_id string, file_path string, text string")
    made = ingest(docs, extractor=answered(tmp_path, spelling))
    tables = {name: t.collect() for name, t in made.items()}
    chunks = tables["chunks"]
    # "first text" is the content of two chunks and asked about once; a failed batch is gone through row by row
    assert len(chunks) == 11 and len({c["content"] for c in chunks}) == 10
    calls = [open(f"{tmp_path}/{f}").read() for f in os.listdir(tmp_path)]
    assert set(calls) == {c["content"] for c in chunks} and all(calls.count(c) <= 2 for c in set(calls))
    assert sorted(r["name"].strip() for r in tables["entities"]) == ["CLIP", "ImageNet"]
    assert len(tables["mentions"]) == 20 and [(r["type"], r["description"]) for r in tables["relations"]] == [("USES", "d")]
    assert {r["doc_id"]: r["status"] for r in tables["status"]} == {f"d{n:02}": "empty" if n == 3 else "ready" for n in range(12)}
    again = ingest(docs, extractor=answered(tmp_path, spelling), known=made["answers"])
    assert sorted(map(tuple, again["mentions"].collect())) == sorted(map(tuple, tables["mentions"]))
    new = [open(f"{tmp_path}/{f}").read() for f in os.listdir(tmp_path)][len(calls) :]
    assert len(os.listdir(tmp_path)) - len(calls) <= 2 and set(new) <= set(calls)  # only the failed one is asked again


def test_ingest_of_bad_files_and_pages(spark):
    pages = [("p", 0, "Abstract\nWe look at pages. They are short."), ("p", 1, " "), ("p", 2, "more of it\n\nand " + "some words. " * 60), ("p", 3, "Method\nwe do it"), ("q", 0, "no heading here")]
    docs = spark.createDataFrame([("p", "f/p", None, None), ("q", "f/q", None, None), ("r", "f/r", "a bad vector", None), ("s", "f/s", None, "cannot read"), ("t", "f/t", "fine text", None)], "doc_id string, file_path string, text string, error string")

    def embedder(asked):
        if any("bad" in t for (t,) in asked):
            raise ValueError("no vector")
        return [[float(len(t))] for (t,) in asked]

    made = {n: t.collect() for n, t in ingest(docs, embedder, pages=spark.createDataFrame(pages, "doc_id string, page_no int, text string")).items()}
    assert {r["doc_id"]: (r["status"], r["step"]) for r in made["status"]} == {"p": ("ready", None), "q": ("ready", None), "r": ("failed", "indexing"), "s": ("failed", "parsing"), "t": ("ready", None)}
    assert {r["doc_id"] for r in made["vectors"]} == {"p", "q", "t"}
    texts = {d: "\n\n".join(t for p, _, t in pages if p == d and t.strip()) for d in "pq"} | {"r": "a bad vector", "t": "fine text"}
    ends = {"p": {}, "q": {}}
    for d in ends:
        at = 0
        for p, n, t in pages:
            if p == d and t.strip():
                ends[d][n], at = (at, at + len(t)), at + len(t) + 2
    tidy = lambda x: " ".join(x.split())
    for c in made["chunks"]:
        own = tidy(texts[c["doc_id"]][c["start"] : c["end"]])
        assert own and tidy(c["content"]).endswith(own)
        if c["doc_id"] in ends:
            low, high = ends[c["doc_id"]][c["page_no"]]
            assert low <= c["start"] < high + 2
        else:
            assert c["page_no"] is None
    of_p = sorted((c["chunk_index"], c["section"], c["page_no"]) for c in made["chunks"] if c["doc_id"] == "p")
    assert [s for _, s, _ in of_p][0] == "abstract" and of_p[-1][1:] == ("method", 3) and [k for k, _, _ in of_p] == list(range(len(of_p)))
    counted = totals(ingest(docs, embedder)["status"]).first()
    assert (counted["files"], counted["failed"]) == (4, 2)  # p and q have the same content without pages


def test_streamed_ingest_equals_the_batch(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    texts = [f"text {n} of {2000 + n}. " * (n + 1) + ("\nReferences\n[1] A name, \"A title of some length\", 2019." if n % 2 else "") for n in range(9)]
    rows = [(f"d{n}", f"p/{n}", t) for n, t in enumerate(texts)] + [("d9", "p/9", texts[0]), ("e", "p/e", "")]
    schema = "doc_id string, file_path string, text string"
    for k in range(3):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    folder, fails = f"{tmp_path}/out", []
    write = ingest_module.KEPT

    class Stops(dict):
        """The tables; the second batch fails half way, once."""

        def __iter__(self):
            for n, name in enumerate(write):
                if n == 4 and len(fails) == 0 and os.path.exists(f"{folder}/chunks/batch=1"):
                    fails.append(name)
                    raise RuntimeError("stopped half way")
                yield name

    ingest_module.KEPT = Stops(write)
    try:
        with pytest.raises(Exception, match="stopped half way"):
            jobs.ingest_stream(source(), folder, extractor=answered(calls))
        assert os.path.exists(f"{folder}/chunks/batch=1") and not os.path.exists(f"{folder}/status/batch=1")
        jobs.ingest_stream(source(), folder, extractor=answered(calls))
        jobs.ingest_stream(source(), folder, extractor=answered(calls))
    finally:
        ingest_module.KEPT = write
    docs = spark.createDataFrame(rows, schema)
    # the stream keeps the first that came of equal contents, which are those of the first paths here
    names = ("documents", "chunks", "references", "cites", "entities", "mentions", "relations", "status")
    plain = lambda t: sorted((tuple(r) for r in t.select(sorted(t.columns)).collect()), key=repr)
    want, got = ({n: plain(t[n]) for n in names} for t in (ingest(docs, extractor=answered(calls)), ingest_module.tables(spark, folder)))
    ingest_module.ingest_to(folder, 1, spark.createDataFrame(rows[4:8], schema), extractor=answered(calls))
    again = ingest_module.tables(spark, folder)
    for name in names:
        assert got[name] == want[name] == plain(again[name]), name


def test_streamed_limiter_lets_go_of_idle_keys(spark, tmp_path):
    """Triggers far apart: the state of a key that has been idle for a window is removed, and what is allowed is the
    same as in batch."""
    from papyra.streaming import jobs, ordered

    start = datetime.datetime(2024, 1, 1)
    rows = [(s, "t", start + datetime.timedelta(seconds=60 * day * 1440 + 10 * n), 1000 * day + 10 * s + n) for day in range(3) for s in range(3 if day == 0 else 1) for n in range(4)]
    schema = "session_id long, tool string, ts timestamp, event_id long"
    for day in range(3):
        spark.createDataFrame([r for r in rows if r[3] // 1000 == day], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))
    calls = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "calls"))
    got = {r["event_id"]: r["allowed"] for r in jobs.run_available(jobs.limit_calls_stream(calls, 2, 3600, "10 minutes")).collect()}
    want = {r["event_id"]: r["allowed"] for r in S.limit_calls(spark.createDataFrame(rows, schema), 2, 3600).collect()}
    assert got == want


def _fed(spark, folder, rows, schema, order, per_file):
    """Files of the rows in the given order, one a trigger."""
    for k in range(0, len(order), per_file):
        part = [rows[i] for i in order[k : k + per_file]]
        path = f"{folder}/{len(os.listdir(folder)) if os.path.exists(folder) else 0:03}"
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(path)
        time.sleep(0.02)


def test_streams_in_order_equal_their_batch_twins(spark, tmp_path):
    rng, day = random.Random(6), datetime.datetime(2024, 1, 1)
    at = lambda s: day + datetime.timedelta(seconds=s)
    calls = [(rng.randint(1, 4), rng.choice(["a", "b"]), at(rng.randint(0, 400)), n) for n in range(160)]
    resets = [(None, None, at(150)), (1, None, at(90)), (2, "a", at(200)), (3, None, at(calls[0][2].second))]
    turns = [(n % 5, n, 40 + n % 7 * 30, at(n * 3)) for n in range(130)]
    shapes = {"calls": (calls, "session_id long, tool string, ts timestamp, event_id long"), "resets": (resets, "session_id long, tool string, ts timestamp"), "turns": (turns, "session_id long, turn long, tokens long, ts timestamp")}
    frames = {n: spark.createDataFrame(r, s) for n, (r, s) in shapes.items()}
    source = lambda n: spark.readStream.schema(shapes[n][1]).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/{n}")
    late = {"calls": (9, "z", at(10**6), 10**6), "turns": (99, 0, 0, at(10**6))}
    want = sorted(map(tuple, S.limit_calls_with_resets(frames["calls"], frames["resets"], 2, 60).select("session_id", "tool", "event_id", "allowed").collect()))
    told = sorted((r["session_id"], list(r["covers"]), r["total"]) for r in S.compactions(frames["turns"], 300, 3, 50).collect())
    assert len({w[3] for w in want}) == 2 and len(told) > 5
    # in halves with a restart between, in any order; one late row lets the watermark pass all others
    for half in (0, 1):
        for n, (rows, schema) in shapes.items():
            order = list(range(half, len(rows), 2))
            rng.shuffle(order)
            _fed(spark, f"{tmp_path}/{n}", rows, schema, order, 15)
            if half and n in late:
                for _ in range(2):
                    _fed(spark, f"{tmp_path}/{n}", [late[n]], schema, [0], 1)
        limited = jobs.run_available(ordered.limit_calls_in_order(source("calls"), source("resets"), 2, 60, "1 hour", groups=3), folder=f"{tmp_path}/limited")
        compacted = jobs.run_available(ordered.compactions_in_order(source("turns"), 300, 3, "1 hour", 50), folder=f"{tmp_path}/compacted")
    assert sorted(map(tuple, limited.where("event_id < 1000000").select("session_id", "tool", "event_id", "allowed").collect())) == want
    assert sorted((r["session_id"], list(r["covers"]), r["total"]) for r in compacted.collect()) == told


def test_compactions_by_brute_force(spark):
    rng = random.Random(2)
    turns = [(rng.randint(0, 6), n, rng.choice([None, 10, 200, 500]), datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)) for n in range(150)]
    want = []
    for session in range(7):
        held, total = [], 0
        for _, n, tokens, _ in (t for t in turns if t[0] == session):
            held.append((n, tokens or 0))
            total += tokens or 0
            if total > 800 and len(held) > 2:
                want.append((session, [t for t, _ in held[:-2]], total))
                held = held[-2:]
                total = sum(x for _, x in held) + 7
    got = S.compactions(spark.createDataFrame(turns, "session_id long, turn long, tokens long, ts timestamp"), 800, 2, 7).collect()
    assert sorted((r["session_id"], list(r["covers"]), r["total"]) for r in got) == sorted(want)
