"""Registered queries on tables that are folders of files, and on odd rows."""

from __future__ import annotations

import random

import pytest
from conftest import rows_of

from papyra.operators import bm25 as B
from papyra.operators import entities as E
from papyra.operators import graph as G
from papyra.operators import hooks as H
from papyra.operators import sessions as S
from papyra.plans import registry
from papyra.sources import batches


def _same(spark, folder, name, tables):
    """The query over the folder's tables against its SQL."""
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = registry.queries()[name](spark, str(folder))
    found = con.execute(registry.oracle_sql()[name])
    got, want = rows_of(df.columns, df.collect()), rows_of([c[0] for c in found.description], found.fetchall())
    assert got == want
    return got[1]


def _documents(spark, folder, texts, files=3):
    rows = [(n, t, "en", "web", len(t or "")) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(files).write.parquet(f"{folder}/documents.parquet")


def test_streams_read_folders_of_files_and_null_texts(spark, tmp_path):
    """ingest_stream returned no rows for a table of several files, and lost the null text."""
    _documents(spark, tmp_path, ["a b", None, "c", "a b", None, "", "d" * 70])
    assert len(_same(spark, tmp_path, "ingest_stream", ["documents"])) == 5


def test_slugs_of_odd_texts(spark, tmp_path):
    """A text of which nothing is left was called memory; a dotted capital I became i_."""
    odd = ["", "???", "__", None, "\u0130stanbul", "memory", "x" * 59 + "?y", " a  B-c_ ", "\u00c9\u00e9"]
    _documents(spark, tmp_path, odd)
    _same(spark, tmp_path, "slug", ["documents"])


def test_relations_of_entities_at_one_place(spark):
    """Of entities of one name at one place, whichever came first out of the shuffle was taken."""
    rows = [(1, 1, "a", 7, 3), (1, 2, "b", 9, 0), (1, 2, "B", 5, 1), (1, 2, "b", 8, 2)]
    relations = spark.createDataFrame([(1, "a", "NEXT", "b")], "chunk_id long, source string, type string, target string")
    for order in (rows, rows[::-1]):
        found = spark.createDataFrame(order, "chunk_id long, pos int, name string, entity_id long, seq long")
        assert [r.target_id for r in E.resolve_relations(found, relations).collect()] == [9]
        assert [r.target_id for r in E.resolve_relations(found.drop("seq"), relations).collect()] == [5]


def _star(spark, folder):
    """Orders, lines and parts; some parts have the number of a supplier after a million."""
    rng = random.Random(3)
    parts = [*range(5), *range(1_000_000, 1_000_005)]
    spark.createDataFrame([(o, o % 4, "FOP"[o % 3]) for o in range(40)], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{folder}/orders.parquet")
    lines = [(rng.randrange(40), rng.choice(parts), rng.randrange(5), rng.randrange(1, 4)) for _ in range(60)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").repartition(3).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(p,) for p in parts], "p_partkey long").write.parquet(f"{folder}/part.parquet")


@pytest.mark.parametrize("name", ["delete_cascade", "old_version_cleanup", "delete_in_place"])
def test_deletes_with_many_parts(name, spark, tmp_path):
    """Beyond a million parts, a part and a supplier were one entity."""
    _star(spark, tmp_path)
    _same(spark, tmp_path, name, ["orders", "lineitem", "part"])


@pytest.mark.parametrize("paired", [0, 3, 64])
def test_lost_support_against_all_pairs(spark, monkeypatch, paired):
    """Each chunk's mentions are dealt once; relations x mentions of an end is not made for small chunks."""
    monkeypatch.setattr(G, "PAIRED", max(1, paired))
    rng = random.Random(paired)
    mentions = [(rng.choice([None, *range(12)]), rng.choice([None, *range(8)])) for _ in range(50)]
    relations = sorted({(rng.randrange(8), rng.randrange(8)) for _ in range(40)})
    gone = {0, 1, 2, 3, 4, 5, 99}
    frames = spark.createDataFrame(relations, "src long, dst long"), spark.createDataFrame(mentions, "chunk_id long, entity_id long"), spark.createDataFrame([(c,) for c in gone], "chunk_id long")
    n, dead, orphans = G.lost_support(*frames)
    of = {}
    for c, e in mentions:
        of.setdefault(c, set()).add(e)
    by = lambda s, d: {c in gone for c in of if c is not None and {s, d} <= of[c]}
    assert n == sum(c in gone for c, _ in mentions)
    assert {tuple(r) for r in dead.collect()} == {r for r in relations if by(*r) == {True}}
    assert {r[0] for r in orphans.collect()} == {e for e in range(8) if {c in gone for c in of if e in of[c]} == {True}}


def test_batches_to_python_are_bounded_by_bytes(spark):
    """The BM25 index and the hooks took batches of 10,000 rows, however long the texts were."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(100).selectExpr("id AS key", "repeat('word ', 20000) AS text").coalesce(1)
    spark.conf.unset(key)
    sizes = H.apply_hook(docs, lambda rows: [len(rows)] * len(rows), ["text"], "n", "long").select("n").collect()
    assert max(r.n for r in sizes) * 100_000 <= batches.BATCH_BYTES + 100_000
    spark.conf.unset(key)
    assert B.build(docs).n_words == 2_000_000
    assert int(spark.conf.get(key)) <= batches.BATCH_BYTES


def test_word_sets_meet_as_numbers(spark):
    """Each word of each memory, with its set's digest, went through two shuffles before any two sets met."""
    sets = spark.createDataFrame([("s1", "t", ["a", "b", "c"]), ("s2", "t", ["a", "b", "d"])], "_set string, _type string, w array<string>")
    (coded,) = S._coded([sets])
    assert dict(coded.dtypes)["o"] == "array<bigint>"
    rows = {r["_set"]: r for r in coded.collect()}
    assert [len(r.o) for r in rows.values()] == [3, 3] and [r["_few"] for r in rows.values()] == [1, 1]
    assert rows["s1"].o[1:] == rows["s2"].o[1:]
    assert {tuple(r) for r in S._similar_sets(sets, sets, 0.4, own=True).collect()} in ({("s1", "s2")}, {("s2", "s1")})
