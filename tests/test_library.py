"""The eight entry points over a small library, and the router's rules."""

from __future__ import annotations

import json

import pytest

from papyra.operators import router
from papyra.operators.library import Library

QUESTION = "query_id long, text string, mode string, ll array<string>, hl array<string>, section string, year_from int, year_to int"


@pytest.fixture(scope="module")
def library(spark):
    papers = [(f"d{n}", f"Paper {n} on {'graphs' if n % 2 else 'trees'}", "A. Name", None if n % 3 else "an abstract of GRAPHS", "k") for n in range(12)]
    contents = [(f"c{n}", f"file{n}", f"content {n}", "method" if n % 2 else "result", None if n % 5 == 0 else 2010 + n) for n in range(40)]
    nodes = [(f"e{n}", "Entity", f"Net {n:02}") for n in range(20)] + [("x", "Document", "Net doc")]
    edges = [(f"e{n}", f"e{n + 1}", "USES" if n % 2 else "IN") for n in range(19)]
    first = lambda names: lambda asked, k: asked.select("query_id").crossJoin(spark.createDataFrame([(r + 1, x) for r, x in enumerate(names[:k])], "rank int, key string"))
    finders = {
        "vectors": first([f"c{n}" for n in range(40)]),
        "words": first(["c5", "c1"]),
        "chunks": first(["c7", "c0"]),
        "entities": first(["1", "2"]),
        "relations": first(["3::4"]),
    }
    ids = spark.createDataFrame([(n, n + 1, "IN") for n in range(1, 9)], "src long, dst long, type string")
    return Library(
        papers=spark.createDataFrame(papers, "doc_id string, title string, authors string, abstract string, keywords string"),
        contents=spark.createDataFrame(contents, "key string, source string, content string, section string, year int"),
        nodes=spark.createDataFrame(nodes, "id string, label string, name string"),
        edges=spark.createDataFrame(edges, "src string, dst string, type string"),
        communities=spark.createDataFrame([("community-1", 5)], "community_id string, entity_count long"),
        finders=finders,
    ), ids


def test_modes_follow_the_text_and_the_history(spark):
    best = spark.createDataFrame([("abstract", "hybrid"), ("temporal", "local")], "question_type string, mode string")
    rows = [
        (1, "2015年以来 graphs", "auto", [], [], "", 0, 0),
        (2, "a", "auto", ["CLIP"], ["survey"], None, None, None),
        (3, "a", "auto", ["CLIP"], [], " ", 0, 0),
        (4, "a", "auto", [], ["survey"], "method", 0, 0),
        (5, None, None, [], [], "", 2012, 0),
        (6, "a", "odd", [], [], "", 0, 0),
        (7, "a", "dual", [], ["survey"], "", 0, 0),
    ]
    plan = {r["query_id"]: r for r in router.planned(spark.createDataFrame(rows, QUESTION), best, 2024).collect()}
    assert {n: r["mode"] for n, r in plan.items()} == {1: "mix", 2: "dual", 3: "local", 4: "hybrid", 5: "mix", 6: "semantic", 7: "dual"}
    assert {n: r["depth"] for n, r in plan.items()} == {1: 20, 2: 5, 3: 5, 4: 20, 5: 20, 6: 5, 7: 5}
    assert (plan[1]["year_from"], plan[1]["explicit"], plan[5]["year_from"], plan[5]["explicit"]) == (2015, False, 2012, True)


def test_entry_points(spark, library):
    lib, ids = library
    asked = [(1, "a", "semantic", [], [], "method", 0, 0), (2, "a", "hybrid", [], [], "", 0, 0), (3, "a", "semantic", [], [], "", 2040, 0)]
    routed = Library(contents=lib.contents, edges=ids, finders=lib.finders, communities=lib.communities)
    told = {r["query_id"]: r for r in routed.retrieve_knowledge(spark.createDataFrame(asked, QUESTION)).collect()}
    assert told[1]["context"].startswith("[1] file1\ncontent 1\n\n[2] file3") and told[1]["sources"] == [f"file{n}" for n in (1, 3, 5, 7, 9)]
    assert told[2]["sources"][:2] == ["file1", "file5"]  # in both lists
    assert told[3]["sources"] == [f"file{n}" for n in (0, 5, 10, 15)]  # only unknown years are left of the first 20
    parts = spark.createDataFrame([(7, *asked[0]), (7, *asked[1])], "parent_id long, " + QUESTION)
    (task,) = routed.deep_research(parts, use_community=True).collect()
    assert task["n_questions"] == 2 and task["context"].startswith("- community-1 (5)\n\n## a\n[1] content 1")
    listed = {r["query_id"]: r for r in lib.list_documents(spark.createDataFrame([(1, "GRAPHS", 3), (2, "", 2), (3, "nothing", 5), (4, None, 50)], "query_id int, keyword string, most int")).collect()}
    assert [(listed[n]["total"], [x["doc_id"] for x in listed[n]["listed"] or []]) for n in (1, 2, 3)] == [(8, ["d0", "d1", "d11"]), (12, ["d0", "d1"]), (0, [])]
    assert len(listed[4]["listed"]) == 12
    found = {r["query_id"]: (r["doc_id"], r["others"]) for r in lib.get_document_metadata(spark.createDataFrame([(1, "d4"), (2, "TREES"), (3, "none")], "query_id int, q string")).collect()}
    assert found == {1: ("d4", 0), 2: ("d0", 5)}
    near = [tuple(r) for r in lib.search_by_entity(spark.createDataFrame([(1, "net 0", "IN"), (2, "NET", ""), (3, "doc", None)], "query_id int, entity_name string, relation_type string")).collect()]
    assert [r[2:] for r in near if r[0] == 1 and r[1] == "relation"] == [(f"e{n}", f"e{n + 1}") for n in range(0, 9, 2)]
    assert sum(r[:2] == (2, "node") for r in near) == 10 and sum(r[:2] == (2, "relation") for r in near) == 15 and not any(r[0] == 3 for r in near)
    assert {(r["kind"], r["name"]): r["n"] for r in lib.get_knowledge_graph_stats().collect()}["node", "Entity"] == 20
    new = spark.createDataFrame([("My Note", "first\nsecond", "RULE"), ("My Note", "zzz", "note"), ("b", " ", "rule"), ("c", "text", "odd")], "title string, body string, type string")
    kept = {r["title"]: (r["type"], r["description"]) for r in lib.save_user_memory(new).collect()}
    assert kept == {"My Note": ("rule", "first"), "c": ("preference", "text")}

    def model(asked):
        if any("bad" in p for (p,) in asked):
            raise ValueError("no")
        return [json.dumps({"research_gaps": [p]}) for (p,) in asked]

    ideas = {r["query_id"]: r for r in lib.generate_research_ideas(spark.createDataFrame([(1, "topic", "report"), (2, "bad", None)], "query_id int, topic string, research_report string"), model).collect()}
    assert "topic\n\nreport" in ideas[1]["report"] and ideas[2]["report"] is None and "no" in ideas[2]["error"]
