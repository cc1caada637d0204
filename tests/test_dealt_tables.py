"""Tables that are changed partition by partition."""

from __future__ import annotations

import os

from papyra.operators import maintenance as M
from papyra.sources import dealt


def times(path):
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("part=")}


def test_changes_touch_their_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(n, f"v{n}") for n in range(200)] + [(None, "none")]
    dealt.deal(spark.createDataFrame(rows, "id long, v string"), path, ["id"], parts=16)
    assert sorted(map(tuple, dealt.load(spark, path).collect()), key=repr) == sorted(rows, key=repr)
    before = times(path)
    assert len(before) == 16
    assert dealt.remove(spark, path, spark.createDataFrame([(5,), (6,), (5,), (999,)], "id long"), ["id"]) == 2
    after = times(path)
    changed = [d for d in before if before[d] != after[d]]
    assert 1 <= len(changed) <= 2
    assert dealt.remove(spark, path, spark.createDataFrame([(999,)], "id long"), ["id"]) == 0 and times(path) == after
    dealt.put(spark, path, spark.createDataFrame([(7, "new"), (1000, "more")], "id long, v string"), ["id"])
    assert len([d for d in after if after[d] != times(path)[d]]) <= 2
    want = [(n, "new" if n == 7 else f"v{n}") for n in range(200) if n not in (5, 6)] + [(1000, "more"), (None, "none")]
    assert sorted(map(tuple, dealt.load(spark, path).collect()), key=repr) == sorted(want, key=repr)
    # a partition that loses its last row is emptied
    assert dealt.remove(spark, path, dealt.load(spark, path), ["id"]) == 200
    assert dealt.load(spark, path).count() == 0 and len(times(path)) == 16


def test_removed_documents_take_along_what_hangs_on_them(spark, tmp_path):
    mentions = [(f"c{n}", f"e{e}") for n in range(30) for e in (n % 7, n % 5 + 7, n // 10 + 20)]
    tables = {
        "documents": ([(f"d{n}",) for n in range(10)], "doc_id string"),
        "chunks": ([(f"c{n}", f"d{n // 3}") for n in range(30)], "chunk_id string, doc_id string"),
        "cites": ([(f"d{n}", f"r{n % 3}") for n in range(10)], "doc_id string, ref_id string"),
        "mentions": (mentions, "chunk_id string, entity_id string"),
        "relations": ([(f"e{a}", f"e{b}", "T") for a in range(7) for b in (7, 8, 20, 22)], "src string, dst string, type string"),
        "entities": ([(f"e{n}",) for n in range(25)], "entity_id string"),
        "vectors": ([(f"c{n}",) for n in range(30)], "chunk_id string"),
    }
    frames = {n: spark.createDataFrame(r, s) for n, (r, s) in tables.items()}
    for name, df in frames.items():
        dealt.deal(df, f"{tmp_path}/{name}", dealt.KEYS[name], parts=8)
    ids = spark.createDataFrame([("d0",), ("d1",), ("d2",), ("d3",), ("nothing",)], "doc_id string")
    left, counts = M.delete_cascade(frames, ids)
    found = dealt.remove_documents(spark, str(tmp_path), ids)
    assert {r["table"]: r["deleted"] for r in counts.collect()} == {k: v for k, v in found.items() if k != "vectors"} and found["vectors"] == 12
    for name in tables:
        if name != "vectors":
            assert sorted(map(tuple, dealt.load(spark, f"{tmp_path}/{name}").collect())) == sorted(map(tuple, left[name].select(frames[name].columns).collect())), name
    assert dealt.remove_documents(spark, str(tmp_path), ids) == dict.fromkeys(found, 0)
