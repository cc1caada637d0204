"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items, run once over
every document.

Texts are normalised to lower-case words joined by single spaces. Each item yields its windows of `window`
consecutive words (one shorter window if it has fewer words). Windows are bounded by spaces on both sides, so a
match is one of whole words. Matches are mapped back to code points of the original text.

Null texts, empty texts and texts without words have no hits. Items without words, and items whose id is null,
are left out. Items with equal texts are both reported. Documents may repeat: each row is judged by itself and
all its other columns stay, except those that have the name of an added column.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import WORD_BYTES, append_columns, cut, free_names, raw_texts, words_of

#: An automaton is built over at most about so many characters of items; larger sets are scanned in blocks, one
#: after the other, so that what is broadcast and what a worker holds stay bounded.
BLOCK_CHARS = 2_000_000

#: The column that carries hits from block to block.
HITS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("item", T.StringType())]))
HITS_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("item", pa.string())]))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    """All windows of an item; one shorter window if it has fewer words, none if it has none."""
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def build_automaton(items: list[tuple[str, str]], window: int):
    """An automaton over the items' windows; a match gives the number of words and the items that have it."""
    import ahocorasick

    holders: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        for w in windows_of(words_of(text.encode()), window):
            holders.setdefault(w, set()).add(item)
    if not holders:
        return None
    automaton = ahocorasick.Automaton()
    for w, names in holders.items():
        automaton.add_word((b" " + b" ".join(w) + b" ").decode("latin-1"), (len(w), sorted(names)))
    automaton.make_automaton()
    return automaton


def find_hits(automaton, words: list[bytes]) -> list[tuple[int, int, str]]:
    """(first word, one past the last word, item) of every match. Bytes are read as Latin-1, one character each."""
    if automaton is None or not words:
        return []
    text = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = list(automaton.iter(text))
    if not found:
        return []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    spaces = np.concatenate(([0], np.cumsum(lengths + 1)))
    ends = np.searchsorted(spaces, [at for at, _ in found])
    return [(int(end) - n, int(end), item) for end, (_, (n, names)) in zip(ends, found, strict=True) for item in names]


def merge(hits: list[tuple[int, int, str]]) -> list[list[int]]:
    """The word intervals that the hits cover, in order and disjoint."""
    merged: list[list[int]] = []
    for first, last, _ in sorted(hits):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    return merged


def original_spans(raw: bytes, intervals: list[list[int]]) -> list[dict]:
    """Word intervals as code points of the original text."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(WORD_BYTES))]
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(points[at[a][0]]), "end": int(points[at[b - 1][1]])} for a, b in intervals]


_KEPT: dict[str, object] = {}


def _automaton(key: str, items, window: int):
    """The worker's automaton of one scan; it serves all the worker's tasks."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build_automaton(items.value, window)
    return _KEPT[key]


def _scan(docs: DataFrame, items, window: int, text_col: str, name: str, carried: bool, last: bool) -> DataFrame:
    key = uuid.uuid4().hex
    hits_field = T.StructField(name, HITS)
    added = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("spans", SPANS),
    ]

    def start():
        automaton = _automaton(key, items, window)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            raws = raw_texts(batch.column(text_col))
            before = batch.column(name).to_pylist() if carried else [None] * len(raws)
            out: list[list] = [[], [], [], [], []]
            for raw, old in zip(raws, before, strict=True):
                words = words_of(raw)
                hits = find_hits(automaton, words) + [(h["first"], h["last"], h["item"]) for h in old or ()]
                if not last:
                    out[0].append([{"first": a, "last": b, "item": i} for a, b, i in hits])
                    continue
                merged = merge(hits)
                out[1].append(len(words))
                out[2].append(sum(b - a for a, b in merged))
                out[3].append(sorted({i for _, _, i in hits}))
                out[4].append(original_spans(raw, merged) if merged else [])
            if not last:
                return [pa.array(out[0], HITS_ARROW)]
            return [pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.string())), pa.array(out[4], SPANS_ARROW)]

        return work

    done = append_columns(docs, T.StructType(added if last else [hits_field]), start)
    return done.drop(name) if last and carried else done


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Adds n_words, n_hit, item_ids (items with a window in the text, sorted) and spans (what matches cover).

    items: item_id and text. Its size is checked first; beyond `block_chars` the items are dealt over blocks.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_chars))
    name = free_names(docs, "hits_so_far")[0]
    for k in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k) if n_blocks > 1 else items
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in block.collect()])
        docs = _scan(docs, shared, window, text_col, name, carried=k > 0, last=k == n_blocks - 1)
        if k < n_blocks - 1:
            docs = cut(docs)
    return docs
