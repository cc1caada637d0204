"""Keyword extraction for batches of queries: phrases by place, cleaned, told apart, each once."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import clean_phrase, distinct_keywords, expand_topic, extract_json, phrase_level

# The patterns of phrases; mixed terms, topics, then names and runs of Chinese.
PHRASES = (
    r"[\u4e00-\u9fff]{2,12}[A-Za-z][A-Za-z0-9.+\-]{1,20}|[A-Za-z][A-Za-z0-9.+\-]{1,20}[\u4e00-\u9fff]{2,12}",
    r"[\u4e00-\u9fffA-Za-z0-9.+\-]{0,10}(?:研究趋势|发展趋势|应用挑战|研究方向|研究现状|技术进展|主要挑战)",
    r"[A-Z][A-Za-z0-9.+\-]*(?:\s+[A-Z]?[A-Za-z0-9.+\-]+){0,5}|[A-Za-z][A-Za-z0-9.+\-]{1,31}|[\u4e00-\u9fff]{2,20}",
)


def _phrases(texts: pd.Series) -> pd.Series:
    """All patterns' matches in order of their places, which Spark's own functions don't give."""
    patterns = [re.compile(p) for p in PHRASES]

    def one(text: str | None) -> list[str]:
        text = " ".join((text or "").split())
        found = sorted(((m.start(), n, m[0].strip()) for n, p in enumerate(patterns) for m in p.finditer(text)), key=lambda x: x[:2])
        return [x for _, _, x in found] or text.split()

    return texts.map(one)


def extract_keywords(queries: DataFrame) -> DataFrame:
    """Adds ll and hl to queries (query_id, text): names of things and topics; a topic that is also a name is a name."""
    rows = queries.withColumn("_p", F.filter(F.transform(F.pandas_udf(_phrases, "array<string>")("text"), clean_phrase), lambda p: p != ""))
    of = lambda level: F.filter("_p", lambda p: phrase_level(p) == level)
    ll = distinct_keywords(of("ll"))
    hl = distinct_keywords(F.flatten(F.transform(of("hl"), expand_topic)))
    rows = rows.withColumn("ll", ll).withColumn("hl", hl)
    lowered = F.transform("ll", lambda x: F.lower(x))
    return rows.withColumn("hl", F.filter("hl", lambda h: ~F.array_contains(lowered, F.lower(h)))).drop("_p")


def naive_keywords(text: Column) -> Column:
    """What stands in where nothing was extracted: the words longer than one character."""
    return F.filter(F.split(text, r"[\s,，。?？!！]+"), lambda w: F.length(w) > 1)


def keywords_or_asked(queries: DataFrame, call=None) -> DataFrame:
    """As extract_keywords; a query without any keyword gets those of a model: `call` gives JSON with the arrays
    low_level_keywords and high_level_keywords. Where it fails or gives no JSON both lists stay empty."""
    from papyra.operators.hooks import apply_hook

    rows = extract_keywords(queries)
    if call is None:
        return rows
    none = (F.size("ll") == 0) & (F.size("hl") == 0)
    asked = apply_hook(rows.where(none), call, ["text"], "_answer", "string").drop("_answer_error")
    given = F.from_json(extract_json(F.col("_answer")), "low_level_keywords array<string>, high_level_keywords array<string>")
    list_of = lambda name: distinct_keywords(F.filter(F.coalesce(given[name], F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    asked = asked.withColumn("ll", list_of("low_level_keywords")).withColumn("hl", list_of("high_level_keywords")).drop("_answer")
    return rows.where(~none).unionByName(asked)
