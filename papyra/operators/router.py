"""The router: each question gets the retrieval mode that its text and the history of its kind call for.

`planned` reads the questions; `answered` runs the modes. Modes are made of a few lists (vectors, words, chunks, entities,
relations), each of which is searched once, for the questions whose modes need it, to the greatest depth asked for;
questions then cut the lists to their own depth.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions import text as X
from papyra.operators import graph as G
from papyra.operators import retrieval as R
from papyra.operators.questions import override_modes
from papyra.sources.scratch import written

MODES = ("semantic", "local", "global", "dual", "mix", "hybrid")
#: With a filter so many times more are searched than are wanted.
WIDER = 4
HYBRID_DEPTH = 10
#: The lists that each mode is made of.
LISTS = {
    "vectors": ("semantic", "local", "mix", "hybrid"),
    "words": ("hybrid",),
    "chunks": ("local", "global", "mix"),
    "entities": ("dual", "global", "mix"),
    "relations": ("dual", "global", "mix"),
}

Finder = Callable[[DataFrame, int], DataFrame]


def planned(questions: DataFrame, best: DataFrame | None, as_of_year: int, k: int = 5) -> DataFrame:
    """questions (query_id, text, mode, ll, hl, section, year_from, year_to) with question_type, the mode that is taken, the
    bounds of years, explicit (they were asked for and not read from the text), and depth.

    A mode that is neither auto nor known is semantic. For auto, the kind of the question (by the time that it asks for and
    its keywords) gives the mode, or the mode that did best for the kind where `best` (question_type, mode) has one; not for
    questions about times. Blank sections and null or 0 years filter nothing."""
    none = lambda c: F.nullif(F.col(c), F.lit(0)).cast("int")
    asked = X.time_constraint(F.coalesce("text", F.lit("")), as_of_year)
    given = none("year_from").isNotNull() | none("year_to").isNotNull()
    rows = questions.withColumn("_t", asked).withColumn("explicit", given)
    rows = rows.withColumn("question_type", X.question_type(F.col("_t"), F.col("ll"), F.col("hl"))).withColumn("_auto", X.auto_mode(F.col("_t"), F.col("ll"), F.col("hl")))
    rows = rows.withColumnsRenamed({"mode": "_asked", "_auto": "mode"})
    if best is not None:
        rows = override_modes(rows, best)
    mode = F.when(F.coalesce("_asked", F.lit("auto")) == "auto", F.col("mode")).when(F.col("_asked").isin(*MODES), F.col("_asked")).otherwise("semantic")
    section = F.nullif(F.trim(F.coalesce("section", F.lit(""))), F.lit(""))
    low = F.when(F.col("explicit"), none("year_from")).otherwise(F.col("_t.year_from"))
    high = F.when(F.col("explicit"), none("year_to")).otherwise(F.col("_t.year_to"))
    filtered = section.isNotNull() | F.col("explicit") | F.col("_t").isNotNull()
    depth = F.when(filtered, k * WIDER).otherwise(k)
    return rows.select("query_id", "text", "ll", "hl", "question_type", mode.alias("mode"), section.alias("section"), low.alias("year_from"), high.alias("year_to"), "explicit", depth.alias("depth"))


def answered(plan: DataFrame, finders: dict[str, Finder], edges: DataFrame, facts: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, mode, key, rank) for the planned questions. finders: by list, a function of questions and a depth that
    gives (query_id, rank, key); relations have keys src::dst, of the ids that entities have. edges: (src, dst). facts:
    (key, section, year) of what can be found; what is missing there has neither.

    dual is entities, relations and their neighbours; global is dual, or relations and chunks for questions that dual has
    nothing for; mix unites vectors, the local list and global. A section keeps only keys that have it; years asked for are
    kept to, years read from the text are relaxed where they leave too little."""
    plan = written(plan)
    used = {r["mode"] for r in plan.select("mode").distinct().collect()}
    deepest = plan.agg(F.max("depth")).first()[0] or k
    factor = F.when(F.col("mode") == "mix", 2).otherwise(1)  # the mix asks its parts for twice as many
    wide = plan.select(F.col("query_id").alias("_q"), "mode", (F.col("depth") * factor).alias("_wide"), "depth")
    wide = F.broadcast(wide) if plan.count() <= R.BROADCAST_QUERIES else wide

    lists = {}
    for name, modes in LISTS.items():
        if used & set(modes):
            asked = plan.where(F.col("mode").isin(*modes))
            most = HYBRID_DEPTH if name == "words" else max(HYBRID_DEPTH, 4 * deepest)
            found = finders[name](asked, most).select("query_id", "rank", F.col("key").cast("string").alias("key"))
            lists[name] = written(found)

    def of(name: str, modes: tuple[str, ...], times: int = 1, most: str = "_wide") -> DataFrame:
        hits = lists[name].join(wide, F.col("query_id") == F.col("_q"))
        return hits.where(F.col("mode").isin(*modes) & (F.col("rank") <= F.col(most) * times)).select("query_id", "rank", "key")

    def cut(hits: DataFrame, most: str = "_wide") -> DataFrame:
        return hits.join(wide, F.col("query_id") == F.col("_q")).where(F.col("rank") <= F.col(most)).select("query_id", "rank", "key")

    out, deep = [], 4 * deepest
    if "semantic" in used:
        out.append(of("vectors", ("semantic",)))
    if "hybrid" in used:
        first = lambda name: of(name, ("hybrid",), 10**6).where(F.col("rank") <= HYBRID_DEPTH)
        out.append(cut(R.fuse([first("words"), first("vectors")], deep)))
    near = ("local", "mix")
    if used & set(near):
        local = written(cut(R.fuse([of("chunks", near, 2), of("vectors", near, 2)], deep)))
        out.append(_of_modes(local, wide, ("local",)))
    both = ("dual", "global", "mix")
    if used & set(both):
        relations = of("relations", both).withColumns({"src": F.element_at(F.split("key", "::"), 1), "dst": F.element_at(F.split("key", "::"), 2)})
        dual = written(cut(G.dual_level(of("entities", both), relations, edges, deep)))
        out.append(_of_modes(dual, wide, ("dual",)))
        if used & {"global", "mix"}:
            either = cut(R.fuse([of("relations", ("global", "mix")), of("chunks", ("global", "mix"))], deep))
            whole = R.or_else(_of_modes(dual, wide, ("global", "mix")), either)
            out.append(_of_modes(whole, wide, ("global",)))
            if "mix" in used:
                parts = [of("vectors", ("mix",)), _of_modes(local, wide, ("mix",)), _of_modes(whole, wide, ("mix",))]
                out.append(R.fuse(parts, deep).select("query_id", "rank", "key"))
    if not out:
        return plan.select("query_id", "mode", F.lit("").alias("key"), F.lit(0).alias("rank")).limit(0)
    hits = cut(reduce(DataFrame.unionByName, out), "depth")
    known = hits.join(facts.withColumn("key", F.col("key").cast("string")), "key", "left")
    told = known.join(plan.select("query_id", "mode", F.col("section").alias("_section"), "year_from", "year_to", "explicit"), "query_id")
    told = told.where(F.col("_section").isNull() | F.coalesce(F.col("section") == F.col("_section"), F.lit(False)))
    strict = R.keep_years(told.where("explicit"), F.col("year_from"), F.col("year_to"))
    kept = strict.unionByName(R.relaxed_years(told.where("NOT explicit")))
    return R.top_k(kept.withColumnRenamed("rank", "_at"), k, F.asc("_at"), F.asc("key")).select("query_id", "mode", "key", "rank")


def _of_modes(hits: DataFrame, wide: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    return hits.join(wide.where(F.col("mode").isin(*modes)).select("_q"), F.col("query_id") == F.col("_q"), "left_semi")
