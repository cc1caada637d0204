"""Conversations, memories and usage as log tables."""

from __future__ import annotations

from collections import deque
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.operators.keyword_match import shared_words_top_k
from papyra.sources.batches import bound_batches, freed
from papyra.sources.scratch import written

# Retrieval modes, and how many samples a mode needs before it is recommended.
MODES = ("dual", "local", "global", "mix", "hybrid", "semantic")
LEAST_SAMPLES = 5


def session_meta(turns: DataFrame) -> DataFrame:
    """turns: (session_id, turn, user_input, tokens, cost). Title of the first turn, counts and sums."""
    return turns.groupBy("session_id").agg(
        F.substring(F.min_by("user_input", "turn"), 1, 30).alias("title"),
        F.min("turn").alias("first_turn"),
        F.max("turn").alias("last_turn"),
        F.count("*").alias("turn_count"),
        F.sum("tokens").alias("tokens"),
        F.round(F.sum("cost"), 6).alias("cost"),
    )


def uncovered(turns: DataFrame, summaries: DataFrame) -> DataFrame:
    """Turns that no summary (session_id, covers array) covers."""
    covered = summaries.select(F.col("session_id"), F.explode("covers").alias("turn"))
    return turns.join(covered, ["session_id", "turn"], "left_anti")


def restore(turns: DataFrame, summaries: DataFrame) -> DataFrame:
    """(session_id, pos, role, content): one system row of all summaries, numbered if there are several, then the
    uncovered turns' messages in order."""
    many = F.size("s") > 1
    lines = F.transform("s", lambda x, i: F.when(many, F.concat(F.lit("["), i + 1, F.lit("] ("), F.size(x["covers"]), F.lit(" turns) "), x["text"])).otherwise(x["text"]))
    merged = summaries.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text", "covers"))).alias("s"))
    system = merged.select("session_id", F.lit(0).cast("long").alias("pos"), F.lit("system").alias("role"), F.array_join(lines, "\n").alias("content"))
    order = Window.partitionBy("session_id").orderBy("turn")
    rest = uncovered(turns, summaries).select("session_id", F.row_number().over(order).cast("long").alias("pos"), "role", "content")
    return system.unionByName(rest)


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return turns.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def to_compact(turns: DataFrame, most_tokens: int = 8000, keep: int = 3) -> DataFrame:
    """Sessions with more than most_tokens tokens and more than `keep` turns: all turns but the last `keep`."""
    each = Window.partitionBy("session_id")
    rows = turns.withColumn("total", F.sum("tokens").over(each)).withColumn("back", F.row_number().over(each.orderBy(F.desc("turn"))))
    return rows.where((F.col("total") > most_tokens) & (F.col("back") > keep)).drop("back")


def compactions(turns: DataFrame, most_tokens: int = 8000, keep: int = 3, summary_tokens: int = 0) -> DataFrame:
    """(session_id, covers, total) for turns (session_id, turn, tokens, ts) in order of ts: each time a session's tokens pass
    most_tokens while more than `keep` (1 at least) turns are in no summary, all of these but the last `keep` are to be
    summarised; the tokens start anew with the turns kept and the summary's own."""
    turn = F.struct(F.col("ts"), F.col("turn").cast("long").alias("turn"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    whole = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    kind = "array<struct<turn:bigint,tokens:bigint>>"
    start = F.struct(F.array().cast(kind).alias("held"), F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<covers:array<bigint>,total:bigint>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        held = F.concat(acc["held"], F.array(F.struct(x["turn"].alias("turn"), x["tokens"].alias("tokens"))))
        total = acc["total"] + x["tokens"]
        due = (total > most_tokens) & (F.size(held) > keep)
        kept = F.slice(held, F.size(held) - (keep - 1), F.lit(keep))
        old = F.transform(F.slice(held, F.lit(1), F.size(held) - keep), lambda t: t["turn"])
        anew = F.aggregate(kept, F.lit(summary_tokens).cast("long"), lambda n, t: n + t["tokens"])
        out = F.concat(acc["out"], F.array(F.struct(old.alias("covers"), total.alias("total"))))
        return F.struct(F.when(due, kept).otherwise(held).alias("held"), F.when(due, anew).otherwise(total).alias("total"), F.when(due, out).otherwise(acc["out"]).alias("out"))

    found = whole.select("session_id", F.explode(F.aggregate("turns", start, add, lambda acc: acc["out"])).alias("c"))
    return found.select("session_id", "c.covers", "c.total")


def dialogue(turns: DataFrame) -> DataFrame:
    """One text a session: `role: content` lines in order."""
    line = F.concat("role", F.lit(": "), "content")
    rows = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return rows.select("session_id", F.array_join("l.line", "\n").alias("text"))


def pair_calls(events: DataFrame) -> DataFrame:
    """events: (session_id, tool, seq, kind), kind start or end. One row a start, first in first out: end_seq is the end
    that belongs to it, null while it runs. Ends without a running start are passed over: those that raise the running
    number of ends less starts above all it had been, and above 0."""
    key = Window.partitionBy("session_id", "tool").orderBy("seq")
    step = F.when(F.col("kind") == "end", 1).otherwise(-1)
    rows = events.where("kind IN ('start', 'end')").withColumn("_b", F.sum(step).over(key))
    most = F.greatest(F.lit(0), F.coalesce(F.max("_b").over(key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_orphan", (F.col("kind") == "end") & (F.col("_b") > most)).where("NOT _orphan")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("session_id", "tool", "kind").orderBy("seq")))
    ends = rows.where("kind = 'end'").select("session_id", "tool", "_n", F.col("seq").alias("end_seq"))
    return rows.where("kind = 'start'").join(ends, ["session_id", "tool", "_n"], "left").select("session_id", "tool", F.col("seq").alias("start_seq"), "end_seq")


def turn_records(events: DataFrame) -> DataFrame:
    """events: (session_id, turn, seq, delta, tool, usage). One row a turn: the deltas joined in order, how many tools
    there were, and the latest usage that isn't null."""
    parts = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("delta", F.lit("")).alias("d"))))
    rows = events.groupBy("session_id", "turn").agg(parts.alias("p"), F.count_distinct("tool").alias("n_tools"), F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("seq"))).alias("usage"))
    return rows.select("session_id", "turn", F.array_join("p.d", "").alias("text"), "n_tools", "usage")


def display_history(turns: DataFrame) -> DataFrame:
    """What a reader sees: the messages of user and assistant that aren't blank."""
    return turns.where(F.col("role").isin("user", "assistant") & (F.btrim("content", F.lit(" \t\r\n")) != ""))


def harvest(answers: DataFrame, memories: DataFrame) -> DataFrame:
    """Memories worth keeping, from a model's answers (answer_id, answer) about turns. An answer counts if it is a JSON
    object with should_save true, a title and a body; unknown types become preferences; the description is the
    answer's, else the body's first line. Of answers with one slug the first stays; what is a memory already goes."""
    from papyra.functions.text import extract_json, slug

    found = answers.select("answer_id", extract_json(F.col("answer")).alias("j"))
    field = lambda name: F.btrim(F.coalesce(F.get_json_object("j", f"$.{name}"), F.lit("")), F.lit(" \t\r\n"))
    rows = found.where(F.startswith("j", F.lit("{")) & (F.get_json_object("j", "$.should_save") == "true"))
    rows = rows.select("answer_id", *[field(n).alias(n) for n in ("title", "body", "type", "description")]).where("title <> '' AND body <> ''")
    line = F.substring(F.trim(F.element_at(F.split("body", "\n"), 1)), 1, 100)
    rows = rows.withColumn("type", F.when(F.col("type").isin("preference", "rule", "note"), F.col("type")).otherwise("preference"))
    rows = rows.withColumn("text", F.when(F.col("description") != "", F.col("description")).otherwise(line)).withColumn("slug", slug(F.col("title")))
    first = rows.groupBy("slug").agg(F.min_by(F.struct("answer_id", "title", "type", "text", "body"), "answer_id").alias("r")).select("slug", "r.*")
    return new_memories(first, memories)


def strategy_stats(log: DataFrame) -> DataFrame:
    """log: (question_type, mode, result_count, continued). Samples and successes."""
    success = (F.col("result_count") > 0) & F.col("continued")
    return log.groupBy("question_type", "mode").agg(F.count("*").alias("samples"), F.count_if(success).alias("successes"))


def best_mode(stats: DataFrame, least: int = LEAST_SAMPLES) -> DataFrame:
    rate = F.col("successes") / F.col("samples")
    order = Window.partitionBy("question_type").orderBy(F.desc(rate), "mode")
    rows = stats.where((F.col("samples") >= least) & F.col("mode").isin(*MODES)).withColumn("_n", F.row_number().over(order))
    return rows.where("_n = 1").select("question_type", "mode", F.round(rate, 9).alias("rate"))


def relevant_memories(memories: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """memories: (slug, question_type, text); queries: (query_id, question_type, text). Three points for the question's
    type, one for each shared word; the k best, ties to the smaller slug.

    Memories are compared where they lie; tasks hand on k a query."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("words")
    return shared_words_top_k(memories.select("slug", "question_type", words), queries.select("query_id", "question_type", words), k, "slug", "question_type", 3)


def _word_sets(rows: DataFrame, *kept: str) -> DataFrame:
    """The rows' ids with _type, their sorted distinct words w and a digest of both, _set; null texts are empty."""
    text = F.lower(F.coalesce("text", F.lit("")))
    words = F.array_sort(F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != "")))
    out = rows.select(*kept, F.col("type").alias("_type"), words.alias("w"))
    return out.withColumn("_set", F.sha2(F.concat(F.coalesce("_type", F.lit("")), F.lit("\n"), F.array_join("w", " ")), 256))


#: Words are counted in so many places, in tasks and in the driver.
WORD_PLACES = 1 << 18


def _coded(sets: list[DataFrame]) -> list[DataFrame]:
    """Written tables (_id, _set, _type, n, o, _few): the sets' words as numbers, from those that are rare in the last table
    to the frequent ones; _few of them come first that no set of it, or no other one, has. Words are counted by places of a
    hash, so that only WORD_PLACES counts go through the driver. The numbers are hashes with a seed under which no two words
    collide, so they stand for the words."""
    words, seed = reduce(DataFrame.union, [s.select(F.explode("w").alias("x")) for s in sets]), 0
    while not words.groupBy(F.xxhash64(F.lit(seed), "x").alias("h")).agg((F.min("x") == F.max("x")).alias("one")).where("NOT one").isEmpty():
        seed += 1
    hashed = [s.select("_set", "_type", F.transform("w", lambda x: F.xxhash64(F.lit(seed), x)).alias("o")) for s in sets]
    place = F.col("h").bitwiseAND(F.lit(WORD_PLACES - 1))
    counts = np.zeros(WORD_PLACES, np.int64)
    for r in hashed[-1].select(F.explode("o").alias("h")).groupBy(place.alias("p")).agg(F.count("*").alias("n")).collect():
        counts[r["p"]] = r["n"]
    shared = words.sparkSession.sparkContext.broadcast(counts)
    least = 1 if len(sets) == 1 else 0  # what no other set has

    def order(batches):
        for batch in batches:
            o = batch.column("o")
            lengths = pc.list_value_length(o).to_numpy(zero_copy_only=False)
            flat, row = o.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(o)), lengths)
            df = shared.value[flat & (WORD_PLACES - 1)]
            few = np.bincount(row, df <= least, len(o)).astype(np.int32)
            sorted_o = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(flat[np.lexsort((flat, df, row))]))
            yield pa.RecordBatch.from_arrays([batch.column("_set"), batch.column("_type"), sorted_o, pa.array(few)], ["_set", "_type", "o", "_few"])

    bound_batches(words.sparkSession)
    schema = "_set string, _type string, o array<long>, _few int"
    return [written(h.mapInArrow(freed(order), schema).select(F.monotonically_increasing_id().alias("_id"), "_set", "_type", F.size("o").alias("n"), "o", "_few")) for h in hashed]


def _similar_sets(left: DataFrame, right: DataFrame, threshold: float, own: bool = False) -> DataFrame:
    """(a, b): different sets (_set, _type, w) of one type that share more than the threshold of their words. With own,
    left is right, and each pair comes once.

    Words are ordered from rare to frequent; such a pair shares one of the first n - ceil(threshold * n) + 1 words of
    both. A meeting counts only if what can still follow the two places leaves the threshold in reach; that of the first
    shared word always does. Words that nothing else has never meet. Only ids and places meet; the words' numbers are
    joined to the pairs that are left."""
    coded = _coded([written(s.where("_type IS NOT NULL").select("_set", "_type", "w")) for s in ([right] if own else [left, right])])

    def beginnings(sets: DataFrame) -> DataFrame:
        first = F.slice("o", F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1)
        rows = sets.select("_id", "_type", "n", "_few", F.posexplode(first).alias("at", "h")).where("at >= _few")
        return rows.select("_id", "n", "at", F.xxhash64("_type", "h").alias("x"))

    a, b = beginnings(coded[0]).alias("a"), beginnings(coded[-1]).alias("b")
    need = (F.col("a.n") + F.col("b.n")) * (threshold / (1 + threshold))
    reach = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= need - 1e-6
    meets = (F.col("a.x") == F.col("b.x")) & reach & (F.col("a._id") < F.col("b._id") if own else F.lit(True))
    pairs = written(a.join(b, meets).select(F.col("a._id").alias("a"), F.col("b._id").alias("b")).distinct())
    of = lambda t, s: t.select(F.col("_id").alias(s), F.col("_set").alias(f"s{s}"), F.col("_type").alias(f"t{s}"), F.col("o").alias(f"o{s}"))
    pairs = pairs.join(of(coded[0], "a"), "a").join(of(coded[-1], "b"), "b")
    shared = F.size(F.array_intersect("oa", "ob"))
    pairs = pairs.where((F.col("ta") == F.col("tb")) & (shared > (F.size("oa") + F.size("ob") - shared) * threshold))
    return pairs.select(F.col("sa").alias("a"), F.col("sb").alias("b"))


def new_memories(candidates: DataFrame, memories: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Candidates (slug, title, type, text) that aren't memories yet: neither slug nor title is known, and no memory of
    the same type shares more than the threshold of its words."""
    left = candidates.join(memories.select("slug"), "slug", "left_anti").join(memories.select("title"), "title", "left_anti")
    mine = _word_sets(left, "slug").where("size(w) > 0")
    known = _word_sets(memories).where("size(w) > 0").dropDuplicates(["_set"])
    near = _similar_sets(mine.drop("slug").dropDuplicates(["_set"]), known, threshold).select(F.col("a").alias("_set")).distinct()
    return left.join(mine.select("slug", "_set").join(near, "_set").select("slug"), "slug", "left_anti")


def similar_memories(memories: DataFrame, id_col: str, threshold: float = 0.7) -> DataFrame:
    """memories: (id, type, text). One row each: class_id, the smallest id with the same type and set of words, and
    n_links, how many other rows of the type share more than the threshold of its words, copies among them.

    Copies collapse to one class first, and only classes are compared. Texts without words have no links. Null texts
    are empty; rows of null type are linked to their copies only."""
    rows = _word_sets(memories, F.col(id_col).alias("_id")).withColumn("_null", F.col("_type").isNull()).withColumn("_empty", F.size("w") == 0)
    classes = rows.groupBy("_set", "_null").agg(F.min("_id").alias("class_id"), F.count("*").alias("copies"))
    sets = rows.where("size(w) > 0 AND NOT _null").select("_set", "_type", "w").dropDuplicates(["_set"])
    pairs = _similar_sets(sets, sets, threshold, own=True)
    links = pairs.union(pairs.select("b", "a")).toDF("_set", "b").join(classes.where("NOT _null").select(F.col("_set").alias("b"), "copies"), "b")
    links = links.groupBy("_set").agg(F.sum("copies").alias("links")).withColumn("_null", F.lit(False))
    classes = classes.join(links, ["_set", "_null"], "left")
    n = F.when(F.col("_empty"), F.lit(0)).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    return rows.drop("w").join(classes, ["_set", "_null"]).select(F.col("_id").alias(id_col), "class_id", n.cast("long").alias("n_links"))


def _resets_before(calls: DataFrame, resets: DataFrame, on: list[str], name: str) -> DataFrame:
    """Adds how many resets there were up to each call, among those equal in `on`. Counts are summed by day; only the
    call's own day is looked at in detail."""
    day = F.to_date("ts").alias("_day")
    daily = resets.groupBy(*on, day).agg(F.collect_list("ts").alias("_times"))
    days = calls.select(*on, day).distinct().join(daily, [*on, "_day"], "full")
    before = Window.partitionBy(*on).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    n = F.when(F.col("_times").isNull(), 0).otherwise(F.size("_times"))
    days = days.withColumn("_before", F.coalesce(F.sum(n).over(before), F.lit(0)))
    rows = calls.withColumn("_day", F.to_date("ts")).join(days, [*on, "_day"], "left")
    today = F.coalesce(F.size(F.filter("_times", lambda t: t <= F.col("ts"))), F.lit(0))
    return rows.withColumn(name, F.col("_before") + F.when(F.col("_times").isNull(), 0).otherwise(today)).drop("_day", "_times", "_before")


def limit_calls_with_resets(calls: DataFrame, resets: DataFrame, most: int, window_s: float) -> DataFrame:
    """The limiter with resets (session_id, tool, ts): of one tool of a session, of a session where tool is null, of
    all where both are null. What was held before a reset doesn't count after it."""
    columns = calls.columns
    whole, session = F.col("session_id").isNull(), F.col("tool").isNull()
    rows = _resets_before(calls, resets.where(whole), [], "_all")
    rows = _resets_before(rows, resets.where(~whole & session), ["session_id"], "_session")
    rows = _resets_before(rows, resets.where(~whole & ~session), ["session_id", "tool"], "_tool")
    rows = rows.withColumn("_epoch", (F.col("_all") + F.col("_session") + F.col("_tool")).cast("long"))
    return limit_calls(rows.select(*columns, "_epoch"), most, window_s, "_epoch").drop("_epoch")


def limit_calls(calls: DataFrame, most: int, window_s: float, epoch: str | None = None) -> DataFrame:
    """Adds allowed to calls (session_id, tool, ts, event_id): at most `most` allowed calls of a session and tool in any
    window; denied calls don't count. Each key's calls are gone through in order, with `most` times held. A change of
    the epoch column, if there is one, lets go of them."""
    columns = calls.columns

    def run(batches):
        key, held = None, deque()
        for pdf in batches:
            allowed = []
            epochs = pdf[epoch] if epoch else [0] * len(pdf)
            for session, tool, at, ts in zip(pdf["session_id"], pdf["tool"], epochs, pdf["ts"].astype("datetime64[us]").astype("int64"), strict=True):
                if (session, tool, at) != key:
                    key, held = (session, tool, at), deque()
                while held and ts - held[0] > window_s * 1e6:
                    held.popleft()
                allowed.append(len(held) < most)
                if allowed[-1]:
                    held.append(ts)
            yield pdf.assign(allowed=pd.Series(allowed, index=pdf.index, dtype=bool))

    ordered = calls.repartition("session_id", "tool").sortWithinPartitions("session_id", "tool", "ts", "event_id")
    schema = ", ".join(f"`{c}` {t}" for c, t in calls.dtypes) + ", allowed boolean"
    return ordered.select(*columns).mapInPandas(run, schema)
