"""What goes around a retrieval: modes from history, several questions of one task, last answers, costs, the cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def override_modes(queries: DataFrame, best: DataFrame) -> DataFrame:
    """queries (query_id, question_type, mode): the best mode of the question's type (question_type, mode), where one is
    known, instead of the chosen one; questions about times keep theirs."""
    known = best.select("question_type", F.col("mode").alias("_best"))
    return queries.join(known, "question_type", "left").withColumn("mode", F.when(F.col("question_type") == "temporal", F.col("mode")).otherwise(F.coalesce("_best", "mode"))).drop("_best")


def researched(questions: DataFrame, hits: DataFrame, usage: DataFrame) -> DataFrame:
    """One row a task of several questions: questions (parent_id, query_id, question), hits (query_id, rank, content,
    source), usage (query_id, prompt, completion). Each question has a section with its numbered hits; sources are listed
    once, in order of name; tokens are summed."""
    lines = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("h"), F.collect_set("source").alias("s"))
    used = usage.groupBy("query_id").agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"))
    rows = questions.join(lines, "query_id", "left").join(used, "query_id", "left")
    numbered = F.transform("h", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["content"]))
    section = F.concat(F.lit("## "), "question", F.lit("\n"), F.coalesce(F.array_join(numbered, "\n"), F.lit("")))
    done = rows.withColumn("section", section).groupBy("parent_id").agg(
        F.count("*").alias("n_questions"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("query_id", "section"))), lambda x: x["section"]), "\n\n").alias("context"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("s", F.array().cast("array<string>")))))).alias("sources"),
        F.coalesce(F.sum("prompt"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion"), F.lit(0)).alias("completion_tokens"),
    )
    return done.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def last_answers(messages: DataFrame, session: str = "session_id", answer_role: str = "assistant") -> DataFrame:
    """(session, answer): of each session's messages (session, pos, role, content) the last answer that isn't blank."""
    said = messages.where((F.col("role") == answer_role) & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    return said.groupBy(session).agg(F.max_by("content", "pos").alias("answer"))


def turn_blocks(messages: DataFrame, session: str = "session_id", ask_role: str = "user", labels: tuple[str, str] = ("用户", "助手")) -> DataFrame:
    """(session, history): a numbered block for each turn, which begins with each message of ask_role; lines are
    `label: content`, with the first label for ask_role and the second for others; blank messages are left out."""
    rows = messages.where(F.trim(F.coalesce("content", F.lit(""))) != "")
    label = F.when(F.col("role") == ask_role, labels[0]).otherwise(labels[1])
    rows = rows.select(session, F.struct("pos", (F.col("role") == ask_role).alias("asks"), F.concat(label, F.lit(": "), "content").alias("line")).alias("m"))
    said = rows.groupBy(session).agg(F.array_sort(F.collect_list("m")).alias("m"))

    def add(acc: Column, x: Column) -> Column:
        opens = x["asks"] | (acc["n"] == 0)
        n = acc["n"] + opens.cast("int")
        head = F.when(opens, F.concat(F.when(acc["n"] == 0, "").otherwise("\n\n"), F.lit("[第 "), n.cast("string"), F.lit(" 轮]"))).otherwise("")
        return F.struct(n.alias("n"), F.concat(acc["lines"], F.array(F.concat(head, F.lit("\n"), x["line"]))).alias("lines"))

    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("lines"))
    return said.select(session, F.aggregate("m", start, add, lambda acc: F.array_join(acc["lines"], "")).alias("history"))


def turn_dialogue(turns: DataFrame, messages: DataFrame, head: int = 250, tail: int = 150, labels: tuple[str, str] = ("用户", "助手")) -> DataFrame:
    """(session_id, dialogue): a numbered block for each of the turns (session_id, turn, user_input), in order, with the
    turn's last answer: of its messages (session_id, turn, pos, role, content, tool_calls) the last of an assistant that calls
    no tool and isn't blank. Longer answers keep their first `head` and last `tail` characters."""
    blank = " \t\r\n"
    said = messages.where(F.col("role").isin("assistant", "ai") & ~F.coalesce("tool_calls", F.lit(False)))
    said = said.withColumn("content", F.btrim(F.coalesce("content", F.lit("")), F.lit(blank))).where("content <> ''")
    last = said.groupBy("session_id", "turn").agg(F.max_by("content", "pos").alias("answer"))
    short = F.when(F.length("answer") <= head + tail, F.col("answer")).otherwise(F.concat(F.left("answer", F.lit(head)), F.lit("…"), F.right("answer", F.lit(tail))))
    rows = turns.join(last, ["session_id", "turn"], "left")
    line = F.concat(F.lit(f"{labels[0]}："), F.btrim(F.coalesce("user_input", F.lit("")), F.lit(blank)), F.coalesce(F.concat(F.lit(f"\n{labels[1]}："), short), F.lit("")))
    whole = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("t"))
    blocks = F.transform("t", lambda x, i: F.concat(F.lit("[第 "), (i + 1).cast("string"), F.lit(" 轮]\n"), x["line"]))
    return whole.select("session_id", F.array_join(blocks, "\n\n").alias("dialogue"))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, prompt, completion, total) with total, where it is null, as their sum, and cost by the models'
    prices a thousand tokens (model, prompt_price, completion_price); models without a price cost nothing."""
    rows = usage.withColumn("total", F.coalesce("total", F.coalesce("prompt", F.lit(0)) + F.coalesce("completion", F.lit(0))))
    cost = (F.coalesce("prompt", F.lit(0)) * F.coalesce("prompt_price", F.lit(0.0)) + F.coalesce("completion", F.lit(0)) * F.coalesce("completion_price", F.lit(0.0))) / 1000
    return rows.join(prices, "model", "left").withColumn("cost", cost).drop("prompt_price", "completion_price")


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache (file_path, cache_key, value) with the new values in place of those of the same key."""
    return cache.join(new.select("cache_key"), "cache_key", "left_anti").select(*cache.columns).unionByName(new)


def cache_invalidate(cache: DataFrame, paths: DataFrame) -> DataFrame:
    """The cache without what was read from the files (file_path)."""
    return cache.join(paths.select("file_path").distinct(), "file_path", "left_anti").select(*cache.columns)


def cache_hits(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (cache_key, ...) with value, null where the cache has none."""
    return asked.join(cache.select("cache_key", "value"), "cache_key", "left")


def statuses(rows: DataFrame, doc_id: Column | str | None = None, file_path: str | None = None, status: str | None = None) -> DataFrame:
    """The current status rows of an id, a path or a status; all, if none of them is given."""
    for column, value in (("doc_id", doc_id), ("file_path", file_path), ("status", status)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def label_unknown(pages: DataFrame, call, labels: tuple[str, ...], text_col: str = "text", section_col: str = "section") -> DataFrame:
    """Pages whose section is `unknown` get the label that `call` gives to their text, if it is one of `labels`; a call
    that fails, or any other answer, leaves them unknown."""
    from papyra.operators.hooks import apply_hook

    unknown = F.coalesce(F.col(section_col), F.lit("unknown")) == "unknown"
    asked = apply_hook(pages.where(unknown), call, [text_col], "_label", "string").drop("_label_error")
    label = F.lower(F.trim("_label"))
    asked = asked.withColumn(section_col, F.when(label.isin(*labels), label).otherwise("unknown")).drop("_label")
    return pages.where(~unknown).unionByName(asked)


def splits_by_section(docs: DataFrame, pages: str = "pages", sections: str = "sections") -> DataFrame:
    """Adds by_section: whether a document is chunked by sections, for which it must have as many as pages."""
    n = F.coalesce(F.size(pages), F.lit(0))
    return docs.withColumn("by_section", (n > 0) & (n == F.coalesce(F.size(sections), F.lit(0))))
