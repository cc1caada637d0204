"""A library of documents with its eight entry points. Each takes a table of requests and answers all of them in one plan;
models are functions of the caller, and their answers columns.

`Library` holds the tables; an entry point reads only those that it needs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import text as X
from papyra.operators import graph as G
from papyra.operators import maintenance as M
from papyra.operators import router
from papyra.operators.hooks import complete
from papyra.operators.keyword_match import containing, keyword_top_k
from papyra.operators.questions import researched
from papyra.sources.scratch import written

SEARCHED = ("title", "authors", "abstract", "keywords")
MEMORY_TYPES = ("preference", "rule", "note")
#: Nodes that an entity search looks at, nodes and relations that it tells.
WITHIN, N_NODES, N_RELATIONS = 50, 10, 15


@dataclass
class Library:
    """papers (doc_id, title, authors, abstract, keywords); contents (key, source, content, section, year) of all that retrieval finds;
    nodes (id, label, name); edges (src, dst, type); communities (community_id, entity_count); finders: the router's lists;
    best (question_type, mode): the modes that did best before."""

    papers: DataFrame | None = None
    contents: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    communities: DataFrame | None = None
    finders: dict[str, router.Finder] = field(default_factory=dict)
    best: DataFrame | None = None
    as_of_year: int = 2024

    def _hits(self, questions: DataFrame, k: int) -> DataFrame:
        """(query_id, mode, rank, key, source, content)."""
        plan = router.planned(questions, self.best, self.as_of_year, k)
        found = router.answered(plan, self.finders, self.edges, self.contents.select("key", "section", "year"), k)
        texts = self.contents.select(F.col("key").cast("string").alias("key"), "source", "content")
        return found.join(texts, "key", "left")

    def retrieve_knowledge(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """questions as router.planned takes them. (query_id, mode, context, sources): numbered contents with their sources;
        sources are told once, in order. Questions without hits have no row."""
        line = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.coalesce("source", "key"), F.lit("\n"), F.coalesce("content", F.lit("")))
        rows = self._hits(questions, k).withColumn("_l", F.struct("rank", line.alias("line"), F.coalesce("source", "key").alias("source")))
        whole = rows.groupBy("query_id", "mode").agg(F.array_sort(F.collect_list("_l")).alias("l"))
        return whole.select("query_id", "mode", F.array_join("l.line", "\n\n").alias("context"), F.array_distinct("l.source").alias("sources"))

    def deep_research(self, questions: DataFrame, k: int = 5, use_community: bool = False) -> DataFrame:
        """questions as for retrieve_knowledge with parent_id: the sub-questions of one task. (parent_id, n_questions, context,
        sources): a section for each sub-question, with the largest communities before all if asked for."""
        hits = self._hits(questions, k).select("query_id", "rank", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("source", "key").alias("source"))
        asked = questions.select("parent_id", "query_id", F.col("text").alias("question"))
        none = asked.select("query_id", F.lit(0).alias("prompt"), F.lit(0).alias("completion"))
        told = researched(asked, hits, none).select("parent_id", "n_questions", "context", "sources")
        if not use_community:
            return told
        led = G.with_perspective(told.withColumnRenamed("parent_id", "query_id"), self.communities)
        return led.withColumnRenamed("query_id", "parent_id")

    def list_documents(self, asked: DataFrame) -> DataFrame:
        """asked: (query_id, keyword, most). (query_id, total, listed): how many papers have the keyword in a field, in whatever
        case (all for a blank one), and the first `most` by id."""
        blank = F.trim(F.coalesce("keyword", F.lit(""))) == ""
        fields = self.papers.select("doc_id", F.explode(F.array(*[F.coalesce(c, F.lit("")) for c in SEARCHED])).alias("field"))
        words = asked.where(~blank).select("query_id", F.trim("keyword").alias("keyword"))
        met = containing(fields, "field", words).select("query_id", "doc_id").distinct()
        counted = met.groupBy("query_id").agg(F.count("*").alias("total"))
        place = Window.partitionBy("query_id").orderBy("doc_id")
        first = met.withColumn("_n", F.row_number().over(place)).join(asked.select("query_id", "most"), "query_id").where(F.col("_n") <= F.col("most"))
        named = first.join(self.papers.select("doc_id", "title"), "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "title"))).alias("listed"))
        found = counted.join(named, "query_id", "left")
        whole = self.papers.agg(F.count("*").alias("total"))  # one row
        longest = asked.where(blank).agg(F.max("most")).first()[0] or 0
        top = self.papers.orderBy("doc_id").limit(longest).agg(F.array_sort(F.collect_list(F.struct("doc_id", "title"))).alias("_all"))  # one row
        blanks = asked.where(blank).crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(top)).select("query_id", "total", F.slice("_all", F.lit(1), F.col("most")).alias("listed"))
        return asked.select("query_id").join(found.unionByName(blanks), "query_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))

    def get_document_metadata(self, asked: DataFrame) -> DataFrame:
        """asked: (query_id, q). The paper of the id q, else the first whose title has it, and how many others match."""
        return M.lookup(self.papers, asked)

    def search_by_entity(self, asked: DataFrame) -> DataFrame:
        """asked: (query_id, entity_name, relation_type). (query_id, kind, a, b): ids and names of the first entities whose name
        has the text, and the ends of the first relations between these, of the type if one is given."""
        names = asked.select("query_id", F.col("entity_name").alias("keyword"))
        entities = self.nodes.where("label = 'Entity'").select("id", "name")
        top = written(keyword_top_k(entities, "name", names, WITHIN, ["name", "id"], count=False).select("query_id", "rank", "id", "name"))
        nodes = top.where(F.col("rank") <= N_NODES).select("query_id", F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("name").alias("b"))
        of = lambda side: top.select("query_id", F.col("id").alias(side))
        inside = self.edges.select("src", "dst", "type").join(of("src"), "src").join(of("dst"), ["query_id", "dst"])
        kind = F.nullif(F.trim(F.coalesce("relation_type", F.lit(""))), F.lit(""))
        inside = inside.join(asked.select("query_id", kind.alias("_type")), "query_id").where(F.col("_type").isNull() | (F.col("type") == F.col("_type"))).select("query_id", "src", "dst", "type").distinct()
        order = Window.partitionBy("query_id").orderBy("src", "dst", "type")
        ends = inside.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= N_RELATIONS).select("query_id", F.lit("relation").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))
        return nodes.unionByName(ends)

    def get_knowledge_graph_stats(self) -> DataFrame:
        """(kind, name, n): nodes by label and edges by type, with totals."""
        return G.stats(self.nodes, self.edges)

    @staticmethod
    def save_user_memory(new: DataFrame) -> DataFrame:
        """new: (title, body, type). The memories (slug, title, type, description, text) to keep: other types become
        preferences, the description is the body's first line, else the title; of equal slugs the one with the smallest
        body stays, and those without a title or a body are left out."""
        body = F.btrim(F.coalesce("body", F.lit("")), F.lit(" \t\r\n"))
        line = F.left(F.element_at(F.split(body, "\n"), 1), F.lit(100))
        kind = F.when(F.lower("type").isin(*MEMORY_TYPES), F.lower("type")).otherwise("preference")
        rows = new.where((F.trim(F.coalesce("title", F.lit(""))) != "") & (body != ""))
        rows = rows.select(X.slug(F.col("title")).alias("slug"), "title", kind.alias("type"), F.coalesce(F.nullif(line, F.lit("")), "title").alias("description"), body.alias("text"))
        return rows.groupBy("slug").agg(F.min(F.struct("text", "title", "type", "description")).alias("m")).select("slug", "m.title", "m.type", "m.description", "m.text")

    @staticmethod
    def generate_research_ideas(topics: DataFrame, call: Callable[[list[tuple]], list]) -> DataFrame:
        """topics: (query_id, topic, research_report). (query_id, report, error): a model's ideas as one Markdown report; a
        call that fails has its error."""
        prompt = F.concat_ws("\n\n", F.col("topic"), F.nullif(F.trim(F.coalesce("research_report", F.lit(""))), F.lit("")))
        told = complete(topics.select("query_id", prompt.alias("prompt")), "prompt", call)
        report = F.when(F.col("answer").isNotNull(), X.report_markdown(F.col("r")))
        return told.withColumn("r", X.report_fields(F.col("answer"))).select("query_id", report.alias("report"), F.col("answer_error").alias("error"))
