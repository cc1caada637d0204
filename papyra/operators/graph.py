"""Graph queries and analytics over node and edge DataFrames.

nodes: (id, label, name, ...); edges: (src, dst, type, ...); relations between entities: (src, dst).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from papyra.operators.keyword_match import containing, group_top_k, keyword_top_k, with_words  # noqa: F401
from papyra.sources.scratch import written

# The order in which labels are shown.
LABEL_ORDER = {"Document": 0, "Entity": 1, "Community": 2, "Reference": 3}


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): totals (name null) and counts by label and by type, in one pass over each table."""
    of_nodes = nodes.rollup("label").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.col("label").alias("name"), "n")
    of_edges = edges.rollup("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("type").alias("name"), "n")
    return of_nodes.unionByName(of_edges)


def display_name(*columns: str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def subgraph(nodes: DataFrame, edges: DataFrame, limit: int, labels: list[str] | None = None, search: str = "") -> tuple[DataFrame, DataFrame]:
    """At most `limit` (1 to 500) nodes of the labels whose name has the search text, in whatever case, by label and
    name; and the distinct edges between them."""
    kept = nodes.where(F.col("label").isin(*labels)) if labels else nodes
    if search:
        kept = kept.where(F.contains(F.lower("name"), F.lit(search.lower())))
    place = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in LABEL_ORDER.items()], F.lit(9))
    kept = kept.orderBy(place, "name", "id").limit(max(1, min(limit, 500)))
    ids = kept.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, inside.select("src", "dst", "type").distinct()


def entity_search(nodes: DataFrame, edges: DataFrame, search: str, relation_type: str | None = None, n_nodes: int = 10, n_relations: int = 15, within: int = 50) -> DataFrame:
    """(kind, a, b): ids and names of the first nodes of the subgraph, then the ends of its first relations."""
    kept, inside = subgraph(nodes, edges, within, ["Entity"], search)
    if relation_type:
        inside = inside.where(F.col("type") == relation_type)
    named = kept.orderBy("name", "id").limit(n_nodes).select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("name").alias("b"))
    ends = inside.orderBy("src", "dst", "type").limit(n_relations).select(F.lit("relation").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))
    return named.union(ends)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def one_hop(edges: DataFrame, seeds: DataFrame, limit: int = 50) -> DataFrame:
    """seeds: (query_id, id). Each query's neighbours in either direction that aren't seeds of it, the first by id.

    Edges meet the seeds where they lie, once by either end: seeds are written first, so Spark knows their size and
    broadcasts them if they are few; only neighbours of seeds are dealt out and made distinct."""
    seeds = written(seeds.select("query_id", "id").distinct())
    of_src = edges.join(seeds, F.col("src") == F.col("id")).select("query_id", F.col("dst").alias("near"))
    of_dst = edges.join(seeds, F.col("dst") == F.col("id")).select("query_id", F.col("src").alias("near"))
    mine = seeds.select(F.col("query_id").alias("_q"), F.col("id").alias("_id"))
    near = of_src.unionByName(of_dst).join(mine, (F.col("query_id") == F.col("_q")) & (F.col("near") == F.col("_id")), "left_anti")
    order = Window.partitionBy("query_id").orderBy("near")
    return near.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def undirected(edges: DataFrame) -> DataFrame:
    """One row for each pair of different nodes that an edge joins."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


#: Edges of a part of the nodes; beyond so many tries with fewer nodes a level ends.
PART_EDGES, LEAST_SHARE = 4_000_000, 64
#: Passes over the nodes of a part.
PASSES = 30


def local_moves(src, dst, w, c_src, k_src, c_dst, tot_src, tot_dst, whole: float) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, communities) of the nodes src after greedy moves, one node at a time in order of id, until no node gains.
    Nodes that are only dst stay where they are; communities' degrees follow the moves."""
    order = np.argsort(src, kind="stable")
    src, dst, w, c_dst = src[order], dst[order], w[order], c_dst[order]
    nodes, first = np.unique(src, return_index=True)
    names = np.unique(np.concatenate([c_src, c_dst]))
    total = np.zeros(len(names))
    total[np.searchsorted(names, c_src)], total[np.searchsorted(names, c_dst)] = tot_src, tot_dst[order]
    own, degree = np.searchsorted(names, c_src[order][first]), k_src[order][first]
    loops = src == dst
    at = np.searchsorted(nodes, dst)
    at = np.where(nodes[np.minimum(at, len(nodes) - 1)] == dst, at, -1)  # -1: a node of another part
    frozen, w = np.searchsorted(names, c_dst), np.where(loops, 0.0, w)
    ends = np.append(first[1:], len(src))
    for _ in range(PASSES):
        moved = False
        for n in range(len(nodes)):
            part = slice(first[n], ends[n])
            near = np.where(at[part] >= 0, own[at[part]], frozen[part])
            here, k = own[n], degree[n]
            to, which = np.unique(np.append(near, here), return_inverse=True)
            gain = np.bincount(which, np.append(w[part], 0.0)) - k * (total[to] - np.where(to == here, k, 0.0)) / whole
            best = int(np.argmax(np.round(gain, 9)))  # the first of equal ones is the smallest community
            if to[best] != here and gain[best] > gain[np.searchsorted(to, here)] + 1e-9:
                total[here] -= k
                total[to[best]] += k
                own[n], moved = to[best], True
        if not moved:
            break
    return nodes, names[own]


def _score(weighted: DataFrame, place: DataFrame, whole: float) -> float:
    """Modularity times whole squared."""
    ends = weighted.join(place.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(place.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst")
    inside = ends.agg(F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")))).first()[0] or 0.0
    squares = place.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
    return whole * inside - squares


def _round(weighted: DataFrame, place: DataFrame, whole: float, parts: int, seed: int, share: int) -> DataFrame:
    """place after one round: nodes are dealt into parts by a hash that changes with the round; each part moves its own
    nodes, those of other parts stay as they are. With a share, only one node in so many may move."""
    total = place.groupBy("c").agg(F.sum("k").alias("tot"))
    full = place.join(total, "c")
    of_src = full.select(F.col("id").alias("src"), F.col("c").alias("c_src"), F.col("k").alias("k_src"), F.col("tot").alias("tot_src"))
    of_dst = full.select(F.col("id").alias("dst"), F.col("c").alias("c_dst"), F.col("tot").alias("tot_dst"))
    rows = weighted.join(of_src, "src").join(of_dst, "dst").withColumn("_part", F.pmod(F.xxhash64("src", F.lit(seed)), F.lit(parts)))
    if share > 1:
        rows = rows.where(F.pmod(F.xxhash64("src", F.lit(seed + 1)), F.lit(share)) == 0)
    columns = ("src", "dst", "w", "c_src", "k_src", "c_dst", "tot_src", "tot_dst")
    kind = to_arrow_type(place.schema["id"].dataType)

    def move(table: pa.Table) -> pa.Table:
        nodes, to = local_moves(*(table.column(c).to_numpy() for c in columns), whole)
        return pa.table([pa.array(nodes, kind), pa.array(to, kind)], names=["id", "to"])

    schema = T.StructType([place.schema["id"], T.StructField("to", place.schema["id"].dataType)])
    moves = rows.groupBy("_part").applyInArrow(move, schema)
    return place.join(moves, "id", "left").select("id", F.coalesce("to", "c").alias("c"), "k")


def _settled(weighted: DataFrame, whole: float, rounds: int | None, cut) -> DataFrame | None:
    """(id, c) when rounds gain no more, or after `rounds` that were kept; None if no node has moved."""
    place = cut(weighted.groupBy(F.col("src").alias("id")).agg(F.first("src").alias("c"), F.sum("w").alias("k")))
    parts = max(1, -(-weighted.count() // PART_EDGES))
    score, kept, share, seed = _score(weighted, place, whole), 0, 1, 0
    while (rounds is None or kept < rounds) and share <= LEAST_SHARE:
        seed += 1
        tried = cut(_round(weighted, place, whole, parts, seed, share))
        new = _score(weighted, tried, whole)
        if new > score * (1 + 1e-12):
            place, score, kept, share = tried, new, kept + 1, max(1, share // 2)
            if parts == 1 and share == 1:
                break  # all nodes were in one part, and none gains any more
        else:
            share = share * 4 if parts > 1 else LEAST_SHARE + 1
    return place.select("id", "c") if kept else None


def louvain(pairs: DataFrame, rounds: int | None = None, levels: int | None = None, cut=None) -> DataFrame:
    """(id, community) of the nodes of pairs (a, b), by greedy modularity gains, then on the graph of communities, level by
    level, until no node gains; `rounds` (in a level) and `levels` may be bounded.

    In a round nodes are dealt by hash into parts of PART_EDGES edges or so, with their neighbours' communities and these
    communities' degrees. A part moves its nodes one after another, each to the community that it gains most by: joining c
    gains w(node, c) - degree(node) * degree(c) / 2m, degree(c) without the node itself; of equal gains the smallest community
    wins. Nodes of other parts stay as they are meanwhile, so a round is kept only if the modularity of the whole has risen;
    else the next one lets fewer nodes move. Then communities become nodes. The community's id is its smallest node.
    """
    cut = cut or written
    weighted = cut(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w")).union(pairs.select("b", "a", F.lit(1.0))))
    whole = weighted.agg(F.sum("w")).first()[0]
    members = cut(weighted.select("src").distinct().select(F.col("src").alias("id"), F.col("src").alias("community")))
    if not whole:
        return members
    level = 0
    while levels is None or level < levels:
        place = _settled(weighted, whole, rounds, cut)
        if place is None:
            break
        level += 1
        name = place.groupBy("c").agg(F.min("id").alias("named"))
        place = cut(place.join(name, "c").select("id", F.col("named").alias("to")))
        members = cut(members.join(place, F.col("community") == place["id"]).select(members["id"], F.col("to").alias("community")))
        ends = weighted.join(place.select(F.col("id").alias("src"), F.col("to").alias("s")), "src").join(place.select(F.col("id").alias("dst"), F.col("to").alias("t")), "dst")
        weighted = cut(ends.groupBy(F.col("s").alias("src"), F.col("t").alias("dst")).agg(F.sum("w").alias("w")))
    return members


def modularity(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row: the partition's modularity."""
    ends = pairs.join(members.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(members.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    m = ends.agg(F.count("*").alias("m"))
    inside = ends.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.count("*").alias("e"))
    degree = ends.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count("*").alias("k"))
    each = degree.join(inside, "c", "left").crossJoin(F.broadcast(m))  # m is one row
    return each.agg(F.sum(F.coalesce("e", F.lit(0)) / F.col("m") - F.pow(F.col("k") / (2 * F.col("m")), F.lit(2))).alias("modularity"))


def community_table(members: DataFrame, entities: DataFrame, least: int = 3) -> DataFrame:
    """(community_id, label, entity_count, summary) of the communities with `least` members at least; the summary is
    the members' lines `- name: description`, by name."""
    line = F.concat(F.lit("- "), F.col("name"), F.when(F.coalesce("description", F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(": "), F.col("description"))))
    rows = members.join(entities, "id").groupBy("community").agg(F.count("*").alias("entity_count"), F.array_sort(F.collect_list(F.struct("name", line.alias("line")))).alias("l"))
    return rows.where(F.col("entity_count") >= least).select(F.concat(F.lit("community-"), F.col("community")).alias("community_id"), F.col("community").alias("label"), "entity_count", F.array_join("l.line", "\n").alias("summary"))


def with_perspective(contexts: DataFrame, communities: DataFrame, most: int = 5) -> DataFrame:
    """contexts (query_id, context) with lines of the largest communities (community_id, entity_count) before them."""
    first = communities.orderBy(F.desc("entity_count"), "community_id").limit(most)
    order = F.array_sort(F.collect_list(F.struct((-F.col("entity_count")).alias("n"), F.col("community_id").alias("id"))))
    lines = F.transform(order, lambda c: F.concat(F.lit("- "), c["id"], F.lit(" ("), -c["n"], F.lit(")")))
    head = first.agg(F.array_join(lines, "\n").alias("_head"))
    text = F.when(F.col("_head") != "", F.concat("_head", F.lit("\n\n"), "context")).otherwise(F.col("context"))
    return contexts.crossJoin(F.broadcast(head)).withColumn("context", text).drop("_head")  # one row


def chunk_hits(keywords: DataFrame, entities: DataFrame, mentions: DataFrame, k: int) -> DataFrame:
    """keywords: (query_id, keyword); entities: (entity_id, name); mentions: (chunk_id, entity_id), each once.

    (query_id, rank, chunk_id, hits): each query's k chunks that mention the most entities whose name has one of its
    keywords, in whatever case."""
    found = with_words(entities, "name", keywords, "entity_id")
    members = mentions.join(found, "entity_id").select(F.col("chunk_id").alias("group_id"), "words")
    return group_top_k(members, keywords, k).select("query_id", "rank", F.col("group_id").alias("chunk_id"), F.col("score").alias("hits"))


def matching_chunks(keywords: DataFrame, entities: DataFrame, mentions: DataFrame, k: int, years: DataFrame | None = None) -> DataFrame:
    """chunk_hits with the names and ids of the entities met (each once, sorted, joined by |) and, given years (chunk_id,
    year), the chunk's year."""
    hits = written(chunk_hits(keywords, entities, mentions, k))  # k rows a query, so that Spark knows how few they are
    asked = keywords.select("query_id", F.lower("keyword").alias("_kw")).distinct()
    near = mentions.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").join(entities.select("entity_id", "name"), "entity_id")
    tags = with_words(near.select("entity_id", "name").distinct(), "name", keywords, "entity_id")
    met = hits.join(near, "chunk_id").join(tags, "entity_id").withColumn("_kw", F.explode("words")).join(asked, ["query_id", "_kw"], "left_semi")
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), "|")
    told = met.groupBy("query_id", "chunk_id").agg(listed("name").alias("names"), listed("entity_id").alias("entity_ids"))
    out = hits.join(told, ["query_id", "chunk_id"])
    if years is not None:
        of_chunk = years.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.max("year").alias("year"))
        out = out.join(of_chunk, "chunk_id", "left")
    return out


def matching_relations(keywords: DataFrame, relations: DataFrame, k: int, most: int = 8, mentions: DataFrame | None = None, years: DataFrame | None = None) -> DataFrame:
    """keywords: (query_id, pos, keyword). Each query's k relations (src, dst, type, description) by the number of its
    first `most` keywords that their description has: (query_id, rank, score, ...). Given mentions (chunk_id, entity_id)
    and years (chunk_id, year), year is the latest of the chunks that mention src."""
    hits = keyword_top_k(relations, "description", keywords.where(F.col("pos") < most), k, ["src", "dst", "type"])
    if mentions is None or years is None:
        return hits
    hits = written(hits)
    about = mentions.join(hits.select(F.col("src").alias("entity_id")).distinct(), "entity_id", "left_semi")
    latest = about.join(years, "chunk_id").groupBy(F.col("entity_id").alias("src")).agg(F.max("year").alias("year"))
    return hits.join(latest, "src", "left")


def named_hits(keywords: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, key, score): the first k entities (key, name) by key whose name has one of a query's keywords."""
    return keyword_top_k(entities.select("key", "name"), "name", keywords, k, ["key"], count=False).select("query_id", "rank", "key", "score")


def unsupported_relations(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """Relations with no chunk that mentions both ends: an anti-join with the pairs that relations ask for."""
    ends = relations.select("src", "dst").distinct()
    of_src = ends.join(mentions.select(F.col("entity_id").alias("src"), "chunk_id"), "src")
    together = of_src.join(mentions.select(F.col("entity_id").alias("dst"), "chunk_id"), ["dst", "chunk_id"]).select("src", "dst").distinct()
    return relations.join(together, ["src", "dst"], "left_anti")


#: Chunks with more mentions than this give no pairs; relations are looked up in them.
PAIRED = 64


def lost_support(relations: DataFrame, mentions: DataFrame, gone: DataFrame) -> tuple[int, DataFrame, DataFrame]:
    """What the chunks in gone (chunk_id) alone support: how many mentions (chunk_id, entity_id) they have, the distinct
    (src, dst) of the relations that they, but no other chunk, mention both ends of, and the entities (entity_id) that
    nothing else mentions.

    Mentions are dealt by chunk once and written as arrays of at most PAIRED entities. A chunk's own pairs are counted by
    relation, so work grows with the mentions, not with relations x mentions of an end; larger chunks, whose pairs would
    grow with the square, are met from the relations' side."""
    marked = mentions.select("chunk_id", "entity_id").join(gone.select("chunk_id").distinct().withColumn("_gone", F.lit(True)), "chunk_id", "left")
    own = Window.partitionBy("chunk_id")
    block = F.floor((F.row_number().over(own.orderBy("entity_id")) - 1) / PAIRED).alias("_block")
    rows = marked.select("chunk_id", "entity_id", F.coalesce("_gone", F.lit(False)).alias("gone"), F.count("*").over(own).alias("_n"), block)
    rows = rows.groupBy("chunk_id", "_block").agg(F.first("gone").alias("gone"), F.first("_n").alias("_n"), F.count("*").alias("n"), F.collect_list("entity_id").alias("e"))
    large = F.col("_n") > PAIRED
    dealt = written(rows.select(F.when(large, F.col("chunk_id")).alias("chunk_id"), (F.col("chunk_id").isNotNull() & ~large).alias("paired"), "gone", "n", "e"))
    mark = F.when(F.col("gone"), 1).otherwise(2).alias("by")  # 1: a chunk that goes, 2: one that stays
    pairs = dealt.where("paired").select("e", mark).select("e", "by", F.explode("e").alias("src")).select("src", F.explode("e").alias("dst"), "by").where("src <> dst")
    ends = relations.select("src", "dst").distinct()
    loops = ends.where("src = dst")
    if not loops.isEmpty():
        pairs = pairs.unionByName(dealt.where("paired").select(F.explode("e").alias("src"), mark).join(loops.select("src"), "src", "left_semi").select("src", F.col("src").alias("dst"), "by"))
    big = dealt.where("chunk_id IS NOT NULL").select("chunk_id", F.explode("e").alias("entity_id"), mark)
    if not big.isEmpty():
        of_src = ends.join(big.select(F.col("entity_id").alias("src"), "chunk_id", "by"), "src")
        pairs = pairs.unionByName(of_src.join(big.select(F.col("entity_id").alias("dst"), "chunk_id"), ["dst", "chunk_id"]).select("src", "dst", "by"))
    only_gone = pairs.groupBy("src", "dst").agg(F.bit_or("by").alias("by")).where("by = 1").drop("by")
    dead = written(ends.join(only_gone, ["src", "dst"], "left_semi"))
    met = dealt.select(F.explode("e").alias("entity_id"), mark).groupBy("entity_id").agg(F.bit_or("by").alias("by"))
    n = dealt.where("gone").agg(F.sum("n")).first()[0] or 0
    return n, dead, written(met.where("by = 1 AND entity_id IS NOT NULL").select("entity_id"))


def entity_cards(entities: DataFrame, edges: DataFrame, hits: DataFrame, names: int = 10) -> DataFrame:
    """Hits (query_id, rank, key) on entities (entity_id, name, description) as cards with their first neighbours' names."""
    near = both_ways(edges).join(entities.select(F.col("entity_id").alias("dst"), F.col("name").alias("near")), "dst").select("src", "near").distinct()
    order = Window.partitionBy("src").orderBy("near")
    near = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= names).groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("near")), ", ").alias("near"))
    rows = hits.join(entities, hits["key"] == entities["entity_id"]).join(near, F.col("entity_id") == F.col("src"), "left")
    card = F.concat("name", F.lit(": "), "description", F.when(F.col("near").isNotNull(), F.concat(F.lit(" [related: "), "near", F.lit("]"))).otherwise(""))
    return rows.select("query_id", "rank", "key", card.alias("content"))


def dual_level(entity_hits: DataFrame, relation_hits: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(query_id, key, list_no, rank): entities found by name, then relations (keys `a::b`), then the neighbours of the
    ends of both; each key once, the first list that has it wins; cut to k."""
    from papyra.operators.retrieval import first_wins

    low = entity_hits.select("query_id", "rank", F.col("key").cast("string").alias("key"))
    high = relation_hits.select("query_id", "rank", F.concat_ws("::", "src", "dst").alias("key"))
    seeds = low.union(high).select("query_id", F.explode(F.filter(F.split("key", "::"), lambda x: x != "")).alias("id")).select("query_id", F.col("id").cast("long").alias("id")).distinct()
    wide = one_hop(edges, seeds).select("query_id", "rank", F.col("near").cast("string").alias("key"))
    return first_wins([low, high, wide], k, "key").select("query_id", "key", "list_no", "rank")
