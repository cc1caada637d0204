"""Chat formatting: conversations merged into prefix trees, shared turns emitted once, depth first.

A turn is a user's (or any other role's) `<s>[INST] role\\ntext [/INST]` or an assistant's `text</s>`. Control strings
inside roles and texts get a backslash after their first character; those that have backslashes there get one more,
so unescaping gives the text back whatever it holds.

Conversations are sorted by their paths, the hashes of their turns, then by id: this is the depth-first order of
the prefix trees. In this order a conversation shares with the one before it the turns that both begin with (turns
are compared by a 128-bit digest) and adds the rest, its own nodes. Only the first conversations of a partition
depend on what came before it, so a first pass gathers for each partition the path at its ends, and the second
emits. No tree is ever in one task, however many conversations share its first turn.

A token here is a code point of the formatted text. Each node has its first token's place in its tree's packed
sequence, the position id of that token (its depth in the conversation) and the intervals of the packed sequence
that its tokens attend to besides their own earlier ones: its ancestors', merged where they touch.

Null roles and texts are empty; other roles than assistant aren't under the loss. Turns of a conversation are
ordered by turn, role and text; repeated rows are turns of their own. A null conv_id is a conversation. A table
without rows gives none. A conversation is one sample and is held by one task.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from papyra.llm.common import bound_batches, cut

ASSISTANT = "assistant"
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def format_turn(role: Column, text: Column) -> Column:
    one_line = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    other = F.concat(F.lit("<s>[INST] "), escape(one_line), F.lit("\n"), escape(text), F.lit(" [/INST]"))
    return F.when(role == ASSISTANT, F.concat(escape(text), F.lit("</s>"))).otherwise(other)


INTERVALS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
NODES = T.ArrayType(
    T.StructType(
        [
            T.StructField("packed_start", T.LongType()),
            T.StructField("position", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("loss_start", T.LongType()),
            T.StructField("loss_end", T.LongType()),
            T.StructField("attends", INTERVALS),
        ]
    )
)
PACKED = [T.StructField("tree", T.StringType()), T.StructField("path", T.ArrayType(T.LongType())), T.StructField("nodes", NODES)]


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


class Packer:
    """Goes through conversations in depth-first order. State: the last path, its nodes' places, the tree's length."""

    def __init__(self, state: dict | None = None):
        state = state or {}
        self.path: list = list(state.get("path", []))
        self.places: list[tuple[int, int]] = [tuple(x) for x in state.get("places", [])]
        self.length: int = state.get("length", 0)
        self.tree: str | None = state.get("tree")

    def add(self, turns: list[dict], tree: str) -> tuple[str, list[int], list[dict]]:
        """A conversation's tree, the packed starts of all its nodes, and its own nodes."""
        digests = [digest(t["text"]) for t in turns]
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared] == digests[shared]:
            shared += 1
        if shared == 0:
            self.length, self.tree = 0, tree
        del self.path[shared:], self.places[shared:]
        depth = sum(n for _, n in self.places)
        attends: list[list[int]] = []
        for at, n in self.places:
            if attends and attends[-1][1] == at:
                attends[-1][1] = at + n
            else:
                attends.append([at, at + n])
        own = []
        for turn, known_by in zip(turns[shared:], digests[shared:], strict=True):
            text = turn["text"]
            n, end = len(text), len(text) - len("</s>")
            own.append({"packed_start": self.length, "position": depth, "text": text, "loss_start": 0 if turn["loss"] else n, "loss_end": end if turn["loss"] else n, "attends": [{"start": a, "end": b} for a, b in attends]})
            if attends and attends[-1][1] == self.length:
                attends[-1][1] += n
            else:
                attends.append([self.length, self.length + n])
            self.path.append(known_by)
            self.places.append((self.length, n))
            self.length += n
            depth += n
        return self.tree, [at for at, _ in self.places], own

    def state(self) -> dict:
        return {"path": self.path, "places": self.places, "length": self.length, "tree": self.tree}


SUMMARY = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType())])


def conversations_sorted(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, tree (hash of its first turn), turns; sorted by path, over the partitions too."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), text.alias("words")))).alias("turns"))
    turns = turns.select("conv_id", F.transform("turns", lambda t: F.struct(format_turn(t["role"], t["words"]).alias("text"), (t["role"] == ASSISTANT).alias("loss"))).alias("turns"))
    hashed = turns.withColumn("hashes", F.transform("turns", lambda t: F.xxhash64(t["text"])))
    hashed = hashed.withColumn("tree", F.sha2(F.element_at("turns", 1)["text"], 256))
    return hashed.repartitionByRange("tree", "hashes", "conv_id").sortWithinPartitions("tree", "hashes", "conv_id").select("conv_id", "tree", "turns")


def pack(rows: DataFrame) -> DataFrame:
    """(conv_id, tree, path, nodes) for rows (conv_id, turn, role, text).

    path: the packed starts of all the conversation's nodes in its tree; nodes: those that no earlier one has.
    """
    bound_batches(rows.sparkSession)
    packed = T.StructType([rows.schema["conv_id"], *PACKED])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in packed])
    ordered = cut(conversations_sorted(rows).withColumn("part", F.spark_partition_id()))

    def summarise(batches):
        """A partition's first path and the state after its last conversation, as if nothing came before it."""
        packer, first, part = Packer(), None, None
        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"]
                if first is None:
                    first = {"path": [digest(t["text"]) for t in row["turns"]], "tree": row["tree"]}
                packer.add(row["turns"], row["tree"])
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "first": json.dumps(first), "last": json.dumps(packer.state())}], schema=pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string())]))

    # one row a partition, with the digests of a conversation's turns at each end, no more
    summaries = sorted(ordered.select("part", "tree", "turns").mapInArrow(summarise, SUMMARY).collect(), key=lambda r: r["part"])
    starts, before = {}, None
    for row in summaries:
        if before is not None:
            starts[row["part"]] = before
        first, last = json.loads(row["first"]), json.loads(row["last"])
        before = carried_state(before, first, last)
    shared = rows.sparkSession.sparkContext.broadcast(starts)

    def emit(batches):
        packer = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if packer is None:
                    packer = Packer(shared.value.get(row["part"]))
                tree, path, nodes = packer.add(row["turns"], row["tree"])
                out.append({"conv_id": row["conv_id"], "tree": tree, "path": path, "nodes": nodes})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return ordered.mapInArrow(emit, packed)


def carried_state(before: dict | None, first: dict, last: dict) -> dict:
    """The state after a partition that was gone through by itself, given the state before it.

    If the partition's first conversation shares turns with what came before, its nodes were counted from 0 although
    the tree goes on: in the tree in which the partition began, places move by what the tree had before, less the
    shared turns, which the partition's own count has at its start.
    """
    if before is None:
        return last
    shared = 0
    for old, new in zip(before["path"], first["path"], strict=False):
        if old != new:
            break
        shared += 1
    if shared == 0 or last["tree"] != first["tree"]:
        return last
    lead = sum(n for _, n in before["places"][:shared])
    shift = before["length"] - lead
    places = []
    for k, (at, n) in enumerate(last["places"]):
        places.append(tuple(before["places"][k]) if k < shared and at < lead else (at + shift, n))
    return {"path": last["path"], "places": places, "length": last["length"] + shift, "tree": before["tree"]}


def read_back(packed: DataFrame) -> DataFrame:
    """(conv_id, position, text, loss_start, loss_end) of every turn of every conversation, from the packed trees."""
    nodes = packed.select("tree", F.explode("nodes").alias("n")).select("tree", "n.packed_start", "n.position", "n.text", "n.loss_start", "n.loss_end")
    asked = packed.select("conv_id", "tree", F.posexplode("path").alias("turn_no", "packed_start"))
    return asked.join(nodes, ["tree", "packed_start"])


def parse_turns(turns: DataFrame) -> DataFrame:
    """Adds role and words to read-back turns: what the template marks and escapes, undone."""
    user = F.col("loss_start") == F.col("loss_end")
    assistant_empty = F.col("text") == "</s>"
    other = user & ~assistant_empty
    body = F.when(other, F.substring("text", F.lit(11), F.length("text") - 18)).otherwise(F.substring("text", F.lit(1), F.length("text") - 4))
    cut_at = F.locate("\n", body)
    named = F.replace(F.replace(unescape(F.substring(body, F.lit(1), cut_at - 1)), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
    role = F.when(other, named).otherwise(F.lit(ASSISTANT))
    words = F.when(other, F.substring(body, cut_at + 1, F.length(body))).otherwise(body)
    return turns.withColumn("role", role).withColumn("words", unescape(words))
