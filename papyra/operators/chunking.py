"""From documents to pages and chunks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.text import heading, section_size

SIZE, OVERLAP = 1000, 200
SEPARATORS = ("\n\n", "\n", "。", ". ", " ", "")
SECTION_OVERLAP = 50


def document_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text) of pages (doc_id, page_no, text): blank pages dropped, joined by blank lines in page order."""
    kept = pages.where(F.btrim("text", F.lit(" \n\t\r")) != "")
    whole = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    return whole.select("doc_id", F.array_join("p.text", "\n\n").alias("text"))


def page_offsets(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, start, end): each page's place in its document's text; the last page's end is open."""
    order = Window.partitionBy("doc_id").orderBy("page_no")
    kept = pages.where(F.btrim("text", F.lit(" \n\t\r")) != "").withColumn("n", F.length("text") + 2)
    kept = kept.withColumn("start", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    kept = kept.withColumn("start", F.coalesce("start", F.lit(0)))
    return kept.select("doc_id", "page_no", "start", F.lead("start").over(order).alias("end"))


def page_of_offset(chunks: DataFrame, offsets: DataFrame) -> DataFrame:
    """As-of join: the last page that starts at or before a chunk's offset."""
    there = (F.col("offset") >= F.col("start")) & (F.col("end").isNull() | (F.col("offset") < F.col("end")))
    o = offsets.withColumnRenamed("doc_id", "_doc")
    return chunks.join(o, (F.col("doc_id") == F.col("_doc")) & there).drop("_doc", "start", "end")


def stride_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, offset, content): pieces of `size` characters, each beginning `overlap` before the last's end."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length("text") - overlap) / step).cast("int"), F.lit(1)) - 1
    starts = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return starts.select("doc_id", "chunk_index", (F.col("chunk_index") * step).alias("offset"), F.substring("text", F.col("chunk_index") * step + 1, F.lit(size)).alias("content"))


Span = tuple[int, int]


def _parts(text: str, first: int, last: int, separator: str) -> list[Span]:
    """Spans of text[first:last] that begin at each separator (single characters for an empty one)."""
    if separator == "":
        return [(k, k + 1) for k in range(first, last)]
    cuts, at = [first], text.find(separator, first, last)
    while at >= 0:
        if at > cuts[-1]:
            cuts.append(at)
        at = text.find(separator, at + 1, last)
    return list(zip(cuts, [*cuts[1:], last], strict=True))


def _stripped(text: str, first: int, last: int) -> Span:
    own = text[first:last]
    lead = len(own) - len(own.lstrip())
    return first + lead, first + lead + len(own.strip())


def recursive_spans(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[Span]:
    """Where the chunks of a text begin and end. It is cut at the first separator that occurs; small parts are packed up to
    size, a chunk taking over the last parts of the one before as far as `overlap`; larger parts are cut at the next
    separators. A stack of open parts takes the place of recursion."""
    out: list[Span] = []

    def add(first: int, last: int) -> None:
        first, last = _stripped(text, first, last)
        if first < last:
            out.append((first, last))

    todo: list[tuple[int, int, tuple[str, ...]]] = [(0, len(text), separators)]
    while todo:
        first, last, left = todo.pop()
        at = next((n for n, s in enumerate(left) if s == "" or text.find(s, first, last) >= 0), len(left) - 1)
        rest, parts = left[at + 1 :], _parts(text, first, last, left[at])
        head = 0  # parts[head:n] are packed
        for n, (a, b) in enumerate(parts):
            if b - a > size and rest:
                if head < n:
                    add(parts[head][0], a)
                # this part is cut first, then what comes after it
                if b < last:
                    todo.append((b, last, left))
                todo.append((a, b, rest))
                break
            if head < n and b - parts[head][0] > size:
                add(parts[head][0], a)
                while head < n and (a - parts[head][0] > overlap or b - parts[head][0] > size):
                    head += 1
        else:
            if parts and head < len(parts):
                add(parts[head][0], last)
    return out


def _spread(rows: DataFrame, spans, added: str) -> DataFrame:
    """rows (whose last columns are text and what `spans` takes besides) without the text, once for each piece that
    spans(text, ...) gives: (start, end, content) in the text, with its number as chunk_index."""
    schema = T.StructType([*(f for f in rows.schema if f.name not in ("text", added)), *(T.StructField(c, T.IntegerType()) for c in ("chunk_index", "start", "end")), T.StructField("content", T.StringType())])
    kept = [c for c in rows.columns if c not in ("text", added)]
    more = added in rows.columns

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [spans(t, n) if t else [] for t, n in zip(texts, batch.column(added).to_pylist() if more else texts, strict=True)]
            owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
            part = batch.select(kept).take(pa.array(owner))
            flat = [(k, *x) for own in found for k, x in enumerate(own)]
            numbers = [pa.array([x[c] for x in flat], pa.int32()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*part.columns, *numbers, pa.array([x[3] for x in flat], pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def recursive_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """(doc_id, chunk_index, start, end, content) by recursive splitting; content is the text from start to end (code
    points from 0, end exclusive)."""
    return _spread(docs.select("doc_id", "text"), lambda t, _: [(a, b, t[a:b]) for a, b in recursive_spans(t, size, overlap, separators)], "_none")


def _pack(parts: list[tuple[int, int, str]], size: int, glue: str) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for a, b, p in parts:
        if out and len(out[-1][2]) + len(glue) + len(p) <= size:
            out[-1] = (out[-1][0], b, out[-1][2] + glue + p)
        else:
            out.append((a, b, p))
    return out


def _between(pattern: str, text: str, first: int, last: int) -> list[Span]:
    """The stripped spans between matches of the pattern; empty ones are left out."""
    cuts = [(m.start(), m.end()) for m in re.compile(pattern).finditer(text, first, last)]
    spans = [_stripped(text, a, b) for a, b in zip([first, *(e for _, e in cuts)], [*(s for s, _ in cuts), last], strict=True)]
    return [(a, b) for a, b in spans if a < b]


def section_spans(text: str, size: int) -> list[tuple[int, int, str]]:
    """(start, end, piece): paragraphs packed up to size; longer ones by sentences, longer sentences cut. A piece is what
    lies between start and end, with blank lines and the gaps between sentences made uniform."""
    out: list[tuple[int, int, str]] = []
    for a, b in _between(r"\n\s*\n", text, 0, len(text)):
        if b - a <= size:
            out.append((a, b, text[a:b]))
            continue
        sentences = _between(r"(?<=[。！？.!?])", text, a, b)
        cut = [(k, min(k + size, e), text[k : min(k + size, e)]) for s, e in sentences for k in range(s, e, size)]
        out.extend(_pack(cut, size, " "))
    return _pack(out, size, "\n\n")


def section_chunks(sections: DataFrame, overrides: dict[str, int] | None = None, overlap: int = SECTION_OVERLAP) -> DataFrame:
    """(doc_id, section_no, section_type, chunk_index, start, end, content) for sections (doc_id, section_no, section_type,
    text). start and end are in the section's text.

    Pieces fit the section's size; each after the first is led by the last `overlap` characters of the one before.
    """

    def pieces(text: str, size: int) -> list[tuple[int, int, str]]:
        found = section_spans(text, size)
        leads = ["", *(p[-overlap:] if overlap else "" for _, _, p in found)]
        return [(a, b, lead + p) for (a, b, p), lead in zip(found, leads, strict=False)]

    rows = sections.select("doc_id", "section_no", "section_type", "text", section_size(F.col("section_type"), overrides).alias("_size"))
    return _spread(rows, pieces, "_size")


def paged_chunks(pages: DataFrame, overrides: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, chunk_index, section, page_no, start, end, content) for pages (doc_id, page_no, text). Headings on pages
    give the sections, pages without one go on with the last; sections are split, and start and end are in the document's
    text, by which the page on which a chunk begins is found (as-of join). Blank pages take no part."""
    kept = pages.where(F.btrim("text", F.lit(" \n\t\r")) != "")
    found = kept.withColumn("_h", heading(F.col("text")))
    named = fill_sections(found.select("doc_id", "page_no", "text", F.col("_h.section").alias("section"), F.col("_h.title").alias("title")))
    sections = group_pages(named)
    offsets = page_offsets(kept)
    first = offsets.select(F.col("doc_id").alias("_doc"), F.col("page_no").alias("_page"), F.col("start").alias("_from"))
    chunks = section_chunks(sections, overrides).join(sections.select("doc_id", "section_no", "first_page"), ["doc_id", "section_no"])
    chunks = chunks.join(first, (F.col("doc_id") == F.col("_doc")) & (F.col("first_page") == F.col("_page")))
    placed = chunks.select("doc_id", "section_no", "section_type", "chunk_index", (F.col("_from") + F.col("start")).alias("offset"), (F.col("_from") + F.col("end")).alias("_to"), "content")
    at = page_of_offset(placed, offsets)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no", "chunk_index")) - 1
    return at.select("doc_id", number.alias("chunk_index"), F.col("section_type").alias("section"), "page_no", F.col("offset").alias("start"), F.col("_to").alias("end"), "content")


def fill_sections(pages: DataFrame) -> DataFrame:
    """Pages without a heading take the section of the last one that has one; leading ones are unknown."""
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.last("section", ignorenulls=True).over(before)
    return pages.withColumn("section", F.coalesce(filled, F.lit("unknown")))


def group_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, section_no, section_type, title, first_page, text): runs of pages of one section and title.

    A page without a title joins the run before it if the section is the same; gaps and islands by a running sum.
    """
    order = Window.partitionBy("doc_id").orderBy("page_no")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.nullif(F.col("title"), F.lit(""))
    rows = pages.withColumn("_new_type", F.coalesce(F.lag("section").over(order) != F.col("section"), F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new_type").over(up_to)).withColumn("_title", title)
    in_run = Window.partitionBy("doc_id", "_run").orderBy("page_no")
    seen = F.last("_title", ignorenulls=True).over(in_run.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("_new_type") == 1, 1).when(F.col("_title").isNotNull() & (seen != F.col("_title")), 1).otherwise(0))
    rows = rows.withColumn("section_no", F.sum("_new").over(up_to))
    done = rows.groupBy("doc_id", "section_no").agg(
        F.first("section").alias("section_type"), F.max("_title").alias("title"), F.min("page_no").alias("first_page"), F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p")
    )
    return done.select("doc_id", "section_no", "section_type", F.coalesce("title", F.lit("")).alias("title"), "first_page", F.array_join("p.text", "\n\n").alias("text"))


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """Adds chunk_id: a hash of the document, the text's hash and how often the text came before in the document."""
    rows = chunks.withColumn("_hash", F.md5("content"))
    same = Window.partitionBy("doc_id", "_hash").orderBy("chunk_index")
    occurrence = F.row_number().over(same) - 1
    return rows.withColumn("chunk_id", F.md5(F.concat_ws("::", "doc_id", "_hash", occurrence))).drop("_hash")


def modal_text(kind: Column, hint: Column, text: Column) -> Column:
    return F.concat(F.lit("["), F.upper(kind), F.lit("] "), hint, F.lit("\n"), text)
