"""Column functions on texts: names, slugs, headings, references, metadata, time constraints, small formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headings and the sections that they open, in the order in which they are tried.
HEADINGS = (
    (r"^(abstract)$", "abstract"),
    (r"^(\d+\.?\s*)?(introduction)$", "introduction"),
    (r"^(\d+\.?\s*)?(related\s+work|literature\s+review|background)$", "related_work"),
    (r"^(\d+\.?\s*)?(method(ology|s)?|approach|proposed\s+method)$", "method"),
    (r"^(\d+\.?\s*)?(experiment(s|al\s+setup)?|evaluation|experimental\s+results)$", "experiment"),
    (r"^(\d+\.?\s*)?(results?)$", "result"),
    (r"^(\d+\.?\s*)?(discussion)$", "discussion"),
    (r"^(\d+\.?\s*)?(conclusion(s)?|summary)$", "conclusion"),
    (r"^(references?|bibliography)$", "reference"),
    (r"^(appendix|appendices|supplementary)(\s+[A-Z])?$", "appendix"),
)
# The longest chunk of each section, in characters.
SECTION_SIZES = {"abstract": 300, "introduction": 400, "related_work": 500, "method": 700, "experiment": 600, "result": 600, "discussion": 500, "conclusion": 300, "reference": 400, "appendix": 500, "unknown": 500}
# Chinese numerals.
NUMERALS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "十一": 11, "十二": 12, "十三": 13, "十四": 14, "十五": 15, "二十": 20}
# Words for "lately".
RECENT_WORDS = ("最新", "最近", "近期", "近年", "latest", "recent")
RECENT_YEARS = 3
# Question words and endings, stop words.
FILLERS = ("什么", "哪些", "哪个", "如何", "怎么", "为什么", "是否", "以及", "还有", "请问", "一下")
STOP_WORDS = ("the", "a", "an", "of", "for", "to", "and", "or", "in", "on", "with", "by", "is", "are", "be", "what", "which", "how", "why")
ENDINGS = "(有哪些|是什么|是什么问题|差异是什么|表现差异是什么|如何|怎么样)$"
# What tells topics (hl) from names of things (ll).
HL_ROOTS = ("trend", "survey", "overview", "challenge", "progress", "comparison", "review", "evolution", "evaluation", "direction", "application")
HL_ROOTS_ZH = ("趋势", "综述", "挑战", "现状", "进展", "演变", "对比", "比较", "评估", "方向", "问题", "应用")
HL_WORDS = ("trend", "trends", "survey", "overview", "review", "progress", "challenge", "challenges", "direction", "directions")
TOPIC_HINTS = ("研究", "领域", "任务", "方向", "应用", "发展", "技术", "范式")
LL_HINTS = ("bert", "gpt", "rag", "clip", "llama", "transformer", "diffusion", "retrieval", "prompt", "agent", "benchmark", "dataset", "encoder", "decoder")
LL_SUFFIXES = ("模型", "方法", "算法", "框架", "网络", "系统", "数据集", "基准", "任务", "论文", "编码器", "解码器", "预训练", "微调", "检索")
TOPICS = ("研究趋势", "应用挑战", "研究方向", "研究现状", "技术进展", "主要挑战")
KEYWORDS_KEPT = 8


def _any(*tests: Column) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def spaces_collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(title: Column, longest: int = 60, empty: str = "memory") -> Column:
    """Lower-case letters, digits, underscores and hyphens only; `empty` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9_-]", "_"), "_+", "_")
    s = F.btrim(s, F.lit("_"))
    return F.when(s == "", F.lit(empty)).otherwise(F.substring(s, 1, longest))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared words by all words; 0 if either text has none."""
    wa, wb = words(a), words(b)
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb)))


def _section_of(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, section in reversed(HEADINGS):
        out = F.when(F.rlike(line, F.lit("(?i)" + pattern)), F.lit(section)).otherwise(out)
    return out


def heading(page: Column) -> Column:
    """(section, title) of the first heading among a page's first ten lines that aren't blank; null if none is."""
    lines = F.slice(F.filter(F.transform(F.split(page, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 10)
    judged = F.transform(lines, lambda x: F.struct(F.when(F.length(x) <= 80, _section_of(x)).alias("section"), x.alias("title")))
    found = F.filter(judged, lambda x: x["section"].isNotNull())
    return F.when(F.size(found) > 0, F.element_at(found, 1))


def section_size(section: Column, overrides: dict[str, int] | None = None) -> Column:
    sizes = F.create_map(*[F.lit(x) for pair in (SECTION_SIZES | (overrides or {})).items() for x in pair])
    return F.coalesce(F.try_element_at(sizes, section), F.lit(SECTION_SIZES["unknown"]))


def reference_section(text: Column) -> Column:
    """The text after the first line that is a heading of references; empty if there is none."""
    return F.regexp_extract(text, r"(?is)(?:^|\n)(?:References?|Bibliography|参考文献)\s*\n(.*)", 1)


def split_references(section: Column, least: int = 10) -> Column:
    """Numbered entries ([n] or n.) where there are two markers at least, else paragraphs; short ones are left out."""
    lead = F.concat(F.lit("\n"), section)
    marker = r"\n\s*(?:\[\d+\]|\d+\.\s)"
    numbered = F.slice(F.split(lead, marker), 2, 100_000)
    parts = F.when(F.regexp_count(lead, F.lit(marker)) >= 2, numbered).otherwise(F.split(section, r"\n\s*\n"))
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" \n\t\r"))), lambda x: F.length(x) >= least)


def doi(raw: Column) -> Column:
    return F.regexp_extract(raw, r"10\.\d{4,}/\S+", 0)


def reference_year(raw: Column) -> Column:
    return F.regexp_extract(raw, r"\b(?:19|20)\d{2}\b", 0)


def quoted_title(raw: Column) -> Column:
    return F.regexp_extract(raw, '"([^"]{10,})"', 1)


def rule_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b(20[0-2]\d)\b", 1), F.lit("")).cast("int")


def rule_abstract(text: Column) -> Column:
    return F.nullif(F.btrim(F.regexp_extract(text, r"(?is)abstract[.\s:—-]*(.+?)(?=\n\s*\n|\nintroduction|\nkeywords|\n1\b)", 1), F.lit(" \n\t\r")), F.lit(""))


def rule_keywords(text: Column) -> Column:
    raw = F.trim(F.regexp_extract(text, r"(?i)keywords?[.\s:—-]*(.+)", 1))
    return F.filter(F.transform(F.split(raw, "[;,·•]"), lambda x: F.trim(x)), lambda x: x != "")


def time_constraint(query: Column, as_of_year: int) -> Column:
    """(year_from, year_to) that a query asks for, or null. Rules in order; one that matches with values out of bounds
    lets the next one try: the last N years, a range, since a year, one year, a word for lately."""
    none = F.lit(None).cast("int")
    bounds = lambda low, high: F.struct(low.cast("int").alias("year_from"), high.cast("int").alias("year_to"))
    number = lambda pattern, n: F.nullif(F.regexp_extract(query, pattern, n), F.lit("")).cast("int")
    latest = as_of_year + 5
    raw = F.regexp_extract(query, r"近([一二三四五六七八九十\d]{1,2})年", 1)
    n = F.when(F.rlike(raw, F.lit(r"^\d+$")), F.try_to_number(raw, F.lit("99")).cast("int")).otherwise(F.try_element_at(F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in pair]), raw))
    years = r"(20\d{2})年?\s*[-~至到]\s*(20\d{2})年?"
    a, b = number(years, 1), number(years, 2)
    since = number(r"(20\d{2})年\s*(?:以来|之后|起|后)", 1)
    one = number(r"(?<!\d)(20\d{2})(?!\d)", 1)
    recent = _any(*[F.contains(F.lower(query), F.lit(w)) for w in RECENT_WORDS])
    return (
        F.when((n >= 1) & (n <= 50), bounds(F.lit(as_of_year + 1) - n, none))
        .when((a <= latest) & (a <= b) & (b <= latest), bounds(a, b))
        .when(since <= latest, bounds(since, none))
        .when(one <= latest, bounds(one, one))
        .when(recent, bounds(F.lit(as_of_year - RECENT_YEARS + 1), none))
    )


def clean_phrase(phrase: Column) -> Column:
    """Without outer punctuation, question endings and particles; empty for stop words."""
    s = F.btrim(phrase, F.lit(" ,，。！？!?()（）[]【】\"'“”‘’"))
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", " "), ENDINGS, "")
    s = F.btrim(s, F.lit("的在上中与和及 "))
    return F.when(F.lower(s).isin(*STOP_WORDS) | s.isin(*FILLERS), F.lit("")).otherwise(s)


def phrase_level(phrase: Column) -> Column:
    """hl (a topic), ll (the name of a thing) or null."""
    low = F.lower(phrase)
    han = lambda a, b: F.rlike(phrase, F.lit(f"^[\\u4e00-\\u9fff]{{{a},{b}}}$"))
    hinted = _any(*[F.contains(phrase, F.lit(h)) for h in TOPIC_HINTS])
    topical = _any(
        *[F.contains(low, F.lit(r)) for r in HL_ROOTS],
        *[F.contains(phrase, F.lit(r)) for r in HL_ROOTS_ZH],
        low.isin(*HL_WORDS),
        han(4, 20) & hinted,
        F.contains(phrase, F.lit(" ")) & F.arrays_overlap(F.split(low, r"\s+"), F.array(*map(F.lit, HL_WORDS))),
    )
    named = _any(
        *[F.contains(low, F.lit(h)) for h in LL_HINTS],
        *[F.endswith(phrase, F.lit(s)) for s in LL_SUFFIXES],
        F.rlike(phrase, F.lit("[A-Z]{2,}")),
        F.rlike(phrase, F.lit("[0-9]")) & F.rlike(phrase, F.lit("[A-Za-z]")),
        F.contains(phrase, F.lit("-")) & F.rlike(phrase, F.lit("[A-Za-z]")),
        han(2, 8) & ~hinted,
    )
    chinese = F.rlike(phrase, F.lit("[\\u4e00-\\u9fff]"))
    plain = F.when(chinese, F.when(F.length(phrase).between(2, 8), F.lit("ll"))).when(F.rlike(phrase, F.lit(r"\S\s+\S")) | (F.length(phrase) >= 3), F.lit("ll"))
    return F.when(low.isin(*STOP_WORDS) | phrase.isin(*FILLERS), F.lit(None).cast("string")).when(topical, F.lit("hl")).when(named, F.lit("ll")).otherwise(plain)


def expand_topic(phrase: Column) -> Column:
    """The parts of a topic joined by `and`, each by its canonical name."""
    parts = F.when(F.contains(phrase, F.lit("和")), F.filter(F.split(phrase, "[和及与]"), lambda x: x != "")).otherwise(F.array(phrase))

    def canonical(x: Column) -> Column:
        out = x
        for t in reversed(TOPICS):
            out = F.when(F.contains(x, F.lit(t)), F.lit(t)).otherwise(out)
        return out

    return F.transform(parts, canonical)


def distinct_keywords(items: Column) -> Column:
    """The first KEYWORDS_KEPT items, each once whatever its case, in order."""
    lowered = F.transform(items, F.lower)
    first = F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    return F.slice(first, 1, KEYWORDS_KEPT)


def question_type(constraint: Column, ll: Column, hl: Column) -> Column:
    return F.when(constraint.isNotNull(), "temporal").when((F.size(ll) > 0) & (F.size(hl) > 0), "mixed").when(F.size(ll) > 0, "specific").when(F.size(hl) > 0, "abstract").otherwise("general")


def auto_mode(constraint: Column, ll: Column, hl: Column) -> Column:
    """The retrieval mode that suits a query."""
    return F.when(constraint.isNotNull(), "mix").when((F.size(ll) > 0) & (F.size(hl) > 0), "dual").when(F.size(ll) > 0, "local").when(F.size(hl) > 0, "global").otherwise("mix")


def json_candidates(text: Column) -> Column:
    """What may be JSON in a model's answer, in the order in which it is tried."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    outer = F.lit(" \t\r\n")
    return F.array(F.btrim(text, outer), F.btrim(fenced, outer), F.regexp_extract(text, r"(?s)\{.*\}", 0), F.regexp_extract(text, r"(?s)\[.*\]", 0))


def extract_json(text: Column) -> Column:
    """The first candidate that parses, as text; null if none does."""
    out = F.lit(None).cast("string")
    for n in (4, 3, 2, 1):
        s = F.element_at(json_candidates(text), n)
        out = F.when((s != "") & F.try_parse_json(s).isNotNull(), s).otherwise(out)
    return out


def list_items(text: Column, most: int = 5) -> Column:
    """The items of a numbered or bulleted list, one a line."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(?:\d+[.)、]|[-*•])\s*", "")))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, most)


def head_and_tail(text: Column, longest: int = 400, head: int = 250, tail: int = 150) -> Column:
    return F.when(F.length(text) <= longest, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(" … "), F.right(text, F.lit(tail))))


def source_tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[来源:\s*([^\]]+)\]"), F.lit(1))


def one_line(text: Column, longest: int = 80, default: str = "done") -> Column:
    first = F.trim(F.element_at(F.split(F.trim(text), "\n"), 1))
    return F.when(first == "", F.lit(default)).when(F.length(first) > longest, F.concat(F.substring(first, 1, longest), F.lit("…"))).otherwise(first)


def cost(prompt: Column, completion: Column, prompt_price: float = 0.04, completion_price: float = 0.12) -> Column:
    return F.round(prompt / 1000.0 * prompt_price + completion / 1000.0 * completion_price, 6)


def table_text(cells: Column) -> Column:
    """Rows of cells as text: cells joined by tabs (null is empty), rows by line breaks, trimmed."""
    rows = F.transform(cells, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "\t"))
    return F.btrim(F.array_join(rows, "\n"), F.lit(" \t\n\r"))


def front_matter(text: Column) -> Column:
    """(meta, body): the `key: value` lines between leading --- lines, and the rest; no block gives an empty map."""
    pattern = r"(?s)^---\s*\n(.*?)\n---\s*\n?(.*)$"
    there = F.rlike(text, F.lit(pattern))
    lines = F.filter(F.split(F.regexp_extract(text, pattern, 1), "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("value")))
    empty = F.create_map().cast("map<string,string>")
    return F.struct(F.when(there, F.map_from_entries(pairs)).otherwise(empty).alias("meta"), F.when(there, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("body"))


def format_front_matter(meta: Column, body: Column) -> Column:
    lines = F.transform(F.map_entries(meta), lambda e: F.concat(e["key"], F.lit(": "), F.regexp_replace(e["value"], r"\s*\n\s*", " ")))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), body)


def index_line(line: Column) -> Column:
    """(title, file, hook) of a line `- [title](file) — hook`."""
    pattern = r"^- \[(.*?)\]\((.*?)\)(?:\s*—\s*(.*))?$"
    return F.when(F.rlike(line, F.lit(pattern)), F.struct(*[F.regexp_extract(line, pattern, n).alias(name) for n, name in ((1, "title"), (2, "file"), (3, "hook"))]))


# The list and text fields of a structured report, and their headings.
REPORT_LISTS = {"research_gaps": "Research Gaps", "method_comparisons": "方法对比", "suggested_directions": "建议方向"}
REPORT_TEXTS = {"evidence_basis": "证据依据", "confidence_note": "证据充分度说明"}
NOT_GIVEN = "（未提供）"


def report_fields(answer: Column) -> Column:
    """A model's structured report as a struct. A string in place of a list is a list of one, a blank one of none; what
    is missing gets a default; a bare list is taken as directions; without JSON the answer's beginning is the evidence."""
    found = extract_json(answer)
    bare, none = F.startswith(found, F.lit("[")), found.isNull()
    strings = lambda s: F.coalesce(F.from_json(s, "array<string>"), F.array().cast("array<string>"))

    def listed(name: str) -> Column:
        value = F.get_json_object(found, f"$.{name}")
        many = F.when(F.startswith(value, F.lit("[")), strings(value)).when(F.trim(value) != "", F.array(value)).otherwise(F.array().cast("array<string>"))
        return F.when(bare, strings(found) if name == "suggested_directions" else F.array().cast("array<string>")).otherwise(many)

    def said(name: str) -> Column:
        value = F.coalesce(F.get_json_object(found, f"$.{name}"), F.lit(NOT_GIVEN))
        return F.when(none & F.lit(name == "evidence_basis"), F.substring(answer, 1, 1000)).otherwise(value)

    return F.struct(*[listed(n).alias(n) for n in REPORT_LISTS], *[said(n).alias(n) for n in REPORT_TEXTS])


def report_markdown(report: Column) -> Column:
    """The report of report_fields as Markdown: lists as bullets, texts as they are."""
    lines = F.array(F.lit("# Idea 报告"))
    for name, head in REPORT_LISTS.items():
        lines = F.concat(lines, F.array(F.lit(""), F.lit(f"## {head}")), F.transform(report[name], lambda x: F.concat(F.lit("- "), x)))
    for name, head in REPORT_TEXTS.items():
        lines = F.concat(lines, F.array(F.lit(""), F.lit(f"## {head}"), report[name]))
    return F.array_join(lines, "\n")
