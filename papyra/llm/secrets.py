"""Secret scans with DataFrame functions only.

Known formats are found by three patterns, kept whatever else holds: assign (a key word, `:` or `=`, a value of six
or more characters), access (AKIA and capitals or digits, 20 or more in all) and hex (24 or more digits). Besides,
candidate strings (runs of [A-Za-z0-9+/_=-]) are scanned by a window of WINDOW characters that slides over them: the
Shannon entropy of the window, per character class, is kept up from the counts of the one character that enters and
the one that leaves. A candidate of a class (hex, or base64 with characters of two of: capitals, small letters,
digits) is a secret if a window reaches the class's threshold, unless an allow-list pattern matches it or it overlaps
a known format; windows near a word of the allow-list, in its segment, don't count. It is reported as kind `entropy`.

Spans are code points, end exclusive. Null and empty texts have none. Rows that repeat are scanned one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import free_names


def either_case(word: str) -> str:
    """A pattern for the ASCII letters of a word in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join([*(either_case(w) for w in ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN_HEAD = rf"""(?:{KEYWORDS})["']?\x20*[:=]\x20*["']?"""
ASSIGN = ASSIGN_HEAD + VALUE
#: As long as the pattern's value is maximal, these ask for the least length at once.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
MIN_VALUE = 6

WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: The greatest entropy of a window is log2(20) = 4.32 bits. Random hex has 3.3 on average, random base64 4.0.
THRESHOLDS = {"hex": 2.9, "base64": 3.7}
#: Candidates that look random and are no secrets, as a whole.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"^(sha1|sha256|sha384|sha512|md5)-",  # integrity attributes
    r"^(.)\1+$",
)
#: Words that mark what is around them as no secret: their segment (between the characters / = _ -), as far as
#: NEAR characters on either side. What is left of the candidate is scanned all the same.
NEAR = 64
ALLOWED_WORDS = rf"[^/=_-]{{0,{NEAR}}}(?:(?i:example|placeholder|changeme|dummy|sample)|0123456789|abcdefghij)[^/=_-]{{0,{NEAR}}}"
KINDS = ("assign", "access", "hex", "entropy")


SPANS = "array<struct<start:int,end:int,s:string>>"
#: Matches of a text are placed block by block, so that no long array is copied once a match.
SPAN_BLOCK = 256


def bound(value: Column, body) -> Column:
    """body(value), with the value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def spans_of(text: Column, pattern: str) -> Column:
    """(start, end, text) of the leftmost matches that don't overlap, from the pieces between them."""
    none = F.array().cast(SPANS)
    # one entry a match: the length of the piece before it, and the match; the piece after the last one has no match
    pairs = F.zip_with(F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("s")))
    pairs = F.filter(pairs, lambda x: x["s"].isNotNull())

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["s"])
        return F.struct(F.concat(acc["done"], F.array(F.struct(start.alias("start"), end.alias("end"), x["s"].alias("s")))).alias("done"), end.alias("at"))

    def placed(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(none.alias("done"), at.alias("at")), one, lambda acc: acc["done"])

    def many(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(SPAN_BLOCK)), lambda k: F.slice(pairs, k, F.lit(SPAN_BLOCK)))
        blocks = F.transform(blocks, lambda b: F.struct(b.alias("b"), F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["s"])).alias("n")))
        starts = lambda acc, x: F.struct(F.concat(acc["done"], F.array(acc["at"])).alias("done"), (acc["at"] + x["n"]).alias("at"))
        at = lambda blocks: F.aggregate(blocks, F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("at")), starts, lambda acc: acc["done"])
        return bound(blocks, lambda blocks: F.flatten(F.zip_with(blocks, at(blocks), lambda x, start: placed(x["b"], start))))

    # most texts have no match; for them the text is scanned once
    return F.when(F.rlike(text, F.lit(pattern)), bound(pairs, many)).otherwise(none)


def overlaps(spans: Column, x: Column) -> Column:
    """Whether x overlaps one of `spans`, which are in order and disjoint: by bisection, the last that starts before
    x's end is the one to look at."""
    step = lambda n, bit: F.when(F.get(spans, n + bit - 1)["start"] < x["end"], n + bit).otherwise(n)
    before = F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), step)
    return F.coalesce(F.get(spans, before - 1)["end"] > x["start"], F.lit(False))


#: The characters of candidates; each has a counter of COUNTER_BITS bits, and a long holds COUNTERS of them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
COUNTER_BITS, COUNTERS = 5, 12
#: c log2 c is kept in units of 2^-40, so sums are exact and don't drift however far the window slides.
UNIT = 2.0**40


def best_entropy(s: Column, window: int = WINDOW) -> Column:
    """The greatest entropy of a window of s, by incremental counts; null if s is shorter than the window.

    The entropy of counts c of n characters is log2 n - (sum of c log2 c) / n. When the window moves by one, only the
    counts of the character that leaves and of the one that enters change, so a step costs the same whatever the
    window and the length of s. s has characters of ALPHABET only; window is below 2^COUNTER_BITS.
    """
    words = [f"w{n}" for n in range(-(-len(ALPHABET) // COUNTERS))]
    #: What the sum grows by when a count goes from c to c + 1.
    weight = [int(c * math.log2(c) * UNIT + 0.5) if c > 1 else 0 for c in range(window + 2)]
    growth = F.array(*[F.lit(b - a).cast("long") for a, b in zip(weight, weight[1:], strict=False)])
    codes = F.transform(F.split(s, ""), lambda c: (F.instr(F.lit(ALPHABET), c) - 1).cast("int"))
    moves = lambda codes: F.zip_with(codes, F.slice(F.concat(F.array_repeat(F.lit(-1), window), codes), 1, F.size(codes)), lambda i, o: F.struct(i.alias("i"), o.alias("o")))

    def shift(code: Column) -> Column:
        return F.when(code >= 0, F.lit(COUNTER_BITS) * (code % COUNTERS)).otherwise(F.lit(0))

    def held(acc: Column, code: Column) -> Column:
        which = (code / COUNTERS).cast("int")
        word = acc[words[-1]]
        for n in range(len(words) - 2, -1, -1):
            word = F.when(which == n, acc[words[n]]).otherwise(word)
        return F.call_function("shiftright", word, shift(code)).bitwiseAND(F.lit(2**COUNTER_BITS - 1))

    def move(acc: Column, x: Column) -> Column:
        come, gone = x["i"], x["o"]
        leaves = gone >= 0
        # counts before the step; of the character that enters, without the one that leaves
        had = held(acc, gone)
        has = held(acc, come) - F.when(come == gone, 1).otherwise(0)
        total = acc["total"] - F.when(leaves, F.get(growth, (had - 1).cast("int"))).otherwise(F.lit(0)) + F.get(growth, has.cast("int"))
        place = lambda code, n: F.when((code >= COUNTERS * n) & (code < COUNTERS * (n + 1)), F.call_function("shiftleft", F.lit(1).cast("long"), shift(code))).otherwise(F.lit(0).cast("long"))
        new = [(acc[w] + place(come, n) - place(gone, n)).alias(w) for n, w in enumerate(words)]
        seen = acc["seen"] + 1
        return F.struct(*new, total.alias("total"), seen.alias("seen"), F.when(seen >= window, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

    zero = F.lit(0).cast("long")
    start = F.struct(*[zero.alias(w) for w in words], zero.alias("total"), F.lit(0).alias("seen"), F.lit(2**62).cast("long").alias("least"))
    least = bound(codes, lambda codes: F.aggregate(moves(codes), start, move, lambda acc: acc["least"]))
    return F.when(F.length(s) >= window, F.lit(math.log2(window)) - least.cast("double") / F.lit(UNIT * window))


def is_random(s: Column) -> Column:
    """Whether a string's class reaches its threshold."""
    kinds = sum(F.rlike(s, F.lit(p)).cast("int") for p in ("[A-Z]", "[a-z]", "[0-9]"))
    least = F.when(F.rlike(s, F.lit("^[0-9a-fA-F]+$")) & F.rlike(s, F.lit("[0-9]")), F.lit(THRESHOLDS["hex"])).when(kinds >= 2, F.lit(THRESHOLDS["base64"]))
    digits = F.rlike(s, F.lit("[0-9]"))  # words joined by hyphens or slashes have none
    return least.isNotNull() & digits & (F.round(best_entropy(s), 9) >= least)


def is_secret(s: Column) -> Column:
    """Whether a candidate that no allow-list pattern matches is random in a part that no allowed word covers."""
    allowed = F.lit(False)
    for p in ALLOWED:
        allowed = allowed | F.rlike(s, F.lit(p))
    parts = F.split(F.regexp_replace(s, F.lit(ALLOWED_WORDS), F.lit(" ")), " ")
    return ~allowed & F.exists(F.filter(parts, lambda p: F.length(p) >= WINDOW), is_random)


def _named(n: int, kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("kind_no"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds secrets: array of (start, kind_no, kind, end), ordered by start, then kind as listed in KINDS. Other
    columns stay whatever they are called, but for one that is called secrets."""
    own = free_names(docs, *KINDS)
    text = F.coalesce(F.col(text_col), F.lit(""))
    value = lambda x: F.length(F.regexp_replace(x["s"], "^" + ASSIGN_HEAD, ""))
    found = [F.filter(spans_of(text, ASSIGN), lambda x: value(x) >= MIN_VALUE), spans_of(text, ACCESS), spans_of(text, HEX)]
    scanned = docs.withColumns(dict(zip(own, found, strict=False)))
    free = lambda x: ~(overlaps(F.col(own[0]), x) | overlaps(F.col(own[1]), x) | overlaps(F.col(own[2]), x))
    scanned = scanned.withColumn(own[3], F.filter(spans_of(text, CANDIDATE), lambda x: free(x) & is_secret(x["s"])))
    named = [F.transform(name, _named(n, kind)) for n, (name, kind) in enumerate(zip(own, KINDS, strict=True))]
    return scanned.withColumn("secrets", F.array_sort(F.concat(*named))).drop(*own)
