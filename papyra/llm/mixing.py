"""Mixing sources to target weights by Pareto order sampling.

A document's size is its number of words. Each source gets a target: its weight's share of all sizes, at most
`max_copies` times the source's own size, the excess shared again by weight among the others.

Within its source a document is expected c * m times, at most `max_copies`: m is its measure, a whole number above 0
(by default the number of binary digits of its size, so that a text of 1,000 words is taken about three times as often
as one of 5), and c is the source's factor with which expected copies times sizes sum to the target. The whole part of
the expected copies is taken for certain. The rest, p, differs from document to document; it is the inclusion
probability in a Pareto order sample: documents are ranked by the random odds u/(1-u) divided by the inclusion odds
p/(1-p), and are taken in that order up to the fixed size (in words) that the target leaves. The words that are still
missing there are filled at most FILLS times by the next in rank of the documents that fill more than half of them.

u comes from a hash of the id, the text and the seed, so reruns agree. Rows that are equal in id, source and text are
interchangeable. The cut of each source is found from sums over bins of the rank, then over finer bins within the bin
that has the cut, then over equal ranks, and rows of equal rank (repeated rows) are dealt over bins by a random number:
neither a source nor a group of repeated rows is ever sorted in one task.

Null texts have size 0 and are never taken. Null ids are told apart by their texts. A null source is a source of its
own, last in order. Tables without rows give no rows. A source whose documents are all empty has target 0. Columns
other than those named are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.common import cut, files_for, placed

WORD = r"[^\x20\x09-\x0D]+"
#: Bins of a level; two levels leave a millionth of a source.
BINS = 1024
#: 13 hexadecimal digits: random numbers that doubles hold exactly.
RANDOM_DIGITS = 13
FILLS = 4
#: Tables of a few rows a source are broadcast up to so many rows, and joined beyond.
BROADCAST_ROWS = 100_000


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from a string."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), key)), 1, RANDOM_DIGITS)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(16**RANDOM_DIGITS))


def rank_value(u: Column, p: Column) -> Column:
    """q / (1 + q) for the odds ratio q = u/(1-u) : p/(1-p); in [0, 1] and increasing in q."""
    a, b = u * (F.lit(1.0) - p), (F.lit(1.0) - u) * p
    return F.when(a + b > 0, a / (a + b)).otherwise(F.lit(1.0))


def targets(sources: DataFrame, max_copies: int = 3) -> DataFrame:
    """Adds target to (source, source_size, weight). Sources above their limit are held at it, round by round; only
    sums over all sources go through the driver."""
    held = sources.withColumn("limit", F.col("source_size") * max_copies).withColumn("held", F.lit(False))
    while True:
        sums = held.agg(F.sum("source_size"), F.sum(F.when(F.col("held"), F.col("limit")).otherwise(0)), F.sum(F.when(F.col("held"), 0).otherwise(F.col("weight")))).first()
        left, weights = (sums[0] or 0) - (sums[1] or 0), sums[2] or 0
        share = (F.lit(left).cast("long") * F.col("weight")).cast("double") / F.lit(float(weights)) if weights else F.lit(0.0)
        held = cut(held.withColumn("share", share).withColumn("new", ~F.col("held") & (F.col("share") > F.col("limit"))), files_for(sources.sparkSession))
        if not held.where("new").head(1):
            break
        held = held.withColumn("held", F.col("held") | F.col("new"))
    target = F.when(F.col("held"), F.col("limit").cast("double")).otherwise(F.col("share"))
    return held.select("source", "source_size", "weight", target.alias("target"))


def expected_copies(sizes: DataFrame, max_copies: int = 3) -> DataFrame:
    """Adds copies to (source, measure, words, source_size, target): the expected copies of a source's documents of a
    measure, c * measure, where c is such that copies * words sum to the target. Measures that reach max_copies are
    held there, round by round. A source has a row for each of its measures, which are few."""
    of_source = Window.partitionBy("source")
    # a source whose target is its limit has all its documents held
    sizes = sizes.withColumn("full", F.col("target") >= F.col("source_size") * max_copies)
    while True:
        free = F.sum(F.when(F.col("full"), 0).otherwise(F.col("measure") * F.col("words"))).over(of_source)
        full = F.sum(F.when(F.col("full"), F.col("words")).otherwise(0)).over(of_source)
        factor = F.when(free > 0, (F.col("target") - (full * max_copies).cast("double")) / free.cast("double")).otherwise(F.lit(0.0))
        sizes = cut(sizes.withColumn("factor", factor).withColumn("new", ~F.col("full") & (F.col("factor") * F.col("measure") >= max_copies)), files_for(sizes.sparkSession))
        if not sizes.where("new").head(1):
            break
        sizes = sizes.withColumn("full", F.col("full") | F.col("new"))
    copies = F.when(F.col("full"), F.lit(float(max_copies))).otherwise(F.col("factor") * F.col("measure"))
    return sizes.withColumn("copies", copies).drop("full", "factor", "new")


def _small(df: DataFrame):
    """A table of a few rows a source, materialised; broadcast if it is small."""
    df = cut(df, files_for(df.sparkSession))
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _cut_bins(rows: DataFrame) -> DataFrame:
    """(_source, cut_bin, before, n): for each source the bin in which the sizes, summed in order of bins, pass `rest`,
    and the number of its rows."""
    sums = rows.groupBy("source", "bin", "rest").agg(F.sum("size").alias("s"), F.count("*").alias("rows"))
    by_bin = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("after", F.sum("s").over(by_bin)).where(F.col("rest") < F.col("after"))
    return sums.groupBy(F.col("source").alias("_source")).agg(F.min("bin").alias("cut_bin"), F.min_by(F.col("after") - F.col("s"), "bin").alias("before"), F.min_by("rows", "bin").alias("n"))


def pareto_sample(rows: DataFrame) -> DataFrame:
    """Adds state (1 taken, 0 not) to rows with source, size, value (the rank), rest (the words to take of the source)
    and salt (different for all rows): in order of value, as many as fit into rest."""
    first = F.least(F.floor(F.col("value") * BINS), F.lit(BINS - 1))
    second = F.least(F.floor((F.col("value") * BINS - first) * BINS), F.lit(BINS - 1))
    done, columns = [], [*rows.columns, "state"]
    for level in (first, second, F.col("value"), F.pmod("salt", F.lit(BINS)), F.col("salt")):
        rows = rows.withColumn("bin", level)
        bins = _small(_cut_bins(rows))
        files = files_for(rows.sparkSession, bins.agg(F.sum("n")).first()[0] or 0)
        joined = rows.join(bins.drop("n"), _same("source", "_source"), "left")
        # a source without a cut takes all
        below = F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin"))
        done.append(joined.where(F.col("cut_bin").isNull() | (F.col("bin") != F.col("cut_bin"))).withColumn("state", below.cast("int")).select(columns))
        rows = cut(joined.where(F.col("bin") == F.col("cut_bin")).withColumn("rest", F.col("rest") - F.col("before")).drop("_source", "cut_bin", "before", "bin"), files)
    return reduce(DataFrame.unionByName, [*done, rows.withColumn("state", F.lit(0)).select(columns)])


def fills(sampled: DataFrame) -> DataFrame:
    """(source, salt) of the documents that fill what the sample leaves: FILLS times, for each source, the first in
    rank of those not taken that fit and fill more than half of the words missing. One that has been chosen is larger
    than what is missing then, so none is chosen twice."""
    gaps = _small(sampled.groupBy(F.col("source").alias("_source")).agg((F.max("left") - F.sum(F.col("size") * F.col("state"))).alias("gap")))
    chosen = []
    for _ in range(FILLS):
        fits = (F.col("size") <= F.col("gap")) & (F.col("size") * 2 > F.col("gap"))
        best = sampled.where("state = 0").join(gaps, _same("source", "_source")).where(fits).groupBy("_source")
        best = _small(best.agg(F.min(F.struct("value", "salt", "size")).alias("best")).select(F.col("_source").alias("_filled"), "best.salt", F.col("best.size").alias("filled")))
        chosen.append(best.select(F.col("_filled").alias("_source"), F.col("salt").alias("_salt")))
        gaps = _small(gaps.join(best.drop("salt"), _same("_source", "_filled"), "left").select("_source", (F.col("gap") - F.coalesce("filled", F.lit(0))).alias("gap")))
    return reduce(DataFrame.unionByName, chosen)


def mix(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_copies: int = 3, seed: str = "mix", measure: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often the mix takes each document.

    weights: (source, weight), weight a whole number above 0; documents of sources that it lacks aren't taken.
    measure: of the documents' columns, a whole number above 0 of few different values.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    # salt differs for all rows and is written with them, so it doesn't change afterwards
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), uniform(key, seed).alias("u"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), *([measure.cast("long").alias("measure")] if measure is not None else []))
    rows = cut(rows if measure is not None else rows.withColumn("measure", F.length(F.bin("size")).cast("long")))
    as_came = max(files_for(docs.sparkSession), rows.rdd.getNumPartitions())

    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = sources.join(weights.select(F.col("source").alias("_w"), "weight"), _same("source", "_w"), "left").drop("_w")
    plan = targets(weighed.select("source", "source_size", F.coalesce("weight", F.lit(0)).cast("long").alias("weight")), max_copies).withColumnRenamed("source", "_source")
    sizes = rows.groupBy("source", "measure").agg(F.sum("size").alias("words")).join(plan, _same("source", "_source")).select("source", "measure", "words", "source_size", "target")
    sizes = expected_copies(sizes, max_copies)
    whole = F.sum(F.floor("copies") * F.col("words")).over(Window.partitionBy("source"))
    sizes = sizes.withColumn("left", F.col("target") - whole.cast("double")).withColumnsRenamed({"source": "_source", "measure": "_measure"}).drop("words")

    rows = rows.join(_small(sizes), _same("source", "_source") & (F.col("measure") == F.col("_measure"))).drop("_source", "_measure", "measure")
    rows = rows.withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.col("whole"))
    may = (F.col("p") > 0) & (F.col("size") > 0)
    ranked = rows.where(may).withColumn("value", rank_value(F.col("u"), F.col("p"))).withColumn("rest", F.col("left"))
    sampled = cut(pareto_sample(ranked.drop("u", "p", "copies")), as_came)
    more = sampled.join(_small(fills(sampled)), (F.col("salt") == F.col("_salt")) & _same("source", "_source"), "left")
    some = more.withColumn("copies", F.col("whole") + F.when(F.col("_salt").isNotNull(), 1).otherwise(F.col("state")))
    none = rows.where(~may).withColumn("copies", F.when(F.col("size") > 0, F.col("whole")).otherwise(F.lit(0)))
    columns = ["doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies")]
    return some.select(columns).unionByName(none.select(columns))


def cyclic_weights(docs: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), source_col: str = "source") -> DataFrame:
    """(source, weight): the sources by code point, null last, weigh as `cycle`, repeating. One row a source."""
    sources = placed(docs.select(F.col(source_col).alias("source")).distinct(), F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("place") % len(cycle) + 1).cast("int"))
    return sources.select("source", weight.cast("long").alias("weight"))
