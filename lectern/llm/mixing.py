"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source is to give a target number of words. Among all document rates between 0 and ``most`` that meet the
targets, entropy balancing takes those that stray least (in relative entropy) from one copy of everything. They have
the form ``exp(lambda * size)``, cut at ``most``, with one multiplier for each source; the multipliers solve a convex
dual, found here by safeguarded Newton steps that are distributed sums over a histogram of document sizes.

Rates become whole copies by comparing their fractions with a fixed number drawn from each document's id and text. What
that adds or lacks is then corrected in rounds: among the documents no larger than the gap, those whose next draw lies
below a threshold get one copy more (or less). The threshold is read from running sums over narrow ranges of the draw,
so a correction never exceeds the gap, and rounds end when no document fits into what is left of it. A document's
copies depend on its own draws and its source's few numbers alone, so documents needn't be shuffled or grouped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD, discarded, free_name, scratch, written

#: Weights of the sources in the order of their names' code points, null last, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this, and no source's target exceeds this many times its size.
MOST = 3
NEWTON_STEPS, NEWTON_ERROR = 40, 1e-9
#: Rounds of corrections at most (each closes half of a source's gap at least, all but surely), the share of a target
#: at which a gap is closed, and ranges of the draw whose sums are taken in a round.
ROUNDING_STEPS, ROUNDING_ERROR, RANGES = 40, 1e-6, 512
#: A multiplier that takes a source's documents as often as allowed.
_ALL = 1e12
_CORRECTIONS = "array<struct<round:int,sign:int,largest:double,below:double>>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(sources: DataFrame, name: str = "mix-sources") -> DataFrame:
    """``sources`` (``source`` and more, one row each) with ``number``, its place by code points from 0, null last.

    Rows are dealt in order; a row's place is its place in its partition, after all rows of the partitions before.
    """
    order = F.col("source").asc_nulls_last()
    dealt = sources.repartitionByRange(order).sortWithinPartitions(order).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    dealt = written(dealt, name)
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    starts = parts.select(F.col("part").alias("of_part"), (before - F.col("first")).alias("shift"))
    return dealt.join(F.broadcast(starts), F.col("part") == F.col("of_part")).withColumn("number", F.col("at") + F.col("shift")).drop("part", "at", "of_part", "shift")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``totals`` (source, source_size) with each source's target.

    The words of all sources are shared by weight; a target stops at ``most`` times its source's size and the excess
    is shared again until none is above. The level (words for a unit of weight) rises with each sharing; sources whose
    cap it reaches stop there. A sharing is one sum over the sources.
    """
    named = numbered(totals).withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("number") % len(weights) + 1).cast("int")))
    named = written(named.drop("number").withColumn("cap", F.col("source_size").cast("double") * most), "mix-weights")
    level, words = 0.0, float(named.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        full = F.col("cap") <= F.col("weight") * level
        held, free = named.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        risen = (words - held) / free if free else level
        if risen <= level:
            return named.withColumn("target", F.least("cap", F.col("weight") * level)).drop("cap", "weight")
        level = risen


def rate(size: Column, multiplier: Column, scale: Column, most: int = MOST) -> Column:
    return F.exp(F.least(multiplier * size / scale, F.lit(math.log(most))))


def drawn(seed: Column, number: Column) -> Column:
    """A number in [0, 1), fixed by a document's seed and the number of the draw."""
    return F.shiftrightunsigned(F.xxhash64(seed, number), 11).cast("double") / F.lit(float(2**53))


def seed(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text, F.lit("mix"))


def copies(size: Column, seed: Column, multiplier: Column, scale: Column, corrections: Column, most: int = MOST) -> Column:
    """A document's copies: its rate, rounded by its first draw, and its source's corrections in order."""
    whole = F.least(F.lit(most), F.floor(rate(size, multiplier, scale, most) + drawn(seed, F.lit(0)))).cast("int")

    def corrected(now: Column, c: Column) -> Column:
        chosen = (size > 0) & (size <= c["largest"]) & (drawn(seed, c["round"]) < c["below"]) & (now + c["sign"]).between(0, most)
        return now + F.when(chosen, c["sign"]).otherwise(F.lit(0))

    return F.aggregate(corrections, whole, corrected)


def _stepped(state: DataFrame, sums: DataFrame) -> DataFrame:
    """``state`` after one Newton step of the multiplier on the logarithm of the words found, kept between known bounds."""
    x = F.col("multiplier")
    s = state.join(sums, state["source"].eqNullSafe(sums["of_source"]), "left")
    gap = F.log(F.greatest(F.coalesce(F.col("found"), F.lit(0.0)), F.lit(0.5))) - F.log(F.greatest(F.col("target"), F.lit(0.5)))
    s = s.withColumn("gap", F.when(F.col("fixed"), F.lit(0.0)).otherwise(gap))
    better, under, over = F.abs(F.col("gap")) < F.col("best_gap"), (F.col("gap") < 0) & (x > F.col("low")), (F.col("gap") > 0) & (x < F.col("high"))
    s = s.withColumns(
        {
            "best": F.when(better, x).otherwise(F.col("best")),
            "best_gap": F.when(better, F.abs(F.col("gap"))).otherwise(F.col("best_gap")),
            "low": F.when(under, x).otherwise(F.col("low")),
            "high": F.when(over, x).otherwise(F.col("high")),
        }
    )
    newton = x - F.try_divide(F.col("gap") * F.col("found"), F.col("slope"))
    middle = (F.col("low") + F.col("high")) / 2
    wide = F.when((F.col("low") > -_ALL) & (F.col("high") < _ALL), middle).when(F.col("gap") < 0, x + F.abs(x) + 1).otherwise(x - F.abs(x) - 1)
    inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high")) & ~F.isnan(newton)
    return s.withColumn("multiplier", F.when(F.col("fixed") | (F.col("gap") == 0), x).when(inside, newton).otherwise(wide))


def _solved(histogram: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """``state`` (source, target, scale, multiplier, ...) with the multipliers that meet the targets at the rates themselves."""
    columns = state.columns
    start = {"low": F.lit(-_ALL), "high": F.lit(_ALL), "best": F.col("multiplier"), "best_gap": F.lit(1e300)}
    state = written(state.withColumns(start), "mix-targets")
    free = F.col("multiplier") * F.col("size") / F.col("scale") < math.log(most)
    words = rate(F.col("size"), F.col("multiplier"), F.col("scale"), most) * F.col("size") * F.col("n")
    for _ in range(NEWTON_STEPS):
        at = state.select(F.col("source").alias("at_source"), "multiplier", "scale")
        slope = F.sum(F.when(free, words * F.col("size") / F.col("scale")).otherwise(F.lit(0.0)))
        sums = histogram.join(at, histogram["source"].eqNullSafe(at["at_source"])).groupBy(F.col("source").alias("of_source")).agg(F.sum(words).alias("found"), slope.alias("slope"))
        last, state = state, written(_stepped(state, sums).select(*state.columns), "mix-dual")
        discarded(last)
        worst = state.agg(F.max(F.when(~F.col("fixed"), F.col("best_gap"))).alias("gap")).first()["gap"]
        if worst is None or worst <= NEWTON_ERROR:
            break
    return state.withColumn("multiplier", F.round("best", 12)).select(*columns)


def _corrected(rows: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """``state`` (source, target, multiplier, scale) with the ``corrections`` that bring whole copies near the targets.

    A round reads ``rows`` (source, size, seed) twice: for the words taken and those of documents that may change, by
    size; then, where a gap is left, for sums of what may change over ranges of the next draw. The ranges are dealt so
    that they hold about four times the gap, and end where their running sum would exceed it.
    """
    state = written(state.withColumn("corrections", F.array().cast(_CORRECTIONS)), "mix-rounding")
    now = copies(F.col("size"), F.col("seed"), F.col("multiplier"), F.col("scale"), F.col("corrections"), most)
    for step in range(1, ROUNDING_STEPS + 1):
        at = state.select(F.col("source").alias("at_source"), "multiplier", "scale", "corrections")
        held = rows.filter("size > 0").join(at, rows["source"].eqNullSafe(at["at_source"])).select("source", "size", "seed", now.alias("now"))
        words = lambda which: F.sum(F.when(which, F.col("size")).otherwise(F.lit(0)))
        by_size = held.groupBy("source", "size").agg(F.sum(F.col("now") * F.col("size")).alias("taken"), words(F.col("now") < most).alias("up"), words(F.col("now") > 0).alias("down"))
        by_size = written(by_size, "mix-by-size")
        taken = by_size.groupBy(F.col("source").alias("of")).agg(F.sum("taken").alias("taken"))
        gaps = state.join(taken, state["source"].eqNullSafe(taken["of"]), "left").select(state["source"].alias("of"), (F.col("target") - F.coalesce("taken", F.lit(0))).alias("gap"), "target")
        gaps = gaps.filter(F.abs("gap") > F.col("target") * ROUNDING_ERROR)
        fitting = by_size.join(gaps, by_size["source"].eqNullSafe(gaps["of"])).filter(F.col("size") <= F.abs("gap"))
        fitting = fitting.groupBy("of", "gap").agg(F.sum(F.when(F.col("gap") > 0, F.col("up")).otherwise(F.col("down"))).alias("may")).filter("may > 0")
        sign = F.when(F.col("gap") > 0, 1).otherwise(-1)
        fitting = written(fitting.select("of", F.abs("gap").alias("gap"), sign.alias("sign"), F.least(F.lit(1.0), F.abs("gap") * 4 / F.col("may")).alias("span")), "mix-gaps")
        if fitting.isEmpty():
            break
        draw = drawn(F.col("seed"), F.lit(step))
        may = held.join(fitting, held["source"].eqNullSafe(fitting["of"])).filter((F.col("size") <= F.col("gap")) & (draw < F.col("span")) & (F.col("now") + F.col("sign")).between(0, most))
        ranges = may.groupBy("of", "gap", "sign", "span", F.floor(draw / F.col("span") * RANGES).alias("range")).agg(F.sum("size").alias("words"))
        so_far = F.sum("words").over(Window.partitionBy("of").orderBy("range"))  # at most RANGES rows for each source
        below = ranges.withColumn("so_far", so_far).filter("so_far <= gap").groupBy("of", "gap", "sign", "span").agg(F.max("range").alias("last"))
        more = below.select("of", F.struct(F.lit(step).alias("round"), "sign", F.col("gap").alias("largest"), ((F.col("last") + 1) / RANGES * F.col("span")).alias("below")).alias("correction"))
        longer = F.when(F.col("correction").isNull(), F.col("corrections")).otherwise(F.concat("corrections", F.array("correction").cast(_CORRECTIONS)))
        after = state.join(more, state["source"].eqNullSafe(more["of"]), "left").withColumn("corrections", longer).select(*state.columns)
        last, state = state, written(after, "mix-rounding")
        for table in (last, by_size, fitting):
            discarded(table)
    return state


def multipliers(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Each source's size and target, and what its documents' copies depend on: ``multiplier, scale, corrections``."""
    rows = docs.select(F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), seed(F.col(doc_id), F.col(text)).alias("seed"))
    rows = written(rows, "mix-sizes")
    histogram = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    goal = targets(totals, weights, most)
    full = F.col("target") >= F.col("source_size") * most * (1 - 1e-12)
    state = goal.select(
        "source",
        "source_size",
        "target",
        F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9)).alias("scale"),
        (full | (F.col("source_size") == 0) | (F.col("target") <= 0)).alias("fixed"),
        F.when(F.col("source_size") == 0, 0.0).when(full, _ALL).when(F.col("target") <= 0, -_ALL).otherwise(0.0).alias("multiplier"),
    )
    return _corrected(rows, _solved(histogram, state, most).drop("fixed"), most)


def taken(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, most: int = MOST, out: str = "copies") -> DataFrame:
    """``docs`` with ``out``, the copies that the mix takes, and ``size``, ``source_size``, ``target``.

    Nulls: a null text has no words; null sources form one source, last in order; null ids are drawn by their text.
    Rows that repeat in id and text round alike. A source without words has target 0. An empty table gives an empty
    result. Columns of ``docs`` that bear a result's name are replaced.
    """
    names = ("source", "source_size", "target", "multiplier", "scale", "corrections")
    with scratch():
        solved = written(multipliers(docs, text, source, doc_id, weights, most).select(*names), "mix-solved", lasting=True)
    of = F.struct(*names)
    held, key, counted = (free_name(docs, stem) for stem in ("mix_of_source", "mix_source", "mix_size"))
    solved = solved.select(F.col("source").alias(key), of.alias(held))
    joined = docs.withColumn(counted, word_count(F.col(text))).join(solved, docs[source].cast("string").eqNullSafe(solved[key]), "left")
    whole = copies(F.col(counted), seed(F.col(doc_id), F.col(text)), *[F.col(f"{held}.{c}") for c in names[3:]], most)
    results = {"size", "source_size", "target", out.lower()}
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in results],
        F.col(counted).alias("size"),
        F.col(f"{held}.source_size").alias("source_size"),
        F.col(f"{held}.target").alias("target"),
        whole.alias(out),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: every document as many times as its copies, none for 0."""
    out = free_name(docs, "copies_taken")
    kept = taken(docs, out=out, **options)
    again = free_name(kept, "copy_number")
    return kept.filter(F.col(out) > 0).withColumn(again, F.explode(F.sequence(F.lit(1), F.col(out)))).select(*[F.col(f"`{c}`") for c in docs.columns])
