"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1: its weight times ``1 + slope * (2t - 1)``.
The integral of the schedule is the source's demand; inverting the cumulative demand at a document's
cumulative word offset gives the document's training position, and a range sort by position gives
the training order.

Defined cases: null text and null source are kept (size 0; the null source comes last; ``mixture`` keeps texts of size 0 once); sources
whose texts are empty have target 0; repeated rows are separate documents; an empty table gives an
empty result. Columns of the input other than ``doc_id, text, source`` are not read by ``plan``;
``mixture`` carries them along untouched in a struct, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the contract: weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Start-to-end tilt of the schedules, repeating likewise: the first kind of source fades in, the second out.
SLOPES = (0.5, -0.5, 0.0)
MOST_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the shuffle hash that deal a source out: 16^3 groups, each summed on its own.
DEAL_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cycle(rank: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), ((rank - 1) % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, repeats: int = MOST_REPEATS) -> DataFrame:
    """One row per source: size, weight, slope, target. The windows here run over sources, not documents.

    Water filling: every source gets ``min(repeats * size, level * weight)``; sorted by the level at
    which a source fills up, the level is the first at which the rest can take what is left.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    src = src.select("*", rank.alias("rank"))
    src = src.select("*", _cycle(F.col("rank"), weights).alias("weight"), _cycle(F.col("rank"), slopes).alias("slope"),
                     (F.lit(repeats) * F.col("source_size")).cast("double").alias("cap"))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()).cast("double")
    src = src.select("*", ((total - before) / behind).alias("level"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))
    level = F.min(fits).over(W.partitionBy()).getField("level")
    return src.select("source", "source_size", "weight", "slope",
                      F.least("cap", level * F.col("weight")).alias("target"))


#: What rows are dealt out by, and joined by with plain equality: a null-safe join would deal them out anew by keys of its own.
_DEALT = ["s_key", "s_null", "part"]


def _offsets(d: DataFrame, per_source: DataFrame) -> DataFrame:
    """Adds ``start``: the words of the source's documents before this one, in the order of the shuffle hash, and
    the columns of ``per_source`` (source ``t_``).

    Rows are dealt out by (source, hash prefix), never by source alone; a window runs inside each such
    group, and the totals of the groups are prefix-summed per source and get its columns: the rows meet both in one join.
    """
    sums = d.groupBy("source", *_DEALT).agg(F.sum("size").alias("n"))
    ahead = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    sums = sums.join(per_source, sums.source.eqNullSafe(per_source.t_)).drop("source", "n", "t_")
    inside = W.partitionBy(*_DEALT).orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return d.join(sums, _DEALT).withColumn("start", F.col("base") + F.col("within")).drop(*_DEALT, "base", "within")


def plan(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, repeats: int = MOST_REPEATS, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first position, start, slope per document
    (with ``carry``, the whole input row as ``row``).

    The words taken from a source are its documents laid end to end in hash order, again and again,
    up to the rounded target: every full pass takes a document whole, the last pass may take part of one.
    """
    cols = [F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h")]
    d = docs.select(*cols, *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    # the one exchange of the rows; the sums, the targets, the windows and the join with the offsets below all read it
    source = F.col("source").cast("string")
    d = d.select("*", F.coalesce(source, F.lit("")).alias("s_key"), source.isNull().alias("s_null"), F.substring("h", 1, DEAL_DIGITS).alias("part")).repartition(*_DEALT)
    t = targets(d.groupBy("source", *_DEALT).agg(F.sum("size").alias("size")), weights, slopes, repeats)
    t = t.select(F.col("source").alias("t_"), "source_size", "slope", "target",
                 F.least(F.floor(F.col("target") + 0.5), F.lit(repeats) * F.col("source_size")).cast("long").alias("words"))
    d = _offsets(d, t).drop("h")
    passes = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0))
    d = d.withColumn("passes", passes).withColumn("rest", F.expr("words - passes * source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    d = d.withColumn("taken", (F.col("passes") * F.col("size") + part).cast("long"))
    return d.withColumn("position", F.when(F.col("taken") > 0, position(F.col("start"), F.col("words"), F.col("slope"))))


def position(offset: Column, words: Column, slope: Column) -> Column:
    """The time at which the source's cumulative demand ``words * ((1-k) t + k t^2)`` reaches ``offset``."""
    u = offset.cast("double") / words
    root = (slope - 1 + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u)) / (2 * slope)
    return F.when(slope == 0, u).otherwise(root)


def mixture(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, repeats: int = MOST_REPEATS) -> DataFrame:
    """The training corpus: the rows of ``docs`` (same columns), repeated as taken, range-sorted by position.

    A last, partial pass keeps a document if it takes at least half of its words. Documents without words (size 0) cost
    none: each stays once, at the position of the words before it, or at the end of its source's words if these run out.
    """
    d = plan(docs, weights, slopes, repeats, carry=True)
    times = F.when(F.col("size") > 0, F.expr("cast(floor(taken / size + 0.5) as int)")).otherwise(F.lit(1))
    d = d.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(
        F.array().cast("array<int>"))))
    offset = F.col("copy") * F.col("source_size") + F.col("start")
    offset = F.when(F.col("size") > 0, offset).otherwise(F.least(offset, F.col("words")))
    at = F.when(F.col("words") > 0, position(offset, F.col("words"), F.col("slope"))).otherwise(F.lit(0.0))
    return d.select("row", at.alias("at")).orderBy("at").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
