"""Spelling variant grouping by permuterm rotations.

A word with a terminator behind it has one rotation per place: ``y$x`` for every ``word = xy``. Two words that
differ in one replaced code point, ``xay`` and ``xby``, have rotations ``y$x + a`` and ``y$x + b``: one prefix, the
edited code point skipped. An inserted code point, ``xcy`` against ``xy``, is the prefix ``y$x`` of one word that is
a whole rotation of the other. So every word puts its whole rotations and its rotations without the last code
point into one sorted table, and a scan over the groups of equal prefixes meets all neighbours. A group has one
whole rotation at most and one word per letter of the alphabet (90 for the pattern below), whatever the corpus;
each member reads how many neighbours it has there and its best one, so pairs are never listed.

Where a word has a run of one letter, leaving out any of them gives the same shorter word: only the first counts
for insertions and deletions (replacements differ in one place by nature), so no pair is counted twice.

Defined cases: null and empty texts have no words; a null doc_id counts as the empty text; repeated rows count as
often as they occur; ties go to the smaller word in code-point order; words without neighbours stay, as their own
root; an empty table gives an empty result. Columns other than ``doc_id, text`` are not read. A text's words are
made in one row, so a text must fit into a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from featlens.session import materialize

#: The alphabet of a word (fixed by the contract), without the quantifier.
LETTER = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sorts before every letter and is none.
END = "$"
SHORTEST, LEAST, RATIO, DAMAGE = 6, 5, 5, 199


def runs(docs: DataFrame, shortest: int = SHORTEST, damage: int | None = None) -> DataFrame:
    """``(word)``: one row for each maximal run of letters of ``shortest`` code points or more, A-Z lower-cased.

    With ``damage``, a run whose hash ``crc32("<doc_id>:<run>")`` the number divides loses its code point ``hash % length``.
    Shorter runs are left out by the pattern already: damage makes none longer.
    """
    d = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                    F.explode(F.regexp_extract_all("text", F.lit(f"{LETTER}{{{shortest},}}"), F.lit(0))).alias("run"))
    d = d.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    if not damage:
        return d.select(F.col("run").alias("word"))
    d = d.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return d.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)


def count(words: DataFrame, least: int = LEAST) -> DataFrame:
    """``(word, n)`` of the words that occur ``least`` times or more; a frequent word is summed before the exchange."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """``(key, skips, word, n, first)``: whole rotations (``skips`` 0) and rotations without their last code point (1).

    ``first`` marks the first letter of a run of equal ones as the one left out."""
    i, w = F.col("i"), F.col("word")
    d = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    head = F.substring(w, F.lit(1), i)
    whole = F.struct(F.lit(0).alias("skips"), F.concat(F.substring(w, i + 1, F.length(w)), F.lit(END), head).alias("key"), F.lit(False).alias("first"))
    new = (i == 0) | (F.substring(w, i, F.lit(1)) != F.substring(w, i + 1, F.lit(1)))
    less = F.struct(F.lit(1).alias("skips"), F.concat(F.substring(w, i + 2, F.length(w)), F.lit(END), head).alias("key"), new.alias("first"))
    both = F.when(i < F.length(w), F.array(whole, less)).otherwise(F.array(whole))
    return d.select("word", "n", F.explode(both).alias("r")).select("r.key", "r.skips", "word", "n", "r.first")


def neighbours(words: DataFrame) -> DataFrame:
    """``(word, n_near, best)`` of the words ``(word, n)`` that have neighbours: their number and the one of
    largest ``n`` (ties: the smaller word) as ``struct(minus, word)``.

    One exchange by rotation sorts the table; a group's first rows are its whole rotation, if any, and then the
    most frequent of the words that skip a letter.
    """
    d = rotations(words).select("key", "skips", "first", F.struct((-F.col("n")).alias("minus"), "word").alias("me"))
    group = W.partitionBy("key").orderBy("skips", "me")
    entire = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = d.select("skips", "first", "me", F.count(F.lit(1)).over(entire).alias("rows"), F.sum(F.col("first").cast("int")).over(entire).alias("firsts"),
                 F.min("skips").over(entire).alias("least"), *[F.nth_value("me", k).over(entire).alias(f"m{k}") for k in (1, 2, 3)])
    d = d.where("rows > 1")
    has = F.col("least") == 0
    skipping = F.col("rows") - has.cast("int")      # members of the group that skip a letter
    top, second = F.when(has, F.col("m2")).otherwise(F.col("m1")), F.when(has, F.col("m3")).otherwise(F.col("m2"))
    other = F.when(F.col("me") == top, second).otherwise(top)
    shorter = F.when(has & F.col("first"), F.col("m1"))
    whole = F.col("skips") == 0
    near = F.when(whole, F.col("firsts")).otherwise(skipping - 1 + (has & F.col("first")).cast("int"))
    best = F.when(whole, top).when(shorter.isNull() | (other < shorter), other).otherwise(shorter)
    d = d.select(F.col("me.word").alias("word"), near.alias("near"), best.alias("best")).where("near > 0")
    return d.groupBy("word").agg(F.sum("near").cast("long").alias("n_near"), F.min("best").alias("best"))


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``(word, n)``: its neighbours and its group.

    A word's form is its best neighbour if that occurs ``ratio`` times as often; its root is the end of the forms.
    A step up the forms multiplies the count by ``ratio`` (2 or more), so the ends are reached after few doublings.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could run in a circle")
    words = materialize(words)
    d = words.join(neighbours(words).withColumnRenamed("word", "w_"), F.col("word") == F.col("w_"), "left")
    best = -F.col("best.minus")
    good = best >= ratio * F.col("n")
    d = materialize(d.select("word", F.when(good, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                             F.when(good, best).alias("form_n")))
    ends = roots(d.where("form is not null").select("word", "form"))
    return d.join(ends.withColumnRenamed("word", "w_"), F.col("word") == F.col("w_"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for every word of ``(word, form)``: where the chain of forms ends (there are no circles)."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("w_"), F.col("root").alias("r_"))
        at = materialize(at.join(ahead, at.root == ahead.w_, "left").select("word", F.coalesce("r_", "root").alias("root"), F.col("r_").isNotNull().alias("went")))
        if at.where("went").limit(1).count() == 0:
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, *, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, damage: int | None = None) -> DataFrame:
    """The spelling variants of the words of ``docs``."""
    return group(count(runs(docs, shortest, damage), least), ratio)
