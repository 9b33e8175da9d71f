"""Operator 13: what filters remove in every order in which they can be applied.

Documents become masks of failed filters, counted in cells (part, mask, labels). The cells are unpivoted against the
steps of all orders; a running bit-or over the steps before tells which documents are gone by then.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filters in the order of their bits.
NAMES = "ABCDE"
_WORD_GAP = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a non-null text fails: short, repetitive, loud, with symbols."""
    words = F.array_remove(F.split(text, _WORD_GAP), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def bits(w: Column) -> Column:
        short = F.size(w) < 200
        repetitive = 100 * F.size(F.array_distinct(w)).cast("long") < 50 * F.size(w).cast("long")
        return short.cast("int") + 2 * repetitive.cast("int")

    # One pass over the array: the words are bound once as the only element of an outer array.
    by_words = F.get(F.transform(F.array(words), bits), F.lit(0))
    loud = 100 * capitals.cast("long") > 3 * F.length(text).cast("long")
    return by_words + 4 * loud.cast("int") + 8 * F.regexp_like(text, F.lit(r"[#$%&*|]")).cast("int")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: documents by language, failed filters and labels.

    E fails where a smaller doc_id has the same text; texts are told apart by SHA-256 and size. Texts themselves are
    never shuffled, and copies of a text meet as counts only, so a text of a third of all rows is no hot group.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")
    ).where("doc_id is not null")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.struct(F.unhex(F.sha2(text.cast("binary"), 256)), F.octet_length(text)).alias("key"), failures(text).alias("mask")
    )
    joined = rows.join(known, "doc_id", "left").select("doc_id", "part", "key", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    by = ["key", "part", "mask", "good", "toxic"]
    # Rows that repeat a doc_id are counted first, so that the least doc_id of a group brings the number of its rows.
    each = joined.groupBy(*by, "doc_id").agg(F.count("*").alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")
    groups = each.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min(first).alias("first"))
    # Of one text there are at most as many groups as parts times labels.
    groups = groups.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("key")))
    fresh = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = groups.select("part", "mask", "good", "toxic", F.explode(F.array(F.struct(F.lit(0).alias("e"), fresh.alias("n")), F.struct(F.lit(16).alias("e"), (F.col("n") - fresh).alias("n")))).alias("x"))
    counted = split.groupBy("part", (F.col("mask") + F.col("x.e")).alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))
    return counted.where("n > 0")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every part
    (language; null: empty), each of the 120 orders of five filters and each step.

    Null texts are empty: they fail A, and E if a smaller doc_id is empty or null, too. A null doc_id is no copy of
    another and makes none; rows that repeat a doc_id with its text are all first or all copies. Of repeated labels a
    document is good or toxic if one says so; null labels say nothing. An empty table gives no row. Other columns are
    ignored. Texts are counted whole; a text's words are held in one task, about 60 bytes a word.
    """
    orders = F.array(*(F.lit("".join(p)) for p in itertools.permutations(NAMES)))
    long = cells(docs, labels).withColumn("filter_order", F.explode(orders))
    long = long.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(NAMES)))).alias("step"))
    bit = F.expr(f"shiftleft(1, instr('{NAMES}', substring(filter_order, step, 1)) - 1)")
    long = long.withColumn("hit", F.col("mask").bitwiseAND(bit)).withColumn("bit", bit)
    before = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("gone", F.coalesce(F.bit_or("hit").over(before), F.lit(0)))
    fails, here = F.col("hit") > 0, (F.col("hit") > 0) & (F.col("gone") == 0)
    total = lambda on: F.sum(F.when(on, F.col("n")).otherwise(0))
    steps = long.groupBy("part", "filter_order", "step").agg(
        total((F.col("hit") == 0) & (F.col("gone") == 0)).alias("kept"),
        total(here).alias("removed"),
        total(fails & (F.col("gone") > 0)).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here & (F.col("good") == 1)).alias("good_lost"),
        total(here & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    same = Window.partitionBy("part", F.expr("substring(filter_order, step, 1)"))
    return steps.withColumn("shapley", F.sum("removed").over(same))
