"""Accuracy of matchers, comparisons between two, and the effect of wider rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def confusion(df: DataFrame, expected: Column, predicted: Column, *by: str) -> DataFrame:
    """tp, fp, fn, tn and rates, for each group; a rate without a denominator is null."""
    n = lambda c: F.sum(c.cast("int")).cast("bigint")
    a = df.withColumn("__e", expected).withColumn("__p", predicted).groupBy(*by).agg(n(F.col("__e") & F.col("__p")).alias("tp"), n(~F.col("__e") & F.col("__p")).alias("fp"), n(F.col("__e") & ~F.col("__p")).alias("fn"), n(~F.col("__e") & ~F.col("__p")).alias("tn"))
    rate = lambda x, y: F.when(y > 0, x / y)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return a.select(*by, "tp", "fp", "fn", "tn", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(fp, fp + tn).alias("fpr"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"), rate(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def buckets(df: DataFrame, expected: Column, ours: Column, other: Column, by: str) -> DataFrame:
    """Who is right, in one row for each group."""
    a, b = ours == expected, other == expected
    kind = F.when(a & b, "both_right").when(a, "engine_only").when(b, "other_only").otherwise("both_wrong")
    names = ["both_right", "engine_only", "other_only", "both_wrong"]
    return df.withColumn("__k", kind).groupBy(by).pivot("__k", names).count().na.fill(0, names)


def overlap(false_positives: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Each id with the side or sides it is on."""
    a = false_positives.select(key).distinct().withColumn("fp", F.lit(True))
    b = removed.select(key).distinct().withColumn("removed", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("fp") & F.col("removed"), "both").when(F.col("fp"), "fp_only").otherwise("removed_only").alias("side"))


def match_count_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n == 1, "1").otherwise("2+")


def category(rationale: Column, levels: int = 1) -> Column:
    return F.substring_index(F.substring_index(rationale, "/", 1), " ", 1) if levels == 1 else F.substring_index(rationale, "/", levels)


def redecide(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.withColumn("matched", F.col(score) >= threshold)
