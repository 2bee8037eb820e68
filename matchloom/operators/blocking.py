"""Fuzzy and near-date joins as equi-joins on neighbourhood keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import similarity as sim


def deletions(s: Column) -> Column:
    """A string and all that one deletion leaves; strings at distance one share one of these."""
    cut = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
    return F.array_distinct(F.concat(F.array(s), F.when(F.length(s) > 0, cut).otherwise(F.array().cast("array<string>"))))


def fuzzy_join(left: DataFrame, right: DataFrame, a: str, b: str, least: int = sim.MIN_FUZZY) -> DataFrame:
    """Distinct pairs of values (a, b) within one edit, both at least ``least`` long."""
    l = left.select(a).where(F.length(a) >= least).distinct().select(a, F.explode(deletions(F.col(a))).alias("key"))
    r = right.select(b).where(F.length(b) >= least).distinct().select(b, F.explode(deletions(F.col(b))).alias("key"))
    return l.join(r, "key").select(a, b).distinct().where(sim.dl1(F.col(a), F.col(b)))


def near_days_join(left: DataFrame, right: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """Rows whose dates are at most a day apart, by three keys a row."""
    days = F.array(*[F.date_format(F.date_add(sim.day(F.col(a)), i), "yyyy-MM-dd") for i in (-1, 0, 1)])
    l = left.select(F.col(by).alias("left_id"), a, F.explode(days).alias("key"))
    return l.join(right.select(F.col(by).alias("right_id"), b), F.col("key") == F.col(b)).drop("key")
