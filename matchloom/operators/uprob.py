"""How often two people agree by chance, from counts and probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import similarity as sim
from .blocking import deletions


def from_counts(counts: DataFrame, n: str = "n") -> DataFrame:
    """``u_simple, u_unbiased, total, distinct_values`` of a table of counts."""
    x = F.col(n).cast("double")
    a = counts.agg(F.sum(x * x).alias("sq"), F.sum(x * (x - 1)).alias("pairs"), F.sum(x).alias("t"), F.count("*").alias("distinct_values"))
    return a.select((F.col("sq") / (F.col("t") * F.col("t"))).alias("u_simple"), F.when(F.col("t") > 1, F.col("pairs") / (F.col("t") * (F.col("t") - 1))).otherwise(0.0).alias("u_unbiased"), F.col("t").cast("bigint").alias("total"), "distinct_values")


def u_exact(df: DataFrame, column: str) -> DataFrame:
    return from_counts(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")))


def u_initial(df: DataFrame, column: str) -> DataFrame:
    first = F.upper(F.substring(F.trim(column), 1, 1))
    return from_counts(df.select(first.alias("i")).where(F.col("i").rlike("^[A-Z]$")).groupBy("i").agg(F.count("*").alias("n")))


def with_unlisted(counts: DataFrame, unlisted: int, n: str = "n") -> DataFrame:
    """Bounds when some people have names that are not listed: each a singleton, or left out."""
    x = F.col(n).cast("double")
    a = counts.agg(F.sum(x * x).alias("sq"), F.sum(x * (x - 1)).alias("pairs"), F.sum(x).alias("t"))
    t = F.col("t") + unlisted
    return a.select((F.col("pairs") / (t * (t - 1))).alias("u_unbiased"), ((F.col("sq") + unlisted) / (t * t)).alias("u_simple"), (F.col("pairs") / (F.col("t") * (F.col("t") - 1))).alias("u_listed_only"), (F.col("t") / t).alias("coverage"))


def ball_mass(names: DataFrame, name: str = "name", p: str = "p", least: int = sim.MIN_FUZZY) -> DataFrame:
    """Of each name of at least ``least`` letters the probability of the others within one edit."""
    own = names.select(F.col(name).alias("name"), F.col(p).alias("p")).where(F.length("name") >= least)
    keyed = own.select("name", "p", F.explode(deletions(F.col("name"))).alias("key"))
    pairs = keyed.alias("a").join(keyed.alias("b"), "key").where("a.name <> b.name").select(F.col("a.name").alias("name"), F.col("b.name").alias("other"), F.col("b.p").alias("q")).distinct()
    near = pairs.where(sim.dl1(F.col("name"), F.col("other"))).groupBy("name").agg(F.sum("q").alias("ball"))
    return own.join(near, "name", "left").select("name", "p", F.coalesce("ball", F.lit(0.0)).alias("ball"))


def u_fuzzy(df: DataFrame, column: str, least: int = sim.MIN_FUZZY) -> DataFrame:
    """Agreement within one edit, as the square of probabilities and without bias."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count("*").cast("double").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    ball = ball_mass(counts, "name", "n", least).select("name", "ball")
    each = counts.join(ball, "name", "left").select("n", F.coalesce("ball", F.lit(0.0)).alias("ball")).crossJoin(F.broadcast(total))  # one row
    return each.groupBy("t").agg(F.sum(F.col("n") * (F.col("n") + F.col("ball"))).alias("a"), F.sum(F.col("n") * (F.col("n") - 1 + F.col("ball"))).alias("b")).select((F.col("a") / (F.col("t") * F.col("t"))).alias("u_simple"), F.when(F.col("t") > 1, F.col("b") / (F.col("t") * (F.col("t") - 1))).otherwise(0.0).alias("u_unbiased"))


def top_share(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.orderBy(F.col("n").desc(), "value").limit(k).crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("t")).alias("share"))


def year_of_birth(agesex: DataFrame, reference_year: int = 2025, least_age: int = 0) -> DataFrame:
    """Birth years from a table by sex and age (sex 0: both; age 999: all)."""
    own = agesex.where((F.col("SEX") == 0) & (F.col("AGE") != 999) & (F.col("AGE") >= least_age))
    return own.select((F.lit(reference_year) - F.col("AGE")).alias("year"), F.col(f"POPESTIMATE{reference_year}").alias("n"))


def dob_u(years: DataFrame, variant: str) -> DataFrame:
    """Agreement on a date of birth: exact, pm1day, swap or dl1. years: (year, n), days of a year alike."""
    total = years.agg(F.sum("n").cast("double").alias("t"))
    day = F.explode(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))).alias("d")
    length = F.dayofyear(F.make_date("year", F.lit(12), F.lit(31)))
    days = years.crossJoin(F.broadcast(total)).select("year", (F.col("n") / F.col("t") / length).alias("p"), day).select("d", "p")
    d = F.col("d")
    near = [F.date_add(d, 1), F.date_add(d, -1)]
    if variant in ("swap", "dl1"):
        near.append(F.when(F.dayofmonth(d) <= 12, F.make_date(F.year(d), F.dayofmonth(d), F.month(d))))
    if variant == "exact":
        return days.agg(F.sum(F.col("p") * F.col("p")).alias("u"))
    others = F.array_distinct(F.array_compact(F.array(*near)))
    if variant == "dl1":
        others = F.array_union(others, _digit_edits(d))
    others = F.filter(others, lambda x: x != F.col("d"))
    pairs = days.select("d", "p", F.explode_outer(others).alias("e")).join(days.select(F.col("d").alias("e"), F.col("p").alias("q")), "e", "left")
    return pairs.groupBy("d", "p").agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("ball")).agg(F.sum(F.col("p") * (F.col("p") + F.col("ball"))).alias("u"))


def _digit_edits(d):
    """Dates whose eight digits are one substitution or one exchange of neighbours away."""
    s = F.date_format(d, "yyyyMMdd")
    digit = F.sequence(F.lit(0), F.lit(9))
    put = lambda i, x: F.concat(F.substr(s, F.lit(1), i - 1), x, F.substr(s, i + 1))
    subs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.transform(digit, lambda x: put(i, x.cast("string")))))
    turns = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1, F.lit(1)), F.substr(s, i, F.lit(1)), F.substr(s, i + 2)))
    return F.array_distinct(F.array_compact(F.transform(F.concat(subs, turns), lambda x: F.try_to_timestamp(x, F.lit("yyyyMMdd")).cast("date"))))


def street_given_zip(zips: DataFrame) -> DataFrame:
    """Population-weighted chance (h - 1) / (p - 1) that two people of a ZIP share a household. zips: (population, household_size)."""
    chance = F.greatest(F.lit(0.0), (F.col("household_size") - 1) / (F.col("population") - 1))
    return zips.where("population > 1").agg((F.sum(F.col("population") * chance) / F.sum("population")).alias("u"))


def sanity(u: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rows outside the range that a probability must keep."""
    return u.where(~F.col("u").between(low, high))


def from_probabilities(df: DataFrame, p: str = "p") -> DataFrame:
    """``u``: the sum of squares."""
    return df.agg(F.sum(F.col(p) * F.col(p)).alias("u"))


def dob_by_year(year_u: DataFrame, u: str = "u_unbiased") -> DataFrame:
    """The chance of the same day from that of the same year, days of a year being alike."""
    return year_u.select((F.col(u) / 365.25).alias("u"))


def with_outside(counts: DataFrame, outside: float, n: str = "n") -> DataFrame:
    """Bounds for places that cover a part of all people: the covered ones alone, and all others as one of a kind each."""
    x, extra = F.col(n).cast("double"), float(round(max(outside, 0)))
    a = counts.agg(F.sum(x * (x - 1)).alias("pairs"), F.sum(x).alias("t"))
    t = F.col("t")
    return a.select((F.col("pairs") / (t * (t - 1))).alias("u_covered"), (F.col("pairs") / ((t + extra) * (t + extra - 1))).alias("u_all"), (t / (t + extra)).alias("coverage"))


def street_by_household(zips: DataFrame, size: str = "size", households: str = "households") -> DataFrame:
    """Chance that two people of a ZIP share a household, from households (zip, population, size, households) by size."""
    s = F.col(size).cast("double")
    each = zips.where("population > 1").groupBy("zip").agg(F.sum(F.col(households) * s * (s - 1)).alias("pairs"), F.max("population").cast("double").alias("p"))
    return each.agg((F.sum("pairs") / F.sum(F.col("p") * (F.col("p") - 1))).alias("u"))


# How many values the last four digits take.
LAST4 = 9999


def scalars(street_with_zip: float, landline: float, enrolled: float) -> dict[str, float]:
    """Chances that follow from one number each: a shared phone is a shared household's landline, the last four digits are alike, a beneficiary number is one of all."""
    return {"phone": street_with_zip * landline, "ssn_last4": 1 / LAST4, "itin_last4": 1 / LAST4, "mbi": 1 / enrolled}
