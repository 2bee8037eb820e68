"""Reports over labelled results, registries and daily tables, and the sinks they go to."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, functions as F

from . import evaluation

# ---------------------------------------------------------------- two matchers


def two_matchers(rows: DataFrame, matchers: dict[str, str], *by: str) -> DataFrame:
    """Confusion and rates of each matcher (name: column of its decision, null where it failed), for each group."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("matcher"), F.col(c).alias("said")) for k, c in matchers.items()]))
    long = rows.select("expected", *by, each.alias("m")).select("expected", *by, "m.*")
    errors = long.groupBy("matcher", *by).agg(F.count_if(F.col("said").isNull()).alias("errors"))
    return evaluation.confusion(long.where("said is not null"), F.col("expected"), F.col("said"), "matcher", *by).join(errors, ["matcher", *by], "right")


def disagreements(rows: DataFrame, ours: str, other: str) -> DataFrame:
    """Rows on which at least one of two matchers is wrong, with who is right."""
    a, b = F.col(ours) == F.col("expected"), F.col(other) == F.col("expected")
    bucket = F.when(a & b, "both_right").when(a, "engine_only").when(b, "other_only").otherwise("both_wrong")
    return rows.withColumn("bucket", bucket).where("bucket <> 'both_right'")


def by_levels(rows: DataFrame, *levels: str) -> DataFrame:
    """Counts of tp, fp, fn and tn over all, by the first level, and by all levels, in one pass; ``level`` says which."""
    n = lambda c: F.count_if(c)
    e, p = F.col("expected"), F.col("predicted")
    sets = [[], [levels[0]], list(levels)] if len(levels) > 1 else [[], list(levels)]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in levels]).agg(F.grouping_id().alias("g"), n(e & p).alias("tp"), n(~e & p).alias("fp"), n(e & ~p).alias("fn"), n(~e & ~p).alias("tn"))
    shut = (1 << len(levels)) - 1
    level = F.when(F.col("g") == shut, "all").when(F.col("g") == 0, levels[-1]).otherwise(levels[0])
    return out.select(level.alias("level"), *levels, "tp", "fp", "fn", "tn")


# ---------------------------------------------------------------- sinks


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; at most ``most`` rows, as a report is for reading."""
    cell = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in df.limit(most).collect())]) + "\n"


def metrics_json(df: DataFrame) -> str:
    """A one-row table of metrics as JSON."""
    return json.dumps(df.first().asDict(), sort_keys=True)


# ---------------------------------------------------------------- windows and joins of daily tables


def calendar_windows(df: DataFrame, day: str, value: str, last: str, days: int = 30) -> DataFrame:
    """``last_n, prior_n, last_sum, prior_sum, first_half, second_half``: the days up to ``last``, as many before these, and the halves of the last ones."""
    back = F.datediff(F.to_date(F.lit(last)), F.col(day))
    now, before = back.between(0, days - 1), back.between(days, 2 * days - 1)
    v = F.col(value)
    return df.agg(F.count_if(now).alias("last_n"), F.count_if(before).alias("prior_n"), F.sum(F.when(now, v)).alias("last_sum"), F.sum(F.when(before, v)).alias("prior_sum"), F.avg(F.when(now & (back >= days // 2), v)).alias("first_half"), F.avg(F.when(now & (back < days // 2), v)).alias("second_half"))


def aligned(a: DataFrame, b: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Two series over the union of their keys, 0 where one has none."""
    both = a.select(key, left).join(b.select(key, right), key, "full_outer")
    return both.select(key, F.coalesce(left, F.lit(0)).alias(left), F.coalesce(right, F.lit(0)).alias(right))


def cross_checked(members: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """All members, and whether the feed has them."""
    return members.join(feed.select(key).distinct().withColumn("in_feed", F.lit(True)), key, "left").withColumn("in_feed", F.coalesce("in_feed", F.lit(False)))


def recent(df: DataFrame, day: str, last: str, days: int) -> DataFrame:
    """Rows of the ``days`` days up to ``last``; on a table partitioned by day only these are read."""
    return df.where((F.col(day) > F.date_sub(F.to_date(F.lit(last)), days)) & (F.col(day) <= F.to_date(F.lit(last))))


def percentiles(df: DataFrame, column: str, *at: float) -> DataFrame:
    return df.agg(*[F.percentile(column, p).alias(f"p{round(100 * p)}") for p in at])


def sole_blocker(rows: DataFrame, *checks: str) -> DataFrame:
    """For each check how many rows fail it, and how many fail nothing else."""
    failed = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(c)) for c in checks]))
    each = rows.select(failed.alias("f")).select(F.size("f").alias("n"), F.explode("f").alias("check"))
    return each.groupBy("check").agg(F.count("*").alias("failed"), F.count_if(F.col("n") == 1).alias("sole"))


# ---------------------------------------------------------------- registry


def union_of(sources: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Records of all sources, each with the columns it has; ``source`` says which."""
    out = None
    for name, df in sorted(sources.items()):
        own = df.select(F.lit(name).alias("source"), *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
        out = own if out is None else out.unionByName(own)
    return out


def policy_counts(entries: DataFrame, policies: dict[str, str], kind: str = "institution_type") -> DataFrame:
    """Entries by policy and type; a type without a policy is reviewed."""
    table = F.create_map(*[F.lit(x) for kv in policies.items() for x in kv])
    return entries.groupBy(F.coalesce(F.try_element_at(table, F.col(kind)), F.lit("review")).alias("policy"), kind).agg(F.count("*").alias("n"))


def build_stats(fetched: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """``fetched, cached, skipped`` of a refresh, counted rather than accumulated, so that retries don't count twice."""
    both = fetched.select(key).distinct().join(cached.select(key).distinct().withColumn("there", F.lit(True)), key, "left")
    return both.agg(F.count("*").alias("fetched"), F.count_if("there").alias("cached"), F.count_if(F.col("there").isNull()).alias("skipped"))


# ---------------------------------------------------------------- guards and cleaning

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def identifier(name: str, dotted: bool = False) -> str:
    """The name, if it can stand in SQL as it is."""
    parts = name.split(".") if dotted else [name]
    if not all(_NAME.fullmatch(p) for p in parts):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def without_empty(value: Column) -> Column:
    """JSON without blank strings at any depth, and without what is empty after that; null where it is no JSON."""
    import pandas as pd

    def clean(x):
        if isinstance(x, dict):
            return {k: y for k, y in ((k, clean(v)) for k, v in x.items()) if y not in (None, {}, [])} or None
        if isinstance(x, list):
            return [y for y in map(clean, x) if y not in (None, {}, [])] or None
        return None if isinstance(x, str) and not x.strip() else x

    @F.pandas_udf("string")
    def run(s):
        def one(t):
            try:
                return None if t is None else json.dumps(clean(json.loads(t)))
            except ValueError:
                return None

        return pd.Series([one(t) for t in s], dtype=object)

    return run(value)
