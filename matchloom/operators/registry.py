"""Address registry: keys, deduplication, quality of sources, robustness of keys; newline-delimited JSON out and in."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import placeholders, text

ENTRY = "id string, institution_type string, name string, match_street string, match_zip5 string, collected string, sources array<struct<source:string,source_id:string>>"


def keyed(records: DataFrame) -> DataFrame:
    """Adds the key (match_street, match_zip5)."""
    return records.withColumn("match_street", text.standard_street(text.strip_unit(F.col("street")))).withColumn("match_zip5", text.zip5(text.pad_zip(F.col("zip"))))


def usable() -> F.Column:
    return (F.coalesce(F.col("match_street"), F.lit("")) != "") & (F.length("match_zip5") == 5)


def build(records: DataFrame) -> DataFrame:
    """One entry for each type and key: the name of the first record by source and id, the last day collected, all sources."""
    order = F.struct("source", "source_id")
    return keyed(records).where(usable()).groupBy("institution_type", "match_street", "match_zip5").agg(F.min_by("name", order).alias("name"), F.max("collected").alias("collected"), F.array_sort(F.collect_set(order)).alias("sources"))


def dropped(records: DataFrame) -> DataFrame:
    return keyed(records).where(~usable()).groupBy("source").agg(F.count("*").alias("n_dropped"))


def quality(records: DataFrame) -> DataFrame:
    """Rows, usable share, distinct keys and unusable streets of each source."""
    ok = usable()
    return keyed(records).groupBy("source").agg(F.count("*").alias("n_rows"), F.avg(ok.cast("double")).alias("usable_share"), F.count_distinct(F.when(ok, F.struct("match_street", "match_zip5"))).alias("n_keys"), F.avg(placeholders.unusable_street(F.col("street")).cast("double")).alias("unusable_share"))


def robustness(records: DataFrame, sample: int | None = 3000) -> DataFrame:
    """How often a key survives a change in writing, on the first ``sample`` records by hash (a report), or on all of them where it is None."""
    keys = keyed(records).where(usable()).select("match_street", "match_zip5").distinct()
    some = records if sample is None else records.orderBy(F.xxhash64("source", "source_id"), "source_id").limit(sample)
    changes = {"upper": F.upper("street"), "unit": F.concat("street", F.lit(" apt 2")), "zip4": F.col("street"), "typo": F.concat(F.expr("substr(street, 1, 3)"), F.expr("substr(street, 5)"))}
    all_ = None
    for name, street in changes.items():
        own = some.withColumn("street", street).withColumn("zip", F.concat("zip", F.lit("-1234")) if name == "zip4" else F.col("zip")).withColumn("variant", F.lit(name))
        all_ = own if all_ is None else all_.unionByName(own)
    hit = keyed(all_).join(keys.withColumn("hit", F.lit(1.0)), ["match_street", "match_zip5"], "left")
    return hit.groupBy("variant").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("hit_rate"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records of two sources with the same six-digit id, and the share whose keys agree."""
    own = lambda df, s: keyed(df).groupBy(F.lpad("source_id", 6, "0").alias("fid")).agg(F.min(F.struct("match_street", "match_zip5")).alias(s))
    return own(a, "x").join(own(b, "y"), "fid").agg(F.count("*").alias("n_shared"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("agree"))


def write(entries: DataFrame, path: str) -> None:
    """Compressed lines in the order of keys, each with a stable id."""
    named = entries.withColumn("id", F.sha1(F.concat_ws("|", "institution_type", "match_street", "match_zip5")))
    named.orderBy("institution_type", "match_zip5", "match_street").select(F.to_json(F.struct(*[c.split()[0] for c in ENTRY.replace("array<struct<source:string,source_id:string>>", "x").split(", ")])).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", ENTRY).alias("e")).select("e.*")
