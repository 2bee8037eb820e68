"""The field-value index as a table that batches and streams refresh by key.

The index lies in SHARDS parts by a hash of the patient; an upsert reads and writes only the parts
that its patients are in, under a new version, and then names them in a new manifest.
Readers follow the newest manifest, so a failed run leaves all as it was.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.fields import PATIENT, extracted, index_rows, matchable, normalized

SHARDS = 64
INDEX = "patient_id string, field_name string, value string"
#: Records with the time of their last change, by which the newest of several is known.
VERSIONED = PATIENT + ", meta struct<lastUpdated:string>"


def merged(old: DataFrame, new: DataFrame, key: str = "patient_id", ids: DataFrame | None = None) -> DataFrame:
    """All rows of new, and of old those whose key is not among ``ids`` (the keys of new, if none are given)."""
    gone = (new if ids is None else ids).select(key).distinct()
    return new.unionByName(old.join(gone, key, "left_anti").select(*new.columns))


def _shard(shards: int):
    return F.pmod(F.xxhash64("patient_id"), F.lit(shards)).cast("int")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def manifest(spark: SparkSession, path: str) -> dict:
    """The newest manifest: version, the batch it came from, and the version of each part that holds something."""
    system, at = _fs(spark, path)
    if not system.exists(at):
        return {"version": 0, "batch": None, "shards": {}, "of": SHARDS}
    names = [s.getPath().getName() for s in system.listStatus(at)]
    found = max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)
    if not found:
        return {"version": 0, "batch": None, "shards": {}, "of": SHARDS}
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest-{found}.json").collect()))  # one line


def _publish(spark: SparkSession, path: str, made: dict) -> None:
    system, _ = _fs(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/.manifest-{made['version']}.part")
    out = system.create(part, True)
    out.write(json.dumps(made).encode())
    out.close()
    if not system.rename(part, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-{made['version']}.json")):
        raise RuntimeError("another writer has published this version")


def read_index(spark: SparkSession, path: str, shards: list[int] | None = None) -> DataFrame:
    """The index as the newest manifest has it, or some of its parts."""
    now = manifest(spark, path)["shards"]
    paths = [f"{path}/v{v}/shard={k}" for k, v in now.items() if shards is None or int(k) in shards]
    return spark.read.schema(INDEX).parquet(*paths) if paths else spark.createDataFrame([], INDEX)


def upsert(spark: SparkSession, path: str, new: DataFrame, ids: DataFrame, batch: str | None = None) -> int:
    """Replaces all values of the patients ``ids`` (patient_id) by the rows ``new``; a patient without rows loses its old ones. A batch that was published last is not repeated."""
    now = manifest(spark, path)
    if batch is not None and batch == now["batch"]:
        return now["version"]
    shard, version = _shard(now["of"]), now["version"] + 1
    touched = sorted(r.s for r in ids.select(shard.alias("s")).distinct().collect())  # SHARDS at most
    out = merged(read_index(spark, path, touched), new.select("patient_id", "field_name", "value"), ids=ids).withColumn("shard", shard)
    out.repartition("shard").sortWithinPartitions("field_name", "value").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/v{version}")
    system, at = _fs(spark, f"{path}/v{version}")
    held = {s.getPath().getName().removeprefix("shard=") for s in system.listStatus(at) if s.isDirectory()}
    shards = {k: v for k, v in now["shards"].items() if int(k) not in touched} | {k: version for k in held}
    _publish(spark, path, {"version": version, "batch": batch, "shards": shards, "of": now["of"]})
    return version


def count(spark: SparkSession, path: str) -> int:
    return read_index(spark, path).select("patient_id").distinct().count()


def get(spark: SparkSession, path: str, patient_id: str) -> DataFrame:
    """All values of one patient; reads one part."""
    own = spark.range(1).select(F.lit(patient_id).alias("patient_id")).select(_shard(manifest(spark, path)["of"])).first()[0]
    return read_index(spark, path, [own]).where(F.col("patient_id") == patient_id)


def clear(spark: SparkSession, path: str) -> None:
    """An empty index, as a version of its own."""
    now = manifest(spark, path)
    system, at = _fs(spark, path)
    system.mkdirs(at)
    _publish(spark, path, {"version": now["version"] + 1, "batch": None, "shards": {}, "of": now["of"]})


def newest(records: DataFrame) -> DataFrame:
    """Of several records of one id the one changed last; of equally new ones the last in order of content."""
    row = F.struct(*[F.col(c) for c in records.columns])
    order = F.struct(F.coalesce(F.col("meta.lastUpdated"), F.lit("")).alias("at"), F.to_json(row).alias("text"))
    return records.groupBy("id").agg(F.max_by(row, order).alias("r")).select("r.*")


def refresh(spark: SparkSession, path: str, records: DataFrame, as_of: str, batch: str | None = None) -> int:
    """One upsert from records: normalised, extracted, those with nothing to match left out."""
    latest = newest(records).persist()
    try:
        return upsert(spark, path, index_rows(matchable(extracted(normalized(latest, as_of)))), latest.select(F.col("id").alias("patient_id")), batch)
    finally:
        latest.unpersist()


def refresh_stream(spark: SparkSession, folder: str, path: str, checkpoint: str, as_of: str, **trigger):
    """Follows a folder of newline-delimited records; each micro-batch is one upsert, and a batch that is retried is known by checkpoint and number."""
    records = spark.readStream.schema(VERSIONED).json(folder)

    def apply(batch: DataFrame, epoch: int) -> None:
        refresh(batch.sparkSession, path, batch, as_of, f"{checkpoint}:{epoch}")

    return records.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
