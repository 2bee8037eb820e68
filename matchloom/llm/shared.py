"""What the operators of this package share: tables in the shared folder, packed exchanges and vectorised words.

The *packed exchange* moves tens of millions of (hash, document) entries as a
few binary rows: a scan task hashes its documents with numpy, cuts the entries
by hash range and emits one row per (bucket, chunk).  Buckets are hash ranges,
so they are even; keys that many documents share are combined inside each
chunk before anything is shuffled.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, which the cluster names in spark.checkpoint.dir; a local master may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path  # for drop()
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table made by written(); its readers must be done."""
    path = getattr(df, "_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one job: called like written(), it keeps them in mind until drop() deletes them all."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str = "step") -> DataFrame:
        self.tables.append(written(df, name))
        return self.tables[-1]

    def drop(self) -> None:
        for df in self.tables:
            drop(df)
        self.tables.clear()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; sizes buckets to the data."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def buckets(spark: SparkSession, entries: float, each: float = 2e6) -> int:
    return int(max(partitions(spark), -(-entries // each), 1))


# ---------------------------------------------------------------- hashing

M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
POLY = 0x5851F42D4C957F2D
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x + GOLD
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(POLY, -1, 2**64)
    out = []
    for base in (POLY, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of POLY and of its inverse modulo 2**64, at least n of them."""
    return _powers(1 << max(16, int(n).bit_length()))


# ---------------------------------------------------------------- words

BYTES = np.arange(256)
#: A-Z to a-z.
LOWER = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES).astype(np.uint8)
#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED = ~((BYTES == 0x20) | ((BYTES >= 9) & (BYTES <= 0x0D)))
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = ((BYTES >= 0x30) & (BYTES <= 0x39)) | ((BYTES >= 0x61) & (BYTES <= 0x7A)) | (BYTES >= 0x80)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and the rows' offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a few rows: byte positions, the row of each, and where each row's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED, lower: bool = False):
        self.data = LOWER[data] if lower else data
        n, rows = len(data), len(offsets) - 1
        inside = np.zeros(n + 1, bool)
        inside[:n] = kind[self.data]
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:n]
        before[offsets[:-1]] = False
        after = np.zeros(n + 1, bool)
        after[:n] = inside[1:]
        after[offsets[1:] - 1] = False  # of an empty first row: the last place, which holds no word
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(rows), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + U(1)) * up[: len(self.data)], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix(h ^ ((self.end - self.start).astype(np.uint64) << U(52)))


def windows(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words inside one row, and the places where they start."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(h) - n + 1
    out = np.full(size, n, np.uint64)
    for i in range(n):
        out = out * U(POLY) + h[i : i + size]
    at = np.flatnonzero(row[:size] == row[n - 1 :])
    return mix(out[at]), at


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each, so that numpy's temporaries stay small whatever Arrow's batch size."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(lengths), 0
    while at < len(lengths):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def by_bucket(bucket: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts entries of a bucket together, and where each bucket begins."""
    kind = np.uint16 if count < 65536 else np.uint32
    order = np.argsort(bucket.astype(kind), kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(count + 1))


def lean(df: DataFrame) -> DataFrame:
    """Rows reach Python in batches of at most 1,000, since texts are long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """``(v, root)`` for each vertex of undirected edges (a, b): root is the smallest vertex reachable.

    Large star and small star alternate until nothing changes; each step is
    written to the shared folder.  A vertex with very many neighbours is only
    ever aggregated with map-side combining or joined with one row per key,
    which adaptive execution splits.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large.where("a <> b"), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        after = written(small, "edges")
        drop(large)
        drop(now)
        now, last, state = after, state, _state(after)
        if state == last:
            break
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("v"), F.col("b").alias("root"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


# ---------------------------------------------------------------- packed exchange


def packed(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[dict[str, list]]], schema: str, column: str = "text", limit: int = 1_000_000) -> DataFrame:
    """mapInArrow over small parts of ``df``; f sees all parts of a task one after another, may keep bounded state between them, and gives columns as dicts of lists."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        parts = (part for batch in batches for part in slices(batch, column, limit))
        for made in f(parts):
            yield pa.RecordBatch.from_arrays([pa.array(made[k.name], k.type) for k in arrow], schema=arrow)

    return lean(df).mapInArrow(run, schema)


def tables(schema: str) -> Callable[[dict[str, list]], pa.Table]:
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return lambda made: pa.Table.from_arrays([pa.array(made[k.name], k.type) for k in arrow], schema=arrow)


def grouped(df: DataFrame, key: str, f: Callable[[pa.Table], dict[str, list]], schema: str) -> DataFrame:
    make = tables(schema)
    return lean(df).groupBy(key).applyInArrow(lambda t: make(f(t)), schema)


def cogrouped(left: DataFrame, right: DataFrame, key: str, f: Callable[[pa.Table, pa.Table], dict[str, list]], schema: str) -> DataFrame:
    make = tables(schema)
    return lean(left).groupBy(key).cogroup(right.groupBy(key)).applyInArrow(lambda a, b: make(f(a, b)), schema)


def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """All binaries of a column, one after another, as numbers."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def spread(docs: np.ndarray, count: int) -> np.ndarray:
    """A bucket for each document id."""
    return (mix(docs.astype(np.int64).view(np.uint64)) % U(count)).astype(np.int64)


#: Slots of the bitmap that keeps untouched documents out of a shuffle: 4 million, whatever the input. It only ever saves work.
SLOTS = 1 << 22


def slot(column) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(5), column), F.lit(SLOTS))


def slot_filter(ids: DataFrame, column: str) -> Callable[[DataFrame, str], tuple[DataFrame, DataFrame]]:
    """Splits documents into those that may be among ``ids`` and those that surely are not, without a shuffle of their texts.

    What reaches the driver is at most SLOTS integers; where ids fill most
    slots, nearly all documents count as possible, which is slower, not wrong.
    """
    found = ids.select(slot(column).cast("int").alias("s")).distinct().toArrow().column("s").to_numpy()
    bits = np.zeros(SLOTS // 8, np.uint8)
    np.bitwise_or.at(bits, found >> 3, (1 << (found & 7)).astype(np.uint8))
    sent = ids.sparkSession.sparkContext.broadcast(bits)

    def split(docs: DataFrame, doc_id: str):
        @F.pandas_udf("boolean")
        def possible(s):
            import pandas as pd

            at = s.to_numpy()
            return pd.Series(sent.value[at >> 3] >> (at & 7) & 1 == 1)

        marked = docs.withColumn("__possible", possible(slot(F.coalesce(F.col(doc_id), F.lit(-1)))))
        return marked.where("__possible").drop("__possible"), marked.where("not __possible").drop("__possible")

    return split


def pack(bucket: np.ndarray, count: int, known: bool, docs: np.ndarray, **fields: np.ndarray) -> dict[str, list]:
    """One row for each bucket that has entries: documents as a list and places in it, each field as binary."""
    order, at = by_bucket(bucket.astype(np.int64), count)
    docs, fields = docs[order], {k: v[order] for k, v in fields.items()}
    out: dict[str, list] = {k: [] for k in ("b", "known", "who", "docs", *fields)}
    for b in np.flatnonzero(np.diff(at)):
        part = slice(at[b], at[b + 1])
        ids, who = np.unique(docs[part], return_inverse=True)
        out["b"].append(int(b))
        out["known"].append(known)
        out["who"].append(who.astype(np.uint16 if len(ids) < 65536 else np.uint32).tobytes())
        out["docs"].append(ids.tobytes())
        for k, v in fields.items():
            out[k].append(v[part].tobytes())
    return out


def unpack(t: pa.Table, **kinds: type) -> list[np.ndarray]:
    """Documents, known, and the fields of all entries in a bucket's rows."""
    docs, known = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for w, d, k in zip(t["who"].to_pylist(), t["docs"].to_pylist(), t["known"].to_pylist()):
        ids = np.frombuffer(d, np.int64)
        who = np.frombuffer(w, np.uint16 if len(ids) < 65536 else np.uint32)
        docs.append(ids[who])
        known.append(np.full(len(who), k, bool))
    return [np.concatenate(docs), np.concatenate(known), *(joined(t[k], kind) for k, kind in kinds.items())]


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins (and the end of the last), and the run of each entry."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    new = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))
    return np.append(np.flatnonzero(new), len(sorted_keys)), np.cumsum(new) - 1
