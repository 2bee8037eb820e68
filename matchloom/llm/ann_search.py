"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are banded by length, each band STEP times as long as the next, so that
within a band the largest inner product is nearly the nearest direction.  A query
probes all bands; bands of fewer than FEW vectors have no tables, as every query
meets all of their vectors.  A table hashes a vector by POLYTOPES fast pseudo-rotations
(three rounds of random signs and a Hadamard transform each) to the nearest signed axis of each; the
sequence of these axes is its bucket, so a table has (2 * width) ** POLYTOPES.  A query probes, in each of
TABLES tables, the buckets nearest to it - those whose axes are least behind the
nearest ones, in squares - and all vectors found are reranked by their exact
inner product.  A query probes PROBES buckets of a table, however many vectors there are: what
it finds in a table it finds in any larger one too.  The fewer vectors a band has, the farther its
neighbours are, so PROBES is set by the smallest bands that have tables: recall of the 20 nearest
of random directions is above 0.9 from FEW vectors on, and higher in larger bands.

Layout: buckets are dealt by a hash of all their axes but the last into groups sized to the data; a
vector goes once to each group that holds one of its buckets, a query to each that holds a bucket it
probes, each with its list of buckets there.  A group thus meets a vector once, whatever number of
tables finds it, and returns a query's k best.  Buckets that share these axes
and hold over PART vectors are dealt by a hash of the vector's id into parts, so
one that a third of all vectors share is many tasks; no bucket is capped and every vector is
indexed.  Vectors without tables meet slices of SLICE queries.  Buckets of ASKED queries are sought by one task.
Pairs are scored in matrix products, and of a query's pairs only those are sorted that are not below
the kth score it has so far.  Where there are over AHEAD groups, the first table of each band goes ahead: the
kth score a query finds there goes with it to all groups of the others, so they keep and return few of its pairs.  Sizes of
bands, and of what holds over PART vectors, are the only thing that reaches the driver.

Recall and shares of candidates against brute force are in the README and in the tests.

Defined results: vectors that are null, zero, empty or hold null or non-finite
components take no part; shorter ones end in zeros; of rows with one id the
first in the order of components counts; exact copies under other ids are all
candidates, and of equal scores the smaller ids win, at the last rank too, as all within rounding of the kth are
compared exactly; a query without candidates has no row; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import Scratch, U, cogrouped, drop, mix, runs, written
from .vectors import QUERIES, best, matrix, usable

TABLES, POLYTOPES, PART, SLICE, ASKED = 24, 2, 8192, 16_384, 512
STEP, FEW = 1.1, 256
#: Buckets probed in a table, at any size.
PROBES = 362
#: The bucket of all bands with fewer than FEW vectors.
SCANNED = -1
#: Groups over which the first table goes ahead.
AHEAD = 48
#: Pairs kept until the first cut at least, pairs of a bucket from which on it is scored alone, and bucket entries of a group.
PAIRS, DENSE, ENTRIES = 1 << 16, 2048, 150_000
FOUND = "query_id bigint, vec_id bigint, score double"
HASHED = "vec_id bigint, e array<double>, buckets array<bigint>"
SENT = "b bigint, vec_id bigint, e binary, buckets binary"
ASKS = f"{SENT}, least double"


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of rows whose width is a power of two; a few at a time, as columns, so that they stay in the cache."""
    n, width = x.shape
    signs = np.random.default_rng(table).choice(np.array([-1.0, 1.0]), (3, width))
    out, step = np.empty((n, width)), max(1, 32_768 // width)
    for at in range(0, n, step):
        part = np.ascontiguousarray(x[at : at + step].T)
        for s in signs:
            part, h = part * s[:, None], 1
            while h < width:
                part = part.reshape(-1, 2, h, part.shape[-1])
                both = np.empty_like(part)
                np.add(part[:, 0], part[:, 1], out=both[:, 0])
                np.subtract(part[:, 0], part[:, 1], out=both[:, 1])
                part = both.reshape(width, -1)
                h *= 2
            part /= np.sqrt(width)
        out[at : at + step] = part.T
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    """Unit vectors of the padded width."""
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x / np.abs(x).max(1, keepdims=True)
    return out / np.sqrt((out * out).sum(1))[:, None]


def _measured(batches):
    """Vectors with the natural logarithm of their length, of any finite size."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        x = matrix(t, int(np.diff(t["e"].combine_chunks().offsets.to_numpy()).max()))
        top = np.abs(x).max(1)
        length = np.log(top) + np.log(((x / top[:, None]) ** 2).sum(1)) / 2
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("e"), pa.array(length)], names=["vec_id", "e", "length"])


def _axes(x: np.ndarray, table: int, k: int) -> np.ndarray:
    """How far each signed axis of one polytope is along each unit vector."""
    y = rotated(x, table * POLYTOPES + k)
    return np.concatenate([y, -y], 1)


def _own(x: np.ndarray, table: int) -> np.ndarray:
    """Each vector's bucket in a table."""
    name = np.zeros(len(x), np.int64)
    for k in range(POLYTOPES):
        both = _axes(x, table, k)
        name = name * both.shape[1] + both.argmax(1)
    return name


def _nearest_buckets(x: np.ndarray, table: int, count: int) -> np.ndarray:
    """The ``count`` buckets nearest to each vector: the best of all sums follow from the best of partial sums.

    Of two sorted lists the ith and the jth make a sum that i * j - 1 others do not exceed, so only those with i * j up to ``count`` are made.
    """
    name, behind = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for k in range(POLYTOPES):
        both = _axes(x, table, k)
        width = both.shape[1]
        more = (both.max(1, keepdims=True) - both) ** 2
        axis, order = np.argsort(more, axis=1), np.argsort(behind, axis=1)
        more, behind, name = np.take_along_axis(more, axis, 1), np.take_along_axis(behind, order, 1), np.take_along_axis(name, order, 1)
        i, j = np.nonzero(np.arange(1, behind.shape[1] + 1)[:, None] * np.arange(1, width + 1) <= count)
        behind, name = behind[:, i] + more[:, j], name[:, i] * width + axis[:, j]
        if behind.shape[1] > count:
            some = np.argpartition(behind, count - 1, axis=1)[:, :count]
            behind, name = np.take_along_axis(behind, some, 1), np.take_along_axis(name, some, 1)
    return name


def _filed(width: int, padded: int):
    """The buckets of vectors: one of each table of their band, whose first is ``base``; SCANNED without one."""

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            x, base = _wide(matrix(t, width), padded), t["base"]
            scanned = base.is_null().to_numpy()
            first = base.fill_null(0).to_numpy()
            names = np.stack([_own(x, table) + (first + table) * (2 * padded) ** POLYTOPES for table in range(TABLES)], 1)
            names[scanned, 0] = SCANNED
            count = np.where(scanned, 1, TABLES)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(names[np.arange(TABLES) < count[:, None]]))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("e"), lists], names=["vec_id", "e", "buckets"])

    return run


def _group(coarse: np.ndarray, part: np.ndarray, groups: int) -> np.ndarray:
    return (mix(coarse.astype(np.uint64) * U(1 << 20) + part.astype(np.uint64)) % U(groups)).astype(np.int64)


def _rows(group: np.ndarray, row: np.ndarray, name: np.ndarray, ids: np.ndarray, x: np.ndarray, **more: np.ndarray):
    """Entries (group, row, bucket) as one record for each group and row, vectors as binary; ``more`` are further columns of rows."""
    key = group * len(ids) + row
    order = np.argsort(key.astype(np.min_scalar_type(int(key.max(initial=0)))), kind="stable")
    group, row, name = group[order], row[order], name[order]
    new = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (row[1:] != row[:-1])))) if len(group) else np.zeros(0, np.int64)
    for at in range(0, len(new), 4096):
        some = new[at : at + 4096]
        ends = np.append(new, len(group))[at + 1 : at + 1 + len(some)]
        sent = {"b": group[some], "vec_id": ids[row[some]], "e": pa.array([x[i].tobytes() for i in row[some]], pa.binary()), "buckets": pa.array([name[a:z].tobytes() for a, z in zip(some, ends)], pa.binary())}
        yield pa.RecordBatch.from_pydict(sent | {column: v[row[some]] for column, v in more.items()})


def _first_copies(ids: np.ndarray, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors the ``count`` smallest ids: as their scores are the same, no later one is among a query's best."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order])
    _, same = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids)) - np.searchsorted(same[order], same[order])
    return ids[place < count], x[place < count]


def _exact(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last, so that a pair has one score wherever it is computed."""
    return np.cumsum(y * x, axis=1)[:, -1]


def _rounding(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each query, what a matrix product may be off by: all within it of the kth are compared by their exact scores."""
    return 4 * x.shape[1] * np.finfo(float).eps * np.sqrt((y * y).sum(1)) * np.sqrt((x * x).sum(1).max())


def _values(y: np.ndarray, query: np.ndarray, x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Exact scores of pairs."""
    step = max(1, (1 << 20) // x.shape[1])
    return np.concatenate([np.zeros(0), *(_exact(y[query[at : at + step]], x[row[at : at + step]]) for at in range(0, len(query), step))])


def _top(own: np.ndarray, y: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and rows, and exact scores, of each query's k best rows, ties to smaller ids; ids are distinct."""
    score = y @ x.T
    score[own[:, None] == ids[None, :]] = -np.inf
    kth = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(y), -np.inf)
    query, row = np.nonzero((score >= (kth - _rounding(y, x))[:, None]) & (score > -np.inf))
    value = _values(y, query, x, row)
    keep = best(query, ids[row], value, k)
    return query[keep], row[keep], value[keep]


class _Best:
    """The pairs that may still be among the k best of their queries; ``least`` is the score below which a query's pairs are not, at first as found elsewhere."""

    def __init__(self, own: np.ndarray, y: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, least: np.ndarray):
        self.own, self.y, self.ids, self.x, self.k = own, y, ids, x, k
        self.off, self.least = _rounding(y, x), np.full(len(own), -np.inf)
        self.raise_to(np.arange(len(own)), least)
        self.found: list[tuple] = []
        self.new, self.limit = 0, max(PAIRS, 2 * k * len(own))

    def raise_to(self, query: np.ndarray, kth: np.ndarray) -> None:
        """Each query has k pairs that score at least ``kth``."""
        with np.errstate(invalid="ignore"):
            self.least[query] = np.fmax(self.least[query], kth - self.off[query])

    def score(self, query: np.ndarray, row: np.ndarray, due: np.ndarray | None = None) -> None:
        """Meets all of ``query`` with all of ``row``; only pairs that are due count."""
        score = self.y[query] @ self.x[row].T
        hit = score >= self.least[query][:, None]
        if due is not None:
            hit &= due
        q, r = np.nonzero(hit)
        self.found.append((query[q], row[r], score[q, r]))
        self.new += len(q)
        if self.new >= self.limit:
            self.cut()

    def cut(self) -> None:
        """Leaves each pair once, of each query those within rounding of its kth; where these are more, the k best by exact scores."""
        q, r, score = (np.concatenate(v) for v in zip(*self.found)) if self.found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        keep = (self.own[q] != self.ids[r]) & (score >= self.least[q])
        q, r, score = q[keep], r[keep], score[keep]
        pair = q * len(self.ids) + r
        order = np.argsort(pair)
        once = order[np.concatenate(([True], np.diff(pair[order]) > 0))[: len(order)]]
        order = once[np.argsort(-score[once])]
        order = order[np.argsort(q[order].astype(np.uint16), kind="stable")]  # SLICE queries at most
        q, r, score = q[order], r[order], score[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))[: len(q)]
        size = np.diff(np.append(first, len(q)))
        full = size >= self.k
        self.raise_to(q[first[full]], score[first[full] + self.k - 1])
        keep = score >= self.least[q]
        q, r, score = q[keep], r[keep], score[keep]
        tied = np.flatnonzero(np.bincount(q, minlength=len(self.own))[q] > self.k)
        if len(tied):
            keep = np.ones(len(q), bool)
            keep[tied] = False
            keep[tied[best(q[tied], self.ids[r[tied]], _values(self.y, q[tied], self.x, r[tied]), self.k)]] = True
            q, r, score = q[keep], r[keep], score[keep]
        self.found, self.new = [(q, r, score)], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of queries and rows, and exact scores."""
        self.cut()
        q, r, _ = self.found[0]
        value = _values(self.y, q, self.x, r)
        keep = best(q, self.ids[r], value, self.k)
        return self.own[q[keep]], self.ids[r[keep]], value[keep]


def _matched(own: np.ndarray, y: np.ndarray, asked: tuple, ids: np.ndarray, x: np.ndarray, filed: tuple, k: int, fine: int, least: np.ndarray | None = None):
    """Ids of queries and rows, and exact scores, of the k best of each query among the rows in its buckets; asked and filed: (bucket, place) sorted by bucket.

    Buckets that share their axes but the last are scored as one matrix product, of which only pairs
    in probed buckets count; where it is over DENSE pairs for each bucket, as one product for each bucket.
    Pairs below ``least`` need not be found.
    """
    least = np.full(len(own), -np.inf) if least is None else least
    at_row, block = runs(filed[0])[0], runs(filed[0] // fine)[0]
    for begin in range(0, len(own), SLICE):
        some = slice(begin, begin + SLICE)
        kept = _Best(own[some], y[some], ids, x, k, least[some])
        mine = (asked[1] >= begin) & (asked[1] < begin + SLICE)
        name, query = asked[0][mine], asked[1][mine] - begin
        place = np.zeros(len(kept.own), np.int64)
        for a, z in zip(block[:-1], block[1:]):
            coarse = filed[0][a] // fine * fine
            low, high = np.searchsorted(name, (coarse, coarse + fine))
            if low == high:
                continue
            place[query[low:high]] = 1
            who = np.flatnonzero(place)
            place[who] = np.arange(len(who))
            bounds = at_row[np.searchsorted(at_row, a) : np.searchsorted(at_row, z) + 1]
            if len(who) * (z - a) <= DENSE * (len(bounds) - 1):
                due = np.zeros((len(who), fine), bool)
                due[place[query[low:high]], name[low:high] - coarse] = True
                kept.score(who, filed[1][a:z], due[:, filed[0][a:z] - coarse])
            else:
                lows, highs = (np.searchsorted(name, filed[0][bounds[:-1]], side) for side in ("left", "right"))
                for i, j, u, v in zip(bounds[:-1], bounds[1:], lows, highs):
                    step = max(1, 16 * PAIRS // (j - i))
                    for w in range(u, v, step):
                        kept.score(query[w : min(v, w + step)], filed[1][i:j])
            place[who] = 0
        yield kept.rows()


def _entries(t: pa.Table, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and the places of their rows, sorted by bucket; rows whose place is below 0 are left out."""
    parts = [np.frombuffer(x, np.int64) for x in t["buckets"].to_pylist()]
    name = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    if place is not None:
        row = place[row]
        name, row = name[row >= 0], row[row >= 0]
    order = np.argsort(name)
    return name[order], row[order]


def nearest(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` from tables (vec_id, e)."""
    keep = Scratch()
    once = lambda df: df.groupBy("vec_id").agg(F.min("e").alias("e"))
    candidates = written(once(candidates).mapInArrow(_measured, "vec_id bigint, e array<double>, length double"), "vectors")
    queries = keep(once(queries), "queries")
    width, longest = candidates.agg(F.max(F.size("e")), F.max("length")).first()
    width, longest = width or 1, longest or 0.0
    padded = 1 << max(1, (width - 1).bit_length())
    fine = 2 * padded
    band = F.floor((F.lit(longest) - F.col("length")) / float(np.log(STEP))).cast("int")
    counts = {r["band"]: r["count"] for r in candidates.groupBy(band.alias("band")).count().collect()}
    large = sorted(b for b, n in counts.items() if n >= FEW)
    first = {b: i * TABLES for i, b in enumerate(large)}  # a band's first table
    base = F.try_element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), band) if first else F.lit(None).cast("int")
    filed = keep(candidates.select("vec_id", "e", base.cast("bigint").alias("base")).mapInArrow(_filed(width, padded), HASHED), "filed")
    drop(candidates)
    coarse = F.when(F.col("bucket") == SCANNED, F.lit(SCANNED)).otherwise(F.floor(F.col("bucket") / fine))
    sizes = filed.select(F.explode("buckets").alias("bucket")).groupBy(coarse.alias("coarse")).count().where(F.col("count") > PART)
    many = {r["coarse"]: -(-r["count"] // PART) for r in sizes.collect()}
    hot = np.array(sorted(c for c in many if c != SCANNED), np.int64)
    hot_parts = np.array([many[c] for c in hot.tolist()], np.int64)
    n, asks = sum(counts.values()), queries.count()
    groups, slices, scanned_parts = max(TABLES, -(-n * TABLES // ENTRIES)), -(-max(asks, 1) // SLICE), many.get(SCANNED, 1)
    scans, tries = len(large) < len(counts), [(first[b], PROBES) for b in large]

    def parts_of(coarse: np.ndarray) -> np.ndarray:
        if not len(hot):
            return np.ones(len(coarse), np.int64)
        at = np.minimum(np.searchsorted(hot, coarse), len(hot) - 1)
        return np.where(hot[at] == coarse, hot_parts[at], 1)

    def spread_vectors(batches, tables: range):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            ids, x = t["vec_id"].to_numpy(), matrix(t, width)
            name = t["buckets"].combine_chunks().flatten().to_numpy()
            row = np.repeat(np.arange(len(ids)), t["buckets"].combine_chunks().value_lengths().to_numpy())
            deal = mix(ids.astype(np.int64).view(np.uint64))
            far_row = row[(name == SCANNED) & (TABLES - 1 in tables)]
            near = (name != SCANNED) & np.isin(name // fine**POLYTOPES % TABLES, tables)
            name, row = name[near], row[near]
            c = name // fine
            group = _group(c, (deal[row] % parts_of(c).astype(np.uint64)).astype(np.int64), groups)
            far = groups + (deal[far_row] % U(scanned_parts)).astype(np.int64)[:, None] * slices + np.arange(slices)
            yield from _rows(np.concatenate([group, far.ravel()]), np.concatenate([row, np.repeat(far_row, slices)]), np.concatenate([name, np.full(far.size, SCANNED)]), ids, x)

    def spread_queries(batches, tables: range):
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                t = pa.Table.from_batches([batch])
                ids, x = t["vec_id"].to_numpy(), matrix(t, width)
                unit, row, name = _wide(x, padded), [], []
                for begin, count in tries:
                    for table in tables:
                        found = _nearest_buckets(unit, table, min(count, fine**POLYTOPES)) + (begin + table) * fine**POLYTOPES
                        row.append(np.repeat(np.arange(len(ids)), found.shape[1]))
                        name.append(found.ravel())
                row, name = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (row, name))
                c = name // fine
                parts = parts_of(c)
                end = np.cumsum(parts)
                part = np.arange(end[-1] if len(end) else 0) - np.repeat(end - parts, parts)
                group, row, name = _group(np.repeat(c, parts), part, groups), np.repeat(row, parts), np.repeat(name, parts)
                if scans and TABLES - 1 in tables:
                    deal = (mix(ids.astype(np.int64).view(np.uint64) ^ U(77)) % U(slices)).astype(np.int64)
                    far = groups + np.arange(scanned_parts) * slices + deal[:, None]
                    group, row, name = np.concatenate([group, far.ravel()]), np.concatenate([row, np.repeat(np.arange(len(ids)), scanned_parts)]), np.concatenate([name, np.full(far.size, SCANNED)])
                yield from _rows(group, row, name, ids, x, least=t["least"].to_numpy())

    def run(t: pa.Table, q: pa.Table) -> dict[str, np.ndarray]:
        out = {"query_id": [np.zeros(0, np.int64)], "vec_id": [np.zeros(0, np.int64)], "score": [np.zeros(0)]}
        whole = lambda: {name: np.concatenate(parts) for name, parts in out.items()}
        if not t.num_rows or not q.num_rows:
            return whole()
        own, y = q["vec_id"].to_numpy(), np.frombuffer(b"".join(q["e"].to_pylist())).reshape(-1, width)
        all_ids, x = t["vec_id"].to_numpy(), np.frombuffer(b"".join(t["e"].to_pylist())).reshape(-1, width)
        ids, x = _first_copies(all_ids, x, k + 1)

        def add(query, row, value):
            for parts, part in zip(out.values(), (query, row, value)):
                parts.append(part)

        if t["b"][0].as_py() >= groups:
            for at in range(0, len(own), QUERIES):
                query, row, value = _top(own[at : at + QUERIES], y[at : at + QUERIES], ids, x, k)
                add(own[at : at + QUERIES][query], ids[row], value)
            return whole()
        order = np.argsort(ids)
        at = np.minimum(np.searchsorted(ids[order], all_ids), len(ids) - 1)
        place = np.where(ids[order][at] == all_ids, order[at], -1)
        for found in _matched(own, y, _entries(q), ids, x, _entries(t, place), k, fine, q["least"].to_numpy()):
            add(*found)
        return whole()

    def met(asked: DataFrame, tables: range) -> DataFrame:
        """Pairs found in some tables of each band; the last ones bring those without tables."""
        vectors = filed.mapInArrow(lambda batches: spread_vectors(batches, tables), SENT)
        return cogrouped(vectors, asked.repartition(-(-max(asks, 1) // ASKED)).mapInArrow(lambda batches: spread_queries(batches, tables), ASKS), "b", run, FOUND)

    none = F.lit(float("-inf"))
    queries = queries.withColumn("least", none)
    if large and groups > AHEAD:
        ahead = keep(met(queries, range(1)), "ahead")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        kth = ahead.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
        found = met(queries.join(kth, "vec_id", "left").select("vec_id", "e", F.coalesce("kth", none).alias("least")), range(1, TABLES)).unionAll(ahead)
    else:
        found = met(queries, range(TABLES))
    # a vector comes from several tables, each time with the same exact score
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_query(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    vectors = usable(embeddings).where(F.exists("e", lambda x: x != 0))
    return nearest(vectors, vectors.where(F.col("vec_id") % every == 0), k)
