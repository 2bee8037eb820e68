"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt by a hash of their id into blocks of about BLOCK; a block
sorts the ids of each dimension by their component once.  For a query, the
lists are read from the end that suits the sign of its component, all to the
same depth, which doubles from step to step; vectors seen for the first time are
scored in full.  No unseen vector can score above the sum, over dimensions, of
the query's component times the component at that depth, so a query stops as
soon as this bound is below its kth score (an equal score could still win by its
smaller id, so equality does not stop it).

The first block is searched first.  The kth score that a query has there is a bound for all other
blocks: they stop as soon as nothing unseen can reach it, and return only what does.

Queries meet blocks in groups of at most GROUP, so a task holds one block and one group
whatever the numbers of either; each pair of a block and a query returns at most
k rows, and the k best of those are the result.  ``accesses`` counts the vectors scored in full: on
random directions of 64 dimensions the bound stays above the kth score until nearly all
lists are read, so nearly all vectors are; on vectors with few large components it is a small share
(README).

Defined results: vectors that are null, empty or hold null or non-finite
components take no part; shorter vectors end in zeros; of rows with one id the
first in the order of components counts; of equal scores the smaller ids win, at the last rank too; fewer than k candidates are all
returned; a query without candidates has no row; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import cogrouped, written
from .vectors import BLOCK, distinct_ids, matrix, usable

#: Queries that meet a block at once.
GROUP = 8192

FOUND = "query_id bigint, vec_id bigint, score bigint"


def threshold_search(x: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, own: int, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of one query's k best among x, and how many vectors were scored. lists: for each dimension the rows in ascending order of their component; least: what a score must reach."""
    n = len(x)
    dims = np.flatnonzero(query)
    down = query[dims] > 0
    weight = query[dims]
    seen = ids == own
    rows, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
    depth, step = 0, max(8, n // 256)
    while True:
        to = min(n, depth + step)
        if to > depth and len(dims):
            part = np.where(down[:, None], lists[dims, n - to : n - depth], lists[dims, depth:to])
            hit = np.zeros(n, bool)
            hit[part.ravel()] = True
            new = np.flatnonzero(hit & ~seen)
        else:  # a query of zeros has no lists to read
            new = np.flatnonzero(~seen)
            to = n
        seen[new] = True
        rows.append(new)
        scores.append(x[new] @ query)
        all_rows, all_scores = np.concatenate(rows), np.concatenate(scores)
        order = np.lexsort((ids[all_rows], -all_scores))[:k]
        rows, scores = [all_rows[order]], [all_scores[order]]
        if to >= n or seen.all():
            break
        at = np.where(down, lists[dims, n - to], lists[dims, to - 1])
        if float(weight @ x[at, dims]) < max(least, scores[0][-1] if len(order) == k else -np.inf):
            break
        depth, step = to, step * 2
    keep = scores[0] >= least
    return ids[rows[0]][keep], scores[0][keep], int(seen.sum())


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` from tables (vec_id, e); components are whole numbers."""
    n, width = candidates.agg(F.count("*"), F.max(F.size("e"))).first()
    width = max(width or 1, queries.agg(F.max(F.size("e"))).first()[0] or 1)
    blocks, groups = -(-max(n, 1) // BLOCK), -(-max(queries.count(), 1) // GROUP)
    deal = lambda count: F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(count)).cast("int")
    name = (F.col("block").cast("bigint") * groups + F.col("group")).alias("b")
    left = candidates.withColumn("block", deal(blocks)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(t: pa.Table, q: pa.Table) -> dict[str, list]:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if not t.num_rows or not q.num_rows:
            return out
        ids, x = distinct_ids(t["vec_id"].to_numpy(), matrix(t, width))
        own, order = np.unique(q["query_id"].to_numpy(), return_index=True)
        queries, least = matrix(q, width, "asked")[order], q["least"].fill_null(-np.inf).to_numpy()[order]
        lists = np.argsort(x.T, axis=1, kind="stable").astype(np.int32)
        for i, query, bound in zip(own, queries, least):
            found, score, _ = threshold_search(x, ids, lists, query, i, k, bound)
            out["query_id"] += [int(i)] * len(found)
            out["vec_id"] += found.tolist()
            out["score"] += score.astype(np.int64).tolist()
        return out

    def searched(some: DataFrame, asks: DataFrame) -> DataFrame:
        return cogrouped(some.select(name, "vec_id", "e"), asks.select(name.alias("b"), F.col("vec_id").alias("query_id"), F.col("e").alias("asked"), "least"), "b", run, FOUND)

    once = queries.groupBy("vec_id").agg(F.min("e").alias("e")).withColumn("group", deal(groups))
    found = searched(left.where("block = 0"), once.withColumn("block", F.lit(0)).withColumn("least", F.lit(None).cast("double")))
    if blocks > 1:
        keep = written(found, "found")
        least = keep.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") >= k)
        asks = once.join(least.select(F.col("query_id").alias("vec_id"), "least"), "vec_id", "left").withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(blocks - 1))))
        found = keep.unionAll(searched(left.where("block > 0"), asks))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def accesses(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> float:
    """The share of one block's vectors that the queries score in full, on average."""
    lists = np.argsort(x.T, axis=1, kind="stable").astype(np.int32)
    return float(np.mean([threshold_search(x, ids, lists, q, i, k)[2] / len(x) for q, i in zip(queries, own)]))


def top_k_query(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    vectors = usable(embeddings).withColumn("e", F.transform("e", lambda x: F.floor(x * 256).cast("double")))
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)


TOP_K_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
