"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Sources in code-point order, null last, weigh 1, 2, 3 and so on in turn.  All
words of the input are shared by weight; no target is above three times its
source's words, and what is above is shared again among the others.

Document rates w minimise the relative entropy to one copy of each document,
sum(w log w - w + 1), under one token constraint for each source,
sum(w * size) = target, and 0 <= w <= CAP.  The solution is tilted exponentially,
``w = min(CAP, exp(lambda * size / mean))`` with one lambda for each source and its
mean size, so long documents move most.  Lambda solves the convex dual; each
Newton step is one grouped aggregation, with map-side combining, of the gradient
``target - sum(w * size)`` and of the second derivative over all documents (gathered once by
source and size), all sources at once, and falls back to bisection where a step
leaves the interval known to hold the root.

Rates are rounded to copies group by group: documents of a source are dealt by a
hash of their id into groups of about GROUP, so a source with a third of all
rows is many groups; inside a group, from the longest document to the shortest,
each gets the number of copies that comes nearest to its rate and what the ones
before it left owing, and the difference passes on.  Groups hold ids, hashes and sizes, no texts;
the mix itself joins copies to documents by these.  Reruns agree, whatever the
partitioning: documents are in the order of size, id and hash of the text, and rows that
agree in these are one item, whose copies are dealt out evenly.

Defined results: a null text has size 0; the null source is a source; a null id is an id; texts of any
length count whole; equal rows are documents of their own; a document without words keeps one copy;
a source without words has target 0 and takes
nothing; an empty table gives an empty result; the mix has the columns of the input, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from .shared import written

WORD = r"[^\x20\x09-\x0D]+"
#: Most copies of a document.
CAP = 3
#: Documents of a source that are rounded together.
GROUP = 500
#: Most Newton steps, and the part of a target that may be missing at their end.
STEPS, CLOSE = 60, 1e-10


def _size():
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint")


def _items(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, h, n``: documents that agree in id, source and text are one item of n."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", _size().alias("size"), F.xxhash64("text").alias("h"))
    return own.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("n"))


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 in code-point order, null last, by a range sort and the counts of its partitions."""
    order = F.col("source").asc_nulls_last()
    placed = sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id())
    placed = written(placed, "sources").withColumn("part", F.shiftright("at", 33))
    before = placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    return placed.join(before.select("part", "before"), "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "before", "at")


def source_targets(items: DataFrame) -> DataFrame:
    """``(source, source_size, n_docs, target)`` for each source."""
    sources = items.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    ranked = written(_ranked(sources).withColumn("weight", (F.col("rank") % 3 + 1).cast("double")).drop("rank"), "sources")
    total, weights = ranked.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level, last = (total / weights if weights else 0.0), None
    while level != last:  # each round stops at least one more source; the level only rises
        above = F.col("source_size") * CAP <= F.lit(level) * F.col("weight")
        held, free = ranked.agg(F.sum(F.when(above, F.col("source_size") * CAP)), F.sum(F.when(~above, F.col("weight")))).first()
        last, level = level, max(level, (total - (held or 0)) / free) if free else level
    target = F.least(F.lit(float(CAP)) * F.col("source_size"), F.lit(level or 0.0) * F.col("weight"))
    return ranked.select("source", "source_size", "n_docs", target.alias("target"))


def _tilt(tilt, size, mean):
    """A document's rate under its source's lambda."""
    return F.when(size > 0, F.exp(F.least(tilt * size / mean, F.lit(math.log(CAP))))).otherwise(1.0)


def balanced(items: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``mean`` and ``tilt``, the lambda of each source; that of a source at its cap is the largest double."""
    top, inf = 1.7e308, F.lit(float("inf"))
    sizes = written(items.where("size > 0").groupBy("source", "size").agg(F.sum("n").cast("double").alias("n")), "sizes")
    full = F.col("target") >= F.col("source_size") * (CAP * (1 - 1e-12))
    state = targets.withColumn("mean", F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9)))
    state = state.withColumn("tilt", F.when(full, F.lit(top)).otherwise(0.0)).withColumn("low", -inf).withColumn("high", inf).withColumn("off", F.when(full | (F.col("source_size") == 0), 0.0).otherwise(1.0))
    state = written(state, "tilts")
    for _ in range(STEPS):
        if not state.where("off > 0").take(1):
            break
        x, w = F.col("size") / F.col("mean"), _tilt(F.col("tilt"), F.col("size"), F.col("mean"))
        mass = F.col("n") * F.col("size") * w
        each = sizes.alias("z").join(state.where("off > 0").select(F.col("source").alias("own"), "mean", "tilt"), F.col("z.source").eqNullSafe(F.col("own")))
        sums = each.groupBy("own").agg(F.sum(mass).alias("got"), F.sum(F.when(w < CAP, mass * x)).alias("slope"))
        step = state.join(sums, F.col("source").eqNullSafe(F.col("own")), "left").withColumn("gradient", F.col("target") - F.col("got"))
        low = F.when(F.col("gradient") > 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("gradient") < 0, F.col("tilt")).otherwise(F.col("high"))
        step = step.withColumn("low", low).withColumn("high", high)
        newton = F.col("tilt") + F.col("gradient") / F.nullif(F.col("slope"), F.lit(0.0))
        middle = F.when(F.col("low") == -inf, F.col("high") * 2 - 1).when(F.col("high") == inf, F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        # the step itself where it stays inside
        inside = (newton > F.col("low")) & (newton < F.col("high")) & (F.abs(newton - F.col("tilt")) < 1 + 2 * F.abs(F.col("tilt")))
        close = F.abs(F.col("gradient")) <= F.col("target") * CLOSE
        step = step.withColumn("tilt", F.when(F.col("got").isNull() | close, F.col("tilt")).otherwise(F.when(inside, newton).otherwise(middle)))
        step = step.withColumn("off", F.when(F.col("got").isNull() | close, 0.0).otherwise(F.abs("gradient")))
        state = written(step.select(*state.columns), "tilts")
    # the same to nine digits however sums were ordered
    return state.select("source", "source_size", "n_docs", "target", "mean", F.when(F.col("tilt") < top, F.round("tilt", 9)).otherwise(F.col("tilt")).alias("tilt"))


def dealt(docs: DataFrame) -> DataFrame:
    """``doc_id, h, n, size, source, source_size, target, rate, copies`` for each item; copies is the total of its n documents."""
    items = written(_items(docs), "items")
    targets = balanced(items, source_targets(items))
    both = items.alias("d").join(targets.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")), "inner")
    both = both.select("d.*", "s.source_size", "s.target", "s.mean", "s.tilt", F.pmod(F.xxhash64("d.doc_id", "d.h", F.lit(11)), F.ceil(F.col("s.n_docs") / GROUP)).alias("part"))
    item = F.struct((-F.col("size")).alias("less"), "doc_id", "h", "n", "size")
    groups = both.groupBy("source", "part").agg(F.sort_array(F.collect_list(item)).alias("items"), *(F.first(c).alias(c) for c in ("source_size", "target", "mean", "tilt")))
    copies = F.aggregate("items", F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<bigint>").alias("copies")), lambda acc, d: _deal(acc, d, _tilt(F.col("tilt"), d["size"], F.col("mean"))), lambda acc: acc["copies"])
    each = groups.withColumn("copies", copies).select("source", "source_size", "target", "mean", "tilt", F.explode(F.arrays_zip("items", "copies")).alias("d"))
    each = each.select("d.items.*", "source", "source_size", "target", "mean", "tilt", F.col("d.copies").alias("copies"))
    return each.withColumn("rate", F.round(_tilt(F.col("tilt"), F.col("size"), F.col("mean")), 9))


def _deal(acc, d, rate):
    """As many copies as come nearest to what is owed; the difference passes to the next, smaller document."""
    size, n = d["size"], d["n"]
    owed = acc["owed"] + rate * size * n
    copies = F.when(size > 0, F.greatest(F.lit(0), F.least(CAP * n, F.floor(owed / F.greatest(size, F.lit(1)) + 0.5)))).otherwise(n).cast("bigint")
    return F.struct((owed - copies * size).alias("owed"), F.concat(acc["copies"], F.array(copies)).alias("copies"))


def _share(at):
    """Copies of the document ``at``, from 1, of an item."""
    return F.floor(F.col("copies") / F.col("n")) + (at <= F.col("copies") % F.col("n")).cast("bigint")


def mixed(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies, taken`` for each document."""
    each = dealt(docs).withColumn("at", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).withColumn("copies", _share(F.col("at")))
    return each.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_query(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it has copies, with the columns of the input.

    Documents of one item share its copies evenly; where these do not come out even,
    the first ones by a hash of source and text get one more.
    """
    copies = written(dealt(docs).select("doc_id", "h", "source", "n", "copies"), "copies").where("copies > 0")
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    key = (F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("doc_id"))) & (F.xxhash64("row.text") == F.col("h")) & F.col("row.source").eqNullSafe(F.col("source"))
    both = own.join(copies, key)
    uneven = F.col("copies") % F.col("n") > 0
    order = Window.partitionBy("doc_id", "h", "source").orderBy(F.xxhash64("row.text", "row.source"))
    even = both.where(~uneven).withColumn("at", F.lit(1))
    rest = both.where(uneven).withColumn("at", F.row_number().over(order))
    every = even.unionByName(rest).withColumn("copies", _share(F.col("at"))).where("copies > 0")
    return every.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")).select("row.*")
