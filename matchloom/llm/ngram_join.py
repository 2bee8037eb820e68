"""Similarity self-join of documents on their distinct five-word shingles, by universe partition.

Two sets r and s with 100 * |r & s| >= 75 * |r | s| differ in at most
H = floor((|r| + |s|) / 7) shingles.  Shingles are hashed into m > H segments; then
at least m - H segments are equal in r and s, and one of these is not empty if
either set fills more than H of them.  So it is enough to compare documents that
have a filled segment in common.

* Sizes double from one band to the next, so only documents of the same or of
  neighbouring bands can link; each band has its own m, which serves its links
  with itself and with the next band.
* Under the plan of its band (to look up), and under that of the band below where
  it is small enough for links there (to be found), a document sends
  only its first H + 1 filled segments, H for its own size, in one order that all
  documents share: by cost, then by hash.  Before the first segment that two linked
  sets have in common each of them has only segments the other lacks, at most H,
  so both send it.
* Cost follows from a segment's content: two or more uncommon shingles first,
  then one, then none (common in a sample of documents; the sample decides cost,
  never results).  Common segments thus travel only where others are too few.
* Sets with H = 1 are one segment with its one-deletion neighbourhood: two sets
  that differ in one shingle share the smaller one.
* A document whose shingles fill too few segments (rare for H > 1) is found by
  shingles instead: of any floor(size / 4) + 1 of its shingles a linked set holds at
  least one, so one more scan sends the documents' shingles that are among these.

Candidates first meet in parity sketches: each shingle flips one bit of a map
at least four times as long as the set, so two maps never differ in more bits than their sets
do in shingles, and a pair whose maps differ in more than H bits is dropped for
sure.  The rest are verified exactly on the shingle sets.  In a group of documents
that share a segment, only pairs with its smallest member, the centre, are verified
first.  Groups with one centre are then one; where it still has members in different
components, each member meets the nearest ones by sketch in other components:
one in the first round, MORE times as many in each further one, until no
group has a pair left that was not compared.  Groups of near copies
thus cost few pairs a member, and no link between separate components is lost.  Equal sets are one vertex from the start.

Memory and skew: segments travel packed, 6 bytes each, to buckets that are hash
ranges, with the names of those sets only that the bucket needs; 32 bits of a key
beside its range suffice, since a false agreement only costs a comparison.  A scan
task sends an equal set once.  Verification deals pairs by their
larger member, so a set with very many neighbours is sent to each partition at
most once.  A group with more than MEMBERS members is dealt by hash into parts,
and each two parts are a task of their own.

Shingles and sets are 64-bit hashes.  Defined results: a null text, or one
without words, has an empty set and no links; fewer than five words are one
shingle, the whole sequence; rows with equal sets link whatever their doc_id; a
row with a null doc_id takes no part and has a null component; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .shared import GOLD, POLY, SLOTS, Scratch, U, Words, buckets, by_bucket, cogrouped, components, flat, grouped, joined, mix, packed, runs, slot_filter, spread, text_bytes, windows, written

SHINGLE = 5
#: Bits of the map of common shingles, one document in how many it is taken from, and how often a sampled shingle is common.
COMMON_BITS, SAMPLE, COMMON = 22, 64, 3
#: Segments gathered by a scan task before it sends them, and documents in one part of them.
FLUSH, PART = 600_000, 32_000

#: Members of a group's part, pairs of a member in the first round, and how their number grows.
MEMBERS, NEAREST, MORE = 2048, 1, 8
#: Bits of the smallest and the largest parity sketch.
SKETCH = (256, 1 << 18)
#: kind 0: segments (x: names of sets, y: places in it, the top bit for one that looks up, z: keys); 1: documents (x: ids, y: sizes, z: sets); 2: sets that fill too few segments (x, y)
SENT = "b int, kind int, x binary, y binary, z binary"
#: kind 1 and 2 as before; 3: pairs (x, y); 4: members of groups of three or more (x: members, y: centres, z: which look up), by the place of the member
FOUND = SENT
META = "doc_id bigint, n_shingles bigint, v bigint"

# ---------------------------------------------------------------- bands


@lru_cache(maxsize=1)
def _firsts() -> np.ndarray:
    """The smallest size of each band: powers of two."""
    return 1 << np.arange(41)


def band_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(_firsts(), n, "right") - 1


def most_apart(r, s):
    """H: in how many shingles sets of r and s shingles that link may differ."""
    return (r + s) // 7


@lru_cache(maxsize=None)
def plan(band: int) -> tuple[int, int]:
    """H and the number of segments of links within a band and between it and the next one."""
    low, high = int(_firsts()[band]), int(_firsts()[band + 1]) - 1
    h = most_apart(high, high * 4 // 3)
    if h <= 1:
        return h, 1
    m = h + 1
    while m < 16 * high and not all(_fills(size, m, most_apart(size, size * 4 // 3) + 1) for size in (low, high)):
        m += max(1, m // 50)
    return h, m


def _fills(size: int, m: int, need: int) -> bool:
    """Whether a set of this size fills ``need`` of m segments but in very rare cases, with some to spare for common shingles."""
    load = size / m
    spread = math.sqrt(max(0.0, m * math.exp(-load) * (1 - (1 + load) * math.exp(-load))))
    return m * (1 - math.exp(-load)) - 5 * spread - 2 - 0.03 * m >= need


# ---------------------------------------------------------------- sets


def shingles(part: pa.RecordBatch, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, in order, and how many each row has."""
    words = Words(*flat(part.column("text")), lower=True)
    h = words.hashes()
    g, at = windows(h, words.row, n)
    row = words.row[at]
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(n - 1):
            more = words.count[short] > i
            whole[more] = whole[more] * U(POLY) + h[words.first[short[more]] + i]
        g = np.concatenate((g, mix(whole ^ (words.count[short].astype(np.uint64) << U(56)) ^ GOLD)))
        row = np.concatenate((row, short))
        order = np.argsort(row, kind="stable")
        g, row = g[order], row[order]
    at = np.searchsorted(row, np.arange(part.num_rows + 1))
    own = [np.unique(g[a:b]) for a, b in zip(at[:-1], at[1:])]
    return (np.concatenate(own) if own else g[:0]), np.array([len(x) for x in own], np.int64)


def vertices(sets: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A 63-bit name for each set; 0 for an empty one."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sets ^ GOLD), dtype=np.uint64)))
    end = np.cumsum(count)
    v = mix(total[end] - total[end - count] + count.astype(np.uint64)) >> U(1)
    return np.where(count == 0, 0, v.astype(np.int64))


def sketch_bytes(n: np.ndarray) -> np.ndarray:
    """Bytes of the sketch of a set: a power of two of bits, at least four times as many as shingles within limits."""
    return (np.clip(4 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), *SKETCH) >> 3).astype(np.int64)


def sketches(sets: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Parity sketches, one after another."""
    size = sketch_bytes(n) * 8
    base = np.concatenate(([0], np.cumsum(size)))
    doc = np.repeat(np.arange(len(n)), n)
    place = base[doc] + ((sets >> U(8)) & (size[doc] - 1).astype(np.uint64)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=base[-1]) & 1).astype(np.uint8))


def apart_at_least(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ; the longer one is folded."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = _halved(a)
    while len(b) > len(a):
        b = _halved(b)
    return int(np.bitwise_count(a ^ b).sum())


def _halved(a: np.ndarray) -> np.ndarray:
    return a[: len(a) // 2] ^ a[len(a) // 2 :]


# ---------------------------------------------------------------- sending


def _segments(sets, count, band, common):
    """Filled segments of documents under the plans of any bands: key, document, and how many uncommon shingles each has."""
    which, at = np.unique(band, return_inverse=True)
    m = np.array([plan(int(b))[1] for b in which], np.int64)[at]
    base = np.concatenate(([0], np.cumsum(m)))
    doc = np.repeat(np.arange(len(count)), count)
    place = base[doc] + ((sets >> U(16)) % m[doc].astype(np.uint64)).astype(np.int64)
    total, some, rare = np.zeros(base[-1], np.uint64), np.zeros(base[-1], np.int32), np.zeros(base[-1], np.int32)
    np.add.at(total, place, mix(sets))
    some = np.bincount(place, minlength=base[-1])
    rare = np.bincount(place, weights=~common, minlength=base[-1]).astype(np.int64)
    live = np.flatnonzero(some)
    who = np.searchsorted(base, live, "right") - 1
    name = (band[who].astype(np.uint64) << U(40)) + (live - base[who]).astype(np.uint64)
    return mix(total[live] + mix(name)), who, rare[live]


def _firsts_of(key: np.ndarray, who: np.ndarray, cost: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Places of each document's first ``limit`` entries by cost and key; equal keys keep the order of segments."""
    order = np.argsort((who.astype(np.uint64) << U(42)) | (cost.astype(np.uint64) << U(40)) | (key >> U(24)), kind="stable")
    w = who[order]
    return order[np.arange(len(w)) - np.searchsorted(w, w) < limit[w]]


HARD = U(0xD1B54A32D192ED03)


def entries(sets, count, common):
    """(key, document, whether it looks up) of all that documents send, and which documents fill too few segments."""
    docs = len(count)
    band = band_of(count)
    keys, who, ask, short = [], [], [], np.zeros(docs, bool)

    def add(k, d, a):
        keys.append(k)
        who.append(d)
        ask.append(np.broadcast_to(np.uint16(a), len(k)) if np.isscalar(a) else a.astype(np.uint16))

    tiny = np.array([plan(int(b))[0] <= 1 for b in band], bool)
    # below this size no set of the band below can link
    down = (band > 0) & (3 * count < 4 * _firsts()[np.maximum(band, 0)]) & (count > 0)
    tiny_down = np.array([b > 0 and plan(int(b) - 1)[0] <= 1 for b in band], bool)
    # sets that may differ in one shingle at most: the set and its one-deletion neighbourhood, over all bands
    near = np.flatnonzero(tiny | (down & tiny_down))
    if len(near):
        at = np.concatenate(([0], np.cumsum(count)))
        own = [(d, mix(sets[at[d] : at[d + 1]])) for d in near]
        k = np.concatenate([np.append(x.sum(dtype=np.uint64), x.sum(dtype=np.uint64) - x) if len(x) > 1 else x for _, x in own])
        add(mix(k ^ HARD), np.repeat(near, [len(x) + (len(x) > 1) for _, x in own]), 1)

    def take(chosen, bands, looks_up):
        """The first segments under the plans of ``bands``, which are those of the documents, or the ones below."""
        if not len(chosen):
            return
        doc = np.repeat(np.arange(docs), count)
        mine = np.isin(doc, chosen)
        key, w, rare = _segments(sets[mine], count[chosen], bands, common[mine])
        size = count[chosen]
        # the largest set of the other side that may link
        need = most_apart(size, size * 4 // 3 if looks_up else _firsts()[bands + 1] - 1) + 1
        if looks_up:
            short[chosen[np.bincount(w, minlength=len(chosen)) < need]] = True
        keep = _firsts_of(key, w, np.where(rare > 1, 0, np.where(rare > 0, 1, 2)), need)
        add(key[keep], chosen[w[keep]], int(looks_up))

    own = np.flatnonzero(~tiny & (count > 0))
    take(own, band[own], True)
    below = np.flatnonzero(down & ~tiny_down)
    take(below, band[below] - 1, False)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint16), short
    return np.concatenate(keys), np.concatenate(who), np.concatenate(ask), short


NONE = -(1 << 63)


def _send(count: int, common: np.ndarray):
    def flush(kept):
        v, n, keys, who, ask = ([k[i] for k in kept] for i in range(5))
        base = np.cumsum([0] + [len(x) for x in v[:-1]])
        v, n = np.concatenate(v), np.concatenate(n)
        keys, who, ask = np.concatenate(keys), np.concatenate([w + b for w, b in zip(who, base)]), np.concatenate(ask)
        kept.clear()
        order, at = by_bucket((((keys >> U(40)) * U(count)) >> U(24)).astype(np.int64), count)
        keys, who = keys[order], (who[order] | (ask[order].astype(np.int64) << 15)).astype(np.uint16)
        out: dict[str, list] = {k: [] for k in ("b", "kind", "x", "y", "z")}
        for b in np.flatnonzero(np.diff(at)):
            own = slice(at[b], at[b + 1])
            used, place = np.unique(who[own] & 0x7FFF, return_inverse=True)
            _put(out, int(b), 0, v[used].tobytes(), (place.astype(np.uint16) | who[own] & 0x8000).tobytes(), (keys[own] & U(0xFFFFFFFF)).astype(np.uint32).tobytes())
        return out

    def run(parts):
        kept, size, docs, seen = [], 0, 0, set()
        for part in parts:
            sets, n = shingles(part)
            v = vertices(sets, n)
            ids = pc.fill_null(part.column("doc_id").cast(pa.int64()), NONE).to_numpy(zero_copy_only=False)
            out: dict[str, list] = {k: [] for k in ("b", "kind", "x", "y", "z")}
            _put(out, int(mix(v[:1].view(np.uint64))[0] % U(count)), 1, ids.tobytes(), n.tobytes(), v.tobytes())
            new = np.zeros(len(v), bool)
            for i in np.flatnonzero((n > 0) & (ids != NONE)):
                if v[i] not in seen:
                    new[i] = True
                    seen.add(v[i])
            if len(seen) > 1_000_000:
                seen.clear()
            if new.any():
                chosen = sets[np.repeat(new, n)]
                at = (chosen >> U(64 - COMMON_BITS)).astype(np.int64)
                keys, who, ask, short = entries(chosen, n[new], common[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)
                if docs + new.sum() >= PART:
                    yield flush(kept)
                    size = docs = 0
                kept.append((v[new], n[new], keys, who, ask))
                size, docs = size + len(keys), docs + int(new.sum())
                if short.any():
                    _put(out, 0, 2, v[new][short].tobytes(), n[new][short].tobytes(), b"")
            yield out
            if size > FLUSH:
                yield flush(kept)
                size = docs = 0
        if kept:
            yield flush(kept)

    return run


def _put(out: dict[str, list], *values) -> None:
    for k, x in zip(("b", "kind", "x", "y", "z"), values):
        out[k].append(x)


# ---------------------------------------------------------------- finding


def _may_link(n, m):
    return 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)


def _candidates(t: pa.Table, count: int) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("b", "kind", "x", "y", "z")}
    keys, v, ask = [], [], []
    for b, kind, x, y, z in zip(*(t[k].to_pylist() for k in ("b", "kind", "x", "y", "z"))):
        if kind:
            _put(out, b, kind, x, y, z)
            continue
        who = np.frombuffer(y, np.uint16)
        keys.append(np.frombuffer(z, np.uint32))
        v.append(np.frombuffer(x, np.int64)[who & 0x7FFF])
        ask.append(who >> 15 == 1)
    if not keys:
        return out
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    shared = np.append(same, False) | np.concatenate(([False], same))
    order, keys = order[shared], keys[shared]
    v, ask = (np.concatenate(x)[order] for x in (v, ask))
    order = np.lexsort((~ask, v, keys))  # of equal sets one, that looks up if any does
    keys, v, ask = keys[order], v[order], ask[order]
    if len(keys):
        first = np.concatenate(([True], (keys[1:] != keys[:-1]) | (v[1:] != v[:-1])))
        keys, v, ask = keys[first], v[first], ask[first]
    order = np.lexsort((v, ~ask, keys))  # those that look up first
    keys, v, ask = keys[order], v[order], ask[order]
    begin, r = runs(keys)
    if not len(r):
        return out
    size = np.diff(begin)
    center = begin[:-1][r]
    pair = (np.arange(len(keys)) != center) & ask[center]
    a, z = np.minimum(v, v[center])[pair], np.maximum(v, v[center])[pair]
    both = np.unique(np.stack([a, z], 1), axis=0)
    b = t["b"][0].as_py()
    if len(both):
        _put(out, b, 3, both[:, 0].tobytes(), both[:, 1].tobytes(), b"")
    # groups of three or more, each member once for a centre, to the member's place
    many = pair & (size[r] > 2)
    if many.any():
        both = np.stack([v[many], v[center][many]], 1)
        order = np.lexsort((~ask[many], both[:, 1], both[:, 0]))
        both, asks = both[order], ask[many][order]
        first = np.concatenate(([True], (both[1:] != both[:-1]).any(1)))
        both, asks = both[first], asks[first]
        order, at = by_bucket(spread(both[:, 0], count), count)
        for k in np.flatnonzero(np.diff(at)):
            own = order[at[k] : at[k + 1]]
            _put(out, int(k), 4, both[own, 0].tobytes(), both[own, 1].tobytes(), asks[own].tobytes())
    return out


def _members(t: pa.Table) -> dict[str, list]:
    """Each member and centre once, and whether it looks up anywhere."""
    v, center, ask = joined(t["x"], np.int64), joined(t["y"], np.int64), joined(t["z"], bool)
    order = np.lexsort((~ask, center, v))
    v, center, ask = v[order], center[order], ask[order]
    first = np.concatenate(([True], (v[1:] != v[:-1]) | (center[1:] != center[:-1])))
    return {"v": v[first], "center": center[first], "ask": ask[first]}


def _across(t: pa.Table, limit: int) -> dict[str, list]:
    """Of one group, or of two parts of one, pairs in different components whose sketches leave room for a link; for each member the ``limit`` nearest behind it. Last, whether there were more."""
    v, root, n, part, ask = (t[k].to_numpy() for k in ("v", "root", "n", "part", "ask"))
    order = np.argsort(v)
    sketch = t["s"].to_pylist()
    v, root, n, part, ask = (x[order] for x in (v, root, n, part, ask))
    width = int(sketch_bytes(n).min())
    # all sketches folded to the shortest
    rows = np.stack([np.bitwise_xor.reduce(np.frombuffer(sketch[i], np.uint8).reshape(-1, width), axis=0) for i in order])
    two = part[0] != part[-1] or (part != part[0]).any()
    found, more = [], False
    for i in range(len(v) - 1):  # one member at a time, so memory is in proportion to the group
        ok = (root[i + 1 :] != root[i]) & (ask[i] | ask[i + 1 :]) & _may_link(n[i], n[i + 1 :])
        if two:
            ok &= part[i + 1 :] != part[i]
        ok = np.flatnonzero(ok) + i + 1
        if len(ok):
            far = np.bitwise_count(rows[ok] ^ rows[i]).sum(1).astype(np.int64) - most_apart(n[i], n[ok])
            ok, far = ok[far <= 0], far[far <= 0]
        if len(ok) > limit:
            ok, more = ok[np.lexsort((ok, far))[:limit]], True
        if len(ok):
            found.append(np.stack([np.full(len(ok), v[i]), v[ok]], 1))
    both = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return {"a": [*both[:, 0].tolist(), *[None] * more], "b": [*both[:, 1].tolist(), *[None] * more]}


def _sketched(members: DataFrame, outlines: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of groups that are not yet one component, dealt into tasks, with what ``_across`` needs."""
    own = members.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    size = own.groupBy("center").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    size = size.where("low <> high").select("center", F.ceil(F.col("size") / MEMBERS).cast("int").alias("parts"))
    own = own.join(size, "center").withColumn("part", F.pmod(F.xxhash64("v", F.lit(9)), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = own.withColumn("other", other).withColumn("task", F.xxhash64("center", F.least("part", "other"), F.greatest("part", "other")))
    return dealt.join(outlines, "v").select("task", "v", "root", "n", "s", "part", "ask")


def _rows(found: DataFrame, kind: int, schema: str) -> DataFrame:
    """Packed numbers as rows."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            cols = [joined(pa.chunked_array([batch.column(k)]), np.int64) for k in ("x", "y", "z")[: len(names)]]
            for at in range(0, len(cols[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in cols], names=names)

    return found.where(F.col("kind") == kind).select("x", "y", "z").mapInArrow(run, schema)


# ---------------------------------------------------------------- verifying


def _verified(docs: DataFrame, meta: DataFrame, pairs: DataFrame, count: int, keep: Scratch) -> DataFrame:
    """The pairs (a, b) of sets whose similarity reaches the threshold, from the texts of one document of each set, in ``count`` parts."""
    pairs = pairs.withColumn("p", F.pmod(F.xxhash64("b"), F.lit(count)).cast("int"))
    wanted = pairs.select(F.col("a").alias("v"), "p").unionAll(pairs.select(F.col("b").alias("v"), "p"))
    wanted = wanted.groupBy("v").agg(F.collect_set("p").alias("p"))
    one = meta.where("doc_id is not null").groupBy("v").agg(F.min("doc_id").alias("doc_id"))
    wanted = keep(wanted.join(one, "v"), "wanted")
    split = slot_filter(wanted.select("doc_id"), "doc_id")
    texts = split(docs.where("doc_id is not null").select("doc_id", "text"), "doc_id")[0].join(wanted, "doc_id").select("v", "p", "text")

    def sets(part):
        s, n = shingles(part)
        v = vertices(s, n)
        end = np.cumsum(n)
        out: dict[str, list] = {"p": [], "v": [], "s": []}
        want = part.column("v").to_numpy(zero_copy_only=False)
        for i, p in enumerate(part.column("p").to_pylist()):
            if v[i] == want[i]:  # rows that share a doc_id need not share a text
                s_ = s[end[i] - n[i] : end[i]].tobytes()
                for x in p:
                    out["p"].append(x)
                    out["v"].append(int(v[i]))
                    out["s"].append(s_)
        yield out

    sent = packed(texts, lambda parts: (x for part in parts for x in sets(part)), "p int, v bigint, s binary")

    def verify(pairs: pa.Table, sets: pa.Table) -> dict[str, list]:
        out: dict[str, list] = {"a": [], "b": []}
        own = {v: s for v, s in zip(sets["v"].to_pylist(), sets["s"].to_pylist())}
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
            if a in own and b in own:
                x, y = np.frombuffer(own[a], np.uint64), np.frombuffer(own[b], np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    out["a"].append(a)
                    out["b"].append(b)
        return out

    return cogrouped(pairs, sent, "p", verify, "a bigint, b bigint")


def _near(pairs: DataFrame, outlines: DataFrame) -> DataFrame:
    """The pairs whose sketches leave room for a link."""
    both = pairs.join(outlines.select(F.col("v").alias("a"), F.col("s").alias("x"), F.col("n").alias("n")), "a").join(outlines.select(F.col("v").alias("b"), F.col("s").alias("y"), F.col("n").alias("k")), "b").where("4 * least(n, k) >= 3 * greatest(n, k)")

    def run(batches):
        for batch in batches:
            a, b, x, n, y, k = (batch.column(c) for c in ("a", "b", "x", "n", "y", "k"))
            limit = most_apart(n.to_numpy(), k.to_numpy())
            keep = pa.array([apart_at_least(p, q) <= h for p, q, h in zip(x.to_pylist(), y.to_pylist(), limit.tolist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(keep)

    return both.select("a", "b", "x", "n", "y", "k").mapInArrow(run, "a bigint, b bigint")


def _outlines(docs: DataFrame, meta: DataFrame, wanted: DataFrame) -> DataFrame:
    """``v, n, s``: sketches of the wanted sets ``v``, read from one document of each, and perhaps of some others.

    The texts are read again, since most sets have no candidate at all; they don't travel.
    """
    one = meta.where("doc_id is not null").groupBy("v").agg(F.min("doc_id").alias("doc_id"))
    split = slot_filter(wanted.join(one, "v"), "doc_id")

    def run(parts):
        for part in parts:
            sets, n = shingles(part)
            s, end = sketches(sets, n).tobytes(), np.cumsum(sketch_bytes(n))
            yield {"v": vertices(sets, n), "n": n, "s": [s[x:y] for x, y in zip(end - sketch_bytes(n), end)]}

    return packed(split(docs.where("doc_id is not null"), "doc_id")[0].select("text"), run, "v bigint, n bigint, s binary")


def _common(docs: DataFrame) -> np.ndarray:
    """A map of shingles that several sampled documents hold; of fixed size."""
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")

    def run(parts):
        for part in parts:
            s, _ = shingles(part)
            x, n = np.unique((s >> U(64 - COMMON_BITS)).astype(np.int64), return_counts=True)
            yield {"x": x, "n": n}

    found = packed(sample, run, "x bigint, n bigint").groupBy("x").agg(F.sum("n").alias("n"))
    # in a large sample chance alone fills the map, so what is common rises with it
    mean = (found.agg(F.sum("n")).first()[0] or 0) / (1 << COMMON_BITS)
    at = found.where(F.col("n") >= COMMON + math.ceil(mean + 5 * math.sqrt(mean))).select("x").toArrow().column("x").to_numpy()
    bits = np.zeros((1 << COMMON_BITS) // 8, np.uint8)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def _slot(x: np.ndarray) -> np.ndarray:
    return (mix(x.view(np.uint64)) % U(SLOTS)).astype(np.int64)


def _slots_of(df: DataFrame):
    """The places of a number column in a bitmap of fixed size, sent to all workers."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))], names=["s"])

    at = df.mapInArrow(run, "s bigint").distinct().toArrow().column("s").to_numpy()
    bits = np.zeros(SLOTS // 8, np.uint8)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return df.sparkSession.sparkContext.broadcast(bits)


def _in_slots(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = _slot(x)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _by_shingles(docs: DataFrame, short: DataFrame, keep: Scratch) -> DataFrame:
    """Pairs (a, b) of the sets ``short`` (v, n) with all that hold one of floor(n / 4) + 1 of their shingles.

    A set that links holds at least three quarters of either set's shingles.
    """
    asked = _slots_of(short.select("v"))

    def probes(parts):
        for part in parts:
            sets, n = shingles(part)
            v = vertices(sets, n)
            need = np.where(_in_slots(v, asked.value) & (n > 0), n // 4 + 1, 0)
            mine = np.arange(len(sets)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(need, n)
            yield {"a": np.repeat(v, need), "k": sets[mine].view(np.int64)}

    texts = docs.where("doc_id is not null").select("text")
    wanted = keep(packed(texts, probes, "a bigint, k bigint").join(short.select(F.col("v").alias("a")), "a", "left_semi").distinct(), "probes")
    bits = _slots_of(wanted.select("k"))

    def held(parts):
        for part in parts:
            sets, n = shingles(part)
            hit = _in_slots(sets.view(np.int64), bits.value)
            yield {"b": np.repeat(vertices(sets, n), n)[hit], "k": sets[hit].view(np.int64)}

    pairs = packed(texts, held, "b bigint, k bigint").distinct().join(wanted, "k").where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total, keep = text_bytes(docs), Scratch()
    count, home = buckets(spark, total / 6, 2e6), buckets(spark, total, 24e6)
    common = spark.sparkContext.broadcast(_common(docs))
    sent = packed(docs, lambda parts: _send(count, common.value)(parts), SENT)
    found = keep(grouped(sent, "b", partial(_candidates, count=home), FOUND), "segments")
    meta = _rows(found, 1, META).withColumn("doc_id", F.when(F.col("doc_id") != NONE, F.col("doc_id")))
    pairs = _rows(found, 3, "a bigint, b bigint").distinct()
    short = _rows(found, 2, "v bigint, n bigint").distinct()
    if short.take(1):
        pairs = pairs.unionAll(_by_shingles(docs, keep(short, "short"), keep)).distinct()
    members = keep(grouped(found.where("kind = 4").select("b", "x", "y", "z"), "b", _members, "v bigint, center bigint, ask boolean"), "members")
    wanted = pairs.select(F.col("a").alias("v")).unionAll(pairs.select(F.col("b").alias("v"))).unionAll(members.select("v")).distinct()
    outlines = keep(_outlines(docs, meta, keep(wanted, "sets")), "outlines")
    pairs = keep(_near(pairs, outlines).distinct(), "pairs")
    links = keep(_verified(docs, meta, pairs, home, keep), "links")
    roots, limit = keep(components(links), "roots"), NEAREST
    while True:
        task = _sketched(members, outlines, roots)
        across = keep(grouped(task, "task", partial(_across, limit=limit), "a bigint, b bigint").distinct(), "across")
        new = across.where("a is not null").join(pairs, ["a", "b"], "left_anti")
        if new.take(1):
            linked_now = keep(_verified(docs, meta, new, home, keep), "links")
            pairs = keep(pairs.unionAll(new), "pairs")
            if linked_now.take(1):
                links = links.unionAll(linked_now)
                roots = keep(components(links), "roots")
        if not across.where("a is null").take(1):
            break
        limit *= MORE
    named = meta.join(roots, "v", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "v")).alias("root"))
    named = written(named, "named")
    keep.drop()
    least = named.where("doc_id is not null and root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    own = named.join(least, "root", "left")
    return own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
