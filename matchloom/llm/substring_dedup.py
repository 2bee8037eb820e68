"""Substring deduplication by level-wise doubling.

Windows of a short length that occur in a single document are discarded; places
where a repeated one survives are extended to twice that length and compared again,
and so on up to windows of n words, until no candidates survive: a level that keeps nothing
ends it.  Lengths double from level to level (where a length is odd, the two halves
of a window share its middle word): 7 and 13 for the default SHORTEST, 4, 7 and 13
for one of 4.  A shorter first level sends less for each place and keeps more places; for windows of 13
words one more level costs another exchange of the possible texts and gains nothing here.

At each level before the last a document sends not all its windows but one for each
place of n words: the smallest hash among the shorter windows in it.  Equal
places hold equal shorter windows and so send the same one; at the first
level about a quarter of the words are sent instead of all.

Memory and skew: each scan part combines equal windows before it sends them, so
a passage that a third of all documents hold reaches its bucket once for each
part.  Buckets are hash ranges sized to the data.  Only documents that may hold
a repeated window have their texts shuffled, twice.

Defined results: a null text has no words; a document shorter than the window
loses nothing; rows with the same doc_id are one document, so what they share
removes nothing (such rows are expected to hold one text: places found in one
apply to all); a row with a null doc_id takes no part and keeps its words; texts of any length
are read whole, and one text is the most that a worker holds beside its bucket; extra
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Scratch, U, Words, buckets, cogrouped, flat, grouped, joined, mix, pack, packed, runs, slices, slot_filter, spread, text_bytes, unpack, windows

TOP = U(0xFFFFFFFFFFFFFFFF)
ENTRIES = "b int, known boolean, who binary, docs binary, keys binary"
PLACES = "b int, known boolean, who binary, docs binary, pos binary"
BOTH = "b int, known boolean, who binary, docs binary, keys binary, pos binary"
#: The first level's windows have at least this many words.
SHORTEST = 7
#: Entries that a scan task or a bucket of documents gathers before it sends them.
FLUSH = 400_000
#: Bytes of text in one bucket of documents. A bucket is whole in a worker, and an executor may have four.
GROUP = 4e6
#: Bytes of text that are hashed at once, which takes some fifty times as many for a while; a longer text is one part.
SLICE = 250_000


def _lowest(row: np.ndarray, h: np.ndarray, n: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each place of n words starts, and the smallest hash of its windows of ``half`` words."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g, at = windows(h, row, half)
    full = np.full(len(h), TOP, np.uint64)
    full[at] = g
    low = full[:size].copy()
    for i in range(1, n - half + 1):
        np.minimum(low, full[i : i + size], out=low)
    place = np.flatnonzero(row[:size] == row[n - 1 :])
    return place, low[place]


def _parts(texts: pa.Table):
    """A bucket's documents, about SLICE bytes of text at a time."""
    return (part for batch in texts.to_batches() for part in slices(batch, limit=SLICE))


def _key_bucket(keys: np.ndarray, count: int) -> np.ndarray:
    return (keys >> U(20)) % U(count)


def _level(n: int, half: int, count: int):
    """Entries (window, document) of the first level."""

    def flush(kept):
        keys, docs = (np.concatenate(x) for x in zip(*kept))
        kept.clear()
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        begin, run = runs(keys)
        alone = (docs[begin[:-1]] == docs[begin[1:] - 1])[run]
        first = np.zeros(len(keys), bool)
        first[begin[:-1]] = True
        yield pack(_key_bucket(keys[first], count), count, False, docs[first], keys=keys[first])
        yield pack(spread(docs[~alone], count), count, True, docs[~alone], keys=keys[~alone])

    def run(parts):
        kept, size = [], 0
        for part in parts:
            words = Words(*flat(part.column("text")))
            place, low = _lowest(words.row, words.hashes(), n, half)
            if not len(place):
                continue
            doc = part.column("doc_id").to_numpy(zero_copy_only=False)[words.row[place]].astype(np.int64)
            change = np.concatenate(([True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])))
            kept.append((low[change], doc[change]))
            size += int(change.sum())
            if size > FLUSH:
                yield from flush(kept)
                size = 0
        if kept:
            yield from flush(kept)

    return run


def _repeated(count: int):
    """Of a bucket's entries those whose window two documents hold, regrouped by document."""

    def run(t: pa.Table) -> dict[str, list]:
        docs, known, keys = unpack(t, keys=np.uint64)
        kd, kk = docs[known], keys[known]
        docs, keys = docs[~known], keys[~known]
        order = np.lexsort((docs, keys))
        docs, keys = docs[order], keys[order]
        begin, r = runs(keys)
        many = (docs[begin[:-1]] != docs[begin[1:] - 1])[r] if len(keys) else np.zeros(0, bool)
        docs, keys = np.concatenate((kd, docs[many])), np.concatenate((kk, keys[many]))
        return pack(spread(docs, count), count, False, docs, keys=keys)

    return run


def lengths(n: int, shortest: int = SHORTEST) -> list[int]:
    """The lengths of all levels: each at most twice the one before, the last one n."""
    out = [n]
    while (out[0] + 1) // 2 >= max(shortest, 1) and out[0] > 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _extended(n: int, last: int, length: int, count: int):
    """Windows of ``length`` words of documents, at places whose smallest window of ``last`` words is repeated; those of n words with their positions."""

    def run(texts: pa.Table, found: pa.Table) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("b", "known", "who", "docs", "keys", "pos")}
        if not texts.num_rows or not found.num_rows:
            return out
        docs, _, keys = unpack(found, keys=np.uint64)
        wanted = np.unique(mix(docs.view(np.uint64)) ^ keys)
        del docs, keys

        def flush():
            w, doc, pos = (np.concatenate(x) for x in zip(*kept))
            kept.clear()
            order = np.lexsort((doc, w))
            w, doc, pos = w[order], doc[order], pos[order]
            begin, r = runs(w)
            later = doc > doc[begin[:-1]][r]  # repeated for sure
            if length < n:
                parts = ((False, np.ones(len(w), bool), _key_bucket(w, count)),)
            else:
                parts = ((False, ~later, _key_bucket(w[~later], count)), (True, later, spread(doc[later], count)))
            for known, keep, bucket in parts:
                for k, v in pack(bucket, count, known, doc[keep], keys=w[keep], pos=pos[keep]).items():
                    out[k] += v

        kept, size = [], 0
        for part in _parts(texts):
            ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            words = Words(*flat(part.column("text")))
            h = words.hashes()
            place, low = _lowest(words.row, h, n, last)
            if not len(place):
                continue
            key = mix(ids[words.row[place]].view(np.uint64)) ^ low
            hit = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
            at, w = _lowest(words.row, h, n, length)  # at equals place; of n words the window itself
            w, at = w[hit], at[hit]
            if not len(w):
                continue
            doc, pos = ids[words.row[at]], (at - words.first[words.row[at]]).astype(np.uint32)
            if length < n:
                keep = np.concatenate(([True], (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])))
                w, doc, pos = w[keep], doc[keep], pos[keep]
            kept.append((w, doc, pos))
            size += len(w)
            if size > FLUSH:
                flush()
                size = 0
        if kept:
            flush()
        return out

    return run


def _later(count: int):
    """Of a bucket's windows those that a smaller document holds too, regrouped by document."""

    def run(t: pa.Table) -> dict[str, list]:
        docs, known, keys, pos = unpack(t, keys=np.uint64, pos=np.uint32)
        kd, kp = docs[known], pos[known]
        docs, keys, pos = docs[~known], keys[~known], pos[~known]
        order = np.lexsort((docs, keys))
        docs, keys, pos = docs[order], keys[order], pos[order]
        begin, r = runs(keys)
        later = docs > docs[begin[:-1]][r] if len(keys) else np.zeros(0, bool)
        docs, pos = np.concatenate((kd, docs[later])), np.concatenate((kp, pos[later]))
        return pack(spread(docs, count), count, False, docs, pos=pos)

    return run


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _kept(text: bytes, starts: np.ndarray, n: int) -> tuple[int, int, bytes]:
    words = text.split()  # of bytes: at \x20 and \x09-\x0D
    if not len(starts):
        return len(words), 0, b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + n, len(words)), -1)
    keep = np.cumsum(cover[:-1]) == 0
    return len(words), int((~keep).sum()), b" ".join([words[i] for i in np.flatnonzero(keep)])


def _result(rows) -> dict[str, list]:
    out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": []}
    for doc, (n_words, n_removed, kept) in rows:
        out["doc_id"].append(doc)
        out["n_words"].append(n_words)
        out["n_removed"].append(n_removed)
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
    return out


def repeated_places(docs: DataFrame, keep: Scratch, n: int = 13, shortest: int = SHORTEST) -> tuple[DataFrame | None, Callable | None, int]:
    """Packed (document, start) of each window of n words that a smaller document holds too; a splitter of documents that may have some; the number of document buckets.

    Where a level keeps nothing there is neither table nor splitter.
    """
    spark = docs.sparkSession
    levels = lengths(n, shortest)
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total = text_bytes(known)
    count = buckets(spark, total / 24, 1e6)
    home = buckets(spark, total, GROUP)
    survivors = keep(grouped(packed(known, _level(n, levels[0], count), ENTRIES, limit=SLICE), "b", _repeated(home), ENTRIES), "windows")
    for last, length in zip(levels, levels[1:]):
        split = slot_filter(grouped(survivors.select("b", "docs"), "b", _ids, "id bigint"), "id")
        texts = split(known, "doc_id")[0].withColumn("b", _home(home))
        extended = cogrouped(texts, survivors, "b", _extended(n, last, length, count if length < n else home), BOTH)
        if length == n:
            return grouped(extended, "b", _later(home), PLACES), split, home
        survivors = keep(grouped(extended, "b", _repeated(home), ENTRIES), "windows")
        if not survivors.take(1):
            break
    return None, None, home


def _ids(t: pa.Table) -> dict[str, np.ndarray]:
    """A bucket's documents, each once; they are in no other bucket."""
    return {"id": np.unique(joined(t["docs"], np.int64))}


def _home(count: int):
    @F.pandas_udf("int")
    def home(ids):
        import pandas as pd

        return pd.Series(spread(ids.to_numpy(), count).astype(np.int32))

    return home("doc_id")


def remove_repeats(docs: DataFrame, n: int = 13, shortest: int = SHORTEST) -> DataFrame:
    """One row per document: its words, how many a repeated window covers, and the SHA-256 of the rest joined by one space."""
    if len(lengths(n, shortest)) < 2:
        raise ValueError("windows must have at least twice as many words as those of the first level")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    places, split, home = repeated_places(docs, Scratch(), n, shortest)

    def apart(t: pa.Table, found: pa.Table) -> dict[str, list]:
        at: dict[int, np.ndarray] = {}
        if found.num_rows:
            ids, _, pos = unpack(found, pos=np.uint32)
            order = np.argsort(ids, kind="stable")
            ids, pos = ids[order], pos[order].astype(np.int64)
            begin, _ = runs(ids)
            at = {int(ids[a]): pos[a:b] for a, b in zip(begin[:-1], begin[1:])}
        none = np.zeros(0, np.int64)

        def rows():
            for part in _parts(t):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    yield doc, _one(text or b"", at.get(doc, none), n)

        return _result(rows())

    def whole(parts):
        for part in parts:
            yield _result((doc, _kept(text or b"", np.zeros(0, np.int64), n)) for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()))

    if split is None:
        return packed(docs, whole, RESULT, limit=SLICE)
    possible, others = split(docs, "doc_id")
    first = cogrouped(possible.withColumn("b", _home(home)), places, "b", apart, RESULT)
    return first.unionAll(packed(others, whole, RESULT, limit=SLICE))


def _one(text: bytes, starts: np.ndarray, n: int):
    """Rows that share a doc_id but not a text may get places of each other; those past the end of a text are not its own."""
    if len(starts):
        starts = starts[starts + n <= len(text.split())]
    return _kept(text, starts, n)
