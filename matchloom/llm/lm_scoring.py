"""Perplexity from an interpolated modified Kneser-Ney model of words, of any order from two on; three by default.

Counting is one Spark job with two exchanges, whatever the order.  A scan task
hashes its words and counts its n-grams; these travel once, packed with a dictionary of
the words in each row, to the bucket of the word v before their last word w.  All
contexts that end in v and all shorter n-grams that end in v w are complete
there, so a worker derives every order below from the one above: an n-gram's
shorter form counts the different words before it (at the beginning of a text,
where nothing stands before, its occurrences).  For each order the worker writes n-grams and
contexts as sorted hash arrays into the shared folder, and sends on, for each word w, how
many different words precede it.  Those meet in the word's own bucket and become
the array of words.

Skew: a word v that precedes a large part of all words has its n-grams dealt over all
buckets by w, and a pair v w that is as frequent by the word before it.  The
statistics of their contexts, and counts of such pairs, are then partial and are
summed in the second exchange, spread by context or word.  Which words and pairs these
are is taken from a sample of documents, which decides placement only.  The driver gets
sums, and the statistics of frequent words, at most one for each bucket.

Scoring maps the arrays into memory, so workers of a machine share their pages;
a part of the documents looks its n-grams up in hash order, bucket by bucket, and
longer ones only where shorter ones were found.  Where the shared folder is not
mounted as a file system the arrays are read through its own file system instead.
A missing array is an error.

Memory: a scan task puts the tokens it has gathered in the order of their buckets, as
32-bit places in its words; hashes, sums and lookups are then made for a few buckets,
about PIECE n-grams, at a time.

Retries: each array is written under a temporary name and renamed, with the same
content each time.  The arrays stay in the shared folder until ``Model.drop``, since
scores are computed when they are asked for.

Words are 48-bit hashes; n-grams are 64-bit ones, of which the arrays keep 44 bits beside the
bucket, so that of ten million lookups of what is not there less than one finds something.  Keys with the usual counts, most of all, are kept apart without them.

Defined results: a null or empty text is the single end token; a null doc_id
counts as the empty string, so its text is learnt from; a word never seen gets
the uniform share; without training texts all tokens share the uniform 1/(V+1); an empty table gives an
empty result; texts of any length are counted and scored whole, one text is the
most that a worker holds beside FLUSH tokens.
Extra columns are ignored; equal rows are counted as often as they occur.
"""

from __future__ import annotations

import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import GOLD, POLY, U, Words, buckets, by_bucket, flat, grouped, joined, mix, packed, runs, shared_dir, text_bytes

#: Words of the longest n-gram.
ORDER = 3
END, BEGIN, WORD = U(0x0123456789AB), U(0xFEDCBA987654), U((1 << 48) - 1)
#: Tokens that a scan task gathers before it counts or scores them.
FLUSH = 1_000_000
#: N-grams of those tokens that are hashed, summed or looked up at once.
PIECE = 1 << 17
#: One document in so many is sampled to find frequent words and pairs.
SAMPLE = 64
#: level n >= 2: n-grams (words: a dictionary, x: n columns of places in it, c: counts, over: those above 254); 1: words (words, c: how many different ones precede each, then how often each occurs, over); 0: facts (words: names, x: five numbers each); -2: contexts (words, c: four numbers each, over); -3: frequent pairs (words: first and last word of each, c, over)
SENT = "b int, level int, words binary, x binary, c binary, over binary"
FACTS = "kind int, v bigint, a double, b double, c double, d double"

# ---------------------------------------------------------------- arrays in the shared folder


def _local(path: str) -> str | None:
    for prefix in ("file://", "file:"):
        if path.startswith(prefix):
            return path[len(prefix) :]
    return path if path.startswith("/") else None


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    local = _local(folder)
    for k, x in arrays.items():
        if local:
            os.makedirs(local, exist_ok=True)
            temporary = f"{local}/.{name}.{k}.{uuid.uuid4().hex}"
            x.tofile(temporary)
            os.replace(temporary, f"{local}/{name}.{k}")
        else:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(f"{folder}/.{name}.{k}.{uuid.uuid4().hex}")
            with system.open_output_stream(path) as f:
                f.write(x.tobytes())
            system.move(path, fs.FileSystem.from_uri(f"{folder}/{name}.{k}")[1])


def _load(folder: str, name: str, k: str, kind: type) -> np.ndarray:
    """An array, mapped into memory as long as it is in use; its pages stay in the machine's cache."""
    local = _local(folder)
    if local:
        path = f"{local}/{name}.{k}"
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    return _fetched(folder, name, k, kind)


@lru_cache(maxsize=64)
def _fetched(folder: str, name: str, k: str, kind: type) -> np.ndarray:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(f"{folder}/{name}.{k}")
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def _small(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts in a byte each, 255 for more, and those counts."""
    return np.minimum(c, 255).astype(np.uint8), c[c >= 255].astype(np.int64)


#: Fewer keys than this are kept whole; the upper bits of others, of BITS, are places in a table, the lower 32 are kept.
FEW, BITS, UPPER = 1 << 12, 44, 12


def _save_map(folder: str, name: str, keys: np.ndarray, values: np.ndarray) -> None:
    """A hash array: sorted 64-bit keys, of which BITS stay, and a few counts for each; where the first two are 1 and others 0, the key alone."""
    values = values.reshape(len(keys), -1) if len(keys) else np.zeros((0, 1), np.int64)
    usual = (values[:, :2] == 1).all(1) & (values[:, 2:] == 0).all(1)
    _save_keys(folder, f"{name}-usual", keys[usual])
    keys, values = keys[~usual], values[~usual].reshape(-1)
    _save_keys(folder, name, keys)
    c, over = _small(values)
    _save(folder, name, c=c, at=np.flatnonzero(values >= 255).astype(np.int64), over=over)


def _save_keys(folder: str, name: str, keys: np.ndarray) -> None:
    key = keys >> U(64 - BITS)
    if len(key) < FEW:
        _save(folder, name, low=np.zeros(0, np.uint32), whole=key)
    else:
        _save(folder, name, low=(key & U(0xFFFFFFFF)).astype(np.uint32), high=np.searchsorted(key, np.arange((1 << UPPER) + 1, dtype=np.uint64) << U(32)).astype(np.uint32))


def _place(folder: str, name: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are there, and where: the upper bits give a short range, in which a binary search goes on."""
    key, low = keys >> U(64 - BITS), _load(folder, name, "low", np.uint32)
    if not len(low):
        whole = _load(folder, name, "whole", np.uint64)
        at = np.minimum(np.searchsorted(whole, key), max(len(whole) - 1, 0))
        return (whole[at] == key if len(whole) else np.zeros(len(key), bool)), at
    high = _load(folder, name, "high", np.uint32)
    top, want = (key >> U(32)).astype(np.int64), (key & U(0xFFFFFFFF)).astype(np.uint32)
    a, z = high[top].astype(np.int64), high[top + 1].astype(np.int64)
    end = z.copy()
    for _ in range(int((z - a).max(initial=0)).bit_length()):
        mid = (a + z) >> 1
        less = (a < z) & (low[np.minimum(mid, len(low) - 1)] < want)
        a, z = np.where(less, mid + 1, a), np.where(less, z, mid)
    return (a < end) & (low[np.minimum(a, len(low) - 1)] == want), a


def _look(folder: str, name: str, keys: np.ndarray, width: int = 1) -> np.ndarray:
    """The counts of keys, 0 for those that are not there."""
    out = np.zeros((len(keys), width), np.int64)
    ok, _ = _place(folder, f"{name}-usual", keys)
    out[ok, :2] = 1
    rest = np.flatnonzero(~ok)
    ok, at = _place(folder, name, keys[rest])
    at = (at[ok][:, None] * width + np.arange(width)).reshape(-1)
    c = _load(folder, name, "c", np.uint8)[at].astype(np.int64)
    if (c == 255).any():
        c[c == 255] = _load(folder, name, "over", np.int64)[np.searchsorted(_load(folder, name, "at", np.int64), at[c == 255])]
    out[rest[ok]] = c.reshape(-1, width)
    return out


# ---------------------------------------------------------------- tokens


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's hash, its place in its text, and its row: the words of each text, then one end."""
    words = Words(*flat(part.column("text")), lower=True)
    rows, n = len(words.count), len(words.start)
    w = np.full(n + rows, END, np.uint64)
    ends = np.cumsum(words.count + 1) - 1
    inside = np.ones(n + rows, bool)
    inside[ends] = False
    w[inside] = words.hashes() & WORD
    place = np.arange(n + rows, dtype=np.int32) - np.repeat((ends - words.count).astype(np.int32), words.count + 1)
    return w, place, np.repeat(np.arange(rows, dtype=np.int32), words.count + 1)


def _before(w: np.ndarray, place: np.ndarray, back: int, begin) -> np.ndarray:
    """The token ``back`` places before each; at the beginning of a text ``begin``."""
    out = np.empty_like(w)
    out[back:] = w[:-back] if back < len(w) else w[:0]
    out[:back] = begin
    out[place < back] = begin
    return out


def _first(words: np.ndarray) -> np.ndarray:
    return mix(words ^ GOLD)


def _longer(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hash of a sequence with one more word."""
    return mix(key * U(POLY) + words)


def _sequence(words: list[np.ndarray]) -> np.ndarray:
    key = _first(words[0])
    for w in words[1:]:
        key = _longer(key, w)
    return key


class Layout:
    """Where n-grams are: the number of buckets, frequent words, and frequent pairs by their hash, both sorted."""

    def __init__(self, count: int, hot: np.ndarray, pairs: np.ndarray):
        self.count, self.hot, self.pairs = count, hot, pairs

    def bucket(self, columns: list[np.ndarray]) -> np.ndarray:
        """Of n-grams, by the word before the last one; the last one where that is frequent; the one before both where the pair is."""
        v, w = columns[-2:]
        by = np.where(np.isin(v, self.hot), w, v)
        if len(columns) > 2 and len(self.pairs):
            by = np.where(self.frequent(v, w), columns[-3], by)
        return (mix(by) >> U(8)) % U(self.count)

    def frequent(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.isin(_sequence([v, w]), self.pairs) if len(self.pairs) else np.zeros(len(v), bool)

    def word_bucket(self, w: np.ndarray) -> np.ndarray:
        return (mix(w ^ GOLD) >> U(8)) % U(self.count)

    def context_bucket(self, key: np.ndarray) -> np.ndarray:
        return (key >> U(8)) % U(self.count)


def _bucket_of(at: Layout, words: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """The buckets of n-grams whose columns are places in ``words``."""
    out = np.empty(len(columns[0]), np.uint16 if at.count < 65536 else np.uint32)
    for a in range(0, len(out), PIECE):
        out[a : a + PIECE] = at.bucket([words[x[a : a + PIECE]] for x in columns])
    return out


def _pieces(bucket: np.ndarray, count: int):
    """Places of entries by bucket, so many whole buckets at a time that they hold about PIECE of them."""
    order, begin = by_bucket(bucket, count)
    b = 0
    while b < count:
        to = max(b + 1, int(np.searchsorted(begin, begin[b] + PIECE, "right")) - 1)
        if begin[to] > begin[b]:
            yield order[begin[b] : begin[to]]
        b = to


def _begins(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.ones(len(sorted_keys), bool)
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def _summed(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each key, in the order of keys, and the sum of its counts."""
    order = np.argsort(key)
    begin = _begins(key[order])
    return order[begin], np.add.reduceat(c[order], begin) if len(key) else c


# ---------------------------------------------------------------- counting


def _new() -> dict[str, list]:
    return {k: [] for k in ("b", "level", "words", "x", "c", "over")}


def _put(out: dict[str, list], b: int, level: int, words: bytes, x: bytes = b"", c: np.ndarray | None = None) -> None:
    small, over = _small(c) if c is not None else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
    for k, value in zip(out, (int(b), level, words, x, small.tobytes(), over.tobytes())):
        out[k].append(value)


def _squeezed(x: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bytes of each number, all first bytes before all second ones, compressed."""
    raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)[:, :width].T).tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unsqueezed(raw: bytes, kind: type, width: int) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(raw[8:], n * width, "zstd"), np.uint8).reshape(width, n).T
    return out.view(kind).reshape(-1)


def _counts(c: bytes, over: bytes) -> np.ndarray:
    out = np.frombuffer(c, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(over, np.int64)
    return out


def _put_words(out: dict[str, list], at: Layout, w: np.ndarray, types: np.ndarray, c: np.ndarray) -> None:
    order, begin = by_bucket(at.word_bucket(w).astype(np.int64), at.count)
    for b in np.flatnonzero(np.diff(begin)):
        own = order[begin[b] : begin[b + 1]]
        own = own[np.argsort(w[own])]
        _put(out, b, 1, _squeezed(w[own], 6), c=np.concatenate((types[own], c[own])))


def _count(at: Layout, n: int):
    def flush(kept):
        w, place = (np.concatenate(x) for x in zip(*kept))
        kept.clear()
        words, ids = np.unique(w, return_inverse=True)
        del w
        ids, words = ids.astype(np.uint32), np.append(words, BEGIN)
        columns = [_before(ids, place, k, len(words) - 1) for k in range(n - 1, 0, -1)] + [ids]
        local = np.zeros(len(words), np.uint32)
        for k in range(2, n + 1):  # shorter ones at the beginning of a text only
            chosen = np.flatnonzero(place >= n - 2 if k == n else place == k - 2)
            if not len(chosen):
                continue
            some = [x[chosen] for x in columns[n - k :]]
            del chosen
            all_buckets = _bucket_of(at, words, some)
            for piece in _pieces(all_buckets, at.count):
                out, own = _new(), [x[piece] for x in some]
                one, c = _summed(_sequence([words[x] for x in own]), np.ones(len(piece), np.int64))
                own, bucket = [x[one] for x in own], all_buckets[piece[one]].astype(np.int64)
                order = np.argsort(bucket * len(words) + own[-2], kind="stable")  # equal words together compress well
                begin, own, c = np.searchsorted(bucket[order], np.arange(at.count + 1)), [x[order] for x in own], c[order]
                for b in np.flatnonzero(np.diff(begin)):
                    part = slice(begin[b], begin[b + 1])
                    times = np.bincount(np.concatenate([x[part] for x in own]), minlength=len(words))
                    used = np.flatnonzero(times)
                    used = used[np.argsort(-np.log2(times[used]).astype(np.int64), kind="stable")]  # frequent ones first, so that places are small numbers; each kind in the order of hashes
                    local[used] = np.arange(len(used))
                    kind = np.uint16 if len(used) < 65536 else np.uint32
                    _put(out, b, k, _squeezed(words[used], 6), _squeezed(np.concatenate([local[x[part]] for x in own]).astype(kind), kind().itemsize), c[part])
                yield out

    def run(parts):
        kept, size = [], 0
        for part in parts:
            w, place, _ = _tokens(part)
            kept.append((w, place))
            size += len(w)
            if size > FLUSH:
                yield from flush(kept)
                size = 0
        if kept:
            yield from flush(kept)

    return run


def _classes(c: np.ndarray) -> list[np.ndarray]:
    return [c == 1, c == 2, c >= 3]


def _merge(folder: str, at: Layout, n: int):
    """All orders of the n-grams of one bucket."""

    def run(t: pa.Table) -> dict[str, list]:
        b, out = t["b"][0].as_py(), _new()
        given: dict[int, list] = {k: [] for k in range(2, n + 1)}
        for level, words, x, c, over in zip(*(t[k].to_pylist() for k in ("level", "words", "x", "c", "over"))):
            if level < 2:  # on its way to the second exchange
                for k, value in zip(out, (b, level, words, x, c, over)):
                    out[k].append(value)
                continue
            words, c = _unsqueezed(words, np.uint64, 6), _counts(c, over)
            kind = np.uint16 if len(words) < 65536 else np.uint32
            places = _unsqueezed(x, kind, kind().itemsize).reshape(level, -1)
            given[level].append(([words[p] for p in places], c))
        above, facts = None, [[-1.0, b, 0, 0, 0, 0]]
        # every token ends one of the n-grams that were sent
        last = np.concatenate([p[0][-1] for parts in given.values() for p in parts] or [np.zeros(0, np.uint64)])
        one, occurs = _summed(last, np.concatenate([p[1] for parts in given.values() for p in parts] or [np.zeros(0, np.int64)]))
        last = last[one]
        for k in range(n, 1, -1):
            parts, above = given.pop(k) + ([above] if above else []), None
            c = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            columns = [np.concatenate([p[0].pop(0) for p in parts]) if parts else np.zeros(0, np.uint64) for _ in range(k)]  # each part goes when it is copied
            del parts
            one, c = _summed(_sequence(columns), c)
            for i in range(k):
                columns[i] = columns[i][one]
            del one
            if k == 2:
                often = at.frequent(*columns)
                if often.any():
                    both, some = np.stack([x[often] for x in columns], 1), c[often]
                    order, begin = by_bucket(at.word_bucket(both[:, 1]).astype(np.int64), at.count)
                    for to in np.flatnonzero(np.diff(begin)):
                        own = order[begin[to] : begin[to + 1]]
                        _put(out, to, -3, both[own].tobytes(), c=some[own])
                    columns, c = [x[~often] for x in columns], c[~often]
            _save_map(folder, f"gram-{k}-{b}", _sequence(columns), c)
            facts.append([float(k), 0.0, *(int((c == i).sum()) for i in (1, 2, 3, 4))])
            context = _sequence(columns[:-1])
            order = np.argsort(context)
            begin = _begins(context[order])
            first, sorted_c = order[begin], c[order]
            context = context[first]
            del order
            each = np.zeros((len(first), 4), np.int64)
            for i, x in enumerate((sorted_c, *_classes(sorted_c)) if len(first) else ()):
                each[:, i] = np.add.reduceat(x, begin, dtype=np.int64)
            hot = np.isin(columns[-2][first], at.hot)
            _save_map(folder, f"context-{k}-{b}", context[~hot], each[~hot])
            if k == 2:
                facts += [[-2.0, int(v.view(np.int64)), *map(float, x)] for v, x in zip(columns[0][first[hot]], each[hot])]
                types = np.bincount(np.searchsorted(last, columns[1]), minlength=len(last))
                _put_words(out, at, last, types, occurs)
            elif hot.any():
                keys, stats = context[hot], each[hot]
                order, begin = by_bucket(at.context_bucket(keys).astype(np.int64), at.count)
                for to in np.flatnonzero(np.diff(begin)):
                    own = order[begin[to] : begin[to + 1]]
                    _put(out, to, -2, keys[own].tobytes(), c=stats[own].reshape(-1))
            above = (columns[1:], np.ones(len(c), np.int64))
        _put_facts(out, at, b, facts)
        return out

    return run


def _put_facts(out: dict[str, list], at: Layout, b: int, facts: list) -> None:
    """Facts, a kind, a name and four numbers each; those of a word go to its bucket."""
    by: dict[int, list] = {}
    for kind, name, *x in facts:
        to = int(at.context_bucket(mix(np.array([name], np.int64).view(np.uint64)))[0]) if kind == -2 else b
        by.setdefault(to, []).append((int(name), [kind, *x]))
    for to, own in by.items():
        _put(out, to, 0, np.array([x[0] for x in own], np.int64).tobytes(), np.array([x[1] for x in own], np.float64).tobytes())


def _merge_words(folder: str, at: Layout):
    def run(t: pa.Table) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("kind", "v", "a", "b", "c", "d")}

        def tell(kind, v, *x):
            for k, y in zip(out, (int(kind), int(v), *map(float, x))):
                out[k].append(y)

        b = t["b"][0].as_py()
        words, types, often = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        pairs, pair_counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        keys, stats, told = [np.zeros(0, np.uint64)], [np.zeros((0, 4), np.int64)], []
        for level, w, x, c, over in zip(*(t[k].to_pylist() for k in ("level", "words", "x", "c", "over"))):
            if level == 1:
                w, c = _unsqueezed(w, np.uint64, 6), _counts(c, over)
                words.append(w)
                types.append(c[: len(w)])
                often.append(c[len(w) :])
                continue
            w = np.frombuffer(w, np.uint64)
            if level == 0:
                told += zip(w.view(np.int64).tolist(), np.frombuffer(x, np.float64).reshape(-1, 5).tolist())
            elif level == -2:
                keys.append(w)
                stats.append(_counts(c, over).reshape(-1, 4))
            else:
                pairs.append(w)
                pair_counts.append(_counts(c, over))
        for name, (kind, *x) in told:
            tell(kind, name, *x)
        tell(-4, b, 0, 0, 0, 0)
        # contexts of frequent words
        keys, stats = np.concatenate(keys), np.concatenate(stats)
        order = np.argsort(keys)
        begin, _ = runs(keys[order])
        stats = np.add.reduceat(stats[order], begin[:-1]) if len(keys) else stats
        _save_map(folder, f"contexts-{b}", keys[order][begin[:-1]], stats)
        # frequent pairs
        both, c = np.concatenate(pairs).reshape(-1, 2), np.concatenate(pair_counts)
        pair = _sequence([both[:, 0], both[:, 1]])
        one, c = _summed(pair, c)
        both, pair = both[one], pair[one]
        _save_map(folder, f"pairs-{b}", pair, c)
        for v, x in zip(both[:, 0].view(np.int64).tolist(), c.tolist()):
            tell(-2, v, x, x == 1, x == 2, x >= 3)
        tell(2, 0, *(int((c == i).sum()) for i in (1, 2, 3, 4)))
        # words: how many different ones precede each, and how often it occurs
        w = np.concatenate([*words, both[:, 1]])
        types, c = np.concatenate([*types, np.ones(len(both), np.int64)]), np.concatenate([*often, np.zeros(len(both), np.int64)])
        order = np.argsort(w, kind="stable")
        begin, _ = runs(w[order])
        if len(w):
            w, types, c = w[order][begin[:-1]], np.add.reduceat(types[order], begin[:-1]), np.add.reduceat(c[order], begin[:-1])
        _save_map(folder, f"word-{b}", _first(w[np.argsort(_first(w))]), np.stack([c, types], 1)[np.argsort(_first(w))])
        tell(-3, 0, len(w), c.sum(), types.sum(), int((types >= 3).sum()))
        tell(1, 0, *(int((types == i).sum()) for i in (1, 2, 3, 4)))
        return out

    return run


def _frequent(count: int):
    """Words, kind 0, and pairs, kind 1, that a share of at least 1 / count of a sampled part's tokens follow or are."""

    def run(parts):
        for part in parts:
            w, place, _ = _tokens(part)
            v = _before(w, place, 1, BEGIN)
            out: dict[str, list] = {"kind": [2], "v": [0], "n": [len(w)]}
            pair = _sequence([v, w])[v != BEGIN]
            for kind, x in ((0, v), (1, pair)):
                x, n = np.unique(x, return_counts=True)
                keep = n * count * 2 >= len(w)
                out["kind"] += [kind] * int(keep.sum())
                out["v"] += x[keep].view(np.int64).tolist()
                out["n"] += n[keep].tolist()
            yield out

    return run


class Model:
    """Where the arrays are, and the few numbers that every score needs."""

    def __init__(self, folder: str, at: Layout, order: int, facts: list):
        self.folder, self.at, self.order = folder, at, order
        total: dict[int, np.ndarray] = {}
        hot, self.first, self.second = {}, set(), set()
        for r in facts:
            x = np.array([r.a, r.b, r.c, r.d])
            if r.kind == -2:
                hot[int(np.int64(r.v).view(np.uint64))] = x
            elif r.kind in (-1, -4):
                (self.first if r.kind == -1 else self.second).add(r.v)
            else:
                total[r.kind] = total.get(r.kind, np.zeros(4)) + x
        none = np.zeros(4)
        self.v, self.n, self.types = (int(x) for x in total.get(-3, none)[:3])
        self.discount = {k: _discounts(total.get(k, none)) for k in range(1, order + 1)}
        d, types = self.discount[1], total.get(1, none)
        self.left = float(d[1] * types[0] + d[2] * types[1] + d[3] * total.get(-3, none)[3])
        self.hot_v = np.array(sorted(hot), np.uint64)
        self.hot_n = np.array([hot[v] for v in sorted(hot)], np.float64).reshape(-1, 4)

    def drop(self, spark) -> None:
        """Deletes the arrays; all scores must have been written."""
        at = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from the numbers of counts 1 to 4; where these do not determine one, half a count."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = [0.0, 1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.5, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return np.array([0.0] + [x if 0 < x < k else 0.5 for k, x in enumerate(raw[1:], 1)])


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Counts the texts of ``docs``."""
    if order < 2:
        raise ValueError("an n-gram has two words at least")
    spark = docs.sparkSession
    texts = docs.select("text")
    count = buckets(spark, text_bytes(texts) / 7, 1.5e6)
    rows = packed(texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0), _frequent(count), "kind int, v bigint, n bigint")
    rows = rows.groupBy("kind", "v").agg(F.sum("n").alias("n"))
    total = rows.where("kind = 2").select("n").first()
    found = rows.where((F.col("kind") < 2) & (F.col("n") * count >= (total.n if total else 0))).collect()  # at most 2 * count
    chosen = lambda kind, *more: np.array(sorted({*more, *(int(np.int64(r.v).view(np.uint64)) for r in found if r.kind == kind)}), np.uint64)
    at = Layout(count, chosen(0, int(BEGIN)), chosen(1))
    folder = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    words = grouped(packed(texts, _count(at, order), SENT), "b", _merge(folder, at, order), SENT)
    facts = grouped(words, "b", _merge_words(folder, at), FACTS).groupBy("kind", "v").agg(*(F.sum(k).alias(k) for k in "abcd")).collect()
    return Model(folder, at, order, facts)


# ---------------------------------------------------------------- scoring


def _each_bucket(bucket: np.ndarray, count: int):
    order, at = by_bucket(bucket.astype(np.int64), count)
    for b in np.flatnonzero(np.diff(at)):
        yield int(b), order[at[b] : at[b + 1]]


def _gather(m: Model, bucket: np.ndarray, there: set, name: str, keys: np.ndarray, width: int = 1) -> np.ndarray:
    """Counts of keys from the arrays of their buckets; a bucket that got nothing has none."""
    out = np.zeros((len(keys), width), np.int64)
    for b, own in _each_bucket(bucket, m.at.count):
        if b in there:
            out[own] = _look(m.folder, f"{name}-{b}", keys[own], width)
    return out


def _look_up(m: Model, w: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token its count in training and its probability after the words before it."""
    words, ids = np.unique(w, return_inverse=True)
    ids = ids.astype(np.uint32)
    facts = _gather(m, m.at.word_bucket(words), m.second, "word", _first(words), 2)
    types, d = facts[:, 1], m.discount[1]
    if m.types:
        low = (types - d[np.minimum(types, 3)]) / m.types + m.left / m.types / (m.v + 1)
    else:
        low = np.full(len(words), 1.0 / (m.v + 1))
    p, found, words = low[ids], (types > 0)[ids], np.append(words, BEGIN)
    for k in range(2, m.order + 1):
        who = np.flatnonzero(place >= k - 2)
        columns = [_before(ids, place, i, len(words) - 1)[who] for i in range(k - 1, 0, -1)] + [ids[who]]
        for piece in _pieces(_bucket_of(m.at, words, columns), m.at.count):
            at = who[piece]
            p[at], found[at] = _longer_by_one(m, [words[x[piece]] for x in columns], p[at], found[at])
    return facts[ids, 0], p


def _longer_by_one(m: Model, own: list[np.ndarray], p: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities with one more word before, from those without it; and whether the longer n-grams were found."""
    k = len(own)
    context = _sequence(own[:-1])
    keys, one, of = np.unique(context, return_index=True, return_inverse=True)
    v = own[-2][one]
    stats, hot = np.zeros((len(keys), 4)), np.isin(v, m.at.hot)
    cool = np.flatnonzero(~hot)
    stats[cool] = _gather(m, (mix(v[cool]) >> U(8)) % U(m.at.count), m.first, f"context-{k}", keys[cool], 4)
    warm = np.flatnonzero(hot)
    if k == 2 and len(m.hot_v):
        place_of = np.minimum(np.searchsorted(m.hot_v, v[warm]), len(m.hot_v) - 1)
        known = m.hot_v[place_of] == v[warm]
        stats[warm[known]] = m.hot_n[place_of[known]]
    elif k > 2:
        stats[warm] = _gather(m, m.at.context_bucket(keys[warm]), m.second, "contexts", keys[warm], 4)
    total, d = stats[:, 0], m.discount[k]
    back = np.where(total > 0, (stats[:, 1:] @ d[1:]) / np.maximum(total, 1), 1.0)
    c = np.zeros(len(p), np.int64)
    ask = np.flatnonzero((total[of] > 0) & found)
    grams, one, gram_of = np.unique(_longer(context[ask], own[-1][ask]), return_index=True, return_inverse=True)
    some = [x[ask][one] for x in own]
    made = np.zeros(len(grams), np.int64)
    often = m.at.frequent(*some[-2:]) if k == 2 else np.zeros(len(grams), bool)
    usual, rare = np.flatnonzero(~often), np.flatnonzero(often)
    made[usual] = _gather(m, m.at.bucket([x[usual] for x in some]), m.first, f"gram-{k}", grams[usual])[:, 0]
    made[rare] = _gather(m, m.at.word_bucket(some[-1][rare]), m.second, "pairs", grams[rare])[:, 0]
    c[ask] = made[gram_of]
    return (c - d[np.minimum(c, 3)]) / np.maximum(total[of], 1) * (total[of] > 0) + back[of] * p, c > 0


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"


def score(docs: DataFrame, m: Model) -> DataFrame:
    """One row per document; ``docs`` has doc_id, text and held_out."""
    sent = docs.sparkSession.sparkContext.broadcast(m)

    def flush(kept):
        m = sent.value
        *tokens, rows, doc_id, held_out = zip(*kept)
        kept.clear()
        rows = sum(rows)
        w, place, row = (np.concatenate(tokens.pop(0)) for _ in range(3))
        c, p = _look_up(m, w, place)
        n = np.bincount(row, minlength=rows)
        s = np.bincount(row, weights=np.log10(p), minlength=rows)
        base = np.bincount(row, weights=np.log10((c + 1) / (m.n + m.v + 1)), minlength=rows)
        return {
            "doc_id": pa.concat_arrays(doc_id),
            "held_out": pa.concat_arrays(held_out),
            "n_tokens": n,
            "n_known": np.bincount(row, weights=c > 0, minlength=rows).astype(np.int64),
            "train_tokens": np.full(rows, m.n, np.int64),
            "base_score": base,
            "score": s,
            "perplexity": 10.0 ** np.minimum(-s / np.maximum(n, 1), 300.0),
        }

    def run(parts):
        kept, size, rows = [], 0, 0
        for part in parts:
            w, place, row = _tokens(part)
            kept.append((w, place, row + rows, part.num_rows, part.column("doc_id").cast(pa.int64()), part.column("held_out")))
            size, rows = size + len(w), rows + part.num_rows
            if size > FLUSH:
                yield flush(kept)
                size, rows = 0, 0
        if kept:
            yield flush(kept)

    return packed(docs.select("doc_id", "text", "held_out"), run, SCORES)


def lm_query(docs: DataFrame, order: int = ORDER) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    return score(docs, train(docs.where("not held_out"), order))
