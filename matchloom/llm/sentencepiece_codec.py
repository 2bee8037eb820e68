"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds all pieces of the model, as bytes.  Texts are read once, byte by
byte; after each, the pieces that end there (the state and its output links) relax
the best score of the position behind them.  Bytes that no piece covers become
byte pieces.

Scores: a model of word pieces carries log probabilities, which are used as they
are.  A model of merges carries ranks only, no probabilities; its pieces get the
log probability of their rank under Zipf's law, -log(rank + 2), less PIECE for
each piece, so that fewer pieces are preferred as merging does.  The segmentation
is the best one under these scores, not the one that merging would give.  Byte
pieces cost more than any other.

A piece's U+2581 stands for a space.  A text begins with one more space unless told
otherwise, which decoding takes away again.  The character U+2581 itself is encoded
as bytes, so every text comes back exactly.

No piece goes on from another character to a space (checked when the model is
loaded), so a text falls apart before each run of spaces.  The different parts of
a megabyte of text are encoded together: position by position for all short
parts at once, in numpy, and one after another for those over SHORT bytes.

Memory: the automaton is a few flat arrays of some megabytes, a chunk of CHUNK
parts another 15 MB; nothing is kept from one megabyte to the next and nothing is
shuffled.

Defined results: a null text has null pieces; an empty one has none; texts of
any length are encoded whole; equal rows get equal results; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import U, flat, lean, mix, packed, powers

MARK, SPACE = "▁", 32
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Longest part that is encoded beside others, parts encoded at once, and ids decoded at once.
SHORT, CHUNK, IDS = 64, 16_384, 250_000
#: What each piece of a model of merges costs beside its rank.
PIECE = 10.0


class Codec:
    """Encoder and decoder of one SentencePiece model."""

    def __init__(self, model: bytes, prefix: bool = True):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = m.vocab_size()
        scores = [m.get_score(i) for i in range(n)]
        self.prefix = prefix
        self.byte = np.zeros(256, np.int32)
        normal: dict[bytes, tuple[int, float]] = {}
        ranks = all(s == int(s) for s in scores)
        raw = [b""] * n
        for i, s in enumerate(scores):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                raw[i] = p.replace(MARK, " ").encode()
                normal[raw[i]] = (i, -math.log(2 - s) - PIECE if ranks else s)
        for b, i in enumerate(self.byte.tolist()):
            raw[i] = bytes([b])
        self.low = min(s for _, s in normal.values()) - 1
        self.cut = not any(b" " in p.lstrip(b" ") for p in normal)
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate(([0], np.cumsum([len(p) for p in raw])))
        self._build(normal)

    def _build(self, pieces: dict[bytes, tuple[int, float]]) -> None:
        """Transitions as sorted keys (state * 256 + byte), failure links, and for each state the nearest one, itself first, where a piece ends."""
        goto: dict[int, int] = {}
        length, score, piece = [0], [0.0], [-1]
        for p, (i, s) in pieces.items():
            state = 0
            for b in p:
                to = goto.setdefault(state * 256 + b, len(length))
                if to == len(length):
                    length.append(0)
                    score.append(0.0)
                    piece.append(-1)
                state = to
            length[state], score[state], piece[state] = len(p), s, i
        keys = np.array(sorted(goto), np.int64)
        to = np.array([goto[k] for k in keys.tolist()], np.int32)
        fail, ends, link = [0] * len(length), [0] * len(length), [0] * len(length)
        level = [0]
        children: dict[int, list[tuple[int, int]]] = {}
        for k, t in zip(keys.tolist(), to.tolist()):
            children.setdefault(k >> 8, []).append((k & 255, t))
        while level:
            after = []
            for state in level:
                for b, t in children.get(state, ()):
                    f = fail[state]
                    while f and f * 256 + b not in goto:
                        f = fail[f]
                    f = goto.get(f * 256 + b, 0)
                    fail[t] = f if f != t else 0
                    link[t] = ends[fail[t]]
                    ends[t] = t if piece[t] >= 0 else link[t]
                    after.append(t)
            level = after
        self.keys, self.to = keys, to
        self.fail, self.ends, self.link = (np.array(x, np.int32) for x in (fail, ends, link))
        self.length, self.score, self.piece = np.array(length, np.int32), np.array(score), np.array(piece, np.int32)
        root = np.zeros(256, np.int32)
        root[(keys[keys < 256]).astype(int)] = to[keys < 256]
        self.root = root

    # ------------------------------------------------------------ one part

    @functools.cached_property
    def _lists(self):
        """The automaton for reading byte by byte."""
        return dict(zip(self.keys.tolist(), self.to.tolist())), *(x.tolist() for x in (self.fail, self.ends, self.link, self.length, self.score, self.piece, self.byte))

    def best(self, text: bytes) -> list[int]:
        """Viterbi over one part."""
        goto, fail, ends, link, length, scores, piece, byte = self._lists
        n, low = len(text), self.low
        score, back = [0.0] * (n + 1), [0] * (n + 1)
        state = 0
        for at, b in enumerate(text, 1):
            while state and state * 256 + b not in goto:
                state = fail[state]
            state = goto.get(state * 256 + b, 0)
            top, how, e = score[at - 1] + low, 0, ends[state]
            while e:
                x = score[at - length[e]] + scores[e]
                if x > top or (x == top and not how):
                    top, how = x, e
                e = link[e]
            score[at], back[at] = top, how
        out: list[int] = []
        while n:
            e = back[n]
            out.append(piece[e] if e else byte[text[n - 1]])
            n -= length[e] if e else 1
        return out[::-1]

    # ------------------------------------------------------------ many parts

    def _next(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one more byte each."""
        out = np.zeros(len(state), np.int32)
        todo, cur = np.arange(len(state)), state.astype(np.int64)
        while len(todo):
            key = cur * 256 + byte[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[todo[hit]] = self.to[at[hit]]
            miss = ~hit & (cur != 0)
            todo, cur = todo[miss], self.fail[cur[miss]].astype(np.int64)
            top = cur == 0
            if top.any():
                out[todo[top]] = self.root[byte[todo[top]]]
                todo, cur = todo[~top], cur[~top]
        return out

    def _together(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of short parts, sorted by falling size, one after another, and how many each has."""
        n, most = len(start), int(size.max(initial=0))
        score, back = np.zeros((n, most + 1)), np.zeros((n, most + 1), np.int32)
        state = np.zeros(n, np.int32)
        active = n
        for at in range(1, most + 1):
            while active and size[active - 1] < at:
                active -= 1
            state = self._next(state[:active], data[start[:active] + at - 1])
            top, how = score[:active, at - 1] + self.low, np.zeros(active, np.int32)
            e = self.ends[state]
            who = np.flatnonzero(e)
            e = e[who]
            while len(who):
                x = score[who, at - self.length[e]] + self.score[e]
                better = (x > top[who]) | ((x == top[who]) & (how[who] == 0))
                top[who[better]], how[who[better]] = x[better], e[better]
                e = self.link[e]
                who, e = who[e != 0], e[e != 0]
            score[:active, at], back[:active, at] = top, how
        made, count, left = np.zeros((n, most), np.int32), np.zeros(n, np.int64), size.copy()
        who = np.flatnonzero(left)
        while len(who):
            count[who] += 1
            e = back[who, left[who]]
            made[who, most - count[who]] = np.where(e > 0, self.piece[e], self.byte[data[start[who] + left[who] - 1]])
            left[who] -= np.where(e > 0, self.length[e], 1)
            who = who[left[who] > 0]
        return made[np.arange(most) >= most - count[:, None]], count

    def _parts(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, one after another, and how many each has; equal parts are encoded once."""
        up, down = powers(len(data) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + U(1)) * up[: len(data)], dtype=np.uint64)))
        h = mix((total[start + size] - total[start]) * down[start] ^ (size.astype(np.uint64) << U(48)))
        _, first, same = np.unique(h, return_index=True, return_inverse=True)
        at = np.repeat(start[first][same] - start, size) + _within(start, size)
        if (size[first][same] != size).any() or (data[at] != data[_within(start, size)]).any():  # two parts with one hash
            first = same = np.arange(len(start))
        order = np.argsort(-size[first], kind="stable")
        own, n = first[order], size[first[order]]
        ids, count = [], []
        long = int((n > SHORT).sum())
        for i in own[:long]:
            ids.append(np.array(self.best(data[start[i] : start[i] + size[i]].tobytes()), np.int32))
            count.append([len(ids[-1])])
        for a in range(long, len(own), CHUNK):
            made = self._together(data, start[own[a : a + CHUNK]], n[a : a + CHUNK])
            ids.append(made[0])
            count.append(made[1])
        ids, count = np.concatenate(ids), np.concatenate(count).astype(np.int64)
        place = np.empty(len(own), np.int64)
        place[order] = np.arange(len(own))
        begin, which = np.cumsum(count) - count, place[same]
        return ids[_within(begin[which], count[which])], count[which]

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        rows = len(offsets) - 1
        data, offsets = self._begun(data, offsets)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        begin = np.zeros(len(data), bool)
        if self.cut:
            begin[1:] = (data[1:] == SPACE) & (data[:-1] != SPACE)
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(begin)
        ids, count = self._parts(data, start, np.diff(np.append(start, len(data))))
        row = np.searchsorted(offsets, start, "right") - 1
        return ids, np.bincount(row, weights=count, minlength=rows).astype(np.int64)

    def _begun(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts that are not empty with a space before them."""
        if not self.prefix:
            return data, offsets
        some = (np.diff(offsets) > 0).astype(np.int64)
        return np.insert(data, offsets[:-1][some > 0], SPACE), offsets + np.concatenate(([0], np.cumsum(some)))

    def decode_all(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts of rows of ids, as bytes and offsets."""
        begin, size = self.raw_at[ids], np.diff(self.raw_at)[ids]
        data = self.raw[_within(begin, size)]
        total = np.concatenate(([0], np.cumsum(size)))
        offsets = total[np.concatenate(([0], np.cumsum(count)))]
        if self.prefix:
            first = offsets[:-1][np.diff(offsets) > 0]
            gone = first[data[first] == SPACE]
            keep = np.ones(len(data), bool)
            keep[gone] = False
            offsets = offsets - np.searchsorted(gone, offsets)
            data = data[keep]
        return data, offsets

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        return self.encode_all(raw, np.array([0, len(raw)]))[0]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all(np.asarray(ids, np.int64), np.array([len(ids)]))[0].tobytes().decode("utf-8", "surrogatepass")


def _within(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of ranges, one range after another."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(begin - (end - size), size)


@functools.lru_cache(maxsize=2)
def codec(path: str, prefix: bool = True) -> Codec:
    """The codec of a model file that all machines have; made once in a worker."""
    with open(path, "rb") as f:
        return Codec(f.read(), prefix)


ENCODED = "doc_id bigint, n_pieces bigint, pieces array<int>, decoded_equal boolean"


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, n_pieces, pieces, decoded_equal`` for each document."""

    def run(parts):
        c = codec(model)
        for part in parts:
            data, offsets = flat(part.column("text"))
            ids, count = c.encode_all(data, offsets)
            back, at = c.decode_all(ids, count)
            null = part.column("text").is_null().to_numpy(zero_copy_only=False)
            if np.array_equal(at, offsets):
                wrong = np.concatenate(([0], np.cumsum(back != data)))
                same = np.diff(wrong[offsets]) == 0
            else:
                same = np.array([np.array_equal(back[a:b], data[x:y]) for a, b, x, y in zip(at[:-1], at[1:], offsets[:-1], offsets[1:])], bool)
            ends = np.concatenate(([0], np.cumsum(count)))
            pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids), mask=pa.array(null))
            yield {"doc_id": part.column("doc_id").cast(pa.int64()), "n_pieces": pa.array(count, mask=null), "pieces": pieces, "decoded_equal": pa.array(same, mask=null)}

    return packed(docs.select("doc_id", "text"), run, ENCODED)


def decoded(pieces: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, text`` from ``doc_id, pieces``."""

    def run(batches):
        c = codec(model)
        for batch in batches:
            for part in _by_ids(batch):
                lists = part.column(1)
                null = lists.is_null().to_numpy(zero_copy_only=False)
                count = np.where(null, 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                data, offsets = c.decode_all(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), count)
                raw = data.tobytes()
                texts = [None if x else raw[a:b].decode("utf-8", "surrogatepass") for x, a, b in zip(null, offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return lean(pieces.select("doc_id", "pieces")).mapInArrow(run, "doc_id bigint, text string")


def _by_ids(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about IDS ids each."""
    total, at = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), 0
    while at < len(total):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + IDS, "right")))
        yield batch.slice(at, to - at)
        at = to
