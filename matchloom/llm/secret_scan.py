"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of key-like characters that hold a digit, or are assigned
or quoted; values assigned to a name with a suspicious part; passwords in
addresses; and blocks of private keys.  A name before a value is no part of it.  Each is described by
its length, digits and letter cases, entropy, the likelihood of its character
transitions under the corpus, how much of it words of the corpus cover, the kind of path
its source suggests, and the words before it.  A forest of classification trees,
trained from labelled findings, decides which are secrets.

Statistics of the corpus, counted over all texts by grouped aggregation with map-side
combining: transitions between SYMBOLS, and words, of which the DICTIONARY most frequent ones
(at least OFTEN times, ties by code point) are sent to the workers.  A histogram of counts
first names the count that they reach, so that rarer words never meet in the task that ranks.

Training reads a bounded sample: at most ``TRAIN`` labelled findings (the
smallest by hash).  ``findings_of`` reads them from a table.  Without findings of one's own,
``labelled_findings()`` makes them by rule from words of the corpus: keys of the usual forms in usual
places against commit ids, checksums, identifiers, addresses, placeholders and words.

Scanning is one pass without a shuffle; a worker holds one part of texts, the forest and the statistics.

Defined results: a null or empty text has no findings; texts of any length are
scanned whole; equal rows give equal findings; of overlapping candidates the first, longest one counts; a table
without ``source`` has no paths; a null id is kept; an empty table gives an empty result; extra columns are ignored by the
scan and kept by ``redacted``, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import ALNUM, Words, drop, flat, lean, packed, slices, written

#: The most labelled findings that a forest is trained from.
TRAIN = 6000
TREES, DEPTH, LEAF, TRIED, SEED = 25, 8, 3, 5, 7
NEAR = 48
#: Words of the corpus that the cover is measured by, and how often each occurs at least.
DICTIONARY, OFTEN = 20_000, 5
#: Bytes of text that are counted or scanned at once.
SMALL = 300_000

# Names before a value that suggest a secret, and that suggest none.
SUSPECT = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "key", "auth", "bearer", "credential", "private")
HARMLESS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "hash", "digest", "uuid", "id", "etag", "revision", "version", "example", "integrity")
# Forms of keys that are recognised by their beginning.
KNOWN = re.compile(r"^(?:-----BEGIN|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{16,}|AIza[0-9A-Za-z_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_.-]+)")
# Words for made findings and the dictionary's place where a corpus has too few of its own.
PARTS = ("the", "and", "with", "from", "that", "this", "name", "test", "user", "data", "file", "path", "page", "time", "date", "word", "text", "your", "here", "pass", "change", "sample", "example", "dummy", "placeholder", "value", "string", "number", "order", "report", "service", "request", "house", "water", "light", "music", "paper", "stone", "green", "winter")
CANDIDATE = re.compile(
    r"""(?P<block>-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]{16,16384}?-----END [A-Z ]{0,40}PRIVATE KEY-----)"""
    r"""|://[^\s/@:"']{0,64}:(?P<address>[^\s/@"']{3,256})@"""
    r"""|(?<![A-Za-z0-9_+/.-])(?=[A-Za-z_+/.-]*[0-9])(?P<run>[A-Za-z0-9_+/.-]{16,}={0,2})(?![A-Za-z0-9_+/=.-])"""
    r"""|(?i:(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key)[A-Za-z0-9_-]{0,40}["']?\s{0,3}[:=]\s{0,3}["']?)(?P<named>[^\s"',;]{6,})"""
    r"""|(?:[:=]\s{0,3}["']?|["'])(?P<assigned>[A-Za-z0-9_+/.-]{16,}={0,2})(?![A-Za-z0-9_+/=.:@-])"""
)
FEATURES = ("length", "digits", "upper", "lower", "other", "entropy", "hex", "transition", "cover", "repeat", "assigned", "quoted", "suspect", "harmless", "known", "code_path", "address")

_CLASS = np.full(256, 5)
for _i, _part in enumerate(("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOUBCDFGHJKLMNPQRSTVWXYZ", "0123456789", "_-./+=")):
    _CLASS[[ord(c) for c in _part]] = _i
#: Symbols of transitions: letters in both cases, digits as one, characters of keys, bytes above ASCII, all else.
SYMBOLS = 57
_SYMBOL = np.full(256, 56, np.uint16)
_SYMBOL[65:91], _SYMBOL[97:123], _SYMBOL[48:58], _SYMBOL[128:] = np.arange(26), np.arange(26, 52), 52, 53
_SYMBOL[[ord(c) for c in "_-./+="]] = 54
_SYMBOL[[32, 9, 10, 13]] = 55
_RUN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(frozen=True)
class Corpus:
    """Logarithms of transitions, and frequent words."""

    transitions: np.ndarray = field(default_factory=lambda: np.full((SYMBOLS, SYMBOLS), -math.log(SYMBOLS)))
    words: frozenset = frozenset(PARTS)


def corpus_of(docs: DataFrame) -> Corpus:
    """Statistics of all texts."""

    def pairs(parts):
        total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for part in parts:
            data, offsets = flat(part.column("text"))
            at = _SYMBOL[data]
            code = at[:-1] * np.uint16(SYMBOLS) + at[1:]
            inside = np.ones(len(code), bool)
            cut = offsets[1:-1] - 1
            inside[cut[(cut >= 0) & (cut < len(code))]] = False  # from the end of a text to the next one
            total += np.bincount(code[inside], minlength=len(total))
            own = Words(data, offsets, ALNUM, lower=True)
            size = own.end - own.start
            plain = np.concatenate((np.zeros(1, np.int32), np.cumsum((own.data >= 48) & (own.data <= 57), dtype=np.int32)))
            keep = (size >= 3) & (size <= 24) & (plain[own.end] == plain[own.start])
            _, first, n = np.unique(own.hashes()[keep], return_index=True, return_counts=True)
            raw = own.data.tobytes()
            start, end = own.start[keep][first], own.end[keep][first]
            yield {"cell": [None] * len(n), "word": [raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())], "n": n}
        some = np.flatnonzero(total)
        yield {"cell": some, "word": [None] * len(some), "n": total[some]}

    counted = packed(docs.select("text"), pairs, "cell int, word string, n bigint", limit=SMALL).groupBy("cell", "word").agg(F.sum("n").alias("n"))
    found = written(counted.where(F.col("cell").isNotNull() | (F.col("n") >= OFTEN)), "words")
    words = found.where(F.col("word").isNotNull())
    # Words of each step of counts, 16 to a doubling: only words of the steps that reach the dictionary are ranked.
    step = F.floor(16 * F.log2("n")).cast("int")
    least, above = 0, 0
    for r in sorted(words.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):  # 1,024 rows at most
        least, above = r.step, above + r["count"]
        if above >= DICTIONARY:
            break
    top = words.where(step >= least).select("word", "n", "cell").orderBy(F.col("n").desc(), "word").limit(DICTIONARY)
    rows = found.where(F.col("cell").isNotNull()).select("word", "n", "cell").unionAll(top).collect()  # SYMBOLS squared and DICTIONARY at most
    drop(found)
    count = np.full((SYMBOLS, SYMBOLS), 0.5)
    for r in rows:
        if r.cell is not None:
            count[divmod(r.cell, SYMBOLS)] += r.n
    own = sorted((r for r in rows if r.cell is None), key=lambda r: (-r.n, r.word))
    return Corpus(np.log(count / count.sum(1, keepdims=True)), frozenset(r.word for r in own) if len(own) >= len(PARTS) else frozenset(PARTS))


def features(value: str, before: str, after: str, source: str, corpus: Corpus) -> list[float]:
    """The forest's view of one candidate."""
    n = len(value)
    raw = value.encode("latin-1", "replace")
    kind = _CLASS[np.frombuffer(raw, np.uint8)]
    share = np.bincount(kind, minlength=6) / n
    p = np.bincount(np.frombuffer(raw, np.uint8), minlength=1)
    p = p[p > 0] / n
    low = value.lower()
    covered = sum(len(m[0]) for m in _RUN.finditer(value) if len(m[0]) > 2 and m[0].lower() in corpus.words)
    at = _SYMBOL[np.frombuffer(raw, np.uint8)]
    names = re.findall(r"[A-Za-z_][A-Za-z0-9_-]*", before.lower())[-3:]
    return [
        min(n, 200),
        share[3],
        share[2],
        share[0] + share[1],
        share[4] + share[5],
        float(-(p * np.log2(p)).sum()),
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        float(corpus.transitions[at[:-1], at[1:]].mean()) if n > 1 else 0.0,
        covered / n,
        max(map(low.count, set(low))) / n,
        float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(before.rstrip()[-1:] in "\"'" and after[:1] in "\"'" and after[:1] != ""),
        float(any(x.strip("_-") in SUSPECT or any(s in x for s in SUSPECT[:6]) for x in names)),
        float(any(x.strip("_-") in HARMLESS for x in names)),
        float(bool(KNOWN.match(value))),
        float(bool(re.search(r"\.(?:py|js|ts|go|java|env|ya?ml|json|cfg|ini|tf)$|config|deploy", source or ""))),
        float(after[:1] == "@" and bool(re.search(r"://[^\s/@:]*:$", before))),
    ]


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that might be secrets, in order and without overlap."""
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span(m.lastgroup)
        if m.lastgroup not in ("address", "block"):
            while b > a and text[b - 1] in ".,;:-/":
                b -= 1
        if b - a >= (3 if m.lastgroup == "address" else 6) and (not out or a >= out[-1][1]):
            out.append((a, b))
    return out


def described(text: str, a: int, b: int, source: str, corpus: Corpus) -> list[float]:
    return features(text[a:b], text[max(0, a - NEAR) : a], text[b : b + 4], source, corpus)


# ---------------------------------------------------------------- forest


class Forest:
    """Classification trees on bootstrap samples, each split chosen among a few random features by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            own = rng.integers(0, len(y), len(y))
            nodes: list[tuple] = []
            self._grow(nodes, x[own], y[own], 0, rng)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes)))

    def _grow(self, nodes, x, y, depth, rng) -> int:
        me = len(nodes)
        nodes.append((-1, 0.0, 0, 0, float(y.mean())))
        if depth < DEPTH and len(y) >= 2 * LEAF and 0 < y.mean() < 1:
            top = None
            for f in rng.choice(x.shape[1], TRIED, replace=False):
                order = np.argsort(x[:, f], kind="stable")
                v, ones = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(y))
                left, right = ones[:-1], ones[-1] - ones[:-1]
                impurity = left * (1 - left / n) + right * (1 - right / (len(y) - n))
                ok = (v[1:] > v[:-1]) & (n >= LEAF) & (len(y) - n >= LEAF)
                if ok.any():
                    i = np.flatnonzero(ok)[np.argmin(impurity[ok])]
                    if top is None or impurity[i] < top[0]:
                        top = (impurity[i], f, v[i])
            if top is not None:
                go = x[:, top[1]] <= top[2]
                a = self._grow(nodes, x[go], y[go], depth + 1, rng)
                b = self._grow(nodes, x[~go], y[~go], depth + 1, rng)
                nodes[me] = (top[1], top[2], a, b, float(y.mean()))
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The share of trees' votes for a secret, averaged over their leaves."""
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], left[at], right[at]))
            total += value[at]
        return total / len(self.trees)


def labelled_findings(n: int = 3000, seed: int = 11, vocabulary: frozenset = frozenset(PARTS)) -> list[tuple[str, str, int]]:
    """``(text, source, secret)`` findings by rule, of words of the vocabulary; the candidate is the last one of the text."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(np.array(list(chars))[rng.integers(0, len(chars), k)])
    hexes, upper, lower, digits = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    known = sorted(w for w in vocabulary if w.isascii()) or sorted(PARTS)
    some = lambda k: [known[i] for i in rng.integers(0, len(known), k)]
    words = lambda k, by=("", "", "_", "-"): str(rng.choice(by)).join(w.capitalize() if rng.integers(4) == 0 else w for w in some(k))
    prose = lambda: " ".join(some(int(rng.integers(0, 9))))
    out = []
    inner = lambda: pick(upper + lower + digits + "!#$%&*?", int(rng.integers(3, 8)))
    short = lambda: [inner() + pick(digits, 1) + inner(), pick(lower, int(rng.integers(4, 8))) + pick(digits, int(rng.integers(1, 4))) + pick("!#$%&*?", 1) + pick(lower, 2), words(2, ('',))[:7] + pick(digits, int(rng.integers(1, 4))) + pick("!#$%&*?", 1) + pick(lower, int(rng.integers(0, 3)))][rng.integers(3)]
    for _ in range(n):
        name = str(rng.choice(["token", "secret", "password", "api_key", "apikey", "access_token", "client_secret", "auth_token", "private_key"]))
        harmless = str(rng.choice(HARMLESS))
        value = [pick(hexes, int(rng.choice([32, 40, 48, 64]))), pick(upper + lower + digits, int(rng.integers(20, 50))), "AKIA" + pick(upper + digits, 16), "ghp_" + pick(upper + lower + digits, 36), "sk-" + pick(upper + lower + digits, 32), pick(upper + lower + digits + "+/", 40) + "=", short(), short(), pick(lower, int(rng.integers(18, 40))), pick(upper + lower, int(rng.integers(18, 40)))][rng.integers(10)]
        assign = str(rng.choice([" = ", "=", ": ", ' = "', "='"]))
        if rng.integers(8) == 0:
            text = f"{prose()} {rng.choice(['postgres', 'mysql', 'amqp', 'https', 'redis'])}://{words(1)}:{pick(upper + lower + digits, int(rng.integers(4, 6))) + pick(digits, 1) if rng.integers(2) else short().replace('?', '')}@{words(1)}/db"
        else:
            text = f"{prose()} {str(rng.choice(['', '', 'DB_', 'my-', 'app_'])) + name}{assign}{value}"
        if rng.integers(30) == 0:
            kind = str(rng.choice(["RSA ", "EC ", "", "OPENSSH "]))
            text = f"{prose()} -----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(pick(upper + lower + digits + "+/", 64) for _ in range(int(rng.integers(1, 6)))) + f"\n-----END {kind}PRIVATE KEY-----"
        out.append((text, str(rng.choice(["src", "app.env", "config.yml", "notes.txt"])), 1))
        other = [
            f"{harmless} {pick(hexes, int(rng.choice([32, 40, 64])))}",
            f"{harmless}: {pick(hexes, 40)}",
            f"{pick(hexes, 8)}-{pick(hexes, 4)}-{pick(hexes, 4)}-{pick(hexes, 4)}-{pick(hexes, 12)}",
            f"{name}{assign}{rng.choice(['changeme1', 'your_token_here1', 'xxxxxxxxxxxxxxxx1', 'example-password1', '<password1>', '********1', 'placeholder-value-1'])}",
            f"{words(int(rng.integers(4, 8)))}{pick(digits, 2)}",
            pick(digits, int(rng.integers(16, 24))),
            f"www.{words(3, ('', '-'))}.example.com/{words(2, ('/', '-'))}/{pick(digits, 4)}",
            f"{words(int(rng.integers(3, 7)), ('_', '-', '/', '.'))}{rng.choice(['_', '-', '/', ''])}{pick(digits, 2)}",
            f"{name}{assign}{rng.choice(['required', 'optional', 'changeme', 'undefined', 'string', 'process.env.SECRET', 'os.environ', words(3)])}",
            f'title{assign}{words(int(rng.integers(5, 9)))}',
            f"https://user:{rng.choice(['password', 'passwd', '<password>', 'changeme', '$PASSWORD', 'pass', 'xxxx', '****'])}@{words(1)}/db",
        ][rng.integers(11)]
        out.append((f"{prose()} {other}", str(rng.choice(["src", "README.md", "index.html", "notes.txt", "app.env", "config.yml"])), 0))
    return out


def findings_of(table: DataFrame) -> list[tuple]:
    """Labelled findings from a table (text string, source string, secret int, first int, last int): ``first`` and ``last`` are the span in characters, null for the last candidate of the text; at most TRAIN, the smallest by hash."""
    columns = ("text", "source", "secret", "first", "last")
    own = table.where("text is not null and secret is not null").select(*columns).orderBy(F.xxhash64(*columns), *columns).limit(TRAIN)
    return [(r.text, r.source or "", int(r.secret), r["first"], r["last"]) for r in own.collect()]


def trained(findings: list[tuple], corpus: Corpus) -> Forest:
    """A forest from labelled findings (text, source, secret and perhaps first and last), at most TRAIN of them, chosen by hash."""
    own = sorted(findings, key=lambda f: hashlib.md5(repr(f).encode()).digest())[:TRAIN]
    x, y = [], []
    for text, source, secret, *span in own:
        found = [tuple(span)] if span and None not in span else candidates(text)
        if found:
            a, b = found[-1]
            x.append(described(text, a, b, source, corpus))
            y.append(secret)
    return Forest(np.array(x), np.array(y, float))


@dataclass(frozen=True)
class Detector:
    """What decides: a forest and the corpus it was trained under."""

    forest: Forest
    corpus: Corpus

    def secrets(self, text: str, source: str) -> list[tuple[int, int, float]]:
        spans = candidates(text)
        if not spans:
            return []
        p = self.forest.predict(np.array([described(text, a, b, source, self.corpus) for a, b in spans]))
        return [(a, b, float(s)) for (a, b), s in zip(spans, p)]


def detector(docs: DataFrame, findings: list[tuple] | None = None) -> Detector:
    """A forest trained under the statistics of ``docs``, from made findings where none are given."""
    corpus = corpus_of(docs)
    return Detector(trained(findings or labelled_findings(vocabulary=corpus.words), corpus), corpus)


FOUND = "doc_id bigint, start_char bigint, end_char bigint, value_sha256 string, score double, is_secret boolean"


def _sourced(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.col("source").cast("string").alias("source") if "source" in docs.columns else F.lit(None).cast("string").alias("source"))


def scan_secrets(docs: DataFrame, threshold: float = 0.5, own: Detector | None = None) -> DataFrame:
    """One row per candidate of each document, with the forest's score."""
    sent = docs.sparkSession.sparkContext.broadcast(own or detector(docs))

    def run(parts):
        for part in parts:
            out: dict[str, list] = {k.split()[0]: [] for k in FOUND.split(", ")}
            for doc, text, source in zip(*(part.column(k).to_pylist() for k in ("doc_id", "text", "source"))):
                for a, b, s in sent.value.secrets(text or "", source or ""):
                    for k, v in zip(out, (doc, a, b, hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest(), s, s >= threshold)):
                        out[k].append(v)
            yield out

    return packed(_sourced(docs), run, FOUND, limit=SMALL)


def redacted(docs: DataFrame, threshold: float = 0.5, own: Detector | None = None, mark: str = "<SECRET>") -> DataFrame:
    """The same rows and columns, secrets in the text replaced by ``mark``; no row is dropped."""
    sent = docs.sparkSession.sparkContext.broadcast(own or detector(docs))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, at = to_arrow_schema(docs.schema), docs.columns.index("text")
    source_at = docs.columns.index("source") if "source" in docs.columns else -1

    def clean(text, source):
        if not text:
            return text
        out, last = [], 0
        for a, b, s in sent.value.secrets(text, str(source or "")):
            if s >= threshold:
                out += [text[last:a], mark]
                last = b
        return "".join(out) + text[last:] if out else text

    def run(batches):
        for whole in batches:
            for batch in slices(whole, at, SMALL):
                sources = batch.column(source_at).to_pylist() if source_at >= 0 else [None] * batch.num_rows
                texts = pa.array([clean(t, s) for t, s in zip(batch.column(at).to_pylist(), sources)], arrow.field(at).type)
                cols = [texts if i == at else c for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return lean(docs).mapInArrow(run, docs.schema)
