"""Language identification by fusing evidence in log odds.

Evidence of a document, or a page:

* text: hashed character trigrams of the whole text under one multinomial model
  per language, trained from about TRAIN different declared texts of each language, read whole, twice as
  many at most on average, chosen by hash - the only bounded sample here; each
  text counts as much as its length, up to TRAIN_BYTES, so that no long one decides alone;
* declared markup language (``<html lang>``, or the lang column), believed as far
  as the text model agrees with such declarations over the whole corpus; only its
  primary subtag counts, and one that is none of the LANGUAGES most declared ones
  is evidence for those, but never a verdict itself;
* address suffix (top-level domain, and the first path segment where it is
  a language code), counted the same way;
* host prior, smoothed hierarchically: host, its registered domain, the corpus.

Corpus counts come from grouped aggregations with map-side combining over all
rows: first the text's verdict for each row, then counts by declaration, suffix,
domain and host.  A host that holds a third of all rows is one row after that.
Joining counts back is left to adaptive execution, which splits hot hosts and
broadcasts only what it has measured; rows without a host or suffix are dealt out by a
hash of their id.  Of the text model one row a language reaches the driver, of at most
BINS counts, for at most LANGUAGES languages.

Text evidence is tempered: a likelihood is an average per trigram times at most
EVIDENCE trigrams, since neighbouring trigrams are not independent.

Defined results: a null or empty text gives no text evidence, so declaration,
suffix and host decide; with no evidence at all the corpus prior decides; equal
rows get equal results; of equally likely languages the first in code-point order is the
verdict; texts of any length are read whole, a null id is kept; an empty table gives an empty result; columns of the
input that are not named here are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import flat, grouped, packed, written

#: Texts of each language that the text model is trained from, and the bytes that one of them counts for at most.
TRAIN, TRAIN_BYTES = 400, 20_000
BINS = 1 << 15
#: Most languages of the text model, those with most declared texts; others only count as declarations.
LANGUAGES = 200
#: Most trigrams whose evidence counts, pseudo-counts of the host hierarchy and of declarations.
EVIDENCE, HOST, DECLARED = 60.0, 20.0, 5.0
#: A document whose best language has less than this, or none of the wanted ones, is rejected.
CONFIDENT = 0.5

INPUT = "kind string, id bigint, text string, declared string, suffix string, host string, domain string"


def _bins(data: np.ndarray) -> np.ndarray:
    """The bin of the trigram that ends at each byte from the third on; digits and punctuation are one symbol."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    low = np.where((low >= 97) | (low >= 128), low, 32).astype(np.uint32)
    x = (low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA6B)) ^ (low[2:] * np.uint32(0xC2B2AE35))
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return x >> np.uint32(32 - 15)


def _primary(column: str):
    """The primary subtag of a declared language: en of en-us and en_gb."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(F.col(column))), "^[^-_]*", 0), F.lit(""))


def trained(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """The LANGUAGES most declared languages, and log likelihoods [bin, language], from ``(declared, text)``."""
    rank = F.xxhash64("text")
    sample = texts.withColumn("declared", _primary("declared")).where("declared is not null and text is not null").withColumn("r", rank)
    share = sample.groupBy("declared").count().orderBy(F.col("count").desc(), "declared").limit(LANGUAGES).collect()
    many = {r["declared"]: r["count"] for r in share}
    languages = sorted(many)
    if not languages:
        return ["und"], np.full((BINS, 1), -np.log(BINS))
    bound = F.create_map(*[F.lit(x) for k, n in many.items() for x in (k, min(1.0, 2.0 * TRAIN / n))])
    unit = (F.pmod(F.col("r"), F.lit(1 << 30)) / float(1 << 30)) < F.try_element_at(bound, F.col("declared"))
    names = {x: i for i, x in enumerate(languages)}

    def count(parts):
        for part in parts:
            data, offsets = flat(part.column("text"))
            out: dict[str, list] = {"lang": [], "bin": [], "n": []}
            for i, x in enumerate(part.column("declared").to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                if len(own) > 2:
                    bins, n = np.unique(_bins(own), return_counts=True)
                    out["lang"] += [names[x]] * len(bins)
                    out["bin"] += bins.tolist()
                    out["n"] += (n * min(1.0, TRAIN_BYTES / len(own))).tolist()
            yield out

    def dense(t):
        n = np.zeros(BINS)
        np.add.at(n, t["bin"].to_numpy(), t["n"].to_numpy())
        return {"lang": t["lang"][:1], "counts": [np.round(n, 6).tobytes()]}

    total = np.zeros((len(languages), BINS))
    # copies of a text count once, under each declaration
    rows = packed(sample.where(unit).dropDuplicates(["r", "declared"]).select("declared", "text"), count, "lang int, bin int, n double")
    rows = rows.groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    for r in grouped(rows, "lang", dense, "lang int, counts binary").toLocalIterator():
        total[r["lang"]] = np.frombuffer(r["counts"])
    p = (total + 0.2) / (total + 0.2).sum(1, keepdims=True)
    return languages, np.log(p).T.copy()


def _text_evidence(inputs: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """Adds ``evidence``: tempered log likelihoods of the whole text."""
    sent = inputs.sparkSession.sparkContext.broadcast(model.astype(np.float32))
    n = len(languages)

    def run(parts):
        model = sent.value
        for part in parts:
            data, offsets = flat(part.column("text"))
            size = np.maximum(np.diff(offsets) - 2, 0)
            total = np.zeros((part.num_rows, n))
            if len(data) > 2:
                bins = _bins(data)
                at = np.flatnonzero(size > 0)
                # sums between the first trigram of a text and its last one
                edges = np.stack([offsets[:-1][at], offsets[1:][at] - 2], 1).ravel()
                for k in range(n):
                    own = np.append(model[:, k][bins], np.float32(0)).astype(np.float64)
                    total[at, k] = np.add.reduceat(own, np.minimum(edges, len(own) - 1))[::2]
            e = total / np.maximum(size, 1)[:, None] * np.minimum(size, EVIDENCE)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * n, pa.int32()), pa.array(e.ravel()))
            yield {k: part.column(k) for k in ("kind", "id", "declared", "suffix", "host", "domain")} | {"evidence": lists}

    return packed(inputs, run, "kind string, id bigint, declared string, suffix string, host string, domain string, evidence array<double>")


def _softmax(x):
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _summed(df: DataFrame, key: str, n: int) -> DataFrame:
    """For each key the summed posteriors, one for each language."""
    sums = [F.sum(F.col("posterior")[k]) for k in range(n)]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*sums).alias(f"{key}_n"))


def identified(inputs: DataFrame) -> DataFrame:
    """``kind, id, language, confidence, text_language, declared, suffix, host`` for rows of INPUT."""
    languages, model = trained(inputs.select("declared", "text"))
    n = len(languages)
    scored = written(_text_evidence(inputs, languages, model), "evidence").withColumn("posterior", _softmax(F.col("evidence"))).withColumn("tag", _primary("declared"))
    total = scored.agg(F.count("*"), *[F.sum(F.col("posterior")[k]) for k in range(n)]).first()
    prior = [((x or 0.0) + 1.0) / ((total[0] or 0) + n) for x in total[1:]]
    base = F.array(*[F.lit(float(p)) for p in prior])
    zeros = F.array(*[F.lit(0.0)] * n)

    def smoothed(counts, below, weight):
        """Counts shrunk towards the level below."""
        size = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(counts, below, lambda c, p: (c + p * weight) / (size + weight))

    out = scored
    for key in ("tag", "suffix", "domain", "host"):
        # a null has no counts, and nulls must not meet in one task
        named = F.coalesce(F.concat(F.lit("="), F.col(key)), F.concat(F.lit("-"), F.pmod(F.xxhash64("id"), F.lit(1 << 16)).cast("string")))
        counts = _summed(scored, key, n).select(F.concat(F.lit("="), F.col(key)).alias("name"), f"{key}_n")
        out = out.withColumn("name", named).join(counts, "name", "left").drop("name").withColumn(f"{key}_n", F.coalesce(F.col(f"{key}_n"), zeros))
    by_domain = smoothed(F.col("domain_n"), base, HOST)
    by_host = smoothed(F.col("host_n"), by_domain, HOST)
    ratio = lambda key: F.zip_with(smoothed(F.col(f"{key}_n"), base, DECLARED), base, lambda p, q: F.log(p / q))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = plus(plus(F.col("evidence"), F.transform(by_host, lambda p: F.log(p))), plus(ratio("tag"), ratio("suffix")))
    names = F.array(*[F.lit(x) for x in languages])
    out = out.withColumn("fused", _softmax(fused))
    first = lambda x: F.element_at(names, F.array_position(x, F.array_max(x)).cast("int"))
    return out.select("kind", "id", first(F.col("fused")).alias("language"), F.array_max("fused").alias("confidence"), first(F.col("posterior")).alias("text_language"), "declared", "suffix", "host")


# ---------------------------------------------------------------- inputs

_TAGS = r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>|&[a-z#0-9]{1,8};"


def _address(url):
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    suffix = F.regexp_extract(host, r"\.([a-z]{2,})$", 1)
    path = F.lower(F.regexp_extract(url, r"(?i)://[^/?#]+/([a-z]{2})(?:[/?#-]|$)", 1))
    return host, F.when((suffix != "") | (path != ""), F.concat_ws("/", F.nullif(suffix, F.lit("")), F.nullif(path, F.lit("")))), F.when(host.isNotNull(), F.regexp_extract(host, r"([^.]+\.[^.]+)$|^([^.]+)$", 0))


def from_pages(pages: DataFrame) -> DataFrame:
    """Markup, address and host evidence of pages (page_id, url, html)."""
    host, suffix, domain = _address(F.col("url"))
    declared = F.lower(F.regexp_extract("html", r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,3})""", 1))
    text = F.trim(F.regexp_replace("html", _TAGS, " "))
    return pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("bigint").alias("id"), text.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), F.nullif(suffix, F.lit("")).alias("suffix"), host.alias("host"), F.nullif(domain, F.lit("")).alias("domain"))


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents declare a language in ``lang``; their source takes a host's place."""
    none = F.lit(None).cast("string")
    lang, source = (F.col(c).cast("string") if c in docs.columns else none for c in ("lang", "source"))
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("bigint").alias("id"), F.col("text"), F.nullif(F.lower(F.trim(lang)), F.lit("")).alias("declared"), none.alias("suffix"), source.alias("host"), F.regexp_replace(source, r"\d+$", "").alias("domain"))


def language_query(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """All documents and all pages, identified together: one row for each, with doc_id or page_id."""
    found = identified(from_documents(docs).unionAll(from_pages(pages)))
    own = lambda kind: F.when(F.col("kind") == kind, F.col("id"))
    return found.select(own("document").alias("doc_id"), own("page").alias("page_id"), "language", "confidence", "text_language", "declared", "suffix", "host", (F.col("confidence") >= CONFIDENT).alias("accepted"))


def accepted(docs: DataFrame) -> DataFrame:
    """Documents whose language is known with confidence, with all their columns, ``lang`` set to what was found; others go.

    A document without a letter in its text, or whose best language stays below
    CONFIDENT, is rejected.  Rows with one doc_id are told apart by their text.
    """
    row, own = F.struct(*[F.col(c) for c in docs.columns]).alias("row"), [F.col(c) for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    named = docs.select(row, F.xxhash64(*own).alias("key"))
    inputs = from_documents(docs.withColumn("doc_id", F.xxhash64(*own)))
    found = identified(inputs).where(F.col("confidence") >= CONFIDENT).groupBy(F.col("id").alias("key")).agg(F.min("language").alias("found"))
    letters = F.coalesce(F.col("row.text"), F.lit("")).rlike(r"\p{L}")
    kept = named.where(letters).join(found, "key")
    return kept.select(*[(F.col("found") if c == "lang" else F.col("row")[c]).alias(c) for c in docs.columns])
