"""Similarity search over a column, with exchangeable algorithms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import similarity as sim

#: name: (score of query and value, distance or None)
ALGORITHMS: dict[str, Callable[[Column, Column], tuple[Column, Column | None]]] = {}


def register(name: str, f: Callable[[Column, Column], tuple[Column, Column | None]]) -> None:
    """Adds an algorithm that search() accepts by name."""
    if not callable(f):
        raise TypeError("an algorithm is a function of two columns")
    ALGORITHMS[name] = f


def _by_distance(distance: Callable[[Column, Column], Column]):
    def made(q: Column, v: Column):
        d = distance(q, v)
        return 1 - d / F.greatest(F.length(q), F.length(v), F.lit(1)), d

    return made


register("levenshtein", _by_distance(F.levenshtein))
register("damerau_levenshtein", _by_distance(sim.damerau))
register("jaro", lambda q, v: (sim.jaro(q, v), None))
register("jaro_winkler", lambda q, v: (sim.jaro_winkler(q, v), None))
register("token_sort", lambda q, v: (sim.token_sort(q, v), None))


@dataclass(frozen=True)
class SearchConfig:
    algorithm: str = "levenshtein"
    threshold: float = 0.0
    max_distance: int = 3
    limit: int = 10
    case_sensitive: bool = False

    def __post_init__(self):
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algorithm}")
        if not 0 <= self.threshold <= 1 or self.max_distance < 0 or self.limit < 1:
            raise ValueError("threshold lies in 0..1, max_distance is not negative, limit is positive")


def config_from(values: dict) -> SearchConfig:
    """From strings or typed values, as files and environments give them."""
    kinds = {"algorithm": str, "threshold": float, "max_distance": int, "limit": int, "case_sensitive": lambda x: str(x).lower() in ("1", "true", "yes")}
    return SearchConfig(**{k: kinds[k](v) for k, v in values.items() if k in kinds})


def config_of_file(path: str) -> SearchConfig:
    """From a JSON or YAML file; a section ``search`` is looked into."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        values = yaml.safe_load(text)
    else:
        import json

        values = json.loads(text)
    return config_from(values.get("search", values))


def config_of_environment(environ: dict, prefix: str = "SEARCH_") -> SearchConfig:
    return config_from({k[len(prefix) :].lower(): v for k, v in environ.items() if k.startswith(prefix)})


#: The most edits of the index-like way of searching.
INDEX_EDITS = 2
#: Algorithms whose score is one minus distance over the longer length, so that lengths bound it.
BOUNDED = ("levenshtein", "damerau_levenshtein")


def search(df: DataFrame, query: str, field: str, id_field: str, config: SearchConfig = SearchConfig(), metadata: list[str] | None = None) -> DataFrame:
    """``id, value, similarity_score`` and, for the columns asked for, ``metadata``: the best by score, ties by id.

    Values whose length alone rules them out are dropped first, and those beyond the distance by a
    native bounded comparison where there is one, so functions in Python meet few rows.
    """
    fold = (lambda c: c) if config.case_sensitive else F.lower
    q, v = fold(F.lit(query)), fold(F.col(field))
    score, distance = ALGORITHMS[config.algorithm](q, v)
    found = df.where(F.col(field).isNotNull())
    if config.algorithm in BOUNDED:
        found = found.where(F.abs(F.length(v) - len(query)) <= config.max_distance)
        # an exchange of neighbours is two plain edits at most
        found = found.where(F.levenshtein(q, v, config.max_distance * (1 if config.algorithm == "levenshtein" else 2)) >= 0)
    more = [F.create_map(*[x for c in metadata for x in (F.lit(c), F.col(c).cast("string"))]).alias("metadata")] if metadata else []
    made = found.select(F.col(id_field).alias("id"), F.col(field).alias("value"), (distance if distance is not None else F.lit(0)).alias("d"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("s"), *more)
    made = made.where((F.col("d") <= config.max_distance) & (F.col("s") >= config.threshold))
    return made.select("id", "value", F.round("s", 4).alias("similarity_score"), *(["metadata"] if metadata else [])).orderBy(F.col("similarity_score").desc(), "id").limit(config.limit)


def relative(found: DataFrame) -> DataFrame:
    """Adds ``score``: the similarity over the best one of the hits, which a limit bounds."""
    best = found.agg(F.max("similarity_score").alias("best"))
    return found.crossJoin(F.broadcast(best)).withColumn("score", F.round(F.col("similarity_score") / F.col("best"), 4)).drop("best")  # one row


def index_like(config: SearchConfig) -> SearchConfig:
    """The same search with the few edits that an index of terms allows."""
    from dataclasses import replace

    return replace(config, max_distance=min(config.max_distance, INDEX_EDITS))


def timed(df: DataFrame, query: str, field: str, id_field: str, names: list[str] | None = None) -> dict[str, tuple[float, int]]:
    """Seconds and hits of each algorithm on one query."""
    import time

    out = {}
    for name in names or list(ALGORITHMS):
        began = time.perf_counter()
        n = search(df, query, field, id_field, SearchConfig(algorithm=name)).count()
        out[name] = (time.perf_counter() - began, n)
    return out


def recommended(needs: dict) -> str:
    """Which way of searching suits stated needs: a plain scan, an index of terms for live queries, or a table in key order for large data."""
    if needs.get("algorithm") in ("jaro", "jaro_winkler"):
        return "scan"
    existing = needs.get("existing_infrastructure", [])
    existing = [existing] if isinstance(existing, str) else existing
    size = needs.get("dataset_size", "medium")
    if needs.get("realtime"):
        return "key_value" if "key_value" in existing and "term_index" not in existing else "term_index"
    if size == "large":
        return "term_index" if "term_index" in existing and "relational" not in existing else "relational"
    return "scan"
