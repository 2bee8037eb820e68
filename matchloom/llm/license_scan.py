"""Fuzzy search for short licence and copyright notices.

A notice may be wrong in up to ``edits`` characters.  Its text is cut into
edits + 1 pieces of about equal length; by the pigeonhole principle one of them
stands unchanged in any place that holds the notice with that many errors.  One
Aho-Corasick automaton over all pieces finds these seeds in a single pass over
the whole text; around each seed, and only there, the regular-expression
library matches the notice with bounded errors and reports span and edits.  After
the best match of such a window, the stretches before and behind it are searched in
the same way, so notices that stand close together are all found.

Notices are a table of (text, label, edits); NOTICES is the default, ``notices_of``
reads one's own.  Next to this, exact base phrases are counted on word level, and
SPDX tags and copyright lines, which have a form and no fixed text, are found by pattern.

Bounds: one text at a time is scanned; overlapping windows of one notice are
merged before they are matched, so a text that repeats a seed many times is
matched once.  There is no shuffle; notices reach the workers with the function, so
their table must be small.

Defined results: a null or empty text has no words and no places, empty labels
and score 0; texts of any length are scanned whole; A-Z are lower-cased before
all else; equal rows get equal results, rows with a null id as well; of equally good matches in a
window the first one counts; extra columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame

from .shared import ALNUM, Words, flat, packed

# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Notices, their labels, and the edits they may have.
NOTICES = (
    ("licensed under the apache license, version 2.0", "apache-2.0", 4),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted, free of charge, to any person obtaining a copy", "mit", 6),
    ("licensed under the gnu general public license", "gpl", 4),
    ("licensed under the gnu lesser general public license", "lgpl", 4),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("licensed under cc by", "cc-by", 2),
    ("licensed under cc by-nc", "cc-by-nc", 2),
    ("licensed under cc by-sa", "cc-by-sa", 2),
    ("creative commons attribution", "cc-by", 2),
    ("subject to the terms of the mozilla public license", "mpl", 4),
    ("this software is released into the public domain", "public-domain", 4),
    ("all rights reserved", "reserved", 1),
    ("permission to use, copy, modify, and/or distribute this software for any purpose", "isc", 6),
    ("licensed under the gnu affero general public license", "agpl", 4),
    ("licensed under the eclipse public license", "epl", 4),
    ("licensed under cc0", "cc0", 1),
    ("licensed under cc by-nd", "cc-by-nd", 2),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5),
    ("do not distribute without permission", "no-distribution", 3),
)

# Forms without a fixed text, and their labels; of an SPDX tag its own name is the label.
SPDX = re.compile(r"spdx-license-identifier:[ \t]{0,8}([a-z0-9][a-z0-9.+-]{0,63})")
COPYRIGHT = re.compile(r"(?:copyright|\(c\)|©)[ \t]{1,4}(?:\(c\)[ \t]{1,4}|©[ \t]{0,4})?(?:19|20)[0-9]{2}\b")


@functools.lru_cache(maxsize=4)
def _prepared(notices: tuple):
    """The automaton over all pieces, and the patterns."""
    import ahocorasick
    import regex

    automaton, at = ahocorasick.Automaton(), {}
    patterns = []
    for i, (text, label, edits) in enumerate(notices):
        cuts = np.linspace(0, len(text), edits + 2).astype(int)
        for a, b in zip(cuts[:-1], cuts[1:]):
            at.setdefault(text[a:b], []).append((i, int(a)))
        patterns.append((regex.compile(f"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={edits}}}"), text, label, edits))
    for piece, owners in at.items():
        automaton.add_word(piece, (len(piece), owners))
    automaton.make_automaton()
    return automaton, patterns


def find_notices(text: str, notices: tuple = NOTICES) -> list[tuple[int, int, str, int, float]]:
    """``(start, end, label, edits, similarity)`` of each notice in a lower-cased text, in order."""
    automaton, patterns = _prepared(notices)
    spans: dict[int, list[list[int]]] = {}
    for end, (length, owners) in automaton.iter(text):
        for i, offset in owners:
            _, pattern, _, edits = patterns[i]
            start = end + 1 - length - offset
            a, b = max(0, start - edits), min(len(text), start + len(pattern) + edits)
            own = spans.setdefault(i, [])
            if own and a <= own[-1][1]:
                own[-1][0], own[-1][1] = min(own[-1][0], a), max(own[-1][1], b)
            else:
                own.append([a, b])
    found = []
    for i, windows in spans.items():
        compiled, pattern, label, edits = patterns[i]
        todo = windows[::-1]
        while todo:
            a, b = todo.pop()
            if b - a < len(pattern) - edits or not (match := compiled.search(text, a, b)):
                continue
            wrong = sum(match.fuzzy_counts)
            found.append((match.start(), match.end(), label, wrong, 1 - wrong / len(pattern)))
            todo += [[match.end(), b], [a, match.start()]]
    return sorted(found)


def find_forms(text: str) -> list[tuple[int, int, str, int, float]]:
    """SPDX tags and copyright lines of a lower-cased text, in the shape of ``find_notices``."""
    out = []
    if "spdx-license-identifier:" in text:
        out += [(*m.span(), m[1], 0, 1.0) for m in SPDX.finditer(text)]
    if "copyright" in text or "(c)" in text or "©" in text:
        out += [(*m.span(), "copyright", 0, 1.0) for m in COPYRIGHT.finditer(text)]
    return out


def notices_of(table: DataFrame) -> tuple:
    """Notices from a table (text string, label string, edits int) with a few thousand rows at most; null texts and labels are left out."""
    rows = table.where("text is not null and label is not null and edits is not null").select("text", "label", "edits").distinct().toLocalIterator()
    return tuple(sorted((lowered(r.text), r.label, max(0, min(r.edits, len(r.text) // 2))) for r in rows if r.text))


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """Where the words of a base phrase stand one after another."""
    out = []
    for phrase, label in BASE:
        want = phrase.split(" ")
        at = -1
        for _ in range(words.count(want[0])):
            at = words.index(want[0], at + 1)
            if words[at : at + len(want)] == want:
                out.append((at, label))
    return sorted(out)


def lowered(text: str) -> str:
    """A-Z to a-z, and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes: ASCII only


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text)


SCANNED = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans string"


def scan_licenses(docs: DataFrame, notices: tuple = NOTICES) -> DataFrame:
    """One row per document; ``spans`` lists the method's finds as start-end:label:edits, in characters of the text."""

    def run(parts):
        for part in parts:
            count = Words(*flat(part.column("text")), kind=ALNUM, lower=True).count
            out: dict[str, list] = {k.split()[0]: [] for k in SCANNED.split(", ")}
            for doc, text, n in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), count.tolist()):
                text = lowered(text or "")
                found = sorted(find_notices(text, notices) + find_forms(text))
                # a phrase's last word is looked for first: few texts hold one
                base = base_places(words_of(text)) if any(phrase.rpartition(" ")[2] in text and phrase.partition(" ")[0] in text for phrase, _ in BASE) else []
                base_labels = {label for _, label in base}
                values = (doc, n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {f[2] for f in found})), 1.0 if base else max((f[4] for f in found), default=0.0), " ".join(f"{a}-{b}:{label}:{wrong}" for a, b, label, wrong, _ in found))
                for k, v in zip(out, values):
                    out[k].append(v)
            yield out

    return packed(docs.select("doc_id", "text"), run, SCANNED)
