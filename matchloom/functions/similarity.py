"""Comparisons of values and of sets of values.

Sets are arrays without nulls.  ``dl1`` is Damerau-Levenshtein distance of at
most one, native; Jaro, Jaro-Winkler, full Damerau-Levenshtein and token
sort have no native form and are Arrow-batched functions for candidates that a
cheaper test has left over.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

MIN_FUZZY = 5


def dl1(a: Column, b: Column) -> Column:
    swap = lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b
    turned = (F.length(a) == F.length(b)) & (F.length(a) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), swap)
    return (F.levenshtein(a, b, 1) >= 0) | turned


def exact(q: Column, c: Column) -> Column:
    return F.arrays_overlap(q, c)


def any_pair(q: Column, c: Column, f) -> Column:
    return F.exists(q, lambda a: F.exists(c, lambda b: f(a, b)))


def fuzzy(q: Column, c: Column, least: int = MIN_FUZZY) -> Column:
    return exact(q, c) | any_pair(q, c, lambda a, b: (F.length(a) >= least) & (F.length(b) >= least) & dl1(a, b))


def fuzzy_only(q: Column, c: Column, least: int = MIN_FUZZY) -> Column:
    """Near, and no value the same."""
    return ~exact(q, c) & fuzzy(q, c, least)


def day(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"))


def dob_near(q: Column, c: Column) -> Column:
    """Any pair within a day; one value that is no full date makes the whole comparison false."""
    full = F.forall(F.concat(q, c), lambda v: day(v).isNotNull())
    return full & any_pair(q, c, lambda a, b: F.abs(F.datediff(day(a), day(b))) <= 1)


def swapped(c: Column) -> Column:
    return F.when(day(c).isNotNull(), day(F.concat(F.substring(c, 1, 5), F.substring(c, 9, 2), F.lit("-"), F.substring(c, 6, 2))))


def dob_swap(q: Column, c: Column) -> Column:
    return dob_near(q, c) | any_pair(q, c, lambda a, b: swapped(a) == day(b))


def dob_digit(q: Column, c: Column) -> Column:
    digits = lambda x: F.replace(x, F.lit("-"), F.lit(""))
    return dob_swap(q, c) | any_pair(q, c, lambda a, b: day(a).isNotNull() & day(b).isNotNull() & dl1(digits(a), digits(b)))


def street_fuzzy(q: Column, c: Column) -> Column:
    line, zip_ = lambda v: F.substring_index(v, "|", 1), lambda v: F.substring_index(v, "|", -1)
    near = lambda a, b: (zip_(a) == zip_(b)) & a.contains("|") & b.contains("|") & (F.length(line(a)) >= MIN_FUZZY) & (F.length(line(b)) >= MIN_FUZZY) & dl1(line(a), line(b))
    return exact(q, c) | any_pair(q, c, near)


def initial(q: Column, c: Column) -> Column:
    one = lambda a, b: (F.length(a) == 1) & (F.length(b) > 1) & b.startswith(a)
    return any_pair(q, c, lambda a, b: one(a, b) | one(b, a))


def fuzzy_distance(q: Column, c: Column) -> Column:
    return F.when(exact(q, c), 0).when(fuzzy(q, c), 1)


def day_offset(q: Column, c: Column) -> Column:
    each = F.flatten(F.transform(q, lambda a: F.transform(c, lambda b: F.abs(F.datediff(day(a), day(b))))))
    return F.when(dob_near(q, c), F.array_min(each))


def levenshtein_score(q: Column, v: Column) -> Column:
    return 1 - F.levenshtein(q, v) / F.greatest(F.length(q), F.length(v), F.lit(1))


# ---------------------------------------------------------------- without a native form


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, left = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [ch for ch, u in zip(b, used) if u]
    turned = sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - turned) / m) / 3


def _winkler(a: str, b: str) -> float:
    s = _jaro(a, b)
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return s + same * 0.1 * (1 - s) if s > 0.7 else s


def _damerau(a: str, b: str) -> int:
    """Unrestricted: a letter may be edited between two that change places."""
    top = len(a) + len(b)
    last: dict[str, int] = {}
    d = [[top] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        seen = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), seen
            if x == y:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[len(a) + 1][len(b) + 1]


def _token_sort(a: str, b: str) -> float:
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def _batched(f, kind):
    """A function of two columns; null where either is."""

    def of(a: Column, b: Column) -> Column:
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([None if p is None or q is None else f(p, q) for p, q in zip(x, y)], dtype="float64")

        return F.pandas_udf(run, T.DoubleType())(a, b).cast(kind)

    return of


jaro, jaro_winkler, token_sort = _batched(_jaro, "double"), _batched(_winkler, "double"), _batched(_token_sort, "double")
damerau = _batched(_damerau, "int")


def dob_class(a: Column, b: Column) -> Column:
    """How two written dates differ."""
    read = lambda c: F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "M/d/yyyy", "yyyyMMdd", "M-d-yyyy", "yyyy/M/d")])
    x, y = read(a), read(b)
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    parts = [(f(x) == f(y)).cast("int") for f in (F.year, F.month, F.dayofmonth)]
    year_typo = (parts[0] == 0) & (parts[1] + parts[2] == 2) & (F.abs(F.year(x) - F.year(y)) <= 2)
    recovered = ((parts[0] + parts[1] == 2) & (F.abs(F.dayofmonth(x) - F.dayofmonth(y)) <= 2)) | ((parts[0] + parts[2] == 2) & (F.abs(F.month(x) - F.month(y)) <= 1)) | year_typo
    return F.when(blank(a) | blank(b), "missing_one_side").when(F.trim(a) == F.trim(b), "identical").when(x.isNull() | y.isNull(), "unparseable").when(x == y, "format_artifact").when(recovered, "typo_auto_recovered").when(parts[0] + parts[1] + parts[2] == 2, "typo_beyond_tolerance").otherwise("genuinely_different")


def gender_class(a: Column, b: Column, canonical) -> Column:
    x, y = canonical(a), canonical(b)
    return F.when(a.isNull() | b.isNull(), "missing").when(x == y, "match_after_normalisation").when(x.isin("male", "female") & y.isin("male", "female"), "true_conflict").otherwise("other")
