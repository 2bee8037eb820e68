"""Normalisation of names, dates, phones, addresses and identifiers as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# Spellings of suffixes and their canonical forms; numbers 1-39 follow by rule.
SUFFIXES = {"jr": "jr", "junior": "jr", "jnr": "jr", "sr": "sr", "senior": "sr", "snr": "sr", "first": "i", "second": "ii", "third": "iii", "fourth": "iv", "fifth": "v", "sixth": "vi", "seventh": "vii", "eighth": "viii", "ninth": "ix", "tenth": "x", "esq": "esq", "esquire": "esq", "md": "md", "phd": "phd", "do": "do", "dds": "dds"}
# Nicknames by given name.
NICKNAMES = {"robert": ["bob", "rob", "bobby"], "william": ["bill", "will", "billy"], "james": ["jim", "jimmy"], "elizabeth": ["liz", "beth", "betty"], "margaret": ["peggy", "meg", "maggie"], "richard": ["dick", "rick", "rich"], "john": ["jack", "johnny"], "katherine": ["kate", "kathy", "katie"], "michael": ["mike", "mikey"], "thomas": ["tom", "tommy"], "joseph": ["joe", "joey"], "charles": ["charlie", "chuck"], "patricia": ["pat", "patty"], "edward": ["ed", "ted", "eddie"], "susan": ["sue", "susie"]}
GENERATIONAL = ("jr", "sr", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= value:
            out, n = out + sign, n - value
    return out


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Latin letters with marks and their plain forms, found from Unicode's own decompositions."""
    source, plain = "", ""
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base != chr(code) and base.isascii():
            source, plain = source + chr(code), plain + base
    # Letters without a decomposition.
    return source + "øØđĐłŁıħĦ", plain + "oOdDlLihH", [("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "Th"), ("ð", "d"), ("Ð", "D")]


_SOURCE, _PLAIN, _PAIRS = _fold_tables()


def fold_diacritics(c: Column) -> Column:
    for a, b in _PAIRS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(c, _SOURCE, _PLAIN), r"[̀-ͯ]", "")


def normalize_text(c: Column, preserve_spaces: bool = False) -> Column:
    """Lower case, plain letters, no punctuation, spaces removed or collapsed."""
    c = F.regexp_replace(fold_diacritics(F.lower(c)), r"[^\w\s]", "")
    return F.trim(F.regexp_replace(c, r"\s+", " ")) if preserve_spaces else F.regexp_replace(c, r"\s+", "")


def suffix_tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"[\s,;/\-.]+"), lambda t: (t != "") & (F.lower(t) != "the"))


def canonical_suffix(c: Column) -> Column:
    clean = normalize_text(c)
    number = F.regexp_extract(clean, r"^(\d{1,2})(?:st|nd|rd|th|d)?$", 1)
    romans = F.array(*[F.lit(_roman(i)) for i in range(1, 40)])
    n = F.try_to_number(number, F.lit("99")).cast("int")
    return F.coalesce(F.try_element_at(literal_map(SUFFIXES), clean), F.when(n.between(1, 39), F.element_at(romans, F.greatest(n, F.lit(1)))), clean)


def generational(suffixes: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(suffixes, canonical_suffix), lambda s: s.isin(*GENERATIONAL) | s.rlike("^[ivx]+$")))


def suffixes_conflict(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def nicknames(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in NICKNAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), c), F.array().cast("array<string>"))


def birth_date(c: Column, as_of: str) -> Column:
    """Full, month or year dates as they are; null outside [as_of - 120 years, as_of + 2 days], partial ones within the years."""
    c = F.trim(c)
    today = F.to_date(F.lit(as_of))
    year = F.substring(c, 1, 4).cast("int")
    full = F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")
    ok_full = c.rlike(r"^\d{4}-\d{2}-\d{2}$") & full.isNotNull() & full.between(F.make_date(F.year(today) - 120, F.lit(1), F.lit(1)), F.date_add(today, 2))
    ok_part = c.rlike(r"^\d{4}(-(0[1-9]|1[0-2]))?$") & year.between(F.year(today) - 120, F.year(today))
    return F.when(ok_full | ok_part, c)


def e164(c: Column) -> Column:
    """A North American number as +1 and ten digits, or another with its + and 8 to 15 digits; else null."""
    bare = F.regexp_replace(c, r"(?i)\s*(?:;\s*ext=|,|ext\.?|extension|x|#)\s*\d+\s*$", "")
    d = F.regexp_replace(bare, r"\D", "")
    ten = F.when(F.length(d) == 10, d).when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10))
    valid = ten.rlike(r"^[2-9]\d{2}[0-9]\d{6}$") & ~ten.rlike(r"^(\d)11|^.11|^555|^[2-9]9\d") & ~F.substring(ten, 4, 3).rlike("^.11$")
    foreign = F.trim(c).startswith("+") & ~d.startswith("1") & d.rlike(r"^\d{8,15}$")
    return F.when(valid, F.concat(F.lit("+1"), ten)).when(foreign, F.concat(F.lit("+"), d))


def postal(c: Column) -> Column:
    x = F.regexp_replace(c, r"[^0-9-]", "")
    d = F.replace(x, F.lit("-"), F.lit(""))
    return F.when(F.length(d) == 9, F.concat(F.substring(d, 1, 5), F.lit("-"), F.substring(d, 6, 4))).when(F.length(d) == 5, d).otherwise(x)


def zip5(c: Column) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"^(\d{5})(?:[-\s]?\d{4})?$", 1)


def pad_zip(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{1,4}$"), F.lpad(c, 5, "0")).otherwise(c)


# Street words and their short forms, and designators of units.
STREET = {"street": "st", "avenue": "ave", "road": "rd", "drive": "dr", "lane": "ln", "court": "ct", "boulevard": "blvd", "place": "pl", "terrace": "ter", "circle": "cir", "highway": "hwy", "parkway": "pkwy", "square": "sq", "trail": "trl", "meadows": "mdws", "heights": "hts", "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw", "apartment": "apt", "suite": "ste", "building": "bldg", "floor": "fl", "room": "rm"}
# Words before a unit's number, in a line of its own and at the end of a street line.
DESIGNATORS = ("apt", "apartment", "unit", "ste", "suite", "rm", "room", "fl", "floor", "bldg", "building", "lot", "spc", "space", "trlr", "trailer", "dept", "department", "ph", "bsmt", "frnt", "rear", "ofc", "lbby", "lowr", "uppr", "hngr", "pier", "slip", "stop", "key")
TRAILING = ("suite", "ste", "unit", "apt", "apartment", "rm", "room", "floor", "fl", "bldg", "building", "lot")
# Fixed value: what may follow such a word at the end of a street line.
UNIT_ID = r"(?:[0-9][\w-]*|[A-Z][0-9][\w-]*|[A-Z])"


def standard_street(c: Column) -> Column:
    words = F.split(normalize_text(c, preserve_spaces=True), " ")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(literal_map(STREET), w), w)), " ")


def unit_only(c: Column) -> Column:
    """A line that holds a unit and no street: a designator and one or two numbers or letters, a short token with a digit, or a numbered floor."""
    words = F.split(F.lower(F.trim(F.replace(c, F.lit("#"), F.lit(" ")))), r"\s+")
    first, rest = F.element_at(words, 1), F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    numbered = F.size(rest).between(1, 2) & F.forall(rest, lambda w: w.rlike("^([0-9][a-z0-9-]*|[a-z])$"))
    short = (F.size(words) == 1) & (F.length(first) <= 4) & first.rlike("^[a-z0-9-]*[0-9][a-z0-9-]*$")
    floor = first.rlike("^[0-9]+(st|nd|rd|th)$") & F.coalesce(F.try_element_at(rest, F.lit(1)).rlike(r"^(floor|fl)\b"), F.lit(False))
    return F.coalesce((first.isin(*DESIGNATORS) & numbered) | short | floor, F.lit(False))


def line_one(lines: Column) -> Column:
    own = F.filter(lines, lambda x: (x != "") & ~unit_only(x))
    return F.coalesce(F.try_element_at(F.filter(own, lambda x: x.rlike(r"^\d")), F.lit(1)), F.try_element_at(own, F.lit(1)))


def strip_unit(c: Column) -> Column:
    """A street without a unit at its end: a designator with one or two identifiers, or all from a # on that is not its beginning."""
    named = rf"(?i)[\s,]+(?:{'|'.join(TRAILING)})(?:\s*#\s*|\s+){UNIT_ID}(?:\s+{UNIT_ID})?[\s-]*$"
    x = F.regexp_replace(F.regexp_replace(c, named, ""), r"[\s,]+#\s*\w.*$", "")
    return F.regexp_replace(x, r"^[ ,-]+|[ ,-]+$", "")


def iso_date(c: Column) -> Column:
    """A day in one of three forms, of the whole cell or its first ten characters."""
    made = [F.try_to_timestamp(x, F.lit(f)).cast("date") for x in (F.trim(c), F.substring(F.trim(c), 1, 10)) for f in ("yyyy-MM-dd", "M/d/yyyy", "M/d/yy")]
    return F.date_format(F.coalesce(*made), "yyyy-MM-dd")


def clean_cell(c: Column) -> Column:
    x = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(x.rlike(r"^\d+\.0$"), F.regexp_replace(x, r"\.0$", "")).otherwise(x)


def beds(c: Column) -> Column:
    n = c.try_cast("double")
    return F.when(~F.isnan(n) & (n >= 0), n.try_cast("int"))


def gender(c: Column) -> Column:
    forms = {"m": "male", "male": "male", "f": "female", "female": "female", "u": "unknown", "unk": "unknown", "unknown": "unknown", "o": "other", "other": "other"}
    return F.try_element_at(literal_map(forms), F.lower(F.trim(c)))


def split_address(c: Column) -> Column:
    form = r"^\s*(.+?),\s*([^,]+?),?\s+([A-Za-z]{2})\.?,?\s+(\d{5})(?:-\d{4})?\s*$"
    return F.struct(*[F.regexp_extract(c, form, i).alias(n) for i, n in enumerate(("street", "city", "state", "zip"), 1)])


def strip_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^[^-]+-", "")
