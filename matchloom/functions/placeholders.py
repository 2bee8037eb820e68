"""Values that stand for nothing: each function gives a reason code, or null for a value that can be compared."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that are no names and no values.
NEWBORN = ("babyboy", "babygirl", "baby", "newborn", "infantboy", "infantgirl", "infant", "nbboy", "nbgirl", "nb", "boybabyof", "girlbabyof", "babyof", "twina", "twinb")
UNIDENTIFIED = ("unknown", "unk", "unidentified", "doe", "johndoe", "janedoe", "patient", "noname", "none", "na", "notapplicable", "anonymous", "anon")
TEST = ("test", "testing", "testpatient", "testuser", "demo", "demopatient", "sample", "samplepatient", "training", "trainingpatient", "zztest", "zzztestpatient", "fake", "fakepatient", "dummy")
UNKNOWN = ("unknown", "unk", "none", "na", "n/a", "notavailable", "notapplicable", "null", "nil", "tbd", "pending", "missing", "unavailable", "unspecified")
UNKNOWN_NAMES = ("tbd", "pending", "missing", "unavailable", "unspecified", "notavailable")
DATES = ("1800-01-01", "1900-01-01", "1901-01-01", "2000-01-01", "1111-11-11", "0001-01-01")
NAME_FORMS = r"(?i)^baby\s*(boy|girl)?\s*(of\s+)?|^(boy|girl)\s*baby\s*of\s+|^infant\s*(boy|girl)?\s*(of\s+)?|^newborn\s*(boy|girl)?\s*(of\s+)?|^twin\s*[a-z]$|^zz+|^test\s*patient|^x{2,}$|^\.+$"
PHONES = r"^(0{7,}|1{10}|5{10}|9{10}|(\d)\2{6,}|1234567890)$"
STREETS = r"(?i)^(p\.?\s*o\.?|post\s+office)\s*box\s*#?\s*0+\s*\.?$|^unknown|^(homeless|no\s*(fixed\s*)?address)|^general\s*delivery$|^none$|^n/?a$"


def _bare(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s\-'.]+", ""))


def _reason(*cases: tuple[Column, str]) -> Column:
    out = None
    for when, code in cases:
        out = F.when(when, code) if out is None else out.when(when, code)
    return out


def _empty(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def reason_name(c: Column, allow_initial: bool = False) -> Column:
    x = _bare(c)
    single = x.rlike(r"^(.)\1{2,}$") if allow_initial else (F.length(x) == 1) | x.rlike(r"^(.)\1{2,}$")
    return _reason((_empty(c), "empty"), (x.isin(*NEWBORN), "newborn_temp_name"), (x.isin(*UNIDENTIFIED), "unidentified_name"), (x.isin(*TEST), "test_name"), (x.isin(*UNKNOWN_NAMES), "unknown_placeholder"), (single, "single_or_repeated_character"), (c.rlike(NAME_FORMS), "placeholder_pattern"))


def reason_general(c: Column) -> Column:
    return _reason((_empty(c), "empty"), (_bare(c).isin(*UNKNOWN), "unknown_placeholder"))


def reason_date(c: Column, as_of: str) -> Column:
    day, today = F.try_to_timestamp(F.trim(c), F.lit("yyyy-MM-dd")).cast("date"), F.to_date(F.lit(as_of))
    low = F.make_date(F.year(today) - 120, F.lit(1), F.lit(1))
    return _reason((_empty(c), "empty"), (_bare(c).isin(*UNKNOWN), "unknown_placeholder"), (F.trim(c).isin(*DATES), "placeholder_date"), (day.isNull(), "unparseable"), (~day.between(low, F.date_add(today, 2)), "out_of_range"))


def reason_phone(c: Column) -> Column:
    bare = F.regexp_replace(c, r"(?i)\s*(?:;\s*ext=|,|ext\.?|extension|x|#)\s*\d+\s*$", "")
    d = F.regexp_replace(bare, r"\D", "")
    foreign = F.trim(c).startswith("+") & ~d.startswith("1")
    return _reason((_empty(c), "empty"), (d == "", "no_digits"), (d.rlike(PHONES), "placeholder_pattern"), (d.rlike(r"^1?\d{3}555\d{4}$") & ~foreign, "exchange_555"))


def looks_like_unit(c: Column) -> Column:
    return c.rlike(r"(?i)\d|^(apt|apartment|unit|ste|suite|rm|room|fl|floor|bldg|building|lot|spc|space|trlr|trailer|dept|department|ph|bsmt|frnt|rear|ofc|lbby|lowr|uppr|hngr|pier|slip|stop|key)\b") & reason_general(c).isNull()


def reason_address(c: Column, unit: Column | None = None) -> Column:
    unit = F.lit(False) if unit is None else F.coalesce(looks_like_unit(unit), F.lit(False))
    return _reason((_empty(c), "empty"), (_bare(c).isin(*UNKNOWN), "unknown_placeholder"), (F.trim(c).rlike(r"(?i)^123\s+main\s+(st|street)\s*[.,]?$") & ~unit, "generic_street"), (F.trim(c).rlike(STREETS), "placeholder_pattern"))


def reason_postal(c: Column) -> Column:
    d = F.regexp_replace(c, r"\D", "")
    return _reason((F.length(d).isin(5, 9) & F.substring(d, 1, 5).isin("00000", "99999"), "placeholder_zip"))


def reason_email(c: Column) -> Column:
    x = F.lower(F.trim(c))
    return _reason((_empty(c), "empty"), (x.rlike("^(test|noreply|no-reply|donotreply|nobody|null|none|fake)"), "placeholder_prefix"), (x.rlike(r"@(example\.com|test\.com|invalid|nowhere)$"), "placeholder_domain"), (x.rlike("^unknown@"), "unknown_placeholder"))


def reason_ssn(c: Column) -> Column:
    return _reason((_empty(c), "empty"), (c.rlike(r"^0{3}|^9{3}|^(\d)\1{2}-\1{2}-\1{4}$"), "placeholder_pattern"))


def reason_last4(c: Column) -> Column:
    return _reason((_empty(c), "empty"), (c.isin("0000", "9999", "1234") | c.rlike(r"^(\d)\1{3}$"), "placeholder_last4"))


def reason_subscriber(c: Column) -> Column:
    return _reason((_empty(c), "empty"), (F.trim(c).rlike("(?i)^(0+|9+|pending|tbd|none)$"), "placeholder_pattern"))


def unusable_street(c: Column) -> Column:
    return c.rlike(r"(?i)\bp\.?\s*o\.?\s*box\b|^\s*(rr|rural route|route|hc|hwy|highway)\b")
