"""The rule catalogue as data, and the chance that a rule's fields agree for two people."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

# The chance that two people agree on a field, exactly and with its tolerance.
U = {"first_name": (0.02, 0.03), "last_name": (0.005, 0.01), "dob": (1e-4, 1e-4), "street_line": (3e-5, 3e-5), "phone": (1e-6, None), "email": (1e-6, None), "ssn_last4": (1e-4, None), "itin_last4": (1e-4, None), "mbi": (1e-6, None), "legal_id": (1e-6, None), "namespace_id": (1e-15, None), "zip_code": (3e-4, None), "insurance_member_id": (1e-6, None), "insurance_subscriber_id": (1e-4, None), "guardian_identity": (1.0, None), "mother_identity": (1.0, None), "birth_encounter_id": (1e-15, None), "child_of": (0.01, None), "newborn_of": (0.01, None), "city": (0.01, None), "state": (0.06, None)}
THRESHOLD = 2e-12
#: Where each field's values are.
COLUMN = {"first_name": "first_names", "last_name": "last_names", "street_line": "street_lines", "phone": "phones", "email": "emails", "legal_id": "legal_ids", "namespace_id": "namespace_ids", "zip_code": "zip_codes", "insurance_member_id": "insurance_member_ids", "insurance_subscriber_id": "insurance_subscriber_ids", "guardian_identity": "guardian_identities", "mother_identity": "mother_identities", "birth_encounter_id": "birth_encounter_ids"}


@dataclass(frozen=True)
class Rule:
    """Fields that must agree; those in ``loose`` may do so with tolerance, at most ``most`` of them besides the date of birth."""

    rule_id: str
    fields: tuple[str, ...]
    loose: frozenset[str] = frozenset()
    most: int = 0
    household: tuple[str, ...] = field(default=())


def _rule(rule_id: str, text: str, most: int = 0, household: str = "") -> Rule:
    short = {"first": "first_name", "last": "last_name", "street": "street_line", "ssn4": "ssn_last4", "itin4": "itin_last4", "legal": "legal_id", "namespace": "namespace_id", "member": "insurance_member_id", "subscriber": "insurance_subscriber_id", "zip": "zip_code", "guardian": "guardian_identity", "mother": "mother_identity", "birth": "birth_encounter_id", "child": "child_of", "newborn": "newborn_of"}
    names = [short.get(x.rstrip("*"), x.rstrip("*")) for x in text.split()]
    return Rule(rule_id, tuple(names), frozenset(n for n, x in zip(names, text.split()) if x.endswith("*")), most, tuple(short.get(x, x) for x in household.split()))


# The rules in the order in which they are tried.
RULES = tuple(
    _rule(i, text, most)
    for i, text, most in (
        ("01", "first* last* dob* street*", 2), ("02", "first last* dob* phone", 1), ("03", "first* last* dob* email", 2),
        ("04", "first* last dob ssn4", 1), ("05", "first last* dob ssn4", 1), ("06", "first* last dob itin4", 1), ("07", "first last* dob itin4", 1),
        ("08", "first dob mbi", 0), ("09", "first dob legal", 0), ("10", "last* dob* legal", 1), ("11", "first dob phone", 0), ("12", "first dob email", 0),
        ("13", "first phone ssn4", 0), ("14", "first phone itin4", 0), ("15", "first email ssn4", 0), ("16", "first email itin4", 0),
        ("17", "phone mbi", 0), ("18", "phone legal", 0), ("19", "email mbi", 0), ("20", "email legal", 0), ("21", "legal mbi", 0), ("22", "namespace", 0),
        ("23", "first dob member", 0), ("24", "last* dob* member", 1), ("25", "phone member", 0), ("26", "email member", 0),
        ("27", "first* last dob subscriber", 1), ("28", "first last* dob subscriber", 1), ("30", "last* dob phone", 1),
    )
)
HOUSEHOLD_RULES = tuple(
    _rule(i, text, most, house)
    for i, house, text, most in (
        ("C2-13", "ssn4 phone", "first* dob", 1), ("C2-14", "itin4 phone", "first* dob", 1), ("C2-15", "ssn4 email", "first* dob", 1), ("C2-16", "itin4 email", "first* dob", 1),
        ("C2-34", "phone zip", "first* dob", 1), ("C2-35", "email zip", "first* dob", 1), ("C2-37", "phone street", "first* dob", 1), ("C2-38", "subscriber phone", "first* dob", 1),
        ("C2-39", "guardian street", "child first dob", 0), ("C2-40", "mother", "newborn dob birth", 0),
    )
)


def p_collision(fields: tuple[str, ...], loose: frozenset[str] = frozenset()) -> float:
    """The product of u over fields, from left to right."""
    p = 1.0
    for f in fields:
        exact, tolerant = U[f]
        p *= tolerant if f in loose and tolerant is not None else exact
    return p


def catalogue(spark: SparkSession) -> DataFrame:
    """All rules with the chance of each, exactly and with all tolerances."""
    rows = [(r.rule_id, i, list(r.household + r.fields), sorted(r.loose), r.most, p_collision(r.household + r.fields), p_collision(r.household + r.fields, r.loose)) for i, r in enumerate(RULES + HOUSEHOLD_RULES)]
    return spark.createDataFrame(rows, "rule_id string, position int, fields array<string>, loose array<string>, max_loose int, p_exact double, p_loose double").withColumn("approved", F.col("p_exact") <= THRESHOLD)
