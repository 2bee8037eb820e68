"""Queries over nested patient records, from raw values to matches, and their SQL: what each remainder of the key must give, stated field by field."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fields, matching
from ..sources.people import patients
from .catalogue import query

AS_OF = "2026-06-01"
#: Field, value and condition of all values that extraction must find for customer k.
_VALUES = (
    ("first_names", "'robert'", "k % 3 = 0"), ("first_names", "'bob'", "k % 3 = 0"), ("first_names", "'rob'", "k % 3 = 0"), ("first_names", "'bobby'", "k % 3 = 0"), ("first_names", "'lee'", "k % 3 = 0"),
    ("first_names", "concat('maria', k % 20)", "k % 3 <> 0"), ("first_names", "'anna'", "k % 4 = 1"),
    ("middle_names", "'lee'", "k % 3 = 0"), ("suffixes", "'jr'", "k % 5 = 0"),
    ("last_names", "CASE WHEN k % 7 = 0 THEN 'oconnor' WHEN k % 7 = 1 THEN 'delacruz' WHEN k % 7 = 2 THEN 'muller' ELSE concat('family', k % 50) END", "TRUE"), ("last_names", "'jones'", "k % 4 = 1"),
    ("dob", "CAST(DATE '1950-01-01' + CAST(k % 9000 AS INT) AS VARCHAR)", "k % 11 <> 0 AND k % 23 <> 1"),
    ("phones", "concat('+1415867', 1000 + k % 8000)", "k % 6 <> 0"), ("emails", "concat('p', k, '@mail.org')", "k % 8 <> 0"),
    ("zip_codes", "CAST(10000 + k % 700 AS VARCHAR)", "k % 10 <> 0"),
    ("street_lines", "concat(1 + k % 97, CASE WHEN k % 10 = 1 THEN ' maple ave|' ELSE ' belt line rd|' END, 10000 + k % 700)", "k % 10 <> 0"),
    ("ssn_last4", "CAST(6000 + k % 500 AS VARCHAR)", "k % 3 < 2"), ("itin_last4", "CAST(7000 + k % 400 AS VARCHAR)", "k % 9 = 2"), ("mbi", "concat('1EG4', k)", "k % 4 = 0"),
    ("legal_ids", "concat(CASE WHEN k % 2 = 0 THEN 'ca|' ELSE '' END, 'D', k)", "TRUE"),
    ("insurance_member_ids", "concat('urn:payer|M', k)", "k % 5 = 1"), ("insurance_subscriber_ids", "concat('urn:payer|S', k)", "k % 5 = 2 AND k % 2 = 0"),
    ("guardian_identities", "concat('urn:own|G', k)", "k % 13 = 0"), ("mother_identities", "concat('urn:own|T', k)", "k % 13 = 1"), ("birth_encounter_ids", "concat('urn:own|E', k)", "k % 13 = 1"),
    ("namespace_ids", "concat('R', k)", "k % 6 = 1"), ("namespace_ids", "concat('urn:other|X', k)", "k % 6 = 2 AND k % 4 <> 2"),
    ("relationship_linkage_clinical", "CASE WHEN k % 13 = 0 THEN 'child-of' ELSE 'newborn-of' END", "k % 13 < 2 AND k % 2 = 0"), ("relationship_linkage_self_reported", "CASE WHEN k % 13 = 0 THEN 'child-of' ELSE 'newborn-of' END", "k % 13 < 2 AND k % 2 = 1"),
)
_INDEX = " UNION ALL ".join(f"SELECT concat('p', k) AS patient_id, '{f}' AS field_name, {v} AS value FROM c WHERE {w}" for f, v, w in _VALUES)
_FROM = "c AS (SELECT c_custkey AS k FROM customer)"


def _extracted(spark, d):
    return fields.extracted(fields.normalized(patients(spark, d), AS_OF))


@query(f"WITH {_FROM} {_INDEX}")
def extract_index(spark, d):
    """Normalised, extracted and indexed values of nested records."""
    return fields.index_rows(_extracted(spark, d))


@query(f"WITH {_FROM}, i AS ({_INDEX}) SELECT patient_id, string_agg(CASE WHEN field_name = 'first_names' THEN value END, ',' ORDER BY value) AS first_names, string_agg(CASE WHEN field_name = 'last_names' THEN value END, ',' ORDER BY value) AS last_names, max(CASE WHEN field_name = 'dob' THEN value END) AS dob, max(CASE WHEN field_name = 'phones' THEN value END) AS phone, max(CASE WHEN field_name = 'street_lines' THEN value END) AS street, max(CASE WHEN field_name = 'itin_last4' THEN value END) AS itin, max(CASE WHEN field_name = 'legal_ids' THEN value END) AS legal FROM i GROUP BY patient_id")
def extract_fields(spark, d):
    """Extracted fields as sets."""
    own = _extracted(spark, d)
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return own.select("patient_id", joined("first_names").alias("first_names"), joined("last_names").alias("last_names"), *[F.array_max(c).alias(n) for c, n in (("dob", "dob"), ("phones", "phone"), ("street_lines", "street"), ("itin_last4", "itin"), ("legal_ids", "legal"))])


_DROPPED = (
    ("birthDate", "'1900-01-01'", "placeholder_date", "k % 11 = 0"), ("telecom[0].value", "'555-555-5555'", "placeholder_pattern", "k % 6 = 0"), ("telecom[1].value", "'noreply@acme.org'", "placeholder_prefix", "k % 8 = 0"),
    ("address[0].line[0]", "'PO Box 0'", "placeholder_pattern", "k % 10 = 0"),
)
_PENDING = "concat('identifier[', CAST((CASE WHEN k % 3 < 2 THEN 1 ELSE 0 END + CASE WHEN k % 9 = 2 THEN 1 ELSE 0 END + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END + 1 + CASE WHEN k % 5 IN (1, 2) THEN 1 ELSE 0 END + CASE WHEN k % 13 = 0 THEN 1 WHEN k % 13 = 1 THEN 2 ELSE 0 END) AS VARCHAR), '].value')"


@query(f"WITH {_FROM} " + " UNION ALL ".join(f"SELECT concat('p', k) AS id, '{p}' AS path, {v} AS raw_value, '{r}' AS reason FROM c WHERE {w}" for p, v, r, w in _DROPPED) + f" UNION ALL SELECT concat('p', k), {_PENDING}, 'pending', 'placeholder_pattern' FROM c WHERE k % 6 = 2 AND k % 4 = 2")
def normalize_report(spark, d):
    """Values that normalisation drops, with place and reason."""
    return fields.report(patients(spark, d), AS_OF)


@query(f"WITH {_FROM}, i AS ({_INDEX}) SELECT field_name, count(DISTINCT patient_id) AS n_patients, count(*) AS n_values FROM i GROUP BY field_name")
def index_counts(spark, d):
    return fields.index_counts(fields.index_rows(_extracted(spark, d)))


@query("SELECT count(*) AS n FROM customer")
def matchable_patients(spark, d):
    return fields.matchable(_extracted(spark, d)).agg(F.count("*").alias("n"))


@query(f"WITH {_FROM}, i AS ({_INDEX}), q AS (SELECT a.patient_id AS query_id, b.patient_id FROM i a JOIN i b ON a.field_name = 'namespace_ids' AND b.field_name = a.field_name AND a.value = b.value AND a.patient_id <> b.patient_id) SELECT concat('p', k) AS query_id, CAST((SELECT count(*) FROM q WHERE query_id = concat('p', k)) AS BIGINT) AS n FROM c")
def shared_namespace_ids(spark, d):
    """Patients that share a namespace id with each one: the strongest rule over the index, as a join."""
    rows = fields.index_rows(_extracted(spark, d))
    own = rows.where("field_name = 'namespace_ids'")
    other = own.select(F.col("patient_id").alias("other"), "value")
    pairs = own.join(other, "value").where("patient_id <> other").groupBy(F.col("patient_id").alias("query_id")).agg(F.count("*").alias("n"))
    return rows.select(F.col("patient_id").alias("query_id")).distinct().join(pairs, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))


@query()
def record_match(spark, d):
    """Nested records against themselves through the service: normalised, matched, one row each."""
    p = patients(spark, d)
    return matching.service(p, p, AS_OF)[0].select("query_id", "outcome", "n_matches")
