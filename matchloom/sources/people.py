"""People made from the customer table by one SQL text that Spark and DuckDB both run: typos, swapped letters, neighbouring days, households and twins are planted by remainders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FIRST = ("robert", "maria", "jayden", "elizabeth", "william", "susan", "michael", "patricia", "thomas", "margaret", "joseph", "katherine", "charles", "angela", "edward", "laura", "kevin", "nicole")
LAST = ("smith", "alvarez", "johnson", "nguyen", "washington", "martinez", "thompson", "robinson", "patterson", "gonzalez", "sullivan", "fitzgerald", "oconnor")
STREETS = ("pinnacle mdws", "maple ave", "belt line rd", "alameda ave", "harbor view dr")
#: Fields of a person that hold one value each here and a set in general.
FIELDS = ("first_names", "last_names", "middle_names", "suffixes", "dob", "phones", "emails", "ssn_last4", "itin_last4", "mbi", "legal_ids", "namespace_ids", "zip_codes", "street_lines", "insurance_member_ids", "insurance_subscriber_ids", "guardian_identities", "mother_identities", "birth_encounter_ids", "relationship_linkage_clinical", "relationship_linkage_self_reported")


def _pick(values: tuple, by: str) -> str:
    return "CASE " + " ".join(f"WHEN {by} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: Two rows share a person b; the odd one carries the changes.
PEOPLE = f"""
SELECT k AS pid,
  CASE WHEN k % 14 = 3 THEN concat(substr(fn, 2, 1), substr(fn, 1, 1), substr(fn, 3)) WHEN k % 22 = 5 THEN concat(fn, 'n') ELSE fn END AS first_name,
  CASE WHEN k % 18 = 7 THEN concat(substr(ln, 1, 2), substr(ln, 4)) WHEN k % 26 = 9 THEN concat(ln, 's') ELSE ln END AS last_name,
  CASE WHEN b % 3 = 0 THEN 'lee' WHEN b % 3 = 1 THEN 'ann' END AS middle_name,
  CASE WHEN k % 34 = 1 THEN 'jr' WHEN k % 34 = 2 THEN 'sr' END AS suffix,
  CAST(DATE '1950-01-01' + CAST((b * 37) % 20000 + CASE WHEN k % 10 = 1 THEN 1 ELSE 0 END AS INT) AS STRING) AS dob,
  CASE WHEN k % 12 <> 11 THEN concat('+1415867', CAST(1000 + h % 9000 AS STRING)) END AS phone,
  CASE WHEN k % 16 <> 5 THEN concat('p', CAST(h AS STRING), '@mail.org') END AS email,
  CASE WHEN k % 6 <> 4 THEN CAST(1000 + (b * 7919) % 9000 AS STRING) END AS ssn4,
  CASE WHEN k % 9 = 0 THEN concat('MBI', CAST(b AS STRING)) END AS mbi,
  CASE WHEN k % 5 <> 2 THEN concat('ca|D', CAST(b AS STRING)) END AS legal_id,
  CASE WHEN k % 8 < 2 THEN concat('ns|', CAST(b AS STRING)) END AS namespace_id,
  CAST(10000 + h % 700 AS STRING) AS zip,
  concat(CAST(1 + h % 97 AS STRING), ' ', {_pick(STREETS, 'h')}, '|', CAST(10000 + h % 700 AS STRING)) AS street,
  CASE WHEN k % 7 < 4 THEN concat('M', CAST(b AS STRING)) END AS member_id,
  CASE WHEN k % 7 > 3 THEN concat('S', CAST(h AS STRING)) END AS subscriber_id
FROM (SELECT k, b, CAST(floor(b / 2) AS BIGINT) AS h, {_pick(FIRST, 'b')} AS fn, {_pick(LAST, 'h')} AS ln
      FROM (SELECT c_custkey AS k, CAST(floor(c_custkey / 2) AS BIGINT) AS b FROM customer) a) p
"""

_ONE = {"first_names": "first_name", "last_names": "last_name", "middle_names": "middle_name", "suffixes": "suffix", "dob": "dob", "phones": "phone", "emails": "email", "ssn_last4": "ssn4", "mbi": "mbi", "legal_ids": "legal_id", "namespace_ids": "namespace_id", "zip_codes": "zip", "street_lines": "street", "insurance_member_ids": "member_id", "insurance_subscriber_ids": "subscriber_id"}


def flat_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value a field."""
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    return spark.sql(PEOPLE)


def as_fields(flat: DataFrame) -> DataFrame:
    """``patient_id`` and the 21 sets."""
    sets = [F.array_compact(F.array(F.col(_ONE[f]) if f in _ONE else F.lit(None).cast("string"))).alias(f) for f in FIELDS]
    return flat.select(F.col("pid").cast("string").alias("patient_id"), *sets)


#: Nested records: several names, codings and relationships, and values that stand for nothing, by remainders of the key.
PATIENTS = """
SELECT concat('p', k) AS id, 'Patient' AS resourceType,
  CASE WHEN k % 11 = 0 THEN '1900-01-01' WHEN k % 23 = 1 THEN NULL ELSE CAST(DATE '1950-01-01' + CAST(k % 9000 AS INT) AS STRING) END AS birthDate,
  filter(array(
    named_struct('use', 'official', 'family', CASE WHEN k % 7 = 0 THEN 'O''Connor' WHEN k % 7 = 1 THEN 'de la Cruz' WHEN k % 7 = 2 THEN 'M\u00fcller' ELSE concat('Family', k % 50) END,
      'given', CASE WHEN k % 3 = 0 THEN array('Robert', 'Lee') ELSE array(concat('Maria', k % 20)) END, 'prefix', CAST(array() AS ARRAY<STRING>), 'suffix', CASE WHEN k % 5 = 0 THEN array('Jr.') ELSE CAST(array() AS ARRAY<STRING>) END, 'text', CAST(NULL AS STRING)),
    CASE WHEN k % 4 = 1 THEN named_struct('use', 'maiden', 'family', 'Jones', 'given', array('Anna'), 'prefix', CAST(array() AS ARRAY<STRING>), 'suffix', CAST(array() AS ARRAY<STRING>), 'text', CAST(NULL AS STRING)) END), x -> x IS NOT NULL) AS name,
  array(named_struct('system', 'phone', 'value', CASE WHEN k % 6 = 0 THEN '555-555-5555' ELSE concat('(415) 867-', 1000 + k % 8000) END, 'use', 'home'),
    named_struct('system', 'email', 'value', CASE WHEN k % 8 = 0 THEN 'noreply@acme.org' ELSE concat('P', k, '@Mail.ORG') END, 'use', 'home')) AS telecom,
  array(named_struct('use', 'home', 'type', 'postal', 'line', CASE WHEN k % 10 = 0 THEN array('PO Box 0') WHEN k % 10 = 1 THEN array('Apt 4', concat(1 + k % 97, ' Maple Avenue')) ELSE array(concat(1 + k % 97, ' Belt Line Road'), 'Apt 4') END, 'city', 'Reno', 'state', 'NV', 'postalCode', concat(10000 + k % 700, CASE WHEN k % 2 = 0 THEN '-1234' ELSE '' END), 'country', 'US')) AS address,
  filter(array(
    CASE WHEN k % 3 < 2 THEN named_struct('system', 'http://hl7.org/fhir/sid/us-ssn', 'value', concat('123-45-', 6000 + k % 500), 'type', named_struct('coding', CAST(array() AS ARRAY<STRUCT<system: STRING, code: STRING>>)), 'assigner', named_struct('display', CAST(NULL AS STRING))) END,
    CASE WHEN k % 9 = 2 THEN named_struct('system', 'urn:oid:2.16.840.1.113883.4.4', 'value', concat('900-70-', 7000 + k % 400), 'type', named_struct('coding', CAST(array() AS ARRAY<STRUCT<system: STRING, code: STRING>>)), 'assigner', named_struct('display', CAST(NULL AS STRING))) END,
    CASE WHEN k % 4 = 0 THEN named_struct('system', 'http://hl7.org/fhir/sid/us-mbi', 'value', concat('1EG4', k), 'type', named_struct('coding', CAST(array() AS ARRAY<STRUCT<system: STRING, code: STRING>>)), 'assigner', named_struct('display', CAST(NULL AS STRING))) END,
    named_struct('system', 'urn:dl', 'value', concat('D', k), 'type', named_struct('coding', array(named_struct('system', 'x', 'code', 'ZZ'), named_struct('system', 'x', 'code', 'DL'))), 'assigner', named_struct('display', CASE WHEN k % 2 = 0 THEN 'ca' END)),
    CASE WHEN k % 5 = 1 THEN named_struct('system', 'urn:payer', 'value', concat('M', k), 'type', named_struct('coding', array(named_struct('system', 'x', 'code', 'MB'))), 'assigner', named_struct('display', CAST(NULL AS STRING))) END,
    CASE WHEN k % 5 = 2 THEN named_struct('system', CASE WHEN k % 2 = 0 THEN 'urn:payer' END, 'value', concat('S', k), 'type', named_struct('coding', array(named_struct('system', 'x', 'code', 'SN'))), 'assigner', named_struct('display', CAST(NULL AS STRING))) END,
    CASE WHEN k % 13 = 0 THEN named_struct('system', 'urn:own', 'value', concat('G', k), 'type', named_struct('coding', array(named_struct('system', 'x', 'code', 'CMS-GRDN'))), 'assigner', named_struct('display', CAST(NULL AS STRING))) END,
    CASE WHEN k % 13 = 1 THEN named_struct('system', 'urn:own', 'value', concat('T', k), 'type', named_struct('coding', array(named_struct('system', 'x', 'code', 'CMS-MTHR'))), 'assigner', named_struct('display', CAST(NULL AS STRING))) END,
    CASE WHEN k % 13 = 1 THEN named_struct('system', 'urn:own', 'value', concat('E', k), 'type', named_struct('coding', array(named_struct('system', 'x', 'code', 'CMS-BEID'))), 'assigner', named_struct('display', CAST(NULL AS STRING))) END,
    CASE WHEN k % 6 = 1 THEN named_struct('system', CAST(NULL AS STRING), 'value', concat('R', k), 'type', named_struct('coding', array(named_struct('system', 'x', 'code', 'MR'))), 'assigner', named_struct('display', CAST(NULL AS STRING))) END,
    CASE WHEN k % 6 = 2 THEN named_struct('system', 'urn:other', 'value', CASE WHEN k % 4 = 2 THEN 'pending' ELSE concat('X', k) END, 'type', named_struct('coding', CAST(array() AS ARRAY<STRUCT<system: STRING, code: STRING>>)), 'assigner', named_struct('display', CAST(NULL AS STRING))) END), x -> x IS NOT NULL) AS identifier,
  CASE WHEN k % 13 < 2 THEN array(named_struct('url', 'https://example.org/StructureDefinition/relationship-linkage', 'extension', array(named_struct('url', 'type', 'valueCode', CASE WHEN k % 13 = 0 THEN 'child-of' ELSE 'newborn-of' END), named_struct('url', 'source', 'valueCode', CASE WHEN k % 2 = 0 THEN 'clinical' ELSE 'self-reported' END)))) ELSE CAST(array() AS ARRAY<STRUCT<url: STRING, extension: ARRAY<STRUCT<url: STRING, valueCode: STRING>>>>) END AS extension
FROM (SELECT c_custkey AS k FROM customer) c
"""


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records, one for each customer."""
    # a record is made of a few bytes, but takes long: keys are dealt to all tasks first
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").repartition(spread, "c_custkey").createOrReplaceTempView("customer")
    return spark.sql(PATIENTS)
