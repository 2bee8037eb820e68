"""Match fields from nested patient records, and the field-value index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import placeholders as ph, text
from ..sources.people import FIELDS

PATIENT = (
    "id string, resourceType string, birthDate string, name array<struct<use:string,family:string,given:array<string>,prefix:array<string>,suffix:array<string>,text:string>>, "
    "telecom array<struct<system:string,value:string,use:string>>, address array<struct<use:string,type:string,line:array<string>,city:string,state:string,postalCode:string,country:string>>, "
    "identifier array<struct<system:string,value:string,type:struct<coding:array<struct<system:string,code:string>>>,assigner:struct<display:string>>>, "
    "extension array<struct<url:string,extension:array<struct<url:string,valueCode:string>>>>"
)
# Identifier systems and type codes.
GUARDIAN, MOTHER, BIRTH, NAMESPACE = "CMS-GRDN", "CMS-MTHR", "CMS-BEID", ("RI", "MR", "AN", "PI")
SSN, ITIN, MBI = "http://hl7.org/fhir/sid/us-ssn", "urn:oid:2.16.840.1.113883.4.4", "http://hl7.org/fhir/sid/us-mbi"


def _set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(c, lambda v: v.isNotNull() & (v != ""))))


def _strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def normalized(patients: DataFrame, as_of: str) -> DataFrame:
    """The same records with clean values; what stands for nothing is gone."""
    def name(n):
        given = F.transform(F.filter(_strings(n["given"]), lambda g: ph.reason_name(g, True).isNull()), lambda g: text.normalize_text(g))
        bad_given, why = F.size(given) == 0, ph.reason_name(n["family"], True)
        alone = why.isin("unidentified_name", "unknown_placeholder", "single_or_repeated_character") & ~text.normalize_text(n["family"]).isin("doe", "na")
        family = F.when(~F.coalesce(alone, F.lit(False)), text.normalize_text(n["family"]))
        drop = (bad_given & F.coalesce(why.isNotNull(), F.lit(True))) | ph.reason_name(F.concat_ws("", F.try_element_at(given, F.lit(1)), family)).isin("unidentified_name", "test_name")
        return F.when(~F.coalesce(drop, F.lit(False)), F.struct(n["use"].alias("use"), family.alias("family"), given.alias("given"), n["prefix"].alias("prefix"), n["suffix"].alias("suffix"), n["text"].alias("text")))

    def contact(t):
        value = F.when((t["system"] == "phone") & ph.reason_phone(t["value"]).isNull(), text.e164(t["value"])).when((t["system"] == "email") & ph.reason_email(t["value"]).isNull(), F.lower(F.trim(t["value"]))).when(~t["system"].isin("phone", "email"), F.trim(t["value"]))
        return F.when(value.isNotNull(), F.struct(t["system"].alias("system"), value.alias("value"), t["use"].alias("use")))

    def place(a):
        lines = _strings(a["line"])
        one, two = F.try_element_at(lines, F.lit(1)), F.try_element_at(lines, F.lit(2))
        bad = F.coalesce(ph.reason_address(one, two).isNotNull() & (one != ""), F.lit(False))
        zip_ = F.when(ph.reason_postal(a["postalCode"]).isNull(), text.postal(a["postalCode"]))
        return F.when(~bad, F.struct(a["use"].alias("use"), a["type"].alias("type"), F.transform(lines, text.standard_street).alias("line"), F.lower(a["city"]).alias("city"), F.lower(a["state"]).alias("state"), zip_.alias("postalCode"), a["country"].alias("country")))

    def known(i):
        last4 = _last4(i["value"])
        reason = F.when(i["system"] == SSN, F.coalesce(ph.reason_ssn(i["value"]), ph.reason_last4(last4))).when(i["system"] == ITIN, ph.reason_last4(last4)).otherwise(F.coalesce(ph.reason_subscriber(i["value"]), ph.reason_general(i["value"])))
        return reason.isNull()

    dob = F.when(ph.reason_date(F.col("birthDate"), as_of).isNull() | F.col("birthDate").rlike(r"^\d{4}(-\d{2})?$"), text.birth_date(F.col("birthDate"), as_of))
    drop_null = lambda c, f: F.filter(F.transform(c, f), lambda x: x.isNotNull())
    return patients.withColumns({"birthDate": dob, "name": drop_null(F.col("name"), name), "telecom": drop_null(F.col("telecom"), contact), "address": drop_null(F.col("address"), place), "identifier": F.filter("identifier", known)})


def report(patients: DataFrame, as_of: str) -> DataFrame:
    """``id, path, raw_value, reason`` of all values that normalisation drops; places in lists count from 0."""
    found = lambda path, raw, reason: F.struct(path.alias("path"), raw.alias("raw_value"), reason.alias("reason"))
    at = lambda c, i, *more: F.concat(F.lit(c + "["), i.cast("string"), F.lit("]"), *more)
    some = lambda c: F.coalesce(F.col(c), F.array())

    def names(n, i):
        family = found(at("name", i, F.lit(".family")), n["family"], F.when(n["family"].isNotNull(), ph.reason_name(n["family"], True)))
        given = F.transform(_strings(n["given"]), lambda g, j: found(at("name", i, F.lit(".given["), j.cast("string"), F.lit("]")), g, ph.reason_name(g, True)))
        return F.concat(F.array(family), given)

    def places(a, i):
        lines = _strings(a["line"])
        street = found(at("address", i, F.lit(".line[0]")), F.try_element_at(lines, F.lit(1)), F.when(F.size(lines) > 0, ph.reason_address(F.try_element_at(lines, F.lit(1)), F.try_element_at(lines, F.lit(2)))))
        return F.array(street, found(at("address", i, F.lit(".postalCode")), a["postalCode"], ph.reason_postal(a["postalCode"])))

    def identifier(x, i):
        last4 = _last4(x["value"])
        reason = F.when(x["system"] == SSN, F.coalesce(ph.reason_ssn(x["value"]), ph.reason_last4(last4))).when(x["system"] == ITIN, ph.reason_last4(last4)).otherwise(F.coalesce(ph.reason_subscriber(x["value"]), ph.reason_general(x["value"])))
        return found(at("identifier", i, F.lit(".value")), x["value"], reason)

    contact = lambda t, i: found(at("telecom", i, F.lit(".value")), t["value"], F.when(t["system"] == "phone", ph.reason_phone(t["value"])).when(t["system"] == "email", ph.reason_email(t["value"])))
    day = found(F.lit("birthDate"), F.col("birthDate"), F.when(F.col("birthDate").isNotNull() & ~F.col("birthDate").rlike(r"^\d{4}(-\d{2})?$"), ph.reason_date(F.col("birthDate"), as_of)))
    rows = F.concat(F.array(day), F.flatten(F.transform(some("name"), names)), F.transform(some("telecom"), contact), F.flatten(F.transform(some("address"), places)), F.transform(some("identifier"), identifier))
    return patients.select("id", F.explode(F.filter(rows, lambda r: r["reason"].isNotNull())).alias("r")).select("id", "r.*")


def _last4(c: Column) -> Column:
    """The last four characters of a number without its hyphens and spaces; shorter ones as they are."""
    bare = F.regexp_replace(c, "[- ]", "")
    return F.when(F.length(bare) > 4, F.substring(bare, -4, 4)).otherwise(bare)


def extracted(patients: DataFrame) -> DataFrame:
    """``patient_id`` and the 21 sets of match fields."""
    names, telecom, address, ids, ext = (F.coalesce(F.col(c), F.array()) for c in ("name", "telecom", "address", "identifier", "extension"))
    given = F.flatten(F.transform(names, lambda n: _strings(n["given"])))
    nick = F.flatten(F.transform(names, lambda n: text.nicknames(F.try_element_at(_strings(n["given"]), F.lit(1)))))
    has = lambda i, *codes: F.exists(F.coalesce(i["type"]["coding"], F.array()), lambda c: c["code"].isin(*codes))
    scoped = lambda i: F.coalesce(i["system"], F.lit("")) != ""
    full = lambda i: F.when(scoped(i), F.concat_ws("|", i["system"], i["value"]))
    coded = (("DL", "legal_ids"), ("MB", "insurance_member_ids"), ("SN", "insurance_subscriber_ids"), (GUARDIAN, "guardian_identities"), (MOTHER, "mother_identities"), (BIRTH, "birth_encounter_ids"))

    def kind(i):
        out = F.when(i["system"] == SSN, "ssn_last4").when(i["system"] == ITIN, "itin_last4").when(i["system"] == MBI, "mbi")
        for code, name in coded:
            out = out.when(has(i, code), name)
        return out.otherwise("namespace_ids")

    def value(i):
        four, k = _last4(i["value"]), kind(i)
        legal = F.when(F.coalesce(i["assigner"]["display"], F.lit("")) != "", F.concat_ws("|", i["assigner"]["display"], i["value"])).otherwise(i["value"])
        made = F.when(k.isin("ssn_last4", "itin_last4"), F.when(F.length(four) == 4, four)).when(k == "mbi", i["value"]).when(k == "legal_ids", legal)
        return F.when(F.coalesce(i["value"], F.lit("")) != "", made.when(k == "namespace_ids", F.coalesce(full(i), F.when(has(i, *NAMESPACE), i["value"]))).otherwise(full(i)))

    of = lambda f: F.transform(F.filter(ids, lambda i: kind(i) == f), value)
    part = lambda e, url: F.try_element_at(F.transform(F.filter(e["extension"], lambda x: x["url"] == url), lambda x: x["valueCode"]), F.lit(1))
    linked = F.filter(ext, lambda e: e["url"].endswith("relationship-linkage"))
    links = lambda source: F.transform(F.filter(linked, lambda e: part(e, "source") == source), lambda e: part(e, "type"))
    street = lambda a: F.when(text.zip5(a["postalCode"]) != "", F.concat(text.line_one(_strings(a["line"])), F.lit("|"), text.zip5(a["postalCode"])))
    made = {
        "first_names": F.concat(given, nick),
        "last_names": F.transform(names, lambda n: n["family"]),
        "middle_names": F.flatten(F.transform(names, lambda n: F.slice(_strings(n["given"]), 2, F.greatest(F.size(_strings(n["given"])), F.lit(1))))),
        "suffixes": F.flatten(F.transform(names, lambda n: text.generational(F.flatten(F.transform(_strings(n["suffix"]), text.suffix_tokens))))),
        "dob": F.array("birthDate"),
        "phones": F.transform(F.filter(telecom, lambda t: t["system"] == "phone"), lambda t: t["value"]),
        "emails": F.transform(F.filter(telecom, lambda t: t["system"] == "email"), lambda t: t["value"]),
        "zip_codes": F.transform(address, lambda a: text.zip5(a["postalCode"])),
        "street_lines": F.transform(address, street),
        "relationship_linkage_clinical": links("clinical"),
        "relationship_linkage_self_reported": links("self-reported"),
    }
    return patients.select(F.col("id").alias("patient_id"), *[_set(made[f] if f in made else of(f)).alias(f) for f in FIELDS])


def index_rows(fields: DataFrame) -> DataFrame:
    """``patient_id, field_name, value``, one row for each value."""
    named = lambda f: F.transform(F.col(f), lambda v: F.struct(F.lit(f).alias("field_name"), v.alias("value")))
    entries = F.flatten(F.array(*[named(f) for f in FIELDS]))
    return fields.select("patient_id", F.explode(entries).alias("e")).select("patient_id", "e.field_name", "e.value")


def from_index(rows: DataFrame) -> DataFrame:
    return rows.groupBy("patient_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("field_name") == f, F.col("value")))).alias(f) for f in FIELDS])


def lookup(rows: DataFrame, field: str, value: str) -> DataFrame:
    return rows.where((F.col("field_name") == field) & (F.col("value") == value)).select("patient_id").distinct()


#: Fields of which a patient must have one to be worth an index entry.
MATCHABLE = ("first_names", "last_names", "dob", "phones", "emails", "ssn_last4", "itin_last4", "mbi", "legal_ids", "namespace_ids")


def matchable(fields: DataFrame) -> DataFrame:
    """Patients with a value in some matchable field."""
    some = F.lit(False)
    for f in MATCHABLE:
        some = some | (F.size(f) > 0)
    return fields.where(some)


def index_counts(rows: DataFrame) -> DataFrame:
    """How many patients and values each field of the index has."""
    return rows.groupBy("field_name").agg(F.countDistinct("patient_id").alias("n_patients"), F.count("*").alias("n_values"))
