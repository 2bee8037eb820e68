"""Records from files to the index and back, the service, and known answers of levers and chances."""

import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from matchloom.functions import text
from matchloom.operators import fields, levers, matching, reports, search, uprob
from matchloom.operators.rules import HOUSEHOLD_RULES, RULES
from matchloom.sources import people, readers
from matchloom.streaming import index

AS_OF = "2026-06-01"


def patient(i, **more):
    own = {"resourceType": "Patient", "id": i, "name": [{"family": "Alvarez", "given": ["Maria"]}], "birthDate": "1985-03-14", "telecom": [{"system": "phone", "value": "415-867-5309"}], "identifier": [{"system": "urn:x", "value": i}]}
    return own | more


def test_unit_lines(spark):
    lines = ["3rd fl", "rear 2", "ofc 3", "3rd floor west", "apt 12b-4", "#4b", "12 floor ave", "1 main st", ""]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, v string")
    assert [r.x for r in rows.select("i", text.unit_only(F.col("v")).alias("x")).orderBy("i").collect()] == [True] * 6 + [False] * 3
    streets = {"1128 E WINONA AVENUE SUITE B1 -": "1128 E WINONA AVENUE", "42840 CHRISTY ST, SUITE 102 -": "42840 CHRISTY ST", "1 A ST SUITE 760 B": "1 A ST", "1 A ST #130 REAR": "1 A ST", "1282 FL-78": "1282 FL-78", "100 Veterans Building Rd": "100 Veterans Building Rd", "3349 BLDG A WHITING AVENUE": "3349 BLDG A WHITING AVENUE", "9 ELM ST PH 3": "9 ELM ST PH 3"}
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(streets)], "i int, v string")
    assert [r.x for r in rows.select("i", text.strip_unit(F.col("v")).alias("x")).orderBy("i").collect()] == list(streets.values())
    assert spark.range(1).select(text.zip5(F.lit(" 10001 "))).first()[0] == "10001"


def test_readers(spark, tmp_path):
    pages = {"a": {"entry": [{"resource": patient("1")}, {"resource": {"resourceType": "Device", "id": "d"}}], "link": [{"relation": "next", "url": "b"}]}, "b": {"entry": [{"resource": patient("2")}]}}
    got = readers.pages(spark, lambda u: json.dumps(pages[u]), "a")
    assert {r.id for r in got.collect()} == {"1", "2"} and readers.pages(spark, lambda u: json.dumps(pages[u]), "a", 1).count() == 1
    assert readers.point(got, "2").count() == 1
    (tmp_path / "bundle.json").write_text(json.dumps(pages["a"]))
    assert [r.id for r in readers.bundle(spark, str(tmp_path / "bundle.json")).collect()] == ["1"]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("names.csv", "name,count\nSMITH,5\nJONES,3\n")
    assert [r.row["name"] for r in readers.zip_member_csv(spark, str(tmp_path / "x.zip"), "names.csv").collect()] == ["SMITH", "JONES"]
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>name</t></si><si><t>Ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c></row></sheetData></worksheet>')
    assert [r.row for r in readers.excel(spark, str(tmp_path / "x.xlsx")).collect()] == [{"name": "Ann", "n": "7"}]
    (tmp_path / "m.json").write_text('{"a.csv": {"downloaded": "2026-01-01", "ok": true}, "b.csv": {}}')
    assert {(r.file, r.ok) for r in readers.manifest_status(spark, str(tmp_path / "m.json")).collect()} == {("a.csv", True), ("b.csv", False)}
    (tmp_path / "matrix.json").write_text('[["zip", "n"], ["10001", "5"], ["10002", "6"]]')
    assert [r.row["n"] for r in readers.matrix(spark, str(tmp_path / "matrix.json")).collect()] == ["5", "6"]
    (tmp_path / "list.csv").write_text("﻿name,zip\nA,01234\n")
    assert readers.facilities(spark, str(tmp_path / "list.csv")).collect()[0].zip == "01234"
    pairs = {"case_id": "1", "source": patient("1"), "target": patient("2"), "expected_match": True, "rationale": "typo/x"}
    (tmp_path / "pairs.jsonl").write_text(json.dumps(pairs) + "\n")
    assert readers.labelled_pairs(spark, str(tmp_path / "pairs.jsonl")).select("target.id", "expected_match").first() == ("2", True)
    spark.sql("select 'p' as id, named_struct('primary', 'Clinic') as names, named_struct('primary', 'hospital') as categories, array(named_struct('freeform', '1 A St', 'locality', 'Reno', 'region', 'NV', 'postcode', '10001', 'country', 'US')) as addresses").write.parquet(str(tmp_path / "places"))
    assert readers.places(spark, str(tmp_path / "places"), "US", ["hospital"]).first().street == "1 A St" and readers.places(spark, str(tmp_path / "places"), "DE", ["hospital"]).count() == 0


def test_index_of_batches_and_streams(spark, tmp_path):
    path, inbox = str(tmp_path / "index"), tmp_path / "in"
    inbox.mkdir()

    def put(name, *rows):
        (inbox / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        index.refresh_stream(spark, str(inbox), path, str(tmp_path / "check"), AS_OF).awaitTermination()

    put("1.json", patient("a"), patient("b"), patient("b", birthDate="1990-01-01", meta={"lastUpdated": "2026-02-01"}))
    assert index.count(spark, path) == 2
    assert index.get(spark, path, "b").where("field_name = 'dob'").first().value == "1990-01-01"
    empty = {"resourceType": "Patient", "id": "a"}
    put("2.json", empty, patient("c"))
    assert index.count(spark, path) == 2 and index.get(spark, path, "a").count() == 0 and index.get(spark, path, "c").count() > 0
    version = index.manifest(spark, path)["version"]
    batch = index.manifest(spark, path)["batch"]
    records = spark.read.schema(index.VERSIONED).json(str(inbox / "2.json"))
    assert index.refresh(spark, path, records, AS_OF, batch) == version  # a retried batch
    assert index.refresh(spark, path, records, AS_OF, "other:0") == version + 1 and index.count(spark, path) == 2
    index.clear(spark, path)
    assert index.count(spark, path) == 0


def test_service(spark, tmp_path):
    rows = [patient("q"), patient("near", birthDate="1985-03-15", identifier=[]), patient("other", name=[{"family": "Nguyen", "given": ["Kim"]}], telecom=[], identifier=[{"system": "urn:x", "value": "z"}]), {"resourceType": "Patient", "id": "none"}]
    (tmp_path / "p.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    records = readers.patients(spark, str(tmp_path / "p.json"))
    result, audit = matching.service(records, records, AS_OF)
    got = {r.query_id: r for r in result.collect()}
    assert got["q"].outcome == "match" and [m.patient_id for m in got["q"].matches] == ["near"] and got["none"].outcome == "insufficient_fields" and got["other"].outcome == "no_match"
    rows = audit.collect()
    assert {r.query_id for r in rows if r.candidates_retrieved == 0} == {"other", "none"}
    won = [r for r in rows if r.query_id == "q" and r.matched]
    assert won and all(r.match_type == "fuzzy" and r.fuzzy_fields == ["dob"] for r in won)
    only = matching.service(records, records, AS_OF, rules=RULES[:1], household_rules=())[0]
    assert {r.outcome for r in only.collect()} <= {"no_match", "insufficient_fields"}


def test_all_rules_can_hold(spark):
    """A pair that agrees on everything fulfils each rule."""
    one = {f: ["v"] for f in people.FIELDS} | {"dob": ["1990-01-01"], "street_lines": ["1 main st|10001"], "relationship_linkage_clinical": ["child-of", "newborn-of"]}
    df = spark.createDataFrame([tuple([i] + [one[f] for f in people.FIELDS]) for i in ("a", "b")], "patient_id string, " + ", ".join(f"{f} array<string>" for f in people.FIELDS))
    both = matching.pairs(df, df)
    assert {r.rule_id for r in matching.evaluate_flat(both).where("query_id = 'a'").collect()} == {r.rule_id for r in RULES}
    assert {r.rule_id for r in matching.evaluate_households(both).where("query_id = 'a'").collect()} == {r.rule_id for r in HOUSEHOLD_RULES}
    twin = df.withColumn("first_names", F.array(F.lit("x")))
    assert not matching.evaluate_flat(matching.compared(spark.createDataFrame([("a", "b")], "query_id string, patient_id string"), df, twin)).where("array_contains(map_values(outcomes), 'no_match')").count()


def _crowd(spark, n):
    """People with several values a field, few different ones, and odd dates."""
    rnd = random.Random(7)
    pools = {f: [f"{f}{i}" for i in range(3)] for f in people.FIELDS}
    pools |= {"first_names": ["robert", "robret", "maria", "ann"], "last_names": ["nguyen", "nguyne", "smith"], "dob": ["1990-01-01", "1989-12-31", "1990-01-03", "1990-01", "x"], "suffixes": ["jr", "sr"]}
    pools |= {"street_lines": ["1 main st|10001", "2 main st|10001", "1 main st|10002"], "relationship_linkage_clinical": ["child-of", "newborn-of"]}
    some = lambda f: sorted(rnd.sample(pools[f], rnd.choices((0, 1, 2), (2, 6, 1))[0] if f != "suffixes" else rnd.randint(0, 1)))
    return spark.createDataFrame([tuple([f"{i}"] + [some(f) for f in people.FIELDS]) for i in range(n)], "patient_id string, " + ", ".join(f"{f} array<string>" for f in people.FIELDS))


@pytest.mark.parametrize("rules", [RULES + HOUSEHOLD_RULES, RULES, RULES[:1], RULES[3:5], HOUSEHOLD_RULES])
def test_decided_as_by_masks(spark, rules):
    """Joins by all exact fields find what comparing the wider candidates finds, with several values and odd dates too."""
    crowd = _crowd(spark, 120)
    want = {(r[0], r[1]) for r in matching.any_rule(matching.pairs(crowd, crowd, rules), rules).where("matched").collect()}
    got = [(r[0], r[1]) for r in matching.decided(crowd, crowd, rules).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_match_as_by_masks(spark):
    """Matches by keys are those by comparing all of the wider candidates, twins and several dates of birth included; people are never joined as a whole."""
    crowd = _crowd(spark, 90)
    both = matching.pairs(crowd, crowd)
    found, lost = {}, set()
    for r in [*matching.evaluate_flat(both).collect(), *matching.evaluate_households(both).collect()]:
        if not r.negated_by_suffix:
            found.setdefault((r.query_id, r.patient_id), []).append((r.position, r.rule_id, r.match_type))
            lost |= {(r.query_id, r.patient_id)} if "excluded" in r and r.excluded else set()
    want = {(*pair, *min(rows)[1:]) for pair, rows in found.items() if pair not in lost}
    out = matching.match(crowd, crowd)
    rows = out.collect()
    assert {(r.query_id, m.patient_id, m.rule_id, m.match_type) for r in rows for m in r.matches} == want and any(r.n_matches > 2 for r in rows)
    assert len(rows) == 90 and all(r.n_matches == len(r.matches) for r in rows)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3  # flat rules, households, all queries


def test_crowds_without_pairs(spark):
    """People who share two fields of a rule, but not its date of birth, are not joined."""
    empty = {f: F.array().cast("array<string>") for f in people.FIELDS}
    day = F.date_format(F.date_add(F.lit("1950-01-01"), (F.col("id") * 5).cast("int")), "yyyy-MM-dd")
    crowd = spark.range(300).select(F.col("id").cast("string").alias("patient_id"), *[c.alias(f) for f, c in (empty | {"first_names": F.array(F.lit("maria")), "last_names": F.array(F.lit("smith")), "phones": F.array(F.lit("+1")), "zip_codes": F.array(F.lit("10001")), "dob": F.array(day)}).items()])
    groups = matching.key_groups(RULES + HOUSEHOLD_RULES)
    met = matching.keyed(crowd, True, groups).join(matching.keyed(crowd, False, groups).withColumnRenamed("patient_id", "other"), ["h", "i"]).where("patient_id <> other")
    assert met.count() == 0 and matching.decided(crowd, crowd).count() == 0


@pytest.mark.parametrize("name", ["evaluate_pair_any", "evaluate_pair_flat"])
def test_pairs_are_joined_by_all_exact_fields(spark, name):
    """No pair is compared as a whole: the plan has one join of keys, and none of people."""
    plan = __import__("__spark_entry__").queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_levers(spark):
    p = {(r.lever, r.rule_id, r.basis): r for r in levers.feasibility(spark).collect()}
    base = p["initial_all", "02", "scaled_conservative"].p
    assert math.isclose(base, 2e-14 * 0.0671673866353513 / 0.001792560882279055, rel_tol=1e-6)
    assert not p["dob_dl1_all", "11", "scaled_conservative"].feasible and ("dob_dl1_fuzzy", "11", "empirical") not in p and ("initial_c2", "02", "empirical") not in p and ("initial_c2", "C2-13", "empirical") in p
    chosen = {(r.combo, r.rule_id, r.basis): r.levers for r in levers.assignment(spark).collect()}
    assert chosen["dob_dl1_all + initial_all", "02", "scaled_conservative"] == "dob_dl1_all"


def test_chances(spark):
    counts = spark.createDataFrame([(25,)] * 4, "n int")
    r = uprob.from_counts(counts).first()
    assert math.isclose(r.u_simple, 0.25) and math.isclose(r.u_unbiased, 4 * 25 * 24 / (100 * 99))
    one = spark.createDataFrame([(2000, 100)], "year int, n int")
    u = [uprob.dob_u(one, v).first().u for v in ("exact", "pm1day", "swap", "dl1")]
    assert math.isclose(u[0], 1 / 366) and u == sorted(u) and len(set(u)) == 4
    ages = spark.createDataFrame([(0, 0, 5), (0, 1, 5), (0, 999, 10), (1, 0, 3)], "SEX int, AGE int, POPESTIMATE2025 int")
    assert {(r.year, r.n) for r in uprob.year_of_birth(ages).collect()} == {(2025, 5), (2024, 5)}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([('{"a": "", "b": {"c": " "}, "d": [1, ""]}',), ("no json",), (None,)], "j string")
    assert [r.x for r in df.select(reports.without_empty(F.col("j")).alias("x")).collect()] == ['{"d": [1]}', None, None]
    assert reports.identifier("a.b", dotted=True) == "a.b" and reports.literal("o'x") == "'o''x'"
    with pytest.raises(ValueError):
        reports.identifier("a b")
    table = spark.createDataFrame([("x", 0.5)], "k string, v double")
    assert reports.markdown(table).splitlines()[2] == "| x | 0.5 |" and json.loads(reports.metrics_json(table)) == {"k": "x", "v": 0.5}
    reports.write_csv(table, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_search_settings(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"search": {"algorithm": "jaro", "threshold": "0.8"}}')
    assert search.config_of_file(str(tmp_path / "s.json")).algorithm == "jaro"
    assert search.config_of_environment({"SEARCH_LIMIT": "3", "X": "1"}).limit == 3
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["smith", "smyth", "smithe", "jones"])], "id int, name string")
    assert [r.value for r in search.search(names, "smith", "name", "id", search.SearchConfig(algorithm="damerau_levenshtein", max_distance=1)).collect()] == ["smith", "smithe", "smyth"]
    assert set(search.timed(names, "smith", "name", "id", ["levenshtein", "jaro"])) == {"levenshtein", "jaro"}
    assert search.recommended({"algorithm": "jaro"}) == "scan" and search.recommended({"realtime": True, "existing_infrastructure": "key_value"}) == "key_value"
