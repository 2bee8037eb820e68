"""Known answers of single operators, and all queries with SQL against DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from matchloom.functions import placeholders as ph, similarity as sim, text
from matchloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def ask(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_zip5(spark):
    assert ask(spark, ["10001", "10001-1234", "100011234", "10001 1234", None, "", "1000", "ab10001", "10001-12"], text.zip5) == ["10001"] * 4 + [""] * 5


def test_unit_only(spark):
    lines = ["apt 2", "unit 5b", "ste 100", "rm 114", "fl 3", "bldg c", "4b", "unit 5 b", "apt 4 b", "ph 3", "bsmt a", "floor rd", "unit dr", "lot ln", "unity", "building", "suites"]
    assert ask(spark, lines, text.unit_only) == [True] * 11 + [False] * 6


def test_strip_unit(spark):
    pairs = {"7920 BELT LINE ROAD SUITE 760": "7920 BELT LINE ROAD", "103 W ALAMEDA AVE #130": "103 W ALAMEDA AVE", "#16 WILSON FARM ROAD": "#16 WILSON FARM ROAD", "77 Ste Marie St": "77 Ste Marie St", "12 Floor Ave": "12 Floor Ave", "500 MAIN ST BLDG 2": "500 MAIN ST"}
    assert ask(spark, list(pairs), text.strip_unit) == list(pairs.values())


def test_placeholders(spark):
    absent = lambda f, *v: all(x is not None for x in ask(spark, v, f))
    kept = lambda f, *v: all(x is None for x in ask(spark, v, f))
    date = lambda c: ph.reason_date(c, "2025-06-01")
    assert absent(date, "1900-01-01", "1901-01-01", "1800-01-01", "2000-01-01", "1111-11-11", "0001-01-01", "2099-01-01") and kept(date, "1985-03-14", "2000-01-02", "1999-12-31", "2001-01-01")
    assert absent(ph.reason_last4, "0000", "9999", "1234", "5555") and kept(ph.reason_last4, "6789", "4321", "1212")
    assert absent(ph.reason_phone, "000-000-0000", "555-555-5555", "111-111-1111", "123-456-7890", "415-555-0134", "(310) 555-9999", "+1 212 555 1212") and kept(ph.reason_phone, "415-867-5309", "555-867-5309")
    assert absent(ph.reason_email, "test@test.com", "noreply@acme.org", "unknown@unknown.com", "none@none.com", "maria@example.com") and kept(ph.reason_email, "maria.alvarez@gmail.com")
    assert absent(ph.reason_address, "123 Main St", "PO Box 0", "Unknown", "Homeless", "No Fixed Address") and kept(lambda c: ph.reason_address(c, F.lit("Apt 4")), "123 Main St")


def test_phone(spark):
    assert ask(spark, ["415-867-5309", "+1 212 556 1212"], text.e164) == ["+14158675309", "+12125561212"]


def test_fuzzy(spark):
    rows = [(["smith"], ["smtih"], True), (["smith"], ["smiths"], True), (["james"], ["janes"], True), (["bob", "robert"], ["robret", "alice"], True), (["smith"], ["snack"], False), (["jon"], ["john"], False), (["ann"], ["anne"], False), ([], [], False)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, want boolean")
    assert df.where(sim.fuzzy(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_dob(spark):
    rows = [("1990-01-15", "1990-01-14", True), ("1990-01-15", "1990-01-17", False), ("1990-02-01", "1990-01-31", True), ("1990-01-01", "1989-12-31", True), ("not-a-date", "1990-01-15", False), ("1990-01", "1990-01-15", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.where(sim.dob_near(F.array("a"), F.array("b")) != F.col("want")).count() == 0


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = catalogue.QUERIES[name](spark, SF)
    made = con.execute(catalogue.SQL[name])
    names = [c[0] for c in made.description]
    plain = lambda rows: sorted(repr(tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r)) for r in rows)
    assert sorted(df.columns) == sorted(names)
    assert plain(tuple(r[c] for c in names) for r in df.collect()) == plain(made.fetchall())
