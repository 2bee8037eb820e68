"""Readers for the formats that records arrive in; schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.fields import PATIENT


def patients(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PATIENT).json(path)


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """Patients out of bundle pages."""
    pages = spark.read.option("multiLine", True).schema(f"entry array<struct<resource:struct<{', '.join(c.replace(' ', ':', 1) for c in _split(PATIENT))}>>>").json(path)
    return pages.select(F.explode("entry.resource").alias("r")).select("r.*").where("resourceType = 'Patient'")


def _split(schema: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    struct = ", ".join(c.replace(" ", ":", 1) for c in _split(PATIENT))
    return spark.read.schema(f"case_id string, source struct<{struct}>, target struct<{struct}>, expected_match boolean, rationale string").json(path)


def facilities(spark: SparkSession, path: str) -> DataFrame:
    """State lists: all cells as text, the byte-order mark and compression handled."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def positional(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Tables without a header: the fifth column, else the fourth, is the street; active rows only."""
    df = spark.read.schema(", ".join(f"c{i} string" for i in range(width))).option("encoding", "ISO-8859-1").csv(path)
    return df.where(F.col(f"c{width - 1}") == "ACTIVE").withColumn("street", F.coalesce(F.nullif(F.col("c5"), F.lit("")), F.col("c4")))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", True).option("primitivesAsString", True).schema(schema).json(path)


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of lists, whose first one holds the names; ``row`` maps name to value."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("m"))
    return whole.select(F.explode(F.expr("slice(m, 2, greatest(size(m) - 1, 0))")).alias("r"), F.element_at("m", 1).alias("h")).select(F.map_from_arrays("h", "r").alias("row"))


def pages(spark: SparkSession, fetch, start: str, max_pages: int = 0) -> DataFrame:
    """Patients from a paged service: ``fetch`` gives the JSON text of an address; each page names the next one. Pages follow one another, so they are fetched in turn, and parsed on the executors."""
    texts, at, seen = [], start, set()
    while at and at not in seen and not (max_pages and len(texts) >= max_pages):
        seen.add(at)
        texts.append(fetch(at))
        import json

        at = next((x.get("url") for x in json.loads(texts[-1]).get("link", []) if x.get("relation") == "next"), None)
    struct = ", ".join(c.replace(" ", ":", 1) for c in _split(PATIENT))
    parsed = spark.createDataFrame([(t,) for t in texts], "page string").select(F.from_json("page", f"entry array<struct<resource:struct<{struct}>>>").alias("p"))
    return parsed.select(F.explode("p.entry.resource").alias("r")).select("r.*").where("resourceType = 'Patient'")


def point(patients: DataFrame, patient_id: str) -> DataFrame:
    return patients.where(F.col("id") == patient_id)


def _in_files(spark: SparkSession, path: str, f, schema: str) -> DataFrame:
    """Rows that ``f`` makes of each file's bytes, on the executors, one file at a time."""
    import pandas as pd

    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames):
        for frame in frames:
            for content in frame["content"]:
                rows = list(f(content))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def zip_member_csv(spark: SparkSession, path: str, member: str) -> DataFrame:
    """``row``: name to value, of a CSV file with a header inside a zip archive."""

    def rows(content):
        import csv
        import io
        import zipfile

        with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
            for r in csv.DictReader(io.TextIOWrapper(f, "utf-8-sig")):
                yield ({k: v for k, v in r.items() if k},)

    return _in_files(spark, path, rows, "row map<string,string>")


def excel(spark: SparkSession, path: str, sheet: int = 1, header: int = 1) -> DataFrame:
    """``row``: name to text, of a sheet of a workbook, names from row ``header``; a workbook is a zip archive of XML."""

    def rows(content):
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in s.iter(space + "t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(space + "si")]
            names: dict[str, str] = {}
            for r in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(space + "row"):
                cells = {}
                for c in r.iter(space + "c"):
                    v = c.find(space + "v")
                    text = "".join(t.text or "" for t in c.iter(space + "t")) if c.get("t") == "inlineStr" else (v.text if v is not None else None)
                    column = re.match("[A-Z]+", c.get("r", "A"))[0]
                    cells[column] = shared[int(text)] if c.get("t") == "s" and text is not None else text
                at = int(r.get("r", "0"))
                if at == header:
                    names = {k: v for k, v in cells.items() if v}
                elif at > header:
                    yield ({name: cells.get(k) for k, name in names.items()},)

    return _in_files(spark, path, rows, "row map<string,string>")


def places(spark: SparkSession, path: str, country: str, categories: list[str]) -> DataFrame:
    """Flat rows of nested places in Parquet; country and category are filtered in the scan's own stage and only the parts that are used are read."""
    schema = "id string, names struct<primary:string>, categories struct<primary:string>, addresses array<struct<freeform:string,locality:string,region:string,postcode:string,country:string>>"
    df = spark.read.schema(schema).parquet(path)
    first = F.try_element_at("addresses", F.lit(1))
    own = df.where(F.col("categories.primary").isin(*categories)).select("id", F.col("names.primary").alias("name"), F.col("categories.primary").alias("category"), first.alias("a"))
    return own.where(F.col("a.country") == country).select("id", "name", "category", F.col("a.freeform").alias("street"), F.col("a.locality").alias("city"), F.col("a.region").alias("state"), F.col("a.postcode").alias("zip"))


def manifest_status(spark: SparkSession, path: str) -> DataFrame:
    """``file, downloaded, ok`` of a manifest that maps file names to their state."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<downloaded:string, ok:boolean>>").alias("m"))
    return whole.select(F.explode("m").alias("file", "s")).select("file", "s.downloaded", F.coalesce("s.ok", F.lit(False)).alias("ok"))
