"""All queries over the driver's tables, each over whole tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import placeholders as ph, similarity as sim, text
from ..operators import blocking, evaluation, fields, matching, registry, search, uprob
from ..operators.rules import HOUSEHOLD_RULES, RULES, U, catalogue as rule_table, p_collision
from ..sources.people import FIELDS, PEOPLE, as_fields, flat_people
from ..streaming.index import merged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _people(spark: SparkSession, d: str) -> DataFrame:
    return as_fields(flat_people(spark, d))


# ---------------------------------------------------------------- matching

_FLAT = {"first_name": "first_name", "last_name": "last_name", "dob": "dob", "street_line": "street", "phone": "phone", "email": "email", "ssn_last4": "ssn4", "mbi": "mbi", "legal_id": "legal_id", "namespace_id": "namespace_id", "zip_code": "zip", "insurance_member_id": "member_id", "insurance_subscriber_id": "subscriber_id"}
_DL1 = "(length({a}) >= 5 AND length({b}) >= 5 AND damerau_levenshtein({a}, {b}) <= 1)"
_VETO = "(q.suffix IS NOT NULL AND c.suffix IS NOT NULL AND q.suffix <> c.suffix)"


def _near(name: str) -> str:
    q, c = f"q.{_FLAT[name]}", f"c.{_FLAT[name]}"
    if name == "dob":
        return f"abs(date_diff('day', CAST({q} AS DATE), CAST({c} AS DATE))) <= 1"
    if name == "street_line":
        return f"(split_part({q}, '|', 2) = split_part({c}, '|', 2) AND " + _DL1.format(a=f"split_part({q}, '|', 1)", b=f"split_part({c}, '|', 1)") + ")"
    return _DL1.format(a=q, b=c)


def _conditions(rule, first_exact: str = "FALSE") -> tuple[list[str], str]:
    """Join conditions of a rule, and whether a tolerance was used."""
    where, used, any_loose = [], [], []
    for name in rule.fields:
        q, c = f"q.{_FLAT[name]}", f"c.{_FLAT[name]}"
        if name in rule.loose:
            near = _near(name) if name != "first_name" else f"({_near(name)} AND NOT {first_exact})"
            where.append(f"({q} = {c} OR {near})")
            any_loose.append(f"{q} <> {c}")
            if name != "dob":
                used.append(f"CASE WHEN {q} <> {c} THEN 1 ELSE 0 END")
        else:
            where.append(f"{q} = {c}")
    if used:
        where.append(f"{' + '.join(used)} <= {rule.most}")
    return where, "(" + " OR ".join(any_loose or ["FALSE"]) + ")"


def _flat_sql() -> str:
    parts = []
    for i, r in enumerate(RULES):
        if not all(f in _FLAT for f in r.fields):
            continue
        where, loose = _conditions(r)
        parts.append(f"SELECT CAST(q.pid AS VARCHAR) AS query_id, CAST(c.pid AS VARCHAR) AS patient_id, '{r.rule_id}' AS rule_id, {i} AS position, CASE WHEN {loose} THEN 'fuzzy' ELSE 'exact' END AS match_type, {_VETO} AS negated_by_suffix FROM people q JOIN people c ON q.pid <> c.pid AND " + ("q.zip = c.zip AND " if r.rule_id == "01" else "") + " AND ".join(where))
    return " UNION ALL ".join(parts)


def _house_sql() -> str:
    parts = []
    for i, r in enumerate(HOUSEHOLD_RULES):
        if not all(f in _FLAT for f in r.household + r.fields):
            continue
        house = " AND ".join(f"q.{_FLAT[f]} = c.{_FLAT[f]}" for f in r.household)
        where, loose = _conditions(r, "(count(*) OVER (PARTITION BY q.pid, c.dob) > 1)")
        parts.append(f"SELECT * FROM (SELECT CAST(q.pid AS VARCHAR) AS query_id, CAST(c.pid AS VARCHAR) AS patient_id, '{r.rule_id}' AS rule_id, {len(RULES) + i} AS position, CASE WHEN {loose} THEN 'fuzzy' ELSE 'exact' END AS match_type, {_VETO} AS negated_by_suffix, count(*) OVER (PARTITION BY q.pid, c.dob) > 1 AS shared_dob, ({' AND '.join(where)}) AS ok, q.namespace_id IS NOT NULL AS q_id, coalesce(q.namespace_id = c.namespace_id, FALSE) AS same_id, q.middle_name IS NOT NULL AS q_mid, c.middle_name IS NOT NULL AS has_mid, coalesce(q.middle_name = c.middle_name, FALSE) AS same_mid FROM people q JOIN people c ON q.pid <> c.pid AND {house} WHERE q.first_name IS NOT NULL AND q.dob IS NOT NULL) x WHERE ok")
    live = "OVER (PARTITION BY query_id, rule_id)"
    n = lambda c: f"sum(CASE WHEN NOT negated_by_suffix AND {c} THEN 1 ELSE 0 END) {live}"
    return f"""SELECT query_id, patient_id, rule_id, position, match_type, negated_by_suffix, shared_dob,
  (t = 2 AND s > 0 AND NOT negated_by_suffix AND ((q_id AND a = 1 AND NOT same_id) OR (NOT q_id AND q_mid AND m = 2 AND b = 1 AND NOT same_mid))) AS excluded
FROM (SELECT *, {n('TRUE')} AS t, {n('shared_dob')} AS s, {n('same_id')} AS a, {n('has_mid')} AS m, {n('same_mid')} AS b FROM ({" UNION ALL ".join(parts)}) u) w"""


_FOUND = f"""people AS ({PEOPLE}), flat AS ({_flat_sql()}), house AS ({_house_sql()}),
found AS (SELECT query_id, patient_id, rule_id, position, match_type, negated_by_suffix, FALSE AS excluded FROM flat UNION ALL SELECT query_id, patient_id, rule_id, position, match_type, negated_by_suffix, excluded FROM house),
own AS (SELECT query_id, patient_id, min(CASE WHEN NOT negated_by_suffix THEN position END) AS position FROM found GROUP BY 1, 2 HAVING NOT bool_or(excluded) AND bool_or(NOT negated_by_suffix)),
named AS (SELECT o.*, f.rule_id, f.match_type FROM own o JOIN found f ON f.query_id = o.query_id AND f.patient_id = o.patient_id AND f.position = o.position)"""


@query(PEOPLE)
def people_projection(spark, d):
    return flat_people(spark, d)


@query(f"WITH people AS ({PEOPLE}) {_flat_sql()}")
def match_rules(spark, d):
    """All 29 flat rules."""
    p = _people(spark, d)
    return matching.evaluate_flat(matching.pairs(p, p)).drop("outcomes")


@query(f"WITH people AS ({PEOPLE}) {_house_sql()}")
def household_rules(spark, d):
    """Two-step rules with shared dates of birth and the tie between twins."""
    p = _people(spark, d)
    return matching.evaluate_households(matching.pairs(p, p))


@query(f"WITH {_FOUND} SELECT CAST(p.pid AS VARCHAR) AS query_id, CASE WHEN count(n.patient_id) = 0 THEN 'no_match' WHEN count(n.patient_id) = 1 THEN 'match' WHEN count(n.patient_id) = 2 THEN 'escalate' ELSE 'ambiguous' END AS outcome, CAST(count(n.patient_id) AS INTEGER) AS n_matches, coalesce(string_agg(n.patient_id || ':' || n.rule_id || ':' || n.match_type, ',' ORDER BY n.patient_id), '') AS matches FROM people p LEFT JOIN named n ON n.query_id = CAST(p.pid AS VARCHAR) GROUP BY p.pid")
def match_result(spark, d):
    """Outcome of each person against all others."""
    p = _people(spark, d)
    out = matching.match(p, p)
    return out.select("query_id", "outcome", "n_matches", F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["patient_id"], m["rule_id"], m["match_type"])), ",").alias("matches"))


def _chances() -> str:
    product = lambda names, loose: " * ".join(["CAST(1 AS DOUBLE)"] + [f"CAST({(U[f][1] if f in loose and U[f][1] is not None else U[f][0])!r} AS DOUBLE)" for f in names])
    return " UNION ALL ".join(f"SELECT '{r.rule_id}' AS rule_id, '{kind}' AS match_type, {product(r.household + r.fields, loose)} AS p" for r in RULES + HOUSEHOLD_RULES for kind, loose in (("exact", ()), ("fuzzy", r.loose)))


@query(f"WITH {_FOUND}, p AS ({_chances()}), n AS (SELECT query_id, count(*) AS n, any_value(p.p) AS p FROM named JOIN p USING (rule_id, match_type) GROUP BY 1) SELECT CAST(pid AS VARCHAR) AS query_id, CASE WHEN n IS NULL THEN 'no_match' WHEN n = 1 THEN 'match' WHEN n = 2 THEN 'escalate' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN greatest(0, least(1, 1 - p)) END AS confidence FROM people LEFT JOIN n ON n.query_id = CAST(pid AS VARCHAR)")
def match_confidence(spark, d):
    p = _people(spark, d)
    return matching.match(p, p).select("query_id", "outcome", "confidence")


@query(f"WITH {_FOUND}, c2 AS (SELECT DISTINCT query_id, patient_id FROM found WHERE NOT negated_by_suffix AND position < {len(RULES)}) SELECT count(*) AS n_pairs FROM c2")
def evaluate_pair_flat_count(spark, d):
    p = _people(spark, d)
    return matching.evaluate_flat(matching.pairs(p, p)).where("not negated_by_suffix").select("query_id", "patient_id").distinct().agg(F.count("*").alias("n_pairs"))


def _any_house_sql() -> str:
    parts = []
    for r in HOUSEHOLD_RULES:
        if all(f in _FLAT for f in r.household + r.fields):
            house = [f"q.{_FLAT[f]} = c.{_FLAT[f]}" for f in r.household]
            parts.append(f"SELECT CAST(q.pid AS VARCHAR) AS query_id, CAST(c.pid AS VARCHAR) AS patient_id, {_VETO} AS negated_by_suffix FROM people q JOIN people c ON q.pid <> c.pid AND {' AND '.join(house + _conditions(r)[0])}")
    return " UNION ALL ".join(parts)


@query(f"WITH people AS ({PEOPLE}), flat AS ({_flat_sql()}), house AS ({_any_house_sql()}) SELECT DISTINCT query_id, patient_id, TRUE AS matched FROM (SELECT query_id, patient_id, negated_by_suffix FROM flat UNION ALL SELECT * FROM house) u WHERE NOT negated_by_suffix")
def evaluate_pair_any(spark, d):
    """Pairwise decision without twin logic."""
    p = _people(spark, d)
    return matching.decided(p, p).withColumn("matched", F.lit(True))


@query()
def audit_long(spark, d):
    """Outcome of each field of each rule that holds."""
    p = _people(spark, d)
    return matching.evaluate_flat(matching.pairs(p, p)).select("query_id", "patient_id", "rule_id", F.explode("outcomes").alias("field_name", "outcome"))


_PRODUCT = lambda names, loose: " * ".join(["CAST(1 AS DOUBLE)"] + [f"CAST({(U[f][1] if f in loose and U[f][1] is not None else U[f][0])!r} AS DOUBLE)" for f in names])


@query(" UNION ALL ".join(f"SELECT '{r.rule_id}' AS rule_id, {_PRODUCT(r.household + r.fields, ())} AS p_exact, {_PRODUCT(r.household + r.fields, r.loose)} AS p_loose" for r in RULES + HOUSEHOLD_RULES))
def p_collision_rules(spark, d):
    return rule_table(spark).select("rule_id", "p_exact", "p_loose")


# ---------------------------------------------------------------- similarity and joins


def _names(spark, d):
    return flat_people(spark, d).select("pid", F.concat("first_name", F.lit(" "), "last_name").alias("name"))


def _topk(algorithm: str, sql_score: str, keep: str):
    @query(f"WITH people AS ({PEOPLE}), n AS (SELECT pid, concat(first_name, ' ', last_name) AS name FROM people), s AS (SELECT pid AS id, name AS value, {sql_score} AS s FROM n WHERE {keep}) SELECT id, value, round(s, 4) AS similarity_score FROM s ORDER BY round(s, 4) DESC, id LIMIT 25")
    def run(spark, d):
        return search.search(_names(spark, d), "robert smiht", "name", "pid", search.SearchConfig(algorithm, max_distance=6, limit=25))

    QUERIES[f"{algorithm}_topk"] = QUERIES.pop("run")
    SQL[f"{algorithm}_topk"] = SQL.pop("run")


for _a, _f in (("levenshtein", "levenshtein"), ("damerau_levenshtein", "damerau_levenshtein")):
    _topk(_a, f"1 - {_f}('robert smiht', name)::DOUBLE / greatest(length(name), 12, 1)", f"{_f}('robert smiht', name) <= 6")
_topk("jaro", "jaro_similarity('robert smiht', name)", "TRUE")
_topk("jaro_winkler", "jaro_winkler_similarity('robert smiht', name)", "TRUE")


@query(f"WITH people AS ({PEOPLE}), n AS (SELECT DISTINCT concat(first_name, last_name) AS v FROM people) SELECT x.v AS a, y.v AS b FROM n x JOIN n y ON length(x.v) >= 5 AND length(y.v) >= 5 AND abs(length(x.v) - length(y.v)) <= 1 AND damerau_levenshtein(x.v, y.v) <= 1")
def dl1_self_join(spark, d):
    n = flat_people(spark, d).select(F.concat("first_name", "last_name").alias("a"))
    return blocking.fuzzy_join(n, n.withColumnRenamed("a", "b"), "a", "b")


@query(f"WITH people AS ({PEOPLE}) SELECT x.pid AS left_id, y.pid AS right_id, x.dob AS dob, y.dob AS other FROM people x JOIN people y ON CAST(y.dob AS DATE) BETWEEN CAST(x.dob AS DATE) - 1 AND CAST(x.dob AS DATE) + 1 WHERE x.pid < y.pid")
def dob_pm1_join(spark, d):
    p = flat_people(spark, d)
    return blocking.near_days_join(p.select("pid", "dob"), p.select("pid", F.col("dob").alias("other")), "dob", "other", "pid").where("left_id < right_id")


# ---------------------------------------------------------------- text and placeholders

_MAIL = "[A-Za-z0-9._-]+@[A-Za-z0-9.-]+[A-Za-z]"
_PHONE = "[(][0-9]{3}[)] [0-9]{3}-[0-9]{4}"


@query(f"""WITH e AS (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '{_MAIL}')) AS value FROM documents UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(text, '{_PHONE}')) FROM documents)
SELECT doc_id, kind, value, count(*) AS n, CASE WHEN kind = 'email' THEN CASE WHEN regexp_matches(lower(value), '^(test|noreply|no-reply|donotreply|nobody|null|none|fake)') THEN 'placeholder_prefix' WHEN regexp_matches(lower(value), '@(example\\.com|test\\.com|invalid|nowhere)$') THEN 'placeholder_domain' WHEN regexp_matches(lower(value), '^unknown@') THEN 'unknown_placeholder' END WHEN substr(value, 7, 3) = '555' THEN 'exchange_555' END AS reason FROM e GROUP BY 1, 2, 3""")
def document_contacts(spark, d):
    """E-mail addresses and phones of all documents with the reason why they cannot be compared."""
    docs = _read(spark, d, "documents")
    each = lambda kind, form: docs.select("doc_id", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(form), F.lit(0))).alias("value"))
    both = each("email", _MAIL).unionAll(each("phone", _PHONE)).groupBy("doc_id", "kind", "value").agg(F.count("*").alias("n"))
    return both.withColumn("reason", F.when(F.col("kind") == "email", ph.reason_email(F.col("value"))).otherwise(ph.reason_phone(F.col("value"))))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '[^\w\s]', '', 'g'), '\s+', '', 'g')) AS digest FROM documents")
def normalize_text(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("digest"))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'jr' WHEN 1 THEN 'iii' WHEN 2 THEN 'xii' WHEN 3 THEN 'md' WHEN 4 THEN 'ii' ELSE 'esq' END AS canonical, c_custkey % 6 IN (0, 1, 2, 4) AS is_generational FROM customer")
def suffix_canonical(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("Jnr.", "3rd", "12th", "M.D.", "2d", "Esquire")]), (F.col("c_custkey") % 6 + 1).cast("int"))
    c = _read(spark, d, "customer").select("c_custkey", raw.alias("raw"))
    return c.select("c_custkey", text.canonical_suffix(F.col("raw")).alias("canonical"), (F.size(text.generational(F.array("raw"))) > 0).alias("is_generational"))


# ---------------------------------------------------------------- chance of agreement

_U = "SELECT sum(n * n) / (sum(n) * sum(n)) AS u_simple, CASE WHEN sum(n) > 1 THEN sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) ELSE 0 END AS u_unbiased, CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_values FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM {t} GROUP BY {c}) x"


@query(_U.format(t="part", c="p_brand"))
def u_exact_brand(spark, d):
    return uprob.u_exact(_read(spark, d, "part"), "p_brand")


@query(_U.format(t="events", c="event_type"))
def u_exact_event_type(spark, d):
    return uprob.u_exact(_read(spark, d, "events"), "event_type")


@query(f"WITH people AS ({PEOPLE}) " + _U.format(t="people", c="upper(substr(first_name, 1, 1))"))
def u_first_initial(spark, d):
    return uprob.u_initial(flat_people(spark, d), "first_name")


@query(f"WITH people AS ({PEOPLE}), c AS (SELECT last_name AS v, CAST(count(*) AS DOUBLE) AS n FROM people GROUP BY 1), b AS (SELECT x.v, x.n, coalesce(sum(y.n), 0) AS ball FROM c x LEFT JOIN c y ON x.v <> y.v AND length(x.v) >= 5 AND length(y.v) >= 5 AND damerau_levenshtein(x.v, y.v) <= 1 GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c) SELECT sum(n * (n + ball)) / max(t * t) AS u_simple, sum(n * (n - 1 + ball)) / max(t * (t - 1)) AS u_unbiased FROM b, t")
def u_fuzzy_ball(spark, d):
    return uprob.u_fuzzy(flat_people(spark, d), "last_name")


def _years(spark, d):
    return flat_people(spark, d).groupBy(F.substring("dob", 1, 4).cast("int").alias("year")).agg(F.count("*").alias("n"))


_DAYS = f"people AS ({PEOPLE}), y AS (SELECT CAST(substr(dob, 1, 4) AS INTEGER) AS year, CAST(count(*) AS DOUBLE) AS n FROM people GROUP BY 1), t AS (SELECT sum(n) AS t FROM y), days AS (SELECT CAST(unnest(generate_series(make_date(year, 1, 1), make_date(year, 12, 31), INTERVAL 1 DAY)) AS DATE) AS d, n / t / dayofyear(make_date(year, 12, 31)) AS p FROM y, t)"


@query(f"WITH {_DAYS} SELECT round(sum(p * p), 12) AS u FROM days")
def u_dob_exact(spark, d):
    return uprob.dob_u(_years(spark, d), "exact").select(F.round("u", 12).alias("u"))


@query(f"WITH {_DAYS} SELECT round((SELECT sum(p * p) FROM days) + sum(a.p * b.p), 12) AS u FROM days a JOIN days b ON b.d = a.d + 1 OR b.d = a.d - 1")
def u_dob_pm1day(spark, d):
    return uprob.dob_u(_years(spark, d), "pm1day").select(F.round("u", 12).alias("u"))


_SWAPPED = "SELECT d, d + 1 AS e FROM days UNION SELECT d, d - 1 FROM days UNION SELECT d, make_date(year(d), least(day(d), 12), month(d)) FROM days WHERE day(d) <= 12"
_EDITED = """SELECT a.d, b.d AS e FROM masks a JOIN masks b ON a.mask = b.mask
UNION SELECT d, CAST(try_strptime(substr(s, 1, i - 1) || substr(s, i + 1, 1) || substr(s, i, 1) || substr(s, i + 2), '%Y%m%d') AS DATE) FROM digits WHERE i < 8"""
_BALL = "SELECT round((SELECT sum(p * p) FROM days) + sum(a.p * b.p), 12) AS u FROM near JOIN days a ON a.d = near.d JOIN days b ON b.d = near.e WHERE near.d <> near.e"


@query(f"WITH {_DAYS}, near AS ({_SWAPPED}) {_BALL}")
def u_dob_swap(spark, d):
    return uprob.dob_u(_years(spark, d), "swap").select(F.round("u", 12).alias("u"))


@query(f"WITH {_DAYS}, digits AS (SELECT d, strftime(d, '%Y%m%d') AS s, i FROM days, generate_series(1, 8) AS g(i)), masks AS (SELECT d, substr(s, 1, i - 1) || '*' || substr(s, i + 1) AS mask FROM digits), near AS ({_SWAPPED} UNION {_EDITED}) {_BALL}")
def u_dob_dl1(spark, d):
    return uprob.dob_u(_years(spark, d), "dl1").select(F.round("u", 12).alias("u"))


@query("SELECT event_type AS value, count(*) AS n, count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE) AS share FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def topn_share(spark, d):
    return uprob.top_share(_read(spark, d, "events"), "event_type")


# ---------------------------------------------------------------- evaluation

_LAB = "SELECT d.source, l.quality = 1 AS e, d.n_chars > 1500 AS p, l.toxic = 0 AS o FROM labels l JOIN documents d USING (doc_id)"


def _labelled(spark, d):
    return _read(spark, d, "labels").join(_read(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")


@query(f"""WITH x AS ({_LAB}), a AS (SELECT source, sum(CASE WHEN e AND p THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN NOT e AND p THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN e AND NOT p THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN NOT e AND NOT p THEN 1 ELSE 0 END)::BIGINT AS tn FROM x GROUP BY 1)
SELECT source, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) END AS "precision", CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) END AS recall, CASE WHEN fp + tn > 0 THEN fp / CAST(fp + tn AS DOUBLE) END AS fpr, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1, CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) END AS accuracy FROM a""")
def confusion_by_category(spark, d):
    return evaluation.confusion(_labelled(spark, d), F.col("quality") == 1, F.col("n_chars") > 1500, "source")


@query(f"WITH x AS ({_LAB}) SELECT source, count(CASE WHEN p = e AND o = e THEN 1 END) AS both_right, count(CASE WHEN p = e AND o <> e THEN 1 END) AS engine_only, count(CASE WHEN p <> e AND o = e THEN 1 END) AS other_only, count(CASE WHEN p <> e AND o <> e THEN 1 END) AS both_wrong FROM x GROUP BY 1")
def bucket_pivot(spark, d):
    return evaluation.buckets(_labelled(spark, d), F.col("quality") == 1, F.col("n_chars") > 1500, F.col("toxic") == 0, "source")


@query("WITH a AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), b AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'both' WHEN a.doc_id IS NOT NULL THEN 'fp_only' ELSE 'removed_only' END AS side FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id")
def fp_overlap(spark, d):
    labels = _read(spark, d, "labels")
    return evaluation.overlap(labels.where("quality = 0"), labels.where("toxic = 1"), "doc_id")


# ---------------------------------------------------------------- registry

_REC = "SELECT 'hospital' AS institution_type, concat('s', CAST(c_nationkey % 3 AS STRING)) AS source, CAST(c_custkey AS STRING) AS source_id, concat('Site ', CAST(c_custkey AS STRING)) AS name, concat(CAST(1 + c_custkey % 60 AS STRING), ' Maple Street', CASE WHEN c_custkey % 4 = 1 THEN ' Suite 12' WHEN c_custkey % 4 = 2 THEN ' #5' ELSE '' END) AS street, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE CAST(1000 + c_custkey % 9 AS STRING) END AS zip, concat('2025-01-', CAST(10 + c_custkey % 20 AS STRING)) AS collected FROM customer"


def _records(spark, d):
    _read(spark, d, "customer").createOrReplaceTempView("customer")
    return spark.sql(_REC)


@query(f"WITH r AS ({_REC}), k AS (SELECT *, lower(replace(regexp_replace(street, '( Suite 12| #5)$', ''), 'Street', 'st')) AS match_street, CASE WHEN zip = '' THEN '' ELSE lpad(zip, 5, '0') END AS match_zip5 FROM r) SELECT institution_type, match_street, match_zip5, arg_min(name, source || '~' || source_id) AS name, max(collected) AS collected, count(DISTINCT source || '~' || source_id) AS n_sources FROM k WHERE match_zip5 <> '' GROUP BY 1, 2, 3")
def registry_dedupe(spark, d):
    return registry.build(_records(spark, d)).select("institution_type", "match_street", "match_zip5", "name", "collected", F.size("sources").cast("bigint").alias("n_sources"))


@query(f"WITH r AS ({_REC}) SELECT source, count(*) AS n_dropped FROM r WHERE zip = '' GROUP BY 1")
def registry_dropped(spark, d):
    return registry.dropped(_records(spark, d))


_KEYED = "lower(street) AS own, replace(regexp_replace(regexp_replace(lower(street), ' (suite|apt) [0-9]+$', ''), ' #.*$', ''), 'street', 'st') AS match_street, CASE WHEN regexp_matches(zip, '^[0-9]{1,5}$') THEN lpad(zip, 5, '0') WHEN regexp_matches(zip, '^[0-9]{5}-[0-9]{4}$') THEN substr(zip, 1, 5) ELSE '' END AS match_zip5"


@query(f"""WITH r AS ({_REC}), k AS (SELECT source, {_KEYED} FROM r)
SELECT source, count(*) AS n_rows, avg(CASE WHEN match_zip5 <> '' THEN 1 ELSE 0 END) AS usable_share, count(DISTINCT CASE WHEN match_zip5 <> '' THEN match_street || '|' || match_zip5 END) AS n_keys, avg(CASE WHEN regexp_matches(own, '\\bp\\.?\\s*o\\.?\\s*box\\b|^\\s*(rr|rural route|route|hc|hwy|highway)\\b') THEN 1 ELSE 0 END) AS unusable_share FROM k GROUP BY 1""")
def registry_quality(spark, d):
    return registry.quality(_records(spark, d))


@query(f"""WITH r AS ({_REC}), v AS (SELECT 'upper' AS variant, upper(street) AS street, zip FROM r UNION ALL SELECT 'unit', street || ' apt 2', zip FROM r UNION ALL SELECT 'zip4', street, zip || '-1234' FROM r UNION ALL SELECT 'typo', substr(street, 1, 3) || substr(street, 5), zip FROM r),
keys AS (SELECT DISTINCT match_street, match_zip5 FROM (SELECT {_KEYED} FROM r) x WHERE match_zip5 <> ''), k AS (SELECT variant, {_KEYED} FROM v)
SELECT variant, avg(CASE WHEN keys.match_zip5 IS NULL THEN 0 ELSE 1 END) AS hit_rate FROM k LEFT JOIN keys USING (match_street, match_zip5) GROUP BY 1""")
def registry_robustness(spark, d):
    return registry.robustness(_records(spark, d), sample=None)


# ---------------------------------------------------------------- windows, series, index


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) x WHERE rn = 1")
def latest_per_key(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return _read(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("o_custkey", "o_orderkey", "o_totalprice")


@query("WITH n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, CASE WHEN count(*) OVER w = 7 THEN avg(n) OVER w END AS mean7 FROM n WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def rolling7(spark, d):
    """Days are few whatever the number of events, so one ordered window holds them."""
    n = _read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy("day").rowsBetween(-6, 0)
    return n.select("day", "n", F.when(F.count("*").over(w) == 7, F.avg("n").over(w)).alias("mean7"))


@query("WITH n AS (SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1) SELECT round(regr_slope(n, date_diff('day', DATE '2020-01-01', day)), 9) AS slope, round(stddev_pop(n) / avg(n), 9) AS cv, median(n) AS median_n FROM n")
def regression_slope(spark, d):
    n = _read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    at = F.datediff("day", F.to_date(F.lit("2020-01-01"))).cast("double")
    return n.agg(F.round(F.regr_slope("n", at), 9).alias("slope"), F.round(F.stddev_pop("n") / F.avg("n"), 9).alias("cv"), F.median("n").alias("median_n"))


@query(f"WITH people AS ({PEOPLE}) " + " UNION ALL ".join(f"SELECT CAST(pid AS VARCHAR) AS patient_id, '{f}' AS field_name, {c} AS value FROM people WHERE {c} IS NOT NULL" for f, c in (("first_names", "first_name"), ("last_names", "last_name"), ("middle_names", "middle_name"), ("suffixes", "suffix"), ("dob", "dob"), ("phones", "phone"), ("emails", "email"), ("ssn_last4", "ssn4"), ("mbi", "mbi"), ("legal_ids", "legal_id"), ("namespace_ids", "namespace_id"), ("zip_codes", "zip"), ("street_lines", "street"), ("insurance_member_ids", "member_id"), ("insurance_subscriber_ids", "subscriber_id"))))
def eav_explode(spark, d):
    return fields.index_rows(_people(spark, d))


@query(f"WITH people AS ({PEOPLE}) SELECT CAST(pid AS VARCHAR) AS patient_id, first_name AS first, coalesce(phone, '') AS phone, coalesce(legal_id, '') AS legal FROM people")
def eav_pivot(spark, d):
    wide = fields.from_index(fields.index_rows(_people(spark, d)))
    return wide.select("patient_id", F.array_join("first_names", ",").alias("first"), F.array_join("phones", ",").alias("phone"), F.array_join("legal_ids", ",").alias("legal"))


@query("SELECT c_custkey AS k, c_acctbal AS v, 'customer' AS origin FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier")
def upsert_merge(spark, d):
    old = _read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit("customer").alias("origin"))
    new = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"), F.lit("supplier").alias("origin"))
    return merged(old, new, "k")


from . import analytics, records  # noqa: E402,F401  register their queries
