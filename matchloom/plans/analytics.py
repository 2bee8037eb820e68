"""Queries of levers, reports, chances of agreement, daily windows and joins over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import similarity as sim
from ..operators import evaluation, levers, matching, reports, search, uprob
from ..operators.rules import RULES, THRESHOLD
from ..sources.people import PEOPLE, flat_people
from .catalogue import _FOUND, _people, _read, query

# ---------------------------------------------------------------- levers


def _sql(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else str(x)


def _values(rows: list[tuple], columns: str) -> str:
    names = ", ".join(c.split()[0] for c in columns.split(", "))
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + f") v({names}))"


_TABLES = f"f AS {_values(levers.field_rows(), levers.FIELD_ROWS)}, w AS {_values(levers.widened_rows(), levers.WIDENED_ROWS)}, a AS (SELECT f.*, w.lever, w.times, w.widened, w.spec FROM f JOIN w ON f.field = w.field WHERE scope = 'all' OR (scope = 'c2' AND category = 'C2') OR (scope = 'ge4' AND step_fields >= 4) OR (scope = 'fuzzy_eligible' AND eligible))"
_PRICED = """over_ AS (SELECT option, rule_id, field, max(times) AS times, arg_max(widened, times) AS widened, arg_max(spec, times) AS spec FROM a JOIN options USING (lever) GROUP BY 1, 2, 3),
base AS (SELECT *, eligible AND field IN ('first_name', 'last_name') AS is_name, row_number() OVER (PARTITION BY rule_id ORDER BY CASE WHEN eligible AND field IN ('first_name', 'last_name') THEN measured_loose / measured END DESC NULLS LAST, field DESC) AS rank FROM f),
priced AS (SELECT u.option, u.rule_id, any_value(b.p) * product(CASE WHEN o.times IS NULL THEN 1.0 ELSE least(o.times, 1 / o.spec) END) AS scaled, product(coalesce(o.widened, CASE WHEN b.is_name AND b.rank <= b.most THEN b.measured_loose ELSE b.measured END, b.plain)) AS empirical
  FROM (SELECT DISTINCT option, rule_id FROM over_) u JOIN base b ON b.rule_id = u.rule_id LEFT JOIN over_ o ON o.option = u.option AND o.rule_id = b.rule_id AND o.field = b.field GROUP BY 1, 2),
long AS (SELECT option, rule_id, 'scaled_conservative' AS basis, scaled AS p FROM priced UNION ALL SELECT option, rule_id, 'empirical', empirical FROM priced)"""
_SINGLE = f"{_TABLES}, options AS (SELECT DISTINCT lever AS option, lever FROM w), {_PRICED}"


@query(f"WITH {_SINGLE} SELECT option AS lever, rule_id, basis, round(log10(p), 6) AS log10_p, p <= {THRESHOLD!r} AS feasible FROM long")
def lever_feasibility(spark, d):
    """Each rule's chance under each lever that applies to it, on two bases."""
    return levers.feasibility(spark).select("lever", "rule_id", "basis", F.round(F.log10("p"), 6).alias("log10_p"), "feasible")


_COMBOS = _values([(" + ".join(c), i, x) for c in levers.COMBOS for i, x in enumerate(c)], "combo string, place int, lever string")


@query(f"""WITH {_TABLES}, parts AS {_COMBOS}, here AS (SELECT p.*, r.rule_id FROM parts p JOIN (SELECT DISTINCT rule_id, lever FROM a) r ON r.lever = p.lever),
whole AS (SELECT combo, rule_id, -1 AS place, string_agg(lever, '+' ORDER BY place) AS option FROM here GROUP BY 1, 2 HAVING count(*) > 1),
choices AS (SELECT combo, rule_id, place, option FROM whole UNION ALL SELECT combo, rule_id, place, lever FROM here),
options AS (SELECT DISTINCT option, unnest(string_split(option, '+')) AS lever FROM choices), {_PRICED},
fits AS (SELECT c.combo, c.rule_id, l.basis, arg_min(c.option, c.place) AS levers FROM choices c JOIN long l ON l.option = c.option AND l.rule_id = c.rule_id WHERE l.p <= {THRESHOLD!r} GROUP BY 1, 2, 3)
SELECT e.combo, e.rule_id, e.basis, coalesce(t.levers, '') AS levers FROM (SELECT DISTINCT p.combo, f.rule_id, b.basis FROM parts p, f, (VALUES ('scaled_conservative'), ('empirical')) b(basis)) e LEFT JOIN fits t ON t.combo = e.combo AND t.rule_id = e.rule_id AND t.basis = e.basis""")
def lever_assignment(spark, d):
    """Levers that each rule can take, of each combination."""
    return levers.assignment(spark)


@query(f"WITH {_SINGLE} SELECT basis, option AS lever, count(*) AS applicable, coalesce(string_agg(CASE WHEN p <= {THRESHOLD!r} THEN rule_id END, ',' ORDER BY rule_id), '') AS feasible FROM long GROUP BY 1, 2")
def lever_report(spark, d):
    return levers.feasibility_report(spark)


_SAME = f"people AS ({PEOPLE}), twos AS (SELECT q.pid, c.pid AS other, q.first_name AS a, c.first_name AS b, q.dob AS x, c.dob AS y FROM people q JOIN people c ON q.pid % 2 = 0 AND c.pid = q.pid + 1)"


@query(f"""WITH {_SAME}, r AS (SELECT a = b OR (length(a) >= 5 AND length(b) >= 5 AND damerau_levenshtein(a, b) <= 1) AS plain, substr(a, 1, 1) = substr(b, 1, 1) AS initial, x = y AS same_day, abs(date_diff('day', CAST(x AS DATE), CAST(y AS DATE))) <= 1 AS near_day FROM twos),
l AS (SELECT 'plain' AS lever, plain AS found FROM r UNION ALL SELECT 'initial', initial FROM r UNION ALL SELECT 'same_day', same_day FROM r UNION ALL SELECT 'near_day', near_day FROM r)
SELECT lever, sum(CASE WHEN found THEN 1 ELSE 0 END)::BIGINT AS tp, count(*) AS n, round(avg(CASE WHEN found THEN 1.0 ELSE 0.0 END), 9) AS recall FROM l GROUP BY 1""")
def lever_recall(spark, d):
    """What wider comparisons find among pairs of one person's two rows."""
    p = flat_people(spark, d)
    q = p.where("pid % 2 = 0").select("pid", F.col("first_name").alias("a"), F.col("dob").alias("x"))
    both = q.join(p.select((F.col("pid") - 1).alias("pid"), F.col("first_name").alias("b"), F.col("dob").alias("y")), "pid").withColumn("expected", F.lit(True))
    a, b, x, y = (F.array(c) for c in "abxy")
    made = levers.lever_recall(both, {"plain": sim.fuzzy(a, b), "initial": F.substring("a", 1, 1) == F.substring("b", 1, 1), "same_day": F.col("x") == F.col("y"), "near_day": sim.dob_near(x, y)})
    return made.select("lever", "tp", "n", F.round("recall", 9).alias("recall"))


# ---------------------------------------------------------------- matchers and their reports

_LABELLED = "SELECT doc_id, quality = 1 AS expected, toxic = 0 AS ours, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 3 <> 0 END AS other, concat('c', doc_id % 3) AS category, concat('c', doc_id % 3, '/s', doc_id % 2) AS sub FROM labels"


def _labelled(spark, d):
    k = F.col("doc_id")
    return _read(spark, d, "labels").select(k, (F.col("quality") == 1).alias("expected"), (F.col("toxic") == 0).alias("ours"), F.when(k % 7 != 0, k % 3 != 0).alias("other"), F.concat(F.lit("c"), k % 3).alias("category"), F.concat(F.lit("c"), k % 3, F.lit("/s"), k % 2).alias("sub"))


@query(f"""WITH l AS ({_LABELLED}), m AS (SELECT 'ours' AS matcher, category, expected, ours AS said FROM l UNION ALL SELECT 'other', category, expected, other FROM l)
SELECT matcher, category, count(*) FILTER (expected AND said) AS tp, count(*) FILTER (NOT expected AND said) AS fp, count(*) FILTER (expected AND NOT said) AS fn, count(*) FILTER (NOT expected AND NOT said) AS tn, count(*) FILTER (said IS NULL) AS errors FROM m GROUP BY 1, 2""")
def two_matcher_report(spark, d):
    """Two matchers side by side for each category; rows that a matcher could not decide are tallied."""
    return reports.two_matchers(_labelled(spark, d), {"ours": "ours", "other": "other"}, "category").select("matcher", "category", "tp", "fp", "fn", "tn", "errors")


@query(f"WITH l AS ({_LABELLED}) SELECT doc_id, CASE WHEN ours = expected THEN 'engine_only' WHEN other = expected THEN 'other_only' ELSE 'both_wrong' END AS bucket FROM l WHERE NOT (ours = expected AND coalesce(other = expected, FALSE))")
def disagreement_rows(spark, d):
    """Rows on which at least one matcher is wrong."""
    return reports.disagreements(_labelled(spark, d), "ours", "other").select("doc_id", "bucket")


@query(f"""WITH l AS ({_LABELLED}) SELECT CASE WHEN grouping(category, sub) = 3 THEN 'all' WHEN grouping(category, sub) = 0 THEN 'sub' ELSE 'category' END AS level, category, sub, count(*) FILTER (expected AND ours) AS tp, count(*) FILTER (NOT expected AND ours) AS fp, count(*) FILTER (expected AND NOT ours) AS fn, count(*) FILTER (NOT expected AND NOT ours) AS tn FROM l GROUP BY GROUPING SETS ((), (category), (category, sub))""")
def accuracy_by_levels(spark, d):
    return reports.by_levels(_labelled(spark, d).withColumnRenamed("ours", "predicted"), "category", "sub")


@query(f"WITH {_FOUND}, n AS (SELECT p.pid, count(n.patient_id) AS n FROM people p LEFT JOIN named n ON n.query_id = CAST(p.pid AS VARCHAR) GROUP BY 1) SELECT CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' ELSE '2+' END AS bucket, count(*) AS n FROM n GROUP BY 1")
def match_count_buckets(spark, d):
    p = _people(spark, d)
    return matching.match(p, p).groupBy(evaluation.match_count_bucket(F.col("n_matches")).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, n_chars >= 500 AS matched FROM documents")
def redecided(spark, d):
    """Decisions anew at another threshold."""
    return evaluation.redecide(_read(spark, d, "documents"), "n_chars", 500).select("doc_id", "matched")


@query("SELECT concat('c', doc_id % 3) AS category, count(*) AS n FROM labels GROUP BY 1")
def rationale_categories(spark, d):
    rationale = _read(spark, d, "labels").select(F.concat(F.lit("c"), F.col("doc_id") % 3, F.lit("/s"), F.col("doc_id") % 2, F.lit(" more")).alias("r"))
    return rationale.groupBy(evaluation.category(F.col("r")).alias("category")).agg(F.count("*").alias("n"))


@query(f"""WITH {_FOUND}, f1 AS (SELECT DISTINCT query_id, patient_id FROM flat WHERE NOT negated_by_suffix), asked AS (SELECT CAST(pid AS VARCHAR) AS query_id, CAST(pid + 1 AS VARCHAR) AS candidate_id, pid % 2 = 0 AS expected FROM people)
SELECT count(*) AS n, count(*) FILTER (candidate_id NOT IN (SELECT CAST(pid AS VARCHAR) FROM people)) AS errors, count(*) FILTER (EXISTS (SELECT 1 FROM f1 WHERE f1.query_id = asked.query_id AND f1.patient_id = asked.candidate_id)) AS flat_matches FROM asked""")
def score_population(spark, d):
    """Each person against the next one: rows, ids without fields, and matches by a flat rule."""
    own = _people(spark, d)
    other = (F.col("patient_id").cast("bigint") + 1).cast("string")
    asked = own.select(F.col("patient_id").alias("query_id"), F.array(other).alias("candidate_ids"), F.array(F.when(F.col("patient_id").cast("bigint") % 2 == 0, other)).alias("expected_ids"))
    rows = matching.score_queries(asked, own)
    flat = matching.any_rule(matching.compared(rows.where("error is null").select("query_id", F.col("candidate_id").alias("patient_id")), own, own), RULES).where("matched")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors")).crossJoin(flat.agg(F.count("*").alias("flat_matches")))  # one row each


@query(f"WITH {_FOUND} SELECT q.query_id, q.patient_id, TRUE AS matched FROM (SELECT DISTINCT query_id, patient_id FROM flat WHERE NOT negated_by_suffix) q")
def evaluate_pair_flat(spark, d):
    """Pairs that some flat rule decides."""
    p = _people(spark, d)
    return matching.decided(p, p, RULES).withColumn("matched", F.lit(True))


@query(f"WITH {_FOUND}, e AS (SELECT query_id, count(*) FILTER (position < {len(RULES)} AND NOT negated_by_suffix) AS rules FROM found GROUP BY 1) SELECT CAST(p.pid AS VARCHAR) AS query_id, coalesce(e.rules, 0) AS rules FROM people p LEFT JOIN e ON e.query_id = CAST(p.pid AS VARCHAR)")
def audit_matched(spark, d):
    """How many flat rules hold for each query, counted over the audit; queries without candidates are there with their own row."""
    p = _people(spark, d)
    return matching.audit(p, p).groupBy("query_id").agg(F.count_if(F.col("matched") & (F.col("step") == "flat")).alias("rules"))


# ---------------------------------------------------------------- chances of agreement

_NATION = "SELECT c_nationkey AS zip, count(*) AS population FROM customer GROUP BY 1"


def _nations(spark, d):
    return _read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("zip")).agg(F.count("*").alias("population"))


@query("WITH n AS (SELECT c_mktsegment, count(*) * 1.0 / (SELECT count(*) FROM customer) AS p FROM customer GROUP BY 1) SELECT round(sum(p * p), 12) AS u FROM n")
def u_from_probabilities(spark, d):
    c = _read(spark, d, "customer")
    p = c.groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))  # segments are few
    return uprob.from_probabilities(p).select(F.round("u", 12).alias("u"))


@query(f"WITH n AS ({_NATION}), t AS (SELECT sum(population * (population - 1.0)) AS pairs, sum(population) * 1.0 AS t FROM n WHERE zip <> 3) SELECT round(pairs / (t * (t - 1)), 12) AS u_covered, round(pairs / ((t + 40) * (t + 39)), 12) AS u_all, round(t / (t + 40), 12) AS coverage FROM t")
def u_places(spark, d):
    """Places that leave some people out, one area excluded, with both bounds."""
    return uprob.with_outside(_nations(spark, d).where("zip <> 3"), 40.0, "population").select(*[F.round(c, 12).alias(c) for c in ("u_covered", "u_all", "coverage")])


@query(f"WITH n AS ({_NATION}), h AS (SELECT population, 1.0 + zip % 4 AS h FROM n WHERE population > 1) SELECT round(sum(population * greatest(0, (h - 1) / (population - 1))) / sum(population), 12) AS u FROM h")
def u_street_given_zip(spark, d):
    return uprob.street_given_zip(_nations(spark, d).withColumn("household_size", 1.0 + F.col("zip") % 4)).select(F.round("u", 12).alias("u"))


@query(f"WITH n AS ({_NATION}), s AS (SELECT zip, population, s.s AS size, (population + s.s) % 9 AS households FROM n, (VALUES (1), (2), (3), (7)) s(s) WHERE population > 1), e AS (SELECT zip, sum(households * size * (size - 1.0)) AS pairs, max(population) * 1.0 AS p FROM s GROUP BY 1) SELECT round(sum(pairs) / sum(p * (p - 1)), 12) AS u FROM e")
def u_street_by_household(spark, d):
    sizes = _nations(spark, d).withColumn("size", F.explode(F.array(*map(F.lit, (1, 2, 3, 7))))).withColumn("households", (F.col("population") + F.col("size")) % 9)
    return uprob.street_by_household(sizes).select(F.round("u", 12).alias("u"))


@query(f"WITH people AS ({PEOPLE}), n AS (SELECT substr(dob, 1, 4) AS y, count(*) * 1.0 AS n FROM people GROUP BY 1), t AS (SELECT sum(n) AS t FROM n) SELECT round(sum(n * (n - 1)) / (any_value(t) * (any_value(t) - 1)) / 365.25, 12) AS u FROM n, t")
def u_dob_by_year(spark, d):
    return uprob.dob_by_year(uprob.u_exact(flat_people(spark, d).withColumn("y", F.substring("dob", 1, 4)), "y")).select(F.round("u", 12).alias("u"))


@query("SELECT 'phone' AS field, 6.329849830708974e-09 * 0.207 AS u UNION ALL SELECT 'ssn_last4', CAST(1 AS DOUBLE) / 9999 UNION ALL SELECT 'itin_last4', CAST(1 AS DOUBLE) / 9999 UNION ALL SELECT 'mbi', CAST(1 AS DOUBLE) / 67995415")
def u_scalars(spark, d):
    return spark.createDataFrame(sorted(uprob.scalars(6.329849830708974e-09, 0.207, 67995415).items()), "field string, u double")


@query("WITH n AS (SELECT c_mktsegment AS s, count(*) * 1.0 AS n FROM customer GROUP BY 1), t AS (SELECT sum(n * n) AS sq, sum(n * (n - 1)) AS pairs, sum(n) AS t FROM n) SELECT round(pairs / ((t + 100) * (t + 99)), 12) AS u_unbiased, round((sq + 100) / ((t + 100) * (t + 100)), 12) AS u_simple, round(pairs / (t * (t - 1)), 12) AS u_listed_only, round(t / (t + 100), 12) AS coverage FROM t")
def u_with_unlisted(spark, d):
    counts = _read(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return uprob.with_unlisted(counts, 100).select(*[F.round(c, 12).alias(c) for c in ("u_unbiased", "u_simple", "u_listed_only", "coverage")])


@query("SELECT c_custkey AS k, c_acctbal AS u FROM customer WHERE c_acctbal < 0 OR c_acctbal > 5000")
def u_out_of_range(spark, d):
    return uprob.sanity(_read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("u")), 0.0, 5000.0)


# ---------------------------------------------------------------- days, windows and joins

_DAYS = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"


def _days(spark, d):
    return _read(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT n, date_diff('day', day, DATE '1997-06-30') AS back FROM n)
SELECT count(*) FILTER (back BETWEEN 0 AND 29) AS last_n, count(*) FILTER (back BETWEEN 30 AND 59) AS prior_n, CAST(sum(n) FILTER (back BETWEEN 0 AND 29) AS BIGINT) AS last_sum, CAST(sum(n) FILTER (back BETWEEN 30 AND 59) AS BIGINT) AS prior_sum, round(avg(n) FILTER (back BETWEEN 15 AND 29), 9) AS first_half, round(avg(n) FILTER (back BETWEEN 0 AND 14), 9) AS second_half FROM b""")
def calendar_windows(spark, d):
    """The last 30 days, the 30 before, and the halves."""
    n = _read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return reports.calendar_windows(n, "day", "n", "1997-06-30").withColumns({c: F.round(c, 9) for c in ("first_half", "second_half")})


@query(f"WITH n AS ({_DAYS}), a AS (SELECT day, n AS a FROM n WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT day, n AS b FROM n WHERE event_type = (SELECT max(event_type) FROM events)) SELECT coalesce(a.day, b.day) AS day, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL OUTER JOIN b ON a.day = b.day")
def outer_aligned(spark, d):
    """Two daily series over the union of their days."""
    n = _days(spark, d)
    kinds = _read(spark, d, "events").agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    both = n.crossJoin(F.broadcast(kinds))  # one row
    return reports.aligned(both.where("event_type = lo").select("day", F.col("n").alias("a")), both.where("event_type = hi").select("day", F.col("n").alias("b")), "day", "a", "b")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS in_feed FROM customer")
def left_cross_check(spark, d):
    feed = _read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return reports.cross_checked(_read(spark, d, "customer").select("c_custkey"), feed, "c_custkey")


@query(f"WITH n AS ({_NATION}) SELECT n.zip, n.population, s.size FROM n JOIN (SELECT s_nationkey AS zip, count(*) AS size FROM supplier GROUP BY 1) s ON s.zip = n.zip")
def inner_merge(spark, d):
    sizes = _read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("zip")).agg(F.count("*").alias("size"))
    return _nations(spark, d).join(sizes, "zip")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 5, 9))")
def in_list_semi_join(spark, d):
    members = _read(spark, d, "customer").where(F.col("c_nationkey").isin(1, 5, 9))
    return _read(spark, d, "orders").join(members, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM (SELECT o_custkey FROM orders ORDER BY o_orderkey LIMIT 50) h)")
def head_and_needed(spark, d):
    """The first 50 queries, a limit that is the feature, and only the candidates these need."""
    head = _read(spark, d, "orders").orderBy("o_orderkey").limit(50)
    return _read(spark, d, "customer").join(head, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1997-06-30' - 60 AND CAST(o_orderdate AS DATE) <= DATE '1997-06-30'")
def recent_window(spark, d):
    """Rows of the last 60 days."""
    o = _read(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return reports.recent(o, "day", "1997-06-30", 60).select("o_orderkey", "o_totalprice")


@query("SELECT quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99 FROM events")
def latency_percentiles(spark, d):
    return reports.percentiles(_read(spark, d, "events"), "value", 0.5, 0.99)


@query("""WITH r AS (SELECT l_discount < 0.05 AS a, l_tax < 0.04 AS b, l_quantity > 20 AS c FROM lineitem), f AS (SELECT 'a' AS "check", CASE WHEN b AND c THEN 1 ELSE 0 END AS sole FROM r WHERE NOT a UNION ALL SELECT 'b', CASE WHEN a AND c THEN 1 ELSE 0 END FROM r WHERE NOT b UNION ALL SELECT 'c', CASE WHEN a AND b THEN 1 ELSE 0 END FROM r WHERE NOT c) SELECT "check", count(*) AS failed, CAST(sum(sole) AS BIGINT) AS sole FROM f GROUP BY 1""")
def sole_blocker(spark, d):
    """How often each check fails, and fails alone."""
    rows = _read(spark, d, "lineitem").select((F.col("l_discount") < 0.05).alias("a"), (F.col("l_tax") < 0.04).alias("b"), (F.col("l_quantity") > 20).alias("c"))
    return reports.sole_blocker(rows, "a", "b", "c")


# ---------------------------------------------------------------- registry and index

_BOTH = "SELECT 'customer' AS source, c_name AS name, CAST(c_nationkey AS VARCHAR) AS state, c_mktsegment AS institution_type FROM customer UNION ALL SELECT 'supplier', s_name, CAST(s_nationkey AS VARCHAR), NULL FROM supplier"


def _sources(spark, d):
    c = _read(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("state"), F.col("c_mktsegment").alias("institution_type"))
    s = _read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("state"))
    return reports.union_of({"customer": c, "supplier": s}, ["name", "state", "institution_type"])


@query(_BOTH)
def union_of_sources(spark, d):
    return _sources(spark, d)


@query(f"WITH b AS ({_BOTH}) SELECT CASE institution_type WHEN 'BUILDING' THEN 'block' WHEN 'MACHINERY' THEN 'block' ELSE 'review' END AS policy, institution_type, count(*) AS n FROM b GROUP BY 1, 2")
def counts_by_policy(spark, d):
    return reports.policy_counts(_sources(spark, d), {"BUILDING": "block", "MACHINERY": "block"})


@query("SELECT count(*) AS fetched, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS cached, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS skipped FROM customer")
def build_stats(spark, d):
    cached = _read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return reports.build_stats(_read(spark, d, "customer"), cached, "c_custkey")


@query(f"WITH people AS ({PEOPLE}) SELECT q.pid AS a, c.pid AS b FROM people q JOIN people c ON q.pid < c.pid AND q.phone = c.phone WHERE q.last_name <> c.last_name AND length(q.last_name) >= 5 AND length(c.last_name) >= 5 AND damerau_levenshtein(q.last_name, c.last_name) <= 1")
def fuzzy_only(spark, d):
    """People with one phone whose last names are near and not the same."""
    p = flat_people(spark, d).where("phone is not null")
    q, c = (p.select("phone", F.col("pid").alias(k), F.array("last_name").alias(k + "_n")) for k in "ab")
    return q.join(c, "phone").where("a < b").where(sim.fuzzy_only(F.col("a_n"), F.col("b_n"))).select("a", "b")


# ---------------------------------------------------------------- similarity search


@query("SELECT c_custkey AS id, c_name AS value, round(1 - levenshtein(lower('Customer#000000017'), lower(c_name)) / 18.0, 4) AS similarity_score, c_mktsegment AS segment FROM customer WHERE levenshtein(lower('Customer#000000017'), lower(c_name)) <= 1 ORDER BY 3 DESC, 1 LIMIT 10")
def search_with_metadata(spark, d):
    """Hits with their row's other columns as a map."""
    config = search.SearchConfig(max_distance=1)
    found = search.search(_read(spark, d, "customer"), "Customer#000000017", "c_name", "c_custkey", config, metadata=["c_mktsegment"])
    return found.select("id", "value", "similarity_score", F.col("metadata")["c_mktsegment"].alias("segment"))


@query("WITH s AS (SELECT p_partkey AS id, 1 - levenshtein('brand#13', lower(p_brand)) / 8.0 AS s FROM part WHERE levenshtein('brand#13', lower(p_brand)) <= 1 ORDER BY 2 DESC, 1 LIMIT 100) SELECT id, round(s / max(s) OVER (), 4) AS score FROM s")
def search_scores_over_maximum(spark, d):
    """Scores as shares of the best one, at most two edits whatever is asked for."""
    config = search.index_like(search.SearchConfig(max_distance=1, limit=100))
    return search.relative(search.search(_read(spark, d, "part"), "Brand#13", "p_brand", "p_partkey", config)).select("id", "score")
