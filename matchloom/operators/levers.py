"""What wider comparisons would cost each rule: chances under levers and combinations of them, as joins over small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .rules import HOUSEHOLD_RULES, RULES, THRESHOLD, U, p_collision

# A widening's field, the chance of agreement widened, and the plain one it is a multiple of.
WIDENINGS = (
    ("initial", "first_name", 0.0671673866353513, 0.001792560882279055),
    ("dob_dl1", "dob", 0.001044395948837177, 3.225964861105512e-05),
    ("dob_swap", "dob", 0.0001084365051850848, 3.225964861105512e-05),
    ("min4_first_name", "first_name", 0.0025831930756511174, 0.0022573158479302557),
    ("min4_last_name", "last_name", 0.0009106306839093161, 0.0008324816310942842),
)
# Levers, the widenings they bring, and the rules they are meant for.
LEVERS = (
    ("initial_all", ("initial",), "all"), ("initial_c2", ("initial",), "c2"), ("initial_ge4", ("initial",), "ge4"),
    ("dob_dl1_fuzzy", ("dob_dl1",), "fuzzy_eligible"), ("dob_dl1_all", ("dob_dl1",), "all"), ("dob_dl1_c2", ("dob_dl1",), "c2"),
    ("dob_swap_fuzzy", ("dob_swap",), "fuzzy_eligible"), ("min4", ("min4_first_name", "min4_last_name"), "fuzzy_eligible"),
)
# Combinations in the order of preference of their levers.
COMBOS = (("dob_dl1_all", "initial_c2"), ("dob_dl1_all", "initial_all"), ("dob_dl1_all", "initial_ge4"), ("initial_all", "dob_dl1_fuzzy"), ("initial_all", "dob_dl1_fuzzy", "min4"))
# Measured chances of fields, exactly and with tolerance.
MEASURED = {"first_name": (0.001792560882279055, 0.0022573158479302557), "last_name": (0.0006778535244696045, 0.0008324816310942842), "dob": (3.225964861105512e-05, 3.225964861105512e-05), "zip_code": (9.697668631688555e-05, 9.697668631688555e-05), "ssn_last4": (0.00010001000100010001, 0.00010001000100010001), "itin_last4": (0.00010001000100010001, 0.00010001000100010001)}
#: Rules that levers are priced for: all but the two on relationships.
PRICED = RULES + tuple(r for r in HOUSEHOLD_RULES if r.rule_id not in ("C2-39", "C2-40"))

FIELD_ROWS = "rule_id string, category string, step_fields int, most int, p double, field string, eligible boolean, exact double, plain double, measured double, measured_loose double"


def field_rows() -> list[tuple]:
    """One row for each rule and field; ``plain`` is the field's own chance in the rule, loose where it may be."""
    out = []
    for r in PRICED:
        most, p = (1 if r.household else r.most), max(p_collision(r.household + r.fields), p_collision(r.household + r.fields, r.loose))
        for i, f in enumerate(r.household + r.fields):
            own = i >= len(r.household)
            eligible = own and f in r.loose
            loose = eligible and most > 0 and f in ("first_name", "last_name", "street_line") and U[f][1] is not None
            out.append((r.rule_id, "C2" if r.household else "C1", len(r.fields), most, p, f, eligible, U[f][0], U[f][1] if loose else U[f][0], *(MEASURED.get(f) or (None, None))))
    return out


WIDENED_ROWS = "lever string, scope string, widening string, field string, widened double, times double, spec double"


def widened_rows() -> list[tuple]:
    """One row for each lever and widening; ``spec`` is the chance whose inverse bounds the multiple."""
    of = {w[0]: w[1:] for w in WIDENINGS}
    return [(lever, scope, w, of[w][0], of[w][1], of[w][1] / of[w][2], U[of[w][0]][1] if w.startswith("min4") else U[of[w][0]][0]) for lever, ws, scope in LEVERS for w in ws]


def tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(field_rows(), FIELD_ROWS), spark.createDataFrame(widened_rows(), WIDENED_ROWS)


def applies() -> Column:
    """Whether a lever's widening is meant for a rule's field."""
    return F.when(F.col("scope") == "all", True).when(F.col("scope") == "c2", F.col("category") == "C2").when(F.col("scope") == "ge4", F.col("step_fields") >= 4).otherwise(F.col("eligible"))


def applicable(fields: DataFrame, widened: DataFrame) -> DataFrame:
    """``rule_id, lever`` with the field, widening and multiple of each place where a lever applies."""
    return fields.join(widened, "field").where(applies())


def priced(fields: DataFrame, widened: DataFrame, options: DataFrame) -> DataFrame:
    """``option, rule_id, basis, p`` for options (option, lever): where two levers widen a field, the larger multiple counts.

    Two bases: the rule's own chance times multiples, none above certainty; and measured chances field by field.
    """
    over = applicable(fields, widened).join(options, "lever").groupBy("option", "rule_id", "field").agg(F.max("times").alias("times"), F.max_by("widened", "times").alias("widened"), F.max_by("spec", "times").alias("spec"))
    # of fields that may be fuzzy, as many as the rule allows are taken to be, the worst first
    name = F.col("eligible") & F.col("field").isin("first_name", "last_name")
    ratio = F.when(name, F.col("measured_loose") / F.col("measured"))
    rank = F.row_number().over(Window.partitionBy("rule_id").orderBy(ratio.desc_nulls_last(), F.col("field").desc()))
    base = fields.withColumn("rank", rank).withColumn("own", F.coalesce(F.when(name & (F.col("rank") <= F.col("most")), F.col("measured_loose")).otherwise(F.col("measured")), F.col("plain")))
    used = over.select("option", "rule_id").distinct()
    each = used.join(base, "rule_id").join(over.withColumnRenamed("times", "multiple"), ["option", "rule_id", "field"], "left")
    made = each.groupBy("option", "rule_id").agg((F.first("p") * F.product(F.coalesce(F.least("multiple", 1 / F.col("spec")), F.lit(1.0)))).alias("scaled_conservative"), F.product(F.coalesce("widened", "own")).alias("empirical"))
    return made.unpivot(["option", "rule_id"], ["scaled_conservative", "empirical"], "basis", "p")


def feasibility(spark: SparkSession, threshold: float = THRESHOLD) -> DataFrame:
    """Single levers: for each rule they apply to, on each basis, the chance and whether the rule stays approved."""
    fields, widened = tables(spark)
    options = widened.select(F.col("lever").alias("option"), "lever").distinct()
    return priced(fields, widened, options).select(F.col("option").alias("lever"), "rule_id", "basis", "p", (F.col("p") <= threshold).alias("feasible"))


def assignment(spark: SparkSession, combos: tuple[tuple[str, ...], ...] = COMBOS, threshold: float = THRESHOLD) -> DataFrame:
    """For each combination, rule and basis: all of its levers that apply if the rule stays approved under them, else the first one alone that it does under, else none."""
    fields, widened = tables(spark)
    rows = [(" + ".join(c), i, lever) for c in combos for i, lever in enumerate(c)]
    parts = spark.createDataFrame(rows, "combo string, place int, lever string")
    here = parts.join(applicable(fields, widened).select("rule_id", "lever").distinct(), "lever")
    whole = here.groupBy("combo", "rule_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "lever"))), lambda x: x["lever"]).alias("levers")).where("n > 1")
    options = whole.select("combo", "rule_id", F.lit(-1).alias("place"), "levers").unionByName(here.select("combo", "rule_id", "place", F.array("lever").alias("levers"))).withColumn("option", F.concat_ws("+", "levers"))
    price = priced(fields, widened, options.select("option", F.explode("levers").alias("lever")).distinct())
    fits = options.join(price, ["option", "rule_id"]).where(F.col("p") <= threshold).groupBy("combo", "rule_id", "basis").agg(F.min_by("option", "place").alias("levers"))
    every = parts.select("combo").distinct().crossJoin(F.broadcast(fields.select("rule_id").distinct())).withColumn("basis", F.explode(F.array(F.lit("scaled_conservative"), F.lit("empirical"))))  # combinations are few
    return every.join(fits, ["combo", "rule_id", "basis"], "left").select("combo", "rule_id", "basis", F.coalesce("levers", F.lit("")).alias("levers"))


def feasibility_report(spark: SparkSession) -> DataFrame:
    """For each basis and lever how many rules it applies to, and those that stay approved."""
    return feasibility(spark).groupBy("basis", "lever").agg(F.count("*").alias("applicable"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("feasible"), F.col("rule_id")))), ",").alias("feasible"))


def lever_recall(pairs: DataFrame, by_lever: dict[str, Column], expected: str = "expected") -> DataFrame:
    """Recall of each lever on labelled pairs: a pair counts as found where its lever's column holds."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("lever"), F.coalesce(c, F.lit(False)).alias("found")) for k, c in by_lever.items()]))
    rows = pairs.where(F.col(expected)).select(each.alias("l")).select("l.*")
    return rows.groupBy("lever").agg(F.sum(F.col("found").cast("int")).alias("tp"), F.count("*").alias("n"), F.avg(F.col("found").cast("double")).alias("recall"))
