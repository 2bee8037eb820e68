"""Batch matching: pairs are joined by the exact fields of a rule, or compared as a whole by bit masks.

``match`` and ``decided`` join on keys that hold all exact fields of a rule (a date that
may differ by a day as a block of days), and send beside a key only what its rules still
compare; households of ``match`` are joined by their own fields, as twins are told apart
among all of them.  ``pairs``, for the audit and single rules, takes wider candidates -
equi-joins on two exact fields - and compares a pair field by field: four integers with a
bit for each field, asked for, there on both sides, the same, near.  A rule is a row of a
small constant array of masks, and all rules are decided by a filter over that array.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import similarity as sim, text
from .fields import extracted, normalized
from .rules import COLUMN, HOUSEHOLD_RULES, RULES, Rule, U, p_collision

#: The bit of each field that some rule uses.
BITS = {name: i for i, name in enumerate(sorted({n for r in RULES + HOUSEHOLD_RULES for n in r.household + r.fields}))}


def value(side: str, name: str) -> Column:
    """The set of a field; two fields are parts of another."""
    if name in ("child_of", "newborn_of"):
        return F.filter(F.col(f"{side}.relationship_linkage_clinical"), lambda v: v == name.replace("_", "-"))
    return F.col(f"{side}.{COLUMN.get(name, name)}")


def blocking_keys(rules: tuple[Rule, ...] = RULES + HOUSEHOLD_RULES) -> list[tuple[str, ...]]:
    """The fields that rules are blocked by: all household fields; else the two exact ones that fewest people share; else the only exact one, with the day where dates may differ; else ZIP and day."""
    out = []
    for r in rules:
        strict = [f for f in r.fields if f not in r.loose]
        if r.household:
            key = tuple(sorted(r.household))
        elif len(strict) > 1:
            key = min((tuple(sorted(p)) for p in combinations(strict, 2)), key=lambda p: (U[p[0]][0] * U[p[1]][0], p))
        elif strict:
            key = (strict[0], "near_day") if "dob" in r.loose else (strict[0],)
        else:
            key = ("near_day", "street_zip")
        if key not in out:
            out.append(key)
    return out


def keys(fields: DataFrame, near_days: bool, rules: tuple[Rule, ...] = RULES + HOUSEHOLD_RULES) -> DataFrame:
    """``patient_id, key`` for blocking; with near_days the days next to a date of birth too."""
    days = F.col("f.dob")
    if near_days:
        days = F.array_distinct(F.flatten(F.transform(days, lambda d: F.array_compact(F.array(d, *[F.date_format(F.date_add(sim.day(d), i), "yyyy-MM-dd") for i in (-1, 1)])))))
    own = {"near_day": days, "street_zip": F.array_distinct(F.transform(F.col("f.street_lines"), lambda s: F.substring_index(s, "|", -1)))}
    named = []
    for i, key in enumerate(blocking_keys(rules)):
        parts = F.array(F.lit(f"{i}"))
        for name in key:
            more = own[name] if name in own else value("f", name)
            parts = F.flatten(F.transform(parts, lambda x: F.transform(more, lambda y: F.concat(x, F.lit("|"), y))))  # noqa: B023
        named.append(parts)
    both = fields.select("patient_id", F.struct(*[c for c in fields.columns if c != "patient_id"]).alias("f"))
    return both.select("patient_id", F.explode(F.array_distinct(F.concat(*named))).alias("key"))


def candidates(queries: DataFrame, pool: DataFrame, rules: tuple[Rule, ...] = RULES + HOUSEHOLD_RULES) -> DataFrame:
    """Pairs ``(query_id, patient_id)`` that share a key; a query is not its own candidate."""
    q = keys(queries, True, rules).withColumnRenamed("patient_id", "query_id")
    return q.join(keys(pool, False, rules), "key").where("query_id <> patient_id").select("query_id", "patient_id").distinct()


def _compared(name: str) -> Column:
    """Bits of one field: 1 asked, 2 there, 4 the same, 8 near."""
    q, c = value("q", name), value("c", name)
    asked, there, same = F.size(q) > 0, (F.size(q) > 0) & (F.size(c) > 0), sim.exact(q, c)
    near = {"dob": sim.dob_near, "street_line": sim.street_fuzzy}.get(name, sim.fuzzy)
    made = asked.cast("int") + there.cast("int") * 2
    loose = any(name in r.loose for r in RULES + HOUSEHOLD_RULES)
    return made + F.when(there & same, 4).when(there & near(q, c), 8).otherwise(0) if loose else made + F.when(there & same, 4).otherwise(0)


def pairs(queries: DataFrame, pool: DataFrame, rules: tuple[Rule, ...] = RULES + HOUSEHOLD_RULES) -> DataFrame:
    """Candidate pairs as masks: ``query_id, patient_id, asked, there, same, near, vetoed, dob`` (the candidate's) and what decides between twins."""
    return compared(candidates(queries, pool, rules), queries, pool)


def compared(found: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """The pairs (query_id, patient_id) as masks."""
    q = queries.select(F.col("patient_id").alias("query_id"), F.struct(*[c for c in queries.columns if c != "patient_id"]).alias("q"))
    c = pool.select("patient_id", F.struct(*[c for c in pool.columns if c != "patient_id"]).alias("c"))
    both = found.join(q, "query_id").join(c, "patient_id")
    bits = F.array(*[_compared(name) for name in BITS])
    vetoed = text.suffixes_conflict(text.generational(F.col("q.suffixes")), text.generational(F.col("c.suffixes")))
    both = both.select("query_id", "patient_id", bits.alias("bits"), vetoed.alias("vetoed"), F.col("c.dob").alias("dob"), *_ties())
    place = F.sequence(F.lit(0), F.lit(len(BITS) - 1))
    mask = lambda bit: F.aggregate(F.zip_with("bits", place, lambda b, i: F.call_function("shiftleft", F.shiftright(b, bit).bitwiseAND(1).cast("bigint"), i)), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return both.select("query_id", "patient_id", *[mask(i).alias(n) for i, n in enumerate(("asked", "there", "same", "near"))], "vetoed", "dob", *TIES)


TIES = ("q_has_id", "same_id", "q_has_middle", "has_middle", "same_middle")


def _ties(own: str = "") -> list[Column]:
    some = lambda c: F.size(c) > 0
    same = lambda a: F.coalesce(sim.exact(F.col(f"q.{own}{a}"), F.col(f"c.{own}{a}")), F.lit(False))
    return [c.alias(n) for n, c in zip(TIES, (some(f"q.{own}namespace_ids"), same("namespace_ids"), some(f"q.{own}middle_names"), some(f"c.{own}middle_names"), same("middle_names")))]


def _mask(names) -> int:
    return sum(1 << BITS[n] for n in names)


def _table(rules: tuple[Rule, ...], first: int = 0, places: dict[Rule, int] | None = None) -> Column:
    """Rules as a constant array of masks."""
    rows = []
    for i, r in enumerate(rules):
        numbers = {"position": places[r] if places else first + i, "most": r.most}
        masks = {"house": _mask(r.household), "strict": _mask(f for f in r.fields if f not in r.loose), "loose": _mask(r.loose), "counted": _mask(f for f in r.loose if f != "dob"), "needed": _mask(r.household + r.fields)}
        names = F.array(*[F.lit(f) for f in r.household + r.fields])
        rows.append(F.struct(F.lit(r.rule_id).alias("rule_id"), *[F.lit(v).alias(k) for k, v in numbers.items()], *[F.lit(v).cast("bigint").alias(k) for k, v in masks.items()], names.alias("names"), F.array(*[F.lit(BITS[f]) for f in r.household + r.fields]).alias("bits")))
    return F.array(*rows)


def _near(exact_first: Column | None = None) -> Column:
    """The mask of near fields; first names don't count where exact ones are asked for."""
    near = F.col("near")
    return near if exact_first is None else F.when(exact_first, near.bitwiseAND(~(1 << BITS["first_name"]))).otherwise(near)


def holds(rule: Column, near: Column) -> Column:
    """Whether a rule's individual fields agree, with no more tolerance than it allows."""
    strict, loose = F.col("same").bitwiseAND(rule["strict"]) == rule["strict"], F.col("same").bitwiseOR(near).bitwiseAND(rule["loose"]) == rule["loose"]
    return strict & loose & (F.bit_count(near.bitwiseAND(rule["counted"])) <= rule["most"])


def in_house(rule: Column) -> Column:
    """Whether the household fields agree and the individual ones are asked for."""
    return (F.col("same").bitwiseAND(rule["house"]) == rule["house"]) & (F.col("asked").bitwiseAND(rule["needed"]) == rule["needed"])


def _kind(rule: Column, near: Column) -> Column:
    return F.when(near.bitwiseAND(rule["loose"]) != 0, "fuzzy").otherwise("exact")


def outcomes(rule: Column, near: Column) -> Column:
    """Of each field of a rule: missing, exact, fuzzy, fuzzy_exceeded or no_match."""
    has = lambda mask, bit: F.call_function("shiftright", mask, bit).bitwiseAND(1) == 1
    used = lambda bit: F.bit_count(near.bitwiseAND(rule["counted"]).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit) - 1))

    def of(bit):
        loose, counted = has(rule["loose"], bit), has(rule["counted"], bit)
        close = loose & has(near, bit)
        return F.when(~has(F.col("there"), bit), "missing").when(has(F.col("same"), bit), "exact").when(close & (~counted | (used(bit) < rule["most"])), "fuzzy").when(close, "fuzzy_exceeded").otherwise("no_match")

    return F.map_from_arrays(rule["names"], F.transform(rule["bits"], of))


def evaluate_flat(both: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each rule that a pair fulfils or a suffix vetoes: ``query_id, patient_id, rule_id, position, match_type, negated_by_suffix, outcomes``."""
    each = both.withColumn("rule", F.explode(F.filter(_table(rules), lambda r: holds(r, _near()))))
    rule = F.col("rule")
    return each.select("query_id", "patient_id", "rule.rule_id", "rule.position", _kind(rule, _near()).alias("match_type"), F.col("vetoed").alias("negated_by_suffix"), outcomes(rule, _near()).alias("outcomes"))


def evaluate_households(both: DataFrame, rules: tuple[Rule, ...] = HOUSEHOLD_RULES) -> DataFrame:
    """The two-step rules: household fields first, exactly; then the individual ones, with first names exact where two of the household share a date of birth; last the tie between twins.

    ``query_id, patient_id, rule_id, position, match_type, negated_by_suffix, shared_dob, excluded``
    """
    return _households(both.withColumn("rule", F.explode(F.filter(_table(rules, len(RULES)), in_house))))


def _households(kept: DataFrame) -> DataFrame:
    """``evaluate_households`` from one row for each pair and rule whose household fields agree."""
    dates = kept.withColumn("date", F.explode_outer("dob"))
    others = F.count("*").over(Window.partitionBy("query_id", "rule.rule_id", "date"))
    dates = dates.withColumn("shared", F.col("date").isNotNull() & (others > 1))
    own = ["same", "near", "vetoed", *TIES]
    kept = dates.groupBy("query_id", F.col("rule.rule_id").alias("rule_id"), "patient_id").agg(F.max("shared").alias("shared_dob"), F.first("rule").alias("rule"), *[F.first(c).alias(c) for c in own])
    near = _near(F.col("shared_dob"))
    matched = kept.where(holds(F.col("rule"), near)).withColumn("match_type", _kind(F.col("rule"), near)).withColumnRenamed("vetoed", "negated_by_suffix")
    # exactly two are left and a date of birth is shared: an identifier decides, or without one the middle name
    live = Window.partitionBy("query_id", "rule_id")
    on = lambda c: F.sum((~F.col("negated_by_suffix") & c).cast("int")).over(live)
    tie = (on(F.lit(True)) == 2) & (on(F.col("shared_dob")) > 0)
    by_id = F.col("q_has_id") & (on(F.col("same_id")) == 1)
    by_middle = ~F.col("q_has_id") & F.col("q_has_middle") & (on(F.col("has_middle")) == 2) & (on(F.col("same_middle")) == 1)
    lost = tie & ~F.col("negated_by_suffix") & ((by_id & ~F.col("same_id")) | (by_middle & ~F.col("same_middle")))
    return matched.withColumn("excluded", lost).select("query_id", "patient_id", "rule_id", F.col("rule.position").alias("position"), "match_type", "negated_by_suffix", "shared_dob", "excluded")


def any_rule(both: DataFrame, rules: tuple[Rule, ...] = RULES + HOUSEHOLD_RULES) -> DataFrame:
    """Pairwise decision: some flat rule, or some two-step rule without twin logic, and no veto."""
    ok = F.exists(_table(rules), lambda r: holds(r, _near()) & ((r["house"] == 0) | in_house(r)))
    return both.select("query_id", "patient_id", (ok & ~F.col("vetoed")).alias("matched"))


def key_groups(rules: tuple[Rule, ...], whole: bool = False) -> list[tuple[tuple[str, ...], tuple[Rule, ...]]]:
    """Keys that hold all exact fields of their rules, and the rules that each decides; a first name is left to the comparison where two more fields are there, and a key whose fields are all in another one takes the other's rules.  With whole, households are joined by their own fields alone."""
    wanted = {}
    for r in rules:
        if whole and r.household:
            wanted[r] = frozenset(r.household)
            continue
        key = {f for f in r.household + r.fields if f not in r.loose} | ({"near_day"} if "dob" in r.loose else set())
        key |= {"street_zip"} if key <= {"near_day"} and "street_line" in r.loose else set()
        wanted[r] = frozenset(key - {"first_name"} if len(key - {"first_name"}) > 1 else key)
    within = lambda a, b: all(x in b or (x == "near_day" and "dob" in b) for x in a)
    least = [k for k in set(wanted.values()) if not any(o != k and within(o, k) for o in wanted.values())]
    chance = lambda k: 1.0 if not k else U[{"near_day": "dob", "street_zip": "zip_code"}.get(min(k), min(k))][0] * chance(k - {min(k)})
    least.sort(key=lambda k: (chance(k), sorted(k)))
    own = {k: tuple(r for r in rules if next(o for o in least if within(o, wanted[r])) == k) for k in least}
    return [(tuple(sorted(k)), rs) for k, rs in own.items() if rs]


def _sent(key: tuple[str, ...], rules: tuple[Rule, ...]) -> list[str]:
    """The fields that a pair with this key must still be compared by."""
    return sorted({f for r in rules for f in r.household + r.fields} - set(key))


#: Days of a block; a date and those next to it lie in at most two.
BLOCK = 4


def keyed(fields: DataFrame, near_days: bool, groups: list[tuple[tuple[str, ...], tuple[Rule, ...]]], more: tuple[str, ...] = ()) -> DataFrame:
    """``patient_id, h, i, g, several, suffixes`` and the fields to compare, one row for each key: 96 bits name it, so that two different keys do not meet; several: whether the person has more keys of the group."""
    block = lambda d, i: F.floor(F.datediff(F.date_add(sim.day(d), i), F.lit("1970-01-01").cast("date")) / BLOCK).cast("string")
    near = lambda d: F.array_compact(F.array(block(d, -1), block(d, 1), F.when(sim.day(d).isNull(), d)))
    days = F.array_distinct(F.flatten(F.transform("f.dob", near)) if near_days else F.transform("f.dob", lambda d: F.coalesce(block(d, 0), d)))
    own = {"near_day": days, "street_zip": F.array_distinct(F.transform(F.col("f.street_lines"), lambda s: F.substring_index(s, "|", -1)))}
    sent = sorted({f for key, rules in groups for f in _sent(key, rules)})
    entries = []
    for g, (key, rules) in enumerate(groups):
        parts = F.array(F.struct(F.lit(g).cast("bigint").alias("h"), F.lit(g).alias("i")))
        for name in key:
            values = own[name] if name in own else value("f", name)
            parts = F.flatten(F.transform(parts, lambda x: F.transform(values, lambda y: F.struct(F.xxhash64(x["h"], y).alias("h"), F.hash(x["i"], y).alias("i")))))  # noqa: B023
        carried = [(value("f", f) if f in _sent(key, rules) else F.lit(None).cast("array<string>")).alias(f) for f in sent]
        parts = F.array_distinct(parts)
        entries.append(F.transform(parts, lambda x: F.struct(x["h"].alias("h"), x["i"].alias("i"), F.lit(g).alias("g"), (F.size(parts) > 1).alias("several"), *carried)))  # noqa: B023
    suffixes = text.generational(F.col("f.suffixes"))
    both = fields.select("patient_id", F.struct(*[c for c in fields.columns if c != "patient_id"]).alias("f"))
    return both.select("patient_id", F.when(F.size(suffixes) > 0, suffixes).alias("suffixes"), *[F.col(f"f.{c}").alias(f"own_{c}") for c in more], F.explode(F.concat(*entries)).alias("e")).select("patient_id", "suffixes", *[f"own_{c}" for c in more], "e.*")


def _met(q: DataFrame, c: DataFrame) -> DataFrame:
    """Pairs that share a key, as structs q and c; a query is not its own candidate."""
    q = q.select("h", "i", F.struct(*[x for x in q.columns if x not in ("h", "i")]).alias("q"))
    c = c.select("h", "i", F.struct(*[x for x in c.columns if x not in ("h", "i", "g")]).alias("c"))
    return q.join(c, ["h", "i"]).where(F.col("q.patient_id") != F.col("c.patient_id"))


def _vetoed() -> Column:
    return F.coalesce(text.suffixes_conflict(F.col("q.suffixes"), F.col("c.suffixes")), F.lit(False))


def _ruled(both: DataFrame, groups: list[tuple[tuple[str, ...], tuple[Rule, ...]]], agrees, places: dict[Rule, int], *more: Column) -> DataFrame:
    """``query_id, patient_id, rules, same, near`` and more columns: of the rules of a pair's key those for which agrees, null without any."""
    same, near = [], []
    for name in sorted({f for key, rules in groups for f in _sent(key, rules)}):
        x, y, bit = F.col(f"q.{name}"), F.col(f"c.{name}"), F.lit(1 << BITS[name]).cast("bigint")
        equal = F.coalesce(sim.exact(x, y), F.lit(False))
        same.append(F.when(equal, bit).otherwise(0))
        if any(name in r.loose for _, rules in groups for r in rules):
            close = {"dob": sim.dob_near, "street_line": sim.street_fuzzy}.get(name, sim.fuzzy)
            near.append(F.when(equal, 0).when(F.coalesce(close(x, y), F.lit(False)), bit).otherwise(0))
    any_bit = lambda parts: sum(parts, F.lit(0).cast("bigint"))
    of = lambda values: F.element_at(F.array(*values), F.col("g") + 1)
    sure = of([F.lit(_mask(f for f in key if f in BITS)).cast("bigint") for key, _ in groups])
    both = both.select(F.col("q.patient_id").alias("query_id"), "c.patient_id", "q.g", any_bit(same).alias("found"), any_bit(near).alias("near"), *more)
    both = both.withColumn("same", F.col("found") + sure)
    # exploded, as a filter would put the comparisons into each step of the loop over rules
    rules = F.filter(of([_table(rules, 0, places) for _, rules in groups]), agrees)
    return both.withColumn("rules", F.explode_outer(F.array(F.when(F.size(rules) > 0, F.transform(rules, lambda r: F.struct(r["position"].alias("position"), r["loose"].alias("loose"))))))).where("rules is not null")


def _agrees(rule: Column) -> Column:
    return holds(rule, _near()) & (F.col("same").bitwiseAND(rule["house"]) == rule["house"])


def decided(queries: DataFrame, pool: DataFrame, rules: tuple[Rule, ...] = RULES + HOUSEHOLD_RULES) -> DataFrame:
    """The pairs ``query_id, patient_id`` that ``any_rule`` decides for, among all: joined by all exact fields of a rule, so only what tolerance leaves open is compared, and nothing but the fields it takes is sent."""
    groups = key_groups(rules)
    # comparing costs more than reading: rows are dealt to all tasks first
    q, c = (keyed(df.repartition("patient_id"), near, groups) for df, near in ((queries, True), (pool, False)))
    both = _met(q, c).where(~_vetoed())
    return _ruled(both, groups, _agrees, {r: i for i, r in enumerate(rules)}).select("query_id", "patient_id").distinct()


def _packed(fields: DataFrame) -> DataFrame:
    """The same rows, dealt to all tasks as one column, so that all who read them read the same shuffle and fields are extracted once."""
    names = [c for c in fields.columns if c != "patient_id"]
    rows = fields.select("patient_id", F.to_json(F.struct(*names)).alias("f")).repartition("patient_id")
    return rows.select("patient_id", F.from_json("f", ", ".join(f"{c} array<string>" for c in names)).alias("f")).select("patient_id", "f.*")


def _found(q: DataFrame, c: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``query_id, patient_id, code, excluded`` of pairs that a flat rule decides for; the code is twice the first rule's position, and one more if fuzzy."""
    groups = key_groups(rules)
    both = _met(keyed(q, True, groups), keyed(c, False, groups)).where(~_vetoed())
    first = F.element_at("rules", 1)  # positions ascend
    code = first["position"] * 2 + (F.col("near").bitwiseAND(first["loose"]) != 0).cast("int")
    return _ruled(both, groups, _agrees, {r: i for i, r in enumerate(rules)}).select("query_id", "patient_id", code.alias("code"), F.lit(False).alias("excluded"))


def _found_in_households(q: DataFrame, c: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The same of two-step rules.  Who shares no date of birth with a query counts only beside one who has several, so in most households only those of the query's date are kept."""
    groups, places = key_groups(rules, True), {r: len(RULES) + i for i, r in enumerate(rules)}
    own = ("dob", "middle_names", "namespace_ids")
    keys_of = keyed(c, False, groups, own).withColumn("many", F.max(F.size("own_dob") > 1).over(Window.partitionBy("h", "i")))
    both = _met(keyed(q, True, groups, own), keys_of)
    if all("dob" in r.fields and "dob" not in r.loose for r in rules):
        both = both.where(F.coalesce(sim.exact(F.col("q.own_dob"), F.col("c.own_dob")), F.lit(False)) | F.col("c.many") | F.col("q.several"))
    in_same = lambda r: F.col("same").bitwiseAND(r["house"]) == r["house"]
    rows = _ruled(both, groups, in_same, places, _vetoed().alias("vetoed"), F.col("c.own_dob").alias("dob"), *_ties("own_"))
    rows = rows.withColumn("position", F.explode("rules.position")).select("query_id", "patient_id", "position", "same", "near", "vetoed", "dob", *TIES)
    # a pair with several values meets more than once
    rows = rows.repartition("query_id").dropDuplicates(["query_id", "patient_id", "position"])
    decided_ = _households(rows.withColumn("rule", F.element_at(_table(rules, len(RULES)), F.col("position") - len(RULES) + 1)))
    code = F.col("position") * 2 + (F.col("match_type") == "fuzzy").cast("int")
    return decided_.where("not negated_by_suffix").select("query_id", "patient_id", code.alias("code"), "excluded")


def audit(queries: DataFrame, pool: DataFrame, rules: tuple[Rule, ...] = RULES + HOUSEHOLD_RULES) -> DataFrame:
    """Each rule that a query has the fields for, on each of its candidates; a query without candidates has one row with ``candidates_retrieved`` 0.

    ``query_id, patient_id, rule_id, matched, match_type, negated_by_suffix, step, outcomes, fuzzy_fields, candidates_retrieved``
    """
    both = pairs(queries, pool, rules).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    each = both.withColumn("rule", F.explode(F.filter(_table(rules), lambda r: F.col("asked").bitwiseAND(r["needed"]) == r["needed"])))
    rule = F.col("rule")
    flat = rule["house"] == 0
    ok = holds(rule, _near()) & (flat | in_house(rule))
    made = outcomes(rule, _near())
    rows = each.select("query_id", "patient_id", "rule.rule_id", (ok & ~F.col("vetoed")).alias("matched"), F.when(ok, _kind(rule, _near())).alias("match_type"), (ok & F.col("vetoed")).alias("negated_by_suffix"), F.when(flat, "flat").when(in_house(rule), "individual").otherwise("household").alias("step"), made.alias("outcomes"), F.map_keys(F.map_filter(made, lambda _, v: v == "fuzzy")).alias("fuzzy_fields"), F.col("n").cast("bigint").alias("candidates_retrieved"))
    none = queries.select(F.col("patient_id").alias("query_id")).join(both.select("query_id").distinct(), "query_id", "left_anti")
    empty = {"matched": F.lit(False), "negated_by_suffix": F.lit(False), "candidates_retrieved": F.lit(0).cast("bigint")}
    return rows.unionByName(none.select("query_id", *[empty.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "query_id"]))


def evaluable(queries: DataFrame, rules: tuple[Rule, ...] = RULES + HOUSEHOLD_RULES) -> DataFrame:
    """Whether a query has all fields of some rule."""
    q = queries.select(F.col("patient_id").alias("query_id"), F.struct(*[c for c in queries.columns if c != "patient_id"]).alias("q"))
    asked = sum(((F.size(value("q", n)) > 0).cast("bigint") * (1 << i) for n, i in BITS.items()), F.lit(0).cast("bigint"))
    return q.select("query_id", F.exists(_table(rules), lambda r: asked.bitwiseAND(r["needed"]) == r["needed"]).alias("evaluable"))


def match(queries: DataFrame, pool: DataFrame, rules: tuple[Rule, ...] = RULES, household_rules: tuple[Rule, ...] = HOUSEHOLD_RULES) -> DataFrame:
    """One row for each query: ``query_id, outcome, n_matches, matches, confidence``; a match is (patient_id, rule_id, match_type) of the first rule that holds."""
    q = _packed(queries)
    c = q if pool is queries else _packed(pool)
    parts = [_found(q, c, rules)] if rules else []
    parts += [_found_in_households(q, c, household_rules)] if household_rules else []
    if not parts:
        raise ValueError("no rules to match by")
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # all of a query in one task, for both groupings
    each = found.repartition("query_id").groupBy("query_id", "patient_id").agg(F.min("code").alias("code"), F.max("excluded").alias("excluded")).where("not excluded")
    at = {i: r.rule_id for i, r in enumerate(rules)} | {len(RULES) + i: r.rule_id for i, r in enumerate(household_rules)}
    rule_ids = F.create_map(*[F.lit(x) for kv in at.items() for x in kv])
    m = F.struct("patient_id", F.element_at(rule_ids, F.shiftright("code", 1)).alias("rule_id"), F.when(F.col("code") % 2 == 1, "fuzzy").otherwise("exact").alias("match_type"))
    own = each.groupBy("query_id").agg(F.count("*").cast("int").alias("n"), F.min(m).alias("first"), F.array_sort(F.collect_list(m)).alias("matches"))
    p = {r.rule_id: (p_collision(r.household + r.fields), p_collision(r.household + r.fields, r.loose)) for r in rules + household_rules}
    chance = F.create_map(*[x for k, v in p.items() for x in (F.lit(k), F.array(F.lit(v[0]), F.lit(v[1])))])
    first = F.col("first")
    out = evaluable(q, rules + household_rules).join(own, "query_id", "left").withColumn("n_matches", F.coalesce("n", F.lit(0)))
    outcome = F.when(~F.col("evaluable"), "insufficient_fields").when(F.col("n_matches") == 0, "no_match").when(F.col("n_matches") == 1, "match").when(F.col("n_matches") == 2, "escalate").otherwise("ambiguous")
    risk = F.element_at(F.element_at(chance, first["rule_id"]), F.when(first["match_type"] == "fuzzy", 2).otherwise(1))
    return out.select("query_id", outcome.alias("outcome"), "n_matches", F.coalesce("matches", F.array().cast("array<struct<patient_id:string,rule_id:string,match_type:string>>")).alias("matches"), F.when(F.col("n_matches") == 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - risk))).alias("confidence"))


def service(records: DataFrame, pool: DataFrame, as_of: str, skip_normalization: bool = False, rules: tuple[Rule, ...] = RULES, household_rules: tuple[Rule, ...] = HOUSEHOLD_RULES) -> tuple[DataFrame, DataFrame]:
    """Nested patient records against a pool of records: responses, as of ``match``, and the audit."""
    clean = (lambda df: df) if skip_normalization else (lambda df: normalized(df, as_of))
    q = extracted(clean(records))
    c = q if pool is records else extracted(clean(pool))
    return match(q, c, rules, household_rules), audit(q, c, rules + household_rules)


def score_queries(queries: DataFrame, fields: DataFrame) -> DataFrame:
    """``query_id, candidate_id, expected, predicted, error`` for queries (query_id, candidate_ids, expected_ids) against the fields of their listed candidates; an id without fields is an error row."""
    asked = queries.select("query_id", F.explode("candidate_ids").alias("patient_id"), "expected_ids")
    asked = asked.select("query_id", "patient_id", F.array_contains("expected_ids", F.col("patient_id")).alias("expected")).distinct()
    known = asked.join(fields.select("patient_id"), "patient_id", "left_semi").join(fields.select(F.col("patient_id").alias("query_id")), "query_id", "left_semi")
    said = any_rule(compared(known.select("query_id", "patient_id"), fields, fields))
    out = asked.join(said, ["query_id", "patient_id"], "left")
    return out.select("query_id", F.col("patient_id").alias("candidate_id"), "expected", F.coalesce("matched", F.lit(False)).alias("predicted"), F.when(F.col("matched").isNull(), "missing_fields").alias("error"))
