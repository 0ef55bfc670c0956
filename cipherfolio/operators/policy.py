"""Rule packs compiled to Columns: scoring is one projection, no shuffle.

Every rule becomes one boolean column. Scores, bands, deadlines and status
are plain arithmetic over those booleans; label, rule and action lists are
fixed-order arrays, so nothing is sorted per row.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherfolio.functions.canonical import literal_map, lookup, strip
from cipherfolio.knowledge import Pack, Rule, default_packs, load_data_classes

# Band thresholds, caps, Mosca terms, status order, caveats.
BAND_FLOORS = ((80, "Critical"), (60, "High"), (40, "Medium"), (0, "Low"))
DEFAULT_CAP = 40
MOSCA_GAP_CEILING = 20
Y_YEARS_BASE = 3
Y_YEARS_HARDCODED = 2
DEFAULT_Z_YEARS = 11
STATUS_ORDER = ("broken", "weakened", "adequate", "pqc")
UNVERIFIED_LABEL = " (provisional -- unverified against source)"
UNVERIFIED_ACTION = "PROVISIONAL (unverified against source): "

#: Facts a verdict itself produces; rules selecting on them run second.
DERIVED_FACTS = frozenset({"quantum_status"})

FACT_COLUMNS = {
    "name": "name",
    "algorithm": "algorithm",
    "component_type": "component_type",
    "primitive": "standard_primitive",
    "usage": "usage",
    "views": "views",
    "nist_quantum_security_level": "nist_quantum_security_level",
    "classical_security_level": "classical_security_level",
    "x_years": "x_years",
    "y_years": "y_years",
    "z_years": "z_years",
    "sector": "sector",
    "exposure": "exposure",
    "data_class": "data_class_name",
    "configurable": "configurable",
    "quantum_status": "_status",
}
INTEGER_FACTS = frozenset(
    {"nist_quantum_security_level", "classical_security_level", "x_years", "y_years", "z_years"}
)


def band_of(score: Column) -> Column:
    chain = F
    for floor, band in BAND_FLOORS[:-1]:
        chain = chain.when(score >= floor, F.lit(band))
    return chain.otherwise(F.lit(BAND_FLOORS[-1][1]))


def band_rank(band: Column) -> Column:
    return lookup({"Critical": 3, "High": 2, "Medium": 1, "Low": 0}, band)


def mosca_gap(x: Column, y: Column, z: Column) -> Column:
    return x + y - z


def mosca_contribution(gap: Column, cap: int) -> Column:
    scaled = F.floor(gap * cap / MOSCA_GAP_CEILING).cast("int")
    return F.when(gap > 0, F.least(F.lit(cap), scaled)).otherwise(F.lit(0))


# --- selectors --------------------------------------------------------------

def fact(name: str) -> Column:
    if name == "asset_type":
        return F.coalesce("standard_asset_type", "asset_type")
    if name in FACT_COLUMNS:
        return F.col(FACT_COLUMNS[name])
    return F.try_element_at(F.col("params"), F.lit(name))


def _number(name: str, value: Column) -> Column:
    return value.cast("double") if name in INTEGER_FACTS else strip(value.cast("string")).try_cast("double")


def _equals(name: str, value: Column, operand: Any) -> Column:
    if isinstance(operand, bool):
        words = ("true", "True") if operand else ("false", "False")
        return value.cast("string").isin(*words)
    if isinstance(operand, (int, float)):
        return _number(name, value) == F.lit(float(operand))
    return value.cast("string") == F.lit(str(operand))


def _any_equal(name: str, value: Column, operands: Iterable[Any]) -> Column:
    operands = list(operands)
    if all(isinstance(o, str) for o in operands):
        return value.cast("string").isin(*operands)
    tests = [_equals(name, value, o) for o in operands]
    joined = tests[0]
    for test in tests[1:]:
        joined = joined | test
    return joined


def selector(when: Mapping[str, Any]) -> Column:
    """A ``when`` table as one never-NULL boolean; an absent fact matches nothing."""
    tests: list[Column] = []
    for name, expected in when.items():
        value = fact(name)
        for operator, operand in (expected if isinstance(expected, Mapping) else {"eq": expected}).items():
            if operator == "present":
                tests.append(value.isNotNull() if operand else value.isNull())
                continue
            if operator == "eq":
                test = _equals(name, value, operand)
            elif operator == "in":
                test = _any_equal(name, value, operand)
            elif operator == "not_in":
                test = ~_any_equal(name, value, operand)
            elif operator == "contains":
                test = F.array_contains(value, operand) if name == "views" else F.lit(False)
            elif operator == "min":
                test = _number(name, value) >= F.lit(float(operand))
            else:
                test = _number(name, value) <= F.lit(float(operand))
            tests.append(F.coalesce(test, F.lit(False)))
    joined = tests[0]
    for test in tests[1:]:
        joined = joined & test
    return joined


# --- inputs -----------------------------------------------------------------

X_BASIS = "data_class={}; a policy default, not a statutory retention period"
Y_BASIS = "ESTIMATE (heuristic): base 3y{}. Modelled from configurability, not measured."
Z_BASIS = "ESTIMATE (global parameter): years until a cryptographically relevant quantum computer."


def with_score_inputs(
    components: DataFrame,
    targets: DataFrame,
    z_years: int | Column | None = None,
    data_classes: dict[str, tuple[str, int]] | None = None,
) -> DataFrame:
    """Join the context of each (scan, system) and derive the Mosca terms.

    ``targets`` holds scan_id, system, data_class, sector, exposure and
    optionally z_years. A system nobody classified keeps ``x_years`` NULL.
    """
    table = load_data_classes() if data_classes is None else data_classes
    joined = components.join(targets, ["scan_id", "system"], "left")
    alias = F.lower(strip(F.col("data_class")))
    years = lookup({a: y for a, (_, y) in table.items()}, alias)
    named = lookup({a: n for a, (n, _) in table.items()}, alias)
    hard = F.coalesce(~F.col("configurable"), F.lit(False))
    if z_years is None:
        horizon = F.col("z_years") if "z_years" in targets.columns else F.lit(DEFAULT_Z_YEARS)
    else:
        horizon = z_years if isinstance(z_years, Column) else F.lit(z_years)
    return (
        joined.withColumn("sector", F.coalesce("sector", F.lit("other")))
        .withColumn("exposure", F.coalesce("exposure", F.lit("unknown")))
        .withColumn("data_class_name", named)
        .withColumn("x_years", years)
        .withColumn("y_years", F.lit(Y_YEARS_BASE) + F.when(hard, F.lit(Y_YEARS_HARDCODED)).otherwise(F.lit(0)))
        .withColumn("z_years", F.coalesce(horizon, F.lit(DEFAULT_Z_YEARS)))
    )


def input_bases() -> dict[str, Column]:
    """The wording that marks each term as an estimate or a default."""
    hard = F.when(F.col("y_years") > Y_YEARS_BASE, F.lit(" + 2y hard-coded penalty")).otherwise(F.lit(""))
    return {
        "x_years_basis": F.when(F.col("x_years").isNotNull(), F.concat(F.lit("data_class="), "data_class_name", F.lit(X_BASIS.split("{}")[1]))),
        "y_years_basis": F.concat(F.lit(Y_BASIS.split("{}")[0]), hard, F.lit(Y_BASIS.split("{}")[1])),
        "z_years_basis": F.lit(Z_BASIS),
    }


# --- evaluation -------------------------------------------------------------

def _any(columns: Sequence[Column]) -> Column:
    joined = F.lit(False)
    for column in columns:
        joined = joined | column
    return joined


def _least(dates: list[Column]) -> Column:
    if not dates:
        return F.lit(None).cast("date")
    return dates[0] if len(dates) == 1 else F.least(*dates)


def _worst_status(fired: list[tuple[Rule, Column]]) -> Column:
    chain = None
    for status in STATUS_ORDER:
        cause = [hit for rule, hit in fired if rule.verified and rule.effect.get("quantum_status") == status]
        if cause:
            chain = F.when(_any(cause), F.lit(status)) if chain is None else chain.when(_any(cause), F.lit(status))
    return F.lit(None).cast("string") if chain is None else chain


def category_caps(packs: Iterable[Pack]) -> dict[str, int]:
    caps: dict[str, int] = {}
    for pack in packs:
        for category, cap in pack.caps.items():
            caps[category] = min(cap, caps.get(category, cap))
    return caps


def evaluate(rows: DataFrame, packs: Sequence[Pack] | None = None) -> DataFrame:
    """Add the verdict columns to rows that carry facts and score inputs."""
    packs = list(default_packs() if packs is None else packs)
    caps = category_caps(packs)
    rules = [rule for pack in packs for rule in pack.rules]
    column_of = {rule.id: f"_r{i}" for i, rule in enumerate(rules)}
    first = [r for r in rules if not DERIVED_FACTS & set(r.when)]
    second = [r for r in rules if DERIVED_FACTS & set(r.when)]

    def hits(some: list[Rule]) -> list[tuple[Rule, Column]]:
        return [(rule, F.col(column_of[rule.id])) for rule in some]

    base_columns = rows.columns
    staged = rows.select("*", *[selector(r.when).alias(column_of[r.id]) for r in first])
    staged = staged.withColumn("_status", _worst_status(hits(first)))
    staged = staged.select("*", *[selector(r.when).alias(column_of[r.id]) for r in second])

    fired = hits(rules)
    gap = mosca_gap(F.col("x_years"), F.col("y_years"), F.col("z_years"))

    def contribution(rule: Rule) -> Column:
        if rule.effect.get("type") == "mosca_urgency":
            return mosca_contribution(gap, caps.get(rule.effect["category"], DEFAULT_CAP))
        return F.lit(int(rule.effect["score"]))

    categories: dict[str, Column] = {}
    for category in sorted({str(rule.effect["category"]) for rule in rules}):
        mine = [(rule, hit) for rule, hit in fired if rule.effect["category"] == category]
        total = F.lit(0)
        for rule, hit in mine:
            if rule.verified and (rule.effect.get("type") or rule.effect["score"]):
                total = total + F.when(hit, contribution(rule)).otherwise(F.lit(0))
        cap = caps.get(category, DEFAULT_CAP)
        categories[category] = F.when(_any([hit for _, hit in mine]), F.least(total, F.lit(cap)))
    names = {category: f"_c{i}" for i, category in enumerate(categories)}
    staged = staged.select("*", *[value.alias(names[category]) for category, value in categories.items()])

    score = F.lit(0)
    for column in names.values():
        score = score + F.coalesce(F.col(column), F.lit(0))

    def fixed_order(pairs: list[tuple[str, list[Column]]]) -> Column:
        return F.array_compact(F.array(*[F.when(_any(cause), F.lit(text)) for text, cause in pairs])) if pairs else F.array().cast("array<string>")

    labels: dict[str, list[Column]] = {}
    actions: list[tuple[dt.date, str, str, Column]] = []
    for rule, hit in fired:
        suffix, prefix = ("", "") if rule.verified else (UNVERIFIED_LABEL, UNVERIFIED_ACTION)
        for label in rule.texts("label", "labels"):
            labels.setdefault(label + suffix, []).append(hit)
        for action in rule.texts("action", "actions"):
            actions.append((rule.deadline or dt.date.max, rule.id, prefix + action, hit))
    dated = [(rule, F.when(hit, F.lit(rule.deadline))) for rule, hit in fired if rule.deadline]
    deadline = _least([d for _, d in dated])
    checked = _least([d for rule, d in dated if rule.verified])
    category_map = F.map_filter(
        F.create_map(*[part for category, column in names.items() for part in (F.lit(category), F.col(column))]),
        lambda _, value: value.isNotNull(),
    )
    return staged.select(
        *base_columns,
        score.alias("score"),
        band_of(score).alias("band"),
        fixed_order(sorted(labels.items())).alias("labels"),
        deadline.alias("deadline"),
        F.array_distinct(fixed_order([(text, [hit]) for _, _, text, hit in sorted(actions, key=lambda a: a[:3])])).alias("actions"),
        fixed_order([(rule.id, [hit]) for rule, hit in sorted(fired, key=lambda pair: pair[0].id)]).alias("fired_rules"),
        _worst_status(fired).alias("quantum_status"),
        category_map.alias("categories"),
        fixed_order([(rule.id, [hit]) for rule, hit in sorted(fired, key=lambda pair: pair[0].id) if not rule.verified]).alias("provisional_rules"),
        F.coalesce(deadline.isNotNull() & (checked.isNull() | (checked > deadline)), F.lit(False)).alias("deadline_provisional"),
    )


def score_components(
    components: DataFrame,
    targets: DataFrame,
    packs: Sequence[Pack] | None = None,
    z_years: int | None = None,
) -> DataFrame:
    """Components -> components with verdicts."""
    return evaluate(with_score_inputs(components, targets, z_years), packs)


def horizon_sweep(
    components: DataFrame,
    targets: DataFrame,
    horizons: Sequence[int] = tuple(range(5, 21)),
    packs: Sequence[Pack] | None = None,
) -> DataFrame:
    """Band counts at every horizon.

    Components are first counted per distinct combination of facts any rule
    can read, so the horizons multiply only those combinations.
    """
    packs = list(default_packs() if packs is None else packs)
    inputs = with_score_inputs(components, targets)
    read = {name for pack in packs for rule in pack.rules for name in rule.when} - DERIVED_FACTS
    columns = {FACT_COLUMNS[n] for n in read if n in FACT_COLUMNS} | {"x_years", "y_years"}
    if "asset_type" in read:
        columns |= {"asset_type", "standard_asset_type"}
    columns.discard("z_years")
    params = sorted(n for n in read if n not in FACT_COLUMNS and n != "asset_type")
    shown = [F.try_element_at("params", F.lit(p)).alias(f"_p{i}") for i, p in enumerate(params)]
    distinct = (
        inputs.select("scan_id", *sorted(columns), *shown)
        .groupBy("scan_id", *sorted(columns), *[f"_p{i}" for i in range(len(params))])
        .agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = [part for i, p in enumerate(params) for part in (F.lit(p), F.col(f"_p{i}"))]
    params_map = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    swept = distinct.withColumn("params", params_map).withColumn("z_years", F.explode(F.array(*[F.lit(z) for z in horizons])))
    return (
        evaluate(swept, packs)
        .groupBy("scan_id", "z_years", "band")
        .agg(F.sum("n").alias("components"))
    )
