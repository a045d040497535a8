"""Rule definitions as data (SRC4) run over declarations (RUL4).

Rules are JSON rows. Their conditions are parsed with typed operands, reduced to the distinct ones and compiled to column
expressions, each evaluated once a declaration however many rules share it; a declaration then carries the numbers of the
conditions it meets, and a rule holds if its own are among them. A catalog with more distinct conditions than ``most``
is not put into the plan: its conditions travel with the rule rows and are judged by a higher-order function in the join instead. Both ways
use the same predicates.

Operators: eq, neq, in, regex (found anywhere), gte, lte, exists (``value`` false: must be absent). A number compares with
the field read as a number, true and false with its text in lower case, a text with its text. A missing field, one that
cannot be read as a number, and an unknown operator fail every operator but ``exists`` with false; eq null is met by a missing field.
A condition without a field looks at ``raw_text``; one without an operator is eq.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct conditions that are compiled into the plan.
MOST_COMPILED = 256

_CONDITIONS = "conditions array<struct<field:string,operator:string,value:variant>>"
_OPERAND = "struct<kind:string,number:double,text:string>"


def parse_conditions(rule: Column) -> Column:
    """Conditions of a JSON rule as array of (field, operator, value), the value still as JSON text."""
    parsed = F.coalesce(F.from_json(rule, _CONDITIONS)["conditions"], F.from_json(F.lit("[]"), _CONDITIONS.split(" ", 1)[1]))
    return F.transform(parsed, lambda c: F.struct(
        F.coalesce(c["field"], F.lit("raw_text")).alias("field"), F.coalesce(c["operator"], F.lit("eq")).alias("operator"), F.to_json(c["value"]).alias("value")))


def _typed(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.struct(
        F.when(v.isNull() | F.is_variant_null(v), "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "text")
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").otherwise("other").alias("kind"),
        F.try_variant_get(v, "$", "double").alias("number"), F.try_variant_get(v, "$", "string").alias("text"))


def _operand(value: Column) -> tuple[Column, Column]:
    """Operand and, for lists, its items, from JSON text in a column."""
    return _typed(F.try_parse_json(value)), F.transform(F.from_json(value, "array<variant>"), _typed)


def _literal_operand(value: str | None) -> tuple[Column, Column]:
    def typed(v: object) -> Column:
        kind = ("null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "text" if isinstance(v, str) else "other")
        text = v if kind == "text" else json.dumps(v)
        return F.struct(F.lit(kind).alias("kind"), F.lit(float(v) if kind == "number" else None).cast("double").alias("number"), F.lit(None if kind == "null" else text).cast("string").alias("text"))

    parsed = None if value is None else json.loads(value)
    items = F.array(*[typed(x) for x in parsed]) if isinstance(parsed, list) and parsed else F.lit(None).cast(f"array<{_OPERAND}>")
    return typed(parsed), items


def _same(value: Column, operand: Column) -> Column:
    kind = operand["kind"]
    return (F.when(kind == "null", value.isNull()).when(kind == "number", value.try_cast("double") == operand["number"])
            .when(kind == "boolean", F.lower(value) == operand["text"]).when(kind == "text", value == operand["text"]))


def _ordered(value: Column, operand: Column, up: bool) -> Column:
    number, text = value.try_cast("double"), operand["text"]
    return (F.when(operand["kind"] == "number", number >= operand["number"] if up else number <= operand["number"])
            .when(operand["kind"] == "text", value >= text if up else value <= text))


def holds(value: Column, operator: Column, operand: Column, items: Column) -> Column:
    """Whether a field (as text) meets a condition; never null."""
    met = (F.when(operator == "eq", _same(value, operand)).when(operator == "neq", value.isNotNull() & ~_same(value, operand))
           .when(operator == "in", F.exists(items, lambda x: F.coalesce(_same(value, x), F.lit(False))))
           .when(operator == "regex", F.rlike(value, operand["text"])).when(operator == "gte", _ordered(value, operand, True))
           .when(operator == "lte", _ordered(value, operand, False))
           .when(operator == "exists", F.when(operand["text"] == "false", value.isNull()).otherwise(value.isNotNull())))
    return F.coalesce(met, F.lit(False))


def field_text(schema: T.StructType, path: str) -> Column:
    """A dotted field as text: through structs, maps and JSON texts; null where there is no such field."""
    head, *rest = path.split(".")
    if head not in schema.fieldNames():
        return F.lit(None).cast("string")
    column, kind = F.col(f"`{head}`"), schema[head].dataType
    while rest:
        if isinstance(kind, T.StructType) and rest[0] in kind.fieldNames():
            column, kind, rest = column[rest[0]], kind[rest[0]].dataType, rest[1:]
        elif isinstance(kind, T.MapType):
            column, kind, rest = F.try_element_at(column, F.lit(rest[0])), kind.valueType, rest[1:]
        elif isinstance(kind, T.StringType):
            return F.get_json_object(column, "$." + ".".join(rest))
        else:
            return F.lit(None).cast("string")
    return F.to_json(column) if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) else column.cast("string")


def parse_rules(rules: DataFrame) -> DataFrame:
    """Rules (rule_code, rule as JSON) with typed parts; a rule without a target is left out, as no declaration can meet it."""
    head = F.from_json("rule", "type string, target string, on_low_confidence string, min_confidence double")
    return rules.select(
        "rule_code", head["target"].alias("target"), F.coalesce(head["type"], F.lit("presence")).alias("type"),
        F.coalesce(head["on_low_confidence"], F.lit("REVIEW")).alias("on_low_confidence"), F.coalesce(head["min_confidence"], F.lit(0.70)).alias("min_confidence"),
        parse_conditions(F.col("rule")).alias("conditions")).where("target IS NOT NULL")


def evaluate_rules(decls: DataFrame, rules: DataFrame, most: int = MOST_COMPILED) -> DataFrame:
    """RUL4: ``rule_code, scan_id, declaration_id, n_conditions, n_met, status`` for each rule and declaration of its target.

    ``decls``: scan_id, declaration_id, declaration_type, confidence, resolution_status and whatever fields the conditions name.
    Declarations that wait for a reviewer give REVIEW; then unmet conditions give NOT_APPLICABLE for a rule of type conditional and FAIL for
    others; then a confidence below the rule's minimum gives its ``on_low_confidence``; else PASS.
    """
    parsed = parse_rules(rules)
    distinct = parsed.select("target", F.explode("conditions").alias("c")).select("target", "c.*").distinct()
    found = distinct.limit(most + 1).collect()
    keys = F.transform("conditions", lambda c: F.xxhash64(c["field"], c["operator"], F.coalesce(c["value"], F.lit("null"))))
    facts = ["scan_id", "declaration_id", "declaration_type", "confidence", "resolution_status"]
    if len(found) <= most:
        by_target: dict[str, list[Column]] = {}
        for c in found:
            key = F.xxhash64(F.lit(c["field"]), F.lit(c["operator"]), F.lit("null" if c["value"] is None else c["value"]))
            met = holds(field_text(decls.schema, c["field"]), F.lit(c["operator"]), *_literal_operand(c["value"]))
            by_target.setdefault(c["target"], []).append(F.when(met, key))
        numbers = F.lit(None).cast("array<bigint>")
        for target, tests in by_target.items():
            numbers = F.when(F.col("declaration_type") == target, F.array_compact(F.array(*tests))).otherwise(numbers)
        judged = decls.select(*facts, F.coalesce(numbers, F.array().cast("array<bigint>")).alias("met"))
        joined = judged.join(parsed.withColumn("keys", keys), F.col("declaration_type") == F.col("target"))
        n_met = F.size(F.filter("keys", lambda k: F.array_contains("met", k)))
    else:
        fields = [r["field"] for r in distinct.select("field").distinct().limit(most + 1).collect()]
        if len(fields) > most:
            raise ValueError(f"rules name more than {most} fields")
        texts = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[field_text(decls.schema, f) for f in fields]))
        typed = F.transform("conditions", lambda c: F.struct(c["field"].alias("field"), c["operator"].alias("operator"), _operand(c["value"])[0].alias("operand"), _operand(c["value"])[1].alias("items")))
        joined = decls.select(*facts, texts.alias("texts")).join(parsed.withColumn("typed", typed), F.col("declaration_type") == F.col("target"))
        n_met = F.size(F.filter("typed", lambda c: holds(F.try_element_at("texts", c["field"]), c["operator"], c["operand"], c["items"])))
    counted = joined.withColumn("n_conditions", F.size("conditions")).withColumn("n_met", n_met)
    unmet = F.col("n_met") < F.col("n_conditions")
    status = (F.when(F.col("resolution_status").isin("NEEDS_REVIEW", "CONFLICT"), "REVIEW").when(unmet & (F.col("type") == "conditional"), "NOT_APPLICABLE")
              .when(unmet, "FAIL").when(F.col("confidence") < F.col("min_confidence"), F.col("on_low_confidence")).otherwise("PASS"))
    return counted.select("rule_code", "scan_id", "declaration_id", "n_conditions", "n_met", status.alias("status"))
