"""Validation by rules compiled to predicates: every violation of a row, with its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def item_rules() -> dict[str, Column]:
    """What any item must meet."""
    return {
        "/trust untrusted-instructs": (F.col("trust_level") == "untrusted") & F.coalesce("provides_instructions", F.lit(False)),
        "/id required": F.col("id").isNull() | (F.col("id") == ""),
        "/priority minimum": F.col("priority") < 0,
        "/relevance range": ~F.col("relevance").between(0, 1),
    }


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks; rules give true for what is wrong, null counts as right."""
    found = F.filter(F.array(*[F.when(F.coalesce(wrong, F.lit(False)), name) for name, wrong in rules.items()]), lambda v: v.isNotNull())
    return rows.select("*", F.explode(found).alias("violation"))


def unknown_keys(document: Column, allowed: list[str]) -> Column:
    return F.array_except(F.json_object_keys(document), F.array(*map(F.lit, allowed)))


def patch_rules() -> dict[str, Column]:
    """Rules for rows (op, path, from, value) of a patch."""
    op = F.col("op")
    return {
        "/op enum": ~op.isin("add", "remove", "replace", "move", "copy", "test"),
        "/path pattern": ~F.col("path").rlike(r"^(/([^/~]|~[01])*)*$"),
        "/value required": op.isin("add", "replace", "test") & F.col("value").isNull(),
        "/from required": op.isin("move", "copy") & F.col("from").isNull(),
    }
