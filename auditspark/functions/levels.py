"""Ordered text levels (severity, confidence, exposure, drift) as ranks and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditspark import fixed_values as fv


def mapped(key: Column, table: dict, default=None) -> Column:
    """Lookup in a constant table: a map literal, so the generated code stays small."""
    if not table:
        return F.lit(default)
    entries = [F.lit(x) if not isinstance(x, list) else string_array(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*entries), key)
    return found if default is None else F.coalesce(found, string_array(default) if isinstance(default, list) else F.lit(default))


def rank(level: Column, order: list[str]) -> Column:
    """0-based rank, null for an unknown level. Integer-typed, so aggregates stay hash-based."""
    return mapped(level, {name: i for i, name in enumerate(order)}).cast("int")


def level(rank_: Column, order: list[str]) -> Column:
    return mapped(rank_, {i: name for i, name in enumerate(order)})


def severity_rank(c: Column) -> Column:
    return rank(c, fv.SEVERITIES)


def severity(c: Column) -> Column:
    return level(c, fv.SEVERITIES)


def step(level_: Column, order: list[str], by: int) -> Column:
    """The level *by* steps up or down, stopping at the ends."""
    moved = F.greatest(F.lit(0), F.least(F.lit(len(order) - 1), rank(level_, order) + F.lit(by)))
    return level(moved, order)


def string_array(values) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def is_high_impact(capability: Column) -> Column:
    return capability.isin(fv.HIGH_IMPACT_CAPABILITIES)


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)
