"""Unit-normalised amounts and dose rules, as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_unit(amount: Column, unit: Column, factors: Mapping[str, float]) -> Column:
    """The amount in the base unit; units match exactly and an unknown unit gives NULL."""
    converted = F.lit(None).cast("double")
    for name, factor in factors.items():
        converted = F.when(unit == name, amount * F.lit(factor)).otherwise(converted)
    return converted


def whole_units(amount: Column) -> Column:
    """Round to a whole number, halves to even."""
    return F.rint(amount)


@dataclass(frozen=True)
class DoseRule:
    """``value`` in ``unit`` above ``limit``; with ``only_if_null`` the rule needs that other column to be NULL."""

    value: Column
    unit_col: Column
    unit: str
    limit: float
    only_if_null: Column | None = None

    def column(self) -> Column:
        test = (self.unit_col == self.unit) & (self.value > F.lit(self.limit))
        return test if self.only_if_null is None else test & self.only_if_null.isNull()


def dose_predicate(rules: Sequence[DoseRule]) -> Column:
    """True where any rule holds."""
    predicate = rules[0].column()
    for rule in rules[1:]:
        predicate = predicate | rule.column()
    return predicate


def in_band(
    value: Column, above: float, upto: float, closed: bool
) -> Column:
    """above < value <= upto (closed) or above < value < upto."""
    return (value > above) & ((value <= upto) if closed else (value < upto))
