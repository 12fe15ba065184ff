"""Three-valued logic whose unknowns carry a cause.

A value is a pair of columns: ``value`` (boolean, null for unknown) and ``error`` (true if the unknown comes
from a malformed operand rather than a missing one).  SQL's own AND and OR are Kleene's; the cause is kept
beside them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tri:
    """A three-valued result: null is unknown, and ``error`` tells a malformed operand from a missing one."""

    value: Column
    error: Column

    @staticmethod
    def of(value: Column) -> Tri:
        """A value that is unknown only when it is missing."""
        return Tri(value, F.lit(False))

    def cause(self) -> Column:
        """'true', 'false', 'missing' or 'error'."""
        return F.when(self.value, "true").when(~self.value, "false").when(self.error, "error").otherwise("missing")


def _error(value: Column, parts: list[Tri]) -> Column:
    return value.isNull() & reduce(lambda a, b: a | b, [p.value.isNull() & p.error for p in parts], F.lit(False))


def all_of(*parts: Tri) -> Tri:
    """Kleene AND; true for no operands.  Among unknowns an error outweighs a missing value."""
    value = reduce(lambda a, b: a & b, [p.value for p in parts], F.lit(True))
    return Tri(value, _error(value, list(parts)))


def any_of(*parts: Tri) -> Tri:
    """Kleene OR; false for no operands."""
    value = reduce(lambda a, b: a | b, [p.value for p in parts], F.lit(False))
    return Tri(value, _error(value, list(parts)))


def not_(part: Tri) -> Tri:
    return Tri(~part.value, part.error)


def resolve(part: Tri, on_missing: str, on_error: str, blocking: bool, warn_fires: bool = False) -> Column:
    """Whether a rule fires: 'fire', 'quiet' or 'dropped' (unknown and skipped).

    fail_closed fires blocking rules on an unknown, and all rules if ``warn_fires``; fail_open never does;
    skip drops the subject, to be counted.
    """

    def outcome(policy: str) -> Column:
        if policy == "fail_closed":
            return F.lit("fire" if blocking or warn_fires else "quiet")
        return F.lit("quiet" if policy == "fail_open" else "dropped")

    return F.when(part.value, "fire").when(~part.value, "quiet").when(part.error, outcome(on_error)).otherwise(outcome(on_missing))


def subset_of(left: Column, right: Column) -> Column:
    return F.size(F.array_except(left, right)) == 0


def compare(op: str, left: Column, right) -> Column:
    """The plain value of an operator; null where an operand is missing, or is nothing that the operator can take."""
    as_list = lambda x: F.array(*map(F.lit, x)) if isinstance(x, (list, tuple, set)) else x
    flag = left.try_cast("boolean")
    # text against a number has no answer; it doesn't stop the job
    ordered = left.try_cast("double") if isinstance(right, float) else left.try_cast("decimal(38,9)") if isinstance(right, int) else left
    pairs = {
        "exists": lambda: left.isNotNull(),
        "absent": lambda: left.isNull(),
        "is_true": lambda: F.when(left.isNull(), False).otherwise(flag),
        "is_false": lambda: F.when(left.isNull(), False).otherwise(~flag),
        "eq": lambda: left == right,
        "ne": lambda: left != right,
        "in": lambda: left.isin(right),
        "not_in": lambda: ~left.isin(right),
        "matches": lambda: left.rlike(rf"\A(?:{right})\z"),
        "intersects": lambda: F.arrays_overlap(left, as_list(right)),
        "subset_of": lambda: subset_of(left, as_list(right)),
        "not_subset_of": lambda: ~subset_of(left, as_list(right)),
        "superset_of": lambda: subset_of(as_list(right), left),
        "gt": lambda: ordered > right,
        "ge": lambda: ordered >= right,
        "lt": lambda: ordered < right,
        "le": lambda: ordered <= right,
    }
    if op not in pairs:
        raise ValueError(f"unknown operator: {op}")
    return pairs[op]()
