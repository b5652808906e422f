"""Ordered enumerations as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The orders of the enumerations.
CLEARANCES = ("public", "internal", "confidential", "restricted")
SEVERITIES = ("low", "medium", "high", "critical")
ACTIONS = ("allow", "redact", "review", "block")
MASKINGS = ("placeholder", "partial_email", "partial_phone", "keep_last4", "hash", "tokenize", "full")
DIRECTIONS = ("request", "response")

# What a decision means on the wire.
STATUS_CODES = {"allow": 200, "redact": 200, "review": 409, "block": 403}
ERROR_CODES = {"allow": "allow", "redact": "redact", "review": "review_required", "block": "blocked_sensitive_payload"}


def choose(col: Column, table: dict, default=None) -> Column:
    """CASE over a small constant table."""
    items = list(table.items())
    head = F.when(col == F.lit(items[0][0]), F.lit(items[0][1]))
    chain = reduce(lambda acc, kv: acc.when(col == F.lit(kv[0]), F.lit(kv[1])), items[1:], head)
    return chain if default is None else chain.otherwise(F.lit(default))


def literal(value) -> str:
    """A constant as SQL text: one expression for a whole table of them keeps plans quick to build."""
    if value is None:
        return "NULL"
    if isinstance(value, (bool, int, float)):
        return str(value).upper() if isinstance(value, bool) else repr(value)
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def literals(values) -> Column:
    return F.expr(f"array({', '.join(literal(v) for v in values)})")


def _rank(names: tuple[str, ...], col: Column) -> Column:
    return (F.array_position(literals(names), col) - 1).cast("int")


def action_rank(col: Column) -> Column:
    return _rank(ACTIONS, col)


def clearance_rank(col: Column) -> Column:
    return _rank(CLEARANCES, col)


def severity_rank(col: Column) -> Column:
    return _rank(SEVERITIES, col)


def action_of(rank: Column) -> Column:
    return F.element_at(literals(ACTIONS), (rank + 1).cast("int"))


def stricter(a: Column, b: Column) -> Column:
    """The action of higher rank; NULL counts as absent."""
    return action_of(F.greatest(action_rank(a), action_rank(b)))


def decision_status(decision: Column) -> Column:
    return choose(decision, STATUS_CODES)


def decision_code(decision: Column) -> Column:
    return choose(decision, ERROR_CODES)
