"""All registered queries."""

from __future__ import annotations

from starling.plans import leakfree, modelling, relational, textual  # noqa: F401  registers
from starling.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
