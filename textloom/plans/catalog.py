"""All queries of the engine by name."""

from __future__ import annotations

from . import alignment, evaluation, measures, packing, preparation, rewards, runs, scalars, star, text, visibility  # noqa: F401  (they register)
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
