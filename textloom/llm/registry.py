"""The queries of the corpus operators and, where DuckDB can say the same, their SQL."""

from __future__ import annotations

from . import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13

_MODULES = [op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13]


def queries() -> dict:
    return {m.NAME: m.query for m in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _MODULES if m.SQL}
