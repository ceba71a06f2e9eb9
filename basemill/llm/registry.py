"""Queries and oracle SQL of this subpackage; a module is added when its query exists."""

from __future__ import annotations

from . import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10

MODULES = (op1, op2, op3, op4, op5, op6, op7, op8, op9, op10)


def queries() -> dict:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE for m in MODULES if getattr(m, "ORACLE", None)}
