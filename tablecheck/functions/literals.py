"""Python values as Spark SQL text.

Plans over many columns or rules are generated as SQL expressions: one parsed text per plan
step, where the Column API would cost a call into the JVM for every operator in it.
"""

from __future__ import annotations

import math
from typing import Any


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def number(value: float) -> str:
    """A DOUBLE literal; an infinite or undefined number has no literal and is cast from text."""
    value = float(value)
    return f"{value!r}D" if math.isfinite(value) else f"CAST('{value}' AS DOUBLE)"


def literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}" if abs(value) < 2**31 else f"{value}L"
    if isinstance(value, float):
        return number(value)
    return text(str(value))


def array(parts: list[str]) -> str:
    return "array(" + ", ".join(parts) + ")"


def struct(**fields: str) -> str:
    return "struct(" + ", ".join(f"{expression} AS {field}" for field, expression in fields.items()) + ")"
