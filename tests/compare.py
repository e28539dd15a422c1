"""Results of two engines as comparable bags of rows."""

from __future__ import annotations

import datetime
import decimal


def plain(value):
    if isinstance(value, decimal.Decimal | float):
        return repr(round(float(value), 6) + 0.0)
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def bag(columns: list[str], rows) -> list[tuple]:
    """The rows with columns in order of name, sorted."""
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)
