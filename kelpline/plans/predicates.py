"""The predicate grammar (equality and conjunction over known fields), keyset cursors and time bounds."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("source", "host", "container_id", "container_kind", "project", "author_id", "kind", "message_id")
STATE_KINDS = {"todo": "todo", "todos": "todo", "task": "task", "tasks": "task", "title": "title", "titles": "title"}


def eq(field: str, value: str) -> Column:
    """Equality on a known field; an unknown field matches everything."""
    return F.col(field) == value if field in FIELDS else F.lit(True)


def conj(parts: list[Column]) -> Column:
    return reduce(and_, parts, F.lit(True))


def eq_all(**values: str | None) -> Column:
    """Conjunction over the given fields; empty values are left out."""
    return conj([eq(k, v) for k, v in values.items() if v])


def cursor(after_ts: int = 0, after_id: str = "", ts: str = "timestamp", id: str = "id") -> Column:
    """Rows after a keyset cursor. A time without an id is inclusive."""
    if after_ts and after_id:
        return (F.col(ts) > after_ts) | ((F.col(ts) == after_ts) & (F.col(id) > after_id))
    if after_ts:
        return F.col(ts) >= after_ts
    return F.col(id) > after_id if after_id else F.lit(True)


def before(until: int, ts: str = "timestamp") -> Column:
    return F.col(ts) < until if until > 0 else F.lit(True)


def kinds(include: str) -> set[str]:
    name = include.strip().lower()
    if name in ("state", "important"):
        return {"title", "todo", "task"}
    return {STATE_KINDS.get(name, "message")}


def of_kinds(names: set[str]) -> Column:
    return F.col("kind").isin(*sorted(names))
