"""The ad-hoc structured query, folded search and paging: checked names, never SQL text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded

OPERATORS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "contains": lambda c, v: F.contains(F.lower(c.cast("string")), F.lit(str(v).lower())),
}


class QueryError(ValueError):
    """A query that names what the catalog does not have, or exceeds a limit."""


def ask(df: DataFrame, fields: list[str], filters: list[dict] = (), order_by: str | None = None, direction: str = "desc", limit: int = 40, offset: int = 0, clip: int = 1800) -> DataFrame:
    """Some fields of the rows that pass all filters ({column, op, value}), one page of them.

    At most 30 fields, 12 filters, 100 rows and an offset of 100 000; strings are cut to `clip` code points.
    """
    named = [*fields, *(f["column"] for f in filters), *([order_by] if order_by else [])]
    if bad := [n for n in named if n not in df.columns]:
        raise QueryError(f"no such column: {bad}")
    if bad := [f["op"] for f in filters if f["op"] not in OPERATORS]:
        raise QueryError(f"no such operator: {bad}")
    if not 1 <= len(fields) <= 30 or len(filters) > 12 or offset > 100_000:
        raise QueryError("too many fields or filters, or too large an offset")
    kinds = dict(df.dtypes)
    rows = df
    for f in filters:
        rows = rows.where(OPERATORS[f["op"]](F.col(f["column"]), f["value"]))
    if order_by:
        ties = [F.col(c) for c in df.columns if c != order_by and kinds[c] in ("bigint", "int", "string")]
        rows = rows.orderBy(F.col(order_by).asc() if direction == "asc" else F.col(order_by).desc(), *ties)
    cut = [F.substring(F.col(c), 1, clip).alias(c) if kinds[c] == "string" else F.col(c) for c in fields]
    return rows.select(cut).offset(max(0, offset)).limit(min(100, max(1, limit)))


def matches(text: Column, terms: list[str], every: bool = False) -> Column:
    """Whether folded text holds any (or all) of the folded terms, literally; 10 terms of 2 to 100 characters count."""
    wanted = [t for t in dict.fromkeys(folded(t) for t in terms) if 2 <= len(t) <= 100][:10]
    hits = [F.instr(text, t) > 0 for t in wanted]
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), hits) if hits else F.lit(False)
