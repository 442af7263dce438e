"""Saved and ad-hoc filters: a JSON tree of operators compiled to one column, which the optimizer pushes down."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {"eq": lambda c, v: c == v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v, "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v}


class PredicateError(ValueError):
    """Says which part of a filter can't be used and why."""


def compiled(tree: dict | str, columns: list[str]) -> Column:
    """``{"operator": ..., "operands": [...]}`` with and, or, not, eq, gt, lt, gte, lte, btwn (inclusive) and is-in."""
    if isinstance(tree, str):
        try:
            tree = json.loads(tree)
        except ValueError as e:
            raise PredicateError(f"the filter is no JSON: {e}") from None
    if not isinstance(tree, dict) or "operator" not in tree:
        raise PredicateError(f"no operator in {tree!r}")
    op, args = str(tree["operator"]).lower(), tree.get("operands")
    if not isinstance(args, list) or not args:
        raise PredicateError(f"{op} needs a list of operands")
    if op in ("and", "or"):
        out = compiled(args[0], columns)
        for a in args[1:]:
            out = out & compiled(a, columns) if op == "and" else out | compiled(a, columns)
        return out
    if op == "not":
        return ~compiled(args[0], columns)
    name, values = args[0], args[1:]
    if name not in columns:
        raise PredicateError(f"unknown field {name!r}; there are {', '.join(sorted(columns))}")
    if op in _COMPARE and len(values) == 1:
        return _COMPARE[op](F.col(name), F.lit(values[0]))
    if op == "btwn" and len(values) == 2:
        return F.col(name).between(*values)
    if op == "is-in" and values:
        return F.col(name).isin(*values)
    raise PredicateError(f"{op} can't take {len(values)} values" if op in (*_COMPARE, "btwn", "is-in") else f"unknown operator {op!r}")


def screened(df: DataFrame, tree: dict | str, sort: str | None = None, ascending: bool = False, count: int | None = None, offset: int = 0) -> DataFrame:
    """Rows that a filter keeps, sorted (nulls last), from ``offset`` on."""
    d = df.where(compiled(tree, df.columns))
    if sort:
        d = d.orderBy(F.col(sort).asc_nulls_last() if ascending else F.col(sort).desc_nulls_last(), *[c for c in df.columns if c != sort])
    if offset:
        d = d.offset(offset)
    return d.limit(count) if count is not None else d


def cascade(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """stage, left: how many rows are left after each stage in turn, in one pass; the first with 0 emptied the list."""
    kept, counts = F.lit(True), []
    for name, c in stages.items():
        kept = kept & F.coalesce(c, F.lit(False))
        counts.append(F.count(F.when(kept, 1)).alias(name))
    return df.agg(*counts).unpivot([], list(stages), "stage", "left")
