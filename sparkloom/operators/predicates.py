"""Filters as column expressions. None of them needs a shuffle, and those on plain columns reach the scan."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model
from ..functions.names import normalize_name
from ..sources.transform import parse_date, parse_number

OPS = ("gt", "gte", "lt", "lte")
TEXT_QUERIES = ("match", "match_phrase", "query_string")
_UNITS = {"y": "year", "M": "month", "w": "week", "d": "day", "h": "hour", "m": "minute", "s": "second"}


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def at_least(tests: list[Column], k: int) -> Column:
    return sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0)) >= k


def field_column(df: DataFrame, field: str) -> tuple[Column, T.DataType]:
    """Column of a field name: ``a``, ``properties.a``, ``numeric.a``."""
    if field in ("id", "_id"):
        return F.col("_id"), T.StringType()
    head, _, rest = field.partition(".")
    if rest and head in df.columns and isinstance(df.schema[head].dataType, T.MapType):
        return F.try_element_at(F.col(head), F.lit(rest)), df.schema[head].dataType.valueType
    if field in df.columns:
        return F.col(field), df.schema[field].dataType
    return F.lit(None).cast("string"), T.StringType()


def _typed(kind: T.DataType, value) -> Column:
    v = F.lit(str(value))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return parse_date(v)
    return v.try_cast(kind)


def field_terms(df: DataFrame, field: str, values: list) -> Column:
    """Whether the field has one of the values; no values match all."""
    if not values:
        return F.lit(True)
    if field == "names":
        values = [normalize_name(str(v)) for v in values]
    column, kind = field_column(df, field)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.arrays_overlap(column, F.array(*[_typed(kind.elementType, v) for v in values])), F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(column.isin([str(v) for v in values]), F.lit(False))
    return F.coalesce(any_of([column == _typed(kind, v) for v in values]), F.lit(False))


def exists(df: DataFrame, field: str) -> Column:
    column, kind = field_column(df, field)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(column) > 0, F.lit(False))
    return column.isNotNull()


def bound(kind: T.DataType, op: str, value) -> Column:
    """The limit of a range. ``1970||/y`` rounds to the unit: down for gte and lt,
    to its last moment for lte and gt."""
    text, _, rounding = str(value).partition("||/")
    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return parse_number(F.lit(text)) if isinstance(kind, T.NumericType) else F.lit(text)
    at = parse_date(F.lit(text))
    if not rounding:
        return at
    unit = _UNITS[rounding]
    start = F.date_trunc(unit, at)
    if op in ("gte", "lt"):
        return start
    return F.timestamp_add(unit.upper(), F.lit(1), start) - F.expr("interval 1 microsecond")


def field_range(df: DataFrame, field: str, ops: dict[str, object]) -> Column:
    """Whether a value of the field is within all bounds at once."""
    column, kind = field_column(df, field)
    of = kind.elementType if isinstance(kind, T.ArrayType) else kind
    as_dates = isinstance(of, T.StringType) and model.property_types().get(field.rpartition(".")[2]) == "date"
    limit_kind = T.TimestampType() if as_dates else of
    compare = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
    limits = {op: bound(limit_kind, op, v) for op, v in ops.items()}
    test = lambda x: all_of([compare[op](parse_date(x) if as_dates else x, b) for op, b in limits.items()])
    return F.coalesce(F.exists(column, test) if isinstance(kind, T.ArrayType) else test(column), F.lit(False))


def prefix(df: DataFrame, field: str, value: str) -> Column:
    column, kind = field_column(df, field)
    value = value.lower()
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(column, lambda x: x.startswith(value)), F.lit(False))
    return F.coalesce(F.lower(column).startswith(value), F.lit(False))


def shares(df: DataFrame, field: str, values: list[str], least: int = 1) -> Column:
    """Whether the field has ``least`` of the values, or all if there are fewer."""
    if not values:
        return F.lit(False)
    column, _ = field_column(df, field)
    n = F.size(F.array_intersect(column, F.array(*[F.lit(v) for v in sorted(set(values))])))
    return F.coalesce(n >= min(least, len(set(values))), F.lit(False))


def schemata(names: list[str], descendants: bool = False) -> Column:
    found = model.concrete(names, descendants)
    return F.col("schema").isin(found) if found else F.lit(False)


def acl(auth: model.Auth, field: str = "dataset") -> Column:
    """What a person may read; applied before all else."""
    if auth.is_admin:
        return F.lit(True)
    allowed = sorted(map(str, auth.collection_ids)) if "collection" in field else sorted(auth.datasets)
    return F.col(field).isin(allowed) if allowed else F.lit(False)


def filter_text(field: str, values: list, invert: bool = False) -> str:
    """A filter in the words of the query language."""
    sign = "-" if invert else ""
    if not values:
        return f"{sign}{field}:*"
    quoted = [f'{field}:"{re.sub(chr(34), chr(92) + chr(34), str(v))}"' for v in sorted(map(str, values))]
    return f"{sign}{quoted[0]}" if len(quoted) == 1 else f"{sign}({' OR '.join(quoted)})"


def from_body(df: DataFrame, body: dict, text: Callable[[str, dict], Column] | None = None) -> Column:
    """A query tree (bool, term, terms, ids, range, prefix, exists, match_all,
    match_none) as one condition. Text queries (match, match_phrase, query_string)
    have a plan of their own, whose condition ``text`` gives."""
    (kind, spec), *more = body.items()
    if more:
        raise ValueError("one query at each level")
    if kind == "bool":
        listed = lambda k: [from_body(df, q, text) for q in (spec.get(k) if isinstance(spec.get(k), list) else [spec[k]] if spec.get(k) else [])]
        must, should = listed("must") + listed("filter"), listed("should")
        need = spec.get("minimum_should_match", 0 if must else 1) if should else 0
        tests = must + [~t for t in listed("must_not")]
        if need:
            tests.append(at_least(should, int(need)))
        return all_of(tests)
    if kind == "match_all":
        return F.lit(True)
    if kind == "match_none":
        return F.lit(False)
    if kind in TEXT_QUERIES and text is not None:
        return text(kind, spec)
    if kind == "ids":
        return field_terms(df, "_id", spec["values"])
    if kind == "exists":
        return exists(df, spec["field"])
    (field, value), *_ = spec.items()
    if kind == "term":
        return field_terms(df, field, [value["value"] if isinstance(value, dict) else value])
    if kind == "terms":
        return field_terms(df, field, list(value)) if value else F.lit(False)
    if kind == "range":
        return field_range(df, field, {k: v for k, v in value.items() if k in OPS})
    if kind == "prefix":
        return prefix(df, field, value["value"] if isinstance(value, dict) else value)
    raise ValueError(f"unknown query {kind!r}")
