"""Order and pages of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model
from . import predicates as P

ALIASES = {"score": "score", "_score": "score"}


def sort_columns(df: DataFrame, sorts: list[tuple[str, str]]) -> list[Column]:
    """The last sort asked for is the first key, then come the others, the score and
    the id. What is missing comes last either way. Of several values the least
    counts, of a descending field that isn't a date the greatest. An unknown field
    doesn't order anything."""
    types = model.property_types()
    out: list[Column] = []
    for field, way in reversed(sorts):
        field = ALIASES.get(field, field)
        name = field.rpartition(".")[2]
        if field.startswith("properties.") and types.get(name) in model.NUMERIC_TYPES:
            field = f"numeric.{name}"
        elif field == "dates":
            field = "numeric.dates"
        column, kind = P.field_column(df, field)
        if field not in df.columns and "." not in field:
            continue
        if isinstance(kind, T.ArrayType):
            is_date = name == "dates" or types.get(name) == "date"
            column = F.array_max(column) if way == "desc" and not is_date else F.array_min(column)
        out.append(column.desc_nulls_last() if way == "desc" else column.asc_nulls_last())
    if "score" in df.columns and not any(f in ALIASES for f, _ in sorts):
        out.append(F.col("score").desc_nulls_last())
    return [*out, F.col("_id").asc()]


def page(df: DataFrame, sorts: list[tuple[str, str]], offset: int = 0, limit: int | None = 20) -> DataFrame:
    """One page of the hits in order; a top-k, not a sort of all, if there is a limit."""
    ordered = df.orderBy(*sort_columns(df, sorts))
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(limit)
