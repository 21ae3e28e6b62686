"""Table queries: projection, filters, aggregates, order, limit, exact rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import MAX_PREVIEW_ROWS, MAX_RESULT_ROWS, MAX_SOURCE_ROWS, Aggregate, Filter, Sort, SpecError, TableQuery

_COMPARE = {
    "lt": lambda c, v: c < v, "<": lambda c, v: c < v, "lte": lambda c, v: c <= v, "<=": lambda c, v: c <= v,
    "gt": lambda c, v: c > v, ">": lambda c, v: c > v, "gte": lambda c, v: c >= v, ">=": lambda c, v: c >= v,
}
_AGGREGATES = {"count": F.count, "sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max}


def need(df: DataFrame, fields: Sequence[str]) -> None:
    if unknown := [f for f in fields if f not in df.columns]:
        raise SpecError(f"unknown fields: {', '.join(unknown)}")


def project(df: DataFrame, select: Sequence[str]) -> DataFrame:
    """These columns in this order; none means all."""
    need(df, select)
    return df.select(*select) if select else df


def condition(f: Filter) -> Column:
    """One predicate as a column; null-aware equality, substring on text, membership."""
    column, value = F.col(f.field), f.value
    if f.operator == "in":
        if not isinstance(value, (list, tuple)):
            raise SpecError("'in' takes a list")
        return column.isin(*value) if value else F.lit(False)
    if isinstance(value, (list, tuple, dict)):
        raise SpecError(f"{f.operator!r} takes one null, boolean, number or text")
    if f.operator in ("eq", "="):
        return column.isNull() if value is None else column == F.lit(value)
    if f.operator in ("ne", "!="):
        return column.isNotNull() if value is None else column != F.lit(value)
    if f.operator == "contains":
        return F.contains(column.cast("string"), F.lit(str(value)))
    if f.operator in _COMPARE:
        return _COMPARE[f.operator](column, F.lit(value))
    raise SpecError(f"unsupported operator {f.operator!r}")


def filter_all(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Rows that meet every filter; the predicates reach the scan."""
    need(df, [f.field for f in filters])
    return df.where(reduce(lambda a, b: a & b, map(condition, filters))) if filters else df


def aggregate_columns(df: DataFrame, aggregates: Sequence[Aggregate]) -> list[Column]:
    need(df, [a.field for a in aggregates if a.field not in (None, "*")])
    out = []
    for a in aggregates:
        if a.function not in _AGGREGATES:
            raise SpecError(f"unsupported aggregate {a.function!r}")
        if a.field in (None, "*"):
            if a.function != "count":
                raise SpecError(f"{a.function} needs a field")
            out.append(F.count(F.lit(1)).alias(a.name))
        else:
            out.append(_AGGREGATES[a.function](F.col(a.field)).alias(a.name))
    return out


def group_aggregate(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Aggregate]) -> DataFrame:
    """Group keys first, then the aggregates; without keys one row."""
    need(df, keys)
    if keys and not aggregates:
        raise SpecError("grouping needs an aggregate")
    columns = aggregate_columns(df, aggregates)
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def matched_count(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Number of rows that meet the filters, before grouping and limit."""
    return filter_all(df, filters).agg(F.count(F.lit(1)).alias("matched_rows"))


def order_by(df: DataFrame, keys: Sequence[Sort]) -> DataFrame:
    need(df, [k.field for k in keys])

    def key(k: Sort) -> Column:
        c = F.col(k.field)
        if k.descending:
            return c.desc_nulls_first() if k.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if k.nulls_first else c.asc_nulls_last()

    return df.orderBy(*map(key, keys)) if keys else df


def bounded_limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(max(1, min(n, MAX_RESULT_ROWS)))


@dataclass
class TableResult:
    """A result and the facts about it; counting is left to the caller of facts().

    facts() reads the source once: a result that is not grouped has as many rows as match, up to its limit, and
    of a grouped one the groups are counted with their rows."""

    data: DataFrame
    matched: DataFrame
    limit: int
    deterministic_order: bool

    def facts(self) -> dict:
        if self.grouped:
            groups, matched = self.groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("__rows"), F.lit(0))).first()
            returned = min(groups, self.limit)
        else:
            matched = self.matched.first()["matched_rows"]
            returned = min(matched, self.limit)
        schema = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in self.data.schema]
        return {
            "columns": self.data.columns, "schema": schema, "returned_rows": returned, "matched_rows": matched,
            "truncated": returned == self.limit if self.grouped else matched > returned, "deterministic_order": self.deterministic_order,
        }

    grouped: bool = False
    #: Of a grouped result: its groups with the numbers of their rows.
    groups: DataFrame | None = None


def table_query(df: DataFrame, q: TableQuery) -> TableResult:
    """Filters, then groups or projects, then orders and limits; one pass for the data."""
    if q.group_by and not q.aggregates:
        raise SpecError("grouping needs an aggregate")
    if q.aggregates and (extra := [c for c in q.select if c not in q.group_by]):
        raise SpecError(f"selected fields must be grouped: {', '.join(extra)}")
    rows = filter_all(df, q.filters)
    made = group_aggregate(rows, q.group_by, q.aggregates) if q.aggregates else rows
    ordered = order_by(made, q.order_by)
    data = bounded_limit(ordered if q.aggregates else project(ordered, q.select), q.limit)
    return TableResult(data, matched_count(df, q.filters), max(1, min(q.limit, MAX_RESULT_ROWS)), bool(q.order_by) or bool(q.aggregates) and not q.group_by, bool(q.aggregates), rows.groupBy(*q.group_by).agg(F.count(F.lit(1)).alias("__rows")) if q.aggregates else None)


def preview(df: DataFrame, limit: int, index: str = "source_index") -> DataFrame:
    """The first source records, as text."""
    first = df.orderBy(index).limit(max(1, min(limit, MAX_PREVIEW_ROWS)))
    return first.select(*(F.col(c) if c == index else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))


def source_rows(df: DataFrame, indices: Sequence[int], select: Sequence[str] = (), index: str = "source_index") -> DataFrame:
    """Exactly these rows, in the order asked for (column ``position``).

    At most MAX_SOURCE_ROWS different indices; the list is small, so it is
    broadcast, and the largest index prunes the scan. Use :func:`missing_rows`
    to find indices that the source does not have.
    """
    need(df, [index, *select])
    if not indices:
        raise SpecError("no row asked for")
    if len(indices) > MAX_SOURCE_ROWS:
        raise SpecError(f"at most {MAX_SOURCE_ROWS} rows at once")
    if len(set(indices)) != len(indices):
        raise SpecError("a row is asked for twice")
    if min(indices) < 0:
        raise SpecError("row indices are not negative")
    asked = _asked(df, indices, index)
    rows = df.where(F.col(index).between(min(indices), max(indices))).join(F.broadcast(asked), index)
    return rows.select("position", index, *(select or [c for c in df.columns if c != index])).orderBy("position")


def missing_rows(df: DataFrame, indices: Sequence[int], index: str = "source_index") -> DataFrame:
    return _asked(df, indices, index).join(df.select(index), index, "left_anti").select(index)


def _asked(df: DataFrame, indices: Sequence[int], index: str) -> DataFrame:
    schema = T.StructType([T.StructField("position", T.LongType()), T.StructField(index, T.LongType())])
    return df.sparkSession.createDataFrame(list(enumerate(indices)), schema)


def constraint_filter(df: DataFrame, variables: Sequence[str], constraints: Sequence[Filter]) -> DataFrame:
    """Subset of a table service: declared variables and comparisons on them."""
    allowed = {"=", "!=", "<", "<=", ">", ">="}
    if bad := [c.operator for c in constraints if c.operator not in allowed]:
        raise SpecError(f"unsupported constraint {bad[0]!r}")
    return project(filter_all(df, constraints), variables)


def temporal_bounds(df: DataFrame, time: str, start=None, end=None, constraints: Sequence[Filter] = ()) -> DataFrame:
    """Adds bounds on time unless a constraint already gives one of that side."""
    below = any(c.field == time and c.operator in (">", ">=", "=") for c in constraints)
    above = any(c.field == time and c.operator in ("<", "<=", "=") for c in constraints)
    df = filter_all(df, constraints)
    if start is not None and not below:
        df = df.where(F.col(time) >= F.lit(start))
    if end is not None and not above:
        df = df.where(F.col(time) <= F.lit(end))
    return df


def numeric_series_melt(df: DataFrame, fields: Sequence[str], index: str = "source_index", limit: int | None = None) -> DataFrame:
    """(row, field, value) of every cell that parses as a number."""
    need(df, [index, *fields])
    rows = df.select(F.col(index).alias("row"), *(F.col(f).cast("string").alias(f) for f in fields))
    rows = rows.where(F.col("row") < limit) if limit is not None else rows
    long = rows.unpivot("row", list(fields), "field", "text")
    return long.select("row", "field", F.expr("try_cast(trim(text) AS double)").alias("value")).where("value is not null")


def stride_sample(df: DataFrame, budget: int, index: str = "source_index") -> DataFrame:
    """Every stride-th source row, stride = ceil(rows / budget)."""
    stride = max(1, -(-df.count() // budget))
    return df.where(F.col(index) % stride == 0)


def class_elevation_filter(df: DataFrame, classes: Sequence[int] = (), z_min: float | None = None, z_max: float | None = None, z: str = "z", classification: str = "classification") -> DataFrame:
    """Class in the set (none: any) and elevation within inclusive bounds."""
    out = df.where(F.col(classification).isin(*classes)) if classes else df
    out = out.where(F.col(z) >= z_min) if z_min is not None else out
    return out.where(F.col(z) <= z_max) if z_max is not None else out
