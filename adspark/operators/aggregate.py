"""Grouped aggregates with the language's rules for what is undefined or an error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import text
from ..plans.compile import Compiler, Typed, Untyped, as_int, as_real, plain_arithmetic, scope_of, true_of
from .scan import where


@dataclass(frozen=True)
class Agg:
    """COUNT, SUM, AVG, MIN, MAX or COUNT DISTINCT of an expression ("*" for rows), over rows where ``only`` is true."""

    func: str
    arg: str = "*"
    only: str = ""
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or f"{self.func.lower().replace(' ', '_')}_{self.arg}"


@dataclass(frozen=True)
class Group:
    """A grouping column; with a width, floor(x / width) * width, and rows without a number are dropped."""

    column: str
    width: int | None = None
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or self.column


def _err(x: Typed) -> Column:
    return F.lit(x.err) if isinstance(x.err, bool) else x.err


def group_key(x: Typed) -> Column:
    """The key's column. Text keys spell undefined and error out, so each is one group with its own spelling."""
    if x.v is None:
        return F.lit("error" if x.kind == "e" else "undefined")
    if x.kind == "s":
        key = F.coalesce(x.v, F.lit("undefined"))
        return key if x.err is False else F.when(x.err, "error").otherwise(key)
    return x.v


def bucket(x: Typed, width: int) -> Column:
    """The bucket's start, null where there is no number."""
    if x.kind not in "ir":
        return F.lit(None).cast("bigint")
    if x.kind == "i":
        return F.call_function("div", x.v - F.pmod(x.v, F.lit(width).cast("bigint")), F.lit(1).cast("bigint"))
    return (F.floor(x.v / width) * width).cast("bigint")


def _one(c: Compiler, a: Agg) -> list[Column]:
    keep = c.predicate(a.only) if a.only else None
    some = lambda v: v if keep is None else F.when(keep, v)
    func, label = a.func.upper(), a.label
    if a.arg == "*":
        if func != "COUNT":
            raise ValueError(f"{a.func} of *")
        return [F.count(some(F.lit(1))).alias(label)]
    x = c.compile(a.arg)
    if x.v is None:
        x = Typed("i", F.lit(None).cast("bigint"), x.kind == "e")
    if func == "COUNT":
        return [F.count(some(x.v)).alias(label)]
    if func == "COUNT DISTINCT":
        return [F.count_distinct(some(text(x).v if x.kind == "b" else x.v)).alias(label)]
    # a string, list or record in the argument makes the aggregate an error: no value
    bad = _err(x) if x.kind in "bir" else _err(x) | x.v.isNotNull()
    failed = F.coalesce(F.bool_or(some(bad)), F.lit(False)) if x.err is not False or x.kind not in "bir" else None
    v = (as_int(x) if x.kind in "bi" else x.v) if x.kind in "bir" else F.lit(None).cast("bigint")
    v = some(v)
    if func == "SUM":
        out = F.coalesce(F.sum(v), F.lit(0).cast("double" if x.kind == "r" else "bigint"))
    elif func == "AVG":
        out = F.coalesce(F.avg(v), F.lit(0.0))
    elif func in ("MIN", "MAX"):
        out = (F.min if func == "MIN" else F.max)(v)
    else:
        raise ValueError(a.func)
    return [(out if failed is None else F.when(~failed, out)).alias(label)]


def aggregate(df: DataFrame, groups: list[Group | str], aggs: list[Agg], constraint: str = "", now: int | None = None) -> DataFrame:
    """One row per group, or one row in all without groups. Sums wrap; partial sums combine before the shuffle."""
    groups = [Group(g) if isinstance(g, str) else g for g in groups]
    df = where(df, constraint, now)
    with plain_arithmetic(df.sparkSession):
        c = Compiler(scope_of(df), now=now)
        keys = []
        for g in groups:
            x = c.compile(g.column)
            if g.width is None:
                keys.append(group_key(x).alias(g.label))
            else:
                b = bucket(x, g.width)
                df = df.where(b.isNotNull())
                keys.append(b.alias(g.label))
        cols = [k for a in aggs for k in _one(c, a)]
        return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def numeric_stats(df: DataFrame, attr: str, constraint: str = "", group: str | None = None) -> DataFrame:
    """Number, sum, least and largest of one numeric attribute in one pass, by group if one is given."""
    aggs = [Agg("COUNT", attr, name="n"), Agg("SUM", attr, name="total"), Agg("MIN", attr, name="least"), Agg("MAX", attr, name="largest")]
    return aggregate(df, [group] if group else [], aggs, constraint)


def presence(df: DataFrame, attr: str) -> DataFrame:
    """How many rows have the attribute's value defined, undefined and in error."""
    with plain_arithmetic(df.sparkSession):
        x = Compiler(scope_of(df)).compile(attr)
        err = _err(x)
        empty = F.lit(x.kind == "u") if x.v is None else x.v.isNull() & ~err
        return df.agg(
            F.count(F.when(~empty & ~err, 1)).alias("defined"), F.count(F.when(empty, 1)).alias("undefined"), F.count(F.when(err, 1)).alias("error")
        )


def real(x: Typed) -> Column:
    return as_real(x)


__all__ = ["Agg", "Group", "Untyped", "aggregate", "bucket", "group_key", "numeric_stats", "presence", "true_of"]
