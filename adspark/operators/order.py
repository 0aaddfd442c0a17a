"""Top-k, ordered walks with cursors, signatures and run-length folds."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.compile import Compiler, Typed, plain_arithmetic, scope_of
from .scan import project, value_column, where


def top_k(df: DataFrame, attrs: list[str], order: str, k: int, desc: bool = True, constraint: str = "", tie: str | None = None) -> DataFrame:
    """The first k rows by a numeric attribute; rows without a number there are skipped."""
    df = where(df, constraint)
    with plain_arithmetic(df.sparkSession):
        c = Compiler(scope_of(df))
        x = c.compile(order)
        if x.kind not in "ir" or k <= 0:
            return project(df.limit(0), attrs)
        key = x.v.desc() if desc else x.v.asc()
        extra = [F.col(tie)] if tie else []
        ok = x.v.isNotNull() if x.err is False else x.v.isNotNull() & ~x.err
        return project(df.where(ok).orderBy(key, *extra).limit(k), attrs)


@dataclass(frozen=True)
class OrderSpec:
    """Members, partition and keys of an ordered walk; a key is (expression, descending)."""

    member: str
    partition: str
    keys: tuple
    seq: str
    cluster: tuple = ()


_KIND = {"u": 0, "e": 0, "b": 1, "i": 2, "r": 2, "s": 3}


def _sort_value(x: Typed) -> tuple[Column, Column]:
    """(kind, value): undefined before booleans before numbers before strings."""
    if x.v is None:
        return F.lit(0), F.lit(None).cast("boolean")
    return F.when(x.v.isNull(), 0).otherwise(_KIND.get(x.kind, 4)), value_column(x)


def _walk_columns(df: DataFrame, spec: OrderSpec) -> tuple[DataFrame, list]:
    c = Compiler(scope_of(df))
    df = df.where(c.predicate(spec.member)).withColumn("_part", value_column(c.compile(spec.partition)))
    sort = []
    for i, (e, desc) in enumerate(spec.keys):
        kind, v = _sort_value(c.compile(e))
        df = df.withColumn(f"_kind{i}", kind).withColumn(f"_key{i}", v)
        sort += [(f"_kind{i}", desc), (f"_key{i}", desc)]
    return df.withColumn("_seq", F.col(spec.seq)), [*sort, ("_seq", False)]


def ordered(df: DataFrame, spec: OrderSpec, partition=None, after: dict | None = None) -> DataFrame:
    """Members of one partition (or of all, partition by partition) in order, strictly after a cursor row.

    Cursor: a row that a walk returned, as a dict; it holds the same columns.
    """
    with plain_arithmetic(df.sparkSession):
        df, sort = _walk_columns(df, spec)
        if partition is not None:
            df = df.where(F.col("_part") == F.lit(partition))
        if after is not None:
            past = F.lit(False)
            same = F.lit(True)
            for name, desc in sort:
                v = F.lit(after[name])
                c = F.col(name)
                if after[name] is not None:
                    past = past | (same & F.coalesce(c < v if desc else c > v, F.lit(False)))
                same = same & c.eqNullSafe(v)
            df = df.where(past)
        cols = [F.col(n).desc() if d else F.col(n).asc() for n, d in sort]
        return df.orderBy("_part", *cols)


def fnv1a(df: DataFrame, names: list[str]) -> Column:
    """FNV-1a, 64 bits, over the values' texts, each ended by a NUL, as a signed long."""
    from ..lang.interp import text_of
    from ..plans.fallback import literal
    from ..lang.interp import eval_in

    def run(pdf: pd.DataFrame) -> pd.Series:
        out = []
        for row in pdf.itertuples(index=False):
            h = 0xCBF29CE484222325
            for v in row:
                v = None if v is pd.NA or v is None or isinstance(v, float) and v != v else v
                t = text_of(eval_in(literal(v)))
                for b in (t if isinstance(t, str) else repr(t)).encode() + b"\0":
                    h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
            out.append(h - (1 << 64) if h >> 63 else h)
        return pd.Series(out, dtype="int64")

    return F.pandas_udf(run, "bigint")(F.struct(*(F.col(n) for n in names)))


def signature(names: list[str]) -> Column:
    """A cheap signature for equality alone."""
    return F.xxhash64(*(F.col(n) for n in names))


def run_lengths(df: DataFrame, partition: str, order: list, sig: str) -> DataFrame:
    """Neighbouring rows with one signature folded: first order values, signature and length of each run."""
    w = Window.partitionBy(partition).orderBy(*order)
    new = F.coalesce((~F.col(sig).eqNullSafe(F.lag(sig).over(w))).cast("int"), F.lit(1))
    new = F.when(F.row_number().over(w) == 1, 1).otherwise(new)
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(partition, "_run").agg(F.first(sig).alias(sig), F.count(F.lit(1)).alias("length")).withColumnRenamed("_run", "run")
