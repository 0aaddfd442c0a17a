"""The evaluator over Arrow batches, for expressions without a static column form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lang.interp import Scoped, eval_in, text_of
from ..lang.syntax import ERROR, UNDEFINED, Ad, ListOf, Lit, RecordOf, parse_expr, refs, calls

UNDEF_TAG, ERROR_TAG, BOOL_TAG, INT_TAG, REAL_TAG, STRING_TAG, OTHER_TAG = range(7)
VALUE = "t tinyint, i bigint, d double, s string"


def literal(v):
    """A host value as an expression."""
    if v is None or v is pd.NaT:
        return Lit(UNDEFINED)
    if isinstance(v, dict):
        return RecordOf(tuple((k, literal(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return literal(v.asDict())
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return ListOf(tuple(map(literal, v)))
    if isinstance(v, pd.Timestamp) or hasattr(v, "timestamp"):
        return Lit(int(pd.Timestamp(v).timestamp()))
    return Lit(v) if isinstance(v, (bool, int, float, str)) else Lit(str(v))


def tagged(v) -> tuple:
    """(tag, integer, real, string) of a value."""
    if v is UNDEFINED:
        return UNDEF_TAG, None, None, None
    if v is ERROR:
        return ERROR_TAG, None, None, None
    if isinstance(v, bool):
        return BOOL_TAG, int(v), None, None
    if isinstance(v, int):
        return INT_TAG, v, None, None
    if isinstance(v, float):
        return REAL_TAG, None, v, None
    if isinstance(v, str):
        return STRING_TAG, None, None, v
    t = text_of(v)
    return OTHER_TAG, None, None, t if isinstance(t, str) else "[]" if isinstance(v, Scoped) else None


def evaluated(df: DataFrame, text: str, now: int | None = None) -> Column:
    """The expression's value in each row, as a tagged struct. Only the columns it reads are sent."""
    e = parse_expr(text)
    every = bool(calls(e) & {"eval", "unparse"})
    want = {r.name.lower() for r in refs(e)}
    names = [c for c in df.columns if every or c.lower() in want]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = {n: pdf[n].astype(object).where(pdf[n].notna(), None).tolist() for n in names}
        out = [tagged(eval_in(e, Ad.of((n, literal(cols[n][i])) for n in names if cols[n][i] is not None), now=now)) for i in range(len(pdf))]
        return pd.DataFrame(
            {
                "t": pd.array([o[0] for o in out], "Int8"), "i": pd.array([o[1] for o in out], "Int64"),
                "d": pd.Series([o[2] for o in out], dtype=object), "s": pd.Series([o[3] for o in out], dtype=object),
            }
        )

    src = [F.col(f"`{n}`") for n in names] or [F.lit(1).alias("_")]
    return F.pandas_udf(run, VALUE)(F.struct(*src))
