"""Records from text: the new form, the old form and JSON; shredding into typed columns; text back out.

A parsed record is a map of attribute names to expression texts (``ad``).
Literal attributes become typed columns by ``shred``; the rest stay texts.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.interp import is_num
from ..lang.syntax import ERROR, UNDEFINED, Ad, ListOf, Lit, ParseError, RecordOf, Unary, ad_text, is_private, old_text, parse_ads, parse_expr, parse_old_ads, unparse

_MAP = pa.map_(pa.string(), pa.string())


def _parse_files(spark: SparkSession, path: str, parse) -> DataFrame:
    """One task per file: records are not split at lines, so a file is read whole."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")

    def run(batches):
        for b in batches:
            src, idx, ads, errs = [], [], [], []
            for s, t in zip(b.column("source").to_pylist(), b.column("value").to_pylist()):
                try:
                    for i, ad in enumerate(parse(t)):
                        src.append(s)
                        idx.append(i)
                        ads.append([(n, unparse(e)) for n, e in ad.pairs()])
                        errs.append(None)
                except ParseError as e:
                    src.append(s)
                    idx.append(-1)
                    ads.append(None)
                    errs.append(str(e))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(idx, pa.int64()), pa.array(ads, _MAP), pa.array(errs, pa.string())], names=["source", "index", "ad", "error"])

    return files.mapInArrow(run, "source string, index long, ad map<string,string>, error string")


def read_new(spark: SparkSession, path: str) -> DataFrame:
    """Records in the new form: source, index, ad, and the error of a file that does not parse."""
    return _parse_files(spark, path, parse_ads)


def read_old(spark: SparkSession, path: str) -> DataFrame:
    """Records in the old form, separated by blank lines."""
    return _parse_files(spark, path, parse_old_ads)


def _parsed(df: DataFrame, column: str, parse) -> DataFrame:
    keys = [c for c in df.columns if c != column]

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(column).to_pylist():
                try:
                    ad = parse(t)
                    out.append([(n, unparse(e)) for n, e in ad.pairs()])
                except (ParseError, ValueError, TypeError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, _MAP)], names=[*keys, "ad"])

    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([df.schema[k] for k in keys] + list(_parse_datatype_string("ad map<string,string>")))
    return df.select(*keys, column).mapInArrow(run, schema)


def parse_old_column(df: DataFrame, column: str) -> DataFrame:
    """A column of old-form texts as ``ad``; null where a text does not parse."""
    return _parsed(df, column, lambda t: (parse_old_ads(t) or [Ad()])[0])


def parse_json_column(df: DataFrame, column: str) -> DataFrame:
    return _parsed(df, column, lambda t: from_json(json.loads(t)))


# -- JSON ----------------------------------------------------------------------

_EXPR = re.compile(r"/Expr\((.*)\)/\Z", re.S)


def _from_json_value(v):
    if v is None:
        return Lit(UNDEFINED)
    if isinstance(v, str):
        m = _EXPR.match(v)
        return parse_expr(m[1]) if m else Lit(v)
    if isinstance(v, list):
        return ListOf(tuple(map(_from_json_value, v)))
    if isinstance(v, dict):
        return RecordOf(tuple((k, _from_json_value(x)) for k, x in v.items()))
    if isinstance(v, float) and v.is_integer() and abs(v) < 1 << 63:
        return Lit(int(v))
    return Lit(v)


def from_json(obj: dict) -> Ad:
    return Ad.of((k, _from_json_value(v)) for k, v in obj.items())


def _to_json_value(e):
    if isinstance(e, Lit) and e.value is not ERROR:
        return None if e.value is UNDEFINED else e.value
    if isinstance(e, Unary) and e.op == "-" and isinstance(e.arg, Lit) and is_num(e.arg.value):
        return -e.arg.value
    if isinstance(e, ListOf):
        return [_to_json_value(x) for x in e.items]
    if isinstance(e, RecordOf):
        return {n: _to_json_value(x) for n, x in e.items}
    return f"/Expr({unparse(e)})/"


def to_json(ad: Ad, private: bool = False) -> str:
    """Expressions as ``"\\/Expr(...)\\/"`` strings; undefined is null; private names are left out."""
    s = json.dumps({n: _to_json_value(e) for n, e in ad.pairs() if private or not is_private(n)})
    return re.sub(r'"/Expr\(((?:[^"\\]|\\.)*)\)/"', lambda m: f'"\\/Expr({m[1]})\\/"', s)


def ad_of(texts: dict[str, str]) -> Ad:
    return Ad.of((n, parse_expr(t)) for n, t in texts.items())


def render(df: DataFrame, form: str = "new", private: bool = False, column: str = "ad") -> DataFrame:
    """A frame with an ``ad`` map gets its text: ``new``, ``old`` or ``json``."""
    how = {"new": ad_text, "old": old_text, "json": to_json}[form]
    keys = [c for c in df.columns if c != column]

    def run(batches):
        for b in batches:
            out = [None if ad is None else how(ad_of(dict(ad)), private) for ad in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, pa.string())], names=[*keys, "text"])

    from pyspark.sql.types import StringType, StructField, StructType

    return df.select(*keys, column).mapInArrow(run, StructType([df.schema[k] for k in keys] + [StructField("text", StringType())]))


# -- shredding -----------------------------------------------------------------

_KIND = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def _kind(text: str) -> str | None:
    try:
        e = parse_expr(text)
    except ParseError:
        return None
    if isinstance(e, Unary) and e.op == "-" and isinstance(e.arg, Lit) and is_num(e.arg.value):
        e = e.arg
    return _KIND.get(type(e.value)) if isinstance(e, Lit) else None


def infer(ads: DataFrame, presence: float = 0.5, sample: int = 1000) -> dict[str, str]:
    """Folded attribute names worth a column, by their dominant literal kind in a bounded sample.

    The sample decides the layout only; rows that do not fit keep their texts.
    """
    rows = [dict(r[0]) for r in ads.select("ad").where("ad IS NOT NULL").limit(sample).collect()]
    seen: dict[str, Counter] = {}
    for ad in rows:
        for n, t in ad.items():
            seen.setdefault(n.lower(), Counter())[_kind(t)] += 1
    out = {}
    for n, c in sorted(seen.items()):
        kinds = [(k, m) for k, m in c.most_common() if k]
        if kinds and kinds[0][1] >= presence * len(rows):
            out[n] = kinds[0][0]
    return out


def shred(ads: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Typed columns for literal attributes, the rest as texts in ``_expr`` (by folded name)."""
    columns = columns if columns is not None else infer(ads)
    keys = [c for c in ads.columns if c != "ad"]
    kinds = {"boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    hosts = {"boolean": bool, "bigint": int, "double": float, "string": str}

    def run(batches):
        for b in batches:
            cols: dict[str, list] = {n: [] for n in columns}
            rest = []
            for ad in b.column("ad").to_pylist():
                own = {n.lower(): t for n, t in ad or []}
                for n, kind in columns.items():
                    v = None
                    if n in own:
                        e = parse_expr(own[n])
                        if isinstance(e, Unary) and e.op == "-" and isinstance(e.arg, Lit) and is_num(e.arg.value):
                            e = Lit(-e.arg.value)
                        if isinstance(e, Lit) and type(e.value) is hosts[kind]:
                            v = e.value
                            del own[n]
                    cols[n].append(v)
                rest.append(list(own.items()))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keys), *(pa.array(cols[n], kinds[k]) for n, k in columns.items()), pa.array(rest, _MAP)], names=[*keys, *columns, "_expr"]
            )

    from pyspark.sql.types import StructType, _parse_datatype_string

    ddl = ", ".join([*(f"`{n}` {k}" for n, k in columns.items()), "_expr map<string,string>"])
    return ads.select(*keys, "ad").mapInArrow(run, StructType([ads.schema[k] for k in keys] + list(_parse_datatype_string(ddl))))
