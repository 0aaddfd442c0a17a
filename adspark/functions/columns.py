"""Column forms of the functions; those without one are left to the evaluator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.compile import (
    BadPattern, E, INF, U, Compiler, Typed, Untyped, _all_some, _err_col, _failed, _or, _some, _undefined, as_int, as_real, ascii_fold, literal_pattern,
)


def text(x: Typed) -> Typed:
    """The string coercion."""
    if x.kind in "ue" or x.kind == "s":
        return x
    if x.kind == "b":
        return Typed("s", F.when(x.v, "true").when(~x.v, "false"), x.err)
    if x.kind == "i":
        return Typed("s", x.v.cast("string"), x.err)
    if x.kind == "r":
        s = F.format_string("%1.15E", x.v)
        odd = F.when(F.isnan(x.v), 'real("NaN")').when(x.v == INF, 'real("INF")').when(x.v == -INF, 'real("-INF")').when(x.v == 0, "0.0").otherwise(s)
        return Typed("s", F.when(x.v.isNotNull(), odd), x.err)
    raise Untyped("text of a list")


def _strings(*xs: Typed):
    """The error column if all are strings; a failed result or literal otherwise."""
    if any(x.kind == "e" for x in xs):
        return E
    if any(x.kind == "u" for x in xs):
        return _undefined(*xs)
    if any(x.kind != "s" for x in xs):
        return _failed(*xs)
    return None


def strcat(c: Compiler, xs: list[Typed]) -> Typed:
    xs = [text(x) for x in xs]
    if any(x.err is not False for x in xs) or any(x.kind in "ue" for x in xs):
        for x in xs:
            if x.kind in "ue":
                return x if x is xs[0] else _raise("strcat with a literal that is no string")
        raise Untyped("strcat with errors")
    return Typed("s", F.concat(*(x.v for x in xs)) if xs else F.lit(""))


def _raise(what: str):
    raise Untyped(what)


def substr(c, xs):
    s, off, *rest = xs
    if any(x.kind == "u" for x in xs):
        return U
    if any(x.kind == "e" for x in xs):
        return E
    if s.kind != "s" or off.kind != "i" or rest and rest[0].kind != "i":
        return _failed(*xs)
    b = s.v.cast("binary")
    n, o = F.length(b), off.v.cast("int")
    start = F.when(o < 0, F.greatest(n + o, F.lit(0))).otherwise(F.least(o, n))
    stop = n
    if rest:
        k = rest[0].v.cast("int")
        stop = F.when(k >= 0, F.least((start.cast("bigint") + k).cast("bigint"), n.cast("bigint")).cast("int")).otherwise(n + k)
    v = F.call_function("substring", b, (start + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int")).cast("string")
    return Typed("s", F.when(_all_some(*xs), v), _or(*(x.err for x in xs)))


def size(c, xs):
    (x,) = xs
    if x.kind in "ue":
        return x
    if x.kind == "s":
        return Typed("i", F.octet_length(x.v).cast("bigint"), x.err)
    if x.kind == "l":
        return Typed("i", F.when(x.v.isNotNull(), F.size(x.v).cast("bigint")), x.err)
    return _failed(x)


def _case(f):
    def g(c, xs):
        x = text(xs[0])
        return x if x.kind in "ue" else Typed("s", f(x.v), x.err)

    return g


def _order(low: bool):
    def g(c, xs):
        a, b = map(text, xs)
        if "u" in (a.kind, b.kind):
            return U
        if "e" in (a.kind, b.kind):
            return E
        x, y = (F.lower(t.v) if low else t.v for t in (a, b))
        return Typed("i", F.when(x < y, -1).when(x > y, 1).when(x == y, 0).cast("bigint"), _or(a.err, b.err))

    return g


def _user(order: bool):
    def g(c, xs):
        bad = _strings(*xs)
        if bad is not None:
            return bad
        s = xs[0].v
        at = F.instr(s, "@")
        a, b = F.substring_index(s, "@", 1), F.expr("1")
        b = s.substr(at + 1, F.length(s))
        none = F.array(s, F.lit("")) if order else F.array(F.lit(""), s)
        return Typed("l", F.when(s.isNotNull(), F.when(at > 0, F.array(a, b)).otherwise(none)), xs[0].err, "s")

    return g


def regexp(c, xs):
    bad = _strings(*xs)
    if bad is not None:
        return bad
    try:
        pat = literal_pattern(xs[0], xs[2] if len(xs) > 2 else None)
    except BadPattern:
        return _failed(xs[1])
    return Typed("b", F.regexp_like(xs[1].v, F.lit(pat)), xs[1].err)


def regexp_member(c, xs):
    pat, items = xs[0], xs[1]
    if any(x.kind in "ue" for x in xs):
        return E if any(x.kind == "e" for x in xs) else U
    try:
        p = literal_pattern(pat, xs[2] if len(xs) > 2 else None)
    except BadPattern:
        return _failed(items)
    if items.kind != "l" or items.item != "s":
        raise Untyped("regexpMember over other lists")
    return Typed("b", F.when(items.v.isNotNull(), F.exists(items.v, lambda x: F.coalesce(F.regexp_like(x, F.lit(p)), F.lit(False)))), items.err)


def _java_template(template: str) -> str:
    """A Go replacement template in Java's terms."""
    import re

    out, i = "", 0
    while i < len(template):
        m = re.compile(r"\$\$|\$\{(\d+)\}|\$(\w+)").match(template, i)
        if m is None:
            ch = template[i]
            out += "\\" + ch if ch in "\\$" else ch
            i += 1
        elif m[0] == "$$":
            out += "\\$"
            i = m.end()
        else:
            name = m[1] or m[2]
            if not name.isdigit() or len(name) > 1 or re.match(r"\d", template[m.end() : m.end() + 1]):
                raise Untyped("template with a named group")
            out += f"${name}"
            i = m.end()
    return out


def regexps(c, xs):
    bad = _strings(*xs)
    if bad is not None:
        return bad
    try:
        pat = literal_pattern(xs[0], xs[3] if len(xs) > 3 else None)
    except BadPattern:
        return _failed(xs[1], xs[2])
    if not isinstance(xs[2].lit, str):
        raise Untyped("replacement that is no literal")
    import re

    groups = re.compile(pat).groups
    template = _java_template(xs[2].lit)
    if any(int(g) > groups for g in re.findall(r"(?<!\\)\$(\d)", template)):
        raise Untyped("template with a group that is not there")
    return Typed("s", F.regexp_replace(xs[1].v, F.lit(pat), F.lit(template)), xs[1].err)


def tokens(s: Typed, delims: Typed | None):
    """The trimmed tokens of a delimited list that are not empty."""
    if delims is not None and not isinstance(delims.lit, str):
        raise Untyped("delimiters that are no literal")
    d = delims.lit if delims is not None else ", "
    if not d:
        raise Untyped("no delimiters")
    cls = "[" + "".join("\\" + ch if not ch.isalnum() and not ch.isspace() else ch for ch in d) + "]"
    return F.filter(F.transform(F.split(s.v, cls), lambda x: F.regexp_replace(x, r"^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$", "")), lambda x: x != "")


def _list_member(low: bool):
    def g(c, xs):
        x, s = xs[0], xs[1]
        if "e" in (x.kind, s.kind):
            return E
        if x.kind == s.kind == "u":
            return U
        if x.kind == "u" or s.kind == "u":
            raise Untyped("undefined list")
        if x.kind != "s" or s.kind != "s":
            raise Untyped("member of other types")
        own = tokens(Typed("s", F.coalesce(s.v, F.lit(""))), xs[2] if len(xs) > 2 else None)
        key = F.coalesce(x.v, F.lit(""))
        v = F.array_contains(F.transform(own, F.lower), F.lower(key)) if low else F.array_contains(own, key)
        return Typed("b", F.when(x.v.isNotNull() | s.v.isNotNull(), v), _or(x.err, s.err))

    return g


def list_size(c, xs):
    s = xs[0]
    if s.kind != "s":
        return E
    return Typed("i", F.when(s.v.isNotNull(), F.size(tokens(s, xs[1] if len(xs) > 1 else None)).cast("bigint")), _or(s.err, s.v.isNull()))


def _two_lists(subset: bool):
    def g(c, xs):
        bad = _strings(*xs[:2])
        if bad is not None:
            if subset and any(x.kind == "u" for x in xs[:2]):
                raise Untyped("undefined list")
            return bad
        d = xs[2] if len(xs) > 2 else None
        a, b = tokens(xs[0], d), tokens(xs[1], d)
        some = _all_some(*xs[:2])
        if not subset:
            return Typed("b", F.when(some, F.arrays_overlap(a, b)), _or(xs[0].err, xs[1].err))
        x, y = (F.coalesce(t.v, F.lit("")) for t in xs[:2])
        a, b = tokens(Typed("s", x), d), tokens(Typed("s", y), d)
        v = F.when(x == "", True).otherwise((F.size(a) > 0) & (F.size(F.array_except(a, b)) == 0))
        return Typed("b", F.when(xs[0].v.isNotNull() | xs[1].v.isNotNull(), v), _or(xs[0].err, xs[1].err))

    return g


def _rounded(f):
    def g(c, xs):
        (x,) = xs
        if x.kind in "ue" or x.kind in "lR":
            return E
        if x.kind == "s":
            raise Untyped("rounding of text")
        v = as_int(x) if x.kind in "bi" else whole(f(x.v))
        return Typed("i", v, _or(x.err, x.v.isNull()))

    return g


def whole(c):
    """A double as an integer: NaN is 0, the ends saturate (Spark's plain cast does both)."""
    return c.cast("bigint")


def int_of(c, xs):
    (x,) = xs
    if x.kind in "ue":
        return x
    if x.kind in "bi":
        return Typed("i", as_int(x), x.err)
    if x.kind == "r":
        return Typed("i", whole(x.v), x.err)
    if x.kind == "s":
        raise Untyped("int of text")
    return _failed(x)


def real_of(c, xs):
    (x,) = xs
    if x.kind in "ue":
        return x
    if x.kind in "bir":
        return Typed("r", as_real(x), x.err)
    if x.kind == "s":
        raise Untyped("real of text")
    return _failed(x)


def bool_of(c, xs):
    (x,) = xs
    if x.kind in "ue" or x.kind == "b":
        return x
    if x.kind in "ir":
        return Typed("b", x.v != 0, x.err)
    if x.kind == "s":
        low = F.lower(x.v)
        return Typed("b", F.when(low == "true", True).when(low == "false", False), x.err)
    return _failed(x)


def power(c, xs):
    a, b = xs
    if any(x.kind in "ue" or x.kind in "lR" for x in xs):
        return E
    if any(x.kind == "s" for x in xs):
        raise Untyped("power of text")
    bad = _or(a.err, b.err, ~_all_some(a, b))
    p = F.pow(as_real(a), as_real(b))
    if a.kind == b.kind == "i":
        if not (isinstance(b.lit, int) and b.lit >= 0):
            raise Untyped("power with an unknown sign")
        return Typed("i", whole(F.when(p >= 0, F.floor(p + 0.5)).otherwise(F.ceil(p + 0.5)).cast("double")), bad)
    return Typed("r", p, bad)


def quantize(c, xs):
    a, b = xs
    if a.kind == "i" and b.kind == "i" and isinstance(b.lit, int) and b.lit > 0:
        return Typed("i", F.call_function("div", a.v + F.lit(b.lit - 1).cast("bigint"), b.v) * b.v, _or(a.err, a.v.isNull()))
    if a.kind in "ir" and b.kind in "ir" and "r" in (a.kind, b.kind) and b.lit and abs(b.lit) > 1e-8:
        return Typed("r", F.ceil(as_real(a) / as_real(b)).cast("double") * as_real(b), _or(a.err, a.v.isNull()))
    raise Untyped("quantize")


def _aggregate(what):
    def g(c, xs):
        (x,) = xs
        if x.kind in "ue":
            return x
        if x.kind != "l":
            return _failed(x)
        if x.item == "s":
            live = F.size(F.filter(x.v, lambda t: t.isNotNull())) > 0
            if what in ("sum", "avg"):
                return Typed("i", F.when(x.v.isNotNull() & ~live, F.lit(0).cast("bigint")), _or(x.err, F.coalesce(live & x.v.isNotNull(), F.lit(False))))
            return Typed("i", F.lit(None).cast("bigint"), _or(x.err, F.coalesce(live & x.v.isNotNull(), F.lit(False))))
        if x.item == "b":
            raise Untyped("booleans in a list")
        live = F.filter(x.v, lambda t: t.isNotNull())
        n = F.size(live)
        some = x.v.isNotNull()
        if what in ("min", "max"):
            return Typed(x.item, (F.array_min if what == "min" else F.array_max)(live), x.err)
        zero = F.lit(0).cast("bigint") if x.item == "i" and what == "sum" else F.lit(0.0)
        total = F.aggregate(live, zero, lambda s, t: s + (t if what == "sum" else t.cast("double")))
        if what == "avg":
            return Typed("r", F.when(some, F.when(n > 0, total / n).otherwise(0.0)), x.err)
        return Typed(x.item, F.when(some, total), x.err)

    return g


def _test(f):
    def g(c, xs):
        return Typed("b", f(xs[0]))

    return g


def _is_kind(kind: str):
    def f(x):
        return _some(x) if x.kind == kind else F.lit(False)

    return _test(f)


def is_undefined(x):
    if x.kind == "e":
        return F.lit(False)
    empty = x.v.isNull() if x.v is not None else F.lit(True)
    return empty if x.err is False else empty & ~_err_col(x.err)


def member(c, xs):
    x, items = xs
    if "u" in (x.kind, items.kind):
        return U
    if "e" in (x.kind, items.kind):
        return E
    if items.kind != "l" or x.kind in "lR":
        return _failed(x, items)
    number = x.kind in "bir" and items.item in "bir"
    if not number and not (x.kind == items.item == "s"):
        v = F.lit(False)
    elif number:
        v = F.exists(items.v, lambda y: F.coalesce(y.cast("double") == as_real(x), F.lit(False)))
    else:
        v = F.exists(items.v, lambda y: F.coalesce(ascii_fold(y) == ascii_fold(x.v), F.lit(False)))
    return Typed("b", F.when(_all_some(x, items), v), _or(x.err, items.err))


def identical_member(c, xs):
    x, items = xs
    if items.kind in "ue":
        return items
    if items.kind != "l" or x.kind in "lR":
        return _failed(items)
    if x.kind == "e":
        return Typed("b", F.when(items.v.isNotNull(), F.lit(False)))
    if x.kind == "u":
        v = F.exists(items.v, lambda y: y.isNull())
    elif x.kind == items.item:
        v = F.exists(items.v, lambda y: y.eqNullSafe(x.v))
    else:
        v = x.v.isNull() & F.exists(items.v, lambda y: y.isNull())
    return Typed("b", F.when(items.v.isNotNull(), v), items.err)


def _compare_any(every: bool):
    def g(c, xs):
        op, items, x = xs
        if not isinstance(op.lit, str) or items.kind != "l":
            raise Untyped("comparison over a list")
        name = {"=?=": "is", "=!=": "isnt"}.get(op.lit, op.lit.lower())
        if name not in ("<", "<=", ">", ">=", "==", "!="):
            raise Untyped("operator")
        sure = Compiler.compare(name, Typed(items.item, F.lit(None)), x)
        if sure.kind == "u":
            return Typed("b", F.when(items.v.isNotNull(), (F.size(items.v) == 0) if every else F.lit(False)), items.err)
        if sure.err is not False:
            raise Untyped("comparison of other types")
        f = F.forall if every else F.exists
        v = f(items.v, lambda y: F.coalesce(Compiler.compare(name, Typed(items.item, y), x).v, F.lit(False)))
        return Typed("b", F.when(items.v.isNotNull(), v), items.err)

    return g


def if_then_else(c, xs):
    return Compiler.choose(*xs)


def now(c, xs):
    return Typed("i", F.lit(c.now).cast("bigint"))


def random(c, xs):
    if not xs:
        return Typed("r", F.rand())
    (x,) = xs
    if x.kind == "i" and isinstance(x.lit, int) and x.lit > 0:
        return Typed("i", F.floor(F.rand() * x.lit).cast("bigint"))
    if x.kind in "ir":
        return Typed("r", F.rand() * as_real(x), x.err)
    raise Untyped("random")


def interval(c, xs):
    (x,) = xs
    if x.kind in "ue" or x.kind in "lR":
        return E
    if x.kind == "s":
        raise Untyped("interval of text")
    n = (as_int(x) if x.kind in "bi" else whole(x.v)).cast("int").cast("bigint")
    sign, a = F.when(n < 0, "-").otherwise(""), F.abs(n)
    div = lambda p, q: F.call_function("div", p, F.lit(q).cast("bigint"))
    d, h, m, s = div(a, 86400), div(a, 3600) % 24, div(a, 60) % 60, a % 60
    v = (
        F.when(d > 0, F.format_string("%s%d+%02d:%02d:%02d", sign, d, h, m, s))
        .when(h > 0, F.format_string("%s%d:%02d:%02d", sign, h, m, s))
        .when(m > 0, F.format_string("%s%d:%02d", sign, m, s))
        .otherwise(F.format_string("%s%d", sign, s))
    )
    return Typed("s", F.when(x.v.isNotNull(), v), _or(x.err, x.v.isNull()))


#: format code: Java pattern
_CODES = {
    "a": "EEE", "A": "EEEE", "b": "MMM", "B": "MMMM", "c": "EEE MMM d HH:mm:ss yyyy", "d": "dd", "H": "HH", "I": "hh", "j": "DDD", "m": "MM", "M": "mm", "p": "a", "S": "ss",
    "x": "MM/dd/yy", "X": "HH:mm:ss", "y": "yy", "Y": "yyyy",
}


def format_time(c, xs):
    t = xs[0] if xs else now(c, [])
    fmt = xs[1] if len(xs) > 1 else Typed("s", F.lit("%c"), lit="%c")
    if any(x.kind in "ue" for x in (t, fmt)):
        return E if "e" in (t.kind, fmt.kind) else U
    if t.kind not in "bir" or not isinstance(fmt.lit, str):
        raise Untyped("format of other types")
    import re

    parts = []
    for m in re.finditer(r"%(.)|([^%]+|%$)", fmt.lit, re.S):
        if m[1] is None:
            parts.append(F.lit(m[2]))
        elif m[1] in _CODES:
            stamp = F.to_utc_timestamp(F.timestamp_seconds(as_int(t) if t.kind != "r" else whole(t.v)), F.current_timezone())
            # the session zone is taken out, so the text is in UTC whatever it is
            parts.append(F.date_format(F.from_utc_timestamp(stamp, "UTC"), _CODES[m[1]]))
        elif m[1] == "%":
            parts.append(F.lit("%"))
        else:
            raise Untyped(f"format code {m[1]}")
    return Typed("s", F.concat(*parts) if parts else F.lit(""), t.err)


def string_of(c, xs):
    return text(xs[0])


FUNCTIONS = {
    "strcat": strcat, "substr": substr, "size": size, "tolower": _case(F.lower), "toupper": _case(F.upper), "strcmp": _order(False), "stricmp": _order(True), "string": string_of,
    "splitusername": _user(True), "splitslotname": _user(False), "regexp": regexp, "regexpmember": regexp_member, "regexps": regexps, "replaceall": regexps,
    "stringlistmember": _list_member(False), "stringlistimember": _list_member(True), "stringlistsize": list_size, "stringlistsintersect": _two_lists(False), "stringlistsubsetmatch": _two_lists(True),
    "floor": _rounded(F.floor), "ceiling": _rounded(F.ceil), "ceil": _rounded(F.ceil), "round": _rounded(F.rint), "random": random, "int": int_of, "real": real_of, "bool": bool_of,
    "pow": power, "quantize": quantize, "sum": _aggregate("sum"), "avg": _aggregate("avg"), "min": _aggregate("min"), "max": _aggregate("max"),
    "isundefined": _test(is_undefined), "iserror": _test(lambda x: F.lit(True) if x.kind == "e" else _err_col(x.err)), "isstring": _is_kind("s"), "isinteger": _is_kind("i"), "isreal": _is_kind("r"),
    "isboolean": _is_kind("b"), "islist": _is_kind("l"), "isclassad": _is_kind("R"), "member": member, "identicalmember": identical_member,
    "anycompare": _compare_any(False), "allcompare": _compare_any(True), "ifthenelse": if_then_else, "time": now, "interval": interval, "formattime": format_time,
}
