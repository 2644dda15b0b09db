"""SPARQL expressions as Catalyst columns; an error is null.

An expression is a ``Value``: a column with a Form. Where the datatype is constant everything stays in native
columns; where it varies by row a number is (tier, decimal, double) derived from the term. Tiers: 1 integer,
2 decimal, 3 float, 4 double; a result has the highest tier of its operands, integer division gives decimals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import INTEGERS, IRI, RDF, TERMS, XSD, BNode, Form, Literal, constant, lexical, lit_form, make
from .xsd import canonical, typed, valid

TIER = {"xsd:integer": 1, "xsd:decimal": 2, "xsd:float": 3, "xsd:double": 4}
TIER_TYPE = {v: k for k, v in TIER.items()}
STRING, BOOL, INT, DEC, DBL = (lit_form(f"xsd:{x}") for x in ("string", "boolean", "integer", "decimal", "double"))

#: Functions registered for calls by IRI: they take Values and return a Value.
FUNCTIONS: dict[str, Callable[..., "Value"]] = {}


def register_function(iri: str, fn: Callable[..., "Value"]) -> None:
    """Makes fn(*Values) -> Value callable in queries by its IRI."""
    FUNCTIONS[iri] = fn


@dataclass(frozen=True)
class Value:
    col: Column
    form: Form
    const: Literal | IRI | None = None
    void: bool = False  # never bound

    def term(self) -> Column:
        return self.form.term(self.col)

    @property
    def dt(self) -> str:
        return self.form.datatype if self.form.kind == "lit" else ""


def unbound() -> Value:
    return Value(F.lit(None).cast("string"), STRING, None, True)


def let(cols: list[Column], fn: Callable[..., Column]) -> Column:
    """fn of columns that are evaluated once: fn may use them often without copies of their expressions in the plan."""
    one = F.struct(*[c.alias(f"a{i}") for i, c in enumerate(cols)])
    return F.get(F.transform(F.array(one), lambda z: fn(*[z[f"a{i}"] for i in range(len(cols))])), F.lit(0))


def let_values(args: list[Value], fn: Callable[[list[Value]], Value]) -> Value:
    """fn of values; where one of them varies in type, its column stands in the result once."""
    if not any(a.form.kind == "term" and a.const is None for a in args):
        return fn(args)
    form: list[Form] = []

    def body(*cols: Column) -> Column:
        got = fn([Value(c, a.form, a.const) for c, a in zip(cols, args)])
        form[:] = [got.form]
        return got.col

    col = let([a.col for a in args], body)
    return Value(col, form[0])


@dataclass(frozen=True)
class Num:
    """tier is an int where it is constant; native is then the native column."""

    tier: int | Column
    native: Column | None
    dec: Column
    dbl: Column

    @property
    def tier_col(self) -> Column:
        return self.tier if isinstance(self.tier, Column) else F.lit(self.tier)

    def value(self) -> Value:
        if not isinstance(self.tier, Column):
            return Value(self.native, lit_form(TIER_TYPE[self.tier]))
        whole = F.replace(self.dec.cast("decimal(38,0)").cast("string"), F.lit(""))
        v = F.when(self.tier == 1, whole).when(self.tier == 2, lexical(self.dec, "xsd:decimal")).when(self.tier == 3, lexical(self.dbl.cast("float"), "xsd:float")).otherwise(lexical(self.dbl, "xsd:double"))
        dt = F.element_at(F.array(*[F.lit(TIER_TYPE[i]) for i in (1, 2, 3, 4)]), self.tier.cast("int"))
        return Value(F.when(self.tier.isNotNull() & v.isNotNull(), make(2, v, dt)), TERMS)


def static_num(c: Column, tier: int) -> Num:
    return Num(tier, c, c.try_cast("decimal(38,18)") if tier <= 2 else F.lit(None).cast("decimal(38,18)"), c.cast("double"))


def num(v: Value) -> Num | None:
    """The number of a value; None if it never is one."""
    if v.form.kind == "lit":
        return static_num(v.col, TIER[v.dt]) if v.dt in TIER else None
    if v.form.kind != "term":
        return None
    c = v.col
    dt, s = c["dt"], F.trim(c["v"])
    tier = F.when(dt.isin([f"xsd:{x}" for x in INTEGERS]), 1).when(dt == "xsd:decimal", 2).when(dt == "xsd:float", 3).when(dt == "xsd:double", 4)
    dec = F.when(tier <= 2, s.try_cast("decimal(38,18)"))
    text = F.when(s.isin("INF", "+INF"), "Infinity").when(s == "-INF", "-Infinity").otherwise(s)
    dbl = F.when(tier.isNotNull(), text.try_cast("double"))
    return Num(F.when(dbl.isNotNull(), tier), None, dec, dbl)


def _digits(x: Column) -> Column:
    """The digits of a decimal(38,18) without sign and point; the last 18 are its fraction."""
    return F.replace(F.abs(x).cast("string"), F.lit("."), F.lit(""))


def _pointed(digits: Column, fraction: Column | int) -> Column:
    """The decimal(38,18) of digits of which so many are the fraction; null beyond 20 digits before the point."""
    whole = F.length(digits) - F.lit(fraction) if isinstance(fraction, int) else F.length(digits) - fraction
    return F.concat(F.substr(digits, F.lit(1), whole), F.lit("."), F.substr(digits, whole + 1)).try_cast("decimal(38,18)")


def _signed(x: Column, y: Column, size: Column) -> Column:
    return F.when(F.signum(x.cast("double")) * F.signum(y.cast("double")) < 0, -size).otherwise(size).cast("decimal(38,18)")


def product(x: Column, y: Column) -> Column:
    """x * y of decimal(38,18), rounded half up to 18 fraction digits; null where it doesn't fit.

    Spark gives up fraction digits of a product beyond 38. Operands of up to nine digits on either side of the point have an exact one; else
    the 38 digits of each are multiplied in halves.
    """
    short = [v.try_cast("decimal(18,9)") for v in (x, y)]
    exact = F.try_multiply(*short).cast("decimal(38,18)")

    def long(a: Column, b: Column) -> Column:
        half = lambda v: (F.substr(v, F.lit(1), F.lit(19)).cast("decimal(38,0)"), F.substr(v, F.lit(20)).cast("decimal(38,0)"))
        (a1, a0), (b1, b0) = half(a), half(b)
        ten = lambda n: F.lit("1" + "0" * n).cast("decimal(38,0)")
        low = F.lpad(F.try_multiply(a0, b0).cast("string"), 38, "0")
        up = F.when(F.substring(low, 21, 1) >= "5", 1).otherwise(0).cast("decimal(38,0)")
        cross = F.try_multiply(F.try_add(F.try_multiply(a1, b0), F.try_multiply(a0, b1)), ten(1))
        total = F.try_add(F.try_add(F.try_multiply(F.try_multiply(a1, b1), ten(20)), cross), F.try_add(F.substring(low, 1, 20).cast("decimal(38,0)"), up))
        return _pointed(F.lpad(total.cast("string"), 38, "0"), 18)

    size = let([F.lpad(_digits(v), 38, "0") for v in (x, y)], long)
    return F.when((short[0] == x) & (short[1] == y), exact).otherwise(_signed(x, y, size))


def quotient(x: Column, y: Column) -> Column:
    """x / y of decimal(38,18), rounded half up to 18 fraction digits; null for a zero divisor and where it doesn't fit.

    Both are multiplied by the power of ten that makes the divisor an integer, whose quotient Spark gives with 18 fraction
    digits. Where the dividend then has more than 20 digits before the point the result has six.
    """
    short = [v.try_cast("decimal(20,6)") for v in (x, y)]
    exact = F.try_divide(*short).try_cast("decimal(38,18)")

    def long(a: Column, b: Column) -> Column:
        kept = F.length(F.regexp_replace(F.substr(b, F.length(b) - 17), "0+$", ""))  # fraction digits of the divisor
        divisor = F.substr(b, F.lit(1), F.length(b) - 18 + kept).cast("decimal(38,0)")
        dividend = _pointed(a, F.lit(18) - kept)
        large = F.substr(a, F.lit(1), F.length(a) - 18 + kept).try_cast("decimal(38,0)")
        return F.coalesce(F.try_divide(dividend, divisor).try_cast("decimal(38,18)"), F.when(dividend.isNull(), F.try_divide(large, divisor).try_cast("decimal(38,18)")))

    size = let([F.lpad(_digits(v), 38, "0") for v in (x, y)], long)
    return F.when(y == 0, F.lit(None).cast("decimal(38,18)")).when((short[0] == x) & (short[1] == y), exact).otherwise(_signed(x, y, size))


def arithmetic(op: str, a: Num, b: Num) -> Num:
    fn = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}.get(op)

    def decimals(x: Column, y: Column) -> Column:
        if op in "*/":
            return let([x, y], product if op == "*" else quotient)
        return fn(x, y).try_cast("decimal(38,18)")

    def doubles(x: Column, y: Column) -> Column:
        if op != "/":
            return {"+": x + y, "-": x - y, "*": x * y}[op]
        by_zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        return F.when(y.isNull() | x.isNull(), F.lit(None).cast("double")).when(y == 0, by_zero).otherwise(F.try_divide(x, y))

    if not isinstance(a.tier, Column) and not isinstance(b.tier, Column):
        tier = max(a.tier, b.tier)
        if tier == 1 and op != "/":
            return static_num(fn(a.native, b.native), 1)
        if tier <= 2:
            if tier == 1:
                return static_num(F.try_divide(a.native.try_cast("decimal(20,0)"), b.native.try_cast("decimal(20,0)")).try_cast("decimal(38,18)"), 2)
            return static_num(decimals(a.dec, b.dec), 2)
        out = doubles(a.dbl, b.dbl)
        return static_num(out.cast("float") if tier == 3 else out, tier)
    tier = F.when(a.tier_col.isNotNull() & b.tier_col.isNotNull(), F.greatest(a.tier_col, b.tier_col))
    if op == "/":
        tier = F.greatest(tier, F.when(tier.isNotNull(), 2))
    dec = F.when(tier <= 2, decimals(a.dec, b.dec))
    dbl = F.when(tier >= 3, doubles(a.dbl, b.dbl)).otherwise(dec.cast("double"))
    return Num(F.when((tier >= 3) | dec.isNotNull(), tier), None, dec, dbl)


def ebv(v: Value) -> Column:
    """Effective boolean value; null is an error."""
    if v.form.kind == "lit":
        if v.dt == "xsd:boolean":
            return v.col
        if v.dt == "xsd:string":
            return v.col != ""
        if v.dt in ("xsd:double", "xsd:float"):
            return (v.col != 0) & ~F.isnan(v.col)
        if v.dt in TIER:
            return v.col != 0
        return F.lit(None).cast("boolean")
    if v.form.kind != "term":
        return F.lit(None).cast("boolean")
    return let([v.col], lambda c: _term_ebv(Value(c, TERMS)))


def _term_ebv(v: Value) -> Column:
    c, n = v.col, num(v)
    dt = c["dt"]
    number = F.when(dt.isin(*TIER, *[f"xsd:{x}" for x in INTEGERS]), F.coalesce((n.dbl != 0) & ~F.isnan(n.dbl), F.lit(False)))
    return F.when(c["k"] != 2, F.lit(None).cast("boolean")).when(dt == "xsd:boolean", c["v"].isin("true", "1")).when(dt.isin("xsd:string", "rdf:langString"), c["v"] != "").otherwise(number)


def _instant(c: Column) -> Column:
    return canonical(c["v"], "xsd:dateTime")


def compare(op: str, a: Value, b: Value) -> Column:
    """As _compare; terms are evaluated once."""
    return let_values([a, b], lambda x: Value(_compare(op, *x), BOOL)).col


def _compare(op: str, a: Value, b: Value) -> Column:
    """= != < <= > >= with values of numbers, strings, booleans and dates; else term equality for = and !=, and an error for order."""
    apply = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    none = F.lit(None).cast("boolean")
    na, nb = num(a), num(b)
    fixed = lambda n: n is not None and not isinstance(n.tier, Column)

    def no_nan(x: Column, y: Column, out: Column) -> Column:  # Spark has NaN equal to NaN and above all
        return F.when(F.isnan(x) | F.isnan(y), F.when(x.isNotNull() & y.isNotNull(), F.lit(op == "!="))).otherwise(out)

    if fixed(na) and fixed(nb):
        if max(na.tier, nb.tier) >= 3:
            if b.const is not None and b.const.value != "NaN":  # in a form that reaches the scan; only > and >= take NaN for greater
                return apply(na.dbl, nb.dbl) & ~F.isnan(na.dbl) if op in (">", ">=") else apply(na.dbl, nb.dbl)
            return no_nan(na.dbl, nb.dbl, apply(na.dbl, nb.dbl))
        return apply(na.native, nb.native)
    if a.form.kind == b.form.kind == "lit" and a.dt == b.dt:
        return apply(a.col, b.col)
    if op in ("=", "!=") and b.const is not None and isinstance(b.const, IRI):
        same = a.form.equal(a.col, b.const)
        same = F.when(a.col.isNotNull(), F.lit(False)) if same is None else F.when(a.col.isNotNull(), F.coalesce(same, F.lit(False)))
        return same if op == "=" else ~same
    if op in ("=", "!=") and a.form == b.form and a.form.kind in ("iri", "key"):
        return apply(a.col, b.col)
    ta, tb = a.term(), b.term()
    both = a.col.isNotNull() & b.col.isNotNull()
    out = none
    if op in ("=", "!="):
        same = ta == tb
        # unequal literals of types that aren't known may still be equal values
        known = F.lit(False)
        for t in (ta, tb):
            known = known | (t["k"] != 2) | t["dt"].isin("xsd:string", "rdf:langString")
        out = F.when(both, F.when(same, F.lit(op == "=")).when(known | (ta["dt"] != tb["dt"]), F.lit(op == "!=")).otherwise(none))
    if na is not None and nb is not None:
        numbers = na.tier_col.isNotNull() & nb.tier_col.isNotNull()
        exact = (na.tier_col <= 2) & (nb.tier_col <= 2) & na.dec.isNotNull() & nb.dec.isNotNull()
        by_value = F.when(exact, apply(na.dec, nb.dec)).otherwise(no_nan(na.dbl, nb.dbl, apply(na.dbl, nb.dbl)))
        out = F.when(F.coalesce(numbers, F.lit(False)), by_value).otherwise(out)
    alike = (ta["dt"] == tb["dt"]) & (ta["k"] == 2) & (tb["k"] == 2)
    if a.form.kind == "term" or b.form.kind == "term":
        types = {x.dt for x in (a, b) if x.form.kind == "lit"}
        if not types or types == {"xsd:string"}:
            if op not in ("=", "!="):
                out = F.when(F.coalesce(alike & (ta["dt"] == "xsd:string"), F.lit(False)), apply(ta["v"], tb["v"])).otherwise(out)
        if not types or types == {"xsd:boolean"}:
            out = F.when(F.coalesce(alike & (ta["dt"] == "xsd:boolean"), F.lit(False)), apply(canonical(ta["v"], "boolean"), canonical(tb["v"], "boolean"))).otherwise(out)
        if not types or types == {"xsd:date"}:
            out = F.when(F.coalesce(alike & (ta["dt"] == "xsd:date"), F.lit(False)), apply(canonical(ta["v"], "date").try_cast("date"), canonical(tb["v"], "date").try_cast("date"))).otherwise(out)
        if not types or types == {"xsd:dateTime"}:
            out = F.when(F.coalesce(alike & (ta["dt"] == "xsd:dateTime"), F.lit(False)), apply(typed(_instant(ta), "dateTime"), typed(_instant(tb), "dateTime"))).otherwise(out)
    return out


def sort_key(v: Value) -> Column:
    """A column that sorts like SPARQL: unbound, blank nodes, IRIs, literals; numbers, dates and strings by value."""
    if v.form.kind == "lit" and (v.dt in TIER or v.dt in ("xsd:string", "xsd:boolean", "xsd:dateTime", "xsd:date")):
        return v.col
    if v.form.kind == "iri":
        return v.col
    if v.form.kind == "key":
        return v.form.text(v.col)
    return let([v.term()], _term_key)


def _term_key(c: Column) -> Column:
    n = num(Value(c, TERMS))
    dt = c["dt"]
    rank = F.when(n.tier_col.isNotNull(), 0).when(dt == "xsd:dateTime", 1).when(dt == "xsd:date", 2).when(dt == "xsd:boolean", 3).when(dt == "xsd:string", 4).when(dt == "rdf:langString", 5).otherwise(6)
    at = F.when(dt == "xsd:dateTime", typed(_instant(c), "dateTime")).when(dt == "xsd:date", canonical(c["v"], "date").try_cast("date").cast("timestamp_ntz"))
    return F.when(c.isNotNull(), F.struct(c["k"].alias("k"), F.when(c["k"] == 2, rank).alias("r"), n.dbl.alias("d"), n.dec.alias("x"), at.alias("t"), F.when(n.tier_col.isNull(), c["v"]).alias("v"), dt.alias("dt"), c["lang"].alias("lang")))


# ---- strings ----


def text(v: Value) -> Column:
    """The characters of a string literal (plain or with a language); null for anything else."""
    if v.form.kind == "lit":
        return v.col if v.dt == "xsd:string" else F.lit(None).cast("string")
    if v.form.kind != "term":
        return F.lit(None).cast("string")
    return F.when(v.col["dt"].isin("xsd:string", "rdf:langString"), v.col["v"])


def _like(v: Value, c: Column) -> Value:
    """A string with the language of v."""
    if v.form.kind == "lit":
        return Value(c, STRING)
    return Value(F.when(c.isNotNull() & v.col.isNotNull(), make(2, c, v.col["dt"], v.col["lang"])), TERMS)


def _lang(v: Value) -> Column:
    if v.form.kind == "lit":
        return F.when(v.col.isNotNull(), F.lit(""))
    if v.form.kind != "term":
        return F.lit(None).cast("string")
    return F.when(v.col["k"] == 2, F.coalesce(v.col["lang"], F.lit("")))


def _int(v: Value) -> Column:
    n = num(v)
    return F.lit(None).cast("int") if n is None else n.native.cast("int") if n.native is not None and n.tier == 1 else n.dbl.try_cast("int")


def as_str(v: Value) -> Column:
    if isinstance(v.const, Literal):
        return F.lit(v.const.value)
    c = v.form.text(v.col)
    return F.when(v.col["k"] != 0, c) if v.form.kind == "term" else c


def _flags(pattern: Value, flags: Value | None) -> Column:
    p = text(pattern)
    if flags is None:
        return p
    f = text(flags)
    quoted = F.when(f.contains("q"), F.concat(F.lit("\\Q"), p, F.lit("\\E"))).otherwise(p)
    rest = F.replace(f, F.lit("q"), F.lit(""))
    return F.when(rest == "", quoted).otherwise(F.concat(F.lit("(?"), rest, F.lit(")"), quoted))


_DT_PATTERN = r"^\s*(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})(?:T([0-9]{2}):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?))?(Z|[+-][0-9]{2}:[0-9]{2})?\s*$"


def _date_part(v: Value, i: int) -> Column:
    if v.form.kind == "lit" and v.dt in ("xsd:dateTime", "xsd:date"):
        parts = {1: F.year, 2: F.month, 3: F.dayofmonth, 4: F.hour, 5: F.minute}
        if i in parts and not (v.dt == "xsd:date" and i > 3):
            return parts[i](v.col).cast("bigint")
        if i == 6 and v.dt == "xsd:dateTime":
            return F.date_part(F.lit("SECOND"), v.col)
        return F.lit(None).cast("bigint") if i != 7 else F.when(v.col.isNotNull(), F.lit(""))
    if v.form.kind != "term":
        return F.lit(None).cast("string")
    dt = v.col["dt"]
    ok = (dt == "xsd:dateTime") | ((dt == "xsd:date") & F.lit(i in (1, 2, 3, 7)))
    x = F.when(ok & v.col["v"].rlike(_DT_PATTERN), F.regexp_extract(v.col["v"], _DT_PATTERN, i))
    return x if i == 7 else F.when(x != "", x)


def _rounded(name: str, v: Value) -> Value:
    n = num(v)
    if n is None:
        return unbound()
    half = F.lit("0.5").cast("decimal(2,1)")
    dec = {"ABS": F.abs(n.dec), "CEIL": F.ceil(n.dec), "FLOOR": F.floor(n.dec), "ROUND": F.floor(n.dec + half)}[name].try_cast("decimal(38,18)")
    # half up towards positive infinity; the sign of infinities and NaN stays
    finite = F.when(F.isnan(n.dbl) | (F.abs(n.dbl) > 1e15), n.dbl)
    dbl = {"ABS": F.abs(n.dbl), "CEIL": F.coalesce(finite, F.ceil(F.when(finite.isNull(), n.dbl)).cast("double")), "FLOOR": F.coalesce(finite, F.floor(F.when(finite.isNull(), n.dbl)).cast("double")), "ROUND": F.coalesce(finite, F.floor(F.when(finite.isNull(), n.dbl) + 0.5).cast("double"))}[name]
    if isinstance(n.tier, Column):
        return Num(n.tier, None, dec, dbl).value()
    if n.tier == 1:
        return Value(F.abs(v.col) if name == "ABS" else v.col, v.form)
    return Value(dec if n.tier == 2 else dbl.cast("float") if n.tier == 3 else dbl, v.form)


def cast_to(kind: str, v: Value) -> Value:
    """xsd:boolean, integer, decimal, float, double, string, date and dateTime casts."""
    s = v.form.text(v.col)
    n = num(v)
    lit_ok = F.lit(True) if v.form.kind == "lit" else (v.col["k"] == 2) if v.form.kind == "term" else F.lit(False)
    plain = F.lit(v.dt == "xsd:string") if v.form.kind == "lit" else (v.col["dt"] == "xsd:string") if v.form.kind == "term" else F.lit(False)
    is_bool = F.lit(v.dt == "xsd:boolean") if v.form.kind == "lit" else (v.col["dt"] == "xsd:boolean") if v.form.kind == "term" else F.lit(False)
    one = F.when(is_bool, F.when(s.isin("true", "1"), F.lit("1")).otherwise("0"))
    if kind == "string":
        return Value(as_str(v) if v.form.kind != "term" else F.when(v.col["k"] != 0, s), STRING)
    if kind == "boolean":
        by_number = F.when(n.tier_col.isNotNull(), (n.dbl != 0) & ~F.isnan(n.dbl)) if n is not None else F.lit(None).cast("boolean")
        return Value(F.coalesce(by_number, F.when(plain | is_bool, canonical(s, "boolean").try_cast("boolean"))), BOOL)
    if kind == "integer":
        by_number = F.when(n.tier_col.isNotNull() & ~F.isnan(n.dbl), F.when(n.tier_col <= 2, F.signum(n.dbl).cast("bigint") * F.floor(F.abs(n.dec)).try_cast("bigint")).otherwise(n.dbl.try_cast("bigint"))) if n is not None else F.lit(None).cast("bigint")
        return Value(F.coalesce(by_number, F.when(plain, canonical(s, "integer")).try_cast("bigint"), one.try_cast("bigint")), INT)
    if kind == "decimal":
        by_number = F.when(n.tier_col.isNotNull(), F.coalesce(n.dec, n.dbl.try_cast("decimal(38,18)"))) if n is not None else F.lit(None).cast("decimal(38,18)")
        return Value(F.coalesce(by_number, F.when(plain, canonical(s, "decimal")).try_cast("decimal(38,18)"), one.try_cast("decimal(38,18)")), DEC)
    if kind in ("double", "float"):
        by_number = F.when(n.tier_col.isNotNull(), n.dbl) if n is not None else F.lit(None).cast("double")
        x = F.coalesce(by_number, F.when(plain, canonical(s, "double")).try_cast("double"), one.try_cast("double"))
        return Value(x if kind == "double" else x.cast("float"), lit_form(f"xsd:{kind}"))
    if kind == "date":
        day = F.regexp_extract(s, r"^\s*(-?[0-9]{4,}-[0-9]{2}-[0-9]{2})", 1).try_cast("date")
        return Value(F.when(lit_ok, day), lit_form("xsd:date"))
    if kind == "dateTime":
        if v.dt == "xsd:dateTime":
            return v
        full = F.when(F.trim(s).rlike("^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}$"), F.concat(F.trim(s), F.lit("T00:00:00"))).otherwise(F.trim(s))
        return Value(F.when(lit_ok & canonical(full, "dateTime").isNotNull(), make(2, full, "xsd:dateTime")), TERMS)
    raise ValueError(kind)


def call(name: str, args: list[Value]) -> Value:
    """A built-in function other than the logical ones and those that need the query's scope."""
    if name in ("=", "!=", "<", "<=", ">", ">="):
        return _call(name, args)
    return let_values(args, lambda x: _call(name, x))


def _call(name: str, args: list[Value]) -> Value:
    a = args[0] if args else None
    b = args[1] if len(args) > 1 else None
    if name in ("+", "-", "*", "/"):
        x, y = num(a), num(b)
        return unbound() if x is None or y is None else arithmetic(name, x, y).value()
    if name == "U-":
        x = num(a)
        return unbound() if x is None else arithmetic("-", static_num(F.lit(0).cast("bigint"), 1), x).value()
    if name == "U+":
        x = num(a)
        return unbound() if x is None else x.value()
    if name in ("=", "!=", "<", "<=", ">", ">="):
        if a.const is not None and b.const is None:
            flip = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
            return Value(compare(flip.get(name, name), b, a), BOOL)
        return Value(compare(name, a, b), BOOL)
    if name == "SAMETERM":
        return Value(F.when(a.col.isNotNull() & b.col.isNotNull(), a.term() == b.term()), BOOL)
    if name in ("ISIRI", "ISBLANK", "ISLITERAL"):
        k = {"ISIRI": 1, "ISBLANK": 0, "ISLITERAL": 2}[name]
        if a.form.kind == "term":
            return Value(a.col["k"] == k, BOOL)
        return Value(F.when(a.col.isNotNull(), F.lit(k == (2 if a.form.kind == "lit" else 1))), BOOL)
    if name == "ISNUMERIC":
        n = num(a)
        return Value(F.when(a.col.isNotNull(), F.lit(False) if n is None else n.tier_col.isNotNull() if isinstance(n.tier, Column) else F.lit(True)), BOOL)
    if name == "STR":
        return Value(as_str(a), STRING)
    if name == "LANG":
        return Value(_lang(a), STRING)
    if name == "DATATYPE":
        if a.form.kind == "lit":
            dt = F.when(a.col.isNotNull(), F.lit(a.dt))
        elif a.form.kind == "term":
            dt = a.col["dt"]
        else:
            return unbound()
        iri = F.when(dt.startswith("xsd:"), F.concat(F.lit(XSD), F.substring(dt, 5, 1000))).when(dt == "rdf:langString", F.lit(RDF + "langString")).otherwise(dt)
        return Value(iri, Form("iri"))
    if name == "IRI":
        iri = F.when(a.col["k"] == 1, a.col["v"]).when(a.col["dt"] == "xsd:string", a.col["v"]) if a.form.kind == "term" else a.form.text(a.col) if a.form.kind != "lit" or a.dt == "xsd:string" else F.lit(None).cast("string")
        return Value(iri, Form("iri"))
    if name == "BNODE":
        label = F.uuid() if a is None else text(a)
        return Value(F.when(label.isNotNull(), make(0, F.concat(F.lit("f"), F.md5(label) if a is not None else F.replace(label, F.lit("-"), F.lit(""))))), TERMS)
    if name == "STRDT":
        s, dt = text(a), as_str(b)
        dt = F.when(dt.startswith(XSD), F.concat(F.lit("xsd:"), F.substring(dt, len(XSD) + 1, 1000))).otherwise(dt)
        return Value(F.when(s.isNotNull() & dt.isNotNull(), make(2, s, dt)), TERMS)
    if name == "STRLANG":
        s, lang = text(a), text(b)
        return Value(F.when(s.isNotNull() & lang.isNotNull(), make(2, s, "rdf:langString", F.lower(lang))), TERMS)
    if name == "UUID":
        return Value(F.concat(F.lit("urn:uuid:"), F.uuid()), Form("iri"))
    if name == "STRUUID":
        return Value(F.uuid(), STRING)
    if name == "STRLEN":
        return Value(F.length(text(a)).cast("bigint"), INT)
    if name == "SUBSTR":
        s, start = text(a), _int(b)
        length = _int(args[2]) if len(args) > 2 else F.lit(2**30)
        end = F.when(length >= 2**30, F.lit(2**30)).otherwise(start + length)
        begin = F.greatest(start, F.lit(1))
        return _like(a, F.when(start.isNotNull() & length.isNotNull(), F.substr(s, begin, F.greatest(end - begin, F.lit(0)))))
    if name in ("UCASE", "LCASE"):
        return _like(a, (F.upper if name == "UCASE" else F.lower)(text(a)))
    if name in ("STRSTARTS", "STRENDS", "CONTAINS"):
        fn = {"STRSTARTS": F.startswith, "STRENDS": F.endswith, "CONTAINS": F.contains}[name]
        return Value(fn(text(a), text(b)), BOOL)
    if name in ("STRBEFORE", "STRAFTER"):
        s, t = text(a), text(b)
        at = F.call_function("locate", t, s)
        hit = F.substr(s, F.lit(1), at - 1) if name == "STRBEFORE" else F.substr(s, at + F.length(t), F.length(s))
        got = _like(a, F.when(at > 0, hit))
        if a.form.kind == "lit":
            return Value(F.when(at > 0, hit).otherwise(F.when(s.isNotNull() & t.isNotNull(), F.lit(""))), STRING)
        return Value(F.coalesce(got.col, F.when(s.isNotNull() & t.isNotNull(), make(2, F.lit(""), "xsd:string"))), TERMS)
    if name == "CONCAT":
        if not args:
            return Value(F.lit(""), STRING)
        s = F.concat(*[text(x) for x in args])
        if all(x.form.kind == "lit" for x in args):
            return Value(s, STRING)
        langs = [_lang(x) for x in args]
        same = F.lit(True)
        for x in langs[1:]:
            same = same & (x == langs[0])
        tagged = F.coalesce(same & (langs[0] != ""), F.lit(False))
        return Value(F.when(s.isNotNull(), F.when(tagged, make(2, s, "rdf:langString", langs[0])).otherwise(make(2, s, "xsd:string"))), TERMS)
    if name == "ENCODE_FOR_URI":
        e = F.url_encode(text(a))
        for x, y in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            e = F.replace(e, F.lit(x), F.lit(y))
        return Value(e, STRING)
    if name == "REGEX":
        return Value(F.call_function("rlike", text(a), _flags(b, args[2] if len(args) > 2 else None)), BOOL)
    if name == "REPLACE":
        return _like(a, F.regexp_replace(text(a), _flags(b, args[3] if len(args) > 3 else None), text(args[2])))
    if name == "LANGMATCHES":
        tag, rng = F.lower(text(a)), F.lower(text(b))
        return Value(F.when(rng == "*", tag != "").otherwise((tag == rng) | F.startswith(tag, F.concat(rng, F.lit("-")))), BOOL)
    if name in ("ABS", "CEIL", "FLOOR", "ROUND"):
        return _rounded(name, a)
    if name == "RAND":
        return Value(F.rand(), DBL)
    if name == "NOW":
        return Value(F.current_timestamp().cast("timestamp_ntz"), lit_form("xsd:dateTime"))
    if name in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES"):
        return Value(_date_part(a, ["YEAR", "MONTH", "DAY", "HOURS", "MINUTES"].index(name) + 1).try_cast("bigint"), INT)
    if name == "SECONDS":
        return Value(_date_part(a, 6).try_cast("decimal(38,18)"), DEC)
    if name == "TZ":
        return Value(_date_part(a, 7), STRING)
    if name == "TIMEZONE":
        z = _date_part(a, 7)
        h, m = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
        parts = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
        dur = F.when((z == "Z") | ((h == 0) & (m == 0)), F.lit("PT0S")).when(z != "", F.concat(F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), parts))
        return Value(F.when(dur.isNotNull(), make(2, dur, "xsd:dayTimeDuration")), TERMS)
    if name in ("MD5", "SHA1"):
        return Value((F.md5 if name == "MD5" else F.sha1)(text(a)), STRING)
    if name in ("SHA256", "SHA384", "SHA512"):
        return Value(F.sha2(text(a), int(name[3:])), STRING)
    if name.startswith(XSD) and name[len(XSD) :] in ("boolean", "integer", "decimal", "float", "double", "string", "date", "dateTime"):
        return cast_to(name[len(XSD) :], a)
    if name in FUNCTIONS:
        return FUNCTIONS[name](*args)
    raise NotImplementedError(f"function {name}")


def keeps_text(t: Literal | IRI | BNode) -> bool:
    """Whether the native form of a constant has the constant's own text."""
    if isinstance(t, Literal):
        return t.datatype in ("xsd:string", "xsd:boolean") or (t.datatype == "xsd:integer" and t.value.lstrip("-").isdecimal() and t.value.isascii() and str(int(t.value)) == t.value)
    return True


def literal_value(t: Literal | IRI) -> Value:
    """A constant, in its native type where it is valid."""
    if isinstance(t, IRI):
        return Value(F.lit(t.value), Form("iri"), t)
    if isinstance(t, Literal) and t.datatype.startswith("xsd:") and valid(t.datatype[4:], t.value) and t.value == t.value.strip():
        kind = t.datatype
        if kind == "xsd:string":
            return Value(F.lit(t.value), STRING, t)
        if kind == "xsd:integer" and t.value.lstrip("+-").isdigit() and len(t.value) < 19:
            return Value(F.lit(int(t.value)).cast("bigint"), INT, t)
        if kind == "xsd:decimal":
            return Value(F.lit(t.value).try_cast("decimal(38,18)"), DEC, t)
        if kind == "xsd:double":
            return Value(F.lit(float(t.value)) if "INF" not in t.value else F.lit(float(t.value.replace("INF", "inf"))), DBL, t)
        if kind == "xsd:boolean" and t.value in ("true", "false"):
            return Value(F.lit(t.value == "true"), BOOL, t)
        if kind == "xsd:dateTime" and len(t.value) >= 19 and not t.value.rstrip("Z").endswith(("+", "-")) and "Z" not in t.value and "+" not in t.value[19:] and "-" not in t.value[19:]:
            return Value(F.lit(t.value).try_cast("timestamp_ntz"), lit_form(kind), t)
    return Value(constant(t), TERMS, t)


def unify(values: list[Value]) -> tuple[list[Column], Form]:
    """Columns of one common form."""
    forms = {v.form for v in values if not v.void}
    if len(forms) == 1:
        form = forms.pop()
        return [v.col if not v.void else F.lit(None) for v in values], form
    if not forms:
        return [v.col for v in values], STRING
    return [v.term() if not v.void else F.lit(None) for v in values], TERMS
