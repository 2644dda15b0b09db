"""Bags of solutions: one column for each variable, null is unbound, and the joins of the SPARQL algebra on them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Value
from ..functions.terms import TERMS, Form


@dataclass(frozen=True)
class Slot:
    form: Form
    nullable: bool


def column(name: str) -> str:
    return "v_" + name.replace(":", "_").replace(".", "_")


@dataclass
class Solutions:
    df: DataFrame
    vars: dict[str, Slot]

    def value(self, name: str) -> Value:
        return Value(F.col(column(name)), self.vars[name].form)

    def select(self, names: list[str]) -> Solutions:
        """These variables only; those that aren't there are unbound."""
        cols = [F.col(column(n)) if n in self.vars else F.lit(None).cast("string").alias(column(n)) for n in names]
        return Solutions(self.df.select(*cols), {n: self.vars.get(n, Slot(Form("lit", datatype="xsd:string"), True)) for n in names})

    def with_value(self, name: str, v: Value, nullable: bool = True) -> Solutions:
        return Solutions(self.df.withColumn(column(name), v.col), {**self.vars, name: Slot(v.form, nullable)})

    def where(self, cond: Column) -> Solutions:
        return Solutions(self.df.where(cond), dict(self.vars))

    def as_terms(self, names: list[str]) -> Solutions:
        """The same solutions with some variables as term structs."""
        change = {column(n): self.vars[n].form.term(F.col(column(n))) for n in names if self.vars[n].form.kind != "term"}
        if not change:
            return self
        return Solutions(self.df.withColumns(change), {k: Slot(TERMS, s.nullable) if k in names else s for k, s in self.vars.items()})

    def bound(self, names: set[str]) -> Solutions:
        return Solutions(self.df, {k: Slot(s.form, s.nullable and k not in names) for k, s in self.vars.items()})


def unit(spark) -> Solutions:
    return Solutions(spark.range(1).select(), {})


def empty(spark, names: list[str]) -> Solutions:
    return unit(spark).where(F.lit(False)).select(names)


def aligned(left: Solutions, right: Solutions) -> tuple[Solutions, Solutions, list[str]]:
    """Both sides with equal forms of their shared variables."""
    shared = [n for n in left.vars if n in right.vars]
    differ = [n for n in shared if left.vars[n].form != right.vars[n].form]
    return left.as_terms(differ), right.as_terms(differ), shared


def _renamed(right: Solutions, shared: list[str]) -> DataFrame:
    # fresh column identities keep self-joins apart
    return right.df.select(*[F.col(column(n)).alias(column(n) + ("__r" if n in shared else "")) for n in right.vars])


def _match(shared: list[str]) -> Column | None:
    conds = [F.col(column(n)) == F.col(column(n) + "__r") for n in shared]
    return reduce(lambda x, y: x & y, conds) if conds else None


def _loose(s: Solutions, shared: list[str]) -> str | None:
    return next((n for n in shared if s.vars[n].nullable), None)


def _split(s: Solutions, name: str) -> tuple[Solutions, Solutions]:
    """The solutions that bind a variable and, without it, those that don't."""
    c = F.col(column(name))
    rest = Solutions(s.df.where(c.isNull()).drop(column(name)), {k: v for k, v in s.vars.items() if k != name})
    return s.where(c.isNotNull()).bound({name}), rest


def _with_unbound(s: Solutions, name: str, like: Solutions) -> Solutions:
    kind = like.df.schema[column(name)].dataType
    return Solutions(s.df.withColumn(column(name), F.lit(None).cast(kind)), {**s.vars, name: Slot(like.vars[name].form, True)})


def join(left: Solutions, right: Solutions) -> Solutions:
    """Compatible mappings joined. Shared variables that are always bound are hash keys; a side where one may be
    unbound is split in two, so that its bound part joins by hash as well."""
    left, right, shared = aligned(left, right)
    if n := _loose(left, shared):
        a, b = _split(left, n)
        return union(join(a, right), join(b, right))
    if n := _loose(right, shared):
        a, b = _split(right, n)
        return union(join(left, a), join(left, b))
    cond = _match(shared)
    r = _renamed(right, shared)
    df = left.df.crossJoin(r) if cond is None else left.df.join(r, cond, "inner")
    return _output(df, left, right, shared, False)


def _output(df: DataFrame, left: Solutions, right: Solutions, shared: list[str], outer: bool) -> Solutions:
    cols, slots = [], {}
    for n, s in left.vars.items():
        c = F.col(column(n))
        nullable = s.nullable
        if n in shared:
            if s.nullable:
                c = F.coalesce(c, F.col(column(n) + "__r"))
            nullable = s.nullable and (outer or right.vars[n].nullable)
        cols.append(c.alias(column(n)))
        slots[n] = Slot(s.form, nullable)
    for n, s in right.vars.items():
        if n not in shared:
            cols.append(F.col(column(n)))
            slots[n] = Slot(s.form, s.nullable or outer)
    return Solutions(df.select(*cols), slots)


def left_join(left: Solutions, right: Solutions, condition=None) -> Solutions:
    """OPTIONAL. condition(Solutions) -> Column sees the variables of both sides; the joined row's values decide.

    Where the right side may leave a shared variable unbound, what joins its bound and its unbound part and what
    joins neither are three joins by hash.
    """
    left, right, shared = aligned(left, right)
    if n := _loose(left, shared):
        a, b = _split(left, n)
        return union(left_join(a, right, condition), left_join(b, right, condition))
    if n := _loose(right, shared):
        found = [join(left, part) for part in _split(right, n)]
        if condition is not None:
            found = [f.where(F.coalesce(condition(f), F.lit(False))) for f in found]
        return union(union(*found), semi_join(left, right, True, condition))
    cond = _match(shared)
    r = _renamed(right, shared)
    if condition is not None:
        both = Solutions(left.df, {**right.vars, **left.vars})
        extra = F.coalesce(condition(both), F.lit(False))
        cond = extra if cond is None else cond & extra
    df = left.df.join(r, cond if cond is not None else F.lit(True), "left")
    return _output(df, left, right, shared, True)


def semi_join(left: Solutions, right: Solutions, negated: bool, condition=None) -> Solutions:
    """EXISTS and NOT EXISTS: left rows with (without) a compatible right row. Maybe-unbound shared variables split the sides as in ``join``."""
    keep = left
    left, right, shared = aligned(left, right)
    if n := _loose(left, shared):
        a, b = _split(left, n)
        rest = _with_unbound(semi_join(b, right, negated, condition), n, left)
        return _ordered(union(semi_join(a, right, negated, condition), rest), keep, left)
    if n := _loose(right, shared):
        a, b = _split(right, n)
        without = semi_join(left, a, True, condition)
        if negated:
            return _ordered(semi_join(without, b, True, condition), keep, left)
        return _ordered(union(semi_join(left, a, False, condition), semi_join(without, b, False, condition)), keep, left)
    cond = _match(shared)
    if condition is None and cond is None:
        some = F.coalesce(right.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("some")).scalar(), F.lit(False))
        return _ordered(left.where(~some if negated else some), keep, left)
    r = _renamed(right, shared)
    if condition is not None:
        extra = F.coalesce(condition(Solutions(left.df, {**right.vars, **left.vars})), F.lit(False))
        cond = extra if cond is None else cond & extra
    return _ordered(Solutions(left.df.join(r, cond, "left_anti" if negated else "left_semi"), dict(left.vars)), keep, left)


def _ordered(s: Solutions, keep: Solutions, left: Solutions) -> Solutions:
    """The columns of a side in its own order, with its own knowledge of what is bound."""
    return Solutions(s.df.select(*[F.col(column(n)) for n in keep.vars]), {n: Slot(s.vars[n].form, left.vars[n].nullable) for n in keep.vars})


def minus(left: Solutions, right: Solutions) -> Solutions:
    """Left rows without a compatible right row that binds one of the same variables."""
    keep = left
    left, right, shared = aligned(left, right)
    if not shared:
        return left
    if n := _loose(left, shared):
        a, b = _split(left, n)
        return _ordered(union(minus(a, right), _with_unbound(minus(b, right), n, left)), keep, left)
    right = right.select(shared)
    if n := _loose(right, shared):
        a, b = _split(right, n)
        return minus(minus(left, a), b)
    return Solutions(left.df.join(_renamed(right, shared), _match(shared), "left_anti"), dict(left.vars))


def union(a: Solutions, b: Solutions) -> Solutions:
    a, b, shared = aligned(a, b)
    df = a.df.unionByName(b.df, allowMissingColumns=True)
    slots = {}
    for n in [*a.vars, *(x for x in b.vars if x not in a.vars)]:
        x, y = a.vars.get(n), b.vars.get(n)
        slots[n] = Slot((x or y).form, x is None or y is None or x.nullable or y.nullable)
    if not slots:
        return Solutions(a.df.union(b.df), {})
    return Solutions(df, slots)
