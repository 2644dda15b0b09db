"""SPARQL syntax tree to DataFrame operations, following the translation of SPARQL 1.1 section 18.2.

The compiler keeps, for every variable, how it is held and whether it may be unbound; decisions that Catalyst can't
make are made here: the order of triple patterns, which joins have hash keys, decorrelation of EXISTS, and native
columns in place of terms. Everything else is left to Catalyst and adaptive execution.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.expressions import BOOL, DEC, INT, STRING, Value, unbound
from ..functions.terms import IRI, TERMS, BNode, Form, Literal, Term
from . import parser as P
from .parser import UnsupportedSparql, Var
from .solution import Slot, Solutions, column, empty, join, left_join, minus, semi_join, union, unit


def _vars_of(e: Any) -> set[str]:
    """Variables of an expression, those of EXISTS groups included."""
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, P.Call):
        return set().union(*map(_vars_of, e.args)) if e.args else set()
    if isinstance(e, P.Aggregate):
        return _vars_of(e.arg) if e.arg is not None else set()
    if isinstance(e, P.Exists):
        return _group_vars(e.group)
    return set()


def _group_vars(g: Any) -> set[str]:
    out: set[str] = set()
    for p in g.parts:
        if isinstance(p, P.Triple):
            out |= {x.name for x in (p.s, p.p, p.o) if isinstance(x, Var)}
        elif isinstance(p, P.Union):
            for x in p.groups:
                out |= _group_vars(x)
        elif isinstance(p, (P.Optional, P.Minus)):
            out |= _group_vars(p.group)
        elif isinstance(p, P.Graph):
            out |= _group_vars(p.group) | ({p.name.name} if isinstance(p.name, Var) else set())
        elif isinstance(p, P.Group):
            out |= _group_vars(p)
        elif isinstance(p, P.Filter):
            out |= _vars_of(p.expr)
        elif isinstance(p, P.Bind):
            out |= _vars_of(p.expr) | {p.var}
        elif isinstance(p, P.Values):
            out |= set(p.names)
        elif isinstance(p, P.Query):
            out |= {n for _, n in p.select} if p.select is not None else _group_vars(p.where)
    return out


def _settled(inner: Solutions, outer: Solutions) -> set[str]:
    """The variables of a group whose values no outer solution can add to."""
    return {n for n, slot in inner.vars.items() if not slot.nullable or n not in outer.vars}


def _has_exists(e: Any) -> bool:
    return isinstance(e, P.Exists) or (isinstance(e, P.Call) and any(map(_has_exists, e.args)))


def _conjuncts(e: Any) -> list[Any]:
    return _conjuncts(e.args[0]) + _conjuncts(e.args[1]) if isinstance(e, P.Call) and e.name == "&&" else [e]


def _aggregates(e: Any) -> list[P.Aggregate]:
    if isinstance(e, P.Aggregate):
        return [e]
    return [x for a in e.args for x in _aggregates(a)] if isinstance(e, P.Call) else []


def _substitute(e: Any, names: dict[Any, str]) -> Any:
    """An expression over groups with its aggregates and grouping expressions replaced by variables."""
    if e in names:
        return Var(names[e])
    return replace(e, args=tuple(_substitute(a, names) for a in e.args)) if isinstance(e, P.Call) else e


class Compiler:
    def __init__(self, source, bindings: dict[str, Term] | None = None):
        self.source = source
        self.spark = source.spark
        self.bindings = bindings or {}
        self.graphs: list[str] = []
        self.named: list[str] = []
        self.fresh = 0

    # ---- queries ----
    def run(self, q: P.Query) -> Solutions:
        self.graphs, self.named = q.graphs, q.named
        out = self.query(q)
        if q.form == "ASK":
            n = out.df.limit(1).agg((F.count(F.lit(1)) > 0).alias(column("ask")))
            return Solutions(n, {"ask": Slot(BOOL, False)})
        # bindings that are projected come out as constant columns
        return out

    def query(self, q: P.Query) -> Solutions:
        s = self.group(q.where)
        if q.values:
            s = join(s, self.values(q.values))
        s = self.bind_parameters(s, q)
        select, order, having = q.select, q.order, q.having
        exprs = [e for e, _ in select or []] + [e for e, _ in order] + having
        if q.group_by is not None or any(_aggregates(e) for e in exprs):
            s, names = self.aggregate(s, q, [a for e in exprs for a in _aggregates(e)])
            sub = lambda e: _substitute(e, names)
            if select is None:
                raise P.SparqlError("SELECT * with GROUP BY")
            select, order, having = [(sub(e), n) for e, n in select], [(sub(e), up) for e, up in order], [sub(e) for e in having]
        for h in having:
            s = self.filter(s, h)
        if select is None:
            names_out = [n for n in s.vars if not n.startswith("_:")]
        else:
            for e, n in select:
                if not (isinstance(e, Var) and e.name == n):
                    s = self.extend(s, e, n)
            names_out = [n for _, n in select]
        keys = []
        for i, (e, up) in enumerate(order):
            if isinstance(e, Var) and e.name not in s.vars:
                continue
            k = X.sort_key(self.expr(s, e))
            keys.append(k.asc_nulls_first() if up else k.desc_nulls_last())
        if q.distinct:
            if keys and not all(isinstance(e, Var) and e.name in names_out for e, _ in order):
                # order is kept by the first of equal rows
                from pyspark.sql import Window

                cols = [column(n) for n in names_out]
                ranked = s.df.withColumn("__rank", F.row_number().over(Window.partitionBy(*cols).orderBy(*keys)))
                s = Solutions(ranked.where("__rank = 1").drop("__rank"), s.vars)
            else:
                s = s.select(names_out)
                s = Solutions(s.df.distinct(), s.vars)
        if keys:
            s = Solutions(s.df.orderBy(*keys), s.vars)
        if q.offset:
            s = Solutions(s.df.offset(q.offset), s.vars)
        if q.limit is not None:
            s = Solutions(s.df.limit(q.limit), s.vars)
        return s.select(names_out)

    def bind_parameters(self, s: Solutions, q: P.Query) -> Solutions:
        for n, t in self.bindings.items():
            if n not in s.vars and (q.select is None or any(isinstance(e, Var) and e.name == n for e, _ in q.select)):
                v = X.literal_value(t)
                s = s.with_value(n, Value(v.col, v.form), False)
        return s

    # ---- groups ----
    def group(self, g: P.Group, graph: Any = None, start: Solutions | None = None, keep_filters: bool = False) -> Any:
        """A group graph pattern. Filters see the whole group; with keep_filters they are returned instead of applied."""
        s: Solutions | None = start
        filters: list[Any] = []
        triples: list[P.Triple] = []

        def flush() -> None:
            nonlocal s, triples
            if triples:
                got = self.bgp(triples, graph)
                s = got if s is None else join(s, got)
                triples = []

        def plus(x: Solutions) -> None:
            nonlocal s
            s = x if s is None else join(s, x)

        for p in g.parts:
            if isinstance(p, P.Triple):
                triples.append(p)
                continue
            if isinstance(p, P.Filter):
                filters.append(p.expr)
                continue
            flush()
            base = s if s is not None else unit(self.spark)
            if isinstance(p, P.Optional):
                inner, conds = self.group(p.group, graph, keep_filters=True)
                plain = [c for c in conds if not _has_exists(c)]
                outer = [c for c in plain if not _vars_of(c) <= _settled(inner, base)]
                for c in conds:
                    if c not in outer:
                        inner = self.filter(inner, c, graph)
                cond = None if not outer else lambda both, outer=outer: reduce(lambda a, b: a & b, [X.ebv(self.expr(both, c)) for c in outer])
                s = left_join(base, inner, cond)
            elif isinstance(p, P.Minus):
                s = minus(base, self.group(p.group, graph))
            elif isinstance(p, P.Union):
                plus(reduce(union, [self.group(x, graph) for x in p.groups]))
            elif isinstance(p, P.Group):
                plus(self.group(p, graph))
            elif isinstance(p, P.Graph):
                plus(self.group(p.group, p.name))
            elif isinstance(p, P.Bind):
                if p.var in base.vars:
                    raise P.SparqlError(f"BIND to ?{p.var}, which is bound already")
                s = self.extend(base, p.expr, p.var)
            elif isinstance(p, P.Values):
                plus(self.values(p))
            elif isinstance(p, P.Query):
                plus(self.query(p))
            else:
                raise UnsupportedSparql(type(p).__name__)
        flush()
        s = s if s is not None else unit(self.spark)
        if keep_filters:
            return s, filters
        for f in filters:
            s = self.filter(s, f, graph)
        return s

    def values(self, v: P.Values) -> Solutions:
        if not v.rows:
            return empty(self.spark, v.names)
        cols, slots = [], {}
        for i, n in enumerate(v.names):
            terms = [r[i] for r in v.rows]
            consts = [X.literal_value(t) if t is not None else unbound() for t in terms]
            known = {c.form for c in consts if not c.void}
            if len(known) == 1 and all(t is None or X.keeps_text(t) for t in terms):
                xs, form = X.unify(consts)
            else:
                xs, form = [X.constant(t) if t is not None else F.lit(None) for t in terms], TERMS
            slots[n] = Slot(form, any(t is None for t in terms))
            cols.append(xs)
        row = [F.struct(*[c[j].alias(column(n)) for n, c in zip(v.names, cols)]) for j in range(len(v.rows))]
        df = self.spark.range(1).select(F.inline(F.array(*row))) if v.names else self.spark.range(len(v.rows)).select()
        return Solutions(df, slots)

    # ---- triple patterns ----
    def bgp(self, triples: list[P.Triple], graph: Any) -> Solutions:
        """Patterns joined in greedy order: connected ones first, those with more constants earlier."""
        todo = []
        for t in triples:
            todo += self.expand(t)
        todo = [replace(t, s=self.fix(t.s), p=self.fix(t.p), o=self.fix(t.o)) for t in todo]
        graph = self.fix(graph)
        stars, todo = self.stars(todo, graph)
        names = lambda t: {x.name for x in (t.s, t.p, t.o) if isinstance(x, Var)} if isinstance(t, P.Triple) else set(t.vars)
        todo += stars
        weight = lambda t: sum(w for x, w in ((t.s, 4), (t.o, 3), (t.p, 1)) if not isinstance(x, (Var, P.Path))) if isinstance(t, P.Triple) else 5
        s, seen = None, set()
        while todo:
            linked = [t for t in todo if names(t) & seen] if seen else todo
            t = max(linked or todo, key=weight)
            todo.remove(t)
            got = self.pattern(t, graph) if isinstance(t, P.Triple) else t
            s = got if s is None else join(s, got)
            seen |= names(t)
        return s

    def stars(self, triples: list[P.Triple], graph: Any) -> tuple[list[Solutions], list[P.Triple]]:
        """Patterns about one subject whose predicates are columns of one table become one scan of it."""
        if not hasattr(self.source, "star"):
            return [], triples
        by: dict[Any, list[P.Triple]] = {}
        for t in triples:
            if isinstance(t.s, Var) and isinstance(t.p, IRI):
                by.setdefault(t.s, []).append(t)
        done, out = set(), []
        for s, ts in by.items():
            rel = self.source.star([t.p.value for t in ts], self.graph_filter(graph)) if len(ts) > 1 else None
            if rel is None:
                continue
            at: dict[str, tuple[Column, Form]] = {s.name: (F.col("s"), rel.forms["s"])}
            conds: list[Column] = []
            for i, x in [*((f"o{i}", t.o) for i, t in enumerate(ts)), *([("g", graph)] if isinstance(graph, Var) else [])]:
                c, form = F.col(i), rel.forms[i]
                if isinstance(x, Var):
                    if i == "g":
                        conds.append(c.isNotNull())
                    if x.name in at:
                        c0, f0 = at[x.name]
                        conds.append(c0 == c if f0 == form else f0.term(c0) == form.term(c))
                    else:
                        at[x.name] = (c, form)
                else:
                    e = form.equal(c, x)
                    conds.append(e if e is not None else F.lit(False))
            df = rel.df
            for e in conds:
                df = df.where(e)
            out.append(Solutions(df.select(*[c.alias(column(n)) for n, (c, _) in at.items()]), {n: Slot(f, False) for n, (_, f) in at.items()}))
            done |= {id(t) for t in ts}
        return out, [t for t in triples if id(t) not in done]

    def fix(self, x: Any) -> Any:
        return self.bindings[x.name] if isinstance(x, Var) and x.name in self.bindings else x

    def expand(self, t: P.Triple) -> list[P.Triple]:
        """Sequence and inverse paths as plain patterns."""
        if isinstance(t.p, P.Path):
            if t.p.op == "seq":
                out, at = [], t.s
                for i, step in enumerate(t.p.args):
                    self.fresh += 1
                    to = t.o if i == len(t.p.args) - 1 else Var(f"_:p{self.fresh}")
                    out += self.expand(P.Triple(at, step, to))
                    at = to
                return out
            if t.p.op == "inv":
                return self.expand(P.Triple(t.o, t.p.args[0], t.s))
        return [t]

    def pattern(self, t: P.Triple, graph: Any) -> Solutions:
        if not isinstance(t.p, P.Path):
            return self.scan(t.s, t.p, t.o, graph)
        op, args = t.p.op, t.p.args
        if op == "alt":
            if all(isinstance(a, IRI) for a in args):
                return self.scan(t.s, list(args), t.o, graph)
            return reduce(union, [self.bgp([P.Triple(t.s, a, t.o)], graph) for a in args])
        if op == "neg":
            plain = [a for a in args if isinstance(a, IRI)]
            inverse = [a.args[0] for a in args if isinstance(a, P.Path)]
            parts = []
            if plain or not inverse:
                parts.append(self.scan(t.s, ("not", plain), t.o, graph))
            if inverse:
                parts.append(self.scan(t.o, ("not", inverse), t.s, graph))
            return reduce(union, parts)
        if op == "opt":
            one = self.bgp([P.Triple(t.s, args[0], t.o)], graph)
            both = union(self.zero(t.s, t.o, graph), one)
            return Solutions(both.df.distinct(), both.vars)
        raise UnsupportedSparql("paths of any length (* and +)")

    def zero(self, s: Any, o: Any, graph: Any) -> Solutions:
        """Paths of length zero."""
        gvar = graph.name if isinstance(graph, Var) else None
        if not isinstance(s, Var) and not isinstance(o, Var):
            out = unit(self.spark) if s == o else unit(self.spark).where(F.lit(False))
        elif isinstance(s, Var) and isinstance(o, Var):
            nodes = self.source.nodes(self.graph_filter(graph))
            names = [s.name] + ([o.name] if o.name != s.name else [])
            cols = [F.col("node").alias(column(n)) for n in names]
            df = nodes.df.select(*cols, *([F.col("g").alias(column(gvar))] if gvar else [])).distinct()
            slots = {n: Slot(nodes.form, False) for n in names} | ({gvar: Slot(nodes.graph_form, False)} if gvar else {})
            return Solutions(df.where(F.col(column(gvar)).isNotNull()) if gvar else df, slots)
        else:
            var, const = (s, o) if isinstance(s, Var) else (o, s)
            v = X.literal_value(const) if X.keeps_text(const) else Value(X.constant(const), TERMS)
            out = unit(self.spark).with_value(var.name, Value(v.col, v.form), False)
        if gvar:
            nodes = self.source.nodes(self.graph_filter(graph))
            gs = nodes.df.where("g IS NOT NULL").select(F.col("g").alias(column(gvar))).distinct()
            return join(out, Solutions(gs, {gvar: Slot(nodes.graph_form, False)}))
        return out

    def graph_filter(self, graph: Any) -> Any:
        """None: all graphs; a list of names; or "named": any but the default graph."""
        if graph is None:
            return list(self.graphs) if self.graphs else (None if not self.named else [])
        if isinstance(graph, IRI):
            return [graph.value] if not (self.graphs or self.named) or graph.value in self.named else []
        return list(self.named) if (self.graphs or self.named) else "named"

    def scan(self, s: Any, p: Any, o: Any, graph: Any) -> Solutions:
        which = self.graph_filter(graph)
        parts = []
        for rel in self.source.scan(p, which):
            df, cols, slots, ok = rel.df, [], {}, True
            conds: list[Column] = []
            places = [(s, "s"), (o, "o")] + ([(p, "p")] if isinstance(p, (Var, IRI, Literal, BNode)) else []) + ([(graph, "g")] if isinstance(graph, Var) else [])
            if isinstance(p, tuple) and p[0] == "not" and p[1]:
                conds += [~F.coalesce(e, F.lit(False)) for e in (rel.forms["p"].equal(F.col("p"), x) for x in p[1]) if e is not None]
            elif isinstance(p, list):
                eqs = [e for e in (rel.forms["p"].equal(F.col("p"), x) for x in p) if e is not None]
                conds.append(reduce(lambda a, b: a | b, eqs) if eqs else F.lit(False))
            at: dict[str, tuple[Column, Form]] = {}
            for x, place in places:
                c, form = F.col(place), rel.forms[place]
                if isinstance(x, Var):
                    if place == "g":
                        conds.append(c.isNotNull())
                    if x.name in at:
                        c0, f0 = at[x.name]
                        conds.append(c0 == c if f0 == form else f0.term(c0) == form.term(c))
                    else:
                        at[x.name] = (c, form)
                        cols.append(c.alias(column(x.name)))
                        slots[x.name] = Slot(form, False)
                else:
                    e = form.equal(c, x)
                    if e is None:
                        ok = False
                        break
                    conds.append(e)
            if not ok:
                continue
            for e in conds:
                df = df.where(e)
            if graph is None and self.graphs and len(self.graphs) > 1:
                df = df.select("s", "p", "o").distinct()  # the merge of graphs is a set
            parts.append(Solutions(df.select(*cols), slots))
        if not parts:
            return empty(self.spark, [x.name for x in (s, p, o, graph) if isinstance(x, Var)]).bound(set())
        return reduce(union, parts)

    # ---- filters and expressions ----
    def filter(self, s: Solutions, e: Any, graph: Any = None) -> Solutions:
        for c in _conjuncts(e):
            if isinstance(c, P.Call) and c.name == "!" and isinstance(c.args[0], P.Exists):
                c = P.Exists(c.args[0].group, not c.args[0].negated)
            if isinstance(c, P.Exists):
                s = self.exists(s, c, graph)
                continue
            before = dict(s.vars)
            s, c = self.flag_exists(s, c, graph)
            s = s.where(X.ebv(self.expr(s, c)))
            s = Solutions(s.df.select(*[column(n) for n in before]), before)
        return s

    def exists(self, s: Solutions, e: P.Exists, graph: Any, negated: bool | None = None) -> Solutions:
        inner, conds = self.group(e.group, graph, keep_filters=True)
        lifted = []
        for c in conds:
            if _vars_of(c) <= _settled(inner, s) or not (_vars_of(c) - _settled(inner, s)) & set(s.vars):
                inner = self.filter(inner, c, graph)
            elif _has_exists(c):
                raise UnsupportedSparql("EXISTS inside EXISTS over outer variables")
            else:
                lifted.append(c)
        needed = set().union(*map(_vars_of, lifted)) if lifted else set()
        inner = inner.select([n for n in inner.vars if n in s.vars or n in needed])
        cond = None if not lifted else lambda both: reduce(lambda a, b: a & b, [X.ebv(self.expr(both, c)) for c in lifted])
        return semi_join(s, inner, e.negated if negated is None else negated, cond)

    def flag_exists(self, s: Solutions, e: Any, graph: Any) -> tuple[Solutions, Any]:
        """EXISTS within a condition becomes a boolean variable: rows with and without are told apart by a semi and an anti join."""
        if isinstance(e, P.Exists):
            self.fresh += 1
            n = f"_:e{self.fresh}"
            yes = self.exists(s, e, graph, negated=False).with_value(n, Value(F.lit(not e.negated), BOOL), False)
            no = self.exists(s, e, graph, negated=True).with_value(n, Value(F.lit(e.negated), BOOL), False)
            return union(yes, no), Var(n)
        if isinstance(e, P.Call) and _has_exists(e):
            args = []
            for a in e.args:
                s, a = self.flag_exists(s, a, graph)
                args.append(a)
            return s, replace(e, args=tuple(args))
        return s, e

    def extend(self, s: Solutions, e: Any, name: str) -> Solutions:
        if _has_exists(e):
            s, e = self.flag_exists(s, e, None)
        v = Value(X.constant(e), TERMS) if isinstance(e, Literal) and not X.keeps_text(e) else self.expr(s, e)
        nullable = not (isinstance(e, (IRI, Literal)) or (isinstance(e, Var) and e.name in s.vars and not s.vars[e.name].nullable))
        return s.with_value(name, v, nullable)

    def expr(self, s: Solutions, e: Any) -> Value:
        if isinstance(e, Var):
            if e.name in s.vars:
                return s.value(e.name)
            return X.literal_value(self.bindings[e.name]) if e.name in self.bindings else unbound()
        if isinstance(e, (IRI, Literal)):
            return X.literal_value(e)
        if isinstance(e, BNode):
            return Value(X.constant(e), TERMS)
        if not isinstance(e, P.Call):
            raise UnsupportedSparql(f"{type(e).__name__} here")
        n = e.name
        if n == "BOUND":
            return Value(s.value(e.args[0].name).col.isNotNull() if e.args[0].name in s.vars else F.lit(e.args[0].name in self.bindings), BOOL)
        args = [self.expr(s, a) for a in e.args]
        if n == "&&":
            return Value(X.ebv(args[0]) & X.ebv(args[1]), BOOL)
        if n == "||":
            return Value(X.ebv(args[0]) | X.ebv(args[1]), BOOL)
        if n == "!":
            return Value(~X.ebv(args[0]), BOOL)
        if n == "IN":
            return Value(reduce(lambda a, b: a | b, [X.compare("=", args[0], x) for x in args[1:]], F.lit(False)), BOOL)
        if n == "IF":
            cond = X.ebv(args[0])
            (a, b), form = X.unify(args[1:])
            return Value(F.when(cond, a).when(~cond, b), form)
        if n == "COALESCE":
            cols, form = X.unify(args)
            return Value(F.coalesce(*cols), form)
        try:
            return X.call(n, args)
        except NotImplementedError as x:
            raise UnsupportedSparql(str(x)) from None

    # ---- aggregation ----
    def aggregate(self, s: Solutions, q: P.Query, aggs: list[P.Aggregate]) -> tuple[Solutions, dict[Any, str]]:
        """One groupBy for all aggregates; distinct sums of varying type come from a pre-aggregation of their own."""
        names: dict[Any, str] = {}
        keys: list[str] = []
        for i, (e, n) in enumerate(q.group_by or []):
            n = n or f"_:k{i}"
            if not (isinstance(e, Var) and e.name == n):
                s = self.extend(s, e, n)
                names[e] = n
            elif n not in s.vars:
                s = s.with_value(n, unbound())
            keys.append(n)
        todo: list[tuple[P.Aggregate, str, Value | None]] = []
        for a in dict.fromkeys(aggs):
            self.fresh += 1
            n = f"_:a{self.fresh}"
            names[a] = n
            v = None if a.arg is None else self.expr(s, a.arg)
            todo.append((a, n, v))
        # arguments become columns of their own
        add = {f"__{column(n)}": v.col for _, n, v in todo if v is not None}
        df = s.df.withColumns(add) if add else s.df
        arg = lambda n, v: Value(F.col(f"__{column(n)}"), v.form)
        key_cols = [column(k) for k in keys]
        outs: list[Column] = []
        after: dict[str, tuple] = {}
        apart: list[tuple[str, DataFrame]] = []
        for a, n, v in todo:
            c = column(n)
            if a.name == "COUNT":
                if a.arg is None:
                    if a.distinct:
                        row = F.struct(*[F.coalesce(F.to_json(F.struct(F.col(column(x)))), F.lit("")) for x in s.vars]) if s.vars else F.lit(1)
                        outs.append(F.count_distinct(row).alias(c))
                    else:
                        outs.append(F.count(F.lit(1)).alias(c))
                else:
                    x = arg(n, v).col
                    outs.append((F.count_distinct(x) if a.distinct else F.count(x)).alias(c))
                after[n] = ("as", INT)
            elif a.name in ("SUM", "AVG"):
                v2 = arg(n, v)
                m = X.num(v2)
                if m is None:
                    outs.append(F.when(F.count(F.lit(1)) == 0, F.lit(0).cast("bigint")).alias(c))
                    after[n] = ("as", INT)
                    continue
                bad = F.count_if(m.tier_col.isNull() if isinstance(m.tier, Column) else v2.col.isNull())
                if isinstance(m.tier, Column):
                    parts = [F.try_sum(m.dec).alias("dec"), F.sum(m.dbl).alias("dbl"), F.max(m.tier).alias("tier"), F.count(F.lit(1)).alias("n"), bad.alias("bad")]
                    if a.distinct:
                        once = df.select(*key_cols, v2.col.alias("x")).distinct()
                        m2 = X.num(Value(F.col("x"), TERMS))
                        parts = [F.try_sum(m2.dec).alias("dec"), F.sum(m2.dbl).alias("dbl"), F.max(m2.tier).alias("tier"), F.count(F.lit(1)).alias("n"), F.count_if(m2.tier.isNull()).alias("bad")]
                        apart.append((c, once.groupBy(*key_cols).agg(F.struct(*parts).alias(c))))
                    else:
                        outs.append(F.struct(*parts).alias(c))
                    after[n] = ("dynamic", a.name)
                else:
                    # sums that grow out of their type are unbound
                    kind = {1: "decimal(28,0)", 2: "decimal(38,18)", 3: "float", 4: "double"}[m.tier]
                    total = F.expr(f"try_sum({'DISTINCT ' if a.distinct else ''}try_cast(`__{c}` AS {kind}))")
                    count = F.count_distinct(m.native) if a.distinct else F.count(m.native)
                    fits = {1: "bigint", 2: "decimal(38,18)", 3: "float", 4: "double"}[m.tier]
                    if a.name == "SUM":
                        outs.append(F.when(bad == 0, F.when(count == 0, F.lit(0).cast(fits)).otherwise(total.try_cast(fits))).alias(c))
                        after[n] = ("as", X.lit_form(X.TIER_TYPE[m.tier]))
                    elif m.tier <= 2:
                        outs.append(F.when(bad == 0, F.when(count == 0, F.lit(0).cast("decimal(38,18)")).otherwise(F.try_divide(total.try_cast("decimal(38,18)"), count.cast("decimal(20,0)")).try_cast("decimal(38,18)"))).alias(c))
                        after[n] = ("as", DEC)
                    else:
                        outs.append(F.when(bad == 0, F.coalesce(total / F.when(count != 0, count), F.lit(0.0))).alias(c))
                        after[n] = ("as", X.lit_form(X.TIER_TYPE[m.tier]))
            elif a.name in ("MIN", "MAX"):
                v2 = arg(n, v)
                key = X.sort_key(v2)
                if v2.form.kind != "term":
                    outs.append((F.min if a.name == "MIN" else F.max)(v2.col).alias(c) if v2.form.kind != "key" else (F.min_by if a.name == "MIN" else F.max_by)(v2.col, key).alias(c))
                else:
                    outs.append((F.min_by if a.name == "MIN" else F.max_by)(v2.col, key).alias(c))
                after[n] = ("as", v2.form)
            elif a.name == "SAMPLE":
                v2 = arg(n, v)
                outs.append(F.any_value(v2.col, F.lit(True)).alias(c))
                after[n] = ("as", v2.form)
            else:
                v2 = arg(n, v)
                df = df.withColumn(f"__s{c}", X.as_str(v2) if v2.form.kind != "term" else v2.col["v"])
                sep = a.separator.replace("\\", "\\\\").replace("'", "\\'")
                outs.append(F.expr(f"coalesce(listagg({'DISTINCT ' if a.distinct else ''}`__s{c}`, '{sep}') WITHIN GROUP (ORDER BY `__s{c}`), '')").alias(c))
                after[n] = ("as", STRING)
        if not outs:
            got = df.select(*key_cols).distinct() if key_cols else df.agg(F.count(F.lit(1)).alias("__n")).select()
        else:
            got = df.groupBy(*key_cols).agg(*outs)
        for c, extra in apart:
            ren = extra.select(*[F.col(k).alias(f"{k}__r") for k in key_cols], c)
            on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}__r")) for k in key_cols], F.lit(True))
            got = got.join(ren, on, "left").drop(*[f"{k}__r" for k in key_cols])
        slots = {k: s.vars[k] for k in keys}
        for n, how in after.items():
            if how[0] == "as":
                slots[n] = Slot(how[1], True)
            else:
                c = F.col(column(n))
                tier = F.when(c["bad"] == 0, F.coalesce(c["tier"], F.lit(1)))
                dec, dbl = F.coalesce(c["dec"], F.when(c["n"] == 0, F.lit(0))).try_cast("decimal(38,18)"), F.coalesce(c["dbl"], F.when(c["n"] == 0, F.lit(0.0)))
                total = X.Num(tier, None, dec, dbl)
                if how[1] == "AVG":
                    count = X.static_num(F.greatest(c["n"], F.lit(1)).cast("bigint"), 1)
                    total = X.arithmetic("/", total, count)
                got = got.withColumn(column(n), total.value().col)
                slots[n] = Slot(TERMS, True)
        return Solutions(got, slots), names


