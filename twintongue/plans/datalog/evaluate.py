"""Evaluation of a program against an engine's tables."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...errors import ConstraintViolation, TriggerAbort, UnknownName
from ..fixpoint import Stats, cut, fixpoint, minus
from .compile import body, head, kind, type_of_const
from .terms import Atom, Compound, Const, Program, Rule, check_safety, parse, strata, variables

if TYPE_CHECKING:
    from ..engine import Engine


def wider(a: T.DataType | None, b: T.DataType) -> T.DataType:
    if a is None or a == b:
        return b
    if kind(a) == kind(b) == "number":
        return T.DoubleType() if T.DoubleType() in (a, b) or T.FloatType() in (a, b) else T.LongType()
    return T.StringType()


def ground(atom: Atom) -> tuple:
    """A fact's values; compound terms in canonical text."""
    import json

    def whole(x):
        if isinstance(x, Compound):
            return {"f": x.functor, "a": [whole(a) for a in x.args]}
        tag = "bool" if isinstance(x.value, bool) else "int" if isinstance(x.value, int) else "float" if isinstance(x.value, float) else "atom"
        return {"t": tag, "v": x.value}

    return tuple(json.dumps(whole(a), separators=(",", ":"), ensure_ascii=False) if isinstance(a, Compound) else a.value for a in map(folded, atom.args))


def folded(x):
    """Arithmetic on constants, done."""
    from .terms import Arith

    if not isinstance(x, Arith):
        return x
    a, b = folded(x.left).value, folded(x.right).value
    whole = isinstance(a, int) and isinstance(b, int)
    if x.op in ("/", "mod") and b == 0:
        return Const(None)
    if x.op == "/":
        return Const(int(a / b) if whole else a / b)
    return Const(a - b * int(a / b) if x.op == "mod" else {"+": a + b, "-": a - b, "*": a * b}[x.op])


class Evaluation:
    def __init__(self, engine: Engine, program: Program):
        self.engine, self.program, self.spark = engine, program, engine.spark
        self.stats = Stats()
        self.known: dict[str, DataFrame] = {}
        #: Facts of predicates that are no tables.
        self.given: dict[str, list[tuple]] = {}

    def facts(self) -> None:
        """Facts of tables are inserted through their triggers; those that are there, or that a trigger rejects, are left out."""
        by_name: dict[str, list[tuple]] = {}
        for f in self.program.facts:
            by_name.setdefault(f.name, []).append(ground(f))
        for name, rows in by_name.items():
            if name.lower() not in self.engine.catalog.tables:
                self.given[name] = rows
                continue
            relation = self.engine.catalog.get(name)
            if any(len(r) != len(relation.columns) for r in rows):
                raise UnknownName(f"{name} has {len(relation.columns)} arguments")
            df = self._literal(rows).toDF(*relation.names)
            df = df.select(*[F.col(f"`{c.name}`").try_cast(c.type).alias(c.name) for c in relation.columns])
            try:
                self.engine.insert_rows(name, cut(minus(df, relation.df)))
            except TriggerAbort:
                continue

    def _literal(self, rows: list[tuple]) -> DataFrame:
        width = len(rows[0])
        if not width:
            return self.spark.range(1).select(F.lit(True).alias("holds"))
        types: list[T.DataType | None] = [None] * width
        for r in rows:
            for i, v in enumerate(r):
                if v is not None:
                    types[i] = wider(types[i], type_of_const(v))
        kinds = [t or T.StringType() for t in types]
        fixed = [tuple(None if v is None else str(v) if isinstance(t, T.StringType) else float(v) if isinstance(t, T.DoubleType) else v for v, t in zip(r, kinds)) for r in rows]
        return self.spark.createDataFrame(fixed, T.StructType([T.StructField(f"col{i}", t) for i, t in enumerate(kinds)])).distinct()

    def relation(self, name: str) -> DataFrame:
        if name in self.known:
            return self.known[name]
        if name.lower() in self.engine.catalog.tables:
            df = self.engine.catalog.get(name).df
            if name in self.given:
                df = df.unionByName(self._literal(self.given[name]).toDF(*df.columns))
        elif name in self.given:
            df = self._literal(self.given[name])
        elif name.lower() in self.engine.views:
            df = self.engine.sql(f"SELECT * FROM {name}")
        else:
            raise UnknownName(f"no table or predicate {name}")
        # The catalog's texts, dates and times are atoms.
        df = df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if kind(f.dataType) == "text" else F.col(f"`{f.name}`") for f in df.schema.fields])
        self.known[name] = df
        return df

    def _empty(self, types: list[T.DataType]) -> DataFrame:
        names = [f"col{i}" for i in range(len(types))]
        return self.spark.createDataFrame([], T.StructType([T.StructField(n, t) for n, t in zip(names, types)]))

    def _head(self, rule: Rule, relation) -> DataFrame:
        return head(rule.head, *body(self.spark, rule.body, relation))

    def _types(self, group: list[str], rules: list[Rule], own: dict[str, DataFrame | None]) -> dict[str, list[T.DataType]]:
        """Column types of mutually recursive predicates: from their facts and rules, until none becomes wider."""
        types: dict[str, list[T.DataType]] = {p: [f.dataType for f in own[p].schema.fields] for p in group if own[p] is not None}
        while True:
            before = {p: list(t) for p, t in types.items()}
            for r in rules:
                if any(lit.kind == "pos" and lit.atom.name in group and lit.atom.name not in types for lit in r.body):
                    continue
                made = self._head(r, lambda i, n: self._empty(types[n]) if n in types else self.relation(n)).schema.fields
                old = types.get(r.head.name, [None] * len(made))
                types[r.head.name] = [wider(a, f.dataType) for a, f in zip(old, made)]
            if types == before:
                break
        for p in group:
            if p not in types:  # no rule can ever give a fact
                arity = len(next(r for r in rules if r.head.name == p).head.args)
                types[p] = [T.StringType()] * arity or [T.BooleanType()]
        return types

    def derive(self) -> None:
        for group in strata(self.program):
            rules = [r for r in self.program.rules if r.head.name in group]
            own: dict[str, DataFrame | None] = {}
            for p in group:
                try:
                    own[p] = self.relation(p)
                except UnknownName:
                    own[p] = None
            types = self._types(group, rules, own)

            def fit(df: DataFrame, p: str) -> DataFrame:
                names = [f"col{i}" for i in range(len(types[p]))]
                return df.toDF(*names).select(*[F.col(n).cast(t).alias(n) for n, t in zip(names, types[p])])

            base: dict[str, DataFrame] = {}
            steps = []
            for p in group:
                df = fit(own[p], p) if own[p] is not None else self._empty(types[p])
                for r in rules:
                    if r.head.name == p and not any(lit.kind == "pos" and lit.atom.name in group for lit in r.body):
                        df = df.unionByName(fit(self._head(r, lambda i, n: self.relation(n)), p))
                        self.stats.applications += 1
                base[p] = df
            for r in rules:
                for at, lit in enumerate(r.body):
                    if lit.kind == "pos" and lit.atom.name in group:

                        def step(delta, full, r=r, at=at):
                            return fit(self._head(r, lambda i, n: delta[n] if i == at else full[n] if n in full else self.relation(n)), r.head.name)

                        steps.append((r.head.name, step))
            if steps:
                found = fixpoint(base, steps, self.engine.most_rounds, self.stats, ", ".join(group))
            else:
                self.stats.rounds += 1
                found = {p: cut(df.distinct()) for p, df in base.items()}
            for p, df in found.items():
                self._keep(p, df)

    def _keep(self, name: str, df: DataFrame) -> None:
        """Derived facts become a table with the columns col0, col1, ..., or new rows of the table that has their name."""
        self.known[name] = df
        tables = self.engine.catalog.tables
        if name.lower() in tables and [c.lower() for c in tables[name.lower()].names] != df.columns:
            relation = tables[name.lower()]
            rows = df.toDF(*relation.names).select(*[F.col(f"`{c.name}`").try_cast(c.type).alias(c.name) for c in relation.columns])
            self.engine.insert_rows(name, cut(minus(rows, relation.df)))
        else:
            self.engine.keep(name, df)

    def check(self) -> None:
        for c in self.program.constraints:
            df, _ = body(self.spark, c, lambda i, n: self.relation(n))
            n = df.distinct().count()
            if n:
                raise ConstraintViolation(f"a constraint on {', '.join(lit.atom.name for lit in c if lit.atom)} has {n} violations", n)

    def answer(self, query) -> DataFrame:
        df, bound = body(self.spark, query, lambda i, n: self.relation(n))
        names = [v for v in variables(query) if not v.startswith("_") and v in bound]
        return df.select(*[bound[v].col.alias(v) for v in names]).distinct() if names else df.limit(1).select()


def run(engine: Engine, text: str):
    from ..engine import Done

    program = parse(text)
    check_safety(program)
    strata(program)  # before anything is changed
    e = Evaluation(engine, program)
    e.facts()
    for name, rows in e.given.items():
        if not any(r.head.name == name for r in program.rules):
            e._keep(name, cut(e.relation(name)))
    e.derive()
    engine.stats = e.stats
    e.check()
    return e.answer(program.queries[-1]) if program.queries else Done("DATALOG")
