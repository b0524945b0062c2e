"""Rule bodies as joins, anti-joins and filters.

A body's bindings are a DataFrame with a column for each variable. Equality is
null-safe, as NULL is the atom null. Text never equals a number or a boolean;
integers and floats compare as numbers. Compound terms are text in a canonical
JSON form, {"f": functor, "a": [arguments]}, whose arguments are compound terms
or {"t": tag, "v": value}.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .terms import Arith, Atom, Compound, Const, Literal, Var, variables

NUMBERS = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.DecimalType)


def kind(t: T.DataType) -> str:
    if isinstance(t, NUMBERS):
        return "number"
    return "bool" if isinstance(t, T.BooleanType) else "text"


def type_of_const(v) -> T.DataType:
    if isinstance(v, bool):
        return T.BooleanType()
    return T.LongType() if isinstance(v, int) else T.DoubleType() if isinstance(v, float) else T.StringType()


class Value:
    """A column with its type. loose: text taken out of a compound term, which may stand for a number."""

    def __init__(self, col: Column, type_: T.DataType, loose: bool = False):
        self.col, self.type, self.loose = col, type_, loose


def equal(a: Value, b: Value) -> Column:
    ka, kb = kind(a.type), kind(b.type)
    if ka == kb:
        if ka == "text" and type(a.type) is not type(b.type):
            return a.col.cast("string").eqNullSafe(b.col.cast("string"))
        return a.col.eqNullSafe(b.col)
    if a.loose or b.loose:
        text, other = (a, b) if ka == "text" else (b, a)
        return text.col.try_cast(other.type).eqNullSafe(other.col)
    return a.col.isNull() & b.col.isNull()


def tagged(v: Value) -> Column:
    """An argument of a compound term as JSON."""
    text = v.col.cast("string")
    if kind(v.type) == "text":
        own = F.to_json(F.struct(F.lit("atom").alias("t"), text.alias("v")))
        return F.when(v.col.isNull(), F.lit('{"t":"atom","v":null}')).when(text.startswith('{"f":'), text).otherwise(own)
    tag = "bool" if kind(v.type) == "bool" else "float" if isinstance(v.type, (T.DoubleType, T.FloatType)) else "int"
    return F.when(v.col.isNull(), F.lit('{"t":"atom","v":null}')).otherwise(F.concat(F.lit(f'{{"t":"{tag}","v":'), text, F.lit("}")))


def evaluated(term, bound: dict[str, Value]) -> Value:
    if isinstance(term, Var):
        return bound[term.name]
    if isinstance(term, Const):
        t = type_of_const(term.value)
        return Value(F.lit(term.value).cast(t), t)
    if isinstance(term, Compound):
        parts = [F.lit(f'{{"f":{json.dumps(term.functor)},"a":[')]
        for i, a in enumerate(term.args):
            parts += [F.lit(",")] * (i > 0) + [tagged(evaluated(a, bound))]
        return Value(F.concat(*parts, F.lit("]}")), T.StringType())
    a, b = evaluated(term.left, bound), evaluated(term.right, bound)
    for v in (a, b):
        if v.loose:
            v.col, v.type, v.loose = v.col.try_cast("double"), T.DoubleType(), False
    if kind(a.type) != "number" or kind(b.type) != "number":
        return Value(F.lit(None).cast("double"), T.DoubleType())
    whole = all(not isinstance(v.type, (T.DoubleType, T.FloatType, T.DecimalType)) for v in (a, b))
    if term.op == "/":
        # Whole numbers truncate; nothing is a result of a division by zero.
        col = F.when(b.col != 0, F.call_function("div", a.col, b.col)) if whole else F.try_divide(a.col, b.col)
    elif term.op == "mod":
        col = F.try_mod(a.col, b.col)
    else:
        col = {"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}[term.op]
    return Value(col, T.LongType() if whole else T.DoubleType())


def comparison(lit: Literal, bound: dict[str, Value]) -> Column:
    a, b = evaluated(lit.left, bound), evaluated(lit.right, bound)
    known = F.lit(True)
    for side, v in ((lit.left, a), (lit.right, b)):
        if isinstance(side, Arith):
            known = known & v.col.isNotNull()
    if lit.op in ("=", "!="):
        same = equal(a, b)
        return known & (same if lit.op == "=" else ~same)
    if kind(a.type) != kind(b.type):
        if not (a.loose or b.loose):
            return F.lit(False)
        text, other = (a, b) if kind(a.type) == "text" else (b, a)
        text.col = text.col.try_cast(other.type)
    test = {"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[lit.op]
    return known & F.coalesce(test, F.lit(False))


def matched(atom: Atom, df: DataFrame) -> tuple[DataFrame, dict[str, T.DataType], set[str]]:
    """The atom's relation as bindings of its variables, the types, and which are loose."""
    df = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    if len(atom.args) != len(df.columns) and not (not atom.args and len(df.columns) == 1):
        from ...errors import UnknownName

        raise UnknownName(f"{atom.name} has {len(df.columns)} arguments, not {len(atom.args)}")
    tests: list[Column] = []
    seen: dict[str, Value] = {}
    later: list[tuple[Value, object]] = []

    def match(v: Value, term) -> None:
        if isinstance(term, Var):
            if term.name == "_":
                return
            if term.name in seen:
                tests.append(equal(seen[term.name], v))
            else:
                seen[term.name] = v
        elif isinstance(term, Compound):
            if kind(v.type) != "text":
                tests.append(F.lit(False))
                return
            at = lambda path: F.get_json_object(v.col.cast("string"), path)
            tests.append((at("$.f") == term.functor) & (F.json_array_length(at("$.a")) == len(term.args)))
            for i, a in enumerate(term.args):
                part = at(f"$.a[{i}]")
                inner = F.when(F.get_json_object(part, "$.f").isNotNull(), part).otherwise(F.get_json_object(part, "$.v"))
                match(Value(inner, T.StringType(), True), a)
        else:
            later.append((v, term))

    for i, a in enumerate(atom.args):
        match(Value(F.col(f"_c{i}"), df.schema[i].dataType), a)
    for v, term in later:
        if isinstance(term, Const) or all(n in seen for n in variables(term)):
            tests.append(equal(v, evaluated(term, seen)))
        else:
            from ...errors import UnsafeRule

            raise UnsafeRule(f"{atom.name}: an arithmetic argument with variables that occur elsewhere only; compare it instead")
    for t in tests:
        df = df.where(t)
    out = df.select(*[v.col.alias(n) for n, v in seen.items()]) if seen else df.select(F.lit(True).alias("_any")).limit(1)
    return out, {n: v.type for n, v in seen.items()}, {n for n, v in seen.items() if v.loose}


def body(spark: SparkSession, literals: tuple[Literal, ...], relation: Callable[[int, str], DataFrame]) -> tuple[DataFrame, dict[str, Value]]:
    """Bindings of a body; relation(position, name) is the DataFrame of an atom."""
    todo = [(i, lit) for i, lit in enumerate(literals) if lit.kind == "pos"]
    tests = [lit for lit in literals if lit.kind == "cmp"]
    df: DataFrame | None = None
    types: dict[str, T.DataType] = {}
    loose: set[str] = set()

    def bound() -> dict[str, Value]:
        return {n: Value(F.col(f"`{n}`"), t, n in loose) for n, t in types.items()}

    def test() -> None:
        nonlocal df
        for lit in list(tests):
            if all(v in types for v in variables(lit)):
                df = df.where(comparison(lit, bound()))
                tests.remove(lit)

    while todo:
        # An atom that shares a variable comes first, so that no product is made where a join will do.
        at = next((k for k, (_, lit) in enumerate(todo) if any(v in types for v in variables(lit))), 0)
        i, lit = todo.pop(at)
        right, more, mloose = matched(lit.atom, relation(i, lit.atom.name))
        if df is None:
            df, types, loose = right, more, mloose
        else:
            shared = [v for v in more if v in types]
            right = right.toDF(*[f"_r_{c}" for c in right.columns])
            on = [equal(Value(F.col(f"`{v}`"), types[v], v in loose), Value(F.col(f"`_r_{v}`"), more[v], v in mloose)) for v in shared]
            joined = df.join(right, on) if on else df.crossJoin(right)
            df = joined.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`_r_{v}`").alias(v) for v in more if v not in types])
            loose |= {v for v in mloose if v not in types}
            types |= {v: t for v, t in more.items() if v not in types}
        test()
    if df is None:
        df = spark.range(1).select(F.lit(True).alias("_any"))
        test()
    for i, lit in enumerate(literals):
        if lit.kind == "fail":
            df = df.limit(0)
        if lit.kind == "neg":
            right, more, mloose = matched(lit.atom, relation(i, lit.atom.name))
            shared = [v for v in more if v in types]
            right = right.select(*[F.col(f"`{v}`").alias(f"_n_{v}") for v in shared]) if shared else right.toDF(*[f"_n_{c}" for c in right.columns])
            on = [equal(Value(F.col(f"`{v}`"), types[v], v in loose), Value(F.col(f"`_n_{v}`"), more[v], v in mloose)) for v in shared]
            df = df.join(right.distinct(), on or F.lit(True), "left_anti")
    return df, bound()


def head(atom: Atom, df: DataFrame, bound: dict[str, Value]) -> DataFrame:
    if not atom.args:
        return df.select(F.lit(True).alias("holds")).distinct()
    values = [evaluated(a, bound) for a in atom.args]
    for a, v in zip(atom.args, values):
        if isinstance(a, Arith):
            df = df.where(v.col.isNotNull())
    return df.select(*[v.col.cast(v.type).alias(f"col{i}") for i, v in enumerate(values)]).distinct()
