"""Tables as versions of DataFrames, with what is declared about them.

DataFrames do not change, so that a snapshot for a transaction is a copy of a few
dictionaries.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AlreadyExists, UnknownName

#: Declared types (fixed values). Times are text, as Spark cannot cast to them.
TYPES = {
    "INT": T.LongType(), "INTEGER": T.LongType(), "BIGINT": T.LongType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "REAL": T.DoubleType(),
    "TEXT": T.StringType(), "VARCHAR": T.StringType(), "STRING": T.StringType(), "JSON": T.StringType(), "TIME": T.StringType(),
    "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(),
}


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"


@dataclass(frozen=True)
class Column:
    name: str
    type: T.DataType
    nullable: bool = True
    default: str | None = None


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    columns: tuple[Column, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    foreign: tuple[ForeignKey, ...] = ()
    #: Changes since the lineage was last cut.
    age: int = 0

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise UnknownName(f"no column {name}")


@dataclass(frozen=True)
class Trigger:
    name: str
    table: str
    before: bool
    events: frozenset[str]
    #: Either the name of a function or the body itself.
    function: str | None
    body: str | None


@dataclass
class Catalog:
    tables: dict[str, Relation] = field(default_factory=dict)
    indexes: dict[str, tuple[str, tuple[str, ...], bool]] = field(default_factory=dict)
    functions: dict[str, object] = field(default_factory=dict)
    triggers: dict[str, Trigger] = field(default_factory=dict)

    def snapshot(self) -> Catalog:
        return Catalog(dict(self.tables), dict(self.indexes), dict(self.functions), dict(self.triggers))

    def get(self, name: str) -> Relation:
        key = name.lower()
        if key not in self.tables:
            raise UnknownName(f"no table {name}")
        return self.tables[key]

    def put(self, name: str, relation: Relation) -> None:
        self.tables[name.lower()] = relation

    def create(self, name: str, relation: Relation) -> None:
        if name.lower() in self.tables:
            raise AlreadyExists(f"table {name} exists")
        self.put(name, relation)

    def drop(self, name: str) -> None:
        self.get(name)
        del self.tables[name.lower()]
        self.indexes = {k: v for k, v in self.indexes.items() if v[0] != name.lower()}
        self.triggers = {k: v for k, v in self.triggers.items() if v.table != name.lower()}

    def triggers_of(self, table: str, event: str, before: bool) -> list[Trigger]:
        found = [t for t in self.triggers.values() if t.table == table.lower() and event in t.events and t.before == before]
        return sorted(found, key=lambda t: t.name)

    def children(self, parent: str) -> list[tuple[str, ForeignKey]]:
        return [(name, k) for name, r in self.tables.items() for k in r.foreign if k.parent == parent.lower()]


def relation_of(df: DataFrame, unique: tuple[tuple[str, ...], ...] = ()) -> Relation:
    return Relation(df, tuple(Column(f.name, f.dataType) for f in df.schema.fields), unique)


def typed(df: DataFrame, columns: tuple[Column, ...]) -> DataFrame:
    return df.select(*[F.col(f"`{c.name}`").cast(c.type).alias(c.name) for c in columns])


def with_df(relation: Relation, df: DataFrame) -> Relation:
    return replace(relation, df=df, age=relation.age + 1)
