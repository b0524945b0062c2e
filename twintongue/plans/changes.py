"""INSERT, UPDATE and DELETE over table versions, with constraints and row triggers.

A statement is one batch: a DataFrame whose columns n_c (new) and o_c (old) are the
rows that change. Triggers turn the batch into another batch or into changes of
other tables, constraints are joins, and all new versions take effect together or
not at all. Trigger bodies see other tables as they were before the statement.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintViolation, ParseError, TriggerAbort, TriggerDepth
from .catalog import Catalog, ForeignKey, Relation, Trigger, with_df
from .fixpoint import cut
from .text import Reader, literal, split_top, tokens

MOST_DEPTH = 3
#: After so many changes a table's lineage is cut.
CUT_AFTER = 6
MOST_CASCADES = 100
#: Functions that may answer otherwise when they are asked again.
_FICKLE = re.compile(r"\b(rand\w*|uniform|uuid|shuffle|now|current_\w+|monotonically_\w+|spark_partition_id|input_file_\w+)\b", re.I)


def row_expr(text: str) -> str:
    """NEW.c and OLD.c as columns of the batch, outside of strings."""
    out, at, found = [], 0, tokens(text)
    for i, t in enumerate(found):
        if t.upper in ("NEW", "OLD") and i + 2 < len(found) and found[i + 1].text == ".":
            out.append(text[at : t.start] + f"`{t.upper[0].lower()}_{found[i + 2].name.lower()}`")
            at = found[i + 2].end
    return "".join(out) + text[at:]


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{prefix}{c.lower()}") for c in df.columns])


def _plain(batch: DataFrame, relation: Relation, prefix: str) -> DataFrame:
    return batch.select(*[F.col(f"`{prefix}{c.name.lower()}`").cast(c.type).alias(c.name) for c in relation.columns])


class Changes:
    """One statement's changes; `catalog` is a copy that replaces the real one at the end."""

    def __init__(self, catalog: Catalog, functions: dict, depth: int = 0):
        self.catalog, self.functions, self.depth = catalog, functions, depth

    # The three statements

    def insert(self, table: str, rows: DataFrame) -> int:
        """rows: the table's columns by name."""
        relation = self.catalog.get(table)
        batch = self._fired(table, "INSERT", True, cut(_prefixed(rows, "n_")))
        new = cut(_plain(batch, relation, "n_"))
        self._not_null(relation, new)
        self._unique(table, relation, new, relation.df)
        self._set(table, relation.df.unionByName(new))
        self._parents_exist(relation, new)  # rows of one statement may refer to each other
        self._fired(table, "INSERT", False, _prefixed(new, "n_"))
        return new.count()

    def update(self, table: str, assignments: dict[str, str], where: str | None, batch: DataFrame | None = None) -> int:
        relation = self.catalog.get(table)
        hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        if batch is None:
            named = {relation.column(c).name: e for c, e in assignments.items()}
            new = [F.expr(named[c.name]).cast(c.type) if c.name in named else F.col(f"`{c.name}`") for c in relation.columns]
            batch = relation.df.alias(table).where(hit).select(*[x.alias(f"n_{c.name.lower()}") for x, c in zip(new, relation.columns)], *[F.col(f"`{c}`").alias(f"o_{c.lower()}") for c in relation.names])
            rest = self._others(table, relation, "UPDATE", where, hit)
        else:
            rest = None
        batch = cut(self._fired(table, "UPDATE", True, cut(batch)))
        return self._replace(table, relation, batch, rest)

    def delete(self, table: str, where: str | None) -> int:
        relation = self.catalog.get(table)
        hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        rest = self._others(table, relation, "DELETE", where, hit)
        batch = cut(_prefixed(relation.df.alias(table).where(hit), "o_"))
        if rest is None:
            batch = cut(self._fired(table, "DELETE", True, batch))
            rest = self._without(relation.df, _plain(batch, relation, "o_"))
        n = batch.count()
        self._set(table, rest)
        self._orphans(table, relation, batch, None)
        self._fired(table, "DELETE", False, batch)
        return n

    def _others(self, table: str, relation: Relation, event: str, where: str | None, hit: Column) -> DataFrame | None:
        """The rows that a statement leaves alone, by its predicate; None if that can't tell, as a trigger may take rows back."""
        if self.catalog.triggers_of(table, event, True) or _FICKLE.search(where or ""):
            return None
        return relation.df.alias(table).where(~hit)

    def _replace(self, table: str, relation: Relation, batch: DataFrame, rest: DataFrame | None = None) -> int:
        """The batch's old rows become its new rows. Rows that a trigger took out of the batch stay as they are."""
        new = cut(_plain(batch, relation, "n_"))
        if rest is None:
            rest = cut(self._without(relation.df, _plain(batch, relation, "o_")))
        self._not_null(relation, new)
        self._unique(table, relation, new, rest)
        self._set(table, rest.unionByName(new))
        self._parents_exist(relation, new)
        self._orphans(table, relation, batch, "n_")
        self._fired(table, "UPDATE", False, batch)
        return new.count()

    @staticmethod
    def _without(df: DataFrame, gone: DataFrame) -> DataFrame:
        """A bag difference."""
        return df.exceptAll(gone)

    def _set(self, table: str, df: DataFrame) -> None:
        relation = with_df(self.catalog.get(table), df)
        if relation.age >= CUT_AFTER:
            relation = replace(relation, df=cut(df), age=0)
        self.catalog.put(table, relation)

    # Constraints

    def _not_null(self, relation: Relation, new: DataFrame) -> None:
        must = [c.name for c in relation.columns if not c.nullable]
        if must:
            for name, nulls in zip(must, new.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(must)]).first()):
                if nulls:
                    raise ConstraintViolation(f"column {name} must not be NULL")

    def _unique(self, table: str, relation: Relation, new: DataFrame, others: DataFrame) -> None:
        for keys in relation.unique:
            full = [F.col(f"`{k}`").isNotNull() for k in keys]
            keep = full[0]
            for f in full[1:]:
                keep = keep & f
            mine = new.where(keep).select(*[F.col(f"`{k}`") for k in keys])
            twice = mine.groupBy(*[F.col(f"`{k}`") for k in keys]).count().where("count > 1")
            if not twice.isEmpty() or not mine.join(others.select(*[F.col(f"`{k}`") for k in keys]), list(keys), "left_semi").isEmpty():
                raise ConstraintViolation(f"{table}: ({', '.join(keys)}) must be unique")

    def _parents_exist(self, relation: Relation, new: DataFrame) -> None:
        for k in relation.foreign:
            self._check_parents(k, new)

    def _check_parents(self, k: ForeignKey, new: DataFrame) -> None:
        parent = self.catalog.get(k.parent).df.select(*[F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(k.parent_columns)])
        keys = new.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(k.columns)]).na.drop()
        on = [F.col(f"_c{i}") == F.col(f"_p{i}") for i in range(len(k.columns))]
        if not keys.join(parent, on, "left_anti").isEmpty():
            raise ConstraintViolation(f"({', '.join(k.columns)}) has no row in {k.parent}")

    def _orphans(self, table: str, relation: Relation, batch: DataFrame, new: str | None, depth: int = 0) -> None:
        """What the loss or change of referenced keys does to the tables that refer to them, over all levels."""
        for child, k in self.catalog.children(table):
            if depth > MOST_CASCADES:
                raise ConstraintViolation(f"{table}: more than {MOST_CASCADES} cascades")
            action = k.on_update if new else k.on_delete
            old = [F.col(f"`o_{c.lower()}`").alias(f"_o{i}") for i, c in enumerate(k.parent_columns)]
            now = [F.col(f"`{new}{c.lower()}`").alias(f"_n{i}") for i, c in enumerate(k.parent_columns)] if new else []
            changed = batch.select(*old, *now)
            if new:
                same = F.lit(True)
                for i in range(len(old)):
                    same = same & F.col(f"_o{i}").eqNullSafe(F.col(f"_n{i}"))
                changed = changed.where(~same)
            # A key that another row still has is not lost.
            left = self.catalog.get(table).df.select(*[F.col(f"`{c}`").alias(f"_l{i}") for i, c in enumerate(k.parent_columns)])
            changed = changed.join(left, [F.col(f"_o{i}") == F.col(f"_l{i}") for i in range(len(old))], "left_anti").dropDuplicates([f"_o{i}" for i in range(len(old))])
            theirs = self.catalog.get(child)
            on = [F.col(f"`{c}`") == F.col(f"_o{i}") for i, c in enumerate(k.columns)]
            hit = theirs.df.join(changed, on)
            if hit.isEmpty():
                continue
            if action in ("RESTRICT", "NO ACTION"):
                raise ConstraintViolation(f"{child} still refers to rows of {table}")
            def after(c) -> F.Column:
                if c.name.lower() not in [x.lower() for x in k.columns]:
                    return F.col(f"`{c.name}`")
                if action == "CASCADE":
                    return F.col(f"_n{[x.lower() for x in k.columns].index(c.name.lower())}")
                return (F.expr(c.default) if action == "SET DEFAULT" and c.default else F.lit(None)).cast(c.type)
            olds = [F.col(f"`{c}`").alias(f"o_{c.lower()}") for c in theirs.names]
            if action == "CASCADE" and not new:
                gone = cut(hit.select(*olds))
                self._set(child, self._without(theirs.df, _plain(gone, theirs, "o_")))
                self._orphans(child, theirs, gone, None, depth + 1)
            else:
                moved = cut(hit.select(*olds, *[after(c).alias(f"n_{c.name.lower()}") for c in theirs.columns]))
                news = _plain(moved, theirs, "n_")
                rest = cut(self._without(theirs.df, _plain(moved, theirs, "o_")))
                self._not_null(theirs, news)
                self._unique(child, theirs, news, rest)
                self._set(child, rest.unionByName(news))
                self._orphans(child, theirs, moved, "n_", depth + 1)

    # Triggers

    def _fired(self, table: str, event: str, before: bool, batch: DataFrame) -> DataFrame:
        found = self.catalog.triggers_of(table, event, before)
        if not found:
            return batch
        if self.depth >= MOST_DEPTH:
            raise TriggerDepth(f"triggers of {table} more than {MOST_DEPTH} levels deep")
        for t in found:
            after = self._run(t, batch)
            if before:
                batch = after
        return batch

    def _run(self, trigger: Trigger, batch: DataFrame) -> DataFrame:
        body = trigger.body if trigger.function is None else self.functions[trigger.function.lower()]
        if callable(body):
            return body(batch)
        r = Reader(body)
        r.accept("BEGIN")
        for part in split_top(r.found[r.at :], ";"):
            text = body[part[0].start : part[-1].end] if part else ""
            if not text or part[0].upper in ("END", "BEGIN") and len(part) == 1:
                continue
            batch, ended = self._statement(text, batch)
            if ended:
                break
        return batch

    def _statement(self, text: str, batch: DataFrame) -> tuple[DataFrame, bool]:
        r = Reader(text)
        if r.accept("SET"):
            for part in split_top(r.found[r.at :], ","):
                names = [t for t in part]
                if names[0].upper == "NEW" and names[1].text == ".":
                    names = names[2:]
                column, value = f"n_{names[0].name.lower()}", row_expr(text[names[2].start : names[-1].end])
                if column not in batch.columns:
                    raise ParseError(f"no column {names[0].name} to set")
                batch = batch.withColumn(column, F.expr(value).cast(batch.schema[column].dataType))
            return batch, False
        if r.accept("RETURN", "NULL"):
            return batch.limit(0), True
        if r.accept("RETURN"):
            return batch, True
        if r.accept("RAISE", "ERROR"):
            if not batch.isEmpty():
                raise TriggerAbort(literal(r.take().text))
            return batch, True
        if r.accept("IF"):
            absent = r.accept("NOT")
            r.expect("EXISTS")
            excluding = r.accept("EXCLUDING", "OLD")
            query = Reader(r.text_of(r.inside()))
            r.expect("THEN", "RAISE", "ERROR")
            message = literal(r.take().text)
            query.expect("SELECT")
            query.until("FROM")
            query.expect("FROM")
            other = self.catalog.get(query.name())
            where = row_expr(query.rest()[len("WHERE") :]) if query.peek() == "WHERE" else "true"
            rows = other.df
            if excluding:
                rows = self._without(rows, _plain(batch, other, "o_"))
            found = batch.join(rows, F.expr(where), "left_anti" if absent else "left_semi")
            if not found.isEmpty():
                raise TriggerAbort(message)
            return batch, False
        inner = Changes(self.catalog, self.functions, self.depth + 1)
        if r.accept("INSERT", "INTO"):
            table = r.name()
            relation = self.catalog.get(table)
            names = r.names() if r.peek() == "(" else relation.names
            r.expect("VALUES")
            values = [r.text_of(p) for p in split_top(r.inside(), ",")]
            given = {relation.column(c).name: row_expr(v) for c, v in zip(names, values)}
            rows = batch.select(*[F.expr(given.get(c.name, c.default or "NULL")).cast(c.type).alias(c.name) for c in relation.columns])
            inner.insert(table, rows)
            return batch, False
        if r.accept("UPDATE"):
            table = r.name()
            relation = self.catalog.get(table)
            r.expect("SET")
            given = assignments(r)
            where = row_expr(r.rest()[len("WHERE") :]) if r.peek() == "WHERE" else "true"
            named = {relation.column(c).name: row_expr(e) for c, e in given.items()}
            keyed = relation.df.select(*[F.col(f"`{c}`") for c in relation.names])
            hit = keyed.join(batch, F.expr(where)).select(*[F.col(f"`{c}`").alias(f"_{c}") for c in relation.names], *[F.expr(named[c.name]).cast(c.type).alias(f"n_{c.name.lower()}") if c.name in named else F.col(f"`{c.name}`").alias(f"n_{c.name.lower()}") for c in relation.columns])
            hit = hit.toDF(*[f"o_{c.lower()}" for c in relation.names], *[f"n_{c.lower()}" for c in relation.names]).dropDuplicates([f"o_{c.lower()}" for c in relation.names])
            inner.update(table, {}, None, cut(hit))
            return batch, False
        if r.accept("DELETE", "FROM"):
            table = r.name()
            relation = self.catalog.get(table)
            where = row_expr(r.rest()[len("WHERE") :]) if r.peek() == "WHERE" else "true"
            gone = relation.df.join(batch, F.expr(where), "left_semi")
            old = cut(_prefixed(gone, "o_"))
            old = inner._fired(table, "DELETE", True, old)
            self._set(table, self._without(relation.df, _plain(old, relation, "o_")))
            self._orphans(table, relation, old, None)
            inner._fired(table, "DELETE", False, old)
            return batch, False
        raise ParseError(f"a trigger cannot do this: {text!r}")


def assignments(r: Reader) -> dict[str, str]:
    """c = e, ... up to WHERE or the end."""
    out: dict[str, str] = {}
    text = r.until("WHERE")
    for part in split_top(tokens(text), ","):
        if len(part) < 3 or part[1].text != "=":
            raise ParseError(f"expected column = expression: {text!r}")
        out[part[0].name] = text[part[2].start : part[-1].end]
    return out


def words_of(text: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Za-z_]\w*", text)}
