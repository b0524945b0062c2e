"""Semi-naive iteration over DataFrames, shared by recursive queries and Datalog.

In each round the steps see what the round before found (delta) and all facts so
far (full); what is new is what they give and full does not have, NULLs being
equal. Every round's result is written to the shared checkpoint folder, so that
lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TooManyRounds

Facts = dict[str, DataFrame]
Step = tuple[str, Callable[[Facts, Facts], DataFrame]]


@dataclass
class Stats:
    rounds: int = 0
    applications: int = 0
    facts: int = 0


def shared_dir(spark: SparkSession) -> str:
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (own or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again, under fresh column identities."""
    path = f"{shared_dir(df.sparkSession)}/facts-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def minus(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows, without repeats, that known does not have; NULL equals NULL."""
    rows = rows.distinct()
    if not rows.columns:
        return rows if known.isEmpty() else rows.limit(0)
    known = known.toDF(*[f"_k{i}" for i in range(len(rows.columns))])
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(rows.columns)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return rows.join(known, on, "left_anti")


def fixpoint(base: Facts, steps: list[Step], most_rounds: int = 1000, stats: Stats | None = None, label: str = "recursion") -> Facts:
    """All facts: the base, and what the steps give until a round finds nothing new."""
    stats = stats or Stats()
    full = {p: cut(df.distinct()) for p, df in base.items()}
    pieces = {p: [df] for p, df in full.items()}
    delta = full
    while True:
        stats.rounds += 1
        if stats.rounds > most_rounds:
            raise TooManyRounds(f"{label}: more than {most_rounds} rounds")
        made: dict[str, list[DataFrame]] = {}
        for p, step in steps:
            got = step(delta, full)
            if got is not None:
                stats.applications += 1
                made.setdefault(p, []).append(got)
        new: Facts = {}
        for p, parts in made.items():
            every = parts[0]
            for more in parts[1:]:
                every = every.unionByName(more)
            new[p] = cut(minus(every, full[p]))
        new = {p: df for p, df in new.items() if not df.isEmpty()}
        if not new:
            return full
        empty = {p: df.limit(0) for p, df in full.items()}
        delta = {**empty, **new}
        for p, df in new.items():
            pieces[p].append(df)
            if len(pieces[p]) > 16:  # few inputs for each union
                whole = pieces[p][0]
                for more in pieces[p][1:]:
                    whole = whole.unionByName(more)
                pieces[p] = [cut(whole)]
            whole = pieces[p][0]
            for more in pieces[p][1:]:
                whole = whole.unionByName(more)
            full = {**full, p: whole}


def bag_recursion(base: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = 1000) -> DataFrame:
    """UNION ALL recursion: each round sees the rows of the round before only; repeats stay."""
    total = delta = cut(base)
    for _ in range(most_rounds):
        delta = cut(step(delta))
        if delta.isEmpty():
            return total
        total = total.unionByName(delta)
    raise TooManyRounds(f"recursive query: more than {most_rounds} rounds")
