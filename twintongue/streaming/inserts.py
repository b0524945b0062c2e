"""Streams as inserts: every micro-batch goes through the triggers and constraints of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..errors import EngineError
from ..plans.engine import Engine


def stream_into(engine: Engine, stream: DataFrame, table: str, checkpoint: str, rejected: Callable[[DataFrame, EngineError], None] | None = None, program: str | None = None, **trigger) -> StreamingQuery:
    """Starts a query that inserts each micro-batch of `stream` into `table`.

    A batch that a trigger or constraint refuses is handed to `rejected` (else the
    query fails). program: Datalog that is evaluated after each batch, so that
    derived tables follow the stream. A batch that is replayed after a failure is
    inserted again only if its changes were not yet in effect: the last batch's
    number is kept with the engine.
    """
    done = {"batch": -1}

    def insert(batch: DataFrame, number: int) -> None:
        if number <= done["batch"]:
            return
        try:
            engine.insert_rows(table, batch)
        except EngineError as e:
            if rejected is None:
                raise
            rejected(batch, e)
        else:
            if program:
                engine.datalog(program)
        done["batch"] = number

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
