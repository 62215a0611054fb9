"""Protects rows as they stream in."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veilframe.engine import Engine


def protect_stream(engine: Engine, rows: DataFrame, table: str, checkpoint: str, continuous: bool = False) -> StreamingQuery:
    """Appends the logical rows of a stream to a protected table, micro-batch by micro-batch: external rows that are still missing
    first, then the table. A micro-batch that is replayed after a failure appends nothing twice: its appends carry the query's id, which
    the checkpoint keeps, and the number of the batch. Without ``continuous`` it takes what is there and ends."""

    def write(batch: DataFrame, number: int) -> None:
        query = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        batch = batch.persist()
        try:
            engine.insert(table, batch, token=f"{query}-{number}")
        finally:
            batch.unpersist()

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer if continuous else writer.trigger(availableNow=True)).start()
