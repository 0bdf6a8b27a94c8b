"""Tables that follow streams: each micro-batch is one commit, once, even when it is tried again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.sources.store import Table


def apply_batch(table: Table, name: str, batch: DataFrame, number: int, order: str | None = None, deleted: str | None = None) -> bool:
    """Commits a batch unless the log says that it was committed. deleted: a column that marks keys that go. Of a key's rows, the last by order counts."""
    state = table.current()
    if state.batches.get(name, -1) >= number:
        return False
    tx = table.catalog.begin()
    tx.batches[name] = number
    if order is not None:
        from docweave.operators.change import last_of_each

        batch = last_of_each(table.keyed(batch), table.spec.key, order)
    if deleted is not None:
        gone = F.coalesce(F.col(f"`{deleted}`").cast("boolean"), F.lit(False))
        tx.insert(table, batch.where(~gone).drop(deleted))
        tx.delete(table, table.keyed(batch).where(gone))
    else:
        tx.insert(table, batch)
    tx.commit()
    return True


def follow(stream: DataFrame, table: Table, name: str, checkpoint: str, order: str | None = None, deleted: str | None = None, every: str | None = None, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Starts to maintain table from stream. every: an interval such as "10 seconds"; without it, what is there now is taken and the query ends."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            if apply_batch(table, name, batch, number, order, deleted):
                if table.spec.texts:
                    table.index()  # a layer with what the batch changed
                if after:
                    after(number)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
