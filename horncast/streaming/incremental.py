"""Closure kept up to date over a stream: each micro-batch is loaded as new facts and the model closed again.

Only rows that are new take part in the first round, so a batch costs what it changes.  Programs are
monotone, and keys that are bound keep their elements (``bind``), so a batch that is delivered twice adds
nothing.  The model is saved after each batch: after a restart, ``reopen`` its folder (``model.store.root``) and
start again with the same checkpoint; a batch whose facts were not saved is delivered again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..model import Model


def close_over(stream: DataFrame, model: Model, load: Callable[[Model, DataFrame], None], checkpoint: str, *, available_now: bool = True, **limits) -> StreamingQuery:
    """Starts a query that loads every micro-batch with ``load(model, batch)`` and closes the model."""

    def batch(df: DataFrame, _: int) -> None:
        kept = df.persist()  # a batch is read once, however many relations it feeds
        try:
            load(model, kept)
            model.close(**limits)
            model.save()
        finally:
            kept.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
