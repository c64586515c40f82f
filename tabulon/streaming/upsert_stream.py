"""Keyed upsert of a stream (S8): every micro-batch becomes a version of a
table, exactly once.

The commit of a version carries the number of the micro-batch it came from;
a micro-batch that is run again after a lost driver finds its number
committed and changes nothing.  Inside a micro-batch a key keeps its last row
by the order column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabulon.operators.library import upsert
from tabulon.sources.versioned import VersionedTable


def upsert_batch(target: VersionedTable, batch: DataFrame, batch_id: int, key: str, order: str) -> bool:
    """Upserts one micro-batch; False if it has been committed before."""
    now = target.current()
    if now["tag"] is not None and batch_id <= now["tag"]:
        return False
    target.commit(upsert(target.read(), batch, key, order), tag=batch_id, after=now["version"])
    return True


def upsert_stream(stream: DataFrame, target: VersionedTable, checkpoint: str, key: str = "id", order: str = "seq",
                  trigger: dict | None = None):
    """Starts the stream; ``trigger`` as in ``writeStream.trigger`` (all that is there by default).
    The target's schema holds what the table keeps of the stream's columns, ``key`` among them."""
    return (stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, batch_id: upsert_batch(target, batch, batch_id, key, order) and None)
            .trigger(**(trigger or {"availableNow": True})).start())
