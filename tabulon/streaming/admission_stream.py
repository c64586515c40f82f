"""Z1 as a Structured Streaming operator: keyed state with
``applyInPandasWithState``.

State per key: the last ``limit`` admitted stamps and the event time of the
last processed event.  Inside a micro-batch a key's rows are ordered by
(ts, id) before the state machine runs, so the decisions equal the batch
operator's whenever events arrive in time order across micro-batches.  An
event older than the key's last processed event would need history that is
gone: it comes out with status ``late`` and is not admitted; one without a
time is ``invalid``, as in the batch operator.  Every input event comes out
once.  There is no watermark and no timeout, because Spark
removes rows behind a watermark before a state function with an event-time
timeout sees them; the state is one small record for each key.
"""

from __future__ import annotations

import uuid
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tabulon.operators.admission import LIMIT, WINDOW_SECONDS, _check, admit_sequence, event_micros
from tabulon.session import checkpoint_dir

STATE_SCHEMA = T.StructType([
    T.StructField("stamps", T.ArrayType(T.LongType())),
    T.StructField("last_us", T.LongType()),
])


def _output_schema(id_type: T.DataType, key_type: T.DataType, ts_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("event_id", id_type),
        T.StructField("key", key_type),
        T.StructField("ts", ts_type),
        T.StructField("admitted", T.BooleanType()),
        T.StructField("status", T.StringType()),
    ])


def _state_fn(limit: int, window_us: int):
    def fn(key, pdfs, state):
        frames = [p for p in pdfs if not p.empty]
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True).sort_values(["_us", "event_id"], kind="mergesort")
        if state.exists:
            stamps_list, last_us = state.get
            stamps = deque(stamps_list or [], maxlen=limit)
        else:
            stamps, last_us = deque(), None
        invalid = pdf["_us"].isna().to_numpy()
        ts = pdf["_us"].fillna(0).to_numpy(dtype=np.int64)
        late = ~invalid & (False if last_us is None else ts < last_us)
        flags = np.zeros(len(pdf), dtype=bool)
        ok = ~late & ~invalid
        if ok.any():
            flags[ok], stamps = admit_sequence(ts[ok], limit, window_us, stamps)
            last_us = int(ts[ok].max())
        state.update((list(stamps), last_us))
        status = np.where(invalid, "invalid", np.where(late, "late", np.where(flags, "admitted", "rejected")))
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "key": pdf["key"].to_numpy(),
                            "ts": pdf["ts"].to_numpy(), "admitted": flags, "status": status})
    return fn


def admission_stream(stream: DataFrame, key: str = "key", ts: str = "ts", tie: str = "event_id",
                     limit: int = LIMIT, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Streaming Z1: input stream with (tie, key, ts) -> (event_id, key, ts,
    admitted, status), append mode; one output row for every input row."""
    limit, window_us = _check(limit, window_seconds)
    base = stream.select(F.col(tie).alias("event_id"), F.col(key).alias("key"), F.col(ts).alias("ts"),
                         event_micros(ts).alias("_us"))
    schema = _output_schema(stream.schema[tie].dataType, stream.schema[key].dataType, stream.schema[ts].dataType)
    return base.groupBy("key").applyInPandasWithState(
        _state_fn(limit, window_us), schema, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def run_to_table(spark: SparkSession, source_dir: str, schema: T.StructType, transform,
                 max_files_per_trigger: int | None = None, out_root: str | None = None,
                 glob: str | None = None, max_bytes_per_trigger: int | None = None,
                 files_in_time_order: bool = False) -> DataFrame:
    """Run a parquet file stream (files of ``source_dir``, optionally only
    those matching ``glob``) to completion (``availableNow``) through
    ``transform`` into a parquet table under the shared checkpoint folder and
    return that table as a batch DataFrame.  The sink and its checkpoint live
    in the folder the cluster names in ``spark.checkpoint.dir``, so a lost
    executor or a restarted driver resumes instead of recomputing.

    Without a limit all files are one micro-batch.  A limit splits them in
    file order, which changes what is late unless that order is the events':
    the caller has to say so (``files_in_time_order``), else it is refused."""
    if (max_files_per_trigger or max_bytes_per_trigger) and not files_in_time_order:
        raise ValueError("several micro-batches need files in event-time order (files_in_time_order=True)")
    root = (out_root or checkpoint_dir(spark)).rstrip("/") + f"/tabulon-stream-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    elif max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    query = (transform(reader.parquet(source_dir)).writeStream
             .format("parquet").outputMode("append")
             .option("checkpointLocation", root + "/_checkpoint")
             .trigger(availableNow=True)
             .start(root + "/out"))
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.parquet(root + "/out")
