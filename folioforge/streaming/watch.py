"""Watching a folder or a table of events: incremental ingest and debouncing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch_folder(spark: SparkSession, folder: str, pattern: str = "*.{pdf,PDF}") -> DataFrame:
    """A stream of (path, file_hash, size, modified); files are seen once."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").schema(
        "path string, modificationTime timestamp, length bigint, content binary"
    ).load(folder)
    return files.where("length > 0").select("path", F.sha2("content", 256).alias("file_hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def ingest(stream: DataFrame, known: Callable[[], DataFrame], target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes files whose content is neither known nor in the batch before. Without
    ``every`` it runs over what is there and stops, else it goes on at that interval;
    started again on the same checkpoint it goes on where it stopped.

    A batch is written to a folder of its own number, so that a batch that is run again
    takes the place of its first try.
    """

    def batch(files: DataFrame, number: int) -> None:
        first = files.groupBy("file_hash").agg(F.min_by(F.struct("path", "size", "modified"), "path").alias("f")).select("file_hash", "f.*")
        first.join(known().select("file_hash"), "file_hash", "left_anti").write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def sync_then_watch(stream: DataFrame, known: Callable[[], DataFrame], target: str, checkpoint: str, every: str = "60 seconds") -> StreamingQuery:
    """First all files that are there, then those that come, until it is stopped."""
    ingest(stream, known, target, checkpoint).awaitTermination()
    return ingest(stream, known, target, checkpoint, every)


def stop(query: StreamingQuery, seconds: int = 60) -> bool:
    """Lets the batch in hand end, then stops; whether the query has stopped."""
    if query.isActive:
        query.processAllAvailable()
        query.stop()
        query.awaitTermination(seconds)
    return not query.isActive


def _keep(last: float | None, times: list[float], wait: float) -> tuple[list[bool], float | None]:
    kept = []
    for t in times:
        ok = last is None or t - last >= wait
        kept.append(ok)
        last = t if ok else last
    return kept, last


def debounce(events: DataFrame, seconds: float) -> DataFrame:
    """(key, ts, id) of events (key, ts, id), batch or stream: an event is dropped if it
    comes within ``seconds`` of the last one kept for its key.

    State is one number a key. In a batch the events of one key are folded in order of
    (ts, id) from sorted partitions, never gathered; in a stream, in arrival order.
    """
    if not events.isStreaming:
        def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, last = object(), None
            for f in frames:
                at, keys = (pd.to_datetime(f.ts, utc=True) - pd.Timestamp(0, tz="UTC")).dt.total_seconds().to_numpy(), f.key.to_numpy()
                starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
                keep: list[bool] = []
                for a, b in zip(starts, starts[1:], strict=False):
                    if keys[a] != key:
                        key, last = keys[a], None
                    kept, last = _keep(last, at[a:b].tolist(), seconds)
                    keep += kept
                yield f[keep]

        ordered = events.select("key", "ts", "id").where("key is not null and ts is not null").repartition("key").sortWithinPartitions("key", "ts", "id")
        return ordered.mapInPandas(fold, ordered.schema)

    def state(key: tuple, frames: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        last = s.get[0] if s.exists else None
        for f in frames:
            f = f.sort_values(["ts", "id"])
            kept, last = _keep(last, [t.timestamp() for t in f.ts], seconds)
            yield f[kept][["key", "ts", "id"]]
        if last is not None:
            s.update((last,))

    return events.groupBy("key").applyInPandasWithState(state, "key string, ts timestamp, id bigint", "last double", "append", GroupStateTimeout.NoTimeout)
