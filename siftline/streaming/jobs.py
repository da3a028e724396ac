"""Structured Streaming jobs: run progress, stalls, alert intake, posting intake."""

import datetime
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.functions.keys import dedup_key
from siftline.functions.runlog import (merge_partials, phase_states, progress_partials,
                                       run_percent, stalled)
from siftline.streaming.deltas import compact, read_deltas, write_delta

COMPACT_EVERY = 50

# Executors need no copy of this package: the state function carries its code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
ALERT_FIELDS = ("alert_name", "track", "title", "company")


def _start(stream: DataFrame, fold, merge, path: str, checkpoint: str, trigger: dict,
           every: int) -> StreamingQuery:
    """Write a delta a batch and fold the state every so many batches, between two of them."""
    def batch(df: DataFrame, batch_id: int) -> None:
        write_delta(fold(df), batch_id, path)
        if every and (batch_id + 1) % every == 0:
            compact(df.sparkSession, path, batch_id, merge)

    return (stream.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).foreachBatch(batch).start())


def run_progress(lines: DataFrame, path: str, checkpoint: str, trigger: dict = None,
                 every: int = COMPACT_EVERY) -> StreamingQuery:
    """Log lines (run_id, seq, ts, line) into the progress state at ``path``."""
    return _start(lines, progress_partials, merge_partials, path, checkpoint, trigger, every)


def progress_now(spark, path: str, now=None) -> DataFrame:
    """Percent, completeness and stall flag of every run, from the merged state."""
    runs = run_percent(phase_states(merge_partials(read_deltas(spark, path))))
    return runs if now is None else stalled(runs, now)


def alert_partials(sightings: DataFrame) -> DataFrame:
    """Sightings (key, first_alerted, fields..., seq) folded to one row per key."""
    return sightings.groupBy("key").agg(
        F.min_by(F.struct("first_alerted", *ALERT_FIELDS), F.struct("first_alerted", "seq"))
        .alias("first"), F.min(F.struct("first_alerted", "seq")).alias("order"),
        F.max("seen_on").alias("last_seen"))


def fold_alert_partials(partials: DataFrame) -> DataFrame:
    """Partials of many batches as one a key, still partials."""
    return partials.groupBy("key").agg(
        F.min_by("first", "order").alias("first"), F.min("order").alias("order"),
        F.max("last_seen").alias("last_seen"))


def merge_alert_partials(partials: DataFrame) -> DataFrame:
    """The alert store: earliest sighting kept, last sighting refreshed."""
    return fold_alert_partials(partials).select("key", "first.*", "last_seen")


def alert_intake(sightings: DataFrame, path: str, checkpoint: str, trigger: dict = None,
                 every: int = COMPACT_EVERY) -> StreamingQuery:
    return _start(sightings, alert_partials, fold_alert_partials, path, checkpoint, trigger, every)


def posting_intake(postings: DataFrame, event_time: str = "ts",
                   delay: str = "1 day") -> DataFrame:
    """Streamed postings, one per key within the watermark.

    The first arrival is kept; inside one micro-batch the order is Spark's, which is weaker than
    the explicit order of the batch operator. Copies later than the delay pass again.
    """
    return _keyed(postings, event_time, delay).dropDuplicatesWithinWatermark(["dedup_key"])


def _keyed(postings: DataFrame, event_time: str, delay: str) -> DataFrame:
    return postings.withColumns({
        "dedup_key": dedup_key(F.col("url"), F.col("company"), F.col("title")),
        event_time: F.col(event_time).cast("timestamp")}).withWatermark(event_time, delay)


def earliest_postings(postings: DataFrame, event_time: str = "ts",
                      delay: datetime.timedelta = datetime.timedelta(days=1)) -> DataFrame:
    """Streamed postings, of each key the one with the earliest event time, whatever arrives first.

    A key's state is the earliest posting so far. Copies up to ``delay`` after it are dropped, an
    earlier one within the delay takes its place, and a later one closes it and is held in turn. A
    held posting leaves when the watermark has passed it by the delay, for nothing earlier can come
    then; its key's state goes with it. Equal times go to the smaller row.
    """
    rows = _keyed(postings, event_time, f"{int(delay.total_seconds())} seconds")
    names = rows.columns

    def order(row: tuple) -> tuple:
        return row[names.index(event_time)], tuple(map(str, row))

    def step(key, frames, state):
        at = names.index(event_time)
        if state.hasTimedOut:
            out = [state.get]
            state.remove()
        else:
            held, out = state.get if state.exists else None, []
            for row in sorted((tuple(x) for f in frames for x in f.itertuples(index=False)),
                              key=order):
                if held is None or order(row) < order(held) and held[at] - row[at] <= delay:
                    held = row
                elif row[at] < held[at] - delay:
                    out.append(row)
                elif row[at] > held[at] + delay:
                    out.append(held)
                    held = row
            closes = int(pd.Timestamp(held[at]).timestamp() * 1000 + delay.total_seconds() * 1000)
            if closes <= state.getCurrentWatermarkMs():
                out.append(held)
                if state.exists:
                    state.remove()
            else:
                state.update(held)
                state.setTimeoutTimestamp(closes)
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy("dedup_key").applyInPandasWithState(
        step, rows.schema, rows.schema, "append", "EventTimeTimeout")
