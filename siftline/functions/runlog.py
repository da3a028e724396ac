"""Run-log lines and run progress."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import fixed_values as V

_PHASE = (r"(?i)\bPhase\s+(" + "|".join(sorted((p for p, _ in V.RUN_PHASES), key=len,
                                               reverse=True)) + r")(?![\w-])")
# A job count in a message, and item tallies that are no verdict.
_COUNT = (r"(?i)(?:complete(?:\s+on\s+attempt[^:]*)?:\s*|offering\s+)(\d+)\s+(?:of\s+\d+\s+)?"
          r"(?:[a-z][a-z-]*\s+){0,2}?(?:job|jobs|job\(s\))\b")
_TALLY = r"(?i)\b\d+\s+(?:failed|failures?|timeouts?|timed\s+out)\b"
RUN_DONE = "*"


def parse_line(line: Column) -> Column:
    """Struct of stamp, message, phase, status and count; null for lines without meaning.

    The line that ends a run has phase ``*``.
    """
    stamp = F.regexp_extract(line, r"^\[(\d{2}:\d{2}:\d{2})\]", 1)
    message = F.trim(F.regexp_extract(line, r"^\[\d{2}:\d{2}:\d{2}\]\s*(.*)$", 1))
    phase = F.lower(F.regexp_extract(message, _PHASE, 1))
    done = message == V.RUN_COMPLETE_MESSAGE
    verdict = F.regexp_replace(F.regexp_replace(F.lower(message), _PHASE, " phase "), _TALLY, " ")
    status = (F.when(verdict.rlike("failed|fatal|timeout"), "failed")
              .when(verdict.contains("skipped"), "skipped")
              .when(verdict.contains("complete"), "done").otherwise("running"))
    return F.when((stamp != "") & (done | (phase != "")), F.struct(
        stamp.alias("stamp"), message.alias("message"),
        F.when(done, RUN_DONE).otherwise(phase).alias("phase"),
        F.when(done, "done").otherwise(status).alias("status"),
        F.regexp_extract(message, _COUNT, 1).try_cast("int").alias("count")))


def progress_partials(lines: DataFrame) -> DataFrame:
    """Lines (run_id, seq, ts, line) folded to one row per run and phase.

    Every aggregate is a maximum by sequence number, so partials merge in any order and a replayed
    batch changes nothing.
    """
    p = lines.withColumn("p", parse_line(F.col("line"))).filter(F.col("p").isNotNull())
    return p.groupBy("run_id", F.col("p.phase").alias("phase")).agg(
        F.max_by("p.status", "seq").alias("status"), F.max_by("p.message", "seq")
        .alias("message"), F.max("seq").alias("seq"), F.max("ts").alias("ts"),
        F.max_by("p.count", F.when(F.col("p.count").isNotNull(), F.col("seq"))).alias("count"),
        F.max(F.when(F.col("p.count").isNotNull(), F.col("seq"))).alias("count_seq"))


def merge_partials(partials: DataFrame) -> DataFrame:
    """Partials of many batches as one row per run and phase."""
    return partials.groupBy("run_id", "phase").agg(
        F.max_by("status", "seq").alias("status"), F.max_by("message", "seq").alias("message"),
        F.max("seq").alias("seq"), F.max("ts").alias("ts"),
        F.max_by("count", "count_seq").alias("count"), F.max("count_seq").alias("count_seq"))


def phase_states(state: DataFrame) -> DataFrame:
    """Every phase of every run: an open phase is done once a later phase or the end speaks."""
    names = F.array(*[F.lit(p) for p, _ in V.RUN_PHASES])
    known = F.map_from_entries(F.collect_list(F.struct("phase", F.struct(
        "status", "seq", "count"))))
    # One run holds at most one row per phase, so the map has eleven entries at most.
    runs = state.groupBy("run_id").agg(known.alias("k"), F.max("ts").alias("last_activity"))
    end = F.col("k")[F.lit(RUN_DONE)]["seq"]
    rows = runs.select("run_id", "last_activity", end.alias("end_seq"),
                       F.posexplode(F.transform(names, lambda n: F.struct(
                           n.alias("phase"), F.try_element_at(F.col("k"), n).alias("own"))))
                       .alias("position", "x"))
    later = W.partitionBy("run_id").orderBy("position").rowsBetween(1, W.unboundedFollowing)
    rows = rows.withColumn("later_seq", F.greatest(
        F.max(F.col("x.own.seq")).over(later), F.col("end_seq")))
    own = F.col("x.own")
    closed = F.col("later_seq").isNotNull() & (own["seq"].isNull()
                                               | (F.col("later_seq") > own["seq"]))
    status = F.coalesce(own["status"], F.lit("pending"))
    return rows.select(
        "run_id", "position", F.col("x.phase").alias("phase"),
        F.when(status.isin("pending", "running") & closed, "done").otherwise(status)
        .alias("status"), own["count"].alias("count"), "last_activity",
        F.col("end_seq").isNotNull().alias("complete"))


def run_percent(phases: DataFrame) -> DataFrame:
    """Percent per run: finished phases in full, running ones half, 99 at most before the end."""
    weight = F.coalesce(*[F.when(F.col("phase") == p, w) for p, w in V.RUN_PHASES], F.lit(0))
    points = (F.when(F.col("status").isin("done", "skipped", "failed"), weight * 1.0)
              .when(F.col("status") == "running", weight / 2).otherwise(0.0))
    return phases.groupBy("run_id").agg(
        F.when(F.max("complete"), 100).otherwise(F.least(F.lit(99), F.floor(F.sum(points))))
        .cast("int").alias("pct"), F.max("complete").alias("complete"),
        F.max("last_activity").alias("last_activity"))


def stalled(runs: DataFrame, now: Column, seconds: int = V.RUN_STALL_SECONDS) -> DataFrame:
    """Mark runs that are not complete and have been quiet for too long."""
    quiet = (now.cast("timestamp").cast("double")
             - F.col("last_activity").cast("timestamp").cast("double"))
    return runs.withColumn("stalled", ~F.col("complete") & F.coalesce(quiet >= seconds,
                                                                      F.lit(False)))
