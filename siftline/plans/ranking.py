"""From external decisions to ranked rows, lists and the updated store."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.scores import band, overall_score
from siftline.operators.joins import alert_status, live_keys, merge_seen_store, split_ranked
from siftline.operators.validation import batch_verdicts, correct_alert_claims, enforce_gates


def accepted_decisions(jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions of batches that passed validation; a bad batch is rejected whole."""
    ok = batch_verdicts(jobs.select("batch_id", F.col("dedup_key").alias("key")), decisions)
    return enforce_gates(decisions.join(ok.filter("accepted").select("batch_id"), "batch_id",
                                        "left_semi"))


def ranked_rows(jobs: DataFrame, decisions: DataFrame, alerts: DataFrame, today: str) -> DataFrame:
    """Scored decisions joined to their records, with score, verdict and outcome."""
    d = accepted_decisions(jobs, decisions)
    s = F.col("scores")
    scored = (d.filter("decision = 'score'")
              .withColumn("score", overall_score(s["technical"], s["experience"],
                                                 s["behavioral"], s["career"]))
              .withColumn("verdict", band(F.col("score")))
              .withColumn("alert_matched", F.lit(False)))
    live = live_keys(alert_status(alerts, today, reject_future=True))
    scored = correct_alert_claims(scored, live).drop("corrected")
    record = jobs.select("batch_id", F.col("dedup_key").alias("key"), "title", "company", "url",
                         "location", "portal", "description", "pos")
    return split_ranked(scored.join(record, ["batch_id", "key"]))


def seen_after(seen: DataFrame, ranked: DataFrame, today: str) -> DataFrame:
    """The seen store after a run: every scored key has a fresh entry, dropped keys none."""
    entries = ranked.select(
        "key", F.lit("ranked").alias("status"), F.col("score").alias("rank_score"),
        F.col("verdict").alias("rank_verdict"), F.lit(today).alias("rank_date"),
        F.col("location_gate").alias("location"), "portal", "track", "alert_matched", "url")
    return merge_seen_store(seen, entries)
