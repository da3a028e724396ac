"""Validation of externally supplied decisions, and set checks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import fixed_values as V
from siftline.functions.text import WHITESPACE


def _text(c: Column) -> Column:
    return F.coalesce(F.btrim(c, F.lit(WHITESPACE)), F.lit("")) != ""


def _texts(c: Column) -> Column:
    return c.isNotNull() & F.forall(c, _text)


def decision_errors(decisions: DataFrame) -> DataFrame:
    """Add ``errors``: the rules a decision breaks. Drops need a reason, scores the full set."""
    dropped = F.col("decision") == "drop"
    scored = F.col("decision") == "score"
    s = F.col("scores")

    def bad_range(name):
        v = s[name]
        return v.isNull() | F.isnan(v) | (v < 0) | (v > 100)

    rules = [
        (~F.coalesce(scored | dropped, F.lit(False)), "invalid decision"),
        (~F.coalesce(F.col("location_gate").isin(*V.GATE_VALUES), F.lit(False)),
         "invalid location gate"),
        (~F.coalesce(F.col("language_gate").isin(*V.GATE_VALUES), F.lit(False)),
         "invalid language gate"),
        (dropped & ~_text(F.col("drop_reason")), "drop without a reason"),
        *[(scored & F.coalesce(bad_range(n), F.lit(True)), f"invalid {n} score")
          for n in V.OVERALL_WEIGHTS],
        (scored & ~_text(F.col("track")), "score without a track"),
        (scored & ~_texts(F.col("strengths")), "invalid strengths"),
        (scored & ~_texts(F.col("gaps")), "invalid gaps"),
    ]
    return decisions.withColumn("errors", F.array_compact(F.array(
        *[F.when(test, name) for test, name in rules])))


def batch_verdicts(expected: DataFrame, decisions: DataFrame, batch: str = "batch_id",
                   key: str = "key") -> DataFrame:
    """One row per batch: accepted only when keys match one to one and no decision is bad.

    Both sides are counted per (batch, key) and summed in one union, with partial aggregation.
    """
    judged = decision_errors(decisions)
    left = expected.select(batch, key, F.lit(1).alias("want"), F.lit(0).alias("got"),
                           F.lit(0).alias("bad"))
    right = judged.select(batch, key, F.lit(0).alias("want"), F.lit(1).alias("got"),
                          (F.size("errors") > 0).cast("int").alias("bad"))
    per_key = left.unionByName(right).groupBy(batch, key).agg(
        F.sum("want").alias("want"), F.sum("got").alias("got"), F.sum("bad").alias("bad"))
    out = per_key.groupBy(batch).agg(
        F.count_if((F.col("want") > 0) & (F.col("got") == 0)).alias("missing"),
        F.count_if((F.col("want") == 0) & (F.col("got") > 0)).alias("extra"),
        F.count_if((F.col("got") > 1) | (F.col("want") > 1)
                   | (~_text(F.col(key)) & (F.col("want") > 0))).alias("repeated"),
        F.sum("bad").alias("bad_decisions"))
    wrong = F.col("missing") + F.col("extra") + F.col("repeated") + F.col("bad_decisions")
    return out.withColumn("accepted", wrong == 0)


def enforce_gates(decisions: DataFrame) -> DataFrame:
    """A FAIL gate turns a score decision into a drop, recorded as ``coerced``."""
    failed = F.array_compact(F.array(
        F.when(F.upper("location_gate") == "FAIL", "location"),
        F.when(F.upper("language_gate") == "FAIL", "language")))
    forced = (F.size(failed) > 0) & (F.col("decision") != "drop")
    reason = F.coalesce("drop_reason", F.lit(""))
    note = F.concat(F.array_join(failed, ", "),
                    F.lit(" gate returned FAIL alongside a score decision - the gate wins"),
                    F.when(reason != "", F.concat(F.lit("; "), reason)).otherwise(""))
    return decisions.withColumns({
        "coerced": forced,
        "drop_reason": F.when(forced, note).otherwise(F.col("drop_reason")),
        "decision": F.when(forced, "drop").otherwise(F.col("decision"))})


def correct_alert_claims(ranked: DataFrame, live: DataFrame, key: str = "key") -> DataFrame:
    """The store's word replaces the claim; ``corrected`` marks where they differ."""
    known = live.select(F.col("key").alias(key)).distinct().withColumn("_live", F.lit(True))
    out = ranked.join(known, key, "left")
    store = F.coalesce("_live", F.lit(False))
    return out.withColumns({
        "corrected": F.coalesce("alert_matched", F.lit(False)) != store,
        "alert_matched": store}).drop("_live")


def complement(corpus: DataFrame) -> DataFrame:
    """The deferred part of an annotated corpus."""
    return corpus.filter(~F.coalesce("selected", F.lit(False)))


def deferred_view(annotated: DataFrame) -> DataFrame:
    """Deferred rows trimmed to what a report shows."""
    return complement(annotated).select(
        F.col("dedup_key").alias("key"), "title", "company", "url", "location", "portal",
        F.col("score").alias("prerank_score"), F.col("track").alias("track_guess"), "reason",
        F.col("gates.overall").alias("gate_overall"), F.col("gates.failed").alias("gate_failed"))


def not_drafted_view(gated: DataFrame) -> DataFrame:
    """Rejected rows with nine carried fields and the note."""
    return gated.filter(~F.col("kept")).select(
        "key", "title", "company", "url", "location", "portal", "track", "score", "verdict",
        F.coalesce("gate_note", F.lit("below the drafting gate")).alias("gate_note"))


def unknown_names(requested: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """Requested names that match no known name by slug."""
    from siftline.functions.keys import slug

    wanted = requested.select(slug(F.col(name)).alias("slug")).distinct()
    return wanted.join(known.select(slug(F.col(name)).alias("slug")), "slug", "left_anti")


def matched_names(requested: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """Known names that a request matches by slug, in their own spelling."""
    from siftline.functions.keys import slug

    wanted = requested.select(slug(F.col(name)).alias("_slug")).distinct()
    return (known.withColumn("_slug", slug(F.col(name)))
            .join(wanted, "_slug", "left_semi").drop("_slug"))


def repeated_names(plans: DataFrame, name: str = "name") -> DataFrame:
    """Plan names used more than once."""
    return plans.groupBy(name).agg(F.count("*").alias("n")).filter("n > 1")


def drop_malformed(raw: DataFrame, corrupt: str = "_corrupt_record") -> DataFrame:
    return raw.filter(F.col(corrupt).isNull())


def malformed_count(raw: DataFrame, corrupt: str = "_corrupt_record") -> DataFrame:
    return raw.agg(F.count_if(F.col(corrupt).isNotNull()).alias("malformed"))
