"""Orders, budgets and cuts.

Every cut is ``orderBy(...).limit(n)`` (a top-k per task, then a merge of k rows each), never a
global window. The per-group floor is ``row_number() <= f``, which Spark limits per task before
the shuffle, so a group that holds a third of the rows sends only its f best rows per task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import fixed_values as V
from siftline.functions.keys import recency_number
from siftline.functions.text import contains_any, text_or_empty
from siftline.session import cut_lineage


def preference_order(preferred_places=("hungary", "budapest"), tie_breaks: bool = True,
                     position=("pos",), remote: Column = None) -> list:
    """Score, alerted, place that needs no permit or remote, recency, position.

    ``remote`` is the row's own flag, for tables that have one; the place may say it as well.
    """
    if not tie_breaks:
        return [F.desc("score"), *[F.asc(p) for p in position]]
    place = F.lower(text_or_empty("location"))
    free = contains_any(place, (*preferred_places, "remote"))
    if remote is not None:
        free = free | F.coalesce(remote, F.lit(False))
    return [F.desc("score"), F.desc("alerted"), F.desc(free),
            F.desc(recency_number(F.col("date_posted"))), *[F.asc(p) for p in position]]


def _floor_then_score(df: DataFrame, order: list, budget: int, floor: int, key: str,
                      track: str) -> DataFrame:
    """The chosen rows whole, with ``pick``; at most ``budget`` of them."""
    budget = max(0, budget)
    best = df.orderBy(*order).limit(budget).withColumn("_floor", F.lit(False))
    both = best
    if floor > 0:
        w = W.partitionBy(track).orderBy(*order)
        per_track = (df.filter(F.col(track).isNotNull())
                     .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= floor)
                     .drop("_rn").orderBy(*order).limit(budget))
        both = per_track.withColumn("_floor", F.lit(True)).unionByName(best)
    # At most 2 x budget rows from here on; a row picked twice counts as a floor row.
    w_key = W.partitionBy(key).orderBy(F.desc("_floor"))
    once = both.withColumn("_n", F.row_number().over(w_key)).filter("_n = 1").drop("_n")
    return (once.orderBy(F.desc("_floor"), *order).limit(budget)
            .withColumn("pick", F.when(F.col("_floor"), "floor").otherwise("score"))
            .drop("_floor"))


def select_with_floor(df: DataFrame, order: list, budget: int, floor: int, key: str = "dedup_key",
                      track: str = "track") -> DataFrame:
    """The chosen rows (key, pick): up to ``floor`` per track, then the best of the rest.

    The best ``budget`` rows overall are enough for the second pass: at most ``budget`` rows can be
    taken, and each floor row among them frees no extra place. Pass a narrow frame: the key, the
    track and what the order reads.
    """
    return _floor_then_score(df, order, budget, floor, key, track).select(key, "pick")


def select_with_alerts(df: DataFrame, order: list, budget: int, alert_budget: int, floor: int,
                       key: str = "dedup_key", track: str = "track",
                       alert: Column = None) -> DataFrame:
    """Chosen rows (key, pick): alerted rows from their own pool first, then floor and score."""
    budget = max(0, budget)
    is_alert = F.col("alerted") if alert is None else alert
    pool = (df.filter(is_alert).orderBy(*order).limit(min(max(0, alert_budget), budget))
            .withColumn("pick", F.lit("alert")))
    rest = _floor_then_score(df.filter(~is_alert), order, budget, floor, key, track)
    # Alerts keep their places; floor and score rows fill what is left.
    turn = F.when(F.col("pick") == "alert", 0).when(F.col("pick") == "floor", 1).otherwise(2)
    return pool.unionByName(rest).orderBy(turn, *order).limit(budget).select(key, "pick")


def annotate(df: DataFrame, chosen: DataFrame, budget: int, alert_budget: int,
             stage: str = "shortlist", key: str = "dedup_key") -> DataFrame:
    """Every row with ``selected`` and the reason; no row disappears."""
    what = "shortlist" if stage == "shortlist" else "pre-rank"
    cut = "shortlist" if stage == "shortlist" else "deep-rank"
    out = df.join(chosen, key, "left")
    reason = (F.when(F.col("pick") == "alert", "alert-matched")
              .when(F.col("pick").isNotNull(), f"top of the {what}")
              .when(F.col("alerted"), f"alert-matched but over the alert budget of {alert_budget}")
              .otherwise(f"below the {cut} budget of {budget}"))
    return out.withColumns({"selected": F.col("pick").isNotNull(), "reason": reason})


def first_stage_alert_cap(budget: int, final_budget: int, final_alerts: int) -> int:
    """How many alerted rows the wide cut may hold so that the final cut can still be filled."""
    return max(0, budget - max(0, final_budget - final_alerts))


def cut_members(shortlist: DataFrame, cut: int, alert_budget: int, floor: int,
                key: str = "dedup_key") -> DataFrame:
    """The rows the final cut would take now: alerts in file order, floor, then score."""
    slim = shortlist.select(*dict.fromkeys([key, "track", "score", "pos"]),
                            F.lower(text_or_empty("reason")).contains("alert-matched")
                            .alias("_pool"))
    # Alerted rows rank by position alone, the others by score.
    order = [F.desc(F.when(F.col("_pool"), 0).otherwise(F.col("score"))), F.asc("pos")]
    return select_with_alerts(slim, order, max(0, cut), alert_budget, floor, key,
                              alert=F.col("_pool")).select(key)


def fetch_targets(candidates: DataFrame, members: DataFrame, budget: int,
                  key: str = "dedup_key") -> DataFrame:
    """All candidates with their fetch tier columns, ``eligible`` and ``target``.

    Needs ``fetchable`` (a posting id and no body), ``unverified``, ``alert_source``, ``repeat``,
    ``half``, ``match``, ``score`` and ``pos``.
    """
    rows = (candidates.join(members.withColumn("_in", F.lit(True)), key, "left")
            .withColumn("in_cut", F.coalesce("_in", F.lit(False))).drop("_in"))
    verify = F.col("unverified") & F.col("in_cut")
    rows = rows.withColumns({
        "verify": verify,
        "eligible": F.col("fetchable") & ((F.col("match") > 0) | F.col("alert_source")
                                          | (F.col("half") != "") | verify)})
    order = [F.desc("verify"), F.desc(F.when(F.col("verify"), F.col("score")).otherwise(0)),
             F.desc(F.col("half") != ""), F.desc("alert_source"), F.desc("unverified"),
             F.asc("repeat"), F.desc("match"), F.asc("pos")]
    picked = (rows.filter("eligible").orderBy(*order).limit(max(0, budget))
              .select(key, F.lit(True).alias("_target")))
    return (rows.join(picked, key, "left")
            .withColumn("target", F.coalesce("_target", F.lit(False))).drop("_target"))


def fetch_counters(targets: DataFrame) -> DataFrame:
    """The counters of one fetch allocation in one aggregate."""
    c = F.col
    over = c("eligible") & ~c("target")
    n = F.count_if
    return targets.agg(
        n(c("has_id")).alias("cards"), n(~c("has_id") & c("board_portal")).alias("unparseable_id"),
        n(c("has_id") & c("has_body")).alias("already_full"),
        n(c("fetchable") & c("repeat")).alias("already_seen"),
        n(c("fetchable") & ~c("eligible")).alias("no_title_match"),
        n(over).alias("over_budget"), n(over & c("alert_source")).alias("alert_over_budget"),
        n(over & c("verify")).alias("verify_over_budget"),
        n(c("target") & c("verify")).alias("verify_targets"),
        n(c("target") & c("alert_source")).alias("alert_targets"),
        n(c("target") & (c("half") != "")).alias("half_hybrid_targets"),
        n(c("target") & (c("half") == "enabler")).alias("missing_enabler_targets"),
        n(c("target") & (c("half") == "domain")).alias("missing_domain_targets"),
        n(c("target") & c("unverified")).alias("gate_unknown_targets"),
        n(c("in_cut")).alias("rank_cut"), n(c("in_cut") & c("unverified"))
        .alias("unverified_in_cut"),
        n(c("in_cut") & c("unverified") & ~c("fetchable")).alias("unreachable_in_cut"))


def final_gate(jobs: DataFrame, live: DataFrame, strong: int = V.STRONG_SCORE,
               minimum: int = V.MIN_SCORE, cap: int = V.DRAFT_CAP, key: str = "key") -> DataFrame:
    """Every job with its gate result: kept, or rejected with a note.

    The store decides whether a job is alert-matched; a differing claim is flagged.
    Needs ``score`` (text or number), ``alert_matched`` (the claim), ``enriched`` and ``pos``.
    """
    known = live.select(F.col("key").alias(key)).distinct().withColumn("_live", F.lit(True))
    j = jobs.join(known, key, "left")
    # Truncate, not round: 74.9 stays below 75.
    whole = F.coalesce(F.col("score").cast("string").try_cast("double").try_cast("int"),
                       F.lit(-1))
    store = F.coalesce("_live", F.lit(False))
    j = j.withColumns({"_score": whole, "_store": store})
    usable = F.col("_score") >= 0
    j = j.withColumns({
        "alert_corrected": usable & (F.coalesce("alert_matched", F.lit(False)) != F.col("_store")),
        "gate_reason": F.when(usable & (F.col("_score") >= strong), "score>=75")
        .when(usable & (F.col("_score") >= minimum) & F.col("_store"), "alert_matched+score>=60"),
        "gate_note": F.when(~usable, "no usable score")
        .when((F.col("_score") >= strong) | ((F.col("_score") >= minimum) & F.col("_store")),
              F.lit(None).cast("string"))
        .when(F.col("_score") >= minimum, F.concat(
            F.lit("score "), F.col("_score"), F.lit(f" below {strong} and not alert-matched")))
        .otherwise(F.concat(F.lit("score "), F.col("_score"), F.lit(f" below {minimum}")))})
    j = j.withColumn("alert_matched", F.when(usable, F.col("_store"))
                     .otherwise(F.col("alert_matched")))
    cleared = j.filter(F.col("gate_reason").isNotNull())
    kept = (cleared.orderBy(F.desc("_score"), F.desc("_store"),
                            F.desc(F.coalesce("enriched", F.lit(False))), F.asc("pos"))
            .limit(max(0, cap)).select("pos", F.lit(True).alias("_kept")))
    out = j.join(kept, "pos", "left").withColumn("kept", F.coalesce("_kept", F.lit(False)))
    over = F.col("gate_reason").isNotNull() & ~F.col("kept")
    return (out.withColumn("gate_note", F.when(
        over, f"cleared the gate but over the cap of {cap}").otherwise(F.col("gate_note")))
        .drop("_live", "_store", "_kept", "_score"))


def final_gate_counts(gated: DataFrame) -> DataFrame:
    c, n = F.col, F.count_if
    return gated.agg(
        F.count("*").alias("ranker_returned"),
        n(c("gate_reason").isNull()).alias("gate_rejected"),
        n(c("gate_reason").isNotNull() & ~c("kept")).alias("over_cap"),
        n(c("gate_note") == "no usable score").alias("unscored"),
        n("alert_corrected").alias("alert_claim_corrected"), n("kept").alias("cleared"))


def ranked_order() -> list:
    """Order of the ranked list: score, alerted, with a full body."""
    return [F.desc("score"), F.desc("alert_matched"),
            F.desc(F.coalesce(F.col("description"), F.lit("")) != ""), F.asc("pos")]


def display_index(df: DataFrame, score: str = "score", pos: str = "pos") -> DataFrame:
    """Display order with an index: numeric scores first, best first, nulls last.

    A range sort gives every task a slice of the order; an index is its slice's offset plus the
    place inside the slice, so no task sees all rows.
    """
    order = [F.desc_nulls_last(score), F.asc(pos)]
    return sorted_index(df, order, "idx")


def sorted_index(df: DataFrame, order: list, out: str = "idx") -> DataFrame:
    """Zero-based index in a total order without a global window."""
    # Materialised once: a second run of the range sort could cut its slices elsewhere.
    ranged = cut_lineage(df.sort(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition: the running offset is tiny.
    offsets = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n"))
                           .alias("_offset"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return (ranged.withColumn("_place", place).join(offsets, "_part")
            .withColumn(out, (F.col("_offset") + F.col("_place") - 1).cast("bigint"))
            .drop("_part", "_place", "_offset"))


def closest_misses(deferred: DataFrame, n: int = 10) -> DataFrame:
    """The best deferred rows that are not near-duplicates."""
    return (deferred.filter((F.col("score") != 0)
                            & ~text_or_empty("reason").contains("near-duplicate"))
            .orderBy(F.desc("score"), F.asc("pos")).limit(n))


def rotating_cohort(df: DataFrame, order: list, day: int, cap: int, reserve: int = 0,
                    always: Column = None) -> DataFrame:
    """Today's cohort: the always-included rows, then a window that walks the rest day by day.

    ``cap - reserve`` rows at most (at least one). Each day starts where the day before stopped
    and wraps, so all rows are covered in ``ceil(n / take)`` days.
    """
    take = max(1, cap - reserve)
    fixed = df.filter(always) if always is not None else df.limit(0)
    rest = df.filter(~always) if always is not None else df
    head = fixed.orderBy(*order).limit(take)
    counts = df.agg(F.count_if(always) if always is not None else F.lit(0),
                    F.count("*")).first()
    n_fixed, n_rest = int(counts[0]), int(counts[1]) - int(counts[0])
    room = take - n_fixed
    cohort = head.withColumn("part", F.lit("always"))
    if room <= 0 or n_rest == 0:
        return cohort
    start = (day * room) % n_rest
    indexed = sorted_index(rest, order, "_idx")
    window = indexed.filter(F.pmod(F.col("_idx") - start, F.lit(n_rest)) < room).drop("_idx")
    return cohort.unionByName(window.withColumn("part", F.lit("rotating")))


def newest_dates(df: DataFrame, date: str, keep: int, today) -> DataFrame:
    """Each distinct date with ``kept``: the newest ``keep`` dates and always today.

    The window runs over distinct dates, one row per day of history.
    """
    days = df.select(date).distinct()
    rank = F.row_number().over(W.orderBy(F.desc(date)))
    return days.withColumn("kept", (rank <= max(0, keep))
                           | (F.col(date) == F.lit(today).cast("date")))
