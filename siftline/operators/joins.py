"""Joins of records with stores, ledgers, decisions and logs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import fixed_values as V
from siftline.functions.keys import iso_date
from siftline.functions.text import words
from siftline.operators.skew import running_sum, spread_join


# Outcome states a runner may record.
RECORDED_STATES = ("pending", "running", "done", "failed", "skipped", "paused")


def alert_status(store: DataFrame, today, expiry_days: int = V.ALERT_EXPIRY_DAYS,
                 reject_future: bool = False) -> DataFrame:
    """Each store entry labelled live, expired or undated; an undatable entry is never live.

    ``reject_future`` is the stricter of the two liveness rules in use: a future date is not live.
    """
    today = F.lit(today).cast("date")
    when = iso_date(F.col("first_alerted"))
    age = F.datediff(today, when)
    label = (F.when(when.isNull(), "undated").when(age > expiry_days, "expired"))
    if reject_future:
        label = label.when(age < 0, "expired")
    return store.withColumn("alert_status", label.otherwise("live"))


def alert_counts(status: DataFrame) -> DataFrame:
    return status.agg(F.count("*").alias("alert_entries"),
                      *[F.count_if(F.col("alert_status") == s).alias(f"alert_{s}")
                        for s in ("live", "expired", "undated")])


def live_keys(status: DataFrame) -> DataFrame:
    return status.filter("alert_status = 'live'").select("key").distinct()


def flag_alerted(records: DataFrame, live: DataFrame, key: str = "dedup_key") -> DataFrame:
    """Flag, never filter. Adaptive execution broadcasts the live set where its size allows."""
    flags = live.select(F.col("key").alias(key)).withColumn("_live", F.lit(True))
    return (records.join(flags, key, "left")
            .withColumn("alerted", F.coalesce("_live", F.lit(False))).drop("_live"))


def run_ledger(seen: DataFrame) -> DataFrame:
    """Distinct ``rank_date`` values with the number of later run dates.

    A run date has the shape of a date; other spellings are no runs but have runs after them. There
    may be any number of those, so runs are counted over range slices, never in one window.
    """
    dated = (seen.select(F.trim("rank_date").alias("last_seen")).filter("last_seen <> ''")
             .distinct())
    is_run = F.col("last_seen").rlike(r"^.{4}-.{2}-.{2}$").cast("int")
    counted = running_sum(dated, [F.desc("last_seen")], is_run, "upto")
    return counted.select("last_seen", (F.col("upto") - is_run).cast("int").alias("runs_ago"))


def mark_repeats(records: DataFrame, seen: DataFrame, today, key: str = "dedup_key") -> DataFrame:
    """Mark records that ran before with the number of distinct later runs; never filter."""
    today = F.lit(today).cast("string")
    store = seen.select(F.col("key").alias(key),
                        F.trim(F.coalesce("rank_date", F.lit(""))).alias("last_seen"))
    # Most of a store may carry the date of one run.
    joined = (spread_join(store, run_ledger(seen), ["last_seen"], [F.col(key)], "left")
              .withColumn("is_repeat", F.lit(True)))
    out = records.join(joined, key, "left").withColumn("is_repeat", F.coalesce(
        "is_repeat", F.lit(False)))
    n = F.col("runs_ago")
    label = (F.when(~F.col("is_repeat"), F.lit(None).cast("string"))
             .when(F.coalesce("last_seen", F.lit("")) == "", "🔁 seen before")
             .when((n == 0) & (F.col("last_seen") >= today), "🔁 seen earlier today")
             .when(n == 0, F.concat(F.lit("🔁 seen in the last run ("), F.col("last_seen"),
                                    F.lit(")")))
             .otherwise(F.concat(F.lit("🔁 seen "), n, F.when(n == 1, " run ago")
                                 .otherwise(" runs ago"))))
    return out.withColumns({"repeat_label": label,
                            "last_seen": F.nullif(F.col("last_seen"), F.lit(""))})


def merge_stage(corpus: DataFrame, stage: DataFrame, fields, key: str = "dedup_key",
                pos: str = "pos") -> DataFrame:
    """A stage's fields back onto the corpus; only present values overwrite, the last row wins."""
    picked = (stage.filter(F.col(key).isNotNull()).groupBy(key)
              .agg(F.max_by(F.struct(*fields), pos).alias("_stage")))
    out = corpus.join(picked, key, "left")
    return out.withColumns({f: F.coalesce(F.col("_stage")[f], F.col(f)) if f in corpus.columns
                            else F.col("_stage")[f] for f in fields}).drop("_stage")


def stage_counts(corpus: DataFrame, stage: DataFrame, key: str = "dedup_key") -> DataFrame:
    """One row: stage rows without a key, stage keys joined, stage keys the corpus lacks."""
    keyed = stage.filter(F.col(key).isNotNull()).select(key).distinct()
    marked = keyed.join(corpus.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    parts = (stage.filter(F.col(key).isNull()).select(F.lit("unkeyed").alias("part"))
             .unionByName(marked.select(F.when(F.col("hit") == 1, "joined")
                                        .otherwise("unmatched").alias("part"))))
    return parts.agg(*[F.count_if(F.col("part") == p).alias(p)
                       for p in ("unkeyed", "joined", "unmatched")])


def in_tracker(records: DataFrame, tracker: DataFrame) -> DataFrame:
    """Flag records whose (company, role) is tracked, case-folded and trimmed."""
    fold = lambda c: F.lower(F.trim(F.col(c)))
    known = (tracker.select(fold("company").alias("_c"), fold("role").alias("_r")).distinct()
             .withColumn("_known", F.lit(True)))
    out = records.withColumns({"_c": fold("company"), "_r": fold("title")})
    return (out.join(known, ["_c", "_r"], "left")
            .withColumn("tracked", F.coalesce("_known", F.lit(False))).drop("_c", "_r", "_known"))


def drafted_status(records: DataFrame, applications: DataFrame) -> DataFrame:
    """Drafted when an application has the same company and title, else Pending."""
    made = (applications.select("company", "title").distinct().withColumn("_made", F.lit(True)))
    return (records.join(made, ["company", "title"], "left")
            .withColumn("status", F.when(F.col("_made"), "Drafted").otherwise("Pending"))
            .drop("_made"))


def merge_alert_store(store: DataFrame, sightings: DataFrame, today) -> DataFrame:
    """New alert store: the earliest ``first_alerted`` stays, ``last_seen`` is refreshed.

    A store entry without a usable date is replaced by the sighting. Sightings fold with
    associative aggregates, so a hot key is combined before the shuffle.
    """
    fields = ("alert_name", "track", "title", "company")
    new = (sightings.groupBy("key").agg(
        F.min_by(F.struct("first_alerted", *fields), F.struct("first_alerted", "pos"))
        .alias("n")))
    old = store.withColumnRenamed("key", "_key")
    keeps = F.coalesce(F.col("o.first_alerted"), F.lit("")) != ""
    joined = (new.alias("n").join(
        old.select("_key", F.struct("first_alerted", "last_seen", *fields).alias("o")),
        F.col("key") == F.col("_key"), "full_outer"))
    n, o = F.col("n"), F.col("o")
    pick = {f: F.when(n.isNull() | (o.isNotNull() & keeps), o[f]).otherwise(n[f])
            for f in ("first_alerted", *fields)}
    return joined.select(
        F.coalesce("key", "_key").alias("key"), pick["first_alerted"].alias("first_alerted"),
        F.when(n.isNull(), o["last_seen"]).otherwise(F.lit(today).cast("string"))
        .alias("last_seen"), *[pick[f].alias(f) for f in fields])


def merge_seen_store(seen: DataFrame, scored: DataFrame) -> DataFrame:
    """Scored keys replace their entry, all others stay."""
    return (seen.join(scored.select("key").distinct(), "key", "left_anti")
            .unionByName(scored, allowMissingColumns=True))


def keep_live(store: DataFrame, live: DataFrame) -> DataFrame:
    """The store pruned to its live keys; only on request."""
    return store.join(live.select("key").distinct(), "key", "left_semi")


def attribute_alerts(headings: DataFrame, alert_names, track_map: dict,
                     text: str = "heading") -> DataFrame:
    """The longest configured name contained in a heading, and its track.

    The names are configuration, so they become one expression; unmapped names keep a null track.
    """
    import re

    def plain(n):
        return re.sub(r"[^a-z0-9]+", " ", n.lower()).strip()

    ordered = sorted((n for n in alert_names if plain(n)), key=lambda n: -len(plain(n)))
    hay = F.btrim(words(F.col(text)))
    name = F.coalesce(*[F.when(hay.contains(plain(n)), n) for n in ordered],
                      F.lit(None).cast("string"))
    track = F.coalesce(*[F.when(F.col("alert_name") == n, t) for n, t in track_map.items()],
                       F.lit(None).cast("string"))
    return headings.withColumn("alert_name", name).withColumn("alert_track", track)


def merge_outcomes(jobs: DataFrame, log: DataFrame, attempts: DataFrame,
                   state: DataFrame) -> DataFrame:
    """Outcome per job: finished work wins, then recorded state, running, failure of this run.

    ``jobs(idx, company, complete)``, ``log(idx, pos, code, error)`` in order of appearance,
    ``attempts(company, pos, kind)`` with kind start or skip, ``state(idx, status, error)``.
    """
    last = (log.filter("code <> 0").groupBy("idx")
            .agg(F.max_by("error", "pos").alias("log_error")))
    tried = attempts.groupBy("company").agg(
        F.max(F.when(F.col("kind") == "start", 1).otherwise(0)).alias("started"),
        F.max(F.when(F.col("kind") == "skip", 1).otherwise(0)).alias("skipped"))
    newest = (attempts.filter("kind = 'start'").agg(F.max_by("company", "pos").alias("company"))
              .filter("company is not null").withColumn("in_flight", F.lit(True)))
    st = state.filter(F.col("status").isin(*RECORDED_STATES)).select(
        "idx", F.col("status").alias("st_status"), F.col("error").alias("st_error"))
    j = (jobs.join(last, "idx", "left").join(tried, "company", "left")
         .join(newest, "company", "left").join(st, "idx", "left"))
    skipped = F.coalesce(F.col("skipped") == 1, F.lit(False))
    done = F.col("complete") & ~skipped
    failed_now = F.col("log_error").isNotNull() & (F.col("started") == 1)
    status = (F.when(done, "done").when(F.col("st_status").isNotNull(), F.col("st_status"))
              .when(skipped, "skipped").when(F.col("in_flight"), "running")
              .when(failed_now, "failed").otherwise("pending"))
    text = F.when(F.col("st_status").isNotNull(), F.col("st_error")).otherwise(
        F.substring("log_error", 1, 200))
    return j.select("idx", "company", status.alias("status"),
                    F.when(status == "failed", F.coalesce(text, F.lit(""))).otherwise("")
                    .alias("error"))


def split_ranked(scored: DataFrame, strong: float = V.STRONG_SCORE,
                 minimum: float = V.MIN_SCORE) -> DataFrame:
    """Label scored rows: ranked, not drafted, or neither; nothing is dropped."""
    score = F.col("score")
    reason = (F.when(score >= strong, "score>=75")
              .when((score >= minimum) & F.col("alert_matched"), "alert_matched+score>=60"))
    return scored.withColumn("gate_reason", reason).withColumn(
        "outcome", F.when(F.col("gate_reason").isNotNull(), "ranked")
        .when(score >= minimum, "not_drafted").otherwise("below"))
