"""The funnel: corpus, wide shortlist, final cut. No row leaves without a reason."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import gates as G
from siftline.functions.fixed_values import ALERT_EXPIRY_DAYS, FAIL
from siftline.functions.scores import attribute_track
from siftline.functions.text import words
from siftline.operators.axes import Vocabulary, has_signal, score_axes
from siftline.operators.details import merge_detail
from siftline.operators.gating import evaluate_gates, with_evidence
from siftline.operators.joins import alert_status, flag_alerted, live_keys, mark_repeats
from siftline.operators.neardup import collapse_near_duplicates
from siftline.operators.selection import (annotate, first_stage_alert_cap, preference_order,
                                          select_with_alerts)
from siftline.session import cut_lineage

NO_SIGNAL = "title and description match no scoring category"


@dataclass(frozen=True)
class Settings:
    """Everything a funnel run depends on besides its tables."""

    vocabulary: Vocabulary
    tracks: dict
    today: str
    shortlist_budget: int = 80
    final_budget: int = 25
    alert_budget: int = 10
    floor: int = 3
    preferred_places: tuple = ("hungary", "budapest")
    expiry_days: int = ALERT_EXPIRY_DAYS
    gate_options: dict = field(default_factory=dict)

    def alert_cap(self, stage: str) -> int:
        if stage == "final":
            return self.alert_budget
        return first_stage_alert_cap(self.shortlist_budget, self.final_budget,
                                     self.alert_budget)

    def budget(self, stage: str) -> int:
        return self.final_budget if stage == "final" else self.shortlist_budget


SLIM = ("dedup_key", "pos", "title", "company", "url", "location", "portal", "date_posted")


def scored_and_gated(corpus: DataFrame, seen: DataFrame, alerts: DataFrame,
                     s: Settings) -> DataFrame:
    """Scores, tracks, gates, alert flags and repeat marks; bodies are dropped again.

    One narrow pass over the text, then two joins with stores. What goes on is a slim table, so
    the later sorts and joins never move posting bodies.
    """
    df = with_evidence(corpus).drop("full_text", "caveat", "evidence_source")
    df = score_axes(df, s.vocabulary)
    df = df.withColumn("_words", words(F.col("title")))
    df = df.withColumn("track", attribute_track(F.col("_words"), s.tracks)["track"])
    df = evaluate_gates(df, s.today, min_body_domains=s.vocabulary.weights[
        "core_tech_exempt_min_body_domains"], **s.gate_options)
    df = df.select(*SLIM, "track", "axes", "gates", F.col("axes.score").alias("score"))
    df = flag_alerted(df, live_keys(alert_status(alerts, s.today, s.expiry_days)))
    return mark_repeats(df, seen, s.today)


def cut(corpus: DataFrame, seen: DataFrame, alerts: DataFrame, s: Settings,
        stage: str = "shortlist") -> DataFrame:
    """Every corpus row with score, gates, ``selected``, ``pick`` and ``reason``."""
    scored = cut_lineage(scored_and_gated(corpus, seen, alerts, s))
    early = F.when(F.col("gates.overall") == FAIL, G.discard_reason(F.col("gates"))).when(
        ~has_signal(F.col("alerted"), F.col("axes")), NO_SIGNAL)
    scored = scored.withColumn("early_reason", early)
    candidates = scored.filter(F.col("early_reason").isNull())
    collapsed = collapse_near_duplicates(
        candidates.select(*SLIM, "track", "score", "alerted"),
        [(~F.col("alerted")).alias("o1"), (-F.col("score")).alias("o2"),
         F.col("pos").alias("o3")])
    collapsed = cut_lineage(collapsed)
    keepers = collapsed.filter(F.col("dedup_key") == F.col("keeper_key"))
    order = preference_order(s.preferred_places)
    budget, alert_cap = s.budget(stage), s.alert_cap(stage)
    chosen = select_with_alerts(keepers, order, budget, alert_cap, s.floor)
    titles = keepers.select(F.col("dedup_key").alias("keeper_key"),
                            F.col("title").alias("keeper_title"))
    absorbed = (collapsed.filter(F.col("dedup_key") != F.col("keeper_key"))
                .select("dedup_key", "keeper_key").join(titles, "keeper_key"))
    out = annotate(scored, chosen, budget, alert_cap, stage).join(
        absorbed.drop("keeper_key"), "dedup_key", "left")
    merged = F.concat(F.lit('near-duplicate of "'), F.col("keeper_title"),
                      F.lit('" at the same company'))
    return (out.withColumn("reason", F.coalesce(
        F.col("early_reason"), F.when(F.col("keeper_title").isNotNull(), merged),
        F.col("reason"))).drop("early_reason", "keeper_title"))


def two_stage(corpus: DataFrame, details: DataFrame, seen: DataFrame, alerts: DataFrame,
              s: Settings) -> DataFrame:
    """Wide cut, detail merge on its rows only, final cut, verdicts back onto the corpus.

    Bodies are read again for shortlisted keys only: a semi join with at most the budget of rows.
    """
    first = cut_lineage(cut(corpus, seen, alerts, s, "shortlist"))
    keys = first.filter("selected").select("dedup_key")
    enriched = merge_detail(corpus.join(keys, "dedup_key", "left_semi"), details)
    second = cut(enriched, seen, alerts, s, "final")
    fields = ("score", "track", "axes", "gates", "selected", "pick", "reason")
    back = second.select("dedup_key", F.struct(*fields).alias("final"))
    out = first.join(back, "dedup_key", "left")
    return out.withColumns({
        f: F.when(F.col("final").isNotNull(), F.col("final")[f]).otherwise(F.col(f))
        for f in fields}).withColumn("stage", F.when(F.col("final").isNotNull(), "final")
                                     .otherwise("shortlist")).drop("final")
