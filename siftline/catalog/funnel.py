"""The whole funnel over the derived postings, and its reports."""

from pyspark.sql import functions as F

from siftline.catalog.base import (POSTINGS, SENTENCES, TODAY, TRACKS, VOCABULARY, axis_ctes, postings, query,
                                   table)
from siftline.catalog.gates import ALL
from siftline.catalog.scores import TRACKED, scored
from siftline.functions.scores import attribute_track
from siftline.functions.text import words
from siftline.operators import reports as R
from siftline.operators.selection import (annotate, closest_misses, preference_order,
                                          select_with_alerts, sorted_index)
from siftline.operators.validation import complement, deferred_view
from siftline.plans.funnel import Settings, cut, two_stage
from siftline.session import cut_lineage

SETTINGS = Settings(vocabulary=VOCABULARY, tracks=TRACKS, today=TODAY, shortlist_budget=80,
                    final_budget=25, alert_budget=10, floor=3)


def stores(spark, sf):
    """Seen and alert stores derived from the same documents."""
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    key = F.concat(F.lit("url:https://jobs.example.com/"), i)
    seen = d.filter(i % 4 == 1).select(key.alias("key"), F.date_format(F.date_sub(
        F.lit("2024-02-28").cast("date"), (i % 5).cast("int")), "yyyy-MM-dd").alias("rank_date"))
    alerts = d.filter(i % 6 == 2).select(key.alias("key"), F.date_format(F.date_sub(
        F.lit("2024-02-28").cast("date"), (i % 50).cast("int")), "yyyy-MM-dd")
        .alias("first_alerted"))
    return seen, alerts


def shortlist(spark, sf):
    seen, alerts = stores(spark, sf)
    return cut(postings(spark, sf), seen, alerts, SETTINGS)


_ORDER = """score DESC, alerted DESC, (contains(lower(location), 'hungary')
  OR contains(lower(location), 'budapest') OR contains(lower(location), 'remote')) DESC,
  date_posted DESC, pos"""


def funnel_sql(records: str, budget: int, alert_cap: int, floor: int, stage: str) -> str:
    """The whole funnel over ``records``, a CTE named postings: every row with its last reason.

    Titles of the derived records differ in so many words that only equal ones are near-duplicates.
    """
    what, cut_name = (("shortlist", "shortlist") if stage == "shortlist"
                      else ("pre-rank", "deep-rank"))
    return f"""WITH {records}, {SENTENCES}{ALL}, {TRACKED.replace(' best AS', ' trk AS')},
 s0 AS (SELECT p.pos, p.dedup_key, p.title, p.company, p.location, p.date_posted, ax.score,
   trk.track, o.overall, o.failed, p.pos % 6 = 2 AND p.pos % 50 <= 28 AS alerted,
   p.pos % 4 = 1 AS is_repeat, dt + db + et + eb > 0 AS matched
  FROM postings p JOIN ax USING (pos) JOIN overall o ON o.pos = p.pos
  LEFT JOIN trk ON trk.pos = p.pos),
 s1 AS (SELECT *, CASE WHEN overall = 'FAIL' THEN 'hard gate: ' || failed
   WHEN NOT (alerted OR matched) THEN 'title and description match no scoring category' END
   AS early FROM s0),
 s2 AS (SELECT *, first_value(pos) OVER (PARTITION BY lower(company), title
   ORDER BY alerted DESC, score DESC, pos) AS keeper FROM s1 WHERE early IS NULL),
 rw AS (SELECT * FROM s2 WHERE keeper = pos),
 pool AS (SELECT pos FROM rw WHERE alerted ORDER BY {_ORDER} LIMIT {min(alert_cap, budget)}),
 fl AS (SELECT pos FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY {_ORDER}) AS rn
   FROM rw WHERE NOT alerted AND track IS NOT NULL) WHERE rn <= {floor}),
 sel AS (SELECT pos, pick FROM (SELECT rw.*, CASE WHEN pool.pos IS NOT NULL THEN 'alert'
   WHEN fl.pos IS NOT NULL THEN 'floor' ELSE 'score' END AS pick FROM rw LEFT JOIN pool USING (pos)
   LEFT JOIN fl USING (pos) WHERE NOT alerted OR pool.pos IS NOT NULL)
   ORDER BY CASE pick WHEN 'alert' THEN 0 WHEN 'floor' THEN 1 ELSE 2 END, {_ORDER} LIMIT {budget}),
 ann AS (SELECT s1.*, pick, pick IS NOT NULL AS selected, CASE WHEN s1.early IS NOT NULL THEN s1.early
   WHEN s2.keeper <> s1.pos THEN 'near-duplicate of "' || s1.title || '" at the same company'
   WHEN pick = 'alert' THEN 'alert-matched' WHEN pick IS NOT NULL THEN 'top of the {what}'
   WHEN s1.alerted THEN 'alert-matched but over the alert budget of {alert_cap}'
   ELSE 'below the {cut_name} budget of {budget}' END AS reason
  FROM s1 LEFT JOIN s2 ON s2.pos = s1.pos LEFT JOIN sel ON sel.pos = s1.pos)"""


_FIRST = funnel_sql(POSTINGS, 80, 65, 3, "shortlist")


def _without_quotes(reason, gates):
    """Quotes are evidence in the record's own words; the twin names the gates."""
    return F.when(reason.startswith("hard gate"), F.concat(
        F.lit("hard gate: "), F.array_join(gates["failed"], ","))).otherwise(reason)


@query("shortlist_stages", f"""{_FIRST} SELECT dedup_key, title, company, track, score, overall,
 alerted, is_repeat, selected, pick, reason FROM ann""")
def shortlist_stages(spark, sf):
    return shortlist(spark, sf).select(
        "dedup_key", "title", "company", "track", "score", "gates.overall", "alerted",
        "is_repeat", "selected", "pick",
        _without_quotes(F.col("reason"), F.col("gates")).alias("reason"))


@query("deferred_with_gates", f"""{_FIRST} SELECT dedup_key AS key, title, company, dedup_key[5:] AS url,
 location, company AS portal, score AS prerank_score, track AS track_guess, reason,
 overall AS gate_overall, failed AS gate_failed FROM ann WHERE NOT selected""")
def deferred_with_gates(spark, sf):
    """The deferred list as a report shows it, gate columns included."""
    rows = shortlist(spark, sf)
    rows = rows.withColumn("reason", _without_quotes(F.col("reason"), F.col("gates")))
    return deferred_view(rows).withColumn("gate_failed", F.array_join("gate_failed", ","))


@query("shortlist")
def shortlist_rows(spark, sf):
    """Every posting with its score, gates and the reason of its last stage."""
    return shortlist(spark, sf).select(
        "dedup_key", "title", "company", "track", "score", "gates.overall", "alerted",
        "is_repeat", "selected", "pick", "reason")


@query("funnel_report", f"""{_FIRST} SELECT count(*) AS total, count_if(is_repeat) AS repeats,
 count_if(overall = 'FAIL') AS gate_failed, count_if(overall = 'UNKNOWN') AS gate_unknown,
 count_if(reason LIKE '%match no scoring category') AS no_signal,
 count_if(reason LIKE 'near-duplicate%') AS near_duplicates,
 count_if(coalesce(pick, '') = 'alert') AS alert_selected,
 count_if(reason LIKE 'alert-matched but over%') AS alert_over_budget,
 count_if(coalesce(pick, '') = 'floor') AS floor_slots,
 count_if(coalesce(pick, '') = 'score') AS score_slots, count_if(selected) AS selected,
 count_if(NOT selected) AS deferred, 80 AS budget, 65 AS alert_budget FROM ann""")
def funnel_report(spark, sf):
    return R.funnel_summary(shortlist(spark, sf), 80, SETTINGS.alert_cap("shortlist"))


# First the snippets alone, then the bodies of a third of the shortlisted rows.
_THIN = POSTINGS.replace("postings AS (SELECT", "full_p AS (SELECT") + """,
 postings AS (SELECT * REPLACE (substr(description, 1, 500) AS description, TRUE AS cut)
  FROM full_p)"""
_BODY = "trim(description, ' ' || chr(10) || chr(13) || chr(9))"
_RICH = POSTINGS.replace("postings AS (SELECT", "full_p AS (SELECT") + f""",
 postings AS (SELECT f.* REPLACE (CASE WHEN f.pos % 3 <> 0 THEN substr(description, 1, 500)
   WHEN length({_BODY}) > 20000 THEN substr({_BODY}, 1, 20000) || '…' ELSE {_BODY} END
   AS description, f.pos % 3 <> 0 OR length({_BODY}) > 20000 AS cut)
  FROM full_p f JOIN first_cut USING (pos) WHERE first_cut.selected)"""


@query("two_stage_cut", f"""WITH first_cut AS ({funnel_sql(_THIN, 80, 65, 3, 'shortlist')}
  SELECT pos, selected FROM ann),
 final_cut AS ({funnel_sql(_RICH, 25, 10, 3, 'final')} SELECT pos, selected FROM ann)
SELECT CASE WHEN b.pos IS NULL THEN 'shortlist' ELSE 'final' END AS stage,
 coalesce(b.selected, a.selected) AS selected, count(*) AS n
FROM first_cut a LEFT JOIN final_cut b USING (pos) GROUP BY 1, 2""")
def two_stage_cut(spark, sf):
    seen, alerts = stores(spark, sf)
    d = postings(spark, sf)
    details = d.filter(F.col("pos") % 3 == 0).select(
        "dedup_key", F.lit(False).alias("failed"), "description")
    thin = d.withColumns({"description_snippet": F.substring("description", 1, 500),
                          "description": F.lit(None).cast("string"),
                          "description_truncated": F.lit(False)})
    return two_stage(thin, details, seen, alerts, SETTINGS).groupBy("stage", "selected").agg(
        F.count("*").alias("n"))


# ---- the cut alone, against SQL: alerts, floor, score
def _rows(spark, sf):
    p = scored(spark, sf)
    p = p.select("dedup_key", "pos", "title", "company", "url", "location", "portal",
                 "date_posted", F.col("axes.score").alias("score"),
                 words(F.col("title")).alias("_w"), (F.col("pos") % 6 == 2).alias("alerted"))
    return p.withColumn("track", attribute_track(F.col("_w"), TRACKS)["track"]).drop("_w")


def _cut(spark, sf):
    # Scored once into a slim stored table; the pool, the floor and the cut read that.
    rows = cut_lineage(_rows(spark, sf))
    chosen = select_with_alerts(rows, preference_order(), 80, 20, 5)
    return annotate(rows, chosen, 80, 20)


CUT = f"""{POSTINGS}, {axis_ctes()}, {TRACKED}, rw AS (SELECT ax.pos, dedup_key, title, company,
  portal, location, date_posted, score, ax.pos % 6 = 2 AS alerted, track FROM ax
  LEFT JOIN best ON best.pos = ax.pos),
 pool AS (SELECT pos FROM rw WHERE alerted ORDER BY {_ORDER} LIMIT 20),
 fl AS (SELECT pos FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY {_ORDER}) AS rn
   FROM rw WHERE NOT alerted AND track IS NOT NULL) WHERE rn <= 5),
 sel AS (SELECT pos, pick FROM (SELECT rw.*, CASE WHEN pool.pos IS NOT NULL THEN 'alert'
   WHEN fl.pos IS NOT NULL THEN 'floor' ELSE 'score' END AS pick FROM rw LEFT JOIN pool USING (pos)
   LEFT JOIN fl USING (pos) WHERE NOT alerted OR pool.pos IS NOT NULL)
   ORDER BY CASE pick WHEN 'alert' THEN 0 WHEN 'floor' THEN 1 ELSE 2 END, {_ORDER} LIMIT 80),
 ann AS (SELECT rw.*, pick, CASE WHEN pick = 'alert' THEN 'alert-matched' WHEN pick IS NOT NULL
   THEN 'top of the shortlist' WHEN alerted THEN 'alert-matched but over the alert budget of 20'
   ELSE 'below the shortlist budget of 80' END AS reason FROM rw LEFT JOIN sel USING (pos))"""


@query("shortlist_floor", f"WITH {CUT} SELECT pos, score, track, pick, reason FROM ann")
def shortlist_floor(spark, sf):
    return _cut(spark, sf).select("pos", "score", "track", "pick", "reason")


@query("deferral_histogram", f"""WITH {CUT} SELECT reason, count(*) AS n FROM ann
WHERE pick IS NULL GROUP BY reason""")
def deferral_histogram(spark, sf):
    return R.reason_histogram(complement(_cut(spark, sf)))


@query("closest_misses", f"""WITH {CUT} SELECT pos, score, reason FROM ann
WHERE pick IS NULL AND score <> 0 ORDER BY score DESC, pos LIMIT 10""")
def misses(spark, sf):
    return closest_misses(complement(_cut(spark, sf))).select("pos", "score", "reason")


@query("deferred_rows", f"""WITH {CUT} SELECT dedup_key AS key, title, portal,
 score AS prerank_score, track AS track_guess, reason FROM ann WHERE pick IS NULL""")
def deferred_rows(spark, sf):
    gates = F.struct(F.lit("PASS").alias("overall"),
                     F.array().cast("array<string>").alias("failed"))
    return deferred_view(_cut(spark, sf).withColumn("gates", gates)).select(
        "key", "title", "portal", "prerank_score", "track_guess", "reason")


@query("verification", """SELECT count_if(o_orderstatus = 'F') AS verified,
 count_if(o_orderstatus = 'O') AS unverified, count(*) AS selected FROM orders""")
def verification(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "PASS").when(
        F.col("o_orderstatus") == "O", "UNKNOWN").otherwise("FAIL")
    return R.verification(table(spark, sf, "orders").select(
        F.struct(status.alias("overall")).alias("gates")))


@query("preference_with_remote", f"""WITH {POSTINGS}, r AS (SELECT *, pos % 3 AS score,
  pos % 6 = 2 AS alerted, CASE WHEN pos % 4 <> 3 THEN pos % 4 = 1 END AS remote FROM postings)
SELECT pos, row_number() OVER (ORDER BY score DESC, alerted DESC, (coalesce(remote, FALSE)
  OR contains(lower(location), 'hungary') OR contains(lower(location), 'budapest')
  OR contains(lower(location), 'remote')) DESC, date_posted DESC, pos) - 1 AS idx FROM r""")
def preference_with_remote(spark, sf):
    """The order of the cut where rows say themselves that they are remote."""
    i = F.col("pos")
    p = postings(spark, sf).select(
        "pos", "location", "date_posted", (i % 3).alias("score"), (i % 6 == 2).alias("alerted"),
        F.when(i % 4 != 3, i % 4 == 1).alias("remote"))
    return sorted_index(p, preference_order(remote=F.col("remote"))).select("pos", "idx")
