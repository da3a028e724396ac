"""Gates and facts over the derived postings."""

from pyspark.sql import functions as F

from siftline.catalog.base import (POSTINGS, SENTENCES, TODAY, VOCABULARY, any_sql, axis_ctes,
                                   norm_sql, postings, query, table)
from siftline.functions import facts as X
from siftline.functions import fixed_values as V
from siftline.functions import gates as G
from siftline.operators.axes import score_axes
from siftline.session import cut_lineage
from siftline.operators.gating import (display_tally, display_tally_long, evaluate_gates,
                                       gate_failure_counts, with_evidence)


def gated(spark, sf, columns=None):
    df = with_evidence(postings(spark, sf)).drop("full_text", "caveat", "evidence_source")
    return evaluate_gates(score_axes(df, VOCABULARY), TODAY)


def sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _alt(patterns):
    return "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


BASE = f"WITH {POSTINGS}, {SENTENCES}"
SOFTEN = "CASE WHEN {v} = 'PASS' AND cut THEN 'UNKNOWN' ELSE {v} END"

# ---- language
_LANGS = ", ".join(
    f"('{lang}', {sql_list(al)}, '"
    + (rf"\benglish{V.LANGUAGE_JOINER}(?:{'|'.join(al)})\b|\b(?:{'|'.join(al)}){V.LANGUAGE_JOINER}"
       r"english\b") + "')" for lang, al in V.LANGUAGE_NAMES.items())
_STOP = ", ".join(f"({i}, '{lang}', {sql_list(ws)})"
                  for i, (lang, ws) in enumerate(V.LANGUAGE_STOPWORDS.items()))
DETECT = f""", toks AS (SELECT pos, description,
   string_split(trim({norm_sql("title || ' ' || description")}), ' ') AS t FROM postings),
 tot AS (SELECT pos, length(description) AS chars, len(t) AS total, len(list_filter(t,
   lambda x: list_contains({sql_list(V.ENGLISH_STOPWORDS)}, x))) AS english, t FROM toks),
 stop(o, lang, ws) AS (VALUES {_STOP}),
 flat AS (SELECT o, lang, unnest(ws) AS w FROM stop),
 tk AS (SELECT pos, unnest(t) AS w FROM tot),
 cnt AS (SELECT pos, o, lang, count(*) AS hits FROM tk JOIN flat USING (w) GROUP BY ALL),
 best AS (SELECT pos, max(hits) AS hits, arg_max(lang, hits * 100 - o) AS lang FROM cnt
   GROUP BY pos),
 det AS (SELECT tot.pos, total, english, coalesce(hits, 0) AS hits, lang, CASE
   WHEN chars < 400 THEN 'UNKNOWN' WHEN coalesce(hits, 0) >= 8 AND hits / total >= 0.06
     AND hits >= english * 1.5 THEN 'FAIL'
   WHEN total >= 60 AND english / total < 0.06 THEN 'UNKNOWN' ELSE 'PASS' END AS verdict,
   chars >= 400 AND NOT (coalesce(hits, 0) >= 8 AND hits / total >= 0.06
     AND hits >= english * 1.5) AND total >= 60 AND english / total < 0.06 AS absent
   FROM tot LEFT JOIN best USING (pos))"""
LANGUAGE = f"""{DETECT}, langs(lang, al, pair) AS (VALUES {_LANGS}),
 lflat AS (SELECT lang, unnest(al) AS a, pair FROM langs),
 marks AS MATERIALIZED (SELECT pos, ord, n, {any_sql('n', V.LANGUAGE_OPTIONAL)} AS opt,
   {any_sql('n', V.LANGUAGE_REQUIRED)} AS req FROM sent),
 la AS MATERIALIZED (SELECT pos, ord, lang, opt, req, n, pair FROM marks, lflat
   WHERE contains(n, ' ' || a || ' ')),
 lh AS (SELECT DISTINCT pos, ord, lang, opt FROM la
   WHERE opt OR req OR regexp_matches(n, pair)),
 nh AS (SELECT pos, ord, 'native-speaker' AS lang, opt FROM marks WHERE NOT opt AND
   regexp_matches(n, '{_alt(V.NATIVE_SPEAKER_PATTERNS)}')),
 lall AS (SELECT * FROM lh UNION ALL SELECT * FROM nh),
 lagg AS (SELECT pos, string_agg(DISTINCT lang, ',' ORDER BY lang) FILTER (WHERE NOT opt) AS req,
   string_agg(DISTINCT lang, ',' ORDER BY lang) FILTER (WHERE opt) AS opt FROM lall GROUP BY pos),
 lg AS (SELECT p.pos, p.cut, CASE WHEN req IS NOT NULL OR d.verdict = 'FAIL' THEN 'FAIL'
   WHEN d.verdict = 'UNKNOWN' AND absent THEN 'UNKNOWN' ELSE 'PASS' END AS v,
   coalesce(req, '') AS languages_required, coalesce(opt, '') AS languages_optional
   FROM postings p LEFT JOIN lagg USING (pos) JOIN det d USING (pos)),
 language AS (SELECT pos, {SOFTEN.format(v='v')} AS verdict, languages_required,
   languages_optional FROM lg)"""


@query("stopword_language", f"""{BASE}{DETECT}
SELECT pos, total, english, hits, CASE WHEN hits > 0 THEN lang ELSE 'italian' END AS language,
 verdict, absent FROM det""")
def stopword_language(spark, sf):
    p = postings(spark, sf).select(
        "pos", "description", G.gate_text(F.concat_ws(" ", "title", "description")).alias("t"))
    p = p.withColumn("s", G.stopword_hits(F.col("t")))
    counts = G.language_counts(F.col("s"), F.col("t"))
    p = p.withColumns({f"c_{k}": c for k, c in counts.items()})
    d = G.detect_language({k: F.col(f"c_{k}") for k in counts}, F.col("description"))
    return p.select("pos", *[F.col(f"c_{k}").cast("bigint").alias(k)
                             for k in ("total", "english", "hits")],
                    F.col("c_language").alias("language"), d["verdict"].alias("verdict"),
                    d["english_absent"].alias("absent"))


@query("language_agreement", f"""{BASE}{DETECT}
SELECT p.lang, det.verdict, count(*) AS n FROM det JOIN postings p USING (pos) GROUP BY ALL""")
def language_agreement(spark, sf):
    p = postings(spark, sf).select("pos", "lang")
    return (stopword_language(spark, sf).join(p, "pos").groupBy("lang", "verdict")
            .agg(F.count("*").alias("n")))


@query("gate_language", f"""{BASE}{LANGUAGE} SELECT * FROM language""")
def gate_language(spark, sf):
    return gated(spark, sf).select(
        "pos", "gates.language.verdict",
        F.array_join("gates.language.languages_required", ",").alias("languages_required"),
        F.array_join("gates.language.languages_optional", ",").alias("languages_optional"))


# ---- experience: no look-behind in this dialect; the derived texts have no longer numbers.
_YEARS_SQL = V.YEARS.replace("(?<![0-9])", "").replace("(\\d", "(?:\\d").replace("‐-―−－", "")
EXPERIENCE = f""", yr AS (SELECT pos, ord, regexp_extract_all(n, '{_YEARS_SQL}') AS m,
   string_split_regex(n, '{_YEARS_SQL}') AS g FROM sent WHERE regexp_matches(n, '{_YEARS_SQL}')),
 yi AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM yr),
 yw AS (SELECT pos, ord, i, m[i] AS fig, right(array_to_string(list_transform(range(1, i + 1),
    lambda k: g[k] || CASE WHEN k < i THEN m[k] ELSE '' END), ''), 60) AS bef,
   left(array_to_string(list_transform(range(i + 1, len(g) + 1),
    lambda k: g[k] || coalesce(m[k], '')), ''), 45) AS aft FROM yi),
 yn AS (SELECT *, bef || fig || aft AS win, list_max(list_transform(
    regexp_extract_all(fig, '[0-9]{{1,2}}'), lambda x: x::INT)) AS years FROM yw),
 yk AS (SELECT *, CASE WHEN years <= 3 THEN 'soft'
   WHEN {any_sql('bef', V.YEARS_HARD_FLOOR)} AND NOT {any_sql('bef', V.YEARS_AMBIGUOUS)} THEN 'hard'
   WHEN {any_sql('win', V.YEARS_AMBIGUOUS)} THEN 'soft'
   WHEN {any_sql('aft', V.YEARS_DOMAIN_SCOPED)} THEN 'soft'
   WHEN {any_sql('win', V.YEARS_MANDATORY)} OR contains(fig, '+') OR (regexp_matches(aft,
     '{V.YEARS_TENURE_PHRASE}') AND NOT {any_sql('bef', V.YEARS_COMPANY_AGE)}) THEN 'hard'
   ELSE 'soft' END AS kind FROM yn WHERE NOT ({any_sql('win', V.YEARS_NOT_TENURE)}
     AND NOT {any_sql('win', V.YEARS_TENURE_OVERRIDE)})),
 ya AS (SELECT pos, max(years) FILTER (WHERE kind = 'hard') AS hard,
   max(years) FILTER (WHERE kind = 'soft') AS soft FROM yk GROUP BY pos),
 experience AS (SELECT p.pos, CASE WHEN hard IS NOT NULL THEN 'FAIL' WHEN cut THEN 'UNKNOWN'
   ELSE 'PASS' END AS verdict, coalesce(hard, soft) AS years_required
   FROM postings p LEFT JOIN ya USING (pos))"""


@query("gate_experience", f"{BASE}{EXPERIENCE} SELECT * FROM experience")
def gate_experience(spark, sf):
    return gated(spark, sf).select("pos", "gates.experience.verdict",
                                   "gates.experience.years_required")


# ---- sponsorship
_WALLS = ", ".join(f"('{p}')" for p in V.AUTHORISATION_WALL)
SPONSORSHIP = f""", sp AS (SELECT pos, ord, n, regexp_matches(n, '{_alt(V.SPONSORSHIP_DENIED)}')
    AS denied, regexp_matches(n, '{_alt(V.SPONSORSHIP_OFFERED)}') AS offer,
    regexp_matches(n, '{_alt(V.AUTHORISATION_WALL)}') AS wall FROM sent),
 walls(p) AS (VALUES {_WALLS}),
 wh AS (SELECT DISTINCT pos FROM sp, walls WHERE wall AND regexp_matches(n, p) AND NOT
   {any_sql("right(regexp_extract(n, '^(.*?)(?:' || p || ')', 1), 40)", V.WALL_NEGATORS)}),
 sa AS (SELECT pos, bool_or(denied) AS denied, bool_or(offer AND NOT denied) AS offered
   FROM sp GROUP BY pos),
 sponsorship AS (SELECT p.pos, CASE WHEN denied THEN 'sponsorship_denied'
   WHEN NOT offered AND wh.pos IS NOT NULL THEN 'authorisation_wall' END AS bar,
   CASE WHEN denied OR (NOT offered AND wh.pos IS NOT NULL) THEN 'FAIL' WHEN cut THEN 'UNKNOWN'
   ELSE 'PASS' END AS verdict, offered AS sponsorship_offered
   FROM postings p JOIN sa USING (pos) LEFT JOIN wh USING (pos))"""


@query("gate_sponsorship", f"{BASE}{SPONSORSHIP} SELECT * FROM sponsorship")
def gate_sponsorship(spark, sf):
    g = F.col("gates.sponsorship")
    return gated(spark, sf).select("pos", g["bar"].alias("bar"), g["verdict"].alias("verdict"),
                                   g["sponsorship_offered"].alias("sponsorship_offered"))


# ---- seniority, closed, geography, recency, pure technical
SENIORITY = f""", sw AS (SELECT pos, list_filter(string_split_regex({norm_sql('title')},
   '[\\s/&-]+'), lambda x: x <> '') AS w FROM postings),
 si AS (SELECT pos, list_filter(range(1, len(w) + 1), lambda i:
   list_contains({sql_list(V.SENIORITY_WORDS)}, w[i]) AND NOT (w[i] = 'lead' AND
    list_contains({sql_list(V.LEAD_FOLLOWERS)}, coalesce(w[i + 1], '')))) AS hit, w FROM sw),
 seniority AS (SELECT pos, CASE WHEN len(hit) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict,
   w[hit[1]] AS marker FROM si)"""


@query("gate_seniority", f"{BASE}{SENIORITY} SELECT * FROM seniority")
def gate_seniority(spark, sf):
    p = postings(spark, sf).select("pos", "title", G.seniority_marker(F.col("title")).alias("m"))
    g = G.seniority_gate(F.col("m"), F.col("title"))
    return p.select("pos", g["verdict"].alias("verdict"), g["marker"].alias("marker"))


CLOSED = f""", cs AS (SELECT pos, ord, list_filter({sql_list(V.CLOSED_NOTICES)},
   lambda m: contains(n, m))[1] AS marker FROM sent WHERE NOT {any_sql('n', V.CLOSED_DEADLINES)}),
 ca AS (SELECT pos, arg_min(marker, ord) AS marker FROM cs WHERE marker IS NOT NULL GROUP BY pos),
 closed AS (SELECT p.pos, CASE WHEN marker IS NOT NULL THEN 'FAIL' WHEN cut THEN 'UNKNOWN'
   ELSE 'PASS' END AS verdict, marker FROM postings p LEFT JOIN ca USING (pos))"""


@query("gate_closed", f"{BASE}{CLOSED} SELECT * FROM closed")
def gate_closed(spark, sf):
    return gated(spark, sf).select("pos", "gates.closed.verdict", "gates.closed.marker")


def _apart(values):
    return sql_list(" " + v.replace("-", " - ") + " " for v in values)


def _named(values):
    return f"trim(replace(list_filter({_apart(values)}, lambda m: contains(t, m))[1], ' - ', '-'))"


GEOGRAPHY = f""", gt AS (SELECT pos, location, regexp_replace({norm_sql(
    "location || ' ' || title || ' ' || description")}, '([+/&-])', ' \\1 ', 'g') AS t
   FROM postings),
 gm AS (SELECT pos, regexp_matches(lower(trim(location)), ',\\s*(?:{'|'.join(V.SUBDIVISIONS)})'
   || '\\s*(?:,\\s*(?:usa|us|canada))?\\s*$') AS suffix, {_named(V.OUTSIDE_EUROPE)} AS o,
   {_named(V.US_STATES)} AS s, {_named(V.INSIDE_EUROPE)} AS e FROM gt),
 geography AS (SELECT pos, CASE WHEN suffix OR o IS NOT NULL OR s IS NOT NULL THEN 'FAIL'
   WHEN e IS NOT NULL THEN 'PASS' ELSE 'UNKNOWN' END AS verdict,
   CASE WHEN suffix THEN 'us/ca subdivision' ELSE coalesce(o, s, e) END AS marker FROM gm)"""


@query("gate_geography", f"{BASE}{GEOGRAPHY} SELECT * FROM geography")
def gate_geography(spark, sf):
    return gated(spark, sf).select("pos", "gates.geography.verdict", "gates.geography.marker")


RECENCY = f""", recency AS (SELECT pos, CASE
   WHEN DATE '{TODAY}' - date_posted::DATE > 45 THEN 'FAIL'
   WHEN DATE '{TODAY}' - date_posted::DATE < 0 THEN 'UNKNOWN' ELSE 'PASS' END AS verdict
   FROM postings)"""


@query("gate_recency", f"{BASE}{RECENCY} SELECT * FROM recency")
def gate_recency(spark, sf):
    p = postings(spark, sf)
    age = G.posting_age(F.col("date_posted"), F.lit(TODAY).cast("date"))
    p = p.select("pos", "date_posted", age.alias("age"))
    return p.select("pos", G.recency_gate(F.col("age"), F.col("date_posted"))["verdict"]
                    .alias("verdict"))


TECHNICAL = f""", {axis_ctes()}, pure_technical AS (SELECT pos, CASE WHEN core AND dt = 0
   AND db < 2 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM ax)"""


@query("gate_pure_technical", f"WITH {POSTINGS}{TECHNICAL} SELECT * FROM pure_technical")
def gate_pure_technical(spark, sf):
    df = with_evidence(postings(spark, sf))
    return score_axes(df, VOCABULARY).select("pos", G.pure_technical_gate(F.col("axes"))[
        "verdict"].alias("verdict"))


ALL = (LANGUAGE + EXPERIENCE + SPONSORSHIP + SENIORITY + CLOSED + GEOGRAPHY + RECENCY + TECHNICAL
       + ", rolled AS (SELECT p.pos, "
       + ", ".join(f"{n}.verdict AS {n}" for n in V.GATE_ORDER)
       + " FROM postings p " + " ".join(f"JOIN {n} ON {n}.pos = p.pos" for n in V.GATE_ORDER)
       + "), overall AS (SELECT *, CASE WHEN "
       + " OR ".join(f"{n} = 'FAIL'" for n in V.GATE_ORDER) + " THEN 'FAIL' WHEN "
       + " OR ".join(f"{n} = 'UNKNOWN'" for n in V.GATES_THAT_CAN_BE_UNKNOWN)
       + " THEN 'UNKNOWN' ELSE 'PASS' END AS overall, array_to_string(list_filter(["
       + ", ".join(f"CASE WHEN {n} = 'FAIL' THEN '{n}' END" for n in V.GATE_ORDER)
       + "], lambda x: x IS NOT NULL), ',') AS failed FROM rolled)")


@query("gate_rollup", f"{BASE}{ALL} SELECT pos, overall, failed FROM overall")
def gate_rollup(spark, sf):
    return gated(spark, sf).select("pos", "gates.overall",
                                   F.array_join("gates.failed", ",").alias("failed"))


@query("gate_failures", f"""{BASE}{ALL} SELECT count_if(overall = 'FAIL') AS gate_failed,
 count_if(overall = 'UNKNOWN') AS gate_unknown, """ + ", ".join(
    f"count_if({n} = 'FAIL') AS gate_failed_{n}" for n in V.GATE_ORDER) + " FROM overall")
def gate_failures(spark, sf):
    return gate_failure_counts(gated(spark, sf))


@query("gate_display_tally", f"""{BASE}{ALL} SELECT pos, """ + ", ".join(
    "(" + " + ".join(f"({n} {test})::INT" for n in V.GATE_ORDER) + f")::INT AS {w}"
    for w, test in (("pass", "= 'PASS'"), ("fail", "= 'FAIL'"),
                    ("unverified", "NOT IN ('PASS', 'FAIL')"))) + " FROM overall")
def gate_display_tally(spark, sf):
    return display_tally(gated(spark, sf), "pos")


@query("display_tally_long", """SELECT o_custkey, count_if(o_orderstatus = 'P') AS pass,
 count_if(o_orderstatus = 'F') AS fail, count_if(o_orderstatus = 'O') AS unverified
 FROM orders GROUP BY o_custkey""")
def display_tally_by_group(spark, sf):
    o = table(spark, sf, "orders")
    verdict = F.when(F.col("o_orderstatus") == "P", "PASS").when(
        F.col("o_orderstatus") == "F", "fail").otherwise("other")
    return display_tally_long(o.select("o_custkey", verdict.alias("verdict")), "o_custkey")


@query("gate_reasons")
def gate_reasons(spark, sf):
    """Discard reasons with their quotes; wording has no SQL twin.

    The gates are stored first: a filter on them would be pushed into the text stages and repeat
    their work.
    """
    g = cut_lineage(gated(spark, sf).select("pos", "gates"))
    return g.filter("gates.overall = 'FAIL'").select(
        "pos", G.discard_reason(F.col("gates")).alias("reason"))


_LANG_RANK = ", ".join(f"('{lang}', {i})" for i, lang in enumerate(("native-speaker", *V.LANGUAGE_NAMES)))
_CORE_SQL = " ".join(f"WHEN contains(t, ' {m} ') THEN '{m}'" for m in VOCABULARY.core_tech)
REASONS = f"""{ALL}, lrank(lang, k) AS (VALUES {_LANG_RANK}),
 lfirst AS (SELECT pos, arg_min(lang, ord * 100 + k) AS lang FROM lall JOIN lrank USING (lang)
  WHERE NOT opt GROUP BY pos),
 yfirst AS (SELECT pos, max(years) AS years, arg_max(list_min(list_transform(regexp_extract_all(
   fig, '[0-9]{{1,2}}'), lambda x: x::INT)), years * 1000000 - ord * 100 - i) AS low
  FROM yk WHERE kind = 'hard' GROUP BY pos),
 reasons AS (SELECT v.pos, v.failed, 'hard gate — ' || array_to_string(list_filter([
  CASE WHEN v.language = 'FAIL' THEN 'language: ' || coalesce(
   lfirst.lang || ' stated as a hard job condition', 'posting is written in ' || det.lang) END,
  CASE WHEN v.experience = 'FAIL' THEN 'experience: ' || CASE WHEN y.low <> y.years THEN y.low || '-'
   || y.years || ' years stated as a hard requirement, read at its ceiling of ' || y.years
   ELSE y.years || '+ years stated as a hard requirement' END END,
  CASE WHEN v.sponsorship = 'FAIL' THEN 'sponsorship: ' || CASE WHEN s.bar = 'sponsorship_denied'
   THEN 'posting states sponsorship is not available' ELSE 'posting requires citizenship, a passport '
   || 'or pre-existing work rights this profile lacks' END END,
  CASE WHEN v.seniority = 'FAIL' THEN 'seniority: title advertises a grade above this level ('''
   || m.marker || ''')' END,
  CASE WHEN v.pure_technical = 'FAIL' THEN 'pure_technical: pure technical role - title matches '''
   || (CASE {_CORE_SQL} END) || '''' END,
  CASE WHEN v.closed = 'FAIL' THEN 'closed: the posting states it is closed' END,
  CASE WHEN v.geography = 'FAIL' THEN 'geography: ' || CASE WHEN g.suffix
   THEN 'the location is a US/Canadian state-or-province address' WHEN g.o IS NOT NULL
   THEN 'the posting places the role outside Europe (''' || g.o || ''')'
   ELSE 'the posting names the US state ''' || g.s || '''' END END,
  CASE WHEN v.recency = 'FAIL' THEN 'recency: posted ' || (DATE '{TODAY}' - p.date_posted::DATE)
   || ' days ago, past the 45-day freshness limit' END], lambda x: x IS NOT NULL), '; ') AS reason
  FROM overall v JOIN postings p USING (pos) JOIN det USING (pos) JOIN seniority m USING (pos)
  JOIN gm g USING (pos) JOIN sponsorship s USING (pos) JOIN ax USING (pos)
  LEFT JOIN lfirst USING (pos) LEFT JOIN yfirst y USING (pos) WHERE v.overall = 'FAIL')"""


@query("gate_reason_texts", f"{BASE}{REASONS} SELECT pos, reason FROM reasons")
def gate_reason_texts(spark, sf):
    """Discard reasons of all gates without the quoted evidence."""
    g = cut_lineage(gated(spark, sf).select("pos", "gates"))
    quiet = F.col("gates")
    for name in V.GATE_ORDER:
        quiet = quiet.withField(f"{name}.quote", F.lit(None).cast("string"))
    return g.filter("gates.overall = 'FAIL'").select("pos", quiet.alias("gates")).select(
        "pos", G.discard_reason(F.col("gates")).alias("reason"))


@query("evidence_source", f"""WITH {POSTINGS} SELECT pos, CASE WHEN cut
 THEN 'description_truncated' ELSE 'description' END AS evidence_source,
 length(description)::INT AS evidence_chars FROM postings""")
def evidence_source(spark, sf):
    return with_evidence(postings(spark, sf)).select(
        "pos", "evidence_source", F.length("body").alias("evidence_chars"))


_LEVEL = "(?:fluent|professional|business level|native|mother tongue)"
_OTHER = "|".join(G.RANK_LANGUAGES)


@query("gates_rank_time", f"""WITH {POSTINGS}, x AS (SELECT *, lower(title) AS t,
  lower(description) AS d, lower(location) AS l, {any_sql('location', G.RANK_COUNTRIES)} AS listed
  FROM postings)
SELECT pos, CASE WHEN regexp_matches(t, '\\b(?:senior|sr|snr|leader|principal|head|director|expert)\\b')
  OR (regexp_matches(t, '\\blead\\b') AND NOT regexp_matches(t, '\\blead\\s+(?:time|to|generation|gen|management|qualification|nurturing|scoring|conversion)\\b'))
  THEN 'FAIL' ELSE 'PASS' END AS seniority,
 CASE WHEN contains(location, 'Hungary') OR contains(location, 'Budapest') THEN
   CASE WHEN regexp_matches(d, '{_alt(G.CITIZEN_ONLY)}') OR regexp_matches(d, '{G.HOME_PASSPORT}')
     THEN 'FAIL' ELSE 'PASS' END
  WHEN (contains(l, 'remote') OR contains(l, 'worldwide')) AND (contains(l, 'eu')
    OR contains(l, 'worldwide') OR contains(l, 'global')) THEN 'PASS'
  WHEN listed THEN CASE WHEN regexp_matches(d, '{_alt(G.NO_SPONSOR)}') THEN 'FLAG'
    WHEN regexp_matches(d, '{_alt(G.CITIZEN_ONLY)}') THEN 'FAIL' ELSE 'FLAG' END
  WHEN NOT (contains(location, 'Europe') OR contains(location, 'EU')) THEN
    CASE WHEN contains(l, 'remote') AND NOT {any_sql('l', ('us', 'america', 'canada', 'australia', 'asia'))}
      THEN 'PASS' ELSE 'FAIL' END ELSE 'PASS' END AS eligibility,
 CASE WHEN regexp_matches(d, '\\b{_LEVEL}\\s+hungarian\\b|\\bhungarian\\s+(?:fluent|professional|business level|native|required|mandatory)\\b')
   OR regexp_matches(d, '\\b{_LEVEL}\\s+(?:{_OTHER})\\b|\\b(?:{_OTHER})\\s+(?:required|mandatory|must have|must speak|essential)\\b') THEN 'FAIL'
  WHEN contains(d, 'hungarian') AND regexp_matches(d, '{G.OPTIONAL_SHORT}') THEN 'PASS'
  WHEN regexp_matches(d, '{_alt(G.ENGLISH_HIGH)}') THEN 'FLAG' ELSE 'PASS' END AS language FROM x""")
def gates_rank_time(spark, sf):
    p = postings(spark, sf)
    return p.select(
        "pos", G.rank_seniority_gate(F.col("title")).alias("seniority"),
        G.rank_eligibility_gate(F.col("location"), F.col("description")).alias("eligibility"),
        G.rank_language_gate(F.col("description")).alias("language"))


# ---- facts: the clauses are the only wording the patterns can meet in the derived texts.
@query("salary_facts", f"""WITH {POSTINGS} SELECT pos, CASE
 WHEN contains(description, 'Salary €60,000 - €80,000 per year') THEN '€60,000 - €80,000 per year'
 WHEN contains(lower(description), 'competitive salary') THEN 'not disclosed' ELSE 'unknown' END
 AS salary FROM postings""")
def salary_facts(spark, sf):
    p = postings(spark, sf).withColumn("body", F.col("description"))
    return X.add_facts(p).select("pos", F.col("salary.value").alias("salary"))


@query("work_mode_facts", f"""WITH {POSTINGS} SELECT pos, CASE
 WHEN contains(description, 'hybrid role') THEN 'hybrid'
 WHEN contains(description, 'Competitive salary and remote work') THEN 'remote'
 WHEN contains(description, 'no remote work') AND NOT regexp_matches(right(regexp_replace(
   split_part(description, 'no remote work', 1), '\\s+', ' ', 'g'), 30),
   '(?i)\\b(?:no|not|non|without|never|isn''?t|aren''?t|cannot|can''?t)\\b') THEN 'onsite'
 ELSE 'unknown' END AS work_mode FROM postings""")
def work_mode_facts(spark, sf):
    p = postings(spark, sf).withColumn("body", F.col("description"))
    return X.add_facts(p).select("pos", F.col("work_mode.value").alias("work_mode"))


_ERRORS = ("403 user quota: $1.5, need quota: $2.25", "HTTP 401", "rate limit", "timed out",
           "permission denied", "billing", "unclassified", "boom", " ")


@query("error_facts", f"""WITH e AS (SELECT event_id, ({sql_list(_ERRORS)})[(event_id % 9)::INT + 1]
   || CASE WHEN event_id % 9 = 8 THEN '' ELSE ' at ' || event_id END AS t FROM events)
SELECT event_id, CASE event_id % 9 WHEN 0 THEN 1.5 END::DOUBLE AS have,
 CASE event_id % 9 WHEN 0 THEN 2.25 END::DOUBLE AS need, event_id % 9 = 0 AS quota_error,
 CASE WHEN trim(t) = '' THEN 'unknown' WHEN contains(lower(t), '401') THEN 'auth'
  WHEN contains(t, 'permission denied') THEN 'permission' WHEN contains(t, 'quota')
   OR contains(t, 'rate limit') OR contains(t, '429') THEN 'quota'
  WHEN contains(t, 'billing') THEN 'credit' WHEN contains(t, 'timed out') THEN 'timeout'
  WHEN contains(t, 'unclassified') THEN 'unknown' ELSE 'transient' END AS class FROM e""")
def error_facts(spark, sf):
    i = F.col("event_id")
    t = F.concat(F.get(F.array(*[F.lit(x) for x in _ERRORS]), (i % 9).cast("int")),
                 F.when(i % 9 == 8, "").otherwise(F.concat(F.lit(" at "), i)))
    e = table(spark, sf, "events").select("event_id", t.alias("t"))
    c = F.col("t")
    return e.select("event_id", X.quota_figures(c).alias("q"), X.is_quota_error(c)
                    .alias("quota_error"), X.error_class(c).alias("class")).select(
        "event_id", "q.have", "q.need", "quota_error", "class")
