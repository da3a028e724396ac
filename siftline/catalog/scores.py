"""Match scores, rule-based scores, company matches."""

from pyspark.sql import functions as F

from siftline.catalog.base import (POSTINGS, TITLES, TRACKS, VOCABULARY, any_sql, axis_ctes,
                                   postings, query, table, words_sql)
from siftline.functions import fixed_values as V
from siftline.functions import scores as S
from siftline.functions.text import words
from siftline.operators import reports as R
from siftline.operators import vocabulary as VO
from siftline.operators.axes import overlap_share, score_axes
from siftline.operators.fuzzy import company_matches


def scored(spark, sf):
    return score_axes(postings(spark, sf).withColumn("body", F.col("description")), VOCABULARY)


@query("axis_score", f"""WITH {POSTINGS}, {axis_ctes()}
SELECT pos, score, (dt + db) AS n_domains, (et + eb) AS n_enablers, pairs, tier, pen FROM ax""")
def axis_score(spark, sf):
    a = F.col("axes")
    return scored(spark, sf).select(
        "pos", a["score"].alias("score"), F.size(a["domain_matched"]).alias("n_domains"),
        F.size(a["enabler_matched"]).alias("n_enablers"), a["overlap_pairs"].alias("pairs"),
        a["hybrid_tier"].alias("tier"), a["core_tech_penalty"].alias("pen"))


@query("overlap_share", f"""WITH {POSTINGS}, {axis_ctes()}
SELECT sum(35 * pairs)::BIGINT AS overlap_bonus_points,
 round(100.0 * sum(35 * pairs) / sum(greatest(0, score)), 1) AS overlap_bonus_share_pct FROM ax""")
def overlap(spark, sf):
    return overlap_share(scored(spark, sf))


@query("missing_half", f"""WITH {POSTINGS}, {axis_ctes()} SELECT pos,
 CASE WHEN dt + db > 0 AND et + eb = 0 THEN 'enabler' WHEN et + eb > 0 AND dt + db = 0
 THEN 'domain' ELSE '' END AS half FROM ax""")
def missing_half(spark, sf):
    a = F.col("axes")
    return scored(spark, sf).select("pos", S.missing_half(a["domain_matched"],
                                                          a["enabler_matched"]).alias("half"))


def _match_sql(col, queries):
    phrases, tokens = S._terms(queries)
    return " + ".join([f"10 * contains({col}, ' {p} ')::INT" for p in phrases]
                      + [f"contains({col}, ' {t} ')::INT" for t in tokens])


def _longest_sql(col, queries):
    phrases, tokens = S._terms(queries)
    return "greatest(0, " + ", ".join(f"{len(t)} * contains({col}, ' {t} ')::INT"
                                      for t in sorted({*phrases, *tokens})) + ")"


_ALL_QUERIES = [q for qs in TRACKS.values() for q in qs]
_BEST = " UNION ALL ".join(
    f"SELECT pos, '{t}' AS track, {_match_sql('w', q)} AS hits, {_longest_sql('w', q)} AS spec "
    "FROM wt" for t, q in TRACKS.items())
TRACKED = f"""wt AS (SELECT pos, {words_sql('title')} AS w, {words_sql('description')} AS wb
  FROM postings), th AS ({_BEST}),
 best AS (SELECT pos, track, hits FROM (SELECT *, row_number() OVER (PARTITION BY pos
   ORDER BY hits DESC, spec DESC, track) AS rn FROM th WHERE hits > 0) WHERE rn = 1)"""


@query("query_match", f"""WITH {POSTINGS}, {TRACKED} SELECT wt.pos,
 ({_match_sql('w', _ALL_QUERIES)})::INT AS title_hits,
 (({_match_sql('w', _ALL_QUERIES)}) * 10
   + least({_match_sql('wb', _ALL_QUERIES)}, 20))::INT AS score,
 ({_longest_sql('w', _ALL_QUERIES)})::INT AS specificity FROM wt""")
def query_match(spark, sf):
    p = postings(spark, sf).select("pos", words(F.col("title")).alias("w"),
                                   words(F.col("description")).alias("wb"))
    title = S.query_match_score(F.col("w"), _ALL_QUERIES)
    return p.select("pos", title.alias("title_hits"), S.legacy_score(
        title, S.query_match_score(F.col("wb"), _ALL_QUERIES)).alias("score"),
        S.match_specificity(F.col("w"), _ALL_QUERIES).alias("specificity"))


@query("track_attribution", f"""WITH {POSTINGS}, {TRACKED}
SELECT wt.pos, track, coalesce(hits, 0)::INT AS hits FROM wt LEFT JOIN best USING (pos)""")
def track_attribution(spark, sf):
    p = postings(spark, sf).select("pos", words(F.col("title")).alias("w"))
    return p.select("pos", S.attribute_track(F.col("w"), TRACKS).alias("t")).select("pos", "t.*")


@query("track_attribution_table", f"""WITH {POSTINGS}, {TRACKED}
SELECT pos, track, hits::BIGINT AS hits FROM best""")
def track_attribution_table(spark, sf):
    """The same attribution with the vocabulary as a table that meets title word groups."""
    terms = F.explode(F.array(*[F.struct(F.lit(t).alias("track"), F.lit(q).alias("query"))
                                for t, qs in TRACKS.items() for q in qs])).alias("v")
    vocab = table(spark, sf, "region").select(terms).select("v.*").distinct()
    p = postings(spark, sf).select("pos", "title")
    return VO.best_track(VO.match_vocabulary_table(p, vocab, "pos"), "pos")


@query("widening_terms", """WITH own AS (SELECT DISTINCT lower(p_type) AS q FROM part
  WHERE p_size % 3 = 0 AND p_partkey % 97 = 0), oth AS (SELECT p_brand, upper(p_type) AS q FROM part
  WHERE p_size % 3 <> 0 UNION ALL SELECT p_brand, 'Only ' || p_brand FROM part)
SELECT lower(q) AS folded, min(q) AS query FROM oth
WHERE lower(q) NOT IN (SELECT q FROM own) GROUP BY 1""")
def widening_terms(spark, sf):
    """Terms of other sources of which some are covered by a track and some are not."""
    p, k = table(spark, sf, "part"), F.col("p_size")
    own = p.select(F.col("p_brand").alias("track"), ((k % 3 == 0) & (F.col("p_partkey") % 97 == 0))
                   .alias("enabled"), F.col("p_type").alias("query"))
    other = p.select(F.col("p_brand").alias("source"), (k % 3 != 0).alias("enabled"),
                     F.upper("p_type").alias("query")).unionByName(p.select(
        F.col("p_brand").alias("source"), F.lit(True).alias("enabled"),
        F.concat(F.lit(" Only "), "p_brand").alias("query")))
    return VO.split_vocabulary(own, other)[1].select("folded", "query")


@query("split_vocabulary", """WITH own AS (SELECT DISTINCT p_brand AS track, p_name AS query
  FROM part WHERE p_size % 3 = 0), oth AS (SELECT DISTINCT upper(p_name) AS query FROM part
  WHERE p_size % 3 <> 0)
SELECT lower(query) AS folded, query FROM oth WHERE lower(query) NOT IN (SELECT query FROM own)
 AND query <> 'X'""")
def split_vocabulary(spark, sf):
    p = table(spark, sf, "part")
    own = p.select(F.col("p_brand").alias("track"), (F.col("p_size") % 3 == 0).alias("enabled"),
                   F.col("p_name").alias("query"))
    other = p.select(F.col("p_type").alias("source"), (F.col("p_size") % 3 != 0).alias("enabled"),
                     F.upper("p_name").alias("query"))
    return VO.split_vocabulary(own, other)[1].select("folded", "query")


# ---- rule-based scores over postings
_STRONG = any_sql("c", V.STRONG_SKILLS)
_MODERATE = any_sql("c", V.MODERATE_SKILLS)


def _sum_sql(col, terms, points):
    return " + ".join(f"{points} * contains({col}, '{t}')::INT" for t in terms)


def _career_sql():
    def hit(terms):
        return "(" + any_sql("t", terms) + " OR " + any_sql("d", terms) + ")"

    marks = ", ".join(f"CASE WHEN {hit(k)} THEN '{t}' END" for t, k in V.CAREER_TRACKS.items())
    return (f"list_filter([{marks}], lambda x: x IS NOT NULL) AS tr, "
            f"{hit(V.CAREER_ADJACENT)} AS adjacent")


_EXP = " ".join(f"WHEN regexp_matches(d, '{p}') THEN {s}" for p, s in V.EXPERIENCE_RULES)
RULES = f"""x AS (SELECT pos, lower(title) AS t, lower(description) AS d FROM postings),
 cl AS (SELECT pos, d, t, regexp_extract_all(d, '{V.REQUIRED_CLAUSE}') AS cls, {_career_sql()}
   FROM x),
 tech AS (SELECT *, list_sum(list_transform(cls, lambda c: CASE WHEN {_STRONG} THEN 1.0
   WHEN {_MODERATE} THEN 0.5 ELSE 0.0 END)) AS earned,
   {_sum_sql('d', V.STRONG_SKILLS, 1)} AS ns, {_sum_sql('d', V.MODERATE_SKILLS, 1)} AS nm FROM cl),
 ruled AS (SELECT pos, CASE WHEN len(cls) = 0 THEN least(100, floor(15 * (ns + 0.5 * nm)))
   ELSE least(100, floor(100.0 * earned::DOUBLE / len(cls))) END::INT AS technical,
   CASE {_EXP} ELSE 85 END AS experience,
   greatest(0, least(100, 70 + {_sum_sql('d', V.BEHAVIORAL_POSITIVE, 5)}
     - ({_sum_sql('d', V.BEHAVIORAL_NEGATIVE, 10)}))) AS behavioral,
   CASE WHEN len(tr) >= 2 THEN 100 WHEN len(tr) = 1 THEN 95 WHEN adjacent THEN 50 ELSE 30 END
     AS career, CASE WHEN len(tr) = 0 THEN 'none' ELSE array_to_string(tr, '+') END AS track, d
   FROM tech)"""


def ruled(spark, sf):
    p = postings(spark, sf)
    d = F.col("description")
    p = p.select("pos", "description", S.technical_score(d).alias("technical"),
                 S.experience_score(d).alias("experience"),
                 S.behavioral_score(d).alias("behavioral"),
                 S.career_score(F.col("title"), d).alias("c"))
    return p.select("pos", "description", "technical", "experience", "behavioral",
                    F.col("c.score").alias("career"), "c.track")


@query("rule_scores", f"""WITH {POSTINGS}, {RULES}
SELECT pos, technical, experience, behavioral, career, track FROM ruled""")
def rule_scores(spark, sf):
    return ruled(spark, sf).drop("description")


_SAID = ", ".join(f"CASE WHEN contains(d, '{k}') THEN '{k.title()} mentioned in posting' END"
                  for k in V.STRENGTH_KEYWORDS)


@query("strengths_and_gaps", f"""WITH {POSTINGS}, {RULES}
SELECT pos, array_to_string(list_filter([{_SAID},
 CASE WHEN experience >= 85 THEN 'Experience requirements within profile range' END,
 CASE WHEN career >= 90 THEN 'Strong career alignment with track ' || track END],
 lambda x: x IS NOT NULL)[1:3], '; ') AS strengths,
 array_to_string(list_filter([CASE WHEN technical < 60 THEN 'Technical skills gap' END,
 CASE WHEN experience < 55 THEN 'Experience gap' END], lambda x: x IS NOT NULL), '; ') AS gaps
FROM ruled""")
def strengths_and_gaps(spark, sf):
    r = ruled(spark, sf)
    none = F.lit(None).cast("array<string>")
    return r.select(
        "pos", F.array_join(S.strengths(F.col("description"), F.col("experience"),
                                        F.col("career"), F.col("track")), "; ")
        .alias("strengths"),
        F.array_join(S.gaps(F.col("technical"), F.col("experience"), none, F.lit("PASS")), "; ")
        .alias("gaps"))


FOUR = """four AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS a,
  l_discount * 1000 % 101 AS b, l_tax * 1000 AS c, l_extendedprice % 101 AS d FROM lineitem)"""


@query("overall_bands", f"""WITH {FOUR}, r AS (SELECT a::DOUBLE * 0.30::DOUBLE
  + b::DOUBLE * 0.25::DOUBLE + c::DOUBLE * 0.15::DOUBLE + d::DOUBLE * 0.30::DOUBLE AS x FROM four),
 p AS (SELECT floor(x)::BIGINT AS whole,
  ((x - floor(x)) * 4503599627370496::DOUBLE)::HUGEINT * 10 AS part FROM r),
 t AS (SELECT whole, part // 4503599627370496 AS digit, part % 4503599627370496 AS rest FROM p),
 s AS (SELECT (whole * 10 + digit + (rest > 2251799813685248
   OR (rest = 2251799813685248 AND digit % 2 = 1))::INT)::DOUBLE / 10 AS score FROM t)
SELECT CASE WHEN score >= 75 THEN 'Strong Fit' WHEN score >= 60 THEN 'Good Fit'
 WHEN score >= 45 THEN 'Moderate Fit' WHEN score >= 30 THEN 'Weak Fit' ELSE 'Poor Fit' END AS band,
 count(*) AS n, round(avg(score), 1) AS mean FROM s GROUP BY 1""")
def overall_bands(spark, sf):
    line = table(spark, sf, "lineitem")
    s = S.overall_score(F.col("l_quantity") * 2, F.col("l_discount") * 1000 % 101,
                        F.col("l_tax") * 1000, F.col("l_extendedprice") % 101)
    return (line.select(s.alias("score")).withColumn("band", S.band(F.col("score")))
            .groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("score"), 1)
                                 .alias("mean")))


# ---- calibration: titles from the list, years and labels from the part table
ANCHORS = {"T1": ("ai ", "machine learning"), "T2": ("data", "bi developer"),
           "T4": ("supply chain", "procurement", "operations"), "T5": ("process", "performance")}
_LABELS = ("mid", "junior", "senior", "lead", "other")


def _titles_sql():
    return "[" + ", ".join(f"'{t}'" for t in TITLES) + "]"


def _old_career(t):
    return (f"CASE WHEN {any_sql(t, ('ai ', 'ai/', 'artificial intelligence', 'machine learning', 'ml ', 'data scien', 'data analy', 'analytics'))} THEN 100 "
            f"WHEN {any_sql(t, ('software engineer', 'developer'))} THEN 50 ELSE 0 END")


_NEW = ", ".join(f"CASE WHEN {any_sql('t', a)} THEN '{k}' END" for k, a in ANCHORS.items())


@query("calibration", f"""WITH r AS (SELECT lower(({_titles_sql()})[(p_partkey % 16)::INT + 1]) AS t,
  p_size % 9 AS years, (['mid', 'junior', 'senior', 'lead', 'other'])[p_size % 5 + 1] AS label,
  p_size * 2 AS technical, 70 AS behavioral, p_size % 10 = 0 AS mgr FROM part),
 s AS (SELECT *, {_old_career('t')} AS oc, CASE label WHEN 'senior' THEN 80 WHEN 'lead' THEN 60
   ELSE 100 END AS oe, list_filter([{_NEW}], lambda x: x IS NOT NULL) AS tr, CASE WHEN mgr THEN 30
   WHEN years <= 2 THEN 100 WHEN years <= 4 THEN 85 WHEN years <= 6 THEN 55 ELSE 25 END AS ne
   FROM r),
 d AS (SELECT CASE WHEN len(tr) = 0 THEN 'none' ELSE array_to_string(tr, '+') END
   AS matched_track, (technical * 0.30 + ne * 0.25 + behavioral * 0.15 + 0.30 * CASE
   WHEN len(tr) >= 2 THEN 100 WHEN len(tr) = 1 THEN 95 WHEN {any_sql('t', ('software engineer', 'devops', 'data engineer'))}
   THEN 50 ELSE 10 END)::DOUBLE - (technical * 0.35 + oe * 0.30 + oc * 0.35)::DOUBLE AS delta
   FROM s)
SELECT matched_track, count(*) AS n, round(avg(delta), 4) AS mean_delta,
 round(min(delta), 4) AS min_delta, round(max(delta), 4) AS max_delta FROM d GROUP BY 1""")
def calibration(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size")
    rows = p.select(
        F.get(F.array(*[F.lit(t) for t in TITLES]), (F.col("p_partkey") % 16).cast("int"))
        .alias("title"), (size % 9).alias("asks_years"),
        F.get(F.array(*[F.lit(x) for x in _LABELS]), size % 5).alias("label"),
        (size * 2).alias("technical"), F.lit(70).alias("behavioral"),
        (size % 10 == 0).alias("manages_people"))
    return R.calibration_by_track(R.calibration(rows, ANCHORS))


# ---- company names: every pair scored in SQL, candidates joined in Spark
_NAMES = """nm AS (SELECT s_name AS name, 'q' AS side FROM supplier UNION SELECT n_name, 'q'
  FROM nation UNION SELECT c_name, 'c' FROM customer UNION SELECT n_name, 'c' FROM nation),
 f AS (SELECT name, side, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k,
   list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'),
     lambda x: length(x) > 1)) AS w FROM nm),
 pr AS (SELECT q.name AS query, c.name AS company, q.k AS qk, c.k AS ck, q.w AS qw, c.w AS cw,
   len(list_intersect(q.w, c.w)) AS shared, length(q.k) AS ql, length(c.k) AS cl
   FROM f q, f c WHERE q.side = 'q' AND c.side = 'c'),
 sc AS (SELECT query, company, CASE WHEN qk = ck THEN 100
   WHEN contains(ck, qk) AND (NOT (ql <= 4 AND ql / cl < 0.5) OR shared > 0)
     THEN 80 + floor(ql / cl * 10)::INT
   WHEN contains(qk, ck) AND NOT (cl <= 4 AND cl / ql < 0.5) THEN 80 + floor(cl / ql * 10)::INT
   WHEN shared = 0 THEN 0 WHEN len(qw) = 1 THEN 70
   ELSE floor(30 + shared / len(qw) * 40)::INT END AS score FROM pr)"""


@query("company_match", f"""WITH {_NAMES} SELECT query, company, score FROM sc WHERE score >= 30""")
def company_match(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("n"))
    q = table(spark, sf, "supplier").select(F.col("s_name").alias("n")).union(nations)
    c = table(spark, sf, "customer").select(F.col("c_name").alias("n")).union(nations)
    return company_matches(q, c, "n", "n")
