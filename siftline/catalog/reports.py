"""Report aggregates over trackers, sheets and counts."""

from pyspark.sql import functions as F

from siftline.catalog.base import postings, query, table
from siftline.functions.keys import slug
from siftline.operators import reports as R
from siftline.operators import selection as SE
from siftline.operators import validation as VA
from siftline.sources.sheets import salary_long


@query("source_counts", "SELECT source AS portal, count(*) AS n FROM documents GROUP BY 1")
def source_counts(spark, sf):
    return R.source_counts(postings(spark, sf))


@query("source_warnings", """SELECT p_brand AS source, 0::BIGINT AS total, count(*) AS queries
FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1 HAVING max(p_size % 50) < 49""")
def source_warnings(spark, sf):
    p = table(spark, sf, "part")
    counts = p.select(F.col("p_brand").alias("source"), F.col("p_name").alias("query"),
                      F.when(F.col("p_size") % 50 == 49, 1).otherwise(0).alias("n"))
    skip = p.filter("p_brand = 'Brand#3'").select(F.col("p_brand").alias("source")).distinct()
    return R.source_warnings(counts, skip)


# ---- tracker: orders as applications
_STATUS = ("no response", "offer_declined", "offer declined", "rejected", "drafted", "interview",
           "hired", "ghosted")
_STATUS_SQL = ("([" + ", ".join(f"'{s}'" for s in _STATUS)
               + "])[(o_orderkey % 8)::INT + 1]")
_BUCKET_SQL = """CASE s WHEN 'hired' THEN 'Hired' WHEN 'offer_declined' THEN 'Offer declined'
 WHEN 'no_response' THEN 'No response' WHEN 'drafted' THEN 'Open' WHEN 'interview' THEN 'Open'
 ELSE 'Rejected/Closed' END"""
TRACKER = (f"tr AS (SELECT *, replace({_STATUS_SQL}, ' ', '_') AS s FROM orders),"
           f" tb AS (SELECT *, {_BUCKET_SQL} AS bucket FROM tr)")


def tracker(spark, sf):
    o = table(spark, sf, "orders")
    return o.withColumns({
        "status": F.get(F.array(*[F.lit(s) for s in _STATUS]),
                        (F.col("o_orderkey") % 8).cast("int")),
        "sector": F.col("o_orderpriority"), "channel": F.col("o_orderstatus")})


@query("tracker_status", f"""WITH {TRACKER} SELECT s AS status, bucket,
 s NOT IN ('hired', 'offer_declined', 'rejected', 'no_response') AS open, s = 'ghosted'
 AS unrecognised, count(*) AS n FROM tb GROUP BY 1, 2, 3, 4""")
def tracker_status(spark, sf):
    return R.status_counts(tracker(spark, sf))


@query("tracker_dashboard", f"""WITH {TRACKER} SELECT 'bucket' AS dimension, bucket AS value,
 count(*) AS n FROM tb GROUP BY 2 UNION ALL SELECT 'sector', o_orderpriority, count(*) FROM tb
 GROUP BY 2 UNION ALL SELECT 'channel', o_orderstatus, count(*) FROM tb GROUP BY 2""")
def tracker_dashboard(spark, sf):
    return R.tracker_dashboard(tracker(spark, sf))


@query("stage_funnel", f"""WITH {TRACKER} SELECT count_if(s IN ('drafted', 'interview', 'hired'))
 AS drafted, count_if(s IN ('interview', 'hired')) AS interview, count_if(s = 'hired') AS hired
 FROM tb""")
def stage_funnel(spark, sf):
    return R.stage_funnel(tracker(spark, sf), ("drafted", "interview", "hired"))


@query("stale_open", f"""WITH {TRACKER}, a AS (SELECT o_custkey,
  max(o_orderdate)::DATE AS last_date, max({{'d': o_orderdate::DATE, 's': {_STATUS_SQL}}}) AS m,
  count_if(o_orderkey % 9 = 0) AS followups FROM tb GROUP BY 1)
SELECT o_custkey, last_date, followups,
 (DATE '2001-08-10' - last_date)::INT AS quiet_days, DATE '2001-08-10' - last_date >= 30 AS alarm
FROM a WHERE DATE '2001-08-10' - last_date >= 10 AND followups < 2 AND replace(m.s, ' ', '_')
 NOT IN ('hired', 'offer_declined', 'rejected', 'no_response')""")
def stale_open(spark, sf):
    t = tracker(spark, sf).select("o_custkey", "status", F.to_date("o_orderdate").alias("date"),
                                  (F.col("o_orderkey") % 9 == 0).alias("followup"))
    return R.stale_applications(t, "2001-08-10", "o_custkey").select(
        "o_custkey", "last_date", "followups", "quiet_days", "alarm")


# ---- skill gaps: parts as tracked cases, line items as ranked ones
_GAPS = ("sql", "python", "german", "cloud")


@query("skill_gaps", """WITH tk AS (SELECT lower(p_brand) AS c, lower(p_name) AS r,
  (p_size * 2)::DOUBLE AS score, [(['sql', 'python', 'german', 'cloud'])[p_size % 4 + 1]] AS gaps,
  'tracked' AS source, p_size % 2 = 0 AS rec FROM part),
 rk AS (SELECT lower(p_brand) AS c, lower(p_type) AS r, (p_size + 40)::DOUBLE AS score,
  ['sql', (['sql', 'python', 'german', 'cloud'])[p_size % 4 + 1]] AS gaps, 'ranked' AS source,
  p_size % 3 = 0 AS rec FROM part),
 al AS (SELECT * FROM tk UNION ALL SELECT * FROM rk),
 one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c, r ORDER BY rec DESC,
  source DESC, score DESC, array_to_string(gaps, '|') DESC) AS rn FROM al) WHERE rn = 1),
 ex AS (SELECT unnest(list_distinct(gaps)) AS gap, score, source, rec FROM one WHERE score >= 45)
SELECT gap, round(sum((100 - score) / 100), 4) AS weight, count_if(source = 'tracked') AS tracked,
 count_if(source = 'ranked') AS ranked, count_if(rec) AS recorded_gaps, count_if(NOT rec)
 AS inferred FROM ex GROUP BY gap""")
def skill_gaps(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size")
    gap = F.get(F.array(*[F.lit(g) for g in _GAPS]), size % 4)
    tracked = p.select(F.upper("p_brand").alias("company"), F.col("p_name").alias("role"),
                       (size * 2).cast("double").alias("score"), F.array(gap).alias("gaps"),
                       (size % 2 == 0).alias("recorded"))
    ranked = p.select(F.col("p_brand").alias("company"), F.col("p_type").alias("role"),
                      (size + 40).cast("double").alias("score"),
                      F.array(F.lit("sql"), gap).alias("gaps"), (size % 3 == 0).alias("recorded"))
    return R.skill_gaps(tracked, ranked)


# ---- salary sheets
def sheet(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("P"), k).alias("Firma"), F.col("p_brand").alias("By"),
        k.alias("Personnummer"),
        F.when(k % 4 != 0, F.concat(F.col("p_size").cast("string"), F.lit(" "))).alias("IT antal"),
        F.when(k % 6 != 0, F.regexp_replace(F.format_string("%.1f", F.col("p_retailprice")),
                                            r"\.", ",")).alias("IT indeks"),
        F.col("p_size").cast("string").alias("Medarbejdere"), F.col("p_type").alias("Noter"))


@query("salary_long", """SELECT 'P' || p_partkey AS company, p_brand AS city, 'it' AS category,
 CASE WHEN p_partkey % 4 <> 0 THEN p_size::BIGINT END AS count,
 CASE WHEN p_partkey % 6 <> 0 THEN round(p_retailprice, 1) END AS "index" FROM part
 WHERE p_partkey % 4 <> 0 OR p_partkey % 6 <> 0
UNION ALL SELECT 'P' || p_partkey, p_brand, 'medarbejdere', p_size::BIGINT, NULL FROM part""")
def salary(spark, sf):
    return salary_long(sheet(spark, sf))


@query("salary_vs_baseline", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN ''
 ELSE (CASE WHEN p_retailprice >= 1000 THEN '+' ELSE '' END)
  || printf('%.1f', (p_retailprice - 1000) * 100 / 1000) || '%' END AS diff FROM part""")
def salary_vs_baseline(spark, sf):
    index = F.when(F.col("p_partkey") % 5 == 0, "n/a").otherwise(
        F.col("p_retailprice").cast("string"))
    return table(spark, sf, "part").select("p_partkey", R.against_baseline(index, 1000)
                                           .alias("diff"))


@query("salary_issues", """WITH t AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 50 = 7
  THEN ' ' ELSE upper(p_name) || ' ' || p_brand END AS company, p_partkey % 20 = 3 AS badc FROM part),
 f AS (SELECT lower(company) AS k, min(pos) AS first FROM t GROUP BY 1)
SELECT level, count(*) AS n FROM (SELECT 'error' AS level FROM t WHERE trim(company) = ''
 UNION ALL SELECT 'error' FROM t WHERE badc UNION ALL SELECT 'warning' FROM t JOIN f
 ON f.k = lower(t.company) WHERE pos <> first AND trim(company) <> '') GROUP BY level""")
def salary_issues(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    name = F.when(k % 50 == 7, " ").otherwise(F.concat(F.upper("p_name"), F.lit(" "), "p_brand"))
    cell = F.struct(F.when(k % 20 == 3, "many").otherwise("5").alias("count"),
                    F.lit("1.5").alias("index"))
    t = p.select(k.alias("pos"), name.alias("company"),
                 F.create_map(F.lit("it"), cell).alias("categories"))
    return R.salary_table_issues(t).groupBy("level").agg(F.count("*").alias("n"))


# ---- names, dates, rotation, display order
@query("unknown_names", """SELECT DISTINCT lower(p_name) AS n, replace(lower(p_name), ' ', '_')
 AS slug FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 40)""")
def unknown_names(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("name"), "p_size")
    out = VA.unknown_names(p.select(F.upper("name").alias("name")), p.filter("p_size > 40"))
    return out.select(F.replace(F.col("slug"), F.lit("_"), F.lit(" ")).alias("n"), "slug")


@query("matched_names", """SELECT n_name AS name FROM nation WHERE n_nationkey % 2 = 0""")
def matched_names(spark, sf):
    n = table(spark, sf, "nation")
    asked = n.filter("n_nationkey % 2 = 0").select(F.replace(F.lower("n_name"), F.lit("_"),
                                                             F.lit(" ")).alias("name"))
    return VA.matched_names(asked, n.select(F.col("n_name").alias("name")))


@query("repeated_names", """SELECT replace(lower(p_name), ' ', '_') AS name, count(*) AS n
FROM part GROUP BY 1 HAVING count(*) > 1""")
def repeated_names(spark, sf):
    return VA.repeated_names(table(spark, sf, "part").select(slug(F.col("p_name")).alias("name")))


@query("newest_dates", """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)
SELECT day, row_number() OVER (ORDER BY day DESC) <= 7 OR day = DATE '1997-05-28' AS kept FROM d""")
def newest_dates(spark, sf):
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    return SE.newest_dates(o, "day", 7, "1997-05-28")


@query("rotation_window", """WITH p AS (SELECT p_partkey, p_size = 1 AS fixed FROM part),
 n AS (SELECT count_if(fixed) AS f, count_if(NOT fixed) AS r FROM p),
 i AS (SELECT p_partkey, fixed, row_number() OVER (PARTITION BY fixed ORDER BY p_partkey) - 1
  AS idx FROM p)
SELECT p_partkey, CASE WHEN fixed THEN 'always' ELSE 'rotating' END AS part FROM i, n
WHERE (fixed AND idx < 65) OR (NOT fixed AND 65 - f > 0
 AND ((idx - (11 * (65 - f)) % r) + r) % r < 65 - f)""")
def rotation_window(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    return SE.rotating_cohort(p, ["p_partkey"], 11, 90, 25, F.col("p_size") == 1).select(
        "p_partkey", "part")


@query("display_order", """SELECT o_orderkey, (row_number() OVER (ORDER BY
 CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END DESC NULLS LAST, o_orderkey) - 1) AS idx
FROM orders""")
def display_order(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(
        F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("score"))
    return SE.display_index(o, pos="o_orderkey").select("o_orderkey", "idx")


@query("alert_counts_by_name", """WITH c AS (SELECT event_id, CASE WHEN event_type = 'error'
  THEN NULL ELSE event_type END AS nm, CASE WHEN event_type = 'view' OR event_id % 3 = 0 THEN NULL
  ELSE 'T' || event_id % 5 END AS tr FROM events)
SELECT coalesce(nm, '(unattributed)') AS alert_name, count(*) AS n,
 arg_min(tr, event_id) AS track, arg_min(tr, event_id) IS NULL AND nm IS NOT NULL AS unmapped
FROM c GROUP BY nm""")
def alert_counts_by_name(spark, sf):
    t, i = F.col("event_type"), F.col("event_id")
    c = table(spark, sf, "events").select(
        i.alias("pos"), F.when(t != "error", t).alias("alert_name"),
        F.when((t != "view") & (i % 3 != 0), F.concat(F.lit("T"), i % 5)).alias("alert_track"))
    return R.alert_counts_by_name(c)


@query("cut_profile", """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_quantity::INT AS score FROM lineitem),
 b AS (SELECT l_partkey, l_suppkey FROM c ORDER BY score DESC, l_orderkey, l_linenumber,
  l_partkey, l_suppkey LIMIT 1)
SELECT min(score) AS min, max(score) AS max, (list_sort(list(score)))[count(*) // 2 + 1] AS median,
 'p' || (SELECT l_partkey FROM b) AS best_title, 's' || (SELECT l_suppkey FROM b) AS best_company
FROM c""")
def cut_profile(spark, sf):
    c = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("int").alias("score"),
        F.concat(F.lit("p"), "l_partkey").alias("title"),
        F.concat(F.lit("s"), "l_suppkey").alias("company"))
    return R.cut_profile(c, order=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


@query("cut_profile_doubles", """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_extendedprice::DOUBLE * (1 + l_tax::DOUBLE) AS score FROM lineitem),
 r AS (SELECT *, row_number() OVER (ORDER BY score) - 1 AS rk, count(*) OVER () AS n FROM c)
SELECT min(score) AS min, max(score) AS max, max(score) FILTER (WHERE rk = n // 2) AS median,
 arg_min('o' || l_orderkey, (l_orderkey, l_linenumber, l_partkey, l_suppkey))
  FILTER (WHERE score = (SELECT max(score) FROM c)) AS best_title,
 arg_min('p' || l_partkey, (l_orderkey, l_linenumber, l_partkey, l_suppkey))
  FILTER (WHERE score = (SELECT max(score) FROM c)) AS best_company FROM r""")
def cut_profile_doubles(spark, sf):
    """Almost as many scores as rows, so the median is a selection by rank, not by histogram."""
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    c = table(spark, sf, "lineitem").select(
        *order, (F.col("l_extendedprice").cast("double") * (1 + F.col("l_tax").cast("double")))
        .alias("score"), F.concat(F.lit("o"), "l_orderkey").alias("title"),
        F.concat(F.lit("p"), "l_partkey").alias("company"))
    return R.cut_profile(c, order=order)


@query("raw_salary_issues", """WITH t AS (SELECT p_partkey AS k, p_partkey // 50 AS file,
  (row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey))::INT AS entry FROM part),
 ok AS (SELECT * FROM t WHERE file % 5 <> 2 AND file % 7 <> 3)
SELECT file, entry, 'error' AS level, 'must be an object' AS issue FROM ok WHERE k % 60 = 11
UNION ALL SELECT file, entry, 'error', 'company must be a non-empty string' FROM ok
 WHERE k % 60 <> 11 AND k % 50 = 7
UNION ALL SELECT file, entry, 'error', 'city must be a string when provided' FROM ok
 WHERE k % 60 <> 11 AND k % 40 = 9
UNION ALL SELECT file, entry, 'error', 'categories must be an object when provided' FROM ok
 WHERE k % 60 <> 11 AND k % 30 = 4
UNION ALL SELECT file, entry, 'error', 'it.count must be a number' FROM ok
 WHERE k % 60 <> 11 AND k % 30 <> 4 AND k % 20 = 3
UNION ALL SELECT file, entry, 'error', 'it.index must be a number or string' FROM ok
 WHERE k % 60 <> 11 AND k % 30 <> 4 AND k % 25 = 6
UNION ALL SELECT file, entry, 'error', 'hr must be an object with ''count'' and/or ''index'''
 FROM ok WHERE k % 60 <> 11 AND k % 30 <> 4 AND k % 35 = 8
UNION ALL SELECT file, entry, 'warning', 'Duplicate company name ''C' || k % 45 || '''' FROM (
 SELECT *, row_number() OVER (PARTITION BY file, k % 45 ORDER BY entry) AS rn FROM ok
 WHERE k % 60 <> 11 AND k % 50 <> 7) WHERE rn > 1
UNION ALL SELECT DISTINCT file, NULL, 'error', '''metadata'' must be an object when provided' FROM t
 WHERE file % 3 = 1 AND file % 7 <> 3
UNION ALL SELECT DISTINCT file, NULL, 'error', '''companies'' must be a list' FROM t
 WHERE file % 5 = 2 AND file % 7 <> 3
UNION ALL SELECT DISTINCT file, NULL, 'error', 'top-level JSON value must be an object' FROM t
 WHERE file % 7 = 3""")
def raw_salary_issues(spark, sf):
    """Tables of fifty entries, each rule broken by some of them."""
    k, f = F.col("p_partkey"), F.col("file")
    name = F.when(k % 50 == 7, '" "').otherwise(F.concat(F.lit('"C'), k % 45, F.lit('"')))
    count = F.when(k % 20 == 3, '"many"').when(k % 20 == 4, "true").otherwise("5")
    index = F.when(k % 25 == 6, "[1]").when(k % 25 == 7, '"102*"').otherwise("101.5")
    cells = F.concat(F.lit('{"it": {"count": '), count, F.lit(', "index": '), index, F.lit("}"),
                     F.when(k % 35 == 8, ', "hr": 7').otherwise(""), F.lit("}"))
    entry = F.when(k % 60 == 11, '"text"').otherwise(F.concat(
        F.lit('{"company": '), name, F.when(k % 40 == 9, ', "city": 5').otherwise(', "city": null'),
        F.lit(', "categories": '), F.when(k % 30 == 4, "[1]").otherwise(cells), F.lit("}")))
    rows = F.sort_array(F.collect_list(F.struct(k.alias("k"), entry.alias("e"))))
    files = table(spark, sf, "part").groupBy(F.floor(k / 50).alias("file")).agg(
        F.array_join(F.transform(rows, lambda x: x["e"]), ", ").alias("list"))
    value = F.when(f % 7 == 3, "[1, 2]").otherwise(F.concat(
        F.lit('{"metadata": '), F.when(f % 3 == 1, '"text"').otherwise("{}"),
        F.lit(', "companies": '), F.when(f % 5 == 2, "{}").otherwise(
            F.concat(F.lit("["), "list", F.lit("]"))), F.lit("}")))
    return R.raw_table_issues(files.select("file", value.alias("value")))


@query("unknown_mixed_names", """SELECT DISTINCT trim(regexp_replace(lower(p_type), '[^a-z0-9]+',
 '_', 'g'), '_') AS slug FROM part WHERE p_size % 3 = 0 AND p_type NOT IN (SELECT p_type FROM part
 WHERE p_size % 5 = 0 AND p_partkey % 97 = 0)
UNION SELECT 'no_such_name' FROM part""")
def unknown_mixed_names(spark, sf):
    """Requests of which some are known and some are not."""
    p = table(spark, sf, "part")
    asked = p.filter("p_size % 3 = 0").select(F.upper("p_type").alias("name")).unionByName(
        p.select(F.lit(" No such  name! ").alias("name")))
    known = p.filter("p_size % 5 = 0 AND p_partkey % 97 = 0").select(F.col("p_type").alias("name"))
    return VA.unknown_names(asked, known)
