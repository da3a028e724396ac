"""Ingest and sinks by way of files that Spark writes once from the given tables."""

import uuid

from pyspark.sql import functions as F

from siftline.catalog.base import query, table
from siftline.operators.validation import drop_malformed
from siftline.session import checkpoint_dir
from siftline.sources import portals as P
from siftline.sources import stores as S
from siftline.sources.replies import recovered_report

_SOURCES = ("linkedin-alert", "linkedin", "freehire", "arbeitnow", "weworkremotely")
_NAMES = ("linkedin-alert", "linkedin-search", "freehire-search", "arbeitnow-search",
          "weworkremotely-search")
_PORTAL = "([" + ", ".join(f"'{n}'" for n in _NAMES) + "])[(p_partkey % 5)::INT + 1]"


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _envelopes(spark, sf):
    """Portal files: at most 500 rows each, every 13th row no object, one file in ten unreadable."""
    i = F.col("p_partkey")
    row = F.when(i % 13 == 0, F.lit('"no object"')).otherwise(F.to_json(F.struct(
        F.col("p_name").alias("title"), F.col("p_brand").alias("company"),
        F.concat(F.lit("https://jobs.example.com/"), i).alias("url"))))
    p = table(spark, sf, "part").select(
        F.get(F.array(*[F.lit(s) for s in _SOURCES]), (i % 5).cast("int")).alias("src"),
        F.floor(i / 500).alias("part"), F.struct(i.alias("i"), row.alias("row")).alias("r"))
    body = F.concat(F.lit('{"meta": {}, "results": ['), F.array_join(
        F.sort_array(F.collect_list("r"))["row"], ", "),
        F.when(F.col("part") % 10 == 9, F.lit("]")).otherwise(F.lit("]}")))
    files = p.groupBy("src", "part").agg(body.alias("value"))
    root = _folder(spark, "portals")
    # The text writer starts a file for each (src, part).
    files.write.partitionBy("src", "part").text(root)
    return P.read_envelopes(spark, root)


_PARTS = f"""pt AS (SELECT p_partkey, p_name, p_brand, {_PORTAL} AS portal FROM part
 WHERE (p_partkey // 500) % 10 <> 9)"""


@query("portal_ingest", f"""WITH {_PARTS} SELECT portal, CASE WHEN p_partkey % 13 <> 0 THEN p_name
 END AS title, CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS company, CASE WHEN p_partkey % 13
 <> 0 THEN 'https://jobs.example.com/' || p_partkey END AS url, p_partkey % 13 <> 0 AS is_object
FROM pt WHERE portal <> 'arbeitnow-search'""")
def portal_ingest(spark, sf):
    rows = P.portal_rows(_envelopes(spark, sf))
    alerts = rows.filter(F.col("portal") == "linkedin-alert")
    others = rows.filter(F.col("portal") != "linkedin-alert")
    skip = spark.createDataFrame([("arbeitnow-search",)], "portal string")
    return P.skip_sources(P.unite(alerts, others), skip).select(
        "portal", "title", "company", "url", "is_object")


@query("portal_malformed", f"""WITH {_PARTS} SELECT portal, count_if(p_partkey % 13 = 0) AS malformed
FROM pt GROUP BY portal""")
def portal_malformed(spark, sf):
    return P.malformed_rows(P.portal_rows(_envelopes(spark, sf)))


@query("unreadable_files", """SELECT count(DISTINCT (p_partkey % 5, p_partkey // 500))
 AS unreadable FROM part WHERE (p_partkey // 500) % 10 = 9""")
def unreadable_files(spark, sf):
    return P.envelope_warnings(_envelopes(spark, sf)).agg(F.count("*").alias("unreadable"))


@query("tracker_round_trip", """SELECT '2024-02-05' AS date, p_brand AS company, p_name AS role,
 'select' AS channel, 'drafted' AS status, p_size::VARCHAR AS fit_rating,
 p_partkey || ', "cv".pdf' AS cv_file, NULL AS notes FROM part""")
def tracker_round_trip(spark, sf):
    p = table(spark, sf, "part")
    outcomes = p.select(F.col("p_brand").alias("company"), F.col("p_name").alias("title"),
                        F.col("p_size").alias("score"), F.lit("").alias("cover_letter_file"),
                        F.concat("p_partkey", F.lit(', "cv".pdf')).alias("cv_file"),
                        F.lit("u").alias("url"))
    root = _folder(spark, "tracker")
    half = F.col("score") % 2 == 0
    for part in (outcomes.filter(half), outcomes.filter(~half)):
        S.append_tracker(S.tracker_rows(part, "2024-02-05"), root)
    return S.read_tracker(spark, root).select("date", "company", "role", "channel", "status",
                                              "fit_rating", "cv_file", "notes")


@query("output_sinks", """SELECT p_brand, count(*) AS n, 'corpus' AS sink FROM part GROUP BY p_brand
UNION ALL SELECT p_brand, count(*), 'deferred' FROM part WHERE p_size % 2 = 0 GROUP BY p_brand""")
def output_sinks(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    root = _folder(spark, "outputs")
    S.write_outputs(root, corpus=p, deferred=p.filter("p_size % 2 = 0"))
    S.write_output(p, f"{root}/corpus", ("p_brand",))
    back = [spark.read.parquet(f"{root}/{name}").groupBy("p_brand").agg(F.count("*").alias("n"))
            .withColumn("sink", F.lit(name)) for name in ("corpus", "deferred")]
    return P.unite(*back)


@query("store_round_trip", """SELECT 'k' || c_custkey AS key, c_name AS title, c_custkey % 7 = 0
 AS is_null FROM customer""")
def store_round_trip(spark, sf):
    """A keyed store in many files of one object each; entries that are no objects stay."""
    i = F.col("c_custkey")
    c = table(spark, sf, "customer").select(F.floor(i / 200).alias("file"), F.struct(
        F.concat(F.lit("k"), i).alias("key"), F.when(i % 7 == 0, F.lit("null")).otherwise(
            F.to_json(F.struct(F.col("c_name").alias("title"), F.lit("T").alias("track"))))
        .alias("raw")).alias("e"))
    body = F.concat(F.lit("{"), F.array_join(F.transform(F.collect_list("e"), lambda e: F.concat(
        F.lit('"'), e["key"], F.lit('": '), e["raw"])), ", "), F.lit("}"))
    root = _folder(spark, "store")
    c.groupBy("file").agg(body.alias("value")).write.partitionBy("file").text(root)
    names = table(spark, sf, "customer").select(F.concat(F.lit("k"), i).alias("key"), "c_name")
    entries = S.read_store(spark, root, S.ALERT_ENTRY).select("key", "track", "title")
    return entries.join(names, "key").select(
        "key", F.coalesce("title", "c_name").alias("title"), F.col("track").isNull().alias("is_null"))


@query("store_by_lines", """SELECT 'k' || c_custkey AS key, CASE WHEN c_custkey % 7 <> 0
 THEN c_name END AS title FROM customer""")
def store_by_lines(spark, sf):
    """Stores with their entries on lines of their own, read by as many tasks as there are splits."""
    i = F.col("c_custkey")
    line = F.concat(F.lit('  "k'), i, F.lit('": '), F.when(i % 7 == 0, F.lit('"none"')).otherwise(
        F.concat(F.lit('{\n    "title": "'), "c_name", F.lit('",\n    "track": "T"\n  }'))))
    body = F.concat(F.lit("{\n"), F.array_join(F.collect_list(line), ",\n"), F.lit("\n}"))
    root = _folder(spark, "lines")
    (table(spark, sf, "customer").groupBy(F.floor(i / 200)).agg(body.alias("value"))
     .select("value").write.text(root))
    return S.read_big_store(spark, root, S.ALERT_ENTRY).select("key", "title")


@query("recovered_reports", """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '{"ok": [' || conv_id
 || ']}' WHEN 1 THEN '[' || conv_id || ', 2]' WHEN 2 THEN '[{"a": 1}]' END AS report
FROM conversations""")
def recovered_reports(spark, sf):
    c, t = table(spark, sf, "conversations"), F.col("turn")
    clean = F.regexp_replace("text", r"[\\[\\]{}`\"]", " ")
    reply = (F.when(t % 4 == 0, F.concat(F.lit(' {"ok": ['), "conv_id", F.lit("]} ")))
             .when(t % 4 == 1, F.concat(clean, F.lit("\n```json\n["), "conv_id", F.lit(", 2]\n```\n"),
                                        clean))
             .when(t % 4 == 2, F.concat(clean, F.lit(' [{"a": 1}] '), clean)).otherwise(
                 F.concat(clean, F.lit(" {broken"))))
    return c.select("conv_id", "turn", recovered_report(reply).alias("report"))


@query("usable_lines", """SELECT event_id FROM events WHERE event_id % 5 <> 0""")
def usable_lines(spark, sf):
    """JSON lines, one in five broken; the broken ones are set aside by the reader."""
    i = F.col("event_id")
    line = F.when(i % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(i)))
    root = _folder(spark, "lines")
    table(spark, sf, "events").select(line.alias("value")).write.text(root)
    raw = spark.read.schema("event_id LONG, _corrupt_record STRING").json(root)
    return drop_malformed(raw.select("event_id", "_corrupt_record")).select("event_id")
