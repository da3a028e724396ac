"""Broken portal files, detail cut at a blank, negators at the edge of their window, tasks of a size."""

from pyspark.sql import functions as F

from siftline.functions.facts import add_facts
from siftline.operators.details import merge_detail
from siftline.operators.skew import grid_join
from siftline.session import spread
from siftline.sources import portals as P


def test_broken_files_are_counted(spark, tmp_path):
    """The reader must not leave a file at its results, before the broken end."""
    for name, text in (("good", '{"meta": {}, "results": [{"title": "a"}]}'),
                       ("cut", '{"meta": {}, "results": [{"title": "a"}]'),
                       ("none", '{"meta": {}}'), ("noise", "no json")):
        (tmp_path / f"{name}.json").write_text(text)
    files = P.read_envelopes(spark, str(tmp_path))
    got = [r.path.rsplit("/", 1)[1] for r in P.envelope_warnings(files).collect()]
    assert sorted(got) == ["cut.json", "noise.json"]
    assert P.envelope_warnings(files).agg(F.count("*")).first()[0] == 2


def test_detail_cut_at_a_blank(spark):
    """The blank before the cut goes from the text, not from the count of what was taken."""
    long = "x" * 19999 + " " + "y" * 50
    records = spark.createDataFrame(
        [("url:linkedin:1000001", "", ""), ("url:linkedin:1000002", "", "")],
        "dedup_key string, url string, description_snippet string")
    details = spark.createDataFrame(
        [("url:linkedin:1000001", False, long), ("url:linkedin:1000002", False, " ab ")],
        "dedup_key string, failed boolean, description string")
    a, b = merge_detail(records, details).orderBy("dedup_key").collect()
    assert a.description == "x" * 19999 + "…" and a.taken_chars == 20001
    assert b.description == "ab" and b.taken_chars == 2


def test_negators_are_read_in_the_window_as_cut(spark):
    """The window is cut by characters first, as in the reference; what it cuts in half counts."""
    rows = [("xx onharent. Competitive salary and remote work.", "unknown"),
            ("xx onharenx. Competitive salary and remote work.", "remote"),
            ("xx arent so. Competitive salary and remote work.", "remote")]
    df = spark.createDataFrame([(i, "", t, "") for i, (t, _) in enumerate(rows)],
                               "id int, title string, body string, location string")
    got = [r.work_mode.value for r in add_facts(df).orderBy("id").collect()]
    assert got == [w for _, w in rows]


def test_tasks_keep_their_size_when_the_input_grows(spark, tmp_path):
    """One row group is one task's to read; above any bound its rows must still be dealt out."""
    path = str(tmp_path / "one.parquet")
    spark.range(20000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(
        1).write.parquet(path)
    df = spark.read.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "one.parquet").glob("*.parquet"))
    out = spread(df, size // 50)
    rows = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) >= 50 and max(rows) <= 2 * 20000 / 50


def test_a_hot_key_without_partner_leaves_before_the_join(spark):
    """Rows of a key that the other side lacks must not all be sent to one cell."""
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k string, l int")
    right = spark.range(300).select(
        F.when(F.col("id") < 3, "a").otherwise("lonely").alias("k"), F.col("id").alias("r"))
    out = grid_join(left, right, "k", ["l"], ["r"], block=10)
    assert sorted(r.r for r in out.collect()) == [0, 1, 2]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" in plan  # the counts that tell lonely keys


def test_roles_are_dealt_over_tasks(spark):
    """One row group of parts is one task's to read; the signatures must not stay in it."""
    from siftline.catalog.keys import _roles

    roles = _roles(spark, "/root/testdata/sf0.01")
    assert roles.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
