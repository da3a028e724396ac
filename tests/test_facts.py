from pyspark.sql import functions as F

from siftline.functions import facts
from siftline.functions.facts import add_facts

PAY = [
    ("We pay €60,000 - €80,000 per year plus bonus", "€60,000 - €80,000 per year"),
    ("60 000 - 80 000 EUR", "60 000 - 80 000 EUR"),
    ("3.131 EUR per month", "3.131 EUR per month"),
    ("a voucher of $10 for lunch", "unknown"),
    ("Competitive salary and more", "not disclosed"),
    ("we need 5 years", "unknown"), ("60k-80k EUR", "60k-80k EUR"),
    ("Salary: USD 120k annually", "USD 120k annually"), ("", "unknown"),
]
MODE = [
    ("Hybrid role in Berlin", "", "hybrid"), ("fully remote team", "", "remote"),
    ("remote work is fine, office too", "", "remote"), ("There is no remote work", "", "onsite"),
    ("on-site only", "", "onsite"), ("hybrid cloud engineer", "", "unknown"),
    ("not hybrid for the first months of all. Then this is a hybrid role for most weeks, whole year"
     , "", "hybrid"),
    ("x", "Berlin, Germany (Remote)", "remote"), ("", "", "unknown"),
    ("work from home", "", "remote"), ("2 days per week in the office", "", "hybrid"),
]


def test_salary(spark):
    df = spark.createDataFrame([(i, "", t, "") for i, (t, _) in enumerate(PAY)],
                               "id int, title string, body string, location string")
    got = [r.salary for r in add_facts(df).orderBy("id").collect()]
    assert [g.value for g in got] == [w for _, w in PAY]
    assert "€60,000" in got[0].quote


def test_work_mode(spark):
    df = spark.createDataFrame([(i, "", t, p) for i, (t, p, _) in enumerate(MODE)],
                               "id int, title string, body string, location string")
    got = [r.work_mode for r in add_facts(df).orderBy("id").collect()]
    assert [g.value for g in got] == [w for *_, w in MODE]
    assert got[6].quote.endswith("whole year") and "this is a hybrid" in got[6].quote


def test_quota_and_error_class(spark):
    df = spark.createDataFrame([
        ("403 user quota: $1.25, need quota: $3.5",), ("403 quota",), ("quota",),
        ("HTTP 401 bad",), ("rate limit hit",), ("request timed out",), ("boom",), ("  ",),
        ("exit unclassified",)], "t string")
    t = F.col("t")
    got = df.select(facts.quota_figures(t).alias("q"), facts.is_quota_error(t).alias("e"),
                    facts.error_class(t).alias("c")).collect()
    assert (got[0].q.have, got[0].q.need) == (1.25, 3.5)
    assert [g.e for g in got[:4]] == [True, True, False, False]
    assert [g.c for g in got] == ["quota", "quota", "quota", "auth", "quota", "timeout",
                                  "transient", "unknown", "unknown"]
