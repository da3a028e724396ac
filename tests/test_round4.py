"""Empty texts beside the SQL twin, negators beside accented letters."""

import duckdb
from oracle import compare
from pyspark.sql import functions as F

from siftline.catalog import QUERIES, SQL
from siftline.functions.facts import add_facts
from siftline.operators.dedup import unify


def test_empty_texts_are_listed_as_the_twin_does(spark, tmp_path):
    """An empty text came out null, as a missing one does."""
    texts = ["", None, " \n ", "short ", "x" * 500, "y" * 499 + " z", " " * 501]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, t, "en", "src0") for i, t in enumerate(texts)],
                          "doc_id long, text string, lang string, source string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    diff, n = compare(spark, con, str(tmp_path), "unified_rows", QUERIES["unified_rows"],
                      SQL["unified_rows"])
    assert diff == "" and n == len(texts)
    got = {r.doc_id: r.description_snippet
           for r in QUERIES["unified_rows"](spark, str(tmp_path)).collect()}
    assert got == {0: "", 1: None, 2: "", 3: "short", 4: "x" * 500, 5: "y" * 499 + "...", 6: "..."}


def test_unify_keeps_no_snippet_of_an_empty_text(spark):
    """The operator stays as the reference: nothing to read gives no snippet."""
    df = spark.createDataFrame([("",), (None,), (" a\t",)], "description string").withColumns(
        {c: F.lit("x") for c in ("title", "company", "url", "location")})
    assert [r.description_snippet for r in unify(df).collect()] == [None, None, "a"]


def test_negators_are_whole_words_of_any_alphabet(spark):
    """The SQL takes the first for a negator and the second for none; the reference does not."""
    rows = [("que noñadoeses. Miga. There is no remote work here.", "onsite"),
            ("llaci para no. Competitive salary and remote work.", "unknown")]
    df = spark.createDataFrame([(i, "", t, "") for i, (t, _) in enumerate(rows)],
                               "id int, title string, body string, location string")
    got = [r.work_mode.value for r in add_facts(df).orderBy("id").collect()]
    assert got == [w for _, w in rows]
