"""Cases that crossed a border before: sentences, nesting, ties, encoded paths, headers."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import fixed_values as V
from siftline.functions import gates as G
from siftline.functions.scores import tenths
from siftline.functions.text import gate_lines, gate_text
from siftline.operators.robots import robots_allowed, rule_table
from siftline.operators.vocabulary import match_vocabulary_table
from siftline.sources.replies import recovered_object
from siftline.sources.sheets import sheet_layout


def _one(spark, text, make):
    df = spark.createDataFrame([(text,)], "t string").withColumn("l", gate_lines(F.col("t")))
    return df.select(*[c.alias(k) for k, c in make(F.col("l"), F.col("t")).items()]).first()


@pytest.mark.parametrize("text, denied, offered", [
    ("Is there a fee? No. Sponsorship is provided by us.", False, True),
    ("There is no sponsorship here.", True, False),
    ("We help you obtain a residence permit.", False, True),
    ("We are not able to provide that.", True, False)])
def test_sponsorship_stays_in_a_sentence(spark, text, denied, offered):
    got = _one(spark, text, lambda l, t: G.sponsorship_evidence(l))
    assert (got.denied, got.offered) == (denied, offered)


def test_sponsorship_topics_cover_all_patterns():
    """Random words of the patterns' language: a match never lacks a topic word."""
    import re

    r = random.Random(1)
    patterns = [*V.SPONSORSHIP_DENIED, *V.SPONSORSHIP_OFFERED, *V.AUTHORISATION_WALL]
    for p in patterns:
        for _ in range(400):
            text = re.sub(" +", " ", _sample(p, r))
            if re.search(p, text):
                assert any(w in text for w in G.SPONSORSHIP_TOPICS), (p, text)


def _sample(pattern, r):
    """A text that a pattern of words, groups and small repeats may match."""
    import re._parser as sre

    def walk(items):
        out = ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "SUBPATTERN":
                out += walk(arg[3])
            elif name == "BRANCH":
                out += walk(r.choice(arg[1]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                out += "".join(walk(inner) for _ in range(r.randint(low, min(high, low + 2))))
            elif name == "IN":
                out += " " if "SPACE" in str(arg) and "WORD" not in str(arg) else "x"
        return out

    return walk(sre.parse(pattern))


def test_language_stays_in_a_sentence(spark):
    across = "Our main clients are German. English is the office language."
    assert _one(spark, across, lambda l, t: G.language_evidence(l)).hit == ""
    assert _one(spark, "English and German", lambda l, t: G.language_evidence(l)).hit != ""


def test_years_stay_in_a_sentence(spark):
    text = "Minimum 2 years of experience. You join a team of 8. Years of experience required vary."
    got = _one(spark, text, lambda l, t: {"y": F.transform(G.years_figures(l), lambda m: m["years"])})
    assert got.y == [2]


def test_optional_language_is_quoted(spark):
    got = _one(spark, "We sell. German is an advantage.", lambda l, t: G.language_findings(
        F.struct(*[c.alias(k) for k, c in G.language_evidence(l).items()]), l, t))
    assert got["optional"] == ["german"] and "German is an advantage" in got["optional_quote"]


def test_objects_nest_deep(spark):
    deep = '{"a":{"b":{"c":{"d":{"e":{"f":"}{"}}}}}}'
    rows = [(f"x {deep} y {{\"z\":1}}", deep), ('say "hi" {bad {"k": "a } b"} end', '{"k": "a } b"}'),
            ("none", None), (None, None), ('{"open": 1', None), ("{}", "{}")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", recovered_object(F.col("t"))).collect())


def test_tenths_round_as_the_exact_value_does(spark):
    r = random.Random(4)
    w = V.OVERALL_WEIGHTS
    values = [80 * w["technical"] + 81 * w["experience"] + 80 * w["behavioral"] + 80 * w["career"],
              29.95, 80.25, 80.75, 0.25, 99.95, 100.0, 0.0, 74.95, 59.95]
    values += [sum(r.randint(0, 100) * x for x in w.values()) for _ in range(2000)]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert all(x.t == round(x.x, 1) for x in df.withColumn("t", tenths(F.col("x"))).collect())


def test_robots_paths_are_decoded(spark):
    files = spark.createDataFrame([("h", "User-agent: *\nDisallow: /foo%20bar\nDisallow: /q?a=%20b")],
                                  "host string, body string")
    urls = spark.createDataFrame([(1, "h", "/foo%20bar/x"), (2, "h", "/foo bar/x"), (3, "h", "/foo"),
                                  (4, "h", "/other?x=/foo%20bar")],
                                 "url_id int, host string, path string")
    got = {r.url_id: r.allowed for r in robots_allowed(urls, rule_table(files), "bot").collect()}
    assert got == {1: False, 2: False, 3: True, 4: True}


def test_headers_pair_by_category(spark):
    got = sheet_layout(spark, ["Firma", "By", "ID", "IT antal", "IT indeks", "Salg antal", "Other",
                               "Løn"])
    assert (got["company"], got["city"]) == ("Firma", "By")
    assert got["fields"] == [("IT antal", "it", "count"), ("IT indeks", "it", "index"),
                             ("Salg antal", "salg_antal", "count"), ("Other", "other", "index"),
                             ("Løn", "løn", "index")]


def test_long_phrases_match(spark):
    v = spark.createDataFrame([("T", "one two three four five six")], "track string, query string")
    d = spark.createDataFrame([("k", "x one two three four five six y")],
                              "dedup_key string, title string")
    assert match_vocabulary_table(d, v).first().hits > 10


def test_gate_text_keeps_signs(spark):
    got = spark.createDataFrame([("A–B & C/d",)], "t string").select(gate_text(F.col("t"))).first()[0]
    assert got == " a-b & c/d "
