"""Operators that must hold when one key, one chain or one row has most of the work."""

import json
import random
import re
import time
from collections import Counter
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from siftline.functions.names import company_match_score, name_forms
from siftline.operators import neardup
from siftline.operators.fuzzy import company_matches
from siftline.operators.joins import mark_repeats, run_ledger
from siftline.operators.reports import cut_profile
from siftline.operators.robots import confirmed, robots_allowed, rule_lines, rule_table
from siftline.operators.skew import grid_join, running_sum, spread_join
from siftline.sources.replies import first_object, recovered_object


# ---- joins and sums -------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [1, 3, 1000])
def test_grid_join_meets_each_pair_once(spark, block):
    r = random.Random(block)
    left = [(i, r.choice(["hot"] * 6 + ["a", "b", None])) for i in range(40)]
    right = [(i, r.choice(["hot"] * 6 + ["a", "c", None])) for i in range(30)]
    l, m = spark.createDataFrame(left, "i int, k string"), spark.createDataFrame(right, "j int, k string")
    got = grid_join(l, m, "k", [F.col("i")], [F.col("j")], block)
    assert sorted(got.columns) == ["i", "j", "k"]
    want = Counter((i, j, a) for i, a in left for j, b in right if a == b and a is not None)
    assert Counter((x.i, x.j, x.k) for x in got.collect()) == want


def test_grid_join_spreads_a_hot_key(spark):
    side = spark.range(4000).select(F.col("id"), F.lit("hot").alias("k"))
    got = grid_join(side.withColumnRenamed("id", "i"), side.withColumnRenamed("id", "j"), "k",
                    [F.col("i")], [F.col("j")], 500)
    assert got.count() == 16_000_000
    cells = (got.groupBy(F.pmod(F.xxhash64("i"), F.lit(8)), F.pmod(F.xxhash64("j"), F.lit(8)))
             .count().select("count").toPandas()["count"])
    assert len(cells) == 64 and cells.max() <= 1.4 * cells.median()


def test_spread_join_keeps_rows(spark):
    left = spark.createDataFrame([(i, "k" if i % 3 else None) for i in range(50)], "i int, k string")
    right = spark.createDataFrame([("k", 7)], "k string, v int")
    got = spread_join(left, right, ["k"], [F.col("i")], "left")
    assert Counter((x.i, x.k, x.v) for x in got.collect()) == Counter(
        (i, "k", 7) if i % 3 else (i, None, None) for i in range(50))


def test_running_sum(spark):
    r = random.Random(3)
    values = [(r.randint(0, 30), i, r.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(values, "a int, b int, w int").repartition(5)
    got = {(x.a, x.b): x.s for x in running_sum(df, [F.desc("a"), F.asc("b")], F.col("w"), "s").collect()}
    total = 0
    for a, b, w in sorted(values, key=lambda v: (-v[0], v[1])):
        total += w
        assert got[a, b] == total
    assert running_sum(df.limit(0), [F.asc("a")], F.col("w"), "s").count() == 0


# ---- company names --------------------------------------------------------------------------------

def _names(seed, n):
    r = random.Random(seed)
    first = ["maersk", "nordic", "Maersk", "søren", "soren", "ab", "abc", "abcd", "x", "data", "dataworks", "Æble"]
    return ["Holding " * (r.random() < 0.5) + " ".join(r.choices(first, k=r.randint(1, 3)))
            + r.choice(["", " A/S", " (DK)", ", Oslo", " ApS"]) for _ in range(n)] + ["", None, "A/S"]


@pytest.mark.parametrize("seed", range(2))
def test_company_matches_equal_all_pairs(spark, seed):
    q = spark.createDataFrame([(x,) for x in _names(seed, 40)], "query string")
    c = spark.createDataFrame([(x,) for x in _names(seed + 9, 60)], "company string")
    pairs = q.distinct().crossJoin(c.distinct()).withColumn(
        "score", company_match_score(name_forms(F.col("query")), name_forms(F.col("company"))))
    want = Counter(tuple(x) for x in pairs.filter("score >= 30").collect())
    assert Counter(tuple(x) for x in company_matches(q, c).collect()) == want


def test_company_matches_by_city(spark):
    q = spark.createDataFrame([("Maersk", "Århus"), ("Maersk", ""), ("Maersk", "Oslo")],
                              "query string, city string")
    c = spark.createDataFrame([("Maersk A/S", "aarhus C"), ("Maersk A/S", "Berlin")],
                              "company string, city string")
    got = Counter((x.query, x.city) for x in company_matches(q, c).collect())
    assert got["Maersk", "aarhus C"] == 2 and got["Maersk", "Berlin"] == 1


# ---- chains of titles ------------------------------------------------------------------------------

def _followers_of(edges):
    """Later nodes follow when an earlier neighbour leads."""
    lead, out = {}, set()
    for n in sorted({x for e in edges for x in e}):
        lead[n] = not any(lead[a] for a, b in edges if b == n)
        if not lead[n]:
            out.add(n)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_followers_equal_the_fold(spark, seed):
    r = random.Random(seed)
    pairs = {tuple(sorted(r.sample(range(60), 2))) for _ in range(20 + 40 * seed)}
    pairs |= {(100 + i, 101 + i) for i in range(25)} | {(200, 201 + i) for i in range(9)}
    df = spark.createDataFrame([(f"{a:03}", f"{b:03}") for a, b in pairs], "early string, late string")
    got = {int(x.late) for x in neardup._followers(df).collect()}
    assert got == _followers_of(pairs)


def test_a_long_chain_takes_few_writes(spark, monkeypatch):
    writes = []

    def counted(df):
        writes.append(1)
        return df.sparkSession.createDataFrame(df.collect(), df.schema)

    monkeypatch.setattr(neardup, "cut_lineage", counted)
    chain = spark.createDataFrame([(f"{i:05}", f"{i + 1:05}") for i in range(2000)],
                                  "early string, late string")
    got = {int(x.late) for x in neardup._followers(chain).collect()}
    assert got == set(range(1, 2001, 2)) and len(writes) < 15


# ---- robots ----------------------------------------------------------------------------------------

def _allowed(body, agent, path):
    """The rules by hand: longest pattern, Disallow on a tie, own group before ``*``."""
    groups, last = [], None
    for line in re.split("\r\n|[\n\r]", body):
        line = re.sub("#.*$", "", line).strip()
        if ":" not in line:
            continue
        field, value = (x.strip() for x in line.split(":", 1))
        field = field.lower()
        if field == "user-agent":
            if last != "user-agent":
                groups.append([set(), []])
            groups[-1][0].add(value.lower())
        elif field in ("allow", "disallow"):
            if groups:
                groups[-1][1].append((field == "allow", value))
        else:
            continue
        last = field
    own = [g for g in groups if agent.lower() in g[0] and g[1]]
    rules = [x for g in own or [g for g in groups if "*" in g[0]] for x in g[1]]
    p, q = re.match(r"([^?]*)(.*)", path, re.S).groups()
    asked = unquote(p) + q
    best = (-1, True)
    for allow, pattern in rules:
        pattern = unquote(pattern)
        rx = "".join(".*" if c == "*" else "$" if c == "$" else re.escape(c) for c in pattern)
        if pattern and re.match(rx, asked):
            best = max(best, (len(pattern), not allow))
    return not best[1] if best[0] >= 0 else True


def test_robots_equal_the_rules_by_hand(spark):
    r = random.Random(8)
    parts = ["User-agent: bot", "user-agent: *", "User-Agent: other", "Allow: /a", "Disallow: /a",
             "Disallow: /", "Allow: /a/*.html$", "Disallow: /*b", "Disallow:", "Allow: /x%20y", "",
             "# note", "Sitemap: /s", "Disallow: /a/b # why", "junk", "Crawl-delay: 3", "Allow: /a/b+c"]
    bodies = {f"h{i}": r.choice(["\n", "\r\n", "\r"]).join(r.choices(parts, k=r.randint(0, 14)))
              for i in range(60)}
    paths = ["/", "/a", "/a/b", "/a/b.html", "/x y", "/x%20y/z", "/cb?b", "/a/b+c", "/a/b.html?x"]
    rows = [(i, h, p) for i, (h, p) in enumerate((h, p) for h in bodies for p in paths)]
    rows += [(len(rows) + i, "h0", "/a") for i in range(200)] + [(-1, "unknown", "/a")]
    files = spark.createDataFrame(list(bodies.items()), "host string, body string")
    urls = spark.createDataFrame(rows, "url_id int, host string, path string").repartition(4)
    got = {x.url_id: x.allowed for x in robots_allowed(urls, rule_table(files), "Bot").collect()}
    assert got == {i: _allowed(bodies.get(h, ""), "bot", p) for i, h, p in rows}
    none = spark.createDataFrame([("h0", "<html>no rules</html>")], "host string, body string")
    shut = robots_allowed(urls, rule_table(none), "bot", confirmed(none)).filter("host = 'h0'")
    assert not any(x.allowed for x in shut.collect())


def test_a_long_rule_file_is_linear(spark):
    body = "\n".join(f"User-agent: a{i}\nDisallow: /p{i}" for i in range(25_000))
    files = spark.createDataFrame([("h", body)], "host string, body string")
    start = time.time()
    assert rule_lines(files).count() == 25_000 and rule_table(files).count() == 25_000
    assert time.time() - start < 30


# ---- objects in replies ----------------------------------------------------------------------------

def _slow(text):
    at = text.find("{")
    while at >= 0:
        depth, inside, escaped = 0, False, False
        for i in range(at, len(text)):
            c = text[i]
            if inside:
                escaped, inside = (False, True) if escaped else (c == "\\", c != '"')
            elif c == '"':
                inside = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    try:
                        json.loads(text[at:i + 1])
                        return text[at:i + 1]
                    except json.JSONDecodeError:
                        break
        at = text.find("{", at + 1)
    return None


def test_first_object_equals_a_slow_scan():
    r = random.Random(2)
    for _ in range(20_000):
        text = "".join(r.choices(["{", "}", '"', ":", "1", "\\", "a", ",", "[", "]", '"a":', " ",
                                  '{"a":1}', "\n"], k=r.randint(0, 14)))
        assert first_object(text) == _slow(text), text


@pytest.mark.parametrize("text,found", [
    ('{"a": ' * 50_000, False), ("{ x } " * 170_000, False), ('{"a":"{' * 50_000, False),
    ('{"a":1 x}' * 50_000 + "{}", True), ('{"a":' * 50_000 + "1" + "}" * 50_000, True)])
def test_many_braces_take_little_time(text, found):
    start = time.time()
    got = first_object(text)
    assert (got is not None) == found and time.time() - start < 5
    assert got is None or json.loads(got) is not None


def test_objects_of_a_column(spark):
    rows = [("x {\"a\": 1} y", '{"a": 1}'), (None, None), ("", None), ("{" * 9, None)]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", recovered_object(F.col("t")))
    assert all(x.got == x.want for x in df.collect())


# ---- ledger and order statistics -------------------------------------------------------------------

def test_runs_are_counted_for_any_spelling(spark):
    r = random.Random(6)
    dates = [f"2024-0{r.randint(1, 9)}-1{r.randint(0, 9)}" for _ in range(60)]
    dates += [f"junk {i}" for i in range(80)] + ["2024-05", "", " ", None, "9999", " 2024-03-11 "]
    seen = spark.createDataFrame([(f"k{i}", d) for i, d in enumerate(dates)], "key string, rank_date string")
    runs = {d.strip() for d in dates if d and re.fullmatch(".{4}-.{2}-.{2}", d.strip())}
    want = {d.strip(): sum(x > d.strip() for x in runs) for d in dates if d and d.strip()}
    assert {x.last_seen: x.runs_ago for x in run_ledger(seen.repartition(4)).collect()} == want
    records = spark.createDataFrame([(f"k{i}",) for i in range(0, 160, 3)], "dedup_key string")
    for x in mark_repeats(records, seen, "2024-12-01").collect():
        i = int(x.dedup_key[1:])
        assert x.is_repeat == (i < len(dates))
        if x.is_repeat:
            assert x.runs_ago == want.get((dates[i] or "").strip())


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500])
def test_cut_profile_of_doubles(spark, n):
    r = random.Random(n)
    rows = [(i, r.choice([r.random(), 0.5]), f"t{i}", "c") for i in range(n)]
    df = spark.createDataFrame(rows + [(n, None, "none", "c")],
                               "pos int, score double, title string, company string").repartition(3)
    got = cut_profile(df).first()
    scores = sorted(x[1] for x in rows)
    if not rows:
        assert got["min"] is None and got["median"] is None
        return
    best = next(x for x in rows if x[1] == scores[-1])
    assert (got["min"], got["max"], got["median"], got["best_title"]) == (
        scores[0], scores[-1], scores[n // 2], best[2])
