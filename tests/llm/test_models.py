"""Language, toxicity, pages and neighbours: held-out accuracy, brute force, odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from siftline.llm import html, language, neighbours, toxicity

SYLLABLES = {"aa": ["the", "ing", "and", "er", "on"], "bb": ["der", "sch", "ung", "keit", "ein"],
             "cc": ["ción", "que", "los", "ado", "ra"]}


def prose(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4)))
                    for _ in range(n))


def test_language(spark, no_docs):
    table = [(i, prose(lang, i, 20 + i), lang) for i, lang in enumerate(list(SYLLABLES) * 30)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string")
    model = language.fit(df.filter("doc_id < 60"))
    odd = [(1000, None, None), (1001, "", "aa"), (1002, "123 — !! ¿ 🙂", "aa"), (1003, "ing " * 90_000, None),
           (None, "der schung", "bb"), (1004, "zxq wvkj 漢字漢字漢字漢字漢字漢字漢字漢字漢字漢字" * 20, None)]
    rows = df.union(spark.createDataFrame(odd, df.schema))
    got = {r.doc_id: r for r in language.predict(rows, model, keep=("doc_id",)).collect()}
    assert len(got) == len(table) + len(odd)
    assert np.mean([got[i].lang_pred == lang for i, _, lang in table if i >= 60]) > 0.95
    assert not any(got[i].rejected for i, _, _ in table)
    assert all(0 <= r.score <= 1 for r in got.values())
    for i in (1000, 1001, 1002):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
    assert got[1003].lang_pred == "aa" and got[None].lang_pred == "bb" and got[1004].rejected
    empty = language.fit(no_docs)
    assert {r.lang_pred for r in language.predict(rows, empty, keep=("doc_id",)).collect()} == {"und"}
    assert language.predict(no_docs, model, keep=("doc_id",)).count() == 0


def test_copies_do_not_fill_the_language_sample(spark):
    table = [(prose("aa", 0), "aa")] * 300 + [(prose("bb", 0), "bb"), (prose("bb", 0), "cc")]
    table += [(prose("aa", i), "aa") for i in range(1, 20)] + [(None, "aa")]
    df = spark.createDataFrame(table, "text string, lang string").repartition(3)
    for sample in (90, 15):
        got = language._sampled(df, "lang", sample, 3).collect()
        assert len(got) == len({r.text for r in got}) == min(20, sample // 3) + 1
        assert {(r.language, r.text) for r in got if r.language != "aa"} == {("bb", prose("bb", 0))}


def test_toxicity(spark, no_docs, docs):
    r = random.Random(5)
    table = []
    for i in range(400):
        text = prose("aa", i, 50).split()
        if i % 5 == 0:
            for _ in range(1 + i % 4):
                text.insert(r.randrange(50), "vilest" + r.choice(["", "ly", "ness"]))
        table.append((i, " ".join(text), int(i % 5 == 0)))
    df = spark.createDataFrame(table, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").union(spark.createDataFrame(
        [(9999, 1), (None, 1), (3, None)], "doc_id long, toxic int"))
    texts = df.select("doc_id", "text").union(spark.createDataFrame(
        [(1000, None), (1001, ""), (None, "vilest vilest vilest"), (1002, "ing " * 60_000)],
        "doc_id long, text string"))
    rows = toxicity.score(texts, labels, F.col("doc_id") < 300).collect()
    got = {x.id: x for x in rows}
    assert len(rows) == 404 and all(0 <= x.score <= 1 for x in rows)
    held = [(got[i].predicted, y) for i, _, y in table if i >= 300]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert got[None].predicted == 1 and got[1000].predicted == got[1001].predicted == 0
    assert toxicity.score(no_docs, labels, F.lit(True)).count() == 0
    assert {x.score for x in toxicity.score(texts, labels.limit(0), F.lit(True)).collect()} == {0.0}


def test_toxic_texts_without_telling_words(spark):
    """All words and both labels are in the index: a copy finds its labelled text."""
    table = [(i, prose("aa", i, 30), 0) for i in range(60)]
    table += [(100 + i, prose("bb", i, 30), 1) for i in range(2)]
    df = spark.createDataFrame(table, "doc_id long, text string, toxic int")
    copies = df.select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    got = {r.id: r for r in toxicity.score(df.select("doc_id", "text").union(copies), df.select(
        "doc_id", "toxic"), F.col("doc_id") < 1000).collect()}
    assert len(got) == 124 and all(got[1000 + i].evidence[0] == i for i, _, _ in table)
    clean = max(got[1000 + i].score for i, _, y in table if not y)
    assert all(got[1000 + i].score > clean for i, _, y in table if y)


def test_block_max_neighbours_are_exact():
    r = np.random.default_rng(3)
    rows = []
    for _ in range(500):
        s = np.sort(r.choice(40, r.integers(1, 6), replace=False))
        rows.append((s, r.integers(1, 4, len(s)).astype(float)))
    idf = r.random(40) + 0.5
    order = sorted(range(500), key=lambda i: (list(rows[i][0]), list(rows[i][1])))
    index = toxicity.build_index(rows, np.zeros(500), idf)
    dense = np.zeros((500, 40))
    for i, o in enumerate(order):
        dense[i, rows[o][0]] = toxicity.unit(rows[o][1], idf[rows[o][0]])
    for o in range(0, 500, 17):
        s, w = rows[o][0], toxicity.unit(rows[o][1], idf[rows[o][0]])
        cos = dense[:, s] @ w
        found, got = toxicity.nearest(index, s, w, 15)
        best = sorted(((c, -i) for i, c in enumerate(cos) if c > 0), reverse=True)[:15]
        assert np.allclose(got, [c for c, _ in best])
        assert np.allclose(cos[found], got)


PAGE = ("<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var a='</p>';"
        "</script></head><body><nav><ul><li><a href='/'>Home {i}</a></li></ul></nav>"
        "<div class=\"ad box\">Buy {i}</div>{open}<h1>Head &amp; {i}</h1><p>One\n  {i}<p><b>Two&nbsp;x"
        "</b><br>three<div class='comments'><p>great post</p></div>{close}"
        "<form><input name=q>Search</form><aside>More</aside><footer>&copy; me</footer></body></html>")


def test_pages(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i=i, open="<article>", close="</article>"), "x", 1)
            for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", PAGE.format(i=i, open="<div>", close="</div>"), "x", 1)
             for i in range(3)]
    rows += [(200, None, None, "x", 1), (201, "odd", "", "x", 1), (202, "http://c.example", "plain & text",
             "x", 1), (203, "http://c.example/2", "<p>a<script>never ends", "x", 1),
             (204, "http://d.example/", "<article>" + "<p>w</p>" * 20_000, "x", 1), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int")
    got = html.extract(df).collect()
    assert len(got) == len(rows)
    text = {r.id: r.text for r in got}
    for i in (*range(12), *range(100, 103)):
        assert text[i] == f"Head & {i % 100}\nOne {i % 100}\nTwo x\nthree"
    assert text[200] == text[201] == "" and text[202] == "plain & text" and text[203] == "a"
    assert text[204] == "\n".join(["w"] * 20_000)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract(df.limit(0)).count() == 0


def test_marked_wrappers_keep_the_article():
    story = "<h1>Head</h1><p>one two three four five</p>"
    rest = "<div class='comments'><p>great post</p></div>"
    want = "Head\none two three four five"

    def text(page):
        return html.main_text(page, [], set(), None)

    for mark in ("class='layout has-sidebar'", "class=widget-container", "id='post-with-comments'"):
        side = "<div class='related'><article>a teaser</article></div>"
        assert text(f"<body><div {mark}><article>{story}{rest}</article></div>{side}</body>") == want
        assert text(f"<div {mark}><div {mark}><main>{story}</main>{rest}</div></div>{side}") == want
        assert text(f"<main><div {mark}><article>{story}</article></div>{side}</main>") == want
        assert text(f"<div>Site</div><div {mark}>{story}{rest}</div>") == "Site\n" + want
        assert text(f"<div {mark}><p>one two</p>{rest}</div>") == "one two"
    assert text(f"<div class='masthead'><h1>Site</h1></div><div>{story}</div>{rest}") == want
    assert text(f"<div>{story}</div><div class='comments'>{'long ' * 50}</div>") == want


def test_neighbours(spark):
    r = np.random.default_rng(11)
    base = r.standard_normal((300, 16))
    table = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    table += [(400 + i, table[7][1]) for i in range(60)]
    odd = [(900, None), (920, []), (940, [0.0] * 16), (960, [None] + [1.0] * 15),
           (980, [float("nan")] * 16), (1000, [float("inf")] * 16), (None, table[1][1])]
    df = spark.createDataFrame(table + odd, "vec_id long, embedding array<float>")
    df = df.withColumn("rank", F.lit("x")).withColumn("score", F.lit(1))
    asks = F.col("vec_id") % 20 == 0
    got = neighbours.nearest_neighbours(df, asks, least=100_000).collect()
    ids = np.array([i for i, _ in table])
    x = np.array([v for _, v in table], float)
    for q in ids[ids % 20 == 0]:
        score = (x * x[list(ids).index(q)]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:20]
        mine = sorted((g["rank"], g.id, g.score) for g in got if g.query_id == q)
        assert [m[1] for m in mine] == list(ids[order]) and [m[0] for m in mine] == list(range(1, 21))
        assert np.allclose([m[2] for m in mine], score[order], rtol=0, atol=1e-12)
    assert {g.query_id for g in got} == set(ids[ids % 20 == 0])
    few = neighbours.nearest_neighbours(df.filter("vec_id < 5"), asks).collect()
    assert len(few) == 4
    assert neighbours.nearest_neighbours(df.limit(0), asks).count() == 0


def test_forest_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    got = neighbours.nearest_neighbours(df, F.col("vec_id") % 20 == 0, 20, 1.5, least=0).collect()
    table = df.orderBy("vec_id").collect()
    x = np.array([t.embedding for t in table], float)
    hits = total = 0
    for i in range(0, len(table), 20):
        score = (x * x[i]).sum(axis=1)
        score[i] = -9
        best = {table[j].vec_id for j in np.argsort(-score, kind="stable")[:20]}
        hits += len(best & {g.id for g in got if g.query_id == table[i].vec_id})
        total += 20
    assert hits / total >= 0.9
