"""Phrases, spelling variants and the URL vocabulary against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import phrases, spelling, urls

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def lower(text):
    return (text or "").translate(LOW)


# ---- phrases ------------------------------------------------------------------------------------

def brute_phrases(rows, least, longest, cover, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    kept = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *w), a in kept.items():
        if any(100 * b >= cover * a for (l2, *v), b in kept.items()
               if l2 == lang and len(v) > len(w)
               and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))):
            continue
        cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append(
            (-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -score)
            for lang, found in out.items()
            for i, (score, a, p, l, r) in enumerate(sorted(found)[:top])}


def prose(seed, rows=60):
    r = random.Random(seed)
    vocabulary = ["the", "of", "a", "New", "york", "stock", "exchange", "ünï", "x", "ab", "漢字"]
    weights = [9, 7, 6, 3, 3, 2, 2, 1, 1, 1, 1]
    out = []
    for i in range(rows):
        words = r.choices(vocabulary, weights, k=r.randint(0, 40))
        gaps = r.choices([" ", "  ", "\t", ". ", "\n", ","], [14, 2, 1, 1, 1, 1], k=len(words))
        out.append((r.choice(["en", "en", "de", None]), "".join(map("".join, zip(words, gaps)))))
    return out + [("en", None), ("de", ""), (None, " . "), ("en", "new york " * 400)]


@pytest.mark.parametrize("shards,limit,longest", [(1, 1 << 22, 3), (3, 120, 3), (4, 60, 4), (2, 200, 2)])
def test_phrases_equal_brute_force(spark, shards, limit, longest):
    rows = prose(shards)
    docs = spark.createDataFrame([(*row, i, "n", 1) for i, row in enumerate(rows)],
                                 "lang string, text string, h long, phrase string, n long")
    found = phrases.collocations(docs.repartition(3), least=5, longest=longest, top=25,
                                 shards=shards, limit=limit).collect()
    want = brute_phrases(rows, 5, longest, 50, 25)
    assert {tuple(x) for x in found} == want and len(found) == len(want)


def test_phrases_of_an_empty_table_and_repeated_rows(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(none).count() == 0
    docs = spark.createDataFrame([("en", "red fish, blue")] * 12, "lang string, text string")
    assert [tuple(x) for x in phrases.collocations(docs).collect()] == [
        ("en", 1, "red fish", 12, 12, 12, 36, 1000000)]


def test_words_that_are_names_of_languages(spark):
    rows = [("en", "es of en es")] * 6 + [("es", "en of es")] * 7 + [(None, "und en")] * 5
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = phrases.collocations(docs, least=5).collect()
    assert {tuple(x) for x in found} == brute_phrases(rows, 5, 3, 50, 2000)


def test_a_late_phrase_gets_a_whole_cycle(spark):
    # The parts of "p q r" are frequent only through the last shard; all shards must count.
    rows = [("en", "p q r")] * 3 + [("en", "z")] * 3 + [("en", "p q r " * 2)] * 4
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    found = phrases.collocations(docs, least=10, shards=5, limit=6).collect()
    want = brute_phrases(rows, 10, 3, 50, 2000)
    assert {tuple(x) for x in found} == want


# ---- spelling -----------------------------------------------------------------------------------

def brute_words(rows, every, least, often):
    found = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= often}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n, times=10):
    near_of = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in near_of.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], len(near_of[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def test_words_equal_brute_force(spark):
    r = random.Random(5)
    pool = ["".join(r.choices("abéÀñzQ×", k=r.randint(1, 14))) for _ in range(40)] + ["é" * 90, "Ab" * 70]
    rows = [(i % 50 if i % 9 else None, " ".join(r.choices(pool, k=r.randint(0, 60))))
            for i in range(120)]
    rows += [(1, None), (2, ""), (3, "12 漢字漢字漢字漢字"), rows[5], rows[5]]
    docs = spark.createDataFrame([(*x, "w", 1) for x in rows],
                                 "doc_id long, text string, word string, n long").repartition(3)
    for every in (31, 3):
        found = {x.word: x.n for x in spelling.long_words(docs, every=every).collect()}
        assert found == brute_words(rows, every, 7, 2)


def misspellings(seed, size):
    r = random.Random(seed)
    words = {}
    for _ in range(size):
        base = "".join(r.choices("abcé", k=r.randint(7, 11)))
        words[base] = r.choice([2, 30, 30, 1000])
        for _ in range(r.randint(0, 4)):
            i, c = r.randrange(len(base) + 1), r.choice("abcé")
            v = r.choice([base[:i] + c + base[i:], base[:i] + base[i + 1:], base[:i] + c + base[i + 1:]])
            if len(v) >= 7:
                words.setdefault(v, r.choice([2, 3, 3, 30]))
    words["a" * 20], words["a" * 21], words["b" + "a" * 20] = 1, 10, 100
    return words


@pytest.mark.parametrize("seed", range(3))
def test_variants_equal_brute_force(spark, seed):
    words = misspellings(seed, 150)
    rows = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    found = spelling.spelling_variants(rows).select("word", "n", "n_near", "form", "form_n", "root")
    assert {tuple(x) for x in found.collect()} == brute_variants(words)


def test_variants_of_no_words(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert spelling.spelling_variants(spelling.long_words(docs)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=3, max_size=3, unique=True), st.data())
def test_pivots_are_the_cheapest_disjoint_pair(places, data):
    places.sort()
    cost = data.draw(st.lists(st.integers(1, 9), min_size=3, max_size=3))
    pairs = [(cost[i] + cost[j], (places[i], places[j])) for i in range(3) for j in range(i)
             if places[i] - places[j] >= 2]
    chosen = spelling.pivots_of(places, cost, 1)
    assert len(chosen) == 2 and chosen[1] - chosen[0] >= 2
    assert sum(cost[places.index(p)] for p in chosen) == min(pairs)[0]


# ---- addresses ----------------------------------------------------------------------------------

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))

ADDRESSES = {
    "http://WWW.Example.ORG/es/Casino?x=1#y": ("www.example.org", "/es/Casino", "example.org/es/", "block"),
    "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
    "https://casino.example.org/en/2": ("casino.example.org", "/en/2", "org/", "allow"),
    "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "http://casino.com/fr/": ("casino.com", "/fr/", "com/fr/", "allow"),
    "http://a.com/de/?q": ("a.com", "/de/", "com/de/", "block"),
    "http://casino-win.net/": ("casino-win.net", "/", None, "block"),
    "http://a.net/CASINO.html": ("a.net", "/CASINO.html", None, "block"),
    "http://occasinos.net/casinos": ("occasinos.net", "/casinos", None, "allow"),
    "http://free.net/free/free": ("free.net", "/free/free", None, "allow"),
    "http://free1bets.net": ("free1bets.net", "", None, "block"),
    "http://fréebets.net/free-ébets": ("fréebets.net", "/free-ébets", None, "block"),
    "http://a.net?casino": ("a.net", "", None, "allow"),
    "http://a.net#://casino/": ("a.net", "", None, "allow"),
    "x://y://casino.org/": ("y:", "//casino.org/", None, "block"),
    "casino": ("", "", None, "allow"), "": ("", "", None, "allow"),
    "http://a.org": ("a.org", "", None, "allow"), "http://": ("", "", None, "allow"),
    "http://a.net/" + "q/" * 60000 + "porn": ("a.net", "/" + "q/" * 60000 + "porn", None, "block"),
}


def test_addresses(spark):
    rows = [(i, u, "h", 1) for i, u in enumerate(ADDRESSES)] + [(None, None, "h", 1)] + [(0, None, "h", 1)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, strict_hits int")
    found = urls.judge_urls(pages.repartition(2), RULES).collect()
    got = Counter((x.id, x.host, x.path, x.rule, x.verdict) for x in found)
    want = Counter((i, *v) for i, v in enumerate(ADDRESSES.values()))
    want.update([(None, "", "", None, "allow"), (0, "", "", None, "allow"), (0, "", "", None, "allow")])
    assert got == want
    assert urls.judge_urls(pages.limit(0), RULES).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("abxé-/1 ", max_size=12), min_size=1, max_size=8))
def test_terms_equal_patterns(spark, texts):
    strict, soft = ("ab", "abx"), ("x", "b", "xa", "ab")
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    for x in urls.term_hits(rows, "text", strict, soft).collect():
        def hits(terms):
            return sum(bool(re.search(f"(?<![a-z]){t}(?![a-z])", x.text)) for t in terms)
        assert (x.strict_hits, x.soft_hits) == (hits(strict), hits(("x", "b", "xa")))


def test_rules_of_one_length_go_to_the_longer_host(spark):
    pages = spark.createDataFrame([(1, "http://a.com/de/")], "page_id int, url string")
    rules = (("com", "/de/", "allow"), ("a.com", "/d", "block"))
    assert urls.judge_urls(pages, rules).first().rule == "a.com/d"
    with pytest.raises(ValueError):
        urls.judge_urls(pages, strict=("not a word",))
