import random

from pyspark.sql import functions as F

from siftline.functions.names import company_match_score, name_forms
from siftline.operators.neardup import collapse_near_duplicates


def greedy(rows):
    """Leader clustering, row by row, on token sets."""
    leaders, out = {}, {}
    for key, company, tokens, _ in sorted(rows, key=lambda r: r[3]):
        for lead, sig in leaders.setdefault(company, []):
            if 100 * len(sig & tokens) // len(sig | tokens) >= 80:
                out[key] = lead
                break
        else:
            leaders[company].append((key, tokens))
            out[key] = key
    return out


def test_collapse_equals_the_greedy_fold(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "zeta"]
    rows = []
    for i in range(400):
        company = rng.choice(["one", "one", "one", "two", ""])
        rows.append((f"k{i}", company, frozenset(rng.sample(words, rng.randint(4, 7))), i))
    df = spark.createDataFrame([(k, c, " ".join(sorted(t)), p) for k, c, t, p in rows],
                               "dedup_key string, company string, title string, pos int")
    got = {r.dedup_key: r.keeper_key
           for r in collapse_near_duplicates(df, ["pos"]).select("dedup_key", "keeper_key")
           .collect()}
    assert got == greedy(rows)


def test_company_scores(spark):
    cases = [("Mærsk", "Mærsk A/S", 100, 100), ("Carlsberg", "Carlsberg Danmark A/S", 80, 100),
             ("Maersk", "Mærsk A/S", 1, 100), ("IBM", "IBM Corporation", 1, 100),
             ("ab", "Something Unrelated Company", 0, 0), ("", "Mærsk A/S", 0, 0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(cases)],
                               "id int, q string, n string")
    got = df.select("id", company_match_score(name_forms(F.col("q")), name_forms(F.col("n")))
                    .alias("s")).orderBy("id").collect()
    for (a, b, low, high), r in zip(cases, got):
        assert low <= r.s <= high, (a, b, r.s)
