"""Company-name fuzzy join without comparing every pair.

A pair can only score when the names share a core word (plain or anglicised) or one normalised
name contains the other. So candidates come from two equality joins:

* shared word, on the anglicised word (equal plain words are equal anglicised);
* containment, where the shorter name must have each of its letter groups in the longer one: the
  shorter side probes with its rarest group only, the longer side is indexed by all its groups.

Both joins are exact; the score then decides. Nothing is capped.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import fixed_values as V
from siftline.functions.names import anglicise, company_match_score, name_forms
from siftline.functions.text import text_or_empty
from siftline.operators.skew import grid_join

GRAM = 3


def _grams(ang, size):
    """All letter groups of one length."""
    n = F.length(ang) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n),
                                     lambda i: F.substring(ang, i, F.lit(size))))


def _all_grams(ang):
    """Letter groups of every length up to ``GRAM``; shorter ones serve very short names."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(_grams(ang, k), empty)
                                       for k in range(1, GRAM + 1)]))


def _containment(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs in which the short side's anglicised key lies inside the long side's.

    ``short`` has columns (sid, s) and ``long`` (lid, l), with ``name_forms`` in s and l. Plain
    containment implies anglicised containment, so one index serves both tests.
    """
    short_ang, long_ang = F.col("s.ang"), F.col("l.ang")
    probes = short.filter(F.length(short_ang) > 0).select(
        "sid", F.explode(F.array_distinct(
            _grams(short_ang, F.least(F.length(short_ang), F.lit(GRAM))))).alias("gram"))
    index = long.filter(F.length(long_ang) > 0).select(
        "lid", "l", F.explode(_all_grams(long_ang)).alias("gram"))
    # Counted where the rows are: one row per letter group is left, whatever groups are frequent.
    sizes = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # Groups the long side lacks rule a probe out; else the rarest group is the probe.
    rarest = (probes.join(F.broadcast(sizes), "gram", "left").groupBy("sid")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
              .filter("least.n > 0").select("sid", F.col("least.gram").alias("gram"))
              .join(short, "sid"))
    # Only groups that are probed leave the index; there are as many as letters allow, not names.
    wanted = rarest.select("gram").distinct()
    index = index.join(F.broadcast(wanted), "gram", "left_semi").select("lid", "l", "gram")
    return (grid_join(rarest, index, "gram", [F.col("sid")], [F.col("lid")])
            .filter(long_ang.contains(short_ang)).drop("gram"))


def company_matches(queries: DataFrame, companies: DataFrame, query: str = "query",
                    company: str = "company", min_score: int = V.COMPANY_MIN_SCORE) -> DataFrame:
    """All (query, company) pairs at or above the score, best first within a query.

    With a ``city`` column on both sides, a query's city must be part of the company's. Each pair is
    decided at one place only, so candidates need no ``distinct``: at the smallest word both names
    share, or, without a shared word, at the one letter group that the contained name probes with.
    """
    with_city = "city" in queries.columns and "city" in companies.columns
    c = companies.withColumnRenamed(company, "company")
    names = c.select("company").distinct().select(
        F.col("company").alias("lid"), name_forms(F.col("company")).alias("l"))
    asked = queries.select(F.col(query).alias("query")).distinct().select(
        F.col("query").alias("sid"), name_forms(F.col("query")).alias("s"))
    shared = F.array_intersect("s.words_ang", "l.words_ang")
    by_word = grid_join(
        asked.select("sid", "s", F.explode("s.words_ang").alias("word")),
        names.select("lid", "l", F.explode("l.words_ang").alias("word")), "word",
        [F.col("sid")], [F.col("lid")]).filter(F.col("word") == F.array_min(shared)).drop("word")
    apart = F.size(shared) == 0
    inside = _containment(asked, names).filter(apart)
    around = (_containment(names.toDF("sid", "s"), asked.toDF("lid", "l"))
              .select(F.col("lid").alias("sid"), F.col("l").alias("s"), F.col("sid").alias("lid"),
                      F.col("s").alias("l")).filter(apart & (F.col("s.ang") != F.col("l.ang"))))
    scored = (by_word.unionByName(inside).unionByName(around)
              .select(F.col("sid").alias("query"), F.col("lid").alias("company"),
                      company_match_score(F.col("s"), F.col("l")).alias("score"))
              .filter(F.col("score") >= min_score))
    if not with_city:
        return scored
    cities = queries.select(F.col(query).alias("query"), F.col("city").alias("asked")).distinct()
    place, want = F.lower(text_or_empty(F.col("city"))), F.lower(F.col("asked"))
    near = (F.coalesce(want, F.lit("")) == "") | place.contains(want) | anglicise(
        place).contains(anglicise(want))
    return (scored.join(cities, "query").join(c.select("company", "city"), "company")
            .filter(near).select("query", "company", "city", "score"))
