"""Query vocabulary: which terms score and which attribute a track."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import words


def split_vocabulary(tracks: DataFrame, other: DataFrame) -> tuple:
    """Terms of enabled tracks, and other sources' terms that no track covers.

    ``tracks(track, enabled, query)`` and ``other(source, enabled, query)``. The extra terms widen
    scoring only; they attribute nothing.
    """
    own = (tracks.filter("enabled").filter(F.trim("query") != "").select("track", "query"))
    folded = F.lower(F.trim("query"))
    extra = (other.filter("enabled").filter(F.trim(F.coalesce("query", F.lit(""))) != "")
             .withColumn("folded", folded)
             .join(own.select(folded.alias("folded")).distinct(), "folded", "left_anti")
             .groupBy("folded").agg(F.min_by(F.trim("query"), F.struct("source", "query"))
                                    .alias("query")))
    return own, extra


def match_vocabulary_table(records: DataFrame, vocabulary: DataFrame, key: str = "dedup_key",
                           title: str = "title") -> DataFrame:
    """Track hits from a vocabulary *table*, for vocabularies too large for one expression.

    Titles become word groups as long as the longest phrase and meet the terms by equality, so the
    work follows the title lengths and not records x terms. Struct columns: track, hits,
    specificity per record and track.
    """
    phrases = (vocabulary.select("track", F.btrim(words(F.col("query"))).alias("term"))
               .filter("term <> ''"))
    longest = phrases.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    whole = phrases.groupBy("track", "term").agg((F.count("*") * 10).alias("points"))
    parts = (phrases.select("track", F.explode(F.split("term", " ")).alias("term"))
             .filter(F.length("term") > 2).distinct().withColumn("points", F.lit(1)))
    terms = whole.unionByName(parts).groupBy("track", "term").agg(
        F.sum("points").alias("points"))
    tokens = F.split(F.btrim(words(F.col(title))), " ")
    df = records.select(key, tokens.alias("t")).withColumn("n", F.size("t"))
    groups = F.flatten(F.transform(
        F.sequence(F.lit(1), F.least(F.col("n"), F.lit(longest))),
        lambda k: F.transform(F.sequence(F.lit(1), F.col("n") - k + 1),
                              lambda i: F.array_join(F.slice(F.col("t"), i, k), " "))))
    grams = df.select(key, F.explode(F.array_distinct(groups)).alias("term"))
    return (grams.join(terms, "term").groupBy(key, "track")
            .agg(F.sum("points").alias("hits"), F.max(F.length("term")).alias("specificity")))


def best_track(hits: DataFrame, key: str = "dedup_key") -> DataFrame:
    """The track of each record: most hits, longest term, smallest id."""
    best = F.min(F.struct((-F.col("hits")).alias("h"), (-F.col("specificity")).alias("s"),
                          "track")).alias("b")
    return hits.groupBy(key).agg(best).select(key, F.col("b.track").alias("track"),
                                              (-F.col("b.h")).alias("hits"))
