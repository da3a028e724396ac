"""Exact dedup, key migration and their accounting."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions.keys import dedup_key, posted_at
from siftline.functions.text import blank_to_null, strip, text_or_empty

SNIPPET_CHARS = 500


def unify(df: DataFrame, description: str = "description") -> DataFrame:
    """Raw portal rows in the fixed corpus shape; other columns are kept."""
    text = F.col(description)
    cut = F.concat(strip(F.substring(text, 1, SNIPPET_CHARS)),
                   F.when(F.length(text) > SNIPPET_CHARS, "...").otherwise(""))
    return df.withColumns({
        "title": strip(text_or_empty("title")), "company": blank_to_null(F.col("company")),
        "url": strip(text_or_empty("url")), "location": blank_to_null(F.col("location")),
        "description_snippet": F.when(text != "", cut),
    })


def usable(url: Column, company: Column, title: Column) -> Column:
    """A record needs a URL, or both a company and a title."""
    named = (F.coalesce(company, F.lit("")) != "") & (F.coalesce(title, F.lit("")) != "")
    return (F.coalesce(url, F.lit("")) != "") | named


def first_per_key(df: DataFrame, key, order) -> DataFrame:
    """The first row of every key in an explicit order.

    Spark turns ``row_number() <= 1`` into a group limit before the shuffle, so each task sends
    one row per key and a hot key stays cheap.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_wins(corpus: DataFrame, order=("file_rank", "row_pos")) -> DataFrame:
    """Usable rows with their key; the first arrival of a key wins."""
    keyed = (corpus.filter(usable(F.col("url"), F.col("company"), F.col("title")))
             .withColumn("dedup_key", dedup_key(F.col("url"), F.col("company"), F.col("title"))))
    return first_per_key(keyed, "dedup_key", order)


def dedup_accounting(corpus: DataFrame, unique: DataFrame) -> DataFrame:
    """One row: input, unique, duplicates and undated, in one aggregate over both frames."""
    ok = usable(F.col("url"), F.col("company"), F.col("title"))
    parts = corpus.select(F.lit(1).alias("i"), ok.cast("int").alias("u"), F.lit(0).alias("k"),
                          F.lit(0).alias("n")).unionByName(
        unique.select(F.lit(0).alias("i"), F.lit(0).alias("u"), F.lit(1).alias("k"),
                      posted_at(F.col("date_posted")).isNull().cast("int").alias("n")))
    total = {c: F.coalesce(F.sum(c), F.lit(0)) for c in "iukn"}
    return parts.agg(total["i"].alias("total_input"), total["k"].alias("unique"),
                     (total["u"] - total["k"]).alias("dupes_skipped"),
                     total["n"].alias("undated"))


def unique_per_source(unique: DataFrame, source: str = "portal") -> DataFrame:
    """How many rows each source keeps after the dedup, most first."""
    return (unique.groupBy(F.coalesce(F.col(source), F.lit("unknown")).alias("source"))
            .agg(F.count("*").alias("unique")).orderBy(F.desc("unique"), "source"))


def newest_first(date: Column, key: Column) -> list:
    """Sort columns: newest first, undated last, key as tie-break."""
    return [F.desc_nulls_last(posted_at(date)), F.asc(key)]


def migrated_store(store: DataFrame) -> DataFrame:
    """Old store keys in canonical form; the URL a key carried is kept as a column."""
    stored = strip(text_or_empty("url"))
    link = (F.when(stored != "", stored)
            .when(F.col("key").rlike("^https?://"), F.col("key")).otherwise(""))
    named = dedup_key(F.lit(""), F.col("company"), F.col("title"))
    new_key = (F.when(link != "", dedup_key(link, F.lit(None), F.lit(None)))
               .when(F.col("key").rlike("^(?:url|ct):"), F.col("key")).otherwise(named))
    return store.withColumns({"new_key": new_key, "url": F.when(link != "", link)
                              .otherwise(F.col("url"))})


def key_collisions(migrated: DataFrame) -> DataFrame:
    """New keys that several old keys map to. Must be empty before a migrated store is written."""
    return (migrated.groupBy("new_key").agg(F.count("*").alias("n"),
                                            F.min("key").alias("first_key"),
                                            F.max("key").alias("last_key")).filter("n > 1"))


def migrate_or_fail(store: DataFrame) -> DataFrame:
    """The migrated store; raises when two keys would merge."""
    out = migrated_store(store)
    clash = key_collisions(out).limit(1).collect()
    if clash:
        row = clash[0]
        raise ValueError(f"key collision: {row.first_key!r} and {row.last_key!r} both become "
                         f"{row.new_key!r}")
    return out.drop("key").withColumnRenamed("new_key", "key")


def merge_lists(existing: DataFrame, new: DataFrame, key: str = "key",
                order: str = "pos") -> DataFrame:
    """Existing rows first, then new rows whose key is unseen; rows without a key always stay.

    Rows without a key skip the grouping, so they do not pile up in one task.
    """
    has_key = F.coalesce(F.col(key), F.lit("")) != ""
    known = existing.filter(has_key).select(key).distinct()
    fresh = first_per_key(new.filter(has_key).join(known, key, "left_anti"), key, [order])
    parts = [existing, fresh, new.filter(~has_key)]
    out = parts[0].withColumn("part", F.lit(0))
    for p in parts[1:]:
        out = out.unionByName(p.withColumn("part", F.lit(1)), allowMissingColumns=True)
    return out


def first_sighting(cards: DataFrame, job: str = "job_id", order=("msg_order", "pos")) -> DataFrame:
    """The card of the earliest message for every job id."""
    return first_per_key(cards, job, order)


def duplicate_names(table: DataFrame, name: str = "company") -> DataFrame:
    """Case-folded names that occur more than once."""
    return (table.groupBy(F.lower(name).alias("name_key"))
            .agg(F.count("*").alias("n")).filter("n > 1"))
