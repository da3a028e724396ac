"""Portal files: many JSON envelopes to one table of raw rows."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "meta STRING, results ARRAY<STRING>, _corrupt STRING"
ROW = ("title STRING, company STRING, url STRING, location STRING, date STRING, "
       "description STRING, work_mode STRING, alert_name STRING, alert_track STRING")

# Path parts that name a source, in test order.
PATH_SOURCES = (("linkedin-alert", "linkedin-alert"), ("linkedin_alert", "linkedin-alert"),
                ("linkedin", "linkedin-search"), ("freehire", "freehire-search"),
                ("arbeitnow", "arbeitnow-search"), ("weworkremotely", "weworkremotely-search"),
                ("wwr", "weworkremotely-search"))
# Keys of the first result that name a source, in test order.
CONTENT_SOURCES = (("work_mode", "freehire-search"), ("remote", "arbeitnow-search"),
                   ("category", "weworkremotely-search"), ("companyUrl", "linkedin-search"))


def source_of(path: Column, meta: Column, first_result: Column) -> Column:
    """Source of a file: path tests first, then which keys are present, else unknown.

    ``meta`` and ``first_result`` are raw JSON, so a present null key differs from an absent one.
    """
    low = F.lower(path)
    out = F.when(F.lit(False), "")
    for part, name in PATH_SOURCES:
        out = out.when(low.contains(part), name)

    def has(raw, key):
        return F.coalesce(F.array_contains(F.json_object_keys(raw), key), F.lit(False))

    out = out.when(has(meta, "scan_capped"), "arbeitnow-search")
    for key, name in CONTENT_SOURCES:
        out = out.when(has(first_result, key), name)
    return out.otherwise("unknown")


def read_envelopes(spark: SparkSession, paths) -> DataFrame:
    """One row per file: path, raw meta, raw results, and the corrupt text if unreadable.

    Missing files are skipped (``ignoreMissingFiles`` covers files that vanish, globs the rest).
    """
    df = (spark.read.schema(ENVELOPE).option("multiLine", True).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt").option("ignoreMissingFiles", True)
          .json(paths))
    return df.withColumn("path", F.col("_metadata.file_path"))


def envelope_warnings(envelopes: DataFrame) -> DataFrame:
    """Files that could not be parsed."""
    # Spark refuses to read the corrupt column alone; such a row has no results either. A plain
    # null test would be pushed into the reader, which then leaves a file at its results, before
    # it comes to the broken end.
    bad = F.col("_corrupt").isNotNull() & (F.coalesce(F.size("results"), F.lit(-1)) < 0)
    return envelopes.filter(bad).select("path")


def portal_rows(envelopes: DataFrame) -> DataFrame:
    """Raw rows of all readable files with source, file order and row order.

    Files rank by path, so an alert file sorts ahead of the searches it shares postings with. The
    rank is over files, not rows.
    """
    good = envelopes.filter(F.col("_corrupt").isNull())
    good = good.withColumn("portal", source_of(F.col("path"), F.col("meta"),
                                               F.get("results", F.lit(0))))
    rows = good.select("path", "portal", F.posexplode("results").alias("row_pos", "raw"))
    parsed = F.from_json("raw", ROW)
    return rows.select(F.col("path").alias("file_rank"), "row_pos", "portal",
                       F.col("raw").rlike(r"^\s*\{").alias("is_object"), parsed.alias("r")
                       ).select("file_rank", "row_pos", "portal", "is_object", "r.*"
                                ).withColumnRenamed("date", "date_posted")


def malformed_rows(rows: DataFrame) -> DataFrame:
    """Rows per source that are not objects."""
    return rows.groupBy("portal").agg(F.count_if(~F.col("is_object")).alias("malformed"))


def skip_sources(rows: DataFrame, skip: DataFrame) -> DataFrame:
    """Rows of all sources but the skipped ones."""
    return rows.join(skip.select("portal").distinct(), "portal", "left_anti")


def unite(*frames: DataFrame) -> DataFrame:
    """One corpus of all sources."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
