"""Keyed JSON stores, the tracker file and result sinks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.fixed_values import TRACKER_COLUMNS
from siftline.operators.skew import running_sum

SEEN_ENTRY = ("status STRING, rank_score DOUBLE, rank_verdict STRING, rank_date STRING, "
              "location STRING, portal STRING, track STRING, alert_matched BOOLEAN, url STRING")
ALERT_ENTRY = ("first_alerted STRING, last_seen STRING, alert_name STRING, track STRING, "
               "title STRING, company STRING, source STRING")


def store_rows(texts: DataFrame, entry: str, text: str = "value", under: str = None) -> DataFrame:
    """Entries of JSON map texts as rows (key, entry fields...).

    A malformed text yields no rows. Entries that are no objects become null fields: kept, so they
    can be counted, and never live.
    """
    raw = F.get_json_object(text, f"$.{under}") if under else F.col(text)
    pairs = texts.select(F.explode(F.from_json(raw, "MAP<STRING, STRING>")).alias("key", "raw"))
    return pairs.select("key", F.from_json("raw", entry).alias("e")).select("key", "e.*")


def read_store(spark: SparkSession, path: str, entry: str, under: str = None) -> DataFrame:
    """A store kept as one JSON object per file."""
    return store_rows(spark.read.text(path, wholetext=True), entry, "value", under)


def read_big_store(spark: SparkSession, path: str, entry: str, under: str = None) -> DataFrame:
    """A store of one JSON object whose entries start on lines of their own, read by many tasks.

    Lines are dealt to tasks as the file system splits the file. A line with a key at the entries'
    depth of indentation opens an entry: two blanks, or four inside the object ``under``. Running
    counts over slices of the line order number the entries, whose lines then come together; so
    no task holds the file. What a writer without line breaks has made needs ``read_store``. An
    entry that is not valid JSON has null fields, as one that is no object has.
    """
    indent = 4 if under else 2
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), "value")
    depth = F.length(F.regexp_extract("value", "^ *", 0))
    # Sections of the file: what stands at the outer depth opens and closes ``under``.
    outer = F.regexp_extract("value", r'^  "((?:[^"\\]|\\.)*)": *\{ *$', 1)
    opens = (depth == indent) & F.col("value").rlike(r'^ *"(?:[^"\\]|\\.)*" *:')
    order = [F.asc("file"), F.asc("start"), F.asc("at")]
    counted = running_sum(lines.withColumn("opens", opens), order, F.col("opens").cast("int"), "entry")
    if under:
        section = (depth == 2) & ~F.col("value").rlike(r"^ *[}\]]")
        counted = running_sum(counted.withColumn("section", section), order,
                              F.col("section").cast("int"), "part")
        wanted = counted.filter(F.col("section") & (outer == under)).select("file", "part")
        counted = counted.join(F.broadcast(wanted.distinct()), ["file", "part"], "left_semi")
    body = counted.filter((F.col("entry") > 0) & (depth >= indent)).groupBy("file", "entry").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "at", "value"))),
                                 lambda x: x["value"]), "\n").alias("text"))
    text = F.regexp_replace("text", r",\s*$", "")
    pairs = body.filter(text.rlike(r'^ *"')).select(F.explode_outer(F.from_json(
        F.concat(F.lit("{"), text, F.lit("}")), "MAP<STRING, STRING>")).alias("key", "raw"))
    return (pairs.filter(F.col("key").isNotNull())
            .select("key", F.from_json("raw", entry).alias("e")).select("key", "e.*"))


def read_tracker(spark: SparkSession, path: str) -> DataFrame:
    """The tracker file; all columns are text."""
    schema = ", ".join(f"{c} STRING" for c in TRACKER_COLUMNS)
    return spark.read.schema(schema).option("header", True).csv(path)


def tracker_rows(outcomes: DataFrame, today: str) -> DataFrame:
    """Tracker rows for drafted records; columns in file order."""
    known = {"date": F.lit(today), "company": F.col("company"), "role": F.col("title"),
             "channel": F.lit("select"), "status": F.lit("drafted"),
             "fit_rating": F.col("score").cast("string"), "cv_file": F.col("cv_file"),
             "cover_letter_file": F.col("cover_letter_file"), "source": F.col("url")}
    return outcomes.select(*[known.get(c, F.lit("")).alias(c) for c in TRACKER_COLUMNS])


def append_tracker(rows: DataFrame, path: str) -> None:
    """Append rows; each part file carries the header, the reader sees it once per file."""
    rows.select(*TRACKER_COLUMNS).write.mode("append").option("header", True).csv(path)


def write_output(df: DataFrame, path: str, partition_by=()) -> None:
    """Replace one output whole; the committer makes the swap of a finished job visible."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_outputs(root: str, **outputs: DataFrame) -> None:
    """Corpus, rankset, deferred, not-drafted and summary, each in its own folder."""
    for name, df in outputs.items():
        write_output(df, f"{root}/{name}")
