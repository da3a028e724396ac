"""Report aggregates over annotated records, trackers and salary tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import fixed_values as V
from siftline.functions.text import text_or_empty
from siftline.operators.skew import running_sum

# Open and final states of a tracked application.
FINAL_STATUSES = ("hired", "offer_declined", "rejected", "no_response", "withdrawn")
KNOWN_OPEN = ("drafted", "applied", "in_progress", "interview", "offer")


def source_counts(df: DataFrame, source: str = "portal") -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n")).orderBy(F.desc("n"), source)


def reason_histogram(deferred: DataFrame) -> DataFrame:
    reason = F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit("no reason recorded"))
    return (deferred.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "reason"))


def alert_counts_by_name(cards: DataFrame, pos: str = "pos") -> DataFrame:
    """Cards per alert with the first known track; gaps in the configuration stay visible."""
    name = F.coalesce(F.nullif(F.col("alert_name"), F.lit("")), F.lit("(unattributed)"))
    out = cards.groupBy(name.alias("alert_name")).agg(
        F.count("*").alias("n"),
        F.min_by("alert_track", F.when(F.col("alert_track").isNotNull(), F.col(pos)))
        .alias("track"))
    return out.withColumn("unmapped", F.col("track").isNull()
                          & (F.col("alert_name") != "(unattributed)"))


def cut_profile(rows: DataFrame, score: str = "score", order=("pos",)) -> DataFrame:
    """Min, max, upper median and the best row of a cut, without ordering rows in one task.

    Equal scores fold before any shuffle. Scores may still be as many as rows, so the median is
    selected exactly by rank: running counts over range slices, then the first score whose count
    passes the half. Rows without a score do not count; without any the row holds nulls.
    """
    hist = rows.filter(F.col(score).isNotNull()).groupBy(score).agg(
        F.count("*").alias("c"), F.min_by(F.struct("title", "company"), F.struct(*order))
        .alias("first_row"))
    running = running_sum(hist, [F.asc(score)], F.col("c"), "upto")
    total = running.agg(F.max("upto").alias("total"))
    half = F.floor(total.scalar() / 2)
    return running.agg(
        F.min(score).alias("min"), F.max(score).alias("max"),
        F.min(F.when(F.col("upto") > half, F.col(score))).alias("median"),
        F.max_by("first_row", score).alias("best")).select(
        "min", "max", "median", F.col("best.title").alias("best_title"),
        F.col("best.company").alias("best_company"))


def funnel_summary(annotated: DataFrame, budget: int, alert_budget: int) -> DataFrame:
    """The whole funnel in one aggregate; ``reason`` and ``pick`` tell each row's last stage."""
    c, n = F.col, F.count_if
    reason = text_or_empty("reason")
    return annotated.agg(
        F.count("*").alias("total"), n(c("is_repeat")).alias("repeats"),
        n(reason.startswith("hard gate")).alias("gate_failed"),
        n(c("gates.overall") == V.UNKNOWN).alias("gate_unknown"),
        n(reason.contains("match no scoring category")).alias("no_signal"),
        n(reason.startswith("near-duplicate")).alias("near_duplicates"),
        n(c("pick") == "alert").alias("alert_selected"),
        n(reason.startswith("alert-matched but over")).alias("alert_over_budget"),
        n(c("pick") == "floor").alias("floor_slots"),
        n(c("pick") == "score").alias("score_slots"),
        n(c("selected")).alias("selected"), n(~c("selected")).alias("deferred"),
        F.lit(budget).alias("budget"), F.lit(alert_budget).alias("alert_budget"))


def verification(selected: DataFrame) -> DataFrame:
    overall = F.col("gates.overall")
    return selected.agg(F.count_if(overall == V.PASS).alias("verified"),
                        F.count_if(overall == V.UNKNOWN).alias("unverified"),
                        F.count("*").alias("selected"))


def against_baseline(index: Column, baseline) -> Column:
    """Percent above a baseline as text; blank for baseline 0 and for text values."""
    value = index.try_cast("double")
    pct = F.try_divide((value - baseline) * 100, F.lit(float(baseline)))
    return F.when(value.isNull() | F.lit(baseline == 0), "").otherwise(
        F.concat(F.when(pct >= 0, "+").otherwise(""), F.format_string("%.1f", pct), F.lit("%")))


def salary_table_issues(table: DataFrame, pos: str = "pos") -> DataFrame:
    """Errors and warnings of a salary table, one row per finding.

    ``categories`` maps a name to raw ``count`` and ``index`` texts. Each rule is one filtered
    projection; later copies of a company name are warnings.
    """
    number = r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"
    blank = table.filter(F.coalesce(F.trim("company"), F.lit("")) == "").select(
        pos, F.lit("error").alias("level"),
        F.lit("company must be a non-empty string").alias("issue"))
    cells = table.select(pos, F.explode("categories").alias("category", "cell"))
    counts = cells.filter(F.col("cell.count").isNotNull() & ~F.col("cell.count").rlike(number)
                          ).select(pos, F.lit("error").alias("level"), F.concat(
                              F.lit("count must be a number: "), "category").alias("issue"))
    empty = cells.filter(F.col("cell").isNull()).select(
        pos, F.lit("error").alias("level"),
        F.concat(F.lit("category must be an object: "), "category").alias("issue"))
    first = table.groupBy(F.lower("company").alias("k")).agg(F.min(pos).alias("first"),
                                                             F.count("*").alias("n"))
    copies = (table.withColumn("k", F.lower("company")).join(first.filter("n > 1"), "k")
              .filter(F.col(pos) != F.col("first")).filter(F.trim("company") != "")
              .select(pos, F.lit("warning").alias("level"),
                      F.concat(F.lit("Duplicate company name "), "company").alias("issue")))
    return blank.unionByName(counts).unionByName(empty).unionByName(copies)


def canonical_status(status: Column) -> Column:
    """``no response`` and ``no_response`` are one status."""
    return F.regexp_replace(F.lower(F.trim(status)), r"\s+", "_")


def status_bucket(status: Column) -> Column:
    """Open is everything that is not final; unknown spellings fall in a named catch-all."""
    s = canonical_status(status)
    return (F.when(s.isin("hired"), "Hired").when(s == "offer_declined", "Offer declined")
            .when(s == "no_response", "No response").when(s.isin("rejected", "withdrawn"),
                                                           "Rejected/Closed")
            .when(s.isin(*KNOWN_OPEN), "Open").otherwise("Rejected/Closed"))


def status_counts(tracker: DataFrame) -> DataFrame:
    s = canonical_status(F.col("status"))
    return (tracker.groupBy(s.alias("status"), status_bucket(F.col("status")).alias("bucket"),
                            (~s.isin(*FINAL_STATUSES)).alias("open"),
                            (~s.isin(*FINAL_STATUSES, *KNOWN_OPEN)).alias("unrecognised"))
            .agg(F.count("*").alias("n")))


def stale_applications(activity: DataFrame, today, key: str, quiet_days: int = 10,
                       alarm_days: int = 30, max_followups: int = 2) -> DataFrame:
    """Open applications that went quiet.

    ``activity(key, status, date, followup)`` holds one row per entry; the newest decides.
    """
    last = activity.groupBy(key).agg(
        F.max("date").alias("last_date"), F.max_by("status", F.struct("date", "status"))
        .alias("status"), F.sum(F.col("followup").cast("int")).alias("followups"))
    quiet = F.datediff(F.lit(today).cast("date"), F.col("last_date"))
    return (last.withColumn("quiet_days", quiet)
            .filter((F.col("quiet_days") >= quiet_days) & (F.col("followups") < max_followups)
                    & ~canonical_status(F.col("status")).isin(*FINAL_STATUSES))
            .withColumn("alarm", F.col("quiet_days") >= alarm_days))


def tracker_dashboard(tracker: DataFrame) -> DataFrame:
    """Counts by status bucket, sector and channel in one grouping-sets pass."""
    t = tracker.withColumn("bucket", status_bucket(F.col("status")))
    sets = t.groupingSets([[F.col("bucket")], [F.col("sector")], [F.col("channel")]],
                          F.col("bucket"), F.col("sector"), F.col("channel")).agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"))
    # Grouping bits: bucket 4, sector 2, channel 1; a cleared bit is the grouped column.
    dim = F.when(F.col("g") == 3, "bucket").when(F.col("g") == 5, "sector").otherwise("channel")
    value = F.when(F.col("g") == 3, F.col("bucket")).when(F.col("g") == 5, F.col("sector")
                                                          ).otherwise(F.col("channel"))
    return sets.select(dim.alias("dimension"), value.alias("value"), "n")


def stage_funnel(tracker: DataFrame, stages) -> DataFrame:
    """How many applications reached each stage; a later stage implies the earlier ones."""
    level = F.array_position(F.array(*[F.lit(s) for s in stages]),
                             canonical_status(F.col("status")))
    return tracker.agg(*[F.count_if(level >= i).alias(s)
                         for i, s in enumerate(stages, start=1)])


def skill_gaps(tracked: DataFrame, ranked: DataFrame, min_score: float = 45) -> DataFrame:
    """Gap heatmap: one row per case-folded company and role, gaps weighted by missing fit.

    Both sides have ``company, role, score, gaps, recorded``; recorded gaps beat inferred ones.
    The per-case choice is an associative aggregate, so copies fold before the shuffle.
    """
    both = (tracked.withColumn("source", F.lit("tracked")).unionByName(
        ranked.withColumn("source", F.lit("ranked")))
        .withColumns({"c": F.lower(F.trim("company")), "r": F.lower(F.trim("role"))}))
    rank = F.struct(F.col("recorded").cast("int").alias("rec"),
                    (F.col("source") == "tracked").cast("int").alias("t"),
                    F.col("score").alias("s"), F.array_join("gaps", "|").alias("g"))
    one = both.groupBy("c", "r").agg(F.max_by(F.struct("score", "gaps", "source", "recorded"),
                                              rank).alias("x"))
    rows = one.filter(F.col("x.score") >= min_score).select(
        F.explode(F.array_distinct("x.gaps")).alias("gap"), F.col("x.score").alias("score"),
        F.col("x.source").alias("source"), F.col("x.recorded").alias("recorded"))
    weight = F.sum((F.lit(100) - F.col("score")) / 100)
    return (rows.groupBy("gap").agg(
        F.round(weight, 4).alias("weight"), F.count_if(F.col("source") == "tracked")
        .alias("tracked"), F.count_if(F.col("source") == "ranked").alias("ranked"),
        F.count_if("recorded").alias("recorded_gaps"),
        F.count_if(~F.col("recorded")).alias("inferred"))
        .orderBy(F.desc("weight"), "gap"))


def calibration(rows: DataFrame, anchors: dict) -> DataFrame:
    """Old and new formula side by side per row.

    Needs ``title, asks_years, label, technical, behavioral, manages_people``.
    """
    from siftline.functions import scores as S

    out = rows.withColumns({
        "old_experience": S.old_experience_score(F.col("label")),
        "new_experience": S.new_experience_score(F.col("asks_years"), F.col("manages_people")),
        "old_career": S.old_career_score(F.col("title")),
        "_new": S.new_career_score(F.col("title"), anchors)})
    out = out.withColumns({"new_career": F.col("_new.score"),
                           "matched_track": F.col("_new.track")}).drop("_new")
    out = out.withColumns({
        "old_overall": S.old_overall(F.col("technical"), F.col("old_experience"),
                                     F.col("old_career")),
        "new_overall": (F.col("technical") * 0.30 + F.col("new_experience") * 0.25
                        + F.col("behavioral") * 0.15 + F.col("new_career") * 0.30)})
    return out.withColumn("delta", F.col("new_overall") - F.col("old_overall"))


def calibration_by_track(compared: DataFrame) -> DataFrame:
    return compared.groupBy("matched_track").agg(
        F.count("*").alias("n"), F.round(F.avg("delta"), 4).alias("mean_delta"),
        F.round(F.min("delta"), 4).alias("min_delta"),
        F.round(F.max("delta"), 4).alias("max_delta"))


def source_warnings(counts: DataFrame, skip: DataFrame = None) -> DataFrame:
    """Sources whose queries all returned nothing; skipped sources do not count.

    ``counts(source, query, n)``.
    """
    c = counts if skip is None else counts.join(skip.select("source"), "source", "left_anti")
    return (c.groupBy("source").agg(F.sum("n").alias("total"), F.count("*").alias("queries"))
            .filter("total = 0"))


def _kind(value: Column) -> Column:
    """The JSON type of a variant: object, array, text, number, boolean or none."""
    name = F.schema_of_variant(value)
    return (F.when(value.isNull() | (name == "VOID"), "none")
            .when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array")
            .when(name == "STRING", "text").when(name == "BOOLEAN", "boolean").otherwise("number"))


def _part(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def raw_table_issues(files: DataFrame, file: str = "file", text: str = "value") -> DataFrame:
    """(file, entry, level, issue): what is wrong with salary tables kept as JSON, one row a finding.

    Types are checked as they stand in the file, before any schema is forced on it: the table, its
    metadata and list, then each entry's company, city, categories, cells, counts and indexes.
    Entries are numbered from 1; findings about a whole file have none. Booleans pass as numbers.
    """
    doc = files.select(F.col(file).alias("file"), F.try_parse_json(text).alias("doc"))
    doc = doc.withColumn("list", _part(F.col("doc"), "$.companies"))
    is_object, is_list = _kind(F.col("doc")) == "object", _kind(F.col("list")) == "array"
    whole = F.array_compact(F.array(
        F.when(~is_object, "top-level JSON value must be an object"),
        F.when(is_object & ~_kind(_part(F.col("doc"), "$.metadata")).isin("object", "none"),
               "'metadata' must be an object when provided"),
        F.when(is_object & ~is_list, "'companies' must be a list")))
    found = doc.select("file", F.lit(None).cast("int").alias("entry"), F.explode(whole).alias("issue"))
    entries = (doc.filter(is_object & is_list).select("file", F.posexplode(F.try_variant_get(
        F.col("list"), "$", "array<variant>")).alias("k", "e"))
        .select("file", (F.col("k") + 1).alias("entry"), "e"))
    e, fine = F.col("e"), _kind(F.col("e")) == "object"
    name, groups = _part(e, "$.company"), _part(e, "$.categories")
    shown = F.coalesce(F.try_variant_get(e, "$.company", "string"), F.lit(""))
    issues = F.array_compact(F.array(
        F.when(~fine, "must be an object"),
        F.when(fine & ((_kind(name) != "text") | (F.trim(shown) == "")),
               "company must be a non-empty string"),
        F.when(fine & ~_kind(_part(e, "$.city")).isin("text", "none"),
               "city must be a string when provided"),
        F.when(fine & ~_kind(groups).isin("object", "none"),
               "categories must be an object when provided")))
    found = found.unionByName(entries.select("file", "entry", F.explode(issues).alias("issue")))
    cells = entries.filter(_kind(groups) == "object").select("file", "entry", F.explode(
        F.try_variant_get(e, "$.categories", "map<string,variant>")).alias("label", "cell"))
    cell, label = F.col("cell"), F.col("label")
    is_cell = _kind(cell) == "object"
    wrong = F.array_compact(F.array(
        F.when(~is_cell, F.concat(label, F.lit(" must be an object with 'count' and/or 'index'"))),
        F.when(is_cell & ~_kind(_part(cell, "$.count")).isin("number", "boolean", "none"),
               F.concat(label, F.lit(".count must be a number"))),
        F.when(is_cell & ~_kind(_part(cell, "$.index")).isin("number", "boolean", "text", "none"),
               F.concat(label, F.lit(".index must be a number or string")))))
    found = found.unionByName(cells.select("file", "entry", F.explode(wrong).alias("issue")))
    named = entries.filter(fine & (_kind(name) == "text")).select(
        "file", "entry", shown.alias("name")).filter(F.trim("name") != "").withColumn(
        "k", F.lower("name"))
    first = named.groupBy("file", "k").agg(F.min("entry").alias("first"))
    again = named.join(first, ["file", "k"]).filter(F.col("entry") > F.col("first")).select(
        "file", "entry", F.concat(F.lit("Duplicate company name '"), "name", F.lit("'")).alias("issue"))
    return found.withColumn("level", F.lit("error")).unionByName(
        again.withColumn("level", F.lit("warning")))
