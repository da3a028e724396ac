"""Fetched detail: merge into records, quality check, outcome counts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import fixed_values as V
from siftline.functions.keys import BOARD_NAME, posting_id_of_record
from siftline.functions.text import ELLIPSIS, WHITESPACE, strip, text_or_empty

# Page furniture that shows a capture is not a posting.
PAGE_CHROME = ("Skip to main content", "Skip to primary content", "0 notifications")


def merge_detail(records: DataFrame, details: DataFrame, key: str = "dedup_key") -> DataFrame:
    """Merge detail by key; a detail shorter than the snippet is refused and flagged.

    ``details`` has the key, ``failed``, ``description`` and any of the detail fields.
    ``taken_chars`` counts what an accepted detail gives up to the cap, the mark of a cut included;
    white space that the cut leaves at the end is counted but not kept.
    """
    fields = [f for f in V.DETAIL_FIELDS if f in details.columns]
    d = details.select(key, F.struct("failed", "description", *fields).alias("d"))
    out = records.join(d, key, "left")
    snippet = strip(text_or_empty("description_snippet"))
    snippet = F.when(snippet.endswith("..."), F.rtrim(F.regexp_replace(snippet, r"\.\.\.$", ""))
                     ).otherwise(snippet)
    text = strip(text_or_empty(F.col("d")["description"]))
    fetched = F.col("d").isNotNull() & ~F.coalesce(F.col("d")["failed"], F.lit(False))
    on_board = (posting_id_of_record(F.col(key), F.col("url")).isNotNull()
                | text_or_empty("url").contains(f"{BOARD_NAME}.com"))
    out = out.withColumns({"_text": text, "_fetched": fetched,
                           "_cap": F.when(on_board, V.DETAIL_CAP_HOST)
                           .otherwise(V.DETAIL_CAP_OTHER),
                           "_degraded": fetched & (text != "")
                           & (F.length(text) < F.length(snippet))})
    accepted = F.col("_fetched") & (F.col("_text") != "") & ~F.col("_degraded")
    cut = accepted & (F.length("_text") > F.col("_cap"))
    body = F.when(cut, F.concat(F.rtrim(F.substring("_text", F.lit(1), F.col("_cap"))),
                                F.lit(ELLIPSIS))).when(accepted, F.col("_text"))
    outcome = (F.when(F.col("d").isNull(), F.lit(None).cast("string"))
               .when(~F.col("_fetched"), "failed").when(accepted, "enriched")
               .when(F.col("_degraded"), "degraded").otherwise("empty"))
    before = F.col("description") if "description" in records.columns else F.lit(None)
    had_cut = (F.col("description_truncated") if "description_truncated" in records.columns
               else F.lit(None).cast("boolean"))
    extra = {f: F.coalesce(
        F.when(F.col("_fetched"), F.nullif(strip(F.col("d")[f]), F.lit(""))),
        F.col(f) if f in records.columns else F.lit(None).cast("string")) for f in fields}
    return (out.withColumns({
        "outcome": outcome, "description": F.coalesce(body, before),
        "description_truncated": F.when(cut, True).otherwise(had_cut),
        "description_degraded": F.coalesce(F.col("_degraded"), F.lit(False)),
        "enriched": F.coalesce(accepted, F.lit(False)),
        "taken_chars": F.when(accepted, F.least(F.length("_text"), F.col("_cap") + 1)), **extra})
        .drop("d", "_text", "_fetched", "_cap", "_degraded"))


def outcome_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(*[F.count_if(F.col("outcome") == o).alias(o)
                        for o in ("enriched", "empty", "failed", "degraded")])


def detail_quality(df: DataFrame, text: str, keywords=(), min_chars: int = V.DETAIL_MIN_CHARS,
                   chrome=PAGE_CHROME) -> DataFrame:
    """Flag captures that are too short, hold page furniture or miss expected keywords."""
    body = text_or_empty(text)
    low = F.lower(body)
    missing = F.array_compact(F.array(*[F.when(~low.contains(k.lower()), k) for k in keywords])
                              ) if keywords else F.array().cast("array<string>")
    found = F.array_compact(F.array(*[F.when(body.contains(m), m) for m in chrome]))
    trimmed = F.btrim(body, F.lit(WHITESPACE))
    return df.withColumns({
        "chars": F.length(body),
        "words": F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"(?U)\s+"))),
        "chrome_found": found, "missing_keywords": missing,
        "ok": (F.length(body) >= min_chars) & (F.size(found) == 0) & (F.size(missing) == 0)})
