"""Record keys, dates and small scalar normalisers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import WHITESPACE, clip, strip, text_or_empty

# The job board whose postings carry a numeric id, and the shape of its URLs.
BOARD_NAME = "linkedin"
BOARD_URL = (r"(?i)^https?://(?:[a-z0-9-]+\.)*linkedin\.com/(?:comm/)?jobs/view/(?:.*?-)?"
             r"(\d{6,})(?:[/?#]|$)")
BOARD_KEY = r"^url:linkedin:(\d{6,})$"
TRACKER_PARAMS = ("url", "u", "target")
ISO_STAMP = (r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:\.\d{3}(?:\d{3})?)?)?)?"
             r"(?:[Zz]|[+-]\d{2}:\d{2}(?::\d{2})?)?)?$")
SECRET_TOKEN = r"(?<!\d)\d{5,}:[A-Za-z0-9_-]{20,}"


def posting_id(url: Column) -> Column:
    """Numeric posting id of a board URL, or null."""
    return F.nullif(F.regexp_extract(strip(text_or_empty(url)), BOARD_URL, 1), F.lit(""))


def posting_id_of_record(key: Column, url: Column) -> Column:
    """Posting id taken from the dedup key, else from the URL."""
    return F.coalesce(
        F.nullif(F.regexp_extract(strip(text_or_empty(key)), BOARD_KEY, 1), F.lit("")),
        posting_id(url))


def dedup_key(url: Column, company: Column, title: Column) -> Column:
    """Canonical key: board id, else URL without its query, else company and title."""
    link = strip(text_or_empty(url))
    base = F.regexp_replace(F.split_part(link, F.lit("?"), F.lit(1)), "/+$", "")
    named = F.concat(F.lit("ct:"), strip(F.lower(text_or_empty(company))), F.lit("|"),
                     strip(F.lower(text_or_empty(title))))
    by_id = F.concat(F.lit(f"url:{BOARD_NAME}:"), posting_id(url))
    return F.when(link == "", named).otherwise(
        F.coalesce(by_id, F.concat(F.lit("url:"), base)))


def unwrapped_posting_id(href: Column) -> Column:
    """Posting id of a link, looking one level into click-tracker parameters."""
    link = strip(text_or_empty(href))
    query = F.try_parse_url(F.replace(link, F.lit(" "), F.lit("%20")), F.lit("QUERY"))
    tries = [posting_id(link)]
    for name in TRACKER_PARAMS:
        value = F.nullif(F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1), F.lit(""))
        once = F.try_url_decode(value)
        tries += [posting_id(once), posting_id(F.try_url_decode(once))]
    return F.coalesce(*tries)


def canonical_posting_url(job_id: Column) -> Column:
    return F.concat(F.lit(f"https://www.{BOARD_NAME}.com/jobs/view/"), job_id)


def safe_url(url: Column) -> Column:
    """The URL if it is http(s) with a host, else null."""
    ok = (F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https")
          & (F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")) != ""))
    return F.when(ok, url)


def posted_at(value: Column) -> Column:
    """ISO date or timestamp; naive values are UTC, anything else is null (sorts last)."""
    stamp = strip(value)
    return F.when(stamp.rlike(ISO_STAMP), F.try_to_timestamp(F.upper(stamp)))


def recency_number(value: Column) -> Column:
    """The first 14 digits as a number, right-padded with zeros; 0 without digits."""
    digits = F.regexp_replace(text_or_empty(value), r"\D", "")
    return F.when(digits == "", F.lit(0).cast("bigint")).otherwise(
        F.rpad(F.substring(digits, 1, 14), 14, "0").cast("bigint"))


def ymd(value: Column) -> Column:
    """The first eight digits as a date, null when they are none."""
    digits = F.regexp_replace(text_or_empty(value), r"\D", "")
    return F.when((F.length(digits) >= 8) & (F.substring(digits, 1, 4) != "0000"),
                  F.try_to_date(F.substring(digits, 1, 8), "yyyyMMdd"))


def iso_date(value: Column) -> Column:
    """A strict ``yyyy-MM-dd`` date, null otherwise."""
    return F.when(value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(value, "yyyy-M-d"))


def age_days(posted: Column, today: Column) -> Column:
    """Whole days since a date, null for unreadable and future dates."""
    when = F.try_to_date(F.substring(text_or_empty(posted), 1, 10), "yyyy-MM-dd")
    days = F.datediff(today, when)
    return F.when(days >= 0, days)


def slug(c: Column) -> Column:
    cut = F.btrim(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(cut == "", "q").otherwise(cut)


def caption_parts(c: Column) -> Column:
    """``company · location (Mode)`` as a struct; ``Onsite`` reads ``On-site``."""
    text = text_or_empty(c)
    at = F.locate("·", text)
    company = F.when(at == 0, text).otherwise(F.substring(text, F.lit(1), at - 1))
    rest = strip(F.when(at == 0, F.lit("")).otherwise(
        F.substring(text, at + 1, F.length(text))))
    tail = r"(?i)\s*\((On-site|Onsite|Remote|Hybrid)\)\s*$"
    mode = F.nullif(F.regexp_extract(rest, tail, 1), F.lit(""))
    place = F.nullif(strip(F.regexp_replace(rest, tail, "")), F.lit(""))
    return F.struct(strip(company).alias("company"), place.alias("location"),
                    F.when(F.lower(mode) == "onsite", "On-site").otherwise(mode)
                    .alias("work_mode"))


def redact(c: Column, size: int = 120) -> Column:
    """One line without secret-shaped tokens, clipped."""
    flat = clip(c, 2147483647)
    clean = F.regexp_replace(flat, SECRET_TOKEN, "<redacted-token>")
    return F.when(F.length(clean) <= size, clean).otherwise(
        F.concat(F.substring(clean, 1, max(0, size - 1)), F.lit("…")))


def localised_number(c: Column) -> Column:
    """Number in local notation; ``1,234`` alone is ambiguous and null."""
    text = F.replace(F.replace(F.btrim(c, F.lit(WHITESPACE)), F.lit(" "), F.lit(" ")),
                     F.lit(" "), F.lit(""))
    comma, dot = text.contains(","), text.contains(".")
    plain = (F.when(comma & dot, F.replace(F.replace(text, F.lit("."), F.lit("")),
                                           F.lit(","), F.lit(".")))
             .when(comma & text.rlike(r"^[+-]?\d+,\d{3}$"), F.lit(None))
             .when(comma, F.replace(text, F.lit(","), F.lit(".")))
             .otherwise(text))
    return F.when(plain.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"),
                  plain.try_cast("double"))


def robots_regex(pattern: Column) -> Column:
    """Rule pattern as an anchored regex: ``*`` wild, ``$`` end, percent-decoded."""
    decoded = F.coalesce(F.try_url_decode(F.replace(pattern, F.lit("+"), F.lit("%2B"))), pattern)
    quoted = F.regexp_replace(decoded, r"([\\.\[\]{}()+?^|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")))
