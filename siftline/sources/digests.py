"""Alert digests: HTML messages to job cards."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions.keys import (canonical_posting_url, caption_parts, unwrapped_posting_id)
from siftline.functions.text import collapse, text_or_empty, words
from siftline.operators.joins import attribute_alerts

# The character between company and location in a caption.
CAPTION_DOT = "·"


def _plain(html):
    """Text of a markup fragment: image alts stay, tags go, common entities are decoded."""
    alts = F.regexp_replace(html, r'(?is)<img\b[^>]*?\balt="([^"]*)"[^>]*>', " $1 ")
    text = F.regexp_replace(alts, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&middot;", "·"), ("&#183;", "·"), ("&lt;", "<"),
                         ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return collapse(text)


def digest_tokens(messages: DataFrame, msg: str = "msg_id", html: str = "html",
                  extra=()) -> DataFrame:
    """Messages as a flat token table (msg, pos, kind, href, text), in reading order.

    Anchors become link tokens. Text between them is cut at block tags, blank pieces go.
    """
    body = F.regexp_replace(text_or_empty(html), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    # One marker per token boundary: anchors as a whole, block tags as cuts.
    block = r"(?i)</?(?:br|tr|td|p|div|table)\b[^>]*>"
    marked = F.regexp_replace(body, r"(?is)(<a\b[^>]*>.*?</a>)", "\u0001$1\u0001")
    pieces = F.split(marked, "\u0001", -1)
    tokens = F.flatten(F.transform(pieces, lambda p: F.when(
        p.rlike(r"(?is)^<a\b"), F.array(F.struct(
            F.lit("link").alias("kind"),
            F.replace(F.regexp_extract(p, r'(?is)^<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1),
                      F.lit("&amp;"), F.lit("&")).alias("href"),
            _plain(p).alias("text")))).otherwise(
        F.transform(F.split(p, block, -1), lambda t: F.struct(
            F.lit("text").alias("kind"), F.lit("").alias("href"), _plain(t).alias("text"))))))
    kept = F.filter(tokens, lambda t: (t["kind"] == "link") | (t["text"] != ""))
    return (messages.select(msg, *extra, F.posexplode(kept).alias("pos", "t"))
            .select(msg, *extra, "pos", "t.*"))


def digest_cards(tokens: DataFrame, alert_names, track_map=None, msg: str = "msg_id",
                 job_id=None, extra=()) -> DataFrame:
    """Cards from a token table: a run of links with one job id, under the latest heading.

    Windows stay inside a message, which is one mail. Cards without a usable title stay in the
    result with ``parsed = false``.
    """
    track_map = track_map or {}
    t = tokens.withColumn("job_id", F.when(
        F.col("kind") == "link",
        unwrapped_posting_id(F.col("href")) if job_id is None else job_id))
    t = attribute_alerts(t, alert_names, {}, "text").drop("alert_track")
    is_link = F.col("kind") == "link"
    job_link = F.col("job_id").isNotNull()
    heading = F.when(~job_link, F.col("alert_name"))
    in_order = W.partitionBy(msg).orderBy("pos")
    upto = in_order.rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumns({"alert": F.last(heading, ignorenulls=True).over(upto),
                       "prev_link": F.last(F.when(is_link, F.coalesce("job_id", F.lit(""))),
                                           ignorenulls=True).over(
                           in_order.rowsBetween(W.unboundedPreceding, -1))})
    starts = F.when(is_link & (F.col("prev_link").isNull()
                               | (F.col("prev_link") != F.coalesce("job_id", F.lit("")))), 1)
    t = t.withColumn("island", F.sum(F.coalesce(starts, F.lit(0))).over(upto))
    w_island = W.partitionBy(msg, "island")
    t = t.withColumn("card_id", F.max("job_id").over(w_island))
    cards = t.filter(F.col("card_id").isNotNull()).groupBy(msg, *extra, "island").agg(
        F.max("card_id").alias("job_id"), F.min("pos").alias("pos"),
        F.min_by("alert", "pos").alias("alert_name"),
        F.min_by("text", F.when((F.col("kind") == "text")
                                & F.col("text").contains(CAPTION_DOT), F.col("pos")))
        .alias("caption"),
        F.sort_array(F.collect_list(F.when(is_link & (F.col("text") != ""),
                                           F.struct("pos", "text")))).alias("anchors"))
    part = caption_parts(F.col("caption"))
    cards = cards.withColumns({"c": F.when(F.col("caption").isNotNull(), part),
                               "names": F.col("anchors.text")})
    company = F.nullif(F.col("c.company"), F.lit(""))
    other = F.get(F.filter("names", lambda a: F.btrim(words(a))
                           != F.btrim(words(F.col("c.company")))), 0)
    longest = F.array_max(F.transform("names", lambda a, i: F.struct(
        F.length(a).alias("n"), (-i).alias("o"), a.alias("a"))))["a"]
    title = F.coalesce(F.when(company.isNotNull(), other), longest)
    track = F.coalesce(*[F.when(F.col("alert_name") == n, tr) for n, tr in track_map.items()],
                       F.lit(None).cast("string"))
    return cards.select(
        msg, *extra, "pos", "job_id", canonical_posting_url(F.col("job_id")).alias("url"),
        title.alias("title"), company.alias("company"), F.col("c.location").alias("location"),
        F.col("c.work_mode").alias("work_mode"), "alert_name", track.alias("alert_track"),
        title.isNotNull().alias("parsed"))
