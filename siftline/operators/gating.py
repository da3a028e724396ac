"""All gates over a table of records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import fixed_values as V
from siftline.functions import gates as G
from siftline.functions.text import gate_lines, gate_text, text_or_empty


def with_evidence(df: DataFrame) -> DataFrame:
    """Body, evidence source and completeness of the text a record carries."""
    empty = F.lit("")
    description = text_or_empty("description")
    snippet = text_or_empty("description_snippet")
    cut = (description != empty) & F.coalesce(F.col("description_truncated"), F.lit(False))
    return df.withColumns({
        "body": F.coalesce(F.nullif(description, empty), F.nullif(snippet, empty), empty),
        "full_text": (description != empty) & ~cut,
        "caveat": F.when(cut, V.CUT_BODY_CAVEAT).otherwise(V.SNIPPET_CAVEAT),
        "evidence_source": F.when(cut, "description_truncated")
        .when(description != empty, "description")
        .when(snippet != empty, "description_snippet").otherwise("none"),
    })


def _add(df: DataFrame, **groups) -> tuple:
    """One projection with the columns of several groups, and references to them by group."""
    names = {g: {f: f"_{g}_{f}" for f in fields} for g, fields in groups.items()}
    df = df.withColumns({names[g][f]: c for g, fields in groups.items()
                         for f, c in fields.items()})
    return df, {g: {f: F.col(n) for f, n in fields.items()} for g, fields in names.items()}


def evaluate_gates(df: DataFrame, today, max_age: int = V.MAX_AGE_DAYS,
                   min_body_domains: int = 2, languages=None, stopwords=None) -> DataFrame:
    """Add a ``gates`` struct; needs ``axes`` and the record columns. One narrow pass.

    Normalised text is made once and kept as a column, then read by the gates that need it.
    Store the result (``cut_lineage`` or a table) before filtering on gates: Spark pushes such a
    filter down into the text stages, where it would repeat their work.
    """
    today = F.lit(today).cast("date")
    df = with_evidence(df)
    title, body = text_or_empty("title"), F.col("body")
    whole, raw, full, caveat = (F.col(c) for c in ("_whole", "_raw", "full_text", "caveat"))
    lines, at, text = F.col("_lines"), F.col("_at"), F.col("_text")
    has_body = body != ""
    # Each stage is one projection. A value that several expressions read becomes a plain column
    # first, so it is computed once per row and plans stay small.
    df = df.withColumn("_raw", F.concat(title, F.lit("\n"), body))
    df = df.withColumns({
        "_whole": gate_lines(raw), "_spot": gate_text(text_or_empty("location")),
        "_senior": G.seniority_marker(F.col("title")),
        "_age": G.posting_age(F.col("date_posted"), today)})
    # The sentences that any gate hangs on, and where they stand; the patterns read only those.
    df = df.withColumns({
        "_picked": G.trigger_lines(whole, languages),
        "_text": F.concat(F.lit(" "), F.btrim(F.regexp_replace(whole, "[ \n]+", " ")), F.lit(" "))})
    df = df.withColumns({"_lines": F.array_join(F.col("_picked.text"), "\n"),
                         "_at": F.col("_picked.line"),
                         "_place": F.concat(F.rtrim("_spot"), text)})
    df, got = _add(
        df.withColumns({"_years": G.years_figures(lines), "_shut": G.closed_line(lines),
                        "_names": G.place_names(F.col("_place"))}),
        lang=G.language_evidence(lines, languages), spon=G.sponsorship_evidence(lines))
    df, where = _add(df, geo=G.geography_evidence(F.col("location"), F.col("_names")))
    got |= where
    df = df.withColumn("_stop", G.stopword_hits(text, stopwords))
    df, found = _add(
        df, counts=G.language_counts(F.col("_stop"), text, stopwords),
        lang_found=G.language_findings(got["lang"], lines, raw, languages, at),
        years_found=G.experience_findings(F.col("_years")),
        spon_found=G.sponsorship_findings(got["spon"], lines, raw, at))
    df, seen = _add(df, detected=G.detect_language(found["counts"], body))
    df, gate = _add(
        df, g_language=G.language_gate(found["lang_found"], seen["detected"], has_body),
        g_experience=G.experience_gate(found["years_found"], raw, has_body),
        g_sponsorship=G.sponsorship_gate(found["spon_found"], got["spon"], raw, has_body),
        g_seniority=G.seniority_gate(F.col("_senior"), F.col("title")),
        g_pure_technical=G.pure_technical_gate(F.col("axes"), min_body_domains),
        g_closed=G.closed_gate(F.col("_shut"), lines, raw, has_body, at),
        g_geography=G.geography_gate(got["geo"], F.col("location"), F.col("_place")),
        g_recency=G.recency_gate(F.col("_age"), F.col("date_posted"), max_age))
    extra = {"language": ("languages_required", "languages_optional"),
             "experience": ("years_required",), "sponsorship": ("bar", "sponsorship_offered"),
             "closed": ("marker",)}
    df, capped = _add(df, **{f"f_{n}": G.unless_incomplete(gate[f"g_{n}"], full, caveat, fields)
                             for n, fields in extra.items()})
    final = {n: capped.get(f"f_{n}", gate[f"g_{n}"]) for n in V.GATE_ORDER}
    verdicts = {n: final[n]["verdict"] for n in V.GATE_ORDER}
    gates = F.struct(
        G.overall_verdict(verdicts).alias("overall"), G.failed_gates(verdicts).alias("failed"),
        *[F.struct(*[c.alias(f) for f, c in final[n].items()]).alias(n) for n in V.GATE_ORDER],
        F.length(body).alias("evidence_chars"), F.col("evidence_source"))
    keep = [c for c in df.columns if not c.startswith("_")
            and c not in ("full_text", "caveat", "evidence_source")]
    return df.select(*keep, gates.alias("gates"))


def gate_failure_counts(df: DataFrame, gates: str = "gates") -> DataFrame:
    """One row: failures per gate and the number of UNKNOWN records; one pass, no explode."""
    failed = F.col(gates)["failed"]
    return df.agg(
        F.count_if(F.col(gates)["overall"] == V.FAIL).alias("gate_failed"),
        F.count_if(F.col(gates)["overall"] == V.UNKNOWN).alias("gate_unknown"),
        *[F.count_if(F.array_contains(failed, n)).alias(f"gate_failed_{n}")
          for n in V.GATE_ORDER])


def display_tally(df: DataFrame, key: str, gates: str = "gates") -> DataFrame:
    """Per record: how many gates display as pass, fail and unverified; no shuffle."""
    shown = [G.display_verdict(F.col(gates)[n]["verdict"]) for n in V.GATE_ORDER]

    def tally(word):
        total = F.lit(0)
        for s in shown:
            total = total + F.when(s == word, 1).otherwise(0)
        return total.alias(word)

    return df.select(key, tally("pass"), tally("fail"), tally("unverified"))


def display_tally_long(verdicts: DataFrame, key: str) -> DataFrame:
    """The same tally over a long table (key, gate, verdict), open to gates added later."""
    return (verdicts.withColumn("shown", G.display_verdict(F.col("verdict")))
            .groupBy(key).pivot("shown", ["pass", "fail", "unverified"])
            .agg(F.count(F.lit(1))).na.fill(0))
