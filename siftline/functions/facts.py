"""Facts read from posting text: salary, work mode, quota figures, error class."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import fixed_values as V
from siftline.functions.text import (ELLIPSIS, WHITESPACE, any_of, around, collapse,
                                     contains_any, context, text_or_empty)

_FLAGS = "(?iU)"
# Words without which no pattern of a kind can match; plain tests that run first.
_FIGURE = r"\d\d|\d\s*[kK]"
_MONEY = r"(?i)[€£$₣]|(?:EUR|GBP|USD|CHF|HUF|PLN|SEK|NOK|DKK|CZK|RON)\b"
_PAY = "(?i)salary|compensation|competitive"
_PLACE = (r"(?i)hybrid|remote|on[- ]?site|in[- ]office|premise|office[- ]based|work\s+from|"
          r"the\s+office")


def _spot(text: Column, patterns, first: int = 0) -> Column:
    """Number of the first pattern that matches, with start and width of its leftmost match."""
    return F.coalesce(*[F.when(text.rlike(_FLAGS + p), F.struct(
        F.lit(first + i).alias("rule"),
        (F.regexp_instr(text, F.lit(_FLAGS + p)) - 1).alias("start"),
        F.length(F.regexp_substr(text, F.lit(_FLAGS + p))).alias("width")))
        for i, p in enumerate(patterns)])


def salary_spot(body: Column) -> Column:
    """Where a collapsed text states or withholds a salary; ``body`` is a column reference."""
    stated = F.when(body.rlike(_FIGURE) & body.rlike(_MONEY), _spot(body, V.SALARY_STATED))
    withheld = F.when(body.rlike(_PAY), _spot(body, V.SALARY_WITHHELD, len(V.SALARY_STATED)))
    return F.coalesce(stated, withheld)


def salary(spot: Column, body: Column) -> Column:
    """Struct of value (the verbatim span), quote and reason."""
    stated = spot["rule"] < len(V.SALARY_STATED)
    span = F.btrim(F.substring(body, spot["start"] + 1, spot["width"]))
    return F.struct(
        F.when(spot.isNull(), "unknown").when(stated, span).otherwise("not disclosed")
        .alias("value"),
        F.when(spot.isNotNull(), context(body, spot["start"], spot["width"])).alias("quote"),
        F.when(body == "", "no posting text available to read")
        .when(spot.isNull(), "the posting states no salary")
        .when(stated, "stated in the posting text")
        .otherwise("the posting declines to state a figure").alias("reason"))


def _tag(mode: str):
    return lambda m: m.withField("mode", F.lit(mode))


def mode_spot(hay: Column) -> Column:
    """The first rule with a match that no negator precedes: mode, match and wording around it.

    A negated match is skipped and the next match of the same pattern is tried. Run-ups are cut
    first and searched alone, so a word cut in half at the window edge counts as it stands.
    """
    rules = []
    for mode, patterns in V.WORK_MODES.items():
        for p in patterns:
            rx = F.lit("(?iU)" + around(71, 71, p))
            found = F.arrays_zip(*[F.regexp_extract_all(hay, rx, F.lit(i)).alias(n)
                                   for i, n in ((1, "before"), (2, "match"), (3, "after"))])
            free = F.filter(found, lambda m: ~F.right(
                m["before"], F.lit(V.WORK_MODE_NEGATOR_CHARS)).rlike(
                _FLAGS + V.WORK_MODE_NEGATOR))
            rules.append(F.when(hay.rlike(_FLAGS + p), F.get(
                F.transform(free, _tag(mode)), 0)))
    return F.when(hay.rlike(_PLACE), F.coalesce(*rules))


def work_mode(spot: Column) -> Column:
    """Struct of value and quote: hybrid, remote, onsite or unknown."""
    pad = F.greatest(F.floor((F.lit(140) - F.length(spot["match"])) / 2), F.lit(0)).cast("int")
    before, after = spot["before"], spot["after"]
    quote = F.concat(F.when(F.length(before) > pad, ELLIPSIS).otherwise(""), F.btrim(F.concat(
        F.right(before, pad), spot["match"], F.left(after, pad))),
        F.when(F.length(after) > pad, ELLIPSIS).otherwise(""))
    return F.struct(F.coalesce(spot["mode"], F.lit("unknown")).alias("value"),
                    F.when(spot.isNotNull(), quote).alias("quote"))


def add_facts(df: DataFrame, title: str = "title", body: str = "body",
              location: str = "location") -> DataFrame:
    """Add ``salary`` and ``work_mode``; the title counts for the salary only.

    Texts are collapsed once and kept as columns, so a record is searched once per pattern.
    """
    df = df.withColumns({
        "_pay": collapse(F.concat(text_or_empty(title), F.lit(". "), text_or_empty(body))),
        "_hay": F.btrim(F.concat(collapse(text_or_empty(location)), F.lit(". "),
                                 collapse(text_or_empty(body))), F.lit(". "))})
    df = df.withColumns({"_pay_at": salary_spot(F.col("_pay")),
                         "_mode_at": mode_spot(F.col("_hay"))})
    return df.withColumns({
        "salary": salary(F.col("_pay_at"), F.col("_pay")),
        "work_mode": work_mode(F.col("_mode_at")),
    }).drop("_pay", "_hay", "_pay_at", "_mode_at")


def quota_figures(text: Column) -> Column:
    """Struct of ``have`` and ``need`` from an error text."""
    body = text_or_empty(text)
    return F.struct(
        F.regexp_extract(body, V.QUOTA_HAVE, 1).try_cast("double").alias("have"),
        F.regexp_extract(body, V.QUOTA_NEED, 1).try_cast("double").alias("need"))


def is_quota_error(text: Column) -> Column:
    body = text_or_empty(text)
    return ((F.lower(body).contains("403") & contains_any(F.lower(body), V.QUOTA_MARKERS))
            | body.rlike(V.QUOTA_HAVE) | body.rlike(V.QUOTA_NEED))


def error_class(text: Column) -> Column:
    """The first class whose word list matches; blank text is unknown, other text transient."""
    low = F.lower(text_or_empty(text))
    out = F.when(F.btrim(low, F.lit(WHITESPACE)) == "", "unknown")
    for name, terms in V.ERROR_CLASSES:
        out = out.when(low.rlike(any_of(terms)), name)
    return out.otherwise("transient")
