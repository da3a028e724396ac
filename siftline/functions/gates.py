"""Evidence gates: every gate answers PASS, FAIL or UNKNOWN and quotes its evidence.

Gates read ``gate_lines`` (one padded line per sentence), so "this sentence says X and not Y" is
one multi-line regex. One pass over a record looks for any word that some gate hangs on
(``trigger_lines``); only sentences with such a word go to the costly patterns, so most text is
read once, whatever the number of gates.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import fixed_values as V
from siftline.functions.keys import ymd
from siftline.functions.text import (SENTENCE_END, around, any_of, collapse, contains_any, either, excerpt,
                                     first_in_order, gate_text, line_of, on_line, on_raw_line,
                                     raw_sentence, strip, text_or_empty)


def _null() -> Column:
    return F.lit(None).cast("string")


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def _fields(**columns) -> dict:
    """Named columns. Callers keep them as plain columns, not as one struct: the optimiser copies
    the fields of a struct into every place that reads them, and long expressions with it.
    """
    return columns


def unless_incomplete(block: dict, full_text: Column, caveat: Column, extra=()) -> dict:
    """A PASS earned by silence in incomplete text is UNKNOWN; FAIL never softens.

    ``block`` must be a column reference: it is read several times. ``extra`` names the fields
    beyond verdict, reason and quote.
    """
    silent = (block["verdict"] == V.PASS) & ~full_text
    return _fields(
        verdict=F.when(silent, V.UNKNOWN).otherwise(block["verdict"]),
        reason=F.when(silent, F.concat(block["reason"], F.lit(", but "), caveat,
                                F.lit(" — unverified, not a pass")))
        .otherwise(block["reason"]),
        **{f: block[f] for f in ("quote", *extra)})


# ------------------------------------------------------------------------------- triggers

def trigger_pattern(names=None) -> str:
    """One alternation of what every pattern of the sentence gates needs to match at all."""
    names = V.LANGUAGE_NAMES if names is None else names
    words_ = ["native", "mother tongue", "mothertongue", *SPONSORSHIP_TOPICS, *CLOSED_TOPICS,
              *(a for al in names.values() for a in al)]
    return f"{any_of(words_)}|{YEARS_TOPIC}"


def trigger_lines(lines: Column, names=None) -> Column:
    """(line, text) of the lines with a trigger, in order: an array, empty for most records."""
    numbered = F.transform(F.split(lines, "\n", -1),
                           lambda s, i: F.struct(i.alias("line"), s.alias("text")))
    return F.filter(numbered, lambda x: x["text"].rlike(trigger_pattern(names)))


def _raw_line(line: Column, at: Column = None) -> Column:
    """The number of a line in the whole text; ``at`` holds those of lines picked from it."""
    return line if at is None else F.get(at, line)


# ------------------------------------------------------------------------------- language

def stopword_hits(text: Column, stopwords=None) -> Column:
    """All stopwords of any language in a normalised text, in order, in one regex pass."""
    stopwords = V.LANGUAGE_STOPWORDS if stopwords is None else stopwords
    known = sorted({w for ws in stopwords.values() for w in ws} | set(V.ENGLISH_STOPWORDS))
    return F.regexp_extract_all(text, F.lit(f"(?<= ){any_of(known)}(?= )"), F.lit(0))


def language_counts(hits: Column, text: Column, stopwords=None) -> dict:
    """Struct of total tokens, English hits, and the best other language with its hits."""
    stopwords = V.LANGUAGE_STOPWORDS if stopwords is None else stopwords

    def count(listed):
        return F.size(F.filter(hits, lambda w: w.isin(*listed)))

    ranked = F.array(*[F.struct(count(ws).alias("hits"), F.lit(-i).alias("order"),
                                F.lit(lang).alias("language"))
                       for i, (lang, ws) in enumerate(stopwords.items())])
    best = F.array_max(ranked)
    trimmed = F.btrim(text)
    total = F.when(trimmed == "", 0).otherwise(
        F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1)
    return _fields(
        total=total,
        english=count(V.ENGLISH_STOPWORDS),
        hits=best["hits"],
        language=best["language"])


def detect_language(counts: Column, body: Column) -> dict:
    """Verdict about the language a posting is written in."""
    total, english, hits = counts["total"], counts["english"], counts["hits"]
    ratio, english_ratio = F.try_divide(hits, total), F.try_divide(english, total)
    thin = F.length(body) < V.DETECT_MIN_CHARS
    other = ((hits >= V.DETECT_MIN_HITS) & (ratio >= V.DETECT_MIN_RATIO)
             & (hits >= english * V.DETECT_ENGLISH_MARGIN))
    absent = (total >= V.ENGLISH_MIN_TOKENS) & (english_ratio < V.ENGLISH_MIN_RATIO)
    verdict = (F.when((total == 0) | thin, V.UNKNOWN).when(other, V.FAIL)
               .when(absent, V.UNKNOWN).otherwise(V.PASS))
    named = (total > 0) & (hits > 0) & (thin | other)
    return _fields(
        verdict=verdict,
        language=F.when(named, counts["language"]),
        ratio=F.when(total == 0, F.lit(0.0)).otherwise(F.round(ratio, 4)),
        hits=F.when(total == 0, 0).otherwise(hits),
        english_hits=english,
        english_absent=(total > 0) & ~thin & ~other & absent,
        quote=F.when((total > 0) & ~thin & (other | absent), F.substring(strip(body), 1, 200)),
        reason=F.when(total == 0, "no text")
        .when(thin, F.concat(F.lit("only "), F.length(body),
                             F.lit(" chars of text - too thin to judge")))
        .when(other, F.concat(hits, F.lit(" "), counts["language"], F.lit(" stopwords against "),
                              english, F.lit(" English")))
        .when(absent, F.concat(F.lit("only "), english, F.lit(" English stopwords in "), total,
                               F.lit(" words")))
        .otherwise(F.concat(F.lit("reads as English ("), english, F.lit(" stopwords)"))))


def _language_patterns(names):
    optional, required = any_of(V.LANGUAGE_OPTIONAL), any_of(V.LANGUAGE_REQUIRED)
    native = on_line(either(V.NATIVE_SPEAKER_PATTERNS))
    joiner = on_line(V.LANGUAGE_JOINER)
    demanded = {"native-speaker": f"(?m)^(?!.*{optional}).*{native}.*$"}
    allowed, demand_only = {}, {"native-speaker": native}
    for lang, aliases in names.items():
        alias = any_of(aliases)
        pair = (rf"\benglish{joiner}{alias}\b|\b{alias}{joiner}english\b")
        asks = f"(?=.* {alias} )(?:.*{required}|.*(?:{pair}))"
        demanded[lang] = f"(?m)^(?!.*{optional}){asks}.*$"
        allowed[lang] = f"(?m)^(?=.*{optional}).* {alias} "
        demand_only[lang] = f"^{asks}"
    everything = either([f".*{native}"] + [p[1:] for k, p in demand_only.items()
                                           if k != "native-speaker"])
    return demanded, allowed, demand_only, f"(?m)^(?!.*{optional}){everything}.*$"


def language_evidence(lines: Column, names=None) -> dict:
    """The first convicting line and whether any optional wording occurs; read by the gate."""
    names = V.LANGUAGE_NAMES if names is None else names
    any_demand = _language_patterns(names)[3]
    aliases = [a for al in names.values() for a in al]
    possible = lines.rlike(f" {any_of(aliases)} |native|mother ?tongue")
    return _fields(
        hit=F.when(possible, F.regexp_extract(lines, any_demand, 0)).otherwise(""),
        maybe_optional=possible & lines.rlike(any_of(V.LANGUAGE_OPTIONAL)))


def language_findings(evidence: Column, lines: Column, raw: Column, names=None,
                      at: Column = None) -> dict:
    """Which language convicted with its quote, and all demanded and optional languages.

    The per-language tests sit behind ``when``: they run on the few records with a hit. ``at``
    numbers the lines in the whole text if ``lines`` are picked ones.
    """
    names = V.LANGUAGE_NAMES if names is None else names
    demanded, allowed, demand_only, any_demand = _language_patterns(names)
    hit = evidence["hit"]
    first = F.coalesce(*[F.when(hit.rlike(p), lang) for lang, p in demand_only.items()])
    centre = "(?i)" + either([*V.NATIVE_SPEAKER_PATTERNS,
                              *[any_of(a) for a in names.values()]])
    quote = excerpt(raw_sentence(raw, _raw_line(line_of(lines, any_demand), at)), centre)
    required = F.array_sort(F.array_compact(F.array(*[
        F.when(lines.rlike(p), lang) for lang, p in demanded.items()])))
    optional = F.array_sort(F.array_compact(F.array(*[
        F.when(lines.rlike(p), lang) for lang, p in allowed.items()])))
    some_optional = (f"(?m)^(?=.*{any_of(V.LANGUAGE_OPTIONAL)}).* "
                     f"{any_of([a for al in names.values() for a in al])} ")
    mild = F.when(evidence["maybe_optional"] & lines.rlike(some_optional), excerpt(
        raw_sentence(raw, _raw_line(line_of(lines, some_optional), at)),
        "(?i)" + any_of([a for al in names.values() for a in al])))
    return _fields(
        first=F.when(hit != "", first),
        quote=F.when(hit != "", quote),
        optional_quote=mild,
        required=F.when(hit != "", required).otherwise(_no_strings()),
        optional=F.when(evidence["maybe_optional"], optional).otherwise(_no_strings()))


def language_gate(found: Column, detected: Column, has_body: Column) -> dict:
    """Does the posting demand a blocked language, or is it written in one?"""
    convicted = found["first"].isNotNull()
    foreign = detected["verdict"] == V.FAIL
    unread = (detected["verdict"] == V.UNKNOWN) & detected["english_absent"]
    some_optional = F.size(found["optional"]) > 0
    return _fields(
        verdict=F.when(convicted | foreign, V.FAIL).when(unread, V.UNKNOWN)
        .when(some_optional | has_body, V.PASS).otherwise(V.UNKNOWN),
        reason=F.when(convicted, F.concat(found["first"], F.lit(" stated as a hard job condition")))
        .when(foreign, F.concat(F.lit("posting is written in "), detected["language"]))
        .when(unread, "posting does not read as English and its language could not be "
                      "identified - any stated language requirement is unread")
        .when(some_optional, "only optional language preferences stated")
        .when(has_body, "no language condition stated")
        .otherwise("no description text to read a language condition from"),
        quote=F.when(convicted, found["quote"]).when(foreign | unread, detected["quote"])
        .when(some_optional, found["optional_quote"]),
        languages_required=found["required"],
        languages_optional=found["optional"])


# ------------------------------------------------------------------------------- experience

YEARS_TOPIC = r"\d ?(?:\+|plus)? ?(?:year|yr)"


def years_figures(lines: Column) -> Column:
    """Every years figure with its window, graded at the upper end of a range.

    ``kind`` says why a figure does not convict; it is null for a hard requirement.
    """
    rx = F.lit(around(V.YEARS_BEFORE, V.YEARS_AFTER, on_line(V.YEARS)))
    parts = [F.regexp_extract_all(lines, rx, F.lit(i)) for i in (1, 2, 3, 4, 5)]

    def grade(m: Column) -> Column:
        before, figure, after = m["before"], m["figure"], m["after"]
        window = F.concat(before, figure, after)
        low = m["low"].cast("int")
        high = F.coalesce(m["high"].try_cast("int"), low)
        top = F.greatest(low, high)
        floor = (before.rlike(any_of(V.YEARS_HARD_FLOOR))
                 & ~before.rlike(any_of(V.YEARS_AMBIGUOUS)))
        tenure = (after.rlike(V.YEARS_TENURE_PHRASE)
                  & ~before.rlike(any_of(V.YEARS_COMPANY_AGE)))
        kind = (F.when(top <= V.YEARS_MAX, "the requirement is within the profile's range")
                .when(floor, _null())
                .when(window.rlike(any_of(V.YEARS_AMBIGUOUS)), "ambiguity marker beside the figure")
                .when(after.rlike(any_of(V.YEARS_DOMAIN_SCOPED)),
                      "years scoped to an adjacent domain, not the role's core work")
                .when(window.rlike(any_of(V.YEARS_MANDATORY)) | figure.contains("+") | tenure,
                      _null())
                .otherwise("years stated without a mandatory marker"))
        ignored = (window.rlike(any_of(V.YEARS_NOT_TENURE))
                   & ~window.rlike(any_of(V.YEARS_TENURE_OVERRIDE)))
        return F.struct(top.alias("years"), F.least(low, high).alias("low"), kind.alias("kind"),
                        ignored.alias("ignored"))

    zipped = F.arrays_zip(*[p.alias(n) for p, n in
                            zip(parts, ("before", "figure", "low", "high", "after"))])
    named = F.transform(zipped, lambda m, i: grade(m).withField("nth", i))
    empty = F.array().cast("array<struct<years:int,low:int,kind:string,ignored:boolean,nth:int>>")
    return F.when(lines.rlike(YEARS_TOPIC),
                  F.filter(named, lambda m: ~m["ignored"])).otherwise(empty)


def experience_findings(figures: Column) -> dict:
    """The highest hard figure and the highest other one; the first of equals."""
    def worst(items):
        return F.array_max(F.transform(items, lambda m: F.struct(
            m["years"].alias("years"), (-m["nth"]).alias("order"), m["low"].alias("low"),
            m["kind"].alias("kind"))))

    return _fields(
        hard=worst(F.filter(figures, lambda m: m["kind"].isNull())),
        soft=worst(F.filter(figures, lambda m: m["kind"].isNotNull())))


def _years_quote(raw: Column, nth: Column) -> Column:
    """The n-th years figure of the raw text with the wording around it."""
    lines = F.regexp_replace(raw, SENTENCE_END, "\n")
    rx = F.lit("(?i)" + around(140, 140, on_raw_line(V.YEARS)))
    part = [F.get(F.regexp_extract_all(lines, rx, F.lit(i)), nth) for i in (1, 2, 5)]
    return collapse(F.concat(*part))


def experience_gate(found: Column, raw: Column, has_body: Column) -> dict:
    """Does the posting demand more years than the ceiling?"""
    hard, soft = found["hard"], found["soft"]
    span = F.when(hard["low"] != hard["years"], F.concat(
        hard["low"], F.lit("-"), hard["years"], F.lit(
            " years stated as a hard requirement, read at its ceiling of "), hard["years"])
    ).otherwise(F.concat(hard["years"], F.lit("+ years stated as a hard requirement")))
    nth = -F.coalesce(hard["order"], soft["order"])
    return _fields(
        verdict=F.when(hard.isNotNull(), V.FAIL).when(soft.isNotNull() | has_body, V.PASS)
        .otherwise(V.UNKNOWN),
        reason=F.when(hard.isNotNull(), span).when(soft.isNotNull(), soft["kind"])
        .when(has_body, "no years requirement stated")
        .otherwise("no description text to read a years requirement from"),
        quote=F.when(hard.isNotNull() | soft.isNotNull(), _years_quote(raw, nth)),
        years_required=F.coalesce(hard["years"], soft["years"]))


# ------------------------------------------------------------------------------- sponsorship

# Every pattern of the gate holds one of these words in each of its branches; a test checks that.
SPONSORSHIP_TOPICS = ("sponsor", "visa", "permit", "immigration", "passport", "citizen",
                      "national", "right to work", "eligible to work", "authoris", "authoriz",
                      "permanent resid", "applicants", "candidates", "residents", "able to offer",
                      "able to provide", "position to offer", "position to provide")


def sponsorship_evidence(lines: Column) -> dict:
    """Whether sponsorship is refused or offered, and whether papers may be demanded."""
    denied, offer, wall = (on_line(either(x)) for x in (
        V.SPONSORSHIP_DENIED, V.SPONSORSHIP_OFFERED, V.AUTHORISATION_WALL))
    topical = lines.rlike(any_of(SPONSORSHIP_TOPICS))
    return _fields(
        denied=topical & lines.rlike(denied),
        offered=topical & lines.rlike(f"(?m)^(?!.*{denied}).*{offer}"),
        maybe_wall=topical & lines.rlike(wall))


def sponsorship_findings(evidence: Column, lines: Column, raw: Column, at: Column = None) -> dict:
    """The bar that stands and its quote; negated demands for papers are no bar."""
    denied, wall = (on_line(either(x)) for x in (V.SPONSORSHIP_DENIED, V.AUTHORISATION_WALL))
    negators = any_of(V.WALL_NEGATORS)

    def stands(s: Column) -> Column:
        """Some demand whose first match in the sentence has no negator in its run-up."""
        hit = F.lit(False)
        for p in map(on_line, V.AUTHORISATION_WALL):
            run_up = F.right(F.regexp_extract(s, f"^(.*?)(?:{p})", 1),
                             F.lit(V.WALL_NEGATOR_CHARS))
            hit = hit | (s.rlike(p) & ~run_up.rlike(negators))
        return hit

    # Positions of the sentences that demand papers; only sentences with any match are tested.
    walls = F.filter(F.transform(F.split(lines, "\n", -1), lambda s, i: F.when(
        s.rlike(wall), F.when(stands(s), i))), lambda i: i.isNotNull())
    open_wall = evidence["maybe_wall"] & ~evidence["denied"] & ~evidence["offered"]
    denied_at = F.when(evidence["denied"], line_of(lines, denied))
    return _fields(
        denied_line=_raw_line(denied_at, at),
        wall_line=_raw_line(F.when(open_wall, F.get(walls, 0)), at))


def sponsorship_gate(found: Column, evidence: Column, raw: Column, has_body: Column) -> dict:
    """Is sponsorship refused, or are papers demanded that nobody offers to obtain?"""
    denied, wall = either(V.SPONSORSHIP_DENIED), either(V.AUTHORISATION_WALL)
    is_denied, barred = found["denied_line"].isNotNull(), found["wall_line"].isNotNull()
    return _fields(
        verdict=F.when(is_denied | barred, V.FAIL).when(has_body, V.PASS).otherwise(V.UNKNOWN),
        reason=F.when(is_denied, "posting states sponsorship is not available")
        .when(barred, "posting requires citizenship, a passport or pre-existing work rights this "
                      "profile lacks")
        .when(has_body & evidence["offered"], "posting states sponsorship is available")
        .when(has_body, "no sponsorship or citizenship bar stated")
        .otherwise("no description text to read a sponsorship condition from"),
        quote=F.when(is_denied | barred, excerpt(
            raw_sentence(raw, F.coalesce(found["denied_line"], found["wall_line"])),
            "(?i)" + either([denied, wall]))),
        bar=F.when(is_denied, "sponsorship_denied").when(barred, "authorisation_wall"),
        sponsorship_offered=evidence["offered"])


# ------------------------------------------------------------------------------- title, closed

def seniority_marker(title: Column) -> Column:
    """The first grade word of a title, or null."""
    spaced = F.concat(F.lit(" "), F.btrim(F.regexp_replace(gate_text(title), r"[\s\-/&]+", " ")),
                      F.lit(" "))
    followers = "|".join(V.LEAD_FOLLOWERS)
    grades = "|".join(w if w != "lead" else f"lead(?! (?:{followers}) )"
                      for w in V.SENIORITY_WORDS)
    return F.nullif(F.regexp_extract(spaced, f"(?<= )({grades})(?= )", 1), F.lit(""))


def seniority_gate(marker: Column, title: Column) -> dict:
    """Does the title carry a grade word? Never UNKNOWN."""
    hit = marker.isNotNull()
    return _fields(
        verdict=F.when(hit, V.FAIL).otherwise(V.PASS),
        reason=F.when(hit, F.concat(F.lit("title advertises a grade above this level ('"), marker,
                             F.lit("')"))).otherwise("no seniority marker in the title"),
        quote=F.when(hit, collapse(text_or_empty(title))),
        marker=marker)


def pure_technical_gate(axes: Column, min_body_domains: int = 2) -> dict:
    """A core-tech title needs a domain in the title or several in the body."""
    marker, in_title, in_body = (axes["core_tech_marker"], axes["domain_in_title"],
                                 axes["domain_from_description"])
    verdict = (F.when(axes.isNull(), V.UNKNOWN).when(marker.isNull(), V.PASS)
               .when((F.size(in_title) > 0) | (F.size(in_body) >= min_body_domains), V.PASS)
               .otherwise(V.FAIL))
    reason = (F.when(axes.isNull(), "no two-axis result to classify from")
              .when(marker.isNull(), "no core-tech marker in the title")
              .when(F.size(in_title) > 0, F.concat(
                  F.lit("core-tech title carries a business domain: "),
                  F.array_join(in_title, ", ")))
              .when(F.size(in_body) >= min_body_domains, F.concat(
                  F.lit("description describes business work in "), F.size(in_body),
                  F.lit(" domains: "), F.array_join(in_body, ", ")))
              .otherwise(F.concat(F.lit("pure technical role - title matches '"), marker,
                                  F.lit("'"))))
    return _fields(
        verdict=verdict,
        reason=reason,
        quote=_null(),
        marker=marker)


# Every notice holds one of these words; a test checks that.
CLOSED_TOPICS = ("accepting", "available", "clos", "filled", "expired")
_CLOSED = f"(?m)^(?!.*{any_of(V.CLOSED_DEADLINES)}).*{any_of(V.CLOSED_NOTICES)}.*$"


def closed_line(lines: Column) -> Column:
    """The first line that states the posting is closed without naming a deadline, or null."""
    return F.when(lines.rlike(any_of(CLOSED_TOPICS)),
                  F.nullif(F.regexp_extract(lines, _CLOSED, 0), F.lit("")))


def closed_gate(hit: Column, lines: Column, raw: Column, has_body: Column,
                at: Column = None) -> dict:
    """Does a sentence say the posting is closed, without naming a deadline?"""
    marker = F.when(hit.isNotNull(), first_in_order(hit, V.CLOSED_NOTICES, before="", after=""))
    quote = F.substring(raw_sentence(raw, _raw_line(line_of(lines, _CLOSED), at)), 1, 200)
    return _fields(
        verdict=F.when(hit.isNotNull(), V.FAIL).when(has_body, V.PASS).otherwise(V.UNKNOWN),
        reason=F.when(hit.isNotNull(), "the posting states it is closed")
        .when(has_body, "no closed-posting notice in the text")
        .otherwise("no description text to read a closed-posting notice from"),
        quote=F.when(hit.isNotNull(), quote),
        marker=marker)


# ------------------------------------------------------------------------------- geography

def _place_ranks(lists) -> list[dict]:
    """For each list: every known name with the first place of the list that it answers for.

    A name answers for itself and for names that it starts with as whole words.
    """
    def answers(name: str, other: str) -> bool:
        return (name + " ").startswith(other) and not (name + " ")[len(other)].isalnum()

    ranks = [{n: [i for i, m in enumerate(names) if answers(n, m)] for listed in lists
              for n in listed} for names in lists]
    return [{n: min(i) for n, i in rank.items() if i} for rank in ranks]


PLACE_LISTS = (V.OUTSIDE_EUROPE, V.US_STATES, V.INSIDE_EUROPE)


def place_names(text: Column) -> Column:
    """The names of all place lists in ``gate_text`` of location, title and body, in one pass.

    The look-ahead reports the longest name at each place and lets the next one overlap it.
    """
    known = any_of([n for names in PLACE_LISTS for n in names])
    return F.regexp_extract_all(text, F.lit(f"(?<![a-z0-9])(?=({known})(?![a-z0-9]))"), F.lit(1))


def geography_evidence(location: Column, found: Column) -> dict:
    """The first name of each list; ``found`` is ``place_names``. Few names occur in a text, so their
    lists and places are looked up one by one."""
    suffix = F.lower(strip(text_or_empty(location))).rlike(
        r",\s*(?:" + "|".join(V.SUBDIVISIONS) + r")\s*(?:,\s*(?:usa|us|canada))?\s*$")

    def listed(values) -> Column:
        return F.split(F.lit("|".join(map(str, values))), r"\|", -1)

    def first(names, rank) -> Column:
        keys, places = listed(rank), listed(rank.values()).cast("array<int>")
        best = F.array_min(F.transform(found, lambda n: F.get(
            places, (F.array_position(keys, n) - 1).cast("int"))))
        return F.get(listed(names), best)

    return _fields(suffix=suffix, **{
        field: first(names, rank) for field, names, rank in zip(
            ("outside", "state", "inside"), PLACE_LISTS, _place_ranks(PLACE_LISTS))})


def geography_gate(found: Column, location: Column, text: Column) -> dict:
    """Where is the role? Names outside Europe win over names inside."""
    place = strip(text_or_empty(location))
    suffix, outside, state, inside = (found[n] for n in ("suffix", "outside", "state", "inside"))
    abroad = F.coalesce(outside, state)
    near = F.position(abroad, text)
    return _fields(
        verdict=F.when(suffix | abroad.isNotNull(), V.FAIL).when(inside.isNotNull(), V.PASS)
        .otherwise(V.UNKNOWN),
        reason=F.when(suffix, "the location is a US/Canadian state-or-province address")
        .when(outside.isNotNull(), F.concat(
            F.lit("the posting places the role outside Europe ('"), outside, F.lit("')")))
        .when(state.isNotNull(), F.concat(F.lit("the posting names the US state '"), state,
                                          F.lit("'")))
        .when(inside.isNotNull(), F.concat(
            F.lit("the posting places the role in Europe ('"), inside, F.lit("')")))
        .when(place == "", "the posting carries no location field to judge")
        .otherwise("the location names no country this gate recognises either way"),
        quote=F.when(suffix, F.substring(collapse(place), 1, 120))
        .when(abroad.isNotNull(), F.btrim(F.substring(
            text, F.greatest(F.lit(1), near - 40), F.length(abroad) + 80))),
        marker=F.when(suffix, "us/ca subdivision").otherwise(F.coalesce(abroad, inside)))


# ------------------------------------------------------------------------------- recency

def recency_gate(age: Column, date_posted: Column, max_age: int = V.MAX_AGE_DAYS) -> dict:
    """Is the posting recent? ``age`` is in days, null when the date cannot be read."""
    old, future = age > max_age, age < 0
    return _fields(
        verdict=F.when(age.isNull() | future, V.UNKNOWN).when(old, V.FAIL).otherwise(V.PASS),
        reason=F.when(age.isNull(), "the posting carries no readable date")
        .when(old, F.concat(F.lit("posted "), age, F.lit(
            f" days ago, past the {max_age}-day freshness limit")))
        .when(future, "the posting date is in the future")
        .otherwise(F.concat(F.lit("posted "), age, F.lit(" days ago"))),
        quote=F.when(old, F.substring(date_posted, 1, 40)),
        marker=F.when(age.isNotNull(), F.substring(date_posted, 1, 10)))


def posting_age(date_posted: Column, today: Column) -> Column:
    """Days from the leading yyyymmdd digits to ``today``; never read from a clock."""
    return F.datediff(today, ymd(date_posted))


# ------------------------------------------------------------------------------- roll-up

def overall_verdict(verdicts: dict) -> Column:
    """Any FAIL fails; UNKNOWN only from the gates a fetched body could settle."""
    failed, unknown = F.lit(False), F.lit(False)
    for name in V.GATE_ORDER:
        failed = failed | (verdicts[name] == V.FAIL)
        if name in V.GATES_THAT_CAN_BE_UNKNOWN:
            unknown = unknown | (verdicts[name] == V.UNKNOWN)
    return F.when(failed, V.FAIL).when(unknown, V.UNKNOWN).otherwise(V.PASS)


def failed_gates(verdicts: dict) -> Column:
    return F.array_compact(F.array(*[F.when(verdicts[n] == V.FAIL, n) for n in V.GATE_ORDER]))


def discard_reason(gates: Column) -> Column:
    """Reason text of a discarded record, with the quoted evidence."""
    parts = F.array_compact(F.array(*[
        F.when(gates[n]["verdict"] == V.FAIL, F.concat(
            F.lit(f"{n}: "), F.coalesce(gates[n]["reason"], F.lit(n)),
            F.when(F.coalesce(gates[n]["quote"], F.lit("")) != "", F.concat(
                F.lit(' — "'), strip(gates[n]["quote"]), F.lit('"'))).otherwise("")))
        for n in V.GATE_ORDER]))
    return F.concat(F.lit("hard gate — "), F.array_join(parts, "; "))


def display_verdict(verdict: Column) -> Column:
    upper = F.upper(text_or_empty(verdict))
    return F.when(upper == V.PASS, "pass").when(upper == V.FAIL, "fail").otherwise("unverified")


# ------------------------------------------------------------------------------- rank-time set

# Wording of the rank-time gates.
CITIZEN_ONLY = (r"\bmust be a (?:citizen|permanent resident|pr)\b",
                r"\b(?:citizenship|permanent residency|pr status) required\b",
                r"\bsecurity clearance\b")
HOME_PASSPORT = r"\bmust hold (?:hungarian|eu|european) (?:citizenship|passport)\b"
NO_SPONSOR = (r"\bno visa sponsorship\b", r"\bmust already have the right to work\b",
              r"\bnot eligible for sponsorship\b", r"\bno work permit support\b",
              r"\bno relocation support\b")
RANK_COUNTRIES = (
    "Austria", "Belgium", "Bulgaria", "Croatia", "Cyprus", "Czech Republic", "Denmark", "Estonia",
    "Finland", "France", "Germany", "Greece", "Hungary", "Ireland", "Italy", "Latvia",
    "Lithuania", "Luxembourg", "Malta", "Netherlands", "Poland", "Portugal", "Romania",
    "Slovakia", "Slovenia", "Spain", "Sweden", "Switzerland", "UK", "United Kingdom", "Norway",
    "Iceland", "Liechtenstein",
)
RANK_LANGUAGES = ("german", "french", "spanish", "italian", "dutch", "polish", "russian",
                  "chinese", "arabic")
LEVEL = r"(?:fluent|professional|business level|native|mother tongue)"
OPTIONAL_SHORT = (r"\b(?:advantage|nice to have|preferred|ideally|a plus|an asset|welcome|"
                  r"beneficial)\b")
ENGLISH_HIGH = (r"\bnative(?:-level)?\s+english\b", r"\bfluent\s+english\s+and\b")


def rank_seniority_gate(title: Column) -> Column:
    """PASS or FAIL from title words; "lead" followed by a noun is pardoned."""
    low = F.lower(text_or_empty(title))
    plain = "|".join(w for w in V.SENIORITY_WORDS if w != "lead")
    followers = "|".join(V.LEAD_FOLLOWERS[:1] + V.LEAD_FOLLOWERS[2:])
    # One noun use of "lead" pardons the word for the whole title.
    lead = low.rlike(r"(?U)\blead\b") & ~low.rlike(rf"(?U)\blead\s+(?:{followers})\b")
    return F.when(low.rlike(rf"(?U)\b(?:{plain})\b") | lead, V.FAIL).otherwise(V.PASS)


def rank_eligibility_gate(location: Column, body: Column,
                          home=("Hungary", "Budapest")) -> Column:
    """PASS, FLAG or FAIL by place and wording."""
    place, low = text_or_empty(location), F.lower(text_or_empty(body))
    low_place = F.lower(place)
    at_home = contains_any(place, home)
    in_list = contains_any(place, RANK_COUNTRIES)
    far_remote = low_place.contains("remote") | low_place.contains("worldwide")
    open_remote = far_remote & contains_any(low_place, ("eu", "europe", "worldwide", "global"))
    citizens = low.rlike("(?U)" + either(CITIZEN_ONLY))
    europe = in_list | contains_any(place, ("Europe", "EU", "European"))
    abroad_remote = contains_any(low_place, ("us", "usa", "america", "canada", "australia",
                                             "asia"))
    return (F.when(at_home, F.when(citizens | low.rlike("(?U)" + HOME_PASSPORT), V.FAIL)
                   .otherwise(V.PASS))
            .when(open_remote, V.PASS)
            .when(in_list & ~place.contains(home[0]),
                  F.when(low.rlike("(?U)" + either(NO_SPONSOR)), "FLAG").when(citizens, V.FAIL)
                  .otherwise("FLAG"))
            .when(~europe & low_place.contains("remote"),
                  F.when(abroad_remote, V.FAIL).otherwise(V.PASS))
            .when(~europe, V.FAIL).otherwise(V.PASS))


def rank_language_gate(body: Column, home_language: str = "hungarian") -> Column:
    """PASS, FLAG or FAIL by language wording near a level word."""
    low = F.lower(text_or_empty(body))
    home = (rf"\b{LEVEL}\s+{home_language}\b",
            rf"\b{home_language}\s+(?:fluent|professional|business level|native|required|"
            r"mandatory)\b")
    other = "|".join(RANK_LANGUAGES)
    foreign = (rf"\b{LEVEL}\s+(?:{other})\b",
               rf"\b(?:{other})\s+(?:required|mandatory|must have|must speak|essential)\b")
    return (F.when(low.rlike("(?U)" + either(home + foreign)), V.FAIL)
            .when(low.contains(home_language) & low.rlike("(?U)" + OPTIONAL_SHORT), V.PASS)
            .when(low.rlike("(?U)" + either(ENGLISH_HIGH)), "FLAG").otherwise(V.PASS))
