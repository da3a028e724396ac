"""Scores: query match, rule-based dimensions, weighted overall."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import fixed_values as V
from siftline.functions.text import any_of, contains_any, text_or_empty, words


def _plain_words(text: str) -> str:
    import re

    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


def _terms(queries):
    """Phrases (may repeat) and the distinct tokens longer than two letters."""
    phrases = [p for p in (_plain_words(q) for q in queries) if p]
    tokens = sorted({t for p in phrases for t in p.split() if len(t) > 2})
    return phrases, tokens


def _points(hit: Column, points: int) -> Column:
    return F.when(hit, points).otherwise(0)


def _sum(columns) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + c
    return total


def query_match_score(padded: Column, queries) -> Column:
    """10 for each contained query phrase plus 1 for each distinct contained token.

    ``padded`` is the output of ``words``; compute it once as its own column.
    """
    phrases, tokens = _terms(queries)
    return _sum([_points(padded.contains(f" {p} "), 10) for p in phrases]
                + [_points(padded.contains(f" {t} "), 1) for t in tokens])


def match_specificity(padded: Column, queries) -> Column:
    """Length of the longest matched phrase or token."""
    phrases, tokens = _terms(queries)
    lengths = [_points(padded.contains(f" {t} "), len(t)) for t in sorted({*phrases, *tokens})]
    return F.greatest(F.lit(0), F.lit(0), *lengths)


def attribute_track(padded: Column, tracks: dict) -> Column:
    """The track with most hits, then the longest matched term, then the smallest id.

    Struct of ``track`` and ``hits``; null track when nothing matched.
    """
    ranked = [F.when(query_match_score(padded, q) > 0, F.struct(
        (-query_match_score(padded, q)).alias("hits"),
        (-match_specificity(padded, q)).alias("specificity"),
        F.lit(track).alias("track"))) for track, q in tracks.items()]
    best = F.array_min(F.array(*ranked))
    return F.struct(best["track"].alias("track"),
                    F.coalesce(-best["hits"], F.lit(0)).alias("hits"))


def legacy_score(title_hits: Column, body_hits: Column) -> Column:
    """Title hits weigh tenfold, body hits are capped."""
    return title_hits * V.TITLE_WEIGHT + F.least(body_hits, F.lit(V.BODY_CAP))


def overall_score(technical: Column, experience: Column, behavioral: Column,
                  career: Column) -> Column:
    w = V.OVERALL_WEIGHTS
    raw = (technical * w["technical"] + experience * w["experience"]
           + behavioral * w["behavioral"] + career * w["career"])
    return tenths(raw)


def tenths(x: Column) -> Column:
    """A double of 0 or more to one place: its exact binary value decides, a true tie goes even.

    The fraction is a whole number of 2^-52 for values from 1, so integers carry it exactly.
    """
    x = x.cast("double")
    scaled = ((x - F.floor(x)) * float(1 << 52)).cast("bigint") * 10
    digit, rest = F.shiftright(scaled, 52), scaled.bitwiseAND((1 << 52) - 1)
    half = 1 << 51
    up = (rest > half) | ((rest == half) & (digit % 2 == 1))
    return (F.floor(x) * 10 + digit + up.cast("int")) / F.lit(10.0)


def band(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for floor, name in V.OVERALL_BANDS:
        out = out.when(score >= floor, name)
    return out.otherwise(V.LOWEST_BAND)


def technical_score(body: Column, strong=V.STRONG_SKILLS, moderate=V.MODERATE_SKILLS) -> Column:
    """Share of "required" clauses that name a known skill; keyword count without such a clause."""
    low = F.lower(body)
    clauses = F.regexp_extract_all(low, F.lit("(?i)" + V.REQUIRED_CLAUSE), F.lit(0))
    strong_rx, moderate_rx = any_of(strong), any_of(moderate)
    earned = F.aggregate(
        clauses, F.lit(0.0),
        lambda acc, s: acc + F.when(s.rlike(strong_rx), 1.0).when(s.rlike(moderate_rx), 0.5)
        .otherwise(0.0))
    count = (_sum([_points(low.contains(s), 1) for s in strong])
             + _sum([_points(low.contains(s), 1) for s in moderate]) * 0.5)
    share = F.floor(F.try_divide(earned, F.size(clauses)) * 100)
    return (F.when(F.coalesce(body, F.lit("")) == "", 70)
            .when(F.size(clauses) == 0, F.least(F.lit(100), F.floor(count * 15)))
            .otherwise(F.least(F.lit(100), share)).cast("int"))


def experience_score(body: Column, rules=V.EXPERIENCE_RULES, default: int = 85) -> Column:
    """The score of the first rule that matches."""
    low = F.lower(text_or_empty(body))
    out = F.when(F.lit(False), F.lit(0))
    for pattern, score in rules:
        out = out.when(low.rlike("(?U)" + pattern), score)
    return out.otherwise(default)


def behavioral_score(body: Column) -> Column:
    low = F.lower(text_or_empty(body))
    raw = (F.lit(70) + _sum([_points(low.contains(k), 5) for k in V.BEHAVIORAL_POSITIVE])
           - _sum([_points(low.contains(k), 10) for k in V.BEHAVIORAL_NEGATIVE]))
    return F.greatest(F.lit(0), F.least(F.lit(100), raw))


def career_score(title: Column, body: Column, tracks=None) -> Column:
    """Struct of score and track label. A keyword may sit inside a longer word."""
    tracks = V.CAREER_TRACKS if tracks is None else tracks
    low_title, low_body = F.lower(text_or_empty(title)), F.lower(text_or_empty(body))

    def named(keywords):
        pattern = any_of(keywords)
        return low_title.rlike(pattern) | low_body.rlike(pattern)

    hit = F.array_compact(F.array(*[F.when(named(k), t) for t, k in sorted(tracks.items())]))
    n = F.size(hit)
    score = (F.when(n >= 2, 100).when(n == 1, 95).when(named(V.CAREER_ADJACENT), 50)
             .otherwise(30))
    return F.struct(score.alias("score"),
                    F.when(n == 0, "none").otherwise(F.array_join(hit, "+")).alias("track"))


def strengths(body: Column, experience: Column, career: Column, track: Column) -> Column:
    """The first three reasons in favour."""
    low = F.lower(text_or_empty(body))
    said = [F.when(low.contains(k), f"{k.title()} mentioned in posting")
            for k in V.STRENGTH_KEYWORDS]
    said += [F.when(experience >= 85, "Experience requirements within profile range"),
             F.when(career >= 90, F.concat(F.lit("Strong career alignment with track "), track))]
    return F.slice(F.array_compact(F.array(*said)), 1, 3)


def gaps(technical: Column, experience: Column, earlier: Column, place_verdict: Column) -> Column:
    """The first three reasons against; gate notes come first."""
    said = F.array_compact(F.array(
        F.when(technical < 60, "Technical skills gap"),
        F.when(experience < 55, "Experience gap"),
        F.when(place_verdict == "FLAG", "Visa sponsorship likely required")))
    return F.slice(F.concat(F.coalesce(earlier, F.array().cast("array<string>")), said), 1, 3)


def missing_half(domain_matched: Column, enabler_matched: Column) -> Column:
    """Which axis a record left unanswered: ``enabler``, ``domain`` or an empty string."""
    domain, enabler = F.size(domain_matched) > 0, F.size(enabler_matched) > 0
    return (F.when(domain & ~enabler, "enabler").when(enabler & ~domain, "domain")
            .otherwise(""))


def role_signature(title: Column) -> Column:
    """Sorted distinct tokens that name the role: no grades, joining words, refs or letters."""
    text = words(title)
    for phrase, short in V.TITLE_ABBREVIATIONS:
        text = F.replace(text, F.lit(f" {phrase} "), F.lit(f" {short} "))
    tokens = F.filter(F.split(F.btrim(text), " +"),
                      lambda t: (t != "") & ~t.isin(*V.TITLE_STOPWORDS))
    role = F.filter(tokens, lambda t: ~t.isin(*V.GRADE_WORDS) & ~t.rlike(V.TITLE_REF)
                    & (F.length(t) > 1))
    return F.array_sort(F.array_distinct(F.when(F.size(role) > 0, role).otherwise(tokens)))


def jaccard_percent(left: Column, right: Column) -> Column:
    """Token-set overlap as a floored percentage; 0 when a side is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0).otherwise(
        F.floor(F.try_divide(both * 100, F.size(F.array_union(left, right))))).cast("int")


def old_career_score(title: Column) -> Column:
    """The earlier career rule, kept for calibration."""
    low = F.lower(text_or_empty(title))
    # Wording of the earlier rule.
    return (F.when(contains_any(low, ("ai ", "ai/", "artificial intelligence",
                                      "machine learning", "ml ", "data scien", "data analy",
                                      "analytics")), 100)
            .when(contains_any(low, ("software engineer", "developer")), 50).otherwise(0))


def old_experience_score(label: Column) -> Column:
    """The earlier experience rule: grades the label of the posting."""
    # Label grades of the earlier rule.
    grades = {"mid": 100, "junior": 100, "senior": 80, "lead": 60, "principal": 60, "intern": 40}
    out = F.when(F.lit(False), 0)
    for name, score in grades.items():
        out = out.when(label == name, score)
    return out.otherwise(100)


def new_career_score(title: Column, anchors: dict) -> Column:
    """The present career rule on titles: struct of score and track label."""
    low = F.lower(text_or_empty(title))
    hit = F.array_compact(F.array(*[
        F.when(contains_any(low, [a.lower() for a in terms]), track)
        for track, terms in sorted(anchors.items())]))
    n = F.size(hit)
    near = contains_any(low, ("software engineer", "devops", "data engineer"))
    return F.struct(
        F.when(n >= 2, 100).when(n == 1, 95).when(near, 50).otherwise(10).alias("score"),
        F.when(n == 0, "none").otherwise(F.array_join(hit, "+")).alias("track"))


def new_experience_score(asks_years: Column, manages_people: Column) -> Column:
    """The present experience rule: grades the stated years."""
    return (F.when(manages_people, 30).when(asks_years <= 2, 100).when(asks_years <= 4, 85)
            .when(asks_years <= 6, 55).otherwise(25))


def old_overall(technical: Column, experience: Column, career: Column) -> Column:
    return technical * 0.35 + experience * 0.30 + career * 0.35
