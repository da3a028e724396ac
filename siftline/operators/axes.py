"""Two-axis score: business domains against technical enablers."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import fixed_values as V
from siftline.functions.text import axis_text


def _term(text: str) -> str:
    import re

    return " " + re.sub(r"[^a-z0-9&+]+", " ", str(text or "").lower()).strip() + " "


@dataclass(frozen=True)
class Category:
    """One category: anchors count anywhere, weak terms in titles only, excludes are masked."""

    name: str
    anchors: tuple = ()
    weak: tuple = ()
    exclude: tuple = ()


@dataclass(frozen=True)
class Vocabulary:
    """What the two-axis score looks for."""

    domain: tuple
    enabler: tuple
    core_tech: tuple = ()
    strong: tuple = V.STRONG_ENABLERS
    weights: dict = field(default_factory=lambda: dict(V.AXIS_WEIGHTS))


def _masked(text: Column, exclude) -> Column:
    for phrase in exclude:
        text = F.replace(text, F.lit(_term(phrase)), F.lit(" "))
    return text


def _any_term(text: Column, terms) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit = hit | text.contains(_term(t))
    return hit


def category_level(category: Category, title: Column, body: Column) -> Column:
    """2 when the title shows the category, 1 when only the body does, else 0."""
    return (F.when(_any_term(_masked(title, category.exclude),
                             (*category.anchors, *category.weak)), 2)
            .when(_any_term(_masked(body, category.exclude), category.anchors), 1)
            .otherwise(0))


def _named(levels: Column, categories, test) -> Column:
    ordered = sorted(c.name for c in categories)
    return F.array_compact(F.array(*[F.when(test(levels[n]), n) for n in ordered]))


def score_axes(df: DataFrame, vocabulary: Vocabulary, title: str = "title",
               body: str = "body", out: str = "axes") -> DataFrame:
    """Add the axis result as a struct column; a narrow step without a shuffle.

    The work is staged in projections so that every category is matched once per row.
    """
    w, v = vocabulary.weights, vocabulary
    df = df.withColumns({"_title": axis_text(F.col(title)), "_body": axis_text(F.col(body))})
    df = df.withColumns({
        "_d": F.struct(*[category_level(c, F.col("_title"), F.col("_body")).alias(c.name)
                         for c in v.domain]),
        "_e": F.struct(*[category_level(c, F.col("_title"), F.col("_body")).alias(c.name)
                         for c in v.enabler]),
        "_core": F.coalesce(*[F.when(F.col("_title").contains(_term(m)), _term(m).strip())
                              for m in v.core_tech], F.lit(None).cast("string")),
    })

    def total(side, categories, level):
        out_ = F.lit(0)
        for c in categories:
            out_ = out_ + F.when(F.col(side)[c.name] == level, 1).otherwise(0)
        return out_

    df = df.withColumns({
        "_dt": total("_d", v.domain, 2), "_db": total("_d", v.domain, 1),
        "_et": total("_e", v.enabler, 2), "_eb": total("_e", v.enabler, 1),
    })
    strong = F.lit(False)
    for c in v.enabler:
        if c.name in v.strong:
            strong = strong | (F.col("_e")[c.name] > 0)
    dt, db, et, eb = (F.col(c) for c in ("_dt", "_db", "_et", "_eb"))
    exempt = (dt > 0) | (db >= w["core_tech_exempt_min_body_domains"])
    df = df.withColumns({
        "_pen": F.col("_core").isNotNull() & ~exempt,
        "_exempt": F.col("_core").isNotNull() & exempt,
        "_bonus": F.least(F.lit(w["description_bonus_cap"]),
                          db * w["description_domain"] + eb * w["description_enabler"]),
    })
    hybrid = ~F.col("_pen") & (dt + db > 0) & (et + eb > 0)
    tier_points = F.when(strong, w["strong_hybrid_bonus"]).otherwise(w["medium_hybrid_bonus"])
    scaled = F.when(dt > 0, tier_points).otherwise(
        F.floor(tier_points * w["body_only_domain_scale"] / 100).cast("int"))
    df = df.withColumns({
        "_pairs": F.when(F.col("_pen"), 0).otherwise(F.least(dt + db, et + eb)),
        "_hidden": F.when(hybrid & ~((dt > 0) & (et > 0)), w["hidden_hybrid_bonus"]).otherwise(0),
        "_tier": F.when(hybrid, F.when(strong, "strong").otherwise("medium")),
        "_tier_points": F.when(hybrid, scaled).otherwise(0),
    })
    score = (dt * w["domain"] + et * w["enabler"] + F.col("_pairs") * w["overlap"]
             + F.col("_bonus") + F.col("_hidden") + F.col("_tier_points")
             + F.when(F.col("_pen"), w["core_tech_penalty"]).otherwise(0))
    d, e = F.col("_d"), F.col("_e")
    axes = F.struct(
        score.alias("score"),
        _named(d, v.domain, lambda x: x > 0).alias("domain_matched"),
        _named(e, v.enabler, lambda x: x > 0).alias("enabler_matched"),
        _named(d, v.domain, lambda x: x == 2).alias("domain_in_title"),
        _named(e, v.enabler, lambda x: x == 2).alias("enabler_in_title"),
        _named(d, v.domain, lambda x: x == 1).alias("domain_from_description"),
        _named(e, v.enabler, lambda x: x == 1).alias("enabler_from_description"),
        F.col("_pairs").alias("overlap_pairs"),
        (F.col("_pairs") * w["overlap"]).alias("overlap_bonus"),
        F.col("_bonus").alias("description_bonus"), F.col("_hidden").alias("hidden_hybrid_bonus"),
        F.col("_tier").alias("hybrid_tier"), F.col("_tier_points").alias("hybrid_tier_bonus"),
        F.col("_pen").alias("core_tech_penalty"), F.col("_core").alias("core_tech_marker"),
        F.col("_exempt").alias("core_tech_exempt"))
    scratch = ["_title", "_body", "_d", "_e", "_core", "_dt", "_db", "_et", "_eb", "_pen",
               "_exempt", "_bonus", "_pairs", "_hidden", "_tier", "_tier_points"]
    return df.withColumn(out, axes).drop(*scratch)


def has_signal(alerted: Column, axes: Column) -> Column:
    """Alerted rows stay; others need a match on an axis. A negative score is still a signal."""
    return alerted | (F.size(axes["domain_matched"]) > 0) | (F.size(axes["enabler_matched"]) > 0)


def overlap_share(df: DataFrame, axes: str = "axes") -> DataFrame:
    """Share of the points that came from the overlap term."""
    points = F.coalesce(F.sum(F.col(axes)["overlap_bonus"]), F.lit(0))
    total = F.coalesce(F.sum(F.greatest(F.lit(0), F.col(axes)["score"])), F.lit(0))
    return df.agg(points.alias("overlap_bonus_points"),
                  F.when(total == 0, F.lit(0.0)).otherwise(
                      F.round(F.try_divide(points * 100, total), 1))
                  .alias("overlap_bonus_share_pct"))
