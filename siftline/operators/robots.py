"""Robots rules: files to rule tables, and URLs against them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.keys import robots_regex
from siftline.functions.text import strip, text_or_empty
from siftline.operators.skew import spread_join

# Directives that make a body a rule file.
DIRECTIVES = ("user-agent", "allow", "disallow", "sitemap", "crawl-delay", "host")


def _directives(body) -> Column:
    """The agent and rule lines of a file as an array of (field, value)."""
    lines = F.split(text_or_empty(body), r"\r\n|[\n\r]", -1)
    parsed = F.transform(lines, lambda raw: strip(F.regexp_replace(raw, "#.*$", "")))
    parsed = F.filter(parsed, lambda s: s.contains(":"))
    named = F.transform(parsed, lambda s: F.struct(
        F.lower(strip(F.split_part(s, F.lit(":"), F.lit(1)))).alias("field"),
        strip(F.regexp_replace(s, "^[^:]*:", "")).alias("value")))
    return F.filter(named, lambda r: r["field"].isin("user-agent", "allow", "disallow"))


def rule_lines(files: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """(host, grp, rules): the directive lines of each group of a file, groups numbered from 1.

    An agent line after a rule line opens a group; blank lines do not. Groups are cut out between
    their first lines, so the work is linear in the file, which never leaves its row. Rules before
    any agent line belong to no group.
    """
    df = files.select(host, _directives(body).alias("rules"))
    # Each line next to the one before it: a group starts at an agent line after another line.
    field = F.col("rules.field")
    before = F.concat(F.array(F.lit("")), field)
    opens = F.transform(F.arrays_zip(field.alias("now"), before.alias("before")), lambda x, i: F.when(
        (x["now"] == "user-agent") & (x["before"] != "user-agent"), i + 1))
    df = df.withColumn("starts", F.filter(opens, lambda i: i.isNotNull()))
    ends = F.concat(F.slice("starts", F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0))),
                    F.array(F.size("rules") + 1))
    spans = F.arrays_zip(F.col("starts").alias("at"), ends.alias("to"))
    df = df.withColumn("spans", F.when(F.size("starts") > 0, spans))
    return (df.select(host, "rules", F.posexplode("spans").alias("k", "span"))
            .select(host, (F.col("k") + 1).alias("grp"), F.slice(
                "rules", F.col("span.at"), F.col("span.to") - F.col("span.at")).alias("rules")))


def confirmed(files: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """Whether a body is a rule file: empty bodies are, other texts need a directive."""
    text = text_or_empty(body)
    known = "|".join(DIRECTIVES)
    is_rules = text.rlike(rf"(?im)^[ \t]*(?:{known})[ \t]*:")
    return files.select(host, ((strip(text) == "") | is_rules).alias("confirmed"))


def rule_table(files: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """Rules as (host, agent, allow, pattern); an agent without rules keeps one null rule.

    Agents and rules of a group meet inside the group's row; there is no join.
    """
    groups = rule_lines(files, host, body)
    agents = F.array_distinct(F.transform(F.filter(
        "rules", lambda r: r["field"] == "user-agent"), lambda r: F.lower(r["value"])))
    rules = F.transform(F.filter("rules", lambda r: r["field"] != "user-agent"), lambda r: F.struct(
        (r["field"] == "allow").alias("allow"), r["value"].alias("pattern")))
    return (groups.select(host, F.explode(agents).alias("agent"), rules.alias("rules"))
            .select(host, "agent", F.explode_outer("rules").alias("rule"))
            .select(host, "agent", "rule.allow", "rule.pattern"))


def _decoded(c) -> Column:
    """Percent-decoded; a plus stays, and what cannot be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def host_rules(rules: DataFrame, agent: str, host: str = "host") -> DataFrame:
    """(host, rules): a host's rules for an agent as one array in the order they are tried.

    The agent's own group counts when it has rules, else ``*``. The longest pattern comes first,
    Disallow before Allow of one length. ``start`` is what a path must begin with; ``rx`` is null
    where that is the whole pattern, so plain rules need no regular expression. An array holds what
    one rule file holds.
    """
    own = F.col("agent") == agent.lower()
    pattern = _decoded(F.col("pattern"))
    plain = ~F.col("pattern").contains("*") & ~pattern.rlike(r"[*$]")
    rule = F.struct((-F.length(pattern)).alias("order"), F.col("allow"),
                    F.regexp_extract(pattern, r"(?s)^[^*$]*", 0).alias("start"),
                    F.when(~plain, robots_regex(F.col("pattern"))).alias("rx"))
    usable = rules.filter(F.col("pattern").isNotNull() & F.col("agent").isin(agent.lower(), "*"))
    cell = F.when(F.col("pattern") != "", rule)
    sets = usable.groupBy(host).agg(
        F.max(own).alias("_own"), F.collect_set(F.when(own, cell)).alias("_mine"),
        F.collect_set(F.when(~own, cell)).alias("_all"))
    return sets.select(host, F.sort_array(F.when(F.col("_own"), F.col("_mine")).otherwise(F.col("_all")))
                       .alias("rules"))


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str, known: DataFrame = None,
                   host: str = "host", path: str = "path", url_id: str = "url_id") -> DataFrame:
    """``urls`` with ``allowed`` for an agent: longest pattern wins, a tie disallows.

    Hosts' rules come as arrays, with whether the host's file is confirmed, in one join whose hot
    hosts are dealt over salts; the first rule of the array that fits decides inside the row. Each
    side is read once. No rule that fits allows; an unconfirmed host allows nothing.
    """
    # The query of a URL stays as it is.
    bare = F.regexp_extract(F.col(path), r"(?s)^[^?]*", 0)
    asked = F.concat(_decoded(bare), F.substring(F.col(path), F.length(bare) + 1,
                                                 F.length(F.col(path))))
    side = host_rules(rules, agent, host)
    if known is not None:
        side = side.join(known.groupBy(host).agg(F.min("confirmed").alias("_confirmed")), host,
                         "full")
    else:
        side = side.withColumn("_confirmed", F.lit(True))
    side = side.withColumnRenamed("rules", "_rules")
    met = spread_join(urls.withColumn("_asked", asked), side, [host], [F.col(url_id)], "left")
    fits = F.filter("_rules", lambda r: F.col("_asked").startswith(r["start"]) & (
        r["rx"].isNull() | F.rlike(F.col("_asked"), r["rx"])))
    verdict = F.coalesce(F.get(fits, 0)["allow"], F.lit(True))
    return (met.withColumn("allowed", verdict & F.coalesce("_confirmed", F.lit(True)))
            .select(*urls.columns, "allowed"))
