"""Registry and the record table that Spark derives from ``documents``.

The driver tables hold invented prose, so gate and fact wording is added by rule: each document
becomes a posting whose title, place, date and closing clause follow from its id. Nothing is
filtered, sampled or cut: every query reads all rows and whole texts.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.axes import Category, Vocabulary
from siftline.session import spread

QUERIES, SQL = {}, {}
TODAY = "2024-03-01"


def query(name: str, sql: str = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


TITLES = (
    "Business Analyst", "Senior Data Analyst", "Supply Chain AI Specialist",
    "Machine Learning Engineer", "Lead Time Analyst", "Process Automation Manager",
    "Head of Operations", "Automation Engineer - Procurement", "AI Product Manager",
    "Software Engineer, Logistics", "Team Lead (Planning)", "Operations Excellence Analyst",
    "BI Developer", "Junior/Senior Planner", "Procurement Specialist III req1234",
    "Data Warehouse Engineer",
)
PLACES = (
    "Budapest, Hungary", "Austin, TX", "Remote", "Berlin, Germany", "Toronto, Canada", "Paris",
    "Paris, TX", "Georgia", "", "Remote (US only)", "Zürich, Switzerland", "Tokyo", "Ohio",
)
CLAUSES = (
    "We want curious people", "Fluent German is required", "English and German",
    "Hungarian is an advantage", "Minimum 5-7 years of experience delivering, ideally in finance",
    "2-3 years of experience required", "8 years of experience preferred",
    "Founded 25 years ago, we lead the market", "5 years in operations",
    "Please note there is no sponsorship available", "You must hold an EU passport",
    "No EU passport required", "We offer visa sponsorship. A valid work permit is required",
    "No longer accepting applications", "This role closes on 30 September",
    "Salary €60,000 - €80,000 per year, hybrid role", "Competitive salary and remote work",
    "There is no remote work here", "6 years of experience in the telecom sector",
    "Must be a native speaker", "Required: python and sql. Must have sap skills",
    "Only Irish applicants will be considered", "At least 4 years of python, preferably more",
)


def _pick(values, by):
    return F.get(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int"))


def postings(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("pos"), F.concat(F.lit("url:https://jobs.example.com/"), i).alias("dedup_key"),
        _pick(TITLES, i).alias("title"), F.col("source").alias("company"),
        F.concat(F.lit("https://jobs.example.com/"), i).alias("url"),
        _pick(PLACES, i).alias("location"), F.col("source").alias("portal"),
        F.date_format(F.date_sub(F.lit(TODAY).cast("date"), (i % 60).cast("int") - 2),
                      "yyyy-MM-dd").alias("date_posted"),
        F.concat("text", F.lit("\n"), _pick(CLAUSES, i), F.lit(".")).alias("description"),
        F.lit(None).cast("string").alias("description_snippet"),
        (i % 7 == 3).alias("description_truncated"), "lang")


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


POSTINGS = f"""postings AS (SELECT doc_id AS pos,
  'url:https://jobs.example.com/' || doc_id AS dedup_key,
  ({_list(TITLES)})[(doc_id % {len(TITLES)})::INT + 1] AS title, source AS company,
  'https://jobs.example.com/' || doc_id AS url,
  ({_list(PLACES)})[(doc_id % {len(PLACES)})::INT + 1] AS location, source AS portal,
  strftime(DATE '{TODAY}' - ((doc_id % 60)::INT - 2), '%Y-%m-%d') AS date_posted,
  text || chr(10) || ({_list(CLAUSES)})[(doc_id % {len(CLAUSES)})::INT + 1] || '.' AS description,
  doc_id % 7 = 3 AS cut, lang FROM documents)"""


def norm_sql(x: str) -> str:
    return (f"(' ' || trim(regexp_replace(lower(strip_accents(regexp_replace({x}, "
            "'[‐-―−－]', '-', 'g'))), '[^a-z0-9+/&-]+', ' ', 'g')) || ' ')")


def words_sql(x: str) -> str:
    return f"(' ' || trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')) || ' ')"


def axis_sql(x: str) -> str:
    return f"(' ' || trim(regexp_replace(lower({x}), '[^a-z0-9&+]+', ' ', 'g')) || ' ')"


SENTENCES = f"""pieces AS (SELECT pos, string_split_regex(title || chr(10) || description,
    '[.;!?\\n\\r•|]+') AS l FROM postings),
  raw AS (SELECT pos, unnest(l) AS s, unnest(range(len(l))) AS ord FROM pieces),
  sent AS MATERIALIZED (SELECT pos, ord, {norm_sql('s')} AS n FROM raw)"""


def any_sql(column: str, phrases) -> str:
    """Some phrase is a substring."""
    return "(" + " OR ".join("contains(" + column + ", '" + p.replace("'", "''") + "')"
                             for p in phrases) + ")"


VOCABULARY = Vocabulary(
    domain=(Category("supply_chain", ("supply chain", "logistics", "warehouse"), (),
                     ("data warehouse",)),
            Category("operations", ("operations excellence", "und die"), ("operations",)),
            Category("procurement", ("procurement", "la que"), ("planning",)),
            Category("process", ("process", "with the"), ("analyst",), ("lead time analyst",))),
    enabler=(Category("ai", ("ai", "artificial intelligence")),
             Category("automation", ("automation", "from the")),
             Category("bi", ("bi", "business intelligence", "de la")),
             Category("data_bi", (), ("data",))),
    core_tech=("machine learning engineer", "software engineer", "data warehouse engineer"))

TRACKS = {
    "T1": ("AI Engineer", "Machine Learning Engineer"),
    "T2": ("Data Analyst", "BI Developer"),
    "T3": ("AI Product Manager", "Process Automation Manager"),
    "T4": ("Supply Chain Analyst", "Procurement Specialist", "Operations Analyst"),
}


def axis_ctes() -> str:
    """The two-axis score in SQL over ``postings`` (pos, title, description)."""
    def masked(col, cat):
        for p in cat.exclude:
            col = f"replace({col}, ' {p} ', ' ')"
        return col

    def level(cat):
        t, b = masked("t", cat), masked("b", cat)
        in_title = " OR ".join(f"contains({t}, ' {p} ')" for p in (*cat.anchors, *cat.weak))
        in_body = " OR ".join(f"contains({b}, ' {p} ')" for p in cat.anchors) or "FALSE"
        return f"CASE WHEN {in_title} THEN 2 WHEN {in_body} THEN 1 ELSE 0 END AS {cat.name}"

    v = VOCABULARY
    cats = ", ".join(level(c) for c in (*v.domain, *v.enabler))

    def count(side, n):
        return " + ".join(f"({c.name} = {n})::INT" for c in side)

    strong = " OR ".join(f"{c.name} > 0" for c in v.enabler if c.name in v.strong)
    core = " OR ".join(f"contains(t, ' {m} ')" for m in v.core_tech)
    return f"""ax0 AS (SELECT *, {axis_sql("title")} AS t, {axis_sql("description")} AS b
    FROM postings),
  ax1 AS (SELECT *, {cats}, ({core}) AS core FROM ax0),
  ax2 AS (SELECT *, {count(v.domain, 2)} AS dt, {count(v.domain, 1)} AS db,
    {count(v.enabler, 2)} AS et, {count(v.enabler, 1)} AS eb, ({strong}) AS strong FROM ax1),
  ax3 AS (SELECT *, core AND NOT (dt > 0 OR db >= 2) AS pen FROM ax2),
  ax4 AS (SELECT *, NOT pen AND dt + db > 0 AND et + eb > 0 AS hybrid FROM ax3),
  ax AS (SELECT *, CASE WHEN pen THEN 0 ELSE least(dt + db, et + eb) END AS pairs,
    CASE WHEN hybrid THEN (CASE WHEN strong THEN 'strong' ELSE 'medium' END) END AS tier,
    30 * dt + 20 * et + CASE WHEN pen THEN 0 ELSE 35 * least(dt + db, et + eb) END
    + least(25, 8 * db + 5 * eb)
    + CASE WHEN hybrid AND NOT (dt > 0 AND et > 0) THEN 15 ELSE 0 END
    + CASE WHEN hybrid THEN (CASE WHEN strong AND dt > 0 THEN 40 WHEN strong THEN 28
        WHEN dt > 0 THEN 20 ELSE 14 END) ELSE 0 END
    - CASE WHEN pen THEN 60 ELSE 0 END AS score FROM ax4)"""
