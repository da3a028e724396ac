"""Salary sheets: wide columns to one row per company and category."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import fixed_values as V
from siftline.functions.keys import localised_number
from siftline.functions.text import either, strip

_LETTERS = "a-zæøåöäü0-9"


def _word_of(phrases) -> str:
    """A pattern for the listed words as whole words; compound ones may stand inside others."""
    return either([p if p in V.SHEET_COMPOUND else
                   f"(?<![{_LETTERS}]){p}(?![{_LETTERS}])" for p in phrases])


def header_table(spark: SparkSession, headers) -> DataFrame:
    """One row per header: position, header, kind, category. A sheet's headers, never its rows.

    Of several company or city headers the last counts; the others are dropped like ids.
    """
    kinds = (("company", V.SHEET_COMPANY), ("city", V.SHEET_CITY), ("id", V.SHEET_ID),
             ("count", V.SHEET_COUNT), ("index", V.SHEET_INDEX))
    low = F.lower(F.trim("header"))
    kind = F.coalesce(*[F.when(low.rlike(_word_of(words)), name) for name, words in kinds],
                      F.lit("plain"))
    rest = F.lower("header")
    for name, words in kinds[3:]:
        plain = either([f"(?<![{_LETTERS}]){p}(?![{_LETTERS}])" for p in words])
        rest = F.when(F.col("kind") == name, F.regexp_replace(F.lower("header"), plain, "")
                      ).otherwise(rest)
    rows = [F.struct(F.lit(i).alias("position"), F.lit(h).alias("header"))
            for i, h in enumerate(headers) if h]
    # One row of literals in one partition: no window below needs a shuffle.
    table = spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))
    return table.withColumn("kind", kind).withColumn("category", F.btrim(rest, F.lit(" _-")))


def sheet_fields(headers: DataFrame) -> DataFrame:
    """(header, position, label, kind) of the value columns, counts and indexes under one label.

    The n-th count of a category pairs with its n-th index; what finds no partner keeps its own
    name, and plain columns are indexes.
    """
    data = headers.filter(F.col("kind").isin("count", "index", "plain"))
    named = (F.col("kind") != "plain") & (F.col("category") != "")
    turn = F.row_number().over(W.partitionBy("kind", "category").orderBy("position"))
    mates = F.count("*").over(W.partitionBy("named", "category", "turn"))
    own = F.replace(F.lower("header"), F.lit(" "), F.lit("_"))
    paired = data.withColumn("named", named).withColumn("turn", turn).withColumn("mates", mates)
    return paired.select(
        "header", "position", F.when(F.col("named") & (F.col("mates") == 2), F.translate(
            "category", " -", "__")).otherwise(own).alias("label"),
        F.when(F.col("kind") == "count", "count").otherwise("index").alias("kind"))


def sheet_layout(spark: SparkSession, headers) -> dict:
    """The company and city headers and the (header, label, kind) of every value column: one job."""
    table = header_table(spark, headers)
    owners = table.filter(F.col("kind").isin("company", "city")).select(
        "header", "position", F.lit(None).cast("string").alias("label"), "kind")
    rows = sorted(sheet_fields(table).unionByName(owners).collect(), key=lambda r: r.position)
    known = {r.kind: r.header for r in rows if r.kind in ("company", "city")}
    return {"company": known.get("company"), "city": known.get("city"),
            "fields": [(r.header, r.label, r.kind) for r in rows if r.kind not in known]}


def salary_long(sheet: DataFrame) -> DataFrame:
    """Long table (company, city, category, count, index); pairs without a value are dropped.

    One narrow pass: the cells of a row become an array of structs, no unpivot and regroup.
    """
    layout = sheet_layout(sheet.sparkSession, sheet.columns)
    if layout["company"] is None:
        raise ValueError("no company column among the headers")
    company = strip(F.col(f"`{layout['company']}`").cast("string"))
    city = (F.coalesce(strip(F.col(f"`{layout['city']}`").cast("string")), F.lit(""))
            if layout["city"] else F.lit(""))
    by_category = {}
    for header, category, kind in layout["fields"]:
        by_category.setdefault(category, {})[kind] = localised_number(
            F.col(f"`{header}`").cast("string"))
    missing = F.lit(None).cast("double")
    cells = F.array(*[F.struct(
        F.lit(name).alias("category"), kinds.get("count", missing).cast("bigint").alias("count"),
        kinds.get("index", missing).alias("index")) for name, kinds in by_category.items()])
    return (sheet.filter(F.coalesce(company, F.lit("")) != "")
            .select(company.alias("company"), city.alias("city"), F.inline(cells))
            .filter(F.col("count").isNotNull() | F.col("index").isNotNull()))
