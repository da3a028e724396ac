"""The registered queries of the corpus operators: thin calls with production parameters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import (exact, html, language, mixing, near, neighbours, packing, phrases, repeats,
                          sharding, spelling, toxicity, urls)
from siftline.llm.common import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def part_of(n: int):
    """crc32 of the id as text, modulo n: the split that the contracts name."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


@query("op3_language_id")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(part_of(3) == 1, F.lit(False))
    model = language.fit(docs.filter(~held))
    found = language.predict(docs, model, keep=("doc_id",))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "cosine", "rejected")


@query("op10_exact_dedup", sql=r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of one parity of the id's checksum are the snapshot, the others come in as a batch."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    known = F.coalesce(part_of(2) == 0, F.lit(True))
    out = exact.exact_duplicates(docs.filter(~known), docs.filter(known))
    return out.withColumnRenamed("id", "doc_id")


@query("op8_minhash_near_dedup", sql=r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l
  FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(l[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS i FROM w WHERE len(l) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g)
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 75 * (min(na.n) + min(nb.n) - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles,
  least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id,
  least(d.doc_id, coalesce(min(r.b), d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id""")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    out = near.near_duplicates(table(spark, sf, "documents"))
    return out.withColumnRenamed("id", "doc_id")


@query("op4_curriculum_mix")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    rows = mixing.curriculum(table(spark, sf, "documents"), mixing.cycle((3, 1, 2)),
                             schedule=mixing.ramp)
    return mixing.in_order(rows).withColumnRenamed("id", "doc_id").drop("source")


@query("op2_min_slack_packing")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.tokenized(table(spark, sf, "documents"))
    return packing.pack(pieces).withColumnRenamed("id", "doc_id")


@query("op5_label_propagation_shards")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf, "documents"), 24)
    return rows.withColumnRenamed("id", "doc_id").withColumn("law", F.lit("rows")).withColumn(
        "grown_shard", F.lit(None).cast("int"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held = F.coalesce(part_of(5) == 0, F.lit(False))
    rows = toxicity.score(docs, table(spark, sf, "labels"), ~held)
    return rows.withColumnRenamed("id", "doc_id").withColumn("held_out", held)


@query("op7_template_html")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return html.extract(table(spark, sf, "pages")).withColumnRenamed("id", "page_id")


@query("op1_prefix_forest_ann")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    rows = neighbours.nearest_neighbours(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)
    return rows.withColumnRenamed("id", "vec_id")


@query("op6_prefix_doubling_repeats")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@query("op12_phrase_collocations", sql=r"""
WITH pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(
      coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS s FROM documents)),
f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM pieces, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k) GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w
  FROM f WHERE k >= 2 AND f >= 10),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS p,
    array_to_string(w[k + 1:], ' ') AS q
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM c)),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
    (1000000 * c.a::HUGEINT * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p
  JOIN f y ON y.lang = c.lang AND y.phrase = c.q),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase
  ORDER BY score, k) = 1),
around AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS m
  FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM c WHERE len(w) = 3) GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.m IS NULL OR 100 * o.m < 50 * b.a),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score::BIGINT AS score FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
          ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def _terms(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("op11_url_vocabulary", sql=rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in _RULES)}) t(h, p, v)),
fit AS (SELECT host, path, h || p AS rule, v FROM (SELECT DISTINCT host, path FROM u) u JOIN r
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(h || p) DESC, length(h) DESC) = 1),
hits AS (SELECT *, len(list_filter({_terms(urls.STRICT)},
    lambda t: regexp_matches(lower(host || path), '(^|[^a-z])' || t || '([^a-z]|$)'))) AS strict_hits,
  len(list_filter({_terms(urls.SOFT)},
    lambda t: regexp_matches(lower(host || path), '(^|[^a-z])' || t || '([^a-z]|$)'))) AS soft_hits
  FROM u)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN strict_hits > 0 OR soft_hits > 1
    THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_hits
FROM hits LEFT JOIN fit USING (host, path)""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf, "pages"), _RULES).withColumnRenamed("id", "page_id")


@query("op13_pivotal_spelling")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    words = spelling.long_words(table(spark, sf, "documents"))
    return spelling.spelling_variants(words)
