"""Near-duplicate collapse within a company, exact and without per-company tasks.

Rows join, in preference order, the first leader whose role signature is similar enough, else they
become leaders. That greedy result is the lexicographically first maximal independent set of the
similarity graph: a row is a leader iff no earlier neighbour is a leader. So it needs no ordered
fold over a whole company:

1. equal signatures of a company merge first (partial aggregation; copies collapse map-side);
2. similar pairs of *distinct* signatures come from a prefix-filtered join on
   (company, rare token, size), which cannot lose a pair at the given threshold;
3. rounds decide all rows whose earlier neighbours are decided, until none is left.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import fixed_values as V
from siftline.functions.scores import jaccard_percent, role_signature
from siftline.functions.text import words
from siftline.operators.skew import spread_join
from siftline.session import cut_lineage


def _node():
    """Identity of a signature in its company; the text itself, so it cannot collide."""
    return F.concat(F.col("company_key"), F.lit("|"), F.array_join("signature", " "))


def _signature_table(rows: DataFrame) -> DataFrame:
    """One row per (company, signature) with its earliest order; empty signatures never merge."""
    return (rows.filter(F.size("signature") > 0).groupBy("company_key", "signature")
            .agg(F.min("order").alias("order"))
            .withColumn("node", _node()))


def similar_pairs(nodes: DataFrame, percent: int = V.SIMILARITY_PERCENT) -> DataFrame:
    """Pairs of distinct signatures in one company at or above the similarity.

    Two sets of sizes n <= m at Jaccard >= t share a token among the n - ceil(t n) + 1 rarest
    tokens of the one and the m - ceil(t m) + 1 rarest of the other, and m <= n / t. Sets too
    small to have a partner of another size and content drop out before the join.
    """
    tokens = nodes.select("company_key", "node", "signature",
                          F.explode("signature").alias("token"))
    rarity = tokens.groupBy("company_key", "token").agg(F.count("*").alias("rarity"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ranked = (tokens.join(rarity, ["company_key", "token"])
              .groupBy("company_key", "node")
              .agg(F.first("signature").alias("signature"),
                   F.sort_array(F.collect_list(F.struct("rarity", "token"))).alias("by_rarity"))
              .withColumn("n", F.size("signature"))
              .filter(F.col("n") * 100 >= percent * (F.col("n") + 1))
              .withColumn("rare", F.slice(F.col("by_rarity.token"), F.lit(1),
                                          prefix.cast("int")))
              .select("company_key", "node", "n", "signature", F.explode("rare").alias("token")))
    widest = F.floor(F.col("n") * 100 / percent).cast("int")
    small = ranked.select("company_key", "token", F.col("node").alias("a"),
                          F.col("signature").alias("sig_a"),
                          F.explode(F.sequence(F.col("n"), widest)).alias("n"))
    large = ranked.select("company_key", "token", F.col("node").alias("b"),
                          F.col("signature").alias("sig_b"), "n")
    pairs = (small.join(large, ["company_key", "token", "n"])
             .filter((F.col("a") != F.col("b"))
                     & (jaccard_percent(F.col("sig_a"), F.col("sig_b")) >= percent))
             .select("a", "b"))
    return (pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct())


def _jump(chain: DataFrame) -> DataFrame:
    """Every node of a forced chain points as far up as the node it points to; odd links add up.

    ``moved`` tells whether the node pointed to was part of a chain itself.
    """
    on = chain.select(F.col("node").alias("up"), F.col("up").alias("_up"),
                      F.col("odd").alias("_odd"))
    far = F.col("_up").isNotNull()
    return spread_join(chain, on, ["up"], [F.col("node")], "left").select(
        "node", F.coalesce("_up", "up").alias("up"),
        F.when(far, F.col("odd") != F.col("_odd")).otherwise(F.col("odd")).alias("odd"),
        far.alias("moved"))


def _followers(edges: DataFrame) -> DataFrame:
    """Nodes that an earlier leader absorbs, decided in rounds over ``early, late`` edges.

    A node that is late in no open edge is a leader, and its later neighbours are followers. A node
    with a single open earlier neighbour is the opposite of it. So nodes of that kind form forced
    chains, and pointer jumping takes each to the top of its chain, two jumps a write: a chain of n
    titles is decided in log4(n) writes instead of n / 2 rounds. Followers constrain nobody and
    leave with their edges. State goes to reliable storage each time, and each round only touches
    what is still open. The earliest open node is a leader, so rounds end.
    """
    still_open, decided = edges.select("early", "late"), None
    while not still_open.isEmpty():
        late = cut_lineage(still_open.groupBy("late").agg(
            F.count(F.lit(1)).alias("n"), F.min("early").alias("early")))
        tops = (still_open.select(F.col("early").alias("up")).distinct()
                .join(late.select(F.col("late").alias("up")), "up", "left_anti"))
        chain = late.filter("n = 1").select(F.col("late").alias("node"), F.col("early").alias("up"),
                                            F.lit(True).alias("odd"))
        while True:
            chain = cut_lineage(_jump(_jump(chain).drop("moved")))
            going = not chain.filter("moved").isEmpty()
            chain = chain.drop("moved")
            if not going:
                break
        known = spread_join(chain, tops.withColumn("top", F.lit(True)), ["up"], [F.col("node")])
        leaders = tops.select(F.col("up").alias("early")).unionByName(
            known.filter("NOT odd").select(F.col("node").alias("early")))
        new = cut_lineage(still_open.join(leaders, "early", "left_semi").select("late")
                          .unionByName(known.filter("odd").select(F.col("node").alias("late")))
                          .distinct())
        decided = new if decided is None else decided.unionByName(new)
        still_open = cut_lineage(
            still_open.join(new, "late", "left_anti")
            .join(new.withColumnRenamed("late", "early"), "early", "left_anti"))
    return decided


def _leaders(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The leader of every node; nodes without a similar pair lead themselves."""
    order = nodes.select("node", "order")
    edges = cut_lineage(
        pairs.join(order.withColumnsRenamed({"node": "a", "order": "oa"}), "a")
        .join(order.withColumnsRenamed({"node": "b", "order": "ob"}), "b")
        .select(F.when(F.col("oa") < F.col("ob"), F.col("a")).otherwise(F.col("b")).alias("early"),
                F.when(F.col("oa") < F.col("ob"), F.col("b")).otherwise(F.col("a")).alias("late"),
                F.least("oa", "ob").alias("early_order")))
    followers = _followers(edges)
    if followers is None:
        return nodes.select("node", F.col("node").alias("leader"))
    # A follower joins its earliest neighbour among the leaders.
    chosen = (edges.join(followers.withColumnRenamed("late", "early"), "early", "left_anti")
              .groupBy("late").agg(F.min_by("early", "early_order").alias("leader")))
    return (nodes.join(chosen, nodes["node"] == chosen["late"], "left")
            .select("node", F.coalesce("leader", "node").alias("leader")))


def collapse_near_duplicates(df: DataFrame, order, key: str = "dedup_key",
                             percent: int = V.SIMILARITY_PERCENT) -> DataFrame:
    """Add ``keeper_key`` to every row: its own key for keepers, the keeper's key otherwise.

    ``order`` lists ascending columns that end in a unique one: alerted first, then score, then
    position. Rows with an empty signature keep themselves.
    """
    rows = df.withColumns({"company_key": words(F.col("company")),
                           "signature": role_signature(F.col("title")),
                           "order": F.struct(*order)})
    # Signatures are read three times below and are the costly part: made once.
    rows = cut_lineage(rows)
    slim = rows.select(key, "company_key", "signature", "order")
    nodes = cut_lineage(_signature_table(slim))
    leaders = _leaders(nodes, similar_pairs(nodes, percent))
    # A leader node stands for its earliest row.
    first = (slim.filter(F.size("signature") > 0)
             .withColumn("node", _node())
             .groupBy("node").agg(F.min_by(key, "order").alias("first_key")))
    keeper = (leaders.join(first.withColumnRenamed("node", "leader"), "leader")
              .select("node", F.col("first_key").alias("keeper_key")))
    out = rows.withColumn("node", F.when(F.size("signature") > 0, _node()))
    return (out.join(keeper, "node", "left")
            .withColumn("keeper_key", F.coalesce("keeper_key", key))
            .drop("node", "company_key", "signature", "order"))


def near_duplicate_report(collapsed: DataFrame, key: str = "dedup_key") -> DataFrame:
    """Keepers with their siblings' places, and siblings with the keeper's title.

    Sibling lists are built from collapsed rows only; the row itself goes through one shuffle.
    """
    siblings = (collapsed.filter(F.col(key) != F.col("keeper_key"))
                .groupBy(F.col("keeper_key").alias(key))
                .agg(F.count("*").alias("siblings")))
    titles = collapsed.filter(F.col(key) == F.col("keeper_key")).select(
        F.col(key).alias("keeper_key"), F.col("title").alias("keeper_title"))
    return (collapsed.join(siblings, key, "left").join(titles, "keeper_key", "left")
            .withColumns({
                "siblings": F.coalesce("siblings", F.lit(0)),
                "duplicate_of": F.when(F.col(key) != F.col("keeper_key"),
                                       F.col("keeper_title"))})
            .drop("keeper_title"))


def also_posted(collapsed: DataFrame, key: str = "dedup_key") -> DataFrame:
    """One row per sibling under its keeper: where else the role was posted."""
    return (collapsed.filter(F.col(key) != F.col("keeper_key"))
            .select("keeper_key", F.col(key).alias("sibling_key"), "title", "location", "url"))
