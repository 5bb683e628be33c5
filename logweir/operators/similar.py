"""TF-IDF vectors of lines as a long table, clusters by cosine, representatives, nearest candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import special_characters
from ..tables import cut

# Words that aren't counted.
STOP = ("the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as")
MAX_SHARE = 0.95
RADIUS = 0.3


def preprocess(line: Column) -> Column:
    """Lower case, without numbers, stop words and single characters."""
    bare = F.regexp_replace(F.lower(line), r"\b\d+(?:\.\d+)?\b", "")
    return F.array_join(F.filter(F.split(bare, r"\s+"), lambda t: (F.length(t) > 1) & ~t.isin(*STOP)), " ")


def terms(lines: DataFrame, id_col: str = "id", line_col: str = "line") -> DataFrame:
    """(id, term, tf)."""
    words = F.regexp_extract_all(preprocess(F.col(line_col)), F.lit(r"(?U)(?<![\w])[A-Za-z_]\w*"), F.lit(0))
    return lines.select(F.col(id_col).alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def fit(lines: DataFrame, id_col: str = "id", line_col: str = "line") -> tuple[DataFrame, DataFrame]:
    """The weight of each term, ln((1 + n) / (1 + df)) + 1, without those in more than MAX_SHARE of the lines, and the (id, term, w) vectors of length one."""
    n = lines.count()
    counted = terms(lines, id_col, line_col)
    idf = counted.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") <= MAX_SHARE * n)
    idf = cut(idf.select("term", "df", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf")))
    return idf, transform(counted, idf)


def transform(counted: DataFrame, idf: DataFrame) -> DataFrame:
    raw = counted.join(idf, "term").select("id", "term", "df", ((1.0 + F.log("tf")) * F.col("idf")).alias("x"))
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norms, "id").select("id", "term", "df", (F.col("x") / F.col("norm")).alias("w"))


def cosines(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(a, b) of the pairs whose vectors have a cosine of least or more."""
    x, y = vectors.select(F.col("id").alias("a"), "term", F.col("w").alias("wa")), vectors.select(F.col("id").alias("b"), "term", F.col("w").alias("wb"))
    dots = pairs.join(x, "a").join(y, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return dots.where(F.col("cosine") >= least).select("a", "b")


def near_roots(vectors: DataFrame, least: float) -> DataFrame:
    """(id, root): the smallest id reachable by links of cosine least or more.

    A vector is looked up by its rarest terms only: the rest, once it is shorter than least, can't
    make a pair by itself. The vectors of a term are compared with the first of them; pairs of others only where these links
    leave them in different components, so a dense cluster costs as much as it has vectors.
    """
    nodes = vectors.select("id").distinct()
    rarest = W.partitionBy("id").orderBy(F.col("df").desc(), F.col("term"))  # the terms of one line
    rest = F.sqrt(F.sum(F.col("w") * F.col("w")).over(rarest))
    keys = cut(vectors.withColumn("rest", rest).where(F.col("rest") >= least - 1e-9).select("id", "term"))
    first = keys.groupBy("term").agg(F.min("id").alias("a"))
    star = cut(cosines(keys.join(first, "term").where("id > a").select("a", F.col("id").alias("b")).distinct(), vectors, least))
    placed = cut(keys.join(connect(nodes, star), "id"))
    split = placed.groupBy("term").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("term")
    open_ = placed.join(split, "term")
    x, y = (open_.select("term", F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    others = x.join(y, "term").where("root_a < root_b").select("a", "b").distinct()
    return connect(nodes, star.unionByName(cosines(others, vectors, least)))


def connect(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable, by passing the least label on and jumping to labels of labels until none changes."""
    both = cut(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    labels = cut(nodes.select("id", F.col("id").alias("root")))
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("low"))
        step = labels.join(near.withColumnRenamed("u", "id"), "id", "left").select("id", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = cut(step.join(jump, "root").select("id", "old", F.least("root", "next").alias("root")))
        if not after.where("old <> root").limit(1).count():
            return after.select("id", "root")
        labels = after.select("id", "root")


def cluster(lines: DataFrame, id_col: str = "id", line_col: str = "line", radius: float = RADIUS) -> DataFrame:
    """(id, label): density clusters of cosine distance radius and two lines or more, numbered by their first line; -1 for lines alone.

    With two as the least size every line with a neighbour is a core, so clusters are the components of the neighbour graph.
    Lines with equal words are one vector, told once.
    """
    told = cut(lines.select(F.col(id_col).alias("id"), preprocess(F.col(line_col)).alias("line")))
    groups = cut(told.groupBy("line").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    n = told.count()
    counted = terms(groups.select(F.col("rep").alias("id"), "line"))
    sizes = groups.select(F.col("rep").alias("id"), "n")
    idf = counted.join(sizes, "id").groupBy("term").agg(F.sum("n").alias("df")).where(F.col("df") <= MAX_SHARE * n)
    idf = cut(idf.select("term", "df", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf")))
    vectors = cut(transform(counted, idf))
    roots = near_roots(vectors, 1.0 - radius)
    crowd = roots.join(sizes, "id").groupBy("root").agg(F.sum("n").alias("n")).where("n > 1")
    labelled = crowd.select("root", (F.row_number().over(W.orderBy("root")) - 1).alias("label"))  # one row a cluster
    by_rep = roots.join(labelled, "root").select(F.col("id").alias("rep"), "label")
    return told.join(groups.select("line", "rep"), "line").join(by_rep, "rep", "left").select(F.col("id").alias(id_col), F.coalesce("label", F.lit(-1)).alias("label"))


def representatives(lines: DataFrame, labels: DataFrame, id_col: str = "id", line_col: str = "line") -> DataFrame:
    """The first line of each cluster and set of structural characters, and every line without a cluster."""
    told = lines.join(labels, id_col).select(F.col(id_col).alias("id"), F.col(line_col).alias("line"), "label", special_characters(F.col(line_col)).alias("marks"))
    first = told.where("label >= 0").groupBy("label", "marks").agg(F.min_by(F.struct("id", "line"), "id").alias("x")).select("x.id", "x.line", "label")
    return first.unionByName(told.where("label < 0").select("id", "line", "label"))


def alike(lines: DataFrame, k: int, id_col: str = "id", line_col: str = "line") -> tuple[DataFrame, DataFrame]:
    """Lines of the same words as one: (id, term, tf) of the first of each, and (id, ids) with its k smallest ids."""
    counted = terms(lines, id_col, line_col)
    bags = counted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("bag"))  # one line's terms
    first = bags.withColumn("place", F.row_number().over(W.partitionBy("bag").orderBy("id"))).where(F.col("place") <= k)
    groups = cut(first.groupBy("bag").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    return groups.select(F.col("ids")[0].alias("id"), F.explode("bag").alias("x")).select("id", "x.term", "x.tf"), groups.select(F.col("ids")[0].alias("id"), "ids")


def bounded_pairs(q: DataFrame, c: DataFrame, k: int, ids: DataFrame) -> DataFrame:
    """(q, c, cosine): every pair that can be among the k best of its query, and few others.

    q and c are vectors (id, term, df, w). A query's rarest terms come first; what the
    terms from one on can give at most is the sum of its weights times the terms'
    greatest. The k heaviest candidates of each term give each query a k-th best to
    beat; terms from which on the rest stays below it don't look up anybody, and a
    pair found by the others goes on only if it can still reach it.
    """
    most = c.groupBy("term").agg(F.max("w").alias("most"))
    heavy = W.partitionBy("term").orderBy(F.col("w").desc(), "id")
    champions = c.withColumn("place", F.row_number().over(heavy)).where(F.col("place") <= k).select("term", F.col("id").alias("c"))  # k a term, limited in each task first
    after = W.partitionBy("q").orderBy("df", "term").rowsBetween(0, W.unboundedFollowing)  # the terms of one line
    asked = q.select(F.col("id").alias("q"), "term", "df", F.col("w").alias("wq")).join(most, "term").withColumn("rest", F.sum(F.col("wq") * F.col("most")).over(after))
    asked = cut(asked.drop("most"))
    of_q = cut(asked.groupBy("q").agg(F.collect_list(F.struct("term", "wq")).alias("terms")))
    of_c = cut(c.groupBy(F.col("id").alias("c")).agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("weights")).join(ids.select(F.col("id").alias("c"), F.size("ids").alias("n")), "c"))

    def scored(pairs: DataFrame) -> DataFrame:
        dot = F.aggregate("terms", F.lit(0.0), lambda a, t: a + t["wq"] * F.coalesce(F.try_element_at("weights", t["term"]), F.lit(0.0)))
        return pairs.join(of_c, "c").join(of_q, "q").select("q", "c", "n", dot.alias("cosine"))

    seeds = scored(asked.select("q", "term").join(champions, "term").select("q", "c").distinct())
    best = F.sort_array(F.flatten(F.collect_list(F.array_repeat("cosine", F.col("n").cast("int")))), asc=False)  # k a term and query at most, k times each
    beat = seeds.groupBy("q").agg(F.coalesce(F.get(best, F.lit(k - 1)), F.lit(0.0)).alias("beat"))
    told = cut(asked.join(beat, "q").withColumn("beat", F.col("beat") - 1e-9))
    rest = told.where("rest < beat").groupBy("q").agg(F.max("rest").alias("left"))
    met = told.where("rest >= beat").select("q", "term", "wq", "beat").join(c.select("term", F.col("id").alias("c"), "w"), "term")
    found = met.groupBy("q", "c").agg(F.sum(F.col("wq") * F.col("w")).alias("part"), F.first("beat").alias("beat"))
    can = found.join(rest, "q", "left").where(F.col("part") + F.coalesce("left", F.lit(0.0)) >= F.col("beat")).select("q", "c")
    return scored(can).select("q", "c", "cosine")


def nearest(queries: DataFrame, candidates: DataFrame, idf: DataFrame, k: int = 3, id_col: str = "id", line_col: str = "line") -> DataFrame:
    """(id, rank, candidate, cosine): for each query the k candidates with the greatest cosine, ties by id. A query without known words gets the first k; others fill up with cosine 0.

    Lines of the same words are looked up once and stand for their k smallest ids.
    """
    q_terms, _ = alike(queries, 1, id_col, line_col)
    c_terms, members = alike(candidates, k, id_col, line_col)
    c = cut(transform(c_terms, idf))
    pairs = bounded_pairs(cut(transform(q_terms, idf)), c, k, members)
    ranked = W.partitionBy("q").orderBy(F.col("cosine").desc(), "c")
    found = pairs.where("cosine > 0").join(members.select(F.col("id").alias("c"), "ids"), "c").select("q", F.explode("ids").alias("c"), "cosine")
    best = cut(found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).drop("rank"))

    bag = lambda lines: terms(lines, id_col, line_col).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("bag"))
    bags = bag(queries)
    same = bags.join(bags.groupBy("bag").agg(F.min("id").alias("q")), "bag").select("id", "q")
    dots = best.join(same, "q").select(F.col("id").alias("q"), "c", "cosine")
    first = candidates.select(F.col(id_col).alias("c")).orderBy("c").limit(k).withColumn("cosine", F.lit(0.0))
    short = queries.select(F.col(id_col).alias("q")).join(dots.groupBy("q").agg(F.count("*").alias("n")), "q", "left").where(F.coalesce("n", F.lit(0)) < k).select("q")
    filled = short.join(F.broadcast(first)).join(dots.select("q", "c"), ["q", "c"], "left_anti")  # k rows
    told = dots.unionByName(filled.select("q", "c", "cosine")).withColumn("rank", F.row_number().over(ranked))
    return told.where(F.col("rank") <= k).select(F.col("q").alias(id_col), "rank", F.col("c").alias("candidate"), "cosine")
