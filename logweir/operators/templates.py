"""Line templates: discovery, storage, matching, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.signature import generate_signature, tokenise
from ..functions.text import last_wins, let
from ..tables import cut
from .staging import keep_first

ANY = "<*>"
SPAN = 5
JOIN = " "  # no token holds it
LEVELS = 4  # of the tree, between one written table of states and the next


def discover_templates(lines: DataFrame, line_col: str = "line", order_col: str = "at", least: int = 2) -> DataFrame:
    """(template, position_map) of lines: those with as many tokens and the same first one make one template, with <*> where they differ.

    Lines whose number of tokens is rarer than least stay as they are; so does the first line of a rarer first token.
    """
    told = lines.select(F.col(order_col).alias("at"), tokenise(F.col(line_col)).alias("tokens")).where(F.size("tokens") > 0).select("at", "tokens", F.size("tokens").alias("n"), F.get("tokens", F.lit(0)).alias("head"))
    lengths = told.groupBy("n").agg(F.count("*").alias("of_length"))
    groups = told.groupBy("n", "head").agg(F.count("*").alias("of_group"), F.min_by("tokens", "at").alias("first")).join(lengths, "n")
    places = told.select("n", "head", F.posexplode("tokens").alias("place", "token"))
    classed = places.groupBy("n", "head", "place").agg(F.min("token").alias("low"), F.max("token").alias("high"))
    marked = classed.select("n", "head", F.struct("place", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(ANY).alias("token")).alias("x"))
    joined = marked.groupBy("n", "head").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["token"]).alias("tokens"))  # n entries
    common = groups.where((F.col("of_length") >= least) & (F.col("of_group") >= least)).select("n", "head").join(joined, ["n", "head"]).select("tokens")
    lone = groups.where((F.col("of_length") >= least) & (F.col("of_group") < least)).select(F.col("first").alias("tokens"))
    rare = told.join(lengths.where(F.col("of_length") < least), "n").select("tokens")
    wild = F.size(F.filter("tokens", lambda t: t == ANY))
    numbers = F.when(wild > 0, F.sequence(F.lit(0), wild - 1)).otherwise(F.array().cast("array<int>"))
    fields = F.map_from_entries(F.transform(numbers, lambda i: F.struct(i.alias("k"), F.concat(F.lit("unknown_field_"), i.cast("string")).alias("v"))))
    return common.unionByName(lone).unionByName(rare).select(F.array_join("tokens", " ").alias("template"), fields.alias("position_map"))


def as_table(found: DataFrame, source: str = "partitioner") -> DataFrame:
    """Discovered templates by the signature of their text; of those with one signature, the first by text stays."""
    told = found.withColumn("signature", generate_signature(F.col("template")))
    return keep_first(told, "signature", ["template"]).select("signature", "template", "position_map", F.lit(source).alias("source"), F.lit(0).cast("long").alias("hit_count"), F.lit(None).cast("string").alias("created_at"))


def build_position_map(template: str, names: list[str]) -> dict[int, str]:
    """ValueError unless there is a name for each <*>."""
    if template.split().count(ANY) != len(names):
        raise ValueError(f"{len(names)} names for {template.split().count(ANY)} places")
    return dict(enumerate(names))


def trie(templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefix tree of a template table, written: edges (node, token, child, least, most) and leaves (node and the template that ends there).

    A node is its prefix, tokens joined; least and most are the numbers of tokens
    that a line can have left behind the child, wild is how many <*> lead to it.
    """
    t = templates.select("signature", "template", "position_map", tokenise(F.col("template")).alias("t")).where(F.size("t") > 0)
    leaves = cut(t.select(F.array_join("t", JOIN).alias("node"), "signature", "template", "position_map", F.size(F.filter("t", lambda x: x != ANY)).alias("exact"), F.transform("t", lambda x: F.when(x == ANY, "￿").otherwise("")).alias("shape")))
    steps = t.select("t", F.posexplode("t").alias("k", "token"))
    prefix = lambda n: F.array_join(F.slice("t", F.lit(1), n), JOIN)
    rest = F.slice("t", F.col("k") + 2, F.size("t"))
    wild = F.size(F.filter(rest, lambda x: x == ANY))
    told = steps.select(prefix(F.col("k")).alias("node"), "token", prefix(F.col("k") + 1).alias("child"), F.size(rest).alias("least"), (F.size(rest) + (SPAN - 1) * wild).alias("most"), (F.col("k") + 1).alias("depth"), F.size(F.filter(F.slice("t", F.lit(1), F.col("k") + 1), lambda x: x == ANY)).alias("wild"))
    edges = cut(told.groupBy("node", "token", "child", "depth", "wild").agg(F.min("least").alias("least"), F.max("most").alias("most")))
    return edges, leaves


def match_templates(lines: DataFrame, templates: DataFrame, id_col: str = "id", line_col: str = "line") -> DataFrame:
    """id, signature, template and position_map of the best template of each line that has one: with most exact tokens, then the one that is exact and short earliest.

    A <*> takes one to five tokens. The lines walk the tree of templates level by
    level: a state is a line, a node and how many tokens are used, and joins the
    edges that leave the node by the line's next token or by <*>. A state from
    which no leaf can be reached with the tokens left is dropped at once; where two
    ways lead to one state, it goes on once. Edges are a table whose size Spark
    knows: small ones are broadcast, large ones shuffled, and the literal
    edges' join spreads by token. An id names one line.
    """
    edges, leaves = trie(templates)
    levels = {r.depth: r.wild for r in edges.groupBy("depth").agg(F.max("wild").alias("wild")).collect()}  # one row a level
    literal = edges.where(F.col("token") != ANY).select(F.col("node").alias("n"), "token", F.col("child").alias("to"), F.col("least").alias("low"), F.col("most").alias("high"))
    wild = edges.where(F.col("token") == ANY).select(F.col("node").alias("m"), F.col("child").alias("wto"), F.col("least").alias("wlow"), F.col("most").alias("whigh"))
    tokens = tokenise(F.col(line_col))
    states = lines.select(F.col(id_col).alias("id"), tokens.alias("l"), F.lit("").alias("node"), F.lit(0).alias("at")).where(F.size("l") > 0)
    nowhere = F.array().cast("array<struct<node:string,at:int>>")

    def reached(to: Column, at: Column, low: Column, high: Column) -> Column:
        return F.when((F.size("l") - at).between(low, high), F.struct(to.alias("node"), at.cast("int").alias("at")))

    for depth in sorted(levels):
        on = (F.col("node") == F.col("n")) & (F.get("l", F.col("at")) == F.col("token"))
        met = states.join(literal, on, "left").join(wild, F.col("node") == F.col("m"), "left")
        spans = F.transform(F.sequence(F.lit(1), F.lit(SPAN)), lambda k: reached(F.col("wto"), F.col("at") + k, F.col("wlow"), F.col("whigh")))
        ended = F.when(F.col("at") == F.size("l"), F.array(F.struct("node", "at"))).otherwise(nowhere)  # stays till the last level
        ways = F.concat(F.array(reached(F.col("to"), F.col("at") + 1, F.col("low"), F.col("high"))), F.when(F.col("wto").isNotNull() & (F.col("at") < F.size("l")), spans).otherwise(nowhere))
        states = met.select("id", "l", F.explode(F.concat(ended, F.array_compact(ways))).alias("s")).select("id", "l", "s.node", "s.at")
        if levels[depth] > 1:
            states = states.groupBy("id", "node", "at").agg(F.first("l").alias("l")).select("id", "l", "node", "at")
        if depth % LEVELS == 0:
            states = cut(states)
    met = states.where(F.col("at") == F.size("l")).join(leaves, "node")
    best = met.groupBy("id").agg(F.min_by(F.struct("signature", "template", "position_map"), F.struct((-F.col("exact")).alias("e"), "shape", "template")).alias("m"))
    return best.select(F.col("id").alias(id_col), "m.*")


def extract_values(matched: DataFrame, line_col: str = "line") -> DataFrame:
    """matched lines with ``values``, by the names in position_map: the tokens that each <*> stands for, up to the template's next token and five at most."""
    next_of = lambda t: F.transform(t, lambda x, k: F.struct(x.alias("token"), F.get(t, k + 1).alias("stop")))
    kind = "struct<at:int,wild:int,found:array<struct<k:string,v:string>>>"

    def walked(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("wild"), F.array().cast("array<struct<k:string,v:string>>").alias("found")).cast(kind)

        def taken(s: Column, step: Column) -> Column:
            ahead = F.slice(x["l"], s["at"] + 1, F.lit(SPAN))
            place = F.coalesce(F.array_position(ahead, step["stop"]), F.lit(0))
            return F.when(place > 0, F.slice(ahead, F.lit(1), (place - 1).cast("int"))).otherwise(ahead)

        def one(s: Column, step: Column) -> Column:
            span = taken(s, step)
            name = F.coalesce(F.try_element_at(x["names"], s["wild"]), F.concat(F.lit("unknown_field_"), s["wild"].cast("string")))
            more = F.when(F.size(span) > 0, F.array(F.struct(name.alias("k"), F.array_join(span, " ").alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
            wild = F.struct((s["at"] + F.size(span)).alias("at"), (s["wild"] + 1).alias("wild"), F.concat(s["found"], more).alias("found")).cast(kind)
            literal = F.struct((s["at"] + 1).alias("at"), s["wild"].alias("wild"), s["found"].alias("found")).cast(kind)
            return F.when(s["at"] >= F.size(x["l"]), s).when(step["token"] == ANY, wild).otherwise(literal)

        return F.aggregate(next_of(x["t"]), start, one, lambda s: F.map_from_entries(last_wins(s["found"])))

    line, names = F.coalesce(F.col(line_col), F.lit("")), F.coalesce("position_map", F.create_map().cast("map<int,string>"))
    told = F.struct(tokenise(line).alias("l"), tokenise(F.coalesce("template", F.lit(""))).alias("t"), names.alias("names"))
    return matched.withColumn("values", let(told, walked))
