"""Property graphs: nodes (id, type, ...), edges (src, dst, type, ...), at most one edge for each ordered pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.storage import written

from .relational import last_wins


def keyed_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge for each ordered pair, the last by order."""
    return last_wins(edges, ["src", "dst"], [order])


def type_counts(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy(F.lit(kind).alias("what"), F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): ends of edges at each node; a loop counts twice, a node without edges 0."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_centrality(nodes: DataFrame, edges: DataFrame, top: int | None = 10) -> DataFrame:
    """(id, degree, centrality) with degree / (n - 1), or 1 for a single node."""
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    out = degrees(nodes, edges).join(F.broadcast(n), how="cross")  # one row
    out = out.select("id", "degree", F.coalesce(F.try_divide(F.col("degree").cast("double"), F.col("n_nodes") - 1), F.lit(1.0)).alias("centrality"))
    return out.orderBy(F.desc("centrality"), "id").limit(top) if top else out


def one_hop(edges: DataFrame, node: str) -> DataFrame:
    """(id, type, direction) of a node's direct neighbours."""
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("id"), "type", F.lit("out").alias("direction"))
    return out.unionByName(edges.where(F.col("dst") == node).select(F.col("src").alias("id"), "type", F.lit("in").alias("direction")))


def closure(edges: DataFrame, start: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """(root, id, depth, via): everything that can be reached from the start nodes (id), by fewest steps; the start itself at depth 0.

    One join a level: the frontier meets the edges, and what was seen before goes. via is the smallest parent. Without
    max_depth it goes on until nothing new is reached.
    """
    seen = written(start.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")).distinct(), "closure")
    frontier, depth = seen, 0
    levels = [seen]
    links = written(edges.select(F.col("src"), F.col("dst")).distinct(), "links")  # once, not at every level
    while max_depth is None or depth < max_depth:
        depth += 1
        visited = reduce(DataFrame.unionByName, levels)
        step = frontier.join(links, frontier["id"] == links["src"]).groupBy("root", "dst").agg(F.min("id").alias("via"))
        step = step.select("root", F.col("dst").alias("id"), F.lit(depth).alias("depth"), "via").join(visited.select("root", "id"), ["root", "id"], "left_anti")
        frontier = written(step, "closure")
        if frontier.isEmpty():
            break
        levels.append(frontier)
        if len(levels) > 16:  # the plan stays small however deep the graph is
            levels = [written(reduce(DataFrame.unionByName, levels), "closure")]
    return reduce(DataFrame.unionByName, levels)


def dependencies(nodes: DataFrame, edges: DataFrame, component: str, *, direction: str = "both", transitive: bool = False) -> DataFrame:
    """(id, name, type, relationship, direction, depth, via, error) of a component's neighbours, or of everything below and above it.

    relationship is the type of the edge by which it is reached, via the node at that edge's other end. An unknown
    component gives one row with error alone. Nodes that the graph knows by edges only have type 'unknown'.
    """
    if direction not in ("in", "out", "both"):
        raise ValueError(f"unknown direction: {direction}")
    start = edges.sparkSession.createDataFrame([(component,)], "id string")
    parts = []
    for way, e in (("out", edges.select("src", "dst", "type")), ("in", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))):
        if direction in (way, "both"):
            reached = closure(e, start, max_depth=None if transitive else 1).where("depth > 0")
            kind = e.groupBy(F.col("src").alias("via"), F.col("dst").alias("id")).agg(F.min("type").alias("relationship"))
            parts.append(reached.join(kind, ["via", "id"]).withColumn("direction", F.lit(way)))
    known = nodes.groupBy("id").agg(F.min("type").alias("type"))
    out = reduce(DataFrame.unionByName, parts).join(known, "id", "left")
    name = F.regexp_extract("id", r"([^.]*)$", 1)
    out = out.select("id", name.alias("name"), F.coalesce("type", F.lit("unknown")).alias("type"), "relationship", "direction", "depth", "via", F.lit(None).cast("string").alias("error"))
    there = nodes.select("id").unionByName(edges.select(F.col("src").alias("id"))).unionByName(edges.select(F.col("dst").alias("id")))
    missing = start.join(there, "id", "left_anti").select(F.lit(f"Component {component} not found in the call graph").alias("error"))
    return out.unionByName(missing, allowMissingColumns=True)


def dependencies_of_kind(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(id, dst, type): the edges from all nodes of a kind, in one join."""
    return nodes.where(F.col("type") == kind).select("id").distinct().join(edges.select(F.col("src").alias("id"), "dst", "type"), "id")


# --- architecture from graphs
def mvc_role(name: Column, path: Column | None = None) -> Column:
    """The first of controller, model and view that a name has, or its path as a plural."""
    low, at = F.lower(name), F.lower(path) if path is not None else F.lit("")
    has = lambda word: F.contains(low, F.lit(word)) | F.coalesce(F.contains(at, F.lit(word + "s")), F.lit(False))
    return F.when(has("controller"), "controller").when(has("model"), "model").when(has("view"), "view")


def implementations(edges: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(id, n) of interfaces: distinct targets of their di_registration edges and sources of implements and inherits edges."""
    pairs = edges.where("type = 'di_registration'").select(F.col("src").alias("id"), F.col("dst").alias("impl"))
    pairs = pairs.unionByName(edges.where("type IN ('implements', 'inherits')").select(F.col("dst").alias("id"), F.col("src").alias("impl"))).distinct()
    return pairs.join(interfaces.select("id"), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def graph_patterns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, confidence, components) of the patterns that names, paths (if nodes have them) and edges show."""
    low = F.lower("id")
    has = lambda *words: F.count_if(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]))
    path = F.col("path") if "path" in nodes.columns else None
    role = lambda r: F.count_if(mvc_role(F.col("id"), path) == r)
    counts = nodes.agg(
        role("controller").alias("c"), role("model").alias("m"), role("view").alias("v"), has("repository").alias("repository"), has("service").alias("service"), has("factory").alias("factory"),
        has("controller").alias("controllers"), has("repository", "dao").alias("stores"), has("model", "entity").alias("models"),
        F.count_if(F.col("type") == "interface").alias("interfaces"), F.count_if((F.col("type") == "class") & F.contains(low, F.lit("impl"))).alias("impl"),
    )
    links = edges.agg(F.count_if(F.col("type") == "di_registration").alias("di"))
    most = implementations(edges, nodes.where("type = 'interface'")).where("n > 1").orderBy("id").limit(1).agg(F.max("n").alias("strategy"))
    one = counts.join(F.broadcast(links), how="cross").join(F.broadcast(most), how="cross")  # one row each
    tier = lambda c: F.when(F.col(c) > 2, "high").otherwise("medium")
    hit = lambda when, name, confidence, n: F.when(when, F.struct(F.lit(name).alias("name"), confidence.alias("confidence"), n.cast("long").alias("components")))
    c = lambda name: F.col(name)
    found = F.array_compact(F.array(
        hit((c("c") > 0) & (c("m") > 0) & (c("v") > 0), "MVC", F.when(F.least("c", "m", "v") > 2, "high").otherwise("medium"), c("c") + c("m") + c("v")),
        hit(c("repository") > 0, "Repository Pattern", tier("repository"), c("repository")),
        hit(c("service") > 0, "Service Pattern", tier("service"), c("service")),
        hit(c("factory") > 0, "Factory Pattern", F.lit("medium"), c("factory")),
        hit(c("di") > 0, "Dependency Injection", F.lit("high"), c("di")),
        hit(c("strategy") > 1, "Strategy Pattern", tier("strategy"), c("strategy")),
        hit((c("controllers") > 0) & (c("service") > 0) & ((c("stores") > 0) | (c("models") > 0)), "Layered Architecture", F.lit("high"), c("controllers") + c("service")),
        hit((c("interfaces") > 5) & (c("impl") > 5), "Hexagonal/Clean Architecture", F.lit("medium"), c("interfaces")),
    ))
    return one.select(F.explode(found).alias("p")).select("p.*")
