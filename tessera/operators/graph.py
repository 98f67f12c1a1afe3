"""Walks over a triple table: two hops, shortest paths, propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import naming
from tessera.operators import triples as T
from tessera.sources.storage import materialise


def directed(triples: DataFrame) -> DataFrame:
    """(ord, at, to, relation, from_name, to_name): each triple both ways, names along the way."""
    out = triples.select("ord", F.col("subject_key").alias("at"), F.col("object_key").alias("to"), "relation", F.col("subject").alias("from_name"), F.col("object").alias("to_name"))
    back = triples.select("ord", F.col("object_key").alias("at"), F.col("subject_key").alias("to"), "relation", F.col("object").alias("from_name"), F.col("subject").alias("to_name"))
    return out.unionByName(back)


def edges(triples: DataFrame) -> DataFrame:
    """(src, dst, relation): the multigraph on surface names, one row for each triple."""
    return triples.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "relation")


def two_hop(triples: DataFrame, entity: str, limit: int = 40, per_key: int = 5) -> DataFrame:
    """(hop, via, ord, subject, relation, object): the entity's facts, and of each neighbour the first five."""
    key = naming.canonical_entity(F.lit(entity), unaccent=not entity.isascii())
    first = T.neighbors(triples, entity, limit)
    ends = first.select(F.explode(F.array("subject_key", "object_key")).alias("via")).distinct().filter(F.col("via") != key).orderBy("via").limit(limit)
    cols = ["ord", "subject", "relation", "object"]
    sides = triples.select(F.col("subject_key").alias("at"), *cols).unionByName(triples.select(F.col("object_key").alias("at"), *cols))
    around = sides.join(F.broadcast(ends), F.col("at") == F.col("via")).select("via", *cols).distinct()  # at most ``limit`` ends
    nth = F.row_number().over(W.partitionBy("via").orderBy(*cols[:1], "subject", "relation", "object"))
    second = around.withColumn("nth", nth).filter(F.col("nth") <= per_key)
    return first.select(F.lit(1).alias("hop"), key.alias("via"), *cols).unionByName(second.select(F.lit(2).alias("hop"), "via", *cols))


def shortest_paths(triples: DataFrame, src: str, dst: str, max_hops: int = 3) -> DataFrame:
    """(path array<struct<relation, to>>, start, hops): one path for each last edge of the breadth-first tree to ``dst``.

    Every node is reached once, by the first edge in (parent's order, edge order). Levels are joins of the frontier
    with the edges of the nodes it holds; nodes seen before fall out by an anti join. Each level is written to shared
    storage, so a lost executor costs that level at most.
    """
    start, goal = (naming.canonical_entity(F.lit(x), unaccent=not x.isascii()) for x in (src, dst))
    spark = triples.sparkSession
    a, b = spark.range(1).select(start, goal).first()
    step = "array<struct<relation:string,to:string>>"
    found = spark.createDataFrame([], f"start string, path {step}, hops int")
    if a == b:
        return found
    steps = directed(triples)
    empty = F.array().cast(step)
    frontier = spark.createDataFrame([(a,)], "node string").select("node", F.array().cast("array<bigint>").alias("trail"), empty.alias("path"), F.lit(None).cast("string").alias("start"))
    seen = spark.createDataFrame([(a,)], "node string")
    for hop in range(1, max_hops + 1):
        moves = frontier.join(steps, F.col("node") == F.col("at")).select("to", F.concat("trail", F.array("ord")).alias("trail"), F.coalesce("start", "from_name").alias("start"), F.concat("path", F.array(F.struct("relation", F.col("to_name").alias("to")))).alias("path"))
        moves = materialise(moves, "moves")
        hits = moves.filter(F.col("to") == b)
        if not hits.isEmpty():
            return hits.orderBy("trail").select("start", "path", F.lit(hop).alias("hops"))
        # the numbers of the edges walked order a level's nodes: by their parents, then by edge
        best = moves.join(seen, F.col("to") == F.col("node"), "left_anti").groupBy("to").agg(F.min(F.struct("trail", "start", "path")).alias("m"))
        frontier = materialise(best.select(F.col("to").alias("node"), "m.trail", "m.path", "m.start"), "frontier")
        seen = seen.unionByName(frontier.select("node"))
    return found


def paths_between(triples: DataFrame, pairs: DataFrame, max_hops: int = 3) -> DataFrame:
    """(src, dst, trail, start, path array<struct<relation, to>>, hops) of ``pairs(src, dst)`` of keys, as ``shortest_paths`` has them.

    All sources walk at once, and a node is reached once for each source. A level ends at the edges that lead into a
    wanted target, so the last one never lists what else its nodes are tied to; the level before it goes to nodes next
    to a wanted target only. What is left out lies on no shortest path, so the paths are the same, and a hub is expanded
    towards its targets' neighbours instead of to all it is tied to. Pairs of one key have no path.
    """
    step = "array<struct<relation:string,to:string>>"
    steps = directed(triples)
    moved = [F.concat("trail", F.array("ord")).alias("trail"), F.coalesce("start", "from_name").alias("start"), F.concat("path", F.array(F.struct("relation", F.col("to_name").alias("to")))).alias("path")]
    wanted = materialise(pairs.filter("src <> dst").distinct(), "wanted")
    into = materialise(steps.join(wanted.select(F.col("dst").alias("to")).distinct(), "to", "left_semi"), "into")  # edges that lead into a target
    frontier = wanted.select("src").distinct().select("src", F.col("src").alias("node"), F.array().cast("array<bigint>").alias("trail"), F.array().cast(step).alias("path"), F.lit(None).cast("string").alias("start"))
    seen = frontier.select("src", "node")
    found = None
    for hop in range(1, max_hops + 1):
        last = into.join(wanted.withColumnRenamed("dst", "to"), "to").withColumnRenamed("at", "node")  # of each source: the edges that would end its walk
        hits = frontier.join(last, ["src", "node"]).select("src", F.col("to").alias("dst"), *moved, F.lit(hop).alias("hops"))
        hits = materialise(hits, "hits")
        found = hits if found is None else found.unionByName(hits)
        if hop == max_hops:
            break
        wanted = materialise(wanted.join(hits.select("src", "dst").distinct(), ["src", "dst"], "left_anti"), "wanted")
        walked = frontier.join(wanted.select("src").distinct(), "src", "left_semi")  # sources with nothing left to find stop
        towards = steps
        if hop == max_hops - 1:  # the next node must be next to a target that its source still wants
            near = materialise(into.join(wanted.withColumnRenamed("dst", "to"), "to").select("src", F.col("at").alias("near")).distinct(), "near")
            towards = steps.join(near.select(F.col("near").alias("to")).distinct(), "to", "left_semi")
        moves = walked.join(towards, F.col("node") == F.col("at")).select("src", "to", *moved)
        if hop == max_hops - 1:
            moves = moves.join(near.withColumnRenamed("near", "to"), ["src", "to"], "left_semi")
        best = moves.join(seen.withColumnRenamed("node", "to"), ["src", "to"], "left_anti").groupBy("src", "to").agg(F.min(F.struct("trail", "start", "path")).alias("m"))
        frontier = materialise(best.select("src", F.col("to").alias("node"), "m.trail", "m.path", "m.start"), "frontier")
        seen = seen.unionByName(frontier.select("src", "node"))
    return found


def hop_distances(triples: DataFrame, src: str, max_hops: int = 3) -> DataFrame:
    """(node, hops) of every node within ``max_hops`` of the source."""
    spark = triples.sparkSession
    a = spark.range(1).select(naming.canonical_entity(F.lit(src), unaccent=not src.isascii())).first()[0]
    steps = directed(triples).select("at", "to").distinct()
    known = spark.createDataFrame([(a, 0)], "node string, hops int")
    last = known
    for hop in range(1, max_hops + 1):
        reached = last.join(steps, F.col("node") == F.col("at")).select(F.col("to").alias("node")).distinct()
        last = materialise(reached.join(known.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hops")), "level")
        known = known.unionByName(last)
    return known


def propagate(features: DataFrame, links: DataFrame) -> DataFrame:
    """One graph-convolution step: sum over neighbours and self of x_j / sqrt(d_i d_j), degrees with the loop.

    ``features(node, i, x)`` in long form, ``links(src, dst)`` directed.
    """
    nodes = features.select("node").distinct()
    loops = links.select("src", "dst").unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    degree = loops.groupBy(F.col("dst").alias("of")).agg(F.count("*").alias("d"))
    weighted = loops.join(degree.select(F.col("of").alias("src"), F.col("d").alias("ds")), "src").join(degree.select(F.col("of").alias("dst"), F.col("d").alias("dd")), "dst")
    weighted = weighted.select("src", "dst", (1 / F.sqrt(F.col("ds") * F.col("dd"))).alias("w"))
    return weighted.join(features, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node"), "i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
