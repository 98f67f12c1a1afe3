"""Classes of near-duplicates from candidate buckets, without listing the pairs of a bucket.

A bucket holds the nodes that share a key; its hub is its least node. First every member is checked against its hub,
and the links found give components. Two members of a bucket that are by then in one component need no check. What is
left are hubs with members outside their component: those are checked against all members of the hub in blocks of
bounded size, and a block gives one link at most for any two components it joins. So every pair that shares a bucket
is either checked or known to be connected, and a bucket of copies costs one check for each member.

Keys, hubs and components may be hot: hubs are found by aggregates that combine before the shuffle, hubs' members are
dealt by (hub, salt), and joins on a key alone are plain sort-merge joins, which Spark splits where a key is skewed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise, shuffle_partitions

Pairs = Callable[[DataFrame], DataFrame]

#: Shares that the members of a hub of many are dealt into before they meet what is known of the hub, and how many are many.
SALTS, MANY = 32, 1024
#: Sides of a block: members outside the hub's component, and members, that one task checks at once.
BLOCK_OUTSIDE, BLOCK_MEMBERS = 256, 512


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``: component is the least node it is connected with.

    Alternating large-star and small-star rounds; each round's edges are written to shared storage. A hub's edges
    meet only in sums (minima, combined before the shuffle) and in joins that Spark can split.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = None
    while not (state is None and now.isEmpty()):  # without edges there is nothing to walk
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), F.least("a", "low").alias("low"))
        # large star: neighbours above a node point to the least node it sees
        large = both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # small star: a node and its lower neighbours point to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
        before, now = now, materialise(small.filter("a <> b").distinct(), "edges")
        discard(before)
        got = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if got == state:
            break
        state = tuple(got)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def hub_members(members: DataFrame) -> DataFrame:
    """(hub, node), distinct, of the buckets in ``members(key, node)`` that hold two or more nodes; a hub is a member of its own."""
    hubs = members.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub <> top").select("key", "hub")
    return members.select("key", "node").join(hubs, "key").select("hub", "node").distinct()


def each_salt():
    return F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")


def with_sizes(members: DataFrame, least: int = 1) -> DataFrame:
    """``members(hub, salts, salt, node, component, outside)`` with the sizes of their hubs' groups, of those with outside members and ``least`` members."""
    sizes = members.groupBy("hub").agg(F.max("salts").alias("salts"), F.sum(F.col("outside").cast("long")).alias("n_outside"), F.count("*").alias("n_members")).filter(f"n_outside > 0 AND n_members >= {least}")
    return members.join(sizes.select("hub", "n_outside", "n_members", each_salt()), ["hub", "salt"])


def open_groups(buckets: DataFrame, components: DataFrame) -> DataFrame:
    """(hub, salts, salt, node, component, outside, n_outside, n_members) of the hubs whose members may hold links not yet found.

    Members that share a bucket share its hub, so the pairs of all buckets are among those of the hubs' groups, and
    there each comes once for a hub instead of once for a bucket. What is left is between members outside the hub's
    component and others; the hub itself was checked against all.
    """
    of = components.select(F.col("node").alias("of"), "component")
    large = F.broadcast(buckets.groupBy("hub").agg(F.count("*").alias("n")).filter(f"n >= {MANY}").select("hub", F.lit(SALTS).alias("many")))  # one row for MANY or more
    salts = F.coalesce("many", F.lit(1)).alias("salts")
    members = buckets.join(of, F.col("node") == F.col("of"), "left").join(large, "hub", "left").select("hub", "node", F.coalesce("component", "node").alias("component"), salts)
    members = members.withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int"))
    hubs = buckets.filter("hub = node").select("hub").join(of, F.col("hub") == F.col("of"), "left").join(large, "hub", "left").select("hub", F.coalesce("component", "hub").alias("main"), salts)
    members = members.join(hubs.select("hub", "main", each_salt()), ["hub", "salt"]).withColumn("outside", F.col("component") != F.col("main"))
    members = materialise(members.drop("main"), "members")
    groups = materialise(with_sizes(members, 3), "groups")
    discard(members)
    return groups


def dealt_blocks(groups: DataFrame, carried: DataFrame, *columns: str) -> DataFrame:
    """(hub, x, y, side, node, component, columns...): members outside (side 0) against all members (side 1), in blocks.

    A hub's outside members and its members are dealt into shares of bounded size; each pair of shares is a block.
    ``columns`` are those of ``groups`` or of ``carried(node, ...)``. A block is much work for few bytes, so the number
    of partitions is a given one, which Spark does not lower by their size.
    """
    ceil = lambda x, n: F.ceil(F.col(x) / n).cast("int")
    sized = groups.withColumn("o", ceil("n_outside", BLOCK_OUTSIDE)).withColumn("m", ceil("n_members", BLOCK_MEMBERS))
    share = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["node", "component", *(c for c in columns if c in groups.columns)]
    outside = sized.filter("outside").select("hub", share("o").alias("x"), every("m").alias("y"), F.lit(0).alias("side"), *own)
    members = sized.select("hub", every("o").alias("x"), share("m").alias("y"), F.lit(1).alias("side"), *own)
    rows = outside.unionByName(members).join(carried.select("node", *(c for c in columns if c not in groups.columns)), "node")
    return rows.select("hub", "x", "y", "side", "node", "component", *columns).repartition(shuffle_partitions(rows), "hub", "x", "y").sortWithinPartitions("hub", "x", "y", "side")


Side = tuple[list[int], list[int], list]


def each_block(batches: Iterator[pa.RecordBatch], read: Callable) -> Iterator[tuple[int, Side, Side]]:
    """(hub, outside members, members) of every block, each side as nodes, components and what was read of their columns."""
    at, sides = None, (([], [], []), ([], [], []))
    for batch in batches:
        for hub, x, y, side, node, component, *values in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (hub, x, y):
                if sides[0][0] and sides[1][0]:
                    yield at[0], *sides
                at, sides = (hub, x, y), (([], [], []), ([], [], []))
            for to, v in zip(sides[side], (node, component, read(*values))):
                to.append(v)
    if sides[0][0] and sides[1][0]:
        yield at[0], *sides


#: Pairs of sides up to which small blocks are looked at together.
TOGETHER = 16_384


def joint_blocks(blocks: Iterator[tuple[int, Side, Side]], most: int) -> Iterator[tuple]:
    """(hub, number of the block, node, component of each, and what was read) of both sides of several blocks, one side behind the other."""

    def side(held: list, k: int) -> list:
        sizes = [len(x[k][0]) for x in held]
        each = lambda i: [v for x in held for v in x[k][i]]
        return [np.repeat([x[0] for x in held], sizes), np.repeat(np.arange(len(held)), sizes), np.array(each(0)), np.array(each(1)), each(2)]

    held, n_a, n_b = [], 0, 0
    for block in blocks:
        x, y = len(block[1][0]), len(block[2][0])
        if held and (n_a + x) * (n_b + y) > most:
            yield (*side(held, 1), *side(held, 2))
            held, n_a, n_b = [], 0, 0
        held.append(block)
        n_a, n_b = n_a + x, n_b + y
    if held:
        yield (*side(held, 1), *side(held, 2))


def promising(groups: DataFrame, sketches: DataFrame, make: Callable[[], Callable]) -> DataFrame:
    """``groups`` without the members whose sketch rules out a link to any other member of another component.

    ``make()`` runs once per task and gives ``may_link(a, b, asked)``: two lists of sketches to a matrix of booleans,
    of which only those ``asked`` for count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may_link = make()
        hubs, nodes = [], []
        for found in joint_blocks(each_block(batches, lambda value: value), TOGETHER):
            hub_a, at_a, nodes_a, groups_a, a, hub_b, at_b, nodes_b, groups_b, b = found
            asked = (at_a[:, None] == at_b[None, :]) & (groups_a[:, None] != groups_b[None, :]) & (nodes_b != hub_b)[None, :]
            open_ = may_link(a, b, asked) & asked
            for hub, node, left in ((hub_a, nodes_a, open_.any(1)), (hub_b, nodes_b, open_.any(0))):
                hubs += hub[left].tolist()
                nodes += node[left].tolist()
            if len(nodes) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(nodes, pa.int64())], names=["hub", "node"])
                hubs, nodes = [], []
        yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(nodes, pa.int64())], names=["hub", "node"])

    left = dealt_blocks(groups, sketches, "sketch").mapInArrow(run, "hub long, node long").distinct()
    members = groups.drop("n_outside", "n_members").join(left, ["hub", "node"], "left_semi")
    return with_sizes(materialise(members, "members"))


#: Pairs of small blocks that are checked together, and the pairs up to which a block is small.
CHECKED, SMALL = 2048, 512


def block_links(groups: DataFrame, texts: DataFrame, make: Callable[[], tuple[Callable, Callable, Callable]]) -> DataFrame:
    """Links (a, b) that connect components of ``open_groups``: members outside with all members, in blocks.

    ``make()`` runs once per task and gives ``read(text)``, what is kept of a member; ``candidates(xs, ys)``, the
    (i, j) of two lists of those that may be linked, likely ones first; and ``check(pairs)``, whether each pair (x, y)
    is. Two members may share many hubs: their pair belongs to the least of those alone, so it is checked once. Of a
    large block, pairs that links found so far connect are left out.
    """
    groups = materialise(groups, "open")
    if groups.isEmpty():
        return groups.select(F.col("hub").alias("a"), F.col("node").alias("b"))
    hubs = groups.groupBy("node").agg(F.collect_set("hub").alias("hubs"))  # a node has as many as it has keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, candidates, check = make()
        waiting: list[tuple[Joining, list]] = []

        def links_of(blocks: list[tuple[Joining, list]]) -> list[tuple[int, int]]:
            fits = iter(check([(block.a[i], block.b[j]) for block, some in blocks for i, j in some]))
            return [link for block, some in blocks for i, j in some if next(fits) and (link := block.join(i, j))]

        def batch_of(links: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for hub, (nodes_a, groups_a, a), (nodes_b, groups_b, b) in each_block(batches, lambda outside, hubs, text: (outside, frozenset(hubs), read(text or ""))):
            block = Joining(nodes_a, groups_a, [m[2] for m in a], nodes_b, groups_b, [m[2] for m in b])
            some = [(i, j) for i, j in candidates(block.a, block.b) if groups_a[i] != groups_b[j] and (nodes_a[i] < nodes_b[j] or not b[j][0]) and min(a[i][1] & b[j][1]) == hub]
            if len(some) <= SMALL:
                waiting.append((block, some))
                if sum(len(x) for _, x in waiting) >= CHECKED or len(waiting) >= CHECKED:
                    yield from batch_of(links_of(waiting))
                    waiting = []
                continue
            at, step = 0, 64
            while at < len(some):
                left = [(i, j) for i, j in some[at : at + step] if block.apart(i, j)]
                at, step = at + step, min(2 * step, CHECKED)
                yield from batch_of(links_of([(block, left)]))
        yield from batch_of(links_of(waiting))

    return dealt_blocks(groups, hubs.join(texts, "node"), "outside", "hubs", "text").mapInArrow(run, "a long, b long").distinct()


class Joining:
    """Two sides of a block and the components that links found in it have joined."""

    def __init__(self, nodes_a: list[int], groups_a: list[int], a: list, nodes_b: list[int], groups_b: list[int], b: list):
        self.nodes_a, self.groups_a, self.a, self.nodes_b, self.groups_b, self.b = nodes_a, groups_a, a, nodes_b, groups_b, b
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def apart(self, i: int, j: int) -> bool:
        return self.root(self.groups_a[i]) != self.root(self.groups_b[j])

    def join(self, i: int, j: int) -> tuple[int, int] | None:
        """The link, if it connects what was apart."""
        x, y = self.root(self.groups_a[i]), self.root(self.groups_b[j])
        if x == y:
            return None
        self.parent[x] = y
        return min(self.nodes_a[i], self.nodes_b[j]), max(self.nodes_a[i], self.nodes_b[j])


def near_classes(buckets: DataFrame, check: Pairs, rest: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """((node, component), links (a, b)) from ``hub_members`` output.

    ``check`` keeps the linked ones of pairs (a, b); ``rest(groups)`` gives the links that are missing between the
    members of ``open_groups``. The links connect every component; they are not all links.
    """
    links = materialise(check(buckets.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))), "links")
    found = connected_components(links)
    groups = open_groups(buckets, found)
    if groups.isEmpty():
        return found, links
    more = materialise(rest(groups), "links")
    if more.isEmpty():
        return found, links
    links = links.unionByName(more)
    return connected_components(links), links
