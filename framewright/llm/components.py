"""Connected components by low-diameter decomposition.

Each round, every vertex draws an exponential shift from a hash of its number; vertex v joins the centre u with the largest
``shift(u) - distance(u, v)``, found by passing (shift, centre) along the edges for RADIUS steps; shifts are drawn from the
distribution truncated at RADIUS, so hardly a centre would reach further. A vertex with one neighbour, of a larger number, starts no
cluster: it can only join that neighbour's, so lone pairs, the ends of chains and half the leaves of a hub are contracted in any case. Clusters become the vertices of the
next round, edges between clusters its edges, and the rounds end when none is left. Assignments are then composed from
the last round back, each level being larger than the one above it, and every vertex gets the smallest id of its component.

Ids are numbered first. A shift in 16 binary places and a number share one BIGINT, so that "largest shift, then largest
number" is a plain maximum, combined before each shuffle; every vertex has an edge of cost 0 to itself, which keeps the
plan of a round linear. A hub is no single task: its messages are combined early, and links of vertices with more than
HUB_LINKS of them are joined apart, by a broadcast of the bids of these vertices, of which there are few. Links between the same two
clusters are removed each round, and the links of a round are deleted after it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import cut, discard

#: Steps that a cluster grows per round, and the bound of the shifts (6 at most, for the bits of a bid).
RADIUS = 6
#: Rate of the exponential shifts before they are truncated.
RATE = 0.3
#: Links, or members of a group, beyond which a vertex is joined by a broadcast; n links have 2 n / HUB_LINKS such vertices at most.
HUB_LINKS = 200_000
#: Bound on rounds; expected are a few times the logarithm of the vertices, so reaching it is an error.
MAX_ROUNDS = 200
#: Bits of a vertex number: 33 count within a partition, 11 name one of PARTS partitions.
NUMBER_BITS, PARTS = 44, 2048
_ONE = 1 << (NUMBER_BITS + 16)


def _start(vertex: str, seed: str) -> F.Column:
    """The vertex's own bid: 1 and its exponential shift, truncated at RADIUS, above its number; whoever hears of it can join it."""
    unit = F.shiftrightunsigned(F.xxhash64(seed, vertex), 11).cast("double") / float(1 << 53)
    shift = -F.log(1.0 - unit * (1.0 - math.exp(-RATE * RADIUS))) / RATE
    return F.shiftleft(((1.0 + shift) * 65536).cast("long"), NUMBER_BITS).bitwiseOR(F.col(vertex))


class _Apart:
    """A cut table split by whether a key has more than ``most`` rows; joins on it never shuffle the rows of such a key.

    n: rows of the table; one of no more than ``most`` rows has no such key and isn't split.
    """

    def __init__(self, rows: DataFrame, key: str, n: int, most: int):
        self.rows, self.key, self.hot = rows, key, None
        if n > most:
            hot = cut(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key))
            self.hot = None if hot.isEmpty() else F.broadcast(hot)

    def join(self, other: DataFrame, how: str = "inner") -> DataFrame:
        """A join with at most one row per key."""
        if self.hot is None:
            return self.rows.join(other, self.key, how)
        few = F.broadcast(other.join(self.hot, self.key, "left_semi"))
        return self.rows.join(self.hot, self.key, "left_anti").join(other, self.key, how).unionByName(self.rows.join(self.hot, self.key, "left_semi").join(few, self.key, how))


def decompose(edges: DataFrame, n: int, hub_links: int = HUB_LINKS) -> DataFrame:
    """(v, c): the cluster centre of each vertex of the n ``edges`` (src, dst, seed, cost), symmetric, with loops of cost 0, and cut.

    The round's seed is data and no constant of the plan, so that the code compiled for one round serves the others.
    """
    apart = _Apart(edges, "src", n, hub_links)
    ends = edges.groupBy("src").agg(F.max("seed").alias("seed"), F.count_if(F.col("src") != F.col("dst")).alias("n"), F.max("dst").alias("largest"))
    bids = ends.where("n > 1 or largest = src").select("src", _start("src", "seed").alias("bid"))
    for _ in range(RADIUS):
        sent = apart.join(bids).select("dst", (F.col("bid") - F.col("cost")).alias("bid")).where("bid >= 0")
        bids = sent.groupBy(F.col("dst").alias("src")).agg(F.max("bid").alias("bid"))
    return bids.select(F.col("src").alias("v"), F.col("bid").bitwiseAND(F.lit((1 << NUMBER_BITS) - 1)).alias("c"))


def _with_loops(links: DataFrame) -> DataFrame:
    """Distinct symmetric links (src, dst, seed) with their costs and a loop for every vertex."""
    loops = links.select("src", F.col("src").alias("dst"), "seed")
    return links.unionByName(loops).distinct().withColumn("cost", F.when(F.col("src") == F.col("dst"), F.lit(0)).otherwise(F.lit(_ONE)).cast("long"))


def components(pairs: DataFrame, a: str, b: str, hub_links: int = HUB_LINKS) -> DataFrame:
    """(member, group_id): every id that is linked to another, with the smallest id of all it is linked to, at any distance.

    pairs: one row per link, ids of one orderable type in columns a and b. Links with a null end and links of an id with
    itself count for nothing; repeated links and links in either order count once; no usable link gives no rows. Other
    columns are not read.
    """
    links = cut(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    ids = links.select(F.col("a").alias("member")).unionByName(links.select(F.col("b").alias("member"))).distinct()
    numbers = cut(ids.coalesce(PARTS).withColumn("v", F.monotonically_increasing_id()))
    number = lambda old, new: numbers.select(F.col("member").alias(old), F.col("v").alias(new))
    pair = links.join(number("a", "src"), "a").join(number("b", "dst"), "b").select("src", "dst")
    both = pair.unionByName(pair.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = cut(_with_loops(both.withColumn("seed", F.lit(0).cast("long"))))
    levels: list[DataFrame] = []
    while n := edges.count():
        if len(levels) == MAX_ROUNDS:
            raise RuntimeError(f"components: links left after {MAX_ROUNDS} rounds")
        level = cut(decompose(edges, n, hub_links))
        levels.append(level)
        at = lambda side: level.select(F.col("v").alias(side), F.col("c").alias(f"{side}_c"))
        moved = _Apart(edges, "src", n, hub_links).join(at("src")).where("cost > 0")
        # The other end may be a hub as well, which is only looked for in a table that may have one.
        moved = _Apart(cut(moved) if n > hub_links else moved, "dst", n, hub_links).join(at("dst"))
        moved = moved.select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst"), (F.col("seed") + 1).alias("seed"))
        before, edges = edges, cut(_with_loops(moved.where("src <> dst")))
        discard(before)
    if not levels:
        return links.select(F.col("a").alias("member"), F.col("b").alias("group_id"))
    root = lambda top: top.select(F.col("v").alias("c"), F.col("c").alias("root"))
    compose = lambda top, level: _Apart(level, "c", level.count(), hub_links).join(root(top), "left").select("v", F.coalesce("root", "c").alias("c"))
    roots = reduce(compose, reversed(levels))
    named = cut(roots.join(numbers, "v").select("member", "c"))
    least = named.groupBy("c").agg(F.min("member").alias("group_id"))
    return _Apart(named, "c", named.count(), hub_links).join(least).select("member", "group_id")
