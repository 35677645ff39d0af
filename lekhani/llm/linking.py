"""Links between rows that share a bucket, and the components that links form. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhani.llm.common import settle


#: Ids of a pool whose members are all held against each other.
POOL = 1 << 16


def components(links: DataFrame) -> DataFrame:
    """links: a, b of one type. Returns id, component (the smallest id that can be reached), for ids that have links.

    Distributed union-find by alternating stars: each node hands its larger neighbours, then its smaller ones, to the
    smallest; ends when every node hangs directly on its component's smallest. Rounds grow with the logarithm of the size.
    Each round's rows are written to the shared folder, so joins read plain tables and Spark can split hot keys; rows of
    earlier rounds are deleted.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))
        large = settle(both.join(low, "a").where("b > a and b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), edges, low)
        low = settle(large.groupBy("a").agg(F.min("b").alias("low")))
        down = large.join(low, "a").where("b <> low").select("b", "low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = settle(down.union(low.select("a", F.col("low").alias("b"))).distinct(), large, low)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return settle(edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots), edges)


def centered(rows: DataFrame) -> DataFrame:
    """Rows (bucket, id, center) of the rows (bucket, id) whose bucket holds another id; center is the bucket's smallest."""
    full = rows.groupBy("bucket").agg(F.min("id").alias("center"), F.max("id").alias("last")).where("center < last").select("bucket", "center")
    return rows.join(full.hint("shuffle_hash"), "bucket")  # few buckets hold several


def in_blocks(rest: DataFrame) -> DataFrame:
    """rest (bucket, id, parts, more columns) with i, j and side: pairs of parts of a bucket, each row in the pairs of its part with every part.

    The caller sets parts so that one has bounded rows and bytes; a bucket of any size becomes tasks of bounded size, and no
    pair of rows is formed here.
    """
    placed = rest.withColumn("own", F.pmod(F.xxhash64("id", F.lit(2)), "parts").cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spread.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("own", "other", "parts")


def link(members: DataFrame, weights: DataFrame, verify: Callable[[DataFrame], DataFrame], across: Callable[[DataFrame], DataFrame], block: int, block_weight: int) -> DataFrame:
    """Components (id, component) of the ids that are linked within a bucket. Deletes members.

    members: as `centered` returns them, settled. weights: id, n (what an id brings to a block). verify keeps the linked
    ones of distinct pairs (a, b). across takes rows (bucket, id, component, parts), for `in_blocks`, and returns distinct
    pairs (a, b) of components between which it found links.

    First each member is held against its bucket's smallest. Ids that buckets join, directly or through others, are a pool.
    Where a pool still spans several components, its members of different components are held against each other: in pools
    of up to POOL ids all of them, in larger ones those that share a bucket. So nothing that shares a bucket is missed, each
    id's data travel once for each part of a pool, and no row is made for a pair. A part has about `block` ids and `block_weight` of n.
    """
    first = settle(members.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct())
    pools = components(first)
    links = settle(verify(first), first)
    found = components(links)
    named = pools.select("id", F.col("component").alias("pool")).join(found, "id", "left").join(weights.select("id", "n"), "id")
    named = settle(named.select("id", "pool", "n", F.coalesce("component", "id").alias("component")), links, pools, found)
    span = [F.count("*").alias("m"), F.sum("n").alias("weight"), F.min("component").alias("lo"), F.max("component").alias("hi")]
    parts = F.ceil(F.greatest(F.col("m") / block, F.col("weight") / block_weight)).cast("int").alias("parts")
    sizes = settle(named.groupBy("pool").agg(*span).where("m > 2 and lo < hi"))  # a pool of two was held against each other
    small = named.join(sizes.where(F.col("m") <= POOL).select("pool", parts), "pool").select(F.col("pool").cast("string").alias("bucket"), "id", "component", "parts")
    large = members.select("bucket", "id").join(named.join(sizes.where(F.col("m") > POOL).select("pool"), "pool", "left_semi"), "id")
    spans = large.groupBy("bucket").agg(*span).where("m > 2 and lo < hi").select("bucket", parts)
    large = large.join(spans, "bucket").select(F.concat(F.lit("bucket "), F.col("bucket").cast("string")).alias("bucket"), "id", "component", "parts")
    rest = settle(small.union(large), members, sizes)
    joined = components(settle(across(rest), rest))
    out = named.select("id", "component").join(joined.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left")
    return settle(out.select("id", F.coalesce("root", "component").alias("component")), named, joined)
