"""What can be reached in a graph, without depths: nodes that reach each other go as one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shared_dir, stored
from .catalog import LONGS, by_long, walk
from .changes import assign_ids
from .skew import salted_join

#: Searches for groups at most. What they leave ungrouped is walked node by node, with the same result.
PASSES = 4
#: Sources to a row of the result's making, at most.
OWN = 16_384


def _beside(ways: DataFrame, name: str) -> DataFrame:
    """``ways`` (``node, dst``), distinct, as a table in buckets by ``node``: rounds that join it don't move it."""
    spark = ways.sparkSession
    n = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    ways.select("node", "dst").repartition(n, "node").distinct().write.format("parquet").bucketBy(n, "node").option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    made = spark.table(table)
    made._table = table
    return made


def _colors(ways: DataFrame, pivots: DataFrame, name: str) -> DataFrame:
    """``node, color``: the least ``id`` of the ``pivots`` that lead to a node, for all nodes to which one does."""
    seen = front = stored(pivots.select("node", F.col("id").alias("color")), name)
    depth = 0
    while not front.isEmpty():
        depth += 1
        met = front.join(ways, "node").groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("color"))
        old = seen.groupBy("node").agg(F.min("color").alias("_old"))
        front = stored(met.join(old, "node", "left").where("_old IS NULL OR color < _old").select("node", "color"), name)
        seen = seen.unionByName(front)
        if depth % 8 == 0:
            seen = stored(seen.groupBy("node").agg(F.min("color").alias("color")), name)
    return stored(seen.groupBy("node").agg(F.min("color").alias("color")), name)


def _mutual(back: DataFrame, colors: DataFrame, pivots: DataFrame, name: str) -> DataFrame:
    """``node, color``: nodes that also lead to the pivot of their color. ``back``: the ways, turned round."""
    found = front = stored(pivots.select("node", F.col("id").alias("color")).join(colors, ["node", "color"], "left_semi"), name)
    depth = 0
    while not front.isEmpty():
        depth += 1
        met = front.join(back, "node").select(F.col("dst").alias("node"), "color").distinct()
        front = stored(met.join(colors, ["node", "color"], "left_semi").join(found, "node", "left_anti"), name)
        found = found.unionByName(front)
        if depth % 8 == 0:
            found = stored(found, name)
    return found


def groups(links: DataFrame, numbered: DataFrame, name: str = "groups") -> tuple[DataFrame, DataFrame]:
    """``node, group`` of every node that the sources ``numbered`` (``id, node``) reach, and the links ``src, dst`` between groups.

    Nodes of one group reach each other. A pass gives each node the least number of the sources that lead to it, and goes
    back from each such source over nodes of its number: what it meets is the whole of its group. The next pass leaves
    out the groups found. Passes end when the sources that are left fit a row of a walk, and after ``PASSES``; a group
    may then be in parts, down to single nodes.
    """
    ways = _beside(links.select(F.col("src").alias("node"), "dst").where("node IS NOT NULL AND dst IS NOT NULL AND node <> dst"), name)
    search, pivots, member, done = ways, numbered, None, None
    for step in range(PASSES):
        back = _beside(search.select(F.col("dst").alias("node"), F.col("node").alias("dst")), f"{name}-back")
        colors = _colors(search, pivots, f"{name}-colors")
        found = _mutual(back, colors, pivots, f"{name}-found")
        heads = pivots.select(F.col("id").alias("color"), F.col("node").alias("_head"))
        headed = stored(found.join(heads, "color").select("node", "_head"), f"{name}-headed")
        all_ = colors.select("node") if member is None else member.select(F.col("group").alias("node")).distinct()
        moved = stored(all_.join(headed, "node", "left").select("node", F.coalesce("_head", "node").alias("group")), f"{name}-moved")
        member = moved if member is None else stored(member.withColumnRenamed("group", "_was").join(moved.withColumnRenamed("node", "_was"), "_was").select("node", "group"), name)
        left = ways.join(moved, "node").select(F.col("group").alias("src"), F.col("dst").alias("node")).distinct()
        ways = stored(left.join(moved, "node").where("src <> group").select(F.col("src").alias("node"), F.col("group").alias("dst")).distinct(), f"{name}-ways")
        settled = headed.select(F.col("_head").alias("node")).distinct()
        done = settled if done is None else done.unionByName(settled)
        for made in (search, back):
            links.sparkSession.sql(f"DROP TABLE IF EXISTS {made._table}")
        pivots = stored(numbered.join(member, "node").groupBy(F.col("group").alias("node")).agg(F.min("id").alias("id")).join(done, "node", "left_anti"), f"{name}-pivots")
        if step + 1 == PASSES or pivots.count() <= 64 * LONGS:
            break
        rest = ways.join(done, "node", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti")
        search = _beside(rest, name)
    return member, ways.withColumnRenamed("node", "src")


def reach(links: DataFrame, sources: DataFrame, name: str = "reach") -> DataFrame:
    """``source, node``: every node that can be reached from each of ``sources`` (``node``) over ``links`` (``src, dst``), the
    source itself too. The pairs of ``closure``, without depths.

    Nodes that reach each other are reached by the same sources, so the walk, with its bits, is over groups of them, and
    what a round moves for a link doesn't grow with the sources. Groups become nodes, and bits become pairs, where the result is
    read; a node's pairs follow each other, sources in one order. A group of many nodes is dealt to parts.
    Null nodes and links are ignored.
    """
    own = sources.where("node IS NOT NULL").select("node").distinct().withColumn("_turn", F.xxhash64("node"))
    numbered = stored(assign_ids(own, ["_turn", "node"], 0).select("id", "node"), f"{name}-sources")
    member, between = groups(links, numbered, f"{name}-groups")
    starts = stored(numbered.join(member, "node").select("id", F.col("node").alias("source"), "group"), f"{name}-starts")
    heads, seen = walk(between, starts.select(F.col("group").alias("node")), name)
    at = starts.join(heads.select(F.col("node").alias("group"), F.col("id").alias("_head")), "group")
    at = at.groupBy(F.floor(F.col("_head") / 64).alias("_long"), F.floor(F.col("id") / OWN).alias("_lot"), (F.col("_head") % 64).cast("int").alias("k")).agg(F.sort_array(F.collect_list("source")).alias("own"))
    slots = stored(at.groupBy("_long", "_lot").agg(F.sort_array(F.collect_list(F.struct("k", "own"))).alias("slots")).drop("_lot"), f"{name}-slots")
    longs = stored(by_long(seen).select(F.col("node").alias("group"), "_long", "_bits"), f"{name}-longs")
    met = salted_join(member, longs, "group", most=4096, name=name).select("node", "_long", "_bits")
    told = met.join(slots, "_long").select("node", "_bits", F.inline("slots")).where(F.expr("getbit(_bits, k) = 1"))
    return told.select(F.explode("own").alias("source"), "node")
