"""Circular-flow search: the best ring back to each origin within a hop bound.

Every simple ring is found once, from its member of highest degree, and then
rotated to all its members. Paths therefore never run *through* a node busier
than their start: a hub with ``i`` inbound and ``o`` outbound partners is a start
of ``o`` paths, never the middle of ``i * o`` ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.operators.ranking import top_k
from lakewarden.session import cut_lineage


def _ranked_edges(transfers: DataFrame) -> DataFrame:
    """One edge per (from, to), the largest transfer, with both ends' rank.

    Only the largest of parallel transfers can be part of a best ring.
    """
    edges = (
        transfers.filter(F.col("from_acct") != F.col("to_acct"))
        .groupBy("from_acct", "to_acct")
        .agg(F.max("amount").alias("amount"))
    )
    degree = (
        edges.select("from_acct").unionAll(edges.select("to_acct")).toDF("node")
        .groupBy("node").agg(F.count("*").alias("degree"))
    )
    rank = F.struct("degree", "node").alias("rank")
    left = degree.select(F.col("node").alias("from_acct"), rank.alias("from_rank"))
    right = degree.select(F.col("node").alias("to_acct"), rank.alias("to_rank"))
    return cut_lineage(edges.join(left, "from_acct").join(right, "to_acct"))


def _best(rings: DataFrame, depth: int) -> DataFrame:
    """Largest total per origin, then the smallest path, combined on the map side."""
    key = F.struct((-F.col("total")).alias("t"), F.col("path"))
    return rings.groupBy("origin").agg(F.min(key).alias("k")).select(
        "origin",
        F.col("k.path").alias("path"),
        F.lit(depth).alias("depth"),
        (-F.col("k.t")).alias("total"),
    )


def _rotations(cycles: DataFrame, depth: int) -> DataFrame:
    """A ring as seen from each of its members."""
    spin = F.posexplode(F.col("nodes")).alias("at", "origin")
    ahead = F.slice("nodes", F.col("at") + 1, F.lit(depth))
    behind = F.slice("nodes", F.lit(1), F.col("at"))
    return cycles.select("nodes", "total", spin).select(
        "origin", F.concat(ahead, behind, F.array("origin")).alias("path"), "total"
    )


def _double_returns(edges: DataFrame) -> DataFrame:
    """Four-hop walks origin -> b -> origin -> c -> origin, the best one per origin."""
    back = edges.select(
        F.col("from_acct").alias("to_acct"), F.col("to_acct").alias("from_acct"),
        F.col("amount").alias("back"),
    )
    pairs = edges.join(back, ["from_acct", "to_acct"]).select(
        F.col("from_acct").alias("origin"), F.col("to_acct").alias("mate"),
        (F.col("amount") + F.col("back")).alias("total"),
    )
    two = top_k(pairs, ["origin"], [F.desc("total"), F.col("mate")], 2)
    return (
        two.groupBy("origin")
        .agg(
            F.count("*").alias("n"), F.min("mate").alias("b"), F.max("mate").alias("c"),
            F.sum("total").alias("total"),
        )
        .filter("n = 2")
        .select("origin", F.array("origin", "b", "origin", "c", "origin").alias("path"), "total")
    )


def _near(nodes: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """Nodes within ``steps`` edges of the given ones, in either direction."""
    for _ in range(steps):
        ahead = edges.join(nodes.toDF("from_acct"), "from_acct", "left_semi").select("to_acct")
        behind = edges.join(nodes.toDF("to_acct"), "to_acct", "left_semi").select("from_acct")
        nodes = nodes.unionAll(ahead).unionAll(behind).distinct()
    return nodes


def best_rings(
    transfers: DataFrame, min_hops: int = 3, max_hops: int = 5, simple_only: bool = False
) -> DataFrame:
    """(origin, path, depth, total) of the shortest ring per origin.

    Among rings of equal length the one with the largest total wins, then the
    smallest path. A walk may pass its origin once and go on unless
    ``simple_only``; where a shorter ring is impossible that adds exactly the
    four-hop walks over two partners. The closing hop joins on (current, start)
    and never fans out, and after each length the search keeps only paths near
    origins that have no ring yet.
    """
    if min_hops not in (2, 3):
        raise ValueError("min_hops must be 2 or 3")
    edges = _ranked_edges(transfers)
    step = edges.select(
        F.col("from_acct").alias("current"), F.col("to_acct").alias("next"),
        F.col("amount").alias("hop"), F.col("to_rank").alias("next_rank"),
    )
    closing = step.select("current", F.col("next").alias("start"), "hop")
    paths = edges.filter(F.col("from_rank") > F.col("to_rank")).select(
        F.col("from_acct").alias("start"), F.col("from_rank").alias("start_rank"),
        F.col("to_acct").alias("current"), F.array("from_acct", "to_acct").alias("nodes"),
        F.col("amount").alias("total"),
    )
    found: list[DataFrame] = []
    for depth in range(2, max_hops + 1):
        if depth >= min_hops:
            cycles = paths.join(closing, ["current", "start"]).select(
                "nodes", (F.col("total") + F.col("hop")).alias("total")
            )
            rings = _rotations(cycles, depth)
            if depth == 4 and min_hops == 3 and not simple_only:
                rings = rings.unionByName(_double_returns(edges))
            done = reduce(DataFrame.unionByName, found).select("origin") if found else None
            if done is not None:
                rings = rings.join(done, "origin", "left_anti")
            found.append(cut_lineage(_best(rings, depth)))
        if depth == max_hops:
            break
        if found:
            done = reduce(DataFrame.unionByName, found).select(F.col("origin").alias("node"))
            open_nodes = (
                edges.select(F.col("from_acct").alias("node")).distinct().join(done, "node", "left_anti")
            )
            near = cut_lineage(_near(open_nodes, edges, max_hops // 2))
            paths = paths.join(near.toDF("start"), "start", "left_semi").join(
                near.toDF("current"), "current", "left_semi"
            )
        paths = cut_lineage(
            paths.join(step, "current")
            .filter((F.col("next_rank") < F.col("start_rank")) & ~F.array_contains("nodes", F.col("next")))
            .select(
                "start", "start_rank", F.col("next").alias("current"),
                F.concat("nodes", F.array("next")).alias("nodes"),
                (F.col("total") + F.col("hop")).alias("total"),
            )
        )
    return reduce(DataFrame.unionByName, found)
