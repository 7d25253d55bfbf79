"""Discovery graphs: neighbour lists, chosen edges, connectivity, communities.

Edges are (source, target, weight, kind). Tag edges come from an equi-join on tags in which a tag is salted on one side by its own count and
replicated on the other, so no hot tag is one task. Graphs grown from a seed are bounded by ``max_nodes``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenlit.errors import ConfigError
from lumenlit.operators.search import _named
from lumenlit.session import checkpoint

#: Holders of a tag that one task joins; a tag with more is cut into as many parts as that takes.
TAG_ROWS = 20_000


def record_tags(documents: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(record_id, key, value), distinct, of the ``tag_`` arrays."""
    each = F.explode(F.flatten(F.array(*map(_named, keys))))
    return documents.select("record_id", each.alias("t")).select("record_id", "t.key", "t.value").distinct()


def _alike(tags: DataFrame, asked: DataFrame) -> DataFrame:
    """(source, target, weight): Jaccard of the tag sets of each asked record and of every record it shares a tag with, itself too."""
    sizes = tags.groupBy("record_id").agg(F.count("*").alias("n"))
    salts = tags.groupBy("key", "value").agg(F.ceil(F.count("*") / TAG_ROWS).cast("int").alias("salts")).where("salts > 1")
    salted = tags.join(salts, ["key", "value"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    left = salted.join(asked.select("record_id").distinct(), "record_id", "left_semi").select(F.col("record_id").alias("source"), "key", "value", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    right = salted.select(F.col("record_id").alias("target"), "key", "value", F.pmod(F.xxhash64("record_id"), F.col("salts")).cast("int").alias("salt"))
    shared = left.join(right, ["key", "value", "salt"]).groupBy("source", "target").agg(F.count("*").alias("both"))
    n = lambda side: sizes.select(F.col("record_id").alias(side), F.col("n").alias(f"n_{side}"))
    scored = shared.join(n("source"), "source").join(n("target"), "target")
    return scored.select("source", "target", (F.col("both") / (F.col("n_source") + F.col("n_target") - F.col("both"))).alias("weight"))


def jaccard_edges(tags: DataFrame, asked: DataFrame, limit: int = 10) -> DataFrame:
    """(source, target, weight, kind): for each asked record the ``limit`` records with the most alike tag sets."""
    return top_neighbours(_alike(tags, asked).where(F.col("source") != F.col("target")).withColumn("kind", F.lit("tags")), limit)


def all_jaccard_edges(tags: DataFrame, limit: int = 10) -> DataFrame:
    """``jaccard_edges`` that asks every record. Records with equal tag sets are one group, and only groups, named by their smallest id, are
    joined: a group behind ``limit`` + 1 others by weight and name gives no target, as each of those has its name ahead of it."""
    sets = checkpoint(tags.groupBy("record_id").agg(F.array_sort(F.collect_set(F.struct("key", "value"))).alias("tags")))
    place = F.row_number().over(W.partitionBy("tags").orderBy("record_id"))
    first = checkpoint(sets.withColumn("_p", place).where(F.col("_p") <= limit + 1).withColumn("group", F.min("record_id").over(W.partitionBy("tags"))))
    groups = first.where("_p = 1").select("group", "tags")
    named = groups.select(F.col("group").alias("record_id"), F.explode("tags").alias("t")).select("record_id", "t.key", "t.value")
    ahead = lambda target: F.row_number().over(W.partitionBy("source").orderBy(F.desc("weight"), target))
    near = _alike(named, groups.select(F.col("group").alias("record_id"))).withColumn("_p", ahead("target")).where(F.col("_p") <= limit + 1).drop("_p")
    members = first.select(F.col("group").alias("target"), F.col("record_id").alias("member"))
    best = near.join(members, "target").withColumn("_p", ahead("member")).where(F.col("_p") <= limit + 1)
    lists = best.groupBy(F.col("source").alias("group")).agg(F.array_sort(F.collect_list(F.struct("_p", "member", "weight"))).alias("list"))
    each = sets.join(groups, "tags").join(lists, "group").select(F.col("record_id").alias("source"), "list")
    others = F.slice(F.filter("list", lambda x: x["member"] != F.col("source")), 1, limit)
    return each.select("source", F.explode(others).alias("e")).select("source", F.col("e.member").alias("target"), "e.weight", F.lit("tags").alias("kind"))


def top_neighbours(edges: DataFrame, fanout: int) -> DataFrame:
    """Per source and kind the ``fanout`` heaviest targets, ties by target; loops and non-finite weights left out, duplicates keep the heavier."""
    good = edges.where((F.col("source") != F.col("target")) & ~F.isnan("weight") & (F.abs(F.col("weight")) < float("inf")))
    best = good.groupBy("source", "target", "kind").agg(F.max("weight").alias("weight"))
    place = F.row_number().over(W.partitionBy("source", "kind").orderBy(F.desc("weight"), "target"))
    return best.withColumn("_p", place).where(F.col("_p") <= fanout).select("source", "target", "weight", "kind")


def choose_edges(lists: DataFrame, nodes: DataFrame | None = None, least: float = 0.0, mutual: bool = False) -> DataFrame:
    """Undirected edges, source < target, the heavier listing kept; ``mutual`` needs both listings of one kind."""
    rows = lists.where((F.col("source") != F.col("target")) & (F.col("weight") >= least))
    if nodes is not None:
        for side in ("source", "target"):
            rows = rows.join(nodes.select(F.col("record_id").alias(side)), side, "left_semi")
    both = rows.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "kind", "weight", (F.col("source") < F.col("target")).alias("forward"))
    merged = both.groupBy("source", "target", "kind").agg(F.max("weight").alias("weight"), F.count_distinct("forward").alias("ways"))
    return (merged.where("ways = 2") if mutual else merged).select("source", "target", "weight", "kind")


def degrees(edges: DataFrame) -> DataFrame:
    """(record_id, degree): distinct neighbours over all kinds."""
    ends = edges.select(F.explode(F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))).alias("e"))
    return ends.select("e.source", "e.target").distinct().groupBy(F.col("source").alias("record_id")).agg(F.count("*").alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """(record_id, component): the smallest id that edges connect a record with. Large stars and small stars alternate, which hooks roots to
    smaller roots, so rounds grow with the logarithm of the nodes, not with the diameter; it ends only when every tree is a star."""
    down = lambda df: df.select(F.greatest("source", "target").alias("node"), F.least("source", "target").alias("low"))
    arcs = checkpoint(down(edges.where(F.col("source") != F.col("target"))).distinct())
    while not _all_stars(arcs):
        both = arcs.union(arcs.select(F.col("low").alias("node"), F.col("node").alias("low")))
        least = both.groupBy("node").agg(F.least(F.min("low"), F.col("node")).alias("root"))
        large = both.join(least, "node").where(F.col("low") > F.col("node")).select(F.col("low").alias("node"), F.col("root").alias("low")).distinct()
        root = large.groupBy("node").agg(F.min("low").alias("root"))
        moved = large.join(root, "node").where(F.col("low") != F.col("root")).select(F.col("low").alias("node"), F.col("root").alias("low"))
        arcs = checkpoint(moved.union(root).distinct())
    return arcs.select(F.col("node").alias("record_id"), F.col("low").alias("component")).union(arcs.select("low", "low").distinct())


def _all_stars(arcs: DataFrame) -> bool:
    """Every node has one root, and no root is below another."""
    ends = arcs.select(F.explode(F.array(F.struct("node", F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("low").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.sum("e.down").alias("down")).where("up > 1 OR (up = 1 AND down > 0)").isEmpty()


def label_communities(edges: list[tuple], nodes: list, passes: int = 20) -> tuple[dict, bool]:
    """(node -> community, converged) of one bounded graph, by label propagation over an array of labels.

    Node ``i`` of the sorted nodes begins with label ``i``. A pass takes the nodes in order: a node adds up the weights around it per label
    and changes at once to the lowest of the heaviest labels if that outweighs its own. Of several edges between two nodes the heaviest counts;
    loops and edges to other nodes do not. Communities are numbered in the order of their smallest member.
    """
    if passes < 1:
        raise ConfigError("there is at least one pass")
    names = sorted(set(nodes))
    place = {n: i for i, n in enumerate(names)}
    rows = [(place[a], place[b], w) for a, b, w in edges if a in place and b in place and a != b]
    ends = np.array([r[:2] for r in rows] + [r[1::-1] for r in rows], int).reshape(-1, 2)
    weights = np.array([r[2] for r in rows] * 2, float)
    order = np.lexsort((-weights, ends[:, 1], ends[:, 0]))
    ends, weights = ends[order], weights[order]
    heaviest = np.concatenate([[True], (ends[1:] != ends[:-1]).any(1)]) if len(ends) else np.zeros(0, bool)
    ends, weights = ends[heaviest], weights[heaviest]
    first = np.searchsorted(ends[:, 0], np.arange(len(names) + 1))
    label, changes = np.arange(len(names)), 1
    for _ in range(passes):
        changes = 0
        for i in range(len(names)):
            around = slice(first[i], first[i + 1])
            if around.start == around.stop:
                continue
            # Unbuffered, so sums add up in the order of the neighbours.
            found, slot = np.unique(label[ends[around, 1]], return_inverse=True)
            pull = np.zeros(len(found))
            np.add.at(pull, slot, weights[around])
            top = int(pull.argmax())
            if pull[top] > pull[found == label[i]].sum():
                label[i], changes = found[top], changes + 1
        if not changes:
            break
    _, start, group = np.unique(label, return_index=True, return_inverse=True)
    number = np.argsort(np.argsort(start))
    return {n: int(number[group[i]]) for i, n in enumerate(names)}, not changes


def reachable(edges: list[tuple], seed: str) -> set:
    """Nodes that edges connect with the seed, in a bounded graph; the seed itself always."""
    found, open_ = {seed}, {seed}
    while open_:
        open_ = {y for a, b, *_ in edges for x, y in ((a, b), (b, a)) if x in open_} - found
        found |= open_
    return found


def communities(edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """(graph, record_id, community, converged) of many graphs, each bounded by its builder; edges and nodes carry ``graph``."""

    def one(key: tuple, e: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        found, done = label_communities(list(e[["source", "target", "weight"]].itertuples(index=False, name=None)), n["record_id"].tolist())
        return pd.DataFrame({"graph": key[0], "record_id": list(found), "community": list(found.values()), "converged": done})

    kind = dict(graphs.dtypes)["record_id"]
    nodes = graphs.toDF(*graphs.columns)  # new column ids, as nodes often come from the same edges
    return edges.groupBy("graph").cogroup(nodes.groupBy("graph")).applyInPandas(one, f"graph string, record_id {kind}, community int, converged boolean")


def grow(neighbours, seed: str, depth: int = 2, fanout: int = 10, least: float = 0.0, max_nodes: int = 200) -> tuple[list[str], list[tuple]]:
    """(nodes in order of discovery, listed edges): breadth first from a seed, one job per level, never more than ``max_nodes`` nodes.
    ``neighbours``: function of a list of ids to a DataFrame (source, target, weight, kind) of bounded lists."""
    nodes, level, edges = [seed], [seed], []
    for _ in range(depth):
        if len(nodes) >= max_nodes or not level:
            break
        rows = top_neighbours(neighbours(level), fanout).where(F.col("weight") >= least).collect()  # at most max_nodes x fanout
        edges += [tuple(r) for r in rows]
        best: dict[str, float] = {}
        for r in rows:
            if r.target not in nodes:
                best[r.target] = max(best.get(r.target, r.weight), r.weight)
        level = sorted(best, key=lambda x: (-best[x], x))[: max_nodes - len(nodes)]
        nodes += level
    return nodes, edges


def filter_graph(nodes: DataFrame, edges: DataFrame, kept: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges left when only ``kept`` ids and the seed stay; degrees are counted anew, communities stay."""
    stay = nodes.join(kept.select("record_id"), "record_id", "left_semi").unionByName(nodes.where(F.col("record_id") == seed)).dropDuplicates(["record_id"])
    left = edges
    for side in ("source", "target"):
        left = left.join(stay.select(F.col("record_id").alias(side)), side, "left_semi")
    stay = stay.drop("degree").join(degrees(left), "record_id", "left").fillna({"degree": 0})
    return stay, left
