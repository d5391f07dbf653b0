"""Graph operators over typed, weighted edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.sources.shared import written


def neighbor_trust(edges: DataFrame, anchors: DataFrame, types: tuple[str, ...] = ()) -> DataFrame:
    """Neighbours of the anchors (uid) over edges of either direction (of ``types``, if given), none of them an anchor, with their best confidence."""
    edges = edges.filter(F.col("edge_type").isin(*types)) if types else edges
    out = edges.join(anchors.withColumnRenamed("uid", "source_uid"), "source_uid", "left_semi").select(F.col("target_uid").alias("uid"), "confidence")
    back = edges.join(anchors.withColumnRenamed("uid", "target_uid"), "target_uid", "left_semi").select(F.col("source_uid").alias("uid"), "confidence")
    near = out.unionByName(back).filter("uid <> ''").join(anchors, "uid", "left_anti")
    return near.groupBy("uid").agg(F.max("confidence").alias("trust"))


def reached(edges: DataFrame, start: DataFrame, hops: int | None) -> DataFrame:
    """uid and hop (the fewest edges) of the nodes within ``hops`` directed edges of ``start`` (uid); None: as far as edges go.

    Each frontier is written to the shared folder, so that a round reads the
    last one and doesn't compute those before it again; an empty frontier ends
    the search.
    """
    seen = front = written(start.select("uid", F.lit(0).alias("hop")).distinct(), "frontier")
    hop = 0
    while hops is None or hop < max(hops, 1):
        hop += 1
        step = edges.join(front.select(F.col("uid").alias("source_uid")), "source_uid").select(F.col("target_uid").alias("uid")).distinct()
        front = written(step.join(seen, "uid", "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def k_hop(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    return reached(edges, start, hops)


def seed_clusters(refs: DataFrame, seeds: DataFrame, cap: int) -> DataFrame:
    """(seed, uid): what each seed reaches over refs (source_uid, target_uid), for the seeds whose cluster has ``cap`` cards at most.

    A seed that passes the cap is given up as soon as it does, and no further
    round follows it.
    """
    pairs = front = written(seeds.select(F.col("uid").alias("seed"), "uid").distinct(), "cluster")
    while True:
        step = front.join(refs.select(F.col("source_uid").alias("uid"), "target_uid"), "uid").select("seed", F.col("target_uid").alias("uid")).distinct()
        new = step.join(pairs, ["seed", "uid"], "left_anti")
        both = written(pairs.unionByName(new), "cluster")
        within = both.groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") <= cap).select("seed")
        front = written(new.join(within, "seed", "left_semi"), "cluster")
        pairs = written(both.join(within, "seed", "left_semi"), "cluster")
        if front.isEmpty():
            return pairs


def with_dangling(chosen: DataFrame, refs: DataFrame, rounds: int = 3) -> DataFrame:
    """``chosen`` (uid) and the targets of their refs, for ``rounds`` rounds or until none is missing."""
    held = written(chosen.select("uid").distinct(), "slice")
    for _ in range(rounds):
        lost = written(refs.join(held.select(F.col("uid").alias("source_uid")), "source_uid").select(F.col("target_uid").alias("uid")).distinct().join(held, "uid", "left_anti"), "slice")
        if lost.isEmpty():
            break
        held = held.unionByName(lost)
    return held


def stratified_seeds(cards: DataFrame, percent: float, always: DataFrame | None = None) -> DataFrame:
    """(uid) of about ``percent`` of each type's cards, by the hash of their uid, one of each type at least, and ``always``."""
    share = F.pmod(F.xxhash64("uid"), F.lit(1_000_000)) < int(percent * 10_000)
    first = cards.groupBy("type").agg(F.min_by("uid", F.xxhash64("uid")).alias("uid")).select("uid")
    out = cards.filter(share).select("uid").unionByName(first)
    return (out.unionByName(always.select("uid")) if always is not None else out).distinct()


def degrees(cards: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source_uid").alias("uid")).unionByName(edges.select(F.col("target_uid").alias("uid")))
    return cards.select("uid").join(ends.groupBy("uid").agg(F.count("*").alias("degree")), "uid", "left").select("uid", F.coalesce("degree", F.lit(0)).alias("degree"))


def dead_ends(cards: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(cards, edges).filter("degree <= 1")


def orphan_targets(edges: DataFrame, cards: DataFrame) -> DataFrame:
    """Edges whose target is no card, counted by type."""
    lost = edges.join(cards.select(F.col("uid").alias("target_uid")), "target_uid", "left_anti")
    return lost.groupBy("edge_type").agg(F.count("*").alias("n"), F.countDistinct("target_uid").alias("targets"))
