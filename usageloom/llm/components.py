"""Connected components of an edge table, by alternating large and small stars.

A large star links a node's larger neighbours to the least node around it, a small star its smaller neighbours and itself;
in turn they make every component a star around its least node, in few rounds. All work is grouped minima with partial
aggregation and joins that can be split where a hub has many edges; no component is gathered anywhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageloom.llm.shared import checkpointed, stored


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it reaches by the edges (i, j)."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _stored_least(least: DataFrame) -> DataFrame:
    """As a table that isn't dealt by its key, unlike a checkpoint: so a join with it can split a hub's edges."""
    return stored(least, "least-neighbours")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _stored_least(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge has a > b."""
    least = _stored_least(edges.groupBy("a").agg(F.min("b").alias("m")))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of edges (a, b), of any type with an order; a component's name is its least node.

    Edges with a null end and loops are ignored, repeated edges count once, and an empty table gives an empty result.
    """
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b")
    now = checkpointed(ends.distinct())
    state = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if found == state or not found[0]:
            break
        state = found
        now = checkpointed(_small_star(_large_star(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def linked_classes(rows: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (id, class_id, n_links) for rows (id, digest); other columns of rows stay, before class_id.

    distinct: (digest, id, copies), the least id and the number of rows of each digest. links: (a, b, n), where the edges
    (a, b) of digests connect every class and the n of a digest a sum to its linked rows, its own copies left out. A row
    without a digest links with nothing. What is joined is stored before: then a join can split the side of a hot digest.
    """
    classes = components(links.select("a", "b")).select(F.col("node").alias("digest"), "component")
    counted = links.groupBy(F.col("a").alias("digest")).agg(F.sum("n").alias("n"))
    info = distinct.join(classes, "digest", "left").join(counted, "digest", "left")
    n_links = F.col("copies") - 1 + F.coalesce("n", F.lit(0))
    info = stored(info.select("digest", "id", F.coalesce("component", "digest").alias("component"), n_links.alias("n_links")), "class-members")
    names = stored(info.groupBy("component").agg(F.min("id").alias("class_id")), "class-names")
    found = stored(info.join(names, "component").select("digest", "class_id", "n_links"), "classes")
    class_id = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("class_id"))
    kept = [c for c in rows.columns if c != "digest"]
    return rows.join(found, "digest", "left").select(*kept, class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
