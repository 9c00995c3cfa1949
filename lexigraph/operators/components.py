"""Connected components by minimum labels with pointer jumping on a contracted edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..joins import salted_join
from ..scratch import Scratch

#: A node is hot if it owns more than one in so many edge ends of a round.
HOT_SHARE = 200
#: From so many edges a round on, hot nodes and labels are spread; below, the largest possible one fits a task easily.
SPREAD_FROM = 1_000_000
JUMPS = 2


def _hot(rows: DataFrame, column: str, total: int, least: int = 1000) -> DataFrame:
    """(column): values above the share: fewer than 2 * HOT_SHARE by counting, so the list is small whatever the input."""
    return rows.groupBy(column).count().filter(F.col("count") > max(least, total // HOT_SHARE)).select(column)


def _follow(rows: DataFrame, to: DataFrame, on: str, hot: DataFrame | None) -> DataFrame:
    """rows left-joined with ``to`` (one row a value of ``on``), hot values spread over many tasks."""
    return rows.join(to, on, "left") if hot is None else salted_join(rows, to, on, hot, how="left")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200, spread_from: int = SPREAD_FROM) -> DataFrame:
    """(node, component) for every node of an edge between two different nodes; component is its group's least node.

    Each round lets every node take the least label among itself and its neighbours (a map-side-combined minimum),
    shortens the labels by pointer jumping, writes them to the shared folder, and contracts the edges to the labels. A label
    that is no root yet stays joined to its own label by a contracted edge, so no link is lost. It ends when no edge joins
    two different labels, that is when no label changes.
    Rounds grow with the logarithm of the longest chain; edges shrink each round. The rounds' label tables are then
    composed from last to first, so each is read once. From ``spread_from`` edges on, nodes with many edges and labels that many
    nodes have (one label for all of a giant group) are spread over many tasks in every join.

    Null ends, self pairs and repeated or turned-round pairs link nothing new. No edges: no rows. Extra columns are ignored.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    kind = edges.select(src).schema[0].dataType
    a, b = F.col(src), F.col(dst)
    live = edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    live = scratch.keep(live, "edges0")
    rounds: list[DataFrame] = []
    sizes: list[int] = []
    while (total := live.count()) > 0:
        k = len(rounds)
        sizes.append(total)
        if k >= max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        ends = live.select(F.explode(F.array(F.struct(F.col("b").alias("node"), F.col("a").alias("least")), F.struct(F.col("a").alias("node"), F.col("a").alias("least")))).alias("e")).select("e.*")
        label = ends.groupBy("node").agg(F.min("least").alias("label"))
        spread = total >= spread_from
        if spread:
            label = scratch.keep(label, "least")  # counted and joined several times
        for _ in range(JUMPS):  # pointer jumping: label <- label of label; those that are roots need no lookup
            up = label.filter("node <> label").select(F.col("node").alias("label"), F.col("label").alias("up"))
            label = _follow(label, up, "label", _hot(label, "label", total) if spread else None).select("node", F.coalesce("up", "label").alias("label"))
        label = scratch.keep(label, f"label{k}")
        rounds.append(label)
        to, hot = label.filter("node <> label"), _hot(ends, "node", total) if spread else None
        half = _follow(live.withColumnRenamed("b", "node"), to, "node", hot).select("a", F.coalesce("label", "node").alias("b"))
        both = _follow(half.withColumnRenamed("a", "node"), to, "node", hot).select(F.coalesce("label", "node").alias("a"), "b")
        live = scratch.keep(both.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"edges{k + 1}")
        scratch.drop(f"edges{k}")
    if not rounds:
        return spark.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    final = rounds[-1].withColumnRenamed("label", "component")
    for k, earlier in reversed(list(enumerate(rounds[:-1]))):
        later = final.filter("node <> component").select(F.col("node").alias("label"), "component")
        hot = _hot(earlier, "label", sizes[k]) if sizes[k] >= spread_from else None
        final = _follow(earlier, later, "label", hot).select("node", F.coalesce("component", "label").alias("component"))
    return final
