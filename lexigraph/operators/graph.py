"""Relationships, co-occurrence, degrees, clean-up and checks of the entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_name, relation_type, slugify
from ..joins import distinct_lists, hot_values, maybe_broadcast, salted_join
from ..scratch import Scratch


def remap_relationships(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations keyed by slug, with the ids of both ends; those with an unknown end or two equal ends are dropped.

    relations: source_slug, target_slug, ...; entities: id, slug, pos. Of entities with one slug the last (by pos, id) counts.
    """
    ids = entities.groupBy("slug").agg(F.max_by("id", F.struct("pos", "id")).alias("id"))
    at = lambda end: ids.select(F.col("slug").alias(f"{end}_slug"), F.col("id").alias(f"{end}_id"))
    out = relations.join(at("source"), "source_slug").join(at("target"), "target_slug")
    return out.filter("source_id <> target_id")


def consolidate_relationships(relations: DataFrame) -> DataFrame:
    """One row a (source_id, target_id): first slugs, sorted different descriptions joined, sum of weights, all sources, top rank."""
    told = F.array_sort(F.collect_set(F.nullif(F.col("description"), F.lit(""))))
    key = ["source_id", "target_id"]
    out = relations.groupBy(*key).agg(
        F.min("source_slug").alias("source_slug"), F.min("target_slug").alias("target_slug"), F.array_join(told, " | ").alias("description"),
        F.sum("weight").alias("weight"), F.max("rank").alias("rank"),
    )
    return out.join(distinct_lists(relations, key, "source_ids"), key, "left").withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<string>")))


def drop_orphans(edges: DataFrame, nodes: DataFrame, source: str, target: str, node: str) -> DataFrame:
    known = nodes.select(F.col(node)).filter(F.col(node).isNotNull()).distinct()
    return edges.join(known.withColumnRenamed(node, source), source, "left_semi").join(known.withColumnRenamed(node, target), target, "left_semi")


def merge_edges(edges: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """One row a (source, type, target): occurrences and different evidences, added to those of an earlier table."""
    now = edges.select("source", relation_type(F.col("type")).alias("type"), "target", F.lit(1).cast("long").alias("occurrence_count"), F.array("evidence").alias("evidences"))
    rows = now if before is None else now.unionByName(before.select("source", "type", "target", "occurrence_count", "evidences"))
    key = ["source", "type", "target"]
    told = distinct_lists(rows.filter("source IS NOT NULL AND target IS NOT NULL"), key, "evidences")
    return rows.groupBy(*key).agg(F.sum("occurrence_count").alias("occurrence_count")).join(told, key, "left").withColumn("evidences", F.coalesce("evidences", F.array().cast("array<string>")))


def merge_nodes(nodes: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """One row an id: the union of its labels; labels are added, never taken away."""
    rows = nodes if before is None else nodes.unionByName(before)
    return distinct_lists(rows, ["id"], "labels")


def cooccurrences(links: DataFrame, entity: str = "entity_id", chunk: str = "chunk_id") -> DataFrame:
    """(entity_a, entity_b, co_occurrence_count): pairs named in one chunk, a < b. Pairs within a chunk: its entities squared,
    so chunks are the units of text whose size the splitter bounds; one that names far more has its pairs made in many tasks."""
    one = links.filter(F.col(entity).isNotNull() & F.col(chunk).isNotNull()).select(F.col(entity).alias("e"), F.col(chunk).alias("c")).distinct()
    one = Scratch(links.sparkSession, "cooccurrences").keep(one, "named")
    pairs = salted_join(one.withColumnRenamed("e", "entity_a"), one.withColumnRenamed("e", "entity_b"), "c", hot_values(one, "c")).filter("entity_a < entity_b")
    return pairs.groupBy("entity_a", "entity_b").agg(F.count("*").alias("co_occurrence_count"))


def shared_chunks(links: DataFrame, a: str, b: str) -> DataFrame:
    """chunk_id of the chunks that name both entities."""
    two = links.filter(F.col("entity_id").isin(a, b)).select("chunk_id", "entity_id").distinct()
    return two.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n = 2").select("chunk_id")


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    ends = edges.select(F.col(source).alias("node")).unionByName(edges.select(F.col(target).alias("node"))).filter("node IS NOT NULL")
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def drop_common_aliases(entities: DataFrame, key: str, least: int = 3) -> DataFrame:
    """aliases without those whose normalised form ``least`` or more entity occurrences hold."""
    used = entities.select(F.explode("aliases").alias("a")).select(normalize_name(F.col("a")).alias("n")).filter("n <> ''").groupBy("n").count()
    common = used.filter(F.col("count") >= least).select("n")
    each = entities.select(key, F.posexplode("aliases").alias("_p", "_a")).withColumn("n", normalize_name(F.col("_a")))
    kept = each.join(common, "n", "left_anti").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", "_a"))).alias("k"))
    kept = kept.select(key, F.transform("k", lambda x: x["_a"]).alias("_kept"))
    return entities.join(kept, key, "left").withColumn("aliases", F.coalesce("_kept", F.array().cast("array<string>"))).drop("_kept")


def validate(entities: DataFrame, rules: DataFrame, kind: str = "type") -> DataFrame:
    """(type, found, least, most, valid): how many entities a rule's type has and whether that is within its bounds."""
    found = entities.groupBy(kind).agg(F.count("*").alias("found")).withColumnRenamed(kind, "type")
    checked = rules.join(found, "type", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return checked.withColumn("valid", F.expr("found >= coalesce(least, 0) AND (most IS NULL OR found <= most)"))


def retype(edges: DataFrame, official: DataFrame) -> DataFrame:
    """type by the mapping (variant, official), else its normal form."""
    shape = edges.withColumn("type", relation_type(F.col("type")))
    to = official.select(relation_type(F.col("variant")).alias("_v"), F.col("official").alias("_o")).dropDuplicates(["_v"])
    return shape.join(maybe_broadcast(to), shape["type"] == to["_v"], "left").withColumn("type", F.coalesce("_o", "type")).drop("_v", "_o")


def unofficial_types(edges: DataFrame, official: DataFrame) -> DataFrame:
    """(type): the edge types that are not official."""
    return edges.select(relation_type(F.col("type")).alias("type")).subtract(official.select("type"))


def _settle(edges: DataFrame, nodes: DataFrame, rounds: int, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): label propagation held back by size, so that not all nodes of a dense graph end in one label.

    edges: a, b, w, both ways; nodes: node, degree (sum of w). In each round the nodes of one half, by a hash that changes, take the
    label of the greatest gain: weight of the edges to it, less its degree times the node's over all edges (the gain in
    modularity); ties go to the smaller label. Nodes of the other half stay, so neighbours do not swap for ever.
    """
    labels = nodes.select("node", F.col("node").alias("label"))
    whole = nodes.agg(F.sum("degree").alias("whole"))
    for k in range(rounds):
        moves = F.pmod(F.xxhash64("node", F.lit(k // 2)), F.lit(2)) == k % 2
        held = labels.join(nodes, "node").groupBy("label").agg(F.sum("degree").alias("held"))
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("w").alias("to"))
        own = labels.join(nodes, "node").filter(moves)
        options = near.unionByName(own.select("node", "label", F.lit(0.0).alias("to"))).groupBy("node", "label").agg(F.sum("to").alias("to"))
        options = options.join(own.select("node", "degree", F.col("label").alias("now")), "node").join(held, "label").join(F.broadcast(whole))  # one row
        rest = F.col("held") - F.when(F.col("label") == F.col("now"), F.col("degree")).otherwise(0.0)
        gain = F.round(F.col("to") - F.col("degree") * rest / F.col("whole"), 9)
        best = options.groupBy("node").agg(F.max(gain).alias("gain"))
        chosen = options.withColumn("gain", gain).join(best, ["node", "gain"]).groupBy("node").agg(F.min("label").alias("to_label"))
        labels = scratch.keep(labels.join(chosen, "node", "left").select("node", F.coalesce("to_label", "label").alias("label")), f"{name}_{k}")
    return labels


def communities(edges: DataFrame, source: str, target: str, most: int = 10, levels: int = 3, rounds: int = 6) -> DataFrame:
    """(node, level, community, parent, size): groups of nodes that are joined more among themselves than to others, level by level.

    Level 0 splits the whole graph; each further level splits the communities of more than ``most`` nodes along their inner edges,
    until there are none or the levels are used up; one that does not split stays whole. A community is named by the level
    and its label. Splits follow edges alone. Repeated and turned-round edges add up; null ends and self pairs count for nothing;
    no edges: no rows. Rounds are bounded and written.
    """
    scratch = Scratch(edges.sparkSession, "communities")
    a, b = F.col(source), F.col(target)
    pairs = edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).groupBy(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).agg(F.count("*").cast("double").alias("w"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b"), "w"), F.struct(F.col("y").alias("a"), F.col("x").alias("b"), "w"))).alias("e")).select("e.*")
    live = scratch.keep(both, "edges0")
    found = None
    parents = None
    for level in range(levels):
        nodes = scratch.keep(live.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree")), f"nodes{level}")
        labels = _settle(live, nodes, rounds, scratch, f"labels{level}")
        if parents is None:
            named = labels.withColumn("parent", F.lit(None).cast("string"))
        else:  # nodes without an inner edge stay by themselves
            named = parents.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.col("community").alias("parent"))
        named = named.select("node", F.lit(level).alias("level"), F.concat_ws("|", F.lit(str(level)), "parent", "label").alias("community"), "parent")
        sizes = named.groupBy("community").agg(F.count("*").alias("size"))
        named = scratch.keep(named.join(sizes, "community"), f"level{level}")
        found = named if found is None else found.unionByName(named)
        parents = named.filter(F.col("size") > most).select("node", "community")
        at = lambda end: parents.select(F.col("node").alias(end), F.col("community").alias(f"c{end}"))  # noqa: B023, E731
        live = scratch.keep(live.join(at("a"), "a").join(at("b"), "b").filter("ca = cb").select("a", "b", "w"), f"edges{level + 1}")
        if live.isEmpty():
            break
    return found.select("node", "level", "community", "parent", "size")


def modularity(edges: DataFrame, source: str, target: str, members: DataFrame) -> float:
    """Share of the edges within communities (node, community), less what a random graph of these degrees would have."""
    ends = edges.filter(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target))).select(F.col(source).alias("a"), F.col(target).alias("b"))
    at = lambda end: members.select(F.col("node").alias(end), F.col("community").alias(f"c{end}"))
    rows = ends.join(at("a"), "a").join(at("b"), "b")
    total, inner = rows.agg(F.count("*"), F.sum((F.col("ca") == F.col("cb")).cast("int"))).first()
    held = rows.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count("*").cast("double").alias("k"))
    return inner / total - held.agg(F.sum(F.pow(F.col("k") / (2.0 * total), 2))).first()[0] if total else 0.0


def slug_edges(relations: DataFrame) -> DataFrame:
    """Legacy relations as edges between slugs, re-deliveries once."""
    return relations.dropDuplicates(["rel_id"]).select(
        slugify(F.col("source")).alias("source_slug"), slugify(F.col("target")).alias("target_slug"), F.coalesce("evidence", F.lit("")).alias("description"),
        F.coalesce("confidence", F.lit(1.0)).alias("weight"), F.array(F.col("doc_id").cast("string")).alias("source_ids"), F.lit(1).alias("rank"),
    )
