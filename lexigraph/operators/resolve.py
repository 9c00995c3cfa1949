"""Entity resolution: blocking, greedy merging, similarity groups, redirects, anchoring, consolidation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import gestalt, gestalt_column, lcs_ratio, metaphone_column
from ..functions.text import normalize_name, slugify, strip
from ..joins import distinct_lists, maybe_broadcast
from ..scratch import Scratch
from .components import connected_components

#: Gestalt ratio from which on two aliases count as alike, and letters of a context that are compared.
ALIAS_LIKE, CONTEXT = 0.8, 100

# Kinds that may name one entity, and kinds that hardly can.
COMPATIBLE = (("AhlBayt", "Sahabi"), ("Child", "AhlBayt"), ("Place", "City"), ("Event", "Battle"))
INCOMPATIBLE = (("MotherBeliever", "Prophet"), ("MotherBeliever", "AhlBayt"), ("Sahabi", "Prophet"))


def type_compatibility(a, b):
    """1 if equal, 0.7 if they may name one entity, 0.1 if they hardly can, else 0.3."""
    pair = lambda pairs: F.greatest(a, b).isNotNull() & F.concat_ws("|", F.least(a, b), F.greatest(a, b)).isin(*["|".join(sorted(p)) for p in pairs])
    return F.when(a == b, 1.0).when(pair(COMPATIBLE), 0.7).when(pair(INCOMPATIBLE), 0.1).otherwise(0.3)


def alias_overlap(a: list[str], b: list[str], like: Callable[[str, str], bool] | None = None) -> float:
    """1 for two or more aliases of a that are each like one of b of their own, 0.7 for one, 0 for none."""
    like = like or like_alias
    used: set[int] = set()
    for x in sorted(set(a)):
        for i, y in enumerate(sorted(set(b))):
            if i not in used and like(x, y):
                used.add(i)
                break
        if len(used) >= 2:
            return 1.0
    return 0.7 if used else 0.0


def like_alias(x: str, y: str) -> bool:
    """A gestalt ratio of ALIAS_LIKE; the lengths and the common subsequence bound it and are counted sooner."""
    if x == y:
        return x != ""
    return 2.0 * min(len(x), len(y)) >= ALIAS_LIKE * (len(x) + len(y)) - 1e-9 and lcs_ratio(x, y) >= ALIAS_LIKE and gestalt(x, y) >= ALIAS_LIKE


def compared_names(name: Column, aliases: Column) -> Column:
    """The normalised name and aliases, without blank ones."""
    return F.filter(F.transform(F.array_append(F.coalesce(aliases, F.array().cast("array<string>")), name), normalize_name), lambda n: n != "")


def pair_scores(pairs: DataFrame) -> DataFrame:
    """score: 0.5 name + 0.3 alias + 0.1 type + 0.1 context of pairs given as columns name_a, aliases_a, type_a, context_a, name_b, ..."""

    def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alias_overlap(list(x), list(y)) for x, y in zip(a, b)], dtype="float64")

    names = lambda s: compared_names(F.col(f"name_{s}"), F.col(f"aliases_{s}"))
    head = lambda s: F.substring(F.coalesce(f"context_{s}", F.lit("")), 1, CONTEXT)
    score = (
        0.5 * gestalt_column(F.col("name_a"), F.col("name_b")) + 0.3 * F.pandas_udf(overlap, "double")(names("a"), names("b"))
        + 0.1 * type_compatibility(F.col("type_a"), F.col("type_b")) + 0.1 * gestalt_column(head("a"), head("b"))
    )
    return pairs.withColumn("score", score)


def phonetic_blocks(entities: DataFrame) -> DataFrame:
    """sound: the phonetic key of the title, '' if blank."""
    return entities.withColumn("sound", F.coalesce(metaphone_column(F.col("title")), F.lit("")))


def greedy_pivots(entities: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, pivot): each entity's cluster head.

    entities: id, title, category, frequency, pos; an id counts once, with the sum of its frequencies. Within a block of one
    category (null equals null) and sound, by frequency, pos and id, the first free entity becomes a head and takes
    those free whose title is like its own. The outcome depends on this order, so a block is one sequence; blocks are
    further cut by the title's first letter group only through their sound, and titles are compared once each.
    """
    whole = entities.groupBy("id").agg(F.min_by("title", "pos").alias("title"), F.min_by("category", "pos").alias("category"), F.sum("frequency").alias("frequency"), F.min("pos").alias("pos"))
    blocked = phonetic_blocks(whole).withColumn("block", F.coalesce("category", F.lit("\u0000")))

    def run(block: pd.DataFrame) -> pd.DataFrame:
        rows = block.sort_values(["frequency", "pos", "id"], ascending=[False, True, True])
        heads: list[tuple[str, str]] = []
        out = []
        for key, title in zip(rows["id"], rows["title"]):
            head = next((h for h, t in heads if t and title and lcs_ratio(t, title) >= threshold), None)
            if head is None:
                heads.append((key, title))
            out.append((key, head or key))
        return pd.DataFrame(out, columns=["id", "pivot"])

    return blocked.select("id", "title", "frequency", "pos", "block", "sound").groupBy("block", "sound").applyInPandas(run, "id string, pivot string")


def collapse_clusters(entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row a cluster: title, type and category of its head, sum of frequencies, top rank, all sources, descriptions joined."""
    rows = entities.join(clusters, "id")
    first = F.struct((F.col("id") != F.col("pivot")).cast("int"), F.col("pos"), F.col("id"))
    out = rows.groupBy("pivot").agg(
        F.min_by("title", first).alias("title"), F.min_by("type", first).alias("type"), F.min_by("category", first).alias("category"), F.sum("frequency").alias("frequency"),
        F.max("rank").alias("rank"), F.array_join(F.array_sort(F.collect_set(F.nullif(F.col("description"), F.lit("")))), " | ").alias("description"),
    )
    return out.join(distinct_lists(rows, ["pivot"], "source_ids"), "pivot", "left").withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<string>"))).withColumnRenamed("pivot", "id")


def consolidate(entities: DataFrame) -> DataFrame:
    """One row an id, in order of appearance (pos): first non-null title, type, slug, category, status; descriptions joined;
    frequency is the number of different sources."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    out = entities.groupBy("id").agg(
        *[first(c) for c in ("title", "type", "slug", "category")], F.array_join(F.array_sort(F.collect_set(F.nullif(F.col("description"), F.lit("")))), " | ").alias("description"),
        F.max("rank").alias("rank"), F.min("pos").alias("pos"),
    )
    out = out.join(distinct_lists(entities, ["id"], "source_ids"), "id", "left").withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<string>")))
    return out.withColumn("frequency", F.size("source_ids"))


def valid_redirects(redirects: DataFrame) -> DataFrame:
    """(source, target): trimmed; null, blank, "nan" and self redirects go; of several for one source the last stage's counts."""
    clean = lambda c: F.when(~F.lower(strip(F.col(c))).isin("", "nan"), strip(F.col(c)))
    rows = redirects.select(clean("source").alias("source"), clean("target").alias("target"), "stage").filter("source IS NOT NULL AND target IS NOT NULL AND source <> target")
    return rows.groupBy("source").agg(F.max_by("target", F.struct("stage", "target")).alias("target"))


def resolve_redirects(redirects: DataFrame) -> DataFrame:
    """(source, target): the end of every chain, by pointer jumping in a logarithmic number of rounds, written each round.

    All members of a cycle, and what leads into it, go to the cycle's smallest member.
    """
    scratch = Scratch(redirects.sparkSession, "redirects")
    step = redirects.select("source", "target", F.least("source", "target").alias("least"))
    roots = redirects.select(F.col("target").alias("source")).subtract(redirects.select("source"))
    state = scratch.keep(step.unionByName(roots.select("source", F.col("source").alias("target"), F.col("source").alias("least"))), "round0")
    ends = scratch.keep(roots.withColumnRenamed("source", "target"), "ends")
    k, was, left = 0, -1, state.join(ends, "target", "left_anti").count()  # nodes that have not come to an end
    # Chains shorten from their ends, so once a round frees none, all that are left are on or before a cycle.
    while left and not (left == was and 2**k >= left):
        k += 1
        up = state.select(F.col("source").alias("target"), F.col("target").alias("_t"), F.col("least").alias("_l"))
        state = scratch.keep(state.join(up, "target").select("source", F.col("_t").alias("target"), F.least("least", "_l").alias("least")), f"round{k}")
        was, left = left, state.join(ends, "target", "left_anti").count()
    # What a node leads to is an end, which is least by itself, or lies on a cycle, all of which its own least has seen.
    end = state.select(F.col("source").alias("target"), F.col("least").alias("_l"))
    return state.join(end, "target").join(redirects.select("source"), "source", "left_semi").select("source", F.col("_l").alias("target"))


def apply_redirects(rows: DataFrame, resolved: DataFrame, *columns: str) -> DataFrame:
    """The columns' ids replaced by where they lead."""
    for c in columns:
        to = resolved.select(F.col("source").alias(c), F.col("target").alias("_to"))
        rows = rows.join(to, c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return rows


def _pieces(text, n):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n if not isinstance(n, int) else F.lit(n))))


def anchor(entities: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, candidates, canonical_id, review_status): entries of an entity's category whose slug, or an alias's, is its title's, or
    for keys over four characters contains it (with LIKE, so _ stands for any character).

    One candidate anchors the entity, several leave it PENDING, none NOT_KNOWN. A null category has none. Two equality joins: on the
    key, and on a piece of up to three letters of it, whose hits are checked; no candidate is missed.
    """
    probe = entities.select("id", "category", slugify(F.col("title")).alias("key")).filter("key <> '' AND category IS NOT NULL").distinct()
    keys = entries.select(F.col("slug").alias("entry"), "category", F.explode(F.array_distinct(F.concat(F.array(F.col("slug")), F.transform(F.coalesce("properties.aliases", F.array().cast("array<string>")), slugify)))).alias("k")).filter("k <> ''")
    exact = probe.join(maybe_broadcast(keys), (probe["category"] == keys["category"]) & (F.col("key") == F.col("k"))).select("id", "entry")
    # A key is looked for by the rarest piece of its longest part without _; one whose piece no entry holds is in none.
    asked = probe.filter(F.length("key") > 4).select("category", "key").distinct()
    parts = F.split("key", "_")
    longest = F.element_at(F.array_sort(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))), -1)["p"]
    asked = asked.withColumn("_part", longest).withColumn("_w", F.least(F.length("_part"), F.lit(3))).withColumn("piece", F.explode(_pieces(F.col("_part"), F.col("_w")))).drop("_part", "_w")
    held = keys.withColumn("piece", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length("k"))), lambda n: _pieces(F.col("k"), n))))))
    counts = held.groupBy("category", "piece").agg(F.count("*").alias("n"))
    rarest = asked.join(maybe_broadcast(counts), ["category", "piece"], "left").groupBy("category", "key").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), F.col("piece"))).alias("piece"))
    within = rarest.join(maybe_broadcast(held), ["category", "piece"]).filter("k LIKE concat('%', key, '%')").select("category", "key", "entry").distinct()
    hit = exact.unionByName(probe.join(within, ["category", "key"]).select("id", "entry"))
    found = hit.groupBy("id").agg(F.array_sort(F.collect_set("entry")).alias("candidates"))
    out = entities.select("id").distinct().join(found, "id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    n = F.size("candidates")
    return out.withColumn("canonical_id", F.when(n == 1, F.element_at("candidates", 1))).withColumn("review_status", F.when(n == 1, "CORE_VALIDATED").when(n > 1, "PENDING").otherwise("NOT_KNOWN"))


def canonical_merge(members: DataFrame, key: str, priority: dict[str, int]) -> DataFrame:
    """One row a group: its longest name (then with a lineage, then a kunya), its strongest type, other names and aliases that
    are not the name itself, different contexts joined, top confidence. members: name, type, aliases, context_description, confidence."""
    low = F.lower("name")
    best = F.struct(F.length("name"), (low.contains("bint") | low.contains("ibn")).cast("int"), (low.contains("abu ") | low.contains("um ") | low.contains("umm ")).cast("int"), F.col("name"))
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col("type")), F.lit(0)) if priority else F.lit(0)
    rows = members.filter("name IS NOT NULL").withColumn("_rank", rank)
    out = rows.groupBy(key).agg(
        F.max_by("name", best).alias("name"), F.max_by("type", F.struct("_rank", "type")).alias("type"),
        F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim("context_description"), F.lit("")))), " | ").alias("context_description"), F.max("confidence").alias("confidence"),
    )
    named = rows.select(key, F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name")).alias("_all"))
    out = out.join(distinct_lists(named, [key], "_all"), key).withColumn("normalized_name", normalize_name(F.col("name")))
    kept = F.array_sort(F.filter("_all", lambda a: a.isNotNull() & (normalize_name(a) != F.col("normalized_name"))))
    none = F.lit("No description available")
    return out.withColumn("aliases", kept).withColumn("context_description", F.coalesce(F.nullif(F.col("context_description"), F.lit("")), none)).drop("_all")


def similarity_groups(edges: DataFrame, nodes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(node, grp): connected groups of the edges with at least the score; nodes without one are groups of their own."""
    groups = connected_components(edges.filter(F.col("score") >= threshold), "a", "b")
    return nodes.select("node").distinct().join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("grp"))
