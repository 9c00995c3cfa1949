"""Variant spellings of names typed by people (problem 5)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..joins import salted_join
from ..operators.components import connected_components
from ..scratch import Scratch
from .folding import fold, skeleton

#: Most edits between two folded spellings of one name, and into how many segments a name is cut for it: any two
#: segments left unchanged by the edits find the pair.
EDITS, SEGMENTS = 2, 4
PERSONS = ("Person", "Sahabi", "Sahabiya", "Child", "Opponent", "Tribe", "Group")
FULL = r"^\S{2,} ibn \S{2,} al \S+$"
INITIAL = r"^\S ibn | ibn \S al "
TRIBE = r"^banu \S+$"
#: A nickname is a person's own if more than this share of the different records that name it beside somebody name that person.
OWN_SHARE = 1 / 3


def _shifts(shorter: bool) -> list[tuple[int, int, int, int, int]]:
    """(i, j, d, a, b): segments i < j of the indexed string, d characters longer the other, and where i and j may begin in it.

    a edits' worth of shift before i, then to b before j, then to d at the end, cost at least |a| + |b - a| + |d - b| edits.
    """
    reach = range(-EDITS, EDITS + 1)
    return [(i, j, d, a, b) for i, j in combinations(range(SEGMENTS), 2) for d in range(-EDITS if shorter else 0, EDITS + 1) for a in reach for b in reach if abs(a) + abs(b - a) + abs(d - b) <= EDITS]


def _place(i: str) -> tuple[str, str]:
    start = f"({i} * (l div {SEGMENTS}) + greatest(0, {i} - ({SEGMENTS} - l % {SEGMENTS})))"
    return start, f"(l div {SEGMENTS} + int({i} >= {SEGMENTS} - l % {SEGMENTS}))"


def _near(keys: DataFrame, against: DataFrame | None, by: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(v, r, edits, and v_x, r_x for each carried column x): what ``close_keys`` finds, before either is put first.

    ``by`` names a column in which both must be equal; it is part of a slot, so others never meet. Probes travel as two 64-bit
    hashes; the index brings its strings along, the probing side's are fetched by one join, whose partitions also serve the
    removal of what was found twice.
    """
    spark, both = keys.sparkSession, against is not None
    sized = lambda t: t.filter(F.length("key") >= 2 * SEGMENTS)
    long, indexed = sized(keys), sized(against if both else keys)
    same = f", {by}" if by else ""
    (pi, wi), (pj, wj) = _place("c.i"), _place("c.j")
    two = ", ".join(f"struct({i} AS i, {j} AS j)" for i, j in combinations(range(SEGMENTS), 2))
    more = "".join(f", {c} AS r_{c}" for c in carry)
    index = indexed.selectExpr("*", "length(key) AS l", f"explode(array({two})) AS c").selectExpr(
        f"xxhash64(l, c.i, c.j{same}, substr(key, {pi} + 1, {wi}), substr(key, {pj} + 1, {wj})) AS slot", f"named_struct('r', key{''.join(f", 'r_{c}', {c}" for c in carry)}) AS found"
    )
    moves = ", ".join(f"struct({i} AS i, {j} AS j, {d} AS d, {a} AS a, {b} AS b)" for i, j, d, a, b in _shifts(both))
    probes = long.selectExpr("*", f"explode(array({moves})) AS c").selectExpr("*", "length(key) - c.d AS l")
    probes = probes.filter(f"l >= 2 * {SEGMENTS} AND {pi} + c.a >= 0 AND {pj} + c.b + {wj} <= length(key)").selectExpr(
        "xxhash64(key) AS id", f"xxhash64(l, c.i, c.j{same}, substr(key, {pi} + c.a + 1, {wi}), substr(key, {pj} + c.b + 1, {wj})) AS slot"
    )
    hits = probes.join(index.hint("merge"), "slot").select("id", "found.*")
    of = long.select(F.xxhash64("key").alias("id"), F.col("key").alias("v"), *[F.col(c).alias(f"v_{c}") for c in carry])
    pairs = hits.join(of.hint("merge"), "id").filter("v <> r").dropDuplicates(["id", "r"]).withColumn("edits", F.expr(f"levenshtein(v, r, {EDITS})")).filter("edits >= 0")
    words = f"size(split(v, ' ')) <> size(split(r, ' ')) OR forall(zip_with(split(v, ' '), split(r, ' '), (x, y) -> levenshtein(x, y) <= IF(greatest(length(x), length(y)) < 6, 1, {EDITS})), t -> t)"
    return pairs.filter(words).drop("id")


def close_keys(keys: DataFrame, against: DataFrame | None = None) -> DataFrame:
    """(a, b, edits): pairs of different strings within EDITS edits, a before b; keys has one column ``key``, distinct.
    With a second table only pairs of a key a and one of that table, b.

    Pigeonhole join: each string is cut into SEGMENTS segments, of which EDITS edits leave two unchanged. The inverted index
    holds every pair of segments under their text; a string looks up its substrings at the places that the edits allow.
    Found pairs are verified by the banded edit distance, and of the edits words under six letters may take one. No pair
    within the bound is missed; strings shorter than 2 * SEGMENTS are not compared. A collision of hashes is dropped by the
    verification.
    """
    pairs = _near(keys, against)
    if against is not None:
        return pairs.select(F.col("v").alias("a"), F.col("r").alias("b"), "edits")
    return pairs.select(F.least("v", "r").alias("a"), F.greatest("v", "r").alias("b"), "edits").distinct()


def _kind(key: str) -> str:
    return f"CASE WHEN {key} LIKE '~%' THEN 'arabic' WHEN {key} RLIKE r'{INITIAL}' THEN 'initial' WHEN {key} RLIKE r'{FULL}' THEN 'full' WHEN {key} RLIKE r'{TRIBE}' THEN 'tribe' WHEN {key} RLIKE r'^(?:abu|um) \\S+ al \\S+$' THEN 'kunya' WHEN {key} RLIKE r'^\\S+ al \\S+$' THEN 'short' ELSE 'other' END"


def _ties(keys: DataFrame) -> DataFrame:
    """(a, b): each spelling with the nearest ones of its kind that more records use; of equal use the smaller is stronger."""
    pairs = _near(keys, None, "kind", ("n",))
    weak = (F.col("v_n") < F.col("r_n")) | (F.col("v_n") == F.col("r_n")) & (F.col("v") > F.col("r"))
    up = pairs.select(F.when(weak, F.col("v")).otherwise(F.col("r")).alias("a"), F.when(weak, F.col("r")).otherwise(F.col("v")).alias("b"), "edits")
    least = F.min("edits").over(Window.partitionBy("a"))
    return up.withColumn("least", least).filter("edits = least").select("a", "b").distinct()


def link_variants(records: DataFrame) -> DataFrame:
    """(name, entity): the different name strings with the entities they mean; most mean one, a short name may mean several.

    records: name, aliases, normalized_name, type. Every string of a record is folded (see ``folding``). Full names of
    persons and names of tribes that are within EDITS edits of one another are one entity: each is tied to the nearest
    spellings that more records use, so two neighbours are not joined by a slip between them. Names in another form (short,
    with an initial, by the son, a nickname, in Arabic script) are attached to the entity whose form they are if it is one,
    else to those that a record names beside them: they never join two entities. Such a name is a
    person's if more than OWN_SHARE of the different records with it name that person, whose spellings of one consonant
    skeleton count together, so one shared by many is nobody's, and a stray record changes nothing at any size. Null, blank and repeated strings and empty alias lists add nothing; records of other types are
    left out; extra columns are ignored. A hot name is one row here, as strings are counted before they are compared.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "variants")
    rows = records.filter(F.col("type").isin(*PERSONS)).select("name", "aliases", "normalized_name")
    rows = rows.groupBy("name", "aliases", "normalized_name").agg(F.count("*").alias("n"))
    rows = scratch.keep(rows.withColumn("row", F.xxhash64("name", "aliases", "normalized_name")), "rows")
    said = rows.select("row", "n", F.explode(F.array_distinct(F.concat(F.array("name", "normalized_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("text")).filter("text IS NOT NULL")
    texts = scratch.keep(fold(said.groupBy("text").agg(F.sum("n").alias("n")), "text", "key"), "texts").filter("length(key) > 1")
    keys = scratch.keep(texts.groupBy("key").agg(F.sum("n").alias("n")).selectExpr("key", "n", f"{_kind('key')} AS kind"), "keys")

    # 1. Spellings within the bound, each tied to its nearest stronger one of its own kind.
    ties = scratch.keep(_ties(keys.filter("kind NOT IN ('arabic', 'initial')")), "ties")
    groups = connected_components(ties, "a", "b").withColumnRenamed("node", "key")
    keys = scratch.keep(keys.join(groups, "key", "left").withColumn("grp", F.coalesce("component", "key")).drop("component"), "grouped")

    # 2. Entities, and the other forms of their names; those that nobody wrote have no group.
    core, loose = keys.filter("kind IN ('full', 'tribe')"), keys.filter("kind NOT IN ('full', 'tribe')")
    forms = core.selectExpr("grp AS entity", f"""explode(array_distinct(IF(key RLIKE r'{FULL}', array(
        regexp_replace(key, r' ibn \\S+ ', ' '), regexp_replace(key, r'^(.)\\S* ', '$1 '), regexp_replace(key, r' ibn (.)\\S* ', ' ibn $1 '), {skeleton('key')},
        {skeleton("regexp_replace(key, r' ibn .+ al ', ' al ')")}), array({skeleton('key')})))) AS key""")
    forms = scratch.keep(forms.join(keys.select("key", "grp"), "key", "left").dropDuplicates(["key", "entity"]), "forms")
    formed = forms.filter("grp IS NOT NULL").select("grp", "entity").distinct()
    # A loose spelling near a form that nobody wrote is compared with the forms themselves.
    unsaid = forms.filter("grp IS NULL").selectExpr("key", "entity", f"{_kind('key')} AS kind").filter("kind = 'short'")
    slips = loose.filter("kind = 'short'").join(formed.select("grp").distinct(), "grp", "left_anti").select("key", "grp", "kind")
    close = _near(slips.withColumn("entity", F.lit("")), unsaid.withColumn("grp", F.lit("")), "kind", ("grp", "entity"))
    formed = scratch.keep(formed.unionByName(close.select(F.col("v_grp").alias("grp"), F.col("r_entity").alias("entity"))).distinct(), "formed")

    # 3. What records name beside one another.
    told = scratch.keep(said.select("row", "text").join(texts.select("text", "key"), "text").join(keys.select("key", "kind", "grp"), "key").select("row", "key", "kind", "grp").distinct(), "told")
    full = F.col("kind").isin("full", "tribe")
    sole = formed.groupBy("grp").agg(F.min("entity").alias("entity"), F.count("*").alias("c"))
    several, sole = sole.filter("c > 1").select("grp"), sole.filter("c = 1").select("grp", "entity")
    sure = told.filter(full).select("row", F.col("grp").alias("entity")).unionByName(told.join(sole, "grp").select("row", "entity"))
    family = lambda c: F.regexp_extract(c, r" al (\S+)$", 1)
    kin = (family("grp") != "") & (F.levenshtein(family("grp"), family("entity")) <= EDITS)
    beside = told.filter(~full).select("row", "key", "grp").join(sure, "row").distinct()
    beside = scratch.keep(beside.withColumns({"kin": kin, "person": F.expr(skeleton("entity"))}), "beside")

    def own(by: str) -> DataFrame:
        """(by, entity): whose the spelling, or group of spellings, is by what stands beside it."""
        once = beside.groupBy(by, "row", "person").agg(F.collect_set(F.struct("entity", "kin")).alias("e"))
        part = once.groupBy(by, "person").agg(F.count("*").alias("part"), F.array_distinct(F.flatten(F.collect_set("e"))).alias("e"))
        whole = beside.select(by, "row").distinct().groupBy(by).agg(F.count("*").alias("whole"))
        listed = part.join(whole, by).select(by, "part", "whole", F.inline("e"))
        return listed.filter(F.col("kin") | (F.col("part") > OWN_SHARE * F.col("whole"))).select(by, "entity").distinct()

    by_group = scratch.keep(own("grp"), "own_group")
    told_of = formed.join(several, "grp", "left_semi").join(by_group, ["grp", "entity"], "left_semi")  # of several, those named beside it
    attached = loose.select("key", "grp").join(sole.unionByName(told_of), "grp").select("key", "entity")
    # Others by what stands beside the spelling itself (two persons' nicknames may be near), else beside its neighbours.
    rest = loose.select("key", "grp").join(formed.select("grp").distinct(), "grp", "left_anti")
    seen = beside.select("key").distinct()
    by_key = scratch.keep(own("key"), "own_key")
    other = rest.join(by_key, "key").select("key", "entity").unionByName(rest.join(seen, "key", "left_anti").join(by_group, "grp").select("key", "entity"))
    attached = scratch.keep(attached.unionByName(other).distinct(), "attached")
    entity = keys.join(attached, "key", "left").select("key", F.coalesce("entity", "grp").alias("entity"))

    names = rows.select(F.col("name").alias("text")).filter("text IS NOT NULL").distinct()
    linked = names.join(texts.select("text", "key"), "text").join(entity, "key").select(F.col("text").alias("name"), "entity").distinct()
    linked = scratch.keep(linked, "linked")
    scratch.drop("rows", "texts", "keys", "ties", "grouped", "forms", "formed", "told", "beside", "own_group", "own_key", "attached")
    return linked


def variant_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b): each pair of different strings of one entity, once, name_a before name_b by code point.

    An entity with more than a thousand strings has its pairs made in 64 tasks.
    """
    hot = linked.groupBy("entity").count().filter("count > 1000").select("entity")
    a, b = linked.select(F.col("name").alias("name_a"), "entity"), linked.select(F.col("name").alias("name_b"), "entity")
    return salted_join(a, b, "entity", hot).filter("name_a < name_b").select("name_a", "name_b").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(link_variants(spark.read.parquet(f"{sf_dir}/graph_extraction_raw.parquet")))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name string with the entities it means: the membership."""
    return link_variants(spark.read.parquet(f"{sf_dir}/graph_extraction_raw.parquet"))


QUERIES = {"p5_found": p5_found, "p5_entities": p5_entities}
ORACLES: dict[str, str] = {}
