"""Mapping free-entered values to a canonical list by a partition-based pigeonhole join (problem 4). SQL only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..joins import maybe_broadcast
from .folding import folded, skeleton

#: Most edits between a value and its entry, after both are folded.
MAX_EDITS = 2

#: A folded name of a person in full, and one with a part cut to its initial. The latter must agree to the letter.
FULL, INITIAL = "^\\\\S{2,} ibn \\\\S{2,} al \\\\S+$", "^\\\\S ibn | ibn \\\\S al "

#: Start (from 0) and length of segment i (from 0) of a string of length l cut into n parts, as SQL.
_SEG = "struct(i * (l div {n}) + greatest(0, i - ({n} - l % {n})) AS p, l div {n} + int(i >= {n} - l % {n}) AS w)"


def pigeonhole_candidates(values: DataFrame, references: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """(v, r): pairs of a value and a reference string that may be within ``edits`` edits; none that is within is missed.

    Both tables have one column of distinct strings, v and r. A reference is cut into edits + 1 segments; one of them occurs
    unchanged in any value within the bound, and its place there is within the shifts that the edits before and after
    it allow. The join is an equality on (length, segment number, text).
    """
    n, spark = edits + 1, values.sparkSession
    values.createOrReplaceTempView("_values"), references.createOrReplaceTempView("_references")
    seg = _SEG.format(n=n)
    index = spark.sql(f"""
        SELECT r, l, i, substr(r, s.p + 1, s.w) AS seg FROM (
          SELECT r, l, i, {seg} AS s FROM (SELECT r, length(r) AS l, explode(sequence(0, {n - 1})) AS i FROM _references WHERE length(r) >= {n}))""")
    probes = spark.sql(f"""
        SELECT v, l, i, substr(v, q + 1, w) AS seg FROM (
          SELECT v, l, i, s.w AS w, explode(sequence(greatest(0, s.p - i, s.p + d - ({edits} - i)), least(length(v) - s.w, s.p + i, s.p + d + ({edits} - i)))) AS q FROM (
            SELECT v, l, d, i, {seg} AS s FROM (
              SELECT v, l, length(v) - l AS d, explode(sequence(0, {n - 1})) AS i FROM (
                SELECT v, explode(sequence(greatest({n}, length(v) - {edits}), length(v) + {edits})) AS l FROM _values WHERE length(v) >= 1)))
          WHERE greatest(0, s.p - i, s.p + d - ({edits} - i)) <= least(length(v) - s.w, s.p + i, s.p + d + ({edits} - i)))""")
    return probes.join(maybe_broadcast(index), ["l", "i", "seg"]).select("v", "r").distinct()


def map_to_list(values: DataFrame, references: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """(value, id, edits) for the values that mean an entry; the rest come from ``unmatched``.

    A person's full name stands also for its forms with an initial or without the father's name, where these are one id's.

    values: one column ``value``, any repeats; references: (id, text), several texts an id. A text that stands for several ids
    is nobody's own and is left out. Values and texts are folded, compared by edit distance, and a value is given the id
    of its nearest text; if two ids are equally near it is unmatched. The bound is ``edits``, one for folded texts under
    eight characters and for consonant skeletons, by which Arabic script is compared, and none under five. Null, blank and unmatched values do not appear.
    """
    spark = values.sparkSession
    references.createOrReplaceTempView("_listed")
    own = spark.sql(f"""
        WITH f AS (SELECT id, {folded('text')} AS r FROM _listed WHERE text IS NOT NULL AND id IS NOT NULL)
        SELECT r, max(id) AS id FROM (SELECT id, explode(CASE
            WHEN r LIKE '~%' THEN array(r) WHEN r RLIKE '{FULL}' THEN array(r, {skeleton('r')}, regexp_replace(r, '^(.)\\\\S* ', '$1 '), regexp_replace(r, ' ibn (.)\\\\S* ', ' ibn $1 '), regexp_replace(r, ' ibn \\\\S+ ', ' '))
            ELSE array(r, {skeleton('r')}) END) AS r FROM f WHERE r <> '')
        GROUP BY r HAVING min(id) = max(id)""")
    values.filter("value IS NOT NULL").select("value").distinct().createOrReplaceTempView("_entered")
    entered = spark.sql(f"SELECT value, {folded('value')} AS v FROM _entered")
    candidates = pigeonhole_candidates(entered.select("v").filter("v <> ''").distinct(), own.select("r"), edits)
    candidates.join(maybe_broadcast(own), "r").createOrReplaceTempView("_candidates")
    near = spark.sql(f"""
        SELECT v, min(struct(e, id)) AS best, max_by(id, struct(-e, id)) AS other FROM (
          SELECT v, id, r, levenshtein(v, r) AS e, greatest(length(v), length(r)) AS long, v LIKE '~%' AS bare FROM _candidates)
        WHERE e <= {edits} AND e <= CASE WHEN long < 5 OR r RLIKE '{INITIAL}' OR v RLIKE '{INITIAL}' THEN 0 WHEN long < 8 OR bare THEN 1 ELSE {edits} END GROUP BY v""")
    return entered.join(near.filter("best.id = other"), "v").select("value", F.col("best.id").alias("id"), F.col("best.e").alias("edits"))


def unmatched(values: DataFrame, matched: DataFrame) -> DataFrame:
    """(value, records): the distinct non-null values without an entry, and how many rows hold each."""
    return values.filter("value IS NOT NULL").join(matched.select("value"), "value", "left_anti").groupBy("value").agg(F.count("*").alias("records"))


def entry_texts(entries: DataFrame) -> DataFrame:
    """(id, text) of each way to write an entry: its slug, title and aliases."""
    texts = F.flatten(F.array(F.array(F.translate("slug", "_", " "), F.col("title")), F.coalesce("properties.aliases", F.array().cast("array<string>"))))
    return entries.select(F.col("slug").alias("id"), F.explode(texts).alias("text"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = spark.read.parquet(f"{sf_dir}/graph_extraction_raw.parquet").select("rec_id", F.col("normalized_name").alias("value"))
    return raw, entry_texts(spark.read.parquet(f"{sf_dir}/encyclopedia.parquet"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, texts = _tables(spark, sf_dir)
    return raw.join(map_to_list(raw, texts), "value").select("rec_id", F.col("id").alias("slug")).distinct()


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, texts = _tables(spark, sf_dir)
    return unmatched(raw, map_to_list(raw, texts)).select(F.col("value").alias("normalized_name"), "records")


QUERIES = {"p4_found": p4_found, "p4_unmatched": p4_unmatched}
ORACLES: dict[str, str] = {}
