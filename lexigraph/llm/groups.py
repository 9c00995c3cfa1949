"""Consolidating pairwise matches into groups (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components


def clean_name(column: str):
    """Trimmed of white space and in lower case; blank becomes null."""
    return F.nullif(F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")), F.lit(""))


def group_matches(pairs: DataFrame, left: str = "left_name", right: str = "right_name") -> DataFrame:
    """(normalized_name, group_name): the group of each name that a pair links to a different name.

    group_name is the smallest name of the group by code point. Names are compared trimmed and in lower case. Rows with a
    null or blank end and self pairs link nothing; repeated and turned-round pairs count once. An empty table gives no rows;
    further columns are ignored. Minimum labels, pointer jumping and a written table each round: see
    ``connected_components``.
    """
    edges = pairs.select(clean_name(left).alias("src"), clean_name(right).alias("dst"))
    return connected_components(edges).select(F.col("node").alias("normalized_name"), F.col("component").alias("group_name"))


def assign_groups(records: DataFrame, groups: DataFrame, name: str = "normalized_name") -> DataFrame:
    """Every record with group_name: that of its name, else the cleaned name itself, null where the name is null.

    The match table holds one row a name and the record side may be skewed to one name, so the records are never
    grouped: the join's own skew handling splits a hot name's partition and repeats its single match row.
    """
    key = clean_name(name)
    to = groups.select(F.col("normalized_name").alias("_name"), "group_name")
    rest = records.drop("group_name").withColumn("_key", key)
    return rest.join(to, rest["_key"] == to["_name"], "left").withColumn("group_name", F.coalesce("group_name", "_key")).drop("_key", "_name")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_matches(spark.read.parquet(f"{sf_dir}/match_pairs.parquet"))


def p1_record_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raw record with its group identifier."""
    raw = spark.read.parquet(f"{sf_dir}/graph_extraction_raw.parquet").select("rec_id", "normalized_name")
    return assign_groups(raw, p1_found(spark, sf_dir)).select("rec_id", "group_name")


QUERIES = {"p1_found": p1_found, "p1_record_groups": p1_record_groups}

_GROUPS = """WITH RECURSIVE pairs AS (
    SELECT lower(trim(left_name)) AS a, lower(trim(right_name)) AS b FROM match_pairs
    WHERE trim(left_name) <> '' AND trim(right_name) <> '' AND lower(trim(left_name)) <> lower(trim(right_name))),
  ends AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
  reach(x, y) AS (SELECT x, x FROM ends UNION SELECT r.x, e.y FROM reach r JOIN ends e ON r.y = e.x),
  grouped AS (SELECT x AS normalized_name, min(y) AS group_name FROM reach GROUP BY x)"""

ORACLES = {
    "p1_found": f"{_GROUPS} SELECT * FROM grouped",
    "p1_record_groups": f"""{_GROUPS} SELECT rec_id, coalesce(group_name, nullif(lower(trim(r.normalized_name)), '')) AS group_name
        FROM graph_extraction_raw r LEFT JOIN grouped g ON g.normalized_name = lower(trim(r.normalized_name))""",
}
