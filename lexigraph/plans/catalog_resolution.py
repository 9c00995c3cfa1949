"""Named queries of model-arbitrated resolution, with rules in the place of a model, and their SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fx
from ..operators import arbitration as ar
from . import providers as pv
from .catalog import _TYPES, T, _slug, _strip, query

_CLEAN = f"(SELECT normalized_name AS id, {_slug('normalized_name')} AS slug, arg_min(name, rec_id) AS title, min(type) AS type, coalesce(max(context_description), '') AS description FROM graph_extraction_clean WHERE normalized_name IS NOT NULL GROUP BY 1, 2)"
_CATEGORY = f"(SELECT c.*, t.c AS category FROM {_CLEAN} c LEFT JOIN ({_TYPES}) t(n, c) ON upper({_strip('c.type')}) = t.n)"


def entities(spark: SparkSession, d: str) -> DataFrame:
    """The keyed records as entities: one row a normalised name."""
    rows = T(spark, d, "graph_extraction_clean").filter("normalized_name IS NOT NULL").groupBy(F.col("normalized_name").alias("id")).agg(
        F.min_by("name", F.when(F.col("name").isNotNull(), F.col("rec_id"))).alias("title"), F.min("type").alias("type"), F.coalesce(F.max("context_description"), F.lit("")).alias("description")
    )
    return rows.withColumns({"slug": fx.slugify(F.col("id")), "category": fx.type_category(F.col("type")), "canonical_id": F.lit(None).cast("string")})


def _lines(prompt: str) -> list[tuple[int, str]]:
    return [(int(m[1]), m[2]) for m in re.finditer(r"^\[#(\d+)\] (.*)$", prompt, re.M)]


def _rule(prompts: list[str]) -> list[str]:
    """In place of a model: bridges name titles of one first letter together; verdicts merge all of a batch into its least line;
    arbitration merges the first two places under the first one's name."""
    out = []
    for p in prompts:
        lines = _lines(p)
        if p.startswith("BRIDGES"):
            of: dict[str, list[int]] = {}
            for i, t in lines:
                of.setdefault(t[:1], []).append(i)
            out.append(json.dumps([x for x in of.values() if len(x) > 1]))
        elif p.startswith("RESOLVE"):
            to = min(lines, key=lambda x: (x[1], x[0]))[0]
            out.append("##".join(f'("MERGE"<|>[#{i}]<|>{to})' for i, _ in lines if i != to))
        else:
            name = re.search(r"Name: (.*?) \| ", dict(lines)[0] + " | ")
            out.append(json.dumps({"actions": [{"type": "merge", "entity_ids": [0, "1", "x"], "canonical_name": name[1]}, {"type": "keep_distinct", "entity_ids": [2]}]}))
    return out


def ask(prompts: DataFrame) -> DataFrame:
    return pv.ask(prompts, _rule)


@query(f"""WITH e AS (SELECT DISTINCT {_slug('r.name')} AS slug, t.c AS category FROM graph_extraction_raw r LEFT JOIN ({_TYPES}) t(n, c) ON upper({_strip('r.type')}) = t.n WHERE name IS NOT NULL)
  SELECT DISTINCT least(x.slug, y.slug) AS a, greatest(x.slug, y.slug) AS b FROM e x JOIN e y ON x.category IS NOT DISTINCT FROM y.category AND x.slug <> y.slug AND length(x.slug) > 4 AND length(y.slug) > 4 AND contains(y.slug, x.slug)""")
def contained_slugs(spark, d):
    names = T(spark, d, "graph_extraction_raw").filter("name IS NOT NULL").select(fx.slugify(F.col("name")).alias("slug"), fx.type_category(F.col("type")).alias("category")).distinct()
    return ar.contained_pairs(names, "slug", "slug", "category")


@query()
def hybrid_components(spark, d):
    e = entities(spark, d)
    return ar.clusters_of(ar.hybrid_edges(e, links=True), e)


_BY_TYPE = "(SELECT id, coalesce(type, '') AS cluster FROM e)"


def _by_type(e: DataFrame) -> DataFrame:
    return e.select("id", F.coalesce("type", F.lit("")).alias("cluster"))


@query(f"WITH e AS {_CLEAN}, r AS (SELECT c.cluster, e.id, row_number() OVER (PARTITION BY cluster ORDER BY length(coalesce(title,'')) DESC, length(description) DESC, e.id) AS k, count(*) OVER (PARTITION BY cluster) AS members FROM e JOIN {_BY_TYPE} c USING (id)) SELECT cluster, id, members FROM r WHERE k = 1")
def cluster_representatives(spark, d):
    e = entities(spark, d)
    return ar.representatives(e, _by_type(e))


@query(f"""WITH e AS {_CATEGORY}, c AS (SELECT id, coalesce(type,'') || '|' || length(id) AS cluster, coalesce(category,'') AS category, title, description FROM e),
  p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY length(coalesce(title,'')) DESC, length(description) DESC, id) AS k FROM c) WHERE k = 1),
  g AS (SELECT cluster, min(cluster) OVER (PARTITION BY category, substr(coalesce(title,''), 1, 1)) AS grp FROM p)
  SELECT id, grp AS cluster FROM c JOIN g USING (cluster)""")
def bridge_merge(spark, d):
    e = entities(spark, d)
    clusters = e.select("id", F.concat_ws("|", F.coalesce("type", F.lit("")), F.length("id").cast("string")).alias("cluster"))
    return ar.merge_clusters(clusters, ar.bridges(e, clusters, ask, 100_000))


@query(f"""WITH e AS {_CLEAN}, l AS (SELECT id, coalesce(type,'') AS cluster, 'Title: ' || coalesce(title,'') || ' (Type: ' || coalesce(type,'') || '): ' || substr({_strip("replace(description, chr(10), ' ')")}, 1, 250) AS line FROM e),
  m AS (SELECT cluster, min(line) AS line FROM l GROUP BY 1 HAVING count(*) > 1), t AS (SELECT l.cluster, min(l.id) AS target FROM l JOIN m ON l.cluster = m.cluster AND l.line = m.line GROUP BY 1)
  SELECT id AS source, target FROM l JOIN t USING (cluster) WHERE id <> target""")
def pyramid(spark, d):
    e = entities(spark, d)
    return ar.pyramid(e, _by_type(e), ask)


@query(f"""WITH p AS (SELECT DISTINCT {_slug('name')} AS key, c.c AS category FROM graph_extraction_clean r JOIN ({_TYPES}) c(n, c) ON upper(trim(r.type)) = c.n WHERE name IS NOT NULL), k AS (SELECT slug, category FROM encyclopedia WHERE category IS NOT NULL),
  h AS (SELECT key, p.category, min(slug) AS least, max(slug) AS most FROM p JOIN k ON k.category = p.category AND substr(k.slug, 1, 4) = substr(key, 1, 4) WHERE key <> '' GROUP BY 1, 2)
  SELECT key || '|' || category AS id, CASE WHEN length(key) % 3 = 0 THEN 'E:' || most WHEN length(key) % 3 = 1 THEN NULL ELSE 'E:' || least END AS canonical_id, CASE WHEN length(key) % 3 = 1 THEN 'NOT_KNOWN' ELSE 'LLM_VALIDATED' END AS review_status FROM h""")
def anchoring_choices(spark, d):
    rows = T(spark, d, "graph_extraction_clean").filter("name IS NOT NULL").select(fx.slugify(F.col("name")).alias("key"), fx.type_category(F.col("type")).alias("category")).filter("key <> '' AND category IS NOT NULL").distinct()
    listed = T(spark, d, "encyclopedia").filter("category IS NOT NULL").select(F.substring("slug", 1, 4).alias("head"), "category", "slug")
    found = rows.withColumn("head", F.substring("key", 1, 4)).join(listed, ["head", "category"]).groupBy("key", "category").agg(F.array_sort(F.collect_list(F.struct("slug", F.concat(F.lit("E:"), "slug").alias("id")))).alias("candidates"))
    found = found.withColumn("id", F.concat_ws("|", "key", "category"))
    pick = F.when(F.length("key") % 3 == 0, F.element_at("candidates", -1)["slug"]).when(F.length("key") % 3 == 1, F.lit("NEW_ENTITY")).otherwise(F.element_at("candidates", 1)["slug"])
    answers = found.select("id", F.concat(F.lit('Chosen: ```json\n{"choice": "'), pick, F.lit('"}\n```')).alias("answer"))
    return ar.choose_anchor(found, answers)


_PLACES = "(SELECT *, row_number() OVER (PARTITION BY normalized_name ORDER BY rec_id) - 1 AS idx FROM (SELECT DISTINCT ON (rec_id) * FROM graph_extraction_clean WHERE normalized_name IS NOT NULL AND rec_id IS NOT NULL ORDER BY rec_id))"


@query(f"""WITH m AS {_PLACES}, n AS (SELECT normalized_name FROM m GROUP BY 1 HAVING count(*) > 1)
  SELECT m.rec_id AS id, CASE WHEN idx = 0 AND n.normalized_name IS NOT NULL THEN 'name of ' || m.normalized_name ELSE name END AS name, n.normalized_name IS NOT NULL AND idx = 0 AS merged FROM m LEFT JOIN n USING (normalized_name) WHERE idx <> 1""")
def decisions(spark, d):
    rows = T(spark, d, "graph_extraction_clean").filter("normalized_name IS NOT NULL AND rec_id IS NOT NULL").dropDuplicates(["rec_id"]).withColumn("grp", F.col("normalized_name"))
    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy("grp").orderBy("rec_id")) - 1).withColumnRenamed("rec_id", "id")
    answers = rows.select("grp").distinct().withColumn("answer", F.to_json(F.struct(F.array(F.struct(F.lit("merge").alias("type"), F.array(F.lit("0"), F.lit("1"), F.lit("x"), F.lit("999999")).alias("entity_ids"), F.concat(F.lit("name of "), "grp").alias("canonical_name"))).alias("actions"))))
    kept, _ = ar.apply_decisions(rows, ar.actions(answers), {})
    return kept.select("id", "name", F.coalesce(F.col("name").startswith("name of "), F.lit(False)).alias("merged"))


@query()
def threshold_groups(spark, d):
    e = T(spark, d, "graph_extraction_clean").filter("normalized_name IS NOT NULL AND name IS NOT NULL")
    e = e.groupBy(F.col("normalized_name").alias("id")).agg(F.min_by(F.struct("name", "aliases", "type", "context_description"), "rec_id").alias("r")).select("id", "r.*")
    return ar.threshold_groups(e)


@query()
def legacy_deduplication(spark, d):
    e = T(spark, d, "graph_extraction_clean").filter("normalized_name IS NOT NULL AND name IS NOT NULL")
    e = e.groupBy("normalized_name").agg(F.min_by(F.struct(F.col("rec_id").alias("id"), "name", "aliases", "type", "context_description", "confidence"), "rec_id").alias("r")).select("normalized_name", "r.*").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    rules = spark.createDataFrame([("Prophet", 1, 1), ("MotherBeliever", None, 11)], "type string, least int, most int")
    kept, relations, _ = ar.deduplicate(e, T(spark, d, "legacy_relations").dropDuplicates(["rel_id"]).select("rel_id", "source", "target"), ask, rules, {})
    return kept.agg(F.count("*").alias("n")).select(F.lit("entities").alias("what"), "n").unionByName(relations.agg(F.count("*").alias("n")).select(F.lit("relations").alias("what"), "n"))
