"""The named queries over the test tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import similarity as sim
from ..functions import text as fx
from ..operators import graph as g
from ..operators import identity as idn
from ..operators import resolve as rs
from ..operators import retrieval as rt
from ..operators import units as un
from ..schemas import PRICES
from ..sources import tables as tb
from . import providers as pv

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
T = tb.read_table


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_S = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _slug(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(upper(coalesce({x},'')), '[^A-Z0-9{_S}_-]', '', 'g'), '[{_S}-]+', '_', 'g'), '_')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_S}]+|[{_S}]+$', '', 'g')"


def _norm(x: str) -> str:
    y = f"strip_accents(lower({_strip(f'coalesce({x},chr(0))')}))".replace("chr(0)", "''")
    for a, b in ((r"[''`´]", ""), (f"[{_S}]*\\([^)]*\\)", ""), ("[-_]", " "), (r"\bbin\b", "ibn"), (rf"\bal[{_S}]+", ""), (rf"\bas[{_S}]+", ""), ("yy", "y"), ("ss", "s"), (r"sh\b", "ch"), (f"[{_S}]+", " ")):
        y = f"regexp_replace({y}, '{a}', '{b}', 'g')"
    return _strip(y)


RAW = "(SELECT DISTINCT ON (rec_id) * FROM graph_extraction_raw WHERE rec_id IS NOT NULL ORDER BY rec_id, ingested_at)"


def records(spark: SparkSession, d: str) -> DataFrame:
    """Raw records, a re-delivered one as it first came."""
    w = Window.partitionBy("rec_id").orderBy("ingested_at")
    return T(spark, d, "graph_extraction_raw").filter("rec_id IS NOT NULL").withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def links(spark: SparkSession, d: str) -> DataFrame:
    """Entity links: each name and chunk with its best confidence within 0..1."""
    ok = F.when(F.col("confidence").between(0, 1), F.col("confidence"))
    rows = T(spark, d, "graph_extraction_raw").filter("normalized_name IS NOT NULL AND chunk_id IS NOT NULL")
    return rows.groupBy(F.col("normalized_name").alias("entity_id"), "chunk_id").agg(F.coalesce(F.max(ok), F.lit(0.0)).alias("relevance_score"), F.min("doc_id").alias("doc_id"))


LINKS = "(SELECT normalized_name AS entity_id, chunk_id, coalesce(max(CASE WHEN NOT isnan(confidence) AND confidence BETWEEN 0 AND 1 THEN confidence END), 0.0) AS relevance_score, min(doc_id) AS doc_id FROM graph_extraction_raw WHERE normalized_name IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL)"


# Scalar functions


@query(f"SELECT id, {_slug('title')} AS slug FROM encyclopedia")
def slugify(spark, d):
    return T(spark, d, "encyclopedia").select("id", fx.slugify(F.col("title")).alias("slug"))


@query(f"SELECT rec_id, name, {_norm('name')} AS norm FROM {RAW}")
def normalize_name(spark, d):
    return records(spark, d).select("rec_id", "name", fx.normalize_name(F.col("name")).alias("norm"))


@query("SELECT substr(sha256(text),1,16) AS content_id, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_hash_dedup(spark, d):
    return T(spark, d, "documents").filter("text IS NOT NULL").groupBy(fx.content_id(F.col("text")).alias("content_id")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("SELECT id, substr(sha256(title || '_' || type),1,16) AS entity_id FROM encyclopedia")
def entity_id(spark, d):
    return T(spark, d, "encyclopedia").select("id", fx.entity_id(F.col("title"), F.col("type")).alias("entity_id"))


_TYPES = "VALUES " + ",".join(f"('{n}','{c}')" for n, c in dict([(v.upper(), c) for _, v, c in __import__("lexigraph.schemas", fromlist=["TYPES"]).TYPES] + [(n, c) for n, _, c in __import__("lexigraph.schemas", fromlist=["TYPES"]).TYPES]).items())


@query(f"SELECT rec_id, t.c AS category FROM {RAW} r LEFT JOIN ({_TYPES}) t(n, c) ON upper({_strip('r.type')}) = t.n")
def type_category(spark, d):
    return records(spark, d).select("rec_id", fx.type_category(F.col("type")).alias("category"))


_WEIGHTS = "(SELECT rel_id, CASE rel_id % 7 WHEN 0 THEN '9' WHEN 1 THEN '9.5' WHEN 2 THEN '.5' WHEN 3 THEN '-1' WHEN 4 THEN '1e3' WHEN 5 THEN '' ELSE '.' END AS w FROM legacy_relations)"


@query(f"SELECT rel_id, w, CASE WHEN regexp_matches(w, '^[0-9]*\\.?[0-9]*$') AND regexp_matches(w, '[0-9]') THEN w::DOUBLE ELSE 1.0 END AS weight FROM {_WEIGHTS}")
def weight_parse(spark, d):
    w = F.element_at(F.array(*[F.lit(x) for x in ("9", "9.5", ".5", "-1", "1e3", "", ".")]), (F.col("rel_id") % 7 + 1).cast("int"))
    return T(spark, d, "legacy_relations").select("rel_id", w.alias("w"), fx.weight(w).alias("weight"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers in the tuple format, one a relation: both ends as entities, a relationship, and a block that is no record."""
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '["()#<>]', ""), F.lit('"'))
    s, t = q(F.col("source")), q(F.col("target"))
    raw = F.concat(F.lit('("entity"<|>'), s, F.lit("<|>Person<|>src)##\n (\"ENTITY\"<|>"), t, F.lit('<|>Place<|>dst)##11. ("entity"<|>X<|>Y<|>Z)##("relationship"<|>'), s, F.lit("<|>"), t, F.lit("<|>told<|>"), F.coalesce((F.col("confidence") * 100).cast("int").cast("string"), F.lit("")), F.lit(") <|COMPLETE|>"))
    return T(spark, d, "legacy_relations").dropDuplicates(["rel_id"]).select(F.col("rel_id").alias("unit_id"), raw.alias("answer"))


_REL = "(SELECT DISTINCT ON (rel_id) * FROM legacy_relations ORDER BY rel_id)"
_Q = "trim(regexp_replace(coalesce({x},''), '[\"()#<>]', '', 'g'), chr(39))"


@query(f"SELECT rel_id AS unit_id, {_Q.format(x='source')} AS source, {_Q.format(x='target')} AS target, 'told' AS description, CASE WHEN confidence IS NULL OR isnan(confidence) OR confidence < 0 THEN CASE WHEN confidence IS NULL THEN 1.0 WHEN isnan(confidence) THEN 0.0 ELSE 1.0 END ELSE trunc(confidence*100)::INT::DOUBLE END AS weight FROM {_REL}")
def tuple_parse(spark, d):
    return pv.answers_to_graph(answers(spark, d))[1]


@query(f"SELECT title, type, count(*) AS mentions FROM (SELECT {_Q.format(x='source')} AS title, 'Person' AS type FROM {_REL} UNION ALL SELECT {_Q.format(x='target')}, 'Place' FROM {_REL}) GROUP BY ALL")
def tuple_entities(spark, d):
    return pv.answers_to_graph(answers(spark, d))[0].groupBy("title", "type").agg(F.count("*").alias("mentions"))


@query("SELECT event_id, (props->>'k')::INT AS k FROM events")
def json_extract(spark, d):
    fenced = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))
    return T(spark, d, "events").select("event_id", F.from_json(fx.json_part(fenced), "k int")["k"].alias("k"))


@query("SELECT chunk_id, any_value(CASE WHEN length(f) > 300 THEN substr(f,1,250) || '...' ELSE f END) AS snippet FROM (SELECT chunk_id, trim(replace(chunk_text, chr(10), ' ')) AS f FROM chunks) GROUP BY 1")
def snippets(spark, d):
    return T(spark, d, "chunks").groupBy("chunk_id").agg(F.any_value(fx.snippet(F.col("chunk_text"))).alias("snippet"))


@query("""SELECT chunk_id, any_value(concat_ws(chr(10)||chr(10), CASE WHEN trim(chunk_heading_full) NOT IN ('', 'Sans titre') THEN '[SECTION] ' || trim(chunk_heading_full) END, chunk_text)) AS text_for_reranker,
  any_value(concat_ws(chr(10), CASE WHEN trim(chunk_heading_full) <> '' THEN '# ' || trim(chunk_heading_full) END, chunk_text)) AS text_for_embedding FROM chunks GROUP BY 1""")
def chunk_texts(spark, d):
    none = F.lit(None).cast("string")
    return T(spark, d, "chunks").groupBy("chunk_id").agg(
        F.any_value(fx.reranker_text(none, F.col("chunk_heading_full"), F.col("chunk_text"))).alias("text_for_reranker"),
        F.any_value(fx.embedding_text(F.col("chunk_heading_full"), F.col("chunk_text"), none)).alias("text_for_embedding"),
    )


@query("SELECT DISTINCT name, 'llm_cache:' || sha256('[\"' || name || '\"]' || chr(10) || 'mini') AS key FROM graph_extraction_raw WHERE name IS NOT NULL")
def cache_keys(spark, d):
    names = T(spark, d, "graph_extraction_raw").filter("name IS NOT NULL").select("name").distinct()
    return names.select("name", fx.cache_key(F.array("name"), F.lit("mini")).alias("key"))


@query()
def lcs_ratio(spark, d):
    e = T(spark, d, "encyclopedia").select("category", "slug").filter("category IS NOT NULL")
    n = e.withColumn("next", F.lead("slug").over(Window.partitionBy("category").orderBy("slug"))).filter("next IS NOT NULL")
    return n.select("slug", "next", F.round(sim.lcs_ratio_column(F.col("slug"), F.col("next")), 6).alias("ratio"), F.round(sim.gestalt_column(F.col("slug"), F.col("next")), 6).alias("gestalt"))


@query()
def phonetic_key(spark, d):
    return T(spark, d, "encyclopedia").select("slug", sim.metaphone_column(F.regexp_replace(fx.strip_accents(F.col("title")), "-", " ")).alias("sound"))


# Text units


@query("SELECT doc_id, pos, substr(sha256(doc_id || '|' || pos || '|' || line),1,16) AS unit_id, line FROM (SELECT doc_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE " + _strip("line") + " <> ''")
def line_units(spark, d):
    return un.line_units(T(spark, d, "documents"))


_W = f"list_filter(regexp_split_to_array(coalesce(text,''), '[{_S}]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, w AS \"window\", w*80 AS first, len(p) AS words, array_to_string(p,' ') AS piece FROM (SELECT doc_id, w, list_slice(l, w*80+1, w*80+100) AS p FROM (SELECT doc_id, l, unnest(range(0, 1 + greatest(0, ceil((len(l)-100)/80.0)::INT))) AS w FROM (SELECT doc_id, {_W} AS l FROM documents) WHERE len(l) > 0))")
def token_windows(spark, d):
    return un.token_windows(T(spark, d, "documents"), "doc_id", "text", 100, 20)


@query()
def recursive_split(spark, d):
    docs = T(spark, d, "documents").select(F.col("doc_id").cast("string").alias("unit_id"), "text", F.col("source").alias("heading"))
    return un.recursive_split(docs, max_tokens=200, overlap=30)


_CH = "(SELECT DISTINCT ON (chunk_id) * FROM chunks ORDER BY chunk_id)"
_HEAD = """CASE WHEN h = '' OR (regexp_matches(h,'^["«“]') <> regexp_matches(h,'["»”]$')) OR regexp_matches(h,'^\\d+$') OR regexp_matches(h,'^[^\\pL\\pN_\\s]+$') OR regexp_matches(h,'(?i)^page\\s*\\d+$') OR regexp_matches(h,'^\\d+\\s*€$') OR regexp_matches(h,'^©.*$') OR regexp_matches(h,'^\\d{2}/\\d{2}/\\d{4}$') THEN 'Section générale' ELSE h END"""


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "chunks").dropDuplicates(["chunk_id"])


@query(f"SELECT chunk_id, pos, {_HEAD} AS heading FROM (SELECT chunk_id, pos, {_strip('line')} AS h FROM (SELECT chunk_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS line FROM (SELECT chunk_id, string_split(chunk_text, chr(10)) AS l FROM {_CH})) WHERE {_strip('line')} <> '')")
def heading_filter(spark, d):
    lines = un.line_units(chunk_rows(spark, d), "chunk_id", "chunk_text")
    return lines.select("chunk_id", "pos", fx.clean_heading(F.col("line")).alias("heading"))


@query(f"SELECT chunk_id, coalesce(last_value(CASE WHEN c NOT IN ('Section générale','Contenu informatif') THEN c END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_index, chunk_id ROWS UNBOUNDED PRECEDING), 'Section générale') AS heading_refined FROM (SELECT *, {_HEAD} AS c FROM (SELECT chunk_id, doc_id, chunk_index, {_strip('coalesce(chunk_headings[1], chr(0))').replace('chr(0)', chr(39) + 'Section générale' + chr(39))} AS h FROM {_CH}))")
def heading_inherit(spark, d):
    rows = chunk_rows(spark, d).withColumn("o", F.struct("chunk_index", "chunk_id"))
    return un.inherit_heading(rows, "doc_id", "o", "chunk_headings").select("chunk_id", "heading_refined")


@query(f"SELECT chunk_id, coalesce(array_to_string(last_value(CASE WHEN len(chunk_headings) > 0 THEN chunk_headings END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_index, chunk_id ROWS UNBOUNDED PRECEDING), ' > '), '') AS path FROM {_CH}")
def heading_path_inherit(spark, d):
    rows = chunk_rows(spark, d).withColumn("o", F.struct("chunk_index", "chunk_id"))
    return un.inherit_path(rows, "doc_id", "o", "chunk_headings").select("chunk_id", fx.heading_path(F.col("heading_path")).alias("path"))


@query(f"SELECT chunk_id, t || CASE WHEN n > 0 THEN ' (Suite ' || n || ')' ELSE '' END AS numbered FROM (SELECT chunk_id, t, count(*) OVER (PARTITION BY doc_id, t ORDER BY chunk_index, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM (SELECT *, coalesce(chunk_heading_full, 'Sans titre') AS t FROM {_CH}))")
def running_suffix(spark, d):
    rows = chunk_rows(spark, d).withColumn("o", F.struct("chunk_index", "chunk_id")).withColumn("t", F.coalesce("chunk_heading_full", F.lit("Sans titre")))
    return un.numbered_titles(rows, "doc_id", "t", "o").select("chunk_id", "numbered")


@query(f"SELECT chunk_id FROM (SELECT chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, chunk_id) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM {_CH}) WHERE k < 2 OR k BETWEEN n // 2 AND n // 2 + 1 OR k >= n - 2")
def sample_222(spark, d):
    rows = chunk_rows(spark, d).withColumn("o", F.struct("chunk_index", "chunk_id"))
    return un.sample_ends(rows, "doc_id", "o").select("chunk_id")


@query(f"SELECT doc_id, heading, first FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first, heading) AS k FROM (SELECT doc_id, chunk_headings[-1] AS heading, min(chunk_index) AS first FROM {_CH} WHERE len(chunk_headings) > 0 AND chunk_headings[-1] IS NOT NULL GROUP BY ALL)) WHERE k <= 20")
def distinct_headings(spark, d):
    return un.distinct_headings(chunk_rows(spark, d), "doc_id", "chunk_index", "chunk_headings").select("doc_id", "heading", "first")


_TOC = " OR ".join(f"contains(w, '{k}')" for k in fx.TOC_WORDS)


@query(f"SELECT doc_id, chunk_text, first FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS k FROM (SELECT doc_id, chunk_text, min(chunk_index) AS first FROM (SELECT *, lower(array_to_string(chunk_headings,' ')) || chr(10) || lower(substr(coalesce(chunk_text,''),1,200)) AS w FROM {_CH}) WHERE {_TOC} GROUP BY ALL)) WHERE k <= 3")
def toc_units(spark, d):
    return un.toc_units(chunk_rows(spark, d), "doc_id", "chunk_index", "chunk_headings", "chunk_text").select("doc_id", "chunk_text", "first")


@query("SELECT doc_id, regexp_matches(text, '\\|[- :]+\\|') AS is_table FROM documents")
def table_units(spark, d):
    return T(spark, d, "documents").select("doc_id", fx.is_markdown_table(F.col("text")).alias("is_table"))


@query("SELECT doc_id, t AS title FROM (SELECT doc_id, trim(regexp_extract(" + _strip("unnest(string_split(text, chr(10)))") + ", '^[-*•]\\s*(?:\\d+[.)]\\s*)?(.+?)(?:\\s*\\(p\\.\\d+\\))?$', 1)) AS t FROM documents) WHERE length(t) > 3")
def outline_titles(spark, d):
    return T(spark, d, "documents").select("doc_id", F.explode(fx.outline_titles(F.col("text"))).alias("title"))


@query("SELECT doc_id, NOT coalesce(bool_or(length(trim(chunk_text)) > 50), false) AS needs_ocr FROM chunks WHERE chunk_index < 3 GROUP BY 1")
def ocr_needed(spark, d):
    return un.needs_ocr(T(spark, d, "chunks"), "doc_id", "chunk_index", "chunk_text")


@query("SELECT doc_id, coalesce(bool_or(length(coalesce(trim(chunk_text),'')) < 50 AND coalesce(len(chunk_images_urls),0) >= 1), false) AS needs_ocr FROM chunks WHERE chunk_index < 3 GROUP BY 1")
def ocr_needed_legacy(spark, d):
    pages = T(spark, d, "chunks").withColumn("images", F.greatest(F.coalesce(F.size("chunk_images_urls"), F.lit(0)), F.lit(0)))
    return un.needs_ocr_legacy(pages, "doc_id", "chunk_index", "chunk_text", "images")


_BOX = f"(SELECT chunk_id, doc_id, chunk_index, chunk_page_numbers AS pages, coalesce((chunk_metadata->'bbox'->>'top')::DOUBLE, 0) AS top, coalesce((chunk_metadata->'bbox'->>'bottom')::DOUBLE, 1000) AS bottom, chunk_images_urls AS urls FROM {_CH})"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    meta = F.from_json("chunk_metadata", "bbox struct<top: double, bottom: double>")["bbox"]
    return chunk_rows(spark, d).select("chunk_id", "doc_id", "chunk_index", F.col("chunk_page_numbers").alias("pages"), F.coalesce(meta["top"], F.lit(0.0)).alias("top"), F.coalesce(meta["bottom"], F.lit(1000.0)).alias("bottom"), F.col("chunk_images_urls").alias("urls"))


@query(f"""WITH c AS {_BOX}, img AS (SELECT DISTINCT unnest(urls) AS image_id, doc_id, pages[1] AS page, top, bottom FROM c WHERE len(pages) > 0),
  i AS (SELECT image_id, min(doc_id) AS doc_id, arg_min(page, doc_id*1000000+top) AS page, arg_min(top, doc_id*1000000+top) AS top, arg_min(bottom, doc_id*1000000+top) AS bottom FROM img GROUP BY 1),
  p AS (SELECT i.image_id, c.chunk_id, c.chunk_index FROM i JOIN (SELECT *, unnest(pages) AS page, len(pages) AS n FROM c) c ON c.doc_id = i.doc_id AND c.page = i.page
    WHERE ((i.top+i.bottom)/2 BETWEEN c.top-100 AND c.bottom+100 OR c.n = 1) AND abs(i.bottom-i.top)/greatest(abs(c.bottom-c.top),1e-9) > 0.05)
  SELECT image_id, arg_min(chunk_id, lpad(chunk_index::VARCHAR,9,'0') || chunk_id) AS chunk_id FROM p GROUP BY 1""")
def image_chunks(spark, d):
    c = boxes(spark, d)
    img = c.filter("size(pages) > 0").select(F.explode("urls").alias("image_id"), "doc_id", F.element_at("pages", 1).alias("page"), "top", "bottom").distinct()
    first = F.col("doc_id") * 1000000 + F.col("top")
    one = img.groupBy("image_id").agg(F.min_by("page", first).alias("page"), F.min_by("top", first).alias("top"), F.min_by("bottom", first).alias("bottom"), F.min("doc_id").alias("doc_id"))
    return un.assign_images(c, one)


@query(f"SELECT doc_id, min(top) AS top, max(bottom) AS bottom, array_to_string(list_sort(list_distinct(flatten(list(coalesce(pages, []))))), ',') AS pages FROM {_BOX} GROUP BY 1")
def page_boxes(spark, d):
    rows = boxes(spark, d).withColumn("page", F.explode_outer("pages"))
    return un.bounding_box(rows, "doc_id", "top", "bottom", "page").withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


# Graph


@query(f"""WITH e AS (SELECT {_slug('normalized_name')} AS slug, arg_max(rec_id, rec_id) AS id FROM graph_extraction_clean WHERE normalized_name IS NOT NULL GROUP BY 1),
  r AS (SELECT {_slug('source')} AS s, {_slug('target')} AS t, coalesce(confidence, 1.0) AS w, coalesce(evidence,'') AS ev, doc_id FROM {_REL})
  SELECT a.id AS source_id, b.id AS target_id, count(*) AS edges, round(sum(CASE WHEN isnan(w) THEN 0 ELSE w END), 6) AS weight, array_to_string(list_sort(list_distinct(list_filter(list(ev), lambda x: x <> ''))), ' | ') AS description
  FROM r JOIN e a ON a.slug = r.s JOIN e b ON b.slug = r.t WHERE a.id <> b.id GROUP BY 1, 2""")
def edges_build(spark, d):
    e = T(spark, d, "graph_extraction_clean").filter("normalized_name IS NOT NULL").select(F.col("rec_id").alias("id"), fx.slugify(F.col("normalized_name")).alias("slug"), F.col("rec_id").alias("pos"))
    rel = g.slug_edges(T(spark, d, "legacy_relations")).withColumn("weight", F.when(F.isnan("weight"), 0.0).otherwise(F.col("weight")))
    out = g.remap_relationships(rel.withColumn("rank", F.lit(1)), e)
    counts = out.groupBy("source_id", "target_id").agg(F.count("*").alias("edges"))
    return g.consolidate_relationships(out).join(counts, ["source_id", "target_id"]).select("source_id", "target_id", "edges", F.round("weight", 6).alias("weight"), "description")


@query(f"SELECT rel_id FROM {_REL} WHERE source IN (SELECT normalized_name FROM graph_extraction_raw) AND target IN (SELECT normalized_name FROM graph_extraction_raw)")
def orphan_filter(spark, d):
    return g.drop_orphans(T(spark, d, "legacy_relations").dropDuplicates(["rel_id"]), T(spark, d, "graph_extraction_raw"), "source", "target", "normalized_name").select("rel_id")


_RT = "coalesce(nullif(upper(replace(trim(type), ' ', '_')), ''), 'RELATED_TO')"


@query(f"SELECT source, {_RT} AS type, target, count(*) AS occurrence_count, coalesce(array_to_string(list_sort(list_distinct(list_filter(list(evidence), lambda x: x IS NOT NULL))), ' | '),'') AS evidences FROM legacy_relations WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY ALL")
def edge_merge(spark, d):
    return g.merge_edges(T(spark, d, "legacy_relations").filter("source IS NOT NULL AND target IS NOT NULL")).withColumn("evidences", F.array_join("evidences", " | "))


@query("SELECT normalized_name AS id, array_to_string(list_sort(list_distinct(list(type))), ',') AS labels FROM graph_extraction_raw WHERE normalized_name IS NOT NULL AND type IS NOT NULL GROUP BY 1")
def node_labels(spark, d):
    rows = T(spark, d, "graph_extraction_raw").filter("normalized_name IS NOT NULL AND type IS NOT NULL").select(F.col("normalized_name").alias("id"), F.array("type").alias("labels")).distinct()
    return g.merge_nodes(rows).withColumn("labels", F.array_join("labels", ","))


@query("WITH l AS (SELECT DISTINCT normalized_name AS e, chunk_id AS c FROM graph_extraction_raw WHERE normalized_name IS NOT NULL AND chunk_id IS NOT NULL) SELECT a.e AS entity_a, b.e AS entity_b, count(*) AS co_occurrence_count FROM l a JOIN l b ON a.c = b.c AND a.e < b.e GROUP BY 1, 2")
def cooccurrence(spark, d):
    return g.cooccurrences(T(spark, d, "graph_extraction_raw"), "normalized_name", "chunk_id")


@query("SELECT node, count(*) AS degree FROM (SELECT source AS node FROM legacy_relations UNION ALL SELECT target FROM legacy_relations) WHERE node IS NOT NULL GROUP BY 1")
def node_degree(spark, d):
    return g.degrees(T(spark, d, "legacy_relations"), "source", "target")


@query(f"SELECT DISTINCT t AS type FROM (SELECT {_RT} AS t FROM legacy_relations) WHERE t NOT IN ('ALLIED_WITH','TEACHER_OF','FAMILY_OF')")
def unofficial_types(spark, d):
    return g.unofficial_types(T(spark, d, "legacy_relations"), spark.createDataFrame([("ALLIED_WITH",), ("TEACHER_OF",), ("FAMILY_OF",)], "type string"))


@query(f"SELECT CASE t WHEN 'LIVED_IN' THEN 'LOCATED_AT' WHEN 'RELATED_TO' THEN 'LINKED' ELSE t END AS type, count(*) AS edges FROM (SELECT {_RT} AS t FROM legacy_relations) GROUP BY 1")
def relation_types(spark, d):
    to = spark.createDataFrame([("lived in", "LOCATED_AT"), ("related to", "LINKED")], "variant string, official string")
    return g.retype(T(spark, d, "legacy_relations"), to).groupBy("type").agg(F.count("*").alias("edges"))


@query("""WITH c AS (SELECT DISTINCT ON (rec_id) rec_id, coalesce(aliases, []) AS al FROM graph_extraction_clean ORDER BY rec_id), u AS (SELECT n FROM (SELECT """ + _norm("a") + """ AS n FROM (SELECT unnest(al) AS a FROM c) WHERE a IS NOT NULL) WHERE n <> '' GROUP BY n HAVING count(*) >= 3),
  x AS (SELECT rec_id, unnest(CASE WHEN len(al) = 0 THEN [NULL] ELSE al END) AS a FROM c)
  SELECT rec_id, count(*) FILTER (WHERE a IS NOT NULL AND """ + _norm("a") + """ NOT IN (SELECT n FROM u)) AS kept FROM x GROUP BY 1""")
def common_alias(spark, d):
    rows = T(spark, d, "graph_extraction_clean").dropDuplicates(["rec_id"]).select("rec_id", F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull()).alias("aliases"))
    return g.drop_common_aliases(rows, "rec_id").select("rec_id", F.size("aliases").alias("kept"))


@query(f"SELECT r.type, coalesce(f.n, 0) AS found, (coalesce(f.n,0) >= coalesce(least,0) AND (most IS NULL OR coalesce(f.n,0) <= most)) AS valid FROM (VALUES ('Sahabi',1,NULL),('Tribe',1,11),('Prophet',1,1),('Battle',NULL,100000)) r(type, least, most) LEFT JOIN (SELECT type, count(*) AS n FROM {RAW} GROUP BY 1) f ON f.type = r.type")
def rule_validation(spark, d):
    rules = spark.createDataFrame([("Sahabi", 1, None), ("Tribe", 1, 11), ("Prophet", 1, 1), ("Battle", None, 100000)], "type string, least int, most int")
    return g.validate(records(spark, d), rules).select("type", "found", "valid")


@query()
def graph_communities(spark, d):
    return g.communities(T(spark, d, "legacy_relations"), "source", "target", levels=2, rounds=4)


# Resolution


@query("""WITH m AS (SELECT normalized_name AS k, name, aliases, context_description AS c, confidence FROM graph_extraction_clean WHERE normalized_name IS NOT NULL AND name IS NOT NULL),
  n AS (SELECT k, arg_max(name, lpad(length(name)::VARCHAR,5,'0') || (contains(lower(name),'bint') OR contains(lower(name),'ibn'))::INT || (contains(lower(name),'abu ') OR contains(lower(name),'um ') OR contains(lower(name),'umm '))::INT || name) AS name,
    coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter(list(nullif(trim(c),'')), lambda x: x IS NOT NULL))), ' | '), ''), 'No description available') AS context_description, max(confidence) AS confidence FROM m GROUP BY k)
  SELECT k, name, context_description, CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS confidence FROM n""")
def canonical_merge(spark, d):
    rows = T(spark, d, "graph_extraction_clean").filter("normalized_name IS NOT NULL").withColumnRenamed("normalized_name", "k")
    return rs.canonical_merge(rows, "k", {}).select("k", "name", "context_description", fx.nan_to_null(F.col("confidence")).alias("confidence"))


@query("""SELECT normalized_name AS id, arg_min(name, rec_id) FILTER (name IS NOT NULL) AS title, arg_min(type, rec_id) FILTER (type IS NOT NULL) AS type,
  array_to_string(list_sort(list_distinct(list_filter(list(nullif(context_description,'')), lambda x: x IS NOT NULL))), ' | ') AS description, count(DISTINCT doc_id) AS frequency FROM (SELECT * FROM """ + RAW + """) WHERE normalized_name IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1""")
def entity_consolidate(spark, d):
    rows = records(spark, d).filter("normalized_name IS NOT NULL AND doc_id IS NOT NULL").select(
        F.col("normalized_name").alias("id"), F.col("name").alias("title"), "type", F.lit(None).cast("string").alias("slug"), F.lit(None).cast("string").alias("category"),
        F.col("context_description").alias("description"), F.array(F.col("doc_id").cast("string")).alias("source_ids"), F.lit(1).alias("rank"), F.col("rec_id").alias("pos"),
    )
    return rs.consolidate(rows).select("id", "title", "type", "description", F.col("frequency").cast("long").alias("frequency"))


def named_entities(spark: SparkSession, d: str) -> DataFrame:
    """The keyed records as entities, one row a normalised name, with the number of its records."""
    rows = T(spark, d, "graph_extraction_clean").filter("normalized_name IS NOT NULL AND name IS NOT NULL").groupBy(F.col("normalized_name").alias("id"))
    rows = rows.agg(F.min_by("name", "rec_id").alias("title"), F.min("type").alias("type"), F.count("*").cast("int").alias("frequency"), F.min("rec_id").alias("pos"), F.max("context_description").alias("description"))
    return rows.withColumns({"category": fx.type_category(F.col("type")), "rank": F.lit(1), "source_ids": F.array("id")})


@query()
def greedy_pivot(spark, d):
    return rs.greedy_pivots(named_entities(spark, d))


@query()
def cluster_collapse(spark, d):
    e = named_entities(spark, d)
    return rs.collapse_clusters(e, rs.greedy_pivots(e)).select("id", "title", "frequency", F.size("source_ids").alias("sources"))


@query(f"""WITH p AS (SELECT DISTINCT {_norm('normalized_name')} AS id FROM graph_extraction_clean WHERE normalized_name IS NOT NULL), r AS (
  SELECT DISTINCT {_slug('name')} AS key, type FROM graph_extraction_clean WHERE name IS NOT NULL), t AS (SELECT r.key, c.c AS category FROM r JOIN ({_TYPES}) c(n, c) ON upper(trim(r.type)) = c.n WHERE key <> ''),
  k AS (SELECT slug, category, slug AS k FROM encyclopedia UNION SELECT slug, category, {_slug('a')} FROM (SELECT slug, category, unnest(properties.aliases) AS a FROM encyclopedia)),
  h AS (SELECT t.key, t.category, count(DISTINCT k.slug) AS n, min(k.slug) AS one FROM t LEFT JOIN k ON k.category = t.category AND k.k <> '' AND (t.key = k.k OR length(t.key) > 4 AND k.k LIKE '%' || t.key || '%') GROUP BY 1, 2)
  SELECT key, category, n AS candidates, CASE WHEN n = 1 THEN one END AS canonical_id, CASE WHEN n = 1 THEN 'CORE_VALIDATED' WHEN n > 1 THEN 'PENDING' ELSE 'NOT_KNOWN' END AS review_status FROM h""")
def anchor(spark, d):
    e = T(spark, d, "graph_extraction_clean").filter("name IS NOT NULL").select(fx.slugify(F.col("name")).alias("title"), fx.type_category(F.col("type")).alias("category")).filter("title <> '' AND category IS NOT NULL").distinct()
    e = e.withColumn("id", F.concat_ws("|", "title", "category"))
    out = rs.anchor(e, T(spark, d, "encyclopedia"))
    return out.join(e.select("id", F.col("title").alias("key"), "category"), "id").select("key", "category", F.size("candidates").cast("long").alias("candidates"), "canonical_id", "review_status")


@query("SELECT category, count(*) AS entries, sum(is_verified::INT) AS verified FROM encyclopedia WHERE coalesce(review_status,'') <> 'OFFICIAL' GROUP BY 1")
def orphans_by_category(spark, d):
    e = T(spark, d, "encyclopedia").filter("coalesce(review_status, '') <> 'OFFICIAL'")
    return e.groupBy("category").agg(F.count("*").alias("entries"), F.sum(F.col("is_verified").cast("int")).alias("verified"))


@query("""WITH RECURSIVE p AS (SELECT trim(left_name) AS l, trim(right_name) AS r, pair_id FROM match_pairs WHERE left_name IS NOT NULL AND right_name IS NOT NULL),
  v AS (SELECT greatest(l, r) AS s, least(l, r) AS t, pair_id FROM p WHERE l <> r AND l <> '' AND r <> '' AND lower(l) <> 'nan' AND lower(r) <> 'nan'),
  f AS (SELECT s, arg_max(t, pair_id) AS t FROM v GROUP BY s), w(s, e, n) AS (SELECT s, t, 1 FROM f UNION ALL SELECT w.s, f.t, n + 1 FROM w JOIN f ON f.s = w.e)
  SELECT s AS source, arg_max(e, n) AS target FROM w GROUP BY s""")
def redirects(spark, d):
    left, right = F.trim("left_name"), F.trim("right_name")
    p = T(spark, d, "match_pairs").filter(left.isNotNull() & right.isNotNull()).select(F.greatest(left, right).alias("source"), F.least(left, right).alias("target"), F.col("pair_id").alias("stage"))
    return rs.resolve_redirects(rs.valid_redirects(p))


_KEYED = "(SELECT normalized_name AS id, coalesce(min(type),'') AS type, normalized_name || ' ' || coalesce(max(context_description),'') AS t FROM graph_extraction_clean WHERE normalized_name IS NOT NULL GROUP BY 1)"


def keyed(spark: SparkSession, d: str) -> DataFrame:
    """The keyed records: one row a normalised name, with the text by which names are compared."""
    rows = T(spark, d, "graph_extraction_clean").filter("normalized_name IS NOT NULL").groupBy(F.col("normalized_name").alias("id")).agg(F.coalesce(F.min("type"), F.lit("")).alias("type"), F.max("context_description").alias("c"))
    return rows.select("id", "type", F.concat(F.col("id"), F.lit(" "), F.coalesce("c", F.lit(""))).alias("t"))


def _tfidf(least: float) -> str:
    return f"""w AS (SELECT id, type, unnest({_TERMS.format(x='t')}) AS t FROM {_KEYED}), tf AS (SELECT id, type, t, count(*) AS tf FROM w WHERE length(t) > 1 AND t NOT IN {_stop()} GROUP BY ALL),
  n AS (SELECT type, count(DISTINCT id) AS n FROM tf GROUP BY 1), df AS (SELECT type, t, count(*) AS df FROM tf GROUP BY ALL),
  x AS (SELECT id, type, t, tf * (ln((1+n)/(1+df)) + 1) AS w FROM tf JOIN n USING (type) JOIN df USING (type, t)), u AS (SELECT id, type, t, w / sqrt(sum(w*w) OVER (PARTITION BY id)) AS w FROM x),
  p AS (SELECT a, b, score FROM (SELECT a.id AS a, b.id AS b, round(sum(a.w*b.w), 6) AS score FROM u a JOIN u b ON a.type = b.type AND a.t = b.t AND a.id < b.id GROUP BY 1, 2) WHERE score >= {least})"""


# Retrieval


_COS = "list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q::DOUBLE[], q::DOUBLE[]))"


@query(f"SELECT query_id, vec_id, round(round(score, 9), 6) AS score FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS k FROM (SELECT query_id, vec_id, {_COS} AS score FROM embeddings, (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)) WHERE round(score, 9) >= 0.05) WHERE k <= 50")
def vector_topk(spark, d):
    rows = T(spark, d, "embeddings")
    queries_ = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))  # the stated queries of a search
    return rt.vector_topk_each(rows, queries_, 50).select("query_id", "vec_id", F.round("score", 6).alias("score"))


_TERMS = "list_filter(regexp_split_to_array(lower(coalesce({x},'')), '[^\\pL\\pN]+'), lambda w: w <> '')"


@query(f"""WITH d AS (SELECT doc_id, {_TERMS.format(x='text')} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS m FROM d),
  q AS (SELECT DISTINCT item_id, unnest({_TERMS.format(x='question')}) AS t FROM eval_items),
  h AS (SELECT doc_id, len, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL), f AS (SELECT t, count(*) AS df FROM h GROUP BY 1),
  r AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / m))), 6) AS score FROM h JOIN f USING (t) JOIN q USING (t), s GROUP BY ALL)
  SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 15""")
def bm25_topk(spark, d):
    out = rt.bm25_topk(T(spark, d, "documents"), T(spark, d, "eval_items"), "doc_id", "text", "item_id", "question")
    return out.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT term, count(*) AS docs, sum(tf) AS uses FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS.format(x='text')}) AS term FROM documents) GROUP BY ALL) GROUP BY 1")
def postings_terms(spark, d):
    return rt.postings(T(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("uses"))


def _stop() -> str:
    return "(" + ",".join(f"'{w}'" for w in rt.STOP_WORDS) + ")"


@query(f"WITH {_tfidf(0.3)} SELECT * FROM p")
def tfidf_pairs(spark, d):
    return rt.tfidf_pairs(keyed(spark, d), "id", "t", 0.3, "type")


@query(f"""WITH RECURSIVE {_tfidf(0.3)}, e AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), reach(x, y) AS (SELECT id, id FROM {_KEYED} UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x)
  SELECT x AS node, min(y) AS grp FROM reach GROUP BY 1""")
def resolution_groups(spark, d):
    e = keyed(spark, d)
    return rs.similarity_groups(rt.tfidf_pairs(e, "id", "t", 0.3, "type", links=True), e.select(F.col("id").alias("node")), 0.3)


_RANK = f"(SELECT 'conf' AS ranking, chunk_id, max(relevance_score) AS score FROM {LINKS} GROUP BY 2 UNION ALL SELECT 'size', chunk_id, count(*)::DOUBLE FROM {LINKS} GROUP BY 2)"


def _rankings(spark, d):
    li = links(spark, d).groupBy("chunk_id").agg(F.max("relevance_score").alias("a"), F.count("*").cast("double").alias("b"))
    return li.select("chunk_id", F.explode(F.array(F.struct(F.lit("conf").alias("ranking"), F.col("a").alias("score")), F.struct(F.lit("size").alias("ranking"), F.col("b").alias("score")))).alias("s")).select("chunk_id", "s.*")


@query(f"SELECT chunk_id, round(sum(1.0/(60+k)), 9) AS score FROM (SELECT chunk_id, row_number() OVER (PARTITION BY ranking ORDER BY score DESC, chunk_id) AS k FROM {_RANK}) GROUP BY 1 ORDER BY score DESC, chunk_id LIMIT 200")
def rrf(spark, d):
    return rt.rank_fusion(_rankings(spark, d), "chunk_id", 60, 200)


_HITS = f"(SELECT chunk_id, max(relevance_score) AS score FROM {LINKS} GROUP BY 1)"
_SURE = f"(SELECT * FROM {_HITS} WHERE score >= 0.9)"


def _hits(spark, d):
    return links(spark, d).groupBy("chunk_id").agg(F.max("relevance_score").alias("score"))


@query(f"""WITH r AS (SELECT h.chunk_id, c.doc_id, c.chunk_index, h.score, false AS is_identity FROM {_HITS} h JOIN {_CH} c USING (chunk_id)), b AS (SELECT doc_id, max(score) AS best FROM r GROUP BY 1),
  i AS (SELECT chunk_id, doc_id, -1 AS chunk_index, 1.0 AS score, true AS is_identity FROM {_CH} WHERE chunk_type = 'IDENTITY' AND doc_id IN (SELECT doc_id FROM b) AND chunk_id NOT IN (SELECT chunk_id FROM r))
  SELECT chunk_id, doc_id, is_identity, row_number() OVER (ORDER BY best DESC, doc_id, is_identity DESC, chunk_index, chunk_id) AS position FROM (SELECT * FROM r UNION ALL SELECT * FROM i) JOIN b USING (doc_id)""")
def context_group(spark, d):
    c = chunk_rows(spark, d)
    return rt.group_context(_hits(spark, d), c, c.filter("chunk_type = 'IDENTITY'")).select("chunk_id", "doc_id", "is_identity", F.col("position").cast("long").alias("position"))


@query(f"SELECT chunk_id, part, position FROM (SELECT *, row_number() OVER (ORDER BY part, score DESC, chunk_id) AS position FROM (SELECT chunk_id, score, 0 AS part FROM {_SURE} UNION ALL SELECT chunk_id, score, 1 FROM {_HITS} WHERE chunk_id NOT IN (SELECT chunk_id FROM {_SURE}))) WHERE position <= 400")
def strategy_fill(spark, d):
    every = _hits(spark, d)
    return rt.fill(every.filter("score >= 0.9"), every, 400).select("chunk_id", "part", F.col("position").cast("long").alias("position"))


@query(f"SELECT entity_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY relevance_score DESC NULLS LAST, chunk_id) AS rank FROM {LINKS}) WHERE rank <= 20")
def link_topk(spark, d):
    return rt.top_per_entity(links(spark, d), 20).select("entity_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


_TAGS = """t AS (SELECT DISTINCT coalesce(type,'?') AS tag_id FROM graph_extraction_raw), et AS (SELECT DISTINCT coalesce(type,'?') AS tag_id, normalized_name AS entity_id FROM graph_extraction_raw WHERE normalized_name IS NOT NULL), en AS (SELECT normalized_name AS entity_id, min(type) AS entity_type FROM graph_extraction_raw WHERE normalized_name IS NOT NULL GROUP BY 1)"""


def _tags(spark, d):
    raw = T(spark, d, "graph_extraction_raw").select(F.coalesce("type", F.lit("?")).alias("tag_id"), F.col("normalized_name").alias("entity_id"), "type", "chunk_id", "doc_id")
    named = raw.filter("entity_id IS NOT NULL")
    return raw.select("tag_id", F.col("tag_id").isin("Tribe", "City").alias("is_system")).distinct(), named.select("tag_id", "entity_id").distinct(), named.groupBy("entity_id").agg(F.min("type").alias("entity_type"))


@query(f"""WITH {_TAGS}, l AS {LINKS}, x AS (SELECT t.tag_id, count(DISTINCT et.entity_id) AS entities, count(DISTINCT en.entity_type) AS types FROM t LEFT JOIN et USING (tag_id) LEFT JOIN en USING (entity_id) GROUP BY 1),
  y AS (SELECT et.tag_id, count(DISTINCT l.doc_id) AS docs FROM et JOIN l USING (entity_id) GROUP BY 1)
  SELECT tag_id, entities, coalesce(docs,0) AS docs, types, round(0.3*least(1.0,entities/10.0) + 0.3*least(1.0,coalesce(docs,0)/3.0) + 0.2*least(1.0,greatest(0.0,1-(types-1)*0.5)) + CASE WHEN tag_id IN ('Tribe','City') THEN 0.3 ELSE 0 END, 6) AS trust_score FROM x LEFT JOIN y USING (tag_id)""")
def tag_trust(spark, d):
    tags, et, en = _tags(spark, d)
    return rt.tag_trust(tags, et, en, links(spark, d))


@query(f"""WITH {_TAGS}, l AS {LINKS}, x AS (SELECT t.tag_id, count(DISTINCT et.entity_id) AS entities, count(DISTINCT en.entity_type) AS types FROM t LEFT JOIN et USING (tag_id) LEFT JOIN en USING (entity_id) GROUP BY 1),
  y AS (SELECT et.tag_id, count(DISTINCT l.doc_id) AS docs FROM et JOIN l USING (entity_id) GROUP BY 1),
  g AS (SELECT tag_id FROM x LEFT JOIN y USING (tag_id) WHERE tag_id = 'City' AND 0.3*least(1.0,entities/10.0) + 0.3*least(1.0,coalesce(docs,0)/3.0) + 0.2*least(1.0,greatest(0.0,1-(types-1)*0.5)) + 0.3 >= 0.6),
  m AS (SELECT DISTINCT entity_id FROM et JOIN g USING (tag_id) ORDER BY 1 LIMIT 5), r AS (SELECT chunk_id, entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY relevance_score DESC NULLS LAST, chunk_id) AS rank FROM l JOIN m USING (entity_id)),
  u AS (SELECT 'tag_' || tag_id AS chunk_id, NULL AS entity_id, 0 AS part, 0 AS rank FROM g UNION ALL SELECT chunk_id, entity_id, 1, rank FROM r WHERE rank <= 2)
  SELECT chunk_id, entity_id, row_number() OVER (ORDER BY part, entity_id, rank) AS position FROM u""")
def tag_group(spark, d):
    tags, et, en = _tags(spark, d)
    return rt.tag_group(rt.tag_trust(tags, et, en, links(spark, d)), et, links(spark, d), "City")


@query(f"""WITH q AS (SELECT title AS mention, 0 AS ord, title AS variant, {_norm('title')} AS v FROM encyclopedia WHERE title IS NOT NULL UNION ALL SELECT title, 1, regexp_replace(title, ' .*', ''), {_norm("regexp_replace(title, ' .*', '')")} FROM encyclopedia WHERE title IS NOT NULL),
  k AS (SELECT normalized_name AS entity, count(*) AS n, {_norm('normalized_name')} AS nn FROM graph_extraction_clean WHERE normalized_name IS NOT NULL GROUP BY 1),
  al AS (SELECT DISTINCT normalized_name AS entity, {_norm('a')} AS a FROM (SELECT normalized_name, unnest(aliases) AS a FROM graph_extraction_clean WHERE normalized_name IS NOT NULL)),
  h AS (SELECT q.*, k.entity, k.n, CASE WHEN nn = v THEN 1.0 ELSE 0.8 END AS s FROM q JOIN k ON v <> '' AND nn <> '' AND (contains(nn, v) OR contains(v, nn)) UNION ALL SELECT q.*, k.entity, k.n, 0.6 FROM q JOIN al ON v <> '' AND al.a = v JOIN k USING (entity)),
  b AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY ord, s DESC, n DESC, entity DESC) AS r FROM h)
  SELECT mention, variant, entity, s::DOUBLE AS match_score FROM b WHERE r = 1""")
def query_entity_match(spark, d):
    names = T(spark, d, "encyclopedia").filter("title IS NOT NULL").select(F.col("title").alias("mention"), F.array("title", F.regexp_replace("title", " .*", "")).alias("variants"))
    rows = T(spark, d, "graph_extraction_clean").filter("normalized_name IS NOT NULL")
    known = rows.groupBy(F.col("normalized_name").alias("entity")).agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>"))))).alias("aliases"), F.count("*").alias("chunk_count"))
    return rt.resolve_mentions(names, known).drop("final_score")


@query("SELECT normalized_name AS entity, 'summary_' || normalized_name AS chunk_id, summary AS text, 0.95 AS score FROM (SELECT normalized_name, min(context_description) AS summary FROM graph_extraction_clean WHERE normalized_name IS NOT NULL GROUP BY 1) WHERE trim(summary) <> ''")
def entity_summaries(spark, d):
    rows = T(spark, d, "graph_extraction_clean").filter("normalized_name IS NOT NULL").groupBy(F.col("normalized_name").alias("entity")).agg(F.min("context_description").alias("summary"))
    return rt.entity_summaries(rows)


@query(f"WITH p AS (SELECT entity_a AS a, entity_b AS b FROM (WITH l AS {LINKS} SELECT x.entity_id AS entity_a, y.entity_id AS entity_b, count(*) AS n FROM l x JOIN l y ON x.chunk_id = y.chunk_id AND x.entity_id < y.entity_id GROUP BY 1, 2) ORDER BY n DESC, a, b LIMIT 1) SELECT chunk_id FROM {LINKS} l JOIN p ON l.entity_id IN (a, b) GROUP BY 1 HAVING count(DISTINCT entity_id) = 2")
def relationship_chunks(spark, d):
    li = links(spark, d)
    top = g.cooccurrences(li).orderBy(F.desc("co_occurrence_count"), "entity_a", "entity_b").limit(1).collect()  # the two names of a question
    return g.shared_chunks(li, top[0]["entity_a"], top[0]["entity_b"]) if top else li.limit(0).select("chunk_id")


# Store


@query("SELECT filename, doc_id, created_at FROM documents ORDER BY created_at DESC, doc_id")
def list_documents(spark, d):
    return tb.list_documents(T(spark, d, "documents"))


_UP = "SELECT filename, doc_id, status, updated_at + INTERVAL 1 DAY AS updated_at FROM documents WHERE status = 'PROCESSING' UNION ALL SELECT 'new_' || filename, doc_id, 'PENDING', updated_at FROM documents WHERE status = 'FAILED'"


@query(f"WITH n AS ({_UP}) SELECT coalesce(o.filename, n.filename) AS filename, coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.filename IS NULL THEN n.status ELSE o.status END AS status, coalesce(n.updated_at, o.updated_at) AS updated_at FROM documents o FULL JOIN n ON n.filename = o.filename")
def document_upsert(spark, d):
    old = T(spark, d, "documents").select("filename", "doc_id", "status", "updated_at")
    day = F.expr("INTERVAL 1 DAY")
    new = old.filter("status = 'PROCESSING'").withColumn("updated_at", F.col("updated_at") + day).unionByName(old.filter("status = 'FAILED'").withColumn("filename", F.concat(F.lit("new_"), "filename")).withColumn("status", F.lit("PENDING")))
    return tb.upsert_documents(old, new)


@query("SELECT slug, title, CASE WHEN review_status = 'PENDING' THEN 'new ' || slug ELSE core_summary END AS core_summary, CASE WHEN review_status = 'PENDING' THEN 'Event' ELSE category END AS category, CASE WHEN review_status = 'PENDING' THEN 'NEW' ELSE properties.phase END AS phase, properties.nasab AS nasab FROM encyclopedia")
def encyclopedia_upsert(spark, d):
    old = T(spark, d, "encyclopedia")
    new = old.filter("review_status = 'PENDING'").select("slug", F.lit("x").alias("title"), F.concat(F.lit("new "), "slug").alias("core_summary"), F.lit("Event").alias("category"), F.struct(F.lit(None).cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("nasab"), F.lit("NEW").alias("phase")).alias("properties"))
    return tb.upsert_encyclopedia(old, new).select("slug", "title", "core_summary", "category", F.col("properties.phase").alias("phase"), F.col("properties.nasab").alias("nasab"))


@query("SELECT doc_id, CASE WHEN updated_at IS NULL THEN greatest(status, 'PENDING') ELSE status END AS status, updated_at AS at FROM documents")
def document_status(spark, d):
    rows = T(spark, d, "documents")
    log = rows.select("doc_id", F.lit("PENDING").alias("status"), (F.col("updated_at") - F.expr("INTERVAL 1 DAY")).alias("at")).unionByName(rows.select("doc_id", "status", F.col("updated_at").alias("at")))
    return tb.latest_status(log)


@query(f"SELECT chunk_id, CASE WHEN len(chunk_images_urls) > 0 THEN 'enriched' ELSE chunk_text END AS chunk_text, CASE WHEN len(chunk_images_urls) > 0 THEN 'seen' END AS visual_summary FROM {_CH}")
def chunk_enrich(spark, d):
    c = chunk_rows(spark, d)
    return tb.enrich_chunks(c, c.filter("size(chunk_images_urls) > 0").select("chunk_id", F.lit("enriched").alias("chunk_text"), F.lit("seen").alias("visual_summary"))).select("chunk_id", "chunk_text", "visual_summary")


@query(f"SELECT c.chunk_id, coalesce(array_to_string(c.chunk_page_numbers, ','), '') AS pages, c.chunk_type FROM {_CH} c WHERE chunk_id IN (SELECT chunk_id FROM {_HITS})")
def chunks_by_id(spark, d):
    wanted = _hits(spark, d)
    return chunk_rows(spark, d).join(wanted, "chunk_id", "left_semi").select("chunk_id", F.array_join(F.transform(F.coalesce("chunk_page_numbers", F.array().cast("array<int>")), lambda p: p.cast("string")), ",").alias("pages"), "chunk_type")


@query(f"SELECT chunk_id, doc_id, 1.0 AS vector_score FROM {_CH} WHERE chunk_type = 'IDENTITY' AND doc_id IN (SELECT doc_id FROM documents WHERE source = 'notices')")
def identities(spark, d):
    docs = T(spark, d, "documents").filter("source = 'notices'").select("doc_id")
    return tb.identity_chunks(chunk_rows(spark, d), docs)


@query("SELECT model, sum(prompt_tokens) AS prompt_tokens, sum(completion_tokens) AS completion_tokens, round((sum(prompt_tokens)*any_value(CASE WHEN model='large' THEN 5.0 ELSE 0.15 END) + sum(completion_tokens)*any_value(CASE WHEN model='large' THEN 15.0 ELSE 0.6 END))/1e6, 6) AS cost FROM (SELECT CASE event_type WHEN 'click' THEN 'mini' WHEN 'view' THEN 'large' ELSE event_type END AS model, event_id AS prompt_tokens, user_id AS completion_tokens FROM events) GROUP BY 1")
def usage_cost(spark, d):
    kind = F.when(F.col("event_type") == "click", "mini").when(F.col("event_type") == "view", "large").otherwise(F.col("event_type"))
    log = T(spark, d, "events").select(kind.alias("model"), F.col("event_id").alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"))
    return pv.usage(log, spark.createDataFrame(PRICES, "model string, prompt_price double, completion_price double"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 10")
def history_last(spark, d):
    return tb.last_rows(T(spark, d, "events"), "user_id", ["ts", "event_id"], 10).select("user_id", "event_id")


@query("SELECT slug, ((row_number() OVER (PARTITION BY category ORDER BY slug) - 1) // 22)::INT AS batch FROM encyclopedia")
def batches(spark, d):
    return un.batches(T(spark, d, "encyclopedia"), "slug", 22, "category").select("slug", "batch")


@query(f"SELECT type, count(*) AS records, count(DISTINCT name) AS names FROM {RAW} GROUP BY 1")
def type_distribution(spark, d):
    return records(spark, d).groupBy("type").agg(F.count("*").alias("records"), F.count_distinct("name").alias("names"))


@query(f"SELECT lower(name) AS name, count(*) AS records FROM {RAW} WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 5")
def duplicate_names(spark, d):
    return records(spark, d).filter("name IS NOT NULL").groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("records")).filter("records > 1").orderBy(F.desc("records"), "name").limit(5)


# Model-backed operators, with a deterministic provider in the place of a model


def _echo(prompts: list[str]) -> list[str]:
    """A rule in place of a model: the words of a prompt that begin with a capital, as entity records."""
    import re

    return ["##".join(f'("entity"<|>{w}<|>Person<|>named)' for w in dict.fromkeys(re.findall(r"(?a)\b[A-Z][a-z]{4,}\b", p))) for p in prompts]


@query(f"SELECT title, count(DISTINCT chunk_id) AS units FROM (SELECT chunk_id, unnest(regexp_extract_all(chunk_text, '\\b[A-Z][a-z]{{4,}}\\b')) AS title FROM {_CH} WHERE chunk_text IS NOT NULL) GROUP BY 1")
def graph_extraction(spark, d):
    units = chunk_rows(spark, d).filter("chunk_text IS NOT NULL").select(F.col("chunk_id").alias("unit_id"), F.col("chunk_text").alias("text"))
    return pv.answers_to_graph(pv.extract_graph(units, _echo))[0].groupBy("title").agg(F.countDistinct("unit_id").alias("units"))  # a gleaning may name it again


@query("SELECT normalized_name AS key, CASE WHEN len(f) <= 1 THEN coalesce(f[1],'') ELSE f[1] || ' ' || f[2] END AS description FROM (SELECT normalized_name, list_sort(list_distinct(list_filter(list(nullif(context_description,'')), lambda x: x IS NOT NULL))) AS f FROM graph_extraction_clean WHERE normalized_name IS NOT NULL GROUP BY 1)")
def description_synthesis(spark, d):
    rows = T(spark, d, "graph_extraction_clean").filter("normalized_name IS NOT NULL").groupBy(F.col("normalized_name").alias("key")).agg(F.collect_set("context_description").alias("fragments"))
    return pv.merge_descriptions(rows).select("key", "description")


# Identity cards and answers


@query("SELECT doc_id, CASE WHEN length(text) <= 1500 THEN text ELSE substr(concat_ws(chr(10)||chr(10)||'[...]'||chr(10)||chr(10), array_to_string(list_slice(p,1,2),chr(10)), array_to_string(list_slice(p, greatest(1, len(p)//2), greatest(1, len(p)//2)+1), chr(10)), array_to_string(list_slice(p, greatest(1, len(p)-1), len(p)), chr(10))), 1, 1500) END AS sample FROM (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents)")
def document_sample(spark, d):
    return T(spark, d, "documents").select("doc_id", idn.sample_paragraphs(F.col("text"), 1500, 2, "\n").alias("sample"))


_WORDS = "|".join(idn.OUTLINE_WORDS)


def _behind(lines: str) -> str:
    entries = f"list_transform(list_filter({lines}[i+1:i+59], lambda x: {_strip('x')} <> '' AND length(x) > 3), lambda x: {_strip('x')})"
    head = f"length({_strip(f'{lines}[i]')}) < 50 AND regexp_matches(lower({lines}[i]), '{_WORDS}')"
    return f"list_filter([{entries} for i in range(1, len({lines}) + 1) if {head}], lambda b: len(b) > 3)[1]"


@query(f"""WITH c AS (SELECT chunk_id, string_split(coalesce(chunk_text,''), chr(10)) AS l, list_filter([{_strip('x')} for x in coalesce(chunk_headings, [])], lambda h: h <> '' AND length(h) < 150)[1:40] AS short FROM {_CH}),
  f AS (SELECT chunk_id, short, coalesce({_behind('l[1:200]')}, CASE WHEN len(l) > 200 THEN {_behind('l[-200:]')} END) AS found FROM c)
  SELECT chunk_id, CASE WHEN found IS NOT NULL THEN 'OFFICIEL' WHEN len(short) > 0 THEN 'ESTIMÉ' ELSE 'ABSENT' END AS type, coalesce(array_to_string(coalesce(found, ['- ' || h for h in short]), chr(10)), '') AS content FROM f""")
def outlines(spark, d):
    return chunk_rows(spark, d).select("chunk_id", idn.outline(F.col("chunk_text"), F.col("chunk_headings")).alias("o")).select("chunk_id", "o.type", "o.content")


@query("SELECT doc_id, 'TITRE: ' || coalesce(nullif(trim(filename),''),'Titre non détecté') || chr(10) || 'STRUCTURE:' || chr(10) || '- ' || replace(coalesce(text,''), '. ', '.' || chr(10) || '- ') AS card FROM documents")
def fallback_cards(spark, d):
    return T(spark, d, "documents").select("doc_id", idn.fallback_card(F.col("filename"), F.col("text")).alias("card"))


@query(f"""WITH h AS (SELECT doc_id, string_agg(heading, chr(10) ORDER BY first, heading) AS outline FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first, heading) AS k FROM (SELECT doc_id, chunk_headings[-1] AS heading, min(struct_pack(i := chunk_index, c := chunk_id)) AS first FROM {_CH} WHERE len(chunk_headings) > 0 AND chunk_headings[-1] IS NOT NULL GROUP BY 1, 2)) WHERE k <= 20 GROUP BY 1),
  t AS (SELECT doc_id, string_agg(coalesce(chunk_text,''), chr(10)||chr(10) ORDER BY chunk_index, chunk_id) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, chunk_id) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM {_CH}) WHERE k < 2 OR k BETWEEN n // 2 AND n // 2 + 1 OR k >= n - 2 GROUP BY 1)
  SELECT doc_id, concat_ws(chr(10)||chr(10), outline, sample) AS context FROM t LEFT JOIN h USING (doc_id)""")
def card_contexts(spark, d):
    rows = chunk_rows(spark, d).withColumn("o", F.struct("chunk_index", "chunk_id"))
    return idn.card_context(rows.withColumn("chunk_text", F.col("chunk_text")), "doc_id", "o", "chunk_text", "chunk_headings")


@query("SELECT item_id, trim(question) AS v1, '' AS v2, text AS v3, lang AS keywords FROM eval_items")
def query_rewrites(spark, d):
    answer = F.concat(F.lit("V1: "), "question", F.lit("\nV3:"), "text", F.lit("\nKEYWORDS: "), "lang")
    return T(spark, d, "eval_items").select("item_id", idn.rewritten(answer).alias("r")).select("item_id", "r.*")


@query(f"""WITH b AS (SELECT * FROM {_HITS} ORDER BY score DESC, chunk_id LIMIT 20), r AS (SELECT c.*, row_number() OVER (ORDER BY score DESC, c.chunk_id) AS n FROM b JOIN {_CH} c USING (chunk_id)),
  l AS (SELECT n, coalesce(chunk_images_urls, []) AS images, concat_ws(chr(10), '[SOURCE ' || n || '] ' || coalesce(chunk_heading_full,'') || ' (p. ' || coalesce(array_to_string(chunk_page_numbers, ', '),'') || ')', chunk_text, nullif(array_to_string(['[TABLE]' || chr(10) || x for x in coalesce(chunk_tables, [])], chr(10)), '')) AS line FROM r)
  SELECT string_agg(line, chr(10)||chr(10) ORDER BY n) AS context, array_to_string(list_sort(list_distinct(flatten(list(images)))), ' ') AS images FROM l""")
def answer_sources(spark, d):
    best = _hits(spark, d).orderBy(F.desc("score"), "chunk_id").limit(20)  # the sources of one answer
    rows = chunk_rows(spark, d).join(F.broadcast(best), "chunk_id").withColumn("o", F.struct(-F.col("score"), F.col("chunk_id")))
    return idn.answer_context(rows, "o").withColumn("images", F.array_join(F.array_sort("images"), " "))


@query()
def community_contexts(spark, d):
    members = g.communities(T(spark, d, "legacy_relations"), "source", "target", levels=1, rounds=4)
    told = T(spark, d, "graph_extraction_clean").filter("normalized_name IS NOT NULL").groupBy(F.col("normalized_name").alias("node")).agg(F.max("context_description").alias("description"))
    return idn.community_context(members, told, T(spark, d, "legacy_relations").select("source", "target", F.col("evidence").alias("description")))


from . import catalog_resolution  # noqa: E402, F401 - registers its queries
