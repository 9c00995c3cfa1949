"""Sources, sinks and upserts of the store's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import ENCYCLOPEDIA


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files as they are: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").load(path)


def read_texts(spark: SparkSession, path: str, kind: str = "text", **options: str) -> DataFrame:
    """Input texts from text, csv, json (lines) or parquet files."""
    if kind not in ("text", "csv", "json", "jsonl", "parquet"):
        raise ValueError(f"unknown kind of input: {kind}")
    if kind == "text":
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return spark.read.format("json" if kind == "jsonl" else kind).options(**({"header": "true"} if kind == "csv" else {}) | options).load(path)


def read_encyclopedia_seed(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of entries with ID, CANONICAL_NAME, TYPE, CORE_SUMMARY, PROPERTIES {ALIASES, NASAB, PHASE}."""
    raw = spark.read.schema("ID string, CANONICAL_NAME string, TYPE string, CATEGORY string, CORE_SUMMARY string, PROPERTIES struct<ALIASES: array<string>, NASAB: string, PHASE: string>").json(path, multiLine=True)
    return raw.select(
        F.sha2("ID", 256).alias("id"), F.col("ID").alias("slug"), F.col("CANONICAL_NAME").alias("title"), F.col("TYPE").alias("type"), F.col("CATEGORY").alias("category"),
        F.col("CORE_SUMMARY").alias("core_summary"), F.struct(F.col("PROPERTIES.ALIASES").alias("aliases"), F.col("PROPERTIES.NASAB").alias("nasab"), F.col("PROPERTIES.PHASE").alias("phase")).alias("properties"),
        F.lit("OFFICIAL").alias("review_status"), F.lit(True).alias("is_verified"),
    )


def seed_if_empty(spark: SparkSession, table: DataFrame, seed: DataFrame) -> DataFrame:
    """The table, or the seed where the table has no row."""
    return seed if table.isEmpty() else table


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of files {entities: [...], relations: [...]}; both empty for an empty list."""
    kind = (
        "entities array<struct<name: string, normalized_name: string, type: string, aliases: array<string>, context_description: string, confidence: double>>, "
        "relations array<struct<source: string, target: string, type: string, evidence: string, properties: map<string,string>, confidence: double>>"
    )
    raw = spark.read.schema(kind).json(path, multiLine=True)
    return raw.select(F.explode("entities").alias("e")).select("e.*"), raw.select(F.explode("relations").alias("r")).select("r.*")


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Chunks with their position; nested columns as JSON text, cut by a hash of the document so that no document's folder grows small files."""
    nested = [c for c, t in chunks.dtypes if t.startswith(("array", "map", "struct")) and c not in ("chunk_page_numbers", "chunk_images_urls")]
    out = chunks.withColumns({c: F.to_json(c) for c in nested}).withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int"))
    out.repartition("doc_bucket").write.mode(mode).partitionBy("doc_bucket").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def create_tables(spark: SparkSession, database: str) -> None:
    """The store's tables, where they are not yet there."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.encyclopedia ({ENCYCLOPEDIA.replace('struct<aliases: ', 'struct<aliases:')}) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.documents (doc_id string, filename string, metadata string, status string, created_at timestamp_ntz, updated_at timestamp_ntz) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.chunks (chunk_id string, doc_id string, chunk_index int, chunk_type string, chunk_text string, chunk_headings array<string>, chunk_heading_full string, chunk_page_numbers array<int>, chunk_tables array<string>, chunk_images_urls array<string>, chunk_metadata string, created_at timestamp_ntz) USING parquet")


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once: empty where the key is unique."""
    return rows.groupBy(*key).count().filter("count > 1")


def upsert(old: DataFrame, new: DataFrame, key: str, **merged: Column) -> DataFrame:
    """One row a key: those of either table; a column of both is old's unless ``merged`` names an expression on o and n.

    The new table may repeat a key: any one of its equal rows counts, so give the rows one order before if they differ.
    """
    o, n = old.alias("o"), new.dropDuplicates([key]).alias("n")
    joined = o.join(n, F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full_outer")
    out = []
    for c in old.columns:
        given = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        there = F.col(f"o.{key}").isNotNull()
        fallback = F.when(there, F.col(f"o.{c}")).otherwise(given)
        out.append((F.when(there & F.col(f"n.{key}").isNotNull(), merged[c]).otherwise(fallback) if c in merged else fallback).alias(c))
    return joined.select(*out)


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents by filename: a known one gets the new updated_at and keeps the rest."""
    return upsert(old, new, "filename", updated_at=F.col("n.updated_at"))


def upsert_encyclopedia(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries by slug: summary and category are the new ones, properties the old with the new ones over them."""
    p = "properties"
    over = F.struct(*[F.coalesce(F.col(f"n.{p}.{f}"), F.col(f"o.{p}.{f}")).alias(f) for f in ("aliases", "nasab", "phase")])
    return upsert(old, new, "slug", core_summary=F.col("n.core_summary"), category=F.col("n.category"), properties=over)


def get_by(rows: DataFrame, column: str, value: object) -> DataFrame:
    """The rows with the value: none, or the one of a key; the filter reaches the scan."""
    return rows.filter(F.col(column) == F.lit(value))


def list_documents(documents: DataFrame) -> DataFrame:
    """(filename, doc_id, created_at), the newest first."""
    return documents.select("filename", "doc_id", "created_at").orderBy(F.desc("created_at"), "doc_id")


def identity_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, vector_score): the identity chunks of the documents (doc_id), each of score 1."""
    return chunks.filter("chunk_type = 'IDENTITY'").join(documents.select("doc_id"), "doc_id", "left_semi").select("chunk_id", "doc_id", F.lit(1.0).alias("vector_score"))


def last_rows(rows: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """The ``most`` last rows of each value by the order; Spark cuts each partition to so many before the shuffle."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k")


def merge_by_key(old: DataFrame | None, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """A vertices or edges table after a batch: one row a key, the last by ``order`` of the batch, else the old one."""
    last = new.groupBy(*key).agg(F.max_by(F.struct(*[c for c in new.columns if c not in key and c != order]), order).alias("_r")).select(*key, "_r.*")
    return last if old is None else old.join(last.select(*key), key, "left_anti").select(*last.columns).unionByName(last)


def import_graph(spark: SparkSession, entities: str, relationships: str, path: str) -> None:
    """Replaces the graph tables under ``path`` by those of Parquet files: entities by title, relationships with both ends known."""
    nodes = spark.read.parquet(entities).filter("title IS NOT NULL").dropDuplicates(["title"])
    edges = spark.read.parquet(relationships)
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("title").alias(end)), end, "left_semi")
    nodes.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def separate_content(items: DataFrame) -> DataFrame:
    """(chunk_id, text, headings, pages, tables, images): parts of a chunk (chunk_id, pos, kind, value, page) by what they are, in their order; different
    pages and tables once."""
    of = lambda kind: F.transform(F.filter(F.col("_p"), lambda p: p["kind"] == kind), lambda p: p["value"])
    rows = items.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "value", "page"))).alias("_p"))  # a chunk is bounded
    pages = F.array_sort(F.array_distinct(F.filter(F.transform("_p", lambda p: p["page"]), lambda p: p.isNotNull())))
    return rows.select("chunk_id", F.array_join(of("text"), "\n").alias("text"), of("heading").alias("headings"), pages.alias("pages"), F.array_distinct(of("table")).alias("tables"), of("image").alias("images"))


def pass_statistics(passes: DataFrame, by: str = "pass") -> DataFrame:
    """(pass, units, entities, relations, failed): the counters of the units of each pass, summed."""
    return passes.groupBy(by).agg(F.count("*").alias("units"), *[F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(c) for c in ("entities", "relations", "failed")])


def latest_status(log: DataFrame) -> DataFrame:
    """(doc_id, status, at): the last of each document's status rows."""
    return log.groupBy("doc_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.max("at").alias("at"))


def enrich_chunks(chunks: DataFrame, update: DataFrame) -> DataFrame:
    """chunk_text and visual_summary replaced where the update (chunk_id, chunk_text, visual_summary) has a value."""
    new = update.select("chunk_id", F.col("chunk_text").alias("_t"), F.col("visual_summary").alias("_v"))
    had = F.col("visual_summary") if "visual_summary" in chunks.columns else F.lit(None).cast("string")
    return chunks.join(new, "chunk_id", "left").withColumn("chunk_text", F.coalesce("_t", "chunk_text")).withColumn("visual_summary", F.coalesce(F.col("_v"), had)).drop("_t", "_v")


def image_assets(images: DataFrame, least: int = 150) -> DataFrame:
    """(unit_id, image_urls): images at least so wide or high, each content once."""
    big = images.filter((F.col("width") >= least) | (F.col("height") >= least)).dropDuplicates(["unit_id", "url"])
    return big.groupBy("unit_id").agg(F.array_sort(F.collect_list("url")).alias("image_urls"))


def identity_pages(pages: Column) -> Column:
    """Those page numbers that are whole numbers; [1000] if none is."""
    cast = F.filter(F.transform(pages, lambda p: p.try_cast("int")), lambda p: p.isNotNull())
    return F.when(F.size(cast) > 0, cast).otherwise(F.array(F.lit(1000)))
