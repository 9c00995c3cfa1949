"""From a question to its context: text units, sparse and dense search, rank fusion, grouping by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id, strip
from ..operators import retrieval as rt
from ..scratch import Scratch
from ..sources.tables import read_table


def question_context(spark: SparkSession, sf_dir: str, top: int = 15) -> DataFrame:
    """(item_id, chunk_id, doc_id, chunk_index, score, position): the lines of documents that answer each held-out question best.

    Lines are the units, known by document and place; they are written once, and only those that are returned get their
    hash. Two rankings a question, BM25 over the lines and the cosine of documents' vectors (a question and a document take
    the vector of their number), are fused by reciprocal ranks and put in the order of their documents. Ties go to the
    smaller document, then the earlier line.
    """
    texts = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text")).filter(strip(F.col("text")) != "")
    lines = Scratch(spark, "context").keep(texts.select(F.struct("doc_id", "chunk_index").alias("line"), "text"), "lines")
    asked = read_table(spark, sf_dir, "eval_items").select("item_id", "question")
    sparse = rt.bm25_topk(lines, asked, "line", "text", "item_id", "question", 50).select("item_id", F.lit("sparse").alias("ranking"), "line", "score")
    vectors = read_table(spark, sf_dir, "embeddings")
    probes = asked.join(vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("q")), "item_id")
    near = rt.vector_topk_each(vectors, probes, 50, by="item_id").select("item_id", F.struct(F.col("vec_id").cast(lines.schema["line"].dataType["doc_id"].dataType).alias("doc_id"), F.lit(0).alias("chunk_index")).alias("line"), "score")
    dense = near.join(lines.select("line"), "line", "left_semi").select("item_id", F.lit("dense").alias("ranking"), "line", "score")
    fused = rt.rank_fusion(sparse.unionByName(dense), "line", 60, top, ["item_id"])
    hits = fused.join(lines, "line").select("item_id", "line", "text", "score")
    hits = hits.select("item_id", content_id(F.concat_ws("|", F.col("line.doc_id").cast("string"), F.col("line.chunk_index").cast("string"), "text")).alias("chunk_id"), "line.*", "score")
    return rt.ordered_by_document(hits, ["item_id"]).select("item_id", "chunk_id", "doc_id", "chunk_index", "score", "position")


_TERMS = "list_filter(regexp_split_to_array(lower(coalesce({x},'')), '[^\\pL\\pN]+'), lambda w: w <> '')"
_S = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_COS = "list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q::DOUBLE[], q::DOUBLE[]))"
QUESTION_CONTEXT_SQL = f"""WITH l AS (SELECT doc_id, i, text FROM (SELECT doc_id, unnest(range(len(l)))::INT AS i, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_replace(text, '^[{_S}]+|[{_S}]+$', '', 'g') <> ''),
  w AS (SELECT doc_id, i, {_TERMS.format(x='text')} AS w FROM l), s AS (SELECT count(*) AS n, avg(len(w)) AS m FROM w),
  q AS (SELECT DISTINCT item_id, unnest({_TERMS.format(x='question')}) AS t FROM eval_items),
  h AS (SELECT doc_id, i, len, t, count(*) AS tf FROM (SELECT doc_id, i, len(w) AS len, unnest(w) AS t FROM w) WHERE t IN (SELECT t FROM q) GROUP BY ALL), f AS (SELECT t, count(*) AS df FROM h GROUP BY 1),
  b AS (SELECT item_id, doc_id, i, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / m))), 6) AS score FROM h JOIN f USING (t) JOIN q USING (t), s GROUP BY ALL),
  sparse AS (SELECT item_id, doc_id, i, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, i) AS rank FROM b QUALIFY rank <= 50),
  c AS (SELECT item_id, vec_id, round({_COS}, 9) AS score FROM embeddings, (SELECT item_id, embedding AS q FROM eval_items JOIN embeddings ON vec_id = item_id)),
  near AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vec_id) AS k FROM c WHERE score >= 0.05 QUALIFY k <= 50),
  dense AS (SELECT item_id, l.doc_id, l.i, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, l.doc_id) AS rank FROM near JOIN l ON l.doc_id = vec_id AND l.i = 0),
  r AS (SELECT item_id, doc_id, i, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM sparse UNION ALL SELECT * FROM dense) GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, i) AS k FROM r QUALIFY k <= 15),
  o AS (SELECT *, max(score) OVER (PARTITION BY item_id, doc_id) AS best FROM k JOIN l USING (doc_id, i))
  SELECT item_id, substr(sha256(doc_id || '|' || i || '|' || text), 1, 16) AS chunk_id, doc_id, i AS chunk_index, score, row_number() OVER (PARTITION BY item_id ORDER BY best DESC, doc_id, i) AS position FROM o"""
