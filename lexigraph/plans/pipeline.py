"""The two entry points: from documents to a graph, and from a question to its context."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_id, slugify, type_category
from ..operators import arbitration as ar
from ..operators import graph as g
from ..operators import identity as idn
from ..operators import resolve as rs
from ..operators import retrieval as rt
from ..operators import units as un
from . import providers as pv


@dataclass
class Analysis:
    """What a question asks: the texts to search with, and the names in it with their spellings, the primary first."""

    vector_query: str
    keyword_query: str = ""
    query_type: str = "general"
    confidence: float = 0.12345
    entities: list[list[str]] = field(default_factory=list)


def check_question(question: str, limit: int = 15) -> tuple[str, int]:
    """The trimmed question of 3 to 500 characters and a limit of 1 to 50, or ValueError."""
    text = (question or "").strip()
    if not 3 <= len(text) <= 500:
        raise ValueError("a question has 3 to 500 characters")
    if not isinstance(limit, int) or not 1 <= limit <= 50:
        raise ValueError("limit is 1 to 50")
    return text, limit


def analyse(question: str, provider: pv.Provider | None = None) -> Analysis:
    """By the provider's JSON {vector_query, keyword_query, query_type, confidence, entities_mentioned}; the question itself where it fails."""
    import json

    try:
        got = json.loads(provider([question])[0]) if provider else {}
        names = [[e["primary"], *e.get("variants", [])] for e in got.get("entities_mentioned", [])]
        return Analysis(got.get("vector_query") or question, got.get("keyword_query") or question, got.get("query_type") or "general", float(got.get("confidence", 0.12345)), names)
    except (ValueError, KeyError, TypeError):
        return Analysis(question, question)


def build_graph(units: DataFrame, provider: pv.Provider, encyclopedia: DataFrame, arbitrate: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of units (unit_id, text): extracted, greedily merged, anchored, redirected, consolidated, re-keyed.

    With ``arbitrate`` the provider also chooses among several entries an entity may mean, and merges the likely duplicates
    among those that none anchors (see ``arbitration.resolve_by_model``); encyclopedia then has the column id.

    The stages are lazy up to the redirects, which are written round by round. Entities without a title are left out.
    """
    answers = pv.extract_graph(units, provider, **options)
    raw, relations = pv.answers_to_graph(answers)
    named = raw.filter("title <> ''").select(
        entity_id(F.col("title"), F.col("type")).alias("id"), "title", "type", slugify(F.col("title")).alias("slug"), type_category(F.col("type")).alias("category"), "description",
        F.lit(1).alias("frequency"), F.lit(1).alias("rank"), F.array("unit_id").alias("source_ids"), F.xxhash64("unit_id", "pos").alias("pos"),
    )
    pivots = rs.greedy_pivots(named.select("id", "title", "category", "frequency", "pos"))
    anchored = rs.anchor(named.select("id", "title", "category"), encyclopedia).filter("canonical_id IS NOT NULL")
    steps = pivots.select(F.col("id").alias("source"), F.col("pivot").alias("target"), F.lit(1).alias("stage")).unionByName(anchored.select(F.col("id").alias("source"), F.col("canonical_id").alias("target"), F.lit(2).alias("stage")))
    if arbitrate:
        told = lambda prompts: pv.ask(prompts, provider, **options)
        steps = steps.unionByName(_arbitrated(named, rs.anchor(named.select("id", "title", "category"), encyclopedia), encyclopedia, told))
    resolved = rs.resolve_redirects(rs.valid_redirects(steps))
    entities = rs.consolidate(rs.apply_redirects(named, resolved, "id"))
    slugs = rs.apply_redirects(named.select("id", "slug", "pos"), resolved, "id")
    edges = relations.select(slugify(F.col("source")).alias("source_slug"), slugify(F.col("target")).alias("target_slug"), "description", "weight", F.array("unit_id").alias("source_ids"), F.lit(1).alias("rank"))
    return entities, g.consolidate_relationships(g.remap_relationships(edges, slugs))


def _arbitrated(named: DataFrame, anchored: DataFrame, encyclopedia: DataFrame, told) -> DataFrame:
    """(source, target, stage) of what the model decides: an entry for entities with several, merges of those without one."""
    once = named.groupBy("id").agg(*[F.min_by(c, "pos").alias(c) for c in ("title", "type", "slug", "category", "description")])
    several = anchored.filter("size(candidates) > 1").join(once, "id")
    listed = several.select("id", "title", "description", F.explode("candidates").alias("slug")).join(encyclopedia.select("slug", F.col("title").alias("entry")), "slug")
    listed = listed.groupBy("id", "title", "description").agg(F.array_sort(F.collect_list(F.struct("slug", F.col("slug").alias("id"), "entry"))).alias("candidates"))  # entries of one key
    lines = F.array_join(F.transform("candidates", lambda c: F.concat(F.lit("SLUG: "), c["slug"], F.lit(" | Name: "), F.coalesce(c["entry"], F.lit("")))), "\n")
    prompts = listed.select(F.col("id").alias("key"), F.concat_ws("\n", F.lit("ANCHOR"), "title", F.substring("description", 1, 250), lines).alias("prompt"))
    chosen = ar.choose_anchor(listed.select("id", "candidates"), told(prompts).select(F.col("key").alias("id"), "answer")).filter("canonical_id IS NOT NULL")
    free = once.join(anchored.filter("canonical_id IS NOT NULL").select("id"), "id", "left_anti").join(chosen.select("id"), "id", "left_anti").withColumn("canonical_id", F.lit(None).cast("string"))
    merged = ar.resolve_by_model(free, told)
    return chosen.select(F.col("id").alias("source"), F.col("canonical_id").alias("target"), F.lit(3).alias("stage")).unionByName(merged.select("source", "target", F.lit(4).alias("stage")))


def ingest(documents: DataFrame, provider: pv.Provider, encyclopedia: DataFrame, max_tokens: int = 800, overlap: int = 120) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, entities, relationships) of documents (doc_id, text)."""
    whole = documents.select(F.col("doc_id").cast("string").alias("unit_id"), "text", F.lit(None).cast("string").alias("heading"))
    units = un.recursive_split(whole, max_tokens=max_tokens, overlap=overlap)
    return units, *build_graph(units.select("unit_id", "text"), provider, encyclopedia)


def resolve_names(analysis: Analysis, entities: DataFrame, tags: DataFrame | None = None) -> list[dict]:
    """What the names of a question are, in their order: {kind: entity, entity} or {kind: tag, tag_id}; a tag only where no entity matches any
    spelling; the same one once. They are the few names of one question."""
    spark = entities.sparkSession
    asked = [names for names in analysis.entities if names]
    if not asked:
        return []
    rows = spark.createDataFrame([(str(n), names) for n, names in enumerate(asked)], "mention string, variants array<string>")
    found = {r["mention"]: r for r in rt.resolve_mentions(rows, entities).collect()}
    out: list[dict] = []
    for n, names in enumerate(asked):
        if (r := found.get(str(n))) is not None:
            match = {"kind": "entity", "entity": r["entity"]}
        elif tags is not None and (t := rt.tag_search(tags, names[0]).first()) is not None:
            match = {"kind": "tag", "tag_id": t["tag_id"]}
        else:
            continue
        if match not in out:
            out.append(match)
    return out


def retrieve(
    analysis: Analysis, vectors: DataFrame, probe: list[float], chunks: DataFrame, links: DataFrame, entities: DataFrame, top: int = 15, tags: DataFrame | None = None,
    entity_tags: DataFrame | None = None, trust: DataFrame | None = None, reranker=None, candidates: int = 50,
) -> DataFrame:
    """(chunk_id, score, part, position): the strategy's chunks, topped up by the vector search.

    vectors: chunk_id, embedding; chunks: chunk_id, chunk_text; links: entity_id, chunk_id, relevance_score; entities: entity,
    aliases, chunk_count, summary; tags: tag_id, label, aliases, with entity_tags and trust (see ``retrieval.tag_group``). The names of
    the question are resolved first; what they are picks the strategy. A chunk that several of its entities name comes once for
    each. With a reranker the fused candidates are scored by it, those below 0 go, and ``top`` stay.
    """
    spark = chunks.sparkSession
    near = rt.vector_topk(vectors, probe, candidates, key="chunk_id").select(F.lit("vector").alias("ranking"), "chunk_id", "score")
    asked = spark.createDataFrame([(0, analysis.keyword_query or analysis.vector_query)], "q int, text string")
    words = rt.bm25_topk(chunks.select("chunk_id", "chunk_text"), asked, "chunk_id", "chunk_text", "q", "text", candidates).select(F.lit("words").alias("ranking"), "chunk_id", "score")
    fused = rt.rank_fusion(near.unionByName(words), "chunk_id", 60, candidates if reranker else top)
    if reranker:
        texts = fused.join(chunks.select("chunk_id", "chunk_text"), "chunk_id").withColumn("question", F.lit(analysis.vector_query))
        texts = pv.score_pairs(texts, reranker, text="chunk_text").withColumn("_order", -F.col("score"))
        fused = rt.rerank(texts, "rerank_score", top, 0.0, "_order").select("chunk_id", F.coalesce("rerank_score", "score").alias("score"))
    matches = resolve_names(analysis, entities, tags)
    strategy = rt.choose_strategy(matches, analysis.query_type)
    names = [m["entity"] for m in matches if m["kind"] == "entity"]
    if strategy == "vector":
        first = fused.limit(0)
    elif strategy == "tag":
        first = rt.tag_group(trust, entity_tags, links, matches[0]["tag_id"]).select("chunk_id", (1.0 / F.col("position")).alias("score"))
    elif strategy == "summary":
        first = rt.entity_summary(entities, names[0]).select("chunk_id", "score")
    elif strategy == "relationship":
        first = g.shared_chunks(links, names[0], names[1]).withColumn("score", F.lit(1.0))
    else:
        first = rt.top_per_entity(links.filter(F.col("entity_id").isin(names)), 20).select("chunk_id", F.col("relevance_score").alias("score"))
    return rt.fill(first, fused, top)


def answer(question: str, found: DataFrame, chunks: DataFrame, provider: pv.Provider, history: DataFrame | None = None, **options) -> DataFrame:
    """(question_id, answer, images): the provider's answer from the retrieved chunks in their order, with the images of its sources once each.

    found: chunk_id, position; chunks: chunk_id, chunk_text, chunk_heading_full, chunk_page_numbers, chunk_tables, chunk_images_urls; history:
    question_id (0), turn, role, content.
    """
    rows = found.groupBy("chunk_id").agg(F.min("position").alias("position")).join(chunks, "chunk_id")
    context = idn.answer_context(rows, "position").withColumns({"question_id": F.lit(0), "question": F.lit(question)})
    told = pv.ask(pv.answer_prompts(context, history), provider, **options).select(F.col("key").alias("question_id"), "answer")
    return context.join(told, "question_id").select("question_id", "answer", "images")
