"""Ranking and retrieval: vectors, postings, fusion, entity lookup, strategies, context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import cosine, gestalt_column
from ..functions.text import SPACE, normalize_name
from ..joins import maybe_broadcast, ranked
from ..scratch import Scratch
from .cells import Forest, in_cells, products, sparse

# Words without meaning for a search, in the languages of the corpus; a parameter of the functions below.
STOP_WORDS = ("the of and to in a an is was were for on at by with as de la le les des du un une et en à au aux dans sur par pour que qui ce se sa son ses").split()


def vector_topk(vectors: DataFrame, query: list[float] | Column, k: int = 12, least: float = 0.05, key: str = "vec_id", vector: str = "embedding", keep: Column | None = None) -> DataFrame:
    """(key, score): the k nearest by cosine with at least the score, ties to the smaller key; ``keep`` filters first."""
    rows = vectors if keep is None else vectors.filter(keep)
    probe = F.array(*[F.lit(float(x)) for x in query]) if isinstance(query, list) else query
    scored = rows.select(key, F.round(cosine(F.col(vector), probe), 9).alias("score")).filter(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), key).limit(k)


#: Numbers in a block of queries (64 MB); more queries are searched block by block.
QUERY_BLOCK = 8 << 20


def vector_topk_each(vectors: DataFrame, queries: DataFrame, k: int = 12, least: float = 0.05, key: str = "vec_id", vector: str = "embedding", by: str = "query_id", block: int = QUERY_BLOCK) -> DataFrame:
    """(by, key, score, rank): the k nearest of each query (by, q: array) with at least the score, ties to the smaller key.

    A stated set of queries against all rows: blocks of queries of bounded size are broadcast, one product of matrices scores
    an Arrow batch against a block, and each batch keeps k rows a query. Null, empty and all-zero vectors, and those of another
    length than the query, are near to nothing.
    """
    spark = vectors.sparkSession
    asked = queries.select(by, "q").filter("q IS NOT NULL AND size(q) > 0")
    total = asked.agg(F.sum(F.size("q"))).first()[0] or 0
    blocks = max(1, -(-total // block))
    kinds = {c: t for c, t in [*vectors.dtypes, *queries.dtypes]}
    schema = f"{by} {kinds[by]}, {key} {kinds[key]}, score double"
    out = None
    for n in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64(by), F.lit(blocks)) == n)
        rows = part.collect()  # a block of bounded size
        sizes: dict[int, tuple[list, np.ndarray]] = {}
        for size in {len(r["q"]) for r in rows}:
            same = [r for r in rows if len(r["q"]) == size]
            matrix = np.array([r["q"] for r in same], dtype="float64")
            norm = np.linalg.norm(matrix, axis=1)
            sizes[size] = ([r[by] for r, x in zip(same, norm) if x > 0], matrix[norm > 0] / norm[norm > 0, None])
        found = vectors.select(key, vector).filter(F.col(vector).isNotNull()).mapInPandas(_nearest(spark.sparkContext.broadcast(sizes), k, least, key, vector, by), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key))).filter(F.col("rank") <= k)


def _nearest(shared, k: int, least: float, key: str, vector: str, by: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch[vector].map(len)
            for size, (names, matrix) in shared.value.items():
                own = batch[lengths == size]
                if not len(own) or not names:
                    continue
                rows = np.array(own[vector].tolist(), dtype="float64")
                norm = np.linalg.norm(rows, axis=1)
                keys = own[key].to_numpy()[norm > 0]
                order = np.argsort(keys, kind="stable")  # equal scores: the smaller key first
                keys, rows = keys[order], (rows[norm > 0] / norm[norm > 0, None])[order]
                scores = np.round(rows @ matrix.T, 9)
                best = np.argsort(-scores, axis=0, kind="stable")[:k]
                for j, name in enumerate(names):
                    at = best[:, j][scores[best[:, j], j] >= least]
                    if len(at):
                        yield pd.DataFrame({by: name, key: keys[at], "score": scores[at, j]})

    return run


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, length): the sparse index; the length of a text is counted before it is exploded, so nothing is joined."""
    words = documents.select(key, terms(F.col(text)).alias("w")).withColumn("length", F.size("w"))
    return words.select(key, "length", F.explode("w").alias("term")).groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def bm25_topk(documents: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, k: int = 15, k1: float = 1.2, b: float = 0.75, often: float = 0.02) -> DataFrame:
    """(query_key, key, score, rank): the k best texts of each query. Only postings of query terms are kept, before any shuffle.

    Terms that more than the share ``often`` of the texts hold would pair nearly all texts with nearly all queries. Their
    weights are summed a text for each different set of them that queries have, and a set's k best texts and the texts
    with any other term of the query hold the k best of the query: every weight is positive, so the result is that of all
    pairs whatever ``often`` is.
    """
    asked = queries.select(query_key, F.explode(F.array_distinct(terms(F.col(query_text)))).alias("term"))
    scratch = Scratch(documents.sparkSession, "bm25")
    wanted = maybe_broadcast(asked.select("term").distinct())
    sized = documents.select(key, terms(F.col(text)).alias("w")).withColumn("length", F.size("w"))
    stats = sized.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    hits = sized.select(key, "length", F.explode("w").alias("term")).join(wanted, "term").groupBy("term", key, "length").agg(F.count("*").alias("tf"))
    hits = scratch.keep(hits, "hits")
    df = hits.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(stats))
    df = scratch.keep(df.select("term", "mean", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), (F.col("df") > often * F.col("n")).alias("common")), "df")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    parts = hits.join(maybe_broadcast(df), "term").select("term", key, "common", part.alias("part"))
    common = parts.filter("common").groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "part")))).alias("weights"))
    known = asked.join(df.select("term", "common"), "term")
    sets = known.filter("common").groupBy(query_key).agg(F.array_sort(F.collect_list("term")).alias("common_terms"))
    weight = F.aggregate("common_terms", F.lit(0.0), lambda x, t: x + F.coalesce(F.try_element_at("weights", t), F.lit(0.0)))
    base = common.join(F.broadcast(sets.select("common_terms").distinct())).select("common_terms", key, F.round(weight, 6).alias("score")).filter("score > 0")
    best = base.withColumn("_r", F.row_number().over(Window.partitionBy("common_terms").orderBy(F.desc("score"), key))).filter(F.col("_r") <= k)
    best = maybe_broadcast(sets).join(best, "common_terms").select(query_key, key, "score")
    rare = parts.filter("NOT common").join(maybe_broadcast(known.filter("NOT common").select(query_key, "term")), "term").groupBy(query_key, key).agg(F.sum("part").alias("rare"))
    rare = rare.join(maybe_broadcast(sets), query_key, "left").join(common, key, "left")
    rare = rare.select(query_key, key, F.round(F.col("rare") + F.when(F.col("weights").isNotNull() & F.col("common_terms").isNotNull(), weight).otherwise(0.0), 6).alias("score"))
    total = best.unionByName(rare).groupBy(query_key, key).agg(F.max("score").alias("score"))
    ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key)))
    return ranked.filter(F.col("rank") <= k)


def tfidf_pairs(texts: DataFrame, key: str, text: str, least: float = 0.3, block: str | None = None, stop: list[str] = STOP_WORDS, links: bool = False) -> DataFrame:
    """(a, b, score): pairs a < b whose TF-IDF vectors (smooth idf + 1, unit length) have at least the cosine, within a block.

    Vectors are multiplied cell by cell, so the products of pairs below the cosine never leave their task; stop words are left
    out of the vectors. With ``links`` only so many of the pairs as link the same keys.
    """
    by = [block] if block else []
    words = texts.select(key, *by, F.explode(F.filter(terms(F.col(text)), lambda w: (F.length(w) > 1) & ~w.isin(stop))).alias("term"))
    tf = words.groupBy(key, *by, "term").agg(F.count("*").alias("tf"))
    scratch = Scratch(texts.sparkSession, "tfidf")
    tf = scratch.keep(tf.filter(F.col(key).isNotNull()), "tf")
    n = tf.select(key, *by).distinct().groupBy(*by).agg(F.count("*").alias("n"))
    df = tf.groupBy(*by, "term").agg(F.count("*").alias("df"))
    raw = tf.join(df, [*by, "term"])
    raw = raw.join(maybe_broadcast(n), by) if by else raw.join(F.broadcast(n))  # one row without blocks
    raw = raw.withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    unit = raw.groupBy(F.col(key).alias("k"), (F.col(block) if block else F.lit("")).alias("g")).agg(F.collect_list(F.struct("term", "w")).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = scratch.keep(unit.select("k", "g", F.col("v.term").alias("terms"), F.transform("v.w", lambda w: w / F.col("norm")).alias("weights")), "unit")
    scratch.drop("tf")
    kind = dict(unit.dtypes)["k"]
    pairs = in_cells(unit, "k", "g", _cosines(least, links), f"a {kind}, b {kind}, score double")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("score", 6).alias("score")).filter((F.col("a") != F.col("b")) & (F.col("score") >= least))


def _cosines(least: float, links: bool):
    def vectors(table: pa.Table, codes: np.ndarray):
        return sparse(pc.list_value_length(table["terms"]).to_numpy(), codes, pc.list_flatten(table["weights"]).to_numpy())

    def run(left: pa.Table, right: pa.Table, same: bool) -> Iterator[dict]:
        words = [pc.list_flatten(x["terms"]).combine_chunks() for x in (left, right)]
        codes = pa.concat_arrays(words).dictionary_encode().indices.to_numpy()
        a, b = vectors(left, codes[: len(words[0])]), vectors(right, codes[len(words[0]) :])
        forest = Forest(len(left) if same else len(left) + len(right)) if links else None
        for start, scores in products(a, b):
            i, j = np.nonzero(scores >= least - 5e-7)  # rounded to six places later
            found = scores[i, j]
            i += start
            if same:
                i, j, found = i[j > i], j[j > i], found[j > i]
            if forest:
                kept = forest.fresh(i, j if same else j + len(left))
                i, j, found = i[kept], j[kept], found[kept]
            yield {"a": left["k"].take(pa.array(i)), "b": right["k"].take(pa.array(j)), "score": found}

    return run


def rank_fusion(rankings: DataFrame, key: str, k: int = 60, most: int | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, key, score): sum of 1 / (k + rank) over the rankings (ranking, key, score), rank from 1 by score, ties by key;
    the ``most`` best, of each question where ``by`` names one."""
    by = by or []
    if by:  # the rankings of a question are top-k lists
        placed = rankings.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "ranking").orderBy(F.desc("score"), key)))
    else:
        placed = ranked(rankings, ["ranking"], [F.desc("score"), F.col(key)], "rank")
    fused = placed.groupBy(*by, key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    if most is None or not by:
        return fused if most is None else fused.orderBy(F.desc("score"), key).limit(most)
    return fused.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), key))).filter(F.col("_r") <= most).drop("_r")


def rerank(rows: DataFrame, score: str, top: int, least: float = 0.0, order: str = "position") -> DataFrame:
    """The ``top`` rows by score, at least ``least``; rows without a score keep their order, behind the others."""
    return rows.filter(F.col(score).isNull() | (F.col(score) >= least)).orderBy(F.col(score).desc_nulls_last(), order).limit(top)


def group_context(hits: DataFrame, chunks: DataFrame, identities: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Hits (by, chunk_id, score) with their chunks, documents by their best score, in a document its identity first, then by
    chunk_index; position numbers the rows of each question. An identity row comes only for a document that has one.

    The hits of one question are a top-k, so each question is a window; without ``by`` the hits may be many and are numbered by ranges.
    """
    by = by or []
    rows = hits.join(chunks, "chunk_id").select(*by, "chunk_id", "doc_id", "chunk_index", "score", F.lit(False).alias("is_identity"))
    best = rows.groupBy(*by, "doc_id").agg(F.max("score").alias("best"))
    out = rows
    if identities is not None:
        cards = identities.join(best.select(*by, "doc_id"), "doc_id").join(rows.select(*by, "chunk_id"), [*by, "chunk_id"], "left_anti")
        out = out.unionByName(cards.select(*by, "chunk_id", "doc_id", F.lit(-1).alias("chunk_index"), F.lit(1.0).alias("score"), F.lit(True).alias("is_identity")))
    order = [F.desc("best"), F.col("doc_id"), F.desc("is_identity"), F.col("chunk_index"), F.col("chunk_id")]
    out = out.join(best, [*by, "doc_id"])
    return out.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))) if by else ranked(out, [], order, "position")


def ordered_by_document(hits: DataFrame, by: list[str]) -> DataFrame:
    """position: documents by their best score, in a document by chunk_index; the hits (by, doc_id, chunk_index, score) of a question are a top-k."""
    best = F.max("score").over(Window.partitionBy(*by, "doc_id"))
    return hits.withColumn("best", best).withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("best"), "doc_id", "chunk_index")).cast("long")).drop("best")


def fill(first: DataFrame, then: DataFrame, top: int, key: str = "chunk_id") -> DataFrame:
    """The rows of a strategy, then those of the vector search that it lacks, up to ``top`` in all. Both: key, score."""
    rest = then.join(first.select(key), key, "left_anti")
    both = first.select(key, "score", F.lit(0).alias("part")).unionByName(rest.select(key, "score", F.lit(1).alias("part")))
    order = ["part", F.desc("score"), F.col(key)]
    return both.orderBy(*order).limit(top).withColumn("position", F.row_number().over(Window.orderBy(*order)))  # numbers the kept rows only


def top_per_entity(links: DataFrame, k: int, entity: str = "entity_id", order: str = "relevance_score", key: str = "chunk_id") -> DataFrame:
    """The k best chunks of each entity; Spark cuts each partition to k before the shuffle."""
    w = Window.partitionBy(entity).orderBy(F.col(order).desc_nulls_last(), key)
    return links.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def contained_texts(texts: DataFrame, piece: int = 3) -> DataFrame:
    """(part, whole): pairs of different texts t of which one contains the other, by an index of pieces; none is missed.

    Each text looks, by the rarest of its pieces of ``piece`` letters, for those that hold it; one of fewer letters is a piece itself.
    Both joins are by sorting: sizes estimated from packed files would let a grown table be broadcast through the driver.
    """
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.length("t") - n + 1), lambda i: F.substr(F.col("t"), i, F.lit(n)))
    all_ = F.array_distinct(F.concat(*[F.when(F.length("t") >= n, pieces(n)).otherwise(F.array().cast("array<string>")) for n in range(1, piece + 1)]))
    held = texts.filter("t <> ''").select("t", F.explode(all_).alias("piece"))
    own = held.filter(F.length("piece") == F.least(F.length("t"), F.lit(piece)))
    counts = held.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = own.join(counts.hint("merge"), "piece").groupBy(F.col("t").alias("part")).agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    return rarest.join(held.select("piece", F.col("t").alias("whole")).hint("merge"), "piece").filter((F.col("part") != F.col("whole")) & F.col("whole").contains(F.col("part"))).select("part", "whole")


def resolve_mentions(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention, variant, entity, match_score, final_score): the best entity of each mention.

    mentions: mention, variants (array, the primary name first). A variant matches an entity by its normalised name exactly (1.0),
    by containment either way (0.8) or by an alias (0.6); the first variant that matches anything wins, then the better match,
    then more chunks. final_score is the likeness of the variant and the name. Three equality joins: names, pieces of names,
    aliases. All tables grow, so none is broadcast, whatever size is estimated from its packed file.
    """
    scratch = Scratch(mentions.sparkSession, "mentions")  # a name is normalised once: its expression is long, and every use repeats it in the plan
    asked = mentions.select("mention", F.posexplode("variants").alias("ord", "variant")).withColumn("v", normalize_name(F.col("variant"))).filter("v <> ''")
    asked = scratch.keep(asked, "asked").hint("merge")
    known = entities.select("entity", "chunk_count", normalize_name(F.col("entity")).alias("n"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), normalize_name).alias("al"))
    known = scratch.keep(known, "known")
    named = known.filter("n <> ''").select("entity", "chunk_count", "n")
    exact = named.join(asked, F.col("n") == F.col("v")).withColumn("match_score", F.lit(1.0))
    # Containment by the pieces of the shorter side: a name's first piece lies in the variant, or the variant's in the name.
    texts = named.select(F.col("n").alias("t")).unionByName(asked.select(F.col("v").alias("t"))).distinct()
    within = scratch.keep(contained_texts(texts), "within")
    both = within.unionByName(within.select(F.col("whole").alias("part"), F.col("part").alias("whole")))
    partly = named.join(both.hint("merge"), named["n"] == both["part"]).join(asked, F.col("whole") == F.col("v")).withColumn("match_score", F.lit(0.8))
    alias = known.select("entity", "chunk_count", "n", F.explode(F.array_distinct("al")).alias("v")).join(asked, "v").withColumn("match_score", F.lit(0.6))
    columns = ["mention", "ord", "variant", "v", "entity", "n", "chunk_count", "match_score"]
    hits = exact.select(columns).unionByName(partly.select(columns)).unionByName(alias.select(columns))
    best = hits.groupBy("mention").agg(F.max_by(F.struct("variant", "entity", "match_score", "v", "n"), F.struct(-F.col("ord"), F.col("match_score"), F.col("chunk_count"), F.col("entity"))).alias("h"))
    return best.select("mention", "h.variant", "h.entity", "h.match_score", F.round(gestalt_column(F.col("h.v"), F.col("h.n")), 6).alias("final_score"))


def tag_search(tags: DataFrame, name: str) -> DataFrame:
    """The tag with the label, else the first by label with one that contains it or is within it, else the first with the alias."""
    x = name.strip().lower()
    low = F.lower("label")
    level = F.when(low == x, 0).when(low.contains(x) | F.lit(x).contains(low), 1).when(F.exists("aliases", lambda a: F.lower(a) == x), 2)
    return tags.withColumn("level", level).filter("level IS NOT NULL").orderBy("level", "label").limit(1)


def tag_trust(tags: DataFrame, entity_tags: DataFrame, entities: DataFrame, links: DataFrame) -> DataFrame:
    """(tag_id, entities, docs, types, trust_score): how far a tag may be trusted: by its entities, documents, and unity of
    types, and whether it is a system tag. A tag without entities has no documents; unity is at most 1."""
    per = entity_tags.join(entities.select("entity_id", "entity_type"), "entity_id", "left").groupBy("tag_id").agg(F.count_distinct("entity_id").alias("entities"), F.count_distinct("entity_type").alias("types"))
    docs = entity_tags.join(links.select("entity_id", "doc_id"), "entity_id").groupBy("tag_id").agg(F.count_distinct("doc_id").alias("docs"))
    out = tags.join(per, "tag_id", "left").join(docs, "tag_id", "left").fillna(0, ["entities", "types", "docs"])
    unity = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (F.col("types") - 1) * 0.5))
    score = 0.3 * F.least(F.lit(1.0), F.col("entities") / 10) + 0.3 * F.least(F.lit(1.0), F.col("docs") / 3) + 0.2 * unity + F.when(F.col("is_system"), 0.3).otherwise(0.0)
    return out.select("tag_id", "entities", "docs", "types", F.round(score, 6).alias("trust_score"))


def choose_strategy(matches: list[dict], query_type: str) -> str:
    """vector, tag, summary, relationship or hybrid, by what a question's names resolved to (dicts with kind)."""
    if not matches:
        return "vector"
    if matches[0]["kind"] == "tag":
        return "tag"
    named = [m for m in matches if m["kind"] == "entity"]
    if query_type == "overview" and len(matches) == 1:
        return "summary"
    if query_type == "relationship" and len(named) >= 2:
        return "relationship"
    return "hybrid"


def entity_summaries(entities: DataFrame) -> DataFrame:
    """(entity, chunk_id, text, score): each entity's summary as one chunk of score 0.95; nothing for those without one."""
    rows = entities.filter(F.trim("summary") != "")
    return rows.select("entity", F.concat(F.lit("summary_"), "entity").alias("chunk_id"), F.col("summary").alias("text"), F.lit(0.95).alias("score"))


def entity_summary(entities: DataFrame, entity: str) -> DataFrame:
    """The entity's summary as one chunk; nothing if it has none."""
    return entity_summaries(entities.filter(F.col("entity") == entity)).drop("entity")


def tag_group(trust: DataFrame, entity_tags: DataFrame, links: DataFrame, tag: str, least: float = 0.6, entities: int = 5, each: int = 2) -> DataFrame:
    """(chunk_id, entity_id, position): a trusted tag's own line first, then the best chunks of its first entities."""
    good = trust.filter((F.col("tag_id") == tag) & (F.col("trust_score") >= least)).select("tag_id")
    members = entity_tags.join(good, "tag_id", "left_semi").select("entity_id").distinct().orderBy("entity_id").limit(entities)
    best = top_per_entity(links.join(maybe_broadcast(members), "entity_id"), each)
    head = good.select(F.concat(F.lit("tag_"), "tag_id").alias("chunk_id"), F.lit(None).cast("string").alias("entity_id"), F.lit(0).alias("part"), F.lit(0).alias("rank"))
    rows = head.unionByName(best.select("chunk_id", "entity_id", F.lit(1).alias("part"), "rank"))
    return rows.withColumn("position", F.row_number().over(Window.orderBy("part", "entity_id", "rank"))).drop("part", "rank")


def words_of(text: Column) -> Column:
    return F.split(text, f"{SPACE}+")
