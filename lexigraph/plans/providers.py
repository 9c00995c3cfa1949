"""Model-backed operators behind a cache table: any callable from prompts to answers may stand behind them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cache_key, entity_tuples, json_part, relationship_tuples, tuples, weight

#: list of prompts -> list of answers; runs in the workers
Provider = Callable[[list[str]], list[str]]


def ask(prompts: DataFrame, provider: Provider, cache: DataFrame | None = None, model: str = "rules", ttl_days: float = 7, attempts: int = 3, wait: float = 0.0, fallback: str = "") -> DataFrame:
    """prompts (key, prompt) with answer, error and cached: from the cache (key, response, created_at) where it is fresh, else from the provider.

    Equal prompts are asked once. A batch that fails is tried again, waiting twice as long each time; then its answers are
    the fallback and error says why, so that one bad batch does not end the run and a failure is never taken for an answer
    (``to_cache`` leaves it out).
    """
    asked = prompts.withColumn("_k", cache_key(F.array("prompt"), F.lit(model)))
    once = asked.select("_k", "prompt").dropDuplicates(["_k"])
    if cache is not None:
        fresh = cache.filter(F.col("created_at") >= F.current_timestamp() - F.expr(f"INTERVAL {int(ttl_days * 86400)} SECONDS"))
        known = fresh.groupBy("key").agg(F.max_by("response", "created_at").alias("response")).withColumnRenamed("key", "_k")
        misses = once.join(known, "_k", "left_anti")
    else:
        known, misses = None, once

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, answers, error = batch["prompt"].tolist(), None, None
            for attempt in range(attempts):
                try:
                    answers, error = provider(texts), None
                    break
                except Exception as x:  # noqa: BLE001 - any failure of a provider is retried
                    error = f"{type(x).__name__}: {x}"
                    time.sleep(wait * 2**attempt)
            yield pd.DataFrame({"_k": batch["_k"], "response": answers if answers is not None else [fallback] * len(texts), "error": pd.Series([error] * len(texts), dtype="object")})

    new = misses.mapInPandas(run, "_k string, response string, error string").withColumn("cached", F.lit(False))
    answers = new if known is None else new.unionByName(known.select("_k", "response", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached")))
    return asked.join(answers, "_k", "left").withColumnRenamed("response", "answer").withColumnRenamed("_k", "cache_key")


def to_cache(answered: DataFrame) -> DataFrame:
    """(key, response, created_at): the new answers of ``ask`` for the cache table, without failures."""
    new = answered.filter("NOT cached AND error IS NULL").select(F.col("cache_key").alias("key"), F.col("answer").alias("response"))
    return new.dropDuplicates(["key"]).withColumn("created_at", F.current_timestamp())


def embed(texts: DataFrame, provider: Callable[[list[str]], list[list[float]]], key: str = "chunk_id", text: str = "text", instruction: str = "") -> DataFrame:
    """(key, embedding) of texts, in Arrow batches; a question is given the instruction before it, a document none. Null texts have no vector."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({key: batch[key], "embedding": provider([instruction + t for t in batch[text]])})

    return texts.filter(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def score_pairs(rows: DataFrame, provider: Callable[[list[tuple[str, str]]], list[float]], question: str = "question", text: str = "text") -> DataFrame:
    """rows with rerank_score, a cross-encoder's score of (question, text); null where a batch fails, so that those keep their order
    behind the others in ``retrieval.rerank``."""

    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        try:
            return pd.Series(provider(list(zip(q, t.fillna("")))), dtype="float64")
        except Exception:  # noqa: BLE001 - a reranker that fails leaves the first ranking
            return pd.Series([None] * len(q), dtype="float64")

    return rows.withColumn("rerank_score", F.pandas_udf(run, "double")(F.col(question), F.col(text)))


def answer_prompts(contexts: DataFrame, history: DataFrame | None = None, most: int = 10) -> DataFrame:
    """(key, prompt) of (question_id, question, context): the last ``most`` turns (question_id, turn, role, content) in order, the
    sources, the question."""
    rows = contexts
    if history is not None:
        kept = history.withColumn("_k", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("turn")))).filter(F.col("_k") <= most)
        told = kept.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n").alias("_said"))
        rows = contexts.join(told, "question_id", "left")
    else:
        rows = contexts.withColumn("_said", F.lit(None).cast("string"))
    return rows.select(F.col("question_id").alias("key"), F.concat_ws("\n\n", F.lit("ANSWER"), "_said", "context", F.concat(F.lit("QUESTION: "), "question")).alias("prompt"))


def visual_summaries(chunks: DataFrame, provider: Provider, **options) -> DataFrame:
    """(chunk_id, visual_summary): a model's line on the tables and images of a chunk; '' for a chunk without any, which is not asked about."""
    seen = (F.size("chunk_tables") > 0) | (F.size("chunk_images_urls") > 0)
    prompt = F.concat_ws("\n", F.lit("VISUAL"), "chunk_heading_full", F.array_join("chunk_tables", "\n"), F.array_join("chunk_images_urls", "\n"))
    told = ask(chunks.filter(seen).select(F.col("chunk_id").alias("key"), prompt.alias("prompt")), provider, **options).select(F.col("key").alias("chunk_id"), "answer").dropDuplicates(["chunk_id"])
    return chunks.select("chunk_id").distinct().join(told, "chunk_id", "left").select("chunk_id", F.coalesce("answer", F.lit("")).alias("visual_summary"))


def extract_light(units: DataFrame, provider: Provider, **options) -> DataFrame:
    """units (unit_id, text) with answer: entities asked for first, then the relations among those that were found."""
    first = ask(units.select(F.col("unit_id").alias("key"), F.concat(F.lit("ENTITIES\n"), "text").alias("prompt")), provider, **options).select(F.col("key").alias("unit_id"), F.col("answer").alias("entities"))
    named = F.array_join(F.transform(entity_tuples(tuples(F.col("entities"))), lambda e: e[1]), "\n")
    both = units.join(first, "unit_id").withColumn("_named", named)
    second = ask(both.filter("_named <> ''").select(F.col("unit_id").alias("key"), F.concat(F.lit("RELATIONS\n"), "_named", F.lit("\n\n"), "text").alias("prompt")), provider, **options)
    return both.join(second.select(F.col("key").alias("unit_id"), F.col("answer").alias("relations")), "unit_id", "left").select("unit_id", F.concat_ws("##", "entities", F.nullif(F.col("relations"), F.lit(""))).alias("answer"))


def reduce_points(points: DataFrame, question: str, provider: Provider, budget: int = 12_000, **options) -> DataFrame:
    """(answer): one answer from the points (description, score, position) of a map step, the most important first, as many as a prompt of
    ``budget`` characters holds."""
    line = F.concat(F.lit("["), F.col("score").cast("string"), F.lit("] "), "description")
    rows = points.orderBy(F.desc("score"), "description").limit(200).select("score", "description", line.alias("line"))  # the best of one question
    used = F.sum(F.length("line") + 1).over(Window.orderBy(F.desc("score"), "description"))
    listed = rows.withColumn("used", used).filter(F.col("used") <= budget).agg(F.array_sort(F.collect_list(F.struct(-F.col("score"), F.col("description"), F.col("line").alias("line")))).alias("l"))
    prompt = listed.select(F.lit(0).alias("key"), F.concat(F.lit(f"REDUCE\n{question}\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("prompt"))
    return ask(prompt, provider, **options).select("answer")


def drift(answers: DataFrame) -> DataFrame:
    """(key, response, score, follow_up_queries) of drift-search answers {response, score, follow_up_queries}; nulls where it fails."""
    shape = "response string, score double, follow_up_queries array<string>"
    return answers.withColumn("r", F.from_json(json_part(F.col("answer")), shape)).select("key", "r.*")


def follow_up_questions(answers: DataFrame) -> DataFrame:
    """(key, position, question): the questions that an answer lists, one a line, bullets left out."""
    lines = F.filter(F.transform(F.split("answer", "\n"), lambda x: F.regexp_replace(F.trim(x), r"^[-*•]\s*|^\d+[.)]\s*", "")), lambda x: x != "")
    return answers.select("key", F.posexplode(lines).alias("position", "question"))


def answers_to_graph(answers: DataFrame, unit: str = "unit_id") -> tuple[DataFrame, DataFrame]:
    """Entities (unit, title, type, description, pos) and relationships (unit, source, target, description, weight) of answers."""
    records = answers.select(unit, tuples(F.col("answer")).alias("r"))
    entities = records.select(unit, F.posexplode(entity_tuples(F.col("r"))).alias("pos", "e")).select(unit, F.col("e")[1].alias("title"), F.col("e")[2].alias("type"), F.col("e")[3].alias("description"), "pos")
    relations = records.select(unit, F.explode(relationship_tuples(F.col("r"))).alias("e"))
    return entities, relations.select(unit, F.col("e")[1].alias("source"), F.col("e")[2].alias("target"), F.col("e")[3].alias("description"), weight(F.col("e")[4]).alias("weight"))


def extract_graph(units: DataFrame, provider: Provider, gleanings: int = 1, **options) -> DataFrame:
    """units (unit_id, text) with answer: the provider's records, and those it adds when asked again up to ``gleanings`` times.

    A unit is asked again only while its last answer had a record: after an empty answer or a "no" there is nothing to add.
    """
    out = ask(units.select(F.col("unit_id").alias("key"), F.concat(F.lit("EXTRACT\n"), "text").alias("prompt")), provider, **options)
    rows = out.select(F.col("key").alias("unit_id"), "answer", F.col("answer").alias("_last"))
    for n in range(gleanings):
        open_ = units.join(rows.filter(F.size(tuples(F.col("_last"))) > 0).select("unit_id"), "unit_id", "left_semi")
        more = ask(open_.select(F.col("unit_id").alias("key"), F.concat(F.lit(f"CONTINUE {n + 1}\n"), "text").alias("prompt")), provider, **options)
        more = more.select(F.col("key").alias("unit_id"), F.coalesce("answer", F.lit("")).alias("_more"))
        rows = rows.join(more, "unit_id", "left").select("unit_id", F.concat_ws("##", "answer", F.nullif(F.col("_more"), F.lit(""))).alias("answer"), F.col("_more").alias("_last"))
    return rows.drop("_last")


def merge_descriptions(rows: DataFrame, provider: Provider | None = None) -> DataFrame:
    """rows (key, fragments) with description: the only fragment as it is, else the provider's synthesis of the sorted ones; without
    a provider, or where it fails, the first two."""
    sorted_ = F.array_sort(F.array_distinct(F.filter("fragments", lambda f: f.isNotNull() & (f != ""))))
    base = rows.withColumn("_f", sorted_).withColumn("_first", F.array_join(F.slice("_f", 1, 2), " "))
    if provider is None:
        return base.withColumn("description", F.when(F.size("_f") <= 1, F.coalesce(F.try_element_at("_f", F.lit(1)), F.lit(""))).otherwise(F.col("_first"))).drop("_f", "_first")
    many = base.filter(F.size("_f") > 1).select("key", F.concat(F.lit("SUMMARISE\n"), F.array_join("_f", "\n")).alias("prompt"))
    told = ask(many, provider).select("key", F.nullif(F.col("answer"), F.lit("")).alias("_a"))
    out = base.join(told, "key", "left").withColumn("description", F.when(F.size("_f") <= 1, F.coalesce(F.try_element_at("_f", F.lit(1)), F.lit(""))).otherwise(F.coalesce("_a", "_first")))
    return out.drop("_f", "_first", "_a")


def verdicts(answers: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cluster, i, j): pairs that a model merges, from records MERGE i j; indices that are no number or out of range are left out."""
    records = answers.select("cluster", F.explode(tuples(F.col("answer"))).alias("r")).filter(F.lower(F.col("r")[0]) == "merge")
    pairs = records.select("cluster", F.col("r")[1].try_cast("int").alias("i"), F.col("r")[2].try_cast("int").alias("j")).filter("i IS NOT NULL AND j IS NOT NULL AND i <> j")
    return pairs.join(sizes, "cluster").filter("i >= 0 AND j >= 0 AND i < size AND j < size").select("cluster", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def claims(answers: DataFrame, unit: str = "unit_id") -> DataFrame:
    """The eight-field claims of answers."""
    fields = ("subject", "object", "type", "status", "start_date", "end_date", "description", "source_text")
    rows = answers.select(unit, F.explode(F.filter(tuples(F.col("answer")), lambda p: F.size(p) >= 8)).alias("c"))
    return rows.select(unit, *[F.col("c")[i].alias(f) for i, f in enumerate(fields)])


def search_points(answers: DataFrame, least: int = 1, most: int = 50) -> DataFrame:
    """(description, score, position): the points that parts of a question found, {points: [{description, score}]}, best first."""
    shape = "points array<struct<description: string, score: int>>"
    rows = answers.select(F.explode(F.from_json(json_part(F.col("answer")), shape)["points"]).alias("p")).select("p.*").filter(F.col("score") >= least)
    return rows.orderBy(F.desc("score"), "description").limit(most)


def usage(log: DataFrame, prices: DataFrame, default: str = "mini") -> DataFrame:
    """(model, prompt_tokens, completion_tokens, cost): sums of a log; a model without a price costs as the default."""
    sums = log.groupBy("model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    base = prices.filter(F.col("model") == default).select(F.col("prompt_price").alias("_p"), F.col("completion_price").alias("_c"))
    priced = sums.join(F.broadcast(prices), "model", "left").join(F.broadcast(base))
    cost = (F.col("prompt_tokens") * F.coalesce("prompt_price", "_p") + F.col("completion_tokens") * F.coalesce("completion_price", "_c")) / 1e6
    return priced.select("model", "prompt_tokens", "completion_tokens", F.round(cost, 6).alias("cost"))
