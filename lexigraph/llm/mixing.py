"""Mixing sources to target weights by Pfair scheduling (problem 8)."""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from ..joins import maybe_broadcast
from ..scratch import Scratch

#: The vocabulary file of the public tokenizer by which sizes are counted, looked up in the installed tokenizer files.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Blocks of the whole mix, whatever its size: the schedule is so many rows.
BLOCKS = 4096
#: Hash buckets a source is cut into for running sums; no task sums more than one.
BUCKETS = 1024


def count_tokens(text, vocabulary: str = VOCABULARY):
    """Column: tokens of a text; null for null. vocabulary is a path, or the name of an installed file."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import public_tokenizers
        import tiktoken

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for texts in batches:
            yield pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, LongType())(text)


def quotas(have: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: int | None = None) -> dict[str, int]:
    """Tokens each source is to give: its share of the total, at most what its repeats allow.

    total defaults to the tokens of all sources that have a target. A source that falls short is not made up for by the
    others, so their shares of one another stay as asked.
    """
    norm = sum(s for s in share.values() if s and s > 0) or 1.0
    if total is None:
        total = sum(have.get(s, 0) for s in share)
    return {s: min(math.floor(total * (w or 0) / norm), have.get(s, 0) * (repeats.get(s) or 0)) for s, w in share.items() if w and w > 0}


def pfair(counts: dict[str, int]) -> list[tuple[str, int]]:
    """The order of the blocks, one a slot: [(source, number of its block)].

    Of N blocks in all a source with n has weight n / N. Its block i (from 0) is released at slot floor(i * N / n) and due by
    ceil((i + 1) * N / n). Earliest deadline first among the released meets every deadline, as the weights sum to one, so
    no source is ever a whole block ahead of or behind its weight. Ties go to the smaller name.
    """
    slots = sum(counts.values())
    weight = {s: Fraction(n, slots) for s, n in counts.items() if n}
    release = lambda s, i: math.floor(i / weight[s])
    due = lambda s, i: math.ceil((i + 1) / weight[s])
    waiting = [(release(s, 0), s, 0) for s in weight]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, i), s, i))
        if not ready:  # cannot be while weights sum to one; kept so that no block is lost
            at, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, i), s, i))
        _, s, i = heapq.heappop(ready)
        out.append((s, i))
        if i + 1 < counts[s]:
            heapq.heappush(waiting, (max(release(s, i + 1), slot + 1), s, i + 1))
    return out


def _placed(documents: DataFrame, wanted: list[str], vocabulary: str, seed: int, scratch: Scratch) -> DataFrame:
    """doc_id, source, tokens, start: where the document begins in its source's running sum of tokens."""
    rows = documents.filter(F.col("source").isin(wanted) & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "source", count_tokens(F.col("text"), vocabulary).alias("tokens"))
    order = F.xxhash64("doc_id", F.lit(seed))
    rows = scratch.keep(rows.filter("tokens > 0").withColumn("bucket", F.pmod(order, F.lit(BUCKETS)).cast("int")).withColumn("place", order), "tokens")
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("held"))  # sources * BUCKETS rows
    before = F.sum("held").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("within", F.coalesce(within, F.lit(0))).join(maybe_broadcast(sums), ["source", "bucket"])
    return placed.select("doc_id", "source", "tokens", (F.col("before") + F.col("within")).alias("start"))


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str = VOCABULARY, blocks: int = BLOCKS, seed: int = 0) -> DataFrame:
    """(slot, place, doc_id, source, copy, tokens): the mix, to be read in the order of slot, source and place.

    A source gives its documents in a random but fixed order, over again up to max_repeats times, until its quota
    (see ``quotas``) is reached; its last document may overshoot by a part of itself. Its token range is cut into blocks of
    one size, interleaved by ``pfair``. Documents without source, text or token, and of sources without a target, are left
    out; targets without documents or share give nothing; an empty table gives no rows. Each row of documents counts by
    itself. The running sum over a source is cut into hash buckets, so a source of any size is summed in parallel; what the
    driver handles is one row a target and the schedule of ``blocks`` rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    listed = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).filter("source IS NOT NULL").collect()
    share, repeats = {r["source"]: r["share"] for r in listed}, {r["source"]: r["repeats"] for r in listed}
    placed = scratch.keep(_placed(documents, sorted(share), vocabulary, seed, scratch), "placed")
    have = {r["source"]: r["held"] for r in placed.groupBy("source").agg(F.sum("tokens").alias("held")).collect()}
    quota = {s: q for s, q in quotas(have, share, repeats, total).items() if q > 0}
    whole = sum(quota.values())
    counts = {s: max(1, round(blocks * q / whole)) for s, q in quota.items()}
    schedule = spark.createDataFrame([(s, i, n) for n, (s, i) in enumerate(pfair(counts))], "source string, block int, slot int")
    of = spark.createDataFrame([(s, q, have[s], counts[s]) for s, q in quota.items()], "source string, quota long, held long, blocks int")
    rows = placed.join(F.broadcast(of), "source").filter("start < quota")
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(0L, (quota - start - 1) div held)")))
    rows = rows.withColumn("place", F.expr("start + copy * held")).withColumn("block", F.expr("least(blocks - 1, int(place * CAST(blocks AS DECIMAL(38, 0)) / quota))"))
    return rows.join(F.broadcast(schedule), ["source", "block"]).select("slot", "place", "doc_id", "source", (F.col("copy") + 1).cast("int").alias("copy"), "tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target: its share asked for, tokens, documents and most copies of one, and the share reached."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"), F.max("copy").alias("most_copies"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    asked = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    return asked.join(got, "source", "left").join(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"),
    )


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/mix_targets.parquet")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(*_tables(spark, sf_dir))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, targets = _tables(spark, sf_dir)
    return shares(mix(documents, targets), targets)


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
ORACLES: dict[str, str] = {}
