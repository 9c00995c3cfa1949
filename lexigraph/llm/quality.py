"""Text statistics per document, and text types from them (problem 9)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("prose", "list", "table", "junk")
# Common words of the languages of the corpus.
COMMON = frozenset(
    """le la les l un une des de du d et à au aux en dans sur sous par pour avec sans ne pas que qui ce cette ces son sa ses leur leurs il elle on se s qu où
    est sont fut était a ont été plus comme mais ou si je tu nous vous y tout même deux trois vers près lors selon depuis pendant après avant entre
    the of and to in a an is was were are that this it its with for on at by from as or but not be he she they his her their had has have who which
    when while before after near into than then so no all one two there what you we i my your
    في من على إلى عن مع أن إن ما لا لم قد كان قال التي الذي هذا هذه بعد قبل عند دون كل غير بين خلال حتى ثم أو وفي ومن
    إن أمام قرب عند نحو كما التي والأول خلافا بحسب عليه عليها فيه فيها له لها منه منها هو هي وهو وهي به بها ذلك تلك وقد ولم وكان كانت""".split()
)
# Signs that open the entry of a list.
BULLET = r"[•▪◦‣●○■□☐☑✓✔*·➢➤–-]\s|\(?\d{1,3}[.)]\s|\(?[a-zA-Z][.)]\s|\(?[ivxIVX]{1,5}[.)]\s"
_BULLET = re.compile(BULLET)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_REFERENCE = re.compile(r"(?:[.…·]{3,}|[,:;]|\bp\.|\s)\s*(?:p\.\s*)?\d{1,4}(?:\s*[,-]\s*\d{1,4})*\.?$")
_CELLS = (re.compile(r"\t"), re.compile(r"\|"), re.compile(r";(?! )"), re.compile(r",(?! )"), re.compile(r" {2,}"))
_PIECE = re.compile(r"[^\W\d_]{2,}")
_LEADER = re.compile(r"[.…·_]{3,}")
_SENTENCE = re.compile(r"[^\W\d_][.,;:!?؟،؛…»\"”](?=\s|$)")
_NUMBER = re.compile(r"[\s|]*[-+]?\d[\d.,%€]*\s*")
_BROKEN = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f\ufffd\ue000-\uf8ff]|[ÃÂØÙÐÑ][\x80-\xbf\u2013-\u2122\u0152-\u0192]")
_VOWEL = re.compile(r"[aeiouyàâäáãéèêëíîïìóôöòõúûüùœæāīūēō]", re.I)
_LATIN_RUN = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}", re.I)

STATISTICS = (
    "words", "lines", "mean_word_length", "symbol_ratio", "digit_ratio", "end_punctuation", "common_words", "words_per_line", "bullets", "references",
    "cells", "number_cells", "variety", "distinct_runs", "distinct_lines", "sentence_signs", "broken", "implausible", "longest_word",
)


def statistics(text: str) -> tuple[float, ...]:
    """The statistics of a text, in the order of STATISTICS. variety is different words by the root of all words;
    distinct_runs counts runs of three words; sentence_signs are marks behind a word, by words. Shares are of lines, words or characters that are not blank."""
    lines = [x for x in (line.strip() for line in text.split("\n")) if x]
    tokens = text.split()
    words = _WORD.findall(text)
    n_lines, n_tokens, n_words = max(1, len(lines)), max(1, len(tokens)), max(1, len(words))
    solid = max(1, sum(map(len, tokens)) - sum(map(len, _LEADER.findall(text))))
    letters = sum(map(len, words))
    digits = sum(map(text.count, "0123456789"))
    parts = _PIECE.findall(text.lower())
    common, pieces = sum(w in COMMON for w in parts), max(1, len(parts))
    ends = sum(line[-1] in ".!?…؟»\"”:;" for line in lines)
    bullets = sum(1 for line in lines if _BULLET.match(line))
    references = sum(1 for line in lines if _REFERENCE.search(line[-24:]))
    cells = number_cells = 0.0
    if len(lines) >= 2:
        for sign in _CELLS:
            counts = Counter(len(sign.findall(line)) for line in lines)
            counts.pop(0, None)
            if not counts:
                continue
            mode, _ = max(counts.items(), key=lambda x: (x[1], x[0]))
            if mode < 2 and sign is not _CELLS[0] and sign is not _CELLS[1]:
                continue
            share = sum(n for k, n in counts.items() if abs(k - mode) <= max(1, mode // 3)) / n_lines
            if share > cells:
                parts = [c for line in lines for c in sign.split(line)]
                if n_tokens > 6 * len(parts):  # cells are short
                    continue
                cells = share
                number_cells = sum(1 for c in parts if not c.strip() or _NUMBER.fullmatch(c)) / len(parts)
    latin = [w for w in words if w.isascii() or _VOWEL.search(w)]
    odd = sum(1 for w in latin if len(w) > 1 and (not _VOWEL.search(w) or _LATIN_RUN.search(w)))
    return (
        float(len(words)), float(len(lines)), letters / n_words, max(0.0, 1 - (letters + digits) / solid), digits / solid, ends / n_lines, common / pieces,
        len(tokens) / n_lines, bullets / n_lines, references / n_lines, cells, number_cells, len(set(tokens)) / math.sqrt(n_tokens),
        len(set(zip(tokens, tokens[1:], tokens[2:]))) / max(1, len(tokens) - 2), len(set(lines)) / n_lines, len(_SENTENCE.findall(text)) / n_words,
        len(_BROKEN.findall(text)) / solid, odd / n_words, float(max(map(len, tokens), default=0)),
    )


def signs() -> list[tuple[str, str]]:
    """The labelling functions: (kind that is voted for, SQL condition on the statistics). A threshold alone may well err."""
    varied = "(words < 20 OR variety >= 3 AND distinct_runs >= 0.3) AND (lines < 6 OR distinct_lines >= 0.5)"
    sound = "symbol_ratio < 0.25 AND implausible < 0.25 AND broken < 0.02"
    return [
        ("prose", f"end_punctuation >= 0.5 AND common_words >= 0.06 AND {varied} AND broken < 0.02 AND bullets < 0.5"),
        ("prose", f"common_words >= 0.18 AND bullets < 0.4 AND cells < 0.5 AND references < 0.4 AND {varied} AND broken < 0.02"),
        ("prose", f"words_per_line >= 12 AND common_words >= 0.06 AND {varied} AND {sound} AND cells < 0.5"),
        ("prose", f"sentence_signs >= 0.04 AND end_punctuation >= 0.4 AND {varied} AND {sound} AND bullets < 0.5 AND references < 0.4 AND cells < 0.5"),
        ("list", "lines >= 4 AND bullets >= 0.5 AND end_punctuation < 0.5"),
        ("list", f"lines >= 4 AND words_per_line <= 9 AND end_punctuation < 0.3 AND common_words < 0.15 AND cells < 0.5 AND distinct_lines > 0.5 AND longest_word < 30 AND {sound}"),
        ("list", "lines >= 4 AND references >= 0.3 AND cells < 0.6 AND symbol_ratio < 0.5"),
        ("table", "lines >= 2 AND cells >= 0.6 AND end_punctuation < 0.5"),
        ("table", "lines >= 2 AND cells >= 0.6 AND (number_cells >= 0.15 OR common_words < 0.08)"),
        ("junk", "symbol_ratio >= 0.4 AND cells < 0.6"),
        ("junk", "broken >= 0.03"),
        ("junk", f"NOT ({varied})"),
        ("junk", "common_words < 0.05 AND implausible >= 0.25"),
        ("junk", "longest_word >= 30 AND words_per_line <= 3 AND bullets < 0.5 OR words = 0"),
        ("junk", "common_words < 0.03 AND sentence_signs < 0.03 AND lines <= 2 AND words >= 12 AND bullets = 0"),
    ]


#: No function is trusted further than this: those of one kind rest on the same statistics and agree more than independent ones.
MOST, LEAST = 0.8, 0.003


def learn(patterns: list[tuple[tuple[int, ...], int]], kinds: list[str], rounds: int = 40) -> dict:
    """Expectation-maximisation over the patterns of votes: the prior of each kind, and of each labelling function how
    often it fires on texts of its kind and on others. Documents count through their pattern, so at most 2 ** functions
    rows are needed. Weak prior counts keep a function from turning into its opposite and a kind that is absent from dying."""
    total = sum(n for _, n in patterns) or 1
    prior = {k: 0.97 if k == "prose" else 0.01 for k in KINDS}
    hit = [0.7] * len(kinds)
    slip = [0.01] * len(kinds)
    for _ in range(rounds):
        mass = dict.fromkeys(KINDS, 0.0)
        fired_own, own, fired_other, other = [0.0] * len(kinds), [0.0] * len(kinds), [0.0] * len(kinds), [0.0] * len(kinds)
        for votes, n in patterns:
            p = posterior(votes, kinds, prior, hit, slip)
            for k in KINDS:
                mass[k] += n * p[k]
            for j, kind in enumerate(kinds):
                own[j] += n * p[kind]
                other[j] += n * (1 - p[kind])
                if votes[j]:
                    fired_own[j] += n * p[kind]
                    fired_other[j] += n * (1 - p[kind])
        prior = {k: (mass[k] + 0.002 * total + 1) / (total * (1 + 0.002 * len(KINDS)) + len(KINDS)) for k in KINDS}
        weight = 0.01 * total + 5
        hit = [min(MOST, (f + 0.7 * 0.1 * weight) / (o + 0.1 * weight)) for f, o in zip(fired_own, own)]
        slip = [min(0.3, max(LEAST, (f + 0.01 * weight) / (o + weight))) for f, o in zip(fired_other, other)]
    return {"prior": prior, "hit": hit, "slip": slip}


def posterior(votes: tuple[int, ...], kinds: list[str], prior: dict, hit: list[float], slip: list[float]) -> dict[str, float]:
    logs = {}
    for k in KINDS:
        score = math.log(prior[k])
        for j, v in enumerate(votes):
            p = hit[j] if kinds[j] == k else slip[j]
            score += math.log(p if v else 1 - p)
        logs[k] = score
    top = max(logs.values())
    weights = {k: math.exp(s - top) for k, s in logs.items()}
    return {k: w / sum(weights.values()) for k, w in weights.items()}


def document_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the STATISTICS of each document, over its whole text. Null texts have null statistics."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [statistics(t) if t is not None else (None,) * len(STATISTICS) for t in batch["text"]]
            out = pd.DataFrame(rows, columns=list(STATISTICS), dtype="float64")
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


def text_types(documents: DataFrame) -> DataFrame:
    """doc_id, the statistics, kind and the posterior of each kind.

    The labelling functions' thresholds are noisy; how reliable each is, is learned by expectation-maximisation on how they
    agree over all documents, and the posterior of their votes decides. Null texts are left out; blank ones are junk. A
    repeated doc_id is kept as often. The statistics are written once to the shared folder and read twice.
    """
    from ..scratch import Scratch

    spark = documents.sparkSession
    table = document_statistics(documents.filter("text IS NOT NULL"))
    votes = [F.expr(f"int({c})").alias(f"v{j}") for j, (_, c) in enumerate(signs())]
    table = Scratch(spark, "quality").keep(table.select("*", F.array(*votes).alias("votes")), "statistics")
    kinds = [k for k, _ in signs()]
    patterns = [(tuple(r["votes"]), r["count"]) for r in table.groupBy("votes").count().collect()]  # at most 2 ** len(kinds) rows
    model = learn(patterns, kinds)
    rows = []
    for votes_, _ in patterns:
        p = posterior(votes_, kinds, **model)
        rows.append((list(votes_), max(KINDS, key=lambda k: p[k]), *[p[k] for k in KINDS]))
    schema = "votes array<int>, kind string, " + ", ".join(f"p_{k} double" for k in KINDS)
    of = spark.createDataFrame(rows, schema)
    return table.join(F.broadcast(of), "votes").drop("votes")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_types(_documents(spark, sf_dir)).filter("kind <> 'prose'").select("doc_id", "kind").distinct()


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_types(_documents(spark, sf_dir))


QUERIES = {"p9_found": p9_found, "p9_statistics": p9_statistics}
ORACLES: dict[str, str] = {}
