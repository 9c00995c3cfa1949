"""Evaluation texts leaking into training text (problem 7)."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Running words of an item that make a leak, and the share of them that must agree.
LEAK_WORDS, AGREE = 14, 0.8
#: Shortest verbatim match that is looked up, and the depth in words to which suffixes are sorted.
SEED, DEPTH = 4, 16
#: A word is distinctive if at most this share of the items, or three of them, hold it. A piece without one, of fewer than
#: LEAK_WORDS words on end and LONG in all, is a set phrase and no part of a passage.
DISTINCT_SHARE, LONG = 0.025, 28
#: A shard closes at so many words.
SHARD_WORDS = 1_500_000
_MARKS = re.compile("[̀-ًͯ-ٰٟ]+")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Words without case, accents and punctuation."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text)


class Items:
    """The test suffixes: all item words in one row of ids, items apart by 0."""

    def __init__(self, rows: list[tuple[int, str]]):
        listed = [(i, words_of(t)) for i, t in rows if t]
        listed = [(i, w) for i, w in listed if len(w) >= LEAK_WORDS]
        held = Counter(w for _, ws in listed for w in set(ws))
        self.vocabulary = {w: n + 1 for n, w in enumerate(sorted(held))}
        few = max(3, DISTINCT_SHARE * len(listed))
        self.distinct = np.zeros(len(held) + 1, dtype=bool)
        self.distinct[[self.vocabulary[w] for w, n in held.items() if n <= few]] = True
        ids, owner = [], []
        #: By an item's number (owner): its id, where it begins, and its words.
        self.item: list[tuple[int, int, list[int]]] = []
        for number, (i, ws) in enumerate(listed):
            self.item.append((i, len(ids), [self.vocabulary[w] for w in ws]))
            ids += [self.vocabulary[w] for w in ws] + [0]
            owner += [number] * (len(ws) + 1)
        pad = [0] * DEPTH
        self.ids = np.array(ids + pad, dtype="int32")
        self.owner = np.array(owner + pad[:0], dtype="int64")
        starts = np.arange(len(ids))
        whole = np.ones(len(ids), dtype=bool)
        for k in range(SEED):
            whole &= self.ids[starts + k] > 0
        #: The suffixes that are searched: all that begin with a seed.
        self.suffixes = starts[whole]


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Starts of all suffixes that begin with a known word, sorted by their first DEPTH words (prefix doubling).

    ids ends with DEPTH zeros; 0 sorts first and stands for any word that no item holds.
    """
    starts = np.flatnonzero(ids[:-DEPTH])
    rank = ids.astype("int64")
    order = starts
    step = 1
    while step <= DEPTH:
        keys = rank[starts] if step == 1 else rank[starts] * (int(rank.max()) + 1) + rank[np.minimum(starts + step // 2, len(ids) - 1)]
        by = np.argsort(keys, kind="stable")
        order, ordered = starts[by], keys[by]
        fresh = np.zeros(len(ids), dtype="int64")
        fresh[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else 0
        rank = fresh
        step *= 2
    return order


def _bound(ids: np.ndarray, order: np.ndarray, items: Items, upper: bool) -> np.ndarray:
    """For each searched suffix the first place in the suffix array whose SEED words are not less (upper: are greater)."""
    low, high = np.zeros(len(items.suffixes), dtype="int64"), np.full(len(items.suffixes), len(order), dtype="int64")
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = order[np.minimum(mid, len(order) - 1)]
        less, same = np.zeros(len(mid), dtype=bool), np.ones(len(mid), dtype=bool)
        for k in range(SEED):
            a, b = ids[at + k], items.ids[items.suffixes + k]
            less |= same & (a < b)
            same &= a == b
        go = open_ & (less | same if upper else less)
        low, high = np.where(go, mid + 1, low), np.where(open_ & ~go, mid, high)
    return low


def matches(ids: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the shard, place in the items, length) of every verbatim match that no match on its left continues."""
    order = suffix_array(ids)
    if not len(order) or not len(items.suffixes):
        return (np.zeros(0, dtype="int64"),) * 3
    low, high = _bound(ids, order, items, False), _bound(ids, order, items, True)
    count = high - low
    there = np.repeat(items.suffixes, count)
    here = order[np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
    # Those that continue a found match on the left: their predecessors agree, are a seed, and were searched too.
    searched = np.zeros(len(items.ids) + 1, dtype=bool)
    searched[items.suffixes] = True
    inner = (here > 0) & (there > 0) & (ids[here - 1] == items.ids[there - 1]) & searched[there - 1]
    here, there = here[~inner], there[~inner]
    length = np.full(len(here), SEED, dtype="int64")
    live = np.arange(len(here))
    while len(live):
        a = np.minimum(here[live] + length[live], len(ids) - 1)
        b = np.minimum(there[live] + length[live], len(items.ids) - 1)
        live = live[(ids[a] == items.ids[b]) & (ids[a] > 0)]
        length[live] += 1
    return here, there, length


_SKIPS = ((1, 1), (0, 1), (1, 0), (2, 2), (1, 2), (2, 1), (0, 2), (2, 0), (3, 3))


def _extend(text: list[int], item: list[int], p: int, q: int, step: int, covered: set[int]) -> None:
    """Goes on from a match over single changed, missing or added words, as long as two words agree behind them."""
    at = lambda s, k: s[k] if 0 <= k < len(s) else 0
    while True:
        while at(text, p) and at(text, p) == at(item, q):
            covered.add(q)
            p, q = p + step, q + step
        for a, b in _SKIPS:
            x, y = p + a * step, q + b * step
            if all(at(text, x + k * step) and at(text, x + k * step) == at(item, y + k * step) for k in range(2)):
                p, q = x, y
                break
        else:
            return


def _goes_on(ids: np.ndarray, items: Items, p: np.ndarray, q: np.ndarray, step: int) -> np.ndarray:
    """Whether _extend would go on from these places; true for some more, at the ends of texts."""
    out = np.zeros(len(p), dtype=bool)
    for a, b in _SKIPS:
        two = np.ones(len(p), dtype=bool)
        for k in range(2):
            x = ids[np.clip(p + (a + k) * step, 0, len(ids) - 1)]
            two &= (x > 0) & (x == items.ids[np.clip(q + (b + k) * step, 0, len(items.ids) - 1)])
        out |= two
    return out


def _holds(marks: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether a place from start on, of so many, is marked."""
    before = np.r_[0, np.cumsum(marks)]
    return before[start + length] > before[start]


def leaked_words(covered: set[int]) -> int:
    """Most words from one covered word of the item to another of which AGREE are covered."""
    places, best = sorted(covered), 0
    for n, a in enumerate(places):
        for m in range(len(places) - 1, n, -1):
            span = places[m] - a + 1
            if span <= best:
                break
            if m - n + 1 >= AGREE * span:
                best = span
                break
    return max(best, min(len(places), 1))


def find_leaks(documents: DataFrame, items: DataFrame, least: int = LEAK_WORDS) -> DataFrame:
    """(doc_id, item_id, words): documents that hold ``least`` or more running words of an item, and how many.

    A shard of the documents is one suffix array over word ids; every test suffix is
    looked up in it by binary search, its verbatim matches are made as long as they go, and go on over changed, missing
    or added words. The matches of a document may lie anywhere in it: they are laid out on the item, and the longest
    stretch of which AGREE agrees counts; set phrases under LEAK_WORDS words, told by the items alone, count for nothing, so a
    document's leaks do not depend on the others of its shard. Case, accents, punctuation and white space are ignored. Null and empty texts, and items shorter than a leak, give no rows;
    a repeated doc_id is reported once. The items, a held-out set, are broadcast; documents never leave their task.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(Items([tuple(r) for r in items.select("item_id", "text").filter("text IS NOT NULL AND item_id IS NOT NULL").collect()]))

    def shard(docs: list[tuple[int, list[int]]], test: Items) -> list[tuple[int, int, int]]:
        flat = np.fromiter((w for _, ids in docs for w in (*ids, 0)), dtype="int32")
        ids = np.r_[flat, np.zeros(DEPTH, dtype="int32")]
        ends = np.cumsum([len(x) + 1 for _, x in docs])
        here, there, length = matches(ids, test)
        sure = (length >= LEAK_WORDS) | _holds(test.distinct[test.ids], there, length)
        more = _goes_on(ids, test, here + length, there + length, 1) | _goes_on(ids, test, here - 1, there - 1, -1)
        here, there, length = (x[sure | more] for x in (here, there, length))  # the others are set phrases, whole
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for d, h, t, n in zip(np.searchsorted(ends, here, side="right").tolist(), here.tolist(), there.tolist(), length.tolist()):
            found.setdefault((d, int(test.owner[t])), []).append((h, t, n))
        out = []
        rare = test.distinct.tolist()
        for (d, number), runs in found.items():
            start = int(ends[d]) - len(docs[d][1]) - 1
            item, begin, words = test.item[number]
            covered: set[int] = set()
            for h, t, n in runs:
                piece = set(range(t - begin, t - begin + n))
                _extend(docs[d][1], words, h - start + n, t - begin + n, 1, piece)
                _extend(docs[d][1], words, h - start - 1, t - begin - 1, -1, piece)
                if n >= LEAK_WORDS or len(piece) >= LONG or any(rare[words[q]] for q in piece):
                    covered |= piece
            out.append((docs[d][0], item, leaked_words(covered)))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        test = shared.value
        of = test.vocabulary.get
        docs, size = [], 0
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = [of(w, 0) for w in words_of(text)]
                docs.append((doc_id, ids))
                size += len(ids) + 1
                if size >= SHARD_WORDS:
                    out += shard(docs, test)
                    docs, size = [], 0
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "words"])
        yield pd.DataFrame(shard(docs, test) if docs else [], columns=["doc_id", "item_id", "words"])

    rows = documents.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text")
    found = rows.mapInPandas(run, "doc_id long, item_id long, words long").filter(F.col("words") >= least)
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def clean_corpus(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents without the affected ones."""
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")


def _read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(*_read(spark, sf_dir)).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = _read(spark, sf_dir)
    return clean_corpus(documents, find_leaks(documents, items)).select("doc_id", "source")


QUERIES = {"p7_found": p7_found, "p7_clean": p7_clean}
ORACLES: dict[str, str] = {}
