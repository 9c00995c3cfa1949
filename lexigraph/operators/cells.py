"""All pairs of a block, cell by cell: a task holds two parts of a block and compares them, so candidates are never shuffled.

What is shuffled are the rows, once for each part of their block. A cell's pairs exist only a slab at a time in the task that
compares them; those that are kept leave it, and where only connected groups are asked for, only as many as link the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import maybe_broadcast

#: Numbers in a slab of pairs, pairs whose subsequences are counted at once, and the share of rows from which on a feature goes by a product of matrices.
SLAB, CHUNK, DENSE = 4_000_000, 16_000, 0.05

#: (left rows, right rows, whether they are the same rows) -> column arrays of what is kept
Compare = Callable[[pa.Table, pa.Table, bool], Iterator[dict]]
#: (rows of a task) -> a call with ``rows``, their number, that takes others -> column arrays of what is kept
Begin = Callable[[pa.Table], Callable[[pa.Table], Iterator[dict]]]


def in_cells(rows: DataFrame, key: str, block: str, compare: Compare, schema: str, size: int = 8192) -> DataFrame:
    """What ``compare`` yields for every two parts of every block; a part has about ``size`` rows, those of one key together.

    Each two rows of a block meet in exactly one cell if their parts differ, and twice, in either order, if not. ``rows`` is read
    twice, so it should be a written table. Rows without block, and blocks of one row, have no pairs.
    """
    n = rows.groupBy(block).agg(F.count("*").alias("_n")).filter("_n > 1")
    n = n.select(block, F.greatest(F.ceil(F.col("_n") / size), F.least(F.lit(4), F.ceil(F.col("_n") / 500))).cast("int").alias("_parts"))
    cells = int(n.agg(F.sum(F.col("_parts").cast("double") * (F.col("_parts") + 1) / 2)).first()[0] or 0)
    placed = rows.join(maybe_broadcast(n), block).withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int"))
    placed = placed.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    first, last = F.least("_part", "_with"), F.greatest("_part", "_with")
    placed = placed.select(F.concat_ws("|", first, last, block).alias("_cell"), (F.col("_part") == first).alias("_left"), (F.col("_part") == last).alias("_right"), *[c for c in rows.columns if c != block])
    return placed.repartition(min(max(2 * cells, 12), 2000), "_cell").sortWithinPartitions("_cell").mapInArrow(_by_cell(compare, schema_of(rows.sparkSession, schema)), schema)


def in_windows(rows: DataFrame, order: list[Column], compare: Compare, schema: str, size: int = 512) -> DataFrame:
    """What ``compare`` yields for every ``size`` rows that follow one another in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= size:
                table = pa.Table.from_batches(held)
                full = len(table) - len(table) % size
                for at in range(0, full, size):
                    yield from _batches(compare(table.slice(at, size), table.slice(at, size), True), kind)
                held = table.slice(full).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from _batches(compare(table, table, True), kind)

    kind = schema_of(rows.sparkSession, schema)
    return rows.repartitionByRange(max(12, math.ceil(rows.count() / (4 * size))), *order).sortWithinPartitions(*order).mapInArrow(run, schema)


def open_with_all(rows: DataFrame, key: str, begin: Begin, schema: str, size: int = 8192) -> DataFrame:
    """What ``begin`` and what it returns yield for every two rows of which at least one has a true column ``open``.

    A task holds a part of the open rows and is given others slab by slab, all open ones before the closed ones; so a closed row is
    shuffled once for each part of the open rows. Two open rows of one part come in either order, others once; column ``_own``
    of the rows given says whether they are of the task's own part.
    """
    n = rows.filter("open").count()
    parts = max(math.ceil(n / size), min(6, math.ceil(n / 500)), 1)
    lanes = math.ceil(12 / parts)  # the rows given to a part are dealt to so many tasks
    at = lambda what, many: F.pmod(F.xxhash64(F.lit(what), key), F.lit(many)).cast("int")
    rows = rows.withColumn("_part", F.when(F.col("open"), at("part", parts)))
    held = rows.filter("open").withColumn("_to", F.col("_part")).withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    given = rows.withColumn("_to", F.explode(F.sequence(F.lit(0), F.coalesce("_part", F.lit(parts - 1))))).withColumn("_lane", at("lane", lanes))
    cell = (F.col("_to") * lanes + F.col("_lane")).cast("int").alias("_cell")
    own = [c for c in rows.columns if c not in ("open", "_part")]
    both = held.select(cell, F.lit(0).alias("_phase"), F.lit(True).alias("_own"), *own).unionByName(
        given.select(cell, F.when(F.col("open"), 1).otherwise(2).alias("_phase"), (F.col("_part").isNotNull() & (F.col("_part") == F.col("_to"))).alias("_own"), *own)
    )
    return both.repartitionById(parts * lanes, F.col("_cell")).sortWithinPartitions("_cell", "_phase").mapInArrow(_by_slab(begin, schema_of(rows.sparkSession, schema)), schema)


def _by_slab(begin: Begin, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, now, held = None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal step
            if held and now[1] == 0:
                step = begin(pa.Table.from_batches(held))
            elif held:
                table = pa.Table.from_batches(held)
                slab = max(64, SLAB // step.rows)
                for at in range(0, len(table), slab):
                    yield from _batches(step(table.slice(at, slab)), schema)
            held.clear()

        for batch in batches:
            cell, phase = (batch.column(c).to_numpy() for c in ("_cell", "_phase"))
            at = [0, *(np.flatnonzero(np.diff(cell) | np.diff(phase)) + 1), len(batch)]
            for start, end in zip(at, at[1:]):
                if end == start:
                    continue
                name = int(cell[start]), int(phase[start])
                if name != now or now[1] and sum(map(len, held)) >= SLAB // step.rows:
                    yield from done()
                now = name
                held.append(batch.slice(start, end - start))
        yield from done()

    return run


def _batches(found: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for columns in found:
        table = pa.table({f.name: pa.array(columns[f.name]) if isinstance(columns[f.name], np.ndarray) else columns[f.name] for f in schema}).cast(schema)
        yield from table.combine_chunks().to_batches(max_chunksize=50_000)


def schema_of(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _by_cell(compare: Compare, schema: pa.Schema):
    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(parts)
        left, right = cell.filter(cell["_left"]), cell.filter(cell["_right"])
        yield from _batches(compare(left, right, len(left) + len(right) > len(cell)), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            names = batch.column("_cell").dictionary_encode()
            codes = names.indices.to_numpy()
            at = [0, *(np.flatnonzero(np.diff(codes)) + 1), len(codes)]
            for start, end in zip(at, at[1:]):
                if end == start:
                    continue
                name = names.dictionary[int(codes[start])].as_py()
                if held and name != now:
                    yield from done(held)
                    held = []
                now = name
                held.append(batch.slice(start, end - start))
        if held:
            yield from done(held)

    return run


def sparse(count: np.ndarray | list[int], codes: np.ndarray, weights: np.ndarray | None = None):
    """(number of rows, row, code, weight) of features; ``count``: how many each row has."""
    count = np.asarray(count, dtype=np.int64)
    return len(count), np.repeat(np.arange(len(count)), count), codes, weights


def products(left, right, kind: str = "float64") -> Iterator[tuple[int, np.ndarray]]:
    """(first row, products): of each row of ``left`` with each of ``right`` (see ``sparse``), a slab of rows at a time.

    Features that many rows have go by a product of matrices, the others by their postings.
    """
    n_left, l_row, l_code, l_w = left
    n_right, r_row, r_code, r_w = right
    if not n_left or not n_right:
        return
    top = int(max(l_code.max(initial=0), r_code.max(initial=0))) + 1
    l_w = np.ones(len(l_code), kind) if l_w is None else l_w
    r_w = np.ones(len(r_code), kind) if r_w is None else r_w
    often = np.bincount(r_code, minlength=top)
    dense = np.flatnonzero(often > DENSE * n_right)
    place = np.full(top, -1)
    place[dense] = np.arange(len(dense))
    at = place[r_code]
    matrix = np.zeros((len(dense), n_right), kind)
    matrix[at[at >= 0], r_row[at >= 0]] = r_w[at >= 0]
    order = np.argsort(r_code, kind="stable")
    order = order[place[r_code[order]] < 0]
    p_row, p_w = r_row[order], r_w[order].astype(kind)
    begin = np.searchsorted(r_code[order], np.arange(top + 1))
    step = max(1, SLAB // n_right)
    bounds = np.searchsorted(l_row, np.arange(0, n_left + step, step))
    for slab, start in enumerate(range(0, n_left, step)):
        part = slice(bounds[slab], bounds[slab + 1])
        rows, codes, w = l_row[part] - start, l_code[part], l_w[part]
        mine = np.zeros((min(step, n_left - start), len(dense)), kind)
        at = place[codes]
        mine[rows[at >= 0], at[at >= 0]] = w[at >= 0]
        out = mine @ matrix
        rest = np.flatnonzero((at < 0) & (begin[codes + 1] > begin[codes]))
        rest = rest[np.argsort(codes[rest], kind="stable")]
        rows, codes, w = rows[rest], codes[rest], w[rest].astype(kind)
        ends = [*np.flatnonzero(np.diff(codes, prepend=-1)), len(codes)]
        for s, e in zip(ends, ends[1:]):
            own = slice(begin[codes[s]], begin[codes[s] + 1])
            out[rows[s:e, None], p_row[own]] += w[s:e, None] * p_w[own]
        yield start, out


class Forest:
    """Which pairs link rows that no pair before them linked. Rows are numbers below n; those of one label are linked from the start."""

    def __init__(self, n: int, labels: list | None = None):
        self.root = np.arange(n)
        if labels is not None:
            first: dict = {}
            self.root = np.array([first.setdefault(x, i) for i, x in enumerate(labels)], int)
        self._to: dict[int, int] = {}

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.root[i] != self.root[j]

    def fresh(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Positions of pairs that link what they all link."""
        a, b = self.root[i], self.root[j]
        open_ = np.flatnonzero(a != b)
        a, b = np.minimum(a[open_], b[open_]), np.maximum(a[open_], b[open_])
        _, once = np.unique(a * len(self.root) + b, return_index=True)
        kept = [at for at, x, y in zip(open_[once].tolist(), a[once].tolist(), b[once].tolist()) if self.join(x, y)]
        self.settle()
        return np.array(kept, dtype=int)

    def _find(self, x: int) -> int:
        x = int(self.root[x])
        while (y := self._to.get(x, x)) != x:
            self._to[x] = self._to.get(y, y)
            x = y
        return x

    def joined(self, i: int, j: int) -> bool:
        return self._find(i) == self._find(j)

    def join(self, i: int, j: int) -> bool:
        """Whether the pair links what was apart; ``root`` shows it after ``settle``."""
        x, y = self._find(i), self._find(j)
        if x != y:
            self._to[max(x, y)] = min(x, y)
        return x != y

    def settle(self) -> None:
        if self._to:
            lead = np.arange(len(self.root))
            lead[list(self._to)] = [self._find(x) for x in list(self._to)]
            self.root, self._to = lead[self.root], {}


class Letters:
    """Upper bounds of the gestalt ratio of many pairs at once: the blocks it matches are a common subsequence, so twice the length
    of the longest one over both lengths is no less. Texts over 64 letters are bounded by their lengths alone."""

    def __init__(self, left: list[str], right: list[str]):
        letters, row, at, size = _letters([*left, *right])
        self.n_left, self.n_right = size[: len(left)], size[len(left) :]
        many = int(letters.max(initial=-1)) + 1
        self.masks = np.zeros((len(left), many + 1), np.uint64)
        self.codes = np.full((max(1, min(64, self.n_right.max(initial=1))), len(right)), many)
        short = size[row] <= 64
        a, b = np.flatnonzero(short & (row < len(left))), np.flatnonzero(short & (row >= len(left)))
        np.bitwise_or.at(self.masks, (row[a], letters[a]), np.uint64(1) << at[a].astype(np.uint64))
        self.codes[at[b], row[b] - len(left)] = letters[b]

    def lengths(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.n_left[i], self.n_right[j]
        return 2.0 * np.minimum(a, b) / np.maximum(a + b, 1)

    def bound(self, i: np.ndarray, j: np.ndarray, least: float = 0.0) -> np.ndarray:
        """The bounds; of pairs whose lengths keep them below ``least``, by the lengths."""
        out = self.lengths(i, j)
        todo = np.flatnonzero((out >= least) & (out > 0) & (self.n_left[i] <= 64) & (self.n_right[j] <= 64))
        flat, wide = self.masks.ravel(), self.masks.shape[1]
        for s in range(0, len(todo), CHUNK):
            at = todo[s : s + CHUNK]
            a, b = i[at], j[at]
            base = a * wide
            row = np.full(len(at), ~np.uint64(0))
            for k in range(int(self.n_right[b].max())):
                hit = flat.take(self.codes[k].take(b) + base)
                hit &= row
                rest = row ^ hit
                row += hit
                row |= rest
            length = self.n_left[a].astype(np.uint64)
            mask = np.where(length >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(length, np.uint64(63))) - np.uint64(1))
            out[at] = 2.0 * np.bitwise_count(~row & mask) / (self.n_left[a] + self.n_right[b])
        return out


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the letter, text, place in it) of all letters of the texts, and the length of each text."""
    size = np.array([len(t) for t in texts], int)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.zeros(int(points.max(initial=0)) + 1, bool)
    known[points] = True
    letters = (np.cumsum(known) - 1)[points]
    row = np.repeat(np.arange(len(texts)), size)
    return letters, row, np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size), size


def most_alike(left: list[str], right: list[str], pieces: tuple[int, ...] = (1, 2)) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, upper bounds): of the gestalt ratio of each text of ``left`` with each of ``right``, a slab of rows at a time.

    What is matched, M letters of the S of both, is no more than the letters in common, each as often as both have it. Two blocks
    that follow one another have an unmatched letter between them, in one text at least, so there are S - 2M + 1 blocks at most, and
    3M - S - 1 pairs of letters in common at least. So no pair is missed, however few pieces it shares.
    """
    letters, row, at, size = _letters([*left, *right])
    size_a, size_b = size[: len(left)].astype("float32"), size[len(left) :].astype("float32")

    def common(n: int) -> Iterator[tuple[int, np.ndarray]]:
        begin = np.flatnonzero(at <= size[row] - n)
        many, piece = int(letters.max(initial=0)) + 1, letters[begin]
        for k in range(1, n):
            piece = piece * many + letters[begin + k]
        top = int(piece.max(initial=0)) + 1
        each, often = np.unique(row[begin] * top + piece, return_counts=True)
        nth = np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
        most = int(often.max(initial=1))
        codes = np.repeat(each % top, often) * most + nth  # a piece counts as often as both have it
        if top * most > SLAB:
            codes = np.unique(codes, return_inverse=True)[1]
        count = np.maximum(size - n + 1, 0)
        cut = int(count[: len(left)].sum())
        return products(sparse(count[: len(left)], codes[:cut]), sparse(count[len(left) :], codes[cut:]), "float32")

    for (start, out), *pairs in zip(*map(common, pieces)):
        both = size_a[start : start + len(out), None] + size_b
        for _, x in pairs:  # of two letters
            x += both
            x += 1
            x /= 3
            np.minimum(out, x, out=out)
        out *= 2
        out /= np.maximum(both, 1, out=both)
        yield start, out


def near(left: list[str], right: list[str], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): all texts whose gestalt ratio may be ``least`` or more, by ``most_alike``."""
    for start, most in most_alike(left, right):
        i, j = np.nonzero(most >= np.float32(least - 1e-5))
        yield i + start, j


def pieces_of(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, piece): the different pieces of n letters of each text, in order of the texts; a shorter text is one piece."""
    letters, row, at, size = _letters(texts)
    begin = np.flatnonzero(at <= size[row] - n)
    piece = letters[begin]
    for k in range(1, n):
        _, piece = np.unique(piece * (len(letters) + 1) + letters[begin + k], return_inverse=True)
    short = np.flatnonzero(size < n)
    whole: dict[str, int] = {}
    first = int(piece.max(initial=-1)) + 1
    piece = np.concatenate([piece, np.array([first + whole.setdefault(texts[t], len(whole)) for t in short.tolist()], int)])
    top = int(piece.max(initial=0)) + 1
    both = np.unique(np.concatenate([row[begin], short]) * top + piece)
    return both // top, both % top


def sharing(left: list[str], right: list[str], n: int, shared: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): texts of which the share of the longer one's pieces of n letters is common to both."""
    row, piece = pieces_of([*left, *right], n)
    size = np.bincount(row, minlength=len(left) + len(right))
    size_a, size_b = size[: len(left)], size[len(left) :]
    cut = int(size_a.sum())
    a, b = sparse(size_a, piece[:cut]), sparse(size_b, piece[cut:])
    for start, common in products(a, b, "float32"):
        size = size_a[start : start + len(common)]
        i, j = np.nonzero(common >= np.float32(0.99) * np.float32(shared) * size[:, None].astype("float32"))
        found = common[i, j] >= shared * np.maximum(size[i], size_b[j])
        yield i[found] + start, j[found]
