"""Resolution that a model arbitrates: likely duplicates, clusters, bridges between them, batched verdicts, decisions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import gestalt, lcs_ratio
from ..functions.text import json_part, normalize_name, strip, tuples
from ..scratch import Scratch
from .cells import Compare, Forest, Letters, in_cells, in_windows, most_alike, near, open_with_all, sharing
from .components import connected_components
from .graph import drop_common_aliases, drop_orphans, validate
from .resolve import ALIAS_LIKE, COMPATIBLE, CONTEXT, INCOMPATIBLE, alias_overlap, apply_redirects, canonical_merge, compared_names, resolve_redirects, similarity_groups
from .retrieval import tfidf_pairs

#: Entities that a model is asked about at once.
BATCH = 22
#: Letters of the pieces by which likely pairs are found, and the share of the longer one's pieces that a pair has in common.
PIECE, SHARED = 3, 1 / 3
#: Pairs of entities that are bounded or scored at once.
PAIRS = 50_000
#: Entities from which on neighbours in the order of names are compared before the rest is, and the words at which names are turned for it.
FEW, TURNS = 4096, (0, 2, -1)

#: prompts (key, prompt) -> (key, answer); see ``plans.providers.ask``
Ask = Callable[[DataFrame], DataFrame]


def _pieces(text: Column, n: int) -> Column:
    """The different pieces of n letters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n))))


def contained_pairs(rows: DataFrame, key: str, slug: str, block: str, least: int = 5) -> DataFrame:
    """(a, b): keys a < b of one block (null equals null) of which one slug contains the other, both of at least ``least`` letters.

    An index of pieces: each slug looks for the ones that hold its rarest piece, so a common beginning pairs nothing by
    itself; what is found is checked. No pair is missed.
    """
    known = rows.filter(F.length(slug) >= least).select(F.col(key).alias("k"), F.col(slug).alias("s"), F.coalesce(block, F.lit("\u0000")).alias("g")).distinct()
    held = known.select("k", "s", "g", F.explode(_pieces(F.col("s"), least)).alias("piece"))
    counted = held.join(held.groupBy("g", "piece").agg(F.count("*").alias("n")), ["g", "piece"])
    rarest = counted.groupBy("k", "s", "g").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    found = rarest.join(held.select(F.col("k").alias("k2"), F.col("s").alias("s2"), "g", "piece"), ["g", "piece"]).filter(F.col("s2").contains(F.col("s")) & (F.col("k") != F.col("k2")))
    return found.select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b")).distinct()


def likely_pairs(rows: DataFrame, key: str, text: str, block: str | None = None, shared: float = SHARED) -> DataFrame:
    """(a, b): keys a < b of one block whose texts have ``shared`` of the longer one's pieces of PIECE letters in common.

    Pieces are counted cell by cell, on the whole sets. Shorter texts count as one piece.
    """
    found = _compared(rows, key, text, block, _likely(shared), "likely")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def alike_pairs(rows: DataFrame, key: str, text: str, block: str | None = None, likeness: float = 0.75, links: bool = False, label: str | None = None) -> DataFrame:
    """(a, b): keys of one block whose texts are alike in letters (gestalt ratio, the text of the lesser key first), all of them; with
    ``links`` only so many as link the same keys, those of one ``label`` being linked already.

    Every two texts are bounded, by the letters they have in common and by their common subsequence; what may be alike is compared.
    """
    return _compared(rows, key, text, block, _alike(likeness, links, label is not None), "alike", label)


def _compared(rows: DataFrame, key: str, text: str, block: str | None, compare: Compare, name: str, label: str | None = None) -> DataFrame:
    named = [F.col(label).alias("label")] if label else []
    given = rows.filter((F.col(text) != "") & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), (F.coalesce(block, F.lit("\u0000")) if block else F.lit("")).alias("g"), *named).distinct()
    given = Scratch(rows.sparkSession, name).keep(given, "texts")
    kind = dict(given.dtypes)["k"]
    return in_cells(given, "k", "g", compare, f"a {kind}, b {kind}").filter("a <> b")


def _likely(shared: float) -> Compare:
    def run(left: pa.Table, right: pa.Table, same: bool) -> Iterator[dict]:
        for i, j in sharing(left["t"].to_pylist(), right["t"].to_pylist(), PIECE, shared):
            if same:
                i, j = i[j > i], j[j > i]
            yield {"a": left["k"].take(pa.array(i)), "b": right["k"].take(pa.array(j))}

    return run


def _open(left: list, right: list, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of left, rows of right) to be compared if two of the commonest label need not be: each two others once, of the same rows
    some in either order."""
    most = Counter(left + right).most_common(1)
    a, b = (np.array([x != most[0][0] for x in side], bool) for side in (left, right))
    yield np.flatnonzero(a), np.arange(len(b))
    if not same:
        yield np.flatnonzero(~a), np.flatnonzero(b)


def _alike(likeness: float, links: bool, labelled: bool) -> Compare:
    def run(left: pa.Table, right: pa.Table, same: bool) -> Iterator[dict]:
        texts = left["t"].to_pylist(), right["t"].to_pylist()
        keys = [t["k"].to_pandas().to_numpy() for t in (left, right)]
        labels = [t["label"].to_pylist() for t in (left, right)] if labelled else None
        shift = 0 if same else len(left)
        forest = Forest(len(right) + shift, labels and (labels[0] if same else labels[0] + labels[1])) if links else None
        letters = Letters(*texts)
        whole = np.arange(len(left)), np.arange(len(right))
        for rows_a, rows_b in _open(*labels, same) if labels and links else [whole]:
            twice = np.zeros(len(right), bool)
            if same:
                twice[rows_a] = True
            for i, j in near([texts[0][n] for n in rows_a.tolist()], [texts[1][n] for n in rows_b.tolist()], likeness):
                i, j = rows_a[i], rows_b[j]
                if same:  # two rows that are both compared with all come in either order
                    once = (j > i) | ~twice[j]
                    i, j = i[once], j[once]
                if forest:
                    apart = forest.apart(i, j + shift)
                    i, j = i[apart], j[apart]
                alike = letters.bound(i, j, likeness)
                order = np.argsort(-alike, kind="stable")
                order = order[alike[order] >= likeness]
                i, j = i[order], j[order]
                turned = keys[0][i] > keys[1][j]
                kept = np.zeros(len(i), bool)
                for n, (x, y, t) in enumerate(zip(i.tolist(), j.tolist(), turned.tolist())):
                    if forest and forest.joined(x, y + shift):
                        continue
                    a, b = texts[0][x], texts[1][y]
                    kept[n] = gestalt(b, a) >= likeness if t else gestalt(a, b) >= likeness
                    if forest and kept[n]:
                        forest.join(x, y + shift)
                if forest:
                    forest.settle()
                i, j = i[kept], j[kept]
                yield {"a": left["k"].take(pa.array(i)), "b": right["k"].take(pa.array(j))}

    return run


def hybrid_edges(entities: DataFrame, cosine: float = 0.3, likeness: float = 0.75, links: bool = False) -> DataFrame:
    """(a, b): ids of one category (null equals null) that are alike in words (TF-IDF cosine of title and description), of which
    one slug contains the other, or whose slugs are alike in letters (gestalt ratio).

    entities: id, category, slug, title, description. The union of three joins, of all pairs each. With ``links`` only so many as
    link the same ids, some more than once: what the first two joins link is not compared in letters.
    """
    e = entities.select("id", F.coalesce("category", F.lit("\u0000")).alias("category"), F.coalesce("slug", F.lit("")).alias("slug"), F.concat_ws(" ", "title", F.translate("description", "|", " ")).alias("t"))
    scratch = Scratch(entities.sparkSession, "hybrid")
    e = scratch.keep(e, "entities")
    found = tfidf_pairs(e, "id", "t", cosine, "category", links=links).select("a", "b").unionByName(contained_pairs(e, "id", "slug", "category"))
    if links:
        found = scratch.keep(found, "found")
        groups = connected_components(found, "a", "b").select(F.col("node").alias("id"), "component")
        e = e.join(groups, "id", "left").withColumn("label", F.coalesce("component", "id"))
    letters = alike_pairs(e, "id", "slug", "category", likeness, links, "label" if links else None).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = found.unionByName(letters)
    return found if links else found.distinct()


def clusters_of(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, cluster): the connected groups of the edges (a, b), named by their least id; an id without edge is its own."""
    groups = connected_components(edges, "a", "b")
    return entities.select("id").distinct().join(groups, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("cluster"))


def representatives(entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, id, members): of each cluster the entity of the longest title, then the longest description, then the least id."""
    rows = entities.join(clusters, "id")
    rank = F.struct(F.length(F.coalesce("title", F.lit(""))), F.length(F.coalesce("description", F.lit(""))))
    best = rows.groupBy("cluster").agg(F.max(rank).alias("rank"), F.countDistinct("id").alias("members"))
    return rows.select("cluster", "id", rank.alias("rank")).join(best, ["cluster", "rank"]).groupBy("cluster").agg(F.min("id").alias("id"), F.max("members").alias("members"))


def numbered(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """batch and idx: rows of one group in order, ``size`` a batch, counted from 0.

    The place is taken from counts of hash buckets and a count within the bucket, so a group of any size is numbered by many
    tasks; the order is that of the buckets, then of ``order``.
    """
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(256)).cast("int"))
    sums = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    at = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)) - 1
    placed = rows.withColumn("_at", at).join(sums, [*by, "_bucket"]).withColumn("_at", F.col("_before") + F.col("_at"))
    return placed.withColumn("batch", F.floor(F.col("_at") / size).cast("int")).withColumn("idx", (F.col("_at") % size).cast("int")).drop("_bucket", "_before", "_at")


def _listed(rows: DataFrame, by: list[str], line: Column, head: str) -> DataFrame:
    """(key, *by, batch, members, prompt): one prompt a batch; a batch is bounded, so is the list."""
    lists = rows.groupBy(*by, "batch").agg(F.array_sort(F.collect_list(F.struct("idx", "id", line.alias("line")))).alias("members"))
    text = F.concat(F.lit(head + "\n"), F.array_join(F.transform("members", lambda m: F.concat(F.lit("[#"), m["idx"].cast("string"), F.lit("] "), m["line"])), "\n"))
    return lists.withColumn("prompt", text).withColumn("key", F.concat_ws("|", *by, F.col("batch").cast("string")))


def bridges(entities: DataFrame, clusters: DataFrame, ask: Ask, size: int = 200) -> DataFrame:
    """(a, b): clusters that the model names together, from answers [[i, j, ...], ...] over the titles of the representatives of a
    category, ``size`` a prompt. Numbers that are none of the prompt's, and answers that cannot be read, name nothing."""
    best = representatives(entities, clusters).drop("members").join(entities.select("id", "title", F.coalesce("category", F.lit("")).alias("category")).dropDuplicates(["id"]), "id")
    asked = _listed(numbered(best, ["category"], ["id"], size), ["category"], F.coalesce("title", F.lit("")), "BRIDGES").filter(F.size("members") > 1)
    told = ask(asked.select("key", "prompt")).select("key", F.explode(F.from_json(json_part(F.col("answer")), "array<array<int>>")).alias("named"))
    ids = told.join(asked.select("key", "members"), "key").select(F.filter(F.transform("named", lambda i: F.get(F.filter("members", lambda m: m["idx"] == i), F.lit(0))["id"]), lambda x: x.isNotNull()).alias("ids"))
    pairs = ids.filter("size(ids) > 1").select(F.explode(F.arrays_zip(F.slice("ids", 1, F.size("ids") - 1).alias("x"), F.slice("ids", 2, F.size("ids") - 1).alias("y"))).alias("p"))
    rows = pairs.select(F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    to = clusters.select("id", "cluster")
    rows = rows.join(to.select(F.col("id").alias("x"), F.col("cluster").alias("a")), "x").join(to.select(F.col("id").alias("y"), F.col("cluster").alias("b")), "y")
    return rows.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def merge_clusters(clusters: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cluster): clusters that links (a, b) name together become one, transitively, named by the least."""
    groups = connected_components(links, "a", "b").select(F.col("node").alias("cluster"), F.col("component").alias("_to"))
    return clusters.join(groups, "cluster", "left").select("id", F.coalesce("_to", "cluster").alias("cluster"))


def merge_maps(first: DataFrame, then: DataFrame) -> DataFrame:
    """(source, target): both redirect maps as one, the later winning for a source that both have, every chain followed to its end.

    Cycles go to their least member, whatever the order of the rows.
    """
    both = first.select("source", "target").join(then.select("source"), "source", "left_anti").unionByName(then.select("source", "target"))
    return resolve_redirects(both.filter("source <> target"))


def merge_verdicts(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """(source, target): ids of records MERGE i j, i going into j; brackets and # around a number are dropped, unknown numbers
    and a number with itself name nothing. A source that is named twice goes to the last."""
    number = lambda c: F.regexp_replace(c, r"[\[\]#\s]", "").try_cast("int")
    records = answers.select("key", F.posexplode(tuples(F.col("answer"))).alias("pos", "r")).filter((F.size("r") >= 3) & (F.lower(F.get("r", F.lit(0))) == "merge"))
    named = records.select("key", "pos", number(F.get("r", F.lit(1))).alias("i"), number(F.get("r", F.lit(2))).alias("j")).filter("i <> j").join(asked.select("key", "members"), "key")
    of = lambda i: F.get(F.filter("members", lambda m: m["idx"] == F.col(i)), F.lit(0))["id"]
    pairs = named.select(of("i").alias("source"), of("j").alias("target"), "pos").filter("source IS NOT NULL AND target IS NOT NULL")
    return pairs.groupBy("source").agg(F.max_by("target", F.struct("pos", "target")).alias("target"))


def pyramid(entities: DataFrame, clusters: DataFrame, ask: Ask, size: int = BATCH, most_rounds: int = 30) -> DataFrame:
    """(source, target): merges within clusters. A cluster over ``size`` is asked about in batches; those merged away leave it and the rest
    is asked about again, until it fits one batch or a round merges nothing. Chains are followed to their ends.

    entities: id, title, type, description. Each round is written; the largest cluster shrinks, so rounds grow with its logarithm.
    """
    spark = entities.sparkSession
    scratch = Scratch(spark, "pyramid")
    snippet = F.substring(strip(F.translate(F.coalesce("description", F.lit("")), "\n", " ")), 1, 250)
    line = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit(" (Type: "), F.coalesce("type", F.lit("")), F.lit("): "), snippet)
    told = entities.select("id", line.alias("line")).dropDuplicates(["id"])
    pool = scratch.keep(clusters.join(told, "id").select("id", "cluster", "line"), "pool0")
    merged: DataFrame | None = None
    for k in range(most_rounds):
        sizes = pool.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1")
        open_ = pool.join(sizes, "cluster")
        asked = scratch.keep(_listed(numbered(open_, ["cluster"], ["id"], size), ["cluster"], F.col("line"), "RESOLVE").filter(F.size("members") > 1), f"asked{k}")
        now = scratch.keep(merge_verdicts(ask(asked.select("key", "prompt")), asked), f"merged{k}")
        if now.isEmpty():
            break
        merged = now if merged is None else merged.unionByName(now)
        # Those that fitted one batch are done; of the others the merged ones go. One that is a source stays out for good.
        large = sizes.filter(F.col("n") > size).select("cluster")
        pool = scratch.keep(pool.join(large, "cluster", "left_semi").join(now.select(F.col("source").alias("id")), "id", "left_anti"), f"pool{k + 1}")
    if merged is None:
        return spark.createDataFrame([], "source string, target string")
    return resolve_redirects(merged)


def choose_anchor(entities: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, canonical_id, review_status): the candidate that an answer {choice: slug} names, LLM_VALIDATED; for NEW_ENTITY, a slug that is no
    candidate, an answer that cannot be read or none at all NOT_KNOWN without an id.

    entities: id, candidates (array of struct slug, id); answers: id, answer.
    """
    said = answers.select("id", F.get_json_object(json_part(F.col("answer")), "$.choice").alias("choice")).dropDuplicates(["id"])
    rows = entities.join(said, "id", "left").withColumn("canonical_id", F.get(F.filter("candidates", lambda c: c["slug"] == F.col("choice")), F.lit(0))["id"])
    return rows.select("id", "canonical_id", F.when(F.col("canonical_id").isNotNull(), "LLM_VALIDATED").otherwise("NOT_KNOWN").alias("review_status"))


def resolve_by_model(entities: DataFrame, ask: Ask) -> DataFrame:
    """(source, target): hybrid clusters of the entities that no entry anchors, joined by the model's bridges, and merged by its verdicts.

    entities: id, category, slug, title, type, description, canonical_id.
    """
    free = entities.filter("coalesce(canonical_id, '') = ''").dropDuplicates(["id"])
    clusters = Scratch(entities.sparkSession, "arbitration").keep(clusters_of(hybrid_edges(free, links=True), free), "clusters")
    return pyramid(free, merge_clusters(clusters, bridges(free, clusters, ask)), ask)


# Duplicates of one run, by scores of pairs and a model's actions


def scored_pairs(entities: DataFrame, least: float = 0.0, links: bool = False, few: int = FEW, shared: float | None = SHARED) -> DataFrame:
    """(a, b, score) of the pairs of entities with at least the score: all of them if ``shared`` is None, else those with two names or
    aliases that have this share of the longer one's pieces in common.

    entities: id, name, aliases, type, context_description; see ``pair_scores``. Every pair is bounded, by the letters that names, aliases
    and contexts have in common, and scored if it may reach the score, cell by cell; with ``links`` only so many come as link the same entities: those of ``few``
    entities on are first compared with their neighbours in the order of their names, turned at several words. Two of the largest
    group that this gives are linked, so only pairs with an entity outside of it are left, and all of these are compared.
    """
    scratch = Scratch(entities.sparkSession, "scored")
    rows = entities.filter("id IS NOT NULL").select("id", "name", F.array_sort(F.array_distinct(compared_names(F.col("name"), F.col("aliases")))).alias("names"), "type", F.substring(F.coalesce("context_description", F.lit("")), 1, CONTEXT).alias("head"))
    rows = scratch.keep(rows, "rows")
    kind = dict(rows.dtypes)["id"]
    schema = f"a {kind}, b {kind}, score double"
    if not links:
        found = in_cells(rows.withColumn("g", F.lit("")), "id", "g", _scores(least, False, shared), schema, 2048)
    elif rows.count() < few:
        found = open_with_all(rows.withColumns({"label": F.col("id"), "open": F.lit(True)}), "id", _links(least, shared), schema)
    else:
        words = F.split(F.coalesce(F.get("names", F.lit(0)), F.lit("")), " ")
        near = None
        for k in TURNS:
            head = F.slice(words, 1, F.greatest(F.size(words) + k, F.lit(0)) if k < 0 else F.lit(k))
            turned = F.concat_ws(" ", F.slice(words, F.size(head) + 1, F.size(words)), head)
            some = in_windows(rows, [turned, F.col("id")], _scores(least, True, shared), schema)
            near = some if near is None else near.unionByName(some)
        near = scratch.keep(near, "near")
        groups = scratch.keep(connected_components(near, "a", "b"), "groups")
        largest = groups.groupBy("component").agg(F.count("*").alias("n")).agg(F.max_by("component", F.struct("n", "component")).alias("component"), F.lit(True).alias("largest"))
        known = rows.join(groups.withColumnRenamed("node", "id"), "id", "left").join(F.broadcast(largest), "component", "left")  # one row
        known = scratch.keep(known.select(*rows.columns, F.coalesce("component", "id").alias("label"), F.col("largest").isNull().alias("open")), "known")
        found = near.unionByName(open_with_all(known, "id", _links(least, shared), schema))
    return found.select("a", "b", F.round("score", 9).alias("score")).filter(F.col("score") >= least)


def _scores(least: float, links: bool, shared: float | None):
    def run(left: pa.Table, right: pa.Table, same: bool) -> Iterator[dict]:
        cell = _Cell(left, right, least - 5e-10, shared)  # rounded to nine places later
        forest = Forest(len(left) if same else len(left) + len(right)) if links else None
        yield from _scored(cell, (lambda i, j: j > i) if same else (lambda i, j: np.ones(len(i), bool)), forest, 0 if same else len(left))

    return run


def _links(least: float, shared: float | None):
    """For ``open_with_all``: links between rows that neither their labels nor the links before them join."""

    def begin(left: pa.Table):
        return _Linking(left, least - 5e-10, shared)

    return begin


class _Linking:
    """Links of a task's rows with others that it is given. The labels of linked rows become one, so that a row is no longer compared
    with those it is joined to already: neither with closed rows, once it is in their group."""

    def __init__(self, left: pa.Table, least: float, shared: float | None):
        self.left, self.least, self.shared, self.rows = left, least, shared, len(left)
        self.labels, self.to = left["label"].to_pylist(), {}

    def _now(self, label):
        while (to := self.to.get(label, label)) != label:
            self.to[label] = self.to.get(to, to)
            label = to
        return label

    def __call__(self, right: pa.Table) -> Iterator[dict]:
        others = [self._now(x) for x in right["label"].to_pylist()]
        self.labels = [self._now(x) for x in self.labels]
        if len(only := set(others)) == 1:  # rows in the group of all that are given are joined to them
            apart = np.array([x not in only for x in self.labels], bool)
        else:
            apart = np.ones(len(self.labels), bool)
        at = np.flatnonzero(apart)
        if not len(at):
            return
        cell = _Cell(self.left.take(pa.array(at)), right, self.least, self.shared)
        labels = [self.labels[n] for n in at.tolist()] + others
        forest = Forest(len(labels), labels)
        own = right["_own"].to_numpy()
        once = lambda i, j: (~own[j] | (cell.ids_left[i] < cell.ids_right[j])) & forest.apart(i, j + len(at))
        for found in _scored(cell, once, forest, len(at)):
            yield found
        for n, root in enumerate(forest.root.tolist()):
            x, y = self._now(labels[n]), self._now(labels[root])
            if x != y:
                self.to[x] = y


def _scored(cell: _Cell, keep: Callable, forest: Forest | None, shift: int) -> Iterator[dict]:
    """The scores of pairs of a cell that ``keep`` is true of; with a forest, whose rows on the right begin at ``shift``, of those that link."""
    i, j, most, but_head, alias = cell.found(keep)
    ahead = cell.ids_left[i] < cell.ids_right[j]  # the order in which two entities are compared
    for turned in (False, True):
        todo = np.flatnonzero((ahead != turned) & (cell.ids_left[i] != cell.ids_right[j]))
        todo = todo[np.argsort(-most[todo], kind="stable")]
        side = cell.turned() if turned else cell
        for s in range(0, len(todo), PAIRS):
            at = todo[s : s + PAIRS]
            x, y = i[at], j[at] + shift
            a, b = (j[at], i[at]) if turned else (i[at], j[at])
            scores = np.full(len(at), -1.0)
            if forest:
                open_ = forest.apart(x, y)
                for n in np.flatnonzero(open_).tolist():
                    if forest.joined(x[n], y[n]):
                        continue
                    scores[n] = side.score(int(a[n]), int(b[n]), alias[at[n]], but_head[at[n]])
                    if scores[n] >= side.least:
                        forest.join(x[n], y[n])
                forest.settle()
            else:
                scores[:] = [side.score(*of) for of in zip(a.tolist(), b.tolist(), alias[at].tolist(), but_head[at].tolist())]
            kept = scores >= side.least
            yield {"a": side.left["id"].take(pa.array(a[kept])), "b": side.right["id"].take(pa.array(b[kept])), "score": scores[kept]}


class _Cell:
    """The scores of entities of one side with those of another, and what they are at most."""

    def __init__(self, left: pa.Table, right: pa.Table, least: float, shared: float | None):
        self.left, self.right, self.least, self.shared = left, right, least, shared
        side = lambda t: (t["id"].to_pandas().to_numpy(), t["name"].to_pylist(), t["names"].to_pylist(), t["type"].to_pylist(), t["head"].to_pylist())
        self._fill(side(left), side(right))

    def _fill(self, a, b) -> None:
        (self.ids_left, self.name_a, self.names_a, self.type_a, self.head_a), (self.ids_right, self.name_b, self.names_b, self.type_b, self.head_b) = a, b
        self.sides = a, b

    def turned(self) -> _Cell:
        other = object.__new__(_Cell)
        other.left, other.right, other.least, other.shared = self.right, self.left, self.least, self.shared
        other._fill(*self.sides[::-1])
        return other

    def likely(self) -> np.ndarray:
        """Which entities have a likely pair among their names."""
        out = np.zeros((len(self.name_a), len(self.name_b)), bool)
        (of_a, texts_a), (of_b, texts_b) = _flat(self.names_a), _flat(self.names_b)
        for i, j in sharing(texts_a, texts_b, PIECE, self.shared):
            out[of_a[i], of_b[j]] = True
        return out

    def aliases(self, keep: Callable) -> np.ndarray:
        """How many pairs of their names may be alike, 2 at most, of the entities that ``keep`` is true of."""
        out = np.zeros((len(self.name_a), len(self.name_b)), np.uint8)
        flat = out.ravel()
        (of_a, texts_a), (of_b, texts_b) = _flat(self.names_a), _flat(self.names_b)
        letters = Letters(texts_a, texts_b)
        for x, y in near(texts_a, texts_b, ALIAS_LIKE):
            kept = keep(of_a[x], of_b[y])
            x, y = x[kept], y[kept]
            alike = letters.bound(x, y, ALIAS_LIKE) >= ALIAS_LIKE
            at, n = np.unique(of_a[x[alike]] * len(self.name_b) + of_b[y[alike]], return_counts=True)
            flat[at] = np.minimum(flat[at] + n, 2)
        return out

    def found(self, keep: Callable) -> tuple[np.ndarray, ...]:
        """(i, j, most, most but for the heads, most of the aliases): of the pairs that ``keep`` is true of and that may have the score, what
        they have at most."""
        if self.shared is not None:
            given, likely = keep, self.likely()
            keep = lambda i, j: likely[i, j] & given(i, j)
        alias = self.aliases(keep)
        kinds = {t: n for n, t in enumerate(dict.fromkeys((*self.type_a, *self.type_b)))}
        table = np.array([[0.1 * _compatible(x, y) for y in kinds] for x in kinds], "float32")
        kind_a, kind_b = (np.array([kinds[t] for t in x], int) for x in (self.type_a, self.type_b))
        names = [t or "" for t in self.name_a], [t or "" for t in self.name_b]
        letters, counts = Letters(*names), np.array([0, 0.21, 0.3], "float32")
        out = []
        for (start, name), (_, head) in zip(most_alike(*names, (1,)), most_alike(self.head_a, self.head_b, (1,))):
            own = slice(start, start + len(name))
            rest = table[kind_a[own]][:, kind_b]
            rest += counts[alias[own]]
            name *= 0.5
            head *= 0.1
            name += head
            name += rest
            i, j = np.nonzero(name >= np.float32(self.least - 1e-5))
            kept = keep(i + start, j)
            i, j = i[kept], j[kept]
            rest, head = rest[i, j].astype(float), head[i, j].astype(float)
            i += start
            rest += 0.5 * letters.bound(i, j) + 1e-5  # bounds are summed in single precision
            kept = rest + head >= self.least
            i, j, rest = i[kept], j[kept], rest[kept]
            out.append((i, j, rest + head[kept], rest, counts[alias[i, j]].astype(float)))
        return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, int), np.zeros(0, int), *np.zeros((3, 0)))

    def score(self, i: int, j: int, alias_most: float, but_head: float) -> float:
        """The score; -1 as soon as it cannot reach ``least``. alias_most, but_head: what the aliases, and all but the heads, add at most."""
        head = 0.1 * lcs_ratio(self.head_a[i], self.head_b[j])
        if but_head + head < self.least - 1e-9:
            return -1.0
        kind = 0.1 * _compatible(self.type_a[i], self.type_b[j])
        name = 0.5 * gestalt(self.name_a[i], self.name_b[j])
        if name + alias_most + kind + head < self.least - 1e-6:
            return -1.0
        alias = 0.3 * alias_overlap(self.names_a[i], self.names_b[j]) if alias_most else 0.0
        if name + alias + kind + head < self.least - 1e-9:
            return -1.0
        return name + alias + kind + 0.1 * gestalt(self.head_a[i], self.head_b[j])


def _flat(names: list[list[str]]) -> tuple[np.ndarray, list[str]]:
    """(row, name) of all names."""
    return np.repeat(np.arange(len(names)), [len(n) for n in names]), [t for n in names for t in n]


def _compatible(a: str | None, b: str | None) -> float:
    """See ``type_compatibility``."""
    if a is None or b is None:
        return 0.3
    pair = (a, b)
    return 1.0 if a == b else 0.7 if pair in COMPATIBLE or pair[::-1] in COMPATIBLE else 0.1 if pair in INCOMPATIBLE or pair[::-1] in INCOMPATIBLE else 0.3


def threshold_groups(entities: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, grp): connected groups of pairs with at least the score; entities alike to none are groups of their own."""
    return similarity_groups(scored_pairs(entities, least, links=True, shared=None), entities.select(F.col("id").alias("node")), least).withColumnRenamed("node", "id")


def actions(answers: DataFrame) -> DataFrame:
    """(grp, action, entity_ids, canonical_name, canonical_type) of answers {actions: [{type: merge, entity_ids, canonical_name, ...}]}; others than
    merges, and those without a name, are left out."""
    shape = "actions array<struct<type: string, entity_ids: array<string>, canonical_name: string, canonical_type: string>>"
    rows = answers.select("grp", F.posexplode(F.from_json(json_part(F.col("answer")), shape)["actions"]).alias("action", "x")).select("grp", "action", "x.*").filter("type = 'merge' AND canonical_name IS NOT NULL")
    return rows.withColumn("entity_ids", F.filter(F.transform("entity_ids", lambda i: i.try_cast("int")), lambda i: i.isNotNull())).drop("type")


def apply_decisions(members: DataFrame, decided: DataFrame, priority: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(entities, moved): the entities after the merges, and (source, target) of normalised names.

    members: grp, idx (place in its group), id, name, normalized_name, type, aliases, context_description, confidence; decided:
    see ``actions``. A merge of two or more known places gives one entity, with the id of its least place, the given name and
    type; the others of it go. A place in several merges counts in the first.
    """
    named = decided.select("grp", "action", "canonical_name", "canonical_type", F.explode("entity_ids").alias("idx")).groupBy("grp", "idx").agg(
        F.min_by(F.struct("action", "canonical_name", "canonical_type"), "action").alias("d")
    )
    rows = members.join(named.select("grp", "idx", "d.*"), ["grp", "idx"])
    several = rows.groupBy("grp", "action").agg(F.count("*").alias("n"), F.min_by("id", "idx").alias("keep")).filter("n > 1")
    rows = rows.join(several.select("grp", "action", "keep"), ["grp", "action"])
    merged = canonical_merge(rows, "keep", priority).drop("name", "type", "normalized_name", "_rank")
    given = rows.groupBy("keep").agg(F.first("canonical_name").alias("name"), F.first("canonical_type").alias("_given"), F.max_by("type", F.struct(_rank(priority), F.col("type"))).alias("_type"))
    made = merged.join(given, "keep").select(F.col("keep").alias("id"), "name", normalize_name(F.col("name")).alias("normalized_name"), F.coalesce("_given", "_type").alias("type"), "aliases", "context_description", "confidence")
    rest = members.join(rows.select("id"), "id", "left_anti").select(*made.columns)
    moved = rows.select(F.col("normalized_name").alias("source"), normalize_name(F.col("canonical_name")).alias("target")).filter("source IS NOT NULL")
    return rest.unionByName(made), moved.groupBy("source").agg(F.min("target").alias("target"))


def _rank(priority: dict[str, int]) -> Column:
    if not priority:
        return F.lit(0)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col("type")), F.lit(0))


def deduplicate(entities: DataFrame, relations: DataFrame, ask: Ask, rules: DataFrame, priority: dict[str, int], size: int = BATCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, report): groups by score, arbitrated by the model, decisions applied, relations rewired, aliases that many share
    dropped, the counts a type checked against the rules, and relations without a known end left out.

    A group over ``size`` is asked about in batches.
    """
    scratch = Scratch(entities.sparkSession, "deduplicate")
    groups = scratch.keep(entities.join(threshold_groups(entities), "id"), "groups")
    placed = numbered(groups, ["grp"], ["id"], size).withColumn("grp", F.concat_ws("|", "grp", F.col("batch").cast("string")))
    line = F.concat_ws(" | ", F.concat(F.lit("Name: "), "name"), F.concat(F.lit("Type: "), "type"), F.concat(F.lit("Aliases: "), F.array_join("aliases", ", ")), F.concat(F.lit("Context: "), F.substring("context_description", 1, 120)))
    placed = scratch.keep(placed, "placed")
    asked = _listed(placed, ["grp"], line, "ARBITRATE").filter(F.size("members") > 1)
    answers = ask(asked.select(F.col("grp").alias("key"), "prompt")).select(F.col("key").alias("grp"), "answer")
    decided = scratch.keep(actions(answers), "decided")  # read by both results; the model is asked once
    kept, moved = apply_decisions(placed, decided, priority)
    kept, moved = scratch.keep(kept, "kept"), scratch.keep(moved, "moved")
    scratch.drop("groups", "placed", "decided")
    clean = scratch.keep(drop_common_aliases(kept, "id"), "clean")
    scratch.drop("kept")
    wired = apply_redirects(relations, resolve_redirects(moved.filter("source <> target")), "source", "target")
    return clean, drop_orphans(wired, clean, "source", "target", "normalized_name"), validate(clean, rules)
