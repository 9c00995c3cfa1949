import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from lexigraph.operators import arbitration as ar
from lexigraph.operators import cells as ce
from lexigraph.operators import resolve as rs
from lexigraph.operators import retrieval as rt
from lexigraph.operators.components import connected_components


def shuffled(spark):
    """Bytes that shuffles have written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def groups(df):
    return {tuple(r) for r in connected_components(df, "a", "b").collect()}


def test_tfidf_pairs_are_not_shuffled_and_links_link_the_same(spark):
    rng = random.Random(3)
    rows = [(f"k{i:04}", f"of common {rng.randrange(150)} w{rng.randrange(150)} common", "x" if i % 3 else "y") for i in range(900)]
    df = spark.createDataFrame(rows, "id string, t string, type string")
    before = shuffled(spark)
    got = {(r["a"], r["b"]) for r in rt.tfidf_pairs(df, "id", "t", 0.6, "type").collect()}
    assert shuffled(spark) - before < 600_000  # 240,000 pairs share the common word
    assert got and all(a < b for a, b in got)
    links = rt.tfidf_pairs(df, "id", "t", 0.6, "type", links=True)
    assert {(r["a"], r["b"]) for r in links.collect()} < got
    assert groups(links) == groups(spark.createDataFrame(list(got), "a string, b string"))


def test_products_and_bounds_against_all_pairs():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd é") for _ in range(rng.choice([0, 1, 2, 9, 30, 64, 70]))) for _ in range(60)]
    pieces = lambda s: {s[i : i + 3] for i in range(len(s) - 2)} or {s}
    got = {(i, j) for a, b in ce.sharing(texts, texts[::-1], 3, 1 / 3) for i, j in zip(a.tolist(), b.tolist())}
    assert got == {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts[::-1]) if 3 * len(pieces(x) & pieces(y)) >= max(len(pieces(x)), len(pieces(y)))}
    i, j = (x.ravel() for x in np.indices((60, 60)))
    bounds = ce.Letters(texts, texts).bound(i, j)
    assert all(u >= SequenceMatcher(None, texts[a], texts[b]).ratio() or not texts[a] for a, b, u in zip(i, j, bounds))


def test_links_of_a_giant_group_are_few(spark):
    df = spark.createDataFrame([(f"k{i:04}", f"the same words {i % 7}", "x") for i in range(1200)], "id string, t string, type string")
    before = shuffled(spark)
    got = rs.similarity_groups(rt.tfidf_pairs(df, "id", "t", 0.3, "type", links=True), df.select(df["id"].alias("node")), 0.3).collect()
    assert shuffled(spark) - before < 3_000_000  # 719,400 pairs are alike
    assert len(got) == 1200 and {r["grp"] for r in got} == {"k0000"}


def test_scored_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    part = lambda: "".join(rng.choice("bdfghjk") + rng.choice("aiu") for _ in range(3))
    pool = [part() for _ in range(12)]
    text = lambda: rng.choice([" ibn ", " "]).join(rng.sample(pool, 2)) + rng.choice(["", " al-" + part(), rng.choice("xyz")])
    rows = [(i, text() if i % 9 else None, rng.choice([None, "Person", "Child", "AhlBayt"]), rng.choice([None, [], [text(), None, ""], [text(), text(), text()]]), rng.choice([None, "told of old", text() * 9])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, name string, type string, aliases array<string>, context_description string")
    ends = {e: df.select([F.col(c).alias(f"{to}_{e}") for c, to in (("id", "id"), ("name", "name"), ("type", "type"), ("aliases", "aliases"), ("context_description", "context"))]) for e in "ab"}
    names = {r["id"]: set(r["n"]) for r in df.select("id", rs.compared_names(F.col("name"), F.col("aliases")).alias("n")).collect()}
    pieces = lambda s: {s[i : i + 3] for i in range(len(s) - 2)} or {s}
    likely = lambda a, b: any(3 * len(pieces(x) & pieces(y)) >= max(len(pieces(x)), len(pieces(y))) for x in names[a] for y in names[b])
    scored = rs.pair_scores(ends["a"].join(ends["b"], F.col("id_a") < F.col("id_b"))).collect()
    want = {(r["id_a"], r["id_b"]): round(r["score"], 9) for r in scored if likely(r["id_a"], r["id_b"])}
    for least in (0.0, 0.5):
        before = shuffled(spark)
        got = {(r["a"], r["b"]): r["score"] for r in ar.scored_pairs(df, least).collect()}
        assert shuffled(spark) - before < 200_000
        assert got == {k: v for k, v in want.items() if v >= least} and got
    assert groups(ar.scored_pairs(df, 0.5, links=True)) == groups(spark.createDataFrame([k for k, v in want.items() if v >= 0.5], "a long, b long"))


def test_alike_pairs_and_hybrid_links(spark):
    rng = random.Random(6)
    part = lambda: "".join(rng.choice("BDFGH") + rng.choice("AIU") for _ in range(3))
    pool = [part() for _ in range(8)]
    rows = [(f"k{i:03}", "_".join(rng.sample(pool, 2)) + rng.choice(["", "X", "_" + part()]), rng.choice([None, "c"])) for i in range(150)]
    df = spark.createDataFrame(rows, "id string, slug string, category string")
    pieces = lambda s: {s[i : i + 3] for i in range(len(s) - 2)} or {s}
    likely = {(a[0], b[0]): SequenceMatcher(None, a[1], b[1]).ratio() for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and 3 * len(pieces(a[1]) & pieces(b[1])) >= max(len(pieces(a[1])), len(pieces(b[1])))}
    before = shuffled(spark)
    assert {tuple(r) for r in ar.likely_pairs(df, "id", "slug", "category").collect()} == set(likely)
    assert {tuple(sorted(r)) for r in ar.alike_pairs(df, "id", "slug", "category").collect()} == {k for k, v in likely.items() if v >= 0.75}
    assert shuffled(spark) - before < 300_000
    e = df.withColumn("title", F.col("slug")).withColumn("description", F.lit(""))
    assert groups(ar.hybrid_edges(e, links=True)) == groups(ar.hybrid_edges(e))


def test_names_of_mentions_are_normalised_once(spark):
    asked = spark.createDataFrame([("Hamza ibn Abd", ["Hamza ibn Abd", "Hamza"])], "mention string, variants array<string>")
    known = spark.createDataFrame([("hamza", ["the lion"], 3), ("zayd", None, 1)], "entity string, aliases array<string>, chunk_count long")
    got = rt.resolve_mentions(asked, known)
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()  # the long expression, once a use
    assert [tuple(r)[:4] for r in got.collect()] == [("Hamza ibn Abd", "Hamza ibn Abd", "hamza", 0.8)]


def test_links_by_neighbours_first_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abdghijklmnrstuwz") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    rows = [(n, f"{rng.choice(words)} ibn {rng.choice(words)} al-{rng.choice(words)}", [f"Abu {rng.choice(words)}"] if rng.random() < 0.4 else [], rng.choice(["Person", "Prophet", "Place"]), " ".join(rng.sample(words, 3))) for n in range(1300)]
    df = spark.createDataFrame(rows, "id long, name string, aliases array<string>, type string, context_description string")
    groups = lambda links: {(r["node"], r["grp"]) for r in rs.similarity_groups(links, df.select(df["id"].alias("node"))).collect()}
    want = groups(ar.scored_pairs(df, 0.5))
    assert 10 < len({g for _, g in want}) < 1300  # some are linked, some are not
    assert groups(ar.scored_pairs(df, 0.5, links=True, few=100)) == want == groups(ar.scored_pairs(df, 0.5, links=True))


def test_closed_rows_are_shuffled_once_a_part_of_the_open_ones(spark):
    seen = lambda left: type("Seen", (), {"rows": len(left), "__call__": lambda self, right: iter([{"a": np.repeat(left["id"].to_numpy(), len(right)), "b": np.tile(right["id"].to_numpy(), len(left))}])})()
    rows = spark.range(3000).selectExpr("id", "id % 10 = 0 AS open")
    got = ce.open_with_all(rows, "id", seen, "a long, b long").toPandas()
    pairs = set(zip(got[["a", "b"]].min(axis=1), got[["a", "b"]].max(axis=1)))
    assert len(got) < 300 * 3000 + 1 and pairs >= {(a, b) if a < b else (b, a) for a in range(0, 3000, 10) for b in range(3000)}


def test_the_model_is_asked_once(spark):
    from lexigraph.plans import providers as pv

    asked = spark.sparkContext.accumulator(0)

    def rule(prompts):
        asked.add(len(prompts))
        return ['{"actions": []}'] * len(prompts)

    df = spark.createDataFrame([(n, f"Zayd ibn Harith{n}", f"zayd ibn harith{n}", [], "Person", "x", 1.0) for n in range(6)], "id long, name string, normalized_name string, aliases array<string>, type string, context_description string, confidence double")
    relations = spark.createDataFrame([("zayd ibn harith1", "zayd ibn harith2")], "source string, target string")
    results = ar.deduplicate(df, relations, lambda prompts: pv.ask(prompts, rule), spark.createDataFrame([("Person", 1, 9)], "type string, least int, most int"), {})
    assert [r.count() for r in results] == [6, 1, 1] and asked.value == 1


def test_alike_pairs_with_few_pieces_in_common_are_found(spark):
    pairs = [("abcdefghijklmnop", "abXdefYhijZlmnWp"), ("qrstuvwxyzab", "qr1tu2wx3zab"), ("mnbvcxzlkjhg", "mnbv0xzl0jhg")]
    rows = [(f"{side}{n}", p[side], "c") for n, p in enumerate(pairs) for side in (0, 1)]
    df = spark.createDataFrame(rows, "id string, slug string, category string")
    want = {(f"0{n}", f"1{n}") for n in range(3)}
    assert {tuple(sorted(r)) for r in ar.alike_pairs(df, "id", "slug", "category").collect()} == want
    e = df.withColumn("title", F.col("id")).withColumn("description", F.lit(""))
    assert {tuple(r) for r in ar.hybrid_edges(e).collect()} == want
    assert {(r["id"], r["cluster"]) for r in ar.clusters_of(ar.hybrid_edges(e, links=True), e).collect()} == {(x, min(p)) for p in want for x in p}


def test_alike_links_beside_known_groups_link_what_all_pairs_do(spark):
    rng = random.Random(8)
    rows = []
    for n in range(160):
        t = "".join(rng.choice("abdgijlmnr") for _ in range(12))
        rows += [(f"k{n:03}", t, f"w{n % 3}"), (f"m{n:03}", "".join(c if k % 3 else "x" for k, c in enumerate(t)) if n % 2 else t[:11] + "y", "big" if n % 4 else f"m{n}")]
    df = spark.createDataFrame(rows, "id string, slug string, label string")
    known = df.groupBy("label").agg(F.min("id").alias("a")).join(df, "label").select("a", F.col("id").alias("b"))
    pairs = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and SequenceMatcher(None, a[1], b[1]).ratio() >= 0.75]
    links = ar.alike_pairs(df, "id", "slug", links=True, label="label").select("a", "b")
    want = groups(known.unionByName(spark.createDataFrame(pairs, "a string, b string")))
    assert len(pairs) > 60 and groups(known.unionByName(links)) == want and links.count() < len(pairs)


def test_scored_pairs_with_few_pieces_in_common_are_found(spark):
    # Names with a gestalt ratio of 0.75 and no three letters in common: 0.375 + 0.1 of the type + 0.1 of the context.
    rows = [(1, "mnbvcxzlkjhg", "Person", [], "told of old"), (2, "mnQvcWzlEjhR", "Person", None, "told of old"), (3, "qrstuwyab", "Place", [], "")]
    # Aliases alike by 0.8 with few pieces in common: 0.21, and as much again of names alike by half.
    rows += [(4, "acegikmo", "Person", ["bdfhj lnprt vxz"], "went far"), (5, "acXgiYmZ", "Person", ["bdfhk lnpst vxy"], "went far")]
    df = spark.createDataFrame(rows, "id long, name string, type string, aliases array<string>, context_description string")
    ends = {e: df.select([F.col(c).alias(f"{to}_{e}") for c, to in (("id", "id"), ("name", "name"), ("type", "type"), ("aliases", "aliases"), ("context_description", "context"))]) for e in "ab"}
    scored = rs.pair_scores(ends["a"].join(ends["b"], F.col("id_a") < F.col("id_b"))).collect()
    want = {(r["id_a"], r["id_b"]): round(r["score"], 9) for r in scored if r["score"] >= 0.5}
    assert set(want) == {(1, 2), (4, 5)}
    assert {(r["a"], r["b"]): r["score"] for r in ar.scored_pairs(df, 0.5, shared=None).collect()} == want
    assert {(r["a"], r["b"]): r["score"] for r in ar.scored_pairs(df, 0.5, links=True, shared=None).collect()} == want
    assert {(r["id"], r["grp"]) for r in ar.threshold_groups(df).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)}


def test_scored_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abdgiklmnrstuz") for _ in range(rng.randrange(4, 9)))
    words = [word() for _ in range(9)]
    blur = lambda t: "".join(c if rng.random() < 0.75 else rng.choice("xyw") for c in t)
    name = lambda: blur(f"{rng.choice(words)} {rng.choice(words)}")
    rows = [(n, name() if n % 11 else None, rng.choice(["Child", "AhlBayt", None]), [name() for _ in range(rng.randrange(3))], rng.choice(["", "told of old", blur(" ".join(words) * 2)])) for n in range(90)]
    df = spark.createDataFrame(rows, "id long, name string, type string, aliases array<string>, context_description string")
    ends = {e: df.select([F.col(c).alias(f"{to}_{e}") for c, to in (("id", "id"), ("name", "name"), ("type", "type"), ("aliases", "aliases"), ("context_description", "context"))]) for e in "ab"}
    scored = rs.pair_scores(ends["a"].join(ends["b"], F.col("id_a") < F.col("id_b"))).collect()
    for least in (0.3, 0.5):
        want = {(r["id_a"], r["id_b"]): round(r["score"], 9) for r in scored if round(r["score"], 9) >= least}
        assert want and {(r["a"], r["b"]): r["score"] for r in ar.scored_pairs(df, least, shared=None).collect()} == want


def test_names_of_mentions_are_not_broadcast(spark):
    asked = spark.createDataFrame([("Hamza ibn Abd", ["Hamza ibn Abd", "Hamza"])], "mention string, variants array<string>")
    known = spark.createDataFrame([("hamza", ["the lion"], 3), ("zayd", None, 1)], "entity string, aliases array<string>, chunk_count long")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    got, within = rt.resolve_mentions(asked, known), rt.contained_texts(spark.createDataFrame([("hamza",), ("hamza ibn abd",)], "t string"))
    assert all("Broadcast" not in plan(df) and "SortMergeJoin" in plan(df) for df in (got, within))
    assert [tuple(r)[:4] for r in got.collect()] == [("Hamza ibn Abd", "Hamza ibn Abd", "hamza", 0.8)]
