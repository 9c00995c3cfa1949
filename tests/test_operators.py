import random

import pytest
from pyspark.sql import functions as F

from lexigraph.joins import salted_join
from lexigraph.operators import graph as g
from lexigraph.operators import identity as idn
from lexigraph.operators import resolve as rs
from lexigraph.operators import retrieval as rt
from lexigraph.operators import units as un
from lexigraph.operators.components import connected_components
from lexigraph.plans import providers as pv
from lexigraph.sources import tables as tb


def brute_components(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", range(3))
def test_components_are_those_of_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(90):02}", f"n{rng.randrange(90):02}") for _ in range(60)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)] + [("hub", f"h{i}") for i in range(40)]
    pairs += [(None, "x"), ("y", None), ("z", "z"), ("b", "a"), ("a", "b")]
    df = spark.createDataFrame([(a, b, "extra") for a, b in pairs], "src string, dst string, node string")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == brute_components(pairs)


def test_components_with_a_hot_node_and_a_hot_label_spread_over_tasks(spark):
    pairs = [("hub", f"h{i:04}") for i in range(2500)] + [(f"h{i:04}", f"z{i:04}") for i in range(0, 2500, 7)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)]
    df = spark.createDataFrame(pairs, "src string, dst string")
    assert {r["node"]: r["component"] for r in connected_components(df, spread_from=0).collect()} == brute_components(pairs)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_salted_join_is_a_join(spark):
    many = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 1), (None, 2), ("c", 3)], "k string, v int")
    one = spark.createDataFrame([("a", "A"), ("b", "B")], "k string, w string")
    got = salted_join(many, one, "k", spark.createDataFrame([("a",)], "k string"), salts=8, how="left")
    assert sorted(map(str, got.select("k", "v", "w").collect())) == sorted(map(str, many.join(one, "k", "left").select("k", "v", "w").collect()))


def follow(redirects, x):
    seen = []
    while x in redirects and x not in seen:
        seen.append(x)
        x = redirects[x]
    return min(seen[seen.index(x) :]) if x in seen else x


@pytest.mark.parametrize("seed", range(2))
def test_redirects(spark, seed):
    rng = random.Random(seed)
    table = {f"{i:02}": f"{rng.randrange(40):02}" for i in range(30)}
    table = {a: b for a, b in table.items() if a != b} | {f"t{i}": f"t{i + 1}" for i in range(20)}
    got = {r["source"]: r["target"] for r in rs.resolve_redirects(spark.createDataFrame(list(table.items()), "source string, target string")).collect()}
    assert got == {x: follow(table, x) for x in table}


def test_valid_redirects(spark):
    rows = [(" a ", "b", 1), ("a", "c", 2), ("a", " ", 3), ("NaN", "x", 1), ("d", "d", 1), (None, "x", 1), ("e", None, 1)]
    assert [tuple(r) for r in rs.valid_redirects(spark.createDataFrame(rows, "source string, target string, stage int")).collect()] == [("a", "c")]


def test_greedy_pivots_are_not_transitive(spark):
    rows = [("1", "Abdullah", "Human", 5, 1), ("2", "Abdulla", "Human", 1, 2), ("3", "Abdullah", "Event", 1, 3), ("4", "Hamza", None, 1, 4), ("5", "Hamzah", None, 2, 5), ("5", "Hamzah", None, 2, 6)]
    got = {r["id"]: r["pivot"] for r in rs.greedy_pivots(spark.createDataFrame(rows, "id string, title string, category string, frequency int, pos int")).collect()}
    assert got == {"1": "1", "2": "1", "3": "3", "4": "5", "5": "5"}


def test_anchor(spark):
    entries = spark.createDataFrame([("BADR_WELL", "Event", (["Ghazwat Badr"],)), ("OHOD", "Event", (None,)), ("BADR_X", "Event", ([],))], "slug string, category string, properties struct<aliases: array<string>>")
    e = spark.createDataFrame([("1", "ghazwat badr", "Event"), ("2", "Badr", "Event"), ("3", "ohod", "Place"), ("4", "OHOD", "Event"), ("5", "BADR_", "Event"), ("6", None, "Event"), ("7", "ohod", None)], "id string, title string, category string")
    got = {r["id"]: (r["review_status"], r["canonical_id"]) for r in rs.anchor(e, entries).collect()}
    assert got == {"1": ("CORE_VALIDATED", "BADR_WELL"), "2": ("NOT_KNOWN", None), "3": ("NOT_KNOWN", None), "4": ("CORE_VALIDATED", "OHOD"), "5": ("NOT_KNOWN", None), "6": ("NOT_KNOWN", None), "7": ("NOT_KNOWN", None)}


def test_pair_scores_and_types(spark):
    rows = [("ali ibn abi talib", ["ali"], "AhlBayt", "x", "ali ibn abi talib", ["Ali"], "Sahabi", None), ("a", None, None, None, "b", [], "City", "x")]
    columns = ", ".join(f"name_{s} string, aliases_{s} array<string>, type_{s} string, context_{s} string" for s in "ab")
    got = [r["score"] for r in rs.pair_scores(spark.createDataFrame(rows, columns)).collect()]
    assert got[0] == pytest.approx(0.5 + 0.3 + 0.07) and got[1] == pytest.approx(0.03)


def test_split_text():
    text = " ".join(f"w{i}." for i in range(300)) + "\n\n" + "".join(f"{chr(97 + i % 26)}{i}" for i in range(300)) + "|tail"
    parts = un.split_text(text, 300, 30)
    assert max(map(len, parts)) <= 300 and un.split_text("", 10, 2) == [] and un.split_text("short", 10, 2) == ["short"]
    at = 0
    for p in parts:  # in order, nothing skipped
        found = next(q for q in range(at, max(-1, at - 31), -1) if text.startswith(p, q))
        at = found + len(p)
    assert at == len(text)


def test_recursive_split_flags(spark):
    rows = [("u", "| a | b |\n" * 200, "Table"), ("v", None, None), ("w", "short", "T")]
    got = un.recursive_split(spark.createDataFrame(rows, "unit_id string, text string, heading string"), max_tokens=100, overlap=10).toPandas()
    u = got[got.parent_id == "u"].sort_values("part")
    assert len(u) > 2 and list(u.is_continuation)[:2] == [False, True] and not u.is_cut.iloc[-1] and u.is_table_cut.iloc[0]
    assert u.unit_id.iloc[1] == "u_s1" and u.heading.iloc[1] == "Table (Suite Tableau 1)" and len(got[got.parent_id == "v"]) == 1


def test_heading_inheritance(spark):
    rows = [("d", 0, []), ("d", 1, ["Chapter 1"]), ("d", 2, ["Page 12"]), ("d", 3, None), ("e", 0, ["Page 1"])]
    got = un.inherit_heading(spark.createDataFrame(rows, "doc string, n int, h array<string>"), "doc", "n", "h").orderBy("doc", "n").collect()
    assert [r["heading_refined"] for r in got] == ["Section générale", "Chapter 1", "Chapter 1", "Chapter 1", "Section générale"]


def test_edges_without_known_ends_vanish(spark):
    e = spark.createDataFrame([("1", "A", 1), ("2", "B", 2), ("3", "B", 3)], "id string, slug string, pos int")
    r = spark.createDataFrame([("A", "B", "x", 1.0, ["u"], 1), ("A", "B", "", 2.0, ["v"], 1), ("A", "Z", "y", 1.0, ["u"], 1), ("B", "B", "self", 1.0, ["u"], 1)], "source_slug string, target_slug string, description string, weight double, source_ids array<string>, rank int")
    got = g.consolidate_relationships(g.remap_relationships(r, e)).collect()
    assert [(x["source_id"], x["target_id"], x["weight"], x["description"], x["source_ids"]) for x in got] == [("1", "3", 3.0, "x", ["u", "v"])]


def test_edge_upsert_counts_on(spark):
    now = spark.createDataFrame([("a", "lived in", "b", "e1"), ("a", "LIVED_IN", "b", None)], "source string, type string, target string, evidence string")
    first = g.merge_edges(now)
    again = g.merge_edges(now, first).first()
    assert again["occurrence_count"] == 4 and again["evidences"] == ["e1"] and again["type"] == "LIVED_IN"


def test_communities_follow_the_edges(spark):
    groups = [[f"{g}{i}" for i in range(6)] for g in "abcd"]
    pairs = [(x, y) for g in groups for x in g for y in g if x < y] + [("a0", "b0"), ("b1", "c1"), ("c2", "d2"), ("d3", "a3"), (None, "x"), ("y", "y")]
    edges = spark.createDataFrame(pairs, "s string, t string")
    got = g.communities(edges, "s", "t", 10, 2)
    first = got.filter("level = 0").cache()
    of = {}
    for r in first.collect():
        of.setdefault(r["community"], set()).add(r["node"])
        assert r["size"] <= 10 or r["size"] % 6 == 0
    assert sum(map(len, of.values())) == 24 and all(any(set(m) <= c for c in of.values()) for m in groups)
    assert g.modularity(edges, "s", "t", first) > 0.4
    assert g.communities(edges.limit(0), "s", "t").count() == 0


def test_strategies():
    entity, tag = {"kind": "entity"}, {"kind": "tag"}
    assert [rt.choose_strategy(m, t) for m, t in (([], "overview"), ([tag], "x"), ([entity], "overview"), ([entity, entity], "relationship"), ([entity, tag], "relationship"), ([entity], "general"))] == ["vector", "tag", "summary", "relationship", "hybrid", "hybrid"]


def test_mentions_first_variant_wins(spark):
    known = spark.createDataFrame([("abu bakr", [], 5), ("abu talib", ["the uncle"], 9), ("umar", None, 1)], "entity string, aliases array<string>, chunk_count int")
    asked = spark.createDataFrame([("q1", ["Abu Bakr", "umar"]), ("q2", ["nobody", "The Uncle"]), ("q3", ["xyz"])], "mention string, variants array<string>")
    got = {r["mention"]: (r["entity"], r["match_score"]) for r in rt.resolve_mentions(asked, known).collect()}
    assert got == {"q1": ("abu bakr", 1.0), "q2": ("abu talib", 0.6)}


def test_rerank_keeps_rows_without_score(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("b", None, 2), ("c", 0.9, 3), ("d", -1.0, 4)], "id string, score double, position int")
    assert [r["id"] for r in rt.rerank(df, "score", 3).collect()] == ["c", "a", "b"]


def test_outline(spark):
    entries = "\n".join(f"Chapitre {i}" for i in range(5))
    rows = [("x\n  Sommaire :\n\n" + entries, None), ("Sommaire\nun\ndeux", ["A", " ", "B"]), ("rien", None), (None, []), ("y\n" * 300 + "Table des matières\n" + entries, ["A"])]
    got = [(r["o"]["type"], r["o"]["content"]) for r in spark.createDataFrame(rows, "t string, h array<string>").select(idn.outline(F.col("t"), F.col("h")).alias("o")).collect()]
    assert got == [("OFFICIEL", entries), ("ESTIMÉ", "- A\n- B"), ("ABSENT", ""), ("ABSENT", ""), ("OFFICIEL", entries)]


def test_reports_and_answer_context(spark):
    a = spark.createDataFrame([(1, 'x {"title": "T", "rating": 3.5, "findings": [{"summary": "s", "explanation": "e"}]}'), (2, "no")], "community int, answer string")
    assert {r["community"]: r["title"] for r in idn.reports(a).collect()} == {1: "T", 2: None}
    rows = spark.createDataFrame([(2, "b", "H", [1], ["|t|"], ["i", "j"]), (1, "a", None, None, None, ["j"])], "o int, chunk_text string, chunk_heading_full string, chunk_page_numbers array<int>, chunk_tables array<string>, chunk_images_urls array<string>")
    got = idn.answer_context(rows, "o").first()
    assert got["context"].index("[SOURCE 1]") < got["context"].index("|t|") and got["images"] == ["j", "i"]


def test_tag_search(spark):
    tags = spark.createDataFrame([("1", "Mères", ["mothers"]), ("2", "Mères des Croyants", None)], "tag_id string, label string, aliases array<string>")
    assert [rt.tag_search(tags, n).first()["tag_id"] for n in ("mères", "croyants", "MOTHERS")] == ["1", "2", "1"] and rt.tag_search(tags, "zzz").count() == 0


def test_provider_cache_retry_and_fallback(spark, tmp_path):
    prompts = spark.createDataFrame([(i, f"p{i % 3}") for i in range(9)], "key int, prompt string")
    first = pv.ask(prompts, lambda texts: [t.upper() for t in texts])
    assert {r["answer"] for r in first.collect()} == {"P0", "P1", "P2"}
    cache = first.select(F.col("cache_key").alias("key"), F.lit("kept").alias("response"), F.current_timestamp().alias("created_at")).filter("prompt = 'p0'").limit(1)
    cache.write.parquet(str(tmp_path / "cache"))

    def broken(texts):
        raise OSError

    got = pv.ask(prompts, broken, spark.read.parquet(str(tmp_path / "cache")), fallback="none").collect()
    assert {(r["prompt"], r["answer"], r["cached"]) for r in got} == {("p0", "kept", True), ("p1", "none", False), ("p2", "none", False)}


def test_verdicts_and_claims_and_points(spark):
    a = spark.createDataFrame([("c", '("MERGE"<|>0<|>2)##("merge"<|>1<|>x)##("merge"<|>0<|>9)##("MERGE"<|>2<|>0)')], "cluster string, answer string")
    assert [tuple(r) for r in pv.verdicts(a, spark.createDataFrame([("c", 3)], "cluster string, size int")).collect()] == [("c", 0, 2)]
    b = spark.createDataFrame([("u", "(" + "<|>".join("abcdefgh") + ")##(a<|>b)", '```json {"points": [{"description": "x", "score": 3}, {"description": "y", "score": 80}, {"description": "z", "score": 0}]}```')], "unit_id string, answer string, points string")
    assert pv.claims(b).first()["source_text"] == "h"
    assert [r["description"] for r in pv.search_points(b.select(F.col("points").alias("answer"))).collect()] == ["y", "x"]


def test_usage_costs(spark):
    prices = spark.createDataFrame([("mini", 0.15, 0.6)], "model string, prompt_price double, completion_price double")
    log = spark.createDataFrame([("mini", 1_000_000, 1_000_000), ("other", 1_000_000, 0)], "model string, prompt_tokens long, completion_tokens long")
    assert {r["model"]: r["cost"] for r in pv.usage(log, prices).collect()} == {"mini": 0.75, "other": 0.15}


def test_sources(spark, tmp_path):
    (tmp_path / "seed.json").write_text('[{"ID": "BADR", "CANONICAL_NAME": "Badr", "TYPE": "Battle", "CORE_SUMMARY": "s", "PROPERTIES": {"ALIASES": ["x"]}}]')
    seed = tb.read_encyclopedia_seed(spark, str(tmp_path / "seed.json"))
    assert seed.first()["properties"]["aliases"] == ["x"] and tb.seed_if_empty(spark, seed.limit(0), seed).count() == 1
    (tmp_path / "graph.json").write_text('{"entities": [{"name": "A"}], "relations": []}')
    e, r = tb.read_graph_json(spark, str(tmp_path / "graph.json"))
    assert e.count() == 1 and r.count() == 0
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert tb.read_texts(spark, str(tmp_path / "a.txt")).first()["text"] == "one\ntwo" and tb.read_files(spark, str(tmp_path / "a.txt")).first()["length"] == 7
    with pytest.raises(ValueError):
        tb.read_texts(spark, "x", "pdf")
    chunks = spark.createDataFrame([("c1", "d1", 0, "t", ["h"], [1])], "chunk_id string, doc_id string, chunk_index int, chunk_text string, chunk_headings array<string>, chunk_page_numbers array<int>")
    tb.write_chunks(chunks, str(tmp_path / "chunks"))
    back = spark.read.parquet(str(tmp_path / "chunks")).first()
    assert back["chunk_headings"] == '["h"]' and back["chunk_page_numbers"] == [1]
    assert tb.duplicates(chunks.union(chunks), "chunk_id").count() == 1
    images = spark.createDataFrame([("u", "b", 200, 10), ("u", "a", 10, 150), ("u", "a", 10, 150), ("u", "c", 9, 9)], "unit_id string, url string, width int, height int")
    assert tb.image_assets(images).first()["image_urls"] == ["a", "b"]
    pages = spark.createDataFrame([(["1", "x", "2"],), (["x"],)], "p array<string>").select(tb.identity_pages(F.col("p")).alias("p"))
    assert [r["p"] for r in pages.collect()] == [[1, 2], [1000]]


def test_bm25_counts_every_term_at_any_split(spark):
    import math

    rng = random.Random(5)
    texts = [" ".join(["al"] * rng.randrange(3) + ["ibn"] * rng.randrange(2) + rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(120)]
    asked = ["al", "who is al ibn", "ibn a", "al ibn b c", "h", "nothing"]
    split = [t.split() for t in texts]
    n, mean = len(split), sum(map(len, split)) / len(split)
    df = {t: sum(t in w for w in split) for t in {t for q in asked for t in q.split()}}
    want = set()
    for q, question in enumerate(asked):
        scores = [(-round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in question.split() if t in w), 6), i) for i, w in enumerate(split)]
        want |= {(q, i, r + 1) for r, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:7])}
    docs, queries = spark.createDataFrame(list(enumerate(texts)), "i int, t string"), spark.createDataFrame(list(enumerate(asked)), "q int, text string")
    for options in ({}, {"often": 0.0}, {"often": 0.3}, {"often": 0.5}, {"often": 1.0}):
        assert {(r["q"], r["i"], r["rank"]) for r in rt.bm25_topk(docs, queries, "i", "t", "q", "text", 7, **options).collect()} == want
