import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lexigraph.joins import hot_values, ranked
from lexigraph.operators import arbitration as ar
from lexigraph.operators import retrieval as rt
from lexigraph.plans import pipeline
from lexigraph.plans import providers as pv
from lexigraph.plans.catalog_resolution import ask
from lexigraph.sources import tables as tb


def names(seed, n):
    rng = random.Random(seed)
    part = lambda: "".join(rng.choice("bdfghjklmn") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))
    out = [f"{part()}_{part()}" for _ in range(n)]
    return out + [x[:4] + rng.choice("xyz") + x[5:] for x in out[::3]] + [x.split("_")[0] for x in out[::5]] + ["_", "abcd", ""]


def test_contained_and_likely_pairs_against_all_pairs(spark):
    rows = [(f"k{i:03}", s, None if i % 4 == 0 else "c") for i, s in enumerate(names(1, 60))]
    df = spark.createDataFrame(rows, "id string, slug string, category string")
    pairs = [(a, b) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2]]
    got = {tuple(r) for r in ar.contained_pairs(df, "id", "slug", "category").collect()}
    assert got == {(a[0], b[0]) for a, b in pairs if min(len(a[1]), len(b[1])) > 4 and (a[1] in b[1] or b[1] in a[1])}
    pieces = lambda s: {s} if len(s) < 3 else {s[i : i + 3] for i in range(len(s) - 2)}
    likely = {tuple(r) for r in ar.likely_pairs(df, "id", "slug", "category").collect()}
    assert likely == {(a[0], b[0]) for a, b in pairs if a[1] and b[1] and 3 * len(pieces(a[1]) & pieces(b[1])) >= max(len(pieces(a[1])), len(pieces(b[1])))}
    alike = {(a[0], b[0]) for a, b in pairs if SequenceMatcher(None, a[1], b[1]).ratio() >= 0.75 and a[1] and b[1]}
    assert len(alike & (likely | got)) >= 0.9 * len(alike)


def test_contained_texts_against_all_pairs(spark):
    texts = sorted(set(names(2, 40)) | {"a", "ab", "b"})
    got = {tuple(r) for r in rt.contained_texts(spark.createDataFrame([(t,) for t in texts], "t string")).collect()}
    assert got == {(a, b) for a in texts for b in texts if a and a != b and a in b}


def test_merge_maps_and_verdicts(spark):
    m = lambda rows: spark.createDataFrame(rows, "source string, target string")
    got = {r["source"]: r["target"] for r in ar.merge_maps(m([("a", "b"), ("x", "y")]), m([("b", "c"), ("x", "z")])).collect()}
    assert got == {"a": "c", "b": "c", "x": "z"}
    asked = spark.createDataFrame([("k", [(0, "e0"), (1, "e1"), (2, "e2")])], "key string, members array<struct<idx: int, id: string>>")
    said = spark.createDataFrame([("k", '("MERGE"<|>[#1]<|>0)##("merge"<|>2<|>9)##("merge"<|>2<|>2)##("merge"<|>x<|>1)##("keep"<|>2<|>1)')], "key string, answer string")
    assert [tuple(r) for r in ar.merge_verdicts(said, asked).collect()] == [("e1", "e0")]


def test_pyramid_goes_on_until_one_batch(spark):
    e = spark.createDataFrame([(f"e{i:03}", f"t{i:03}", "T", "d") for i in range(60)], "id string, title string, type string, description string")
    got = ar.pyramid(e, e.select("id", F.lit("c").alias("cluster")), ask, size=5).collect()
    assert {r["target"] for r in got} == {"e000"} and len(got) == 59


def test_deduplicate(spark):
    rows = [(1, "Hamza ibn Abd", "hamza", "Person", ["the lion"], "told", 0.5), (2, "Hamzah ibn Abd", "hamzah", "Person", None, "more", 0.9), (3, "Zaynab", "zaynab", "Person", [], None, None)]
    e = spark.createDataFrame(rows, "id long, name string, normalized_name string, type string, aliases array<string>, context_description string, confidence double")
    edges = spark.createDataFrame([("hamzah", "zaynab"), ("nobody", "zaynab")], "source string, target string")
    kept, relations, report = ar.deduplicate(e.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))), edges, ask, spark.createDataFrame([("Person", 1, 2)], "type string, least int, most int"), {})
    got = {r["id"]: r for r in kept.collect()}
    assert set(got) in ({1, 3}, {2, 3}) and [tuple(r) for r in relations.select("target").collect()] == [("zaynab",)] and report.first()["valid"]
    one = got[min(got)]
    assert one["context_description"] == "more | told" and one["confidence"] == 0.9 and "the lion" in one["aliases"]


def test_ranked_is_a_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b"]), rng.randrange(20), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    want = {}
    for g in (None, "a", "b"):
        for n, (_, v, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))):
            want[i] = n + 1
    assert {r["i"]: r["k"] for r in ranked(df, ["g"], [F.desc("v"), F.col("i")], "k").collect()} == want
    assert sorted(r["k"] for r in ranked(df, [], [F.col("i")], "k").collect()) == list(range(1, 301))
    hot = spark.createDataFrame([("x",)] * 3000 + [("y",)] * 10, "k string")
    assert [r["k"] for r in hot_values(hot, "k").collect()] == ["x"]


def test_vector_search_in_blocks(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)] if i % 9 else None) for i in range(80)] + [(90, []), (91, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = df.filter("vec_id < 8").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    ask_ = lambda **o: {(r["query_id"], r["vec_id"], r["rank"]) for r in rt.vector_topk_each(df, q, 5, **o).collect()}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    want = set()
    for a, x in rows[:8]:
        if x and norm(x):
            near = sorted((-round(sum(p * r for p, r in zip(x, y)) / norm(x) / norm(y), 9), b) for b, y in rows if y and len(y) == 4 and norm(y))
            want |= {(a, b, n + 1) for n, (s, b) in enumerate([x for x in near if -x[0] >= 0.05][:5])}
    assert ask_() == ask_(block=8) == want


def test_providers_of_the_answer(spark):
    units = spark.createDataFrame([("u", "Ab meets Cd"), ("v", "nothing")], "unit_id string, text string")

    def light(prompts):
        return ['("entity"<|>Ab<|>P<|>x)' if p.startswith("ENTITIES") and "Ab" in p else '("relationship"<|>Ab<|>Cd<|>meets<|>2)' if p.startswith("RELATIONS") else "" for p in prompts]

    entities, relations = pv.answers_to_graph(pv.extract_light(units, light))
    assert entities.count() == 1 and relations.first()["weight"] == 2.0
    chunks = spark.createDataFrame([("c", "H", ["t"], [], "text", [1]), ("d", None, [], None, "more", None)], "chunk_id string, chunk_heading_full string, chunk_tables array<string>, chunk_images_urls array<string>, chunk_text string, chunk_page_numbers array<int>")
    assert {r["chunk_id"]: r["visual_summary"] for r in pv.visual_summaries(chunks, lambda p: ["seen"] * len(p)).collect()} == {"c": "seen", "d": ""}
    vectors = {r["chunk_id"]: r["embedding"] for r in pv.embed(chunks.select("chunk_id", F.col("chunk_text").alias("text")), lambda t: [[float(len(x))] for x in t], instruction="q:").collect()}
    assert vectors == {"c": [6.0], "d": [6.0]}
    points = spark.createDataFrame([("low", 1), ("high", 9)], "description string, score int")
    assert pv.reduce_points(points, "q?", lambda p: [x.split("\n")[2] for x in p]).first()["answer"] == "[9] high"
    told = spark.createDataFrame([("k", '{"response": "r", "score": 3, "follow_up_queries": ["a"]}'), ("n", "no")], "key string, answer string")
    assert {r["key"]: r["response"] for r in pv.drift(told).collect()} == {"k": "r", "n": None}
    assert [r["question"] for r in pv.follow_up_questions(spark.createDataFrame([("k", "- one?\n2. two?\n")], "key string, answer string")).orderBy("position").collect()] == ["one?", "two?"]
    found = spark.createDataFrame([("d", 1), ("c", 2)], "chunk_id string, position int")
    history = spark.createDataFrame([(0, 1, "user", "before")], "question_id int, turn int, role string, content string")
    got = pipeline.answer("who?", found, chunks, lambda p: p, history).first()["answer"]
    assert got.index("before") < got.index("more") < got.index("text") < got.index("QUESTION: who?")
    failed = pv.ask(spark.createDataFrame([(1, "p")], "key int, prompt string"), lambda p: 1 / 0, fallback="none", attempts=1)
    assert failed.first()["error"].startswith("ZeroDivisionError") and pv.to_cache(failed).count() == 0


def test_tags_and_duplicates_in_retrieval(spark):
    chunks = spark.createDataFrame([("c1", "the well of badr"), ("c2", "umar at badr"), ("c3", "nothing here")], "chunk_id string, chunk_text string")
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.6, 0.8]), ("c3", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    links = spark.createDataFrame([("umar", "c2", 0.9), ("badr", "c1", 0.8), ("badr", "c2", 0.7)], "entity_id string, chunk_id string, relevance_score double")
    entities = spark.createDataFrame([("umar", [], 1, "the second"), ("badr", [], 2, "")], "entity string, aliases array<string>, chunk_count int, summary string")
    tags = spark.createDataFrame([("T", "Battles", None)], "tag_id string, label string, aliases array<string>")
    of, trust = spark.createDataFrame([("T", "badr")], "tag_id string, entity_id string"), spark.createDataFrame([("T", 0.9)], "tag_id string, trust_score double")
    ask_ = lambda *n, **o: [r["chunk_id"] for r in pipeline.retrieve(pipeline.Analysis("badr", "badr", "general", 1.0, [[x] for x in n]), vectors, [1.0, 0.0], chunks, links, entities, 5, tags, of, trust, **o).orderBy("position").collect()]
    assert ask_("battles")[:3] == ["tag_T", "c1", "c2"]
    assert ask_("umar", "badr")[:3] == ["c2", "c1", "c2"]
    assert ask_("nobody", reranker=lambda pairs: [1.0 if "umar" in t else 0.5 if "well" in t else -1.0 for _, t in pairs]) == ["c2", "c1"]


def test_store_operators(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, at int, v string")
    first = tb.merge_by_key(None, rows, ["k"], "at")
    again = tb.merge_by_key(first, spark.createDataFrame([("b", 5, "new"), ("c", 5, "c")], "k string, at int, v string"), ["k"], "at")
    assert {tuple(r) for r in again.collect()} == {("a", "y"), ("b", "new"), ("c", "c")} and tb.get_by(again, "k", "a").count() == 1
    spark.createDataFrame([("A",), ("B",), ("A",)], "title string").write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([("A", "B"), ("A", "Z")], "source string, target string").write.parquet(str(tmp_path / "r"))
    tb.import_graph(spark, str(tmp_path / "e"), str(tmp_path / "r"), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g" / "vertices")).count() == 2 and spark.read.parquet(str(tmp_path / "g" / "edges")).count() == 1
    items = spark.createDataFrame([("c", 1, "text", "b", 2), ("c", 0, "text", "a", 1), ("c", 2, "table", "t", 2), ("c", 3, "table", "t", None), ("c", 4, "image", "i", 2)], "chunk_id string, pos int, kind string, value string, page int")
    got = tb.separate_content(items).first()
    assert got["text"] == "a\nb" and got["pages"] == [1, 2] and got["tables"] == ["t"] and got["images"] == ["i"] and got["headings"] == []
    passes = spark.createDataFrame([("one", 2, 1, 0), ("one", 3, None, 1)], "pass string, entities int, relations int, failed int")
    assert tuple(tb.pass_statistics(passes).first()) == ("one", 2, 5, 1, 1)


def test_deduplicate_asks_about_names_with_few_pieces_in_common(spark):
    rows = [(1, "mnbvcxzlkjhg", "mnbvcxzlkjhg", "Person", [], "told of old", 0.5), (2, "mnQvcWzlEjhR", "mnqvcwzlejhr", "Person", [], "told of old", 0.9), (3, "qrstuwyab", "qrstuwyab", "Place", [], "", None)]
    e = spark.createDataFrame(rows, "id long, name string, normalized_name string, type string, aliases array<string>, context_description string, confidence double")
    edges = spark.createDataFrame([("mnqvcwzlejhr", "qrstuwyab")], "source string, target string")
    kept, _, _ = ar.deduplicate(e, edges, ask, spark.createDataFrame([("Person", 1, 2)], "type string, least int, most int"), {})
    assert sorted(r["id"] for r in kept.collect()) == [1, 3]  # the rule merges the first two of a group
