import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigraph.llm import canonical, folding, lookalike, variants

SAME = [
    ("Jabal Dashidghib", "Jabal Dashidghib"), ("Jâhwa", "Jâhwa"), ("Ｍａｂ－ｘ", "Mab-x"), ("Кіw", "Kiw"), ("a​̂﻿b", "âb"), ("al‑Ru", "al-Ru"),
    ("  x   y ", "x y"), ("ﻻ", "لا"), ("غودوکزیبوي", "غودوكزيبوي"), ("ﬁn", "fin"), ("", ""),
]


def test_one_form(spark):
    df = spark.createDataFrame([(a, b) for a, b in SAME] + [(None, None)], "a string, b string")
    got = df.select(lookalike.canonical_text(F.col("a")).alias("a"), lookalike.canonical_text(F.col("b")).alias("b"), F.col("b").alias("c")).collect()
    assert all(r["a"] == r["b"] == r["c"] for r in got)


def test_what_shows_stays():
    for text in ("Ali", "ali", "âli", "x²", "①", "Мир", "Ж", "a-b", "a—b"):
        again = lookalike.canonical(text)
        assert (again == unicodedata.normalize("NFC", text)) or text == "Мир"
    assert lookalike.canonical("Ali") != lookalike.canonical("ali") != lookalike.canonical("âli")


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=30))
def test_one_form_is_stable_and_splices_rightly(text):
    once = lookalike.canonical(text)
    assert lookalike.canonical(once) == once
    whole = unicodedata.normalize("NFC", once)
    assert whole == once and "  " not in once


def test_fast_path_agrees_with_the_whole(spark):
    texts = ["Souk Nûrdastiw", "x  y", " x", "é", "é", "لييوزجوكز", "a­b", "plain", "Ĳ", "ﬀ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["x"] for r in df.select(lookalike.canonical_text(F.col("t")).alias("x")).collect()] == [lookalike.canonical(t) for t in texts]


def test_link_lookalikes(spark):
    mentions = spark.createDataFrame([(1, "Bad​r", "e"), (1, "Bad​r", "e"), (2, "Badr", "e"), (3, None, "e"), (4, "​", "e"), (5, "badr", "e")], "rec_id long, name string, id string")
    entries = spark.createDataFrame([("e1", "Badr"), ("e2", "Ba⁠dr"), ("e3", None), ("e4", "﻿")], "id string, title string")
    got = lookalike.link_lookalikes(mentions, entries, "rec_id", "name", "id", "title")
    assert {tuple(r) for r in got.collect()} == {(1, "e1"), (1, "e2"), (2, "e2")}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_pigeonhole_misses_nothing(spark):
    import random

    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(3, 12))) for _ in range(120)})
    refs, vals = words[::2], words[1::2] + words[:10]
    got = canonical.pigeonhole_candidates(spark.createDataFrame([(v,) for v in sorted(set(vals))], "v string"), spark.createDataFrame([(r,) for r in refs], "r string"), 2)
    found = {tuple(r) for r in got.collect()}
    assert {(v, r) for v in vals for r in refs if edits(v, r) <= 2} <= found


def test_map_to_list(spark):
    refs = spark.createDataFrame([("BADR", "Bataille de Badrwahish"), ("MAK", "Makkatrun"), ("MAK", "the mother"), ("TAY", "the mother"), ("ALI", "Ali ibn Talibun al-Hashimi"), (None, "x"), ("E", None)], "id string, text string")
    values = ["la bataille de badrwahish", "battle of badrwahihs", "cite de makatrun", "the mother", "ali b. talibun al hashimi", "al-Hashimi, Ali ibn Talibun", "a. ibn talibun al-hashimi", "ali al hashimi", "nothing like it", "", None, "makkatrun", "makkatrun"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = canonical.map_to_list(df, refs)
    assert {r["value"]: r["id"] for r in got.collect()} == {values[0]: "BADR", values[1]: "BADR", values[2]: "MAK", values[4]: "ALI", values[5]: "ALI", values[6]: "ALI", values[7]: "ALI", "makkatrun": "MAK"}
    assert {r["value"]: r["records"] for r in canonical.unmatched(df, got).collect()} == {"the mother": 1, "nothing like it": 1, "": 1}
    assert canonical.map_to_list(df.limit(0), refs).count() == 0 == canonical.map_to_list(df, refs.limit(0)).count()


def test_close_keys_misses_nothing(spark):
    import random

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(8, 12))) for _ in range(250)})
    got = variants.close_keys(spark.createDataFrame([(w,) for w in words], "key string"))
    assert {(r["a"], r["b"]): r["edits"] for r in got.collect()} == {(a, b): edits(a, b) for a in words for b in words if a < b and edits(a, b) <= 2}
    half = spark.createDataFrame([(w,) for w in words[::2]], "key string"), spark.createDataFrame([(w,) for w in words[1::2]], "key string")
    crossed = {(r["a"], r["b"]) for r in variants.close_keys(*half).collect()}
    assert crossed == {(a, b) for a in words[::2] for b in words[1::2] if edits(a, b) <= 2}


def test_folding(spark):
    pairs = [("H. ibn Shufiyad al-Rifîgh", "h ibn shufiad al rifigh"), ("Shijdum ibn B. al-Tuzju", "shijdum ibn b al tuzju"), ("B. Wazuf", "banu wazuf"), ("Wazuf (Banu)", "banu wazuf"), ("le chef Ali bin Umar al Makki", "ali ibn umar al maki"), ("Ali ibn Umar al-Makki (m. 454)", "ali ibn umar al maki")]
    df = spark.createDataFrame(pairs + [(None, None), ("", "")], "a string, b string")
    assert all(r["x"] == r["b"] for r in df.selectExpr("b", f"{folding.folded('a')} AS x").collect())


def test_link_variants(spark):
    rows = [
        ("Tufuziw ibn Raftan al-Jurtijtashi", [], None, "Person"), ("Tufuzwi ibn Raftan al-Jurtijtashi", None, None, "Person"), ("al-Jurtijtashi, Tufuziw ibn Raftan", [""], None, "Person"),
        ("Tufuziw ibn Raftan al-Jurtijtashi", [], None, "Person"), ("T. ibn Raftan al-Jurtijtashi", [], None, "Child"), ("توفوزيو بن رافتان الجورتيجتشي", [], None, "Person"),
        ("Abu Zanjub al-Jurtijtashi", ["Tufuziw ibn Raftan al-Jurtijtashi", "le chef"], None, "Person"), ("Hidjus ibn Raftan al-Jurtijtashi", ["le chef"], None, "Person"),
        ("Banu Wazufmabuj", [], None, "Tribe"), ("Beni Wazufmabuj", [], None, "Group"), ("Banu Wazuf​mabuj", [], None, "Tribe"), ("Tufuziw", [], None, "City"), (None, None, None, "Person"), ("", [], None, "Person"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "name string, aliases array<string>, normalized_name string, type string, entity string")
    got = {tuple(r) for r in variants.variant_pairs(variants.link_variants(df)).collect()}
    person = sorted({r[0] for r in rows[:7]})
    tribe = sorted({r[0] for r in rows[8:11]})
    assert got == {(a, b) for g in (person, tribe) for a in g for b in g if a < b}
    assert variants.variant_pairs(variants.link_variants(df.limit(0))).count() == 0


def test_nickname_is_whose_records_name_it(spark):
    main, strays = "Tufuziw ibn Raftan al-Jurtijtashi", ["Hidjus ibn Kallubar al-Rakdifbizi", "Sambin ibn Zulfit al-Tatshuswani"]
    rows = [(main, ["Dhu l-Zanjubarif", f"x{n}"], None, "Person") for n in range(8)] + [(s, ["Dhu l-Zanjubarif"], None, "Person") for s in strays]
    rows += [("Dhu l-Zanjubarif", [], None, "Person"), ("Dhu l-Zanjubaruf", [strays[0]], None, "Person")]  # another's nickname, one letter apart
    rows += [(n, ["le chef"], None, "Person") for n in (main, *strays, "Dulbaz ibn Ghumakad al-Shilbuziti")] + [("le chef", [], None, "Person")]  # nobody's own
    df = spark.createDataFrame(rows, "name string, aliases array<string>, normalized_name string, type string")
    got = {tuple(r) for r in variants.variant_pairs(variants.link_variants(df)).collect()}
    assert got == {("Dhu l-Zanjubarif", main), ("Dhu l-Zanjubaruf", strays[0])}
