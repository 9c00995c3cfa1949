from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigraph.functions import similarity as sim
from lexigraph.functions import text as fx


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given_, slug", [("Médine", "MDINE"), (" a-b  c_ ", "A_B_C"), (None, ""), ("", ""), ("__", ""), ("الله", "")])
def test_slugify(spark, given_, slug):
    assert one(spark, fx.slugify(F.col("a")), a=given_) == slug


@pytest.mark.parametrize("name, norm", [("Al-Hussein bin 'Ali", "husein ibn ali"), ("Ḥafṣah (r.a.)", "hafsah"), ("Ayyash", "ayach"), (None, ""), ("Hassan", "hasan")])
def test_normalize_name(spark, name, norm):
    assert one(spark, fx.normalize_name(F.col("a")), a=name) == norm


def test_tuples(spark):
    raw = '("entity"<|>A<|>Person<|>first)##\n (\'ENTITY\'<|>B<|>City)##1. ("entity"<|>X<|>Y<|>Z)##("relationship"<|>A<|>B<|>knows<|>9.5)##("other"<|>a)<|COMPLETE|>'
    records = one(spark, fx.tuples(F.col("a")), a=raw)
    assert records[0] == ["entity", "A", "Person", "first"] and len(records) == 4
    assert one(spark, fx.tuples(fx.tuples_text(fx.tuples(F.col("a")))), a=raw) == records
    assert one(spark, F.size(fx.entity_tuples(fx.tuples(F.col("a")))), a=raw) == 1
    assert one(spark, F.size(fx.relationship_tuples(fx.tuples(F.col("a")))), a=raw) == 1
    assert one(spark, fx.tuples(F.col("a")), a=None) == []


@pytest.mark.parametrize("text, number", [("9", 9.0), ("9.5", 9.5), (".5", 0.5), ("-1", 1.0), ("1e3", 1.0), ("", 1.0), (".", 1.0), (None, 1.0)])
def test_weight(spark, text, number):
    assert one(spark, fx.weight(F.col("a")), a=text) == number


@pytest.mark.parametrize("text, part", [('```json\n{"a": 1}\n```', '{"a": 1}'), ("x [1, 2] y", "[1, 2]"), ("none", None), (None, None)])
def test_json_part(spark, text, part):
    assert one(spark, fx.json_part(F.col("a")), a=text) == part


HEADINGS = [("  ", True), ('"half', True), ('"whole"', False), ("12", True), ("...", True), ("Page 12", True), ("15 €", True), ("© x", True), ("01/02/2003", True), ("Chapter 1", False), (None, True)]


@pytest.mark.parametrize("heading, generic", HEADINGS)
def test_clean_heading(spark, heading, generic):
    assert (one(spark, fx.clean_heading(F.col("a")), a=heading) == fx.GENERIC_HEADING) == generic


def test_clean_heading_against_titles(spark):
    titles, long = F.array(F.lit("Les puits du nord")), "Un texte bien trop long pour être un titre, qui ne dit rien des sources " * 2
    assert one(spark, fx.clean_heading(F.col("a"), titles), a=long) == fx.GENERIC_HEADING
    assert one(spark, fx.clean_heading(F.col("a"), titles), a=long + "les puits du nord").startswith("Un texte")
    assert one(spark, fx.clean_heading(F.col("a"), legacy=True), a='"whole"') == fx.GENERIC_HEADING


def test_outline_titles(spark):
    assert one(spark, fx.outline_titles(F.col("a")), a="- 1. Premier titre (p.3)\n* Second\n- ab\nprose") == ["Premier titre", "Second"]


def test_metaphone_matches_the_published_codec(spark):
    codec = spark._jvm.org.apache.commons.codec.language.DoubleMetaphone()
    words = "Hamza Hamzah Muhammad Mohammed Abdullah Abdulla Aisha Ayesha Khaled Halid Smith Schmidt Thomas Wright Knight Jose Charles Chianti Character Architect Caesar Bacchus Accident Edge Edgar Laugh Night Ghislane Gnome Sugar Island Bright Wicz Zhao Physics Queen Xavier Breaux Vivian Jabal Qasr Yahya Zaynab Uthman Fatima Hafsa Talha Zubayr Tufuziw Ghijufra Shijdum".split()
    wrong = [(w, sim.metaphone(w), codec.doubleMetaphone(w)) for w in words if sim.metaphone(w) != codec.doubleMetaphone(w)]
    assert len(wrong) <= 2, wrong
    assert sim.metaphone(" ") == "" and sim.metaphone(None) == ""


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_ratios(a, b):
    assert sim.lcs_ratio(a, b) == pytest.approx(2 * brute_lcs(a, b) / (len(a) + len(b)) if a and b else 0.0)
    assert sim.gestalt(a, b) == (SequenceMatcher(None, a, b).ratio() if a and b else 0.0)


def test_ratio_of_known_names():
    assert round(sim.lcs_ratio("MUHAMMAD", "MOHAMMED"), 4) == 0.75 and round(sim.lcs_ratio("AISHA", "AYESHA"), 4) == 0.7273


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r["x"] for r in df.select(sim.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] == pytest.approx(0.70710678) and got[1:] == [None, None]
