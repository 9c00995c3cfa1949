import datetime as dt
import random

from pyspark.sql import functions as F

from lexigraph.llm import groups, survivors


def test_groups_against_union_find(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(40)] + [(f"chain{i:02}", f"chain{i + 1:02}") for i in range(30)] + [("hub", f"leaf{i}") for i in range(30)]
    shown = [(f" {a.upper()} " if i % 3 == 0 else a, b) for i, (a, b) in enumerate(pairs)] + [(None, "lone"), ("lone", None), ("Self", "self "), ("  ", "blank"), ("b1", "a1"), ("a1", "B1")]
    got = groups.group_matches(spark.createDataFrame([(i, a, b, "x", "y") for i, (a, b) in enumerate(shown)], "pair_id long, left_name string, right_name string, node string, component string"))
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in [*pairs, ("a1", "b1")]:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert {tuple(r) for r in got.collect()} == {(x, find(x)) for x in up}


def test_groups_of_an_empty_table_and_records(spark):
    empty = spark.createDataFrame([], "left_name string, right_name string")
    assert groups.group_matches(empty).count() == 0
    found = spark.createDataFrame([("a", "a"), ("b", "a")], "normalized_name string, group_name string")
    records = spark.createDataFrame([(1, " B"), (2, "c"), (3, None)], "rec_id long, normalized_name string")
    assert {r["rec_id"]: r["group_name"] for r in groups.assign_groups(records, found).collect()} == {1: "a", 2: "c", 3: None}


SCHEMA = "rec_id long, normalized_name string, aliases array<string>, context_description string, confidence double, model string, updated_at timestamp_ntz, value string, quality double"
DAY = dt.datetime(2024, 1, 1)


def row(i, name, aliases=None, told=None, sure=None, day=0, model="m"):
    return (i, name, aliases, told, sure, model, DAY + dt.timedelta(days=day), "clash", 0.0)


def best(spark, rows):
    votes = survivors.long_votes(spark.createDataFrame(rows, SCHEMA), "normalized_name", "rec_id", "model", "updated_at", survivors.record_fields())
    return {(r["key"], r["field"]): r["rec_id"] for r in survivors.best_values(votes).collect()}


def test_best_value_of_each_field(spark):
    rows = [
        row(1, "a", ["X", " x ", "N/A", None, ""], "One thing done. | One thing done. | One thing done.", 1.5, 9),
        row(2, "a", ["X", "Y"], "One thing done. Another thing done.      ", 0.9, 1),
        row(3, "a", ["y", "z"], "Another thing done.\nOne thing done.", 0.9, 2),
        row(3, "a", ["y", "z"], "Another thing done.\nOne thing done.", 0.9, 2),
        row(4, "a", None, "à compléter", float("nan"), 30),
        row(5, "b", [], "...", None, 1), row(6, "b", None, None, -1.0, 2), row(7, None, ["q"], "Said so.", 1.0),
    ]
    got = best(spark, rows)
    assert {got["a", f] for f in ("aliases", "confidence", "context_description")} == {3}
    assert {got["b", f] for f in ("aliases", "confidence", "context_description")} == {6}  # nothing usable: the latest
    assert not any(k is None for k, _ in got)


def test_votes_add_up_and_empty_table(spark):
    rows = [row(1, "a", None, "Said x here.", 0.5, 0), row(2, "a", None, "Said y here.", 0.5, 5), row(3, "a", None, "said X here", 0.5, 1)]
    got = survivors.survivors(spark.createDataFrame(rows, SCHEMA)).first()
    assert survivors.statements is not None and got["context_description"].lower().startswith("said x")
    assert survivors.survivors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_statements(spark):
    df = spark.createDataFrame([("Il vit b. Ali. Il partit!\nIl  vit b. Ali",), ("TODO",), (None,)], "t string")
    assert [r["n"] for r in df.select(F.size(survivors.statements(F.col("t"))).alias("n")).collect()][:2] == [2, 0]
