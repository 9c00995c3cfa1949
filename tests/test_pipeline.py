import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lexigraph.plans import pipeline
from lexigraph.streaming import ingest as si


def rules(prompts):
    """Names of two capitalised words; those of one prompt that follow one another are related."""
    import re

    out = []
    for p in prompts:
        names = re.findall(r"[A-Z][a-z]+ [A-Z][a-z]+", p) if p.startswith("EXTRACT") else []
        pairs = zip(names, names[1:])
        out.append("##".join([f'("entity"<|>{n}<|>Person<|>in {n})' for n in names] + [f'("relationship"<|>{a}<|>{b}<|>meets<|>2)' for a, b in pairs]))
    return out


def test_documents_become_a_graph(spark):
    docs = spark.createDataFrame([(1, "then Abu Bakr met Umar Farooq."), (2, "and Abu Bakkr met Umar Farooq again, Umar Farooq."), (3, None)], "doc_id long, text string")
    entries = spark.createDataFrame([("UMAR_FAROOQ", "Human", (["x"],))], "slug string, category string, properties struct<aliases: array<string>>")
    units, entities, relations = pipeline.ingest(docs, rules, entries)
    assert units.count() == 3
    got = {r["id"]: (r["title"], r["frequency"]) for r in entities.collect()}
    assert got["UMAR_FAROOQ"] == ("Umar Farooq", 2) and len(got) == 2
    edges = relations.collect()
    assert len(edges) == 1 and edges[0]["target_id"] == "UMAR_FAROOQ" and edges[0]["weight"] == 4.0


def test_question_to_context(spark):
    chunks = spark.createDataFrame([("c1", "the well of badr"), ("c2", "umar at badr"), ("c3", "nothing here")], "chunk_id string, chunk_text string")
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.6, 0.8]), ("c3", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    links = spark.createDataFrame([("umar", "c2", 0.9), ("badr", "c1", 0.8), ("badr", "c2", 0.7)], "entity_id string, chunk_id string, relevance_score double")
    entities = spark.createDataFrame([("umar", [], 1, "the second"), ("badr", [], 2, "")], "entity string, aliases array<string>, chunk_count int, summary string")
    ask = lambda kind, *names: [r["chunk_id"] for r in pipeline.retrieve(pipeline.Analysis("badr", "badr", kind, 1.0, [[n] for n in names]), vectors, [1.0, 0.0], chunks, links, entities, 3).orderBy("position").collect()]
    assert ask("general")[0] == "c1"
    assert ask("overview", "umar")[0] == "summary_umar"
    assert ask("relationship", "umar", "badr")[0] == "c2"
    assert ask("general", "badr")[:2] == ["c1", "c2"]


def test_questions_are_checked_and_analysed():
    assert pipeline.check_question("  who? ") == ("who?", 15)
    for bad in (("", 15), ("x" * 501, 15), ("who?", 0), ("who?", 51)):
        with pytest.raises(ValueError):
            pipeline.check_question(*bad)
    told = pipeline.analyse("q", lambda p: [json.dumps({"query_type": "overview", "entities_mentioned": [{"primary": "A", "variants": ["B"]}]})])
    assert told.query_type == "overview" and told.entities == [["A", "B"]]
    assert pipeline.analyse("q", lambda p: ["no json"]).confidence == 0.12345


def test_stream_takes_each_content_once(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    for n, rows in enumerate([[(1, "a\nb", at), (2, "a\nb", at)], [(3, "a\nb", at), (4, "c", at), (5, None, at)]]):
        spark.createDataFrame(rows, "doc_id long, text string, created_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    stream = si.document_stream(spark, str(tmp_path / "in" / "*"), "doc_id long, text string, created_at timestamp", files=1)
    si.ingest(stream, str(tmp_path / "units"), str(tmp_path / "status"), str(tmp_path / "checkpoint")).awaitTermination()
    units = spark.read.parquet(str(tmp_path / "units"))
    assert sorted(r["line"] for r in units.collect()) == ["a", "b", "c"]
    assert {r["status"] for r in spark.read.parquet(str(tmp_path / "status")).collect()} == {"COMPLETED"}
    si.ingest(si.document_stream(spark, str(tmp_path / "in" / "*"), "doc_id long, text string, created_at timestamp"), str(tmp_path / "units"), str(tmp_path / "status"), str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "units")).count() == 3 and units.select(F.countDistinct("doc_id")).first()[0] == 2
