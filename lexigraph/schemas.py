"""Record schemas and the fixed dimension tables of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ENTITY = (
    "id string, title string, type string, slug string, category string, description string, frequency int, source_ids array<string>, rank int, "
    "community_ids array<string>, attributes map<string,string>, canonical_id string, review_status string"
)
RELATIONSHIP = (
    "id string, source_id string, target_id string, source_slug string, target_slug string, description string, weight double, rank int, "
    "source_ids array<string>, attributes map<string,string>"
)
TEXT_UNIT = (
    "doc_id string, unit_id string, text string, headings array<string>, page_numbers array<int>, tables array<string>, image_urls array<string>, "
    "heading_full string, heading_refined string, chunk_index int, bbox struct<top: double, bottom: double>, is_continuation boolean, is_cut boolean, "
    "is_table_continuation boolean, is_table_cut boolean, parent_chunk_id string"
)
ENCYCLOPEDIA = (
    "id string, slug string, title string, type string, category string, core_summary string, "
    "properties struct<aliases: array<string>, nasab: string, phase: string>, review_status string, is_verified boolean"
)
COMMUNITY = (
    "id string, title string, level int, parent string, children array<string>, entity_ids array<string>, relationship_ids array<string>, "
    "text_unit_ids array<string>, covariate_ids map<string,array<string>>, attributes map<string,string>, size int, period string"
)
CONTEXT_CHUNK = (
    "chunk_id string, text_for_reranker string, heading_full string, page_numbers array<int>, visual_summary string, tables array<string>, "
    "images_urls array<string>, relevance_score double, source string, is_identity boolean"
)
QUERY_ANALYSIS = (
    "vector_query string, variants array<string>, keyword_query string, query_type string, confidence double, "
    "entities_mentioned array<struct<primary: string, variants: array<string>, type: string>>, temporal_indicators array<string>, reasoning string"
)

# Entity types as (name, value, category).
TYPES = (
    ("GOD", "God", "God"), ("PROPHET_MUHAMMAD", "Prophet", "Human"), ("MOTHER_OF_BELIEVERS", "MotherBeliever", "Human"), ("AHL_BAYT", "AhlBayt", "Human"),
    ("SAHABI", "Sahabi", "Human"), ("SAHABIYA", "Sahabiya", "Human"), ("CHILD", "Child", "Human"), ("OPPONENT", "Opponent", "Human"), ("PERSON", "Person", "Human"),
    ("CITY", "City", "Geographic"), ("PLACE", "Place", "Geographic"), ("LOCATION", "Location", "Geographic"), ("BATTLE", "Battle", "Event"), ("EVENT", "Event", "Event"),
    ("TRIBE", "Tribe", "Conceptual"), ("CONCEPT", "Concept", "Conceptual"), ("CONCEPT_RELIGIOUS", "Religious Concept", "Conceptual"), ("GROUP", "Group", "Conceptual"),
    ("DOCUMENT", "Document", "Object"), ("ANIMAL", "Animal", "Object"),
)
# Review states, lowest first.
REVIEW = ("NOT_KNOWN", "PENDING", "LLM_VALIDATED", "CORE_VALIDATED", "OFFICIAL")
# Heading of units that have none of their own.
GENERIC_HEADING = "Section générale"
# Prices in USD for a million prompt and completion tokens; models that are not listed cost as the first.
PRICES = (("mini", 0.15, 0.60), ("large", 5.0, 15.0))


def type_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TYPES, "name string, value string, category string")
