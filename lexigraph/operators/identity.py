"""Identity cards of documents: outline, samples, fallback text; and the context of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip

# Words that head a table of contents.
OUTLINE_WORDS = ("sommaire", "table des matières", "table of contents", "plan du document", "contenu")


def _outline_in(lines: Column) -> Column:
    """The up to 59 lines behind the first short line with an outline word that has four or more entries behind it; else null."""
    heads = F.filter(
        F.transform(lines, lambda x, i: F.when((F.length(strip(x)) < 50) & F.lower(x).rlike("|".join(OUTLINE_WORDS)), i)), lambda i: i.isNotNull()
    )
    behind = F.transform(heads, lambda i: F.transform(F.filter(F.slice(lines, i + 2, F.lit(59)), lambda x: (strip(x) != "") & (F.length(x) > 3)), strip))
    return F.try_element_at(F.filter(behind, lambda b: F.size(b) > 3), F.lit(1))


def outline(text: Column, headings: Column) -> Column:
    """Struct type, content: OFFICIEL with the lines behind an outline word in the first or last 200 lines, ESTIMÉ with up to 40
    headings under 150 characters, else ABSENT."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    tail = F.when(F.size(lines) > 200, F.slice(lines, F.size(lines) - 199, F.lit(200))).otherwise(F.array().cast("array<string>"))
    found = F.coalesce(_outline_in(F.slice(lines, 1, 200)), _outline_in(tail))
    short = F.slice(F.filter(F.transform(F.coalesce(headings, F.array().cast("array<string>")), strip), lambda h: (h != "") & (F.length(h) < 150)), 1, 40)
    kind = F.when(found.isNotNull(), "OFFICIEL").when(F.size(short) > 0, "ESTIMÉ").otherwise("ABSENT")
    content = F.when(found.isNotNull(), F.array_join(found, "\n")).when(F.size(short) > 0, F.array_join(F.transform(short, lambda h: F.concat(F.lit("- "), h)), "\n")).otherwise("")
    return F.struct(kind.alias("type"), content.alias("content"))


def sample_paragraphs(text: Column, most: int = 10000, each: int = 20, sign: str = "\n\n") -> Column:
    """The text, or of a longer one its first, middle and last ``each`` paragraphs, cut to ``most`` characters."""
    p = F.split(text, sign)
    middle = F.floor(F.size(p) / 2).cast("int")
    first, last = F.slice(p, 1, each), F.slice(p, F.greatest(F.lit(1), F.size(p) - each + 1), F.lit(each))
    mid = F.slice(p, F.greatest(F.lit(1), middle - each // 2 + 1), F.lit(each))
    joined = F.concat_ws("\n\n[...]\n\n", F.array_join(first, sign), F.array_join(mid, sign), F.array_join(last, sign))
    return F.when(F.length(text) <= most, text).otherwise(F.substring(joined, 1, most))


def fallback_card(title: Column, content: Column) -> Column:
    """The card of a document that no model described."""
    return F.concat_ws("\n", F.concat(F.lit("TITRE: "), F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("Titre non détecté"))), F.lit("STRUCTURE:"), F.concat(F.lit("- "), F.regexp_replace(F.coalesce(content, F.lit("")), r"\. ", ".\n- ")))


def card_context(units: DataFrame, doc: str, order: str, text: str, headings: str) -> DataFrame:
    """(doc, context): outline headings and the 2 + 2 + 2 sampled texts of each document, as a model would be given them."""
    from .units import distinct_headings, sample_ends

    outline_ = distinct_headings(units, doc, order, headings).groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "heading"))), lambda x: x["heading"]), "\n").alias("outline"))
    texts = sample_ends(units, doc, order).groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: F.coalesce(x["t"], F.lit(""))), "\n\n").alias("sample"))
    return texts.join(outline_, doc, "left").select(doc, F.concat_ws("\n\n", "outline", "sample").alias("context"))


def rewritten(answer: Column) -> Column:
    """Struct v1, v2, v3, keywords of a rewriting's lines "V1: ...", ""; '' where a line is missing."""
    part = lambda k: F.trim(F.regexp_extract(F.coalesce(answer, F.lit("")), rf"(?m)^{k}:(.*)$", 1))
    return F.struct(part("V1").alias("v1"), part("V2").alias("v2"), part("V3").alias("v3"), part("KEYWORDS").alias("keywords"))


def answer_context(rows: DataFrame, order: str) -> DataFrame:
    """One row: the sources' texts with heading, pages and tables in order, and their different image addresses in order of appearance.

    The sources of one answer are few (top 20), so they are one window.
    """
    pages = F.array_join(F.transform(F.coalesce("chunk_page_numbers", F.array().cast("array<int>")), lambda p: p.cast("string")), ", ")
    tables = F.array_join(F.transform(F.coalesce("chunk_tables", F.array().cast("array<string>")), lambda t: F.concat(F.lit("[TABLE]\n"), t)), "\n")
    n = F.row_number().over(Window.orderBy(order))
    line = F.concat_ws("\n", F.concat(F.lit("[SOURCE "), n.cast("string"), F.lit("] "), F.coalesce("chunk_heading_full", F.lit("")), F.lit(" (p. "), pages, F.lit(")")), F.col("chunk_text"), F.nullif(tables, F.lit("")))
    listed = rows.select(n.alias("n"), line.alias("line"), F.coalesce("chunk_images_urls", F.array().cast("array<string>")).alias("images"))
    put = F.array_sort(F.collect_list(F.struct("n", "line", "images")))
    out = listed.agg(put.alias("s"))
    return out.select(F.array_join(F.transform("s", lambda x: x["line"]), "\n\n").alias("context"), F.array_distinct(F.flatten(F.transform("s", lambda x: x["images"]))).alias("images"))


def community_context(members: DataFrame, entities: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(level, community, context): of each community its most joined entities and its most frequent inner edges, for a report.

    members: node, level, community; entities: node, description; edges: source, target, description. ``most`` of each, as the
    context of a report is bounded; entities by their inner edges, edges by how often they are told, then by name.
    """
    by = ["level", "community"]
    at = lambda end: members.select(F.col("node").alias(end), *by)
    inner = edges.filter("source <> target").join(at("source"), "source").join(at("target"), ["target", *by])
    inner = inner.groupBy(*by, "source", "target").agg(F.count("*").alias("n"), F.min("description").alias("description"))
    joined = inner.select(*by, F.explode(F.array("source", "target")).alias("node"), "n").groupBy(*by, "node").agg(F.sum("n").alias("n"))
    top = lambda *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    names = members.select("node", *by).join(joined, [*by, "node"], "left").withColumn("k", top(F.desc_nulls_last("n"), "node")).filter(F.col("k") <= most).join(entities, "node", "left")
    told = lambda rows, line: rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    nodes = told(names, F.concat_ws(": ", "node", "description"))
    links = inner.withColumn("k", top(F.desc("n"), "source", "target")).filter(F.col("k") <= most)
    links = told(links, F.concat_ws(": ", F.concat_ws(" -> ", "source", "target"), "description")).withColumnRenamed("text", "links")
    return nodes.join(links, by, "left").select(*by, F.concat_ws("\n\n", "text", "links").alias("context"))


def reports(answers: DataFrame) -> DataFrame:
    """Community reports of answers {title, summary, rating, rating_explanation, findings: [{summary, explanation}]}; nulls where it fails."""
    from ..functions.text import json_part

    shape = "title string, summary string, rating double, rating_explanation string, findings array<struct<summary: string, explanation: string>>"
    return answers.withColumn("r", F.from_json(json_part(F.col("answer")), shape)).select(*[c for c in answers.columns if c != "answer"], "r.*")
