"""Text units: splitting, headings, sampling, spatial assignment."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import SPACE, clean_heading, content_id, is_toc, strip
from ..joins import ranked
from ..schemas import GENERIC_HEADING


def line_units(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, unit_id, line): the non-blank lines of each text in order; unit_id is a hash of key and line and position."""
    lines = documents.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).filter(strip(F.col("line")) != "")
    return lines.withColumn("unit_id", content_id(F.concat_ws("|", F.col(key).cast("string"), F.col("pos").cast("string"), F.col("line"))))


def needs_ocr(pages: DataFrame, doc: str, page_no: str, text: str) -> DataFrame:
    """(doc, needs_ocr): true unless one of the first three pages has more than 50 characters."""
    first = pages.filter(F.col(page_no) < 3)
    return first.groupBy(doc).agg((~F.coalesce(F.bool_or(F.length(F.trim(text)) > 50), F.lit(False))).alias("needs_ocr"))


def needs_ocr_legacy(pages: DataFrame, doc: str, page_no: str, text: str, images: str) -> DataFrame:
    """(doc, needs_ocr): true if one of the first three pages has under 50 characters and an image."""
    poor = (F.length(F.coalesce(F.trim(text), F.lit(""))) < 50) & (F.col(images) >= 1)
    return pages.filter(F.col(page_no) < 3).groupBy(doc).agg(F.coalesce(F.bool_or(poor), F.lit(False)).alias("needs_ocr"))


def token_windows(documents: DataFrame, key: str, text: str, size: int = 900, overlap: int = 200) -> DataFrame:
    """(key, window, first, words, piece): windows of ``size`` words, each ``overlap`` words back from the end of the last."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    words = documents.select(key, F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "").alias("w")).filter("size(w) > 0")
    step = size - overlap
    starts = words.withColumn("window", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step).cast("int")))))
    piece = F.slice("w", F.col("window") * step + 1, F.lit(size))
    return starts.select(key, "window", (F.col("window") * step).alias("first"), F.size(piece).alias("words"), F.array_join(piece, " ").alias("piece"))


SEPARATORS = ("\n\n", "\n", "|", ". ", " ", "")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that occurs, finer ones within pieces that stay too
    long. A separator stays at the head of the piece it opens; neighbours share up to ``overlap`` characters of whole parts."""
    if len(text) <= size:
        return [text] if text else []
    sign = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sign) + 1 :] or ("",)
    if sign == "":
        return [text[i : i + size] for i in range(0, max(1, len(text) - overlap), max(1, size - overlap))]
    heads = text.split(sign)
    parts = [p for p in [heads[0], *(sign + h for h in heads[1:])] if p]
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if held:
            out.append("".join(held))

    for part in parts:
        if len(part) > size:
            close()
            held.clear()
            out.extend(split_text(part, size, overlap, finer))
            continue
        if sum(map(len, held)) + len(part) > size:
            close()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                held.pop(0)
        held.append(part)
    close()
    return out


def recursive_split(units: DataFrame, key: str = "unit_id", text: str = "text", heading: str = "heading", max_tokens: int = 1200, overlap: int = 150) -> DataFrame:
    """Units over max_tokens (counted as characters / 3) cut into sub-units with their flags; the others as they are.

    Output: parent_id, unit_id, part, text, heading, is_continuation, is_cut, is_table_continuation, is_table_cut.
    Sub-unit i > 0 has the id parent_s{i} and a heading marked as its continuation, of a table if it holds a bar. Row-local,
    no shuffle. Null texts count as empty and stay one unit.
    """
    size, back = max_tokens * 3, overlap * 3

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t, h in zip(batch["k"], batch["t"], batch["h"]):
                t = t or ""
                pieces = split_text(t, size, back) if len(t) > size else [t]
                for i, p in enumerate(pieces):
                    bar, table = "|" in p, "|" in t and "|" in p
                    mark = "" if i == 0 else f" (Suite Tableau {i})" if bar else f" (Suite {i})"
                    rows.append((k, k if i == 0 else f"{k}_s{i}", i, p, (h or "Sans titre") + mark, i > 0, i < len(pieces) - 1, table and i > 0, table and i < len(pieces) - 1))
            yield pd.DataFrame(rows, columns=["parent_id", "unit_id", "part", "text", "heading", "is_continuation", "is_cut", "is_table_continuation", "is_table_cut"])

    given = units.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(heading).alias("h"))
    return given.mapInPandas(run, "parent_id string, unit_id string, part int, text string, heading string, is_continuation boolean, is_cut boolean, is_table_continuation boolean, is_table_cut boolean")


def inherit_heading(units: DataFrame, doc: str, order: str, headings: str, titles: Column | None = None) -> DataFrame:
    """heading_refined: the unit's cleaned first heading, else that of the last unit before it that has one."""
    raw = F.coalesce(F.try_element_at(F.col(headings), F.lit(1)), F.lit(GENERIC_HEADING))
    own = clean_heading(raw, titles)
    valid = F.when(~own.isin(GENERIC_HEADING, "Contenu informatif"), own)
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return units.withColumn("heading_refined", F.coalesce(F.last(valid, ignorenulls=True).over(before), F.lit(GENERIC_HEADING)))


def inherit_path(units: DataFrame, doc: str, order: str, headings: str) -> DataFrame:
    """heading_path: the unit's list of headings, else the last non-empty one before it, else empty."""
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.when(F.size(headings) > 0, F.col(headings))
    return units.withColumn("heading_path", F.coalesce(F.last(own, ignorenulls=True).over(before), F.array().cast("array<string>")))


def numbered_titles(units: DataFrame, doc: str, title: str, order: str) -> DataFrame:
    """numbered: the title, with " (Suite n)" from its second time in the document on."""
    n = F.count("*").over(Window.partitionBy(doc, title).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return units.withColumn("numbered", F.when(n > 0, F.concat(F.col(title), F.lit(" (Suite "), n.cast("string"), F.lit(")"))).otherwise(F.col(title)))


def sample_ends(units: DataFrame, doc: str, order: str, each: int = 2) -> DataFrame:
    """The first, middle and last ``each`` units of a document; each unit once, though the ranges may overlap."""
    w = Window.partitionBy(doc)
    ranked = units.withColumn("_k", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    middle = F.floor(F.col("_n") / 2)
    return ranked.filter((F.col("_k") < each) | F.col("_k").between(middle, middle + each - 1) | (F.col("_k") >= F.col("_n") - each)).drop("_k", "_n")


def distinct_headings(units: DataFrame, doc: str, order: str, headings: str, most: int = 20) -> DataFrame:
    """(doc, heading, first): the first ``most`` different leaf headings of each document, in the order of appearance."""
    leaf = units.filter(F.size(headings) > 0).select(doc, F.col(order).alias("_o"), F.element_at(headings, -1).alias("heading")).filter("heading IS NOT NULL")
    seen = leaf.groupBy(doc, "heading").agg(F.min("_o").alias("first"))
    return seen.withColumn("_k", F.row_number().over(Window.partitionBy(doc).orderBy("first", "heading"))).filter(F.col("_k") <= most).drop("_k")


def toc_units(units: DataFrame, doc: str, order: str, headings: str, text: str, most: int = 3) -> DataFrame:
    """The first ``most`` different texts of each document that look like a table of contents."""
    found = units.filter(is_toc(F.col(headings), F.col(text))).groupBy(doc, text).agg(F.min(order).alias("first"))
    return found.withColumn("_k", F.row_number().over(Window.partitionBy(doc).orderBy("first"))).filter(F.col("_k") <= most).drop("_k")


def batches(rows: DataFrame, order: str, size: int = 22, partition: str | None = None) -> DataFrame:
    """batch: number of the group of ``size`` rows, in order, within the partition where one is given."""
    placed = ranked(rows, [partition] if partition else [], [F.col(order)], "_place")
    return placed.withColumn("batch", F.floor((F.col("_place") - 1) / size).cast("int")).drop("_place")


def bounding_box(items: DataFrame, chunk: str, top: str, bottom: str, page: str) -> DataFrame:
    """(chunk, top, bottom, pages): least top (0 if none), greatest bottom (1000 if none), sorted different pages."""
    return items.groupBy(chunk).agg(F.coalesce(F.min(top), F.lit(0.0)).alias("top"), F.coalesce(F.max(bottom), F.lit(1000.0)).alias("bottom"), F.array_sort(F.collect_set(page)).alias("pages"))


def assign_images(chunks: DataFrame, images: DataFrame, band: float = 100.0, least_share: float = 0.05) -> DataFrame:
    """(image_id, chunk_id): each image to the first chunk, by chunk_index, of its document on its page that is within
    ``band`` of its middle, or stands on one page only; images of no height beside the chunk's are part of a table.

    chunks: chunk_id, doc_id, chunk_index, pages, top, bottom; images: image_id, doc_id, page, top, bottom.
    """
    on = chunks.select("chunk_id", "doc_id", "chunk_index", F.explode("pages").alias("page"), F.size("pages").alias("_n"), F.col("top").alias("_t"), F.col("bottom").alias("_b"))
    near = F.expr(f"(top + bottom) / 2 BETWEEN _t - {band} AND _b + {band}") | (F.col("_n") == 1)
    tall = F.abs(F.col("bottom") - F.col("top")) / F.greatest(F.abs(F.col("_b") - F.col("_t")), F.lit(1e-9)) > least_share
    pairs = images.join(on, ["doc_id", "page"]).filter(near & tall)
    return pairs.groupBy("image_id").agg(F.min_by("chunk_id", F.struct("chunk_index", "chunk_id")).alias("chunk_id"))
