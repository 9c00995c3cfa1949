"""Scalar text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import GENERIC_HEADING, TYPES

SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: Where a word begins or ends; invisible joiners are no part of one.
EDGE = r"(?:(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_]))"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def slugify(text: Column) -> Column:
    """Upper case, only A-Z, 0-9, white space, _ and -, runs of space and - as one _, none at the ends; '' for null.

    Accented letters are deleted, not folded.
    """
    kept = F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), f"[^A-Z0-9{SPACE[1:-1]}_-]", "")
    return F.btrim(F.regexp_replace(kept, f"[{SPACE[1:-1]}-]+", "_"), F.lit("_"))


@functools.cache
def _unaccented() -> tuple[str, str]:
    """Characters whose canonical decomposition is one letter and marks, and those letters."""
    marked, bare = [], []
    for code in range(0xC0, min(sys.maxunicode, 0xFFFF)):
        if 0xAC00 <= code <= 0xDFFF:
            continue
        parts = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"]
        if len(parts) == 1 and parts[0] != chr(code):
            marked.append(chr(code))
            bare.append(parts[0])
    return "".join(marked), "".join(bare)


def strip_accents(text: Column) -> Column:
    marked, bare = _unaccented()
    return F.regexp_replace(F.translate(text, marked, bare), r"\p{Mn}", "")


def normalize_name(text: Column) -> Column:
    """The matching key of an entity name: case, accents, quotes, bracketed parts and spelling habits removed; '' for null."""
    x = strip_accents(F.lower(strip(F.coalesce(text, F.lit("")))))
    for pattern, to in (
        (r"['`´]", ""), (f"{SPACE}*\\([^)]*\\)", ""), ("[-_]", " "), (rf"{EDGE}bin{EDGE}", "ibn"), (rf"{EDGE}al{SPACE}+", ""), (rf"{EDGE}as{SPACE}+", ""),
        ("yy", "y"), ("ss", "s"), (f"sh{EDGE}", "ch"), (f"{SPACE}+", " "),
    ):
        x = F.regexp_replace(x, pattern, to)
    return strip(x)


def content_id(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def entity_id(title: Column, kind: Column) -> Column:
    return content_id(F.concat(title, F.lit("_"), kind))


def cache_key(messages: Column, model: Column | None = None, temperature: Column | None = None) -> Column:
    """Key of a model call; model and temperature are part of it, as answers differ by them."""
    parts = [F.to_json(messages)] + [c.cast("string") for c in (model, temperature) if c is not None]
    return F.concat(F.lit("llm_cache:"), F.sha2(F.concat_ws("\n", *parts), 256))


def type_category(kind: Column) -> Column:
    """Category of an entity type by its name, else by its value, any case and outer space; null if unknown or blank."""
    key = F.upper(strip(kind))
    names, values = {n: c for n, _, c in TYPES}, {v.upper(): c for _, v, c in TYPES}
    table = F.create_map(*[F.lit(x) for k, c in {**values, **names}.items() for x in (k, c)])
    return F.try_element_at(table, key)


def tuples(raw: Column) -> Column:
    """array<array<string>>: the bracketed records of a model answer, split at the delimiter <|> and unquoted.

    Blocks that do not begin with a bracket are skipped; one closing bracket is dropped; null gives an empty array.
    """
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"<\|COMPLETE\|>", "")
    blocks = F.filter(F.transform(F.split(text, "##"), strip), lambda b: b.startswith("("))
    inner = F.transform(blocks, lambda b: F.regexp_replace(F.substring(b, 2, 2_000_000_000), r"\)$", ""))
    return F.transform(inner, lambda b: F.transform(F.split(b, r"<\|>"), lambda p: F.btrim(F.btrim(strip(p), F.lit('"')), F.lit("'"))))


def tuples_text(records: Column) -> Column:
    """Inverse of ``tuples``."""
    return F.array_join(F.transform(records, lambda r: F.concat(F.lit("("), F.array_join(r, "<|>"), F.lit(")"))), "##")


def entity_tuples(records: Column) -> Column:
    return F.filter(records, lambda p: (F.lower(p[0]) == "entity") & (F.size(p) >= 4))


def relationship_tuples(records: Column) -> Column:
    return F.filter(records, lambda p: (F.lower(p[0]) == "relationship") & (F.size(p) >= 5))


def weight(text: Column) -> Column:
    """Digits with at most one dot, else 1.0; so signs and exponents give 1.0."""
    return F.when(text.rlike(r"^[0-9]*\.?[0-9]*$") & text.rlike("[0-9]"), text.cast("double")).otherwise(F.lit(1.0))


def json_part(text: Column) -> Column:
    """The outermost object or array of an answer, fences and prose around it left out; null if there is none."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    found = F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.nullif(found, F.lit(""))


def heading_path(headings: Column) -> Column:
    return F.array_join(headings, " > ")


def snippet(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(text, "\n", " "))
    return F.when(F.length(flat) > 300, F.concat(F.substring(flat, 1, 250), F.lit("..."))).otherwise(flat)


def reranker_text(visual: Column, heading: Column, text: Column) -> Column:
    """Visual and heading blocks where they say something, then the text, a blank line between."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    head = F.when(F.trim(heading) != "Sans titre", filled(heading))
    return F.concat_ws("\n\n", F.concat(F.lit("[VISUEL] "), filled(visual)), F.concat(F.lit("[SECTION] "), head), text)


def embedding_text(heading: Column, text: Column, visual: Column) -> Column:
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws("\n", F.concat(F.lit("# "), filled(heading)), text, F.concat(F.lit("[VISUAL DESCRIPTION] "), filled(visual)))


def is_markdown_table(text: Column) -> Column:
    return text.rlike(r"\|[- :]+\|")


# Words that mark a table of contents.
TOC_WORDS = (
    "table of contents", "toc", "contents", "outline", "index", "list of sections", "contents page", "plan", "agenda", "program", "schedule", "catalogue",
    "directory", "synopsis", "abstract", "compendium", "digest", "summary", "syllabus", "manual overview", "navigation page", "roadmap", "book map",
    "table des matières", "sommaire", "plan du document", "table des sections", "répertoire", "sommaire détaillé", "sommaire des chapitres",
    "liste des sections", "synthèse", "résumé", "synthèse préliminaire",
)


def is_toc(headings: Column, text: Column) -> Column:
    """A contents word in the headings or in the first 200 characters."""
    where = F.lower(F.concat_ws(" ", headings)), F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 200))
    return functools.reduce(lambda a, b: a | b, [w.contains(k) for w in where for k in TOC_WORDS])


# Headings that are noise: numbers, signs, page numbers, prices, copyright, dates.
HEADING_NOISE = (r"^\d+$", r"^[^\w\s]+$", r"(?i)^page\s*\d+$", r"^\d+\s*€$", r"^©.*$", r"^\d{2}/\d{2}/\d{4}$")
QUOTES_OPEN, QUOTES_CLOSE = ('"', "«", "“"), ('"', "»", "”")


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", "")


def clean_heading(heading: Column, titles: Column | None = None, legacy: bool = False) -> Column:
    """The heading, or GENERIC_HEADING where it is blank, a quotation, noise, or long and unlike every trusted title.

    By default a quotation is quoted at one end only, headings over 60 characters are held against any titles there are,
    and must contain one. The legacy form takes a quote at either end, over 56 characters, more than three titles, and
    containment either way. titles is an array column.
    """
    h = strip(F.coalesce(heading, F.lit("")))
    starts, ends = (functools.reduce(lambda a, b: a | b, x) for x in ([h.startswith(q) for q in QUOTES_OPEN], [h.endswith(q) for q in QUOTES_CLOSE]))
    bad = (h == "") | ((starts | ends) if legacy else (starts != ends))
    if titles is not None:
        within = F.exists(titles, lambda t: _bare(h).contains(_bare(t)) | ((_bare(t).contains(_bare(h))) if legacy else F.lit(False)))
        bad = bad | ((F.size(titles) > (3 if legacy else 0)) & (F.length(h) > (56 if legacy else 60)) & ~within)
    noise = functools.reduce(lambda a, b: a | b, [h.rlike("(?U)" + p) for p in HEADING_NOISE])
    return F.when(bad | noise, F.lit(GENERIC_HEADING)).otherwise(h)


def outline_titles(outline: Column) -> Column:
    """Titles of an outline's bullet lines, without numbering and page; those of up to three characters are left out."""
    lines = F.transform(F.split(F.coalesce(outline, F.lit("")), "\n"), strip)
    found = F.transform(lines, lambda x: F.trim(F.regexp_extract(x, r"^[-*•]\s*(?:\d+[.)]\s*)?(.+?)(?:\s*\(p\.\d+\))?$", 1)))
    return F.filter(found, lambda t: F.length(t) > 3)


def relation_type(kind: Column) -> Column:
    """Upper case with _ for spaces; RELATED_TO for null and blank."""
    return F.coalesce(F.nullif(F.upper(F.regexp_replace(F.trim(kind), " ", "_")), F.lit("")), F.lit("RELATED_TO"))


def nan_to_null(number: Column) -> Column:
    return F.when(~F.isnan(number), number)


def flatten_message(parts: Column) -> Column:
    """Lines of a message given as parts {text}; blank parts are left out."""
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")


def candidate_line(slug: Column, name: Column, summary: Column, properties: Column) -> Column:
    """SLUG / Name / Summary / Properties of a candidate in one line; properties is a map."""
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), ", ")
    return F.concat_ws(" | ", F.concat(F.lit("SLUG: "), slug), F.concat(F.lit("Name: "), name), F.concat(F.lit("Summary: "), F.coalesce(summary, F.lit(""))), F.concat(F.lit("Properties: "), listed))


def document_context(title: Column, subject: Column, kind: Column, outline: Column) -> Column:
    """Labelled lines of an identity card, the outline's first five items joined."""
    return F.concat_ws("\n", F.concat(F.lit("TITLE: "), title), F.concat(F.lit("SUBJECT: "), subject), F.concat(F.lit("TYPE: "), kind), F.concat(F.lit("OUTLINE: "), F.array_join(F.slice(outline, 1, 5), " > ")))
