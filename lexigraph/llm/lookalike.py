"""One form for text that looks the same in print (problem 2)."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..joins import maybe_broadcast

# Letters of other scripts, and variants of a letter, that print like the letter they map to.
LOOKALIKE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "Һ": "H", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "ϳ": "j", "ϲ": "c",
    # Armenian, Latin
    "օ": "o", "ս": "u", "հ": "h", "ցּ": "g", "ɑ": "a", "ɡ": "g", "ı": "i",
    # Arabic letters of other languages
    "ک": "ك", "ی": "ي", "ى": "ي", "ہ": "ه", "ھ": "ه", "ە": "ه", "ۀ": "ه",
    # Dashes and apostrophes
    "‐": "-", "‑": "-", "‒": "-", "−": "-", "⁃": "-", "˗": "-", "’": "'", "ʼ": "'", "‘": "'", "′": "'",
}
#: Compatibility decompositions whose parts look like the whole; the others (superscripts, circles, fonts) show.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Format characters that print something.
SHOWN = set("؀؁؂؃؄؅۝܏࢐࢑࣢")
#: Text made of these alone, single spaced, is stable: the quick check that the JVM does.
_STABLE = "[!-~À-İĴ-ĿŁ-ňŊ-žƉ-ƏḀ-ẙ«»°،؛؟ء-غف-وي]+"
STABLE_TEXT = f"(?:{_STABLE}(?: {_STABLE})*)?"


@functools.cache
def _tables() -> tuple[dict[int, str], re.Pattern]:
    """What each character folds to ('' for invisible ones), and the pattern of an unstable segment with its context.

    Unstable is a character that folds, has a combining class, or fails or may fail the quick check of the composed form,
    that is one that is the second part of a canonical composition. The segment takes one stable character before it, the
    only one that an unstable character can compose with; the stable one after it starts anew.
    """
    fold = {ord(k): v for k, v in LOOKALIKE.items() if len(k) == 1}
    unstable = set(fold)
    for code in range(sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or 0x3400 <= code <= 0x9FFF or 0x20000 <= code < 0xE0000 or code >= 0xF0000:
            continue  # syllables and ideographs without decomposition, surrogates, unassigned planes
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind == "Cn":
            continue
        if ch.isspace() or kind == "Zs":
            fold[code] = " "
        elif kind == "Cc" or kind == "Cf" and ch not in SHOWN or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0):
            fold[code] = ""
        else:
            parts = unicodedata.decomposition(ch)
            if parts[:1] == "<" and parts.split(" ")[0] in SAME_LOOK:
                whole = unicodedata.normalize("NFKC", ch)
                fold.setdefault(code, "".join(LOOKALIKE.get(c, c) for c in whole))
            elif parts and not parts.startswith("<"):
                pieces = [int(x, 16) for x in parts.split()]
                if len(pieces) == 2:
                    unstable.add(pieces[1])
                if unicodedata.normalize("NFC", ch) != ch:
                    unstable.add(code)
            if unicodedata.combining(ch) or 0x1161 <= code <= 0x11C2:
                unstable.add(code)
    unstable |= {c for c, to in fold.items() if c != 0x20}
    ranges, codes = [], sorted(unstable)
    for code in codes:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    unit = "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in ranges)
    return fold, re.compile(f"(?s:.)?[{unit}]+")


def _segment(match: re.Match) -> str:
    text = unicodedata.normalize("NFD", match.group().translate(_tables()[0]))
    return unicodedata.normalize("NFC", "".join(LOOKALIKE.get(c, c) for c in text))


def canonical(text: str | None) -> str | None:
    """One form of all texts that look the same; null stays null, a text of invisible characters becomes ''.

    Wide, presentation and look-alike letters fold to the plain letter, accents compose, invisible characters vanish, any
    white space becomes one space, none outside. Case, visible accents and visibly other scripts stay. Applying it again
    changes nothing.
    """
    if text is None:
        return None
    done = _tables()[1].sub(_segment, text)
    if not unicodedata.is_normalized("NFC", done):  # a folded segment met another one
        done = unicodedata.normalize("NFC", done)
    return " ".join(done.split(" ")) if "  " not in done and done[:1] != " " and done[-1:] != " " else " ".join(done.split())


def _canonical_series(texts: pd.Series) -> pd.Series:
    seen: dict[str, str] = {}

    def one(x):
        if x is None or x not in seen:
            if x is None:
                return None
            seen[x] = canonical(x)
        return seen[x]

    return texts.map(one, na_action="ignore")


def canonical_text(text: Column) -> Column:
    """Column form of ``canonical``. Texts that pass the JVM's quick check never reach Python."""
    stable = text.rlike("^" + STABLE_TEXT + "$")
    return F.coalesce(F.when(stable, text), F.pandas_udf(_canonical_series, StringType())(F.when(~stable, text)))


def link_lookalikes(mentions: DataFrame, entries: DataFrame, mention_id: str, name: str, entry_id: str, title: str) -> DataFrame:
    """(mention_id, entry_id): mentions whose name looks like an entry's title without being the identical string.

    Null names and titles, and those without a visible character, link to nothing; a name that looks like the titles of
    several entries gives a row for each; re-delivered mentions give one. Extra columns are ignored. The entries are
    broadcast only up to a checked size.
    """
    left = mentions.select(F.col(mention_id).alias("_m"), F.col(name).alias("_n")).filter("_n is not null").withColumn("_k", canonical_text(F.col("_n"))).filter("_k <> ''")
    right = entries.select(F.col(entry_id).alias("_e"), F.col(title).alias("_t")).filter("_t is not null").withColumn("_k", canonical_text(F.col("_t"))).filter("_k <> ''")
    return left.join(maybe_broadcast(right), "_k").filter("_n <> _t").select(F.col("_m").alias(mention_id), F.col("_e").alias("entry_id")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/graph_extraction_raw.parquet")
    return link_lookalikes(raw, spark.read.parquet(f"{sf_dir}/encyclopedia.parquet"), "rec_id", "name", "id", "title")


def p2_one_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's name and each entry's title in the one form."""
    raw = spark.read.parquet(f"{sf_dir}/graph_extraction_raw.parquet").select(F.lit("mention").alias("kind"), F.col("rec_id").cast("string").alias("key"), canonical_text(F.col("name")).alias("one_form"))
    entries = spark.read.parquet(f"{sf_dir}/encyclopedia.parquet").select(F.lit("entry").alias("kind"), F.col("id").alias("key"), canonical_text(F.col("title")).alias("one_form"))
    return raw.unionByName(entries)


QUERIES = {"p2_found": p2_found, "p2_one_form": p2_one_form}
ORACLES: dict[str, str] = {}
