"""String similarities and the phonetic key. Python only where no built-in computes the same number."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def gestalt(a: str | None, b: str | None) -> float:
    """Gestalt pattern ratio, 0 if either is blank. It is not symmetric: give the arguments in a fixed order."""
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def lcs_ratio(a: str | None, b: str | None) -> float:
    """2 * longest common subsequence / total length; 0 if either is blank. Bits of an integer hold a row of the table."""
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def _pairwise(score):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


def gestalt_column(a: Column, b: Column) -> Column:
    return F.pandas_udf(_pairwise(gestalt), DoubleType())(a, b)


def lcs_ratio_column(a: Column, b: Column) -> Column:
    return F.pandas_udf(_pairwise(lcs_ratio), DoubleType())(a, b)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if either is null, empty or all zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


_VOWELS = "AEIOUY"


def metaphone(word: str | None, length: int = 4) -> str:
    """Primary double metaphone key of up to ``length`` letters; '' for null and blank."""
    if not word or not word.strip():
        return ""
    w = word.strip().upper()
    n, last = len(w), len(w) - 1
    slavic = "W" in w or "K" in w or "CZ" in w or "WITZ" in w
    i = 1 if w[:2] in ("GN", "KN", "PN", "WR", "PS") else 0
    out = ""
    has = lambda at, *parts: at >= 0 and any(w.startswith(p, at) for p in parts)
    at = lambda k: w[k] if 0 <= k < n else ""
    vowel = lambda k: at(k) != "" and at(k) in _VOWELS
    while len(out) < length and i < n:
        c = w[i]
        if c in _VOWELS:
            out, i = out + ("A" if i == 0 else ""), i + 1
        elif c == "B":
            out, i = out + "P", i + (2 if at(i + 1) == "B" else 1)
        elif c in "Çç":
            out, i = out + "S", i + 1
        elif c == "C":
            code, step = _c(w, i, has, at, vowel)
            out, i = out + code, i + step
        elif c == "D":
            if has(i, "DG"):
                soft = at(i + 2) in ("I", "E", "Y") and at(i + 2)
                out, i = out + ("J" if soft else "TK"), i + (3 if soft else 2)
            else:
                out, i = out + "T", i + (2 if has(i, "DT", "DD") else 1)
        elif c == "F":
            out, i = out + "F", i + (2 if at(i + 1) == "F" else 1)
        elif c == "G":
            code, step = _g(w, i, slavic, has, at, vowel)
            out, i = out + code, i + step
        elif c == "H":
            if (i == 0 or vowel(i - 1)) and vowel(i + 1):
                out, i = out + "H", i + 2
            else:
                i += 1
        elif c == "J":
            if has(i, "JOSE") or w.startswith("SAN "):
                spanish = i == 0 and at(4) == " " or n == 4 or w.startswith("SAN ")
                out, i = out + ("H" if spanish else "J"), i + 1
            else:
                if i == 0:
                    out += "J"
                elif vowel(i - 1) and not slavic and at(i + 1) in ("A", "O") and at(i + 1):
                    out += "J"
                elif i == last:
                    out += "J"
                elif at(i + 1) not in tuple("LTKSNMBZ") and at(i - 1) not in ("S", "K", "L"):
                    out += "J"
                i += 2 if at(i + 1) == "J" else 1
        elif c == "K":
            out, i = out + "K", i + (2 if at(i + 1) == "K" else 1)
        elif c == "L":
            out, i = out + "L", i + (2 if at(i + 1) == "L" else 1)
        elif c == "M":
            double = at(i + 1) == "M" or has(i - 1, "UMB") and (i + 1 == last or has(i + 2, "ER"))
            out, i = out + "M", i + (2 if double else 1)
        elif c == "N":
            out, i = out + "N", i + (2 if at(i + 1) == "N" else 1)
        elif c == "Ñ":
            out, i = out + "N", i + 1
        elif c == "P":
            if at(i + 1) == "H":
                out, i = out + "F", i + 2
            else:
                out, i = out + "P", i + (2 if at(i + 1) in ("P", "B") and at(i + 1) else 1)
        elif c == "Q":
            out, i = out + "K", i + (2 if at(i + 1) == "Q" else 1)
        elif c == "R":
            silent = i == last and not slavic and has(i - 2, "IE") and not has(i - 4, "ME", "MA")
            out, i = out + ("" if silent else "R"), i + (2 if at(i + 1) == "R" else 1)
        elif c == "S":
            code, step = _s(w, i, last, slavic, has, at, vowel)
            out, i = out + code, i + step
        elif c == "T":
            if has(i, "TION", "TIA", "TCH"):
                out, i = out + "X", i + 3
            elif has(i, "TH", "TTH"):
                hard = has(i + 2, "OM", "AM") or w.startswith(("VAN ", "VON ", "SCH"))
                out, i = out + ("T" if hard else "0"), i + 2
            else:
                out, i = out + "T", i + (2 if at(i + 1) in ("T", "D") and at(i + 1) else 1)
        elif c == "V":
            out, i = out + "F", i + (2 if at(i + 1) == "V" else 1)
        elif c == "W":
            if has(i, "WR"):
                out, i = out + "R", i + 2
            elif i == 0 and (vowel(1) or has(i, "WH")):
                out, i = out + "A", i + 1
            elif i == last and vowel(i - 1) or has(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or w.startswith("SCH"):
                i += 1
            elif has(i, "WICZ", "WITZ"):
                out, i = out + "TS", i + 4
            else:
                i += 1
        elif c == "X":
            if i == 0:
                out, i = out + "S", i + 1
            else:
                quiet = i == last and (has(i - 3, "IAU", "EAU") or has(i - 2, "AU", "OU"))
                out, i = out + ("" if quiet else "KS"), i + (2 if at(i + 1) in ("C", "X") and at(i + 1) else 1)
        elif c == "Z":
            if at(i + 1) == "H":
                out, i = out + "J", i + 2
            else:
                out, i = out + "S", i + (2 if at(i + 1) == "Z" else 1)
        else:
            i += 1
    return out[:length]


def _c(w, i, has, at, vowel) -> tuple[str, int]:
    if has(i, "CHIA") or i > 1 and not vowel(i - 2) and has(i - 1, "ACH") and at(i + 2) != "I" and (at(i + 2) != "E" or has(i - 2, "BACHER", "MACHER")):
        return "K", 2
    if i == 0 and has(i, "CAESAR"):
        return "S", 2
    if has(i, "CH"):
        if i > 0 and has(i, "CHAE"):
            return "K", 2
        greek = i == 0 and (has(1, "HARAC", "HARIS") or has(1, "HOR", "HYM", "HIA", "HEM")) and not has(0, "CHORE")
        german = w.startswith(("VAN ", "VON ", "SCH")) or has(i - 2, "ORCHES", "ARCHIT", "ORCHID") or at(i + 2) in ("T", "S") and at(i + 2)
        liquid = (at(i - 1) in ("A", "O", "U", "E") and at(i - 1) or i == 0) and (at(i + 2) in tuple("LRNMBHFVW ") and at(i + 2) or i + 1 == len(w) - 1)
        if greek or german or liquid:
            return "K", 2
        return ("K" if i > 0 and w.startswith("MC") else "X"), 2
    if has(i, "CZ") and not has(i - 2, "WICZ"):
        return "S", 2
    if has(i + 1, "CIA"):
        return "X", 3
    if has(i, "CC") and not (i == 1 and w[0] == "M"):
        if at(i + 2) in ("I", "E", "H") and at(i + 2) and not has(i + 2, "HU"):
            return ("KS" if i == 1 and at(i - 1) == "A" or has(i - 1, "UCCEE", "UCCES") else "X"), 3
        return "K", 2
    if has(i, "CK", "CG", "CQ"):
        return "K", 2
    if has(i, "CI", "CE", "CY"):
        return "S", 2
    if has(i + 1, " C", " Q", " G"):
        return "K", 3
    return "K", (2 if at(i + 1) in ("C", "K", "Q") and at(i + 1) and not has(i + 1, "CE", "CI") else 1)


def _g(w, i, slavic, has, at, vowel) -> tuple[str, int]:
    if at(i + 1) == "H":
        if i > 0 and not vowel(i - 1):
            return "K", 2
        if i == 0:
            return ("J" if at(2) == "I" else "K"), 2
        if at(i - 2) in ("B", "H", "D") and i > 1 or at(i - 3) in ("B", "H", "D") and i > 2 or at(i - 4) in ("B", "H") and i > 3:
            return "", 2
        if i > 2 and at(i - 1) == "U" and at(i - 3) in ("C", "G", "L", "R", "T"):
            return "F", 2
        return ("K" if at(i - 1) != "I" else ""), 2
    if at(i + 1) == "N":
        if i == 1 and vowel(0) and not slavic:
            return "KN", 2
        if not has(i + 2, "EY") and at(i + 1) != "Y" and not slavic:
            return "N", 2
        return "KN", 2
    if has(i + 1, "LI") and not slavic:
        return "KL", 2
    if i == 0 and (at(1) == "Y" or has(1, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
        return "K", 2
    if (has(i + 1, "ER") or at(i + 1) == "Y") and not w.startswith(("DANGER", "RANGER", "MANGER")) and at(i - 1) not in ("E", "I") and not has(i - 1, "RGY", "OGY"):
        return "K", 2
    if at(i + 1) in ("E", "I", "Y") and at(i + 1) or has(i - 1, "AGGI", "OGGI"):
        return ("K" if w.startswith(("VAN ", "VON ", "SCH")) or has(i + 1, "ET") else "J"), 2
    return "K", (2 if at(i + 1) == "G" else 1)


def _s(w, i, last, slavic, has, at, vowel) -> tuple[str, int]:
    if has(i - 1, "ISL", "YSL"):
        return "", 1
    if i == 0 and has(i, "SUGAR"):
        return "X", 1
    if has(i, "SH"):
        return ("S" if has(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else "X"), 2
    if has(i, "SIO", "SIA") or has(i, "SIAN"):
        return "S", 3
    if i == 0 and at(1) in ("M", "N", "L", "W") and at(1) or at(i + 1) == "Z":
        return "S", (2 if at(i + 1) == "Z" else 1)
    if has(i, "SC"):
        if at(i + 2) == "H":
            if has(i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                return ("X" if has(i + 3, "ER", "EN") else "SK"), 3
            return "X", 3
        return ("S" if at(i + 2) in ("I", "E", "Y") and at(i + 2) else "SK"), 3
    quiet = i == last and has(i - 2, "AI", "OI")
    return ("" if quiet else "S"), (2 if at(i + 1) in ("S", "Z") and at(i + 1) else 1)


def metaphone_column(text: Column) -> Column:
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda x: metaphone(x), na_action=None)

    return F.pandas_udf(run, StringType())(text)
