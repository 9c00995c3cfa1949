"""Folding of names to the form in which spellings are compared, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parameters, not values that must match anything: letters with marks, and letters of other scripts that print like a Latin one, by the plain letter they fold to.
FOLDS_TO = {
    "a": "àáâãäåāăąаα", "b": "ВΒ", "c": "çćčсС", "d": "ďđḍԁ", "e": "èéêëēĕėęěеЕΕ", "g": "ĝğġģ", "h": "ĥħḥһНΗ", "i": "ìíîïĩīĭįıіІιΙ", "j": "ĵјЈ",
    "k": "ķКΚ", "l": "ĺļľłḷ", "m": "МΜṁ", "n": "ñńņňΝṅ", "o": "òóôõöøōŏőоОοΟ", "p": "рРρΡ", "r": "ŕŗřṛ", "s": "śŝşšṣѕЅ", "t": "ţťŧṭТΤ",
    "u": "ùúûüũūŭůűų", "v": "ν", "w": "ŵ", "x": "хХΧ", "y": "ýÿŷуУΥ", "z": "źżžẓΖ", "ك": "ک", "ي": "یىئ", "ه": "ہەة", "ا": "أإآ",
}
# Words that stand for one another, by the word they fold to; '' for words without a meaning of their own.
SAME_WORD = {
    "jabal": "djebel jebel djabal gebel mount mont montagne جبل", "qasr": "ksar kasr qsar palais fort castle قصر", "suk": "souk souq suq soukh marche market سوق",
    "bir": "puits puit well بئر بير بءر", "wadi": "oued ouadi wady vallee valley وادي", "banu": "beni banou bani banoo بنو", "ibn": "bin ben b bn bint binte bent ibnat بن ابن بنت",
    "al": "el ul", "bataille": "bat combat battle ghazwat غزوه", "pacte": "traite pact treaty alliance", "exode": "exodus depart hijrat", "serment": "oath bay",
    "lettre": "letter", "registre": "register", "jument": "mare", "rite": "rites", "porte": "gate", "source": "spring", "plaine": "plain", "col": "pass",
    "abu": "abou abi ابو", "umm": "oum um oumm ام", "dhu": "dhou dou zu ذو",
    "": "de of des du at prete sayyid cheikh sheikh shaykh hajj imam ra tribe tribu clan les the le la",
}
# Spellings of one sound, applied in this order.
SAME_SOUND = (("ou", "u"), ("oo", "u"), ("ee", "i"), ("ie", "i"), ("dj", "j"), ("ch", "sh"), ("kh", "k"), ("q", "k"), ("c", "k"), ("dh", "d"), ("o", "u"), ("e", "a"), ("y", "i"))
# Arabic letters by the consonant, or long vowel, that is written for them in Latin letters.
ARABIC = "ابتثجحخدذرزسشصضطظعغفقكلمنهويءؤ"
LATIN_ = "_bttjhkddrzsSsdtzaGfkklmnhwy__"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words(sql: str) -> str:
    """Lower case, without marks, invisible characters or punctuation, single spaces; look-alike letters are Latin."""
    wide, thin = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94))
    marked, plain = "".join(FOLDS_TO.values()), "".join(k * len(v) for k, v in FOLDS_TO.items())
    x = f"translate(lower(translate({sql}, {_quoted(wide + marked)}, {_quoted(thin + plain)})), {_quoted(marked)}, {_quoted(plain)})"
    x = f"regexp_replace({x}, r'[\\p{{Mn}}\\p{{Cf}}]', '')"
    return f"trim(regexp_replace({x}, r'[^\\p{{L}}\\p{{N}}]+', ' '))"


def folded(sql: str) -> str:
    """The value as it is compared, as one expression; ``fold`` gives the same and computes each step once."""
    return _ending(sql, _plain(sql))


def fold(df: DataFrame, text: str, key: str) -> DataFrame:
    """The column ``key``: the value of the column ``text`` as it is compared. Arabic script gives '~' and the skeleton, see ``skeleton``.

    Words of one kind become one word, ibn and bint alike as an abbreviation leaves them open; spellings of one sound
    become one letter, doubled letters single; articles, forms of address, and what says that a place is a town, go; the
    part of a name that was put first goes back to the end. Null stays null; a value without letters becomes ''.
    """
    return df.withColumn("_plain", F.expr(_plain(text))).withColumn(key, F.expr(_ending(text, "_plain"))).drop("_plain")


def _plain(sql: str) -> str:
    """Words of one kind as one word, the parts of a name in order; before spellings of one sound are made one."""
    pairs = [(w, to) for to, same in SAME_WORD.items() for w in same.split()]
    table = "map(" + ", ".join(f"{_quoted(w)}, {_quoted(to)}" for w, to in pairs) + ")"
    x = f"regexp_replace({words(sql)}, r'\\bbi r\\b', 'bir')"
    x = f"regexp_replace({x}, r'^(?:l ancien |le chef )|(?: dit l ancien| la haute ville)$|^(?:ville|cite|city|town) (?:de|d|of) |^(?:madinat|مدينه) ', '')"
    x = f"regexp_replace({x}, r'\\b(?:d|a) (?!ibn |al )', '')"  # elided de, à; but an initial stays
    x = f"array_join(filter(transform(split({x}, ' '), t -> coalesce(try_element_at({table}, t), t)), t -> t <> ''), ' ')"
    for read, meant in (("^ibn ibn ", "b ibn "), (" ibn ibn ", " ibn b "), (" m \\d+$", "")):  # an initial B., a year of death
        x = f"regexp_replace({x}, r'{read}', '{meant}')"
    x = f"regexp_replace({x}, r'^(jabal|qasr|suk|bir|wadi) al ', '$1 ')"
    x = f"regexp_replace({x}, r'^(\\S{{3,}}?)(?:ibn|bint) (\\S+) al ', '$1 ibn $2 al ')"
    x = f"regexp_replace({x}, r'^ibn (\\S+)$|^(\\S+) banu$', 'banu $1$2')"
    x = f"regexp_replace({x}, r'^al (\\S+) (\\S+(?: ibn .+)?)$', '$2 al $1')"
    return f"regexp_replace({x}, r'^(\\S+) (\\S+ ibn \\S+)$', '$2 al $1')"


def _ending(sql: str, x: str) -> str:
    latin = x
    for spelled, sound in SAME_SOUND:
        latin = f"replace({latin}, '{spelled}', '{sound}')"
    latin = f"regexp_replace({latin}, r'(.)\\1+', '$1')"
    arabic = f"concat('~', {_bones(f'translate(regexp_replace({x}, {ARTICLE}, {EMPTY}), {_quoted(ARABIC)}, {_quoted(LATIN_)})')})"
    return f"CASE WHEN {sql} RLIKE r'\\p{{IsArabic}}' THEN {arabic} ELSE {latin} END"


ARTICLE, EMPTY = "r'(?<= |^)ال'", "''"


def _bones(sql: str) -> str:
    return f"regexp_replace(translate({sql}, 'ui_a ', 'wy'), r'(.)\\1+', '$1')"


def skeleton(fold: str) -> str:
    """'~' and the letters of a folded Latin value that Arabic script writes, in one word."""
    x = f"replace(replace(regexp_replace({fold}, r'(?<= |^)al ', ''), 'sh', 'S'), 'gh', 'G')"
    return f"concat('~', {_bones(x)})"
