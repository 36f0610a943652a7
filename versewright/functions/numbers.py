"""Numbers in words, and words in the letters of an aligner.

A numeral is built from groups of three digits; each language says how a group is read
and how groups are joined.  Text is normalised word by word: signs and digits are
spoken, other scripts written in Latin letters, and what is not in the alphabet is left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LETTERS = "abcdefghijklmnopqrstuvwxyz'"
# Words for signs, and Latin letters for letters of other scripts.
SIGNS = {
    "de": {"&": " und ", "+": " plus ", "%": " prozent ", "$": " dollar ", "€": " euro "},
    "en": {"&": " and ", "+": " plus ", "%": " percent ", "$": " dollar ", "€": " euro "},
}
LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ı": "i", "’": "'", "`": "'", "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "'", "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia"}
EN = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
EN_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
DE = "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn".split()
DE_TENS = "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
FR = "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf".split()
FR_TENS = "vingt trente quarante cinquante soixante soixante quatre-vingt quatre-vingt".split()
ES = "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve".split()
ES_TENS = "treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()
ES_HUNDREDS = "ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos".split()
#: Numbers from here on are read digit by digit.
MOST = 10**12


def _english(n: int) -> str:
    if n < 20:
        return EN[n]
    if n < 100:
        return EN_TENS[n // 10 - 2] + (f"-{EN[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{EN[n // 100]} hundred" + (f" and {_english(n % 100)}" if n % 100 else "")
    for unit, name in ((10**9, "billion"), (10**6, "million"), (1000, "thousand")):
        if n >= unit:
            rest = n % unit
            return f"{_english(n // unit)} {name}" + (f" and {_english(rest)}" if 0 < rest < 100 else f", {_english(rest)}" if rest else "")
    raise AssertionError(n)


def _german(n: int, last: bool = True) -> str:
    """``last``: whether nothing follows, so that one is "eins"."""
    if n < 20:
        return "ein" if n == 1 and not last else DE[n]
    if n < 100:
        return (f"{_german(n % 10, False)}und" if n % 10 else "") + DE_TENS[n // 10 - 2]
    if n < 10**6:
        unit, name = (100, "hundert") if n < 1000 else (1000, "tausend")
        return _german(n // unit, False) + name + (_german(n % unit, last) if n % unit else "")
    unit, one, many = (10**6, "Million", "Millionen") if n < 10**9 else (10**9, "Milliarde", "Milliarden")
    head = f"eine {one}" if n // unit == 1 else f"{_german(n // unit)} {many}"
    return head + (f" {_german(n % unit)}" if n % unit else "")


def _french(n: int, last: bool = True) -> str:
    """``last``: whether nothing follows, so that vingt and cent take their plural."""
    if n < 20:
        return FR[n]
    if n < 100:
        tens, ones = divmod(n, 10)
        ones += 10 if tens in (7, 9) else 0
        head = FR_TENS[tens - 2]
        if not ones:
            return head + ("s" if n == 80 and last else "")
        return f"{head} et {FR[ones]}" if ones in (1, 11) and tens < 8 else f"{head}-{FR[ones]}"
    if n < 1000:
        hundreds, rest = divmod(n, 100)
        head = "cent" if hundreds == 1 else f"{FR[hundreds]} cent" + ("s" if not rest and last else "")
        return head + (f" {_french(rest, last)}" if rest else "")
    if n < 10**6:
        head = "mille" if n < 2000 else f"{_french(n // 1000, False)} mille"
        return head + (f" {_french(n % 1000, last)}" if n % 1000 else "")
    unit, name = (10**6, "million") if n < 10**9 else (10**9, "milliard")
    return f"{_french(n // unit)} {name}" + ("s" if n >= 2 * unit else "") + (f" {_french(n % unit)}" if n % unit else "")


def _spanish(n: int, last: bool = True) -> str:
    """``last``: whether nothing follows, so that one is "uno"."""
    if n < 30:
        return {1: "un", 21: "veintiún"}.get(n, ES[n]) if not last else ES[n]
    if n < 100:
        return ES_TENS[n // 10 - 3] + (f" y {_spanish(n % 10, last)}" if n % 10 else "")
    if n < 1000:
        return "cien" if n == 100 else ES_HUNDREDS[n // 100 - 1] + (f" {_spanish(n % 100, last)}" if n % 100 else "")
    if n < 10**6:
        head = "mil" if n < 2000 else f"{_spanish(n // 1000, False)} mil"
        return head + (f" {_spanish(n % 1000, last)}" if n % 1000 else "")
    head = "un millón" if n < 2 * 10**6 else f"{_spanish(n // 10**6, False)} millones"
    return head + (f" {_spanish(n % 10**6, last)}" if n % 10**6 else "")


SPELLERS: dict[str, Callable[[int], str]] = {"en": _english, "de": _german, "fr": _french, "es": _spanish}


def spelled(number: int, language: str = "en") -> str:
    """A number in words; languages without a grammar here are read in English, "einhundert" and "eintausend" at the begin without "ein"."""
    language = language.split("-")[0]
    if number >= MOST:
        return " ".join(spelled(int(d), language) for d in str(number))
    words = SPELLERS.get(language, _english)(number)
    return re.sub("^ein(hundert|tausend)", r"\1", words) if language == "de" else words


def latin(text: str) -> str:
    """Letters without accents, other scripts in Latin letters where LATIN has them."""
    out = "".join(c if c in LATIN else "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in text.lower())
    return "".join(LATIN.get(c, c) for c in out)


@lru_cache(maxsize=100_000)
def normalised(word: str, language: str = "en", letters: str = LETTERS) -> str:
    """A word as an aligner's letters spell it."""
    text = word.lower()
    for sign, spoken in SIGNS["de" if language.startswith("de") else "en"].items():
        text = text.replace(sign, spoken)
    text = re.sub(r"[0-9]+", lambda m: spelled(int(m[0]), language) if len(m[0]) < 13 else " ".join(spelled(int(d), language) for d in m[0]), text)
    return "".join(c for c in latin(text).lower() if c in letters)


def number_words(number: Column, language: Column) -> Column:
    """Numbers from 0 in words; null where either is null or the number is negative."""

    @F.pandas_udf(StringType())
    def spell(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for n, code in parts:
            yield pd.Series([None if c is None or x is None or x != x or x < 0 else spelled(int(x), c) for x, c in zip(n, code)], dtype=object)

    return spell(number, language)


def alignment_text(word: Column, language: Column) -> Column:
    """:func:`normalised` of a column of words; an unknown language counts as English."""

    @F.pandas_udf(StringType())
    def normalise(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for words, codes in parts:
            yield pd.Series([None if w is None else normalised(w, c if isinstance(c, str) else "en") for w, c in zip(words, codes)], dtype=object)

    return normalise(word, language)
