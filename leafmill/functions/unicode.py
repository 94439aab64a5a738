"""Transliteration of names, in Arrow batches: Unicode normal forms have no built-in function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from leafmill.functions.text import slug

#: Letters and signs that no decomposition takes to ASCII.
SPELLED = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "dj", "Đ": "DJ", "ł": "l", "Ł": "L", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D", "ı": "i",
    "$": "dollar", "%": "percent", "<": "less", ">": "greater", "|": "or", "¢": "cent", "£": "pound", "¤": "currency", "¥": "yen", "€": "euro", "©": "(c)", "®": "(r)", "ª": "a", "º": "o",
}
#: Spellings that a language has of its own.
SPELLED_IN = {
    "bg": {"Й": "Y", "Ц": "Ts", "Щ": "Sht", "Ъ": "A", "Ь": "Y", "й": "y", "ц": "ts", "щ": "sht", "ъ": "a", "ь": "y"},
    "de": {"Ä": "AE", "ä": "ae", "Ö": "OE", "ö": "oe", "Ü": "UE", "ü": "ue", "ß": "ss", "%": "prozent", "&": "und", "|": "oder", "∑": "summe", "∞": "unendlich", "♥": "liebe"},
    "es": {"%": "por ciento", "&": "y", "<": "menor que", ">": "mayor que", "|": "o", "¢": "centavos", "£": "libras", "¤": "moneda", "₣": "francos", "∑": "suma", "∞": "infinito", "♥": "amor"},
    "fr": {"%": "pourcent", "&": "et", "<": "plus petit", ">": "plus grand", "|": "ou", "¢": "centime", "£": "livre", "¤": "devise", "₣": "franc", "∑": "somme", "∞": "infini", "♥": "amour"},
    "pt": {"%": "porcento", "&": "e", "<": "menor", ">": "maior", "|": "ou", "¢": "centavo", "∑": "soma", "£": "libra", "∞": "infinito", "♥": "amor"},
    "uk": {"И": "Y", "и": "y", "Й": "Y", "й": "y", "Ц": "Ts", "ц": "ts", "Х": "Kh", "х": "kh", "Щ": "Shch", "щ": "shch", "Г": "H", "г": "h"},
    "vi": {"Đ": "D", "đ": "d"},
    "da": {"Ø": "OE", "ø": "oe", "Å": "AA", "å": "aa", "%": "procent", "&": "og", "|": "eller", "$": "dollar", "<": "mindre end", ">": "større end"},
    "nb": {"&": "og", "Å": "AA", "Æ": "AE", "Ø": "OE", "å": "aa", "æ": "ae", "ø": "oe"},
    "it": {"&": "e"},
    "nl": {"&": "en"},
    "sv": {"&": "och", "Å": "AA", "Ä": "AE", "Ö": "OE", "å": "aa", "ä": "ae", "ö": "oe"},
}


def transliterated(text: Column, locale: str | None = None) -> Column:
    """The text with signs spelled out and marks taken off letters; letters of other scripts stay.

    The function holds all that it needs, so that workers need not import this package.
    """
    spelling = str.maketrans(SPELLED | SPELLED_IN.get(locale or "", {}))

    def spelled(value: str) -> str:
        import unicodedata

        out = unicodedata.normalize("NFC", value).translate(spelling)
        return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", out) if not unicodedata.combining(c)))

    @pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(spelled, na_action="ignore")

    return run(text)


def slug_unicode(name: Column, locale: str | None = None) -> Column:
    """The slug of a name in any of the languages that decompose to ASCII letters."""
    return F.regexp_replace(slug(transliterated(name, locale)), r"[#*+~()'\"!:@]", "")


def slugify(text: Column, locale: str | None = None, replacement: str = "-", remove: str | None = None, lower: bool = False, strict: bool = False, trim: bool = True) -> Column:
    """A slug: signs spelled out as the locale does, what ``remove`` matches taken out, blanks as ``replacement``.

    ``remove`` is by default what is neither a letter, digit or blank nor one of ``$*_+~.()'"!-:@``; ``strict`` leaves
    letters and digits alone. A one-letter ``replacement`` in the text counts as a blank, also at its ends with ``trim``.
    Letters of scripts that neither decompose nor have a spelling are removed as other signs are.
    """
    spaced = F.translate(text, replacement, " ") if len(replacement) == 1 else text
    spelled = transliterated(F.replace(spaced, F.lit("&"), F.lit("and")) if "&" not in SPELLED_IN.get(locale or "", {}) else spaced, locale)
    kept = F.regexp_replace(spelled, remove or r"""[^A-Za-z0-9_\s$*+~.()'"!\-:@]+""", "")
    kept = F.regexp_replace(kept, r"[^A-Za-z0-9\s]", "") if strict else kept
    kept = F.regexp_replace(kept, r"^\s+|\s+$", "") if trim else kept
    joined = F.regexp_replace(kept, r"\s+", replacement.replace("\\", "\\\\").replace("$", "\\$"))
    return F.lower(joined) if lower else joined
