"""Search keys of word forms: what differs in writing but not in the word is folded away.

Spark has no Unicode normalization, so this is the one text function that runs
in Python, batch by batch through Arrow; apply it to distinct forms.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Apostrophes that count as one, and languages with u/v and i/j as one letter each.
APOSTROPHES = "'’ʼ᾽′΄"
LATIN = ("la", "lat")
_LATIN_LETTERS = str.maketrans("jv", "iu")


def fold_text(text: str | None, lang: str | None, strip_marks: bool) -> str | None:
    """Canonical letters in lower case; grave counts as acute, tilde as circumflex, final sigma as sigma."""
    if text is None:
        return None
    if text.isascii():  # nothing to decompose
        return text.lower().translate(_LATIN_LETTERS) if lang in LATIN else text.lower()
    letters = []
    for c in unicodedata.normalize("NFD", text):
        if c in APOSTROPHES:
            letters.append("'")
        elif not unicodedata.category(c).startswith("M"):
            letters.append(c)
        elif not strip_marks:
            letters.append({"̀": "́", "̃": "͂"}.get(c, c))
    folded = "".join(letters).lower().replace("ς", "σ")
    if lang in LATIN:
        folded = folded.translate(_LATIN_LETTERS)
    return unicodedata.normalize("NFC", folded)


@F.arrow_udf(T.StringType())
def _folded(texts: pa.Array, langs: pa.Array, strip: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), langs.to_pylist(), strip.to_pylist(), strict=True)
    return pa.array([fold_text(t, lang, s) for t, lang, s in rows], pa.string())


def match_key(text: Column, lang: Column) -> Column:
    """Keeps accents, except in Latin."""
    return _folded(text, lang, lang.isin(*LATIN))


def loose_key(text: Column, lang: Column) -> Column:
    """Without accents and breathings."""
    return _folded(text, lang, F.lit(True))


def facet_key(text: Column) -> Column:
    """Accents and case folded, for substring filters."""
    return _folded(text, F.lit(""), F.lit(True))


def guess_language(text: Column) -> Column:
    """Greek if it has a Greek letter, else Latin."""
    return F.when(text.rlike("[Ͱ-Ͽἀ-῿]"), "grc").otherwise("la")


def is_punctuation(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[\p{P}\p{S}]+$"), F.lit(False))


def bare_word(text: Column) -> Column:
    """Without punctuation and symbols at its ends."""
    return F.regexp_replace(text, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")
