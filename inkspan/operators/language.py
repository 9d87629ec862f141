"""Language detection from function words (our definition)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import pieces_of, word_list

# Common function words per language.
PROFILES = {
    "da": ["af", "at", "den", "der", "det", "en", "er", "et", "for", "i", "ikke", "med", "og", "på", "som", "til"],
    "de": ["als", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu"],
    "en": ["an", "and", "are", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with"],
    "es": ["al", "con", "de", "del", "el", "en", "es", "la", "las", "los", "para", "por", "que", "se", "su", "un", "una", "y"],
    "fr": ["au", "aux", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "pour", "que", "qui", "sur", "un", "une"],
}


def _one_of(words: Iterable[str]):
    listed = sorted(set(words))
    return lambda w: w.isin(*listed)


def language_scores(docs: DataFrame, text: str = "text", profiles=None) -> DataFrame:
    """Add one ``hits_<lang>`` column per profile. Narrow: no explode and no shuffle.

    One regex pass per piece keeps the function words of any language; the lists are then counted
    in what is left.
    """
    profiles = profiles or PROFILES
    known = _one_of(w for words in profiles.values() for w in words)
    kept = F.flatten(F.transform(pieces_of(F.col(text)), lambda p: F.filter(word_list(p), known)))
    counts = {
        f"hits_{lang}": F.size(F.filter("_function_words", _one_of(words))) for lang, words in profiles.items()
    }
    return docs.withColumn("_function_words", kept).withColumns(counts).drop("_function_words")


def detect_language(docs: DataFrame, text: str = "text", profiles=None) -> DataFrame:
    """Add ``detected_lang`` and ``detected_probability``.

    The language with most function words wins (ties: alphabetical order); its probability is its
    share of all function words found. Texts without any get a null language and 0.
    """
    profiles = profiles or PROFILES
    langs = sorted(profiles)
    scored = language_scores(docs, text, profiles)
    best = F.greatest(*[F.col(f"hits_{x}") for x in langs])
    total = sum((F.col(f"hits_{x}") for x in langs), F.lit(0))
    winner = F.when(best == 0, F.lit(None).cast("string"))
    for lang in langs:
        winner = winner.when(F.col(f"hits_{lang}") == best, lang)
    return scored.withColumns(
        {
            "detected_lang": winner,
            "detected_probability": F.when(best == 0, F.lit(0.0)).otherwise(best / total),
        }
    ).drop(*[f"hits_{x}" for x in langs])
