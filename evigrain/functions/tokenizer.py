"""Tokens for word search in six languages: folded, cut at apostrophes and signs, two-character grams of CJK runs, without stopwords."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a search leaves out, by language; any other language has those of English.
SEARCH_STOPWORDS = {
    "en": ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were", "will", "with", "this", "these", "those", "but", "not", "any", "all", "shall", "may", "if", "than"],
    "fr": ["le", "la", "les", "un", "une", "des", "de", "du", "et", "ou", "que", "qui", "dans", "pour", "par", "sur", "avec", "sans", "au", "aux", "ce", "ces", "cet", "cette", "il", "elle", "ils", "elles", "est", "sont", "ne", "pas", "se", "son", "sa", "ses", "l", "d", "qu", "n", "j", "m", "s", "t", "c"],
    "es": ["el", "la", "los", "las", "un", "una", "unos", "unas", "de", "del", "y", "o", "que", "en", "para", "por", "con", "sin", "al", "lo", "es", "son", "se", "su", "sus", "no", "si", "este", "esta", "estos", "estas", "ese", "esa", "esos", "esas"],
    "de": ["der", "die", "das", "den", "dem", "des", "ein", "eine", "einer", "eines", "einem", "einen", "und", "oder", "in", "im", "an", "am", "auf", "mit", "ohne", "von", "vom", "zu", "zur", "zum", "für", "ist", "sind", "war", "waren", "nicht", "auch", "wie", "als", "so"],
    "zh": ["的", "了", "和", "是", "在", "也", "都", "及", "或", "与", "为", "对", "从", "向", "由", "把", "被"],
    "ar": ["في", "من", "إلى", "على", "عن", "مع", "هذا", "هذه", "ذلك", "تلك", "هو", "هي", "هم", "أن", "إن", "كان", "كانت", "لا", "ما", "و", "أو", "ثم", "كل", "بعض", "غير"],
}
#: Signs that part words, what a word is made of, and the ranges of CJK characters.
APOSTROPHES = "['’ʼ]"
SEARCH_WORD = r"[\p{L}\p{N}\p{Pc}]+"
CJK = "一-鿿㐀-䶿぀-ゟ゠-ヿ가-힯"


def _stable() -> str:
    """Characters that folding never changes and that never join the one before, as ranges of a pattern."""
    out, ranges = [], []
    for c in range(0x500):
        if unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)):
            out.append(c)
    for c in [*out, *range(0x4E00, 0xA000)]:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


FOLDS = f"[^{_stable()}]"


def folded_forms(text: Column) -> Column:
    """Compatibility forms as their plain ones (NFKC). Only texts that hold a character which can change reach Python."""

    @F.pandas_udf("string")
    def nfkc(texts):
        import unicodedata

        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.coalesce(nfkc(F.when(text.rlike(FOLDS), text)), text)


def _with_grams(words: Column) -> Column:
    """Two-character grams of a word's CJK characters, after the word itself where it has Latin letters too."""

    def grams(word: Column) -> Column:
        run = F.regexp_replace(word, f"[^{CJK}]", "")
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(~word.rlike(f"[{CJK}]"), F.array(word)).when(word.rlike("[a-z]"), F.concat(F.array(word), pairs)).otherwise(pairs)

    return F.flatten(F.transform(words, grams))


def is_supported(lang: Column) -> Column:
    """Whether a language has stopwords of its own; null hasn't."""
    return F.coalesce(F.lower(lang).isin(list(SEARCH_STOPWORDS)), F.lit(False))


def _words(text: Column) -> Column:
    low = F.lower(folded_forms(text))
    words = F.regexp_extract_all(F.regexp_replace(low, APOSTROPHES, " "), F.lit(SEARCH_WORD), F.lit(0))
    return F.coalesce(F.when(low.rlike(f"[{CJK}]"), _with_grams(words)).otherwise(words), F.array().cast("array<string>"))


def _by_language(lang: Column | None, of: Callable[[list[str]], Column]) -> Column:
    """What ``of`` says of the stopwords of a language; of those of English where it is null or unknown."""
    found = of(SEARCH_STOPWORDS["en"])
    if lang is not None:
        for name in list(SEARCH_STOPWORDS)[1:]:
            found = F.when(F.lower(lang) == name, of(SEARCH_STOPWORDS[name])).otherwise(found)
    return found


def search_tokens(text: Column, lang: Column | None = None) -> Column:
    """Tokens in order; none of a null text. ``lang`` picks the stopwords, a null or unknown one those of English."""
    words = _words(text)
    return _by_language(lang, lambda stopwords: F.filter(words, lambda t: ~t.isin(stopwords)))


def token_rows(df: DataFrame, keep: list[str], text: str, lang: str | None = None) -> DataFrame:
    """``(*keep, token)``: a row for each search token. Stopwords are dropped after the rows are made, by compiled code."""
    rows = df.select(*keep, *([F.lower(lang).alias("_lang")] if lang else []), F.explode(_words(F.col(text))).alias("token"))
    return rows.where(_by_language(F.col("_lang") if lang else None, lambda stopwords: ~F.col("token").isin(stopwords))).select(*keep, "token")
