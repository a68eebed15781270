"""Column functions over text: tokens, normalisers, overlap, identifiers, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that vote for a language, in order of preference.
STOPWORDS = {
    "en": "the and or of to in a an is are shall not any unless that this by for with be from as on such which under".split(),
    "fr": "le la les de des du et ou un une est sont ne pas que qui dans par pour avec sur aux au sous doit moins sauf donnees".split(),
    "es": "el la los las de del y o un una es son no que en por para con sobre al se su sus menos salvo debe datos personales".split(),
}
MIN_DETECT_CHARS = 12
#: Fixed value: what looks like law in an address or a link's text.
LEGAL = r"(?i)(?<![a-z])(?:act|acts|statute|statutes|regulation|regulations|law|laws|gazette)(?![a-z])|\.pdf(?![a-z])"
WORD = r"[\p{L}\p{N}_]+"


def array_of(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def tokens(text: Column, pattern: str = WORD) -> Column:
    """Lower-cased tokens in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def collapsed(text: Column) -> Column:
    """White space collapsed, trimmed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def folded(text: Column) -> Column:
    """Key of a name: lower-cased, sharp s spelled out."""
    return F.replace(F.lower(F.trim(text)), F.lit("ß"), F.lit("ss"))


def document_key(text: Column) -> Column:
    return F.regexp_replace(folded(text), "[^a-z0-9]", "")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays as sets: 1 if both are empty, 0 if one is."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def occurrences(text: Column, part: Column) -> Column:
    """Number of non-overlapping occurrences of ``part``."""
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return (gone / F.length(part)).cast("long")


def keyword_score(text: Column, keywords: Column) -> Column:
    return F.aggregate(keywords, F.lit(0).cast("long"), lambda n, k: n + occurrences(text, k))


def has_keyword(text: Column, keywords: Column) -> Column:
    """Whether any keyword stands in the text: what a scan can drop rows by before it counts."""
    return F.exists(keywords, lambda k: F.contains(text, k))


def detected_language(text: Column) -> Column:
    """Language with most function words: en if the text is short, has none, or shares its top count with en."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-ZÀ-ÿ]+"), F.lit(0))
    hits = {lang: _hits(words, lang) for lang in STOPWORDS}
    best = F.greatest(*hits.values())
    found = F.when((F.length(F.trim(text)) < MIN_DETECT_CHARS) | (best == 0), "en")
    for lang, n in hits.items():
        found = found.when(n == best, lang)
    return F.coalesce(found, F.lit("en"))


def _hits(words: Column, lang: str) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(STOPWORDS[lang])))


def hashed_term(token: Column) -> Column:
    """24-bit term number: the md5 modulo 2**24."""
    return F.conv(F.substring(F.md5(token.cast("binary")), -6, 6), 16, 10).cast("long")


def hashed_bucket(token: Column, size: int = 64) -> Column:
    return F.conv(F.substring(F.md5(token.cast("binary")), -2, 2), 16, 10).cast("int") % size


def hashed_sign(token: Column) -> Column:
    byte = F.conv(F.substring(F.md5(token.cast("binary")), -6, 2), 16, 10).cast("int")
    return F.when(byte % 2 == 1, 1.0).otherwise(-1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def display_indicator(ident: Column) -> Column:
    """``6.04`` or ``P6-I4`` as ``P6-I4``; null for other shapes."""
    pattern = r"^(?:P(\d+)-I(\d+)|(\d+)\.(\d+))$"
    part = lambda i, j: F.coalesce(F.nullif(F.regexp_extract(ident, pattern, i), F.lit("")), F.regexp_extract(ident, pattern, j)).cast("int").cast("string")
    return F.when(ident.rlike(pattern), F.concat(F.lit("P"), part(1, 3), F.lit("-I"), part(2, 4)))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]+)", 1))


def normalised_url(url: Column) -> Column:
    """Scheme and host lower-cased, fragment and trailing slash dropped."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")
    head = F.regexp_extract(bare, "^([a-zA-Z]+://[^/?#]+)", 1)
    return F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))
