"""Product names, tokens and barcodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no identity, and irregular plurals.
STOP_WORDS = [
    "the", "and", "or", "a", "an", "of", "for", "with", "pack", "pk", "size", "bunch", "sold", "singles", "each", "ea",
    "in", "to", "from", "whole", "carton",
]
PLURALS = {
    "tomatoes": "tomato", "potatoes": "potato", "strawberries": "strawberry", "blueberries": "blueberry", "peaches": "peach",
    "leaves": "leaf", "loaves": "loaf",
}
SYNONYMS = [
    (r"jell\s+o\b", "jello"), (r"\bmayo\b", "mayonnaise"), (r"2\s*%", "2pct"), (r"1\s*%", "1pct"), (r"\bhomogenized\b", "homo"),
    (r"\blit(re|er)s?\b", "l"), (r"\bgrams?\b", "g"), (r"\bkilograms?\b", "kg"),
]


def normalize_name(name: Column) -> Column:
    """Lower case, apostrophes dropped, amounts split from units, everything but a-z, 0-9, dot and percent a single space."""
    out = F.regexp_replace(F.lower(name), "['’]", "")
    out = F.replace(out, F.lit("jell-o"), F.lit("jello"))
    out = F.regexp_replace(out, r"(\d+(?:\.\d+)?)(kg|g|l|ml|lb|oz|ct)\b", "$1 $2")
    return F.trim(F.regexp_replace(out, "[^a-z0-9.%]+", " "))


def stem(token: Column) -> Column:
    """Singular of an English plural."""
    irregular = F.create_map(*[F.lit(x) for pair in PLURALS.items() for x in pair])
    return (
        F.when(irregular[token].isNotNull(), irregular[token])
        .when(token.rlike("(ss|us|is)$"), token)
        .when(token.endswith("ies") & (F.length(token) > 5), F.regexp_replace(token, "ies$", "y"))
        .when(token.endswith("s") & (F.length(token) > 3), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def name_tokens(name: Column) -> Column:
    """Stemmed words of a name in order, repeats kept, stop words left out."""
    out = normalize_name(name)
    for pattern, to in SYNONYMS:
        out = F.regexp_replace(out, pattern, to)
    return F.filter(F.transform(F.split(out, " "), stem), lambda t: (t != "") & ~t.isin(STOP_WORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def brands_match(a: Column, b: Column) -> Column:
    """exact, partial (the shorter of 4 or more letters lies in the longer), mismatch or missing."""
    return names_match(normalize_name(F.coalesce(a, F.lit(""))), normalize_name(F.coalesce(b, F.lit(""))))


def names_match(x: Column, y: Column) -> Column:
    """brands_match of normalised names."""
    inside = F.when(F.length(x) >= F.length(y), x.contains(y)).otherwise(y.contains(x))
    return (
        F.when((x == "") | (y == ""), "missing").when(x == y, "exact")
        .when((F.least(F.length(x), F.length(y)) >= 4) & inside, "partial").otherwise("mismatch")
    )


def normalize_upc(raw: Column) -> Column:
    """Digits of a barcode of 8 to 14 without leading zeros, else null."""
    digits = F.regexp_replace(raw, r"\D", "")
    return F.when(F.length(digits).between(8, 14), F.regexp_replace(digits, "^0+", ""))


def slug(name: Column, most: int = 42) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, most)


def script_bodies(html: Column) -> Column:
    """Bodies of all inline scripts of a page, in order."""
    return F.regexp_extract_all(html, F.lit("(?s)<script[^>]*>(.*?)</script>"), F.lit(1))
