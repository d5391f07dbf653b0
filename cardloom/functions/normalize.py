"""Scalar functions on identifiers, names, subjects and links, all of Spark's built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of a subject's categories, asked in this order.
SUBJECT_WORDS = {
    "account": ["password", "account", "verify", "security", "payment method", "update your", "log in", "login"],
    "promotion": [
        "% off", "save $", "off your", "deal", "promo", "free delivery", "last chance", "reward", " credit", "dashpass exclusive", "exclusive offer",
    ],
    "travel_ride": ["boarding pass", "itinerary", "flight", "your trip", "gate ", "uber", "lyft", "your ride"],
    "delivery": ["on the way", "out for delivery", "delivered", "delivery update", "shipped", "arriving"],
    "receipt": ["order", "receipt", "confirmation", "your order from", "confirmed"],
}
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"


def clean(text: Column) -> Column:
    """White space trimmed and made single; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def email(text: Column) -> Column:
    return F.lower(clean(text))


def slug(text: Column) -> Column:
    return F.lower(F.replace(clean(text), F.lit(" "), F.lit("-")))


def phone(text: Column) -> Column:
    """Digits only, without a leading 1 of eleven."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\D+", ""), r"^1(\d{10})$", "$1")


def handle(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(clean(text), "^@", ""), "^/+|/+$", ""))


def alias(text: Column) -> Column:
    """Lower case; all but letters, digits, _ @ . + - becomes one space."""
    return clean(F.regexp_replace(email(text), r"(?U)[^\w\s@.+-]", " "))


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard likeness of the distinct words of two aliases; 0 where either has none."""
    words = lambda x: F.filter(F.array_distinct(F.split(alias(x), " ")), lambda w: w != "")
    return F.when((F.size(words(a)) == 0) | (F.size(words(b)) == 0), 0.0).otherwise(
        F.size(F.array_intersect(words(a), words(b))) / F.size(F.array_union(words(a), words(b)))
    )


def place_key(name: Column) -> Column:
    """A place's name without "the" before it, st and ave written out."""
    out = F.regexp_replace(email(name), "^the ", "")
    return F.regexp_replace(F.regexp_replace(out, r"\bst\b\.?", "street"), r"\bave\b\.?", "avenue")


def city(address: Column) -> Column:
    """Of three or more parts the second last, else the first; lower case without punctuation."""
    parts = F.split(F.coalesce(address, F.lit("")), ",")
    return clean(F.regexp_replace(F.lower(F.when(F.size(parts) >= 3, F.element_at(parts, -2)).otherwise(parts[0])), r"(?U)[^\w\s]", ""))


def wikilinks(text: Column) -> Column:
    """Targets of [[target]] and [[target|shown]] in order, repeats included."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WIKILINK), F.lit(1)), lambda x: F.trim(x))


def path_bucket(path: Column) -> Column:
    """Top folder, with the month folder below it where there is one; "unknown" for an empty path."""
    parts = F.split(F.coalesce(path, F.lit("")), "/")
    month = (F.size(parts) >= 2) & F.get(parts, F.lit(1)).rlike(r"^\d{4}-\d{2}")
    return F.when(parts[0] == "", "unknown").when(month, F.concat_ws("/", parts[0], F.get(parts, F.lit(1)))).otherwise(parts[0])


def subject_category(subject: Column) -> Column:
    """The first category of which the lower-cased subject holds a word; else other."""
    s = F.lower(F.coalesce(subject, F.lit("")))
    held = {k: reduce(Column.__or__, (F.contains(s, F.lit(w)) for w in words)) for k, words in SUBJECT_WORDS.items()}
    return F.coalesce(*(F.when(test, F.lit(k)) for k, test in held.items()), F.lit("other"))


def in_percent_sample(uid: Column, percent: float) -> Column:
    """Whether the first four bytes of the uid's SHA-256, modulo a million, fall below ``percent``."""
    return F.coalesce(F.conv(F.substr(F.sha2(uid, 256), F.lit(1), F.lit(8)), 16, 10).cast("long") % 1_000_000 < int(percent * 10_000), F.lit(False))


def date_proximity(a: Column, b: Column, days: int = 30) -> Column:
    """1 on the same day, falling to 0 at ``days``; 0 where either is null."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(F.date_diff(a, b)) / days), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two lists of addresses as sets of their normalised, non-empty members; 0 where either is empty."""
    own = lambda x: F.array_distinct(F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), email), lambda v: v != ""))
    both = F.size(F.array_union(own(a), own(b)))
    return F.when((F.size(own(a)) == 0) | (F.size(own(b)) == 0), 0.0).otherwise(F.size(F.array_intersect(own(a), own(b))) / both)


def keyword_score(words: Column, text: Column) -> Column:
    """Share of the words that the text holds, regardless of case; 0 without words or text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.size(F.filter(words, lambda w: F.contains(low, F.lower(w))))
    return F.when((F.coalesce(F.size(words), F.lit(0)) <= 0) | (low == ""), 0.0).otherwise(hits / F.size(words))


def person_key(name: Column) -> Column:
    """Lower case, letters and digits alone, white space single."""
    return clean(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\w\s]", " "))
