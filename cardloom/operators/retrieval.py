"""Plain lexical match, and the score of a reranker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != F.lit("")))


def and_match(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """Rows that hold every term, and how often they hold any."""
    held = F.filter(F.split(F.lower(F.col(text)), "[^a-z0-9]+"), lambda w: w.isin(terms))
    return docs.select(key, held.alias("held")).filter(F.size(F.array_distinct("held")) == len(set(terms))).select(key, F.size("held").cast("long").alias("hits"))


def rerank_score(query: Column, text: Column) -> Column:
    """Half the share of the query's tokens that the text holds, half their Jaccard index; tokens, of any script, of one letter don't count."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 1))
    q, t = tokens(query), tokens(text)
    both = F.size(F.array_intersect(q, t))
    return F.round(F.least(F.lit(1.0), 0.5 * both / F.greatest(F.size(q), F.lit(1)) + 0.5 * both / F.greatest(F.size(F.array_union(q, t)), F.lit(1))), 6)
