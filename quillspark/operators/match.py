"""The match language: terms, prefixes, phrases, AND and OR as DataFrames of matching ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import folded, tokens


def term(postings: DataFrame, word: str, key: str = "doc_id") -> DataFrame:
    return postings.filter(F.col("term") == word.lower()).select(key).distinct()


def prefix(postings: DataFrame, start: str, key: str = "doc_id") -> DataFrame:
    """The predicate reaches a Parquet scan of the postings as StringStartsWith."""
    return postings.filter(F.col("term").startswith(start.lower())).select(key).distinct()


def fold_match(docs: DataFrame, word: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of texts with a token that starts with word, accents and case aside."""
    toks = F.regexp_extract_all(folded(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[a-z][a-z0-9'_-]*"), F.lit(0))
    return docs.filter(F.exists(toks, lambda t: t.startswith(word.lower()))).select(key)


def has_phrase(text: Column, phrase: str) -> Column:
    """True where the phrase's tokens stand side by side."""
    words = " ".join(w.lower() for w in phrase.split())
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")).contains(f" {words} ")


def phrase(docs: DataFrame, words: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.filter(has_phrase(F.col(text), words)).select(key)


def any_of(*found: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), found).distinct()


def all_of(*found: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, a.columns[0], "left_semi"), found)


def where(docs: DataFrame, filters: dict, tags: DataFrame | None = None, scope: list | None = None, key: str = "doc_id") -> DataFrame:
    """docs under metadata filters: equality of known columns (unknown ones and unreadable numbers are ignored), all
    tags asked for in filters["tags"], ids in scope."""
    for name, value in filters.items():
        if name == "tags":
            for t in value:
                docs = docs.join(tags.filter(F.col("tag") == t), key, "left_semi")
        elif name in docs.columns:
            kind = docs.schema[name].dataType.simpleString()
            if kind in ("int", "bigint"):
                try:
                    value = int(value)
                except (TypeError, ValueError):
                    continue
            docs = docs.filter(F.col(name) == F.lit(value))
    return docs if scope is None else docs.filter(F.col(key).isin(*scope))
