"""Phonetic keys: words that sound alike in English get the same key."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values, in order of the alphabet: letters, and how they sound in a first and a second reading. Of the rows that
#: fit, the longest counts. Letters in brackets must follow but are not used up; `^` stands for the start of the word.
SOUNDS = (
    ("^A", "A", "A"), ("^E", "A", "A"), ("^I", "A", "A"), ("^O", "A", "A"), ("^U", "A", "A"),
    ("B", "P", "P"), ("BB", "P", "P"),
    ("C", "K", "K"), ("C(E)", "S", "S"), ("C(I)", "S", "S"), ("C(Y)", "S", "S"), ("CH", "X", "K"),
    ("D", "T", "T"), ("DGE", "J", "J"), ("DGI", "J", "J"), ("DGY", "J", "J"),
    ("F", "F", "F"), ("FF", "F", "F"),
    ("G", "K", "K"), ("G(E)", "J", "K"), ("G(I)", "J", "K"), ("G(N)", "N", "KN"), ("G(Y)", "J", "K"), ("GH", "K", "K"),
    ("H(A)", "H", "H"), ("H(E)", "H", "H"), ("H(I)", "H", "H"), ("H(O)", "H", "H"), ("H(U)", "H", "H"),
    ("J", "J", "H"), ("K", "K", "K"), ("KK", "K", "K"), ("L", "L", "L"), ("LL", "L", "L"),
    ("M", "M", "M"), ("MM", "M", "M"), ("N", "N", "N"), ("NN", "N", "N"),
    ("P", "P", "P"), ("PH", "F", "F"), ("PP", "P", "P"), ("Q", "K", "K"), ("QQ", "K", "K"), ("R", "R", "R"), ("RR", "R", "R"),
    ("S", "S", "S"), ("SCH", "SK", "SK"), ("SH", "X", "X"), ("SI(A)", "X", "X"), ("SI(O)", "X", "X"), ("SS", "S", "S"),
    ("T", "T", "T"), ("T(IA)", "X", "X"), ("T(IO)", "X", "X"), ("TH", "0", "T"), ("TT", "T", "T"),
    ("V", "F", "F"), ("VV", "F", "F"),
    ("W(A)", "W", "W"), ("W(E)", "W", "W"), ("W(I)", "W", "W"), ("W(O)", "W", "W"), ("W(U)", "W", "W"),
    ("X", "SK", "SK"),
    ("Y(A)", "Y", "Y"), ("Y(E)", "Y", "Y"), ("Y(I)", "Y", "Y"), ("Y(O)", "Y", "Y"), ("Y(U)", "Y", "Y"),
    ("Z", "S", "S"), ("ZZ", "S", "S"),
)
#: Letters of each reading that a key keeps.
LENGTH = 6


def _readers() -> re.Pattern:
    """One pattern of all rows, each a group of its number, the longest first."""
    rows = sorted(enumerate(SOUNDS), key=lambda r: -len(re.sub(r"[()^]", "", r[1][0])))
    return re.compile("|".join(f"(?P<r{i}>{group.replace('(', '(?=')})" for i, (group, _, _) in rows))


_PATTERN = _readers()


def key(word: str) -> str:
    """Both readings of a word, LENGTH letters each; one if they agree or the second is empty. Other letters than A to Z
    are left out; letters that no row fits are silent."""
    found = [SOUNDS[int(m.lastgroup[1:])] for m in _PATTERN.finditer(re.sub("[^A-Z]", "", word.upper()))]
    first, second = ("".join(row[k] for row in found)[:LENGTH] for k in (1, 2))
    return f"{first}|{second}" if second and second != first else first


def keys(terms: DataFrame, term: str = "term") -> DataFrame:
    """(term, key) of the distinct terms."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"term": p["term"], "key": [key(t) for t in p["term"]]})

    distinct = terms.select(terms[term].alias("term")).filter("term IS NOT NULL").distinct()
    tasks = 2 * terms.sparkSession.sparkContext.defaultParallelism  # few bytes, much work: else one task may get all
    return distinct.repartition(tasks).mapInPandas(run, "term string, key string")
