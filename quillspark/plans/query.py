"""Queries: parsing, intents and thesaurus expansion. A query is of constant size, so this runs on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quillspark.functions.stemmer import stem
from quillspark.functions.text import FILLER_WORDS, INTENT_STRUCTURES, INTENTS, SINGLE_INTENTS, SUFFIXES_LONG, SUFFIXES_SHORT, TOKEN_PATTERNS

#: Phrases that ask rather than say.
FILLER_PHRASES = r"(?i)\b(find|search|show|get|give me|look for|tell me about|write|list|quotes about|passages on|examples of|definition of|explain)\b"
DEFINITION = r"(?i)^(?:define|definition of|what is|what'?s|meaning of|explain)\s+(.+)$"
DIRECT_WEIGHT, CONCEPT_WEIGHT, EXPANSION_LIMIT = 0.85, 0.60, 40


@dataclass
class Query:
    raw: str
    phrases: list[str] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    direct: list[str] = field(default_factory=list)
    concepts: list[str] = field(default_factory=list)
    intents: list[str] = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return not (self.tokens or self.phrases)

    @property
    def structures(self) -> set[str]:
        """Chunk structures that the intents favour."""
        return {s for i in self.intents for s in INTENT_STRUCTURES.get(i, ())}

    def terms(self, spark: SparkSession, query_id: int = 0, counted: bool = False) -> DataFrame:
        """(query_id, term, signal, qtf, weight) for the scorers. counted: a repeated token counts again."""
        rows = []
        for t in dict.fromkeys(self.stems):
            rows.append((query_id, t, "stem", self.stems.count(t) if counted else 1, 1.0))
        rows += [(query_id, t, "direct", 1, DIRECT_WEIGHT) for t in self.direct]
        rows += [(query_id, t, "concept", 1, CONCEPT_WEIGHT) for t in self.concepts]
        return spark.createDataFrame(rows, "query_id int, term string, signal string, qtf int, weight double")


def suffix_rule(word: str, rules) -> str:
    suffixes, keep = rules
    return next((word[: -len(s)] for s in suffixes if word.endswith(s) and len(word) > len(s) + keep), word)


STEMMERS = {"porter2": stem, "none": str.lower, "long": lambda w: suffix_rule(w, SUFFIXES_LONG), "short": lambda w: suffix_rule(w, SUFFIXES_SHORT)}


class Thesaurus:
    """word -> direct synonyms and concepts. Layered entries {direct, concepts} or flat lists; keys that begin with _ are
    comments; entries that are neither are ignored."""

    def __init__(self, entries: dict):
        self.direct, self.concepts = {}, {}
        for word, x in entries.items():
            if word.startswith("_") or not isinstance(x, (dict, list)):
                continue
            layered = x if isinstance(x, dict) else {"direct": x}
            self.direct[word.lower()] = [w.lower() for w in layered.get("direct", []) if isinstance(w, str)]
            self.concepts[word.lower()] = [w.lower() for w in layered.get("concepts", []) if isinstance(w, str)]

    def merged(self, other: Thesaurus) -> Thesaurus:
        """With the other's entries, which win."""
        out = Thesaurus({})
        out.direct, out.concepts = self.direct | other.direct, self.concepts | other.concepts
        return out

    def expand(self, word: str, limit: int = EXPANSION_LIMIT) -> tuple[list[str], list[str]]:
        """Two hops: synonyms and their synonyms; concepts and their synonyms' concepts. Neither holds the word itself; what
        is a concept is no synonym. The first `limit` in order of the alphabet."""
        near = set(self.direct.get(word, ()))
        direct = near.union(*(self.direct.get(w, ()) for w in near)) - {word}
        concepts = set(self.concepts.get(word, ())).union(*(self.concepts.get(w, ()) for w in near)) - {word}
        return sorted(direct - concepts)[:limit], sorted(concepts)[:limit]

    def frame(self, spark: SparkSession, stemmer: str = "porter2") -> DataFrame:
        """(word, concept, weight) of every word's two-hop expansion, the stems of phrases' words apart."""
        rows = []
        for word in dict.fromkeys((*self.direct, *self.concepts)):
            for terms, weight in zip(self.expand(word), (DIRECT_WEIGHT, CONCEPT_WEIGHT), strict=True):
                rows += [(word, STEMMERS[stemmer](w), weight) for t in terms for w in t.split()]
        return spark.createDataFrame(rows, "word string, concept string, weight double")


def parse(raw: str, thesaurus: Thesaurus | None = None, stemmer: str = "porter2", style: str = "words") -> Query:
    """Phrases in quotation marks, intents, tokens without fillers, stems, and disjoint expansions: a stem is no synonym, a
    synonym no concept. A blank query is empty."""
    q = Query(raw or "")
    q.phrases = [p.strip().lower() for p in re.findall(r'"([^"]{1,200})"', q.raw) if p.strip()]
    text = re.sub(r'"([^"]{1,200})"', " ", q.raw)
    q.intents = [n for n, p in INTENTS if re.search(p, q.raw)] or ["general"]
    text = re.sub(FILLER_PHRASES, " ", text).strip()
    if m := re.match(DEFINITION, text):
        text = m[1]
    pattern = TOKEN_PATTERNS[style].replace("(?U)", "")
    q.tokens = [t for t in re.findall(pattern, text.lower()) if t not in FILLER_WORDS and len(t) > 1]
    cut = STEMMERS[stemmer]
    q.stems = [cut(t) for t in q.tokens]
    if thesaurus:
        known, direct, concepts = set(q.stems), [], []
        for t in dict.fromkeys(q.tokens):
            d, c = thesaurus.expand(t)
            direct += [cut(x) for w in d for x in w.split()]
            concepts += [cut(x) for w in c for x in w.split()]
        q.direct = [x for x in dict.fromkeys(direct) if x not in known]
        q.concepts = [x for x in dict.fromkeys(concepts) if x not in known and x not in q.direct]
    return q


def single_intent(raw: str) -> str:
    return next((n for n, p in SINGLE_INTENTS if re.search(p, raw)), "general")
