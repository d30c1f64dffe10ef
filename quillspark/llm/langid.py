"""Language identification by cross-parsing entropy.

Labelled text of each language goes into a suffix automaton. A text is parsed against each automaton: a phrase is the
longest stretch, from where the last one ended, that occurs in that language's text. The fewer phrases, the closer the
language; a count is normalised by log2 of the automaton's text length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, attached, discard, held_out, learns, parts, scratch, ship, unused

FOLDS = 5
#: Bounds of what is learned from: documents read for a language, letters kept of them.
SAMPLE_DOCS, SAMPLE_LETTERS = 96, 40_000
#: Letters of a stretch. All stretches of many texts are parsed in step, and then joined (counts).
STRETCH = 512
#: Letters of a batch parsed at once.
PORTION = 2_000_000
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def normalised(text: str) -> str:
    """Lower-cased letters, every run of other characters as one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def sample(docs: DataFrame, folds: int = FOLDS) -> dict[str, str]:
    """Training text of each language: about SAMPLE_DOCS documents, chosen by hash of the id, and SAMPLE_LETTERS letters
    of them at most. No document has more of the letters than the others could fill. Only text and lang of learnable rows
    are used; an id counts once in a language, with the first of its texts in order. One pass counts languages, one reads
    the chosen texts; these are cut to their share in a task for each language, so that the driver gets SAMPLE_LETTERS
    letters of each."""
    rows = docs.select(docs["doc_id"], docs["lang"], docs["text"]).filter(learns(F.col("doc_id"), folds) & F.col("lang").isNotNull())
    counts = scratch(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    h = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30))
    chosen = attached(rows, counts.withColumn("few", F.col("n")), ["lang"], counts.agg(F.sum("n")).first()[0] or 0).filter(h < F.floor(F.lit(float((1 << 30) * SAMPLE_DOCS)) / F.col("few")) + 1)
    chosen = chosen.groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, SAMPLE_LETTERS)).alias("text")).select("lang", h.alias("h"), "doc_id", "text")

    def cut(some: pa.Table) -> pa.Table:
        from quillspark.llm.langid import normalised, shared

        read = sorted((r["h"], r["doc_id"], normalised(r["text"] or "")) for r in some.to_pylist())
        return pa.table({"lang": some.column("lang")[:1], "text": [" ".join(shared([t for *_, t in read if t], SAMPLE_LETTERS))]})

    read = chosen.groupBy("lang").applyInArrow(cut, "lang string, text string").filter("text <> ''").collect()
    discard(counts)
    return {r["lang"]: r["text"] for r in sorted(read)}


def shared(texts: list[str], letters: int) -> list[str]:
    """Heads of texts that together, with a blank after each, have at most so many letters: the longest are cut to one
    length, so that no text takes the room of others."""
    room, most = letters, 0
    for k, n in enumerate(sorted(len(t) + 1 for t in texts)):
        most = room // (len(texts) - k)
        if n > most:
            break
        room -= n
        most = n
    return [t[: most - 1] for t in texts if most > 1]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a text: [state][code] is the next state. State 0 is the start."""
    link, length, moves = [-1], [0], [{}]
    last = 0
    for c in codes:
        cur = len(link)
        length.append(length[last] + 1)
        link.append(0)
        moves.append({})
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(link)
                length.append(length[p] + 1)
                link.append(link[q])
                moves.append(dict(moves[q]))
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


class Transitions:
    """Sparse transitions, the rows of all states laid into one another: state s moves by code c where
    owner[base[s] + c] == s, and then to state target[base[s] + c]."""

    def __init__(self, moves: list[dict[int, int]], letters: int):
        one = [s for s, m in enumerate(moves) if len(m) == 1]
        many = sorted((s for s, m in enumerate(moves) if len(m) > 1), key=lambda s: -len(moves[s]))
        size = 2 * letters + sum(map(len, moves))
        taken = bytearray(size)
        base = [0] * len(moves)
        at, tries = letters, 0
        for s in many:
            codes = sorted(moves[s])
            low, rest = codes[0], codes[1:]
            tries, k = 0, taken.find(0, at)
            while True:
                if k < 0 or k + letters >= len(taken):
                    taken.extend(bytes(len(taken)))
                    k = taken.find(0, k if k >= 0 else at)
                    continue
                b = k - low
                if not any(taken[b + c] for c in rest):
                    break
                tries += 1
                k = taken.find(0, k + 1)
            for c in codes:
                taken[b + c] = 1
            base[s] = b
            if tries > 32:  # crowded so far: rows of one move fill what is left behind
                at += (k - at) // 2
        free = np.flatnonzero(np.frombuffer(taken, np.uint8)[letters:] == 0) + letters
        if len(free) < len(one):
            free = np.append(free, np.arange(len(taken), len(taken) + len(one) - len(free)))
        for s, k in zip(one, free.tolist(), strict=False):
            base[s] = k - next(iter(moves[s]))
        self.base = np.array(base, np.int32)
        self.owner = np.full(max(base) + letters + 1, -1, np.int32)
        self.target = np.zeros(len(self.owner), np.int32)
        state = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
        slot = self.base[state] + np.array([c for m in moves for c in m], np.int64)
        self.owner[slot], self.target[slot] = state, np.array([t for m in moves for t in m.values()], np.int32)
        #: of the start, for every code: the next state, or -1
        self.first = np.full(letters, -1, np.int32)
        for c, t in moves[0].items():
            self.first[c] = t

    def follow(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next states, or -1."""
        slot = self.base[state] + code
        return np.where(self.owner[slot] == state, self.target[slot], np.int32(-1))


class Parser:
    """Automata of all languages and the parse of many texts at once."""

    def __init__(self, texts: dict[str, str]):
        self.languages = list(texts)
        counts: dict[str, int] = {}
        for t in texts.values():
            for c in set(t):
                counts[c] = counts.get(c, 0) + t.count(c)
        known = sorted((c for c in counts if c != " "), key=lambda c: (-counts[c], c))
        #: code 0: no letter, 1: a letter that no training text has
        self.code = {" ": 0} | {c: i + 2 for i, c in enumerate(known)}
        self.letters = len(known) + 2
        self.table = np.zeros(0x110000, np.int32)
        for x in range(0x110000):
            if chr(x).isalpha():
                self.table[x] = 1
        for c, i in self.code.items():
            self.table[ord(c)] = i
        self.automata = [Transitions(suffix_automaton([self.code[c] for c in t]), self.letters) for t in texts.values()]
        self.bits = np.array([np.log2(max(2, len(t))) for t in texts.values()])

    def codes(self, text: str) -> np.ndarray:
        x = self.table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
        return x[keep]

    def step(self, automaton: Transitions, state: np.ndarray, code: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Next states; adds to count the phrases that end before this letter, or with it if it was never seen."""
        to = automaton.follow(state, code)
        miss = np.flatnonzero(to < 0)
        again = automaton.first[code[miss]]
        count[miss] += (state[miss] > 0).astype(np.int32) + (again < 0)
        to[miss] = np.maximum(again, 0)
        return to

    def parsed(self, automaton: Transitions, x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases ended in, and state at the end of, each stretch (a column of codes, the longest first) that begins a
        new phrase."""
        state, count = np.zeros(x.shape[1], np.int32), np.zeros(x.shape[1], np.int32)
        for t in range(len(x)):
            n = live[t]
            if not n:
                break
            state[:n] = self.step(automaton, state[:n], x[t, :n], count[:n])
        return count, state

    def counts(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each whole text in each language. Every stretch is first parsed as if it began a phrase. Then those
        that continue a text are parsed again from the state that the one before ends in, beside the first parse, until
        both are in one state: from there on they agree. A stretch where that never happens hands its own end state on,
        and the next is done once more."""
        flat = np.concatenate(texts)
        sizes = np.array([len(t) for t in texts])
        pieces = np.maximum(1, -(-sizes // STRETCH))
        owner = np.repeat(np.arange(len(texts)), pieces)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])[owner] + within * STRETCH
        lengths = np.minimum(STRETCH, np.repeat(sizes, pieces) - within * STRETCH)
        order = np.argsort(-lengths, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        x = np.append(flat, np.zeros(STRETCH, np.int32))[begin[order][None, :] + np.arange(STRETCH)[:, None]]
        live = np.searchsorted(-lengths[order], -np.arange(STRETCH), "left")
        later = np.flatnonzero(within > 0)
        last = np.cumsum(pieces) - 1
        out = np.zeros((len(self.automata), len(texts)), np.int64)
        for k, automaton in enumerate(self.automata):
            count, state = (v[place] for v in self.parsed(automaton, x, live))
            fresh, came = state.copy(), np.zeros(len(owner), np.int32)
            change = np.zeros(len(owner), np.int64)
            todo = later[state[later - 1] != 0]
            while len(todo):
                came[todo] = state[todo - 1]
                a, b = came[todo], np.zeros(len(todo), np.int32)
                ca, cb = np.zeros(len(todo), np.int32), np.zeros(len(todo), np.int32)
                going, end = np.arange(len(todo)), fresh[todo]
                for t in range(STRETCH):
                    going = going[lengths[todo[going]] > t]
                    if not len(going):
                        break
                    code = x[t, place[todo[going]]]
                    na, nb = ca[going], cb[going]
                    a[going], b[going] = self.step(automaton, a[going], code, na), self.step(automaton, b[going], code, nb)
                    ca[going], cb[going] = na, nb
                    apart = a[going] != b[going]
                    done = (lengths[todo[going]] == t + 1) & apart
                    end[going[done]] = a[going[done]]
                    going = going[apart]
                change[todo], state[todo] = ca - cb, end
                after = todo[(todo + 1 < len(owner))] + 1
                todo = after[(within[after] > 0) & (state[after - 1] != came[after])]
            out[k] = np.bincount(owner, count + change, len(texts)).astype(np.int64) + (state[last] > 0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def settle():
            if not held:
                return
            n = self.counts([c for _, c in held]) * self.bits[:, None]
            least = n.min(axis=0)
            share = (least / n) ** 8
            share /= share.sum(axis=0)
            for j, (i, _) in enumerate(held):
                k = int(n[:, j].argmin())
                langs[i], scores[i] = self.languages[k], float(share[k, j])

        for i, t in enumerate(texts):
            if not t or not self.languages:
                continue
            c = self.codes(t)
            if c.any():
                held.append((i, c))
                size += len(c)
                if size >= PORTION:
                    settle()
                    held, size = [], 0
        settle()
        return langs, scores


def identify(docs: DataFrame, folds: int = FOLDS, keep: bool = False) -> DataFrame:
    """Predict the language of every whole text: doc_id, held_out, lang_pred, score (0 to 1: the share of the best
    language among all, by phrases to the power -8); with keep, docs' own columns and lang_pred and lang_score instead
    (the last two, with marks after their names where docs has columns named so).

    Null texts and texts without a letter give `und` and 0, as does every row if nothing can be learned from. Ties go
    to the language first in order. Repeated rows are predicted each; very long texts are parsed whole.
    Every value of lang is learned and every letter of the sample has a code of its own; a letter that no training text
    has matches nothing. Memory: the automata (bounded by the sample of each language) and PORTION letters."""
    spark = docs.sparkSession
    ship(spark)
    # built once; a worker gets the arrays
    shared_parser = spark.sparkContext.broadcast(Parser(sample(docs, folds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone({})
        parser = shared_parser.value
        for b in parts(batches, 2_000):
            at = b.num_columns - 1
            langs, scores = parser.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    text = docs["text"].cast("string").alias(unused("_text", docs.columns))
    if keep:
        names = [*docs.columns, unused("lang_pred", docs.columns), unused("lang_score", docs.columns)]
        schema = docs.select(*docs.columns, F.lit("").alias(names[-2]), F.lit(0.0).alias(names[-1])).schema
        return docs.select(*docs.columns, text).mapInArrow(run, schema)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"], folds).alias("held_out"), text).mapInArrow(run, SCHEMA)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict[str, str] = {}
